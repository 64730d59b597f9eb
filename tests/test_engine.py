"""The diversity engine: goldens, files, edge cases, and the registered queries against DuckDB."""

import gzip
import math
import os

import duckdb
import pytest

from varidia import cli
from varidia.functions.codons import CODE, CODONS, pair_class, site_shares
from varidia.functions.counts import PAIRS
from varidia.operators.cds import chunks, overlapping_positions
from varidia.operators.coding import transcript_statistics
from varidia.operators.pileup import merge_records, minor_allele_filter, pooled_pairs
from varidia.plans.analysis import analyse_files, diversity
from varidia.plans.queries import ORACLES, QUERIES, RATES
from varidia.sources.readers import read_fasta, read_rates, read_sync, read_vcf
from varidia.sources.writers import write_sync

SF = "/root/testdata/sf0.001"
GENOME = "ATGTTTTATGGGTGG"


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("micro")
    (d / "r.fasta").write_text(f">c1\n{GENOME}\n")
    (d / "a.gtf").write_text('#x\nc1\tx\tCDS\t1\t15\t.\t+\t0\tgene_id "g1"; transcript_id "t1";\n')
    rows = [("6", "T", "C", "80:20"), ("9", "T", "A", "90:10"), ("11", "G", "T", "50:50")]
    (d / "v.vcf").write_text("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tx\n" + "".join(f"c1\t{p}\t.\t{r}\t{a}\t.\t.\t.\tRD:AD\t{v}\n" for p, r, a, v in rows))
    return d


def test_micro_example(spark, files):
    out = analyse_files(spark, str(files / "v.vcf"), str(files / "r.fasta"), str(files / "a.gtf"), maf=0.0)
    g = out.genes.first()
    for name, value in {"N_sites": 12.666666667, "S_sites": 2.233333333, "pi": 0.067340067, "piN": 0.054226475, "piS": 0.323232323232 / 2.233333333333}.items():
        assert g[name] == pytest.approx(value, abs=1e-9)
        assert g[f"{name}_no_overlap"] == pytest.approx(value, abs=1e-9)
    assert out.samples.first()["piN"] == pytest.approx(0.054226475, abs=1e-9)
    assert out.contigs.first()["contig_length"] == 15


def test_pi_only_and_written_reports(spark, files, tmp_path):
    out = analyse_files(spark, str(files / "v.vcf"), str(files / "r.fasta"), output_file_prefix=str(tmp_path / "x"), maf=0.0)
    assert out.genes is None
    assert os.path.isdir(tmp_path / "x_samples") and os.path.isdir(tmp_path / "x_sites" / "contig=c1")


def test_command_line_and_gzip(spark, files, tmp_path):
    """Written reports, which share stored statistics, equal the lazy ones."""
    packed = tmp_path / "v.vcf.gz"
    packed.write_bytes(gzip.compress((files / "v.vcf").read_bytes()))
    assert cli.main(["-v", str(packed), "-r", str(files / "r.fasta"), "-g", str(files / "a.gtf"), "-o", str(tmp_path / "run"), "--maf", "0"]) == 0
    lazy = analyse_files(spark, str(files / "v.vcf"), str(files / "r.fasta"), str(files / "a.gtf"), maf=0.0)
    for name, df in (("genes", lazy.genes), ("samples", lazy.samples)):
        got, want = spark.read.csv(str(tmp_path / f"run_{name}"), header=True).collect(), df.collect()
        assert len(got) == len(want) == 1 and float(got[0]["piN"]) == pytest.approx(want[0]["piN"], abs=1e-12)
    assert lazy.genes.first()["chunk_id"] == 0
    assert spark.read.csv(str(tmp_path / "run_sites"), header=True).count() == 3


def test_region_of_a_vcf(spark, files):
    assert {r["pos"] for r in read_vcf(spark, str(files / "v.vcf"), region=("c1", 5, 8)).collect()} == {5}
    assert read_vcf(spark, str(files / "v.vcf"), region=("c", 0, 100)).isEmpty()


def test_folder_of_fasta_files(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">c1 one\nACG\nT\n>c2\nGG\n")
    (tmp_path / "b.fasta").write_text("; text before\n>c3\nTTT\n")
    blocks, contigs = read_fasta(spark, str(tmp_path))
    assert {(r["contig"], r["length"]) for r in contigs.collect()} == {("c1", 4), ("c2", 2), ("c3", 3)}
    assert {(r["contig"], r["seq"]) for r in blocks.collect()} == {("c1", "ACGT"), ("c2", "GG"), ("c3", "TTT")}


def test_codon_goldens():
    share = site_shares()
    assert [share["CTG", i] for i in range(3)] == [pytest.approx((1 / 3, 2 / 3)), pytest.approx((0, 1)), pytest.approx((1, 0))]
    assert sum(s for s, _ in share.values()) == pytest.approx(46.6667, abs=1e-4)
    assert sum(n for _, n in site_shares(include_stops=True).values()) == pytest.approx(146)
    assert site_shares(RATES)["TTT", 2][0] == pytest.approx(0.5)
    assert len(CODE) == 64
    # each pair of a codon with one of the three other bases is of one class
    assert sum(sum(pair_class(c, i, p)) for c in CODONS for i in range(3) for p in PAIRS) == 64 * 9
    assert sum(pair_class(c, i, p)[0] for c in CODONS for i in range(3) for p in PAIRS) == 138


@pytest.mark.parametrize("row, expect", [((10, 90, 0, 0), (10, 90, 0, 0)), ((9, 91, 0, 0), (0, 91, 0, 0)), ((0, 0, 0, 0), (0, 0, 0, 0)), ((1, 0, 0, 0), (1, 0, 0, 0))])
def test_minor_allele_filter_is_strict(spark, row, expect):
    df = spark.createDataFrame([("s", "c", 0, *row)], "sample_id string, contig string, pos long, a long, c long, g long, t long")
    got = minor_allele_filter(df, 0.1).first()
    assert tuple(got[k] for k in "acgt") == expect


def _pile(spark, rows):
    return spark.createDataFrame(rows, "sample_id string, contig string, pos long, a long, c long, g long, t long")


def test_minus_strand_and_unknown_bases(spark):
    """The reverse complement read on the minus strand gives the plus strand's statistics; N has no sites."""
    flip = str.maketrans("ACGT", "TGCA")
    plus = _pile(spark, [("s", "c", 5, 0, 20, 0, 80), ("s", "c", 10, 0, 0, 50, 50), ("n", "c", 2, 0, 0, 3, 0)])
    minus = _pile(spark, [("s", "c", 9, 80, 0, 20, 0), ("s", "c", 4, 50, 50, 0, 0), ("n", "c", 12, 0, 3, 0, 0)])
    kind = "contig string, pos long, base string"
    exon = "contig string, transcript_id string, gene_id string, strand string, exon_ord long, start long, end long"
    out = []
    for pile, seq, strand in ((plus, GENOME, "+"), (minus, GENOME[::-1].translate(flip), "-")):
        ref = spark.createDataFrame([("c", i, b) for i, b in enumerate(seq)], kind)
        ex = spark.createDataFrame([("c", "t", "g", strand, 0, 0, 15)], exon)
        out.append({r["sample_id"]: r for r in transcript_statistics(pile, ex, ref).collect()})
    for s in ("s", "n"):
        for k in ("pi", "piN", "piS", "N_sites", "S_sites"):
            assert out[0][s][k] == pytest.approx(out[1][s][k], abs=1e-12)
    ref = spark.createDataFrame([("c", i, b) for i, b in enumerate("NTGTTT")], kind)
    r = transcript_statistics(_pile(spark, [("s", "c", 1, 0, 0, 0, 5)]), spark.createDataFrame([("c", "t", "g", "+", 0, 0, 6)], exon), ref).first()
    assert r["N_sites"] + r["S_sites"] == pytest.approx(3)


def test_overlaps_chunks_and_bad_lengths(spark):
    exon = "contig string, transcript_id string, gene_id string, strand string, exon_ord long, start long, end long"
    ex = spark.createDataFrame([("c", "a", "g", "+", 0, 0, 9), ("c", "b", "g", "+", 1, 3, 9), ("c", "d", "h", "+", 2, 7, 17)], exon)
    assert sorted(r["pos"] for r in overlapping_positions(ex).collect()) == [7, 8]
    contigs = spark.createDataFrame([("c", 30, 0)], "contig string, length long, contig_ord int")
    assert [(r["start"], r["end"]) for r in chunks(ex, contigs, 5).orderBy("start").collect()] == [(0, 17), (17, 20), (20, 25), (25, 30)]
    ref = spark.createDataFrame([("c", i, "A") for i in range(30)], "contig string, pos long, base string")
    out = diversity(_pile(spark, [("s", "c", 1, 5, 5, 0, 0)]), ref, contigs, ex, maf=0.0)
    rows = {r["transcript_id"]: r for r in out.genes.collect()}
    assert rows["d"]["pi"] is None and rows["d"]["transcript_len_no_overlap"] == 10
    assert [r["transcript_id"] for r in out.rejected.collect()] == ["d"]


def test_empty_tables(spark):
    empty = _pile(spark, [])
    contigs = spark.createDataFrame([("c", 30, 0)], "contig string, length long, contig_ord int")
    ref = spark.createDataFrame([], "contig string, pos long, base string")
    out = diversity(empty, ref, contigs)
    assert out.samples.count() == out.sites.count() == out.contigs.count() == 0


def test_split_records_and_rd_merge(spark, tmp_path):
    head = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tx\n"
    (tmp_path / "v.vcf").write_text(head + "c\t1\t.\tG\tT\t.\t.\t.\tRD:AD\t50:7\nc\t1\t.\tG\tC\t.\t.\t.\tAD:RD\t5:.\n")
    for merge in ("sum", "max"):
        r = read_vcf(spark, str(tmp_path / "v.vcf"), merge).first()
        assert (r["a"], r["c"], r["g"], r["t"]) == (0, 5, 50, 7)
    with pytest.raises(ValueError):
        read_vcf(spark, "x", "other")


def test_sync_round_trip(spark, tmp_path):
    pile = _pile(spark, [("x", "c", 4, 1, 2, 3, 4), ("y", "c", 4, 5, 6, 7, 8)])
    ref = spark.createDataFrame([("c", 4, "A")], "contig string, pos long, base string")
    write_sync(pile, ref, ["x", "y"], str(tmp_path / "s"))
    key = lambda r: r["sample_id"]
    assert sorted(read_sync(spark, str(tmp_path / "s")).collect(), key=key) == sorted(pile.collect(), key=key)
    assert merge_records(pile.unionByName(pile)).filter("sample_id = 'x'").first()["t"] == 8
    assert pooled_pairs(pile).filter("sample_1 = 'x' and sample_2 = 'y'").first()["a"] == 6
    assert pooled_pairs(pile).filter("sample_1 = 'x' and sample_2 = 'x'").first()["a"] == 2


def test_rates(tmp_path):
    m = [[0, 1, 2, 1], [1, 0, 1, 2], [2, 1, 0, 1], [1, 2, 1, 0]]
    (tmp_path / "r.csv").write_text("\n".join(",".join(map(str, r)) for r in m))
    assert read_rates(str(tmp_path / "r.csv")) == read_rates(m) == RATES
    with pytest.raises(ValueError):
        read_rates([[1, 2], [3, 4]])
    with pytest.raises(NotImplementedError):
        read_rates("x.dat")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("part", "lineitem"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    value = lambda x: round(x, 7) + 0.0 if isinstance(x, float) and not math.isnan(x) else x
    rows = lambda it, names: sorted((repr([value(r[names.index(c)]) for c in order]) for r in it))
    assert rows((tuple(r) for r in df.collect()), df.columns) == rows(want.fetchall(), columns)


def test_goldens_of_the_derived_inputs(spark):
    """FIXTURES.md, section 3, at sf0.01."""
    sf = "/root/testdata/sf0.01"
    pi = {r["sample_id"]: r["pi"] for r in QUERIES["sample_pi"](spark, sf).collect()}
    assert [pi[f"s{i}"] for i in range(5)] == pytest.approx([0.126663924, 0.120313092, 0.119181307, 0.120572586, 0.122880445], abs=1e-8)
    rows = {(r["sample_id"], r["transcript_id"]): r for r in QUERIES["gene_report"](spark, sf).collect()}
    for key, n, s, pin, pis, over in [
        (("s0", "ctg0_A1"), 35.1928974, 6.8071026, 0.1588102, 0.1174544, 4), (("s0", "ctg0_A2"), 22.7896269, 4.2103731, 0.1630765, 0.1020055, 0),
        (("s0", "ctg0_B1"), 23.7549699, 6.0168747, 0.1526728, 0.1753754, 4), (("s3", "ctg7_B1"), 24.6648400, 4.9200656, 0.1100369, 0.0793739, 3),
    ]:
        r = rows[key]
        assert [r["N_sites"], r["S_sites"], r["piN"], r["piS"]] == pytest.approx([n, s, pin, pis], abs=1e-6)
        assert r["transcript_len"] - r["transcript_len_no_overlap"] == over
    assert sum(r["N_sites"] or 0 for r in rows.values()) == pytest.approx(8408.7546, abs=1e-3)
