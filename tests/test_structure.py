"""FST, windows, interval joins, sweeps, spliced consensus and annotation trees against brute force on random inputs."""

import glob
import random
import struct
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from varidia import cli
from varidia.operators.cds import overlap_intervals, overlapping_transcripts, variants_in_exons
from varidia.operators.coding import coding_site_values, gene_exons, pair_classes, transcript_statistics
from varidia.operators.fst import fst, pair_sums
from varidia.operators.intervals import overlapping, points_in
from varidia.operators.pileup import BLOCK, consensus_blocks, consensus_sequences
from varidia.operators.windows import sliding_pi
from varidia.plans.analysis import analyse_files, diversity
from varidia.sources.blockgzip import index_members, is_block_gzip, members_of, read_lines
from varidia.sources.readers import read_fasta, read_gtf, read_rates, read_vcf, top_ancestors, vcf_record_counts
from varidia.sources.shared import leftover, removed, written
from varidia.sources.store import PileupStore
from varidia.sources.writers import write_consensus, write_vcf

PILEUP = "sample_id string, contig string, pos long, a long, c long, g long, t long"
EXONS = "contig string, transcript_id string, gene_id string, strand string, exon_ord long, start long, end long"


def random_pileup(rng, samples=5, contigs=("c1", "c2"), length=60, share=0.6):
    rows = []
    for s in range(samples):
        for c in contigs:
            for p in range(length):
                if rng.random() < share:
                    rows.append((f"s{s}", c, p, *(rng.choice((0, 0, 1, 5, 9)) for _ in "acgt")))
    return rows


def plain_fst(rows, by_contig):
    at = defaultdict(dict)
    for s, c, p, *n in rows:
        if sum(n) > 1:
            at[c, p][s] = n
    sums = defaultdict(lambda: [0.0, 0.0, 0])
    for (c, _), got in at.items():
        pi = {s: sum(n[i] * n[j] for i in range(4) for j in range(i)) / (sum(n) * (sum(n) - 1) / 2) for s, n in got.items()}
        for s in got:
            for t in got:
                if s < t:
                    x = sums[(s, t, c) if by_contig else (s, t)]
                    x[0] += (pi[s] + pi[t]) / 2
                    x[1] += 1 - sum(a / sum(got[s]) * b / sum(got[t]) for a, b in zip(got[s], got[t], strict=True))
                    x[2] += 1
    return {k: (n, 1 - w / b) for k, (w, b, n) in sums.items()}


@pytest.mark.parametrize("block", [1, 2, 512])
def test_fst_is_the_ratio_of_sums_whatever_the_blocks(spark, block):
    rows = random_pileup(random.Random(1))
    df = spark.createDataFrame(rows, PILEUP).repartition(3)
    for by_contig in (False, True):
        want = plain_fst(rows, by_contig)
        got = {tuple(r[k] for k in ("sample_1", "sample_2", *(["contig"] if by_contig else []))): (r["n_sites"], r["fst"]) for r in fst(df, by_contig=by_contig, block=block).collect()}
        assert set(got) == set(want)
        for k, (n, value) in want.items():
            assert got[k][0] == n and got[k][1] == pytest.approx(value, abs=1e-9)


def test_fst_of_listed_pairs_shuffles_no_rows_of_pairs_and_sites(spark):
    rows = random_pileup(random.Random(2), samples=6)
    df = spark.createDataFrame(rows, PILEUP)
    pairs = spark.createDataFrame([("s3", "s1"), ("s1", "s3"), ("s0", "s5")], "sample_1 string, sample_2 string")
    want = plain_fst(rows, False)
    got = {(r["sample_1"], r["sample_2"]): r["fst"] for r in fst(df, pairs=pairs).collect()}
    assert set(got) == {("s1", "s3"), ("s0", "s5")} and all(v == pytest.approx(want[k][1]) for k, v in got.items())
    assert pair_sums(df.filter("contig = 'c1'")).count() == 15  # a row for each pair and task at most meets the shuffle
    alone = spark.createDataFrame([("x", "c", 1, 5, 0, 0, 0), ("y", "c", 2, 5, 0, 0, 0), ("x", "c", 3, 4, 0, 0, 0), ("y", "c", 3, 9, 0, 0, 0)], PILEUP)
    assert [(r["n_sites"], r["fst"]) for r in fst(alone).collect()] == [(1, None)]  # one common site, no difference
    assert fst(alone.limit(0)).count() == 0


def test_kinds_of_fst_add_up_to_the_whole_on_coding_sites(spark):
    rng = random.Random(3)
    genome = "".join(rng.choice("ACGT") for _ in range(60))
    exons = spark.createDataFrame([("c1", "t1", "g", "+", 0, 3, 33), ("c1", "t2", "g", "-", 1, 36, 57)], EXONS)
    reference = spark.createDataFrame([("c1", i, b) for i, b in enumerate(genome)], "contig string, pos long, base string")
    rows = [r for r in random_pileup(rng, contigs=("c1",)) if 3 <= r[2] < 33 or 36 <= r[2] < 57]
    classes = pair_classes(exons, reference)
    sums = {(r["sample_1"], r["sample_2"], r["kind"]): r["between"] for r in pair_sums(spark.createDataFrame(rows, PILEUP), classes).collect()}
    own = spark.createDataFrame([(*r[:3], *((n if b in (genome[r[2]], "A") else 0) for b, n in zip("ACGT", r[3:], strict=True))) for r in rows], PILEUP)
    both = {(r["sample_1"], r["sample_2"], r["kind"]): r["between"] for r in pair_sums(own.filter(F.lit(True)), classes).collect()}
    assert all(sums[s, t, "N"] + sums[s, t, "S"] <= sums[s, t, "all"] + 1e-9 for s, t, _ in sums)
    # with only the reference base and A at a site, every difference is of one of the two kinds
    assert all(both.get((s, t, "N"), 0) + both.get((s, t, "S"), 0) == pytest.approx(both[s, t, "all"]) for s, t, k in both if k == "all")


@pytest.mark.parametrize(("width", "step", "block"), [(10, 3, 2), (7, 7, 4096), (4, 9, 1), (50, 1, 5)])
def test_sliding_windows(spark, width, step, block):
    rng = random.Random(width)
    lengths = {"c1": 97, "c2": 30}
    sites = [(s, c, p, rng.random() if rng.random() < 0.8 else 0.0) for s in "xy" for c, n in lengths.items() for p in range(n) if rng.random() < 0.2]
    got = {(r["sample_id"], r["contig"], r["start"]): r for r in sliding_pi(spark.createDataFrame(sites, "sample_id string, contig string, pos long, pi double"), spark.createDataFrame(list(lengths.items()), "contig string, length long"), width, step, block).collect()}
    want = {}
    for s in "xy":
        for c, n in lengths.items():
            for start in range(0, n, step):
                inside = [v for a, b, p, v in sites if (a, b) == (s, c) and start <= p < start + width]
                if inside:
                    want[s, c, start] = (min(width, n - start), len(inside), sum(inside) / min(width, n - start))
    assert set(got) == set(want)
    assert all((got[k]["window_length"], got[k]["n_sites"]) == w[:2] and got[k]["pi"] == pytest.approx(w[2], abs=1e-12) for k, w in want.items())


def test_windows_over_all_of_a_contig_are_the_transcripts_statistics(spark):
    rng = random.Random(9)
    genome = "".join(rng.choice("ACGT") for _ in range(90))
    exons = spark.createDataFrame([("c1", "t1", "g", "-", 0, 6, 66)], EXONS)
    reference = spark.createDataFrame([("c1", i, b) for i, b in enumerate(genome)], "contig string, pos long, base string")
    contigs = spark.createDataFrame([("c1", 0, 90)], "contig string, contig_ord int, length long")
    df = spark.createDataFrame(random_pileup(rng, 2, ("c1",), 90, 0.1), PILEUP)
    out = diversity(df, reference, contigs, exons, maf=0.0, rolling_window=90, fst=True)
    stats = {r["sample_id"]: r for r in transcript_statistics(df, exons, reference).collect()}
    for r in out.coding_windows.collect():
        if r["start"] == 0:
            s = stats[r["sample_id"]]
            assert r["coding_bases"] == 60
            for k in ("piN", "piS", "N_sites", "S_sites"):
                assert r[k] == pytest.approx(s[k], abs=1e-9)
    assert "all" in {r["kind"] for r in out.fst.collect()}
    assert out.windows.filter("start = 0").count() == 2
    constant, variable = coding_site_values(df, gene_exons(exons), reference)
    assert constant.count() + variable.select("pos").distinct().count() == 60


def random_intervals(rng, n, top):
    out = []
    for i in range(n):
        size = int(2 ** rng.uniform(0, top))
        start = rng.randrange(0, 2**top)
        out.append((rng.choice(("c1", "c2")), f"i{i}", start, start + size))
    return [*out, ("c1", "empty", 5, 5)]


def test_points_and_intervals_meet_as_in_brute_force(spark):
    rng = random.Random(4)
    for top in (6, 20, 36):
        a, b = random_intervals(rng, 60, top), random_intervals(rng, 60, top)
        points = [(c, p) for c, _, s, e in a + b for p in (s, e - 1, e, (s + e) // 2)] + [("c3", 1)]
        left, right = (spark.createDataFrame(x, "contig string, id string, start long, end long") for x in (a, b))
        got = sorted((r["contig"], r["pos"], r["id"]) for r in points_in(spark.createDataFrame(points, "contig string, pos long"), left).collect())
        assert got == sorted((c, p, i) for c, p in points for d, i, s, e in a if c == d and s <= p < e)
        got = sorted((r["id"], r["other_id"]) for r in overlapping(left, right).collect())
        assert got == sorted((i, j) for c, i, s, e in a for d, j, t, f in b if c == d and s < e and t < f and s < f and t < e)


def test_sweep_finds_where_frames_overlap(spark):
    rng = random.Random(5)
    exons = []
    for i in range(30):
        start = rng.randrange(0, 300)
        exons.append((rng.choice(("c1", "c2")), f"t{i}", "g", rng.choice("+-"), i, start, start + rng.randrange(1, 60)))
    exons.append(("c3", "long", "g", "+", 90, 0, 2_000_000))
    exons.append(("c3", "in", "g", "-", 91, 1_999_990, 2_000_020))
    frames = defaultdict(set)
    for c, _, _, strand, _, s, e in exons[:30]:
        for p in range(s, e):
            frames[c, p].add(e % 3 + 3 if strand == "-" else s % 3)
    rows = overlap_intervals(spark.createDataFrame(exons, EXONS)).collect()
    assert sorted((r["contig"], p) for r in rows if r["contig"] != "c3" for p in range(r["start"], r["end"])) == sorted(k for k, f in frames.items() if len(f) > 1)
    assert [(r["start"], r["end"]) for r in rows if r["contig"] == "c3"] == [(1_999_990, 2_000_000)]
    variants = [("c1", p) for p in range(0, 360, 7)]
    got = sorted((r["transcript_id"], r["pos"], r["cds_idx"]) for r in variants_in_exons(spark.createDataFrame(variants, "contig string, pos long"), spark.createDataFrame(exons, EXONS)).collect())
    assert got == sorted((t, p, e - 1 - p if strand == "-" else p - s) for c, t, _, strand, _, s, e in exons for d, p in variants if c == d and s <= p < e)
    pairs = {(r["transcript_id"], r["other_transcript_id"]) for r in overlapping_transcripts(spark.createDataFrame(exons, EXONS)).collect()}
    assert pairs == {tuple(sorted((x[1], y[1]))) for x in exons for y in exons if x[1] != y[1] and x[0] == y[0] and x[5] < y[6] and y[5] < x[6]}


def test_consensus_is_spliced_at_the_edges_of_blocks(spark, tmp_path):
    rng = random.Random(6)
    genome = {c: "".join(rng.choice("ACGTN") for _ in range(n)) for c, n in (("c1", 53), ("c2", 16), ("c3", 5))}
    reference = spark.createDataFrame([(c, i, b) for c, s in genome.items() for i, b in enumerate(s)], "contig string, pos long, base string")
    rows = [("x", "c1", p, 0, 0, 0, 9) for p in (0, 15, 16, 17, 31, 32, 52)] + [("y", "c2", 3, 1, 0, 0, 0), ("y", "c1", 5, 0, 0, 0, 0)]
    df = spark.createDataFrame(rows, PILEUP)
    want = {(s, c): list(g) for s in "xy" for c, g in genome.items()}
    for s, c, p, *n in rows:
        if sum(n):
            want[s, c][p] = "ACGT"[n.index(max(n))]
    want = {k: "".join(v) for k, v in want.items()}
    assert {(r["sample_id"], r["contig"]): r["seq"] for r in consensus_sequences(df, reference).collect()} == want
    for r in consensus_blocks(df, reference, 16).collect():
        at = r["block"] * 16
        assert r["seq"] == want[r["sample_id"], r["contig"]][at : at + 16] != genome[r["contig"]][at : at + 16]
    contigs = spark.createDataFrame([("c1", 1, 53), ("c2", 0, 16), ("c3", 2, 5)], "contig string, contig_ord int, length long")
    write_consensus(df, reference, contigs, str(tmp_path / "fa"))
    text = "".join(open(f).read() for f in sorted(glob.glob(str(tmp_path / "fa" / "sample_id=x" / "part-*"))))
    assert text == "".join(f">{c}\n{want['x', c]}\n" for c in ("c2", "c1", "c3"))
    long = spark.createDataFrame([("c", b, "ACGTA" * (BLOCK // 5)) for b in (0, 1)], "contig string, block long, seq string")
    out = {r["block"]: r["seq"] for r in consensus_blocks(spark.createDataFrame([("x", "c", BLOCK + 1, 0, 0, 7, 0)], PILEUP), long).collect()}
    assert list(out) == [1] and out[1] == "AG" + ("ACGTA" * (BLOCK // 5))[2:]


def test_ancestors_by_pointer_doubling(spark):
    links = [(f"n{i}", f"n{i + 1}") for i in range(11)] + [("a", "b"), ("a", "c"), ("b", "d"), ("c", "e"), ("c", "d")]
    got = {(r["child"], r["top"]): r["steps"] for r in top_ancestors(spark.createDataFrame(links, "child string, parent string")).collect()}
    assert got == {**{(f"n{i}", "n11"): 11 - i for i in range(11)}, ("a", "d"): 2, ("a", "e"): 2, ("b", "d"): 1, ("c", "e"): 1, ("c", "d"): 1}
    with pytest.raises(ValueError, match="own ancestors"):
        top_ancestors(spark.createDataFrame([("a", "b"), ("b", "a")], "child string, parent string"))


def test_gff3_of_several_levels_and_parents(spark, tmp_path):
    head = "c1\tx\t{}\t{}\t{}\t.\t{}\t0\t{}"
    lines = ["##gff-version 3", head.format("gene", 1, 90, "+", "ID=gene:1;Name=x"), head.format("mRNA", 1, 90, "+", "ID=t1;Parent=gene:1"), head.format("mRNA", 1, 60, "+", "ID=t%202;Parent=gene:1"),
             head.format("CDS", 1, 30, "+", "ID=cds1;Parent=t1,t%202"), head.format("CDS", 40, 60, "+", "ID=cds1;Parent=t1"), head.format("CDS", 70, 90, "-", "ID=cds3;Parent=gene:1"), head.format("CDS", 5, 7, "-", "Parent=lost")]
    (tmp_path / "a.gff3").write_text("\n".join(lines) + "\n")
    rows = [tuple(r[k] for k in ("transcript_id", "gene_id", "start", "end", "strand")) for r in read_gtf(spark, str(tmp_path / "a.gff3")).orderBy("exon_ord", "transcript_id").collect()]
    assert rows == [("t 2", "gene:1", 0, 30, "+"), ("t1", "gene:1", 0, 30, "+"), ("t1", "gene:1", 39, 60, "+"), ("gene:1", "gene:1", 69, 90, "-"), ("lost", "lost", 4, 7, "-")]


def test_order_of_contigs_over_many_splits(spark, tmp_path):
    names = [f"k{i}" for i in random.Random(7).sample(range(900), 300)]
    (tmp_path / "many.fasta").write_text("preamble\n" + "".join(f">{n} text\n{'ACGT' * (i % 40 + 1)}\n" for i, n in enumerate(names)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        blocks, contigs = read_fasta(spark, str(tmp_path / "many.fasta"))
        assert [r["contig"] for r in contigs.orderBy("contig_ord").collect()] == names
        assert sorted(r["contig_ord"] for r in contigs.collect()) == list(range(300))
        assert blocks.count() == 300
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_records_of_a_vcf_and_its_writer(spark, tmp_path):
    reference = spark.createDataFrame([("c1", i, b) for i, b in enumerate("ACGTN")], "contig string, pos long, base string")
    rows = [("x", "c1", 0, 5, 2, 0, 1), ("y", "c1", 0, 3, 0, 0, 0), ("x", "c1", 3, 0, 0, 0, 4)]
    write_vcf(spark.createDataFrame(rows, PILEUP), reference, ["x", "y"], str(tmp_path / "v"), "gzip")
    back = {tuple(r) for r in read_vcf(spark, str(tmp_path / "v")).collect()}
    assert back == {*rows, ("y", "c1", 3, 0, 0, 0, 0)}
    (tmp_path / "split.vcf").write_text("##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tx\nc1\t1\t.\tA\tC\t.\t.\t.\tRD:AD\t1:2\nc1\t1\t.\tA\tG\t.\t.\t.\tRD:AD\t1:3\nc2\t9\t.\tA\tG\t.\t.\t.\tRD:AD\t1:3\n")
    assert {tuple(r) for r in vcf_record_counts(spark, str(tmp_path / "split.vcf")).collect()} == {("c1", 2), ("c2", 1)}


def test_flags_of_the_command_line(spark, tmp_path):
    (tmp_path / "r.fasta").write_text(">c1\nATGTTTTATGGGTGG\n")
    (tmp_path / "a.gtf").write_text('c1\tx\tCDS\t1\t15\t.\t+\t0\tgene_id "g1"; transcript_id "t1";\n')
    (tmp_path / "v.vcf").write_text("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tx\ty\nc1\t6\t.\tT\tC\t.\t.\t.\tRD:AD\t80:20\t0:50\n")
    args = ["-v", str(tmp_path / "v.vcf"), "-r", str(tmp_path / "r.fasta"), "-g", str(tmp_path / "a.gtf"), "-o", str(tmp_path / "run"), "--rolling_window", "6", "--window_step", "3", "--fst"]
    assert cli.main(args) == 0
    windows = spark.read.csv(str(tmp_path / "run_windows"), header=True)
    assert {(r["sample_id"], r["start"]) for r in windows.collect()} == {(s, k) for s in "xy" for k in ("0", "3")}
    assert spark.read.csv(str(tmp_path / "run_coding_windows"), header=True).count() == 10
    assert {r["kind"] for r in spark.read.csv(str(tmp_path / "run_fst"), header=True).collect()} == {"all", "N", "S"}


def test_tables_are_removed(spark):
    df, path = written(spark.range(3), "some")
    assert df.count() == 3 and path in leftover()
    removed(spark, path)
    assert path not in leftover()


def block_gzip(data, size):
    """A file of members of size bytes of text, and the empty member that ends one."""
    out = b""
    for part in [data[i : i + size] for i in range(0, len(data), size)] + [b""]:
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        packed = c.compress(part) + c.flush()
        out += b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(packed) + 25) + packed + struct.pack("<II", zlib.crc32(part), len(part))
    return out


@pytest.mark.parametrize(("member", "split", "n"), [(700, "4k", 1200), (37, "1k", 150), (5, "64", 12)])
def test_block_gzip_is_read_in_parallel_and_pruned(spark, tmp_path, member, split, n):
    rng = random.Random(member)
    head = "##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tx\ty\n"
    lines = [f"c{1 + i * 3 // n}\t{i + 1}\t.\t{rng.choice('ACGT')}\tA,T\t.\t.\t.\tRD:AD\t{rng.randrange(50)}:{rng.randrange(9)},2\t1:{rng.randrange(99)},.\n" for i in range(n)]
    text = (head + "".join(lines)).encode()
    (tmp_path / "p.vcf").write_bytes(text)
    (tmp_path / "p.vcf.gz").write_bytes(block_gzip(text, member))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        path = str(tmp_path / "p.vcf.gz")
        assert is_block_gzip(spark, path) and not is_block_gzip(spark, str(tmp_path / "p.vcf")) and not is_block_gzip(spark, str(tmp_path))
        assert sorted(r["value"] for r in read_lines(spark, path).collect()) == sorted(text.decode().splitlines())
        assert read_lines(spark, path).rdd.getNumPartitions() > 1
        want = {tuple(r) for r in read_vcf(spark, str(tmp_path / "p.vcf")).collect()}
        assert {tuple(r) for r in read_vcf(spark, path).collect()} == want
        region = ("c2", n * 2 // 5, n * 2 // 5 + 9)
        index, _ = written(index_members(spark, path), "index")
        keys = members_of(index, region)
        assert {tuple(r) for r in read_vcf(spark, path, region=region, index=index).collect()} == {r for r in want if r[1] == "c2" and region[1] <= r[2] < region[2]}
        if member == 700:
            assert len(keys) < 0.5 * (len(text) / member)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_store_reads_a_source_once_and_prunes(spark, tmp_path, monkeypatch):
    def vcf(name, sample, lines):
        (tmp_path / name).write_text(f"#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t{sample}\n" + "".join(f"{c}\t{p}\t.\tA\tC\t.\t.\t.\tRD:AD\t{v}\n" for c, p, v in lines))
        return str(tmp_path / name)

    one, two = vcf("1.vcf", "x", [("c1", p, f"{p}:1") for p in range(1, 40)] + [("c2", 5, "7:7")]), vcf("2.vcf", "y", [("c1", 3, "2:2")])
    store = PileupStore(spark, str(tmp_path / "store"))
    with pytest.raises(ValueError, match="no source"):
        store.read()
    assert store.add(one) and not store.add(one) and store.add(two)
    assert {tuple(r) for r in store.read().collect()} == {tuple(r) for f in (one, two) for r in read_vcf(spark, f).collect()}
    assert [tuple(r) for r in store.read([two]).collect()] == [("y", "c1", 2, 2, 2, 0, 0)]
    region = store.read(region=("c1", 10, 12))
    assert sorted(r["pos"] for r in region.collect()) == [10, 11]
    plan = region._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [isnotnull(bucket" in plan and "GreaterThanOrEqual(pos,10)" in plan
    again = vcf("3.vcf", "x", [("c1", 3, "1:0"), ("c1", 90, "1:1")])  # the same sample in another file
    store.add(again)
    assert {(r["pos"], r["a"]) for r in store.read(region=("c1", 2, 3)).collect() if r["sample_id"] == "x"} == {(2, 4)}
    parts = {e["part"] for e in store.entries()}
    vcf("2.vcf", "y", [("c1", 3, "2:2"), ("c1", 4, "9:9")])
    assert store.add(two) and len({e["part"] for e in store.entries()} & parts) == 2
    assert len(glob.glob(str(tmp_path / "store" / "counts" / "part=*"))) == 3 and len(glob.glob(str(tmp_path / "store" / "manifest" / "*"))) == 1
    (tmp_path / "r.fasta").write_text(">c1\n" + "A" * 100 + "\n>c2\nAAAAAAA\n")
    first = analyse_files(spark, [one, two], str(tmp_path / "r.fasta"), maf=0.0, cache_folder=str(tmp_path / "store")).samples.collect()
    monkeypatch.setattr("varidia.sources.store.read_vcf", None)
    assert sorted(analyse_files(spark, [one, two], str(tmp_path / "r.fasta"), maf=0.0, cache_folder=str(tmp_path / "store")).samples.collect()) == sorted(first)
    monkeypatch.undo()
    plain = analyse_files(spark, [one, two], str(tmp_path / "r.fasta"), maf=0.0).samples.collect()
    assert {(r["sample_id"], round(r["pi"], 12)) for r in plain} == {(r["sample_id"], round(r["pi"], 12)) for r in first}


def test_rates_through_spark(spark, tmp_path):
    (tmp_path / "r.csv").write_text("0,1,2,1\n1,0,1,2\n2,1,0,1\n1,2,1,0\n")
    (tmp_path / "r.json").write_text("[[0,1,2,1],[1,0,1,2],[2,1,0,1],[1,2,1,0]]")
    assert read_rates(str(tmp_path / "r.csv"), spark) == read_rates(str(tmp_path / "r.json"), spark) == read_rates(str(tmp_path / "r.csv"))
    with pytest.raises(NotImplementedError):
        read_rates("x.doc", spark)
