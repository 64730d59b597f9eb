"""Synonymous and nonsynonymous sites and diversities of transcripts.

Codons of the reference give each transcript's sites once, without samples. Only codons that hold a variant site
are then made for each sample, with its consensus bases and frequencies; the difference is added. So the work
grows with samples times variable codons, not with samples times coding length.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codons import Rates, codon_rows
from ..functions.counts import BASES, COUNTS, PAIRS, complement, consensus, frequency, pairs_of_reads, products, site_pi
from .cds import TRANSCRIPT, cds_positions, overlapping_positions, transcripts
from .pileup import attach_base

CODON = [*TRANSCRIPT, "codon_idx"]
STATS = ["pi", "piN", "piS", "N_sites", "S_sites"]
NO_OVERLAP = [f"{s}_no_overlap" for s in STATS]


def _codon(of: Column) -> Column:
    """The codon of grouped rows by codon_pos; N if a base is unknown."""
    return F.concat(*(F.max(F.when(F.col("codon_pos") == i, of)) for i in range(3)))


def coding_bases(exons: DataFrame, reference: DataFrame) -> DataFrame:
    """cds_positions of transcripts of whole codons with codon_idx, codon_pos and the strand's reference base."""
    whole = transcripts(exons).filter(F.col("transcript_len") % 3 == 0).select(*TRANSCRIPT)
    df = attach_base(cds_positions(exons).join(whole, TRANSCRIPT, "left_semi"), reference)
    base = F.when(F.col("base").isin(*BASES), F.col("base")).otherwise("N")
    return df.select(*TRANSCRIPT, "strand", "pos", F.floor(F.col("cds_idx") / 3).cast("long").alias("codon_idx"), (F.col("cds_idx") % 3).cast("int").alias("codon_pos"), base.alias("ref"))


def _marked_codons(pileup: DataFrame, exons: DataFrame, reference: DataFrame, table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Coding bases with is_var and in_overlap, and the codons of the reference with affected: whether one of their bases is a variant site."""
    bases = coding_bases(exons, reference)
    variable = pileup.select("contig", "pos").distinct().withColumn("is_var", F.lit(True))
    overlaps = overlapping_positions(exons).withColumn("in_overlap", F.lit(True))
    strand_ref = F.when(F.col("strand") == "-", complement(F.col("ref"))).otherwise(F.col("ref"))
    marked = bases.join(variable, ["contig", "pos"], "left").join(overlaps, ["contig", "pos"], "left")
    marked = marked.withColumns({"is_var": F.coalesce("is_var", F.lit(False)), "in_overlap": F.coalesce("in_overlap", F.lit(False))})
    return marked, marked.groupBy(*CODON).agg(_codon(strand_ref).alias("codon"), F.max("is_var").alias("affected")).join(table.select("codon", "s_all", "n_all"), "codon", "left")


def _sample_codons(marked: DataFrame, codons: DataFrame, pileup: DataFrame, samples: DataFrame, table: DataFrame) -> DataFrame:
    """Affected codons of each sample with the table's arrays, and of its bases, as x0 to x2, frequencies, shares of pairs and flags."""
    zero = F.lit(0.0)
    hit = marked.join(codons.filter("affected").select(*CODON), CODON, "left_semi").crossJoin(samples)
    reads = hit.join(pileup, ["sample_id", "contig", "pos"], "left").fillna(0, list(COUNTS))
    minus = F.col("strand") == "-"
    forward = [frequency(b, F.col("ref")) for b in BASES]
    pair_share = {p: F.coalesce(c.cast("double") / pairs_of_reads(), zero) for p, c in products().items()}
    other = {p: "".join(sorted(p.translate(str.maketrans("acgt", "tgca")))) for p in PAIRS}
    site = F.struct(
        F.when(minus, F.array(*forward[::-1])).otherwise(F.array(*forward)).alias("f"),
        F.when(minus, F.array(*(pair_share[other[p]] for p in PAIRS))).otherwise(F.array(*(pair_share[p] for p in PAIRS))).alias("p"),
        site_pi().alias("pi"), "is_var", (F.col("in_overlap") & F.col("is_var")).alias("out"), "pos",
    )
    called = consensus(F.col("ref"))
    reads = reads.select("sample_id", *CODON, "codon_pos", F.when(minus, complement(called)).otherwise(called).alias("base"), site.alias("x"))
    three = reads.groupBy("sample_id", *CODON).agg(_codon(F.col("base")).alias("codon"), *(F.max(F.when(F.col("codon_pos") == i, F.col("x"))).alias(f"x{i}") for i in range(3)))
    return three.join(table, "codon", "left")


def _dot(values: str, table_column: str, i: int, n: int) -> Column:
    terms = [F.col(f"x{i}.{values}")[k] * F.coalesce(F.col(table_column)[i * n + k], F.lit(0)) for k in range(n)]
    return reduce(lambda a, b: a + b, terms)


#: of base i of a codon: sites and differences
_PARTS = {"n": lambda i: _dot("f", "n", i, 4), "s": lambda i: _dot("f", "s", i, 4), "pn": lambda i: _dot("p", "non", i, 6), "ps": lambda i: _dot("p", "syn", i, 6), "pi": lambda i: F.col(f"x{i}.pi")}


def coding_site_values(pileup: DataFrame, exons: DataFrame, reference: DataFrame, rates: Rates | None = None, include_stops: bool = False, samples: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Sites and differences of single coding bases: (contig, transcript_id, pos, n_sites, s_sites) of the codons that no variant site
    affects, which all samples share, and (sample_id, contig, transcript_id, pos, n_sites, s_sites, pn, ps) of the others."""
    samples = pileup.select("sample_id").distinct() if samples is None else samples.select("sample_id")
    table = F.broadcast(codon_rows(pileup.sparkSession, rates, include_stops))  # 64 rows
    marked, codons = _marked_codons(pileup, exons, reference, table)
    place = F.col("codon_pos") * len(BASES) + F.array_position(F.array(*map(F.lit, BASES)), F.substr("codon", F.col("codon_pos") + 1, F.lit(1))).cast("int") - 1
    known = codons.filter(~F.col("affected")).select(*CODON, "codon").join(table.select("codon", "n", "s"), "codon")
    constant = marked.select(*CODON, "codon_pos", "pos").join(known, CODON).select(*TRANSCRIPT, "pos", F.col("n")[place].alias("n_sites"), F.col("s")[place].alias("s_sites"))
    three = _sample_codons(marked, codons, pileup, samples, table)
    names = {"n": "n_sites", "s": "s_sites", "pn": "pn", "ps": "ps"}
    each = [F.struct(F.col(f"x{i}.pos").alias("pos"), *(_PARTS[k](i).alias(v) for k, v in names.items())) for i in range(3)]
    return constant, three.select("sample_id", *TRANSCRIPT, F.inline(F.array(*each)))


def gene_exons(exons: DataFrame) -> DataFrame:
    """The exons of each gene's first transcript of whole codons, by start, then place in the file."""
    order = Window.partitionBy("contig", "gene_id").orderBy("first_pos", "file_ord", "transcript_id")
    first = transcripts(exons).filter(F.col("transcript_len") % 3 == 0).withColumn("__n", F.row_number().over(order)).filter("__n = 1")
    return exons.join(first.select(*TRANSCRIPT), TRANSCRIPT, "left_semi")


def transcript_statistics(pileup: DataFrame, exons: DataFrame, reference: DataFrame, rates: Rates | None = None, include_stops: bool = False, samples: DataFrame | None = None) -> DataFrame:
    """A row for each sample and transcript: lengths and the ten statistics (null if the length isn't of whole codons).

    pileup has filtered counts; its sites are the variant sites. samples defaults to those of pileup.
    """
    samples = pileup.select("sample_id").distinct() if samples is None else samples.select("sample_id")
    table = F.broadcast(codon_rows(pileup.sparkSession, rates, include_stops))  # 64 rows
    zero = F.lit(0.0)
    marked, codons = _marked_codons(pileup, exons, reference, table)
    base_sites = codons.groupBy(*TRANSCRIPT).agg(*(F.sum(F.when(~F.col("affected"), F.coalesce(k, zero)).otherwise(zero)).alias(k) for k in ("n_all", "s_all")))
    three = _sample_codons(marked, codons, pileup, samples, table)

    def total(part, only_out: bool = False) -> Column:
        return F.sum(reduce(lambda a, b: a + b, [F.when(F.col(f"x{i}.out"), part(i)).otherwise(zero) if only_out else part(i) for i in range(3)]))

    sums = three.groupBy("sample_id", *TRANSCRIPT).agg(
        *(total(f).alias(f"v_{k}") for k, f in _PARTS.items()), *(total(f, True).alias(f"o_{k}") for k, f in _PARTS.items()),
        total(lambda i: F.lit(1.0), True).cast("long").alias("o_len"),
    )

    out = transcripts(exons).crossJoin(samples).join(base_sites, TRANSCRIPT, "left").join(sums, ["sample_id", *TRANSCRIPT], "left")
    value = lambda k: F.coalesce(F.col(k), zero)
    whole = F.col("transcript_len") % 3 == 0
    size = F.col("transcript_len").cast("double")
    n, s = value("n_all") + value("v_n"), value("s_all") + value("v_s")
    n_no, s_no = n - value("o_n"), s - value("o_s")
    len_no = F.col("transcript_len") - F.coalesce("o_len", F.lit(0))
    ratio = lambda a, b: F.when(F.abs(b) > 1e-12, a / b)
    stats = {
        "pi": value("v_pi") / size, "piN": ratio(value("v_pn"), n), "piS": ratio(value("v_ps"), s), "N_sites": n, "S_sites": s,
        "pi_no_overlap": ratio(value("v_pi") - value("o_pi"), len_no.cast("double")), "piN_no_overlap": ratio(value("v_pn") - value("o_pn"), n_no),
        "piS_no_overlap": ratio(value("v_ps") - value("o_ps"), s_no), "N_sites_no_overlap": n_no, "S_sites_no_overlap": s_no,
    }
    return out.select(
        "sample_id", "contig", "transcript_id", "gene_id", "transcript_len", F.when(whole, len_no).otherwise(F.col("transcript_len")).alias("transcript_len_no_overlap"),
        *(F.when(whole, c).alias(k) for k, c in stats.items()), "first_pos", "file_ord",
    )


def pair_classes(exons: DataFrame, reference: DataFrame) -> DataFrame:
    """(contig, pos, non, syn): for each coding base whether pairs of bases, in the order of PAIRS on the plus strand, change the reference codon's amino acid.

    A base of several transcripts has the classes of the one whose id comes first.
    """
    bases = coding_bases(exons, reference)
    strand_ref = F.when(F.col("strand") == "-", complement(F.col("ref"))).otherwise(F.col("ref"))
    places = [F.struct(F.lit(i).alias("i"), F.max(F.when(F.col("codon_pos") == i, F.col("pos"))).alias("pos")) for i in range(3)]
    codons = bases.groupBy(*TRANSCRIPT, "strand", "codon_idx").agg(_codon(strand_ref).alias("codon"), F.array(*places).alias("at"))
    table = F.broadcast(codon_rows(exons.sparkSession).select("codon", "syn", "non"))  # 64 rows
    rows = codons.join(table, "codon").select("contig", "transcript_id", "strand", "syn", "non", F.inline("at"))
    minus = [PAIRS.index("".join(sorted(p.translate(str.maketrans("acgt", "tgca"))))) for p in PAIRS]

    def of(kind: str) -> Column:
        own = [F.col(kind)[F.col("i") * len(PAIRS) + k] for k in range(len(PAIRS))]
        return F.when(F.col("strand") == "-", F.array(*(own[k] for k in minus))).otherwise(F.array(*own)).alias(kind)

    rows = rows.select("contig", "pos", "transcript_id", F.struct(of("non"), of("syn")).alias("x"))
    return rows.groupBy("contig", "pos").agg(F.min_by("x", "transcript_id").alias("x")).select("contig", "pos", "x.non", "x.syn")


def rejected_transcripts(exons: DataFrame) -> DataFrame:
    """Transcripts whose coding length isn't of whole codons."""
    return transcripts(exons).filter(F.col("transcript_len") % 3 != 0).select("contig", "transcript_id", "transcript_len")
