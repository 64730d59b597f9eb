"""Read counts of samples at variant sites: (sample_id, contig, pos, a, c, g, t), pos from 0."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.counts import BASES, COUNTS, consensus, depth, filter_minor, frequency, products, site_pi

KEY = ["sample_id", "contig", "pos"]
BLOCK = 10_000


def pile_up(reads: DataFrame) -> DataFrame:
    """Counts of rows (sample_id, contig, pos, base, n); other bases and missing counts add nothing."""
    return reads.groupBy(*KEY).agg(*(F.coalesce(F.sum(F.when(F.col("base") == b, F.greatest(F.col("n"), F.lit(0)))), F.lit(0)).cast("long").alias(b.lower()) for b in BASES))


def merge_records(pileup: DataFrame) -> DataFrame:
    """Rows of one sample and site added up."""
    return pileup.groupBy(*KEY).agg(*(F.sum(F.coalesce(n, F.lit(0))).cast("long").alias(n) for n in COUNTS))


def minor_allele_filter(pileup: DataFrame, maf: float = 0.01) -> DataFrame:
    return filter_minor(pileup, maf)


def in_region(df: DataFrame, contig: str, start: int, end: int) -> DataFrame:
    """Rows of a contig with start <= pos < end."""
    return df.filter((F.col("contig") == contig) & (F.col("pos") >= start) & (F.col("pos") < end))


def attach_base(df: DataFrame, reference: DataFrame, how: str = "left") -> DataFrame:
    """df with the reference base at (contig, pos).

    reference is either a row for each base (contig, pos, base) or blocks of BLOCK bases (contig, block, seq).
    """
    if "seq" in reference.columns:
        blocks = reference.select("contig", F.col("block").alias("__b"), "seq")
        joined = df.withColumn("__b", F.floor(F.col("pos") / BLOCK).cast("long")).join(blocks, ["contig", "__b"], how)
        return joined.withColumn("base", F.substr("seq", (F.col("pos") % BLOCK + 1).cast("int"), F.lit(1))).drop("__b", "seq")
    return df.join(reference.select("contig", "pos", "base"), ["contig", "pos"], how)


def frequencies(pileup: DataFrame, reference: DataFrame) -> DataFrame:
    """Depth and base frequencies; where there are no reads, the reference base has frequency 1."""
    df = attach_base(pileup, reference)
    return df.select(*KEY, depth().alias("depth"), *(frequency(b, F.col("base")).alias(f"f{b.lower()}") for b in BASES))


def consensus_bases(pileup: DataFrame, reference: DataFrame) -> DataFrame:
    df = attach_base(pileup, reference)
    return df.select(*KEY, consensus(F.col("base")).alias("base"))


def reference_blocks(reference: DataFrame, size: int = BLOCK) -> DataFrame:
    """(contig, block, seq), size bases each but the last, from rows of bases; blocks of BLOCK bases stay as they are."""
    if "seq" in reference.columns:
        if size != BLOCK:
            raise ValueError(f"these blocks have {BLOCK} bases")
        return reference.select("contig", "block", "seq")
    seq = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "base"))), lambda x: x["base"]), "")
    return reference.groupBy("contig", F.floor(F.col("pos") / size).cast("long").alias("block")).agg(seq.alias("seq"))


def consensus_blocks(pileup: DataFrame, reference: DataFrame, size: int = BLOCK) -> DataFrame:
    """(sample_id, contig, block, seq) where a sample's consensus differs from the reference; its other blocks are the reference's.

    A block's differences, in order, are spliced between slices of the reference. No row is longer than a block.
    """
    called = attach_base(pileup, reference, "inner").select(*KEY, "base", consensus(F.col("base")).alias("own")).filter("own <> base")
    edit = F.struct((F.col("pos") % size).cast("int").alias("at"), "own")
    edits = called.groupBy("sample_id", "contig", F.floor(F.col("pos") / size).cast("long").alias("block")).agg(F.sort_array(F.collect_list(edit)).alias("e"))
    rows = edits.join(reference_blocks(reference, size), ["contig", "block"])
    before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get("e", i - 1)["at"] + 1)
    spliced = F.transform("e", lambda x, i: F.concat(F.substr("seq", before(i) + 1, x["at"] - before(i)), x["own"]))
    rest = F.substr("seq", F.element_at("e", -1)["at"] + 2, F.length("seq"))
    return rows.select("sample_id", "contig", "block", F.concat(F.array_join(spliced, ""), rest).alias("seq"))


def consensus_lines(pileup: DataFrame, reference: DataFrame) -> DataFrame:
    """(sample_id, contig, block, seq): all blocks of all samples, each no longer than BLOCK; for exports."""
    blocks = reference_blocks(reference)
    every = pileup.select("sample_id").distinct().crossJoin(blocks.withColumnRenamed("seq", "__ref"))
    out = every.join(consensus_blocks(pileup, reference), ["sample_id", "contig", "block"], "left")
    return out.select("sample_id", "contig", "block", F.coalesce("seq", "__ref").alias("seq"))


def consensus_sequences(pileup: DataFrame, reference: DataFrame) -> DataFrame:
    """The whole sequence of each sample and contig, for exports: a string of the contig's length in one row, joined from blocks."""
    seq = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "seq"))), lambda x: x["seq"]), "")
    return consensus_lines(pileup, reference).groupBy("sample_id", "contig").agg(seq.alias("seq"))


def pi_math(pileup: DataFrame) -> DataFrame:
    return pileup.select(*KEY, depth().alias("depth"), *(c.alias(p) for p, c in products().items()))


def site_diversity(pileup: DataFrame) -> DataFrame:
    """(sample_id, contig, pos, pi)."""
    return pileup.select(*KEY, site_pi().alias("pi"))


def record_counts(pileup: DataFrame) -> DataFrame:
    """Variant sites of each contig."""
    return pileup.select("contig", "pos").distinct().groupBy("contig").agg(F.count("*").alias("n_records"))


def pooled_pairs(pileup: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(sample_1, sample_2, contig, pos, a, c, g, t): counts of two samples added; a sample without reads at a site adds none.

    pairs (sample_1, sample_2) defaults to all ordered pairs, a sample with itself included. Rows are repeated for
    each pair of a sample before one sum, so no site is joined with itself.
    """
    if pairs is None:
        one = pileup.select(F.col("sample_id").alias("sample_1")).distinct()
        pairs = one.crossJoin(one.withColumnRenamed("sample_1", "sample_2"))
    sides = pairs.select("sample_1", "sample_2", F.explode(F.array("sample_1", "sample_2")).alias("sample_id"))
    both = pileup.join(sides, "sample_id")
    return both.groupBy("sample_1", "sample_2", "contig", "pos").agg(*(F.sum(n).cast("long").alias(n) for n in COUNTS))

