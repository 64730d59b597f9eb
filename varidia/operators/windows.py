"""Overlapping windows along contigs: [k * step, k * step + width) for k = 0, 1, ...

A value enters the running sum at the first window that holds its position and leaves it after the last one, so each value makes two
rows whatever the number of windows that hold it. Rows are summed by window, and running sums are taken within blocks of windows, which
start with the sums of the blocks before them: no contig is one task. Values are summed as decimals, so what leaves cancels exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .intervals import running_sums

BLOCK = 4096
EXACT = "decimal(38,18)"


def sliding_sums(values: DataFrame, by: list[str], columns: list[str], width: int, step: int, block: int = BLOCK) -> DataFrame:
    """(by, k, columns, n): sums of columns over the windows of rows (by, pos, columns), and the rows in each; windows without rows are left out."""
    if width < 1 or step < 1:
        raise ValueError("width and step of windows are positive")
    first = F.greatest(F.floor((F.col("pos") - width) / step) + 1, F.lit(0)).cast("long")
    after = (F.floor(F.col("pos") / step) + 1).cast("long")
    exact = [F.coalesce(F.col(c), F.lit(0)).cast(EXACT).alias(c) for c in columns]
    rows = values.select(*by, first.alias("first"), after.alias("after"), *exact).filter("first < after")

    def edge(at: str, sign: int):
        return F.struct(F.col(at).alias("k"), *((F.col(c) * sign).cast(EXACT).alias(c) for c in columns), F.lit(sign).cast("long").alias("n"))

    edges = rows.select(*by, F.inline(F.array(edge("first", 1), edge("after", -1))))
    every = [*columns, "n"]
    edges = edges.groupBy(*by, "k").agg(*(F.sum(c).cast("long" if c == "n" else EXACT).alias(c) for c in every))
    runs = running_sums(edges, by, "k", every, block)
    runs = runs.filter("n > 0")
    out = runs.withColumn("k", F.explode(F.sequence("k", F.col("__end") - 1)))
    return out.select(*by, "k", *(F.col(c).cast("double").alias(c) for c in columns), F.col("n").cast("long").alias("n"))


def _placed(df: DataFrame, contigs: DataFrame, width: int, step: int) -> DataFrame:
    df = df.join(contigs.select("contig", "length"), "contig").withColumn("start", F.col("k") * step)
    return df.withColumn("window_length", F.least(F.lit(width).cast("long"), F.col("length") - F.col("start")))


def sliding_pi(sites: DataFrame, contigs: DataFrame, width: int, step: int, block: int = BLOCK) -> DataFrame:
    """(sample_id, contig, start, window_length, n_sites, pi): site diversities over each window's length; windows at a contig's end are shorter."""
    sums = sliding_sums(sites, ["sample_id", "contig"], ["pi"], width, step, block).withColumnRenamed("pi", "__pi")
    out = _placed(sums, contigs, width, step)
    return out.select("sample_id", "contig", "start", "window_length", F.col("n").alias("n_sites"), (F.col("__pi") / F.col("window_length")).alias("pi"))


def sliding_coding(constant: DataFrame, variable: DataFrame, samples: DataFrame, contigs: DataFrame, width: int, step: int, block: int = BLOCK) -> DataFrame:
    """(sample_id, contig, start, window_length, coding_bases, piN, piS, N_sites, S_sites): diversities over the sites of the window's coding bases.

    constant and variable are those of coding_site_values: bases that are the same in all samples are summed without samples.
    """
    same = sliding_sums(constant, ["contig"], ["n_sites", "s_sites"], width, step, block)
    own = sliding_sums(variable, ["sample_id", "contig"], ["n_sites", "s_sites", "pn", "ps"], width, step, block)
    same = same.select("contig", "k", F.col("n_sites").alias("n0"), F.col("s_sites").alias("s0"), F.col("n").alias("bases0")).crossJoin(samples.select("sample_id"))
    both = _placed(own.join(same, ["sample_id", "contig", "k"], "full_outer").fillna(0), contigs, width, step)
    n, s = F.col("n_sites") + F.col("n0"), F.col("s_sites") + F.col("s0")
    ratio = lambda a, b: F.when(b > 1e-12, F.col(a) / b)
    return both.select("sample_id", "contig", "start", "window_length", (F.col("n") + F.col("bases0")).alias("coding_bases"), ratio("pn", n).alias("piN"), ratio("ps", s).alias("piS"), n.alias("N_sites"), s.alias("S_sites"))
