"""Mixing sources to target weights, with DataFrame functions only.

A text's size is its number of runs of bytes other than the space and the control characters 9 to 13. Sources
in code point order, null last, take the weights in turn. They share ``total`` times all sizes by weight; no
source gets more than ``most`` times its own size, and what is over goes to the others by weight until none is
above. A source's rate is its target over its size; each of its documents is emitted floor(rate) times, and
once more if a number in [0, 1) drawn from md5 of the seed, doc_id and text's md5 is below the rate's
fraction. So reruns agree and, as rates are at most ``most``, no document exceeds that many times its size.

Null text has size 0; a null doc_id draws as the empty text. Sources of size 0 have target 0 and rate 0. Rows
that repeat are separate documents with the same draw. An empty table gives an empty result. In the plan, columns named like
the outputs are replaced; the mix has the documents' own columns, whatever their names. Very long texts are read once to be
counted and once to be drawn for. Sizes are summed per source before the shuffle, so a hot source costs no more; the
sums (a row for each source) are joined by broadcast only if there are ``small`` of them at most, and else by a
sort-merge join whose skew adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import removed, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SMALL = 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _draw(seed: str) -> Column:
    """A number in [0, 1) from the first 32 bits of an md5."""
    key = F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit(""))))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / 2.0**32


def ranked(sources: DataFrame) -> DataFrame:
    """sources (one row each) with ``place``, from 0 in code point order, null last; no window over all rows.

    Rows are dealt by range, numbered inside each partition, and moved on by the counts of the partitions before.
    """
    dealt = sources.withColumn("__null", F.col("source").isNull().cast("int"))
    dealt = dealt.repartitionByRange("__null", "source").withColumn("__p", F.spark_partition_id())
    inside = dealt.withColumn("__n", F.row_number().over(Window.partitionBy("__p").orderBy("__null", "source")))
    before = dealt.groupBy("__p").agg(F.count("*").alias("__c"))
    before = before.withColumn("__before", F.sum("__c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)))  # a row for each partition
    out = inside.join(before.select("__p", "__before"), "__p")
    return out.withColumn("place", (F.col("__n") - 1 + F.coalesce("__before", F.lit(0))).cast("long")).drop("__null", "__p", "__n", "__before")


def source_targets(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, total: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, weight, target; a row for each source, written to the shared folder.

    Each round gives all that is left to the sources below their limits by weight; those that reach it are
    set. The rounds end when none reaches it, with one small sum each.
    """
    sizes = docs.groupBy("source").agg(F.sum(word_count(F.col("text"))).alias("source_size"))
    sizes, path = written(sizes, "sizes")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    table = written(ranked(sizes).select("source", "source_size", weight.alias("weight"), (F.col("source_size") * float(most)).alias("limit")), "targets")[0]
    removed(docs.sparkSession, path)
    budget = table.agg(F.sum("source_size")).first()[0] or 0
    budget = min(total, most) * budget
    share = 0.0
    while True:
        full = F.col("limit") <= F.col("weight") * share
        row = table.agg(F.sum(F.when(full, F.col("limit")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        set_aside, open_weight = row[0] or 0.0, row[1] or 0.0
        nxt = (budget - set_aside) / open_weight if open_weight > 0 else share
        if nxt <= share:
            break
        share = nxt
    return table.select("source", "source_size", "weight", F.least(F.col("limit"), F.col("weight") * F.lit(float(share))).alias("target"))


PLAN = ("size", "source_size", "target", "rate", "copies")


def _planned(docs: DataFrame, weights: tuple[float, ...], total: float, most: float, seed: str, small: int) -> DataFrame:
    """Each row of docs as the struct ``row``, beside the columns of PLAN; so names can't clash."""
    sized = docs.select(F.col("source").alias("source"), F.col("text").alias("text"))
    targets = source_targets(sized, weights, total, most).select(F.col("source").alias("of"), "source_size", "target")
    if targets.count() <= small:
        targets = F.broadcast(targets)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", "text", "source")
    rows = rows.join(targets, F.col("source").eqNullSafe(F.col("of")), "left")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("size", word_count(F.col("text"))).withColumn("rate", rate)
    copies = (F.floor("rate") + (_draw(seed) < F.col("rate") - F.floor("rate")).cast("int")).cast("int")
    return rows.select("row", "size", "source_size", "target", "rate", copies.alias("copies"))


def mix_plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, total: float = 1.5, most: float = 2.0, seed: str = "mix", small: int = SMALL) -> DataFrame:
    """docs with size, source_size, target, rate and copies."""
    own = [F.col(f"row.`{c}`") for c in docs.columns if c.lower() not in PLAN]
    return _planned(docs, weights, total, most, seed, small).select(*own, *PLAN)


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, total: float = 1.5, most: float = 2.0, seed: str = "mix", small: int = SMALL) -> DataFrame:
    """The documents of the mix: rows of docs with their own columns, each as often as its plan says."""
    plan = _planned(docs, weights, total, most, seed, small).filter("copies > 0")
    return plan.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix_plan(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


#: The limits are found by sorting instead of by rounds: sources fill up in the order of limit over weight.
OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT source, source_size, 2.0e0 * source_size AS lim,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5e0 WHEN 1 THEN 2e0 ELSE 1e0 END AS weight,
         1.5e0 * (SELECT sum(source_size) FROM s) AS budget
  FROM s
), p AS (
  SELECT *, row_number() OVER (ORDER BY lim / weight, source NULLS LAST) AS k FROM w
), o AS (
  SELECT *, coalesce(sum(lim) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS lim_before,
         sum(weight) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING) AS weight_left
  FROM p
), share AS (
  SELECT min_by((budget - lim_before) / weight_left, k) AS lam FROM o WHERE (budget - lim_before) / weight_left <= lim / weight
), g AS (
  SELECT source, source_size, least(lim, weight * coalesce(lam, lim / weight)) AS target FROM p LEFT JOIN share ON true
), r AS (
  SELECT d.*, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0e0 END AS rate
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN
  CAST(CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(t)), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296e0 < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""
