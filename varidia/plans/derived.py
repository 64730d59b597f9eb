"""Genome, reads and annotation derived from the part and lineitem tables (FIXTURES.md, section 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.counts import BASES
from ..operators.pileup import minor_allele_filter, pile_up

MAF = 0.1
#: suffix, gene, strand, start, end, exon_ord; the same on every contig
EXONS = [("_A1", "_A", "+", 6, 36, 0), ("_A1", "_A", "+", 45, 60, 1), ("_A2", "_A", "+", 6, 36, 2), ("_B1", "_B", "-", 50, 80, 3), ("_C1", "_C", "+", 82, 92, 4)]


def _genome(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey").cast("long")
    third = lambda n: F.floor(k / n).cast("long")
    base = F.element_at(F.array(*map(F.lit, BASES)), ((k * 7 + third(4)) % 4 + 1).cast("int"))
    return spark.read.parquet(f"{sf}/part.parquet").select(
        k.alias("gpos"), F.concat(F.lit("ctg"), third(100).cast("string")).alias("contig"), (k % 100).alias("pos"), base.alias("base"), ((k * 13 + third(3)) % 3 == 0).alias("is_var")
    )


def reference(spark: SparkSession, sf: str) -> DataFrame:
    return _genome(spark, sf).select("contig", "pos", "base")


def contigs(spark: SparkSession, sf: str) -> DataFrame:
    return reference(spark, sf).groupBy("contig").agg(F.count("*").alias("length")).withColumn("contig_ord", F.substring("contig", 4, 20).cast("int"))


def exons(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.explode(F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("t", "g", "strand", "start", "end", "exon_ord"), e, strict=True))) for e in EXONS))).alias("e")
    df = contigs(spark, sf).select("contig", kind)
    return df.select("contig", F.concat("contig", "e.t").alias("transcript_id"), F.concat("contig", "e.g").alias("gene_id"), "e.strand", F.col("e.exon_ord").cast("int").alias("exon_ord"), F.col("e.start").cast("long").alias("start"), F.col("e.end").cast("long").alias("end"))


def pileup(spark: SparkSession, sf: str) -> DataFrame:
    """Unfiltered counts; returned lines read another base."""
    ref = _genome(spark, sf).filter("is_var")
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_quantity")
    own = F.array_position(F.array(*map(F.lit, BASES)), F.col("base")) - 1
    other = F.element_at(F.array(*map(F.lit, BASES)), ((own + 1 + F.col("l_linenumber") % 3) % 4 + 1).cast("int"))
    return pile_up(lines.join(ref, F.col("l_partkey") == F.col("gpos")).select(
        F.concat(F.lit("s"), (F.col("l_suppkey") % 5).cast("string")).alias("sample_id"), "contig", "pos",
        F.when(F.col("l_returnflag") == "R", other).otherwise(F.col("base")).alias("base"), F.col("l_quantity").cast("long").alias("n"),
    ))


def filtered(spark: SparkSession, sf: str) -> DataFrame:
    return minor_allele_filter(pileup(spark, sf), MAF)
