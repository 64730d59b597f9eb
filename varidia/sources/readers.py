"""FASTA, GTF, VCF, mutation rates and pool tables as canonical DataFrames. Plain or gzip text, by Spark's codecs."""

from __future__ import annotations

import io
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.codons import Rates
from ..functions.counts import BASES
from ..operators.pileup import BLOCK, KEY
from .blockgzip import is_block_gzip, members_of, read_lines
from .shared import removed, written

FILES = 10_000
MAX_DOUBLINGS = 12


def _ordered(df: DataFrame, *more: Column) -> DataFrame:
    """Rows with ``ord``, which follows the order of the file."""
    return df.select("value", *more, F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("ord"))


def in_order(rows: DataFrame, name: str) -> DataFrame:
    """Rows with ``name``, their rank by (file, ord) from 0: their place within a split after the rows of the splits before; only numbers of rows are added up in one task."""
    split = ["file", "__split"]
    rows = rows.withColumn("__split", F.col("ord.block"))
    counts = rows.groupBy(*split).agg(F.count("*").alias("__n"))
    before = counts.select(*split, F.coalesce(F.sum("__n").over(Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    own = rows.withColumn("__own", F.row_number().over(Window.partitionBy(*split).orderBy("ord.row")) - 1)
    return own.join(before, split).withColumn(name, (F.col("__before") + F.col("__own")).cast("int")).drop("__split", "__own", "__before")


def _fasta_blocks(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks of BLOCK bases and contigs from (contig, file, ord, seq)."""
    contigs = in_order(records.select("contig", "file", "ord", F.length("seq").cast("long").alias("length")), "contig_ord").select("contig", "contig_ord", "length")
    n = F.greatest(F.ceil(F.length("seq") / BLOCK), F.lit(1)).cast("int")
    blocks = records.select("contig", "seq", F.explode(F.sequence(F.lit(0), n - 1)).alias("block"))
    return blocks.select("contig", F.col("block").cast("long").alias("block"), F.substr("seq", F.col("block") * BLOCK + 1, F.lit(BLOCK)).alias("seq")), contigs


def read_fasta(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Blocks (contig, block, seq) and contigs (contig, contig_ord, length); a record is one row, read in parallel.

    path may be a folder of files. Text before a file's first record is skipped; spaces inside sequences are dropped; letters become capitals.
    The first record of each file is joined by broadcast where there are FILES files at most.
    """
    file = F.col("_metadata.file_path").alias("file")
    text = spark.read.option("lineSep", "\n>").text(path)
    rows = _ordered(text, file)
    start = rows.select("file", "ord").groupBy("file").agg(F.min("ord").alias("__first"))
    start = F.broadcast(start) if len(text.inputFiles()) <= FILES else start
    rows = rows.join(start, "file").filter((F.col("ord") != F.col("__first")) | F.col("value").startswith(">"))
    value = F.when(F.col("ord") == F.col("__first"), F.substr("value", F.lit(2))).otherwise(F.col("value"))
    rows = rows.select(value.alias("value"), "file", "ord").filter(F.length("value") > 0)
    title = F.regexp_replace(F.substring_index("value", "\n", 1), r"\r", "")
    body = F.when(F.instr("value", "\n") > 0, F.substr("value", F.instr("value", "\n") + 1)).otherwise("")
    return _fasta_blocks(rows.select(F.split(title, " ")[0].alias("contig"), "file", "ord", F.upper(F.regexp_replace(body, r"\s", "")).alias("seq")))


def _attribute(name: str) -> Column:
    return F.nullif(F.regexp_extract("attributes", rf'(?:^|[;\s]){name}[ =]"?([^";]*)"?', 1), F.lit(""))


def _ids(name: str) -> Column:
    """The values of a GFF3 attribute, which commas part; their escapes are decoded."""
    return F.transform(F.filter(F.split(F.coalesce(_attribute(name), F.lit("")), ","), lambda x: x != ""), lambda x: F.url_decode(F.regexp_replace(x, r"\+|%(?![0-9A-Fa-f]{2})", "%2B")))


def top_ancestors(parents: DataFrame) -> DataFrame:
    """(child, top, steps) of all (child, parent): the ancestors without a parent, by pointer doubling, so the rounds are the logarithm of the depth.

    A child of several parents has a row for each top. Rings have none.
    """
    links = parents.select("child", "parent").distinct()
    known = links.withColumn("steps", F.lit(1).cast("long"))
    spark = parents.sparkSession
    path = None
    for _ in range(MAX_DOUBLINGS):
        last = path
        known, path = written(known, "parents")
        if last:
            removed(spark, last)
        up = known.select(F.col("child").alias("parent"), F.col("parent").alias("__next"), F.col("steps").alias("__more"))
        if known.join(up.select("parent"), "parent", "left_semi").isEmpty():
            return known.withColumnRenamed("parent", "top")
        jumped = known.join(up, "parent", "left")
        known = jumped.select("child", F.coalesce("__next", "parent").alias("parent"), (F.col("steps") + F.coalesce("__more", F.lit(0))).alias("steps"))
        known = known.groupBy("child", "parent").agg(F.max("steps").alias("steps"))
    raise ValueError(f"features of the annotation are their own ancestors, or have more than 2**{MAX_DOUBLINGS - 1} of them")


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    """Exons of CDS rows, in file order; comments and blank lines are skipped.

    GTF rows name their transcript_id and gene_id. GFF3 rows name parents: a coding row belongs to each of them, and its gene is the
    top ancestor, so CDS, mRNA and gene may be linked over any number of levels (one of several tops: the first by name).
    """
    rows = _ordered(spark.read.text(path)).withColumn("value", F.translate("value", "/\r", "_"))
    rows = rows.filter(~F.col("value").startswith("#") & (F.trim("value") != "")).withColumn("f", F.split("value", "\t")).withColumn("attributes", F.get("f", F.lit(8)))
    cds = rows.filter(F.lower(F.get("f", F.lit(2))) == "cds")
    own = F.when(_attribute("transcript_id").isNotNull(), F.array(_attribute("transcript_id"))).when(F.size(_ids("Parent")) > 0, _ids("Parent")).otherwise(F.array(F.lit(None).cast("string")))
    out = cds.select(
        F.get("f", F.lit(0)).alias("contig"), F.explode(own).alias("transcript_id"), _attribute("gene_id").alias("__gene"), _attribute("gene").alias("__symbol"), F.get("f", F.lit(6)).alias("strand"),
        (F.col("ord.block") * F.lit(1 << 20) + F.col("ord.row")).alias("exon_ord"), (F.get("f", F.lit(3)).cast("long") - 1).alias("start"), F.get("f", F.lit(4)).cast("long").alias("end"),
    )
    links = rows.filter(F.lower(F.get("f", F.lit(2))) != "cds").select(F.explode(_ids("ID")).alias("child"), _ids("Parent").alias("p")).select("child", F.explode("p").alias("parent"))
    if not links.isEmpty():  # GFF3
        genes = top_ancestors(links).groupBy("child").agg(F.min("top").alias("__top")).withColumnRenamed("child", "transcript_id")
        out = out.join(genes, "transcript_id", "left")
    else:
        out = out.withColumn("__top", F.lit(None).cast("string"))
    return out.select("contig", "transcript_id", F.coalesce("__gene", "__top", "__symbol", "transcript_id").alias("gene_id"), "strand", "exon_ord", "start", "end")


def check_contigs(exons: DataFrame, contigs: DataFrame) -> None:
    unknown = [r[0] for r in exons.select("contig").distinct().join(contigs, "contig", "left_anti").limit(5).collect()]
    if unknown:
        raise ValueError(f"the annotation names contigs that the reference lacks: {', '.join(unknown)}")


def vcf_samples(lines: DataFrame) -> list[str]:
    """Names of samples in header order."""
    head = lines.filter(F.col("value").startswith("#CHROM")).first()
    return head["value"].rstrip("\r").split("\t")[9:] if head else []


def read_vcf(spark: SparkSession, path: str, rd_merge: str = "sum", region: tuple[str, int, int] | None = None, index: DataFrame | None = None) -> DataFrame:
    """A pileup from FORMAT fields RD (reference reads) and AD (reads of each alternate); missing counts are 0.

    Only single-base alleles count. Records of one site are merged: alternates add up, and reference reads add up
    or, with rd_merge="max", the largest counts (for files that repeat RD in split records).

    A block-gzip file is inflated by all tasks; with a region and its index (index_members), only the members that may hold records of it are.
    """
    if rd_merge not in ("sum", "max"):
        raise ValueError(f"rd_merge is sum or max, not {rd_merge}")
    packed = is_block_gzip(spark, path)
    names = vcf_samples(spark.read.text(path))  # stops after the header
    lines = read_lines(spark, path, members_of(index, region) if region and index is not None else None) if packed else spark.read.text(path)
    if region:  # before lines are split
        pos = F.substring_index(F.substring_index("value", "\t", 2), "\t", -1).try_cast("long") - 1
        lines = lines.filter(F.col("value").startswith(f"{region[0]}\t") & (pos >= region[1]) & (pos < region[2]))
    f = F.split(F.rtrim("value"), "\t")
    rows = lines.filter(~F.col("value").startswith("#") & (F.trim("value") != "")).withColumn("f", f)
    rows = rows.withColumns({"contig": F.col("f")[0], "pos": F.col("f")[1].cast("long") - 1, "ref": F.upper(F.col("f")[3]), "alts": F.split(F.upper(F.col("f")[4]), ","), "fmt": F.split(F.col("f")[8], ":")})
    rows = rows.select("contig", "pos", "ref", "alts", "fmt", F.posexplode(F.slice("f", 10, max(len(names), 1))).alias("k", "v"))
    field = lambda n: F.get(F.split("v", ":"), (F.array_position("fmt", n) - 1).cast("int"))
    number = lambda c: F.greatest(F.coalesce(c.try_cast("long"), F.lit(0)), F.lit(0))
    has = lambda n: F.array_position("fmt", n) > 0
    rd = F.when(has("RD"), number(field("RD"))).otherwise(F.lit(0))
    ads = F.when(has("AD"), F.split(field("AD"), ",")).otherwise(F.array())
    rows = rows.select(F.element_at(F.array(*map(F.lit, names or [""])), F.col("k") + 1).alias("sample_id"), "contig", "pos", "ref", rd.alias("rd"), F.arrays_zip(F.col("alts").alias("alt"), ads.alias("ad")).alias("z"))
    alt = lambda b: F.aggregate(F.filter("z", lambda x: x["alt"] == b), F.lit(0).cast("long"), lambda s, x: s + number(x["ad"]))
    merge = F.max if rd_merge == "max" else F.sum
    out = [(F.coalesce(merge(F.when(F.col("ref") == b, F.col("rd"))), F.lit(0)) + F.sum(alt(b))).cast("long").alias(b.lower()) for b in BASES]
    return rows.groupBy(*KEY).agg(*out)


def vcf_record_counts(spark: SparkSession, path: str) -> DataFrame:
    """(contig, n_records): the records of each contig; a site that is split over several records counts for each."""
    lines = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
    return lines.groupBy(F.substring_index("value", "\t", 1).alias("contig")).agg(F.count("*").alias("n_records"))


def read_rates(source, spark: SparkSession | None = None) -> Rates:
    """Rates from a 4 by 4 array, or a json, csv, tsv, npy or xls(x) file of one: rows are from, columns to, in the order A, C, G, T.

    With a session the file is read by Spark, from any file system; else it is a local one.
    """
    if isinstance(source, str):
        suffix = source.rsplit(".", 1)[-1].lower()
        if suffix not in ("npy", "json", "csv", "tsv", "xls", "xlsx"):
            raise NotImplementedError(f"mutation rates in a .{suffix} file")
        if spark is None:
            with open(source, "rb") as f:
                data = f.read()
        else:
            data = bytes(spark.read.format("binaryFile").load(source).select("content").first()[0])  # 16 numbers
        if suffix == "npy":
            import numpy as np

            source = np.load(io.BytesIO(data)).tolist()
        elif suffix == "json":
            source = json.loads(data)
        elif suffix in ("csv", "tsv"):
            source = [line.strip().split("," if suffix == "csv" else "\t") for line in data.decode().splitlines() if line.strip()]
        else:
            import pandas as pd

            source = pd.read_excel(io.BytesIO(data), header=None).to_numpy().tolist()
    matrix = [[float(x) for x in row] for row in source]
    if len(matrix) != 4 or any(len(row) != 4 for row in matrix):
        raise ValueError("mutation rates are a 4 by 4 matrix")
    return {(a, b): matrix[i][j] for i, a in enumerate(BASES) for j, b in enumerate(BASES) if i != j}


def parse_sync(df: DataFrame, samples: list[str]) -> DataFrame:
    """A pileup from a pool table: Contig, Position (from 1), Ref, and A:T:C:G:N:del of each sample; N and del are dropped."""
    rows = df.select("Contig", "Position", F.explode(F.array(*(F.struct(F.lit(s).alias("s"), F.col(f"`{s}`").alias("v")) for s in samples))).alias("x"))
    n = F.split("x.v", ":")
    at = {"a": 0, "t": 1, "c": 2, "g": 3}
    return rows.select(F.col("x.s").alias("sample_id"), F.col("Contig").alias("contig"), (F.col("Position").cast("long") - 1).alias("pos"), *(n[at[k]].cast("long").alias(k) for k in "acgt"))


def read_sync(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.csv(path, sep="\t", header=True)
    return parse_sync(df, df.columns[3:])
