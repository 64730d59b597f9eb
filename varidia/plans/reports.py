"""Reports over transcripts, genes, samples, contigs and sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.cds import TRANSCRIPT, transcripts_in_regions
from ..operators.coding import NO_OVERLAP, STATS

GENE_COLUMNS = ["sample_id", "contig", "chunk_id", "transcript_id", "transcript", "gene_id", "gene_symbol", "transcript_len", "transcript_len_no_overlap", *STATS, *NO_OVERLAP]


def genes_report(stats: DataFrame, chunks: DataFrame | None = None, exons: DataFrame | None = None) -> DataFrame:
    """The 19 columns of a row for each sample and transcript; chunk_id is that of the chunk the transcript starts in.

    Transcripts of exons, without samples, meet the chunks by bins; statistics are joined with them by key.
    """
    df = stats
    if chunks is None or exons is None:
        df = df.withColumn("chunk_id", F.lit(None).cast("long"))
    else:
        of = transcripts_in_regions(exons, chunks)
        df = df.join(of.select(*TRANSCRIPT, "chunk_id"), TRANSCRIPT, "left")
    return df.withColumns({"transcript": F.col("transcript_id"), "gene_symbol": F.col("gene_id")}).select(*GENE_COLUMNS)


def first_transcripts(stats: DataFrame, contigs: DataFrame) -> DataFrame:
    """For each contig, gene and sample the first transcript that has statistics, by start, then place in the file."""
    order = Window.partitionBy("contig", "gene_id", "sample_id").orderBy("first_pos", "file_ord", "transcript_id")
    known = stats.filter(F.col("pi").isNotNull())
    return known.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def _weighted(kind: str) -> Column:
    value, weight = F.col(f"pi{kind}_no_overlap"), F.col(f"{kind}_sites_no_overlap")
    top = F.sum(F.when(value.isNotNull(), value * weight))
    bottom = F.sum(F.when(value.isNotNull(), weight))
    return F.when(bottom > 1e-12, top / bottom).alias(f"pi{kind}")


def _rolled(first: DataFrame, by: list[str]) -> DataFrame:
    return first.groupBy(*by).agg(_weighted("N"), _weighted("S"), F.sum("N_sites_no_overlap").alias("N_sites"), F.sum("S_sites_no_overlap").alias("S_sites"))


def samples_report(sample_pi: DataFrame, first: DataFrame) -> DataFrame:
    return sample_pi.join(_rolled(first, ["sample_id"]), "sample_id", "left").select("sample_id", *STATS)


def contigs_report(contig_pi: DataFrame, first: DataFrame) -> DataFrame:
    out = contig_pi.join(_rolled(first, ["sample_id", "contig"]), ["sample_id", "contig"], "left")
    return out.select("sample_id", "contig", "contig_length", *STATS)


def sites_report(sites: DataFrame) -> DataFrame:
    """(sample_id, contig, pos, stat_name, value): long, as there may be many positions."""
    return sites.select("sample_id", "contig", "pos", F.lit("pi").alias("stat_name"), F.col("pi").alias("value"))


def wide_sites(sites: DataFrame, contig: str, positions: list[int] | None = None) -> DataFrame:
    """One contig's sites with a column for each position, for export."""
    df = sites_report(sites).filter(F.col("contig") == contig)
    return df.groupBy("sample_id", "contig", "stat_name").pivot("pos", positions).agg(F.first("value"))
