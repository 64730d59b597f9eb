"""Coding positions of transcripts, their reading frames, and overlaps of frames.

exons: (contig, transcript_id, gene_id, strand, exon_ord, start, end), half-open from 0, in transcription order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .intervals import overlapping, points_in, running_sums

TRANSCRIPT = ["contig", "transcript_id"]
SWEEP = 1_000_000  # bases of a block of the sweep


def exon_offsets(exons: DataFrame) -> DataFrame:
    """exons with cds_offset: coding bases before the exon."""
    before = Window.partitionBy(*TRANSCRIPT).orderBy("exon_ord").rowsBetween(Window.unboundedPreceding, -1)
    return exons.withColumn("cds_offset", F.coalesce(F.sum(F.col("end") - F.col("start")).over(before), F.lit(0)).cast("long"))


def transcripts(exons: DataFrame) -> DataFrame:
    """A row for each transcript: gene, strand, extent, coding length and place in the file."""
    return exons.groupBy(*TRANSCRIPT).agg(
        F.min("gene_id").alias("gene_id"), F.min("strand").alias("strand"), F.min("start").alias("first_pos"), F.max("end").alias("last_pos"),
        F.sum(F.col("end") - F.col("start")).cast("long").alias("transcript_len"), F.min("exon_ord").alias("file_ord"),
    )


def cds_positions(exons: DataFrame) -> DataFrame:
    """A row for each coding base: cds_idx from 0 in transcription order, and the contig's pos.

    Only coding bases are made, never introns; joins with sites are then equi-joins on (contig, pos).
    """
    df = exon_offsets(exons).select("*", F.posexplode(F.sequence(F.lit(0), F.col("end") - F.col("start") - 1)).alias("__i", "__d"))
    pos = F.when(F.col("strand") == "-", F.col("end") - 1 - F.col("__i")).otherwise(F.col("start") + F.col("__i"))
    return df.select(*TRANSCRIPT, "strand", (F.col("cds_offset") + F.col("__i")).cast("long").alias("cds_idx"), pos.cast("long").alias("pos"))


def reading_frames(exons: DataFrame, origin: int = 0) -> DataFrame:
    """exons with frame: 0 to 2 on the plus strand, 3 to 5 on the minus strand, by each exon's own first base."""
    frame = F.when(F.col("strand") == "-", F.pmod(F.col("end") - origin, F.lit(3)) + 3).otherwise(F.pmod(F.col("start") - origin, F.lit(3)))
    return exons.withColumn("frame", frame.cast("int"))


def overlap_intervals(exons: DataFrame) -> DataFrame:
    """(contig, start, end), disjoint: where exons of several frames lie, by a sweep over the exons' two edges with a running count for each frame."""
    exons = reading_frames(exons).filter("start < end")
    edge = lambda at, sign: F.struct(F.col(at).cast("long").alias("pos"), *(F.when(F.col("frame") == f, sign).otherwise(0).cast("long").alias(f"f{f}") for f in range(6)))
    frames = [f"f{f}" for f in range(6)]
    edges = exons.select("contig", F.inline(F.array(edge("start", 1), edge("end", -1)))).groupBy("contig", "pos").agg(*(F.sum(f).alias(f) for f in frames))
    several = sum(((F.col(f) > 0).cast("int") for f in frames), F.lit(0)) > 1
    return running_sums(edges, ["contig"], "pos", frames, SWEEP).filter(several).select("contig", F.col("pos").alias("start"), F.col("__end").alias("end"))


def overlapping_positions(exons: DataFrame) -> DataFrame:
    """(contig, pos) that several frames cover: overlap_intervals, expanded."""
    return overlap_intervals(exons).select("contig", F.explode(F.sequence("start", F.col("end") - 1)).alias("pos"))


def variants_in_exons(variants: DataFrame, exons: DataFrame) -> DataFrame:
    """(contig, transcript_id, strand, pos, cds_idx) of the variants (contig, pos) that lie in coding bases, without a row for each base."""
    own = exon_offsets(exons).select(*TRANSCRIPT, "strand", "start", "end", "cds_offset")
    inside = F.when(F.col("strand") == "-", F.col("end") - 1 - F.col("pos")).otherwise(F.col("pos") - F.col("start"))
    return points_in(variants.select("contig", "pos").distinct(), own).select(*TRANSCRIPT, "strand", "pos", (F.col("cds_offset") + inside).cast("long").alias("cds_idx"))


def transcripts_in_regions(exons: DataFrame, regions: DataFrame) -> DataFrame:
    """A row for each transcript and region (contig, start, end, ...) in which the transcript starts: its columns of transcripts() and the region's others."""
    return points_in(transcripts(exons), regions, pos="first_pos")


def overlapping_transcripts(exons: DataFrame) -> DataFrame:
    """(contig, transcript_id, other_transcript_id): pairs of transcripts whose exons share a base, the smaller id first."""
    own = exons.select(*TRANSCRIPT, "start", "end")
    return overlapping(own, own).filter("transcript_id < other_transcript_id").select(*TRANSCRIPT, "other_transcript_id").distinct()


def chunks(exons: DataFrame, contigs: DataFrame, size: int) -> DataFrame:
    """Ranges of contigs of about ``size`` bases that cut no transcript: (contig, chunk_id, start, end).

    Transcripts that overlap are islands (running maximum of ends); a nominal cut inside an island moves to its end.
    """
    extent = transcripts(exons).select("contig", F.col("first_pos").alias("s"), F.col("last_pos").alias("e"))
    w = Window.partitionBy("contig").orderBy("s", "e")
    islands = extent.withColumn("reach", F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    islands = islands.withColumn("island", F.sum((F.coalesce("reach", F.lit(-1)) <= F.col("s")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    islands = islands.groupBy("contig", "island").agg(F.min("s").alias("s"), F.max("e").alias("e")).withColumnRenamed("contig", "__c")
    cuts = contigs.select("contig", "length", F.explode(F.sequence(F.lit(0), F.col("length") - 1, F.lit(size))).alias("cut"))
    moved = cuts.join(islands, (F.col("contig") == F.col("__c")) & (F.col("cut") > F.col("s")) & (F.col("cut") < F.col("e")), "left")
    starts = moved.select("contig", "length", F.coalesce("e", "cut").cast("long").alias("start")).filter(F.col("start") < F.col("length")).distinct()
    order = Window.partitionBy("contig").orderBy("start")
    return starts.select("contig", (F.row_number().over(order) - 1).cast("long").alias("chunk_id"), "start", F.coalesce(F.lead("start").over(order), F.col("length")).cast("long").alias("end"))
