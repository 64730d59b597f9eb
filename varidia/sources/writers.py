"""Writers of reports and pool tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.pileup import attach_base, consensus_lines, reference_blocks

#: files of a contig at most
FILES = 16
LINE = 100


def write_consensus(pileup: DataFrame, reference: DataFrame, contigs: DataFrame, path: str) -> None:
    """FASTA of each sample's consensus, in a folder for each sample; its files in the order of their names are one text.

    Rows are blocks of bases, sorted by contig and block over ranges, so no task holds a contig.
    """
    lines = consensus_lines(pileup, reference).join(contigs.select("contig", "contig_ord"), "contig")
    broken = F.regexp_replace("seq", f"(.{{{LINE}}})(?=.)", "$1\n")
    text = F.when(F.col("block") == 0, F.concat(F.lit(">"), "contig", F.lit("\n"), broken)).otherwise(broken)
    ordered = lines.select("sample_id", "contig_ord", "block", text.alias("value")).repartitionByRange("sample_id", "contig_ord", "block").sortWithinPartitions("sample_id", "contig_ord", "block")
    ordered.select("sample_id", "value").write.mode("overwrite").partitionBy("sample_id").text(path)


def write_reports(result, prefix: str, fmt: str = "csv") -> dict[str, str]:
    """Folders of the reports under a prefix; sites and contigs as gzip, in a folder for each contig. Returns their paths."""
    paths = {}
    for name, df, parts in (("genes", result.genes, []), ("samples", result.samples, []), ("sites", result.sites, ["contig"]), ("summary_statistics", result.contigs, ["contig"]), ("windows", result.windows, ["contig"]), ("coding_windows", result.coding_windows, ["contig"]), ("fst", result.fst, []), ("rejected", result.rejected, [])):
        if df is None:
            continue
        paths[name] = f"{prefix}_{name}"
        if parts:  # a contig's rows in as many files as they need, not in one of each task
            df = df.repartition(*parts, F.pmod(F.xxhash64("sample_id", *(["pos"] if "pos" in df.columns else [])), F.lit(FILES)))
        out = df.write.mode("overwrite").partitionBy(*parts)
        (out.csv(paths[name], header=True, compression="gzip" if parts else None) if fmt == "csv" else out.format(fmt).save(paths[name]))
    return paths


def sync_strings(pileup: DataFrame) -> DataFrame:
    """pileup as (sample_id, contig, pos, counts), counts being A:T:C:G:N:del."""
    zero = F.lit("0")
    return pileup.select("sample_id", "contig", "pos", F.concat_ws(":", *(F.col(k).cast("string") for k in "atcg"), zero, zero).alias("counts"))


def to_sync(pileup: DataFrame, reference: DataFrame, samples: list[str]) -> DataFrame:
    """A pool table with a column for each sample; a sample without reads at a site has zeros."""
    rows = attach_base(sync_strings(pileup), reference)
    wide = rows.groupBy("contig", "pos", "base").pivot("sample_id", samples).agg(F.first("counts")).fillna("0:0:0:0:0:0", samples)
    return wide.select(F.col("contig").alias("Contig"), (F.col("pos") + 1).alias("Position"), F.col("base").alias("Ref"), *(f"`{s}`" for s in samples))


def _lines(rows: DataFrame, path: str, compression: str | None = None) -> None:
    """Text files of (contig, at, value) in that order over ranges, one after the other."""
    rows.repartitionByRange("contig", "at").sortWithinPartitions("contig", "at").select("value").write.mode("overwrite").text(path, compression=compression)


def write_vcf(pileup: DataFrame, reference: DataFrame, samples: list[str], path: str, compression: str | None = None) -> None:
    """Records with the fields RD (reference reads) and AD (reads of each alternate); alternates are the other bases that some sample has.

    The header goes into a file of its own that comes first. A sample without reads at a site has no reads of any base.
    """
    df = attach_base(pileup, reference, "inner")
    others = [F.when((F.col(b) > 0) & (F.col("base") != b.upper()), F.lit(b.upper())) for b in "acgt"]
    seen = df.groupBy("contig", "pos", "base").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array_compact(F.array(*others)))))).alias("alts"), F.collect_list(F.struct("sample_id", *"acgt")).alias("x"))
    names = seen.select("contig", "pos", "base", "alts", F.map_from_entries(F.transform("x", lambda x: F.struct(x["sample_id"], F.create_map(F.lit("A"), x["a"], F.lit("C"), x["c"], F.lit("G"), x["g"], F.lit("T"), x["t"])))).alias("m"))
    own = lambda m: F.concat(F.coalesce(m[F.col("base")], F.lit(0)).cast("string"), F.lit(":"), F.when(F.size("alts") == 0, ".").otherwise(F.array_join(F.transform("alts", lambda a: F.coalesce(m[a], F.lit(0)).cast("string")), ",")))
    fields = F.transform(F.array(*map(F.lit, samples)), lambda s: F.coalesce(own(F.col("m")[s]), F.lit("0:.")))
    alt = F.when(F.size("alts") == 0, ".").otherwise(F.array_join("alts", ","))
    line = F.concat_ws("\t", "contig", (F.col("pos") + 1).cast("string"), F.lit("."), "base", alt, F.lit("."), F.lit("."), F.lit("."), F.lit("RD:AD"), fields)
    _lines(names.select("contig", F.col("pos").alias("at"), line.alias("value")), path, compression)
    head = ["##fileformat=VCFv4.2", "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *samples])]
    pileup.sparkSession.createDataFrame([("\n".join(head),)], "value string").coalesce(1).write.mode("append").text(path, compression=compression)


def write_fasta(reference: DataFrame, path: str) -> None:
    """A record for each contig, of one line for each block of bases."""
    blocks = reference_blocks(reference)
    text = F.when(F.col("block") == 0, F.concat(F.lit(">"), "contig", F.lit("\n"), "seq")).otherwise(F.col("seq"))
    rows = blocks.select("contig", "block", text.alias("value"))  # a contig's lines stay in one file, or a record would be cut
    rows.repartition("contig").sortWithinPartitions("contig", "block").select("value").write.mode("overwrite").text(path)


def write_gtf(exons: DataFrame, path: str) -> None:
    """Rows of exons (contig, transcript_id, gene_id, strand, exon_ord, start, end) as CDS rows."""
    fields = ["contig", F.lit("varidia"), F.lit("CDS"), (F.col("start") + 1).cast("string"), F.col("end").cast("string"), F.lit("."), F.col("strand"), F.lit("0"), F.concat(F.lit('gene_id "'), "gene_id", F.lit('"; transcript_id "'), "transcript_id", F.lit('";'))]
    _lines(exons.select("contig", F.col("exon_ord").alias("at"), F.concat_ws("\t", *fields).alias("value")), path)


def write_sync(pileup: DataFrame, reference: DataFrame, samples: list[str], path: str) -> None:
    to_sync(pileup, reference, samples).write.mode("overwrite").csv(path, sep="\t", header=True)
