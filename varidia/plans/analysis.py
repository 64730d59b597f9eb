"""The whole analysis: from files or tables to lazy reports, and their export."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..functions.codons import Rates
from ..operators.cds import chunks
from ..operators.coding import coding_site_values, gene_exons, pair_classes, rejected_transcripts, transcript_statistics
from ..operators.diversity import contig_pi, sample_pi
from ..operators.fst import fst as pair_fst
from ..operators.pileup import merge_records, minor_allele_filter, site_diversity
from ..operators.windows import sliding_coding, sliding_pi
from ..sources.readers import check_contigs, read_fasta, read_gtf, read_rates, read_vcf
from ..sources.shared import stored
from ..sources.store import PileupStore
from ..sources.writers import write_reports
from .reports import contigs_report, first_transcripts, genes_report, samples_report, sites_report

MAF = 0.01
CHUNK = 1_000_000


@dataclass
class Diversity:
    """Lazy reports; those of genes are None without an annotation, others if they weren't asked for. paths: where they were written."""

    samples: DataFrame
    contigs: DataFrame
    sites: DataFrame
    genes: DataFrame | None = None
    rejected: DataFrame | None = None
    windows: DataFrame | None = None
    coding_windows: DataFrame | None = None
    fst: DataFrame | None = None
    paths: dict[str, str] | None = None

    def write(self, prefix: str, fmt: str = "csv") -> dict[str, str]:
        return write_reports(self, prefix, fmt)


def diversity(
    pileup: DataFrame, reference: DataFrame, contigs: DataFrame, exons: DataFrame | None = None, maf: float = MAF, rates: Rates | None = None,
    include_stop_codons: bool = False, pi_only: bool = False, chunk_size: int = CHUNK, store: bool = False,
    rolling_window: int | None = None, window_step: int | None = None, fst: bool | DataFrame = False,
) -> Diversity:
    """Reports on a pileup (sample_id, contig, pos, a, c, g, t) with unfiltered counts.

    rolling_window adds windows of so many bases, window_step apart (side by side if None); fst adds the differentiation of all pairs of
    samples, or of those in a table (sample_1, sample_2), by contig.

    With store, filtered counts and transcript statistics are written once to the shared folder, and all reports read them there.
    """
    keep = stored if store else lambda df, name: df
    counts = keep(minor_allele_filter(pileup, maf), "counts")
    sites = site_diversity(counts)
    of_samples, of_contigs = sample_pi(sites, contigs), contig_pi(sites, contigs)
    coding = exons is not None and not pi_only
    out = Diversity(of_samples, of_contigs, sites_report(sites))
    if coding:
        stats = keep(transcript_statistics(counts, exons, reference, rates, include_stop_codons), "transcripts")
        first = first_transcripts(stats, contigs)
        out.samples, out.contigs = samples_report(of_samples, first), contigs_report(of_contigs, first)
        out.genes, out.rejected = genes_report(stats, chunks(exons, contigs, chunk_size), exons), rejected_transcripts(exons)
    if rolling_window:
        step = window_step or rolling_window
        out.windows = sliding_pi(sites, contigs, rolling_window, step)
        if coding:
            values = coding_site_values(counts, gene_exons(exons), reference, rates, include_stop_codons)
            out.coding_windows = sliding_coding(*values, counts.select("sample_id").distinct(), contigs, rolling_window, step)
    if fst is not False and fst is not None:
        classes = pair_classes(exons, reference) if coding else None
        out.fst = pair_fst(counts, classes, None if fst is True else fst, by_contig=True)
    return out


def analyse_files(
    spark: SparkSession, vcf_file: str | list[str], ref_fasta: str, gtf_file: str | None = None, output_file_prefix: str | None = None, maf: float = MAF, mutation_rates=None,
    include_stop_codons: bool = False, pi_only: bool = False, chunk_size: int = CHUNK, rd_merge: str = "sum",
    rolling_window: int | None = None, window_step: int | None = None, fst: bool | DataFrame = False, cache_folder: str | None = None,
) -> Diversity:
    """Reports on VCF files with RD and AD fields, a FASTA and a GTF; written under the prefix if one is given, from one parse of the VCF.

    With cache_folder, parsed counts are kept there: files that haven't changed since another run aren't read again.
    """
    files = [vcf_file] if isinstance(vcf_file, str) else list(vcf_file)
    if cache_folder:
        store = PileupStore(spark, cache_folder)
        for f in files:
            store.add(f, rd_merge)
        pileup = store.read(files)
    else:
        pileup = read_vcf(spark, files[0], rd_merge)
        for f in files[1:]:
            pileup = pileup.unionByName(read_vcf(spark, f, rd_merge))
        pileup = merge_records(pileup) if len(files) > 1 else pileup
    reference, contigs = read_fasta(spark, ref_fasta)
    exons = None
    if gtf_file and not pi_only:
        exons = read_gtf(spark, gtf_file)
        check_contigs(exons, contigs)
    rates = read_rates(mutation_rates, spark) if mutation_rates is not None else None
    out = diversity(pileup, reference, contigs, exons, maf, rates, include_stop_codons, pi_only, chunk_size, output_file_prefix is not None, rolling_window, window_step, fst)
    if output_file_prefix:
        out.paths = out.write(output_file_prefix)
    return out
