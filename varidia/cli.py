"""Command line: python -m varidia.cli --vcf FILE --ref_fasta FILE [--gtf FILE] --output PREFIX"""

from __future__ import annotations

import argparse
import logging
import time

from . import __version__
from .plans.analysis import CHUNK, MAF, analyse_files


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="varidia", description="Nucleotide diversity of pooled samples.", formatter_class=argparse.ArgumentDefaultsHelpFormatter)
    p.add_argument("-v", "--vcf", required=True, nargs="+", help="variants with RD and AD fields; several files are read together")
    p.add_argument("-r", "--ref_fasta", required=True, help="reference sequence")
    p.add_argument("-g", "--gtf", help="annotation; without it only diversity of sites, samples and contigs")
    p.add_argument("-o", "--output", default="results", help="prefix of the written folders")
    p.add_argument("--maf", type=float, default=MAF, help="least share of an allele's reads")
    p.add_argument("--mutation_rates", help="4 by 4 rates: json, csv, tsv, npy or xlsx")
    p.add_argument("--pi_only", action="store_true", help="skip synonymous and nonsynonymous diversity")
    p.add_argument("--include_stop_codons", action="store_true", help="count changes from and to stops as sites")
    p.add_argument("--chunk_size", type=int, default=CHUNK, help="bases of the chunks that chunk_id numbers")
    p.add_argument("--rolling_window", type=int, help="bases of windows along contigs")
    p.add_argument("--window_step", type=int, help="bases between the starts of windows; their width if left out")
    p.add_argument("--fst", action="store_true", help="differentiation of all pairs of samples, by contig")
    p.add_argument("--cache_folder", help="keeps parsed variants there for other runs")
    p.add_argument("-t", "--threads", type=int, default=0, help="local threads; 0 uses the session's master")
    p.add_argument("--version", action="version", version=__version__)
    return p


def main(argv: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession

    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(message)s")
    builder = SparkSession.builder.appName("varidia")
    if args.threads:
        builder = builder.master(f"local[{args.threads}]")
    began = time.time()
    out = analyse_files(
        builder.getOrCreate(), args.vcf, args.ref_fasta, args.gtf, args.output, args.maf, args.mutation_rates, args.include_stop_codons, args.pi_only, args.chunk_size,
        rolling_window=args.rolling_window, window_step=args.window_step, fst=args.fst, cache_folder=args.cache_folder)
    if out.rejected is not None:
        for r in out.rejected.toLocalIterator():
            logging.warning("coding length of %s on %s is %d, not of whole codons", r["transcript_id"], r["contig"], r["transcript_len"])
    logging.info("done in %.1f s", time.time() - began)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
