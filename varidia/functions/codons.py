"""The genetic code and the tables made from it: sites of codons and classes of base pairs. All have fixed sizes."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession

from .counts import BASES, PAIRS

# The standard genetic code, amino acids of the codons in the order TTT, TTC, TTA, TTG, TCT, ... GGG (* is a stop).
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODE = {"".join(c): aa for c, aa in zip(product("TCAG", repeat=3), AMINO_ACIDS, strict=True)}
CODONS = sorted(CODE)

Rates = dict[tuple[str, str], float]


def mutated(codon: str, at: int, base: str) -> str:
    return codon[:at] + base + codon[at + 1 :]


def site_shares(rates: Rates | None = None, include_stops: bool = False) -> dict[tuple[str, int], tuple[float, float]]:
    """(synonymous, nonsynonymous) sites of each codon position: shares of its possible changes, which sum to 1 or 0.

    Changes to stops, and stop codons, have none unless they're included.
    """
    out = {}
    for codon, at in product(CODONS, range(3)):
        syn = non = 0.0
        if include_stops or CODE[codon] != "*":
            for base in BASES:
                new = mutated(codon, at, base)
                if base == codon[at] or (CODE[new] == "*" and not include_stops):
                    continue
                weight = rates[codon[at], base] if rates else 1 / 3
                if CODE[new] == CODE[codon]:
                    syn += weight
                else:
                    non += weight
        total = syn + non
        out[codon, at] = (syn / total, non / total) if total else (0.0, 0.0)
    return out


def pair_class(codon: str, at: int, pair: str) -> tuple[int, int]:
    """(synonymous, nonsynonymous) flags of a pair of bases; both are 0 if the codon has neither. Stops count as a residue."""
    one, two = pair.upper()
    if codon[at] not in (one, two):
        return 0, 0
    same = CODE[mutated(codon, at, one)] == CODE[mutated(codon, at, two)]
    return int(same), int(not same)


def codon_sites(spark: SparkSession, rates: Rates | None = None, include_stops: bool = False) -> DataFrame:
    """codon, codon_pos, nuc, s_sites, n_sites: sites at the position of the codon that has nuc there."""
    shares = site_shares(rates, include_stops)
    rows = []
    for codon, at, nuc in product(CODONS, range(3), BASES):
        s, n = shares[mutated(codon, at, nuc), at]
        if CODE[codon] == "*" and not include_stops:
            s = n = 0.0
        rows.append((codon, at, nuc, s, n))
    return spark.createDataFrame(rows, "codon string, codon_pos int, nuc string, s_sites double, n_sites double")


def codon_pairs(spark: SparkSession) -> DataFrame:
    """codon, codon_pos, pair, is_syn, is_nonsyn."""
    rows = [(c, i, p, *pair_class(c, i, p)) for c, i, p in product(CODONS, range(3), PAIRS)]
    return spark.createDataFrame(rows, "codon string, codon_pos int, pair string, is_syn int, is_nonsyn int")


def codon_translation(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, CODE[c]) for c in CODONS], "codon string, aa string")


def codon_rows(spark: SparkSession, rates: Rates | None = None, include_stops: bool = False) -> DataFrame:
    """One row of arrays for each codon: s and n sites by position and base (12), pair flags by position and pair (18)."""
    shares = site_shares(rates, include_stops)
    rows = []
    for codon in CODONS:
        dead = CODE[codon] == "*" and not include_stops
        sites = [(0.0, 0.0) if dead else shares[mutated(codon, i, b), i] for i in range(3) for b in BASES]
        flags = [pair_class(codon, i, p) for i in range(3) for p in PAIRS]
        rows.append((codon, [x[0] for x in sites], [x[1] for x in sites], [x[0] for x in flags], [x[1] for x in flags], *(sum(shares[codon, i][k] for i in range(3)) for k in (0, 1))))
    return spark.createDataFrame(rows, "codon string, s array<double>, n array<double>, syn array<int>, non array<int>, s_all double, n_all double")
