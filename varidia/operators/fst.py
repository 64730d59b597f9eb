"""Differentiation of pairs of samples: FST = 1 - sum of diversities within / sum of diversities between.

Both are summed over the sites where the two samples have two reads or more, and only then divided. At a site, the diversity between
is the chance that a read of one sample differs from a read of the other; the diversity within is the mean of the two site diversities.
Kinds N and S count only pairs of bases that are nonsynonymous or synonymous in the reference codon of the site.

Sums of products over sites are matrix products: with P the frequencies of samples at sites, P P^T has all pairs of samples at once. So a
site's samples meet as one vector, a task adds up matrices over its sites, and only sums of pairs are shuffled, never rows of
pairs and sites. Where there are more than ``block`` samples, each pair of blocks of samples is a key of its own, so no
matrix is larger than 2 * block squared.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.counts import COUNTS, depth

BLOCK = 512
SITES = 256
KINDS = ("all", "N", "S")
#: places of the pairs ac, ag, at, cg, ct, gt in a matrix of bases
_X, _Y = np.triu_indices(4, 1)
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class _Sums:
    """Matrices of a contig and pair of blocks: within, between and sites of each kind, by pairs of samples."""

    def __init__(self, kinds: tuple[str, ...]) -> None:
        self.kinds, self.place, self.block = kinds, {}, []
        self.m = np.zeros((len(kinds), 3, 0, 0))

    def add(self, names: list[str], blocks: np.ndarray, site: np.ndarray, counts: np.ndarray, changes: list[np.ndarray]) -> None:
        """Counts (rows of a sample at a site, 4); changes: for each kind (sites, 4, 4), the pairs of bases that count."""
        for name, b in zip(names, blocks.tolist(), strict=True):
            if self.place.setdefault(name, len(self.place)) == len(self.block):
                self.block.append(b)
        grow = len(self.place) - self.m.shape[-1]
        self.m = np.pad(self.m, ((0, 0), (0, 0), (0, grow), (0, grow)))
        row = np.array([self.place[x] for x in names])
        n = np.zeros((len(self.place), len(changes[0]), 4))
        n[row, site] = counts
        d = n.sum(2)
        there = (d > 1).astype(float)
        p = n / np.maximum(d, 1)[..., None]
        flat = p.reshape(len(p), -1).T
        for k, c in enumerate(changes):
            has = there * c.any((1, 2))
            within = np.einsum("isx,sxy,isy->is", n, c, n, optimize=True) / np.maximum(d * (d - 1), 1)
            half = within @ has.T / 2
            self.m[k, 0] += half + half.T
            self.m[k, 1] += np.einsum("isx,sxy->isy", p, c, optimize=True).reshape(len(p), -1) @ flat
            self.m[k, 2] += has @ there.T

    def batches(self, contig: str, same: bool) -> Iterator[pa.RecordBatch]:
        names, block = np.array(list(self.place), object), np.array(self.block)
        order = np.argsort(names)
        for k, kind in enumerate(self.kinds):
            within, between, sites = (x[np.ix_(order, order)] for x in self.m[k])
            pair = np.triu(sites > 0, 1)
            if not same:
                pair &= block[order][:, None] != block[order][None, :]
            i, j = np.nonzero(pair)
            if len(i):
                left, right = names[order][i].tolist(), names[order][j].tolist()
                yield pa.RecordBatch.from_arrays([
                    pa.array(left, pa.string()), pa.array(right, pa.string()), pa.array([contig] * len(i), pa.string()), pa.array([kind] * len(i), pa.string()),
                    pa.array(within[i, j]), pa.array(between[i, j]), pa.array(sites[i, j].astype(np.int64)),
                ], ["sample_1", "sample_2", "contig", "kind", "within", "between", "n_sites"])


def _changes(flags: pa.Array, n: int) -> np.ndarray:
    out = np.zeros((n, 4, 4))
    for s, f in enumerate(flags.to_pylist()):
        if f:
            out[s, _X, _Y] = f
    return out + out.transpose(0, 2, 1)


def pair_sums(pileup: DataFrame, classes: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """(sample_1, sample_2, contig, kind, within, between, n_sites) of unordered pairs with common sites, sample_1 < sample_2.

    pileup has filtered counts. classes (contig, pos, non, syn), with flags of the pairs ac, ag, at, cg, ct and gt, adds the kinds N and S.
    """
    read = pileup.filter(depth() > 1)
    n = pileup.select("sample_id").distinct().count()
    blocks = max(1, -(-n // block))
    own = F.pmod(F.xxhash64("sample_id"), F.lit(blocks)).cast("int")
    rows = read.select("contig", "pos", F.struct("sample_id", own.alias("block"), *COUNTS).alias("x"), own.alias("own"))
    if classes is not None:
        rows = rows.join(classes.select("contig", "pos", "non", "syn"), ["contig", "pos"], "left")
    kinds = KINDS if classes is not None else KINDS[:1]
    flags = [F.first(c).alias(c) for c in ("non", "syn")] if classes is not None else []
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    rows = rows.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    sites = rows.groupBy("contig", "pos", "i", "j").agg(F.collect_list("x").alias("x"), *flags)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sums = None, None
        for batch in batches:
            col = {c: batch.column(k) for k, c in enumerate(batch.schema.names)}
            keys = list(zip(col["contig"].to_pylist(), col["i"].to_pylist(), col["j"].to_pylist(), strict=True))
            ends = [k for k in range(1, len(keys)) if keys[k] != keys[k - 1]] + [len(keys)]
            at = 0
            for end in ends:
                if keys[at] != key:
                    if sums is not None:
                        yield from sums.batches(key[0], key[1] == key[2])
                    key, sums = keys[at], _Sums(kinds)
                for lo in range(at, end, SITES):
                    hi = min(end, lo + SITES)
                    x = col["x"].slice(lo, hi - lo)
                    v = x.flatten()
                    changes = [np.broadcast_to(1 - np.eye(4), (hi - lo, 4, 4))]
                    changes += [_changes(col[c].slice(lo, hi - lo), hi - lo) for c in ("non", "syn") if c in col]
                    site = np.repeat(np.arange(hi - lo), np.asarray(x.value_lengths()))
                    counts = np.stack([np.asarray(v.field(c), float) for c in COUNTS], 1)
                    sums.add(v.field("sample_id").to_pylist(), np.asarray(v.field("block")), site, counts, changes)
                at = end
        if sums is not None:
            yield from sums.batches(key[0], key[1] == key[2])

    columns = ["contig", "i", "j", "x", *(["non", "syn"] if flags else [])]
    parts = sites.select(*columns).sortWithinPartitions("contig", "i", "j")
    parts = parts.mapInArrow(add_up, "sample_1 string, sample_2 string, contig string, kind string, within double, between double, n_sites bigint")
    return parts.groupBy("sample_1", "sample_2", "contig", "kind").agg(F.sum("within").alias("within"), F.sum("between").alias("between"), F.sum("n_sites").alias("n_sites"))


def fst(pileup: DataFrame, classes: DataFrame | None = None, pairs: DataFrame | None = None, by_contig: bool = False, block: int = BLOCK) -> DataFrame:
    """(sample_1, sample_2, [contig,] kind, n_sites, fst); null where nothing differs between the two.

    pairs (sample_1, sample_2), in any order, restricts the result; only their samples are read. Pairs without common sites have no row.
    """
    wanted = None
    if pairs is not None:
        wanted = pairs.select(F.least("sample_1", "sample_2").alias("sample_1"), F.greatest("sample_1", "sample_2").alias("sample_2")).distinct()
        pileup = pileup.join(wanted.select(F.explode(F.array("sample_1", "sample_2")).alias("sample_id")).distinct(), "sample_id", "left_semi")
    sums = pair_sums(pileup, classes, block)
    if wanted is not None:
        sums = sums.join(wanted, ["sample_1", "sample_2"], "left_semi")
    by = ["sample_1", "sample_2", *(["contig"] if by_contig else []), "kind"]
    ratio = F.when(F.sum("between") > 1e-12, 1 - F.sum("within") / F.sum("between"))
    return sums.groupBy(*by).agg(F.sum("n_sites").alias("n_sites"), ratio.alias("fst"))
