"""Document fingerprints by locally consistent parsing.

A text is a row of symbols (code points). At each level, runs of one symbol become one symbol; deterministic
coin tossing (the lowest bit in which a symbol differs from the one before, with its value, four times over)
gives small labels that differ between neighbours; a phrase begins at each local maximum of the labels; a
phrase's name is a hash of its symbols, and the names are the next level's symbols. Where a phrase begins
depends on a few symbols around it only, so equal substrings get equal names inside, at any offset.

A fingerprint is the K smallest of the names at LEVELS, as hex; texts of fewer than SHORT characters, which have few phrases there, add
those of level 1. Likeness is the Jaccard index of all names of both texts, not of the fingerprints; of a short text and another
that isn't long, with level 1.

Null counts as the empty text, whose fingerprint is empty; two empty fingerprints are alike (1), an empty and
another are not (0). Memory is some 120 bytes for each character of a block of texts or of one longer text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import _POW, mix

K = 64
LEVELS = (2, 3, 4)
SHORT, FINE = 64, 256
BLOCK_CHARS = 1 << 18


def _toss_table(n: int) -> np.ndarray:
    x, y = np.meshgrid(np.arange(n, dtype=np.int64), np.arange(n, dtype=np.int64), indexing="ij")
    low = (x ^ y) & -(x ^ y)
    place = np.bitwise_count(np.maximum(low, 1) - 1).astype(np.int64)
    return np.where(x == y, 0, 2 * place + ((x & low) != 0)).astype(np.uint8)


_TOSS = [_toss_table(128), _toss_table(16), _toss_table(8)]


def parse(sym: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: the names of the phrases, and where each text's names begin (first: the same of symbols).

    Every text has a symbol at least.
    """
    begin = np.zeros(len(sym), bool)
    begin[first] = True
    run = begin.copy()
    run[1:] |= sym[1:] != sym[:-1]
    at = np.flatnonzero(run)
    lens = np.diff(np.append(at, len(sym)))
    s = sym[at]
    if len(at) < len(sym):
        s = np.where(lens > 1, mix(s + lens.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), s)
    begin = begin[at]
    # coin tossing; a text's first symbol is compared with its own complement
    prev = np.empty_like(s)
    prev[1:] = s[:-1]
    prev[begin] = ~s[begin]
    diff = s ^ prev
    low = diff & (~diff + np.uint64(1))
    label = (2 * np.bitwise_count(low - np.uint64(1)) + ((s & low) != 0)).astype(np.uint8)
    label[diff == 0] = 0
    for table in _TOSS:
        before = np.empty_like(label)
        before[1:] = label[:-1]
        before[begin] = label[begin] ^ 1
        label = table[label, before]
    start = begin.copy()
    if len(s) > 2:
        start[1:-1] |= (label[1:-1] > label[:-2]) & (label[1:-1] >= label[2:]) & ~np.append(begin[2:], False)[: len(s) - 2]
    cut = np.flatnonzero(start)
    size = np.diff(np.append(cut, len(s)))
    inner = np.arange(len(s)) - np.repeat(cut, size)
    names = mix(np.add.reduceat(mix(s) * _POW[inner & 4095], cut) + size.astype(np.uint64))
    return names, np.flatnonzero(begin[cut])


def name_sets(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each text the sorted names (32 bits) of the phrases at LEVELS, and those with the phrases of level 1 as well."""
    out = [(np.zeros(0, np.uint32),) * 2] * len(texts)
    full = [i for i, t in enumerate(texts) if t]
    if not full:
        return out
    sym = np.frombuffer("".join(texts[i] for i in full).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    first = np.concatenate(([0], np.cumsum([len(texts[i]) for i in full])[:-1])).astype(np.int64)
    keys = []
    for level in range(1, max(LEVELS) + 1):
        sym, first = parse(sym, first)
        if level == 1 or level in LEVELS:
            owner = np.repeat(np.arange(len(full), dtype=np.uint64), np.diff(np.append(first, len(sym))))
            keys.append(owner << np.uint64(32) | mix(sym + np.uint64(level)) >> np.uint64(32))
    fine = np.zeros(len(full) + 1, bool)
    fine[:-1] = [len(texts[i]) < FINE for i in full]
    low = keys[0][fine[(keys[0] >> np.uint64(32)).astype(np.int64)]] if 1 not in LEVELS else keys[0][:0]
    own = np.unique(np.concatenate(keys[1:] if 1 not in LEVELS else keys))
    each = np.arange(len(full) + 1, dtype=np.uint64) << np.uint64(32)
    both = np.unique(np.concatenate((own[fine[(own >> np.uint64(32)).astype(np.int64)]], low)))
    (a, b), word = (np.searchsorted(k, each) for k in (own, both)), np.uint64(0xFFFFFFFF)
    for k, i in enumerate(full):
        names = (own[a[k] : a[k + 1]] & word).astype(np.uint32)
        out[i] = (names, (both[b[k] : b[k + 1]] & word).astype(np.uint32) if fine[k] else names)
    return out


def sketches(texts: list[str]) -> list[np.ndarray]:
    """The sorted K smallest names of each text at LEVELS, with level 1 for texts of fewer than SHORT characters."""
    return [sketch(t, s) for t, s in zip(texts, name_sets(texts), strict=True)]


def sketch(text: str, sets: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return sets[len(text) < SHORT][:K]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The Jaccard index of two sorted sets."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def alike(text: str, sets: tuple, other: str, others: tuple) -> float:
    """Likeness from all names of both texts; level 1 counts if one of them has fewer than SHORT characters and the other fewer than FINE."""
    fine = min(len(text), len(other)) < SHORT and max(len(text), len(other)) < FINE
    return likeness(sets[fine], others[fine])


def to_hex(a: np.ndarray) -> str:
    return a.astype(">u4").tobytes().hex()


def fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """df with each text's fingerprint; other columns pass, one named ``out`` is replaced."""

    @F.arrow_udf("string")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for arr in parts:
            texts, got = [t or "" for t in arr.to_pylist()], []
            for part in _parts(texts):
                got += map(to_hex, sketches(part))
            yield pa.array(got, pa.string())

    return df.withColumn(out, run(text))


def _parts(texts: list[str]) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= BLOCK_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def edited(text: str, following: str) -> str:
    """text with its last third replaced by as many characters of the beginning of the following text."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def with_neighbours(docs: DataFrame, n_ranges: int | None = None) -> DataFrame:
    """Rows (part, look, key, doc_id, text), dealt and sorted so that a text's next one by descending doc_id follows it.

    Ranges of doc_id are dealt out whole; each range also gets the first row of the next one, marked ``look``, and
    the last range that of the first. One shuffle of the texts; the driver sees two numbers for each range, of which
    there are 8192 at most. A null doc_id comes last; rows of one doc_id are in the order of their texts' hashes.
    """
    spark = docs.sparkSession
    n = min(8192, n_ranges or 3 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    docs = docs.select(F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("key"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cuts = docs.agg(F.percentile_approx("key", [i / n for i in range(1, n)] or [0.5], 20000)).first()[0]
    bounds = np.unique(np.array(cuts or [], np.int64))

    @F.arrow_udf("int")
    def part(keys: pa.Array) -> pa.Array:
        return pa.array(len(bounds) - np.searchsorted(bounds, keys.to_numpy(zero_copy_only=False)), pa.int32())

    # part numbers are replaced by others whose hashes deal them to one task each
    dealt = spark.range(40 * n).groupBy(F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("task")).agg(F.min("id").alias("id")).collect()  # n rows
    name = [int(r["id"]) for r in sorted(dealt, key=lambda r: r["task"])]
    heads = sorted((r["part"], r["head"]) for r in docs.select("key", part("key").alias("part")).groupBy("part").agg(F.max("key").alias("head")).collect())
    rows = docs.select(part("key").alias("part"), F.lit(0).alias("look"), "key", "doc_id", "text")
    if not heads:
        return rows
    to = spark.createDataFrame([(heads[i][1], heads[i - 1][0]) for i in range(len(heads))], "key bigint, part int")
    look = docs.filter(F.col("key").isin([h for _, h in heads])).join(F.broadcast(to), "key").select("part", F.lit(1).alias("look"), "key", "doc_id", "text")
    names = F.array(*map(F.lit, name))
    rows = rows.unionByName(look).withColumn("part", F.element_at(names, F.col("part") % len(name) + 1))
    return rows.repartition(n, "part").sortWithinPartitions("part", "look", F.desc("key"), F.xxhash64("text"), "text")


def op5_phrases(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finish(block: list[tuple], after: tuple | None) -> pa.RecordBatch | None:
            follow = [*block[1:], after]
            own = [(r, f if f is not None and f[0] == r[0] else r) for r, f in zip(block, follow, strict=True) if not r[1]]
            if not own:
                return None
            last = [own[-1][1][3]]
            index = {id(r): i for i, (r, _) in enumerate(own)}
            changed = [edited(r[3], f[3]) for r, f in own]
            texts = [r[3] for r, _ in own]
            fps = name_sets(texts + last)
            new = name_sets(changed)
            nxt = [fps[index[id(f)]] if id(f) in index else (name_sets([f[3]])[0] if f is not own[-1][1] else fps[-1]) for _, f in own]
            return pa.RecordBatch.from_arrays([
                pa.array([r[2] for r, _ in own], pa.int64()),
                pa.array([len(r[3]) for r, _ in own], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
                pa.array([to_hex(sketch(t, a)) for t, a in zip(texts, fps, strict=False)], pa.string()),
                pa.array([to_hex(sketch(t, a)) for t, a in zip(changed, new, strict=True)], pa.string()),
                pa.array([alike(t, a, c, b) for t, a, c, b in zip(texts, fps, changed, new, strict=False)], pa.float64()),
                pa.array([alike(t, a, f[3], b) for t, a, (_, f), b in zip(texts, fps, own, nxt, strict=False)], pa.float64()),
            ], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        block, size = [], 0
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= BLOCK_CHARS:
                    if (done := finish(block, r)) is not None:
                        yield done
                    block, size = [], 0
                block.append(r)
                size += len(r[3])
        if block and (done := finish(block, None)) is not None:
            yield done

    return with_neighbours(docs).select("part", "look", "doc_id", "text").mapInArrow(run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
