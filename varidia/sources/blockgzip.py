"""Block-gzip text (.gz or .bgz as genome tools write it), read by many tasks.

Such a file is a row of small gzip members, each of which says its own length. Spark takes a name in .gz for one stream; a link
in a view file system gives the file another name, and then its text reader, with the first bytes of a member as the end of a
line, deals the members out by byte ranges like lines of a plain file, from any file system. Tasks inflate their members. Lines that cross from one
byte range to the next are put together from the ranges' edges, of which there are two for each range.

An index has, for each member, the ranges of positions of the records that it holds a part of. A member is known by its checksum and
lengths; members that share these share their ranges, so the index never misses one. Records are told from the first two columns.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed value of the format: a member's first bytes.
MAGIC = b"\x1f\x8b\x08\x04"
PIECE = 1 << 20
MANY = 1_000_000
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _jpath(spark: SparkSession, path: str):
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jpath, jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def is_block_gzip(spark: SparkSession, path: str) -> bool:
    """Whether a path is one file that begins with such a member."""
    jpath, fs = _jpath(spark, path)
    if not fs.exists(jpath) or not fs.getFileStatus(jpath).isFile():
        return False
    stream = fs.open(jpath)
    try:
        first = bytes(x & 255 for x in (stream.read() for _ in range(14)) if x >= 0)
    finally:
        stream.close()
    return first[:4] == MAGIC and first[12:14] == b"BC"


def _members(spark: SparkSession, path: str) -> DataFrame:
    """(split, data): members without their first four bytes, in order within a split."""
    jpath, fs = _jpath(spark, path)
    name = f"blockgzip{uuid4().hex}"
    spark.sparkContext._jsc.hadoopConfiguration().set(f"fs.viewfs.mounttable.{name}.link./members", fs.resolvePath(jpath).toString())
    rows = spark.read.option("lineSep", MAGIC.decode("latin-1")).option("encoding", "ISO-8859-1").text(f"viewfs://{name}/members")
    return rows.select(F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("data"))


def _number(data: bytes, at: int, size: int) -> int:
    return int.from_bytes(data[at : at + size], "little")


def _size(data: bytes) -> int:
    """The bytes of a member without the first four, from its extra field; 0 if it has none."""
    at, end = 8, 8 + _number(data, 6, 2)
    while at + 4 <= end <= len(data):
        n = _number(data, at + 2, 2)
        if data[at : at + 2] == b"BC" and n == 2:
            return _number(data, at + 4, 2) + 1 - len(MAGIC)
        at += 4 + n
    return 0


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes | None]]:
    """(split, member); where the first bytes of a member came up inside of one, its parts are put together. None ends a split."""
    split, held = None, b""
    for b in batches:
        for at, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if at != split:
                if held:
                    raise ValueError("a member of a block-gzip file isn't whole; read it with splits of another size")
                if split is not None:
                    yield split, None
                split = at
            if not held and not data:
                continue  # before the first member
            held = held + MAGIC + data if held else data
            if len(held) >= (size := _size(held)):
                if not size or len(held) > size:
                    raise ValueError("this isn't a block-gzip file, or a member was cut; read it with splits of another size")
                yield split, held
                held = b""
    if held:
        raise ValueError("a member of a block-gzip file isn't whole")
    if split is not None:
        yield split, None


def _tail(member: bytes) -> tuple[int, int]:
    """Checksum and length of the text."""
    return _number(member, len(member) - 8, 4), _number(member, len(member) - 4, 4)


def _key(member: bytes) -> int:
    crc, size = _tail(member)
    return crc << 31 ^ size << 8 ^ len(member)


def _inflated(member: bytes) -> bytes:
    text = zlib.decompress(member[8 + _number(member, 6, 2) : -8], -15)
    crc, size = _tail(member)
    if zlib.crc32(text) != crc or len(text) != size:
        raise ValueError("a member of a block-gzip file is damaged")
    return text


def read_lines(spark: SparkSession, path: str, wanted: np.ndarray | None = None) -> DataFrame:
    """(value): the lines of a file in no set order. With wanted, the sorted keys of members, others aren't inflated, and lines that reach into them are left out."""
    shared = spark.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (split, part, text): part 0 is what comes before a split's first line end, 2 what is after its last one, 1 the lines between them. A null text is a gap."""
        keys = shared.value
        out: list[tuple] = []
        size = 0
        held, first = b"", True  # text since the last line end, whether none came yet
        lost = False  # whether the text up to the next line end belongs to a line that isn't wanted

        def flush() -> pa.RecordBatch:
            nonlocal size
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)], ["split", "part", "text"])
            out.clear()
            size = 0
            return batch

        for split, member in _whole(batches):
            if member is None:
                out.append((split, 0 if first else 2, None if lost else held))
                held, first, lost = b"", True, False
                continue
            if keys is not None:
                k = _key(member)
                at = int(np.searchsorted(keys, k))
                if at == len(keys) or keys[at] != k:
                    if first:
                        out.append((split, 0, None))
                        first = False
                    held, lost = b"", True
                    continue
            text = held + _inflated(member)
            if lost:
                cut = text.find(b"\n") + 1
                if not cut:
                    continue
                text, lost = text[cut:], False
            if first and (cut := text.find(b"\n") + 1):
                out.append((split, 0, text[:cut]))
                text, first = text[cut:], False
            end = 0 if first else text.rfind(b"\n") + 1
            if end:
                out.append((split, 1, text[:end]))
                size += end
            held = text[end:]
            if size >= PIECE:
                yield flush()
        if out:
            yield flush()

    # one pass over the file for the lines inside of splits, one for the edges, both lazy
    pieces = _members(spark, path).mapInArrow(run, "split bigint, part int, text binary")
    inside = pieces.filter("part = 1").select(F.explode(F.split(F.regexp_replace(F.col("text").cast("string"), "\n$", ""), "\n", -1)).alias("value"))
    edges = pieces.filter("part <> 1").select("split", "part", F.col("text").cast("string").alias("text"))
    order = Window.orderBy("split", "part")  # two rows for each split
    ends = F.col("text").isNull() | F.endswith("text", F.lit("\n"))
    edges = edges.withColumn("line", F.coalesce(F.sum(ends.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    parts = F.sort_array(F.collect_list(F.struct("split", "part", "text")))
    whole = edges.groupBy("line").agg(parts.alias("x"), F.max(F.col("text").isNull()).alias("gap")).filter(~F.col("gap"))
    across = whole.select(F.regexp_replace(F.array_join(F.transform("x", lambda p: p["text"]), ""), "\n$", "").alias("value"))
    return inside.unionByName(across).filter("value <> ''")


def index_members(spark: SparkSession, path: str) -> DataFrame:
    """(key, contig, lo, hi): the positions (from 0) of the records that have a part in a member; a null contig: not known, as at the edge of a split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held, known = b"", False
        for _, member in _whole(batches):
            if member is None:
                held, known = b"", False
                continue
            key, own = _key(member), {}
            lines = (held + _inflated(member)).split(b"\n")
            if not known:  # begins in the split before
                rows.append((key, None, None, None))
            for i, line in enumerate(lines):
                f = line.split(b"\t", 2)
                if line.startswith(b"#") or not line or (i == 0 and not known):
                    continue
                if len(f) < 3 or not f[1].isdigit():
                    rows.append((key, None, None, None))
                    continue
                lo, hi = own.get(f[0], (1 << 62, -1))
                own[f[0]] = (min(lo, int(f[1]) - 1), max(hi, int(f[1]) - 1))
            known = known or len(lines) > 1
            held = lines[-1]
            rows += [(key, c.decode(), lo, hi) for c, (lo, hi) in own.items()]
            if len(rows) > 10_000:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    found = _members(spark, path).mapInArrow(run, "key bigint, contig string, lo bigint, hi bigint")
    return found.groupBy("key", "contig").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["key", "contig", "lo", "hi"])


def members_of(index: DataFrame, region: tuple[str, int, int]) -> np.ndarray | None:
    """The sorted keys of the members that may hold records of a region; None, which means all, if they are more than MANY."""
    contig, start, end = region
    hit = F.col("contig").isNull() | ((F.col("contig") == contig) & (F.col("lo") < end) & (F.col("hi") >= start))
    keys = [r[0] for r in index.filter(hit).select("key").distinct().limit(MANY + 1).collect()]
    return None if len(keys) > MANY else np.sort(np.array(keys, np.int64))
