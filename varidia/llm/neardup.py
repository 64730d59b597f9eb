"""Near-duplicate classes by order MinHash, with candidates verified by banded alignment.

Words are runs of non-space bytes in lower case; a text's k-mers are its runs of GRAM words (all of its words,
if fewer), each labelled with how often it occurred before. Each of SAMPLES hash functions takes the KEEP least
labelled k-mers and keeps them in text order; a hash of that row is a key. Texts that share a key are
candidates. Two texts are linked if their word edit distance is at most a fifth of the longer one's words, an edit
similarity of 0.8; the alignment alone decides. So texts with moved blocks aren't linked, and equal ones but for case and
white space are. Classes are the connected components of links.

Candidates: texts of MIDDLE words or fewer have twice the samples. Pairs of texts of SHORT words or fewer are found
exactly: of two texts within d edits, the longer one of L words, one run of (L - d) / (d + 1) words is in both, so
all runs of that many words are keys. Other pairs at a similarity of 0.85 share a key with probability 0.99, at 0.8 with
0.93 or so (independent substitutions; the README has measured figures).

Equal texts are one node. In each bucket (texts with one key), all are compared with its leader, the text that
shares most keys with others; so a group of near copies, however large, costs a comparison a text. Buckets whose
texts are then in one component are done. Of the others, one of LOCAL texts and LOCAL_WORDS words or fewer goes to one task,
which counts the labelled words and word pairs that texts have in common: two texts within d edits, the longer of L words,
have L - d and L - 1 - 2 d at least. A larger bucket is dealt out anew by those word pairs: with all pairs ordered from rare to
frequent, two such texts share one of their first ones, and texts that have but a frequent passage in common part.
Where that saves nothing, as the texts have most in common, and what is larger still is compared block by block, in as
many tasks, without loss. So nothing is capped. The driver sees only counts.

An alignment keeps a band of bits around the diagonal that widens up to the limit: its time is words times band
over 64, its memory some 100 bytes a word and, for the 4096 most frequent words at most, a bit for each place.

Null text counts as empty. Texts without words are only linked if equal. A null doc_id is allowed: it is the
class id only of a class without others. Rows that repeat share a class. Other columns pass; one named like an
output is replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._bytes import blocks, mix, token_hashes
from ._shared import removed, written

GRAM = 2
KEEP = 3
SAMPLES = 24
MIDDLE = 64  # texts of so many words or fewer have twice the samples
SHORT = 24  # pairs of texts of so many words or fewer are found by runs
SIMILARITY = 0.8
LOCAL = 2048  # texts of a bucket that one task compares with one another
LOCAL_WORDS = 2_000_000  # and their words

_COMBINE = np.array([pow(0xD6E8FEB86659FD93, j + 1, 1 << 64) for j in range(16)], np.uint64)


def shingles(words: np.ndarray, bounds: np.ndarray, k: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' k-word runs in order, and bounds; a shorter text has one of all its words."""
    n = np.diff(bounds)
    count = np.where(n > 0, np.maximum(n - k + 1, 1), 0)
    out = np.concatenate(([0], np.cumsum(count)))
    owner = np.repeat(np.arange(len(n)), count)
    at = np.arange(len(owner)) - out[owner] + bounds[owner]
    end = bounds[owner + 1]
    w = np.append(words, np.zeros(k, np.uint64))
    h = np.zeros(len(at), np.uint64)
    for j in range(k):
        here = w[np.minimum(at + j, len(w) - 1)]
        h += np.where(at + j < end, here, np.uint64(0)) * _COMBINE[j]
    return mix(h), out


def occurrences(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How often each hash occurred before in its text."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.argsort(h, kind="stable")
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    start = np.flatnonzero(new)
    rank = np.arange(len(h)) - np.repeat(start, np.diff(np.append(start, len(h))))
    out = np.empty(len(h), np.int64)
    out[order] = rank
    return out


def _sampled(h: np.ndarray, label: np.ndarray, cuts: np.ndarray, rounds: range, keep: int) -> np.ndarray:
    """The keys of texts, each with a k-mer at least, by some of the hash functions; a row each.

    A hash function multiplies the labels, which are random numbers, by an odd one. Of each text, only k-mers below
    a bound that some 4 * keep of them meet are sorted; where it happens to leave too few, all of them.
    """
    count = np.diff(cuts)
    n = len(count)
    owner = np.repeat(np.arange(n), count)
    bound = np.where(count > 4 * keep, np.ldexp(np.minimum(1.0, 4 * keep / count), 63), 2.0**63).astype(np.uint64) * np.uint64(2) - np.uint64(1)
    each = np.repeat(bound, count)
    least = np.minimum(count, keep)
    out = np.empty((n, len(rounds)), np.uint64)
    for column, r in enumerate(rounds):
        y = label * (mix(np.array([r + 1], np.uint64)) | np.uint64(1))
        hit = np.flatnonzero(y <= each)
        few = np.bincount(owner[hit], minlength=n) < least
        if few.any():
            hit = np.flatnonzero((y <= each) | few[owner])
        order = np.lexsort((y[hit], owner[hit]))
        hit = hit[order]
        text = owner[hit]
        first = np.searchsorted(text, np.arange(n))
        picked = np.sort(hit[np.arange(len(hit)) - first[text] < keep])  # in text order
        place = np.arange(len(picked)) - np.repeat(np.cumsum(least) - least, least)
        parts = np.zeros((n, keep), np.uint64)
        parts[owner[picked], place] = h[picked]
        key = np.full(n, np.uint64(r + 1))
        for j in range(keep):
            key = mix(key * np.uint64(0xE7037ED1A0B428DB) + parts[:, j])
        out[:, column] = key
    return out


def _some(words: np.ndarray, bounds: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and bounds of some of the texts."""
    n = np.diff(bounds)[texts]
    cuts = np.concatenate(([0], np.cumsum(n)))
    return words[np.arange(cuts[-1]) - np.repeat(cuts[:-1] - bounds[:-1][texts], n)], cuts


def most_edits(n: int | np.ndarray, similarity: float = SIMILARITY):
    """The edits that texts may be apart, the longer one of n words."""
    return ((1 - similarity) * n + 1e-9) // 1


def run_keys(words: np.ndarray, bounds: np.ndarray, similarity: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """(text, key) of short texts: for each length of the longer text of a pair, the runs of which one must be in both."""
    n = np.diff(bounds)
    owners, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for longer in range(1, SHORT + 1):
        d = int(most_edits(longer, similarity))
        texts = np.flatnonzero((n <= longer) & (n >= max(1, longer - d)))
        if len(texts):
            h, cuts = shingles(*_some(words, bounds, texts), -(-(longer - d) // (d + 1)))
            owners.append(np.repeat(texts, np.diff(cuts)))
            keys.append(mix(h + np.uint64(longer * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)))
    return np.concatenate(owners), np.concatenate(keys)


def sketch_keys(words: np.ndarray, bounds: np.ndarray, samples: int = SAMPLES, keep: int = KEEP) -> tuple[np.ndarray, np.ndarray]:
    """(text, key) of all texts, in the order of the texts; a key may occur twice in one."""
    n = np.diff(bounds)
    owners, keys = ([x] for x in run_keys(words, bounds))
    sampled = int(SHORT * SIMILARITY) < n  # others can only meet texts of SHORT words or fewer
    for which, rounds in ((sampled, range(samples)), (sampled & (n <= MIDDLE), range(samples, 2 * samples))):
        texts = np.flatnonzero(which)
        if len(texts):
            h, cuts = shingles(*_some(words, bounds, texts))
            label = mix(h + occurrences(h, cuts).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
            owners.append(np.repeat(texts, len(rounds)))
            keys.append(_sampled(h, label, cuts, rounds, keep).ravel())
    owner, key = np.concatenate(owners), np.concatenate(keys)
    order = np.argsort(owner, kind="stable")
    return owner[order], key[order]


def grams(w: np.ndarray, k: int = GRAM) -> np.ndarray:
    """Distinct numbers of a text's labelled word pairs (or words, with k of 1), sorted."""
    h, cuts = shingles(w.astype(np.uint64), np.array([0, len(w)]), k)
    out = mix(h + occurrences(h, cuts).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    out.sort()
    return out


def least_common(n, similarity: float = SIMILARITY, k: int = GRAM):
    """The labelled runs of k words that texts within the limit have in common at least, the longer one of n words."""
    return np.maximum(1, n - (k - 1) - k * most_edits(n, similarity))


def banded_distance(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """The edit distance of two rows of words if it is ``most`` or less."""
    n = min(len(a), len(b))
    same = a[:n] == b[:n]
    head = n if same.all() else int(same.argmin())
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    if n:
        same = a[::-1][:n] == b[::-1][:n]
        tail = n if same.all() else int(same.argmin())
        a, b = a[: len(a) - tail], b[: len(b) - tail]
    if abs(len(a) - len(b)) > most:
        return None
    if not len(a) or not len(b):
        return max(len(a), len(b))
    where: dict[int, list[int]] = {}
    for i, w in enumerate(a.tolist()):
        where.setdefault(w, []).append(i)
    many = max(8, len(a) >> 12)
    bits = {w: sum_of_bits(at) for w, at in where.items() if len(at) > many}
    band = min(most, max(31, abs(len(a) - len(b))))
    while True:
        d = _band(where, bits, b.tolist(), len(a), band)
        if d is not None or band >= most:
            return d
        band = min(most, 4 * band)


def sum_of_bits(places: list[int]) -> int:
    out = np.zeros(places[-1] + 1, np.uint8)
    out[places] = 1
    return int.from_bytes(np.packbits(out, bitorder="little").tobytes(), "little")


def _band(where: dict[int, list[int]], bits: dict[int, int], b: list[int], n: int, band: int) -> int | None:
    """The distance if it is ``band`` or less, by cells at most ``band`` from the diagonal.

    Bit t stands for row j - band + t of column j, so the window moves down a row with each column. plus and minus
    hold where a cell is one more or one less than the one above; level, where it equals its upper left neighbour.
    The last cell is on the diagonal of one bit, along which values never fall. Rows above the first hold the column's number.
    """
    mask = (1 << 2 * band + 1) - 1
    plus, minus = mask >> band << band, 0
    goal = 1 << n - len(b) + band
    score = max(n - len(b), 0)
    for j, word in enumerate(b):
        shift = j - band
        at = where.get(word)
        if at is None:
            equal = 0
        elif word in bits:
            equal = (bits[word] >> shift if shift > 0 else bits[word] << -shift) & mask
        else:
            equal = 0
            for i in at:
                if 0 <= i - shift <= 2 * band:
                    equal |= 1 << i - shift
        level = (((equal & plus) + plus ^ plus) | equal | minus) & mask
        if not level & goal:
            score += 1
            if score > band:
                return None
        right_more = minus | mask ^ (level | plus)
        right_less = level & plus
        level >>= 1
        plus = right_less | mask ^ (level | right_more)
        minus = level & right_more
    return score


def linked(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether two rows of word hashes are near duplicates."""
    n = max(len(a), len(b))
    most = int(most_edits(n, similarity))
    if abs(len(a) - len(b)) > most:
        return False
    for k in (1, GRAM):
        both = np.concatenate((grams(a, k), grams(b, k)))
        both.sort()
        if np.count_nonzero(both[1:] == both[:-1]) < least_common(n, similarity, k):
            return False
    return banded_distance(a, b, most) is not None


def node_of(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


@F.arrow_udf(T.StructType([T.StructField("words", T.IntegerType()), T.StructField("keys", T.ArrayType(T.LongType()))]))
def _keys(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Each text's number of words and distinct keys."""
    for arr in parts:
        counts, lists = [np.zeros(0, np.int64)], []
        for lo, hi, data, offs in blocks(arr, 1 << 20):
            words, bounds = token_hashes(data, offs)
            owner, key = sketch_keys(words, bounds)
            at = np.searchsorted(owner, np.arange(hi - lo + 1))
            counts.append(np.diff(bounds))
            lists += [np.unique(key[x:y]).view(np.int64) for x, y in zip(at[:-1], at[1:], strict=True)]
        yield pa.StructArray.from_arrays([pa.array(np.concatenate(counts), pa.int32()), pa.array(lists, pa.list_(pa.int64()))], ["words", "keys"])


@F.arrow_udf(T.BinaryType())
def _packed(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Four bytes of each word's hash."""
    for arr in parts:
        out = []
        for _, _, data, offs in blocks(arr):
            words, bounds = token_hashes(data, offs)
            short = (words >> np.uint64(32)).astype("<u4")
            out += [short[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        yield pa.array(out, pa.binary())


@F.arrow_udf(T.BooleanType())
def _linked(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for one, two in parts:
        yield pa.array([linked(np.frombuffer(a.as_py(), "<u4"), np.frombuffer(b.as_py(), "<u4")) for a, b in zip(one, two, strict=True)], pa.bool_())


def components(links: DataFrame) -> tuple[DataFrame, str]:
    """node and root (the least node) of each connected component of links (a, b), by alternating stars, as a written table; and its path."""
    spark = links.sparkSession
    edges, path = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges")
    while True:
        # done if no root has a root of its own and no node has two
        open_ = edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").select("v").unionByName(edges.groupBy("u").count().filter("count > 1").select(F.col("u").alias("v")))
        if open_.isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")), path
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        ends = F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        small = large.join(down, "u").select(F.explode(ends).alias("e")).select("e.*").filter("u != v").distinct()
        last = path
        edges, path = written(small, "edges")
        removed(spark, last)


def common_grams(words: list[np.ndarray], k: int) -> np.ndarray:
    """How many labelled runs of k words each two texts have in common."""
    sets = [grams(w, k) for w in words]
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    value, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[column] > 1
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    common = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total, width = int(column[-1]) + 1 if len(column) else 0, max(1, (1 << 22) // len(sets))
    for lo in range(0, total, width):
        a, b = np.searchsorted(column, (lo, lo + width))
        part = np.zeros((len(sets), min(width, total - lo)), np.float32)
        part[owner[a:b], column[a:b] - lo] = 1
        common += part @ part.T
    return common


def bucket_links(words: list[np.ndarray], joined: list[int], similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Links that join all of a small bucket's texts that links join; common words and word pairs, counted for all at once, rule out most others.

    Texts with one number in ``joined`` are joined already.
    """
    n = np.array([len(w) for w in words])
    longer = np.maximum(n[:, None], n[None])
    near = np.abs(n[:, None] - n[None]) <= most_edits(longer, similarity)
    for k in (1, GRAM):
        near &= common_grams(words, k) >= least_common(longer, similarity, k) - 0.5
    label = np.array(joined)
    out = []
    for i in range(len(words)):
        open_ = near[i] & (label != label[i])
        open_[: i + 1] = False
        while open_.any():
            j = int(open_.argmax())
            open_[j] = False
            if banded_distance(words[i], words[j], int(most_edits(longer[i, j], similarity))) is not None:
                label[label == label[j]] = label[i]
                open_ &= label != label[i]
                out.append((i, j))
    return out


def _solve(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.drop_duplicates("node").sort_values("node")
    nodes = list(pdf["node"])
    found = bucket_links([np.frombuffer(w, "<u4") for w in pdf["w"]], pdf["root"].factorize()[0].tolist())
    return pd.DataFrame({"a": [nodes[i] for i, _ in found], "b": [nodes[j] for _, j in found]})


def _gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, node, words, first, gram) from (key, node, words, w): all labelled word pairs, and of how many the rarest ones must meet."""
    for batch in batches:
        for k in range(len(batch)):
            one = batch.slice(k, 1)
            w = np.frombuffer(one.column(3)[0].as_py(), "<u4")
            g = grams(w)
            first = len(g) - int(least_common(np.arange(len(w), len(w) / SIMILARITY + 1)).min()) + 1
            again = pa.array(np.zeros(len(g), np.int32))
            yield pa.RecordBatch.from_arrays([*(one.column(i).take(again) for i in range(3)), pa.array(np.full(len(g), first, np.int32)), pa.array(g.view(np.int64))], ["key", "node", "words", "first", "gram"])


def _by_rare_pairs(rows: DataFrame, words: DataFrame) -> tuple[DataFrame, str]:
    """Buckets dealt out by their texts' rarest labelled word pairs, of which texts that are to be linked share one: (was, key, node, words) and the table's path.

    A bucket of n texts whose parts hold n * n pairs or more, so that dealing it out saves nothing, isn't in the table.
    """
    each = rows.select("key", "node", "words").join(words, "node").select("key", "node", "words", "w").mapInArrow(_gram_rows, "key bigint, node binary, words int, first int, gram bigint")
    often = each.groupBy("key", "gram").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("key", "node").orderBy("n", "gram"))
    some = each.join(often, ["key", "gram"]).withColumn("place", place).filter("place <= first and n > 1")
    parts = some.groupBy("key", "gram").agg(F.count("*").cast("double").alias("m")).groupBy("key").agg(F.sum(F.col("m") * F.col("m")).alias("cost"))
    worth = parts.join(rows.select("key", "n").distinct(), "key").filter(F.col("cost") < F.col("n").cast("double") * F.col("n")).select("key")
    return written(some.join(worth, "key").select(F.col("key").alias("was"), F.xxhash64("key", "gram").alias("key"), "node", "words").distinct(), "dealt")


def _by_blocks(rows: DataFrame) -> DataFrame:
    """Each bucket as blocks of half of LOCAL, and a key for each pair of blocks."""
    blocks_ = F.ceil(F.greatest(2 * F.col("n") / LOCAL, 2 * F.col("total") / LOCAL_WORDS)).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks_).cast("int")
    rows = rows.select("node", "words", "key", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks_ - 1)).alias("with"))
    return rows.select("node", "words", F.xxhash64("key", F.least("own", "with"), F.greatest("own", "with")).alias("key"))


def _undecided(rows: DataFrame, roots: DataFrame, least: int) -> tuple[DataFrame, str]:
    """Of rows (key, node, words): those of keys of ``least`` nodes or more, in several components, with root and the key's texts and words; and the table's path.

    Of keys with the same nodes one stays, by 128 bits of the nodes' hashes.
    """
    rows = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    seen = rows.groupBy("key").agg(
        F.min("root").alias("r1"), F.max("root").alias("r2"), F.count("*").alias("n"), F.sum("words").alias("total"),
        F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit("again"), "node")).alias("y"),
    ).filter((F.col("r1") != F.col("r2")) & (F.col("n") >= least))
    seen = seen.groupBy("n", "x", "y").agg(F.min("key").alias("key"), F.first("total").alias("total"))
    return written(rows.join(seen.select("key", "n", "total"), "key"), "open")


def _fits() -> Column:
    return (F.col("n") <= LOCAL) & (F.col("total") <= LOCAL_WORDS)


def _links(docs: DataFrame, nodes: DataFrame) -> tuple[DataFrame, str]:
    """Verified links (a, b) between nodes as a written table, and its path; docs has doc_id, text and node, nodes has node, rep, words and keys."""
    spark = docs.sparkSession
    temporary = []

    def keep(table: tuple[DataFrame, str]) -> DataFrame:
        temporary.append(table[1])
        return table[0]

    keys = nodes.select("node", "words", F.explode("keys").alias("key")).repartition("key")
    rows = keep(written(keys.join(keys.groupBy("key").agg(F.count("*").alias("n"), F.max("words").alias("most"), F.max("node").alias("any")).filter("n > 1 and most >= 0 and any is not null").select("key", "n"), "key"), "keys"))
    wanted = rows.select("node").distinct().join(nodes.select("node", "rep"), "node")
    seqs = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["rep"]) & (docs["node"] == wanted["node"]), "left_semi")
    words = keep(written(seqs.select("node", _packed("text").alias("w")), "words"))
    # the text that shares most keys with others leads each of its buckets
    score = rows.groupBy("node").agg(F.sum("n").alias("score"))
    leader = rows.select("key", "node").join(score, "node").groupBy("key").agg(F.max(F.struct("score", "node")).alias("m")).select("key", F.col("m.node").alias("leader"))
    pairs = rows.join(leader, "key").filter("node != leader").select(F.least("node", "leader").alias("node"), F.greatest("node", "leader").alias("leader")).distinct()
    one, two = words.withColumnRenamed("w", "wa"), words.select(F.col("node").alias("leader"), F.col("w").alias("wb"))
    found = keep(written(pairs.join(one, "node").join(two, "leader").filter(_linked("wa", "wb")).select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct(), "links"))
    roots = keep(components(found))
    large = keep(_undecided(rows.select("key", "node", "words"), roots, 3))  # of two, the leader was compared with the other
    small = large.filter(_fits())
    large = large.filter(~_fits())
    if not large.isEmpty():
        dealt = keep(_by_rare_pairs(large, words))
        parts = keep(_undecided(dealt.select("key", "node", "words"), roots, 2))
        whole = large.join(dealt.select(F.col("was").alias("key")).distinct(), "key", "left_anti").unionByName(parts.filter(~_fits()))
        small = small.unionByName(parts.filter(_fits())).unionByName(keep(_undecided(_by_blocks(whole), roots, 2)))
    local = small.select("key", "node", "root").join(words, "node").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key").groupBy("key").applyInPandas(_solve, "a binary, b binary")
    out = written(found.unionByName(local).distinct(), "links")
    for path in temporary:
        removed(spark, path)
    return out


def near_classes(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """doc_id, node, class_id, class_node: a row for each row of docs; and the paths of the tables that it reads."""
    spark = docs.sparkSession
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("node", node_of(F.col("text")))
    table, path = written(keyed.select("doc_id", "node", _keys("text").alias("s")).select("doc_id", "node", "s.words", "s.keys"), "sketches")
    nodes = table.groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("words").alias("words"), F.first("keys").alias("keys"))
    links, link_path = _links(keyed, nodes)
    roots, root_path = components(links)
    removed(spark, link_path)
    named = table.groupBy("node").agg(F.min("doc_id").alias("rep")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min(F.struct(F.col("rep").isNull(), F.col("rep"), F.col("node"))).alias("m"))
    named = named.join(least, "root").select("node", F.col("m.rep").alias("class_id"), F.col("m.node").alias("class_node"))
    return table.select("doc_id", "node").join(named, "node"), [path, root_path]


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs without all but one row (that of the least doc_id) of each class of near duplicates."""
    classes, paths = near_classes(docs.select("doc_id", "text"))
    stay = classes.filter((F.col("node") == F.col("class_node")) & F.col("doc_id").eqNullSafe(F.col("class_id")))
    stay, _ = written(stay.groupBy("node").agg(F.first("doc_id").alias("__id"), F.count("*").alias("n")), "stay")
    for path in paths:
        removed(docs.sparkSession, path)
    rows = docs.withColumn("__node", node_of(F.col("text")))
    on = rows["doc_id"].eqNullSafe(stay["__id"]) & (rows["__node"] == stay["node"])
    kept = rows.join(stay, on, "left_semi")
    if not stay.filter("n > 1").isEmpty():  # rows that repeat: one of them stays
        kept = kept.dropDuplicates(["__node"])
    return kept.drop("__node")


def op7_neardup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_classes(docs)[0].select("doc_id", "class_id")
