"""Divergence of sources, collocations and toxicity against brute force, and their edges."""

import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import regex

from varidia.llm import collocations as co
from varidia.llm import divergence as di
from varidia.llm import toxicity as tx
from varidia.llm._grams import Buckets, bitmap, hashes, is_set, reached, words

SCHEMA = "doc_id long, text string, lang string, source string, extra string"
RNG = np.random.default_rng(5)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def made(n=120, vocabulary=30):
    """Short texts of few words, with nulls, repeats, an empty source and one very long text."""
    names = [f"w{chr(97 + i % 26)}{'é' * (i // 26)}x" for i in range(vocabulary)]
    rows = []
    for i in range(n):
        k = int(RNG.integers(0, 25))
        picked = RNG.zipf(1.4, k) % vocabulary
        text = "".join(names[j].title() + RNG.choice([" ", "  ", ", ", ".\n", "-", "\t", " \r\n"]) for j in picked)
        rows.append((i, text, ["en", "de", None, ""][i % 4], ["a", "b", None, "c", "é"][i % 5], "x"))
    rows += [(n, None, "en", "a", None), (n + 1, "", "fr", "only", None), (n + 2, "12 34 _", "de", "bare", None), (n + 3, "Wax wax " * 9000, "en", "b", None), rows[4], rows[4]]
    return rows


def got(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def duck(sql, rows):
    con = duckdb.connect()
    table = pa.table(dict(zip(("doc_id", "text", "lang", "source", "extra"), map(list, zip(*rows, strict=True)), strict=True))) if rows else pa.table({c: pa.array([], pa.string()) for c in ("doc_id", "text", "lang", "source", "extra")})
    con.register("documents", table)
    r = con.execute(sql)
    names = [d[0] for d in r.description]
    return [dict(zip(names, x, strict=True)) for x in r.fetchall()]


def plain_divergence(rows, min_docs=3, top=200):
    docs, counts, groups = defaultdict(Counter), Counter(), set()
    for _, text, lang, source, *_ in rows:
        found = [t.translate(LOWER) for t in regex.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        docs[lang].update(set(found))
        counts.update((lang, source, t) for t in found)
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in docs[lang].items() if n >= min_docs)
        sources = sorted(s for g, s in groups if g == lang)
        shares = {}
        for s in [*sources, None]:
            n = [sum(counts[lang, x, t] for x in sources) if s is None else counts[lang, s, t] for t in kept]
            shares[s] = [1 + 1_000_000_000 * (c + 1) // (sum(n) + len(kept)) for c in n]
        for s in sources:
            pair = [(o, sum((p - q) ** 2 // q for p, q in zip(shares[s], shares[o], strict=True))) for o in sources if o != s]
            term = [(t, (p - q) ** 2 // q) for t, p, q in zip(kept, shares[s], shares[None], strict=True) if counts[lang, s, t] and p > q]
            for part, items in (("pair", pair), ("term", term)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, i + 1) for i, (item, v) in enumerate(items) if part == "pair" or i < top]
    return sorted(out)


COLUMNS = ("lang", "source", "part", "item", "value", "rank")


@pytest.mark.parametrize(("bits", "many"), [(24, 10_000), (4, 0)])
def test_divergence_equals_brute_force_also_with_a_full_sketch_and_shuffled_groups(spark, bits, many):
    rows = made()
    assert got(di.divergence(spark.createDataFrame(rows, SCHEMA).repartition(5), bits=bits, many=many), *COLUMNS) == plain_divergence(rows)
    assert got(di.divergence(spark.createDataFrame(rows, SCHEMA), min_docs=5, top=3), *COLUMNS) == plain_divergence(rows, 5, 3)


def test_divergence_sql_and_edges(spark):
    rows = made(60)
    assert sorted(tuple(r[c] for c in COLUMNS) for r in duck(di.OP11_SQL, rows)) == plain_divergence(rows)
    assert di.divergence(spark.createDataFrame([], SCHEMA)).count() == 0
    none = [(1, None, "x", "a", None), (2, "one two", "x", "b", None), (3, "", "x", None, None)]  # no kept term
    assert got(di.divergence(spark.createDataFrame(none, SCHEMA)), *COLUMNS) == plain_divergence(none)
    assert {r["value"] for r in di.divergence(spark.createDataFrame(none, SCHEMA)).collect()} == {0}


def test_shares_are_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    big = 40_000_000_000_000
    df = spark.createDataFrame([(big - 1, big, 7), (8_999_999_999, 9_000_000_000, 5), (0, 0, 3)], "c long, n long, v long")
    for r in df.select("*", di.share(F.col("c"), F.col("n"), F.col("v")).alias("p")).collect():
        assert r["p"] == 1 + 1_000_000_000 * (r["c"] + 1) // (r["n"] + r["v"])


def test_sketch_never_underestimates(spark):
    rows = made()
    bits = 8
    may = di.frequency_sketch(spark.createDataFrame(rows, SCHEMA).fillna("").repartition(7), bits=bits)
    docs = defaultdict(Counter)
    for _, text, lang, *_ in rows:
        docs[lang or ""].update({t.translate(LOWER) for t in regex.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")})
    for lang, c in docs.items():
        often = [t for t, n in c.items() if n >= 3]
        h = di._by_lang(hashes(pa.array([t.encode() for t in often], pa.large_binary())), hashes(pa.array([lang.encode()], pa.large_binary())).astype(np.int64))
        assert all(is_set(may, at).all() for at in di._places(h, bits))


def test_buckets_add_up_over_tasks(spark):
    size, cap = 1 << 17, 30
    at = [RNG.integers(0, size // k, 20_000 * k) for k in (1, 2, 400)]
    parts = []
    for x in at:
        b = Buckets(size, cap)
        for piece in np.array_split(x, 3):
            b.add(piece)
        parts += [tuple(r.values()) for batch in b.batches() for r in batch.to_pylist()]
    bits = reached(spark.createDataFrame(parts, "part int, places binary, counts binary"), size, cap)
    true = np.bincount(np.concatenate(at), minlength=size) >= cap
    assert true.any() and (np.unpackbits(bits)[:size] == true).all()
    h = [int(x) for x in RNG.integers(-(2**63), 2**63, 500)]
    on = bitmap(spark.createDataFrame([(x,) for x in h], "h long"), 20)
    assert set(np.flatnonzero(np.unpackbits(on))) == {(x % 2**64) >> 44 for x in h}


def test_words_keep_pieces_and_texts_apart():
    texts = ["Ab, cd\tef", "", "x.y", "é É"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offs = np.cumsum([0, *(len(t.encode()) for t in texts)])
    spelled, code, text, piece = words(data, offs, co._MARKS)
    assert [(spelled[c].as_py().decode(), int(t)) for c, t in zip(code.tolist(), text, strict=True)] == [("ab", 0), ("cd", 0), ("ef", 0), ("x", 2), ("y", 2), ("é", 3), ("É", 3)]
    assert [int(b) == int(a) for a, b in zip(piece[:-1], piece[1:], strict=True)] == [False, True, False, False, False, True]


def plain_collocations(rows, min_count=30, share=80, top=2000):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        for piece in regex.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = regex.findall(r"[^\x20\x09]+", piece)
            lang = "und" if lang is None else lang
            n[lang] += len(w)
            f[lang].update(tuple(w[i : i + k]) for k in (1, 2, 3, 4) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= min_count}
        kept = []
        for p, a in cand.items():
            if any(100 * b >= share * a for q, b in cand.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))):
                continue
            s, _, l, r = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            kept.append((-s, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(kept)[:top])]
    return sorted(out)


PHRASES = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@pytest.mark.parametrize(("min_count", "bits", "top"), [(3, 25, 2000), (2, 3, 7), (30, 20, 2000)])
def test_collocations_equal_brute_force_also_with_full_buckets(spark, min_count, bits, top):
    rows = made(200, 12)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = plain_collocations(rows, min_count, top=top)
    assert want and got(co.collocations(df, min_count, top=top, bits=bits), *PHRASES) == want


def test_collocations_sql_and_edges(spark):
    rows = made(400, 8)
    assert sorted(tuple(r[c] for c in PHRASES) for r in duck(co.OP12_SQL, rows)) == plain_collocations(rows)
    assert co.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert co.collocations(spark.createDataFrame([(1, None, None, None, None), (2, "a b", None, None, None)], SCHEMA)).count() == 0
    marks = [(1, "a b\x0bb a " * 40, None, None, None)]  # pieces end at all of the marks
    assert got(co.collocations(spark.createDataFrame(marks, SCHEMA)), *PHRASES) == plain_collocations(marks)


def toxic_table(n=900):
    neutral = [f"n{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        w = list(RNG.choice(neutral, RNG.integers(5, 60)))
        toxic = i % 10 == 0
        if toxic:
            for bad in RNG.choice(["scorn", "vitriol", "spite"], 2):
                w.insert(int(RNG.integers(0, len(w))), str(bad))
        rows.append((i, " ".join(w), "en", "s", "x"))
        if i % 3:
            labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity_learns_from_confirmed_and_unlabelled_texts(spark):
    rows, labels = toxic_table()
    docs = spark.createDataFrame(rows, SCHEMA)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = tx.train_toxicity(docs, marks)
    out = {r["doc_id"]: r for r in tx.score_toxicity(docs.withColumnRenamed("extra", "score"), model).collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 3 == 1]
    right = [out[i]["predicted"] == int(i % 10 == 0) for i in held]
    assert np.mean(right) > 0.98 and all(0 <= r["score"] <= 1 for r in out.values())
    # labels of the held-out fold, and of harmless documents, change nothing but the prior
    flipped = [(i, q, 1 - t if i in set(held) else t) for i, q, t in labels]
    again = tx.train_toxicity(docs, spark.createDataFrame(flipped, "doc_id long, quality int, toxic int"))
    assert np.array_equal(model.weights, again.weights) and model.bias == again.bias
    assert np.array_equal(model.weights, tx.train_toxicity(docs, marks.filter("toxic = 1"), prior=float(np.mean([t for i, _, t in labels if i not in set(held)]))).weights)


def test_toxicity_scores_equal_plain_sums_and_edges(spark):
    model = tx.ToxicityModel(*(lambda h: (np.sort(h), np.array([1.5, -2.0])[np.argsort(h)]))(hashes(pa.array([b"bad", b"good"], pa.large_binary())).astype(np.int64)), -0.5)
    docs = spark.createDataFrame([(1, "Bad, bad good"), (2, None), (3, ""), (4, "bad " * 200_000), (4, "BAD")], "doc_id long, text string")
    got_ = sorted((r["doc_id"], round(r["score"], 9)) for r in tx.score_toxicity(docs, model).collect())
    s = lambda z: round(1 / (1 + np.exp(-z)), 9)
    assert got_ == [(1, s(-1)), (2, s(-0.5)), (3, s(-0.5)), (4, s(1)), (4, s(1))]
    empty = docs.limit(0)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert tx.score_toxicity(empty, tx.train_toxicity(empty, none)).count() == 0
    assert {r["predicted"] for r in tx.score_toxicity(docs, tx.train_toxicity(docs, none)).collect()} == {0}
    odd = spark.createDataFrame([(None, 1, 1), (1, 1, None), (3, 1, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    assert tx.score_toxicity(docs, tx.train_toxicity(docs, odd)).count() == 5


def test_risk_corrects_by_the_prior_and_its_steps_follow_the_gradient():
    rng = np.random.default_rng(1)
    prior, n = 0.3, 200_000
    pos, neg = rng.normal(1, 1, n), rng.normal(-1, 1, n)
    mixed = np.where(rng.random(n) < prior, rng.normal(1, 1, n), rng.normal(-1, 1, n))
    _, harmless = tx.risk(pos, mixed, prior)
    assert abs(harmless - (1 - prior) * np.logaddexp(0, neg).mean()) < 0.01
    toxic = [np.array([1, 2]), np.array([1]), np.array([2, 3])] * 30
    unlabelled = [np.array([3]), np.array([4]), np.array([4, 3]), np.array([1, 3])] * 30
    model = tx.nnpu(toxic, unlabelled, 0.25, steps=3000, sigma=0, factor=1, seen=1)

    def at(words_, w, b):
        z = lambda rows: np.array([sum(w[np.searchsorted(words_, x)] for x in r if x in words_) + b for r in rows])
        one, two = tx.risk(z(toxic), z(unlabelled), 0.25)
        return one + max(0, two)

    best = at(model.words, model.weights, model.bias)
    assert best <= at(model.words, np.zeros(len(model.words)), float(np.log(0.25 / 0.75)))
    plus = [w for h, w in zip(model.words, model.weights, strict=True) if h in (1, 2)]
    assert min(plus) > 0 > dict(zip(model.words.tolist(), model.weights, strict=True))[4]
