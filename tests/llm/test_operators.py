"""Each operator against brute force or a round trip, and on nulls, empty and repeated rows, ties, empty tables and clashing columns."""

import hashlib
import html
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql.classic.dataframe import DataFrame
from pyspark.sql import functions as F

from varidia.llm import audio, chat, htmltext, langid, lmscore, mixing, neardup, packing, phrases, quality, queries

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "x y", "en", None, 3), (3, "x y", "de", "a", 3), (3, "x y", "de", "a", 3), (4, " \t\n", "en", "b", 3), (5, "ééé öö " * 3000, "fr", "b", 9), (6, "...", "en", "b", 3)]


@pytest.fixture(scope="module")
def odd(spark):
    clash = ("score", "size", "copies", "lang_pred", "node", "key", "predicted", "audio", "fingerprint", "target", "rate", "word")
    df = spark.createDataFrame(ODD, DOC)
    return df.withColumns({c: F.lit("mine") for c in clash})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def docs_of(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# 1


def test_packing_finds_the_tightest_compatible_bin():
    rng = random.Random(3)
    for _ in range(40):
        n, cap = rng.randrange(1, 60), 100
        sizes = [rng.randrange(0, 101) for _ in range(n)]
        src, dup = [rng.randrange(6) for _ in range(n)], [rng.randrange(20) for _ in range(n)]
        most = rng.choice((1, 1, 2, 3))
        got = packing.best_fit(sizes, src, dup, cap, most)
        room, content, want = [], [], [0] * n
        for k in sorted(range(n), key=lambda k: (-sizes[k], k)):
            fits = [b for b in range(len(room)) if room[b] >= sizes[k] and sum(src[o] == src[k] for o in content[b]) < most and all(dup[o] != dup[k] for o in content[b])]
            b = min(fits, key=lambda b: (room[b], b), default=None)
            if b is None:
                b = len(room)
                room.append(cap)
                content.append([])
            room[b] -= sizes[k]
            content[b].append(k)
            want[k] = b
        assert got == want


def test_packing_keeps_all_words(spark, odd, none):
    d = docs_of(spark)
    rows = packing.pack(d, capacity=300, shard_rows=50).toPandas()
    words = {r["doc_id"]: r["n"] for r in d.select("doc_id", mixing.word_count(F.col("text")).alias("n")).collect()}
    assert rows.groupby("doc_id")["words"].sum().to_dict() == words
    assert (rows.groupby("bin_id")["words"].sum() <= 300).all()
    packed = rows[rows["words"] < 300]
    assert not packed.duplicated(["bin_id", "source"]).any()
    order = ["bin_id", "doc_id", "piece"]
    again = packing.pack(d.repartition(3), capacity=300, shard_rows=50).toPandas()
    assert again.sort_values(order).reset_index(drop=True).equals(rows.sort_values(order).reset_index(drop=True))
    assert packing.pack(none).count() == 0
    got = packing.pack(odd).toPandas()
    assert len(got) == 10 and got[got["doc_id"] == 3]["bin_id"].nunique() == 2  # one text of 6000 words has three pieces


def test_packing_query_equals_plain_placement(spark, monkeypatch):
    """The bins of one shard by a search over all bins; and copies dealt out in chunks."""
    monkeypatch.setattr(packing, "CHUNK", 3)
    docs = docs_of(spark).select("doc_id", "text", "source").unionByName(spark.createDataFrame([(5000, "one text of many copies", "s")] * 11, "doc_id long, text string, source string"))
    rows = packing.pack(docs, capacity=300, shard_rows=10**6).toPandas()
    assert (rows["doc_id"] == 5000).sum() == 11 and rows[rows["doc_id"] == 5000]["bin_id"].nunique() == 11
    same = {r["doc_id"]: (r["source"], re.sub(r"[ \t-\r]+", " ", r["text"].lower()).strip()) for r in docs.collect()}
    bins = []  # room, sources, texts: the pieces in the order of size; of equal sizes the operator's own order
    order = rows[(rows["words"] < 300) | (rows["bin_pieces"] > 1)].sort_values("words", ascending=False, kind="stable")
    placed = {}
    for r in order.itertuples():
        source, text = same[r.doc_id]
        fits = [b for b in placed.values() if b[0] >= r.words and source not in b[1] and text not in b[2]]
        mine = placed.get(r.bin_id)
        if mine is None:
            bins.append(r.bin_id)
            mine = placed[r.bin_id] = [300, set(), set()]
        mine[0] -= r.words
        assert mine[0] >= 0 and source not in mine[1] and text not in mine[2]
        mine[1].add(source)
        mine[2].add(text)
    assert len(bins) == order["bin_id"].nunique()


# 2


def test_audio_round_trip_and_tables(spark, odd, none):
    for r in audio.text_audio(docs_of(spark).select("doc_id", "text")).collect():
        raw = r["text"].encode()
        pay = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        a = r["audio"]
        assert (a["n_bytes"], a["payload_bytes"], a["payload_sha256"], a["tail_crc32"]) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-64:]))
    got = audio.text_audio(odd).collect()
    assert len(got) == len(ODD) and {r["audio"]["payload_bytes"] for r in got if r["doc_id"] in (1, 2)} == {64}
    assert audio.text_audio(none).count() == 0
    for law in (audio.MULAW, audio.ALAW):
        table = audio.TABLES[law].astype(int)
        assert (table[audio.compand(table, law)] == table).all()
    assert audio.TABLES[audio.MULAW][[0, 0x80, 0xFF, 0x7F]].tolist() == [-32124, 32124, 0, 0]
    assert audio.TABLES[audio.ALAW][[0xD5, 0x55, 0xAA, 0x2A]].tolist() == [8, -8, 32256, -32256]


def test_adpcm_blocks_equal_a_plain_decoder():
    rng = np.random.default_rng(1)
    coded = rng.integers(0, 256, (7, 68)).astype(np.uint8)
    coded[:, 2] %= 89
    want = []
    for block in coded.tolist():
        value = int.from_bytes(bytes(block[:2]), "little", signed=True)
        index, out = block[2], [value]
        for byte in block[4:]:
            for code in (byte & 15, byte >> 4):
                step = int(audio.STEPS[index])
                diff = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
                value = max(-32768, min(32767, value - diff if code & 8 else value + diff))
                index = max(0, min(88, index + int(audio.INDEX_STEP[code])))
                out.append(value)
        want.append(out)
    assert audio.adpcm_blocks(coded).tolist() == want


def test_audio_files_and_features_equal_plain_ones(spark, odd):
    def plain(data, fmt):
        if fmt == audio.MULAW:
            out = []
            for byte in data:
                code = byte ^ 0xFF
                size = (((code & 15) * 8 + 132) * 2 ** ((code >> 4) & 7)) - 132
                out.append(-size if code & 128 else size)
            return out
        out = []
        for byte in data:
            code = byte ^ 0x55
            e, size = code >> 4 & 7, (code & 15) * 16 + 8
            size = size if e == 0 else (size + 256) * 2 ** (e - 1)
            out.append(size if code & 128 else -size)
        return out

    for fmt in (audio.MULAW, audio.ALAW):
        assert audio.decode(fmt, bytes(range(256))).tolist() == plain(range(256), fmt)
    x = [random.Random(1).randrange(-3000, 3000) for _ in range(60)]
    got = audio.resample(np.array(x, np.int16), 8000, 16000)
    for i in range(120):  # a windowed sinc around i / 2, weights that sum to 1
        near = [(k, i / 2 - k) for k in range(-8 + i // 2, i // 2 + 9)]
        h = [math.prod((np.sinc(t), math.cos(math.pi * t / 18) ** 2)) * (abs(t) <= 8) for _, t in near]
        assert abs(got[i] - max(-32768, min(32767, sum(w * x[k] for (k, _), w in zip(near, h, strict=True) if 0 <= k < 60) / sum(h)))) <= 1
    rows = audio.text_audio(docs_of(spark).limit(60)).select("audio.*").collect()
    bare = audio.text_audio(docs_of(spark).limit(60), files=False).select("audio.*").collect()
    seen = set()
    for r, b in zip(rows, bare, strict=True):
        assert all(r[n] == b[n] for n in b.asDict()) and hashlib.sha256(r["wav"]).hexdigest() == r["wav_sha256"]
        fmt, rate, channels, align, data = audio.unwav(r["media"])
        pcm = audio.resample(audio.decode(fmt, data, channels, align), rate, 16000)
        wav = audio.unwav(r["wav"])
        assert wav[:3] == (audio.PCM, 16000, 1) and bytes(wav[4]) == pcm.tobytes()
        wide = pcm.astype(int).tolist()
        assert r["feature"].startswith(f"format={fmt};rate=16000;n={len(wide)};peak={max(map(abs, wide))};energy={sum(v * v for v in wide)};")
        seen.add(fmt)
    assert seen == set(audio.FORMATS)


def test_resampling_and_media_columns(spark):
    t = np.arange(4000) / 8000
    tone = (8000 * np.sin(2 * np.pi * 440 * t)).astype(np.int16)
    up = audio.resample(tone, 8000, 16000)
    want = 8000 * np.sin(2 * np.pi * 440 * np.arange(8000) / 16000)
    assert len(up) == 8000 and np.abs(up[100:-100] - want[100:-100]).max() < 60
    assert len(audio.resample(tone, 8000, 11025)) == math.ceil(4000 * 11025 / 8000)
    media = [(1, audio.wav(audio.compand(tone, audio.MULAW).tobytes(), audio.MULAW)), (2, None), (3, b""), (4, b"no sound"), (5, b"RIFF1234WAVE")]
    rows = {r["k"]: r["audio"] for r in audio.decode_media(spark.createDataFrame(media, "k int, media binary")).collect()}
    assert rows[1]["n_samples"] == 8000 and audio.unwav(rows[1]["wav"])[:3] == (audio.PCM, 16000, 1)
    assert rows[2]["n_samples"] == rows[3]["n_samples"] == 0 and rows[4]["error"] and rows[5]["error"]


# 3


def test_lm_scores_equal_brute_force(spark, odd, none):
    d = docs_of(spark).select("doc_id", "text")
    words = {r["doc_id"]: [w for w in re.split(r"[ \t\n\r\x0b\x0c]+", r["text"].lower()) if w] for r in d.collect()}
    one, two = Counter(), Counter()
    for w in words.values():
        one.update(w)
        two.update(zip(w, w[1:], strict=False))
    n = sum(one.values())

    def score(w, least):
        s = 0.0
        for v, x in zip([None, *w], w, strict=False):
            s += math.log(one[x] / n) if v is None else math.log(two[v, x] / one[v]) if two[v, x] >= least else math.log(0.4 * one[x] / n)
        return s

    for options in ({}, {"min_count": 2}, {"min_count": 2, "top": 0, "heavy": 0}, {"top": 500, "heavy": 20}, {"min_count": 2, "top": 500, "heavy": 0}):
        got = lmscore.score_documents(d, **options).collect()
        off = [r["doc_id"] for r in got if abs(r["log_score"] - score(words[r["doc_id"]], options.get("min_count", 1))) > 1e-6]
        assert len(got) == len(words) and not off
        assert all(r["n_words"] == len(words[r["doc_id"]]) for r in got)
    rows = {r["doc_id"]: r for r in lmscore.score_documents(odd).collect()}
    assert rows[1]["n_words"] == 0 and rows[1]["mean_log"] is None and rows[3]["n_words"] == 4 and None in rows
    assert lmscore.score_documents(none).count() == 0


@pytest.mark.parametrize("order, least", [(1, 1), (2, 1), (2, 2), (3, 1), (3, 2)])
def test_lm_scores_of_any_order_equal_brute_force(spark, order, least):
    rng = random.Random(order)
    texts = [(k, " ".join(rng.choice(["a", "B", "c", "É", "dd"]) for _ in range(rng.randrange(9)))) for k in range(60)]
    texts += [(1, "a b"), (7, None), (8, "a c a c"), (8, "a c a c"), (None, "b c dd")]
    words = [(k, (t or "").lower().split()) for k, t in texts]
    count = Counter(tuple(w[i - n + 1 : i + 1]) for _, w in words for n in range(1, order + 1) for i in range(n - 1, len(w)))
    total = sum(c for g, c in count.items() if len(g) == 1)
    want, size = Counter(), Counter()
    for k, w in words:
        size[k] += len(w)
        for i in range(len(w)):
            top = min(order, i + 1)
            n = next(n for n in range(top, 0, -1) if n == 1 or count[tuple(w[i - n + 1 : i + 1])] >= least)
            g = tuple(w[i - n + 1 : i + 1])
            want[k] += math.log(count[g] / (count[g[:-1]] if n > 1 else total)) + (top - n) * math.log(0.4)
    df = spark.createDataFrame(texts, "doc_id long, text string")
    for got in [lmscore.score_ngrams(df, order, min_count=least), *([lmscore.score_documents(df, min_count=least)] if order == 2 else [])]:
        rows = {r["doc_id"]: r for r in got.collect()}
        assert set(rows) == {k for k, _ in texts}
        assert all(rows[k]["n_words"] == size[k] and rows[k]["log_score"] == pytest.approx(want[k]) for k in rows)
    assert lmscore.score_ngrams(df.limit(0)).count() == 0


def test_one_first_word_is_no_hot_key(spark):
    df = spark.createDataFrame([(k, f"the r{k}a r{k}b r{k}c r{k}d") for k in range(4000)], "doc_id long, text string")
    got = lmscore.score_documents(df, min_count=1)
    assert all(r["n_words"] == 5 and r["log_score"] == pytest.approx(math.log(4000 / 20000) + math.log(1 / 4000)) for r in got.collect())
    placed = []  # rows of the exploded pairs: none has the first word
    real = DataFrame.repartition
    with pytest.MonkeyPatch.context() as m:
        m.setattr(DataFrame, "repartition", lambda self, *a: placed.append(self) or real(self, *a))
        lmscore.score_documents(df, min_count=1, heavy=0)
    assert placed[0].groupBy("pair").count().agg(F.max("count")).first()[0] == 1 and placed[0].count() == 16_000


def test_pairs_are_shuffled_once(spark):
    """Counting, both joins and the sums read one exchange of the exploded pairs, whichever words are rare."""
    rng = np.random.default_rng(31)
    df = spark.createDataFrame([(i, " ".join(f"w{n}" for n in rng.zipf(1.3, 60) % 500)) for i in range(200)], "doc_id long, text string")
    out = lmscore.score_documents(df, min_count=1, top=40, heavy=4)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    made = [line for line in plan.splitlines() if "REPARTITION_BY_COL" in line and "ReusedExchange" not in line]
    reused = [line for line in plan.splitlines() if "ReusedExchange" in line and "REPARTITION_BY_COL" in line]
    assert len(made) == 1 and len(reused) == 2


def test_lm_query_counts_pairs_that_occur_once(spark, tmp_path):
    texts = {1: "a b c a b d", 2: "A b e", 3: "rare once", 4: "c", 5: "", 6: None}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for folder in (tmp_path, SF):
        words = {r["doc_id"]: (r["text"] or "").lower() for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
        words = {k: [w for w in re.split(r"[ \t\n\r\x0b\x0c]+", t) if w] for k, t in words.items()}
        one, two = Counter(), Counter()
        for w in words.values():
            one.update(w)
            two.update(zip(w, w[1:], strict=False))
        n = sum(one.values())
        want = {k: sum(math.log(two[p] / one[p[0]]) for p in zip(w, w[1:], strict=False)) + (math.log(one[w[0]] / n) if w else 0) for k, w in words.items()}
        got = {r["doc_id"]: r["log_score"] for r in queries.QUERIES["op3_lmscore"](spark, str(folder)).collect()}
        assert set(got) == set(want) and not [k for k in want if abs(got[k] - want[k]) > 1e-6]


def test_frequent_words(spark):
    counts = {(h * 0x9E3779B97F4A7C15 & (1 << 64) - 1) - (1 << 63): 1 + h % 7 + 50 * (h < 10) for h in range(3000)}
    df = spark.createDataFrame(list(counts.items()), "h long, c long")
    for top in (0, 5, 10, 200, 2999, 3000, 9999):
        best, total = lmscore.frequent_words(df, top)
        assert total == sum(counts.values()) and all(counts[h] == c for h, c in zip(best["h"], best["c"], strict=True))
        assert top * 0.8 <= len(best) <= top or len(best) == 3000 <= top
        assert (best["c"].head(10) > 50).all() and best["c"].is_monotonic_decreasing
    assert lmscore.frequent_words(df.limit(0), 5)[1] == 1


def test_word_numbers_equal_a_dictionary():
    rng = np.random.default_rng(2)
    for n in (0, 1, 5000):
        words = rng.integers(0, 1 << 64, n, dtype=np.uint64)
        if n > 20:
            words[11:20] = words[10] ^ np.arange(1, 10, dtype=np.uint64)  # one place in the table
        asked = np.concatenate((words, words ^ np.uint64(1 << 20), rng.integers(0, 1 << 64, 5000, dtype=np.uint64)))
        place = {int(h): i for i, h in enumerate(words)}
        want = [place.get(int(h), lmscore.RARE + (int(h) >> 19)) for h in asked]
        assert lmscore.Words(words).numbers(asked).tolist() == want


# 4


def test_quality_held_out_accuracy_and_edges(spark, odd, none):
    sf = "/root/testdata/sf0.01"
    d, lab = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.op4_quality(spark, sf).join(lab, "doc_id").filter("held_out").toPandas()
    assert ((got["predicted"] == got["quality"]).mean()) > 0.93
    model = quality.train_quality(d, lab)
    again = quality.train_quality(d.repartition(3), lab)
    assert np.array_equal(model.weights, again.weights)
    rows = quality.score_quality(odd, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (1, 2, 4)}) == 1
    flat = quality.train_quality(none, lab.limit(0))
    assert {r["score"] for r in quality.score_quality(odd, flat).collect()} == {0.5}
    assert quality.score_quality(none, model).count() == 0


def test_ftrl_equals_a_plain_loop():
    rng = random.Random(1)
    rows = [(np.array(sorted(rng.sample(range(16), 5)), np.int32), np.array([rng.random() for _ in range(5)], np.float32), rng.randrange(2)) for _ in range(40)]
    alpha, beta, l1, l2 = 0.3, 1.0, 0.02, 0.02
    z, n, zb, nb = [0.0] * 16, [0.0] * 16, 0.0, 0.0

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    order = np.random.default_rng(7)
    for _ in range(4):
        for k in order.permutation(40):
            idx, val, y = rows[k]
            b = -zb / ((beta + math.sqrt(nb)) / alpha)
            w = {int(i): weight(int(i)) for i in idx}
            p = 1 / (1 + math.exp(-sum(w[int(i)] * float(v) for i, v in zip(idx, val, strict=True)) - b))
            for i, v in zip(map(int, idx), map(float, val), strict=True):
                g = (p - y) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
                n[i] += g * g
            g = p - y
            zb += g - (math.sqrt(nb + g * g) - math.sqrt(nb)) / alpha * b
            nb += g * g
    model = quality.ftrl(rows, bits=4)
    assert model.weights == pytest.approx([weight(i) for i in range(16)], abs=1e-6) and model.bias == pytest.approx(-zb / ((beta + math.sqrt(nb)) / alpha))


def test_quality_score_equals_a_dictionary():
    rng = np.random.default_rng(3)
    model = quality.QualityModel(rng.normal(size=1 << 12).astype(np.float32), 0.3, 12)
    texts = ["A b, a B!", "", "one one ONE two", "é à"]
    data, offs = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)])
    slots, bounds = quality._slots(data, offs, 12)
    assert np.diff(bounds).tolist() == [3 * 6, 0, 3 * 4, 3 * 2]  # words and marks, their pairs, their shapes
    for k, got in enumerate(model.scores(data, offs)):
        count = Counter(slots[bounds[k] : bounds[k + 1]].tolist())
        dot = sum(c * float(model.weights[s]) for s, c in count.items()) / math.sqrt(max(1, sum(count.values())))
        assert got == pytest.approx(1 / (1 + math.exp(-dot - 0.3)))


def test_training_rows_are_bounded_when_ids_repeat(spark, monkeypatch):
    rows = [(1, f"text {k % 7} of one id", "en", "a", 3) for k in range(5000)] + [(k, f"other {k}", "de", "a", 3) for k in range(2, 40)] + [(1, "no language", None, "a", 3)]
    docs = spark.createDataFrame(rows, DOC)
    lab = spark.createDataFrame([(k, k % 2) for k in range(1, 40)] * 3, "doc_id long, quality int")
    for limit, most in ((10, 10), (1000, 39)):
        model = quality.train_quality(docs, lab, max_rows=limit, fold=None, bits=10)
        assert np.array_equal(model.weights, quality.train_quality(docs.dropDuplicates().repartition(3), lab, max_rows=limit, fold=None, bits=10).weights)
    got = langid.training_rows(docs, 10, None, 100).collect()
    assert Counter(r["_l"] for r in got) == {"de": 10, "en": 1} and all(r["_t"] != "no language" for r in got)
    assert {r["_l"] for r in langid.training_rows(docs, 10, None, 1).collect()} == {"de"}
    none_of_it = docs.filter("lang is null").unionByName(docs.filter("doc_id > 1"))
    assert all(r["_t"].startswith("other") for r in langid.training_rows(none_of_it, 1000, None, 100).collect())


# 5


def test_fingerprints(spark, odd, none):
    rows = sorted(phrases.op5_phrases(spark, SF).collect(), key=lambda r: -r["doc_id"])
    text = {r["doc_id"]: r["text"] for r in docs_of(spark).collect()}
    for r, nxt in zip(rows, [*rows[1:], rows[0]], strict=True):
        t, u = text[r["doc_id"]], text[nxt["doc_id"]]
        e = t[: len(t) - len(t) // 3] + u[: len(t) // 3]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert r["edited_fingerprint"] == phrases.to_hex(phrases.sketches([e])[0])
    got = {r["doc_id"]: r["fp"] for r in phrases.fingerprint(odd, out="fp").collect()}
    assert got[1] == got[2] == "" and got[3] == got[None]
    order = phrases.with_neighbours(odd).select("part", "look", "doc_id").collect()
    assert sum(not r["look"] for r in order) == len(ODD)
    assert phrases.with_neighbours(none).count() == 0


def plain_names(text, fine=False):
    """The set of names by loops over one text, with level 1 if fine; the same hashes of symbols."""
    one = lambda x: int(phrases.mix(np.array([x & (1 << 64) - 1], np.uint64))[0])
    sym, out = [ord(c) for c in text], []
    for _ in range(max(phrases.LEVELS)):
        runs = []
        for x in sym:
            if runs and runs[-1][0] == x:
                runs[-1][1] += 1
            else:
                runs.append([x, 1])
        s = [x if n == 1 else one(x + n * 0x9E3779B97F4A7C15) for x, n in runs]

        def toss(x, y):
            if x == y:
                return 0
            low = (x ^ y) & -(x ^ y)
            return 2 * (low.bit_length() - 1) + bool(x & low)

        label = [toss(x, s[i - 1] if i else ~x & (1 << 64) - 1) for i, x in enumerate(s)]
        for _ in range(3):
            label = [toss(x, label[i - 1] if i else x ^ 1) for i, x in enumerate(label)]
        cuts = [0] + [i for i in range(1, len(s) - 1) if label[i - 1] < label[i] >= label[i + 1]]
        sym = []
        for a, b in zip(cuts, [*cuts[1:], len(s)], strict=True):
            power, total = 1, 0
            for x in s[a:b]:
                total += one(x) * power
                power = power * 0x9E3779B97F4A7C15 & (1 << 64) - 1
            sym.append(one(total + b - a))
        out.append([one(x + len(out) + 1) >> 32 for x in sym])
    return {x for level in ((1,) if fine else ()) + phrases.LEVELS for x in out[level - 1]}


def test_fingerprints_equal_a_plain_parse(spark):
    texts = ["a", "ab", "aaaa", "abcabc" * 9, *(r["text"] for r in docs_of(spark).limit(25).collect())]
    texts = [t for t in texts if t]
    texts += ["hello world", "x" * 63 + "y", "é" * 20 + "abc" * 15, "ab" * 140]
    assert [x.tolist() for x in phrases.sketches(texts)] == [sorted(plain_names(t, len(t) < phrases.SHORT))[: phrases.K] for t in texts]
    rows = sorted(phrases.op5_phrases(spark, SF).collect(), key=lambda r: -r["doc_id"])[:30]
    text = {r["doc_id"]: r["text"] or "" for r in docs_of(spark).collect()}
    for r, nxt in zip(rows, rows[1:], strict=False):
        t, u = text[r["doc_id"]], text[nxt["doc_id"]]
        e = t[: len(t) - len(t) // 3] + u[: len(t) // 3]
        for near, other in (("near_edited", e), ("near_next", u)):
            assert r[near] == pytest.approx(plain_likeness(t, other))


def plain_likeness(t, u):
    if not t or not u:
        return float(t == u)
    fine = min(len(t), len(u)) < 64 and max(len(t), len(u)) < 256
    a, b = plain_names(t, fine), plain_names(u, fine)
    return len(a & b) / len(a | b)


def test_likeness_takes_all_names(spark):
    rng = random.Random(11)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    common = words(60)
    one, two = words(1500) + common + words(1500), words(1500) + common + words(1500)
    for t, u in ((one, two), ("hello world", "hello wurld"), ("", "x"), ("", ""), (words(8), words(30)), (words(8), words(80))):
        (a, b) = phrases.name_sets([t, u])
        assert phrases.alike(t, a, u, b) == pytest.approx(plain_likeness(t, u))
    assert phrases.alike(one, phrases.name_sets([one])[0], two, phrases.name_sets([two])[0]) > 0


def test_equal_substrings_share_phrases_at_any_offset():
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    for _ in range(20):
        core = word(2000)
        a, b = word(rng.randrange(50)) + core + word(20), word(rng.randrange(50)) + core
        names = []
        for t in (a, b):
            sym, first = np.frombuffer(t.encode("utf-32-le"), "<u4").astype(np.uint64), np.array([0])
            for _ in range(2):
                sym, first = phrases.parse(sym, first)
            names.append(set(sym.tolist()))
        assert len(names[0] & names[1]) / len(names[0] | names[1]) > 0.8
    runs, _ = phrases.parse(np.full(1000, 7, np.uint64), np.array([0]))
    assert len(runs) == 1


# 6


def test_language_held_out_accuracy_and_edges(spark, odd, none):
    sf = "/root/testdata/sf0.01"
    got = langid.op6_langid(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").filter("held_out and lang_pred != 'und'").toPandas()
    assert (got["lang_pred"] == got["lang"]).mean() > 0.93
    net, langs = langid.train_langid(docs_of(spark), per_lang=30, fold=None)
    rows = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify_language(odd, net, langs).collect()}
    assert rows[1] == rows[2] == rows[4] == rows[6] == ("und", 0.0) and rows[5][0] in langs
    assert langid.identify_language(none, net, langs).count() == 0
    assert langid.train_langid(none) == ({}, [])
    assert {r["lang_pred"] for r in langid.identify_language(odd, {}, []).collect()} == {"und"}


def test_network_equals_nested_loops():
    rng = np.random.default_rng(5)
    net, mask = langid.new_network(3, rng)
    net["b1"], net["b2"] = rng.normal(size=36).astype(np.float32), rng.normal(size=3).astype(np.float32)
    x = rng.integers(0, 256, (2, langid.WINDOW)).astype(np.uint8)
    got = langid.forward(net, x)
    for row, p in zip(x.tolist(), got, strict=True):
        row += [0] * (max(langid.WIDTHS) - 1)
        pooled = []
        for f in range(36):
            width = langid.WIDTHS[f // langid.FILTERS]
            best = max(sum(float(net["emb"][row[i + j]][d]) * float(net["w1"][j * langid.DIM + d][f]) for j in range(width) for d in range(langid.DIM)) for i in range(langid.WINDOW))
            pooled.append(max(0.0, best + float(net["b1"][f])))
        logit = [sum(pooled[f] * float(net["w2"][f][k]) for f in range(36)) + float(net["b2"][k]) for k in range(3)]
        e = [math.exp(v - max(logit)) for v in logit]
        assert p == pytest.approx([v / sum(e) for v in e], abs=1e-4)


def test_network_gradients_equal_differences():
    rng = np.random.default_rng(6)
    net, mask = langid.new_network(3, rng)
    net["b1"] += 0.1
    x, y = rng.integers(0, 256, (8, langid.WINDOW)).astype(np.uint8), rng.integers(0, 3, 8)
    loss = lambda: -np.log(langid.forward(net, x).astype(np.float64)[np.arange(8), y]).mean()
    g, step = langid.gradients(net, x, y, mask), 1e-3
    for name, value in net.items():
        at = [np.unravel_index(k, value.shape) for k in np.argsort(-np.abs(g[name]), axis=None)[:5]]
        for i in at:
            old = value[i]
            value[i] = old + step
            more = loss()
            value[i] = old - step
            less = loss()
            value[i] = old
            assert (more - less) / (2 * step) == pytest.approx(g[name][i], rel=0.1, abs=2e-3)
    assert not (g["w1"][mask == 0]).any()


# 7


def distance(a, b):
    """Word edit distance by the plain table."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def plain_classes(texts):
    """All pairs: linked if equal, or if the edit distance is a fifth of the longer text's words at most."""
    words = {i: (t or "").lower().split() for i, t in texts.items()}
    bags = {i: Counter(w) for i, w in words.items()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in texts:
        for j in texts:
            n = max(len(words[i]), len(words[j]))
            near = i < j and n and 5 * (n - (bags[i] & bags[j]).total()) <= n and 5 * distance(words[i], words[j]) <= n
            if i < j and (near or (texts[i] or "") == (texts[j] or "")):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in texts}


def classes_of(df):
    return {r["doc_id"]: r["class_id"] for r in neardup.near_classes(df)[0].collect()}


def edits(rng, words, n, vocabulary):
    w = list(words)
    for _ in range(n):
        at = rng.randrange(len(w) + 1)
        w[at : at + rng.randrange(2)] = [rng.choice(vocabulary)] * rng.randrange(2)
    return w


def test_near_duplicates_equal_brute_force(spark, odd, none):
    texts = {r["doc_id"]: r["text"] for r in docs_of(spark).collect()}
    assert {r["doc_id"]: r["class_id"] for r in neardup.op7_neardup(spark, SF).collect()} == plain_classes(texts)
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    made = {i: " ".join(edits(rng, base, rng.randrange(0, 60), vocabulary)) for i in range(60)}  # at and below the limit
    df = spark.createDataFrame(list(made.items()), "doc_id long, text string")
    want = plain_classes(made)
    assert 1 < len(set(want.values())) < 60
    assert classes_of(df) == want
    assert sorted(r["doc_id"] for r in neardup.deduplicate(df).collect()) == sorted(set(want.values()))
    kept = neardup.deduplicate(odd)
    assert kept.columns == odd.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "4", "5", "6"]
    assert neardup.deduplicate(none).count() == 0


def test_alignment_decides(spark):
    """Edits of 5 to 15 % leave few five-word shingles; texts with the same word pairs in another order share all candidates' bounds."""
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(5000)]
    made, want = {}, {}
    for k in range(60):
        base = [rng.choice(vocabulary) for _ in range(200)]
        made[3 * k], made[3 * k + 1] = " ".join(base), " ".join(edits(rng, base, (10, 20, 30)[k % 3], vocabulary))
        made[3 * k + 2] = " ".join(base[60:120] + base[:60] + base[120:])  # a moved block: bigrams stay, alignment doesn't
        want |= {3 * k: 3 * k, 3 * k + 1: 3 * k, 3 * k + 2: 3 * k + 2}
    df = spark.createDataFrame(list(made.items()), "doc_id long, text string")
    assert classes_of(df) == want


def shared_keys(a, b):
    words = np.array([int.from_bytes(hashlib.md5(str(w).encode()).digest()[:8]) for w in [*a, *b]], np.uint64)
    owner, key = neardup.sketch_keys(words, np.array([0, len(a), len(a) + len(b)]))
    return len(set(key[owner == 0].tolist()) & set(key[owner == 1].tolist()))


def test_recall_of_keys():
    rng = random.Random(7)
    lost = 0
    for _ in range(3000):  # short pairs: all
        a = [rng.randrange(300) for _ in range(rng.randrange(1, 25))]
        b = edits(rng, a, rng.randrange(0, 6), range(300))
        n = max(len(a), len(b))
        lost += bool(b) and n <= neardup.SHORT and 5 * distance(a, b) <= n and not shared_keys(a, b)
    assert lost == 0
    for size in (30, 64, 65, 300):  # others, at an edit similarity of 0.85: 0.95 at least
        lost = 0
        for _ in range(200):
            a = [rng.randrange(10**6) for _ in range(size)]
            b = list(a)
            for at in rng.sample(range(size), int(0.15 * size)):
                b[at] = -1 - at
            lost += not shared_keys(a, b)
        assert lost <= 10


def test_repeated_lines_share_keys(spark):
    made = {}
    for k in range(40):
        base, line = [f"b{k}.{i}" for i in range(300)], [f"l{k}.{i}" for i in range(6)]
        made[2 * k] = " ".join(base + line * 50)
        line[3] = "other"
        made[2 * k + 1] = " ".join(base + line * 50)
    df = spark.createDataFrame(list(made.items()), "doc_id long, text string")
    assert classes_of(df) == {i: i - i % 2 for i in made}


@pytest.mark.parametrize("blocks", (False, True))
def test_large_buckets_lose_nothing(spark, monkeypatch, blocks):
    """Many different texts around one passage, with some near copies: dealt out by rare word pairs, or all of it by blocks."""
    monkeypatch.setattr(neardup, "LOCAL", 6)
    monkeypatch.setattr(neardup, "SAMPLES", 60)
    if blocks:
        nothing = lambda rows: rows.select(F.col("key").alias("was"), "key", "node", "words").filter("key is null")
        monkeypatch.setattr(neardup, "_by_rare_pairs", lambda rows, words: neardup.written(nothing(rows), "dealt"))
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(60)]
    made = {}
    for i in range(0, 80, 2):
        own = [rng.choice("abcdefghij") + str(rng.randrange(400)) for _ in range(60)]
        made[i] = " ".join(own[:30] + passage + own[30:])
        made[i + 1] = " ".join(edits(rng, made[i].split(), rng.choice((8, 15, 40)), passage))
    df = spark.createDataFrame(list(made.items()), "doc_id long, text string")
    want = plain_classes(made)
    assert 45 < len(set(want.values())) < 75
    assert classes_of(df) == want


def test_banded_distance():
    rng = random.Random(1)
    for _ in range(150):
        a = [rng.randrange(30) for _ in range(rng.randrange(0, 120))]
        b = list(a)
        for _ in range(rng.randrange(0, 60)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = [rng.randrange(30)] * rng.randrange(2)
        d, most = distance(a, b), rng.randrange(0, 80)
        assert neardup.banded_distance(np.array(a, "<u4"), np.array(b, "<u4"), most) == (d if d <= most else None)
    a = np.arange(60_000, dtype="<u4") % 9973  # long: three bands, and words that are rare and frequent
    b = np.delete(a, [5, 30_000, 30_001, 59_000])
    b[::3000] = 10**6
    assert neardup.banded_distance(a, b, 12_000) == 4 + 20
    assert neardup.banded_distance(a, a[::-1], 50) is None


# 8, 9


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_native_queries_agree_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(queries.ORACLES[name])
    columns = sorted(c[0] for c in want.description)
    places = [next(i for i, c in enumerate(want.description) if c[0] == n) for n in columns]
    value = lambda x: round(x, 6) if isinstance(x, float) else x
    got = queries.QUERIES[name](spark, SF).select(*columns)
    assert sorted(repr([value(x) for x in r]) for r in got.collect()) == sorted(repr([value(r[i]) for i in places]) for r in want.fetchall())


def test_mixing_edges(spark, odd, none):
    plan = mixing.mix_plan(odd).collect()
    assert len(plan) == len(ODD) and all(r["copies"] <= 2 for r in plan)
    assert mixing.mix_sources(odd).columns == odd.columns
    assert sorted(map(str, mixing.mix_sources(odd).collect())) == sorted(map(str, mixing.mix_sources(odd, small=0).collect()))
    assert mixing.mix_plan(none).count() == 0
    places = {r["source"]: r["place"] for r in mixing.ranked(spark.createDataFrame([("b",), ("B",), (None,), ("é",), ("a",)], "source string")).collect()}
    assert places == {"B": 0, "a": 1, "b": 2, "é": 3, None: 4}


def test_mixing_keeps_the_documents_own_columns(spark):
    names = ("weight", "rate", "size", "target", "copies", "source_size", "row", "of", "copy", "limit", "Place")
    docs = docs_of(spark).withColumns({n: F.concat(F.lit(n), "doc_id") for n in names}).withColumn("a.b", F.lit(1))
    plain = Counter(r["doc_id"] for r in mixing.mix_sources(docs_of(spark)).collect())
    rows = mixing.mix_sources(docs).collect()
    assert Counter(r["doc_id"] for r in rows) == plain
    assert all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in names)
    plan = mixing.mix_plan(docs)
    assert {r["weight"] for r in plan.collect()} == {f"weight{k}" for k in {r["doc_id"] for r in docs.collect()}}
    assert {(r["doc_id"], r["copies"]) for r in plan.collect()} == {(r["doc_id"], r["copies"]) for r in mixing.mix_plan(docs_of(spark)).collect()}


def test_chat_sql_counts_escapes(spark, tmp_path):
    bits = ["\\", "<|", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<s>", "x", "\n", "é"]
    rng = random.Random(9)
    rows = [(k % 40, k, rng.choice(["user", "assistant", "a\\b\n<|", None]), "".join(rng.choice(bits) for _ in range(rng.randrange(9))) or None) for k in range(300)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(queries.ORACLES["op9_chat"])
    columns = [c[0] for c in want.description]
    assert sorted(map(tuple, queries.QUERIES["op9_chat"](spark, str(tmp_path)).select(*columns).collect())) == sorted(want.fetchall())


def test_chat_reads_back(spark):
    rng = random.Random(4)
    bits = ["\\", "<|", "|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<|im_end|>\n", "<|im_next|>", "\\\\<|", "a", "é", "\n", ""]
    turns, want = [], {}
    for c in range(60):
        rows = [(c, t, rng.choice(["user", "assistant", "sys\\n\ntem", "<|im_start|>", "\x00\x01\\\n\\"]), "".join(rng.choice(bits) for _ in range(rng.randrange(8)))) for t in range(rng.randrange(1, 7))]
        want[c] = [(r, x) for _, _, r, x in rows]
        turns += rows
    rng.shuffle(turns)
    turns += [(100, None, None, None), (100, 1, "user", "b"), (100, 1, "user", "a"), (100, 1, "user", "a")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("t", F.lit("mine"))
    out = chat.format_chat(df).withColumns({"r": chat.read_chat(F.col("formatted")), "m": chat.loss_pieces(F.col("formatted"))})
    for r in out.collect():
        got = [tuple(x) for x in r["r"]]
        assert got == want.get(r["conv_id"], [("", ""), ("user", "a"), ("user", "a"), ("user", "b")])
        assert "".join(x["text"] for x in r["m"]) == r["formatted"]
        assert sum(x["learned"] for x in r["m"]) == sum(role == "assistant" and text != "" for role, text in got)
    assert chat.format_chat(df.limit(0)).count() == 0


# 10


def test_main_text_equals_the_article(spark):
    p = spark.read.parquet(f"{SF}/pages.parquet")
    for r in htmltext.extract_text(p).collect():
        m = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S)
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"<br>|</?p>|</?h1>", m[1] if m else "")]
        want = "\n".join(b for b in parts if b)
        assert (r["text"], r["n_chars"]) == (want, len(want))


def test_wrappers_and_broken_pages(spark):
    page = lambda k: f"<html><body><div class='top menu'>Home {k}</div><div id=x><div class=story><p>First&nbsp; {k} &lt;b&gt;<p>Second {k * 7} <i>a</i>b</div><div class='comments'>nice {k}</div></div><footer>c</footer></body>"
    assert htmltext.main_text(page(5), htmltext.induce([page(1), page(2), page(3)])) == "First 5 <b>\nSecond 35 ab"
    cases = [(1, "http://h/1", page(1)), (2, "http://h/2", page(2)), (3, None, None), (4, "bad", ""), (5, "http://o/", "<p>a<p>b &am"), (6, "http://o/", "text < only"), (6, "http://o/", "text < only"), (7, "x", "<article><header><h1>T</h1></header><nav>n</nav>x<script>'</article>'</script>y<!-- c"), (8, "http://p/", "<p>x</p>< 5 percent"), (9, "http://q/", "<3 hearts and <b>more")]
    got = htmltext.extract_text(spark.createDataFrame(cases, "page_id long, url string, html string").withColumns({"host": F.lit("mine"), "tree": F.lit("mine")}))
    rows = {r["page_id"]: r["text"] for r in got.collect()}
    assert got.count() == len(cases) and {"host", "tree"} <= set(got.columns)
    assert rows == {1: "First 1 <b>\nSecond 7 ab", 2: "First 2 <b>\nSecond 14 ab", 3: "", 4: "", 5: "a\nb &am", 6: "text < only", 7: "T\nxy", 8: "x\n< 5 percent", 9: "<3 hearts and more"}
    assert htmltext.extract_text(got.limit(0)).count() == 0


def random_tree(rng, n):
    t = htmltext.Tree()
    for _ in range(n):
        t.add(rng.choice("abc") + ".|", rng.randrange(len(t.kinds)))
    t.stats = [[1] + [0] * 12 for _ in t.kinds]
    return t


def test_tree_matching_equals_the_recursion():
    def plain(a, b, v, w):
        left, right = a.kids[v], b.kids[w]
        m = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
        for i, x in enumerate(left):
            for j, y in enumerate(right):
                m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + plain(a, b, x, y) if a.kinds[x] == b.kinds[y] else 0)
        return m[-1][-1] + 1

    rng = random.Random(4)
    for _ in range(300):
        a, b = random_tree(rng, rng.randrange(14)), random_tree(rng, rng.randrange(14))
        to = htmltext.tree_match(a, b)
        assert len(to) == plain(a, b, 0, 0) == len(set(to.values()))
        assert all(w == 0 or a.kinds[v] == b.kinds[w] and to[b.parents[w]] == a.parents[v] for w, v in to.items())
        size = len(a.kinds) + len(b.kinds) - len(to)
        again = htmltext.Tree.load(htmltext.merge(a, b).dump())
        assert len(again.kinds) == size and sum(s[0] for s in again.stats) == size + len(to)


def test_wide_trees_get_the_heaviest_matching_too(spark):
    names = [f"{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(540)]
    moved = htmltext.Tree(), htmltext.Tree()
    for t, order in zip(moved, ([*names, "mover"], ["mover", *names]), strict=True):
        for name in order:
            t.add(f"div.{name}|", 0)
    assert [len(htmltext.tree_match(*pair)) for pair in (moved, moved[::-1], moved[:1] * 2)] == [541, 541, 542]
    rng = random.Random(5)
    a, b = htmltext.Tree(), htmltext.Tree()
    for t in (a, b):
        for _ in range(900):
            t.add(rng.choice("ab") + ".|", rng.randrange(min(len(t.kinds), 3)))
    best = {}
    for v in range(900, -1, -1):
        for w in range(900, -1, -1):
            if a.kinds[v] == b.kinds[w]:
                line = [0] * (len(b.kids[w]) + 1)
                for x in a.kids[v]:
                    new = [0]
                    for j, y in enumerate(b.kids[w]):
                        new.append(max(line[j + 1], new[j], line[j] + best.get((x, y), 0)))
                    line = new
                best[v, w] = line[-1] + 1
    assert len(htmltext.tree_match(a, b)) == best[0, 0]
    # a page in which only a block's place differs has the template of the others
    fixed = "".join(f"<div class={name}><p>Fixed {name}</p></div>" for name in names)
    block = lambda k: f"<div class=mover><p>Moved {k} here</p></div>"
    page = lambda k: f"<body><div class=m>{block(k) * (k == 9)}{fixed}{block(k) * (k != 9)}<p>{'word ' * 20}{k}</p></div></body>"
    got = texts_of(spark, [(k, "http://wide/", page(k)) for k in (0, 1, 2, 9)])
    assert got == {k: f"Moved {k} here\n{'word ' * 20}{k}" for k in (0, 1, 2, 9)}


def plain_site(k, notes=True):
    """A page without article, main or speaking classes: link list, advert, text between constant paragraphs, comments."""
    rng = random.Random(k)
    words = lambda n: " ".join(f"w{rng.randrange(9999)}" for _ in range(n))
    text = [words(30 + rng.randrange(40)) for _ in range(3 + rng.randrange(4))]
    notes = "".join(f"<div class=r><div>n{words(1)}</div><p>{words(9)}</p></div>" for _ in range(rng.randrange(5))) if notes else ""
    body = f"<p>Read this first, it is on all pages</p><h1>T{k}</h1><h2>Summary</h2>{''.join(f'<p>{t}</p>' for t in text)}<p>Send this to a friend</p>"
    links = "".join(f"<li><a href=/{k}>{words(2)}</a></li>" for _ in range(5))
    page = f"<html><body><div class=q><ul>{links}</ul></div><div class=z>{words(8)}</div><div class=k>{body}</div><div class=j>{notes}</div><div class=z>{words(12)} <a>{words(2)}</a></div></body></html>"
    return page, "\n".join([f"T{k}", "Summary", *text])


def test_wrapper_decides_without_article_or_speaking_names(spark, monkeypatch):
    cases = [(k, "http://plain/", plain_site(k)[0]) for k in range(40)]
    got = texts_of(spark, cases)
    assert all(got[k] == plain_site(k)[1] for k in range(40))
    monkeypatch.setattr(htmltext, "GROUP", 2)
    trees, _ = htmltext.induce_wrappers(spark.createDataFrame(cases, "page_id long, url string, html string"), group=2)
    wrapper = [r["tree"] for r in trees.collect()]
    assert len(wrapper) == 1 and all(htmltext.main_text(h, wrapper[0]) == got[k] for k, _, h in cases)
    alone = [htmltext.main_text(h) for _, _, h in cases]  # without the wrapper, what all pages share stays
    assert all("Send this to a friend" in t and t != got[k] for k, t in enumerate(alone))


def test_articles_keep_their_parts_and_lose_comments(spark):
    page = lambda k: f"<body><article><h1>T{k}</h1><p>Methods {k} and more words here</p><section id=discussion><p>D{k} we discuss</p></section><p class=notice>N{k}</p><div class=related-work><h2>R{k}</h2><p>others {k}</p></div></article><article class=comment><p>I like {k}</p></article><article class=comment><p>Me too {k}</p></article></body>"
    cases = [(k, "http://a/", page(k)) for k in range(2)] + [(k, "http://b/", page(k)) for k in range(2, 7)] + [(9, "http://c/", page(9))]
    got = texts_of(spark, cases)
    for k in got:
        assert got[k] == f"T{k}\nMethods {k} and more words here\nD{k} we discuss\nN{k}\nR{k}\nothers {k}"


def test_deep_and_wide_pages(spark):
    deep = [f"{'<div>' * 10_000}<p>x{k}</p>{'<div>' * k}" for k in range(3)]
    wide = ["".join(f"<div class=c{chr(97 + (i * k) % 7)}><p>t{i}.{k}</p></div>" for i in range(900)) for k in range(1, 4)]
    got = texts_of(spark, [(k, "http://d/", p) for k, p in enumerate(deep)] + [(10 + k, "http://w/", p) for k, p in enumerate(wide)])
    assert [got[k] for k in range(3)] == ["x0", "x1", "x2"]
    assert all(got[10 + k].startswith(f"t0.{k + 1}\nt1.") and got[10 + k].count("\n") == 899 for k in range(3))


def texts_of(spark, cases):
    return {r["page_id"]: r["text"] for r in htmltext.extract_text(spark.createDataFrame(cases, "page_id long, url string, html string")).collect()}


def test_headings_beside_a_long_container_stay(spark):
    long = lambda k: "".join(f"<p>Part {k} {i}</p>" for i in range(30))
    page = lambda k, tag: f"<html><body><nav>n</nav><{tag} class=page><h1>T{k}</h1><p class=lead>L{k}</p><div class=content>{long(k)}</div><p>End {k}</p></{tag}><footer>c</footer></body>"
    got = texts_of(spark, [(k, f"http://{'ab'[k % 2]}/", page(k, ("article", "div")[k % 2])) for k in range(8)])
    for k in range(8):
        assert got[k] == "\n".join([f"T{k}", f"L{k}", *(f"Part {k} {i}" for i in range(30)), f"End {k}"])


def test_each_layout_of_a_host_has_a_wrapper_from_all_pages(spark):
    one = lambda k: f"<html><body><div class=top>Site</div><div class=a><p>A{k}</p></div></body>"
    two = lambda k: f"<html><body><div class=top>Site</div><div class=b><h1>B{k}</h1><div class=x><p>B{k} x</p></div></div></body>"
    late = lambda k: f"<html><body><div class=c><div class=d>{'Same' if k < 199 else 'Other'}</div><div class=e><p>C{k}</p></div></div></body>"
    cases = [(k, "http://hot/", (one, two)[k % 2](k)) for k in range(40)] + [(100 + k, "http://c/", late(k)) for k in range(200)]
    got = texts_of(spark, cases)
    assert all(got[k] == (f"B{k}\nB{k} x" if k % 2 else f"A{k}") for k in range(40))
    assert got[299] == "C199" and got[100] == "C0"  # a line beside the main block, no heading or paragraph


SPEAKING = "navigation comments promo modal subscribe pagination footer cookie signup".split()


def test_speaking_classes_and_ids_drop_no_text_of_an_article(spark):
    block = lambda k, how: f"<div {how}><h2>Part {k}</h2><p>Stars guide ships {k} over the wide sea</p></div><p {how}>A line {k} of it</p>"
    page = lambda k, how: f"<body><article><h1>T{k}</h1><p>{'word ' * 30}{k}</p>{block(k, how)}<p>{'more ' * 20}{k}</p></article></body>"
    cases = [(100 * i + 10 * j + k, f"http://{how}{name}/", page(k, f"{how}={name}")) for i, name in enumerate(SPEAKING) for j, how in enumerate(("class", "id")) for k in range(4)]
    bare = lambda k: f"<body><article><p>{'word ' * 30}{k}</p><div id=navigation><p>Stars guide ships {k}</p></div></article></body>"
    got = texts_of(spark, cases + [(5000 + k, "http://bare/", bare(k)) for k in range(4)])
    for n, _, _ in cases:
        k = n % 10
        assert f"Part {k}\nStars guide ships {k} over the wide sea\nA line {k} of it" in got[n], n
    assert all(got[5000 + k].endswith(f"\nStars guide ships {k}") for k in range(4))


def test_steps_that_end_an_article_stay_and_signed_records_go(spark):
    steps = lambda k: "".join(f"<div class=step><p>Do {i} of {k} now</p></div>" for i in range(2 + k))
    notes = lambda k: "".join(f"<div class=r><div>n{i}</div><p>I like it {i} {k} very much</p></div>" for i in range(1 + k))
    page = lambda k, end: f"<body><div class=w><h1>T{k}</h1><p>{'word ' * 40}{k}</p>{end(k)}</div></body>"
    got = texts_of(spark, [(k, "http://s/", page(k, steps)) for k in range(4)] + [(10 + k, "http://n/", page(k, notes)) for k in range(4)])
    for k in range(4):
        assert got[k].split("\n")[2:] == [f"Do {i} of {k} now" for i in range(2 + k)]
        assert len(got[10 + k].split("\n")) == 2


def test_words_and_forms_do_not_drop_content(spark):
    article = lambda k: f"<body><article><div class='article-header'><h1>T{k}</h1></div><p>x{k}</p><div class='social share'>Tell a friend</div><section id=discussion>D{k}</section><div class=alert>W{k}</div><div class=ad>Buy {k}</div></article></body>"
    story = lambda k: f"<body><div class=side>s{k}</div><div class=story><header><h1>T{k}</h1></header><p>x{k}</p><p>y{k}</p></div></body>"
    form = lambda k: f"<body><form action=x><input><nav>n</nav><div class=f><h1>T{k}</h1><p>x{k}</p></div></form></body>"
    search = lambda k: f"<body><form><p>Search here</p></form><div class=g><p>some more words {k}</p></div></body>"
    got = texts_of(spark, [(4 * k + i, f"http://{i}/", f(k)) for k in range(3) for i, f in enumerate((article, story, form, search))])
    for k in range(3):
        assert got[4 * k] == f"T{k}\nx{k}\nD{k}\nW{k}"
        assert got[4 * k + 1] == f"T{k}\nx{k}\ny{k}"
        assert got[4 * k + 2] == f"T{k}\nx{k}"
        assert got[4 * k + 3] == f"some more words {k}"


# pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = docs_of(spark)
    want = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SF)
        assert docs.columns == want
        old, new = (Counter(r["doc_id"] for r in d.collect()) for d in (before, docs))
        assert set(new) <= set(old)
        if name == "near_duplicates":
            classes = plain_classes({r["doc_id"]: r["text"] for r in before.collect()})
            assert set(new) == set(classes.values()) and set(new.values()) == {1}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in rows} == set(new)


def test_stages_leave_columns_as_they_are_and_decide_as_the_models(spark):
    import corpus_pipeline

    names = ("score", "predicted", "lang_pred", "weight", "size", "__score")
    docs = docs_of(spark).withColumns({n: F.concat(F.lit(n), "doc_id") for n in names})
    lab = spark.read.parquet(f"{SF}/labels.parquet")
    model, (net, langs) = quality.train_quality(docs, lab), langid.train_langid(docs)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, docs, SF).collect()
        assert all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in names)
        kept = {r["doc_id"] for r in rows}
        if name == "quality":
            want = {k for k, t in texts.items() if model.scores(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0] >= 0.3}
            assert kept == want
        elif name == "language":
            want = set()
            for k, t in texts.items():
                x, _, real = langid.windows(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))
                if any(c.isalpha() for c in t) and (langid.forward(net, x) * real[:, None]).sum(0).max() / real.sum() >= 0.5:
                    want.add(k)
            assert kept == want


def test_language_stage_decides_by_score_and_passes_all_when_nothing_is_learned(spark, monkeypatch):
    import corpus_pipeline

    rows = [(k, f"some words {k}" if k % 4 else "12 . 34", None, "a", 9) for k in range(40)] + [(99, None, None, "a", 0)]
    docs = spark.createDataFrame(rows, DOC)
    held = docs.filter(langid.held_out(F.col("doc_id"), 3, 1)).withColumn("lang", F.lit("en"))
    for df in (docs, held):
        got = {r["doc_id"] for r in corpus_pipeline.language(spark, df, SF).collect()}
        assert got and got == {r["doc_id"] for r in df.collect() if r["text"] and "words" in r["text"]}
    scores = {0: ("en", 0.49), 1: ("en", 0.5), 2: ("en", 0.99), 3: (langid.UND, 0.0)}
    monkeypatch.setattr(corpus_pipeline, "train_langid", lambda df: ({}, ["en", "de"]))
    pick = lambda at: F.array(*(F.lit(scores[k][at]) for k in range(4)))[F.col("doc_id") % 4]
    monkeypatch.setattr(corpus_pipeline, "identify_language", lambda df, net, langs, out: df.withColumns({out[0]: pick(0), out[1]: pick(1)}))
    got = corpus_pipeline.language(spark, docs, SF)
    assert got.columns == docs.columns and {r["doc_id"] for r in got.collect()} == {r[0] for r in rows if r[0] % 4 in (1, 2)}


def test_language_stage_keeps_clean_documents(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.01"
    clean = spark.read.parquet(f"{folder}/documents.parquet").join(spark.read.parquet(f"{folder}/labels.parquet").filter("quality = 1").select("doc_id"), "doc_id")
    assert corpus_pipeline.language(spark, clean, folder).count() == clean.count()
