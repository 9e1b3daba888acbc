"""The trained operators: held-out accuracy, ties, and tables without anything to learn from."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from leafseason.llm import langid, quality
from pyspark.sql import functions as F

import corpus_pipeline

SMALL = "/root/testdata/sf0.01"


def test_language_accuracy_and_split(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = langid.identify(docs, langid.train(docs)).join(docs.select(F.col("doc_id").alias("id"), "lang"), "id").toPandas()
    assert len(got) == docs.count()
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(got.id, got.held_out, strict=True))
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_language_of_odd_texts(spark):
    rows = [(1, "the cat the dog", "en"), (2, "le chat le chien", "fr"), (3, "the the the", "en"), (4, None, "en"), (5, "12 ++", None), (None, "le", "fr"), (6, "", "fr"), (7, "the" * 5, None), (8, "中文", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("gram", F.lit(1))
    model = langid.train(df)
    got = {r.id: (r.lang_pred, r.score) for r in langid.identify(df, model).collect()}
    assert got[4] == got[5] == got[6] == ("und", 0.0)
    assert got[8][0] in model.langs  # letters, but none that the model knows: the first language, with equal shares
    empty = langid.train(df.limit(0))
    assert {r.lang_pred for r in langid.identify(df, empty).collect()} == {"und"}
    assert langid.identify(df.limit(0), model).isEmpty()
    assert langid.keep_identified(df, model).columns == df.columns


def test_backoff_takes_the_longest_known_length():
    model = langid.Model.of(["a", "b"], [(3, "abc"), (1, "a")], ["a", "b"], np.array([1.0, 1.0]))
    scorer = langid.Scorer(model)

    def costs(word):
        lang, gain, _, counts = scorer._entries([word])
        return (7 - np.bincount(lang, gain, 2)).tolist() if counts[0] else None

    assert costs("xabcx") == [1, 7]
    assert costs("xax") == [7, 1]
    assert costs("zzz") is None


def language_by_hand(train, text):
    """train: (lang, text) rows. Costs in plain dictionaries, word by word."""
    words = lambda t: regex.findall(r"[\p{L}\p{M}]+", (t or "").lower())
    grams = lambda w, n: [(f" {w} " if n > 1 else w)[i : i + n] for i in range(len(f" {w} " if n > 1 else w) - n + 1)]
    seen = defaultdict(Counter)
    for lang, t in train:
        for w in words(t):
            seen[lang, 0][w] += 1
            for n in range(1, 5):
                seen[lang, n].update(grams(w, n))
    langs = sorted({k for (k, n), c in seen.items() if c})
    cost = lambda lang, n, x: -math.log10(seen[lang, n][x] / seen[lang, n].total()) if seen[lang, n][x] else 7.0
    if not langs or not regex.search(r"\p{L}", text or ""):
        return "und", 0.0
    totals, known = dict.fromkeys(langs, 0.0), 0
    for w in words(text):
        if any(seen[k, 0][w] for k in langs):
            own = [{k: cost(k, 0, w) for k in langs}]
        else:
            own = next(([{k: cost(k, n, g) for k in langs} for g in grams(w, n) if any(seen[k, n][g] for k in langs)] for n in (4, 3, 2, 1) if any(seen[k, n][g] for g in grams(w, n) for k in langs)), [])
        if own:
            known += 1
            for k in langs:
                totals[k] += sum(o[k] for o in own) / len(own)
    mean = {k: v / max(1, known) for k, v in totals.items()}
    best = min(langs, key=lambda k: (round(mean[k], 4), k))
    return best, 1 / sum(10 ** ((mean[best] - v) * min(max(known, 1), 5)) for v in mean.values())


def test_language_of_whole_texts_by_hand(spark):
    rng = random.Random(4)
    said = {"en": ["the", "cat", "house", "that", "river"], "fr": ["le", "chat", "maison", "que", "rivière"], "de": ["der", "fluß", "haus", "das", "ÄPFEL"]}
    rows = [(i, " ".join(rng.choice(said[k]) for _ in range(rng.randint(1, 12))) + rng.choice(["", "!", " 12", " é́"]), k) for i, k in enumerate(rng.choices(list(said), k=60))]
    odd = ["hauses rivers", "zq xx", None, "", "12 ++", "中文", "LE CHAT der fluß", "the " * 200_000, "ththth eeee", "́́"]
    rows += [(100 + i, t, None) for i, t in enumerate(odd)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"held_out": F.lit("x"), "id": F.lit(1), "score": F.lit(2), "n": F.lit(3)}).repartition(3)
    train = [(k, t) for i, t, k in rows if k and zlib.crc32(str(i).encode()) % 5]
    got = {r.id: (r.lang_pred, r.score) for r in langid.identify(df, langid.train(df)).collect()}
    for i, t, _ in rows:
        lang, score = language_by_hand(train, t)
        assert got[i][0] == lang and got[i][1] == pytest.approx(score, abs=1e-3), t
    whole, cut = langid.train(df), langid.train(df, max_words=1)
    assert cut.words.keys() < whole.words.keys() and cut.grams[2].keys() == whole.grams[2].keys()
    assert len(langid.train(df, sample_bytes=300).words) < len(whole.words)


def statistics_by_hand(text):
    """The statistics of a text, one by one, in plain Python."""
    raw = (text or "").encode()
    if not raw:
        return [0.0] * 25
    n, words, lines = len(raw), raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    size, w, m = [len(x) for x in words] or [0], max(1, len(words)), max(1, len(lines))
    mean = sum(size) / len(size)
    share = lambda f: sum(map(f, raw)) / n
    marks, rare = b".,;:?!'\"()-", b"#$%&*+/<=>@[\\]^_`{|}~"
    return [
        math.log1p(n), math.log1p(len(words)), math.log1p(len(lines)), mean, (sum((x - mean) ** 2 for x in size) / len(size)) ** 0.5, math.log1p(max(size)),
        share(lambda b: 65 <= b <= 90), share(lambda b: 97 <= b <= 122), share(lambda b: 48 <= b <= 57), share(lambda b: b in b" \t\n\v\f\r"), share(lambda b: b in marks), share(lambda b: b >= 128), share(lambda b: b in rare),
        raw.count(b"|") / w, raw.count(b"!") / w, raw.count(b".") / w, sum(x.isupper() for x in words) / w, sum(x <= 3 for x in size) / len(size), len(set(words)) / w, len(set(lines)) / m,
        max(Counter(words).values(), default=0) / w, w / (1 + sum(raw.count(x) for x in (b".", b"!", b"?"))), sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines) / m,
        -sum(c / n * math.log2(c / n) for c in Counter(raw).values()), len({(words[i], words[i + 1]) for i in range(len(words) - 1)}) / w,
    ]


def test_quality_scores_by_hand(spark):
    rng = random.Random(6)
    rows = []
    for i in range(400):
        good = i % 3 > 0
        words = [rng.choice(["river", "stone", "Über", "walks", "in", "a"]) for _ in range(rng.randint(0, 40))]
        rows.append((i, (" ".join(words) + ("." if good else " ||| $$ BUY!!")) + rng.choice(["", "\n", "\nmore"])))
    rows += [(1000, None), (1001, ""), (1002, "word " * 300_000), (7, "same id, other text"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"x": F.lit(1), "y": F.lit(2), "id": F.lit(3), "held_out": F.lit(4), "quality": F.lit(1)}).repartition(4)
    marked = [(i, int(i % 3 > 0)) for i in range(400)] + [(1, 0), (2, None), (None, 1)]
    labels = spark.createDataFrame(marked, "doc_id long, quality int").withColumn("x", F.lit(9))
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0
    mean = {i: sum(own) / len(own) for i in range(400) if (own := [q for j, q in marked if j == i and q is not None])}
    x = {i: min(np.array(statistics_by_hand(t), np.float32).tolist() for j, t in rows if j == i) for i in mean if not held(i)}
    model = quality.fit(np.array(list(x.values()), np.float32), np.array([mean[i] for i in x]))
    want = []
    for i, t in rows:
        own, raw = np.array(statistics_by_hand(t), np.float32), model.base
        for k in range(len(model.feature)):
            node = 0
            for _ in range(model.depth):
                node = 2 * node + 1 + int(own[model.feature[k, node]] > model.threshold[k, node])
            raw += model.leaf[k, node - (2**model.depth - 1)]
        want.append((i, held(i), round(1 / (1 + math.exp(-raw)), 3)))
    got = quality.classify(df, labels).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    for a, b in zip(sorted(((r.id, r.held_out, round(r.score, 3)) for r in got), key=key), sorted(want, key=key), strict=True):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) <= 0.002
    assert all(r.predicted == int(r.score >= 0.3) for r in got)


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(docs, labels).join(labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("y")), "id").toPandas()
    held = got[got.held_out]
    assert (held.predicted == held.y).mean() > 0.9
    good, bad = held[held.y == 1].score.to_numpy(), held[held.y == 0].score.to_numpy()
    assert (good[:, None] > bad[None]).mean() > 0.95
    assert ((got.score >= 0.3).astype(int) == got.predicted).all()


def test_quality_without_labels(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (None, "some text"), (2, "x\ny")], "doc_id long, text string")
    none = spark.createDataFrame([(1, None)], "doc_id long, quality int")
    assert [r.score for r in quality.classify(df, none).collect()] == [0.5] * 4
    ones = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    assert all(r.score > 0.99 for r in quality.classify(df, ones).collect())
    assert quality.classify(df.limit(0), ones).isEmpty()


def test_flat_trees_equal_walking_them():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 5)).astype(np.float32)
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > 0)).astype(float)
    trees = quality.fit(x, y, trees=30, depth=3)
    score = trees.score(x)
    assert ((score > 0.5) == y).mean() > 0.97
    raw = np.full(20, trees.base)
    for k in range(20):
        for t in range(30):
            node = 0
            for _ in range(3):
                node = 2 * node + 1 + int(x[k, trees.feature[t, node]] > trees.threshold[t, node])
            raw[k] += trees.leaf[t, node - 7]
    assert np.allclose(1 / (1 + np.exp(-raw)), score[:20])


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage of the pipeline got and gave."""
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, SMALL).cache()
        out[name] = (docs, made)
        docs = made
    return out


def test_pipeline_stages(stages):
    assert list(stages) == ["language", "near_duplicates", "repeats", "mixing", "tokens"]
    start = stages["language"][0]
    for name, (_, made) in stages.items():
        if name != "tokens":
            assert made.columns == start.columns
    docs, kept = stages["language"]
    assert kept.exceptAll(docs).isEmpty() and kept.count() >= 0.97 * docs.where("text rlike '[A-Za-z]'").count()
    docs, kept = stages["near_duplicates"]
    assert kept.exceptAll(docs).isEmpty()
    assert kept.select("text").distinct().count() == kept.count()
    assert docs.select("text").distinct().count() * 0.85 < kept.count()
    docs, cut = stages["repeats"]
    assert cut.count() == docs.count() and cut.where("n_chars != length(text)").isEmpty()
    docs, mixed = stages["mixing"]
    shares = mixed.groupBy("source").agg(F.sum(F.octet_length("text")).alias("n")).toPandas().n
    assert mixed.exceptAll(docs).dropDuplicates(["doc_id"]).join(docs, "doc_id", "left_anti").isEmpty()
    assert shares.max() < 4 * shares.min()
    docs, tokens = stages["tokens"]
    assert tokens.count() == docs.count()
    want = docs.select("doc_id", F.sha2("text", 256).alias("sha")).distinct()
    assert tokens.join(want, "doc_id").where("decoded_sha256 != sha").isEmpty()


def test_stages_take_nulls_and_empty_tables(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["the", "cat", "un", "chien", "ab"]) for _ in range(30)), "en", "s", 9) for i in range(20)]
    rows += [(None, None, None, None, None), (3, "", "fr", None, 0), (3, "", "fr", None, 0), (4, "the " * 400, None, "s", None)]
    rows += [(50, " ".join(rng.choice(["the", "cat", "un", "chien"]) + str(k) for k in range(150_000)), "en", "s", 1), (51, "cat" * 400_000, "en", "s", 1)]  # very long ones
    clash = {c: F.lit(c) for c in ("k1", "__k1", "__k2", "__key", "__id", "__n", "h", "fp", "tile", "replica", "mix_key", "__source", "id", "held_out", "score")}
    for table in (rows, []):
        docs = spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").withColumns(clash)
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, "").cache()
            assert (docs.count() > 0) == bool(table), name
            assert name == "tokens" or docs.columns[-1] == "score"
