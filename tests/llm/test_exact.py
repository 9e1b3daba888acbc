"""The corpus operators against brute force on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from leafseason.llm import bpe, chat, common, fingerprints, mixing, queries, simhash, suffix_dedup, token_counts, topk
from pyspark.sql import functions as F

CLASH = "doc_id long, text string, fp long, h long, key long, n long, tile long, component long, id long"


def docs(spark, texts, first=0):
    """Extra columns carry names that the operators use inside."""
    rows = [(i + first, t, 1, 2, 3, 4, 5, 6, 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, CLASH).repartition(3)


def sample_texts(seed, n=120):
    rng = random.Random(seed)
    phrases = ["".join(rng.choice("abcdefgé ") for _ in range(rng.randint(30, 400))) for _ in range(15)]
    out = []
    for _ in range(n):
        parts = [rng.choice(phrases) if rng.random() < 0.5 else "".join(rng.choice("abcdefghijk ") for _ in range(rng.randint(1, 200))) for _ in range(rng.randint(0, 8))]
        out.append("".join(parts))
    return [*out, None, "", out[3], out[5], "a" * 1500, "ab" * 300, "x" * 200, "y" * 199, "abc" * 100 + "zzz" + "abc" * 100]


def repeats_by_hand(texts, width):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + width] for b in raw for i in range(len(b) - width + 1))
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - width + 1):
            if seen[b[i : i + width]] > 1:
                gone[i : i + width] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        yield len(b), int(gone.sum()), int((np.diff(np.append(0, gone.astype(int))) == 1).sum()), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize(("width", "hot"), [(200, 4000), (64, 4000), (200, 2)])
def test_repeats(spark, width, hot):
    texts = sample_texts(1)
    got = suffix_dedup.remove_repeats(docs(spark, texts), width=width, hot=hot).orderBy("doc_id").collect()
    assert [tuple(r)[1:5] for r in got] == list(repeats_by_hand(texts, width))


def test_repeats_over_chunks_and_odd_tables(spark):
    rng = random.Random(9)
    long = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(suffix_dedup.CHUNK * 2 + 5000))
    texts = [long, "Z" + long[suffix_dedup.CHUNK - 300 : suffix_dedup.CHUNK + 300], "é" * 300, "é" * 300]
    got = suffix_dedup.remove_repeats(docs(spark, texts)).orderBy("doc_id").collect()
    assert [r.n_removed for r in got] == [600, 600, 600, 600]
    assert got[2].kept_text == "" and got[1].kept_text == "Z"
    same = spark.createDataFrame([(1, "q" + long[:500]), (1, "q" + long[:500]), (None, None)], "doc_id long, text string")
    assert sorted(r.n_removed for r in suffix_dedup.remove_repeats(same).collect()) == [0, 501, 501]
    assert suffix_dedup.remove_repeats(same.limit(0)).isEmpty()


def test_index_buckets_keep_grams_together(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(suffix_dedup, "BUCKET", 900)
    rng = random.Random(2)
    rows = []
    for h in range(40):
        core = bytes(rng.choice(b"abcd") for _ in range(250))
        rows += [(h, 1, 10 * h + k, 0, 0, 101, bytes(rng.choice(b"abcd") for _ in range(50)) + core) for k in range(rng.randint(1, 4))]
    names = ["h", "n", "k1", "k2", "lo", "ns", "seg"]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[a : a + 7], strict=True)], names=names) for a in range(0, len(rows), 7)]
    got = {x for b in suffix_dedup.index_marks(iter(batches), 200) for x in zip(b["k1"].to_pylist(), b["lo"].to_pylist(), b["hi"].to_pylist(), strict=True)}
    shared = Counter(r[0] for r in rows)
    assert {k for k, _, _ in got} == {r[2] for r in rows if shared[r[0]] > 1}
    assert all(lo <= 50 and hi == 300 for _, lo, hi in got)


def simhash_by_hand(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_classes(spark):
    rng = random.Random(3)
    words = ["Wa", "wb", "É x", "wd", "we", "\u001cq"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 9))) for _ in range(300)] + [None, "", " \t\n", "A", "a"]
    got = {r.id: (r.fp % 2**64, r.component) for r in simhash.near_classes(docs(spark, texts)).collect()}
    fps = [simhash_by_hand(t) for t in texts]
    assert [got[i][0] for i in range(len(texts))] == fps
    near = [[k for k in range(len(fps)) if (fps[i] ^ fps[k]).bit_count() <= 2] for i in range(len(fps))]
    least = list(range(len(fps)))
    for _ in fps:
        least = [min(least[k] for k in near[i]) for i in range(len(fps))]
    assert [got[i][1] for i in range(len(texts))] == least
    assert spark.createDataFrame([(i, c) for i, (_, c) in got.items()], "i long, c long").count() == len(texts)


@pytest.mark.parametrize(("parts", "radius"), [(4, 2), (8, 3), (16, 2)])
def test_tiles_lose_no_link(spark, parts, radius):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    fps = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64)) for _ in range(6)]))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    edges = [(r.u, r.v) for r in simhash.links(df, radius, parts).collect()]
    root = {int(x): int(x) for x in fps.view(np.int64)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        assert bin((u ^ v) & (2**64 - 1)).count("1") <= 64
        root[find(u)] = find(v)
    want = {}
    a, b = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None]) <= radius)
    label = np.arange(len(fps))
    for _ in range(len(fps)):
        np.minimum.at(label, a, label[b])
    ids = fps.view(np.int64).tolist()
    for i, x in enumerate(ids):
        want.setdefault(label[i], set()).add(x)
    made = {}
    for x in ids:
        made.setdefault(find(x), set()).add(x)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, made.values()))


def test_parts_grow_with_the_table():
    assert [simhash.parts_for(n) for n in (0, 10**6, 10**7, 10**10)] == [4, 4, 8, 16]


def test_deduplicate_keeps_one_row_of_each_class(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (None, "other words"), (3, None), (4, ""), (5, "unlike all the rest of them")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component", F.lit("x"))
    for classes in (simhash.near_classes(df), simhash.similar_classes(df)):
        got = simhash.deduplicate(df, classes)
        assert got.columns == df.columns
        assert sorted((r.doc_id or 0, r.text) for r in got.collect()) == sorted([(1, "a b c d e f"), (0, "other words"), (3, None), (5, "unlike all the rest of them")])
    assert simhash.deduplicate(df.limit(0), simhash.similar_classes(df.limit(0))).isEmpty()


def test_similar_texts_are_found_and_others_left(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    texts = []
    for _ in range(60):
        own = [word() for _ in range(rng.randint(150, 400))]
        near = list(own)
        for _ in range(len(own) // 60):
            near[rng.randrange(len(near))] = word()
        texts += [" ".join(own), " ".join(near)]
    got = {r.id: r.component for r in simhash.similar_classes(docs(spark, texts)).collect()}
    assert sum(got[2 * k] == got[2 * k + 1] for k in range(60)) >= 58
    assert len(set(got.values())) >= 60


def test_cut_tiles_lose_no_link(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    texts = [None, "", "one", "one two"]
    for size in (50, 9):  # groups of near copies far larger than a tile
        own = [word() for _ in range(300)]
        for _ in range(size):
            near = list(own)
            near[rng.randrange(300)] = word()
            texts.append(" ".join(near))
    texts += [" ".join(word() for _ in range(100)) for _ in range(20)]
    fps = [simhash.wide_fingerprint((t or "").encode(), 5)[:2] for t in texts]
    label = list(range(len(texts)))
    for i, (a, b) in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j][0]).bit_count() + (b ^ fps[j][1]).bit_count() <= 24:
                label = [label[j] if x == label[i] else x for x in label]
    least = {x: label.index(x) for x in label}
    for tile_size in (4, 4096):
        got = {r.id: r.component for r in simhash.similar_classes(docs(spark, texts), tile_size=tile_size).collect()}
        assert got == {i: least[x] for i, x in enumerate(label)}


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("byte_bpe_50k.json")
    rng = random.Random(6)
    texts = [None, "", "<|endoftext|>", "a<|endoftext|> b", " " * 700, "a" * 3000, "don't  we'll\n\n x", " \u0085 q"]
    for _ in range(400):
        top = rng.choice([0x7F, 0x250, 0x3000, 0x10FFFF])
        texts.append("".join(chr(c) if not 0xD800 <= (c := rng.randint(0, top)) < 0xE000 else " " for _ in range(rng.randint(0, 40))))
    lib = Tokenizer.from_file(path)
    made = bpe.encode_decode(docs(spark, texts), path, with_ids=True, classes=3, block_bytes=2000)
    got = {r.id: r for r in made.collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        text = lib.decode(ids, skip_special_tokens=False)
        assert got[i].ids == ids and got[i].decoded == text and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode_decode(docs(spark, texts).limit(0), path).isEmpty()


def test_token_counts_equal_the_library(spark):
    import sentencepiece

    path = queries.tokenizer_path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(7)
    texts = ["".join(rng.choice(["a", "b ", "  ", " ", "▁", "the ", "\n", "é", "\0", "<s>", "中 "]) for _ in range(rng.randint(0, 60))) for _ in range(500)]
    assert token_counts.count_tokens(texts, path, limit=2).tolist() == [len(lib.encode(t)) for t in texts]
    long = " ".join(texts) * 20
    got = {r.id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs(spark, [None, "", long, "a b"]), path).collect()}
    n = len(lib.encode(long))
    assert got == {0: (0, 0, False), 1: (0, 0, False), 2: (len(long.encode()), n, n > 4096), 3: (3, 2, False)}


def test_fingerprints(spark):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(3000)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(30, 500))) for _ in range(80)]
    texts += [None, "", "one", texts[0], "é" * 50]
    got = fingerprints.fingerprint_edits(docs(spark, texts)).orderBy(F.desc("id")).collect()
    plain = [t or "" for t in texts][::-1]
    shingles = lambda t: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := t.split()) else set()
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for k, t in enumerate(plain):
        after = plain[(k + 1) % len(plain)]
        edited = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        assert (got[k].n_chars, got[k].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert abs(got[k].near_edited - like(shingles(t), shingles(edited))) < 0.15
        assert abs(got[k].near_next - like(shingles(t), shingles(after))) < 0.15
        assert re.fullmatch(f"[0-9a-f]{{{len(fingerprints.ZEROS)}}}", got[k].fingerprint)
    by_text = {}
    for k, t in enumerate(plain):
        assert by_text.setdefault(t, got[k].fingerprint) == got[k].fingerprint
    one = fingerprints.fingerprint_edits(docs(spark, ["only one here"])).first()
    assert one.near_next == 1.0
    odd = spark.createDataFrame([(None, "x y"), (5, "b"), (5, "b"), (5, None)], "doc_id long, text string")
    assert fingerprints.fingerprint_edits(odd).count() == 4
    assert fingerprints.fingerprint_edits(odd.limit(0)).isEmpty()


def top_by_hand(vectors, k, every):
    rows = {i: [int(np.floor(256 * float(x))) for x in v] for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = set()
    for q in rows:
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(rows[q], v)), i) for i, v in rows.items() if i != q)  # noqa: B905
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])}
    return out


def test_top_k(spark):
    rng = np.random.default_rng(9)
    vectors = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(260)]
    vectors += [(i, vectors[3][1]) for i in range(300, 420)] + [(500, None), (501, [1.0, None]), (502, [float("nan")] * 6), (550, [0.0] * 6), (600, vectors[3][1]), (650, [float("inf")] * 6), (None, [1.0] * 6), (700, [1.0, 2.0])]
    rows = spark.createDataFrame([*vectors, vectors[7], vectors[50]], "vec_id long, embedding array<double>").withColumn("score", F.lit("x")).repartition(3)
    got = topk.top_k(rows, block=64, query_block=3).collect()
    assert {tuple(r) for r in got} == top_by_hand(vectors, 5, 50) and len(got) == len(top_by_hand(vectors, 5, 50))
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(few).collect()] == [(0, 1, 1, 256 * 512)]
    assert topk.top_k(few.limit(0)).isEmpty()


def frames_equal(got, want):
    show = lambda f: sorted(tuple("~" if pd.isna(v) else repr(float(v)) if isinstance(v, int | float | np.integer) else str(v) for v in r) for r in f[sorted(f.columns)].astype(object).itertuples(index=False))
    assert sorted(got.columns) == sorted(want.columns)
    assert show(got) == show(want)


def test_mixing_equals_sql(spark):
    rng = random.Random(10)
    rows = [(i if i % 9 else None, "t" * rng.randint(0, 300), "en", rng.choice(["a", "a", "a", "b", None]), 1) for i in range(200)] + [(1000, "x", "en", "tiny", 1), (1001, None, "en", "void", None)]
    frame = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"]).astype({"doc_id": "Int64", "n_chars": "Int64"})
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    base = duckdb.connect()
    base.register("documents", frame)
    frames_equal(mixing.mix(df).toPandas(), base.sql(mixing.mix_sql()).df())
    assert mixing.mix(df.limit(0)).isEmpty()
    assert mixing.mix(df, {"a": 1.0}).select("source").distinct().collect() != []
    extra = mixing.mix(df.withColumn("replica", F.lit("old")))
    assert extra.columns == [*df.columns, "replica", "mix_key"] and dict(extra.dtypes)["replica"] == "int"


def test_poisson_counts(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.when(F.col("id") < 15_000, "a").otherwise("b").alias("source"))
    counts = mixing.mix(df).groupBy("source", "doc_id").count().toPandas()
    for source, n in (("a", 15_000), ("b", 5_000)):
        own = np.append(counts[counts.source == source]["count"], np.zeros(n - (counts.source == source).sum()))
        rate = 10_000 / n
        assert abs(own.mean() - rate) < 0.05 and abs(own.var() - rate) < 0.12


def test_preferences_equal_sql(spark):
    turns = [(0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (1, 0, "user", "hi"), (1, 1, "assistant", "no é"), (1, 2, "user", None), (2, 0, None, "alone"), (5, 1, "assistant", "b"), (5, 0, "system", "a"), (6, 0, "user", "x"), (6, 1, "assistant", "same"), (7, 0, "user", "x"), (7, 1, "assistant", "same"), (8, None, "assistant", "t"), (8, 0, "user", "t"), (8, 0, "user", "t"), (9, 0, "assistant", "")]
    frame = pd.DataFrame(turns, columns=["conv_id", "turn", "role", "text"]).astype({"turn": "Int64"})
    df = spark.createDataFrame([*turns, (None, 0, "user", "lost")], "conv_id long, turn long, role string, text string").withColumn("prompt", F.lit(1)).repartition(3)
    base = duckdb.connect()
    base.register("conversations", frame)
    got = chat.preference_pairs(df, chat.neighbour_pairs(df)).toPandas()
    frames_equal(got, base.sql(chat.SQL).df())
    one = got[got.pair_id == 0].iloc[0]
    assert one.n_common == 1 and one.prompt == "<|user|>\nhi<|end|>\n" and one.chosen[slice(*map(int, one.chosen_spans.split("-")))] == "yes<|end|>\n"
    empty = df.limit(0)
    assert chat.preference_pairs(empty, chat.neighbour_pairs(empty)).isEmpty()


def test_wide_repeats(spark):
    rng = random.Random(14)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(9000))
    texts = ["x" + passage, passage[:5200] + "y", passage[4100:] + "z" * 5001, "q" * 5002, None, "é" * 2600]
    got = suffix_dedup.remove_repeats(docs(spark, texts), width=5000).orderBy("doc_id").collect()
    assert [tuple(r)[1:5] for r in got] == list(repeats_by_hand(texts, 5000))
    far = "".join(rng.choice("abcd") for _ in range(140_000))
    both = suffix_dedup.remove_repeats(docs(spark, [far, "-" + far, far[1:]]), width=139_999).orderBy("doc_id").collect()
    assert [r.n_removed for r in both] == [140_000, 140_000, 139_999]


def test_repeats_of_many_equal_rows(spark):
    """More rows of one text and id than one task gets, and rows without id; each row has its result."""
    texts = sample_texts(2, 20)
    rows = [(7, texts[3] + "a" * 250)] * 300 + [(None, texts[4] + "b" * 250)] * 150 + list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = Counter((r.doc_id, *tuple(r)[1:5]) for r in suffix_dedup.remove_repeats(df, hot=3).collect())
    assert got == Counter((i, *r) for (i, _), r in zip(rows, repeats_by_hand([t for _, t in rows], 200), strict=True))
    named = df.withColumns({"n_bytes": F.lit("old"), "__k1": F.lit(1), "__row": F.lit(2), "__text": F.lit(3)})
    out = suffix_dedup.remove_repeats(named, others=["n_bytes", "__k1", "__row", "__text"])
    assert out.columns[:4] == ["doc_id", "__k1", "__row", "__text"] and out.columns.count("n_bytes") == 1


def test_crowded_grams_are_filed_anew(spark):
    """One line in hundreds of contexts: more segments under its grams than a task may gather."""
    rng = random.Random(15)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    line = word(60)
    before, after = [word(100) for _ in range(6)], [word(100) for _ in range(6)]
    texts = [word(rng.randint(0, 150)) + rng.choice(before) + line + rng.choice(after) + word(rng.randint(0, 150)) for _ in range(250)]
    want = list(repeats_by_hand(texts, 200))
    assert 0 < sum(r[1] for r in want)
    for hot in (5, 40, 1000):
        got = suffix_dedup.remove_repeats(docs(spark, texts), hot=hot).orderBy("doc_id").collect()
        assert [tuple(r)[1:5] for r in got] == want


@pytest.mark.parametrize("most", [4, 50])
def test_cut_simhash_tiles_lose_no_link(spark, most):
    rng = np.random.default_rng(16)
    base = rng.integers(0, 2**63, 8, dtype=np.uint64)
    flips = lambda: np.uint64(1) << rng.integers(0, 64, 8, dtype=np.uint64)
    fps = np.unique(np.concatenate([base] + [base ^ flips() ^ flips() for _ in range(40)])).view(np.int64)
    df = spark.createDataFrame([(int(x),) for x in fps], "fp long")
    root = {int(x): int(x) for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in simhash.links(df, 2, 4, most).collect():
        root[find(r.u)] = find(r.v)
    label = np.arange(len(fps))
    a, b = np.nonzero(np.bitwise_count(fps.view(np.uint64)[:, None] ^ fps.view(np.uint64)[None]) <= 2)
    for _ in range(len(fps)):
        np.minimum.at(label, a, label[b])
    made, want = {}, {}
    for i, x in enumerate(fps.tolist()):
        made.setdefault(find(x), set()).add(x)
        want.setdefault(label[i], set()).add(x)
    assert sorted(map(sorted, made.values())) == sorted(map(sorted, want.values()))


def test_own_tiles_are_named_alike(spark):
    fps = [0, -1, 5, -(2**63), 2**63 - 1, 123456789123456789]
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    for parts in (4, 8, 16):
        counts = simhash.tile_counts(np.array(fps).view(np.uint64), parts)
        want = (counts * (64 // parts + 1) ** np.arange(parts)).sum(axis=1)
        assert {r.fp: r.t for r in df.select("fp", simhash.home_tile(parts).alias("t")).collect()} == dict(zip(fps, want.tolist(), strict=True))


@pytest.mark.parametrize("n", [0, 1, 300, bpe.BLOCK_WORDS, bpe.BLOCK_WORDS + 5])
def test_flows_of_any_number_of_words(n):
    rank = np.arange(n, dtype=np.uint32)
    head, places, back = bpe._read_flow(bpe._write_flow(b"head", rank, rank[::-1].copy()))
    assert head == b"head" and np.array_equal(back, rank) and np.array_equal(places, rank[::-1])


def test_encoding_in_many_classes_and_blocks(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    rng = random.Random(17)
    texts = [" ".join(f"w{rng.randint(0, 400)}é" for _ in range(60)) for _ in range(80)] + ["long " * 100_000, "q" * 50_000]
    rows = {r.id: (r.n_tokens, r.decoded_sha256) for r in bpe.encode_decode(docs(spark, texts), path, classes=50, block_bytes=500).collect()}
    assert rows == {i: (len(lib.encode(t, add_special_tokens=False).ids), hashlib.sha256(t.encode()).hexdigest()) for i, t in enumerate(texts)}


def edits_by_hand(rows):
    """rows in their order: id, characters and digest of each edited text."""
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        yield i, len(t), hashlib.sha256((t[: len(t) - len(t) // 3] + after[: len(t) // 3]).encode()).hexdigest()


@pytest.mark.parametrize("each", [200, 1 << 20])
def test_fingerprints_of_crowded_ids(spark, monkeypatch, each):
    monkeypatch.setattr(fingerprints, "SAME", 10)
    rng = random.Random(18)
    texts = [" ".join(rng.choice(["ab", "cd", "é", "fg"]) for _ in range(rng.randint(1, 30))) for _ in range(60)]
    rows = [(i % 40, t) for i, t in enumerate(texts)] + [(None, t) for t in texts] + [(9, "the same text " * 5)] * 35 + [(None, None)] * 25
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"place": F.lit("x"), "mark": F.lit(1), "copies": F.lit(2)}).repartition(5)
    got = fingerprints.fingerprint_edits(df, each=each).collect()
    hashed = {r.text: r.h for r in df.select(F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).distinct().collect()}
    crowded = {i for i, n in Counter(i for i, _ in rows).items() if n > 10}
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), hashed[r[1]] if r[0] in crowded else 0, r[1]))
    assert Counter((r.id, r.n_chars, r.edited_sha256) for r in got) == Counter(edits_by_hand(order))
    assert {r.fingerprint for r in got if r.id == 9 and r.n_chars == 70} == {next(r.fingerprint for r in got if r.id == 9 and r.n_chars == 70)}


def test_ranges_of_places():
    bounds = fingerprints.bounds_of([5, 5, 5, 9])
    assert bounds[0].tolist() == [5, 5, 5, 9]
    place, mark = np.array([4, 5, 5, 5, 6, 9, 10]), np.array([0, -(2**63), 0, 2**63 - 1, 0, 0, 0])
    assert fingerprints.range_of(place, mark, bounds).tolist() == [0, 1, 2, 3, 3, 4, 4]
    assert fingerprints.range_of(place, mark, fingerprints.bounds_of([])).tolist() == [0] * 7


def test_mixing_with_more_sources_than_are_broadcast(spark, monkeypatch):
    rows = [(i, "t" * (i % 50), "en", "big" if i % 3 else (f"s{i}" if i % 2 else None), 1) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"__source": F.lit(1), "__row": F.lit(2)})
    plain = mixing.mix(df)
    monkeypatch.setattr(mixing, "SMALL", 5)
    many = mixing.mix(df)
    assert many.columns == plain.columns and many.exceptAll(plain).isEmpty() and plain.exceptAll(many).isEmpty()
    assert mixing.mix(df.limit(0)).isEmpty()


def test_top_k_of_large_scores(spark):
    rng = np.random.default_rng(19)
    # Scores around 2**58, far beyond what a float can tell apart.
    rows = [(i, [float(x) for x in rng.integers(2**20, 2**20 + 50, 16)]) for i in range(120)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=10).collect()
    ints = {i: [int(256 * x) for x in v] for i, v in rows}
    for q in range(0, 120, 10):
        best = sorted((-sum(a * b for a, b in zip(ints[q], v, strict=True)), i) for i, v in ints.items() if i != q)[:5]
        assert [(r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == [(i, -s) for s, i in best]


def test_settings_and_scratch(spark, monkeypatch):
    sizes = {"64mb": 64 << 20, "16777216b": 16 << 20, "1g": 1 << 30, "7": 7, "2k": 2048, "3TB": 3 << 40, "64m": 64 << 20}
    assert {k: common.parse_size(k) for k in sizes} == sizes
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    for said, after in (("64mb", f"{16 << 20}b"), ("1m", "1m"), ("2048b", "2048b")):
        spark.conf.set(name, said)
        common.small_batches(spark)
        assert spark.conf.get(name) == after
    spark.conf.unset(name)
    df, path = common.write_table(spark.range(3), "kept")
    assert df.count() == 3 and common.release(spark) >= 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND|exist"):
        spark.read.parquet(path).count()
    asked = spark.conf.get("spark.checkpoint.dir")
    assert common.shared_dir(spark) == asked

    class Far:
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})()
        sparkContext = type("S", (), {"master": "spark://host:7077"})()

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Far())


def test_long_conversations(spark):
    turns = [(i, k, "assistant" if k % 2 else "user", "hi" if k < 400 else f"{i} {k}") for i in (0, 1) for k in range(500)] + [(2, 0, "user", "x" * 1_000_000)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumns({"id": F.lit(1), "turns": F.lit(2), "chosen": F.lit(3), "n_common": F.lit(4), "pair_id": F.lit(5)})
    got = {r.pair_id: r for r in chat.preference_pairs(df, chat.neighbour_pairs(df)).collect()}
    assert got[0].n_common == 400 and got[0].prompt.count("<|end|>") == 400 and got[0].chosen_spans.count("-") == 50
    assert got[1].chosen == "<|user|>\n" + "x" * 1_000_000 + "<|end|>\n" and got[1].rejected is None
