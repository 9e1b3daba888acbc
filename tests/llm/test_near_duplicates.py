"""The pipeline's near-duplicates stage against brute force."""

import random

import pytest
from leafseason.llm import simhash


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def classes_by_hand(texts):
    sets = [shingles(t) for t in texts]
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for k, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b) and label[i] != label[k]:
                low, high = sorted((label[i], label[k]))
                label = [low if x == high else x for x in label]
    return label


@pytest.mark.parametrize(("tile_size", "large"), [(3, 4096), (4096, 4096), (3, 2), (4096, 5)])
def test_classes_equal_jaccard_by_brute_force(spark, tile_size, large):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    texts = [None, "", "one", "a b c d e f g h", "a b c d e f g h i", "A b c d e f g h i j k"]
    for k in range(40):  # a tail of the other words: similarities from 0.6 to 0.9, and some of exactly 0.8
        own = [word() for _ in range(94)]
        cut = 10 if k % 4 == 0 else rng.randint(5, 22)
        texts += [" ".join(own), " ".join(own[:-cut] + [word() for _ in range(cut)])]
    for _ in range(2):  # groups that share half of their text, or a line
        own = [word() for _ in range(120)]
        texts += [" ".join(own + [word() for _ in range(40)]) for _ in range(12)]
        texts += [" ".join(own[:8] + [word() for _ in range(60)]) for _ in range(12)]
    want = classes_by_hand(texts)
    at = [len(shingles(texts[i]) & shingles(texts[i + 1])) / len(shingles(texts[i]) | shingles(texts[i + 1])) for i in range(6, 86, 2)]
    assert 0.8 in at and min(at) < 0.7 and sum(x < 0.8 for x in at) > 5
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.id: r.component for r in simhash.similar_classes(df, tile_size=tile_size, large=large).collect()}
    assert [got[i] for i in range(len(texts))] == want
    kept = simhash.deduplicate(df, simhash.similar_classes(df, tile_size=tile_size, large=large))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


def test_chunks_by_shingles_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash.similar_tiles, "__defaults__", (150,))
    rng = random.Random(12)
    own = [f"w{rng.random()}" for _ in range(100)]
    texts = [" ".join([*own[:99], f"x{k}"]) for k in range(12)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.component for r in simhash.similar_classes(df).collect()} == {0}


@pytest.mark.parametrize("find", [simhash.near_classes, simhash.similar_classes])
def test_classes_without_ids_and_with_shared_ids_keep_one_row_each(spark, find):
    own = [f"w{k}" for k in range(200)]
    near = " ".join([*own[:-1], "other0"])
    rows = [(None, " ".join(own)), (None, near), (7, "a text of its own"), (7, "and one quite unlike it")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = find(df)
    texts = sorted(r.text for r in simhash.deduplicate(df, found).collect())
    assert [t for t in texts if t[0] == "a"] == ["a text of its own", "and one quite unlike it"]
    assert found.select("fp").distinct().count() == 4 and found.where("id is null").select("root").distinct().count() == len(texts) - 2 == 1


def test_a_large_group_is_compared_with_its_pivot_only(spark):
    rng = random.Random(13)
    own = [f"w{rng.random()}" for _ in range(300)]
    rows = []
    for k in range(600):  # copies with two words changed: all near the pivot, many of them not near each other
        words = list(own)
        for at in rng.sample(range(300), 2):
            words[at] = f"x{k}-{at}"
        rows.append((k, " ".join(words)))
    df = spark.createDataFrame([*rows, (1000, " ".join(own))], "doc_id long, text string")
    asked = []
    tiles = simhash.similar_tiles
    simhash.similar_tiles = lambda met, *a: asked.append(out := tiles(met, *a)) or out
    try:
        assert {r.component for r in simhash.similar_classes(df, large=64).collect()} == {0}
        assert asked[0].isEmpty()  # nothing is left to compare
    finally:
        simhash.similar_tiles = tiles


def test_precision_and_recall_on_the_driver_table(spark):
    """No row is taken out without a chain of pairs at 0.8 or more, and no such pair stays apart."""
    from collections import defaultdict

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = dict(map(tuple, docs.collect()))
    sets = {i: shingles(t) for i, t in texts.items()}
    by = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    pairs = {(a, b) for own in by.values() for a in own for b in own if a < b}
    label = {i: i for i in texts}
    for a, b in sorted(pairs):
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and label[a] != label[b]:
            low, high = sorted((label[a], label[b]))
            label = {k: low if v == high else v for k, v in label.items()}
    wordless = [i for i, s in sets.items() if not s]
    for i in wordless:
        label[i] = min(wordless)
    for large in (256, 2):
        assert {r.id: r.component for r in simhash.similar_classes(docs, large=large).collect()} == label
