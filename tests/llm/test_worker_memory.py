"""What stages take of a worker, and leave in it."""

import tracemalloc
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from leafseason.llm import langid


def rss() -> int:
    return int(Path("/proc/self/statm").read_text().split()[1]) * 4096


def function_of(model: langid.Model):
    """What the language stage runs in a worker."""
    conf = SimpleNamespace(get=lambda *_: None, set=lambda *_: None)
    context = SimpleNamespace(broadcast=lambda x: SimpleNamespace(value=x))
    docs = SimpleNamespace(sparkSession=SimpleNamespace(conf=conf, sparkContext=context), schema=None, mapInArrow=lambda run, schema: run)
    return langid.keep_identified(docs, model)


def test_the_language_stage_scores_little_text_at_once():
    rng = np.random.default_rng(3)
    langs = ["de", "en", "es", "fr"]
    words = ["".join(map(chr, 97 + rng.integers(0, 26, 5))) for _ in range(3000)]
    model = langid.Model.of(langs, [(0, w) for w in words for _ in langs], langs * len(words), np.tile([1.0, 2, 3, 4], len(words)))
    texts = [" ".join(words[i] for i in rng.integers(0, len(words), 3000)) for _ in range(400)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    tracemalloc.start()
    kept = sum(b.num_rows for b in function_of(model)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert kept == len(texts)
    assert peak < 64 << 20


def test_a_worker_keeps_no_free_memory(monkeypatch):
    last = []

    def judge(self, texts):
        many = [bytes(50_000) for _ in range(4000)]
        last.append(many.pop())  # in use above all that is free
        return ["en"] * len(texts), np.ones(len(texts)), np.ones(len(texts), np.int64)

    monkeypatch.setattr(langid.Scorer, "judge", judge)
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["x"])], names=["doc_id", "text"])
    before = rss()
    assert sum(b.num_rows for b in function_of(langid.Model.of([], [], [], np.zeros(0)))(iter([batch]))) == 1
    assert rss() - before < 50 << 20
