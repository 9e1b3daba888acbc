import hashlib
import tracemalloc
import types

import numpy as np
import pyarrow as pa
from leafseason.llm import bpe
from leafseason.llm.queries import tokenizer_path


def test_a_block_of_many_words_is_joined_in_pieces(monkeypatch):
    """What is held besides the words' own ids and texts doesn't grow with the words of a block."""
    path = tokenizer_path("byte_bpe_50k.json")
    monkeypatch.setattr(bpe, "TaskContext", types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 0)))
    rng = np.random.default_rng(6)
    words = ["".join(map(chr, 97 + rng.integers(0, 26, 12))) for _ in range(150_000)]
    texts = [" ".join(words[a : a + 500]) for a in range(0, len(words), 500)] + ["", None, " ".join(words[::700])]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["__id", "__text"])
    sort = lambda made, *by: pa.Table.from_batches(made).sort_by([(c, "ascending") for c in by]).to_batches(max_chunksize=50)
    split = sort(bpe.split_blocks(iter([batch]), path, 7, 1 << 30), "kind", "class")
    coded = sort(bpe.encode_words(iter(split), path), "block", "kind", "class")
    tracemalloc.start()
    rows = [r for b in bpe.join_positions(iter(coded), path, False) for r in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    tokenizer = bpe._tokenizer(path)[0]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in rows:
        ids = tokenizer.encode(texts[r["id"]] or "", add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(texts[r["id"]] or ""))
    assert len(rows) == len(texts)
    assert peak < 600 * len(words)
