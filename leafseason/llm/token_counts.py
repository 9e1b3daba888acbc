"""Token counts with the sentencepiece library, returning lengths only.

Texts go to the library in slices balanced by bytes. Longer texts are cut at safe boundaries: at a blank whose left
neighbour is no blank and that is not the last character. No piece of such a vocabulary has a blank after another
character (this is verified when the model is loaded; otherwise nothing is cut), and the library writes a blank before each
text, so the part after the cut leaves its own blank out and gets the same tokens as inside the whole text.

A text without safe blanks, such as one in a script without blanks, is encoded whole. Null texts count as empty, empty texts
have no tokens, repeated rows are counted each, empty tables give empty results, other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafseason.llm.common import batches_by_bytes, once, ship

ship(__name__)

BLANK = "▁"  # what the vocabulary writes for a blank
SLICE = 1 << 20
SAFE = regex.compile(f"(?<=[^ {BLANK}]) (?=.)", regex.DOTALL)


def _model(path: str):
    def load():
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        inner = any(BLANK in model.id_to_piece(i).lstrip(BLANK) for i in range(model.get_piece_size()))
        plain = model.encode("a b  c", out_type=str) == model.encode("a", out_type=str) + model.encode("b  c", out_type=str)
        return model, plain and not inner

    return once(("sentencepiece", path), load)


def cut(text: str, limit: int) -> list[str]:
    """Parts of at least limit characters each but for the last, cut at safe boundaries."""
    parts, at = [], 0
    while len(text) - at > 2 * limit and (found := SAFE.search(text, at + limit)):
        parts.append(text[at : found.start()])
        at = found.end()
    return [*parts, text[at:]]


def count_tokens(texts: list[str], path: str, limit: int = 1 << 15) -> np.ndarray:
    """Number of tokens of each text."""
    model, safe = _model(path)
    parts, owner = [], []
    for i, x in enumerate(texts):
        own = cut(x, limit) if safe and len(x) > 2 * limit else [x]
        parts += own
        owner += [i] * len(own)
    counts = np.fromiter(map(len, model.encode(parts, num_threads=1)), np.int64, len(parts)) if parts else np.zeros(0, np.int64)
    return np.bincount(np.array(owner, np.int64), weights=counts, minlength=len(texts)).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for batch in batches_by_bytes(batches, "text", SLICE):
        made = count_tokens([x or "" for x in batch.column("text").to_pylist()], path)
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), pa.array(made)], names=["id", "n_bytes", "n_tokens"])


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", over: int = 4096) -> DataFrame:
    """id, n_bytes, n_tokens and over_limit (more than `over` tokens) of every row. The model file must be readable on every executor."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    return source.mapInArrow(lambda b: _counts(b, path), "id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > over)
