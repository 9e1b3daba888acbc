"""Language identification, word first with backoff to characters.

Words are runs of letters and marks, in lower case. A word that the model knows scores each language by the negative logarithm
of its share among that language's words. An unknown word backs off to its character n-grams, bounded by blanks: to the longest
length of which the model knows at least one, scored by the mean over the known ones; a word without any known character is
passed over. What a language has not seen costs the penalty. A text's score is the mean over its words, and the language with
the lowest mean wins (ties: by name).

Training takes about `per_lang` documents of each language, and of all languages about `sample_bytes` of text at most, chosen
by a hash of id and text, so that any size of corpus trains a model of bounded size; counts run over whole texts. The model
holds all words and n-grams of these documents (or, on demand, the most frequent ones), each with the languages that have it.

Texts that are null or hold no letter are `und` with score 0, and so are all texts when there is nothing to learn from.
Rows may repeat, null ids count as held out, empty tables give empty results, other columns are not looked at. Texts of any
length are scored whole; one must fit in a worker's memory some times over.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafseason.llm.common import batches_by_bytes, bounded, held_out, lean, ship, small_batches

ship(__name__)

BETWEEN = r"[^\p{L}\p{M}]+"
LONGEST = 4
PENALTY = 7.0
UNKNOWN = "und"
SLICE = 4 << 20  # bytes of training text counted together
SCORED = 1 << 20  # bytes of text scored together, which take some 40 times as much memory
CELLS = 1 << 22  # documents times languages scored together


@dataclass
class Model:
    """What a language saves against the penalty (its gain) for each word or n-gram that it has, row by row."""

    langs: list[str]
    words: dict[str, int]  # to rows
    grams: list[dict[str, int]]  # n-grams by length, to rows
    start: np.ndarray  # a row's first entry, and past the last row the number of entries
    lang: np.ndarray
    gain: np.ndarray

    @classmethod
    def of(cls, langs: list[str], keys: list[tuple[int, str]], names: list[str], costs: np.ndarray) -> Model:
        """A model from costs of keys, each a length (0: a word) and a text, in languages."""
        tables: list[dict[str, int]] = [{} for _ in range(LONGEST + 1)]
        row = np.empty(len(keys), np.int64)
        size = 0
        for i, (n, x) in enumerate(keys):
            row[i] = at = tables[n].setdefault(x, size)
            size += at == size
        order = np.argsort(row, kind="stable")
        number = {x: i for i, x in enumerate(langs)}
        lang = np.array([number[x] for x in names], np.int32)
        return cls(langs, tables[0], tables, np.searchsorted(row[order], np.arange(size + 1)), lang[order], (PENALTY - np.asarray(costs, np.float64))[order].astype(np.float32))

    def entries(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the entries of all rows, one after the other, and how many each row has."""
        n = self.start[rows + 1] - self.start[rows]
        first = np.cumsum(n) - n
        return np.repeat(self.start[rows] - first, n) + np.arange(n.sum()), n


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """The texts' words in order: each one's text by number, and the word."""
    lower = pa.compute.utf8_lower(pa.compute.fill_null(texts.cast(pa.large_string()), ""))
    parts = pa.compute.split_pattern_regex(lower, BETWEEN)
    owner, words = np.asarray(pa.compute.list_parent_indices(parts)), pa.compute.list_flatten(parts)
    real = pa.compute.greater(pa.compute.binary_length(words), 0)  # blanks at a text's ends leave empty parts
    return owner[np.asarray(real)], words.filter(real).dictionary_encode()


def grams_of(word: str, n: int) -> list[str]:
    padded = f" {word} " if n > 1 else word
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and n-grams of the training texts, summed over some texts at a time."""
    for batch in batches_by_bytes(batches, "text", SLICE):
        names = batch.column("lang").to_pylist()
        seen: dict[str, Counter] = {}
        owner, words = words_of(batch.column("text"))
        spelled, at = words.dictionary.to_pylist(), np.asarray(words.indices)
        # Pairs of a word and a language, counted.
        number = {x: i for i, x in enumerate(dict.fromkeys(names))}
        pair, times = np.unique(at.astype(np.int64) * len(number) + np.array([number[x] for x in names], np.int64)[owner], return_counts=True)
        for p, n in zip(pair.tolist(), times.tolist(), strict=True):
            seen.setdefault(list(number)[p % len(number)], Counter())[spelled[p // len(number)]] = n
        for lang, own in seen.items():
            for size in range(LONGEST + 1):
                found: Counter = own if size == 0 else Counter()
                if size:
                    for word, n in own.items():
                        for g in grams_of(word, size):
                            found[g] += n
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found)), pa.array([size] * len(found), pa.int32()), pa.array(list(found)), pa.array(list(found.values()), pa.int64())], names=["lang", "size", "gram", "n"])


def train(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_lang: int = 1500,
    sample_bytes: int = 32 << 20,
    max_words: int | None = None,
    max_grams: int | None = None,
) -> Model:
    """Learn from rows that are not held out and have a language.

    per_lang and sample_bytes bound the sample, and with it the model. max_words and max_grams, if given, keep the most
    frequent words and n-grams of each length for each language (ties by text).
    """
    rows = docs.where(F.col(lang_col).isNotNull() & ~held_out(F.col(id_col))).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("count"), F.sum(F.octet_length("text").cast("long")).alias("bytes"))
    share = sample_bytes / max(1, sizes.count())
    chance = F.least(F.lit(1.0), F.lit(float(per_lang)) / F.col("count"), F.lit(share) / F.greatest(F.col("bytes"), F.lit(1)))
    draw = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 40)) / float(1 << 40)
    sample = rows.join(bounded(sizes, 10_000), "lang").where(draw < chance).select("lang", "text")
    counts = sample.mapInArrow(lean(_count), "lang string, size int, gram string, n long").groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))
    if max_words is not None or max_grams is not None:
        # What is left out still counts in the sums.
        most = F.when(F.col("size") == 0, max_words).otherwise(max_grams)
        counts = counts.withColumn("r", F.row_number().over(Window.partitionBy("lang", "size").orderBy(F.desc("n"), "gram")))
        counts = counts.withColumn("gram", F.when(most.isNull() | (F.col("r") <= most), F.col("gram"))).groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))
    found = counts.toArrow()  # bounded by the sample
    lang, size, n = found["lang"].to_pylist(), found["size"].to_numpy(), found["n"].to_numpy()
    langs = sorted(set(lang))
    number = {x: i for i, x in enumerate(langs)}
    group = np.array([number[x] for x in lang], np.int64) * (LONGEST + 1) + size
    costs = -np.log10(n / np.bincount(group, n, len(langs) * (LONGEST + 1))[group])
    kept = [i for i, g in enumerate(found["gram"].is_valid().to_pylist()) if g]
    grams = found["gram"].to_pylist()
    del found
    return Model.of(langs, [(int(size[i]), grams[i]) for i in kept], [lang[i] for i in kept], costs[kept])


class Scorer:
    """Scores texts, some at a time."""

    def __init__(self, model: Model):
        self.model = model

    def backoff(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words' n-grams of the longest length that has known ones: each one's word by number, row and weight."""
        owner: list[int] = []
        rows: list[int] = []
        left = list(range(len(words)))
        for n in range(LONGEST, 0, -1):
            get, missed = self.model.grams[n].get, []
            for i in left:
                w = f" {words[i]} " if n > 1 else words[i]
                known = [r for k in range(len(w) - n + 1) if (r := get(w[k : k + n])) is not None]
                if known:
                    rows += known
                    owner += [i] * len(known)
                else:
                    missed.append(i)
            left = missed
        of = np.array(owner, np.int64)
        return of, np.array(rows, np.int64), 1 / np.bincount(of, minlength=len(words))[of]

    def _entries(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Languages and gains of distinct words, one word after the other, how many entries each has, and whether it counts."""
        rows = np.fromiter((self.model.words.get(w, -1) for w in words), np.int64, len(words))
        has, lacks = np.flatnonzero(rows >= 0), np.flatnonzero(rows < 0)
        of, more, weight = self.backoff([words[i] for i in lacks.tolist()])
        of, more, weight = np.concatenate((has, lacks[of])), np.concatenate((rows[has], more)), np.concatenate((np.ones(len(has)), weight))
        at, n = self.model.entries(more)
        of, gain = np.repeat(of, n), self.model.gain[at] * np.repeat(weight, n)
        counts = np.zeros(len(words), bool)
        counts[of] = True
        order = np.argsort(of, kind="stable")
        return self.model.lang[at][order], gain[order], np.bincount(of, minlength=len(words)), counts

    def judge(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and the number of words that the model knows or backs off for, of each text."""
        out: tuple[list, list, list] = ([], [], [])
        step = max(1, CELLS // max(1, len(self.model.langs)))
        for at in range(0, len(texts), step):
            for all_of, part in zip(out, self._judge(texts.slice(at, step)), strict=True):
                all_of.append(part)
        return [x for part in out[0] for x in part], *(np.concatenate(o) if o else np.zeros(0) for o in out[1:])

    def _judge(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        docs, size = len(texts), len(self.model.langs)
        owner, words = words_of(texts)
        if not size or not len(owner):
            return [UNKNOWN] * docs, np.zeros(docs), np.zeros(docs, np.int64)
        which = np.asarray(words.indices)
        lang, gain, number, counts = self._entries(words.dictionary.to_pylist())
        n = number[which]
        first = np.cumsum(number) - number
        place = np.repeat(first[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        total = np.bincount(np.repeat(owner, n) * size + lang[place], gain[place], docs * size).reshape(docs, size)
        known = np.bincount(owner, counts[which], docs).astype(np.int64)
        mean = total / np.maximum(known, 1)[:, None]
        best = mean.argmax(axis=1)
        odds = np.exp((mean - mean.max(axis=1, keepdims=True)) * np.log(10) * np.clip(known, 1, 5)[:, None])
        letters = np.asarray(pa.compute.fill_null(pa.compute.match_substring_regex(texts.cast(pa.large_string()), r"\p{L}"), False))
        score = np.where(letters, 1 / odds.sum(axis=1), 0.0)
        return [self.model.langs[b] if has else UNKNOWN for b, has in zip(best.tolist(), letters.tolist(), strict=True)], score, known


def _shared(docs: DataFrame, model: Model):
    return docs.sparkSession.sparkContext.broadcast(vars(model))  # bounded by the sample that it was learnt from


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, lang_pred and score (0 to 1, the winner's share) of every row."""
    small_batches(docs.sparkSession)
    shared = _shared(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Model(**shared.value))
        for batch in batches_by_bytes(batches, "text", SCORED):
            langs, score, _ = scorer.judge(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(score, pa.float64())], names=["id", "held_out", "lang_pred", "score"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return source.mapInArrow(lean(run), "id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text", min_score: float = 0.3) -> DataFrame:
    """Rows of docs whose language is known with at least min_score, with all their columns.

    Dropped are texts without a letter, texts without any known word or n-gram, however large a share the languages have by
    default, and texts whose best language has less than min_score (with one to three languages there are none).
    """
    small_batches(docs.sparkSession)
    shared = _shared(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Model(**shared.value))
        for batch in batches_by_bytes(batches, text_col, SCORED):
            langs, score, known = scorer.judge(batch.column(text_col))
            told = np.array([x != UNKNOWN for x in langs], bool)
            yield batch.filter(pa.array(told & (known > 0) & (score >= min_score)))

    return docs.mapInArrow(lean(run), docs.schema)
