"""Quality classifier: histogram gradient-boosted trees over document statistics.

A document becomes a row of statistics of its text alone. Training takes about `sample` labelled rows, chosen by a hash of
the id, that are not held out, bins each statistic into at most `BINS` quantile bins, and grows `trees` trees of fixed depth
on the logistic loss. The trees are flattened into arrays (feature, threshold, leaf value by node number), and scoring
walks all rows and trees together, level by level, with numpy.

A null text counts as empty and is scored like any other. Labels that are null are not learnt from; labels of one id are
averaged, and of documents that share an id the one with the least statistics is learnt from, so each id counts once. Without
both labels to learn from, every score is the mean label (0.5 without any). Null ids count as held out. Repeated rows are
scored each, empty tables give empty results, other columns are not looked at. Texts of any length are read whole; a task
holds one text's words at a time, so a text must fit in a worker's memory some times over.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafseason.llm.common import held_out, materialise, ship, small_batches, text_bytes

ship(__name__)

BINS = 64
STATISTICS = "n_bytes n_words n_lines word_len word_len_sd longest_word upper lower digit blank punct high rare_marks pipes bangs stops upper_words short_words distinct_words distinct_lines top_word sentence_len end_marked shape_entropy distinct_pairs".split()

_KIND = np.zeros(256, np.int64)  # 0 other, 1 upper, 2 lower, 3 digit, 4 blank, 5 punctuation, 6 beyond ASCII, 7 rare marks
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[[32, *range(9, 14)]], _KIND[128:] = 1, 2, 3, 4, 6
_KIND[[ord(c) for c in ".,;:?!'\"()-"]] = 5
_KIND[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = 7


def statistics(text: bytes) -> list[float]:
    """The document statistics, in the order of STATISTICS."""
    n = len(text)
    if not n:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    kind = np.bincount(_KIND, weights=counts, minlength=8)
    words = text.split()
    w = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    lines = [x for x in text.split(b"\n") if x.strip()]
    seen = Counter(words)
    share = counts[counts > 0] / n
    ends = int(counts[46] + counts[33] + counts[63])
    return [
        np.log1p(n), np.log1p(len(words)), np.log1p(len(lines)), float(sizes.mean()), float(sizes.std()), np.log1p(float(sizes.max())),
        kind[1] / n, kind[2] / n, kind[3] / n, kind[4] / n, kind[5] / n, kind[6] / n, kind[7] / n, counts[124] / w, counts[33] / w, counts[46] / w,
        sum(x.isupper() for x in words) / w, float((sizes <= 3).mean()), len(seen) / w, len(set(lines)) / max(1, len(lines)),
        max(seen.values(), default=0) / w, w / (1 + ends), sum(x.rstrip().endswith((b".", b"!", b"?")) for x in lines) / max(1, len(lines)),
        float(-(share * np.log2(share)).sum()), len(set(zip(words, words[1:]))) / w,  # noqa: B905
    ]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = np.array([statistics(x) for x in text_bytes(batch.column("text"))], np.float32).reshape(-1, len(STATISTICS))
        lists = pa.ListArray.from_arrays(np.arange(len(made) + 1, dtype=np.int32) * len(STATISTICS), pa.array(made.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), lists], names=["id", "held_out", "x"])


@dataclass
class Trees:
    """Complete trees of one depth; node i of a tree has children 2 i + 1 and 2 i + 2."""

    depth: int
    base: float
    feature: np.ndarray  # tree, inner node
    threshold: np.ndarray  # tree, inner node: larger values go right
    leaf: np.ndarray  # tree, leaf

    def score(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros((len(x), len(self.feature)), np.int64)
        tree = np.arange(len(self.feature))[None, :]
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.threshold[tree, node])
        raw = self.base + self.leaf[tree, node - (2**self.depth - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-raw))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, ridge: float = 1.0, least: int = 8) -> Trees:
    """Boost trees on the logistic loss, with splits found in histograms of gradients."""
    inner = 2**depth - 1
    out = Trees(depth, 0.0, np.zeros((0, inner), np.int64), np.zeros((0, inner), np.float32), np.zeros((0, 2**depth)))
    mean = float(y.mean()) if len(y) else 0.5
    if not len(y) or not 0 < mean < 1:
        out.base = 0.0 if not len(y) else 8.0 * (2 * mean - 1)
        return out
    out.base = float(np.log(mean / (1 - mean)))
    m = x.shape[1]
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1]).astype(np.float32)) for f in range(m)]
    binned = np.stack([np.searchsorted(cuts[f], x[:, f], "left") for f in range(m)], axis=1)  # bin b: above cut b - 1
    raw = np.full(len(y), out.base)
    features, thresholds, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf, np.float32)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            at = node - first
            best = np.full(width, 1e-6)
            which, where = np.zeros(width, np.int64), np.full(width, -1)
            for f in range(m):
                key = at * BINS + binned[:, f]
                g, h, c = (np.bincount(key, v, width * BINS).reshape(width, BINS).cumsum(axis=1) for v in (grad, hess, None))
                lg, lh, lc = g[:, :-1], h[:, :-1], c[:, :-1]
                rg, rh, rc = g[:, -1:] - lg, h[:, -1:] - lh, c[:, -1:] - lc
                gain = lg**2 / (lh + ridge) + rg**2 / (rh + ridge) - (g[:, -1:] ** 2) / (h[:, -1:] + ridge)
                gain[(lc < least) | (rc < least)] = 0
                top = gain.argmax(axis=1)
                value = gain[np.arange(width), top]
                better = value > best
                best[better], which[better], where[better] = value[better], f, top[better]
            feature[first : first + width] = which
            for k in np.flatnonzero(where >= 0):
                threshold[first + k] = cuts[which[k]][where[k]]
            node = 2 * node + 1 + ((where[at] >= 0) & (binned[np.arange(len(y)), which[at]] > where[at]))
        leaf = node - inner
        value = rate * np.bincount(leaf, grad, inner + 1) / (np.bincount(leaf, hess, inner + 1) + ridge)
        raw += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(value)
    out.feature, out.threshold, out.leaf = np.stack(features), np.stack(thresholds), np.stack(leaves)
    return out


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, x) of every row."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return source.mapInArrow(_features, "id long, held_out boolean, x array<float>")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 20_000, bar: float = 0.3) -> DataFrame:
    """id, held_out, score and predicted (1 from `bar` on) of every row of docs, learnt from labels (id_col, label_col)."""
    small_batches(docs.sparkSession)
    rows = materialise(document_statistics(docs, id_col, text_col), "statistics")
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("double").alias("y")).where("y is not null")
    known = known.where(~held_out(F.col("id"))).groupBy("id").agg(F.avg("y").alias("y"))
    n = known.count()
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / float(1 << 40)
    some = known.where(draw < min(1.0, sample / max(1, n)))  # about `sample` rows of two numbers
    learnt = rows.where("not held_out").select("id", "x").join(F.broadcast(some), "id").groupBy("id").agg(F.min(F.struct("x", "y")).alias("l"))
    found = learnt.select("id", "l.x", "l.y").toPandas().sort_values("id", kind="stable")
    x = np.array(found["x"].tolist(), np.float32).reshape(-1, len(STATISTICS))
    model = docs.sparkSession.sparkContext.broadcast(vars(fit(x, found["y"].to_numpy())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = Trees(**model.value)
        for batch in batches:
            score = trees.score(np.asarray(batch.column("x").flatten()).reshape(-1, len(STATISTICS)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array(score), pa.array((score >= bar).astype(np.int32))], names=["id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, "id long, held_out boolean, score double, predicted int")
