"""Exact top-k inner products over integer vectors with an impact-ordered score-at-a-time index.

Each component x becomes floor(256 * x). Different vectors are dealt to blocks. A block files its vectors under (dimension,
quantised value): one posting segment each. A query visits the segments of all dimensions in descending order of the
absolute impact that the quantised value can have, adds lower bounds of the impacts to the vectors' accumulators, and knows
after each round what the segments not yet visited can add at most and at least. It stops only when these bounds prove that
every vector outside the leading ones is beaten; the vectors that may still belong to the result are scored exactly.

Equal vectors are searched once, as queries and as candidates: a class of equal vectors hands on its k + 1 smallest ids,
since no other of its rows can be among a query's k best; the ids are limited before the shuffle.

Vectors that are null or hold null or non-finite components take no part; shorter vectors count as ended by zeros; rows
that repeat a vec_id and its vector count once, a row with the query's id is the query's own, rows without an id take no
part. Scores must fit in 64 bits. Query blocks meet all candidate blocks, as a stated query set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafseason.llm.common import ship

ship(__name__)

LEVELS = 16
ROUNDS = 6


def _matrix(column: pa.Array) -> np.ndarray:
    lists = column.to_pylist()
    out = np.zeros((len(lists), max(map(len, lists), default=0)), np.int64)
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


class ImpactIndex:
    """Posting segments of one block of vectors."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        n, self.dims = vectors.shape
        most = int(np.abs(vectors).max(initial=0))
        self.shift = max(0, most.bit_length() + 1 - LEVELS.bit_length() + 1)
        level = vectors >> self.shift
        self.low = int(level.min(initial=0))
        self.levels = int(level.max(initial=0)) - self.low + 1
        key = (level - self.low) + np.arange(self.dims) * self.levels
        flat = key.T.ravel()  # by dimension
        order = np.argsort(flat, kind="stable")
        self.posting = (order % n).astype(np.int32) if n else order.astype(np.int32)
        self.begin = np.searchsorted(flat[order], np.arange(self.dims * self.levels + 1))
        self.dim = np.repeat(np.arange(self.dims), self.levels)
        self.least = np.tile((np.arange(self.levels) + self.low) << self.shift, self.dims)

    def search(self, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of all vectors that score no less than the k-th best."""
        n = len(self.vectors)
        own = np.zeros(self.dims, np.int64)
        own[: min(len(query), self.dims)] = query[: self.dims]
        q = own[self.dim]
        ends = q.astype(np.float64) * np.stack((self.least, self.least + float((1 << self.shift) - 1)))
        low, high = ends.min(axis=0), ends.max(axis=0)
        # Bounds are exact up to 2**52; beyond, what rounding may have cost is taken off the bar.
        reach = np.maximum(np.abs(low), np.abs(high)).reshape(self.dims, -1).max(axis=1, initial=0).sum()
        error = 0.0 if reach < 2**52 else reach * 2.0**-50 * (self.dims + 4)
        used = np.flatnonzero(np.diff(self.begin) > 0)
        order = used[np.argsort(-np.maximum(np.abs(low[used]), np.abs(high[used])), kind="stable")]
        floor, slack = np.zeros(n), np.zeros(n)
        steps = np.linspace(0, len(order), ROUNDS + 1).astype(int)
        members = np.arange(n)
        for a, b in zip(steps, steps[1:]):  # noqa: B905
            part = order[a:b]
            sizes = self.begin[part + 1] - self.begin[part]
            if len(part):
                rows = np.concatenate([self.posting[self.begin[s] : self.begin[s + 1]] for s in part])
                floor += np.bincount(rows, np.repeat(low[part], sizes), n)
                slack += np.bincount(rows, np.repeat(high[part] - low[part], sizes), n)
            left = order[b:]
            more, less = np.zeros(self.dims), np.zeros(self.dims)
            np.maximum.at(more, self.dim[left], high[left])
            np.minimum.at(less, self.dim[left], low[left])
            sure = floor + less.sum()
            bar = np.partition(sure, n - k)[n - k] if n > k else -np.inf
            members = np.flatnonzero(floor + slack + more.sum() >= bar - error)
            if len(members) <= 4 * k:  # proof: all others are beaten by k vectors
                break
        score = self.vectors[members] @ own
        if len(score) > k:
            keep = score >= np.partition(score, len(score) - k)[len(score) - k]
            members, score = members[keep], score[keep]
        return members, score


def _block(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    """Best classes of one candidate block for one block of queries."""
    schema = pa.schema([("qkey", pa.int64()), ("ckey", pa.int64()), ("score", pa.int64())])
    if not left.num_rows or not right.num_rows:
        return schema.empty_table()
    index = ImpactIndex(_matrix(right.column("ints")))
    keys = np.asarray(right.column("ckey"))
    out: list[tuple] = []
    for qkey, query in zip(left.column("qkey").to_pylist(), _matrix(left.column("ints")), strict=True):
        # A class has at least one row other than the query, or is the query's own class; k + 1 classes always suffice.
        at, score = index.search(query, k + 1)
        if len(at) > k + 1:
            best = np.lexsort((keys[at], -score))[: k + 1]
            at, score = at[best], score[best]
        out.append((np.full(len(at), qkey), keys[at], score))
    return pa.table([np.concatenate([x[i] for x in out]) for i in range(3)], schema=schema)


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", block: int = 8192, query_block: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each query, a row whose id is divisible by `every`; ties to smaller ids."""
    v = F.col(vector_col)
    whole = v.isNotNull() & F.col(id_col).isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ints = F.transform(v, lambda x: F.floor(x.cast("double") * 256).cast("long"))
    rows = vectors.where(whole).select(F.col(id_col).cast("long").alias("id"), ints.alias("ints"))
    # dense_rank below a limit is cut down before the shuffle, so that a class of any size sends k + 1 ids a task.
    least = rows.withColumn("r", F.dense_rank().over(Window.partitionBy("ints").orderBy("id"))).where(F.col("r") <= k + 1).distinct()
    classes = least.groupBy("ints").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("ckey"), "ints", "ids")
    asked = rows.where(F.col("id") % every == 0).distinct()
    grouped = asked.groupBy("ints").agg(F.min("id").alias("qkey"))
    n_blocks = max(1, -(-classes.count() // block))
    n_queries = max(1, -(-grouped.count() // query_block))
    pair = (F.col("c") * n_queries + F.col("q")).cast("long").alias("pair")
    candidates = classes.select("ckey", "ints", F.pmod(F.xxhash64("ckey"), F.lit(n_blocks)).alias("c"), F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))).alias("q")).select("ckey", "ints", pair)
    queries = grouped.select("qkey", "ints", F.pmod(F.xxhash64("qkey"), F.lit(n_queries)).alias("q"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("c")).select("qkey", "ints", pair)
    found = queries.groupBy("pair").cogroup(candidates.groupBy("pair")).applyInArrow(lambda a, b: _block(a, b, k), "qkey long, ckey long, score long")
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("qkey").orderBy(F.desc("score"), "ckey"))).where(F.col("r") <= k + 1)
    # All ids of a class that may count, then of them the k best for each query id.
    listed = best.join(classes.select("ckey", "ids"), "ckey").select("qkey", "score", F.explode("ids").alias("vec_id"))
    led = listed.withColumn("r", F.row_number().over(Window.partitionBy("qkey").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + 1)
    ids = asked.join(grouped, "ints").select(F.col("id").alias("query_id"), "qkey").distinct()
    answers = ids.join(led, "qkey").where("query_id != vec_id").select("query_id", "vec_id", "score")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return answers.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(x::double * 256)::bigint) as ints from embeddings
  where embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.ints::double[], c.ints::double[])::bigint as score from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id)
select query_id, rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s) where rank <= 5
"""
