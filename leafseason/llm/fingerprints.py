"""Document fingerprints: one-permutation MinHash of word shingles.

Words are what ASCII blanks part, with A-Z lower-cased; a document's shingles are `SHINGLE` words (a shorter text is one
shingle). The high bits of a shingle's hash name its bin and each bin keeps its smallest hash. An empty bin takes the
value of the filled bin that comes first in a fixed random order of its own (optimal densification). `BITS` low-order bits
of each bin are stored, packed, as lowercase hex. The likeness of two fingerprints is the share of equal bins, corrected
for bins that agree by chance: (p - 2**-b) / (1 - 2**-b), cut to 0..1.

A text without words has the fingerprint of zeros; it is like other such texts (1) and unlike all others (0). Null texts
count as empty. Documents with equal ids follow each other by text (many of them by a hash of it); a null id comes last. Rows
may repeat, empty tables give empty results, other columns are not looked at; a text must fit in a worker's memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafseason.llm.common import batches_by_bytes, bounded, materialise, once, ship, small_batches, tasks_for, total_bytes

ship(__name__)

BINS, BITS, SHINGLE = 512, 4, 5
OUT = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
WALKED = OUT + ", copies long"
RANGE = 128 << 20  # bytes of text in a range of ids
RANGES = 50_000
SAME = 1_000  # rows with one id, beyond which they are told apart by their texts
ZEROS = "0" * (BINS * BITS // 4)


class WordHashes(dict):
    """XXH64 of words, kept for the words met last."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def _orders() -> tuple[np.ndarray, np.ndarray]:
    """For each bin a random order of all bins: the places by bin, and the bins by place."""

    def make():
        by_place = np.argsort(np.random.default_rng(20).random((BINS, BINS)), axis=1)
        place = np.empty_like(by_place)
        np.put_along_axis(place, by_place, np.arange(BINS)[None, :], axis=1)
        return place, by_place

    return once(("orders", BINS), make)


def shingle_hashes(text: str) -> np.ndarray:
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    known = once(("words",), WordHashes)
    w = np.array([known[x] for x in words], np.uint64)
    size = min(SHINGLE, len(w))
    h = np.zeros(len(w) - size + 1, np.uint64)
    for k in range(size):
        h = (h ^ w[k : k + len(h)]) * np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(29)
    return h


def low_bits(hashes: np.ndarray) -> np.ndarray | None:
    """The stored bits of each bin; None without shingles."""
    if not len(hashes):
        return None
    h = np.sort(hashes)
    bins = (h >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.append(True, bins[1:] != bins[:-1]))
    filled = bins[first]
    value = np.zeros(BINS, np.uint64)
    value[filled] = h[first]
    if len(filled) < BINS:
        has = np.zeros(BINS, bool)
        has[filled] = True
        empty = np.flatnonzero(~has)
        place, by_place = _orders()
        if len(filled) < 48:
            value[empty] = value[filled[place[np.ix_(empty, filled)].argmin(axis=1)]]
        else:
            for k in range(BINS):
                pick = by_place[empty, k]
                hit = has[pick]
                value[empty[hit]] = value[pick[hit]]
                empty = empty[~hit]
                if not len(empty):
                    break
    # The bin takes part in the bits, so that a copied value agrees by chance in each bin anew.
    mixed = (value ^ (np.arange(BINS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x9FB21C651E98DF25)
    return (mixed >> np.uint64(64 - BITS)).astype(np.uint8)


def packed(value: np.ndarray | None) -> str:
    if value is None:
        return ZEROS
    bits = np.unpackbits(value[:, None], axis=1)[:, 8 - BITS :]
    return np.packbits(bits.ravel()).tobytes().hex()


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    if a is None or b is None:
        return float(a is b)
    chance = 2.0**-BITS
    return float(min(1.0, max(0.0, ((a == b).mean() - chance) / (1 - chance))))


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted; each is compared with the one after it. A guest row ends its group and is not returned.

    A row that stands for several copies is followed by itself as often as it has copies but one.
    """
    before = None
    names = [x.split()[0] for x in WALKED.split(", ")]
    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2, pa.int64()]
    rows: list[tuple] = []

    def compared(old: tuple, text: str, value: np.ndarray | None, copies: int) -> tuple:
        i, own, own_value = old
        k = len(own) // 3
        edited = own[: len(own) - k] + text[:k]
        changed = low_bits(shingle_hashes(edited))
        return i, len(own), hashlib.sha256(edited.encode()).hexdigest(), packed(own_value), packed(changed), likeness(own_value, changed), likeness(own_value, value), copies

    for batch in batches_by_bytes(batches, "text", 4 << 20):
        for i, guest, text, copies in zip(*(batch.column(c).to_pylist() for c in ("id", "guest", "text", "copies")), strict=True):
            value = low_bits(shingle_hashes(text))
            if before is not None:
                rows.append(compared(before, text, value, 1))
            before = None if guest else (i, text, value)
            if before is not None and copies > 1:
                rows.append(compared(before, text, value, copies - 1))
            if len(rows) >= 500:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def bounds_of(cuts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Where ranges of (place, hash) begin: at each cut, and where one place takes several cuts also at even steps of its hashes."""
    places, times = np.unique(np.array(cuts, np.int64), return_counts=True)
    place = np.repeat(places, times)
    step = np.concatenate([np.arange(n) for n in times]) if len(times) else np.zeros(0, np.int64)
    share = [-(2**63) + int(k) * 2**64 // int(n) for k, n in zip(step, np.repeat(times, times), strict=True)]
    return place, np.array(share, np.int64)


def range_of(place: np.ndarray, mark: np.ndarray, bounds: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How many ranges begin at or before each (place, hash)."""
    first, last = (np.searchsorted(bounds[0], place, side) for side in ("left", "right"))
    out = last.copy()
    for p in np.unique(place[last - first > 1]):  # places with several ranges
        own = place == p
        a, b = np.searchsorted(bounds[0], p, "left"), np.searchsorted(bounds[0], p, "right")
        out[own] = a + np.searchsorted(bounds[1][a:b], mark[own], "right")
    return out.astype(np.int32)


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", each: int = RANGE) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last third is replaced from the next document.

    The next document is the one with the next smaller id, after the last the first. The texts move once: ids are cut into
    ranges of about `each` bytes (no fewer than the shuffle partitions, no more than RANGES), and each range gets the first
    document of the following range as a guest. Rows that share an id beyond SAME are also cut by a hash of their texts, in
    whose order they then follow each other; equal ones among them move once, with their number.
    """
    spark = docs.sparkSession
    small_batches(spark)
    # Descending ids; null comes last.
    place = -F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63) + 1))
    plain = docs.select(F.col(id_col).cast("long").alias("id"), place.alias("place"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    shared = materialise(plain.groupBy("place").agg(F.count("*").alias("rows")).where(F.col("rows") > SAME).select("place"), "shared")
    crowded = not shared.isEmpty()
    if crowded:
        hot = bounded(shared, 500_000)
        alone = plain.join(hot, "place", "left_anti").select("id", "place", F.lit(0).cast("long").alias("mark"), "text", F.lit(1).cast("long").alias("copies"))
        some = plain.join(hot, "place", "left_semi").withColumn("mark", F.xxhash64("text"))
        counts = some.groupBy("id", "place", "mark").agg(F.count("*").alias("copies"), F.min("text").alias("least"), F.max("text").alias("most"))
        # Two texts with one hash stay rows of their own.
        equal = counts.where("least = most").select("id", "place", "mark", F.col("least").alias("text"), "copies")
        unlike = some.join(counts.where("least != most").select("place", "mark"), ["place", "mark"], "left_semi").select("id", "place", "mark", "text", F.lit(1).cast("long").alias("copies"))
        source = alone.unionByName(materialise(equal, "equal")).unionByName(unlike)
    else:
        source = plain.select("id", "place", F.lit(0).cast("long").alias("mark"), "text", F.lit(1).cast("long").alias("copies"))
    n = min(RANGES, tasks_for(spark, total_bytes(docs, text_col), each))
    cuts = source.agg(F.percentile_approx("place", [k / n for k in range(1, n)] or [0.5], F.lit(20 * n + 1000))).first()[0]
    bounds = bounds_of(list(cuts or []))
    held = spark.sparkContext.broadcast(bounds)  # at most RANGES rows

    def part_of(place: pd.Series, mark: pd.Series) -> pd.Series:
        return pd.Series(range_of(place.to_numpy(), mark.to_numpy(), held.value))

    part_of.__annotations__ = {"place": pd.Series, "mark": pd.Series, "return": pd.Series}
    part = F.pandas_udf(part_of, "int")
    ranged = source.withColumn("part", part("place", "mark"))
    firsts = {r[0]: tuple(r[1]) for r in ranged.groupBy("part").agg(F.min(F.struct("place", "mark"))).collect()}  # one row a range
    parts = sorted(firsts)
    rows = ranged.select("id", "place", "mark", "text", "part", F.lit(False).alias("guest"), "copies")
    if parts:
        guests = spark.createDataFrame([(*firsts[b], a) for a, b in zip(parts, [*parts[1:], *parts[:1]])], "place long, mark long, part int")  # noqa: B905
        found = source.join(F.broadcast(guests), ["place", "mark"]).groupBy("place", "mark", "part").agg(F.min("text").alias("text"))
        rows = rows.unionByName(found.select(F.lit(None).cast("long").alias("id"), "place", "mark", "text", "part", F.lit(True).alias("guest"), F.lit(1).cast("long").alias("copies")))
    dealt = rows.repartitionById(len(bounds[0]) + 1, F.col("part")).sortWithinPartitions("part", "guest", "place", "mark", "text")
    walked = dealt.select("id", "guest", "text", "copies").mapInArrow(_walk, WALKED)
    if not crowded:
        return walked.drop("copies")
    made = materialise(walked, "walked")
    chunk = F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / SAME))
    spread = made.where("copies > 1").withColumn("__k", F.explode(chunk)).repartition(tasks_for(spark, 0, 1))
    spread = spread.withColumn("__n", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(SAME).cast("long"), F.col("copies") - F.col("__k") * SAME))))
    return made.where("copies = 1").drop("copies").unionByName(spread.drop("copies", "__k", "__n"))
