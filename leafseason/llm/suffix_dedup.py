"""Removal of long repeated byte strings with a run-length compressed index.

Every string of `width` bytes is filed under its minimizer: the gram of `GRAM` bytes inside it with the smallest hash
(leftmost on ties). Neighbouring strings of a document that share the minimizer's place form one segment, so equal strings
always meet under the same gram, whatever documents they come from. Grams that occur once are left aside at once. Equal
segments of the others are counted, by 128 bits of content hash besides the gram's 64, and enter the index once with their
number; a number above one marks the whole segment. Grams with several different segments go, gram by gram, into a run-length
index: suffix order, Burrows-Wheeler transform, its runs, and the longest common prefixes sampled at run ends. Matching
statistics of every position against all other positions then stream from those samples, because between run ends they fall
by one a byte; there strings are compared byte by byte.

A gram with more than `hot` different segments is not gathered in one task: its strings are filed anew under longer grams,
again and again up to the whole string, until no gram has more, and each level is counted and indexed like the first.

Texts that are null count as empty, documents shorter than `width` lose nothing, repeated rows are documents of their own
(and so repeat each other), an empty table gives an empty result, and other columns are never looked at. Long texts are
scanned piece by piece; a text itself must fit in a worker's memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafseason.llm.common import bounded, lean, materialise, once, ship, small_batches, text_bytes

ship(__name__)

GRAM = 32
CHUNK = 1 << 17  # string starts handled at a time, so that long texts need little memory
BASES = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F  # two content hashes
BUCKET = 1 << 20  # bytes of segments indexed together
COPIES = 64  # rows of one text and id, beyond which they are spread over tasks

GRAMS = "h long, n long"
ROWS = "h long, c long, d long, n long, k1 long, k2 long, lo long, ns int"
REFILED = ROWS + ", seg binary"
SEGMENTS = "h long, n long, k1 long, k2 long, lo long, ns int, seg binary"
MARKS = "k1 long, k2 long, lo long, hi long"
ADDED = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]


def levels(width: int) -> list[int]:
    """Lengths of the grams under which strings are filed: the first, longer ones for grams with too many segments, the whole string."""
    return sorted({GRAM, max(GRAM, width // 2), max(GRAM, width * 4 // 5), width})


def powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of base and of its inverse modulo 2**64."""

    def of(x: int) -> np.ndarray:
        p = np.full(n, x, np.uint64)
        p[0] = 1
        return np.multiply.accumulate(p)

    return once(("powers", n, base), lambda: (of(base), of(pow(base, -1, 2**64))))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    for _ in range(2):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours, from running minima within blocks of w."""
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def segments(text: bytes, width: int, gram: int, content: bool = True) -> Iterator[tuple[np.ndarray, ...]]:
    """For each chunk of a text: gram hash and, with content, two content hashes, first start and number of starts of its segments."""
    whole = np.frombuffer(text, np.uint8)
    place_bits = np.uint64((1 << (CHUNK + width).bit_length()) - 1)
    # Short texts share the tables of a whole chunk.
    (power, inverse), (power2, inverse2) = (powers(CHUNK + width, b) for b in BASES)
    for at in range(0, len(whole) - width + 1, CHUNK):
        data = whole[at : at + CHUNK + width - 1].astype(np.uint64) + np.uint64(1)
        n = len(data)
        # Sums of (byte + 1) * base**place; differences give the hash of any stretch.
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(data * power[:n], dtype=np.uint64)))
        own = mixed((sums[gram:] - sums[:-gram]) * inverse[: n - gram + 1])
        packed = (own & ~place_bits) | np.arange(len(own), dtype=np.uint64)
        place = (sliding_min(packed, width - gram + 1) & place_bits).astype(np.int64)
        lo = np.concatenate(([0], np.flatnonzero(place[1:] != place[:-1]) + 1))
        if not content:
            yield (own[place[lo]].view(np.int64),)
            continue
        hi = np.append(lo[1:], len(place))
        end = hi + width - 1
        sums2 = np.concatenate((np.zeros(1, np.uint64), np.cumsum(data * power2[:n], dtype=np.uint64)))
        length = (end - lo).astype(np.uint64) << np.uint64(40)
        c = mixed(((sums[end] - sums[lo]) * inverse[lo]) ^ length)
        d = mixed(((sums2[end] - sums2[lo]) * inverse2[lo]) ^ length)
        yield own[place[lo]].view(np.int64), c.view(np.int64), d.view(np.int64), lo + at, (hi - lo).astype(np.int32)


def count_grams(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """How many segments each gram has, summed over some texts at a time."""
    held: list[np.ndarray] = []
    size = 0

    def out() -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], names=["h", "n"])

    for batch in batches:
        for text in text_bytes(batch.column("text")):
            for x in segments(text, width, GRAM, False):
                held.append(x[0])
                size += len(x[0])
            if size > 400_000:
                yield out()
                held.clear()
                size = 0
    if held:
        yield out()


def list_segments(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """All segments of each text, as ROWS."""
    for batch in batches:
        k1, k2 = (np.asarray(batch.column(c)) for c in ("k1", "k2"))
        found: list[tuple] = []
        held = 0

        def out(found=found, k1=k1, k2=k2) -> pa.RecordBatch:
            doc = np.concatenate([np.full(len(x[1]), x[0]) for x in found])
            h, c, d, lo, ns = (np.concatenate([x[i] for x in found]) for i in range(1, 6))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (h, c, d, np.ones(len(h), np.int64), k1[doc], k2[doc], lo, ns)], names=["h", "c", "d", "n", "k1", "k2", "lo", "ns"])

        for i, text in enumerate(text_bytes(batch.column("text"))):
            for x in segments(text, width, GRAM):
                found.append((i, *x))
                held += len(x[0])
            if held > 200_000:
                yield out()
                found.clear()
                held = 0
        if found:
            yield out()


def suffix_order(data: np.ndarray, start: np.ndarray, length: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Order of all suffixes within their group by prefix doubling; equal suffixes in order of place."""
    n = len(data)
    rest = np.repeat(start + length, length) - np.arange(n)
    key = np.zeros(n, np.uint64)
    for k in range(5):
        here = np.zeros(n, np.uint64)
        here[: n - k] = data[k:].astype(np.uint64) + np.uint64(1)
        here[rest <= k] = 0
        key = key * np.uint64(257) + here
    key += np.repeat(group.astype(np.uint64) << np.uint64(41), length)
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)

    def classes(slots: np.ndarray, fresh: np.ndarray) -> None:
        """fresh: whether a slot begins a class; a class's rank is its first slot."""
        rank[order[slots]] = slots[np.maximum.accumulate(np.where(fresh, np.arange(len(slots)), 0))]

    sorted_key = key[order]
    fresh = np.append(True, sorted_key[1:] != sorted_key[:-1])
    slots = np.arange(n)
    classes(slots, fresh)
    depth, longest = 5, int(length.max())
    while depth < longest:
        tied = ~fresh
        tied[:-1] |= ~fresh[1:]
        tied &= rest[order[slots]] >= depth
        slots = slots[tied]
        if not len(slots):
            break
        who = order[slots]
        after = np.where(rest[who] > depth, rank[np.minimum(who + depth, n - 1)] + 1, 0)
        both = rank[who] * (n + 1) + after
        by = np.argsort(both, kind="stable")
        order[slots] = who[by]
        both = both[by]
        fresh = np.append(True, both[1:] != both[:-1])
        classes(slots, fresh)
        depth *= 2
    return order


def matching_statistics(data: np.ndarray, start: np.ndarray, length: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For each position the length of the longest string starting there that starts at another place of its group.

    The transform's runs are found from the suffix order; common prefixes are compared only at run ends.
    """
    n = len(data)
    order = suffix_order(data, start, length, group)
    places = np.arange(n)
    rest = np.repeat(start + length, length) - places
    owner = np.repeat(group, length)
    before = np.empty(n, np.int64)  # the transform's symbol; a segment's first place has one of its own
    before[1:] = data[:-1]
    before[start] = -1 - np.arange(len(start))
    symbol, own = before[order], owner[order]
    heads = np.flatnonzero(np.append(True, (symbol[1:] != symbol[:-1]) | (own[1:] != own[:-1])))
    left, right = order[np.maximum(heads - 1, 0)], order[heads]
    most = np.where((heads > 0) & (owner[left] == owner[right]), np.minimum(rest[left], rest[right]), 0)
    padded = np.append(data, np.zeros(8, np.uint8))
    word = np.lib.stride_tricks.as_strided(padded, (n + 1, 8), (1, 1))
    common = np.zeros(len(heads), np.int64)
    live = np.flatnonzero(most > 0)
    while len(live):
        a, b = word[left[live] + common[live]], word[right[live] + common[live]]
        same = (a != b).argmax(axis=1)
        same[(a == b).all(axis=1)] = 8
        common[live] += same
        live = live[(same == 8) & (common[live] < most[live])]
    common = np.minimum(common, most)

    def streamed(at: np.ndarray, value: np.ndarray) -> np.ndarray:
        sampled = np.zeros(n, np.int64)
        sampled[at] = value + at + 1
        last = np.zeros(n, np.int64)
        last[at] = at + 1
        last = np.maximum.accumulate(last)
        return np.where(last > 0, sampled[np.maximum(last - 1, 0)] - places - 1, 0)

    tails = np.append(heads[1:] - 1, n - 1)
    return np.maximum(streamed(right, common), streamed(order[tails], np.append(common[1:], 0)))


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last places of the stretches that are true."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return edge[::2], edge[1::2]


def index_marks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Index segments, sorted by gram, text and place, some grams at a time and emit the covered bytes of those that occur once."""
    kept: list[pa.RecordBatch] = []
    held = 0

    def done(batch: pa.RecordBatch) -> pa.RecordBatch:
        first = np.ones(batch.num_rows, bool)
        for c in ("h", "k1", "k2", "lo"):  # rows that came twice are neighbours
            x = np.asarray(batch.column(c))
            first[1:] = (x[1:] != x[:-1]) | (first[1:] if c != "h" else False)
        first[0] = True
        batch = batch.filter(pa.array(first))
        h, n, k1, k2, lo, ns = (np.asarray(batch.column(i)) for i in range(6))
        texts = text_bytes(batch.column(6))
        length = np.fromiter(map(len, texts), np.int64, len(texts))
        start = np.cumsum(length) - length
        group = np.cumsum(np.append(0, h[1:] != h[:-1]))
        far = matching_statistics(np.frombuffer(b"".join(texts), np.uint8), start, length, group) >= width
        place = np.arange(len(far)) - np.repeat(start, length)
        far &= (place < np.repeat(ns, length)) & np.repeat(n == 1, length)
        a, b = runs(far)
        doc = np.searchsorted(start, a, "right") - 1
        first = lo[doc] + a - start[doc]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (k1[doc], k2[doc], first, first + (b - a) + width - 1)], names=["k1", "k2", "lo", "hi"])

    last = None
    for batch in batches:
        h = np.asarray(batch.column(0))
        if not len(h):
            continue
        size = np.cumsum([0, *map(len, text_bytes(batch.column(6)))])
        at = 0
        for cut in ([0] if last is not None and last != h[0] else []) + (np.flatnonzero(h[1:] != h[:-1]) + 1).tolist():
            if held + size[cut] - size[at] >= BUCKET:
                yield done(joined([*kept, batch.slice(at, cut - at)]))
                kept, held, at = [], 0, cut
        kept.append(batch.slice(at))
        held += int(size[-1] - size[at])
        last = h[-1]
    if kept:
        yield done(joined(kept))


def joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def extract(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Bytes of the wanted segments of each text, as SEGMENTS. Equal texts of a task bring the same; only the first one counts."""
    seen: set[tuple[int, int]] = set()
    held: list[tuple] = []
    size = 0

    def out() -> pa.RecordBatch:
        arrays = [pa.array(np.concatenate([x[i] for x in held])) for i in range(6)] + [pa.array([y for x in held for y in x[6]], pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, names=["h", "n", "k1", "k2", "lo", "ns", "seg"])

    for batch in batches:
        for x, want in zip(text_bytes(batch.column("__text")), batch.column("__want").to_pylist(), strict=True):
            k1, k2 = want[0]["k1"], want[0]["k2"]
            if (k1, k2) in seen:
                continue
            seen.add((k1, k2))
            h, n, lo, ns = (np.array([w[f] for w in want], np.int64) for f in ("h", "n", "lo", "ns"))
            cut = [x[a : a + b + width - 1] for a, b in zip(lo, ns, strict=True)]
            held.append((h, n, *(np.full(len(h), k, np.int64) for k in (k1, k2)), lo, ns.astype(np.int32), cut))
            size += sum(map(len, cut))
            if size > 1 << 22:
                yield out()
                held, size = [], 0
    if held:
        yield out()


def refile(batches: Iterator[pa.RecordBatch], width: int, gram: int) -> Iterator[pa.RecordBatch]:
    """The strings of segments filed under grams of another length, as REFILED; whole strings (gram = width) go without their bytes."""
    held: list[tuple] = []
    size = 0

    def out() -> pa.RecordBatch:
        arrays = [pa.array(np.concatenate([x[i] for x in held])) for i in range(8)] + [pa.array([y for x in held for y in x[8]], pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, names=["h", "c", "d", "n", "k1", "k2", "lo", "ns", "seg"])

    for batch in batches:
        n, k1, k2, lo = (batch.column(c).to_pylist() for c in ("n", "k1", "k2", "lo"))
        for i, piece in enumerate(text_bytes(batch.column("seg"))):
            for own, c, d, at, count in segments(piece, width, gram):
                cut = [None] * len(own) if gram == width else [piece[x : x + y + width - 1] for x, y in zip(at.tolist(), count.tolist(), strict=True)]
                held.append((own, c, d, *(np.full(len(own), v, np.int64) for v in (n[i], k1[i], k2[i])), at + lo[i], count, cut))
                size += sum(map(len, cut)) if gram < width else 64 * len(own)
            if size > 1 << 22:
                yield out()
                held, size = [], 0
    if held:
        yield out()


def cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Apply the marks: counts and digest of what is left, and the text less its wholly covered code points."""
    for batch in batches:
        out: list[tuple] = []
        for raw, was, marks in zip(text_bytes(batch.column("__text")), batch.column("__text").is_valid().to_pylist(), batch.column("__marks").to_pylist(), strict=True):
            if not marks:
                out.append((len(raw), 0, 0, hashlib.sha256(raw).hexdigest(), raw.decode() if was else None))
                continue
            gone = np.zeros(len(raw) + 1, np.int32)
            np.add.at(gone, [m["lo"] for m in marks], 1)
            np.add.at(gone, [m["hi"] for m in marks], -1)
            gone = np.cumsum(gone[:-1]) > 0
            data = np.frombuffer(raw, np.uint8)
            begins = np.flatnonzero((data & 0xC0) != 0x80)
            whole = np.logical_and.reduceat(gone, begins) if len(begins) else gone[:0]
            stays = np.repeat(~whole, np.diff(np.append(begins, len(data))))
            out.append((len(raw), int(gone.sum()), len(runs(gone)[0]), hashlib.sha256(data[~gone].tobytes()).hexdigest(), data[stays].tobytes().decode()))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([batch.column("__row"), *(pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds))], names=["__row", *ADDED])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", others: list[str] | None = None, width: int = 200, hot: int = 1_000) -> DataFrame:
    """Remove every byte covered by a string of width bytes that also starts anywhere else in the corpus.

    Returns id_col, the columns named in others, n_bytes, n_removed, n_spans, kept_sha256 (of the exact remaining bytes)
    and kept_text (less the code points that are covered wholly; null stays null). Others named like an added column are
    replaced by it. width must be at least GRAM.
    """
    if width < GRAM:
        raise ValueError(f"width must be at least {GRAM}")
    spark = docs.sparkSession
    small_batches(spark)
    carried = [c for c in dict.fromkeys([id_col, *(others or [])]) if c not in ADDED]
    # Keys that tell texts apart; marks depend on the text alone, so documents that share both keys share their marks.
    text = F.col(text_col)
    keyed = docs.select(F.xxhash64(F.coalesce(text, F.lit(""))).alias("__k1"), F.coalesce(F.hash(F.col(id_col)).cast("long"), F.lit(0)).alias("__k2"), text.alias("__text"), F.struct(*carried).alias("__row"))
    source = keyed.where(F.octet_length("__text") >= width).select(F.col("__k1").alias("k1"), F.col("__k2").alias("k2"), F.col("__text").alias("text"))

    # Rows of one text and id are dealt to several tasks if they are many; each of these gets their marks.
    many = materialise(keyed.groupBy("__k1", "__k2").agg(F.count("*").alias("__rows")).where(F.col("__rows") > COPIES).select("__k1", "__k2", F.least(F.lit(4096), F.ceil(F.col("__rows") / COPIES)).cast("int").alias("__parts")), "copies")
    copied = not many.isEmpty()
    if copied:
        spread = keyed.join(bounded(many, 500_000), ["__k1", "__k2"], "left")
        spread = spread.withColumn("__part", F.coalesce(F.pmod(F.xxhash64(F.spark_partition_id()), F.col("__parts")), F.lit(0)).cast("int"))
    else:
        spread = keyed
    on = ["__k1", "__k2", "__part"] if copied else ["__k1", "__k2"]  # a constant part would be taken out of the join, not out of the exchange
    texts = spread.repartition(*on)

    def to_parts(rows: DataFrame) -> DataFrame:
        """rows for every task that has their text."""
        if not copied:
            return rows
        parts = F.coalesce("__parts", F.lit(1))
        return rows.join(bounded(many, 500_000), ["__k1", "__k2"], "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")

    def taken(rows: DataFrame, dealt: DataFrame) -> DataFrame:
        """The bytes of segments from the texts. A text's own segments bound each list."""
        want = rows.groupBy(F.col("k1").alias("__k1"), F.col("k2").alias("__k2")).agg(F.collect_list(F.struct("h", "n", "k1", "k2", "lo", "ns")).alias("__want"))
        near = dealt.join(to_parts(want).hint("shuffle_hash"), on)
        # All columns go along: with fewer, the texts' exchange would not be the one that the result uses.
        return near.mapInArrow(lean(lambda b: extract(b, width)), SEGMENTS)

    def indexed(rows: DataFrame) -> DataFrame:
        return rows.repartition("h").sortWithinPartitions("h", "k1", "k2", "lo").mapInArrow(lean(lambda b: index_marks(b, width)), MARKS)

    def whole(level: DataFrame, counted: DataFrame) -> DataFrame:
        """The segments that occur more than once, with all of their bytes."""
        met = level.where("n = 1").join(counted.where("n > 1").select("h", "c", "d"), ["h", "c", "d"])
        return met.select("k1", "k2", "lo", (F.col("lo") + F.col("ns") + width - 1).alias("hi"))

    def counts(level: DataFrame, *more: Column) -> tuple[DataFrame, DataFrame]:
        """Different segments with their numbers and one place, and the grams with several of them."""
        counted = level.groupBy("h", "c", "d").agg(F.sum("n").alias("n"), F.min(F.struct("k1", "k2", "lo", "ns")).alias("one"), *more)
        counted = materialise(counted.select("h", "c", "d", "n", "one.*", *(["seg"] if more else [])), "contents")
        return counted, materialise(counted.groupBy("h").agg(F.count("*").alias("nd")).where("nd > 1"), "several")

    grams = source.select("text").mapInArrow(lean(lambda b: count_grams(b, width)), GRAMS).groupBy("h").agg(F.sum("n").alias("n"))
    grams = materialise(grams.where("n > 1").select("h"), "grams")
    level = materialise(source.mapInArrow(lean(lambda b: list_segments(b, width)), ROWS).join(grams, "h"), "segments")
    counted, several = counts(level)
    rows = counted.join(several, "h")
    marks = [whole(level, counted), indexed(taken(rows.where(F.col("nd") <= hot), texts))]
    crowded = rows.where(F.col("nd") > hot)
    if not crowded.isEmpty():
        # Only the texts that hold such grams move once more; what follows works on the bytes of their segments alone.
        keys = crowded.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2")).distinct()
        some = spread.join(bounded(keys, 500_000), ["__k1", "__k2"], "left_semi").repartition(*on)
        crowded = materialise(taken(crowded, some).dropDuplicates(["h", "k1", "k2", "lo"]), "crowded")
        for gram in levels(width)[1:]:
            level = crowded.mapInArrow(lean(lambda b, gram=gram: refile(b, width, gram)), REFILED)
            level = materialise(level if gram < width else level.drop("seg"), "refiled")
            counted, several = counts(level, *([F.any_value("seg").alias("seg")] if gram < width else []))
            marks.append(whole(level, counted))
            if gram == width:  # whole strings: their number says all
                break
            rows = counted.join(several, "h").select("h", "n", "k1", "k2", "lo", "ns", "seg", "nd")
            marks.append(indexed(rows.where(F.col("nd") <= hot).drop("nd")))
            crowded = rows.where(F.col("nd") > hot).drop("nd")
            if crowded.isEmpty():
                break
    every = marks[0]
    for more in marks[1:]:
        every = every.unionByName(more)
    # Rows of one text and id bring the same marks; each start counts once, with its furthest end.
    every = every.groupBy(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), "lo").agg(F.max("hi").alias("hi"))
    every = to_parts(every.groupBy("__k1", "__k2").agg(F.collect_list(F.struct("lo", "hi")).alias("__marks")))
    final = texts.join(every.hint("shuffle_hash"), on, "left")
    schema = f"__row {keyed.schema['__row'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"
    return final.select("__row", "__text", "__marks").mapInArrow(lean(cut_texts), schema).select("__row.*", *ADDED)
