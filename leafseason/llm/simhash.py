"""SimHash near-duplicates by exact tiled comparison.

Fingerprints are cut into `parts` equal words, and the population counts of the words name a tile. Two fingerprints at
distance r have population counts that differ by at most r in sum, so a tile is compared, by numpy exclusive-or and bit
counts, only with tiles whose counts lie within the radius; all other tile pairs are skipped, and no link is lost. Only
distinct fingerprints are compared, large tiles are cut into chunks, and each task returns a spanning forest of the links
that it found, never all pairs.
More parts make smaller tiles and more visitors; `parts_for` chooses them by the number of distinct fingerprints, and
every setting is exact.

A null text counts as empty. An empty text, or one without words, has fingerprint zero and links like any other. Rows may
repeat; equal fingerprints form one class. A null id takes part, but the smallest id of a class is its smallest known one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafseason.llm.common import lean, materialise, ship, small_batches, text_bytes
from leafseason.llm.components import connected_components

ship(__name__)

PIECE = 1 << 16  # shingles handled at a time
KEYS = 8  # tiles that a text goes to for its smallest shingles
TILE = 4096  # fingerprints compared in one task's step; larger tiles are cut into pairs of chunks
SHINGLES = 1 << 20  # of a chunk's texts together, beyond which a tile is cut as well
LARGE = 256  # sets of a tile, beyond which they are compared with a pivot first


def fingerprint(text: bytes, size: int = 3, seed: int = 42) -> int:
    """64-bit SimHash: a bit is set if more than half of the shingles' XXH64 have it."""
    words = text.lower().split()  # bytes: A-Z only, and splits at exactly the six ASCII blanks
    if not words:
        return 0
    count = max(1, len(words) - size + 1)
    digest = xxhash.xxh64_digest
    votes = np.zeros(64, np.int64)
    if count == 1:
        hashes = digest(b" ".join(words), seed)
        votes += np.unpackbits(np.frombuffer(hashes, np.uint8))
    else:
        line = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = (ends - [len(w) + 1 for w in words]).tolist()
        stops = (ends[size - 1 :] - 1).tolist()
        for at in range(0, count, PIECE):
            hashes = b"".join([digest(line[a:b], seed) for a, b in zip(starts[at : at + PIECE], stops[at : at + PIECE])])  # noqa: B905
            bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
            votes += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * votes > count).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = np.fromiter((fingerprint(x, size) for x in text_bytes(batch.column(0))), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([pa.array(made.view(np.int64)), *batch.columns[1:]], names=["fp", *batch.schema.names[1:]])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, size: int = 3) -> DataFrame:
    """(fp, id, key): key is a hash of the text, which tells rows with the same id apart."""
    source = docs.select(F.col(text_col), F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("key"))
    return source.mapInArrow(lean(lambda b: _fingerprints(b, size)), "fp long, id long, key long")


def tile_counts(fps: np.ndarray, parts: int) -> np.ndarray:
    """Population count of each of the parts of each fingerprint."""
    width = 64 // parts
    mask = np.uint64(2**width - 1)
    return np.stack([np.bitwise_count((fps >> np.uint64(width * k)) & mask) for k in range(parts)], axis=1).astype(np.int64)


def neighbours(parts: int, radius: int) -> np.ndarray:
    """Offsets of tiles within the radius, one of each opposite pair, the tile itself first."""
    found = [(0,) * parts]
    moves = [d for d in range(-radius, radius + 1) if d]
    for places in range(1, radius + 1):
        for which in combinations(range(parts), places):
            for steps in product(moves, repeat=places):
                if sum(map(abs, steps)) <= radius and steps[0] > 0:
                    off = [0] * parts
                    for k, d in zip(which, steps, strict=True):
                        off[k] = d
                    found.append(tuple(off))
    return np.array(found, np.int64)


def parts_for(distinct: int) -> int:
    """Parts of least expected work at radius 2, if a row sent costs as much as 450 comparisons (an estimate).

    With uniform bits the share of pairs that meet is 0.014 for 4 parts, 2.5e-4 for 8 and 3.4e-7 for 16, and a fingerprint
    goes to 21, 73 or 273 tiles.
    """
    return 4 if distinct < 3_400_000 else 8 if distinct < 720_000_000 else 16


def _deal(batches: Iterator[pa.RecordBatch], parts: int, radius: int) -> Iterator[pa.RecordBatch]:
    """Send each fingerprint to its own tile and, as a visitor, to the tiles that compare themselves with it."""
    offsets = neighbours(parts, radius)
    base = 64 // parts + 1
    scale = base ** np.arange(parts)
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            fps = np.asarray(batch.column(0))[at : at + 4096]
            tile = tile_counts(fps.view(np.uint64), parts)
            to = tile[:, None, :] - offsets[None]
            fits = ((to >= 0) & (to < base)).all(axis=2)
            row, which = np.nonzero(fits)
            names = (to[row, which] * scale).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(fps[row]), pa.array(which > 0)], names=["tile", "fp", "visitor"])


def _roots(n: int, a: np.ndarray, b: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Merge the classes of linked places; root holds the smallest place of each class."""
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return root
        low, high = np.minimum(ra, rb)[apart], np.maximum(ra, rb)[apart]
        np.minimum.at(root, high, low)
        while (root != root[root]).any():
            root = root[root]


def _merged(home: np.ndarray, root: np.ndarray, more: np.ndarray, radius: int) -> np.ndarray:
    """Smallest linked places of home and more, given those of home so far; home is compared with more, or without more with itself."""
    root = np.concatenate((root, np.arange(len(root), len(root) + len(more))))
    every, first = (more, len(home)) if len(more) else (home, 0)
    step = max(1, (1 << 21) // max(1, len(every)))
    for at in range(0, len(home), step):
        a, b = np.nonzero(np.bitwise_count(home[at : at + step, None] ^ every[None, :]) <= radius)
        keep = a + at < b + first
        root = _roots(len(root), a[keep] + at, b[keep] + first, root)
    return root


def _tiles(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links of each chunk's own fingerprints with each other and with its visitors, as edges to the smallest linked place.

    Rows come sorted by tile, chunk and visitor: a chunk's own rows are held, its visitors are compared as they come.
    """
    held: list[np.ndarray] = []
    home, root = np.zeros(0, np.uint64), None
    key = None

    def edges(old: np.ndarray, new: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        moved = np.flatnonzero(new != old)
        if len(moved):
            yield pa.RecordBatch.from_arrays([pa.array(fps[moved].view(np.int64)), pa.array(fps[new[moved]].view(np.int64))], names=["u", "v"])

    def settle() -> Iterator[pa.RecordBatch]:
        nonlocal home, root
        if root is None and held:
            home = np.concatenate(held)
            root = _merged(home, np.arange(len(home)), home[:0], radius)
            yield from edges(np.arange(len(home)), root, home)

    for batch in batches:
        if not batch.num_rows:
            continue
        tile, chunk = np.asarray(batch.column("tile")), np.asarray(batch.column("chunk"))
        fps, seen = np.asarray(batch.column("fp")).view(np.uint64), batch.column("visitor").to_numpy(zero_copy_only=False)
        cut = (np.flatnonzero((tile[1:] != tile[:-1]) | (chunk[1:] != chunk[:-1]) | (seen[1:] != seen[:-1])) + 1).tolist()
        for a, b in zip([0, *cut], [*cut, len(tile)], strict=True):
            if key != (tile[a], chunk[a]):
                yield from settle()
                held, root, key = [], None, (tile[a], chunk[a])
            if not seen[a]:
                held.append(fps[a:b])
            elif held:
                yield from settle()
                old = np.concatenate((root, np.arange(len(root), len(root) + b - a)))
                new = _merged(home, root, fps[a:b], radius)
                yield from edges(old, new, np.concatenate((home, fps[a:b])))
                root = new[: len(home)]
    yield from settle()


def home_tile(parts: int) -> Column:
    """The number of a fingerprint's own tile, as _deal names it."""
    width, base = 64 // parts, 64 // parts + 1
    counts = [F.bit_count(F.shiftrightunsigned("fp", width * k).bitwiseAND(F.lit(2**width - 1))).cast("long") * base**k for k in range(parts)]
    return sum(counts[1:], counts[0])


def links(distinct: DataFrame, radius: int = 2, parts: int = 4, most: int = TILE) -> DataFrame:
    """Edges (u, v) that connect exactly the fingerprints (column fp, each once) within the radius of each other.

    A tile with more than `most` fingerprints of its own is cut into chunks, each of which meets its tile's other chunks and
    all of its visitors, so no task holds more than `most` of them.
    """
    dealt = distinct.select("fp").mapInArrow(lean(lambda b: _deal(b, parts, radius)), "tile long, fp long, visitor boolean")
    large = distinct.groupBy(home_tile(parts).alias("tile")).agg(F.ceil(F.count("*") / most).cast("long").alias("chunks")).where("chunks > 1")
    if large.isEmpty():
        cut = dealt.withColumn("chunk", F.lit(0).cast("long"))
    else:
        # Spark broadcasts the large tiles if they are few by its own measure.
        sized = dealt.join(large, "tile", "left").withColumn("own", F.pmod(F.xxhash64("fp"), F.coalesce("chunks", F.lit(1).cast("long"))))
        last = F.when(F.col("visitor"), F.coalesce("chunks", F.lit(1).cast("long")) - 1).otherwise(F.col("own"))
        cut = sized.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), last))).select("tile", "fp", (F.col("visitor") | (F.col("chunk") < F.col("own"))).alias("visitor"), "chunk")
    return cut.repartition("tile", "chunk").sortWithinPartitions("tile", "chunk", "visitor").mapInArrow(lean(lambda b: _tiles(b, radius)), "u long, v long")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, radius: int = 2, parts: int | None = None) -> DataFrame:
    """(fp, id, key, component, root) of every row of docs; component is the smallest id of the row's class, root its smallest linked fp."""
    small_batches(docs.sparkSession)
    made = materialise(fingerprints(docs, id_col, text_col, size), "fingerprints")
    nodes = materialise(made.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    return _classes(made, nodes, links(nodes, radius, parts or parts_for(nodes.count())))


def _classes(made: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    roots = materialise(connected_components(edges), "roots").withColumnRenamed("node", "fp")
    rooted = nodes.select("fp", "least").join(roots, "fp")
    least = rooted.groupBy("root").agg(F.min("least").alias("smallest"))
    linked = rooted.join(least, "root").select("fp", "smallest", "root")
    classes = nodes.select("fp", "least").join(linked, "fp", "left").select("fp", F.coalesce("smallest", "least").alias("component"), F.coalesce("root", "fp").alias("root"))
    return made.join(classes, "fp").select("fp", "id", "key", "component", "root")


def shingle_digests(text: bytes, size: int) -> np.ndarray:
    """128-bit hashes of the distinct shingles as two columns, sorted by the first; that column stands for the shingle."""
    words = text.lower().split()
    if not words:
        return np.zeros((0, 2), np.uint64)
    count = max(1, len(words) - size + 1)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.append(0, ends[:-1])[:count].tolist()
    stops = (ends[-count:] - 1).tolist()
    pieces = range(0, count, PIECE)
    hashes = (b"".join([xxhash.xxh3_128_digest(line[a:b]) for a, b in zip(starts[at : at + PIECE], stops[at : at + PIECE])]) for at in pieces)  # noqa: B905
    every = np.concatenate([np.frombuffer(h, np.uint64).reshape(-1, 2) for h in hashes])
    return every[np.unique(every[:, 0], return_index=True)[1]]


def wide_fingerprint(text: bytes, size: int, keys: int = KEYS) -> tuple[int, int, list[int], int, int]:
    """A SimHash of 128 bits as two words, the smallest of the shingles' hashes under each of `keys` orders, a digest of the set of shingles and its size."""
    # Each shingle has one vote, however often it occurs: lines that a text repeats don't outweigh the rest of it.
    own = shingle_digests(text, size)
    if not len(own):
        return 0, 0, [], 0, 0
    votes = np.zeros(128, np.int64)
    least = np.full(keys, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), PIECE):
        some = own[at : at + PIECE]
        votes += np.unpackbits(some.view(np.uint8), axis=1).sum(axis=0, dtype=np.int32)
        for k in range(keys):
            least[k] = min(least[k], (some[:, 0] + some[:, 1] * np.uint64(k)).min())
    a, b = np.packbits(2 * votes > len(own)).view(">u8").tolist()
    return a, b, least.view(np.int64).tolist(), xxhash.xxh3_64_intdigest(np.ascontiguousarray(own[:, 0])), len(own)


def _wide(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [wide_fingerprint(x, size) for x in text_bytes(batch.column(0))]
        a, b, fp = (pa.array(np.array([m[k] for m in made], np.uint64).view(np.int64)) for k in (0, 1, 3))
        least, n = pa.array([m[2] for m in made], pa.list_(pa.int64())), pa.array([m[4] for m in made], pa.int64())
        yield pa.RecordBatch.from_arrays([fp, a, b, n, least, *batch.columns[1:]], names=["fp", "w0", "w1", "n", "least_hashes", *batch.schema.names[1:]])


def _confirmed(w0: np.ndarray, w1: np.ndarray, n: np.ndarray, part: np.ndarray, texts: pa.Array, radius: int, size: int, similarity: float) -> np.ndarray:
    """Smallest linked place of each row; guests are compared with the others, not with each other, and rows that face guests with those only.

    Rows within the radius whose sizes allow the similarity are candidates; only the exact similarity of their sets links them.
    """
    root, places = np.arange(len(n)), np.arange(len(n))
    guest, alone = part == GUEST, not (part == FACING).any()
    own = np.flatnonzero(~guest)

    def candidates(rows: np.ndarray) -> np.ndarray:
        far = np.bitwise_count(w0[rows, None] ^ w0[None]) + np.bitwise_count(w1[rows, None] ^ w1[None])
        few, many = np.minimum(n[rows, None], n[None]), np.maximum(n[rows, None], n[None])
        return (far <= radius) & (few / many >= similarity) & (guest[None] | (alone & (places[None] > rows[:, None])))

    asked = np.zeros(len(n), bool)
    for at in range(0, len(own), 64):
        met = candidates(own[at : at + 64])
        asked |= met.any(axis=0)
        asked[own[at : at + 64]] |= met.any(axis=1)
    some = np.flatnonzero(asked)
    if not len(some):
        return root
    sets = [shingle_digests(x, size)[:, 0] for x in text_bytes(texts.take(pa.array(some)))]
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum([len(x) for x in sets])
    starts = ends - [len(x) for x in sets]
    nth = np.cumsum(asked) - 1
    mark = np.zeros(len(names), bool)
    for i in own[asked[own]]:
        to = np.flatnonzero(candidates(np.array([i]))[0] & (root != root[i]))
        if not len(to):
            continue
        mine = flat[starts[nth[i]] : ends[nth[i]]]
        mark[mine] = True
        if len(to) < 64:
            both = np.array([np.count_nonzero(mark[flat[starts[k] : ends[k]]]) for k in nth[to]])
        else:
            both = np.add.reduceat(mark[flat], starts, dtype=np.int64)[nth[to]]
        mark[mine] = False
        linked = to[both / (n[i] + n[to] - both) >= similarity]
        if len(linked):
            old = np.append(root[linked], root[i])
            root[np.isin(root, old)] = old.min()
    return root


def _wide_tiles(batches: Iterator[pa.RecordBatch], radius: int, size: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """Links within each tile; rows come sorted by tile."""
    held: pa.Table | None = None
    for batch in _ended(batches):
        if batch is not None:
            more = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, more]).combine_chunks() if held is not None else more
        if held is None or not held.num_rows:
            continue
        tile, fp, w0, w1, n, part = (held.column(c).to_numpy() for c in ("tile", "fp", "w0", "w1", "n", "part"))
        texts = held.column("text").combine_chunks()
        texts = pa.concat_arrays(texts.chunks) if isinstance(texts, pa.ChunkedArray) else texts
        at = 0
        for end in (np.flatnonzero(tile[1:] != tile[:-1]) + 1).tolist() + ([len(tile)] if batch is None else []):
            if end - at > 1:
                root = _confirmed(w0[at:end].view(np.uint64), w1[at:end].view(np.uint64), n[at:end], part[at:end], texts.slice(at, end - at), radius, size, similarity)
                linked = np.flatnonzero(root != np.arange(end - at))
                if len(linked):
                    yield pa.RecordBatch.from_arrays([pa.array(fp[at:end][linked]), pa.array(fp[at:end][root[linked]])], names=["u", "v"])
            at = end
        held = held.slice(at)


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _pivots(batches: Iterator[pa.RecordBatch], size: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """Which rows are similar to their group's pivot, which comes first; rows come sorted by (named, salt, row)."""
    key, centre, fp = None, np.zeros(0, np.uint64), 0
    for batch in batches:
        named, salt, row = (batch.column(c).to_pylist() for c in ("named", "salt", "row"))
        fps, texts = batch.column("fp").to_pylist(), text_bytes(batch.column("text"))
        u, v = [], []
        for i in range(batch.num_rows):
            own = shingle_digests(texts[i], size)[:, 0]
            if row[i] == 0:
                key, centre, fp = (named[i], salt[i]), own, fps[i]
            elif key == (named[i], salt[i]):
                both = len(np.intersect1d(own, centre, assume_unique=True))
                if both / max(1, len(own) + len(centre) - both) >= similarity:
                    u.append(fps[i])
                    v.append(fp)
        if u:
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def pivot_rows(met: DataFrame, large: int, group: int = 1024) -> DataFrame:
    """(named, salt, row, fp, pick): the rows of tiles with more than `large` sets in groups, each led (row 0) by the tile's pivot.

    The pivot is the set whose smallest shingles are the most common ones, which is the one that the others are copies of
    if there is such a one; the choice bears on the work alone.
    """
    weight = met.groupBy("fp").agg(F.sum("rows").alias("weight"))
    some = met.where(F.col("rows") > large)
    central = some.join(weight, "fp").groupBy("named", "rows").agg(F.max_by(F.struct("fp", "pick"), F.struct("weight", "fp")).alias("p"))
    salts = F.ceil(F.col("rows") / group).cast("long")
    heads = central.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).select("named", "salt", F.lit(0).alias("row"), "p.fp", "p.pick")
    return heads.unionByName(some.select("named", F.pmod(F.xxhash64("fp"), salts).alias("salt"), F.lit(1).alias("row"), "fp", "pick"))


OWN, GUEST, FACING = 0, 1, 2  # a row's part in a tile: met by all, met by the others, met by guests only


def similar_tiles(met: DataFrame, tile_size: int, most: int = SHINGLES) -> DataFrame:
    """(tile, fp, w0, w1, n, part, pick) of rows that share a smallest shingle (named) and may have links not found yet.

    met has a column main: the row is of the class that its tile's pivot is in. Rows of main are linked to each other already,
    so they only meet the others, and a tile without others isn't looked at. Others and main rows are cut into chunks of at
    most tile_size rows, or of about `most` shingles, by hash; each chunk of others is a tile, and so is each pair of such a
    chunk with another chunk, whose rows are guests there. So every pair that isn't linked yet meets once. pick names one row
    that has the set.
    """
    free, zero = ~F.col("main"), F.lit(0).cast("long")
    sums = [f(F.when(c, F.col("n")) if f is F.sum else c).alias(a) for f, c, a in ((F.count_if, free, "free"), (F.sum, free, "free_n"), (F.count_if, ~free, "led"), (F.sum, ~free, "led_n"))]
    counts = met.groupBy("named").agg(*sums).where("free > 0 and free + led > 1")
    cut = lambda rows, n: F.least(rows, F.greatest(F.ceil(F.col(rows) / tile_size), F.ceil(F.coalesce(n, zero) / most))).cast("long")
    sized = met.join(counts, "named").withColumns({"chunks": cut("free", "free_n"), "led_chunks": cut("led", "led_n")})
    sized = sized.withColumn("own", F.pmod(F.xxhash64("fp"), F.when(free, F.col("chunks")).otherwise(F.col("led_chunks"))))
    place = lambda low, high, led, part: F.struct(low.alias("low"), high.alias("high"), led.alias("led"), part.alias("part"))
    own, none = F.col("own"), F.lit(-1).cast("long")
    upto = lambda n: F.when(F.col(n) > 0, F.sequence(zero, F.col(n) - 1)).otherwise(F.array().cast("array<long>"))
    among = F.transform(upto("chunks"), lambda o: place(F.least(own, o), F.greatest(own, o), none, F.when(o == own, OWN).when(o > own, FACING).otherwise(GUEST)))
    facing = F.transform(upto("led_chunks"), lambda g: place(own, own, g, F.lit(FACING)))
    visits = F.transform(upto("chunks"), lambda c: place(c, c, own, F.lit(GUEST)))
    dealt = sized.withColumn("to", F.explode(F.when(free, F.concat(among, facing)).otherwise(visits)))
    return dealt.select(F.xxhash64("named", "to.low", "to.high", "to.led").alias("tile"), "fp", "w0", "w1", "n", "to.part", "pick")


def similar_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8, tile_size: int = TILE, large: int = LARGE) -> DataFrame:
    """(fp, id, key, component, root) as near_classes, with texts linked whose sets of shingles have a Jaccard similarity of at least `similarity`; fp is a digest of the set.

    Every link is confirmed on the sets themselves (of 64-bit hashes of the shingles). Which pairs are looked at: a tile holds
    the texts that share their smallest shingle under one of KEYS hash orders; within it, pairs whose sizes rule the similarity
    out or whose 128-bit SimHashes lie beyond the radius are skipped. Texts at similarity j share no tile with probability
    (1 - j) ** KEYS, 3 in a million at 0.8. Their SimHashes differ in an expected share acos(2 j / (1 + j)) / pi of the bits,
    and in up to 0.19 of them for sets of 4 and 5 shingles, where votes tie; the radius lies 7 standard deviations above the
    first, and less than 1 in a million pairs at 0.8 lie beyond it in either case. A text goes to KEYS tiles whatever the size
    of the corpus. Tiles of more than `large` sets are first compared with a pivot of their own, in groups; what hangs
    together after that isn't compared again, so the work of a large group of near copies grows with its size, not with its
    square, but for the rows that none of their pivots links. Texts without words form one class.
    """
    spark = docs.sparkSession
    share = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    radius = int(128 * (share + 7 * (share * (1 - share) / 128) ** 0.5))
    small_batches(spark)
    source = docs.select(F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("key"))
    made = source.mapInArrow(lean(lambda b: _wide(b, size)), "fp long, w0 long, w1 long, n long, least_hashes array<long>, id long, key long")
    made = materialise(made, "fingerprints")
    nodes = materialise(made.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    pick = F.xxhash64("key", "id").alias("pick")
    keyed = made.select("fp", "w0", "w1", "n", pick, F.posexplode("least_hashes").alias("k", "least")).select(F.xxhash64("k", "least").alias("named"), "fp", "w0", "w1", "n", "pick")
    keyed = keyed.groupBy("named", "fp", "w0", "w1", "n").agg(F.min("pick").alias("pick"))
    met = materialise(keyed.join(keyed.groupBy("named").agg(F.count("*").alias("rows")).where("rows > 1"), "named"), "met")
    # Few bytes, much work: more tasks than bytes alone would give.
    tasks = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def with_texts(rows: DataFrame) -> DataFrame:
        """The text of one row of each set; ids keep copies of a text from meeting in one task."""
        asked = source.select("text", pick).join(rows.select("pick").distinct().hint("shuffle_hash"), "pick")
        texts = asked.withColumn("nth", F.row_number().over(Window.partitionBy("pick").orderBy("pick"))).where("nth = 1").select("pick", "text")
        return rows.join(texts, "pick").drop("pick")

    edges = None
    if met.where(F.col("rows") > large).isEmpty():
        sorted_out = met.withColumn("main", F.lit(False))
    else:
        grouped = with_texts(pivot_rows(met, large)).repartition(tasks, "named", "salt").sortWithinPartitions("named", "salt", "row")
        edges = materialise(grouped.mapInArrow(lean(lambda b: _pivots(b, size, similarity)), "u long, v long").where("u != v").distinct(), "pivots")
        classed = met.join(connected_components(edges).withColumnsRenamed({"node": "fp", "root": "class"}), "fp", "left")
        # Of a tile's classes the one with the most rows; a row without a class is one of the others.
        sizes = classed.where("class is not null").groupBy("named", "class").agg(F.count("*").alias("size"))
        largest = sizes.groupBy("named").agg(F.max_by("class", F.struct("size", "class")).alias("largest"))
        sorted_out = classed.join(largest, "named", "left").withColumn("main", F.coalesce(F.col("class") == F.col("largest"), F.lit(False))).select("named", "fp", "w0", "w1", "n", "pick", "main")
    tiles = materialise(similar_tiles(sorted_out, tile_size), "tiles")
    dealt = with_texts(tiles).repartition(tasks, "tile").sortWithinPartitions("tile")
    found = dealt.mapInArrow(lean(lambda b: _wide_tiles(b, radius, size, similarity)), "u long, v long")
    return _classes(made, nodes, found if edges is None else found.unionByName(edges))


def deduplicate(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Keep one row of each class that near_classes or similar_classes found in docs, with all its columns: the one with the smallest id, of rows that share it one.

    Nulls sort last, so a class keeps a row without id only if none of its rows has one.
    """
    kept = classes.groupBy("root").agg(F.min(F.struct(F.isnull("id").alias("unnamed"), "id", "key")).alias("k"))
    kept = kept.select(F.col("k.key").alias("__key"), F.coalesce(F.hash("k.id"), F.lit(0)).alias("__id"))
    row = F.struct(*docs.columns).alias("__row")  # apart from the names used here
    keyed = docs.select(row, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("__key"), F.coalesce(F.hash(F.col(id_col).cast("long")), F.lit(0)).alias("__id"))
    met = keyed.join(kept.distinct().hint("shuffle_hash"), ["__key", "__id"])
    one = met.withColumn("__n", F.row_number().over(Window.partitionBy("__key", "__id").orderBy("__key")))
    return one.where("__n = 1").select("__row.*")
