"""Byte-level BPE encoding and decoding through a table of distinct words.

1. A task splits its documents into words with the tokenizer's own pattern, numbers the words that it meets, and keeps
   each document as an array of word numbers. Documents are handled in blocks of about `block_bytes`; a document is never
   divided.
2. The distinct words of all blocks meet by hash. There each distinct word is encoded once, whatever the number of blocks
   that hold it, and its ids go back to the blocks under the words' numbers.
3. Each block joins the ids to its word positions. For decoding it joins the ids of its distinct words with the table of
   pieces (id, piece), which is as large as the tokenizer's vocabulary, and strings the pieces' bytes together.

Words travel in compressed packs, one for each block and hash class, so a frequent word costs a block one entry, and no
class grows with a word's frequency. There are as many classes as it takes for one to hold `CLASS_BYTES` of words if no word
came twice, so what a task remembers of a class is bounded. A null text counts as empty; empty texts have no tokens. Rows
may repeat, and columns other than those named are not looked at. A text of any length is one piece of work and must fit in
a worker's memory some times over.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafseason.llm.common import batches_by_bytes, lean, once, ship, small_batches, tasks_for, total_bytes

ship(__name__)

#: Fixed value: the tokenizers' own pattern of words.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CLASS_BYTES = 32 << 20
#: Distinct words that are joined with the table of pieces at once.
JOIN_WORDS = 32768
PACKS = "target long, kind int, block string, class int, body binary"


def _tokenizer(path: str):
    """The library's tokenizer, its special strings, and the table of pieces (id, piece)."""

    def load():
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        # The bytes that stand for themselves in a vocabulary; the others follow from code point 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        special = {x["content"]: x["id"] for x in said["added_tokens"]}
        pieces = {i: bytes(byte_of[c] for c in p) for p, i in said["model"]["vocab"].items()} | {i: s.encode() for s, i in special.items()}
        return Tokenizer.from_file(path), special, pa.table({"id": pa.array(list(pieces), pa.int32()), "piece": pa.array(list(pieces.values()), pa.binary())})

    return once(("tokenizer", path), load)


def _patterns(path: str):
    """What finds special strings (none: None), and what finds words."""
    special = sorted(_tokenizer(path)[1], key=len, reverse=True)
    return regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None, regex.compile(SPLIT)


def _pack(lengths: np.ndarray, body: bytes) -> bytes:
    """Lengths, as bytes where they fit, and what they divide."""
    width = 1 if not len(lengths) or lengths.max() < 256 else 4
    return zstandard.compress(struct.pack("<qq", len(lengths), width) + lengths.astype(f"<u{width}").tobytes() + body, 6)


def _unpack(data: bytes) -> tuple[np.ndarray, bytes]:
    data = zstandard.decompress(data)
    n, width = struct.unpack_from("<qq", data)
    return np.frombuffer(data, f"<u{width}", n, 16).astype(np.int64), data[16 + width * n :]


def _by_byte(x: np.ndarray, width: int) -> bytes:
    """Little-endian integers with all first bytes first, which compress better."""
    return x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()


def _from_bytes(data: bytes | memoryview, width: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(f"<u{width}").ravel()


def _id_width(pieces: pa.Table) -> int:
    return 2 if pa.compute.max(pieces["id"]).as_py() < 65536 else 4


#: Ranks below DIRECT take one byte of a block's flow, others a byte and two more, as far as BLOCK_WORDS; with more words all take four.
DIRECT = 192
BLOCK_WORDS = DIRECT + (256 - DIRECT) * 65536


def _write_flow(head: bytes, rank: np.ndarray, places: np.ndarray) -> bytes:
    """A block's header, the rank of each distinct word in class order, and the ranks of its words by position."""
    wide = len(places) > BLOCK_WORDS
    sizes = struct.pack("<qqqq", len(head), len(places), len(rank), wide)
    if wide:
        flow = _by_byte(rank, 4)
    else:
        far = rank >= DIRECT
        rest = rank[far] - np.uint32(DIRECT)
        first = rank.astype(np.uint8)
        first[far] = DIRECT + (rest >> np.uint32(16))
        flow = first.tobytes() + _by_byte(rest & np.uint32(65535), 2)
    return zstandard.compress(sizes + head + _by_byte(places, 4) + flow, 3)


def _read_flow(body: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    data = memoryview(zstandard.decompress(body))
    a, b, c, wide = struct.unpack_from("<qqqq", data)
    a, b = 32 + a, 32 + a + 4 * b
    head, places = bytes(data[32:a]), _from_bytes(data[a:b], 4)
    if wide:
        return head, places, _from_bytes(data[b:], 4)
    first = np.frombuffer(data[b : b + c], np.uint8)
    rank = first.astype(np.uint32)
    far = first >= DIRECT
    rank[far] = ((rank[far] - np.uint32(DIRECT)) << np.uint32(16)) + _from_bytes(data[b + c :], 2) + np.uint32(DIRECT)
    return head, places, rank


def split_blocks(batches: Iterator[pa.RecordBatch], path: str, classes: int, block_bytes: int) -> Iterator[pa.RecordBatch]:
    """Blocks of documents as word numbers (kind 0), and their distinct words by hash class (kind 1)."""
    special, words = _patterns(path)
    numbers: dict[str, int] = {}
    ids: list = []
    sizes: list[int] = []
    places: list[np.ndarray] = []
    held = count = 0
    task = TaskContext.get().partitionId()
    digest = hashlib.blake2b(digest_size=8)

    def packed() -> pa.RecordBatch:
        nonlocal count
        count += 1
        # The same for each attempt of a task, and of its own for equal documents in other places.
        block = f"{task}-{count}-{digest.hexdigest()}"
        home = zlib.crc32(block.encode())
        texts = [w.encode() for w in numbers]
        cls = np.fromiter((zlib.crc32(t) % classes for t in texts), np.int64, len(texts))
        # Words are numbered by class and then by text, so that a class's pack holds neighbours that compress well.
        order = np.array(sorted(range(len(texts)), key=texts.__getitem__), np.int64)
        order = order[np.argsort(cls[order], kind="stable")]
        flow = np.concatenate(places)
        places.clear()
        rank = np.empty(len(texts), np.uint32)
        rank[np.argsort(-np.bincount(flow, minlength=len(texts)), kind="stable")] = np.arange(len(texts), dtype=np.uint32)
        body = _write_flow(json.dumps([ids, sizes]).encode(), rank[flow], rank[order])
        rows = [(home, 0, block, -1, body)]
        cls = cls[order]
        edges = np.flatnonzero(np.diff(cls, prepend=-1, append=-1)).tolist()
        for a, b in zip(edges, edges[1:]):  # noqa: B905
            own = [texts[i] for i in order[a:b]]
            rows.append((int(cls[a]), 1, block, int(cls[a]), _pack(np.fromiter(map(len, own), np.int64, len(own)), b"".join(own))))
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.binary()), strict=True)], names=["target", "kind", "block", "class", "body"])

    for batch in batches_by_bytes(batches, "__text", 4 << 20):
        for i, text in zip(batch.column("__id").to_pylist(), batch.column("__text").to_pylist(), strict=True):
            found: list[str] = []
            for k, part in enumerate(special.split(text) if special and text else [text or ""]):
                found += [part] if k % 2 else words.findall(part)
            places.append(np.fromiter([numbers.setdefault(w, len(numbers)) for w in found], np.uint32, len(found)))
            ids.append(i)
            sizes.append(len(found))
            digest.update(f"{i} {text}\0".encode())
            held += len(text or "")
            if held >= block_bytes or len(numbers) >= BLOCK_WORDS // 2:
                yield packed()
                numbers, ids, sizes, places, held, digest = {}, [], [], [], 0, hashlib.blake2b(digest_size=8)
    if ids:
        yield packed()


def encode_words(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Encode each distinct word of a class once; rows come sorted by class. Blocks pass through."""
    tokenizer, _, pieces = _tokenizer(path)
    width = _id_width(pieces)
    known: dict[bytes, bytes] = {}
    at = None
    names = ["target", "kind", "block", "class", "body"]
    rows: list[tuple] = []
    held = 0

    def out() -> pa.RecordBatch:
        kinds = pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.binary()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    for batch in batches:
        for target, kind, block, cls, body in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            if kind == 1:
                if cls != at:
                    known, at = {}, cls
                lengths, joined = _unpack(body)
                ends = np.cumsum(lengths)
                own = [joined[a:b] for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
                fresh = [w for w in own if w not in known]
                for k in range(0, len(fresh), 4096):
                    piece = fresh[k : k + 4096]
                    for w, e in zip(piece, tokenizer.encode_batch_fast([w.decode() for w in piece], add_special_tokens=False), strict=True):
                        known[w] = np.array(e.ids, f"<u{width}").tobytes()
                ids = [known[w] for w in own]
                body = _pack(np.fromiter((len(x) // width for x in ids), np.int64, len(ids)), b"".join(ids))
                target, kind = zlib.crc32(block.encode()), 2
            rows.append((target, kind, block, cls, body))
            held += len(body)
            if held > 4 << 20 or len(rows) >= 1000:
                yield out()
                rows, held = [], 0
    if rows:
        yield out()


def join_positions(batches: Iterator[pa.RecordBatch], path: str, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """Put ids back at the words' positions and decode them; rows come sorted by block, kind and class."""
    pieces = _tokenizer(path)[2]
    width = _id_width(pieces)

    def finished(body: bytes, packs: list[bytes]) -> Iterator[pa.RecordBatch]:
        head, order, flow = _read_flow(body)
        doc_ids, sizes = json.loads(head)
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        flow = place[flow]
        lengths: list[np.ndarray] = []
        tokens: list[np.ndarray] = []
        for pack in packs:
            n, ids = _unpack(pack)
            lengths.append(n)
            tokens.append(np.frombuffer(ids, f"<u{width}"))
        n = np.concatenate(lengths) if lengths else np.zeros(0, np.int64)
        ids = np.concatenate(tokens) if tokens else np.zeros(0, f"<u{width}")
        said, texts, edges = [], [], np.cumsum(np.append(0, n))
        for k in range(0, len(n), JOIN_WORDS):
            own = edges[k : k + JOIN_WORDS + 1]
            # The ids of some distinct words, one after the other, joined with the table of pieces.
            every = pa.table({"id": pa.array(ids[own[0] : own[-1]], pa.int32())})
            every = every.append_column("place", pa.array(np.arange(every.num_rows)))
            joined = every.join(pieces, "id", join_type="inner", use_threads=False).sort_by("place")
            shown, parts, a = [f"{t}," for t in joined["id"].to_pylist()], joined["piece"].to_pylist(), 0
            for b in (own[1:] - own[0]).tolist():
                said.append("".join(shown[a:b]))
                texts.append(b"".join(parts[a:b]))
                a = b
        ends = np.cumsum(np.append(0, sizes)).tolist()
        rows = []
        for i, a, b in zip(doc_ids, ends, ends[1:]):  # noqa: B905
            where = flow[a:b]
            own = where.tolist()
            ids = "".join([said[w] for w in own])[:-1]
            text = b"".join([texts[w] for w in own]).decode("utf-8", "replace")
            rows.append((i, int(n[where].sum()), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), *([[int(x) for x in ids.split(",")] if ids else [], text] if with_ids else ())))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()][: 6 if with_ids else 4]
        names = ["id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(kinds)]
        for k in range(0, len(rows), 1000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 1000], strict=True), kinds, strict=True)], names=names)

    block, body, packs = None, None, []
    for batch in batches:
        for kind, name, pack in zip(*(batch.column(c).to_pylist() for c in ("kind", "block", "body")), strict=True):
            if name != block and block is not None:
                yield from finished(body, packs)
                packs = []
            block = name
            if kind == 0:
                body = pack
            else:
                packs.append(pack)
    if block is not None:
        yield from finished(body, packs)


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, classes: int | None = None, block_bytes: int = 32 << 20) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 and, on demand, ids and decoded text of every row.

    The tokenizer file must be readable on every executor. classes: number of hash classes of words, by default one for each
    CLASS_BYTES of text, and no fewer than the shuffle partitions.
    """
    spark = docs.sparkSession
    small_batches(spark)
    classes = classes or tasks_for(spark, total_bytes(docs, text_col), CLASS_BYTES)
    source = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"))
    packs = source.mapInArrow(lean(lambda b: split_blocks(b, path, classes, block_bytes)), PACKS)
    encoded = packs.repartition(classes, "target").sortWithinPartitions("kind", "class").mapInArrow(lean(lambda b: encode_words(b, path)), PACKS)
    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    return encoded.repartition(classes, "block").sortWithinPartitions("block", "kind", "class").mapInArrow(lean(lambda b: join_positions(b, path, with_ids)), schema)
