"""Byte-level BPE over whole texts by content-defined chunk reuse (operator 4)."""

from __future__ import annotations

import functools
import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import Powers, kept, lay_out, mix64, prefix_hash, row_key, ship, text_pieces, utf8

#: A chunk ends where the rolling hash of the last WINDOW bytes has these bits all set: 256 bytes on average.
WINDOW, MASK = 8, 0xFF << 8
#: Encoded chunks and joins that a task keeps beside the shared table; beyond it they start anew, which changes no result.
KEPT = 50_000
#: The shared table: the chunks that occur most often, and the longest that are in it (in bytes).
SHARED, LONGEST = 30_000, 1_024


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level BPE: printable Latin-1 bytes stand for themselves, the rest follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@kept
def load(path: str):
    """The vocabulary file as a rank encoder, and the special tokens by text."""
    import public_tokenizers
    import tiktoken

    spec = json.load(open(path, encoding="utf-8"))
    alphabet = byte_alphabet()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(alphabet[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in special}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


@functools.lru_cache(1)
def gear() -> np.ndarray:
    return np.random.default_rng(20240517).integers(0, 1 << 32, 256, np.uint32)


def cuts(buf: np.ndarray) -> np.ndarray:
    """Ends of content-defined chunks: the hash sees the last WINDOW bytes alone, so equal passages cut alike."""
    g = gear()[buf]
    h = g.copy()
    for j in range(1, WINDOW):
        h[j:] += g[:-j] << np.uint32(j)
    return np.flatnonzero((h & np.uint32(MASK)) == MASK) + 1


def borders(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunk borders of all texts, their starts and ends among them, and each text's first border."""
    at = cuts(buf)
    text = np.searchsorted(starts, at, "right") - 1
    at = at[(text >= 0) & (at > starts[text]) & (at < ends[text])] if len(at) else at
    order = np.unique(np.concatenate((at, starts, ends)))
    return order, np.searchsorted(order, starts)


def spans(order: np.ndarray, first: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the chunks, text by text; a text's last border begins no chunk."""
    last = np.searchsorted(order, ends)
    n = last - first
    at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    return order[at], order[at + 1]


def chunk_hashes(buf: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each chunk's bytes and length."""
    sums = prefix_hash(buf)
    _, down = Powers.of(len(buf) + 1)
    return mix64((sums[b] - sums[a]) * down[a] ^ mix64((b - a).astype(np.uint64)))


def safe_places(raw: bytes) -> list[int]:
    """Where the pre-tokenizer breaks whatever stands further off: before a space that follows a visible ASCII character."""
    buf = np.frombuffer(raw, np.uint8)
    return (np.flatnonzero((buf[1:] == 32) & (buf[:-1] > 32) & (buf[:-1] < 127)) + 1).tolist() if len(buf) > 1 else []


class Chunk:
    """An encoded chunk: ``ids`` are its own part's, from its second safe place to its last but one.

    The pieces before and after (``left``, ``right``) are the witnesses that repaired joins are compared with.
    A chunk with less than four safe places, or whose witnesses aren't found in its ids, has no part of its own.
    """

    __slots__ = ("first", "last", "ids", "left", "right")

    def __init__(self, raw: bytes, encode, piece):
        at = safe_places(raw)
        self.first = 0
        if len(at) < 4:
            return
        every, left, right = encode(raw[at[0] : at[-1]]), piece(raw[at[0] : at[1]]), piece(raw[at[-2] : at[-1]])
        if every.startswith(left) and every.endswith(right) and len(every) > len(left) + len(right):
            self.first, self.last, self.left, self.right = at[1], at[-2], left, right
            self.ids = every[len(left) : len(every) - len(right)]


class Encoder:
    """Encodes texts chunk by chunk: a chunk of the shared table is not encoded again, joins are.

    A task also keeps the chunks and joins that it has met itself.
    """

    def __init__(self, path: str, table: dict[bytes, Chunk] | None = None, kept: int = KEPT):
        self.encoder, self.table, self.kept, self.joins, self.chunks = load(path), table or {}, kept, {}, {}

    def encode(self, raw: bytes) -> bytes:
        """Ids of a text as little-endian 32-bit integers."""
        return np.array(self.encoder.encode(raw.decode("utf-8"), allowed_special="all"), "<u4").tobytes()

    def decode(self, ids: bytes) -> bytes:
        return self.encoder.decode_bytes(np.frombuffer(ids, "<u4").tolist())

    def known(self, own: dict, raw: bytes, make):
        found = own.get(raw)
        if found is None:
            found = make(raw)
            if len(raw) <= LONGEST:
                if len(own) >= self.kept:
                    own.clear()
                own[raw] = found
        return found

    def join(self, raw: bytes) -> bytes:
        return self.known(self.joins, raw, self.encode)

    def chunk(self, raw: bytes) -> Chunk:
        return self.table.get(raw) or self.known(self.chunks, raw, lambda x: Chunk(x, self.encode, self.join))

    def text(self, raw: bytes, cuts: list[int]) -> bytes:
        """Ids of a text that is cut into chunks at these places (its start and end among them).

        What lies between the own parts of two chunks is encoded anew, with a witness on both sides. If the
        witnesses come out as the chunks have them, the join agrees with both. If the right one doesn't, its
        chunk is given up and the join goes on to the next; if the left one doesn't, the text is encoded whole.
        """
        out: list[bytes] = []
        start, witness = 0, b""
        for a, b in zip(cuts, cuts[1:]):
            own = self.chunk(raw[a:b])
            if not own.first:
                continue
            made = self.join(raw[start : a + own.first])
            if not made.startswith(witness):
                return self.encode(raw)
            if made.endswith(own.left) and len(made) >= len(witness) + len(own.left):
                out += (made, own.ids)
                start, witness = a + own.last, own.right
        made = self.join(raw[start:]) if start < len(raw) else b""
        return b"".join([*out, made]) if made.startswith(witness) else self.encode(raw)

    def texts(self, texts: list[bytes]):
        """Ids of each whole text."""
        buf, starts, ends = lay_out(texts)
        order, first = borders(buf, starts, ends)
        last = np.searchsorted(order, ends)
        for raw, start, i, j in zip(texts, starts.tolist(), first.tolist(), last.tolist()):
            yield self.text(raw, (order[i : j + 1] - start).tolist()) if raw else b""


def shared_chunks(docs: DataFrame, path: str, most: int = SHARED) -> dict[bytes, Chunk]:
    """The chunks that occur most often in the corpus, ``most`` at most, each encoded once.

    Chunks are counted by their hashes; of the chosen ones the bytes are read where they first stand.
    """

    def count(batches):
        schema = pa.schema([("h", pa.int64()), ("n", pa.int64()), ("key", pa.int64()), ("start", pa.int32()), ("size", pa.int32())])
        for batch in batches:
            for part in text_pieces(batch):
                buf, starts, ends = lay_out(utf8(part.column("text")))
                order, first = borders(buf, starts, ends)
                a, b = spans(order, first, ends)
                near = b - a <= LONGEST
                a, b = a[near], b[near]
                h, at, n = np.unique(chunk_hashes(buf, a, b), return_index=True, return_counts=True)
                text = np.searchsorted(starts, a[at], "right") - 1
                key = part.column("key").to_numpy()[text]
                columns = (h.view(np.int64), n.astype(np.int64), key, (a[at] - starts[text]).astype(np.int32), (b[at] - a[at]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], schema=schema)

    def encode(batches):
        encoder = Encoder(path)
        for batch in batches:
            made = [encoder.chunk(bytes(x)) for x in batch.column("raw").to_pylist()]
            fields = [[getattr(c, k, None) for c in made] for k in Chunk.__slots__]
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("raw"), *(pa.array(x, t) for x, t in zip(fields, kinds))], names=["raw", *Chunk.__slots__])

    rows = docs.select(row_key().alias("key"), "text")
    counted = rows.filter("length(text) > 0").mapInArrow(count, "h long, n long, key long, start int, size int")
    often = counted.groupBy("h").agg(F.sum("n").alias("n"), F.min(F.struct("key", "start", "size")).alias("at")).filter("n > 1")
    chosen = often.orderBy(F.desc("n"), "h").limit(most).select("h", F.col("at.key").alias("key"), F.col("at.start").alias("start"), F.col("at.size").alias("size"))
    found = rows.join(F.broadcast(chosen), "key").select("h", F.expr("substring(cast(text as binary), start + 1, size)").alias("raw"))
    made = found.dropDuplicates(["h"]).select("raw").mapInArrow(encode, "raw binary, first int, last int, ids binary, left binary, right binary").toArrow()
    table = {}
    for raw, *fields in zip(*(made.column(c).to_pylist() for c in ("raw", *Chunk.__slots__))):
        own = table[raw] = Chunk.__new__(Chunk)
        for k, x in zip(Chunk.__slots__, fields):
            setattr(own, k, x)
    return table


def encode_decode(docs: DataFrame, path: str, full: bool = False, shared: int = SHARED) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256; with ``full`` also ids and decoded.

    The ``shared`` chunks of all texts that occur most often are encoded once and told to every task; others
    are encoded where they stand. A null text is empty (no tokens, the hash of nothing); repeated rows give
    repeated rows; other columns are left out, whatever their names; an empty table gives an empty result. Very long
    texts are encoded whole. Bytes that make no UTF-8 decode to U+FFFD, as in the library.
    """
    spark = docs.sparkSession
    ship(spark)
    table = spark.sparkContext.broadcast(shared_chunks(docs, path, shared) if shared else {})

    def run(batches):
        encoder = Encoder(path, table.value)
        for batch in batches:
            for part in text_pieces(batch):
                n, a, b, ids_out, text_out = [], [], [], [], []
                for ids in encoder.texts(utf8(part.column("text"))):
                    text = encoder.decode(ids).decode("utf-8", "replace")
                    n.append(len(ids) // 4)
                    a.append(hashlib.sha256(ids).hexdigest())
                    b.append(hashlib.sha256(text.encode()).hexdigest())
                    if full:
                        ids_out.append(np.frombuffer(ids, "<u4").astype(np.int32))
                        text_out.append(text)
                cols = {"doc_id": part.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(a, pa.string()), "decoded_sha256": pa.array(b, pa.string())}
                if full:
                    cols |= {"ids": pa.array(ids_out, pa.list_(pa.int32())), "decoded": pa.array(text_out, pa.string())}
                yield pa.RecordBatch.from_pydict(cols)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(run, schema + (", ids array<int>, decoded string" if full else ""))
