"""Token ids in patched frame-of-reference files.

A file is a run of segments, each a whole number of documents; the files of a store are numbered in ascending document
order. Layout of a segment, all numbers little-endian:

    magic "PFR1", u32 documents, u32 ids, u32 blocks
    per document: u32 ids                      (their order is that of the rows)
    per block:    u32 start                    (byte offset of the block, the index of block starts)
    per block:    u32 minimum, u8 width, u8 exceptions, packed ids, then exceptions as u8 place and u32 value

A block holds up to 128 ids. Their minimum is taken off, and they are packed at the least width that fits PERCENTILE
percent of them; the others are stored in the exception list (their packed bits are the low ones). Any block can be
decoded alone from its start.

The segments stand in a table in the shared folder (or a path of your own), written and committed by Spark, with the
number of the file, of the segment in it and the doc_ids beside the bytes.

Defined cases: a null text has only the end id; null doc_ids come first; rows that repeat a doc_id stay apart, in order
of a hash of their texts (and of the texts), so even many of them are dealt over several files; a very long text makes one
long segment; an empty table makes an empty store; other columns of the input are not read.
"""

from __future__ import annotations

import os
import string
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.ngrams import row_slices, utf8
from factloom.llm.shared import small_side, write_shared

MAGIC, BLOCK, PERCENTILE, END_ID = b"PFR1", 128, 90, 2
SEGMENT_IDS = 1 << 18
SLICE_BYTES = 3 << 20
PATCH = np.dtype([("place", "u1"), ("value", "<u4")])
KEPT = 800_000


def pack(ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """One segment of ids (u32) of documents with these lengths."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    padded = np.full(blocks * BLOCK, 0, np.uint32)
    padded[:n] = ids
    if n % BLOCK:
        padded[n:] = ids[-1]
    grid = padded.reshape(blocks, BLOCK)
    low = grid.min(axis=1) if blocks else np.empty(0, np.uint32)
    rest = grid - low[:, None]
    limit = np.sort(rest, axis=1)[:, min(BLOCK - 1, BLOCK * PERCENTILE // 100)] if blocks else low
    widths = np.ceil(np.log2(limit.astype(np.float64) + 1)).astype(np.uint8)
    packed: list[bytes] = [b""] * blocks
    for w in np.unique(widths).tolist():
        at = np.flatnonzero(widths == w)
        part = np.ascontiguousarray(rest[at], "<u4")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little", count=w) if w else np.empty((len(at), 0), np.uint8)
        body = np.packbits(bits.reshape(len(at), -1), axis=1, bitorder="little")
        over = part > np.uint32((1 << w) - 1)
        patches = np.empty(int(over.sum()), PATCH)
        patches["place"], patches["value"] = np.nonzero(over)[1], part[over]
        ends = np.cumsum(over.sum(axis=1)).tolist()
        last = 0
        for k, (i, end) in enumerate(zip(at.tolist(), ends, strict=True)):
            packed[i] = struct.pack("<IBB", int(low[i]), w, end - last) + body[k].tobytes() + patches[last:end].tobytes()
            last = end
    head = 16 + 4 * len(lengths) + 4 * blocks
    starts = head + np.concatenate([[0], np.cumsum([len(b) for b in packed])[:-1]]) if blocks else np.empty(0)
    return MAGIC + struct.pack("<III", len(lengths), n, blocks) + lengths.astype("<u4").tobytes() + starts.astype("<u4").tobytes() + b"".join(packed)


def block_starts(segment: bytes) -> np.ndarray:
    docs, _, blocks = struct.unpack_from("<III", segment, 4)
    return np.frombuffer(segment, "<u4", blocks, 16 + 4 * docs)


def unpack_block(segment: bytes, start: int) -> np.ndarray:
    """The 128 ids of the block at a start (the last block of a segment is filled up)."""
    low, width, patched = struct.unpack_from("<IBB", segment, start)
    size = BLOCK * width // 8
    bits = np.unpackbits(np.frombuffer(segment, np.uint8, size, start + 6), bitorder="little").reshape(BLOCK, width)
    values = (bits.astype(np.uint32) << np.arange(width, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)
    at = start + 6 + size
    for k in range(patched):
        place, value = struct.unpack_from("<BI", segment, at + 5 * k)
        values[place] = value
    return values + np.uint32(low)


def unpack(segment: bytes) -> tuple[np.ndarray, np.ndarray]:
    """ids and document lengths of a segment."""
    if segment[:4] != MAGIC:
        raise ValueError("not a segment of token ids")
    docs, n, blocks = struct.unpack_from("<III", segment, 4)
    lengths = np.frombuffer(segment, "<u4", docs, 16)
    starts = block_starts(segment).tolist()
    raw = np.frombuffer(segment, np.uint8)
    out = np.empty((blocks, BLOCK), np.uint32)
    begin = np.array(starts, np.int64)
    widths = raw[begin + 4] if blocks else np.empty(0, np.uint8)
    for w in np.unique(widths).tolist():
        at = np.flatnonzero(widths == w)
        size = BLOCK * w // 8
        body = raw[begin[at][:, None] + 6 + np.arange(size)]
        bits = np.zeros((len(at) * BLOCK, 32), np.uint8)
        bits[:, :w] = np.unpackbits(body, axis=1, bitorder="little").reshape(-1, w) if w else 0
        out[at] = np.packbits(bits, axis=1, bitorder="little").view("<u4").reshape(len(at), BLOCK)
        counts = raw[begin[at] + 5].astype(np.int64)
        own = np.repeat(np.arange(len(at)), counts)
        within = np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts)
        patches = raw[(begin[at][own] + 6 + size + 5 * within)[:, None] + np.arange(5)].copy().view(PATCH).reshape(-1)
        out[at[own], patches["place"]] = patches["value"]
    if blocks:
        out += raw[begin[:, None] + np.arange(4)].copy().view("<u4")
    return out.reshape(-1)[:n], lengths


#: For each byte: 1 ASCII white space, 2 ASCII letter or digit, 4 ASCII mark, 8 surely begins no white space.
_WHITE, _PLAIN, _MARK, _SOLID = 1, 2, 4, 8
_KINDS = bytes(
    _WHITE if chr(b) in " \t\n\v\f\r\x1c\x1d\x1e\x1f" else _SOLID | (_PLAIN if chr(b) in string.ascii_letters + string.digits else _MARK if chr(b) in string.punctuation else 0)
    if b < 128 or (b >= 0xC3 and b not in (0xE1, 0xE2, 0xE3)) else 0
    for b in range(256)
)


def pre_cuts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Places in the bytes of texts (which begin at starts) where byte-level pre-splitting cuts for certain.

    It cuts before a space that a non-space follows, and after a letter or digit before a mark or white space. Bytes
    beyond ASCII count only where they are surely no white space (before) or surely a letter (after).
    """
    n = len(data)
    kinds = np.frombuffer(data.tobytes().translate(_KINDS), np.uint8)
    cut = np.zeros(n, bool)
    if n > 1:
        solid = (kinds[1:] & _SOLID) > 0
        solid[:-1] |= (data[1:-1] == 0xC2) & (data[2:] > 0xA0)
        cut[:-1] = (data[:-1] == 0x20) & solid
        letter = (kinds[:-1] & _PLAIN) > 0
        letter[1:] |= (data[:-2] == 0xC3) & (data[1:-1] != 0x97) & (data[1:-1] != 0xB7)
        cut[1:] |= letter & ((kinds[1:] & (_MARK | _WHITE)) > 0)
    cut[starts[starts < n]] = True
    return np.flatnonzero(cut)


class PieceEncoder:
    """Encodes texts with the tokenizers library, asking it once for each piece between certain cuts (kept in a bounded table).

    Pieces are told apart by Arrow's dictionary encoding and their ids are gathered from one array, so Python sees each
    distinct piece of a batch once.
    """

    def __init__(self, path: str, end_id: int = END_ID):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # words asked for here are new ones
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocab = self.tokenizer.get_vocab()
        self.length = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.length[i] = len(token)  # byte-level labels have a letter for each byte
        self.end_id = end_id
        self._forget()

    def _forget(self) -> None:
        """Empty the table; its entry 0 is the end of a document."""
        self.kept: dict[bytes, int] = {}
        self.ids = np.array([self.end_id], np.uint32)
        self.begins, self.counts = np.zeros(1, np.int64), np.ones(1, np.int64)

    def _learn(self, pieces: list[bytes]) -> None:
        """Enter new pieces. Those that begin with a space and hold no other are asked for as one text and cut by the tokens' bytes."""
        spaced = [p for p in pieces if p[0] == 0x20 and len(p) > 1 and b" " not in p[1:]]
        found, counts = [self.ids], [self.counts]
        for at in range(0, len(spaced), 1000):
            part = spaced[at : at + 1000]
            ids = np.array(self.tokenizer.encode_batch_fast([b"".join(part).decode()], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.searchsorted(np.cumsum(self.length[ids]), np.cumsum(list(map(len, part)))) + 1
            found.append(ids)
            counts.append(np.diff(ends, prepend=0))
        others = list(set(pieces).difference(spaced)) if len(spaced) < len(pieces) else []
        for e in self.tokenizer.encode_batch_fast([p.decode() for p in others], add_special_tokens=False):
            found.append(np.array(e.ids, np.uint32))
            counts.append(np.array([len(e.ids)]))
        self.kept.update(zip(spaced + others, range(len(self.kept) + 1, len(self.kept) + 1 + len(pieces)), strict=True))
        self.ids, self.counts = np.concatenate(found), np.concatenate(counts)
        self.begins = np.cumsum(self.counts) - self.counts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids (u32) of texts, each text's ended by the end id, and how many each text has; a null text is empty."""
        data, offsets = utf8(texts)
        starts = pre_cuts(data, offsets[:-1])
        if any(s.encode() in data.tobytes() for s in self.special):  # a text with a special token goes to the library whole
            marked = [any(s in t for s in self.special) for t in texts.fill_null("").to_pylist()]
            doc = np.searchsorted(offsets, starts, side="right") - 1
            starts = starts[~np.array(marked)[doc] | (offsets[doc] == starts)]
        bounds = np.append(starts, len(data)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        own = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.kept) > KEPT or len(self.ids) > 8 * KEPT:
            self._forget()
        numbers = list(map(self.kept.get, own))
        new = [p for p, k in zip(own, numbers, strict=True) if k is None]
        if new:
            self._learn(new)
            numbers = [self.kept[p] if k is None else k for p, k in zip(own, numbers, strict=True)]
        numbers = np.array(numbers, np.int64)[pieces.indices.to_numpy()]
        stops = np.searchsorted(starts, offsets[1:])  # pieces before each text's end
        numbers = np.insert(numbers, stops, 0)
        counts = self.counts[numbers]
        ends = np.cumsum(counts)
        ids = self.ids[np.repeat(self.begins[numbers] - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)]
        last = ends[stops + np.arange(len(stops))]
        return ids, np.diff(last, prepend=0).astype(np.uint32)


_encoders: dict[tuple[str, int], PieceEncoder] = {}


def encoder(path: str, end_id: int = END_ID) -> PieceEncoder:
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = PieceEncoder(path, end_id)
    return _encoders[path, end_id]


SEGMENTS = "file int, segment long, doc_ids array<long>, n_ids long, bytes binary"


def _segments(path: str, end_id: int):
    def run(batches):
        file, number, own = TaskContext.get().partitionId(), 0, encoder(path, end_id)
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []

        def segment():
            docs, ids, lengths = pa.concat_arrays([h[0] for h in held]), np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            docs = pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs)
            return pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([number], pa.int64()), docs, pa.array([len(ids)], pa.int64()), pa.array([pack(ids, lengths)], pa.binary())], names=["file", "segment", "doc_ids", "n_ids", "bytes"])

        for batch in batches:
            for at, length in row_slices(batch.column("text"), SLICE_BYTES):
                held.append((batch.column("doc_id").slice(at, length), *own.encode(batch.column("text").slice(at, length))))
                if sum(len(h[1]) for h in held) >= SEGMENT_IDS:
                    yield segment()
                    held, number = [], number + 1
        if held:
            yield segment()

    return run


def write_ids(docs: DataFrame, path: str, end_id: int = END_ID, to: str | None = None) -> DataFrame:
    """Encode docs(doc_id, text) into segments, in ascending doc_id order over all files, and write them (to a path, or the shared folder)."""
    order = ["doc_id", F.xxhash64("text"), "text"]
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    made = ordered.mapInArrow(_segments(path, end_id), SEGMENTS)
    if to is None:
        return write_shared(made, "token-files")
    made.write.parquet(to)
    return docs.sparkSession.read.schema(SEGMENTS).parquet(to)


def segment_starts(segments: DataFrame) -> DataFrame:
    """file, segment, first: the number of ids before each segment in the whole store; a written table."""
    whole = Window.orderBy("file")
    own = Window.partitionBy("file").orderBy("segment")
    sizes = segments.select("file", "segment", "n_ids")
    files = sizes.groupBy("file").agg(F.sum("n_ids").alias("n"))  # one row a file
    files = files.select("file", (F.sum("n").over(whole) - F.col("n")).alias("before"))
    starts = sizes.withColumn("within", F.sum("n_ids").over(own) - F.col("n_ids")).join(files, "file").select("file", "segment", (F.col("before") + F.col("within")).alias("first"))
    return write_shared(starts, "token-starts")


def read_span(segments: DataFrame, first: int, n: int) -> DataFrame:
    """The ids from place `first` of the whole store up to `n` of them: rows (at, ids), one a block; only blocks that hold them are decoded."""
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                segment, base, count = [batch.column(c)[i].as_py() for c in ("bytes", "first", "n_ids")]
                low, high = max(first - base, 0), min(first + n - base, count)
                starts, places, found = block_starts(segment), [], []
                for block in range(low // BLOCK, -(-high // BLOCK)):
                    ids = unpack_block(segment, int(starts[block]))
                    a, b = max(low - block * BLOCK, 0), min(high - block * BLOCK, BLOCK)
                    places.append(base + block * BLOCK + a)
                    found.append(ids[a:b].astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array(found, pa.list_(pa.int32()))], names=["at", "ids"])

    held = segments.join(small_side(segment_starts(segments)), ["file", "segment"]).where((F.col("first") < first + n) & (F.col("first") + F.col("n_ids") > first))
    return held.select("first", "n_ids", "bytes").mapInArrow(run, "at long, ids array<int>")


def read_documents(segments: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids before the document in the whole store), n_tokens, ids_crc32 and, if asked, ids of every document, from the segments' bytes."""
    starts = segment_starts(segments)
    fields = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids, lengths = unpack(batch.column("bytes")[i].as_py())
                ends = np.cumsum(lengths, dtype=np.int64)
                begins = ends - lengths
                body = ids.astype("<u4").tobytes()
                spans = list(zip(begins.tolist(), ends.tolist(), strict=True))
                arrays = [batch.column("doc_ids")[i].values, pa.array(begins + batch.column("first")[i].as_py()), pa.array(lengths.astype(np.int64)), pa.array([zlib.crc32(body[4 * a : 4 * b]) for a, b in spans], pa.int64())]
                if with_ids:
                    arrays.append(pa.array([ids[a:b].astype(np.int32) for a, b in spans], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in fields.split(",")])

    return segments.join(small_side(starts), ["file", "segment"]).select("first", "doc_ids", "bytes").mapInArrow(run, fields)
