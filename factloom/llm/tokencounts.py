"""Token counts of whole texts, huge ones from overlapping chunks that are spliced where their encodings surely agree.

A text of more than step + overlap bytes is cut into chunks, one every `step` bytes and each reaching `overlap` bytes into
the next, so that any number of tasks can share one text. Each chunk is encoded alone, with the byte offsets of its
tokens; of these only the boundaries between words (pieces that the byte-level pattern splits off) within its first and
last `overlap` bytes are kept, each with the number of tokens before it.

Why a splice is proven: the pattern reads from left to right and remembers nothing but its place, looks at most one
character beyond a piece, and merges never cross a piece. So if two chunks both have a boundary between words at one byte,
they agree from there on, as far as both see the same text. The chunk before is right up to that byte if its own
start is (by induction; the first begins where the text does) and if its end is far enough off: what is cut at its end
can only change pieces that reach it and special tokens that it tears, so boundaries closer to it than the longest
special token and two characters don't count. A special token torn by a chunk's start has no boundary inside it in the chunk
before, so no splice falls there.

Where a pair of neighbours has no common boundary (one long run of letters, say), the text is done again with chunks and
overlaps WIDER times as large, at last as one chunk, so counts are always those of the whole text.

Defined cases: a null text is empty and has no tokens; special tokens inside a text count as one token each, as the
library does by default; equal long texts are encoded once; null and repeated doc_ids pass through, one row each; a
table without rows gives none; other columns of the input are not read.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.ngrams import row_slices
from factloom.llm.shared import small_side, write_shared
from factloom.llm.tokenfiles import encoder

STEP, OVERLAP, WIDER = 1 << 14, 1 << 9, 8
#: Bytes of two characters, which the pattern may look at beyond a boundary.
AHEAD = 8
CHUNKS = "digest string, at long, start long, last boolean, body string"
ENDS = "digest string, at long, last boolean, n long, head array<long>, head_n array<long>, tail array<long>, tail_n array<long>"


def check(path: str) -> None:
    """Raise unless the proof holds for a tokenizer file: byte-level words by the usual pattern and nothing else before the merges."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    split = spec["pre_tokenizer"] or {}
    plain = spec["model"]["type"] == "BPE" and spec["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    if not plain or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
        raise ValueError(f"{path}: chunks can only be spliced for byte-level BPE without normalizer, prefix space or stripping special tokens")


def _whole(path: str):
    def run(batches):
        own = encoder(path)
        for batch in batches:
            for at, length in row_slices(batch.column("text")):
                _, counts = own.encode(batch.column("text").slice(at, length))
                rest = [batch.column(c).slice(at, length) for c in ("doc_id", "n_bytes")]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(counts.astype(np.int64) - 1)], names=["doc_id", "n_bytes", "n_tokens"])  # each has an end id

    return run


def pieces(text: bytes, step: int, overlap: int):
    """(number, start, whether it is the last, bytes) of the chunks of a text, moved to where characters begin."""

    def begin(place: int) -> int:
        while place < len(text) and text[place] & 0xC0 == 0x80:
            place -= 1
        return place

    number, last = 0, False
    while not last:
        start = begin(number * step)
        last = start + step + overlap >= len(text)
        yield number, start, last, text[start : len(text) if last else begin((number + 1) * step + overlap)]
        number += 1


def _cut(step: int, overlap: int):
    names = [x.split()[0] for x in CHUNKS.split(", ")]

    def run(batches):
        for batch in batches:
            for digest, text in zip(batch.column("digest"), batch.column("text"), strict=True):
                rows = []
                for number, start, last, body in pieces(text.as_py().encode(), step, overlap):
                    rows.append((digest.as_py(), number, start, last, body.decode()))
                    if last or len(rows) == 64:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=names)
                        rows = []

    return run


def boundaries(encoding, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of the boundaries between words of an encoding, and the number of tokens before each."""
    ids, word = np.array(encoding.ids, np.int64), np.array(encoding.word_ids)
    before = np.flatnonzero(word[1:] != word[:-1]) + 1
    return np.cumsum(length[ids])[before - 1], before


def _ends(path: str, overlap: int):
    names = [x.split()[0] for x in ENDS.split(", ")]

    def run(batches):
        own = encoder(path)
        margin = AHEAD + max((len(s.encode()) for s in own.special), default=0)
        for batch in batches:
            rows = batch.to_pylist()
            for at in range(0, len(rows), 16):
                part, out = rows[at : at + 16], []
                for row, e in zip(part, own.tokenizer.encode_batch([r["body"] for r in part], add_special_tokens=False), strict=True):
                    place, before = boundaries(e, own.length)
                    size = len(row["body"].encode())
                    # the start of the next chunk may lie up to three bytes further left
                    head, tail = place <= overlap + 3, (place >= size - overlap - 3) & (place + margin <= size)
                    here = [(place[head] + row["start"]).tolist(), before[head].tolist(), (place[tail] + row["start"]).tolist(), before[tail].tolist()]
                    out.append((row["digest"], row["at"], row["last"], len(e.ids), *here))
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.string(), pa.int64(), pa.bool_(), pa.int64(), *[pa.list_(pa.int64())] * 4], strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def spliced(texts: DataFrame, path: str, step: int = STEP, overlap: int = OVERLAP) -> DataFrame:
    """digest, n_tokens, joined of texts(digest, text); joined is false where two neighbouring chunks have no common boundary."""
    if step < overlap:
        raise ValueError("chunks must not overlap any but the next")
    # the chunks of one text go to many tasks; those of equal texts are the same rows
    chunks = texts.mapInArrow(_cut(step, overlap), CHUNKS).dropDuplicates(["digest", "at"])
    ends = chunks.mapInArrow(_ends(path, overlap), ENDS)
    w = Window.partitionBy("digest").orderBy("at")
    pairs = ends.select("digest", "last", "n", "tail", "tail_n", F.lead("head").over(w).alias("next"), F.lead("head_n").over(w).alias("next_n"))
    pairs = pairs.withColumn("cut", F.array_min(F.array_intersect("tail", "next")))
    before = F.element_at("tail_n", F.array_position("tail", F.col("cut")).cast("int")) - F.element_at("next_n", F.array_position("next", F.col("cut")).cast("int"))
    own = F.when(F.col("last"), F.col("n")).when(F.col("cut").isNotNull(), before)
    return pairs.groupBy("digest").agg(F.sum(own).alias("n_tokens"), F.bool_and(F.col("last") | F.col("cut").isNotNull()).alias("joined"))


def counted(docs: DataFrame, path: str, limit: int = 1024, step: int = STEP, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of docs(doc_id, text)."""
    check(path)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    own = own.withColumn("n_bytes", F.octet_length("text").cast("long"))
    huge = F.col("n_bytes") > step + overlap
    short = own.where(~huge).mapInArrow(_whole(path), "doc_id long, n_bytes long, n_tokens long")
    long = own.where(huge).withColumn("digest", F.sha2("text", 256))
    texts, found = long.select("digest", "text"), []
    while True:
        found.append(write_shared(spliced(texts, path, step, overlap), "token-counts"))
        torn = found[-1].where("not joined")
        if torn.isEmpty():
            break
        texts = texts.join(small_side(torn.select("digest")), "digest", "left_semi")
        step, overlap = step * WIDER, overlap * WIDER
    whole = found[0].where("joined")
    for more in found[1:]:
        whole = whole.unionByName(more.where("joined"))
    long = long.select("doc_id", "n_bytes", "digest").join(small_side(whole.select("digest", "n_tokens")), "digest")
    return short.unionByName(long.drop("digest")).withColumn("over_limit", F.col("n_tokens") > limit)
