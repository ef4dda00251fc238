"""How two tokenizers cut the same texts: groups between common cuts, links between tokens, and how common each link is.

A and B cut one byte string; where both have a token's end, a group ends. A group is fully told by its ids: token bytes
are fixed, so its links (the pairs of an A and a B token whose bytes overlap) are the same wherever it occurs. Groups are
therefore interned: in each block of texts every distinct group gets a number, and each text keeps the numbers and how
often it has them; over all blocks the dictionary holds every distinct group once with the number of texts that have it.
Links are expanded once per distinct group of that dictionary.

The number of texts that hold a pair linked is the sum over the groups that hold the pair of the texts that have the
group, less what texts with several such groups count too often. The latter is found in the block, where all groups of a
text are at hand, and leaves it as one row per pair. Each group's sums go back to the blocks by the group's key, to one row
per block and distinct group however often it occurs there, and from there to the texts.

A group's key holds its A ids, then its B ids with the highest bit set, as little-endian 32-bit numbers.

Defined cases: a text that is null or empty, or whose tokens of A or of B don't join to space and text, has no tokens: all
zeros and an empty digest; strings of special tokens are plain text; repeated rows count as texts of their own; null doc_ids
pass through; a table without rows gives none; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.bpe import byte_letters
from factloom.llm.ngrams import row_slices, utf8
from factloom.llm.shared import write_shared
from factloom.llm.tokenfiles import PieceEncoder

BLOCK_BYTES = 4 << 20
B_SIDE = np.uint32(1 << 31)
ROWS = {
    "block": pa.int64(), "doc_id": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups_sha256": pa.string(), "groups": pa.list_(pa.int32()),
    "times": pa.list_(pa.int32()), "number": pa.int32(), "key": pa.binary(), "a": pa.int32(), "b": pa.int32(), "n": pa.int64(), "kind": pa.string(),
}
FIELDS = (
    "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups array<int>, times array<int>, number int, key binary, a int, b int, n long, kind string"
)


class TokenBytes:
    """The bytes of each token of a vocabulary, to be joined for many ids at once."""

    def __init__(self, tokens: list[bytes]):
        self.length = np.array(list(map(len, tokens)), np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        size = self.length[ids]
        ends = np.cumsum(size)
        return self.data[np.repeat(self.begin[ids] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]

    def same(self, ids: np.ndarray, counts: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each text, whether its tokens (counts of ids) join to its bytes (data between offsets)."""
        doc = np.repeat(np.arange(len(counts)), counts)
        good = np.bincount(doc, self.length[ids], len(counts)).astype(np.int64) == np.diff(offsets)
        kept = np.repeat(good, np.diff(offsets))
        ends = np.cumsum(np.diff(offsets)[good])
        wrong = np.flatnonzero(self.joined(ids[good[doc]]) != data[kept])
        good[np.flatnonzero(good)[np.unique(np.searchsorted(ends, wrong, side="right"))]] = False
        return good


class Pair:
    """Both tokenizers: a byte-level file of the tokenizers library (A) and a sentencepiece model with byte fallback (B)."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a = PieceEncoder(a_path)
        self.a.tokenizer.encode_special_tokens = True
        self.a.special = []
        byte = {letter: b for b, letter in enumerate(byte_letters())}
        labels = {i: t for t, i in self.a.tokenizer.get_vocab().items()}
        self.a_bytes = TokenBytes([bytes(map(byte.__getitem__, labels[i])) if all(c in byte for c in labels.get(i, "")) else b"" for i in range(max(labels) + 1)])
        self.a_bytes.length[[t for t in labels if t in self.a.tokenizer.get_added_tokens_decoder()]] = 0  # never made from plain text
        self.b = b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
        self.b_bytes = TokenBytes([bytes([int(p[3:5], 16)]) if b.is_byte(i) else b"" if b.is_control(i) or b.is_unknown(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])

    def encode(self, texts: pa.Array):
        """ids of A and of B one text after another, how many each text has, and which texts have tokens at all (the others have none here)."""
        spaced = pc.binary_join_element_wise(pa.scalar(" "), texts.fill_null(""), "")
        data, offsets = utf8(spaced)
        ids, counts = self.a.encode(spaced)
        last = np.cumsum(counts.astype(np.int64)) - 1  # the end ids
        a, n_a = np.delete(ids, last).astype(np.int64), counts.astype(np.int64) - 1
        lists = self.b.encode(texts.fill_null("").to_pylist(), num_threads=1)
        n_b = np.array(list(map(len, lists)), np.int64)
        b = np.concatenate([np.array(x, np.int64) for x in lists]) if lists else np.empty(0, np.int64)
        good = self.a_bytes.same(a, n_a, data, offsets) & self.b_bytes.same(b, n_b, data, offsets) & (np.diff(offsets) > 1)
        return a[np.repeat(good, n_a)], n_a * good, b[np.repeat(good, n_b)], n_b * good

    def groups(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        """Where the groups of A's and B's ids end (in bytes), and the groups' keys."""
        a_ends, b_ends = np.cumsum(self.a_bytes.length[a]), np.cumsum(self.b_bytes.length[b])
        ends = np.intersect1d(a_ends, b_ends, assume_unique=True)
        a_stop, b_stop = np.searchsorted(a_ends, ends) + 1, np.searchsorted(b_ends, ends) + 1  # tokens up to each group's end
        out = np.empty(len(a) + len(b), "<u4")
        out[np.arange(len(a)) + np.concatenate([[0], b_stop])[np.searchsorted(ends, a_ends)]] = a
        out[np.arange(len(b)) + a_stop[np.searchsorted(ends, b_ends)]] = b.astype(np.uint32) | B_SIDE
        bounds = 4 * np.concatenate([[0], a_stop + b_stop]).astype(np.int64)
        return ends, pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(bounds), pa.py_buffer(out)])

    def links(self, keys: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Group (its place among the keys), A id and B id of every link; each stretch between two token ends is one link."""
        data, offsets = utf8(keys)
        ids = data.view("<u4") if len(data) else np.empty(0, np.uint32)
        side = ids >= B_SIDE
        group = np.repeat(np.arange(len(keys)), np.diff(offsets) // 4)[~side]
        a, b = ids[~side].astype(np.int64), (ids[side] & ~B_SIDE).astype(np.int64)
        a_ends, b_ends = np.cumsum(self.a_bytes.length[a]), np.cumsum(self.b_bytes.length[b])
        ends = np.union1d(a_ends, b_ends)
        at = np.searchsorted(a_ends, ends)
        return group[at], a[at], b[np.searchsorted(b_ends, ends)]


_pairs: dict[tuple[str, str], Pair] = {}


def pair_of(a_path: str, b_path: str) -> Pair:
    if (a_path, b_path) not in _pairs:
        _pairs[a_path, b_path] = Pair(a_path, b_path)
    return _pairs[a_path, b_path]


def key_text(key: bytes) -> str:
    """A key as decimal ids: a1,a2|b1."""
    ids = np.frombuffer(key, "<u4")
    return ",".join(map(str, ids[ids < B_SIDE].tolist())) + "|" + ",".join(map(str, (ids[ids >= B_SIDE] & ~B_SIDE).tolist()))


def counted_twice(doc: np.ndarray, number: np.ndarray, group: np.ndarray, pair: np.ndarray, n_pairs: int) -> np.ndarray:
    """For each pair, by how much the texts of its groups exceed the texts that hold it; rows (doc, number) and (group, pair) are distinct."""
    order = np.argsort(group, kind="stable")
    group, pair = group[order], pair[order]
    shared = np.bincount(pair, minlength=n_pairs)[pair] > 1
    group, pair = group[shared], pair[shared]
    first, stop = np.searchsorted(group, number), np.searchsorted(group, number, side="right")
    size = stop - first
    ends = np.cumsum(size)
    held = pair[np.repeat(first - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
    distinct = np.unique(np.repeat(doc, size) * n_pairs + held) % max(n_pairs, 1)
    return np.bincount(held, minlength=n_pairs) - np.bincount(distinct, minlength=n_pairs)


def _batch(rows: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[c].cast(t) if c in columns else pa.nulls(rows, t) for c, t in ROWS.items()], names=list(ROWS))


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, pa.int32()))


def _blocks(a_path: str, b_path: str, block_bytes: int):
    def run(batches):
        own, block = pair_of(a_path, b_path), TaskContext.get().partitionId() << 32
        for batch in batches:
            for at, length in row_slices(batch.column("text"), block_bytes):
                block += 1
                a, n_a, b, n_b = own.encode(batch.column("text").slice(at, length))
                ends, keys = own.groups(a, b)
                interned = keys.dictionary_encode()
                number, keys = interned.indices.to_numpy().astype(np.int64), interned.dictionary
                # bytes up to each text's end, so groups up to there
                a_ends = np.concatenate([[0], np.cumsum(own.a_bytes.length[a])])
                stops = np.searchsorted(ends, a_ends[np.cumsum(n_a)], side="right")
                starts = np.concatenate([[0], stops[:-1]])
                doc = np.repeat(np.arange(length), stops - starts)
                held, times = np.unique(doc * len(keys) + number, return_counts=True)
                held_doc, held_number = held // max(len(keys), 1), held % max(len(keys), 1)
                names = list(map(key_text, keys.to_pylist()))
                order = number.tolist()
                digests = [hashlib.sha256(";".join(map(names.__getitem__, order[i:j])).encode()).hexdigest() if j > i else "" for i, j in zip(starts.tolist(), stops.tolist(), strict=True)]
                bounds, blocks = np.searchsorted(held_doc, np.arange(length + 1)), pa.array(np.full(max(length, len(keys)), block))
                n_groups = stops - starts
                yield _batch(
                    length, kind=pa.array(["text"] * length), block=blocks[:length], doc_id=batch.column("doc_id").slice(at, length), n_a=pa.array(n_a), n_b=pa.array(n_b), n_groups=pa.array(n_groups),
                    n_links=pa.array(n_a + n_b - n_groups), groups_sha256=pa.array(digests), groups=_lists(held_number, bounds), times=_lists(times, bounds),
                )
                n_docs = np.bincount(held_number, minlength=len(keys))
                yield _batch(len(keys), kind=pa.array(["group"] * len(keys)), block=blocks[: len(keys)], number=pa.array(np.arange(len(keys))), key=keys, n=pa.array(n_docs))
                group, a, b = own.links(keys)
                pairs, pair = np.unique(a << 32 | b, return_inverse=True)
                linked = np.unique(group * max(len(pairs), 1) + pair)
                over = counted_twice(held_doc, held_number, linked // max(len(pairs), 1), linked % max(len(pairs), 1), len(pairs))
                found = np.flatnonzero(over)
                yield _batch(len(found), kind=pa.array(["over"] * len(found)), a=pa.array(pairs[found] >> 32), b=pa.array(pairs[found] & 0xFFFFFFFF), n=pa.array(over[found]))

    return run


def interned(docs: DataFrame, a_path: str, b_path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows by kind: `text` (a row of docs), `group` (a distinct group of a block, n texts have it) and `over` (n texts too many for a pair)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_blocks(a_path, b_path, block_bytes), FIELDS)


def expanded(groups: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """key, n, a, b, times: the distinct links of distinct groups(key, n) and how often the group has them."""

    def run(batches):
        own = pair_of(a_path, b_path)
        for batch in batches:
            group, a, b = own.links(batch.column("key"))
            order = np.lexsort((b, a, group))
            rows = np.stack([group[order], a[order], b[order]])
            first = np.flatnonzero(np.concatenate([[True], (rows[:, 1:] != rows[:, :-1]).any(axis=0)])) if rows.size else np.empty(0, np.int64)
            times = np.diff(np.append(first, rows.shape[1]))
            group, a, b = rows[:, first]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(pa.array(group)), batch.column("n").take(pa.array(group)), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(times)], names=["key", "n", "a", "b", "times"]
            )

    return groups.select("key", "n").mapInArrow(run, "key binary, n long, a int, b int, times long")


def _summed(texts: pa.Table, values: pa.Table) -> pa.Table:
    """The sums over each text's groups from one block's values by group number."""
    best, total = np.zeros(values.num_rows, np.int64), np.zeros(values.num_rows, np.int64)
    number = values.column("number").to_numpy()
    best[number], total[number] = values.column("best").to_numpy(), values.column("total").to_numpy()
    groups, times = texts.column("groups").combine_chunks(), texts.column("times").combine_chunks()
    at, times = groups.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(groups).to_numpy(zero_copy_only=False))]).astype(np.int64)
    out = {}
    for name, own in (("n_best", best), ("count_sum", total)):
        upto = np.concatenate([[0], np.cumsum(own[at] * times)])
        out[name] = pa.array(upto[bounds[1:]] - upto[bounds[:-1]])
    kept = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    return pa.table([*[texts.column(c) for c in kept], out["n_best"], out["count_sum"], texts.column("groups_sha256")], names=[*kept, "n_best", "count_sum", "groups_sha256"])


def link_counts(links: DataFrame, over: DataFrame) -> DataFrame:
    """a, b, n, best: in how many texts each pair is linked, and whether no pair of the same A id is in more."""
    pairs = links.select("a", "b", "n").unionAll(over.select("a", "b", -F.col("n"))).groupBy("a", "b").agg(F.sum("n").alias("n"))
    return pairs.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("a")))  # at most B's vocabulary an A id


def aligned(docs: DataFrame, a_path: str, b_path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of docs(doc_id, text)."""
    rows = write_shared(interned(docs, a_path, b_path, block_bytes), "alignment")
    groups = rows.where("kind = 'group'").select("block", "number", "key", "n")
    links = write_shared(expanded(groups.groupBy("key").agg(F.sum("n").alias("n")), a_path, b_path), "alignment-links")
    counts = link_counts(links, rows.where("kind = 'over'")).withColumnRenamed("n", "n_texts")
    sums = links.join(counts, ["a", "b"]).groupBy("key").agg(F.sum(F.col("times") * F.col("n_texts")).alias("total"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("best"))
    values = groups.select("block", "number", "key").join(sums, "key").select(F.col("block").alias("of"), "number", "best", "total")
    texts = rows.where("kind = 'text'").select("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "times")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return texts.groupBy("block").cogroup(values.groupBy("of")).applyInArrow(_summed, schema)
