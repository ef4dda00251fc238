"""Collocations from depth-limited count tries: how often phrases of up to DEPTH words occur, and how firmly they hold together.

Each shard (a slice of a few megabytes of one language's texts) makes a trie of the words that follow each word within a
piece, DEPTH words deep, with the number of times that each path ends. It is serialised in order: its distinct words
sorted by bytes, then its paths sorted, each without the words it shares with the path before it, compressed. The shard cuts its trie
into prefix ranges; a range's tries from all shards are merged in one task by sorting their paths together (the runs are
sorted already), and a walk over the merged trie sums the counts below every node.

A prefix range must not grow with one frequent word. So a first pass counts single words (depth one needs no trie),
and a path's range comes from its first words up to the first one that is not among the most frequent words, at least
two: the more frequent a beginning, the deeper it is cut. A node above the cut gets one partial count from each range
and they are summed. Which words count as frequent, and the number of ranges, only deal out the work.

Words that occur fewer than `least` times in their language can't be in a phrase that occurs that often, so shards leave out
paths through them; they know them by a bitmap of BITS hashed bits. Words that share a bit with a frequent one stay in
longer; nothing is lost.

Nodes with `least` occurrences form a table. A phrase is cut in two after its first k words: its left parts are the nodes on
its way down, its right parts the nodes along its suffix links (drop the first word), so both lists grow by one join a depth.

Defined cases: a null text is empty; a null language is `und`; equal rows count each; texts of any length are read whole; a
table without rows, or languages without frequent phrases, give no rows; other columns of the input are not read.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.ngrams import mix, row_slices, utf8, word_hashes
from factloom.llm.shared import write_shared

DEPTH, LEAST, TOP, SHARE = 4, 30, 2000, 80
SHARD_BYTES, RANGE_WORDS = 8 << 20, 1 << 20
BITS, HOT = 1 << 24, 1 << 14
BLOCK_BITS = 1 << 16
SLICES = 64

#: For each byte: 0 part of a word, 1 between words, 2 between pieces.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2


def split(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of texts, A-Z in lower case, and a number for the piece that each lies in (different for different texts)."""
    data, offsets = utf8(column)
    capital = (data >= 0x41) & (data <= 0x5A)
    data = data + capital.astype(np.uint8) * np.uint8(32)
    kind = _KIND[data]
    inside = kind == 0
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    stops = np.flatnonzero(inside & np.append(~inside[1:] | first[1:-1], True)) + 1 if len(data) else starts
    piece = np.cumsum((kind == 2) | first[:-1])
    bounds = np.concatenate([[0], np.cumsum(stops - starts)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data[inside])])
    return words, piece[starts]


def hashes(words: pa.Array) -> np.ndarray:
    data, offsets = utf8(words)
    return word_hashes(data, offsets[:-1], offsets[1:])


def _lang_hash(lang: str) -> np.uint64:
    return hashes(pa.array([lang]))[0]


def _by_lang(batch: pa.RecordBatch, most: int):
    """(language, texts) of slices of a batch with columns lang and text."""
    langs = batch.column("lang").dictionary_encode()
    for k, lang in enumerate(langs.dictionary.to_pylist()):
        texts = batch.column("text").filter(pc.equal(langs.indices, k))
        for at, length in row_slices(texts, most):
            yield lang, texts.slice(at, length)


def _word_counts(batches):
    for batch in batches:
        for lang, texts in _by_lang(batch, SHARD_BYTES):
            words = split(texts)[0].dictionary_encode()
            n = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))
            if len(n):
                columns = [pa.array([lang] * (len(n) + 1)), pa.concat_arrays([words.dictionary.cast(pa.string()), pa.array([None], pa.string())]), pa.array(np.append(n, n.sum()))]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "word", "f"])


def word_counts(docs: DataFrame, least: int) -> DataFrame:
    """lang, word, f of words that occur at least `least` times; the row of each language with a null word has the count of all."""
    counts = docs.mapInArrow(_word_counts, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))
    return counts.where(F.col("word").isNull() | (F.col("f") >= least))


def _bits(batches):
    for batch in batches:
        langs = batch.column("lang").dictionary_encode()
        own = np.array([_lang_hash(x) for x in langs.dictionary.to_pylist()], np.uint64)
        bit = mix(hashes(batch.column("word")) + own[langs.indices.to_numpy()]) % np.uint64(BITS) if batch.num_rows else np.empty(0, np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array((bit // BLOCK_BITS).astype(np.int32)), pa.array((bit % BLOCK_BITS).astype(np.int32))], names=["block", "bit"])


def frequent_bits(words: DataFrame) -> np.ndarray:
    """A bitmap of BITS bits (2 MB) in which the bit of every word of words(lang, word) is set."""

    def pack(table: pa.Table) -> pa.Table:
        marked = np.zeros(BLOCK_BITS, np.uint8)
        marked[table.column("bit").to_numpy()] = 1
        return pa.table({"block": table.column("block")[:1], "bits": pa.array([np.packbits(marked).tobytes()], pa.binary())})

    blocks = words.select("lang", "word").mapInArrow(_bits, "block int, bit int").distinct().groupBy("block").applyInArrow(pack, "block int, bits binary")
    out = np.zeros((BITS // BLOCK_BITS, BLOCK_BITS // 8), np.uint8)
    for row in blocks.toLocalIterator():  # at most 256 rows of 8 KB
        out[row.block] = np.frombuffer(row.bits, np.uint8)
    return out.reshape(-1)


def paths_of(number: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """For each word, itself and those that follow in its piece, DEPTH in all, as numbers from 1; 0 fills up. A word numbered 0 ends the path."""
    paths = np.zeros((len(number), DEPTH), np.int32)
    paths[:, 0] = number
    for k in range(1, DEPTH):
        goes_on = (piece[k:] == piece[:-k]) & (paths[:-k, k - 1] > 0) if len(number) > k else np.empty(0, bool)
        paths[: len(goes_on), k] = np.where(goes_on, number[k:], 0)
    return paths


def _keys(paths: np.ndarray) -> list[np.ndarray]:
    """Keys that sort paths in trie order, the most important last (as lexsort takes them)."""
    width = max(int(paths.max(initial=0)).bit_length(), 1)
    if DEPTH * width <= 63:
        key = np.zeros(len(paths), np.int64)
        for k in range(DEPTH):
            key = key << width | paths[:, k]
        return [key]
    return [paths[:, k].astype(np.int64) << 31 | paths[:, k + 1] for k in range(DEPTH - 2, -1, -2)]


def summed(paths: np.ndarray, n: np.ndarray, also: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Distinct paths in order and their counts; with `also`, sorted by it first (it must depend on the path alone)."""
    keys = _keys(paths) + ([also] if also is not None else [])
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys)
    paths = paths[order]
    first = np.flatnonzero(np.concatenate([[True], (paths[1:] != paths[:-1]).any(axis=1)])) if len(paths) else np.empty(0, np.int64)
    return paths[first], np.add.reduceat(n[order], first) if len(first) else n[:0], None if also is None else also[order][first]


def ranges(paths: np.ndarray, hashed: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of the words that place each path, and how many these are; hashed and hot go by word number (0: none)."""
    found, depth, open_ = np.zeros(len(paths), np.uint64), np.zeros(len(paths), np.int64), np.ones(len(paths), bool)
    all_hot = np.ones(len(paths), bool)
    for k in range(DEPTH):
        here = open_ & (paths[:, k] > 0)
        found[here] = mix(found[here] * np.uint64(31) + hashed[paths[here, k]])
        depth[here] += 1
        all_hot[here] &= hot[paths[here, k]]
        open_ = here & (all_hot | (depth < 2))
    return found, depth


def _planes(numbers: np.ndarray) -> bytes:
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _joined(body: bytes, n: int, at: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(body, np.uint8, 4 * n, at).reshape(4, n).T).view("<u4").reshape(-1)


def pack(words: pa.Array, paths: np.ndarray, n: np.ndarray) -> bytes:
    """A trie: its words (sorted), and its sorted paths, each as the number of words shared with the one before, its depth, the further words and its count.

    Numbers stand in planes (all lowest bytes first), which compress far better than number by number.
    """
    used = np.unique(paths[paths > 0])
    place = np.zeros(int(used.max(initial=0)) + 1, np.uint32)
    place[used] = np.arange(len(used))
    data, offsets = utf8(words.take(pa.array(used - 1)))
    depth = (paths > 0).sum(axis=1).astype(np.uint8)
    same = np.cumprod(paths[1:] == paths[:-1], axis=1).sum(axis=1) if len(paths) else np.empty(0, np.int64)
    shared = np.minimum(np.concatenate([[0], same]) if len(paths) else same, depth).astype(np.uint8)
    at = np.arange(DEPTH)
    new = (at >= shared[:, None]) & (at < depth[:, None])
    ids = place[paths[new]]
    body = struct.pack("<III", len(used), len(paths), len(ids)) + np.diff(offsets).astype("<u4").tobytes() + data.tobytes() + shared.tobytes() + depth.tobytes() + _planes(ids) + _planes(n)
    return struct.pack("<I", len(body)) + pa.compress(body, codec="zstd", asbytes=True)


def unpack(body: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words, paths (numbers from 1) and counts of a packed trie."""
    body = pa.decompress(body[4:], decompressed_size=struct.unpack_from("<I", body)[0], codec="zstd", asbytes=True)
    n_words, n_paths, n_ids = struct.unpack_from("<III", body)
    lengths = np.frombuffer(body, "<u4", n_words, 12)
    bounds = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]).astype(np.int64)
    at = 12 + 4 * n_words
    words = pa.Array.from_buffers(pa.large_string(), n_words, [None, pa.py_buffer(bounds), pa.py_buffer(body[at : at + int(bounds[-1])])])
    at += int(bounds[-1])
    shared, depth = np.frombuffer(body, np.uint8, n_paths, at), np.frombuffer(body, np.uint8, n_paths, at + n_paths)
    ids = _joined(body, n_ids, at + 2 * n_paths)
    n = _joined(body, n_paths, at + 2 * n_paths + 4 * n_ids).astype(np.int64)
    level = np.arange(DEPTH)
    new = (level >= shared[:, None]) & (level < depth[:, None])
    paths = np.zeros((n_paths, DEPTH), np.int64)
    paths[new] = ids.astype(np.int64) + 1
    row = np.arange(n_paths)
    for k in range(DEPTH):  # a shared word is that of the last path that named one at this depth
        last = np.maximum.accumulate(np.where(new[:, k], row, 0))
        paths[:, k] = np.where(k < depth, paths[last, k], 0)
    return words, paths, n


def _shards(bitmap, hot_words, n_ranges: int):
    def run(batches):
        bits, hot = bitmap.value, hot_words.value
        for batch in batches:
            for lang, texts in _by_lang(batch, SHARD_BYTES):
                words, piece = split(texts)
                if not len(words):
                    continue
                words = words.dictionary_encode()
                known = words.dictionary
                own = mix(hashes(known) + _lang_hash(lang))
                bit = own % np.uint64(BITS)
                stays = (bits[bit >> np.uint64(3)] >> (np.uint64(7) - (bit & np.uint64(7))).astype(np.uint8)) & 1
                order = pc.sort_indices(known).to_numpy().astype(np.int64)  # by bytes
                order = order[stays[order] > 0]
                number = np.zeros(len(known), np.int64)
                number[order] = np.arange(1, len(order) + 1)
                paths = paths_of(number[words.indices.to_numpy()], piece)
                paths = paths[paths[:, 1] > 0]  # single words are counted already
                hashed = np.concatenate([[np.uint64(0)], own[order]])
                where = ranges(paths, hashed, np.isin(hashed, hot))[0] % np.uint64(n_ranges)
                paths, n, where = summed(paths, np.ones(len(paths), np.int64), where.astype(np.int64))
                known = known.take(pa.array(order))
                bounds = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1], [True]])) if len(where) else np.zeros(1, np.int64)
                out = [(int(where[i]), pack(known, paths[i:j], n[i:j])) for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                for at in range(0, len(out), 64):
                    part = out[at : at + 64]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array([x for x, _ in part], pa.int64()), pa.array([x for _, x in part], pa.binary())], names=["lang", "range", "trie"])

    return run


def nodes(words: pa.Array, paths: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes below depth one of a sorted trie (paths filled up with 0) and the counts of all that ends at or below them."""
    found, counts = [], []
    for depth in range(2, DEPTH + 1):
        deep = paths[:, depth - 1] > 0
        part, own = paths[deep].copy(), n[deep]
        part[:, depth:] = 0
        first = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]).any(axis=1)])) if len(part) else np.empty(0, np.int64)
        found.append(part[first])
        counts.append(np.add.reduceat(own, first) if len(first) else own[:0])
    return np.concatenate(found), np.concatenate(counts)


def merge(tries: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words (sorted), paths and counts of several tries together."""
    parts = [unpack(t) for t in tries]
    words = pa.chunked_array([p[0] for p in parts]).combine_chunks().dictionary_encode()
    order = pc.sort_indices(words.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(1, len(order) + 1)
    place, at, paths = rank[words.indices.to_numpy()], 0, []
    for own, p, _ in parts:
        paths.append(np.concatenate([[0], place[at : at + len(own)]])[p])
        at += len(own)
    merged, n, _ = summed(np.concatenate(paths), np.concatenate([p[2] for p in parts]))
    return words.dictionary.take(order), merged, n


def _merged(hot_words, least: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        lang = key[0].as_py()
        words, paths, n = merge(table.column("trie").to_pylist())
        hashed = np.concatenate([[np.uint64(0)], mix(hashes(words) + _lang_hash(lang))])
        found, f = nodes(words, paths, n)
        depth = (found > 0).sum(axis=1)
        # a node that the range's words reach is whole here; one above may have counts in other ranges
        hot = np.concatenate([[True], np.isin(hashed[1:], hot_words.value)])
        partial = hot[found].all(axis=1) & (depth < DEPTH)
        kept = partial | (f >= least)
        found, f, depth = found[kept], f[kept], depth[kept]
        flat = found[found > 0] - 1
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(depth)]), pa.int32()), words.cast(pa.string()).take(pa.array(flat)))
        return pa.table([pa.array([lang] * len(f), pa.string()), lists, pa.array(f)], names=["lang", "words", "f"])

    return run


def phrases(docs: DataFrame, counts: DataFrame, least: int = LEAST, range_words: int = RANGE_WORDS, hot_words: int = HOT) -> DataFrame:
    """lang, words, f of all phrases of 2 to DEPTH words that occur `least` times, of docs(lang, text) and their word_counts."""
    sc = docs.sparkSession.sparkContext
    total = counts.where("word is null").agg(F.sum("f")).first()[0] or 0
    bitmap = sc.broadcast(frequent_bits(counts.where("word is not null")))
    share = max(total // hot_words, range_words)
    rows = counts.where(F.col("word").isNotNull() & (F.col("f") > share)).select("lang", "word").toArrow()  # fewer than hot_words rows
    own = [mix(hashes(pa.array([r["word"]])) + _lang_hash(r["lang"]))[0] for r in rows.to_pylist()]
    hot = sc.broadcast(np.array(own, np.uint64))
    n_ranges = max(total // range_words, 32)
    tries = docs.mapInArrow(_shards(bitmap, hot, n_ranges), "lang string, range long, trie binary")
    merged = tries.groupBy("lang", "range").applyInArrow(_merged(hot, least), "lang string, words array<string>, f long")
    return merged.groupBy("lang", "words").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def with_parts(found: DataFrame) -> DataFrame:
    """lang, words, f, lefts, rights of all nodes(lang, words, f): the counts of the first 1, 2, … and of all but the first 1, 2, … words."""
    size = F.size("words")
    none = F.array().cast("array<long>")
    level = found.where(size == 1).select("lang", "words", "f", none.alias("lefts"), none.alias("rights"))
    out = None
    for depth in range(2, DEPTH + 1):
        own = found.where(size == depth).select("lang", "words", "f", F.slice("words", 1, depth - 1).alias("parent"), F.slice("words", 2, depth - 1).alias("suffix"))
        up = level.select("lang", F.col("words").alias("parent"), F.concat("lefts", F.array("f")).alias("lefts"))
        link = level.select("lang", F.col("words").alias("suffix"), F.concat(F.array("f"), "rights").alias("rights"))
        level = own.join(up, ["lang", "parent"]).join(link, ["lang", "suffix"]).select("lang", "words", "f", "lefts", "rights")
        out = level if out is None else out.unionByName(level)
    return out


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(2000000 a / (left + right)) in whole numbers of 38 digits."""
    wide = [c.cast("decimal(19,0)") for c in (a, left, right)]
    return F.call_function("div", F.lit(2_000_000).cast("decimal(7,0)") * wide[0], wide[1] + wide[2])


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, share: int = SHARE, range_words: int = RANGE_WORDS, hot_words: int = HOT) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `top` phrases by the lowest score over their cuts.

    A phrase inside a longer one that has at least `share` percent of its occurrences is left out.
    """
    own = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    counts = write_shared(word_counts(own, least), "collocation-words")
    single = counts.where("word is not null").select("lang", F.array("word").alias("words"), "f")
    found = write_shared(single.unionByName(phrases(own, counts, least, range_words, hot_words)), "collocation-nodes")
    whole = found.where(F.size("words") > 1)
    inner = whole.where(F.size("words") > 2).select("lang", F.col("f").alias("longer"), F.explode(F.array_distinct(F.flatten(F.array(*[_windows(k) for k in range(2, DEPTH)])))).alias("words"))
    inner = inner.groupBy("lang", "words").agg(F.max("longer").alias("longer"))
    scored = with_parts(found).withColumn("score", F.transform(F.arrays_zip("lefts", "rights"), lambda c: score(F.col("f"), c["lefts"], c["rights"])))
    scored = scored.withColumn("low", F.array_min("score")).withColumn("k", F.array_position("score", F.col("low")).cast("int"))
    kept = scored.join(inner, ["lang", "words"], "left").where(F.col("longer").isNull() | (F.lit(100).cast("decimal(3,0)") * F.col("longer").cast("decimal(19,0)") < F.lit(share).cast("decimal(3,0)") * F.col("f").cast("decimal(19,0)")))
    kept = kept.select("lang", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"), F.element_at("lefts", F.col("k")).alias("l"), F.element_at("rights", F.col("k")).alias("r"), F.col("low").alias("score"))
    best = [F.desc("score"), F.desc("a"), "phrase"]
    # the best of each slice first, so no task sees all phrases of a language
    kept = kept.withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(SLICES)))
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "slice").orderBy(*best))).where(F.col("rank") <= top)
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    sizes = counts.where("word is null").select("lang", F.col("f").alias("n"))
    return kept.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _windows(k: int) -> Column:
    """All runs of k words of the column words that are not the whole."""
    size = F.size("words")
    return F.when(size > k, F.transform(F.sequence(F.lit(1), F.greatest(size - k + 1, F.lit(1))), lambda at: F.slice("words", at, k))).otherwise(F.array().cast("array<array<string>>"))
