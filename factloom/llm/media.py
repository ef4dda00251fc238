"""Media columns as content-defined chunks.

Media bytes are cut where a rolling gear hash of the last 32 bytes has MASK's bits all zero (no cut within MIN bytes of
the last one, always one after MAX). Chunks are named by their SHA-256; an aggregation by digest keeps each once, and a
recipe, the ordered list of digests, names a whole. Equal media have one recipe. A join of recipes with chunks puts the
bytes together again, and a digest that doesn't match stops the job.

Where a chunk is used by many recipes, its uses are dealt over salted copies of it, USES to a copy. A recipe of one chunk
needs no join: the chunk is the media.

The media form used here for payloads is a binary grey map (PGM, one 8-bit sample a byte), WIDTH samples a line, so its
samples are the payload itself.

Defined cases: null payloads count as empty and empty ones are padded to one line; equal payloads share one recipe; an
empty table has no chunks; recipes that repeat a chunk use it as often as they list it.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.shared import small_side, write_shared

MIN, MAX = 2048, 65536
MASK = np.uint32(0xFFF80000)  # 13 bits: a cut each 8192 bytes on average
WINDOW = 32
USES = 1000
WIDTH, PAD = 576, 255


def _gear() -> np.ndarray:
    """One number for each byte value, from SHA-256 of the value."""
    return np.array([int.from_bytes(hashlib.sha256(bytes([b])).digest()[:4], "little") for b in range(256)], np.uint32)


GEAR = _gear()


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of data."""
    n = len(data)
    if n <= MIN:
        return [n] if n else []
    h = GEAR[np.frombuffer(data, np.uint8)]
    reach = 1
    while reach < WINDOW:  # h at i covers twice as many bytes each time
        h[reach:] += h[:-reach] << np.uint32(reach)
        reach *= 2
    places = np.flatnonzero((h & MASK) == 0) + 1
    ends, last = [], 0
    while n - last > MIN:
        at = np.searchsorted(places, last + MIN)
        end = int(places[at]) if at < len(places) else n
        last = min(end, last + MAX, n)
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


def chunks(data: bytes) -> list[bytes]:
    at, found = 0, []
    for end in cuts(data):
        found.append(data[at:end])
        at = end
    return found


def to_media(payload: bytes) -> bytes:
    """The payload as a grey map; its length must be a multiple of WIDTH."""
    return b"P5 %d %d 255\n" % (WIDTH, len(payload) // WIDTH) + payload


def samples(media: bytes) -> np.ndarray:
    """Lines of samples of a grey map made by to_media."""
    head, _, body = media.partition(b"\n")
    kind, width, height, depth = head.split()
    if (kind, depth) != (b"P5", b"255"):
        raise ValueError("not an 8-bit grey map")
    return np.frombuffer(body, np.uint8).reshape(int(height), int(width))


def padded(text: str | None) -> tuple[int, bytes]:
    """UTF-8 bytes of a text: their number, and filled up with PAD to a positive multiple of WIDTH."""
    raw = (text or "").encode()
    return len(raw), raw + bytes([PAD]) * (-len(raw) % WIDTH if raw else WIDTH)


def features(grid: np.ndarray) -> str:
    """Eight shares of sample values, mean step along a line and mean step between lines, in thousandths."""
    shares = np.bincount(grid.reshape(-1) >> 5, minlength=8) * 1000 // grid.size
    wide = grid.astype(np.int32)
    along = int(np.abs(np.diff(wide, axis=1)).sum() * 1000 // max(1, grid.shape[0] * (grid.shape[1] - 1)))
    down = int(np.abs(np.diff(wide, axis=0)).sum() * 1000 // max(1, (grid.shape[0] - 1) * grid.shape[1]))
    return f"{grid.shape[1]}x{grid.shape[0]};h={','.join(map(str, shares.tolist()))};dx={along};dy={down}"


def _recipes(batches):
    for batch in batches:
        n_bytes, names, lists = [], [], []
        for text in batch.column("text").to_pylist():
            n, payload = padded(text)
            media = to_media(payload)
            parts = chunks(media)
            n_bytes.append(n)
            names.append(hashlib.sha256(media).digest())
            lists.append([hashlib.sha256(c).digest() for c in parts] if len(parts) > 1 else names[-1:])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(names, pa.binary()), pa.array(lists, pa.list_(pa.binary()))], names=["doc_id", "n_bytes", "media", "digests"])


def _chunks(batches):
    """Digest, compressed bytes and kind of each chunk; a task sends a chunk once (while its memory of them lasts)."""
    pack = zstandard.ZstdCompressor(level=9)
    seen: set[tuple[bytes, int]] = set()
    for batch in batches:
        digests, bodies, kinds = [], [], []
        for text in batch.column("text").to_pylist():
            parts = chunks(to_media(padded(text)[1]))
            kind = WHOLE if len(parts) == 1 else PART
            for c in parts:
                d = hashlib.sha256(c).digest()
                if (d, kind) in seen:
                    continue
                if len(seen) < 200_000:
                    seen.add((d, kind))
                digests.append(d)
                bodies.append(pack.compress(c))
                kinds.append(kind)
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(bodies, pa.binary()), pa.array(kinds, pa.int32())], names=["digest", "body", "kind"])


def recipes_of(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (digest of the stored form), digests (of its chunks in order) of docs(doc_id, text)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_recipes, "doc_id long, n_bytes long, media binary, digests array<binary>")


WHOLE, PART = 1, 2


def chunk_store(docs: DataFrame) -> DataFrame:
    """digest, body (zstd), kinds: each distinct chunk once, and whether it is used as a WHOLE media, as a PART or (their sum) both."""
    sent = docs.select("text").mapInArrow(_chunks, "digest binary, body binary, kind int").where("digest is not null")
    return sent.groupBy("digest").agg(F.first("body").alias("body"), F.bit_or("kind").alias("kinds"))


def rebuilt(recipes: DataFrame, store: DataFrame, uses: int = USES) -> DataFrame:
    """media, parts (compressed chunks in order) for each distinct recipe(media, digests).

    Both branches read the same columns of the store, so Spark runs its aggregation once; the join by digest needs no
    further exchange of it. Only chunks with more than `uses` uses are sent again, in salted copies.
    """
    several = recipes.where(F.size("digests") > 1).groupBy("media").agg(F.first("digests").alias("digests"))
    entries = several.select("media", F.posexplode("digests").alias("pos", "digest"))
    busy = entries.groupBy("digest").agg(F.count("*").alias("n")).where(F.col("n") > uses).select("digest", F.ceil(F.col("n") / uses).cast("int").alias("copies"))
    busy = write_shared(busy, "media-busy")
    parts = store.where(F.col("kinds").bitwiseAND(F.lit(PART)) > 0).select("digest", "body")
    if busy.limit(1).count() == 0:
        joined = entries.join(parts, "digest")
    else:
        plain = entries.join(small_side(busy), "digest", "left_anti").join(parts, "digest").select("media", "pos", "body")
        salt = F.pmod(F.xxhash64("media", "pos"), F.col("copies")).cast("int")
        dealt = entries.join(small_side(busy), "digest").select("media", "pos", "digest", salt.alias("salt"))
        spread = parts.join(small_side(busy), "digest").select("digest", "body", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"))
        joined = plain.union(dealt.join(spread, ["digest", "salt"]).select("media", "pos", "body"))
    lists = joined.groupBy("media").agg(F.sort_array(F.collect_list(F.struct("pos", "body"))).alias("p"))
    alone = store.where(F.col("kinds").bitwiseAND(F.lit(WHOLE)) > 0).select("digest", F.array("body"))
    return lists.select("media", F.transform("p", lambda x: x["body"]).alias("parts")).union(alone)


MEDIA = "media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _read(batches):
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        rows = []
        for name, parts in zip(batch.column("media").to_pylist(), batch.column("parts"), strict=True):
            media = b"".join(unpack.decompress(p.as_py()) for p in parts)
            if hashlib.sha256(media).digest() != name:
                raise ValueError(f"media {name.hex()} came back changed")
            grid = samples(media)
            payload = grid.tobytes()
            rows.append((name, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), name.hex(), features(grid)))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate([pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()])], names=[x.split()[0] for x in MEDIA.split(", ")])


def read_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and what the rebuilt media of each row of docs(doc_id, text) gives (see MEDIA)."""
    recipes = write_shared(recipes_of(docs), "media-recipes")
    found = rebuilt(recipes, chunk_store(docs)).mapInArrow(_read, MEDIA)
    return recipes.select("doc_id", "n_bytes", "media").join(found, "media").drop("media")


def write_store(docs: DataFrame, to: str) -> None:
    """Write the recipes and the distinct chunks of docs as Parquet tables `recipes` and `chunks` under a path."""
    recipes_of(docs).write.parquet(f"{to}/recipes")
    chunk_store(docs).write.option("compression", "uncompressed").parquet(f"{to}/chunks")


def read_store(spark, at: str) -> DataFrame:
    """media and its parsed content (MEDIA) for every distinct recipe of a store that write_store wrote."""
    recipes = spark.read.parquet(f"{at}/recipes")
    return rebuilt(recipes, spark.read.parquet(f"{at}/chunks")).mapInArrow(_read, MEDIA)
