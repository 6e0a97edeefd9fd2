"""Substring deduplication: chunks of words taken by content, by gear hashes of their words, deduplicated by digest."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilspark.llm.common import skew_join, small_batches, staged

#: A chunk is RUN_WORDS words. Of any WINDOW neighbouring chunks the one with the least hash (the last of equal ones) is
#: taken, besides the first and the last of a text, so WINDOW + RUN_WORDS - 1 words that texts share, 32, hold a chunk that
#: is taken in each. A passage of over 50 words has 49 whole ones even if its ends touch other text.
WINDOW = 13
#: A repeated passage is a run of chunks that all occur elsewhere too, of at least so many bytes and words (20 words have 39).
RUN_BYTES, RUN_WORDS = 39, 20
GEAR = np.frombuffer(b"".join(hashlib.blake2b(bytes([i]), digest_size=4).digest() for i in range(256)), np.uint32).copy()
SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))


def gear_hashes(raw: np.ndarray) -> np.ndarray:
    """For each byte the gear hash of the (up to) 32 bytes that end there: sum of GEAR[b] << distance, modulo 2**32."""
    h = GEAR[raw]
    for k in (1, 2, 4, 8, 16):
        if len(h) > k:
            longer = h.copy()
            longer[k:] += h[:-k] << np.uint32(k)
            h = longer
    return h


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each word the gear hash of its (last 32) bytes alone: what stands before the word is taken off."""
    h, size = gear_hashes(raw), ends - starts
    before = np.where((starts > 0) & (size < 32), h[starts - 1], np.uint32(0))
    return h[ends - 1] - (before << np.minimum(size, 31).astype(np.uint32))


def least_of_windows(h: np.ndarray) -> np.ndarray:
    """Indices of the least hash, the last of equal ones, of each WINDOW neighbours (of all, if fewer), and of the ends."""
    back = np.arange(len(h) - 1, -1, -1, dtype=np.uint64)
    least, width = (h.astype(np.uint64) << np.uint64(32)) | back, 1
    while width < min(WINDOW, len(h)):
        k = min(width, min(WINDOW, len(h)) - width)
        least, width = np.minimum(least[:-k], least[k:]), width + k
    return np.unique(np.concatenate([[0, len(h) - 1], len(h) - 1 - (least & np.uint64(0xFFFFFFFF)).astype(np.int64)]))


def chunks_of(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the first word, start and end of the chunks taken from UTF-8 bytes; none below RUN_WORDS words."""
    space = np.concatenate([[True], SPACE[raw], [True]])
    starts, ends = np.flatnonzero(space[:-1] & ~space[1:]), np.flatnonzero(~space[:-1] & space[1:])
    n = len(starts) - RUN_WORDS + 1
    if n < 1:
        return (np.empty(0, np.int64),) * 3
    words, h = word_hashes(raw, starts, ends).astype(np.uint64), np.zeros(n, np.uint64)
    for k in range(RUN_WORDS):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n]
    taken = least_of_windows(((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32))
    return taken, starts[taken], ends[taken + RUN_WORDS - 1]


CHUNKS = "array<struct<pos:int,start:int,n_bytes:int,word:int,h1:bigint,h2:bigint>>"


def chunk_batch(text: pa.Array) -> pa.Array:
    """Chunks of each text of a batch, as CHUNKS."""
    offsets, parts, digests = [0], [], []
    for x in text:
        raw = (x.as_py() or "").encode("utf-8", "surrogatepass")
        word, s, e = chunks_of(np.frombuffer(raw, np.uint8))
        if len(word):
            parts.append(np.stack([np.arange(len(e)), s, e - s, word]).astype(np.int32))
            digests += [xxhash.xxh3_128_digest(raw[i:j]) for i, j in zip(s.tolist(), e.tolist(), strict=True)]
        offsets.append(offsets[-1] + len(word))
    cols = np.concatenate(parts, axis=1) if parts else np.empty((4, 0), np.int32)
    halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    flat = pa.StructArray.from_arrays([pa.array(c) for c in cols] + [pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())], ["pos", "start", "n_bytes", "word", "h1", "h2"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)


def chunk_table(docs: DataFrame) -> DataFrame:
    """A row for each chunk of each text: doc_id, row (of documents with that id, by text), pos, start, n_bytes, word, digest."""
    c = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), F.explode(F.arrow_udf(chunk_batch, CHUNKS)("text")).alias("c"))
    return c.select("doc_id", "row", "c.*").withColumn("digest", F.struct("h1", "h2")).drop("h1", "h2")


def repeated_chunks(chunks: DataFrame) -> DataFrame:
    """Digests of chunks at two or more places: digest, places, first (row and pos of the first place)."""
    where = F.struct("doc_id", "row", "pos")
    return chunks.groupBy("digest").agg(F.count("*").alias("places"), F.min(where).alias("first")).filter("places > 1")


def repeated_passages(docs: DataFrame, least_bytes: int = RUN_BYTES, least_words: int = RUN_WORDS) -> DataFrame:
    """Passages of documents that occur elsewhere too: doc_id, start_byte, end_byte (UTF-8, end exclusive), n_chunks,
    n_words, most_places (of a chunk), is_first (every chunk has its first place here; else none has).

    Maximal runs of neighbouring chunks that all occur at two or more places (in this or other documents) are kept if the run
    has least_bytes and least_words. A run gives a row for each part of it that is_first tells apart; as neighbouring chunks
    overlap, so do parts. A passage is found less up to WINDOW - 1 words at either end, whatever stands around it; one of
    WINDOW + RUN_WORDS - 1 words or more is always found. Null, empty and short texts have no runs. Equal rows each give
    their passages. Repeats of chunks that are frequent everywhere are counted map-side, and rows of hot digests are salted.
    """
    with small_batches(docs.sparkSession):
        chunks = staged(chunk_table(docs.select("doc_id", "text")), "chunks")
    again = staged(repeated_chunks(chunks), "repeated")
    hit = skew_join(chunks, again, "digest", "inner", F.col("row"))
    here = F.struct("doc_id", "row", "pos")
    hit = hit.select("doc_id", "row", "pos", "start", "n_bytes", "word", "places", (F.col("first") == here).alias("is_first"))
    # Runs: pos less its rank within the document is the same for neighbours. Equal rows rank together, by dense_rank.
    since = lambda *keys: F.col("pos") - F.dense_rank().over(Window.partitionBy("doc_id", "row", *keys).orderBy("pos"))
    runs = hit.withColumn("run", since()).withColumn("part", since("is_first")).groupBy("doc_id", "row", "run", "is_first", "part")
    out = runs.agg(F.min("start").cast("long").alias("start_byte"), F.max(F.col("start") + F.col("n_bytes")).cast("long").alias("end_byte"), F.countDistinct("pos").alias("n_chunks"), F.min("word").alias("_from"), F.max(F.col("word") + RUN_WORDS).alias("_to"), F.max("places").alias("most_places"))
    whole = Window.partitionBy("doc_id", "row", "run")
    extent = lambda a, b: F.max(b).over(whole) - F.min(a).over(whole)
    out = out.withColumn("_bytes", extent("start_byte", "end_byte")).withColumn("_words", extent("_from", "_to")).withColumn("n_words", (F.col("_to") - F.col("_from")).cast("long"))
    return out.filter((F.col("_bytes") >= least_bytes) & (F.col("_words") >= least_words)).select("doc_id", "row", "start_byte", "end_byte", "n_chunks", "n_words", "most_places", "is_first")


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with text less every passage that is not at its first place; n_chars, where there is one, is set anew. The first
        place of every chunk stays whole. Null and short texts stay as they are, and so do all other columns."""
    parts = F.array_sort(F.collect_set(F.struct("start_byte", "end_byte", "is_first")))
    spans = repeated_passages(docs).groupBy("doc_id", "row").agg(parts.alias("_spans"), F.bool_and("is_first").alias("_whole")).filter("not _whole")

    @F.arrow_udf("string")
    def cut(text: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for x, s in zip(text.to_pylist(), spans.to_pylist(), strict=True):
            if x is not None and s:
                raw = np.frombuffer(x.encode("utf-8", "surrogatepass"), np.uint8)
                stays = np.ones(len(raw), bool)
                for y in sorted(s, key=lambda y: y["is_first"]):
                    stays[y["start_byte"] : y["end_byte"]] = y["is_first"]
                x = raw[stays].tobytes().decode("utf-8", "surrogatepass")
            out.append(x)
        return pa.array(out, pa.string())

    # A document is told by its id and a hash of its text, so no hash that two texts share cuts the wrong one.
    spans = spans.select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"), "_spans")
    keyed = docs.withColumn("_hash", F.xxhash64("doc_id", "text"))
    found = keyed.join(spans, (F.col("_hash") == F.col("_row")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    with small_batches(docs.sparkSession):
        out = staged(found.withColumn("text", cut("text", "_spans")).select(*docs.columns), "without-repeats")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out
