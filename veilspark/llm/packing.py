"""Best-fit packing of documents into bins of fixed size, without conflicts in a bin."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import staged, words_in

CAPACITY = 2048
#: Pieces that one task packs, about; the number of blocks follows the number of pieces.
PIECES_A_BLOCK = 16_000


class Bins:
    """Open bins by residual space. Bins carry bitmaps of the sources and duplicate clusters inside. A segment tree over
    residuals holds, for each range, the sources that every bin there has; so the successor search skips ranges without a
    bin that takes the source, and goes on past bins that hold the cluster, to the tightest compatible bin."""

    def __init__(self, capacity: int):
        self.width = 1
        while self.width < capacity + 1:
            self.width *= 2
        self.blocked = [-1] * (2 * self.width)  # -1: all bits, that is no bin
        self.levels: list[dict[int, list[int]]] = [{} for _ in range(capacity + 1)]
        self.clusters: list[int] = []

    def _refresh(self, level: int) -> None:
        mask = -1
        for sources in self.levels[level]:
            mask &= sources
        i = level + self.width
        self.blocked[i] = mask
        while i > 1:
            i //= 2
            self.blocked[i] = self.blocked[2 * i] & self.blocked[2 * i + 1]

    def _next(self, level: int, source: int) -> int | None:
        """Smallest residual from level on with a bin free of source."""
        i = level + self.width
        while self.blocked[i] & source:
            while i & 1:
                i //= 2
                if i <= 1:
                    return None
            if i <= 1:
                return None
            i += 1
        while i < self.width:
            i *= 2
            if self.blocked[i] & source:
                i += 1
        return i - self.width

    def put(self, size: int, source: int, cluster: int, capacity: int) -> int:
        """The bin, perhaps a new one, that takes a piece; source and cluster are single bits (cluster 0: no copies)."""
        level = size
        while level < len(self.levels) and (level := self._next(level, source)) is not None and level < len(self.levels):
            for sources, bins in self.levels[level].items():
                if sources & source:
                    continue
                for k, b in enumerate(bins):
                    if not self.clusters[b] & cluster:
                        bins[k] = bins[-1]
                        bins.pop()
                        if not bins:
                            del self.levels[level][sources]
                        self._refresh(level)
                        self._open(b, level - size, sources | source, cluster)
                        return b
            level += 1
        self.clusters.append(0)
        self._open(len(self.clusters) - 1, capacity - size, source, cluster)
        return len(self.clusters) - 1

    def _open(self, b: int, residual: int, sources: int, cluster: int) -> None:
        self.clusters[b] |= cluster
        if residual:
            self.levels[residual].setdefault(sources, []).append(b)
            self._refresh(residual)


def pack_block(sizes: list[int], sources: list, clusters: list, capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each piece. Pieces of one block, largest first. A full piece has its bin to itself."""
    bins, room = Bins(capacity), {}
    source_bits = {s: 1 << i for i, s in enumerate(dict.fromkeys(sources))}
    seen: dict = {}
    for c in clusters:
        seen[c] = seen.get(c, 0) + 1
    cluster_bits = {c: 1 << i for i, c in enumerate(c for c, n in seen.items() if n > 1)}
    out = []
    for size, s, c in zip(sizes, sources, clusters, strict=True):
        b = bins.put(size, source_bits[s], cluster_bits.get(c, 0), capacity)
        out.append((b, room.get(b, 0)))
        room[b] = room.get(b, 0) + size
    return out


def pieces_of(docs: DataFrame, capacity: int) -> DataFrame:
    """doc_id, source (as a string), cluster (MD5 of the text), piece, start_word, n_words: texts over the capacity are cut in pieces."""
    sized = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("cluster"), words_in(F.col("text")).alias("size"))
    cuts = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("size") / capacity) - 1, F.lit(0)).cast("int")))
    cut = sized.withColumn("piece", cuts).withColumn("start_word", F.col("piece").cast("long") * capacity)
    return cut.select("doc_id", "source", "cluster", "piece", "start_word", F.least(F.col("size") - F.col("start_word"), F.lit(capacity).cast("long")).alias("n_words"))


def packed(docs: DataFrame, capacity: int = CAPACITY, pieces_a_block: int = PIECES_A_BLOCK) -> DataFrame:
    """A row for each piece of each document: bin, bin_offset (words before it in the bin), doc_id, source, piece,
    start_word, n_words.

    Sizes are words. No bin exceeds the capacity or holds two pieces of one source or of equal texts. Pieces without words
    (null or empty texts) take no room: bin null, offset 0. A null source is a source of its own. doc_id may be of any type
    and null. Equal rows are numbered and packed each for itself. Blocks of pieces, dealt by hash of the piece and that number,
    are packed in parallel, so up to a few bins a block stay part empty. Ties in size go by doc_id, piece, text and number. An
    empty table gives no rows. Other columns are ignored.
    """
    same = ["doc_id", "source", "cluster", "piece", "start_word", "n_words"]
    pieces = pieces_of(docs, capacity).groupBy(*same).agg(F.count("*").alias("copies"))  # equal rows meet map-side
    pieces = staged(pieces.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copies"), "pieces")
    blocks = max(1, -(-pieces.count() // pieces_a_block))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def one_block(key: tuple, rows: pa.Table) -> pa.Table:
        order = [("n_words", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("cluster", "ascending"), ("copy", "ascending"), ("source", "ascending")]
        rows = rows.sort_by(order)
        spots = pack_block(rows["n_words"].to_pylist(), rows["source"].to_pylist(), rows["cluster"].to_pylist(), capacity)
        name = key[0].as_py()
        return pa.table({"bin": pa.array([f"{name}-{b}" for b, _ in spots], pa.string()), "bin_offset": pa.array([o for _, o in spots], pa.int64())} | {c: rows[c] for c in ("doc_id", "source", "piece", "start_word", "n_words")})

    schema = f"bin string, bin_offset long, doc_id {id_type}, source string, piece int, start_word long, n_words long"
    some = pieces.filter("n_words > 0").withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "cluster", "copy"), F.lit(blocks)).cast("int"))
    none = pieces.filter("n_words <= 0").select(F.lit(None).cast("string").alias("bin"), F.lit(0).cast("long").alias("bin_offset"), "doc_id", "source", "piece", "start_word", F.lit(0).cast("long").alias("n_words"))
    return some.groupBy("block").applyInArrow(one_block, schema).union(none)
