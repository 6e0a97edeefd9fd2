"""Approximate nearest neighbours by largest inner product: hierarchical k-means tree, best-bin-first search."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilspark.llm.common import staged

#: Vectors from which the tree is fitted, at most, and queries on which the number of leaf visits is calibrated, at most.
SAMPLE, CALIBRATE = 20_000, 128
BRANCH, LEAF = 8, 128
#: Rows of neighbouring leaves that one task compares, about; a larger leaf is dealt over several groups. Queries that meet
#: them there, at most, about.
GROUP_ROWS, GROUP_QUERIES = 4_096, 4_096
#: Queries that one task routes, about.
ROUTE_ROWS = 512
RECALL = 0.94


@dataclass
class Node:
    """An inner node has centres (k, d) and children; a leaf has its number."""

    centres: np.ndarray | None = None
    children: list | None = None
    leaf: int = -1


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Centres and the nearest of them for each row."""
    centres = x[rng.choice(len(x), k, replace=False)]
    near = np.zeros(len(x), int)
    for _ in range(rounds):
        near = nearest_centre(x, centres)
        for j in range(k):
            if (mine := near == j).any():
                centres[j] = x[mine].mean(0)
    return centres, near


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((x * x).sum(1)[:, None] - 2 * np.einsum("nd,kd->nk", x, centres) + (centres * centres).sum(1)[None, :]).clip(0)


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return distances(x, centres).argmin(1)


def fit_tree(x: np.ndarray, leaf: int, seed: int = 5) -> tuple[Node, int]:
    """Split with BRANCH centres until a node has at most `leaf` sample rows or no two different ones. Tree and number of leaves."""
    rng, leaves = np.random.default_rng(seed), 0
    root = Node()
    todo = [(root, x)]
    while todo:  # depth first, so leaves with near numbers lie near each other
        node, rows = todo.pop()
        if len(rows) > leaf and len(rows) > BRANCH:
            centres, near = k_means(rows, BRANCH, rng)
            parts = [np.flatnonzero(near == j) for j in range(BRANCH)]
            if max(map(len, parts)) < len(rows):
                used = [j for j in range(BRANCH) if len(parts[j])]
                node.centres, node.children = centres[used], [Node() for _ in used]
                todo += [(c, rows[parts[j]]) for c, j in zip(node.children, used, strict=True)]
                continue
        node.leaf = leaves
        leaves += 1
    return root, leaves


def leaf_of(root: Node, x: np.ndarray) -> np.ndarray:
    """The leaf that each row descends to."""
    out, todo = np.zeros(len(x), int), [(root, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        if node.children is None:
            out[rows] = node.leaf
        elif len(rows):
            near = nearest_centre(x[rows], node.centres)
            todo += [(c, rows[near == j]) for j, c in enumerate(node.children)]
    return out


class Flat:
    """The tree as arrays: all centres in one matrix, so the distances of many queries to all of them are one product."""

    def __init__(self, root: Node):
        self.children: list[list[int]] = []  # rows of centres, by inner node
        self.leaf: list[int] = []  # by row of centres: the leaf there, or -1
        self.inner: list[int] = []  # by row of centres: the inner node there, or -1
        rows, todo = [], [root]
        number = {id(root): 0}
        self.only_leaf = root.leaf if root.children is None else -1
        while todo:
            node = todo.pop()
            if node.children is None:
                continue
            while len(self.children) <= number[id(node)]:
                self.children.append([])
            for centre, child in zip(node.centres, node.children, strict=True):
                self.children[number[id(node)]].append(len(rows))
                rows.append(centre)
                self.leaf.append(child.leaf)
                self.inner.append(-1)
                if child.children is not None:
                    number[id(child)] = len(number)
                    self.inner[-1] = number[id(child)]
                    todo.append(child)
        self.centres = np.array(rows)

    def leaves_by_nearness(self, queries: np.ndarray, visits: int) -> list[list[int]]:
        """Best bin first, for each query: the first `visits` leaves that a priority queue of branches, by the distance to
        their centres, yields."""
        if self.only_leaf >= 0:
            return [[self.only_leaf]] * len(queries)
        found = []
        squares = (queries * queries).sum(1)[:, None] - 2 * queries @ self.centres.T + (self.centres * self.centres).sum(1)[None, :]
        for d in squares.clip(0).tolist():
            queue, mine = [(d[r], r) for r in self.children[0]], []
            heapq.heapify(queue)
            while queue and len(mine) < visits:
                _, r = heapq.heappop(queue)
                if self.inner[r] < 0:
                    mine.append(self.leaf[r])
                else:
                    for c in self.children[self.inner[r]]:
                        heapq.heappush(queue, (d[c], c))
            found.append(mine)
        return found


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id and v (array<double>) of vectors that take part: not null, not zero, all components there and finite, and of
    the most frequent length (of equally frequent ones the smaller). Repeated rows stay."""
    v = F.transform(F.col(embedding), lambda x: x.cast("double"))
    rows = vectors.select(F.col(vec_id).alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.filter(F.coalesce(fine, F.lit(False)))


def as_matrix(column: pd.Series, width: int) -> np.ndarray:
    return np.array(column.tolist(), np.float64).reshape(len(column), width)


def lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """A coordinate more, so that all rows have norm `longest`: nearest by distance is then largest by inner product."""
    return np.hstack([x, np.sqrt(np.clip(longest**2 - (x * x).sum(1), 0, None))[:, None]])


def scaled(q: np.ndarray, longest: float) -> np.ndarray:
    """Queries with norm `longest`, which leaves the order of inner products as it is."""
    return q * (longest / np.maximum(np.sqrt((q * q).sum(1)), 1e-300))[:, None]


class Index:
    """Every usable row of `vectors` assigned to a leaf of a tree that was fitted on a bounded sample by hash of vec_id."""

    def __init__(self, vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", sample: int = SAMPLE, leaf: int = LEAF):
        rows = usable(vectors, vec_id, embedding)
        sizes = rows.groupBy(F.size("v").alias("w")).agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("m")).orderBy(F.desc("n"), "w").first()
        self.width, self.count, self.longest = (sizes["w"], sizes["n"], float(np.sqrt(sizes["m"]))) if sizes else (0, 0, 0.0)
        rows = rows.filter(F.size("v") == self.width)
        got = rows.select("v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect() if self.count else []
        x = lifted(np.array([r["v"] for r in got], float).reshape(len(got), self.width), self.longest)
        # A leaf has `leaf` rows of the whole table, as far as the sample can tell that finely.
        self.tree, self.n_leaves = fit_tree(x, max(8, leaf * len(got) // max(1, self.count)))
        tree, width, longest = self.tree, self.width, self.longest

        def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pdf.assign(leaf=leaf_of(tree, lifted(as_matrix(pdf["v"], width), longest)).astype("int32"))

        self.rows = staged(rows.mapInPandas(assign, "vec_id long, v array<double>, leaf int"), "leaves")
        counts = {r["leaf"]: r["n"] for r in self.rows.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # a row a leaf
        self.groups: dict[int, tuple[int, int]] = {}  # of a leaf: the first group and how many
        group = filled = 0
        for f, n in sorted(counts.items()):
            parts = max(1, -(-n // GROUP_ROWS))
            if filled and filled + n > GROUP_ROWS:
                group, filled = group + 1, 0
            self.groups[f] = (group, parts)
            group, filled = (group + parts, 0) if parts > 1 else (group, filled + n)

    def search(self, queries: DataFrame, k: int, visits: int) -> DataFrame:
        """query_id, rank, vec_id, score: the k best of the leaves visited, never the query's own id. queries: vec_id, v, a
        written table; of equal rows one is asked.

        Queries are numbered in chunks by the leaf nearest to them, so queries of a chunk visit much the same leaves; a chunk
        and a group of leaves that any of its queries visits meet in one task, with bounded rows on both sides."""
        flat, width, groups, longest = Flat(self.tree), self.width, self.groups, self.longest
        asked = queries.select("vec_id", "v").distinct()
        n_queries = queries.count()

        def routed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for whole in batches:
                for at in range(0, len(whole), 256):
                    pdf, plans, homes = whole.iloc[at : at + 256], [], []
                    q = scaled(as_matrix(pdf["v"], width), longest)
                    for visited in flat.leaves_by_nearness(np.hstack([q, np.zeros((len(q), 1))]), visits):
                        plan: dict[int, list[int]] = {}
                        for f in visited:
                            first, parts = groups.get(f, (0, 0))
                            for g in range(first, first + parts):
                                plan.setdefault(g, []).append(f)
                        homes.append(visited[0])
                        plans.append([{"group": g, "leaves": fs} for g, fs in plan.items()])
                    yield pdf.assign(home=np.array(homes, np.int32), at=plans)

        parts = max(asked.sparkSession.sparkContext.defaultParallelism, -(-n_queries // ROUTE_ROWS))
        sent = asked.repartition(parts, "vec_id").mapInPandas(routed, "vec_id long, v array<double>, home int, at array<struct<group:int,leaves:array<int>>>")
        sent = staged(sent, "routes")
        chunks: list[tuple[int, int, int]] = []  # of a home leaf: the first chunk and how many
        chunk = filled = 0
        for r in sent.groupBy("home").count().orderBy("home").collect():  # a row a leaf
            several = max(1, -(-r["count"] // GROUP_QUERIES))
            if filled and filled + r["count"] > GROUP_QUERIES:
                chunk, filled = chunk + 1, 0
            chunks.append((r["home"], chunk, several))
            chunk, filled = (chunk + several, 0) if several > 1 else (chunk, filled + r["count"])
        spark = queries.sparkSession
        numbered = sent.join(F.broadcast(spark.createDataFrame(chunks, "home int, first int, parts int")), "home")
        numbered = numbered.withColumn("chunk", (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).cast("int"))
        sent = numbered.select(F.col("vec_id").alias("query_id"), "v", "chunk", F.explode("at").alias("at")).select("query_id", "v", "chunk", "at.*")
        where = spark.createDataFrame([(f, g, n) for f, (g, n) in groups.items()], "leaf int, first int, parts int")
        held = self.rows.join(F.broadcast(where), "leaf").withColumn("group", (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).cast("int")).drop("first", "parts")
        # Rows of a group go to each chunk that has a query for it: of a search that visits few leaves, few.
        wanted = sent.select(F.col("group").alias("at_group"), F.col("chunk").alias("to_chunk")).distinct()
        held = held.join(wanted, F.col("group") == F.col("at_group"))

        def compared(key: tuple, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            out: list[list[np.ndarray]] = [[], [], []]
            if len(queries) and len(rows):
                rows = rows.sort_values("leaf", kind="stable")
                leaf, ids, x = rows["leaf"].to_numpy(), rows["vec_id"].to_numpy(), as_matrix(rows["v"], width)
                for i, q, leaves in zip(queries["query_id"].to_numpy(), as_matrix(queries["v"], width), queries["leaves"], strict=True):
                    seen = np.flatnonzero(np.isin(leaf, leaves) & (ids != i))
                    score = np.einsum("nd,d->n", x[seen], q)  # the same order of additions for every row, so equal vectors tie
                    at = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k]) if len(score) > k else np.arange(len(score))
                    at = at[np.lexsort((ids[seen[at]], -score[at]))][:k]
                    for col, v in zip(out, (np.full(len(at), i), ids[seen[at]], score[at]), strict=True):
                        col.append(v)
            empty = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
            return pd.DataFrame({n: np.concatenate([e, *c]) for n, e, c in zip(("query_id", "vec_id", "score"), empty, out, strict=True)})

        best = sent.groupBy("group", "chunk").cogroup(held.groupBy("at_group", "to_chunk")).applyInPandas(compared, "query_id long, vec_id long, score double")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    def calibrated_visits(self, queries: DataFrame, k: int, recall: float = RECALL, most: int = CALIBRATE) -> tuple[int, float]:
        """Visits are widened leaf by leaf until a bounded sample of queries, held against a full search, reaches `recall`: that number and the recall there."""
        some = staged(queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(most), "calibrate")
        exact = staged(self.search(some, k, max(1, self.n_leaves)), "exact").select("query_id", F.col("vec_id"), "score")
        total = exact.count()
        if not total:
            return 1, 1.0
        # The leaf in which each true neighbour lies and the place of that leaf in the query's order give the recall of any number of visits.
        flat, longest, width, n_leaves = Flat(self.tree), self.longest, self.width, self.n_leaves

        def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                x = scaled(as_matrix(pdf["v"], width), longest)
                found = flat.leaves_by_nearness(np.hstack([x, np.zeros((len(x), 1))]), n_leaves)
                rows = [(int(i), int(f), n) for i, fs in zip(pdf["vec_id"], found, strict=True) for n, f in enumerate(fs, 1)]
                yield pd.DataFrame(rows, columns=["query_id", "leaf", "place"])

        order = some.select("vec_id", "v").mapInPandas(places, "query_id long, leaf int, place int")
        need = exact.join(self.rows.select("vec_id", "leaf"), "vec_id").join(order, ["query_id", "leaf"]).groupBy("place").count().orderBy("place").collect()
        got = 0
        for r in need:
            got += r["count"]
            if got >= recall * total:
                return r["place"], got / total
        return self.n_leaves, 1.0


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, recall: float = RECALL, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The k rows of vectors nearest to each query by inner product, found in the leaves that calibration says to visit.

    queries has the same columns as vectors. Null, zero, non-finite vectors, those of another length than most and those
    without an id take no part; ids are whole numbers. Ties go to the smaller vec_id. Repeated rows of vectors may each be
    found; of repeated queries one is asked. Empty: no rows. Other columns are ignored. visits and recall: how many of the
    leaves each query visits, and the share of true neighbours that those held for the queries of the calibration.
    """
    index = Index(vectors, vec_id, embedding)
    asked = usable(queries, vec_id, embedding).filter(F.size("v") == index.width)
    if not index.count:
        return queries.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double, visits int, leaves int, recall double")
    asked = staged(asked, "queries")
    visits, reached = index.calibrated_visits(asked, k, recall)
    told = [F.lit(visits).alias("visits"), F.lit(index.n_leaves).alias("leaves"), F.lit(reached).alias("recall")]
    return index.search(asked, k, visits).select("*", *told)
