"""Approximate nearest neighbours by balanced posting lists.

Vectors near a border are replicated to several lists, a graph over the centroids finds the lists of
a vector, and the ratio of distances prunes the lists a query looks into.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from textloom.llm.common import bounded_sample, store

SAMPLE = 65_536  # vectors the centroids are fitted on, at most
LIST_ROWS = 256  # vectors per list aimed at
MOST_LISTS = 4096
REPLICAS = 4
BORDER = 0.10  # a vector also joins lists at most this much farther than its nearest one
REACH = 0.20  # a query looks into lists at most this much farther than its nearest one
PROBES = 64  # width of the search for lists, or half of all lists
DEGREE = 16
BLOCK_ROWS = 2048
SEED = 17


@dataclass
class Lists:
    """Centroids on the unit sphere and a graph over them."""

    centroids: np.ndarray
    graph: np.ndarray
    entries: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, count: int) -> Lists:
        r = np.random.default_rng(SEED)
        c = _balanced(sample, count, r)
        n = len(c)
        degree = min(DEGREE, max(n - 1, 1))
        near = np.empty((n, degree), np.int32)
        for at in range(0, n, 1024):
            close = c[at : at + 1024] @ c.T
            close[np.arange(len(close)), np.arange(at, at + len(close))] = -2
            near[at : at + 1024] = np.argpartition(-close, degree - 1, 1)[:, :degree] if n > 1 else 0
        far = r.integers(0, n, (n, 4)).astype(np.int32)  # long edges keep the graph connected
        ring = ((np.arange(n) + 1) % n).astype(np.int32)[:, None]
        return cls(c, np.concatenate([near, far, ring], 1), r.permutation(n)[:8])

    def search(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` nearest centroids found per row of ``x``, nearest first, and their distances.

        Best-first search: the nearest centroid not yet expanded gives its neighbours, until every
        centroid among the nearest ``width`` has been expanded.
        """
        n, rows = len(self.centroids), np.arange(len(x))
        width = min(width, n)
        found = np.full((len(x), width), -1, np.int64)
        dist = np.full((len(x), width), np.inf)
        open_ = np.zeros((len(x), width), bool)
        seen = np.zeros((len(x), n), bool)
        step = np.tile(self.entries, (len(x), 1))
        live = rows
        while len(live):
            fresh = ~seen[live[:, None], step]
            order = np.argsort(step, 1, kind="stable")  # a neighbour listed twice counts once
            ranked = np.take_along_axis(step, order, 1)
            twice = np.concatenate([np.zeros((len(live), 1), bool), ranked[:, 1:] == ranked[:, :-1]], 1)
            np.put_along_axis(fresh, order, np.take_along_axis(fresh, order, 1) & ~twice, 1)
            seen[live[:, None], step] = True
            d = np.sqrt(np.maximum(2 - 2 * np.einsum("rd,rkd->rk", x[live], self.centroids[step]), 0))
            d[~fresh] = np.inf
            all_d = np.concatenate([dist[live], d], 1)
            all_i = np.concatenate([found[live], step], 1)
            all_o = np.concatenate([open_[live], fresh], 1)
            best = np.argsort(all_d, 1, kind="stable")[:, :width]
            dist[live] = np.take_along_axis(all_d, best, 1)
            found[live] = np.take_along_axis(all_i, best, 1)
            open_[live] = np.take_along_axis(all_o, best, 1)
            going = open_[live].any(1)
            live = live[going]
            first = open_[live].argmax(1)
            open_[live, first] = False
            step = self.graph[found[live, first]].astype(np.int64)
        return found, dist

    def homes(self, x: np.ndarray) -> list[list[int]]:
        """The lists of each vector: its nearest one, and near ones in other directions."""
        found, dist = self.search(x, 4 * REPLICAS)
        out = []
        for ids, d in zip(found, dist, strict=True):
            own = [int(ids[0])]
            for i, e in zip(ids[1:], d[1:], strict=True):
                if len(own) == REPLICAS or e > (1 + BORDER) * d[0]:
                    break
                apart = 2 - 2 * (self.centroids[own] @ self.centroids[i])
                if (apart > e * e).all():
                    own.append(int(i))
            out.append(own)
        return out

    def probes(self, x: np.ndarray) -> list[list[int]]:
        found, dist = self.search(x, max(PROBES, len(self.centroids) // 2))
        return [[int(i) for i in ids[d <= (1 + REACH) * d[0]]] for ids, d in zip(found, dist, strict=True)]


def _balanced(x: np.ndarray, count: int, r: np.random.Generator) -> np.ndarray:
    """Centres of ``count`` groups or a few more: the largest group is halved until all are small."""
    limit = max(1, -(-len(x) // count))
    todo, done = [np.arange(len(x))], []
    while todo:
        own = todo.pop()
        if len(own) <= limit:
            done.append(own)
            continue
        pair = x[own[r.choice(len(own), 2, replace=False)]]
        for _ in range(6):
            lean = x[own] @ (pair[0] - pair[1])
            side = lean > 0
            if side.all() or not side.any():
                break
            pair = np.stack([_unit(x[own[side]].sum(0)), _unit(x[own[~side]].sum(0))])
        cut = np.partition(lean, [len(own) // 3, len(own) - 1 - len(own) // 3])
        side = lean > np.clip(0, cut[len(own) // 3], cut[len(own) - 1 - len(own) // 3])
        if side.all() or not side.any():  # equal vectors
            side = np.arange(len(own)) < len(own) // 2
        todo += [own[side], own[~side]]
    return np.stack([_unit(x[g].sum(0)) for g in done])


def _unit(v: np.ndarray) -> np.ndarray:
    return v / max(np.linalg.norm(v), 1e-300)


def units(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; scaled first, so that very large and very small values keep their digits."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cosine(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosine of ``q`` with each row, summed in the same order for every row, so that equal vectors tie."""
    q, rows = q / np.abs(q).max(), rows / np.abs(rows).max(1, keepdims=True)
    return (rows * q).sum(1) / (np.sqrt((q * q).sum()) * np.sqrt((rows * rows).sum(1)))


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows found of ``vectors`` for each row of ``queries``.

    Both tables hold ``id_col`` and ``vector_col``; a row is no neighbour of a query with its own
    identifier. Nearness is the cosine in double precision, ties go to smaller identifiers. Equal
    vectors are one entry with its ``k + 1`` smallest identifiers, which loses no neighbour however
    many copies there are. Every entry is indexed; only the centroids come from a sample, of at most
    65,536 entries. Lists and the queries of a list are cut into blocks of about 2048 rows, so no
    task grows with the largest list.

    Vectors that are null, zero, or hold a null or a value that is not finite take no part, and
    neither do null identifiers. Rows that repeat identifier and vector count once. All vectors must
    have one length, otherwise an error names two lengths. Fewer candidates than ``k`` give all.
    Other columns are not read.
    """
    spark = vectors.sparkSession
    entries = store(_entries(vectors, k, id_col, vector_col), "ann-entries")
    asked = _valid(queries, id_col, vector_col).dropDuplicates(["_id"])
    lengths = [r[0] for r in entries.select(F.size("vec")).union(asked.select(F.size("vec"))).distinct().limit(2).collect()]
    if len(lengths) > 1:
        raise ValueError(f"vectors of {lengths[0]} and of {lengths[1]} values")
    kind = vectors.schema[id_col].dataType.simpleString()
    empty = spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    total = entries.count()
    if not total:
        return empty
    picked = bounded_sample(entries, SAMPLE, "vec").select("vec").toArrow().column("vec")
    sample = picked.combine_chunks().flatten().to_numpy().reshape(-1, lengths[0])
    model = Lists.fit(units(sample), int(np.clip(total // LIST_ROWS, 1, MOST_LISTS)))
    shared = spark.sparkContext.broadcast(model)  # at most MOST_LISTS centroids and their edges

    def listed(choose: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    x = part.column("vec").flatten().to_numpy().reshape(part.num_rows, -1)
                    homes = getattr(shared.value, choose)(units(x))
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns, pa.array(homes, pa.list_(pa.int32()))], [*part.schema.names, "lists"],
                    )

        return run

    posted = store(
        entries.mapInArrow(listed("homes"), f"entry bigint, ids array<{kind}>, vec array<double>, lists array<int>"), "ann-lists",
    ).withColumn("list", F.explode("lists")).drop("lists")
    probed = store(
        asked.mapInArrow(listed("probes"), f"_id {kind}, vec array<double>, lists array<int>"), "ann-probes",
    ).withColumn("list", F.explode("lists")).drop("lists")
    blocks = lambda c: F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias(c)
    sizes = posted.groupBy("list").agg(blocks("parts")).join(probed.groupBy("list").agg(blocks("query_parts")), "list")
    sizes = F.broadcast(sizes)  # one row per list, at most twice MOST_LISTS
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = (
        probed.join(sizes, "list").withColumn("query_part", F.pmod(F.xxhash64("_id"), F.col("query_parts")).cast("int"))
        .withColumn("part", every("parts")).select("list", "part", "query_part", "_id", "vec")
    )
    right = (
        posted.join(sizes, "list").withColumn("part", F.pmod(F.xxhash64("entry"), F.col("parts")).cast("int"))
        .withColumn("query_part", every("query_parts")).select("list", "part", "query_part", "ids", "vec")
    )
    keys = ["list", "part", "query_part"]
    scored = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        _block(k), f"query_id {kind}, vec_id {kind}, score double",
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    unique = scored.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return unique.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )


def _valid(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    vec = F.transform(F.col(vector_col).cast("array<double>"), lambda x: x + F.lit(0.0))  # no negative zeros
    slim = rows.select(F.col(id_col).alias("_id"), vec.alias("vec"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return slim.filter(F.col("_id").isNotNull() & F.forall("vec", fine) & F.exists("vec", lambda x: x != 0))


def _entries(rows: DataFrame, k: int, id_col: str, vector_col: str) -> DataFrame:
    """Distinct vectors with their ``k + 1`` smallest identifiers; the limit per vector is cut before the shuffle."""
    first = Window.partitionBy("vec").orderBy("_id")
    few = _valid(rows, id_col, vector_col).withColumn("n", F.dense_rank().over(first)).filter(F.col("n") <= k + 1)
    grouped = few.groupBy("vec").agg(F.array_sort(F.collect_set("_id")).alias("ids"))
    return grouped.select(F.monotonically_increasing_id().alias("entry"), "ids", "vec")


def _block(k: int):
    """Exact scores of a block of queries against a block of entries: the best ``k`` rows of each query."""

    def run(queries: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if len(queries) and len(entries):
            rows, ids = np.stack(entries["vec"].to_numpy()), entries["ids"].to_numpy()
            scaled = units(rows)
            for query_id, q in zip(queries["_id"], queries["vec"], strict=True):
                close = scaled @ units(q[None])[0]
                # One entry may hold the query alone, so one more than k entries are looked at, and all ties.
                least = np.partition(close, -k - 1)[-k - 1] if len(close) > k else -2.0
                at = np.flatnonzero(close >= least - 1e-9)
                exact = cosine(q, rows[at])
                pairs = sorted((-s, i) for s, e in zip(exact, at, strict=True) for i in ids[e] if i != query_id)[:k]
                out["query_id"] += [query_id] * len(pairs)
                out["vec_id"] += [i for _, i in pairs]
                out["score"] += [-s for s, _ in pairs]
        return pd.DataFrame(out)

    return run
