"""Cosine and late-interaction retrieval.

The corpus is scanned where it lies: every task multiplies its Arrow batches with a block of query
vectors and keeps a running top-k, so k rows per query and task are what moves. Queries come in
blocks of bounded bytes, one scan each, and a task never holds more than a bounded number of
similarities. For late interaction the tokens of a document are brought together first.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from textloom.functions import vectors as vx
from textloom.operators.skew import broadcast_if_small, heavy_keys, keep_ids, salted_join, top_n
from textloom.session import cut_lineage

BLOCK_BYTES = 16 * 1024 * 1024  # of query vectors that travel with one scan
SIMILARITIES = 4 * 1024 * 1024  # held at once by a task

HIT_SCHEMA = "query_id long, chunk_id long, similarity double"


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _unit_rows(m: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(size == 0, 1.0, size)


def _best(ids: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the k largest similarities (9 digits), smaller ids first on ties."""
    order = np.lexsort((ids, -np.round(sims, 9)), axis=1)[:, :k]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def _local_top(queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    sims = queries @ _unit_rows(vectors).T
    if sims.shape[1] > 4 * k:
        # Keep everything that can still be among the first k, then order only that.
        floor = np.partition(sims, -k, axis=1)[:, -k] - 1e-9
        keep = np.flatnonzero((sims >= floor[:, None]).any(axis=0))
        sims, ids = sims[:, keep], ids[keep]
    return _best(np.broadcast_to(ids, sims.shape), sims, k)


def _emit(qids: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.repeat(qids, ids.shape[1])), pa.array(ids.ravel()), pa.array(sims.ravel())],
        names=["query_id", "chunk_id", "similarity"],
    )


def _of_one_length(df: DataFrame, dim: int) -> DataFrame:
    """``embedding`` as doubles; a vector of another length than the queries' raises an error."""
    wrong = F.raise_error(F.concat(F.lit(f"expected {dim} values, found "), F.size("embedding").cast("string")))
    vec = F.col("embedding").cast("array<double>")
    return df.withColumn("embedding", F.when(F.size("embedding") == dim, vec).otherwise(wrong))


def _blocks(queries: DataFrame, keys: list[str], limit: int) -> tuple[int, list[DataFrame]]:
    """Length of the query vectors, and the queries in blocks of about ``limit`` bytes."""
    n, dim = queries.agg(F.count("*"), F.max(F.size("embedding"))).first()
    ready = _of_one_length(queries, dim or 0).withColumns({k: F.col(k).cast("long") for k in keys})
    count = max(1, -(-n * max(dim or 0, 1) * 8 // limit))
    number = F.pmod(F.xxhash64(keys[0]), F.lit(count))
    return dim or 0, [ready.filter(number == b) for b in range(count)] if n else []


def _steps(rows: int, queries: int) -> Iterator[slice]:
    """Corpus rows in steps whose similarities with all queries of a block stay below 32 MB."""
    size = max(1, SIMILARITIES // max(queries, 1))
    return (slice(at, at + size) for at in range(0, rows, size))


def cosine_top(corpus: DataFrame, queries: DataFrame, k: int = 5, limit: int = BLOCK_BYTES) -> DataFrame:
    """``query_id, chunk_id, similarity, rank``: the k most similar chunks per query.

    ``corpus(chunk_id, embedding)``, ``queries(query_id, embedding)``; ids are integers. A null
    vector is no candidate and no query, a zero query scores 0, and a vector of another length
    than the longest query raises an error.
    """
    queries = queries.select("query_id", "embedding").filter("embedding is not null")
    dim, blocks = _blocks(queries, ["query_id"], limit)
    left = _of_one_length(corpus.select(F.col("chunk_id").cast("long"), "embedding").filter("embedding is not null"), dim)
    hits = [_scanned(left, block, k, dim) for block in blocks]
    empty = corpus.sparkSession.createDataFrame([], HIT_SCHEMA)
    found = reduce(DataFrame.union, hits) if hits else empty
    return top_n(found, ["query_id"], [F.round("similarity", 9).desc(), F.col("chunk_id")], k)


def _scanned(corpus: DataFrame, queries: DataFrame, k: int, dim: int) -> DataFrame:
    """One scan of the corpus for one block of queries."""
    table = queries.toArrow()
    if not table.num_rows:
        return corpus.sparkSession.createDataFrame([], HIT_SCHEMA)
    qids = table.column("query_id").to_numpy()
    matrix = _unit_rows(_matrix(table.column("embedding"), dim))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = np.empty((len(qids), 0), dtype=np.int64)
        sims = np.empty((len(qids), 0))
        for batch in batches:
            new = batch.column("chunk_id").to_numpy(), _matrix(batch.column("embedding"), dim)
            for part in _steps(batch.num_rows, len(qids)):
                i, s = _local_top(matrix, new[0][part], new[1][part], k)
                ids, sims = _best(np.hstack([ids, i]), np.hstack([sims, s]), k)
        if ids.shape[1]:
            yield _emit(qids, ids, sims)

    return corpus.mapInArrow(scan, HIT_SCHEMA)


MAXSIM_SCHEMA = "query_id long, chunk_id long, score double"
PART_SCHEMA = "query_id long, token_id long, chunk_id long, sim double"


def late_interaction_top(doc_tokens: DataFrame, query_tokens: DataFrame, k: int = 5, limit: int = BLOCK_BYTES) -> DataFrame:
    """MaxSim: sum over query tokens of the best cosine with any token of the document.

    ``doc_tokens(chunk_id, embedding)``, ``query_tokens(query_id, token_id, embedding)``. The tokens
    of a document come together in one sorted partition, where it is scored whole and only the best
    ``k`` documents per query stay. A document with 1/1000 of all tokens or more (at most 1000 are)
    is scored where its tokens lie: each task sends one maximum per query token. Null vectors take no
    part, and a vector of another length than the longest query token raises an error.
    """
    asked = query_tokens.select("query_id", "token_id", "embedding").filter("embedding is not null")
    dim, blocks = _blocks(asked, ["query_id", "token_id"], limit)
    docs = _of_one_length(doc_tokens.select(F.col("chunk_id").cast("long"), "embedding").filter("embedding is not null"), dim)
    counts = docs.groupBy("chunk_id").agg(F.count("*").alias("n"))
    heavy = F.broadcast(heavy_keys(counts, "chunk_id", "n"))
    together = docs.join(heavy, "chunk_id", "left_anti").repartition("chunk_id").sortWithinPartitions("chunk_id")
    spread = docs.join(heavy, "chunk_id", "left_semi")
    scores = []
    for block in blocks:
        table = block.toArrow()
        if table.num_rows:
            asked_of = table.column("query_id").to_numpy(), table.column("token_id").to_numpy()
            matrix = _unit_rows(_matrix(table.column("embedding"), dim))
            scores.append(together.mapInArrow(_whole_documents(asked_of[0], matrix, k, dim), MAXSIM_SCHEMA))
            part = spread.mapInArrow(_token_maxima(*asked_of, matrix, dim), PART_SCHEMA)
            best = part.groupBy("query_id", "chunk_id", "token_id").agg(F.max("sim").alias("sim"))
            scores.append(best.groupBy("query_id", "chunk_id").agg(F.sum("sim").alias("score")))
    empty = docs.sparkSession.createDataFrame([], MAXSIM_SCHEMA)
    found = reduce(DataFrame.unionByName, scores) if scores else empty
    return top_n(found, ["query_id"], [F.round("score", 9).desc(), F.col("chunk_id")], k)


def _whole_documents(qids: np.ndarray, matrix: np.ndarray, k: int, dim: int):
    """Scores of documents whose tokens follow each other, and the best ``k`` per query of the task."""
    order = np.argsort(qids, kind="stable")
    queries, cuts = np.unique(qids[order], return_index=True)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, scores = np.empty((len(queries), 0), dtype=np.int64), np.empty((len(queries), 0))
        doc, best = None, np.full(len(matrix), -np.inf)

        def add(docs: np.ndarray, maxima: np.ndarray) -> None:
            nonlocal ids, scores
            new = np.add.reduceat(maxima[order], cuts, axis=0)
            ids, scores = _best(np.hstack([ids, np.broadcast_to(docs, new.shape)]), np.hstack([scores, new]), k)

        for batch in batches:
            own, vectors = batch.column("chunk_id").to_numpy(), _matrix(batch.column("embedding"), dim)
            for part in _steps(batch.num_rows, len(matrix)):
                docs, starts = np.unique(own[part], return_index=True)
                maxima = np.maximum.reduceat(matrix @ _unit_rows(vectors[part]).T, starts, axis=1)
                if doc is not None and docs[0] == doc:
                    maxima[:, 0] = np.maximum(maxima[:, 0], best)
                elif doc is not None:
                    add(np.array([doc]), best[:, None])
                if len(docs) > 1:
                    add(docs[:-1], maxima[:, :-1])
                doc, best = docs[-1], maxima[:, -1]  # the last document may go on
        if doc is not None:
            add(np.array([doc]), best[:, None])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(queries, ids.shape[1])), pa.array(ids.ravel()), pa.array(scores.ravel())],
                names=["query_id", "chunk_id", "score"],
            )

    return scan


def _token_maxima(qids: np.ndarray, tids: np.ndarray, matrix: np.ndarray, dim: int):
    """Best cosine of every query token with any vector of each document, once per task."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, np.ndarray] = {}  # documents that are heavy, hence few
        for batch in batches:
            ids, vectors = batch.column("chunk_id").to_numpy(), _matrix(batch.column("embedding"), dim)
            for part in _steps(batch.num_rows, len(matrix)):
                order = np.argsort(ids[part], kind="stable")
                docs, starts = np.unique(ids[part][order], return_index=True)
                maxima = np.maximum.reduceat(matrix @ _unit_rows(vectors[part][order]).T, starts, axis=1)
                for d, m in zip(docs.tolist(), maxima.T, strict=True):
                    best[d] = np.maximum(best[d], m) if d in best else m
        for d, m in best.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(qids), pa.array(tids), pa.array(np.full(len(qids), d)), pa.array(m)],
                names=["query_id", "token_id", "chunk_id", "sim"],
            )

    return scan


def best_segments(hits: DataFrame, segments: DataFrame, query_vectors: DataFrame) -> DataFrame:
    """Per hit the segment closest to the query: ``query_id, chunk_id, segment_id, similarity``.

    ``segments(chunk_id, segment_id, embedding)``; only segments of hit chunks are scored.
    """
    q = query_vectors.select("query_id", F.col("embedding").alias("_q"))
    asked = hits.select("query_id", "chunk_id")
    own = cut_lineage(keep_ids(segments, "chunk_id", asked), "hit-segments")
    heavy = heavy_keys(own.groupBy("chunk_id").agg(F.count("*").alias("n")), "chunk_id", "n")
    pairs = salted_join(own, asked, "chunk_id", heavy, F.col("segment_id")).join(broadcast_if_small(q), "query_id")
    scored = pairs.withColumn("similarity", vx.cosine(F.col("_q"), F.col("embedding")))
    best = F.max(F.struct(F.round("similarity", 9).alias("r"), (-F.col("segment_id")).alias("neg"), "similarity"))
    return scored.groupBy("query_id", "chunk_id").agg(best.alias("b")).select(
        "query_id", "chunk_id", (-F.col("b.neg")).alias("segment_id"), F.col("b.similarity").alias("similarity")
    )


def mean_vectors(vectors: DataFrame, key: str) -> DataFrame:
    """Mean vector per key, computed per component so that no group is collected."""
    parts = vectors.select(key, F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    # One row per component: bounded by the dimension.
    rows = means.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    return rows.select(key, F.transform("v", lambda s: s["x"]).alias("embedding"))
