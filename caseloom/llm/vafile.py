"""Exact search for the largest inner products through a vector-approximation file."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseloom.llm.tables import keep

#: Components are floor(SCALE * x); cells per component are 2 ** BITS.
SCALE, BITS = 256, 6
#: Vectors and queries per block.
BLOCK, QUERIES = 4096, 256
#: Exact vectors read at a time in the order of their bounds.
STEP = 32

BLOCKS = "block long, dim int, width int, ids binary, vectors binary, low array<bigint>, high array<bigint>"


def whole(column: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, rows, integer vectors) of the rows that hold finite numbers only."""
    column = pa.array(column.to_pylist(), pa.list_(pa.float64())) if not pa.types.is_list(column.type) else column
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False).astype(float)
    lengths, there = np.diff(offsets), column.is_valid().to_numpy(zero_copy_only=False)
    for dim in np.unique(lengths[there]):
        rows = np.flatnonzero(there & (lengths == dim))
        vectors = values[offsets[rows][:, None] + np.arange(dim)]
        finite = np.isfinite(vectors).all(axis=1)
        yield int(dim), rows[finite], np.floor(SCALE * vectors[finite]).astype(np.int64)


def _width(low: int, high: int) -> int:
    """Bytes that hold the numbers from low to high."""
    return next(width for width in (1, 2, 4, 8) if -(1 << 8 * width - 1) <= low and high < 1 << 8 * width - 1)


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of up to ``size`` vectors of ``rows`` (vec_id, embedding), per dimension.

    A block has the ids, the integer vectors in as few bytes as they need, and the least and
    greatest value of each component.
    """

    def pack(ids, vectors, number):
        block = (TaskContext.get().partitionId() << 33) + number
        low, high = vectors.min(axis=0), vectors.max(axis=0)
        width = _width(int(low.min(initial=0)), int(high.max(initial=0)))
        data = vectors.astype(f"i{width}").tobytes()
        return (block, vectors.shape[1], width, ids.astype(np.int64).tobytes(), data, low.tolist(), high.tolist())

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        number = 0

        def flush(dim, least):
            nonlocal number
            ids = np.concatenate([i for i, _ in waiting[dim]])
            vectors = np.concatenate([v for _, v in waiting[dim]])
            while len(ids) >= least and len(ids):
                yield _rows([pack(ids[:size], vectors[:size], number)], schema)
                number, ids, vectors = number + 1, ids[size:], vectors[size:]
            waiting[dim] = [(ids, vectors)]

        for batch in batches:
            every = batch["vec_id"].to_numpy(zero_copy_only=False)
            for dim, of, vectors in whole(batch["embedding"]):
                waiting.setdefault(dim, []).append((every[of], vectors))
                if sum(len(ids) for ids, _ in waiting[dim]) >= size:
                    yield from flush(dim, size)
        for dim in waiting:
            yield from flush(dim, 1)

    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    schema = pa.schema(zip([part.split()[0] for part in BLOCKS.split(", ")], kinds))
    known = rows.filter("vec_id IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return known.mapInArrow(build, BLOCKS)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def _matrix(data: bytes, kind, rows: int, dim: int) -> np.ndarray:
    """The bytes as rows of ``dim`` numbers, which may be none."""
    return np.frombuffer(data, kind).reshape(rows, dim) if dim else np.empty((rows, 0), kind)


class Grid:
    """Equal cells of one component each: 2 ** BITS of them between its least and greatest value."""

    def __init__(self, low: np.ndarray, high: np.ndarray):
        self.low = low
        self.step = -(-(high - low + 1) // (1 << BITS))

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        return ((vectors - self.low) // self.step).astype(np.uint8)

    def centres(self, cells: np.ndarray) -> np.ndarray:
        return self.low + cells * self.step.astype(float) + (self.step - 1) / 2

    def slack(self, queries: np.ndarray) -> np.ndarray:
        """How far a vector's product with each query can be from that of its cells' centres."""
        return np.abs(queries) @ ((self.step - 1) / 2)


def search(ids, cells, vectors, query_ids, queries, grid: Grid, k: int) -> Iterator[tuple[int, int, int]]:
    """(query, vector, score) of the k largest products of each query with a block.

    Bounds come from the cells alone. Exact vectors are read in the order of their upper bounds
    until the kth exact score exceeds every bound that is left.
    """
    middle = queries.astype(float) @ grid.centres(cells).T
    slack = grid.slack(queries.astype(float))
    for row, query in enumerate(query_ids):
        upper = middle[row] + slack[row]
        upper[ids == query] = -np.inf
        others = int(np.isfinite(upper).sum())
        if not others:
            continue
        kth = min(k, others)
        floor = np.partition(upper, len(upper) - kth)[len(upper) - kth] - 2 * slack[row]
        order = np.flatnonzero(upper >= floor)
        order = order[np.argsort(-upper[order], kind="stable")]
        found, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        for at in range(0, len(order), STEP):
            if len(scores) >= kth and upper[order[at]] < scores[-1]:
                break
            read = order[at : at + STEP]
            found = np.concatenate([found, ids[read]])
            scores = np.concatenate([scores, vectors[read].astype(np.int64) @ queries[row]])
            best = np.lexsort((found, -scores))[:kth]
            found, scores = found[best], scores[best]
        yield from zip([int(query)] * len(found), found.tolist(), scores.tolist())


def top_products(rows: DataFrame, is_query, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query the k rows with the largest inner products.

    ``rows`` has vec_id and embedding; the rows where ``is_query`` holds are the queries, every row
    but the query's own is a candidate. Vectors are turned into whole numbers, floor(256 * x), and
    scores are exact for products below 2**53. Ties go to the smaller vec_id.

    Blocks of queries meet blocks of vectors as rows of a join, and each meeting yields at most k
    rows per query, which are merged by query. Nothing but the range of each component, one row
    per dimension and place, comes to the driver.

    Null vectors, vectors that hold null or a number that is not finite, and rows without an id
    take no part; vectors meet those of their own length only. Rows that share a vec_id are all
    candidates of others and not of each other; as a query, the smallest of their valid vectors counts.
    Vectors without components meet each other with score 0.
    No vectors or no queries give no rows. Other columns are ignored.
    """
    stored = keep(blocks(rows, BLOCK), "vafile-vectors")
    # An invalid vector may sort first, so it must not stand for a valid one of its id.
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    asked = rows.filter(is_query & F.col("embedding").isNotNull() & finite).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asked = keep(blocks(asked.repartition("vec_id"), QUERIES), "vafile-queries")
    edges = stored.select("dim", F.posexplode(F.arrays_zip("low", "high")).alias("place", "range"))
    edges = edges.groupBy("dim", "place").agg(F.min("range.low").alias("low"), F.max("range.high").alias("high"))
    limits: dict[int, list[tuple[int, int, int]]] = {}
    for dim, place, low, high in edges.collect():
        limits.setdefault(dim, []).append((place, low, high))
    limits = {dim: np.array(sorted(of), np.int64) for dim, of in limits.items()}
    shared = rows.sparkSession.sparkContext.broadcast(limits)
    empty = np.empty((0, 3), np.int64)

    def approximate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = []
            for dim, width, ids, data in zip(*(batch[c].to_pylist() for c in ("dim", "width", "ids", "vectors"))):
                of = shared.value.get(dim, empty)
                vectors = _matrix(data, f"i{width}", len(ids) // 8, dim)
                cells.append(Grid(of[:, 1], of[:, 2]).cells(vectors.astype(np.int64)).tobytes())
            columns = [*batch.columns, pa.array(cells, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "cells"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                dim, width, ids, data, cells, q_width, q_ids, q_data = (c[row].as_py() for c in batch.columns)
                of = shared.value.get(dim, empty)
                ids, q_ids = np.frombuffer(ids, np.int64), np.frombuffer(q_ids, np.int64)
                vectors = _matrix(data, f"i{width}", len(ids), dim)
                queries = _matrix(q_data, f"i{q_width}", len(q_ids), dim).astype(np.int64)
                cells = _matrix(cells, np.uint8, len(ids), dim)
                found = list(search(ids, cells, vectors, q_ids, queries, Grid(of[:, 1], of[:, 2]), k))
                yield _rows(found, result)

    result = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
    stored = stored.select("block", "dim", "width", "ids", "vectors").mapInArrow(
        approximate, "block long, dim int, width int, ids binary, vectors binary, cells binary"
    )
    # Every pair of a query block and a vector block of the same length, dealt by the pair.
    numbers = keep(stored.select("block", "dim"), "vafile-numbers")
    pairs = asked.select(F.col("block").alias("asked"), "dim").join(numbers, "dim")
    queries = asked.select(F.col("block").alias("asked"), F.col("width").alias("q_width"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    pairs = keep(pairs.join(queries, "asked"), "vafile-pairs")
    met = pairs.drop("dim", "asked").join(stored, "block").select("dim", "width", "ids", "vectors", "cells", "q_width", "q_ids", "q_vectors")
    nearest = met.mapInArrow(meet, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = nearest.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
