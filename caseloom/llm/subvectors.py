"""Clustering around centroids with distances read from dictionaries of distinct subvectors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.llm.tables import keep

#: Components are floor(SCALE * x), held within LIMIT so that squared distances fit a long.
SCALE, LIMIT = 256, 1 << 26
#: Components per block that are tried, widest first; one component is the last resort.
WIDTHS = (8, 4, 2, 1)
#: A wider block must stand for so many vectors per distinct subvector on average.
REUSE = 4
#: Bytes that the distances of all distinct subvectors to all centroids may take in a task.
TABLE_BYTES = 64 << 20
#: Vectors whose distances a task holds at a time.
CHUNK = 8192

CODES, DISTANCES = "vec_id long, codes binary", "vec_id long, cluster int, distance long"


def whole_vectors(rows: DataFrame, dim: int) -> DataFrame:
    """``vec_id, v``: vectors of ``dim`` finite components as whole numbers."""
    real = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall(real, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    # A product beyond all doubles is held by the limit like any other.
    bounded = F.transform(real, lambda x: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(F.greatest(F.lit(-1e18), F.least(F.lit(1e18), x * SCALE))))))
    good = rows.filter(F.col("embedding").isNotNull() & (F.size("embedding") == dim)).filter(finite)
    return good.select(F.col("vec_id").cast("long").alias("vec_id"), bounded.cast("array<int>").alias("v"))


def _blocks(width: int, dim: int, vector: str = "v") -> Column:
    """The vector cut into blocks of so many components."""
    return F.array(*[F.slice(vector, at + 1, width) for at in range(0, dim, width)])


def block_width(vectors: DataFrame, dim: int, most: int) -> int:
    """Widest block whose dictionaries have ``most`` entries at most and are used often enough.

    Entries are estimated here (one pass, 5 % standard deviation) and counted before use.
    """
    widths = [w for w in WIDTHS if dim % w == 0 and w > 1]
    if not widths:
        return 1
    parts = [F.struct(F.lit(w).alias("width"), F.xxhash64(F.lit(at), F.slice("v", at + 1, w)).alias("part")) for w in widths for at in range(0, dim, w)]
    seen = vectors.select(F.explode(F.array(*parts)).alias("of")).groupBy("of.width").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("of.part").alias("entries"))
    found = {width: (n, entries) for width, n, entries in seen.collect()}
    for width in widths:
        n, entries = found.get(width, (0, 0))
        if 1.2 * entries <= most and entries * REUSE <= n:
            return width
    return 1


class Dictionary:
    """Distinct subvectors of one block in lexicographic order; a code is a place in that order."""

    def __init__(self, entries: np.ndarray):
        self.levels = []
        prefix = np.zeros(len(entries), np.int64)
        for column in entries.T:
            values, at = np.unique(column, return_inverse=True)
            prefixes, prefix = np.unique(prefix * len(values) + at, return_inverse=True)
            self.levels.append((values, prefixes))

    def codes(self, subvectors: np.ndarray) -> np.ndarray:
        """Codes of subvectors that are all in the dictionary."""
        code = np.zeros(len(subvectors), np.int64)
        for (values, prefixes), column in zip(self.levels, subvectors.T):
            code = np.searchsorted(prefixes, code * len(values) + np.searchsorted(values, column))
        return code


def distances(entries: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distance of every subvector to the same block of every centroid."""
    return ((entries[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2)


def _numbers(column: pa.ListArray, dim: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(-1, dim).astype(np.int64)


def _coded(column: pa.BinaryArray, blocks: int, kind: str) -> np.ndarray:
    width = blocks * np.dtype(kind).itemsize
    data = column.buffers()[2]
    if data is None or not len(column):
        return np.empty((0, blocks), kind)
    start = np.frombuffer(column.buffers()[1], np.int32, 1, column.offset * 4)[0]
    return np.frombuffer(data, kind, len(column) * width // np.dtype(kind).itemsize, int(start)).reshape(-1, blocks)


class Coded:
    """Vectors as codes of subvectors whose dictionaries every task holds."""

    def __init__(self, vectors: DataFrame, dictionaries: dict[int, np.ndarray], dim: int, width: int):
        self.dim, self.width, self.blocks = dim, width, dim // width
        entries = [dictionaries.get(block, np.empty((0, width), np.int64)) for block in range(self.blocks)]
        self.kind = kind = "<u2" if max(map(len, entries)) <= 1 << 16 else "<u4"
        self.entries = shared = vectors.sparkSession.sparkContext.broadcast(entries)

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            books = [Dictionary(of) for of in shared.value]
            for batch in batches:
                whole = _numbers(batch["v"], dim)
                parts = [book.codes(whole[:, at * width : (at + 1) * width]) for at, book in enumerate(books)]
                codes = np.stack(parts, axis=1).astype(kind)
                packed = pa.array([row.tobytes() for row in codes], pa.binary())
                yield pa.RecordBatch.from_arrays([batch["vec_id"], packed], names=["vec_id", "codes"])

        self.codes = keep(vectors.select("vec_id", "v").mapInArrow(encode, CODES), "subvectors-codes")

    def _scan(self, centroids: np.ndarray):
        """Function from codes to (codes, nearest centroid, distance), a chunk at a time."""
        shared, blocks, kind, width = self.entries, self.blocks, self.kind, self.width

        def scan(batches: Iterator[pa.RecordBatch]):
            # Once a round and task; every vector only adds these up.
            tables = [distances(of, centroids[:, at * width : (at + 1) * width]) for at, of in enumerate(shared.value)]
            for batch in batches:
                codes = _coded(batch["codes"], blocks, kind)
                for start in range(0, len(codes), CHUNK):
                    part = codes[start : start + CHUNK]
                    total = np.zeros((len(part), len(centroids)), np.int64)
                    for at, table in enumerate(tables):
                        total += table[part[:, at]]
                    # The first of equal distances is the smallest number.
                    nearest = total.argmin(axis=1)
                    yield batch["vec_id"].slice(start, len(part)), part, nearest, total[np.arange(len(part)), nearest]

        return scan

    def assign(self, centroids: np.ndarray) -> DataFrame:
        """``vec_id, cluster, distance`` of every vector."""
        scan = self._scan(centroids)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, _, nearest, distance in scan(batches):
                columns = [ids, pa.array(nearest.astype(np.int32)), pa.array(distance)]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance"])

        return self.codes.mapInArrow(work, DISTANCES)

    def sums(self, centroids: np.ndarray) -> DataFrame:
        """``cluster, place, n, total``: vectors of each cluster, and the sum of each component, per task."""
        scan, shared, k, dim = self._scan(centroids), self.entries, len(centroids), self.dim

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sizes = np.zeros(k, np.int64)
            uses = [np.zeros((k, len(of)), np.int64) for of in shared.value]
            for _, codes, nearest, _ in scan(batches):
                sizes += np.bincount(nearest, minlength=k)
                for at, use in enumerate(uses):
                    use += np.bincount(nearest * use.shape[1] + codes[:, at], minlength=use.size).reshape(use.shape)
            # How often a cluster uses a subvector, times the subvector.
            totals = np.concatenate([use @ of for use, of in zip(uses, shared.value)], axis=1)
            held = np.flatnonzero(sizes)
            columns = (np.repeat(held, dim).astype(np.int32), np.tile(np.arange(dim, dtype=np.int32), len(held)), np.repeat(sizes[held], dim), totals[held].ravel())
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["cluster", "place", "n", "total"])

        return self.codes.mapInArrow(work, "cluster int, place int, n long, total long")


class Joined:
    """The same for dictionaries of any size: distances of subvectors are a table, met by a join."""

    def __init__(self, vectors: DataFrame, entries: DataFrame, dim: int, width: int):
        self.dim, self.width = dim, width
        self.entries = entries
        self.vectors = keep(vectors.withColumn("row", F.monotonically_increasing_id()), "subvectors-rows")
        cells = self.vectors.select("row", F.posexplode(_blocks(width, dim)).alias("block", "part"))
        self.cells = keep(cells, "subvectors-cells")

    def _nearest(self, centroids: np.ndarray) -> DataFrame:
        width, k = self.width, len(centroids)
        cut = [(at // width, centroids[:, at : at + width].tolist()) for at in range(0, self.dim, width)]
        of = self.entries.sparkSession.createDataFrame(cut, "block int, of array<array<int>>")
        squares = lambda part, c: F.aggregate(F.zip_with(part, c, lambda x, y: (x - y).cast("long") * (x - y)), F.lit(0).cast("long"), lambda s, x: s + x)
        # The centroids: k times dim numbers.
        parts = self.entries.join(F.broadcast(of), "block").select("block", "part", F.transform("of", lambda c: squares(F.col("part"), c)).alias("parts"))
        table = keep(parts, "subvectors-distances")
        met = self.cells.join(table, ["block", "part"])
        totals = met.groupBy("row").agg(*[F.sum(F.col("parts")[c]).alias(f"d{c}") for c in range(k)])
        best = F.least(*[F.struct(F.col(f"d{c}").alias("distance"), F.lit(c).alias("cluster")) for c in range(k)]) if k > 1 else F.struct(F.col("d0").alias("distance"), F.lit(0).alias("cluster"))
        return keep(totals.select("row", best.alias("best")).select("row", "best.*"), "subvectors-nearest").join(self.vectors, "row")

    def assign(self, centroids: np.ndarray) -> DataFrame:
        return self._nearest(centroids).select("vec_id", F.col("cluster").cast("int").alias("cluster"), "distance")

    def sums(self, centroids: np.ndarray) -> DataFrame:
        placed = self._nearest(centroids).select("cluster", F.posexplode("v").alias("place", "x"))
        return placed.groupBy("cluster", "place").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("total"))


def starts(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors whose ids have the smallest digests with the seed; ids that are null come last."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = vectors.select(digest.alias("digest"), "v").orderBy(F.col("digest").asc_nulls_last(), "v").limit(k)
    return np.array([row["v"] for row in first.collect()], np.int64)


def cluster(rows: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, dim: int = 64, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of the vectors of ``rows`` (vec_id, embedding).

    Every vector is cut into blocks of components and stored as the codes of its subvectors in
    dictionaries of the distinct ones, so nothing is lost. In each round the squared distances of
    the dictionary entries to the centroids are computed once, and a vector's distance is the sum
    of its entries'. A cluster's new centre comes from how often it uses each entry. Centres are the floor
    of the exact mean; a cluster without vectors keeps its centre.

    Blocks are as wide as the data repeat (``WIDTHS``, ``REUSE``). Tasks hold the dictionaries if their distances
    take ``table_bytes`` at most, by count; else the distances are a table that cells of vectors meet by a
    join, with the same result. The driver sees k centroids and sums per cluster and component.

    Vectors that are null, of another length, or hold null or a number that is not finite take
    no part. Rows that share a vec_id, or have none, each count; of equal digests the smaller
    vector starts first. With fewer than k vectors each starts a cluster. Components beyond
    2**26 in size after scaling count as 2**26. No vectors give no rows. Other columns are ignored.
    """
    # Written, so that blocks are cut from numbers and not each from the whole expression again.
    vectors = keep(whole_vectors(rows, dim), "subvectors-vectors")
    most = max(table_bytes // (8 * k), 1)
    width = block_width(vectors, dim, most)
    cells = vectors.select(F.posexplode(_blocks(width, dim)).alias("block", "part"))
    entries = keep(cells.distinct(), "subvectors-dictionary")
    if entries.limit(most + 1).count() <= most:
        # Checked: no more than ``most`` entries.
        books: dict[int, list] = {}
        for block, part in entries.collect():
            books.setdefault(block, []).append(part)
        store = Coded(vectors, {block: np.array(sorted(parts), np.int64) for block, parts in books.items()}, dim, width)
    else:
        store = Joined(vectors, entries, dim, width)
    centroids = starts(vectors, k, seed)
    spark = rows.sparkSession
    if not len(centroids):
        return spark.createDataFrame([], DISTANCES + ", cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        exact = F.col("total").cast("decimal(38,0)")
        means = store.sums(centroids).groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum(exact).alias("total"))
        centroids = centroids.copy()
        for number, place, n, total in means.collect():
            centroids[number, place] = int(total) // n
    placed = keep(store.assign(centroids), "subvectors-placed")
    inertia = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()
    longest = (1 << 63) - 1
    whole = min(sum(int(total) for _, total in inertia), longest)
    spelled = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    of = [(number, min(int(total), longest), whole, spelled[number]) for number, total in inertia]
    facts = spark.createDataFrame(of, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # One row per cluster.
    return placed.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
