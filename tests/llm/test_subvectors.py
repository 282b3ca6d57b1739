import hashlib
import random

import numpy as np
import pytest

from caseloom.llm import subvectors

SCHEMA = "vec_id long, embedding array<double>, label int, cluster string, v string"


def plain(rows, k, rounds, dim):
    """The clustering one vector at a time."""
    kept = []
    for vec_id, vector, *_ in rows:
        if vector is not None and len(vector) == dim and all(x is not None and np.isfinite(x) for x in vector):
            kept.append((vec_id, [max(-(1 << 26), min(1 << 26, int(np.floor(256 * x)) if abs(x) < 1e15 else int(np.sign(x)) << 26)) for x in vector]))
    digest = lambda i: (i is None, hashlib.sha256(f"2:{i}".encode()).hexdigest())
    centroids = [v for _, v in sorted(kept, key=lambda row: (digest(row[0]), row[1]))[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def assign():
        return [min((far(v, c), number) for number, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        of = [number for _, number in assign()]
        for number in set(of):
            mine = [v for (_, v), n in zip(kept, of) if n == number]
            centroids[number] = [sum(x) // len(mine) for x in zip(*mine)]
    placed = assign()
    sums = {n: sum(d for d, m in placed if m == n) for _, n in placed}
    spelled = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(
        [(i, n, d, sums[n], sum(sums.values()), spelled[n]) for (i, _), (d, n) in zip(kept, placed)], key=repr
    )


def rows_of(df):
    return sorted([tuple(row) for row in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()], key=repr)


@pytest.mark.parametrize("steps, width", [(1000, 1), (3, 8)])
@pytest.mark.parametrize("table_bytes", [subvectors.TABLE_BYTES, 64])
def test_same_as_one_by_one(spark, steps, width, table_bytes):
    dice = random.Random(steps)
    rows = [(i, [dice.randrange(-steps, steps) / 256 / steps * 64 for _ in range(8)], 1, "x", "y") for i in range(900)]
    if width > 1:
        # Few distinct subvectors: blocks of several components pay.
        palette = [[dice.randrange(-90, 90) / 256 for _ in range(4)] for _ in range(6)]
        rows = [(i, dice.choice(palette) + dice.choice(palette), 1, "x", "y") for i in range(900)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = subvectors.cluster(df, k=7, rounds=3, dim=8, table_bytes=table_bytes)
    assert rows_of(found) == plain(rows, 7, 3, 8)
    most = subvectors.TABLE_BYTES // 56
    assert subvectors.block_width(subvectors.whole_vectors(df, 8), 8, most) == width


@pytest.mark.parametrize("table_bytes", [subvectors.TABLE_BYTES, 8])
def test_bad_vectors_ties_and_repeats(spark, table_bytes):
    good = [0.5, -0.25, 0.0, 1.0]
    rows = [
        (1, good), (1, good), (2, good), (None, [1.0] * 4), (3, None), (4, []), (5, [1.0]), (6, [None, 1.0, 1.0, 1.0]),
        (7, [float("nan")] + good[1:]), (8, [float("-inf")] + good[1:]), (9, [1e300, -1e300, 0.0, 0.0]), (10, [-0.001] * 4),
    ]
    rows = [(i, v, 1, "x", "y") for i, v in rows]
    df = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(subvectors.cluster(df, k=5, rounds=2, dim=4, table_bytes=table_bytes)) == plain(rows, 5, 2, 4)
    # Fewer vectors than centroids.
    assert rows_of(subvectors.cluster(df, k=40, rounds=2, dim=4, table_bytes=table_bytes)) == plain(rows, 40, 2, 4)
    assert rows_of(subvectors.cluster(df.filter("false"), dim=4, table_bytes=table_bytes)) == []


def test_codes_are_lossless():
    dice = np.random.default_rng(1)
    entries = np.unique(dice.integers(-5, 5, (300, 3)), axis=0)
    book = subvectors.Dictionary(entries)
    assert (book.codes(entries) == np.arange(len(entries))).all()
    asked = entries[dice.integers(0, len(entries), 1000)]
    assert (entries[book.codes(asked)] == asked).all()
