import pytest
import random
import zlib

from caseloom.llm import mixing, packing


def slow_best_fit(sizes, capacity):
    bins, places = [], []
    for size in sorted(sizes, reverse=True):
        fits = [(left, number) for number, left in enumerate(bins) if left >= size]
        if fits:
            _, number = min(fits)
        else:
            bins.append(capacity)
            number = len(bins) - 1
        bins[number] -= size
        places.append((size, number))
    return sorted(places)


def test_runs_equal_one_by_one():
    dice = random.Random(3)
    for _ in range(60):
        sizes = [dice.choice([1, 2, 3, 5, 8, 13, 40]) for _ in range(dice.randint(0, 80))]
        items = sorted(((s, sizes.count(s)) for s in set(sizes)), reverse=True)
        placed = packing.best_fit(items, 50)
        ours = sorted((s, n) for (s, _), runs in zip(items, placed) for c, n in runs for _ in range(c))
        assert ours == slow_best_fit(sizes, 50)


def test_limit_and_oversize():
    assert packing.best_fit([(6, 3)], 10, limit=2) is None
    assert packing.best_fit([(11, 1)], 10) is None


def test_pack_messy(messy):
    found = packing.pack(messy, shards=3).collect()
    assert len(found) == 10
    for shard in {r.shard for r in found}:
        assert sorted(r.slot for r in found if r.shard == shard) == list(range(sum(r.shard == shard for r in found)))
    by_id = {r.doc_id: r for r in found}
    assert (by_id[3].size, by_id[3].text_crc32) == (1, None)
    assert (by_id[4].size, by_id[4].text_crc32) == (1, 0)
    assert by_id[8].text_crc32 == zlib.crc32("Ünï ¡ñandú! 12345 ...".encode())
    assert by_id[1].shard == by_id[2].shard and by_id[9].shard == by_id[None].shard


def test_pack_near_equal_and_splits_giants(spark):
    dice = random.Random(5)
    rows = [(i, "x" * dice.randint(1, 400)) for i in range(1500)] + [(2000 + i, "same " * 20) for i in range(1000)]
    found = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), shards=8).collect()
    sizes = [sum(r.size for r in found if r.shard == s) for s in range(8)]
    assert max(sizes) - min(sizes) <= 0.02 * sum(sizes) / 8 + 400
    assert len(found) == 2500


@pytest.mark.parametrize("long, others", [([1_000_000], 2000), ([900_000, 90_000, 90_000], 2000), ([500 * 2**i for i in range(12)], 300), ([7000] * 3, 0)])
def test_pack_long_documents(spark, long, others):
    texts = [("x" if i % 2 else "y") * n for i, n in enumerate(long)] + [f"{i:0100d}" for i in range(others)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = packing.pack(df, shards=16).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
    size = {}
    for r in rows:
        size.setdefault(r["shard"], []).append(r["size"])
    assert set(size) <= set(range(16)) and len(size) == min(16, len(texts))
    mean = sum(map(sum, size.values())) / 16
    shared = [sum(s) for s in size.values() if len(s) > 1]
    # What is above the mean is one document; the others are level.
    assert all(len(s) == 1 for s in size.values() if sum(s) > 1.05 * mean)
    assert not shared or max(shared) - min(shared) <= 0.1 * max(shared) + 101


def test_pack_capacity_and_empty(spark, nothing):
    rows = spark.createDataFrame([(i, "a" * 9) for i in range(10)], "doc_id long, text string")
    found = packing.pack(rows, capacity=30).collect()
    assert {r.shard for r in found} == {0, 1, 2, 3}
    assert packing.pack(nothing).count() == 0


def test_mix_messy(messy, nothing):
    found = mixing.mix(messy).collect()
    assert len(found) == 10 and all(r.taken <= 2 * r.size for r in found)
    assert {r.size for r in found if r.doc_id in (3, 4, 5)} == {0}
    assert mixing.mix(nothing).count() == 0
    again = mixing.mix(messy.repartition(5)).collect()
    assert sorted(map(repr, found)) == sorted(map(repr, again))


def copies_of(df):
    """How often every row is there, without its kind of table."""
    return sorted((repr(row.doc_id), repr(row.text), repr(row.source)) for row in df.collect())


def test_repeat_as_often_as_mixed(spark, messy, nothing):
    dice = random.Random(4)
    rows = [(d, "w " * dice.randint(0, 9), dice.choice(["a", "a", "b", None])) for d in range(300)]
    rows += [(None, "w " * n, "b") for n in range(1, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    often = {(r.doc_id, r.size): r.copies for r in mixing.mix(docs).collect()}
    wanted = sorted(
        (repr(d), repr(text), repr(source)) for d, text, source in rows for _ in range(often[d, text.count("w")])
    )
    assert copies_of(mixing.repeat(docs)) == wanted
    assert copies_of(mixing.repeat(docs.repartition(7))) == wanted
    found = mixing.repeat(messy)
    assert found.columns == messy.columns and copies_of(found) == copies_of(mixing.repeat(messy.repartition(3)))
    assert mixing.repeat(nothing).count() == 0


def slow_targets(sizes, weights, total, cap):
    target, clamped = {}, set()
    while True:
        left = total - sum(cap * sizes[s] for s in clamped)
        weight = sum(weights[s] for s in sizes if s not in clamped)
        over = {s for s in sizes if s not in clamped and left * weights[s] / weight > cap * sizes[s]}
        if not over:
            return {s: cap * sizes[s] if s in clamped else left * weights[s] / weight for s in sizes}
        clamped |= over


def test_targets_against_loop(spark):
    dice = random.Random(9)
    rows, sizes = [], {}
    for s in range(7):
        for d in range(dice.randint(1, 60)):
            words = dice.randint(1, 30)
            rows.append((100 * s + d, "w " * words, f"s{s}"))
            sizes[f"s{s}"] = sizes.get(f"s{s}", 0) + words
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes))}
    wanted = slow_targets(sizes, weights, 1.5 * sum(sizes.values()), 2)
    found = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken = {s: sum(r.taken for r in found if r.doc_id // 100 == int(s[1:])) for s in sizes}
    for row in found:
        assert abs(row.target - wanted[f"s{row.doc_id // 100}"]) < 1e-6
    assert all(abs(taken[s] - wanted[s]) <= 30 for s in sizes)
