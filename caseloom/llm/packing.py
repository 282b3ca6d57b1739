"""Best-fit-decreasing packing of groups of equal texts into shards."""

from __future__ import annotations

import random
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm.tables import digits_for, keep, running

#: Sizes are packed to so many leading bits, rounded up: exact below 2048, within 0.1 % above.
#: There are then at most 2048 + 1024 * 52 size classes, whatever the number of groups.
SIZE_BITS = 11
#: Room above the mean that is tried first, as a share of the mean; doubled until all fit.
FIRST_SLACK = 1 / 1024


@dataclass(slots=True)
class _Node:
    key: tuple[int, int]
    rank: float
    left: _Node | None = None
    right: _Node | None = None


def _split(node, key):
    """The nodes below the key, and the others."""
    if node is None:
        return None, None
    if node.key < key:
        node.right, rest = _split(node.right, key)
        return node, rest
    rest, node.left = _split(node.left, key)
    return rest, node


def _merge(low, high):
    if low is None or high is None:
        return low or high
    if low.rank > high.rank:
        low.right = _merge(low.right, high)
        return low
    high.left = _merge(low, high.left)
    return high


@dataclass
class Bins:
    """Open bins in a balanced tree (a treap) ordered by what is left in them."""

    capacity: int
    limit: int | None = None
    count: int = 0
    root: _Node | None = None
    dice: random.Random = field(default_factory=lambda: random.Random(1))

    def put(self, left: int, number: int) -> None:
        low, high = _split(self.root, (left, number))
        self.root = _merge(_merge(low, _Node((left, number), self.dice.random())), high)

    def tightest(self, size: int) -> tuple[int, int] | None:
        """Takes out the bin with the least room that the size fits in; opens one if there is none."""
        low, high = _split(self.root, (size, -1))
        if high is None:
            self.root = low
            if self.limit is not None and self.count >= self.limit or size > self.capacity:
                return None
            self.count += 1
            return self.capacity, self.count - 1
        first = high
        while first.left is not None:
            first = first.left
        _, high = _split(high, (first.key[0], first.key[1] + 1))
        self.root = _merge(low, high)
        return first.key


def best_fit(items: list[tuple[int, int]], capacity: int, limit: int | None = None) -> list[list[tuple[int, int]]] | None:
    """Best fit decreasing of ``(size, count)`` items, largest size first.

    Returns for every item its ``(count, bin)`` runs, or nothing if ``limit`` bins do not do.
    After an item has entered the tightest bin, that bin is the tightest for the next item of
    the same size as long as it fits, so equal sizes are placed a run at a time, with the
    same outcome as one by one.
    """
    bins, placed = Bins(capacity, limit), []
    for size, count in items:
        runs = []
        while count:
            found = bins.tightest(size)
            if found is None:
                return None
            left, number = found
            taken = min(count, left // size)
            runs.append((taken, number))
            count -= taken
            bins.put(left - taken * size, number)
        placed.append(runs)
    return placed


def _nominal(size):
    """The size, rounded up to ``SIZE_BITS`` leading bits."""
    step = F.pow(F.lit(2.0), F.greatest(F.length(F.bin(size)) - SIZE_BITS, F.lit(0))).cast("long")
    return F.ceil(size / step) * step


def _pieces(count: int, size: int, capacity: int) -> list[tuple[int, int, int]]:
    """A group that fits no bin, cut into as few as possible: (documents per piece, size, pieces)."""
    per = capacity // size
    whole, rest = divmod(count, per)
    return [(per, per * size, whole)] * bool(whole) + [(rest, rest * size, 1)] * bool(rest)


def _plan(classes, giants, capacity, limit):
    """Runs per size class and per giant, or nothing if they do not fit."""
    # A size class may stand for slightly more than its groups have; they fit a bin all the same.
    items = [(min(size, capacity), count, ("class", size), 1) for size, count in classes]
    for number, (_, count, size) in enumerate(giants):
        items += [(total, pieces, ("giant", number), per) for per, total, pieces in _pieces(count, size, capacity)]
    items.sort(key=lambda item: (-item[0], item[2]))
    placed = best_fit([item[:2] for item in items], capacity, limit)
    if placed is None:
        return None
    where: dict[tuple, list[tuple[int, int]]] = {}
    for (_, _, owner, per), runs in zip(items, placed):
        where.setdefault(owner, []).extend((taken * per, number) for taken, number in runs)
    return where


def _ends(runs):
    """Upper ends of the runs, and their bins."""
    ends, total = [], 0
    for taken, _ in runs:
        total += taken
        ends.append(total)
    return ends, [number for _, number in runs]


def _bin_at(rank: str):
    """The bin of a rank among runs given as ``_ends`` and ``_bins``."""
    passed = F.size(F.filter("_ends", lambda end: end <= F.col(rank)))
    return F.element_at("_bins", (passed + 1).cast("int"))


def pack(docs: DataFrame, shards: int | None = 16, capacity: int | None = None) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` of every row of ``docs`` (doc_id, text).

    With ``shards``, the capacity is the least one tried (the mean plus a slack that starts at
    ``FIRST_SLACK`` and doubles) for which best fit decreasing needs no more bins; sizes come
    out near equal. A document or group above the mean of all smaller ones has a shard of its own,
    and the others share those left. With ``capacity`` instead, as many shards as it needs.

    Rows with equal texts are a group and stay together unless the group alone exceeds a shard;
    such a group is cut into full shards and a rest. A document is never cut.

    The driver sees the count of groups per size class and the groups larger than a shard, of
    which there are fewer than shards. Ranks within a class, places within a shard and the
    join of documents with their group are spread over slices.

    Nulls: a null text has size 1, no checksum, and groups with other null texts; a null doc_id
    is kept. Rows with equal doc_id, or wholly equal ones, each get a slot of their own. An empty
    table gives no rows. Other columns are ignored.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    marks = keep(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            size.alias("size"),
            F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"),
            F.coalesce(F.sha2(F.encode("text", "UTF-8"), 256), F.lit("null")).alias("_text"),
            F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("_order"),
        ),
        "pack-marks",
    )
    groups = keep(
        marks.groupBy("_text")
        .agg(F.count(F.lit(1)).alias("_count"), F.first("size").alias("_size"))
        .withColumn("_bytes", F.col("_count") * F.col("_size"))
        .withColumn("_class", _nominal(F.col("_bytes"))),
        "pack-groups",
    )
    total, rows, largest = groups.agg(F.sum("_class"), F.sum("_count"), F.max(_nominal(F.col("_size")))).first()
    total, digits, bins, alone = total or 0, digits_for(rows or 0), shards, 0
    if capacity is not None:
        least = max(capacity, largest or 1)
    else:
        # What exceeds the mean of all others has shards to itself, else the others would all fit into few.
        mean = max(-(-total // bins), 1)
        needs = F.when(F.col("_bytes") <= mean, F.lit(1)).otherwise(F.col("_count"))
        while True:
            least = max(-(-total // bins), 1)
            over = F.when(F.col("_bytes") <= mean, F.col("_bytes")).otherwise(F.col("_size")) > least
            found, rest = groups.agg(F.sum(F.when(over, needs)), F.sum(F.when(~over, F.col("_class")))).first()
            if (found or 0) == alone:
                break
            alone, total, bins = found, rest or 0, max(shards - found, 1)
    giants = [tuple(row) for row in groups.filter(F.col("_bytes") > least).select("_text", "_count", "_size").collect()]
    small = groups.filter(F.col("_bytes") <= least)
    classes = [tuple(row) for row in small.groupBy("_class").agg(F.count(F.lit(1))).collect()]
    giants.sort()
    lonely = []
    if capacity is None:
        lonely = [group for group in giants if group[1] * group[2] <= mean or group[2] > least]
        giants = [group for group in giants if group not in lonely]
    room, slack, plan = least, FIRST_SLACK, None
    while plan is None:
        if capacity is None:
            room = max(int(total / bins * (1 + slack)) + 1, least)
            slack *= 2
        plan = _plan(classes, giants, room, None if capacity else bins)

    spark = docs.sparkSession
    class_runs = [(key, *_ends(runs)) for (kind, key), runs in plan.items() if kind == "class"]
    giant_runs = [(giants[key][0], *_ends(runs)) for (kind, key), runs in plan.items() if kind == "giant"]
    first = shards - alone if capacity is None else 0
    for text, count, each in lonely:
        per = count if count * each <= mean else 1
        ends = list(range(per, count + 1, per))
        giant_runs.append((text, ends, list(range(first, first + len(ends)))))
        first += len(ends)
    runs_of = "array<bigint>, _bins array<int>"
    by_class = spark.createDataFrame(class_runs, f"_class bigint, _ends {runs_of}")
    by_giant = spark.createDataFrame(giant_runs, f"_text string, _ends {runs_of}")
    ones = small.select("_text", "_class", F.lit(1).alias("_one"))
    homes = keep(
        running(ones, ["_class"], ["_text"], "_one", "_rank", digits)
        .join(F.broadcast(by_class), "_class")
        .select("_text", _bin_at("_rank").alias("shard")),
        "pack-homes",
    )
    columns = ["doc_id", "size", "text_crc32", "_order", "shard"]
    placed = marks.join(homes, "_text").select(columns)
    if giant_runs:
        cut = marks.join(F.broadcast(by_giant), "_text").withColumn("_one", F.lit(1))
        cut = running(cut, ["_text"], ["_order", "doc_id"], "_one", "_rank", digits)
        placed = placed.unionByName(cut.withColumn("shard", _bin_at("_rank")).select(columns))
    placed = keep(placed.withColumn("_one", F.lit(1)), "pack-placed")
    slots = running(placed, ["shard"], ["_order", "doc_id", "text_crc32", "size"], "_one", "slot", digits)
    return slots.select("doc_id", "size", "text_crc32", "shard", "slot")
