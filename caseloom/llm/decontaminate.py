"""Finding benchmark items in documents by spaced seeds."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm.tables import keep

#: Masks over eight token positions. A 0 is a position whose token is ignored.
#: Together they meet every overlap of 8 to 29 tokens at the limit of similarity, all placements enumerated.
MASKS = ("11101001", "11010011", "10110101", "11111111", "10011100", "01111000")
#: Tokens an overlap has at least (all of a shorter item's), and the share of them that agree.
MIN_TOKENS, MIN_SIMILARITY = 13, 0.8
#: Seeds of the benchmark that are held by every task (16 bytes each); more are joined by a shuffle.
MAX_SEEDS = 1 << 21
#: Tokens hashed at a time; bounds the memory for very long texts.
CHUNK = 1 << 18
#: Bits of the seed hash that index the table of those that occur at all.
PREFIX = 20

SPAN = len(MASKS[0])


def tokens(text: str | None) -> np.ndarray:
    """Hashes of the text's lower-cased words without outer punctuation."""
    words = (text or "").lower().split()
    digest = xxhash.xxh64_intdigest
    stripped = [word if word.isalnum() else word.strip(PUNCTUATION) for word in words]
    return np.array([digest(word) for word in stripped if word], np.uint64)


# Characters stripped from the ends of words.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»“”„‘’…–—"


def masks_for(length: int) -> list[str]:
    """Masks that keep the tokens of a whole item of fewer tokens than a window, but for as many as may differ."""
    spare = length - math.ceil(length * round(100 * MIN_SIMILARITY) / 100)
    return ["".join("0" if at in out else "1" for at in range(length)) for out in combinations(range(length), spare)]


def seeds(hashes: np.ndarray, short=()) -> tuple[np.ndarray, np.ndarray]:
    """(seed, position) of every window under every mask: a hash of the tokens that the mask keeps.

    ``short`` has the lengths below a window's of which every stretch gets seeds of its own.
    """
    found, places = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    masks = [*enumerate(MASKS), *((SPAN * 100 + length * 10 + n, m) for length in short for n, m in enumerate(masks_for(length)))]
    for number, mask in masks:
        count = len(hashes) - len(mask) + 1
        if count < 1:
            continue
        mixed = np.full(count, number + 1, np.uint64)
        for at, kept in enumerate(mask):
            if kept == "1":
                mixed = (mixed ^ hashes[at : at + count]) * np.uint64(0x9E3779B97F4A7C15)
                mixed ^= mixed >> np.uint64(29)
        found.append(mixed)
        places.append(np.arange(count))
    return np.concatenate(found), np.concatenate(places)


def item_seeds_of(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seeds of a benchmark item; one shorter than a window has those of its length only."""
    return seeds(hashes, [len(hashes)] if 0 < len(hashes) < SPAN else [])


def overlap(doc: np.ndarray, item: np.ndarray, shift: int, at: int) -> tuple[int, int, int] | None:
    """Longest stretch (start in the document, tokens, equal tokens) around document position ``at``
    in which at least ``MIN_SIMILARITY`` of the tokens equal the item's, the item lying ``shift``
    tokens into the document; nothing if it is too short."""
    low, high = max(0, shift), min(len(doc), shift + len(item))
    same = doc[low:high] == item[low - shift : high - shift]
    # Gain per token: positive where the share is above the limit. Whole numbers keep it exact.
    gain = np.where(same, 100 - round(100 * MIN_SIMILARITY), -round(100 * MIN_SIMILARITY))
    sums = np.concatenate([[0], np.cumsum(gain)])
    counts = np.concatenate([[0], np.cumsum(same)])
    seed = min(max(at - low, 0), len(same) - 1)
    # For every end, the leftmost start whose prefix sum is no larger; prefix minima are sorted.
    lowest = np.minimum.accumulate(sums[: seed + 1])
    ends = np.arange(seed + 1, len(sums))
    starts = np.searchsorted(-lowest, -sums[ends], side="left")
    fits = starts <= seed
    if not fits.any():
        return None
    ends, starts = ends[fits], starts[fits]
    best = np.argmax(ends - starts)
    start, length = int(starts[best]), int(ends[best] - starts[best])
    if length < min(MIN_TOKENS, len(item)):
        return None
    return low + start, length, int(counts[start + length] - counts[start])


class Index:
    """Seeds of the benchmark with their (item, position), for lookups of many seeds at once."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        self.items = items
        found = [item_seeds_of(hashes) for _, hashes in items]
        self.short = sorted({len(hashes) for _, hashes in items if 0 < len(hashes) < SPAN})
        every = np.concatenate([s for s, _ in found]) if found else np.empty(0, np.uint64)
        item = np.repeat(np.arange(len(found)), [len(s) for s, _ in found]) if found else np.empty(0, np.int64)
        place = np.concatenate([p for _, p in found]) if found else np.empty(0, np.int64)
        order = np.argsort(every, kind="stable")
        self.seeds, self.item, self.place = every[order], item[order], place[order]
        self.present = np.zeros(1 << PREFIX, bool)
        self.present[(every >> np.uint64(64 - PREFIX)).astype(np.int64)] = True

    def hits(self, hashes: np.ndarray) -> np.ndarray:
        """Distinct (item number, shift, position) rows of the seeds found in a document."""
        out = []
        for start in range(0, max(1, len(hashes) - SPAN + 1), CHUNK):
            found, at = seeds(hashes[start : start + CHUNK + SPAN - 1], self.short)
            maybe = self.present[(found >> np.uint64(64 - PREFIX)).astype(np.int64)]
            found, at = found[maybe], at[maybe] + start
            low, high = np.searchsorted(self.seeds, found, "left"), np.searchsorted(self.seeds, found, "right")
            sizes = high - low
            at, first = np.repeat(at, sizes), np.repeat(low, sizes)
            entry = first + np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            out.append(np.stack([self.item[entry], at - self.place[entry], at], axis=1))
        return np.unique(np.concatenate(out), axis=0)


def best_overlaps(doc: np.ndarray, hits: np.ndarray, items) -> dict[int, tuple[int, int, int]]:
    """Per item number, the verified overlap with the most equal tokens (then the leftmost)."""
    best: dict[int, tuple[int, int, int]] = {}
    covered: dict[tuple[int, int], int] = {}
    for number, shift, at in hits.tolist():
        if covered.get((number, shift), -1) >= at:
            continue
        found = overlap(doc, items[number][1], shift, at)
        if found is None:
            continue
        start, length, same = found
        covered[number, shift] = start + length - 1
        if number not in best or (same, -start) > (best[number][2], -best[number][0]):
            best[number] = found
    return best


RESULT = "doc_id long, item_id long, start long, tokens long, same_tokens long"
NAMES = ["doc_id", "item_id", "start", "tokens", "same_tokens"]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(NAMES)
    return pa.RecordBatch.from_arrays([pa.array(column, pa.int64()) for column in columns], names=NAMES)


def _in_tasks(docs: DataFrame, items: list[tuple[int, np.ndarray]]) -> DataFrame:
    """Looks the documents' seeds up where the documents are."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(shared.value)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                hashes = tokens(text.as_py())
                best = best_overlaps(hashes, index.hits(hashes), index.items)
                rows += [(doc_id, index.items[number][0], *found) for number, found in best.items()]
            yield _batch(rows)

    return docs.mapInArrow(scan, RESULT)


def _by_join(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Joins the documents' seeds with the items' by a shuffle, then verifies each pair of texts."""

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {len(tokens(text.as_py())) for text in batch["text"]}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(n for n in found if 0 < n < SPAN), pa.int32())], names=["n"])

    # At most one row per length below a window's.
    short = sorted(row.n for row in items.select("text").mapInArrow(lengths, "n int").distinct().collect())

    def item_spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch["key"].to_pylist(), batch["text"]):
                found, at = item_seeds_of(tokens(text.as_py()))
                columns = [found.view(np.int64), np.full(len(found), key), at]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["seed", "key", "at"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch["key"].to_pylist(), batch["text"]):
                hashes = tokens(text.as_py())
                for start in range(0, max(1, len(hashes) - SPAN + 1), CHUNK):
                    found, at = seeds(hashes[start : start + CHUNK + SPAN - 1], short)
                    columns = [found.view(np.int64), np.full(len(found), key), at + start]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["seed", "key", "at"])

    schema = "seed long, key long, at long"
    keyed = keep(docs.withColumn("_doc", F.monotonically_increasing_id()), "decontaminate-docs")
    doc_seeds = keyed.select(F.col("_doc").alias("key"), "text").mapInArrow(spread, schema)
    doc_seeds = keep(doc_seeds.withColumnRenamed("key", "_doc"), "decontaminate-doc-seeds")
    item_seeds = items.select(F.col("_item").alias("key"), "text").mapInArrow(item_spread, schema)
    item_seeds = item_seeds.select("seed", F.col("key").alias("_item"), F.col("at").alias("_place"))
    item_seeds = keep(item_seeds, "decontaminate-seeds")
    shift = F.col("at") - F.col("_place")
    hits = doc_seeds.join(item_seeds, "seed").select("_doc", "_item", shift.alias("shift"), "at").distinct()
    hits = keep(hits, "decontaminate-hits")
    pairs = hits.groupBy("_doc", "_item").agg(F.collect_list(F.struct("shift", "at")).alias("hits"))
    pairs = keep(pairs, "decontaminate-pairs")
    both = keep(pairs.join(keyed, "_doc"), "decontaminate-texts")
    both = both.join(items.select("_item", "item_id", F.col("text").alias("item_text")), "_item")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, item_id, item_text, hits in zip(*(column.to_pylist() for column in batch.columns)):
                at = np.array(sorted((0, hit["shift"], hit["at"]) for hit in hits))
                best = best_overlaps(tokens(text), at, [(item_id, tokens(item_text))])
                rows += [(doc_id, item_id, *found) for found in best.values()]
            yield _batch(rows)

    return both.select("doc_id", "text", "item_id", "item_text", "hits").mapInArrow(verify, RESULT)


def contaminated(docs: DataFrame, benchmark: DataFrame, max_seeds: int = MAX_SEEDS) -> DataFrame:
    """``doc_id, item_id, start, tokens, same_tokens``: a row for every row of ``docs`` (doc_id, text)
    and item of ``benchmark`` (item_id, text) that overlap: the best overlap of the two.

    Every window of eight tokens is hashed under each mask, which ignores some positions, so a
    window with a substituted token still meets its counterpart. At each hit the texts are laid
    over each other, and the overlap is the longest stretch around the hit in which at least
    ``MIN_SIMILARITY`` of the tokens are equal; it counts from ``MIN_TOKENS`` tokens on, or the
    whole item if that is shorter. ``start`` and ``tokens`` count tokens of the document.

    Up to ``max_seeds`` seeds, the benchmark's seeds go to the tasks and the documents stay
    where they are. Beyond that, both sides' seeds are joined by a shuffle, with the same result.

    Null, empty and wordless texts overlap with nothing. Null ids are kept. Repeated items and
    documents give a row each. An item of fewer than eight tokens fills no window and is
    looked up as a whole, with as many tokens substituted as the share allows. Empty tables give no rows. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter(F.length("text") > 0)
    words = F.size(F.split(F.trim("text"), r"\s+"))
    wanted = items.agg(F.coalesce(F.sum(words), F.lit(0))).first()[0] * len(MASKS)
    if wanted <= max_seeds:
        listed = [(row[0], tokens(row[1])) for row in items.collect()]
        return _in_tasks(docs, [item for item in listed if len(item[1])])
    return _by_join(docs, keep(items.withColumn("_item", F.monotonically_increasing_id()), "decontaminate-items"))
