"""Passages that repeat across documents, by MinHash banding of paragraphs, spans between anchors and equal stretches of words."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseloom.llm.components import components
from caseloom.llm.tables import keep, release

#: Words per shingle, and the Jaccard similarity from which paragraphs are near copies.
SHINGLE, SIMILARITY = 5, 0.8
#: Bands and rows per band: a pair at the limit collides with probability 1 - (1 - 0.8**4)**14 = 0.9994.
BANDS, ROWS = 14, 4
#: Words that a run of repeated paragraphs has at least to count as a passage.
PASSAGE = 50
#: Times that colliding paragraphs are compared with one of them, before the rest is compared in pairs.
ROUNDS = 2
#: Words hashed before rows are handed on.
CHUNK = 1 << 17
#: Characters of the neighbouring texts that are hashed together.
BUNDLE = 1 << 17
#: Least hashes of a paragraph of which a near copy has one: at the limit with probability 1 - 0.2**4 = 0.9984.
MARKS = 4
#: Least and most bits, as powers of two, of a shared table; in between it has eight per value or more.
LEAST_BITS, MOST_BITS = 20, 28
#: Words of 64 bits in a set's parity sketch.
SKETCH = 4
#: Members of a bucket that one slice of it compares with all others.
SLICE = 2048
#: Stretches in one row of the table of hashes; bounds the size of its batches.
RUN = 128
#: The words of a text, as ``paragraphs`` splits them.
WORD = re.compile(r"[^ \t\n\r\x0b\x0c]+")


def paragraphs(text: str) -> Iterator[tuple[int, int, list[bytes]]]:
    """(start, end, lower-cased words) of the lines of a text that have words."""
    at = 0
    for line in text.split("\n"):
        words = line.lower().encode("utf-8", "surrogatepass").split()
        if words:
            yield at, at + len(line), words
        at += len(line) + 1


def shingles(words: list[bytes]) -> list[int]:
    """Hashes of the word shingles; of all words if there are fewer."""
    count = max(1, len(words) - SHINGLE + 1)
    digest = xxhash.xxh64_intdigest
    return [digest(b" ".join(words[at : at + SHINGLE])) for at in range(count)]


def similarity(one: list[bytes], two: list[bytes]) -> float:
    """Jaccard similarity of the shingle sets."""
    a, b = set(shingles(one)), set(shingles(two))
    return len(a & b) / len(a | b)


def _mixers() -> tuple[np.ndarray, np.ndarray]:
    dice = np.random.default_rng(20)
    return dice.integers(1, 1 << 63, BANDS * ROWS, np.uint64) | np.uint64(1), dice.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def band_keys(sets: list[np.ndarray], mixers) -> np.ndarray:
    """(paragraph, band) keys: the MinHash values of a band's rows, hashed together."""
    sizes = np.array([len(of) for of in sets])
    hashes = np.concatenate(sets)
    starts = np.cumsum(sizes) - sizes
    keys = np.empty((len(sets), BANDS), np.uint64)
    for band in range(BANDS):
        mixed = np.full(len(sets), band + 1, np.uint64)
        for row in range(band * ROWS, (band + 1) * ROWS):
            values = (hashes ^ mixers[1][row]) * mixers[0][row]
            values ^= values >> np.uint64(32)
            least = np.minimum.reduceat(values, starts)
            mixed = (mixed ^ least) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(31)
        keys[:, band] = mixed
    return keys


#: What a row of the table of units is.
LINE, SPAN, RUNS = 0, 1, 2
UNITS = "kind int, _row long, doc_id long, _of long, paragraph int, start int, end int, at int, words int, text_id binary, bands binary, windows binary"
UNIT_TYPES = [pa.int32(), *[pa.int64()] * 3, *[pa.int32()] * 5, *[pa.binary()] * 3]
UNIT_NAMES = [part.split()[0] for part in UNITS.split(", ")]


def text_id(words: list[bytes]) -> bytes:
    """128 bits that name a paragraph's words."""
    return xxhash.xxh3_128_digest(b" ".join(words))


class Words:
    """The lines of texts that have words, and all words with their hashes; ``ends`` are the lines and words up to the end of each text."""

    def __init__(self, *texts: str | None):
        self.places, counts, self.words, self.ends = [], [], [], []
        for text in texts:
            for start, end, words in paragraphs(text or ""):
                self.places.append((start, end))
                counts.append(len(words))
                self.words += words
            self.ends.append((len(self.places), len(self.words)))
        self.counts = np.array(counts, np.int64)
        self.starts = np.cumsum(self.counts) - self.counts
        self.hashes = np.fromiter(map(xxhash.xxh64_intdigest, self.words), np.uint64, len(self.words))

    def marks(self, mixers) -> np.ndarray:
        """(line, mark): the least hashes of its shingles, in several orders; of all words if there are fewer."""
        found = np.empty((len(self.counts), MARKS), np.uint64)
        for count in range(1, SHINGLE):
            of = np.flatnonzero(self.counts == count)
            whole = self.hashes[self.starts[of]] + np.uint64(count)
            for at in range(1, count):
                whole = _mix(whole, self.hashes[self.starts[of] + at])
            found[of] = whole[:, None]
        of = np.flatnonzero(self.counts >= SHINGLE)
        if len(of):
            every = np.append(stretches(self.hashes, SHINGLE), np.uint64(0))
            edges = np.stack([self.starts[of], self.starts[of] + self.counts[of] - SHINGLE + 1], axis=1).ravel()
            for mark in range(MARKS):
                values = (every ^ mixers[0][mark]) * mixers[1][mark]
                values ^= values >> np.uint64(32)
                found[of, mark] = np.minimum.reduceat(values, edges)[::2]
        return found


def bundles(texts: pa.Array) -> Iterator[tuple[int, Words]]:
    """Neighbouring texts, hashed together, and the place of the first: arrays of many words cost less than many of few."""
    found, first, size = [], 0, 0
    for text in texts:
        found.append(text.as_py())
        size += len(found[-1] or "")
        if size >= BUNDLE:
            yield first, Words(*found)
            found, first, size = [], first + len(found), 0
    if found:
        yield first, Words(*found)


def _shared(docs: DataFrame, passage: int):
    """A table of the anchors of stretches and of the marks of lines that are in documents of more than one doc_id."""
    mixers, part = _mixers(), _part(passage)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, ids, waiting = [], [], 0
            doc_ids = batch["doc_id"].to_pylist()
            for first, texts in bundles(batch["text"]):
                marks = texts.marks(mixers)
                least = anchors(texts.hashes, part) if len(texts.words) >= part else None
                line, word = 0, 0
                for doc_id, (line_end, word_end) in zip(doc_ids[first:], texts.ends):
                    if word_end > word:
                        values = [marks[line:line_end].ravel()]
                        if word_end - word >= part:
                            of = least[word : word_end - part + 1]
                            values.append(of[np.concatenate([[True], of[1:] != of[:-1]])])
                        found.append(np.unique(np.concatenate(values)).view(np.int64))
                        ids.append(np.full(len(found[-1]), doc_id))
                        waiting += len(found[-1])
                    line, word = line_end, word_end
                if waiting >= CHUNK:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (found, ids)], names=["anchor", "doc_id"])
                    found, ids, waiting = [], [], 0
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (found, ids)], names=["anchor", "doc_id"])

    marked = docs.select("doc_id", "text").mapInArrow(mark, "anchor long, doc_id long")
    seen = marked.groupBy("anchor").agg(F.min("doc_id").alias("_low"), F.max("doc_id").alias("_high"))
    shared = keep(seen.filter("_low < _high").select("anchor"), "paragraph-shared")
    table = _table(shared, "anchor")
    release(shared)
    return table


def spans(hashes: np.ndarray, wanted: np.ndarray, passage: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(at, words, keys) of the stretches of 1 to 1.5 times ``passage`` words between two of the wanted anchors.

    Both ends depend on the words there alone, so altered copies are cut alike, wherever in their
    lines they are. A key is a hash of both anchors and of as many words as half a shortest span has
    between them, behind the first anchor or before the second: one edit leaves one of the keys.
    """
    short = _short(_part(passage))
    power = stretches(hashes, short)
    here = np.flatnonzero(np.isin(power, wanted))
    here = here[np.concatenate([[True], (np.diff(here) > 1) | (power[here[1:]] != power[here[:-1]])])] if len(here) else here
    half = max(1, (passage - 2 * short) // 2)
    low = np.searchsorted(here, here + max(passage - short, short + half))
    high = np.maximum(low, np.searchsorted(here, here + passage + passage // 2 - short))
    many = high - low
    first = np.repeat(here, many)
    if not len(first):
        return first, first, np.empty((0, 2), np.uint64)
    last = here[np.repeat(low - np.cumsum(many) + many, many) + np.arange(len(first))]
    ends, between = _mix(power[first], power[last]), stretches(hashes, half)
    keys = np.stack([_mix(ends, between[first + short]), _mix(ends, between[last - half])], axis=1)
    return first, last + short - first, keys


def _units(rows: DataFrame, table, passage: int) -> DataFrame:
    """``UNITS`` of the rows (_row, doc_id, _of, text), those only that share a value of the table with another document:

    lines with their band keys if they are long enough to have near copies, spans between anchors
    with theirs, and runs of neighbouring stretches of ``passage`` words with their hashes.
    All stretches that are in documents of more than one doc_id are among the last, for the anchors of
    their first and of their last two thirds are in several documents.
    """
    mixers, part = _mixers(), _part(passage)

    def finish(rows, sets):
        keys = band_keys([of for of in sets if of is not None], mixers) if any(of is not None for of in sets) else ()
        keys = iter(keys)
        lines = [(*row, next(keys).tobytes() if of is not None else None, None) for row, of in zip(rows[LINE], sets)]
        every = lines + rows[SPAN] + rows[RUNS]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*every), UNIT_TYPES)], names=UNIT_NAMES)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, sets, waiting = ([], [], []), [], 0
        for batch in batches:
            names = list(zip(*(batch[c].to_pylist() for c in ("_row", "doc_id", "_of"))))
            for first, texts in bundles(batch["text"]):
                if not texts.words:
                    continue
                marked = _in(table, texts.marks(mixers)).any(axis=1)
                every = stretches(texts.hashes, SHINGLE) if marked.any() and len(texts.words) >= SHINGLE else None
                least = anchors(texts.hashes, part) if len(texts.words) >= part else None
                anchored = _in(table, least) if least is not None else None
                line, word = 0, 0
                for name, (line_end, word_end) in zip(names[first:], texts.ends):
                    size, hashes = word_end - word, texts.hashes[word:word_end]
                    for mark in np.flatnonzero(marked[line:line_end]).tolist():
                        at, count = int(texts.starts[line + mark]), int(texts.counts[line + mark])
                        rows[LINE].append((LINE, *name, mark, *texts.places[line + mark], at - word, count, text_id(texts.words[at : at + count])))
                        sets.append(every[at : at + count - SHINGLE + 1] if count >= SHINGLE else None)
                        waiting += count
                    if size >= part:
                        shared = anchored[word : word_end - part + 1]
                        wanted = np.unique(least[word : word_end - part + 1][shared])
                        for at, count, keys in zip(*spans(hashes, wanted, passage) if len(wanted) else ([],) * 3):
                            span = xxhash.xxh3_128_digest(hashes[at : at + count].tobytes())
                            rows[SPAN].append((SPAN, *name, None, None, None, int(at), int(count), span, keys.tobytes(), None))
                            waiting += 8
                        runs = _runs(np.flatnonzero(shared[: size - passage + 1] & shared[passage - part :])) if size >= passage else []
                        windows = stretches(hashes, passage) if runs else None
                        for run in runs:
                            data = windows[run[0] : run[-1] + 1].tobytes()
                            rows[RUNS].append((RUNS, *name, None, None, None, int(run[0]), len(run), None, None, data))
                            waiting += len(run)
                    line, word = line_end, word_end
                    if waiting >= CHUNK:
                        yield finish(rows, sets)
                        rows, sets, waiting = ([], [], []), [], 0
        if waiting:
            yield finish(rows, sets)

    return rows.select("_row", "doc_id", "_of", "text").mapInArrow(scan, UNITS)


def _only(rows: DataFrame, table, column: str = "_of") -> DataFrame:
    """The rows whose value of a column may be in the table."""

    def only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_in(table, batch[column].to_numpy())))

    return rows.mapInArrow(only, rows.schema)


SKETCHED = ["size", *(f"s{number}" for number in range(SKETCH))]


def sketch(values: np.ndarray) -> np.ndarray:
    """Whether the number of the set's hashes that fall to a bit is odd, for every bit.

    Equal hashes of two sets cancel, so two sketches differ in no more bits than the sets in hashes.
    """
    odd = np.bincount((values % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, size, s0.., set): the distinct shingle hashes of the units (node, place), their number and sketch.

    ``place`` (_of, at, words) is where one of the equal units is. Texts without any are left out by a table before the join.
    """
    places = wanted.select("place._of", F.struct("node", "place.at", "place.words").alias("unit"))
    places = keep(places.groupBy("_of").agg(F.collect_list("unit").alias("units")), "paragraph-places")
    texts = _only(docs.select("_of", "text"), _table(places, "_of")).groupBy("_of").agg(F.first("text").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, found = [], []
            for text, units in zip(batch["text"], batch["units"]):
                hashes = word_hashes(text.as_py())
                for node, at, count in (unit.values() for unit in units.as_py()):
                    nodes.append(node)
                    found.append(np.unique(stretches(hashes[at : at + count], SHINGLE)))
            marks = np.array([sketch(of) for of in found], np.int64).reshape(-1, SKETCH)
            columns = [pa.array(nodes, pa.int64()), pa.array([len(of) for of in found], pa.int32()), *map(pa.array, marks.T)]
            columns.append(pa.array([of.view(np.int64) for of in found], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, names=["node", *SKETCHED, "set"])

    marks = ", ".join(f"{name} long" for name in SKETCHED[1:])
    joined = texts.join(places, "_of").select("text", "units")
    sets = keep(joined.mapInArrow(cut, f"node long, size int, {marks}, set array<bigint>"), "paragraph-sets")
    release(places)
    return sets


def _may_be_alike(one: str, two: str):
    """Whether two structs of ``SKETCHED`` leave it possible that the sets are similar; never wrong about those that are."""
    a, b = F.col(f"{one}.size"), F.col(f"{two}.size")
    apart = sum(F.bit_count(F.col(f"{one}.{s}").bitwiseXOR(F.col(f"{two}.{s}"))) for s in SKETCHED[1:])
    # Sets are similar if they differ in at most this many hashes; a little more for rounding.
    most = (a + b) * ((1 - SIMILARITY) / (1 + SIMILARITY)) + 1e-6
    return (F.abs(a - b) <= most) & (apart <= most)


def _first_common(one: str, two: str):
    """The first band in which two units collide: of all buckets that a pair shares, one has to name it."""
    keys = [[F.substring(bands, 1 + 8 * band, 8) for bands in (one, two)] for band in range(BANDS)]
    return F.coalesce(*[F.when(a == b, F.lit(band)) for band, (a, b) in enumerate(keys)])


def _alike(one: str, two: str):
    """Whether two shingle sets are similar; sizes too different are told without comparing."""
    a, b = F.size(one), F.size(two)
    both = F.size(F.array_intersect(one, two))
    near = F.least(a, b) / F.greatest(a, b) >= SIMILARITY
    return near & (both / (a + b - both) >= SIMILARITY)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar; the second set is compared as it is joined."""
    left = sets.select(F.col("node").alias("a"), F.col("set").alias("_one"))
    right = sets.select(F.col("node").alias("b"), F.col("set").alias("_two"))
    half = keep(pairs.join(left, "a"), "paragraph-half")
    links = keep(half.join(right, (half["b"] == right["b"]) & _alike("_one", "_two")).select("a", half["b"]), "paragraph-links")
    release(half)
    return links


def classes(docs: DataFrame, units: DataFrame) -> DataFrame:
    """(text_id, component): units, which are lines and spans of the texts of ``docs`` (_of, text), that are equal, or connected by near copies, share a component.

    Equal units are one node. Nodes that collide in a band are compared with one of them,
    then with another, as long as they are not all connected. What is still apart after
    ``ROUNDS`` is compared in pairs, except with what it is already connected to: sketches
    within the join, sliced for large buckets, then the sets of the pairs that the sketches
    let pass. So a large group of near copies of one paragraph costs a few comparisons of
    sets each, and no link between components is lost.
    """
    nodes = keep(
        units.groupBy("text_id")
        .agg(F.min(F.struct("_of", "at", "words")).alias("place"), F.first("bands").alias("bands"))
        .withColumn("node", F.monotonically_increasing_id()),
        "paragraph-nodes",
    )
    keyed = nodes.filter("bands IS NOT NULL").selectExpr(
        "node", "posexplode(transform(sequence(0, int(length(bands) / 8) - 1), n -> substring(bands, 1 + 8 * n, 8))) AS (band, key)"
    )
    keyed = keyed.select("node", "band", F.xxhash64("band", "key").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("_size")).filter("_size > 1")
    sizes = keep(sizes, "paragraph-buckets")
    together = keep(keyed.join(sizes, "key"), "paragraph-members")
    release(sizes)
    central = together.groupBy("node").agg(F.sum("_size").alias("_company"))
    central = keep(central, "paragraph-central")
    sets = _sets(docs, central.join(nodes.select("node", "place"), "node").select("node", "place"))
    known = sets.select("node", F.struct(*SKETCHED).alias("mark")).join(central, "node")
    known = keep(known, "paragraph-known")
    members = keep(together.select("key", "band", "node").join(known, "node"), "paragraph-company")
    release(together, known, central)

    found, homes = None, None
    for attempt in range(ROUNDS + 1):
        placed = members.withColumn("home", F.col("node"))
        if homes is not None:
            placed = members.join(homes, "node", "left").withColumn("home", F.coalesce("root", "node")).drop("root")
        placed = keep(placed, "paragraph-placed")
        used = [placed]
        # The first to be compared with has the most company in its buckets, as an original among
        # its altered copies has; the others are picked by hash.
        turn = -F.col("_company") if attempt == 0 else F.xxhash64("node", F.lit(attempt))
        # Buckets that are not all of one component.
        span = placed.groupBy("key").agg(
            F.min("home").alias("_low"), F.max("home").alias("_high"),
            F.min(F.struct(turn.alias("turn"), "node", "home", "mark")).alias("_head"), F.count(F.lit(1)).alias("_size"),
        )
        split = keep(span.filter("_low < _high"), "paragraph-split")
        used.append(split)
        if attempt < ROUNDS:
            other = placed.join(split, "key").filter((F.col("home") != F.col("_head.home")) & _may_be_alike("mark", "_head.mark"))
            pairs = other.select(F.least("node", "_head.node").alias("a"), F.greatest("node", "_head.node").alias("b"))
        else:
            slices = F.ceil(F.col("_size") / SLICE).cast("int")
            apart = placed.join(split.select("key", slices.alias("_slices")), "key")
            apart = keep(apart.select("key", "band", "node", "home", "mark", "_slices"), "paragraph-apart")
            used.append(apart)
            apart = keep(apart.join(nodes.select("node", "bands"), "node"), "paragraph-apart-bands")
            used.append(apart)
            here = apart.select(
                "key", F.pmod(F.xxhash64("node"), "_slices").cast("int").alias("_slice"), "band",
                F.col("node").alias("a"), F.col("home").alias("_home_a"), F.col("mark").alias("_one"), F.col("bands").alias("_bands_a"),
            )
            twin = apart.select(
                "key", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1)).alias("_slice"),
                F.col("node").alias("b"), F.col("home").alias("_home_b"), F.col("mark").alias("_two"), F.col("bands").alias("_bands_b"),
            )
            # Compared within the join, so that few pairs come out of it.
            met = (here["key"] == twin["key"]) & (here["_slice"] == twin["_slice"]) & (F.col("a") < F.col("b"))
            met = met & (F.col("_home_a") != F.col("_home_b")) & _may_be_alike("_one", "_two")
            met = met & (_first_common("_bands_a", "_bands_b") == F.col("band"))
            pairs = here.join(twin, met).select("a", "b")
        pairs = keep(pairs.distinct(), "paragraph-pairs")
        release(*used)
        if pairs.isEmpty():
            continue
        links = _verified(pairs, sets)
        release(pairs)
        found = links if found is None else keep(found.unionByName(links), "paragraph-all")
        homes = components(found, "paragraph-components")
    release(members, sets)
    if homes is None:
        return nodes.select("text_id", F.col("node").alias("component"))
    return nodes.join(homes, "node", "left").select("text_id", F.coalesce("root", "node").alias("component"))


def _mix(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    mixed, other = one * np.uint64(0x9E3779B97F4A7C15), two * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed += other
    mixed ^= np.right_shift(mixed, np.uint64(29), out=other)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= np.right_shift(mixed, np.uint64(32), out=other)
    return mixed


def stretches(words: np.ndarray, count: int) -> np.ndarray:
    """A hash of every stretch of ``count`` words, from the words' hashes."""
    found, done, power, size, places = None, 0, words, 1, len(words) - count + 1
    while size <= count:
        if count & size:
            part = power[done : done + places]
            found, done = part if found is None else _mix(found, part), done + size
        if 2 * size <= count:
            power = _mix(power[:-size], power[size:])
        size *= 2
    return found


def _part(passage: int) -> int:
    """Words of the stretches that have an anchor."""
    return max(1, 2 * passage // 3)


def _short(part: int) -> int:
    """Words of an anchor."""
    return max(1, part // 3)


def anchors(words: np.ndarray, part: int) -> np.ndarray:
    """For every stretch of ``part`` words the least hash of the shorter ones in it.

    It depends on the stretch alone, so equal stretches have the same anchor, and neighbours mostly share one.
    """
    short = _short(part)
    power, size, width = stretches(words, short), 1, part - short + 1
    while 2 * size <= width:
        power = np.minimum(power[:-size], power[size:])
        size *= 2
    places = len(words) - part + 1
    return np.minimum(power[:places], power[width - size : width - size + places])


def word_hashes(text: str | None) -> np.ndarray:
    words = (text or "").lower().encode("utf-8", "surrogatepass").split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _table(rows: DataFrame, column: str):
    """A shared table of bits for the column's values; it never rules out one that occurs.

    It grows with the number of rows, which are of a written table, up to 32 MB. Slices of it are packed by the tasks.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, (8 * rows.count()).bit_length()))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices: dict[int, np.ndarray] = {}
        for batch in batches:
            values = batch["bit"].to_numpy()
            for part in np.unique(values >> 16).tolist():
                flags = np.zeros(1 << 16, bool)
                flags[values[values >> 16 == part] & 0xFFFF] = True
                slices[part] = slices.get(part, 0) | np.packbits(flags)
        columns = [pa.array(list(slices), pa.int64()), pa.array([of.tobytes() for of in slices.values()], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "slice"])

    places = rows.select(F.col(column).bitwiseAND(F.lit((1 << bits) - 1).cast("long")).alias("bit"))
    packed = places.repartition(F.shiftright("bit", 16)).mapInArrow(pack, "part long, slice binary").toArrow()
    table = np.zeros(1 << (bits - 3), np.uint8)
    for part, of in zip(packed["part"].to_pylist(), packed["slice"].to_pylist()):
        table[part << 13 : (part + 1) << 13] = np.frombuffer(of, np.uint8)
    return rows.sparkSession.sparkContext.broadcast(table)


def _in(table, values: np.ndarray) -> np.ndarray:
    """Whether the values may be in the table."""
    packed = table.value
    places = (values & values.dtype.type(8 * len(packed) - 1)).astype(np.int64)
    return (packed[places >> 3] >> (7 - (places & 7)).astype(np.uint8) & 1).view(bool)


def _runs(places: np.ndarray) -> list[np.ndarray]:
    """Ascending places, cut where one is left out and after every ``RUN``."""
    whole = np.split(places, np.flatnonzero(np.diff(places) != 1) + 1) if len(places) else []
    return [run[at : at + RUN] for run in whole for at in range(0, len(run), RUN)]


def _joined(pieces: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The intervals in order, those that touch as one."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(pieces):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def _without(pieces: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What the taken intervals, in order, leave of the others."""
    left = []
    for low, high in pieces:
        for t_low, t_high in taken:
            if t_low >= high:
                break
            if low < t_low:
                left.append((low, t_low))
            low = max(low, t_high)
        if low < high:
            left.append((low, high))
    return left


def _arrays(of: list, type_: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    names, types = zip(*(part.split() for part in type_.split(", ")))
    columns = [list(column) for column in zip(*of)] if of else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types)], names=list(names))


STRETCHES = "doc_id long, paragraph int, start int, end int, words int, first_doc_id long, removed boolean"


def equal_stretches(docs: DataFrame, windows: DataFrame, listed: DataFrame, near: DataFrame, passage: int) -> DataFrame:
    """``STRETCHES`` of all runs of ``passage`` or more words that are equal in documents of
    different doc_ids, and of the spans ``near`` (_of, first_doc_id, low, high) that have an altered copy in
    another document, as far as the words ``low`` to ``high`` of ``listed`` (_of, low, high) leave them.

    Words of runs whose first document is this one are kept, the others are ``removed``.
    Stretches that listed words cover are looked up for others, but not themselves, so the join
    has those only that the paragraphs miss.
    """
    docs = docs.select("_of", "doc_id", "text")
    taken = listed.groupBy("_of").agg(F.collect_set(F.struct("low", "high")).alias("taken"))
    spread = windows.select("_of", "at", "n").distinct().groupBy("_of").agg(F.collect_list(F.struct("at", "n")).alias("runs"))
    taken = keep(taken, "paragraph-taken")
    spread = keep(spread.join(taken, "_of", "left"), "paragraph-spread")

    def uncovered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for of, runs, taken in zip(*(batch[c].to_pylist() for c in ("_of", "runs", "taken"))):
                # Places of the stretches that lie in listed words as a whole.
                inside = [(low, high - passage + 1) for low, high in _joined([tuple(t.values()) for t in taken or []])]
                inside = [(low, high) for low, high in inside if low < high]
                for at, n in (run.values() for run in runs):
                    rows += [(of, low, high) for low, high in _without([(at, at + n)], inside)]
            yield _arrays(rows, "_of long, low int, high int")

    open_runs = keep(spread.mapInArrow(uncovered, "_of long, low int, high int"), "paragraph-open")
    release(spread)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for of, at, data, low, high in zip(*(batch[c].to_pylist() for c in ("_of", "at", "windows", "low", "high"))):
                hashes = np.frombuffer(data, np.int64)[low - at : high - at]
                found.append((np.full(len(hashes), of), np.arange(low, high, dtype=np.int32), hashes))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=["_of", "at", "window"])

    mine = _only(windows.select("_of", "at", "n", "windows"), _table(open_runs, "_of"))
    mine = mine.dropDuplicates(["_of", "at"]).join(open_runs, "_of").filter("low >= at AND high <= at + n")
    asked = keep(mine.mapInArrow(ask, "_of long, at int, window long"), "paragraph-asked")
    asked_table = _table(asked, "window")
    release(open_runs)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [np.frombuffer(data.as_buffer(), np.int64) for data in batch["windows"]]
            if hashes:
                ids = np.repeat(batch["doc_id"].to_numpy(), [len(of) for of in hashes])
                every = np.concatenate(hashes)
                found = _in(asked_table, every)
                yield pa.RecordBatch.from_arrays([pa.array(every[found]), pa.array(ids[found])], names=["window", "doc_id"])

    answers = windows.select("doc_id", "windows").mapInArrow(answer, "window long, doc_id long")
    firsts = answers.groupBy("window").agg(F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("_last"))
    firsts = keep(firsts.filter("first_doc_id < _last").drop("_last"), "paragraph-window-firsts")
    found = asked.join(firsts, "window").select("_of", "at", "first_doc_id")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                of, at, ids = (batch[c].to_numpy() for c in ("_of", "at", "first_doc_id"))
                new = np.ones(len(of), bool)
                new[1:] = (np.diff(of) != 0) | (np.diff(at) > passage) | (np.diff(ids) != 0)
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(of)) - 1
                columns = [of[first], ids[first], at[first], at[last] + np.int32(passage)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["_of", "first_doc_id", "low", "high"])

    pieces = found.repartition("_of").sortWithinPartitions("_of", "at").mapInArrow(merge, "_of long, first_doc_id long, low int, high int")
    pieces = pieces.unionByName(near)
    gathered = keep(pieces.groupBy("_of").agg(F.collect_list(F.struct("first_doc_id", "low", "high")).alias("found")), "paragraph-found")
    release(asked, firsts)
    pieces = gathered.join(taken, "_of", "left")
    columns = pieces.schema

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            open_ = []
            for found, taken in zip(batch["found"].to_pylist(), batch["taken"].to_pylist()):
                used = _joined([tuple(t.values()) for t in taken or []])
                open_.append(bool(_without(_joined([(p["low"], p["high"]) for p in found]), used)))
            yield batch.filter(pa.array(open_, pa.bool_()))

    pieces = keep(pieces.mapInArrow(left, columns), "paragraph-pieces")
    release(gathered, taken)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, found, taken in zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "found", "taken"))):
                spans = [match.span() for match in WORD.finditer(text)]
                lines = [start for start, _, _ in paragraphs(text)]
                used = _joined([tuple(t.values()) for t in taken or []])
                by_first: dict[int, list[tuple[int, int]]] = {}
                for first, low, high in (piece.values() for piece in found):
                    by_first.setdefault(first, []).append((low, high))
                # Words that are first seen here are kept, whatever else they are part of.
                for first in sorted(by_first, key=lambda first: (first != doc_id, first)):
                    for low, high in _without(_joined(by_first[first]), used):
                        start, end = spans[low][0], spans[high - 1][1]
                        rows.append((doc_id, bisect_right(lines, start) - 1, start, end, high - low, first, first != doc_id))
                    used = _joined(used + by_first[first])
            yield _arrays(rows, STRETCHES)

    found = keep(_only(docs, _table(pieces, "_of")), "paragraph-stretch-texts")
    return found.join(pieces, "_of").select("doc_id", "text", "found", "taken").mapInArrow(finish, STRETCHES)


def repeated_passages(docs: DataFrame, passage: int = PASSAGE) -> DataFrame:
    """``doc_id, paragraph, start, end, words, component_id, first_doc_id, removed``: the paragraphs
    of ``docs`` (doc_id, text) that are part of a passage which repeats across documents, and the
    stretches of other lines that do.

    A paragraph is a line with words; it repeats if a paragraph of its component is in a document
    of another doc_id. A passage is a run of paragraphs of a document, nothing but repeated ones,
    of ``passage`` words or more together. Of every component the first paragraph (by doc_id and
    place) is kept, the others are ``removed``. ``start`` and ``end`` are code points in the text.

    Every run of ``passage`` words that is equal, apart from case and white space, in documents of
    different doc_ids is listed too, wherever in their lines it starts and ends: what no listed
    paragraph covers is a row of its own, whose ``paragraph`` is the line that it starts in. So are spans
    of 1 to 1.5 times ``passage`` words between two anchors that have a near copy in another document. Such a
    row is ``removed`` if the run is in a document of a smaller doc_id; rows first seen in the same
    document share a component, whose number is negative.

    Null and empty texts have no paragraphs. Rows without a doc_id are left out. Rows that share a
    doc_id are one document: repeats among them do not count. Paragraphs of fewer than five words
    repeat only as equal ones. An empty table gives no rows. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id IS NOT NULL")
    # Equal rows share a name.
    docs = docs.withColumn("_of", F.xxhash64("doc_id", "text"))
    rows = docs.withColumn("_row", F.monotonically_increasing_id())
    every = keep(_units(rows, _shared(docs, passage), passage), "paragraph-units")
    units, lines, spanned = (every.filter(F.col("kind").isin(*kinds)) for kinds in ((LINE, SPAN), (LINE,), (SPAN,)))
    classed = keep(classes(docs, units), "paragraph-classes")
    of_text = units.groupBy("text_id").agg(
        F.min(F.struct("doc_id", "paragraph", "_row")).alias("_first"), F.max("doc_id").alias("_last")
    )
    of_text = keep(of_text, "paragraph-seen")
    joined = keep(classed.join(of_text, "text_id"), "paragraph-joined")
    release(classed, of_text)
    repeated = joined.groupBy("component").agg(F.min("_first").alias("_first"), F.max("_last").alias("_last"), F.count(F.lit(1)).alias("_texts"))
    repeated = keep(repeated.filter("_first.doc_id < _last"), "paragraph-repeated")
    named = keep(joined.select("text_id", "component").join(repeated.select("component", "_first", "_texts"), "component"), "paragraph-named")
    release(joined, repeated)
    place = ["_row", "doc_id", "_of", "paragraph", "start", "end", "at", "words"]
    marked = keep(lines.select(*place, "text_id").join(named, "text_id").drop("text_id", "_texts"), "paragraph-marked")
    # Spans that are equal only are among the equal stretches.
    altered = named.filter("_texts > 1").select("text_id", F.col("_first.doc_id").alias("first_doc_id"))
    near = spanned.select("_of", F.col("at").alias("low"), (F.col("at") + F.col("words")).alias("high"), "text_id")
    near = keep(near.join(altered, "text_id").select("_of", "first_doc_id", "low", "high").distinct(), "paragraph-near")
    release(named)
    windows = every.filter(F.col("kind") == RUNS).select("_of", "doc_id", "at", F.col("words").alias("n"), "windows")
    island = F.col("paragraph") - F.row_number().over(Window.partitionBy("_row").orderBy("paragraph"))
    total = F.sum("words").over(Window.partitionBy("_row", "_island"))
    runs = marked.withColumn("_island", island).withColumn("_total", total).filter(F.col("_total") >= passage)
    runs = keep(runs.drop("_island", "_total"), "paragraph-runs")
    release(marked)
    others = equal_stretches(docs, windows, runs.selectExpr("_of", "at AS low", "at + words AS high"), near, passage)
    release(every, near)
    other = F.xxhash64("first_doc_id").bitwiseOR(F.lit(-(1 << 63)).cast("long"))
    others = others.select("doc_id", "paragraph", "start", "end", "words", other.alias("component_id"), "first_doc_id", "removed")
    first = F.struct("doc_id", "paragraph", "_row")
    runs = runs.select(
        "doc_id", "paragraph", "start", "end", "words", F.col("component").alias("component_id"),
        F.col("_first.doc_id").alias("first_doc_id"), (first != F.col("_first")).alias("removed"),
    )
    return runs.unionByName(others)
