"""Near-duplicate documents by SimHash, linked through Golay-code keys."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm.components import components
from caseloom.llm.tables import keep

#: Words per shingle of the fingerprint, and the seed of its hash.
SHINGLE, SEED = 3, 42
#: Differing bits up to which fingerprints link. The segment keys below hold for this number.
MAX_BITS = 3
#: Shingles whose bits are counted at a time; bounds the memory for very long texts.
CHUNK = 1 << 16

# Generator polynomial of the (23, 12) Golay code, and how 64 bits are cut.
GENERATOR = 0b101011100011
SEGMENTS = ((0, 23), (23, 23), (46, 18))
PAIRS = ((0, 1), (0, 2), (1, 2))
WIDTH, INFO = 23, 12


def fingerprint(text: str | None) -> int:
    """SimHash of the text's word shingles; zero without words."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    words = data.split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(line, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: 1 - SHINGLE].tolist()
    stops = ends[SHINGLE - 1 :].tolist()
    digest, ones, count = xxhash.xxh64_digest, np.zeros(64, np.int64), len(starts)
    for at in range(0, count, CHUNK):
        hashes = b"".join([digest(line[a:b], SEED) for a, b in zip(starts[at : at + CHUNK], stops[at : at + CHUNK])])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > count).tobytes(), "big")


def signed(value: int) -> int:
    """The 64 bits as a signed number."""
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint`` (64 bits, signed) of every row of ``docs`` (doc_id, text)."""

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [signed(fingerprint(text.as_py())) for text in batch["text"]]
            columns = [batch["doc_id"], pa.array(prints, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "fingerprint"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(marks, "doc_id long, fingerprint long")


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator: 11 bits that are zero for codewords."""
    rest = words.astype(np.int64)
    for bit in range(WIDTH - 1, WIDTH - INFO - 1, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - (WIDTH - INFO))), rest)
    return rest


def error_patterns() -> tuple[np.ndarray, np.ndarray]:
    """Per syndrome: all patterns of at most 4 bits, that of at most 3 first (padded), and their number.

    The code is perfect: every word lies within 3 bits of exactly one codeword.
    """
    patterns = [sum(1 << b for b in bits) for weight in range(5) for bits in combinations(range(WIDTH), weight)]
    patterns = np.array(patterns, np.int64)
    of = syndrome(patterns)
    order = np.argsort(of, kind="stable")
    sizes = np.bincount(of, minlength=1 << (WIDTH - INFO))
    table = np.zeros((len(sizes), sizes.max()), np.int64)
    column = np.arange(len(patterns)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    table[of[order], column] = patterns[order]
    return table, sizes


def codewords(words: np.ndarray, patterns: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all codewords within 4 bits of each 23-bit word, the nearest first (padded), and their number."""
    table, sizes = patterns
    of = syndrome(words)
    return (words[:, None] ^ table[of]) >> (WIDTH - INFO), sizes[of]


def golay_keys(prints: np.ndarray, patterns: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, side) of signed fingerprints.

    Two fingerprints with at most 3 differing bits have at least two of three segments with at
    most one differing bit each. In such a segment, the codeword nearest to one lies within
    3 + 1 bits of the other. So for each pair of segments, side 0 has the nearest codeword of
    the first segment with every nearby one of the second, and side 1 the other way round:
    fingerprints within 3 bits agree in a key of opposite sides, whichever takes which side.
    """
    bits = prints.astype(np.int64).view(np.uint64)
    parts = [((bits >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
    near, out = [codewords(part, patterns) for part in parts], []
    for number, (one, two) in enumerate(PAIRS):
        for side, (single, many) in enumerate(((one, two), (two, one))):
            indices, sizes = near[many]
            row, column = np.nonzero(np.arange(indices.shape[1]) < sizes[:, None])
            first, second = near[single][0][row, 0], indices[row, column]
            low, high = (first, second) if side == 0 else (second, first)
            key = (number << 2 * INFO) | (low << INFO) | high
            out.append((row, key, np.full(len(row), side)))
    return tuple(np.concatenate(parts) for parts in zip(*out))


def links(prints: DataFrame) -> DataFrame:
    """Pairs ``a < b`` of distinct fingerprints (column ``fingerprint``) with at most 3 differing bits."""
    patterns = error_patterns()

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = batch["fingerprint"].to_numpy(np.int64)
            row, key, side = golay_keys(values, patterns)
            yield pd.DataFrame({"key": key, "side": side, "fingerprint": values[row]})

    keyed = keep(prints.mapInPandas(keys, "key int, side byte, fingerprint long"), "golay-keys")
    left = keyed.filter("side = 0").select("key", F.col("fingerprint").alias("a"))
    right = keyed.filter("side = 1").select("key", F.col("fingerprint").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS
    return left.join(right, (left["key"] == right["key"]) & (F.col("a") < F.col("b")) & near).select("a", "b").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row of ``docs`` (doc_id, text).

    Fingerprints with at most ``MAX_BITS`` differing bits link; ``component_id`` is the smallest
    doc_id that can be reached. Equal fingerprints are one node, so copies make no pairs, and
    only links between different fingerprints are ever formed.

    Null and wordless texts have fingerprint zero and link like others. Rows with a null doc_id
    get a component like others, but name none; a component of such rows only has none. Rows
    that share a doc_id link only by their texts. An empty table gives no rows. Other columns
    are ignored.
    """
    marked = keep(fingerprints(docs), "simhash")
    prints = keep(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("_first")), "simhash-distinct")
    roots = components(links(prints), "simhash-links").withColumnRenamed("node", "fingerprint")
    rooted = keep(
        prints.join(roots, "fingerprint", "left").select(
            "fingerprint", "_first", F.coalesce("root", "fingerprint").alias("root")
        ),
        "simhash-roots",
    )
    names = keep(rooted.groupBy("root").agg(F.min("_first").alias("component_id")), "simhash-names")
    named = keep(rooted.join(names, "root").select("fingerprint", "component_id"), "simhash-named")
    return marked.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")
