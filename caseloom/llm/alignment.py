"""Links between the tokens of two tokenizers, from products of sparse incidence matrices."""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm.tables import keep

#: Where the vocabularies are; the driver reads them and tasks get their bytes.
FOLDER = "/opt/tokenizers"
BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"
# Fixed value: how the byte-level vocabulary cuts a text before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A stretch of text from a space after something else up to the next such space. No token of either
#: tokenizer crosses from a character that is no white space to a space, so stretches are tokenized alone.
STRETCH = re.compile(r"\s*\S+(?:[^\S ]\s*\S+)*(?:[^\S ]\s*\Z)?|\s+")
#: Characters of text that a task takes at a time, a longer text as a whole; products formed at a time.
SLICE, PRODUCTS = 4 << 20, 1 << 20
#: Stretches tokenized in one go; distinct stretches that a task remembers before it starts anew.
RUN, REMEMBERED = 1000, 1 << 19
#: Distinct pairs of ids whose counts every task holds at most (17 bytes each); more are joined by a shuffle.
MAX_PAIRS = 1 << 22
#: Ids of the second tokenizer are below 2**SHIFT; a pair is first << SHIFT | second.
SHIFT = 16
WIDTH = 1 << 2 * SHIFT

LINKED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_overlaps long, groups_sha256 string, pairs array<long>, links array<long>"


def _byte_letters() -> dict[str, int]:
    """Byte behind each letter of byte-level entries: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    letters = {chr(byte): byte for byte in plain}
    others = [byte for byte in range(256) if chr(byte) not in letters]
    return letters | {chr(256 + at): byte for at, byte in enumerate(others)}


class First:
    """The byte-level tokenizer of a JSON vocabulary, special tokens left out."""

    def __init__(self, data: bytes):
        import tiktoken

        whole = json.loads(data)
        vocabulary, merges = whole["model"]["vocab"], whole["model"]["merges"]
        special = {token["content"] for token in whole["added_tokens"]}
        letters = _byte_letters()
        self.bytes = {number: bytes(letters[c] for c in entry) for entry, number in vocabulary.items() if entry not in special}
        made = [vocabulary["".join(merge if isinstance(merge, list) else merge.split(" "))] for merge in merges]
        if made != sorted(made):
            raise ValueError("merges must be in the order of the ids they make")
        ranks = {entry: number for number, entry in self.bytes.items()}
        self.encode = tiktoken.Encoding("first", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def tokens(self, text: str) -> list[int]:
        """Ids of a text that begins with a space."""
        return self.encode(text)


class Second:
    """The piece tokenizer, which puts a space before what it gets."""

    def __init__(self, data: bytes):
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_proto=data)
        if model.get_piece_size() > 1 << SHIFT:
            raise ValueError(f"more than {1 << SHIFT} pieces")
        pieces = ((number, model.id_to_piece(number)) for number in range(model.get_piece_size()))
        self.bytes = {n: bytes([int(p[3:5], 16)]) if model.is_byte(n) else p.replace("▁", " ").encode() for n, p in pieces}
        self.space = model.piece_to_id("▁")

    def tokens(self, text: str) -> list[int]:
        """Ids of a text that begins with a space: the one it puts there itself, which it doesn't before nothing."""
        return self.model.encode(text[1:], num_threads=1) if text != " " else [self.space]


class Table:
    """Bytes of every id, end to end."""

    def __init__(self, entries: dict[int, bytes]):
        every = [entries.get(number, b"") for number in range(max(entries) + 1)]
        self.sizes = np.array([len(entry) for entry in every], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(every), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.data[_spread(self.starts[ids], self.sizes[ids])]


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for sizes[0] numbers, then the same of the next."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def _ends(sizes) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def csr(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, height: int, width: int):
    """(row ends, columns, values) of a sparse matrix from its cells; cells that meet are added up."""
    key = rows * width + columns
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    total = np.add.reduceat(values[order], first) if len(key) else np.empty(0, np.int64)
    cells = key[first]
    return np.searchsorted(cells, np.arange(height + 1) * width), cells % width, total


def product(left, right, width: int):
    """Gustavson's product of two CSR matrices: a row of the result gathers the right rows that its left row names.

    Rows are taken together as long as they form ``PRODUCTS`` single products at most.
    """
    ends, columns, values = left
    right_ends, right_columns, right_values = right
    sizes = right_ends[columns + 1] - right_ends[columns]
    work = _ends(sizes)[ends]
    parts, start, height = [], 0, len(ends) - 1
    while start < height:
        stop = max(start + 1, int(np.searchsorted(work, work[start] + PRODUCTS, "right")) - 1)
        cells = slice(ends[start], ends[stop])
        many = sizes[cells]
        at = _spread(right_ends[columns[cells]], many)
        rows = np.repeat(np.repeat(np.arange(stop - start), np.diff(ends[start : stop + 1])), many)
        parts.append(csr(rows, right_columns[at], np.repeat(values[cells], many) * right_values[at], stop - start, width))
        start = stop
    if not parts:
        return np.zeros(1, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    lengths = np.concatenate([np.diff(part[0]) for part in parts])
    return _ends(lengths), np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])


def overlaps(a_sizes: np.ndarray, b_sizes: np.ndarray):
    """CSR of the bytes that each A token shares with each B token, of tokens that cover the same bytes."""
    size = int(a_sizes.sum())
    ones = np.ones(size, np.int64)
    a_bytes = (_ends(a_sizes), np.arange(size), ones)
    # B's transpose: a row per byte, with the one token that holds it.
    b_bytes = (np.arange(size + 1), np.repeat(np.arange(len(b_sizes)), b_sizes), ones)
    return product(a_bytes, b_bytes, max(len(b_sizes), 1))


def _tokens(stretches: list[str], data: list[bytes], tokenizer, table: Table):
    """(ids, tokens per stretch, whether they spell it) of all stretches, many of them tokenized in one go.

    Stretches put together are cut at least where they meet, unless one ends in white space, which
    goes alone. If the bytes of a run are not those of its tokens, its stretches are looked at one by one.
    """
    parts, counts, good = [], np.zeros(len(stretches), np.int64), np.ones(len(stretches), bool)
    alone = [s[-1].isspace() for s in stretches]
    start = 0
    while start < len(stretches):
        stop = start + 1
        while not alone[start] and stop < len(stretches) and stop < start + RUN and not alone[stop]:
            stop += 1
        found = np.array(tokenizer.tokens("".join(stretches[start:stop])), np.int64)
        ends = np.cumsum(table.sizes[found])
        edges = np.cumsum([len(d) for d in data[start:stop]])
        at = np.searchsorted(ends, edges)
        met = table.joined(found).tobytes() == b"".join(data[start:stop]) and at[-1] == len(ends) - 1 and (ends[at] == edges).all()
        if met:
            counts[start:stop] = np.diff(np.concatenate([[-1], at]))
        elif stop - start > 1:
            single = [np.array(tokenizer.tokens(s), np.int64) for s in stretches[start:stop]]
            counts[start:stop] = list(map(len, single))
            good[start:stop] = [table.joined(of).tobytes() == d for of, d in zip(single, data[start:stop])]
            found = np.concatenate(single)
        else:
            counts[start], good[start] = len(found), False
        parts.append(found)
        start = stop
    return np.concatenate([np.empty(0, np.int64), *parts]), counts, good


class Aligned:
    """Groups and links of distinct stretches of text."""

    def __init__(self, stretches: list[str], first: First, second: Second, tables: tuple[Table, Table]):
        data = [s.encode() for s in stretches]
        self.good = np.ones(len(stretches), bool)
        sides = []
        for tokenizer, table in zip((first, second), tables):
            ids, counts, good = _tokens(stretches, data, tokenizer, table)
            sides.append((ids, counts))
            self.good &= good
        kept = [ids[np.repeat(self.good, n)] for ids, n in sides]
        self.counts = [np.where(self.good, n, 0) for _, n in sides]
        lengths = [table.sizes[ids] for ids, table in zip(kept, tables)]
        ends = [np.cumsum(of) for of in lengths]
        common = np.intersect1d(*ends, assume_unique=True)
        self.group = [np.searchsorted(common, of) for of in ends]
        height = len(stretches)
        of_stretch = [np.repeat(np.arange(height), n) for n in self.counts]
        groups_of = np.zeros(len(common), np.int64)
        groups_of[self.group[0]] = of_stretch[0]
        self.n_groups = np.bincount(groups_of, minlength=height) if len(common) else np.zeros(height, np.int64)
        shared = overlaps(*lengths)
        self.n_overlaps = np.add.reduceat(np.concatenate([np.diff(shared[0]), [0]]), np.minimum(_ends(self.counts[0])[:-1], len(kept[0]))) * (self.counts[0] > 0) if height else np.empty(0, np.int64)
        self.ends, self.pairs, self.links = self._pairs(kept, of_stretch, len(common), height)
        self.text = self._spelled(kept, len(common))

    def _pairs(self, ids, of_stretch, groups: int, height: int):
        """CSR of stretches by pairs of ids, with their links."""
        names, of_name = np.unique(of_stretch[0] << 32 | ids[0], return_inverse=True)
        a_groups = csr(of_name, self.group[0], np.ones(len(of_name), np.int64), len(names), max(groups, 1))
        width = 1 << SHIFT
        b_groups = csr(self.group[1], ids[1], np.ones(len(ids[1]), np.int64), groups, width)
        ends, b_ids, links = product(a_groups, b_groups, width)
        of = np.repeat(np.arange(len(names)), np.diff(ends))
        return csr(names[of] >> 32, (names[of] & 0xFFFFFFFF) << SHIFT | b_ids, links, height, WIDTH)

    def _spelled(self, ids, groups: int) -> list[str]:
        """``a1,a2|b1;a3|b2`` of every stretch."""
        sides = []
        for of, group in zip(ids, self.group):
            words = list(map(str, of.tolist()))
            ends = np.searchsorted(group, np.arange(groups + 1)).tolist()
            sides.append([words[s] if e == s + 1 else ",".join(words[s:e]) for s, e in zip(ends, ends[1:])])
        spelled = [f"{a}|{b}" for a, b in zip(*sides)]
        ends = _ends(self.n_groups).tolist()
        return [";".join(spelled[s:e]) for s, e in zip(ends, ends[1:])]


class Known:
    """What a task knows of the stretches it has met; new ones are aligned a slice at a time."""

    def __init__(self, first: First, second: Second):
        self.first, self.second = first, second
        self.tables = (Table(first.bytes), Table(second.bytes))
        self.forget()

    def forget(self):
        self.index: dict[str, int] = defaultdict(itertools.count().__next__)
        self.text: list[str] = []
        self.good, self.ends = np.empty(0, bool), np.zeros(1, np.int64)
        self.sums = np.empty((4, 0), np.int64)
        self.pairs, self.links = np.empty(0, np.int64), np.empty(0, np.int64)

    def meet(self, texts: list[str | None]) -> list[list[int]]:
        """Numbers of the stretches of every text."""
        if len(self.text) > REMEMBERED:
            self.forget()
        number = self.index.__getitem__
        found = [list(map(number, STRETCH.findall(f" {text}"))) if text else [] for text in texts]
        of = Aligned(list(itertools.islice(self.index, len(self.text), None)), self.first, self.second, self.tables)
        self.text += of.text
        self.good = np.concatenate([self.good, of.good])
        self.sums = np.concatenate([self.sums, [*of.counts, of.n_groups, of.n_overlaps]], axis=1)
        self.ends = np.concatenate([self.ends, self.ends[-1] + of.ends[1:]])
        self.pairs, self.links = np.concatenate([self.pairs, of.pairs]), np.concatenate([self.links, of.links])
        return found

    def documents(self, ids: list, texts: list[str | None]) -> pa.RecordBatch:
        """Rows of ``LINKED`` for some documents."""
        found = self.meet(texts)
        counts = np.array([len(f) for f in found], np.int64)
        flat = np.fromiter(itertools.chain.from_iterable(found), np.int64, int(counts.sum()))
        rows = np.repeat(np.arange(len(texts)), counts)
        whole = np.bincount(rows, ~self.good[flat], len(texts)) == 0
        rows, flat = rows[whole[rows]], flat[whole[rows]]
        # Documents by stretches times stretches by pairs: documents by pairs.
        use = csr(rows, flat, np.ones(len(flat), np.int64), len(texts), max(len(self.text), 1))
        ends, pairs, links = product(use, (self.ends, self.pairs, self.links), WIDTH)
        n_a, n_b, n_groups, n_overlaps = (np.bincount(rows, n[flat], len(texts)).astype(np.int64) for n in self.sums)
        text = self.text.__getitem__
        digests = [hashlib.sha256(";".join(map(text, f)).encode()).hexdigest() if f and fine else "" for f, fine in zip(found, whole.tolist())]
        n_links = _ends(links)[ends[1:]] - _ends(links)[ends[:-1]]
        offsets = pa.array(ends.astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(values)) for values in (pairs, links)]
        columns = [pa.array(ids, pa.int64()), *map(pa.array, (n_a, n_b, n_groups, n_links, n_overlaps)), pa.array(digests, pa.string()), *lists]
        return pa.RecordBatch.from_arrays(columns, names=[part.split()[0] for part in LINKED.split(", ")])


def _read(spark: SparkSession, folder: str):
    """The two vocabularies, a few MB of fixed size, for all tasks."""
    data = []
    for name in (BYTE_BPE, PIECE_BPE):
        with open(f"{folder}/{name}", "rb") as file:
            data.append(file.read())
    return spark.sparkContext.broadcast(data)


def linked(docs: DataFrame, folder: str = FOLDER) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text), columns ``LINKED``, as a kept table.

    ``pairs`` are the distinct pairs of an id of the byte-level tokenizer and one of the piece
    tokenizer that are linked in the text (first id times 2**16 plus second), ``links`` their token
    occurrence pairs that share a group; ``n_overlaps`` counts the token pairs that share a byte.

    Stretches of text between spaces are tokenized and multiplied once in a task that remembers
    them, however often they occur; a document's links are those of its stretches. A text whose
    tokens don't spell it exactly, an empty one and null have no tokens, links or digest.
    """
    shared = _read(docs.sparkSession, folder)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(First(shared.value[0]), Second(shared.value[1]))
        for batch in batches:
            ids, sizes = batch["doc_id"].to_pylist(), pa.compute.utf8_length(batch["text"]).fill_null(0).to_pylist()
            start, held = 0, 0
            for at, size in enumerate([*sizes, SLICE + 1]):
                if at > start and held + size > SLICE:
                    yield known.documents(ids[start:at], batch["text"].slice(start, at - start).to_pylist())
                    start, held = at, 0
                held += size

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, LINKED)
    return keep(rows.withColumn("row", F.monotonically_increasing_id()), "alignment-links")


def pair_counts(links: DataFrame) -> DataFrame:
    """``pair, n, best``: documents that hold the pair linked, and whether no pair of the same first id has more."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, n = np.unique(batch["pairs"].flatten().to_numpy(zero_copy_only=False), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs, pa.int64()), pa.array(n, pa.int64())], names=["pair", "n"])

    parts = links.select("pairs").mapInArrow(work, "pair long, n long")
    counts = keep(parts.groupBy("pair").agg(F.sum("n").alias("n")), "alignment-counts")
    first = F.shiftright("pair", SHIFT)
    most = counts.groupBy(first.alias("first")).agg(F.max("n").alias("most"))
    best = counts.withColumn("first", first).join(most, "first")
    return keep(best.select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "alignment-pairs")


def align(docs: DataFrame, folder: str = FOLDER, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_overlaps`` of every row of ``docs`` (doc_id, text).

    A token's bytes are those of its entry. Bytes where tokens of both end cut them into groups, and
    tokens of one group are linked. ``n_best`` counts links whose pair of ids is linked in as many
    documents as any of its first id, ``count_sum`` adds these numbers of documents over all links.

    Counts of up to ``max_pairs`` distinct pairs are held by every task; of more, documents' pairs
    meet them in a join, with the same result.

    Null, empty and not exactly spelled texts get zeros and an empty digest. Rows that are equal or
    share a doc_id are documents of their own. An empty table gives no rows. Other columns are ignored.
    """
    links = linked(docs, folder)
    counts = pair_counts(links)
    facts = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    if counts.limit(max_pairs + 1).count() <= max_pairs:
        table = counts.toArrow()
        order = np.argsort(table["pair"].to_numpy())
        held = [table[c].to_numpy()[order] for c in ("pair", "n", "best")]
        # Checked: no more than ``max_pairs`` rows of 17 bytes.
        shared = docs.sparkSession.sparkContext.broadcast(held)

        def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, n, best = shared.value
            for batch in batches:
                many = batch["links"].flatten().to_numpy(zero_copy_only=False)
                at = np.searchsorted(known, batch["pairs"].flatten().to_numpy(zero_copy_only=False))
                rows = np.repeat(np.arange(batch.num_rows), pa.compute.list_value_length(batch["pairs"]).to_numpy(zero_copy_only=False))
                sums = []
                for values in (many * best[at], many * n[at]):
                    total = np.zeros(batch.num_rows, np.int64)
                    np.add.at(total, rows, values)
                    sums.append(pa.array(total))
                kept = [batch[c] for c in (*facts, "groups_sha256", "n_overlaps")]
                yield pa.RecordBatch.from_arrays([*kept, *sums], names=[*facts, "groups_sha256", "n_overlaps", "n_best", "count_sum"])

        types = ", ".join(f"{c} long" for c in facts) + ", groups_sha256 string, n_overlaps long, n_best long, count_sum long"
        found = links.select(*facts, "groups_sha256", "n_overlaps", "pairs", "links").mapInArrow(look_up, types)
    else:
        cells = links.select("row", F.explode(F.arrays_zip("pairs", "links")).alias("of")).select("row", F.col("of.pairs").alias("pair"), "of.links")
        met = keep(cells, "alignment-cells").join(counts, "pair")
        sums = met.groupBy("row").agg(
            F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"), F.sum(F.col("links") * F.col("n")).alias("count_sum")
        )
        found = links.drop("pairs", "links").join(keep(sums, "alignment-sums"), "row", "left").fillna(0, ["n_best", "count_sum"])
    return found.select(*facts, "n_best", "count_sum", "groups_sha256", "n_overlaps")
