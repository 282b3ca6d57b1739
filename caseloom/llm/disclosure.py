"""Personal data, and the terms that give it away by the company they keep in the corpus."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm.tables import keep

#: Kinds of personal data, in the order of the digest.
KINDS = ("email", "ip", "card", "phone")
#: Words on each side of personal data that can give it away, looked for within so many characters.
WINDOW, REACH = 8, 256
#: A term near personal data discloses it by the share of the data's information that it carries:
#: from the first share on it is generalised, from the second on removed.
GENERALISE, REMOVE = 0.8, 0.95
#: A term's share of occurrences near personal data counts at its lower bound, this many standard
#: errors down (one-sided 95 %), so that few occurrences say less than many.
CONFIDENCE = 1.645
#: Bits of the table that tells which words may be candidates, when all words are counted.
TABLE_BITS = 22

# The patterns of the base detectors. A word character before the domain's @ is found
# by going back from it, and digits are taken whole, so that no text is scanned more than once.
AT = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")
TERM = re.compile(r"[^\W\d_]+")


def emails(text: str) -> list[tuple[int, int]]:
    found, before = [], 0
    for match in AT.finditer(text) if "@" in text else ():
        start = match.start()
        while start > before and text[start - 1] in LOCAL:
            start -= 1
        if start < match.start():
            found.append((start, match.end()))
            before = match.end()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (2 if place % 2 else 1)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def _is_card(found: str) -> bool:
    digits = NOT_DIGIT.sub("", found)
    return 16 <= len(digits) <= 19 and luhn(digits)


def _is_ip(found: str) -> bool:
    return all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255 for part in found.split("."))


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Start and end of the personal data in a text, by kind, in code points."""

    def valid(pattern, test):
        return [match.span() for match in pattern.finditer(text) if test(match.group())]

    return {
        "email": emails(text),
        "ip": valid(IP, _is_ip),
        "card": valid(CARD, _is_card),
        "phone": valid(PHONE, lambda found: 8 <= len(NOT_DIGIT.sub("", found)) <= 15) if "+" in text else [],
    }


def near_terms(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Spans of the words around a span; words cut off by ``REACH`` do not count."""
    low, high = max(0, start - REACH), min(len(text), end + REACH)
    left = [match.span() for match in TERM.finditer(text, low, start)]
    if left and left[0][0] == low and low and TERM.match(text[low - 1]):
        left = left[1:]
    right = [match.span() for match in TERM.finditer(text, end, high)]
    if right and right[-1][1] == high and high < len(text) and TERM.match(text[high]):
        right = right[:-1]
    yield from left[-WINDOW:]
    yield from right[:WINDOW]


def _contexts(text: str, spans) -> list[dict]:
    taken = sorted(span for found in spans.values() for span in found)
    contexts = []
    for kind, found in spans.items():
        near = {span for start, end in found for span in near_terms(text, start, end)}
        for start, end in sorted(near):
            if not any(a < end and start < b for a, b in taken):
                contexts.append({"kind": kind, "term": text[start:end].lower(), "start": start, "end": end})
    return contexts


FOUND = (
    "_row long, doc_id long, text_id binary, counts array<bigint>, base string, "
    "contexts array<struct<kind: string, term: string, start: int, end: int>>"
)
CONTEXT = pa.struct([("kind", pa.string()), ("term", pa.string()), ("start", pa.int32()), ("end", pa.int32())])


def text_id(text: str) -> bytes:
    """128 bits that name a text; copies share them."""
    return xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names, counts, bases, contexts = [], [], [], []
        for text in batch["text"]:
            text = text.as_py() or ""
            names.append(text_id(text))
            spans = base_spans(text)
            counts.append([len(spans[kind]) for kind in KINDS])
            bases.append(",".join(f"{kind}:{start}:{end}" for kind in KINDS for start, end in spans[kind]))
            contexts.append(_contexts(text, spans) if bases[-1] else [])
        columns = [batch["_row"], batch["doc_id"], pa.array(names, pa.binary()), pa.array(counts, pa.list_(pa.int64())), pa.array(bases, pa.string())]
        columns.append(pa.array(contexts, pa.list_(CONTEXT)))
        yield pa.RecordBatch.from_arrays(columns, names=["_row", "doc_id", "text_id", "counts", "base", "contexts"])


def _bit(term: str | bytes) -> int:
    return xxhash.xxh64_intdigest(term) >> (64 - TABLE_BITS)


def _table(rows: DataFrame, column: str, bit) -> np.ndarray:
    """A packed bit table, of fixed size, of the column's values; it never rules out one that occurs."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sorted({bit(value) for value in batch[column].to_pylist()})
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32())], names=["bit"])

    table = np.zeros(1 << TABLE_BITS, bool)
    table[rows.select(column).mapInArrow(bits, "bit int").distinct().toArrow()["bit"].to_numpy()] = True
    return np.packbits(table)


def term_counts(docs: DataFrame, candidates: DataFrame, copied: DataFrame) -> DataFrame:
    """(term, n): how often the terms occur in all distinct texts; the term "" has the number of all words.

    Tasks count all words, but hand on only those that a bit table of the candidates, whose size
    is fixed, does not rule out. Terms that pass by chance are dropped by a later join. Texts
    that a second such table takes for one of ``copied`` (text_id) are handed on by themselves,
    so that copies count once.
    """
    tables = _table(candidates, "term", _bit), _table(copied, "text_id", _bit)
    shared = docs.sparkSession.sparkContext.broadcast(tables)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, shares = (np.unpackbits(table).view(bool) for table in shared.value)

        def rows(name, words):
            totals = Counter({"": words.total()})
            for word, n in words.items():
                term = word.lower()
                if wanted[_bit(term)]:
                    totals[term] += n
            columns = [pa.array([name] * len(totals), pa.binary()), pa.array(list(totals), pa.string()), pa.array(list(totals.values()), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["text_id", "term", "n"])

        for batch in batches:
            words: Counter[str] = Counter()
            seen = set()
            for text in batch["text"]:
                text = text.as_py() or ""
                name = text_id(text)
                if not shares[_bit(name)]:
                    words.update(TERM.findall(text))
                elif name not in seen:
                    seen.add(name)
                    yield rows(name, Counter(TERM.findall(text)))
            yield rows(None, words)

    found = docs.select("text").mapInArrow(count, "text_id binary, term string, n long")
    once = F.when(F.col("text_id").isNull(), F.sum("n")).otherwise(F.max("n"))
    return found.groupBy("text_id", "term").agg(once.alias("n")).groupBy("term").agg(F.sum("n").alias("n"))


def disclosing_terms(
    docs: DataFrame, contexts: DataFrame, copied: DataFrame, generalise: float = GENERALISE, confidence: float = CONFIDENCE
) -> DataFrame:
    """(kind, term, disclosure) of the terms that give away that personal data of the kind is near.

    Of all words of the corpus, a share p(c) lies near data of kind c; its information is
    -log p(c). A term's pointwise mutual information with the kind, log p(c|t) / p(c), is the
    part of that which the term gives away. Disclosure is the ratio of the two: 1 for a term
    that occurs only near such data, 0 for one that occurs there as often as anywhere.

    For p(c|t) stands the lower Wilson bound of what was counted, so a term of any number of
    occurrences can be listed, but a rare one only if it is exclusive. All counts are over
    distinct texts: copies of a text (``copied`` has the text_id of those) add nothing.
    """
    places = contexts.select("text_id", "kind", "term", "start", "end").distinct()
    near = keep(places.groupBy("kind", "term").agg(F.count(F.lit(1)).alias("near")), "disclosure-near")
    counts = keep(term_counts(docs, near, copied), "disclosure-counts")
    every = counts.filter("term = ''").select("n").scalar()
    kinds = near.groupBy("kind").agg((F.sum("near") / every).alias("_share"))
    n, share, square = F.col("n"), F.col("_share"), confidence**2
    seen = F.least(F.col("near") / n, F.lit(1.0))
    error = F.sqrt(seen * (1 - seen) / n + square / (4 * n * n))
    known = (seen + square / (2 * n) - confidence * error) / (1 + square / n)
    # One row per kind of personal data.
    rated = near.join(counts, "term").join(F.broadcast(kinds), "kind")
    rated = rated.withColumn("disclosure", F.log(known / share) / -F.log(share))
    return rated.filter(F.col("disclosure") >= generalise).select("kind", "term", "disclosure")


def find(docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE, confidence: float = CONFIDENCE) -> DataFrame:
    """``doc_id, counts, base, spans`` of every row of ``docs`` (doc_id, text).

    ``counts`` numbers the personal data per kind of ``KINDS``; ``base`` lists it as
    kind:start:end, by kind and start, comma-joined; ``spans`` goes on with the disclosing terms
    near it, as ``term`` (to be generalised) or ``removed``. A term is listed only near data of the
    kind that it discloses, so texts without personal data stay as they are.

    Counts cover all words of all distinct texts. Null and empty texts have no spans. Null and
    repeated doc_ids are kept, a row for each row. An empty table gives no rows. Other columns
    are ignored.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = keep(rows.mapInArrow(_scan, FOUND), "disclosure-found")
    contexts = found.select("_row", "text_id", F.explode("contexts").alias("c")).select("_row", "text_id", "c.*")
    copied = found.groupBy("text_id").agg(F.count(F.lit(1)).alias("_copies")).filter("_copies > 1")
    terms = keep(disclosing_terms(docs, contexts, copied, generalise, confidence), "disclosure-terms")
    label = F.when(F.col("disclosure") >= remove, "removed").otherwise("term")
    # A place near data of two kinds is listed once.
    marks = contexts.join(terms, ["kind", "term"]).groupBy("_row", "start", "end").agg(F.max(F.struct("disclosure", label.alias("label"))).alias("_m"))
    marks = keep(marks.select("_row", F.struct(F.col("_m.label").alias("label"), "start", "end").alias("m")), "disclosure-marks")
    listed = marks.groupBy("_row").agg(F.array_sort(F.collect_list("m")).alias("_marks"))
    text = F.transform("_marks", lambda m: F.concat_ws(":", m["label"], m["start"].cast("string"), m["end"].cast("string")))
    added = F.when(F.col("_marks").isNotNull(), F.array_join(text, ","))
    spans = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), added)
    return found.join(keep(listed, "disclosure-listed"), "_row", "left").select("doc_id", "counts", "base", spans.alias("spans"))


def sanitise(text: str, spans: str) -> str:
    """The text with its spans replaced: data by its kind, terms by TERM, removed ones by nothing.

    Where spans overlap, the one that starts first (then the longer) is replaced.
    """
    listed = sorted((int(start), -int(end), kind) for kind, start, end in (span.split(":") for span in spans.split(",") if span))
    out, at = [], 0
    for start, end, kind in listed:
        if start >= at:
            out += [text[at:start], "" if kind == "removed" else f"<{kind.upper()}>"]
            at = -end
    return "".join([*out, text[at:]])


def base_digest(base):
    """SHA-256 of the listed base spans, in lower-case hex."""
    return F.sha2(base.cast("binary"), 256)


def digest_of(text: str) -> str:
    """The same for one text, apart from Spark."""
    spans = base_spans(text)
    listed = ",".join(f"{kind}:{start}:{end}" for kind in KINDS for start, end in spans[kind])
    return hashlib.sha256(listed.encode()).hexdigest()
