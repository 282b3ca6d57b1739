"""Language identification by multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Lengths of the n-grams, hash buckets per length, and the count added to each.
SIZES, BUCKETS, SMOOTHING = (1, 2, 3), 1 << 14, 0.5
#: Characters processed at a time; bounds the memory for batches and for very long texts.
CHUNK = 1 << 19
UNDETERMINED = "und"


def pieces(texts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, code point) arrays of the lower-cased texts, at most about ``CHUNK`` long.

    A long text is cut into pieces that overlap so that no n-gram is lost or counted twice.
    """
    numbers, parts, total = [], [], 0
    for number, text in enumerate(texts):
        text = (text or "").lower()
        for start in range(0, max(1, len(text)), CHUNK):
            part = text[start : start + CHUNK + max(SIZES) - 1]
            numbers.append(number)
            parts.append(part)
            total += len(part)
            if total >= CHUNK:
                yield _codes(numbers, parts)
                numbers, parts, total = [], [], 0
    if parts:
        yield _codes(numbers, parts)


def _codes(numbers, parts):
    lengths = [len(part) for part in parts]
    codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    # Pieces are told apart, not texts: the overlap of two pieces of a text is no n-gram.
    piece = np.repeat(np.arange(len(parts)), lengths)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return np.array(numbers)[piece], piece, place, codes


def grams(number, piece, place, codes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, bucket) of every n-gram, one pair of arrays per length."""
    for order, size in enumerate(SIZES):
        count = len(codes) - size + 1
        if count <= 0:
            continue
        mixed = np.full(count, 0x811C9DC5 + order, np.uint32)
        for at in range(size):
            mixed = (mixed ^ codes[at : at + count]) * np.uint32(0x9E3779B1)
            mixed ^= mixed >> np.uint32(15)
        bucket = (mixed & np.uint32(BUCKETS - 1)).astype(np.int64) + order * BUCKETS
        # Those that start in the overlap belong to the next piece of the text.
        own = (piece[:count] == piece[size - 1 :]) & (place[:count] < CHUNK)
        yield number[:count][own], bucket[own]


class Model:
    """Learned languages, their log prior, and log probabilities of the buckets per language."""

    def __init__(self, languages: list[str], prior: np.ndarray, matrix: np.ndarray):
        self.languages, self.prior, self.matrix = languages, prior, matrix

    def predict(self, texts) -> tuple[list[str], list[float]]:
        """Most likely language and its posterior probability per text; ties to the first by name."""
        texts = list(texts)
        sums = np.tile(self.prior, (len(texts), 1)).astype(float)
        for piece in pieces(texts):
            for number, bucket in grams(*piece):
                for column in range(len(self.languages)):
                    sums[:, column] += np.bincount(number, self.matrix[column][bucket], len(texts))
        lettered = np.array([text is not None and any(map(str.isalpha, text)) for text in texts], bool)
        if not self.languages:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        best = sums.argmax(axis=1) if len(texts) else np.empty(0, int)
        odds = np.exp(sums - sums.max(axis=1, keepdims=True)) if len(texts) else sums
        scores = np.where(lettered, 1 / odds.sum(axis=1), 0.0)
        names = [self.languages[b] if known else UNDETERMINED for b, known in zip(best, lettered)]
        return names, scores.tolist()


def train(labelled: DataFrame) -> Model:
    """Counts hashed n-grams of ``labelled`` (text, lang) per language, over all rows.

    Every task counts into one array per language; the driver gets the total per language and
    bucket, so languages times buckets numbers, however many rows there are.
    """
    rows = labelled.select("text", "lang").filter("lang IS NOT NULL AND text IS NOT NULL")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, of in batch.groupby("lang"):
                total = totals.setdefault(lang, np.zeros(len(SIZES) * BUCKETS + 1, np.int64))
                total[-1] += len(of)
                for piece in pieces(of["text"]):
                    for _, bucket in grams(*piece):
                        total[:-1] += np.bincount(bucket, minlength=len(total) - 1)
        for lang, total in totals.items():
            bucket = np.flatnonzero(total)
            yield pd.DataFrame({"lang": lang, "bucket": bucket, "n": total[bucket]})

    counted = rows.mapInPandas(count, "lang string, bucket int, n long")
    table = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(table["lang"].unique())
    counts = np.zeros((len(languages), len(SIZES) * BUCKETS + 1))
    counts[table["lang"].map({lang: i for i, lang in enumerate(languages)}).to_numpy(int), table["bucket"].to_numpy(int)] = table["n"]
    prior = np.log(counts[:, -1] / max(1, counts[:, -1].sum())) if languages else np.empty(0)
    smooth = (counts[:, :-1] + SMOOTHING).reshape(len(languages), len(SIZES), BUCKETS)
    matrix = np.log(smooth / smooth.sum(axis=2, keepdims=True)).reshape(len(languages), len(SIZES) * BUCKETS)
    return Model(languages, prior, matrix)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """The rows with ``lang_pred`` and ``score``, read from column ``text``.

    The matrix, languages times buckets, goes to every executor. ``lang_pred`` is a learned
    language, or ``und`` (score 0) where the text is null or has no letter, or nothing was learned.
    Every other column passes through; columns named ``lang_pred`` or ``score`` are replaced.
    """
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.prior, model.matrix))
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = Model(*shared.value)
        for batch in batches:
            names, scores = local.predict(batch["text"].to_pylist())
            columns = [*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(score, T.StructType([*docs.schema.fields, *added]))
