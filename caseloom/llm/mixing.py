"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm.tables import digits_for, keep, positions, running

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)


def targets(sizes: DataFrame, total, max_epochs: int) -> DataFrame:
    """Adds ``target`` to (source_size, _weight): water-filling up to ``max_epochs`` times the size.

    Every round clamps the sources whose share of what is left exceeds their cap and shares the
    rest by weight again, until no share exceeds its cap. A round is one aggregate over the
    sources; what comes to the driver is a single row.
    """
    cap = F.col("source_size") * max_epochs
    # Shares only grow from round to round, so the clamped are those of the last level passed.
    level: tuple[float, int] | None = None
    while True:
        clamped = F.lit(False) if level is None else cap <= F.lit(level[0]) * F.col("_weight") / F.lit(level[1])
        full, weight, count = sizes.agg(
            F.sum(F.when(clamped, cap).otherwise(0)), F.sum(F.when(clamped, 0).otherwise(F.col("_weight"))), F.sum(clamped.cast("int"))
        ).first()
        if not weight:
            return sizes.withColumn("target", cap.cast("double"))
        left = total - full
        share = F.lit(float(left)) * F.col("_weight") / F.lit(int(weight))
        over = sizes.filter(~clamped & (share > cap)).limit(1).count()
        if not over:
            return sizes.withColumn("target", F.when(clamped, cap.cast("double")).otherwise(share))
        level = (float(left), int(weight))


def _words(seed: int) -> list:
    """Number, size, source and place in the seeded order of a document."""
    return [
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("_source"),
        F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string")).cast("binary")).alias("_order"),
    ]


def _placed(docs: DataFrame, weights: Sequence[int], share: float, max_epochs: int, seed: int) -> DataFrame:
    """The documents' words with the target of their source, ``_whole`` epochs and ``_more`` for one more."""
    words = keep(docs.select(*_words(seed)), "mix-words")
    sizes = words.groupBy("_source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    ranked = positions(sizes, [F.col("_source") == "", F.col("_source")], "_nth", "mix-sources")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_nth") % len(weights) + 1).cast("int"))
    ranked = keep(ranked.withColumn("_weight", weight), "mix-weights")
    rows, total = ranked.agg(F.sum("_rows"), F.sum("source_size")).first()
    aims = targets(ranked, share * (total or 0), max_epochs).select("_source", "source_size", "target")
    told = keep(words.join(aims, "_source"), "mix-told")
    before = running(told, ["_source"], ["_order", "doc_id", "size"], "size", "_before", digits_for(rows or 0))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    extra = F.col("target") - F.col("_whole") * F.col("source_size")
    once_more = (F.col("size") > 0) & (F.col("_before") + F.col("size") / 2 <= extra)
    return before.withColumn("_whole", whole.cast("long")).withColumn("_more", once_more)


def mix(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.5, max_epochs: int = 2, seed: int = 7
) -> DataFrame:
    """``doc_id, size, source_size, target, copies, taken`` of every row of ``docs`` (doc_id, text, source).

    ``size`` counts words. Sources in code point order, null last, weigh ``weights``, repeating;
    together they get ``share`` of all words, none more than ``max_epochs`` times its own.
    A source at ``e`` epochs takes each of its documents floor(e) times, and once more those
    that come first in a seeded order, up to the one whose middle word reaches the target.
    So a source's words miss its target by half a document at most, no document is taken more
    than ``max_epochs`` times, and the same rows give the same mix at any partitioning.

    Nulls: a null source is a source of its own, the last; a null text has size 0; null doc_ids
    come first in the order. Rows with equal doc_id are ordered by size; wholly equal rows are
    interchangeable. A source without words has target 0. An empty table gives no rows. Other
    columns are ignored.
    """
    placed = _placed(docs, weights, share, max_epochs, seed)
    copies = F.col("_whole") + F.col("_more").cast("long")
    return placed.withColumn("copies", copies).select(
        "doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def repeat(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.5, max_epochs: int = 2, seed: int = 7
) -> DataFrame:
    """The rows of ``docs``, all columns, as many times as :func:`mix` takes them.

    Middle words only move on along the seeded order, so what a source takes once more is
    all up to a last document. The mix comes down to one row per source, its whole epochs and
    that last document, and the texts meet these rows where they lie.

    Nulls, empty tables and other columns as for :func:`mix`, except that rows that tie with the
    last document, equal in source, doc_id and size, are all taken once more.
    """
    place = F.struct("_order", "doc_id", "size")
    rules = keep(
        _placed(docs, weights, share, max_epochs, seed)
        .groupBy("_source")
        .agg(F.max("_whole").alias("_whole"), F.max(F.when(F.col("_more"), place)).alias("_last")),
        "mix-rules",
    )
    rows = docs.select(F.struct("*").alias("_row"), *_words(seed)).join(rules, "_source")
    more = (F.col("size") > 0) & (place <= F.col("_last"))
    copies = F.col("_whole") + F.coalesce(more, F.lit(False)).cast("long")
    times = F.explode(F.array_repeat(F.lit(0), copies.cast("int"))).alias("_time")
    return rows.select("_row", times).select("_row.*")
