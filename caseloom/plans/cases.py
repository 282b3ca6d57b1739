"""From raw calls and repair lines to linked cases and suspicion scores."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.functions import (
    at_time,
    bin_fixed,
    floor_days,
    map_values,
    micros_between,
    minutes_between,
    near_contract_edge,
    normalise_time,
    null_if,
    null_if_not_after,
    null_outside,
    numbered_id,
    parse_date,
    row_sum,
    to_flag,
    to_number,
)
from caseloom.functions.clean import as_column, holds
from caseloom.functions.dates import DAY_MICROS
from caseloom.operators.asof import asof_join
from caseloom.operators.dedupe import first_per_key
from caseloom.operators.intervals import point_in_interval
from caseloom.operators.joins import anti, fallback_join, flag_exists
from caseloom.operators.ordered import MAX_GROUP_ROWS, OrderedGroups
from caseloom.operators.quantiles import count_quantile
from caseloom.operators.rows import reorder
from caseloom.operators.skew import Sizes, spread_join
from caseloom.plans.names import CALL_ORDER, FLAGS, REASONS, SERVICES, Calls, Repairs

CALLS, REPAIRS = Calls(), Repairs()

GAP_DAYS = 6
STAY_GAP_DAYS = 7
TOW_TOLERANCE = 7
CALL_TOLERANCE = 3
SWEEPS = {"tow": range(1, 31), "last_call": range(0, 10)}


def is_tow(calls: Calls = CALLS) -> Column:
    """Is the call's outcome a tow?"""
    return holds(as_column(calls.outcome).isin(*calls.tows))


def clean_calls(raw: DataFrame, vehicle_models: DataFrame, source_order: str = "_src") -> DataFrame:
    """Raw calls, all text, to typed and plausible ones with their vehicle model.

    ``source_order`` is a sortable column with the position of a row in its source. Of an
    entity's calls at one moment the first is kept, which covers rows that are equal throughout.
    """
    day = parse_date("Incident Date", ["d/M/yyyy"])
    arrival = normalise_time(null_if("Time Of Arrival", ["0", "00:00"]))
    rows = raw.withColumns(
        {"Time Of Arrival": at_time(day, arrival), "Incident Date": at_time(day, "Time Of Call")}
    )
    rows = first_per_key(rows, ["VIN", "Incident Date"], [source_order])

    dates = {c: parse_date(c) for c in ("Registration Date", "Policy Start Date", "Policy End Date")}
    rows = rows.withColumns({**dates, "Odometer": to_number("Odometer")})
    rows = rows.withColumns(
        {
            "CTA": minutes_between("Incident Date", "Time Of Arrival"),
            "Registration Date": null_outside("Registration Date", 1948, 2023, of=F.year("Registration Date")),
            "Policy Start Date": null_outside("Policy Start Date", lo=dt.date(2002, 1, 1)),
            "Policy End Date": null_outside("Policy End Date", hi=dt.date(2027, 1, 1), hi_inclusive=False),
            "Reason Of Call": map_values("Reason Of Call", REASONS),
            "Odometer": null_outside("Odometer", 50, 260_000),
            "Rental Car Days": to_number("Replacement Car Days"),
            **{c: to_flag(c) for c in SERVICES},
        }
    )
    rows = rows.withColumn("Policy End Date", null_if_not_after("Policy End Date", "Policy Start Date"))
    rows = rows.withColumns(
        {
            "Policy Duration": F.datediff(F.col("Policy End Date"), F.col("Policy Start Date")),
            "Odometer_Binned": bin_fixed("Odometer", 0, 240_000, 20_000),
        }
    )
    rows = fallback_join(
        rows,
        vehicle_models,
        "Btype",
        "Bestelltypschlüssel",
        "Typ aus VIN",
        "Baureihe",
        ["Baureihe", "Modellreihe"],
        sizes_from=raw,
    )
    rows = rows.drop("Typ aus VIN", "Btype", "Monat", "Fault Description Customer", "Replacement Car Days", "Time Of Call")
    return reorder(rows, CALL_ORDER)


def add_cases(
    df: DataFrame,
    calls: Calls = CALLS,
    gap_days: int = GAP_DAYS,
    repeat_days: int = 14,
    max_group_rows: int = MAX_GROUP_ROWS,
    sizes_from: DataFrame | None = None,
) -> DataFrame:
    """Add case id and number, the gap to the call before, and the repeated-tow flag.

    All of them look at the entity's previous call, so one scan serves them.
    """
    scan = OrderedGroups(
        df, [calls.entity], [calls.at, *calls.tie], max_group_rows=max_group_rows, sizes_from=sizes_from
    ).previous(_before=calls.at, _ended=is_tow(calls))
    scan = scan.with_columns(**{calls.gap: floor_days("_before", calls.at)})
    gap = as_column(calls.gap)
    starts = gap.isNull() | (gap > gap_days) | holds(F.col("_ended"))
    scan = scan.running_sum("case_number_in_entity", starts.cast("bigint"))
    scan = scan.with_columns(
        **{
            calls.case_id: numbered_id(calls.entity, "case_number_in_entity"),
            "SuS_Breakdown": holds(gap <= repeat_days) & is_tow(calls),
        }
    )
    return scan.result().drop("_before", "_ended")


def build_stays(
    lines: DataFrame,
    ends: DataFrame,
    repairs: Repairs = REPAIRS,
    line_order: Sequence[str] | None = None,
    gap_days: int = STAY_GAP_DAYS,
    max_group_rows: int = MAX_GROUP_ROWS,
    sizes_from: DataFrame | Sizes | None = None,
    opens: str | None = None,
    within: Sequence[str] = (),
) -> DataFrame:
    """Repair lines with their end, length in days and stay.

    Of lines with the same id the first in ``line_order`` counts; lines without an end are
    dropped. ``sizes_from`` may name something cheaper than ``lines`` to learn the sizes of entities from.
    ``opens`` names a boolean column to add: is this the first line of its stay?
    ``within`` names columns of both tables that a line's id determines and that are never missing; tables dealt by them are not shuffled by id.
    """
    keys = [*within, repairs.line]
    unique = first_per_key(lines, keys, list(line_order or [repairs.start, *repairs.tie]))
    joined = unique.join(ends.select(*keys, repairs.end), keys)
    order = [repairs.start, *repairs.tie]
    sizes = lines if sizes_from is None else sizes_from
    scan = OrderedGroups(joined, [repairs.entity], order, max_group_rows=max_group_rows, sizes_from=sizes)
    scan = scan.previous(_before=repairs.start, _same=repairs.stay_number)
    goes_on = holds(as_column(repairs.stay_number) == F.col("_same")) | holds(
        floor_days("_before", repairs.start) <= gap_days
    )
    scan = scan.running_sum("_number", (~goes_on).cast("bigint"))
    if opens is not None:
        scan = scan.with_columns(**{opens: ~goes_on})
    days = F.datediff(as_column(repairs.end), as_column(repairs.start))
    scan = scan.with_columns(**{repairs.days: days, repairs.stay_id: numbered_id(repairs.entity, "_number")})
    return scan.result().drop("_before", "_same", "_number")


def link_cases(
    df: DataFrame,
    stays: DataFrame,
    calls: Calls = CALLS,
    repairs: Repairs = REPAIRS,
    tow_tolerance: int = TOW_TOLERANCE,
    call_tolerance: int = CALL_TOLERANCE,
    max_group_rows: int = MAX_GROUP_ROWS,
    opens: str | None = None,
) -> DataFrame:
    """All calls, each with the first line of the stay it led to, if any.

    Tows look for the next stay of their entity up to ``tow_tolerance`` days ahead. A case
    without a tow looks up to ``call_tolerance`` days ahead from its last call. Other calls
    stay unlinked. ``link_part`` says which of these a call is, ``link_days`` how far ahead
    the next stay starts, whatever the tolerance. ``df`` comes from :func:`add_cases`. ``opens`` is
    the column of :func:`build_stays` that marks first lines, if the stays have it; else they are looked for.
    """
    # Seen backwards, a call closes its case if the case of the call after it is another one.
    # A tow ends its case, so a case contains a tow exactly if its closing call is one.
    scan = OrderedGroups(
        df, [calls.entity], [calls.at, *calls.tie], descending=True, max_group_rows=max_group_rows
    ).previous(_next_case=calls.case_id)
    closes = ~holds(F.col("_next_case") == as_column(calls.case_id))
    placed = scan.last_known("_closed_by_tow", F.when(closes, is_tow(calls))).result()
    part = (
        F.when(is_tow(calls), "tow")
        .when(F.col("_closed_by_tow"), "in_tow_case")
        .when(closes & as_column(calls.case_id).isNotNull(), "last_call")
        .otherwise("earlier_call")
    )
    placed = placed.withColumn("link_part", part).withColumn("_day", F.to_date(as_column(calls.at)).cast("timestamp_ntz"))
    placed = placed.drop("_next_case", "_closed_by_tow")

    known = stays.filter(F.col(repairs.stay_id).isNotNull())
    if opens is None:
        first_lines = first_per_key(known, [repairs.stay_id], [repairs.start, *repairs.tie])
    else:
        first_lines = known.filter(F.col(opens)).drop(opens)
    # A line may share names with the call, apart from the entity.
    right = first_lines.select(
        as_column(repairs.entity).alias(calls.entity),
        *[as_column(c) for c in first_lines.columns if c != repairs.entity],
    )
    joined = asof_join(
        placed,
        right,
        "_day",
        repairs.start,
        [calls.entity],
        right_order=list(repairs.tie),
        max_group_rows=max_group_rows,
        # An entity may be hot by its stays alone.
        sizes_from=df.select(calls.entity).unionByName(stays.select(as_column(repairs.entity).alias(calls.entity))),
    )
    days = F.floor(micros_between("_day", repairs.start) / F.lit(DAY_MICROS)).cast("bigint")
    joined = joined.withColumn("link_days", F.when(F.col("link_part").isin("tow", "last_call"), days))
    reach = F.when(F.col("link_part") == "tow", tow_tolerance).otherwise(call_tolerance)
    near = holds(F.col("link_days") <= reach)
    added = [c for c in right.columns if c != calls.entity]
    return joined.select(
        *[as_column(c) for c in df.columns],
        "link_part",
        "link_days",
        *[F.when(near, as_column(c)).alias(c) for c in added],
    )


def link_sweep(linked: DataFrame, tolerances: Mapping[str, Sequence[int]]) -> DataFrame:
    """Links there would be for each part and tolerance in days: ``part, tolerance_days, matches``."""
    wanted = [(part, t) for part, days in tolerances.items() for t in days]
    counts = linked.agg(
        *[
            F.count_if((F.col("link_part") == part) & (F.col("link_days") <= t)).alias(f"n{i}")
            for i, (part, t) in enumerate(wanted)
        ]
    )
    rows = F.array(
        *[
            F.struct(F.lit(part).alias("part"), F.lit(t).alias("tolerance_days"), F.col(f"n{i}").alias("matches"))
            for i, (part, t) in enumerate(wanted)
        ]
    )
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def case_stay_bridge(linked: DataFrame, calls: Calls = CALLS, repairs: Repairs = REPAIRS) -> DataFrame:
    """Case and stay ids of linked calls."""
    return linked.select(calls.case_id, repairs.stay_id).dropna()


def flag_linked(
    df: DataFrame,
    linked: DataFrame,
    calls: Calls = CALLS,
    repairs: Repairs = REPAIRS,
    key: str | None = None,
    sizes_from: DataFrame | None = None,
) -> DataFrame:
    """Add ``Merged``, whether the call's case number was linked, and the unlinked-tow flag."""
    key = key or calls.case_number
    hits = linked.filter(as_column(repairs.line).isNotNull()).select(as_column(key))
    flagged = flag_exists(df, hits, key, "Merged", sizes_from=sizes_from)
    return flagged.withColumn("SuS_Merged", is_tow(calls) & ~F.col("Merged"))


def per_entity_measures(df: DataFrame, calls: Calls = CALLS) -> DataFrame:
    """Calls, services, cases, calls with a rental car, and tows per entity, in one aggregate."""
    services = row_sum(calls.services) if calls.services else F.lit(0).cast("bigint")
    return (
        df.filter(as_column(calls.entity).isNotNull())
        .groupBy(calls.entity)
        .agg(
            F.count(F.lit(1)).alias("_calls"),
            F.sum(services).alias("_services"),
            # Case numbers of an entity run from 1 without gaps.
            F.max("case_number_in_entity").alias("_cases"),
            F.count_if(as_column(calls.rental_days) > 0).alias("_rentals"),
            F.count_if(is_tow(calls)).alias("_tows"),
        )
    )


def flag_entities(df: DataFrame, calls: Calls = CALLS) -> DataFrame:
    """Add the five flags that compare an entity's counts with a quantile over entities."""
    measures = per_entity_measures(df, calls)
    points = {
        "_calls": (F.col("_calls"), 0.80),
        "_services": (F.col("_services"), 0.90),
        "_cases": (F.col("_cases"), 0.75),
        # Only entities that have any take part in these two.
        "_rentals": (F.when(F.col("_rentals") > 0, F.col("_rentals")), 0.75),
        "_tows": (F.when(F.col("_tows") > 0, F.col("_tows")), 0.75),
    }
    # The counts sum to at most a few times the rows, so few distinct ones can exist and
    # percentile's buffer of distinct values stays small.
    limits = measures.agg(
        F.struct(*[F.round(F.percentile(value, F.lit(p)), 9).alias(n) for n, (value, p) in points.items()])
    ).scalar()
    flagged = measures.select(
        calls.entity,
        holds(F.col("_calls") >= limits["_calls"]).alias("SuS_Anruferzahl"),
        holds(F.col("_services") >= limits["_services"]).alias("SuS_Services_Offered"),
        holds(F.col("_cases") > limits["_cases"]).alias("SuS_AnrufeInFall"),
        holds(F.col("_rentals") > limits["_rentals"]).alias("SuS_Rental_Car"),
        ((F.col("_tows") > 0) & holds(F.col("_tows") >= limits["_tows"])).alias("SuS_Abschleppungen"),
    )
    names = [c for c in flagged.columns if c != calls.entity]
    joined = spread_join(df, flagged, [calls.entity])
    return joined.select(*[as_column(c) for c in df.columns], *[F.coalesce(n, F.lit(False)).alias(n) for n in names])


def flag_in_workshop(
    df: DataFrame,
    stays: DataFrame,
    calls: Calls = CALLS,
    repairs: Repairs = REPAIRS,
    sizes_from: DataFrame | None = None,
) -> DataFrame:
    """Flag calls made while the vehicle was in the workshop, with the repair's dates."""
    renamed = stays.select(as_column(repairs.entity).alias(calls.entity), repairs.start, repairs.end)
    return point_in_interval(
        df,
        renamed,
        calls.entity,
        calls.at,
        repairs.start,
        repairs.end,
        1,
        "SuS_Call_while_car_in_workshop",
        sizes_from=sizes_from,
    )


def score_calls(
    df: DataFrame,
    linked: DataFrame,
    stays: DataFrame,
    calls: Calls = CALLS,
    repairs: Repairs = REPAIRS,
    key: str | None = None,
) -> DataFrame:
    """Add the nine flags, how many are set, and their share as score.

    ``df`` comes from :func:`add_cases`.
    """
    flagged = flag_entities(df, calls).withColumn(
        "SuS_Vertragszeitraum", near_contract_edge(calls.at, calls.policy_start, calls.policy_end)
    )
    # Each join reads the sizes of its groups from the table, not from the joins before it.
    flagged = flag_linked(flagged, linked, calls, repairs, key, sizes_from=df)
    flagged = flag_in_workshop(flagged, stays, calls, repairs, sizes_from=df)
    return flagged.withColumn("flags_set", row_sum(FLAGS)).withColumn("SuS-O-Meter", F.col("flags_set") / len(FLAGS))


def mark_suspects(scored: DataFrame, p: float = 0.90) -> DataFrame:
    """Add ``Suspect`` for rows whose score reaches the p-quantile.

    The quantile is a second pass over ``scored``, which had better be a written table.
    """
    # Counts of flags instead of shares: ninths would not compare exactly.
    limit = F.round(count_quantile(scored, "flags_set", p), 9)
    return scored.withColumn("Suspect", F.col("flags_set") >= limit)


def unlinked_tows(df: DataFrame, bridge: DataFrame, calls: Calls = CALLS) -> DataFrame:
    """Tows whose case was linked to no stay."""
    tows = df.filter(is_tow(calls)).select(*[as_column(c) for c in (calls.case_id, calls.entity, calls.at, calls.outcome)])
    return anti(tows, bridge, calls.case_id)


def flag_stays(
    stays: DataFrame, unlinked: DataFrame, bridge: DataFrame, calls: Calls = CALLS, repairs: Repairs = REPAIRS
) -> DataFrame:
    """Add to stays whether their id is that of an unlinked tow's case, and whether no case led to them.

    Case and stay ids are both an entity with a running number; the first flag compares
    them as they are, the second goes through the bridge.
    """
    flagged = flag_exists(stays, unlinked, repairs.stay_id, "Unmerged_Towing_STowing_SUS", calls.case_id, sizes_from=stays)
    # The second join reads the sizes of its groups from the table, not from the join before it.
    flagged = flag_exists(flagged, bridge, repairs.stay_id, "_linked", sizes_from=stays)
    return flagged.withColumn("Without_Case", ~F.col("_linked")).drop("_linked")
