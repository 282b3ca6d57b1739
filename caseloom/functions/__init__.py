from caseloom.functions.clean import (
    bin_fixed,
    fill_from,
    map_values,
    null_if,
    null_if_not_after,
    null_outside,
    row_mean,
    row_sum,
    to_flag,
    to_number,
)
from caseloom.functions.dates import (
    at_time,
    floor_days,
    micros_between,
    minutes_between,
    near_contract_edge,
    normalise_time,
    parse_date,
)
from caseloom.functions.text import numbered_id, tokens

__all__ = [
    "at_time",
    "bin_fixed",
    "fill_from",
    "floor_days",
    "map_values",
    "micros_between",
    "minutes_between",
    "near_contract_edge",
    "normalise_time",
    "null_if",
    "null_if_not_after",
    "null_outside",
    "numbered_id",
    "parse_date",
    "row_mean",
    "row_sum",
    "to_flag",
    "to_number",
    "tokens",
]
