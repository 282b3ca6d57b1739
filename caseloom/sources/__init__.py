from caseloom.sources.models import load_model, save_model
from caseloom.sources.tables import (
    conform,
    infer_types,
    read_csv,
    read_harmonised,
    read_table,
    write_table,
)

__all__ = [
    "conform",
    "infer_types",
    "load_model",
    "read_csv",
    "read_harmonised",
    "read_table",
    "save_model",
    "write_table",
]
