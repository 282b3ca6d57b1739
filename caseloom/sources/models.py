"""Saving and loading fitted Spark ML pipelines."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel


def save_model(model: PipelineModel, path: str) -> str:
    """Write a fitted pipeline, replacing an earlier one."""
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    """Read a fitted pipeline; a missing one is an error that names the path."""
    try:
        return PipelineModel.load(path)
    except (AnalysisException, Py4JJavaError) as problem:
        raise FileNotFoundError(f"no fitted model at {path}") from problem
