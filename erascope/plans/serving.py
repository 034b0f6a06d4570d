"""Batch prediction for the live era and for user models."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from erascope import schema as S
from erascope.operators.linear import require_trained

LIVE_SCHEMA = "id string, prediction double"
MAX_MODEL_BYTES = 1 << 30  # what every worker must be able to hold


def predict_function(model, features: Sequence[str]) -> Callable[..., DataFrame]:
    """L14. ``predict(live_features, live_benchmarks=None) -> (id, prediction)``, keyed by id.

    The benchmark frame is accepted and not used.
    """
    require_trained(model)

    def predict(live_features: DataFrame, live_benchmarks: DataFrame | None = None) -> DataFrame:
        scored = model.transform(live_features.select(S.ID, *features))
        return scored.select(S.ID, F.col("prediction").cast("double").alias("prediction"))

    return predict


def live_predictions(panel: DataFrame, model, features: Sequence[str]) -> DataFrame:
    """L14 for a prepared panel: the rows of the live part."""
    return predict_function(model, features)(panel.where(F.col(S.DATA_TYPE) == "live"))


def predict_with(df: DataFrame, model, features: Sequence[str], keep: Sequence[str] = (S.ID,)) -> DataFrame:
    """U2. Apply any picklable object with ``predict(matrix)`` to batches of rows.

    The model is broadcast; its size does not depend on the rows, and one above ``MAX_MODEL_BYTES`` is an error.
    """
    # serialized by value, so that classes defined in a notebook or script work too
    content = cloudpickle.dumps(model)
    if len(content) > MAX_MODEL_BYTES:
        raise ValueError(f"the pickled model has {len(content)} bytes, above MAX_MODEL_BYTES={MAX_MODEL_BYTES}")
    shared = df.sparkSession.sparkContext.broadcast(content)
    names, kept = list(features), list(keep)
    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in kept) + ", prediction double"

    def run(batches):
        import pickle

        scorer = pickle.loads(shared.value)
        for rows in batches:
            values = scorer.predict(rows[names].to_numpy(dtype="float64"))
            yield rows[kept].assign(prediction=values.reshape(-1))

    return df.select(*dict.fromkeys([*kept, *names])).mapInPandas(run, schema)
