"""A user's own Python model as a scorer: shipped once, fed Arrow batches of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.core.broadcast import Broadcast
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.operators.models import Scorer

# The model a worker process has unpacked last, by the digest of its pickle.
_MODELS: dict[str, Callable] = {}
# Bytes of features that the model gets in one call.
CALL_BYTES = 8 << 20


def _unpacked(name: str, shared: Broadcast) -> Callable:
    if name not in _MODELS:
        _MODELS.clear()
        _MODELS[name] = cloudpickle.loads(shared.value)
    return _MODELS[name]


def python_scorer(
    spark: SparkSession, predict: Callable[[np.ndarray], np.ndarray], width: int, classes: int = 2, features: str = "features",
    call_bytes: int = CALL_BYTES,
) -> Scorer:
    """Scorer around ``predict``, which maps a (rows, width) matrix to (rows, classes) probabilities.

    ``classes`` 0 is a regression: ``predict`` then gives one number per row.  The pickled
    model is a broadcast that every worker unpacks once.  A call never gets more than
    ``call_bytes`` of features and never zero rows.  Rows keep their order; what the model
    raises fails the task with the number of rows it was given.
    """
    # pickled here, so that a model that cannot travel fails at once
    packed = cloudpickle.dumps(predict)
    name, shared = blake2b(packed).hexdigest(), spark.sparkContext.broadcast(packed)
    step = max(1, call_bytes // (8 * max(width, 1)))

    def called(x: np.ndarray) -> np.ndarray:
        try:
            out = np.asarray(_unpacked(name, shared)(x), float)
        except Exception as e:
            raise RuntimeError(f"the model failed on {len(x)} rows: {type(e).__name__}: {e}") from e
        want = (len(x), classes) if classes else (len(x),)
        if out.shape != want:
            raise ValueError(f"the model returned shape {out.shape} for {len(x)} rows, {want} was expected")
        return out

    @F.pandas_udf("array<double>")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            parts = []
            for at in range(0, len(rows), step):
                parts.append(called(np.stack(rows.iloc[at:at + step].to_numpy()).reshape(-1, width).astype(float)))
            values = np.concatenate(parts).reshape(len(rows), -1) if parts else np.empty((0, 1))
            yield pd.Series(list(values))

    def score(df: DataFrame) -> DataFrame:
        out = df.withColumn("_p", predicted(vector_to_array(F.col(features))))
        if not classes:
            return out.withColumn("prediction", F.col("_p")[0]).drop("_p")
        best = F.array_position("_p", F.array_max("_p")) - 1
        return out.withColumn("prediction", best.cast("double")).withColumnRenamed("_p", "prob")

    score.model = predict
    return score
