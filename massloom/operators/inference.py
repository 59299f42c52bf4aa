"""Inference of small dense networks whose weights are a table; they are trained elsewhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers of a model that may go to every worker: 128 MB of doubles.
MOST_WEIGHTS = 1 << 24


def load_layers(layers: DataFrame, most: int = MOST_WEIGHTS) -> list[tuple[np.ndarray, np.ndarray]]:
    """(weights, bias) of each layer of a table (layer, unit, weights, bias), in order; ValueError for more than most numbers.

    Units of a layer are numbered from 0 without gaps, and a layer takes as many inputs as the one before has units.
    """
    size = layers.agg(F.coalesce(F.sum(F.size("weights")), F.lit(0))).first()[0]
    if not 0 < size <= most:
        raise ValueError(f"a model of {size} weights; at most {most} go to every worker")
    rows: dict[int, list] = {}
    for r in layers.orderBy("layer", "unit").collect():  # most numbers at most
        rows.setdefault(r["layer"], []).append(r)
    out, width = [], None
    for layer, units in sorted(rows.items()):
        lengths = {len(u["weights"]) for u in units}
        if [u["unit"] for u in units] != list(range(len(units))) or len(lengths) != 1 or lengths != {width or next(iter(lengths))}:
            raise ValueError(f"layer {layer}: units or widths don't fit")
        out.append((np.array([u["weights"] for u in units], dtype="float64"), np.array([u["bias"] for u in units], dtype="float64")))
        width = len(units)
    return out


def predict(rows: DataFrame, vector: str, layers: list[tuple[np.ndarray, np.ndarray]], name: str = "chances") -> DataFrame:
    """rows with name: the last layer's units of each row's vector; rectified between layers, logistic at the end.

    Weights are broadcast once and multiplied a batch at a time. A null vector, one of another length or with a value that
    isn't finite has a null result.
    """
    model = rows.sparkSession.sparkContext.broadcast(layers)

    @F.pandas_udf("array<double>")
    def forward(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights = model.value
        width = weights[0][0].shape[1]
        for batch in batches:
            good = [k for k, v in enumerate(batch) if v is not None and len(v) == width and np.isfinite(np.asarray(v, dtype="float64")).all()]
            out: list = [None] * len(batch)
            if good:
                x = np.stack([np.asarray(batch.iloc[k], dtype="float64") for k in good])
                for w, b in weights[:-1]:
                    x = np.maximum(x @ w.T + b, 0.0)
                x = 1 / (1 + np.exp(-(x @ weights[-1][0].T + weights[-1][1])))
                for k, y in zip(good, x, strict=True):
                    out[k] = y
            yield pd.Series(out)

    return rows.withColumn(name, forward(F.col(vector).cast("array<double>")))
