"""Where users plug in their own Python: transforms, table functions, model scoring. Per-key work is in ``mergeable``."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def chain(df: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """User transforms, one after another, as one lazy plan."""
    return reduce(lambda acc, step: acc.transform(step), steps, df)


def scalar(fn: Callable[..., pd.Series], returns: str) -> Callable[..., Column]:
    """A vectorised user function of columns, for what has no column form."""
    return F.pandas_udf(fn, returns)


def batch_score(
    df: DataFrame, key: str, features: Sequence[str], load: Callable[[], Callable[[np.ndarray], np.ndarray]], batch: int = 64
) -> DataFrame:
    """(key, y_pred): rows scored in batches by a model that each task loads once."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in frames:
            x = pdf[list(features)].to_numpy(dtype=np.float64)
            parts = [np.asarray(model(x[i:i + batch]), dtype=np.float64) for i in range(0, len(x), batch)]
            yield pd.DataFrame({key: pdf[key], "y_pred": np.concatenate(parts) if parts else np.empty(0)})

    return df.select(key, *features).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, y_pred double")


class CoveringTiles:
    """Table function: the map tiles a box touches at a zoom."""

    def eval(self, min_lon: float, min_lat: float, max_lon: float, max_lat: float, zoom: int):
        import math

        n = 1 << zoom

        def x(lon):
            return min(max(int(math.floor((lon + 180.0) / 360.0 * n)), 0), n - 1)

        def y(lat):
            phi = math.radians(max(min(lat, 85.0511287798066), -85.0511287798066))
            return min(max(int(math.floor((1.0 - math.log(math.tan(phi) + 1.0 / math.cos(phi)) / math.pi) / 2.0 * n)), 0), n - 1)

        for i in range(x(min_lon), x(max_lon) + 1):
            for j in range(y(max_lat), y(min_lat) + 1):
                yield (f"{zoom}/{i}/{j}",)


def register_tiles(spark, name: str = "covering_tiles") -> str:
    """Register the table function for SQL (``LATERAL covering_tiles(...)``)."""
    spark.udtf.register(name, F.udtf(CoveringTiles, returnType="tile string"))
    return name
