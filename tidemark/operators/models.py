"""Hooks for caller-supplied Python models: loaded once per worker, fed by Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

Loader = Callable[[], Callable[[Sequence[str]], Sequence]]


def _batched(load: Loader, kind: str):
    @pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            yield pd.Series(list(model(texts.fillna("").tolist())), index=texts.index)
    return run


def score_text(df: DataFrame, text: str, load: Loader, out: str = "score") -> DataFrame:
    """A number per text from a model that ``load()`` returns."""
    return df.withColumn(out, _batched(load, "double")(F.col(text)))


def embed_text(df: DataFrame, text: str, load: Loader, out: str = "embedding") -> DataFrame:
    """A vector per text from a model that ``load()`` returns."""
    return df.withColumn(out, _batched(load, "array<float>")(F.col(text)))


def per_series(df: DataFrame, key: str | Sequence[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A Python function on each key's (calendar-bounded) series."""
    return df.groupBy(*([key] if isinstance(key, str) else key)).applyInPandas(fn, schema)
