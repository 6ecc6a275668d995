"""Language models as plug points: a batch model takes a list of prompts and gives as many answers."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BatchModel = Callable[[list[str]], list[str]]


def each(model: Callable[[str], str]) -> BatchModel:
    """A batch model from one that takes a single prompt."""
    return lambda prompts: [model(p) for p in prompts]


def answers(model: BatchModel, prompt: Column) -> Column:
    """Answers to the prompts; the model is called once for each Arrow batch."""

    @F.pandas_udf("string")
    def run(prompts: pd.Series) -> pd.Series:
        return pd.Series(model(prompts.tolist()), dtype=object)

    return run(prompt)
