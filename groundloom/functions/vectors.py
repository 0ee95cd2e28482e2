"""Vectors as columns, and embedders."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: An embedder turns a column of strings into a column of arrays of numbers.
Embedder = Callable[[Column], Column]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null where either is zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def measured(v: Column) -> Column:
    """A vector with its squared length."""
    # A lambda's argument is computed once, where the column itself would be computed for each mention.
    square = lambda x: F.aggregate(x, F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double"))
    return F.element_at(F.transform(F.array(v), lambda x: F.struct(x.alias("v"), square(x).alias("n"))), 1)


def measured_cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a["v"], b["v"]), F.sqrt(a["n"] * b["n"]))


def letter_counts(x: Column) -> Column:
    """A deterministic embedder: how often each of a-z occurs."""
    # Letter by letter, not as a lambda over them: that is compiled, and takes a fraction of the time.
    return F.array(*((F.length(x) - F.length(F.replace(x, F.lit(chr(i))))).cast("double") for i in range(97, 123)))


def model_embedder(load: Callable[[], Callable[[list[str]], list]]) -> Embedder:
    """An embedder from a model that `load` gives, once for each Python worker."""

    @F.pandas_udf("array<double>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            yield pd.Series([[float(v) for v in row] for row in model(texts.tolist())])

    return lambda x: encode(x)
