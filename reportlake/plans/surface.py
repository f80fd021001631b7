"""Python-backed functions under names that SQL can call."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf

from reportlake.operators.dictation import clean, with_numbers, with_notation
from reportlake.operators.reconcile import restored, word_diff
from reportlake.sources.files import word_text


def _each(f):
    return lambda s: s.map(lambda x: None if x is None else f(x))


def register(spark: SparkSession) -> list[str]:
    """Register the functions for a session and name them; null arguments give null."""

    @pandas_udf("string")
    def spoken_numbers(text: pd.Series) -> pd.Series:
        return _each(lambda t: with_numbers(t)[0])(text)

    @pandas_udf("string")
    def joined_terms(text: pd.Series) -> pd.Series:
        return _each(lambda t: with_notation(t)[0])(text)

    @pandas_udf("string")
    def clean_dictation(text: pd.Series) -> pd.Series:
        return _each(lambda t: clean(t)[0])(text)

    @pandas_udf("string")
    def word_file_text(content: pd.Series) -> pd.Series:
        return _each(lambda c: word_text(bytes(c)))(content)

    @pandas_udf("double")
    def match_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        pairs = zip(a, b, strict=True)
        return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in pairs], dtype="float64")

    @pandas_udf("string")
    def restored_text(source: pd.Series, output: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else restored(x, y)[0] for x, y in zip(source, output, strict=True)], dtype="object")

    @pandas_udf("string")
    def text_diff(source: pd.Series, output: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else word_diff(x, y) for x, y in zip(source, output, strict=True)], dtype="object")

    made = {f.__name__: f for f in (spoken_numbers, joined_terms, clean_dictation, word_file_text, match_ratio, restored_text, text_diff)}
    for name, f in made.items():
        spark.udf.register(name, f)
    return list(made)
