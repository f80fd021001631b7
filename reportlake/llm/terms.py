"""Frequency of every distinct term over a collection of per-source counts.

Entries carry a map *source file -> occurrences*.  Each entry is emitted as one
row per file; Spark's hash aggregate combines these on the map side before each
shuffle, so a term or tenant that owns a third of the rows reaches the reducers
as one partial row per task.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: Bounds of usefulness: fewer occurrences are rare, a larger part of all files is common.
MIN_OCCURRENCES = 3
MAX_FILE_SHARE = 0.30


@pandas_udf(StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def term_key(term: Column) -> Column:
    """Lower case, trimmed, single-spaced, NFC.  Only terms with characters outside
    ASCII are handed to Python; the rest stays in generated code."""
    spaced = F.regexp_replace(F.lower(term), r"(?U)\s+", " ")
    plain = F.trim(spaced)
    exotic = plain.rlike(r"[^\x00-\x7F]")
    return F.when(exotic, _nfc(F.when(exotic, plain))).otherwise(plain)


def term_occurrences(entries: DataFrame) -> DataFrame:
    """One row per (entry, file): ``tenant, term, file, n``.

    A repeated ``entry_id`` counts once; rows without ``entry_id`` are told apart by
    tenant and term.  Null maps keep their term with no file; null counts are 0.
    Clashing extra columns are dropped by the projection."""
    rows = entries.select(
        "entry_id", "tenant", "term", F.explode_outer("sources").alias("file", "n")
    )
    return (
        rows.groupBy("entry_id", "tenant", "term", "file")
        .agg(F.max("n").alias("n"))
        .select("tenant", "term", "file", F.coalesce("n", F.lit(0)).alias("n"))
    )


def term_frequencies(
    entries: DataFrame,
    min_occurrences: int = MIN_OCCURRENCES,
    max_file_share: float = MAX_FILE_SHARE,
) -> DataFrame:
    """``term_lc, n, files, mark`` for every distinct term.

    ``n`` sums occurrences, ``files`` counts distinct (tenant, file) with the term,
    ``mark`` is ``rare``, ``common`` or null.  Null and blank terms do not count, but
    their files do.  An empty table gives an empty result."""
    occurrences = term_occurrences(entries)
    total_files = (
        occurrences.where(F.col("file").isNotNull())
        .select("tenant", "file")
        .distinct()
        .agg(F.count(F.lit(1)).alias("n"))
        .scalar()
    )
    # combine by the raw spelling first: the key is then computed once per spelling and file
    combined = (
        occurrences.where(F.col("term").isNotNull())
        .groupBy("term", "tenant", "file")
        .agg(F.sum("n").alias("n"))
        .select(term_key(F.col("term")).alias("term_lc"), "tenant", "file", "n")
        .where(F.col("term_lc") != "")
    )
    per_file = combined.groupBy("term_lc", "tenant", "file").agg(F.sum("n").alias("n"))
    per_term = per_file.groupBy("term_lc").agg(
        F.sum("n").alias("n"), F.count("file").alias("files")
    )
    mark = F.when(F.col("n") < min_occurrences, "rare").when(
        F.col("files") > max_file_share * total_files, "common"
    )
    return per_term.select("term_lc", "n", "files", mark.alias("mark"))


def useless_terms(entries: DataFrame) -> DataFrame:
    """``term_lc, mark`` of the terms outside the frequency bounds."""
    return term_frequencies(entries).where("mark is not null").select("term_lc", "mark")
