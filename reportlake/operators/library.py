"""Term library: mining, sources added, removed and merged, index look-ups, relevant terms, hints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportlake.operators.documents import LOOKUP_ROWS, near_terms, term_key, term_reason
from reportlake.session import cut, small

MIN_COUNT, MIN_PHRASE, MAX_TERMS = 2, 3, 5_000
MIN_TERM, MAX_TERM = 4, 60


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"([A-Za-z][A-Za-z'\-]{3,})"), 1)


def _bare(w: Column) -> Column:
    return F.regexp_replace(F.lower(w), r"^['-]+|['-]+$", "")


def mined(texts: DataFrame, source: str, text: str, common: DataFrame | None = None, known: DataFrame | None = None, most: int = MAX_TERMS) -> DataFrame:
    """``source, term, n, kind``: candidate terms of each source, the ``most`` frequent.

    Words count from ``MIN_COUNT`` times on if they look technical; phrases of two and three
    words from ``MIN_PHRASE`` on, if no word is common or short and one looks technical or
    has eight letters.  A phrase that only occurs inside a longer kept one is left out.
    ``common`` (word) holds filler words, ``known`` (term) what is listed already."""
    rows = texts.where(F.col(text).isNotNull()).select(F.col(source).alias("source"), F.monotonically_increasing_id().alias("doc"), F.transform(_tokens(F.col(text)), lambda w: F.struct(_bare(w).alias("w"), w.alias("as"))).alias("t"))
    filler = common.select(F.lower("word").alias("w")).distinct() if common is not None else None
    words = rows.select("source", F.posexplode("t").alias("pos", "x")).select("source", "x.w", F.col("x.as").alias("said")).where("w <> ''")
    if filler is not None:
        words = words.join(filler, "w", "left_anti")
    # spelled in lower case once, or never capitalised as a whole word: lower case is the canonical form
    single = words.groupBy("source", "w").agg(F.count(F.lit(1)).alias("n"), F.min_by("said", F.struct((F.col("said") != F.col("w")).cast("int"), "said")).alias("said"))
    shown = F.when(F.col("said") == F.initcap("w"), F.col("w")).otherwise(F.col("said"))
    single = single.where((F.col("n") >= MIN_COUNT) & (term_reason(F.col("w")) != "")).select("source", shown.alias("term"), "n", F.lit("word").alias("kind"))

    def grams(n: int) -> DataFrame:
        runs = F.transform(F.sequence(F.lit(1), F.size("t") - n + 1), lambda i: F.transform(F.slice("t", i, n), lambda x: x["w"]))
        return rows.where(F.size("t") >= n).select("source", F.explode(runs).alias("parts"))

    phrases = grams(2).unionByName(grams(3)).where(F.forall("parts", lambda w: F.length(w) >= MIN_TERM)).groupBy("source", "parts").agg(F.count(F.lit(1)).alias("n"))
    worthy = F.exists("parts", lambda w: (term_reason(w) != "") | (F.length(w) >= 8))
    kept = phrases.where((F.col("n") >= MIN_PHRASE) & worthy).withColumn("term", F.array_join("parts", " ")).where(F.length("term") <= MAX_TERM)
    if filler is not None:
        bad = kept.select("source", "term", F.explode("parts").alias("w")).join(filler, "w").select("source", "term").distinct()
        kept = kept.join(bad, ["source", "term"], "left_anti")
    # the pairs inside kept triples, as an equality join
    inner = kept.where(F.size("parts") == 3).select("source", F.explode(F.array(F.slice("parts", 1, 2), F.slice("parts", 2, 2))).alias("parts"), F.col("n").alias("m")).groupBy("source", "parts").agg(F.max("m").alias("m"))
    alone = kept.join(inner, ["source", "parts"], "left").where("m is null or n > m").select("source", "term", "n", F.lit("phrase").alias("kind"))
    every = single.unionByName(alone)
    if known is not None:
        every = every.join(known.select(term_key(F.col("term")).alias("k")).distinct(), term_key(F.col("term")) == F.col("k"), "left_anti")
    order = Window.partitionBy("source").orderBy(F.desc("n"), F.lower("term"))
    return every.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).drop("r")


def entries(terms: DataFrame) -> DataFrame:
    """``key, term, n, sources`` of a library from rows ``source, term, n``: counts summed
    by source and in all; of several spellings the most frequent is canonical."""
    rows = terms.where(F.col("term").isNotNull() & (term_key(F.col("term")) != "")).withColumn("key", term_key(F.col("term")))
    by_source = rows.groupBy("key", "source").agg(F.sum("n").alias("n"), F.max(F.struct("n", "term")).alias("best"))
    return by_source.groupBy("key").agg(
        F.max("best")["term"].alias("term"), F.sum("n").alias("n"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "n")))).alias("sources")
    ).select("key", "term", "n", "sources")


def merged(library: DataFrame, other: DataFrame) -> DataFrame:
    """Rows ``source, term, n`` of both, of the other only sources that are not there yet."""
    return library.unionByName(other.join(library.select("source").distinct(), "source", "left_anti"))


def without_source(library: DataFrame, sources: list[str]) -> DataFrame:
    return library.where(~F.col("source").isin(*sources))


def looked_up(asked: DataFrame, index: DataFrame) -> DataFrame:
    """``word, term, n`` of the asked words that the library holds."""
    return asked.select("word", term_key(F.col("word")).alias("key")).join(index.select("key", "term", "n"), "key").select("word", "term", "n")


def top_terms(index: DataFrame, k: int) -> DataFrame:
    return index.orderBy(F.desc("n"), "key").limit(k).select("term", "n")


def searched(index: DataFrame, part: str, k: int = 50) -> DataFrame:
    """Terms that hold ``part`` in any case, sorted, the first ``k``."""
    return index.where(F.contains("key", F.lit(part.lower()))).orderBy("key").limit(k).select("term", "n")


def relevant(texts: DataFrame, index: DataFrame, key: str, text: str, k: int = 40, min_ratio: float = 0.75) -> DataFrame:
    """``key, term, score, n, rank``: the library terms that matter for each text: one- to
    three-word runs of it that are listed (1.0), and terms near to one of its words.
    Distinct words are compared once; runs of several words count only as written."""
    t = F.transform(_tokens(F.col(text)), F.lower)
    run = lambda n: F.transform(F.sequence(F.lit(1), F.size("t") - n + 1), lambda i: F.array_join(F.slice("t", i, n), " "))
    none = F.array().cast("array<string>")
    runs = F.concat(*(F.when(F.size("t") >= n, run(n)).otherwise(none) for n in (1, 2, 3)))
    asked = texts.where(F.col(text).isNotNull()).select(key, t.alias("t")).select(key, F.explode(F.array_distinct(runs)).alias("word"))
    exact = index.select(F.col("key").alias("word"), "term", F.lit(1.0).alias("score"), "n")
    close = near_terms(asked.where(~F.contains("word", F.lit(" "))).select("word"), index.select(F.col("key").alias("term")), min_ratio).select("word", F.col("term").alias("key"), F.col("ratio").alias("score"))
    near = close.join(index.select("key", "term", "n"), "key").select("word", "term", "score", "n")
    # one look-up for both: near words are not listed, so a word has one row
    best = asked.join(small(cut(exact.unionByName(near)), LOOKUP_ROWS), "word").groupBy(key, "term").agg(F.max("score").alias("score"), F.max("n").alias("n"))
    order = Window.partitionBy(key).orderBy(F.desc("score"), F.desc("n"), F.lower("term"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hint(parts: Column, most: int = 800) -> Column:
    """Distinct parts joined by commas until the next would pass ``most`` characters."""
    once = F.filter(F.transform(parts, F.trim), lambda p: p.isNotNull() & (p != ""))
    first = F.filter(once, lambda p, i: ~F.exists(F.slice(once, F.lit(1), i), lambda q: F.lower(q) == F.lower(p)))
    start = F.struct(F.lit("").alias("text"), F.lit(False).alias("full"))

    def step(s: Column, p: Column) -> Column:
        joined = F.when(s["text"] == "", p).otherwise(F.concat(s["text"], F.lit(", "), p))
        full = s["full"] | (F.length(joined) > most)
        return F.struct(F.when(full, s["text"]).otherwise(joined).alias("text"), full.alias("full"))

    return F.aggregate(first, start, step)["text"]


def expanded(text: Column, macros: dict[str, str], own: dict[str, str] | None = None) -> Column:
    """Macro triggers ``.name`` replaced by their text; own macros come before built-in ones."""
    table = {**macros, **(own or {})}
    for trigger, body in sorted(table.items(), key=lambda kv: -len(kv[0])):
        text = F.regexp_replace(text, rf"(?i)(?<![\w.])\.{trigger}\b", body.replace("\\", r"\\").replace("$", r"\$"))
    return text
