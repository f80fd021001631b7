"""Measured sizes brought to millimetres, missing units predicted by a tree ensemble.

Quantities are read from the element's own wording with built-in expressions.  Where
neither ``stated`` nor ``sentence`` names a unit, a random forest predicts it from
magnitude, notation, source, modality, organ and the other elements of the record.  It
learns from elements whose unit is named, with the name left out; its scores are
calibrated on other such elements (isotonic, one curve for the score of the chosen
class) and measured on a third part.  Where the report declares a unit for all figures,
that statement decides over the prediction; assignments below ``MIN_CONFIDENCE`` without
such a statement are kept for review and not converted.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportlake.session import cut

# Units with their size in millimetres, and number words.
UNITS = ("mm", "cm", "in")
MILLIMETRES = {"mm": 1.0, "cm": 10.0, "in": 25.4}
NUMBER_WORDS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16,
    "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50,
    "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90, "hundred": 100, "half": 0.5, "quarter": 0.25,
}

#: Rows the forest is fitted on, at most; all other steps see all rows.
MAX_TRAINING_ROWS = 20_000
MIN_CONFIDENCE = 0.90
#: Sizes further than this from the right one (mm) are wrong.
TOLERANCE_MM = 0.06
SEED = 11

_UNIT = r"(?:millimet(?:re|er)s?|mms?\b|centimet(?:re|er)s?|cms?\b|inch(?:es)?|in(?=\s*(?:[.,;:)]|$|in\b))|[\"″”])"
_DIGITS = r"(?:\d+\s+\d+/\d+|\d+/\d+|\d+(?:[.,]\d+)?)"
_WORD = "(?:" + "|".join(NUMBER_WORDS) + ")"
_WORDS = rf"(?:{_WORD}\b(?:[\s-]+(?:and\s+(?:a\s+)?)?{_WORD}\b)*)"
_BY = r"\s*(?:x|×|\*|by)\s*"


def _dims(number: str) -> str:
    return rf"{number}(?:\s*{_UNIT})?(?:{_BY}{number}(?:\s*{_UNIT})?)*"


def _unit_of(text: Column) -> Column:
    """mm, cm, in or null, by the last unit named in a quantity."""
    last = F.lower(F.regexp_extract(text, rf"(?i)({_UNIT})[^a-z\"″”]*$", 1))
    return (
        F.when(last.rlike("^m"), "mm").when(last.rlike("^c"), "cm").when(last.rlike("^(in|[\"″”])"), "in")
    )


def _first(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 0), F.lit(""))


def quantity_in(text: Column) -> Column:
    """The quantity a phrase names: digits with unit, else words with unit, else digits."""
    lead = r"(?i)(?<![\w.-])"
    return F.coalesce(
        _first(text, rf"{lead}{_dims(_DIGITS)}(?<=[a-z\"″”])"),
        _first(text, rf"{lead}{_dims(_WORDS)}(?<=(?:met|mm|cm|cms|met..|met...|inch|inches|in|[\"″”]))"),
        _first(text, rf"{lead}{_dims(_DIGITS)}"),
    )


def _value(number: Column) -> Column:
    """A written number as double: 3, 2.5, 2,5, 1 3/8, 5/8, twenty five, four and a half."""
    n = F.lower(F.trim(number))
    whole = F.regexp_extract(n, r"^(\d+)\s+\d+/\d+$", 1).try_cast("double")
    top = F.regexp_extract(n, r"(\d+)/\d+$", 1).try_cast("double")
    under = F.regexp_extract(n, r"\d+/(\d+)$", 1).try_cast("double")
    words = F.create_map(*[F.lit(x) for kv in NUMBER_WORDS.items() for x in (kv[0], float(kv[1]))])
    spelled = F.aggregate(
        F.split(n, r"[\s-]+"), F.lit(0.0), lambda acc, w: acc + F.coalesce(F.try_element_at(words, w), F.lit(0.0))
    )
    return (
        F.when(n.rlike(r"\d/\d"), F.coalesce(whole, F.lit(0.0)) + F.try_divide(top, under))
        .when(n.rlike(r"^\d"), F.replace(n, F.lit(","), F.lit(".")).try_cast("double"))
        .otherwise(spelled)
    )


def largest(quantity: Column) -> Column:
    """The largest dimension of a quantity, unit apart."""
    numbers = F.regexp_extract_all(quantity, F.lit(rf"(?i)({_DIGITS}|{_WORDS})"), 1)
    return F.array_max(F.transform(numbers, _value))


def declared_unit(report: Column) -> Column:
    """The unit a report gives for all figures without one, or null."""
    said = r"(?:sizes?|measurements?|dimensions?|figures?)\b[^.;:\n\d]{0,40}"
    unit = r"(millimet(?:re|er)s?|mm|centimet(?:re|er)s?|cm|inch(?:es)?)\b"
    name = F.lower(
        F.coalesce(
            F.nullif(F.regexp_extract(report, rf"(?i)\b{said}\b{unit}", 1), F.lit("")),
            F.regexp_extract(report, rf"(?i)\b(?:figures?|sizes?)\s+without\s+units?\s*[:=-]?\s*{unit}", 1),
        )
    )
    return F.when(name.rlike("^m"), "mm").when(name.rlike("^c"), "cm").when(name.rlike("^i"), "in")


def read_sizes(records: DataFrame) -> DataFrame:
    """One row per version of a record and non-null element: ``id, pos, size_mm, value,
    unit`` (null where not named) and the features.

    Null or empty arrays give no rows, null elements none but they keep their position;
    an element without any number is left out.  Extra columns are dropped here."""
    rows = records.where("id is not null and size(measurements) > 0").select(
        "id", F.coalesce("source", F.lit("")).alias("source"), F.lower(F.coalesce("modality", F.lit(""))).alias("modality"),
        declared_unit(F.col("report_text")).alias("declared"), F.posexplode("measurements").alias("pos", "m"),
    ).where("m is not null")
    stated, sentence = quantity_in(F.col("m.stated")), F.col("m.sentence")
    named = rows.select(
        "id", "pos", "source", "modality", "declared", F.lower(F.coalesce("m.key", F.lit(""))).alias("organ"),
        F.coalesce("m.via", F.lit("")).alias("via"), F.col("m.size_mm").alias("size_mm"),
        stated.alias("stated"), F.when(stated.isNull() | _unit_of(stated).isNull(), quantity_in(sentence)).alias("said"),
    )
    quantity = F.coalesce("stated", "said")
    return named.select(
        "id", "pos", "source", "modality", "declared", "organ", "via", "size_mm",
        largest(quantity).alias("value"),
        F.coalesce(_unit_of(F.col("stated")), _unit_of(F.col("said"))).alias("unit"),
        quantity.rlike(r"\d[.,]\d").alias("decimal"), quantity.rlike(r"\d/\d").alias("fraction"), quantity.rlike(_BY).alias("several"),
    ).where("value is not null")


FEATURES = ("log_value", "f_decimal", "f_fraction", "f_several", "others_mm", "others_cm", "others_in", "organ_h", "source_h", "modality_h", "via_h")


def _features(rows: DataFrame) -> DataFrame:
    hashed = lambda c: (F.pmod(F.hash(c), F.lit(64))).cast("double")
    named = {
        "log_value": F.log10(F.greatest("value", F.lit(0.01))),
        **{f"f_{c}": F.col(c).cast("double") for c in ("decimal", "fraction", "several")},
        **{f"others_{u}": F.coalesce(F.col(f"near_{u}").cast("double"), F.lit(0.0)) for u in UNITS},
        "organ_h": hashed("organ"), "source_h": hashed("source"), "modality_h": hashed("modality"), "via_h": hashed("via"),
    }
    return rows.select("*", *(v.alias(k) for k, v in named.items()))


def _with_neighbours(sizes: DataFrame, rows: DataFrame) -> DataFrame:
    """Adds ``near_mm, near_cm, near_in``: how many other elements of the record name that unit."""
    named = sizes.where("unit is not null").groupBy("id").agg(
        *(F.sum((F.col("unit") == u).cast("int")).alias(f"all_{u}") for u in UNITS)
    )
    own = lambda u: F.coalesce((F.col("unit") == u).cast("int"), F.lit(0))
    return rows.join(named, "id", "left").select(
        *rows.columns, *((F.coalesce(f"all_{u}", F.lit(0)) - own(u)).alias(f"near_{u}") for u in UNITS)
    )


def _labelled(rows: DataFrame) -> DataFrame:
    """Adds ``label`` (the named unit) and ``fold`` (0 to 99, one for a whole record)."""
    label = F.expr(f"case unit {' '.join(f"when '{u}' then {float(k)}" for k, u in enumerate(UNITS))} end")
    return rows.withColumns({"label": label, "fold": F.pmod(F.xxhash64("id", F.lit(SEED + 3)), F.lit(100))})


def fit(sizes: DataFrame, max_rows: int = MAX_TRAINING_ROWS):
    """(forest pipeline, calibration, held-out accuracy) fitted on at most ``max_rows``
    labelled rows, the ones of smallest hash: folds 0-59 teach, 60-79 calibrate, 80-99
    measure.  None where there are fewer than two classes to tell apart.

    The accuracy is a list of (unit, rows, right, confident, confident and right)."""
    drawn = sizes.where("unit is not null and value > 0").orderBy(F.xxhash64("id", "pos", F.lit(SEED))).limit(max_rows)
    sample = _features(_labelled(_with_neighbours(sizes, drawn))).select(*FEATURES, "label", "fold").persist()
    try:
        if sample.where("fold < 60").select("label").distinct().count() < 2 or sample.where("fold >= 60 and fold < 80").isEmpty():
            return None
        forest = RandomForestClassifier(
            labelCol="label", featuresCol="features", numTrees=24, maxDepth=8, maxBins=64, seed=SEED, subsamplingRate=0.7,
            featureSubsetStrategy="all",
        )
        model = Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="features"), forest]).fit(sample.where("fold < 60"))
        right = (F.col("prediction") == F.col("label")).cast("double")
        held = _scored(model.transform(sample.where("fold >= 60 and fold < 80"))).select(F.col("score").alias("features"), right.alias("label"))
        fitted = IsotonicRegression(featuresCol="features", labelCol="label").fit(held)
        curve = list(zip(fitted.boundaries, fitted.predictions, strict=True))
        sure = (_calibrated(F.col("score"), _thinned(curve)) >= MIN_CONFIDENCE).cast("double")
        measured = _scored(model.transform(sample.where("fold >= 80"))).groupBy("label").agg(
            F.count(F.lit(1)).alias("n"), F.sum(right).alias("right"), F.sum(sure).alias("sure"), F.sum(sure * right).alias("sure_right")
        ).collect()
    finally:
        sample.unpersist()
    return model, curve, [(UNITS[int(r.label)], r.n, int(r.right), int(r.sure), int(r.sure_right)) for r in measured]


def _scored(rows: DataFrame) -> DataFrame:
    return rows.withColumn("score", F.array_max(vector_to_array("probability")))


def _calibrated(score: Column, curve: list[tuple[float, float]]) -> Column:
    """Step-wise linear reading of the calibration curve (bounded by the held-out rows)."""
    xs, ys = [float(x) for x, _ in curve], [float(y) for _, y in curve]
    out = F.lit(ys[0])
    for (x0, y0), (x1, y1) in zip(zip(xs, ys, strict=True), zip(xs[1:], ys[1:], strict=True), strict=False):
        line = F.lit(y0) if x1 == x0 else F.lit(y0) + (score - x0) * ((y1 - y0) / (x1 - x0))
        out = F.when(score > x0, line).otherwise(out)
    return F.when(score >= xs[-1], ys[-1]).otherwise(out)


def _thinned(curve: list[tuple[float, float]], most: int = 40) -> list[tuple[float, float]]:
    step = max(1, len(curve) // most)
    return [*curve[::step], curve[-1]]


def in_millimetres(records: DataFrame, min_confidence: float = MIN_CONFIDENCE, max_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """``id, pos, value, unit, likely, confidence, route, size_mm, right_mm``, one row
    per version and element.

    route: ``named`` (unit in the wording), ``declared`` (no unit in the wording, but
    one for all figures in the report), ``predicted`` (confident assignment) or ``review``
    (right_mm null).  ``likely`` is what the forest takes the unit for, ``confidence``
    how sure it is of that."""
    sizes = cut(read_sizes(records))  # read once: the fit, its neighbours and the assignment all use it
    fitted = fit(sizes, max_rows)
    keep = ["id", "pos", "value", "unit", "likely", "confidence", "route", "size_mm"]
    named = sizes.where("unit is not null").select(
        "id", "pos", "value", "unit", F.col("unit").alias("likely"), F.lit(1.0).alias("confidence"), F.lit("named").alias("route"), "size_mm"
    )
    unnamed = sizes.where("unit is null")
    if fitted is None:
        scored = unnamed.withColumns({"likely": F.lit(None).cast("string"), "confidence": F.lit(0.0)})
    else:
        model, curve, _ = fitted
        scored = _scored(model.transform(_features(_with_neighbours(sizes, unnamed)))).withColumns(
            {"likely": F.element_at(F.array(*map(F.lit, UNITS)), F.col("prediction").cast("int") + 1), "confidence": _calibrated(F.col("score"), _thinned(curve))}
        )
    route = F.when(F.col("declared").isNotNull(), "declared").when(F.col("confidence") >= min_confidence, "predicted").otherwise("review")
    guessed = scored.withColumns({"route": route, "unit": F.coalesce("declared", "likely")}).select(*keep)
    factor = F.expr(f"case unit {' '.join(f"when '{u}' then {f}D" for u, f in MILLIMETRES.items())} end")
    return named.unionByName(guessed).select(
        *keep, F.when(F.col("route") != "review", F.col("value") * factor).alias("right_mm")
    )


def wrong_sizes(records: DataFrame) -> DataFrame:
    """``id, pos, mm10``: elements whose ``size_mm`` is null or not the size in
    millimetres; mm10 is the right size in tenths, rounded.  Repeated rows and versions
    that agree count once."""
    off = F.col("size_mm").isNull() | F.isnan("size_mm") | (F.abs(F.col("size_mm") - F.col("right_mm")) > TOLERANCE_MM)
    return (
        in_millimetres(records).where(F.col("right_mm").isNotNull() & off)
        .select("id", "pos", F.round(F.col("right_mm") * 10).cast("bigint").alias("mm10"))
        .distinct()
    )


def unit_accuracy(records: DataFrame) -> DataFrame:
    """``unit, rows, right, sure, sure_right``: how the forest does on named elements it
    was not fitted on, and on those of them it is confident about."""
    fitted = fit(cut(read_sizes(records)))
    return records.sparkSession.createDataFrame(fitted[2] if fitted else [], "unit string, rows bigint, right bigint, sure bigint, sure_right bigint")
