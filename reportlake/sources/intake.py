"""Readers and writers of exchange formats as expressions over text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


# Header spellings of an intake sheet.
ALIASES = {
    "patient": ("patient_name", "patient", "name", "pt_name"), "patient_id": ("patient_id", "mrn", "uhid", "reg_no", "id"),
    "age_sex": ("age_sex", "age/sex", "agesex", "age", "age_and_sex"), "study": ("study_name", "study", "examination", "modality_study", "exam"),
    "text": ("raw_dictation_text", "dictation", "report_text", "text", "findings", "report", "raw_text"),
}
MAX_FILE_BYTES = 25 << 20


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """``path, text, problem``: whole files, UTF-8 where valid, else Windows-1252 or Latin-1.

    Files above 25 MiB come out with a null text and ``problem`` set."""
    from reportlake.sources.files import read_any

    return read_any(spark, path).select("path", "text", "problem")


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a CSV sheet under canonical names; blank rows left out; a sheet without a
    text column is refused."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    by_name = {c.strip().lower().lstrip("﻿").replace(" ", "_"): c for c in raw.columns}
    found = {k: next((by_name[a] for a in names if a in by_name), None) for k, names in ALIASES.items()}
    if found["text"] is None:
        raise ValueError("the sheet has no text column")
    cols = [(F.col(f"`{c}`") if c else F.lit(None).cast("string")).alias(k) for k, c in found.items()]
    return raw.select(*cols).where(F.trim("text") != "")


def report_text() -> Column:
    """A sheet row (columns patient, age_sex, study, text) as the text of a report: the study
    as its title, then name and age lines, then the dictation."""
    filled = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    study = F.upper(filled("study"))
    title = F.concat(study, F.when(study.endswith("REPORT"), "").otherwise(" REPORT"), F.lit("\n"))
    meta = F.concat_ws("\n", title, F.concat(F.lit("PATIENT NAME: "), filled("patient")), F.concat(F.lit("AGE/SEX: "), filled("age_sex")))
    return F.when(meta != "", F.concat(meta, F.lit("\n\n"), F.trim("text"))).otherwise(F.trim("text"))


def intake(sheet: DataFrame | None = None, files: DataFrame | None = None, pasted: DataFrame | None = None) -> DataFrame:
    """``label, source, text`` of all ways in: sheet rows, files, pasted parts (``key, pos,
    part``)."""
    parts = []
    if sheet is not None:
        name = F.regexp_replace(F.regexp_replace(F.coalesce("patient", F.lit("")), r"[^A-Za-z0-9]+", "_"), "^_+|_+$", "")
        parts.append(sheet.select(F.coalesce(F.nullif(name, F.lit("")), F.lit("row")).alias("label"), F.lit("sheet").alias("source"), report_text().alias("text")))
    if files is not None:
        parts.append(files.where("text is not null").select(F.element_at(F.split("path", "/"), -1).alias("label"), F.lit("file").alias("source"), "text"))
    if pasted is not None:
        parts.append(pasted.select(F.concat_ws("_", F.lit("paste"), "pos").alias("label"), F.lit("paste").alias("source"), F.col("part").alias("text")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def json_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents below a folder, one record each, with the tenant of their folder;
    broken ones and tenants that begin with an underscore are left out."""
    rows = spark.read.schema(f"{schema}, _broken string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(path)
    tenant = F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1)
    return rows.withColumn("tenant", tenant).where("_broken is null and not startswith(tenant, '_')").drop("_broken")


def log_tail(lines: DataFrame, schema: str, n: int) -> DataFrame:
    """The last ``n`` entries of a log of JSON lines (``seq, value``), newest first; broken
    lines are skipped."""
    read = lines.select("seq", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("e"), F.try_parse_json("value").isNull().alias("broken"))
    return read.where("not broken and e is not null").orderBy(F.desc("seq")).limit(n).select("seq", "e.*")


def split_pasted(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``key, pos, part``: pasted text cut at lines of three dashes or more."""
    cut = texts.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, r"(?m)^\s*-{3,}\s*$")).alias("pos", "p"))
    return cut.select(key, "pos", F.regexp_replace("p", r"^\s+|\s+$", "").alias("part")).where("part <> ''")


def hl7_field(message: Column, segment: str, field: int) -> Column:
    """A field of the first such segment, or the empty string."""
    segments = F.split(F.regexp_replace(message, r"\r\n?|\n", "\r"), "\r")
    parts = F.split(F.get(F.filter(segments, lambda s: s.startswith(f"{segment}|")), F.lit(0)), r"\|")
    return F.coalesce(F.get(parts, F.lit(field - (segment == "MSH"))), F.lit(""))


def order_of(message: Column) -> Column:
    """The order in an ORM message: control id, patient, sex, study, referrer."""
    family, given = (F.split_part(hl7_field(message, "PID", 5), F.lit("^"), F.lit(i)) for i in (1, 2))
    return F.struct(
        hl7_field(message, "MSH", 10).alias("control_id"), F.trim(F.concat_ws(" ", given, family)).alias("patient"),
        hl7_field(message, "PID", 8).alias("sex"), F.split_part(hl7_field(message, "OBR", 4), F.lit("^"), F.lit(2)).alias("study"),
        F.trim(F.concat_ws(" ", F.split_part(hl7_field(message, "OBR", 16), F.lit("^"), F.lit(3)), F.split_part(hl7_field(message, "OBR", 16), F.lit("^"), F.lit(2)))).alias("referrer"),
    )


def unique_names(rows: DataFrame, name: str, order: str) -> DataFrame:
    """Adds ``filename``: safe, the second and later ones of a name with ``_2``, ``_3``."""
    plain = F.replace(F.trim(F.regexp_replace(name, r"[^A-Za-z0-9 _-]", "")), F.lit(" "), F.lit("_"))
    safe = F.left(F.coalesce(F.nullif(plain, F.lit("")), F.lit("report")), F.lit(80))
    w = Window.partitionBy("__safe").orderBy(order)
    n = F.row_number().over(w)
    return rows.withColumn("__safe", safe).withColumn("filename", F.when(n == 1, F.col("__safe")).otherwise(F.concat("__safe", F.lit("_"), n.cast("string")))).drop("__safe")


def routed(reports: DataFrame, doctors: DataFrame, key: str, text: str) -> DataFrame:
    """``key, doctor, how``: the one doctor whose name stands in the last 400 characters
    (``signature``), or, where no name stands there, in the whole text (``mention``).

    Names are looked up by their words: each two neighbouring words of the text meet the
    directory in an equality join, so no report is held against every name.  Several
    different doctors (``ambiguous``), or none (``none``), give null."""
    whole = F.lower(F.coalesce(text, F.lit("")))

    def pairs(part: Column, signed: bool) -> Column:
        w = F.regexp_extract_all(part, F.lit(r"([\p{L}]+)"), 1)
        both = F.zip_with(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, F.lit(2), F.size(w)), lambda a, b: F.concat_ws(" ", a, b))
        return F.transform(F.array_distinct(both), lambda p: F.struct(p.alias("pair"), F.lit(signed).alias("signed")))

    asked = reports.select(key, F.explode_outer(F.concat(pairs(F.right(whole, F.lit(400)), True), pairs(whole, False))).alias("p")).select(key, "p.*")
    named = F.regexp_extract_all(F.lower("full_name"), F.lit(r"([\p{L}]{2,})"), 1)
    known = doctors.select("full_name", F.array_join(F.slice(F.filter(named, lambda x: x != "dr"), 1, 2), " ").alias("pair")).distinct()
    found = asked.join(known, "pair", "left").groupBy(key).agg(
        F.collect_set(F.when(F.col("signed"), F.col("full_name"))).alias("signed"), F.collect_set("full_name").alias("named")
    )
    pool = F.when(F.size("signed") > 0, F.col("signed")).otherwise(F.col("named"))
    how = F.when(F.size(pool) == 0, "none").when(F.size(pool) > 1, "ambiguous").when(F.size("signed") > 0, "signature").otherwise("mention")
    return found.select(key, F.when(F.size(pool) == 1, F.get(pool, F.lit(0))).alias("doctor"), how.alias("how"))


def route(reports: DataFrame, doctors: DataFrame, key: str, text: str) -> DataFrame:
    """``key, doctor`` of ``routed``."""
    return routed(reports, doctors, key, text).select(key, "doctor")
