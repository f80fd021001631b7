"""Batches of reports end to end: parsed, audited, checked, triaged, with errors in a column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportlake.functions.text import modality
from reportlake.operators.clinical import checks, triaged_blocks
from reportlake.operators.reconcile import audit_summary
from reportlake.operators.report import fields, render_text, strip, with_blocks
from reportlake.sources.intake import unique_names


def processed(items: DataFrame, label: str = "label", text: str = "text") -> DataFrame:
    """One row per item: ``label, title, patient, modality, audit_ok, source_tokens,
    qc_critical, qc_warnings, urgency, source_sha256, output_sha256, error, ready``.

    A text that is null or blank has ``error`` set and nothing else; no row stops the
    others.  ``ready``: audited without loss, nothing critical, no error."""
    # parsed once: everything below reads the blocks
    read = with_blocks(items.select(F.col(label).alias("label"), F.coalesce(text, F.lit("")).alias("text")), "text")
    blank = strip(F.col("text")) == ""
    done = read.select(
        "label", "text", "blocks", render_text(F.col("blocks")).alias("output"), fields(F.col("blocks")).alias("f"), F.when(~blank, checks(F.col("blocks"))).alias("qc"),
        triaged_blocks(F.col("blocks"))["level"].alias("urgency"), F.when(blank, "the report is empty").otherwise("").alias("error"),
    ).withColumn("a", audit_summary(F.col("text"), F.col("output")))
    none = F.array().cast("array<string>")
    of = lambda severity: F.filter("qc", lambda c: c["severity"] == severity)
    critical = F.coalesce(F.transform(of("critical"), lambda c: F.concat_ws(" ", c["check"], F.nullif(c["detail"], F.lit("")))), none)
    out = done.select(
        "label", "f.*", modality(F.col("f.study")).alias("modality"), (F.col("a.passed") & (F.col("error") == "")).alias("audit_ok"),
        F.size(F.regexp_extract_all(F.lower("text"), F.lit(r"([0-9]+(?:\.[0-9]+)?|[a-z0-9]+)"), 1)).alias("source_tokens"), critical.alias("qc_critical"),
        F.coalesce(F.size(of("warning")), F.lit(0)).alias("qc_warnings"), F.when(F.col("error") == "", F.col("urgency")).otherwise("routine").alias("urgency"),
        F.sha2(F.encode("text", "UTF-8"), 256).alias("source_sha256"), F.sha2(F.encode("output", "UTF-8"), 256).alias("output_sha256"), "error",
    ).drop("age_sex", "referrer", "study_date").withColumnRenamed("study", "title")
    return out.withColumn("ready", F.col("audit_ok") & (F.size("qc_critical") == 0) & (F.col("error") == ""))


def manifest(results: DataFrame, template: str = "", now: str = "") -> DataFrame:
    """The 14 columns that travel with a batch: names, verdict, counts, digests, errors."""
    named = unique_names(results.withColumn("name", F.coalesce(F.nullif("title", F.lit("")), "label")), "name", "label")
    return named.select(
        F.when(F.col("error") == "", F.concat("filename", F.lit(".docx"))).otherwise("").alias("filename"), F.col("label").alias("source_label"), "patient", "modality", F.lit(template).alias("template"),
        F.when(F.col("audit_ok"), "PASS").when(F.col("error") != "", "ERROR").otherwise("FAIL").alias("word_loss_audit"), "source_tokens", F.size("qc_critical").alias("qc_critical_count"),
        F.array_join("qc_critical", "; ").alias("qc_critical_titles"), "urgency", F.col("source_sha256").alias("sha256_source_text"), F.col("output_sha256").alias("sha256_docx"), "error",
        F.lit(now).alias("generated_utc"),
    )


def totals(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count_if("ready").alias("ready"), F.count_if(F.size("qc_critical") > 0).alias("critical"), F.count_if(~F.col("audit_ok") & (F.col("error") == "")).alias("failed"),
        F.count_if(F.col("error") != "").alias("errored"),
    )
