"""Queries of the core operators over the given tables, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from reportlake import vocabulary
from reportlake.functions import crypto, text
from reportlake.operators import audit, batch, clinical, corpus, dictation, documents, library, memory, nested, reconcile, report, store, units
from reportlake.oracle import ORACLE  # noqa: F401
from reportlake.session import read, shared_dir
from reportlake.sources import exchange, intake
from reportlake.streaming import replay


def p2_found(spark, sf_dir):
    return units.wrong_sizes(read(spark, sf_dir, "records"))


def p2_sizes(spark, sf_dir):
    return units.in_millimetres(read(spark, sf_dir, "records"))


def p2_accuracy(spark, sf_dir):
    return units.unit_accuracy(read(spark, sf_dir, "records"))


def p5_found(spark, sf_dir):
    return nested.child_rows(nested.occurrences(read(spark, sf_dir, "structured_reports"), read(spark, sf_dir, "records")))


def p5_subtrees(spark, sf_dir):
    return nested.subtree_store(nested.occurrences(read(spark, sf_dir, "structured_reports"), read(spark, sf_dir, "records")))


def p5_bridge(spark, sf_dir):
    return nested.occurrences(read(spark, sf_dir, "structured_reports"), read(spark, sf_dir, "records")).drop("node").distinct()


def latest_records(spark, sf_dir):
    return store.latest(read(spark, sf_dir, "records")).select("id", store.minute_of(F.col("updated")).alias("updated"), F.coalesce(F.size("trail"), F.lit(-1)).cast("bigint").alias("steps"))


def event_tail(spark, sf_dir):
    return read(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("event_id", "event_type", "user_id")


def commits_accepted(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("base"), "event_id")
    return store.commit(e, ["user_id"], "base", "event_id").groupBy("user_id").agg(
        F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("conflicts")
    )


def capped_history(spark, sf_dir):
    return store.capped(read(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], "event_id", 10)


def imported_once(spark, sf_dir):
    return store.imported_once(read(spark, sf_dir, "documents"), "text", "doc_id")


def without_deleted(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return store.without(d.select("doc_id", "source"), d.where("text is null or trim(text) = ''"), "doc_id")


def tenants(spark, sf_dir):
    return store.tenants(read(spark, sf_dir, "records"))


def trail_transitions(spark, sf_dir):
    return store.transitions(read(spark, sf_dir, "records"))


def urgency_counts(spark, sf_dir):
    return store.latest(read(spark, sf_dir, "records")).groupBy(F.coalesce(F.nullif("urgency", F.lit("")), F.lit("routine")).alias("urgency"), "status").agg(F.count(F.lit(1)).alias("n"))


def urgency_rollup(spark, sf_dir):
    r = store.latest(read(spark, sf_dir, "records")).select(F.lower("modality").alias("modality"), "status")
    return r.rollup("modality", "status").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


def worklist(spark, sf_dir):
    return clinical.worklist(read(spark, sf_dir, "records"))


def priors(spark, sf_dir):
    return clinical.priors(read(spark, sf_dir, "records"))


def measure_compare(spark, sf_dir):
    return clinical.compare_with_prior(read(spark, sf_dir, "records"))


def delta_summary(spark, sf_dir):
    return clinical.compare_with_prior(read(spark, sf_dir, "records")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def _reports(spark, sf_dir):
    """Newest version of every record, with the columns that reports are read from."""
    return store.latest(read(spark, sf_dir, "records").select("id", "report_text", "patient", "referrer", "age_sex", "status", "study", "updated", "trail", "arrived"))


def report_blocks(spark, sf_dir):
    return report.block_rows(_reports(spark, sf_dir).where("report_text is not null")).select("id", "kind", "section", "text", "trailer")


def report_fields(spark, sf_dir):
    r = report.with_blocks(_reports(spark, sf_dir).where("report_text is not null"))
    return r.select("id", report.fields(F.col("blocks")).alias("f")).select("id", "f.*")


def report_drafts(spark, sf_dir):
    return report.new_records(_reports(spark, sf_dir)).withColumn("triage_terms", F.array_join("triage_terms", ", "))


def structured_reports(spark, sf_dir):
    return report.structured(_reports(spark, sf_dir).where("report_text is not null"))


def triage_levels(spark, sf_dir):
    return clinical.triage(_reports(spark, sf_dir))


def negation_polarity(spark, sf_dir):
    return clinical.polarity(_reports(spark, sf_dir).where("report_text is not null"))


def _halves(spark, sf_dir):
    """Findings and impression of every report: the impression drafted from the findings."""
    r = report.with_blocks(_reports(spark, sf_dir).where("report_text is not null"))
    part = lambda names: F.array_join(report.texts_under(F.col("blocks"), names), "\n")
    return r.select("id", part(vocabulary.FINDINGS).alias("findings"), part(vocabulary.IMPRESSION).alias("impression"))


def draft_guard(spark, sf_dir):
    return clinical.draft_guard(_halves(spark, sf_dir).where("findings <> '' "), "id", "findings", "impression")


def draft_badges(spark, sf_dir):
    return clinical.draft_badges(_halves(spark, sf_dir), "id", "findings", "impression")


def quality_findings(spark, sf_dir):
    return clinical.validation(_reports(spark, sf_dir))


def quality_histogram(spark, sf_dir):
    return clinical.severity_counts(quality_findings(spark, sf_dir))


def guideline_advice(spark, sf_dir):
    return clinical.advice(_reports(spark, sf_dir).where("report_text is not null"))


def impression_proposals(spark, sf_dir):
    return clinical.impression_proposals(_reports(spark, sf_dir))


def section_lines(spark, sf_dir):
    s = documents.sectioned(_reports(spark, sf_dir))
    return s.groupBy("section").agg(F.count(F.lit(1)).alias("lines"), F.countDistinct("id").alias("reports"))


def anatomy_placed(spark, sf_dir):
    return documents.anatomy(_reports(spark, sf_dir))


def anatomy_counts(spark, sf_dir):
    return documents.anatomy(_reports(spark, sf_dir)).groupBy("region", "organ").agg(F.count(F.lit(1)).alias("n"))


def anatomy_paths(spark, sf_dir):
    paths = documents.anatomy_paths(documents.anatomy(_reports(spark, sf_dir)))
    return paths.select("id", "path", F.md5(F.array_join("sentences", "\n")).alias("digest"))


def deid_clean(spark, sf_dir):
    r = _reports(spark, sf_dir).withColumn("names", F.array("patient", "referrer"))
    return documents.deidentified(r, "id", "report_text", "names").select("id", F.md5("clean").alias("digest"), F.size("places").cast("bigint").alias("n"))


def near_terms(spark, sf_dir):
    w = read(spark, sf_dir, "ocr_results").dropDuplicates(["page_id"]).where("text is not null").select("page_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)([\p{L}\p{N}@][\p{L}\p{N}@'-]*)"), 1)).alias("word"))
    return documents.near_terms(w, read(spark, sf_dir, "corpus_terms"))


def _text_pairs(spark, sf_dir):
    """Dictations and the reports made of them."""
    t = read(spark, sf_dir, "transcriptions").where("text is not null").groupBy("transcript_id").agg(F.min(F.struct("text", "record_id")).alias("x"))
    p = t.select("transcript_id", "x.text", F.col("x.record_id").alias("id")).join(_reports(spark, sf_dir).where("report_text is not null").select("id", "report_text"), "id")
    return p.select("transcript_id", "text"), p.select("transcript_id", F.col("report_text").alias("text"))


def bag_difference(spark, sf_dir):
    return audit.bag_difference(*_text_pairs(spark, sf_dir), "transcript_id", "text")


def missing_numbers(spark, sf_dir):
    return audit.missing_numbers(*_text_pairs(spark, sf_dir), "transcript_id", "text")


def token_counts(spark, sf_dir):
    return audit.bag(read(spark, sf_dir, "documents"), "doc_id", "text")


def sentence_counts(spark, sf_dir):
    d = read(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", *(F.size(text.sentences(F.col("text"), s)).cast("bigint").alias(f"style_{s}") for s in "abc"))


def sentence_contexts(spark, sf_dir):
    d = read(spark, sf_dir, "documents").where("text is not null").select(F.explode(text.sentences(F.col("text"), "b")).alias("s"))
    return d.groupBy(clinical.sentence_context(F.col("s")).alias("context")).agg(F.count(F.lit(1)).alias("n"))


def patient_slugs(spark, sf_dir):
    return read(spark, sf_dir, "records").select("patient", "age_sex").distinct().select("patient", "age_sex", text.patient_slug(F.col("patient"), F.col("age_sex")).alias("slug"))


def modalities(spark, sf_dir):
    return read(spark, sf_dir, "records").groupBy(text.modality(F.col("study")).alias("modality")).agg(F.count(F.lit(1)).alias("n"))


def sound_keys(spark, sf_dir):
    return read(spark, sf_dir, "corpus_terms").where("term is not null").select("term").distinct().select("term", text.sound_key(F.col("term")).alias("key"))


def hl7_names(spark, sf_dir):
    return read(spark, sf_dir, "records").where("patient is not null").select("patient").distinct().select("patient", text.hl7_name(F.col("patient")).alias("name"))


def unit_style(spark, sf_dir):
    t = read(spark, sf_dir, "transcriptions").where("text is not null").select("transcript_id", "text").distinct()
    return t.select("transcript_id", F.md5(text.roman_grades(text.iso_units(F.col("text")))).alias("digest"))


def bigrams(spark, sf_dir):
    return corpus.ngrams(read(spark, sf_dir, "chunks").dropDuplicates(["chunk_id"]), "text", 2, 5)


def trigrams(spark, sf_dir):
    return corpus.ngrams(read(spark, sf_dir, "chunks").dropDuplicates(["chunk_id"]), "text", 3, 5)


def packed_chunks(spark, sf_dir):
    return corpus.pack_chunks(read(spark, sf_dir, "documents"), "doc_id", "text")


def hash_vectors(spark, sf_dir):
    v = corpus.hash_vectors(read(spark, sf_dir, "documents"), "doc_id", "text")
    return v.select("doc_id", F.col("bucket").cast("bigint").alias("bucket"), F.round("weight", 4).alias("weight"))


def vector_search(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    return corpus.nearest(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", 5)


def memory_strength(spark, sf_dir):
    return corpus.memory_strength(read(spark, sf_dir, "memories"), "2026-01-01")


def profile_stats(spark, sf_dir):
    m = read(spark, sf_dir, "memories").dropDuplicates(["memory_id"])
    return m.groupBy("tenant", "doctor").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("concept").alias("concepts"), F.sum("uses").alias("uses"))


def keyed_hashes(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", crypto.hmac_sha256(b"demo key", F.col("c_name")).alias("mac"))


def chain_links(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return store.chained(e, "user_id", "event_id", "event_id", "event_type").select("event_id", "link")


def chain_status(spark, sf_dir):
    """Real chains; the entries of one type were changed after they had been linked."""
    e = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    made = store.chained(e, "user_id", "event_id", "event_id", "event_type")
    edited = made.withColumn("event_type", F.when(F.col("event_id") % 997 == 0, "edited").otherwise(F.col("event_type")))
    return store.verify_chain(edited, "user_id", "event_id", "event_id", "event_type")


def trail_checks(spark, sf_dir):
    return store.checked_steps(read(spark, sf_dir, "records")).groupBy("what").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("ok")).alias("illegal"))


def kept_versions(spark, sf_dir):
    r = read(spark, sf_dir, "records").where("id is not null").groupBy("id", store.minute_of(F.col("updated")).alias("at")).agg(F.count(F.lit(1)).alias("copies")).where("at is not null")
    return store.kept_versions(r, ["id"], "at", 1).select("id", "at", "version")


def sealed_round_trip(spark, sf_dir):
    s = read(spark, sf_dir, "documents").select("doc_id", "text").withColumn("sealed", crypto.seal(F.col("text"), b"demo key"))
    back = s.select("doc_id", "text", "sealed", crypto.unseal(F.col("sealed"), b"demo key").alias("b"), crypto.unseal(F.col("sealed"), b"other").alias("w"))
    return back.select("doc_id", F.md5("b").alias("digest"), (F.col("w").isNull() & ~F.col("sealed").eqNullSafe(F.col("text"))).alias("hidden"))


def pasted_parts(spark, sf_dir):
    d = read(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.replace("text", F.lit("\n\n"), F.lit("\n----\n")).alias("text"))
    return intake.split_pasted(d, "doc_id", "text").groupBy("doc_id").agg(F.count(F.lit(1)).alias("parts"))


def _messages(spark, sf_dir):
    return store.latest(read(spark, sf_dir, "records").drop("measurements")).where("report_text is not null")


def oru_messages(spark, sf_dir):
    return _messages(spark, sf_dir).select("id", F.md5(exchange.result_message()).alias("digest"))


def oru_fields(spark, sf_dir):
    m = _messages(spark, sf_dir).select("id", "report_text", exchange.result_message().alias("m"))
    lines = F.filter(F.split("m", "\r"), lambda s: s.startswith("OBX|") & F.contains(s, F.lit("|59776-5^")))
    return m.select("id", intake.hl7_field(F.col("m"), "MSH", 10).alias("control_id"), intake.hl7_field(F.col("m"), "PID", 8).alias("sex"), F.size(lines).cast("bigint").alias("lines"))


def order_round_trip(spark, sf_dir):
    m = _messages(spark, sf_dir).select("id", exchange.framed(exchange.result_message()).alias("f")).select("id", exchange.unframed(F.col("f")).alias("u"))
    one = m.select("id", F.get("u.messages", F.lit(0)).alias("m"))
    return one.select("id", exchange.accepted(exchange.answer(F.col("m")))["ok"].alias("ok"), intake.hl7_field(exchange.answer(F.col("m"), "AE", F.lit("no|room")), "MSA", 3).alias("why"))


def fhir_reports(spark, sf_dir):
    j = _messages(spark, sf_dir).select("id", exchange.bundle().alias("j"))
    get = lambda path: F.get_json_object("j", f"$.entry{path}")
    return j.select(
        "id", get("[1].resource.status").alias("status"), get("[0].resource.gender").alias("gender"), get("[0].resource.name[0].text").alias("name"),
        F.md5(F.decode(F.unbase64(get("[1].resource.presentedForm[0].data")), "UTF-8")).alias("digest"), (get("[1].resource.subject.reference") == F.concat(F.lit("Patient/"), get("[0].resource.id"))).alias("linked"),
    )


def alerts(spark, sf_dir):
    r = store.latest(read(spark, sf_dir, "records").drop("measurements", "report_text")).where("urgency in ('stat', 'urgent')")
    return r.select("id", exchange.alert().alias("a")).select("id", "a.subject", "a.short", F.md5("a.body").alias("digest"))


def header_checks(spark, sf_dir):
    """Reports held against the header of the next study of the table, whose patient is another."""
    r = _messages(spark, sf_dir).select("id", "report_text", "patient", "age_sex", "modality")
    order = Window.partitionBy(F.substring("id", 1, 2)).orderBy("id")
    nxt = lambda c: F.lead(c).over(order)
    h = r.select(
        "id", "report_text", "patient", "age_sex", nxt("patient").alias("header_patient"), exchange.sex_letter(nxt("age_sex")).alias("header_sex"),
        F.regexp_extract(nxt("age_sex"), r"(\d{1,3})", 1).try_cast("int").alias("header_age"), F.lit("CT").alias("header_modality"), F.lit("L").alias("header_laterality"),
    )
    return exchange.cross_checks(h, "id")


def unique_filenames(spark, sf_dir):
    return intake.unique_names(read(spark, sf_dir, "referrers").select("referrer_id", F.col("city").alias("label")), "label", "referrer_id").select("referrer_id", "filename")


def intake_texts(spark, sf_dir):
    r = _messages(spark, sf_dir).select("id", "patient", "age_sex", "study", F.col("report_text").alias("text"))
    return r.select("id", F.md5(intake.report_text()).alias("digest"))


def batch_manifest(spark, sf_dir):
    return batch.manifest(batch.processed(_reports(spark, sf_dir), "id", "report_text"))


def batch_totals(spark, sf_dir):
    return batch.totals(batch.processed(_reports(spark, sf_dir), "id", "report_text"))


def dictation_clean(spark, sf_dir):
    t = read(spark, sf_dir, "transcriptions").select("transcript_id", "text").distinct()
    return dictation.cleaned(t, "transcript_id", "text").withColumn("ranges", F.array_join("ranges", "; "))


def _made_pairs(spark, sf_dir):
    a, b = _text_pairs(spark, sf_dir)
    return a.withColumnRenamed("text", "source").join(b.withColumnRenamed("text", "output"), "transcript_id")


def reconciliation_plan(spark, sf_dir):
    return reconcile.plan(_made_pairs(spark, sf_dir), "transcript_id", "source", "output")


def reconciled(spark, sf_dir):
    return reconcile.auto_restored(_made_pairs(spark, sf_dir), "transcript_id", "source", "output")


def audit_verdicts(spark, sf_dir):
    return _made_pairs(spark, sf_dir).select("transcript_id", reconcile.audit_summary(F.col("source"), F.col("output")).alias("a")).select("transcript_id", "a.*")


def _memories(spark, sf_dir):
    return read(spark, sf_dir, "memories").where("memory_id is not null").dropDuplicates(["memory_id"]).withColumn("owner", F.concat_ws("/", "tenant", "doctor"))


def memory_replayed(spark, sf_dir):
    m = _memories(spark, sf_dir).select(F.col("memory_id").alias("seq"), "owner", "kind", "concept", "content")
    return memory.replayed(m, ("style_rule", "episodic_case")).select("owner", "kind", F.lower("concept").alias("concept"), memory.content_key(F.col("content")).alias("content"), "confidence")


def memory_retrieved(spark, sf_dir):
    """For every tenth memory's content the memories of its owner that serve it best."""
    m = _memories(spark, sf_dir).where("owner is not null and content is not null and vector is not null")
    q = m.where("memory_id % 10 = 0").select(F.col("memory_id").alias("query"), "owner", F.col("content").alias("text"), "embedder", "vector")
    return memory.retrieved(q, m.select("memory_id", "owner", "content", "embedder", "vector", F.coalesce("confidence", F.lit(1.0)).alias("confidence"), "last_used", "created"), "2026-01-01")


def memory_reinforced(spark, sf_dir):
    m = _memories(spark, sf_dir)
    got = memory.reinforced(m.select("memory_id", "uses", "last_used"), memory_retrieved(spark, sf_dir).where("rank = 1"), "2026-01-01")
    return got.groupBy(F.coalesce(F.col("last_used") == "2026-01-01", F.lit(False)).alias("fresh")).agg(F.count(F.lit(1)).alias("n"), F.sum("uses").alias("uses"))


def library_terms(spark, sf_dir):
    t = read(spark, sf_dir, "chunks").dropDuplicates(["chunk_id"]).where("source is not null")
    return library.mined(t, "source", "text")


def _library(spark, sf_dir):
    e = read(spark, sf_dir, "corpus_terms").dropDuplicates(["entry_id"]).where("sources is not null").select("term", F.explode("sources").alias("source", "n"))
    return library.entries(e)


def library_entries(spark, sf_dir):
    return _library(spark, sf_dir).select("key", "n", F.size("sources").cast("bigint").alias("files"))


def library_top(spark, sf_dir):
    return library.top_terms(_library(spark, sf_dir), 50).select(documents.term_key(F.col("term")).alias("term"), "n")


def relevant_terms(spark, sf_dir):
    t = read(spark, sf_dir, "transcriptions").where("text is not null").groupBy("transcript_id").agg(F.min("text").alias("text"))
    return library.relevant(t, _library(spark, sf_dir), "transcript_id", "text", 10).select("transcript_id", documents.term_key(F.col("term")).alias("term"), "score", F.col("n").alias("count"))


def term_suggestions(spark, sf_dir):
    t = read(spark, sf_dir, "transcriptions").where("text is not null").groupBy("transcript_id").agg(F.min("text").alias("text"))
    return documents.suggestions(t, read(spark, sf_dir, "corpus_terms").where("term is not null"), "transcript_id", "text")


def speech_hints(spark, sf_dir):
    t = _library(spark, sf_dir).groupBy(F.substring("key", 1, 1).alias("letter")).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "key"))), lambda x: x["key"]).alias("parts"))
    return t.select("letter", library.hint(F.col("parts"), 200).alias("hint"))


def stream_replay(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    base = f"{shared_dir(spark)}/events-{uuid.uuid4().hex}"
    # the stream source takes a folder or glob; a table that is one file is named by its folder
    return replay.replay(spark, f"{sf_dir}/events.parquet*", e.schema, base).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def routed_reports(spark, sf_dir):
    r = store.latest(read(spark, sf_dir, "records"))
    return intake.routed(r, read(spark, sf_dir, "referrers"), "id", "report_text")


def event_windows(spark, sf_dir):
    return replay.event_counts(read(spark, sf_dir, "events")).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def confidence_by_engine(spark, sf_dir):
    o = read(spark, sf_dir, "ocr_results").dropDuplicates(["page_id"])
    return o.groupBy("engine").agg(F.count(F.lit(1)).alias("pages"), F.round(F.avg(F.when(F.col("confidence") > 0, F.col("confidence"))), 4).alias("confidence"))


def critical_impressions(spark, sf_dir):
    s = read(spark, sf_dir, "structured_reports").dropDuplicates(["report_id"]).select("tenant", "report_id", F.explode("impression").alias("i")).where("i is not null")
    return s.groupBy("tenant").agg(F.count_if("i.is_critical").alias("critical"), F.count(F.lit(1)).alias("n"))


def report_measurements(spark, sf_dir):
    return documents.measurements(store.latest(read(spark, sf_dir, "records")))


def term_reasons(spark, sf_dir):
    w = read(spark, sf_dir, "documents").where("text is not null").select(F.explode(F.array_distinct(text.tokens(F.col("text")))).alias("word"))
    return w.select(documents.term_reason(F.col("word")).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


_EXTRA = (
    report_blocks, report_fields, report_drafts, structured_reports, draft_guard, draft_badges, guideline_advice, section_lines, report_measurements, anatomy_placed,
    anatomy_counts, anatomy_paths, term_reasons, deid_clean, near_terms,
    latest_records, event_tail, commits_accepted, capped_history, imported_once, without_deleted, tenants, trail_transitions, urgency_counts, urgency_rollup,
    worklist, priors, measure_compare, delta_summary, triage_levels, negation_polarity, quality_findings, quality_histogram, impression_proposals, token_counts,
    bag_difference, missing_numbers, sentence_counts, sentence_contexts, patient_slugs, modalities, sound_keys, hl7_names, unit_style, bigrams, trigrams,
    packed_chunks, hash_vectors, vector_search, memory_strength, memory_replayed, memory_retrieved, memory_reinforced, profile_stats, chain_links, chain_status, trail_checks,
    kept_versions, keyed_hashes, sealed_round_trip, pasted_parts, oru_messages, oru_fields, order_round_trip, fhir_reports, alerts, header_checks, intake_texts, batch_manifest,
    batch_totals, dictation_clean, reconciliation_plan, reconciled, audit_verdicts, library_terms, library_entries, library_top, relevant_terms, term_suggestions, speech_hints,
    unique_filenames, routed_reports, event_windows, stream_replay, confidence_by_engine, critical_impressions,
)

QUERIES = {f.__name__: f for f in (p2_found, p2_sizes, p2_accuracy, p5_found, p5_subtrees, p5_bridge, *_EXTRA)}
