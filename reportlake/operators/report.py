"""Report parser: lines to typed blocks, and what is read from blocks.

A report is parsed inside its row: lines, headings and the section each line stands under
are arrays, so no text is shuffled and a report of any length needs one task's row only.
Blocks are ``kind, text, trailer, section, marker``; kind is ``title``, ``heading``,
``heading_inline``, ``subheading``, ``bullet``, ``bold_bullet``, ``text`` or ``verbatim``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportlake import vocabulary as v
from reportlake.functions.text import let, modality, patient_slug, sentences, strip_marker

BLOCK = "struct<kind:string,text:string,trailer:string,section:string,marker:string>"
_HEADING = rf"(?is)^[\s•*–—-]*({v.longest_first(v.HEADINGS)})\s*(?:([:–—-])(.*)|)$"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def lines_of(text: Column) -> Column:
    return F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")


def is_subheading(line: Column) -> Column:
    """The shape of an organ label: a colon at the end, or a few words without a sentence end."""
    words = F.size(F.filter(F.split(line, r"(?U)\s+"), lambda w: w != ""))
    few = (F.length(line) <= v.SUBHEADING_CHARS) & (words <= v.SUBHEADING_WORDS) & ~line.rlike(r"[.,;]$")
    return (line != "") & (line.endswith(":") | (few & (~line.rlike(r"(?U)\d") | line.rlike(r"^[A-Za-z ]+ ?\d*$"))))


def is_sign_off(line: Column) -> Column:
    low = F.lower(line)
    return F.exists(F.array(*map(F.lit, v.SIGN_OFF)), lambda hint: F.contains(low, hint))


def _block(kind: str, text: Column, section: Column, trailer: Column | None = None, marker: Column | None = None) -> Column:
    empty = F.lit("")
    return F.struct(
        F.lit(kind).alias("kind"), text.alias("text"), (empty if trailer is None else trailer).alias("trailer"), section.alias("section"),
        (empty if marker is None else marker).alias("marker"),
    )


def _content(line: Column, section: Column, marker: Column, split: bool, bold_tail: bool) -> Column:
    """Blocks of one line below a heading."""
    parts = F.filter(F.transform(F.split(line, r"(?<=[.;])\s+(?=[A-Z(])"), strip), lambda p: p != "") if split else F.array(line)
    each = lambda kind, texts: F.transform(texts, lambda p, i: _block(kind, p, section, marker=F.when(i == 0, marker).otherwise("")))
    one = lambda kind: F.array(_block(kind, line, section, marker=marker))
    label, body = F.regexp_extract(line, r"(?s)^([^:\n]{1,60}?)\s*:\s*(.*)$", 1), strip(F.regexp_extract(line, r"(?s)^([^:\n]{1,60}?)\s*:\s*(.*)$", 2))
    bodies = F.filter(F.transform(F.split(body, r"(?<=[.;])\s+(?=[A-Z(])"), strip), lambda p: p != "") if split else F.array(body)
    labelled = F.concat(
        F.array(_block("subheading", F.concat(strip(label), F.lit(":")), section)), F.transform(bodies, lambda p: _block("bullet", p, section))
    )
    bold = section.isin(*v.IMPRESSION) | (section.isin(*v.TAIL) if bold_tail else F.lit(False))
    return (
        F.when(
            section.isin(*v.FINDINGS),
            F.when(is_subheading(line), one("subheading")).when(is_sign_off(line), one("text"))
            .when((strip(label) != "") & (body != ""), labelled).otherwise(each("bullet", parts)),
        )
        .when(bold, F.when(is_sign_off(line), one("text")).otherwise(each("bold_bullet", parts)))
        .when(section.isin(*v.TAIL) & ~is_sign_off(line), one("bullet"))
        .otherwise(one("text"))
    )


def blocks(text: Column, split: bool = False, bold_tail: bool = False, inline: bool = True, verbatim: bool = False) -> Column:
    """ARRAY of blocks of a report text; null for null, empty for blank texts.

    ``split``: several sentences of a line become bullets of their own; ``bold_tail``:
    comments and advice are set like an impression; ``inline``: short headings keep their
    value; ``verbatim``: one block per line, nothing changed, blank lines at the end dropped."""
    if verbatim:
        kept = F.split(F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), r"(?U)\s*\n\s*$|^\s+$", ""), "\n")
        return F.when(strip(text) != "", F.transform(kept, lambda x: _block("verbatim", x, F.lit("")))).when(text.isNotNull(), F.array().cast(f"array<{BLOCK}>"))
    lines = F.filter(F.transform(lines_of(text), strip), lambda x: x != "")
    heads = lambda lines: F.transform(
        lines,
        lambda x, i: F.when(
            (i > 0) & x.rlike(_HEADING),
            F.struct(
                F.upper(F.regexp_extract(x, _HEADING, 1)).alias("name"), F.regexp_extract(x, _HEADING, 2).alias("mark"),
                strip(F.regexp_extract(x, _HEADING, 3)).alias("rest"),
            ),
        ),
    )
    start = F.array(F.lit("GENERAL"))
    under = lambda heads: F.aggregate(heads, start, lambda acc, h: F.concat(acc, F.array(F.coalesce(h.getField("name"), F.element_at(acc, -1)))))
    zipped = let(lines, lambda xs: let(heads(xs), lambda hs: F.arrays_zip(xs.alias("line"), hs.alias("head"), F.slice(under(hs), 2, F.size(xs)).alias("under"))))

    def made(z: Column, i: Column) -> Column:
        line, head, section = z["line"], z["head"], z["under"]
        title = F.array(_block("title", F.upper(line), F.lit("")))
        written = F.concat(head["name"], F.when(head["mark"] == ":", ":").otherwise(""))
        kept = F.array(_block("heading_inline", written, section, trailer=head["rest"]))
        alone = F.array(_block("heading", written, section))
        headed = F.concat(alone, F.when(head["rest"] != "", _content(head["rest"], section, F.lit(""), split, bold_tail)).otherwise(F.array().cast(f"array<{BLOCK}>")))
        bare = strip(strip_marker(line))
        marker = F.when(bare != line, strip(F.left(line, F.length(line) - F.length(bare)))).otherwise("")
        body = F.when(bare != "", _content(bare, section, marker, split, bold_tail)).otherwise(F.array().cast(f"array<{BLOCK}>"))
        with_value = (head["rest"] != "") & section.isin(*v.INLINE_HEADINGS) & F.lit(inline)
        return F.when(i == 0, title).when(head.isNotNull(), F.when(with_value, kept).otherwise(headed)).otherwise(body)

    return F.when(text.isNotNull(), F.flatten(F.transform(zipped, made)))


def with_blocks(reports: DataFrame, text: str = "report_text", **options: bool) -> DataFrame:
    """Adds ``blocks``, bound once: everything read from a report starts from it."""
    return reports.withColumn("blocks", blocks(F.col(text), **options))


def block_rows(reports: DataFrame, key: str = "id", text: str = "report_text", **options: bool) -> DataFrame:
    """``key, pos, kind, text, trailer, section, marker``: one row per block."""
    return with_blocks(reports.select(key, text), text, **options).select(key, F.posexplode("blocks").alias("pos", "b")).select(key, "pos", "b.*")


HEADS = ("heading", "heading_inline")


def texts_under(parsed: Column, sections: tuple[str, ...], with_headings: bool = False) -> Column:
    """The lines under the given headings, values on the heading's own line included.

    ``with_headings`` keeps the heading lines too, as one caller of the old engine did."""
    inside = F.filter(parsed, lambda b: b["section"].isin(*sections) & (b["kind"] != "title"))
    lines = F.transform(
        inside, lambda b: F.when(b["kind"].isin(*HEADS), F.concat_ws(" ", b["text"], F.nullif(b["trailer"], F.lit(""))) if with_headings else b["trailer"]).otherwise(b["text"])
    )
    return F.filter(lines, lambda x: strip(x) != "")


def warnings(parsed: Column) -> Column:
    """What the parser has to say about a report."""
    heads = F.transform(F.filter(parsed, lambda b: b["kind"].isin(*HEADS)), lambda b: b["section"])
    has = lambda names: F.arrays_overlap(heads, F.array(*map(F.lit, names)))
    said = F.array(
        F.when(F.size(parsed) == 0, "empty"), F.when((F.size(parsed) > 0) & ~has(v.FINDINGS), "no findings heading"),
        F.when((F.size(parsed) > 0) & ~has(v.IMPRESSION), "no impression heading"),
    )
    return F.filter(said, lambda x: x.isNotNull())


def fields(parsed: Column) -> Column:
    """STRUCT patient, age_sex, referrer, study_date, study from blocks.

    A value stands on the line of its heading, or is the first block after it; the first
    value of a field counts, and a heading is no longer waiting once another follows."""
    value_of = F.create_map(*(F.lit(x) for f, names in v.FIELDS.items() for n in names for x in (n, f)))
    start = F.struct(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("got"), F.lit("").alias("waits"))

    def step(s: Column, b: Column) -> Column:
        field = F.coalesce(F.try_element_at(value_of, b["section"]), F.lit(""))
        free = (field != "") & F.coalesce(F.try_element_at(s["got"], field), F.lit("")).eqNullSafe("")
        put = lambda name, x: F.map_concat(F.map_filter(s["got"], lambda k, _: k != name), F.map_from_arrays(F.array(name), F.array(x)))
        got = (
            F.when((b["kind"] == "heading_inline") & free, put(field, strip(b["trailer"])))
            .when(~b["kind"].isin("title", *HEADS) & (s["waits"] != "") & (strip(b["text"]) != ""), put(s["waits"], strip(b["text"])))
            .otherwise(s["got"])
        )
        waits = (
            F.when(b["kind"] == "heading", F.when(free, field).otherwise(""))
            .when(b["kind"].isin("title", "heading_inline"), s["waits"]).when((s["waits"] != "") & (strip(b["text"]) != ""), "").otherwise(s["waits"])
        )
        return F.struct(got.alias("got"), waits.alias("waits"))

    got = F.aggregate(parsed, start, step)["got"]
    title = F.get(F.filter(parsed, lambda b: b["kind"] == "title"), F.lit(0))["text"]
    return F.struct(*(F.coalesce(F.try_element_at(got, F.lit(f)), F.lit("")).alias(f) for f in v.FIELDS), F.coalesce(strip(title), F.lit("")).alias("study"))


def organs(parsed: Column) -> Column:
    """MAP organ label -> text of the findings under it, empty ones left out; lines
    before the first label stand under ``General``."""
    state = F.struct(F.lit("General").alias("organ"), F.array().cast("array<struct<organ:string,line:string>>").alias("rows"))

    def step(s: Column, b: Column) -> Column:
        named = F.coalesce(F.nullif(strip(F.regexp_replace(b["text"], ":+$", "")), F.lit("")), F.lit("General"))
        organ = F.when(b["kind"].isin(*HEADS), "General").when(b["kind"] == "subheading", named).otherwise(s["organ"])
        takes = b["section"].isin(*v.FINDINGS) & ~b["kind"].isin("title", "subheading", *HEADS) & (strip(b["text"]) != "")
        return F.struct(organ.alias("organ"), F.when(takes, F.concat(s["rows"], F.array(F.struct(organ.alias("organ"), strip(b["text"]).alias("line"))))).otherwise(s["rows"]).alias("rows"))

    def grouped(rows: Column) -> Column:
        text = lambda n: F.array_join(F.transform(F.filter(rows, lambda r: r["organ"] == n), lambda r: r["line"]), " ")
        return let(F.array_distinct(F.transform(rows, lambda r: r["organ"])), lambda names: F.map_from_arrays(names, F.transform(names, text)))

    return let(F.aggregate(parsed, state, step)["rows"], grouped)


def structured(reports: DataFrame, key: str = "id", text: str = "report_text") -> DataFrame:
    """``key, study, clinical_history, technique, findings, impression``: the structured
    view of a report; impression items are numbered, critical where triage says stat, and
    placeholders among them are left out."""
    from reportlake.operators.clinical import triaged

    read = with_blocks(reports.select(key, text), text)
    items = F.transform(texts_under(F.col("blocks"), v.IMPRESSION), lambda x, i: F.struct((i + 1).alias("finding_id"), strip(x).alias("impression_text")))
    kept = F.filter(items, lambda x: ~F.lower(x["impression_text"]).isin(*v.EMPTY_IMPRESSIONS))
    judged = F.transform(kept, lambda x: F.struct(x["finding_id"], x["impression_text"], (triaged(x["impression_text"])["level"] == "stat").alias("is_critical")))
    return read.select(
        key, fields(F.col("blocks"))["study"].alias("study"), F.array_join(texts_under(F.col("blocks"), v.HISTORY), " ").alias("clinical_history"),
        F.array_join(texts_under(F.col("blocks"), v.TECHNIQUE), " ").alias("technique"), organs(F.col("blocks")).alias("findings"), judged.alias("impression"),
    )


def new_records(reports: DataFrame, key: str = "id", text: str = "report_text", source: str = "paste") -> DataFrame:
    """A draft record for every report text: fields, modality, patient key and urgency.

    Null texts give a record of empty fields and urgency ``routine``."""
    from reportlake.operators.clinical import triaged_blocks

    read = with_blocks(reports.select(key, text), text).select(key, text, "blocks", fields(F.coalesce("blocks", F.array().cast(f"array<{BLOCK}>"))).alias("f"))
    level = triaged_blocks(F.col("blocks"))
    return read.withColumn("t", level).select(
        key, F.lit("draft").alias("status"), F.lit(source).alias("source"), "f.patient", "f.age_sex", "f.referrer", "f.study", "f.study_date",
        modality(F.col("f.study")).alias("modality"), patient_slug(F.col("f.patient"), F.col("f.age_sex")).alias("patient_key"),
        F.coalesce("t.level", F.lit("routine")).alias("urgency"),
        F.coalesce(F.array_sort(F.array_distinct(F.transform("t.hits", lambda h: h["term"]))), F.array().cast("array<string>")).alias("triage_terms"),
    )


def render_text(parsed: Column) -> Column:
    """A report as plain text again: headings with their value, bullets marked."""
    line = lambda b: F.when(b["kind"] == "heading_inline", F.concat_ws(" ", b["text"], b["trailer"])).when(
        b["kind"].isin("bullet", "bold_bullet"), F.concat(F.lit("- "), b["text"])
    ).otherwise(b["text"])
    return F.array_join(F.transform(parsed, line), "\n")


def appended(text: Column, heading: str, line: Column) -> Column:
    """The report with a line put at its end under ``heading``, which is created when
    the report has none."""
    has = text.rlike(rf"(?im)^\s*{heading}S?\b\s*:?")
    return F.concat(F.regexp_replace(text, r"(?U)\s+$", ""), F.when(has, F.lit("\n- ")).otherwise(F.lit(f"\n\n{heading.upper()}:\n- ")), line)


def guess_replaced(text: Column, heard: Column, right: Column) -> Column:
    """The first ``[[heard]]``, else the first bare ``heard``, replaced by ``right``."""
    marked = F.concat(F.lit("[["), heard, F.lit("]]"))
    target = F.when(F.instr(text, marked) > 0, marked).otherwise(heard)
    at = F.instr(text, target)
    return F.when((at > 0) & (heard != ""), F.overlay(text, right, at, F.length(target))).otherwise(text)


def sentences_of(parsed: Column, sections: tuple[str, ...], style: str) -> Column:
    return sentences(F.array_join(texts_under(parsed, sections), "\n"), style)
