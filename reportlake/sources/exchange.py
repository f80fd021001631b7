"""Exchange with other systems: HL7 frames and answers, FHIR bundles, alerts, image headers, web archives."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportlake import vocabulary as v
from reportlake.functions.text import hl7_escape, hl7_name
from reportlake.operators.report import blocks, texts_under
from reportlake.sources.intake import hl7_field

# Frame marks of the transport, largest message, codes of the report's lines.
START, END = "\x0b", "\x1c"
MAX_MESSAGE = 1_000_000
FINDINGS_CODE = "59776-5^Procedure findings^LN"
IMPRESSION_CODE = "19005-8^Radiology imaging study impression^LN"
# Modality codes of image headers with the words a report claims them by.
HEADER_MODALITIES = {
    "US": ("USG", ("usg", "ultrasound", "sonography", "doppler")), "CT": ("CT", ("ct", "hrct", "computed tomography")), "MR": ("MRI", ("mri", "mr", "magnetic resonance")),
    "CR": ("X-Ray", ("x-ray", "xray", "radiograph")), "DX": ("X-Ray", ("x-ray", "xray", "radiograph")), "MG": ("Mammography", ("mammography", "mammogram")),
}
FEMALE_ONLY = ("uterus", "uterine", "ovary", "ovaries", "ovarian", "endometrium", "cervix", "adnexa")
MALE_ONLY = ("prostate", "prostatic", "seminal vesicles?", "testis", "testes", "testicular", "scrotum", "epididymis")


def framed(message: Column) -> Column:
    return F.concat(F.lit(START), message, F.lit(END + "\r"))


def unframed(stream: Column) -> Column:
    """STRUCT ``messages, rest, too_long`` of a byte stream as text: all complete messages and
    what is left for the next read.  A rest beyond a megabyte is flagged, not kept."""
    parts = F.split(stream, END)
    whole = F.slice(parts, F.lit(1), F.size(parts) - 1)
    messages = F.transform(F.filter(whole, lambda p: F.contains(p, F.lit(START))), lambda p: F.element_at(F.split(p, START, 2), 2))
    last = F.element_at(parts, -1)
    rest = F.when(F.contains(last, F.lit(START)), F.substr(last, F.instr(last, START))).otherwise("")
    return F.struct(messages.alias("messages"), F.when(F.length(rest) <= MAX_MESSAGE, rest).otherwise("").alias("rest"), (F.length(rest) > MAX_MESSAGE).alias("too_long"))


def answer(message: Column, code: str = "AA", said: Column | None = None, now: str = "") -> Column:
    """The acknowledgement of a message; ``said`` adds a reason of at most 180 characters."""
    of = F.coalesce(F.nullif(hl7_field(message, "MSH", 10), F.lit("")), F.lit("UNKNOWN"))
    reason = F.when(said != "", F.concat(F.lit("|"), F.left(F.translate(said, "|\r", "  "), F.lit(180)))).otherwise("") if said is not None else F.lit("")
    return F.concat(F.lit(f"MSH|^~\\&|REPORTS|CLINIC|||{now}||ACK|"), of, F.lit(f"-ACK|P|2.5\rMSA|{code}|"), of, reason, F.lit("\r"))


def accepted(reply: Column) -> Column:
    """STRUCT ``ok, detail`` of an acknowledgement; only AA lets a message count as delivered."""
    code = hl7_field(reply, "MSA", 1)
    return F.struct((code == "AA").alias("ok"), F.concat_ws(" ", code, F.nullif(hl7_field(reply, "MSA", 3), F.lit(""))).alias("detail"))


def hl7_time(iso: Column) -> Column:
    """``YYYYMMDDHHMMSS`` of an ISO time, empty where there is none."""
    stamp = F.try_to_timestamp(F.rpad(F.left(F.replace(iso, F.lit("T"), F.lit(" ")), F.lit(19)), 19, ":00"), F.lit("yyyy-MM-dd HH:mm:ss"))
    return F.coalesce(F.date_format(stamp, "yyyyMMddHHmmss"), F.lit(""))


def sex_letter(age_sex: Column) -> Column:
    word = F.lower(F.regexp_extract(F.coalesce(age_sex, F.lit("")), r"(?i)(female|male|(?<![a-z])[mf](?![a-z]))", 1))
    return F.upper(F.left(word, F.lit(1)))


def result_message() -> Column:
    """An ORU^R01 message of the columns id, tenant, patient, age_sex, study, urgency,
    created, referrer, signed_at, updated, status, report_text: every non-blank line of the
    report, then every line of its impression, numbered through."""
    text = F.coalesce("report_text", F.lit(""))
    safe = lambda c, other="": hl7_escape(F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(other)))
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), F.trim), lambda x: x != "")
    concluded = F.coalesce(texts_under(blocks(F.col("report_text")), v.IMPRESSION), F.array().cast("array<string>"))
    coded = F.concat(
        F.transform(lines, lambda x: F.struct(F.lit(FINDINGS_CODE).alias("code"), x.alias("x"))), F.transform(concluded, lambda x: F.struct(F.lit(IMPRESSION_CODE).alias("code"), x.alias("x")))
    )
    obx = F.transform(coded, lambda e, i: F.concat(F.lit("OBX|"), (i + 1).cast("string"), F.lit("|TX|"), e["code"], F.lit("||"), hl7_escape(e["x"]), F.lit("||||||F")))
    done = F.when(F.col("status").isin("signed", "delivered"), "F").otherwise("P")
    signed = F.coalesce(F.nullif("signed_at", F.lit("")), F.col("updated"))
    head = F.array(
        F.concat(F.lit("MSH|^~\\&|REPORTS|"), safe("tenant", "CLINIC"), F.lit("|RIS|HOSPITAL|"), hl7_time(F.col("updated")), F.lit("||ORU^R01^ORU_R01|"), F.col("id"), F.lit("|P|2.5")),
        F.concat(F.lit("PID|1||||"), hl7_name(F.col("patient")), F.lit("|||"), sex_letter(F.col("age_sex"))),
        F.concat(
            F.lit("OBR|1||"), safe("id"), F.lit("|IMG^"), safe("study", "RADIOLOGY REPORT"), F.lit("|"), F.when(F.col("urgency") == "stat", "S").otherwise("R"), F.lit("||"),
            hl7_time(F.col("created")), F.repeat(F.lit("|"), F.lit(9)), safe("referrer"), F.repeat(F.lit("|"), F.lit(6)), hl7_time(signed), F.lit("|||"), done,
        ),
    )
    return F.concat(F.array_join(F.concat(head, obx), "\r"), F.lit("\r"))


def bundle() -> Column:
    """A FHIR R4 collection of the Patient and the DiagnosticReport in JSON, from the same
    columns and patient_key; null fields are left out."""
    sex = sex_letter(F.col("age_sex"))
    patient_id = F.left(F.concat(F.lit("patient-"), F.coalesce(F.nullif("patient_key", F.lit("")), F.lit("unknown"))), F.lit(64))
    title = F.coalesce(F.nullif("study", F.lit("")), F.lit("Radiology report"))
    concluded = F.array_join(texts_under(blocks(F.col("report_text")), v.IMPRESSION), "\n")
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    patient = F.struct(
        F.lit("Patient").alias("resourceType"), patient_id.alias("id"), F.when(filled("patient").isNotNull(), F.array(F.struct(F.col("patient").alias("text")))).alias("name"),
        F.when(sex == "F", "female").when(sex == "M", "male").alias("gender"),
    )
    coding = lambda system, code, display: F.array(F.struct(F.lit(system).alias("system"), F.lit(code).alias("code"), F.lit(display).alias("display")))
    report = F.struct(
        F.lit("DiagnosticReport").alias("resourceType"), F.concat(F.lit("report-"), "id").alias("id"),
        F.when(F.col("status").isin("signed", "delivered"), "final").otherwise("preliminary").alias("status"),
        F.array(F.struct(coding("http://terminology.hl7.org/CodeSystem/v2-0074", "RAD", "Radiology").alias("coding"))).alias("category"),
        F.struct(coding("http://loinc.org", "18748-4", "Diagnostic imaging study").alias("coding"), title.alias("text")).alias("code"),
        F.struct(F.concat(F.lit("Patient/"), patient_id).alias("reference")).alias("subject"), F.coalesce(filled("signed_at"), F.col("updated")).alias("issued"),
        F.array(F.struct(F.lit("text/plain").alias("contentType"), F.base64(F.encode(F.coalesce("report_text", F.lit("")), "UTF-8")).alias("data"), title.alias("title"))).alias("presentedForm"),
        filled("created").alias("effectiveDateTime"), F.nullif(concluded, F.lit("")).alias("conclusion"),
        F.when(filled("referrer").isNotNull(), F.array(F.struct(F.concat(F.lit("Referred by "), "referrer").alias("display")))).alias("basedOn"),
    )
    # entries of two shapes: joined as text
    return F.concat(F.lit('{"resourceType":"Bundle","type":"collection","entry":[{"resource":'), F.to_json(patient), F.lit('},{"resource":'), F.to_json(report), F.lit("}]}"))


def alert() -> Column:
    """STRUCT ``subject, body, short`` of the message about an urgent report; the short one
    has at most 320 characters."""
    filled = lambda c, other: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(other))
    urgency, who = F.upper(filled("urgency", "routine")), filled("patient", "an unnamed patient")
    found = F.coalesce(F.nullif(F.array_join(F.filter("triage_terms", lambda t: t.isNotNull()), ", "), F.lit("")), F.lit("critical finding"))
    study = filled("study", "a radiology study")
    body = F.concat(
        F.lit("Dear "), filled("referrer", "Doctor"), F.lit(",\n\nA "), urgency, F.lit(" finding needs your attention.\n\nPatient: "), who, F.lit(" ("), filled("age_sex", "age/sex not stated"),
        F.lit(")\nStudy: "), study, F.lit("\nFinding: "), found, F.lit("\nSigned: "), F.coalesce(F.nullif("signed_at", F.lit("")), "updated", F.lit("")), F.lit(" by "),
        filled("signed_by", "the reporting radiologist"), F.lit("\n\nThe full report follows. Please acknowledge receipt."),
    )
    return F.struct(
        F.concat(F.lit("["), urgency, F.lit("] "), found, F.lit(" - "), who).alias("subject"), body.alias("body"),
        F.left(F.concat(urgency, F.lit(": "), found, F.lit(". "), who, F.lit(", "), study, F.lit(". Full report to follow.")), F.lit(320)).alias("short"),
    )


# image headers

# Tags of an image header that are read, (group, element) -> name.
TAGS = {
    (0x0010, 0x0010): "patient", (0x0010, 0x0040): "sex", (0x0010, 0x1010): "age", (0x0008, 0x0060): "modality", (0x0008, 0x1030): "study", (0x0018, 0x0015): "body_part",
    (0x0020, 0x0060): "laterality", (0x0008, 0x0020): "date", (0x0008, 0x0080): "institution", (0x0020, 0x000D): "study_uid",
}
_LONG = {b"OB", b"OW", b"OF", b"SQ", b"UT", b"UN", b"OD", b"OL", b"UC", b"UR", b"OV", b"SV", b"UV"}
HEADER = ", ".join(f"{n} string" for n in TAGS.values())


def header_of(data: bytes) -> dict[str, str] | None:
    """Named elements of an image file's header (little endian, explicit or implicit value
    types), read up to the pixels; None where the file is none."""
    if len(data) < 132 or data[128:132] != b"DICM":
        return None
    out, at, explicit, syntax = dict.fromkeys(TAGS.values(), ""), 132, True, ""
    while at + 8 <= len(data):
        group, element = struct.unpack_from("<HH", data, at)
        if group > 2 and syntax == "1.2.840.10008.1.2":
            explicit = False
        if (group, element) == (0x7FE0, 0x0010):
            break
        if explicit or group == 2:
            kind = data[at + 4 : at + 6]
            size, head = (struct.unpack_from("<I", data, at + 8)[0], 12) if kind in _LONG else (struct.unpack_from("<H", data, at + 6)[0], 8)
        else:
            kind, size, head = b"", struct.unpack_from("<I", data, at + 4)[0], 8
        if size == 0xFFFFFFFF:
            end = data.find(b"\xfe\xff\xdd\xe0", at + head)
            at = len(data) if end < 0 else end + 8
            continue
        value = data[at + head : at + head + size].rstrip(b"\0 ").decode("utf-8", "replace").strip()
        if (group, element) == (2, 0x10):
            syntax = value
        if (group, element) in TAGS:
            out[TAGS[group, element]] = value
        at += head + size
    return out


def image_headers(files: DataFrame, content: str = "content", key: str = "path") -> DataFrame:
    """``path, <tags>, age_years, study_date, laterality, problem`` of image files.

    Ages in days and weeks are 0 years, in months a twelfth; a file that is no image has
    ``problem`` set and null elsewhere."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, c in zip(b["k"], b["c"], strict=True):
                got = header_of(bytes(c)) if c is not None else None
                rows.append((k, *(got[n] if got else None for n in TAGS.values()), None if got else "not an image file"))
            yield pd.DataFrame(rows, columns=[key, *TAGS.values(), "problem"])

    raw = files.select(F.col(key).alias("k"), F.col(content).alias("c")).mapInPandas(read, f"`{key}` string, {HEADER}, problem string")
    number, unit = F.regexp_extract("age", r"^(\d+)[DWMY]$", 1).try_cast("int"), F.regexp_extract("age", r"^\d+([DWMY])$", 1)
    years = F.when(unit.isin("D", "W"), 0).when(unit == "M", F.floor(number / 12).cast("int")).otherwise(number)
    return raw.withColumns(
        {
            "age_years": years, "study_date": F.when(F.col("date").rlike(r"^\d{8}$"), F.regexp_replace("date", r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")).otherwise(F.when(F.col("date").isNotNull(), "")),
            "patient": F.trim(F.replace("patient", F.lit("^"), F.lit(" "))), "sex": F.left(F.upper("sex"), F.lit(1)), "modality": F.upper("modality"),
            "laterality": F.when(F.upper("laterality").isin("L", "R"), F.upper("laterality")).otherwise(F.when(F.col("laterality").isNotNull(), "")),
        }
    ).drop("age", "date")


def cross_checks(pairs: DataFrame, key: str) -> DataFrame:
    """``key, check, severity`` of reports against the header of their study.

    ``pairs``: key, report_text, patient, age_sex and header_patient, header_sex,
    header_age, header_modality, header_laterality.  Checked are the side, organs of the
    other sex, names without a common word, ages more than two years apart, and a modality
    that the first 400 characters claim instead."""
    text = F.coalesce("report_text", F.lit(""))
    has = lambda c, words: c.rlike(f"(?i){v.any_word(words)}")
    left, right = has(text, v.SIDES["left"]), has(text, v.SIDES["right"])
    names = lambda c: F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), rf"\b(?:{'|'.join(v.NAME_TITLES)})\b\.?", " "), "[^a-z]+"), lambda w: F.length(w) > 1)
    a, b = names(F.col("header_patient")), names(F.col("patient"))
    age = F.regexp_extract(F.lower(F.coalesce("age_sex", F.lit(""))), r"(\d{1,3})\s*(?:y(?:ea)?rs?|y\b)", 1).try_cast("int")
    head = F.lower(F.left(text, F.lit(400)))
    claimed = F.filter(F.array(*(F.when(has(head, words), F.lit(name)) for name, words in dict(HEADER_MODALITIES.values()).items())), lambda x: x.isNotNull())
    meant = F.lit(None).cast("string")
    for code, (name, _) in HEADER_MODALITIES.items():
        meant = F.when(F.col("header_modality") == code, name).otherwise(meant)
    row = lambda check, severity: F.struct(F.lit(check).alias("check"), F.lit(severity).alias("severity"))
    found = F.array(
        F.when(((F.col("header_laterality") == "L") & right & ~left) | ((F.col("header_laterality") == "R") & left & ~right), row("side", "critical")),
        F.when(((F.col("header_sex") == "M") & has(text, FEMALE_ONLY)) | ((F.col("header_sex") == "F") & has(text, MALE_ONLY)), row("sex", "critical")),
        F.when((F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b), row("patient", "critical")),
        F.when(F.abs(age - F.col("header_age")) > 2, row("age", "warning")),
        F.when(meant.isNotNull() & (F.size(claimed) > 0) & ~F.array_contains(claimed, meant), row("modality", "warning")),
    )
    return pairs.select(key, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("c")).select(key, "c.*")


# web archives


def study_rows(replies: DataFrame, json: str = "json") -> DataFrame:
    """``study_uid, patient, date, modality, description`` of a study search's JSON reply (an
    array of tag maps): the first value of each tag, names with spaces."""
    shape = "array<map<string,struct<vr:string,Value:array<string>>>>"
    rows = replies.select(F.explode(F.from_json(json, shape)).alias("m"))
    tag = lambda t: F.coalesce(F.get(F.try_element_at(F.col("m"), F.lit(t))["Value"], F.lit(0)), F.lit(""))
    name = F.coalesce(F.get_json_object(tag("00100010"), "$.Alphabetic"), tag("00100010"))
    return rows.select(
        tag("0020000D").alias("study_uid"), F.trim(F.replace(name, F.lit("^"), F.lit(" "))).alias("patient"), tag("00080020").alias("date"),
        F.coalesce(F.nullif(tag("00080061"), F.lit("")), tag("00080060")).alias("modality"), tag("00081030").alias("description"),
    )


def study_search(studies: DataFrame, name: str = "", date_from: str = "", date_to: str = "", modality: str = "") -> DataFrame:
    """Studies by a name with ``*`` wildcards, a range of dates and a modality; what is
    empty does not restrict."""
    out = studies
    if name:
        out = out.where(F.upper("patient").like(name.upper().replace("%", r"\%").replace("_", r"\_").replace("*", "%") + ("" if "*" in name else "%")))
    if date_from or date_to:
        out = out.where(F.col("date").between(date_from or "00000000", date_to or date_from or "99999999"))
    return out.where(F.col("modality") == modality.upper()) if modality else out


def first_part(body: bytes, boundary: str) -> bytes:
    """The first part of a multipart body without its headers; the body itself where it has none."""
    parts = body.split(b"--" + boundary.encode())
    if len(parts) < 2:
        return body
    head, mark, data = parts[1].partition(b"\r\n\r\n")
    data = data if mark else head
    return data[:-2] if data.endswith(b"\r\n") else data


def ocr_lines(words: DataFrame, key: str = "page_id") -> DataFrame:
    """``page, line_no, line, confidence`` from a table of recognised words (block, par,
    line, word_no, text, conf): lines in reading order with their mean confidence."""
    lines = words.where("trim(text) <> ''").groupBy(key, "block", "par", "line").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_no", "text"))), lambda x: x["text"]), " ").alias("text"), F.avg(F.when(F.col("conf") >= 0, F.col("conf"))).alias("confidence")
    )
    from pyspark.sql import Window

    return lines.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("block", "par", "line")) - 1).alias("line_no"), F.col("text").alias("line"), F.round("confidence", 1).alias("confidence"))


def received(index: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """``study_uid, patient, modality, images, last_seen, paths`` of received images, newest
    first; images whose file is gone (not in ``sizes``: path, length) do not count, and a
    study without any is left out."""
    rows = index if sizes is None else index.join(sizes.where("length > 0").select("path"), "path", "left_semi")
    return rows.groupBy("study_uid").agg(
        F.min_by("patient", "when_").alias("patient"), F.min_by("modality", "when_").alias("modality"), F.countDistinct("path").alias("images"), F.max("when_").alias("last_seen"),
        F.array_sort(F.collect_set("path")).alias("paths"),
    ).orderBy(F.desc("last_seen"), "study_uid")


def purged(index: DataFrame, study_uid: str) -> DataFrame:
    return index.where(~F.col("study_uid").eqNullSafe(F.lit(study_uid)))
