import pytest
from pyspark.sql import functions as F

from reportlake import vocabulary as v
from reportlake.operators import clinical, documents, report


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def texts(spark, *said):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(said)], "id string, report_text string")


REPORT = """USG ABDOMEN

Patient Name: Mrs. Sunita Devi
AGE/SEX - 45 / F
Referred by
Dr. A. Shah
CLINICAL HISTORY: rule out pulmonary embolism
FINDINGS:
Liver: normal in size; no focal lesion.
Spleen
1. Left kidney shows a 12 mm calculus
(b) Thanks for the referral
FINDINGS ARE AS ABOVE and more words follow here to make a sentence.
IMPRESSION
- Left renal calculus of 1.2 cm
Please correlate clinically
ADVICE:
* Repeat scan"""


def test_blocks(spark):
    got = [(r.kind, r.section, r.text, r.trailer, r.marker) for r in report.block_rows(texts(spark, REPORT)).orderBy("pos").collect()]
    assert got == [
        ("title", "", "USG ABDOMEN", "", ""),
        ("heading_inline", "PATIENT NAME", "PATIENT NAME:", "Mrs. Sunita Devi", ""),
        ("heading_inline", "AGE/SEX", "AGE/SEX", "45 / F", ""),
        ("heading", "REFERRED BY", "REFERRED BY", "", ""),
        ("text", "REFERRED BY", "Dr. A. Shah", "", ""),
        ("heading", "CLINICAL HISTORY", "CLINICAL HISTORY:", "", ""),
        ("text", "CLINICAL HISTORY", "rule out pulmonary embolism", "", ""),
        ("heading", "FINDINGS", "FINDINGS:", "", ""),
        ("subheading", "FINDINGS", "Liver:", "", ""),
        ("bullet", "FINDINGS", "normal in size; no focal lesion.", "", ""),
        ("subheading", "FINDINGS", "Spleen", "", ""),
        ("bullet", "FINDINGS", "Left kidney shows a 12 mm calculus", "", "1."),
        ("subheading", "FINDINGS", "Thanks for the referral", "", "(b)"),
        ("bullet", "FINDINGS", "FINDINGS ARE AS ABOVE and more words follow here to make a sentence.", "", ""),
        ("heading", "IMPRESSION", "IMPRESSION", "", ""),
        ("bold_bullet", "IMPRESSION", "Left renal calculus of 1.2 cm", "", "-"),
        ("text", "IMPRESSION", "Please correlate clinically", "", ""),
        ("heading", "ADVICE", "ADVICE:", "", ""),
        ("bullet", "ADVICE", "Repeat scan", "", "*"),
    ]


def test_block_options(spark):
    two = texts(spark, "T\nFINDINGS:\nOne thing of many words is here. Another (small) one is there.\nADVICE:\nx y")
    kinds = lambda **o: [(r.kind, r.text) for r in report.block_rows(two, **o).orderBy("pos").collect()]
    assert ("bullet", "Another (small) one is there.") in kinds(split=True) and ("bold_bullet", "x y") in kinds(bold_tail=True)
    assert kinds(verbatim=True)[0] == ("verbatim", "T") and len(kinds(verbatim=True)) == 5
    edge = report.with_blocks(texts(spark, None, "", " \n ", "title only"))
    assert [None if r.blocks is None else len(r.blocks) for r in edge.orderBy("id").collect()] == [None, 0, 0, 1]
    assert [r[0] for r in edge.where("blocks is not null").orderBy("id").select(report.warnings(F.col("blocks"))).collect()] == [["empty"], ["empty"], ["no findings heading", "no impression heading"]]


def test_fields_and_record(spark):
    r = report.with_blocks(texts(spark, REPORT, "x\nDATE\nFINDINGS:\n2024")).select("id", report.fields(F.col("blocks")).alias("f")).orderBy("id").collect()
    assert tuple(r[0].f) == ("Mrs. Sunita Devi", "45 / F", "Dr. A. Shah", "", "USG ABDOMEN") and r[1].f.study_date == ""
    rec = report.new_records(texts(spark, REPORT, None)).orderBy("id").collect()
    assert (rec[0].modality, rec[0].patient_key, rec[0].urgency) == ("USG", "sunita-devi-f", "routine") and rec[1].patient == ""


def test_structured(spark):
    s = report.structured(texts(spark, REPORT)).first()
    assert s.study == "USG ABDOMEN" and s.clinical_history == "rule out pulmonary embolism"
    assert s.findings["Liver"] == "normal in size; no focal lesion." and s.findings["Spleen"] == "Left kidney shows a 12 mm calculus"
    assert [(i.finding_id, i.is_critical) for i in s.impression] == [(1, False), (2, False)]


def test_rewriting(spark):
    one = lambda text, make: texts(spark, text).select(make(F.col("report_text"))).first()[0]
    assert one("T\nADVICE:\n- a", lambda c: report.appended(c, "ADVICE", F.lit("b"))) == "T\nADVICE:\n- a\n- b"
    assert one("T ", lambda c: report.appended(c, "ADVICE", F.lit("b"))) == "T\n\nADVICE:\n- b"
    assert one("x fatty [[fatty]]", lambda c: report.guess_replaced(c, F.lit("fatty"), F.lit("faint"))) == "x fatty faint"
    assert one("x fatty", lambda c: report.guess_replaced(c, F.lit("fatty"), F.lit("faint"))) == "x faint"


@pytest.mark.parametrize(
    ("said", "level", "terms"),
    [
        ("Large subdural hematoma with 8 mm midline shift. Rest is normal.", "stat", "midline shift, subdural hematoma"),
        ("No evidence of pulmonary embolism.", "routine", ""), ("Old acute infarct on the left.", "routine", ""),
        ("Findings fit acute appendicitis.", "urgent", "acute appendicitis, appendicitis"), ("Tension pneumothorax.", "stat", "tension pneumothorax"),
        (REPORT, "routine", ""), ("T\nFINDINGS:\nSaddle embolus.\nIMPRESSION:\nSaddle embolus.", "stat", "saddle embolus"), (None, "routine", ""), ("", "routine", ""),
    ],
)
def test_triage_golden(spark, said, level, terms):
    assert tuple(clinical.triage(texts(spark, said)).first())[1:] == (level, terms)


@pytest.mark.parametrize(
    ("said", "want"),
    [
        ("No pneumothorax. There is a large pleural effusion. No evidence of free fluid.", {"pneumothorax": True, "pleural effusion": False, "free fluid": True}),
        ("No pleural effusion but a large mass is seen.", {"pleural effusion": True, "mass": False}), ("Pneumothorax is not seen.", {"pneumothorax": True}),
        ("No significant change in the known mass.", {"mass": False}), ("Not associated with effusions.", {"effusion": True}), ("without fractures, cysts", {"fracture": True, "cyst": True}),
        ("", {}), (None, {}),
    ],
)
def test_polarity_golden(spark, said, want):
    assert {r.term: r.negated for r in clinical.polarity(texts(spark, said)).collect()} == want


def test_draft_guard(spark):
    pairs = spark.createDataFrame(
        [(1, "No pneumothorax. No cyst.", "Large pneumothorax."), (2, "No mass.", "No mass is seen."), (3, None, "x"), (4, "No mass.", None)], "k int, s string, d string"
    )
    assert rows(clinical.draft_guard(pairs, "k", "s", "d")) == [
        (1, "cyst", "omitted", "No cyst.", ""), (1, "pneumothorax", "flipped", "No pneumothorax.", "Large pneumothorax."), (4, "mass", "omitted", "No mass.", ""),
    ]
    assert rows(clinical.draft_badges(pairs, "k", "s", "d"))[0] == (1, 2, 0, 1, 1)


@pytest.mark.parametrize(
    ("findings", "impression", "check"),
    [
        ("A 4 mm calculus.", "Calculus of 12 mm.", ("measurement not in findings", "critical", "12 mm")), ("A 12 mm calculus.", "Calculus of 1.2 cm.", None),
        ("A 12 mm calculus.", "Calculus of 12 cm.", ("measurement not in findings", "warning", "12 cm")),
        ("Right renal mass is seen.", "Left renal mass is seen.", ("laterality", "critical", "left against right")),
        ("History of left nephrectomy. Right renal mass.", "Right renal mass of old.", None), ("Known left mass; right cyst is seen.", "Right renal cyst seen.", None),
        ("Shows [[fatty]] change.", "Fatty change of liver.", ("unconfirmed dictation", "critical", "fatty")), ("Size is [INSERT] mm.", "Normal study of liver.", ("unfilled bracket", "critical", "[insert]")),
        ("Right kidney, wait, left kidney.", "Normal study of liver.", ("self-correction", "critical", "wait")), ("No free fluid. Free fluid in pelvis.", "Fluid in the pelvis seen.", ("denied and stated", "note", "free fluid")),
        ("Liver is xxxx today.", "Normal study of liver.", ("placeholder", "critical", "xxxx")), ("Fine.", "Normal.", ("short impression", "warning", "")),
        ("Fine.", "", ("empty impression", "critical", "")),
    ],
)
def test_validation_golden(spark, findings, impression, check):
    text = f"USG\nPATIENT NAME: A\nAGE: 4\nFINDINGS:\n{findings}\nIMPRESSION:\n{impression}"
    got = {(r.check, r.severity, r.detail) for r in clinical.validation(texts(spark, text)).collect()}
    assert (check in got) if check else not {g for g in got if g[0] in ("measurement not in findings", "laterality")}


def test_rules(spark):
    text = "MAMMOGRAPHY\nFINDINGS:\nA mass.\nIMPRESSION:\nNormal study."
    got = {(r.check, r.detail) for r in clinical.validation(texts(spark, text)).collect()}
    assert {("required phrase", "BI-RADS"), ("banned phrase", "normal study")} <= got
    assert {r.severity for r in clinical.validation(texts(spark, text), rules=(("default", "required_section", "TECHNIQUE", "note"),)).where("detail = 'TECHNIQUE'").collect()} == {"warning"}
    assert clinical.validation(texts(spark, "", " ")).select("check").distinct().collect()[0][0] == "empty report" and clinical.validation(texts(spark, None)).count() == 0
    assert set(v.SEVERITIES) >= {r.severity for r in clinical.severity_counts(clinical.validation(texts(spark, text))).collect()}


@pytest.mark.parametrize(
    ("title", "said", "want"),
    [
        ("CT CHEST", "A 7 mm solid nodule in the right upper lobe.", {("Fleischner 2017", "6-8 mm: CT at 6-12 months, then 18-24 months")}),
        ("HRCT CHEST", "A 4 mm ground-glass nodule.", {("Fleischner 2017", "ground-glass below 6 mm: none")}), ("CT CHEST", "Nodule of 1.2 cm.", {("Fleischner 2017", "above 8 mm: CT at 3 months, PET-CT or sampling")}),
        ("CT CHEST", "A 7 mm nodule. Follow up by Fleischner.", set()), ("CT CHEST", "No nodule is seen.", set()),
        ("USG NECK", "A thyroid nodule of 9 mm.", {("ACR TI-RADS", "category missing")}), ("USG", "Thyroid nodule, TI-RADS 3.", set()), ("USG", "Simple renal cyst.", {("Bosniak", "category missing")}),
    ],
)
def test_advice_golden(spark, title, said, want):
    assert {(r.system, r.advice) for r in clinical.advice(texts(spark, f"{title}\nFINDINGS:\n{said}")).collect()} == want


def test_proposals(spark):
    said = "T\nFINDINGS:\nLiver is normal.\nNo mass. A cyst of 3 cm is seen.\n- A cyst of 3 cm is seen\nNo calculus, but hydronephrosis of a degree that is much more than fifty letters away from it, stones."
    assert [r.sentence for r in clinical.impression_proposals(texts(spark, said)).orderBy("n").collect()][0] == "A cyst of 3 cm is seen"
    assert rows(clinical.impression_proposals(texts(spark, "T\nFINDINGS:\nLiver is normal.", "T\nIMPRESSION:\nx"))) == [("0", 0, v.NORMAL_LINE)]


def test_anatomy(spark):
    said = "T\nFINDINGS:\nRight lobe of liver shows a lesion of 12 mm.\nA cyst is seen in the left kidney.\nIt measures 2.5 cm.\nBoth lung fields are clear."
    placed = documents.anatomy(texts(spark, said, "T\nFINDINGS:\nIt measures 5 mm today."))
    assert [(r.id, r.region, r.organ, r.subpart) for r in placed.orderBy("id", "pos").collect()] == [
        ("0", "ABDOMEN", "LIVER", "RIGHT LOBE"), ("0", "ABDOMEN", "LEFT KIDNEY", "GENERAL"), ("0", "ABDOMEN", "LEFT KIDNEY", "GENERAL"), ("0", "CHEST", "BILATERAL LUNG", "GENERAL"),
        ("1", "UNASSIGNED", "GENERAL", "GENERAL"),
    ]
    assert {r.path: len(r.sentences) for r in documents.anatomy_paths(placed.where("id = '0'")).collect()} == {"ABDOMEN > LIVER > RIGHT LOBE": 1, "ABDOMEN > LEFT KIDNEY": 2, "CHEST > BILATERAL LUNG": 1}


def test_intervals(spark):
    d = spark.createDataFrame([("2024-01-01T10:00:00", "2024-01-31 10:00"), ("2024-06-01", None), ("2024-01-01T00:00:00+00:00", "2025-01-01T00:00:00")], "a string, b string")
    assert [r[0] for r in d.select(clinical.interval_label(F.col("a"), F.col("b"))).collect()] == ["30 days", "", "12 months"]
