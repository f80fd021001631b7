import hashlib
import hmac
import io
import json
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from reportlake.operators import batch, dictation, library, memory, reconcile, store
from reportlake.plans import surface
from reportlake.sources import exchange, files, intake
from reportlake.streaming import replay


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize(
    ("said", "written"),
    [
        ("five by six centimeter mass", "5 x 6 cm mass"), ("grade two reflux, grade iv", "Grade II reflux, Grade IV"), ("point five mg per dl", "0.5 mg/dL"),
        ("two to three millimeter nodule", "2 to 3 mm nodule"), ("rate seventy two beats per minute", "rate 72 bpm"), ("forty hounsfield units", "40 HU"),
        ("hydro nephrosis noted", "hydronephrosis noted"), ("Retro peri toneal mass", "Retroperitoneal mass"), ("twenty two to three millimeter nodule", "twenty two to three millimeter nodule"),
        ("two fifty ml", "two fifty ml"), ("a hundred percent", "a hundred percent"), ("one and a half cm", "one and a half cm"), ("fourteen point two centimetres", "14.2 cm"),
        ("three lakh two hundred and five", "300205"), ("one", "one"), ("ninety percent", "90%"), ("9.8 into 4.4 cm", "9.8 x 4.4 cm"), ("", ""),
    ],
)
def test_dictation(said, written):
    assert dictation.clean(said)[0] == written


def test_dictation_rows(spark):
    df = spark.createDataFrame([(1, "twenty two to three mm"), (2, None), (3, "five cm")], "k int, t string")
    assert rows(dictation.cleaned(df, "k", "t")) == [(1, "twenty two to three mm", 0, 0, 0, ["twenty two to three mm"]), (2, None, 0, 0, 0, []), (3, "5 cm", 1, 0, 0, [])]


def test_reconcile(spark):
    pairs = spark.createDataFrame([(1, "The 4 mm nodule is seen here", "The nodule is seen"), (2, "same", "same"), (3, None, "x"), (4, "a b", None)], "k int, s string, o string")
    assert rows(reconcile.plan(pairs, "k", "s", "o")) == [(1, 1, "4 mm", "The", "nodule is seen"), (1, 4, "here", "nodule is seen", ""), (4, 0, "a b", "", "")]
    got = {r.k: (r.text, r.runs, r.diff) for r in reconcile.auto_restored(pairs, "k", "s", "o").collect()}
    assert got[1][:2] == ("The 4 mm nodule is seen here", 2) and got[2] == ("same", 0, "same") and got[4][0] == "a b" and "{+x+}" in got[3][2]
    a = spark.createDataFrame([("1. liver liver 9", "Liver 9 Clinic", "Clinic spare")], "s string, o string, h string").select(reconcile.audit_summary(F.col("s"), F.col("o"), F.col("h")).alias("a")).first().a
    assert tuple(a) == (1, 0, False)


def test_memory(spark):
    log = [
        (1, "a", "style_rule", "liver", "Say normal."), (2, "a", "style_rule", "Liver", "Say unremarkable"), (3, "a", "style_rule", "liver", "say normal"), (4, "a", "style_rule", "liver", "third"),
        (5, "b", "case", "x", "y"), (6, "b", "style_rule", "", "z"), (7, "a", "style_rule", "q", " "), (8, "a", "style_rule", "q", None),
    ]
    got = {r.content: r.confidence for r in memory.replayed(spark.createDataFrame(log, "seq int, owner string, kind string, concept string, content string")).collect()}
    assert got == {"Say normal.": 0.5, "Say unremarkable": 0.5, "third": 1.0, "y": 1.0, "z": 1.0}
    kept = "memory_id int, owner string, content string, embedder string, vector array<double>, confidence double, last_used string, created string, uses int"
    m = spark.createDataFrame(
        [(1, "a", "liver normal", "h", [1.0, 0.0], 1.0, "2025-12-31", "", 0), (2, "a", "liver cyst", "g", None, 1.0, "", "2025-01-01", 2), (3, "b", "liver normal", "h", [1.0, 0.0], 1.0, "", "", None)], kept
    )
    q = spark.createDataFrame([(9, "a", "liver cyst", "h", [1.0, 0.0])], "query int, owner string, text string, embedder string, vector array<double>")
    hits = memory.retrieved(q, m, "2026-01-01")
    assert [(r.memory_id, r["rank"]) for r in hits.orderBy("rank").collect()] == [(1, 1), (2, 2)] and hits.where("memory_id = 2").first().score < 0.3
    assert {r.memory_id: (r.uses, r.last_used) for r in memory.reinforced(m, hits, "now").collect()} == {1: (1, "now"), 2: (3, "now"), 3: (0, "")}
    assert memory.forgotten(m, spark.createDataFrame([("a", " Liver normal. ")], "owner string, content string")).count() == 2
    changed, counts = memory.renamed({"m": m}, "a", "c")
    assert changed["m"].where("owner = 'c'").count() == 2 and m.agg(counts["m"]).first()[0] == 2 and memory.without_owner({"m": m}, "a")["m"].count() == 1
    pairs = spark.createDataFrame([("a", i, "x", "x" if i == 3 else f"y{i}") for i in range(5)] + [("a", 9, " ", "z")], "owner string, seq int, b string, c string")
    assert [r.seq for r in memory.archived(pairs, "b", "c", 2).orderBy("seq").collect()] == [2, 4]
    line = memory.preference_json(spark.createDataFrame([("a", "p", "r", "c", None, "w")], "owner string, raw_prompt string, ai_draft string, final_edit string, rule string, when_ string")).first().line
    assert json.loads(line) == {"prompt": "p", "rejected": "r", "chosen": "c", "rule": "", "doctor": "a", "when": "w"}


def test_library(spark):
    t = spark.createDataFrame([("s1", "Portal hypertension with Cholelithiasis. Portal hypertension again. portal hypertension and cholelithiasis severe portal hypertension"), ("s2", None)], "source string, text string")
    got = {(r.term, r.n, r.kind) for r in library.mined(t, "source", "text").collect()}
    assert got == {("hypertension", 4, "word"), ("cholelithiasis", 2, "word"), ("portal hypertension", 4, "phrase")}
    common = spark.createDataFrame([("portal",)], "word string")
    assert {r.term for r in library.mined(t, "source", "text", common, spark.createDataFrame([("Cholelithiasis",)], "term string")).collect()} == {"hypertension"}
    lib = spark.createDataFrame([("a", "Wall", 2), ("b", "wall", 5), ("a", "  wall ", 1), ("a", "cyst", 1), ("c", None, 1)], "source string, term string, n bigint")
    index = library.entries(lib)
    assert {r.key: (r.n, dict(r.sources)) for r in index.collect()} == {"wall": (8, {"a": 3, "b": 5}), "cyst": (1, {"a": 1})}
    more = library.merged(lib, spark.createDataFrame([("a", "new", 1), ("d", "new", 1)], "source string, term string, n bigint"))
    assert more.where("term = 'new'").count() == 1 and library.without_source(more, ["d"]).where("term = 'new'").count() == 0
    assert rows(library.top_terms(index, 1)) == [("wall", 8)] and rows(library.searched(index, "YS")) == [("cyst", 1)]
    assert rows(library.looked_up(spark.createDataFrame([("WALL ",), ("none",)], "word string"), index)) == [("WALL ", "wall", 8)]
    assert [(r.term, r.score) for r in library.relevant(spark.createDataFrame([(1, "the walls and cyst wall here")], "id int, text string"), index, "id", "text").orderBy("rank").collect()] == [("wall", 1.0), ("cyst", 1.0)]
    one = spark.range(1)
    assert one.select(library.hint(F.array(*map(F.lit, ["aa", "AA", "bbb", "c"])), 7)).first()[0] == "aa, bbb"
    assert one.select(library.expanded(F.lit("x .nad and .nadir"), {"nad": "no $disease"}, {"nad": "own $1"})).first()[0] == "x own $1 and .nadir"


def test_store(spark):
    e = spark.createDataFrame([("c", i, f"v{i}") for i in range(4)], "chain string, seq int, verdict string")
    made = store.chained(e, "chain", "seq", "verdict")
    want, prev = [], ""
    for i in range(4):
        prev = hashlib.sha256(f"{prev}|v{i}".encode()).hexdigest()
        want.append(prev)
    assert [r.link for r in made.orderBy("seq").collect()] == want
    assert rows(store.verify_chain(made, "chain", "seq", "verdict")) == [("c", 4, True, None)]
    signed = made.withColumn("signature", F.when(F.col("seq") == 0, F.lit(hmac.new(b"k", want[0].encode(), hashlib.sha256).hexdigest())).when(F.col("seq") == 1, "bad"))
    assert rows(store.signed_counts(signed, "chain", b"k")) == [("c", 1, 1)]
    users, roles = spark.createDataFrame([("u", None), ("w", "clerk")], "user string, role string"), spark.createDataFrame([("attending", "sign")], "role string, action string")
    assert rows(store.allowed(users, roles, "sign")) == [("u",)]
    v = spark.createDataFrame([("k", i) for i in range(5)], "key string, seq int")
    assert rows(store.kept_versions(v, ["key"], "seq", 1)) == [("k", 3, 4), ("k", 4, 5)]
    src, tgt = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "key string, x int"), spark.createDataFrame([("a", 0)], "key string, x int")
    out, tally = store.copied(src, tgt, ["key"], F.col("key").isNotNull())
    assert rows(out) == [("b", 2)] and rows(tally) == [("copied", 1), ("invalid", 1), ("skipped", 1)] and store.copied(src, tgt, ["key"], F.col("key").isNotNull(), True)[0].count() == 2
    assert store.with_tenant(store.with_tenant(v)).columns == ["key", "seq", "tenant"]
    n = spark.createDataFrame([("5",), ("99",), ("nan",), ("x",), (None,)], "t string").select(store.number_between(F.col("t"), 1, 10, 3.0), store.flag(F.col("t"))).collect()
    assert [r[0] for r in n] == [5.0, 10.0, 3.0, 3.0, 3.0]
    assert rows(store.changed_fields(src, spark.createDataFrame([("a", 1), ("b", None)], "key string, x int"), "key", ["x"])) == [("b", "x", "2", None)]


def test_hl7_transport(spark):
    m = "MSH|^~\\&|A|B|C|D|t||ORM^O01|77|P|2.5\rPID|1"
    one = spark.createDataFrame([(m,)], "m string")
    ack = one.select(exchange.answer(F.col("m"), "AE", F.lit("no|room")).alias("a")).select("a", exchange.accepted(F.col("a")).alias("x")).first()
    assert "MSA|AE|77|no room" in ack.a and not ack.x.ok
    stream = "noise\x0bone\x1c\r\x0btwo\x1c\r\x0bpart"
    u = spark.createDataFrame([(stream,), ("\x0b" + "x" * 1_000_001,), ("",)], "s string").select(exchange.unframed(F.col("s")).alias("u")).collect()
    assert (u[0].u.messages, u[0].u.rest) == (["one", "two"], "\x0bpart") and u[1].u.too_long and u[2].u.messages == []
    t = spark.createDataFrame([("2024-01-02T03:04:05+00:00",), ("2024-01-02 03:04",), ("x",), (None,)], "t string").select(exchange.hl7_time(F.col("t"))).collect()
    assert [r[0] for r in t] == ["20240102030405", "20240102030400", "", ""]


def test_messages(spark, table):
    r = store.latest(table("records")).where("report_text is not null")
    one = r.select("report_text", exchange.result_message().alias("m"), exchange.bundle().alias("j"), exchange.alert().alias("a")).first()
    obx = [s for s in one.m.split("\r") if s.startswith("OBX")]
    assert [s.split("|")[1] for s in obx] == [str(i + 1) for i in range(len(obx))] and any("19005-8" in s for s in obx) and len(one.a.short) <= 320
    j = json.loads(one.j)
    assert [e["resource"]["resourceType"] for e in j["entry"]] == ["Patient", "DiagnosticReport"] and j["entry"][1]["resource"]["subject"]["reference"].endswith(j["entry"][0]["resource"]["id"])


def image(elements):
    body = b""
    for (g, e), kind, value in elements:
        value += b" " * (len(value) % 2)
        body += struct.pack("<HH", g, e) + kind + struct.pack("<H", len(value)) + value
    return b"\0" * 128 + b"DICM" + body


def test_images(spark):
    data = image([((2, 0x10), b"UI", b"1.2.840.10008.1.2.1"), ((8, 0x20), b"DA", b"20240131"), ((8, 0x60), b"CS", b"ct"), ((0x10, 0x10), b"PN", b"Devi^Sunita"), ((0x10, 0x40), b"CS", b"F"), ((0x10, 0x1010), b"AS", b"030M"), ((0x20, 0x60), b"CS", b"L")])
    df = spark.createDataFrame([("a", bytearray(data)), ("b", bytearray(b"x")), ("c", None)], "path string, content binary")
    got = {r.path: r for r in exchange.image_headers(df).collect()}
    assert (got["a"].patient, got["a"].age_years, got["a"].study_date, got["a"].modality, got["a"].laterality) == ("Devi Sunita", 2, "2024-01-31", "CT", "L")
    assert got["b"].problem and got["c"].problem and got["a"].problem is None
    pairs = spark.createDataFrame(
        [(1, "MRI of the right knee, prostate", "Ram Kumar", "40 yrs", "Sunita Devi", "F", 30, "CT", "L"), (2, "CT left", "Devi Sunita", "30 Y", "Sunita Devi", "F", 31, "CT", "L"), (3, None, None, None, None, None, None, None, None)],
        "k int, report_text string, patient string, age_sex string, header_patient string, header_sex string, header_age int, header_modality string, header_laterality string",
    )
    assert {(r.k, r.check) for r in exchange.cross_checks(pairs, "k").collect()} == {(1, c) for c in ("side", "sex", "patient", "age", "modality")}
    found = [{"0020000D": {"vr": "UI", "Value": ["1.2"]}, "00100010": {"vr": "PN", "Value": [{"Alphabetic": "Devi^Sunita"}]}, "00080020": {"vr": "DA", "Value": ["20240131"]}, "00080061": {"vr": "CS", "Value": ["CT", "SR"]}}]
    studies = exchange.study_rows(spark.createDataFrame([(json.dumps(found),)], "json string"))
    assert rows(studies) == [("1.2", "Devi Sunita", "20240131", "CT", "")]
    assert exchange.study_search(studies, "devi*", "20240101", "20241231", "ct").count() == 1 and exchange.study_search(studies, "x").count() == 0
    assert exchange.first_part(b"--b\r\nType: x\r\n\r\nDATA\r\n--b--", "b") == b"DATA" and exchange.first_part(b"raw", "b") == b"raw"
    index = spark.createDataFrame([("s", "p1", "A", "CT", "1"), ("s", "p2", "B", "CT", "2"), ("t", "p3", "C", "MR", "3")], "study_uid string, path string, patient string, modality string, when_ string")
    assert [(r.study_uid, r.images, r.patient) for r in exchange.received(index, spark.createDataFrame([("p1", 1), ("p2", 0)], "path string, length int")).collect()] == [("s", 1, "A")]
    assert exchange.purged(index, "s").count() == 1
    words = spark.createDataFrame([(1, 0, 0, 0, 2, "b", 80.0), (1, 0, 0, 0, 1, "a", 90.0), (1, 0, 0, 1, 1, " ", 1.0), (1, 1, 0, 0, 1, "c", -1.0)], "page_id int, block int, par int, line int, word_no int, text string, conf double")
    assert rows(exchange.ocr_lines(words)) == [(1, 0, "a b", 85.0), (1, 1, "c", None)]


def zipped(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/"), text)
    return out.getvalue()


def test_files(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    word = zipped(**{"word__document.xml": f"<w:document {w}><w:body>{p('CT')}{p(' ')}{p('Liver')}<w:tbl><w:tr><w:tc>{p('EF')}</w:tc><w:tc>{p('62')}</w:tc></w:tr></w:tbl></w:body></w:document>"})
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cell = lambda at, i: f'<c r="{at}" t="s"><v>{i}</v></c>'
    excel = zipped(
        **{
            "xl__workbook.xml": f"<workbook {s}/>", "xl__sharedStrings.xml": f"<sst {s}>" + "".join(f"<si><t>{t}</t></si>" for t in ("Patient Name", "Dictation", "Asha", "liver normal")) + "</sst>",
            "xl__worksheets__sheet1.xml": f'<worksheet {s}><sheetData><row>{cell("A1", 0)}{cell("C1", 1)}</row><row>{cell("A2", 2)}{cell("C2", 3)}</row><row>{cell("A3", 2)}</row></sheetData></worksheet>',
        }
    )
    for name, data in {"a.docx": word, "b.xlsx": excel, "c.txt": "caf’".encode("cp1252"), "d.png": b"x", "e.docx": b"broken", "f.txt": b"\xef\xbb\xbfhi"}.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[-1]: r for r in files.read_any(spark, str(tmp_path)).collect()}
    assert got["a.docx"].text == "CT\nLiver\nEF\n62" and got["c.txt"].text == "caf’" and got["f.txt"].text == "hi" and got["d.png"].problem == "needs recognition" and "BadZipFile" in got["e.docx"].problem
    items = files.sheet_items(files.read_any(spark, str(tmp_path)))
    assert [(r.row_no, r.patient, r.study, r.text) for r in items.collect()] == [(1, "Asha", "", "liver normal")]
    made = intake.intake(items, files.read_any(spark, str(tmp_path)), intake.split_pasted(spark.createDataFrame([(1, "x\n---\ny")], "k int, t string"), "k", "t"))
    assert {(r.label, r.text) for r in made.where("source <> 'file'").collect()} == {("Asha", "PATIENT NAME: Asha\n\nliver normal"), ("paste_0", "x"), ("paste_1", "y")} and made.count() == 6
    log = spark.createDataFrame([(1, '{"a": 1}'), (2, "broken"), (3, '{"a": 3}')], "seq int, value string")
    assert [tuple(r) for r in intake.log_tail(log, "a int", 5).collect()] == [(3, 3), (1, 1)]
    for tenant in ("t1", "_x"):
        (tmp_path / "store" / tenant).mkdir(parents=True)
        (tmp_path / "store" / tenant / "a.json").write_text('{"name": "n"}')
    (tmp_path / "store" / "t1" / "b.json").write_text('{"name": ')
    assert rows(intake.json_table(spark, str(tmp_path / "store" / "*"), "name string")) == [("n", "t1")]


def test_batch(spark):
    items = spark.createDataFrame([("a", "USG\nPATIENT NAME: A\nAGE: 4\nFINDINGS:\nA mass is seen.\nIMPRESSION:\nA mass of the liver."), ("b", " "), ("c", None), ("d", "USG\nFINDINGS:\n[[x]]")], "label string, text string")
    got = {r.label: r for r in batch.processed(items).collect()}
    assert got["a"].ready and got["b"].error and got["c"].error and not got["d"].ready and got["a"].source_sha256 == hashlib.sha256(items.first().text.encode()).hexdigest()
    m = {r.source_label: r for r in batch.manifest(batch.processed(items)).collect()}
    assert (m["a"].word_loss_audit, m["b"].word_loss_audit, len(m["a"])) == ("PASS", "ERROR", 14) and {m["a"].filename, m["d"].filename} == {"USG.docx", "USG_2.docx"}
    assert tuple(batch.totals(batch.processed(items)).first()) == (1, 1, 0, 2)


def test_streams(spark, tmp_path):
    orders = "arrived timestamp, message string"
    m = "MSH|^~\\&|A|B|C|D|t||ORM^O01|77|P|2.5\rPID|1||||DEVI^SUNITA|||F"
    spark.sql("select timestamp'2024-01-01 10:00:00' as arrived").crossJoin(spark.createDataFrame([(m,), (m,)], "message string")).write.parquet(str(tmp_path / "in"))
    q = replay.orders(spark.readStream.schema(orders).parquet(str(tmp_path / "in"))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.control_id for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["77"]
    seen = spark.sql("select 's' as study_uid, timestamp'2024-01-01' as arrived union all select 's', timestamp'2024-01-01 02:00:00' union all select 't', timestamp'2024-02-01'")
    assert [(r.study_uid, r.images) for r in replay.studies(seen).orderBy("study_uid").collect()] == [("s", 2), ("t", 1)]


def test_sql_functions(spark):
    names = surface.register(spark)
    assert set(names) >= {"spoken_numbers", "match_ratio"}
    assert tuple(spark.sql("select spoken_numbers('five cm'), match_ratio('abc', 'abd'), restored_text('a b', 'a'), spoken_numbers(null)").first()) == ("5 cm", 2 / 3, "a b", None)


def test_relevant_terms_move_no_runs(spark):
    """Runs of words meet one short look-up table where they are: nothing but the texts is shuffled."""
    lib = spark.createDataFrame([("a", "Wall", 2), ("a", "portal vein", 1)], "source string, term string, n bigint")
    texts = spark.createDataFrame([(1, "the portal vein and thick walll"), (2, None)], "id int, text string").groupBy("id").agg(F.min("text").alias("text"))
    got = library.relevant(texts, library.entries(lib), "id", "text")
    assert rows(got.select("id", "term", "score", "n", "rank")) == [(1, "Wall", 0.89, 2, 2), (1, "portal vein", 1.0, 1, 1)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan
