import hashlib
import hmac
import json
import random
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from reportlake import session
from reportlake.functions import crypto, text
from reportlake.operators import clinical, corpus, graph, nested, store, units
from reportlake.sources import intake


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def one(spark, value, make, name="x"):
    return spark.createDataFrame([(value,)], f"{name} string").select(make(F.col(name))).first()[0]


def element(key, size, stated, sentence):
    return {"key": key, "size_mm": size, "stated": stated, "sentence": sentence, "via": "stated"}


@pytest.mark.parametrize(
    ("stated", "sentence", "value", "unit"),
    [
        ("13.6cm", "", 13.6, "cm"), ("2,5 cm", "", 2.5, "cm"), ("1 3/8 inches", "", 1.375, "in"), ('4.8 × 1.6"', "", 4.8, "in"),
        ("two and a half centimetres", "", 2.5, "cm"), ("twenty five millimetres", "", 25.0, "mm"), ("9 by 16 MM", "", 16.0, "mm"),
        ("", "Lesion measures 40mm.", 40.0, "mm"), (None, "The uterus is 0.8 in greatest extent.", 0.8, None),
        (None, "The uterus is 0.8 in in greatest extent.", 0.8, "in"), ("12", "about 12, smooth", 12.0, None), (None, None, None, None),
    ],
)
def test_quantities(spark, table, stated, sentence, value, unit):
    schema = table("records").schema
    rec = {f.name: None for f in schema.fields} | {"id": "a", "measurements": [element("x", None, stated, sentence), None]}
    got = units.read_sizes(spark.createDataFrame([rec], schema)).select("value", "unit").collect()
    assert [tuple(r) for r in got] == ([] if value is None else [(value, unit)])


def test_declared_unit(spark):
    for said, unit in [("Dimensions in inches.", "in"), ("(figures without unit: cm)", "cm"), ("All sizes in millimetres unless stated.", "mm"),
                       ("Sizes quoted below are centimetre values.", "cm"), ("11 mm sections", None)]:
        assert one(spark, said, units.declared_unit) == unit


def test_units_predict(spark, table):
    recs = table("records")
    got = units.in_millimetres(recs)
    assert got.where("route = 'predicted' and confidence < 0.9").count() == 0
    assert got.where("right_mm is null and route <> 'review'").count() == 0
    declared = units.read_sizes(recs).where("unit is null").select("id", "pos", "declared").distinct()
    hit = got.where("route = 'declared'").join(declared, ["id", "pos"])
    assert hit.count() > 0 and hit.where("unit <> declared").count() == 0
    # without the declarations, what is confident must be right nearly always
    silent = recs.withColumn("report_text", F.lit(""))
    guessed = units.in_millimetres(silent).where("route in ('predicted', 'review')").join(declared, ["id", "pos"])
    sure = guessed.where("route = 'predicted'")
    assert guessed.where("route = 'review'").count() > 0 and sure.where("unit = declared").count() >= 0.85 * sure.count() > 0
    seen = {r.unit: r for r in units.unit_accuracy(recs).collect()}
    assert sum(r.sure_right for r in seen.values()) >= 0.85 * sum(r.sure for r in seen.values())


def test_units_of_nothing(spark, table, nulls):
    assert units.wrong_sizes(table("records").limit(0)).count() == 0
    assert units.wrong_sizes(nulls("records")).count() == 0


def test_nested_against_recursion(spark, table):
    tree = {"A": {"B": ["x", None, {"text": "y", "sizes": [1]}], "C": "z", "D": {}, "E": None}, "F": []}
    deep = "[" * 3000 + "]" * 3000
    texts = [json.dumps(tree), json.dumps(json.dumps(tree)), "", "null", "{broken", deep, None]
    df = spark.createDataFrame([(f"r{i}", t) for i, t in enumerate(texts)], "report_id string, findings_tree string")
    got = rows(nested.child_rows(nested.json_occurrences(df)))
    want = [(f"r{i}", "finding", p, n) for i in (0, 1) for p, n in (("A > B", 0), ("A > B", 2), ("A > C", 0))]
    assert [g for g in got if g[0] != "r5"] == sorted(want, key=repr)
    store_ = nested.subtree_store(nested.json_occurrences(df.where("report_id < 'r2'"))).collect()
    assert len({r.node_hash for r in store_}) == len(store_) and all(r.uses % 2 == 0 for r in store_)


def test_nested_documents_rebuilt(spark):
    tree = {"A": {"B": ["x", None, {"text": "y", "negated": False, "sizes": [{"v": 1.5, "u": "mm"}, [[]]]}], "C": "z", "D": {}, "E": None}, "F": [], "G": 3}
    docs = {"r0": tree, "r1": [1, {"a": [None, {"b": True}]}], "r2": {}}
    df = spark.createDataFrame([(i, json.dumps(t)) for i, t in docs.items()], "report_id string, findings_tree string")
    bridge = nested.json_occurrences(df)
    store_ = {r.node_hash: r.node for r in nested.subtree_store(bridge).collect()}

    def build(h):
        body = store_[h]
        if body[0] == "[":
            return [build(x) for x in body[1:-1].split(",") if x]
        if body[0] != "{":
            return json.loads(body)
        out, at = {}, 1
        while at < len(body) - 1:
            name, at = json.JSONDecoder().raw_decode(body, at)
            out[name], at = build(body[at + 1 : at + 1 + nested.HASH_HEX]), at + 2 + nested.HASH_HEX
        return out

    got = bridge.collect()
    assert {r.parent_id: build(r.node_hash) for r in got if r.kind == "root"} == docs
    places = {(r.path, r.pos): build(r.node_hash) for r in got if r.parent_id == "r0"}
    assert places["A > B > [2] > negated", 1] is False and places["A > B > [2] > sizes > [0] > v", 0] == 1.5
    assert {r.path for r in nested.child_rows(bridge.where("parent_id = 'r0'")).collect()} == {"A > B", "A > C"}


def test_nested_arrays_keep_ordinals(spark, table, nulls):
    schema = table("records").schema
    step = {"when_": "t", "what": "w", "user_": None}
    rec = {f.name: None for f in schema.fields} | {"id": "a", "trail": [step, None, step]}
    longer = rec | {"trail": [step, None, step, step]}
    df = spark.createDataFrame([rec, rec, longer], schema)
    assert rows(nested.child_rows(nested.array_occurrences(df, "trail", "id", "trail"))) == [("a", "trail", "", i) for i in (0, 2, 3)]
    bridge = nested.array_occurrences(df, "trail", "id", "trail")
    kept = {r.node_hash: r.node for r in nested.subtree_store(bridge).collect()}
    assert {hashlib.sha256(n.encode()).hexdigest()[: nested.HASH_HEX] for n in kept.values()} == set(kept)
    assert sorted(n for n in kept.values() if n[0] not in "[{") == ['"t"', '"w"', "null"]
    assert nested.occurrences(nulls("structured_reports"), nulls("records")).count() == 0
    assert nested.occurrences(table("structured_reports").limit(0), table("records").limit(0)).count() == 0


def test_nested_of_any_depth(spark, table):
    schema = table("structured_reports").schema
    text = json.dumps({"A": {"B": ["x"]}})
    for _ in range(12):
        text = json.dumps(text)
    deep = '{"k":' * 2_000 + '["leaf"]' + "}" * 2_000
    value = nested._load('{"k":' * 90_000 + '["leaf"]' + "}" * 90_000)
    for _ in range(90_000):
        value = value[0][1]
    assert value == ["leaf"] and nested._parse_deep('[1, "a,]", {"b": null, "b": []}]') == [1, "a,]", [("b", None), ("b", [])]]
    recs = [{f.name: None for f in schema.fields} | {"report_id": i, "findings_tree": t} for i, t in [("quoted", text), ("deep", deep), ("bad", "{no"), ("number", "7"), ("null", "null")]]
    bridge = nested.json_occurrences(spark.createDataFrame(recs, schema))
    assert [r.path for r in nested.child_rows(bridge.where("parent_id = 'quoted'")).collect()] == ["A > B"]
    assert nested.child_rows(bridge.where("parent_id = 'deep'")).first().path.count("k") == 2_000
    assert rows(bridge.where("kind = 'broken'").select("parent_id", "node")) == [("bad", "{no"), ("number", "7")]


def test_bridge_is_closed(spark, table):
    bridge = nested.occurrences(table("structured_reports"), table("records"))
    store_ = nested.subtree_store(bridge)
    assert bridge.where("parent_hash is not null").join(store_.withColumnRenamed("node_hash", "parent_hash"), "parent_hash", "left_anti").count() == 0
    assert bridge.where("parent_hash is null and kind not in ('root', 'broken')").count() == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (4, 5), (7, 8), (8, 7), (9, 9)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 7: 7, 8: 7}
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_checkpoints(spark):
    df = session.cut(spark.range(3))
    file = df._jdf.queryExecution().logical().rdd().getCheckpointFile().get().removeprefix("file:")
    assert Path(file).exists()
    session.release(df, spark.range(2))
    assert not Path(file).exists()

    class Cluster:
        conf: dict = {}
        sparkContext = type("C", (), {"master": "spark://host:7077", "getConf": lambda self: {}})()

    with pytest.raises(ValueError, match="share"):
        session.shared_dir(Cluster())


def test_text_functions(spark):
    assert one(spark, "Mrs. Sunita Devi", lambda c: text.patient_slug(c, F.lit("45 years female"))) == "sunita-devi-f"
    assert one(spark, "Mrs. Sunita Devi", text.hl7_name) == "DEVI^SUNITA"
    assert one(spark, "a|b\\c", text.hl7_escape) == "a\\F\\b\\E\\c"
    assert one(spark, "HRCT CHEST", text.modality) == "CT"
    assert one(spark, "grade two reflux, 12 mg per deciliter", lambda c: text.iso_units(text.roman_grades(c))) == "Grade II reflux, 12 mg/dL"
    assert one(spark, "Line one\nLine two. Three", lambda c: text.sentences(c, "a")) == ["Line one\nLine two.", "Three"]
    assert one(spark, "Line one\nLine two. Three", lambda c: text.sentences(c, "b")) == ["Line one", "Line two.", "Three"]
    assert one(spark, "  Näme 1! ", text.tenant_slug) == "n-me-1" and one(spark, None, text.tenant_slug) == "default"
    assert one(spark, "hydronephrosis", text.sound_key) == one(spark, "hidronefrosis", text.sound_key)
    t = spark.createDataFrame([([["EF", "62 %"], ["Wall", "9"]],), ([["Side", "Size"], ["Right", "9.8 cm"], ["", "x"]],), ([["Organ", "Side", "mm"], ["liver", "", "9"]],)], "t array<array<string>>")
    assert [r[0] for r in t.select(text.table_text(F.col("t"))).collect()] == ["EF: 62 %\nWall: 9", "Side: Size\nRight: 9.8 cm\nx", "Organ: liver; mm: 9"]


def test_crypto(spark):
    want = hmac.new(b"k" * 80, b"text", hashlib.sha256).hexdigest()
    assert one(spark, "text", lambda c: crypto.hmac_sha256(b"k" * 80, c)) == want
    assert one(spark, "text", lambda c: crypto.unseal(crypto.seal(c, b"k"), b"k")) == "text"
    assert one(spark, "text", lambda c: crypto.unseal(crypto.seal(c, b"k"), b"other")) is None


def test_chain_break(spark):
    links, prev = [], ""
    for i in range(5):
        prev = hashlib.sha256(f"{prev}|{i}|v".encode()).hexdigest()
        links.append(("c", i, "v" if i != 2 else "changed", prev))
    df = spark.createDataFrame(links, "chain string, seq int, verdict string, link string")
    assert rows(store.verify_chain(df, "chain", "seq", "seq", "verdict")) == [("c", 5, False, 2)]


def test_triage(spark):
    said = [
        ("a", "Midline shift is seen. Acute infarct in the MCA territory."), ("b", "No pulmonary embolism is seen."), ("c", "Old acute infarct."),
        ("d", "Appendicitis with fat stranding."), ("e", ""), ("f", "Tension pneumothorax on the left."),
    ]
    got = {r.id: r.level for r in clinical.triage(spark.createDataFrame(said, "id string, report_text string")).collect()}
    assert got == {"a": "stat", "b": "routine", "c": "routine", "d": "urgent", "e": "routine", "f": "stat"}


def test_polarity(spark):
    said = [("a", "No effusion. Masses in the liver. Fracture is not seen."), ("b", "No effusion. Small effusion on the left."), ("c", "No effusion but a large mass, no change in the cyst.")]
    got = {(r.id, r.term): r.negated for r in clinical.polarity(spark.createDataFrame(said, "id string, report_text string")).collect()}
    assert got == {("a", "effusion"): True, ("a", "mass"): False, ("a", "fracture"): True, ("b", "effusion"): False, ("c", "effusion"): True, ("c", "mass"): False, ("c", "cyst"): False}


def test_chunks_overlap(spark):
    d = spark.createDataFrame([(1, "aaaa\n\nbbbb\n\ncccc"), (2, None), (3, " ")], "k int, t string")
    assert rows(corpus.pack_chunks(d, "k", "t", 10)) == [(1, 0, "aaaa\n\nbbbb"), (1, 1, "bbbb\n\ncccc")]


def test_hl7_order(spark):
    m = "MSH|^~\\&|A|B|C|D|t||ORM^O01|77|P|2.5\rPID|1||||DEVI^SUNITA|||F\rOBR|1|||X^USG ABDOMEN||||||||||||9^SHARMA^ANIL"
    o = spark.createDataFrame([(m,), ("",)], "m string").select(intake.order_of(F.col("m")).alias("o")).select("o.*").collect()
    assert tuple(o[0]) == ("77", "SUNITA DEVI", "F", "USG ABDOMEN", "ANIL SHARMA") and o[1].patient == ""


def test_sheet(spark, tmp_path):
    (tmp_path / "s.csv").write_text('Patient_Name,Raw_Dictation_Text\nA,"one\ntwo"\nB,\n')
    assert [tuple(r) for r in intake.read_sheet(spark, str(tmp_path / "s.csv")).select("patient", "text").collect()] == [("A", "one\ntwo")]
    (tmp_path / "t.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        intake.read_sheet(spark, str(tmp_path / "t.csv"))
    (tmp_path / "x.bin").write_bytes(b"caf\xe9")
    assert intake.read_texts(spark, str(tmp_path / "x.bin")).first().text == "café"


def test_routing(spark):
    docs = spark.createDataFrame([("Dr. A Shah",), ("Dr. Meena K. Rao",), ("Dr. Anil Sen",)], "full_name string")
    reps = spark.createDataFrame([("1", "signed Meena Rao"), ("2", "none"), ("3", "Anil Sen and Meena Rao"), ("4", None)], "id string, t string")
    assert rows(intake.route(reps, docs, "id", "t")) == [("1", "Dr. Meena K. Rao"), ("2", None), ("3", None), ("4", None)]


def test_routing_by_mention(spark):
    docs = spark.createDataFrame([("Dr. A Shah",), ("Dr. Meena K. Rao",), ("Dr. Anil Sen",)], "full_name string")
    far = " x" * 300
    reps = spark.createDataFrame(
        [("1", "seen by Meena Rao" + far), ("2", "seen by Anil Sen" + far + " Meena Rao"), ("3", "Anil Sen, Meena Rao" + far), ("4", far)], "id string, t string"
    )
    assert rows(intake.routed(reps, docs, "id", "t")) == [("1", "Dr. Meena K. Rao", "mention"), ("2", "Dr. Meena K. Rao", "signature"), ("3", None, "ambiguous"), ("4", None, "none")]


def test_measurements(spark):
    from reportlake.operators import documents

    said = [
        ("a", "Liver measures 16.2 cm. A cyst is seen in the left kidney. It measures 2.5 cm."), ("b", "Mass of 4.2 x 3.1 cm. Mass of 9 cm."),
        ("c", "It measures 3 cm."), ("d", None), ("e", ""),
    ]
    got = rows(documents.measurements(spark.createDataFrame(said, "id string, report_text string")))
    assert got == [("a", "cyst", 25.0, "anaphora"), ("a", "liver", 162.0, "stated"), ("b", "mass", 42.0, "stated")]


def test_deid_round_trip(spark):
    from reportlake.operators import documents

    t = "MRN: H/123456 of Mrs Sunita  Devi called 98765 43210 and a@b.example on 01/02/2024, again 98765 43210 (H/123456)."
    schema = "k int, t string, names array<string>"
    d = documents.deidentified(spark.createDataFrame([(1, t, ["Mrs. Sunita Devi", None, "Al"]), (2, "", None), (3, None, [])], schema), "k", "t", "names")
    clean = {r.k: r.clean for r in d.collect()}
    assert clean == {1: "MRN: [ID-1] of [NAME-1] called [PHONE-1] and [EMAIL-1] on [DATE-1], again [PHONE-1] (H/123456).", 2: ""}
    assert rows(documents.reidentified(d, "k")) == [(1, t), (2, "")]


def test_near_terms(spark):
    import difflib

    from reportlake.operators import documents

    w = spark.createDataFrame([("cholelithisis",), ("hidronefrosis",), ("hydronephrosis",), ("table",), ("Portal  vien",), ("w@ll",), (None,), ("",)], "word string")
    v = spark.createDataFrame([("Cholelithiasis",), ("hydronephrosis",), ("hydrocele",), ("portal vein",), ("wall",), ("ödem",), (None,)], "term string")
    got = {r.word: (r.term, r.reason) for r in documents.near_terms(w, v).collect()}
    assert got == {"cholelithisis": ("cholelithiasis", "spelling"), "hidronefrosis": ("hydronephrosis", "spelling"), "portal vien": ("portal vein", "spelling")}
    # every pair above the ratio is reached
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abcde") for _ in range(rng.randint(3, 9))) for _ in range(120)})
    terms = sorted({"".join(rng.choice("abcde") for _ in range(rng.randint(3, 9))) for _ in range(120)} - set(words))
    one_column = lambda xs, c: spark.createDataFrame([(x,) for x in xs], f"{c} string")
    found = {r.word: r.ratio for r in documents.near_terms(one_column(words, "word"), one_column(terms, "term")).where("reason = 'spelling'").collect()}
    best = {x: max(difflib.SequenceMatcher(None, x, t).ratio() for t in terms) for x in words}
    assert {x: round(r, 2) for x, r in best.items() if r >= documents.MIN_RATIO} == found and len(found) > 20


def test_nearest_against_brute_force(spark, monkeypatch):
    """Bounds lose no pair: accents, letters of no term, words beyond 64 letters, several slices, ties."""
    import difflib

    from reportlake.operators import documents, near

    rng = random.Random(9)
    one = lambda parts: "".join(rng.choice(["ba", "sho", "vy", "the", "ül", "k", " "]) for _ in range(parts)).strip()
    terms = sorted({t for n in (2, 3, 4, 6, 8, 40) for t in (one(n) for _ in range(60)) if len(t) > 1 and "  " not in t})
    bent = lambda t: "".join(c if rng.random() > 0.12 else rng.choice(["", c + "q", "z"]) for c in t)
    words = sorted({w for w in (bent(t) for t in terms) if len(w) > 1 and w == w.strip() and "  " not in w} - set(terms))
    assert any(len(w) > 64 for w in words)
    want = {}
    for w in words:
        close = [(-r, t) for t in terms for r in [difflib.SequenceMatcher(None, w, t).ratio()] if 0.75 <= r < 0.99]
        if close:
            r, t = min(close)
            want[w] = (t, -r)

    class Sent:
        value = near.Slice(terms)

    got = pd.concat(near.nearest(Sent, 0.75)(iter([pd.DataFrame({"word": words})])))
    assert len(want) > 100 and {w: (t, r) for w, t, r in got.itertuples(index=False)} == want
    none = pd.concat(near.nearest(type("Sent", (), {"value": near.Slice([])}), 0.75)(iter([pd.DataFrame({"word": words})])))
    assert not len(none)
    monkeypatch.setattr(documents, "SLICE", 100)
    column = lambda xs, c: spark.createDataFrame([(x,) for x in xs], f"{c} string")
    found = documents.near_terms(column(words, "word"), column(terms, "term"), 0.75).where("reason = 'spelling'").collect()
    assert {r.word: r.term for r in found} == {w: t for w, (t, _) in want.items()}
