import base64
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reportlake.llm import bpe, identifiers, mixing, names, neighbours, queries, scans, skeleton, terms

SMALL = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_runs(spark, name):
    df = queries.QUERIES[name](spark, SMALL)
    assert df.count() >= 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    import run_query

    got, want = queries.QUERIES[name](spark, SMALL).toPandas(), run_query.oracle(SMALL).sql(queries.ORACLE[name]).df()
    assert run_query.canonical(got) == run_query.canonical(want)


# p1


def page(table, spark, *given):
    schema = table("ocr_results").schema
    return spark.createDataFrame([{f.name: None for f in schema.fields} | g for g in given], schema)


VOCABULARY = "family asked about effusion explained that images cannot show every small change here".split()


def scan_pages(table, spark):
    """Pages of three scans with a header, page numbers, broken, split and misread words."""
    rng, pages = random.Random(4), []
    line = lambda n: " ".join(rng.choice(VOCABULARY) for _ in range(n))
    for s in range(3):
        for n in range(1, 5):
            lines = [f"Archive copy {s}/9", "", *(line(9) for _ in range(14)), f"{line(8)} effu-", f"- {n} -"]
            if n > 1:
                lines[2] = f"sion {line(8)}"
            if (s, n) == (1, 2):
                lines[6], lines[7] = f"{line(4)} farnily {line(4)}", f"{line(4)} exp lained {line(3)}"
            pages.append({"page_id": s * 10 + n, "scan_id": f"s{s}", "page_no": n, "text": "\n".join(lines)})
    return page(table, spark, *pages, pages[0])


def test_scans_found(spark, table):
    got = rows(scans.found(scan_pages(table, spark)))
    kinds = {k: {(p, i) for p, i, q in got if q == k} for k in ("running", "pageno", "hyphen", "misread")}
    ids = [s * 10 + n for s in range(3) for n in range(1, 5)]
    assert kinds["running"] == {(p, 0) for p in ids} and kinds["pageno"] == {(p, 17) for p in ids}
    assert kinds["hyphen"] == {(p, 16) for p in ids if p % 10 < 4}
    assert kinds["misread"] == {(12, 6), (12, 7)}


def test_scans_paragraphs(spark, table):
    text = {r.scan_id: r.text for r in scans.paragraphs(scan_pages(table, spark)).where("paragraph = 0").collect()}
    assert "effu-" not in text["s1"].replace("effu-", "", 1) and "farnily" not in text["s1"] and "exp lained" not in text["s1"]
    assert "Archive" not in text["s1"] and " sion " not in text["s1"]


def test_scans_correct_in_context(spark, table):
    """One misreading of two words, told apart by the neighbours of each occurrence."""
    rng, pages = random.Random(9), []
    for n in range(30):
        lines = [f"the lower harn lies behind {rng.choice(['here', 'there'])} today", f"we barn old wood slowly {rng.choice(['now', 'then'])} again"] * 3
        edge = lambda: ["".join(rng.choice("bdfgkpz") + rng.choice("aeo") for _ in range(6)) + " edge" for _ in range(3)]
        lines = [*edge(), *lines, *edge()]
        pages.append({"page_id": n, "scan_id": "s", "page_no": n + 1, "text": "\n".join(lines)})
    pages.append({"page_id": 50, "scan_id": "t", "page_no": 1, "confidence": 60.0, "text": "one\ntwo\nthree\nthe lower liarn lies behind here today\nfour\nfive\nsix\nsize 8.0 x 4.l cm or 62.S mm seen"})
    text = " ".join(r.text for r in scans.paragraphs(page(table, spark, *pages)).where("scan_id = 't'").collect())
    assert "lower harn lies" in text and "8.0 x 4.1 cm or 62.5 mm" in text
    links = spark.createDataFrame([("x", "one", 1, 5, 0.5), ("x", "two", 1, 9, 0.5)], "word string, right string, edits int, m bigint, fit double")
    lined = spark.createDataFrame([(1, 0, ["a", "x", "b"]), (1, 1, ["c", "x", "d"]), (1, 2, ["e", "x"])], "page_id bigint, line_no int, toks array<string>")
    vectors = spark.createDataFrame([("one", "-a", 2.0), ("two", "+d", 1.0), ("one", "+d", 0.5)], "word string, near string, a double")
    assert rows(scans.corrected(lined, links, vectors)) == [(1, 0, "x", "one"), (1, 1, "x", "two"), (1, 2, "x", "two")]


def test_scans_of_nothing(spark, table, nulls):
    assert scans.page_lines(table("ocr_results").limit(0)).count() == 0
    assert scans.page_lines(nulls("ocr_results")).count() == 0
    assert scans.found(table("ocr_results").limit(0)).count() == 0 and scans.paragraphs(nulls("ocr_results")).count() == 0
    assert scans.page_lines(page(table, spark, {"page_id": 1, "text": ""}, {"page_id": 2, "text": "x" * 300_000})).count() == 1


# p3


def test_terms_edges(spark, table, nulls):
    assert terms.term_frequencies(table("corpus_terms").limit(0)).count() == 0
    assert terms.term_frequencies(nulls("corpus_terms")).count() == 0
    schema = table("corpus_terms").schema
    entry = lambda i, t, s: (i, "t", t, None, s)
    data = [entry(1, "Hépa  x", {"a": 2}), entry(1, "Hépa  x", {"a": 2}), entry(2, "HéPA x ", {"a": 1, "b": 1}), entry(3, " ", {"c": 9}), entry(4, "rare", None)]
    got = rows(terms.term_frequencies(spark.createDataFrame(data, schema), max_file_share=0.5))
    assert got == [("hépa x", 4, 2, "common"), ("rare", 0, 0, "rare")]


# p4


def test_identifiers_edges(spark, table, nulls):
    r, t, a, d = (table(x) for x in ("records", "transcriptions", "name_aliases", "referrers"))
    assert identifiers.identifiers(r.limit(0), t.limit(0), a, d).count() == 0
    assert identifiers.identifiers(nulls("records"), nulls("transcriptions"), nulls("name_aliases"), nulls("referrers")).count() == 0


def test_identifier_spans():
    street = "Flat 9B, " + "Old Lane, " * 40 + "Zorimholm - 098970"
    far = "seen. " * 400
    got = [(k, f"{street} and 7 Hill Road, Zor 123456; mail a.b@x.example"[s:e]) for k, s, e in identifiers._spans(f"{street} and 7 Hill Road, Zor 123456; mail a.b@x.example")]
    assert got == [("addr", street), ("addr", "7 Hill Road, Zor 123456"), ("mail", "a.b@x.example")]
    assert identifiers._left("x " + "y" * 500 + " lives at 12", 511) == ("lives at", "at", "")
    assert identifiers._left(far + "copy to ", len(far) + 8)[0] == "copy to"


def test_identifiers_are_repeatable(spark, table):
    tables = [table(t) for t in ("records", "transcriptions", "name_aliases", "referrers")]
    assert rows(identifiers.identifiers(*tables)) == rows(identifiers.identifiers(*(t.repartition(7) for t in tables)))
    every = table("records").where("id is not null and patient <> ''").select("id", "patient").distinct().count()
    assert identifiers.redacted(*tables).where("place = 'patient'").count() == every


def test_identifiers_found(spark, table):
    schema = table("records").schema
    recs = []
    for i in range(40):
        text = f"CT of the liver\nPatient name: Mr. Bimean Zot{'abcdefgh'[i % 8]}lu\nTel +91-99999-{10000 + i}\nMRN: LK{10000000 + i}\nFINDINGS:\nThe liver is normal.\nThe Tidazo clip sits in place."
        if i == 7:
            text += "\nTel 9876543210\nContact a.b+c@mail.example.net now\nResident of Flat 2B, Kele Enclave, Rupegate - 029873"
        recs.append({f.name: None for f in schema.fields} | {"id": f"r{i}", "patient": f"Bimean Zot{'abcdefgh'[i % 8]}lu", "report_text": text})
    recs[3]["patient"] += " W/o Betheom"
    recs += [recs[7]]
    found = identifiers.identifiers(spark.createDataFrame(recs, schema), table("transcriptions").limit(0), table("name_aliases"), table("referrers"))
    got = {tuple(r) for r in found.collect()}
    for want in [("phone", "+91-99999-10007"), ("identity", "LK10000007"), ("name", "Bimean Zothlu"), ("email", "a.b+c@mail.example.net"), ("address", "Flat 2B, Kele Enclave, Rupegate - 029873")]:
        assert ("report_text", "r7", *want) in got, want
    assert not any("Tidazo" in g[3] for g in got)


# p6


def vectors(spark, m, ids=None):
    data = [("chunks", int(i), "e", [float(x) for x in v] if v is not None else None) for i, v in zip(ids or range(len(m)), m, strict=True)]
    return spark.createDataFrame(data, "src string, id bigint, embedder string, vector array<double>")


def brute(m, k=10, low=0.8):
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = (u @ u.T).round(6)
    np.fill_diagonal(s, -2)
    top = [set(np.argsort(-r, kind="stable")[:k]) for r in s]
    return {("chunks", i, j) for i in range(len(m)) for j in top[i] if i < j and i in top[j] and s[i, j] >= low}


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(1)
    m = np.abs(rng.standard_normal((1500, 32))) * (rng.random((1500, 32)) < 0.3) + 1e-3
    m[700:1000] = m[:300] + 0.1 * rng.random((300, 32))
    m[1000:1030] = m[5] * 3
    got = {tuple(r) for r in neighbours.mutual_neighbours(vectors(spark, m)).collect()}
    want = brute(m)
    assert len(got & want) >= 0.98 * len(want) and len(got - want) <= 0.02 * len(want)


def test_graph_recall(spark):
    m = np.abs(np.random.default_rng(2).standard_normal((2000, 24)))
    nodes, _, spaces = neighbours.classes(vectors(spark, m))
    graph = neighbours.neighbour_graph(nodes, spaces).toPandas()
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    got = {i: set(g.sort_values("sim", ascending=False).dst.head(10)) for i, g in graph.groupby("src")}
    recall = np.mean([len(got[i] & set(np.argsort(-s[i])[:10])) / 10 for i in range(len(m))])
    assert recall >= 0.9, recall


def test_greedy_search_recall(spark):
    m = np.abs(np.random.default_rng(6).standard_normal((2000, 24)))
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    got = neighbours.search_rows(vectors(spark, m), every=40).toPandas()
    assert got.groupby("query").size().eq(10).all() and got["query"].nunique() == 50
    s = u @ u.T
    np.fill_diagonal(s, -2)
    recall = np.mean([len(set(g.id) & set(np.argsort(-s[q])[:10])) / 10 for q, g in got.groupby("query")])
    assert recall >= 0.9, recall


def test_greedy_search_from_outside(spark):
    """Queries that are no rows of the collection enter at fixed nodes."""
    rng = np.random.default_rng(7)
    m = np.abs(rng.standard_normal((2000, 24)))
    nodes, _, spaces = neighbours.classes(vectors(spark, m))
    graph = neighbours.neighbour_graph(nodes, spaces)
    q = np.abs(rng.standard_normal((40, 24)))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    asked = spark.createDataFrame([(0, i, x.astype(np.float32).tobytes(), None) for i, x in enumerate(q)], "space int, query bigint, vec binary, entry bigint")
    got = neighbours.greedy_search(asked, graph, nodes).toPandas()
    s = q @ (m / np.linalg.norm(m, axis=1, keepdims=True)).T
    recall = np.mean([len(set(g.sort_values("sim", ascending=False).node.head(10)) & set(np.argsort(-s[i])[:10])) / 10 for i, g in got.groupby("query")])
    assert recall >= 0.9, recall


def test_hubs_meet_others_each_round(spark):
    """One vector near to all: its neighbourhood is far beyond a block."""
    rng = np.random.default_rng(8)
    m = np.vstack([np.ones((1, 16)), 1 + 0.6 * rng.standard_normal((1800, 16))])
    nodes, _, spaces = neighbours.classes(vectors(spark, m))
    graph = neighbours.neighbour_graph(nodes, spaces).toPandas()
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    recall = np.mean([len(set(g.sort_values("sim", ascending=False).dst.head(10)) & set(np.argsort(-s[i])[:10])) / 10 for i, g in graph.groupby("src")])
    assert recall >= 0.9, recall


def test_vectors_are_packed(spark):
    """Sparse vectors take little of the disk, and come back bit for bit."""
    rng = np.random.default_rng(3)
    for v in (np.zeros(256), rng.standard_normal(256), rng.standard_normal(7), np.arange(256) % 9 == 0):
        v = v.astype(np.float32)
        assert (neighbours.vector(neighbours.packed(v.tobytes())) == v).all()
    m = (rng.random((50, 256)) < 0.1) * rng.choice([0.07, 0.14], (50, 256))
    nodes, _, _ = neighbours.classes(vectors(spark, m))
    assert nodes.selectExpr("max(length(vec)) n").first().n < 512


def test_neighbours_edges(spark):
    assert neighbours.mutual_neighbours(vectors(spark, [])).count() == 0
    bad = vectors(spark, [None, [0.0, 0.0], [1.0, float("nan")], [1.0, 1.0], [2.0, 2.0], [1.0, 1.0], []], [1, 2, 3, 4, 5, 4, 9])
    assert rows(neighbours.mutual_neighbours(bad)) == [("chunks", 4, 5)]


# p7


def test_names(spark, table):
    schema = table("records").schema
    rec = lambda i, p, a, y, **k: {f.name: None for f in schema.fields} | {"id": i, "tenant": "t", "patient": p, "age_sex": a, "created": f"{y}-06-01T00:00:00"} | k
    data = [
        rec("a1", "Mrs. Kushamila Devirastogi", "40 / F", 2024), rec("a2", "DEVIRASTOGI, KUSHAMILA", "F/41", 2025), rec("a3", "K. Devirastogi", "40Y/F", 2024),
        rec("a4", "Kushamila Devirastgoi", None, 2024), rec("b1", "Kushamila  Devirastogi", "72 / F", 2024), rec("c1", "Pavitran Lokanuthen", "30 / M", 2024),
        rec("d1", "Unknown", "30 / M", 2024), rec("d2", "unknown", "30 / M", 2024), rec("e1", None, None, 2024), rec("a1", "Mrs. Kushamila Devirastogi", "40 / F", 2024),
        rec("x1", "Kushamila Devirastogi", "40 / F", 2024, tenant="other"),
    ]
    got = rows(names.patient_pairs(spark.createDataFrame(data, schema)))
    assert got == [("a1", "a2"), ("a1", "a3"), ("a1", "a4"), ("a2", "a3"), ("a2", "a4"), ("a3", "a4")] or {("a1", "a2"), ("a1", "a3"), ("a2", "a3")} <= set(got)
    assert not any(x in ("c1", "d1", "d2", "x1") for pair in got for x in pair)


def name_nodes(spark, data):
    """Nodes of (words, initials, lo, hi) in one tenant."""
    schema = "node bigint, space string, sex string, words array<string>, initials array<string>, lo double, hi double, weight bigint"
    return spark.createDataFrame([(n, "t", None, sorted(w), sorted(i), lo, hi, 1) for n, (w, i, lo, hi) in enumerate(data)], schema)


def name_pairs(nodes):
    """Brute force: every pair of nodes above the cosine that agree word by word."""
    vectors, got = names.Vectors(*names.bigram_weights(nodes)), []
    bags = sorted((r.node, list(r.words), list(r.initials)) for r in nodes.collect())
    for k, (a, wa, ia) in enumerate(bags):
        for b, wb, ib in bags[k + 1 :]:
            if vectors.agreement((wa, ia), (wb, ib)) is not None and vectors.cosine(vectors.vector(wa, ia), vectors.vector(wb, ib)) >= names.MIN_COSINE:
                got.append((a, b))
    return sorted(got, key=repr)


@pytest.mark.parametrize("size", [60, 240])
def test_names_reach_every_pair(spark, size):
    rng = random.Random(size)
    letters = lambda k: "".join(rng.choice("aeiknrst") for _ in range(k))

    def typed(w, edits):
        for _ in range(edits):
            at, c = rng.randrange(len(w)), rng.choice("aeioxyz")
            w = rng.choice([w[:at] + w[at + 1 :], w[:at] + c + w[at:], w[:at] + c + w[at + 1 :]])
        return w

    data = []
    for _ in range(size):
        p, q = letters(rng.randint(3, 9)), letters(rng.randint(4, 10))
        at = lambda: rng.choice([(1980.0, 1981.0), (None, None)])
        data += [([p, q], [], *at()), ([p, typed(q, 2)], [], *at()), ([typed(p, 1), typed(q, 1)], [], *at()), ([typed(q, 2)], [p[0]], *at()), ([p, q[:3], q[3:]], [], *at())]
    nodes = name_nodes(spark, [(list(filter(lambda w: len(w) > 1, w)) or ["none"], i, lo, hi) for w, i, lo, hi in data])
    want = name_pairs(nodes)
    assert len(want) > size and rows(names.linked(nodes).select(F.least("a", "b"), F.greatest("a", "b"))) == want


def test_names_of_many_ages(spark, table):
    schema = table("records").schema
    rec = lambda i, p, born: {f.name: None for f in schema.fields} | {"id": i, "tenant": "t", "patient": p, "age_sex": f"{2020 - born} / F", "created": "2020-01-01T00:00:00"}
    hot = [rec(f"y{y}", "Kushamila Devirastogi", y) for y in range(1930, 2011)]
    recs = spark.createDataFrame([*hot, rec("v", "Kushamila Devirastgoi", 1934), rec("w", "Kushamila Devirastgoi", 2006)], schema)
    nodes, _ = names.people_nodes(names.patient_mentions(recs))
    assert nodes.where(F.col("hi") - F.col("lo") > names.AGE_SLACK).count() == 0
    got = set(rows(names.patient_pairs(recs)))
    # the runs on both sides fit too; linkage takes one of them
    assert {a for a, _ in got} == {"v", "w"} and all(abs(int(b[1:]) - {"v": 1934, "w": 2006}[a]) <= 2 * names.AGE_SLACK for a, b in got)


def test_same_word():
    def plain(x, y):
        row = list(range(len(y) + 1))
        for k, c in enumerate(x, 1):
            last, row = row, [k]
            for m, d in enumerate(y, 1):
                row.append(min(last[m] + 1, row[-1] + 1, last[m - 1] + (c != d)))
        return row[-1]

    rng = random.Random(8)
    for _ in range(3000):
        x, y = ("".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in "xy")
        short = min(len(x), len(y))
        most, e = 2 if short >= names.TWO_EDITS else 1 if short >= names.ONE_EDIT else 0, plain(x, y)
        assert names.same_word(x, y) == (e if e <= most else None)


def test_linkage_by_rounds(spark):
    rng = random.Random(2)
    edges = [(a, b, rng.random(), 1 + a % 3, 1 + b % 3) for a in range(40) for b in range(a + 1, 40) if rng.random() < 0.15]
    df = spark.createDataFrame(edges, "a bigint, b bigint, strength double, a_weight bigint, b_weight bigint")
    alone = rows(names.average_linkage(df, 0.1))
    assert alone == rows(names.average_linkage(df, 0.1, most=10)) == rows(names.linkage_by_rounds(df, 0.1))
    assert len({c for _, c in alone}) > 1


def test_referrers(spark, table):
    schema = table("records").schema
    rec = lambda i, r: {f.name: None for f in schema.fields} | {"id": i, "referrer": r}
    doctors = spark.createDataFrame(
        [("R1", "Dr. Pavitran M. Lokanuthen", "MD", "x", "Ooty"), ("R2", "Dr. Sumitra Lokanuthen", "MS", "x", "Ooty"), ("R3", "Dr. Anand Verkatesh", "MD", "x", "Ooty")],
        "referrer_id string, full_name string, qualification string, clinic string, city string",
    )
    typed = ["Dr. Pavitran M. Lokanuthen", "LOKANUTHEN, PAVITRAN", "Dr P. Lokanuthen MD", "Dr Lokanuthen", "dr verkatesh", "Pavitran Lokanutehn (Ooty)", "Dr S Lokanuthen", "unknown", "", None]
    got = rows(names.referrer_links(spark.createDataFrame([rec(f"i{n}", r) for n, r in enumerate(typed)], schema), doctors))
    assert got == [("i1", "R1"), ("i2", "R1"), ("i4", "R3"), ("i5", "R1"), ("i6", "R2")]


def test_names_edges(spark, table, nulls):
    none = names.linked_names(table("records").limit(0), table("referrers"), table("name_aliases"))
    assert none.count() == 0
    assert names.linked_names(nulls("records"), nulls("referrers"), nulls("name_aliases")).count() == 0


# p8


def test_bpe_against_library(spark):
    import tiktoken

    raw = open(bpe.DEFAULT_VOCABULARY, "rb").read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    ref = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    texts = ["", "a", "  spaces\n\n tab\t", "don't we'll", "日本語 ünïcode 👍🏽", "x" * 5000, "".join(rng.choice("abcdeth ") for _ in range(20_000))]
    texts += ["".join(rng.choice("aeioutnrs") for _ in range(rng.randint(1, 60))) for _ in range(300)]
    encode = bpe.make_encoder(raw)
    assert [encode(t) for t in texts] == [ref.encode_ordinary(t) for t in texts]
    df = spark.createDataFrame([(1, None), (2, ""), (3, "hi"), (3, "hi")], "doc_id bigint, text string").withColumn("ids", F.lit(1))
    assert rows(bpe.token_ids(df)) == [(1, []), (2, []), (3, ref.encode_ordinary("hi")), (3, ref.encode_ordinary("hi"))]


# p9


def test_shares():
    s = [mixing.Source("a", 1000, 0.5, 1), mixing.Source("b", 100, 0.3, 4), mixing.Source("c", 400, 0.2, 2), mixing.Source("none", 0, 0.1, 2)]
    total, _ = mixing.plan_shares(s, 1000)
    assert all(x.share * total <= x.max_repeats * x.tokens * (1 + 1e-9) for x in s) and abs(sum(x.share for x in s) - 1) < 1e-9
    tight = [mixing.Source("a", 1000, 0.5, 1), mixing.Source("b", 10, 0.5, 2)]
    total, _ = mixing.plan_shares(tight, 500)
    assert round(tight[1].share * total) == 20 and round(tight[0].share * total) == 480
    assert mixing.plan_shares([])[0] == 0
    shares = mixing.tempered([900, 90, 10], 0.9)
    assert abs(mixing.entropy(shares) - 0.9) < 1e-6 and shares[0] > shares[1] > shares[2]
    assert abs(mixing.entropy(mixing.tempered([900, 90, 10], 9.0)) - math.log(3)) < 1e-3


def test_mix_nears_targets(spark):
    rng = random.Random(5)
    docs = [(i, "abc"[min(2, i % 7)], " ".join(rng.choice(VOCABULARY) for _ in range(30))) for i in range(1400)]
    weights = spark.createDataFrame([("a", 0.3, 4), ("b", 0.5, 3), ("c", 0.2, 2)], "source string, target_share double, max_repeats int")
    uses, report = mixing.mix(spark.createDataFrame(docs, "doc_id bigint, source string, text string"), weights)
    for r in report.collect():
        assert abs(r.actual_share - r.target_share) < 0.01
    orders = uses.where("source = 'b'").groupBy("use_no").agg(F.array_sort(F.collect_set(F.struct("turn", "block_no"))).alias("o")).collect()
    assert all([x.turn for x in r.o] == list(range(len(r.o))) for r in orders)


def test_mix_spends_budgets(spark, table, nulls):
    uses, report = mixing.mix(table("documents"), table("source_weights"))
    per = {r.source: r for r in report.collect()}
    for r in per.values():
        assert r.used_tokens <= r.budget and r.used_tokens <= r.max_repeats * r.tokens
    again = uses.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k"), F.first("source").alias("source"))
    assert all(r.k <= per[r.source].max_repeats for r in again.collect())
    assert rows(uses) == rows(mixing.mix(table("documents"), table("source_weights"))[0])
    assert mixing.mix(table("documents").limit(0), table("source_weights"))[0].count() == 0
    assert mixing.mix(nulls("documents"), table("source_weights").limit(0))[0].count() == 0


# p10


def test_skeleton(spark, nulls, table):
    same = ["café fin x-y", "café ﬁn x‑y", "cаfé fin\u200b x-y", "ｃafé fin x-y", "café fin x-y\r\n"]
    make = skeleton.make_skeleton(skeleton.prototypes(spark))
    assert len({make(t) for t in same}) == 1 and make("cafe fin x-y") != make(same[0]) and make("m²") != make("m2")
    for a, b in (("к", "k"), ("т", "t"), ("ɡ", "g"), ("Ꭺ", "A"), ("ı", "i"), ("ν", "v"), ("Ӏ", "l"), ("1", "l"), ("0", "O"), ("m", "rn"), ("a\u034fb", "ab"), ("’", "'")):
        assert make(f"x{a}y") == make(f"x{b}y"), (a, b)
    docs = spark.createDataFrame([*enumerate(same), (9, same[0]), (10, " "), (11, None), (12, "\xa0"), (13, "other")], "doc_id bigint, text string")
    got = {tuple(r) for r in skeleton.look_alike_pairs(docs).collect()}
    ids = [0, 1, 2, 3, 4, 9]
    assert got == {(a, b) for a in ids for b in ids if a < b and (a, b) != (0, 9)}
    classes = {r.doc_id: (r.class_id, r.members, r.spellings) for r in skeleton.look_alike_classes(docs.unionAll(docs)).collect()}
    assert classes == {i: (0, 6, 5) for i in ids} | {13: (13, 1, 1)}
    assert skeleton.look_alike_pairs(nulls("documents")).count() == 0 and skeleton.with_skeleton(table("documents").limit(0)).count() == 0
    assert skeleton.look_alike_classes(nulls("documents")).count() == 0
