"""Small cases with known answers: subjects, audits, rejections, symbols, catalogs."""

import random

import pytest
from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.operators import catalog, chunking, health, jobs, reports, subjects, symbols, vectors
from cairn.sources import converted


def test_subjects_of_a_query(spark):
    catalog_rows = [("subject-hydraulics", t) for t in ("hydraulics", "fluid power", "hydraulic")] + [("subject-safety", "safety"), ("subject-electrical", "electrical")]
    terms = spark.createDataFrame(catalog_rows, "subject_id string, term string")
    asked = spark.createDataFrame([(1, "How do I troubleshoot fluid power pressure?"), (2, "nothing here"), (3, "hydraulicss"), (4, "Safety, electrical"), (5, None)], "q int, text string")
    got = {r["q"]: r["subject_id"] for r in symbols.inferred_subject(asked, terms, "q", "text").collect()}
    assert got == {1: "subject-hydraulics", 4: "subject-electrical"}
    assert symbols.inferred_subject(asked, terms.limit(0), "q", "text").count() == 0
    chunks = spark.createDataFrame([(1, ["subject-hydraulics"]), (2, []), (3, None)], "id int, subject_ids array<string>")
    assert [r["b"] for r in chunks.select("id", F.coalesce(subjects.boost(F.col("subject_ids"), "subject-hydraulics"), F.lit(0.0)).alias("b")).orderBy("id").collect()] == [0.05, 0.0, 0.0]


def test_first_words_beyond_the_list(spark, monkeypatch):
    terms = spark.createDataFrame([("a", "one two"), ("b", "two")], "subject_id string, term string")
    texts = spark.createDataFrame([(1, "x one two"), (2, "two"), (3, "one")], "q int, text string")
    want = [(1, "a"), (2, "b")]
    assert sorted(map(tuple, symbols.inferred_subject(texts, terms, "q", "text").collect())) == want
    monkeypatch.setattr(symbols, "MOST_FIRST", 1)
    assert sorted(map(tuple, symbols.inferred_subject(texts, terms, "q", "text").collect())) == want


def test_replies_are_checked(spark):
    known = F.array(F.lit("a"), F.lit("b"), F.lit("c"), F.lit("d"), F.lit("e"))
    one = ("a", 0.9, ["seen"])
    cases = {
        "fine": (one, [("b", 0.7, ["x"])]), "none": (None, []), "many": (one, [(s, 0.9, ["x"]) for s in "bcde"]), "unknown": (("z", 0.9, ["x"]), []), "high": (("a", 1.1, ["x"]), []), "nan": (("a", float("nan"), ["x"]), []),
        "bare": (("a", 0.9, []), []), "much": (("a", 0.9, [str(i) for i in range(7)]), []), "long": (("a", 0.9, ["x" * 513]), []), "blank": (("a", 0.9, [" "]), []), "same": (("a", 0.9, ["X  y", "x y"]), []),
        "twice": (one, [("a", 0.9, ["x"])]), "other": (one, [("b", -1.0, ["x"])]), "null": (one, None),
    }
    rows = spark.createDataFrame([(k, *v) for k, v in cases.items()], f"k string, primary {subjects.SELECTION}, secondary array<{subjects.SELECTION}>")
    got = {r["k"]: r["e"] for r in rows.select("k", subjects.reply_error(F.col("primary"), F.col("secondary"), known).alias("e")).collect()}
    assert got == {
        "fine": None, "null": None, "none": "PrimaryMissing", "many": "TooManySubjects", "unknown": "UnknownSubject", "high": "Confidence", "nan": "Confidence", "bare": "NoEvidence", "much": "TooMuchEvidence", "long": "EvidenceLength",
        "blank": "EvidenceLength", "same": "EvidenceRepeated", "twice": "SubjectRepeated", "other": "Confidence",
    }


def test_boundary_audit(spark):
    rows = [
        ("l/1/a/0", "page-a", "Refer to the AxisFault. \n"), ("l/1/a/1", "page-a", "  Disabled state is the cleared latch. Long.Path."), ("l/1/a/10", "page-a", "Éa. no"), ("l/1/a/2-1", "page-a", ".NET is here"),
        ("l/1/a/2", "page-a", "Inner and so Long."), ("l/1/b/0", "page-b", ".gitignore first. Set AxisFault.Disabled and Long.Path.Inner to acknowledge; 1x.Foo.y, Foo.Baré."), ("l/1/b/x", "page-c", "Foo."), ("l/1/b/1", "page-c", "Bar"), ("l/1/b/3", "page-d", "9."), ("l/1/b/4", "page-d", "y"),
    ]
    got = {(r["page"], r["prev_id"], r["next_id"], r["kind"], r["name"]) for r in chunking.boundary_issues(spark.createDataFrame(rows, "chunk_id string, page string, content string")).collect()}
    assert got == {("page-a", "l/1/a/0", "l/1/a/1", "Name", "AxisFault.Disabled"), ("page-a", "l/1/a/1", "l/1/a/2", "Pair", "Path.Inner"), ("page-a", None, "l/1/a/2-1", "LeadingDot", None)}
    ids = spark.createDataFrame([("a/12-3",), ("12",), ("a/b",), ("a/1-",), ("x/-2",), ("x/99999999999-1",)], "i string").select("i", chunking.ordinal(F.col("i")).alias("o")).collect()
    assert {r["i"]: tuple(r["o"]) for r in ids} == {"a/12-3": (12, 3), "12": (12, 0), "a/b": (0, 0), "a/1-": (1, 0), "x/-2": (0, 2), "x/99999999999-1": (0, 1)}


def window_of(text, token, around=100, cap=200):
    at = text.find(token)
    if at < 0:
        return None
    left, right = max(0, at - around), min(len(text), at + len(token) + around)
    while left > 0 and not text[left - 1].isspace():
        left -= 1
    while right < len(text) and not text[right].isspace():
        right += 1
    shown = " ".join(text[left:right].split())
    if len(shown) <= cap:
        return shown
    before = shown.find(token)
    after, room = len(shown) - before - len(token), cap - len(token)
    keep_after = min(after, room - min(before, room // 2))
    keep_before = min(before, room - keep_after)
    return shown[before - keep_before : before + len(token) + keep_after].strip()


def test_sample_windows(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choices("abcé.", k=rnd.choice([1, 3, 8, 40, 130])))
    texts = ["".join(w + rnd.choice([" ", "  ", "\n", "\t "]) for w in (word() for _ in range(rnd.randint(0, 30)))) for _ in range(300)]
    rows = [(i, t, rnd.choice([t.split() or ["none"], ["none"]])[0] if i % 3 else rnd.choice(t.split() or ["none"])) for i, t in enumerate(texts)] + [(900, "x" * 5000, "xx"), (901, None, "a"), (902, "long " * 50_000 + "end", "end"), (903, "é" * 900 + "key" + "y" * 900 + " z", "key"), (904, "a " * 900 + "b" * 499 + "key" + "c" * 501, "key"), (905, "a " + "b" * 500 + "key" + " c" * 900, "key"), (906, "b" * 500 + "key" + "c" * 500, "key"), (907, "long " * 50_000 + "q" * 3000 + "key", "key")]
    got = {r["i"]: r["w"] for r in spark.createDataFrame(rows, "i int, text string, token string").select("i", T.sample_window(F.col("text"), F.col("token")).alias("w")).collect()}
    assert all(got[i] == (None if t is None else window_of(t, k)) for i, t, k in rows)


def test_rejected_samples_by_third(spark):
    texts = [f"lead {i} noise tail {i}" + (" rare" if i == 4 else "") for i in range(9)]
    chunks = spark.createDataFrame(list(enumerate(texts)), "index long, content string")
    judged = spark.createDataFrame([(i, "noise", "NoStructureSignal" if i > 1 else "Unit") for i in range(9) if i != 3] + [(4, "rare", "Unit"), (5, "kept", None), (8, "gone", "Unit")], "index long, name string, reason string")
    got = {r["name"]: tuple(r)[1:] for r in symbols.rejected_samples(judged, chunks, 9).collect()}
    assert got["noise"] == ("Unit", 8, [texts[0], texts[4], texts[6]]) and got["rare"] == ("Unit", 1, [texts[4]]) and got["gone"] == ("Unit", 1, []) and set(got) == {"noise", "rare", "gone"}


def test_samples_are_not_joined_back(spark):
    judged = spark.createDataFrame([(0, "a", "Unit"), (1, "a", "Unit")], "index long, name string, reason string")
    found = symbols.rejected_samples(judged, spark.createDataFrame([(0, "a b")], "index long, content string"), 2)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1  # of names with texts
    assert [tuple(r) for r in found.collect()] == [("a", "Unit", 2, ["a b"])]  # the other chunk has no text


def test_abbreviations_and_units(spark):
    rows = [("1", "uses RAM once"), ("2", "TCP here. TCP there, TCP! kHz Mhz KM 12 ohms Kelvin RPM rpm k Menu lets Motion Motion Motion")]
    got = {r["name"]: r["reason"] for r in symbols.judged(spark.createDataFrame(rows, "chunk_id string, content string")).collect()}
    want = {"RAM": "NoStructureSignal", "TCP": "LikelyAbbreviation", "kHz": "Unit", "Mhz": "Unit", "KM": "NoStructureSignal", "ohms": "Unit", "RPM": "Unit", "Menu": "GlobalStoplist", "lets": "GlobalStoplist", "uses": "GlobalStoplist", "Motion": None, "k": "GlobalStoplist"}
    assert {k: got.get(k, "absent") for k in want} == want


def test_rejections_by_third(spark):
    rows = spark.createDataFrame([(i, "noise", "NoStructureSignal") for i in (0, 15, 29)] + [(3, "kept", None)], "i int, name string, reason string")
    assert [tuple(r) for r in symbols.rejections(rows, "i", 30).collect()] == [("noise", 3, "NoStructureSignal", [0, 1, 2])]


def test_audit_summary_and_filters(spark):
    rows = spark.createDataFrame([("Indexed", None)] * 2 + [("Skipped", "OffSiteDepth")] * 2 + [("Skipped", "PatternExclude")], "status string, reason string")
    got = {(r["kind"], r["value"]): r["n"] for r in health.group_counts(rows, ["status", "reason"]).collect()}
    assert got["status", "Indexed"] == 2 and got["status", "Skipped"] == 3 and got["reason", "OffSiteDepth"] == 2 and got["reason", "PatternExclude"] == 1
    names = spark.createDataFrame([("MoveLinear",), ("axis_a",)], "name string")
    assert [symbols.named(names, "name", p).count() for p in (None, "", "  ", "move", "S_A", "x%")] == [2, 2, 2, 1, 1, 0]


def test_symbol_kinds(spark):
    text = "class Motor and enum RampMode; def run_all; MoveLinear( list< Controller.Connect AxisStatus in_out KG mm thing"
    found = {r["name"]: r["kind"] for r in symbols.symbols(spark.createDataFrame([("1", text)], "chunk_id string, content string"), stoplist=["and"], likely=["thing"], methods_snake=True, units=["kg", "mm"]).collect()}
    assert {k: found.get(k) for k in ("Motor", "RampMode", "run_all", "MoveLinear", "list", "Controller.Connect", "AxisStatus", "in_out", "thing")} == {
        "Motor": "Type", "RampMode": "Enum", "run_all": "Function", "MoveLinear": "Function", "list": "Type", "Controller.Connect": "Property", "AxisStatus": "Type", "in_out": "Function", "thing": "Type",
    }
    assert "KG" not in found and "mm" not in found


def test_quantiles(spark):
    import numpy as np

    r = np.random.default_rng(1)
    values = {"a": r.normal(size=501).round(2).tolist(), "b": [1.0] * 99 + [2.0], "c": [5.0], "d": [3.0, 4.0]}
    rows = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs] + [("e", None), ("a", None)], "k string, v double")
    got = {x["k"]: (x["p50"], x["p95"]) for x in health.quantiles(rows, "k", "v", {"p50": 0.5, "p95": 0.95}).collect()}
    assert set(got) == set("abcd")
    for k, vs in values.items():
        assert got[k] == pytest.approx((np.quantile(vs, 0.5), np.quantile(vs, 0.95)))


def test_snapshots_and_dashboards(spark):
    versions = spark.createDataFrame([], "library_id string, version string, suspect boolean")
    rows = spark.createDataFrame([], "status string, last_progress timestamp, created timestamp")
    assert tuple(reports.dashboard(versions, rows, F.current_timestamp()).first()) == (0, 0, 0, 0, "scrape_docs")
    assert reports.boundary_pct(F.lit(1), F.lit(0)) is not None
    row = spark.range(1).select(*[jobs.ingest_state(*[F.lit(x) for x in s]).alias(f"s{i}") for i, s in enumerate([(True, True, False, 0, False, False), (False, True, True, 1, False, False), (False, False, False, 0, False, False), (False, False, True, 0, True, False), (False, False, True, 1, True, True), (False, False, True, 1, False, True), (False, False, True, 1, False, False)])]).first()
    assert list(row) == ["IN_PROGRESS", "URL_SUSPECT", "RECON_NEEDED", "READY_TO_SCRAPE", "STALE", "READY_TO_SCRAPE", "READY"]


def test_cycles_and_fallbacks_of_converted_documents(spark):
    cyclic = '{"body": {"children": [{"$ref": "#/groups/0"}, {"$ref": "#/texts/1"}, {"$ref": "#/none"}]}, "groups": [{"self_ref": "#/groups/0", "children": [{"$ref": "#/texts/0"}, {"$ref": "#/groups/0"}]}], "texts": [{"text": "a", "label": "Title", "children": [{"$ref": "#/texts/1"}]}, {"text": "b", "label": "section_header", "level": 3}]}'
    flat = '{"texts": [{"text": "x", "label": "text"}], "tables": [{"label": "table"}]}'
    rows = spark.createDataFrame([(1, cyclic), (2, flat), (3, "{}"), (4, None)], "document_id int, document string")
    got = sorted((r["document_id"], r["nth"], r["kind"], r["level"], r["text"]) for r in converted.blocks(rows).collect())
    assert got == [(1, 0, "Heading", 1, "a"), (1, 1, "Heading", 3, "b"), (2, 0, "Text", None, "x"), (2, 1, "Table", None, None)]


def test_reembedding_and_zip(spark):
    a, b = catalog.numbered(spark.createDataFrame([("b",), ("a",)], "k string"), ["k"]), catalog.numbered(spark.createDataFrame([(2,), (1,)], "v int"), ["v"])
    assert sorted((r["k"], r["v"]) for r in catalog.zipped(a, b).collect()) == [("a", 1), ("b", 2)]
    with pytest.raises(ValueError):
        catalog.zipped(a, b.limit(1))
    assert vectors.candidate_count(1) == 50
