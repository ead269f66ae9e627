"""Symbol candidates and subject catalogs on small fixtures."""

import hashlib
import random
from collections import Counter

from cairn.operators import symbols
from cairn.operators.candidates import candidates, names_used
from cairn.operators.symbols import judged
from cairn.operators.taxonomy import reconciled

OLD = "library_id string, revision int, id string, label string, aliases array<string>, description string"
NEW = "library_id string, document_id string, nth int, subject_id string, label string, aliases array<string>, description string"


def test_candidates(spark):
    text = "public class  Foo<T> calls std::vector.push(x), Foo(1); my-lib struct Foo\nmy1class Bar éclass Baz function, Qux a.b->c"
    rows = candidates(spark.createDataFrame([("1", text), ("2", None), ("3", "")], "chunk_id string, content string")).orderBy("nth").collect()
    got = {(r["name"], r["callable"], r["generic"], r["keyword"]) for r in rows}
    assert ("Foo", False, True, "class") in got and ("Foo", True, False, None) in got and ("Foo", False, False, "struct") in got
    assert ("std::vector.push", True, False, None) in got and ("my-lib", False, False, None) in got
    assert ("Bar", False, False, "class") in got  # the letters before it, back to a digit
    assert ("Baz", False, False, None) in got and ("Qux", False, False, None) in got
    parts = {r["name"]: (r["container"], r["leaf"]) for r in rows}
    assert parts["std::vector.push"] == ("std", "vector.push") and parts["a.b->c"] == ("a.b", "c") and parts["Foo"] == (None, "Foo")
    assert {r["chunk_id"] for r in rows} == {"1"}


def test_same_use_is_one_candidate(spark):
    rows = candidates(spark.createDataFrame([("1", "class A struct A A A( A(")], "chunk_id string, content string")).collect()
    assert sorted((r["nth"], r["name"], r["callable"], r["keyword"]) for r in rows if r["name"] == "A") == [(1, "A", False, "class"), (4, "A", False, None), (5, "A", True, None)]


def test_uses_stay_where_texts_are(spark):
    """Only texts are shuffled, so that those of one chunk meet; uses are neither shuffled nor sorted."""
    rows = spark.createDataFrame([("1", "b class A"), ("2", "A"), ("1", "A( b")], "chunk_id string, content string")
    found = candidates(rows)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(chunk_id" in plan and plan.index("Generate") < plan.index("Exchange")
    assert sorted((r["chunk_id"], r["name"], r["callable"], r["keyword"], r["nth"]) for r in found.collect() if r["name"] != "class") == [("1", "A", False, "class", 2), ("1", "A", True, None, 0), ("1", "b", False, None, 0), ("2", "A", False, None, 0)]


def test_nothing_is_shuffled_for_uses_or_reasons(spark):
    """Texts of chunks with one row stay where they are, and what code and prose say is sent to names."""
    rows = spark.createDataFrame([("1", "class A b"), ("2", "A( Ab Ab Ab"), (None, "c")], "chunk_id string, content string")
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (names_used(rows), judged(rows))]
    assert all("Exchange hashpartitioning" not in p for p in plans) and "BroadcastHashJoin" in plans[1]
    assert {(r["chunk_id"], r["name"]) for r in names_used(rows.union(rows.limit(1))).collect()} == {("1", "class"), ("1", "A"), ("1", "b"), ("2", "A"), ("2", "Ab"), (None, "c")}


def test_facts_that_are_too_many_to_send(spark, monkeypatch):
    texts = ["ABC Motion plain x_y", "Motion Motion ABC", "ABC ```\nf(plain)\n```"]
    rows = spark.createDataFrame(list(enumerate(texts)), "chunk_id int, content string")
    sent = sorted(map(tuple, judged(rows).collect()), key=repr)
    monkeypatch.setattr(symbols, "MOST_SENT", 1)
    assert sorted(map(tuple, judged(rows).collect()), key=repr) == sent and {r[2] for r in sent} >= {None, "LikelyAbbreviation"}


def test_uses_and_leaves_keep_and_reject(spark):
    texts = ["plain class bar then foo( and list< or x.the; y.Is z.kg ABC NASA(", "```\nrun_all(widget)\n```", "a.leafy _p k", "foo plain"]
    rows = judged(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "chunk_id string, content string"), ["the"], ["is"], ["kg"], ["leafy"]).collect()
    got = {(r["chunk_id"], r["name"]): r["reason"] for r in rows}
    assert len(got) == len(rows)
    assert {n: got["0", n] for n in ("bar", "foo", "list", "NASA")} == dict.fromkeys(("bar", "foo", "list", "NASA"))
    assert (got["0", "x.the"], got["0", "y.Is"], got["0", "z.kg"], got["0", "ABC"], got["0", "plain"]) == ("GlobalStoplist", "LibraryStoplist", "Unit", "NoStructureSignal", "NoStructureSignal")
    assert got["1", "widget"] is None and got["2", "a.leafy"] is None and got["2", "_p"] is None and got["2", "k"] == "BelowMinLength"
    assert got["3", "foo"] == "NoStructureSignal"


def test_catalogs(spark):
    old = [("kept", 3, "s1", "Search", ["query"], "Finding."), ("changed", 1, "s1", "Search", ["query"], "Finding."), ("twice", 1, "a", "A", [], "x"), ("twice", 1, "b", "B", [], "x"), ("alone", 2, "a", "A", [], "x")]
    new = [
        ("kept", "d1", 0, None, "Search", ["query", "QUERY"], "Finding."),
        ("changed", "d2", 0, None, "Ranking", [], "Order."), ("changed", "d1", 0, None, "Retrieval", ["QUERY"], "Finding  things."), ("changed", "d3", 0, None, "ranking", ["order"], "Order."),
        ("twice", "d1", 0, None, "a", ["b"], "x"), ("fresh", "d1", 0, None, " One ", None, "First."), ("bad", "d1", 0, "s9", "One", [], "First."), ("blank", "d1", 0, None, " ", [], "First."),
    ]
    rows = {r["library_id"]: r for r in reconciled(spark.createDataFrame(old, OLD), spark.createDataFrame(new, NEW)).collect()}
    assert (rows["kept"]["revision"], rows["kept"]["changed"], rows["kept"]["error"]) == (3, False, None)
    changed = rows["changed"]
    assert (changed["revision"], changed["taxonomy_version"], changed["previous_version"]) == (2, "taxonomy-000002", "taxonomy-000001")
    assert [(c["label"], c["aliases"], c["description"]) for c in changed["concepts"]] == [("Retrieval", ["QUERY"], "Finding things."), ("ranking", ["order"], "Order.")]
    assert changed["concepts"][0]["id"] == "s1"
    assert rows["fresh"]["revision"] == 1 and rows["fresh"]["concepts"][0]["label"] == "One"
    assert "more than one" in rows["twice"]["error"] and "unknown id" in rows["bad"]["error"] and "label" in rows["blank"]["error"]
    assert rows["twice"]["revision"] == 1 and len(rows["twice"]["concepts"]) == 2 and not rows["alone"]["changed"]


def one_by_one(library, old, proposals):
    """What proposals in order make of the concepts (id -> label, aliases, description): concepts or an error."""
    revision = max((o[1] for o in old), default=0)
    first = lambda xs: sorted({x.upper(): x for x in reversed(xs)}.values(), key=lambda x: (x.upper(), x))
    concepts = {o[2]: (o[3], first(o[4]), o[5]) for o in sorted(old, key=lambda o: o[2])}
    for _, _, _, own, label, aliases, description in sorted(proposals, key=lambda p: (p[1], p[2])):
        label, aliases = label.strip(), first([a.strip() for a in aliases if a.strip()])
        if not label or not description:
            return "a concept"
        terms = {t.upper() for t in [label, *aliases]}
        found = [i for i, c in concepts.items() if terms & {t.upper() for t in [c[0], *c[1]]}]
        if len(found) > 1:
            return f"{label}: more"
        if found and own in concepts and own not in found:
            return f"{label}: its id"
        if not found and own is not None and own not in concepts:
            return f"{label}: unknown"
        fresh = "subject-" + hashlib.sha256(f"{library}/{revision}/{len(concepts)}/{label}".encode()).hexdigest()[:16]
        concepts[found[0] if found else own or fresh] = (label, aliases, description)
    return [(i, *c) for i, c in concepts.items()] or "the catalog"


def test_catalogs_against_one_by_one(spark):
    """Many libraries with few terms, so that there are chains, replaced terms, new concepts, ids and errors of each kind."""
    rnd = random.Random(11)
    old, new = [], []
    for k in range(160):
        library, terms, ids = f"l{k}", [f"t{i}" for i in range(rnd.choice([3, 6, 14]))], ["a", "b", "c"]
        for i in rnd.sample(ids, rnd.randint(0, 3)):
            old.append((library, 2, i, rnd.choice(terms) + i, rnd.sample([t + i for t in terms], rnd.randint(0, 2)), "x"))
        for n in range(rnd.randint(0 if k % 9 else 1, 7)):
            i = rnd.choice([None, None, None, "a", "b", "zz" if k % 5 == 0 else None])
            new.append((library, f"d{n // 2}", n, i, rnd.choice([str.upper, str.lower])(rnd.choice(terms)) + rnd.choice(["", "", "a", "b"]) if rnd.random() > 0.03 else " ", rnd.sample(terms, rnd.randint(0, 2)), f"n{n}"))
    got = {r["library_id"]: r for r in reconciled(spark.createDataFrame(old, OLD), spark.createDataFrame(new, NEW)).collect()}
    kinds = Counter()
    for library in {r[0] for r in old + new}:
        was, proposals = [o for o in old if o[0] == library], [n for n in new if n[0] == library]
        want, r = one_by_one(library, was, proposals), got[library]
        if isinstance(want, str):
            assert r["error"].startswith(want) and r["revision"] == max((o[1] for o in was), default=0), (library, want, r)
        else:
            assert r["error"] is None and [(c["id"], c["label"], c["aliases"], c["description"]) for c in r["concepts"]] == want, (library, want, r)
        kinds[want.split(": ")[-1] if isinstance(want, str) else "made"] += 1
    assert len(got) == len({r[0] for r in old + new}) and set(kinds) >= {"made", "more", "unknown", "its id", "a concept"}


def test_many_proposals_of_one_library(spark):
    """Equal proposals and thousands of subjects of one library: several tasks, and no row of them in the ordered pass."""
    new = [("l", f"d{i:05d}", 0, None, f"Subject {i % 1000}", ["common" if i % 1000 == 7 else f"alias {i % 1000}"], f"at {i}") for i in range(5000)]
    r = reconciled(spark.createDataFrame([], OLD), spark.createDataFrame(new, NEW)).first()
    assert len(r["concepts"]) == 1000 and r["concepts"][3]["description"] == "at 4003" and r["error"] is None


def test_empty(spark):
    assert candidates(spark.createDataFrame([], "chunk_id string, content string")).count() == 0
    assert reconciled(spark.createDataFrame([], OLD), spark.createDataFrame([], NEW)).count() == 0
