"""Index segments, streams into them that are stopped anywhere, and names that used to overflow the stack."""

import random

import pytest
from pyspark.sql import functions as F

from cairn.functions import html
from cairn.operators import bm25, candidates, segments, symbols
from cairn.sources import paths
from cairn.streaming import pages

CHUNKS = "chunk_id long, library_id string, version string, content string"


def corpus(n, word="alpha"):
    return [(i, f"l{i % 3}", f"v{i % 2}", f"{word} common{i % 5} word{i} " * (1 + i % 4)) for i in range(n)]


def scores(index, text="alpha common2 word7 beta", library=None):
    return {r["chunk_id"]: round(r["bm25"], 9) for r in bm25.search(index, text, library).collect()}


def files(spark, folder):
    return {f"{t}/{s}" for t in ("postings", "lengths") for s in paths.children(spark, f"{folder}/{t}")}


def same(index, other):
    """Two indexes hold the same, whatever their segments."""
    rows = lambda df, *cs: sorted(map(tuple, df.select(*cs).collect()))
    for name, cs in (("postings", ["term", "library_id", "version", "chunk_id", "tf", "doc_length"]), ("lengths", ["library_id", "version", "chunk_id", "doc_length"])):
        assert rows(getattr(index, name), *cs) == rows(getattr(other, name), *cs)
    facts = ["library_id", "version", "n_docs", "total_length"]
    sums = lambda i: rows(i.manifest.groupBy("library_id", "version").agg(F.sum("n_docs").alias("n_docs"), F.sum("total_length").alias("total_length")).where("n_docs > 0"), *facts)
    assert sums(index) == sums(other)


def test_replaced_version_equals_rebuild(spark, tmp_path):
    old, new = corpus(60), [(i, "l1", "v1", f"beta alpha word{i}") for i in range(100, 110)]
    index = segments.build(spark.createDataFrame(old, CHUNKS), f"{tmp_path}/a")
    before = files(spark, f"{tmp_path}/a")
    index.load(spark.createDataFrame(new, CHUNKS))
    added = files(spark, f"{tmp_path}/a") - before
    assert before <= files(spark, f"{tmp_path}/a") and len(added) == 2  # one folder of postings and one of lengths, nothing else
    own = spark.read.parquet(*[f"{tmp_path}/a/{f}" for f in added if f.startswith("lengths")])
    assert {tuple(r) for r in own.select("library_id", "version").distinct().collect()} == {("l1", "v1")}
    rebuilt = segments.build(spark.createDataFrame([r for r in old if r[1:3] != ("l1", "v1")] + new, CHUNKS), f"{tmp_path}/b")
    same(index, rebuilt)
    assert scores(index) == scores(rebuilt) and scores(index, library="l1") == scores(rebuilt, library="l1") and len(scores(index, "beta")) == 10
    merged = index.merge()
    assert len(merged) == 2 and index.manifest.select("segment").distinct().count() == 1
    same(index, rebuilt)
    assert scores(index) == scores(rebuilt) and index.merge() == []
    assert len(index.vacuum()) == 4 + 2 and len(files(spark, f"{tmp_path}/a")) == 2 and scores(index) == scores(rebuilt)
    index.remove(spark.createDataFrame([("l1", "v1"), ("l0", "v0")], "library_id string, version string"))
    rest = segments.build(spark.createDataFrame([r for r in old if r[1:3] not in (("l1", "v1"), ("l0", "v0"))], CHUNKS), f"{tmp_path}/c")
    same(index, rest)
    assert scores(index) == scores(rest)
    assert bm25.malformed(index.postings, index.lengths).count() == bm25.damaged(index.postings, index.lengths).count() == bm25.miscounted(index.stats, index.lengths).count() == 0


def test_postings_of_a_term_are_stored_together(spark, tmp_path):
    """A task's postings of a term are one row, before they are shuffled; a reader gets each posting with its pair."""
    index = segments.build(spark.createDataFrame(corpus(60), CHUNKS).coalesce(1), f"{tmp_path}/a")
    stored = spark.read.parquet(f"{tmp_path}/a/postings").where("term = 'alpha'")
    assert stored.count() <= 8  # a row a task, at most
    assert stored.agg(F.sum(F.size("chunk_id"))).first()[0] == 60
    got = sorted(map(tuple, index.postings.where("term = 'alpha'").select("chunk_id", "library_id", "version", "tf", "doc_length").collect()))
    assert got == [(i, lib, v, 2 * text.split().count("alpha"), sum(2 for _ in text.split())) for i, lib, v, text in corpus(60)]


def test_terms_of_texts():
    found = segments.count_terms("Foo.Bar a _x foo K\u212aB \u0130io")
    assert found == {"foo": 2 + 1, "bar": 1, "Foo.Bar": 1, "foo.bar": 1, "_x": 1, "io": 2}


def test_terms_counted_together():
    rnd = random.Random(3)
    parts = ["a", "B", "\u00e9", "_", "1", ".", "::", "->", "Foo", " ", "  ", "-", "K\u212a", "\u0130", "x9", "\n"]
    for texts in (["".join(rnd.choices(parts, k=rnd.randint(0, 80))) for _ in range(2000)] + [None, ""], [], [None]):
        terms, text, term, tf = segments.count_together(texts, {})
        got = [{} for _ in texts]
        for i, t, n in zip(text, term, tf):
            got[i][terms[int(t)].as_py()] = int(n)
        assert got == [segments.count_terms(t or "") for t in texts]


def test_a_load_brings_postings_together_where_it_counts(spark, tmp_path, monkeypatch):
    """What a load writes before its shuffle are blocks of terms, and no row for each chunk; blocks and pieces of any size say the same."""
    made = []
    monkeypatch.setattr(segments, "written", lambda df, of=segments.written: (made.append(of(df)), made[-1])[1])
    rows = [*corpus(60), (70, None, "v0", None), (71, "l0", None, "a"), (72, "l7", "v7", "")]
    index = segments.build(spark.createDataFrame(rows, CHUNKS).coalesce(1), f"{tmp_path}/a")
    blocks = [df for df in made if "docs" in df.columns]
    assert len(blocks) == 1 and blocks[0].where("term = 'alpha'").count() <= 8 and blocks[0].where("docs IS NOT NULL").agg(F.sum(F.size("docs"))).first()[0] == 63
    assert {tuple(r) for r in index.manifest.where("n_docs = 0").select("library_id", "version").collect()} == {("", "v0"), ("l0", ""), ("l7", "v7")}
    from pyarrow import RecordBatch, array, int32, int64

    batch = RecordBatch.from_arrays([array([1] * 60, int32()), array(range(60), int64()), array([r[3] for r in corpus(60)])], ["pair", "chunk_id", "content"])
    found = []
    for sizes in ((10**6, 10**6, 10**4), (40, 100, 7), (1, 1, 1)):
        for name, n in zip(("POSTINGS_A_BLOCK", "PIECE_CHARS", "ROWS"), sizes):
            monkeypatch.setattr(segments, name, n)
        out = [r for b in segments.counted_blocks(iter([batch])) for r in b.to_pylist()]
        found.append((sorted((r["term"], *p) for r in out if r["term"] for p in zip(r["pair"], r["chunk_id"], r["tf"], r["doc_length"])), sorted(tuple(d.values()) for r in out for d in r["docs"] or [])))
    assert found[0] == found[1] == found[2] and len(found[0][1]) == 60


def test_stopped_load_changes_nothing(spark, tmp_path, monkeypatch):
    index = segments.build(spark.createDataFrame(corpus(20), CHUNKS), f"{tmp_path}/a")
    before = scores(index)
    new = spark.createDataFrame([(900, "l1", "v1", "alpha")], CHUNKS)
    with monkeypatch.context() as m:
        m.setattr(segments.Index, "_commit", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("stopped")))
        with pytest.raises(RuntimeError):
            index.load(new, segment="s")
    assert scores(index) == before
    (tmp_path / "a/manifest/generation=99").mkdir()  # a generation that was not completed
    assert scores(index) == before
    index.load(new, segment="s")
    index.load(new, segment="s")
    assert 900 in scores(index) and index.lengths.where("chunk_id = 900").count() == 1


def test_a_search_reads_its_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "POSTINGS_A_BUCKET", 40)
    index = segments.build(spark.createDataFrame(corpus(60), CHUNKS), f"{tmp_path}/a")
    buckets = index.manifest.first()["buckets"]
    assert buckets >= 4 and len([n for n in paths.children(spark, f"{tmp_path}/a/postings/{paths.children(spark, f'{tmp_path}/a/postings')[0]}") if n.startswith("bucket")]) > 1
    index.load(spark.createDataFrame([(900, "l9", "v9", "alpha")], CHUNKS))  # a segment with another number of buckets
    plan = bm25.search(index, "word7")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket#" in plan.split("PartitionFilters")[1][:200]
    monkeypatch.undo()
    assert scores(index) == scores(segments.build(spark.createDataFrame([*corpus(60), (900, "l9", "v9", "alpha")], CHUNKS), f"{tmp_path}/b"))


PAGE_ROWS = [(i, f"http://a.com/{i % 9}", f"<title>T{i}</title><h1>H{i}</h1><p>alpha text{i}</p><h2>More</h2><p>beta</p>") for i in range(12)] + [(90, None, "<p>x</p>"), (91, "http://a.com/x", "<p>a</p><![broken[ >"), (92, "http://a.com/y", ""), (93, "http://a.com/z", None)]


def arrived(spark, tmp_path, rows=PAGE_ROWS, n=3):
    for k in range(n):
        spark.createDataFrame([r for r in rows if r[0] % n == k], pages.PAGES).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    return lambda: pages.read_pages(spark, f"{tmp_path}/in/*", 1)


def outcome(spark, target):
    chunks = sorted(map(tuple, spark.read.parquet(f"{target}/chunks").select("chunk_id", "page_id", "heading", "content").collect()))
    rejected = sorted(map(tuple, spark.read.parquet(f"{target}/rejected").select("page_id", "stage", "reason").collect()))
    return chunks, rejected


def test_stream_that_is_stopped_anywhere(spark, tmp_path):
    """Stopped after each step of each batch in turn, and started again: as a run that was never stopped, and as a batch build."""
    read = arrived(spark, tmp_path)
    pages.ingest(read(), f"{tmp_path}/whole", f"{tmp_path}/ck1", "lib", "1", embed=lambda c: F.array(F.length(c).cast("float")), a_bucket=2).awaitTermination()
    stops = iter([("parsed", 0), ("new", 1), ("chunks", 1), ("seen", 1), ("index", 1), ("rejected", 2), ("seen", 2)])
    now = [next(stops)]

    def stop(step, number):
        if now[0] == (step, number):
            now[0] = next(stops, None)
            raise RuntimeError("stopped")

    for _ in range(20):
        run = pages.ingest(read(), f"{tmp_path}/cut", f"{tmp_path}/ck2", "lib", "1", embed=lambda c: F.array(F.length(c).cast("float")), a_bucket=2, after=stop)
        try:
            run.awaitTermination()
            break
        except Exception:
            continue
    assert now[0] is None
    whole, cut = (segments.Index(spark, f"{tmp_path}/{n}/index", "string") for n in ("whole", "cut"))
    assert outcome(spark, f"{tmp_path}/whole") == outcome(spark, f"{tmp_path}/cut")
    same(whole, cut)
    chunks, rejected = outcome(spark, f"{tmp_path}/cut")
    built = segments.build(spark.createDataFrame([(c[0], "lib", "1", c[3]) for c in chunks], CHUNKS.replace("chunk_id long", "chunk_id string")), f"{tmp_path}/built", "string")
    same(cut, built)
    assert scores(cut, "alpha beta text3") == scores(built, "alpha beta text3") and len(chunks) == 18
    assert [r[:2] for r in rejected] == [(9, "Url"), (10, "Url"), (11, "Url"), (90, "Url"), (91, "Parse"), (92, "Text"), (93, "Text")]
    assert dict((r[0], r[2]) for r in rejected)[91].startswith("AssertionError") and dict((r[0], r[2]) for r in rejected)[9] == "Seen"
    assert spark.read.parquet(f"{tmp_path}/cut/vectors").count() == 18 and cut.state()["n_seen"] == 9 and cut.state()["seen_level"] >= 1
    # a new checkpoint goes on behind the old one's batches, and takes nothing twice
    spark.createDataFrame([(200, "http://a.com/new", "<p>alpha fresh</p>")], pages.PAGES).coalesce(1).write.parquet(f"{tmp_path}/in/9")
    pages.ingest(read(), f"{tmp_path}/cut", f"{tmp_path}/ck3", "lib", "1", a_bucket=2).awaitTermination()
    assert len(outcome(spark, f"{tmp_path}/cut")[0]) == 19 and len(scores(cut, "fresh")) == 1 and cut.lengths.count() == 19


def test_seen_urls_read_do_not_grow(spark, tmp_path):
    """A batch of three urls reads three buckets of the history, which hold as much after 4,000 urls as after 400."""
    seen, few = pages.Seen(spark, str(tmp_path), 50), spark.createDataFrame([("u0",), ("u1",), ("new",)], "url string")
    read, state = [], {"seen_level": 0, "n_seen": 0}
    for number, n in enumerate([400, 3600]):
        urls = spark.range(number * 400, number * 400 + n).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("url"))
        state = seen.add(urls, state["seen_level"], state["n_seen"], number)
        rows = seen.of(few, state["seen_level"], number + 1)
        assert {r["url"] for r in rows.join(few, "url", "left_semi").collect()} == {"u0", "u1"}
        assert seen.of(few, state["seen_level"], number).count() == (0 if number == 0 else seen.of(few, state["seen_level"], 0).count())
        read.append(rows.count())
    assert state["n_seen"] == 4000 and max(read) <= 3 * 2 * 50 and read[1] <= 2 * read[0] + 50


def test_parser_errors(spark):
    rows = spark.createDataFrame([(1, "<p>a</p>"), (2, "<![x[ y"), (3, None)], "id long, html string").select("id", html.parsed_or_error("html").alias("o")).collect()
    got = {r["id"]: r["o"] for r in rows}
    assert got[1]["error"] is None and got[1]["page"]["blocks"][0]["text"] == "a" and got[2]["page"] is None and "AssertionError" in got[2]["error"] and got[3]["error"] is None


def test_very_long_joined_names(spark):
    texts = ["a." * 100_000 + "b", "a-b" + "-c" * 100_000, "x::y->" * 50_000 + "z", "ab " * 100_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, content string")
    assert bm25.postings(rows).where("chunk_id = 0").count() == 1  # the joined name, and no word of two letters
    names = {r["chunk_id"]: r["n"] for r in candidates.candidates(rows).groupBy("chunk_id").agg(F.max(F.length("name")).alias("n")).collect()}
    assert names == {0: 200_001, 1: 200_003, 2: 300_001, 3: 2}
    assert symbols.judged(rows, ["ab"]).where("chunk_id < 3 AND length(name) > 200000").count() == 3


def test_links_and_blocks_inside_containers():
    page = "<div>" * 300 + "".join(f"<a href=x>l{i}</a><p>p{i} <a href=y>q</a></p>" for i in range(300)) + "</div>" * 300
    read = html.read(page)
    total = sum(len(f"l{i}") + 1 for i in range(300))
    assert all(c["links"] == total and c["text"] is None for c in read["containers"]) and len(read["containers"]) == 301
    some = html.read("<div><a href=x>abc</a></div><div><p>t</p></div><section>bare <a href=x>de</a></section>")["containers"]
    assert [(c["tag"], c["links"], c["text"]) for c in some] == [("div", 3, "abc"), ("div", 0, None), ("section", 2, "bare de"), ("body", 5, None)]
