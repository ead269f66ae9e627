"""Readers, HTML, chunking and the page stream on small files."""

import re

import pytest
from pyspark.sql import functions as F

from cairn.functions import html
from cairn.functions import text as T
from cairn.functions import web as W
from cairn.operators import bm25, catalog, chunking, segments, vectors
from cairn.plans.search import search_docs
from cairn.sources import files
from cairn.sources.scratch import folder
from cairn.streaming import pages


def put(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode() if isinstance(text, str) else text)
    return str(path)


def test_scan_and_texts(spark, tmp_path):
    put(tmp_path, "a.md", "# Title\r\nbody")
    put(tmp_path, "sub/b.html", "<title>T</title><h1>Head</h1><p>x</p>")
    put(tmp_path, "sub/c.png", b"\x00")
    put(tmp_path, "node_modules/d.md", "no")
    reasons = {r["path"].rsplit("/", 1)[1]: r["reason"] for r in files.scan(spark, str(tmp_path)).collect()}
    assert reasons == {"a.md": None, "b.html": None, "c.png": "UnsupportedExtension", "node_modules": "ExcludedDirectory"}
    rows = files.texts(spark, str(tmp_path / "a.md")).select("text", files.title(F.col("kind"), F.col("text"), F.col("path")).alias("t")).first()
    assert rows["text"] == "# Title\nbody" and rows["t"] == "Title"


def test_scanned_languages(spark, tmp_path):
    """A file of a language stays one that a scan accepts when the language has more text than a file may have."""
    from cairn.queries_files import scan_folders

    text = F.repeat(F.sha2(F.col("id").cast("string"), 256), 8192)  # half a megabyte each
    rows = spark.range(160, numPartitions=8).select(F.col("id").alias("doc_id"), text.alias("text"), F.when(F.col("id") < 140, "en").when(F.col("id") < 150, "fr").when(F.col("id") < 159, "de").alias("lang"), F.lit("s").alias("source"))
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    assert tuple(scan_folders(spark, str(tmp_path)).first()) == (2, 1, 0)


def test_one_task_writes_no_texts(spark, tmp_path, monkeypatch):
    """The table that one task writes as one file grows with the number of documents, not with their texts."""
    from cairn import queries_files

    monkeypatch.setattr(queries_files, "folder", lambda spark: f"{tmp_path}/scratch")
    long = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(500)), lambda i: F.sha2(F.concat_ws("-", "id", i.cast("string")), 256)), "")
    spark.range(40).select(F.col("id").alias("doc_id"), long.alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    assert tuple(queries_files.stored_sizes(spark, str(tmp_path)).first())[:3] == (6, 1, 40)
    assert sum(f.stat().st_size for f in (tmp_path / "scratch/b").glob("*.parquet")) < 20_000


def test_project_files(spark, tmp_path):
    req = files.requirements(spark, put(tmp_path, "r.txt", "# c\nnumpy==1.2\npandas>=2,<3\n-e .\nplain\n")).collect()
    assert {tuple(r) for r in req} == {("numpy", "1.2"), ("pandas", "2"), ("plain", None)}
    pkg = files.package_json(spark, put(tmp_path, "package.json", '{"dependencies": {"a": "^1"}, "devDependencies": {"b": "2"}}'))
    assert {tuple(r) for r in pkg.collect()} == {("a", "^1"), ("b", "2")}
    proj = files.project_references(spark, put(tmp_path, "x.csproj", '<PackageReference Include="A" Version="1"/><PackageReference Include="B"><Version>2</Version></PackageReference><PackageReference Include="C" />'))
    assert {tuple(r) for r in proj.collect()} == {("A", "1"), ("B", "2"), ("C", "unknown")}


def test_projects_and_solutions(spark, tmp_path):
    toml = put(tmp_path, "pyproject.toml", '[tool.x]\ndependencies = [\n"no"\n]\n[project]\nname = "p"\ndependencies = [\n  "a>=1.2",\n  "b",  # c\n]\nother = ["z"]\n[end]\n"no"\n')
    assert {tuple(r) for r in files.pyproject(spark, toml).collect()} == {("a", "1.2"), ("b", None)}
    old = put(tmp_path, "x.sln", 'Project("{A}") = "One", "src\\One\\One.csproj", "{B}"\nEndProject\nProject("{A}") = "Folder", "docs", "{C}"\n')
    new = put(tmp_path, "x.slnx", '<Solution><Folder Name="/f/"><Project Path="a/Two.csproj" /></Folder></Solution>')
    assert [r[0] for r in files.solution_projects(spark, old).collect()] == ["src/One/One.csproj"] and [r[0] for r in files.solution_projects(spark, new).collect()] == ["a/Two.csproj"]


def test_decoding(spark, tmp_path):
    raw = {"a.txt": b"\xef\xbb\xbfh\xc3\xa9\r\nx\ry", "b.txt": b"\xff\xfe" + "hé".encode("utf-16-le"), "c.txt": b"\xfe\xff" + "hé".encode("utf-16-be"), "d.txt": b"\xc3\x28", "e.md": b"%PDF-1.4", "f.html": b"", "g.txt": b"\xff\xfeabc"}
    for name, data in raw.items():
        put(tmp_path, name, data)
    got = {r["path"].rsplit("/", 1)[1]: (r["kind"], r["text"]) for r in files.texts(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": ("text", "hé\nx\ny"), "b.txt": ("text", "hé"), "c.txt": ("text", "hé"), "d.txt": ("text", None), "e.md": (None, None), "g.txt": ("text", None)}


def test_sizes_and_compaction(spark, tmp_path):
    rows = spark.range(100)
    rows.repartition(8).write.parquet(str(tmp_path / "a"))
    files.compacted(spark.read.parquet(str(tmp_path / "a")), str(tmp_path / "b"), 1)
    a, b = (files.stored_size(spark, str(tmp_path / x)).first() for x in "ab")
    assert a["files"] == 8 and b["files"] == 1 and b["bytes"] < a["bytes"] and spark.read.parquet(str(tmp_path / "b")).count() == 100


def test_logs(spark, tmp_path):
    path = put(tmp_path, "s.log", "lost\n2024-01-02 03:04:05.678 +00:00 [INF] one\n  more\n2024-01-02 03:04:06.000 +00:00 [ERR] two\n")
    got = files.log_entries(spark, path).orderBy("entry").collect()
    assert [(r["level"], r["message"], r["details"]) for r in got] == [("INF", "one", ["  more"]), ("ERR", "two", [])]
    assert files.log_filter(files.log_entries(spark, path), "WRN").count() == 1
    assert [r[0] for r in files.tail(spark, path, 2).collect()][0] == "  more"


def test_bundle(spark, tmp_path):
    schema = "chunk_id string, content string, encoder string"
    rows = spark.createDataFrame([("c1", "x", "e"), ("c2", "y", "e")], schema)
    files.export_bundle(rows, str(tmp_path / "b"))
    assert files.import_bundle(spark, str(tmp_path / "b"), schema).count() == 2
    with pytest.raises(ValueError):
        files.export_bundle(rows.withColumn("encoder", F.col("chunk_id")), str(tmp_path / "c"))
    vectors = spark.createDataFrame([("c2", "y", "e", [2.0, 3.0]), ("c1", "x", "e", [1.0, 2.0]), ("c3", "z", "e", None)], schema + ", embedding array<float>")
    assert files.export_bundle(vectors, str(tmp_path / "v")) == {"chunks": 3, "encoder": "e", "dims": 2, "vectors": 2}
    back = lambda e=None: {r["chunk_id"]: r["embedding"] for r in files.import_bundle(spark, str(tmp_path / "v"), schema, e).collect()}
    assert back() == back("e") == {"c1": [1.0, 2.0], "c2": [2.0, 3.0], "c3": None} and set(back("other").values()) == {None}
    with pytest.raises(ValueError):
        files.export_bundle(vectors.withColumn("embedding", F.when(F.col("chunk_id") == "c1", F.array(F.lit(1.0))).otherwise(F.col("embedding"))), str(tmp_path / "w"))
    part = next(p for p in (tmp_path / "v" / "chunks").iterdir() if p.name.startswith("part") and p.stat().st_size)
    part.write_text(part.read_text().replace('"z"', '"q"').replace('"x"', '"q"').replace('"y"', '"q"'))
    for crc in (tmp_path / "v" / "chunks").glob(".*.crc"):
        crc.unlink()
    with pytest.raises(ValueError):
        back()


def pages_of(spark, *pages):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "id long, html string").withColumn("page", html.parsed("html"))
    return df.select("id", "page", html.markdown(F.col("page")).alias("text"), html.container(F.col("page"))["tag"].alias("tag")).orderBy("id").collect()


def test_references_without_an_end():
    page = html.read("<title>a&amp;&amp</title><article><h1>a&amp;&amp</h1><p>b&lt &#38 &notit; &quot;&#x27;&lt;&#38;</p></article>")
    assert page["title"] == "a&&amp" and [b["text"] for b in page["blocks"]] == ["a&&amp", "b&lt &#38 &notit; \"'<&"]


def test_html(spark):
    long = "word " * 60
    rows = pages_of(
        spark,
        '<title>T</title><nav><p>no</p></nav><div class="site-sidebar"><p>no</p></div><h2>H</h2><p>a <a href="#">link</a></p><script>x</script>',
        f"<body><div><p>{long}</p></div><article><h1>A</h1><p>{long}{long}</p><pre><code>x = 1</code></pre></article><div role='dialog'><p>{long * 9}</p></div></body>",
        f"<div><a href='x'>{long * 5}</a></div><section><p>{long}</p></section>",
        "<div>no block here</div>", "", None, "<p>one<p>two<li>a<li>b",
        f"<div id='Promo_box'>{long * 3}</div><main>{long}</main>",
    )
    assert (rows[0]["page"]["title"], rows[0]["text"], rows[0]["tag"]) == ("T", "## H\n\na link", "body")
    assert rows[1]["tag"] == "article" and rows[1]["text"] == f"# A\n\n{(long * 2).strip()}\n\nx = 1"
    assert (rows[2]["tag"], rows[2]["text"]) == ("section", long.strip())
    assert [r["text"] for r in rows[3:7]] == ["no block here", "", "", "one\n\ntwo\n\na\n\nb"] and rows[7]["text"] == long.strip()


def test_bounded_sections(spark):
    texts = ["", "a" * 25, "aaaa bbbb cccc dddd", " \n ", "x" * 6 + " " + "y" * 9, None]
    got = [r["s"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", html.bounded(F.col("t"), 10).alias("s")).orderBy("i").collect()]
    assert got[:5] == [[], ["a" * 10, "a" * 10, "a" * 5], ["aaaa bbbb", "cccc dddd"], [], ["x" * 6, "y" * 9]]


def test_chunking(spark):
    df = spark.createDataFrame([(1, "T", "pre\n# A\nx\n## B\n\n"), (2, "T", "drop\n## v1.0\nx\n## Version 2\ny"), (3, "T", "none")], "page_id long, title string, text string")
    got = {(r["page_id"], r["heading"], r["path"]) for r in chunking.by_headings(df).collect()}
    assert {(1, "", "T"), (1, "A", "T > A"), (1, "B", "T > B"), (3, "", "T")} <= got
    assert {(r["page_id"], r["heading"]) for r in chunking.by_versions(df.where("page_id > 1")).collect()} == {(2, "v1.0"), (2, "Version 2"), (3, "")}
    assert chunking.pieces("") == [] and chunking.pieces("x" * 2400 + " ") == ["x" * 2400, ""]
    capped = chunking.capped(spark.createDataFrame([("l/1/0", "b" * 1300 + "End of first sentence. Beginning of second sentence." + "b" * 1300), ("l/1/1", "short")], "chunk_id string, content string")).collect()
    assert sorted(r["chunk_id"] for r in capped) == ["l/1/0-0", "l/1/0-1", "l/1/1"] and next(r["content"] for r in capped if r["chunk_id"] == "l/1/0-0").endswith(".")
    dotted = "a" * 1300 + " Set AxisFault.Disabled to acknowledge the latch and continue. " + "a" * 1300
    assert not any(p.endswith("AxisFault.") or p.startswith("Disabled") for p in chunking.pieces(dotted)) and len(chunking.pieces(dotted)) >= 2
    parts = chunking.pieces("A sentence here. " * 400)
    assert all(len(p) <= 2400 for p in parts) and all(p.endswith(".") for p in parts)
    assert [r["content"] for r in chunking.packed_paragraphs(df.select("page_id", F.lit("a\n\nb\n\nc").alias("text")).limit(1), 5).orderBy("part").collect()] == ["a\n\nb", "c"]


def test_text_and_urls(spark):
    row = spark.range(1).select(
        T.query_terms(F.lit("Foo.Bar the x")).alias("a"), T.is_identifier_shaped(F.lit("plain words")).alias("b"), W.normalized(F.lit("HTTP://A.com:80/x/y.html?q=1#f")).alias("c"), W.normalized(F.lit("bad")).alias("d"),
        W.code_host_parts(F.lit("https://github.com/o/r.git")).alias("e"), T.collapse(F.lit(" a  b ")).alias("f"), W.failed_crawl(F.lit(0), F.lit(0)).alias("g"),
    ).first()
    assert row["a"] == ["foo", "bar", "the", "Foo.Bar", "foo.bar"] and not row["b"] and row["c"] == "http://a.com/x/y?q=1" and row["d"] is None
    assert tuple(row["e"]) == ("o", "r") and row["f"] == "a b" and row["g"]


def test_query_shapes(spark):
    named = ["MoveLinear", "AxisStatus", "Controller.Connect", "AxisFault.Disabled", "MoveLinear()", "std::vector", "move_linear", "HomeType.ToLimit"]
    prose = ["how do I configure homing", "explain coordinated motion", "set up encoder feedback", "what is the best way to handle errors", "introduction to the library", "a.b", "i.e.", "::", "aB", None]
    rows = spark.createDataFrame([(q,) for q in named + prose], "q string").select("q", T.is_identifier_shaped(F.col("q")).alias("s")).collect()
    assert [r["q"] for r in rows if r["s"]] == named


def test_url_refusals(spark):
    urls = {"http://a.com/x.PNG?y": "BinaryExtension", "http://a.com/x.png#y": None, "http://a.com/x.bmp": "BinaryExtension", "http://a.com/x.pdf": "BinaryExtension", "http://b.com/": "PatternMissAllowed", "http://A.COM/blog/x": "PatternExclude", "http://a.com/dll.iso": None}
    job = W.default_job("https://A.com/docs/")
    assert job["allow"] == [r"a\.com"] and job["scope_depth"] == 10
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select("u", W.refusal(F.col("u"), job["allow"], ["/blog/"]).alias("r"), W.refusal(F.col("u"), [], []).alias("none"), W.refusal(F.col("u"), ["."], [], documents=True).alias("d")).collect()
    assert {r["u"]: r["r"] for r in rows} == urls
    assert all(r["none"] in ("BinaryExtension", "PatternMissAllowed") for r in rows) and next(r["d"] for r in rows if r["u"].endswith("pdf")) is None


def test_search(spark):
    chunks = spark.createDataFrame([(i, "l", "1" if i < 7 else "2", "Overview", f"word{i} common", ["s"] if i == 6 else []) for i in range(8)], "chunk_id long, library_id string, version string, category string, content string, subject_ids array<string>")
    embedded = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(8)], "chunk_id long, embedding array<double>")
    published = spark.createDataFrame([("l", "1")], "library_id string, version string")
    index = segments.build(chunks, folder(spark))
    find = lambda **k: [r["chunk_id"] for r in search_docs(chunks, embedded, published, index, "word3", [1.0, 3.0], 3, **k).orderBy("place").collect()]
    assert find(library="l")[0] == 3 and len(find(library="l")) == 3 and find(library="l", subject="s") == [6] and find(library="other") == [] and find(category="None") == []
    assert 7 not in find() and search_docs(chunks, embedded, published, index, "", [1.0, 7.0], 8, library="l").count() == 7
    assert vectors.should_rerank("Onnx", 6) and not vectors.should_rerank("Onnx", 5) and not vectors.should_rerank("Off", 9)
    assert vectors.candidate_count(5) == 50 and vectors.candidate_count(20) == 100


def test_bm25_cases(spark):
    rows = spark.createDataFrame([(1, "l", "Use MoveLinear to start the move."), (2, "l", "Coordinate motion is described elsewhere."), (3, "l", "MoveLinear parameters control velocity."), (4, "m", "Configure homing on each axis."), (5, "m", "Configure encoder feedback."), (6, "m", None), (7, "n", " ")], "chunk_id long, library_id string, content string")
    index = segments.build(rows, folder(spark))
    assert {r["chunk_id"] for r in bm25.search(index, "MoveLinear", "l").collect()} == {1, 3}
    got = {r["chunk_id"]: r["bm25"] for r in bm25.search(index, "homing configure", "m").collect()}
    assert got[4] > got[5] and bm25.search(index, "homing", "l").count() == 0 and bm25.search(index, "", "m").count() == 0
    whole = {r["chunk_id"]: r["bm25"] for r in bm25.scores(rows, "configure move").collect()}
    assert whole == {r["chunk_id"]: pytest.approx(r["bm25"]) for r in bm25.search(index, "configure move").collect()}
    plan = bm25.search(index, "homing", "m")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan) and re.search(r"PushedFilters: \[[^\]]*term", plan)
    assert bm25.damaged(index.postings, index.lengths).count() == bm25.malformed(index.postings, index.lengths).count() == bm25.miscounted(index.stats, index.lengths).count() == 0
    none = segments.build(rows.limit(0), folder(spark))
    assert bm25.search(none, "homing").count() == 0


def test_parameters_and_selectors(spark):
    assert catalog.renamed_parameter(1, None, "x") == catalog.renamed_parameter(None, 1, "x") == catalog.renamed_parameter(1, 1, "x") == 1
    rows = spark.createDataFrame([("l", "1", False), ("l", "2", True)], "library_id string, version string, is_current boolean")
    assert [catalog.selected_versions(rows, s).count() for s in (None, "", " All ", ["1"])] == [1, 1, 2, 1]
    for bad in ("newest", [], ["3"]):
        with pytest.raises(ValueError):
            catalog.selected_versions(rows, bad)
    with pytest.raises(ValueError):
        catalog.renamed_parameter(1, 2, "x")
    assert catalog.conditional(rows, {"a": None}).count() == 0 and catalog.conditional(rows, {"a": F.lit(True)}, 0).count() == 2


def test_safe_ids(spark):
    row = spark.range(1).select(*[T.is_safe_id(F.lit(x)).alias(f"s{i}") for i, x in enumerate(["a", "a..b", "-a", "a/b", "a" * 129])]).first()
    assert [row[f"s{i}"] for i in range(5)] == [True, False, False, False, False]


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(1, "http://a.com/1", "<h1>A</h1><p>x</p>"), (2, "bad", "<p>y</p>"), (3, "http://a.com/3", "<h1>C</h1><p>z</p>")], pages.PAGES)
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    pages.ingest(pages.read_pages(spark, str(tmp_path / "in"), 1), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert {(r["page_id"], r["heading"]) for r in spark.read.parquet(str(tmp_path / "out/chunks")).collect()} == {(1, "A"), (3, "C")}
    assert {r["page_id"] for r in spark.read.parquet(str(tmp_path / "out/rejected")).collect()} == {2}
    # a second run over more files takes what is new only
    again = spark.createDataFrame([(4, "http://a.com/1/", "<p>again</p>"), (5, "http://a.com/5", "<h1>E</h1><p>new</p>")], pages.PAGES)
    again.write.mode("append").parquet(str(tmp_path / "in"))
    pages.ingest(pages.read_pages(spark, str(tmp_path / "in"), 1), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert {r["page_id"] for r in spark.read.parquet(str(tmp_path / "out/chunks")).collect()} == {1, 3, 5}


def test_audit_log(spark, tmp_path):
    schema = "profile string, url string"
    spark.createDataFrame([("a", "u1"), ("b", "u2"), ("a", "u3")], schema).write.parquet(str(tmp_path / "in"))
    pages.audit_log(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "log"), str(tmp_path / "ck")).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "log")).select("profile", "url").collect())) == [("a", "u1"), ("a", "u3"), ("b", "u2")]
