"""Stored tables: renames that are stopped, gates of imports, the queue to embed; scopes, scans and dry runs with their limits."""

import pytest
from pyspark.sql import functions as F

from cairn.operators import reports, vectors
from cairn.sources import files, paths
from cairn.sources.tables import Tables, drain, gates, import_rows

ROWS = "library_id string, version string, chunk_id string, content string, encoder string, embedding array<double>"


def rows_of(spark, library, version, n, encoder="e1", word="text"):
    return spark.createDataFrame([(library, version, f"{library}/{version}/{i}", f"{word} {i % 3}", encoder, [float(i)]) for i in range(n)], ROWS)


def shown(tables, name):
    return sorted(tuple(r) for r in tables.read(name).select("library_id", "chunk_id").collect())


def test_rename_that_is_stopped_between_tables(spark, tmp_path):
    tables = Tables(spark, str(tmp_path))
    rows = rows_of(spark, "a", "1", 4).unionByName(rows_of(spark, "b", "1", 3))
    tables.put({"chunks": rows, "pages": rows.drop("embedding"), "runs": rows.where("library_id = 'a'").drop("content")})
    before = {t: shown(tables, t) for t in ("chunks", "pages", "runs")}
    kept = set(paths.children(spark, f"{tmp_path}/chunks"))

    def stop(table):
        if table == "pages":
            raise RuntimeError("stopped")

    with pytest.raises(RuntimeError):
        tables.rename("a", "z", after=stop)
    assert before == {t: shown(tables, t) for t in before}  # readers see the old names until all is done
    with pytest.raises(ValueError):
        tables.rename("a", "other")
    done = []
    assert tables.rename("a", "z", after=done.append) == {"chunks": 4, "pages": 4, "runs": 4} and done == ["runs"]
    assert shown(tables, "chunks") == sorted([("z", f"z/1/{i}") for i in range(4)] + [("b", f"b/1/{i}") for i in range(3)])
    assert shown(tables, "runs") == sorted(("z", f"z/1/{i}") for i in range(4)) and tables.libraries() == {"z", "b"}
    assert kept <= set(paths.children(spark, f"{tmp_path}/chunks"))  # b's rows were not written again
    for wrong in (("none", "x"), ("z", "b")):
        with pytest.raises(ValueError):
            tables.rename(*wrong)
    tables.put({"chunks": tables.read("chunks", "b").unionByName(rows_of(spark, "b", "2", 1))})
    for wrong in (("9", "8"), ("1", "2")):
        with pytest.raises(ValueError):
            tables.rename("b", "b", wrong)
    assert tables.rename("b", "b", ("1", "1.5"))["chunks"] == 4
    assert shown(tables, "chunks")[:4] == sorted([("b", f"b/1.5/{i}") for i in range(3)] + [("b", "b/2/0")])


def test_import_gates_and_queue(spark, tmp_path):
    tables, jobs = Tables(spark, str(tmp_path)), spark.createDataFrame([("a", "1", "Running"), ("a", "2", "Completed"), ("b", "1", "Queued")], "library_id string, version string, status string")
    none = jobs.limit(0)
    assert drain(tables, lambda c: F.array(F.length(c)), "e1") == 0
    facts = import_rows(tables, rows_of(spark, "a", "2", 5), jobs, "e1")
    assert facts == {"versions": 1, "conflicts": 0, "at_work": 0, "foreign": 0}
    for wrong in (rows_of(spark, "a", "1", 2), rows_of(spark, "a", "2", 2)):  # a job is at work, the version is there
        with pytest.raises(ValueError):
            import_rows(tables, wrong, jobs, "e1")
    assert tables.read("chunks").count() == 5
    foreign = rows_of(spark, "a", "3", 7, "e9").unionByName(rows_of(spark, "a", "2", 4, "e1", "new"))
    assert import_rows(tables, foreign, none, "e1", overwrite=True) == {"versions": 2, "conflicts": 1, "at_work": 0, "foreign": 1}
    got = {r["chunk_id"]: r for r in tables.read("chunks").collect()}
    assert len(got) == 11 and all((r["embedding"] is None) == (r["version"] == "3") for r in got.values()) and got["a/2/0"]["content"] == "new 0"
    assert tables.read("to_embed").count() == 7
    calls = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def embed(text):
        calls.add(1)
        return [float(len(text)), 1.0]

    assert drain(tables, embed, "e1") == 7 and calls.value == 3  # three different contents
    got = {r["chunk_id"]: r for r in tables.read("chunks").collect()}
    assert len(got) == 11 and got["a/3/6"]["embedding"] == [6.0, 1.0] and {r["encoder"] for r in got.values()} == {"e1"} and drain(tables, embed, "e1") == 0
    assert gates(foreign.limit(0), foreign, jobs, "e1").first().asDict() == {"versions": 0, "conflicts": 0, "at_work": 0, "foreign": 0}


def test_scopes_are_partition_filters(spark, tmp_path):
    rows = spark.createDataFrame([(i, [float(i), 1.0], p, lib, v) for i, (p, lib, v) in enumerate([("p", "a", "1"), ("p", "a", "2"), ("p", "ab", "1"), ("q", "a", "1"), ("", "a", "1")])], "chunk_id long, embedding array<float>, profile string, library_id string, version string")
    vectors.stored(rows.where("profile <> ''"), f"{tmp_path}/v")
    ids = lambda *args: sorted(r["chunk_id"] for r in vectors.scoped(spark, f"{tmp_path}/v", *args).collect())
    assert ids("p") == [0, 1, 2] and ids("p", "a") == [0, 1] and ids("p", "a", "2") == [1] and ids("q", "a", "1") == [3] and ids("p", "none") == [] and ids("p", None, "1") == [0, 1, 2]
    for args, names in ((("p",), ["profile"]), (("p", "a"), ["profile", "library_id"]), (("p", "a", "1"), ["profile", "library_id", "version"])):
        plan = vectors.scoped(spark, f"{tmp_path}/v", *args)._jdf.queryExecution().executedPlan().toString()
        filters = plan.split("PartitionFilters: [")[1].split("]")[0]
        assert all(f"({n}#" in filters for n in names) and "PushedFilters: []" in plan


def test_scan_prunes_and_ends(spark, tmp_path, monkeypatch):
    for name in ["a.md", "sub/b.txt", "sub/deep/c.md", "sub/deep/er/d.md", "x.png", "big.md", "out/e.md", "z/f.md"] + [f"node_modules/n{i}.md" for i in range(50)]:
        (tmp_path / "root" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "root" / name).write_text("x" * (500 if name == "big.md" else 10))
    (tmp_path / "elsewhere").mkdir()
    (tmp_path / "elsewhere/secret.md").write_text("s")
    (tmp_path / "root/link").symlink_to(tmp_path / "elsewhere")
    opened = []
    whole = paths.entries
    monkeypatch.setattr(paths, "entries", lambda s, p: opened.append(p.rsplit("/", 1)[1]) or whole(s, p))

    def reasons(**limits):
        opened.clear()
        return {r["path"].split("/root/")[-1]: r["reason"] for r in files.scan(spark, f"{tmp_path}/root", "/out$", files.Limits(**limits)).collect()}

    got = reasons(file_bytes=100)
    assert opened == ["root", "sub", "z", "deep", "er"]  # neither node_modules nor out nor what the link leads to
    assert got == {"a.md": None, "sub/b.txt": None, "sub/deep/c.md": None, "sub/deep/er/d.md": None, "x.png": "UnsupportedExtension", "big.md": "FileTooLarge", "out": "ExcludedPattern", "z/f.md": None, "node_modules": "ExcludedDirectory", "link": "OutsideRoot"}
    assert reasons(depth=1)["sub/deep"] == "DepthBudget" and opened == ["root", "sub", "z"]
    assert reasons(folders=2)["z"] == "DirectoryBudget" and opened == ["root", "sub"]
    assert "EntryBudget" in reasons(entries=9).values() and opened == ["root", "sub"]
    assert sorted(k for k, v in reasons(documents=2).items() if v == "DocumentBudget") == ["sub/b.txt", "sub/deep/c.md", "sub/deep/er/d.md", "z/f.md"]
    assert sum(v == "ByteBudget" for v in reasons(bytes=25, file_bytes=100).values()) == 3


def test_dry_run_samples_and_times(spark):
    pages = spark.createDataFrame([(i, f"h{i % 2}", i % 3, None, i % 2 == 0, "Error" if i == 3 else "Fetched", 10 if i != 3 else None, i) for i in range(120)], "id long, host string, depth int, category string, in_scope boolean, outcome string, fetch int, chunk int").repartition(5)
    got = {(r["kind"], r["value"]): (r["n"], r["ms"]) for r in reports.dry_run(pages, ("fetch", "chunk"), ["host", "id"]).collect()}
    assert got["stage", "fetch"] == (119, 1190) and got["stage", "chunk"] == (120, 7140) and got["total", "pages"] == (120, None) and got["total", "errors"] == (1, None)
    samples = {v: x for (k, v), x in got.items() if k == "sample"}
    assert len(samples) == 50 and samples["0"] == (1, 10) and samples["98"] == (50, 108)
    assert not any(k == "sample" for k, _ in [(r["kind"], 0) for r in reports.dry_run(pages).collect()])
