"""Readers: directories of documents, project files, logs, bundles; and the writers of the same."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators.catalog import islands, numbered, running_totals
from cairn.sources import paths
from cairn.sources.scratch import written

#: Endings of documents that are read, and folders of which nothing is. Fixed values.
DOCUMENTS = ("md", "markdown", "txt", "text", "html", "htm", "pdf", "docx")
SKIPPED_FOLDERS = (".git", "node_modules", "bin", "obj", "dist", "build", "vendor", "__pycache__", ".venv")
#: Limits of a scan: documents, bytes of a file, bytes in all.
MOST_DOCUMENTS, MOST_FILE_BYTES, MOST_BYTES = 10_000, 64 << 20, 1 << 30
LOG_START = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{3} [+-]\d{2}:\d{2}) \[([A-Z]{3})\] (.*)$"


class Limits(NamedTuple):
    """What ends a scan: documents, folders, entries, levels of folders, bytes of a file and of all."""

    documents: int = MOST_DOCUMENTS
    folders: int = 10_000
    entries: int = 100_000
    depth: int = 64
    file_bytes: int = MOST_FILE_BYTES
    bytes: int = MOST_BYTES


LISTED = "path string, name string, is_folder boolean, length long, depth int, reason string"


def listed(spark: SparkSession, root: str, excluded: str | None = None, limits: Limits = Limits()) -> DataFrame:
    """``LISTED``: the entries below ``root``, level by level, in the order of their names.

    A level's folders are those that the level before lists and that no rule leaves out, so a folder of ``SKIPPED_FOLDERS``, one that
    matches ``excluded``, one below ``limits.depth``, one behind a link that leads out of ``root``, and those beyond
    ``limits.folders`` are an entry with a reason and are not listed themselves.  Beyond ``limits.entries`` the listing
    ends with an entry that says so: that bounds what is held here.
    """
    base = paths.resolved(spark, root)
    out, level, depth, opened = [], [paths.qualified(spark, root)], 0, 1
    while level:
        following = []
        for folder in level:
            for e in paths.entries(spark, folder):
                if len(out) >= limits.entries:
                    return spark.createDataFrame([*out, (folder, "", True, 0, depth, "EntryBudget")], LISTED)
                reason = None
                if not e.resolved.startswith(f"{base}/"):
                    reason = "OutsideRoot"
                elif excluded is not None and re.search(excluded, e.path):
                    reason = "ExcludedPattern"
                elif e.is_folder and e.name in SKIPPED_FOLDERS:
                    reason = "ExcludedDirectory"
                elif e.is_folder and depth + 1 > limits.depth:
                    reason = "DepthBudget"
                elif e.is_folder and opened >= limits.folders:
                    reason = "DirectoryBudget"
                elif e.is_folder:
                    following.append(e.path)
                    opened += 1
                out.append((e.path, e.name, e.is_folder, e.length, depth, reason))
        level, depth = following, depth + 1
    return spark.createDataFrame(out, LISTED)


def scan(spark: SparkSession, root: str, excluded: str | None = None, limits: Limits = Limits()) -> DataFrame:
    """path, length, reason of every file and of every folder that is not listed below ``root``; a null reason accepts a file.

    File contents are not read.  Budgets of documents and bytes are running sums in path order over the files accepted so far.
    """
    rows = listed(spark, root, excluded, limits).where("NOT is_folder OR reason IS NOT NULL")
    ending = F.lower(F.regexp_extract("name", r"\.([A-Za-z0-9]+)$", 1))
    first = F.coalesce("reason", F.when(~ending.isin(*DOCUMENTS), "UnsupportedExtension").when(F.col("length") > limits.file_bytes, "FileTooLarge"))
    rows = rows.where(~(F.col("name").isin("_SUCCESS") | F.startswith("name", F.lit(".")) & ~F.col("is_folder"))).select("path", "length", first.alias("first"))
    rows = rows.withColumn("bytes", F.when(F.col("first").isNull(), F.col("length")).otherwise(0)).withColumn("one", F.col("first").isNull().cast("int"))
    summed = running_totals(rows, ["path"], {"all_bytes": "bytes", "all_files": "one"})
    reason = F.coalesce(F.col("first"), F.when(F.col("all_files") > limits.documents, "DocumentBudget").when(F.col("all_bytes") > limits.bytes, "ByteBudget"))
    return summed.select("path", "length", reason.alias("reason"))


def scan_report(scanned: DataFrame) -> DataFrame:
    """One row: files that a scan accepted, skipped, and found too large or over a budget, and accepted bytes."""
    limits = ("FileTooLarge", "DocumentBudget", "ByteBudget", "DirectoryBudget", "DepthBudget", "EntryBudget")
    ok = F.col("reason").isNull()
    return scanned.agg(
        F.count_if(ok).alias("accepted"), F.count_if(~ok & ~F.col("reason").isin(*limits)).alias("skipped"), F.count_if(F.col("reason").isin(*limits)).alias("limited"),
        F.coalesce(F.sum(F.when(ok, F.col("length"))), F.lit(0)).alias("bytes"),
    )


#: Endings of text files of a repository, folders that are skipped, greatest size. Fixed values.
REPO_TEXT = (
    ".cs", ".csx", ".vb", ".fs", ".fsx", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".py", ".rb", ".go", ".rs", ".java", ".kt", ".kts", ".scala", ".cpp",
    ".cxx", ".cc", ".hpp", ".hxx", ".hh", ".h", ".c", ".swift", ".m", ".mm", ".dart", ".php", ".pl", ".lua", ".r", ".jl", ".clj", ".cljs", ".ex",
    ".exs", ".sh", ".bash", ".zsh", ".ps1", ".bat", ".cmd", ".md", ".markdown", ".rst", ".adoc", ".txt", ".xml", ".xaml", ".json", ".yaml", ".yml",
    ".toml", ".ini", ".cfg", ".html", ".htm", ".css", ".scss", ".sass", ".less", ".sql", ".graphql", ".proto",
)
REPO_SKIPPED = ".git .github .vs .idea .vscode node_modules bower_components vendor bin obj build dist out target Debug Release __pycache__ .pytest_cache .mypy_cache packages .nuget".split()
REPO_BYTES = 200 * 1024


def repo_category(path: Column) -> Column:
    """A repository file's category by its path: change logs, readmes, samples, documents, prose, else code."""
    p = F.lower(path)
    name = F.substring_index(p, "/", -1)
    log = name.rlike("^(?:changelog|changes|history|releases)") | name.isin("release-notes.md", "release_notes.md")
    sample = p.rlike("/(?:samples|sample|examples|example|demo|demos)/")
    return (
        F.when(log, "ChangeLog").when(F.startswith(name, F.lit("readme")), "Overview").when(sample, "Sample").when(p.rlike("^docs?/|/docs?/"), "HowTo")
        .when(name.rlike(r"\.(?:md|markdown|rst|adoc)$"), "Overview").otherwise("Code")
    )


def repo_files(files: DataFrame) -> DataFrame:
    """path, category of ``files`` (path below the root, length) that are texts, not too large, and in no skipped folder."""
    ending = F.lower(F.regexp_extract("path", r"(\.[A-Za-z0-9]+)$", 1))
    folders = F.transform(F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1), F.lower)
    skipped = F.arrays_overlap(folders, F.array(*[F.lit(f.lower()) for f in REPO_SKIPPED]))
    return files.where(ending.isin(*REPO_TEXT) & (F.col("length") <= REPO_BYTES) & ~F.coalesce(skipped, F.lit(False))).select("path", repo_category(F.col("path")).alias("category"))


def stored_size(spark: SparkSession, path: str) -> DataFrame:
    """One row: files and bytes of a stored table."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def compacted(rows: DataFrame, path: str, files: int) -> None:
    """Writes ``rows`` anew in about ``files`` files."""
    rows.coalesce(files).write.mode("errorifexists").parquet(path)


def media_kind(path: Column, head: Column) -> Column:
    """What a file is, by its ending and first bytes: null where these disagree, or for endings that are not read."""
    ending = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    magic = F.hex(F.substring(head, 1, 5))
    pdf, zipped = magic == "255044462D", F.startswith(magic, F.lit("504B0304"))
    return (
        F.when((ending == "pdf") & pdf, "pdf").when((ending == "docx") & zipped, "docx").when(pdf | zipped, F.lit(None)).when(ending.isin("html", "htm"), "html")
        .when(ending.isin("md", "markdown"), "markdown").when(ending.isin("txt", "text"), "text")
    )


def decoded(content: Column) -> Column:
    """Text of bytes by their byte order mark, else UTF-8, with line feeds; null if they are not valid."""
    mark = F.hex(F.substring(content, 1, 3))
    rest = lambda n: F.substring(content, F.lit(n), F.length(content))
    wide = lambda order: F.when(F.length(content) % 2 == 0, F.decode(rest(3), f"UTF-16{order}"))
    utf8 = F.try_validate_utf8(F.when(mark == "EFBBBF", rest(4)).otherwise(content).cast("string"))
    plain = F.when(F.startswith(mark, F.lit("FFFE")), wide("LE")).when(F.startswith(mark, F.lit("FEFF")), wide("BE")).otherwise(utf8)
    return F.regexp_replace(plain, r"\r\n?", "\n")


def texts(spark: SparkSession, root: str) -> DataFrame:
    """path, kind, text of plain, Markdown and HTML files; null texts are ones that don't decode or hold something else. Spark
    does not list empty files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{md,markdown,txt,text,html,htm}").load(root)
    kind = media_kind(F.col("path"), F.col("content"))
    return files.select("path", kind.alias("kind"), F.when(kind.isNotNull(), decoded(F.col("content"))).alias("text"))


def title(kind: Column, text: Column, path: Column) -> Column:
    """First heading, else the page's title, else the file's name."""
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    head = F.when(kind == "html", F.regexp_extract(text, r"(?is)<h1[^>]*>\s*(.*?)\s*</h1>", 1)).otherwise(F.trim(F.regexp_extract(text, r"(?md)^\s*# (.*)$", 1)))
    page = F.when(kind == "html", F.regexp_extract(text, r"(?is)<title[^>]*>\s*(.*?)\s*</title>", 1))
    return F.coalesce(F.nullif(head, F.lit("")), F.nullif(page, F.lit("")), name)


def requirements(spark: SparkSession, path: str) -> DataFrame:
    """package_id, version of requirements.txt lines; comments, options and blank lines go."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", "#.*$", "")).alias("line")).where("line <> '' AND NOT startswith(line, '-')")
    p = r"^([a-zA-Z0-9_.-]+)\s*(?:\[[^\]]*\])?\s*(?:[=!<>~]+\s*([^,;\s]+).*)?$"
    rows = lines.select(F.regexp_extract("line", p, 1).alias("package_id"), F.nullif(F.regexp_extract("line", p, 2), F.lit("")).alias("version"))
    return rows.where("package_id <> ''")


def pyproject(spark: SparkSession, path: str) -> DataFrame:
    """package_id, version of the dependencies that pyproject.toml lists in its project section, one a line."""
    text = spark.read.text(path, wholetext=True)
    section = F.regexp_extract("value", r"(?ims)^[ \t]*\[project\][ \t]*$(.*?)(?=^[ \t]*\[|\z)", 1)
    listed = F.regexp_extract(section, r"(?ims)^[ \t]*dependencies[^\n]*\n(.*?)(?=^[ \t]*\]|\z)", 1)
    spec = text.select(F.explode(F.split(listed, "\n")).alias("line")).select(F.trim(F.regexp_extract("line", '"([^"]+)"', 1)).alias("spec"))
    p = r"^([a-zA-Z0-9_.-]+)\s*(?:[=!<>~]+\s*(.+))?$"
    rows = spec.select(F.regexp_extract("spec", p, 1).alias("package_id"), F.nullif(F.trim(F.regexp_extract("spec", p, 2)), F.lit("")).alias("version"))
    return rows.where("package_id <> ''")


def solution_projects(spark: SparkSession, path: str) -> DataFrame:
    """project: paths of the projects that a solution lists, in either format, with forward slashes."""
    text = spark.read.text(path, wholetext=True)
    old = F.regexp_extract_all("value", F.lit(r'(?m)^\s*Project\("[^"]*"\)\s*=\s*"[^"]*"\s*,\s*"([^"]+\.[a-z]+proj)"'), F.lit(1))
    new = F.regexp_extract_all("value", F.lit(r'<Project\s[^>]*Path="([^"]+\.[a-z]+proj)"'), F.lit(1))
    return text.select(F.explode(F.concat(old, new)).alias("project")).select(F.replace("project", F.lit("\\"), F.lit("/")).alias("project"))


def package_json(spark: SparkSession, path: str) -> DataFrame:
    """package_id, version of dependencies and devDependencies."""
    parsed = spark.read.text(path, wholetext=True).select(F.from_json("value", "dependencies MAP<STRING,STRING>, devDependencies MAP<STRING,STRING>").alias("j"))
    both = [parsed.select(F.explode(F.col(f"j.{k}")).alias("package_id", "version")) for k in ("dependencies", "devDependencies")]
    return both[0].unionByName(both[1])


def package_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """As ``package_json``, of files that hold a package in each line."""
    parsed = spark.read.text(path).select(F.from_json("value", "dependencies MAP<STRING,STRING>, devDependencies MAP<STRING,STRING>").alias("j"))
    both = F.map_entries(F.map_concat(*[F.coalesce(f"j.{k}", F.create_map().cast("map<string,string>")) for k in ("dependencies", "devDependencies")]))
    return parsed.select(F.explode(both).alias("e")).select(F.col("e.key").alias("package_id"), F.col("e.value").alias("version"))


def project_references(spark: SparkSession, path: str) -> DataFrame:
    """package_id, version of PackageReference elements, version by attribute or child; else "unknown"."""
    text = spark.read.text(path, wholetext=True)
    found = text.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)(<PackageReference\b[^>]*?(?:/>|>.*?</PackageReference>))"), F.lit(1))).alias("e"))
    part = lambda p: F.nullif(F.trim(F.regexp_extract("e", p, 1)), F.lit(""))
    return found.select(part(r'Include="([^"]*)"').alias("package_id"), F.coalesce(part(r'Version="([^"]*)"'), part(r"(?s)<Version>(.*?)</Version>"), F.lit("unknown")).alias("version")).where("package_id IS NOT NULL")


def log_entries(spark: SparkSession, path: str) -> DataFrame:
    """file, at, level, message, details: a line that starts with a time begins an entry, the lines behind it are details."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("n"))
    marked = islands(lines, "file", "n", F.col("value").rlike(LOG_START))
    rows = marked.where("entry > 0").groupBy("file", "entry").agg(F.min_by("value", "n").alias("head"), F.array_sort(F.collect_list(F.struct("n", "value"))).alias("all"))
    part = lambda i: F.regexp_extract("head", LOG_START, i)
    return rows.select("file", "entry", F.to_timestamp(part(1), "yyyy-MM-dd HH:mm:ss.SSS XXX").alias("at"), part(2).alias("level"), part(3).alias("message"), F.transform(F.slice("all", F.lit(2), F.size("all")), lambda x: x["value"]).alias("details"))


def log_filter(entries: DataFrame, least: str, text: str = "") -> DataFrame:
    """Entries of a level or above whose message or details hold ``text``."""
    levels = ("VRB", "DBG", "INF", "WRN", "ERR", "FTL")
    wanted = F.col("level").isin(*levels[levels.index(least) :])
    hit = F.lower("message").contains(text.lower()) | F.exists("details", lambda x: F.lower(x).contains(text.lower()))
    return entries.where(wanted & hit)


def tail(spark: SparkSession, path: str, n: int, contains: str = "") -> DataFrame:
    """The last ``n`` lines, in order."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("n")).where(F.lower("value").contains(contains.lower()))
    return lines.orderBy(F.desc("n")).limit(n).orderBy("n").select("value")


def replace_version(rows: DataFrame, path: str) -> None:
    """Replaces the (library_id, version) partitions that ``rows`` holds; all others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("library_id", "version").parquet(path)


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """name, length, sha256 of the files below ``path``, without marker files. A file is read by one task; bundles' files are small."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", r"([^/]+/[^/]+)$", 1)
    return files.select(name.alias("name"), "length", F.sha2("content", 256).alias("sha256"))


def export_bundle(chunks: DataFrame, path: str) -> dict:
    """Writes ``chunks`` (chunk_id, content, encoder, perhaps embedding, ...) as JSON lines, their vectors by place, the files'
    lengths and SHA-256, and a manifest of counts. ValueError for rows of more than one encoder, or vectors of several lengths."""
    spark, size = chunks.sparkSession, F.size("embedding") if "embedding" in chunks.columns else F.lit(None).cast("int")
    facts = chunks.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("encoder").alias("encoders"), F.max("encoder").alias("encoder"), F.min(size).alias("least"), F.max(size).alias("dims"), F.count(size).alias("vectors")).first()
    if facts["encoders"] > 1:
        raise ValueError("the rows come from more than one encoder")
    if facts["least"] != facts["dims"]:
        raise ValueError("vectors differ in length")
    if facts["dims"] is None:
        chunks.drop("embedding").write.mode("errorifexists").json(f"{path}/chunks")
    else:
        placed = written(numbered(chunks, ["chunk_id"]))
        placed.drop("embedding").write.mode("errorifexists").json(f"{path}/chunks")
        placed.select("at", "embedding").where("embedding IS NOT NULL").write.parquet(f"{path}/vectors")
    parts = [fingerprints(spark, f"{path}/{name}") for name in ("chunks", *(["vectors"] if facts["dims"] is not None else []))]
    every = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    every.write.json(f"{path}/files")
    manifest = {"chunks": facts["n"], "encoder": facts["encoder"], "dims": facts["dims"], "vectors": facts["vectors"]}
    spark.createDataFrame([manifest], MANIFEST).coalesce(1).write.json(f"{path}/manifest")
    return manifest


MANIFEST = "chunks long, encoder string, dims int, vectors long"


def import_bundle(spark: SparkSession, path: str, schema: str, encoder: str | None = None) -> DataFrame:
    """The chunks of a bundle, its files and counts checked; ValueError if one differs.

    Vectors are joined by place if the bundle's encoder is ``encoder``, or none is named; for another one they are null, and the
    chunks have to be embedded anew.
    """
    manifest = spark.read.schema(MANIFEST).json(f"{path}/manifest").first()
    told = spark.read.schema("name string, length long, sha256 string").json(f"{path}/files")
    own = fingerprints(spark, f"{path}/chunks")
    own = own if manifest["dims"] is None else own.unionByName(fingerprints(spark, f"{path}/vectors"))
    if not (own.exceptAll(told).isEmpty() and told.exceptAll(own).isEmpty()):
        raise ValueError("the bundle's files do not match its manifest")
    chunks = spark.read.schema(schema + (", at long" if manifest["dims"] is not None else "")).json(f"{path}/chunks")
    if chunks.count() != manifest["chunks"]:
        raise ValueError("the bundle does not hold the chunks of its manifest")
    if manifest["dims"] is None:
        return chunks
    if encoder is not None and encoder != manifest["encoder"]:
        return chunks.withColumn("embedding", F.lit(None).cast("array<float>")).drop("at")
    vectors = spark.read.parquet(f"{path}/vectors")
    if vectors.where(F.size("embedding") == manifest["dims"]).count() != manifest["vectors"]:
        raise ValueError("the bundle does not hold the vectors of its manifest")
    return chunks.join(vectors, "at", "left").drop("at")


def unexpired(rows: DataFrame, at: str, now: Column, days: int = 30) -> DataFrame:
    return rows.where(F.col(at) >= now - F.make_interval(days=F.lit(days)))
