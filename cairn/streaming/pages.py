"""Pages as a stream into a searchable index: read, cut into chunks, indexed and remembered once, with rows that fail set apart.

A micro-batch is one segment of the index.  All that it writes lies in folders named by its number and is replaced when it runs
again; the manifest, which names the segment, the batch and the size of the table of urls, is written last.  So a batch that was
stopped between two writes has changed nothing that a reader sees, and one that was committed does nothing when it comes again.

Urls that were seen are kept in buckets by hash, as many as keep about ``SEEN_A_BUCKET`` in each: when there are more, they are
dealt into four times the buckets.  A batch of k urls reads k buckets at most, however long the history is.

A page that the parser fails on, that has no url or no text, or whose url came before goes to ``rejected`` with the stage and the
reason, and the others of its batch stay in.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cairn.functions.html import markdown, parsed_or_error
from cairn.functions.web import normalized
from cairn.operators.chunking import by_headings
from cairn.operators.segments import Index
from cairn.sources import paths

PAGES = "page_id long, url string, html string"
#: Urls in a bucket of those seen, about.
SEEN_A_BUCKET = 100_000


def read_pages(spark: SparkSession, folder: str, files_a_batch: int = 50, bytes_a_batch: str | None = None) -> DataFrame:
    """A file stream of pages; ``files_a_batch`` or ``bytes_a_batch`` is the back-pressure."""
    limit = ("maxFilesPerTrigger", files_a_batch) if bytes_a_batch is None else ("maxBytesPerTrigger", bytes_a_batch)
    return spark.readStream.schema(PAGES).option(*limit).parquet(folder)


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """What a checkpoint names its stream, for as long as there is the checkpoint."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


class Seen:
    """Urls of committed batches below a folder: seen/level=l/bucket=b/batch=n, with 4 ** l buckets."""

    SCHEMA = "url string, bucket int, batch long"

    def __init__(self, spark: SparkSession, folder: str, a_bucket: int = SEEN_A_BUCKET):
        self.spark, self.folder, self.a_bucket = spark, folder, a_bucket

    @staticmethod
    def bucket(level: int) -> Column:
        return F.pmod(F.xxhash64("url"), F.lit(4**level)).cast("int")

    def of(self, urls: DataFrame, level: int, batch: int) -> DataFrame:
        """The urls of batches before ``batch`` in the buckets that ``urls`` (url) fall in."""
        root = f"{self.folder}/seen/level={level}"
        buckets = [r["b"] for r in urls.select(self.bucket(level).alias("b")).distinct().collect()]
        folders = [f"{root}/bucket={b}" for b in sorted(buckets) if paths.exists(self.spark, f"{root}/bucket={b}")]
        if not folders:
            return self.spark.createDataFrame([], "url string")
        return self.spark.read.schema(self.SCHEMA).option("basePath", root).parquet(*folders).where(F.col("batch") < batch).select("url")

    def add(self, urls: DataFrame, level: int, n_before: int, batch: int) -> dict:
        """Writes ``urls`` (url) as those of ``batch``, and all into more buckets where they have become too many; the new state."""
        put = lambda rows, at: rows.withColumn("bucket", self.bucket(at)).withColumn("batch", F.lit(batch)).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(f"{self.folder}/seen/level={at}")
        n = n_before + urls.count()
        if n <= self.a_bucket * 4**level:
            put(urls.select("url"), level)
            return {"seen_level": level, "n_seen": n}
        root = f"{self.folder}/seen/level={level}"
        old = self.spark.read.schema(self.SCHEMA).parquet(root).where(F.col("batch") < batch).select("url") if n_before else urls.select("url").limit(0)
        while n > self.a_bucket * 4**level:
            level += 1
        paths.remove(self.spark, f"{self.folder}/seen/level={level}")  # of a batch that was stopped before it was committed
        put(old.unionByName(urls.select("url")), level)
        return {"seen_level": level, "n_seen": n}


def ingest(
    pages: DataFrame, target: str, checkpoint: str, library: str = "", version: str = "", classify: Callable[[Column, Column], Column] | None = None, embed: Callable[[Column], Column] | None = None,
    a_bucket: int = SEEN_A_BUCKET, after: Callable[[str, int], None] | None = None,
) -> StreamingQuery:
    """Adds pages with new urls to the index in ``target``/index as chunks of a library's version, until the source has no more.

    Beside the index: chunks (page_id, url, part, heading, path, category, content, chunk_id), vectors (chunk_id, embedding) where there
    is an ``embed`` of contents, rejected (page_id, url, stage, reason).  ``classify`` makes a category of a title and a text.  Of
    pages of a batch with one url, the one with the smallest page_id counts.  ``after`` is called with each step that is done.
    """
    spark = pages.sparkSession
    index = Index(spark, f"{target}/index", "string")
    seen = Seen(spark, target, a_bucket)
    done = after or (lambda step, number: None)

    def write(batch: DataFrame, of_stream: int) -> None:
        stream = stream_id(spark, checkpoint)
        number = index.batch_of(stream, of_stream)
        if number is None:
            return
        state = index.state()

        def put(df: DataFrame, name: str) -> DataFrame:
            path = f"{target}/{name}/batch={number}"
            df.write.mode("overwrite").parquet(path)
            done(name, number)
            return batch.sparkSession.read.schema(df.schema).parquet(path)

        read = batch.withColumn("url", normalized(F.col("url"))).withColumn("o", parsed_or_error("html"))
        rows = read.select("page_id", "url", F.col("o.page.title").alias("title"), markdown(F.col("o.page")).alias("text"), F.col("o.error").alias("error"))
        stage = F.when(F.col("url").isNull(), "Url").when(F.col("error").isNotNull(), "Parse").when(F.coalesce(F.length("text"), F.lit(0)) == 0, "Text")
        rows = put(rows.select("page_id", "url", "title", "text", stage.alias("stage"), F.coalesce("error", F.when(stage == "Url", "NoUrl"), F.when(stage == "Text", "NoText")).alias("reason")), "parsed")
        good = rows.where("stage IS NULL")
        first = good.groupBy("url").agg(F.min_by(F.struct("page_id", "title", "text"), F.struct("page_id", F.xxhash64("title", "text"))).alias("p")).select("url", "p.*")
        urls = first.select("url")
        new = put(first.join(seen.of(urls, state["seen_level"], number), "url", "left_anti"), "new")
        repeated = good.join(new.select("url", "page_id"), ["url", "page_id"], "left_anti")
        put(rows.where("stage IS NOT NULL").select("page_id", "url", "stage", "reason").unionByName(repeated.select("page_id", "url", F.lit("Url").alias("stage"), F.lit("Seen").alias("reason"))), "rejected")
        category = F.lit(None).cast("string") if classify is None else classify(F.col("title"), F.col("text"))
        kinds = new.select("page_id", "url", category.alias("category"))
        cut = by_headings(new.select(F.struct("page_id", "url").alias("page_id"), "title", "text")).select("page_id.page_id", "page_id.url", "part", "heading", "path", "content")
        chunk_id = F.concat_ws("/", F.substring(F.sha2("url", 256), 1, 16), F.col("part").cast("string"))
        chunks = put(cut.join(kinds, ["page_id", "url"]).withColumn("chunk_id", chunk_id), "chunks")
        if embed is not None:
            put(chunks.select("chunk_id", embed(F.col("content")).alias("embedding")), "vectors")
        more = seen.add(new, state["seen_level"], state["n_seen"], number)
        done("seen", number)
        rows_in = chunks.select("chunk_id", F.lit(library).alias("library_id"), F.lit(version).alias("version"), "content")
        index.load(rows_in, replace=False, segment=f"batch-{number:09d}", stream=stream, base=number - of_stream, last_batch=number, **more)
        done("index", number)

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def index_chunks(chunks: DataFrame, index: Index, checkpoint: str) -> StreamingQuery:
    """Adds a stream of chunks (chunk_id, library_id, version, content) to ``index``, a segment for each micro-batch, each once."""

    def write(batch: DataFrame, of_stream: int) -> None:
        stream = stream_id(index.spark, checkpoint)
        number = index.batch_of(stream, of_stream)
        if number is not None:
            index.load(batch, replace=False, segment=f"batch-{number:09d}", stream=stream, base=number - of_stream, last_batch=number)

    return chunks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def audit_log(rows: DataFrame, target: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Appends audit rows to a folder for each profile: every ``every`` (1 second, say), or all that is there."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return rows.writeStream.format("parquet").partitionBy("profile").option("path", target).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts by window and kind for a stream or a table of events (ts, event_type)."""
    at = events.withColumn("ts", F.col("ts").cast("timestamp"))
    at = at.withWatermark("ts", late) if at.isStreaming else at
    return at.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
