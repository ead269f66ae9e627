"""A stored BM25 index in segments: one written for each load, told to readers by a manifest, merged when there are many.

A segment holds the postings of some (library, version) pairs and is never changed.  The manifest has a row for each pair
of each segment with its number of chunks and their total length, which add up over segments.  To replace a pair, its
new segment is written and then a new generation of the manifest without the pair's old rows: only that pair's files are
written, and a reader sees the old index or the new one.  A generation counts from when its ``_SUCCESS`` is there; a load that
fails before has changed nothing, and files it left are replaced by the next of the same name, or removed by ``vacuum``.

One writer at a time.  The manifest also keeps what a stream has committed: its last batch, and the size of its table of urls.

Texts are read once.  A task counts the terms of many chunks and brings the postings of a term together, as one row of arrays, which name a
(library, version) pair by its number in the segment's part of the manifest; with the chunks' lengths, from which statistics come, they are
written, dealt to buckets in one shuffle, and stored so; a reader takes them apart.  A segment has as many buckets as keep about ``POSTINGS_A_BUCKET`` in each, so a
search of a term reads one such folder a segment, and of its files the row groups that hold the term.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from cairn.functions.text import IDENTIFIER, PROSE
from cairn.sources import paths
from cairn.sources.scratch import spread, written

#: Postings in a bucket's folder, about; buckets of a segment at most.
POSTINGS_A_BUCKET, MOST_BUCKETS = 500_000, 4096
#: Segments with fewer live postings are merged, and those of which less than this share is live.
SMALL, LIVE_SHARE = 5_000_000, 0.5
PAIR = ["library_id", "version"]
MANIFEST = "segment string, library_id string, version string, n_docs long, total_length long, n_postings long, segment_postings long, buckets int, pair int, stream string, base long, last_batch long, seen_level int, n_seen long"
STATE = {"stream": "", "base": 0, "last_batch": -1, "seen_level": 0, "n_seen": 0}
FACTS = ["segment", *PAIR, "n_docs", "total_length", "n_postings", "segment_postings", "buckets", "pair"]
#: Postings whose terms are brought together before the shuffle; texts that become one piece of a batch's result.
POSTINGS_A_BLOCK, PIECE = 1_000_000, 256
#: Rows of a batch of blocks, at most.
ROWS = 10_000
ARRAYS = {"pair": "int", "chunk_id": None, "tf": "int", "doc_length": "int"}
#: Characters of texts that are counted together, about; identifiers that a task remembers.
PIECE_CHARS, REMEMBERED = 2_000_000, 200_000


def bucket_of(term: Column, buckets) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets) if isinstance(buckets, int) else buckets).cast("int")


_PROSE, _IDENTIFIER = re.compile(PROSE), re.compile(IDENTIFIER)
_TERMS = [pa.field("term", pa.string()), pa.field("tf", pa.int64())]
_COUNTED = [pa.field("doc_length", pa.int64()), pa.field("terms", pa.list_(pa.struct(_TERMS)))]


def count_terms(text: str) -> Counter:
    """Prose tokens in small letters, and identifiers as written and in small letters where that differs, with their numbers."""
    found = Counter(_IDENTIFIER.findall(text))
    for name in [n for n in found if len(n) < 2]:
        del found[name]
    small: Counter = Counter()
    for word, n in Counter(_PROSE.findall(text)).items():
        small[word.lower()] += n
    for name, n in found.items():
        if name.lower() != name:
            small[name.lower()] += n
    found.update(small)
    return found


@F.arrow_udf(StructType([StructField("doc_length", LongType()), StructField("terms", ArrayType(StructType([StructField("term", StringType()), StructField("tf", LongType())])))]))
def terms_in(contents: pa.Array) -> pa.Array:
    """doc_length and terms (term, tf) of texts: prose tokens and identifier terms together; a null text has none."""
    pieces = []
    for at in range(0, len(contents), PIECE):
        lengths, offsets, terms, tfs = [], [0], [], []
        for text in contents.slice(at, PIECE).to_pylist():
            found = count_terms(text or "")
            terms.extend(found)
            tfs.extend(found.values())
            lengths.append(sum(found.values()))
            offsets.append(len(terms))
        each = pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.array(tfs, pa.int64())], fields=_TERMS)
        pieces.append(pa.StructArray.from_arrays([pa.array(lengths, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), each)], fields=_COUNTED))
    return pa.concat_arrays(pieces) if pieces else pa.array([], pa.struct(_COUNTED))


def in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings (term, and the columns of ``ARRAYS``) with those of a term among ``POSTINGS_A_BLOCK`` or more in one row of arrays."""
    held, n = [], 0

    def together() -> Iterator[pa.RecordBatch]:
        grouped = pa.Table.from_batches(held).group_by("term", use_threads=False).aggregate([(c, "list") for c in ARRAYS])
        yield from grouped.rename_columns([c.removesuffix("_list") for c in grouped.column_names]).select(["term", *ARRAYS]).to_batches(max_chunksize=ROWS)

    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= POSTINGS_A_BLOCK:
            yield from together()
            held, n = [], 0
    if n:
        yield from together()


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``keys`` in order, and the sums of ``n`` over equal ones."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    starts = np.flatnonzero(np.concatenate([np.ones(min(len(keys), 1), bool), ordered[1:] != ordered[:-1]]))
    return ordered[starts], np.add.reduceat(n[order], starts) if len(keys) else n


def count_together(texts: list[str | None], known: dict[str, dict[str, int]]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """What ``count_terms`` finds in each of ``texts``: terms, and for each posting its text, term and number, as arrays.

    Prose tokens lie inside identifiers, so a text's terms are those of its identifiers; ``known`` remembers an identifier's.
    """
    names, sizes = [], []
    for text in texts:
        found = _IDENTIFIER.findall(text or "")
        names += found
        sizes.append(len(found))
    coded = pa.array(names, pa.string()).dictionary_encode()
    words = coded.dictionary.to_pylist()
    keys = np.repeat(np.arange(len(texts)), sizes) * max(len(words), 1) + coded.indices.to_numpy().astype(np.int64)
    keys, n = _summed(keys, np.ones(len(keys), np.int64))
    text, word = np.divmod(keys, max(len(words), 1))
    terms, times, wide = [], [], []
    for name in words:
        if name.isalnum():  # a prose token, if it is long enough, and itself an identifier
            small = name.lower()
            own = {} if len(name) < 2 else {name: 2} if small == name else {name: 1, small: 2}
        else:
            own = known.get(name)
            if own is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                own = known[name] = dict(count_terms(name))
        terms += own
        times += own.values()
        wide.append(len(own))
    coded, wide = pa.array(terms, pa.string()).dictionary_encode(), np.array(wide, np.int64)
    each = np.repeat(np.arange(len(keys)), wide[word])  # a row for each term of each identifier
    place = np.arange(len(each)) - np.repeat(np.cumsum(wide[word]) - wide[word], wide[word]) + (np.cumsum(wide) - wide)[word[each]]
    term = coded.indices.to_numpy().astype(np.int64)[place]
    keys, n = _summed(text[each] * max(len(coded.dictionary), 1) + term, n[each] * np.array(times, np.int64)[place])
    return coded.dictionary, *np.divmod(keys, max(len(coded.dictionary), 1)), n


def counted_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From pair, chunk_id and content: postings as ``in_blocks`` makes them, and rows without a term whose docs (pair, chunk_id,
    n_terms, doc_length) are the chunks."""
    known: dict[str, dict[str, int]] = {}
    held, n = [], 0

    def together() -> Iterator[pa.RecordBatch]:
        chunk = pa.concat_arrays([h[1] for h in held])
        pair, length, n_terms = (np.concatenate([h[k] for h in held]).astype(np.int32) for k in (0, 2, 3))
        coded = pa.concat_arrays([h[4] for h in held]).dictionary_encode()
        at_doc, at_term = (np.cumsum([0, *[len(h[k]) for h in held[:-1]]]) for k in (1, 4))
        doc = np.concatenate([h[5] + at for h, at in zip(held, at_doc)])
        term = coded.indices.to_numpy()[np.concatenate([h[6] + at for h, at in zip(held, at_term)])]
        order = np.argsort(term, kind="stable")
        doc, tf = doc[order], np.concatenate([h[7] for h in held]).astype(np.int32)[order]
        offsets = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(coded.dictionary)))])
        docs = pa.StructArray.from_arrays([pa.array(pair), chunk, pa.array(n_terms), pa.array(length)], ["pair", "chunk_id", "n_terms", "doc_length"])
        lists = [pair[doc], chunk.take(pa.array(doc)), tf, length[doc]]
        for at in range(0, len(coded.dictionary), ROWS):
            some = offsets[at : at + ROWS + 1]
            arrays = [pa.ListArray.from_arrays(pa.array(some - some[0], pa.int32()), pa.array(x[some[0] : some[-1]])) for x in lists]
            yield pa.RecordBatch.from_arrays([coded.dictionary[at : at + ROWS], *arrays, pa.nulls(len(some) - 1, pa.list_(docs.type))], ["term", *ARRAYS, "docs"])
        none = [pa.nulls(1, pa.list_(pa.int32())), pa.nulls(1, pa.list_(chunk.type)), pa.nulls(1, pa.list_(pa.int32())), pa.nulls(1, pa.list_(pa.int32()))]
        for at in range(0, len(docs), ROWS):
            some = docs[at : at + ROWS]
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), *none, pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), some)], ["term", *ARRAYS, "docs"])

    for batch in batches:
        pairs, texts = batch["pair"].to_numpy(), batch["content"].to_pylist()
        at = 0
        while at < len(texts):
            to, chars = at, 0
            while to < len(texts) and chars < PIECE_CHARS:
                chars += len(texts[to] or "")
                to += 1
            terms, doc, term, tf = count_together(texts[at:to], known)
            sums = np.bincount(doc, tf, to - at), np.bincount(doc, minlength=to - at)
            held.append((pairs[at:to], batch["chunk_id"][at:to], *sums, terms, doc, term, tf))
            n, at = n + len(tf), to
            if n >= POSTINGS_A_BLOCK:
                yield from together()
                held, n = [], 0
    if held:
        yield from together()


class Index:
    """The newest generation of an index below a folder.

    postings: term, library_id, version, chunk_id, tf, doc_length, segment, bucket, buckets; lengths: library_id, version,
    chunk_id, doc_length; stats: library_id, n_docs, avg_length.  All of live pairs only.
    """

    def __init__(self, spark: SparkSession, folder: str, id_type: str = "long"):
        self.spark, self.folder, self.id_type = spark, folder, id_type

    def generation(self) -> int:
        """The newest complete generation; -1 if there is none."""
        found = (int(n.split("=")[1]) for n in paths.children(self.spark, f"{self.folder}/manifest"))
        for n in sorted(found, reverse=True):
            if paths.exists(self.spark, f"{self.folder}/manifest/generation={n}/_SUCCESS"):
                return n
        return -1

    def _whole_manifest(self) -> DataFrame:
        n = self.generation()
        if n < 0:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifest/generation={n}")

    @property
    def manifest(self) -> DataFrame:
        return self._whole_manifest().where("segment IS NOT NULL").select(*FACTS)

    def state(self) -> dict:
        """What the last stream that wrote here has committed."""
        row = self._whole_manifest().where("segment IS NULL").select(*STATE).first()
        return row.asDict() if row else dict(STATE)

    def batch_of(self, stream: str, number: int) -> int | None:
        """The number here of a stream's micro-batch, null if it is committed: streams go on from what others have committed."""
        now = self.state()
        base = now["base"] if now["stream"] == stream else now["last_batch"] + 1
        return None if base + number <= now["last_batch"] else base + number

    def _table(self, name: str, schema: str, live: DataFrame, terms: list[str] | None = None) -> DataFrame:
        """Live rows of the segments in ``live``, a part of the manifest; with ``terms``, from their buckets only."""
        root, pieces, blocks = f"{self.folder}/{name}", [], name == "postings"
        sizes: dict[int, list[str]] = {}
        for r in live.where("n_postings > 0").select("segment", "buckets").distinct().collect():
            sizes.setdefault(r["buckets"], []).append(r["segment"])
        for buckets, names in sorted(sizes.items()):
            rows = self.spark.read.schema(schema).option("basePath", root).parquet(*[f"{root}/segment={s}" for s in sorted(names)])
            if terms is not None:
                wanted = self.spark.createDataFrame([(t,) for t in terms], "t string").select(bucket_of(F.col("t"), buckets).alias("b")).distinct()
                rows = rows.where(F.col("bucket").isin([r["b"] for r in wanted.collect()]) & F.col("term").isin(terms))
            pieces.append(rows.withColumn("buckets", F.lit(buckets)) if blocks else rows)
        if not pieces:
            return self.spark.createDataFrame([], schema + (", buckets int" if blocks else ""))
        out = pieces[0]
        for p in pieces[1:]:
            out = out.unionByName(p)
        return out if blocks else out.join(live.select("segment", *PAIR), ["segment", *PAIR], "left_semi")

    def postings_of(self, live: DataFrame, terms: list[str] | None = None) -> DataFrame:
        blocks = self._table("postings", f"term string, {self._arrays()}, segment string, bucket int", live, terms)
        rows = blocks.select("term", "segment", "bucket", "buckets", F.explode(F.arrays_zip(*ARRAYS)).alias("p")).select("term", "segment", "bucket", "buckets", "p.*")
        own = ["term", *PAIR, "chunk_id", F.col("tf").cast("long").alias("tf"), F.col("doc_length").cast("long").alias("doc_length"), "segment", "bucket", "buckets"]
        return rows.join(live.select("segment", "pair", *PAIR), ["segment", "pair"]).select(*own)

    @property
    def postings(self) -> DataFrame:
        return self.postings_of(self.manifest)

    @property
    def lengths(self) -> DataFrame:
        return self._table("lengths", f"library_id string, version string, chunk_id {self.id_type}, doc_length long, segment string", self.manifest).drop("segment")

    @property
    def stats(self) -> DataFrame:
        facts = self.manifest.groupBy("library_id").agg(F.sum("n_docs").alias("n_docs"), F.sum("total_length").alias("total"))
        return facts.where("n_docs > 0").select("library_id", "n_docs", (F.col("total") / F.col("n_docs")).alias("avg_length"))

    def _commit(self, facts: DataFrame, **state) -> None:
        now = self.state() | state
        head = self.spark.createDataFrame([tuple(now[k] for k in STATE)], "stream string, base long, last_batch long, seen_level int, n_seen long")
        rows = facts.select(*FACTS).unionByName(head, allowMissingColumns=True)
        rows.coalesce(1).write.parquet(f"{self.folder}/manifest/generation={self.generation() + 1}")

    def _write(self, segment: str, chunks: DataFrame) -> DataFrame:
        """Writes a segment of chunks (library_id, version, chunk_id, content); its rows of the manifest."""
        pairs = numbered_pairs(chunks.select(*PAIR).distinct())
        texts = spread(chunks).join(F.broadcast(pairs), PAIR).select("pair", "chunk_id", "content")
        rows = written(texts.mapInArrow(counted_blocks, f"term string, {self._arrays()}, docs array<struct<pair: int, chunk_id: {self.id_type}, n_terms: int, doc_length: int>>"))
        docs = rows.where("docs IS NOT NULL").select(F.inline("docs")).join(F.broadcast(pairs), "pair").withColumn("doc_length", F.col("doc_length").cast("long"))
        has = F.col("doc_length") > 0
        docs.where(has).select(*PAIR, "chunk_id", "doc_length").write.mode("overwrite").parquet(f"{self.folder}/lengths/segment={segment}")
        facts = written(docs.groupBy("pair", *PAIR).agg(F.count_if(has).alias("n_docs"), F.sum("doc_length").alias("total_length"), F.sum(F.col("n_terms").cast("long")).alias("n_postings")))
        total = facts.agg(F.sum("n_postings")).first()[0] or 0
        buckets = 1
        while buckets < MOST_BUCKETS and buckets * POSTINGS_A_BUCKET < total:
            buckets *= 2
        self._write_postings(segment, rows.where("term IS NOT NULL").drop("docs"), buckets)
        return facts.withColumns({"segment": F.lit(segment), "segment_postings": F.lit(total).cast("long"), "buckets": F.lit(buckets)})

    def _arrays(self) -> str:
        return ", ".join(f"{c} array<{t or self.id_type}>" for c, t in ARRAYS.items())

    def _write_postings(self, segment: str, blocks: DataFrame, buckets: int) -> None:
        dealt = blocks.withColumn("bucket", bucket_of(F.col("term"), buckets)).hint("rebalance", "bucket").sortWithinPartitions("bucket", "term")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/postings/segment={segment}")

    def load(self, chunks: DataFrame, replace: bool = True, segment: str | None = None, **state) -> None:
        """Adds a segment with the pairs of ``chunks`` (chunk_id, library_id, version, content); they replace what the index has of
        these pairs, or join it."""
        own = [F.coalesce(c, F.lit("")).alias(c) for c in PAIR]
        new = self._write(segment or uuid.uuid4().hex, chunks.select(*own, F.col("chunk_id").cast(self.id_type).alias("chunk_id"), "content"))
        old = self.manifest.where(F.col("segment") != segment) if segment else self.manifest
        self._commit((old.join(new.select(*PAIR), PAIR, "left_anti") if replace else old).select(*FACTS).unionByName(new.select(*FACTS)), **state)

    def remove(self, pairs: DataFrame) -> None:
        """Takes ``pairs`` (library_id, version) out."""
        self._commit(self.manifest.join(pairs.select(*PAIR), PAIR, "left_anti"))

    def merge(self, small: int = SMALL, live_share: float = LIVE_SHARE) -> list[str]:
        """Rewrites the live rows of small and of mostly replaced segments as one, without reading texts; the names of those merged."""
        sizes = self.manifest.groupBy("segment").agg(F.sum("n_postings").alias("live"), F.max("segment_postings").alias("all")).collect()
        names = sorted(r["segment"] for r in sizes if r["live"] < small or r["live"] < live_share * r["all"])
        if len(names) < 2 and not any(r["live"] < live_share * r["all"] for r in sizes):
            return []
        segment, chosen = uuid.uuid4().hex, F.col("segment").isin(names)
        live = written(self.manifest.where(chosen))
        total = live.agg(F.sum("n_postings")).first()[0] or 0
        buckets = 1
        while buckets < MOST_BUCKETS and buckets * POSTINGS_A_BUCKET < total:
            buckets *= 2
        sums = numbered_pairs(live.groupBy(*PAIR).agg(*[F.sum(c).alias(c) for c in ("n_docs", "total_length", "n_postings")]))
        each = self.postings_of(live).join(sums.select(*PAIR, "pair"), PAIR).select("term", *[F.col(c).cast(t or self.id_type).alias(c) for c, t in ARRAYS.items()])
        self._write_postings(segment, each.mapInArrow(in_blocks, f"term string, {self._arrays()}"), buckets)
        lengths = self._table("lengths", f"library_id string, version string, chunk_id {self.id_type}, doc_length long, segment string", live)
        lengths.drop("segment").write.mode("overwrite").parquet(f"{self.folder}/lengths/segment={segment}")
        merged = sums.withColumns({"segment": F.lit(segment), "segment_postings": F.lit(total).cast("long"), "buckets": F.lit(buckets)})
        self._commit(self.manifest.where(~chosen).unionByName(merged.select(*FACTS)))
        return names

    def vacuum(self) -> list[str]:
        """Deletes segments and generations that the newest generation doesn't name; no reader may still use them."""
        now, live = self.generation(), {r["segment"] for r in self.manifest.select("segment").distinct().collect()}
        gone = [f"manifest/{n}" for n in paths.children(self.spark, f"{self.folder}/manifest") if int(n.split("=")[1]) < now]
        gone += [f"{t}/{n}" for t in ("postings", "lengths") for n in paths.children(self.spark, f"{self.folder}/{t}") if n.startswith("segment=") and n.split("=", 1)[1] not in live]
        for name in gone:
            paths.remove(self.spark, f"{self.folder}/{name}")
        return gone


def numbered_pairs(facts: DataFrame) -> DataFrame:
    """``facts`` of pairs with a number for each: as many rows as a segment has in the manifest."""
    return written(facts.withColumn("pair", F.row_number().over(Window.orderBy(*PAIR))))


def build(chunks: DataFrame, folder: str, id_type: str = "long") -> Index:
    """A new index of ``chunks`` (chunk_id, library_id, content, and version if it is there). Chunks without terms are not in it."""
    index = Index(chunks.sparkSession, folder, id_type)
    index.load(chunks if "version" in chunks.columns else chunks.withColumn("version", F.lit("")))
    return index
