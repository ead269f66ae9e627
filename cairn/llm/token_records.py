"""Token ids as length-delimited binary records, with a separate offset index for shuffled reads.

A shard file is a row of records.  A record is

    length    unsigned 64-bit, of the payload
    check     unsigned 32-bit, masked CRC-32 of the eight bytes before
    payload
    check     unsigned 32-bit, masked CRC-32 of the payload

and a payload is: has_id (one byte), doc_id (signed 64-bit), id width in bytes (one byte: 2 or 4), ids.  All numbers are
little-endian.  Documents are range-partitioned by doc_id, so shard numbers and the order inside a shard follow it.
Every attempt of a task writes a file of its own; the index, which Spark commits, names only the files of the attempts
that counted, so lost executors and speculative copies do no harm.

Null texts are the end id alone; null doc_ids come first; rows of equal doc_id, null too, are ordered by their texts' hash
and text, and may lie in several shards; repeated rows are records of their own; very long texts are one record.  An empty
table gives an empty index; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.tokenizing import word_encoder

INDEX_SCHEMA = "shard int, file string, doc_id long, offset long, n_bytes long, start_in_shard long, n_tokens long"
#: Bytes that a reader fetches at once, but for longer records.
READ_AHEAD = 8 << 20
_HEAD, _CHECK, _PAYLOAD = struct.Struct("<Q"), struct.Struct("<I"), struct.Struct("<BqB")


def masked_crc(data: bytes) -> int:
    """CRC-32, rotated right by 15 bits plus a constant, so that checks over data that hold checks stay sound."""
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = _HEAD.pack(len(payload))
    return b"".join((head, _CHECK.pack(masked_crc(head)), payload, _CHECK.pack(masked_crc(payload))))


def unframe(data: memoryview) -> memoryview:
    """The payload of the record at the start of ``data``; ValueError if a check fails."""
    (n,) = _HEAD.unpack_from(data)
    if _CHECK.unpack_from(data, 8)[0] != masked_crc(bytes(data[:8])) or len(data) < n + 16:
        raise ValueError("damaged record length")
    payload = data[12 : 12 + n]
    if _CHECK.unpack_from(data, 12 + n)[0] != masked_crc(payload):
        raise ValueError("damaged record payload")
    return payload


def serialize(doc_id: int | None, ids: bytes, width: int) -> bytes:
    """ids: little-endian unsigned 32-bit."""
    if width == 2:
        ids = np.frombuffer(ids, "<u4").astype("<u2").tobytes()
    return _PAYLOAD.pack(doc_id is not None, doc_id or 0, width) + ids


def deserialize(payload: memoryview) -> tuple[int | None, bytes]:
    has_id, doc_id, width = _PAYLOAD.unpack_from(payload)
    ids = payload[_PAYLOAD.size :]
    return doc_id if has_id else None, np.frombuffer(ids, "<u2").astype("<u4").tobytes() if width == 2 else bytes(ids)


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Encodes ``docs`` (doc_id, text) into shard files in ``folder``/data and returns the index, a table in ``folder``/index.

    ``folder`` is a URI that pyarrow and Spark both write to.  ``tokenizer`` is a path that every worker can read.
    """
    end = int(end_id).to_bytes(4, "little")
    target = pafs.FileSystem.from_uri(folder)
    target[0].create_dir(f"{target[1]}/data", recursive=True)

    def run(batches):
        encoder, shard = word_encoder(tokenizer), TaskContext.get().partitionId()
        width = 2 if encoder.library.get_vocab_size() <= 65536 else 4
        store, root = pafs.FileSystem.from_uri(folder)
        name, offset, start, out = f"shard-{shard:06d}-{uuid.uuid4().hex}.rec", 0, 0, None
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                if out is None:
                    out = store.open_output_stream(f"{root}/data/{name}", buffer_size=1 << 20)
                ids = encoder.encode(text.as_py()) + end
                record = frame(serialize(doc_id, ids, width))
                out.write(record)
                rows.append((shard, name, doc_id, offset, len(record), start, len(ids) // 4))
                offset += len(record)
                start += len(ids) // 4
            if rows:
                columns = list(zip(*rows))
                kinds = (pa.int32(), pa.string(), *[pa.int64()] * 5)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in INDEX_SCHEMA.split(", ")])
        if out is not None:
            out.close()

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text")  # equal ids may take many ranges
    rows.mapInArrow(run, INDEX_SCHEMA).write.parquet(f"{folder}/index")
    return read_index(docs.sparkSession, folder)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(INDEX_SCHEMA).parquet(f"{folder}/index")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records that ``index`` (or any selection of its rows) names: doc_id, start, n_tokens, ids.

    ``start`` is the number of ids before the document in the whole collection: totals of the shards, a row each, are
    summed on the driver.
    """
    spark = index.sparkSession
    totals = read_index(spark, folder).groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect()
    shards = [r["shard"] for r in totals]
    bases = np.concatenate([[0], np.cumsum([r["n"] for r in totals])]).tolist()

    def run(batches):
        store, root = pafs.FileSystem.from_uri(folder)
        opened, handle = None, None

        def fetch(rows):
            nonlocal opened, handle
            first, last = rows[0], rows[-1]
            if opened != first["file"]:
                if handle is not None:
                    handle.close()
                opened, handle = first["file"], store.open_input_file(f"{root}/data/{first['file']}")
            data = memoryview(handle.read_at(last["offset"] + last["n_bytes"] - first["offset"], first["offset"]))
            out = []
            for r in rows:
                at = r["offset"] - first["offset"]
                doc_id, ids = deserialize(unframe(data[at : at + r["n_bytes"]]))
                base = bases[bisect_left(shards, r["shard"])]
                out.append((doc_id, base + r["start_in_shard"], len(ids) // 4, ids))
            doc, start, n, ids = zip(*out)
            return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

        for b in batches:
            held: list[dict] = []
            for r in b.to_pylist():
                if held and (r["file"] != held[0]["file"] or r["offset"] != held[-1]["offset"] + held[-1]["n_bytes"] or r["offset"] + r["n_bytes"] - held[0]["offset"] > READ_AHEAD):
                    yield fetch(held)
                    held = []
                held.append(r)
            if held:
                yield fetch(held)
        if handle is not None:
            handle.close()

    return index.select("shard", "file", "offset", "n_bytes", "start_in_shard").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
