"""Alignment of two tokenizers by byte-owner arrays.

Tokens A are those of a byte-level BPE for a space and the text, tokens B those of a sentencepiece BPE, which adds the space
itself, so both spell the same bytes.  In a batch of texts laid end to end, ``np.repeat`` gives the token that owns each byte,
for A and for B.  Where both owners change, a group ends; consecutive distinct owner pairs are the overlaps.  In a group
with one token on either side the overlaps are all its links; in others each distinct A id meets each distinct B id, with
the product of their numbers, so a group of many equal tokens stays small.

A pair's count is the number of documents that hold it linked.  Documents, with their distinct pairs, are written once.
Counts are summed where the pairs lie and then by pair.  The pairs of the most documents, ``SENT`` at most, are sent to every
task and looked up there; only the others of a document are shuffled to meet their counts.  So a pair in every document
is never gathered, and none is left out.

Null and empty texts, and texts that a tokenizer doesn't spell back byte by byte, have no tokens: zeros and an empty digest.
Very long texts are aligned whole, with their pairs in several parts where they have very many.  Repeated rows and null ids
are rows of their own, counted as often as they occur; an empty table gives an empty one; other columns, whatever their
names, are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.storage import written
from cairn.llm.token_count import byte_letters

#: Pairs that are sent to every task at most: 17 bytes each.
SENT = 1_000_000
#: A pair is an A id shifted by so many bits, and a B id.
BITS = 24
#: Bytes of texts that are aligned together, about; links of one text that are held at once.
TOGETHER, AT_ONCE = 1 << 21, 1 << 23
#: Chunks that a worker remembers, and the longest of them.
REMEMBERED, LONGEST_REMEMBERED = 500_000, 64
_CHUNK = re.compile(" +[^ ]*")


class ByteTokens:
    """Ids of a byte-level BPE: special strings are plain text."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = {c: b for b, c in byte_letters().items()}
        special = {t["content"] for t in spec["added_tokens"]}
        # a merge makes the next id, so ids are the ranks of merges
        self.bytes = {i: bytes(letters[c] for c in token) for token, i in spec["model"]["vocab"].items() if token not in special}
        ranks = {b: i for i, b in self.bytes.items()}
        self.library = tiktoken.Encoding("byte level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = max(self.bytes) + 1
        self.length = np.zeros(self.size, np.int64)
        self.length[list(self.bytes)] = [len(b) for b in self.bytes.values()]

    def encode(self, text: str, data: bytes) -> np.ndarray | None:
        """Ids, or None if they don't spell ``data``."""
        ids = self.library.encode_ordinary(text)
        return np.array(ids, np.int64) if self.library.decode_bytes(ids) == data else None


class PieceTokens:
    """Ids of a sentencepiece BPE, which puts a space before the text.

    No piece holds a space after another character, so a run of spaces and what follows it up to the next are encoded apart, and
    the ids of chunks that recur are remembered; a model with other pieces encodes texts whole.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.library.get_piece_size()
        pieces = [self.library.id_to_piece(i) for i in range(self.size)]
        by_byte = re.compile("<0x([0-9A-F]{2})>")
        spell = lambda i, p: bytes([int(by_byte.fullmatch(p)[1], 16)]) if self.library.is_byte(i) else p.replace("▁", " ").encode()
        self.bytes = [spell(i, p) for i, p in enumerate(pieces)]
        self.length = np.array([len(b) for b in self.bytes], np.int64)
        self.chunked = not any("▁" in p.lstrip("▁") for p in pieces)
        #: the library gives an empty text no tokens, so a lone space at a text's end is its own piece
        self.lone = np.array([self.library.piece_to_id("▁")], "<u4").tobytes()
        self.known: dict[str, bytes | None] = {" ": self.lone}

    def _encode(self, texts: list[str]) -> list[bytes | None]:
        """Ids of texts that begin with a space, which the library adds; None where they don't spell the text."""
        out = []
        for t, ids in zip(texts, self.library.encode([t[1:] for t in texts], num_threads=1)):
            out.append(np.array(ids, "<u4").tobytes() if b"".join([self.bytes[i] for i in ids]) == t.encode() else None)
        return out

    def encode(self, text: str) -> np.ndarray | None:
        """Ids of ``text``, which begins with a space, or None if they don't spell it."""
        chunks = _CHUNK.findall(text) if self.chunked else [text]
        new = list(set(chunks).difference(self.known))
        self.known.update(zip(new, self._encode(new)))
        parts = [self.known[c] for c in chunks]
        for c in new:
            if len(c) > LONGEST_REMEMBERED:
                del self.known[c]
        if len(self.known) > REMEMBERED:
            self.known = {" ": self.lone}
        if None in parts:
            return None
        return np.frombuffer(b"".join(parts), "<u4").astype(np.int64)


@lru_cache(maxsize=2)
def tokenizers_of(path_a: str, path_b: str) -> tuple[ByteTokens, PieceTokens]:
    return ByteTokens(path_a), PieceTokens(path_b)


@lru_cache(maxsize=1)
def spelled_ids(n: int) -> list[bytes]:
    """Each id with a comma, a bar and a semicolon behind it."""
    return [b"%d%c" % (i, c) for i in range(n) for c in b",|;"]


def ragged(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of ``sizes``."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


class Aligned:
    """Groups of tokens of texts laid end to end; every text has tokens."""

    def __init__(self, a: list[np.ndarray], b: list[np.ndarray], length_a: np.ndarray, length_b: np.ndarray):
        self.a, self.b, self.texts = np.concatenate(a), np.concatenate(b), len(a)
        len_a, len_b = length_a[self.a], length_b[self.b]
        owner_a = np.repeat(np.arange(len(self.a), dtype=np.int32), len_a)
        owner_b = np.repeat(np.arange(len(self.b), dtype=np.int32), len_b)
        new_a, new_b = owner_a[1:] != owner_a[:-1], owner_b[1:] != owner_b[:-1]
        # the texts' ends are ends of tokens of both, so they are cuts too
        starts = np.concatenate([[0], np.flatnonzero(new_a & new_b) + 1])
        overlaps = np.concatenate([[0], np.flatnonzero(new_a | new_b) + 1])
        self.first_a, self.first_b = owner_a[starts].astype(np.int64), owner_b[starts].astype(np.int64)
        self.n_a, self.n_b = np.diff(self.first_a, append=len(self.a)), np.diff(self.first_b, append=len(self.b))
        group = np.searchsorted(starts, overlaps, "right") - 1
        plain = (np.minimum(self.n_a, self.n_b) == 1)[group]
        self.over_a, self.over_b, self.over_group = owner_a[overlaps[plain]], owner_b[overlaps[plain]], group[plain]
        text_ends = np.cumsum([len(x) for x in a])
        self.text_groups = np.searchsorted(self.first_a, np.concatenate([[0], text_ends]))
        self.text_of = np.repeat(np.arange(self.texts), np.diff(self.text_groups))

    def per_text(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.text_groups[:-1])

    def digests(self, spelled: list[bytes]) -> list[str]:
        """Of ``a1,a2|b1;a3|b2,b3`` for each text."""
        of_a, of_b = np.repeat(np.arange(len(self.n_a)), self.n_a), np.repeat(np.arange(len(self.n_b)), self.n_b)
        out = np.empty(len(self.a) + len(self.b), np.int64)
        sign_a, sign_b = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        sign_a[self.first_a + self.n_a - 1], sign_b[self.first_b + self.n_b - 1] = 1, 2
        out[np.arange(len(self.a)) + self.first_b[of_a]] = self.a * 3 + sign_a
        out[np.arange(len(self.b)) + (self.first_a + self.n_a)[of_b]] = self.b * 3 + sign_b
        ends = np.append(self.first_a + self.first_b, len(out))[self.text_groups].tolist()
        places = out.tolist()
        spell = spelled.__getitem__
        return [hashlib.sha256(b"".join(map(spell, places[s:e]))[:-1]).hexdigest() for s, e in zip(ends[:-1], ends[1:])]

    def links(self, part: int = 0, parts: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """text, pair and number of occurrences, by text and pair; of A ids that leave ``part`` when divided by ``parts``."""
        a, b, text = self.a[self.over_a], self.b[self.over_b], self.text_of[self.over_group]
        n = np.ones(len(a), np.int64)
        many = np.flatnonzero(np.minimum(self.n_a, self.n_b) > 1)
        if len(many):
            ids_a, n_a, m_a = self._distinct(self.a, self.first_a, self.n_a, many)
            ids_b, n_b, m_b = self._distinct(self.b, self.first_b, self.n_b, many)
            keep = ids_a % parts == part
            m_a = np.add.reduceat(keep, np.cumsum(m_a) - m_a, dtype=np.int64)
            ids_a, n_a = ids_a[keep], n_a[keep]
            of = np.repeat(np.arange(len(many)), m_a)  # each of A's meets all B's of its group
            at_b = np.repeat((np.cumsum(m_b) - m_b)[of], m_b[of]) + ragged(m_b[of])
            at_a = np.repeat(np.arange(len(ids_a)), m_b[of])
            a, b, text = np.concatenate([a, ids_a[at_a]]), np.concatenate([b, ids_b[at_b]]), np.concatenate([text, self.text_of[many][of[at_a]]])
            n = np.concatenate([n, n_a[at_a] * n_b[at_b]])
        keep = a % parts == part
        a, b, text, n = a[keep], b[keep], text[keep], n[keep]
        pair = a << BITS | b
        order = np.lexsort((pair, text))
        text, pair = text[order], pair[order]
        new = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (pair[1:] != pair[:-1])])) if len(pair) else np.zeros(0, np.int64)
        return text[new], pair[new], np.add.reduceat(n[order], new) if len(new) else n[:0]

    @staticmethod
    def _distinct(ids, first, n, groups) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct ids of each of ``groups``, how often each occurs, and how many each group has."""
        size = n[groups]
        own = ids[np.repeat(first[groups], size) + ragged(size)]
        group = np.repeat(np.arange(len(groups)), size)
        order = np.lexsort((own, group))
        own, group = own[order], group[order]
        new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (group[1:] != group[:-1])]))
        return own[new], np.diff(new, append=len(own)), np.bincount(group[new], minlength=len(groups))


def batches_of(rows, most: int):
    """Lists of (index, ids of A, ids of B, bytes) of ``most`` bytes about."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += r[3]
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and pairs and ns: the distinct pairs with their occurrences.

    A row for each row of ``docs`` (doc_id, text), and more with the same ``row``, zeros and no digest for further pairs of it.
    """

    def run(batches):
        of_a, of_b = tokenizers_of(path_a, path_b)
        spelled = spelled_ids(max(of_a.size, of_b.size))

        def encoded(batch):
            for i, t in enumerate(batch.column(1)):
                text = t.as_py()
                if not text:
                    continue
                text = " " + text
                data = text.encode()
                b = of_b.encode(text)
                a = None if b is None else of_a.encode(text, data)
                if a is not None:
                    yield i, a, b, len(data)

        next_row = (TaskContext.get().partitionId() << 36) if TaskContext.get() else 0

        def table(rows, ids, n_a, n_b, n_groups, n_links, shas, ends, pairs, ns):
            lists = lambda v: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, pa.int64()))
            numbers = [pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups, n_links)]
            return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), ids, *numbers, pa.array(shas, pa.string()), lists(pairs), lists(ns)], names=names)

        for batch in batches:
            ids, without = batch.column(0), set(range(len(batch)))
            for held in batches_of(encoded(batch), TOGETHER):
                own = [h[0] for h in held]
                without.difference_update(own)
                groups = Aligned([h[1] for h in held], [h[2] for h in held], of_a.length, of_b.length)
                n_links = groups.per_text(groups.n_a * groups.n_b)
                per = [[len(h[1]) for h in held], [len(h[2]) for h in held], np.diff(groups.text_groups), n_links, groups.digests(spelled)]
                parts = max(1, -(-int(n_links.sum()) // AT_ONCE))
                for part in range(parts):
                    text, pair, n = groups.links(part, parts)
                    ends = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(own)))])
                    yield table(next_row + np.array(own), ids.take(pa.array(own)), *per, ends, pair, n)
                    per = [np.zeros(len(own), np.int64)] * 4 + [[""] * len(own)]
            if without:
                none = sorted(without)
                zeros = np.zeros(len(none), np.int64)
                yield table(next_row + np.array(none), ids.take(pa.array(none)), zeros, zeros, zeros, zeros, [""] * len(none), np.zeros(len(none) + 1), zeros[:0], zeros[:0])
            next_row += len(batch)

    schema = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, ns array<long>"
    names = [c.split()[0] for c in schema.split(", ")]
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, docs and best (is it the highest of its A id) of the rows of ``aligned``."""
    counts = written(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("docs")))
    own = F.shiftright("pair", BITS)
    highest = counts.groupBy(own.alias("a")).agg(F.max("docs").alias("most"))  # a row an id of A's vocabulary
    return counts.withColumn("a", own).join(highest, "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def sent_from(table: DataFrame, most: int) -> int:
    """A number of documents that ``most`` pairs have at most, or more; 1 if all may be sent."""
    step = F.floor(F.log2("docs") * 4).cast("int")  # a few hundred steps, whatever the numbers
    left = most
    for r in sorted(table.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n"), F.min("docs").alias("least"), F.max("docs").alias("last")).collect(), reverse=True):
        left -= r["n"]
        if left < 0:
            return r["last"] + 1
    return 1


def align(docs: DataFrame, path_a: str, path_b: str, most_sent: int = SENT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row of ``docs`` (doc_id, text)."""
    rows = written(aligned(docs, path_a, path_b))
    table = written(pair_counts(rows))
    least = sent_from(table, most_sent)
    sent = table.where(F.col("docs") >= least).orderBy("pair").toPandas()
    value = docs.sparkSession.sparkContext.broadcast((sent["pair"].to_numpy(np.int64), sent["docs"].to_numpy(np.int64), sent["best"].to_numpy(bool)))

    def run(batches):
        known, n_docs, best = value.value
        known, n_docs, best = np.append(known, -1), np.append(n_docs, 0), np.append(best, False)
        for b in batches:
            pairs, ns = b.column(7), b.column(8).flatten().to_numpy()
            flat, ends = pairs.flatten().to_numpy(), np.concatenate([[0], np.cumsum(pairs.value_lengths().to_numpy())])
            at = np.searchsorted(known[:-1], flat)
            found = known[at] == flat
            own = np.where(found, ns, 0)
            sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[ends])
            rest_ends = np.concatenate([[0], np.cumsum(~found)])[ends].astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(rest_ends), pa.array(x[~found])) for x in (flat, ns)]
            columns = [*b.columns[:7], pa.array(sums(own * best[at])), pa.array(sums(own * n_docs[at])), *lists]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, pairs array<long>, ns array<long>"
    names = [c.split()[0] for c in schema.split(", ")]
    looked_up = rows.mapInArrow(run, schema)
    if least > 1:
        looked_up = written(looked_up)
        each = looked_up.select("row", F.explode(F.arrays_zip("pairs", "ns")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.ns").alias("n"))
        rest = each.join(table.where(F.col("docs") < least), "pair")
        rest = rest.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("docs")).alias("count_sum"))
        looked_up = looked_up.unionByName(rest, allowMissingColumns=True)
    numbers = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    out = looked_up.groupBy("row").agg(F.max("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in numbers], F.max("groups_sha256").alias("groups_sha256"))
    return out.drop("row")
