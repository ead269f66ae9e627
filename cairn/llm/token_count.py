"""Token counts of byte-level BPE by rank-synchronous merging of arrays.

Pre-tokens are cut by the vocabulary's pattern.  A batch of new ones is held as one ragged array of symbols; each round
finds the lowest-ranked pair of every pre-token by a sorted lookup and merges all its occurrences in that pre-token, left
to right, in all pre-tokens at once.  The symbols that survive are the tokens.  Counts of pre-tokens that recur are
remembered in a bounded table.

Long pre-tokens, of which each round would merge a small part, keep their pairs by rank instead: the ranks are taken from
the lowest, all pairs of a rank in all of them are merged at once, and only the pairs beside a merge are looked up again.
That is the same order of merges, and the work grows with the bytes, not with bytes times rounds.

Null texts count as empty (0 tokens), very long ones are counted whole.  A special string inside a text is one token, as
the library has it by default.  Repeated rows are counted alike, null ids too; an empty table gives an empty one; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REMEMBERED = 400_000
LONGEST_REMEMBERED = 64
#: Bytes from which a pre-token's pairs are kept by rank; bytes of such pre-tokens that are merged together, about.
LONG, TOGETHER = 512, 1 << 20
#: The pattern of byte-level BPE vocabularies of this kind. A fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[int, str]:
    """Byte to the letter that stands for it in byte-level vocabularies: itself if printable, else from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class RankMerger:
    """Counts the symbols that are left of pre-tokens once all merges are applied."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left, right = (np.array([vocab[p[i]] for p in pairs], dtype=np.int64) for i in (0, 1))
        made = np.array([vocab["".join(p)] for p in pairs], dtype=np.int64)
        key = left << 32 | right
        order = np.argsort(key)
        self.keys, self.ranks, self.made = key[order], order.astype(np.int64), made
        letters = byte_letters()
        self.byte_ids = np.array([vocab[letters[b]] for b in range(256)], dtype=np.int64)
        self.special = [t["content"] for t in spec["added_tokens"]]
        import regex

        self.find = regex.compile(PATTERN).findall
        self.cut = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))).split if self.special else None
        self.known: dict[str, int] = {}

    def ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols; the number of ranks for pairs that never merge."""
        key = a << 32 | b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], len(self.made))

    def swept(self, words: list[str]) -> list[int]:
        """As ``survivors``, by rank."""
        data = [w.encode() for w in words]
        length = [len(b) for b in data]
        n, none = sum(length), len(self.made)
        owner = np.repeat(np.arange(len(words)), length)
        sym = np.append(self.byte_ids[np.frombuffer(b"".join(data), np.uint8)], -1)
        ends = np.cumsum(length)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1] = n  # a place behind the last, which pairs with none
        before[ends - length] = n
        after, before = np.append(after, n), np.append(before, n)
        rank = np.full(n + 1, none)
        rank[:-1] = self.ranks_of(sym[:-1], sym[after[:-1]])
        rank[:-1][after[:-1] == n] = none
        alive = np.ones(n, dtype=bool)
        waiting: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def wait(places: np.ndarray) -> None:
            places = places[rank[places] < none]
            order = np.argsort(rank[places], kind="stable")
            places = places[order]
            own = rank[places]
            cuts = np.flatnonzero(own[1:] != own[:-1]) + 1
            for r, some in zip(own[np.concatenate([[0], cuts])].tolist() if len(own) else [], np.split(places, cuts)):
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(queue, r)
                waiting[r].append(some)

        wait(np.arange(n))
        while queue:
            r = heapq.heappop(queue)
            some = waiting.pop(r)
            at = some[0] if len(some) == 1 else np.unique(np.concatenate(some))
            at = at[rank[at] == r]
            if len(at) > 1:  # of overlapping pairs every other one merges, from the left
                new_run = np.concatenate([[True], after[at[:-1]] != at[1:]])
                first = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - first) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            beyond = after[gone]
            sym[at] = self.made[r]
            alive[gone] = False
            rank[gone] = none
            after[at] = beyond
            before[beyond] = at
            before[n] = n
            changed = np.concatenate([before[at], at])
            changed = changed[changed < n]
            changed = np.unique(changed) if len(at) > 1 else changed
            rank[changed] = np.where(after[changed] == n, none, self.ranks_of(sym[changed], sym[after[changed]]))
            wait(changed)
        return np.bincount(owner[alive], minlength=len(words)).tolist()

    def survivors(self, words: list[str]) -> list[int]:
        """The number of symbols left of each word."""
        data = [w.encode() for w in words]
        length = np.array([len(b) for b in data], dtype=np.int64)
        out = length.copy()
        sym = self.byte_ids[np.frombuffer(b"".join(data), np.uint8)]
        owner = np.repeat(np.arange(len(words)), length)
        none = np.int64(len(self.made))
        while len(sym) > 1:
            key = sym[:-1] << 32 | sym[1:]
            at = np.searchsorted(self.keys, key)
            at[at == len(self.keys)] = 0
            rank = np.where((self.keys[at] == key) & (owner[:-1] == owner[1:]), self.ranks[at], none)
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            size = np.diff(np.append(starts, len(owner)))
            least = np.minimum.reduceat(np.append(rank, none), starts)
            live = least < none
            if not live.all():  # finished words leave the arrays
                out[owner[starts[~live]]] = size[~live]
                keep = np.repeat(live, size)
                if not keep.any():
                    return out.tolist()
                rank = np.append(rank, none)[keep][:-1]
                sym, owner, least, size = sym[keep], owner[keep], least[live], size[live]
                rank[owner[:-1] != owner[1:]] = none
            hit = rank == np.repeat(least, size)[:-1]
            hit &= rank < none
            where = np.flatnonzero(hit)
            if len(where) > 1:  # in a run of overlapping pairs every other one merges, from the left
                new_run = np.concatenate([[True], np.diff(where) > 1])
                first = np.maximum.accumulate(np.where(new_run, np.arange(len(where)), 0))
                where = where[(np.arange(len(where)) - first) % 2 == 0]
            sym[where] = self.made[rank[where]]
            keep = np.ones(len(sym), dtype=bool)
            keep[where + 1] = False
            sym, owner = sym[keep], owner[keep]
        if len(sym):
            out[owner] = 1
        return out.tolist()

    def count(self, text: str) -> int:
        total = 0
        parts = self.cut(text) if self.cut else [text]
        total += len(parts) - 1
        for part in parts:
            total += self._count(self.find(part))
        return total

    def _count(self, words: list[str]) -> int:
        known = self.known
        new = list(set(words).difference(known))
        learned: dict[str, int] = {}
        if new:
            long = [w for w in new if len(w) >= LONG]
            short = [w for w in new if len(w) < LONG] if long else new
            for i in range(0, len(short), 4096):
                some = short[i : i + 4096]
                learned.update(zip(some, self.survivors(some)))
            some, size = [], 0
            for w in long:
                some.append(w)
                size += len(w)
                if size >= TOGETHER:
                    learned.update(zip(some, self.swept(some)))
                    some, size = [], 0
            if some:
                learned.update(zip(some, self.swept(some)))
            if len(known) + len(new) > REMEMBERED:
                learned.update((w, known[w]) for w in set(words) if w in known)
                known.clear()
            known.update((w, n) for w, n in learned.items() if len(w) <= LONGEST_REMEMBERED)
            if any(len(w) > LONGEST_REMEMBERED for w in learned):
                return sum(learned[w] if w in learned else known[w] for w in words)
        return sum(map(known.__getitem__, words))


@lru_cache(maxsize=2)
def rank_merger(path: str) -> RankMerger:
    return RankMerger(path)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of ``docs`` (doc_id, text); ``vocabulary``: a byte-level BPE file."""

    def run(batches):
        merger = rank_merger(vocabulary)
        for b in batches:
            counts = [merger.count(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
