"""Packing: documents into fixed windows by the sum-of-squares rule.

Each task packs the documents of its own scan partitions as they stream by, so nothing is shuffled and a hot source
is just more partitions.  A document longer than a window first fills whole windows; its rest goes to the fill level
that leaves the smallest sum of squared counts of partly filled windows.  The counts live in one array with a slot for
each fill level.  Pieces may be cut: when a task ends, or holds ``MOST_OPEN`` open windows, the emptiest windows are
cut up to fill the fullest, so at most one window of a task stays partly filled.  The rule leaves a number of open windows
that depends on the lengths, not on the rows, so the fewer rows a task has, the more of its windows are filled by cutting.

Null texts pack as the end id alone; null ids, repeated rows and empty tables are packed like any other; very long texts
fill whole windows as they come.  Other columns, whatever their names, are not read.  Window ids follow from the partition
and the order in it, so a task that runs again gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.tokenizing import word_encoder

#: Open windows that a task holds at most: 32 MB of ids at 2048 ids a window.
MOST_OPEN = 4096
#: Rows that a task packs, at least: where input partitions have fewer, a task takes several, as what is open at its end is cut.
LEAST_ROWS = 4096
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class Packer:
    """Sum-of-squares packing with a level array. ``add`` and ``close`` yield the pieces of windows that are complete.

    A piece is (doc, start, ids as bytes, doc_tokens); a yielded one has the window's number and the offset in it too.
    """

    def __init__(self, size: int = 2048, most_open: int = MOST_OPEN):
        self.size, self.most_open = size, most_open
        self.levels = np.zeros(size + 1, dtype=np.int64)
        self.open: list[list[list[tuple]]] = [[] for _ in range(size)]  # windows by fill
        self.n_open = self.n_done = 0

    def level_for(self, s: int) -> int:
        """The fill level at which ``s`` more ids leave the least sum of squares; the fullest among equals."""
        n = self.levels
        top = self.size - s
        gain = 2 * n[s : self.size + 1] - 2 * n[: top + 1] + 2  # of level h: h loses a window, h + s gets one
        gain[top] -= 2 * n[self.size] + 1  # a full window counts no more
        gain[1:][n[1 : top + 1] == 0] = np.iinfo(np.int64).max
        gain[0] = 2 * n[s] + 1  # a new window
        return top - int(np.argmin(gain[::-1]))

    def _done(self, pieces: list[tuple]) -> Iterator[tuple]:
        at = 0
        for doc, start, ids, total in pieces:
            yield doc, start, ids, total, self.n_done, at
            at += len(ids) // 4
        self.n_done += 1

    def add(self, doc, ids: bytes) -> Iterator[tuple]:
        total, at, width = len(ids) // 4, 0, self.size
        while total - at >= width:
            yield from self._done([(doc, at, ids[4 * at : 4 * (at + width)], total)])
            at += width
        s = total - at
        if not s:
            return
        h = self.level_for(s)
        window = self.open[h].pop() if h else []
        window.append((doc, at, ids[4 * at :], total))
        if h:
            self.levels[h] -= 1
            self.n_open -= 1
        if h + s == width:
            yield from self._done(window)
        else:
            self.levels[h + s] += 1
            self.open[h + s].append(window)
            self.n_open += 1
            if self.n_open >= self.most_open:
                yield from self._cut()

    def _cut(self) -> Iterator[tuple]:
        """Fills the fullest windows with cuts of the emptiest ones; one partly filled window may stay."""
        windows = [(fill, w) for fill in range(self.size - 1, 0, -1) for w in self.open[fill]]
        self.open, self.n_open = [[] for _ in range(self.size)], 0
        self.levels[:] = 0
        first, last = 0, len(windows) - 1
        spare: list[tuple] = []  # pieces of the window being cut up
        while first <= last or spare:
            if not spare and first == last:
                fill, window = windows[first]
                self.open[fill].append(window)
                self.levels[fill], self.n_open = 1, 1
                return
            fill, window = windows[first] if first <= last else (0, [])
            first += 1
            while fill < self.size:
                if not spare:
                    if first > last:
                        break
                    spare = windows[last][1][::-1]
                    last -= 1
                doc, start, ids, total = spare.pop()
                k = min(self.size - fill, len(ids) // 4)
                window.append((doc, start, ids[: 4 * k], total))
                if 4 * k < len(ids):
                    spare.append((doc, start + k, ids[4 * k :], total))
                fill += k
            if fill == self.size:
                yield from self._done(window)
            else:
                self.open[fill].append(window)
                self.levels[fill] += 1
                self.n_open += 1

    def close(self) -> Iterator[tuple]:
        yield from self._cut()
        for windows in self.open:
            for window in windows:
                yield from self._done(window)


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) in windows of ``size`` ids: ``SCHEMA``, ids little-endian unsigned 32-bit.

    ``tokenizer`` is the path of a tokenizers file that every worker can read.  Tasks take ``LEAST_ROWS`` rows or more on average,
    which moves no row from where it lies to another partition but reads partitions together.
    """
    docs = docs.coalesce(max(1, docs.count() // LEAST_ROWS))
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset")] + [("ids", pa.binary())])
        packer, encode, base, rows = Packer(size), word_encoder(tokenizer).encode, TaskContext.get().partitionId() << 33, []

        def batch():
            doc, start, ids, total, window, at = zip(*rows)
            rows.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(total, pa.int64()), pa.array([base + w for w in window], pa.int64()), pa.array(at, pa.int64()), pa.array(ids, pa.binary())],
                schema=schema,
            )

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                for piece in packer.add(doc, encode(text.as_py()) + end):
                    rows.append(piece)
                    if len(rows) >= 2048:
                        yield batch()
        for piece in packer.close():
            rows.append(piece)
            if len(rows) >= 2048:
                yield batch()
        if rows:
            yield batch()

    narrow = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return narrow.mapInArrow(run, SCHEMA)
