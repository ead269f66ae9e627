"""Spelling variants against trying every letter at every place."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq

from cairn.llm import spelling
from cairn.llm.queries import QUERIES

D = "/root/testdata/sf0.001"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows, least=7):
    words = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            words[run] += 1
    return {w: n for w, n in words.items() if len(w) >= least and n >= 2}


def expected(words):
    letters = {c for w in words for c in w}
    near = {}
    for w in words:
        made = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters}
        near[w] = [v for v in made if v in words and v != w]
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= 10 * words[w]:
            form[w] = best
    out = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(near[w]), words.get(form.get(w))))
    return out


def test_op13_whole_table(spark):
    words = counted([(r["doc_id"], r["text"]) for r in pq.read_table(f"{D}/documents.parquet").to_pylist()])
    got = QUERIES["op13_spelling_variants"](spark, D)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len(set(got)) and set(got) == expected(words) and any(f for _, f, *_ in got)


def test_awkward_texts(spark):
    """Few letters and many repeats, so that words have many near ones, ties and chains of forms; nulls and clashing names."""
    rnd = random.Random(7)
    text = lambda: " ".join("".join(rnd.choices("aAbÀ", k=rnd.randint(6, 8))) for _ in range(60))
    rows = [(k if k % 5 else None, text()) for k in range(60)] + [(1, None), (2, ""), (3, "1234 x"), (4, "aaaaaaa"), (4, "aaaaaaa")]
    rows += [(9, "b" * 5000 + " " + "b" * 5001 + " " + "b" * 5000 + " " + "b" * 5001)]
    rows += [(100 + k, "chained " * (200 if k == 0 else 0) + "chainde " * 2) for k in range(2)]
    rows += [(200, "abcdefg " * 2000 + "abcdefgh " * 200 + "abcdefghi " * 20 + "abcdefghij " * 2)]
    df = spark.createDataFrame([(*r, "w", 1, "k") for r in rows], "doc_id long, text string, word string, n int, `a.b` string")
    got = [tuple(r) for r in spelling.variants(df).collect()]
    words = counted(rows)
    assert len(got) == len(set(got)) and set(got) == expected(words)
    assert max(r[4] for r in got) > 10
    assert spelling.variants(df.limit(0)).count() == 0


def test_keys_and_orders():
    words = ["abcabca", "bacabca", "abcabc", "aabbccd", "x" * 3000 + "y"]
    codes = np.array([ord(c) for w in words for c in w], np.int64)
    word, place, key, order, _ = spelling.places_of(codes, np.array([len(w) for w in words]))
    told = {}
    for w, p, k, o in zip(word.tolist(), place.tolist(), key.tolist(), order.tolist()):
        rest = words[w] if p < 0 else words[w][:p] + words[w][p + 1 :]
        assert k == sum(ord(c) ** 5 for c in rest)
        told.setdefault((k, o), rest)
        assert told[(k, o)] == rest
    assert len(set(told)) == len(set(told.values()))
