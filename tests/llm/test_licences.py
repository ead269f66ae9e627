"""The licence scan against plain searches, and texts with known licences."""

import random
import re

import pyarrow.parquet as pq

from cairn.llm import licences
from cairn.llm.queries import QUERIES

D = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def base_of(own):
    out = []
    for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
        p = phrase.split()
        out += [(i, label) for i in range(len(own)) if own[i : i + len(p)] == p]
    return sorted(out)


def longest_matches(own, texts, least):
    """(end, length, template, end in it) of equal runs that neither side extends, by trying all ends."""
    out = []
    for i in range(1, len(own) + 1):
        for k, t in enumerate(texts):
            for j in range(1, len(t) + 1):
                n = 0
                while n < min(i, j) and own[i - 1 - n] == t[j - 1 - n]:
                    n += 1
                if n >= least and not (i < len(own) and j < len(t) and own[i] == t[j]):
                    out.append((i, n, k, j))
    return out


def test_op12_whole_table(spark):
    got = QUERIES["op12_licence_scan"](spark, D).collect()
    text = {r["doc_id"]: r["text"] for r in pq.read_table(f"{D}/documents.parquet").to_pylist()}
    texts = [words(t) for _, t in licences.TEMPLATES]
    assert sorted(r["doc_id"] for r in got) == sorted(text) and any(r["n_base"] for r in got)
    for r in got:
        own = words(text[r["doc_id"]])
        base = base_of(own)
        assert (r["n_words"], r["n_base"]) == (len(own), len(base)) and 0 <= r["score"] <= 1
        assert (r["first_word"], r["last_word"]) == ((base[0][0], base[-1][0]) if base else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in base}))
        whole = {label for (label, _), t in zip(licences.TEMPLATES, texts) if any(own[i : i + len(t)] == t for i in range(len(own)))}
        assert set(r["labels"].split(",")) - {""} == {x for _, x in base} | whole and (r["score"] == 1) == bool(whole)


def test_matching_statistics():
    rnd = random.Random(3)
    for _ in range(150):
        pick = lambda n: [rnd.choice([b"a", b"b", b"c"]) for _ in range(rnd.randint(1, n))]
        texts, phrases = [pick(9) for _ in range(rnd.randint(1, 4))], [pick(3) for _ in range(2)]
        own = [rnd.choice([b"a", b"b", b"c", b"x"]) for _ in range(rnd.randint(0, 40))]
        automaton = licences.Automaton(texts, phrases)
        matches, places = automaton.stream(own, 2)
        assert sorted(matches) == sorted(longest_matches(own, texts, 2)) and [m[0] for m in matches] == sorted(m[0] for m in matches)
        assert sorted(places) == sorted((i, k) for k, p in enumerate(phrases) for i in range(len(own)) if own[i : i + len(p)] == p)


def test_awkward_and_altered_texts(spark):
    mit = licences.TEMPLATES[3][1]
    altered = mit.replace("free of charge", "gratis").replace("\n", " ").replace("merge, publish", "publish")
    rows = [
        (1, None), (2, ""), (None, "ALL RIGHTS\nRESERVED. cc-by CC BY"), (None, "ALL RIGHTS\nRESERVED. cc-by CC BY"), (3, "lorem " * 50 + altered + " ipsum" * 50),
        (4, " ".join(mit.split()[: len(mit.split()) // 2])), (5, ("x y z " * 30_000) + "Released under the MIT License. " * 3), (6, "GNU General Public License, version 2"), (7, "Éa all rights reserved été" + "\x00-" * 9),
        (8, "gnu general public license for the version"),
    ]
    df = spark.createDataFrame([(*r, [1], "s") for r in rows], "doc_id long, text string, base array<int>, `a``b` string")
    got = {(r["doc_id"], k): r for k, r in enumerate(licences.scan(df).collect())}
    by = {i: r for (i, _), r in got.items()}
    assert len(got) == len(rows) and by[1]["n_words"] == by[2]["n_words"] == 0 and by[1]["score"] == 0 and by[1]["base"] == by[1]["spans"] == []
    assert [(x["start"], x["label"]) for x in by[None]["base"]] == [(0, "reserved"), (3, "cc-by"), (5, "cc-by")]
    assert [x["label"] for x in by[3]["spans"]] == ["mit"] and by[3]["spans"][0]["start"] == 50 and 0.9 <= by[3]["score"] < 1
    assert by[3]["spans"][0]["end"] == by[3]["n_words"] - 50
    assert by[4]["spans"] == [] and 0.4 < by[4]["score"] < 0.6
    assert [(x["label"], x["start"]) for x in by[5]["spans"]] == [("mit", 90_001)] and by[5]["n_words"] == 90_015
    assert [x["label"] for x in by[6]["spans"]] == ["gpl-2.0"] and [x["label"] for x in by[6]["base"]] == ["gpl"]
    assert by[7]["n_words"] == 5 and by[7]["base"][0]["start"] == 1 and by[8]["spans"] == []
    assert licences.scan(df.limit(0)).count() == 0


def test_chains_keep_order_and_gap():
    text = licences.words_of("a b c d e f g h i j k l")
    automaton = licences.Automaton([text], [])
    covered = lambda s, gap=3: licences.chains(automaton.stream(licences.words_of(s), 4)[0], gap).get(0, (0,))[0]
    assert covered("a b c d x e f g h x i j k l") == 12 and covered("i j k l x e f g h x a b c d") == 4
    assert covered("a b c d x x x x e f g h") == 4 and covered("a b c d x x x e f g h") == 8
    assert covered("a b c d e f d e f g h i") == 9  # words that both matches hold count once
