"""Token groups, links and their counts against a plain walk over bytes."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from tokenizers import Tokenizer

from cairn.llm import alignment
from cairn.llm.queries import QUERIES
from cairn.llm.token_count import byte_letters

D = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    tokenizer = Tokenizer.from_file(A)
    tokenizer.encode_special_tokens = True
    return tokenizer, sentencepiece.SentencePieceProcessor(model_file=B)


def groups_of(text, libraries):
    """[(A ids, B ids)] of a text, found by walking along both."""
    tokenizer, pieces = libraries
    byte = {c: b for b, c in byte_letters().items()}
    a = [(i, bytes(byte[c] for c in tokenizer.id_to_token(i))) for i in tokenizer.encode(" " + text, add_special_tokens=False).ids] if text else []
    spell = lambda p: bytes([int(p[3:5], 16)]) if p.startswith("<0x") else p.replace("▁", " ").encode()
    b = [(i, spell(pieces.id_to_piece(i))) for i in pieces.encode(text)] if text else []
    if not text or any(b"".join(x for _, x in side) != (" " + text).encode() for side in (a, b)):
        return []
    ends = lambda side: [sum(len(x) for _, x in side[: k + 1]) for k in range(len(side))]
    ends_a, ends_b = ends(a), ends(b)
    out, i, j = [], 0, 0
    for cut in sorted(set(ends_a) & set(ends_b)):
        ni, nj = ends_a.index(cut) + 1, ends_b.index(cut) + 1
        out.append(([t for t, _ in a[i:ni]], [t for t, _ in b[j:nj]]))
        i, j = ni, nj
    return out


def expected(rows, libraries):
    """The rows of align for (doc_id, text)."""
    groups = [groups_of(t, libraries) for _, t in rows]
    links = [Counter((x, y) for a, b in g for x in a for y in b) for g in groups]
    docs = Counter(p for own in links for p in own)
    most = {}
    for (x, _), n in docs.items():
        most[x] = max(n, most.get(x, 0))
    out = []
    for (i, _), g, own in zip(rows, groups, links):
        spelled = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append((i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(own.values()), sum(n for p, n in own.items() if docs[p] == most[p[0]]), sum(n * docs[p] for p, n in own.items()), hashlib.sha256(spelled.encode()).hexdigest() if g else ""))
    return out


def result(df):
    return df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()


key = lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:]))


def test_op11_whole_table(spark, libraries):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{D}/documents.parquet").to_pylist()]
    got = result(QUERIES["op11_token_alignment"](spark, D))
    assert sorted(map(tuple, got), key=key) == sorted(expected(rows, libraries), key=key)


@pytest.mark.parametrize("most_sent, at_once", [(1_000_000, 1 << 23), (40, 1 << 23), (0, 7)])
def test_awkward_texts(spark, libraries, monkeypatch, most_sent, at_once):
    """Nulls, ties, repeats, texts that aren't spelled back; pairs sent, pairs joined, and links in parts."""
    rnd = random.Random(5)
    signs = ["a", "th", "e ", "  ", " ", "\n", "é", "ñ", "漢", "😀", "▁", "<|endoftext|>", "<s>", "<0x0A>", "23", "\x00", "ﬁ", "'s", "...", "\r\n", "ab" * 40]
    texts = [None, "", " ", "a ", " a", "▁", "the the the", "the the the", "😀" * 30, "a" * 3000] + ["".join(rnd.choices(signs, k=rnd.randint(1, 30))) for _ in range(120)]
    rows = [(None if k % 7 == 3 else k // 2, t) for k, t in enumerate(texts)]
    monkeypatch.setattr(alignment, "AT_ONCE", at_once)
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "doc_id long, text string, pairs string, `row` long, `a.b` string")
    assert sorted(map(tuple, result(alignment.align(df, A, B, most_sent))), key=key) == sorted(expected(rows, libraries), key=key)
    assert alignment.align(df.limit(0), A, B).count() == 0


def test_many_links_of_one_group_stay_few_pairs():
    """A group of n equal A tokens and n equal B tokens has n * n links and one pair."""
    import numpy as np

    n = 3000
    a, b = np.zeros(n + 1, np.int64), np.full(n + 1, 1, np.int64)
    a[-1], b[0] = 2, 3
    groups = alignment.Aligned([a], [b], np.array([4, 0, 2]), np.array([0, 4, 0, 2]))
    text, pair, ns = groups.links()
    assert len(groups.n_a) == 1 and len(pair) == 4 and ns.sum() == (n + 1) ** 2


def test_pairs_that_are_sent(spark):
    table = spark.createDataFrame([(i, 1 + i // 10, True) for i in range(100)], "pair long, docs long, best boolean")
    assert alignment.sent_from(table, 100) == 1 and 1 < alignment.sent_from(table, 50) <= 11
    assert table.where(f"docs >= {alignment.sent_from(table, 50)}").count() <= 50
