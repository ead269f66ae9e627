"""Verdicts of the quality rules against plain Python, and every stage of the pipeline against what it read."""

import math
import re
import zlib
from collections import Counter, defaultdict
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from cairn.llm import quality, secrets
from cairn.llm.packing import Packer
from cairn.llm.queries import QUERIES
from test_operators import SPACE, awkward, empty, level, plain_base, plain_components, plain_fingerprint

D = "/root/testdata/sf0.001"
CLASSES = ["[a-z]", "[A-Z]", "[0-9]", r"[\x20\x09-\x0D]", "[.,;:!?'\"()-]", r"[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]"]


def half_up(x, digits=0):
    return float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


def histograms(text, lang):
    n = [len(re.findall(c, text)) for c in CLASSES]
    n[5] -= n[4] and len(re.findall("[.,;:!?'\"()-]", text))
    words = [w.lower() for w in SPACE.findall(text)]
    listed = quality.COMMON.get(lang, [])
    common = [words.count(w) for w in listed]
    return [*n, len(text) - sum(n)], [*common, len(words) - sum(common)]


def apart(p, q):
    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    part = lambda x, m: x * math.log2(x / m) if x > 0 else 0.0
    return math.sqrt(max(0.0, sum((part(x, (x + y) / 2) + part(y, (x + y) / 2)) / 2 for x, y in zip(p, q))))


def plain_verdicts(docs):
    """kept of each of ``docs``."""
    rows = []
    for r in docs:
        n, _, _, _, repeat = plain_base(r["text"] or "")
        classes, common = histograms(r["text"] or "", r["lang"])
        rows.append({"key": r["lang"], "failed": n < 10 or 100 * repeat > 20 * n, "classes": classes, "common": common})
    parts = lambda h: [half_up(x * quality.PARTS / sum(h)) for x in h]
    least = {"classes": quality.LEAST_CHARS, "common": quality.LEAST_WORDS}

    def distances(others):
        sums, count = {}, Counter()
        for r in rows:
            for h, enough in least.items():
                if r["counted"] and sum(r[h]) >= enough:
                    sums[r["key"], h] = np.array(parts(r[h])) + sums.get((r["key"], h), 0)
                    count[r["key"], h] += 1
        for r in rows:
            for h, enough in least.items():
                r[h + "_apart"] = None
                if sum(r[h]) >= enough and count[r["key"], h] - r["counted"] >= others and len(r[h]) > 1:
                    rest = sums[r["key"], h] - (np.array(parts(r[h])) if r["counted"] else 0)
                    r[h + "_apart"] = apart(r[h], rest.tolist()) if rest.sum() > 0 else None

    for r in rows:
        r["counted"] = not r["failed"]
    distances(quality.LEAST_OTHERS)
    limits = {"classes": quality.MOST_CHARS_APART, "common": quality.MOST_WORDS_APART}
    for key in {r["key"] for r in rows}:
        for h, most in limits.items():
            own = [half_up(r[h + "_apart"], 3) for r in rows if r["key"] == key and not r["failed"] and r[h + "_apart"] is not None]
            top = max(most, float(np.percentile(own, 50))) if own else most
            for r in rows:
                if r["key"] == key:
                    r[h + "_close"] = r[h + "_apart"] is None or half_up(r[h + "_apart"], 3) <= top
    for r in rows:
        r["counted"] = not r["failed"] and r["classes_close"] and r["common_close"]
    distances(1)
    return [not r["failed"] and all((r[h + "_apart"] or 0.0) <= most for h, most in limits.items()) for r in rows]


def test_op7_verdicts_whole_table(spark):
    docs = pq.read_table(f"{D}/documents.parquet").to_pylist()
    got = {r["doc_id"]: r["kept"] for r in QUERIES["op7_quality_rules"](spark, D).collect()}
    assert got == {r["doc_id"]: k for r, k in zip(docs, plain_verdicts(docs))}


def replaced(text, spans):
    out, at = "", 0
    for s, e in spans:
        out += text[at:s] + "[SECRET]" if not at or s >= at else ""
        at = max(at, e)
    return out + text[at:]


def test_stages(spark, tmp_path):
    """Each stage by its own rule over all that the stage before has kept."""
    rows = spark.read.parquet(f"{D}/documents.parquet")
    prose = next(r["text"] for r in rows.where("doc_id = 1").collect())
    rows = rows.unionByName(spark.createDataFrame([(9000 + i, f"{prose} {w} token: s3cr3t{i}value, AKIA{'Q7' * 9} end", "en", "src1", 9) for i, w in enumerate(("uno due", "tre quattro cinque"))], rows.schema))
    made = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, rows, D).write.parquet(f"{tmp_path}/{name}")
        made[name] = [r.asDict() for r in rows.collect()], [r.asDict() for r in spark.read.parquet(f"{tmp_path}/{name}").collect()]
        rows = spark.read.parquet(f"{tmp_path}/{name}")
    order = lambda rs: sorted(rs, key=lambda r: (r["doc_id"], r["text"]))

    docs, kept = made["quality_rules"]
    assert order(kept) == order([r for r, k in zip(docs, plain_verdicts(docs)) if k])

    docs, first = made["near_duplicates"]
    least: dict = {}
    roots = plain_components([plain_fingerprint(r["text"]) for r in docs])
    for r, x in zip(docs, roots):
        least[x] = min(least.get(x, r["doc_id"]), r["doc_id"])
    assert order(first) == order([r for r in docs if r["doc_id"] in set(least.values())])

    docs, clean = made["secret_scan"]
    spans = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in secrets.scan(spark.read.parquet(f"{tmp_path}/near_duplicates")).collect()}
    want = []
    for r in docs:
        text = replaced(r["text"], spans[r["doc_id"]])
        want.append(r | {"text": text, "n_chars": len(text) if spans[r["doc_id"]] else r["n_chars"]})
    assert order(clean) == order(want)

    docs, mixed = made["source_mix"]
    size, total = {r["doc_id"]: len(SPACE.findall(r["text"])) for r in docs}, Counter()
    for r in docs:
        total[r["source"]] += size[r["doc_id"]]
    taken, by_id, times = Counter(), {r["doc_id"]: r for r in docs}, Counter()
    for r in mixed:
        own, words = by_id[r["doc_id"]], SPACE.findall(r["text"])
        taken[r["source"]] += len(words)
        times[r["doc_id"]] += 1
        whole = len(words) == size[r["doc_id"]]
        assert r == own if whole else words == SPACE.findall(own["text"])[: len(words)] and r["n_chars"] == len(r["text"]) and r["source"] == own["source"]
    assert all(taken[s] == round(w) for s, w in level(total).items()) and max(times.values()) <= 3

    docs, pieces = made["packing"]
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = lambda text: np.asarray([*t.encode(text, add_special_tokens=False).ids, 1], dtype="<u4")
    encoded = Counter((r["doc_id"], len(ids(r["text"]))) for r in docs)
    texts = defaultdict(list)
    for r in docs:
        texts[r["doc_id"], len(ids(r["text"]))].append(ids(r["text"]))
    got, windows = Counter(), defaultdict(list)
    for r in pieces:
        got[r["doc_id"], r["doc_tokens"]] += r["length"]
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
        assert any(zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for x in texts[r["doc_id"], r["doc_tokens"]])
    assert got == Counter({k: k[1] * n for k, n in encoded.items()})
    for w in windows.values():
        assert [o for o, _ in sorted(w)] == np.cumsum([0, *[n for _, n in sorted(w)]])[:-1].tolist() and sum(n for _, n in w) <= 2048


def test_run_is_the_stages(spark):
    rows = corpus_pipeline.run(spark, D)
    assert rows.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and rows.count() > 0


def test_awkward_tables(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    for rows in (awkward(spark), empty(spark).select(*docs.columns)):
        columns = rows.columns
        for name, stage in corpus_pipeline.STAGES:
            rows = stage(spark, rows, D)
            assert name == "packing" or rows.columns == columns
        rows.count()


def plain_level(levels, s, size):
    """The level whose use leaves the least sum of squared counts, by trying them all; the fullest among equals."""
    best = None
    for h in range(size - s, -1, -1):
        if h and not levels[h]:
            continue
        after = Counter({i: n for i, n in enumerate(levels) if 0 < i < size})
        if h:
            after[h] -= 1
        if h + s < size:
            after[h + s] += 1
        total = sum(n * n for n in after.values())
        if best is None or total < best[0]:
            best = total, h
    return best[1]


@pytest.mark.parametrize("seed", range(3))
def test_levels_leave_the_least_sum_of_squares(seed):
    r, packer = np.random.default_rng(seed), Packer(40)
    for i in range(400):
        s = int(r.integers(1, 40))
        assert packer.level_for(s) == plain_level(packer.levels.tolist(), s, 40)
        list(packer.add(i, b"\0" * 4 * s))


def test_padding_is_little():
    """Less than a window of padding, whatever the lengths, and few cuts where a task has many rows."""
    r, packer, cut = np.random.default_rng(0), Packer(2048), Counter()
    done = []
    for i, n in enumerate(r.lognormal(5.5, 1.2, 5000).astype(int) + 1):
        done += packer.add(i, b"\0" * 4 * int(n))
    before = packer.n_done
    done += packer.close()
    windows = defaultdict(int)
    for doc, _, ids, total, window, _ in done:
        windows[window] += len(ids) // 4
        cut[doc] += total <= 2048
    assert sum(n < 2048 for n in windows.values()) <= 1 and before > 0.5 * packer.n_done
    assert sum(n > 1 for n in cut.values()) < 0.2 * len(cut)


def test_stages_with_any_column_names(spark, tmp_path):
    """Dots, backticks, and names that operators use inside: every stage takes them, and all but the last return them."""
    rows = pq.read_table(f"{D}/documents.parquet").slice(0, 60).to_pylist()
    extra = ["a.b", "x`y", "`", "key", "own_0", "carried_0", "f", "spans", "scanned", "h", "row", "counted"]
    df = spark.createDataFrame(rows)
    for i, c in enumerate(extra):
        df = df.withColumn(c, F.concat(F.lit(f"{i}-"), F.col("doc_id").cast("string")))
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, df, D)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == df.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        df = spark.read.parquet(f"{tmp_path}/{name}")
        got = df.collect()
        assert got, name
        if i < len(corpus_pipeline.STAGES) - 1:
            assert all(r[c] == f"{k}-{r['doc_id']}" for r in got for k, c in enumerate(extra)), name
