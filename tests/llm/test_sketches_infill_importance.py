"""Fingerprints, fill-in-the-middle and importance resampling against brute force and exact round trips."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corrobora.llm import fingerprints as fp
from corrobora.llm import importance, infill
from corrobora.llm.ranges import with_next
from tests.llm.test_documents import SCHEMA, prose, rows


@pytest.fixture(scope="module")
def docs(spark):
    """All kinds of texts, with columns that clash with the operators' own."""
    frame = spark.createDataFrame(rows(), SCHEMA).repartition(5)
    return frame.withColumnsRenamed({"lang": "range", "source": "pieces", "n_chars": "rank"}).withColumn("_h", F.lit("x"))


def in_order(data):
    """(doc_id, text) by doc_id, null ids last; the tests use one text for each repeated id."""
    return sorted(((r[0], r[1] or "") for r in data), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def paragraphs(text: str) -> list[str]:
    out, now = [], ""
    for m in re.finditer(r"([^\x20\x09-\x0D]*)([\x20\x09-\x0D]*)", text):
        now += m[0]
        if "\n" in m[2] or (m[1] and hashlib.md5(m[1].encode()).hexdigest()[0] in "01"):
            out.append(now)
            now = ""
    return [*out, now] if now else out


def jaccard(a: str, b: str) -> float:
    x, y = Counter(paragraphs(a)), Counter(paragraphs(b))
    union = (x | y).total()
    return (x & y).total() / union if union else 1.0


def test_fingerprints(docs):
    data = in_order(rows())
    want = []
    for (d, text), (_, after) in zip(data, [*data[1:], data[0]], strict=True):
        half = len(text) // 2
        new = text[: len(text) - half] + after[:half]
        want.append((d, len(text), hashlib.sha256(new.encode()).hexdigest(), jaccard(text, new), jaccard(text, after), len(paragraphs(text))))
    found = fp.compared(docs).collect()
    got = [(r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next, r.n_paragraphs) for r in found]
    assert sorted(got, key=str) == sorted(want, key=str)
    by_text = {}
    for r, (_, text) in zip(sorted(found, key=lambda r: (r.doc_id is None, r.doc_id)), data, strict=True):
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint
    assert len({*by_text.values()}) == len(by_text)


@pytest.mark.parametrize("partitions", ["1", "30"])
def test_next_row_over_ranges(spark, partitions):
    """A third of the rows share an id, others have none; many ranges are empty."""
    data = [(7, f"t{i}") for i in range(300)] + [(i, "u") for i in range(0, 4000, 13)] + [(None, f"n{i % 50}") for i in range(200)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        frame = spark.createDataFrame(data, "doc_id long, text string").withColumn("tie", F.xxhash64("text"))
        out = with_next(frame, "doc_id", "tie").select("range", "ahead", "doc_id", "tie").mapInPandas(_pairs, "a long, s long, b long, t long")
        got = [tuple(r) for r in out.collect()]
        ties = {(r.doc_id, r.text): r.tie for r in frame.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    order = sorted(((d, ties[d, t]) for d, t in data), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert Counter(got) == Counter((*a, *b) for a, b in zip(order, [*order[1:], order[0]], strict=True))


def _pairs(batches):
    import pandas as pd

    held, out = None, []
    for batch in batches:
        for ahead, d, tie in zip(batch["ahead"], batch["doc_id"].astype("Int64"), batch["tie"], strict=True):
            own = (None if d is pd.NA else d, tie)
            if ahead and held is None:
                continue
            if held is not None:
                out.append((*held, *own))
            held = None if ahead else own
    yield pd.DataFrame(out, columns=["a", "s", "b", "t"]).astype({"a": "Int64", "b": "Int64"})


def test_single_document_is_its_own_next(spark):
    row = fp.compared(spark.createDataFrame([(4, "abcd efgh")], "doc_id long, text string")).first()
    assert row.near_next == 1 and row.edited_sha256 == hashlib.sha256(b"abcd abcd").hexdigest()
    assert fp.compared(spark.createDataFrame([], SCHEMA)).count() == 0


def test_peeling_recovers_what_differs():
    rng = random.Random(6)
    text = lambda k: "".join(f"line {rng.random()}\n" for _ in range(k))
    sizes = ((0, 0, 0), (1, 0, 5), (3, 4, 1000), (60, 2, 10), (500, 700, 20), (4000, 0, 3), (2, 2, 2))
    parts = [[fp.keys_of(text(k)) for k in s] for s in sizes]
    a = [np.concatenate([both, x]) for x, _, both in parts]
    b = [np.concatenate([y, both]) for _, y, both in parts]
    found = fp.differences(a, b, fp.Sketches.of(a) - fp.Sketches.of(b))
    for (gone, come), (x, y, _) in zip(found, parts, strict=True):
        assert sorted(gone.tolist()) == sorted(x.tolist()) and sorted(come.tolist()) == sorted(y.tolist())
    assert fp.differences([], [], fp.Sketches.of([])) == []


def test_first_width_fails_on_many_and_sketches_parse():
    a, b = (fp.keys_of("".join(f"{k} {i}\n" for i in range(40))) for k in "ab")
    cells = fp.Sketches.of([a, a]) - fp.Sketches.of([b, a])
    assert cells.peeled()[3].tolist() == [False, True]
    texts = fp.Sketches.of([a, b]).texts()
    back = fp.Sketches.parsed(texts)
    assert back.texts() == texts and back.width == fp.WIDTH and len(texts[0]) == 96 * fp.WIDTH
    owners, keys, signs, empty = (back - fp.Sketches.of([a[:-2], b])).peeled()
    assert empty.all() and set(keys.tolist()) == set(a[-2:].tolist()) and set(owners.tolist()) == {0} and (signs == 1).all()


def test_fill_in_middle(spark, docs):
    data = [(r[0], r[1] or "") for r in rows()]
    extra = [(5000 + i, t) for i, t in enumerate(["has <P> in it", "<", "<S<S", "ends <", "é中\U0001f600" * 40, *[prose(random.Random(i), 9) for i in range(200)]])]
    frame = docs.select("doc_id", "text", "pieces", "_h").unionByName(spark.createDataFrame(extra, "doc_id long, text string"), True)
    table = infill.arranged(frame)
    want = []
    for d, text in data + extra:
        hexa = hashlib.sha256(f"1:{'null' if d is None else d}".encode()).hexdigest()
        h = [int(hexa[8 * k : 8 * k + 8], 16) for k in range(4)]
        n = len(text)
        a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        plain = not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90
        form = "plain" if plain else "spm" if h[3] % 100 < 20 else "psm"
        pre, mid, suf = text[:a], text[a:b], text[b:]
        out = {"plain": text, "psm": f"<P>{pre}<S>{suf}<M>{mid}", "spm": f"<S>{suf}<P>{pre}<M>{mid}"}[form]
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((d, n, form, None if plain else a, None if plain else b - a, sha(out), sha(text)))
    assert len({w[2] for w in want}) == 3
    assert sorted(map(tuple, infill.digests(table).collect()), key=str) == sorted(want, key=str)
    outs = Counter((r.doc_id, hashlib.sha256(r.o.encode()).hexdigest()) for r in table.select("doc_id", infill.output().alias("o")).collect())
    assert outs == Counter((w[0], w[5]) for w in want)
    assert infill.arranged(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sentinels_that_overlap_are_refused():
    for bad in (("ab", "bc", "xy"), ("aa", "b", "c"), ("a", "a", "b"), ("", "a", "b"), ("abc", "b", "x")):
        with pytest.raises(ValueError):
            infill.checked(bad)
    other = ("[pre]", "[mid]", "[suf]")
    text = "[pre[mid]x"
    table = [(0, 2, 3)]
    assert b"".join(infill.streamed(table, (text,))) == b"re["
    made = "[suf]tail[pre]head[mid]body"
    assert b"".join(infill.streamed(infill.restoring(made, "spm", other), (made,))) == b"headbodytail"


def brute_features(text: str) -> list[str]:
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def test_importance_resampling(spark, docs):
    data = [(r[0], r[1] or "") for r in rows()]
    aim = ["the river and the stone", "Ação of the river, river 42", None]
    target = spark.createDataFrame([(i, t) for i, t in enumerate(aim)], "item_id long, text string")
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s = Counter(bucket(f) for _, t in data for f in brute_features(t))
    t = Counter(bucket(f) for x in aim if x for f in brute_features(x))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10000) / ((s[b] + 1) * (t.total() + 10000))))
    want, open_ = [], []
    for d, text in data:
        own = [gain(bucket(f)) for f in brute_features(text)]
        weight = sum(own) // len(own) if own else 0
        h = int(hashlib.sha256(f"7:{'null' if d is None else d}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        want.append((d, len(own), weight, score))
        if (len(own) + 1) // 2 >= 20:
            open_.append(want[-1])
    order = sorted(open_, key=lambda r: (-r[3], r[0] is None, r[0] or 0))[: 25 * len(open_) // 100]
    found = importance.resampled(docs, target, 7, 25, 20).collect()
    assert sorted((tuple(r)[:4] for r in found), key=str) == sorted(want, key=str)
    assert [tuple(r)[:4] for r in sorted((r for r in found if r["rank"]), key=lambda r: r["rank"])] == order
    assert importance.resampled(spark.createDataFrame([], SCHEMA), target, 7, 25, 20).count() == 0


@pytest.mark.parametrize("wanted", [0, 1, 499, 500, 501, 900, 1000])
def test_draw_with_ties_repeats_and_null_ids(spark, wanted):
    rng = random.Random(1)
    data = [(i // 2 if i % 9 else None, 5, rng.choice([-3, 0, 7]), 12 if i % 3 else rng.randrange(-(10**9), 10**9)) for i in range(1000)]
    frame = spark.createDataFrame(data, "doc_id long, n_features long, weight long, score long").withColumn("eligible", F.lit(True))
    found = importance.drawn(frame, wanted).collect()
    assert len(found) == 1000
    order = sorted(data, key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[2]))
    got = sorted((r for r in found if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in got] == list(range(1, wanted + 1))
    assert [(r.doc_id, r.n_features, r.weight, r.score) for r in got] == order[:wanted]


def test_threshold_search_is_exact(spark):
    rng = random.Random(3)
    values = [rng.choice([-(2**62), 2**62, 0, 1, 1, rng.randrange(-50, 50)]) for _ in range(400)]
    frame = spark.createDataFrame([(v,) for v in [*values, None]], "v long")
    for wanted in (1, 7, 200, 399, 400):
        assert importance.least_reaching(frame, "v", wanted) == sorted(values, reverse=True)[wanted - 1]
    assert importance.least_reaching(frame, "v", 401) is None
