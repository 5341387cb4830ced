"""Operators 11 and 12 beside slow versions."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cellweave.llm import negatives, spelling
from cellweave.llm._shared import Scratch

SF = "/root/testdata/sf0.001"
LOW = str.maketrans(spelling.UPPER, spelling.LOWER)


def counted(rows, noise=31):
    c = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if noise and h % noise == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 7:
                c[w] += 1
    return {w: n for w, n in c.items() if n >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def slow(rows, noise=31):
    n = counted(rows, noise)
    out = {}
    for w in n:
        ns = [v for v in n if one_edit(w, v)]
        form = min(ns, key=lambda v: (-n[v], v), default=None)
        out[w] = [n[w], len(ns), form if form and n[form] >= 10 * n[w] else None]
    for w in out:
        root = w
        while out[root][2]:
            root = out[root][2]
        out[w] += [n[out[w][2]] if out[w][2] else None, root]
    return {w: tuple(x) for w, x in out.items()}


def held(df):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


def test_query_11_is_that_of_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    found = spelling.op11(spark, SF)
    assert {"word", "n", "n_near", "form", "form_n", "root"} <= set(found.columns)
    n = counted(rows)
    by_length = {}
    for w in n:
        by_length.setdefault(len(w), []).append(w)
    got = held(found)
    assert set(got) == set(n)
    r = random.Random(5)
    for w in r.sample(sorted(n), 150):
        ns = [v for k in (-1, 0, 1) for v in by_length.get(len(w) + k, []) if one_edit(w, v)]
        form = min(ns, key=lambda v: (-n[v], v), default=None)
        form = form if form and n[form] >= 10 * n[w] else None
        assert got[w][:4] == (n[w], len(ns), form, n[form] if form else None)


@pytest.mark.parametrize("tile", [3, 2048])
def test_forms_roots_tiles_and_odd_rows(spark, tile):
    words = {"separate": 450, "seperate": 30, "seperat": 3, "Separates": 2, "ééééééé": 40, "ééééééÿ": 2, "éééÉééé": 2, "abcdefgh": 2, "bacdefgh": 2, "×abcdefg": 3, "ßabcdefg": 30, "onlyonce": 1, "shorter": 5, "short": 50}
    r = random.Random(2)
    many = [w for w, n in words.items() for _ in range(n)] + [f"prefix{a}{b}" for a in "abcdef" for b in "abcdefgh" for _ in range(2)]
    r.shuffle(many)
    rows = [(None, None), (1, ""), (2, "x" * 50_000), (3, " ".join(many[:200])), (3, " ".join(many[:200])), (None, " ".join(many[200:])), (-7, "1234 !!")]
    docs = spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], "doc_id long, text string, word string, n string")
    got = held(spelling.variants(docs.repartition(3), Scratch(spark, "t"), noise=None, tile=tile))
    assert got == slow(rows, None)
    assert got["seperat"][2:] == ("seperate", got["seperate"][0], "separate") and got["onlyonce" if "onlyonce" in got else "shorter"]
    assert held(spelling.variants(docs, Scratch(spark, "t"), tile=tile)) == slow(rows)
    assert held(spelling.variants(docs.limit(0), Scratch(spark, "t"))) == {}


def test_one_edit_by_rows():
    r = random.Random(3)
    words = ["".join(r.choices("ab", k=r.randrange(1, 7))) for _ in range(300)]
    t = spelling.Tile(pa.array(words))
    i, j = (x.ravel() for x in np.meshgrid(np.arange(300), np.arange(300)))
    keep = (t.length[j] - t.length[i] >= 0) & (t.length[j] - t.length[i] <= 1)
    i, j = i[keep], j[keep]
    got = spelling._one_edit(t.text[i], t.text[j], t.length[i] != t.length[j])
    assert got.tolist() == [one_edit(words[a], words[b]) for a, b in zip(i.tolist(), j.tolist())]


@pytest.mark.parametrize("shape", [(1, 1, 1), (7, 5, 3), (40, 64, 33), (65, 130, 67), (0, 4, 3), (3, 0, 4)])
def test_strassen_is_exact(shape):
    n, k, m = shape
    g = np.random.default_rng(1)
    a, b = g.integers(-(2**24), 2**24, (n, k)), g.integers(-(2**24), 2**24, (k, m))
    exact = np.array([[sum(int(x) * int(y) for x, y in zip(row, col)) for col in b.T] for row in a], np.int64).reshape(n, m)
    assert (negatives.strassen(a, b, leaf=2) == exact).all()


def hard(rows, one_in=100):
    out = set()
    for a, la, va in rows:
        if a % one_in:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(va, v)), i, label) for i, label, v in rows if i != a))
        for p, pid, _ in [x for x in scored if x[2] == la][:5]:
            fit = [(s, i) for s, i, label in scored if label != la and 30 * -p <= 100 * -s <= 90 * -p][:10]
            out |= {(a, pid, k, i, -p, -s) for k, (s, i) in enumerate(fit, 1)}
    return out


def mined(df):
    rows = [tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def usable(rows):
    fine = [(i, label, v) for i, label, v in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    return [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in fine]


def test_query_12_is_that_of_plain_loops(spark):
    rows = usable([(r.vec_id, r.label, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()])
    rows = [(i, (label + 1) % 10 if i % 7 == 0 else label, v) for i, label, v in rows]
    assert mined(negatives.op12(spark, SF)) == hard(rows) != set()


@pytest.mark.parametrize("sent", [500, 1 << 20])
def test_negatives_of_odd_rows(spark, sent, monkeypatch):
    monkeypatch.setattr(negatives, "TILE_BYTES", 2000)
    r = random.Random(9)
    vector = lambda: [round(r.gauss(0.4, 0.3), 3) for _ in range(9)]
    same = vector()
    rows = [(i, r.randrange(3), vector()) for i in range(0, 400)] + [(i, i % 2, same) for i in range(1000, 1100)]  # a third is tied
    rows += [(500, None, vector()), (600, 1, None), (700, 1, [0.1, None]), (701, 1, [float("nan")] * 9), (800, 0, [float("inf")] * 9), (None, 1, vector()), (900, 1, []), (901, 2, [0.5]), (-300, 2, vector())]
    rows += rows[5:25]  # repeated rows count once
    df = spark.createDataFrame([(i, label, v, "clash") for i, label, v in rows], "vec_id long, label int, embedding array<float>, score string")
    as_float = [(i, label, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, label, v in rows]
    once = list({(i, label, tuple(v)) for i, label, v in usable(as_float)})
    assert mined(negatives.mine(negatives.usable(df.repartition(5)), Scratch(spark, "t"), sent=sent)) == hard(once)
    assert mined(negatives.mine(negatives.usable(df.limit(0)), Scratch(spark, "t"))) == set()
