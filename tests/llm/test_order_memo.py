"""Training order beside a plain version, at any split of the input; the memory of the piece encoder."""

import random

import numpy as np
import pytest

from cellweave.llm import training_order, unigram
from cellweave.llm._shared import Scratch

MASK = (1 << 64) - 1


def mixed(x):
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> shift) * times & MASK
    return x ^ x >> 31


def slot(i, n, key):
    half = max(1, ((max(2, n) - 1).bit_length() + 1) // 2)
    while True:
        left, right = i >> half, i & (1 << half) - 1
        for k in range(1, training_order.ROUNDS + 1):
            left, right = right, left ^ mixed(right + mixed((key + k * 0x9E3779B97F4A7C15) & MASK) & MASK) & (1 << half) - 1
        i = left << half | right
        if i < n:
            return i


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 1000])
def test_permutation_is_that_of_plain_integers(n):
    for key in (0, 7, 20_240_601):
        assert training_order.permute(np.arange(n), n, key).tolist() == [slot(i, n, key) for i in range(n)]


def test_slots_do_not_depend_on_splits(spark, tmp_path):
    r = random.Random(21)
    texts = {i: " ".join(r.choices(["tide", "harbour", "gull", "rope", "été", "漁"], k=r.randrange(0, 90))) for i in range(600)}
    path = f"file://{tmp_path}/docs"
    rows = spark.createDataFrame([(i, t or None) for i, t in texts.items()], "doc_id long, text string").repartition(3, "doc_id")
    rows.write.option("parquet.block.size", 4096).option("parquet.page.size", 1024).option("parquet.page.size.row.check.min", 10).option("parquet.block.size.row.check.min", 10).parquet(path)
    stored = spark.read.parquet(path).coalesce(1)  # one task reads files whole, by name below
    names = sorted({f for f in stored.inputFiles()})
    encode = training_order._encoder(training_order.VOCABULARY).encode_ordinary
    numbered = []
    for name in names:
        for x in spark.read.parquet(name).collect():
            if x.text:
                numbered += [(x.doc_id, k) for k in range(-(-(len(encode(x.text)) + 1) // 16))]
    expected = {(*p, slot(i, len(numbered), 20_240_601)) for i, p in enumerate(numbered)}
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(k) for k in keys]
    try:
        for size, cost in (("128m", "4m"), ("64k", "1"), ("8k", "1"), ("4k", "4m")):
            spark.conf.set(keys[0], size), spark.conf.set(keys[1], cost)
            docs = spark.read.parquet(*random.Random(size).sample(names, len(names)))
            got = training_order.training_order(docs, Scratch(spark, "t"), length=16, per_shard=64).select("doc_id", "sequence", "slot").collect()
            assert {tuple(x) for x in got} == expected, (size, docs.rdd.getNumPartitions())
        assert docs.rdd.getNumPartitions() > 3
    finally:
        for k, v in zip(keys, before):
            spark.conf.set(k, v)


def test_the_encoders_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(unigram, "MEMO", 20_000)
    coder, r = unigram.Encoder(unigram.Pieces.load()), random.Random(4)
    plain = lambda t: unigram.Encoder(coder_pieces).encode(t)
    coder_pieces = unigram.Pieces.load()
    for _ in range(40):
        text = "".join(chr(r.randrange(0x4E00, 0x9FA0)) for _ in range(500)) + " " + " ".join("".join(r.choices("abcdefg", k=r.randrange(1, 9))) for _ in range(60))
        ids = coder.encode(text)
        assert coder.decode(ids) == text
        for memo in (coder.young, coder.old):
            assert sum(200 + 4 * len(k) + 8 * len(v) for k, v in memo.items()) <= 20_000 + 1_000 and all(len(k) <= unigram.LONGEST for k in memo)
    assert plain(text) == ids


def test_ties_go_to_the_longer_last_piece():
    pieces = unigram.Pieces.load()
    coder = unigram.Encoder(pieces)
    whole = {b: i for i, b in enumerate(pieces.bytes_of)}
    a, bc, ab, c = (whole[x] for x in (b"a", b"bc", b"ab", b"c"))
    coder.scores = [-100.0] * len(coder.scores)
    for i in (a, bc, ab, c):
        coder.scores[i] = -1.0
    assert coder.solve(b"abc") == [a, bc]
