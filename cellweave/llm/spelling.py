"""Operator 11. Spelling variants: near words by blocked Gram matrices of letter counts.

Words are counted over all texts. One insertion, deletion or replacement changes a word's letter counts by a
squared distance of at most two, and touches at most two of four parts of the alphabet; so two near words agree
in the counts of some two parts. Words are dealt to blocks by those counts, once for each two parts, and blocks
to tiles of about ``TILE`` words. A NumPy product of the letter counts of two tiles gives all squared distances
at once; pairs at most two apart in lengths that are equal or adjacent are kept, and each is verified as one edit.
A pair that meets in several blocks counts in the first. No word is compared outside its blocks, and blocks of any
size are cut into tiles that meet pairwise in different tasks.

Letters are A-Z, a-z and U+00C0 to U+00FF; only A-Z are lower-cased. The latter letters share six counts, which
makes distances smaller and so loses no pair. A null id is written as nothing; null and empty texts have no words,
an empty table gives no rows, a text of any length is read whole, repeated rows count each time. Of near words with
equal counts the smallest in code-point order is the form. Columns other than the id and the text aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm._shared import Scratch, table

RUN = r"[A-Za-z\x{00C0}-\x{00FF}]++"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: least code points of a word, and least occurrences
LEAST, TWICE = 7, 2
#: a run with one checksum in so many loses a code point
NOISE = 31
#: a word's form is so many times as frequent
TIMES = 10
#: words of a tile, about
TILE = 2048
#: up to so many words meet as a whole, more by adjacent lengths
WHOLE = 256
LETTERS, PARTS = 32, 4
PAIRS = list(combinations(range(PARTS), 2))
#: what the letters from U+00C0 on are counted as: six names that no lower-case word holds
_HIGH, _FOLDED = "".join(map(chr, range(0xC0, 0x100))), "".join("ABCDEF"[c % 6] for c in range(0xC0, 0x100))
_DIM = np.zeros(256, np.int64)
_DIM[97:123] = np.arange(26)
_DIM[0xC0:] = 26 + np.arange(0xC0, 0x100) % 6
_PART = np.arange(LETTERS) % PARTS


def words(docs: DataFrame, noise: int | None = NOISE, least: int = LEAST, twice: int = TWICE) -> DataFrame:
    """``(word, n)``: words of ``least`` code points and more that stand ``twice`` and more in all texts together.

    With ``noise``, of each run whose checksum with its doc_id it divides, one code point is deleted.
    """
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= least).withColumn("run", F.translate("run", UPPER, LOWER))
    word = F.col("run")
    if noise:
        h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
        at = (h % F.length("run")).cast("int")
        word = F.when(h % noise == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(word)
    return runs.select(word.alias("word")).where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= twice)


def tiles(vocabulary: DataFrame, tile: int = TILE) -> DataFrame:
    """``(pair, left, right)``: arrays of (word, n) to be compared; right is null where left meets itself.

    ``pair`` is the number of the two parts whose letter counts all the words share.
    """
    folded = F.translate("word", _HIGH, _FOLDED)
    letters = [LOWER[i] if i < 26 else "ABCDEF"[i - 26] for i in range(LETTERS)]
    keys = []
    for k, pair in enumerate(PAIRS):
        others = "".join(c for i, c in enumerate(letters) if _PART[i] not in pair)
        held = F.array_join(F.array_sort(F.split(F.translate(folded, others, ""), "")), "")
        keys.append(F.struct(F.lit(k).cast("byte").alias("pair"), F.xxhash64(F.lit(k), held).alias("key")))
    keyed = vocabulary.select("word", "n", F.explode(F.array(*keys)).alias("at")).select("at.pair", "at.key", "word", "n")
    # blocks of more than a tile, at most one in so many words: each of their words goes to one of the tiles by its hash
    large = keyed.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > tile).select("key", F.ceil(F.col("size") / tile).cast("int").alias("m"))
    laid = keyed.join(large, "key", "left").withColumn("m", F.coalesce("m", F.lit(1)))
    laid = laid.withColumn("t", F.pmod(F.xxhash64("word"), F.col("m").cast("long")).cast("int"))
    return laid.groupBy("pair", "key", "m", "t").agg(F.collect_list(F.struct("word", "n")).alias("words"))


def meetings(tiled: DataFrame) -> DataFrame:
    """Each tile with itself, and of one block each two tiles."""
    own = tiled.where(F.size("words") > 1).select("pair", F.col("words").alias("left"), F.lit(None).cast(tiled.schema["words"].dataType).alias("right"))
    many = tiled.where("m > 1")
    ask = many.select("pair", "key", F.explode(F.sequence("t", F.col("m") - 1)).alias("o"), "t", F.col("words").alias("left")).where("o > t")
    other = many.select(F.col("pair").alias("p"), F.col("key").alias("k"), F.col("t").alias("o"), F.col("words").alias("right"))
    both = ask.join(other, (F.col("pair") == F.col("p")) & (F.col("key") == F.col("k")) & (ask["o"] == other["o"]))
    return own.unionByName(both.select("pair", "left", "right"))


class Tile:
    """Words as rows of letters (code points up to U+00FF, so one byte each), their lengths and letter counts."""

    def __init__(self, words: pa.Array):
        self.words = words
        size = len(words)
        self.length = pc.utf8_length(words).to_numpy().astype(np.int64)
        flat = np.frombuffer("".join(words.to_pylist()).encode("latin-1"), np.uint8)
        row = np.repeat(np.arange(size), self.length)
        start = np.cumsum(self.length) - self.length
        self.text = np.zeros((size, int(self.length.max(initial=0)) + 2), np.uint8)
        self.text[row, np.arange(len(flat)) - start[row]] = flat
        self.counts = np.bincount(row * LETTERS + _DIM[flat], minlength=size * LETTERS).reshape(size, LETTERS).astype(np.float32)
        half = (self.counts * self.counts).sum(1, keepdims=True) / 2
        one = np.ones_like(half)
        # one product then gives x.y - |x|^2/2 - |y|^2/2, which is minus half the squared distance
        self.as_left, self.as_right = np.hstack([self.counts, -half, one]), np.hstack([self.counts, one, -half])


def _blocks(a: Tile, b: Tile) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of both that are of equal or adjacent lengths."""
    if max(len(a.length), len(b.length)) <= WHOLE:
        yield np.arange(len(a.length)), np.arange(len(b.length))
        return
    for n in np.unique(a.length):
        x, y = np.flatnonzero(a.length == n), np.flatnonzero(np.abs(b.length - n) <= 1)
        if len(y):
            yield x, y


def _one_edit(x: np.ndarray, y: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """Whether rows x and y, of equal lengths or y ``longer`` by one, differ by exactly one edit. Rows end in zeros."""
    same = x == y
    replaced = ~longer & ((~same).sum(1) == 1)
    before = np.where(same.all(1), same.shape[1], same.argmin(1))
    moved = (x[:, :-1] == y[:, 1:])[:, ::-1]
    after = np.where(moved.all(1), moved.shape[1], moved.argmin(1))
    return replaced | longer & (before + after >= moved.shape[1])


def near(a: Tile, b: Tile, pair: int, own: bool) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a and of b that are one edit apart and whose first common block is that of ``pair``."""
    found = []
    width = max(a.text.shape[1], b.text.shape[1])
    texts = [np.pad(t.text, ((0, 0), (0, width - t.text.shape[1]))) for t in (a, b)]
    for x, y in _blocks(a, b):
        i, j = np.nonzero(a.as_left[x] @ b.as_right[y].T >= -1)
        i, j = x[i], y[j]
        keep = np.abs(a.length[i] - b.length[j]) <= 1
        keep &= (i < j) if own else True
        i, j = i[keep], j[keep]
        changed = a.counts[i] != b.counts[j]
        touched = np.stack([changed[:, _PART == p].any(1) for p in range(PARTS)], 1) if len(i) else np.zeros((0, PARTS), bool)
        first = np.stack([~touched[:, list(p)].any(1) for p in PAIRS], 1).argmax(1)
        i, j = i[first == pair], j[first == pair]
        swap = a.length[i] > b.length[j]
        s, t = texts[0][i], texts[1][j]
        s[swap], t[swap] = t[swap], s[swap]
        fine = _one_edit(s, t, a.length[i] != b.length[j])
        found.append((i[fine], j[fine]))
    return tuple(np.concatenate(z) if z else np.zeros(0, np.int64) for z in zip(*found)) if found else (np.zeros(0, np.int64),) * 2


def near_words(met: DataFrame) -> DataFrame:
    """``(word, near, near_n)``: each two near words, both ways, once."""

    def rows(column: pa.Array, k: int) -> tuple[pa.Array, pa.Array] | None:
        if not column[k].is_valid:
            return None
        held = column[k].values
        return held.field("word"), held.field("n")

    def run(batches):
        for batch in batches:
            left, right, pair = batch.column("left"), batch.column("right"), batch.column("pair").to_pylist()
            for k in range(batch.num_rows):
                words, n = rows(left, k)
                a = Tile(words)
                other = rows(right, k)
                b, m = (a, n) if other is None else (Tile(other[0]), other[1])
                i, j = near(a, b, pair[k], other is None)
                if len(i):
                    i, j = pa.array(i), pa.array(j)
                    x, y = words.take(i), b.words.take(j)
                    yield pa.RecordBatch.from_arrays([pa.concat_arrays([x, y]), pa.concat_arrays([y, x]), pa.concat_arrays([m.take(j), n.take(i)])], names=["word", "near", "near_n"])

    return met.mapInArrow(run, "word string, near string, near_n long")


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """``(word, root)`` of the words that have a form: where following forms ends.

    A form is ``TIMES`` as frequent as its word, so ways are as long as the largest count has digits at most;
    each round doubles the way.
    """
    top = forms.agg(F.max("form_n")).first()[0] or 1
    steps, done, held = len(str(top)), 1, forms.select("word", F.col("form").alias("root"))
    while done < steps:
        on = held.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        held = scratch.write(f"roots-{done}", held.join(on, "root", "left").select("word", F.coalesce("beyond", "root").alias("root")))
        done *= 2
    return held


def variants(docs: DataFrame, scratch: Scratch, noise: int | None = NOISE, tile: int = TILE) -> DataFrame:
    """``(word, n, n_near, form, form_n, root)`` of all words of ``docs(doc_id, text)``."""
    vocabulary = scratch.write("words", words(docs, noise))
    met = meetings(scratch.write("tiles", tiles(vocabulary, tile)))
    best = near_words(met).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    held = vocabulary.join(best, "word", "left")
    fits = -F.col("best.less") >= TIMES * F.col("n")
    held = scratch.write("forms", held.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n")))
    ends = roots(held.where("form is not null"), scratch)
    return held.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents").select("doc_id", "text"), Scratch(spark, "op11"))
