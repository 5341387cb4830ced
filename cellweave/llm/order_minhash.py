"""Operator 3. Order MinHash fingerprints, sensitive to edit distance.

A text's k-mers are numbered by occurrence, so that repeated ones are distinct items. Each of ``HASHES``
hash functions selects the ``PICKED`` minimal items, puts them back into text order and hashes that tuple.
The likeness of two fingerprints is the share of equal signatures: it falls with edits and with reordering,
where plain MinHash sees only the set of k-mers.

A text of fewer than ``K`` code points is one k-mer, an empty or null text none (its fingerprint is that of
the empty tuple). Long texts are fingerprinted whole, by stretches of ``_COLUMNS`` items. ``edited_texts`` pairs
each document with the next one in descending doc_id order (null ids last; equal ids in the order of their texts'
SHA-256, so that their rows can be dealt to many tasks); of equal rows each is followed by the next, and the last by
the row after them. One document alone is its own next; an empty table gives no rows. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.llm._shared import table
from cellweave.llm._text import mix

K = 8
HASHES = 32
PICKED = 2
#: bytes of text that a range of documents has about, for pairing neighbours
RANGE_BYTES = 16 << 20
#: ranges at most; past that they get longer, and are still read as streams
RANGES = 100_000
#: a task remembers so many rows, and so many bytes of repeated ones, before it sends its repeats
SEEN, SEEN_BYTES = 50_000, 32 << 20
#: equal rows that travel as one
TOGETHER = 1000
#: the kinds of rows in a range: its own, the next range's first, and repeats, which are settled wherever they are
_OWN, _LEAD, _REPEAT = 0, 1, 2
_SALT = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_SALT32 = (_SALT >> np.uint64(32)).astype(np.uint32)
_ODD32 = (mix(_SALT) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_CHAR = mix(np.arange(1, K + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
_COLUMNS = 8192


def _items(text: str) -> np.ndarray:
    """Hashes of the occurrence-numbered k-mers, in text order."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if not len(c):
        return c
    if len(c) < K:
        c = np.concatenate([c, np.full(K - len(c), 0xFFFFFFFF, np.uint64)])
    n = len(c) - K + 1
    h = c[:n] * _CHAR[0]
    for d in range(1, K):
        h += c[d : n + d] * _CHAR[d]
    h = mix(h)
    # occurrence numbers: the rank among equal k-mers, earlier ones first
    order = np.argsort(h)
    s = h[order]
    same = s[1:] == s[:-1]
    if same.any():
        many = np.zeros(n, bool)
        many[1:] = same
        many[:-1] |= same
        place = np.sort(order[many])
        place = place[np.argsort(h[place], kind="stable")]
        s = h[place]
        start = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
        number = np.arange(len(s)) - np.repeat(start, np.diff(np.append(start, len(s))))
        h[place] = np.where(number > 0, mix(s + number.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)), s)
    return h


def signatures(text: str | None) -> np.ndarray:
    """``HASHES`` 32-bit signatures."""
    x = _items(text or "")
    n = len(x)
    if n <= PICKED:
        picked = np.tile(x, (HASHES, 1))
    else:
        places, values = [], []
        h = (x >> np.uint64(32)).astype(np.uint32)
        # values under the bound hold the minima nearly always; else the bound is dropped
        bound = np.uint32(min((1 << 32) - 1, (1 << 32) * PICKED * 6 // n))
        for at in range(0, n, _COLUMNS):
            y = (h[None, at : at + _COLUMNS] ^ _SALT32[:, None]) * _ODD32[:, None]
            flat = np.flatnonzero(y < bound)
            places.append(np.stack([flat // y.shape[1], flat % y.shape[1] + at]))
            values.append(y.ravel()[flat])
        (row, col), value = np.concatenate(places, axis=1), np.concatenate(values)
        by = np.lexsort((col, value, row))
        row, col = row[by], col[by]
        first = np.searchsorted(row, np.arange(HASHES))
        each = np.diff(np.append(first, len(row)))
        chosen = np.empty((HASHES, PICKED), np.int64)
        full = each >= PICKED
        for j in range(PICKED):
            chosen[full, j] = col[first[full] + j]
        for r in np.flatnonzero(~full):
            chosen[r] = np.argsort((h ^ _SALT32[r]) * _ODD32[r], kind="stable")[:PICKED]
        picked = x[np.sort(chosen, axis=1)]
    total = _SALT.copy()
    for j in range(picked.shape[1]):
        total = mix(total + picked[:, j] * _CHAR[j])
    return (total >> np.uint64(32)).astype(np.uint32)


def fingerprint(text: str | None) -> str:
    return signatures(text).astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.mean(a == b))


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the fingerprint of a text column; a column of that name is replaced."""
    docs = docs.drop("fingerprint")

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(map(fingerprint, b.column(text).to_pylist()), pa.string())], names=[*b.schema.names, "fingerprint"])

    return docs.mapInArrow(run, T.StructType([*docs.schema]).add("fingerprint", "string"))


def edit(text: str, following: str) -> str:
    """The last third of a text's code points replaced by as many first ones of the following text, or all of it."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


class _Ranges:
    """Ranges of (id descending, nulls last; key). An id that several cuts fall on is hot: its rows are split evenly by key."""

    def __init__(self, cuts: list[float], without_id: int):
        # ids travel as their complement, which turns their order round; 64-bit ends have no double of their own
        self.cuts, self.without_id = np.clip(np.sort(np.array(cuts, np.float64)), -(2.0**63), 2.0**63 - 1024).astype(np.int64), without_id

    def __len__(self) -> int:
        return len(self.cuts) + 1 + self.without_id

    def of(self, nameless: np.ndarray, turned: np.ndarray, part: np.ndarray) -> np.ndarray:
        """``part``: the first 31 bits of the keys."""
        first, last = np.searchsorted(self.cuts, turned, "left"), np.searchsorted(self.cuts, turned, "right")
        named = np.where(last > first, first + 1 + ((part * (last - first)) >> 31), first)
        return np.where(nameless, len(self.cuts) + 1 + ((part * self.without_id) >> 31), named).astype(np.int32)


def _neighbours(docs: DataFrame) -> tuple[DataFrame, int]:
    """Rows by range, each range followed by a copy of the next range's first row; the number of ranges.

    Ranges are cut at quantiles of doc_id, so the driver holds one number for each; only the texts of the
    rows at a cut are read twice. Equal rows of a task leave it as one row, and their repeats, each of which
    is followed by its like, as bundles that are dealt to all ranges.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = ids.select(F.col("id").isNull().alias("nameless"), F.coalesce(F.bitwise_not("id"), F.lit(0)).alias("turned"), "text", F.unhex(F.sha2("text", 256)).alias("key"))
    ids = ids.withColumn("part", F.shiftright(F.conv(F.hex(F.substring("key", 1, 4)), 16, 10).cast("long"), 1))
    size = F.octet_length("text")
    named, nameless = ids.agg(F.sum(F.when(~F.col("nameless"), size)), F.sum(F.when(F.col("nameless"), size))).first()
    count = lambda n: max(1, min(int((n or 0) // RANGE_BYTES) + 1, RANGES))
    n = count(named)
    cuts = ids.where("not nameless").approxQuantile("turned", [k / n for k in range(1, n)], 0.1 / n) if n > 1 else []
    ranges = _Ranges(cuts, count(nameless))
    held = docs.sparkSession.sparkContext.broadcast(ranges)
    place = ["nameless", "turned", "key"]

    def buckets(b: pa.RecordBatch) -> np.ndarray:
        return held.value.of(b.column("nameless").to_numpy(zero_copy_only=False), b.column("turned").to_numpy(), b.column("part").to_numpy())

    def rows(columns: list, kind: int, count: pa.Array, bucket: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*columns, pa.array(bucket, pa.int32()), pa.array(np.full(len(bucket), kind, np.int32)), count], names=[*place, "text", "bucket", "kind", "count"])

    def deal(batches) -> Iterator[pa.RecordBatch]:
        again: dict[tuple, list] = {}
        seen: set[tuple] = set()
        size = 0

        def repeats() -> Iterator[pa.RecordBatch]:
            for (row, key), (n, part, text) in again.items():
                each = [min(TOGETHER, n - at) for at in range(0, n, TOGETHER)]
                full = lambda v, kind: pa.array([v] * len(each), kind)
                columns = [full(row is None, pa.bool_()), full(row or 0, pa.int64()), full(key, pa.binary()), full(text, pa.string())]
                yield rows(columns, _REPEAT, pa.array(each, pa.int64()), (part + np.arange(len(each))) % len(held.value))

        for b in batches:
            fresh = []
            nobody, turned, keys, texts = (b.column(c) for c in (*place, "text"))
            for i, own in enumerate(zip((None if x else t for x, t in zip(nobody.to_pylist(), turned.to_pylist())), keys.to_pylist())):
                if own not in seen:
                    seen.add(own)
                    fresh.append(i)
                elif own in again:
                    again[own][0] += 1
                else:
                    again[own] = [1, b.column("part")[i].as_py(), texts[i].as_py()]
                    size += 4 * len(again[own][2])
            to = buckets(b)
            if len(fresh) < b.num_rows:
                b, to = b.take(pa.array(fresh, pa.int64())), to[fresh]
            yield rows([b.column(c) for c in (*place, "text")], _OWN, pa.array(np.ones(len(to), np.int64)), to)
            if len(seen) > SEEN or size > SEEN_BYTES:
                yield from repeats()
                again, seen, size = {}, set(), 0
        yield from repeats()

    def numbered(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in place), pa.array(buckets(b))], names=[*place, "bucket"])

    # the first row of each range leads the range before
    firsts = ids.select(*place, "part").mapInArrow(numbered, "nameless boolean, turned long, key binary, bucket int").groupBy("bucket").agg(F.min(F.struct(*place)).alias("first"))
    heads = sorted(firsts.select("bucket", "first.*").collect())
    to = [(h.nameless, h.turned, bytes(h.key), heads[k - 1].bucket) for k, h in enumerate(heads)]
    lead = docs.sparkSession.createDataFrame(to, "nameless boolean, turned long, key binary, bucket int")
    lead = ids.join(F.broadcast(lead), place).groupBy(*place, "bucket").agg(F.min("text").alias("text"))
    lead = lead.select(*place, "text", "bucket", F.lit(_LEAD).alias("kind"), F.lit(1).cast("long").alias("count"))
    return ids.mapInArrow(deal, "nameless boolean, turned long, key binary, text string, bucket int, kind int, count long").union(lead), len(ranges)


def edited_texts(docs: DataFrame) -> DataFrame:
    """The rows of op3: each text's fingerprint beside those of its edited text and of the next document."""
    rows, n = _neighbours(docs)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def pair(doc_id: int | None, text: str, own: np.ndarray, after: str, following: np.ndarray) -> tuple:
        edited = edit(text, after)
        new = signatures(edited)
        return doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), own.astype(">u4").tobytes().hex(), new.astype(">u4").tobytes().hex(), likeness(own, new), likeness(own, following)

    def run(batches) -> Iterator[pa.RecordBatch]:
        last, out = None, []
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                b = batch.slice(at, 64)
                for bucket, kind, nameless, turned, text, count in zip(*(b.column(c).to_pylist() for c in ("bucket", "kind", "nameless", "turned", "text", "count"))):
                    doc_id = None if nameless else ~turned
                    own = signatures(text)
                    if kind == _REPEAT:
                        out += [pair(doc_id, text, own, text, own)] * count
                    elif last is not None and last[0] == bucket:
                        out.append(pair(*last[1:], text, own))
                    last = (bucket, doc_id, text, own) if kind == _OWN else None
                if len(out) >= 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    laid = rows.repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket", "kind", "turned", "key")
    return laid.select("bucket", "kind", "nameless", "turned", "text", "count").mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_texts(table(spark, sf_dir, "documents"))
