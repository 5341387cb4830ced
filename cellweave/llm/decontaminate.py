"""Operator 4. Benchmark decontamination by Wu-Manber search for word windows.

Texts and items are lower-cased (A-Z) and reduced to words of ASCII letters, digits and non-ASCII bytes,
with single spaces between them. Patterns are the items' windows of ``WINDOW`` words (an item of fewer
words is one window). A scan moves along a text by the shift of its last block of bytes; where the shift is
zero the suffix's bucket names the patterns to compare directly. Long and short patterns have tables of their
own, so that a short item does not shorten the shifts of all.

Patterns of up to ``GROUP_BYTES``, names included, go to every executor, and one scan without a shuffle judges
each text. More of them stay a Spark table: executors get a table of the shifts of hashed blocks (``SLOTS``
bytes) and a filter of suffix hashes (``Heads``), both of bounded size and made by aggregation. One scan finds the
places at which some pattern may stand; these meet the bucket of their suffix in a join, which compares
directly. Texts are read once either way. The filter is sparse up to some 50 million patterns; past that it
lets more places through, which the join removes.

Null and wordless texts and items have no words, hit nothing and aren't contaminated. Repeated documents
are separate rows; repeated items count once. Columns other than id and text aren't read. Windows of items with a
null item_id count in n_hit like all others; n_items and the digest hold no name of theirs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm._shared import KeyFilter, Scratch, table

WINDOW = 13
BLOCK = 4
#: a document is contaminated when at least one word in so many is hit
SHARE = 20
#: bytes of patterns, with their items' names, that go to every executor
GROUP_BYTES = 8 << 20
#: bytes of a block, and slots of hashed blocks, where patterns are more than that
WIDE_BLOCK = 8
SLOTS = 1 << 22
#: bytes of texts at possible places that a task holds
PIECES = 4 << 20
#: patterns of fewer bytes are searched apart
SHORT = 32

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def normal(text: bytes) -> bytes:
    """The words of a text, each after one space, with a space at the end."""
    return b" " + b" ".join(text.translate(_TABLE).split()) + b" "


def windows(text: bytes, size: int = WINDOW) -> set[bytes]:
    words = text.translate(_TABLE).split()
    return {b" " + b" ".join(words[i : i + size]) + b" " for i in range(max(1, len(words) - size + 1))} if words else set()


class WuManber:
    """Shift and suffix tables of some patterns (byte strings)."""

    def __init__(self, patterns: list[bytes]):
        self.least = min(map(len, patterns))
        self.block = min(BLOCK, self.least)
        self.default = self.least - self.block + 1
        self.shift: dict[bytes, int] = {}
        self.bucket: dict[bytes, list[tuple[bytes, int]]] = {}
        for k, p in enumerate(patterns):
            for end in range(self.block, self.least + 1):
                b = p[end - self.block : end]
                self.shift[b] = min(self.shift.get(b, self.default), self.least - end)
            # the suffix of the searched part, and a prefix that rules most of the bucket out
            self.bucket.setdefault(p[: self.least], []).append((p, k))

    def search(self, text: bytes) -> Iterator[tuple[int, int, int]]:
        """(start, end, pattern) of every occurrence."""
        shift, block, default, least, n = self.shift.get, self.block, self.default, self.least, len(text)
        end = least
        while end <= n:
            step = shift(text[end - block : end], default)
            if step:
                end += step
                continue
            at = end - least
            for p, k in self.bucket.get(text[at:end], ()):
                if text.startswith(p, at):
                    yield at, at + len(p), k
            end += 1


class Heads(KeyFilter):
    """A filter of 64 MB at most over the hashes of patterns' suffixes."""

    MAX_WORDS = 1 << 23


class Sieve:
    """Shifts of hashed blocks and a filter of suffixes: where a pattern may stand, never missing a place."""

    def __init__(self, least: int, shift: bytes, heads: KeyFilter):
        self.least, self.block, self.shift, self.heads = least, min(WIDE_BLOCK, least), shift, heads

    def places(self, text: bytes) -> list[tuple[int, int]]:
        """(start, suffix hash) of the places at which some pattern may stand."""
        shift, block, least, n = self.shift, self.block, self.least, len(text)
        at, heads, end = [], [], least
        while end <= n:
            step = shift[crc32(text[end - block : end]) & SLOTS - 1]
            if step:
                end += step
                continue
            # every pattern starts with a space
            if text[end - least] == 32:
                at.append(end - least)
                heads.append(xxhash.xxh64_intdigest(text[end - least : end], seed=42))
            end += 1
        if not at:
            return []
        keys = np.array(heads, np.uint64).view(np.int64)
        return [(at[k], int(keys[k])) for k in np.flatnonzero(self.heads.has(keys))]


_JUDGED = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _judged(doc_id: pa.Array, words: np.ndarray, spans: list[list[int]], items: list[list[str]]) -> pa.RecordBatch:
    """Counts and digests of rows whose spans and items may come from several scans."""
    hits, count, digest = [], [], []
    for s, names in zip(spans, items):
        end = n = 0
        for a, b in sorted(zip(s[::2], s[1::2])):
            n += max(0, b - max(a, end))
            end = max(end, b)
        own = sorted(set(names))
        hits.append(n)
        count.append(len(own))
        digest.append(hashlib.sha256(",".join(own).encode()).hexdigest())
    h = np.array(hits, np.int64)
    return pa.RecordBatch.from_arrays([doc_id, pa.array(words), pa.array(h), pa.array(count, pa.int64()), pa.array(digest, pa.string()), pa.array((h > 0) & (SHARE * h >= words))], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def _scan(docs: DataFrame, tables) -> DataFrame:
    """The verdict on each row, by tables that hold all patterns."""

    def run(batches):
        engines = [(WuManber(patterns), items) for patterns, items in tables.value]
        for batch in batches:
            words, spans, found = [], [], []
            for text in batch.column("text").cast(pa.large_binary()):
                clean = normal(text.as_py() or b"")
                hit, items = [], set()
                for engine, of in engines:
                    for a, b, k in engine.search(clean):
                        hit.append((a, b))
                        items.update(of[k])
                at, out, done = 0, [], 0
                for a, b in sorted(hit):
                    # words before a: spaces up to it; the running count moves forward only
                    done += clean.count(b" ", at, a)
                    at = a
                    out.extend((done, done + clean.count(b" ", a, b) - 1))
                words.append(clean.count(b" ") - 1 if len(clean) > 2 else 0)
                spans.append(out)
                found.append(list(items))
            yield _judged(batch.column("doc_id"), np.array(words, np.int64), spans, found)

    return docs.mapInArrow(run, _JUDGED)


def _places(docs: DataFrame, sieves, size: int) -> DataFrame:
    """Of each row its number of words, and in rows of their own the places at which some pattern may stand:
    the word's position, the suffix's hash, and the ``size`` words from there, which hold any pattern whole."""

    def run(batches):
        for batch in batches:
            rows, held = [], 0
            for r, text in enumerate(batch.column("text").cast(pa.large_binary())):
                clean = normal(text.as_py() or b"")
                rows.append((r, clean.count(b" ") - 1 if len(clean) > 2 else 0, None, None, None))
                found = sorted(p for sieve in sieves.value for p in sieve.places(clean))
                if not found:
                    continue
                spaces = np.flatnonzero(np.frombuffer(clean, np.uint8) == 32)
                word = np.searchsorted(spaces, [a for a, _ in found])
                ends = spaces[np.minimum(word + size, len(spaces) - 1)]
                for (a, head), w, e in zip(found, word.tolist(), ends.tolist()):
                    rows.append((r, None, w, head, clean[a : e + 1]))
                    held += e - a
                    if held > PIECES:
                        yield _laid_out(batch, rows)
                        rows, held = [], 0
            if rows:
                yield _laid_out(batch, rows)

    return docs.mapInArrow(run, "doc_id long, key long, n_words long, at long, head long, piece binary")


def _laid_out(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
    of, *columns = zip(*rows)
    of, kinds = pa.array(of, pa.int64()), [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([batch.column("doc_id").take(of), batch.column("key").take(of), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["doc_id", "key", "n_words", "at", "head", "piece"])


def _verdict(rows: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            yield _judged(b.column("doc_id"), b.column("n_words").to_numpy(), b.column("spans").to_pylist(), b.column("items").to_pylist())

    return rows.select("doc_id", "n_words", "spans", "items").mapInArrow(run, _JUDGED)


def _patterns(items: DataFrame, size: int) -> DataFrame:
    """``(p, n, items)``: each window, its number of words, and the names of the items that have it."""

    def run(batches):
        for batch in batches:
            for name, text in zip(batch.column("item_id"), batch.column("text").cast(pa.large_binary())):
                own = sorted(windows(text.as_py() or b"", size))
                for k in range(0, len(own), 4096):
                    p = own[k : k + 4096]
                    yield pa.RecordBatch.from_arrays([pa.array(p, pa.binary()), pa.array([x.count(b" ") - 1 for x in p], pa.int64()), pa.array([name.as_py()] * len(p), pa.string())], names=["p", "n", "item"])

    items = items.select(F.col("item_id").cast("string").alias("item_id"), "text")
    # a null name is not collected
    return items.mapInArrow(run, "p binary, n long, item string").groupBy("p", "n").agg(F.collect_set("item").alias("items"))


def _laid(held: list) -> list[tuple[list[bytes], list[list[str]]]]:
    """Patterns and their items, short ones apart."""
    parts = [[x for x in held if len(x[0]) < SHORT], [x for x in held if len(x[0]) >= SHORT]]
    return [([p for p, _ in x], [i for _, i in x]) for x in parts if x]


def _sieve(patterns: DataFrame, least: int) -> Sieve:
    """The sieve of patterns of at least so many bytes; ``SLOTS`` rows at most reach the driver."""
    block = min(WIDE_BLOCK, least)
    default = min(255, least - block + 1)

    def run(batches):
        table = bytearray([default]) * SLOTS
        for batch in batches:
            for p in batch.column("p"):
                p = p.as_py()
                for end in range(max(block, least - default + 1), least + 1):
                    slot = crc32(p[end - block : end]) & SLOTS - 1
                    table[slot] = min(table[slot], least - end)
        held = np.frombuffer(table, np.uint8)
        seen = np.flatnonzero(held < default)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(held[seen].astype(np.int16))], names=["slot", "shift"])

    found = patterns.select("p").mapInArrow(run, "slot int, shift short").groupBy("slot").agg(F.min("shift").alias("shift")).toArrow()
    table = np.full(SLOTS, default, np.uint8)
    table[found["slot"].to_numpy()] = found["shift"].to_numpy()
    heads = patterns.select("head").distinct()
    return Sieve(least, table.tobytes(), Heads.build(heads, "head", heads.count()))


def _joined(docs: DataFrame, patterns: DataFrame, scratch: Scratch, size: int) -> DataFrame:
    """The verdicts by a join of places and patterns."""
    short = F.length("p") < SHORT
    least = {bool(r.short): r.least for r in patterns.groupBy(short.alias("short")).agg(F.min(F.length("p")).alias("least")).collect()}
    head = F.when(short, F.xxhash64(F.substring("p", 1, least.get(True, 1)))).otherwise(F.xxhash64(F.substring("p", 1, least.get(False, 1))))
    patterns = scratch.write("heads", patterns.withColumn("head", head))
    sieves = [_sieve(patterns.where(short == is_short), n) for is_short, n in least.items()]
    places = scratch.write("places", _places(docs, docs.sparkSession.sparkContext.broadcast(sieves), size))
    whose = patterns.select("p", "n", "items", F.col("head").alias("of_head"))
    met = places.where("head is not null").join(whose, (F.col("head") == F.col("of_head")) & F.startswith("piece", "p"))
    hits = met.groupBy(F.col("doc_id").alias("hit_id"), F.col("key").alias("hit_key")).agg(F.flatten(F.collect_set(F.array(F.col("at"), F.col("at") + F.col("n")))).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    joined = places.where("n_words is not null").join(hits, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("key") == F.col("hit_key")), "left")
    empty = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>")).alias(c)
    return _verdict(joined.select("doc_id", "n_words", empty("spans", "long"), empty("items", "string")))


def contamination(docs: DataFrame, items: DataFrame, scratch: Scratch, size: int = WINDOW, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)`` for each row of ``docs(doc_id, text)``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("key"))
    patterns = scratch.write("patterns", _patterns(items, size))
    total = patterns.agg(F.sum(F.length("p") + F.length(F.concat_ws(",", "items")))).first()[0] or 0
    if total > group_bytes:
        return _joined(docs, patterns, scratch, size)
    held = [(bytes(r.p), list(r["items"])) for r in patterns.select("p", "items").collect()]
    return _scan(docs, docs.sparkSession.sparkContext.broadcast(_laid(held)))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Scratch(spark, "op4"))


def sql(docs: str = "documents") -> str:
    """The rows of ``docs`` in DuckDB's SQL."""
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
with iw as (select cast(item_id as varchar) as item, {words} as w from benchmark),
pos as (select item, w, unnest(range(1, greatest(1, len(w) - {WINDOW - 1}) + 1)) as i from iw where len(w) > 0),
pat as (select distinct item, array_to_string(w[i : i + {WINDOW - 1}], ' ') as p, least(len(w), {WINDOW}) as n from pos),
dw as (select row_number() over () as r, doc_id, {words} as w from {docs}),
dpos as (select r, w, unnest(range(1, len(w) + 1)) as i from dw where len(w) > 0),
lens as (select distinct n from pat),
hit as (select d.r, d.i, l.n, p.item from dpos d, lens l, pat p where d.i + l.n - 1 <= len(d.w) and p.n = l.n and array_to_string(d.w[d.i : d.i + l.n - 1], ' ') = p.p),
covered as (select r, count(distinct j) as n_hit from (select r, unnest(range(i, i + n)) as j from hit) group by r),
named as (select r, count(*) as n_items, sha256(string_agg(item, ',' order by item)) as items_sha256 from (select distinct r, item from hit where item is not null) group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       coalesce(items_sha256, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from dw left join covered using (r) left join named using (r)
"""


SQL = sql()
