"""Operator 5. Near-duplicate documents: a size-aware heavy-light join on word 5-shingles.

Two texts link when 100 * |A & B| >= 75 * |A | B|. Texts with equal sets are one node from the start.

*Light* sets (few shingles) are joined by enumerating subsets: two sets of n and m shingles link exactly
when they share a subset of the o = ceil(3 (n + m) / 7) shingles that the threshold asks for. *Heavy* sets are
joined by scanning inverted lists of their n - ceil(0.75 n) + 1 first shingles in one global order. Any order
is exact; the one taken puts frequent shingles last. The size up to which a set is light comes from the cost
of both ways on the sizes at hand.

Subsets and shingles are keys of one kind of list, dealt out once and read as streams. An entry carries its
set's size and a bound on what the set can share with another from there on, so most pairs of a list are ruled
out where they meet, exactly; parity bitmaps, exact too, rule out nearly all others. What is left joins sets to
candidate components. The members of a list first meet those that are next in size; lists that still reach
into several components are then compared in full, short ones member by member, long ones block by block.

Every link lies within a candidate component. There the whole sets meet block by block, each with each, once:
that counts every link and leaves links enough to span the true components.

Null texts and texts without words have an empty set and link with nothing. Repeated rows are rows of
their own with the same component. Columns other than the id and the text aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm._shared import KeyFilter, Scratch, table
from cellweave.llm._text import NOT_SPACE, mix, shingles, utf8, word_hashes
from cellweave.llm.components import components

#: words in a shingle
WORDS = 5
#: shingles whose frequency orders them last, at most; the rest keep the order of their hashes
ORDERED = 1 << 19
#: following members that each member of a list meets at first
NEXT = 3
#: a list of more members is compared block by block
SHORT = 64
#: members in a block of a long list
BLOCK = 4096
#: members, and shingles in all, of a block in which whole sets are compared
COUNT_BLOCK = 1024
COUNT_SHINGLES = 1 << 19
#: no set of more shingles is light, whatever the cost
LIGHT_MOST = 12
#: sets that a task knows again, shingles that it counts at once, and texts to a bucket of counts
REMEMBERED = 1 << 18
RUN = 1 << 20
BUCKET_TEXTS = 512
#: where the upper half of the hashes begins
UPPER = np.uint64(1 << 63)
_ROWS = 20_000


def overlap(n: int, m: int) -> int:
    """Shared shingles that sets of n and m need."""
    return -(-3 * (n + m) // 7)


def light_sizes(n: int) -> list[int]:
    """Sizes of the subsets that a light set of n enumerates, for all partners that it can have."""
    return sorted({overlap(n, m) for m in range(-(-3 * n // 4), 4 * n // 3 + 1)})


def light_boundary(sizes: dict[int, int], list_length: float) -> int:
    """The largest size at which enumerating subsets costs less than scanning lists of that length."""
    best, gain = 0, 0.0
    total = 0.0
    for n in range(1, LIGHT_MOST + 1):
        subsets = sum(comb(n, o) for o in light_sizes(n))
        lists = (n - -(-3 * n // 4) + 1) * (1 + list_length * (1 + n))
        total += sizes.get(n, 0) * (lists - subsets)
        if total > gain or sizes.get(n, 0) == 0 and total == gain and lists >= subsets:
            best, gain = n, total
    return best


def set_id(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64)) or 1


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            words, first = word_hashes(*utf8(part.column("text")), NOT_SPACE)
            yield part, shingles(words, first, WORDS)


class Unlike:
    """Lets each set that has shingles through once, as far as a task's bounded memory of them goes."""

    def __init__(self):
        self.seen: set[int] = set()

    def __call__(self, sets: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
        for s in sets:
            if len(s) and (k := set_id(s)) not in self.seen:
                if len(self.seen) >= REMEMBERED:
                    self.seen.clear()
                self.seen.add(k)
                yield k, s


def _rows(columns: list[tuple[str, pa.DataType]], chunks: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Tuples of equally long arrays as record batches of a bounded size; None stands for a column of nulls."""
    schema, held, n = pa.schema(columns), [], 0

    def flush() -> pa.RecordBatch:
        cols = []
        for x, (_, kind) in zip(zip(*held), columns):
            parts = [pa.nulls(len(h[0]), kind) if y is None else pa.array(y, kind) for y, h in zip(x, held)]
            cols.append(pa.concat_arrays(parts))
        return pa.RecordBatch.from_arrays(cols, schema=schema)

    for c in chunks:
        held.append(c)
        n += len(c[0])
        if n >= _ROWS:
            yield flush()
            held, n = [], 0
    if held:
        yield flush()


def bitmap(s: np.ndarray) -> bytes:
    """Parities of the set's shingles by bin, with two bins and more to a shingle; folded to one length, two
    bitmaps differ in no more bits than their sets in shingles."""
    bits = max(64, 1 << (2 * len(s) - 1).bit_length())
    return np.packbits((np.bincount((s >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1).astype(np.uint8)).tobytes()


class Bitmaps:
    """Bitmaps of several lengths, compared many at once."""

    def __init__(self, column: pa.ChunkedArray | pa.Array):
        values = column.to_pylist()
        size = np.array([len(v) for v in values], np.int64)
        self.size, self.at, self.of = size, np.zeros(len(values), np.int64), {}
        for k in np.unique(size).tolist():
            own = np.flatnonzero(size == k)
            self.at[own] = np.arange(len(own))
            self.of[k] = np.frombuffer(b"".join([values[i] for i in own]), np.uint64).reshape(len(own), -1)

    def apart(self, i: np.ndarray, other: Bitmaps, j: np.ndarray) -> np.ndarray:
        """The differing bits of bitmap i[k] here and j[k] there."""
        out, pair = np.zeros(len(i), np.int64), self.size[i] << 32 | other.size[j]
        for p in np.unique(pair).tolist():
            here = np.flatnonzero(pair == p)
            x, y = self.of[p >> 32], other.of[p & 0xFFFFFFFF]
            for at in range(0, len(here), 4096):
                k = here[at : at + 4096]
                a, b = x[self.at[i[k]]], y[other.at[j[k]]]
                while a.shape[1] != b.shape[1]:
                    # the bins of the longer one meet again
                    if a.shape[1] > b.shape[1]:
                        a = a[:, : a.shape[1] // 2] ^ a[:, a.shape[1] // 2 :]
                    else:
                        b = b[:, : b.shape[1] // 2] ^ b[:, b.shape[1] // 2 :]
                out[k] = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
        return out


def describe(docs: DataFrame, bits: int) -> DataFrame:
    """Two kinds of rows from one pass: ``(doc_id, set_id, n, bitmap)`` of every text (set_id null for an empty
    set), and ``(bucket, codes, counts)``: how many sets hold each shingle of the lower half of the hashes, in
    runs of many sets, by the bucket of the hash (its first ``bits`` bits)."""
    shift, edges = np.uint64(31 - bits), np.arange(1 << bits, dtype=np.uint64) << np.uint64(32)

    def run(batches):
        unlike, held, n = Unlike(), [], 0

        def counted():
            code, count = np.unique(np.concatenate(held) >> shift, return_counts=True)
            ends = np.append(np.searchsorted(code, edges), len(code))
            some = np.flatnonzero(np.diff(ends)).tolist()
            low = code.astype(np.uint32)
            parts = [(low[ends[b] : ends[b + 1]].tobytes(), count[ends[b] : ends[b + 1]].astype(np.uint32).tobytes()) for b in some]
            return None, None, None, None, some, [c for c, _ in parts], [c for _, c in parts]

        def chunks():
            nonlocal held, n
            for part, sets in _sets(batches):
                ids = [set_id(s) if len(s) else None for s in sets]
                yield part.column("doc_id").to_pylist(), ids, [len(s) for s in sets], [bitmap(s) if len(s) else None for s in sets], None, None, None
                for _, s in unlike(sets):
                    lower = s[: np.searchsorted(s, UPPER)]
                    held.append(lower)
                    n += len(lower)
                if n >= RUN:
                    yield counted()
                    held, n = [], 0
            if n:
                yield counted()

        kinds = [("doc_id", pa.int64()), ("set_id", pa.int64()), ("n", pa.int32()), ("bitmap", pa.binary()), ("bucket", pa.int32()), ("codes", pa.binary()), ("counts", pa.binary())]
        for batch in _rows(kinds, ((c[0] if c[0] is not None else [None] * len(c[4]), *c[1:]) for c in chunks())):
            yield batch

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, set_id long, n int, bitmap binary, bucket int, codes binary, counts binary")


def frequent(runs: DataFrame) -> DataFrame:
    """``(code, c)``: the shingles that more than two sets hold, by bucket of the hash."""

    def count(t: pa.Table) -> pa.Table:
        code, c = (np.frombuffer(b"".join(t.column(x).to_pylist()), np.uint32) for x in ("codes", "counts"))
        code, at = np.unique(code, return_inverse=True)
        c = np.bincount(at, c).astype(np.int64)
        ok = c > 2
        return pa.table({"code": (np.int64(t.column("bucket")[0].as_py()) << 32) + code[ok].astype(np.int64), "c": c[ok]})

    return runs.groupBy("bucket").applyInArrow(count, "code long, c long")


class Order:
    """The global order of shingles: the lower half of the hashes, then the frequent ones of it by frequency, then the upper half."""

    def __init__(self, code: np.ndarray, count: np.ndarray, bits: int):
        by = np.argsort(code)
        self.code, self.level, self.shift = code[by].astype(np.uint64), np.floor(np.log2(np.maximum(count[by], 1)) * 8).astype(np.int16), np.uint64(31 - bits)

    def level_of(self, s: np.ndarray) -> np.ndarray:
        """The level of frequent shingles, -1 for others."""
        if not len(self.code):
            return np.full(len(s), -1, np.int16)
        code = s >> self.shift
        at = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
        return np.where(self.code[at] == code, self.level[at], -1)

    def prefix(self, s: np.ndarray) -> np.ndarray:
        """The first shingles of a sorted set, in order: as many as its linking partners can't all lack."""
        k = len(s) - -(-3 * len(s) // 4) + 1
        half = int(np.searchsorted(s, UPPER))
        for take in (k + k // 4 + 8, half):
            head = s[: min(take, half)]
            level = self.level_of(head)
            rare = head[level < 0]
            if len(rare) >= k:
                return rare[:k]
        often = level >= 0
        return np.concatenate([rare, head[often][np.argsort(level[often], kind="stable")], s[half:]])[:k]


def entries(docs: DataFrame, order, most: int) -> DataFrame:
    """``(key, meta, set_id)``: what sets are listed under, meta being size << 32 | bound.

    Sets that can have a partner of more than ``most`` shingles stand under their prefix, those of up to ``most``
    under their hashed subsets. Two sets listed under the first key that they share have no more shingles in
    common than the lesser of their bounds.
    """

    def run(batches):
        unlike = Unlike()

        def chunks():
            for _, sets in _sets(batches):
                for k, s in unlike(sets):
                    n = len(s)
                    if 4 * n // 3 > most:
                        p = order.value.prefix(s).view(np.int64)
                        yield p, (n << 32) + n - np.arange(len(p)), np.full(len(p), k, np.int64)
                    if n <= most:
                        for o in light_sizes(n):
                            part = mix(mix(np.array(list(combinations(s.tolist(), o)), np.uint64)).sum(axis=1) + np.uint64(o)).view(np.int64)
                            yield part, np.full(len(part), n << 32 | o, np.int64), np.full(len(part), k, np.int64)

        yield from _rows([("key", pa.int64()), ("meta", pa.int64()), ("set_id", pa.int64())], chunks())

    return docs.select("text").mapInArrow(run, "key long, meta long, set_id long")


def _can(meta: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether sizes and bounds allow listed sets i[k] and j[k] to link."""
    n, bound = meta >> 32, meta & 0xFFFFFFFF
    return 7 * np.minimum(bound[i], bound[j]) >= 3 * (n[i] + n[j])


def _pairs(k: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pair once, the lesser id first."""
    both = np.unique(np.stack([np.minimum(k[i], k[j]), np.maximum(k[i], k[j])], axis=1), axis=0) if len(i) else np.zeros((0, 2), np.int64)
    return both[:, 0], both[:, 1]


def _near_in_list(key: np.ndarray, gaps: range) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, i + gap) of one list, gap by gap; ``key`` is sorted."""
    for gap in gaps:
        i = np.flatnonzero(key[gap:] == key[:-gap]) if gap < len(key) else ()
        if not len(i):
            return
        yield i, i + gap


def lists(listed: DataFrame) -> DataFrame:
    """``(key, a, b)``: pairs of sets a and b with a null key, and members a with meta b of the lists under a key.

    Members of a list meet their ``NEXT`` following ones in order of size. Of lists that this doesn't exhaust
    those members are kept that can link with others; lists are read as streams, and long ones never held whole.
    """

    def found(key, meta, k, told: int, long_key: int | None):
        """``told`` first rows were met before; the list ``long_key`` is long whatever of it is here."""
        twin = np.zeros(len(key), bool)
        twin[1:] = key[1:] == key[:-1]
        twin[:-1] |= twin[1:]
        keep = np.flatnonzero(twin)
        told = int(np.searchsorted(keep, told))
        key, meta, k = key[keep], meta[keep], k[keep]
        if not len(key):
            return
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        length = np.repeat(np.diff(np.append(first, len(key))), np.diff(np.append(first, len(key))))
        if long_key is not None:
            length[key == long_key] = SHORT + NEXT + 2
        pair = [(i[ok], j[ok]) for i, j in _near_in_list(key, range(1, NEXT + 1)) if (ok := _can(meta, i, j) & (j >= told)).any()]
        if pair:
            a, b = _pairs(k, *map(np.concatenate, zip(*pair)))
            yield None, a, b
        open_ = (length > SHORT) & (length > NEXT + 1)
        some = np.flatnonzero((length > NEXT + 1) & ~open_)
        for i, j in _near_in_list(key[some], range(NEXT + 1, SHORT)):
            i, j = some[i], some[j]
            ok = _can(meta, i, j)
            open_[i[ok]] = open_[j[ok]] = True
        open_[:told] = False
        if open_.any():
            yield key[open_], k[open_], meta[open_]

    def run(batches):
        def chunks():
            held, told, long_key = [np.zeros(0, np.int64)] * 3, 0, None
            for batch in batches:
                x = [np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, ("key", "meta", "set_id"))]
                new = np.ones(len(x[0]), bool)
                new[1:] = (x[0][1:] != x[0][:-1]) | (x[2][1:] != x[2][:-1])
                x = [c[new] for c in x]
                if not len(x[0]):
                    continue
                # the last list may go on in the next batch
                cut = int(np.searchsorted(x[0], x[0][-1]))
                if len(x[0]) - cut <= 4 * SHORT and not (cut == 0 and long_key is not None):
                    yield from found(*(c[:cut] for c in x), told, long_key)
                    held, told, long_key = [c[cut:] for c in x], 0, None
                else:
                    now = int(x[0][-1])
                    yield from found(*(c[:cut] for c in x), told, long_key) if cut else ()
                    yield from found(*(c[cut:] for c in x), 0 if cut else told, now)
                    held, told, long_key = [c[max(cut, len(c) - NEXT) :] for c in x], min(NEXT, len(x[0]) - cut), now
            yield from found(*held, told, long_key)

        yield from _rows([("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64())], ((c[0], c[1], c[2]) if c[0] is not None else ([None] * len(c[1]), c[1], c[2]) for c in chunks()))

    return listed.repartition("key").sortWithinPartitions("key", "meta", "set_id").select("key", "meta", "set_id").mapInArrow(run, "key long, a long, b long")


def _near(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """Pairs whose sizes and bitmaps allow a link."""
    side = lambda c: sigs.select(F.col("set_id").alias(c), F.col("n").alias(f"n{c}"), F.col("bitmap").alias(f"b{c}"))

    def run(batches):
        for t in batches:
            if t.num_rows:
                k = np.arange(t.num_rows)
                both = t.column("na").to_numpy().astype(np.int64) + t.column("nb").to_numpy()
                ok = pa.array(7 * Bitmaps(t.column("ba")).apart(k, Bitmaps(t.column("bb")), k) <= both)
                yield pa.RecordBatch.from_arrays([t.column(c).filter(ok) for c in "ab"], names=["a", "b"])

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "ba", "bb").mapInArrow(run, "a long, b long")


def _short(members: DataFrame) -> DataFrame:
    """Pairs in different components from lists of up to ``SHORT`` of ``members(key, set_id, meta, root)``."""

    def run(batches):
        held = [np.zeros(0, np.int64)] * 4

        def found(key, meta, k, root):
            for i, j in _near_in_list(key, range(1, SHORT)):
                ok = (root[i] != root[j]) & _can(meta, i, j)
                if ok.any():
                    yield _pairs(k, i[ok], j[ok])

        def chunks():
            nonlocal held
            for batch in batches:
                x = [np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, ("key", "meta", "set_id", "root"))]
                cut = int(np.searchsorted(x[0], x[0][-1])) if len(x[0]) else 0
                held = [c[cut:] for c in x]
                yield from found(*(c[:cut] for c in x))
            yield from found(*held)

        yield from _rows([("a", pa.int64()), ("b", pa.int64())], chunks())

    return members.repartition("key").sortWithinPartitions("key").select("key", "meta", "set_id", "root").mapInArrow(run, "a long, b long").distinct()


def _joined(root: np.ndarray, at: int, near: np.ndarray) -> np.ndarray:
    """Of the places ``near``, one for each component that isn't that of ``at``; ``root`` is brought up to date."""
    _, one = np.unique(root[near], return_index=True)
    one = near[one]
    one = one[root[one] != root[at]]
    if len(one):
        root[np.isin(root, root[one])] = root[at]
    return one


def _long(members: DataFrame, sizes: DataFrame, sigs: DataFrame) -> DataFrame:
    """From long lists, compared block by block: pairs enough to join what their bitmaps allow to link."""
    nb = sizes.select("key", F.expr(f"cast(ceil(c / {BLOCK}) as int)").alias("nb"))
    here = members.join(nb, "key").join(sigs.select("set_id", "bitmap"), "set_id").withColumn("mine", F.expr("cast(pmod(xxhash64(set_id, key), nb) as int)"))
    laid = here.withColumn("other", F.explode(F.expr("sequence(0, nb - 1)"))).select(
        "key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "set_id", "root", "meta", "bitmap")

    def compare(t: pa.Table) -> pa.Table:
        k, root, meta, mine = (t.column(c).to_numpy().copy() for c in ("set_id", "root", "meta", "mine"))
        bits, n, out = Bitmaps(t.column("bitmap")), meta >> 32, [(k[:0], k[:0])]
        rows, cols = (np.flatnonzero(mine == t.column(c)[0].as_py()) for c in "ij")
        for r in rows:
            c = cols[root[cols] != root[r]]
            c = c[_can(meta, np.full(len(c), r), c)]
            c = c[7 * bits.apart(np.full(len(c), r), bits, c) <= n[r] + n[c]]
            if len(c):
                one = _joined(root, r, c)
                out.append(_pairs(k, np.full(len(one), r), one))
        return pa.table({"a": np.concatenate([a for a, _ in out]), "b": np.concatenate([b for _, b in out])})

    return laid.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def _pool(docs: DataFrame, nodes: DataFrame, count: int) -> DataFrame:
    """``(set_id, items)``: the whole sets of ``nodes(set_id)``, and of few others. Only these are shuffled."""
    only = docs.sparkSession.sparkContext.broadcast(KeyFilter.build(nodes, "set_id", count))

    def run(batches):
        unlike = Unlike()

        def chunks():
            for _, sets in _sets(batches):
                if found := list(unlike(sets)):
                    ok = only.value.has(np.array([k for k, _ in found], np.int64))
                    if ok.any():
                        yield [k for (k, _), x in zip(found, ok) if x], [s.view(np.int64) for (_, s), x in zip(found, ok) if x]

        yield from _rows([("set_id", pa.int64()), ("items", pa.list_(pa.int64()))], chunks())

    return docs.select("text").mapInArrow(run, "set_id long, items array<long>").dropDuplicates(["set_id"])


def settle(docs: DataFrame, sigs: DataFrame, comp: DataFrame, scratch: Scratch) -> DataFrame:
    """``(a, b, n_links)``: links a - b enough to span the true components, and with a null b the number of rows
    of other sets that set a links with. All links lie within the components ``comp(node, root)``.

    Each part of a component meets each, as whole sets, in blocks; only counts and spanning links leave a block.
    """
    rooted = comp.withColumnRenamed("node", "set_id").join(sigs.select("set_id", "n", "copies"), "set_id")
    sizes = rooted.groupBy("root").agg(F.expr(f"cast(greatest(ceil(count(*) / {COUNT_BLOCK}), ceil(sum(n) / {COUNT_SHINGLES})) as int)").alias("nb"))
    rooted = scratch.write("candidates", rooted.join(sizes, "root").select("set_id", "root", "copies", "nb", F.expr("cast(pmod(xxhash64(set_id), nb) as int)").alias("mine")))
    laid = rooted.join(_pool(docs, rooted, rooted.count()), "set_id").withColumn("other", F.explode(F.expr("sequence(0, nb - 1)"))).select(
        "root", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "set_id", "copies", "items")

    def compare(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        k, copies, mine = (t.column(c).to_numpy() for c in ("set_id", "copies", "mine"))
        items = pa.concat_arrays(t.column("items").chunks)
        ends = np.cumsum(items.value_lengths().to_numpy().astype(np.int64))
        starts = np.concatenate([[0], ends[:-1]])
        known, at = np.unique(items.flatten().to_numpy(), return_inverse=True)
        block = [t.column(c)[0].as_py() for c in "ij"]
        rows, cols = (np.flatnonzero(mine == b) for b in block)
        size, mark, n, root, out = ends - starts, np.zeros(len(known), bool), np.zeros(t.num_rows, np.int64), np.arange(t.num_rows), [(k[:0], k[:0])]
        laid = np.concatenate([at[starts[c] : ends[c]] for c in cols]) if len(cols) else at[:0]
        first = np.concatenate([[0], np.cumsum(size[cols])[:-1]]).astype(np.int64)
        for r in rows if len(cols) else ():
            own = at[starts[r] : ends[r]]
            mark[own] = True
            both = np.add.reduceat(mark[laid], first, dtype=np.int64)
            mark[own] = False
            linked = cols[100 * both >= 75 * (size[r] + size[cols] - both)]
            linked = linked[linked != r]
            n[r] += copies[linked].sum()
            if block[0] != block[1]:
                n[linked] += copies[r]
            if len(linked):
                one = _joined(root, r, linked)
                out.append(_pairs(k, np.full(len(one), r), one))
        a, b = (np.concatenate([o[c] for o in out]) for c in (0, 1))
        return pa.table({"a": np.concatenate([a, k]), "b": pa.concat_arrays([pa.array(b), pa.nulls(len(k), pa.int64())]), "n_links": np.concatenate([np.zeros(len(a), np.int64), n])})

    return laid.groupBy("root", "i", "j").applyInArrow(compare, "a long, b long, n_links long")


def near_duplicates(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``(doc_id, n_shingles, n_links, component_id)``, one row for each row of ``docs(doc_id, text)``.

    ``n_links`` counts the other rows that the row links with, copies included. A row without shingles has no
    link and its own doc_id; a null doc_id never names a component.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # some hundred texts to a bucket of the hashes, so that what a bucket holds doesn't grow with the input
    bits = min(20, max(4, (docs.count() // BUCKET_TEXTS).bit_length()))
    described = scratch.write("described", describe(docs, bits))
    rows = described.where("bucket is null").select("doc_id", "set_id", "n", "bitmap")
    # one row for each set; copies meet in the map-side aggregation
    sigs = scratch.write("sets", rows.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.max("bitmap").alias("bitmap"), F.count("*").alias("copies")))

    counted = scratch.write("counts", frequent(described.where("bucket is not null").select("bucket", "codes", "counts")))
    levels = {int(r.level): (r.k, r.e) for r in counted.groupBy(F.floor(F.log2("c") * 8).alias("level")).agg(F.count("*").alias("k"), F.sum("c").alias("e")).collect()}
    least, kept = 0, 0
    for level in sorted(levels, reverse=True):
        if kept + levels[level][0] > ORDERED:
            least = level + 1
            break
        kept += levels[level][0]
    top = counted.where(F.floor(F.log2("c") * 8) >= least).toArrow()
    order = spark.sparkContext.broadcast(Order(top["code"].to_numpy(), top["c"].to_numpy().astype(np.float64), bits))
    scratch.drop("counts")

    sizes = {r.n: r.k for r in sigs.where(f"n <= {LIGHT_MOST}").groupBy("n").agg(F.count("*").alias("k")).collect()}
    most = light_boundary(sizes, sum(e for _, e in levels.values()) / max(1, sum(k for k, _ in levels.values())))

    listed = scratch.write("lists", lists(entries(docs, order, most)))
    near = scratch.write("near", _near(listed.where("key is null").select("a", "b").distinct(), sigs))
    comp = scratch.write("components", components(near, scratch, "cc"))

    # lists that still reach into several components: all that sizes, bounds and bitmaps allow is joined
    members = listed.where("key is not null").select("key", F.col("a").alias("set_id"), F.col("b").alias("meta"))
    rooted = members.join(comp.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    open_ = scratch.write("open", rooted.groupBy("key").agg(F.count("*").alias("c"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("key", "c"))
    rooted = scratch.write("open-members", rooted.join(open_, "key"))
    more = scratch.write("near-open", _near(_short(rooted.where(f"c <= {SHORT}")), sigs).union(_long(rooted.where(f"c > {SHORT}").drop("c"), open_.where(f"c > {SHORT}"), sigs)))
    if not more.isEmpty():
        comp = scratch.write("components-open", components(near.union(more), scratch, "cc-open"))
    scratch.drop("lists", "open", "open-members")

    settled = scratch.write("settled", settle(docs, sigs, comp, scratch))
    comp = components(settled.where("b is not null").select("a", "b"), scratch, "cc-links")
    n_links = settled.where("b is null").groupBy(F.col("a").alias("set_id")).agg(F.sum("n_links").alias("n_links"))
    named = sigs.select("set_id", "doc_id", "copies").join(comp.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    named = named.join(named.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").join(n_links, "set_id", "left")
    named = named.select("set_id", "component_id", (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return rows.select("doc_id", "n", "set_id").join(named, "set_id", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark, "op5"))
