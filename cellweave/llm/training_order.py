"""Operator 2. Token sequences in training order: a keyed Feistel permutation and fixed-stride shards.

Texts are tokenised (byte-level BPE of a public vocabulary file, a parameter), closed with the end token and
cut into sequences of ``LENGTH`` ids; the last one is padded with the end token. Sequences are numbered from
0 by the files' names, and in the order of rows within a file, however Spark splits and packs files for its tasks
(rewritten files give a new order; rows that come from no file are numbered by partition), and a keyed Feistel network with cycle-walking maps each number to its slot, a
bijection of 0 .. n-1 that no one needs to store. Slots are dealt to shards by range, and runs of neighbouring
shards to tasks, which write one after the other: shard s holds the slots from s * PER_SHARD on, each of
LENGTH * 2 bytes, so any slot's bytes are found by arithmetic and a reader resumes at any slot. op2 shuffles and
writes a quarter of the shards at a time. ``write_shards`` writes the files, and beside each an index of equal stride with the
sequences' documents; a repeated task writes the same bytes again. op2 writes all shards and returns what it
reads back from the files.

Null and empty texts have no sequence, an empty table makes no shard; a text of any length is read whole. Repeated rows have sequences of their own. Null ids are kept.
Columns other than the id and the text aren't read. A vocabulary with ids beyond 16 bits is an error.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm._shared import Scratch, table
from cellweave.llm._text import mix

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: how a text is cut into words before byte pairs are merged: the vocabulary's published pattern
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
END = 50256
LENGTH = 512
PER_SHARD = 8192
ROUNDS = 6
#: shards that a task writes one after the other, where there are more than ``TASKS`` of them
SHARD_RUN, TASKS = 16, 64
#: parts of the slots that are shuffled and written one after the other, which bounds the shuffle's share of the disk
WAVES = 4
#: a sequence's record in the index beside its shard; ``named`` is 0 for a null doc_id
INDEX = np.dtype([("doc_id", "<i8"), ("sequence", "<i4"), ("n_tokens", "<i4"), ("named", "u1")])


def permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """The slots of indexes under 0 .. n-1: Feistel rounds on the next even number of bits, walked until they fall below n."""
    half = max(1, ((max(2, n) - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = mix(np.uint64(key) + np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out = np.asarray(index).astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> shift, x & mask
        for k in keys:
            left, right = right, left ^ (mix(right + k) & mask)
        out[todo] = x = left << shift | right
        todo = todo[x >= np.uint64(n)]
    return out.astype(np.int64)


def invert(slot: np.ndarray, n: int, key: int) -> np.ndarray:
    """The indexes of slots: what a resumed reader asks for."""
    half = max(1, ((max(2, n) - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = mix(np.uint64(key) + np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out = np.asarray(slot).astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> shift, x & mask
        for k in keys[::-1]:
            left, right = right ^ (mix(left + k) & mask), left
        out[todo] = x = left << shift | right
        todo = todo[x >= np.uint64(n)]
    return out.astype(np.int64)


def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    if max(ranks.values(), default=0) >= 1 << 16:
        raise ValueError(f"{path} has ids that 16 bits can't hold")
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def sequences(docs: DataFrame, length: int = LENGTH, path: str = VOCABULARY) -> DataFrame:
    """``(file, start, part, first, doc_id, n_tokens, ids)``: a row for each text, ids as little-endian 16-bit numbers.

    file and start name the stretch of a file that the row was read from, part the partition where there is no file;
    first is the number of sequences in it before the row's own.
    """

    def run(batches):
        from pyspark import TaskContext

        encode, done, here, task = _encoder(path).encode_ordinary, 0, None, TaskContext.get().partitionId()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                ids, kept, blobs, n, first = b.column("doc_id").to_pylist(), [], [], [], []
                stretch = list(zip(b.column("file").to_pylist(), b.column("start").to_pylist()))
                for k, text in enumerate(b.column("text").to_pylist()):
                    if stretch[k] != here:
                        here, done = stretch[k], 0
                    if text:
                        x = np.array(encode(text) + [END], "<u2")
                        kept.append(k)
                        n.append(len(x))
                        blobs.append(x.tobytes())
                        first.append(done)
                        done += -(-len(x) // length)
                at_file = [stretch[k] for k in kept]
                yield pa.RecordBatch.from_arrays([
                    pa.array([f for f, _ in at_file], pa.string()), pa.array([s for _, s in at_file], pa.int64()), pa.array([0 if f else task for f, _ in at_file], pa.int32()), pa.array(first, pa.int64()),
                    pa.array([ids[k] for k in kept], pa.int64()), pa.array(n, pa.int32()), pa.array(blobs, pa.binary())], names=["file", "start", "part", "first", "doc_id", "n_tokens", "ids"])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.input_file_name().alias("file"), F.input_file_block_start().alias("start"))
    return read.mapInArrow(run, "file string, start long, part int, first long, doc_id long, n_tokens int, ids binary")


def tasks(shards: int) -> int:
    """Tasks that write so many shards."""
    return min(shards, max(TASKS, -(-shards // SHARD_RUN)))


def hold(docs: DataFrame, scratch: Scratch, length: int = LENGTH, path: str = VOCABULARY) -> tuple[DataFrame, dict[tuple[str, int, int], int], int]:
    """The written tokens, the sequences before each stretch of a file, and the number of all sequences."""
    held = scratch.write("tokens", sequences(docs, length, path), codec="zstd", level=3)
    # one number for each stretch that a task reads reaches the driver: how many sequences stand before it
    starts, n = {}, 0
    for c in sorted(held.groupBy("file", "start", "part").agg(F.max(F.col("first") + F.ceil(F.col("n_tokens") / length)).alias("n")).collect()):
        starts[c.file, c.start, c.part] = n
        n += int(c.n)
    return held, starts, n


def arrange(held: DataFrame, starts: dict[tuple[str, int, int], int], n: int, shards: range, key: int = 20_240_601, length: int = LENGTH, per_shard: int = PER_SHARD) -> DataFrame:
    """The sequences of a range of shards as ``training_order`` returns them; only these are shuffled."""
    known = held.sparkSession.sparkContext.broadcast(starts)

    def deal(batches):
        start, pack = known.value, pa.Codec("zstd").compress
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                b = batch.slice(a, 256)
                n_tokens = b.column("n_tokens").to_numpy()
                first = b.column("first").to_numpy() + np.array([start[p] for p in zip(*(b.column(c).to_pylist() for c in ("file", "start", "part")))], np.int64)
                count = -(-n_tokens // length)
                row = np.repeat(np.arange(b.num_rows), count)
                number = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                slot = permute(first[row] + number, n, key)
                here = np.flatnonzero((slot >= shards.start * per_shard) & (slot < shards.stop * per_shard))
                row, number, slot = row[here], number[here], slot[here]
                size = np.minimum(length, n_tokens[row] - number * length)
                blobs = b.column("ids")
                ids = [pack(blobs[r].as_buffer().slice(2 * length * j, 2 * k), asbytes=True) for r, j, k in zip(row.tolist(), number.tolist(), size.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(slot), b.column("doc_id").take(pa.array(row)), pa.array(number.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(ids, pa.binary())], names=["slot", "doc_id", "sequence", "n_tokens", "packed"])

    def lay(batches):
        unpack, pad = pa.Codec("zstd").decompress, np.full(length, END, "<u2").tobytes()
        for b in batches:
            slot, size = b.column("slot").to_numpy(), b.column("n_tokens").to_pylist()
            ids = [unpack(x, 2 * n, asbytes=True) + pad[2 * n :] for x, n in zip(b.column("packed").to_pylist(), size)]
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array((slot // per_shard).astype(np.int32)), pa.array(slot % per_shard * length * 2), *(b.column(c) for c in ("doc_id", "sequence", "n_tokens")), pa.array(ids, pa.binary())], names=["slot", "shard", "place", "doc_id", "sequence", "n_tokens", "ids"])

    count = tasks(len(shards))
    dealt = held.mapInArrow(deal, "slot long, doc_id long, sequence int, n_tokens int, packed binary")
    run = F.expr(f"cast((slot div {per_shard} - {shards.start}) * {count} div {len(shards)} as int)")
    laid = dealt.repartitionById(count, run).sortWithinPartitions("slot")
    return laid.mapInArrow(lay, "slot long, shard int, place long, doc_id long, sequence int, n_tokens int, ids binary")


def training_order(docs: DataFrame, scratch: Scratch, key: int = 20_240_601, length: int = LENGTH, per_shard: int = PER_SHARD, path: str = VOCABULARY) -> DataFrame:
    """``(slot, shard, place, doc_id, sequence, n_tokens, ids)``, shard by shard and in slot order within.

    ``place`` is the byte at which the sequence starts in its shard, ``sequence`` its number in its text.
    """
    held, starts, n = hold(docs, scratch, length, path)
    return arrange(held, starts, n, range(max(1, -(-n // per_shard))), key, length, per_shard)


def write_shards(rows: DataFrame, folder: str, length: int = LENGTH) -> DataFrame:
    """Write each shard of ``training_order`` to ``folder``/shard-NNNNNN.bin; ``(shard, path, sequences, sha256)``.

    ``folder`` is a path or an address that pyarrow opens. A task writes a shard and its index (.idx) beside
    their names and then moves them, so a task that runs again leaves whole files.
    """

    def run(batches):
        import uuid

        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        out = sink = None
        done = []

        def close():
            sink.close()
            with store.open_output_stream(f"{out['own']}.idx") as f:
                f.write(np.array(out["index"], INDEX).tobytes())
            store.move(f"{out['own']}.idx", out["path"].removesuffix(".bin") + ".idx")
            store.move(out["own"], out["path"])
            done.append((out["shard"], out["path"], len(out["index"]), out["sha"].hexdigest()))

        for batch in batches:
            for shard, doc_id, sequence, n_tokens, ids in zip(*(batch.column(c).to_pylist() for c in ("shard", "doc_id", "sequence", "n_tokens", "ids"))):
                if out is None or out["shard"] != shard:
                    if out:
                        close()
                    path = f"{base}/shard-{shard:06d}.bin"
                    out = {"shard": shard, "path": path, "own": f"{path}.{uuid.uuid4().hex}", "index": [], "sha": hashlib.sha256()}
                    sink = store.open_output_stream(out["own"])
                sink.write(ids)
                out["sha"].update(ids)
                out["index"].append((doc_id or 0, sequence, n_tokens, doc_id is not None))
        if out:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), (pa.int32(), pa.string(), pa.int64(), pa.string()))], names=["shard", "path", "sequences", "sha256"])

    return rows.select("shard", "doc_id", "sequence", "n_tokens", "ids").mapInArrow(run, "shard int, path string, sequences long, sha256 string")


def read_shards(files: DataFrame, folder: str, length: int = LENGTH, per_shard: int = PER_SHARD) -> DataFrame:
    """The sequences in the files that ``write_shards`` names, each with the digest of its bytes; a file that differs from its entry is an error."""

    def run(batches):
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for shard, path, n, digest in zip(*(batch.column(c).to_pylist() for c in ("shard", "path", "sequences", "sha256"))):
                with store.open_input_file(path.removesuffix(".bin") + ".idx") as f:
                    index = np.frombuffer(f.read(), INDEX)
                whole = hashlib.sha256()
                with store.open_input_file(path) as f:
                    if f.size() != 2 * length * n or len(index) != n:
                        raise ValueError(f"{path} has {f.size()} bytes and {len(index)} index records for {n} sequences")
                    for at in range(0, n, 256):
                        x = index[at : at + 256]
                        block = f.read(2 * length * len(x))
                        whole.update(block)
                        ids = [block[k : k + 2 * length] for k in range(0, len(block), 2 * length)]
                        place = np.arange(at, at + len(x), dtype=np.int64)
                        yield pa.RecordBatch.from_arrays([
                            pa.array(shard * per_shard + place), pa.array(np.full(len(x), shard, np.int32)), pa.array(place * length * 2), pa.array(x["doc_id"].astype(np.int64), mask=x["named"] == 0),
                            pa.array(x["sequence"].astype(np.int32)), pa.array(x["n_tokens"].astype(np.int32)), pa.array(ids, pa.binary()), pa.array([hashlib.sha256(i).hexdigest() for i in ids]),
                        ], names=["slot", "shard", "place", "doc_id", "sequence", "n_tokens", "ids", "sha256"])
                if whole.hexdigest() != digest:
                    raise ValueError(f"{path} isn't what was written")

    return files.mapInArrow(run, "slot long, shard int, place long, doc_id long, sequence int, n_tokens int, ids binary, sha256 string")


def stored_order(docs: DataFrame, scratch: Scratch, key: int = 20_240_601, length: int = LENGTH, per_shard: int = PER_SHARD, path: str = VOCABULARY) -> DataFrame:
    """The columns of ``training_order`` and ``sha256``, all from the shard files in the scratch folder ``shards``."""
    folder = scratch.path("shards")
    held, starts, n = hold(docs, scratch, length, path)
    shards = max(1, -(-n // per_shard))
    waves = [range(w * shards // WAVES, (w + 1) * shards // WAVES) for w in range(WAVES)]
    names = []
    # one wave's shuffle files are gone before the next one's are written
    for wave in filter(len, waves):
        names.append(f"files-{wave.start}")
        files = scratch.write(names[-1], write_shards(arrange(held, starts, n, wave, key, length, per_shard), folder, length))
    scratch.drop("tokens")
    files = docs.sparkSession.read.schema(files.schema).parquet(*map(scratch.path, names))
    count = tasks(shards)
    return read_shards(files.repartitionById(count, F.col("shard") % count), folder, length, per_shard)


def read_from(folder: str, slot: int, length: int = LENGTH, per_shard: int = PER_SHARD) -> np.ndarray:
    """The ids at a slot, found by arithmetic alone."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    with store.open_input_file(f"{base}/shard-{slot // per_shard:06d}.bin") as f:
        return np.frombuffer(f.read_at(2 * length, slot % per_shard * 2 * length), "<u2")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_order(table(spark, sf_dir, "documents"), Scratch(spark, "op2"))
