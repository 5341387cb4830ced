"""Operator 10. SentencePiece-style encoding and decoding: unigram Viterbi over a double-array trie.

White space becomes the marker (one is put in front), every character that no piece covers becomes the
pieces of its UTF-8 bytes, and of all segmentations the one of the highest summed log score is taken
(on ties the one whose last piece is the longest). Decoding joins pieces and bytes, turns markers into spaces and takes the
leading one away; encoding and decoding give back every text but for bytes that are no UTF-8.

The pieces come from a public vocabulary file, which is a parameter. Its scores are merge ranks; a log score
is made of a rank by Zipf's law, log p = -log(rank + 2) - LOG_NORM, so that sums of scores compare whole
segmentations as a unigram model does. No piece runs from one word into the next marker, so a text is cut
before each run of markers, and around newlines, without any loss, and each distinct part is solved once.

Null texts stay null with 0 tokens; empty texts have none, an empty table gives no rows. Texts of any length are
encoded whole, in memory that grows with their longest part. Repeated rows are encoded alike. Other columns
are kept in ``encode``; same-named ones are replaced.
"""

from __future__ import annotations

import math
import re
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from cellweave.llm._shared import table

#: folder of the public vocabulary files, and the file
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
_NONE = -math.inf
LOG_NORM = math.log(11.0)
#: log score of a byte piece
BYTE_SCORE = -25.0
#: bytes, about, of the parts whose solution a task keeps, in either of two generations; longer parts than this many characters aren't kept
MEMO, LONGEST = 48 << 20, 64


class DoubleArray:
    """A trie over UTF-8 bytes: the child of state s by byte b is base[s] + b + 1 where check says s."""

    def __init__(self, base: np.ndarray, check: np.ndarray, value: np.ndarray):
        self.base, self.check, self.value = base, check, value

    @classmethod
    def build(cls, keys: dict[bytes, int]) -> DoubleArray:
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for key, v in keys.items():
            at = 0
            for b in key:
                if (to := children[at].get(b)) is None:
                    children.append({})
                    ends.append(-1)
                    to = children[at][b] = len(children) - 1
                at = to
            ends[at] = v
        size = 8 * len(children) + 1024
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        used = bytearray(size)
        used[0], value[0] = 1, ends[0]
        begin, todo = 1, deque([(0, 0)])
        while todo:
            node, state = todo.popleft()
            if not (kids := sorted(children[node])):
                continue
            tries, spot = 0, used.find(0, begin + kids[0])
            while spot <= kids[0] or any(used[spot - kids[0] + b] for b in kids[1:]):
                spot, tries = used.find(0, spot + 1), tries + 1
            at = spot - kids[0] - 1
            if tries > 50:
                # what lies before is nearly full: later nodes begin here
                begin = max(begin, at)
            base[state] = at
            for b in kids:
                to = at + b + 1
                used[to], check[to], value[to] = 1, state, ends[children[node][b]]
                todo.append((children[node][b], to))
        last = len(used) - used[::-1].index(1) + 257
        return cls(base[:last], check[:last], value[:last])


class Pieces:
    """A vocabulary: pieces, log scores, byte pieces, and the trie."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[str]):
        keys = {p.encode(): i for i, (p, k) in enumerate(zip(pieces, kinds)) if k == "normal"}
        self.trie = DoubleArray.build(keys)
        self.scores = np.array(scores, np.float64)
        self.bytes_of = [bytes([int(p[3:5], 16)]) if k == "byte" else p.encode() if k == "normal" else b"" for p, k in zip(pieces, kinds)]
        self.byte_id = np.full(256, -1, np.int32)
        for i, k in enumerate(kinds):
            if k == "byte":
                self.byte_id[self.bytes_of[i][0]] = i
        if (self.byte_id < 0).any():
            raise ValueError("the vocabulary has no byte pieces")
        if any(MARK in p.lstrip(MARK) for p, k in zip(pieces, kinds) if k == "normal"):
            raise ValueError("a piece runs over a word's end")
        self.newline = not any("\n" in p and len(p) > 1 for p in pieces)

    @classmethod
    def load(cls, path: str = VOCABULARY) -> Pieces:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.vocab_size()
        kinds = ["byte" if m.is_byte(i) else "control" if m.is_control(i) or m.is_unknown(i) or m.is_unused(i) else "normal" for i in range(n)]
        # ranks count from the first piece that was merged; pieces below all others keep the last rank
        scores = [BYTE_SCORE if k == "byte" else -math.log(min(-m.get_score(i), n) + 2) - LOG_NORM for i, k in enumerate(kinds)]
        return cls([m.id_to_piece(i) for i in range(n)], scores, kinds)


class Encoder:
    """Viterbi in one task, with the solutions of parts kept."""

    def __init__(self, pieces: Pieces):
        self.first, self.check, self.value = (pieces.trie.base + 1).tolist(), pieces.trie.check.tolist(), pieces.trie.value.tolist()
        #: characters that are pieces by themselves
        self.alone = {b for i, b in enumerate(pieces.bytes_of) if b and pieces.byte_id[b[0]] != i and len(b.decode("utf-8", "replace")) == 1}
        self.scores, self.byte_id, self.bytes_of = pieces.scores.tolist(), pieces.byte_id.tolist(), pieces.bytes_of
        self.cut = re.compile(rf"\n|{MARK}*[^{MARK}\n]+|{MARK}+" if pieces.newline else rf"{MARK}*[^{MARK}]+|{MARK}+")
        self.young: dict[str, list[int]] = {}
        self.old: dict[str, list[int]] = {}
        self.kept = 0

    def solve(self, part: bytes) -> list[int]:
        n = len(part)
        best, prev, how = [_NONE] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        first, check, value, scores, alone = self.first, self.check, self.value, self.scores, self.alone
        for i, c in enumerate(part):
            here = best[i]
            if here == _NONE:
                continue
            state, j = 0, i
            while j < n:
                to = first[state] + part[j]
                if check[to] != state:
                    break
                state = to
                j += 1
                v = value[to]
                if v >= 0:
                    s = here + scores[v]
                    if s > best[j]:
                        best[j], prev[j], how[j] = s, i, v
            width = 1 if c < 0x80 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4
            if part[i : i + width] not in alone:
                # byte fallback of one whole character
                to = min(n, i + width)
                s = here + BYTE_SCORE * (to - i)
                if s > best[to]:
                    best[to], prev[to], how[to] = s, i, -1
        out, at = [], n
        while at:
            i = prev[at]
            if how[at] >= 0:
                out.append(how[at])
            else:
                out += [self.byte_id[b] for b in reversed(part[i:at])]
            at = i
        return out[::-1]

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        young, out = self.young, []
        for part in self.cut.findall(MARK + text.replace(" ", MARK)):
            ids = young.get(part)
            if ids is None:
                ids = self.old.get(part) or self.solve(part.encode())
                if len(part) <= LONGEST:
                    self.kept += 200 + 4 * len(part) + 8 * len(ids)
                    if self.kept > MEMO:
                        # parts that were used since the last change stay
                        self.old, young, self.kept = young, {}, 0
                        self.young = young
                    young[part] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


def encode(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """``docs`` with token_ids, n_tokens and round_trip (decoding gives the text again).

    A text that itself holds the marker character comes back with spaces there, and says so in round_trip.
    """
    held = docs.sparkSession.sparkContext.broadcast(pieces.__dict__ | {"trie": pieces.trie.__dict__})
    docs = docs.drop("token_ids", "n_tokens", "round_trip")

    def run(batches):
        coder = Encoder(thaw(held.value))
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                b = batch.slice(at, 128)
                ids, n, same = [], [], []
                for text in b.column("text").to_pylist():
                    x = coder.encode(text or "")
                    ids.append(np.array(x, np.int32))
                    n.append(len(x))
                    same.append(None if text is None else coder.decode(x) == text)
                ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays([*b.columns, lists, pa.array(n, pa.int64()), pa.array(same, pa.bool_())], names=[*b.schema.names, "token_ids", "n_tokens", "round_trip"])

    return docs.mapInArrow(run, T.StructType([*docs.schema]).add("token_ids", T.ArrayType(T.IntegerType())).add("n_tokens", "long").add("round_trip", "boolean"))


def thaw(state: dict) -> Pieces:
    out = Pieces.__new__(Pieces)
    out.__dict__.update(state | {"trie": DoubleArray(**state["trie"])})
    return out


def decode(rows: DataFrame, pieces: Pieces) -> DataFrame:
    """``rows`` with decoded, the text of token_ids; null ids give null."""
    held = rows.sparkSession.sparkContext.broadcast(pieces.__dict__ | {"trie": pieces.trie.__dict__})
    rows = rows.drop("decoded")

    def run(batches):
        coder = Encoder(thaw(held.value))
        for batch in batches:
            text = [None if x is None else coder.decode(x) for x in batch.column("token_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())], names=[*batch.schema.names, "decoded"])

    return rows.mapInArrow(run, T.StructType([*rows.schema]).add("decoded", "string"))



def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, Pieces.load()).drop("text")
