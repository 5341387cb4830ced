"""Operator 6. Secrets: candidate strings, and a random forest that removes false findings.

Candidates are runs of ``LEAST`` and more characters of keys and tokens, and values of ``LEAST_NAMED`` and more
that stand behind a credential's name and a sign. Features are the candidate's length, its transitions between
character classes and their shares, how much of it dictionary words cover, whether it is part of a path or
address, and how many of the ``NEIGHBOURS`` whole words on either side the dictionary knows. A forest (Spark's own) is fitted on labelled
findings, a bounded sample of them (``SAMPLE``), and judges every candidate.

``labels`` may hold labelled findings from elsewhere. The given tables have none, so the query's labels come from
what no feature looks at: a finding is true where it has an issuer's prefix and form, or where a credential's
name is assigned a value with a digit; it is false where it has neither name nor anything but letters and marks.
All others, such as values without digits behind a credential's name, have no label and are judged.

The dictionary holds all words, of any length, that stand in one text in ``ONE_IN``, counted over all texts. It has
at most ``ONE_IN`` times as many words as a text has distinct ones on average, however many texts there are.

Null and empty texts have no candidates, an empty table has no findings. Repeated rows have findings of their own, and
equal candidates with equal neighbours equal verdicts; a probability of just 0.5 is a secret. A candidate is whole
however long it is, and so are its neighbouring words and the piece between white space that it is a part of. Columns other than the id and the text aren't read.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm._shared import Scratch, table

LEAST = 16
#: of a value behind a credential's name
LEAST_NAMED = 8
#: labelled findings that a fit uses, at most
SAMPLE = 20_000
#: a word of the dictionary stands in one text in so many
ONE_IN = 500
#: words on either side of a candidate that are looked up
NEIGHBOURS = 4
TREES, DEPTH, SEED = 20, 8, 11
_CANDIDATE = re.compile(rb"[A-Za-z0-9+/=_.~\-\x80-\xff]{%d,}" % LEAST)
_PROVEN = re.compile(rb"^(AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36,}|xox[abprs]-[0-9A-Za-z-]{10,}|eyJ[\w-]+\.eyJ[\w-]+\.[\w-]+)$")
_NAME = rb"(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)"
_NAMED = re.compile(rb"(?i)%s\W{0,4}$" % _NAME)
_ASSIGNED = re.compile(rb"(?i)%s[\"']?\s{0,2}[=:]\s{0,2}[\"']?([^\s\"'`<>,;]{%d,})" % (_NAME, LEAST_NAMED))
_WORD = re.compile(rb"[A-Za-z\x80-\xff]{3,}")
_ADDRESS = re.compile(rb"://|www\.")
NAMES = ["length", "transitions", "upper", "lower", "digit", "other", "hex", "entropy", "dictionary", "path", "quoted", "words_before", "words_after"]


def _kind(c: int) -> int:
    return 0 if 65 <= c <= 90 else 1 if 97 <= c <= 122 or c >= 128 else 2 if 48 <= c <= 57 else 3


_KIND = np.array([_kind(c) for c in range(256)], np.int8)
_LETTER = np.array([_WORD.match(bytes([c]) * 3) is not None for c in range(256)])
_SPACE = np.array([bytes([c]).isspace() for c in range(256)])
_HEX = np.zeros(256, bool)
_HEX[[*range(48, 58), *range(97, 103)]] = True


class Dictionary:
    """Lower-case words, and their lengths from the longest on."""

    def __init__(self, words: frozenset[bytes]):
        self.words, self.lengths = words, sorted({len(w) for w in words if len(w) > 2}, reverse=True)
        self.longest = self.lengths[0] if self.lengths else 0

    def covered(self, candidate: bytes) -> float:
        """The share of the candidate that words of three and more bytes cover, the longest first from the left."""
        low, n, at, out = candidate.lower(), len(candidate), 0, 0
        while at < n:
            for k in self.lengths:
                if k <= n - at and low[at : at + k] in self.words:
                    out += k
                    at += k
                    break
            else:
                at += 1
        return out / n


class Around:
    """Where the words, white space and signs of addresses of a text are, to look up a candidate's neighbours."""

    def __init__(self, text: bytes):
        a = np.frombuffer(text, np.uint8)
        edges = np.flatnonzero(np.diff(np.concatenate([[False], _LETTER[a], [False]])))
        starts, ends = edges[::2], edges[1::2]
        whole = ends - starts >= 3
        self.text, self.starts, self.ends = text, starts[whole], ends[whole]
        self.spaces = np.flatnonzero(_SPACE[a])
        self.signs = [m.start() for m in _ADDRESS.finditer(text)]

    def _known(self, first: int, to: int, words: Dictionary) -> int:
        spans = zip(self.starts[first:to].tolist(), self.ends[first:to].tolist())
        return sum(b - a <= words.longest and self.text[a:b].lower() in words.words for a, b in spans)

    def known_before(self, start: int, words: Dictionary) -> int:
        k = int(np.searchsorted(self.ends, start, "right"))
        return self._known(max(0, k - NEIGHBOURS), k, words)

    def known_after(self, end: int, words: Dictionary) -> int:
        k = int(np.searchsorted(self.starts, end))
        return self._known(k, k + NEIGHBOURS, words)

    def address(self, start: int, end: int) -> bool:
        """Whether an address's sign stands in the candidate or before it in the same piece."""
        k, j = int(np.searchsorted(self.spaces, start)), bisect_left(self.signs, end)
        return j > 0 and self.signs[j - 1] > (self.spaces[k - 1] if k else -1)


def places(text: bytes) -> list[tuple[int, int]]:
    """Start and end of the candidates; a named value that a run of key characters meets is part of that."""
    runs = [m.span() for m in _CANDIDATE.finditer(text)]
    ends, starts = [b for _, b in runs], [a for a, _ in runs]
    named = []
    for m in _ASSIGNED.finditer(text):
        a, b = m.span(1)
        k = bisect_right(ends, a)
        if k == len(runs) or starts[k] >= b:
            named.append((a, b))
    return sorted(runs + named) if named else runs


def features(around: Around, start: int, end: int, words: Dictionary) -> list[float]:
    text = around.text
    x = text[start:end]
    a = np.frombuffer(x, np.uint8)
    kind, n = _KIND[a], len(a)
    counts = np.bincount(a)
    p = counts[counts > 0] / n
    before = text[max(0, start - 1) : start]
    return [
        n, int((kind[1:] != kind[:-1]).sum()) / n, *(np.bincount(kind, minlength=4) / n), float(_HEX[a].mean()), float(-(p * np.log2(p)).sum()),
        words.covered(x), float(b"/" in x or around.address(start, end) or b"@" in before + text[end : end + 1]),
        float(before in (b'"', b"'", b"`")), around.known_before(start, words), around.known_after(end, words),
    ]


def proof(text: bytes, start: int, end: int) -> int | None:
    """1 where an issuer's form or a credential's name proves a secret, 0 where letters and marks alone say that it is none, else unknown."""
    x = text[start:end]
    name, sign, value = x.partition(b"=")
    # the longest name and the marks behind it have 14 bytes
    named = bool(_NAMED.search(text[max(0, start - 20) : start]))
    inside = bool(sign and value and _NAMED.search(name))
    if _PROVEN.match(x) or re.search(rb"\d", value if inside else x) and (named or inside):
        return 1
    return 0 if not (named or inside or re.search(rb"[0-9+=_~]", x)) else None


def dictionary(docs: DataFrame, one_in: int = ONE_IN) -> frozenset[bytes]:
    """All words that stand in one text in ``one_in``, counted over all texts."""

    def run(batches):
        for batch in batches:
            seen: dict[bytes, int] = {}
            for text in batch.column("text").cast(pa.large_binary()):
                for w in set(_WORD.findall((text.as_py() or b"").lower())):
                    seen[w] = seen.get(w, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int32())], names=["w", "c"])

    least = max(2, docs.count() // one_in)
    often = docs.select("text").mapInArrow(run, "w binary, c int").groupBy("w").agg(F.sum("c").alias("c")).where(F.col("c") >= least)
    return frozenset(bytes(r.w) for r in often.select("w").collect())


def candidates(docs: DataFrame, words: frozenset[bytes]) -> DataFrame:
    """``(doc_id, start, length, features, label)``: places in bytes of UTF-8; label where a format proves one."""
    held = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        own = Dictionary(held.value)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.large_binary())):
                text = text.as_py() or b""
                found = places(text)
                around = Around(text) if found else None
                rows += ((doc_id, a, b - a, features(around, a, b, own), proof(text, a, b)) for a, b in found)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.int32()]
            cols = zip(*rows) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=["doc_id", "start", "length", "features", "label"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, start long, length long, features array<double>, label int")


def fit(findings: DataFrame, most: int = SAMPLE) -> RandomForestClassificationModel | None:
    """A forest from labelled findings; none if they are of one kind only."""
    known = findings.where("label is not null")
    n = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return None
    # as many of either kind as the bound allows, chosen by a hash
    part = F.pmod(F.xxhash64("doc_id", "start", "length"), F.lit(1 << 30)) / (1 << 30)
    picked = known.where(F.when(F.col("label") == 1, part <= most / 2 / n[1]).otherwise(part <= most / 2 / n[0]))
    rows = picked.select(F.col("label").cast("double").alias("label"), array_to_vector("features").alias("x"))
    return RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED).fit(rows)


def classify(findings: DataFrame, model: RandomForestClassificationModel | None) -> DataFrame:
    """``findings`` with probability and is_secret. Without a model no finding is removed."""
    if model is None:
        return findings.withColumns({"probability": F.lit(1.0), "is_secret": F.lit(True)})
    out = model.transform(findings.withColumn("x", array_to_vector("features")))
    return out.withColumn("probability", vector_to_array("probability")[1]).withColumn("is_secret", F.col("probability") >= 0.5).drop("x", "rawPrediction", "prediction")


def scan(docs: DataFrame, scratch: Scratch, labels: DataFrame | None = None) -> DataFrame:
    """``(doc_id, start, length, label, probability, is_secret)``: every candidate and what the forest says.

    ``labels(doc_id, start, length, label)``, one row for a finding, takes the place of the formats' proofs.
    """
    found = candidates(docs, dictionary(docs))
    if labels is not None:
        found = found.drop("label").join(labels.select("doc_id", "start", "length", F.col("label").cast("int").alias("label")), ["doc_id", "start", "length"], "left")
    found = scratch.write("candidates", found)
    return classify(found, fit(found)).select("doc_id", "start", "length", "label", "probability", "is_secret")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"), Scratch(spark, "op6"))
