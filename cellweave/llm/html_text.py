"""Operator 13. Main text of HTML pages: a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks. Each has binary features of its open elements (tags, words of class, id and role,
and what part of a page such words name) and of its text (length, share of linked characters, marks, words that
notices, forms and footers say, place on the page). Two labels, main and other, form a chain with learned
transitions; weights are the maximum of the penalised likelihood over labelled pages, and Viterbi gives the labels
of a whole page. Main blocks' texts, joined by a newline, are the page's text.

The given tables label no blocks, so the query learns from pages that name their article themselves, and from
their texts set in other layouts (``html_layouts``): a sample of at most ``SAMPLE`` pages of at most ``SHORT``
characters, the first by a hash of their html. ``train`` takes labelled pages from elsewhere too. Every page is
judged, and whole, however long.

Null and empty html give an empty text; without a page that names its article, invented text stands in the layouts.
Every row gives a row, repeated ones too; an empty table gives none. Of equal scores the block counts as other.
Input columns called like results are replaced; all others are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm._shared import table
from cellweave.llm.html_blocks import Block, Element, blocks
from cellweave.llm.html_layouts import NAMES, labelled

#: pages of the sample, their characters, and layouts that each is set in
SAMPLE, SHORT, LAYOUTS = 250, 100_000, 5
#: labelled pages of more blocks aren't learnt from
MOST_BLOCKS = 150
ROUNDS, RATE, PENALTY = 200, 0.15, 2e-5
#: a feature has to stand in so many labelled blocks
LEAST = 3
_PART_OF = {w: part for part, names in NAMES.items() for n in names for w in (n.replace("-", ""), *([n] if "-" not in n else [])) if w not in ("text", "banner")}
_SAID = re.compile(r"(?i)\b(cookies?|consent|subscribe|newsletter|sign up|log ?in|password|comments?|repl(?:y|ies)|advert\w*|anzeige|sponsored|share|rights reserved|copyright|privacy|read more|related|menu|search|powered by|terms|contact|previous|next|says)\b")
_STEMS = [("cookie", "notice"), ("consent", "notice"), ("gdpr", "notice"), ("comment", "comments"), ("disqus", "comments"), ("repl", "comments"), ("sidebar", "side"), ("widget", "side"), ("footer", "footer"), ("header", "header"),
          ("masthead", "header"), ("nav", "menu"), ("menu", "menu"), ("breadcrumb", "menu"), ("advert", "ad"), ("sponsor", "ad"), ("promo", "ad"), ("newsletter", "form"), ("subscri", "form"), ("signup", "form"), ("login", "form"),
          ("search", "form"), ("share", "more"), ("social", "more"), ("related", "more"), ("recommend", "more"), ("notice", "notice"), ("popup", "notice"), ("modal", "notice"), ("copyright", "footer")]


def part_of(word: str) -> str | None:
    """The part of a page that a class name's word names, if any."""
    return _PART_OF.get(word) or next((part for stem, part in _STEMS if word.startswith(stem)), None)


def _of_path(path: tuple[Element, ...]) -> list[str]:
    tags = [e.tag for e in path if e.tag not in ("html", "body")]
    leaf = next((t for t in reversed(tags) if t not in ("a", "b", "i", "span", "em", "strong", "u", "small")), "none")
    words = {w for e in path for w in e.words}
    parts = {p for p in map(part_of, words) if p}
    out = [f"leaf {leaf}", *(f"in {t}" for t in set(tags)), *(f"word {w}" for w in words), *(f"part {p}" for p in parts)]
    above = [e for e in path if part_of_element(e)]
    if above:
        out.append(f"nearest {part_of_element(above[-1])}")
    if not parts & {"main"} and not {"article", "main"} & set(tags):
        out.append("in no main part")
    return out


def part_of_element(e: Element) -> str | None:
    return next((p for p in map(part_of, e.words) if p), None) or (e.tag if e.tag in ("article", "main", "nav", "header", "footer", "aside", "form", "dialog") else None)


def features(held: list[Block], title: str) -> list[list[str]]:
    out, seen, cache = [], False, {}
    sizes = [len(b.text.split()) for b in held]
    for k, (b, n) in enumerate(zip(held, sizes)):
        if b.path not in cache:
            cache[b.path] = _of_path(b.path)
        length = len(b.text)
        linked = b.linked / length
        size = n.bit_length()
        f = ["all", *cache[b.path], f"words {min(size, 7)}", f"linked {0 if not linked else 1 if linked < 0.3 else 2 if linked < 0.7 else 3}"]
        if b.text[-1] in ".!?:…\"”":
            f.append("ends")
        if "," in b.text:
            f.append("comma")
        if b.text[0] == "©" or "©" in b.text[:60]:
            f.append("copyright mark")
        if n < 40:
            f += {f"says {m.lower()}" for m in _SAID.findall(b.text)}
        if any(e.tag in ("h1", "h2") for e in b.path):
            seen = True
            if title and (b.text.startswith(title[:15]) or title.startswith(b.text[:15])):
                f.append("title")
        f.append("after a heading" if seen else "before any heading")
        f.append(f"place {min(4, 5 * k // len(held))}")
        f += ["first"] * (k == 0) + ["last"] * (k == len(held) - 1)
        if k:
            f.append("like the one before" if held[k - 1].path[:-1] == b.path[:-1] else "elsewhere than the one before")
        out.append(f)
    return out


class Chain:
    """Weights of the label main by feature, and of transitions ``[from, to]``; ``start`` of the first label."""

    def __init__(self, weights: dict[str, float], moves: np.ndarray, start: float):
        self.weights, self.moves, self.start = weights, moves, start

    def scores(self, rows: list[list[str]]) -> list[float]:
        w = self.weights
        return [sum(w.get(f, 0.0) for f in row) for row in rows]

    def decode(self, scores: list[float]) -> list[bool]:
        """Viterbi: the likeliest labels of the whole page."""
        (oo, om), (mo, mm) = self.moves.tolist()
        other, main, back = 0.0, self.start, []
        for k, s in enumerate(scores):
            if k:
                from_main = (main + mo > other + oo, main + mm > other + om)
                other, main = (main + mo if from_main[0] else other + oo), (main + mm if from_main[1] else other + om)
                back.append(from_main)
            main += s
        label = main > other
        out = [label] if scores else []
        for from_main in reversed(back):
            label = from_main[label]
            out.append(label)
        return out[::-1]


def likelihood(emit: np.ndarray, gold: np.ndarray, size: np.ndarray, moves: np.ndarray, start: float) -> tuple[float, np.ndarray, np.ndarray, float]:
    """Log likelihood of pages as rows (padded; ``size`` blocks each), and its gradients for emissions, moves and start.

    Forward and backward sums in logs, all pages at once.
    """
    pages, longest = emit.shape
    ahead, behind = np.zeros((longest, pages, 2)), np.zeros((longest, pages, 2))
    score = np.stack([np.zeros_like(emit), emit], 2)
    here = score[:, 0] + [0.0, start]
    ahead[0] = here
    for t in range(1, longest):
        here = np.logaddexp(here[:, :1] + moves[0], here[:, 1:] + moves[1]) + score[:, t]
        ahead[t] = here
    last = ahead[size - 1, np.arange(pages)]
    total = np.logaddexp(last[:, 0], last[:, 1])
    pair = np.zeros((2, 2))
    for t in range(longest - 2, -1, -1):
        on = (t + 1 < size)[:, None]
        to = score[:, t + 1] + behind[t + 1]
        behind[t] = np.where(on, np.logaddexp(moves[:, 0] + to[:, :1], moves[:, 1] + to[:, 1:]), 0)
        both = np.exp(ahead[t][:, :, None] + moves + to[:, None, :] - total[:, None, None])
        pair += (both * on[:, :, None]).sum(0)
    inside = np.arange(longest) < size[:, None]
    main = np.where(inside, np.exp((ahead + behind)[:, :, 1].T - total[:, None]), 0)
    truth = (gold * emit * inside).sum() + start * gold[:, 0].sum()
    count = np.zeros((2, 2))
    both = inside[:, 1:]
    for a in (0, 1):
        for b in (0, 1):
            count[a, b] = (both & (gold[:, :-1] == a) & (gold[:, 1:] == b)).sum()
    return float(truth + (count * moves).sum() - total.sum()), np.where(inside, gold - main, 0), count - pair, float((gold[:, 0] - main[:, 0]).sum())


def fit(pages: Iterable[tuple[list[tuple[Block, bool]], str]]) -> Chain:
    """The chain that makes the labels of these pages likeliest."""
    held = [(features([b for b, _ in page], title), [y for _, y in page]) for page, title in pages if 0 < len(page) <= MOST_BLOCKS]
    seen: dict[str, int] = {}
    for rows, _ in held:
        for f in (f for row in rows for f in row):
            seen[f] = seen.get(f, 0) + 1
    names = {f: k for k, f in enumerate(sorted(f for f, n in seen.items() if n >= LEAST))}
    if not held or not names:
        return Chain({}, np.zeros((2, 2)), 0.0)
    size = np.array([len(y) for _, y in held])
    shape = (len(held), int(size.max()))
    gold, cell, flat = np.zeros(shape), [], []
    for i, (rows, y) in enumerate(held):
        gold[i, : len(y)] = y
        for j, row in enumerate(rows):
            own = [names[f] for f in row if f in names]
            flat += own
            cell += [i * shape[1] + j] * len(own)
    cell, flat = np.array(cell), np.array(flat)
    n = len(names)
    x, first, second = np.zeros(n + 5), np.zeros(n + 5), np.zeros(n + 5)
    for k in range(1, ROUNDS + 1):
        emit = np.bincount(cell, x[flat], minlength=shape[0] * shape[1]).reshape(shape)
        _, by_cell, by_move, by_start = likelihood(emit, gold, size, x[n : n + 4].reshape(2, 2), x[n + 4])
        slope = np.concatenate([np.bincount(flat, by_cell.ravel()[cell], minlength=n), by_move.ravel(), [by_start]]) / size.sum() - PENALTY * x
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope * slope
        x += RATE * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-8)
    return Chain({f: float(x[k]) for f, k in names.items() if abs(x[k]) > 1e-6}, x[n : n + 4].reshape(2, 2), float(x[n + 4]))


def main_text(page: str | None, chain: Chain) -> str:
    held, title = blocks(page)
    keep = chain.decode(chain.scores(features(held, title)))
    return "\n".join(b.text for b, y in zip(held, keep) if y)


def train(pages: DataFrame, sample: int = SAMPLE, layouts: int = LAYOUTS, html: str = "html") -> Chain:
    """A chain from a bounded sample of pages that name their article."""
    page = F.col(html)
    named = pages.select(page.alias("html")).where(F.lower(page).contains("<article") & (F.length(page) <= SHORT)).withColumn("h", F.xxhash64("html"))
    # hashes first, so that tasks send numbers and not pages
    least = [r.h for r in named.select("h").distinct().orderBy("h").limit(sample).collect()]
    rows = named.where(F.col("h") <= least[-1]).dropDuplicates(["h"]).orderBy("h").select("html").collect() if least else []
    return fit(labelled([r.html for r in rows], layouts))


def extract(pages: DataFrame, chain: Chain, html: str = "html") -> DataFrame:
    """``pages`` with text and n_chars."""
    held = pages.sparkSession.sparkContext.broadcast(chain)
    keep = [c for c in pages.columns if c.lower() not in ("text", "n_chars")]
    # the input's columns travel in one, so no name of theirs can meet one of ours
    laid = pages.select(F.struct(*keep).alias("row"), F.col(html).alias("html"))

    def run(batches):
        for batch in batches:
            texts = [main_text(x.as_py(), held.value) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["row", "text", "n_chars"])

    kind = laid.schema["row"].dataType.simpleString()
    return laid.mapInArrow(run, f"row {kind}, text string, n_chars long").select("row.*", "text", "n_chars")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages, train(pages)).drop("html")
