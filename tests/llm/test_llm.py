"""The training-data operators beside brute force, and on rows that are null, empty, long, tied or repeated."""

import hashlib
import itertools
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cellweave.llm import decontaminate, importance, line_dedup, ngram_join, order_minhash, queries, secrets, toxicity, training_order, unigram, url_filter
from cellweave.llm._shared import KeyFilter, Scratch
from cellweave.llm._text import ALNUM, NOT_SPACE, shingles, utf8, word_hashes

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


def odd(spark):
    """Null, empty, blank, one-word, repeated, long and odd texts; a null id."""
    long = " ".join(random.Random(1).choices(WORDS, k=30_000))
    texts = [None, "", " \n\t ", "one", "same text of six words here", "same text of six words here", long, "é" * 200_000, "日本語 \U0001f600 naïve ▁ mark", "tab\tand\x00nul"]
    rows = [(i, t, None if i % 3 else "s") for i, t in enumerate(texts)] + [(4, texts[4], "s"), (None, "null id with a text of its own", "s")]
    # extra columns whose names clash with results
    return docs(spark, rows).withColumns({c: F.lit(-1) for c in ("n", "key", "score", "rejected", "verdict", "token_ids", "fingerprint", "n_removed", "selected", "component_id", "bits", "label", "root")})


def scratch(spark):
    return Scratch(spark, "test")


def parity(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rel = con.sql(queries.SQL[name])
    at = [rel.columns.index(c) for c in cols]
    assert sorted(rel.columns) == cols
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    assert got and got == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    parity(spark, name)


# shared


@pytest.mark.parametrize("is_word,pattern", [(NOT_SPACE, rb"[^\x20\x09-\x0D]+"), (ALNUM, rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")])
def test_words(is_word, pattern, monkeypatch):
    from cellweave.llm import _text

    monkeypatch.setattr(_text, "STEP", 50)
    texts = ["Hello, wörld  foo\nBar", None, "", "   ", "a" * 200, "x y", "hello", *(" ".join(random.Random(k).choices(WORDS, k=k)) for k in range(30))]
    words, first = word_hashes(*utf8(pa.array(texts)), is_word)
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    seen = {}
    for k, t in enumerate(texts):
        found = re.findall(pattern, (t or "").encode().translate(low))
        assert first[k + 1] - first[k] == len(found)
        for w, h in zip(found, words[first[k] :].tolist()):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_key_filter_keeps_every_key(spark):
    keys = np.random.default_rng(0).integers(-(1 << 62), 1 << 62, 5000)
    df = spark.createDataFrame([(int(k),) for k in keys], "k long")
    for count in (10, 5000):
        assert KeyFilter.build(df, "k", count).has(keys).all()


# 5


def brute_components(rows):
    low = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted((i, len(s), least.get(find(k))) for k, ((i, _), s) in enumerate(zip(rows, sets)) if i is not None)


def edits(seed, n, size, copies):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        base = [f"{w}{r.randrange(50)}" for w in r.choices(WORDS, k=r.choice(size))]
        for _ in range(copies):
            t = list(base)
            for _ in range(r.randrange(4)):
                t[r.randrange(len(t))] = r.choice(WORDS)
            out.append(" ".join(t))
    return list(enumerate(out))


@pytest.mark.parametrize("short,block", [(64, 4096), (3, 4)])
def test_near_duplicates(spark, monkeypatch, short, block):
    monkeypatch.setattr(ngram_join, "SHORT", short)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = edits(3, 25, [1, 3, 5, 6, 8, 9, 12, 14, 40, 90], 6) + [(1000 + i, t) for i, t in enumerate([None, "", "  ", "one", "One", "two words"])]
    shared = " ".join(f"passage{i}" for i in range(60))
    rows += [(2000 + i, f"{t} {shared}") for i, t in edits(5, 12, [60, 80], 1)]
    got = ngram_join.near_duplicates(docs(spark, [(i, t, "s") for i, t in rows]), scratch(spark))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute_components(rows)


@pytest.mark.parametrize("block", [1024, 3])
def test_links_are_counted(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "COUNT_BLOCK", block)
    base = " ".join(f"w{i}" for i in range(80))
    rows = edits(8, 14, [1, 5, 9, 12, 40, 90], 7) + [(500 + i, f"{base} end{i}") for i in range(3)] + [(600, f"{base} end0"), (601, f"{base} end0"), (602, None), (603, "")]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").split()) else set() for _, t in rows]
    want = {i: sum(k != m and 100 * len(sets[k] & s) >= 75 * len(sets[k] | s) for m, s in enumerate(sets) if s) if sets[k] else 0 for k, (i, _) in enumerate(rows)}
    got = ngram_join.near_duplicates(docs(spark, [(i, t, "s") for i, t in rows]), scratch(spark)).collect()
    assert {r.doc_id: r.n_links for r in got} == want
    assert [want[i] for i in (500, 501, 502, 600, 602)] == [4, 4, 4, 4, 0]
    assert block == 3 or "n_links" in ngram_join.op5(spark, SF).columns


def test_near_duplicates_odd(spark):
    got = ngram_join.near_duplicates(odd(spark), scratch(spark)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 12 and by[0].n_shingles == by[1].n_shingles == by[2].n_shingles == 0 and by[1].component_id == 1
    assert by[5].component_id == 4 and by[None].component_id is None
    assert ngram_join.near_duplicates(odd(spark).limit(0), scratch(spark)).count() == 0


def test_light_subsets():
    for n in range(1, 13):
        for m in range(n, 17):
            for both in range(n + 1):
                assert (100 * both >= 75 * (n + m - both)) == (both >= ngram_join.overlap(n, m))
    assert ngram_join.light_boundary({5: 100}, 3.0) >= 5


# 4


def test_wu_manber_matches_find():
    r = random.Random(2)
    for _ in range(30):
        text = bytes(r.choices(b"ab ", k=300))
        patterns = list({bytes(r.choices(b"ab ", k=r.randrange(1, 9))) for _ in range(12)})
        want = sorted((m.start(), m.start() + len(p), k) for k, p in enumerate(patterns) for m in re.finditer(b"(?=" + re.escape(p) + b")", text))
        assert sorted(decontaminate.WuManber(patterns).search(text)) == want


def test_sieve_misses_no_place(spark):
    """Long and short patterns, shifts above 255, hashes that are equal in both engines."""
    r = random.Random(3)
    for least, size in ((1, 4), (12, 30), (300, 400)):
        words = ["".join(r.choices("abé", k=r.randrange(1, 5))) for _ in range(50)]
        text = decontaminate.normal(" ".join(r.choices(words, k=4_000)).encode())
        starts = [i for i, c in enumerate(text) if c == 32 and i + size < len(text)]
        patterns = [text[i : text.index(b" ", i + r.randrange(least, size))  + 1] for i in r.sample(starts[:-200], 30)]
        df = spark.createDataFrame([(p,) for p in patterns], "p binary")
        short = min(map(len, patterns))
        sieve = decontaminate._sieve(df.withColumn("head", F.xxhash64(F.substring("p", 1, short))), short)
        found = [a for a, _ in sieve.places(text)]
        want = {m.start() for p in patterns for m in re.finditer(b"(?=" + re.escape(p) + b")", text)}
        assert want <= set(found) and found == sorted(found) and all(text[a] == 32 for a in found)


def test_contamination_of_many_patterns(spark, monkeypatch):
    """Patterns past the bound: the same rows, whatever the tables' sizes, also of repeated passages and whole copies."""
    r = random.Random(8)
    items = [(i, " ".join(r.choices(WORDS, k=r.randrange(1, 60)))) for i in range(120)] + [(5, None), (None, "a nameless item of five"), (6, items_text := " ".join(r.choices(WORDS, k=500)))]
    texts = [" ".join([*r.choices(WORDS, k=r.randrange(0, 90)), items[r.randrange(120)][1], *r.choices(WORDS, k=r.randrange(0, 90))]) for _ in range(150)]
    rows = [*enumerate(texts), (None, items_text), (None, items_text), (7, items_text + " " + items_text), (8, "Here: a NAMELESS item, of five"), (9, None), (9, "")]
    d, b = docs(spark, [(i, t, "s") for i, t in rows]), spark.createDataFrame(items, "item_id long, text string")
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    want = sorted(map(tuple, decontaminate.contamination(d, b, scratch(spark)).select(columns).collect()), key=repr)
    con = duckdb.connect()
    con.register("documents", d.select("doc_id", "text").toArrow())
    con.register("benchmark", b.toArrow())
    assert want == sorted(con.sql(decontaminate.SQL).fetchall(), key=repr)
    for pieces, words in ((4 << 20, 1 << 23), (500, 1 << 10)):
        monkeypatch.setattr(decontaminate, "PIECES", pieces)
        monkeypatch.setattr(decontaminate.Heads, "MAX_WORDS", words)
        got = decontaminate.contamination(d, b, scratch(spark), group_bytes=0)
        assert sorted(map(tuple, got.select(columns).collect()), key=repr) == want


def test_contamination_in_groups(spark):
    r = random.Random(4)
    items = [(i, " ".join(r.choices(WORDS, k=k))) for i, k in enumerate([20, 14, 13, 3, 1, 40])] + [(7, None), (8, ""), (0, "repeated id with words of its own")]
    texts = ["pre " + items[0][1].upper() + " post", "x " * 400 + items[1][1], "no hit at all", None, "", items[3][1] + "!!! " + items[3][1], items[0][1] + " " + items[5][1]]
    d, b = docs(spark, [(i, t, "s") for i, t in enumerate(texts)]), spark.createDataFrame(items, "item_id long, text string")
    con = duckdb.connect()
    con.register("documents", d.select("doc_id", "text").toArrow())
    con.register("benchmark", b.toArrow())
    want = sorted(con.sql(decontaminate.SQL).fetchall(), key=repr)
    for size in (8 << 20, 200):
        got = decontaminate.contamination(d, b, scratch(spark), group_bytes=size).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
        assert sorted(map(tuple, got.collect()), key=repr) == want
    assert [w[5] for w in sorted(want)][:5] == [True, False, False, False, False]
    assert decontaminate.contamination(odd(spark), b.limit(0), scratch(spark)).where("contaminated").count() == 0
    for size in (8 << 20, 0):
        assert decontaminate.contamination(d.limit(0), b, scratch(spark), group_bytes=size).count() == 0
        assert decontaminate.contamination(odd(spark), b, scratch(spark), group_bytes=size).count() == 12


# 7


def test_urls(spark, monkeypatch):
    urls = [None, "", "no scheme", "http://", "HTTP://Sub.Example.ORG/es/x", "http://example.org", "http://example.org/en/12?q#f", "https://a.com/de/", "x://a.com/de", "http://org/", "http://notexample.org/es/", "http://a.com:80/de/", "http://b?x/y", "http://example.org/en/1"]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(13, urls[13])], "page_id long, url string").withColumn("verdict", F.lit("old"))
    rules = spark.createDataFrame(url_filter.RULES, "verdict string, host string, path string")
    for few in (100_000, 0):
        monkeypatch.setattr(url_filter, "BROADCAST_RULES", few)
        got = url_filter.judge(pages, rules)
        assert got.count() == len(urls) + 1
        by = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got.collect()}
        assert by[0] == by[1] == by[2] == by[3] == ("", "", None, "allow")
        assert by[4] == ("sub.example.org", "/es/x", "example.org/es/", "block")
        assert by[5][1:] == ("", None, "allow") and by[6][2:] == ("example.org/en/1", "block") and by[7][2:] == ("com/de/", "block")
        assert by[8][2:] == (None, "allow") and by[9][2] == "org/" and by[10][2] == "org/" and by[11][2] is None and by[12][:2] == ("b", "")
    assert url_filter.judge(pages, rules.limit(0)).where("verdict <> 'allow'").count() == 0
    assert url_filter.judge(pages.limit(0), rules).count() == 0


# 8


def test_lines(spark):
    site = [f"s{i}" for i in range(12)]
    rows = [(i, f"own line {i}\nShare this page \nmore of {i}", s) for i, s in enumerate(site)] + [(100 + i, "copied body one\ncopied body two", s) for i, s in enumerate(site)] + [(200, "Share this page\nShare this page\na much longer line of its own", None)]
    got = {r.doc_id: r for r in line_dedup.clean(docs(spark, rows).withColumn("n_removed", F.lit(9)), scratch(spark)).collect()}
    assert got[3].text == "own line 3\nmore of 3" and (got[3].n_lines, got[3].n_removed) == (3, 1)
    assert all((got[100 + i].text, got[100 + i].n_removed) == ("", 2) for i in range(12)) and (got[200].text, got[200].n_removed) == ("a much longer line of its own", 2)
    # for a near-duplicate stage that follows, proven copies stay whole
    kept = {r.doc_id: r for r in line_dedup.clean(docs(spark, rows), scratch(spark), keep_copies=True).collect()}
    assert all((kept[100 + i].text, kept[100 + i].n_removed) == ("copied body one\ncopied body two", 0) for i in range(12))
    assert all((kept[i].text, kept[i].n_removed) == (got[i].text, got[i].n_removed) for i in kept if not 100 <= i < 112)
    assert line_dedup.clean(odd(spark), scratch(spark)).where("n_removed > 0").count() == 0
    assert line_dedup.clean(odd(spark).limit(0), scratch(spark)).count() == 0


def test_boilerplate_goes_whatever_its_share(spark):
    import corpus_pipeline as p

    passage, r = " ".join(f"shared{i}" for i in range(60)), random.Random(11)
    own = [" ".join(r.choices(WORDS, k=40)) for _ in range(12)]
    rows = [(i, f"{passage}\n{t}", f"s{i}") for i, t in enumerate(own)] + [(50, f"{passage}\n{own[3]}", "s3")]
    rows += [(100 + i, "copied body one\ncopied body two", f"s{i}") for i in range(12)] + [(200, passage, "s1"), (201, "copied body two", "s2"), (202, None, "s"), (203, "", "s")]
    got = {x.doc_id: x for x in p.lines(spark, docs(spark, rows), SF).collect()}
    assert len(got) == len(rows)
    assert all(got[i].text == t and got[i].n_chars == len(t) for i, t in enumerate(own)) and got[50].text == own[3]
    assert all(got[100 + i].text == "copied body one\ncopied body two" for i in range(12))
    assert got[200].text == got[201].text == got[203].text == "" and got[202].text is None
    # a repeated row is a copy too
    twice = docs(spark, rows + [(200, passage, "s1")])
    assert [x.text for x in p.lines(spark, twice, SF).where("doc_id = 200").collect()] == [passage] * 2
    assert line_dedup.clean(odd(spark).withColumn("copied_", F.lit(-1)), scratch(spark)).where("n_removed > 0").count() == 0


def test_spread_by_sketch_and_exactly(spark):
    rows = [(i, "wide\n" + ("near\n" if i % 40 < 8 else "") + f"own {i}", f"s{i % 40}") for i in range(400)]
    d = docs(spark, rows).select("text", F.col("source").alias("site"))
    assert line_dedup.boilerplate(d, 8).count() == 2 and line_dedup.boilerplate(d, 9).count() == 1 and line_dedup.boilerplate(d, 41).count() == 0


# 10


@pytest.fixture(scope="module")
def pieces():
    return unigram.Pieces.load()


def best(text, p):
    """Summed log score by plain dynamic programming."""
    x, key = (unigram.MARK + text.replace(" ", unigram.MARK)).encode(), {b: i for i, b in enumerate(p.bytes_of) if p.byte_id[b[0] if len(b) == 1 else 0] != i and b}
    top = [0.0] + [-1e18] * len(x)
    for i in range(len(x)):
        if top[i] <= -1e17:
            continue
        width = 1 if x[i] < 0x80 else 2 if x[i] < 0xE0 else 3 if x[i] < 0xF0 else 4
        if x[i : i + width] not in key:
            top[i + width] = max(top[i + width], top[i] + width * unigram.BYTE_SCORE)
        for j in range(i + 1, min(len(x), i + 60) + 1):
            if (k := key.get(x[i:j])) is not None:
                top[j] = max(top[j], top[i] + p.scores[k])
    return top[-1]


def test_viterbi_is_best(pieces):
    coder = unigram.Encoder(pieces)
    for t in ["hello world", "  two  spaces\n\nand lines ", "日本語 \U0001f600", "naïve café ß", "Thntblere of then, edtioner", "x\x00y", "a" * 50]:
        ids = coder.encode(t)
        assert coder.decode(ids) == t
        assert sum(unigram.BYTE_SCORE if pieces.byte_id[pieces.bytes_of[i][0]] == i else pieces.scores[i] for i in ids) == pytest.approx(best(t, pieces))
    assert coder.encode("") == [] and coder.decode([]) == ""


def test_encode_decode(spark, pieces):
    rows = unigram.decode(unigram.encode(odd(spark), pieces), pieces).collect()
    for r in rows:
        if r.text is None:
            assert r.n_tokens == 0 and r.round_trip is None
        else:
            assert r.n_tokens == len(r.token_ids) and (r.decoded == r.text) == r.round_trip == ("▁" not in r.text)
    assert unigram.encode(odd(spark).limit(0), pieces).count() == 0


# 3


def test_order_minhash(spark):
    base = " ".join(random.Random(7).choices(WORDS, k=120))
    near = base.replace("alpha", "omega", 2)
    swapped = base[len(base) // 2 :] + base[: len(base) // 2]
    s = order_minhash.signatures
    assert order_minhash.likeness(s(base), s(base)) == 1 > order_minhash.likeness(s(base), s(near)) > 0.4 > order_minhash.likeness(s(base), s("other " * 50))
    assert order_minhash.likeness(s(base), s(near)) > order_minhash.likeness(s(base), s(swapped))
    for t in (None, "", "ab", "abcdefg", "abcdefgh", "aaaaaaaaaaaaaaaa", base * 40):
        assert len(order_minhash.fingerprint(t)) == 8 * order_minhash.HASHES
    # minima by the definition
    x = order_minhash._items(base)
    h = (x >> np.uint64(32)).astype(np.uint32)
    assert len(set(x.tolist())) == len(x)
    for r in range(3):
        at = np.sort(np.argsort((h ^ order_minhash._SALT32[r]) * order_minhash._ODD32[r], kind="stable")[: order_minhash.PICKED])
        total = order_minhash._SALT[r : r + 1].copy()
        for j, k in enumerate(at):
            total = order_minhash.mix(total + x[k] * order_minhash._CHAR[j])
        assert s(base)[r] == int(total[0] >> np.uint64(32))


@pytest.mark.parametrize("size", [24 << 20, 400])
def test_edited_texts(spark, monkeypatch, size):
    monkeypatch.setattr(order_minhash, "RANGE_BYTES", size)
    r = random.Random(9)
    rows = [(i * 3, " ".join(r.choices(WORDS, k=r.randrange(0, 30))) if i % 7 else None) for i in range(40)]
    r.shuffle(rows)
    got = {x.doc_id: x for x in order_minhash.edited_texts(docs(spark, [(i, t, "s") for i, t in rows])).collect()}
    order = sorted(((i, t or "") for i, t in rows), reverse=True)
    assert len(got) == len(order)
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        new = order_minhash.edit(t, after)
        x = got[i]
        assert (x.n_chars, x.edited_sha256, x.fingerprint, x.edited_fingerprint) == (len(t), hashlib.sha256(new.encode()).hexdigest(), order_minhash.fingerprint(t), order_minhash.fingerprint(new))
        assert x.near_next == order_minhash.likeness(order_minhash.signatures(t), order_minhash.signatures(after))


def next_ones(rows):
    """(doc_id, n_chars, edited hash, likeness to the next) of each row, in the order that the docstring states."""
    order = sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is None, -(x[0] or 0), hashlib.sha256(x[1].encode()).digest()))
    out = []
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        out.append((i, len(t), hashlib.sha256(order_minhash.edit(t, after).encode()).hexdigest(), order_minhash.likeness(order_minhash.signatures(t), order_minhash.signatures(after))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seen", [50_000, 3])
@pytest.mark.parametrize("size", [24 << 20, 400])
def test_edited_texts_of_hot_ids(spark, monkeypatch, size, seen):
    """A third without an id, a third of one id, repeated rows, and the ends of the range of ids."""
    for name, v in (("RANGE_BYTES", size), ("SEEN", seen), ("TOGETHER", 4)):
        monkeypatch.setattr(order_minhash, name, v)
    r = random.Random(10)
    text = lambda: " ".join(r.choices(WORDS, k=r.randrange(1, 20)))
    rows = [(None, text()) for _ in range(60)] + [(7, text()) for _ in range(60)] + [(r.randrange(-50, 50), text()) for _ in range(40)]
    rows += [(7, "the very same row again and again")] * 41 + [(None, None), (None, ""), (-(1 << 63), "least"), ((1 << 63) - 1, "greatest"), (-(1 << 63), "least")]
    r.shuffle(rows)
    got = order_minhash.edited_texts(docs(spark, [(i, t, "s") for i, t in rows])).select("doc_id", "n_chars", "edited_sha256", "near_next").collect()
    assert sorted(map(tuple, got), key=repr) == next_ones(rows)


def test_hot_ids_are_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(order_minhash, "RANGE_BYTES", 4000)
    r = random.Random(11)
    rows = [(None if i % 3 == 0 else 5 if i % 3 == 1 else i, " ".join(r.choices(WORDS, k=16)), "s") for i in range(3000)]
    laid, n = order_minhash._neighbours(docs(spark, rows))
    sizes = sorted(x["count"] for x in laid.where("kind = 0").groupBy("bucket").count().collect())
    assert sum(sizes) == 3000 and n > 60 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    # equal rows leave a task as one, and their repeats are dealt to all ranges
    laid, n = order_minhash._neighbours(docs(spark, rows[:300] + [(5, WORDS[0] * 9, "s")] * 6000))
    assert laid.where("kind = 0").count() < 600 and laid.where("kind = 2").agg(F.sum("count")).first()[0] > 5700


def test_edited_texts_odd(spark):
    assert order_minhash.edited_texts(odd(spark)).count() == 12
    assert order_minhash.edited_texts(odd(spark).limit(0)).count() == 0
    assert order_minhash.fingerprints(odd(spark)).where("length(fingerprint) <> 256").count() == 0


# 2


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 65, 1000])
def test_permutation(n):
    slot = training_order.permute(np.arange(n), n, 99)
    assert sorted(slot.tolist()) == list(range(n)) and (training_order.invert(slot, n, 99) == np.arange(n)).all()
    assert n < 60 or (slot != training_order.permute(np.arange(n), n, 98)).any()


def test_training_order(spark, tmp_path):
    d = odd(spark).repartition(3)
    rows = training_order.training_order(d, scratch(spark), length=64, per_shard=100)
    held = rows.collect()
    assert sorted(r.slot for r in held) == list(range(len(held)))
    assert all(len(r["ids"]) == 128 and r.shard == r.slot // 100 and r.place == r.slot % 100 * 128 for r in held)
    encode = training_order._encoder(training_order.VOCABULARY)
    texts = {}
    for r in sorted((r for r in held if r.doc_id in (3, 6, 8)), key=lambda r: r.sequence):
        texts.setdefault(r.doc_id, []).extend(np.frombuffer(r["ids"], "<u2")[: r.n_tokens].tolist())
    for i, t in ((r.doc_id, r.text) for r in d.select("doc_id", "text").collect()):
        if i in texts:
            assert texts[i][-1] == training_order.END and encode.decode(texts[i][:-1]) == t
    folder = f"file://{tmp_path}/shards"
    files = training_order.write_shards(rows, folder, 64).collect()
    assert sum(f.sequences for f in files) == len(held)
    for r in random.Random(0).sample(held, 20):
        assert training_order.read_from(folder, r.slot, 64, 100).tobytes() == bytes(r["ids"])
    again = {f.shard: f.sha256 for f in training_order.write_shards(rows, folder, 64).collect()}
    assert again == {f.shard: f.sha256 for f in files}
    assert training_order.training_order(d.limit(0), scratch(spark)).count() == 0


def test_order_comes_from_files(spark):
    d, kept = odd(spark).repartition(3).persist(), scratch(spark)
    want = {r.slot: r for r in training_order.training_order(d, scratch(spark), length=64, per_shard=100).collect()}
    rows = training_order.stored_order(d, kept, length=64, per_shard=100)
    got = rows.collect()
    assert sorted(r.slot for r in got) == sorted(want) and None in {r.doc_id for r in got}
    for r in got:
        assert tuple(r)[:-1] == tuple(want[r.slot]) and r.sha256 == hashlib.sha256(r["ids"]).hexdigest()
        assert r.slot % 97 or training_order.read_from(kept.path("shards"), r.slot, 64, 100).tobytes() == bytes(r["ids"])
    first = f"{kept.path('shards').removeprefix('file://')}/shard-000000.bin"
    with open(first, "r+b") as f:
        f.write(b"\xff\xff\xff")
    with pytest.raises(Exception, match="isn't what was written"):
        rows.collect()
    assert training_order.stored_order(d.limit(0), scratch(spark)).count() == 0
    assert "sha256" in training_order.op2(spark, SF).columns


# 1


def test_toxicity_held_out(spark):
    d, l = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    even = F.pmod(F.xxhash64("doc_id"), F.lit(4)) > 0
    model = toxicity.train(d, l.where(even))
    got = toxicity.severity(d.join(l.where(~even), "doc_id"), model).groupBy("toxic", "rejected").count().collect()
    n = {(r.toxic, r.rejected): r["count"] for r in got}
    assert n.get((1, True), 0) >= 0.9 * (n.get((1, True), 0) + n.get((1, False), 0))
    assert n.get((0, True), 0) <= 0.01 * n[0, False]
    assert (np.diff(model.thresholds) >= 0).all()


def test_toxicity_odd(spark):
    model = toxicity.fit(*[np.array(x) for x in ([0, 0, 1, 2, 2, 3], [5, 9, 9, 5, 9, 9], [3, 1, 1, 4, 1, 1])], np.array([1, 0, 2, 0]), epochs=50)
    rows = toxicity.severity(odd(spark), model).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 12 and by[0].score == by[1].score == 0.0 and by[4].score == by[5].score
    assert all(0 <= r.expected_severity <= 2 and len(r.p_at_least) == 2 for r in rows)
    none = toxicity.train(odd(spark), spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.severity(odd(spark), none).where("rejected").count() == 0


# 9


def test_resampling(spark):
    r = random.Random(5)
    rows = [(i, " ".join(r.choices(WORDS[:10] if i % 2 else WORDS[10:], k=40)), "s") for i in range(400)]
    labels = spark.createDataFrame([(i, 1) for i in range(1, 100, 2)] + [(None, 1), (2, None)], "doc_id long, quality int")
    got = importance.resample(docs(spark, rows), labels, scratch(spark), keep=0.25).collect()
    chosen = [x for x in got if x.selected]
    assert len(chosen) == 100 and sum(x.doc_id % 2 for x in chosen) > 90
    assert min(x.gumbel_key for x in chosen) > max(x.gumbel_key for x in got if not x.selected)
    assert all((x.log_weight > 0) == bool(x.doc_id % 2) for x in got)
    some = importance.resample(odd(spark), labels, scratch(spark))
    assert some.count() == 12 and importance.resample(odd(spark).limit(0), labels, scratch(spark)).count() == 0


def test_inclusion_follows_weights(spark):
    """Of four texts, drawn 4,000 times under other ids, each wins as often as its whole-text probability ratio says."""
    texts = ["alpha beta gamma", "alpha", "delta epsilon zeta eta", "theta iota kappa lambda mu nu"]
    ratio = np.random.default_rng(5).normal(0, 0.4, importance.BUCKETS)
    rows = spark.createDataFrame([(4 * i + k, t) for i in range(4000) for k, t in enumerate(texts)], "doc_id long, text string")
    got = importance.weigh(rows, ratio, whole=True).toPandas().sort_values("doc_id")
    weight = got.log_weight.to_numpy()[:4]
    for t, w in zip(texts, weight):
        bucket = importance.ngrams(pa.array([t]))[1]
        assert len(bucket) == 2 * len(t.split()) - 1 and w == pytest.approx(ratio[bucket].sum(), abs=1e-5)
    wins = np.bincount(got.gumbel_key.to_numpy().reshape(-1, 4).argmax(axis=1), minlength=4) / 4000
    true = np.exp(weight) / np.exp(weight).sum()
    assert np.all(np.abs(wins - true) < 4 * np.sqrt(true * (1 - true) / 4000))
    # the mean over a temperature is the default
    mean = importance.weigh(rows.limit(4), ratio).toPandas().sort_values("doc_id").log_weight.to_numpy()
    assert np.allclose(mean * [5, 1, 7, 11], weight, atol=1e-5)


def test_kth_largest(spark):
    x = np.random.default_rng(1).normal(size=3000).round(2)
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    for k in (1, 2, 1500, 2999, 3000, 9999):
        assert importance.kth_largest(df, "v", k) == sorted(x, reverse=True)[min(k, 3000) - 1]
    assert importance.kth_largest(df, "v", 0) is None


# 6


def test_secrets_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    found = scratch(spark).write("candidates", secrets.candidates(d, secrets.dictionary(d)))
    known, even = found.where("label is not null"), F.pmod(F.xxhash64("doc_id"), F.lit(3)) > 0
    got = secrets.classify(known.where(~even), secrets.fit(known.where(even))).agg(F.avg((F.col("is_secret").cast("int") == F.col("label")).cast("double")), F.count("*")).first()
    assert got[0] > 0.98 and got[1] > 50


def test_secrets_odd(spark):
    got = secrets.scan(odd(spark), scratch(spark)).collect()
    assert {r.doc_id for r in got} <= {7, 8}
    assert secrets.scan(odd(spark).limit(0), scratch(spark)).count() == 0


# pipeline


def test_verdicts_belong_to_rows(spark, tmp_path):
    import corpus_pipeline as p

    r = random.Random(12)
    text = [" ".join(r.choices(WORDS, k=60)) for _ in range(5)]
    rows = [(None, text[0], "a"), (None, text[0], "b"), (None, text[1], "a"), (7, text[1], "a"), (9, text[1], "a"), (9, text[2], "a"), (3, text[3], "a"), (3, text[3], "a"), (4, None, "a"), (4, None, "a"), (None, "", "a")]
    got = p.copies(spark, docs(spark, rows), SF).select("doc_id", "text").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(None, text[0]), (7, text[1]), (9, text[2]), (3, text[3]), (4, None), (4, None), (None, "")], key=repr)

    spark.createDataFrame([(1, text[0]), (None, text[1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, text[0], "a"), (None, text[2], "a"), (5, "x " + text[1], "a"), (5, text[3], "a"), (6, text[4], "a"), (6, text[4], "a"), (8, None, "a")]
    got = p.leaks(spark, docs(spark, rows), str(tmp_path)).select("doc_id", "text").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(None, text[2]), (5, text[3]), (6, text[4]), (6, text[4]), (8, None)], key=repr)
    items = spark.read.parquet(f"{tmp_path}/benchmark.parquet")
    for size in (8 << 20, 200):
        found = {x.doc_id: x for x in decontaminate.contamination(docs(spark, [(0, text[1], "a"), (1, text[0], "a")]), items, scratch(spark), group_bytes=size).collect()}
        assert (found[0].n_hit, found[0].n_items, found[0].contaminated) == (60, 0, True) and (found[1].n_hit, found[1].n_items) == (60, 1)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as p

    d = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in p.STAGES] == ["toxicity", "line dedup", "near duplicates", "benchmark leaks", "tokens"]
    now = d
    for k, (_, stage) in enumerate(p.STAGES[:-1]):
        stage(spark, now, SF).write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        assert after.columns == d.columns
        before_ids, ids = ({r.doc_id for r in x.select("doc_id").collect()} for x in (now, after))
        assert ids <= before_ids
        if k == 0:
            rejected = toxicity.severity(now, toxicity.train(now, spark.read.parquet(f"{SF}/labels.parquet"))).where("rejected")
            assert before_ids - ids == {r.doc_id for r in rejected.collect()}
        if k == 1:
            assert ids == before_ids
        if k == 2:
            want = {c for _, _, c in brute_components([(r.doc_id, r.text) for r in now.collect()])}
            assert ids == want
        if k == 3:
            con = duckdb.connect()
            con.register("documents", now.select("doc_id", "text").toArrow())
            con.sql(f"create view benchmark as select * from '{SF}/benchmark.parquet'")
            assert before_ids - ids == {r[0] for r in con.sql(decontaminate.SQL).fetchall() if r[5]}
        now = after
    out = p.run(spark, SF)
    assert out.count() == now.count() and out.where("not round_trip").count() == 0
