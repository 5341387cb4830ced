"""Operator 8. Boilerplate lines by their spread over sites.

A line (trimmed of spaces) is boilerplate when it stands on at least ``MIN_SITES`` distinct sites. One
aggregation counts each line and merges HyperLogLog sketches of its sites, map-side and again after the shuffle,
so that a line of many rows reaches the reducer as one row from each task. Sketches within ``BAND`` of the
threshold are settled by an exact distinct count. Boilerplate lines go from every document whatever their share
of it; a text of nothing else becomes empty. Where a near-duplicate stage follows, ``keep_copies`` leaves proven
copies whole for that: texts of nothing but boilerplate lines whose set of lines another row has too.

Null texts stay null, empty lines are never boilerplate, a null site is one site of its own. Repeated rows
are each cleaned alike. Texts of any length are read and cleaned whole; an empty table gives no rows. A line on just
``min_sites`` sites is boilerplate. Lines are known by 64-bit hashes: a line is taken for another one with a chance of
about the number of boilerplate lines in 2^64. Input columns named like results are replaced; all others are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm._shared import Scratch, table

MIN_SITES = 8
#: log2 of a sketch's registers, and the relative distance from the threshold at which its error can matter
LOG_K = 10
BAND = 0.15
#: so many boilerplate lines (8 bytes each) go to every executor; more meet the texts' lines in a shuffle
BROADCAST_LINES = 1 << 20


def _lines(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), lambda x: F.trim(x))


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``(line)``: hashes of the lines on at least ``min_sites`` sites of ``docs(text, site)``."""
    lines = docs.select(F.coalesce("site", F.lit("")).alias("site"), F.explode(F.array_distinct(_lines(F.col("text")))).alias("own")).where("own <> ''").select(F.xxhash64("own").alias("line"), "site")
    spread = lines.groupBy("line").agg(F.count("*").alias("c"), F.hll_sketch_agg("site", F.lit(LOG_K)).alias("sketch")).where(F.col("c") >= min_sites).select("line", F.hll_sketch_estimate("sketch").alias("sites"))
    low, high = min_sites * (1 - BAND) - 1, min_sites * (1 + BAND) + 1
    # made distinct first: a line near the threshold then has few rows, however many it had
    near = lines.distinct().join(spread.where(f"sites between {low} and {high}").select("line"), "line").groupBy("line").agg(F.count("*").alias("sites"))
    return spread.where(f"sites > {high}").select("line").union(near.where(f"sites >= {min_sites}").select("line"))


def _hits(docs: DataFrame, bad: DataFrame, scratch: Scratch, keep_copies: bool) -> DataFrame:
    """``(hit_id, hit_key, lines, copied)``: the boilerplate lines of a text, and whether it is a proven copy."""
    own = F.array_distinct(F.filter(_lines(F.col("text")), lambda x: x != ""))
    held = docs.select("doc_id", F.xxhash64("text").alias("key"), own.alias("own")).select("doc_id", "key", F.size("own").alias("n_own"), F.explode("own").alias("own")).select("doc_id", "key", "n_own", F.xxhash64("own").alias("line"))
    hits = held.join(F.broadcast(bad) if bad.count() <= BROADCAST_LINES else bad, "line").groupBy(F.col("doc_id").alias("hit_id"), F.col("key").alias("hit_key")).agg(F.collect_set("line").alias("lines"), F.max("n_own").alias("n_own"), F.count("*").alias("c"))
    # each of the repeated rows behind a group brings every line once
    hits = hits.select("hit_id", "hit_key", "lines", F.when(F.size("lines") == F.col("n_own"), F.xxhash64(F.array_sort("lines"))).alias("set"), (F.col("c") / F.size("lines")).alias("rows"))
    if not keep_copies:
        return hits.select("hit_id", "hit_key", "lines", F.lit(False).alias("copied"))
    hits = scratch.write("hits", hits)
    copies = hits.where("set is not null").groupBy("set").agg(F.sum("rows").alias("rows")).where("rows > 1").select("set", F.lit(True).alias("copied"))
    return hits.drop("rows").join(copies, "set", "left").select("hit_id", "hit_key", "lines", F.coalesce("copied", F.lit(False)).alias("copied"))


def clean(docs: DataFrame, scratch: Scratch, min_sites: int = MIN_SITES, keep_copies: bool = False) -> DataFrame:
    """``docs(doc_id, text, source, ...)`` with the text cleaned, and n_lines, n_removed; proven copies as they are with ``keep_copies``."""
    bad = scratch.write("boilerplate", boilerplate(docs.select("text", F.col("source").alias("site")), min_sites))
    hits = _hits(docs.select("doc_id", "text"), bad, scratch, keep_copies)
    docs = docs.drop("n_lines", "n_removed")
    # the input's columns travel in one, so no name of theirs can meet one of ours
    held = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64("text").alias("key"))
    # hits grow with the documents, so they are joined in one way at every size
    joined = held.join(hits.hint("merge"), F.col("row.doc_id").eqNullSafe(F.col("hit_id")) & (F.col("key") == F.col("hit_key")), "left")
    all_lines, cut = F.split("row.text", "\n"), F.col("lines").isNotNull() & ~F.col("copied")
    kept = F.filter(all_lines, lambda x: ~F.array_contains("lines", F.xxhash64(F.trim(x))))
    made = joined.select("row", F.coalesce(F.size(all_lines), F.lit(0)).cast("long").alias("n_lines"), F.size(all_lines).alias("n"), F.when(cut, kept).alias("kept"))
    text = F.when(F.col("kept").isNotNull(), F.array_join("kept", "\n")).otherwise(F.col("row.text"))
    return made.select(*[text.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns], "n_lines", F.coalesce(F.col("n") - F.size("kept"), F.lit(0)).cast("long").alias("n_removed"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return clean(docs, Scratch(spark, "op8")).select("doc_id", "text", "n_lines", "n_removed")


def sql(docs: str = "documents", min_sites: int = MIN_SITES, keep_copies: bool = False) -> str:
    """The cleaned rows of a table ``docs`` with columns doc_id, text, source, in DuckDB's SQL."""
    return f"""
with lines as (select doc_id, text, source, unnest(string_split(text, chr(10))) as raw from {docs}),
bad as (select trim(raw, ' ') as line from lines where trim(raw, ' ') <> '' group by 1 having count(distinct coalesce(source, '')) >= {min_sites}),
badset as (select coalesce(list(line), []) as b from bad),
cut as (select d.*, string_split(text, chr(10)) as parts, list_filter(string_split(text, chr(10)), lambda x: not list_contains(b, trim(x, ' '))) as kept,
               list_sort(list_distinct(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> ''))) as own from {docs} d, badset),
proven as (select own from cut where len(own) > 0 and len(list_filter(kept, lambda x: trim(x, ' ') <> '')) = 0 and {keep_copies} group by own having count(*) > 1),
done as (select c.*, len(parts) > len(kept) and o.own is null as go from cut c left join proven o on o.own = c.own)
select doc_id, case when go then array_to_string(kept, chr(10)) else text end as text, cast(coalesce(len(parts), 0) as bigint) as n_lines,
       cast(case when go then len(parts) - len(kept) else 0 end as bigint) as n_removed from done
"""


SQL = sql()
