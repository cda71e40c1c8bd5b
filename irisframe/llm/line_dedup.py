"""Removal of lines that stand on many sites.

A HyperLogLog sketch of the sites is kept per line hash; sketches merge by
aggregation, within each task first. Lines whose estimate is near the threshold
get an exact distinct count; the others are decided by the sketch. A line on
enough sites is boilerplate and goes from every document.

Copies of a document carry all its lines to their sites. Where documents are
dropped, equal texts therefore count as one site, and a document that is mostly
boilerplate keeps the lines that no such document before it has, so that of a
group of exact or near copies one remains for the near dedup to keep.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from irisframe.llm.common import let, stored

MIN_SITES = 10
#: Estimates within this share of the threshold are counted exactly.
NEAR = 0.3
#: 2**9 registers: a standard error of about 4.6 %, a sixth of the margin.
LOG_REGISTERS = 9
_WORD = "[^ \\t\\n\\x0B\\f\\r]"
#: Stands for a missing doc_id.
_NO_ID = -1 << 63


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n")


def _without(lines: Column, gone: Column) -> Column:
    """The lines between the sorted positions ``gone``, joined again."""
    before = F.concat(F.array(F.lit(-1)), gone)
    after = F.concat(gone, F.array(F.size(lines)))
    return F.array_join(F.flatten(F.zip_with(before, after, lambda a, b: F.slice(lines, a + 2, b - a - 1))), "\n")


def _texts_once(docs: DataFrame, site: str) -> DataFrame:
    """``docs`` without the rows that repeat a text of a smaller doc_id; only line
    hashes move. A text's rows without site leave the place to those with one."""
    hashes = F.transform(F.filter(_lines(F.col("text")), lambda x: x.rlike(_WORD)), lambda x: F.xxhash64(x))
    rows = docs.filter(F.col(site).isNotNull()).select(
        F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("_text"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("_id"),
        F.col(site).cast("string").alias("_site"),
        hashes.alias("_hashes"),
    )
    first = rows.groupBy("_text").agg(F.min(F.struct("_id", "_site")).alias("f")).select("_text", "f.*")
    # The document is part of the key, so copies of one text do not meet in one task.
    return rows.join(first, ["_text", "_id", "_site"], "left_semi")


def line_spread(docs: DataFrame, *, site: str = "source", min_sites: int = MIN_SITES, texts_once: bool = False) -> DataFrame:
    """(line, n_sites) hashes of boilerplate lines: ``n_sites`` is exact near the
    threshold and an estimate above it. Lines without a word are left out. With
    ``texts_once`` equal texts count as one site, that of the smallest doc_id."""
    if texts_once:
        spread = _texts_once(docs, site).select("_site", F.explode("_hashes").alias("line"))
    else:
        spread = (
            docs.select(F.col(site).cast("string").alias("_site"), F.explode(_lines(F.col("text"))).alias("_line"))
            .filter(F.col("_site").isNotNull() & F.col("_line").rlike(_WORD))
            .select("_site", F.xxhash64("_line").alias("line"))
        )
    # Sketches merge inside each task, so a line sends one per task however often it stands there.
    sketched = spread.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("_site", LOG_REGISTERS)).alias("estimate"))
    sketched = stored(sketched.filter(F.col("estimate") >= min_sites * (1 - NEAR)), "line-sketches")
    far = F.col("estimate") > min_sites * (1 + NEAR)
    near = sketched.filter(~far).select("line")
    exact = spread.join(near, "line", "left_semi").distinct().groupBy("line").agg(F.count("*").alias("n_sites"))
    return sketched.filter(far).select("line", F.col("estimate").alias("n_sites")).unionByName(
        exact.filter(F.col("n_sites") >= min_sites)
    )


def _spared(hits: DataFrame) -> DataFrame:
    """``hits`` without the lines that a document keeps: where they are more than half
    of its bytes, those that no other such document with a smaller doc_id has."""
    hits = stored(hits.distinct(), "line-hits")
    mostly = hits.groupBy("_id", "_fp").agg(F.sum("_bytes").alias("lost"), F.max("_of").alias("of")).filter("2 * lost > of")
    held = hits.join(mostly, ["_id", "_fp"], "left_semi")
    # Documents without doc_id come last.
    first = held.groupBy("line").agg(F.min(F.struct((F.col("_id") == _NO_ID).alias("late"), "_id", "_fp")).alias("f"))
    return hits.join(first.select("line", "f._id", "f._fp"), ["_id", "_fp", "line"], "left_anti")


def cut_boilerplate(docs: DataFrame, *, site: str = "source", min_sites: int = MIN_SITES, spare_copies: bool = False) -> DataFrame:
    """Every row with ``_cut``: how many lines went, and ``_text``: what is left.

    Other columns are untouched and come back inside ``_in``. A null text stays
    null; a null site counts towards no line's spread, but its own lines are
    cleaned. Rows are matched by doc_id and text, so repeated rows and rows
    without doc_id are cleaned alike. With ``spare_copies`` equal texts count as one
    site, and of documents that are mostly boilerplate the first keeps its lines.
    """
    common = stored(line_spread(docs, site=site, min_sites=min_sites, texts_once=spare_copies), "line-common")
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("_id"), F.xxhash64("text").alias("_fp")]
    sizes = [F.octet_length("_line").cast("long").alias("_bytes"), "_of"] if spare_copies else []
    hits = (
        docs.select(*key, F.octet_length("text").alias("_of"), F.posexplode(_lines(F.col("text"))).alias("_at", "_line"))
        .filter(F.col("_line").rlike(_WORD))
        .select("_id", "_fp", "_at", F.xxhash64("_line").alias("line"), *sizes)
        .join(common.select("line"), "line", "left_semi")
    )
    hits = (_spared(hits) if spare_copies else hits).groupBy("_id", "_fp").agg(F.collect_set("_at").alias("_gone"))
    rows = docs.select(F.struct("*").alias("_in"), *key).join(hits, ["_id", "_fp"], "left")
    text = F.col("_in.text").cast("string")
    left = let(_lines(text), lambda lines: let(F.array_sort("_gone"), lambda gone: _without(lines, gone)))
    return rows.select(
        "_in",
        F.when(F.col("_gone").isNull(), text).otherwise(left).alias("_text"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("_cut"),
    )


def drop_boilerplate(docs: DataFrame) -> DataFrame:
    """Documents with the remaining text; those that lost every word are dropped.
    The first of a group of copies keeps its lines."""
    cut = cut_boilerplate(docs, spare_copies=True)
    kept = cut.filter((F.col("_cut") == 0) | F.col("_text").rlike(_WORD))
    new = {
        "text": F.col("_text"),
        "n_chars": F.when(F.col("_cut") == 0, F.col("_in.n_chars")).otherwise(F.char_length("_text").cast("long"))
        if "n_chars" in docs.columns
        else None,
    }
    return kept.select(*[new[c].alias(c) if new.get(c) is not None else F.col(f"_in.`{c}`") for c in docs.columns])
