"""Quality rules judged per document and per host.

Each document is held against the base rules. A host's failure rate is shrunk
towards an empirical beta prior fitted to all hosts, so a host with few pages is
not condemned by one of them; a host whose shrunk rate is too high loses its
remaining documents as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from irisframe.llm.common import WHITE, let, stored

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MAX_HOST_RATE = 0.5
PRIOR_STRENGTH = (2.0, 1000.0)
WINDOW = 8
_SPACE = "[ \\t\\n\\x0B\\f\\r]+"
_NOT_SPACE = "[^ \\t\\n\\x0B\\f\\r]"
_SYMBOLS = "[#*$%&|<>]"


def _pairs(hashes: Column, step: int) -> Column:
    """Hash of every element with the one ``step`` places on."""
    size = F.greatest(F.size(hashes) - step, F.lit(0))
    return F.zip_with(F.slice(hashes, F.lit(1), size), F.slice(hashes, F.lit(step + 1), size), lambda a, b: F.xxhash64(a, b))


def _repeated(windows: Column) -> Column:
    """Words inside windows whose hash occurs twice or more."""

    def covered(ordered: Column) -> Column:
        same = lambda x, k: F.coalesce(x["h"] == F.get(ordered, k)["h"], F.lit(False))
        twice = F.filter(ordered, lambda x, i: same(x, i - 1) | same(x, i + 1))
        starts = F.array_sort(F.transform(twice, lambda x: x["i"]))
        return let(
            starts,
            lambda p: F.aggregate(
                F.zip_with(p, F.slice(p, F.lit(2), F.size(p)), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW)))),
                F.lit(0).cast("long"),
                lambda total, x: total + x,
            ),
        )

    positioned = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(
        let(positioned, covered)
    )


def base_measures(text: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of whole texts."""
    raw = F.coalesce(text.cast("string"), F.lit(""))
    trimmed = F.btrim(raw, F.lit(WHITE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _SPACE))
    lines = F.filter(F.split(raw, "\n"), lambda x: x.rlike(_NOT_SPACE))

    def of_words(w: Column) -> Column:
        eight = let(let(let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: _pairs(h, 1)), lambda h: _pairs(h, 2)), lambda h: _pairs(h, 4))
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            let(eight, _repeated).alias("n_repeat_words"),
        )

    return {
        "_words": let(words, of_words),
        "n_symbols": F.regexp_count(raw, F.lit(_SYMBOLS)).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    }


def measured(docs: DataFrame, *, host: str, payload: list[str]) -> DataFrame:
    """The chosen columns of every row as ``_in`` with measures and base verdict, stored."""
    rows = docs.select(
        F.struct(*[F.col(c) for c in payload]).alias("_in"),
        F.col(host).cast("string").alias("_host"),
        F.struct(*[c.alias(n) for n, c in base_measures(F.col("text")).items()]).alias("_m"),
    ).select("_in", "_host", "_m._words.*", "_m.n_symbols", "_m.n_dup_lines")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return stored(rows.withColumn("base_failed", failed), "host-rules")


def host_verdicts(rows: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Per host: documents, failures, shrunk failure rate and verdict.

    The prior is a beta distribution with the mean of all hosts' rates and, by
    the method of moments, the spread that sampling alone does not explain.
    """
    hosts = rows.filter(F.col("_host").isNotNull()).groupBy("_host").agg(
        F.count("*").alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed")
    )
    hosts = stored(hosts, "hosts").withColumn("rate", F.col("n_failed") / F.col("n_docs"))
    mean, spread, small = hosts.agg(F.avg("rate"), F.var_pop("rate"), F.avg(1 / F.col("n_docs"))).first()
    if mean is None:
        mean, spread, small = 0.0, 0.0, 0.0
    own = mean * (1 - mean)
    between = spread - own * small
    low, high = PRIOR_STRENGTH
    strength = min(high, max(low, own / between - 1)) if between > 0 else high
    shrunk = (F.col("n_failed") + mean * strength) / (F.col("n_docs") + strength)
    return hosts.select("_host", "n_docs", "n_failed", shrunk.alias("host_rate"), (shrunk > max_rate).alias("host_rejected"))


def judge(docs: DataFrame, *, host: str = "source", payload: list[str], max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """All rows with their measures, ``base_failed``, ``host_rate`` and ``kept``.

    A null or empty text has no words and fails; a row without host is judged by
    its own text alone. Repeated rows are judged one by one. Input columns come
    back inside ``_in``, so that their names cannot clash.
    """
    rows = measured(docs, host=host, payload=payload)
    verdicts = host_verdicts(rows, max_rate).select(F.col("_host").alias("_h"), "host_rate", "host_rejected")
    joined = rows.join(verdicts, F.col("_host") == F.col("_h"), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.coalesce("host_rejected", F.lit(False))).drop("_h", "_host", "host_rejected")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns."""
    return judge(docs, payload=docs.columns).filter("kept").select("_in.*")
