"""The pipeline against brute force, stage by stage."""

from collections import defaultdict

from pyspark.sql import functions as F

import corpus_pipeline

from .test_native import odd_rows, plain_measures, table
from .test_payloads import FOLDER, check_pieces
from .test_repeats import linked_components, removed_words


def brute_force(rows):
    """(doc_id, text) after all stages but packing; hosts are all acceptable here."""
    kept = []
    for i, text, site in rows:
        n_words, _, _, _, repeated = plain_measures(text)
        if n_words >= 20 and 100 * repeated <= 30 * n_words:
            kept.append((i, text, site))
    sites = defaultdict(set)
    for _, text, site in kept:
        for line in text.split("\n"):
            if line.encode().split():
                sites[line].add(site)
    lines = [(i, "\n".join(x for x in t.split("\n") if len(sites[x]) < 10), s) for i, t, s in kept]
    lines = [r for r, old in zip(lines, kept) if r[1] == old[1] or r[1].encode().split()]
    labels = linked_components(lines)
    alone = [r for r in lines if labels[r[0]][1] == r[0]]
    passages = removed_words(alone)
    out = []
    for i, text, _ in alone:
        left = passages[i].decode()
        if left or not text.encode().split():
            out.append((i, text if len(left.split()) == len(text.encode().split()) else left))
    return out


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    expected = brute_force(rows)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted((r.doc_id, r.text) for r in docs.collect()) == sorted(expected)
    assert docs.filter(F.col("n_chars") != F.char_length("text")).count() == 0
    packed = corpus_pipeline.run(spark, FOLDER).collect()
    assert check_pieces(packed, expected) < 0.05


def test_stages_take_odd_and_empty_tables(spark):
    for rows in (odd_rows(), []):
        docs = table(spark, rows)
        for _, stage in corpus_pipeline.STAGES:
            found = stage(spark, docs, FOLDER)
            found.count()
            docs = found if found.columns == docs.columns else docs


def test_stages_remove_what_earlier_ones_stored(spark, tmp_path):
    """Tables of a stage go when the next one works on its written result, and stay
    while its result is not written."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    (_, rules), (_, lines), (_, near), (_, passages), _ = corpus_pipeline.STAGES
    rules(spark, docs, FOLDER).write.parquet(f"{tmp_path}/a")
    lines(spark, spark.read.parquet(f"{tmp_path}/a"), FOLDER).write.parquet(f"{tmp_path}/b")
    unwritten = near(spark, spark.read.parquet(f"{tmp_path}/b"), FOLDER)
    stored = list(corpus_pipeline._held)
    assert stored
    last = passages(spark, unwritten, FOLDER)
    assert unwritten.count() and last.count()
    last.write.parquet(f"{tmp_path}/c")
    rules(spark, spark.read.parquet(f"{tmp_path}/c"), FOLDER).count()
    assert not any(path in corpus_pipeline._held for path in stored)
