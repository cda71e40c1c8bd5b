"""Host rules, line removal and ring shards on small tables with odd rows."""

import random
from collections import Counter

import pytest
from pyspark.sql import types as T

from irisframe.llm import host_rules, line_dedup, ring
from irisframe.llm.common import stored

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("_in", T.StringType()),  # a clashing name
    ]
)


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x") for i, t, s in rows], SCHEMA)


def odd_rows():
    words = " ".join(f"w{i}" for i in range(40))
    return [
        (1, None, "a"),
        (2, "", None),
        (None, words, "a"),
        (3, words, "a"),
        (3, words, "a"),
        (4, "one two three four five six seven eight " * 300, "b"),
        (5, "long " + " ".join(f"x{i}" for i in range(60_000)), "b"),
        (6, "\n \n same line\n same line\n\tsame line\n#$ |", "b"),
    ]


def plain_measures(text):
    words = (text or "").encode().split()
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return (
        len(words),
        sum(len(w.decode()) for w in words),
        sum(c in "#*$%&|<>" for c in text or ""),
        len(lines) - len(set(lines)),
        len(covered),
    )


def test_measures(spark):
    rows = odd_rows() + [(7, "a b c d e f g h x a b c d e f g h a b c d e f g h", "é"), (8, "ü é  ñ\x0b\x0cz", "é")]
    got = host_rules.judge(table(spark, rows), payload=["doc_id", "text", "_in"]).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_measures(r["_in"]["text"])
        assert not (r.base_failed and r.kept)


def test_bad_host_takes_its_documents_along(spark):
    good = " ".join(f"w{i}" for i in range(40))
    rows = [(i, good, f"h{i % 10}") for i in range(200)] + [(1000 + i, "short", "bad") for i in range(30)] + [(2000, good, "bad")]
    kept = {r.doc_id for r in host_rules.keep_good(table(spark, rows)).collect()}
    assert kept == set(range(200))
    assert host_rules.keep_good(table(spark, rows)).columns == SCHEMA.names


def test_empty_tables(spark):
    empty = table(spark, [])
    assert host_rules.keep_good(empty).count() == 0
    assert line_dedup.drop_boilerplate(empty).count() == 0
    assert ring.shard_documents(empty).count() == 0


def test_lines_on_many_sites_go(spark):
    rows = [(i, f"own {i}\nshared by ten\nalmost\n\nown too {i}" if i < 9 else f"own {i}\nshared by ten", f"s{i}") for i in range(10)]
    rows += [(None, "shared by ten", "s1"), (50, None, "s1"), (51, "", None), (52, "shared by ten\nmine", None), (1, rows[1][1], "s1")]
    cut = line_dedup.cut_boilerplate(table(spark, rows)).select("_in.doc_id", "_text", "_cut").collect()
    assert len(cut) == len(rows)
    by = {r.doc_id: r for r in cut}
    assert by[0]._text == "own 0\nalmost\n\nown too 0" and by[0]._cut == 1
    assert by[52]._text == "mine" and by[50]._text is None and by[51]._text == "" and by[None]._text == ""
    kept = line_dedup.drop_boilerplate(table(spark, rows))
    assert kept.columns == SCHEMA.names
    assert {r.doc_id for r in kept.collect()} == {*range(10), 50, 51, 52}


def test_exact_pairs_only_near_the_threshold(spark, monkeypatch):
    """Lines are stored as sketches; no table of every line's sites is made."""
    made = []
    monkeypatch.setattr(line_dedup, "stored", lambda df, purpose: made.append(df.columns) or stored(df, purpose))
    rows = [(i, f"own {i}\non all" + "\non ten" * (i < 10) + "\non nine" * (i < 9), f"s{i}") for i in range(60)]
    found = {r.line: r.n_sites for r in line_dedup.line_spread(table(spark, rows)).collect()}
    hashes = spark.sql("SELECT xxhash64('on all') AS a, xxhash64('on ten') AS t").first()
    assert set(found) == {hashes.a, hashes.t} and found[hashes.t] == 10
    assert made == [["line", "estimate"]]


def test_copies_on_many_sites_keep_one(spark):
    text = "\n".join(" ".join(f"w{i}x{j}" for j in range(9)) for i in range(12))
    exact = [(i, text, f"s{i % 15}") for i in range(30)]
    exact += [(None, text, "s3"), (40, "quoted\nown words " * 40 + "\n" + text.split("\n")[0], "s2")]
    kept = {r.doc_id: r.text for r in line_dedup.drop_boilerplate(table(spark, exact)).collect()}
    assert kept[0] == text and kept[40] == exact[-1][1]
    # Near copies are different texts: with an odd line of their own, or with a blank line.
    for odd in (lambda i: f"\nodd {i}", lambda i: "\n" + " " * i):
        near = [(i, text + odd(i), f"s{i % 15}") for i in range(30)]
        kept = {r.doc_id: r.text for r in line_dedup.drop_boilerplate(table(spark, near)).collect()}
        assert kept[0] == near[0][1] and not any("w0x0" in t for i, t in kept.items() if i)
    # The registered query goes by its SQL: copies count, and lines go from every row.
    assert all(r._cut == 12 for r in line_dedup.cut_boilerplate(table(spark, exact[:30])).collect())


@pytest.mark.parametrize("rows", [0, 1, 7, 1000])
def test_ring_bounds(spark, rows):
    out = ring.shard_documents(table(spark, [(i, "é" * (i % 5), "s") for i in range(rows)])).collect()
    sizes = Counter(r.shard for r in out)
    counts = [sizes[s] for s in range(8)]
    assert sum(counts) == rows and max(counts) - min(counts) <= 1
    for s in range(8):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sizes[s]))
    assert all(r["size"] == 1 + len(("é" * (r.doc_id % 5)).encode()) for r in out)


def test_ring_odd_rows(spark):
    out = ring.shard_documents(table(spark, odd_rows())).collect()
    assert len(out) == 8 and max(Counter(r.shard for r in out).values()) == 1


def test_ring_walk_matches_key_by_key():
    """The walk over cell counts ends like sending one key after another."""
    rng = random.Random(3)
    owners = ring.ring_owners(4, 8, 6)
    counts = {c: rng.randrange(9) for c in range(64)}
    total = sum(counts.values())
    capacity = [total // 4 + (s < total % 4) for s in range(4)]
    room, expected = list(capacity), Counter()
    late = []
    for c in range(64):
        for _ in range(counts[c]):
            if room[owners[c]]:
                room[owners[c]] -= 1
                expected[c, owners[c]] += 1
            else:
                late.append(c)
    for c in late:
        at = c
        while not room[owners[at % 64]]:
            at += 1
        room[owners[at % 64]] -= 1
        expected[c, owners[at % 64]] += 1
    got = Counter()
    for c, lo, hi, shard, _ in ring.walk_clockwise(counts, owners, 64, capacity):
        got[c, shard] += hi - lo
    assert +got == expected


def test_ring_moves_little():
    before, after = ring.ring_owners(8), ring.ring_owners(9)
    moved = [(a, b) for a, b in zip(before, after) if a != b]
    assert all(b == 8 for _, b in moved) and len(moved) < len(before) / 5
