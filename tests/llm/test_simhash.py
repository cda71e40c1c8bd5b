"""SimHash fingerprints and their components against plain versions."""

import random

import pytest
import xxhash

from irisframe.llm import queries, simhash

from .test_native import odd_rows, table
from .test_payloads import FOLDER


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """{node: smallest node reachable} over (node, fingerprint) rows."""
    parent = {n: n for n, _ in prints}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for i, (a, x) in enumerate(prints):
        for b, y in prints[:i]:
            if (x ^ y).bit_count() <= 2:
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {n: root(n) for n, _ in prints}


def check(found, rows):
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    labels = plain_components(prints)
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in found) == sorted((i, f"{x:016x}", labels[i]) for i, x in prints)


def test_simhash_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    check(queries.op12_simhash_near_dedup(spark, FOLDER).collect(), rows)


def test_near_copies_and_ties(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(900)}" for _ in range(400)]
    texts = [" ".join(base)] * 20
    for _ in range(60):
        words = list(base)
        words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    texts += [None, "", " \n", "one", "One", "one two", "A b c", "a\tB  c", "a b c a b c"] + [" ".join(rng.choices("abcdef", k=rng.randint(1, 5))) for _ in range(120)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    check(simhash.near_duplicates(table(spark, [(i, t, "s") for i, t in rows])).collect(), rows)


@pytest.mark.parametrize("crowd", [1, 3, 64])
def test_links_of_crowded_keys(spark, monkeypatch, crowd):
    """Joined pairs and midpoints find the same components, for any crowd."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = random.Random(crowd)
    prints = {0, (1 << 64) - 1, 1 << 63, 3, 7, 15}
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(50):
            x = centre
            for _ in range(rng.randint(0, 5)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    rows = [(i, x) for i, x in enumerate(sorted(prints, key=lambda x: x * 0x9E3779B97F4A7C15 % (1 << 64)))]
    signed = [(i, x - (1 << 64) if x >> 63 else x) for i, x in rows]
    links = simhash.fingerprint_links(spark.createDataFrame(signed, "first long, fp long"))
    by_id = dict(rows)
    assert all((by_id[r.a] ^ by_id[r.b]).bit_count() <= 2 for r in links.collect())
    labels = {r.node: r.component for r in simhash.components(links).collect()}
    assert {i: labels.get(i, i) for i, _ in rows} == plain_components(rows)


def test_masks_keep_close_pairs_together():
    masks = [m % (1 << 64) for m in simhash.block_masks()]
    assert len(masks) == 10 and all(37 <= m.bit_count() <= 40 for m in masks)
    for i in range(64):
        for j in range(64):
            assert any(not m & (1 << i | 1 << j) for m in masks)


def test_simhash_odd_rows(spark):
    found = simhash.near_duplicates(table(spark, odd_rows())).collect()
    rows = sorted({(i, t) for i, t, _ in odd_rows() if i is not None}, key=lambda r: r[0])
    check([r for r in found if r.doc_id is not None], rows)
    (alone,) = [r for r in found if r.doc_id is None]
    assert alone.component_id is None and alone.fingerprint == f"{plain_fingerprint(dict((i, t) for i, t, _ in odd_rows())[None]):016x}"
    assert simhash.near_duplicates(table(spark, [])).count() == 0
