"""Near copies, repeated passages and repeated bytes against brute force."""

import hashlib
import random
from collections import defaultdict

import pytest

from irisframe.llm import components, minhash, substring, suffix, suffix_dedup

from .test_native import odd_rows, table


def corpus(seed=5, docs=120):
    """Documents of few words with passages, near copies and exact copies shared."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["Été", "中文"]
    fresh = lambda n: [rng.choice(words) for _ in range(n)]
    passages = [fresh(rng.randrange(45, 140)) for _ in range(6)]
    bases = [fresh(rng.randrange(80, 300)) for _ in range(5)]
    out = []
    for i in range(docs):
        kind = rng.randrange(5)
        text = fresh(rng.randrange(0, 120))
        if kind == 1:
            text = text + rng.choice(passages) + fresh(30)
        elif kind == 2:
            text = list(rng.choice(bases))
            for _ in range(rng.randrange(0, 8)):
                text[rng.randrange(len(text))] = rng.choice(words)
        elif kind == 3:
            text = rng.choice(passages)[:70] + rng.choice(passages)
        elif kind == 4:
            text = rng.choice(bases)
        out.append((i * 3, rng.choice((" ", "\n", " \t")).join(text), f"s{i % 4}"))
    rng.shuffle(out)
    return out


def removed_words(rows, window=50):
    first = {}
    words = {i: (t or "").encode().split() for i, t, _ in rows}
    for i in sorted(words):
        for k in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][k : k + window]), i)
    out = {}
    for i, w in words.items():
        gone = {j for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] < i for j in range(k, k + window)}
        out[i] = b" ".join(x for j, x in enumerate(w) if j not in gone)
    return out


def removed_bytes(rows, length=100):
    seen, out = set(), {}
    for i, text, _ in sorted(rows):
        raw = (text or "").encode()
        gone = bytearray(len(raw) + 1)
        for k in range(len(raw) - length + 1):
            if raw[k : k + length] in seen:
                gone[k : k + length] = b"\1" * length
            seen.add(raw[k : k + length])
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(raw)))
        out[i] = (len(raw), sum(gone), spans, bytes(b for b, g in zip(raw, gone) if not g))
    return out


def linked_components(rows):
    sets = {}
    for i, t, _ in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    ids = sorted(sets)
    changed = True
    while changed:
        changed = False
        for x in ids:
            for y in ids:
                if sets[x] and sets[y] and label[x] != label[y] and 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y]):
                    label[x] = label[y] = min(label[x], label[y])
                    changed = True
    return {i: (len(sets[i]), label[i]) for i in ids}


@pytest.mark.parametrize("shard", [400_000, 150])
def test_passages(spark, monkeypatch, shard):
    monkeypatch.setattr(substring, "SHARD_WORDS", shard)
    rows = corpus() + [(1001, None, "s"), (1002, "", "s"), (1003, "ab " * 3000, "s"), (1004, "x " + "ab " * 60, "s")]
    expected = removed_words(rows)
    got = substring.cut_passages(table(spark, rows)).select("_in.doc_id", "_n_words", "_n_removed", "_kept_sha256").collect()
    assert len(got) == len(rows)
    for r in got:
        assert r._kept_sha256 == hashlib.sha256(expected[r.doc_id]).hexdigest()
        assert r._n_words - r._n_removed == len(expected[r.doc_id].split())
    kept = substring.drop_passages(table(spark, rows))
    assert kept.columns[-1] == "_in"
    lost = {i for i, t, _ in rows if (t or "").split() and not expected[i]}
    assert lost and {r.doc_id for r in kept.collect()} == {i for i, _, _ in rows} - lost


@pytest.mark.parametrize("shard", [3 << 20, 2000])
def test_bytes(spark, monkeypatch, shard):
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", shard)
    rows = corpus(7) + [(1001, None, "s"), (1002, "", "s"), (1003, "ab" * 2000, "s"), (1004, "é" * 130, "s"), (1005, "a" * 99, "s"), (1006, "a" * 99, "s")]
    expected = removed_bytes(rows)
    got = suffix_dedup.cut_repeats(table(spark, rows)).select("_in.doc_id", "_n_bytes", "_n_removed", "_n_spans", "_kept").collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r._n_bytes, r._n_removed, r._n_spans, bytes(r._kept)) == expected[r.doc_id]


@pytest.mark.parametrize("block", [1000, 3])
def test_near_copies(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = corpus(9) + [(1001, None, "s"), (1002, " \n", "s"), (1003, "Two Words", "s"), (1004, "two\twords", "s")]
    expected = linked_components(rows)
    got = minhash.judge(table(spark, rows)).select("_in.doc_id", "_n_shingles", "_component_id", "_kept").collect()
    assert {r.doc_id: (r._n_shingles, r._component_id) for r in got} == expected
    assert all(r._kept == (r.doc_id == r._component_id) for r in got)
    assert len(minhash.drop_near_duplicates(table(spark, rows)).collect()) == len({c for _, c in expected.values()})


def test_near_copies_that_only_meet_late(spark):
    """A chain whose ends are unlike, and two groups of one list joined by a third text."""
    rng = random.Random(1)
    text = [f"t{i}" for i in range(120)]
    rows = []
    for i in range(25):
        rows.append((100 - i, " ".join(text), "s"))
        text[(i * 7) % 120 : (i * 7) % 120 + 2] = [f"n{rng.random()}" for _ in range(2)]
    expected = linked_components(rows)
    got = minhash.near_duplicates(table(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == expected


def test_components(spark):
    rng = random.Random(8)
    chain = [(i, i + 1) for i in range(0, 60)]
    links = chain + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(500, i) for i in range(501, 540)]
    label = {n: n for pair in links for n in pair}
    for _ in range(len(label)):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    rng.shuffle(links)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: c for n, c in label.items() if n != c}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(spark):
    rows = odd_rows()
    words = substring.cut_passages(table(spark, rows)).collect()
    raw = suffix_dedup.cut_repeats(table(spark, rows)).collect()
    near = minhash.judge(table(spark, rows)).collect()
    assert len(words) == len(raw) == len(near) == len(rows)
    assert [r for r in words if r["_in"]["doc_id"] is None][0]._n_removed == 0
    assert len({r._n_removed for r in raw if r["_in"]["doc_id"] == 3}) == 1
    assert [r for r in near if r["_in"]["doc_id"] is None][0]._kept
    for run in (substring.cut_passages, suffix_dedup.cut_repeats, minhash.judge):
        assert run(table(spark, [])).count() == 0


def test_versions_of_a_document(spark):
    one, two = " ".join(f"a{i}" for i in range(90)), " ".join(f"b{i}" for i in range(90))
    rows = [(1, one, "s"), (2, one, "s"), (2, two, "s")]
    cut = {(r["_in"]["doc_id"], r["_in"]["text"]): r._n_removed for r in substring.cut_passages(table(spark, rows)).collect()}
    assert cut == {(1, one): 0, (2, one): 90, (2, two): 0}
    cut = {(r["_in"]["doc_id"], r["_in"]["text"]): r._n_removed for r in suffix_dedup.cut_repeats(table(spark, rows)).collect()}
    assert cut == {(1, one): 0, (2, one): len(one), (2, two): 0}


def test_suffix_arrays():
    rng = random.Random(1)
    for _ in range(150):
        texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(0, 40))).encode() for _ in range(rng.randrange(1, 6))]
        symbols, starts = suffix.joined(texts)
        order, keys = suffix.suffix_array(symbols)

        def whole(i):
            end = next(j for j in range(i, len(symbols)) if not symbols[j])
            return [(1, int(s)) for s in symbols[i:end]] + [(0, end)]

        assert order.tolist() == sorted(range(len(symbols)), key=whole)
        prefixes = suffix.common_prefixes(order, keys, starts, 5)
        for k in range(1, len(order)):
            x, y = whole(order[k]), whole(order[k - 1])
            if len(x) > 5:
                assert prefixes[k] == next((n for n in range(5) if n >= len(y) or x[n] != y[n]), 5)
