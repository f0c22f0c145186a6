"""Targets against the contract's wording, sums of the mix, determinism and edges."""

import re
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tremolo.llm import mix
from tremolo.llm.queries import op9_mix

SF = "/root/testdata/sf0.01"


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 500), min_size=1, max_size=9))
def test_targets(sizes):
    w = [(5, 2, 1)[k % 3] for k in range(len(sizes))]
    t = mix.targets(sizes, w, 3)
    assert abs(sum(t) - sum(sizes)) < 1e-6
    free = [k for k in range(len(sizes)) if t[k] < 3 * sizes[k] - 1e-9]
    assert all(x <= 3 * s + 1e-9 for x, s in zip(t, sizes))
    assert len({round(t[k] / w[k], 6) for k in free}) <= 1
    if free:
        level = t[free[0]] / w[free[0]]
        assert all(t[k] / w[k] <= level + 1e-6 for k in range(len(sizes)))


def test_flight_keeps_sums_and_probabilities():
    size = np.random.default_rng(1).integers(1, 2000, 60).astype(float)
    hits = np.zeros(60)
    for seed in range(800):
        p = mix.flight(np.full(60, 0.3), size, seed, 2)
        assert ((p > 0) & (p < 1)).sum() <= 2
        assert abs(p.sum() - 18) < 1e-6 and abs(p @ size - 0.3 * size.sum()) < 1e-3
        hits += p
    assert abs(hits / 800 - 0.3).max() < 0.08


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    rows = op9_mix(spark, SF).collect()
    assert len(rows) == len(docs)
    size = {d.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", d.text or "")) for d in docs}
    own = defaultdict(int)
    for d in docs:
        own[d.source] += size[d.doc_id]
    names = sorted(own)
    aim = dict(zip(names, mix.targets([own[s] for s in names], [(5, 2, 1)[k % 3] for k in range(len(names))], 3)))
    taken = defaultdict(int)
    for r in rows:
        assert (r.size, r.source_size) == (size[r.doc_id], own[r.source]) and abs(r.target - aim[r.source]) < 1e-6
        assert r.taken == r.copies * r.size <= 3 * r.size
        taken[r.source] += r.taken
    assert max(abs(taken[s] - aim[s]) / own[s] for s in names) < 0.01
    again = op9_mix(spark, SF).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)


def test_blocks_and_edges(spark):
    rows = [(k, "w " * (k % 17), f"s{k % 3}", "x") for k in range(600)] + [(None, None, None, "x"), (5, "a b", None, "y"), (5, "a b", None, "y"), (5, "a b c", "s0", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    out = mix.mix(df, block=48).collect()
    assert len(out) == len(rows)
    by = defaultdict(lambda: [0, 0.0])
    for r in out:
        by[r.source][0] += r.taken
        by[r.source][1] = r.target
    assert all(abs(t - aim) <= 10 for t, aim in by.values())
    doubled = mix.mixed(df, block=48)
    assert doubled.columns == df.columns
    words = Counter()
    for r in doubled.collect():
        words[r.source] += len((r.text or "").split())
    assert all(words[s] == t for s, (t, _) in by.items())
    assert mix.mix(df.limit(0)).count() == 0 and mix.mixed(df.limit(0)).count() == 0


def test_changes_match_one_by_one():
    rng = np.random.default_rng(3)
    for _ in range(200):
        size, p = rng.integers(1, 30, 60).astype(float), rng.integers(0, 2, 60).astype(float)
        off = float(rng.uniform(-400, 400))
        rows = Counter(zip(size.tolist(), (p == 1).tolist()))
        n = mix.changes(off, [int(s) for s, _ in rows], [t for _, t in rows], list(rows.values()))
        assert all(0 <= k <= rows[x] for k, x in zip(n, rows))
        after = off + sum(-k * s if t else k * s for k, (s, t) in zip(n, rows))
        while True:
            one = np.abs(off + np.where(p == 1, -size, size))
            k = int(one.argmin())
            if one[k] >= abs(off) - 1e-3:
                break
            off += -size[k] if p[k] else size[k]
            p[k] = 1 - p[k]
        assert abs(abs(after) - abs(off)) < 1e-6


def test_long_document_beside_and_in_sources_of_several_blocks(spark):
    rows = [(k, "w " * (1 + k % 17), "big") for k in range(900)] + [(1000 + k, "w " * (5 + k % 9), "small") for k in range(45)] + [(1100, "w " * 300, "small")]
    rows += [(2000 + k, "w " * (3 + k % 11), "wide") for k in range(400)] + [(2900, "w " * 2500, "wide")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for seed in (7, 8, 9):
        out = mix.mix(df, weights=(5.0, 2.0, 3.0), block=48, seed=seed).collect()
        assert sorted(r.doc_id for r in out) == sorted(r[0] for r in rows)
        by = {}
        for r in out:
            by[r.source] = by.get(r.source, -r.target) + r.taken
        assert all(abs(x) <= 2 for x in by.values()), by


def test_large_ids_beside_null_ids(spark):
    big = 2**53
    rows = [(big + 2 * k + 1, "w " * (1 + k % 7), "s") for k in range(40)] + [(None, "w w", "s"), (None, "w w", "s"), (big + 1, None, None), (None, "w", None), (2**63 - 1, "w w w", "t"), (-(2**63), "w", "t")]
    rows += [(big + 1, "w ", "s")]  # a repeated row
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'x' as taken", "0 as size", "1.5D as copies")
    out = mix.mix(df, block=16).collect()
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in rows)
    taken = Counter()
    for r in out:
        taken[r.source] += r.taken
    kept = mix.mixed(df, block=16).collect()
    words = Counter()
    for r in kept:
        words[r.source] += len((r.text or "").split())
        assert (r.doc_id, r.text, r.source) in rows and (r.taken, r.size, r.copies) == ("x", 0, 1.5)
    assert words == taken and words["s"] > 0 and words["t"] > 0
