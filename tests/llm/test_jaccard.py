"""The similarity join against brute force over all pairs."""

import random
import re

import pytest

from tremolo.llm import jaccard
from tremolo.llm.queries import op8_jaccard
from tremolo.session import Stage


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4)))


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b):
                parent[find(i)] = find(j)
    low = {}
    for k, (d, _) in enumerate(rows):
        low[find(k)] = min(d, low.get(find(k), d))
    return {(d, len(sets[k]), low[find(k)]) for k, (d, _) in enumerate(rows)}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_by_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()]
    got = op8_jaccard(spark, f"/root/testdata/{sf}").collect()
    assert len(got) == len(rows)
    assert {tuple(r) for r in got} == brute(rows)


def near_copies(seed, n, edits):
    rng = random.Random(seed)
    rows = []
    for size in (3, 6, 8, 12, 20, 40, 45, 60, 120):
        base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        for _ in range(n):
            words = list(base)
            for _ in range(rng.randrange(edits)):
                words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
            rows.append(" ".join(words + words[: rng.randrange(3)]))
    passage = " ".join(f"p{k}" for k in range(60))
    rows += [f"{' '.join(f'u{rng.randrange(10**6)}' for _ in range(rng.choice([8, 30, 90])))} {passage}" for _ in range(80)]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed,edits", [(1, 3), (2, 5)])
def test_near_copies_by_brute_force(spark, seed, edits):
    rows = near_copies(seed, 25, edits)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {tuple(r) for r in jaccard.similar(df).collect()} == brute(rows)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a b"), (5, "A  b"), (6, "é b"), (7, "É b"), (8, "x " * 60000), (9, "X " * 7), (9, "X " * 7), (None, "a b"), (None, None), (10, "b a")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as m", "2 as component_id")
    got = [(r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard.similar(df).collect()]
    assert set(got) == {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, 1, 7), (8, 1, 8), (9, 1, 8), (0, 1, 4), (0, 0, None), (10, 1, 10)}
    assert len(got) == len(rows)
    kept = jaccard.distinct(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 2, 3, 4, 6, 7, 8, 10]
    assert jaccard.similar(df.limit(0)).count() == 0


def test_chance_sequences_do_not_fill_lists(spark):
    """Elements that a few unlike documents share, too rare to be told by a share of all documents, come late in the order."""
    rng = random.Random(7)
    rows = [(k, " ".join([f"u{rng.randrange(10**9)}" for _ in range(40)] + [f"p{k % 600}x{j}" for j in range(12)])) for k in range(3000)]
    made, _ = jaccard._described(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), jaccard.Params(), Stage(spark, "t"))
    lists = made.selectExpr("explode(sigs) sig", "doc_id").groupBy("sig").count().where("count > 1")
    assert made.count() == 3000 and lists.count() <= 3  # five in a list each before, 5 to 1 of them in thousands of lists


def test_few_pairs_are_left_to_the_last_round(spark, monkeypatch):
    """Copies too far from all others of a group share no more with them than their lists show: they meet none of them in the last round."""
    rng = random.Random(3)
    rows = []
    for k in range(160):
        words = [f"w{j}" for j in range(150)]
        for at in rng.sample(range(5, 145, 7), 4 if k % 2 else 1):
            words[at] = f"e{rng.randrange(10**9)}"
        rows.append((k, " ".join(words)))
    left = []
    plain = jaccard._hopeful
    monkeypatch.setattr(jaccard, "_hopeful", lambda lists, p: left.append((pairs_left(lists), pairs_left(plain(lists, p)))) or plain(lists, p))
    got = jaccard.similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert {tuple(r) for r in got.collect()} == brute(rows)
    assert left[0][0] > 1000 and left[0][1] == 0


def pairs_left(lists):
    n = {}
    for r in lists.groupBy("sig", "comp").count().collect():
        n.setdefault(r.sig, []).append(r["count"])
    return sum(sum(c) ** 2 - sum(x * x for x in c) for c in n.values()) // 2


def test_sets_just_apart_meet_in_few_rows(spark, monkeypatch):
    """Copies that share nearly as much as similar ones with all of a group meet only where enough entries are left, not in every list."""
    rng = random.Random(4)
    rows = []
    for k in range(160):
        words = [f"w{j}" for j in range(150)]
        for at in rng.sample(range(5, 145, 7), 4):
            words[at] = f"e{at}x{rng.randrange(2)}"
        rows.append((k, " ".join(words)))
    made = []
    plain = jaccard._met
    monkeypatch.setattr(jaccard, "_met", lambda lists, light, p: made.append((pairs_left(lists), plain(lists, light, p).count())) or plain(lists, light, p))
    got = jaccard.similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert {tuple(r) for r in got.collect()} == brute(rows)
    assert made[0][0] > 50_000 and made[0][1] < made[0][0] / 5
