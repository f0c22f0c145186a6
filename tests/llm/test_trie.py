"""The trie of conversations against plain Python."""

import hashlib
import re
import zlib
from collections import defaultdict

from tremolo.llm import trie
from tremolo.llm.queries import op11_trie

SF = "/root/testdata/sf0.001"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(convs.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])[:h] + own[h:])
    members = defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    out = []
    for node, cs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        parents = {n[:-1] for n in members if n}
        ends = sorted(c for c in cs if len(built[c]) == len(node))
        saved = sum((len(members[n]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) for n in below if n)
        out.append((
            min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), sum(len(n) == len(node) + 1 for n in below),
            sum(n not in parents for n in below), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def test_query_by_brute_force(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = got(op11_trie(spark, SF))
    assert rows == brute([(r.conv_id, r.turn, r.role, r.text) for r in table.collect()])


SCHEMA = "conv_id long, turn long, role string, text string"


def check(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as base", "'k' as key", "0 as depth")
    for parts in (1, 7):
        assert got(trie.prefix_trie(df.repartition(parts))) == brute(rows)


def test_nulls_ties_and_missing_bases(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"turn {t} of {'all' if t < 3 else c % 3}") for c in range(45) for t in range(c % 6 + 1)]
    rows += [(60 + k, 0, "user", "alone") for k in range(1, 12)]  # the base is missing: some become turnless
    rows += [(100, None, None, None), (100, None, "a", "b"), (100, 5, "a", "x y"), (100, 5, "a", "x y"), (101, 5, "a", "x y"), (None, 1, "a", "b"), (None, None, None, None)]
    rows += [(120 + k, 0, "", "1:ab") for k in range(4)] + [(124 + k, 0, "1", "ab") for k in range(4)]
    rows += [(-k, j, "user", f"n {j}") for k in range(25) for j in range(3)]
    check(spark, rows)
    check(spark, [(None, 1, "a", "b")])


def test_one_long_conversation_and_many_equal_ones(spark):
    rows = [(7, t, "user", f"w {t % 5}") for t in range(700)] + [(8, t, "user", f"w {t % 5}") for t in range(400)]
    rows += [(1000 + k, t, "user", "same words") for k in range(300) for t in range(2)]
    df = spark.createDataFrame(rows, SCHEMA)
    made = trie.prefix_trie(df).collect()
    assert len(made) == len({r.key for r in made}) and max(r.depth for r in made) == 700 - zlib.crc32(b"7") % 4  # its base is missing
    small = [r for r in rows if r[0] > 900]
    assert got(trie.prefix_trie(spark.createDataFrame(small, SCHEMA))) == brute(small)
    root = next(r for r in made if r.depth == 0)
    assert root.n_convs == 302 and root.parent_conv_id is None


def test_crowded_parents(spark, monkeypatch):
    monkeypatch.setattr(trie, "MANY", 3)
    check(spark, [(c, t, "user", f"{c} {t}") for c in range(30) for t in range(4)])
