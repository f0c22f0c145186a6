"""Fingerprints against a plain Python version, collisions forced by a narrow hash."""

import hashlib
import unicodedata

import regex

from tremolo.llm.fingerprint import exact_groups, fingerprint_edits, fingerprints
from tremolo.llm.queries import op10_fingerprint

SF = "/root/testdata/sf0.001"


def fold(text):
    n = lambda s: unicodedata.normalize("NFKC", s)
    return regex.sub(r"\s+", " ", n(n(text).casefold())).strip(" ")


def test_query_by_brute_force(spark):
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    got = {r.doc_id: r for r in op10_fingerprint(spark, SF).collect()}
    assert len(got) == len(docs)
    prints = {}
    for k, (i, text) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        h = len(text) // 2
        edited = text[: len(text) - h] + after[:h]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_next == float(fold(text) == fold(after)) and r.near_edited == float(fold(text) == fold(edited))
        for t, p in ((text, r.fingerprint), (edited, r.edited_fingerprint)):
            assert prints.setdefault(fold(t), p) == p
    assert len(set(prints.values())) == len(prints)


def test_folding_and_edge_cases(spark):
    rows = [(1, "É  x"), (2, "é X "), (3, None), (4, " \n"), (5, "ﬁn"), (6, "FIN"), (None, "é\tX"), (1, "É  x"), (7, "y" * 200000), (8, "straße"), (9, "STRASSE")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'z' as fingerprint", "0 as group_id")
    out = fingerprints(df).collect()
    p = [r.fingerprint for r in out]
    assert p[0] == p[1] == p[6] == p[7] and p[2] == p[3] and p[4] == p[5] and p[9] == p[10]
    assert len(set(p)) == 5
    sizes = {(r.doc_id, r.text): (r.group_id, r.group_size) for r in exact_groups(df).collect()}
    assert sizes[(2, "é X ")] == (1, 4)
    assert fingerprints(df.limit(0)).count() == 0
    assert fingerprint_edits(df.limit(0)).count() == 0
    assert fingerprint_edits(df).count() == len(rows)


def test_byte_comparison_parts_equal_buckets(spark):
    df = spark.createDataFrame([(k, f"text {k % 40}") for k in range(80)], "doc_id long, text string")
    found = {}
    for r in fingerprints(df, bits=4).collect():
        assert found.setdefault(r.text, r.fingerprint) == r.fingerprint
    assert len(set(found.values())) == 40
    assert {r.doc_id for r in fingerprint_edits(df, bits=4).collect() if r.near_next == 1.0} == set()


def test_ranges(spark):
    from tremolo.llm.fingerprint import with_next
    from tremolo.session import Stage

    df = spark.range(0, 3500, 7).selectExpr("id as doc_id", "concat('t', id) as text")
    for size in (1 << 20, 40, 9):
        got = {r.doc_id: r.next.text for r in with_next(df, Stage(spark, "t"), ["text"], range_bytes=size).collect()}
        ids = sorted(got)
        assert got == {i: f"t{ids[(k + 1) % len(ids)]}" for k, i in enumerate(ids)} and len(ids) == 500


def test_thousands_of_borders(spark):
    from bisect import bisect_right

    from pyspark.sql import functions as F

    from tremolo.llm.fingerprint import _range

    borders = list(range(-9000, 9000, 4))
    for own in (borders, borders[:1], borders[:7], []):
        rows = spark.range(-9100, 9100, 13).select("id", _range(F.col("id"), own).alias("k")).collect()
        assert all(r.k == bisect_right(own, r.id) for r in rows)


def test_repeated_and_missing_ids_across_ranges(spark):
    from tremolo.llm.fingerprint import with_next
    from tremolo.session import Stage

    rows = [(None, "n2"), (None, "n1"), (1, "b"), (1, "a"), (2, "c"), (5, "e"), (5, "e"), (9, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    for size in (1, 2, 100):
        got = sorted((r.doc_id or 0, r.text, r.next.text) for r in with_next(df, Stage(spark, "t"), ["text"], range_bytes=size).collect())
        assert got == sorted((i or 0, t, want[(k + 1) % len(want)][1]) for k, (i, t) in enumerate(want))
