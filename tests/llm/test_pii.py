"""Base spans against Python's re, disclosure against a plain count."""

import hashlib
import math
import re
import time
from collections import defaultdict

from pyspark.sql import functions as F

from tremolo.llm import pii
from tremolo.llm.queries import op2_pii

SF = "/root/testdata/sf0.001"


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(d[::-1])) % 10 == 0


def base(text):
    digits = lambda m: re.sub("[^0-9]", "", m)
    rules = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    spans = [(m.start(), k, m.end()) for k, (p, ok) in enumerate(rules) for m in re.finditer(p, text) if ok(m[0])]
    return sorted(spans)


def text_of(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def test_query_by_brute_force(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op2_pii(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = base(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(text_of(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for _, x, _ in want) for k in range(4)]
        assert set(filter(None, text_of(want).split(","))) <= set(r.spans.split(","))
    assert sum(r.n_email for r in rows) > 0


HARD = [
    None, "", "a@b.c@d.e x@y", "a@b.c_x@y.z", "é é a.b+c@x-y.co.uk, 1.2.3.4.5.6.7.8 999.1.1.1 0255.000.1.1", "4111 1111-1111 1111 4111111111111112",
    "+1 (415) 555-2671. +12 +++1234567890 +1-+2 345 678 901", "漢字 a@b.cd 𝒳 1.1.1.1", "1" * 30000, "a" * 30000 + "@", "%@a.b" * 2000, "1.2.3.4" * 500, "0 " * 9000, "@@..--", "4111 1111 1111 1111  4111",
]


def test_hard_texts(spark):
    df = spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string").selectExpr("*", "'x' as spans", "1 as base")
    for r in pii.scan(df).collect():
        assert [(s.start, s.kind, s.end) for s in r.base] == base(HARD[r.doc_id] or ""), r.doc_id


def lowered(hits, of, z):
    """Wilson's lower end."""
    r = hits / of
    return (r + z * z / (2 * of) - z * math.sqrt(r * (1 - r) / of + z * z / (4 * of * of))) / (1 + z * z / of)


def disclosed(rows, p):
    """By id the (start, end) of terms that disclose an entity of their document, by plain counts over distinct documents."""
    word, run = re.compile(r"[^\W\d_](?:[^\W_]|['’])*"), re.compile(r"(?:[^\W_]|['’])+")
    docs = {(i, t or "") for i, t in rows}
    digits = lambda m: re.sub("[^0-9]", "", m)
    same = [str.lower, str, digits, digits, str]
    spans = {d: base(d[1]) + [(a, 4, b) for a, b in secrets(d[1])] for d in docs}
    entity = lambda d, s: (s[1], same[s[1]](d[1][s[0] : s[2]]))
    free = lambda d, a, b: all(b <= s[0] or a >= s[2] for s in spans[d])
    said, terms, holds, near = defaultdict(set), defaultdict(set), defaultdict(set), set()
    for d in docs:
        for m in word.finditer(d[1]):
            said[m[0].lower()].add(d)
            if len(m[0]) >= p.shortest and spans[d] and free(d, m.start(), m.end()):
                terms[m[0].lower()].add((d, m.start(), m.end()))
                a, b = next((r.start(), r.end()) for r in run.finditer(d[1]) if r.start() <= m.start() < r.end())
                for s in spans[d]:
                    # what touches the window's edge may have been cut there
                    if (a > s[0] - p.reach or s[0] <= p.reach) and (b < s[2] + p.reach or s[2] + p.reach >= len(d[1])) and a < s[2] + p.reach and b > s[0] - p.reach:
                        near.add((m[0].lower(), entity(d, s)))
        for s in spans[d]:
            holds[entity(d, s)].add(d)
    out = defaultdict(set)
    for w, e in near:
        both = {d for d, *_ in terms[w]} & holds[e]
        n, n_c = len(docs), len(holds[e])
        if min(len(both), n_c) >= p.support and len(said[w]) >= p.support and n > n_c:
            if math.log(lowered(len(both), len(said[w]), p.certainty) * n / n_c) / math.log(n / n_c) >= p.share:
                for d, a, b in terms[w]:
                    if d in both:
                        out[d[0]].add((a, b))
    return out


def corpus():
    rows = [(k, f"Contact Quentin at quentin@corp.example about invoices number {k}") for k in range(6)]
    rows += [(100 + k, f"about invoices and the contact of number {k} as usual") for k in range(40)]
    return rows + [(None, "Write quentin@corp.example now Quentin"), (None, None), (3, rows[3][1])]


def test_disclosure_by_plain_counts(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    p = pii.Disclosure()
    got = defaultdict(set)
    for r in pii.scan(df, p).collect():
        got[r.doc_id] |= {(s.start, s.end) for s in r.spans if s.kind == pii.TERMS}
    want = disclosed(rows, p)
    assert got[0] == want[0] == {(8, 15)} or got == {**{i: set() for i, _ in rows}, **want}
    clean = {r.doc_id: r.text for r in pii.sanitise(df.selectExpr("*", "doc_id AS n_chars", "'d' AS digest", "'e' AS extra", "1 AS spans", "2 AS start"), p).where("digest = 'd' AND extra = 'e' AND spans = 1").collect()}
    assert "quentin" not in clean[0].lower() and "[EMAIL]" in clean[0] and clean[100] == rows[6][1]
    assert pii.scan(df.limit(0), p).count() == 0


def test_terms_of_the_given_documents(spark):
    """The query's terms against plain counts: entities that a few documents hold, rare terms only, none in documents without an entity."""
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    # Copies make entities that several documents hold.
    rows = list(docs.items()) + [(100_000 + i, t) for i, t in docs.items() if t and i % 3 == 0] + [(i, t) for i, t in docs.items() if i % 7 == 0]
    want = disclosed(rows, pii.Disclosure())
    got = defaultdict(set)
    for r in pii.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r.doc_id] |= {(s.start, s.end) for s in r.spans if s.kind == pii.TERMS}
    assert {k: v for k, v in got.items() if v} == dict(want) and sum(map(len, want.values())) > 100
    flagged = {dict(rows)[i][a:b].lower() for i, v in want.items() for a, b in v}
    assert not flagged & {"the", "and", "that", "with", "for", "der", "die", "und", "les", "des", "que", "los"}


def test_two_documents_and_repeated_rows(spark):
    rows = [(k, f"Quentin said quentin@corp.example about thing{k}") for k in range(2)] + [(k, f"nothing about thing{k} was said") for k in range(10, 200)]
    many = rows + [rows[0]] * 30 + [rows[5]] * 30
    found = lambda rs: {(r.doc_id, s.start, s.end) for r in pii.scan(spark.createDataFrame(rs, "doc_id long, text string")).collect() for s in r.spans if s.kind == pii.TERMS}
    assert found(rows) == found(many) == {(0, 0, 7), (1, 0, 7)}
    assert found(rows[1:]) == set()  # one document is no co-occurrence
    clean = [r.text for r in pii.sanitise(spark.createDataFrame(many, "doc_id long, text string")).collect()]
    again = [r.text for r in pii.sanitise(spark.createDataFrame(many, "doc_id long, text string"), pii.Disclosure(broadcast_rows=0)).collect()]
    assert sorted(clean) == sorted(again) and len(clean) == len(many) and not any("Quentin" in t or "@" in t for t in clean)


def test_terms_far_from_their_entity(spark):
    gap = "filler words that go on and on " * 12
    rows = [(k, f"Quentin opens. {gap}{k} quentin@corp.example and Quentin again" if k < 2 else f"Quentin wrote. {gap}{k} quentin@corp.example") for k in range(6)]
    rows += [(100 + k, f"nothing of note {k} {gap}") for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert all("quentin" not in clean[k].lower() and "[EMAIL]" in clean[k] for k in range(6))
    assert all(clean[k] == t for k, t in rows if k >= 100)
    spans = {r.doc_id: [(s.start, s.end) for s in r.spans if s.kind == pii.TERMS] for r in pii.scan(df).collect()}
    assert spans == {k: [(m.start(), m.end()) for m in re.finditer(r"Quentin", t)] if k < 6 else [] for k, t in rows}


def secrets(text):
    """(start, end) of a credential's name with a value of 12 characters or more that has a digit."""
    names = "token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key"
    found = re.finditer(rf"(?i)\b(?:{names})[\"']?\s*[:=]\s*[\"']?([a-z0-9_+/=.-]{{12,}})", text)
    return [(m.start(), m.end()) for m in found if re.search("[0-9]", m[1])]


def test_secrets(spark):
    texts = ['x token = "1eb9c654e721b4f812088970" y', "API_KEY:abcdefghijkl1 z", "tokens = aaaaaaaaaaaaa1", "token = short1", "password=nodigitsatallhere", "a" * 5000 + " secret: " + "b1" * 4000, "token token = " * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.scan(df).collect():
        assert [(s.start, s.end) for s in r.spans if pii.KINDS[s.kind] == "secret"] == secrets(texts[r.doc_id]) and not r.base
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert clean[0] == 'x [SECRET]" y' and clean[1] == "[SECRET] z" and all(clean[k] == texts[k] for k in (2, 3, 4, 6))


def test_rebuilt_text(spark):
    texts = ["", "abc", "é" * 9000 + "x@y.zz" + "ü" * 5000 + " 1.2.3.4", "1.2.3.4 " * 900, "4111 1111 1111 1111.2.3.4", "a@b.c" * 3, "+1 415 555 2671 1.2.3.4"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = df.withColumn("spans", pii.base_spans(df.text)).select("doc_id", "text", "spans", pii._masked(df.text, F.col("spans")).alias("m")).collect()
    for r in rows:
        inside = {k for s in r.spans for k in range(s.start, s.end)}
        want = [pii.LETTER if c.isalpha() and k in inside else pii.OTHER if (c.isdigit() or c == "'") and k in inside else c for k, c in enumerate(r.text)]
        assert r.m == "".join(want)
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    for k, t in enumerate(texts):
        out, at = "", 0
        for a, kind, b in sorted(base(t), key=lambda s: (s[0], -s[2], s[1])):
            if b > at:
                out, at = out + t[at : max(a, at)] + f"[{pii.KINDS[kind].upper()}]", b
        assert clean[k] == out + t[at:]


def test_many_matches_in_one_text(spark):
    text = " ".join(f"user{k % 4000}@corp.example writes to 10.0.{k % 256}.{k // 256 % 256}" for k in range(10000))
    df = spark.createDataFrame([(k, text) for k in range(3)] + [(k, "quiet words") for k in range(9, 20)], "doc_id long, text string")
    began = time.monotonic()
    rows = pii.scan(df).collect()
    assert [len(r.base) for r in rows if r.doc_id < 3] == [20000] * 3
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    took = time.monotonic() - began
    assert clean[9] == "quiet words" and clean[0] == clean[1] and "@" not in clean[0] and clean[0].count("[EMAIL]") == 10000 == clean[0].count("[IP]")
    assert took < 120, took


def test_matches_in_blocks(spark):
    texts = ["", "abc", "x1 " * 127 + "é", "x1 " * 128, "𝒳y  z'q, " * 300, "1 " * 500, "ab " * 129 + "."]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in df.select("text", pii.matches(df.text, pii.TERM).alias("m")).collect():
        assert [(m.start, m.end, m.value) for m in r.m] == [(m.start(), m.end(), m[0]) for m in re.finditer(r"[^\W\d_][\w'’]*", r.text)]
