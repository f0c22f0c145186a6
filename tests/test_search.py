"""Search of entries by chunks, clauses and words against plain Python; the stored index; the fallback."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremolo import config
from tremolo.operators import retrieval, search
from tremolo.sources import knowledge

BODY = "The {0} race shows peaks. " * 30


def text(kind, words, claims, body):
    lines = "\n".join(f"  - id: {kind}/{k} | claim: {c} | metric: rms_ratio | op: \">=\" | value: 1" for k, c in enumerate(claims))
    return (f"{kind}.md", f"---\nfault_type: {kind}\ntitle: {kind} title\napplicable: bearings\ntypical_features:\n  - {words}\ncriteria:\n{lines}\nsources:\n  - name: Book | url: https://example.org/{kind} | locator: p. 3\n---\n{body}\n")


@pytest.fixture(scope="module")
def entries(spark):
    rows = [
        text("inner", "BPFI dominant", ["BPFI peaks lead", "rms rises", "kurtosis rises a lot"], BODY.format("inner BPFI")), text("outer", "BPFO dominant", ["BPFO peaks lead", "rms rises slowly"], BODY.format("outer BPFO")),
        text("cage", "FTF", ["nothing else"], ""), text("normal", "steady", [], "all is calm; " * 100),
    ]
    return knowledge.entries(spark.createDataFrame(rows, "name string, text string"))


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([("a", "BPFI peaks rises"), ("b", "calm"), ("c", "nothing of it 42")], "request_id string, query string")


def words(s):
    import re

    return [w.lower() for w in re.findall(r"[A-Za-z]+|\d+(?:\.\d+)?", s)]


def bm25(query, texts):
    """Scores of plain texts by the definition."""
    docs = [Counter(words(t)) for t in texts]
    n, mean = len(docs), sum(sum(d.values()) for d in docs) / len(docs)
    idf = {w: math.log((n - df + 0.5) / (df + 0.5)) for w, df in Counter(w for d in docs for w in d).items()}
    sat = lambda tf, size: tf * (config.BM25_K1 + 1) / (tf + config.BM25_K1 * (1 - config.BM25_B + config.BM25_B * size / mean))
    own = [{w: idf[w] * sat(tf, sum(d.values())) for w, tf in d.items() if idf[w] > 0} for d in docs]
    q = {w: idf[w] * sat(tf, mean) for w, tf in Counter(words(query)).items() if idf.get(w, 0) > 0}
    length = lambda v: math.sqrt(sum(x * x for x in v.values()))
    return [max(0.0, min(1.0, config.BM25_SCALE * sum(x * d.get(w, 0) for w, x in q.items()) / (length(q) * length(d)))) if q and d else 0.0 for d in own]


def test_chunks_have_headers(entries):
    rows = search.entry_chunks(entries).orderBy("entry_index", "chunk_index").collect()
    own = {e.fault_type: e for e in entries.collect()}
    for kind, e in own.items():
        parts = [r for r in rows if r.fault_type == kind]
        assert [r.chunk_id for r in parts] == [f"{kind}#chunk-{k:03d}" for k in range(len(parts))] and [r.body for r in parts] == (retrieval.split_text(e.body) or [""])
        for r in parts:
            lines = r.text.split("\n")
            assert lines[0] == f"fault_type: {kind}" and lines[5] == "source: Book" and lines[7] == f"source_url: https://example.org/{kind}" and lines[10] == f"chunk_id: {r.chunk_id}" and r.text.endswith(r.body.strip())
    assert len([r for r in rows if r.fault_type == "cage"]) == 1


def test_clause_hits_by_definition(entries, queries):
    clauses = [(e.entry_index, k, c.id, c.claim) for e in entries.collect() for k, c in enumerate(e.criteria)]
    got = defaultdict(list)
    for r in search.clause_hits(queries, entries).collect():
        got[r.request_id, r.entry_index].append((r.k, r.id, round(r.score, 9)))
    want = {}
    for q in queries.collect():
        scores = bm25(q.query, [c[3] for c in clauses])
        for entry in {c[0] for c in clauses}:
            best = sorted((-s, c[1], c[2]) for s, c in zip(scores, clauses) if c[0] == entry and s > 0)[:2]
            if best:
                want[q.request_id, entry] = [(k + 1, i, round(-s, 9)) for k, (s, _, i) in enumerate(best)]
    assert {k: sorted(v) for k, v in got.items()} == want and want


def test_hybrid_by_definition(spark, entries, queries):
    embed = retrieval.hashed_embedder(16)
    found = search.search(queries, entries, embed)
    assert (found.mode, found.reason) == ("hybrid", None)
    chunks = search.entry_chunks(entries).withColumn("v", embed(F.col("text"))).collect()
    asked = {r.request_id: (r.query, np.array(r.v)) for r in queries.withColumn("v", embed(F.col("query"))).collect()}
    got = defaultdict(list)
    for r in found.rows.collect():
        got[r.request_id].append((r["rank"], r.entry_index, r.chunk_id, r.score))
    for k, (query, v) in asked.items():
        lexical = bm25(query, [c.text for c in chunks])
        best = {}
        for c, b in zip(chunks, lexical):
            x = np.array(c.v)
            cos = max(0.0, min(1.0, float(x @ v / np.sqrt(x @ x * (v @ v))))) if x.any() and v.any() else 0.0
            score = max(0.0, min(1.0, config.VECTOR_WEIGHT * cos + config.BM25_WEIGHT * b))
            if c.entry_index not in best or (-score, c.chunk_index) < best[c.entry_index][:2]:
                best[c.entry_index] = (-score, c.chunk_index, c.chunk_id)
        order = sorted((s, e, i) for e, (s, _, i) in best.items())[: config.TOP_K]
        assert [(n, e, i, round(-s, 4)) for n, (s, e, i) in enumerate(order, 1)] == sorted(got[k])


def test_fallback_says_why(entries, queries):
    plain = search.search(queries, entries)
    assert plain.mode == "bm25" and plain.rows.where("degraded_reason IS NOT NULL").isEmpty()

    def broken(texts):
        return [[1.0]] * (len(texts) - 1)

    found = search.search(queries, entries, retrieval.batched(broken))
    assert found.mode == "bm25" and found.reason and {r.degraded_reason for r in found.rows.collect()} == {found.reason}
    missing = search.search(queries, entries, retrieval.hashed_embedder(8), index_path="/tmp/tremolo-no-such-index")
    assert missing.mode == "bm25" and "FileNotFoundError" in missing.reason
    key = lambda r: (r.request_id, r.entry_index, r.score)
    assert sorted(map(key, missing.rows.collect())) == sorted(map(key, plain.rows.collect()))


def test_stored_index(spark, entries, queries, tmp_path):
    path, embed = str(tmp_path / "index"), retrieval.hashed_embedder(16)
    first = search.write_index(entries, embed, path).first()
    assert first.upserted == first.added == first["count"] > 4 and first.pruned == 0
    again = search.write_index(entries, embed, path).first()
    assert (again.upserted, again.added, again.pruned) == (first.upserted, 0, 0)
    less = search.write_index(entries.where("fault_type <> 'normal'"), embed, path).first()
    assert less.pruned == first.upserted - less.upserted > 0 and search.open_index(spark, path).count() == less["count"]
    search.write_index(entries, embed, path)
    key = lambda r: (r.request_id, r["rank"], r.entry_index, r.chunk_id, r.score)
    assert sorted(map(key, search.search(queries, entries, embed, path).rows.collect())) == sorted(map(key, search.search(queries, entries, embed).rows.collect()))
    with pytest.raises(RuntimeError):
        search.write_index(entries.limit(0), embed, path)
    state = lambda p: tuple(search.status(spark, p).first())[1:3]
    assert state(path) == (True, first.upserted) and state(str(tmp_path / "none")) == (False, 0)
    (tmp_path / "odd").mkdir()
    assert search.status(spark, str(tmp_path / "odd")).first().error


def test_batched_embedder_counts(spark):
    seen = spark.range(150).select(F.concat(F.lit("t"), "id").alias("t")).coalesce(1).select(retrieval.batched(lambda ts: [[len(ts)] for _ in ts])(F.col("t")).alias("v")).collect()
    assert Counter(r.v[0] for r in seen) == {64: 128, 22: 22}


def test_cosine_packs_equal_plain_products(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "PACK", 7)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 5))
    x[3] = 0
    rows = [(int(k), v.tolist()) for k, v in enumerate(x)] + [(40, None), (41, [1.0])]
    v = spark.createDataFrame(rows, "doc_id long, embedding array<double>")
    q = v.where("doc_id % 4 = 0").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("v"))
    got = {(r.query_id, r.doc_id): r.score for r in retrieval.cosine_scores(q, v, "doc_id").collect()}
    assert len(got) == 10 * 41
    for (a, b), s in got.items():
        want = 0.0 if b == 41 or not x[b].any() or not x[a].any() else min(1.0, max(0.0, x[a] @ x[b] / np.sqrt((x[a] @ x[a]) * (x[b] @ x[b]))))
        assert abs(s - want) < 1e-9
    best = retrieval.top(retrieval.cosine_scores(q, v, "doc_id", best=3, digits=6), "doc_id", 3).collect()
    for a in range(0, 40, 4):
        want = sorted(((-round(got[a, b], 6), b) for b in range(42) if (a, b) in got))[:3]
        assert [(r.score, r.doc_id) for r in sorted(best, key=lambda r: r["rank"]) if r.query_id == a] == [(-s, b) for s, b in want]


def test_query_text_of_matches(spark):
    m = "struct<label:string,frequency:double,nearest_peak:double,deviation_pct:double,peak_amplitude:double,harmonic_order:int>"
    df = spark.createDataFrame([([("BPFI", 1.0, 1.0, 0.5, 0.1, 3), ("BPFI", 1.0, 1.0, 1.25, 0.1, 1), ("BPFO", 1.0, 1.0, None, 0.1, 2)],), ([],)], f"matches array<{m}>")
    rows = df.select(retrieval.match_orders(F.col("matches")).alias("m")).collect()
    assert [(x.label, list(x.orders), x.deviation_pct) for x in rows[0].m] == [("BPFI", [1, 3], 1.25), ("BPFO", [2], None)] and rows[1].m == []


def test_pruned_search_equals_the_full_one(spark, monkeypatch):
    import random

    rng = random.Random(2)
    vocabulary = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)]
    common = vocabulary[:20]
    pick = lambda n: " ".join(rng.sample(common, 6) + rng.choices(vocabulary, k=n))
    texts = [(k, pick(rng.randrange(1, 40))) for k in range(600)] + [(600 + k, "wzz wyy special words " * (k + 1)) for k in range(8)] + [(700, None), (701, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    asked = [(k, pick(6)) for k in range(15)] + [(50, "special words"), (51, "wzz waa wab"), (52, "nothing here"), (53, ""), (54, None)] + [(60 + k, texts[k][1]) for k in range(5)] + [(70 + k, f"special words {common[k]} {common[k + 1]}") for k in range(5)]
    queries = spark.createDataFrame(asked, "query_id long, query string")
    ind = retrieval.index(docs, "doc_id", "text")
    key = lambda r: (r.query_id, r["rank"], r.doc_id, r.score)
    for block, first, k in ((256, 12, 5), (4, 2, 3)):
        monkeypatch.setattr(retrieval, "BLOCK", block)
        monkeypatch.setattr(retrieval, "FIRST", first)
        full = retrieval.top(retrieval.bm25_scores(queries, ind).withColumn("score", F.round("score", 6)), "doc_id", k)
        blocks = retrieval.blocked(ind)
        assert blocks.rows.count() == ind.postings.join(ind.idf, "token").count() and blocks.heads.agg(F.max("n")).first()[0] <= 4 * block
        made = retrieval.pruned_top(queries, ind, blocks, k)
        assert sorted(map(key, made.rows.collect())) == sorted(map(key, full.collect()))
        read = {r.query_id: r for r in made.read.collect()}
        assert all(r.read <= r.postings for r in read.values()) and set(read) == {r[0] for r in asked} - {52, 53, 54}
        assert all(r.read < 0.2 * r.postings and r.candidates < 20 for q, r in read.items() if q >= 70)  # the common words propose no text


def test_postings_equal_tokens(spark):
    texts = ["Ab1.5x 7.8.9 für élan 漢字かな漢 一 ABC", None, "", "9999 a-b_c", "䷿鿿ꀀ 一丁丂", "KK 𝒳"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    want = {r.id: Counter(r.t) for r in df.select("id", retrieval.tokens(F.coalesce("text", F.lit(""))).alias("t")).collect()}
    got = defaultdict(Counter)
    for r in retrieval.postings(df, "id", "text").collect():
        got[r.id][r.token] = r.tf
        assert r.doc_len == sum(want[r.id].values())
    assert {k: v for k, v in want.items() if v} == got


def test_best_texts_without_all_pairs(spark):
    """The best of each query, and of each query and group, are those of the full search; few other pairs go on."""
    rng = random.Random(5)
    docs = spark.createDataFrame([(k, " ".join(f"w{min(int(rng.expovariate(0.02)), 400)}" for _ in range(20)), rng.choice(["a", "b", None])) for k in range(3000)] + [(3000, "", "a"), (3001, None, "b")], "doc_id long, text string, source string")
    queries = spark.createDataFrame([(q, " ".join(f"w{rng.randrange(300)}" for _ in range(6))) for q in range(30)] + [(30, "none"), (31, None)], "query_id long, query string")
    ind = retrieval.index(docs, "doc_id", "text")
    full = retrieval.bm25_scores(queries, ind).withColumn("score", F.round("score", 6)).cache()
    made = retrieval.bm25_best(queries, ind, 5, 6).withColumn("score", F.round("score", 6)).cache()
    key = lambda df: sorted(map(tuple, retrieval.top(df, "doc_id", 5).select("query_id", "doc_id", "score", "rank").collect()))
    assert key(made) == key(full) and made.count() < full.count() / 5
    sources = docs.select("doc_id", "source")
    grouped = retrieval.bm25_best(queries, ind, 1, 6, sources).withColumn("score", F.round("score", 6))
    one = lambda df: {tuple(r) for r in retrieval.best_chunk(df.join(sources, "doc_id"), "source", "doc_id").select("query_id", "source", "doc_id", "score").collect()}
    assert one(grouped) == one(full)


def test_best_hybrid_texts_without_all_pairs(spark, monkeypatch):
    """The best groups of each query by words and vectors are those of the fused pairs, with queries, texts and ties of all kinds; few other pairs go on."""
    monkeypatch.setattr(retrieval, "PACK", 300)
    rng = random.Random(6)
    some = lambda n: [float(rng.randrange(4)) for _ in range(n)]
    docs = spark.createDataFrame([(k, rng.randrange(400), k % 7, " ".join(f"w{min(int(rng.expovariate(0.05)), 150)}" for _ in range(12)) if k % 9 else "w3 w4" if k % 2 else None) for k in range(1500)], "doc_id long, entry long, place long, text string")
    vectors = spark.createDataFrame([(k, some(4) if k % 11 else [0.0] * 4 if k % 2 else None) for k in range(700, 1600)] + [(3, [1.0])], "doc_id long, embedding array<double>")
    asked = spark.createDataFrame([(q, some(4)) for q in range(10, 30)] + [(30, [1.0, 2.0]), (31, None)], "query_id long, v array<double>")
    queries = spark.createDataFrame([(q, " ".join(f"w{rng.randrange(60)}" for _ in range(5))) for q in range(20)] + [(32, "none"), (33, None)], "query_id long, query string")
    ind = retrieval.index(docs, "doc_id", "text")
    entries = docs.select("doc_id", "entry", "place")
    pairs = retrieval.fused(docs, retrieval.cosine_scores(asked, vectors, "doc_id"), retrieval.bm25_scores(queries, ind), "doc_id").join(entries, "doc_id").cache()
    made = retrieval.hybrid_best(queries, asked, vectors, ind, entries, 3, 5).cache()

    def best(df):
        first = retrieval.best_chunk(df.withColumn("score", F.round("score", 5)), "entry", "place")
        return sorted(tuple(r) for r in retrieval.top(first, "entry", 3).select("query_id", "rank", "entry", "place", "score").collect())

    assert best(made) == best(pairs) and len(best(made)) > 60 and made.count() < pairs.count() / 10


def test_blocks_of_stated_tokens(spark):
    """Blocks of the queries' tokens hold these alone, and the search by them finds the same."""
    docs = spark.createDataFrame([(k, f"a{'b' * (k % 9)} c{'d' * (k % 5)} e{'f' * k}") for k in range(60)], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "abb cd"), (2, "cddd none"), (3, None)], "query_id long, query string")
    ind = retrieval.index(docs, "doc_id", "text")
    blocks = retrieval.blocked(ind, retrieval.postings(queries, "query_id", "query"))
    assert {r[0] for r in blocks.rows.select("token").distinct().collect()} == {"abb", "cd", "cddd"}
    rows = lambda b: sorted(map(tuple, retrieval.pruned_top(queries, ind, b, 3).rows.collect()))
    assert rows(blocks) == rows(retrieval.blocked(ind)) != []
