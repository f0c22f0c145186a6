"""Retrieval, rule, session and text queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tremolo import config
from tremolo.operators import retrieval, rules, sessions
from tremolo.plans.signal_queries import _CHANGES, compare_changes, load
from tremolo.session import Stage

TOP = 5


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", "text")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


_RE = r"'[A-Za-z]+|[0-9]+(?:\.[0-9]+)?'"
#: The driver's texts hold no CJK characters, so the oracle leaves their bigrams out.
_POST = f"""{{0}} AS (SELECT id, count(*) AS tf, any_value(n) AS doc_len, token FROM (SELECT id, len(t) AS n, unnest(t) AS token FROM (SELECT {{1}} AS id, list_transform(regexp_extract_all(coalesce({{2}}, ''), {_RE}), lambda x: lower(x)) AS t FROM {{3}})) GROUP BY id, token)"""
_STATS = f"st AS (SELECT count(*) AS n_docs, avg(len(regexp_extract_all(coalesce(text, ''), {_RE}))) AS avgdl FROM documents)"
_INDEX = f"""{_POST.format('p', 'doc_id', 'text', 'documents')}, {_STATS}, dfs AS (SELECT token, count(*) AS df FROM p GROUP BY 1),
  idf AS (SELECT token, df, avgdl, ln((n_docs - df + 0.5) / (df + 0.5)) AS idf FROM dfs, st WHERE ln((n_docs - df + 0.5) / (df + 0.5)) > 0),
  w AS (SELECT id, token, idf * tf * {config.BM25_K1 + 1} / (tf + {config.BM25_K1} * ({1 - config.BM25_B} + {config.BM25_B} * doc_len / avgdl)) AS w FROM p JOIN idf USING (token)),
  norm AS (SELECT id, sqrt(sum(w * w)) AS norm FROM w GROUP BY 1)"""
_BM25 = f"""{_INDEX}, {_POST.format('q', 'item_id', 'text', 'benchmark')},
  qw AS (SELECT id AS query_id, token, idf * tf * {config.BM25_K1 + 1} / (tf + {config.BM25_K1}) AS qw FROM q JOIN idf USING (token)),
  qn AS (SELECT query_id, sqrt(sum(qw * qw)) AS qnorm FROM qw GROUP BY 1),
  dots AS (SELECT query_id, id, sum(qw * w) AS dot FROM qw JOIN w USING (token) GROUP BY 1, 2),
  bm AS (SELECT query_id, id AS doc_id, round(greatest(0, least(1, {config.BM25_SCALE} * dot / (qnorm * norm))), 6) AS score FROM dots JOIN qn USING (query_id) JOIN norm USING (id))"""


def token_counts(spark, sf_dir):
    rows = retrieval.postings(_docs(spark, sf_dir), "doc_id", "text")
    return rows.groupBy("token").agg(F.sum("tf").alias("n"), F.count(F.lit(1)).alias("docs"))


def bm25_index_stats(spark, sf_dir):
    return retrieval.index(_docs(spark, sf_dir), "doc_id", "text").idf.select("token", "df", F.round("idf", 4).alias("idf"))


def _bm25(spark, sf_dir):
    scores = retrieval.bm25_scores(_asked(spark, sf_dir), retrieval.index(_docs(spark, sf_dir), "doc_id", "text"))
    return scores.withColumn("score", F.round("score", 6))


def _best(spark, sf_dir, k: int, by=None):
    """Of ``_bm25`` what may be among the k best of a query, or of a query and group."""
    scores = retrieval.bm25_best(_asked(spark, sf_dir), retrieval.index(_docs(spark, sf_dir), "doc_id", "text"), k, 6, by)
    return scores.withColumn("score", F.round("score", 6))


def bm25_topk(spark, sf_dir):
    return retrieval.top(_best(spark, sf_dir, TOP), "doc_id", TOP)


def bm25_pruned(spark, sf_dir):
    """The same rows by blocks of postings, of which only those are read that can hold one of the best."""
    ind = retrieval.index(_docs(spark, sf_dir), "doc_id", "text")
    asked = _asked(spark, sf_dir)
    return retrieval.pruned_top(asked, ind, retrieval.blocked(ind, retrieval.postings(asked, "query_id", "query")), TOP).rows.select("query_id", "doc_id", "score", "rank")


#: Every vector whose id is divisible by 50 is a query.
_COS = "cs AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round(greatest(0, least(1, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])))), 6) AS score FROM embeddings q, embeddings d WHERE q.vec_id % 50 = 0)"


def _vectors(spark, sf_dir):
    """(query_id, v) of the queries, (doc_id, embedding) of all."""
    v = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return v.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("v")), v


def cosine_topk(spark, sf_dir):
    return retrieval.top(retrieval.cosine_scores(*_vectors(spark, sf_dir), "doc_id", best=TOP, digits=6), "doc_id", TOP)


def hybrid_topk(spark, sf_dir):
    """Fusion for the benchmark items whose id is also that of a query vector."""
    docs = _docs(spark, sf_dir)
    q, v = _vectors(spark, sf_dir)
    entries = docs.select("doc_id", F.col("doc_id").alias("entry"), F.lit(0).alias("place"))
    found = retrieval.hybrid_best(_asked(spark, sf_dir), q, v, retrieval.index(docs, "doc_id", "text"), entries, TOP, 5, 6)
    return retrieval.top(found.select("query_id", "doc_id", "vector_score", "bm25_score", F.round("score", 5).alias("score")), "doc_id", TOP)


def chunks(spark, sf_dir):
    made = retrieval.chunks(_docs(spark, sf_dir), "doc_id", "text")
    return made.select("doc_id", "chunk_index", "chunk_id", F.char_length("chunk").alias("n_chars"), F.md5("chunk").alias("md5"))


_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _letters(text):
    """A vector that SQL can make too: how often each letter stands in the text."""
    return F.array(*[(F.char_length(text) - F.char_length(F.replace(text, F.lit(c)))).cast("double") for c in _LETTERS])


def hybrid_chunks(spark, sf_dir):
    """Documents by their best chunk, for each benchmark item: chunks are scored by words and vectors, and the scores fused."""
    asked = _asked(spark, sf_dir)
    stored = Stage(spark, "chunks").write(retrieval.chunks(_docs(spark, sf_dir), "doc_id", "text").withColumn("embedding", _letters(F.col("chunk"))))
    vectors = asked.select("query_id", _letters(F.col("query")).alias("v"))
    found = retrieval.hybrid_best(asked, vectors, stored, retrieval.index(stored, "chunk_id", "chunk"), stored.select("chunk_id", "doc_id", "chunk_index"), TOP, 5)
    best = retrieval.best_chunk(found.withColumn("score", F.round("score", 5)), "doc_id", "chunk_index")
    return retrieval.top(best, "doc_id", TOP).select("query_id", "doc_id", "chunk_id", F.round("vector_score", 4).alias("vector_score"), F.round("bm25_score", 4).alias("bm25_score"), "score", "rank")


def best_chunk_per_entry(spark, sf_dir):
    """Of each source the document that scores best for a query; ties to the smaller id."""
    sources = load(spark, sf_dir, "documents").select("doc_id", "source")
    return retrieval.best_chunk(_best(spark, sf_dir, 1, sources).join(sources, "doc_id"), "source", "doc_id").select("query_id", "source", "doc_id", "score")


def clause_hits(spark, sf_dir):
    """Of each source the two documents that score best for a query, as an entry's clauses are picked."""
    from tremolo.operators.search import best_clauses

    sources = load(spark, sf_dir, "documents").select("doc_id", "source")
    return best_clauses(_best(spark, sf_dir, 2, sources).join(sources, "doc_id"), "source", "doc_id", 2, "query_id").select("query_id", "source", "k", "doc_id", "score")


def query_overlap(spark, sf_dir):
    """Share of each benchmark item's tokens that each language's stated words hold."""
    words = retrieval.tokens(F.lit("the of and to in is for on with as de la le der die und el en que"))
    return load(spark, sf_dir, "benchmark").select("item_id", F.round(retrieval.overlap(words, retrieval.tokens(F.col("text"))), 6).alias("share"))


def distinct_sources(spark, sf_dir):
    rows = load(spark, sf_dir, "documents").select(F.lit(0).alias("g"), F.col("source").alias("name"), F.col("lang").alias("url"), F.lit("").alias("locator"), "doc_id")
    return retrieval.distinct_sources(rows, "g", "doc_id").select(F.col("name"), F.col("url").alias("lang"), F.col("doc_id").alias("first_doc"))


def vector_normalise(spark, sf_dir):
    rows = load(spark, sf_dir, "embeddings").select("vec_id", retrieval.normalised(F.col("embedding").cast("array<double>")).alias("v"))
    return rows.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x), 4).alias("norm2"))


def index_rebuild(spark, sf_dir):
    """Counts of a rebuild from an index of the vectors' ids to that of all documents."""
    old = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"))
    return retrieval.rebuilt(old, load(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id")))[1]


# --- rules ---

def _facts(spark, sf_dir) -> DataFrame:
    rows = compare_changes(spark, sf_dir)
    one = lambda f: F.max(F.when(F.col("feature") == f, F.struct("normal", "abnormal", "delta", "ratio")))
    changed = F.filter(F.array_sort(F.collect_list(F.when(F.abs(F.col("ratio") - 1) >= config.CHANGE_THRESHOLD, F.col("feature")))), lambda x: x.isNotNull())
    facts = rows.groupBy("sample_id").agg(*[one(f).alias(f) for f in ("rms", "peak", "kurtosis", "crest_factor")], changed.alias("changed_features"))
    blank = "struct<normal:double,abnormal:double,delta:double,ratio:double>"
    changes = F.struct(*[F.col(f).alias(f) for f in ("rms", "peak", "kurtosis", "crest_factor")], F.lit(None).cast(blank).alias("dominant_amplitude"), F.lit(None).cast(blank).alias("dominant_frequency"))
    null = lambda t: F.lit(None).cast(t)
    return facts.select(
        "sample_id", changes.alias("feature_changes"), "changed_features", null("struct<shift_hz:double,abnormal_dominant:double>").alias("frequency_change"), null("struct<shaft:double>").alias("fault_frequencies"),
        null("array<struct<label:string,harmonic_order:int>>").alias("matches"), null("array<struct<_order:double,label:string,abnormal:double,ratio:double>>").alias("characteristic_changes"),
        null("struct<label:string,ambiguous:boolean,margin_ratio:double,tied:array<string>,ratio:double>").alias("dominant"),
    )


def clause_checks(spark, sf_dir):
    made = rules.checked(_facts(spark, sf_dir), rules.clause_table(spark))
    return made.select("sample_id", "fault_type", "clause_id", F.round("actual", 4).alias("actual"), "expected", "state", "expectation")


def _text(v):
    return "NULL" if v is None else f"'{v}'"


_CLAUSES = "c(fault_type, clause_id, metric, op, value, family, ord) AS (VALUES " + ", ".join(f"({', '.join(map(_text, c))})" for c in rules.CLAUSES) + ")"
_CHECKS = f"""ch AS ({_CHANGES}), {_CLAUSES}, f AS (SELECT sample_id, count(*) FILTER (abs(ratio - 1) >= {config.CHANGE_THRESHOLD}) AS n, max(ratio) FILTER (feature = 'rms') AS rms, max(ratio) FILTER (feature = 'kurtosis') AS kurtosis, max(ratio) FILTER (feature = 'crest_factor') AS crest, max(ratio) FILTER (feature = 'peak') AS peak FROM ch GROUP BY 1),
  k AS (SELECT sample_id, fault_type, clause_id, op, CASE metric WHEN 'rms_ratio' THEN rms WHEN 'kurtosis_ratio' THEN kurtosis WHEN 'crest_factor_ratio' THEN crest WHEN 'peak_ratio' THEN peak WHEN 'changed_feature_count' THEN n END AS actual,
    CASE WHEN value = 'true' THEN 1.0 WHEN value = 'false' THEN 0.0 ELSE CAST(value AS DOUBLE) END AS expected, metric || coalesce('(' || family || ')', '') || ' ' || op || ' ' || value AS expectation FROM f, c),
  s AS (SELECT *, coalesce(CASE WHEN CASE op WHEN '>=' THEN actual >= expected WHEN '<=' THEN actual <= expected WHEN '>' THEN actual > expected WHEN '<' THEN actual < expected WHEN '==' THEN actual = expected ELSE actual <> expected END THEN 'hit' WHEN actual IS NOT NULL THEN 'miss' END, 'unknown') AS state FROM k)"""
_TALLY = """t AS (SELECT sample_id, fault_type, count(*) FILTER (state = 'hit') AS hits, count(*) FILTER (state = 'miss') AS misses, count(*) FILTER (state = 'unknown') AS unknowns, count(*) AS total FROM s GROUP BY 1, 2),
  u AS (SELECT *, hits + misses AS checked, CASE WHEN hits + misses = 0 THEN 'unverified' WHEN misses = 0 THEN 'consistent' WHEN misses < hits THEN 'partial' ELSE 'conflict' END AS state, CASE WHEN hits + misses = 0 THEN 1.0 ELSE round(0.4 + 0.6 * hits / (hits + misses), 4) END AS factor FROM t)"""


def clause_tallies(spark, sf_dir):
    made = rules.tallied(rules.checked(_facts(spark, sf_dir), rules.clause_table(spark)), "sample_id", "fault_type")
    return made


def alignment_rerank(spark, sf_dir):
    """Candidates with made-up retrieval scores (by the place of their name), re-ranked by their clauses."""
    tallies = clause_tallies(spark, sf_dir)
    order = Window.partitionBy("sample_id").orderBy("fault_type")
    made = tallies.select("sample_id", "fault_type").withColumn("rank", F.row_number().over(order).cast("long")).withColumn("score", F.round(0.9 - F.col("rank") * 0.05, 4))
    return rules.reranked(made, tallies.select("sample_id", "fault_type", "state", "factor"), "sample_id").select("sample_id", "fault_type", "rank", "score", "alignment_score", "align_rank", "state")


_RERANK = f"""WITH {_CHECKS}, {_TALLY}, r AS (SELECT sample_id, fault_type, state, factor, row_number() OVER (PARTITION BY sample_id ORDER BY fault_type) AS rank FROM u), q AS (SELECT *, round(0.9 - rank * 0.05, 4) AS score, round(round(0.9 - rank * 0.05, 4) * factor, 4) AS alignment_score FROM r),
  a AS (SELECT sample_id, fault_type, rank, CAST(score AS DOUBLE) AS score, CAST(alignment_score AS DOUBLE) AS alignment_score, row_number() OVER (PARTITION BY sample_id ORDER BY alignment_score DESC, rank) AS align_rank, state FROM q)"""


def candidate_gaps(spark, sf_dir):
    from tremolo.operators.verdict import gaps

    return gaps(alignment_rerank(spark, sf_dir), "sample_id").withColumn("gap", F.round("gap", 4))


def confidence_levels(spark, sf_dir):
    from tremolo.operators import verdict

    rows = alignment_rerank(spark, sf_dir).withColumns({"frequency_family": F.lit(None).cast("string"), "misses": F.lit(0)})
    led = verdict.leaders(rows, "sample_id")
    return led.select("sample_id", F.col("top.fault_type").alias("fault_type"), verdict.confidence(F.col("top"), F.col("second"), F.col("n"), F.lit(False)).alias("level"))


#: A clause for each metric that no registered clause uses, and for each operator.
_EXTRA = [
    ("probe", "probe-peak", "peak_ratio", ">", "1.5", None, None), ("probe", "probe-amplitude", "dominant_amplitude_ratio", ">=", "2", None, None), ("probe", "probe-energy", "envelope_energy", ">", "20", "BPFO", None),
    ("probe", "probe-ratio", "envelope_ratio", "<=", "2.5", "FTF", None), ("probe", "probe-rank", "envelope_rank", "!=", "1", "BSF", None), ("probe", "probe-orders", "peak_match_orders", "==", "2", "BPFI", None),
    ("probe", "probe-truth", "dominant_ambiguous", "!=", "yes", None, None), ("probe", "probe-tie", "tied_family", "==", "0", "BPFI", None), ("probe", "probe-third", "dominant_near_shaft", "==", "1", None, "3"),
    ("probe", "probe-word", "rms_ratio", ">=", "many", None, None), ("probe", "probe-operator", "rms_ratio", "~", "1", None, None), ("probe", "probe-metric", "no_such_metric", ">", "1", None, None),
]


def clause_metrics(spark, sf_dir):
    """Every metric and operator over facts with values: each part's size stands for the measurements of one comparison."""
    x = F.col("p_size").cast("double")
    blank = F.lit(None).cast("double")
    ratio = lambda r: F.struct(blank.alias("normal"), blank.alias("abnormal"), blank.alias("delta"), r.alias("ratio"))
    energy = {"BPFO": x, "BPFI": 51 - x, "BSF": F.lit(25.0), "FTF": F.abs(x - 25)}
    changes = F.array(*[F.struct((-e).alias("_order"), F.lit(k).alias("_pos"), F.lit(f).alias("label"), e.alias("abnormal"), (e / 10).alias("ratio")) for k, (f, e) in enumerate(energy.items())])
    first, second = F.element_at(F.array_sort(changes), 1), F.element_at(F.array_sort(changes), 2)
    margin = first["abnormal"] / second["abnormal"]
    tied = margin < config.DOMINANCE_MARGIN
    dominant = F.struct(first["label"].alias("label"), tied.alias("ambiguous"), margin.alias("margin_ratio"), F.when(tied, F.array(first["label"], second["label"])).otherwise(F.array().cast("array<string>")).alias("tied"))
    repeated = lambda f, n: F.array_repeat(F.struct(F.lit(f).alias("label"), F.lit(1).alias("harmonic_order")), n.cast("int"))
    facts = load(spark, sf_dir, "part").select(
        "p_partkey",
        F.struct(ratio(x / 25).alias("rms"), ratio(x / 20).alias("peak"), ratio((51 - x) / 25).alias("kurtosis"), ratio(F.when(x % 7 != 0, x / 30)).alias("crest_factor"), ratio(x / 10).alias("dominant_amplitude")).alias("feature_changes"),
        F.when(x != 50, F.array_repeat(F.lit("rms"), F.floor(x / 20).cast("int"))).alias("changed_features"),
        F.struct(((x - 25) / 4).alias("shift_hz"), (10 + x / 2).alias("abnormal_dominant")).alias("frequency_change"),
        F.when(x != 49, F.struct(x.alias("shaft"))).alias("fault_frequencies"),
        F.when(x != 48, F.concat(repeated("BPFO", x % 4), repeated("BPFI", x % 3))).alias("matches"),
        F.when(x != 47, changes).alias("characteristic_changes"), F.when(x != 47, dominant).alias("dominant"),
    )
    clauses = spark.createDataFrame([(k, *c) for k, c in enumerate(rules.CLAUSES + _EXTRA)], rules.clause_table(spark).schema)
    made = rules.checked(facts, clauses)
    return made.select("p_partkey", "clause_id", F.round("actual", 6).alias("actual"), "expected", "state")


# --- sessions: conversations stand in for them ---


def _sessions(spark, sf_dir):
    c = load(spark, sf_dir, "conversations").where("conv_id IS NOT NULL")
    s = c.groupBy(F.col("conv_id").alias("session_id")).agg(F.min("turn").alias("_t")).select("session_id", F.col("session_id").alias("created_at"))
    return s, c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("id"), "role", F.coalesce("text", F.lit("")).alias("content"))


def session_list(spark, sf_dir):
    return sessions.session_list(*_sessions(spark, sf_dir))


def session_retention(spark, sf_dir):
    _, kept = sessions.retained(*_sessions(spark, sf_dir))
    return kept.groupBy("session_id").agg(F.count(F.lit(1)).alias("messages"))


def history_window(spark, sf_dir):
    return sessions.history(_sessions(spark, sf_dir)[1]).select("session_id", "id", "pos", "role", "content")


def topic_router(spark, sf_dir):
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", sessions.topic(F.coalesce("text", F.lit(""))).alias("topic"))


_ASKED = [("greeting", "the"), ("article", "a"), ("is", "is this it")]


def question_match(spark, sf_dir):
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", sessions.known_question(F.coalesce("text", F.lit("")), _ASKED).alias("question"))


def session_counts(spark, sf_dir):
    s, m = _sessions(spark, sf_dir)
    return s.agg(F.count(F.lit(1)).alias("sessions")).join(m.agg(F.count(F.lit(1)).alias("messages")), F.lit(True))


def url_extract(spark, sf_dir):
    from tremolo.functions.scalars import urls

    rows = load(spark, sf_dir, "pages").select("page_id", F.explode(F.array_distinct(urls(F.concat_ws(" ", "url", "html")))).alias("url"))
    return rows


def allowed_urls(spark, sf_dir):
    """Of texts that name their own page's address, a part of it and the address of the page after, the URLs that don't fit the own one."""
    pages = load(spark, sf_dir, "pages").select(F.col("page_id").alias("session_id"), "url")
    after = pages.select((F.col("session_id") - 1).alias("session_id"), F.col("url").alias("other"))
    text = F.concat_ws(" ", F.lit("see"), "url", F.concat("url", F.lit("/more")), F.lit("and"), "other")
    return sessions.rejected_urls(pages.join(after, "session_id", "left").select("session_id", text.alias("answer")), pages, "answer", "session_id")


def event_payload_json(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return rows


def text_folding(spark, sf_dir):
    from tremolo.functions.scalars import folded

    return load(spark, sf_dir, "documents").select("doc_id", folded(F.coalesce("text", F.lit("")), config.HISTORY_CHARS).alias("short"))


_SPACE = r"'[ \t\n\f\r\v]+'"
_FOLD = f"trim(regexp_replace(coalesce({{0}}, ''), {_SPACE}, ' ', 'g'))"
_SHORT = f"CASE WHEN length({_FOLD}) > {config.HISTORY_CHARS} THEN substr({_FOLD}, 1, {config.HISTORY_CHARS}) || '…' ELSE {_FOLD} END"
_NORMAL = r"lower(regexp_replace(coalesce(text, ''), '[^\p{L}\p{N}]', '', 'g'))"
_URL = r"""'https?://[^\s，。；、）)\]}"''<>]+'"""


def _topics() -> str:
    says = lambda w: f"contains(lower(coalesce(text, '')), '{w}')"
    return "CASE " + " ".join(f"WHEN {' OR '.join(map(says, words))} THEN '{name}'" for name, words in sessions.TOPICS) + " END"


def _normal(t: str) -> str:
    return "".join(c for c in t.lower() if c.isalnum())


def _matched() -> str:
    return " ".join(f"WHEN starts_with({_NORMAL}, '{_normal(t)}') THEN '{k}'" for k, t in _ASKED)


QUERIES = {
    f.__name__: f
    for f in (
        token_counts, bm25_index_stats, bm25_topk, bm25_pruned, cosine_topk, hybrid_topk, hybrid_chunks, chunks, best_chunk_per_entry, clause_hits, query_overlap, distinct_sources, vector_normalise, index_rebuild, clause_checks, clause_metrics, clause_tallies,
        alignment_rerank, candidate_gaps, confidence_levels, session_list, session_retention, history_window, topic_router, question_match, session_counts, url_extract, allowed_urls, event_payload_json, text_folding,
    )
}

_STRIP = r"regexp_replace(regexp_replace({}, '^[\s\v]+', ''), '[\s\v]+$', '')"
#: Where the chunk of ``t`` that begins at ``at`` ends: after the last border of its tail, if it isn't the last chunk.
_E = f"least({{at}} + {config.CHUNK_SIZE}, length(t))"
_LOW = f"greatest({{at}} + 1, {_E} - {config.CHUNK_LOOKBACK})"
_TAIL = f"length(regexp_replace(substr(t, CAST({_LOW} AS BIGINT) + 1, CAST({_E} - {_LOW} AS BIGINT)), '[^{config.CHUNK_BORDERS}]*$', ''))"
_END = f"CASE WHEN {_E} < length(t) AND {_TAIL} > 0 THEN {_LOW} + {_TAIL} ELSE {_E} END"
_TOPK = f"SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM {{0}}) WHERE rank <= {TOP}"
_SHARED = "list_filter(list_distinct(list_transform(regexp_extract_all(text, " + _RE + "), lambda x: lower(x))), lambda x: list_contains(['the','of','and','to','in','is','for','on','with','as','de','la','le','der','die','und','el','en','que'], x))"
_ENERGY = {"BPFO": "x", "BPFI": "(51 - x)", "BSF": "25.0", "FTF": "abs(x - 25)"}
_RANKED = "SELECT p_partkey, list({'f': f, 'e': e} ORDER BY e DESC, k) AS r FROM (" + " UNION ALL ".join(f"SELECT p_partkey, {k} AS k, '{f}' AS f, {e} AS e FROM x WHERE x <> 47" for k, (f, e) in enumerate(_ENERGY.items())) + ") GROUP BY 1"
_OF = lambda form: "CASE family " + " ".join(f"WHEN '{f}' THEN {form(f, e)}" for f, e in _ENERGY.items()) + " END"
_METRICS = f"""WITH x AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS x FROM part), rk AS ({_RANKED}), c(fault_type, clause_id, metric, op, value, family, ord) AS (VALUES {", ".join(f"({', '.join(map(_text, c))})" for c in rules.CLAUSES + _EXTRA)}),
  f AS (SELECT x.p_partkey, x, r, r[1].e / r[2].e AS margin, r[1].e / r[2].e < {config.DOMINANCE_MARGIN} AS tied FROM x LEFT JOIN rk USING (p_partkey)),
  j AS (SELECT p_partkey, clause_id, op, CASE metric WHEN 'rms_ratio' THEN x / 25 WHEN 'peak_ratio' THEN x / 20 WHEN 'kurtosis_ratio' THEN (51 - x) / 25 WHEN 'crest_factor_ratio' THEN CASE WHEN x % 7 <> 0 THEN x / 30 END WHEN 'dominant_amplitude_ratio' THEN x / 10
      WHEN 'changed_feature_count' THEN CASE WHEN x <> 50 THEN floor(x / 20) END WHEN 'dominant_shift_hz' THEN abs((x - 25) / 4) WHEN 'dominant_near_shaft' THEN CASE WHEN x <> 49 AND x > 0 THEN CAST(abs(10 + x / 2 - x * coalesce(CAST(ord AS DOUBLE), 1)) / (x * coalesce(CAST(ord AS DOUBLE), 1)) <= {config.SHAFT_TOLERANCE} AS DOUBLE) END
      WHEN 'envelope_energy' THEN CASE WHEN x <> 47 THEN {_OF(lambda f, e: e)} END WHEN 'envelope_ratio' THEN CASE WHEN x <> 47 THEN {_OF(lambda f, e: e + " / 10")} END WHEN 'envelope_rank' THEN list_position(list_transform(r, lambda q: q.f), family) WHEN 'envelope_margin' THEN margin WHEN 'dominant_ambiguous' THEN CAST(tied AS DOUBLE)
      WHEN 'peak_match_orders' THEN CASE WHEN x <> 48 THEN CASE family WHEN 'BPFO' THEN x % 4 WHEN 'BPFI' THEN x % 3 ELSE 0 END END WHEN 'tied_family' THEN CASE WHEN tied THEN CAST(family IN (r[1].f, r[2].f) AS DOUBLE) END END AS actual,
    CASE WHEN metric IN ('dominant_near_shaft', 'dominant_ambiguous', 'tied_family') THEN CASE WHEN value IN ('true', '1', 'yes') THEN 1.0 WHEN value IN ('false', '0', 'no') THEN 0.0 END ELSE TRY_CAST(value AS DOUBLE) END AS expected FROM f, c),
  s AS (SELECT *, CASE op WHEN '>=' THEN actual >= expected WHEN '<=' THEN actual <= expected WHEN '>' THEN actual > expected WHEN '<' THEN actual < expected WHEN '==' THEN actual = expected WHEN '!=' THEN actual <> expected END AS holds FROM j)
  SELECT p_partkey, clause_id, round(CAST(actual AS DOUBLE), 6) AS actual, CAST(expected AS DOUBLE) AS expected, CASE WHEN holds IS NULL THEN 'unknown' WHEN holds THEN 'hit' ELSE 'miss' END AS state FROM s"""
_CHUNKS = f"WITH RECURSIVE d AS (SELECT doc_id, {_STRIP.format("coalesce(text, '')")} AS t FROM documents), r AS (SELECT doc_id, 0 AS p0, {_END.format(at=0)} AS e FROM d UNION ALL SELECT doc_id, nat AS p0, {_END.format(at='nat')} AS e FROM (SELECT r.doc_id, d.t, greatest(r.e - {config.CHUNK_OVERLAP}, r.p0 + 1) AS nat FROM r JOIN d USING (doc_id) WHERE r.e < length(d.t))), p AS (SELECT doc_id, p0, {_STRIP.format('substr(t, CAST(p0 AS BIGINT) + 1, CAST(e - p0 AS BIGINT))')} AS c, length(t) AS l FROM r JOIN d USING (doc_id)), k AS (SELECT doc_id, c, row_number() OVER (PARTITION BY doc_id ORDER BY p0) - 1 AS i FROM p WHERE c <> '' OR l = 0)"
_COUNTS = "CAST([length({0}) - length(replace({0}, x, '')) FOR x IN string_split('" + _LETTERS + "', '')] AS DOUBLE[])"
_NORM = "list_sum([x * x FOR x IN {0}])"
ORACLE = {
    "clause_metrics": _METRICS,
    "token_counts": f"WITH {_POST.format('p', 'doc_id', 'text', 'documents')} SELECT token, CAST(sum(tf) AS BIGINT) AS n, count(*) AS docs FROM p GROUP BY 1",
    "bm25_index_stats": f"WITH {_INDEX} SELECT token, df, round(idf, 4) AS idf FROM idf",
    "bm25_topk": f"WITH {_BM25} {_TOPK.format('bm')}",
    "bm25_pruned": f"WITH {_BM25} {_TOPK.format('bm')}",
    "cosine_topk": f"WITH {_COS} {_TOPK.format('cs')}",
    "hybrid_topk": f"""WITH {_BM25}, {_COS}, h AS (SELECT coalesce(cs.query_id, bm.query_id) AS query_id, coalesce(cs.doc_id, bm.doc_id) AS doc_id, coalesce(cs.score, 0) AS vector_score, coalesce(bm.score, 0) AS bm25_score FROM cs FULL JOIN bm ON cs.query_id = bm.query_id AND cs.doc_id = bm.doc_id),
      k AS (SELECT *, round(greatest(0, least(1, {config.VECTOR_WEIGHT} * vector_score + {config.BM25_WEIGHT} * bm25_score)), 5) AS score FROM h WHERE doc_id IN (SELECT doc_id FROM documents)) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM k) WHERE rank <= {TOP}""",
    "best_chunk_per_entry": f"WITH {_BM25}, j AS (SELECT bm.*, source, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, doc_id) AS k FROM bm JOIN documents USING (doc_id)) SELECT query_id, source, doc_id, score FROM j WHERE k = 1",
    "clause_hits": f"WITH {_BM25}, j AS (SELECT bm.*, source, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, doc_id) AS k FROM bm JOIN documents USING (doc_id) WHERE score > 0) SELECT query_id, source, k, doc_id, score FROM j WHERE k <= 2",
    "chunks": f"{_CHUNKS} SELECT doc_id, i AS chunk_index, doc_id || '#chunk-' || printf('%03d', i) AS chunk_id, CAST(length(c) AS INTEGER) AS n_chars, md5(c) AS md5 FROM k",
    "hybrid_chunks": f"""WITH ck AS ({_CHUNKS} SELECT doc_id || '#chunk-' || printf('%03d', i) AS doc_id, doc_id AS entry, i, c AS text FROM k), {_BM25.replace('documents', 'ck')},
      cv AS (SELECT doc_id, {_COUNTS.format('text')} AS v FROM ck), qv AS (SELECT item_id AS query_id, {_COUNTS.format('text')} AS v FROM benchmark),
      cs AS (SELECT query_id, doc_id, CASE WHEN {_NORM.format('cv.v')} > 0 AND {_NORM.format('qv.v')} > 0 THEN greatest(0, least(1, list_cosine_similarity(qv.v, cv.v))) ELSE 0 END AS score FROM qv, cv),
      bx AS (SELECT query_id, id AS doc_id, greatest(0, least(1, {config.BM25_SCALE} * dot / (qnorm * norm))) AS score FROM dots JOIN qn USING (query_id) JOIN norm USING (id)),
      h AS (SELECT query_id, doc_id, cs.score AS vector_score, coalesce(bx.score, 0) AS bm25_score FROM cs LEFT JOIN bx USING (query_id, doc_id)),
      e AS (SELECT h.*, entry, i, round(greatest(0, least(1, {config.VECTOR_WEIGHT} * vector_score + {config.BM25_WEIGHT} * bm25_score)), 5) AS score FROM h JOIN ck USING (doc_id)),
      b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, entry ORDER BY score DESC, i) AS n FROM e) WHERE n = 1)
      SELECT query_id, entry AS doc_id, doc_id AS chunk_id, round(vector_score, 4) AS vector_score, round(bm25_score, 4) AS bm25_score, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry) AS rank FROM b) WHERE rank <= {TOP}""",
    "query_overlap": f"SELECT item_id, round(CAST(len({_SHARED}) AS DOUBLE) / greatest(1, len(list_distinct(list_transform(regexp_extract_all(text, {_RE}), lambda x: lower(x))))), 6) AS share FROM benchmark",
    "distinct_sources": "SELECT source AS name, lang, min(doc_id) AS first_doc FROM documents GROUP BY 1, 2",
    "vector_normalise": "SELECT vec_id, round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / n)), 4) AS total, round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: (x / n) * (x / n))), 4) AS norm2 FROM (SELECT *, sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) AS n FROM embeddings)",
    "index_rebuild": "SELECT count(doc_id) AS upserted, count(*) FILTER (doc_id IS NULL) AS pruned, count(*) FILTER (vec_id IS NULL) AS added FROM documents FULL JOIN embeddings ON doc_id = vec_id",
    "clause_checks": f"WITH {_CHECKS} SELECT sample_id, fault_type, clause_id, round(actual, 4) AS actual, expected, state, expectation FROM s",
    "clause_tallies": f"WITH {_CHECKS}, {_TALLY} SELECT sample_id, fault_type, hits, misses, unknowns, checked, total, state, CAST(factor AS DOUBLE) AS factor FROM u",
    "alignment_rerank": f"{_RERANK} SELECT * FROM a",
    "candidate_gaps": f"{_RERANK} SELECT sample_id, round(gap, 4) AS gap FROM (SELECT *, score - lead(score) OVER (PARTITION BY sample_id ORDER BY align_rank) AS gap FROM a) WHERE align_rank = 1",
    "confidence_levels": f"{_RERANK} SELECT a.sample_id, a.fault_type, CASE WHEN a.state = 'conflict' OR a.score < 0.5 THEN 'low' WHEN a.score >= 0.6 AND a.score - b.score >= 0.08 THEN 'high' ELSE 'medium' END AS level FROM a JOIN a b ON a.sample_id = b.sample_id AND b.align_rank = 2 WHERE a.align_rank = 1",
    "session_list": f"SELECT conv_id AS session_id, conv_id AS created_at, count(*) AS message_count FROM conversations GROUP BY 1 ORDER BY 1 DESC LIMIT {config.SESSIONS_KEPT}",
    "session_retention": f"SELECT conv_id AS session_id, count(*) AS messages FROM conversations WHERE conv_id IN (SELECT DISTINCT conv_id FROM conversations ORDER BY 1 DESC LIMIT {config.SESSIONS_KEPT}) GROUP BY 1",
    "history_window": f"SELECT conv_id AS session_id, turn AS id, n - k AS pos, role, {_SHORT.format('text')} AS content FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k, least(count(*) OVER (PARTITION BY conv_id), {2 * config.HISTORY_TURNS}) AS n FROM conversations) WHERE k <= {2 * config.HISTORY_TURNS}",
    "topic_router": f"SELECT conv_id, turn, {_topics()} AS topic FROM conversations",
    "question_match": f"SELECT conv_id, turn, CASE {_matched()} END AS question FROM conversations",
    "session_counts": "SELECT count(DISTINCT conv_id) AS sessions, count(*) AS messages FROM conversations",
    "url_extract": f"SELECT DISTINCT page_id, unnest(regexp_extract_all(concat_ws(' ', url, html), {_URL})) AS url FROM pages",
    "allowed_urls": f"SELECT DISTINCT p.page_id AS session_id, u AS url FROM (SELECT a.page_id, a.url, unnest(regexp_extract_all(concat_ws(' ', 'see', a.url, a.url || '/more', 'and', b.url), {_URL})) AS u FROM pages a LEFT JOIN pages b ON b.page_id = a.page_id + 1) p WHERE NOT (starts_with(u, p.url) OR starts_with(p.url, u))",
    "event_payload_json": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "text_folding": f"SELECT doc_id, {_SHORT.format('text')} AS short FROM documents",
}
