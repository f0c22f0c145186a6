"""Personal data: typed patterns, and terms that disclose them by co-occurrence.

The patterns give protected entities (one email, address, card or phone number each).
Around each occurrence stand terms; over the whole corpus, pointwise mutual
information tells how much of an entity a term discloses. A term of an entity's
neighbourhood that discloses at least a set share of the entity's information is
generalised, one that discloses all of it is removed, wherever it stands in the
documents that hold the entity. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremolo.session import Stage

#: Kinds in the order in which spans that start together are listed; the last is the method's own.
KINDS = ("email", "ip", "card", "phone", "secret", "term")
#: The first of them are the base patterns.
BASE, TERMS = 4, 5
#: The patterns, written so that no start is tried twice: a match begins at the
#: first character of its run or where the match before it ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: A name for a credential, a sign of assignment, and a run of 12 characters or more with a digit.
SECRET = r"(?i)\b(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key)[\x22']?\s*+[:=]\s*+[\x22']?(?=[a-z_+/=.-]*+[0-9])[a-z0-9_+/=.-]{12,}+"
TERM = r"\p{L}[\p{L}\p{M}\p{N}'’]*+"
#: What can belong to a term.
RUN = r"[\p{L}\p{M}\p{N}'’]++"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"

SPAN = "array<struct<start:int,end:int,value:string>>"
#: Matches to a block while their places are summed, and code points to a chunk of a text that is cut at many places.
PIECES, CHUNK = 128, 4096
#: Stand-ins for letters and for other characters of terms inside spans: signs of scripts that nobody writes any more
#: (Linear A, Aegean). A term with one of them overlaps a span.
LETTER, OTHER = "\U00010600", "\U00010107"


@dataclass(frozen=True)
class Disclosure:
    """Parameters of the sanitisation.

    reach: characters on either side of an entity that count as its neighbourhood, which proposes terms.
    support: documents that must hold both a term and an entity; one document is no co-occurrence.
    certainty: standard errors by which the estimate is lowered (1.2816: 90 % of it are above, on one side).
    share: a term is generalised if its lowered PMI is at least this share of the entity's information.
    shortest: characters of a term at least.
    full: a term is removed if its PMI as counted is at least this share.
    """

    reach: int = 120
    support: int = 2
    certainty: float = 1.2816
    share: float = 0.8
    shortest: int = 3
    full: float = 0.999
    broadcast_rows: int = 300_000


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as (start, end, value), in code points, end exclusive."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("value"))
    empty = F.array().cast(SPAN)
    zero = F.struct(F.lit(0).alias("at"), empty.alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["gap"])
        end = start + F.char_length(x["value"])
        one = F.array(F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value")))
        return F.struct(F.coalesce(end, start).alias("at"), F.when(x["value"].isNull(), acc["spans"]).otherwise(F.concat(acc["spans"], one)).alias("spans"))

    def join(acc: Column, b: Column) -> Column:
        moved = F.transform(b["spans"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), (s["end"] + acc["at"]).alias("end"), s["value"].alias("value")))
        return F.struct((acc["at"] + b["at"]).alias("at"), F.concat(acc["blocks"], F.array(moved)).alias("blocks"))

    def whole(pieces: Column) -> Column:
        # Spans are gathered in blocks, as each that is appended copies those before it.
        last = F.floor((F.size(pieces) - 1) / PIECES).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), last), lambda k: F.aggregate(F.slice(pieces, k * PIECES + 1, F.lit(PIECES)), zero, step))
        none = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("blocks"))
        return F.aggregate(blocks, none, join, lambda acc: F.flatten(acc["blocks"]))

    return F.when(F.size(found) > 0, F.element_at(F.transform(F.array(pieces), whole), 1)).otherwise(empty)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


#: By kind: the pattern, what a text must contain to hold one, which matches count, and how values are compared.
_RULES: list[tuple[str, Callable, Callable, Callable]] = [
    (EMAIL, lambda t: t.contains("@"), lambda v: F.lit(True), F.lower),
    (IP, lambda t: t.rlike(r"[0-9]\.[0-9]"), lambda v: v.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"), lambda v: v),
    (CARD, lambda t: t.rlike(r"[0-9][\x20-]?[0-9]"), lambda v: F.length(_digits(v)).between(12, 19) & F.call_function("luhn_check", _digits(v)), _digits),
    (PHONE, lambda t: t.contains("+"), lambda v: F.length(_digits(v)).between(9, 15), _digits),
    (SECRET, lambda t: t.rlike(SECRET), lambda v: F.lit(True), lambda v: v),
]


def base_spans(text: Column) -> Column:
    """array of (start, kind number, end, entity) of all patterns, by start, then kind."""
    none = F.array().cast("array<struct<start:int,kind:int,end:int,entity:string>>")

    def of(k: int) -> Column:
        pattern, may, valid, same = _RULES[k]
        spans = F.filter(matches(text, pattern), lambda s: valid(s["value"]))
        tagged = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end"), F.concat(F.lit(f"{k}:"), same(s["value"])).alias("entity")))
        return F.when(may(text), tagged).otherwise(none)

    return F.array_sort(F.concat(*map(of, range(len(_RULES)))))


def _once(value: Column, make: Callable) -> Column:
    """make(value), with ``value`` worked out once, however often lambdas inside use it."""
    return F.element_at(F.transform(F.array(value), make), 1)


def _chunks(text: Column) -> Column:
    """The text in chunks, so that a cut at any place reads no more than a chunk or two."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def _cut(chunks: Column, start: Column, end: Column) -> Column:
    """The text from ``start`` to ``end`` (code points) of a text in chunks."""
    first, last = F.floor(start / CHUNK).cast("int"), F.floor((end - 1) / CHUNK).cast("int")
    at = start - first * CHUNK + 1
    part = lambda k, a, n: F.coalesce(F.substring(F.get(chunks, k), a, n), F.lit(""))
    middle = F.array_join(F.slice(chunks, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    return F.when(end <= start, "").when(first == last, part(first, at, end - start)).otherwise(F.concat(part(first, at, F.lit(CHUNK)), middle, part(last, F.lit(1), end - last * CHUNK)))


def _covered(spans: Column, kind: str) -> Column:
    """Spans, in order, without overlaps: a later one keeps what an earlier one leaves of it. Done in blocks, as in ``matches``."""
    none = F.array().cast(f"array<{kind}>")

    def step(acc: Column, s: Column) -> Column:
        clipped = s.withField("start", F.greatest(s["start"], acc["at"]))
        return F.when(s["end"] <= acc["at"], acc).otherwise(F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(clipped)).alias("out")))

    def whole(spans: Column) -> Column:
        last = F.floor((F.size(spans) - 1) / PIECES).cast("int")
        zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{kind}>>").alias("blocks"))

        def block(acc: Column, k: Column) -> Column:
            inner = F.aggregate(F.slice(spans, k * PIECES + 1, F.lit(PIECES)), F.struct(acc["at"].alias("at"), none.alias("out")), step)
            return _once(inner, lambda x: F.struct(x["at"].alias("at"), F.concat(acc["blocks"], F.array(x["out"])).alias("blocks")))

        return F.aggregate(F.sequence(F.lit(0), last), zero, block, lambda acc: F.flatten(acc["blocks"]))

    return F.when(F.size(spans) > 0, _once(spans, whole)).otherwise(none)


def _rebuilt(text: Column, spans: Column, kind: str, put: Callable) -> Column:
    """The text with each span (of what ``_covered`` leaves) put as ``put(span, its text)``."""

    def make(chunks: Column, own: Column) -> Column:
        def piece(s: Column, k: Column) -> Column:
            before = F.when(k == 0, F.lit(0)).otherwise(F.get(own, k - 1)["end"])
            return F.concat(_cut(chunks, before, s["start"]), put(s, _cut(chunks, s["start"], s["end"])))

        tail = _cut(chunks, F.element_at(own, -1)["end"], F.char_length(text))
        return F.concat(F.array_join(F.transform(own, piece), ""), tail)

    return F.when(F.size(spans) > 0, _once(_chunks(text), lambda c: _once(_covered(spans, kind), lambda o: make(c, o)))).otherwise(text)


_BASE = "struct<start:int,kind:int,end:int,entity:string>"


def _masked(text: Column, spans: Column) -> Column:
    """The text, as long as it was, with all that could belong to a term inside spans replaced by LETTER and OTHER."""
    return _rebuilt(text, spans, _BASE, lambda s, part: F.regexp_replace(F.regexp_replace(part, r"\p{L}", LETTER), r"[\p{M}\p{N}'’]", OTHER))


def _terms(text: Column) -> Column:
    """Matches of terms in a masked text that overlap no span."""
    return F.filter(matches(text, TERM), lambda t: _free(t["value"]))


def _free(term: Column) -> Column:
    return ~term.contains(LETTER) & ~term.contains(OTHER)


def _key() -> Column:
    """A document's identity: its id and its text."""
    return F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.md5(F.coalesce("text", F.lit(""))))


def find(docs: DataFrame, p: Disclosure, stage: Stage) -> DataFrame:
    """(doc_id, doc, spans, held), written: one row a document; ``held`` is its masked text if it has spans."""
    rows = docs.select("doc_id", _key().alias("doc"), F.coalesce("text", F.lit("")).alias("text")).withColumn("spans", base_spans(F.col("text")))
    return stage.write(rows.select("doc_id", "doc", "spans", F.when(F.size("spans") > 0, _masked(F.col("text"), F.col("spans"))).alias("held")))


def _sized(df: DataFrame, n: int, p: Disclosure) -> DataFrame:
    """Broadcast if counted to be small; else the join is Spark's choice, by shuffle if need be."""
    return F.broadcast(df) if n <= p.broadcast_rows else df


def lowered(hits: Column, of: Column, z: float) -> Column:
    """The lower end of Wilson's interval for a rate of ``hits`` in ``of``, at ``z`` standard errors on one side."""
    rate, z2 = hits / of, z * z
    return (rate + z2 / (2 * of) - z * F.sqrt(rate * (1 - rate) / of + z2 / (4 * of * of))) / (1 + z2 / of)


def _distinct_docs(docs: DataFrame, found: DataFrame, p: Disclosure, stage: Stage) -> DataFrame:
    """``docs`` with each document once: only rows that repeat another (same id and text) are shuffled."""
    repeated = stage.write(found.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc"))
    many = repeated.count()
    if many == 0:
        return docs
    docs, repeated = docs.withColumn("doc", _key()), _sized(repeated, many, p)
    return docs.join(repeated, "doc", "left_anti").unionByName(docs.join(repeated, "doc", "left_semi").dropDuplicates(["doc"]))


def disclosing(docs: DataFrame, found: DataFrame, p: Disclosure, stage: Stage) -> DataFrame:
    """(doc, start, end, share), written: the terms that disclose an entity of their document.

    A term is proposed for an entity if it stands near it in some document. With N documents (rows of
    the same id and text are one) as contexts, n_c those that hold the entity, n_t those that hold the term, and
    n_tc those that hold both, wherever they stand: PMI = ln(r N / n_c) with r = n_tc / n_t, the entity's information
    is ln(N / n_c), and ``share`` is their quotient, 1 at most. As a few documents prove little, a term is
    flagged by the share that the lower end of Wilson's interval for r gives. All places of such a term in the
    entity's documents are listed; documents without the entity keep the term.

    What a text holds n of is read and joined in proportion to n: places of terms meet their
    shares by document and term, after all entities of that document have been looked at.
    """
    docs = _distinct_docs(docs, found, p, stage)
    n = F.lit(float(found.select("doc").distinct().count()))
    informs = lambda rate: F.log(rate * n / F.col("n_c")) / F.nullif(F.log(n / F.col("n_c")), F.lit(0.0))
    least = lambda n_tc: informs(lowered(n_tc, F.col("n_t"), p.certainty))
    none = lambda: stage.write(docs.sparkSession.createDataFrame([], "doc string, start int, end int, share double"))
    holding = found.select("doc", F.explode(F.array_distinct(F.transform("spans", lambda s: s["entity"]))).alias("entity")).distinct()
    holders = stage.write(holding.groupBy("entity").agg(F.count(F.lit(1)).alias("n_c")).where(F.col("n_c") >= p.support))
    number = holders.count()
    if number == 0:
        return none()
    holders = _sized(holders, number, p)
    holding = stage.write(holding.join(holders.select("entity"), "entity", "left_semi"))

    def near(chunks: Column, size: Column) -> Column:
        def around(s: Column) -> Column:
            at, end = F.greatest(s["start"] - p.reach, F.lit(0)), F.least(s["end"] + p.reach, size)
            return F.struct(s["entity"].alias("entity"), _cut(chunks, at, end).alias("near"), (at > 0).alias("opened"), (end < size).alias("cut"))

        return F.transform("spans", around)

    windows = found.where(F.size("spans") > 0).select(F.explode(_once(_chunks(F.col("held")), lambda c: _once(F.char_length("held"), lambda n: near(c, n)))).alias("w")).select("w.*")
    windows = windows.join(holders.select("entity"), "entity", "left_semi")
    # A run at the window's edge may have been cut there.
    whole = F.when(F.col("opened"), F.regexp_replace("near", rf"^{RUN}", "")).otherwise(F.col("near"))
    whole = F.when(F.col("cut"), F.regexp_replace(whole, rf"(?<!{RUN[:-2]}){RUN}$", "")).otherwise(whole)
    terms = F.filter(F.regexp_extract_all(whole, F.lit(TERM), F.lit(0)), lambda t: _free(t) & (F.char_length(t) >= p.shortest))
    windows = windows.select("entity", F.array_distinct(F.transform(terms, F.lower)).alias("terms"))
    pairs = stage.write(windows.select("entity", F.explode("terms").alias("term")).distinct())
    candidates = stage.write(pairs.select("term").distinct())
    few = candidates.count()
    if few == 0:
        return none()
    said = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(TERM), F.lit(0)))).alias("term"))
    if few <= p.broadcast_rows:
        said = said.join(F.broadcast(candidates), "term", "left_semi")
    counts = said.groupBy("term").agg(F.count(F.lit(1)).alias("n_t")).where(F.col("n_t") >= p.support)
    # Pairs that would not reach the share if each document of the rarer one held both need no count.
    pairs = pairs.join(counts, "term").join(holders, "entity").where(least(F.least("n_t", "n_c")) >= p.share - 1e-9)
    pairs = stage.write(pairs)
    many = pairs.count()
    if many == 0:
        return none()
    pairs = _sized(pairs, many, p)
    places = found.where(F.size("spans") > 0).select("doc", F.explode(F.filter(_terms(F.col("held")), lambda t: F.char_length(t["value"]) >= p.shortest)).alias("t"))
    places = places.select("doc", F.lower("t.value").alias("term"), F.col("t.start").alias("start"), F.col("t.end").alias("end"))
    places = stage.write(places.join(_sized(pairs.select("term").distinct(), many, p), "term", "left_semi"))
    both = stage.write(holding.join(pairs.select("entity", "term"), "entity").join(places.select("doc", "term").distinct(), ["doc", "term"]))
    n_tc = both.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_tc")).where(F.col("n_tc") >= p.support)
    flagged = stage.write(n_tc.join(pairs, ["entity", "term"]).where(least(F.col("n_tc")) >= p.share).select("entity", "term", informs(F.col("n_tc") / F.col("n_t")).alias("share")))
    told = both.join(_sized(flagged, flagged.count(), p), ["entity", "term"]).groupBy("doc", "term").agg(F.max("share").alias("share"))
    return stage.write(places.distinct().join(told, ["doc", "term"]).select("doc", "start", "end", "share"))


_ALL = "struct<start:int,kind:int,end:int,share:double>"


def _plain(spans: Column) -> Column:
    bare = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.lit(None).cast("double").alias("share"))
    return F.transform(spans, bare).cast(f"array<{_ALL}>")


def scan(docs: DataFrame, params: Disclosure = Disclosure()) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): base and spans, arrays of (start, kind, end, share).

    ``kind`` is a place in KINDS; ``base`` has the base patterns' spans, ``spans`` all, with secrets and
    the terms that disclose; share is null but for terms. Null texts count as
    empty; null ids are an identity of their own; repeated rows each get a row; an empty table
    gives none; only doc_id and text are read, so other columns can't clash.
    """
    stage = Stage(docs.sparkSession, "pii")
    docs = docs.select("doc_id", "text")
    found = find(docs, params, stage)
    hits = disclosing(docs, found, params, stage)
    rows = found.select("doc_id", "doc", _plain(F.col("spans")).alias("spans"))
    base = F.filter("spans", lambda s: s["kind"] < BASE)
    return _with_hits(rows, hits, params, "doc", "extra").select("doc_id", base.alias("base"), F.array_sort(F.concat("spans", "extra")).alias("spans"))


def _with_hits(rows: DataFrame, hits: DataFrame, p: Disclosure, key: str, out: str) -> DataFrame:
    """Adds ``out``, the method's spans, by document."""
    own = hits.groupBy(F.col("doc").alias("_tremolo_d")).agg(F.collect_list(F.struct("start", F.lit(TERMS).alias("kind"), "end", "share")).cast(f"array<{_ALL}>").alias("_tremolo_e"))
    joined = rows.join(_sized(own, hits.count(), p), rows[key] == F.col("_tremolo_d"), "left")
    return joined.withColumn(out, F.coalesce("_tremolo_e", F.array().cast(f"array<{_ALL}>"))).drop("_tremolo_d", "_tremolo_e")


def _with_spans(rows: DataFrame, found: DataFrame, p: Disclosure) -> DataFrame:
    """Adds _tremolo_base, the patterns' spans: those found before, if few enough were counted to be broadcast, else taken again from the texts, which is less work than to shuffle these."""
    held = found.where(F.size("spans") > 0).select(F.col("doc").alias("_tremolo_d"), F.col("spans").alias("_tremolo_s"))
    if (held.agg(F.sum(F.size("_tremolo_s"))).first()[0] or 0) > p.broadcast_rows:
        return rows.withColumn("_tremolo_base", base_spans(F.coalesce("text", F.lit(""))))
    joined = rows.join(F.broadcast(held.dropDuplicates(["_tremolo_d"])), rows["_tremolo_doc"] == F.col("_tremolo_d"), "left")
    return joined.withColumn("_tremolo_base", F.coalesce("_tremolo_s", F.array().cast(f"array<{_BASE}>"))).drop("_tremolo_d", "_tremolo_s")


def sanitise(docs: DataFrame, params: Disclosure = Disclosure()) -> DataFrame:
    """``docs`` with personal data and disclosing terms taken out of ``text``; all columns stay.

    A pattern's match becomes its kind in brackets. A term that discloses its entity fully
    becomes empty; one above the threshold is generalised to [NAME] if it begins with a
    capital, else to [TERM]. Spans go in the order of their starts, the longest first; one that
    overlaps those before it goes as far as they leave it.
    If there is a column n_chars, it is brought up to date. Cases as for ``scan``; a null
    text stays null. A text with many spans is cut in chunks and joined once.
    """
    stage = Stage(docs.sparkSession, "pii")
    found = find(docs, params, stage)
    hits = disclosing(docs.select("doc_id", "text"), found, params, stage)
    rows = docs.withColumn("_tremolo_doc", _key())
    rows = _with_hits(rows, hits, params, "_tremolo_doc", "_tremolo_extra")
    rows = _with_spans(rows, found, params)
    rows = rows.withColumn("_tremolo_spans", F.array_sort(F.concat(_plain(F.col("_tremolo_base")), "_tremolo_extra"), _order))

    def put(s: Column, part: Column) -> Column:
        label = F.element_at(F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS]), s["kind"] + 1)
        term = F.when(s["share"] >= params.full, "").when(part.rlike(r"^\p{Lu}"), "[NAME]").otherwise("[TERM]")
        return F.when(s["kind"] < TERMS, label).otherwise(term)

    out = rows.withColumn("text", _rebuilt(F.col("text"), F.col("_tremolo_spans"), _ALL, put))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def _order(a: Column, b: Column) -> Column:
    return F.when(a["start"] != b["start"], a["start"] - b["start"]).when(a["end"] != b["end"], b["end"] - a["end"]).otherwise(a["kind"] - b["kind"])


def listed(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"], s["end"])), ",")
