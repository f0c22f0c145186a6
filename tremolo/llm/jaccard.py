"""N-gram Jaccard self-join by a size-aware heavy-light scheme; exact.

A document is its set of word shingles. Two sets that are similar enough share so many
elements that, in any common order of all elements, their first shared ones lie in the
first few of each: in the first m - o + c there are c shared ones, where m is the set's size and o the
least overlap. Light sets (up to a boundary) enumerate the c-subsets of these few, for
c = 2, and meet in equal subsets. Heavy sets are found by scanning inverted lists of
single elements (c = 1); light sets near the boundary are listed there too. The boundary is where
the cost of subsets reaches that of lists. The order goes by how often elements occur in all
documents, as a table of counters by hash tells, rare ones first, so that neither passages that many
documents share nor word sequences that come up by chance fill the lists.

Lists of near copies are dense. Pairs are therefore tried in rounds: at first each set with
one hub of its lists, then, of what is still apart, with others as long as that helps and more pairs than list
entries are left, and at last all pairs of a list that lie in different components. Every pair that could join two components is
compared on the whole sets, so that no link between components is lost and no group is expanded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremolo.llm.common import Memo, lean, slices, whole_texts
from tremolo.llm.components import components
from tremolo.session import Stage

_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


@dataclass(frozen=True)
class Params:
    """words: of a shingle. percent: of the union that the intersection must reach. counters: elements
    are counted in at most so many (a byte each is broadcast; it changes no result). rounds: with hubs, at most.
    broadcast_rows: ids that are broadcast at most."""

    words: int = 5
    percent: int = 80
    counters: int = 1 << 24
    rounds: int = 8
    broadcast_rows: int = 500_000


#: Counters to a row when tasks' tables are added up; bytes of the table (by Spark's estimate) to a counter.
PART, BYTES = 1 << 11, 128


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingler(words: int):
    """A function from a text to the sorted 64-bit hashes of its distinct shingles.

    Words are runs without ASCII white space, A-Z in lower case; fewer words than a shingle's
    are one shingle together; no words are none.
    """
    memo = Memo(lambda w: xxhash.xxh3_64_digest(w), 60_000)
    factors = [_mixed(np.uint64(k + 1) * _M[k % 5]) | np.uint64(1) for k in range(words)]

    def of(text: str | None) -> np.ndarray:
        tokens = (text or "").encode().lower().split()
        h = np.frombuffer(b"".join(map(memo.__getitem__, tokens)), "<u8")
        n = len(h)
        with np.errstate(over="ignore"):
            if n == 0:
                return np.zeros(0, np.uint64)
            if n < words:
                total = np.uint64(n)
                for k in range(n):
                    total = total + h[k] * factors[k]
                return _mixed(np.array([_mixed(total)], np.uint64))
            total = h[: n - words + 1] * factors[0]
            for k in range(1, words):
                total = total + h[k : n - words + 1 + k] * factors[k]
        return np.unique(_mixed(total))

    return of


def least_overlap(m: int, percent: int) -> int:
    """The shared elements that a set of size m has at least with any similar set."""
    return -(-percent * m // 100)


def _counters(docs: DataFrame, p: Params) -> int:
    """A power of two that grows with the table, up to ``p.counters``."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return 1 << min(max(size // BYTES, 1 << 18), p.counters).bit_length() - 1


def _counted(docs: DataFrame, p: Params, stage: Stage) -> tuple[np.ndarray, float]:
    """The level (the logarithm of a count, in eighths) of each counter, and the mean number of other documents in an element's list.

    All documents are read. An element is counted where the first bits of its hash say, so a
    counter is never less than the number of documents that hold any of its elements. Of each slice
    those in more documents than one of 500 take no part in the mean.
    """
    size = _counters(docs, p)
    shift, part = np.uint64(64 - (size.bit_length() - 1)), min(PART, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, table = shingler(p.words), np.zeros(size, np.uint32)
        rest = pairs = slots = 0
        for whole in batches:
            for b in slices(whole, "text", 4 << 20):
                x, n = np.unique(np.concatenate([of(t) for t in b.column(0).to_pylist()]), return_counts=True)
                np.add.at(table, x >> shift, n.astype(np.uint32))
                seldom = n[n < max(2, b.num_rows // 500)].astype(np.int64)
                rest, pairs, slots = rest + int(seldom.sum()), pairs + int((seldom * (seldom - 1)).sum()), slots + 1
        rows = table.reshape(-1, part)
        used = np.flatnonzero(rows.any(1))
        for k in used:
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([rows[k].tobytes()], pa.binary())], ["part", "counts"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([np.array([rest, pairs, slots], np.int64).tobytes()], pa.binary())], ["part", "counts"])

    def add(key: tuple, rows: pa.Table) -> pa.Table:
        kind = np.int64 if key[0].as_py() < 0 else np.uint32
        total = sum(np.frombuffer(r.as_buffer(), kind).astype(np.int64) for r in rows.column("counts"))
        level = total if kind is np.int64 else np.minimum(np.round(8 * np.log2(1.0 + total)), 255).astype(np.uint8)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "counts": pa.array([level.tobytes()], pa.binary())})

    made = whole_texts(docs.select("text")).mapInArrow(lean(run), "part long, counts binary").groupBy("part").applyInArrow(add, "part long, counts binary")
    levels, stat = np.zeros((size // part, part), np.uint8), np.zeros(3, np.int64)
    for r in stage.write(made).toLocalIterator():  # a byte a counter in all
        if r.part < 0:
            stat = np.frombuffer(r.counts, np.int64)
        else:
            levels[r.part] = np.frombuffer(r.counts, np.uint8)
    return levels.ravel(), float(stat[1] / max(1, stat[0]) * stat[2])


def boundary(partners: float, percent: int) -> int:
    """The largest size at which a set's 2-subsets cost no more rows than its list entries and the partners that they meet."""
    best = 4
    for m in range(4, 200):
        few = m - least_overlap(m, percent)
        if (few + 2) * (few + 1) / 2 <= (few + 1) * (1 + max(1.0, partners)):
            best = m
    return best


def signatures(s: np.ndarray, levels: np.ndarray, light: int, percent: int) -> np.ndarray:
    """The signatures of a set (its sorted hashes): subsets have the lowest bit set, single elements have not."""
    m = len(s)
    if m < 2:
        return np.zeros(0, np.uint64)
    if len(levels) > 1:
        s = s[np.argsort(levels[s >> np.uint64(65 - len(levels).bit_length())], kind="stable")]
    few = m - least_overlap(m, percent)
    sig = []
    if m <= light:
        i, j = np.triu_indices(min(m, few + 2), 1)
        with np.errstate(over="ignore"):
            sig.append(_mixed(s[i] * _M[0] + _mixed(s[j] + _M[1])) | np.uint64(1))
    if m > light or 100 * m > percent * light:
        sig.append(s[: few + 1] & ~np.uint64(1))
    return np.concatenate(sig)


def _described(docs: DataFrame, p: Params, stage: Stage) -> tuple[DataFrame, int]:
    """(doc_id, m, digest, sigs), written: of every row its set's size, digest and signatures; and the boundary."""
    levels, partners = _counted(docs, p, stage)
    light = boundary(partners, p.percent)
    shared = docs.sparkSession.sparkContext.broadcast((levels, light))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shingler(p.words)
        levels, light = shared.value
        for whole in batches:
            for b in slices(whole, "text"):
                sets = [of(t) for t in b.column(1).to_pylist()]
                made = [signatures(s, levels, light, p.percent) for s in sets]
                starts = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in made])]).astype(np.int32))
                sigs = pa.ListArray.from_arrays(starts, pa.array(np.concatenate(made).view(np.int64)))
                digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), sigs], ["doc_id", "m", "digest", "sigs"])

    return stage.write(whole_texts(docs.select("doc_id", "text")).mapInArrow(lean(run), "doc_id long, m long, digest binary, sigs array<long>")), light


def _sized(df: DataFrame, n: int, p: Params) -> DataFrame:
    """Broadcast if counted to be small; else Spark chooses, and shuffles if need be."""
    return F.broadcast(df) if n <= p.broadcast_rows else df


def _verified(docs: DataFrame, pairs: DataFrame, p: Params, stage: Stage) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar, written.

    Sets are made anew from the texts in question, and meet by one shuffle, on b. A text's pairs
    follow one another, so its set is made once.
    """
    texts = docs.select("doc_id", "text")
    mine = texts.join(_sized(pairs.select(F.col("a").alias("doc_id"), "b"), pairs.count(), p), "doc_id").select(F.col("doc_id").alias("a"), "b", "text")
    hubs = stage.write(pairs.select(F.col("b").alias("doc_id")).distinct())
    others = texts.join(_sized(hubs, hubs.count(), p), "doc_id", "left_semi").select(F.col("doc_id").alias("b"), "text")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, last, made = shingler(p.words), None, b""
        for whole in batches:
            for b in slices(whole, "text"):
                sets = []
                for t in b.column(b.num_columns - 1).to_pylist():
                    if t != last:
                        last, made = t, of(t).tobytes()
                    sets.append(made)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sets, pa.binary())], [*b.schema.names[:-1], "els"])

    one = whole_texts(mine).mapInArrow(lean(make), "a long, b long, els binary").withColumnRenamed("els", "x")
    two = whole_texts(others).mapInArrow(lean(make), "b long, els binary").withColumnRenamed("els", "y")
    both = one.join(two, "b").select("a", "b", "x", "y")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                x, y = (x, y) if len(x) <= len(y) else (y, x)
                common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0
                keep.append(common > 0 and 100 * common >= p.percent * (len(x) + len(y) - common))
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return stage.write(both.mapInArrow(lean(compare), "a long, b long"))


def _fits(m: Column, n: Column, percent: int) -> Column:
    return 100 * F.least(m, n) >= percent * F.greatest(m, n)


def _needed(kind: Column, ma: Column, mb: Column, percent: int) -> Column:
    """The signatures that two sets share at least if they are similar.

    Take the set whose first few end earlier in the order: all shared elements up to there are
    among the first few of both, so they are counted, and the rest of the set is all
    that can be shared beyond. k elements make k (k - 1) / 2 subsets.
    """
    ceil = lambda x: F.ceil(x - 1e-9)
    most = F.greatest(ceil(percent * ma / 100), ceil(percent * mb / 100))
    k = ceil(percent * (ma + mb) / (100 + percent)) - most + 1 + kind
    return F.when(kind == 1, F.greatest(k, F.lit(2)) * (F.greatest(k, F.lit(2)) - 1) / 2).otherwise(k)


def _kind(light: int, ma: Column, mb: Column) -> Column:
    """Two light sets meet in subsets only, others in lists only."""
    return F.when(F.greatest(ma, mb) <= light, 1).otherwise(0)


def _hub_pairs(lists: DataFrame, k: int, light: int, p: Params) -> DataFrame:
    """For each set at most one pair (a, b): with the hub that stands in most of its lists, if that is in another component.

    A list's hub is a set of its smallest component, of these the smallest id, after two rounds the one that the round's
    hash puts first; lists are parted by size first, in round k at other borders. Pairs that share too few
    signatures are left to the last round.
    """
    level = F.floor(F.log(F.col("m").cast("double")) / F.log(F.lit(100.0 / p.percent)) + k / 2).cast("int")
    rows = lists.withColumn("level", level)
    first = F.col("doc_id") if k < 2 else F.xxhash64("doc_id", F.lit(k))
    hubs = rows.groupBy("sig", "level").agg(F.min(F.struct("comp", first.alias("_first"), "doc_id", "m")).alias("hub"), F.max("comp").alias("most")).where(F.col("hub.comp") < F.col("most"))
    met = rows.join(hubs.select("sig", "level", "hub"), ["sig", "level"]).where((F.col("hub.comp") != F.col("comp")) & _fits(F.col("m"), F.col("hub.m"), p.percent))
    kind = _kind(light, F.col("m"), F.col("hub.m"))
    votes = met.where(F.col("sig").bitwiseAND(1) == kind).groupBy("doc_id", "m", F.col("hub.doc_id").alias("hub"), F.col("hub.m").alias("n")).agg(F.count(F.lit(1)).alias("shared"))
    votes = votes.where(F.col("shared") >= _needed(_kind(light, F.col("m"), F.col("n")), F.col("m"), F.col("n"), p.percent))
    best = votes.groupBy("doc_id").agg(F.max(F.struct("shared", (-F.col("hub")).alias("hub"))).alias("best"))
    return best.select(F.col("doc_id").alias("a"), (-F.col("best.hub")).alias("b"))


def _left(lists: DataFrame) -> tuple[int, int]:
    """Pairs of a list in different components, over all lists, and the lists' entries."""
    own = lists.groupBy("sig", "comp").agg(F.count(F.lit(1)).cast("double").alias("n"))
    each = own.groupBy("sig").agg(F.sum("n").alias("n"), F.sum(F.col("n") ** 2).alias("same"))
    left, n = each.agg(F.sum((F.col("n") ** 2 - F.col("same")) / 2), F.sum("n")).first()
    return int(left or 0), int(n or 0)


def _hopeful(rows: DataFrame, p: Params) -> DataFrame:
    """The entries (sig, doc_id, m, comp) of lists whose set can be similar to one of the list's others, with rest, the
    entries of its kind that such a set has left from this one on, shortest lists first.

    What a pair needs to share falls as their sizes part, so a list's smallest and largest sets tell the least of it (less
    one, as sizes are rounded); subsets, which only light sets have, all stay. A set whose first elements are its own has few entries, and is of no use to a group it was copied from.
    """
    kind, m = F.col("sig").bitwiseAND(1), F.col("m")
    by_set, by_list = Window.partitionBy("doc_id", kind), Window.partitionBy("sig")
    n = F.count(F.lit(1))
    rows = rows.withColumn("own", n.over(by_set)).withColumns({"_lo": F.min("m").over(by_list), "_hi": F.max("m").over(by_list), "_n": n.over(by_list)})
    low, high = F.greatest("_lo", F.floor(p.percent * m / 100)), F.least("_hi", F.ceil(100 * m / p.percent))
    least = F.least(_needed(F.lit(0), m, low, p.percent), _needed(F.lit(0), m, high, p.percent)) - 1
    rest = F.row_number().over(by_set.orderBy(F.desc("_n"), F.desc("sig")))
    return rows.where((kind == 1) | (F.col("own") >= least)).select("sig", "doc_id", "m", "comp", rest.alias("rest"))


def _met(rows: DataFrame, light: int, p: Params) -> DataFrame:
    """(a, b), maybe repeated: the pairs of ``_hopeful`` entries in different components that may be similar.

    Two sets meet in an entry only if both have as many entries left from there on as they need to share. The first entry that they
    share is one of these if they share enough, as all sets have their entries in one order; the entries of long lists come last and have little left.
    """
    x, y = (rows.select("sig", F.col("doc_id").alias(k), F.col("m").alias(f"m{k}"), F.col("comp").alias(f"c{k}"), F.col("rest").alias(f"r{k}")) for k in "ab")
    kind = _kind(light, F.col("ma"), F.col("mb"))
    met = x.join(y, "sig").where((F.col("ca") < F.col("cb")) & _fits(F.col("ma"), F.col("mb"), p.percent) & (F.col("sig").bitwiseAND(1) == kind) & (F.least("ra", "rb") >= _needed(kind, F.col("ma"), F.col("mb"), p.percent)))
    return met.select("a", "b")


def _apart_pairs(lists: DataFrame, light: int, p: Params) -> DataFrame:
    """All pairs of sets in different components that may be similar, each once."""
    mixed = lists.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("sig")
    rows = lists.join(mixed, "sig", "left_semi").select("sig", "doc_id", "m", "comp").distinct()
    return _met(_hopeful(rows, p), light, p).distinct()


def similar(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs``: the size of its set, and the smallest doc_id
    that it reaches by links, its own included.

    Only doc_id and text are read, so other columns can't clash. Null and empty texts have no
    shingles and reach themselves only; texts of any length count whole. A document is its
    doc_id: rows that repeat one belong together only as far as their texts link them (equal rows do).
    A row without an id links nothing, but is told the component of texts with its set. An
    empty table gives no rows.
    """
    p, stage = params, Stage(docs.sparkSession, "jaccard")
    docs = docs.select("doc_id", "text")
    made, light = _described(docs, p, stage)
    sets = stage.write(made.select("doc_id", "m", "digest"))
    # Digests of several rows; all others are classes of their own and need no join on digests.
    classes = stage.write(sets.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1 AND rep IS NOT NULL").select("digest", "rep"))
    classes = _sized(classes, classes.count(), p)
    copies = sets.where("doc_id IS NOT NULL").join(classes, "digest").where("doc_id <> rep").select("doc_id", "digest").distinct()
    copies = stage.write(copies)
    reps = made.where("doc_id IS NOT NULL AND size(sigs) > 0").join(_sized(copies, copies.count(), p), ["doc_id", "digest"], "left_anti")
    rows = reps.select(F.explode("sigs").alias("sig"), "doc_id", F.col("m").cast("int").alias("m"))
    several = F.count(F.lit(1)).over(Window.partitionBy("sig"))  # one shuffle of all signatures
    lists = stage.write(rows.withColumn("_n", several).where("_n > 1").drop("_n").withColumn("comp", F.col("doc_id")))
    stage.drop(made)
    links = known = None
    left = float("inf")
    for k in range(p.rounds + 1):
        own = lists
        if known is not None:
            own = lists.drop("comp").join(known, lists.doc_id == known.node, "left").withColumn("comp", F.coalesce("component", "doc_id")).drop("node", "component")
        last = k == p.rounds
        if 2 <= k < p.rounds:
            own = stage.write(own)
            (left, entries), were = _left(own), left
            last = left <= entries or left > 0.8 * were
        pairs = stage.write(_apart_pairs(own, light, p) if last else _hub_pairs(own, k, light, p))
        if pairs.isEmpty():
            if last:
                break
            continue
        found = _verified(docs, pairs, p, stage)
        links = found if links is None else links.unionByName(found)
        known = components(links, stage)
        if last:
            break
    named = classes.select("digest", "rep")
    if known is not None:
        known = _sized(known, known.count(), p)
        named = named.join(known, named.rep == known.node, "left").select("digest", F.coalesce("component", "rep").alias("rep"))
        named = stage.write(named)
        named = _sized(named, named.count(), p)
    several = sets.join(named, "digest").select("doc_id", "m", F.col("rep").alias("component"))
    alone = sets.join(named, "digest", "left_anti").select("doc_id", "m")
    alone = alone.withColumn("component", F.col("doc_id")) if known is None else alone.join(known, alone.doc_id == known.node, "left").select("doc_id", "m", "component")
    return several.unionByName(alone).select("doc_id", F.col("m").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def distinct(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """The rows of ``docs``, all columns, with one document of each component: that of the smallest id.

    Of rows that repeat this id the one of the smallest text hash stays; rows without an id
    all stay.
    """
    stage = Stage(docs.sparkSession, "distinct")
    found = stage.write(similar(docs, params))
    stay = stage.write(found.where("doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("_rows")))
    out = docs.where(F.col("doc_id").isNotNull()).join(_sized(stay.select("doc_id"), stay.count(), params), "doc_id", "left_semi")
    if not stay.where("_rows > 1").isEmpty():
        first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text"))
        out = out.withColumn("_tremolo_first", first).where("_tremolo_first = 1").drop("_tremolo_first")
    return out.unionByName(docs.where(F.col("doc_id").isNull()))
