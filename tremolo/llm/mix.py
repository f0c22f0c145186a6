"""Mixing sources to target weights by the cube method of balanced sampling.

Each source gets a target number of words. A document is taken a whole number of times
plus once more with the fractional probability that is left. Which documents are taken
once more is a balanced sample: the probabilities move, three documents at a time, along the
null space of the constraints (documents and words) until one of them is 0 or 1.
Sums are kept at each step, so blocks of a source can move apart from one another; a
dozen documents stay undecided in a block, those of all blocks are moved again, and the last
dozen of a source land on the nearest total. What one long document among them leaves over
is made up by single changes among all decided documents of the source.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremolo.llm.common import word_count
from tremolo.session import Stage

#: Documents to a block, and documents to a landing problem.
BLOCK, LANDING = 4096, 12
#: Ids travel as strings: pandas would turn integers beside nulls into doubles.
UNITS = "doc_id string, source string, source_no long, block long, size long, base int, pi double, p double, total double"


def targets(sizes: list[int], weights: list[float], cap: float) -> list[float]:
    """Shares of all words by weight; what exceeds ``cap`` times a source's size is reshared by weight until none does."""
    left, open_ = float(sum(sizes)), [k for k, w in enumerate(weights) if w > 0]
    out = [0.0] * len(sizes)
    while open_:
        weight = sum(weights[k] for k in open_)
        over = [k for k in open_ if left * weights[k] / weight > cap * sizes[k]]
        if not over:
            for k in open_:
                out[k] = left * weights[k] / weight
            break
        for k in over:
            out[k] = float(cap * sizes[k])
        left -= sum(out[k] for k in over)
        open_ = [k for k in open_ if k not in set(over)]
    return out


def flight(p: np.ndarray, size: np.ndarray, seed: int, left: int = LANDING) -> np.ndarray:
    """Moves probabilities in the null space of (1, size) until ``left`` units at most (2 at least) are undecided."""
    eps = 1e-9
    draw = iter(np.random.default_rng(seed).random(2 * len(p) + 8).tolist())
    p, size = p.tolist(), size.tolist()
    waiting = iter([k for k in range(len(p)) if eps < p[k] < 1 - eps])
    held: list[int] = []
    undecided = sum(eps < x < 1 - eps for x in p)
    while undecided > left:
        while len(held) < 3 and (k := next(waiting, None)) is not None:
            held.append(k)
        if len(held) == 3:
            a, b, c = (size[k] for k in held)
            u = [c - b, a - c, b - a] if a != b or b != c else [1, -1, 0]
        elif len(held) == 2 and size[held[0]] == size[held[1]]:
            u = [1, -1]
        else:
            break
        up = min(((1 - p[k]) if x > 0 else p[k]) / abs(x) for k, x in zip(held, u) if x)
        down = min((p[k] if x > 0 else (1 - p[k])) / abs(x) for k, x in zip(held, u) if x)
        step = up if next(draw) * (up + down) < down else -down
        for k, x in zip(held, u):
            p[k] += step * x
            if p[k] < eps:
                p[k] = 0.0
            elif p[k] > 1 - eps:
                p[k] = 1.0
        undecided -= len(held)
        held = [k for k in held if 0 < p[k] < 1]
        undecided += len(held)
    return np.array(p)


def land(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Rounds the few units that are left so that words, then documents, come nearest to their sums.

    Where one long document outweighs the others that were left, single changes of those
    already decided follow, each the one that brings the words nearest, as many as a landing
    problem has documents at most. They move the inclusion probabilities of no more documents than that.
    """
    open_ = np.flatnonzero((p > 0) & (p < 1))
    if not len(open_):
        return p
    choices = np.array(list(product((0.0, 1.0), repeat=len(open_))))
    words = np.round(np.abs(choices @ size[open_] - size[open_] @ p[open_]), 6)
    number = np.abs(choices.sum(1) - p[open_].sum())
    p = p.copy()
    aim = float(size @ p)
    p[open_] = choices[np.lexsort((number, words))[0]]
    for _ in range(LANDING):
        off = float(size @ p) - aim
        after = np.abs(off + np.where(p == 1, -size, size))
        k = int(after.argmin())
        if after[k] >= abs(off) - 1e-6:
            break
        p[k] = 1 - p[k]
    return p


def changes(off: float, size: list[int], taken: list[bool], rows: list[int]) -> list[int]:
    """By (size, taken), how many of its ``rows`` change sides so that ``off`` words too many come near 0.

    One by one the row whose change brings the words nearest, as ``land`` does among the rows it sees.
    """
    count, sizes = {True: {}, False: {}}, {}
    for s, t, n in zip(size, taken, rows):
        if s > 0:
            count[t][s] = count[t].get(s, 0) + n
    before = {t: dict(c) for t, c in count.items()}
    sizes = {t: sorted(c) for t, c in count.items()}
    while True:
        side = off > 0
        while sizes[side] and not count[side][sizes[side][-1]]:
            sizes[side].pop()
        k = bisect_right(sizes[side], abs(off))
        low = next((s for s in reversed(sizes[side][:k]) if count[side][s]), None)
        high = next((s for s in sizes[side][k:] if count[side][s]), None)
        near = [s for s in (low, high) if s is not None]
        s = min(near, key=lambda s: abs(abs(off) - s), default=None)
        if s is None or abs(abs(off) - s) >= abs(off) - 1e-3:
            break
        n = min(count[side][s], max(1, int(abs(off) // s)))
        count[side][s] -= n
        if s in count[not side]:
            count[not side][s] += n
        off += -n * s if side else n * s
    return [max(0, before[t][s] - count[t][s]) if s > 0 else 0 for s, t in zip(size, taken)]


def _move(last: bool, seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # Large documents first: those that stay undecided are small.
        pdf = pdf.assign(_h=[zlib.crc32(f"{seed}:{d}:{s}".encode()) for d, s in zip(pdf.doc_id, pdf["size"])])
        pdf = pdf.sort_values(["size", "_h", "doc_id"], ascending=[False, True, True], kind="stable").drop(columns="_h").reset_index(drop=True)
        p = flight(pdf.p.to_numpy(float), pdf["size"].to_numpy(float), seed * 1_000_003 + int(pdf.source_no[0]) * 10_007 + int(pdf.block[0]))
        pdf["p"] = land(p, pdf["size"].to_numpy(float)) if last else p
        return pdf

    return run


def _changes_of_source(pdf: pd.DataFrame) -> pd.DataFrame:
    n = changes(float(pdf.off[0]), pdf["size"].tolist(), (pdf.p == 1).tolist(), pdf["rows"].tolist())
    return pdf[["source_no", "size", "p"]].assign(change=n).query("change > 0")


def made_up(whole: DataFrame, plan: DataFrame, seed: int, stage: Stage) -> DataFrame:
    """``whole`` with the words that a source's landing missed made up among all its decided rows.

    Only counts by size reach one task for each such source. Which rows of a size change goes by
    hash, numbered within the hash blocks of the plan.
    """
    words = whole.groupBy("source_no").agg(F.sum(F.col("p") * F.col("size")).alias("words"))
    off = words.join(plan, "source_no").select("source_no", "blocks", (F.col("words") - F.col("pi") * F.col("source_size")).alias("off"))
    off = off.where(F.abs("off") > 0.5).collect()
    if not off:
        return whole
    short = F.broadcast(whole.sparkSession.createDataFrame(off, "source_no long, blocks long, off double"))
    near = whole.join(short, "source_no").where((F.col("size") > 0) & (F.col("size") < 2 * F.abs("off")))
    counts = near.groupBy("source_no", "off", "size", "p").agg(F.count(F.lit(1)).alias("rows"))
    found = stage.write(counts.groupBy("source_no").applyInPandas(_changes_of_source, "source_no long, size long, p double, change long"))
    if found.isEmpty():
        return whole
    key = ["source_no", "size", "p"]
    sized = whole.join(short.drop("off"), "source_no").join(found, key)
    sized = sized.withColumn("_block", F.pmod(F.xxhash64("doc_id", "size", F.lit(seed)), "blocks"))
    blocks = sized.groupBy(*key, "_block", "change").agg(F.count(F.lit(1)).alias("_rows"))
    past = F.sum("_rows").over(Window.partitionBy(*key).orderBy("_block")) - F.col("_rows")
    share = blocks.select(*key, "_block", (F.col("change") - past).alias("_share"))
    turn = F.row_number().over(Window.partitionBy(*key, "_block").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id"))
    turned = sized.withColumn("_turn", turn).join(share, [*key, "_block"])
    turned = turned.withColumn("p", F.when(F.col("_turn") <= F.col("_share"), 1 - F.col("p")).otherwise(F.col("p")))
    return whole.join(found, key, "left_anti").select(*whole.columns).unionByName(turned.select(*whole.columns))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), cap: int = 3, seed: int = 7, block: int = BLOCK) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken): how often the mix takes each row of ``docs``.

    ``docs`` has doc_id, text and source; other columns are ignored. Sources in the order of
    their code points, null last, weigh ``weights`` over and over; they share all words by
    weight, at most ``cap`` times their own. A row's size is its words; ``taken`` is size times copies.
    Null texts have size 0; null ids are rows like others; repeated rows are rows of their
    own (rows alike in id, source and size may be told apart by nothing but their copies); an empty
    table gives none. One total for each source reaches the driver.
    Reruns agree: blocks, order and draws come from hashes.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "mix")
    sized = stage.write(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    totals = sized.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows")).orderBy(F.asc_nulls_last("source")).collect()
    aims = targets([t.words for t in totals], [weights[k % len(weights)] for k in range(len(totals))], cap)
    plan = []
    for k, (t, aim) in enumerate(zip(totals, aims)):
        ratio = aim / t.words if t.words else 0.0
        base = int(ratio + 1e-12)
        plan.append((k, t.source, t.words, aim, base, max(0.0, min(1.0, ratio - base)) if ratio - base > 1e-12 else 0.0, -(-t.rows // block)))
    plan_df = spark.createDataFrame(plan, "source_no long, s string, source_size long, target double, base int, pi double, blocks long")
    own = sized.join(plan_df, sized.source.eqNullSafe(plan_df.s))
    units = own.select(
        F.col("doc_id").cast("string").alias("doc_id"), "source", "source_no", F.pmod(F.xxhash64("doc_id", "size", F.lit(seed)), "blocks").alias("block"), "size", "base", "pi", F.col("pi").alias("p"), F.col("target").alias("total"),
    )
    most = max((x[-1] for x in plan), default=1)
    fan = max(2, block // LANDING)  # blocks whose undecided documents move on together
    done = []
    while True:
        moved = stage.write(units.groupBy("source_no", "block").applyInPandas(_move(most <= 1, seed), UNITS))
        open_ = (F.col("p") > 0) & (F.col("p") < 1)
        if most <= 1:
            done.append(moved)
            break
        done.append(moved.where(~open_))
        units = moved.where(open_).withColumn("block", F.floor(F.col("block") / fan).cast("long"))
        most = -(-most // fan)
    whole = done[0]
    for part in done[1:]:
        whole = whole.unionByName(part)
    whole = made_up(whole, plan_df, seed, stage)
    copies = (F.col("base") + F.col("p").cast("int")).alias("copies")
    sizes = plan_df.select(F.col("source_no").alias("_k"), "source_size")
    doc_id = F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id")
    return whole.join(sizes, whole.source_no == sizes["_k"]).select(doc_id, "source", "size", "source_size", F.col("total").alias("target"), copies, (F.col("size") * copies).alias("taken"))


def mixed(docs: DataFrame, broadcast_rows: int = 300_000, **params) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mix takes it."""
    taken = Stage(docs.sparkSession, "mixed").write(mix(docs, **params).select(F.col("doc_id").alias("_tremolo_d"), F.col("source").alias("_tremolo_s"), F.col("size").alias("_tremolo_n"), F.col("copies").alias("_tremolo_c")))
    several = taken.groupBy("_tremolo_d", "_tremolo_s", "_tremolo_n").agg(F.count(F.lit(1)).alias("k")).where("k > 1").limit(1).count() > 0
    rows = docs.withColumn("_tremolo_size", word_count(F.col("text")))
    match = rows.doc_id.eqNullSafe(F.col("_tremolo_d")) & rows.source.eqNullSafe(F.col("_tremolo_s")) & (rows["_tremolo_size"] == F.col("_tremolo_n"))
    if several:
        rows = rows.withColumn("_tremolo_row", F.row_number().over(Window.partitionBy("doc_id", "source", "_tremolo_size").orderBy(F.xxhash64("text"))))
        taken = taken.withColumn("_tremolo_r", F.row_number().over(Window.partitionBy("_tremolo_d", "_tremolo_s", "_tremolo_n").orderBy("_tremolo_c")))
        match = rows.doc_id.eqNullSafe(F.col("_tremolo_d")) & rows.source.eqNullSafe(F.col("_tremolo_s")) & (rows["_tremolo_size"] == F.col("_tremolo_n")) & (rows["_tremolo_row"] == F.col("_tremolo_r"))
    elif taken.count() <= broadcast_rows:
        taken = F.broadcast(taken)
    repeated = rows.join(taken.where("_tremolo_c > 0"), match).withColumn("_tremolo_copy", F.explode(F.array_repeat(F.lit(1), F.col("_tremolo_c"))))
    return repeated.select(*[F.col(f"`{c}`") for c in docs.columns])

