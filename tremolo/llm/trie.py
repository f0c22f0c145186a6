"""The trie of all conversations' beginnings, built by families first.

A conversation's family is that of its base id (the id less its remainder by ``FAMILY``). Turns meet
their family once, as digests; there conversations are rebuilt, with the base's first turns before
their own, and walked together, depth by depth, so that turns that members share become one node.
Only these combined nodes are shuffled again, by key, for the trie of all families. Sums over
subtrees go the same way back: a node's owner family takes its value, walks its own small trie
from the deepest nodes up, and its sums are added to those of the other families.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremolo.llm.common import lean, word_count
from tremolo.session import Stage

FAMILY = 20
#: Turns at most that a conversation takes from its base are one less than this.
TAKEN = 4
#: The key of the textless root, and the bytes of every other key.
ROOT, WIDTH = b"", 16
#: Characters of a text that order turns of the same number and role, before their digests.
HEAD = 40
#: Conversations that end at a node are listed in blocks of as many consecutive ids.
BLOCK = 4096
#: Parents with more children are joined by broadcast, as one task would get all of their children.
MANY = 10_000
#: Rows of nodes that go back to Spark at once.
ROWS = 20_000

_NODES = "base long, depth long, key binary, parent binary, words long, conv_id long, n_convs long, ends array<long>"
_SUMS = "key binary, n_leaves long, saved long"


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])


def taken(conv_id: Column) -> Column:
    """How many turns of its base a conversation begins with."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % TAKEN).cast("int")


def turns(conversations: DataFrame) -> DataFrame:
    """(base, conv_id, pos, digest, words): turns as digests, numbered from 1, with what its family needs beside each.

    One shuffle, by base id; windows within conversations and families keep to it and spill.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    unique = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)  # where the role ends is told, so no two turns look alike
    digest = F.unhex(F.substring(F.sha2(unique, 256), 1, 2 * WIDTH))
    own = conversations.where(F.col("conv_id").isNotNull()).select(
        (F.col("conv_id") - F.col("conv_id") % FAMILY).cast("long").alias("base"), F.col("conv_id").cast("long").alias("conv_id"),
        "turn", role.alias("role"), F.substring(text, 1, HEAD).alias("head"), digest.alias("digest"), word_count(F.col("text")).alias("words"),
    )
    family = Window.partitionBy("base")
    number = F.row_number().over(Window.partitionBy("base", "conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "head", "digest")).cast("long")
    numbered = own.repartition("base").withColumn("pos", number).select("base", "conv_id", "pos", "digest", "words")
    of_base = F.count(F.when(F.col("conv_id") == F.col("base"), 1)).over(family)
    return numbered.withColumn("base_turns", of_base).withColumn("convs", F.collect_set("conv_id").over(family))


def rebuilt(turns: DataFrame) -> DataFrame:
    """(base, depth, conv_id, digest, words): every conversation's rebuilt turns, and depth 0 once for each."""
    pos, h = F.col("pos"), taken(F.col("conv_id"))
    row = lambda conv, depth, digest, words: F.struct(depth.cast("long").alias("depth"), conv.alias("conv_id"), digest.alias("digest"), words.alias("words"))
    root = F.when(pos == 1, F.array(row(F.col("conv_id"), F.lit(0), F.lit(ROOT), F.lit(0).cast("long"))))
    own = F.when(pos > h, F.array(row(F.col("conv_id"), F.least(h, F.col("base_turns")) + pos - h, F.col("digest"), F.col("words"))))
    heirs = F.filter("convs", lambda c: taken(c) >= pos)
    shared = F.when((F.col("conv_id") == F.col("base")) & (pos < TAKEN), F.transform(heirs, lambda c: row(c, pos, F.col("digest"), F.col("words"))))
    none = F.array().cast("array<struct<depth:bigint,conv_id:bigint,digest:binary,words:bigint>>")
    return turns.select("base", F.explode(F.concat(*(F.coalesce(x, none) for x in (root, own, shared)))).alias("r")).select("base", "r.*")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) == ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def _walk(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Family nodes from rows (base, depth, conv_id, digest, words) in order of base, depth and id.

    Held are the nodes of one depth: as many as the family has conversations, whatever their length.
    """
    at = (None, None)
    level: dict[bytes, list] = {}  # of the depth before: key -> [base, depth, key, parent, words, members]
    here: dict[bytes, list] = {}
    path: dict[int, bytes] = {}  # by conversation: its node at the depth before

    def finish(nodes: dict[bytes, list], going_on: set[int]) -> Iterator[tuple]:
        for base, depth, key, parent, words, members in nodes.values():
            yield base, depth, key, parent, words, min(members), len(members), [c for c in members if c not in going_on]

    for base, depth, conv, digest, words in rows:
        if (base, depth) != at:
            same = base == at[0]
            yield from finish(level, {c for n in here.values() for c in n[5]})
            if not same:
                yield from finish(here, set())
            path = {c: k for k, n in here.items() for c in n[5]} if same else {}
            level, here, at = (here if same else {}), {}, (base, depth)
        parent = path.get(conv)
        key = ROOT if depth == 0 else hashlib.sha256(parent + digest).digest()[:WIDTH]
        here.setdefault(key, [base, depth, key, parent, words, []])[5].append(conv)
    yield from finish(level, {c for n in here.values() for c in n[5]})
    yield from finish(here, set())


def family_nodes(conversations: DataFrame) -> DataFrame:
    """The nodes of every family's trie: key, depth, parent's key, words of the last text, smallest member, members, and who ends there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(_walk(_rows(batches)), _schema(_NODES))

    rows = rebuilt(turns(conversations)).sortWithinPartitions("base", "depth", "conv_id")
    return rows.select("base", "depth", "conv_id", "digest", "words").mapInArrow(lean(run), _NODES)


def _climb(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(key, leaves, saved): sums over subtrees within families, from rows (base, depth, key, parent, leaves, saved), deepest first.

    Several rows may stand for one node; held are the nodes of one depth and their parents.
    """
    at = (None, None)
    here: dict[bytes, list] = {}
    above: dict[bytes, list] = {}

    def finish() -> Iterator[tuple]:
        for key, (parent, leaves, saved) in here.items():
            if leaves or saved:
                yield key, leaves, saved
                if parent is not None:
                    up = above.setdefault(parent, [0, 0])
                    up[0] += leaves
                    up[1] += saved

    for base, depth, key, parent, leaves, saved in rows:
        if (base, depth) != at:
            yield from finish()
            below = above if base == at[0] else {}
            here, above, at = {}, {}, (base, depth)
        if key not in here:
            here[key] = [parent, *below.pop(key, (0, 0))]
        here[key][1] += leaves
        here[key][2] += saved
    yield from finish()


def ends_digests(nodes: DataFrame) -> DataFrame:
    """(key, ends_sha256): the digest of the ids that end at a node, ascending, joined by commas.

    Ids are joined in blocks first; a node's blocks pass one task in order, as a stream.
    """
    ended = nodes.where(F.size("ends") > 0).select("key", F.explode("ends").alias("conv_id"))
    block = F.floor(F.col("conv_id") / BLOCK).cast("long")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    listed = ended.groupBy("key", block.alias("block")).agg(ids.alias("ids")).repartition("key").sortWithinPartitions("key", "block")

    def digests(rows: Iterator[tuple]) -> Iterator[tuple]:
        now = made = None
        for key, _, ids in rows:
            if made is None or key != now:
                if made:
                    yield now, made.hexdigest()
                now, made = key, hashlib.sha256()
            else:
                made.update(b",")
            made.update(ids.encode())
        if made:
            yield now, made.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(digests(_rows(batches)), pa.schema([("key", pa.binary()), ("ends_sha256", pa.string())]))

    return listed.mapInArrow(lean(run), "key binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row for each distinct beginning of a rebuilt conversation of (conv_id, turn, role, text).

    conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children,
    n_leaves (childless nodes of its subtree), saved_tokens (over its subtree, words of each node's last text
    for every member but one), ends_sha256 (of the members that end there) and key, 16 bytes that name the beginning.

    Turns go by number, null first; those of the same number by role, by their texts' first 40 characters,
    then by digest. Null and empty roles and texts count as empty; rows without a conv_id belong to no
    conversation and take no part; repeated rows are turns of their own; texts of any length are digested
    whole; an empty table gives no nodes; only the four columns are read, so others can't clash. Negative
    ids have the base that Spark's remainder gives: the family of 0 then has up to 39 members.
    """
    stage = Stage(conversations.sparkSession, "trie")
    nodes = stage.write(family_nodes(conversations.select("conv_id", "turn", "role", "text")))
    # A key names its whole beginning, so depth, parent and words are the same in all families.
    merged = stage.write(
        nodes.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.min("words").alias("words"), F.sum("n_convs").alias("n_convs"))
    )
    children = merged.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    merged = stage.write(merged.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))
    owned = merged.select(
        (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"), "depth", "key", "parent",
        (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"),
    )
    zero = F.lit(0).cast("long")
    families = nodes.select("base", "depth", "key", "parent", zero.alias("leaves"), zero.alias("saved")).unionByName(owned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(_climb(_rows(batches)), _schema(_SUMS))

    climbed = families.repartition("base").sortWithinPartitions("base", F.col("depth").desc(), "key").mapInArrow(lean(run), _SUMS)
    sums = climbed.groupBy("key").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    out = merged.join(sums, "key", "left").join(ends_digests(nodes), "key", "left")
    return _with_parents(out, merged).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("n_leaves", zero).alias("n_leaves"), F.coalesce("saved_tokens", zero).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"), "key",
    )


def _with_parents(out: DataFrame, merged: DataFrame) -> DataFrame:
    """Adds parent_conv_id. Children of parents with more than MANY of them don't meet in one task: such parents are fewer
    than one of MANY nodes and are broadcast, if counted to be at most 300,000; beyond that Spark chooses the join."""
    parents = merged.where(F.col("n_children") > 0).select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    crowded = parents.where(F.col("n_children") > MANY).drop("n_children")
    crowded = F.broadcast(crowded) if crowded.count() <= 300_000 else crowded
    usual = parents.where(F.col("n_children") <= MANY).drop("n_children")
    few = out.join(crowded.select("parent"), "parent", "left_anti").join(usual, "parent", "left")
    return few.unionByName(out.join(crowded, "parent"))
