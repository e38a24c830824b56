"""Prefix trie of conversations, its subtrees summed along an Euler tour.

A node is a distinct sequence of first turns. It is known by the digests of
its turns: each turn of a sequence gives 128 bits from its place and digest,
and a prefix is the exclusive or of those of its turns, so a node knows its
parent without a look at the turn before. Nodes whose members don't end with
one and the same turn are refused, so no chance meeting goes unseen. The
smallest member and the depth name a node too.

The tour enters and leaves every node once. Each of these arcs names the next
one: the first child or the way out, the next sibling or the parent's way out.
The list of arcs is ranked by contraction: arcs are dealt by their node, a task
joins those that follow each other into segments, and the segments, as a list
of the same form, are dealt again until one is left. Nodes that begin in one
conversation are neighbours, so few segments are left each time; where a list
does not shrink so, segments chosen by coin absorb their successors. Prefix
sums over the positions give what lies between a node's two arcs, its subtree.

No task gathers a conversation, a node's members or its children: places and
siblings come from a global sort, whose parts are linked by one row for each;
long conversations are summed up in chunks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirmark.llm.common import Scratch, materialise

#: Turns of a conversation whose prefixes are formed in one group.
CHUNK = 4096
#: Arcs or segments that a task joins.
TASK = 1 << 15
#: Positions that are summed up in one group.
SPAN = 1 << 16
#: Ids that are written out together for a node's digest.
IDS = 4096

LEVEL = "conv long, slot long, head_conv long, head_slot long, ahead long, next_conv long, next_slot long, total long"
NODE = ["depth", "k1", "k2"]


# --- turns ---------------------------------------------------------------


def _turns(keep: Scratch, talks: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, pos, digest, n_bytes) of every turn: its place from 0 on, the digest of role and text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = talks.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text")).where("conv is not null")
    # Dealt by the start of long texts, so that the bounds stay small; sorted by the whole of them.
    dealt = rows.repartitionByRange("conv", F.col("turn").asc_nulls_first(), F.substring("role", 1, 32), F.substring("text", 1, 64)).sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "text")
    digest = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    rows = keep(dealt.select("conv", digest.alias("digest"), F.octet_length("text").cast("long").alias("n_bytes"), F.monotonically_increasing_id().alias("seq"), F.spark_partition_id().alias("part")), "turns")
    here = F.row_number().over(Window.partitionBy("conv", "part").orderBy("seq")) - 1
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # Conversations that go on from an earlier part: one row for each part at most.
    later = rows.groupBy("conv", "part").agg(F.count("*").alias("n")).withColumn("before", before).where("before is not null").select("conv", "part", "before")
    return rows.withColumn("here", here).join(later, ["conv", "part"], "left").select("conv", (F.col("here") + F.coalesce("before", F.lit(0))).cast("long").alias("pos"), "digest", "n_bytes")


def _rebuilt(keep: Scratch, turns: DataFrame, group: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(conv, length) of every rebuilt conversation, and its turns (conv, depth, length, digest, n_bytes), depths from 1 on."""
    convs = turns.groupBy("conv").agg(F.count("*").alias("n")).withColumns({"h": F.crc32(F.col("conv").cast("string").cast("binary")) % most, "base": F.col("conv") - F.col("conv") % group})
    sizes = convs.select(F.col("conv").alias("base"), F.col("n").alias("n_base"))
    convs = convs.join(sizes, "base", "left").withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0))))
    convs = keep(convs.select("conv", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "convs")
    own = turns.join(convs.select("conv", "h", "taken", "length"), "conv").where("pos >= h").select("conv", (F.col("pos") - F.col("h") + F.col("taken") + 1).alias("depth"), "length", "digest", "n_bytes")
    heads = turns.where(F.col("pos") < most).withColumnRenamed("conv", "base")
    lent = heads.join(convs.select("conv", "base", "h", "length"), "base").where("pos < h").select("conv", (F.col("pos") + 1).alias("depth"), "length", "digest", "n_bytes")
    return convs.select("conv", "length"), own.union(lent)


def _prefixes(keep: Scratch, rows: DataFrame) -> DataFrame:
    """``rows`` with the keys of the prefix that ends with a turn (k1, k2) and of the one before (p1, p2)."""
    marks = {"x1": F.xxhash64("depth", "digest"), "x2": F.xxhash64(F.lit("second"), "digest", "depth"), "chunk": F.floor((F.col("depth") - 1) / CHUNK)}
    rows = keep(rows.withColumns(marks), "rebuilt")
    # All chunks before one, of conversations that have several.
    before = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.where(F.col("length") > CHUNK).groupBy("conv", "chunk").agg(F.bit_xor("x1").alias("s1"), F.bit_xor("x2").alias("s2"))
    sums = sums.select("conv", "chunk", F.bit_xor("s1").over(before).alias("b1"), F.bit_xor("s2").over(before).alias("b2")).where("chunk > 0")
    within = Window.partitionBy("conv", "chunk").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"r1": F.bit_xor("x1").over(within), "r2": F.bit_xor("x2").over(within)}).join(sums, ["conv", "chunk"], "left")
    for i in ("1", "2"):
        rows = rows.withColumn(f"k{i}", F.col(f"r{i}").bitwiseXOR(F.coalesce(f"b{i}", F.lit(0)))).withColumn(f"p{i}", F.col(f"k{i}").bitwiseXOR(F.col(f"x{i}")))
    return rows.select("conv", "depth", "length", "digest", "n_bytes", "k1", "k2", "p1", "p2")


# --- digests of the members that end at a node -----------------------------


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (depth, k1, k2, conv) as lists of at most IDS ids, written out: (depth, k1, k2, first, ids)."""
    names = ["depth", "k1", "k2", "first", "ids"]
    for batch in batches:
        columns = [batch.column(c).to_numpy() for c in (*NODE, "conv")]
        if not len(columns[0]):
            continue
        new = np.concatenate(([True], np.any([c[1:] != c[:-1] for c in columns[:3]], axis=0)))
        at = np.flatnonzero(new)
        at = np.concatenate([np.arange(a, b, IDS) for a, b in zip(at, np.append(at[1:], len(new)), strict=True)])
        ids = [",".join(map(str, columns[3][a:b].tolist())) for a, b in zip(at, np.append(at[1:], len(new)), strict=True)]
        yield pa.RecordBatch.from_arrays([*(pa.array(c[at]) for c in columns), pa.array(ids, pa.string())], names=names)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each node's lists, which come one after the other."""

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in rows], pa.int64()) for k in range(3)), pa.array([r[3] for r in rows], pa.string())], names=[*NODE, "ends_sha256"])

    key, now = None, None
    for batch in batches:
        out = []
        for *own, ids in zip(*(batch.column(c).to_pylist() for c in NODE), batch.column("ids").to_pylist(), strict=True):
            if own == key:
                now.update(b",")
            else:
                if key is not None:
                    out.append((*key, now.hexdigest()))
                key, now = own, hashlib.sha256()
            now.update(ids.encode())
        yield made(out)
    if key is not None:
        yield made([(*key, now.hexdigest())])


def _ends(convs: DataFrame, rows: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256) of the nodes at which conversations end."""
    zero = F.lit(0).cast("long")
    last = rows.where("depth = length").select(*NODE, "conv").union(convs.where("length = 0").select(zero, zero, zero, "conv"))
    lists = last.repartitionByRange(*NODE, "conv").sortWithinPartitions(*NODE, "conv").mapInArrow(_listed, "depth long, k1 long, k2 long, first long, ids string")
    return lists.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(_digests, "depth long, k1 long, k2 long, ends_sha256 string")


# --- tour ------------------------------------------------------------------


def _arcs(keep: Scratch, nodes: DataFrame) -> DataFrame:
    """(conv, slot, next_conv, next_slot, weight, leaf, saved) of all arcs; slot is twice the depth, plus one on the way out; the last arc's next slot is -1.

    ``nodes`` has conv_id, depth, parent_conv_id, saved. Children follow each other by conv_id.
    """
    rows = keep(nodes.repartitionByRange("depth", "parent_conv_id", "conv_id").withColumn("part", F.spark_partition_id()), "siblings")
    near = F.lead("conv_id").over(Window.partitionBy("part", "depth", "parent_conv_id").orderBy("conv_id"))
    # Siblings that go on in a later part: one row for each part at most.
    over = F.lead("least").over(Window.partitionBy("depth", "parent_conv_id").orderBy("part"))
    far = rows.groupBy("depth", "parent_conv_id", "part").agg(F.min("conv_id").alias("least")).withColumn("over", over).where("over is not null").drop("least")
    rows = rows.withColumn("near", near).join(far, ["depth", "parent_conv_id", "part"], "left").withColumn("sibling", F.coalesce("near", "over"))
    first = nodes.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.min("conv_id").alias("child"))
    rows = rows.join(first, ["conv_id", "depth"], "left")
    leaf, inner, slot = F.col("child").isNull(), F.col("child").isNotNull(), F.col("depth") * 2
    enter = [slot.alias("slot"), F.coalesce("child", "conv_id").alias("next_conv"), F.when(inner, slot + 2).otherwise(slot + 1).alias("next_slot"), leaf.cast("long").alias("leaf"), F.col("saved")]
    out = F.when(F.col("sibling").isNotNull(), slot).otherwise(slot - 1)
    leave = [(slot + 1).alias("slot"), F.coalesce("sibling", "parent_conv_id", F.lit(0)).cast("long").alias("next_conv"), out.alias("next_slot"), F.lit(0).cast("long").alias("leaf"), F.lit(0).cast("long").alias("saved")]
    both = F.explode(F.array(F.struct(*enter), F.struct(*leave)))
    return rows.select(F.col("conv_id").alias("conv"), both.alias("a")).select("conv", "a.*", F.lit(1).cast("long").alias("weight"))


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's part of a list, joined: each element with the head of its segment and what lies between; heads with what follows the segment."""
    parts = list(batches)  # as many as a task is dealt
    conv, slot, next_conv, next_slot, weight = (np.concatenate([b.column(c).to_numpy() for b in parts]) if parts else np.zeros(0, np.int64) for c in ("conv", "slot", "next_conv", "next_slot", "weight"))
    n = len(conv)
    if not n:
        return
    names, of = np.unique(conv, return_inverse=True)
    far = int(slot.max()) + 1
    key = of * far + slot
    order = np.argsort(key)
    other = np.minimum(np.searchsorted(names, next_conv), len(names) - 1)
    want = other * far + next_slot
    at = order[np.minimum(np.searchsorted(key, want, sorter=order), n - 1)]
    here = (names[other] == next_conv) & (next_slot >= 0) & (next_slot < far) & (key[at] == want)
    head, ahead = np.arange(n), np.zeros(n, np.int64)
    head[at[here]] = np.flatnonzero(here)
    ahead[at[here]] = weight[here]
    while (head[head] != head).any():
        ahead, head = ahead + ahead[head], head[head]
    ends = np.flatnonzero(~here)
    follow, total, first = np.zeros(n, np.int64), np.zeros(n, np.int64), np.ones(n, bool)
    follow[head[ends]], total[head[ends]], first[head[ends]] = ends, ahead[ends] + weight[ends], False
    columns = [pa.array(x) for x in (conv, slot, conv[head], slot[head], ahead)] + [pa.array(x, mask=first) for x in (next_conv[follow], next_slot[follow], total)]
    yield pa.RecordBatch.from_arrays(columns, names=[x.split(" ")[0] for x in LEVEL.split(", ")])


def _absorbed(keep: Scratch, now: DataFrame, number: int) -> DataFrame:
    """A level in which segments that drew 1 absorb their successor if that drew 0, about a quarter of all."""

    def coin(conv: str, slot: str) -> Column:
        return F.xxhash64(conv, slot, F.lit(number)).bitwiseAND(F.lit(1))

    later = now.where(coin("conv", "slot") == 0).select(F.col("conv").alias("c"), F.col("slot").alias("s"), F.col("next_conv").alias("nc"), F.col("next_slot").alias("ns"), F.col("weight").alias("w"))
    pairs = keep(now.where(coin("conv", "slot") == 1).join(later, (F.col("next_conv") == F.col("c")) & (F.col("next_slot") == F.col("s"))), "pairs")
    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    gone = pairs.select(F.col("c").alias("conv"), F.col("s").alias("slot"), F.col("conv").alias("head_conv"), F.col("slot").alias("head_slot"), F.col("weight").alias("ahead"), none, none, none)
    grown = pairs.select("conv", "slot", "conv", "slot", zero, "nc", "ns", F.col("weight") + F.col("w"))
    both = pairs.select(F.col("c").alias("conv"), F.col("s").alias("slot")).union(pairs.select("conv", "slot"))
    left = now.join(both, ["conv", "slot"], "left_anti").select("conv", "slot", "conv", "slot", zero, "next_conv", "next_slot", "weight")
    return keep(gone.union(grown).union(left).toDF(*[x.split(" ")[0] for x in LEVEL.split(", ")]), "level")


def list_positions(keep: Scratch, elements: DataFrame, task: int = TASK) -> DataFrame:
    """(conv, slot, pos): the sum of the weights before each element of one list (conv, slot, next_conv, next_slot, weight)."""
    levels: list[DataFrame] = []
    now, n = elements.select("conv", "slot", "next_conv", "next_slot", "weight"), elements.count()
    absorb = False
    while n > 1 or not levels:
        parts = -(-n // task)
        if absorb:
            levels.append(_absorbed(keep, now, len(levels)))
        else:
            dealt = now.coalesce(1) if parts <= 1 else now.repartitionByRange(parts, "conv", "slot")
            levels.append(keep(dealt.mapInArrow(_contract, LEVEL), "level"))
        now = levels[-1].where("total is not null").select("conv", "slot", "next_conv", "next_slot", F.col("total").alias("weight"))
        before, n = n, now.count()
        absorb = not absorb and parts > 1 and n > before // 2
    found = levels.pop().select("conv", "slot", F.col("ahead").alias("pos"))
    for level in reversed(levels):
        heads = found.select(F.col("conv").alias("head_conv"), F.col("slot").alias("head_slot"), "pos")
        found = level.join(heads, ["head_conv", "head_slot"]).select("conv", "slot", (F.col("pos") + F.col("ahead")).alias("pos"))
    return found


def _subtrees(keep: Scratch, nodes: DataFrame, task: int) -> DataFrame:
    """(conv_id, depth, n_leaves, saved_tokens) from the prefix sums at each node's two arcs."""
    arcs = keep(_arcs(keep, nodes), "arcs")
    placed = list_positions(keep, arcs, task).join(arcs.select("conv", "slot", "leaf", "saved"), ["conv", "slot"]).withColumn("span", F.floor(F.col("pos") / SPAN))
    placed = keep(placed, "placed")
    before = Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)  # a row for SPAN arcs
    sums = placed.groupBy("span").agg(F.sum("leaf").alias("l"), F.sum("saved").alias("s"))
    sums = sums.select("span", F.coalesce(F.sum("l").over(before), F.lit(0)).alias("l"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("s"))
    within = Window.partitionBy("span").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumns({"leaves": F.sum("leaf").over(within), "tokens": F.sum("saved").over(within)}).join(sums, "span")
    # The sum up to a node's way out, less the sum before its way in.
    inwards = F.col("slot") % 2 == 0
    up_to = [F.when(inwards, F.col(own) - F.col(all_) - F.col(off)).otherwise(F.col(all_) + F.col(off)) for own, all_, off in (("leaf", "leaves", "l"), ("saved", "tokens", "s"))]
    return summed.groupBy(F.col("conv").alias("conv_id"), F.floor(F.col("slot") / 2).alias("depth")).agg(F.sum(up_to[0]).alias("n_leaves"), F.sum(up_to[1]).alias("saved_tokens"))


def prefix_trie(talks: DataFrame, group: int, most: int, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", task: int = TASK) -> DataFrame:
    """One row per node of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns of a conversation stand by ``turn`` (null first; equal turns by role
    and text); null role or text is empty. Conversation c is rebuilt as the
    first h turns of conversation c - c % ``group`` (all if it has fewer, none
    if it is absent), h being crc32(c) % ``most``, and then its own turns after
    its first h. A node is a distinct sequence of first turns; the root is the
    empty one, of which every conversation is a member, also one that is left
    without turns. ``conv_id`` is the smallest member. Rows without a
    conversation id take no part; repeated rows are turns of their own; an
    empty table has no root; other columns are ignored. Role and text are told
    apart by their SHA-256.
    """
    with Scratch() as keep:
        convs, rows = _rebuilt(keep, _turns(keep, talks, conv_col, turn_col, role_col, text_col), group, most)
        rows = keep(_prefixes(keep, rows), "prefixes")
        same = F.when(F.min("digest") == F.max("digest"), F.count("*")).otherwise(F.raise_error(F.lit("keys of two prefixes have met by chance")).cast("long"))
        nodes = rows.groupBy(*NODE, "p1", "p2").agg(F.min("conv").alias("conv_id"), same.alias("n_convs"), F.min("n_bytes").alias("n_bytes"))
        nodes = keep(nodes, "nodes")
        root, n = convs.agg(F.min("conv"), F.count("*")).first()
        zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
        names = [*NODE, "conv_id", "parent_conv_id", "n_convs", "saved"]
        saved = ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved")
        # Children of the root, of which there may be any number, need no join.
        top = nodes.where("depth = 1").select(*NODE, "conv_id", F.lit(root).cast("long").alias("parent_conv_id"), "n_convs", saved)
        parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
        deep = nodes.where("depth > 1").join(parents, ["depth", "p1", "p2"]).select(*NODE, "conv_id", "parent_conv_id", "n_convs", saved)
        first = convs.sparkSession.range(1 if n else 0).select(zero, zero, zero, F.lit(root).cast("long"), none, F.lit(n).cast("long"), zero)
        nodes = keep(first.toDF(*names).union(top).union(deep), "trie")
        below = nodes.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
        found = nodes.join(below, ["conv_id", "depth"], "left").join(_subtrees(keep, nodes, task), ["conv_id", "depth"]).join(_ends(convs, rows), NODE, "left")
        empty = F.lit(hashlib.sha256(b"").hexdigest())
        found = found.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", empty).alias("ends_sha256"))
        return materialise(found, "prefix-trie")
