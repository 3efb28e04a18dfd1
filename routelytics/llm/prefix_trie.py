"""Prefix trie of conversations: nodes, members and subtree sums.

A prefix is known by its depth and a digest that is a sum over its turns: the SHA-256 of a
turn, times a power of a base that stands for its place, modulo a prime, twice.  A sum can
be taken over blocks of a conversation, so even a conversation with a third of all turns
is spread; the grouping by digest checks that all members of a node have the same parent,
which (by induction over the depth) proves that no two prefixes share a digest.

The turns of all conversations, range-sorted, are cut into shards.  A shard enumerates the
distinct digests among its turns and gives them slots by a minimal perfect hash, checked
against the digest kept in the slot; what its turns bring is scattered into flat arrays by
slot and added up, from the deepest level to the root, through an array of parent slots.
A node's own value is brought by one turn alone, that of its smallest member, and the rest
of that member's path is in the same shard, so the sums of the shards add up by digest.
Only a conversation cut by a shard's border has the rest of its path in shards before;
what flows over a border is one number a shard, passed on along the conversation's turns.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, partitions, running_totals

#: Turns of a shard at most (about), shared first turns, conversations that share them, leading characters that order ties.
SHARD_TURNS, MOST_SHARED, GROUP, LEAD = 500_000, 6, 100, 32
#: The digests' prime and bases (any large numbers).
PRIME = (1 << 61) - 1
BASES = (0x1B873593CC9E2D51 % PRIME, 0x165667B19E3779F9 % PRIME)
#: Ids of a list that travel in one row.
PIECE = 1000
KEY = ["depth", "h1", "h2"]


# ------------------------------------------------------------------ minimal perfect hash
def _mixed(keys: tuple[np.ndarray, ...], seed: int) -> np.ndarray:
    """64 well-mixed bits of some columns of numbers."""
    x = np.full(len(keys[0]), (seed + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for k in keys:
        x = (x ^ k.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(32)
    return x


class PerfectHash:
    """Slots 0..n-1 for n distinct keys (columns of numbers).  Level by level, keys that
    have a place of a bit array to themselves stay there and the others go on; the slot is
    the number of set bits before.  The keys are kept by slot, so others are told apart."""

    def __init__(self, keys: tuple[np.ndarray, ...]):
        self.levels, rest, n = [], np.arange(len(keys[0])), 0
        while len(rest):
            some = tuple(k[rest] for k in keys)
            place = (_mixed(some, len(self.levels)) % np.uint64(2 * len(rest) + 1)).astype(np.int64)
            bits = np.bincount(place, minlength=2 * len(rest) + 1) == 1
            self.levels.append((bits, np.cumsum(bits) - bits + n))
            n += int(bits.sum())
            rest = rest[~bits[place]]
        self.keys = keys
        slot = self._slots(keys)
        self.keys = tuple(np.empty_like(k) for k in keys)
        for own, k in zip(self.keys, keys):
            own[slot] = k

    def _slots(self, keys) -> np.ndarray:
        out, rest = np.full(len(keys[0]), -1, np.int64), np.arange(len(keys[0]))
        for i, (bits, before) in enumerate(self.levels):
            if not len(rest):
                break
            place = (_mixed(tuple(k[rest] for k in keys), i) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[place]
            out[rest[hit]] = before[place[hit]]
            rest = rest[~hit]
        return out

    def slots(self, keys: tuple[np.ndarray, ...]) -> np.ndarray:
        """The slot of each key, -1 if it is none of those hashed."""
        out = self._slots(keys)
        for own, k in zip(self.keys, keys):
            if len(own):
                out[own[out] != k] = -1
        return out


def distinct(keys: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    order = np.lexsort(keys[::-1])
    sorted_ = tuple(k[order] for k in keys)
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([k[1:] != k[:-1] for k in sorted_], axis=0)
    return tuple(k[new] for k in sorted_)


def shard_sums(depth, h1, h2, p1, p2, values: tuple[np.ndarray, ...]):
    """Subtree sums over the turns of one shard: the nodes' (depth, h1, h2), the sums of
    each of ``values``, and what reaches a node whose parent is not in the shard."""
    table = PerfectHash(distinct((depth, h1, h2)))
    slot, n = table.slots((depth, h1, h2)), len(table.keys[0])
    parent = np.full(n, -1, np.int64)
    parent[slot] = table.slots((depth - 1, p1, p2))
    sums = []
    for v in values:
        x = np.zeros(n, np.int64)
        np.add.at(x, slot, v)
        sums.append(x)
    by_depth = np.argsort(-table.keys[0], kind="stable")
    cuts = np.flatnonzero(np.diff(table.keys[0][by_depth])) + 1
    for level in np.split(by_depth, cuts):  # the deepest first
        up = parent[level]
        inside = up >= 0
        for x in sums:
            np.add.at(x, up[inside], x[level[inside]])
    loose = (parent < 0) & (table.keys[0] > 0)
    return table.keys, sums, [int(x[loose].sum()) for x in sums]


# ------------------------------------------------------------------ rebuilt conversations
def shared_turns(conv_id):
    """How many first turns of its group's first conversation a conversation begins with."""
    return (F.crc32(conv_id.cast("string")) % MOST_SHARED).cast("long")


def rebuilt(conversations: DataFrame, s: Scratch) -> DataFrame:
    """(conv, depth, x1, x2, cp): the turns of every rebuilt conversation, depth from 1,
    and a row of depth 0 for every conversation.  x1, x2: 60 bits each of the turn's
    SHA-256; cp: code points of its text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    sha = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    bits = lambda a: F.conv(F.substring("sha", a, 15), 16, 10).cast("long")
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn"), role.alias("role"), F.substring(text, 1, LEAD).alias("lead"),
        sha.alias("sha"), F.length(text).cast("long").alias("cp")).select(
        "conv", "turn", "role", "lead", bits(1).alias("x1"), bits(17).alias("x2"), "cp", F.lit(1).cast("long").alias("one"))
    turns = s.table(turns, "turns")
    placed = s.table(running_totals(turns, ["conv", "turn", "role", "lead", "x1", "x2"], "one", "pos", s, group="conv")
                     .select("conv", "pos", "x1", "x2", "cp"), "placed")
    convs = placed.groupBy("conv").agg(F.max("pos").alias("n")).withColumn("h", shared_turns(F.col("conv")))
    convs = s.table(convs.withColumn("base", F.col("conv") - F.col("conv") % GROUP), "convs")
    has = convs.filter(F.col("conv") == F.col("base")).select("base", F.col("n").alias("n_base"))
    convs = convs.join(has, "base", "left").select(
        "conv", "base", "h", F.least("h", F.coalesce("n_base", F.lit(0))).alias("first"))
    head = placed.filter((F.col("conv") % GROUP == 0) & (F.col("pos") < MOST_SHARED)).withColumnRenamed("conv", "base")
    # at most five turns of at most a hundred conversations
    shared = convs.filter(F.col("first") > 0).join(head, "base").filter(F.col("pos") <= F.col("first")).select(
        "conv", F.col("pos").alias("depth"), "x1", "x2", "cp")
    own = placed.withColumn("h", shared_turns(F.col("conv"))).filter(F.col("pos") > F.col("h"))
    short = convs.filter(F.col("first") < F.col("h")).select("conv", "first")
    own = own.join(short, "conv", "left").select(
        "conv", (F.col("pos") - F.col("h") + F.coalesce("first", "h")).alias("depth"), "x1", "x2", "cp")
    zero = F.lit(0).cast("long")
    root = convs.select("conv", zero.alias("depth"), zero.alias("x1"), zero.alias("x2"), zero.alias("cp"))
    return root.unionByName(shared).unionByName(own)


def _paths(turns: DataFrame, shards: int) -> DataFrame:
    """The turns sorted and cut into shards, with their share of the digest (y) and the
    sum of these over the conversation's turns in the shard so far (l)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, conv, sums = TaskContext.get().partitionId(), None, [0, 0]
        power, at = [0, 0], -1
        for b in batches:
            ys, ls = ([], []), ([], [])
            convs, depths = b.column("conv").to_pylist(), b.column("depth").to_pylist()
            xs = (b.column("x1").to_pylist(), b.column("x2").to_pylist())
            for i, (c, d) in enumerate(zip(convs, depths)):
                if c != conv:
                    conv, sums, at = c, [0, 0], -1
                for k in (0, 1):
                    power[k] = power[k] * BASES[k] % PRIME if at >= 0 and d == at + 1 else pow(BASES[k], d, PRIME)
                    y = xs[k][i] * power[k] % PRIME
                    sums[k] = (sums[k] + y) % PRIME
                    ys[k].append(y)
                    ls[k].append(sums[k])
                at = d
            cols = [b.column(c) for c in ("conv", "depth", "cp")]
            yield pa.RecordBatch.from_arrays(
                [*cols, *(pa.array(x, pa.int64()) for x in (*ys, *ls)), pa.array([shard] * len(convs), pa.int32())],
                ["conv", "depth", "cp", "y1", "y2", "l1", "l2", "shard"])
    return (turns.repartitionByRange(shards, "conv", "depth").sortWithinPartitions("conv", "depth")
            .mapInArrow(run, "conv long, depth long, cp long, y1 long, y2 long, l1 long, l2 long, shard int"))


def _members(paths: DataFrame) -> tuple[DataFrame, list]:
    """Every turn of every conversation with the digests of its node (h) and of the node's
    parent (p); and of each shard (shard, first conv, its depth, last conv), in order."""
    ends = sorted(tuple(r) for r in paths.groupBy("shard").agg(
        F.min(F.struct("conv", "depth")).alias("a"), F.max(F.struct("conv", "depth", "l1", "l2")).alias("z")).select(
        "shard", "a.conv", "a.depth", "z.conv", "z.l1", "z.l2").collect())  # one row a shard
    carry, before = [], None
    for shard, first, depth, last, l1, l2 in ends:
        into = (0, 0)
        if depth > 0:  # continues from the shard before
            into = before
            carry.append((shard, first, *into))
        on = into if depth > 0 and first == last else (0, 0)
        before = ((on[0] + l1) % PRIME, (on[1] + l2) % PRIME)
    spark = paths.sparkSession
    table = spark.createDataFrame(carry, "shard int, conv long, s1 long, s2 long")
    with_carry = paths.join(F.broadcast(table), ["shard", "conv"], "left")  # at most one row a shard
    h = [((F.col(f"l{k}") + F.coalesce(f"s{k}", F.lit(0))) % PRIME) for k in (1, 2)]
    members = with_carry.select("shard", "conv", "depth", "cp", "y1", "y2", h[0].alias("h1"), h[1].alias("h2"))
    p = [((F.col(f"h{k}") - F.col(f"y{k}") + PRIME) % PRIME).alias(f"p{k}") for k in (1, 2)]
    return members.select("shard", "conv", "depth", "cp", "h1", "h2", *p), [x[:4] for x in ends]


# ------------------------------------------------------------------ trie
def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations of a table (conv_id, turn,
    role, text): conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.

    Turns go by turn (null first), equal ones by role, then the text's first characters,
    then its digest; repeated rows are turns of their own.  Null role and text are empty.
    Rows without conv_id belong to no conversation and are left out.  A conversation c
    begins with up to crc32(c) % 6 first turns of conversation c - c % 100.  Extra columns
    are ignored; an empty table has no nodes, not even a root.  conv_id must be an integer
    column.
    """
    spark = conversations.sparkSession
    s = Scratch(spark, "prefix-trie")
    turns = rebuilt(conversations, s)
    turns = s.table(turns, "rebuilt")
    shards = max(partitions(spark), math.ceil(turns.count() / SHARD_TURNS))
    paths = s.table(_paths(turns, shards), "paths")
    members, ends = _members(paths)
    members = s.table(members, "members")

    same = lambda c: F.when(F.min(c) == F.max(c), F.min(c)).otherwise(F.raise_error(F.lit("two prefixes share a digest")).cast("long"))
    nodes = s.table(members.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("conv_id"), same("p1").alias("p1"), same("p2").alias("p2"),
        same("cp").alias("cp")), "nodes")
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("h1"), F.col("p2").alias("h2")).agg(
        F.count(F.lit(1)).alias("n_children"))
    nodes = s.table(nodes.join(children, KEY, "left").fillna(0, ["n_children"]), "nodes")

    sums = _subtree_sums(members, nodes, ends, s)
    found = nodes.join(sums, KEY).join(_ends(members, shards), KEY, "left")
    up = nodes.select((F.col("depth") + 1).alias("depth"), F.col("h1").alias("p1"), F.col("h2").alias("p2"),
                      F.col("conv_id").alias("parent_conv_id"))
    # the children of one node may be many; the join's other side has one row for each
    found = found.join(up, ["depth", "p1", "p2"], "left")
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def _subtree_sums(members: DataFrame, nodes: DataFrame, ends: list, s: Scratch) -> DataFrame:
    """(depth, h1, h2, n_leaves, saved_tokens) of all nodes."""
    own = nodes.select(F.col("conv_id").alias("conv"), "depth", (F.col("n_children") == 0).cast("long").alias("leaf"),
                       ((F.col("n_convs") - 1) * F.col("cp")).alias("saved"))
    brought = members.join(own, ["conv", "depth"], "left").fillna(0, ["leaf", "saved"])

    def run(table: pa.Table) -> pa.Table:
        x = {c: table.column(c).to_numpy() for c in ("depth", "h1", "h2", "p1", "p2", "leaf", "saved")}
        keys, sums, out = shard_sums(x["depth"], x["h1"], x["h2"], x["p1"], x["p2"], (x["leaf"], x["saved"]))
        some = (sums[0] != 0) | (sums[1] != 0)
        shard = table.column("shard")[0].as_py()
        cols = [*(np.append(k[some], -1) for k in keys), *(np.append(v[some], o) for v, o in zip(sums, out))]
        return pa.table([pa.array(c, pa.int64()) for c in cols] + [pa.array([shard] * len(cols[0]), pa.int32())],
                        names=[*KEY, "leaves", "saved", "shard"])

    parts = s.table(brought.groupBy("shard").applyInArrow(
        run, "depth long, h1 long, h2 long, leaves long, saved long, shard int"), "sums")
    # one row a shard: what flows over its first border
    loose = {r.shard: (r.leaves, r.saved) for r in parts.filter("depth < 0 AND (leaves > 0 OR saved > 0)").collect()}
    into, flow = [], (0, 0)
    for shard, first, depth, last in reversed(ends):
        if any(flow):
            into.append((shard, last, *flow))
        on = flow if depth > 0 and first == last else (0, 0)
        flow = tuple(a + b for a, b in zip(on, loose.get(shard, (0, 0)))) if depth > 0 else (0, 0)
    late = members.sparkSession.createDataFrame(into, "shard int, conv long, leaves long, saved long")
    passed = members.join(F.broadcast(late), ["shard", "conv"]).select(*KEY, "leaves", "saved")  # at most one row a shard
    return parts.filter("depth >= 0").select(*KEY, "leaves", "saved").unionByName(passed).groupBy(*KEY).agg(
        F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))


def _ends(members: DataFrame, shards: int) -> DataFrame:
    """(depth, h1, h2, ends_sha256) of the nodes at which conversations end.  The ids of a
    node are sorted over all tasks; nodes within one block are hashed there, the lists of
    the others travel as pieces of text and are hashed as a stream."""
    last = members.groupBy("conv").agg(F.max(F.struct("depth", "h1", "h2")).alias("z")).select("z.*", "conv")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, key, ids, first, n = TaskContext.get().partitionId(), None, [], True, 0
        rows = []

        def close(whole: bool):
            """A node's list: its digest, or the (rest of the) list as a piece of text."""
            nonlocal ids, n
            text = ",".join(map(str, ids)).encode()
            if whole and not n:
                rows.append((*key, hashlib.sha256(text).hexdigest(), None, None, None))
            elif ids:
                rows.append((*key, None, block, n, text))
                n += 1
            ids = []

        def batch():
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(),
                                              pa.int64(), pa.binary()))], [*KEY, "sha", "block", "n", "piece"])
            rows.clear()
            return out
        for b in batches:
            cols = [b.column(c).to_pylist() for c in (*KEY, "conv")]
            for d, h1, h2, c in zip(*cols):
                if (d, h1, h2) != key:
                    if key is not None:
                        close(not first)
                        first = False
                    key, n = (d, h1, h2), 0
                ids.append(c)
                if len(ids) >= PIECE:
                    close(False)
                if len(rows) >= 2000:
                    yield batch()
        if key is not None:
            close(False)  # the last node may go on in the next block
        if rows:
            yield batch()

    found = last.repartitionByRange(shards, *KEY, "conv").sortWithinPartitions(*KEY, "conv").mapInArrow(
        listed, "depth long, h1 long, h2 long, sha string, block int, n long, piece binary")
    s = Scratch(members.sparkSession, "prefix-trie-ends")
    found = s.table(found, "lists")

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, h = None, None
        for b in batches:
            out = []
            for *k, piece in zip(*(b.column(c).to_pylist() for c in (*KEY, "piece"))):
                if k != key:
                    if key is not None:
                        out.append((*key, h.hexdigest()))
                    key, h = k, hashlib.sha256()
                else:
                    h.update(b",")
                h.update(piece)
            if out:
                yield _hashed(out)
        if key is not None:
            yield _hashed([(*key, h.hexdigest())])

    # at most two nodes a block come here, and those with long lists
    cut = found.filter("sha IS NULL").repartition(partitions(members.sparkSession), *KEY).sortWithinPartitions(*KEY, "block", "n").select(
        *KEY, "piece").mapInArrow(streamed, "depth long, h1 long, h2 long, ends_sha256 string")
    return found.filter("sha IS NOT NULL").select(*KEY, F.col("sha").alias("ends_sha256")).unionByName(cut)


def _hashed(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string()))],
                                      [*KEY, "ends_sha256"])
