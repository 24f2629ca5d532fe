"""The trie of conversation prefixes, rolled up by bands of depth.

A node is a distinct sequence of first turns. Its identity is a digest chained over the turns, so that it can be told where
the turns lie. Sums over subtrees are made in bands of ``height`` levels: a node's row goes to its ancestors inside the band
and no further; the nodes at the tops of bands then hold their bands' totals and form a smaller trie of their own, which is
rolled up in the same way; a finished top's total goes to the ancestors in the band above it. A row is copied at most
``height`` times at each level, and there are as many levels as the greatest depth has digits to the base ``height``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonority.llm.common import finished, met, table, written

#: Levels of a band, and bytes of a node's digest.
HEIGHT, WIDE = 8, 16
#: Turns that a conversation takes over from the first one of its five at most (a remainder by 9), and the size of those groups.
HEADS, FAMILY = 9, 5
#: Conversation ids that are joined into one piece before they are shuffled.
PIECE = 4096

ROOT = bytes(WIDE)


def ordered(turns: DataFrame) -> DataFrame:
    """``conv_id, place, digest, bytes``: turns in order, with a digest of role and text and the text's bytes.

    Nulls of ``turn`` come first; equal ones are ordered by role and then by the digest. Null roles and texts count as empty.
    Rows without a ``conv_id`` belong to no conversation. Texts aren't shuffled.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    told = F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, WIDE)
    slim = turns.where("conv_id is not null").select("conv_id", F.col("turn").alias("_turn"), role.alias("_role"), told.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    by = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("_turn"), "_role", "digest")
    return slim.select("conv_id", (F.row_number().over(by) - 1).alias("place"), "digest", "bytes")


def heads(conv_id: Column) -> Column:
    """How many turns a conversation takes over."""
    return F.crc32(conv_id.cast("string")) % HEADS


def rebuilt(rows: DataFrame) -> DataFrame:
    """``conv_id, h, taken``: how many turns each conversation takes over at most, and those that it does, as an array.

    Conversations are rebuilt from the first one of their five: its first turns, then their own turns after as many. Only
    the first eight turns of a conversation are ever gathered.
    """
    few = rows.where(F.col("place") < HEADS - 1)
    top = few.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "digest", "bytes"))).alias("_top"))
    first = top.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("_first"), "_top")
    named = top.select("conv_id", heads(F.col("conv_id")).alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("_first"))
    return named.join(first, "_first", "left").select("conv_id", "h", F.coalesce(F.slice("_top", F.lit(1), F.col("h").cast("int")), F.array().cast("array<struct<place:int,digest:binary,bytes:bigint>>")).alias("taken"))


def chained(rows: DataFrame, height: int) -> DataFrame:
    """Nodes along each conversation: ``node, depth, bytes, ups, conv_id, ends``, one row for each turn and one for the root.

    Rows ``conv_id, at, digest, bytes`` lie sorted; ``at`` -1 opens a conversation. A conversation passes as a stream: what is
    held of it is the last ``height`` nodes of each level. ``ups`` has, for each level of bands whose top the node is, and for
    the one above, the ancestors of the band's levels, packed; the first of them is the top above, the last of the first level is
    the parent. ``ends`` marks the last node.
    """

    def at_level(above: list[list[bytes]], level: int) -> list[bytes]:
        if level == len(above):
            above.append([ROOT])
        return above[level]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, node, depth, above, held = None, ROOT, 0, [], None
        for b in batches:
            out = []
            for c, at, digest, size in zip(*(b.column(k).to_pylist() for k in ("conv_id", "at", "digest", "bytes"))):
                if held is not None:
                    out.append((*held, at < 0))
                if at < 0:
                    conv, node, depth, above = c, ROOT, 0, []
                    held = (node, 0, 0, [], conv)
                    continue
                # the node before this one becomes an ancestor, at each level whose bands it tops; the root is one from the start
                level, k = 0, depth
                while k:
                    band = at_level(above, level)
                    if len(band) == height:
                        band.clear()
                    band.append(node)
                    level, k = level + 1, k // height if k % height == 0 else 0
                depth += 1
                node = hashlib.sha256(node + digest).digest()[:WIDE]
                ups, level, k = [b"".join(at_level(above, 0))], 0, depth
                while k % height == 0:
                    level, k = level + 1, k // height
                    ups.append(b"".join(at_level(above, level)))
                held = (node, depth, size, ups, conv)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), KINDS)], NAMES)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*held, True), KINDS)], NAMES)

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "at").mapInArrow(walk, "node binary, depth int, bytes long, ups array<binary>, conv_id long, ends boolean")


NAMES = ["node", "depth", "bytes", "ups", "conv_id", "ends"]
KINDS = [pa.binary(), pa.int32(), pa.int64(), pa.list_(pa.binary()), pa.int64(), pa.bool_()]


def unpacked(ups: Column) -> Column:
    """Packed nodes as an array."""
    n = (F.length(ups) / WIDE).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(ups, i * WIDE + 1, F.lit(WIDE)))).otherwise(F.array().cast("array<binary>"))


def rolled_up(nodes: DataFrame, sums: list[str], height: int = HEIGHT, level: int = 0) -> DataFrame:
    """``node`` and the columns ``sums``, summed over each node's subtree.

    :param nodes: ``node, depth, ups`` and the columns; at level k, the nodes whose depth is a multiple of the k-th power of
        ``height``, with what has been summed into them so far.
    """
    total = [F.sum(c).alias(c) for c in sums]
    top = F.col("depth") % height ** (level + 1) == 0
    up = unpacked(F.get("ups", F.lit(level)))
    own = F.when(top, F.array("node")).otherwise(F.concat(F.array("node"), up))
    within = nodes.select(F.explode(own).alias("node"), *sums).groupBy("node").agg(*total)
    tops = nodes.where(top).select("node", "depth", "ups")
    if tops.where("depth > 0").isEmpty():
        return within
    within = written(within, "band-totals")
    found = written(tops.join(within, "node"), "band-tops")
    finished = written(rolled_up(found, sums, height, level + 1).join(found.select("node", up.alias("_up")), "node"), "finished-tops")
    # tops have their finished totals; the other nodes of a band get those of the tops right below it
    spread = finished.select(F.explode(F.slice("_up", 2, height)).alias("node"), *sums)
    rest = within.join(found.select("node"), "node", "left_anti").select("node", *sums)
    return finished.select("node", *sums).unionByName(rest.unionByName(spread).groupBy("node").agg(*total))


def digests(ends: DataFrame) -> DataFrame:
    """``node, ends_sha256``: the hash of the ascending ids of each node's ``ends(node, conv_id)``, joined by commas.

    A hash is made in order by its nature. Ids are sorted over ranges, so that a node with very many lies in several; each
    range joins them to pieces, and one task streams a node's pieces through the hash.
    """

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids = None, []

        def piece() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])], ["node", "first", "piece"])

        for b in batches:
            for n, c in zip(b.column("node").to_pylist(), b.column("conv_id").to_pylist()):
                if n != node or len(ids) >= PIECE:
                    if ids:
                        yield piece()
                    node, ids = n, []
                ids.append(c)
        if ids:
            yield piece()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for b in batches:
            out = []
            for n, p in zip(b.column("node").to_pylist(), b.column("piece").to_pylist()):
                if n != node:
                    if state is not None:
                        out.append((node, state.hexdigest()))
                    node, state = n, hashlib.sha256(p.encode())
                else:
                    state.update(b"," + p.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in out], pa.binary()), pa.array([h for _, h in out])], ["node", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], ["node", "ends_sha256"])

    tasks = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = ends.repartitionByRange(tasks, "node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(joined, "node binary, first long, piece string")
    return pieces.repartition("node").sortWithinPartitions("node", "first").mapInArrow(hashed, "node binary, ends_sha256 string")


def prefix_trie(turns: DataFrame, height: int = HEIGHT) -> DataFrame:
    """All nodes of the trie of the rebuilt conversations.

    :param turns: ``conv_id, turn, role, text`` and any other columns, which are ignored. Null roles and texts are empty, null
        turns come first, equal turns are ordered by role and digest, repeated rows are turns of their own, and rows without a
        ``conv_id`` are in no conversation. An empty table has no node, not even a root.
    :return: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``, a row for each node.
    """
    return finished(turns.sparkSession, "trie", lambda: _prefix_trie(turns, height))


def _prefix_trie(turns: DataFrame, height: int) -> DataFrame:
    rows = ordered(turns)
    slim = written(rows, "turns")
    plan = rebuilt(slim)
    opened = plan.select("conv_id", F.lit(-1).cast("long").alias("at"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("bytes"))
    taken = plan.select("conv_id", F.explode("taken").alias("t")).select("conv_id", F.col("t.place").cast("long").alias("at"), "t.digest", "t.bytes")
    own = slim.where(F.col("place") >= heads(F.col("conv_id"))).select("conv_id", (F.col("place") + HEADS).cast("long").alias("at"), "digest", "bytes")
    walked = written(chained(opened.union(taken).union(own), height), "walked")

    keys = ["node", "depth", "bytes", "ups"]
    nodes = written(walked.groupBy(*keys).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")), "nodes")
    parent = F.when(F.col("depth") > 0, F.substring(F.col("ups")[0], F.length(F.col("ups")[0]) - WIDE + 1, F.lit(WIDE)))
    children = nodes.where("depth > 0").groupBy(parent.alias("node")).agg(F.count("*").alias("n_children"))
    full = nodes.join(children, "node", "left").select(*keys, "n_convs", "conv_id", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), parent.alias("parent"))
    full = written(full, "nodes")
    own = full.select("node", "depth", "ups", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"))
    sums = rolled_up(own, ["n_leaves", "saved_tokens"], height)
    named = full.where("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    some = full.where("parent is not null").select("node", "parent")
    parents = met(some, named, "parent", "n_children", max(1, some.count())).select("node", "parent_conv_id")
    ends = digests(walked.where("ends").select("node", "conv_id"))
    out = full.join(sums, "node").join(parents, "node", "left").join(ends, "node", "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256")
    )


def query(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


#: By definition: a node is a list of turns, its subtree are the nodes that begin with it. The checksum of an id is worked out bit
#: by bit.
SQL = """
with turn as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 as place,
    struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) as t
  from conversations where conv_id is not null
), conv as (select conv_id, list(t order by place) as own from turn group by conv_id),
head as (
  select *, (xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(conv_id::varchar, ''), lambda ch: [ascii(ch)::bigint] || list_transform(range(8), lambda i: -1::bigint)))),
    lambda s, x: case when x >= 0 then xor(s, x) else xor(s >> 1, case when s & 1 = 1 then 3988292384::bigint else 0::bigint end) end), 4294967295::bigint)) % 9 as h
  from conv
), rebuilt as (
  select a.conv_id, coalesce(b.own[1:a.h], []) || a.own[a.h + 1:] as path from head a left join conv b on b.conv_id = a.conv_id - a.conv_id % 5
), member as (select conv_id, d, path[1:d] as node, d = len(path) as ends from rebuilt, unnest(range(0, len(path) + 1)) as u(d)),
node as (
  select node, d as depth, min(conv_id) as conv_id, count(*) as n_convs, sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where ends), '')) as ends_sha256 from member group by node, d
), kid as (select node[1:depth - 1] as node, depth - 1 as depth, count(*) as n_children from node where depth > 0 group by all),
sized as (select n.*, coalesce(k.n_children, 0) as n_children, case when n.depth = 0 then 0 else (n_convs - 1) * strlen(n.node[n.depth].text) end as own from node n left join kid k using (node, depth)),
up as (
  select s.node[1:a] as node, a as depth, count(*) filter (where s.n_children = 0) as n_leaves, sum(s.own)::bigint as saved_tokens from sized s, unnest(range(0, s.depth + 1)) as u(a) group by all
)
select s.conv_id, s.depth, p.conv_id as parent_conv_id, s.n_convs, s.n_children, u.n_leaves, u.saved_tokens, s.ends_sha256
from sized s join up u using (node, depth) left join node p on p.depth = s.depth - 1 and p.node = s.node[1:s.depth - 1]
"""
