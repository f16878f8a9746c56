"""Conversation prefix trie by a splitter skeleton (operator 12).

A conversation is a path of turns. Conversations are sorted by path (then id) over many tasks: splitters, chosen from a
bounded sample, cut the order into shards. The trie of the splitters' paths, the skeleton, is the only part of
the whole trie that can reach over several shards, and is known to every task. A task walks its sorted shard once,
holding the nodes of one path: every other node lies in it whole and is finished there; of a skeleton node it
returns partial numbers, which are added up afterwards, over shards and then along the skeleton.

A turn is told apart by 128 bits of the SHA-256 of its role and text. Shards are cut inside groups of equal conversations,
too, as the id belongs to the order. Ids that end at one node are hashed as a stream, in order; a skeleton
node's come as blocks of ids from the shards that have them. A splitter has at most SPLITTER_TURNS turns, so the
skeleton has at most that many nodes for each shard, whatever the data.

Null roles and texts are empty ones; turns come by number, null first, and turns of one number by their digest. Rows
without a conv_id belong to no conversation. A repeated row is a turn like any other. A text of any length is one
digest; a conversation is one row of 32 characters and one number for each turn. Without conversations there is no
trie, and so no rows. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecheck.llm.common import crc32_sql, table, tidy, written
from tablecheck.operators.skew import split_hot_join

# Characters of a path for each turn.
STEP = 32
# Sampled paths for each shard, and the turns of a splitter.
SAMPLE = 32
SPLITTER_TURNS = 256
# Ids in a block that a shard hands on.
BLOCK = 8192
TOP = b"\0" * 16
SHARED, HEADS = 6, 100


def turns_of(rows: DataFrame) -> DataFrame:
    """conv_id, turns (array of digest, size) of a table (conv_id, turn, role, text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, STEP)
    each = F.struct("turn", digest.alias("digest"), F.length(text).cast("long").alias("size"))
    sorted_turns = F.sort_array(F.collect_list(each))
    turns = rows.where("conv_id is not null").groupBy("conv_id").agg(sorted_turns.alias("turns"))
    return turns.withColumn("turns", F.transform("turns", lambda t: F.struct(t["digest"], t["size"])))


def with_shared_heads(turns: DataFrame, heads: int = HEADS, most: int = SHARED) -> DataFrame:
    """Each conversation c begins with the first h turns of conversation c - c % heads, in place of its own
    (h = crc32 of the id's digits, modulo ``most``)."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    first = turns.where(F.col("conv_id") % heads == 0).select(
        F.col("conv_id").alias("head"), F.slice("turns", 1, most - 1).alias("first")
    )
    both = turns.withColumn("head", F.col("conv_id") - F.col("conv_id") % heads).join(first, "head", "left")
    head = F.coalesce(F.slice("first", F.lit(1), h), F.slice("turns", 1, 0))
    return both.select("conv_id", F.concat(head, F.slice("turns", h + 1, F.size("turns"))).alias("turns"))


def splitters_of(paths: DataFrame, shards: int) -> list[tuple[str, int]]:
    """At most shards - 1 places (path, conv_id) that cut the paths into about equal parts."""
    short = F.substring("path", 1, SPLITTER_TURNS * STEP).alias("path")
    drawn = paths.orderBy(F.xxhash64("conv_id"), "conv_id").limit(SAMPLE * shards).select(short, "conv_id")
    rows = sorted((r["path"], r["conv_id"]) for r in drawn.toLocalIterator())
    return sorted({rows[k * len(rows) // shards] for k in range(1, shards)}) if rows else []


def _shard(path: Column, id: Column, splitters: list[tuple[str, int]]) -> Column:
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for paths, ids in batches:
            yield pa.array([bisect_right(splitters, x) for x in zip(paths.to_pylist(), ids.to_pylist())], pa.int32())

    return F.arrow_udf(tidy(run), "int").asNondeterministic()(path, id)


def below(key: bytes, digest: str) -> bytes:
    """The key of the child that a turn leads to."""
    return xxhash.xxh3_128_digest(key + digest.encode())


def skeleton_of(splitters: list[tuple[str, int]]) -> set[bytes]:
    """The keys of all nodes on the splitters' paths, the root among them."""
    out = {TOP}
    for path, _ in splitters:
        key = TOP
        for k in range(0, len(path), STEP):
            key = below(key, path[k : k + STEP])
            out.add(key)
    return out


class _Node:
    __slots__ = ("key", "size", "conv_id", "convs", "ends", "children", "leaves", "saved", "sha", "held", "first")

    def __init__(self, key: bytes, size: int, conv_id: int):
        self.key, self.size, self.conv_id = key, size, conv_id
        self.convs = self.ends = self.children = self.leaves = self.saved = 0
        self.sha, self.held, self.first = None, [], conv_id


NODE = (
    "whole boolean, key binary, parent_key binary, above array<binary>, depth long, size long, conv_id long, "
    "n_convs long, n_children long, n_leaves long, saved long, ends string"
)
_KIND = pa.schema([
    ("whole", pa.bool_()), ("key", pa.binary()), ("parent_key", pa.binary()), ("above", pa.list_(pa.binary())), ("depth", pa.int64()),
    ("size", pa.int64()), ("conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
    ("saved", pa.int64()), ("ends", pa.string()),
])


class Walk:
    """The nodes of one sorted shard after another; finished ones wait in ``out``.

    A row with ``whole`` is a finished node. Of a skeleton node there is one row of partial numbers, with the keys from
    the root to it, and rows with null depth for blocks of the ids that end there, by their first.
    """

    def __init__(self, skeleton: set[bytes]):
        self.skeleton, self.path, self.stack, self.out = skeleton, "", [], []

    def add(self, path: str, sizes: list[int], conv_id: int) -> None:
        same, most = 0, min(len(path), len(self.path))
        while same < most and path[same : same + STEP] == self.path[same : same + STEP]:
            same += STEP
        if self.stack:
            self.close(same // STEP + 1)
        else:
            self.stack.append(_Node(TOP, 0, conv_id))
        for k in range(len(self.stack) - 1, len(path) // STEP):
            key = below(self.stack[-1].key, path[k * STEP : (k + 1) * STEP])
            self.stack.append(_Node(key, sizes[k], conv_id))
        self.path, node = path, self.stack[-1]
        node.ends += 1
        node.held.append(str(conv_id))
        if node.key in self.skeleton:
            if len(node.held) == 1:
                node.first = conv_id
            elif len(node.held) == BLOCK:
                self.block(node)
        elif len(node.held) == BLOCK:
            self.hash(node)

    def hash(self, node: _Node) -> None:
        if node.held:
            text = ",".join(node.held).encode()
            if node.sha:
                text = b"," + text
            node.sha = node.sha or hashlib.sha256()
            node.sha.update(text)
            node.held = []

    def block(self, node: _Node) -> None:
        if node.held:
            self.out.append((False, node.key, None, None, None, None, node.first, None, None, None, None, ",".join(node.held)))
            node.held = []

    def close(self, depth: int) -> None:
        """Ends the nodes from a depth on."""
        while len(self.stack) > depth:
            node = self.stack.pop()
            at = len(self.stack)
            parent = self.stack[-1] if self.stack else None
            node.convs += node.ends
            split = node.key in self.skeleton
            if split:
                self.block(node)
                above = [x.key for x in self.stack] + [node.key]
                numbers = (node.conv_id, node.convs, node.children, node.leaves, node.saved, None)
                self.out.append((False, node.key, parent and parent.key, above, at, node.size, *numbers))
            else:
                self.hash(node)
                node.leaves += node.children == 0
                node.saved += (node.convs - 1) * node.size
                numbers = (node.conv_id, node.convs, node.children, node.leaves, node.saved, (node.sha or hashlib.sha256()).hexdigest())
                self.out.append((True, node.key, parent.key, None, at, node.size, *numbers))
            if parent:
                parent.conv_id = min(parent.conv_id, node.conv_id)
                parent.convs += node.convs
                parent.children += not split
                parent.leaves += node.leaves
                parent.saved += node.saved

    def finished(self) -> pa.RecordBatch:
        rows, self.out = self.out, []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(_KIND), _KIND)], schema=_KIND)


def _walk(skeleton: set[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (shard, path, conv_id, sizes) come sorted by the first three."""
        walk, at = Walk(skeleton), None
        for batch in batches:
            for shard, path, conv_id, sizes in zip(*[c.to_pylist() for c in batch.columns]):
                if shard != at:
                    walk.close(0)
                    walk.path, at = "", shard
                walk.add(path, sizes, conv_id)
                if len(walk.out) >= BLOCK:
                    yield walk.finished()
        walk.close(0)
        yield walk.finished()

    return run


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, ends_sha256) of blocks (key, first id, ids) sorted by the first two."""
    at, sha = None, None
    shape = pa.schema([("key", pa.binary()), ("ends_sha256", pa.string())])
    for batch in batches:
        done = []
        for key, _, ids in zip(*[c.to_pylist() for c in batch.columns]):
            if key != at:
                if sha:
                    done.append((at, sha.hexdigest()))
                at, sha = key, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(ids.encode())
        yield pa.RecordBatch.from_pylist([dict(zip(shape.names, x)) for x in done], shape)
    if sha:
        yield pa.RecordBatch.from_pylist([dict(zip(shape.names, (at, sha.hexdigest())))], shape)


def _whole_skeleton(parts: DataFrame, n: int) -> DataFrame:
    """The skeleton's nodes, from the partial numbers of all shards."""
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")]
    least = [F.min(c).alias(c) for c in ("parent_key", "above", "depth", "size", "conv_id")]
    nodes = written(parts.where("depth is not null").groupBy("key").agg(*least, *sums))
    children = nodes.where("parent_key is not null").groupBy("parent_key").agg(F.count(F.lit(1)).alias("more"))
    nodes = nodes.join(children.withColumnRenamed("parent_key", "key"), "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0)))
    own = nodes.select(
        F.explode("above").alias("key"), (F.col("n_children") == 0).cast("long").alias("own_leaves"),
        ((F.col("n_convs") - 1) * F.col("size")).alias("own_saved"),
    ).groupBy("key").agg(F.sum("own_leaves").alias("own_leaves"), F.sum("own_saved").alias("own_saved"))
    blocks = parts.where("depth is null").select("key", F.col("conv_id").alias("first"), "ends").repartition(n, "key").sortWithinPartitions("key", "first")
    ends = blocks.mapInArrow(tidy(_hashed), "key binary, ends_sha256 string")
    nodes = nodes.join(own, "key").join(ends, "key", "left")
    none = F.sha2(F.lit(""), 256)
    return nodes.select(
        "key", "parent_key", "depth", "conv_id", "n_convs", "n_children", (F.col("n_leaves") + F.col("own_leaves")).alias("n_leaves"),
        (F.col("saved") + F.col("own_saved")).alias("saved"), F.coalesce("ends_sha256", none).alias("ends_sha256"),
    )


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row per node of the trie of a table (conv_id, turns), conv_id being unique.

    conv_id is a node's smallest member, and parent_conv_id that of its parent (null at the root); n_convs counts members,
    n_children children, n_leaves the childless nodes of the subtree; saved_tokens sums (n_convs - 1) times the last
    turn's size over the subtree; ends_sha256 is the hash of the ids of the members that end here.
    """
    spark = turns.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    paths = written(turns.select(
        "conv_id", F.array_join(F.transform("turns", lambda t: t["digest"]), "").alias("path"), F.transform("turns", lambda t: t["size"]).alias("sizes")
    ))
    splitters = splitters_of(paths, n)
    shard = _shard(F.col("path"), F.col("conv_id"), splitters).alias("shard")
    rows = paths.select(shard, "path", "conv_id", "sizes").repartition(n, "shard").sortWithinPartitions("shard", "path", "conv_id")
    found = written(rows.mapInArrow(tidy(_walk(skeleton_of(splitters))), NODE))
    names = ["key", "parent_key", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved"]
    finished = found.where("whole").select(*names, F.col("ends").alias("ends_sha256"))
    nodes = written(finished.unionByName(_whole_skeleton(found.where("not whole"), n)))
    parents = nodes.where("n_children > 0").select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    inner = split_hot_join(nodes.where("parent_key is not null"), parents, ["parent_key"], F.col("key"))
    top = nodes.where("parent_key is null").withColumn("parent_conv_id", F.lit(None).cast("long"))
    return inner.unionByName(top).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), "ends_sha256"
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return prefix_trie(with_shared_heads(turns_of(rows)))


OP12_SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, {crc32_sql("CAST(conv_id AS VARCHAR)")} % {SHARED} AS h,
  list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS w FROM c GROUP BY conv_id),
re AS (SELECT o.conv_id, list_concat(list_slice(coalesce(b.w, []), 1, o.h), list_slice(o.w, o.h + 1, len(o.w))) AS w
  FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % {HEADS}),
p AS MATERIALIZED (SELECT conv_id, d, list_slice(w, 1, d) AS k, len(w) = d AS ends, CASE WHEN d = 0 THEN 0 ELSE length(w[d].text) END AS size
  FROM (SELECT conv_id, w, unnest(range(0, len(w) + 1)) AS d FROM re)),
n AS MATERIALIZED (SELECT min(conv_id) AS id, d, k, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS own,
  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM p GROUP BY d, k),
up AS MATERIALIZED (SELECT p.conv_id, p.d, n.id FROM p JOIN n ON p.d = n.d AND p.k = n.k),
kids AS (SELECT up.id, n.d - 1 AS d, count(*) AS n_children FROM n JOIN up ON up.conv_id = n.id AND up.d = n.d - 1 GROUP BY up.id, n.d),
full_n AS MATERIALIZED (SELECT n.id, n.d, own, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids ON n.id = kids.id AND n.d = kids.d),
sub AS (SELECT up.id, up.d, sum(x.own) AS saved, count(*) FILTER (WHERE x.n_children = 0) AS n_leaves
  FROM full_n x JOIN up ON up.conv_id = x.id AND up.d <= x.d GROUP BY up.id, up.d)
SELECT n.id AS conv_id, CAST(n.d AS BIGINT) AS depth, up.id AS parent_conv_id, n.n_convs, CAST(f.n_children AS BIGINT) AS n_children, sub.n_leaves,
  CAST(sub.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n JOIN full_n f ON n.id = f.id AND n.d = f.d JOIN sub ON n.id = sub.id AND n.d = sub.d LEFT JOIN up ON up.conv_id = n.id AND up.d = n.d - 1
"""
