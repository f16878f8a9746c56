"""SimHash near-duplicates, found with BK-trees (operator 3).

A text becomes a 64-bit fingerprint of its word shingles. Texts link when their fingerprints differ in
at most ``radius`` bits, and a document's component is everything it reaches over links.

Fingerprints are dealt into shards: the 64 bits are cut into radius + 2 blocks, and every choice of two
blocks is a table whose shards hold the fingerprints that agree on both. Two fingerprints within the
radius differ in at most ``radius`` blocks, so they share at least one shard, and no link is lost. Each
shard is searched with a BK-tree: a node's children are keyed by their Hamming distance to it, and a
search follows only the edges within the radius of its own distance. A task meets only the trees of
its shards, and none grows past TREE_LIMIT: a fuller shard is cut into pieces, and each pair of pieces
is a task of its own, so a search still meets every fingerprint. Only distinct fingerprints are
searched, and of the links in a tree only a spanning forest is handed on.

Null and empty texts have fingerprint 0, which links like any other. Ids may be null or repeated: a
component's id is its smallest id, null if it has none. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecheck.llm.common import LOWER_BYTES, free_name, slices, table, tidy, written
from tablecheck.llm.components import components

WORDS = 3
RADIUS = 3
SEED = 42
TREE_LIMIT = 2000
# Shingles counted at a time.
SHINGLES = 1 << 18


def fingerprint(text: bytes | None, words: int = WORDS) -> int:
    """Unsigned fingerprint: a bit is set if it is set in over half of the shingles' hashes."""
    w = text.translate(LOWER_BYTES).split() if text else []
    if not w:
        return 0
    shingles = map(b" ".join, zip(*[w[k:] for k in range(words)])) if len(w) >= words else [b" ".join(w)]
    hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), SHINGLES):
        part = hashes[at : at + SHINGLES].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint_column(text: Column, words: int = WORDS) -> Column:
    """The fingerprint's bits as a signed long."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            marks = [fingerprint(t, words) for part in slices(texts) for t in part]
            yield pa.array(np.array(marks, dtype=np.uint64).view(np.int64), pa.int64())

    return F.arrow_udf(tidy(run), "long").asNondeterministic()(text.cast("string"))


class BKTree:
    def __init__(self):
        self.marks: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, mark: int) -> int:
        """The node of the mark."""
        at = 0
        while self.marks:
            d = (self.marks[at] ^ mark).bit_count()
            if d == 0:
                return at
            below = self.children[at].get(d)
            if below is None:
                self.children[at][d] = len(self.marks)
                break
            at = below
        self.marks.append(mark)
        self.children.append({})
        return len(self.marks) - 1

    def near(self, mark: int, radius: int) -> list[int]:
        """Nodes within the radius."""
        found, todo = [], [0] if self.marks else []
        while todo:
            at = todo.pop()
            d = (self.marks[at] ^ mark).bit_count()
            if d <= radius:
                found.append(at)
            todo += [c for k, c in self.children[at].items() if d - radius <= k <= d + radius]
        return found


def tree_links(left: list[int], right: list[int] | None, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links inside ``left``, or, given ``right``, of those between the two."""
    root = {m: m for m in (*left, *(right or ()))}

    def top(m: int) -> int:
        while root[m] != m:
            root[m] = root[root[m]]
            m = root[m]
        return m

    out, tree = [], BKTree()
    for m in right or ():
        tree.add(m)
    for m in left:
        for at in tree.near(m, radius):
            a, b = top(m), top(tree.marks[at])
            if a != b:
                root[a] = b
                out.append((m, tree.marks[at]))
        if right is None:
            tree.add(m)
    return out


def shards(mark: Column, radius: int = RADIUS) -> Column:
    """The shards of a fingerprint: one for each choice of two of its blocks."""
    blocks = radius + 2
    edges = [64 * k // blocks for k in range(blocks + 1)]
    width = [b - a for a, b in zip(edges, edges[1:])]
    if 2 * max(width) > 48:
        raise ValueError("the radius must be 1 or more")
    cut = [F.shiftrightunsigned(mark, a).bitwiseAND(F.lit((1 << w) - 1).cast("long")) for a, w in zip(edges, width)]
    pairs = list(combinations(range(blocks), 2))
    return F.array(*[
        F.lit(t).cast("long") * F.lit(1 << 50).cast("long") + cut[i] * F.lit(1 << width[j]).cast("long") + cut[j]
        for t, (i, j) in enumerate(pairs)
    ])


def _search(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (shard, i, j, own, mark) come sorted by the first three; ``own`` is the row's piece."""

        def links(rows: np.ndarray) -> list[tuple[int, int]]:
            i, j = rows[0, 1], rows[0, 2]
            marks = rows[:, 4].view(np.uint64)
            if i == j:
                return tree_links(marks.tolist(), None, radius)
            return tree_links(marks[rows[:, 3] == i].tolist(), marks[rows[:, 3] == j].tolist(), radius)

        def out(found: list[tuple[int, int]]) -> pa.RecordBatch:
            pairs = np.array(found, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        held = np.zeros((0, 5), np.int64)
        for batch in batches:
            rows = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]).astype(np.int64)
            held = np.vstack([held, rows])
            starts = np.flatnonzero(np.any(held[1:, :3] != held[:-1, :3], axis=1)) + 1
            ends = np.concatenate([[0], starts])  # the last group may go on
            size = np.diff(ends)
            found = []
            for k in np.flatnonzero(size > 1):
                found += links(held[ends[k] : ends[k + 1]])
            held = held[ends[-1] :]
            yield out(found)
        if len(held) > 1:
            yield out(links(held))

    return run


def links(marks: DataFrame, radius: int = RADIUS, limit: int = TREE_LIMIT) -> DataFrame:
    """(a, b): links that connect all of the distinct fingerprints in column ``mark`` that are within the radius."""
    dealt = marks.select("mark", F.explode(shards(F.col("mark"), radius)).alias("shard"))
    full = dealt.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit)
    pieces = full.select("shard", F.ceil(F.col("n") / limit).cast("int").alias("pieces"))
    own = F.pmod(F.xxhash64("mark"), F.col("pieces")).cast("int")
    dealt = dealt.join(pieces, "shard", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1))).withColumn("own", own)
    other = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("other")
    tiles = dealt.select("shard", "mark", "own", other).select(
        "shard", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "mark"
    )
    n = int(marks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tiles = tiles.repartition(n, "shard", "i", "j").sortWithinPartitions("shard", "i", "j")
    return tiles.mapInArrow(tidy(_search(radius)), "a long, b long")


def near_duplicates(
    docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = WORDS, radius: int = RADIUS, limit: int = TREE_LIMIT
) -> DataFrame:
    """One row per document: its id, text_hash, fingerprint (long), root (the component's smallest
    fingerprint as a long) and component_id."""
    rows = written(docs.select(
        F.col(id).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), fingerprint_column(F.col(text), words).alias("mark")
    ))
    groups = written(rows.groupBy("mark").agg(F.min("doc_id").alias("least")))
    roots = components(links(groups, radius, limit))
    linked = roots.union(roots.select(F.col("b"), F.col("b")).distinct()).toDF("mark", "root")
    linked = linked.join(groups, "mark")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    known = groups.join(linked.select("mark", "root").join(least, "root"), "mark", "left").select(
        "mark", F.coalesce("root", "mark").alias("root"), F.coalesce("component_id", "least").alias("component_id")
    )
    return rows.join(known, "mark").select("doc_id", "text_hash", F.col("mark").alias("fingerprint"), "root", "component_id")


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The documents with their columns as they were, one of each component: that of the smallest id,
    and of rows with that id one of the smallest text hash."""
    return one_of_each(docs, near_duplicates(docs, id, text, **how), id, text)


def one_of_each(docs: DataFrame, found: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component of a table (doc_id, text_hash, root, component_id)."""
    first = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    chosen = written(first.groupBy("root").agg(F.min("text_hash").alias("text_hash"), F.min("doc_id").alias("doc_id")).select("text_hash", "doc_id"))
    h, c, d = (free_name(docs, x) for x in ("text_hash", "chosen_hash", "chosen_id"))
    same = (F.col(h) == F.col(c)) & F.col(id).eqNullSafe(F.col(d))
    kept = docs.withColumn(h, F.xxhash64(F.col(text))).join(chosen.toDF(c, d), same, "left_semi")
    twice = first.join(chosen.toDF("text_hash", "chosen_id"), "text_hash").where(F.col("doc_id").eqNullSafe(F.col("chosen_id")))
    again = written(twice.groupBy("text_hash", "doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("text_hash", "doc_id").toDF(c, d))
    if again.isEmpty():
        return kept.drop(h)
    one = kept.join(again, same, "left_semi").dropDuplicates([h, id])
    return kept.join(again, same, "left_anti").unionByName(one).drop(h)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    mark = F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint")
    return found.select("doc_id", mark, "component_id")
