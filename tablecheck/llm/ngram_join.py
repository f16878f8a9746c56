"""Jaccard join of word n-grams by groups of equal prefixes (operator 13).

A document's set holds its distinct shingles (A-Z lower-cased). Two documents link when their sets have a Jaccard
similarity of ``similarity`` or more; a document's component is everything it reaches over links.

Shingles have one order for all sets, the frequent ones last. The prefix of a set of n shingles is its first
n - ceil(similarity * n) + 1: sets that link share a shingle of their prefixes. Equal sets are one key. Keys of the
same size and prefix form a group, and the join works on groups: a list for each prefix shingle holds the groups that
have it; pairs of groups pass if their sizes and the shingles' places in both prefixes still allow the similarity. The
pairs that pass are expanded to their members, sifted by the parity bits of the sets (two sets differ in at least as many
shingles as bits), and confirmed on the exact sets.

Nothing pairs up a long list. A group of more than GROUP members enters lists member by member. A list longer than LIST is
dealt in parts of about PART groups where its shingle is known to be frequent; all are compared with the first of their part, and those
with the first of the list. If that leaves the list in several components, it is cut into pieces by
size, and every two pieces whose sizes are near enough are compared by size, component, parity bits and, where these
leave it open, exactly, in one task.
Which shingles count as frequent (FREQUENT at most, from counts in every task) bears on the work, never on the result.

Null texts and texts without words have an empty set, and link with nothing, not even one another. A very long text is a long
set; sets are made again from the texts of candidates, never kept for all. Ids may be null or repeated: repeated rows are equal
sets, and a component's id is its smallest id. Empty tables give empty results. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecheck.llm.common import LOWER_BYTES, UPPER, slices, table, tidy, written
from tablecheck.llm.components import components
from tablecheck.operators.skew import split_hot_join

PAIR, LONG, HEAD = 0, 1, 2
WORDS = 3
SIMILARITY = 0.9
# Members of a group, and groups of a list, that are paired up directly.
GROUP = 32
LIST = 128
# Bytes of sets in a piece of a long list; a tile has two pieces.
TILE = 8 << 20
# Frequent shingles that are told to every task, and the shingles a task counts before it drops its rarest.
FREQUENT = 1 << 18
COUNTED = 1 << 20
PARITY = 8
# Words of parity bits that tiles look at.
LONGEST = 1024
# Pairs of one key in a piece, for the exact comparison.
PIECE = 256
# Groups of a part of a list that is known to be long.
PART = 4096
# Bits of the filter that picks the texts of candidates.
FILTER = 1 << 24
SEED = 42
# Words a task remembers.
REMEMBER = 300_000
ODD = np.uint64(0x9E3779B97F4A7C15)


class Known(dict):
    """Hashes of words, made when first asked for."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return h


def shingle_sets(texts: list[bytes | None], known: Known, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    out = []
    for text in texts:
        w = text.translate(LOWER_BYTES).split() if text else []
        if not w:
            out.append(np.zeros(0, np.uint64))
            continue
        if len(known) > REMEMBER:
            known.clear()
        each = np.fromiter(map(known.__getitem__, w), np.uint64, len(w))
        n = min(words, len(w))
        h = np.full(len(w) - n + 1, n, np.uint64)
        for k in range(n):
            h = h * ODD + each[k : len(each) - n + 1 + k]
        h ^= h >> np.uint64(31)
        h.sort()
        first = np.ones(len(h), bool)
        np.not_equal(h[1:], h[:-1], out=first[1:])
        out.append(h[first])
    return out


def prefix_length(n: int, least: Fraction) -> int:
    return n - -(-n * least.numerator // least.denominator) + 1 if n else 0


def prefix_of(found: np.ndarray, frequent: np.ndarray, least: Fraction) -> np.ndarray:
    """The set's first shingles: by hash, then the frequent ones from the rarest on (``frequent`` has sorted hashes, and ranks)."""
    size = prefix_length(len(found), least)
    at = np.searchsorted(frequent[0], found)
    at[at == len(frequent[0])] = 0
    common = frequent[0][at] == found if len(frequent[0]) else np.zeros(len(found), bool)
    rare = found[~common][:size]
    if len(rare) == size:
        return rare
    ranks = frequent[1][at[common]]
    return np.concatenate([rare, found[common][np.argsort(ranks)][: size - len(rare)]])


def cuts_of(prefix: np.ndarray, frequent: np.ndarray, list_: int) -> np.ndarray:
    """Into how many parts the list of each shingle is dealt: 0 for those not known to be long."""
    if not len(frequent[0]):
        return np.zeros(len(prefix), np.int32)
    at = np.searchsorted(frequent[0], prefix)
    at[at == len(frequent[0])] = 0
    n = np.where(frequent[0][at] == prefix, frequent[2][at], 0).astype(np.int64)
    return np.where(n > list_, 1 + n // PART, 0).astype(np.int32)


def parity_of(found: np.ndarray) -> np.ndarray:
    """Words of bits, each the parity of how many of its shingles the set has; a bit for every two shingles, PARITY words at least.

    Halves of a longer one, xor-ed, are the bits of a set of half as many.
    """
    words = max(PARITY, 1 << (len(found) // 128).bit_length())
    bit = (found * ODD >> np.uint64(24)) & np.uint64(64 * words - 1)
    odd = np.bincount(bit.astype(np.int64), minlength=64 * words) % 2
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    return np.bitwise_xor.reduce(bits.reshape(-1, words), axis=0)


def _counts(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(shingle, n) of the shingles that a task met in more than one text; past COUNTED of them the rarest go."""
        known = Known()
        keys, n, least = np.zeros(0, np.uint64), np.zeros(0, np.int64), 1
        for batch in batches:
            for part in slices(batch.column(0)):
                sets = shingle_sets(part, known, words)
                new = np.concatenate([keys, *sets])
                weight = np.concatenate([n, np.ones(len(new) - len(n), np.int64)])
                keys, at = np.unique(new, return_inverse=True)
                n = np.bincount(at, weight, len(keys)).astype(np.int64)
                while len(keys) > COUNTED:
                    keep = n > least
                    least += not keep.sum() or keep.sum() > COUNTED
                    keys, n = keys[keep], n[keep]
        keep = n > max(1, least - 1)
        yield pa.RecordBatch.from_arrays([pa.array(keys[keep].view(np.int64)), pa.array(n[keep])], names=["shingle", "n"])

    return run


def frequent_shingles(docs: DataFrame, text: str, words: int, most: int = FREQUENT) -> np.ndarray:
    """Sorted hashes, their ranks by count, and the counts of the most frequent shingles that the tasks report."""
    rows = docs.select(F.col(text).cast("string")).mapInArrow(tidy(_counts(words)), "shingle long, n long")
    total = rows.groupBy("shingle").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "shingle").limit(most).toArrow()
    found = total.column("shingle").to_numpy().view(np.uint64)
    ranks = np.arange(len(found))[::-1]
    order = np.argsort(found)
    return np.array([found[order], ranks[order].astype(np.uint64), total.column("n").to_numpy()[order].astype(np.uint64)])


SKETCH = "n long, mark long, prefix array<long>, cuts array<int>, parity array<long>"


def sketch_column(text: Column, words: int, frequent: np.ndarray, least: Fraction, list_: int = LIST) -> Column:
    """Struct of the set's size, hash (mark), prefix, cuts of the prefix shingles' lists, and parity bits."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = Known()
        for texts in batches:
            n, marks, prefixes, parities = [], [], [], []
            for part in slices(texts):
                for found in shingle_sets(part, known, words):
                    n.append(len(found))
                    marks.append(xxhash.xxh64_intdigest(found.tobytes(), SEED))
                    prefixes.append(prefix_of(found, frequent, least))
                    parities.append(parity_of(found))
            ends = pa.array(np.cumsum([0, *map(len, prefixes)]), pa.int32())
            flat = np.concatenate([np.zeros(0, np.uint64), *prefixes])
            bits = np.concatenate([np.zeros(0, np.int64), *parities])
            stops = pa.array(np.cumsum([0, *map(len, parities)]), pa.int32())
            yield pa.StructArray.from_arrays([
                pa.array(n, pa.int64()), pa.array(np.array(marks, np.uint64).view(np.int64)),
                pa.ListArray.from_arrays(ends, pa.array(flat.view(np.int64))),
                pa.ListArray.from_arrays(ends, pa.array(cuts_of(flat, frequent, list_))),
                pa.ListArray.from_arrays(stops, pa.array(bits)),
            ], names=["n", "mark", "prefix", "cuts", "parity"])

    return F.arrow_udf(tidy(run), SKETCH).asNondeterministic()(text.cast("string"))


def _lists(least: Fraction, list_: int):
    p, q = least.numerator, least.denominator
    names = ["kind", "a", "b"]

    def short(rows: np.ndarray) -> np.ndarray:
        """The pairs of groups of rows (shingle, part, n, at, group) whose lists are short."""
        out = [np.zeros((0, 2), np.int64)]
        shingle, _, n, at, group = rows
        for k in range(1, len(shingle)):
            a = np.flatnonzero(shingle[k:] == shingle[:-k])
            if not len(a):
                break
            b = a + k
            # of a pair that links, what follows its first shared shingle suffices
            rest = np.minimum(n[a] - at[a], n[b] - at[b])
            near = (np.minimum(n[a], n[b]) * q >= p * np.maximum(n[a], n[b])) & (rest * (p + q) >= p * (n[a] + n[b]))
            a, b = group[a[near]], group[b[near]]
            out.append(np.column_stack([np.minimum(a, b), np.maximum(a, b)]))
        return np.unique(np.concatenate(out), axis=0)

    def batch(kind: int, pairs: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), kind, np.int32)), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (shingle, part, n, at, group) come sorted by the first two; parts above 0 are of lists known to be long.

        PAIR rows are pairs of groups; LONG rows (shingle, group) the members of long lists, and HEAD rows (shingle, group)
        the first of each of their parts, with which all others of the part are paired.
        """
        held, head = np.zeros((5, 0), np.int64), None  # head: (shingle, part, group) of the long part that goes on
        for one in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in one.columns])
            rows = np.concatenate([held, rows], axis=1)
            edge = np.flatnonzero(np.any(rows[:2, 1:] != rows[:2, :-1], axis=0)) + 1
            starts = np.concatenate([[0], edge])[: rows.shape[1]]
            size = np.diff(np.concatenate([starts, [rows.shape[1]]]))
            last = len(size) - 1
            long = (rows[1, starts] > 0) | (size > list_)
            if head and len(size) and tuple(rows[:2, 0]) == head[:2]:
                long[0] = True
            done = ~long
            if last >= 0 and not long[last]:
                done[last] = False  # the last list may go on
            yield batch(PAIR, short(rows[:, np.repeat(done, size)]))
            for k in np.flatnonzero(long):
                shingle, part, _, _, group = rows[:, starts[k] : starts[k] + size[k]]
                at = (int(shingle[0]), int(part[0]))
                if not head or head[:2] != at:
                    head = (*at, int(group[0]))
                    yield batch(HEAD, np.array([[at[0], head[2]]], np.int64))
                yield batch(LONG, np.column_stack([shingle, group]))
                others = group[group != head[2]]
                first = np.full(len(others), head[2])
                yield batch(PAIR, np.column_stack([np.minimum(first, others), np.maximum(first, others)]))
            held = rows[:, starts[last] :] if last >= 0 and not long[last] else np.zeros((5, 0), np.int64)
        yield batch(PAIR, short(held))

    return run


def _sift(least: Fraction):
    p, q = least.numerator, least.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Those pairs (a, b) of rows (a, b, n, m, bits, bits) whose parity bits leave them the similarity."""
        for batch in batches:
            # |A xor B| = n + m - 2 |A and B|, and |A and B| is at least p (n + m) / (p + q)
            most = (batch.column(2).to_numpy() + batch.column(3).to_numpy()) * (q - p) // (p + q)
            differ = np.zeros(len(batch), np.int64)
            sides = [batch.column(k) for k in (4, 5)]
            width = np.array([np.diff(x.offsets.to_numpy()) for x in sides]).reshape(2, -1)
            for w in np.unique(width.min(axis=0)):
                at = np.flatnonzero(width.min(axis=0) == w)
                x, y = (np.array([folded(v.values.to_numpy(), w) for v in side.take(pa.array(at))]) for side in sides)
                differ[at] = np.bitwise_count((x ^ y).view(np.uint64)).sum(axis=1, dtype=np.int64)
            yield batch.select([0, 1]).filter(pa.array(differ <= most))

    return run


def sifted(pairs: DataFrame, least: Fraction) -> DataFrame:
    """Different pairs (a < b) of marks, of a table (mark_a, n_a, parity_a, mark_b, n_b, parity_b), that sizes and parity bits leave."""
    near = F.least("n_a", "n_b") * least.denominator >= F.greatest("n_a", "n_b") * least.numerator
    rows = pairs.where(near).select(
        F.least("mark_a", "mark_b").alias("a"), F.greatest("mark_a", "mark_b").alias("b"), "n_a", "n_b", "parity_a", "parity_b"
    )
    return written(rows.mapInArrow(tidy(_sift(least)), "a long, b long").distinct())


def _confirm(least: Fraction):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Those pairs (a, b) of rows (a, b, set) whose sets are similar enough; the row without b comes first and has a's own set."""
        at, mine = None, np.zeros(0, np.uint64)
        for batch in batches:
            keep = []
            for a, b, s in zip(*batch.columns):
                x = np.frombuffer(s.as_py(), np.uint64)
                if not b.is_valid:
                    at, mine = a.as_py(), x
                    keep.append(False)
                    continue
                assert at == a.as_py()
                both = len(np.intersect1d(mine, x, assume_unique=True))
                keep.append(both * least.denominator >= least.numerator * (len(mine) + len(x) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def similar(pairs: DataFrame, sets: DataFrame, least: Fraction) -> DataFrame:
    """Those of the different pairs (a, b) of marks whose sets (mark, shingles) are similar enough.

    A set travels once for each PIECE pairs it is the first of, and once for each pair it is the second of.
    """
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    many = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PIECE).select("a", F.ceil(F.col("n") / PIECE).alias("pieces"))
    cut = pairs.join(many, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("pieces", F.lit(1))).alias("piece"))
    own = cut.select("a", "piece").distinct().join(sets.withColumnRenamed("mark", "a"), "a")
    own = own.select("a", "piece", F.lit(None).cast("long").alias("b"), "shingles")
    other = cut.join(sets.withColumnRenamed("mark", "b"), "b").select("a", "piece", "b", "shingles")
    rows = own.unionByName(other).repartition(n, "a", "piece").sortWithinPartitions("a", "piece", F.col("b").asc_nulls_first())
    return rows.select("a", "b", "shingles").mapInArrow(tidy(_confirm(least)), "a long, b long")


def connecting(pairs: DataFrame, sets: DataFrame, least: Fraction) -> DataFrame:
    """Links among the pairs that connect all that are similar enough: each mark is compared with the smallest it
    is paired with, and then the pairs of different components are compared."""
    first = written(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    found = written(similar(first, sets, least))
    roots = components(found).toDF("mark", "root")
    side = lambda c: roots.select(F.col("mark").alias(c), F.col("root").alias(f"root_{c}"))
    rest = pairs.join(first, ["a", "b"], "left_anti").join(side("a"), "a", "left").join(side("b"), "b", "left")
    rest = rest.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")
    return written(found.unionByName(similar(written(rest), sets, least)))


def tile_links(marks: list[int], own: list[str], roots: list[int], sets: list[np.ndarray], between: bool, least: Fraction) -> list[tuple[int, int]]:
    """Links that connect the similar ones of a tile beyond their ``roots``, the components they are in already; only
    those of different ``own`` are compared if ``between``. Exact sets are compared where sizes and parity bits allow it."""
    p, q = least.numerator, least.denominator
    bits = [parity_of(x) for x in sets]
    width = min(LONGEST, *map(len, bits))
    bits = np.array([folded(x, width) for x in bits])
    n, root = np.array([len(x) for x in sets]), np.unique(roots, return_inverse=True)[1]
    side = np.unique(own, return_inverse=True)[1]
    out = []
    for k in range(1, len(sets)):
        near = (root[:k] != root[k]) & (np.minimum(n[:k], n[k]) * q >= p * np.maximum(n[:k], n[k]))
        if between:
            near &= side[:k] != side[k]
        at = np.flatnonzero(near)
        differ = np.bitwise_count((bits[at] ^ bits[k]).view(np.uint64)).sum(axis=1, dtype=np.int64)
        for m in at[differ * (p + q) <= (n[at] + n[k]) * (q - p)]:
            if root[m] != root[k]:
                both = len(np.intersect1d(sets[m], sets[k], assume_unique=True))
                if both * q >= p * (n[m] + n[k] - both):
                    out.append((marks[m], marks[k]))
                    root[root == root[k]] = root[m]
    return out


def _tiles(least: Fraction):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links of the tiles of rows (list, i, j, own, mark, root, shingles), sorted by the first three."""

        def found(rows: list[tuple]) -> pa.RecordBatch:
            links = []
            if len(rows) > 1:
                _, i, j, own, marks, roots, sets = zip(*rows)
                links = tile_links(marks, own, roots, sets, i[0] != j[0], least)
            return pa.RecordBatch.from_arrays([pa.array([x[c] for x in links], pa.int64()) for c in (0, 1)], names=["a", "b"])

        held: list[tuple] = []
        for batch in batches:
            sets = [np.frombuffer(x.as_py(), np.uint64) for x in batch.column(6)]
            for row in zip(*[c.to_pylist() for c in batch.columns[:6]], sets):
                if held and held[0][:3] != row[:3]:
                    yield found(held)
                    held = []
                held.append(row)
        yield found(held)

    return run


def long_links(members: DataFrame, of: DataFrame, roots: DataFrame, sets_of, least: Fraction, tile: int = TILE) -> DataFrame:
    """(a, b): links that connect the marks of long lists (list, mark) beyond their components; ``of`` has (mark, n).

    A list in several components is cut by size class, and a class into pieces of about ``tile`` bytes of sets; two pieces of equal or
    neighbouring classes are one tile. A tile returns a spanning forest of its links.
    """
    labelled = members.join(roots, "mark", "left").withColumn("root", F.coalesce("root", "mark"))
    several = labelled.groupBy("list").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("list")
    step = max(1e-6, 1.0001 * float(np.log(float(1 / least))))
    open_ = labelled.join(several, "list").join(of, "mark").withColumn("class", F.floor(F.log(F.greatest("n", F.lit(1)).cast("double")) / step))
    open_ = written(open_.select("list", "mark", "root", "n", "class"))
    cuts = open_.groupBy("list", "class").agg(F.ceil((F.sum("n") * 8 + 1) / tile).alias("cuts"))
    # two sets that link have equal or neighbouring classes
    near = cuts.alias("x").join(cuts.alias("y"), "list").where("abs(x.class - y.class) <= 1")
    piece = lambda s: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(f"{s}.cuts") - 1))
    near = near.select("list", F.col("x.class").alias("class"), F.col("y.class").alias("other"), F.col("x.cuts").alias("cuts"), piece("y").alias("part"))
    own = F.pmod(F.xxhash64("mark"), F.col("cuts"))
    tiles = open_.join(near, ["list", "class"]).withColumns({
        "x": F.concat_ws(":", F.col("class"), own), "y": F.concat_ws(":", F.col("other"), F.col("part"))
    })
    tiles = tiles.select("list", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), F.col("x").alias("own"), "mark", "root")
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tiles = tiles.join(sets_of(open_.select("mark").distinct()), "mark").select("list", "i", "j", "own", "mark", "root", "shingles")
    tiles = tiles.repartition(n, "list", "i", "j").sortWithinPartitions("list", "i", "j")
    return written(tiles.mapInArrow(tidy(_tiles(least)), "a long, b long"))


def with_sizes(pairs: DataFrame, of: DataFrame) -> DataFrame:
    """Pairs (a, b) of marks with what ``sifted`` looks at."""
    by = lambda s: of.select(F.col("mark").alias(s), F.col("n").alias(f"n_{s}"), F.col("parity").alias(f"parity_{s}"))
    return pairs.join(by("a"), "a").join(by("b"), "b").withColumnsRenamed({"a": "mark_a", "b": "mark_b"})


def links(keys: DataFrame, sets_of, least: Fraction, group: int = GROUP, list_: int = LIST, tile: int = TILE) -> DataFrame:
    """(a, b): links that connect all keys of a table (mark, n, prefix, cuts, parity) that are similar enough.

    ``sets_of`` gives a table (mark, shingles) for a table of marks.
    """
    spark = keys.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hashed = keys.withColumn("same", F.xxhash64("n", "prefix"))
    sizes = hashed.groupBy("same").agg(F.count(F.lit(1)).alias("members"))
    large = sizes.where(F.col("members") > group).select("same", F.lit(True).alias("large"))
    members = hashed.select("same", "mark", "n", "parity").join(large, "same", "left")
    members = written(members.select(F.when(F.col("large"), F.xxhash64("same", "mark")).otherwise(F.col("same")).alias("group"), "mark", "n", "parity"))
    # one row for each group and prefix shingle
    first = members.groupBy("group").agg(F.min("mark").alias("mark"))
    heads = hashed.join(first, "mark").select("group", "n", F.posexplode(F.arrays_zip("prefix", "cuts")).alias("at", "x"))
    part = F.when(F.col("x.cuts") > 0, 1 + F.pmod(F.xxhash64("group"), F.col("x.cuts"))).otherwise(0).cast("int")
    entries = heads.select(F.col("x.prefix").alias("shingle"), part.alias("part"), "n", "at", "group")
    entries = entries.repartition(n, "shingle", "part").sortWithinPartitions("shingle", "part")
    listed = written(entries.mapInArrow(tidy(_lists(least, list_)), "kind int, a long, b long"))
    heads = listed.where(F.col("kind") == HEAD).select(F.col("a").alias("list"), "b")
    tops = heads.groupBy("list").agg(F.min("b").alias("top"))
    stars = heads.join(tops, "list").where("top <> b").select(F.least("top", "b").alias("a"), F.greatest("top", "b").alias("b"))
    pairs = written(listed.where(F.col("kind") == PAIR).select("a", "b").unionByName(stars).distinct())
    # expanded to members; those of one group are compared with each other as well
    of = members.select("group", "mark", "n", "parity")
    side = lambda s: of.toDF(s, f"mark_{s}", f"n_{s}", f"parity_{s}")
    apart = pairs.join(side("a"), "a").join(side("b"), "b")
    within = side("a").join(side("b"), F.col("a") == F.col("b")).where("mark_a < mark_b")
    marks = sifted(apart.unionByName(within), least)
    found = connecting(marks, sets_of(ends(marks)), least)
    long = listed.where(F.col("kind") == LONG).select(F.col("a").alias("list"), F.col("b").alias("group"))
    if long.isEmpty():
        return found
    roots = written(components(found).toDF("mark", "root"))
    in_long = long.join(members.select("group", "mark"), "group").select("list", "mark")
    return found.unionByName(long_links(in_long, members.select("mark", "n"), roots, sets_of, least, tile))


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("mark")).union(pairs.select("b")).distinct()


def candidate_sets(docs: DataFrame, rows: DataFrame, words: int):
    """A function that gives a table (mark, shingles) for a table of marks, of documents (doc_id, text) with their ``rows``
    (doc_id, text_hash, mark)."""

    def sets_of(marks: DataFrame) -> DataFrame:
        """The sets of the marks, made from one text of each; a filter of bits picks the texts, and the marks decide."""
        place = lambda h, id: F.pmod(F.xxhash64(h, id), F.lit(FILTER))
        one = rows.join(marks, "mark", "left_semi").groupBy("mark").agg(F.min(F.struct("text_hash", "doc_id")).alias("r"))
        bits = one.select(place(F.col("r.text_hash"), F.col("r.doc_id")).alias("at"))
        bits = bits.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at % 64 AS INT))")).alias("bits"))
        held = bits.toArrow()  # at most FILTER / 64 rows
        chosen = np.zeros(FILTER // 64, np.uint64)
        chosen[held.column("word").to_numpy()] = held.column("bits").to_numpy().view(np.uint64)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = Known()
            for batch in batches:
                at = batch.column(1).to_numpy().astype(np.uint64)
                picked = chosen[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)
                for part in slices(batch.column(0).filter(pa.array(picked.astype(bool)))):
                    sets = [s.tobytes() for s in shingle_sets(part, known, words)]
                    marks = np.array([xxhash.xxh64_intdigest(s, SEED) for s in sets], np.uint64).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(marks), pa.array(sets, pa.binary())], names=["mark", "shingles"])

        found = docs.select("text", place(F.xxhash64("text"), F.col("doc_id")).alias("at")).mapInArrow(tidy(run), "mark long, shingles binary")
        return written(found.join(marks, "mark", "left_semi").dropDuplicates(["mark"]))

    return sets_of


def ngram_join(
    docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = WORDS, similarity: float = SIMILARITY,
    group: int = GROUP, list_: int = LIST, tile: int = TILE, frequent: int = FREQUENT,
) -> DataFrame:
    """One row per document: its id, n_shingles, mark (the set's hash) and component_id."""
    least = Fraction(str(similarity))
    docs = docs.select(F.col(id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    ranks = frequent_shingles(docs, "text", words, frequent)
    sketch = sketch_column(F.col("text"), words, ranks, least, list_).alias("s")
    rows = written(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), sketch).select("doc_id", "text_hash", "s.*"))
    filled = rows.where("n > 0")
    keys = written(filled.select("mark", "n", "prefix", "cuts", "parity").dropDuplicates(["mark"]))

    found = links(keys, candidate_sets(docs, filled, words), least, group, list_, tile)
    roots = components(found).toDF("mark", "root")
    own = filled.groupBy("mark").agg(F.min("doc_id").alias("least")).join(roots, "mark", "left").withColumn("root", F.coalesce("root", "mark"))
    own = written(own)
    of = own.join(own.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("mark", "component_id")
    known = split_hot_join(filled.select("doc_id", "n", "mark"), of, ["mark"], F.coalesce("doc_id", F.lit(0)))
    alone = rows.where("n = 0").select("doc_id", "n", "mark", F.col("doc_id").alias("component_id"))
    return known.select("doc_id", "n", "mark", "component_id").unionByName(alone).withColumnRenamed("n", "n_shingles")


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


_LIST = f"coalesce(regexp_extract_all(translate(text, '{UPPER}', '{UPPER.lower()}'), '[^\\x20\\x09-\\x0D]+'), [])"
OP13_SQL = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_LIST} AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT r, array_to_string(list_slice(w, k, k + least(len(w), {WORDS}) - 1), ' ') AS s
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - {WORDS} + 1, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT r, count(*) AS n FROM s GROUP BY r),
common AS (SELECT x.r AS a, y.r AS b, count(*) AS k FROM s x JOIN s y ON x.s = y.s AND x.r <> y.r GROUP BY x.r, y.r),
l AS MATERIALIZED (SELECT a, b FROM common JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
reach AS (SELECT r AS a, r AS b FROM d UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (r) JOIN (SELECT a AS r, min(o.doc_id) AS component_id FROM reach JOIN d o ON reach.b = o.r GROUP BY a) c USING (r)
"""
