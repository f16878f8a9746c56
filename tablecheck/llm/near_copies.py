"""Near copies by the exact Jaccard similarity of word shingles (stage near_dedup of the pipeline).

Texts link when the sets of their shingles of ``words`` words (A-Z lower-cased) have a Jaccard similarity
of ``similarity`` or more, and a document's component is everything it reaches over links.

Candidates are found as in ``simhash``: a 64-bit fingerprint of each set, and BK-trees over the shards of the fingerprints,
which miss no two within ``simhash.RADIUS`` bits. Sets of similarity 0.8 may differ in more bits than trees can prune by, so
seeded MinHashes find candidates too: BANDS bands of ROWS hashes each. Two texts of similarity s share no
band with probability (1 - s^ROWS)^BANDS: 5e-8 at 0.8, and less above. Candidates are sifted by size and parity
bits, and every one left is confirmed with the exact sets. Texts with equal sets are one key, so exact copies cost
nothing. In a band all keys are compared with the smallest first; a band whose keys are still in different
components after that is cut into tiles by size and bytes, whose keys are compared by size, component, parity bits and, where
these leave it open, exactly. Only sizes, fingerprints, bands and bits are kept of every text; sets are made again from the texts of candidates. Of close fingerprints a spanning forest is told by the trees, whose ends are candidates.

Texts without words have the empty set, and are copies of each other; a text of fewer words is one shingle. A very long
text is a long set, and its comparison follows its length. Ids may be null or repeated, as in ``simhash``. Empty tables
give empty results. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecheck.llm import simhash
from tablecheck.llm.common import slices, tidy, written
from tablecheck.llm.components import components
from tablecheck.llm.ngram_join import TILE, Known, candidate_sets, connecting, ends, long_links, parity_of, shingle_sets, sifted, with_sizes
from tablecheck.llm.simhash import one_of_each

WORDS = 5
SIMILARITY = 0.8
BANDS = 32
ROWS = 4
SEED = 42
# Shingles hashed at a time.
SHINGLES = 1 << 12
ODD = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    return shingle_sets([text], Known(), words)[0]


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    x = np.random.default_rng(SEED).integers(0, 1 << 63, (2, n), dtype=np.uint64)
    return x[0, :, None] * np.uint64(2) + np.uint64(1), x[1, :, None]


def band_keys(found: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A hash of each band's MinHashes and its number."""
    factor, shift = _seeds(bands * rows)
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), SHINGLES):
        np.minimum(least, (found[None, at : at + SHINGLES] * factor + shift).min(axis=1), out=least)
    out = np.arange(bands, dtype=np.uint64)
    for k in range(rows):
        out = (out ^ least[k::rows]) * ODD
        out ^= out >> np.uint64(29)
    return out


def set_fingerprint(found: np.ndarray) -> int:
    """Unsigned SimHash of a set: a bit is set if it is set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(found), SHINGLES):
        part = found[at : at + SHINGLES].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(found), bitorder="little").view("<u8")[0])


def sketch_column(text: Column, words: int = WORDS) -> Column:
    """Struct of the set's size, hash (mark), fingerprint, band keys and parity bits."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = Known()
        for texts in batches:
            n, marks, prints, bands, bits = [], [], [], [], []
            for part in slices(texts):
                for found in shingle_sets(part, known, words):
                    n.append(len(found))
                    marks.append(xxhash.xxh64_intdigest(found.tobytes(), SEED))
                    prints.append(set_fingerprint(found))
                    bands.append(band_keys(found))
                    bits.append(parity_of(found))
            flat = np.concatenate([np.zeros(0, np.uint64), *bands]).view(np.int64)
            keys = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * BANDS, pa.int32()), pa.array(flat))
            stops = pa.array(np.cumsum([0, *map(len, bits)]), pa.int32())
            parity = pa.ListArray.from_arrays(stops, pa.array(np.concatenate([np.zeros(0, np.int64), *bits])))
            mark, fingerprint = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in (marks, prints))
            columns = [pa.array(n, pa.int64()), mark, fingerprint, keys, parity]
            yield pa.StructArray.from_arrays(columns, names=["n", "mark", "fingerprint", "bands", "parity"])

    return F.arrow_udf(tidy(run), "n long, mark long, fingerprint long, bands array<long>, parity array<long>").asNondeterministic()(text.cast("string"))


def close_prints(keys: DataFrame, radius: int = simhash.RADIUS) -> DataFrame:
    """(a, b): keys of one fingerprint, each with the smallest, and the smallest of fingerprints that the BK-trees link."""
    groups = written(keys.groupBy("fingerprint").agg(F.min("mark").alias("least")))
    trees = simhash.links(groups.select(F.col("fingerprint").alias("mark")), radius)
    side = lambda c, out: groups.select(F.col("fingerprint").alias(c), F.col("least").alias(out))
    near = trees.toDF("x", "y").join(side("x", "a"), "x").join(side("y", "b"), "y").select("a", "b")
    same = keys.join(groups, "fingerprint").where("mark <> least").select(F.col("least").alias("a"), F.col("mark").alias("b"))
    return near.unionByName(same)


def links(keys: DataFrame, sets_of, similarity: float = SIMILARITY, tile: int = TILE) -> DataFrame:
    """(a, b): links that connect all keys of a table (mark, n, fingerprint, bands, parity) that are similar enough.

    ``sets_of`` gives a table (mark, shingles) for a table of marks.
    """
    least = Fraction(str(similarity))
    dealt = keys.select("mark", F.explode("bands").alias("list"))
    first = dealt.groupBy("list").agg(F.min("mark").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select("list", "a")
    members = written(dealt.join(first, "list"))
    of = keys.select("mark", "n", "parity")
    star = members.where("mark <> a").select("a", F.col("mark").alias("b"))
    star = star.unionByName(close_prints(keys)).distinct()
    pairs = sifted(with_sizes(star, of), least)
    found = connecting(pairs, sets_of(ends(pairs)), least)
    # A band's keys that are in different components may still link to one another.
    roots = written(components(found).toDF("mark", "root"))
    return found.unionByName(long_links(members.select("list", "mark"), keys.select("mark", "n"), roots, sets_of, least, tile))


def near_copies(
    docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = WORDS, similarity: float = SIMILARITY, tile: int = TILE
) -> DataFrame:
    """One row per document: its id, text_hash, root (the component's smallest mark) and component_id (its smallest id)."""
    docs = docs.select(F.col(id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), sketch_column(F.col("text"), words).alias("s"))
    rows = written(rows.select("doc_id", "text_hash", "s.*"))
    keys = written(rows.select("mark", "n", "fingerprint", "bands", "parity").dropDuplicates(["mark"]))
    sets_of = candidate_sets(docs, rows.select("doc_id", "text_hash", "mark"), words)
    roots = components(links(keys, sets_of, similarity, tile)).toDF("mark", "root")
    rows = rows.select("doc_id", "text_hash", "mark").join(roots, "mark", "left")
    rows = written(rows.select("doc_id", "text_hash", F.coalesce("root", "mark").alias("root")))
    return rows.join(rows.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root")


def keep_one_copy(docs: DataFrame, id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The documents with their columns as they were, one of each component, chosen as in ``simhash.keep_one``."""
    return one_of_each(docs, near_copies(docs, id, text, **how), id, text)
