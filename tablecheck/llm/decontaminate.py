"""Benchmark decontamination with FM-indexes (operator 5).

Every shard of the documents (about SLICE_BYTES of text in one task) gets an FM-index: the
Burrows-Wheeler transform of its words in a wavelet matrix, with sampled suffix positions. Benchmark
windows are searched backwards through the matrix' ranks, all at once; rows of the found ranges walk to
a sampled position, which gives the document and word; overlapping windows merge into removal spans.

A window is ``width`` consecutive words of an item; an item of fewer words is one window, an item of
none has none. Only stretches of words that all occur in the benchmark and are as long as the shortest
window can hold a window, so the index holds those stretches of the shard, with separators between.

The benchmark goes to the tasks in blocks of about BLOCK_BYTES of text (or one item), so what a task holds
is bounded. With more than one block the rows are written after each, and a document's spans and items
are merged block by block.

Null and empty texts have no words. A null item id counts as the empty string, repeated items count
once per id, an empty benchmark hits nothing. Other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecheck.llm.common import LOWER_BYTES, UPPER, free_name, slices, table, tidy, written

WIDTH = 10
BLOCK_BYTES = 1 << 20
SAMPLE_EVERY = 8
RESULT = "n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"

# Lower-cases A-Z and turns every other ASCII character that is no letter or digit into a blank.
TO_WORDS = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in LOWER_BYTES
)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(TO_WORDS).split() if text else []


class WaveletMatrix:
    """Ranks over a sequence of small integers, one bit vector per binary digit."""

    def __init__(self, symbols: np.ndarray, digits: int):
        self.levels: list[tuple[int, int, np.ndarray]] = []
        for d in range(digits - 1, -1, -1):
            one = (symbols >> d) & 1
            zeros_before = np.concatenate([[0], np.cumsum(1 - one)]).astype(np.int64)
            self.levels.append((d, int(zeros_before[-1]), zeros_before))
            symbols = np.concatenate([symbols[one == 0], symbols[one == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its position."""
        low = np.zeros_like(at)
        for d, zeros, before in self.levels:
            one = ((symbol >> d) & 1).astype(bool)
            low = np.where(one, zeros + low - before[low], before[low])
            at = np.where(one, zeros + at - before[at], before[at])
        return at - low


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling; every 0 is a separator of its own, so no comparison goes past one."""
    zero = text == 0
    key = np.where(zero, np.cumsum(zero) - 1, int(zero.sum()) + text)
    n, step = len(text), 1
    while True:
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
        if rank[order[-1]] == n - 1:
            return order
        after = np.zeros(n, np.int64)
        after[:-step] = rank[step:] + 1
        key, step = rank * (n + 1) + after, 2 * step


class FMIndex:
    def __init__(self, text: np.ndarray, alphabet: int):
        """``text``: symbols below ``alphabet``; 0 separates and ends the stretches."""
        order = suffix_array(text)
        self.bwt = text[order - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=alphabet))])
        self.matrix = WaveletMatrix(self.bwt, max(1, int(alphabet - 1).bit_length()))
        # Sampled: every SAMPLE_EVERY-th position, and the first of each stretch, so no walk meets a separator.
        self.sampled = np.where((order % SAMPLE_EVERY == 0) | (self.bwt == 0), order, -1)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of rows whose suffixes begin with each phrase (a row of symbols)."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), len(self.bwt), np.int64)
        alive = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[alive, k]
            low[alive] = self.first[c] + self.matrix.rank(c, low[alive])
            high[alive] = self.first[c] + self.matrix.rank(c, high[alive])
            alive = alive[low[alive] < high[alive]]
        return low, np.where(low < high, high, low)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of the rows' suffixes."""
        at, steps, walking = rows.copy(), np.zeros(len(rows), np.int64), np.arange(len(rows))
        while len(walking := walking[self.sampled[at[walking]] < 0]):
            c = self.bwt[at[walking]]
            at[walking] = self.first[c] + self.matrix.rank(c, at[walking])
            steps[walking] += 1
        return self.sampled[at] + steps


class Windows:
    """The windows of one block of the benchmark."""

    def __init__(self, items: list[tuple[str, bytes]], width: int):
        self.symbol: dict[bytes, int] = {}
        by_size: dict[int, dict[tuple[int, ...], set[str]]] = {}
        for name, text in items:
            ids = [self.symbol.setdefault(w, len(self.symbol) + 1) for w in words_of(text)]
            size = min(width, len(ids))
            for k in range(len(ids) - size + 1 if ids else 0):
                by_size.setdefault(size, {}).setdefault(tuple(ids[k : k + size]), set()).add(name)
        self.phrases = {n: np.array(list(w), np.int64) for n, w in by_size.items()}
        self.items = {n: list(w.values()) for n, w in by_size.items()}
        self.shortest = min(by_size, default=0)

    def occurrences(self, ids: np.ndarray, opens: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(size, window, position): where windows occur in the shard's words; ``opens`` marks a document's first word."""
        ok = ids > 0
        starts = ok & (opens | ~np.concatenate([[False], ok[:-1]]))
        run = np.cumsum(starts) - 1
        length = np.bincount(run[ok], minlength=1) if ok.any() else np.zeros(1, np.int64)
        at = np.flatnonzero(ok & (length[np.maximum(run, 0)] >= self.shortest))
        if not len(at):
            return
        place = np.arange(len(at)) + np.concatenate([[0], np.cumsum(np.diff(run[at]) != 0)])
        text = np.zeros(place[-1] + 2, np.int64)
        origin = np.zeros(len(text), np.int64)
        text[place], origin[place] = ids[at], at
        index = FMIndex(text, len(self.symbol) + 1)
        for size, phrases in self.phrases.items():
            low, high = index.search(phrases)
            count = high - low
            window = np.repeat(np.arange(len(phrases)), count)
            rows = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            yield size, window, origin[index.locate(rows)]


def hits_column(text: Column, prior: Column, windows: Windows) -> Column:
    """Struct of RESULT for one block of the benchmark, merged into the struct of the blocks before."""

    def shard(texts: list[bytes | None], before: list[dict | None]) -> list[dict]:
        words = [words_of(t) for t in texts]
        n = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        ids = np.fromiter(map(windows.symbol.get, chain.from_iterable(words), repeat(0)), np.int64, total)
        opens = np.zeros(total + 1, bool)
        opens[ends - n] = True
        steps = np.zeros(total + 1, np.int64)
        items: dict[int, set[str]] = {}
        for size, window, at in windows.occurrences(ids, opens[:-1]) if windows.shortest and total else ():
            np.add.at(steps, at, 1)
            np.add.at(steps, at + size, -1)
            doc = np.searchsorted(ends, at, side="right")
            pairs = np.unique(doc * (len(windows.items[size]) + 1) + window)
            for d, w in zip(pairs // (len(windows.items[size]) + 1), pairs % (len(windows.items[size]) + 1)):
                items.setdefault(int(d), set()).update(windows.items[size][w])
        touched = set(items) | {k for k, b in enumerate(before) if b and b["items"]}
        out = [{"n_words": int(k), "n_hit": 0, "items": [], "spans": []} for k in n]
        depth = np.cumsum(steps)
        for d in touched:
            hit = depth[ends[d] - n[d] : ends[d]] > 0
            b = before[d] or {"items": [], "spans": []}
            for span in b["spans"]:
                hit[span["start"] : span["end"]] = True
            edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
            out[d]["n_hit"] = int(hit.sum())
            out[d]["items"] = sorted(items.get(d, set()) | set(b["items"]))
            out[d]["spans"] = [{"start": int(a), "end": int(z)} for a, z in edge.reshape(-1, 2)]
        return out

    kind = pa.struct([
        ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ])

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, before in batches:
            out: list[dict] = []
            for part in slices(texts):
                prior_part = before.slice(len(out), len(part))
                out += shard(part, prior_part.to_pylist() if prior_part.null_count < len(part) else [None] * len(part))
            yield pa.array(out, kind)

    return F.arrow_udf(tidy(run), RESULT).asNondeterministic()(text.cast("string"), prior)


def find_hits(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    width: int = WIDTH, block_bytes: int = BLOCK_BYTES,
) -> tuple[DataFrame, str]:
    """The documents with a struct of RESULT beside their columns, and that column's name."""
    items = benchmark.select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("name"), F.col(item_text).cast("string").alias("text")
    ).where("text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    name = free_name(docs, "hits")
    out = docs.withColumn(name, F.lit(None).cast(f"struct<{RESULT.replace(' long', ':bigint').replace(' array', ':array')}>"))
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("text", "name"), F.lit(blocks)) == b).collect()
        windows = Windows([(r["name"], r["text"].encode()) for r in rows], width)
        out = written(out) if b else out
        out = out.withColumn(name, hits_column(F.col(text), F.col(name), windows))
    return out, name


def cut(text: str, spans: list[dict]) -> str:
    """The text without the words in the spans (and what lies between them)."""
    at = [m.span() for m in WORD.finditer(text)]
    out, last = [], 0
    for s in spans:
        out.append(text[last : at[s["start"]][0]])
        last = at[s["end"] - 1][1]
    return "".join([*out, text[last:]])


def remove_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", length: str = "n_chars", **how) -> DataFrame:
    """The documents with the removal spans cut out of their text, columns otherwise as they were.

    A document none of whose words is left goes. Where a column ``length`` exists, it gets the number of
    characters of a changed text.
    """
    found, name = find_hits(docs, benchmark, text, **how)

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, hits in batches:
            touched = pc.greater(pc.fill_null(hits.field("n_hit"), 0), 0)
            changed = zip(texts.filter(touched).to_pylist(), hits.field("spans").filter(touched).to_pylist())
            yield pc.replace_with_mask(texts, touched, pa.array([cut(t, s) for t, s in changed], texts.type))

    h = F.col(name)
    kept = found.where((h["n_hit"] == 0) | (h["n_hit"] < h["n_words"]))
    kept = kept.withColumn(text, F.arrow_udf(tidy(run), "string").asNondeterministic()(F.col(text).cast("string"), h))
    if length in docs.columns:
        changed = F.char_length(text).cast(docs.schema[length].dataType)
        kept = kept.withColumn(length, F.when(h["n_hit"] > 0, changed).otherwise(F.col(length)))
    return kept.drop(name)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, h = find_hits(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    hit = F.col(h)
    return found.select(
        "doc_id", hit["n_words"].alias("n_words"), hit["n_hit"].alias("n_hit"),
        F.size(hit["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(hit["items"]), ","), 256).alias("items_sha256"),
        (hit["n_hit"] > 0).alias("contaminated"),
    )


_WORDS = (
    f"regexp_extract_all(translate(text, '{UPPER}', '{UPPER.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)
OP5_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
bw AS MATERIALIZED (
  SELECT DISTINCT item, least(len(w), {WIDTH}) AS n, list_slice(w, k, k + least(len(w), {WIDTH}) - 1) AS p
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {WIDTH} + 1, 1) + 1)) AS k FROM b WHERE len(w) > 0)),
dw AS MATERIALIZED (
  SELECT r, k, n, list_slice(w, k, k + n - 1) AS p
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hit AS MATERIALIZED (SELECT dw.r, dw.k, dw.n, bw.item FROM dw JOIN bw ON dw.n = bw.n AND dw.p = bw.p),
pos AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS x FROM hit) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
"""
