"""Periodic runs of words, found by block convolution (operator 11).

A run is a stretch of consecutive words in which words q apart are identical, q being the smallest such
period, at least max(min_length, exponent * q) words long, that cannot be extended to either side.

At each dyadic scale [b, 2b) of periods a text is cut into blocks of b words. A run with a period of the scale
is long enough to hold a whole block together with the copy of it that follows one period later. Words
become numbers modulo PRIME, and for every block the sums of squared differences to all places of the following
window of 2b words come from one number-theoretic transform, in exact integers. A sum of zero marks an occurrence;
its distance is a seed, extended to both sides by comparing stretches of doubling length. Periods below 2 * BASE
share the first scale. Stretches that lie in a run found at a smaller scale have a multiple of its period, and are
passed over. Two different stretches of words may also have a sum of zero; they end in the extension. Every run
is compared word by word before it is returned.

Texts of a slice are handled together, blocks of all of them in one matrix; work is n log(n)^2 for a text of n words.
A text is one unit of work: its memory follows its own length, not that of other texts. Null and empty texts
have no words and no runs. Each row is judged by itself, so repeated rows and clashing names don't matter.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecheck.llm.common import crc32_sql, free_name, slices, table, tidy

MIN_LENGTH = 24
EXPONENT = 3
PRIME = 65537
ROOT = 3
BASE = 8
# The longest block; longer periods are looked for with blocks of this length, a period apart.
MOST_BLOCK = 1 << 15
# Numbers transformed at a time.
CHUNK = 1 << 18
ODD = np.uint64(0x9E3779B97F4A7C15)

Runs = list[tuple[int, int, int]]
RUN = "struct<start:bigint,length:bigint,period:bigint>"


def _mod(x: np.ndarray) -> np.ndarray:
    """Exact for whole numbers of less than 2**53 in absolute value."""
    return x - PRIME * np.floor(x / PRIME)


def _powers(n: int, rows: int, cols: int, sign: int) -> np.ndarray:
    """w ** (i * j) for an n-th root of one."""
    w = pow(ROOT, (PRIME - 1) // n, PRIME)
    each = np.ones(n, np.int64)
    for k in range(1, n):
        each[k] = each[k - 1] * w % PRIME
    return each[sign * np.outer(np.arange(rows), np.arange(cols)) % n].astype(float)


class Transform:
    """Number-theoretic transform of rows of ``n`` numbers, as products with two small matrices."""

    def __init__(self, n: int):
        a = 1 if n <= 32 else 1 << (n.bit_length() - 1) // 2
        b = n // a
        self.n, self.a, self.b = n, a, b
        self.first, self.last, self.twist = _powers(a, a, a, 1), _powers(b, b, b, 1), _powers(n, b, a, 1)
        scale = pow(n, PRIME - 2, PRIME)
        self.unfirst, self.unlast, self.untwist = _powers(a, a, a, -1), _mod(_powers(b, b, b, -1) * scale), _powers(n, b, a, -1)

    def forward(self, x: np.ndarray) -> np.ndarray:
        """The spectrum, in an order of its own."""
        if self.a > 1:
            x = x.reshape(-1, self.a, self.b).transpose(0, 2, 1)
            x = _mod(_mod(x @ self.first) * self.twist).transpose(0, 2, 1)
        return _mod(np.ascontiguousarray(x).reshape(-1, self.b) @ self.last).reshape(-1, self.n)

    def back(self, x: np.ndarray) -> np.ndarray:
        x = _mod(x.reshape(-1, self.b) @ self.unlast)
        if self.a > 1:
            x = x.reshape(-1, self.a, self.b).transpose(0, 2, 1)
            x = (_mod(_mod(x * self.untwist) @ self.unfirst)).transpose(0, 2, 1)
        return np.ascontiguousarray(x).reshape(-1, self.n)


@functools.lru_cache(maxsize=32)
def transform(n: int) -> Transform:
    return Transform(n)


def occurrences(values: np.ndarray, squares: np.ndarray, at: np.ndarray, block: int, low: int, count: int):
    """(block number, distance) of the blocks' places at distances low to low + count - 1 with no squared difference.

    ``values`` has low + count + block words of padding, ``squares`` the sums of squares before each word.
    """
    width = count + block - 1
    n = 1 << (width - 1).bit_length()
    t = transform(n)
    rows = max(1, CHUNK // n)
    for k in range(0, len(at), rows):
        here = at[k : k + rows, None]
        mine = np.zeros((len(here), n))
        mine[:, :block] = values[here + np.arange(block)][:, ::-1]
        window = np.zeros((len(here), n))
        window[:, :width] = values[here + low + np.arange(width)]
        both = t.back(_mod(t.forward(mine) * t.forward(window)))[:, block - 1 : width]
        places = here + low + np.arange(count)
        own = squares[here + block] - squares[here] + squares[places + block] - squares[places]
        row, d = np.nonzero((own - 2 * both.astype(np.int64)) % PRIME == 0)
        yield row + k, d + low


class Stretches:
    """Lengths of common stretches of one text, from hashes of all stretches of 1, 2, 4, ... words."""

    def __init__(self, ids: np.ndarray, seed: int):
        self.n = len(ids)
        h = ids.astype(np.uint64) * ODD + np.uint64(seed)
        self.levels = [self._mix(h)]
        k = 1
        while 2 * k <= self.n:
            h = self.levels[-1]
            self.levels.append(self._mix(h[: len(h) - k] * ODD + h[k:] + np.uint64(k)))
            k *= 2

    @staticmethod
    def _mix(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i on equal those from j on (i < j)."""
        got = np.zeros(len(i), np.int64)
        for k in reversed(range(len(self.levels))):
            h, step = self.levels[k], 1 << k
            fits = j + got + step <= self.n
            x, y = (np.where(fits, p + got, 0) for p in (i, j))
            got += step * (fits & (h[x] == h[y]))
        return got

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before i equal those before j."""
        got = np.zeros(len(i), np.int64)
        for k in reversed(range(len(self.levels))):
            h, step = self.levels[k], 1 << k
            fits = i - got - step >= 0
            x, y = (np.where(fits, p - got - step, 0) for p in (i, j))
            got += step * (fits & (h[x] == h[y]))
        return got


def _grow(ids: np.ndarray, tried: Stretches, s: np.ndarray, d: np.ndarray, runs: dict, min_length: int, exponent: int) -> bool:
    """Adds the runs that the seeds (place, distance) belong to: period by (start, end). False if hashes misled."""
    start = s - tried.behind(s, s + d)
    end = s + d + tried.ahead(s, s + d)
    long = end - start >= np.maximum(min_length, exponent * d)
    for a, z, q in set(zip(start[long].tolist(), end[long].tolist(), d[long].tolist())):
        if q < runs.get((a, z), q + 1):
            if not np.array_equal(ids[a : z - q], ids[a + q : z]):
                return False
            runs[a, z] = q
    return True


class _Text:
    """One text on its way through the scales."""

    def __init__(self, ids: np.ndarray, min_length: int, exponent: int):
        self.ids, self.limits, self.runs, self.seed = ids, (min_length, exponent), {}, 1
        self.stretches = self.cover = None

    def seeds(self, s: np.ndarray, d: np.ndarray, block: int) -> None:
        if self.cover is not None:  # the furthest end of a run that begins at or before a word
            inside = self.cover[s] >= s + d + block
            s, d = s[~inside], d[~inside]
        if not len(s):
            return
        self.stretches = self.stretches or Stretches(self.ids, self.seed)
        before = len(self.runs)
        while not _grow(self.ids, self.stretches, s, d, self.runs, *self.limits):
            self.seed += 1
            self.stretches = Stretches(self.ids, self.seed)
        if len(self.runs) > before:
            ends = np.zeros(len(self.ids), np.int64)
            for a, z in self.runs:
                ends[a] = max(ends[a], z)
            self.cover = np.maximum.accumulate(ends)


def runs_of(texts: list[np.ndarray], min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> list[Runs]:
    """(start, length, period) of every run of each text, given as word numbers, by start and period."""
    if min_length < 3 * BASE or exponent < 3:
        raise ValueError(f"runs have {3 * BASE} words and three periods at least")
    n = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(n)
    longest = int(n.max(initial=0))
    if longest < min_length:
        return [[] for _ in texts]
    flat = np.concatenate([*texts, np.zeros(4 * BASE, np.int64)])
    spare = np.zeros(2 * min(longest, MOST_BLOCK) + longest, np.int64)  # windows end behind the last word
    hashed = np.concatenate([(flat.astype(np.uint64) * ODD >> np.uint64(32)).astype(np.int64) % PRIME, spare])
    squares = np.concatenate([[0], np.cumsum(hashed * hashed)])
    values = hashed.astype(float)
    held: dict[int, _Text] = {}
    low = 1
    while exponent * low <= longest:
        high = 2 * BASE if low == 1 else 2 * low
        step = BASE if low == 1 else low
        block = min(step, MOST_BLOCK)
        mine = np.flatnonzero(n >= max(min_length, exponent * low))
        blocks = np.maximum(0, (n[mine] - low - block) // step + 1)
        owner = np.repeat(mine, blocks)
        nth = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        at = (ends - n)[owner] + nth * step
        widest = block if low > 1 else high - low
        for first in range(low, high, widest):
            for row, d in occurrences(values, squares, at, block, first, min(widest, high - first)):
                s = at[row]
                real = s + d + block <= ends[owner[row]]
                row, s, d = row[real], s[real], d[real]
                real = (flat[s] == flat[s + d]) & (flat[s + block - 1] == flat[s + d + block - 1])
                row, s, d = row[real], s[real], d[real]
                for k in np.unique(owner[row]).tolist():
                    here = owner[row] == k
                    text = held.setdefault(k, _Text(texts[k], min_length, exponent))
                    text.seeds(s[here] - (ends[k] - n[k]), d[here], block)
        low = high
    out: list[Runs] = [[] for _ in texts]
    for k, text in held.items():
        out[k] = sorted((a, z - a, q) for (a, z), q in text.runs.items())
    return out


def kept_words(n: int, runs: Runs) -> np.ndarray:
    """Which of n words are in no run after the run's first period."""
    steps = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        steps[start + period] += 1
        steps[start + length] -= 1
    return np.cumsum(steps[:-1]) == 0


def numbered(words: list[list[bytes]]) -> list[np.ndarray]:
    """The words as numbers, equal for equal words."""
    known: dict[bytes, int] = {}
    return [np.fromiter((known.setdefault(x, len(known)) for x in w), np.int64, len(w)) for w in words]


def runs_column(text: Column, key: Column | None = None, edit: Callable[[list[bytes], object], list[bytes]] | None = None) -> Column:
    """Struct of n_words, runs (by start and period) and collapsed, the kept words joined by one space.

    ``edit`` may change a text's words, given ``key``, before they are searched.
    """
    kind = pa.struct([
        ("n_words", pa.int64()),
        ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
        ("collapsed", pa.string()),
    ])

    def judged(words: list[list[bytes]]) -> pa.StructArray:
        found = runs_of(numbered(words))
        short = [b" ".join(x for x, k in zip(w, kept_words(len(w), r)) if k) if r else b" ".join(w) for w, r in zip(words, found)]
        runs = [[dict(zip(("start", "length", "period"), x)) for x in r] for r in found]
        columns = [pa.array([len(w) for w in words], pa.int64()), pa.array(runs, kind.field(1).type)]
        return pa.StructArray.from_arrays([*columns, pa.array(short, pa.binary()).cast(pa.string())], fields=list(kind))

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, keys in batches:
            out, at = [], 0
            for part in slices(texts):
                words = [t.split() if t else [] for t in part]
                if edit:
                    words = [edit(w, k) for w, k in zip(words, keys.slice(at, len(part)).to_pylist())]
                at += len(part)
                out.append(judged(words))
            yield pa.concat_arrays(out) if out else pa.array([], kind)

    shape = f"n_words long, runs array<{RUN}>, collapsed string"
    return F.arrow_udf(tidy(run), shape).asNondeterministic()(text.cast("string"), F.lit(None).cast("string") if key is None else key)


def strongest(runs: Column) -> Column:
    """The run with the greatest length in periods; the first of those, null without runs."""
    more = lambda x, y: y["length"] * x["period"] > x["length"] * y["period"]
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda x, y: F.when(more(x, y), y).otherwise(x))


def collapse_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with the repetitions of each run cut out of their text (words joined by one space); a text without runs stays as it is."""
    found = runs_column(F.col(text))
    name = free_name(docs, "runs_found")
    out = docs.withColumn(name, found)
    new = F.when(F.size(F.col(name)["runs"]) > 0, F.col(name)["collapsed"]).otherwise(F.col(text))
    return out.withColumn(text, new).drop(name)


def planted(words: list[bytes], id: int | None) -> list[bytes]:
    """The query's own repetitions, in a tenth of the documents."""
    h = zlib.crc32(str(id).encode()) if id is not None else 1
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = docs.select("doc_id", runs_column(F.col("text"), F.col("doc_id"), planted).alias("r"))
    runs = F.col("r.runs")
    found = found.select("doc_id", runs.alias("runs"), F.col("r.collapsed").alias("collapsed"), strongest(runs).alias("best"))
    line = lambda x: F.concat(F.concat_ws(",", *[x[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )


_WORDS = "coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), [])"
OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w, {crc32_sql("CAST(doc_id AS VARCHAR)")} AS h FROM documents),
a AS (SELECT *, CAST(len(w) AS BIGINT) AS n, h // 10 AS g FROM d),
b AS (SELECT *, CASE WHEN doc_id IS NOT NULL AND h % 10 = 0 AND n > 0 THEN g % n END AS a FROM a),
c AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM b),
t AS MATERIALIZED (SELECT r, doc_id, n, CASE WHEN a IS NULL THEN w
    ELSE list_transform(range(0, n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) END AS w FROM c),
e AS MATERIALIZED (SELECT r, n, unnest(w) AS word, unnest(range(0, n)) AS i FROM t),
m AS (SELECT x.r, y.i - x.i AS q, x.i FROM e x JOIN e y ON x.r = y.r AND x.word = y.word AND x.i < y.i AND {EXPONENT} * (y.i - x.i) <= x.n),
s AS (SELECT r, q, min(i) AS a, max(i) + 1 + q AS z
  FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM m) GROUP BY r, q, k),
run AS MATERIALIZED (SELECT r, a AS start, z - a AS length, min(q) AS period FROM s
  WHERE z - a >= greatest({MIN_LENGTH}, {EXPONENT} * q) GROUP BY r, a, z),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY length / period DESC, start, period) AS k FROM run) WHERE k = 1),
found AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM run GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM run),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS words FROM e ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(words, '')) AS collapsed_sha256
FROM t LEFT JOIN best USING (r) LEFT JOIN found USING (r) LEFT JOIN kept USING (r)
"""
