"""Periodic runs, prefix trie and n-gram join against brute force and SQL, and on odd rows."""

import hashlib
import os
import random
import zlib
from collections import defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tablecheck.llm import ngram_join, periodic_runs, prefix_trie
from tablecheck.llm.periodic_runs import collapse_runs, kept_words, op11_periodic_runs, runs_column, runs_of

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="benchmark tables not present")


def sql(query):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(query)
    names = [c[0] for c in cur.description]
    return sorted((tuple(sorted(zip(names, r))) for r in cur.fetchall()), key=repr)


def rows(df):
    return sorted((tuple(sorted(r.asDict().items())) for r in df.collect()), key=repr)


# ---- periodic runs


def all_runs(x, least=24, periods=3):
    out = {}
    for q in range(1, len(x) // periods + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, periods * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((a, z - a, q) for (a, z), q in out.items())


def with_repeats(rng):
    kinds = rng.choice([1, 2, 3, 5, 50])
    x = [rng.randrange(kinds) for _ in range(rng.randrange(400))]
    for _ in range(rng.randrange(3)):
        p = rng.randrange(1, 70)
        unit = [rng.randrange(max(2, kinds)) for _ in range(p)]
        long, at = rng.randrange(p * 2, p * 5 + 30), rng.randrange(len(x) + 1)
        x[at:at] = (unit * (long // p + 1))[:long]
    return x


def test_runs_match_all_periods_of_all_places():
    rng = random.Random(11)
    for _ in range(12):
        texts = [with_repeats(rng) for _ in range(15)]
        found = runs_of([np.array(x, np.int64) for x in texts])
        assert found == [all_runs(x) for x in texts]


def test_runs_of_longer_blocks_than_the_longest(monkeypatch):
    monkeypatch.setattr(periodic_runs, "MOST_BLOCK", 8)
    rng = random.Random(12)
    texts = [with_repeats(rng) for _ in range(30)]
    assert runs_of([np.array(x, np.int64) for x in texts]) == [all_runs(x) for x in texts]


@pytest.mark.parametrize("n", [8, 32, 64, 512])
def test_transform_is_exact_and_comes_back(n):
    rng = np.random.default_rng(n)
    x, y = rng.integers(0, periodic_runs.PRIME, (2, 3, n)).astype(float)
    t = periodic_runs.Transform(n)
    assert np.array_equal(t.back(t.forward(x)), x)
    got = t.back(np.mod(t.forward(x) * t.forward(y), periodic_runs.PRIME))
    for a, b, c in zip(x.astype(int).tolist(), y.astype(int).tolist(), got.astype(int).tolist()):
        assert c == [sum(a[k] * b[(m - k) % n] for k in range(n)) % periodic_runs.PRIME for m in range(n)]


def test_runs_of_a_very_long_text():
    rng = random.Random(13)
    unit = [rng.randrange(1000) for _ in range(9000)]
    x = np.array([rng.randrange(1000) for _ in range(5000)] + unit * 3 + [1001] + [7] * 30_000, np.int64)
    assert runs_of([x]) == [[(5000, 27_000, 9000), (32_001, 30_000, 1)]]
    assert kept_words(len(x), runs_of([x])[0]).sum() == 5000 + 9000 + 1 + 1


def test_misleading_hashes_are_noticed(monkeypatch):
    true = periodic_runs.Stretches

    class Misleading(true):
        def __init__(self, ids, seed):
            super().__init__(ids, seed)
            if seed == 1:
                self.levels = [np.zeros_like(h) for h in self.levels]

    monkeypatch.setattr(periodic_runs, "Stretches", Misleading)
    x = np.array([1, 2, 3] * 20 + list(range(10, 40)), np.int64)
    assert runs_of([x]) == [[(0, 60, 3)]]


def test_run_parameters_have_a_least_value():
    with pytest.raises(ValueError, match="24"):
        runs_of([np.zeros(30, np.int64)], min_length=10)


@needs_data
def test_op11_matches_sql(spark):
    assert rows(op11_periodic_runs(spark, SF)) == sql(periodic_runs.OP11_SQL)


def test_runs_of_odd_rows(spark):
    loop = "spam ham " * 20
    data = [(1, None, "a"), (2, "", "b"), (3, " \t\n", "c"), (4, loop, "d"), (4, loop, "d"), (None, loop, None), (5, "word", "e")]
    docs = spark.createDataFrame(data, "doc_id long, text string, runs_found string")
    found = docs.select("doc_id", runs_column(F.col("text")).alias("r")).select("doc_id", "r.*").collect()
    by = defaultdict(list)
    for r in found:
        by[r["doc_id"]].append((r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]))
    assert by[1] == by[2] == by[3] == [(0, [], "")]
    assert by[4] == [(40, [(0, 40, 2)], "spam ham")] * 2 and by[None] == by[4][:1]
    kept = collapse_runs(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"], r["runs_found"]) for r in kept.collect() if r["text"]) == sorted(
        [(3, " \t\n", "c"), (4, "spam ham", "d"), (4, "spam ham", "d"), (0, "spam ham", None), (5, "word", "e")]
    )
    assert collapse_runs(docs.limit(0)).count() == 0


# ---- prefix trie


def nodes_of(paths):
    """Every node of {conv_id: [(role, text)]} by the definition."""
    members = defaultdict(list)
    for c, w in paths.items():
        for d in range(len(w) + 1):
            members[tuple(w[:d])].append(c)
    out = []
    for k, m in members.items():
        below = [x for x in members if x[: len(k)] == k]
        leaf = [x for x in below if not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in members)]
        ends = sorted(c for c in m if len(paths[c]) == len(k))
        out.append((
            min(m), len(k), min(members[k[:-1]]) if k else None, len(m), sum(len(x) == len(k) + 1 for x in below), len(leaf),
            sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def trie(spark, paths, n=8):
    rows = [(c, k, role, text) for c, w in paths.items() for k, (role, text) in enumerate(w)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", n)
    try:
        return sorted((tuple(r) for r in prefix_trie.prefix_trie(prefix_trie.turns_of(table)).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_trie_matches_definition(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 3)
    rng = random.Random(5)
    paths = {c: [(rng.choice("ua"), rng.choice(["", "x", "yes", "né"])) for _ in range(rng.randrange(1, 5))] for c in range(60)}
    paths |= {c: [("u", "same"), ("a", "copy")] for c in range(100, 140)}  # more equal ones than a shard holds
    assert trie(spark, paths) == nodes_of(paths)


def test_trie_with_one_shard_and_short_splitters(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SPLITTER_TURNS", 1)
    paths = {c: [("u", "hello")] * (c % 4 + 1) for c in range(1, 30)}
    assert trie(spark, paths, 1) == nodes_of(paths)
    assert trie(spark, paths, 6) == nodes_of(paths)


def test_trie_of_a_very_long_conversation(spark):
    paths = {1: [("u", str(k)) for k in range(500)], 2: [("u", str(k)) for k in range(300)], 3: [("u", "z" * 100_000)]}
    found = trie(spark, paths)
    assert len(found) == 502 and ("1", 500) == (str(max(found, key=lambda r: r[1])[0]), max(r[1] for r in found))
    top = next(r for r in found if r[1] == 0)
    assert top[:6] == (1, 0, None, 3, 2, 2) and top[6] == sum(len(str(k)) for k in range(300))


def rebuilt(own):
    out = {}
    for c, w in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + w[h:]
    return out


def test_shared_heads_and_odd_rows(spark):
    own = {c: [("u", f"{c}-{k}") for k in range(c % 7 + 1)] for c in (*range(0, 9), 105, 200, 203)}
    data = [(c, k, role, text, "x") for c, w in own.items() for k, (role, text) in enumerate(w)]
    data += [(None, 0, "u", "nobody", "x")]
    own[300] = [("", ""), ("", "b"), ("u", "")]
    data += [(300, None, None, None, "x"), (300, 1, None, "b", "x"), (300, 2, "u", None, "x")]
    own[301] = [("u", "same")] * 8
    data += [(301, k // 2, "u", "same", "x") for k in range(8)]  # repeated rows are turns
    table = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, PATH string")
    found = prefix_trie.prefix_trie(prefix_trie.with_shared_heads(prefix_trie.turns_of(table)))
    assert sorted((tuple(r) for r in found.collect()), key=repr) == nodes_of(rebuilt(own))
    empty = prefix_trie.prefix_trie(prefix_trie.with_shared_heads(prefix_trie.turns_of(table.limit(0))))
    assert empty.collect() == []


@needs_data
def test_op12_matches_sql(spark):
    assert rows(prefix_trie.op12_prefix_trie(spark, SF)) == sql(prefix_trie.OP12_SQL)


# ---- n-gram join


def joined(docs, words=3, least=Fraction(9, 10)):
    """(id, set size, smallest id of the component) by all pairs."""
    sets = []
    for _, text in docs:
        w = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
        sets.append({tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set())
    root = list(range(len(docs)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                root[top(a)] = top(b)
    of = defaultdict(list)
    for k in range(len(docs)):
        of[top(k)].append(docs[k][0])
    lowest = {k: min((x for x in v if x is not None), default=None) for k, v in of.items()}
    return sorted(((docs[k][0], len(sets[k]), lowest[top(k)]) for k in range(len(docs))), key=repr)


def copies(rng, n=120):
    base = [[f"w{rng.randrange(300)}" for _ in range(rng.randrange(4, 120))] for _ in range(10)]
    passage = [f"p{k}" for k in range(30)]
    out = []
    for k in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            at = rng.randrange(len(w))
            w[at : at + rng.randrange(2)] = [f"n{rng.randrange(5)}"]
        if rng.random() < 0.3:
            w += passage
        out.append((k, " ".join(w)))
    return out


@pytest.mark.parametrize("limits", [{}, {"group": 1, "list_": 2, "tile": 700}, {"group": 2, "list_": 5, "tile": 3000, "frequent": 20}])
def test_join_matches_all_pairs(spark, limits):
    docs = copies(random.Random(17))
    found = ngram_join.ngram_join(spark.createDataFrame(docs, "doc_id long, text string"), **limits)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found.collect()), key=repr) == joined(docs)


def test_join_of_odd_rows(spark):
    long = " ".join(f"v{k}" for k in range(40_000))
    docs = [(1, None), (2, ""), (3, " \n"), (4, "A b"), (5, "a B"), (None, "a b"), (6, "c d e"), (6, "c d e"), (7, long), (8, long + " end")]
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, MARK string")
    found = ngram_join.ngram_join(frame)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found.collect()), key=repr) == joined(docs)
    assert ngram_join.ngram_join(frame.limit(0)).count() == 0


def test_frequent_shingles_bear_on_order_alone(spark):
    docs = spark.createDataFrame(copies(random.Random(3)), "doc_id long, text string")
    ranks = ngram_join.frequent_shingles(docs, "text", 3, 10)
    assert ranks.shape == (3, 10) and sorted(ranks[1].tolist()) == list(range(10)) and (np.diff(ranks[0].astype(float)) > 0).all()
    found = np.sort(np.concatenate([ranks[0], np.arange(1, 11, dtype=np.uint64)]))
    assert set(ngram_join.prefix_of(found, ranks, Fraction(1, 2)).tolist()) >= set(range(1, 11))


@needs_data
def test_op13_matches_sql(spark):
    assert rows(ngram_join.op13_ngram_join(spark, SF)) == sql(ngram_join.OP13_SQL)
