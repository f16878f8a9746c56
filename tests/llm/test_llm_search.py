"""SimHash, decontamination and line dedup against brute force and SQL, and on odd rows."""

import os
import random
import re
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tablecheck.llm import components as component_module
from tablecheck.llm import decontaminate, near_copies, simhash
from tablecheck.llm.components import components
from tablecheck.llm.decontaminate import OP5_SQL, FMIndex, Windows, find_hits, op5_decontaminate, remove_hits
from tablecheck.llm.line_dedup import OP1_SQL, _sql_lines, drop_boilerplate, host_of, html_lines, lines_of, op1_line_dedup
from tablecheck.operators import skew

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="benchmark tables not present")
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def sql(query):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(query)
    names = [c[0] for c in cur.description]
    return sorted((tuple(sorted(zip(names, r))) for r in cur.fetchall()), key=repr)


def rows(df):
    return sorted((tuple(sorted(r.asDict().items())) for r in df.collect()), key=repr)


def by_pairs(marks, radius=3):
    """Smallest reachable mark of each, by all pairs."""
    root = {m: m for m in marks}

    def top(m):
        while root[m] != m:
            m = root[m]
        return m

    for a in root:
        for b in root:
            if (a ^ b).bit_count() <= radius:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {m: top(m) for m in root}


def test_fingerprint_matches_definition():
    import xxhash

    text = "Aa b\tc D\x1ce é a b c"
    words = re.findall(r"[^\x20\x09-\x0D]+", text.translate(str.maketrans("AD", "ad")))
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert simhash.fingerprint(text.encode()) == want
    assert simhash.fingerprint(None) == simhash.fingerprint(b" \n") == 0
    assert simhash.fingerprint(b"one two") == xxhash.xxh64_intdigest(b"one two", 42)


@pytest.mark.parametrize("limit", [2000, 4])
def test_links_and_components_match_all_pairs(spark, limit):
    rng = random.Random(limit)
    marks = {rng.getrandbits(64) for _ in range(150)}
    for m in list(marks)[:40]:  # clusters, chains and pairs just beyond the radius
        for bits in (1, 2, 3, 4):
            marks.add(m ^ sum(1 << b for b in rng.sample(range(64), bits)))
    hub = rng.getrandbits(64)
    marks |= {hub ^ (1 << b) for b in range(60)} | {0, 7, (1 << 64) - 1}
    signed = [int(np.uint64(m).astype(np.int64)) for m in marks]
    found = simhash.links(spark.createDataFrame([(m,) for m in signed], "mark long"), limit=limit)
    root = dict(components(found).collect())
    want = by_pairs(marks)
    groups, expect = {}, {}
    for m, s in zip(marks, signed):
        groups.setdefault(root.get(s, s), set()).add(m)
        expect.setdefault(want[m], set()).add(m)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expect.values()))


def test_components_of_a_long_chain(spark):
    edges = spark.range(300).select(F.col("id").alias("x"), (F.col("id") + 1).alias("y"))
    assert {tuple(r) for r in components(edges).collect()} == {(k, 0) for k in range(1, 301)}
    assert components(edges.limit(0)).count() == 0


def by_union(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for x, y in pairs:
        x, y = sorted((find(x), find(y)))
        root[y] = x
    return sorted((x, find(x)) for x in root if find(x) != x)


@pytest.mark.parametrize("piece", [100_000, 5])
@pytest.mark.parametrize("forest", [1 << 20, 3])
def test_components_match_union_find(spark, forest, piece, monkeypatch):
    monkeypatch.setattr(component_module, "PIECE_ROWS", piece)
    monkeypatch.setattr(skew, "PIECE_ROWS", piece)
    rng = random.Random(forest + piece)
    pairs = [(rng.randrange(-400, 400), rng.randrange(-400, 400)) for _ in range(260)]
    pairs += [(1000, k) for k in range(1001, 1060)] + [(k, 1200) for k in range(1150, 1180)]  # hubs at either end
    pairs += [(2000 + k, 2001 + k) for k in range(40)] + pairs[:50] + [(7, 7), (-(1 << 63), (1 << 63) - 1)]
    rows = spark.createDataFrame(pairs + [(None, 3), (4, None), (None, None)], "p long, q long").repartition(6)
    want = by_union([p for p in pairs if p[0] != p[1]])
    assert sorted(tuple(r) for r in components(rows, forest).collect()) == want


def test_simhash_odd_rows(spark):
    data = [
        (5, None, "en", "a", 1), (3, "", None, "a", 1), (None, "x y z w", "en", None, 1), (9, "x y z w", "en", "b", 1),
        (9, "x y z w", "en", "b", 1), (9, "x y z w", "en", "c", None), (None, "only here", "en", "b", 1), (4, "something else now", "en", "b", 1),
    ]
    docs = spark.createDataFrame(data, DOC).withColumn("text_hash", F.lit(1)).withColumn("mark", F.lit("m"))
    got = {(r.doc_id, r.component_id, r.fingerprint) for r in simhash.near_duplicates(docs).collect()}
    assert {(d, c) for d, c, _ in got} == {(5, 3), (3, 3), (None, 9), (9, 9), (None, None), (4, 4)}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id, r.text) for r in kept.collect()) == [
        (False, 3, ""), (False, 4, "something else now"), (False, 9, "x y z w"), (True, None, "only here")]
    assert simhash.keep_one(docs.limit(0)).count() == 0


@needs_data
def test_op3_matches_all_pairs(spark):
    got = {r.doc_id: r for r in simhash.op3_simhash(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    marks = {d.doc_id: simhash.fingerprint((d.text or "").encode()) for d in docs}
    root, least = by_pairs(set(marks.values())), {}
    for d, m in marks.items():
        least[root[m]] = min(least.get(root[m], d), d)
    assert {d: (f"{m:016x}", least[root[m]]) for d, m in marks.items()} == {d: (r.fingerprint, r.component_id) for d, r in got.items()}


def by_jaccard(texts, words=5):
    """The component of each text by brute force: the place of its first text."""
    sets = []
    for t in texts:
        w = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()
        sets.append({tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} - {()})
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if root[i] != root[j] and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                x, y = sorted((root[i], root[j]))
                root = [x if r == y else r for r in root]
    return root


def test_stage_near_dedup_matches_brute_force_jaccard(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    texts = []
    for n in (60, 120, 300, 600):
        for _ in range(8):
            base = [word() for _ in range(n)]
            texts.append(" ".join(base))
            for changes in (n // 60, n // 50, n // 40, n // 30):  # similarities from 0.95 down to 0.7
                w = list(base)
                for at in rng.sample(range(n), changes):
                    w[at] = word()
                texts.append(" ".join(w))
            texts.append(" ".join(base).upper())
    chain = [word() for _ in range(200)]
    for k in range(12):  # each near the next, the ends far apart
        texts.append(" ".join(chain))
        chain[k * 16] = word()
    texts += ["", None, " ", "a b", "A b", "a b c", texts[0]]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in enumerate(texts)], DOC)
    want = by_jaccard(texts)
    marks = [simhash.fingerprint((t or "").encode()) for t in texts]
    assert len(set(want)) < len(set(by_pairs(set(marks)).values()))  # three bits leave links out
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()}
    assert got == dict(enumerate(want))
    cut = near_copies.near_copies(docs, tile=4000)  # bands of many, in many tiles
    assert {r.doc_id: r.component_id for r in cut.collect()} == dict(enumerate(want))
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == sorted(set(want))
    assert near_copies.keep_one_copy(docs.limit(0)).count() == 0


def test_fm_index_finds_every_occurrence():
    rng = np.random.default_rng(3)
    for _ in range(20):
        text = np.append(rng.integers(0, 4, rng.integers(1, 300)), 0)
        index = FMIndex(text, 4)
        phrases = rng.integers(1, 4, (30, 3))
        low, high = index.search(phrases)
        for p, a, z in zip(phrases, low, high):
            want = [k for k in range(len(text) - 2) if (text[k : k + 3] == p).all()]
            assert sorted(index.locate(np.arange(a, z))) == want


@needs_data
def test_op5_matches_sql(spark):
    assert rows(op5_decontaminate(spark, SF)) == sql(OP5_SQL)


def hits(spark, texts, items, **how):
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], DOC).withColumn("hits", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found, name = find_hits(docs, bench, **how)
    return docs, bench, {r.doc_id: r.h for r in found.select("doc_id", F.col(name).alias("h")).collect()}


@pytest.mark.parametrize("block_bytes", [1 << 20, 20])
def test_short_items_overlaps_and_blocks(spark, block_bytes):
    long = " ".join(f"w{k}" for k in range(14))
    items = [(1, long), (2, "solo"), (3, "two words"), (3, "two words"), (None, "lost item"), (4, None), (5, " .,"), (6, "W0 w1 w2 w3 w4 w5 w6 w7 w8 w9")]
    texts = [
        f"x {long.upper()} y", "nothing of it", None, "", "Solo,two--words solo", "w1 w2 w3 w4 w5 w6 w7 w8 w9", "a lost item",
        "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9 " * 3 + "w10", "two", "é solo",
    ]
    docs, bench, got = hits(spark, texts, items, block_bytes=block_bytes)
    assert [got[k].n_words for k in range(10)] == [16, 3, 0, 0, 4, 9, 3, 31, 1, 2]
    assert [got[k].n_hit for k in range(10)] == [14, 0, 0, 0, 4, 0, 2, 31, 0, 1]
    assert got[0]["items"] == ["1", "6"] and got[4]["items"] == ["2", "3"] and got[6]["items"] == [""] and got[7]["items"] == ["1", "6"]
    assert [(s.start, s.end) for s in got[0].spans] == [(1, 15)]
    clean = {r.doc_id: r for r in remove_hits(docs, bench, block_bytes=block_bytes).collect()}
    assert 4 not in clean and 7 not in clean  # nothing of them is left
    assert clean[0].text == "x  y" and clean[0].n_chars == 4 and clean[1].text == "nothing of it" and clean[1].n_chars == 0
    assert clean[2].text is None and clean[9].text == "é " and clean[0].hits == 1


def test_equal_items_of_a_benchmark_are_one(spark, monkeypatch):
    sizes = []
    monkeypatch.setattr(decontaminate, "Windows", lambda items, width: sizes.append(sum(len(t) for _, t in items)) or Windows(items, width))
    items = [("same", "one two three four five")] * 500 + [(f"i{k}", f"w{k} x{k} y{k} z{k}") for k in range(60)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    docs = spark.createDataFrame([(1, "a ONE two three four five b"), (2, "w7 x7 y7 z7")], "doc_id long, text string")
    for block in (1 << 20, 300):
        sizes.clear()
        out, h = find_hits(docs, bench, block_bytes=block)
        assert {r.doc_id: (r[h].n_hit, list(r[h]["items"])) for r in out.collect()} == {1: (5, ["same"]), 2: (4, ["i7"])}
        assert sum(sizes) < 1_200 and max(sizes) <= 3 * block


def test_no_benchmark_no_documents(spark):
    docs, bench, got = hits(spark, ["a b"], [(1, None)])
    assert got[0].n_hit == 0 and got[0].n_words == 2
    assert remove_hits(docs.limit(0), bench).count() == 0 and remove_hits(docs, bench.limit(0)).count() == 1
    assert Windows([], 10).shortest == 0


@needs_data
def test_op1_matches_sql(spark):
    assert rows(op1_line_dedup(spark, SF)) == sql(OP1_SQL)


def test_unclosed_html_takes_linear_time_and_means_the_same_in_sql(spark):
    pages = ["<!--" * 40_000, "<script>" * 20_000, "<style a" * 20_000, "<script></script" * 10_000, "<p " * 50_000, "<" * 100_000, "x</p" * 50_000]
    pages += ["a<br>b<!-- c<br>d", "a<p>b<script>c<p>d", "a<STYLE>b</style >c", "a<script>b</script", "1 < 2 <b>x</b>", "<p <p>y", "a--><p>b"]
    frame = spark.createDataFrame([(k, p) for k, p in enumerate(pages)], "k int, html string").coalesce(1)
    start = time.time()
    got = {r.k: r.x for r in frame.select("k", html_lines(F.col("html")).alias("x")).collect()}
    assert time.time() - start < 20
    # an end tag reaches to the next ">", here that of the next start tag, so every second end tag is left over, as text
    ends = [" ".join(["</script"] * 5_000)]
    assert [got[k] for k in range(7)] == [[], [], [], ends, ["<p " * 49_999 + "<p"], ["<" * 100_000], ["x</p" * 50_000]]
    assert [got[k] for k in range(7, 14)] == [["a", "b"], ["a", "b"], ["a c"], ["a"], ["1 < 2 x"], ["<p", "y"], ["a-->", "b"]]
    held = duckdb.connect()
    held.execute("CREATE TABLE h (k INT, html VARCHAR)")
    held.executemany("INSERT INTO h VALUES (?, ?)", list(enumerate(pages)))
    assert dict(held.execute(f"SELECT k, {_sql_lines()} FROM h").fetchall()) == got


def test_lines_hosts_and_boilerplate(spark):
    html = "<html><head><title>T &amp; t</title><script>a\nb</script></head><body><p>One<b> two</b></p><!-- no\n --><p> </p>a &lt; b<br>end"
    one = spark.createDataFrame([(html,), (None,), ("",)], "h string").select(html_lines(F.col("h")).alias("x")).collect()
    assert one[0].x == ["T & t", "One two", "a < b", "end"] and one[1].x is None and one[2].x == []
    urls = ["HTTP://User@WWW.Ex.com:80/a", "https://b.org?x", "nothing", None, "http:///x"]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select(host_of(F.col("u")).alias("h")).collect()
    assert [r.h for r in got] == ["www.ex.com", "b.org", None, None, None]
    data = [("a", "menu\nown %d\nmenu" % k) for k in range(9)] + [("a", None), ("b", "menu\nx"), ("b", "menu\ny"), (None, "menu"), (None, "menu"), (None, "menu")]
    pages = spark.createDataFrame(data, "host string, text string").withColumn("lines", lines_of(F.col("text"))).withColumn("site", F.lit(0))
    out, kept = drop_boilerplate(pages, "lines", "host")
    got = sorted((r.host or "", r[kept] or []) for r in out.collect())
    assert got == sorted([("a", [f"own {k}"]) for k in range(9)] + [("a", [])] + [("b", ["menu", "x"]), ("b", ["menu", "y"])] + 3 * [("", ["menu"])])
    assert drop_boilerplate(pages.limit(0), "lines", "host")[0].count() == 0


def test_near_copies_asks_the_trees(spark, monkeypatch):
    """Candidates come from fingerprints in BK-trees too: without any band, copies that differ little are linked."""
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in rng.integers(0, 10_000, 600)]
    far = [f"v{k}" for k in rng.integers(0, 10_000, 600)]
    texts = [" ".join(base), " ".join([*base, "one", "more"]), " ".join(far), " ".join(far[:-1]), " ".join(base[:40] + far[:40])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marks = [near_copies.set_fingerprint(near_copies.shingle_set(t.encode())) for t in texts]
    assert (marks[0] ^ marks[1]).bit_count() <= simhash.RADIUS and (marks[2] ^ marks[3]).bit_count() <= simhash.RADIUS
    monkeypatch.setattr(near_copies, "band_keys", lambda found: np.array([hash(found.tobytes()) % (1 << 62) + k for k in range(near_copies.BANDS)], np.uint64))
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4}
