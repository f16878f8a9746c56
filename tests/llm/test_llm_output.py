"""Mixing, token files and the pipeline against brute force, round trips and odd rows."""

import itertools
import os
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tablecheck.llm import mixing, quality_rules, token_files
from tablecheck.llm.common import written
from tablecheck.llm.decontaminate import words_of

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="benchmark tables not present")
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def test_targets_reshare_the_excess():
    got = mixing.targets({"a": 10, "b": 1000, "c": 0, None: 90})
    assert list(got) == ["a", "b", "c", None] and got["a"] == 30 and got["c"] == 0
    # b weighs 2 and null, last of four, weighs 5 again; null stops at three times its size.
    assert got[None] == 270 and got["b"] == 1100 - 30 - 270
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0.0}
    # as many rounds as sources: each target stops and raises the next
    many = {f"s{k:06d}": k * k + 1 for k in range(100_000)}
    start = time.time()
    out = mixing.targets(many, weights=(1,), most=1.5)
    assert time.time() - start < 5 and abs(sum(out.values()) / sum(many.values()) - 1) < 1e-9
    level = max(out.values())
    assert all(abs(out[s] - min(1.5 * n, level)) <= 1e-6 * level for s, n in many.items())
    even = mixing.targets({"a": 100, "b": 100, "c": 100}, weights=(1,))
    assert set(even.values()) == {100.0}


def test_flow_is_cheapest_of_all():
    rng = np.random.default_rng(2)
    for _ in range(15):
        patterns = {p: int(n) for p, n in zip([("a",), ("b",), ("a", "b")], rng.integers(1, 4, 3))}
        quota = {"a": float(rng.integers(0, 8)), "b": float(rng.integers(0, 8))}
        taken = mixing.route(patterns, quota)
        cost = lambda t, n: sum(k * k * min(n, max(0, t - n * (k - 1))) for k in (1, 2, 3))
        best = None
        for t in itertools.product(*[range(3 * n + 1) for n in patterns.values()]):
            for shared in range(t[2] + 1):
                if t[0] + shared <= quota["a"] and t[1] + t[2] - shared <= quota["b"]:
                    key = (-sum(t), sum(cost(x, n) for x, n in zip(t, patterns.values())))
                    best = min(best, key) if best else key
        assert (-sum(taken.values()), sum(cost(taken[p], n) for p, n in patterns.items())) == best


def test_overlapping_sources_and_odd_rows(spark):
    data = [(k, "w " * (1 + k % 40), "en", "abc"[k % 3], 0) for k in range(600)]
    data += [(700, None, "en", "a", 0), (701, "", None, None, 0), (702, "x y", "en", None, 0), (702, "x y", "en", None, 0), (None, "z " * 9, "en", "b", 0)]
    docs = spark.createDataFrame(data, DOC).withColumn("mix_size", F.lit(1)).withColumn("words", F.lit(2))
    members = F.when(F.col("doc_id") % 5 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array("source"))
    size = mixing.word_count(F.col("text"))
    out, copies, sizes, quota = mixing.mix(docs, members, size, F.struct("doc_id"), quota={"a": 2000.0, "b": 9000.0, "c": 1500.0})
    rows = out.select("doc_id", members.alias("m"), size.alias("n"), F.col(copies).alias("c")).collect()
    assert len(rows) == len(data) and out.columns == [*docs.columns, copies] and all(0 <= r.c <= 3 for r in rows)
    only_c = sum(r.n * r.c for r in rows if r.m == ["c"])
    assert abs(only_c - 1500) <= 20 and abs(sum(r.n * r.c for r in rows) - 12500) <= 60
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and sorted(map(repr, mixed.collect())) == sorted(map(repr, mixing.mixed(docs).collect()))
    assert mixing.mixed(docs.limit(0)).count() == 0


@needs_data
def test_op8_meets_its_targets(spark):
    rows = mixing.op8_mixing(spark, SF).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    sizes, taken, largest = {}, {}, {}
    for r in rows:
        assert r.size == len((docs[r.doc_id].text or "").encode().split()) and r.taken in (0, r.size, 2 * r.size, 3 * r.size)
        s = docs[r.doc_id].source
        sizes[s] = sizes.get(s, 0) + r.size
        taken[s] = taken.get(s, 0) + r.taken
        largest[s] = max(largest.get(s, 0), r.size)
    want = mixing.targets(sizes)
    for r in rows:
        s = docs[r.doc_id].source
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6
    assert all(abs(taken[s] - want[s]) <= max(0.05 * want[s], largest[s] / 2) for s in sizes)
    assert rows and sorted(map(tuple, rows)) == sorted(map(tuple, mixing.op8_mixing(spark, SF).collect()))


def test_elias_fano_round_trip():
    rng = np.random.default_rng(0)
    for n, most in ((0, 1), (1, 1), (1, 10**12), (5, 2), (3000, 3000), (3000, 10**9), (4000, 50)):
        x = np.sort(rng.integers(0, most, n))
        head, data = token_files.EliasFano.of(x).dump()
        back = token_files.EliasFano.load(head, data)
        assert (back.select(np.arange(n)) == x).all()
        assert len(data) * 8 <= n * (2 + max(0, np.log2(max(most / max(n, 1), 1))) + 1) + 64 + token_files.BLOCK
        assert (back.select(np.arange(n)[::-7]) == x[::-7]).all()


TEXTS = [
    "a  b", "a   b \n\n c", "x\t y \n z", "<|endoftext|> hi", "", " lead", "trail ", "  x y　 z", "it's 'quoted' don't", "x² a²b ½", "a_b _c d__",
    "日本語 テスト。\nа", "a\n\nb\n", "\n", "word.\nWord\n", "a b c d", "İstanbul ŉ ǅ", "٣ ٤a", "é ño", None,
]


def reference(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_files.tokenizer_path())
    return [t.encode(x or "", add_special_tokens=False).ids + [0] for x in texts]


def test_piece_encoder_equals_the_tokenizer():
    got = token_files.PieceEncoder(token_files.tokenizer_path()).encode([t or "" for t in TEXTS])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [r[:-1] for r in reference(TEXTS)]


@pytest.mark.parametrize("shards", [1, 5])
def test_round_trip_with_odd_rows(spark, tmp_path, shards):
    ids = [None, None, *range(-3, len(TEXTS) - 6), 2**40]
    data = [(i, t, "en", "s", 0) for i, t in zip(ids, TEXTS)] + [(7, "again", "en", "s", 0)] * 3
    docs = spark.createDataFrame(data, DOC).withColumn("start", F.lit(1)).withColumn("id", F.lit(1))
    folder = f"file:{tmp_path}/corpus"
    manifest = token_files.write_corpus(docs, folder, token_files.tokenizer_path(), shards=shards)
    got = sorted(token_files.read_corpus(spark, folder, with_ids=True).collect(), key=lambda r: r.start)
    want = dict(zip(map(repr, data), reference([d[1] for d in data])))
    assert len(got) == len(data) and sum(len(r.ids) for r in got) == manifest["tokens"]
    assert [r.doc_id for r in got] == sorted((d[0] for d in data), key=lambda i: (i is not None, i or 0))
    assert sorted((repr(r.doc_id), r.ids) for r in got) == sorted((repr(d[0]), want[repr(d)]) for d in data)
    at = 0
    for r in got:
        assert (r.start, r.n_tokens) == (at, len(r.ids)) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    empty = f"file:{tmp_path}/empty"
    token_files.write_corpus(docs.limit(0), empty, token_files.tokenizer_path())
    assert token_files.read_corpus(spark, empty).count() == 0


@needs_data
def test_op6_against_the_tokenizer(spark):
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda r: r.doc_id)
    got = sorted(token_files.op6_token_files(spark, SF).collect(), key=lambda r: r.doc_id)
    at = 0
    for d, r, ids in zip(docs, got, reference([d.text for d in docs]), strict=True):
        assert tuple(r) == (d.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


@needs_data
def five_words(text):
    """The set of the text's shingles of five words, A-Z lower-cased."""
    w = text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_pipeline_stage_by_stage(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_dedup", "decontamination", "mixing", "token_files"] and corpus_pipeline.ORACLE_SQL is None
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [words_of(r.text.encode()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {tuple(w[k : k + 10]) for w in bench for k in range(max(1, len(w) - 9))}
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(written(stage(spark, seen[-1], SF)))
    rows = [sorted(d.collect(), key=lambda r: r.doc_id) for d in seen]
    assert all(d.columns == docs.columns for d in seen[:5])
    judged, c = quality_rules.quality_rules(docs)
    assert [r.doc_id for r in rows[1]] == sorted(r.doc_id for r in judged.where(f"{c}.kept").collect())
    sets = {r.doc_id: five_words(r.text) for r in rows[1]}
    left = {r.doc_id for r in rows[2]}
    for d in sets:  # what went has a link to something that was there, what stayed has none among the rest
        near = {e for e in sets if e != d and 5 * len(sets[d] & sets[e]) >= 4 * len(sets[d] | sets[e])}
        assert near if d not in left else not near & left
    assert [r.doc_id for r in rows[3]] == [r.doc_id for r in rows[2]]
    for a, b in zip(rows[2], rows[3]):
        w = words_of(b.text.encode())
        assert not any(tuple(w[k : k + 10]) in windows for k in range(len(w) - 9))
        had = words_of(a.text.encode())
        if not any(tuple(had[k : k + 10]) in windows for k in range(len(had) - 9)):
            assert a == b
    assert {r.doc_id for r in rows[4]} <= {r.doc_id for r in rows[3]}
    copies = [r.doc_id for r in rows[4]]
    assert max(copies.count(d) for d in set(copies)) <= 3
    assert [r.doc_id for r in rows[5]] == copies
    assert sorted(r.n_tokens for r in rows[5]) == sorted(map(len, reference([r.text for r in rows[4]])))
    assert corpus_pipeline.run(spark, SF).columns == seen[-1].columns


def test_pipeline_on_odd_tables(spark, tmp_path):
    text = " ".join(f"some{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(120))
    data = [(1, text, "en", None, None), (1, text, "en", None, None), (None, text + " more", None, "s", 3), (3, None, None, None, None), (4, "", "en", "s", 0)]
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, rows in (("some", data), ("none", [])):
        docs = spark.createDataFrame(rows, DOC).withColumn("hits", F.lit(1)).withColumn("text_hash", F.lit(2)).withColumn("mix_copies", F.lit(3))
        for stage, f in corpus_pipeline.STAGES:
            docs = written(f(spark, docs, str(tmp_path)))
            assert stage == "token_files" or docs.columns[5:] == ["hits", "text_hash", "mix_copies"]
        assert (docs.count() > 0) == (name == "some")
