"""Language, toxicity, personal data, perplexity and quality rules: definitions, held-out accuracy and odd rows."""

import hashlib
import math
import os
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablecheck.llm import language, perplexity, pii, quality_rules, toxicity
from tablecheck.llm.common import held_out

SF = "/root/testdata/sf0.001"
SF2 = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(SF2), reason="benchmark tables not present")
DOC = "doc_id long, text string, lang string"


def test_forward_backward_is_exact():
    rng = np.random.default_rng(1)
    emit, move = rng.random((700, 3)), rng.random((3, 3))

    def plain(e):
        n, k = e.shape
        a, b = np.zeros((n, k)), np.ones((n, k))
        for i in range(n):
            a[i] = (a[i - 1] @ move if i else 1) * e[i]
            a[i] /= a[i].sum()
        for i in range(n - 2, -1, -1):
            b[i] = move @ (e[i + 1] * b[i + 1])
            b[i] /= b[i].sum()
        g = a * b
        return g / g.sum(axis=1, keepdims=True)

    ends = np.array([1, 3, 67, 131, 259, 700])
    got = language.forward_backward(emit, ends, move)
    for a, z in zip([0, *ends], ends):
        assert np.allclose(got[a:z], plain(emit[a:z]), atol=1e-12)


@needs_data
def test_language_of_held_out_documents(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF2}/documents.parquet").collect()}
    got = language.op2_language(spark, SF2).collect()
    out = [r for r in got if r.held_out]
    assert len(got) == len(truth) and len(out) > 200
    assert sum(r.lang_pred == truth[r.doc_id] for r in out) >= 0.98 * len(out)
    assert all(0 <= r.score <= 1 for r in got)


def test_code_switching_and_odd_rows(spark):
    words = {"en": "the house with green windows and the small garden", "de": "das haus mit grünen fenstern und der kleine garten"}
    data = [(k, words[lg] + f" {k}", lg) for k in range(60) for lg in words] + [(None, "x", "en"), (1, None, "en"), (2, "only text", None)]
    docs = spark.createDataFrame(data, DOC).withColumn("language", F.lit("taken"))
    model = language.train(docs)
    tests = [(0, words["en"] + " " + words["de"], None), (1, None, None), (2, "", None), (3, " 12 ² _!", None), (4, "Garten " * 5000, None), (5, "garden", None), (5, "garden", None)]
    out, c = language.identify(spark.createDataFrame(tests, DOC).withColumn("language", F.lit(1)), model, with_runs=True)
    got = defaultdict(list)
    for r in out.collect():
        got[r.doc_id].append(r[c])
    assert [(x["lang"], x["start"], x["end"]) for x in got[0][0]["runs"]] == [("en", 0, 9), ("de", 9, 18)]
    assert {(got[k][0]["lang"], got[k][0]["score"]) for k in (1, 2, 3)} == {("und", 0.0)}
    assert got[4][0]["lang"] == "de" and got[4][0]["n_words"] == 5000 and got[5][0] == got[5][1] and got[5][0]["lang"] == "en"
    nothing = language.train(docs.limit(0))
    out, c = language.identify(docs, nothing)
    assert {r[0] for r in out.select(F.col(c)["lang"]).collect()} == {"und"}


@needs_data
def test_toxicity_of_held_out_documents(spark):
    insults = re.compile(r"(?i)\b(?:idiot|moron|trash|pathetic|worthless|disgusting|stupid|clown)\b")
    truth = {r.doc_id: bool(insults.search(r.text or "")) for r in spark.read.parquet(f"{SF2}/documents.parquet").collect()}
    got = [r for r in toxicity.op7_toxicity(spark, SF2).collect() if r.held_out]
    caught = [r.predicted for r in got if truth[r.doc_id]]
    spared = [1 - r.predicted for r in got if not truth[r.doc_id]]
    assert len(caught) > 5 and np.mean(caught) >= 0.8 and np.mean(spared) >= 0.9


def test_toxicity_odd_rows(spark):
    data = [(k, ("you idiot " if k % 2 else "nice day ") + f"number {k}", "en") for k in range(80)]
    data += [(200, None, None), (201, "", None), (202, "ab", None), (203, "fine " * 30000 + "idiot", None), (None, "idiot", None)]
    docs = spark.createDataFrame(data, DOC).withColumn("score", F.lit(1))
    labels = spark.createDataFrame([(k, k % 2) for k in range(80)] + [(3, 0), (None, 1), (5, None), (900, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r.s for r in docs.select("doc_id", model.score_column(F.col("text")).alias("s")).collect()}
    assert all((got[k] >= 0.7) == bool(k % 2) for k in range(80))
    assert got[200] == got[201] == got[202] and got[203] > got[200] and all(0 <= s <= 1 for s in got.values())
    none = toxicity.train(docs, labels.limit(0))
    assert {round(r.s, 6) for r in docs.select(none.score_column(F.col("text")).alias("s")).collect()} == {0.0}


def brute_pii(t):
    patterns = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
    good = (
        lambda x: True, lambda x: all(int(p) <= 255 for p in x.split(".")),
        lambda x: 14 <= len(pii.digits_of(x)) <= 19 and pii.luhn(pii.digits_of(x)), lambda x: 10 <= len(pii.digits_of(x)) <= 15,
    )
    return sorted((m.start(), k, m.end()) for k, p in enumerate(patterns) for m in re.finditer(p, t) if good[k](m[0]))


TRICKY = [
    "a@b.c@d.e @b.c@d.e x@y @.a@b.co. a.b@c-d.e-f.gh, %@1.2 a@b.c.@d.e", "1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.4 1.2.3 255.255.255.255.",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 41111111111111110 4111  1111", "+1 (555) 010-9999 +12 +1234567890123456 ++49 30 123456-78 x+33.1.23.45.67.89",
    "é 4111111111111111 𝒳 a@b.de", "", "no data at all", "5" * 3000,
]


def test_base_spans_match_the_patterns():
    for t in TRICKY:
        assert pii.base_spans(t) == brute_pii(t), t


@needs_data
def test_op4_base_digest_and_added_spans(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF2}/documents.parquet").collect()}
    secrets = found = 0
    for r in pii.op4_pii(spark, SF2).collect():
        base = brute_pii(texts[r.doc_id])
        names = [f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base]
        assert r.base_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == j for _, k, _ in base) for j in range(4))
        assert set(names) <= set(r.spans.split(",")) | ({""} if not names else set())
        for m in re.finditer(r'token = "([0-9a-f]+)"', texts[r.doc_id]):
            secrets += 1
            found += f"secret:{m.start(1)}:{m.end(1)}" in r.spans.split(",")
    assert secrets and found == secrets


def test_pii_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None), (2, "", None), (None, "a@b.com", None), (3, "a@b.com " * 2000, None), (3, "a@b.com " * 2000, None)], DOC)
    docs = docs.withColumn("base", F.lit(0)).withColumn("f", F.lit(0))
    got = [(r.doc_id, len(r.base), len(r.spans)) for r in pii.find_pii(docs).collect()]
    assert sorted(got, key=repr) == sorted([(1, 0, 0), (2, 0, 0), (None, 1, 1), (3, 2000, 2000), (3, 2000, 2000)], key=repr)
    assert pii.find_pii(docs.limit(0)).count() == 0
    assert pii.masked("x a@b.com y", [{"start": 2, "kind": 0, "end": 9}]) == "x <email> y"


def test_expectation_maximisation_finds_the_bad_labeler():
    rng = np.random.default_rng(0)
    counts = Counter()
    for _ in range(4000):
        y = rng.random() < 0.4
        signs = "".join("+-"[int((rng.random() < a) != y)] for a in (0.95, 0.9, 0.9, 0.5, 0.85))
        counts["card", signs] += 1
    em = pii.Reliability(dict(counts))
    assert abs(em.share[2] - 0.4) < 0.05 and np.allclose([em.odds[1, j, 2] for j in (0, 1, 3)], [0.95, 0.9, 0.5], atol=0.05)


def brute_kneser_ney(trusted, everything, order):
    """log p of every gram, by the definition."""
    def grams(texts, n):
        out = Counter()
        for t in texts:
            s = "\x02" * (order - 1) + t.lower()
            out.update(s[i - order + 1 : i + 1][-n:] for i in range(order - 1, len(s)))
        return out

    counts = {order: grams(trusted, order)}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    symbols = len({g[-1] for g in grams(everything, order)})

    def discounts(c):
        n = [sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]
        if not all(n):
            return [0.5, 0.75, 0.9]
        y = n[0] / (n[0] + 2 * n[1])
        return [min(max(k - (k + 0) * y * n[k] / n[k - 1] - y * n[k] / n[k - 1], 0.05), k - 0.05) for k in (1, 2, 3)]

    def p(g):
        if not g:
            return 1 / symbols
        c, d = counts[len(g)], discounts(counts[len(g)])
        total = sum(v for x, v in c.items() if x[:-1] == g[:-1])
        if not total:
            return p(g[1:])
        left = sum(d[min(v, 3) - 1] for x, v in c.items() if x[:-1] == g[:-1])
        v = c.get(g, 0)
        return (max(v - d[min(v, 3) - 1], 0) if v else 0) / total + left / total * p(g[1:])

    return {g: math.log(p(g)) for g in grams(everything, order)}


def test_kneser_ney_matches_definition_in_any_number_of_shards(spark):
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("aabcdé 𝒳"), rng.integers(0, 60))) for _ in range(30)]
    data = spark.createDataFrame([(t, k < 15) for k, t in enumerate(texts)], "text string, trusted boolean")
    table = perplexity.log_probabilities(perplexity.count_grams(data, 3), 3)
    want = brute_kneser_ney(texts[:15], texts, 3)
    got = {r.gram: r.log_p for r in table.collect()}
    assert got.keys() == want.keys() and all(abs(got[g] - want[g]) < 1e-9 for g in want)
    sums = {}
    for shard in (10**6, 40):
        out = perplexity.add_log_likelihood(data, table, "text", "s", 3, shard)
        sums[shard] = {r.text: (r.s.n_chars, r.s.log_p) for r in out.collect()}
    for t in texts:
        s = "\x02\x02" + t
        total = sum(want[s[i - 2 : i + 1]] for i in range(2, len(s)))
        for shard in sums:
            assert sums[shard][t][0] == len(t) and abs(sums[shard][t][1] - total) < 1e-4


@needs_data
def test_op9_separates_junk(spark):
    good = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF2}/labels.parquet").collect()}
    got = [r for r in perplexity.op9_perplexity(spark, SF2).collect() if r.doc_id in good]
    assert np.mean([r.kept for r in got if good[r.doc_id]]) >= 0.98
    assert np.mean([r.kept for r in got if not good[r.doc_id]]) <= 0.4


def test_perplexity_odd_rows(spark):
    plain = "some plain words in a row, and again some plain words. " * 8
    data = [(k, plain, "en") for k in range(30)] + [(40, None, "en"), (41, "", "en"), (42, "§¶" * 300, None), (43, "§¶", "xx"), (None, plain, "en"), (1, plain, None)]
    docs = spark.createDataFrame(data, DOC).withColumn("trusted", F.lit(0)).withColumn("score", F.lit(0))
    labels = spark.createDataFrame([(k, 1) for k in range(20)] + [(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, quality int")
    got = {(r.doc_id, r.lang): r for r in perplexity.classify(docs, labels).collect()}
    assert got[40, "en"].perplexity is None and not got[40, "en"].kept and not got[41, "en"].kept
    assert not got[42, None].kept and got[43, "xx"].kept and got[None, "en"].kept and got[1, None].kept and got[25, "en"].kept
    free = perplexity.classify(docs, labels.limit(0)).where("n_chars > 0")
    assert {r.kept for r in free.collect()} == {True} and perplexity.classify(docs.limit(0), labels).count() == 0


def test_language_sample_is_even_and_takes_an_id_once(spark):
    def docs(first, n, lang, text):
        return spark.range(first, first + n).selectExpr("id AS doc_id", f"concat('{text} ', id) AS text", f"'{lang}' AS lang")

    many = spark.range(3_000).selectExpr("0L AS doc_id", "concat('zz copy ', id) AS text", "'en' AS lang")  # one id of very many rows
    rows = docs(0, 20_000, "en", "aa bb").unionByName(docs(50_000, 900, "fr", "cc dd")).unionByName(docs(60_000, 12, "xx", "ee")).unionByName(many)
    got = language.sample(rows, "doc_id", "text", "lang", 200)
    assert language.sample(rows.repartition(7), "doc_id", "text", "lang", 200) == got and len(got) == 200
    found = Counter(lang for lang, _ in got)
    learned = {r.doc_id for r in rows.where(~held_out("doc_id") & (F.col("lang") == "xx")).collect()}
    assert found["xx"] == len(learned) > 4 and abs(found["en"] - found["fr"]) < 50
    assert sum(s == ["zz", "copy"] for _, s in got) <= 1
    assert len(language.sample(rows.where("lang = 'xx'"), "doc_id", "text", "lang", 200)) == len(learned)


@pytest.mark.parametrize("broadcast_langs", [0, 10])
def test_thresholds_of_a_language_are_its_own(spark, broadcast_langs):
    def kept(others):
        own = [("xx", True, 300, 9.0 + k / 100) for k in range(20)] + [("xx", False, 300, 9.5), ("xx", False, 300, 30.0), ("xx", False, 30, 30.0)]
        few = [("yy", True, 300, 8.0)] * 19 + [("yy", True, 100, 1.0), ("yy", False, 300, 90.0), (None, False, 300, 90.0), ("xx", False, 0, None)]
        rows = spark.createDataFrame(own + few, "lang string, trusted boolean, n_chars long, perplexity double")
        en = spark.range(others).selectExpr("'en' AS lang", "true AS trusted", "300L AS n_chars", "5.0D AS perplexity")
        got = perplexity.judge(rows.unionByName(en), broadcast_langs=broadcast_langs).where("lang is null or lang <> 'en'").collect()
        return sorted((str(r.lang), r.n_chars, r.perplexity or 0, r.threshold or 0, r.kept) for r in got if r.lang), [r.kept for r in got if not r.lang]

    first, nulls = kept(10)
    assert kept(30_000)[0] == first and nulls == [False]
    limit = 9.19 * perplexity.MARGIN
    assert all(abs(t - limit) < 1e-9 for lang, _, _, t, _ in first if lang == "xx") and {t for lang, _, _, t, _ in first if lang == "yy"} == {0}
    # brute force: own limit, short texts stay, empty ones go, and no verdict for a language of 19
    assert all(k == (n > 0 and (n < 200 or lang == "yy" or p <= limit)) for lang, n, p, _, k in first)


def brute_counts(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(zip(words, words[1:], words[2:]))
    hit = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


ODD = ["", " \n\t", "a", "a b c a b c", "x\ny\nx\n \n \nx", "é\x85è\x1cü #*$ <>|&%", "a b c d\n" * 40, "w " * 200, "𝒳 𝒴 𝒵 𝒳 𝒴 𝒵"]


def test_base_counts_match_definition():
    for t in ODD:
        words, *rest = quality_rules.base_counts(t.encode())
        assert (len(words), *rest) == brute_counts(t), t


@needs_data
def test_op10_base_columns_and_verdicts(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF2}/documents.parquet").collect()}
    good = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF2}/labels.parquet").collect()}
    kept = {0: [], 1: []}
    for r in quality_rules.op10_quality_rules(spark, SF2).collect():
        n = brute_counts(docs[r.doc_id].text or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        failed = n[0] < 50 or 100 * n[4] > 50 * n[0]
        assert r.base_failed == failed and not (failed and r.kept)
        if r.doc_id in good and not failed:
            kept[good[r.doc_id]].append(r.kept)
    assert np.mean(kept[1]) == 1 and np.mean(kept[0]) < 0.3


def test_distances_match_definition():
    def js(p, q):
        p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
        m = [(a + b) / 2 for a, b in zip(p, q)]
        kl = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m) if x)
        return math.sqrt((kl(p) + kl(q)) / 2)

    p, q = [1, 2, 0, 5], [[4, 0, 0, 1], [1, 2, 0, 5]]
    assert np.allclose(quality_rules.js_distance(np.array(p), np.array(q)), [js(p, q[0]), 0])


def test_quality_rules_odd_rows(spark):
    clean = "the old house stands by the river and nobody has lived there for many long years now "
    text = clean + " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(90))
    data = [(k, text, "en") for k in range(20)] + [(30, None, "en"), (31, "", None), (32, text, None), (33, text, "xx"), (34, "### $$$ " + "%&*# " * 90 + text[:50], "en"), (None, text, "en")]
    docs = spark.createDataFrame(data, DOC).withColumn("quality_rules", F.lit(7)).withColumn("kept", F.lit("k"))
    kept = quality_rules.keep_clean(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [*range(20), 32, 33]
    assert kept.where("doc_id is null").count() == 1 and quality_rules.keep_clean(docs.limit(0)).count() == 0


def quality_rows(rng):
    """Documents of two invented languages of one script: words by rank, like those of a natural language."""
    word = lambda letters: "".join(rng.choice(list(letters), rng.integers(2, 8)))
    langs = {lg: [word(letters) for _ in range(3000)] for lg, letters in (("en", "abcdefgh"), ("de", "efghijkl"), ("ru", "абвгдежз"))}
    share = 1 / np.arange(1, 3001)
    return word, lambda lg, n: " ".join(rng.choice(langs[lg], n, p=share / share.sum()))


def test_other_language_and_random_letters_are_rejected(spark):
    word, text = quality_rows(np.random.default_rng(9))
    data = [(k, text(lg, 80 + 5 * k), lg) for lg in ("en", "de") for k in range(60)]
    odd = [(100, text("de", 300), "en"), (101, text("en", 300), "de"), (102, " ".join(word("abcdefghijkl") for _ in range(400)), "en")]
    rows = spark.createDataFrame(data + odd, "doc_id int, text string, lang string")
    kept = quality_rules.keep_clean(rows).collect()
    assert {r.doc_id for r in kept} == set(range(60)) and len(kept) >= 0.98 * len(data)


@pytest.mark.parametrize("sent", [1000, 1])
def test_rare_languages_keep_their_documents_and_their_reference(spark, monkeypatch, sent):
    monkeypatch.setattr(quality_rules, "SENT_LANGUAGES", sent)
    word, text = quality_rows(np.random.default_rng(4))
    few = [(k, text("ru", 200), "xx") for k in range(3)]  # too few for a reference
    some = [(10 + k, text("ru", 200), "ru") for k in range(20)] + [(40, text("en", 300), "ru")]
    many = [(100 + k, text("en", 100), "en") for k in range(200)] + [(400 + k, text("en", 100), None) for k in range(12)]
    rows = spark.createDataFrame(few + some + many, "doc_id int, text string, lang string")
    rows = rows.unionByName(spark.range(30000).selectExpr("cast(id + 1000 as int) doc_id", "'short' text", "'en' lang"))
    assert {r.doc_id for r in quality_rules.keep_clean(rows).collect() if r.doc_id < 100} == {0, 1, 2, *range(10, 30)}
