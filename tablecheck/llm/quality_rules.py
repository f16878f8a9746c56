"""Quality rules by distribution divergence (operator 10).

Every language of at least REFERENCE_DOCS documents and REFERENCE_WORDS words has a reference: the histogram of character
classes over all its documents, and the histogram of its words by rank: bins of rank 1, 2 to 3, 4 to 7 and
so on over its COMMON_WORDS most common words, and one bin for all other words. A document is compared with
the reference of its language by Jensen-Shannon distance (base 2, 0 to 1). It is rejected when it fails a
base rule or, from ``guard`` words on, when a distance is over its language's limit. Shorter documents are too
noisy to compare and pass the divergence test, and so do those whose language has no reference.

A language's limits are the outer fences of the distances of all its documents of ``guard`` words or more:
the third quartile plus FENCE times the distance of the quartiles, counted exactly in steps of 1/1000, so
that up to a quarter of junk does not move them much; and at least CLASS_FLOOR and WORD_FLOOR.

A null language is a language of its own. Null text counts as no words (base rules reject it). Empty tables
give empty results, repeated rows are judged one by one, and other columns are never looked at.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablecheck.llm.common import free_name, slices, table, tidy, written

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
# Nine bins of ranks and one for all other words.
COMMON_WORDS = 511
GUARD = 80
FENCE = 3.0
CLASS_FLOOR = 0.25
WORD_FLOOR = 0.2
# What a language needs for a reference, however large the others are.
REFERENCE_DOCS = 10
REFERENCE_WORDS = 1000
# The references of the largest languages go to all tasks; those of others, each below a thousandth of the
# documents, are joined to their documents.
SENT_LANGUAGES = 1000
# A task hands on its word counts when it holds this many words.
FLUSH_WORDS = 150_000

SPACES = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
NAMES = ("lower", "upper", "digit", "space", "sentence", "symbol", "other", "beyond_ascii")
RESULT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "class_distance double, word_distance double, kept boolean"
)


def _classes() -> np.ndarray:
    """Class of each byte; bytes that continue a character have class -1."""
    out = np.full(256, NAMES.index("other"))
    for b in range(256):
        c = bytes([b])
        if b >= 0xC0:
            out[b] = NAMES.index("beyond_ascii")
        elif b >= 0x80:
            out[b] = -1
        elif c.islower():
            out[b] = NAMES.index("lower")
        elif c.isupper():
            out[b] = NAMES.index("upper")
        elif c.isdigit():
            out[b] = NAMES.index("digit")
        elif c in SPACES:
            out[b] = NAMES.index("space")
        elif c in b".,;:!?'\"()-":
            out[b] = NAMES.index("sentence")
        elif c in SYMBOLS:
            out[b] = NAMES.index("symbol")
    return out


CLASS_OF = _classes()
CONTINUES = bytes(range(0x80, 0xC0))


def class_counts(text: bytes) -> np.ndarray:
    per_byte = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    seen = CLASS_OF >= 0
    return np.bincount(CLASS_OF[seen], weights=per_byte[seen], minlength=len(NAMES))


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found at least twice."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, n)
    if len(ids) < 1 << 21:
        key = (w[:-2] << 42) | (w[1:-1] << 21) | w[2:]
    else:
        pairs = np.unique((w[:-1] << 32) | w[1:], return_inverse=True)[1].astype(np.int64)
        key = (pairs[:-1] << 32) | w[2:]
    _, at, count = np.unique(key, return_inverse=True, return_counts=True)
    twice = count[at] > 1
    if not twice.any():
        return 0
    hit = np.zeros(n, bool)
    for k in range(3):
        hit[k : n - 2 + k] |= twice
    return int(hit.sum())


def base_counts(text: bytes) -> tuple[list[bytes], int, int, int, int]:
    """The words, then word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    chars = len(text.translate(None, CONTINUES + SPACES))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    return words, chars, symbols, len(lines) - len(set(lines)), repeated_words(words)


def base_failed(n_words: int, n_repeat: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat > MAX_REPEAT_PERCENT * n_words


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of p from each row of q; all are counts or shares."""
    p = p / max(p.sum(), 1e-300)
    q = q / np.maximum(q.sum(axis=-1, keepdims=True), 1e-300)
    m = (p + q) / 2

    def kl(a: np.ndarray) -> np.ndarray:
        return np.where(a > 0, a * np.log2(np.where(a > 0, a, 1) / np.where(m > 0, m, 1)), 0).sum(axis=-1)

    return np.sqrt(np.clip((kl(p) + kl(q)) / 2, 0, 1))


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, kind, key, n): word counts, class counts and documents of each language in this task."""
    words: dict[str | None, Counter] = {}
    classes: dict[str | None, np.ndarray] = {}
    docs: Counter = Counter()
    schema = pa.schema([("lang", pa.string()), ("kind", pa.string()), ("key", pa.string()), ("n", pa.int64())])

    def rows() -> pa.RecordBatch:
        flat = [(k, "word", w.decode(), n) for k, c in words.items() for w, n in c.items()]
        flat += [(k, "class", NAMES[i], int(n)) for k, c in classes.items() for i, n in enumerate(c) if n]
        flat += [(k, "words", "", sum(c.values())) for k, c in words.items()]
        flat += [(k, "docs", "", n) for k, n in docs.items()]
        for held in (words, classes, docs):
            held.clear()
        return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*flat), schema.types)], schema=schema)

    for batch in batches:
        langs, at = batch.column(1).to_pylist(), 0
        for part in slices(batch.column(0)):
            for text, lang in zip(part, langs[at : at + len(part)]):
                docs[lang] += 1
                if text:
                    words.setdefault(lang, Counter()).update(text.split())
                    classes[lang] = classes.get(lang, 0) + class_counts(text)
            at += len(part)
            if sum(map(len, words.values())) > FLUSH_WORDS:
                yield rows()
    if docs or words:
        yield rows()


def references(docs: DataFrame, text: str = "text", lang: str = "lang", words: int = COMMON_WORDS) -> DataFrame:
    """One row per language with a reference: lang, docs, classes as (key, n), words as (rank, key, n) and their total."""
    counted = docs.select(F.col(text).cast("string"), F.col(lang).cast("string")).mapInArrow(
        tidy(_gather), "lang string, kind string, key string, n long"
    )
    # One row per language, word and task: the sums are over bounded groups, whatever a language's share.
    sums = counted.groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    # The largest of each kind: every task hands on its own largest, and all of the kinds that are few.
    top = Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "key")
    ranked = sums.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= max(words, len(NAMES)))

    def of(kind: str, *names: str) -> Column:
        return F.collect_list(F.when(F.col("kind") == kind, F.struct(*names)))

    rows = ranked.groupBy("lang").agg(
        F.max(F.when(F.col("kind") == "docs", F.col("n"))).alias("docs"), F.max(F.when(F.col("kind") == "words", F.col("n"))).alias("total"),
        of("class", "key", "n").alias("classes"), of("word", "rank", "key", "n").alias("words"),
    )
    return rows.where((F.col("docs") >= REFERENCE_DOCS) & (F.col("total") >= REFERENCE_WORDS))


class Reference:
    """The reference of one language, from the JSON of its row."""

    def __init__(self, row: str):
        r = json.loads(row)
        self.rank = {w["key"].encode(): w["rank"].bit_length() - 1 for w in r["words"]}
        self.other = max(self.rank.values(), default=-1) + 1
        self.words = np.zeros(self.other + 1)
        for w in r["words"]:
            self.words[w["rank"].bit_length() - 1] += w["n"]
        self.words[-1] = r["total"] - self.words.sum()
        self.classes = np.zeros(len(NAMES))
        for c in r["classes"]:
            self.classes[NAMES.index(c["key"])] = c["n"]
        self.limits = r.get("class_limit"), r.get("word_limit")

    def distances(self, text: bytes, words: list[bytes]) -> tuple[float, float]:
        """Of the character classes and of the words by rank."""
        if not words:
            return 0.0, 0.0
        bins = np.bincount([self.rank.get(w, self.other) for w in words], minlength=self.other + 1)
        return float(js_distance(class_counts(text), self.classes)), float(js_distance(bins, self.words))


def _with_reference(docs: DataFrame, refs: DataFrame, lang: str, name: str, column) -> DataFrame:
    """Adds column ``name``: ``column(sent, own)``, for the references sent to all tasks by language, and a
    column with the row's own."""
    order = (F.desc("docs"), F.col("lang").asc_nulls_first())
    rows = refs.select("lang", "docs", F.to_json(F.struct(*refs.columns)).alias("ref"))
    sent = {r["lang"]: r["ref"] for r in rows.orderBy(*order).limit(SENT_LANGUAGES).collect()}
    if len(sent) < SENT_LANGUAGES or rows.count() == SENT_LANGUAGES:
        return docs.withColumn(name, column(sent, F.lit(None).cast("string")))
    own, key = (free_name(docs, x) for x in ("own_reference", "of_lang"))
    known = docs.sparkSession.createDataFrame([(k,) for k in sent], "lang string")
    rest = rows.join(F.broadcast(known.toDF("known")), F.col("lang").eqNullSafe(F.col("known")), "left_anti")
    large = F.broadcast(known.toDF(key))
    same = F.col(lang).cast("string").eqNullSafe(F.col(key))
    first = docs.join(large, same, "left_semi").withColumn(name, column(sent, F.lit(None).cast("string")))
    others = docs.join(large, same, "left_anti").join(rest.select(F.col("lang").alias(key), F.col("ref").alias(own)), same, "left")
    return first.unionByName(others.withColumn(name, column({}, F.col(own))).drop(key, own))


def _finder(sent: dict[str | None, str]):
    """Function from a language and the row's own reference to the reference, if any."""
    made: dict[str | None, Reference] = {}

    def find(lang: str | None, own: str | None) -> Reference | None:
        row = own or sent.get(lang)
        if row is None:
            return None
        if lang not in made:
            if len(made) >= SENT_LANGUAGES:
                made.clear()
            made[lang] = Reference(row)
        return made[lang]

    return find


def limits(
    docs: DataFrame, refs: DataFrame, text: str, lang: str, guard: int = GUARD, fence: float = FENCE,
    class_floor: float = CLASS_FLOOR, word_floor: float = WORD_FLOOR,
) -> DataFrame:
    """The references with class_limit and word_limit."""
    kinds = pa.struct([("class_", pa.float64()), ("word", pa.float64())])

    def column(sent: dict[str | None, str], own: Column) -> Column:
        def measure(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            find = _finder(sent)
            for texts, langs, owns in batches:
                out, langs, owns = [], langs.to_pylist(), owns.to_pylist()
                for part in slices(texts):
                    for t in part:
                        ref, words = find(langs[len(out)], owns[len(out)]), (t or b"").split()
                        d = ref.distances(t, words) if ref and len(words) >= guard else None
                        out.append(d and {"class_": round(d[0], 3), "word": round(d[1], 3)})
                yield pa.array(out, kinds)

        return F.arrow_udf(tidy(measure), "class_ double, word double").asNondeterministic()("text", "lang", own)

    rows = docs.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = _with_reference(rows, refs, "lang", "d", column).select("lang", "d").where("d is not null")
    kind = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col("d")[k].alias("x")) for k in ("class_", "word")])).alias("e")
    cells = rows.select("lang", kind).select("lang", "e.*").groupBy("lang", "kind", "x").agg(F.count(F.lit(1)).alias("n"))
    quarters = cells.groupBy("lang", "kind").agg(F.percentile("x", [0.25, 0.75], F.col("n")).alias("q"))
    top = F.col("q")[1] + fence * (F.col("q")[1] - F.col("q")[0])
    found = quarters.groupBy("lang").agg(*[
        F.max(F.when(F.col("kind") == k, F.greatest(top, F.lit(floor)))).alias(out)
        for k, floor, out in (("class_", class_floor, "class_limit"), ("word", word_floor, "word_limit"))
    ])
    found = found.withColumnRenamed("lang", "of_lang")
    return refs.join(found, F.col("lang").eqNullSafe(F.col("of_lang")), "left").drop("of_lang")


def verdict_column(sent: dict[str | None, str], own: Column, text: Column, lang: Column, guard: int = GUARD) -> Column:
    """Struct column with the fields of RESULT."""

    def judge(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        find = _finder(sent)
        for texts, langs, owns in batches:
            out, langs, owns = [], langs.to_pylist(), owns.to_pylist()
            for part in slices(texts):
                for t in part:
                    t, ref = t or b"", find(langs[len(out)], owns[len(out)])
                    words, chars, symbols, dup, rep = base_counts(t)
                    failed = base_failed(len(words), rep)
                    d = ref.distances(t, words) if ref else (0.0, 0.0)
                    far = bool(ref) and len(words) >= guard and any(top is not None and round(x, 3) > top for x, top in zip(d, ref.limits))
                    out.append((len(words), chars, symbols, dup, rep, failed, *d, not failed and not far))
            columns = list(zip(*out)) or [[]] * 9
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]
            names = [x.split()[0] for x in RESULT.split(", ")]
            yield pa.StructArray.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)

    # Not deterministic to the optimizer: it must not run twice for a filter and a projection.
    return F.arrow_udf(tidy(judge), RESULT).asNondeterministic()(text.cast("string"), lang.cast("string"), own)


def quality_rules(docs: DataFrame, text: str = "text", lang: str = "lang", guard: int = GUARD, **how) -> tuple[DataFrame, str]:
    """The documents with a struct of RESULT beside their columns, and that column's name."""
    refs = written(limits(docs, written(references(docs, text, lang)), text, lang, guard, **how))
    name = free_name(docs, "quality_rules")
    column = lambda sent, own: verdict_column(sent, own, F.col(text), F.col(lang), guard)
    return _with_reference(docs, refs, lang, name, column), name


def keep_clean(docs: DataFrame, text: str = "text", lang: str = "lang", **how) -> DataFrame:
    """The documents that pass, with their columns as they were."""
    judged, name = quality_rules(docs, text, lang, **how)
    return judged.where(F.col(name)["kept"]).drop(name)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    judged, name = quality_rules(docs)
    first = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged.select("doc_id", *[F.col(name)[c].alias(c) for c in (*first, "class_distance", "word_distance")])
