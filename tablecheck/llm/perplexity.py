"""Quality by perplexity under an interpolated modified Kneser-Ney n-gram model (operator 9).

The model is over characters (lower-cased), ORDER at a time, trained on trusted documents: those labelled
as of good quality. A document's perplexity is per character, and a document stays if it is at most the
QUANTILE of its language's trusted documents, times MARGIN. Character grams are few enough to count over
all of a corpus in every language, and their counts are summed in each task before they are shuffled.

* Counting: the distinct grams of all documents, with their counts in trusted ones, come from one pass.
* Model: continuation counts, discounts and context totals are groupings of the gram table, and a gram's
  interpolated probability joins them order by order, sharded by gram. Grams that no trusted document has
  get the probability of their lower orders.
* Scoring: the log-probabilities of the grams go to the tasks in shards of at most SHARD_GRAMS grams. A
  shard adds the log-probabilities of its grams to each document's sum, so what a task holds is bounded
  and any number of grams is scored exactly.

Null and empty texts have no characters: their perplexity is null and they do not stay. A language with
fewer than MIN_DOCS trusted documents (of MIN_CHARS characters or more) has no threshold, and its texts stay: what the other
languages have bears on no language's threshold. A null language takes the threshold of all trusted documents. Texts below MIN_CHARS characters are too short to condemn and stay. Without trusted documents all
perplexities are the alphabet's size and all texts stay. Labels of repeated rows: trusted if any row says
so; repeated documents count as often as they occur. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecheck.llm.common import slices, table, tidy, written

ORDER = 5
QUANTILE = 0.99
MARGIN = 1.05
MIN_CHARS = 200
MIN_DOCS = 20
SHARD_GRAMS = 4_000_000
# A task hands on its grams when it holds this many.
FLUSH_GRAMS = 1_500_000
# Ids of trusted documents, and languages, are broadcast up to so many, and joined by key beyond.
BROADCAST_IDS = 2_000_000
BROADCAST_LANGS = 10_000
PAD = "\x02"


def _hash(codes: np.ndarray, n: int) -> np.ndarray:
    """Of the n codes that end at each position from n - 1 on."""
    h = np.zeros(len(codes) - n + 1, np.uint64)
    for k in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[k : len(codes) - n + 1 + k]
    return h


def grams(texts: list[bytes | None], order: int) -> tuple[str, np.ndarray, np.ndarray]:
    """The texts lower-cased and padded in one string, the hash of each character's gram, and each text's
    number of characters. The gram of the i-th character of text d starts at place i + d * (order - 1)
    plus the characters of earlier texts."""
    lower = [t.decode().lower() if t else "" for t in texts]
    pads = PAD * (order - 1)
    joined = "".join(pads + t for t in lower)
    n = np.array([len(t) for t in lower], np.int64)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    starts = np.arange(n.sum()) + np.repeat(np.arange(len(n)) * (order - 1), n)
    return joined, _hash(codes, order)[starts] if n.sum() else np.zeros(0, np.uint64), n


def _gather(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(gram, n): the task's grams with their counts in trusted texts."""
        held: dict[int, int] = {}
        names: list[str] = []
        counts: list[np.ndarray] = [np.zeros(0, np.int64)]

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts[0][: len(names)])], names=["gram", "n"])
            held.clear()
            names.clear()
            counts[0] = np.zeros(0, np.int64)
            return out

        for batch in batches:
            trusted, at = batch.column(1).to_numpy(zero_copy_only=False), 0
            for part in slices(batch.column(0), 4 << 20):
                joined, h, n = grams(part, order)
                weight = np.repeat(trusted[at : at + len(part)].astype(np.float64), n)
                at += len(part)
                codes, distinct = pd.factorize(h)
                count = np.bincount(codes, weights=weight, minlength=len(distinct)).astype(np.int64)
                first = np.zeros(len(distinct), np.int64)
                first[codes[::-1]] = np.arange(len(h))[::-1]
                place = first + (order - 1) * (np.searchsorted(np.cumsum(n), first, side="right"))
                number = np.empty(len(distinct), np.int64)
                for k, key in enumerate(distinct.tolist()):
                    i = held.get(key)
                    if i is None:
                        i = held[key] = len(names)
                        p = int(place[k])
                        names.append(joined[p : p + order])
                    number[k] = i
                if len(names) > len(counts[0]):
                    counts[0] = np.concatenate([counts[0], np.zeros(len(names), np.int64)])
                counts[0][number] += count
                if len(names) > FLUSH_GRAMS:
                    yield rows()
        if names:
            yield rows()

    return run


def trusted_ids(labels: DataFrame, id: str = "doc_id", label: str = "quality") -> DataFrame:
    ids = written(labels.where((F.col(label) == 1) & F.col(id).isNotNull()).select(F.col(id).alias("trusted_id")).distinct())
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def count_grams(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, n) of a table (text, trusted)."""
    return texts.mapInArrow(tidy(_gather(order)), "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _discounts(counts: DataFrame) -> list[float]:
    """Modified Kneser-Ney discounts of counts 1, 2, and 3 or more."""
    n1, n2, n3, n4 = (x or 0 for x in counts.agg(*[F.sum((F.col("n") == k).cast("long")) for k in (1, 2, 3, 4)]).first())
    if not (n1 and n2 and n3 and n4):
        return [0.5, 0.75, 0.9]
    y = n1 / (n1 + 2 * n2)
    return [min(max(d, 0.05), k - 0.05) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))]


def log_probabilities(gram_counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, log_p) of every gram of a table (gram, n), whether trusted texts have it or not."""
    wanted = {order: gram_counts.select("gram")}
    counts = {order: gram_counts.where("n > 0")}
    for k in range(order - 1, 0, -1):
        tail = F.substring("gram", 2, order)
        wanted[k] = wanted[k + 1].select(tail.alias("gram")).distinct()
        # How many different characters the trusted texts have before it.
        counts[k] = counts[k + 1].groupBy(tail.alias("gram")).agg(F.count(F.lit(1)).alias("n"))
    wanted[1] = written(wanted[1])
    symbols = max(wanted[1].count(), 1)
    known = None
    for k in range(1, order + 1):
        seen = counts[k] = written(counts[k])
        d = _discounts(seen)
        cut = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        context = F.substring("gram", 1, k - 1) if k > 1 else F.lit("")
        of_context = seen.groupBy(context.alias("context")).agg(F.sum("n").alias("total"), F.sum(cut).alias("left"))
        rows = wanted[k].join(seen, "gram", "left").withColumn("context", context).join(of_context, "context", "left")
        if known is None:
            rows = rows.withColumn("lower", F.lit(1.0 / symbols))
        else:
            lower = known.toDF("tail", "lower")
            rows = rows.withColumn("tail", F.substring("gram", 2, order)).join(lower, "tail", "left")
        kept = F.coalesce(F.greatest(F.col("n") - cut, F.lit(0.0)), F.lit(0.0))
        p = F.when(F.col("total").isNull(), F.col("lower")).otherwise((kept + F.col("left") * F.col("lower")) / F.col("total"))
        known = written(rows.select("gram", p.alias("p")))
    return known.select("gram", F.log("p").alias("log_p"))


def _score(shard, order: int):
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        keys, values = shard.value
        for texts, before in batches:
            sums, sizes = [np.zeros(0)], [np.zeros(0, np.int64)]
            for part in slices(texts, 4 << 20):
                _, h, n = grams(part, order)
                codes, distinct = pd.factorize(h)
                at = np.minimum(np.searchsorted(keys, distinct), max(len(keys) - 1, 0))
                each = np.where(keys[at] == distinct, values[at], 0.0) if len(keys) else np.zeros(len(distinct))
                ends = np.concatenate([[0.0], np.cumsum(each[codes], dtype=np.float64)])
                stop = np.cumsum(n)
                sums.append(ends[stop] - ends[stop - n])
                sizes.append(n)
            total = np.concatenate(sums) + before.field("log_p").fill_null(0.0).to_numpy(zero_copy_only=False)
            yield pa.StructArray.from_arrays([pa.array(np.concatenate(sizes)), pa.array(total)], names=["n_chars", "log_p"])

    return run


def add_log_likelihood(docs: DataFrame, probabilities: DataFrame, text: str, out: str, order: int = ORDER, shard_grams: int = SHARD_GRAMS) -> DataFrame:
    """The documents with a struct (n_chars, log_p) in column ``out``."""
    spark = docs.sparkSession
    shards = max(1, -(-probabilities.count() // shard_grams))
    docs = docs.withColumn(out, F.lit(None).cast("struct<n_chars:bigint,log_p:double>"))
    for s in range(shards):
        part = probabilities.where(F.pmod(F.xxhash64("gram"), F.lit(shards)) == s).toArrow()
        joined = "".join(part.column("gram").to_pylist())
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64).reshape(-1, order)
        h = np.zeros(len(codes), np.uint64)
        for k in range(order):
            h = h * np.uint64(0x9E3779B97F4A7C15) + codes[:, k]
        sort = np.argsort(h)
        shard = spark.sparkContext.broadcast((h[sort], part.column("log_p").to_numpy()[sort].astype(np.float32)))
        score = F.arrow_udf(tidy(_score(shard, order)), "n_chars long, log_p double").asNondeterministic()
        docs = docs.withColumn(out, score(F.col(text).cast("string"), F.col(out)))
    return docs


def judge(
    scored: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
    broadcast_langs: int = BROADCAST_LANGS,
) -> DataFrame:
    """Adds threshold and kept to a table with columns lang, trusted, n_chars and perplexity."""
    fair = scored.where(F.col("trusted") & (F.col("n_chars") >= min_chars))
    at = F.percentile_approx("perplexity", quantile, 10000)
    overall = fair.agg(at.alias("limit")).first()["limit"]
    by_lang = fair.where("lang is not null").groupBy("lang").agg(at.alias("of_lang"), F.count(F.lit(1)).alias("docs"))
    by_lang = written(by_lang.where(F.col("docs") >= min_docs).drop("docs"))
    rows = scored.join(F.broadcast(by_lang) if by_lang.count() <= broadcast_langs else by_lang, "lang", "left")
    limit = F.when(F.col("lang").isNull(), F.lit(overall).cast("double")).otherwise(F.col("of_lang")) * margin
    rows = rows.withColumn("threshold", limit).drop("of_lang")
    fits = F.coalesce(F.col("perplexity") <= F.col("threshold"), F.col("threshold").isNull())
    return rows.withColumn("kept", (F.col("n_chars") > 0) & ((F.col("n_chars") < min_chars) | fits))


def classify(
    docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", order: int = ORDER, **limits
) -> DataFrame:
    """One row per document: doc_id, lang, trusted, n_chars, perplexity, threshold and kept."""
    ids = trusted_ids(labels, id)
    rows = docs.select(F.col(id).alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    rows = rows.join(ids, F.col("doc_id") == F.col("trusted_id"), "left")
    rows = rows.withColumn("trusted", F.col("trusted_id").isNotNull()).drop("trusted_id")
    counted = written(count_grams(rows.select("text", "trusted"), order))
    scored = add_log_likelihood(rows, log_probabilities(counted, order), "text", "score", order)
    n = F.col("score")["n_chars"]
    perplexity = F.when(n > 0, F.exp(-F.col("score")["log_p"] / n))
    scored = written(scored.select("doc_id", "lang", "trusted", n.alias("n_chars"), perplexity.alias("perplexity")))
    return judge(scored, **limits)


def op9_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
