"""Language identification with a linear-chain conditional random field (operator 2).

Each word of a text is labelled with a language. A word's features are its affixes, its character 2- and
3-grams, the word itself, and the languages whose lexicon (words of the training sample seen in one
language only) holds it; transitions between the labels of neighbours are learned too. Labels are
posteriors by forward-backward over the whole text, and the document's language has the largest mean.

Only documents have labels, so training text is made code-switched: spans of words of differently
labelled documents are strung together, which gives every word a label and the transitions their weight.
The sample is bounded: SAMPLE_DOCS documents of the training fold by a hash of their id, and SPANS spans of
SPAN words spread evenly over each text.

Forward-backward runs over pieces of PIECE words at once: the pieces' transfer matrices are multiplied
first, messages pass from piece to piece, then every piece is solved between its two messages. That is
exact, and a very long text takes few steps.

``und`` (score 0) where the text is null or has no letter, or nothing could be learned. Ties go to the first
language by code point. Rows with a null label or null text teach nothing; repeated rows are predicted one
by one; other columns are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecheck.llm.common import free_name, held_out, slices, table, tidy

SAMPLE_DOCS = 4000
SPANS = 4
SPAN = 12
BITS = 16
STEPS = 80
PENALTY = 1e-6
PIECE = 64
# Words a task remembers.
REMEMBER = 300_000
SLICE = 2 << 20
RESULT = "lang string, score double, n_words long, runs array<struct<lang:string,start:long,end:long>>"

WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    words = WORD.findall(text.lower()) if text else []
    return words if any(c.isalpha() for w in words for c in w) else []


def features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(owner, feature): numbers of words and of their hashed features, for all words at once.

    A word between ^ and $ gives its 2- and 3-grams, its first and last three letters with the mark beside
    them, itself, and, past the hashed numbers, one for the language whose lexicon holds it.
    """
    size = np.array([len(w) + 2 for w in words], np.int64)
    c = np.frombuffer("".join([f"^{w}$" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(c)) - np.repeat(np.cumsum(size) - size, size)
    left = np.repeat(size, size) - place
    mask = np.uint32((1 << BITS) - 1)
    owners, found, h = [], [], c
    for n in (2, 3, 4):
        h = h[:-1] * np.uint32(0x01000193) + c[n - 1 :] * np.uint32(0x9E3779B1)
        at = np.flatnonzero(left[: len(h)] >= n)
        if n == 4:
            at = at[(place[at] == 0) | (left[at] == n)]
        mixed = (h[at] ^ (h[at] >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        owners.append(owner[at])
        found.append(((mixed >> np.uint32(16)) ^ np.uint32(n * 0x3D4D)) & mask)
    owners.append(np.arange(len(words)))
    found.append(np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words], np.uint32) & mask)
    listed = [(k, (1 << BITS) + lexicon[w]) for k, w in enumerate(words) if w in lexicon]
    owners.append(np.array([k for k, _ in listed], np.int64))
    found.append(np.array([f for _, f in listed], np.int64))
    return np.concatenate(owners), np.concatenate([f.astype(np.int64) for f in found])


def add_up(owner: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of ``values`` by owner."""
    return np.stack([np.bincount(owner, weights=values[:, j], minlength=n) for j in range(values.shape[1])], axis=1)


def spans(words: list[str]) -> list[list[str]]:
    """SPANS spans of SPAN words, spread evenly over the whole text; all of a shorter text."""
    if len(words) <= SPANS * SPAN:
        return [words[k : k + SPAN] for k in range(0, len(words), SPAN)]
    step = (len(words) - SPAN) / (SPANS - 1)
    return [words[int(k * step) : int(k * step) + SPAN] for k in range(SPANS)]


def sample(docs: DataFrame, id: str, text: str, lang: str, n: int) -> list[tuple[str, list[str]]]:
    """(language, span) of at most ``n`` documents, as evenly from the languages as they have documents.

    Different ids are put in the order of a hash, whose rank in the language follows from the language's number of ids; those of
    the lowest ranks are the sample. An id counts once in a language, with its smallest text, however many rows it has.
    """
    rows = docs.select(F.col(id).alias("k"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = rows.where(~held_out("k") & F.col("k").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    ids = rows.select("k", "lang").distinct()
    rank = F.pmod(F.xxhash64("k"), F.lit(1 << 52)) / float(1 << 52) * F.col("ids")
    ids = ids.join(ids.groupBy("lang").agg(F.count(F.lit(1)).alias("ids")), "lang").withColumn("rank", rank)
    # of no language are more than about n wanted, so little is left to sort
    ids = ids.where(F.col("rank") <= n + 1).orderBy("rank", F.xxhash64("k"), "k", "lang").limit(n).select("k", "lang")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(lg, " ".join(s)) for t, lg in zip(*map(pa.Array.to_pylist, batch.columns)) for s in spans(words_of(t))]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.string()) for k in (0, 1)], names=["lang", "span"])

    chosen = rows.join(F.broadcast(ids), ["k", "lang"]).groupBy("k", "lang").agg(F.min("text").alias("text")).select("text", "lang")
    found = chosen.mapInArrow(tidy(take), "lang string, span string").collect()
    return sorted((r["lang"], r["span"].split(" ")) for r in found)


def forward_backward(emit: np.ndarray, ends: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Posteriors of the labels. ``emit``: potentials of all words of all texts, by word and label;
    ``ends``: where each text ends; ``move``: potentials of (label, next label)."""
    k = emit.shape[1]
    lengths = np.diff(np.concatenate([[0], ends]))
    per_doc = -(-lengths // PIECE)
    doc = np.repeat(np.arange(len(lengths)), per_doc)
    rank = np.arange(len(doc)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
    start = np.repeat(ends - lengths, per_doc) + rank * PIECE
    size = np.minimum(PIECE, np.repeat(ends, per_doc) - start)
    at = np.minimum(start[:, None] + np.arange(PIECE), len(emit) - 1)
    first, n = rank == 0, len(doc)

    def norm(x: np.ndarray, axes) -> np.ndarray:
        return x / np.maximum(x.sum(axis=axes, keepdims=True), 1e-300)

    # Transfer matrix of each piece: the move into each word, then its potential.
    through = np.broadcast_to(np.eye(k), (n, k, k)).copy()
    for t in range(PIECE):
        on = size > t
        step = through[on] @ move if t else np.where(first[on, None, None], through[on], through[on] @ move)
        through[on] = norm(step * emit[at[on, t]][:, None, :], (1, 2))
    # Messages into each piece from the left, and out of it from the right.
    left, right = np.full((n, k), 1.0 / k), np.full((n, k), 1.0 / k)
    by_rank = np.split(np.argsort(rank, kind="stable"), np.cumsum(np.bincount(rank))[:-1]) if n else []
    for p in by_rank[1:]:
        left[p] = norm(np.einsum("ni,nij->nj", left[p - 1], through[p - 1]), 1)
    for p in by_rank[:0:-1]:
        right[p - 1] = norm(np.einsum("nij,nj->ni", through[p], right[p]), 1)
    ahead = np.zeros((n, PIECE, k))
    a = left
    for t in range(PIECE):
        step = a @ move
        if t == 0:
            step = np.where(first[:, None], a, step)
        a = ahead[:, t] = norm(step * emit[at[:, t]], 1)
    out = np.zeros_like(emit)
    b = right.copy()
    for t in range(PIECE - 1, -1, -1):
        on = size > t
        out[at[on, t]] = norm(ahead[on, t] * b[on], 1)
        b[on] = norm((emit[at[on, t]] * b[on]) @ move.T, 1)
    return out


class Model:
    """``langs`` by code point; weights by feature and language; log potentials of moves."""

    def __init__(self, langs: list[str], lexicon: dict[str, int], weights: np.ndarray, moves: np.ndarray):
        self.langs, self.lexicon, self.weights, self.moves = langs, lexicon, weights, moves

    def log_potentials(self, words: list[str]) -> np.ndarray:
        owner, feature = features(words, self.lexicon)
        return add_up(owner, self.weights[feature], len(words))

    def predict_column(self, text: Column, with_runs: bool = False) -> Column:
        """Struct column with the fields of RESULT; runs (of words of one label) only if asked for."""
        langs, log_potentials = self.langs, self.log_potentials
        kind = pa.struct([
            ("lang", pa.string()), ("score", pa.float64()), ("n_words", pa.int64()),
            ("runs", pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))),
        ])

        def runs_of(best: np.ndarray) -> list[dict]:
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(best)) + 1, [len(best)]])
            return [{"lang": langs[best[a]], "start": int(a), "end": int(z)} for a, z in zip(cuts, cuts[1:])]

        def label(texts: list[bytes | None], known: dict[str, int], held: list[np.ndarray]) -> list[dict]:
            words = [words_of(t.decode()) if t else [] for t in texts]
            new = {w for ws in words for w in ws if w not in known}
            if len(known) + len(new) > REMEMBER:
                known.clear()
                held[0] = np.zeros((0, len(langs)))
                new = {w for ws in words for w in ws}
            if new:
                known.update(zip(new, range(len(known), len(known) + len(new))))
                held[0] = np.concatenate([held[0], log_potentials(list(new))])
            n = np.array([len(ws) for ws in words])
            ids = np.fromiter(map(known.__getitem__, chain.from_iterable(words)), np.int64, n.sum())
            out = [{"lang": "und", "score": 0.0, "n_words": 0, "runs": []} for _ in texts]
            full = np.flatnonzero(n)
            if not len(full):
                return out
            e = held[0][ids]
            ends = np.cumsum(n[full])
            share = forward_backward(np.exp(e - e.max(axis=1, keepdims=True)), ends, move)
            mean = np.add.reduceat(share, np.concatenate([[0], ends[:-1]]), axis=0) / n[full][:, None]
            for d, end, m in zip(full, ends, mean):
                k = int(np.argmax(m))
                out[d] = {"lang": langs[k], "score": float(min(m[k], 1.0)), "n_words": int(n[d]), "runs": []}
                if with_runs:
                    out[d]["runs"] = runs_of(np.argmax(share[end - n[d] : end], axis=1))
            return out

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            known: dict[str, int] = {}
            held = [np.zeros((0, len(langs)))]
            for batch in batches:
                yield pa.array([x for part in slices(batch, SLICE) for x in label(part, known, held)], kind)

        if not langs:
            null = "struct<lang:string,score:double,n_words:bigint,runs:array<struct<lang:string,start:bigint,end:bigint>>>"
            return F.from_json(F.lit('{"lang":"und","score":0.0,"n_words":0,"runs":[]}'), null)
        move = np.exp(self.moves - self.moves.max())
        return F.arrow_udf(tidy(run), RESULT).asNondeterministic()(text.cast("string"))


def fit(found: list[tuple[str, list[str]]]) -> Model:
    """Maximum likelihood with a penalty, by Adam over the whole sample."""
    found = [x for x in found if x[1] and x[1][0]]
    langs = sorted({lg for lg, _ in found})
    if not langs:
        return Model([], {}, np.zeros((0, 0)), np.zeros((0, 0)))
    seen: dict[str, dict[str, int]] = {}
    for lg, words in found:
        for w in words:
            seen.setdefault(w, {}).setdefault(lg, 0)
            seen[w][lg] += 1
    lexicon = {w: langs.index(next(iter(c))) for w, c in seen.items() if len(c) == 1 and sum(c.values()) > 1}
    # A word seen once must not be known by its lexicon only, or unseen words would meet an untrained model.
    rng = np.random.default_rng(0)
    lines = [found[i] for i in rng.permutation(len(found))]
    groups = [lines[i : i + SPANS] for i in range(0, len(lines), SPANS)]
    k, most = len(langs), SPANS * SPAN
    types = {w: i for i, w in enumerate(seen)}
    x, y = np.zeros((len(groups), most), np.int64), np.full((len(groups), most), -1, np.int64)
    for g, group in enumerate(groups):
        flat = [(types[w], langs.index(lg)) for lg, words in group for w in words][:most]
        x[g, : len(flat)], y[g, : len(flat)] = zip(*flat)
    owner, feature = features(list(seen), lexicon)
    n, on = (1 << BITS) + k, y >= 0
    gold = np.zeros((len(types), k))
    np.add.at(gold, (x[on], y[on]), 1)
    pair = on[:, 1:]
    gold_moves = np.zeros((k, k))
    np.add.at(gold_moves, (y[:, :-1][pair], y[:, 1:][pair]), 1)
    theta, total = np.zeros(n * k + k * k), on.sum()
    m, s = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        weights, moves = theta[: n * k].reshape(n, k), theta[n * k :].reshape(k, k)
        e = add_up(owner, weights[feature], len(types))
        emit, move = np.exp(e - e.max(axis=1, keepdims=True)), np.exp(moves - moves.max())
        ahead = np.zeros((len(groups), most, k))
        a = np.full((len(groups), k), 1.0 / k)
        for t in range(most):
            a = np.where(on[:, t, None], (a @ move if t else a) * emit[x[:, t]], a)
            a /= a.sum(axis=1, keepdims=True)
            ahead[:, t] = a
        want, want_moves, b = np.zeros_like(gold), np.zeros((k, k)), np.ones((len(groups), k))
        for t in range(most - 1, -1, -1):
            r = on[:, t]
            p = ahead[r, t] * b[r]
            p /= p.sum(axis=1, keepdims=True)
            for j in range(k):
                want[:, j] += np.bincount(x[r, t], weights=p[:, j], minlength=len(types))
            back = emit[x[r, t]] * b[r]
            if t:
                both = ahead[r, t - 1][:, :, None] * move[None] * back[:, None, :]
                want_moves += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            b[r] = back @ move.T
            b /= b.sum(axis=1, keepdims=True)
        off = (want - gold) / total
        g = np.concatenate([
            add_up(feature, off[owner], n).ravel(),
            ((want_moves - gold_moves) / total).ravel(),
        ]) + PENALTY * theta
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        theta = theta - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)
    return Model(langs, lexicon, theta[: n * k].reshape(n, k).astype(np.float32), theta[n * k :].reshape(k, k))


def train(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", sample_docs: int = SAMPLE_DOCS) -> Model:
    return fit(sample(docs, id, text, lang, sample_docs))


def identify(docs: DataFrame, model: Model, text: str = "text", with_runs: bool = False) -> tuple[DataFrame, str]:
    """The documents with a struct of RESULT beside their columns, and that column's name."""
    name = free_name(docs, "language")
    return docs.withColumn(name, model.predict_column(F.col(text), with_runs)), name


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out, c = identify(docs.select("doc_id", "text"), train(docs))
    return out.select(
        "doc_id", held_out().alias("held_out"), F.col(c)["lang"].alias("lang_pred"), F.col(c)["score"].alias("score"),
        F.col(c)["n_words"].alias("n_words"),
    )
