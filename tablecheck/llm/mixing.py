"""Mixing overlapping sources to target weights by min-cost flow (operator 8).

Documents are summed by membership pattern, the set of sources a document belongs to. Each pattern can
give its words once, twice and so on up to ``max_repeat`` times, and the k-th copy costs k squared, so
repetition is spread evenly. A min-cost flow routes these words to the sources' quotas; only patterns
and sources are in its graph, never documents. A pattern's flow is then met by whole copies of all its
documents plus one more copy of some: documents are seeded by a hash into buckets, and from the largest
size class (powers of two) down, the buckets that come nearest to the class's share are taken; what a
class misses is carried to the next, so the rest at the end is about one small document.

Null text has size 0. A null source is a source of its own, last in order. Repeated rows count as
often as they occur and are decided alike. A source without words has target 0. Other columns are not
looked at; result columns replace none of them (a free name is chosen).
"""

from __future__ import annotations

import heapq
import json
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecheck.llm.common import free_name, table, written

WEIGHTS = (5, 2, 1)
SHARE = 1.0
MAX_REPEAT = 3
SEED = 8
BUCKETS = 256
# The choice (at most 64 rows for each pattern) is broadcast up to this many patterns, and joined by key beyond.
BROADCAST_PATTERNS = 2000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], weights: tuple = WEIGHTS, share: float = SHARE, most: int = MAX_REPEAT) -> dict:
    """Words wanted from each source: weights by code point order (null last), repeating; a target stops
    at ``most`` times its source's size and the excess is shared anew by weight."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    want = share * sum(sizes.values())
    # sources that reach their limit first come first, so one pass finds all that do
    left, units, full = want, sum(weight.values()), set()
    for s in sorted(order, key=lambda s: sizes[s] / weight[s]):
        if left / units * weight[s] <= most * sizes[s]:
            break
        full.add(s)
        left, units = left - most * sizes[s], units - weight[s]
    held = want - sum(float(most * sizes[s]) for s in order if s in full)
    return {s: float(most * sizes[s]) if s in full else held / units * weight[s] for s in order}


def min_cost_flow(n: int, arcs: list[tuple[int, int, int, int]], source: int, sink: int) -> list[int]:
    """Flow on each arc (tail, head, capacity, cost >= 0) of a cheapest maximum flow: successive shortest
    paths with reduced costs."""
    head, room, cost, out = [], [], [], [[] for _ in range(n)]
    for a, b, cap, c in arcs:
        for tail, to, r, w in ((a, b, cap, c), (b, a, 0, -c)):
            out[tail].append(len(head))
            head.append(to)
            room.append(r)
            cost.append(w)
    level = [0] * n
    while True:
        dist, via, todo = [math.inf] * n, [-1] * n, [(0, source)]
        dist[source] = 0
        while todo:
            d, u = heapq.heappop(todo)
            if d > dist[u]:
                continue
            for e in out[u]:
                if room[e] and (w := d + cost[e] + level[u] - level[head[e]]) < dist[head[e]]:
                    dist[head[e]], via[head[e]] = w, e
                    heapq.heappush(todo, (w, head[e]))
        if dist[sink] == math.inf:
            return [room[2 * k + 1] for k in range(len(arcs))]
        far = dist[sink]
        level = [p + min(d, far) for p, d in zip(level, dist)]
        path, at = [], sink
        while at != source:
            path.append(via[at])
            at = head[via[at] ^ 1]
        step = min(room[e] for e in path)
        for e in path:
            room[e] -= step
            room[e ^ 1] += step


def route(patterns: dict[tuple, int], quota: dict[str | None, float], most: int = MAX_REPEAT) -> dict[tuple, int]:
    """Words to take from each pattern. Patterns and sources that are not connected are solved apart."""
    group: dict = {s: s for s in quota}

    def top(s):
        while group[s] != s:
            group[s] = group[group[s]]
            s = group[s]
        return s

    for p in patterns:
        for s in p[1:]:
            group[top(s)] = top(p[0])
    parts: dict = {}
    for p in patterns:
        parts.setdefault(top(p[0]), []).append(p)
    taken = {}
    for part in parts.values():
        sources = sorted({s for p in part for s in p}, key=lambda s: (s is None, s or ""))
        at = {s: 1 + len(part) + i for i, s in enumerate(sources)}
        end = 1 + len(part) + len(sources)
        arcs = [(0, 1 + i, patterns[p], k * k) for i, p in enumerate(part) for k in range(1, most + 1)]
        arcs += [(1 + i, at[s], most * patterns[p], 0) for i, p in enumerate(part) for s in p]
        arcs += [(at[s], end, round(quota[s]), 0) for s in sources]
        flow = min_cost_flow(end + 1, arcs, 0, end)
        for i, p in enumerate(part):
            taken[p] = sum(flow[most * i : most * (i + 1)])
    return taken


def _choose(taken: dict[str, int], words: dict[str, int]):
    """Last bucket of each size class whose documents get one more copy than the ``whole`` copies all get."""

    def run(cells: pd.DataFrame) -> pd.DataFrame:
        p, carry, out = cells["pattern"].iloc[0], 0.0, []
        whole, rest = divmod(taken[p], words[p]) if words[p] else (0, 0)
        for size_class, part in sorted(cells.groupby("size_class"), key=lambda x: -x[0]):
            part = part.sort_values("bucket")
            buckets, summed = [-1, *part["bucket"]], [0, *part["words"].cumsum()]
            goal = summed[-1] * rest / words[p] + carry if words[p] else 0.0
            k = min(range(len(summed)), key=lambda i: abs(summed[i] - goal))
            out.append((p, size_class, whole, buckets[k]))
            carry = goal - summed[k]
        return pd.DataFrame(out, columns=["pattern", "size_class", "whole", "last_bucket"])

    return run


def mix(
    docs: DataFrame, sources: Column, size: Column, key: Column, weights: tuple = WEIGHTS, share: float = SHARE,
    most: int = MAX_REPEAT, seed: int = SEED, quota: dict[str | None, float] | None = None,
) -> tuple[DataFrame, str, dict[str | None, int], dict[str | None, float]]:
    """The documents with the number of copies that the mix takes, that column's name, and the sources'
    sizes and targets.

    ``sources``: array of the sources a document belongs to (none: nothing is taken); ``key``: what seeds
    its choice; ``quota``: words by source in place of the weights.
    """
    c = {k: free_name(docs, f"mix_{k}") for k in ("size", "pattern", "size_class", "bucket", "pattern_of", "class_of", "whole", "last", "copies")}
    size = F.coalesce(size, F.lit(0))
    rows = docs.withColumns({
        c["pattern"]: F.to_json(F.array_sort(F.array_distinct(sources))),
        c["size"]: size,
        c["bucket"]: F.pmod(F.xxhash64(F.lit(seed), key), F.lit(BUCKETS)).cast("int"),
    }).withColumn(c["size_class"], F.floor(F.log2(F.greatest(F.col(c["size"]), F.lit(1)).cast("double"))).cast("int"))
    cells = rows.groupBy(c["pattern"], c["size_class"], c["bucket"]).agg(F.sum(c["size"]).alias("words"))
    cells = written(cells.toDF("pattern", "size_class", "bucket", "words").where("pattern is not null"))
    words = {r["pattern"]: int(r["words"]) for r in cells.groupBy("pattern").agg(F.sum("words").alias("words")).collect()}
    patterns = {tuple(json.loads(p)): n for p, n in words.items() if p != "[]"}
    sizes: dict[str | None, int] = {}
    for p, n in patterns.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    quota = targets(sizes, weights, share, most) if quota is None else {s: quota.get(s, 0.0) for s in sizes}
    flow = route(patterns, quota, most)
    taken = {p: flow.get(tuple(json.loads(p)), 0) for p in words}
    chosen = cells.groupBy("pattern").applyInPandas(
        _choose(taken, words), "pattern string, size_class int, whole int, last_bucket int"
    )
    chosen = written(chosen).toDF(c["pattern_of"], c["class_of"], c["whole"], c["last"])
    if len(words) <= BROADCAST_PATTERNS:
        chosen = F.broadcast(chosen)
    on = (F.col(c["pattern"]) == F.col(c["pattern_of"])) & (F.col(c["size_class"]) == F.col(c["class_of"]))
    more = (F.col(c["bucket"]) <= F.col(c["last"])).cast("int")
    out = rows.join(chosen, on, "left").withColumn(c["copies"], F.coalesce(F.col(c["whole"]) + more, F.lit(0)))
    return out.select(*docs.columns, c["copies"]), c["copies"], sizes, quota


def of_source(source: str = "source") -> Column:
    """One source per document; null is a source of its own."""
    return F.array(F.col(source).cast("string"))


def mixed(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The documents of the mix, each as often as it is taken, columns as they were."""
    rows, copies, _, _ = mix(docs, of_source(source), word_count(F.col(text)), F.struct(F.col(id), F.xxhash64(F.col(text))), **how)
    again = F.array_repeat(F.lit(True), F.col(copies))
    return rows.withColumn(copies, F.explode(again)).drop(copies)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = written(docs.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash")
    ))
    out, copies, sizes, quota = mix(rows, of_source(), F.col("size"), F.struct("doc_id", "text_hash"))
    known = [(s, sizes[s], float(quota[s])) for s in sizes]
    plan = spark.createDataFrame(known, "s string, source_size long, target double")
    if len(known) <= BROADCAST_PATTERNS:
        plan = F.broadcast(plan)
    out = out.join(plan, F.col("source").cast("string").eqNullSafe(F.col("s")), "left")
    taken = (F.col("size") * F.col(copies)).alias("taken")
    return out.select("doc_id", "size", "source_size", "target", taken, F.col(copies).alias("copies"))
