"""Rules of different scopes that may contradict each other, and their resolution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecheck.functions import scalars as S
from tablecheck.operators.rows import with_row_index
from tablecheck.operators.session import checkpointed
from tablecheck.operators.skew import dealt, each_pair, grid_join, pack_rows, packed, split_hot_join, with_pack
from tablecheck.operators.state import latest_per_key

# (first scope, second scope, shared parent column)
KINDS = (
    ("catalog", "table", "catalog_id"),
    ("table", "column", "table_id"),
    ("catalog", "column", "catalog_id"),
)


# Fixed value: the sentence on two rules of different scopes.
CONTRADICTION = (
    "Rules at '", "' and '", "' scope levels target overlapping fields with potentially contradictory constraints.",
)


def _clean_fields() -> Column:
    fields = F.coalesce(F.col("target_fields"), F.array().cast("array<string>"))
    return F.array_distinct(F.filter(fields, lambda f: f.isNotNull()))


def _keyed(rules: DataFrame, scope: str, parent: str, prefix: str) -> DataFrame:
    """One row per (rule, match key) such that two rules meet on exactly the keys that make
    them a conflict: a shared field, or a marker for "one side (or both) names no field"."""
    fields = F.col("__fields")
    own = F.transform(fields, lambda f: F.concat(F.lit("field:"), f))
    no_fields = F.size(fields) == 0
    first = prefix == "a"
    if first:
        keys = F.when(no_fields, F.array(F.lit("second only"), F.lit("neither"))).otherwise(
            F.array_append(own, F.lit("first only"))
        )
    else:
        keys = F.when(no_fields, F.array(F.lit("first only"), F.lit("neither"))).otherwise(
            F.array_append(own, F.lit("second only"))
        )
    side = rules.where((F.col("status") == "active") & (F.col("scope") == scope)).withColumn(
        "__fields", _clean_fields()
    )
    return side.select(
        F.col(parent).alias("parent_id"),
        F.explode(keys).alias("match_key"),
        F.col("rule_id").alias(f"{prefix}_rule_id"),
        F.col("scope").alias(f"{prefix}_scope"),
        fields.alias(f"{prefix}_fields"),
    ).where(F.col("parent_id").isNotNull())


def _members(rules: DataFrame, scope: str, parent: str) -> DataFrame:
    """Active rules of a scope: parent, sorted distinct target fields and id."""
    side = rules.where((F.col("status") == "active") & (F.col("scope") == scope) & F.col(parent).isNotNull())
    return side.select(F.col(parent).alias(parent), F.array_sort(_clean_fields()).alias("target_fields"), "rule_id")


def _pack_rows(rules: DataFrame, kind: tuple[str, str, str]) -> Column:
    """Rows of the packs of a kind, by the pairs of rules that share a parent."""
    first, second, parent = kind
    return pack_rows(_members(rules, first, parent), _members(rules, second, parent), [parent])


def _cells(rules: DataFrame, kind: tuple[str, str, str]) -> DataFrame:
    """Conflicts as pairs of packs: rules of one scope and parent with the same target fields are one set, a set is cut into
    packs, and every rule of the pack ``a`` is in conflict with every rule of the pack ``b``. Each conflict is in one row."""
    first, second, parent = kind
    sides, rows = [], _pack_rows(rules, kind)
    for scope, s in ((first, "a"), (second, "b")):
        packs = packed(_members(rules, scope, parent), [parent, "target_fields"], "rule_id", rows)
        packs = packs.withColumns({"status": F.lit("active"), "scope": F.lit(scope), "rule_id": F.struct("__pack", "rule_id")})
        sides.append(_keyed(packs, scope, parent, s))
    pairs = grid_join(*sides, ["parent_id", "match_key"], F.col("a_rule_id"), F.col("b_rule_id"))
    common = F.array_min(F.array_intersect("a_fields", "b_fields"))
    once = ~F.col("match_key").startswith("field:") | (F.col("match_key") == F.concat(F.lit("field:"), common))
    packs = [F.col(f"{s}_rule_id.{c}").alias(n) for s in "ab" for c, n in (("__pack", f"{s}_pack"), ("rule_id", s))]
    return pairs.where(once).select("parent_id", "a_scope", "b_scope", "a_fields", "b_fields", *packs)


def conflicts(rules: DataFrame, kind: tuple[str, str, str]) -> DataFrame:
    """Pairs of active rules of the two scopes under one parent whose target fields overlap,
    or where either side names none: every pair once. ``conflict_groups`` states the
    same in rows that grow with the rules.

    Sets of rules with equal fields are paired, not rules; their packs are dealt over the tasks, and a task writes out
    the pairs of its packs, so time follows the number of pairs, and no task holds or sorts them.
    """
    cells = _cells(rules, kind).select("parent_id", "a_scope", "b_scope", "a", "b")
    named = lambda r: F.struct(r.alias("rule_id"), r.cast("string").alias("text"))
    pairs = each_pair(dealt(cells), "a", "b", named)
    return pairs.select(
        S.pair_key(F.col("a.text"), F.col("b.text")).alias("pair_key"),
        F.col("a.rule_id").alias("rule_a"),
        "a_scope",
        F.col("b.rule_id").alias("rule_b"),
        "b_scope",
        "parent_id",
    )


def conflict_groups(rules: DataFrame, kind: tuple[str, str, str]) -> DataFrame:
    """All conflicts of a kind as groups: under one parent, every rule of the first scope with a match key conflicts with
    every rule of the second scope with that key. One row per rule and key, ``links`` being the rules on the other side.

    Only groups with both sides are listed. Two rules are in conflict exactly if they share a group, once for each shared
    field, so there are at most two rows more than target fields for each rule.
    """
    first, second, parent = kind
    keys = ["parent_id", "match_key"]
    a, b = _keyed(rules, first, parent, "a"), _keyed(rules, second, parent, "b")
    size = lambda side, name: side.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    both = size(a, "firsts").join(size(b, "seconds"), keys)
    parts = []
    for side, s, links in ((a, "a", "seconds"), (b, "b", "firsts")):
        rows = split_hot_join(side, both.select(*keys, F.col(links).alias("links")), keys, F.col(f"{s}_rule_id"))
        parts.append(rows.select(*keys, F.col(f"{s}_scope").alias("scope"), F.col(f"{s}_rule_id").alias("rule_id"), "links"))
    return parts[0].unionByName(parts[1])


def _alike(rules: DataFrame, scope: str, parent: str, prefix: str) -> DataFrame:
    """Rules of a scope with one parent and the same target fields, as one row with their number and smallest id."""
    side = rules.where((F.col("status") == "active") & (F.col("scope") == scope) & F.col(parent).isNotNull())
    side = side.select(F.col(parent).alias(parent), "rule_id", F.array_sort(_clean_fields()).alias("target_fields"))
    alike = side.groupBy(parent, "target_fields").agg(F.count(F.lit(1)).alias("n"), F.min("rule_id").alias("rule_id"))
    keyed = _keyed(alike.withColumns({"status": F.lit("active"), "scope": F.lit(scope)}), scope, parent, prefix)
    sizes = alike.select(F.col(parent).alias("parent_id"), F.col("target_fields").alias(f"{prefix}_fields"), F.col("n").alias(f"{prefix}_n"))
    return keyed.join(sizes, ["parent_id", f"{prefix}_fields"])


def _alike_pairs(rules: DataFrame, kind: tuple[str, str, str]) -> DataFrame:
    """Conflicts between sets of rules with the same parent and target fields: each pair of sets once."""
    first, second, parent = kind
    a, b = _alike(rules, first, parent, "a"), _alike(rules, second, parent, "b")
    pairs = grid_join(a, b, ["parent_id", "match_key"], F.col("a_rule_id"), F.col("b_rule_id"))
    common = F.array_min(F.array_intersect("a_fields", "b_fields"))
    return pairs.where(~F.col("match_key").startswith("field:") | (F.col("match_key") == F.concat(F.lit("field:"), common)))


def rule_conflicts(rules: DataFrame, kind: tuple[str, str, str]) -> DataFrame:
    """One row per rule with conflicts of a kind: the other scope, how many rules it conflicts with, and the smallest of them."""
    pairs = _alike_pairs(rules, kind)
    first, second, parent = kind
    parts = []
    for own, other, scope, facing in (("a", "b", first, second), ("b", "a", second, first)):
        found = pairs.groupBy("parent_id", F.col(f"{own}_fields").alias("__fields")).agg(
            F.sum(f"{other}_n").alias("conflicts"), F.min(f"{other}_rule_id").alias("partner_id")
        )
        side = rules.where((F.col("status") == "active") & (F.col("scope") == scope)).select(
            "rule_id", "scope", F.col(parent).alias("parent_id"), F.array_sort(_clean_fields()).alias("__fields")
        )
        rows = split_hot_join(side, found, ["parent_id", "__fields"], F.col("rule_id"))
        parts.append(rows.select("rule_id", "scope", F.lit(facing).alias("other_scope"), "parent_id", "conflicts", "partner_id"))
    return parts[0].unionByName(parts[1])


def conflict_totals(rules: DataFrame) -> DataFrame:
    """a_scope, b_scope, conflicts: the number of conflicting pairs of each kind, counted without listing them."""
    out = None
    for kind in KINDS:
        total = _alike_pairs(rules, kind).agg(F.sum(F.col("a_n") * F.col("b_n")).alias("conflicts"))
        total = total.select(F.lit(kind[0]).alias("a_scope"), F.lit(kind[1]).alias("b_scope"), "conflicts").where("conflicts is not null")
        out = out.unionByName(total) if out is not None else total
    return out


def all_conflicts(rules: DataFrame) -> DataFrame:
    """The three kinds together; scopes differ, so no pair can appear twice."""
    out = conflicts(rules, KINDS[0])
    for kind in KINDS[1:]:
        out = out.unionByName(conflicts(rules, kind))
    return out


def describe(conflicted: DataFrame) -> DataFrame:
    """Add the contradiction sentence."""
    before, between, after = map(F.lit, CONTRADICTION)
    text = F.concat(before, F.col("a_scope"), between, F.col("b_scope"), after)
    return conflicted.withColumn("contradiction_summary", text)


def _latest_resolutions(resolutions: DataFrame) -> DataFrame:
    columns = ["pair_key", "priority_rule_id", "resolved_by", "resolved_at"]
    return latest_per_key(resolutions.select(*columns), ["pair_key"], ["resolved_at", "priority_rule_id"])


def with_resolutions(conflicted: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Attach the latest resolution to each of some pairs; ``resolved`` tells whether there is one."""
    extra = ["priority_rule_id", "resolved_by", "resolved_at"]
    joined = conflicted.join(_latest_resolutions(resolutions).withColumn("__found", F.lit(True)), "pair_key", "left")
    return joined.select(*conflicted.columns, F.col("__found").isNotNull().alias("resolved"), *extra)


def resolved_conflicts(rules: DataFrame, resolutions: DataFrame) -> DataFrame:
    """The latest resolution of every conflict that has one: pair_key, rule_a and rule_b (the wider scope first), their
    scopes, parent_id, priority_rule_id, resolved_by and resolved_at.

    It starts from the resolutions: both rules of a pair are looked up by id, and the pair is tested on what was found, so no
    conflicts are listed. Rule ids contain no | (they are joined by it), and are unique.
    """
    latest = _latest_resolutions(resolutions)
    ids = F.split("pair_key", r"\|", 2)
    pairs = latest.withColumns({"__x": F.get(ids, F.lit(0)), "__y": F.get(ids, F.lit(1))})
    rank = F.when(F.col("scope") == "catalog", 0).when(F.col("scope") == "table", 1).when(F.col("scope") == "column", 2)
    active = rules.where(F.col("status") == "active")
    side = active.select("rule_id", "scope", "catalog_id", "table_id", _clean_fields().alias("fields"), rank.alias("rank"))
    for c, s in (("__x", "x"), ("__y", "y")):
        pairs = pairs.join(side.select(F.col("rule_id").cast("string").alias(c), F.struct("*").alias(s)), c)
    wide = F.col("x.rank") < F.col("y.rank")
    both = pairs.withColumns({"a": F.when(wide, F.col("x")).otherwise(F.col("y")), "b": F.when(wide, F.col("y")).otherwise(F.col("x"))})
    parent = None
    for first, second, column in KINDS:
        here = (F.col("a.scope") == first) & (F.col("b.scope") == second) & (F.col(f"a.{column}") == F.col(f"b.{column}"))
        parent = F.when(here, F.col(f"a.{column}")) if parent is None else parent.when(here, F.col(f"a.{column}"))
    meet = (F.size("a.fields") == 0) | (F.size("b.fields") == 0) | S.fields_overlap(F.col("a.fields"), F.col("b.fields"))
    found = both.withColumn("parent_id", parent).where(F.col("parent_id").isNotNull() & meet)
    return found.select(
        "pair_key", F.col("a.rule_id").alias("rule_a"), F.col("a.scope").alias("a_scope"), F.col("b.rule_id").alias("rule_b"),
        F.col("b.scope").alias("b_scope"), "parent_id", "priority_rule_id", "resolved_by", "resolved_at",
    )


def conflicts_with_resolutions(rules: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Every conflict of the three kinds, its latest resolution if it has one, and whether it has (``resolved``); columns
    as in ``resolved_conflicts``.

    Resolved conflicts are found from the resolutions. The rest are the pairs of packs without them: a pair of packs is
    told its resolved pairs, so no conflicts are shuffled.
    """
    solved = checkpointed(resolved_conflicts(rules, resolutions))
    out = solved.withColumn("resolved", F.lit(True))
    for kind in KINDS:
        first, second, parent = kind
        here = solved.where((F.col("a_scope") == first) & (F.col("b_scope") == second)).select("rule_a", "rule_b")
        rows = _pack_rows(rules, kind)
        for scope, s in ((first, "a"), (second, "b")):
            keys = [parent, "target_fields"]
            place = with_pack(_members(rules, scope, parent), keys, "rule_id", f"{s}_pack", rows)
            place = place.withColumnsRenamed({parent: f"{s}_parent", "target_fields": f"{s}_fields", "rule_id": f"rule_{s}"})
            here = here.join(place, f"rule_{s}")
        cell = ["parent_id", "a_fields", "a_pack", "b_fields", "b_pack"]
        done = here.withColumnRenamed("a_parent", "parent_id").groupBy(*cell, "rule_a").agg(F.collect_list("rule_b").alias("partners"))
        done = done.groupBy(*cell).agg(F.collect_list(F.struct("rule_a", "partners")).alias("done"))
        done = done.select(*cell, F.col("done.rule_a").alias("done"), F.col("done.partners").alias("partners"))
        cells = dealt(_cells(rules, kind).join(done, cell, "left").drop("a_fields", "a_pack", "b_fields", "b_pack"))
        kept = ["parent_id", "a_scope", "b_scope"]
        # Each rule of the pack a is told its partners before it is taken out of the pack: later, the optimizer would look them up for each rule b.
        mine = lambda r: F.get("partners", (F.array_position("done", r) - 1).cast("int"))
        told = F.transform("a", lambda r: F.struct(r.alias("rule_id"), mine(r).alias("partners")))
        each = cells.select(*kept, "b", F.explode(told).alias("a"))
        each = each.select(*kept, F.col("a.rule_id").alias("a"), "b", F.col("a.partners").alias("partners"))
        left = F.filter("b", lambda r: ~F.coalesce(F.array_contains("partners", r), F.lit(False)))
        left = F.when(F.col("partners").isNull(), F.col("b")).otherwise(left)
        pairs = each.select(*kept, "a", left.alias("b")).select(*kept, "a", F.explode("b").alias("b"))
        empty = [F.lit(None).cast(solved.schema[c].dataType).alias(c) for c in ("priority_rule_id", "resolved_by", "resolved_at")]
        rest = pairs.select(
            S.pair_key(F.col("a"), F.col("b")).alias("pair_key"), F.col("a").alias("rule_a"), "a_scope",
            F.col("b").alias("rule_b"), "b_scope", "parent_id", *empty, F.lit(False).alias("resolved"),
        )
        out = out.unionByName(rest)
    return out


def open_conflicts(rules: DataFrame, resolutions: DataFrame) -> DataFrame:
    """One row per rule with conflicts: how many it has, how many of them are resolved, and how many are open."""
    total = rule_conflicts(rules, KINDS[0])
    for kind in KINDS[1:]:
        total = total.unionByName(rule_conflicts(rules, kind))
    total = total.groupBy("rule_id").agg(F.sum("conflicts").alias("conflicts"))
    solved = resolved_conflicts(rules, resolutions).select(F.explode(F.array("rule_a", "rule_b")).alias("rule_id"))
    solved = solved.groupBy("rule_id").agg(F.count(F.lit(1)).alias("resolved"))
    resolved = F.coalesce("resolved", F.lit(0))
    return total.join(solved, "rule_id", "left").select("rule_id", "conflicts", resolved.alias("resolved"), (F.col("conflicts") - resolved).alias("open"))


def resolve_conflict(
    rules: DataFrame, rule_ids: Sequence, winner, resolved_by: str, resolved_at
) -> tuple[DataFrame, DataFrame]:
    """Override every listed rule but the winner.

    Returns the new rule table and one resolution row per pair of listed rules, so every
    later pair lookup finds it.
    """
    if len(rule_ids) < 2:
        raise ValueError("a conflict has at least two rules")
    if winner not in rule_ids:
        raise ValueError("the winner must be one of the rules in the conflict")
    losers = [r for r in dict.fromkeys(rule_ids) if r != winner]
    at = F.lit(resolved_at).cast("timestamp")
    lost = F.coalesce(F.col("rule_id").isin(losers), F.lit(False))
    updated = rules.withColumn("status", F.when(lost, "overridden").otherwise(F.col("status")))
    if "updated_at" in rules.columns:
        updated = updated.withColumn("updated_at", F.when(lost, at).otherwise(F.col("updated_at")))
    return updated, _resolution_rows(rules, [winner, *losers], winner, losers, resolved_by, at)


def _resolution_rows(rules, ids, winner, losers, resolved_by, at) -> DataFrame:
    ids_col = F.array(*[F.lit(i).cast("string") for i in ids])
    one = rules.sparkSession.range(1).select(F.array_sort(ids_col).alias("rule_ids"))
    numbered = one.select("rule_ids", F.posexplode("rule_ids").alias("i", "x"))
    pairs = numbered.select(
        "rule_ids", "x", F.explode(F.slice("rule_ids", F.col("i") + 2, F.size("rule_ids"))).alias("y")
    )
    return pairs.select(
        S.pair_key(F.col("x"), F.col("y")).alias("pair_key"),
        "rule_ids",
        F.lit(winner).cast("string").alias("priority_rule_id"),
        F.array(*[F.lit(i).cast("string") for i in losers]).alias("overridden_rule_ids"),
        F.lit(resolved_by).alias("resolved_by"),
        at.alias("resolved_at"),
    )


def resolve_all(rules: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Apply a table of (pair_key, priority_rule_id, overridden rule id) rows to the rules:
    every rule overridden by at least one resolution gets that status."""
    losers = resolutions.select(F.col("overridden_rule_id").alias("rule_id")).distinct()
    marked = rules.join(losers.withColumn("__lost", F.lit(True)), "rule_id", "left")
    status = F.when(F.col("__lost"), "overridden").otherwise(F.col("status"))
    return marked.withColumn("status", status).select(*rules.columns)


def active_rules(rules: DataFrame, dataset_id: str) -> DataFrame:
    """Active rules bound to the dataset; refuses a run that would have none."""
    bound = [F.col(c) == dataset_id for c in ("dataset_id", "scope_target") if c in rules.columns]
    match = bound[0]
    for other in bound[1:]:
        match = match | other
    found = rules.where((F.col("status") == "active") & F.coalesce(match, F.lit(False)))
    if found.isEmpty():
        raise ValueError(f"no active rules for dataset {dataset_id!r}")
    return found


def scope_labels(tables: DataFrame, fields: DataFrame) -> DataFrame:
    """level, node_id, lo, hi: what every catalog, table and field covers in one numbering of all fields; a table has
    the interval of its catalog, too (top_lo, top_hi).

    Fields are numbered in the order of catalog, table and field; a table's, and a catalog's, then follow one another, so a
    scope of any size is an interval from lo to before hi. Tables without fields have no row.
    """
    owned = fields.select("field_id", "table_id").join(tables.select("table_id", "catalog_id"), "table_id")
    at = with_row_index(owned, ["catalog_id", "table_id", "field_id"], "lo")
    names = ("level", "node_id", "lo", "hi")
    span = [F.min("lo").alias("lo"), (F.max("lo") + 1).alias("hi")]
    column = at.select(F.lit("column"), F.col("field_id").cast("string"), "lo", F.col("lo") + 1).toDF(*names)
    catalog = at.where("catalog_id is not null").groupBy("catalog_id").agg(*span)
    table = at.groupBy("table_id", "catalog_id").agg(*span)
    tops = catalog.toDF("catalog_id", "top_lo", "top_hi")
    table = table.join(tops, "catalog_id", "left").withColumns({"level": F.lit("table"), "node_id": F.col("table_id").cast("string")})
    catalog = catalog.select(F.lit("catalog"), F.col("catalog_id").cast("string"), "lo", "hi").toDF(*names)
    return table.select(*names, "top_lo", "top_hi").unionByName(column.unionByName(catalog), allowMissingColumns=True)


def rule_ranges(rules: DataFrame, labels: DataFrame) -> DataFrame:
    """rule_id, scope, lo, hi: the interval of fields that each rule applies to; one row per rule, whatever its scope holds.

    Rules of scopes without fields have no row.
    """
    node = F.when(F.col("scope") == "catalog", F.col("catalog_id").cast("string")).when(
        F.col("scope") == "table", F.col("table_id").cast("string")
    ).when(F.col("scope") == "column", F.col("column_id").cast("string"))
    mine = rules.select("rule_id", "scope", F.col("scope").alias("level"), node.alias("node_id"))
    return split_hot_join(mine, labels.select("level", "node_id", "lo", "hi"), ["level", "node_id"], F.col("rule_id")).select("rule_id", "scope", "lo", "hi")


def rules_of_tables(ranges: DataFrame, labels: DataFrame, asked: DataFrame) -> DataFrame:
    """rule_id, scope, table_id, lo, hi: the rules that apply to some field of the asked tables (column ``table_id``), and
    the interval of the table's fields that they apply to.

    An asked table looks for the rules that start where its catalog, itself or one of its fields starts, with
    that very extent; rules of other scopes are not met.
    """
    spans = labels.where("level = 'table'").select("node_id", F.col("lo").alias("from"), F.col("hi").alias("to"), "top_lo", "top_hi")
    spans = asked.select("table_id").distinct().withColumn("node_id", F.col("table_id").cast("string")).join(spans, "node_id")
    side = lambda scope, lo, hi: spans.select("table_id", "from", "to", F.lit(scope).alias("scope"), lo.alias("lo"), hi.alias("hi"))
    own = side("table", F.col("from"), F.col("to"))
    top = side("catalog", F.col("top_lo"), F.col("top_hi")).where("lo is not null")
    fields = F.explode(F.sequence(F.col("from"), F.col("to") - 1))
    each = side("column", fields, F.lit(None).cast("bigint")).withColumn("hi", F.col("lo") + 1)
    wanted = own.unionByName(each).unionByName(top)
    met = split_hot_join(ranges, wanted, ["scope", "lo", "hi"], F.col("rule_id"))
    return met.select("rule_id", "scope", "table_id", F.greatest("lo", "from").alias("lo"), F.least("hi", "to").alias("hi"))


def expand_rules(rules: DataFrame, tables: DataFrame, fields: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """rule_id, scope, table_id, field_id: which fields each rule applies to; those of the asked tables (column
    ``table_id``) alone if any are given.

    A catalog rule applies to every field of every table in the catalog, a table rule to every field of the
    table, a column rule to the column. The rules and the fields of a scope are cut into packs, whose pairs are
    dealt over the tasks and written out there.
    """
    owners = tables.select("table_id", "catalog_id")
    if asked is not None:
        owners = owners.join(asked.select("table_id").distinct(), "table_id", "left_semi")
    registry = split_hot_join(fields.select("field_id", "table_id"), owners, ["table_id"], F.col("field_id"))
    of = {"catalog": ("catalog_id", "catalog_id"), "table": ("table_id", "table_id"), "column": ("column_id", "field_id")}
    node = lambda at: F.coalesce(*[F.when(F.col("scope") == s, F.col(c[at]).cast("string")) for s, c in of.items()])
    place = F.struct("table_id", "field_id").alias("place")
    places = registry.withColumn("scope", F.explode(F.array(*map(F.lit, of)))).select("scope", node(1).alias("node_id"), place)
    mine = rules.select("scope", node(0).alias("node_id"), "rule_id").where("node_id is not null")
    keys = ["scope", "node_id"]
    places = places.where("node_id is not null")
    rows = pack_rows(mine, places, keys)
    sides = [packed(side, keys, value, rows).drop("__pack") for side, value in ((mine, "rule_id"), (places, "place"))]
    cells = dealt(grid_join(*sides, keys, F.xxhash64("rule_id"), F.xxhash64("place")))
    pairs = each_pair(cells.drop("node_id"), "rule_id", "place")
    return pairs.select("rule_id", "scope", "place.table_id", "place.field_id")
