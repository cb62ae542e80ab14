"""Identities united in bulk: pairs taken in order, as far as decisions and exclusions let them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from trackloom.functions import exprs, graphs
from trackloom.operators import labels as own_labels

_ACCEPTED = "left_id string, right_id string, a string, b string, group string, name string, born_left string, born_right string"


def _ranked(df: DataFrame, *order: str) -> DataFrame:
    """df with its place, from 1, in an order: ranges sorted by themselves, each moved by the sizes of those before it."""
    parts = graphs.cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"__p": F.spark_partition_id(), "__i": F.monotonically_increasing_id()}))
    sizes = parts.groupBy("__p").agg(F.count("*").alias("__n"))  # a row for each partition
    before = sizes.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__before"))
    return parts.join(F.broadcast(before), "__p").withColumn("place", F.col("__before") + F.col("__i").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__p", "__i", "__before")


def _fold(rows: pd.DataFrame) -> Iterator[tuple]:
    """Pairs of one constrained component in order, by union and find; each component carries whom it must not join."""
    up, foes, barred, clash = {}, {}, set(), set()
    for kind, left, right, a, b in rows[["kind", "left_id", "right_id", "a", "b"]].itertuples(index=False):
        if kind == "different" and a == b:
            clash.add(a)
        elif kind == "different":
            foes.setdefault(a, set()).add(b)
            foes.setdefault(b, set()).add(a)
        elif kind == "barred":
            barred.add((left, right))

    def find(x):
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    names, accepted = {}, []

    def name(root):
        if root not in names and root.startswith("e"):
            number = own_labels._natural(root[1:])
            names[root] = ((0, number[1], "", "") if number[0] == 0 else (2, 0, root[1:], ""), root[1:])
        return names.get(root)

    for left, right, x, y in rows[rows.kind == "pair"].sort_values(["left_id", "right_id"])[["left_id", "right_id", "a", "b"]].itertuples(index=False):
        a, b = find(x), find(y)
        its = {left: name(a), right: name(b)}
        if a == b or any(n and (n[1], t) in barred for t, n in ((left, its[right]), (right, its[left]))):
            continue
        if len(foes.get(a, ())) > len(foes.get(b, ())):
            a, b = b, a
        if a in clash or b in clash or any(find(f) == b for f in foes.get(a, ())):
            continue
        # a new name comes after all numbered ones and before the others
        new = min((n for n in its.values() if n), key=lambda n: n[0], default=((1, 0, left, right), None))
        up[a] = b
        foes.setdefault(b, set()).update(foes.pop(a, ()))
        names[b] = new
        accepted.append((left, right, x, y))
    for left, right, x, y in accepted:
        root = find(x)
        key, text = names[root]
        yield left, right, x, y, root, text, *(key[2:] if text is None else (None, None))


def accept_pairs(labels: DataFrame, reviews: DataFrame, exclusions: DataFrame, pairs: DataFrame) -> DataFrame:
    """Which pairs (left_id, right_id) unite identities when taken in their order, and the name that each side ends with.

    As in accept_same, one by one: a pair inside one identity does nothing; one
    that an exclusion bars, or that would bring two tracks marked different into
    one identity, is refused; the first name in natural order stays.  A group
    without a name gets the number after the greatest in labels and exclusions,
    in the order of the pairs that began the groups; numbers given up in between
    are not used again.  One plan for any number of pairs: a spanning forest of
    the candidates by rounds; only components that hold a decision, an exclusion
    or a name without number are folded, each in one task, since there every
    refusal depends on those before it.

    labels has one row for each track; an unconfirmed row has no identity
    whatever its entity_id.  Pairs of tracks without a row, of a track with
    itself, and repeated pairs are left out; null ids match nothing.  Returns
    left_id, right_id, a and b (nodes: e and the name, or t and the track),
    group, and entity_id.
    """
    named = F.coalesce("confirmed", F.lit(False)) & (exprs.normal_id(F.col("entity_id")) != "")
    nodes = graphs.cut(labels.where("tracklet_id IS NOT NULL").select("tracklet_id", F.when(named, F.concat(F.lit("e"), exprs.normal_id(F.col("entity_id")))).otherwise(F.concat(F.lit("t"), "tracklet_id")).alias("node")).dropDuplicates(["tracklet_id"]))
    side = lambda track, node: nodes.select(F.col("tracklet_id").alias(track), F.col("node").alias(node))
    at_nodes = lambda df: df.join(side("left_id", "a"), "left_id").join(side("right_id", "b"), "right_id")

    ordered = pairs.select(F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id")).where("left_id <> right_id").distinct()
    edges = graphs.cut(at_nodes(ordered).where("a <> b").select("left_id", "right_id", "a", "b"))
    forest, roots = graphs.spanning_forest(edges, F.struct("left_id", "right_id"))
    root_of = lambda node, root: roots.select(F.col("node").alias(node), F.col("root").alias(root))

    different = at_nodes(reviews.where("decision = 'different'").select("left_id", "right_id").where("left_id <> right_id"))
    different = different.join(root_of("a", "root"), "a").join(root_of("b", "other"), "b").where("root = other").select("root", F.lit("different").alias("kind"), "left_id", "right_id", "a", "b")
    own = exclusions.select(exprs.normal_id(F.col("entity_id")).alias("left_id"), F.col("tracklet_id").alias("right_id")).distinct().withColumn("a", F.concat(F.lit("e"), "left_id"))
    barred = own.join(root_of("a", "root"), "a").join(side("right_id", "b"), "right_id").join(root_of("b", "other"), "b").where("root = other").select("root", F.lit("barred").alias("kind"), "left_id", "right_id", "a", "b")
    held = graphs.cut(different.unionByName(barred))
    number = exprs.id_number(F.substring("node", 2, 1 << 30))
    is_named = F.col("node").startswith("e")
    odd = roots.where(is_named & number.isNull()).select("root")
    bound = graphs.cut(held.select("root").unionByName(odd).distinct())

    rooted = edges.join(root_of("a", "root"), "a").join(bound, "root", "left_semi").select("root", F.lit("pair").alias("kind"), "left_id", "right_id", "a", "b")

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_fold(rows), columns=["left_id", "right_id", "a", "b", "group", "name", "born_left", "born_right"])

    folded = rooted.unionByName(held).groupBy("root").applyInPandas(fold, _ACCEPTED)

    free = roots.join(bound, "root", "left_anti")
    first_name = free.where(is_named).groupBy("root").agg(F.min_by(F.substring("node", 2, 1 << 30), F.struct(number, "node")).alias("name"))
    free_pairs = forest.join(free.select(F.col("node").alias("a"), "root"), "a").join(first_name, "root", "left")
    born = free_pairs.where("name IS NULL").groupBy("root").agg(F.min(F.struct("left_id", "right_id")).alias("born"))
    whole = free_pairs.join(born, "root", "left").select("left_id", "right_id", "a", "b", F.col("root").alias("group"), "name", F.col("born.left_id").alias("born_left"), F.col("born.right_id").alias("born_right"))
    accepted = graphs.cut(whole.unionByName(folded))

    known = labels.select("entity_id").unionByName(exclusions.select("entity_id")).agg(F.coalesce(F.max(exprs.id_number(exprs.normal_id(F.col("entity_id")))), F.lit(0)).alias("greatest"))
    fresh = _ranked(accepted.where("name IS NULL").select("born_left", "born_right").distinct(), "born_left", "born_right").join(known)  # one row
    fresh = fresh.select("born_left", "born_right", F.format_string(f"{exprs.ID_PREFIX}_%04d", F.col("greatest") + F.col("place")).alias("new"))
    return accepted.join(fresh, ["born_left", "born_right"], "left").select("left_id", "right_id", "a", "b", "group", F.coalesce("name", "new").alias("entity_id"))


def unite(labels: DataFrame, reviews: DataFrame, exclusions: DataFrame, pairs: DataFrame, now: str, source: str = "auto_dual_signal") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Labels, reviews and the accepted pairs after accept_pairs.

    Tracks of accepted pairs get the source, other tracks of identities that
    got another name "identity_merge"; all of both are confirmed.  Each accepted
    pair has a "same" review, with its cosine where pairs has one.
    """
    accepted = graphs.cut(accept_pairs(labels, reviews, exclusions, pairs))
    groups = accepted.select(F.explode(F.array("a", "b")).alias("__node"), F.col("entity_id").alias("__new")).distinct()
    paired = accepted.select(F.explode(F.array("left_id", "right_id")).alias("tracklet_id"), F.lit(True).alias("__pair")).distinct()
    named = F.coalesce("confirmed", F.lit(False)) & (exprs.normal_id(F.col("entity_id")) != "")
    node = F.when(named, F.concat(F.lit("e"), exprs.normal_id(F.col("entity_id")))).otherwise(F.concat(F.lit("t"), "tracklet_id"))
    moved = labels.withColumn("__node", node).join(groups, "__node", "left").join(paired, "tracklet_id", "left")
    pair, merged = F.col("__pair").isNotNull(), F.col("__new").isNotNull() & (F.col("__new") != exprs.normal_id(F.col("entity_id")))
    changed = pair | merged
    values = {
        "entity_id": F.coalesce("__new", "entity_id"),
        "confirmed": F.when(changed, True).otherwise(F.col("confirmed")),
        "assignment_source": F.when(pair, source).when(merged, "identity_merge").otherwise(F.col("assignment_source")),
        "notes": F.when(pair, "").otherwise(F.col("notes")),
        "updated_at": F.when(changed, now).otherwise(F.col("updated_at")),
    }
    updated = moved.select(*(values[c].alias(c) if c in values else F.col(c) for c in labels.columns))
    unordered = [F.least("left_id", "right_id").alias("__l"), F.greatest("left_id", "right_id").alias("__r")]
    alike = pairs.select(*unordered, (F.col("cosine") if "cosine" in pairs.columns else F.lit(None)).cast("double").alias("similarity")).groupBy("__l", "__r").agg(F.max("similarity").alias("similarity"))
    done = accepted.select("left_id", "right_id", "entity_id").join(alike, (F.col("left_id") == F.col("__l")) & (F.col("right_id") == F.col("__r")), "left")
    rows = done.select("left_id", "right_id", F.lit("same").alias("decision"), "entity_id", "similarity", F.lit("").alias("notes"), F.lit(now).alias("updated_at"))
    kept = reviews.select("*", *unordered).join(accepted.select(F.col("left_id").alias("__l"), F.col("right_id").alias("__r")), ["__l", "__r"], "left_anti").drop("__l", "__r")
    return updated, kept.unionByName(rows), accepted.select("left_id", "right_id", "entity_id")


def auto_confirm(labels: DataFrame, reviews: DataFrame, exclusions: DataFrame, pairs: DataFrame, now: str, cosine: float = 0.95, geometry: float = 0.5, source: str = "auto_dual_signal") -> tuple[DataFrame, DataFrame, DataFrame]:
    """unite of the pairs that are each other's first candidate and alike in both signals."""
    return unite(labels, reviews, exclusions, own_labels.auto_confirm_candidates(pairs, reviews, cosine, geometry), now, source)
