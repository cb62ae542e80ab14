"""Identity labels: audit, review decisions and changes under cannot-link constraints."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from trackloom.functions import exprs, windows

#: Review states that keep a track out of training, and review decisions.
FLAGGED = ("tracklet_error", "split_requested")
STATES = ("unsure", "tracklet_error", "split_requested", "valid")
DECISIONS = ("same", "different", "unsure")


class Conflict(ValueError):
    """A change that a recorded "different" decision forbids."""


def flagged_tracklets(reviews: DataFrame) -> DataFrame:
    return reviews.where(F.col("state").isin(*FLAGGED)).select("tracklet_id").distinct()


def without_flagged(df: DataFrame, reviews: DataFrame) -> DataFrame:
    return df.join(flagged_tracklets(reviews), "tracklet_id", "left_anti")


def confirmed_labels(labels: DataFrame) -> DataFrame:
    """Confirmed rows with an id in normal form; without a confirmed column every row is confirmed."""
    normal = labels.withColumn("entity_id", exprs.normal_id(F.col("entity_id")))
    sure = F.coalesce("confirmed", F.lit(False)) if "confirmed" in labels.columns else F.lit(True)
    return normal.where(sure & (F.col("entity_id") != ""))


def label_conflicts(labels: DataFrame, reviews: DataFrame) -> DataFrame:
    """Review edges that contradict labels: different inside an identity, or same across two."""
    ids = confirmed_labels(labels).select("tracklet_id", "entity_id").dropDuplicates(["tracklet_id"])
    end = lambda side: ids.select(F.col("tracklet_id").alias(f"{side}_id"), F.col("entity_id").alias(f"{side}_entity"))
    edges = reviews.select("left_id", "right_id", "decision").join(end("left"), "left_id", "left").join(end("right"), "right_id", "left")
    inside = (F.col("decision") == "different") & (F.col("left_entity") == F.col("right_entity"))
    across = (F.col("decision") == "same") & (F.col("left_entity") != F.col("right_entity"))
    kind = F.when(inside, "different_pair_inside_identity").when(across, "same_pair_across_identities")
    return edges.withColumn("conflict_type", kind).where("conflict_type IS NOT NULL").select("conflict_type", F.col("left_entity").alias("entity_id"), F.when(across, F.col("right_entity")).otherwise("").alias("other_entity_id"), "left_id", "right_id", "decision")


def audit_identities(labels: DataFrame, reviews: DataFrame, flagged: DataFrame | None = None) -> DataFrame:
    """A row for each identity: its counts, conflicts, status and whether it may train.

    Two unflagged tracks or more and no conflict make it eligible; two tracks of
    one session only warn.
    """
    members = confirmed_labels(labels)
    marks = members.withColumn("__flag", F.lit(False)) if flagged is None else members.join(flagged.select("tracklet_id", F.lit(True).alias("__flag")).distinct(), "tracklet_id", "left").withColumn("__flag", F.coalesce("__flag", F.lit(False)))
    counts = marks.groupBy("entity_id").agg(
        F.count_distinct("tracklet_id").alias("tracklets"),
        F.count_distinct("session_id").alias("sessions"),
        F.count_distinct("video_id").alias("videos"),
        F.count_distinct(F.when(F.col("__flag"), F.col("tracklet_id"))).alias("excluded_flagged_tracklets"),
        F.count_distinct(F.when(~F.col("__flag"), F.col("tracklet_id"))).alias("__usable"),
    )
    crowded = members.where("session_id IS NOT NULL").groupBy("entity_id", "session_id").agg(F.count("*").alias("n")).groupBy("entity_id").agg(F.count_if(F.expr("n > 1")).alias("same_session_duplicates"))
    conflicts = label_conflicts(labels, reviews)
    sides = conflicts.select("conflict_type", F.explode(F.array_distinct(F.array("entity_id", "other_entity_id"))).alias("entity_id")).where("entity_id <> ''")
    edges = sides.groupBy("entity_id").agg(F.count_if(F.expr("conflict_type LIKE 'different%'")).alias("different_edges_inside_identity"), F.count_if(F.expr("conflict_type LIKE 'same%'")).alias("same_edges_across_identities"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("same_session_duplicates", "different_edges_inside_identity", "same_edges_across_identities")}
    joined = counts.join(crowded, "entity_id", "left").join(edges, "entity_id", "left").withColumns(zero)
    conflict = (F.col("different_edges_inside_identity") > 0) | (F.col("same_edges_across_identities") > 0)
    enough = F.col("__usable") >= 2
    status = F.when(conflict, "conflict").when(~enough, "needs_more_tracklets").when(F.col("same_session_duplicates") > 0, "warning_same_session_duplicates").otherwise("safe")
    return joined.withColumns({"status": status, "training_eligible": enough & ~conflict}).drop("__usable")


def safe_labels(labels: DataFrame, audit: DataFrame) -> DataFrame:
    """labels with training_eligible and audit_status of their identity."""
    judged = audit.select("entity_id", F.col("training_eligible").alias("__ok"), F.col("status").alias("__status"))
    normal = labels.withColumn("entity_id", exprs.normal_id(F.col("entity_id")))
    sure = F.coalesce("confirmed", F.lit(False)) if "confirmed" in labels.columns else F.lit(True)
    return normal.join(judged, "entity_id", "left").withColumns({"training_eligible": F.coalesce("__ok", F.lit(False)) & sure, "audit_status": F.coalesce("__status", F.lit("unassigned"))}).drop("__ok", "__status")


def audit_summary(audit: DataFrame, safe: DataFrame) -> DataFrame:
    """One row of counts of identities and of tracks that may train."""
    a = audit.agg(F.count("*").alias("identities"), F.count_if("training_eligible").alias("safe_identities"), F.count_if(F.expr("status = 'conflict'")).alias("conflicted_identities"))
    return a.join(safe.agg(F.count_if("training_eligible").alias("training_safe_tracklets")))  # a row each


def load_labels(tracks: DataFrame, assignments: DataFrame | None = None, existing: DataFrame | None = None, sequence: str | None = None) -> DataFrame:
    """One row for each valid track, with its pseudo id and the non-null values of the last existing label."""
    base = tracks.where(F.coalesce("valid", F.lit(False))).select("tracklet_id", "session_id", "video_id").dropDuplicates(["tracklet_id"])
    if assignments is not None:
        base = base.join(assignments.select("tracklet_id", "pseudo_id").dropDuplicates(["tracklet_id"]), "tracklet_id", "left")
    else:
        base = base.withColumn("pseudo_id", F.lit(""))
    empty = {"entity_id": F.lit(""), "confirmed": F.lit(False), "assignment_source": F.lit(""), "notes": F.lit(""), "updated_at": F.lit("")}
    base = base.withColumns(empty)
    if existing is not None:
        last = windows.latest_wins(existing.withColumn("__s", F.col(sequence) if sequence else windows.row_hash(existing)), ["tracklet_id"], "__s")
        given = [c for c in empty if c in existing.columns]
        base = base.join(last.select("tracklet_id", *(F.col(c).alias(f"__{c}") for c in given)), "tracklet_id", "left").withColumns({c: F.coalesce(f"__{c}", c) for c in given}).drop(*(f"__{c}" for c in given))
    out = base.withColumn("entity_id", exprs.normal_id(F.col("entity_id")))
    return out.withColumn("confirmed", F.col("confirmed") & (F.col("entity_id") != "")).select("tracklet_id", "pseudo_id", "session_id", "video_id", *empty)


def matching(labels: DataFrame, text: str, columns: Sequence[str] = ("entity_id", "tracklet_id")) -> DataFrame:
    """Rows with text anywhere in one of the columns, in either case; an empty text matches all."""
    wanted = F.lit(text.strip().upper())
    found = F.lit(False)
    for c in columns:
        found = found | F.contains(F.upper(F.coalesce(F.col(c).cast("string"), F.lit(""))), wanted)
    return labels.where(found)


def checked_unique(labels: DataFrame) -> DataFrame:
    """labels; an error if a track has more than one row."""
    if labels.groupBy("tracklet_id").agg(F.count("*").alias("n")).where("n > 1").head(1):
        raise ValueError("a track has more than one label")
    return labels


def catalog(labels: DataFrame) -> DataFrame:
    own = labels.where(F.coalesce("confirmed", F.lit(False)) & (F.coalesce("entity_id", F.lit("")) != ""))
    return own.groupBy("entity_id").agg(F.count_distinct("tracklet_id").alias("tracklets"), F.count_distinct("video_id").alias("videos"), F.count_distinct("session_id").alias("sessions"))


def next_id(labels: DataFrame, prefix: str = exprs.ID_PREFIX) -> DataFrame:
    """One row: the id after the greatest in use."""
    return labels.agg((F.coalesce(F.max(exprs.id_number(exprs.stripped(F.col("entity_id")), prefix)), F.lit(0)) + 1).alias("n")).select(F.format_string(f"{prefix}_%04d", "n").alias("entity_id"))


def by_id(entity: str | Column) -> tuple[Column, ...]:
    """Natural order of ids: numbered ones by number, then the others by name."""
    c = F.col(entity) if isinstance(entity, str) else entity
    return exprs.id_number(exprs.normal_id(c)).asc_nulls_last(), c.asc()


def _set(labels: DataFrame, chosen: Column, **values) -> DataFrame:
    return labels.withColumns({c: F.when(chosen, F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def _require(found: Iterable, wanted: Iterable, what: str) -> None:
    missing = sorted(set(wanted) - set(found))
    if missing:
        raise ValueError(f"{what}: {missing}")


def _present(labels: DataFrame, column: str, values: Sequence[str]) -> set:
    """Which of the given values the column has: at most as many rows as were asked for."""
    return {r[0] for r in labels.where(F.col(column).isin(*values)).select(column).distinct().collect()}


def normal(entity: str, labels: DataFrame) -> str:
    return labels.sparkSession.range(1).select(exprs.normal_id(F.lit(entity))).first()[0]


def assign(labels: DataFrame, tracklets: Iterable[str], entity: str | None, now: str, source: str = "manual", notes: str = "") -> tuple[DataFrame, str]:
    chosen = sorted({str(t) for t in tracklets})
    _require(_present(labels, "tracklet_id", chosen), chosen, "unknown tracks")
    resolved = normal(entity, labels) if entity else next_id(labels).first()[0]
    if not resolved:
        raise ValueError("the identity is empty")
    return _set(labels, F.col("tracklet_id").isin(*chosen), entity_id=resolved, confirmed=True, assignment_source=source, notes=notes, updated_at=now), resolved


def unassign(labels: DataFrame, tracklets: Iterable[str]) -> DataFrame:
    return _set(labels, F.col("tracklet_id").isin(*map(str, tracklets)), entity_id="", confirmed=False, assignment_source="", notes="", updated_at="")


def rename(labels: DataFrame, old: str, new: str, now: str) -> DataFrame:
    old, new = normal(old, labels), normal(new, labels)
    if not new:
        raise ValueError("the new identity is empty")
    own = labels.withColumn("entity_id", exprs.normal_id(F.col("entity_id")))
    found = _present(own, "entity_id", [old, new])
    _require(found, [old], "unknown identity")
    if new != old and new in found:
        raise ValueError(f"{new} exists already; merge instead")
    return _set(own, F.col("entity_id") == old, entity_id=new, assignment_source="identity_rename", updated_at=now)


def merge(labels: DataFrame, entities: Iterable[str], now: str, target: str | None = None) -> tuple[DataFrame, str]:
    """All tracks of the given identities under the target, or the first of them in natural order."""
    own = labels.withColumn("entity_id", exprs.normal_id(F.col("entity_id")))
    names = sorted({normal(e, labels) for e in entities} - {""})
    if not names:
        raise ValueError("no identity to merge")
    _require(_present(own, "entity_id", names), names, "unknown identities")
    resolved = normal(target, labels) if target else sorted(names, key=_natural)[0]
    if not resolved:
        raise ValueError("the target is empty")
    return _set(own, F.col("entity_id").isin(*names), entity_id=resolved, confirmed=True, assignment_source="identity_merge", updated_at=now), resolved


def _natural(name: str) -> tuple:
    head, _, tail = name.rpartition("_")
    return (0, int(tail), "") if head.upper() == exprs.ID_PREFIX and tail.isdigit() else (1, 0, name)


def save_review(reviews: DataFrame, left: str, right: str, decision: str, now: str, entity: str = "", similarity: float | None = None, notes: str = "") -> DataFrame:
    """reviews with one decision for the pair, whichever way round it is named."""
    if decision not in DECISIONS:
        raise ValueError(f"decision must be one of {DECISIONS}")
    a, b = sorted((str(left), str(right)))
    row = reviews.sparkSession.createDataFrame([(a, b, decision, entity, similarity, notes, now)], reviews.schema)
    return reviews.where(~((F.least("left_id", "right_id") == a) & (F.greatest("left_id", "right_id") == b))).unionByName(row)


def set_state(reviews: DataFrame, tracklet: str, state: str, now: str, split_at_s: float | None = None, notes: str = "") -> DataFrame:
    if state not in STATES:
        raise ValueError(f"state must be one of {STATES}")
    row = reviews.sparkSession.createDataFrame([(str(tracklet), state, split_at_s, notes, now)], reviews.schema)
    return reviews.where(~F.col("tracklet_id").eqNullSafe(F.lit(str(tracklet)))).unionByName(row)


def reject_candidate(exclusions: DataFrame, entity: str, tracklet: str, now: str, reason: str = "human_rejected_identity_candidate") -> DataFrame:
    entity = normal(entity, exclusions)
    row = exclusions.sparkSession.createDataFrame([(entity, str(tracklet), reason, now)], exclusions.schema)
    return exclusions.where(~((F.col("entity_id") == entity) & (F.col("tracklet_id") == str(tracklet)))).unionByName(row)


def different_within(reviews: DataFrame, members: DataFrame) -> DataFrame:
    """Edges marked different with both ends among members (tracklet_id)."""
    side = lambda c: members.select(F.col("tracklet_id").alias(c)).distinct()
    return reviews.where("decision = 'different'").join(side("left_id"), "left_id", "left_semi").join(side("right_id"), "right_id", "left_semi")


def _forbid(reviews: DataFrame, members: DataFrame, ignored: tuple[str, str] | None = None) -> None:
    edges = different_within(reviews, members)
    if ignored:
        a, b = sorted(ignored)
        edges = edges.where(~((F.least("left_id", "right_id") == a) & (F.greatest("left_id", "right_id") == b)))
    first = edges.select("left_id", "right_id").head(1)
    if first:
        raise Conflict(f"recorded as different: {first[0][0]} and {first[0][1]}")


def _named(labels: DataFrame, names: Iterable[str]) -> DataFrame:
    return labels.where(exprs.normal_id(F.col("entity_id")).isin(*names)).select("tracklet_id")


def assign_checked(labels: DataFrame, reviews: DataFrame, exclusions: DataFrame, tracklets: Iterable[str], entity: str | None, now: str, source: str = "manual", notes: str = "") -> tuple[DataFrame, DataFrame, str]:
    """Labels and exclusions after an assignment that no "different" decision forbids; it lifts the exclusions it overrules."""
    chosen = sorted({str(t) for t in tracklets})
    resolved = normal(entity, labels) if entity else next_id(labels).first()[0]
    present = _named(labels.where(F.coalesce("confirmed", F.lit(False))), [resolved])
    _forbid(reviews, present.unionByName(labels.sparkSession.createDataFrame([(t,) for t in chosen], "tracklet_id string")))
    updated, resolved = assign(labels, chosen, resolved, now, source, notes)
    return updated, exclusions.where(~((F.col("entity_id") == resolved) & F.col("tracklet_id").isin(*chosen))), resolved


def record_different(labels: DataFrame, reviews: DataFrame, left: str, right: str, now: str, similarity: float | None = None) -> DataFrame:
    ids = {r[0]: r[1] for r in labels.where(F.col("tracklet_id").isin(left, right)).select("tracklet_id", exprs.normal_id(F.col("entity_id"))).collect()}
    if ids.get(left) and ids.get(left) == ids.get(right):
        raise Conflict(f"both tracks are labelled {ids[left]}; take one out first")
    return save_review(reviews, left, right, "different", now, similarity=similarity)


def accept_same(labels: DataFrame, reviews: DataFrame, left: str, right: str, now: str, entity: str | None = None, similarity: float | None = None, source: str = "pair_review") -> tuple[DataFrame, DataFrame, str]:
    """Labels and reviews after two tracks, and the identities they belong to, become one.

    The first of their ids in natural order stays, or a new one is made.  Any
    "different" decision inside the united group forbids it, but for the pair's own.
    """
    pair = [str(left), str(right)]
    rows = labels.where(F.col("tracklet_id").isin(*pair) & F.coalesce("confirmed", F.lit(False))).select(exprs.normal_id(F.col("entity_id"))).distinct().collect()
    existing = sorted({r[0] for r in rows} - {""}, key=_natural)
    resolved = normal(entity, labels) if entity else existing[0] if existing else next_id(labels).first()[0]
    sources = set(existing) | (_present(labels.withColumn("entity_id", exprs.normal_id(F.col("entity_id"))), "entity_id", [resolved]))
    ends = labels.sparkSession.createDataFrame([(t,) for t in pair], "tracklet_id string")
    _forbid(reviews, ends.unionByName(_named(labels, sources)) if sources else ends, (pair[0], pair[1]))
    if len(sources) > 1:
        labels, resolved = merge(labels, sources, now, resolved)
    labels, resolved = assign(labels, pair, resolved, now, source)
    gone = sorted(set(existing) - {resolved}, key=_natural)
    notes = f"Merged {', '.join(gone)} into {resolved}" if gone else ""
    return labels, save_review(reviews, *pair, "same", now, resolved, similarity, notes), resolved


def auto_confirm_candidates(pairs: DataFrame, reviews: DataFrame, cosine: float = 0.95, geometry: float = 0.5) -> DataFrame:
    """Pairs that are each other's first candidate, alike in both signals and never marked different."""
    from trackloom.operators.similarity import mutual_best

    different = reviews.where("decision = 'different'").select(F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id")).distinct()
    return mutual_best(pairs).where((F.col("cosine") >= cosine) & (F.col("geometry_cosine") >= geometry)).join(different, ["left_id", "right_id"], "left_anti")


def auto_confirm(labels: DataFrame, reviews: DataFrame, exclusions: DataFrame, pairs: DataFrame, now: str, cosine: float = 0.95, geometry: float = 0.5, source: str = "auto_dual_signal") -> tuple[DataFrame, DataFrame, list[tuple[str, str, str]]]:
    """Applies auto_confirm_candidates one by one, as each merge may forbid a later one.

    The candidates come from one distributed plan; those that pass every bar are
    few and are folded in the order of the pair.
    """
    barred = {(r[0], r[1]) for r in exclusions.select("entity_id", "tracklet_id").collect()}
    applied = []
    for row in auto_confirm_candidates(pairs, reviews, cosine, geometry).orderBy("left_id", "right_id").collect():
        a, b = row["left_id"], row["right_id"]
        ids = {r[0]: r[1] for r in labels.where(F.col("tracklet_id").isin(a, b)).select("tracklet_id", exprs.normal_id(F.col("entity_id"))).collect()}
        if ids.get(a) and ids.get(a) == ids.get(b) or (ids.get(b), a) in barred or (ids.get(a), b) in barred:
            continue
        try:
            labels, reviews, entity = accept_same(labels, reviews, a, b, now, similarity=row["cosine"], source=source)
        except Conflict:
            continue
        applied.append((a, b, entity))
    return labels, reviews, applied


def triage_queue(pairs: DataFrame, labels: DataFrame, reviews: DataFrame) -> DataFrame:
    """The first candidate of each unconfirmed track whose pair isn't reviewed, most alike first."""
    least = lambda a, b: (F.least(a, b).alias("x"), F.greatest(a, b).alias("y"))
    open_ = labels.where(~F.coalesce("confirmed", F.lit(False))).select(F.col("tracklet_id").alias("query_id")).distinct()
    first = pairs.where("rank = 1").join(open_, "query_id", "left_semi").withColumns(dict(zip(("x", "y"), (F.least("query_id", "candidate_id"), F.greatest("query_id", "candidate_id")), strict=True)))
    done = reviews.select(*least("left_id", "right_id")).distinct()
    return first.join(done, ["x", "y"], "left_anti").select(F.col("query_id").alias("tracklet_id"), "candidate_id", "cosine").orderBy(F.round("cosine", 9).desc(), "tracklet_id")


def best_pairs(pairs: DataFrame, n: int = 40) -> DataFrame:
    """The n most alike unordered pairs."""
    distinct = pairs.groupBy(F.least("query_id", "candidate_id").alias("left_id"), F.greatest("query_id", "candidate_id").alias("right_id")).agg(F.max("cosine").alias("cosine"))
    return distinct.orderBy(F.round("cosine", 9).desc(), "left_id", "right_id").limit(n)
