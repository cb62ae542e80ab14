"""Order-dependent clustering under a session constraint, and its summaries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

SCHEMA = "tracklet_id string, session_id string, pseudo_id string, similarity_to_cluster double, candidate_similarity double, candidate_margin double, assignment_type string, needs_review boolean"


#: Scores held at once and vectors scored together at most, and the width of the stretches whose highest score is kept.
SCORES, VECTORS, STRETCH = 1 << 25, 256, 512
#: What the score of a closed cluster is lowered by, and the score that no open one has.
CLOSED, SHUT = np.float32(-8), -4


def _best_two(own: np.ndarray, most: np.ndarray, v: np.ndarray, prototypes: np.ndarray) -> list[tuple[int, float]]:
    """The two best (cluster, score), lower numbers first among equals, of single-precision scores and their stretches' highest.

    Whatever single precision can't tell from the second best is scored again in double precision.
    """
    first = int(most.argmax())
    if most[first] <= SHUT:
        return []
    inside = np.partition(own[first * STRETCH : (first + 1) * STRETCH], -2)[-2]
    other = max(most[:first].max(initial=-np.inf), most[first + 1 :].max(initial=-np.inf))
    least = max(inside, other) - 4 * len(v) * np.finfo(np.float32).eps
    found = np.concatenate([g * STRETCH + np.flatnonzero((own[g * STRETCH : (g + 1) * STRETCH] >= least) & (own[g * STRETCH : (g + 1) * STRETCH] > SHUT)) for g in np.flatnonzero((most >= least) & (most > SHUT))])
    scores = (prototypes[found] * v).sum(1)
    return [(int(found[i]), float(scores[i])) for i in np.argsort(-scores, kind="stable")[:2]]


def assign_in_order(ids: list[str], vectors: np.ndarray, sessions: list[str], threshold: float = 0.95, min_margin: float = 0.0, one_per_session: bool = True) -> pd.DataFrame:
    """One pass: each vector joins the most similar cluster without its session, or starts one.

    It starts one where no cluster reaches threshold, or where the best isn't
    min_margin above the second (if that is not negative).  A cluster's
    prototype is the mean of its vectors, kept as a running sum, at length one.

    A cluster that gets a vector is closed to the vector's session, so while
    vectors of one session follow each other the open prototypes stay as they
    are: blocks of such vectors are scored by one matrix product.
    """
    size = lambda v: v / max(float(np.linalg.norm(v)), 1e-12)
    units = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    sums, prototypes = np.zeros_like(units), np.zeros_like(units)
    # in single precision, with a last place that lowers the scores of closed clusters; a vector that isn't finite stays alone
    quick, quick_units = np.zeros((len(units), units.shape[1] + 1), np.float32), np.ones((len(units), units.shape[1] + 1), np.float32)
    finite = np.isfinite(units).all(1)
    quick_units[finite, :-1] = units[finite]
    alone = np.where(finite, np.float32(0), CLOSED)
    lowered = np.zeros(len(units), np.float32)
    seen: dict[str, list[int]] = {}
    rows, n, at = [], 0, 0
    while at < len(ids):
        session, end = sessions[at], at + 1
        most_rows = min(VECTORS, max(1, SCORES // max(n, STRETCH))) if one_per_session else 1
        while end < len(ids) and end - at < most_rows and sessions[end] == session:
            end += 1
        known = n
        closed = seen.setdefault(session, [])
        if one_per_session and (not at or sessions[at - 1] != session):
            quick[:n, -1] = lowered[:n]
            quick[closed, -1] = CLOSED
        if one_per_session and len(closed) == known:
            known = 0
        if known:
            scores = np.empty((end - at, -(-known // STRETCH) * STRETCH), np.float32)
            np.matmul(quick_units[at:end], quick[:known].T, out=scores[:, :known])
            scores[:, known:] = CLOSED
            most = scores.reshape(end - at, -1, STRETCH).max(2)
        for i in range(at, end):
            v = units[i]
            two = _best_two(scores[i - at], most[i - at], v, prototypes) if known and finite[i] else []
            best = two[0][1] if two else None
            second = two[1][1] if len(two) > 1 else -np.inf
            best = None if best is not None and best <= -1.0 else best
            margin = best - second if best is not None and second >= 0 else np.inf
            joins = best is not None and best >= threshold and margin >= min_margin
            cluster = two[0][0] if joins else n
            n += not joins
            sums[cluster] += v
            prototypes[cluster] = size(sums[cluster])
            lowered[cluster] = alone[i]
            quick[cluster, :-1] = prototypes[cluster] if finite[i] else 0
            quick[cluster, -1] = CLOSED if one_per_session else alone[i]
            closed.append(cluster)
            if joins and i + 1 < end:
                g = cluster // STRETCH
                scores[i + 1 - at :, cluster] = CLOSED
                most[i + 1 - at :, g] = scores[i + 1 - at :, g * STRETCH : (g + 1) * STRETCH].max(1)
            review = joins and (best < min(0.99, threshold + 0.02) or margin < min_margin + 0.02)
            rows.append((ids[i], session, f"PSEUDO_{cluster + 1:04d}", best if joins else 1.0, best, margin if np.isfinite(margin) and best is not None else None, "matched" if joins else "seed", bool(review)))
        at = end
    return pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])


def greedy_clusters(vectors: DataFrame, order: list[str], group: str | None = None, id_col: str = "tracklet_id", vector_col: str = "embedding", session_col: str = "session_id", threshold: float = 0.95, min_margin: float = 0.0, one_per_session: bool = True) -> DataFrame:
    """assign_in_order over rows sorted by order, separately for each group.

    The pass is sequential by definition: a group is one task, so groups (a
    site, a season) are what scales.  Its products with all prototypes grow
    with the square of a group; an order that begins with the session makes
    them matrix products of whole blocks.
    """
    own = vectors.select(F.col(id_col).cast("string").alias("id"), F.col(vector_col).alias("v"), F.col(session_col).cast("string").alias("s"), F.struct(*order).alias("o"), (F.col(group) if group else F.lit(0)).alias("g"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = [tuple(o.values()) if isinstance(o, dict) else tuple(o) for o in pdf["o"]]
        pdf = pdf.iloc[sorted(range(len(pdf)), key=keys.__getitem__)]
        return assign_in_order(pdf["id"].tolist(), np.stack(pdf["v"]).astype(float), pdf["s"].tolist(), threshold, min_margin, one_per_session)

    return own.groupBy("g").applyInPandas(run, SCHEMA)


def cluster_sizes(assignments: DataFrame) -> DataFrame:
    """One row: tracks, clusters and clusters of more than one track."""
    sizes = assignments.groupBy("pseudo_id").agg(F.count("*").alias("n"))
    return sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tracks"), F.count("*").alias("clusters"), F.count_if(F.expr("n > 1")).alias("shared_clusters"))


def cluster_summary(assignments: DataFrame, labels: DataFrame) -> DataFrame:
    """pseudo_id, tracklets, sessions, unlinked and the least entity linked, for every cluster."""
    named = labels.where(F.coalesce("confirmed", F.lit(False)) & (F.col("entity_id") != "")).select("tracklet_id", "entity_id")
    joined = assignments.join(named, "tracklet_id", "left")
    return joined.groupBy("pseudo_id").agg(F.count("*").alias("tracklets"), F.count_distinct("session_id").alias("sessions"), F.count_if(F.col("entity_id").isNull()).alias("unlinked"), F.coalesce(F.min("entity_id"), F.lit("")).alias("linked_entity"))
