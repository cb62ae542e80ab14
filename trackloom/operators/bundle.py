"""Joining a base run and a new run for review."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from trackloom.functions import windows
from trackloom.operators.similarity import PROVENANCE


def keyed_union(base: DataFrame, new: DataFrame, keys: Sequence[str] = (), keep: str = "last", sequence: str | None = None) -> DataFrame:
    """Rows of both by name, missing columns null; of rows with a key the last (or first) stays, new rows coming after base ones.

    Rows of one side that share a key follow in the order of sequence; without
    one, of a hash of the row, whatever the partitioning.
    """
    order = lambda df, n: df.withColumn("__o", F.struct(F.lit(n).alias("n"), (F.col(sequence) if sequence else windows.row_hash(df)).alias("m")))
    both = order(base, 0).unionByName(order(new, 1), allowMissingColumns=True)
    if not keys:
        return both.drop("__o")
    pick = windows.latest_wins if keep == "last" else windows.first_wins
    return pick(both, list(keys), "__o").drop("__o")


def joined_embeddings(base: DataFrame, new: DataFrame) -> DataFrame:
    """Both runs' embeddings, geometry and provenance included; they must be made alike and share no track."""
    kinds = [c for c in PROVENANCE if c in base.columns and c in new.columns]
    for c in kinds:
        values = {r[0] for r in base.select(c).distinct().union(new.select(c).distinct()).limit(3).collect()}
        if len(values) > 1:
            raise ValueError(f"the runs have different {c}: {sorted(map(str, values))}")
    if base.join(new, "tracklet_id", "left_semi").head(1):
        raise ValueError("the runs share tracks")
    return base.unionByName(new, allowMissingColumns=True)


def new_labels(assignments: DataFrame, tracks: DataFrame, predictions: DataFrame | None, now: str, prefix: str = "NEW_") -> DataFrame:
    """Unassigned labels of a new run, with the model's guess as a note."""
    place = tracks.select("tracklet_id", "session_id", "video_id").dropDuplicates(["tracklet_id"])
    rows = assignments.select("tracklet_id", "pseudo_id").join(place, "tracklet_id")
    note = F.lit("")  # the note's form is a fixed value
    if predictions is not None:
        guess = predictions.select("tracklet_id", "top_1_id", "top_1_score", "predicted")
        rows = rows.join(guess, "tracklet_id", "left")
        note = F.when(F.col("predicted").isNotNull(), F.concat(F.lit("model_top1="), F.coalesce("top_1_id", F.lit("")), F.lit(";similarity="), F.format_string("%.6f", F.coalesce("top_1_score", F.lit(0.0))), F.lit(";prediction="), "predicted")).otherwise("")
    return rows.select("tracklet_id", F.concat(F.lit(prefix), "pseudo_id").alias("pseudo_id"), "session_id", "video_id", F.lit("").alias("entity_id"), F.lit(False).alias("confirmed"), F.lit("new_video_unassigned").alias("assignment_source"), note.alias("notes"), F.lit(now).alias("updated_at"))


#: How each table of two runs is united: keys and which row stays.
TABLES = {
    "tracklets": (("tracklet_id",), "last"),
    "frames": ((), "last"),
    "video_manifest": (("video_id",), "last"),
    "tracklet_reviews": (("tracklet_id",), "last"),
    "pair_reviews": (("left_id", "right_id"), "last"),
    "identity_exclusions": (("entity_id", "tracklet_id"), "last"),
    "labels": (("tracklet_id",), "first"),
}


def review_bundle(base: dict[str, DataFrame], new: dict[str, DataFrame], now: str, prefix: str = "NEW_") -> dict[str, DataFrame]:
    """All tables of both runs, embeddings united, the new run's tracks as unassigned labels."""
    own = dict(new)
    if "assignments" in new:
        own["labels"] = new_labels(new["assignments"], new["tracklets"], new.get("predictions"), now, prefix)
    out = {}
    for name, (keys, keep) in TABLES.items():
        parts = [t[name] for t in (base, own) if name in t]
        if len(parts) == 2:
            out[name] = keyed_union(*parts, keys, keep)
        elif parts:
            out[name] = parts[0]
    out["embeddings"] = joined_embeddings(base["embeddings"], new["embeddings"])
    return out
