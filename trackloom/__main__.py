"""Command line: each command reads versioned tables of a run folder, applies an operator and writes a new version.

    spark-submit -m trackloom COMMAND RUN [--name value ...]
"""

from __future__ import annotations

import argparse
import importlib
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from trackloom.operators import bundle, cluster, labels, manifest, merging, posture, registry, similarity, splits, worker
from trackloom.sources import tables


class Run:
    """Tables below a folder, by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return tables.read_version(self.spark, f"{self.folder}/{name}", tables.schema_of(name) if name in tables.TABLES else None)

    def write(self, name: str, df: DataFrame) -> str:
        return tables.write_version(df, f"{self.folder}/{name}")


def inventory(run: Run, a) -> str:
    found = tables.scan_files(run.spark, a.videos, a.pattern).withColumn("camera_id", F.lit(a.camera))
    return run.write("video_manifest", tables.conform(found, tables.schema_of("video_manifest")))


def build_manifest(run: Run, a) -> str:
    raws = [tables.read_csv(run.spark, p, "video_manifest") for p in a.raw] or [run.read("video_manifest")]
    return run.write("video_manifest", manifest.canonical_manifest(raws, [tables.read_csv(run.spark, p, "video_manifest") for p in a.correction]))


def import_embeddings(run: Run, a) -> str:
    return run.write("embeddings", tables.read_npz(run.spark, a.npz))


def cluster_run(run: Run, a) -> str:
    e = run.read("embeddings")
    run.write("candidate_pairs", similarity.candidate_pairs(e, a.top_k, "tracklet_id", "embedding", "session_id", "geometry_embedding" if e.where("geometry_embedding IS NOT NULL").head(1) else None))
    return run.write("pseudo_assignments", cluster.greedy_clusters(e, ["session_id", "tracklet_id"], threshold=a.threshold, min_margin=a.margin))


def audit(run: Run, a) -> str:
    own, reviews = run.read("labels"), run.read("pair_reviews")
    found = labels.audit_identities(own, reviews, labels.flagged_tracklets(run.read("tracklet_reviews")))
    run.write("label_conflicts", labels.label_conflicts(own, reviews))
    run.write("label_audit", found)
    return run.write("labels_training_safe", labels.safe_labels(own, found))


def build_gallery(run: Run, a) -> str:
    return run.write("gallery", similarity.build_gallery(run.read("labels_training_safe"), run.read("embeddings"), run.read("tracklets"), labels.flagged_tracklets(run.read("tracklet_reviews"))))


def identify(run: Run, a) -> str:
    gallery, e = run.read("gallery"), run.read("embeddings")
    similarity.check_contract(gallery, e)
    asked = e.select(F.col("tracklet_id").alias("id"), F.col("embedding").alias("vector"))
    own = gallery.select(F.col("tracklet_id").alias("id"), F.col("prototype").alias("vector"), "entity_id")
    return run.write("identity_predictions", similarity.identify(asked, own, a.threshold, a.margin, a.top_k))


def auto_confirm(run: Run, a) -> str:
    own, reviews, applied = merging.auto_confirm(run.read("labels"), run.read("pair_reviews"), run.read("identity_exclusions"), run.read("candidate_pairs"), a.now, a.cosine, a.geometry)
    if a.dry_run:
        shown = applied.orderBy("left_id", "right_id").limit(1000).collect()
        return "\n".join([f"{applied.count()} pairs", *(str(tuple(r)) for r in shown)])
    run.write("pair_reviews", reviews)
    return run.write("labels", own)


def evaluate(run: Run, a) -> str:
    safe = run.read("labels_training_safe").where("training_eligible").select("tracklet_id", "entity_id")
    rows = similarity.evaluate_retrieval(run.read("embeddings").join(safe, "tracklet_id"), "tracklet_id", "embedding", "entity_id", "session_id")
    run.write("retrieval_predictions", rows)
    return run.write("retrieval_summary", similarity.retrieval_summary(run.read("retrieval_predictions")))


def split(run: Run, a) -> str:
    own = run.read("video_manifest")
    videos = splits.date_split(own, a.test_date, a.validation_date) if a.test_date or a.validation_date else splits.last_day_split(own)
    return run.write("splits", splits.track_split(run.read("labels_training_safe"), run.read("tracklets"), videos, labels.flagged_tracklets(run.read("tracklet_reviews")), a.open_set))


def import_posture(run: Run, a) -> str:
    scores = run.spark.read.csv(a.scores, header=True)
    return run.write("posture_observations", posture.import_scores(scores, run.read("tracklets"), run.read("labels"), run.read("video_manifest"), run.read("posture_observations"), a.scores))


def health_refresh(run: Run, a) -> str:
    own = posture.with_current_identity(run.read("posture_observations"), run.read("labels")).withColumn("observed_at", F.try_to_timestamp("observed_at")).withColumn("uncertainty", F.col("measurement_uncertainty"))
    return run.write("health_summaries", posture.health_summaries(own))


def pose_scores(run: Run, a) -> str:
    return run.write("posture_scores", posture.frame_scores(run.read("keypoints")))


def review_bundle(run: Run, a) -> str:
    base, new = Run(run.spark, a.base), Run(run.spark, a.new)
    have = lambda r: {n: r.read(n) for n in (*bundle.TABLES, "embeddings") if tables.has_version(run.spark, f"{r.folder}/{n}")}
    parts = have(new)
    if tables.has_version(run.spark, f"{new.folder}/pseudo_assignments"):
        parts["assignments"] = new.read("pseudo_assignments")
        parts.pop("labels", None)
    return "\n".join(run.write(n, df) for n, df in bundle.review_bundle(have(base), parts, a.now, a.prefix).items())


def ingest(run: Run, a) -> str:
    found = tables.scan_files(run.spark, a.videos, a.pattern)
    return run.write("videos", run.read("videos").unionByName(registry.ingest(run.read("videos"), found, a.camera), allowMissingColumns=True) if tables.has_version(run.spark, f"{run.folder}/videos") else registry.ingest(found.limit(0), found, a.camera))


def timestamp_import(run: Run, a) -> str:
    return run.write("videos", registry.override_times(run.read("videos"), tables.read_csv(run.spark, a.manifest, "video_manifest")))


def _function(name: str | None):
    """module:function, or None."""
    if not name:
        return None
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def process_new(run: Run, a) -> str:
    """Works on the recordings in videos: the stages are functions of the user's modules."""
    own = worker.Worker(run.spark, f"{run.folder}/worker", _function(a.extract), _function(a.embed), _function(a.identify), a.batch, a.lease, a.attempts)
    if tables.has_version(run.spark, f"{run.folder}/videos"):
        own.land(run.read("videos"))
    own.run()
    return run.write("video_states", own.states())


COMMANDS = {
    "inventory": (inventory, {"--videos": {}, "--pattern": {"default": "*.mp4"}, "--camera": {"default": "unknown"}}),
    "build-manifest": (build_manifest, {"--raw": {"action": "append", "default": []}, "--correction": {"action": "append", "default": []}}),
    "import-embeddings": (import_embeddings, {"--npz": {}}),
    "cluster": (cluster_run, {"--threshold": {"type": float, "default": 0.95}, "--margin": {"type": float, "default": 0.02}, "--top-k": {"type": int, "default": 5}}),
    "audit-labels": (audit, {}),
    "build-gallery": (build_gallery, {}),
    "identify": (identify, {"--threshold": {"type": float, "default": 0.95}, "--margin": {"type": float, "default": 0.02}, "--top-k": {"type": int, "default": 5}}),
    "auto-confirm": (auto_confirm, {"--cosine": {"type": float, "default": 0.95}, "--geometry": {"type": float, "default": 0.5}, "--dry-run": {"action": "store_true"}}),
    "evaluate": (evaluate, {}),
    "split": (split, {"--test-date": {"action": "append", "default": []}, "--validation-date": {"action": "append", "default": []}, "--open-set": {"action": "append", "default": []}}),
    "import-posture": (import_posture, {"--scores": {}}),
    "health-refresh": (health_refresh, {}),
    "pose-scores": (pose_scores, {}),
    "review-bundle": (review_bundle, {"--base": {}, "--new": {}, "--prefix": {"default": "NEW_"}}),
    "ingest": (ingest, {"--videos": {}, "--pattern": {"default": "*.mp4"}, "--camera": {"default": "unknown"}}),
    "process-new": (process_new, {"--extract": {}, "--embed": {}, "--identify": {"default": None}, "--batch": {"type": int, "default": 1000}, "--lease": {"type": float, "default": 21600.0}, "--attempts": {"type": int, "default": 3}}),
    "timestamp-import": (timestamp_import, {"--manifest": {}}),
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="trackloom", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    for name, (_, options) in COMMANDS.items():
        one = commands.add_parser(name)
        one.add_argument("run")
        one.add_argument("--now", default=datetime.now(timezone.utc).isoformat(timespec="seconds"))
        for option, how in options.items():
            one.add_argument(option, **({"required": True} if not how else how))
    return top


def main(argv: list[str] | None = None) -> str:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    out = COMMANDS[a.command][0](Run(spark, a.run), a)
    print(out)
    return out


if __name__ == "__main__":
    main()
