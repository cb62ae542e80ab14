"""Exact vector search and what is built on it.

All pairs of two vector tables are compared block by block: each side is dealt
to blocks of about BLOCK rows, every pair of blocks is one grouped task that
multiplies two matrices and keeps the best few of each query, and a window
merges those.  Nothing is broadcast and no row is made for a pair.  Top-k search
takes larger blocks as the table grows, so that a row is copied to few of them,
and evaluation, which ranks every positive, one block of queries at a time
against all candidates.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from trackloom.functions import exprs, windows

BLOCK = 4096
#: Rows and bytes of double vectors that a large block may have.
LARGE, LARGE_BYTES = 1 << 15, 1 << 26
#: Similarities that agree to this many places are ties, broken by the candidate's id.
PLACES = 9


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), -1)


def normalized(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def _dealt(df: DataFrame, id_col: str, blocks: int, others: int, first: bool, key: Column | None = None) -> DataFrame:
    own = F.pmod(F.xxhash64(key if key is not None else id_col), F.lit(blocks)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
    return df.withColumn("qb" if first else "cb", own).withColumn("cb" if first else "qb", other).withColumn("is_query", F.lit(first))


def block_compare(queries: DataFrame, candidates: DataFrame, kernel: Callable[[pa.Table, pa.Table], pa.Table], schema: str, candidate_key: Column | None = None, block: int | tuple[int, int] = BLOCK) -> DataFrame:
    """kernel(queries, candidates) for every pair of blocks.

    Both tables have id, vector and the same further columns; candidates with
    equal candidate_key meet in one block.  block is the rows of a block, or the
    numbers of blocks of both sides.
    """
    nq, nc = block if isinstance(block, tuple) else (max(1, -(-df.count() // block)) for df in (queries, candidates))
    both = _dealt(queries, "id", nq, nc, True).unionByName(_dealt(candidates, "id", nc, nq, False, candidate_key), allowMissingColumns=True)
    empty = to_arrow_schema(T.StructType.fromDDL(schema)).empty_table()

    def run(group: pa.Table) -> pa.Table:
        mask = group.column("is_query")
        q, c = group.filter(mask), group.filter(pc.invert(mask))
        return kernel(q, c) if len(q) and len(c) else empty

    if nc == 1:  # few blocks of much work: by ranges, as several of them would meet by hash in one task
        both = both.repartitionByRange(4 * nq, "qb")
    return both.groupBy("qb", "cb").applyInArrow(run, schema)


def _large_blocks(vectors: DataFrame, most: int) -> int:
    """Blocks for a table (id, vector): up to most while blocks of 2048 rows fill them, then as many as large blocks need."""
    n, width = vectors.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(1))).first()
    rows = max(BLOCK // 4, min(LARGE, LARGE_BYTES // (8 * max(width, 1))))
    return max(1, -(-n // rows), min(most, -(-n // 2048)))


def _codes(a: pa.ChunkedArray, b: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the values of two columns, equal where the values are; nulls are equal."""
    both = pa.chunked_array([*a.chunks, *b.chunks], a.type).combine_chunks()
    codes = np.asarray(both.dictionary_encode().indices.fill_null(-1)).astype(np.int64)
    return codes[: len(a)], codes[len(a) :]


def _equal_runs(asked: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the codes that equal each asked one begin and end in sorted codes."""
    return np.searchsorted(codes, asked, "left"), np.searchsorted(codes, asked, "right")


def _best_of_others(a: np.ndarray, b: np.ndarray, qs: np.ndarray, cs: np.ndarray, qid: np.ndarray, cid: np.ndarray, by_id: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and cosine of the k best of each row of a among the rows of b of another session and id.

    Products in single precision choose: of many groups of columns the k-th
    greatest maximum is no more than the k-th greatest product, so what lies below it by more
    than the error of both can't be among the best.  The rest is multiplied
    again in double precision and ranked as _best ranks; rows where many are left (copies of one
    vector) are ranked whole.
    """
    place = np.empty(len(cid), np.int64)
    place[by_id] = np.arange(len(cid))
    groups = max(64, 4 * k)
    by = np.argsort(cs, kind="stable")
    width = -(-len(by) // groups) * groups
    small = np.zeros((width, b.shape[1]), np.float32)
    small[: len(by)] = b[by]
    left, right = _equal_runs(qs, cs[by])
    own = np.argsort(cid[by], kind="stable")
    first, last = _equal_runs(qid, cid[by][own])
    slack = np.float32(2 * (b.shape[1] + 8) * 1.2e-7)
    step = max(1, (1 << 22) // width)
    out = []

    def hide(scores, lo):
        for r in range(len(scores)):
            scores[r, left[lo + r] : right[lo + r]] = -np.inf
            if last[lo + r] > first[lo + r]:
                scores[r, own[first[lo + r] : last[lo + r]]] = -np.inf

    for lo in range(0, len(a), step):
        scores = a[lo : lo + step].astype(np.float32) @ small.T
        scores[:, len(by) :] = -np.inf
        hide(scores, lo)
        most = scores.reshape(len(scores), groups, -1).max(axis=2)
        bar = np.partition(most, groups - k, axis=1)[:, groups - k] - slack
        near = scores >= np.maximum(bar, np.float32(-3.0))[:, None]  # -inf never counts
        many = np.count_nonzero(near, axis=1) > 1024
        for r in np.flatnonzero(many):
            whole = (b @ a[lo + r])[by]
            hide(whole[None], lo + r)
            i, j = _best(whole[None], place[by], k)
            out.append((np.full(len(j), lo + r), by[j], whole[j]))
        near[many] = False
        i, j = np.nonzero(near)
        exact = np.concatenate([np.einsum("ij,ij->i", a[lo + i[n : n + 65536]], b[by[j[n : n + 65536]]]) for n in range(0, max(len(i), 1), 65536)])
        order = np.lexsort((place[by[j]], -np.round(exact, PLACES), i))
        i, j, exact = i[order], j[order], exact[order]
        kept = np.arange(len(i)) - np.searchsorted(i, i) < k
        out.append((lo + i[kept], by[j[kept]], exact[kept]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k best of each row by score, then the least id; -inf doesn't count."""
    rounded = np.round(scores, PLACES)
    by_id = np.argsort(ids, kind="stable")
    order = by_id[np.argsort(-rounded[:, by_id], axis=1, kind="stable")[:, :k]]
    rows = np.repeat(np.arange(len(scores)), order.shape[1])
    good = np.isfinite(scores[rows, order.ravel()])
    return rows[good], order.ravel()[good]


def candidate_pairs(vectors: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", session: str | Column = "session_id", geometry: str | Column | None = None) -> DataFrame:
    """The k most similar rows of other sessions for every row: query_id, query_session, rank, candidate_id, candidate_session, cosine, geometry_cosine.

    Geometry vectors, where given, only add the similarity of the chosen pairs.
    """
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    own = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), as_column(session).alias("session"), *([as_column(geometry).alias("geometry")] if geometry is not None else []))
    kinds = {f.name: f.dataType.simpleString() for f in own.schema}
    has_geometry = geometry is not None

    def kernel(q: pa.Table, c: pa.Table) -> pa.Table:
        names = ["query_id", "query_session", "candidate_id", "candidate_session", "cosine", "geometry_cosine"]
        by_id = np.argsort(np.array(c.column("id").to_pylist()), kind="stable")
        qs, cs = _codes(q.column("session"), c.column("session"))
        i, j, s = _best_of_others(normalized(_matrix(q.column("vector"))), normalized(_matrix(c.column("vector"))), qs, cs, *_codes(q.column("id"), c.column("id")), by_id, k)
        if not has_geometry:
            g = pa.nulls(len(i), pa.float64())
        else:
            ga, gb = (normalized(_matrix(t.column("geometry"))) for t in (q, c))
            g = pa.array(np.einsum("ij,ij->i", ga[i], gb[j]))
        i, j = pa.array(i), pa.array(j)
        return pa.table([q.column("id").take(i), q.column("session").take(i), c.column("id").take(j), c.column("session").take(j), pa.array(s), g], names=names)

    found = block_compare(own, own, kernel, f"query_id {kinds['id']}, query_session {kinds['session']}, candidate_id {kinds['id']}, candidate_session {kinds['session']}, cosine double, geometry_cosine double", block=(_large_blocks(own, 6),) * 2)
    best = windows.top_k(found, ["query_id"], k, F.round("cosine", PLACES).desc(), F.col("candidate_id").asc())
    return best.select("query_id", "query_session", "rank", "candidate_id", "candidate_session", "cosine", "geometry_cosine")


def candidate_pairs_by_join(vectors: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", session: str | Column = "session_id") -> DataFrame:
    """candidate_pairs as a join of expressions: slower, for checks of the block kernel on small tables."""
    s = F.col(session) if isinstance(session, str) else session
    own = vectors.select(F.col(id_col).alias("id"), s.alias("session"), exprs.unit(F.col(vector_col)).alias("v"))
    a, b = own.alias("a"), own.alias("b")
    pairs = a.join(b, (F.col("a.session") != F.col("b.session")) & (F.col("a.id") != F.col("b.id"))).select(F.col("a.id").alias("query_id"), F.col("b.id").alias("candidate_id"), exprs.dot(F.col("a.v"), F.col("b.v")).alias("cosine"))
    return windows.top_k(pairs, ["query_id"], k, F.round("cosine", PLACES).desc(), F.col("candidate_id").asc())


def mutual_best(pairs: DataFrame) -> DataFrame:
    """left_id < right_id, cosine and geometry_cosine of pairs where each is the other's first candidate."""
    first = pairs.where("rank = 1")
    a, b = first.alias("a"), first.select("query_id", "candidate_id").alias("b")
    both = a.join(b, (F.col("a.query_id") == F.col("b.candidate_id")) & (F.col("a.candidate_id") == F.col("b.query_id")))
    return both.where("a.query_id < a.candidate_id").select(F.col("a.query_id").alias("left_id"), F.col("a.candidate_id").alias("right_id"), "a.cosine", "a.geometry_cosine")


def mean_prototypes(vectors: DataFrame, key: str, vector_col: str = "embedding", weight: Column | None = None) -> DataFrame:
    """key, prototype (mean of unit vectors at length one) and members; means by dimension combine before the shuffle."""
    unit = exprs.unit(F.col(vector_col)) if weight is None else exprs.doubles(F.col(vector_col))
    long = vectors.select(key, (F.lit(1.0) if weight is None else weight).alias("w"), F.posexplode(unit).alias("dim", "x"))
    means = long.groupBy(key, "dim").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("x"), F.count("*").alias("members"))
    rows = means.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("a"), F.max("members").alias("members"))
    return rows.select(key, exprs.unit(F.transform("a", lambda s: s["x"])).alias("prototype"), "members")


def pooled_embeddings(frames: DataFrame, key: str, vector_col: str, quality_col: str, floor: float = 0.05) -> DataFrame:
    """One vector a track: the mean of its frames by quality, none counting less than floor, at length one."""
    return mean_prototypes(frames, key, vector_col, F.greatest(F.col(quality_col), F.lit(floor)))


def build_gallery(labels: DataFrame, embeddings: DataFrame, tracks: DataFrame, flagged: DataFrame | None = None) -> DataFrame:
    """A prototype for every labelled, confirmed, eligible and unflagged track: entity_id, tracklet_id, prototype, flank, view, domain, provenance."""
    own = labels.withColumn("entity_id", F.trim("entity_id")).where("entity_id <> ''")
    for flag in ("confirmed", "training_eligible"):
        if flag in own.columns:
            own = own.where(F.coalesce(flag, F.lit(False)))
    if flagged is not None:
        own = own.join(flagged, "tracklet_id", "left_anti")
    view = F.coalesce(*(c for c in ("view", "camera_id") if c in tracks.columns), F.lit("unknown"))
    place = lambda c: F.coalesce(c, F.lit("unknown")).alias(c) if c in tracks.columns else F.lit("unknown").alias(c)
    places = tracks.dropDuplicates(["tracklet_id"]).select("tracklet_id", place("flank"), view.alias("view"), place("domain"))
    kept = [c for c in PROVENANCE if c in embeddings.columns]
    prototypes = embeddings.select("tracklet_id", exprs.unit(F.col("embedding")).alias("prototype"), *kept)
    unknown = {c: F.coalesce(c, F.lit("unknown")) for c in ("flank", "view", "domain")}
    return own.select("tracklet_id", "entity_id").join(prototypes, "tracklet_id").join(places, "tracklet_id", "left").withColumns(unknown)


#: Columns that say how an embedding was made, and those that must agree.
PROVENANCE = ("backend", "checkpoint", "checkpoint_sha256", "preprocessing_profile", "crop_version", "embedding_schema_version")
CONTENT = PROVENANCE[2:]


def check_contract(gallery: DataFrame, queries: DataFrame) -> None:
    """Raises where a side mixes known provenance, or both sides' is known and differs; unknown content fields fall back to backend and checkpoint.

    Of each field the least and the greatest known value are looked at, so two
    values of one side are seen wherever they are.
    """
    def known(df: DataFrame, side: str) -> dict:
        given = [c for c in PROVENANCE if c in df.columns]
        value = {c: F.when(~F.coalesce(F.col(c).cast("string"), F.lit("")).isin("", "unknown"), F.col(c).cast("string")) for c in given}
        row = df.agg(*(f(v).alias(f"{n}_{c}") for c, v in value.items() for n, f in (("least", F.min), ("greatest", F.max)))).first() if given else {}
        mixed = [c for c in given if row[f"least_{c}"] != row[f"greatest_{c}"]]
        if mixed:
            raise ValueError(f"{side} mix embeddings of different {', '.join(mixed)}")
        return {c: row[f"least_{c}"] for c in given if row[f"least_{c}"] is not None}

    a, b = known(gallery, "the gallery's prototypes"), known(queries, "the queries")
    both = [c for c in PROVENANCE if c in a and c in b]
    hard = [c for c in both if c in CONTENT]
    soft = [] if len(hard) == len(CONTENT) else [c for c in both if c not in CONTENT]
    for c in hard + soft:
        if a[c] != b[c]:
            raise ValueError(f"gallery and queries disagree on {c}: {a[c]!r}, {b[c]!r}")


#: An entity of more prototypes is cut into slices of this many, so that no block holds more than a few of them.
SLICE = BLOCK // 4


def entity_scores(queries: DataFrame, gallery: DataFrame, k: int | None = None) -> DataFrame:
    """id, entity_id and score of every query and entity, or of at least the k best entities of each query.

    One prototype gives its similarity; more give 0.7 of the best and 0.3 of the
    median of the best three.  An entity's prototypes lie in one block, whose
    task finishes its score; entities of more than SLICE prototypes lie in one
    block for each slice, which gives their best three, and those merge.  So with
    k a query makes k rows a block and one row for each slice of a large entity.
    """
    kind = queries.schema["id"].dataType.simpleString()

    def kernel(q: pa.Table, c: pa.Table) -> pa.Table:
        names, owner = np.unique(np.array(c.column("entity").to_pylist(), object).astype(str), return_inverse=True)
        a, b = normalized(_matrix(q.column("vector"))), normalized(_matrix(c.column("vector")))
        by = np.argsort(owner, kind="stable")
        cuts = np.searchsorted(owner[by], np.arange(len(names) + 1))
        sizes = np.diff(cuts)
        cut = np.zeros(len(names), bool)
        cut[owner] = c.column("slices").to_numpy() > 1
        whole, qid = np.flatnonzero(~cut), q.column("id")
        rows, entities, best = [], [], []
        for lo in range(0, len(q), 512):
            scores = a[lo : lo + 512] @ b[by].T
            three = np.full((len(scores), len(names), 3), np.nan)
            for e, n in enumerate(np.minimum(sizes, 3)):
                three[:, e, :n] = np.sort(scores[:, cuts[e] : cuts[e + 1]], axis=1)[:, : -n - 1 : -1]
            if k is None:
                i, j = (x.ravel() for x in np.indices(three.shape[:2]))
            else:
                i, j = _best(_entity_score(three[:, whole], sizes[whole]), names[whole], k)
                more, large = (x.ravel() for x in np.meshgrid(np.arange(len(scores)), np.flatnonzero(cut), indexing="ij"))
                i, j = np.concatenate([i, more]), np.concatenate([whole[j], large])
            rows.append(i + lo)
            entities.append(j)
            best.append(three[i, j])
        i, j = np.concatenate(rows), np.concatenate(entities)
        kept = np.minimum(sizes[j], 3)
        flat = np.concatenate(best)[np.arange(3) < kept[:, None]]
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(kept)]), pa.int32()), pa.array(flat))
        return pa.table([qid.take(pa.array(i)), pa.array(names.astype(object)[j], pa.string()), lists, pa.array(sizes[j], pa.int64())], names=["id", "entity_id", "best", "n"])

    prototypes = gallery.select("id", "vector", F.col("entity_id").cast("string").alias("entity"))
    large = prototypes.groupBy("entity").agg(F.ceil(F.count("*") / F.lit(SLICE)).alias("slices")).where("slices > 1")
    dealt = prototypes.join(large, "entity", "left").select("id", "vector", "entity", F.coalesce("slices", F.lit(1)).alias("slices"))
    place = F.struct("entity", F.pmod(F.xxhash64("id"), F.col("slices")))
    none = queries.select("id", "vector", F.lit(None).cast("string").alias("entity"), F.lit(1).cast("bigint").alias("slices"))
    parts = block_compare(none, dealt, kernel, f"id {kind}, entity_id string, best array<double>, n bigint", candidate_key=place)
    merged = parts.groupBy("id", "entity_id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("best")), asc=False), 1, 3).alias("best"), F.sum("n").alias("n"))
    top = F.element_at("best", 1)
    return merged.select("id", "entity_id", F.when(F.col("n") == 1, top).otherwise(0.7 * top + 0.3 * windows.array_median(F.col("best"))).alias("score"))


def _entity_score(three: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Scores from the best three similarities (last axis, descending) of entities of these sizes."""
    first, second = three[..., 0], three[..., 1]
    middle = np.where(sizes == 2, (first + second) / 2, second)
    return np.where(sizes == 1, first, 0.7 * first + 0.3 * middle)


def identify(queries: DataFrame, gallery: DataFrame, threshold: float = 0.95, min_margin: float = 0.02, k: int = 5) -> DataFrame:
    """id, predicted, confidence, is_unknown, is_ambiguous, margin and candidates, the k best (entity_id, score)."""
    scores = entity_scores(queries, gallery, max(k, 2))
    ranked = windows.top_k(scores, ["id"], max(k, 2), F.round("score", PLACES).desc(), F.col("entity_id").asc())
    rows = ranked.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "entity_id", "score"))).alias("r"))
    best, second = F.element_at("r", 1), F.try_element_at("r", F.lit(2)) if k > 1 else F.lit(None)
    margin = best["score"] - F.coalesce(second["score"] if k > 1 else second, F.lit(-1.0))
    unknown = F.round(best["score"], PLACES) < threshold
    ambiguous = ~unknown & (F.round(margin, PLACES) < min_margin)
    return rows.select(
        "id",
        F.when(unknown, "UNKNOWN").when(ambiguous, "AMBIGUOUS").otherwise(best["entity_id"]).alias("predicted"),
        best["score"].alias("confidence"),
        unknown.alias("is_unknown"),
        ambiguous.alias("is_ambiguous"),
        margin.alias("margin"),
        F.transform(F.slice("r", 1, k), lambda x: F.struct(x["entity_id"], x["score"])).alias("candidates"),
    )


def wide(predictions: DataFrame, k: int = 5) -> DataFrame:
    """Candidates as columns top_1_id, top_1_score and so on."""
    at = lambda i: F.try_element_at("candidates", F.lit(i))
    return predictions.select("id", "predicted", *(c for i in range(1, k + 1) for c in (at(i)["entity_id"].alias(f"top_{i}_id"), at(i)["score"].alias(f"top_{i}_score"))))


def identify_summary(predictions: DataFrame) -> DataFrame:
    """One row of counts; known counts all that aren't unknown, known_strict leaves the ambiguous out."""
    return predictions.agg(F.count("*").alias("queries"), F.count_if(~F.col("is_unknown")).alias("known"), F.count_if("is_unknown").alias("unknown"), F.count_if("is_ambiguous").alias("ambiguous"), F.count_if(~F.col("is_unknown") & ~F.col("is_ambiguous")).alias("known_strict"))


def entity_candidates(vectors: DataFrame, labels: DataFrame, entity: str, k: int = 20, exclusions: DataFrame | None = None, exclude_assigned: bool = True, exclude_seen_sessions: bool = True) -> DataFrame:
    """Tracks most like an entity's mean: tracklet_id, session_id, similarity.

    Left out: its own and rejected tracks, tracks confirmed for others, and
    sessions where it is seen already.
    """
    own = labels.where(F.coalesce("confirmed", F.lit(False)) & (F.col("entity_id") == entity))
    prototype = mean_prototypes(vectors.join(own.select("tracklet_id"), "tracklet_id", "left_semi").withColumn("__e", F.lit(1)), "__e").select("prototype")
    pool = vectors.select("tracklet_id", "embedding").join(labels.select("tracklet_id", "session_id", "entity_id", "confirmed").dropDuplicates(["tracklet_id"]), "tracklet_id").join(own.select("tracklet_id"), "tracklet_id", "left_anti")
    if exclusions is not None:
        pool = pool.join(exclusions.where(F.col("entity_id") == entity).select("tracklet_id"), "tracklet_id", "left_anti")
    if exclude_assigned:
        pool = pool.where(~(F.coalesce("confirmed", F.lit(False)) & (F.coalesce("entity_id", F.lit("")) != "")))
    if exclude_seen_sessions:
        pool = pool.join(own.select("session_id").distinct(), "session_id", "left_anti")
    scored = pool.join(F.broadcast(prototype)).select("tracklet_id", "session_id", exprs.dot(exprs.unit(F.col("embedding")), F.col("prototype")).alias("similarity"))  # one prototype
    return scored.orderBy(F.round("similarity", PLACES).desc(), "tracklet_id").limit(k)


#: Ranking keys: twice the rounded similarity downwards, so that twice the unit fits 32 bits; those that aren't numbers come last, hidden ones not at all.
UNKNOWN, HIDDEN = np.int32(2_100_000_000), np.int32(2**31 - 1)
#: Keys that a task holds at once, and columns of one product.
KEYS, COLUMNS = 1 << 24, 2048


def _ranked_positives(q: pa.Table, c: pa.Table) -> pa.Table:
    """What evaluate_retrieval returns for queries against all candidates.

    A candidate is a 32-bit key: its rounded similarity, then whether it is of
    the query's entity.  Sorted, those are the ranking but for the places of
    equal similarities, which are found by id where an entity's own and others
    are equal.  Products are made for some queries at once, column block by
    column block, but for those of the queries' own session; their keys take
    64 MB at most, or those of 8 queries.
    """
    by_id = np.argsort(np.array(c.column("id").to_pylist()), kind="stable")
    q = q.take(pa.array(np.argsort(_codes(q.column("session"), c.column("session"))[0], kind="stable")))
    (qs, cs), (qe, ce), (qid, cid) = (_codes(q.column(n), c.column(n)) for n in ("session", "entity", "id"))
    by = by_id[np.argsort(cs[by_id], kind="stable")]
    a, b = normalized(_matrix(q.column("vector"))), _matrix(c.column("vector"))[by]
    b /= np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-12)
    place, unit = np.empty(len(by), np.int64), 10**PLACES
    place[by_id] = np.arange(len(by))
    place = place[by]
    left, right = _equal_runs(qs, cs[by])
    ids, entities = (np.argsort(x[by], kind="stable") for x in (cid, ce))
    first, last = _equal_runs(qid, cid[by][ids])
    begin, end = _equal_runs(qe, ce[by][entities])
    lost, lost_rows = np.flatnonzero(np.isnan(b).any(axis=1)), np.isnan(a).any(axis=1)
    step = max(8, min(128, KEYS // len(by)))
    keys, out = np.empty((min(step, len(a)), len(by)), np.int32), []
    for lo in range(0, len(a), step):
        block = a[lo : lo + step]
        none = left[lo : lo + step].max(), right[lo : lo + step].min()  # columns hidden from all of the block
        for at in range(0, len(by), COLUMNS):
            if none[0] <= at and at + COLUMNS <= none[1]:
                continue
            scores = block @ b[at : at + COLUMNS].T
            scores *= -float(unit)
            np.rint(scores, out=scores)
            scores += scores
            with np.errstate(invalid="ignore"):
                keys[: len(block), at : at + COLUMNS] = scores.astype(np.int32)
        keys[:, lost] = UNKNOWN
        keys[: len(block)][lost_rows[lo : lo + step]] = UNKNOWN
        for n, row in enumerate(range(lo, lo + len(block))):
            own, mine, same = keys[n], entities[begin[row] : end[row]], ids[first[row] : last[row]]
            own[mine] |= 1
            own[left[row] : right[row]] = HIDDEN
            own[same] = HIDDEN
            ranked = np.concatenate([own[: left[row]], own[right[row] :]])
            ranked.sort()
            ranked = ranked[: len(ranked) - np.count_nonzero((same < left[row]) | (same >= right[row]))]
            found = np.flatnonzero((ranked & 1).astype(bool))
            if len(found):
                ranks = _ranks(own, mine, ranked, found, place)
                best = int(own.argmin())
                if len(ranked) > 1 and ranked[0] | 1 == ranked[1] | 1:
                    equal = np.flatnonzero((own | 1) == ranked[0] | 1)
                    best = equal[place[equal].argmin()]
                away = int(ranked[0]) >> 1
                out.append((row, by[best], np.nan if away > unit + 9 else -away / unit, ranks[0], (np.arange(1, len(ranks) + 1) / ranks).mean(), len(ranked)))
    i, best, similarity, rank, precision, eligible = zip(*out) if out else [()] * 6
    rows = [q.column(n).combine_chunks().take(pa.array(i, pa.int64())) for n in ("id", "entity")]
    return pa.table([*rows, c.column("id").combine_chunks().take(pa.array(best, pa.int64())), pa.array(similarity, pa.float64()), pa.array(rank, pa.int64()), pa.array(precision, pa.float64()), pa.array(eligible, pa.int64())], names=["query_id", "entity", "best_candidate_id", "best_similarity", "correct_rank", "average_precision", "eligible"])


def _ranks(own: np.ndarray, mine: np.ndarray, ranked: np.ndarray, found: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Ranks, ascending, of a query's own candidates (columns mine) from keys by column, those in order and where odd ones lie in it.

    Keys say the ranks but where others have the same similarity: those lie just
    before, and all of such a similarity are put in order by place.
    """
    ranks, odd = found + 1, ranked[found]
    mixed = odd[(found > 0) & (ranked[found - 1] == odd - 1)] - 1
    if not len(mixed):
        return ranks
    marks = np.zeros(1 << 16, bool)
    marks[mixed & 0xFFFF] = True

    def among(keys: np.ndarray) -> np.ndarray:
        near = np.flatnonzero(marks.take(keys & 0xFFFF))
        return near[mixed[np.minimum(np.searchsorted(mixed, keys[near]), len(mixed) - 1)] == keys[near]]

    others, tied = among(own), mine[among(own[mine] - 1)]
    order = np.concatenate([(own[others].astype(np.int64) << 32) + (place[others] << 1), ((own[tied].astype(np.int64) - 1) << 32) + (place[tied] << 1) + 1])
    order.sort()
    value = order >> 32
    rank = np.searchsorted(ranked, value) + np.arange(len(order)) - np.searchsorted(value, value) + 1
    ranks[among(odd - 1)] = rank[(order & 1).astype(bool)]
    return ranks


def evaluate_retrieval(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", entity: str | Column = "label", session: str | Column = "session_id") -> DataFrame:
    """Cross-session leave-one-out retrieval, a row for each query with a positive: query_id, entity, best_candidate_id, best_similarity, correct_rank, top1, top5, average_precision, eligible.

    Average precision needs the rank of every positive among all candidates,
    and there are quadratically many of them: a block of queries meets all
    candidates in one task, which ranks a few queries at a time and returns one
    row for each, so neither positives nor ranks are ever stored.  A task holds
    the candidates' vectors: 0.8 GB for a million of 64 dimensions, by when the
    comparisons themselves take hours.
    """
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    own = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), as_column(entity).alias("entity"), as_column(session).alias("session"))
    kinds = {f.name: f.dataType.simpleString() for f in own.schema}
    schema = f"query_id {kinds['id']}, entity {kinds['entity']}, best_candidate_id {kinds['id']}, best_similarity double, correct_rank bigint, average_precision double, eligible bigint"
    rows = block_compare(own, own, _ranked_positives, schema, block=(_large_blocks(own, 24), 1))
    return rows.select("query_id", "entity", "best_candidate_id", "best_similarity", "correct_rank", (F.col("correct_rank") == 1).alias("top1"), (F.col("correct_rank") <= 5).alias("top5"), "average_precision", "eligible")


def retrieval_summary(rows: DataFrame) -> DataFrame:
    """One row: queries, top1, top5, mean average precision and median rank; null without queries."""
    return rows.agg(F.count("*").alias("queries"), F.avg(F.col("top1").cast("int")).alias("top1"), F.avg(F.col("top5").cast("int")).alias("top5"), F.avg("average_precision").alias("mean_ap"), F.percentile("correct_rank", F.lit(0.5)).alias("median_rank"))


def rank_summary(ranks: DataFrame) -> DataFrame:
    """One row: queries, top1 and mean average precision of ranks of one relevant item each, whose precision is one by the rank."""
    return ranks.agg(F.count("*").alias("queries"), F.avg((F.col("rank") == 1).cast("int")).alias("top1"), F.avg(1 / F.col("rank")).alias("mean_ap"))


def track_embeddings(frames: DataFrame, tracks: DataFrame, flagged: DataFrame | None = None, backend: str = "unknown", checkpoint: str = "unknown", checkpoint_sha256: str = "", profile: str = "unknown", schema_version: str = "1", floor: float = 0.05) -> DataFrame:
    """The embeddings table of the valid, unflagged tracks: both vectors of their frames pooled by quality, with provenance.

    frames has tracklet_id, embedding, geometry_embedding and quality.  The crop
    version is that of the tracks if they have one only, else unknown; the
    schema version begins with the vector's size.  frames_used and
    mean_frame_quality say what went in.
    """
    valid = tracks.where(F.coalesce("valid", F.lit(False)))
    if flagged is not None:
        valid = valid.join(flagged.select("tracklet_id"), "tracklet_id", "left_anti")
    own = frames.join(valid.select("tracklet_id"), "tracklet_id", "left_semi")
    pooled = pooled_embeddings(own, "tracklet_id", "embedding", "quality", floor).select("tracklet_id", F.col("prototype").cast("array<float>").alias("embedding"))
    layout = pooled_embeddings(own, "tracklet_id", "geometry_embedding", "quality", floor).select("tracklet_id", F.col("prototype").cast("array<float>").alias("geometry_embedding"))
    used = own.groupBy("tracklet_id").agg(F.count("*").alias("frames_used"), F.avg("quality").alias("mean_frame_quality"))
    crop = F.coalesce("crop_version", F.lit("unknown")) if "crop_version" in valid.columns else F.lit("unknown")
    one = valid.join(used.select("tracklet_id"), "tracklet_id", "left_semi").agg(F.when(F.min(crop) == F.max(crop), F.min(crop)).otherwise("unknown").alias("crop_version"))
    places = valid.select("tracklet_id", "session_id", "video_id").dropDuplicates(["tracklet_id"])
    joined = places.join(pooled, "tracklet_id").join(layout, "tracklet_id").join(used, "tracklet_id").join(F.broadcast(one))  # one row
    return joined.select(
        "tracklet_id", "session_id", "video_id", "embedding", "geometry_embedding", F.lit(backend).alias("backend"), F.lit(checkpoint).alias("checkpoint"), F.lit(checkpoint_sha256).alias("checkpoint_sha256"),
        F.lit(profile).alias("preprocessing_profile"), "crop_version", F.concat_ws("d_", F.size("embedding"), F.lit(schema_version)).alias("embedding_schema_version"), "frames_used", "mean_frame_quality",
    )


def prototype_retrieval(train: DataFrame, queries: DataFrame, entity_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """id, entity and rank of the query's own entity among the mean prototypes of train; queries of unseen entities are left out.

    The rank is one more than the number of prototypes that score higher (or
    the same with a greater name), summed over blocks.
    """
    prototypes = mean_prototypes(train, entity_col, vector_col).select(F.col(entity_col).alias("id"), F.col("prototype").alias("vector"))
    asked = queries.select(F.col("id"), F.col(vector_col).alias("vector"), F.col(entity_col).alias("entity"))
    own = asked.join(prototypes.select(F.col("id").alias("entity"), F.col("vector").alias("own")), "entity")
    scored = own.withColumn("score", exprs.dot(F.col("vector"), F.col("own"))).select("id", "vector", "entity", "score")
    kind, ekind = scored.schema["id"].dataType.simpleString(), scored.schema["entity"].dataType.simpleString()

    def kernel(q: pa.Table, c: pa.Table) -> pa.Table:
        scores = np.round(_matrix(q.column("vector")) @ _matrix(c.column("vector")).T, PLACES)
        mine = np.round(q.column("score").to_numpy(), PLACES)[:, None]
        names, entity = np.array(c.column("id").to_pylist()), np.array(q.column("entity").to_pylist())
        other = entity[:, None] != names[None]
        before = (other & ((scores > mine) | ((scores == mine) & (names[None] > entity[:, None])))).sum(axis=1)
        return pa.table([q.column("id").combine_chunks(), q.column("entity").combine_chunks(), pa.array(before, pa.int64())], names=["id", "entity", "before"])

    parts = block_compare(scored, prototypes.withColumn("id", F.col("id").cast(ekind)), kernel, f"id {kind}, entity {ekind}, before bigint") if kind == ekind else _prototype_parts(scored, prototypes, kernel, kind, ekind)
    return parts.groupBy("id", "entity").agg((F.sum("before") + 1).alias("rank"))


def _prototype_parts(scored: DataFrame, prototypes: DataFrame, kernel, kind: str, ekind: str) -> DataFrame:
    """Queries' and prototypes' ids of different types share a block task as text and are cast back."""
    as_text = lambda df: df.withColumn("id", F.col("id").cast("string"))
    texts = block_compare(as_text(scored).withColumn("entity", F.col("entity").cast("string")), as_text(prototypes), kernel, "id string, entity string, before bigint")
    return texts.withColumns({"id": F.col("id").cast(kind), "entity": F.col("entity").cast(ekind)})


def unit_vectors(df: DataFrame, vector_col: str) -> DataFrame:
    return df.withColumn(vector_col, exprs.unit(F.col(vector_col)))
