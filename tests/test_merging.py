import random

import pytest

from trackloom.functions import graphs
from trackloom.operators import merging
from trackloom.sources.tables import schema_of

NOW = "2024-01-01"


def natural(name):
    head, _, tail = name.rpartition("_")
    return (0, int(tail), "") if head == "COW" and tail.isdigit() else (1, 0, name)


def plain(names, different, barred, pairs, greatest):
    """One pair after the other; new names are numbered as made, then without gaps among those that stay."""
    own, made, accepted = dict(names), [], []
    for a, b in sorted({tuple(sorted(p)) for p in pairs if p[0] != p[1]}):
        if a not in own or b not in own or own[a] and own[a] == own[b] or (own[b], a) in barred or (own[a], b) in barred:
            continue
        old = {own[a], own[b]} - {""}
        members = {t for t in own if own[t] in old} | {a, b}
        if any(x in members and y in members for x, y in different):
            continue
        made += [] if old else [f"COW_{greatest + len(made) + 1:04d}"]
        new = min(old, key=natural) if old else made[-1]
        own.update(dict.fromkeys(members, new))
        accepted.append((a, b))
    left = [m for m in made if m in own.values()]
    renamed = {m: f"COW_{greatest + k + 1:04d}" for k, m in enumerate(left)}
    own = {t: renamed.get(n, n) for t, n in own.items()}
    return own, [(a, b, own[a]) for a, b in accepted]


def tables_of(spark, names, different, barred, pairs):
    labels = spark.createDataFrame([(t, "", "s", "v", n, bool(n), "old", "kept", "") for t, n in names.items()], schema_of("labels"))
    reviews = spark.createDataFrame([(a, b, "different", "", None, "", "") for a, b in different], schema_of("pair_reviews"))
    exclusions = spark.createDataFrame([(e, t, "", "") for e, t in barred], schema_of("identity_exclusions"))
    return labels, reviews, exclusions, spark.createDataFrame([(a, b, 0.9) for a, b in pairs], "left_id string, right_id string, cosine double")


@pytest.mark.parametrize("seed", range(3))
def test_equals_one_by_one(spark, seed):
    """Many small random graphs side by side, some with decisions, exclusions and names of all kinds, some without."""
    rng = random.Random(seed)
    names, different, barred, pairs = {}, [], [], []
    for g in range(40):
        tracks = [f"t{g:02d}_{k}" for k in rng.sample(range(100), rng.randrange(2, 14))]
        ids = [f"COW_{10 * g + k + 1:04d}" for k in range(3)] + ([f"bella{g}", f"Ada{g}"] if g % 4 == 1 else [])
        names |= {t: rng.choice(ids) if rng.random() < rng.choice([0, 0.4]) else "" for t in tracks}
        pairs += [(rng.choice(tracks), rng.choice(tracks)) for _ in range(rng.randrange(1, 16))]
        if g % 2:
            different += [tuple(rng.sample(tracks, 2)) for _ in range(rng.randrange(0, 3))]
            barred += [(rng.choice(ids), rng.choice(tracks)) for _ in range(rng.randrange(0, 3))]
    pairs += [("t00_zz", "t01_zz"), (None, "t00_1"), pairs[0], pairs[0][::-1]]
    own, accepted = plain(names, different, set(barred), [p for p in pairs if None not in p], max(natural(n)[1] for n in [*names.values(), *(e for e, _ in barred)] if n.startswith("COW_")))
    updated, reviews, applied = merging.unite(*tables_of(spark, names, different, barred, pairs), NOW)
    assert sorted(map(tuple, applied.collect())) == sorted(accepted)
    rows = updated.collect()
    assert {r.tracklet_id: r.entity_id for r in rows} == own and len(rows) == len(names)
    paired = {t for a, b, _ in accepted for t in (a, b)}
    assert {r.tracklet_id for r in rows if r.assignment_source == "auto_dual_signal"} == paired
    assert {r.tracklet_id for r in rows if r.assignment_source == "identity_merge"} == {t for t in names if t not in paired and own[t] != names[t]}
    assert sorted((r.left_id, r.right_id, r.entity_id, r.similarity) for r in reviews.where("decision = 'same'").collect()) == sorted((a, b, e, 0.9) for a, b, e in accepted)


def test_long_path_and_star_without_decisions(spark):
    """A path and a star of 3000 tracks each: rounds by the logarithm, one identity each, all pairs accepted."""
    path, star = [f"p{k:05d}" for k in range(3000)], [f"s{k:05d}" for k in range(3000)]
    pairs = list(zip(path, path[1:])) + [(star[0], s) for s in star[1:]]
    updated, _, applied = merging.unite(*tables_of(spark, dict.fromkeys(path + star, ""), [], [], pairs), NOW)
    assert applied.count() == 5998
    assert {(r.tracklet_id[0], r.entity_id) for r in updated.collect()} == {("p", "COW_0001"), ("s", "COW_0002")}


def test_empty(spark):
    labels, reviews, exclusions, pairs = tables_of(spark, {"a": "COW_0001", "b": ""}, [("a", "b")], [], [("a", "b")])
    updated, log, applied = merging.unite(labels, reviews, exclusions, pairs.limit(0), NOW)
    assert applied.count() == 0 and log.count() == 1 and sorted(r.entity_id for r in updated.collect()) == ["", "COW_0001"]
    assert merging.unite(labels, reviews, exclusions, pairs, NOW)[2].count() == 0  # marked different
    assert merging.unite(labels.limit(0), reviews, exclusions, pairs, NOW)[2].count() == 0


def test_spanning_forest(spark):
    from pyspark.sql import functions as F

    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200), k) for k in range(260)]
    up, kept = list(range(200)), []
    for a, b, k in edges:
        if up[a] != up[b]:
            kept.append(k)
            up = [up[b] if u == up[a] else u for u in up]
    forest, roots = graphs.spanning_forest(spark.createDataFrame(edges, "a int, b int, k int"), F.col("k"))
    assert sorted(r.k for r in forest.collect()) == kept
    root = {r.node: r.root for r in roots.collect()}
    assert all((root[a] == root[b]) == (up[a] == up[b]) for a in root for b in root)


def test_a_cut_computes_once_and_leaves_few_partitions(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    cut = graphs.cut(spark.range(40).repartition(40).mapInArrow(count, "id bigint"))
    assert cut.rdd.getNumPartitions() < 40 and sorted(r.id for r in cut.collect()) == list(range(40)) and seen.value == 40
