"""Operators on small fixtures with known results, and properties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.operators import graph, model, pairs, partition, retrieval, store
from skein.operators.components import connected_components

UNDIRECTED = [(0, 1), (0, 2), (0, 3), (0, 7), (1, 3), (1, 6), (1, 7), (2, 3), (2, 4), (3, 4), (3, 5), (4, 5), (5, 6), (5, 7), (6, 7), (7, 8)]
WEIGHTED = [(0, 1, 6), (0, 2, 1), (0, 3, 5), (1, 2, 5), (1, 4, 3), (2, 3, 5), (2, 4, 6), (2, 5, 4), (3, 5, 2), (4, 5, 6)]


def edges(spark, rows):
    return spark.createDataFrame([(a, b, *(w or (1,))) for a, b, *w in rows], "src bigint, dst bigint, weight bigint")


def test_pair_codes(spark):
    rows = spark.createDataFrame([(a, b) for a in range(20) for b in range(20)], "a bigint, b bigint")
    coded = rows.withColumn("p", pairs.pair_id(F.col("a"), F.col("b")))
    low, high = pairs.unpair(F.col("p"))
    for r in coded.select("a", "b", "p", low.alias("low"), high.alias("high"), pairs.swapped(F.col("a"), F.col("b")).alias("s")).collect():
        assert (r.low, r.high) == (min(r.a, r.b), max(r.a, r.b))
        assert r.p == min(r.a, r.b) * 2147483647 + max(r.a, r.b)
        assert r.s == (r.a > r.b)


def test_numbered(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    got = {r.k: r.position for r in pairs.numbered(df, ["k"]).collect()}
    assert got == {k: k for k in range(1000)}


@pytest.mark.parametrize("small", [0, 100_000])
def test_components(spark, small):
    links = [(0, 2), (4, 5), (3, 9), (5, 7), (6, 7), (1, 4), (8, 8)]
    found = {r.id: r.component for r in connected_components(spark.createDataFrame(links, "a bigint, b bigint"), small=small).collect()}
    assert found == {0: 0, 2: 0, 1: 1, 4: 1, 5: 1, 6: 1, 7: 1, 3: 3, 9: 3, 8: 8}


def test_components_of_random_graphs(spark):
    rng = np.random.default_rng(1)
    for n, m in ((60, 40), (200, 150), (50, 400)):
        links = rng.integers(0, n, (m, 2)).tolist() + [[500 + i, 501 + i] for i in range(40)]
        parent = {x: x for e in links for x in e}

        def root(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in links:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
        for small in (0, 10, 100_000):
            found = {r.id: r.component for r in connected_components(spark.createDataFrame(links, "a bigint, b bigint"), small=small).collect()}
            assert found == {x: root(x) for x in parent}


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_undirected_graph(spark):
    g = edges(spark, UNDIRECTED)
    labels = graph.components(graph.nodes_of(g), g)
    assert labels.select("component").distinct().count() == 1
    clique = [(a, b) for a in range(8, 12) for b in range(a + 1, 12)]
    g = edges(spark, [e for e in UNDIRECTED if e not in ((7, 8),)] + clique)
    assert graph.components(graph.nodes_of(g), g).select("component").distinct().count() == 2
    assert graph.largest_component(graph.components(graph.nodes_of(g), g)).count() == 8


def test_spanning_tree(spark):
    tree = {(r.src, r.dst) for r in graph.spanning_forest(edges(spark, WEIGHTED)).collect()}
    assert tree == {(0, 2), (1, 2), (1, 4), (2, 5), (3, 5)}


def test_paths_in_the_tree(spark):
    tree = edges(spark, [(0, 2), (1, 2), (1, 4), (2, 5), (3, 5)])
    for a, b, n in ((0, 1, 2), (0, 4, 3), (4, 3, 4)):
        path = [r.id for r in graph.shortest_path(tree, a, b).orderBy("step").collect()]
        assert (len(path) - 1, path[0], path[-1]) == (n, a, b)
    assert graph.shortest_path(tree, 0, 99).count() == 0


def test_anchor(spark):
    assert graph.anchor(edges(spark, [(0, 1), (1, 2), (2, 3), (3, 4)])) == 2
    assert graph.anchor(edges(spark, [(0, 1)])) == 0


def test_edge_edits(spark):
    g = edges(spark, [(0, 1, 5), (1, 2, 6)])
    more = graph.add_edges(g, edges(spark, [(0, 1, 9), (2, 3, 7)]))
    assert {(r.src, r.dst, r.weight) for r in more.collect()} == {(0, 1, 5), (1, 2, 6), (2, 3, 7)}
    assert {(r.src, r.weight) for r in graph.alter_edges(g, edges(spark, [(0, 1, 8)])).collect()} == {(0, 8), (1, 6)}
    assert graph.delete_edges(g, edges(spark, [(0, 1, 0)])).count() == 1
    assert [(r.src, r.dst) for r in graph.incident(g, 1).collect()] == [(0, 1)]


def test_triangles_by_brute_force(spark):
    rng = np.random.default_rng(2)
    pairs_ = {(int(min(a, b)), int(max(a, b))) for a, b in rng.integers(0, 25, (120, 2)) if a != b}
    expected = {(a, b, c) for a, b in pairs_ for c in range(25) if (a, c) in pairs_ and (b, c) in pairs_ and b < c}
    rows = [(a, b, a * 100 + b) for a, b in pairs_]
    found = graph.triangles(edges(spark, rows)).collect()
    assert {(r.a, r.b, r.c) for r in found} == expected
    assert all((r.ab.weight, r.ac.weight, r.bc.weight) == (r.a * 100 + r.b, r.a * 100 + r.c, r.b * 100 + r.c) for r in found)


def test_tracks(spark):
    """Linked features form tracks; a second feature of an image is left out."""
    elements = [(i, i // 3, i % 3) for i in range(12)]
    obs = spark.createDataFrame(elements, "id bigint, image_id bigint, idx int")
    for links, n in (([(0, 3), (3, 8), (8, 11), (2, 5), (5, 6), (1, 4), (7, 9)], 4), ([(0, 3), (3, 8), (8, 11), (2, 5), (5, 6), (1, 4), (7, 9), (10, 0)], 4)):
        labels = connected_components(spark.createDataFrame(links, "a bigint, b bigint"))
        rows = obs.join(labels, "id").withColumnRenamed("component", "point_id")
        kept = model.one_per_image(rows, order=["id"])
        assert model.track_lengths(kept, 2, 10).count() == n


def test_correspondence_graph(spark):
    m = spark.createDataFrame([(0, 1, a, b) for a, b in ((0, 0), (1, 2), (3, 7), (4, 8))], "image_id1 bigint, image_id2 bigint, idx1 bigint, idx2 bigint")
    corr = model.correspondences(m)
    assert [r.correspondences for r in model.correspondence_counts(corr).collect()] == [4, 4]
    assert model.pair_counts(corr).first().correspondences == 4
    assert model.two_view_observations(corr).count() == 8


def test_repeated_matches_count_once(spark):
    m = spark.createDataFrame([(0, 1, 0, 0), (0, 1, 0, 1), (0, 1, 2, 0)], "image_id1 bigint, image_id2 bigint, idx1 bigint, idx2 bigint")
    assert {(r.image_id, r.idx, r.other_idx) for r in model.correspondences(m).filter("image_id = 0").collect()} == {(0, 0, 0)}


def test_visibility_pyramid(spark):
    for levels in range(1, 8):
        point = spark.createDataFrame([(0, 0.0, 0.0)], "image_id bigint, x double, y double")
        assert model.visibility(point, 4, 4, levels).first().score == sum(4**k for k in range(1, levels + 1))


def test_full_pyramid(spark):
    rows = [(0, float(x), float(y)) for x in range(8) for y in range(8)]
    assert model.visibility(spark.createDataFrame(rows, "image_id bigint, x double, y double"), 8, 8, 3).first().score == sum(16**k for k in range(1, 4))


def test_empty_model_statistics(spark):
    obs = spark.createDataFrame([], "image_id bigint, idx bigint, point_id bigint")
    row = model.statistics(spark.createDataFrame([(1,)], "image_id bigint"), obs).first()
    assert (row.registered, row.points, row.mean_track_length, row.mean_per_image) == (0, 0, 0.0, 0.0)


def test_store_versions(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "store")).create()
    assert s.read("images").count() == 0
    new = s.insert("images", spark.createDataFrame([("b",), ("a",)], "name string"), "image_id", ["name"])
    assert {(r.name, r.image_id) for r in new.collect()} == {("a", 1), ("b", 2)}
    s.update("images", spark.createDataFrame([(2, "c")], "image_id bigint, name string"), "image_id")
    assert {r.name for r in s.read("images").collect()} == {"a", "c"}
    s.delete("images", spark.createDataFrame([(1,)], "image_id bigint"), "image_id")
    assert s.exists("images", F.col("name") == "c") and not s.exists("images", F.col("name") == "a")
    s.clear("images")
    assert s.read("images").count() == 0


def test_matches_from_either_side(spark):
    rows = spark.createDataFrame([(1 * 2147483647 + 2, 1, 2, [(0, 5), (3, 4)])], store.SCHEMAS["matches"])
    assert {tuple(r) for r in store.matches_between(rows, 1, 2).collect()} == {(0, 5), (3, 4)}
    assert {tuple(r) for r in store.matches_between(rows, 2, 1).collect()} == {(5, 0), (4, 3)}


def test_merge_needs_distinct_names(spark):
    images = spark.createDataFrame([(1, "a", 1)], "image_id bigint, name string, camera_id bigint")
    cameras = spark.createDataFrame([(1,)], "camera_id bigint")
    with pytest.raises(ValueError):
        store.merge({"images": images, "cameras": cameras}, {"images": images, "cameras": cameras})


@pytest.mark.parametrize("name", partition.METHODS)
def test_partition_covers(spark, name):
    rng = np.random.default_rng(3)
    rows = [(i, i + 1, 50) for i in range(59)] + [(int(a), int(b), int(w)) for a, b, w in zip(rng.integers(0, 60, 200), rng.integers(0, 60, 200), rng.integers(30, 100, 200)) if a < b]
    g = edges(spark, rows).groupBy("src", "dst").agg(F.max("weight").alias("weight"))
    labels = partition.assign(g, 15, name)
    assert {r.id for r in labels.collect()} == set(range(60))
    inner, lost = partition.split_edges(g, labels)
    assert inner.count() + lost.count() == g.count()
    if name == "NCUT":
        assert labels.groupBy("label").count().agg(F.max("count")).first()[0] <= 20


def test_large_component_is_split(spark):
    g = edges(spark, [(i, i + 1, 50) for i in range(299)] + [(i, i + 7, 30) for i in range(290)])
    labels = partition.assign(g, 10, most=60)
    sizes = labels.groupBy("label").count()
    assert labels.count() == 300 and sizes.agg(F.max("count")).first()[0] <= 60


def test_expansion_keeps_members(spark):
    g = edges(spark, WEIGHTED)
    labels = spark.createDataFrame([(i, i % 2) for i in range(6)], "id bigint, label bigint")
    _, lost = partition.split_edges(g, labels)
    grown = partition.expand(labels, lost, completeness=0.5)
    assert grown.filter("NOT added").count() == 6
    assert grown.filter("added").groupBy("label").count().filter("count > 2").count() == 0
    assert grown.groupBy("label", "id").count().filter("count > 1").count() == 0


def test_cluster_tree(spark):
    assert partition.hierarchy(edges(spark, [(0, 1, 10)]), 2).select("label").distinct().count() == 1
    assert partition.hierarchy(edges(spark, [(0, 1, 10)]), 1).select("label").distinct().count() == 2


def test_methods():
    assert [partition.method(x) for x in ("ncut", "SPECTRA", None, "HYBRID", "?")] == ["NCUT", "SPECTRAL", "NCUT", "HYBRID", "NCUT"]


def test_cuts():
    rows, cols, w = np.array([0, 1, 0, 2, 3, 3, 4]), np.array([1, 2, 2, 3, 4, 5, 5]), np.array([5.0, 5, 5, 1, 5, 5, 5])
    value, side = partition.min_cut(6, rows, cols, w)
    assert value == 1 and set(np.flatnonzero(side)) in ({0, 1, 2}, {3, 4, 5})
    both = np.concatenate([rows, cols]), np.concatenate([cols, rows]), np.concatenate([w, w])
    flow, side = partition.max_flow(6, *both, 0, 5)
    assert flow == 1 and set(np.flatnonzero(side)) == {0, 1, 2}
    assert len(set(partition.greedy_modularity(6, rows, cols, w))) == 2


def test_retrieval_of_itself(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(100)]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    centres = retrieval.vocabulary(vectors, 10)
    words = retrieval.assign_words(vectors, centres)
    postings = words.select((F.col("vec_id") % 2).alias("doc_id"), F.col("word").cast("string").alias("word")).groupBy("doc_id", "word").agg(F.count("*").alias("tf"))
    queries = postings.filter("doc_id = 1").select(F.lit(7).alias("query_id"), "word", F.col("tf").alias("qtf"))
    found = retrieval.search(queries, postings, 3).collect()
    assert not found or found[0].doc_id == 1


def test_whitening(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 6)) @ rng.normal(size=(6, 6)) + 3
    mean, w = retrieval.whitening(spark.createDataFrame([(r.tolist(),) for r in x], "embedding array<double>"), 4)
    y = (x - mean) @ w.T
    assert np.allclose(np.cov(y.T, bias=True), np.eye(4), atol=1e-6)


@pytest.mark.parametrize("block", [1024, 5])
def test_shared_points_of_long_tracks(spark, block):
    rng = np.random.default_rng(3)
    seen = {(int(i), int(p)) for i, p in zip(rng.integers(0, 30, 200), rng.integers(0, 12, 200))}
    expected = {}
    for a, p in seen:
        for b, q in seen:
            if p == q and a < b:
                expected[a, b] = expected.get((a, b), 0) + 1
    found = model.shared_points(spark.createDataFrame(list(seen) + [(99, None)], "image_id bigint, point_id bigint"), block)
    assert {(r.image_id1, r.image_id2): r.shared for r in found.collect()} == expected


def test_first_edge_wins(spark):
    g_ = edges(spark, [(0, 1, 5)])
    more = spark.createDataFrame([(1, 2, 9, 1), (1, 2, 3, 2), (0, 1, 1, 0)], "src bigint, dst bigint, weight bigint, at int")
    assert {(r.src, r.dst, r.weight) for r in graph.add_edges(g_, more, "at").collect()} == {(0, 1, 5), (1, 2, 9)}


def test_distances_have_no_limit(spark):
    chain = edges(spark, [(i, i + 1) for i in range(40)])
    assert graph.distances(chain, 0).agg(F.max("distance")).first()[0] == 40
    assert graph.distances(chain, 0, most=3).count() == 4


def test_failing_edges_use_up_a_budget(spark):
    star = edges(spark, [(0, i, 10 + i) for i in range(1, 9)])
    few = graph.verified_forest(star, lambda e: e.filter("dst <= 2"), budget=2)
    assert {r.dst for r in few.collect()} <= {1, 2}
    every = graph.verified_forest(star, lambda e: e.filter("dst <= 2"), budget=100)
    assert {r.dst for r in every.collect()} == {1, 2}


def test_store_appends_write_their_rows_only(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s")).create()
    rows = spark.createDataFrame([(1, "a", 1)], "image_id bigint, name string, camera_id bigint")
    s.append("images", rows)
    s.append("images", rows.withColumn("image_id", F.lit(2).cast("long")))
    assert sorted(r.image_id for r in s.read("images").collect()) == [1, 2] and s.read("images", 2).count() == 1
    folders = [n for n in s._names("images") if n.startswith("d")]
    assert len(folders) == 3
    s.vacuum("images")
    assert s.read("images").count() == 2 and len(s._versions("images")) == 1


def test_tracks_are_built(spark):
    from skein.operators import tracks

    rows = [(1, 2, [(0, 0), (1, 1)]), (2, 3, [(0, 5), (1, 6)]), (1, 3, [(7, 5)]), (4, 5, [(3, 3)])]
    found = tracks.build(spark.createDataFrame(rows, "image_id1 bigint, image_id2 bigint, inliers array<struct<idx1:int,idx2:int>>")).collect()
    by = {}
    for r in found:
        by.setdefault(r.track, set()).add((r.image_id, r.idx))
    # Features 0 and 7 of image 1 are one track: the first stays.
    assert sorted(map(sorted, by.values())) == [[(1, 0), (2, 0), (3, 5)], [(1, 1), (2, 1), (3, 6)], [(4, 3), (5, 3)]]


def test_clusters_are_regrouped(spark):
    rng = np.random.default_rng(6)
    links = {(int(min(a, b)), int(max(a, b))) for a, b in rng.integers(0, 60, (500, 2)) if a != b}
    found = partition.cut_and_expand(edges(spark, [(a, b, 1 + (a + b) % 9) for a, b in links]), 12, relax=1.5, completeness=0.2).collect()
    sizes = {}
    for r in found:
        sizes.setdefault(r.label, set()).add(r.id)
    assert set().union(*sizes.values()) == {x for e in links for x in e} and max(map(len, sizes.values())) <= 18


def test_tracks_in_turn(spark):
    """Images fill up by id and count what others have picked; compared with a plain loop."""
    rng = np.random.default_rng(5)
    seen = sorted({(int(i), int(t)) for i, t in rng.integers(0, [12, 30], (150, 2))})
    rows_ = [(i % 2, i, 2 * t + i % 2, float(50 * (t % 3)), 0.0) for i, t in seen]
    length = {t: sum(r[2] == t for r in rows_) for r in rows_ for t in [r[2]]}
    stats = [(t, n, float(t % 7)) for t, n in length.items()]
    rank = {t: (n, e, t) for t, n, e in stats}
    expected = set()
    for label in (0, 1):
        own = [r for r in rows_ if r[0] == label]
        cells: dict = {}
        for _, i, t, x, y in own:
            cells.setdefault((i, int(x / 100), int(y / 100)), []).append(t)
        chosen = {min(ts, key=rank.get) for ts in cells.values()}
        for i in sorted({r[1] for r in own}):
            ids = sorted((r[2] for r in own if r[1] == i), key=rank.get)
            want = min(6, len(ids)) - sum(t in chosen for t in ids)
            chosen |= set([t for t in ids if t not in chosen][: max(0, want)])
        expected |= {(label, t) for t in chosen}
    df = spark.createDataFrame(rows_, "label long, image_id long, point_id long, x double, y double")
    got = model.selected_in_turn(df, spark.createDataFrame(stats, "point_id long, length long, mean_error2 double"), 6, "label")
    assert {tuple(r) for r in got.collect()} == expected and got.columns == ["label", "point_id"]
