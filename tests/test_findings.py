"""Cases that a review found wrong or too large."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from skein.functions import scalar
from skein.kernels import geometry as kernels
from skein import session
from skein.operators import graph, pairs, partition
from skein.plans import catalog_numeric, catalog_sources, flow
from skein.plans.catalog import ORACLES, QUERIES
from skein.sources import model
from skein.views import TABLES, frame, with_

from conftest import SF, same

LARGER = "/root/testdata/sf0.1"


def over(folder, *names):
    """DuckDB over some tables of a folder."""
    import duckdb

    con = duckdb.connect()
    for name in names:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def test_spatial_ranks_follow_the_last_bit(spark):
    assert same(QUERIES["pairs_spatial"](spark, LARGER), over(LARGER, "supplier"), ORACLES["pairs_spatial"])


def test_descriptors_above_a_byte(spark, tmp_path):
    rows = np.full((2, 64), 0.01, dtype=np.float32)
    rows[0, 0] = -0.9
    pq.write_table(pa.table({"vec_id": [1, 2], "embedding": pa.array(list(rows), pa.list_(pa.float32())), "label": pa.array([0, 0], pa.int32())}), tmp_path / "embeddings.parquet")
    found = same(QUERIES["unit_descriptors"](spark, str(tmp_path)), over(tmp_path, "embeddings"), ORACLES["unit_descriptors"])
    assert max(int(r[0]) for r in found) > 255
    assert spark.range(1).select(scalar.to_bytes(F.array(F.lit(0.9)))[0].alias("b")).first()["b"] == 255


@pytest.mark.parametrize("block", [50, 1 << 20])
def test_forest_needs_no_round_over_all_edges(spark, monkeypatch, block):
    """Blocks are reduced where they are; the rounds see no more than is left."""
    rng = np.random.default_rng(3)
    rows = sorted({(int(a), int(b)) for a, b in rng.integers(0, 60, (900, 2)) if a < b})
    rows = [(a, b, int(w)) for (a, b), w in zip(rows, rng.integers(0, 5, len(rows)))]
    expected, home = [], list(range(60))
    for a, b, w in sorted(rows, key=lambda r: (r[2], r[0], r[1])):
        if home[a] != home[b]:
            expected.append((a, b, w))
            home = [home[b] if h == home[a] else h for h in home]
    seen = []
    plain = graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: (lambda out: seen.append(out.count()) or out)(plain(df)))
    found = graph.spanning_forest(spark.createDataFrame(rows, "src bigint, dst bigint, weight bigint").coalesce(2), block=block)
    assert sorted(map(tuple, found.collect())) == sorted(expected)
    assert max(seen) < len(rows) / 2


@pytest.mark.parametrize("name", ["points_binary", "images_binary", "visibility_files"])
def test_driver_holds_a_piece_of_a_file(spark, duck, monkeypatch, name):
    """What is written passes the driver in bounded pieces."""
    longest, plain = [], catalog_sources._put

    def put(spark, path, *parts):
        sizes = lambda part: [longest.append(len(x)) or x for x in ([part] if isinstance(part, bytes) else part)]
        return plain(spark, path, *[iter(sizes(p)) for p in parts])

    monkeypatch.setattr(catalog_sources, "_put", put)
    monkeypatch.setattr(model, "binary_files", lambda df, table, plain=model.binary_files: plain(df, table, 2_000))
    assert same(QUERIES[name](spark, SF), duck, ORACLES[name])
    assert len(longest) > 5 and max(longest) < 4_000


def test_sequences_are_met_without_a_broadcast(spark):
    images = spark.range(2_000).select(F.col("id").alias("image_id"), F.lpad(F.col("id").cast("string"), 6, "0").alias("name"))
    found = pairs.sequential(images, quadratic=True)
    assert found.count() == sum(2_000 - k for k in (*range(1, 10), 16, 32, 64, 128, 256, 512))
    found.collect()
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()


def held(function) -> float:
    """MB that a call allocates at most."""
    import tracemalloc

    tracemalloc.start()
    try:
        function()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("kind", [kernels.Fundamental8, kernels.Homography, kernels.Essential8])
def test_tall_systems_have_no_square_factor(kind):
    x = np.random.default_rng(2).normal(size=(4_000, 2))
    assert held(lambda: kind().fit(x, 1.5 * x + 0.1)) < 20


def test_verified_rig_is_not_stored(spark, monkeypatch):
    monkeypatch.setattr(catalog_numeric, "cut", None)
    assert same(QUERIES["pairs_verified"](spark, "/root/testdata/sf0.01"), over("/root/testdata/sf0.01", *TABLES), ORACLES["pairs_verified"])


@pytest.mark.parametrize("method", ["L1_IRLS", "NONLINEAR"])
def test_rotations_hold_no_row_an_edge(method):
    """The system of a dense graph is held as its normal equations."""
    n = 250
    rows, cols = np.array([(i, j) for i in range(n) for j in range(i + 1, n) if j == i + 1 or (i + j) % 5 == 0]).T
    truth = np.stack([kernels.exp_rotation(v) for v in np.random.default_rng(4).normal(size=(n, 3))])
    relative = truth[cols] @ np.swapaxes(truth[rows], 1, 2)
    found = []
    assert held(lambda: found.append(kernels.average_rotations(n, rows, cols, relative, method=method))) < 12
    assert np.abs(kernels.align_rotations(truth, found[0]) - truth).max() < 1e-6


def stored(monkeypatch, *modules) -> list[int]:
    """Rows of every table that is stored from here on."""
    seen, plain = [], graph.cut
    for module in modules:
        monkeypatch.setattr(module, "cut", lambda df: (lambda out: seen.append(out.count()) or out)(plain(df)))
    return seen


@pytest.mark.parametrize("hold", [40, 500_000])
def test_wedges_of_triangles_are_not_shuffled(spark, hold):
    rows = [(a, b, a * 100 + b) for a in range(40) for b in range(a + 1, 40) if (a * b) % 3 != 1]
    known = {(a, b) for a, b, _ in rows}
    want = {(a, b, c, a * 100 + b, a * 100 + c, b * 100 + c) for a, b in known for c in range(b + 1, 40) if (a, c) in known and (b, c) in known}
    found = graph.triangles(spark.createDataFrame([*rows, rows[0], (5, 5, 0)], "src bigint, dst bigint, weight bigint"), hold=hold)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    got = found.select("a", "b", "c", "ab.weight", "ac.weight", "bc.weight").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_dense_pairs_are_counted_without_a_join(spark, tmp_path):
    rows = [(1, 1), (1, 2), (1, 2), (2, 1), (2, 2), (2, 3), (None, 4), (None, 5), (3, None), (3, 6), (4, 9)]
    pq.write_table(pa.table({"l_partkey": pa.array([r[0] for r in rows], pa.int64()), "l_suppkey": pa.array([r[1] for r in rows], pa.int64())}), tmp_path / "lineitem.parquet")
    found = frame(spark, str(tmp_path), "dense")
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert same(found, over(tmp_path, "lineitem"), with_("SELECT * FROM {dense}"))


def test_forest_without_budget_verifies_a_forest_a_round(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = {(int(a), int(b)): int(w) for a, b, w in zip(*rng.integers(0, 80, (2, 1_500)), rng.integers(0, 40, 1_500)) if a < b}
    want, home = [], list(range(80))
    for (a, b), w in sorted(rows.items(), key=lambda r: (-r[1], r[0])):
        if w % 3 and home[a] != home[b]:
            want.append((a, b, w))
            home = [home[b] if h == home[a] else h for h in home]
    asked = []
    verify = lambda df: (lambda out: asked.append(out.count()) or out.filter("weight % 3 > 0"))(df)
    seen = stored(monkeypatch, graph)
    edges = spark.createDataFrame([(a, b, w) for (a, b), w in rows.items()], "src bigint, dst bigint, weight bigint").coalesce(2)
    found = graph.verified_forest(edges, verify, budget=1 << 40)
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert max(asked) < 80 and sum(n > len(rows) // 2 for n in seen) == 1  # the edges are stored once


def test_clusterings_of_a_dense_block_are_small_and_quick():
    import time

    rows, cols = np.triu_indices(250, 1)
    weights = np.random.default_rng(8).integers(5, 30, len(rows)).astype(float)
    began = time.time()
    assert len(partition.greedy_modularity(250, rows, cols, weights)) == 250
    assert time.time() - began < 2
    matrix = partition.laplacian(250, rows, cols, weights)
    assert held(lambda: partition.kmeans(matrix, 60)) < 10


def test_bundle_of_many_points():
    import time

    rng = np.random.default_rng(9)
    points, poses = rng.normal(size=(6_000, 3)), np.stack([np.column_stack([kernels.exp_rotation([0, 0, a]), [a, 0, 6]]) for a in (0.0, 0.3, 0.6, 0.9, 1.2)])
    view, point = (x.ravel() for x in np.meshgrid(np.arange(5), np.arange(6_000), indexing="ij"))
    p = np.einsum("nij,nj->ni", poses[view, :, :3], points[point]) + poses[view, :, 3]
    began = time.time()
    _, found, error = kernels.bundle_adjust(poses, points + 0.01 * rng.normal(size=points.shape), view, point, p[:, :2] / p[:, 2:], rounds=3)
    assert error < 1e-4 and time.time() - began < 4


def test_adjusted_models_store_what_they_adjust(spark, monkeypatch):
    folder = "/root/testdata/sf0.01"
    seen = stored(monkeypatch, catalog_numeric)
    assert same(QUERIES["adjusted_models"](spark, folder), over(folder, *TABLES), ORACLES["adjusted_models"])
    assert max(seen) <= 50 * 200


def test_all_pairs_join_packed_blocks(spark, monkeypatch):
    images = spark.createDataFrame([(7 * i - 300,) for i in range(333)], "image_id bigint")
    seen = stored(monkeypatch, pairs)
    found = pairs.exhaustive(images)
    got = [tuple(r) for r in found.collect()]
    ids = [7 * i - 300 for i in range(333)]
    assert len(got) == 333 * 332 // 2 and set(got) == {(a, b) for a in ids for b in ids if a < b}
    assert seen and max(seen) <= 7  # blocks, not images


def test_dense_edges_are_stored_as_compressed_columns(spark, monkeypatch):
    """One block a task, not a row an edge; the same edges."""
    seen = stored(monkeypatch, session)
    found = frame(spark, LARGER, "dense", {})
    assert len(seen) == 1 and seen[0] < 100 < 100_000 < found.count()
    want = frame(spark, LARGER, "dense")
    assert found.exceptAll(want).isEmpty() and want.exceptAll(found).isEmpty() and found.schema == want.schema


@pytest.mark.parametrize("known", [100_000, 3])
def test_edges_inside_blocks_are_packed_before_they_are_shuffled(spark, monkeypatch, known):
    monkeypatch.setattr(partition, "_KNOWN", known)
    rows = [(a, b, 1 + (a * b) % 7) for a in range(60) for b in range(a + 1, 60) if a // 20 == b // 20 or a % 20 == 3]
    edges = spark.createDataFrame(rows, "src bigint, dst bigint, weight bigint").coalesce(2)
    blocks = spark.createDataFrame([(i, i // 20) for i in range(60)], "id bigint, block bigint")
    packed = partition._inside(edges, blocks).collect()
    assert len(packed) <= 3 * 4
    got = {(r["block"], *e) for r in packed for e in zip(*(x.tolist() for x in partition._edges_of([r["blob"]])))}
    assert got == {(a // 20, a, b, float(w)) for a, b, w in rows if a // 20 == b // 20}


def _dense(spark, n=70):
    return spark.createDataFrame([(a, b, 1 + (a * b) % 9) for a in range(n) for b in range(a + 1, n) if (a + b) % 4], "src bigint, dst bigint, weight bigint")


def test_clusters_are_expanded_without_a_group_a_pair(spark):
    edges, labels = _dense(spark), spark.createDataFrame([(i, i // 10) for i in range(70)], "id bigint, label bigint")
    _, lost = partition.split_edges(edges, labels)
    found = partition.expand(labels, lost, completeness=0.5, overlap=4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GroupsIn" not in plan
    want = set()
    rows = sorted(((r.l1, r.l2, -r.weight, r.src, r.dst) for r in lost.collect()))
    for pair in {r[:2] for r in rows}:
        size, given = {k: 10 for k in pair}, {k: set() for k in pair}
        for _, _, _, src, dst in (r for r in rows if r[:2] == pair):
            common = sum(map(len, given.values()))
            full = {k: common / size[k] > 0.5 for k in pair}
            if all(full.values()) or common > 4:
                break
            to = pair[1] if size[pair[0]] > size[pair[1]] else pair[0]
            lacks = dst if src // 10 == to else src
            if not full[to] and lacks not in given[to]:
                given[to].add(lacks)
                size[to] += 1
        want |= {(k, i) for k in pair for i in given[k]}
    assert {(r.label, r.id) for r in found.filter("added").collect()} == want


def test_regrouping_needs_no_round_of_joins(spark, monkeypatch):
    seen = stored(monkeypatch, partition, session)
    found = partition.cut_and_expand(_dense(spark), 8, relax=1.3, completeness=0.3).collect()
    assert len(seen) < 10
    sizes = {}
    for r in found:
        sizes[r.label] = sizes.get(r.label, 0) + 1
    assert {r.id for r in found} == set(range(70)) and max(sizes.values()) <= 10


@pytest.mark.parametrize("dense", [2_000, 40])
def test_a_tree_of_clusters_needs_no_join_a_level(spark, monkeypatch, dense):
    monkeypatch.setattr(partition, "DENSE", dense)
    seen = stored(monkeypatch, partition, session)
    edges = _dense(spark)
    rows = partition.hierarchy(edges, 8, overlap=3).collect()
    assert len(seen) < 20 if dense < 70 else len(seen) < 10
    home = {r.id: r.label for r in rows if not r.added}
    assert set(home) == set(range(70)) and len(home) == sum(not r.added for r in rows) and all(list(home.values()).count(k) <= 8 for k in home.values())
    best = {}
    for e in edges.collect():
        for a, b in ((e.src, e.dst), (e.dst, e.src)):
            if home[a] != home[b]:
                best[home[a], b] = max(best.get((home[a], b), 0), e.weight)
    want = set()
    for k in set(home.values()):
        want |= {(k, i) for _, i in sorted((-w, i) for (label, i), w in best.items() if label == k)[:3]}
    assert {(r.label, r.id) for r in rows if r.added} == want


@pytest.mark.parametrize("k", [2, 7])
def test_moves_of_a_cut_are_those_node_by_node(k):
    rng = np.random.default_rng(k)
    i, j = np.triu_indices(40, 1)
    v = rng.integers(0, 9, len(i)).astype(float)
    label, w = partition.normalised_cut(40, i, j, v, k), partition._matrix(40, i, j, v)
    sizes = np.bincount(label, minlength=k)
    for x in range(40):  # no node is left that could move
        gain = np.bincount(label, weights=w[x], minlength=k)
        assert gain[gain.argmax()] <= gain[label[x]] or sizes[gain.argmax()] >= np.ceil(1.1 * 40 / k) or sizes[label[x]] == 1


def test_mutual_matches_list_no_pairs(spark, monkeypatch):
    from skein.operators import retrieval

    assert same(QUERIES["mutual_match"](spark, LARGER), over(LARGER, "embeddings"), ORACLES["mutual_match"])
    monkeypatch.setattr(retrieval, "_FEATURES", 7)
    rng = np.random.default_rng(12)
    rows = [(i, (rng.integers(-3, 4, 8) / 8).tolist(), i % 3) for i in range(90)]  # many equal scores
    a = spark.createDataFrame(rows[:50], "a bigint, q array<float>, k int")
    b = spark.createDataFrame(rows[50:], "b bigint, w array<float>, k int")
    pairs_ = a.join(b, "k").select("a", "b", retrieval.dot(F.col("q"), F.col("w")).alias("score"))
    seen = stored(monkeypatch, retrieval)
    found = retrieval.mutual_matches_by_blocks(a, b, 1.1, 3.2)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, retrieval.mutual_matches(pairs_, 1.1, 3.2).collect())) and found.count()
    assert max(seen) < pairs_.count()


@pytest.mark.parametrize("hold", [40, 500_000])
def test_edges_of_triangles_are_packed_and_loops_tested_where_found(spark, hold):
    rows = [(a, b, float((a * 7 + b * 3) % 11)) for a in range(40) for b in range(a + 1, 40) if (a * b) % 3 != 1]
    edges = spark.createDataFrame(rows, "src bigint, dst bigint, turn double")
    value = {(a, b): t for a, b, t in rows}
    want = set()
    for a, b in value:
        for c in range(b + 1, 40):
            if (a, c) in value and (b, c) in value and abs(value[a, b] + value[b, c] - value[a, c]) < 0.5:
                want |= {(a, b), (a, c), (b, c)}
    found = graph.consistent_edges(edges, "turn", lambda ab, ac, bc: np.abs(ab + bc - ac), 0.5, hold=hold)
    assert "FlatMapGroupsInArrow [t" in (plan := found._jdf.queryExecution().executedPlan().toString()) and "src#" in plan and " ab#" not in plan  # no row a triangle
    got = found.collect()
    assert {(r.src, r.dst) for r in got} == want and 0 < len(got) == len(want) < len(rows)
    some = graph.triangles(edges.select("src", "dst"), hold=hold)
    assert "blob" in some._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in some.select("a", "b", "c").collect()} == {(a, b, c) for a, b in value for c in range(b + 1, 40) if (a, c) in value and (b, c) in value}


def test_a_bundler_file_is_parsed_piece_by_piece(spark, tmp_path):
    rng = np.random.default_rng(13)
    text = ["# Bundle file v0.3", "2 500", *["1 2 3"] * 10]
    want = []
    for i in range(500):
        track = [(int(a), int(b), float(i), 0.5) for a, b in rng.integers(0, 99, (rng.integers(0, 30), 2))]
        want.append((i, i / 4, -1.5, 2.0, i % 256, 7, 8, track))
        text += [f"{i / 4} -1.5 2.0", f"{i % 256} 7 8", " ".join([str(len(track)), *(str(x) for t in track for x in t)])]
    (tmp_path / "b.out").write_text("\n".join(text) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "777")
    try:
        found = model.read_bundler(spark, str(tmp_path / "b.out"))
        assert found.rdd.getNumPartitions() > 20
        got = sorted((*r[:7], [tuple(t) for t in r[7]]) for r in found.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == want
    (tmp_path / "c.out").write_text("0 1 1.0 2.0 3.0\n4 5 6 1 2 3 0.5 0.25")  # lines as they come
    assert [tuple(map(str, r[:7])) for r in model.read_bundler(spark, str(tmp_path / "c.out")).collect()] == [("0", "1.0", "2.0", "3.0", "4", "5", "6")]


@pytest.mark.parametrize("name", ["motions_solved", "poses_found"])
def test_the_rig_is_never_a_table(spark, monkeypatch, name):
    monkeypatch.setattr(catalog_numeric, "_rig", None)
    monkeypatch.setattr(flow, "_MET", 40)  # several blocks a cell
    seen = stored(monkeypatch, catalog_numeric)
    assert same(QUERIES[name](spark, "/root/testdata/sf0.01"), over("/root/testdata/sf0.01", "supplier", "part"), ORACLES[name]) and not seen


def test_epipolar_errors_end_at_the_first_that_is_too_large():
    rng = np.random.default_rng(5)
    x, e = rng.normal(size=(20_000, 2)), np.array([[0, 0, 0], [0, 0, -1.0], [0, 1, 0]])  # a shift along x
    y = x + [1.0, 0.0]
    assert kernels.meets(e, x, y, 1e-10) and not kernels.meets(e, x[:0], y[:0], 1e-10)
    for bad in (3, 600, 19_999):
        off = y.copy()
        off[bad] += 0.1
        assert not kernels.meets(e, x, off, 1e-10)
        off[bad] = np.nan
        assert not kernels.meets(e, x, off, 1e-10)


@pytest.mark.parametrize("n", [50, 20_000])
def test_poses_are_refined_without_a_row_a_point_in_memory(n):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(n, 3)) * [3, 3, 1] + [0, 0, 9]
    pose = np.column_stack([kernels.exp_rotation(np.array([0.1, -0.2, 0.3])), [0.5, -0.5, 1.0]])
    p = x @ pose[:, :3].T + pose[:, 3]
    y = p[:, :2] / p[:, 2:]
    start = np.column_stack([kernels.exp_rotation(np.array([0.12, -0.17, 0.33])), [0.6, -0.4, 1.2]])
    found = []
    assert held(lambda: found.append(kernels.refine_pose(start, x, y))) < 8
    assert np.abs(found[0] - pose).max() < 1e-9
    assert kernels.PnP.residuals(pose, x, y).max() < 1e-18 and np.isinf(kernels.PnP.residuals(-pose, x, y)).all()


def test_registration_by_function_is_that_by_rows(spark, monkeypatch):
    monkeypatch.setattr(flow, "_MET", 2)
    rng = np.random.default_rng(7)
    at = {i: tuple(map(float, p)) for i, p in enumerate(rng.normal(size=(60, 3)) * 3)}
    points = spark.createDataFrame([(i, *p, i % 2) for i, p in at.items()], "track bigint, x double, y double, z double, cell int")
    images = spark.createDataFrame([(i, i % 2) for i in range(9)] + [(20, 7), (21, None)], "image_id bigint, cell int")

    def observe(i, xyz):
        out = (xyz[:, :2] + [i, -i]) / (xyz[:, 2:] + 30)
        out[::7] += 0.5  # outliers
        return out

    rows = []
    for i in range(9):
        tracks = [t for t in sorted(at) if t % 2 == i % 2]
        rows += [(i, t, float(a), float(b)) for t, (a, b) in zip(tracks, observe(i, np.array([at[t] for t in tracks])))]
    seen = spark.createDataFrame(rows, "image_id bigint, track bigint, x double, y double")
    want = flow.register_images(seen, points.select("track", F.array("x", "y", "z").alias("xyz")), seen.select("image_id").limit(0)).collect()
    got = {r.image_id: r for r in flow.register_seen(images, points, observe).collect()}
    assert len(want) == len(got) == 9
    for r in want:
        assert r.inliers == got[r.image_id].inliers == 25 and np.allclose(r.pose, got[r.image_id].pose, atol=1e-9)


@pytest.mark.parametrize("limits", [{}, {"_POSTINGS": 300, "_HITS": 2_000, "_STEP": 90, "_SENT_ENTRIES": 900, "_LIST": 8}])
def test_similar_documents_are_found_without_shuffling_hits(spark, monkeypatch, limits):
    from skein.operators import retrieval

    for name, value in limits.items():
        monkeypatch.setattr(retrieval, name, value)
    rng = np.random.default_rng(9)
    rows = {(int(d) * 10**12 - 7, int(w) ** 2) for d, w in zip(rng.integers(0, 150, 1_500), rng.integers(0, 40, 1_500))}
    rows = [(d, w, 1 + (d + w) % 3) for d, w in sorted(rows)]
    rows += [(d, -5, 1) for d in sorted({r[0] for r in rows})]  # a word of all weighs nothing
    postings = spark.createDataFrame(rows, "doc_id bigint, word bigint, tf bigint")
    want = retrieval.search(postings.select(F.col("doc_id").alias("query_id"), "word", F.col("tf").alias("qtf")), postings, 6)
    found = retrieval.similar_documents(postings, 6)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and want.count() > 500
    if limits:
        assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") > 1  # one after the other
    assert retrieval.similar_documents(postings.limit(0), 6).collect() == []


def test_hits_of_the_similarity_graph_are_no_rows_of_a_join(spark):
    found = QUERIES["similarity_graph"](spark, SF)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_similarity_counts_postings_without_a_word_or_document(spark):
    from skein.operators import retrieval

    rows = [(1, 1, 1), (2, 1, 1), (3, 2, 1), (1, 2, 1), (None, 1, 1), (9, None, 1), (4, 3, 1)]
    postings = spark.createDataFrame(rows, "doc_id bigint, word bigint, tf bigint")
    words = postings.withColumn("word", F.col("word").cast("string"))
    got = [sorted(map(tuple, retrieval.similarity_graph(p, 5).collect())) for p in (postings, words)]
    # Five documents; the first word is in three postings, the second in two.
    a, b = np.log(5 / 3) ** 2, np.log(5 / 2) ** 2
    assert got[0] == [(1, 2, int(1000 * a / np.sqrt(a) / np.sqrt(a + b))), (1, 3, int(1000 * b / np.sqrt(b) / np.sqrt(a + b)))] == got[1]


@pytest.mark.parametrize("name", ["rotations_averaged", "rotations_by_method"])
def test_all_edges_are_averaged(spark, monkeypatch, name):
    """Every edge of the view reaches the averaging."""
    seen, plain = [], flow.global_rotations
    monkeypatch.setattr(flow, "global_rotations", lambda edges, method: seen.append(edges.count()) or plain(edges, method))
    found = QUERIES[name](spark, "/root/testdata/sf0.01")
    assert same(found, over("/root/testdata/sf0.01", *TABLES), ORACLES[name])
    assert set(seen) == {frame(spark, "/root/testdata/sf0.01", "dense").count()}


def test_rotations_of_several_components_agree(spark, tmp_path):
    rows = [(p, s + 1_000 * (p // 4)) for p in range(12) for s in range(p % 4, 8)]
    pq.write_table(pa.table({"l_partkey": [r[0] for r in rows], "l_suppkey": [r[1] for r in rows]}), tmp_path / "lineitem.parquet")
    found = QUERIES["rotations_averaged"](spark, str(tmp_path)).collect()
    assert len(found) == 24 and all(r.agrees for r in found)


@pytest.mark.parametrize("method", ["L1_IRLS", "NONLINEAR", "LAGRANGE_DUAL"])
def test_a_complete_graph_of_rotations_is_small_and_quick(method):
    import time

    n = 300
    rows, cols = np.triu_indices(n, 1)
    truth = kernels.exp_rotations(np.random.default_rng(4).normal(size=(n, 3)))
    relative, found, began = truth[cols] @ np.swapaxes(truth[rows], 1, 2), [], time.time()
    assert held(lambda: found.append(kernels.average_rotations(n, rows, cols, relative, method=method))) < 40
    assert time.time() - began < 10 and np.abs(kernels.align_rotations(truth, found[0]) - truth).max() < 1e-6


def test_dual_rotations_reach_the_relaxation():
    """A loop whose tree is a bad start, and repeated edges: no other rotations fit better."""
    rng = np.random.default_rng(11)
    rows, cols = np.array([(i, (i + k) % 30) for i in range(30) for k in (1, 2)] + [(0, 1)] * 2).T
    truth = kernels.exp_rotations(rng.normal(size=(30, 3)))
    relative = kernels.exp_rotations(0.1 * rng.normal(size=(len(rows), 3))) @ truth[cols] @ np.swapaxes(truth[rows], 1, 2)
    fit = lambda r: float(np.einsum("mij,mij->", r[cols] @ np.swapaxes(r[rows], 1, 2), relative))
    found = kernels.average_rotations(30, rows, cols, relative, method="LAGRANGE_DUAL")
    assert fit(found) > fit(truth) and fit(found) > fit(kernels.tree_rotations(30, rows, cols, relative))
    for scale in (1e-3, 1e-1):
        assert all(fit(found @ kernels.exp_rotations(scale * rng.normal(size=(30, 3)))) < fit(found) for _ in range(20))


def test_rotations_are_logged_near_half_a_turn():
    v = np.random.default_rng(3).normal(size=(600, 3))
    v *= (np.r_[np.linspace(0, 1e-9, 200), np.linspace(0, 3.1, 200), np.linspace(np.pi - 0.1, np.pi - 1e-9, 200)] / np.linalg.norm(v, axis=1))[:, None]
    r = kernels.exp_rotations(v)
    assert np.abs(kernels.log_rotations(r) - v).max() < 1e-7 and np.allclose(r, [kernels.exp_rotation(x) for x in v], atol=1e-14)


@pytest.mark.parametrize("wrong", [False, True])
def test_a_large_component_that_agrees_needs_no_task_of_all_edges(spark, monkeypatch, wrong):
    """Its tree is tested by every edge; with one that disagrees it is averaged."""
    monkeypatch.setattr(flow, "_AVERAGED", 10)
    truth = kernels.exp_rotations(np.random.default_rng(5).normal(size=(45, 3)))
    rows = [(a, b, kernels.log_rotation(truth[b] @ truth[a].T).tolist()) for a in range(45) for b in range(a + 1, 45) if (a < 40) == (b < 40)]
    if wrong:
        rows[500] = (*rows[500][:2], [0.0, 0.0, 1.0])
    edges = spark.createDataFrame(rows, "src bigint, dst bigint, rotation array<double>")
    found = flow.global_rotations(edges)
    got = {r.id: kernels.exp_rotation(np.array(r.rotation)) for r in found.collect()}
    assert len(got) == 45 == found.count()
    for low, high in ((0, 40), (40, 45)):
        own = [(a - low, b - low, kernels.exp_rotation(np.array(r))) for a, b, r in rows if (a < 40) == (low < 40)]
        want = kernels.average_rotations(high - low, *(np.array(x) for x in zip(*own)))
        assert np.abs(np.stack([got[i] for i in range(low, high)]) - want).max() < 1e-8
        assert wrong and low == 0 or np.abs(want @ truth[low] - truth[low:high]).max() < 1e-9


@pytest.mark.parametrize("hold", [40, 500_000])
def test_closing_edges_are_tested_where_they_close(spark, hold):
    rng = np.random.default_rng(14)
    rows = [(a, b, float(t)) for (a, b), t in zip([(a, b) for a in range(45) for b in range(a + 1, 45) if (a * b) % 3 != 1], rng.integers(0, 40, 990))]
    edges = spark.createDataFrame(rows, "src bigint, dst bigint, turn double")
    old, new = edges.filter("(src + dst) % 5 > 0"), edges.filter("(src + dst) % 5 = 0")
    error = lambda ab, ac, bc: np.abs(ab + bc - ac)
    found = graph.edges_that_close(old, new.unionByName(new.limit(3)).unionByName(old.limit(9)), "turn", error, 0.5, hold=hold)
    want = graph.closing_edges(old, new, F.abs(F.col("ab.turn") + F.col("bc.turn") - F.col("ac.turn")), 0.5)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and 0 < want.count() < new.count()
    assert " ab#" not in found._jdf.queryExecution().executedPlan().toString()  # no row a triangle


@pytest.mark.parametrize("wedges", [1 << 21, 50])
def test_edges_in_loops_need_not_all_their_triangles(monkeypatch, wedges):
    monkeypatch.setattr(graph, "_WEDGES", wedges)
    u, v = np.triu_indices(150, 1)
    w, tried = np.where(u * 7 % 30 == 0, 9.0, 0) + (v - u), []
    error = lambda ab, ac, bc: tried.append(len(ab)) or np.abs(ab + bc - ac)
    found = graph._in_a_loop(u, v, pa.array(w), np.ones(len(u), dtype=bool), None, error, 1.0)
    every = np.zeros(len(u), dtype=bool)
    for ab, ac, bc in graph._closed(u, v):
        for s in (ab, ac, bc):
            every[s[np.abs(w[ab] + w[bc] - w[ac]) < 1.0]] = True
    assert (found == every).all() and sum(tried) < 150 * 149 * 148 // 6


def test_verified_pairs_are_no_rows_of_matches(spark, monkeypatch):
    monkeypatch.setattr(catalog_numeric, "_rig", None)
    monkeypatch.setattr(flow, "_VERIFIED", 2)
    monkeypatch.setattr(flow, "matched_points", None)
    assert same(QUERIES["pairs_verified"](spark, "/root/testdata/sf0.01"), over("/root/testdata/sf0.01", *TABLES), ORACLES["pairs_verified"])


def test_pose_of_many_points_is_that_of_few(monkeypatch):
    rng = np.random.default_rng(15)
    x = rng.normal(size=(1_500, 3)) + [0, 0, 8]
    r, t = kernels.exp_rotation(np.array([0.1, -0.3, 0.2])), np.array([1.0, 0.2, 0.1])
    y = x @ r.T + t
    e, x, y = kernels.skew(t) @ r, x[:, :2] / x[:, 2:], y[:, :2] / y[:, 2:]
    quick = kernels.recover_pose(e, x, y)
    monkeypatch.setattr(kernels, "_SEEN", 10_000)
    assert all(np.array_equal(a, b) for a, b in zip(quick, kernels.recover_pose(e, x, y))) and np.allclose(quick[0], r)


@pytest.mark.parametrize("pairs_", [1 << 21, 40])
def test_dense_pairs_are_shuffled_as_compressed_blocks(spark, monkeypatch, tmp_path, pairs_):
    from skein import views

    monkeypatch.setattr(views, "_PAIRS", pairs_)
    rng = np.random.default_rng(16)
    rows = {"l_partkey": rng.integers(0, 60, 900), "l_suppkey": rng.integers(-5, 70, 900) * 10**9}
    pq.write_table(pa.table({**rows, "l_orderkey": np.arange(900)}), tmp_path / "lineitem.parquet")
    found = frame(spark, str(tmp_path), "dense")
    assert "blob" in found._jdf.queryExecution().executedPlan().toString()
    assert same(found, over(tmp_path, "lineitem"), with_("SELECT * FROM {dense}"))
