"""Source views, voting, matching, rigs, fusion and edits on small inputs."""

import numpy as np
from pyspark.sql import functions as F

from skein.kernels import geometry as k, robust
from skein.operators import edits, views
from skein.sources import model as files


def test_three_points():
    rng = np.random.default_rng(0)
    points = rng.uniform(-1, 1, (30, 3)) + [0, 0, 6]
    r, t = k.exp_rotation(np.array([0.1, -0.2, 0.05])), np.array([0.3, -0.1, 0.2])
    cam = points @ r.T + t
    x = cam[:, :2] / cam[:, 2:]
    x[:8] += 0.3
    poses = k.P3P().fit(points[10:13], x[10:13])
    assert min(np.abs(p - np.column_stack([r, t])).max() for p in poses) < 1e-6
    found = robust.ransac(k.P3P(), points, x, 1e-8, local=2)
    assert found[1][8:].all() and not found[1][:8].any()


def test_one_to_one(spark):
    rows = [(1, 0, 0, 0.9), (1, 0, 1, 0.8), (1, 1, 0, 0.95), (2, 5, 5, 0.1)]
    df = spark.createDataFrame(rows, "pair bigint, a bigint, b bigint, score double")
    assert {(r.pair, r.a, r.b) for r in views.one_to_one(df, ["pair"]).collect()} == {(1, 1, 0), (1, 0, 1), (2, 5, 5)}


def test_votes_of_one_bin(spark):
    rows = [(1, 10.0, 20.0, 1.0, 0.1)] * 4 + [(1, 9000.0, 0.0, 1.0, 0.0), (1, 0.0, 0.0, 100.0, 0.0)]
    found = views.votes(spark.createDataFrame(rows, "pair bigint, tx double, ty double, scale double, angle double"), ["pair"]).collect()
    assert [(r.votes, round(r.score, 6)) for r in found] == [(4, 4 * (1 + 0.5 + 0.25 + 0.125 + 0.0625 + 0.03125))]


def test_rig(spark):
    q, turn = [1.0, 0.0, 0.0, 0.0], [float(np.cos(0.2)), 0.0, 0.0, float(np.sin(0.2))]
    rows = [(s, 0, True, q, [0.0, 0.0, float(s)]) for s in range(3)] + [(s, 1, False, turn, [1.0, 0.0, float(s)]) for s in range(3)]
    found = {r.camera_id: (r.q, r.t) for r in views.rig_poses(spark.createDataFrame(rows, "snapshot bigint, camera_id bigint, reference boolean, q array<double>, t array<double>")).collect()}
    assert np.allclose(found[1][0], turn) and np.allclose(found[1][1], [1, 0, 0]) and np.allclose(found[0][0], q)
    rig = spark.createDataFrame([(0, 0.0, 0.0, 0.0)], "camera_id bigint, x double, y double, z double")
    assert np.isnan(views.rig_scale(rig, spark.createDataFrame([(0, 0, 1.0, 1.0, 1.0)], "snapshot bigint, camera_id bigint, x double, y double, z double")).first().scale)


def test_fusion(spark):
    rows = [(1, *map(float, (i, 0, 0, 0, 0, 1, 10 * i, 0, 0))) for i in range(5)] + [(2, *[0.0] * 9)]
    df = spark.createDataFrame(rows, "cluster bigint, x double, y double, z double, nx double, ny double, nz double, r double, g double, b double")
    assert [(r.cluster, r.n, r.x, r.r) for r in views.fused_points(df).collect()] == [(1, 5, 2.0, 20.0)]


def test_edits(spark):
    obs = spark.createDataFrame([(1, 0, 10), (2, 0, 10), (3, 0, 10), (1, 1, 11), (2, 1, 11), (4, 0, None)], "image_id bigint, idx bigint, point_id bigint")
    gone = spark.createDataFrame([(3, 0), (2, 1)], "image_id bigint, idx bigint")
    after = {(r.image_id, r.idx): r.point_id for r in edits.delete_observations(obs, gone).collect()}
    assert after == {(1, 0): 10, (2, 0): 10, (3, 0): None, (1, 1): None, (2, 1): None, (4, 0): None}
    new = edits.add_points(obs, spark.createDataFrame([(4, 0, 12)], "image_id bigint, idx bigint, new_id bigint"))
    assert new.filter("point_id = 12").count() == 1
    assert edits.deregister(obs, spark.createDataFrame([(1,)], "image_id bigint")).filter("point_id IS NOT NULL").count() == 2


def test_overlap_images(spark):
    g = spark.createDataFrame([(0, 1, 5), (1, 2, 9), (2, 3, 4), (0, 3, 7)], "src bigint, dst bigint, weight bigint")
    labels = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1)], "id bigint, label bigint")
    assert {(r.label, r.id) for r in views.overlap_images(g, labels, 1).collect()} == {(0, 2), (1, 1)}


def test_consistent_pixels(spark):
    pixels = spark.createDataFrame([(0, 1.0, 0.0, 0.0, 1.0), (1, 1.005, 0.0, 0.0, 1.0), (2, 1.5, 0.0, 0.0, 1.0)], "id bigint, depth double, nx double, ny double, nz double")
    near = spark.createDataFrame([(0, 1, 1.0, 0.5, 0.5), (0, 2, 1.0, 0.0, 0.0), (1, 0, 1.0, 3.0, 0.0)], "a bigint, b bigint, depth_b double, dx double, dy double")
    assert [(r.a, r.b) for r in views.consistent_pixels(pixels, near).collect()] == [(0, 1)]


def test_bundler(spark, tmp_path):
    (tmp_path / "b.out").write_text("# Bundle file v0.3\n1 1\n500 0.1 0\n1 0 0\n0 1 0\n0 0 1\n1 2 3\n4 5 6\n7 8 9\n1 0 12 0.5 -0.5\n")
    image = files.read_bundler(spark, str(tmp_path / "b.out"), "images").first()
    assert (image.f, image.t) == (500.0, [1.0, 2.0, 3.0])
    point = files.read_bundler(spark, str(tmp_path / "b.out")).first()
    assert (point.z, point.b, [tuple(t) for t in point.track]) == (6.0, 9, [(0, 12, 0.5, -0.5)])


def test_masks(spark):
    df = spark.createDataFrame([([1, 2, 3], [True, False, True])], "m array<int>, k array<boolean>")
    good, bad = edits.split_by_mask(F.col("m"), F.col("k"))
    assert tuple(df.select(good.alias("g"), bad.alias("b")).first()) == ([1, 3], [2])
