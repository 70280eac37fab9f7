"""Numeric kernels on synthetic ground truth, and expressions against them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.functions import geometry as g
from skein.kernels import geometry as k, robust


def test_trials():
    for n, m, c, t in ((1, 100, 0.99, 4605168), (10, 100, 0.99, 4603), (10, 100, 0.999, 6905), (100, 100, 0.99, 1), (100, 100, 0.0, 1)):
        assert robust.trials(n, m, c) == t


def test_robust_similarity():
    rng = np.random.default_rng(0)
    x = rng.uniform(-1000, 1000, (1000, 3))
    y = 2 * x + [100, 10, 10]
    y[:400] = rng.uniform(-3000, -2000, (400, 3))
    m, inliers, _ = robust.ransac(k.Similarity(), x, y, 10.0**2, local=2)
    assert inliers.sum() == 600 and not inliers[:400].any()
    assert np.abs(m - np.column_stack([2 * np.eye(3), [100, 10, 10]])).max() < 1e-6


def test_samplers():
    assert len(list(robust.all_samples(5, 3))) == 10
    first = next(robust.progressive_samples(np.arange(10.0), 3))
    assert set(first) == {9, 8, 7}


def test_linear_solvers():
    rng = np.random.default_rng(1)
    a, x = rng.normal(size=(60, 4)), np.array([1.0, -2, 3, 0.5])
    b = a @ x
    b[:10] += 50
    assert np.allclose(robust.least_absolute(a, b, rounds=3000), x, atol=1e-3)
    p = a.T @ a
    assert np.allclose(robust.conjugate_gradient(lambda v: p @ v, p @ x), x, atol=1e-6)
    assert np.allclose(robust.quadratic_program(np.eye(2), np.array([-3.0, 1]), np.zeros(2), np.ones(2)), [1, 0], atol=1e-6)
    assert np.allclose(sorted(robust.polynomial_roots([1, -6, 11, -6]).real), [1, 2, 3])
    r, q = robust.rq(rng.normal(size=(3, 3)))
    assert np.allclose(q @ q.T, np.eye(3)) and np.allclose(r, np.triu(r))


@pytest.mark.parametrize("model", sorted(k.MODELS))
def test_camera_models(model):
    names = k.MODELS[model][1].split()
    values = {"f": 500, "fx": 500, "fy": 510, "cx": 320, "cy": 240, "omega": 0.5}
    params = [values.get(n, 0.01) for n in names]
    uv = np.random.default_rng(0).uniform(-0.5, 0.5, (50, 2))
    assert np.abs(k.to_world(model, params, k.to_image(model, params, uv)) - uv).max() < 1e-6


def scene(n=60, views=2, seed=0):
    rng = np.random.default_rng(seed)
    points = rng.uniform(-1, 1, (n, 3)) + [0, 0, 5]
    poses = np.stack([np.column_stack([k.exp_rotation(rng.normal(size=3) * 0.1), rng.normal(size=3) * 0.5]) for _ in range(views)])
    poses[0] = np.eye(3, 4)
    cam = np.einsum("vij,nj->vni", poses[:, :, :3], points) + poses[:, None, :, 3]
    return points, poses, cam[..., :2] / cam[..., 2:]


def test_two_views():
    points, poses, x = scene(80, seed=3)
    x[1, :15] += np.random.default_rng(0).uniform(0.2, 0.4, (15, 2))
    found = k.two_view(x[0], x[1], calibrated=True, most=1e-3)
    assert found["config"] == 2 and found["inliers"][15:].all() and found["inliers"][:15].sum() <= 2
    assert np.abs(found["R"] - poses[1, :, :3]).max() < 1e-3
    t = poses[1, :, 3] / np.linalg.norm(poses[1, :, 3])
    assert np.abs(found["t"] - t).max() < 1e-2


def test_seven_points():
    _, _, x = scene(7, seed=4)
    assert min(k.sampson(f, x[0], x[1]).max() for f in k.Fundamental7().fit(x[0], x[1])) < 1e-12


def test_homography():
    rng = np.random.default_rng(5)
    h = np.array([[1.1, 0.1, 3], [0.05, 0.9, -2], [1e-4, 2e-4, 1]])
    x = rng.uniform(0, 100, (20, 2))
    p = np.column_stack([x, np.ones(20)]) @ h.T
    fitted = k.Homography().fit(x, p[:, :2] / p[:, 2:])[0]
    assert np.allclose(fitted / fitted[2, 2], h, atol=1e-6)


def test_watermark():
    rng = np.random.default_rng(6)
    x = rng.uniform(0, 30, (40, 2))
    assert k.watermark(x, x + [3, 1], 1000, 800)
    assert not k.watermark(rng.uniform(300, 500, (40, 2)), rng.uniform(300, 500, (40, 2)), 1000, 800)


def test_triangulation_and_pose():
    points, poses, x = scene(40, views=3, seed=7)
    assert np.allclose(k.triangulate_views(poses, x.transpose(1, 0, 2)), points, atol=1e-8)
    found = k.PnP().fit(points, x[2])[0]
    assert np.allclose(found, poses[2], atol=1e-6)


def test_rotation_averaging():
    rng = np.random.default_rng(8)
    truth = np.stack([k.exp_rotation(rng.normal(size=3)) for _ in range(8)])
    rows, cols = np.array([(i, j) for i in range(8) for j in range(i + 1, 8)]).T
    relative = np.stack([truth[j] @ truth[i].T for i, j in zip(rows, cols)])
    relative[3] = k.exp_rotation(rng.normal(size=3))
    found = k.align_rotations(truth, k.average_rotations(8, rows, cols, relative))
    assert max(np.degrees(np.linalg.norm(k.log_rotation(a @ b.T))) for a, b in zip(truth, found)) < 1.0


@pytest.mark.parametrize(("method", "most"), [("NONLINEAR", 2.0), ("LAGRANGE_DUAL", 2.0)])
def test_rotation_averaging_methods(method, most):
    """A sparse graph with a little noise on every edge; exact without it."""
    rng = np.random.default_rng(3)
    truth = np.stack([k.exp_rotation(rng.normal(size=3)) for _ in range(12)])
    rows, cols = np.array([(i, j) for i in range(12) for j in range(i + 1, 12) if (j - i) % 5 < 3]).T
    for noise, bound in ((0.0, 1e-3), (0.01, most)):
        relative = np.stack([k.exp_rotation(rng.normal(size=3) * noise) @ truth[j] @ truth[i].T for i, j in zip(rows, cols)])
        found = k.average_rotations(12, rows, cols, relative, method=method)
        assert np.allclose(np.linalg.det(found), 1) and np.allclose(found[0], np.eye(3), atol=1e-6)
        found = k.align_rotations(truth, found)
        assert max(np.degrees(np.linalg.norm(k.log_rotation(a @ b.T))) for a, b in zip(truth, found)) < bound


def test_bundle_adjustment():
    points, poses, x = scene(30, views=4, seed=9)
    view, point = np.divmod(np.arange(120), 30)
    rng = np.random.default_rng(0)
    rough = poses.copy()
    rough[2:, :, 3] += rng.normal(size=(2, 3)) * 0.02
    start = points + rng.normal(size=points.shape) * 0.02
    _, _, error = k.bundle_adjust(rough, start, view, point, x.reshape(-1, 2), fixed=(0, 1))
    assert error < 1e-12


def test_mean_quaternion():
    q = k.to_quaternion(k.exp_rotation(np.array([0.1, 0.2, -0.1])))
    assert np.allclose(k.mean_quaternion(np.stack([q, -q, q]), np.ones(3)), q)


def test_geodesy():
    rows = np.array([[48.14800, 11.57000, 561.0], [48.14843, 11.57155, 561.1509]])
    a, e2 = 6378137.0, (1 / 298.257223563) * (2 - 1 / 298.257223563)
    lat, lon = np.radians(rows[:, 0]), np.radians(rows[:, 1])
    n = a / np.sqrt(1 - e2 * np.sin(lat) ** 2)
    xyz = np.stack([(n + rows[:, 2]) * np.cos(lat) * np.cos(lon), (n + rows[:, 2]) * np.cos(lat) * np.sin(lon), (n * (1 - e2) + rows[:, 2]) * np.sin(lat)], axis=1)
    assert np.abs(k.xyz_to_ellipsoid(xyz) - rows).max() < 1e-6


def test_expressions_agree_with_kernels(spark):
    rng = np.random.default_rng(10)
    rows = [tuple(map(float, rng.normal(size=10))) for _ in range(20)]
    df = spark.createDataFrame(rows, "w double, x double, y double, z double, a double, b double, c double, d double, e double, f double")
    q = g.normalized(g.vector("w", "x", "y", "z"))
    v, t = g.vector("a", "b", "c"), g.vector("d", "e", "f")
    turned, back = g.rotate(q, v), g.from_angle_axis(g.to_angle_axis(q))
    centre, euler = g.centre(q, t), g.from_euler(*g.to_euler(q))
    out = df.select(*[F.array(*x).alias(n) for n, x in (("q", q), ("turned", turned), ("back", back), ("centre", centre), ("euler", euler))]).collect()
    for row, r in zip(rows, out):
        m = k.from_quaternion(row[:4])
        assert np.allclose(r.turned, m @ row[4:7])
        assert np.allclose(np.abs(np.dot(r.back, r.q)), 1) and np.allclose(np.abs(np.dot(r.euler, r.q)), 1)
        assert np.allclose(r.centre, -m.T @ row[7:])


def test_interpolated_poses(spark):
    half = float(np.sqrt(0.5))
    df = spark.createDataFrame([(1.0, 0.0, half, half)], "w1 double, z1 double, w2 double, z2 double")
    zero = F.lit(0.0)
    q, t = g.interpolate_pose((F.col("w1"), zero, zero, F.col("z1")), g.vector(0.0, 0.0, 0.0), (F.col("w2"), zero, zero, F.col("z2")), g.vector(2.0, 0.0, 0.0), F.lit(0.5))
    r = df.select(F.array(*q).alias("q"), F.array(*t).alias("t")).first()
    assert np.allclose(r.q, [np.cos(np.pi / 8), 0, 0, np.sin(np.pi / 8)]) and np.allclose(r.t, [1, 0, 0])


def test_five_points():
    """Of the models through five matches one is the true essential matrix."""
    rng = np.random.default_rng(11)
    for _ in range(20):
        r, t = k.exp_rotation(rng.normal(size=3) * 0.3), rng.normal(size=3)
        x3 = rng.uniform(-2, 2, (30, 3)) + [0, 0, 6]
        y3 = x3 @ r.T + t
        x, y = x3[:, :2] / x3[:, 2:], y3[:, :2] / y3[:, 2:]
        truth = k.skew(t / np.linalg.norm(t)) @ r
        truth /= np.linalg.norm(truth)
        found = k.Essential5().fit(x[:5], y[:5])
        assert found and min(min(np.abs(e - truth).max(), np.abs(e + truth).max()) for e in found) < 1e-6
        best = min(found, key=lambda e: k.sampson(e, x, y).max())
        assert k.sampson(best, x, y).max() < 1e-12


def test_homography_decomposition():
    rng = np.random.default_rng(12)
    for _ in range(20):
        r, t, n = k.exp_rotation(rng.normal(size=3) * 0.4), rng.normal(size=3), rng.normal(size=3)
        n /= np.linalg.norm(n)
        n = n if np.linalg.det(r + np.outer(t, n)) > 0 else -n  # both cameras on one side of the plane
        found = k.decompose_homography(rng.choice([-2.0, 3.0]) * (r + np.outer(t, n)))
        assert min(np.abs(a - r).max() + np.abs(b - t).max() + np.abs(c - n).max() for a, b, c in found) < 1e-6
        assert all(np.allclose(a @ a.T, np.eye(3), atol=1e-8) for a, _, _ in found)
    ((a, b, _),) = k.decompose_homography(2 * r)
    assert np.allclose(a, r) and not b.any()
