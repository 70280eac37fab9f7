"""Files written and read again."""

import numpy as np

from skein.sources import files, model, sqlite
from skein.streaming import ingest


def test_sqlite_round_trip(spark, tmp_path):
    tables = {
        "cameras": spark.createDataFrame([(1, 0, 100, 80, [50.0, 50.0, 40.0], True)], "camera_id bigint, model int, width int, height int, params array<double>, prior_focal_length boolean"),
        "images": spark.createDataFrame([(1, "a", 1, None, [1.0, 2.0, 3.0]), (2, "b", 1, None, None)], "image_id bigint, name string, camera_id bigint, prior_q array<double>, prior_t array<double>"),
        "keypoints": spark.createDataFrame([(1, 0, 1.0, 2.0, 1.0, 0.0, 0.0, 1.0), (1, 1, 3.0, 4.0, 1.0, 0.5, 0.0, 1.0)], "image_id bigint, point2d_idx int, x float, y float, a11 float, a12 float, a21 float, a22 float"),
        "descriptors": spark.createDataFrame([(1, 0, [1, 255]), (1, 1, [0, 7])], "image_id bigint, point2d_idx int, descriptor array<smallint>"),
        "two_view_geometries": spark.createDataFrame([(2147483649, 1, 2, [(0, 1)], 6, [1.0, 0.0, 0.0, 0.0], [0.0, 0.0, 1.0])], "pair_id bigint, image_id1 bigint, image_id2 bigint, matches array<struct<idx1:int,idx2:int>>, config int, qvec array<double>, tvec array<double>"),
    }
    path = str(tmp_path / "store.db")
    sqlite.write(path, tables)
    for name, df in tables.items():
        assert sorted(map(repr, sqlite.read(spark, [path], name).drop("source").collect())) == sorted(map(repr, df.collect()))
    assert sqlite.read(spark, [path], "matches").count() == 0


def test_projection_matrix():
    """Either sign; the skew is left out."""
    r = np.linalg.qr(np.random.default_rng(1).normal(size=(3, 3)))[0]
    r *= np.linalg.det(r)
    k, t = np.array([[500.0, 3, 320], [0, 480, 240], [0, 0, 1]]), np.array([1.0, -2, 3])
    for scale in (1.0, -0.1):
        found = model.decompose_projection(scale * k @ np.column_stack([r, t]))
        assert np.allclose(found[0], k - 3 * np.eye(3, k=1) * [[1], [0], [0]]) and np.allclose(found[1], r) and np.allclose(found[2], t)


def test_keypoint_shapes():
    assert sqlite.keypoints(np.array([[1, 2]], "<f4").tobytes(), 1, 2).tolist() == [[1, 2, 1, 0, 0, 1]]
    four = sqlite.keypoints(np.array([[1, 2, 2, 0]], "<f4").tobytes(), 1, 4)
    assert four.tolist() == [[1, 2, 2, 0, 0, 2]]


def test_model_files(spark, tmp_path):
    cameras = spark.createDataFrame([(1, 1, 100, 80, [50.0, 51.0, 40.0, 30.0])], model.CAMERAS)
    images = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0], [0.5, 1.0, 2.0], 1, "a b.png".replace(" ", "_"), 3, [(1.5, 2.5, 7), (3.0, 4.0, None)]), (2, [1.0, 0.0, 0.0, 0.0], [0.0, 0.0, 0.0], 1, "c", 0, [])], model.IMAGES)
    points = spark.createDataFrame([(7, 1.0, 2.0, 3.0, 10, 20, 30, 0.5, [(1, 0), (2, 5)]), (8, 0.0, 0.0, 0.0, 0, 0, 0, -1.0, [])], model.POINTS)
    for name, df, text, read in (
        ("cameras", cameras, model.cameras_text, model.read_cameras_text), ("images", images, model.images_text, model.read_images_text), ("points", points, model.points_text, model.read_points_text),
    ):
        rows = sorted(map(repr, df.collect()))
        binary = tmp_path / f"{name}.bin"
        binary.write_bytes(model.to_binary(df, name))
        assert sorted(map(repr, model.read_binary(spark, str(binary), name).collect())) == rows
        lines = tmp_path / f"{name}.txt"
        lines.write_text("# head\n" + "\n".join(r.value for r in text(df).collect()) + "\n")
        assert sorted(map(repr, read(spark, str(lines)).collect())) == rows


def test_exports(spark):
    cameras = spark.createDataFrame([(1, 1, 100, 80, [50.0, 51.0, 40.0, 30.0])], model.CAMERAS)
    images = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0], [0.5, 1.0, 2.0], 1, "a", 3, [])], model.IMAGES)
    points = spark.createDataFrame([(7, 1.0, 2.0, 3.0, 10, 20, 30, 0.5, [])], model.POINTS)
    assert model.nvm_lines(images, cameras).first().value.startswith("a 50.0 1.0 0.0 0.0 0.0 -0.5 -1.0 -2.0")
    assert model.bundler_lines(images, cameras).first().value.split("\n")[-1] == "0.5 -1.0 -2.0"
    assert model.vrml_lines(points).first().value == "1.0, 2.0, 3.0,"


def test_ply(spark, tmp_path):
    header = model.ply_header(1)
    (tmp_path / "a.ply").write_text(header + "\n1 2 3 4 5 6\n")
    row = files.read_ply(spark, str(tmp_path / "a.ply")).first()
    assert (row.x, row.y, row.z, row.r, row.g, row.b) == (1, 2, 3, 4, 5, 6)
    binary = header.replace("ascii", "binary_little_endian").encode() + b"\n" + np.array([(1, 2, 3, 4, 5, 6)], "<f4,<f4,<f4,u1,u1,u1").tobytes()
    assert files.decode_ply(binary)["x"].tolist() == [1]


def test_arrays(spark, tmp_path):
    a = np.arange(24, dtype=np.float32).reshape(2, 3, 4)
    assert (files.decode_array(files.encode_array(a)) == a).all()
    (tmp_path / "a.bin").write_bytes(files.encode_array(a))
    rows = files.read_arrays(spark, str(tmp_path / "a.bin")).collect()
    assert all(a[r.row, r.col, r.channel] == r.value for r in rows) and len(rows) == 24


def test_consistency_graph():
    rows = [(0, 1, [4, 5]), (2, 3, [])]
    assert files.decode_consistency(files.encode_consistency(4, 4, rows)) == rows


def test_lists(spark, tmp_path):
    (tmp_path / "m.txt").write_text("a b\n0 1\n2 3\n\nc d\n4 5\n")
    rows = {tuple(r) for r in files.read_match_blocks(spark, str(tmp_path / "m.txt")).collect()}
    assert rows == {("a", "b", 0, 1), ("a", "b", 2, 3), ("c", "d", 4, 5)}
    (tmp_path / "f.txt").write_text("2 2\n1 2 3 0.5 7 8\n4 5 6 0.25 9 10\n")
    features = files.read_features_text(spark, str(tmp_path / "f.txt")).orderBy("idx").collect()
    assert [(r.x, r.descriptor) for r in features] == [(1.0, [7, 8]), (4.0, [9, 10])]


def test_images_and_cameras(spark, tmp_path):
    for name in ("a/1.png", "a/2.png", "b/1.png"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    images = files.list_images(spark, str(tmp_path))
    assert [r.name for r in images.collect()] == ["a/1.png", "a/2.png", "b/1.png"]
    assert {policy: files.assign_cameras(images, policy).select("camera_id").distinct().count() for policy in ("single", "folder", "image")} == {"single": 1, "folder": 2, "image": 3}
    specs = spark.createDataFrame([("Acme Co", "X-100", 6.2)], "make string, model string, sensor_mm double")
    known = files.sensor_widths(spark.createDataFrame([("ACMECO", "x100"), ("other", "y")], "make string, model string"), specs)
    assert {r.model: r.sensor_mm for r in known.collect()} == {"x100": 6.2, "y": None}


def test_npy(spark, tmp_path):
    np.save(tmp_path / "r.npy", np.eye(2))
    assert [r.embedding for r in files.read_npy(spark, str(tmp_path / "r.npy")).orderBy("region").collect()] == [[1.0, 0.0], [0.0, 1.0]]


def test_incremental_ingest(spark, tmp_path):
    """A stream in three files makes the same pairs as one batch, and a repeated
    batch adds nothing."""
    rows = [(1, 1), (2, 1), (2, 2), (3, 2), (4, 1), (4, 2)]
    source = tmp_path / "in"
    for i in range(3):
        spark.createDataFrame(rows[2 * i : 2 * i + 2], "image_id bigint, point_id bigint").coalesce(1).write.mode("append").parquet(str(source))
    target = ingest.Ingest(spark, str(tmp_path / "out"))
    stream = spark.readStream.schema("image_id bigint, point_id bigint").option("maxFilesPerTrigger", 1).parquet(str(source))
    ingest.run(stream, target, str(tmp_path / "check")).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out" / "pairs"))
    assert {(r.image_id1, r.image_id2) for r in found.collect()} == {(1, 2), (1, 4), (2, 3), (2, 4), (3, 4)}
    n = found.count()
    target(spark.createDataFrame(rows[:2], "image_id bigint, point_id bigint"), 77)
    assert spark.read.parquet(str(tmp_path / "out" / "pairs")).count() == n
