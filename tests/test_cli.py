"""Commands over small tables."""

import json

from conftest import SF
from skein import cli
from skein.views import frame


def test_project_files(spark, tmp_path):
    path = str(tmp_path / "p.json")
    cli.main(["project_generator", "--output", path, "--overlap", "3"], spark)
    assert cli.Options.read(path).overlap == 3 and json.loads(open(path).read())["method"] == "NCUT"


def test_commands(spark, tmp_path):
    images = str(tmp_path / "images")
    frame(spark, SF, "images").filter("image_id < 40").write.parquet(images)
    out = str(tmp_path / "out")
    cli.main(["exhaustive_matcher", "--input", images, "--output", out], spark)
    assert spark.read.parquet(out).count() == 780
    cli.main(["sequential_matcher", "--input", images, "--output", out, "--overlap", "2"], spark)
    assert spark.read.parquet(out).count() == 39
    cli.main(["transitive_matcher", "--input", out, "--output", str(tmp_path / "two"), "--rounds", "1"], spark)
    assert spark.read.parquet(str(tmp_path / "two")).count() == 38
    obs = str(tmp_path / "obs")
    frame(spark, SF, "obs").write.parquet(obs)
    cli.main(["model_analyzer", "--input", obs, "--output", out], spark)
    assert spark.read.parquet(out).first().observations == frame(spark, SF, "obs").count()
    cli.main(["point_filtering", "--input", obs, "--output", out, "--min_track", "30"], spark)
    assert 0 < spark.read.parquet(out).count() < frame(spark, SF, "obs").count()


def test_stores(spark, tmp_path):
    path = str(tmp_path / "store")
    cli.main(["database_creator", "--output", path], spark)
    cli.main(["database_merger", "--input", path, "--other", path, "--output", str(tmp_path / "merged")], spark)
