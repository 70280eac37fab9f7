"""Command line: the engine's commands over tables and files.

``python -m skein.cli COMMAND --option value ...``; every command reads Parquet
tables (or the formats of ``skein.sources``) and writes Parquet or text.
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

COMMANDS: dict[str, Callable] = {}


def command(function):
    COMMANDS[function.__name__] = function
    return function


@dataclass
class Options:
    """Options of a project; ``write`` and ``read`` keep them as JSON."""

    overlap: int = 10
    quadratic: bool = False
    neighbours: int = 50
    distance: float = 100.0
    rounds: int = 3
    least: int = 15
    size: int = 100
    method: str = "NCUT"
    most_error: float = 4.0
    min_angle: float = 1.5
    min_track: int = 2
    top: int = 100

    def write(self, path: str) -> None:
        Path(path).write_text(json.dumps(asdict(self), indent=1, sort_keys=True))

    @classmethod
    def read(cls, path: str) -> Options:
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in json.loads(Path(path).read_text()).items() if k in known})


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


@command
def database_creator(spark, args, options):
    from skein.operators.store import Store

    Store(spark, args.output).create()


@command
def database_merger(spark, args, options):
    from skein.operators.store import SCHEMAS, Store, merge

    a, b, out = Store(spark, args.input), Store(spark, args.other), Store(spark, args.output)
    for name, rows in merge({t: a.read(t) for t in SCHEMAS}, {t: b.read(t) for t in SCHEMAS}).items():
        out.replace(name, rows)


@command
def project_generator(spark, args, options):
    options.write(args.output)


def _matcher(function):
    def run(spark, args, options):
        function(spark, args, options).write.mode("overwrite").parquet(args.output)

    COMMANDS[function.__name__] = run
    return function


@_matcher
def exhaustive_matcher(spark, args, options):
    from skein.operators import pairs

    return pairs.exhaustive(_read(spark, args.input))


@_matcher
def sequential_matcher(spark, args, options):
    from skein.operators import pairs

    return pairs.sequential(_read(spark, args.input), overlap=options.overlap, quadratic=options.quadratic)


@_matcher
def spatial_matcher(spark, args, options):
    from skein.operators import pairs

    return pairs.spatial(_read(spark, args.input), neighbours=options.neighbours, distance=options.distance)


@_matcher
def transitive_matcher(spark, args, options):
    from skein.operators import pairs

    return pairs.transitive(_read(spark, args.input), options.rounds)


@_matcher
def vocab_tree_matcher(spark, args, options):
    from skein.operators import retrieval

    postings = _read(spark, args.input)
    queries = postings.select(F.col("doc_id").alias("query_id"), "word", F.col("tf").alias("qtf"))
    found = retrieval.search(queries, postings, options.top).filter("query_id < doc_id")
    return found.select(F.col("query_id").alias("image_id1"), F.col("doc_id").alias("image_id2"), (F.col("score") * 1000).cast("int").alias("score"))


@_matcher
def vocab_tree_retriever(spark, args, options):
    from skein.operators import retrieval

    return retrieval.search(_read(spark, args.other), _read(spark, args.input), options.top)


@_matcher
def matches_importer(spark, args, options):
    from skein.operators import pairs

    return pairs.from_names(pairs.parse_pair_list(spark.read.text(args.other)), _read(spark, args.input))


@_matcher
def feature_importer(spark, args, options):
    from skein.sources.files import read_features_text

    return read_features_text(spark, args.input)


@_matcher
def image_lister(spark, args, options):
    from skein.sources.files import list_images

    return list_images(spark, args.input)


@command
def vocab_tree_builder(spark, args, options):
    import pandas as pd

    from skein.operators.retrieval import vocabulary

    centres = vocabulary(_read(spark, args.input), options.top)
    spark.createDataFrame(pd.DataFrame({"word": range(len(centres)), "centre": list(centres)})).write.mode("overwrite").parquet(args.output)


@_matcher
def image_deleter(spark, args, options):
    return _read(spark, args.input).join(_read(spark, args.other).select("image_id"), "image_id", "left_anti")


@_matcher
def image_filterer(spark, args, options):
    from skein.operators import model

    obs = _read(spark, args.input)
    few = model.per_image_counts(obs.select("image_id").distinct(), obs).filter(F.col("observations") < options.least)
    return obs.join(few.select("image_id"), "image_id", "left_anti")


@_matcher
def point_filtering(spark, args, options):
    from skein.operators import model

    return model.short_tracks_dropped(_read(spark, args.input), options.min_track)


@_matcher
def model_analyzer(spark, args, options):
    from skein.operators import model

    obs = _read(spark, args.input)
    return model.statistics(obs.select("image_id").distinct(), obs)


@_matcher
def color_extractor(spark, args, options):
    from skein.operators import model

    return model.mean_colours(_read(spark, args.input), _read(spark, args.other))


@_matcher
def mapper(spark, args, options):
    from skein.plans import flow

    obs = _read(spark, args.input)
    members = obs.select(F.lit(0).cast("long").alias("label"), F.col("image_id").alias("id")).distinct()
    return flow.reconstruct_clusters(members, obs)


@_matcher
def local_sfm_worker(spark, args, options):
    """Reconstruct clusters (label, id) given as ``--other``, one task each."""
    from skein.plans import flow

    return flow.reconstruct_clusters(_read(spark, args.other), _read(spark, args.input))


@_matcher
def distributed_mapper(spark, args, options):
    from skein.plans import flow

    return flow.run(_read(spark, args.input), _read(spark, args.other), size=options.size)


@_matcher
def automatic_reconstructor(spark, args, options):
    """Features (image_id, idx, x, y, descriptor) and pairs to a merged model."""
    from skein.operators import tracks
    from skein.plans import flow
    from skein.session import cut

    features, pairs_ = _read(spark, args.input), _read(spark, args.other)
    matches = cut(flow.match_pairs(pairs_, features.select("image_id", "idx", "descriptor")))
    geometries = cut(flow.verify_pairs(matches, features.select("image_id", "idx", "x", "y"), least=options.least))
    edges = cut(flow.view_graph(geometries, least=options.least))
    found = tracks.build(geometries)
    return flow.run(found.join(features.select("image_id", "idx", "x", "y"), ["image_id", "idx"]), edges, size=options.size)


@_matcher
def point_triangulator(spark, args, options):
    from skein.plans import flow

    return flow.triangulate_tracks(_read(spark, args.input), _read(spark, args.other))


@_matcher
def image_registrator(spark, args, options):
    """Poses of images that a model (``--other``) lacks, from its points."""
    from skein.plans import flow

    model = _read(spark, args.other)
    points = model.filter("kind = 'point'").select(F.col("id").alias("track"), F.col("v").alias("xyz"))
    return flow.register_images(_read(spark, args.input), points, model.filter("kind = 'pose'").select(F.col("id").alias("image_id")), least=options.least)


@_matcher
def bundle_adjuster(spark, args, options):
    """Partial models (``--other``) refined on observations."""
    from skein.plans import flow

    return flow.adjust_models(_read(spark, args.other), _read(spark, args.input))


@_matcher
def model_merger(spark, args, options):
    from skein.plans import flow

    models = _read(spark, args.input)
    return flow.merge_models(models, flow.transforms_to_anchor(flow.model_graph(models), models))


@_matcher
def sfm_aligner(spark, args, options):
    """Each partial model's map into its common frame."""
    from skein.plans import flow

    models = _read(spark, args.input)
    return flow.transforms_to_anchor(flow.model_graph(models), models)


@_matcher
def model_orientation_aligner(spark, args, options):
    from skein.plans import flow

    return flow.upright(_read(spark, args.input))


@_matcher
def model_aligner(spark, args, options):
    """The map of a model onto reference positions: one row (m, mean, median)."""
    from skein.plans import flow

    m, mean, median = flow.align_to_reference(_read(spark, args.input), _read(spark, args.other))
    return spark.createDataFrame([(m.ravel().tolist(), mean, median)], "m array<double>, mean double, median double")


@command
def model_converter(spark, args, options):
    """Binary model folder to text lines (cameras, images, points)."""
    from skein.sources import model

    for name, text in (("cameras", model.cameras_text), ("images", model.images_text), ("points", model.points_text)):
        text(model.read_binary(spark, f"{args.input}/{name}.bin", name)).write.mode("overwrite").text(f"{args.output}/{name}")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="skein", description=__doc__)
    parser.add_argument("command", choices=sorted(COMMANDS))
    for name in ("input", "other", "output", "project"):
        parser.add_argument(f"--{name}")
    for f in fields(Options):
        kind = (lambda x: x.lower() in ("1", "true", "yes")) if f.type == "bool" else {"int": int, "float": float, "str": str}[f.type]
        parser.add_argument(f"--{f.name}", type=kind)
    args = parser.parse_args(argv)
    options = Options.read(args.project) if args.project else Options()
    for f in fields(Options):
        if getattr(args, f.name) is not None:
            setattr(options, f.name, getattr(args, f.name))
    COMMANDS[args.command](spark or SparkSession.builder.getOrCreate(), args, options)


if __name__ == "__main__":
    main()
