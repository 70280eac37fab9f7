"""Queries of graph edits, forests, searches, cuts and clusters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window, functions as F

from skein.operators import graph, partition, tracks, views
from skein.session import cut, cut_packed

from .catalog_store import matches_of
from .registry import query


def _sparse(v):
    return v("sparse").select(F.col("image_id1").alias("src"), F.col("image_id2").alias("dst"), F.col("shared").alias("weight"))


_SPARSE = "SELECT image_id1 AS src, image_id2 AS dst, shared AS weight FROM {sparse}"


# Edits --------------------------------------------------------------------------------


@query("SELECT src, dst, weight FROM {dense} WHERE (src + dst) % 3 > 0 UNION ALL SELECT src, dst, 1000 + (src + dst) % 7 FROM {dense} WHERE (src + dst) % 3 = 0")
def edges_added(v):
    """Of repeated new edges the first one counts, not the lightest."""
    known = v("dense").filter("(src + dst) % 3 > 0")
    again = v("dense").select("src", "dst", F.explode(F.array(F.lit(2), F.lit(0), F.lit(1))).alias("place"))
    more = again.select("src", "dst", F.when(F.col("place") == 0, 1000 + (F.col("src") + F.col("dst")) % 7).otherwise(F.col("place")).cast("long").alias("weight"), "place")
    return graph.add_edges(known, more, "place")


@query("SELECT src, dst, CASE WHEN src % 2 = 0 THEN weight + 5 ELSE weight END AS weight FROM {dense} WHERE dst % 4 > 0")
def edges_altered(v):
    changed = v("dense").filter("src % 2 = 0").select("src", "dst", (F.col("weight") + 5).alias("weight"))
    return graph.delete_edges(graph.alter_edges(v("dense"), changed), v("dense").filter("dst % 4 = 0"))


@query("SELECT camera_id AS id FROM {cameras} WHERE camera_id % 3 > 0")
def nodes_deleted(v):
    nodes = v("cameras").select(F.col("camera_id").alias("id"))
    return graph.delete_nodes(nodes, nodes.filter("id % 3 = 0"))


@query("SELECT src, dst FROM {dense} WHERE src = (SELECT min(camera_id) + 3 FROM {cameras}) OR dst = (SELECT min(camera_id) + 3 FROM {cameras}) ORDER BY src, dst LIMIT 1")
def incident_edge(v):
    node = v("cameras").agg(F.min("camera_id") + 3).first()[0]
    return graph.incident(v("dense"), node).select("src", "dst")


@query("SELECT DISTINCT id FROM (SELECT image_id1 AS id FROM {sparse} UNION ALL SELECT image_id2 FROM {sparse}) t")
def node_list(v):
    return graph.nodes_of(_sparse(v))


# Forests, searches, groups ----------------------------------------------------------------

#: Edges taken in order; the state is each node's label.
_FOREST = """RECURSIVE
    e AS (SELECT row_number() OVER (ORDER BY %s) AS i, src, dst, weight FROM %s),
    k AS (SELECT CAST(0 AS BIGINT) AS i, range(0, (SELECT max(greatest(src, dst)) + 1 FROM e)) AS lab UNION ALL
          SELECT k.i + 1, CASE WHEN lab[src + 1] <> lab[dst + 1] THEN list_transform(lab, lambda x: CASE WHEN x = greatest(lab[src + 1], lab[dst + 1]) THEN least(lab[src + 1], lab[dst + 1]) ELSE x END) ELSE lab END FROM k JOIN e ON e.i = k.i + 1)
    SELECT src, dst, weight FROM k JOIN e ON e.i = k.i + 1 WHERE lab[src + 1] <> lab[dst + 1]"""


@query(_FOREST % ("weight, src, dst", "{dense}"))
def mst_edges(v):
    return graph.spanning_forest(v("dense"))


@query(_FOREST % ("weight DESC, src, dst", "(SELECT * FROM {dense} WHERE weight % 3 > 0) d"))
def verified_forest(v):
    """With every edge that fails allowed for, the forest of those that pass."""
    return graph.verified_forest(v("dense"), lambda edges: edges.filter("weight % 3 > 0"), budget=1 << 40)


@query("""RECURSIVE
    e AS (SELECT row_number() OVER (ORDER BY image_id1, image_id2) AS i, image_id1 AS src, image_id2 AS dst FROM {sparse}),
    n AS (SELECT id, row_number() OVER (ORDER BY id) AS p FROM (SELECT src AS id FROM e UNION SELECT dst FROM e) t),
    x AS (SELECT i, a.p AS s, b.p AS d FROM e JOIN n a ON a.id = src JOIN n b ON b.id = dst),
    k AS (SELECT CAST(0 AS BIGINT) AS i, range(1, (SELECT count(*) + 1 FROM n)) AS lab UNION ALL
          SELECT k.i + 1, CASE WHEN lab[s] <> lab[d] AND len(list_filter(lab, lambda y: y = lab[s] OR y = lab[d])) <= 20 THEN list_transform(lab, lambda y: CASE WHEN y = greatest(lab[s], lab[d]) THEN least(lab[s], lab[d]) ELSE y END) ELSE lab END FROM k JOIN x ON x.i = k.i + 1),
    f AS (SELECT lab FROM k ORDER BY i DESC LIMIT 1)
    SELECT n.id, m.id AS component FROM n JOIN n m ON m.p = (SELECT lab FROM f)[n.p]""")
def size_capped_components(v):
    return graph.size_capped_components(_sparse(v), 20)


@query("""RECURSIVE
    u AS (SELECT src AS a, dst AS b FROM {viewgraph} UNION SELECT dst, src FROM {viewgraph}),
    s AS (SELECT min(a) AS source FROM u),
    d AS (SELECT source AS id, 0 AS k FROM s UNION SELECT u.b, d.k + 1 FROM d JOIN u ON d.id = u.a WHERE d.k < 40),
    l AS (SELECT id, min(k) AS k FROM d GROUP BY id),
    w AS (SELECT x.id, min(y.id) AS previous FROM l x JOIN u ON u.b = x.id JOIN l y ON y.id = u.a AND y.k = x.k - 1 GROUP BY x.id),
    t AS (SELECT id, k FROM l ORDER BY k DESC, id LIMIT 1),
    p AS (SELECT id, k AS step FROM t UNION ALL SELECT w.previous, p.step - 1 FROM p JOIN w ON w.id = p.id)
    SELECT step, id FROM p""")
def bfs_path(v):
    """From the smallest node to the one farthest from it."""
    edges = cut(v("viewgraph").select("src", "dst", "weight"))
    source = edges.agg(F.least(F.min("src"), F.min("dst"))).first()[0]
    far = graph.distances(edges, source).agg(F.max(F.struct("distance", (-F.col("id")).alias("i"))).alias("m")).first()["m"]
    return graph.shortest_path(edges, source, -far["i"])


@query("""RECURSIVE
    e AS (SELECT image_id1 AS a, image_id2 AS b FROM {sparse}),
    t AS (SELECT row_number() OVER (ORDER BY x.a, x.b, y.b) AS i, x.a, x.b, y.b AS c FROM e x JOIN e y ON x.b = y.a JOIN e z ON z.a = x.a AND z.b = y.b),
    s AS (SELECT i, unnest([a || '-' || b, a || '-' || c, b || '-' || c]) AS side FROM t),
    n AS (SELECT DISTINCT x.i, y.i AS j FROM s x JOIN s y ON x.side = y.side),
    r AS (SELECT i, i AS j FROM t UNION SELECT r.i, n.j FROM r JOIN n ON n.i = r.j),
    g AS (SELECT i, min(j) AS first FROM r GROUP BY i)
    SELECT t.a, t.b, t.c, f.a || '-' || f.b || '-' || f.c AS "group", count(*) OVER (PARTITION BY first) AS size FROM t JOIN g USING (i) JOIN t f ON f.i = g.first""")
def triangle_groups(v):
    return graph.triangle_groups(graph.triangles(_sparse(v)))


_TREE = "e AS (SELECT s_suppkey // 3 AS src, CAST(s_suppkey AS BIGINT) AS dst FROM {supplier} WHERE s_suppkey > 0)"


@query("RECURSIVE " + _TREE + """, u AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
    d AS (SELECT a AS s, a AS id, 0 AS k FROM (SELECT DISTINCT a FROM u) UNION SELECT s, b, k + 1 FROM d JOIN u ON d.id = u.a WHERE k < 20),
    x AS (SELECT s, max(k) AS far FROM (SELECT s, id, min(k) AS k FROM d GROUP BY s, id) GROUP BY s)
    SELECT s AS id FROM x ORDER BY far, s LIMIT 1""")
def tree_anchor(v):
    """What is left when leaves are peeled off: the centre of the tree."""
    key = F.col("s_suppkey")
    edges = v("supplier").filter("s_suppkey > 0").select(F.floor(key / 3).alias("src"), key.cast("long").alias("dst"))
    return graph.anchors(edges).select("id")


@query("""RECURSIVE
    e AS (SELECT c_custkey // 3 AS src, c_custkey AS dst, c_custkey * 7 %% 360 AS turn FROM {customer} WHERE c_custkey > 0),
    r AS (SELECT CAST(0 AS BIGINT) AS id, 0 AS distance, CAST(0 AS DOUBLE) AS turn UNION ALL SELECT e.dst, r.distance + 1, (r.turn + e.turn) %% 360 FROM r JOIN e ON e.src = r.id)
    SELECT id, distance, turn FROM r""".replace("%%", "%"))
def tree_paths(v):
    """A value composed along the paths of a tree."""
    key = F.col("c_custkey")
    edges = v("customer").filter("c_custkey > 0").select(F.floor(key / 3).alias("src"), key.alias("dst"), (key * 7 % 360).cast("double").alias("turn"))
    roots = v("customer").sparkSession.createDataFrame([(0,)], "id bigint")
    found = graph.composed(edges, roots, "turn", lambda a, b: F.pmod(a + b, F.lit(360.0)), lambda b: -b, F.lit(0.0))
    return found.select("id", "distance", "turn")


_ERROR = "abs((((%s + %s - %s + 180) %% 360) + 360) %% 360 - 180)"


@query("""--with
    g AS (SELECT *, (src + dst) % 5 = 0 AS fresh FROM {viewgraph}),
    t AS (SELECT a.src AS a, a.dst AS b, b.dst AS c, a.fresh AS fa, b.fresh AS fb, c.fresh AS fc FROM g a JOIN g b ON a.dst = b.src JOIN g c ON c.src = a.src AND c.dst = b.dst
          WHERE CAST(a.fresh AS INTEGER) + CAST(b.fresh AS INTEGER) + CAST(c.fresh AS INTEGER) = 1 AND abs((((a.turn + b.turn - c.turn + 180) % 360) + 360) % 360 - 180) < 1.2)
    SELECT src, dst, weight, turn FROM g WHERE fresh AND (src, dst) IN (SELECT (CASE WHEN fa THEN (a, b) WHEN fb THEN (b, c) ELSE (a, c) END) FROM t)""")
def closing_edges(v):
    """Candidates that close a wedge consistently."""
    edges = cut_packed(v("viewgraph"))
    error = lambda ab, ac, bc: np.abs((ab + bc - ac + 180) % 360 - 180)
    return graph.edges_that_close(edges.filter("(src + dst) % 5 > 0"), edges.filter("(src + dst) % 5 = 0"), "turn", error, 1.2)


@query("""--with
    x AS (SELECT least(src % 5, dst % 5) AS c1, greatest(src % 5, dst % 5) AS c2, src, dst, weight FROM {dense} WHERE src % 5 <> dst % 5)
    SELECT c1, c2, src, dst, weight, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY c1, c2 ORDER BY weight DESC, src, dst) AS rank FROM x) t WHERE rank <= 3""")
def component_pairs(v):
    labels = v("cameras").select(F.col("camera_id").alias("id"), (F.col("camera_id") % 5).alias("component"))
    return graph.component_pairs(v("dense"), labels, 3)


@query("""--with
    g AS (SELECT *, src % 2 = 0 AS known FROM {viewgraph}),
    x AS (SELECT *, row_number() OVER (PARTITION BY least(src % 5, dst % 5), greatest(src % 5, dst % 5) ORDER BY weight DESC, src, dst) AS k FROM g WHERE NOT known AND src % 5 <> dst % 5)
    SELECT src, dst, weight, turn FROM g WHERE known UNION ALL SELECT src, dst, weight, turn FROM x WHERE k <= 2
    UNION ALL SELECT src, dst, weight, turn FROM g WHERE NOT known AND src % 5 = dst % 5 AND abs((((dst * 7 - src * 7 - turn + 180) % 360) + 360) % 360 - 180) <= 0.6""")
def reinforced_graph(v):
    edges = cut(v("viewgraph"))
    nodes = graph.nodes_of(edges)
    labels, turns = nodes.select("id", (F.col("id") % 5).alias("component")), nodes.select("id", (F.col("id") * 7).cast("double").alias("turn"))
    return graph.reinforced(edges.filter("src % 2 = 0"), edges, turns, labels, 2, 0.6)


@query("""RECURSIVE
    u AS (SELECT image_id1 * 10000 + idx1 AS a, image_id2 * 10000 + idx2 AS b FROM {matches} UNION SELECT image_id2 * 10000 + idx2, image_id1 * 10000 + idx1 FROM {matches}),
    t AS (SELECT a AS id, a AS c FROM u UNION SELECT t.id, u.b FROM t JOIN u ON t.c = u.a),
    l AS (SELECT id, min(c) AS root FROM t GROUP BY id)
    SELECT root // 10000 AS first_image, root % 10000 AS first_idx, id // 10000 AS image_id, id % 10000 AS idx FROM l""")
def tracks_built(v):
    """Tracks of matched features; a track has one feature an image here."""
    found = tracks.build(matches_of(v).withColumnRenamed("matches", "inliers"))
    first = F.col("track")
    return found.select(F.floor(first / (1 << 32)).alias("first_image"), F.pmod(first, F.lit(1 << 32)).alias("first_idx"), "image_id", "idx")


# Cuts and clusters -----------------------------------------------------------------------

#: Groups of nodes, their edges, and all ways to cut each group in two.
_CUTS = """--with
    e AS (SELECT src // 9 AS g, src, dst, weight FROM {dense} WHERE src // 9 = dst // 9),
    n AS (SELECT g, id, row_number() OVER (PARTITION BY g ORDER BY id) - 1 AS p, count(*) OVER (PARTITION BY g) AS n FROM (SELECT g, src AS id FROM e UNION SELECT g, dst FROM e) t),
    s AS (SELECT g, n, unnest(range(1, CAST(1 AS BIGINT) << (n - 1))) * 2 AS side FROM (SELECT DISTINCT g, n FROM n) t WHERE n > 1),
    c AS (SELECT s.g, s.n, s.side, sum(CASE WHEN (side >> a.p) & 1 <> (side >> b.p) & 1 THEN weight ELSE 0 END) AS value FROM s JOIN e ON e.g = s.g JOIN n a ON a.g = e.g AND a.id = e.src JOIN n b ON b.g = e.g AND b.id = e.dst GROUP BY s.g, s.n, s.side)
"""


def _groups(v):
    group = F.floor(F.col("src") / 9)
    return v("dense").filter(group == F.floor(F.col("dst") / 9)).select(group.alias("group"), "src", "dst", "weight")


@query(_CUTS + 'SELECT g AS "group", CAST(min(value) AS DOUBLE) AS value FROM c GROUP BY g')
def min_cuts(v):
    """Against every way to cut each group."""
    return partition.min_cuts(_groups(v)).select("group", "value")


@query(_CUTS + 'SELECT g AS "group", CAST(min(value) AS DOUBLE) AS value FROM c WHERE (side >> (n - 1)) & 1 = 1 GROUP BY g')
def terminal_cuts(v):
    return partition.terminal_cuts(_groups(v)).select("group", "value")


def _labels(v):
    return v("cameras").select(F.col("camera_id").alias("id"), (F.col("camera_id") % 5).alias("label"))


_LOST = """--with
    l AS (SELECT camera_id AS id, camera_id % 5 AS label FROM {cameras}), i AS (SELECT src % 5 AS label, count(*) AS n FROM {dense} WHERE src % 5 = dst % 5 GROUP BY 1),
    x AS (SELECT least(src % 5, dst % 5) AS l1, greatest(src % 5, dst % 5) AS l2, src, dst, weight FROM {dense} WHERE src % 5 <> dst % 5)
"""


@query(_LOST + "SELECT l1, l2, src, dst, CAST(row_number() OVER (PARTITION BY l1, l2 ORDER BY weight DESC, src, dst) AS INTEGER) AS rank FROM x")
def boundary_edges(v):
    return partition.boundary_edges(partition.split_edges(v("dense"), _labels(v))[1]).select("l1", "l2", "src", "dst", "rank")


@query(_LOST + """, p AS (SELECT CASE WHEN coalesce(a.n, 0) <= coalesce(b.n, 0) THEN l1 ELSE l2 END AS label, src, dst FROM x LEFT JOIN i a ON a.label = l1 LEFT JOIN i b ON b.label = l2)
    SELECT label, src AS id FROM p UNION SELECT label, dst FROM p UNION SELECT label, id FROM l""")
def edges_expanded(v):
    inner, lost = partition.split_edges(v("dense"), _labels(v))
    return partition.expand_all(_labels(v), inner, lost)


@query(_LOST + """, o AS (SELECT l.label, x.dst AS id, weight FROM x JOIN l ON l.id = x.src UNION ALL SELECT l.label, x.src, weight FROM x JOIN l ON l.id = x.dst),
    m AS (SELECT label, id, max(weight) AS weight FROM o GROUP BY label, id)
    SELECT label, id, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY weight DESC, id) AS rank FROM m) t WHERE rank <= 3""")
def overlap_images(v):
    return views.overlap_images(v("dense"), _labels(v), 3).select("label", "id", "rank")


_MEMBERS = "m AS (SELECT image_id % 7 AS label, image_id AS id FROM {images} UNION SELECT image_id % 5, image_id FROM {images} WHERE image_id % 3 = 0)"


def _members(v):
    first = v("images").select((F.col("image_id") % 7).alias("label"), F.col("image_id").alias("id"))
    return first.unionByName(v("images").filter("image_id % 3 = 0").select((F.col("image_id") % 5).alias("label"), F.col("image_id").alias("id"))).distinct()


@query("--with\n" + _MEMBERS + " SELECT label, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, label) - 1 AS position FROM m GROUP BY label")
def dispatch_order(v):
    return partition.dispatch_order(_members(v))


@query("--with\n" + _MEMBERS + " SELECT i.image_id, c.cluster_id FROM {images} i LEFT JOIN (SELECT id, min(label) AS cluster_id FROM m WHERE label > 2 GROUP BY id) c ON c.id = i.image_id")
def images_labelled(v):
    return partition.with_clusters(v("images").select("image_id"), _members(v).filter("label > 2"))


@query("--with\n" + _MEMBERS + """ SELECT count(DISTINCT label) AS clusters, (SELECT count(*) FROM {images}) AS nodes, (SELECT count(*) FROM {sparse}) AS edges, round(count(*) / CAST((SELECT count(*) FROM {images}) AS DOUBLE), 6) AS inflation,
    round(1 - (SELECT count(*) FROM {sparse} WHERE image_id1 % 7 = image_id2 % 7) / CAST((SELECT count(*) FROM {sparse}) AS DOUBLE), 6) AS edge_loss FROM m""")
def clustering_summary(v):
    edges = _sparse(v)
    return partition.summary(v("images"), edges, _members(v), edges.filter("src % 7 = dst % 7"))


@query("SELECT * FROM (VALUES ('ncut', 'NCUT'), ('KMeans', 'KMEANS'), ('SPECTRA', 'SPECTRAL'), ('hybrid', 'HYBRID'), ('community', 'COMMUNITY_DETECTION'), ('other', 'NCUT')) t(name, method)")
def cluster_methods(v):
    names = ("ncut", "KMeans", "SPECTRA", "hybrid", "community", "other")
    return v("region").sparkSession.createDataFrame([(n, partition.method(n)) for n in names], "name string, method string")


_NODES = "(SELECT src AS id FROM {dense} UNION SELECT dst FROM {dense}) n"


def _checked(found, most: int):
    """Each node: how often it is held, and whether a cluster of it is too large."""
    sizes = found.groupBy("label").agg(F.count("*").alias("n"))
    return found.join(sizes, "label").groupBy("id").agg(F.count("*").alias("held"), F.max((F.col("n") > most).cast("int")).alias("too_large"))


@query(f"SELECT id, CAST(1 AS BIGINT) AS held, 0 AS too_large FROM {_NODES}")
def clusters(v):
    """Every node is in one cluster, none is much larger than asked for."""
    return _checked(partition.assign(v("dense"), 20), 45)


@query("SELECT * FROM (VALUES ('COMMUNITY_DETECTION'), ('HYBRID'), ('KMEANS'), ('NCUT'), ('SPECTRAL')) t(method), (SELECT count(*) AS nodes, count(*) AS held FROM " + _NODES + ") c")
def clusters_by_method(v):
    """Whatever the method, every node is held once."""
    out = None
    for name in partition.METHODS:
        found = partition.assign(v("dense"), 20, name).agg(F.lit(name).alias("method"), F.countDistinct("id").alias("nodes"), F.count("*").alias("held"))
        out = found if out is None else out.unionByName(found)
    return out


@query(f"SELECT id, CAST(1 AS BIGINT) AS homes, true AS at_boundary FROM {_NODES}")
def clusters_expanded(v):
    """Every node keeps one home, and is added only to clusters it has lost edges to."""
    labels = cut(partition.assign(v("dense"), 20))
    _, lost = partition.split_edges(v("dense"), labels)
    found = cut(partition.expand(labels, lost, completeness=0.5, overlap=10))
    ends = lost.select("src", "dst", F.explode(F.array("l1", "l2")).alias("label"))
    near = ends.select("label", F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("near", F.lit(True))
    rows = found.join(near, ["label", "id"], "left")
    return rows.groupBy("id").agg(F.sum((~F.col("added")).cast("int")).alias("homes"), F.min(F.coalesce("near", F.lit(False)) | ~F.col("added")).alias("at_boundary"))


@query(f"SELECT id, true AS held, 0 AS too_large FROM {_NODES}")
def clusters_regrouped(v):
    """After cutting, expanding and regrouping no cluster is above its relaxed bound."""
    found = cut(partition.cut_and_expand(v("dense"), 20, relax=1.3, completeness=0.3))
    return _checked(found, 26).select("id", (F.col("held") > 0).alias("held"), "too_large")


@query(f"SELECT id, CAST(1 AS BIGINT) AS homes, 0 AS too_large FROM {_NODES}")
def cluster_tree(v):
    """Leaves of the tree cover every node once and respect their bound."""
    found = cut(partition.hierarchy(v("dense"), 20, overlap=3))
    sizes = found.filter("NOT added").groupBy("label").agg(F.count("*").alias("n"))
    rows = found.filter("NOT added").join(sizes, "label")
    return rows.groupBy("id").agg(F.count("*").alias("homes"), F.max((F.col("n") > 20).cast("int")).alias("too_large"))


_PAIRS = "list_sum(list_transform(range(1, 65), lambda i: CAST(a.embedding[i] AS DOUBLE) * b.embedding[i]))"


@query(f"""--with
    p AS (SELECT a.vec_id AS a, b.vec_id AS b, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_PAIRS} DESC, b.vec_id) AS k FROM {{embeddings}} a JOIN {{embeddings}} b ON a.vec_id % 2 = 0 AND b.vec_id % 2 = 1 AND a.label % 5 = b.label % 5)
    SELECT a % 7 AS pair, CAST(0 AS BIGINT) AS repeated, CAST(0 AS BIGINT) AS unused FROM p WHERE k <= 3 GROUP BY 1""")
def one_to_one(v):
    """No feature is matched twice, and no candidate is left whose features are both free."""
    from skein.operators import retrieval

    a = v("embeddings").filter("vec_id % 2 = 0").select(F.col("vec_id").alias("a"), F.col("embedding").alias("q"), (F.col("label") % 5).alias("k"))
    b = v("embeddings").filter("vec_id % 2 = 1").select(F.col("vec_id").alias("b"), F.col("embedding").alias("w"), (F.col("label") % 5).alias("k"))
    rows = a.join(b, "k").select("a", "b", retrieval.dot(F.col("q"), F.col("w")).alias("score")).withColumn("pair", (F.col("a") % 7).cast("long"))
    order = Window.partitionBy("a").orderBy(F.desc("score"), "b")
    few = cut(rows.withColumn("k", F.row_number().over(order)).filter("k <= 3").select("pair", "a", "b", "score"))
    found = cut(views.one_to_one(few, ["pair"]))
    twice = found.groupBy("pair").agg((2 * F.count("*") - F.countDistinct("a") - F.countDistinct("b")).alias("repeated"))
    free = few.join(found.select("pair", "a"), ["pair", "a"], "left_anti").join(found.select("pair", "b"), ["pair", "b"], "left_anti").groupBy("pair").agg(F.count("*").alias("unused"))
    return twice.join(free, "pair", "left").select("pair", "repeated", F.coalesce("unused", F.lit(0)).cast("long").alias("unused"))
