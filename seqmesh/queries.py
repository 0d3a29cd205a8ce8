"""The registered queries of the sequence-graph operators over the driver's tables, with their SQL oracles.

``embeddings`` stand in for sequences: the signs of a vector are a string of 64 letters 0 and 1.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqmesh.functions.distance import block_owner, capped, initial_distance, leading_int, vertex_name
from seqmesh.operators import components, graph, medoids, pairs, paths, sparse_paths, strip_medoids
from seqmesh.operators.order import numbered
from seqmesh.plans.pipeline import cluster_sequences
from seqmesh.session import materialise, scratch, ship, table
from seqmesh.sources import clustering, dot, fasta, formats, matrix, text

#: Thresholds on sign strings: a connected graph, one with isolated vertices, many small components, and few close pairs.
NEAR, SPARSE, THIN, CLOSE = 26, 22, 20, 16
INIT = [0, 1, 2, 3]
#: Equal sign strings are adjacent in the paths of embeddings, as in their SQL.
ZERO = "edge"


def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    sign = F.array_join(F.transform("embedding", lambda x: F.when(x > 0, "1").otherwise("0")), "")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("idx"), sign.alias("seq"))


def _edges(spark: SparkSession, sf_dir: str, epsilon: int) -> DataFrame:
    return materialise(pairs.threshold_graph(signatures(spark, sf_dir), epsilon, "01"), "edges")


def _vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("idx"))


def _paths(spark: SparkSession, sf_dir: str, epsilon: int) -> DataFrame:
    return paths.shortest_paths(_vertices(spark, sf_dir), _edges(spark, sf_dir, epsilon), zero_weight=ZERO)


def signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signatures(spark, sf_dir)


def hamming_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.pairwise_hamming(signatures(spark, sf_dir), "01")


def hamming_pairs_any_alphabet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.pairwise_hamming(signatures(spark, sf_dir), None)


def hamming_pairs_by_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.pairwise_hamming(signatures(spark, sf_dir), "01", broadcast_bytes=8192)


def hamming_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming_pairs(spark, sf_dir).groupBy("d").agg(F.count(F.lit(1)).alias("n"))


def threshold_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.threshold_graph(signatures(spark, sf_dir), NEAR, "01")


def threshold_edges_by_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs below a small threshold, from those that have one of its segments in common."""
    return pairs.threshold_graph(signatures(spark, sf_dir), CLOSE, "01", "segments")


def segment_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pairs the segment join compares for each of three thresholds."""
    held = signatures(spark, sf_dir)
    return spark.createDataFrame([(b, pairs.segment_candidates(held, b)) for b in (4, CLOSE, SPARSE)], "below int, candidates long")


def symmetric_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    # pairs are compared for each direction: writing the edges down first takes half as much room again
    return graph.symmetrised(threshold_edges(spark, sf_dir))


def vertex_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(_vertices(spark, sf_dir), _edges(spark, sf_dir, NEAR))


def isolated_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.isolated(_vertices(spark, sf_dir), _edges(spark, sf_dir, SPARSE))


def initial_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ordered pair of nations with its initial distance in the trade graph; weight 0 and loops included."""
    trade = _trade(spark, sf_dir)
    ends = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("i"))
    every = ends.join(ends.withColumnRenamed("i", "j"), F.lit(True))
    known = every.join(graph.symmetrised(trade).withColumnsRenamed({"src": "i", "dst": "j"}), ["i", "j"], "left")
    return known.select("i", "j", initial_distance(F.col("i"), F.col("j"), F.col("weight")).alias("d"))


def _trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as a graph: for each unordered pair the last line item in order of key and number between customer and
    supplier, its quantity less ten, at least 0, as weight; pairs of a nation with itself included."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    joined = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"]).join(s, li["l_suppkey"] == s["s_suppkey"])
    ends = joined.select(F.col("c_nationkey").cast("long").alias("src"), F.col("s_nationkey").cast("long").alias("dst"), F.greatest(F.col("l_quantity").cast("int") - 10, F.lit(0)).alias("weight"), "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return graph.last_wins(ends, ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"])


def parallel_edge_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trade(spark, sf_dir)


def nation_graph_apsp(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("idx"))
    return paths.shortest_paths(nations, materialise(_trade(spark, sf_dir), "trade"), "relational")


def min_plus_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _edges(spark, sf_dir, SPARSE)
    both = graph.symmetrised(d).withColumnsRenamed({"src": "i", "dst": "j", "weight": "d"})
    return paths.min_plus(both, both)


def apsp_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir, NEAR)


def apsp_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paths of the near graph on tiles of 128 x 128, closed by halves."""
    return paths.shortest_paths(_vertices(spark, sf_dir), _edges(spark, sf_dir, NEAR), "tiles", ZERO, side=128)


def apsp_reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paths of the sparse graph by component, pairs with a path alone."""
    return sparse_paths.reachable(_vertices(spark, sf_dir), _edges(spark, sf_dir, SPARSE), ZERO)


def apsp_delta_stepping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paths of a thinner graph by delta stepping from every vertex."""
    return sparse_paths.delta_stepping(_vertices(spark, sf_dir), graph.usable(_edges(spark, sf_dir, THIN), ZERO), 80)


def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.components(_vertices(spark, sf_dir), _edges(spark, sf_dir, SPARSE))


def apsp_unreachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _paths(spark, sf_dir, SPARSE)
    return found.select("i", "j", F.coalesce("d", F.lit(paths.INF)).alias("d"), capped(F.col("d"), medoids.CAP).alias("capped"))


def vertex_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers numbered in order of market segment, then key."""
    c = table(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey")
    return numbered(c, ["c_mktsegment", "c_custkey"])


def weight_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.concat(F.lit(" "), F.format_string("%.2f", "p_retailprice"))
    return table(spark, sf_dir, "part").select("p_partkey", leading_int(price, F.col("p_name")).alias("weight"))


def block_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The owner of each block of 32 parts x 32 suppliers on a grid of 2 x 3."""
    bi = table(spark, sf_dir, "part").select(F.expr("p_partkey div 32").alias("bi")).distinct()
    bj = table(spark, sf_dir, "supplier").select(F.expr("s_suppkey div 32").alias("bj")).distinct()
    return bi.join(bj, F.lit(True)).select("bi", "bj", block_owner(F.col("bi"), F.col("bj"), 2, 3).alias("owner"))


def sequence_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signatures(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.min(F.length("seq")).alias("shortest"), F.max(F.length("seq")).alias("longest"))


def dot_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dot.dot_lines(_vertices(spark, sf_dir), threshold_edges(spark, sf_dir))


def dot_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near graph written as a DOT file and read again."""
    path = f"{scratch(spark)}/graph-{uuid.uuid4().hex[:8]}.dot"
    # the edges are read once, by the sort of the writer, which writes them down itself
    dot.write_dot(_vertices(spark, sf_dir), threshold_edges(spark, sf_dir), path)
    vertices, edges = dot.read_dot(spark, path)
    return dot.named(edges, vertices, ("src", "dst"), ("a", "b"), "idx").select("src", "dst", "weight", "a", "b")


def dot_one_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near graph with quoted names that hold signs of the language, all on one line, read again."""
    path = f"{scratch(spark)}/line-{uuid.uuid4().hex[:8]}.dot"
    name = lambda c: F.concat(F.lit('"v; '), F.col(c).cast("string"), F.lit(' -- [x]"'))
    edge = F.concat(name("src"), F.lit(" -- "), name("dst"), F.lit(" [weight="), F.col("weight").cast("string"), F.lit("];"))
    text.write_ordered(threshold_edges(spark, sf_dir), path, ["src", "dst"], ["graph {"], ["}"], edge, " ")
    vertices, edges = dot.read_dot(spark, path)
    return dot.named(edges, vertices, ("src", "dst"), ("a", "b"), "idx").select("a", "b", "weight")


def dot_subgraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers in a subgraph for each nation, with a default of its own, and edges from whole subgraphs to regions, read again."""
    path = f"{scratch(spark)}/nested-{uuid.uuid4().hex[:8]}.dot"
    n = F.col("n_nationkey").cast("string")
    held = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    place = [F.col("n_nationkey").alias("nation"), F.col("s_suppkey").alias("supplier")]
    rows = held.select(F.lit(1).alias("kind"), *place, F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit(" -- hub"), n).alias("line"))
    once = held.select("n_nationkey", "n_regionkey").distinct().withColumn("s_suppkey", F.lit(0).cast("long"))
    opened = once.select(F.lit(0).alias("kind"), *place, F.concat(F.lit('subgraph "of '), n, F.lit('" {\nedge [weight='), F.col("n_nationkey") + 1, F.lit("]")).alias("line"))
    closed = once.select(F.lit(2).alias("kind"), *place, F.concat(F.lit("}\nsubgraph /* all\nof it */ \"of "), n, F.lit('" -- r'), F.col("n_regionkey"), F.lit("\n[weight=100]")).alias("line"))
    text.write_ordered(opened.unionByName(rows).unionByName(closed), path, ["nation", "kind", "supplier"], ["graph nested {"], ["}"])
    vertices, edges = dot.read_dot(spark, path)
    a, b = (vertices.withColumnsRenamed({"idx": i, "name": n}) for i, n in (("src", "a"), ("dst", "b")))
    return edges.join(a, "src").join(b, "dst").select("a", "b", "weight")


def matrix_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.matrix_lines(_paths(spark, sf_dir, SPARSE))


def matrix_strip_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the matrix file from binary strips."""
    return matrix.strip_lines(paths.path_strips(_vertices(spark, sf_dir), _edges(spark, sf_dir, SPARSE), ZERO))


def matrix_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch(spark)}/matrix-{uuid.uuid4().hex[:8]}.txt"
    matrix.write_matrix(_paths(spark, sf_dir, SPARSE), path)
    return matrix.read_matrix(spark, path)


def matrix_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix file read as a data source, in ranges of 64 KB."""
    path = f"{scratch(spark)}/matrix-{uuid.uuid4().hex[:8]}.txt"
    matrix.write_strips(paths.path_strips(_vertices(spark, sf_dir), _edges(spark, sf_dir, SPARSE), ZERO), path)
    formats.register(spark)
    return matrix.of_words(formats.ordered(spark.read.format("distmatrix").option("splitBytes", 1 << 16).load(path), "at"))


def fasta_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sign strings written as a FASTA file and read as a data source, in ranges of 4 KB."""
    path = f"{scratch(spark)}/signs-{uuid.uuid4().hex[:8]}.fa"
    fasta.write_fasta(signatures(spark, sf_dir).withColumn("header", vertex_name(F.col("idx"))), path, 30)
    formats.register(spark)
    return formats.ordered(spark.read.format("fasta").option("splitBytes", 1 << 12).load(path)).select("idx", "header", "seq")


def fasta_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sign strings written as a FASTA file and read again."""
    path = f"{scratch(spark)}/signs-{uuid.uuid4().hex[:8]}.fa"
    fasta.write_fasta(signatures(spark, sf_dir).withColumn("header", vertex_name(F.col("idx"))), path, 30)
    return fasta.read_fasta(spark, path)


def pam_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return medoids.assign(_paths(spark, sf_dir, SPARSE), INIT)


def pam_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pam_assign(spark, sf_dir).agg(F.sum(F.col("dist").cast("long")).alias("total_cost"))


def pam_assign_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assignment to the initial medoids with the names of vertices and medoids."""
    names = _vertices(spark, sf_dir).withColumn("name", vertex_name(F.col("idx")))
    return medoids.decoded(pam_assign(spark, sf_dir), names)


def pam_random_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search from medoids drawn by seed 5."""
    found = medoids.k_medoids(_paths(spark, sf_dir, NEAR), 4, seed=5)
    return spark.createDataFrame([(m, v, found.total_cost) for m, v in enumerate(found.medoids)], "slot int, medoid long, total_cost long")


def pam_swap_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cost of every swap from the initial medoids."""
    costs = medoids.swap_costs(materialise(_paths(spark, sf_dir, NEAR), "distances"), INIT, n=_vertices(spark, sf_dir).count())
    return costs.select("h", F.posexplode(F.array(*[F.col(f"c{m}") for m in range(len(INIT))])).alias("slot", "cost"))


def pam_strip_swap_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cost of every swap from the initial medoids, from binary strips."""
    costs = strip_medoids.swap_costs(paths.path_strips(_vertices(spark, sf_dir), _edges(spark, sf_dir, NEAR), ZERO), INIT)
    return costs.select("h", F.posexplode("costs").alias("slot", "cost"))


def pam_strip_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pass of the search on binary strips: its medoids and their cost."""
    found = strip_medoids.k_medoids(paths.path_strips(_vertices(spark, sf_dir), _edges(spark, sf_dir, NEAR), ZERO), 4, INIT)
    rows = [(p, slot, m, cost) for p, (med, cost) in enumerate(found.history) for slot, m in enumerate(med)]
    return spark.createDataFrame(rows, "pass int, slot int, medoid long, cost long")


def pam_best_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    cost, slot, h = medoids.best_swap(materialise(_paths(spark, sf_dir, NEAR), "distances"), INIT, n=_vertices(spark, sf_dir).count())
    return spark.createDataFrame([(cost, slot, h)], "cost long, slot int, h long")


def pam_medoids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = medoids.k_medoids(_paths(spark, sf_dir, NEAR), 4, INIT)
    return spark.createDataFrame([(m, v, found.total_cost) for m, v in enumerate(found.medoids)], "slot int, medoid long, total_cost long")


def sequence_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: sign strings to graph to paths to clusters."""
    return cluster_sequences(signatures(spark, sf_dir), NEAR, 4, INIT, zero_weight=ZERO, alphabet="01").clustering.assignment


def pam_cluster_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return medoids.summary(sequence_pipeline(spark, sf_dir))


def pam_result_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch(spark)}/clusters-{uuid.uuid4().hex[:8]}.txt"
    found = cluster_sequences(signatures(spark, sf_dir), NEAR, 4, INIT, zero_weight=ZERO, alphabet="01").clustering
    clustering.write_clustering(found, path)
    return clustering.read_clustering(spark, path)[1]


_SIG = "SELECT vec_id AS idx, array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS seq FROM embeddings"
_S = f"s AS ({_SIG}), p AS (SELECT a.idx AS i, b.idx AS j, hamming(a.seq, b.seq)::INT AS d FROM s a JOIN s b ON a.idx < b.idx)"


def _e(epsilon: int) -> str:
    return f"{_S}, e AS (SELECT i AS src, j AS dst, d AS weight FROM p WHERE d < {epsilon}), b AS (SELECT * FROM e UNION ALL SELECT dst, src, weight FROM e), v AS (SELECT vec_id AS idx FROM embeddings)"


def _closure(vertices: str, both: str) -> str:
    """Tables d0 (reachable pairs) and dist (all pairs), from tables of vertices and of edges both ways."""
    return f"""d0(s, t, w) USING KEY (s, t) AS (
      SELECT idx, idx, 0::BIGINT FROM {vertices} UNION ALL SELECT src, dst, weight::BIGINT FROM {both}
    UNION
      SELECT d0.s, b2.dst, min(d0.w + b2.weight) AS w FROM d0 JOIN {both} b2 ON d0.t = b2.src
      LEFT JOIN recurring.d0 r ON r.s = d0.s AND r.t = b2.dst
      WHERE r.w IS NULL OR d0.w + b2.weight < r.w GROUP BY d0.s, b2.dst),
    dist AS (SELECT x.idx AS i, y.idx AS j, d0.w::INT AS d FROM {vertices} x CROSS JOIN {vertices} y LEFT JOIN d0 ON d0.s = x.idx AND d0.t = y.idx)"""


def _all(epsilon: int) -> str:
    return f"WITH RECURSIVE {_e(epsilon)}, {_closure('v', 'b')}"


_TRADE = """t AS (
  SELECT c_nationkey::BIGINT AS a, s_nationkey::BIGINT AS b, greatest(trunc(l_quantity)::INT - 10, 0) AS weight, l_orderkey, l_linenumber, l_partkey, l_extendedprice
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey),
last AS (SELECT least(a, b) AS src, greatest(a, b) AS dst, weight, row_number() OVER (PARTITION BY least(a, b), greatest(a, b)
  ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_extendedprice DESC, weight DESC) AS k FROM t),
trade AS (SELECT src, dst, weight FROM last WHERE k = 1),
trade2 AS (SELECT * FROM trade UNION ALL SELECT dst, src, weight FROM trade WHERE src <> dst),
nations AS (SELECT n_nationkey::BIGINT AS idx FROM nation)"""

_ASSIGN = """m(slot, medoid) AS (VALUES (0, 0::BIGINT), (1, 1::BIGINT), (2, 2::BIGINT), (3, 3::BIGINT)),
c AS (SELECT i, slot, medoid, least(coalesce(d, 100000), 100000) AS d, row_number() OVER (PARTITION BY i ORDER BY least(coalesce(d, 100000), 100000), slot) AS k FROM dist JOIN m ON j = medoid)"""

_SWAPS = f"""{_ASSIGN},
swaps AS (SELECT h.idx AS h, x.slot, sum(z.d)::BIGINT AS cost
  FROM v h CROSS JOIN (SELECT slot FROM m) x
  JOIN (SELECT g.h, g.slot, g.i, min(g.d) AS d FROM (
      SELECT dist.j AS h, x.slot, dist.i, least(coalesce(dist.d, 100000), 100000) AS d FROM dist CROSS JOIN (SELECT slot FROM m) x
      UNION ALL
      SELECT h.idx, x.slot, c.i, min(c.d) FROM v h CROSS JOIN (SELECT slot FROM m) x JOIN c ON c.slot <> x.slot GROUP BY ALL) g GROUP BY ALL) z
    ON z.h = h.idx AND z.slot = x.slot
  WHERE h.idx NOT IN (SELECT medoid FROM m) GROUP BY ALL)"""

_DRAWN = "drawn AS (SELECT idx, row_number() OVER (ORDER BY md5('5:' || idx), idx) AS k FROM v QUALIFY k <= 4)"

# Passes of the search: the state is the list of medoids; a candidate's cost is the sum over vertices of the least
# distance to the list with one slot replaced.
_SEARCH = """search(pass, med, cost) AS (
  SELECT 0, [0::BIGINT, 1::BIGINT, 2::BIGINT, 3::BIGINT],
         (SELECT sum(d)::BIGINT FROM (SELECT min(least(coalesce(d, 100000), 100000)) AS d FROM dist WHERE j IN (0, 1, 2, 3) GROUP BY i))
UNION ALL
  SELECT pass + 1, [CASE WHEN slot = x.s THEN h ELSE med[x.s + 1] END FOR x IN [{'s': 0}, {'s': 1}, {'s': 2}, {'s': 3}]], cost
  FROM (
    SELECT pass, med, slot, h, cost, before, row_number() OVER (ORDER BY cost, slot, h) AS k
    FROM (
      SELECT q.pass, q.med, q.before, q.slot, dd.j AS h, sum(least(coalesce(dd.d, 100000), 100000, q.rest))::BIGINT AS cost
      FROM (
        SELECT s.pass, s.med, s.cost AS before, x.slot, r.i, min(CASE WHEN r.j = s.med[x.slot + 1] THEN 100000 ELSE least(coalesce(r.d, 100000), 100000) END) AS rest
        FROM search s CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS slot) x JOIN dist r ON list_contains(s.med, r.j)
        GROUP BY ALL) q
      JOIN dist dd ON dd.i = q.i AND NOT list_contains(q.med, dd.j)
      GROUP BY ALL))
  WHERE k = 1 AND cost < before),
final AS (SELECT med, cost FROM search ORDER BY pass DESC LIMIT 1),
slots AS (SELECT unnest([0, 1, 2, 3]) AS slot, unnest(med) AS medoid, cost FROM final)"""

_RANDOM = _SEARCH.replace("[0::BIGINT, 1::BIGINT, 2::BIGINT, 3::BIGINT]", "(SELECT list(idx ORDER BY k) FROM drawn)").replace("j IN (0, 1, 2, 3)", "j IN (SELECT idx FROM drawn)")

_CLUSTERS = """nearest AS (SELECT i AS vertex, slot::INT AS cluster, medoid, least(coalesce(d, 100000), 100000)::INT AS dist,
  row_number() OVER (PARTITION BY i ORDER BY least(coalesce(d, 100000), 100000), slot) AS k FROM dist JOIN slots ON j = medoid)"""

_PIPELINE = f"{_all(NEAR)}, {_SEARCH}, {_CLUSTERS} SELECT vertex, cluster, medoid, dist FROM nearest WHERE k = 1"

QUERIES = {
    f.__name__: f
    for f in (
        signature, hamming_pairs, hamming_pairs_any_alphabet, hamming_pairs_by_blocks, hamming_histogram, threshold_edges, threshold_edges_by_segments, segment_candidates, symmetric_edges,
        vertex_degree, isolated_vertices, initial_distances, parallel_edge_last_wins, nation_graph_apsp, min_plus_product, apsp_small, apsp_tiles, apsp_reachable, apsp_delta_stepping, graph_components,
        apsp_unreachable, vertex_numbering, weight_parse, block_ownership, sequence_sizes, dot_lines, dot_roundtrip, dot_one_line, dot_subgraphs, matrix_lines, matrix_strip_lines,
        matrix_roundtrip, matrix_source, fasta_roundtrip, fasta_source, pam_assign, pam_assign_named, pam_cost, pam_swap_costs, pam_strip_swap_costs, pam_strip_passes, pam_best_swap, pam_medoids, pam_random_start, sequence_pipeline,
        pam_cluster_summary, pam_result_roundtrip,
    )
}

ORACLES = {
    "signature": _SIG,
    "hamming_pairs": f"WITH {_S} SELECT i, j, d FROM p",
    "hamming_pairs_any_alphabet": f"WITH {_S} SELECT i, j, d FROM p",
    "hamming_pairs_by_blocks": f"WITH {_S} SELECT i, j, d FROM p",
    "hamming_histogram": f"WITH {_S} SELECT d, count(*) AS n FROM p GROUP BY d",
    "threshold_edges": f"WITH {_e(NEAR)} SELECT src, dst, weight FROM e",
    "threshold_edges_by_segments": f"WITH {_e(CLOSE)} SELECT src, dst, weight FROM e",
    "segment_candidates": f"""WITH s AS ({_SIG}), b(below) AS (VALUES (4), ({CLOSE}), ({SPARSE})),
      cut AS (SELECT below, k, substr(seq, k * 64 // below + 1, (k + 1) * 64 // below - k * 64 // below) AS key FROM s, b, LATERAL (SELECT unnest(range(below)) AS k))
      SELECT below, sum(c * (c - 1) // 2)::BIGINT AS candidates FROM (SELECT below, k, key, count(*) AS c FROM cut GROUP BY ALL) GROUP BY below""",
    "symmetric_edges": f"WITH {_e(NEAR)} SELECT src, dst, weight FROM b",
    "vertex_degree": f"WITH {_e(NEAR)} SELECT idx, count(b.src) AS degree FROM v LEFT JOIN b ON b.src = v.idx GROUP BY idx",
    "isolated_vertices": f"WITH {_e(SPARSE)} SELECT idx FROM v WHERE idx NOT IN (SELECT src FROM b)",
    "initial_distances": f"WITH {_TRADE} SELECT x.idx AS i, y.idx AS j, CASE WHEN x.idx = y.idx THEN 0 WHEN weight = 0 THEN NULL ELSE weight END::INT AS d FROM nations x CROSS JOIN nations y LEFT JOIN trade2 ON src = x.idx AND dst = y.idx",
    "parallel_edge_last_wins": f"WITH {_TRADE} SELECT src, dst, weight FROM trade",
    "nation_graph_apsp": f"WITH RECURSIVE {_TRADE}, tb AS (SELECT * FROM trade2 WHERE weight > 0 AND src <> dst), {_closure('nations', 'tb')} SELECT i, j, d FROM dist",
    "min_plus_product": f"WITH {_e(SPARSE)} SELECT x.src AS i, y.dst AS j, min(x.weight + y.weight)::INT AS d FROM b x JOIN b y ON x.dst = y.src GROUP BY ALL",
    "apsp_small": f"{_all(NEAR)} SELECT i, j, d FROM dist",
    "apsp_tiles": f"{_all(NEAR)} SELECT i, j, d FROM dist",
    "apsp_reachable": f"{_all(SPARSE)} SELECT i, j, d FROM dist WHERE d IS NOT NULL",
    "apsp_delta_stepping": f"{_all(THIN)} SELECT i, j, d FROM dist WHERE d IS NOT NULL",
    "graph_components": f"{_all(SPARSE)} SELECT i AS idx, min(j) AS component FROM dist WHERE d IS NOT NULL GROUP BY i",
    "apsp_unreachable": f"{_all(SPARSE)} SELECT i, j, coalesce(d, 1000000000) AS d, least(coalesce(d, 100000), 100000) AS capped FROM dist",
    "vertex_numbering": "SELECT c_mktsegment, c_custkey, row_number() OVER (ORDER BY c_mktsegment, c_custkey) - 1 AS idx FROM customer",
    "weight_parse": "SELECT p_partkey, trunc(round(p_retailprice, 2))::INT AS weight FROM part",
    "block_ownership": "SELECT bi, bj, bi % 2 * 3 + bj % 3 AS owner FROM (SELECT DISTINCT p_partkey // 32 AS bi FROM part) CROSS JOIN (SELECT DISTINCT s_suppkey // 32 AS bj FROM supplier)",
    "sequence_sizes": f"SELECT count(*) AS n, min(length(seq))::INT AS shortest, max(length(seq))::INT AS longest FROM ({_SIG})",
    "dot_lines": f"""WITH {_e(NEAR)} SELECT 0 AS kind, idx AS i, -1::BIGINT AS j, '    A' || (idx + 1) || ' [label="' || idx || '"];' AS line FROM v
      UNION ALL SELECT 2, src, dst, '    A' || (src + 1) || ' -- A' || (dst + 1) || ' [label="' || weight || '", weight=' || weight || '];' FROM e""",
    "dot_roundtrip": f"WITH {_e(NEAR)} SELECT src, dst, weight, 'A' || (src + 1) AS a, 'A' || (dst + 1) AS b FROM e",
    "dot_one_line": f"""WITH {_e(NEAR)} SELECT 'v; ' || src || ' -- [x]' AS a, 'v; ' || dst || ' -- [x]' AS b, weight FROM e""",
    "dot_subgraphs": """WITH s AS (SELECT 's' || s_suppkey AS supplier, 'hub' || n_nationkey AS hub, 'r' || n_regionkey AS region, (n_nationkey + 1)::INT AS w FROM supplier JOIN nation ON s_nationkey = n_nationkey)
      SELECT supplier AS a, hub AS b, w AS weight FROM s UNION ALL SELECT supplier, region, 100 FROM s UNION ALL SELECT DISTINCT hub, region, 100 FROM s""",
    "matrix_lines": f"{_all(SPARSE)} SELECT i, string_agg(CASE WHEN length(t) < 5 THEN lpad(t, 5, ' ') ELSE t END || ' ', '' ORDER BY j) AS line FROM (SELECT i, j, coalesce(d, 1000000000)::VARCHAR AS t FROM dist) GROUP BY i",
    "matrix_strip_lines": f"{_all(SPARSE)} SELECT i, string_agg(CASE WHEN length(t) < 5 THEN lpad(t, 5, ' ') ELSE t END || ' ', '' ORDER BY j) AS line FROM (SELECT i, j, coalesce(d, 1000000000)::VARCHAR AS t FROM dist) GROUP BY i",
    "matrix_roundtrip": f"{_all(SPARSE)} SELECT i, j, d FROM dist",
    "matrix_source": f"{_all(SPARSE)} SELECT i, j, d FROM dist",
    "fasta_source": f"SELECT idx, 'A' || (idx + 1) AS header, seq FROM ({_SIG})",
    "fasta_roundtrip": f"SELECT idx, 'A' || (idx + 1) AS header, seq FROM ({_SIG})",
    "pam_assign": f"{_all(SPARSE)}, {_ASSIGN} SELECT i AS vertex, slot AS cluster, medoid, d AS dist FROM c WHERE k = 1",
    "pam_assign_named": f"{_all(SPARSE)}, {_ASSIGN} SELECT i AS vertex, slot AS cluster, medoid, d AS dist, 'A' || (i + 1) AS vertex_name, 'A' || (medoid + 1) AS medoid_name FROM c WHERE k = 1",
    "pam_cost": f"{_all(SPARSE)}, {_ASSIGN} SELECT sum(d)::BIGINT AS total_cost FROM c WHERE k = 1",
    "pam_swap_costs": f"{_all(NEAR)}, {_SWAPS} SELECT h, slot, cost FROM swaps",
    "pam_strip_swap_costs": f"{_all(NEAR)}, {_SWAPS} SELECT h, slot, cost FROM swaps",
    "pam_strip_passes": f"{_all(NEAR)}, {_SEARCH} SELECT pass, unnest([0, 1, 2, 3]) AS slot, unnest(med) AS medoid, cost FROM search",
    "pam_best_swap": f"{_all(NEAR)}, {_SWAPS} SELECT cost, slot, h FROM swaps ORDER BY cost, slot, h LIMIT 1",
    "pam_medoids": f"{_all(NEAR)}, {_SEARCH} SELECT slot, medoid, cost AS total_cost FROM slots",
    "pam_random_start": f"{_all(NEAR)}, {_DRAWN}, {_RANDOM} SELECT slot, medoid, cost AS total_cost FROM slots",
    "sequence_pipeline": _PIPELINE,
    "pam_cluster_summary": f"{_all(NEAR)}, {_SEARCH}, {_CLUSTERS} SELECT cluster, medoid, count(*) AS n, sum(dist)::BIGINT AS cost, max(dist) AS farthest FROM nearest WHERE k = 1 GROUP BY ALL",
    "pam_result_roundtrip": _PIPELINE,
}


def entry(spark: SparkSession, root: str = "/root/testdata") -> DataFrame:
    ship(spark)
    return sequence_pipeline(spark, os.path.join(root, "sf0.001"))
