"""Tiles, strips, components, sparse paths, the segment join and the file sinks against brute force."""

import heapq
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqmesh.operators import graph, medoids, pairs, paths, source_paths, sparse_paths, strip_medoids, tiles
from seqmesh.operators.components import components
from seqmesh.plans.pipeline import cluster_sequences
from seqmesh.session import materialise
from seqmesh.sources import matrix
from seqmesh.sources.text import write_ordered

INF = tiles.INF


def edges_of(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long, weight int")


def vertices_of(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "idx long")


def random_edges(n, m, seed, heaviest=50):
    r = random.Random(seed)
    return list({(min(a, b), max(a, b)): (min(a, b), max(a, b), r.randint(1, heaviest)) for a, b in ((r.randrange(n), r.randrange(n)) for _ in range(m)) if a != b}.values())


def dijkstra(ids, rows):
    """{(i, j): d} of all pairs with a path."""
    near = {i: [] for i in ids}
    for a, b, w in rows:
        if a != b:
            near[a].append((b, w))
            near[b].append((a, w))
    out = {}
    for s in ids:
        best, heap = {}, [(0, s)]
        while heap:
            d, v = heapq.heappop(heap)
            if v not in best:
                best[v] = d
                for u, w in near[v]:
                    if d + w < INF:
                        heapq.heappush(heap, (d + w, u))
        out |= {(s, v): d for v, d in best.items()}
    return out


def known(df):
    return {(r.i, r.j): r.d for r in df.collect() if r.d is not None}


@pytest.mark.parametrize(("n", "m", "side", "leaf"), [(45, 60, 8, 8), (50, 400, 16, 32), (30, 0, 16, 16), (33, 70, 64, 64)])
def test_tiles(spark, n, m, side, leaf):
    rows = random_edges(n, m, n)
    found = paths.shortest_paths(vertices_of(spark, range(n)), edges_of(spark, rows), "tiles", side=side, leaf=leaf)
    got = found.collect()
    assert len(got) == n * n and {(r.i, r.j) for r in got} == {(i, j) for i in range(n) for j in range(n)}
    assert {(r.i, r.j): r.d for r in got if r.d is not None} == dijkstra(range(n), rows)


def test_tiles_of_any_ids_and_long_sums(spark):
    ids = [-4, 7, 100, 101, 5000]
    rows = [(-4, 7, 600_000_000), (7, 100, 600_000_000), (100, 101, 3), (101, 100, 3)]
    got = known(paths.shortest_paths(vertices_of(spark, ids), edges_of(spark, rows), "tiles", side=2, leaf=2))
    assert got == dijkstra(ids, rows) and (-4, 100) not in got


def test_a_grid_bounds_what_an_owner_holds():
    for height, width, side, cores in ((1, 1, 512, 8), (200, 100, 512, 64), (2000, 2000, 512, 4)):
        g = tiles.Grid.of(height, width, side, cores)
        assert g.rows <= height and g.cols <= width
        assert -(-height // g.rows) * -(-width // g.cols) * 4 * side * side <= tiles.OWNED


def test_only_reachable_tiles_are_rows(spark):
    rows = [(8 * k, 8 * k + 1, 5) for k in range(8)]
    closed = tiles.close(tiles.to_tiles(edges_of(spark, rows + [(b, a, w) for a, b, w in rows]), 64, 8), 8)
    assert sorted((r.bi, r.bj) for r in closed.table.collect()) == [(k, k) for k in range(8)]


@pytest.mark.parametrize(("n", "weight", "kind"), [(12, 7, "<u1"), (12, 40, "<i2"), (12, 5000, "<i4")])
def test_tiles_are_as_narrow_as_their_distances_and_held_once(spark, n, weight, kind):
    """A path: light edges may still lie far apart, which is found out when all is closed."""
    rows = [(k, k + 1, weight) for k in range(n - 1)]
    closed = tiles.close(tiles.to_tiles(edges_of(spark, rows + [(b, a, w) for a, b, w in rows]), n, 4), 4)
    assert closed.kind == kind and sorted((r.bi, r.bj) for r in closed.table.collect()) == [(a, b) for a in range(3) for b in range(a, 3)]
    assert known(tiles.to_long(closed)) == {(i, j): weight * abs(i - j) for i in range(n) for j in range(n)}


def test_what_a_written_step_shuffled_is_deleted(spark):
    def held():
        return set(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").splitlines())

    before = held()
    out = materialise(spark.range(1000).repartition(7, "id"), "dealt")
    assert not [p for p in held() - before if p.endswith(".data")]
    assert out.count() == 1000


@pytest.mark.parametrize("local", [0, 5, 2048])
def test_sparse_paths(spark, local):
    rows = [*random_edges(60, 45, 3), (7, 7, 1), (0, 59, 0)]
    ids = range(62)
    want = dijkstra(ids, [e for e in rows if e[2]])
    assert known(sparse_paths.reachable(vertices_of(spark, [*ids, 5]), edges_of(spark, rows), local=local)) == want
    zero = known(sparse_paths.reachable(vertices_of(spark, ids), edges_of(spark, rows), "edge", local))
    assert zero == dijkstra(ids, rows)


def test_sparse_paths_of_a_dense_large_component(spark):
    rows = random_edges(40, 500, 8) + [(50, 51, 4)]
    ids = [*range(40), 50, 51, 99]
    assert known(sparse_paths.reachable(vertices_of(spark, ids), edges_of(spark, rows), local=3)) == dijkstra(ids, rows)


def no_rounds(*_):
    raise AssertionError("the whole matrix was written in rounds")


@pytest.mark.parametrize(("heaviest", "delta"), [(9, None), (9, 4), (16_000, None), (400_000_000, 7)])
def test_blocks_of_sources(heaviest, delta):
    """Distances of 16 and of 32 bits, in rounds of all open vertices and of near ones."""
    for n, m in ((1, 0), (90, 100), (120, 1500)):
        rows = random_edges(n, m, n, heaviest)
        s, t, w = (np.array([e[k] for e in rows], dtype=np.int64) for k in range(3))
        held = source_paths.by_head(n, np.r_[s, t], np.r_[t, s], np.r_[w, w])
        got = np.concatenate([source_paths.distances(held, at, min(n, at + 32), delta) for at in range(0, n, 32)], axis=1)
        assert {(j, i): int(got[i, j]) for i, j in zip(*np.nonzero(got < INF), strict=True)} == dijkstra(range(n), rows)


def test_paths_are_closed_without_rounds_over_the_matrix(spark, monkeypatch):
    rows = random_edges(90, 140, 6)
    want = dijkstra(range(90), rows)
    v, e = vertices_of(spark, range(90)), edges_of(spark, rows)
    monkeypatch.setattr(paths, "close_strips", no_rounds)
    monkeypatch.setattr(tiles, "close", no_rounds)
    assert known(paths.shortest_paths(v, e)) == want
    assert known(paths.path_strips(v, e).long()) == want
    assert known(sparse_paths.reachable(v, e, local=3)) == want


@pytest.mark.parametrize("room", [0, 1 << 20])
def test_delta_stepping_from_some_sources(spark, monkeypatch, room):
    """By joins and by blocks of sources; edges one way, sources without edges, ids of any kind."""
    monkeypatch.setattr(source_paths, "EDGE_BYTES", room)
    one_way = edges_of(spark, [(-5, 70, 3), (70, 9, 4), (9, -5, 2), (70, 30, 50), (9, 30, 1)])
    got = known(sparse_paths.delta_stepping(vertices_of(spark, [70, 8, 70]), one_way, 5))
    assert got == {(70, 70): 0, (70, 9): 4, (70, -5): 6, (70, 30): 5, (8, 8): 0}
    assert known(sparse_paths.delta_stepping(vertices_of(spark, []), graph.symmetrised(one_way), 5)) == {}


def test_paths_of_edges_too_many_to_be_sent(spark, monkeypatch):
    """Strips, tiles and joins, as they are taken where edges can't be broadcast."""
    rows = random_edges(70, 110, 4)
    want = dijkstra(range(70), rows)
    v, e = vertices_of(spark, range(70)), edges_of(spark, rows)
    monkeypatch.setattr(source_paths, "EDGE_BYTES", 0)
    assert known(paths.shortest_paths(v, e)) == want
    assert known(sparse_paths.reachable(v, e, local=3)) == want


def test_sparse_strategy_has_all_pairs(spark):
    got = paths.shortest_paths(vertices_of(spark, range(5)), edges_of(spark, [(0, 1, 2)]), "sparse").collect()
    assert len(got) == 25 and sum(r.d is not None for r in got) == 7
    assert sparse_paths.reachable(vertices_of(spark, []), edges_of(spark, [])).count() == 0
    with pytest.raises(Exception, match="negative weight"):
        sparse_paths.reachable(vertices_of(spark, [0, 1]), edges_of(spark, [(0, 1, -2)])).collect()


def test_many_vertices_in_small_components(spark):
    """100,000 vertices with four neighbours on average: paths within components, no table of all pairs."""
    size, n = 10, 100_000
    e = spark.range(2 * n).select((F.col("id") % n).alias("src"), F.xxhash64("id").alias("h"))
    e = e.select("src", (F.expr(f"src div {size}") * size + F.pmod("h", F.lit(size))).alias("dst"), (F.pmod(F.shiftright("h", 8), F.lit(90)) + 1).cast("int").alias("weight")).where("src <> dst")
    e = e.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.min("weight").alias("weight"))
    found = sparse_paths.reachable(spark.range(n).withColumnRenamed("id", "idx"), e)
    mark = found.agg(F.count(F.lit(1)), F.count_if(F.expr(f"i div {size} <> j div {size}")), F.count_if(F.col("i") == F.col("j"))).first()
    assert n < mark[0] <= n * size and mark[1] == 0 and mark[2] == n
    part = range(500, 540)
    rows = [tuple(r) for r in e.where(F.col("src").between(500, 539)).collect()]
    assert known(found.where(F.col("i").between(500, 539))) == dijkstra(part, rows)


def test_components(spark):
    rows = random_edges(300, 160, 5) + [(400 + k, 401 + k, 1) for k in range(60)] + [(1000 - k, 700, 1) for k in range(40)] + [(3, 3, 1)]
    ids = [*range(300), *range(400, 461), 700, *range(961, 1001)]
    want = {}
    for i, j in dijkstra(ids, rows):
        want[i] = min(want.get(i, i), j)
    assert {r.idx: r.component for r in components(vertices_of(spark, ids), edges_of(spark, rows)).collect()} == want
    assert components(vertices_of(spark, []), edges_of(spark, [])).count() == 0


@pytest.mark.parametrize("k", [1, 2, 4, 14])
def test_medoids_on_strips(spark, k):
    r = np.random.default_rng(k)
    m = r.integers(0, 6, (14, 14))
    m[r.random((14, 14)) < 0.15] = INF
    np.fill_diagonal(m, 0)
    ids = [3 * i + 2 for i in range(14)]
    dist = spark.createDataFrame([(ids[i], ids[j], None if m[i, j] == INF else int(m[i, j])) for i in range(14) for j in range(14)], "i long, j long, d int")
    strips, init = strip_medoids.of_long(dist), ids[:k]
    found, want = strip_medoids.k_medoids(strips, k, init), medoids.k_medoids(dist, k, init)
    assert found.history == want.history and found.total_cost == want.total_cost
    assert sorted(map(tuple, found.assignment.collect())) == sorted(map(tuple, want.assignment.collect()))
    assert strip_medoids.k_medoids(strips, k, seed=2).history == medoids.k_medoids(dist, k, seed=2).history
    a = sorted((r.h, *r.costs) for r in strip_medoids.swap_costs(strips, list(range(k))).collect())
    assert a == sorted((r.h, *(r[f"c{s}"] for s in range(k))) for r in medoids.swap_costs(dist, init).collect())
    assert known(strips.long()) == {(ids[i], ids[j]): m[i, j] for i in range(14) for j in range(14) if m[i, j] < INF}


def test_medoids_over_blocks_of_candidates(spark, monkeypatch):
    r = np.random.default_rng(1)
    x = r.integers(0, 100_000, (70, 2))
    m = np.abs(x[:, None] - x[None]).sum(axis=2)
    dist = spark.createDataFrame([(i, j, int(m[i, j])) for i in range(70) for j in range(70)], "i long, j long, d int")
    monkeypatch.setattr(strip_medoids, "height_for", lambda n: 9)
    strips = strip_medoids.of_long(dist)
    assert strips.table.count() == 8
    assert strip_medoids.k_medoids(strips, 3, [0, 1, 2]).history == medoids.k_medoids(dist, 3, [0, 1, 2]).history


def test_strip_arguments(spark):
    dist = spark.createDataFrame([(i, j, abs(i - j)) for i in range(5) for j in range(5)], "i long, j long, d int")
    strips = strip_medoids.of_long(dist)
    for k, init, text in ((6, None, "k is 6"), (2, [1, 1], "different"), (2, [1, 77], "must be vertices")):
        with pytest.raises(ValueError, match=text):
            strip_medoids.k_medoids(strips, k, init)
    assert strip_medoids.k_medoids(strip_medoids.of_long(dist.limit(0))).medoids == []


def test_strips_of_tiles(spark, monkeypatch):
    monkeypatch.setattr(paths, "TILED", 10)
    rows = random_edges(40, 50, 2)
    ids = [5 * i for i in range(40)]
    moved = [(5 * a, 5 * b, w) for a, b, w in rows]
    strips = paths.path_strips(vertices_of(spark, ids), edges_of(spark, moved))
    assert known(strips.long()) == dijkstra(ids, moved)
    lines = [r.line for r in matrix.strip_lines(strips, 3).orderBy("i").collect()]
    want = dijkstra(range(40), rows)
    assert lines == ["".join(f"{want.get((i, j), INF):3d} " for j in range(40)) for i in range(40)]


def test_report_has_each_pass(spark):
    rows = ["AAAAAAAA", "AAAAAAAT", "TTTTTTTT", "TTTTTTTA", "TTTTTTAA"]
    report = cluster_sequences(spark.createDataFrame(list(enumerate(rows)), "idx long, seq string"), epsilon=4, k=2, init=[0, 1]).report
    assert len(report["history"]) == report["passes"] and report["history"][-1] == (report["medoids"], report["total_cost"])
    costs = [c for _, c in report["history"]]
    assert costs == sorted(costs, reverse=True)


def sequences(n, length, seed):
    r = random.Random(seed)
    base = ["".join(r.choice("ACGT") for _ in range(length)) for _ in range(n // 4)]
    out = []
    for k in range(n):
        s = list(base[k % len(base)])
        for _ in range(k % 9):
            s[r.randrange(length)] = r.choice("ACGT")
        out.append("".join(s))
    return out


@pytest.mark.parametrize(("below", "alphabet", "crowd"), [(1, "ACGT", 4096), (5, "ACGT", 3), (8, None, 4096), (40, "ACGT", 7)])
def test_segment_join(spark, monkeypatch, below, alphabet, crowd):
    monkeypatch.setattr(pairs, "CROWD", crowd)
    rows = sequences(80, 40, below) + ["A" * 40] * 12  # a crowd that shares every segment
    df = spark.createDataFrame(list(enumerate(rows)), "idx long, seq string")
    want = sorted((i, j, d) for i in range(len(rows)) for j in range(i + 1, len(rows)) if (d := sum(a != b for a, b in zip(rows[i], rows[j]))) < below)
    assert sorted(map(tuple, pairs.pairwise_hamming(df, alphabet, below, join="segments").collect())) == want
    assert sorted(map(tuple, pairs.pairwise_hamming(df, alphabet, below, join="pairs").collect())) == want
    cut = [(k * 40 // below, (k + 1) * 40 // below) for k in range(below)]
    assert pairs.segment_candidates(df, below) == sum(s[a:b] == t[a:b] for i, s in enumerate(rows) for t in rows[:i] for a, b in cut)


@pytest.mark.parametrize(("length", "below", "alphabet"), [(64, 16, "01"), (64, 5, "01"), (125, 7, "ACGT"), (40, 3, None)])
def test_crowds_are_compared_as_arrays(spark, monkeypatch, length, below, alphabet):
    """Crowds in several blocks, strings over two words of bits, repeated ids and nulls; no candidate is a row of a join."""
    monkeypatch.setattr(pairs, "CROWD", 1)
    rows = sequences(150, length, below)
    rows = [s.translate(str.maketrans("ACGT", "0101")) for s in rows] if alphabet == "01" else rows
    held = [*enumerate(rows), (7, rows[7]), (3, rows[9]), (1000, None)]
    df = spark.createDataFrame(held, "idx long, seq string")
    got = pairs.pairwise_hamming(df, alphabet, below, join="segments")
    want = sorted((i, j, d) for i, s in held for j, t in held if i < j and s and t and (d := sum(a != b for a, b in zip(s, t))) < below)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 20
    assert "zip_with" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_segments_look_at_the_distance_first(spark):
    df = spark.createDataFrame(list(enumerate(sequences(30, 40, 3))), "idx long, seq string")
    plan = pairs.pairwise_hamming(df, "ACGT", 5, join="segments")._jdf.queryExecution().optimizedPlan().toString()
    join = next(x for x in plan.splitlines() if "Join Inner" in x and "zip_with" in x)
    assert 0 <= join.index("bit_count") < join.index("zip_with")


def test_segment_join_is_taken_where_it_pays(spark):
    df = spark.createDataFrame(list(enumerate(sequences(1200, 60, 1))), "idx long, seq string")
    assert pairs._worth(df, 1200, 60, "ACGT", 6) and not pairs._worth(df, 1200, 60, "ACGT", 50)
    same = spark.createDataFrame([(i, "A" * 60) for i in range(1200)], "idx long, seq string")
    assert not pairs._worth(same, 1200, 60, "ACGT", 6)
    assert pairs.pairwise_hamming(df, "ACGT", 0).count() == 0
    with pytest.raises(ValueError, match="join is"):
        pairs.pairwise_hamming(df, "ACGT", None, join="segments")
    auto = pairs.threshold_graph(df, 6)
    assert auto.count() == pairs.threshold_graph(df, 6, join="pairs").count()


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_one_file_from_many_tasks(spark, tmp_path, n):
    lines = spark.range(n).select("id", F.concat(F.lit("zeile é "), F.col("id").cast("string")).alias("line")).repartition(7)
    want = "top\n\nsecond\n" + "".join(f"zeile é {i}\n" for i in reversed(range(n))) + "end\n"
    path = str(tmp_path / "out.txt")
    for _ in range(2):  # the second time it replaces the first
        write_ordered(lines.select((-F.col("id")).alias("k"), "line"), path, ["k"], ["top\n", "second"], ["end"])
        assert open(path, encoding="utf-8").read() == want
    assert sorted(x for x in os.listdir(tmp_path) if not x.endswith(".crc")) == ["out.txt"]
    assert spark.read.text(path).count() == n + 4


def test_one_file_in_a_store_that_only_spark_reaches(spark, tmp_path):
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.shelf.link./data", f"file://{tmp_path}")
    lines = spark.range(3000).select("id", F.col("id").cast("string").alias("line")).repartition(5)
    write_ordered(lines, "viewfs://shelf/data/out.txt", ["id"], ["head"], ["tail"])
    assert open(tmp_path / "out.txt").read() == "head\n" + "".join(f"{i}\n" for i in range(3000)) + "tail\n"


def test_a_failed_write_leaves_the_old_file(spark, tmp_path):
    path = str(tmp_path / "kept.txt")
    write_ordered(spark.range(3).select("id", F.lit("x").alias("line")), path, ["id"])
    bad = spark.range(50).select("id", F.when(F.col("id") == 40, F.raise_error(F.lit("no"))).otherwise("x").alias("line"))
    with pytest.raises(Exception, match="no"):
        write_ordered(bad, path, ["id"])
    assert open(path).read() == "x\nx\nx\n" and sorted(x for x in os.listdir(tmp_path) if not x.endswith(".crc")) == ["kept.txt"]
