"""Small cases of faults that only showed on larger tables: plans that grow too fast, ties, seconds cut off."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom.operators import joins, raster
from gridloom.operators.relational import exact_percentiles, mean_ranks

NAN = float("nan")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def grid_cells(spark, blocks, value, kind):
    rows = [(b, r, c, None if np.isnan(v) else (int(v) if kind == "int" else float(v))) for b, a in blocks.items() for (r, c), v in np.ndenumerate(a)]
    return spark.createDataFrame(rows, f"block_id long, row long, col long, {value} {kind}")


@pytest.mark.parametrize("angle", [0, 90])
def test_relational_texture_broadcasts_no_cells(spark, angle):
    rng = np.random.default_rng(5)
    blocks = {b: rng.integers(0, 7, (8, 8)) for b in range(3)}
    blocks[1][:4] = 6
    got = raster.texture_relational(grid_cells(spark, blocks, "q", "int"), ["block_id"], 8, 8, 6, angle=angle)
    assert "Broadcast" not in plan(got) and "SortMergeJoin" in plan(got)
    want = {b: raster.texture(a, 6, angles=(angle,)) for b, a in blocks.items()}
    rows = got.collect()
    assert len(rows) == sum((a < 6).sum() for a in blocks.values())
    for r in rows:
        for n in ("contrast", "homogeneity"):
            w = want[r.block_id][n][r.row, r.col]
            assert (r[n] is None and np.isnan(w)) or abs(r[n] - w) < 1e-9


def test_kernels_get_stacks_of_blocks(spark):
    """Before, each small block was a call of pandas and numpy of its own."""
    rng = np.random.default_rng(6)
    blocks = {b: np.where(rng.random(s := ((3, 4), (5, 2), (3, 4), (1, 1))[b % 4]) < 0.2, NAN, rng.random(s)) for b in range(200)}
    cells = grid_cells(spark, blocks, "v", "double").repartition(3)

    def kernel(a):
        return {"n": np.full(a.shape, float(len(a))), "w": a * 2 + a.shape[-1]}

    got = raster.per_block(cells, ["block_id"], "v", kernel, ["n", "w"]).collect()
    assert len(got) == sum(a.size for a in blocks.values()) and max(r.n for r in got) > 1
    for r in got:
        v = blocks[r.block_id][r.row, r.col]
        assert (r.w is None and np.isnan(v)) or r.w == 2 * v + blocks[r.block_id].shape[1]


@pytest.mark.parametrize("most", [1, 7, 1000])
def test_blocks_stay_whole_between_batches(spark, monkeypatch, most):
    monkeypatch.setattr(raster, "STACK_CELLS", most)
    cells = spark.range(500).select((F.col("id") % 5).alias("a"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("b"), (F.col("id") % 3).cast("string"))).alias("b"), F.floor(F.col("id") / 15).alias("row"), F.lit(0).cast("long").alias("col"), F.col("id").cast("double").alias("v"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 11)
    try:
        got = raster.hole_fraction(cells, ["a", "b"], "v").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = cells.groupBy("a", "b").agg((F.max("row") - F.min("row") + 1).alias("n")).collect()
    assert sorted((r.a, r.b or "", r.n_px) for r in got) == sorted((r.a, r.b or "", r.n) for r in want) and len(got) == 15


def test_texture_of_a_stack():
    rng = np.random.default_rng(7)
    stack = rng.integers(0, 7, (5, 8, 6))
    whole = raster.texture(stack, 6)
    for b, a in enumerate(stack):
        for n, v in raster.texture(a, 6).items():
            assert np.allclose(whole[n][b], v, equal_nan=True, atol=1e-12)


def test_smoothing_of_a_stack():
    rng = np.random.default_rng(8)
    stack = np.where(rng.random((6, 8, 8)) < 0.2, NAN, rng.gamma(4, 0.25, (6, 8, 8)))
    stack[2], stack[4, :, :4] = NAN, -1.0
    for f in (raster.smooth_tv, raster.smooth_nlm, raster.fill_nearest):
        whole = f(stack)
        for b, a in enumerate(stack):
            assert np.allclose(whole[b], f(a), equal_nan=True, atol=1e-12)


def test_texture_query_runs_on_stacks(spark):
    from gridloom.plans import registry

    for name in ("arr15_glcm_texture", "arr15_glcm_all_metrics", "arr20_despeckle", "arr19_halo_mean", "arr4_bilinear_resample", "arr10_interior_holes"):
        shown = plan(registry.queries()[name](spark, "/root/testdata/sf0.001"))
        assert "FlatMapGroupsInPandas" not in shown and "MapInArrow" in shown


def test_window_stats_are_those_of_the_pairs(spark):
    rng = np.random.default_rng(9)
    start = dt.datetime(2024, 1, 1)
    # whole hours, so that times meet the window's ends
    times = lambda n: [start + dt.timedelta(hours=int(h)) for h in rng.integers(-20 * 24, 20 * 24, n)]
    post = spark.createDataFrame([("abc"[i % 3] if i % 10 else None, i // 2, t) for i, t in enumerate(times(80))], "k string, id int, at timestamp_ntz")
    hist = spark.createDataFrame([("abd"[i % 3] if i % 10 else None, t) for i, t in enumerate(times(300))], "k string, t timestamp_ntz")
    got = joins.window_stats(post, hist, ["k"], "at", "t", 1, 6, ["id"])
    want = joins.window_join(post, hist, ["k"], "at", "t", 1, 6).groupBy("id").agg(F.count("*").alias("n"), F.max("t").alias("last"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 20


def test_time_window_counts_make_no_pairs(spark, tmp_path):
    """One burst whose posts all see the same history: pairs grow with the square, rows do not."""
    from gridloom.plans import registry

    n = 3000
    e = spark.range(n).select(F.col("id").alias("event_id"), F.timestamp_add("SECOND", F.when(F.col("id") % 2 == 0, 0).otherwise(3 * 86400) + F.col("id"), F.lit("2024-01-01").cast("timestamp_ntz")).alias("ts"), F.lit(1).cast("long").alias("user_id"), F.lit("click").alias("event_type"), F.lit(1.0).alias("value"))
    e.write.parquet(str(tmp_path / "events.parquet"))
    q = registry.queries()["join4_time_window_join"](spark, str(tmp_path))
    rows = q.collect()
    assert len(rows) == n // 2 and all(r.n_pre == n // 2 for r in rows)
    assert 0 < max_rows(q) <= 2 * n


def max_rows(df):
    """Most rows that a join of the executed plan made."""
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        if p.nodeName() == "AdaptiveSparkPlan":
            todo.append(p.executedPlan())
            continue
        if "QueryStage" in p.nodeName():
            todo.append(p.plan())
        if "Join" in p.nodeName() and p.metrics().contains("numOutputRows"):
            most = max(most, p.metrics().apply("numOutputRows").value())
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return most


def test_late_by_part_of_a_second(spark, tmp_path):
    from gridloom.streaming import cube

    newest = dt.datetime(2024, 1, 30, 12, 0, 0, 900_000)
    back = [dt.timedelta(days=20, microseconds=m) for m in (-1, 0, 1, 500_000, 999_999)]
    spark.createDataFrame([(i, newest - b) for i, b in enumerate(back)] + [(9, newest)], "id int, ts timestamp_ntz").write.parquet(str(tmp_path / "e"))
    late = cube.rejected_late(cube.stream(spark, str(tmp_path / "e"), 2), "ts", 20)
    assert sorted(r.id for r in late.where("cause = 'permanent'").collect()) == [2, 3, 4]


@pytest.mark.parametrize("files", [1, 3])
@pytest.mark.parametrize("name", ["arr31_tile_mosaic", "win9_10_first_valid_mosaic", "arr3_5_shifted_mosaic", "arr6_priority_window", "arr8_scene_mosaics", "arr29_merge_groups"])
def test_of_equal_scenes_the_first_in_the_table_wins(spark, tmp_path, name, files):
    """Scenes with the same number and place in the scene: one thread of the SQL's engine takes the first that it reads."""
    import duckdb

    from gridloom.plans import registry

    at, con = tmp_path / "lineitem.parquet", duckdb.connect(config={"threads": 1})
    at.mkdir()
    for k in range(files):
        con.execute(f"""COPY (SELECT i % 3 AS l_orderkey, 8::BIGINT AS l_partkey, (i % 2) * 6 AS l_suppkey, 1::INT AS l_linenumber, (1 + (i * 7 + {k}) % 50)::DOUBLE AS l_quantity, 5.0::DOUBLE AS l_extendedprice, ((i * 13 + {k} * 5) % 11) / 100.0::DOUBLE AS l_discount,
            0.0::DOUBLE AS l_tax, 'ANR'[1 + i % 3] AS l_returnflag, 'O' AS l_linestatus, TIMESTAMP '1997-01-01' + to_days((i % 40)::INT) AS l_shipdate FROM range(400) r(i)) TO '{at}/p{k}.parquet' (FORMAT parquet)""")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{at}/*.parquet'")
    got, want = registry.queries()[name](spark, str(tmp_path)).toPandas(), con.execute(registry.oracle_sql()[name]).df()
    rows = lambda f: sorted(map(str, f[sorted(f)].round(7).astype(object).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def test_points_stream_past_their_series(spark):
    """A broadcast of the points made one series the streamed row of all its points' output rows, which were held at a time."""
    from gridloom.plans import registry

    shown = plan(registry.queries()["arr26_27_track_series"](spark, "/root/testdata/sf0.001"))
    last = [line for line in shown.splitlines() if "Join" in line][0]
    assert "SortMergeJoin [row" in last and "share" in last


def test_points_in_rectangles_by_small_cells(spark):
    rng = np.random.default_rng(10)
    # whole numbers, so that points meet edges of rectangles and cells; some rectangles are empty
    rects = [(i, *map(float, (x, y, x + w, y + h))) for i, (x, y, w, h) in enumerate(rng.integers(-8, 9, (60, 4)) % [99, 99, 9, 9])]
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.integers(-10, 20, (300, 2)))]
    p, g = spark.createDataFrame(pts, "p int, x double, y double"), spark.createDataFrame(rects, "g int, xmin double, ymin double, xmax double, ymax double")
    want = sorted((i, j) for i, x, y in pts for j, a, b, c, d in rects if a <= x < c and b <= y < d)
    got = joins.points_in_rectangles(p, g, (3.0, 1.0))
    assert sorted((r.p, r.g) for r in got.collect()) == want and "Broadcast" not in plan(got)


def test_first_rectangle_tries_few(spark):
    """Four hundred rectangles over every point: all pairs are 400 a point, the first needs one."""
    g = spark.range(400).select(F.col("id").alias("g"), (F.col("id") / 100).alias("xmin"), (F.col("id") / 100 + 50).alias("xmax"), F.lit(0.0).alias("ymin"), F.lit(9.0).alias("ymax"))
    p = spark.range(500).select(F.col("id").alias("p"), (F.col("id") % 40).cast("double").alias("x"), (F.col("id") % 10).cast("double").alias("y"))
    q = joins.first_rectangle(p, g, (4.0, 1.0), ["p"], "g")
    got = {r.p: r.g for r in q.collect()}
    assert got == {i: 0 for i in range(500) if i % 10 < 9}
    assert 0 < max_rows(q) < 400 * 200


def test_blocks_are_written_by_many_tasks(spark, tmp_path):
    """Each block was one task's, whatever its size."""
    from gridloom.plans import registry

    spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").repartition(3).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.conf.set("spark.sql.files.openCostInBytes", 64 << 20)
    try:
        q = registry.queries()["src23_window_read"](spark, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(q.inputFiles()) > 4 and q.count() == 9


def test_provenance_is_made_once_and_checked(spark, tmp_path):
    from gridloom.sources import sinks, tables

    made = spark.sparkContext.accumulator(0)
    one = F.udf(lambda x: made.add(1) or x, "string").asNondeterministic()
    links = spark.range(40).select(one(F.concat(F.lit("o"), (F.col("id") % 8).cast("string"))).alias("output_id"), F.col("id").cast("string").alias("source_id"), F.lit("g").alias("generation"), F.lit("vv").alias("variable"), F.lit("in").alias("role"))
    outs, srcs, path = spark.range(8).select(F.concat(F.lit("o"), "id").alias("output_id")), spark.range(40).select(F.col("id").cast("string").alias("source_id")), str(tmp_path / "l")
    sinks.write_provenance(links, outs, srcs, path, tables.SOURCE_LINKS)
    assert made.value == 40 and tables.read_strict(spark, path, tables.SOURCE_LINKS).count() == 40
    for bad, o, s in ((links, outs, srcs), (links, outs.limit(3), srcs), (links, outs, srcs.limit(3)), (links.union(links), outs, srcs)):
        with pytest.raises((ValueError, FileExistsError)):
            sinks.write_provenance(bad, o, s, path if bad is links and o is outs and s is srcs else str(tmp_path / "m"), tables.SOURCE_LINKS)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["l"]


def test_percentiles_and_ranks_are_exact(spark):
    rng = np.random.default_rng(11)
    n = 3000
    f = pd.DataFrame({"g": np.where(rng.random(n) < 0.5, "a", "b"), "v": np.round(rng.normal(0, 5, n), 2)})
    f.loc[:1200, "v"] = 1.25  # a value that many rows share
    rows = [(g if i % 9 else None, float(v) if i % 7 else None) for i, (g, v) in enumerate(f.itertuples(index=False))] + [("c", None), ("d", 2.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    shares = {"lo": 0.02, "mid": 0.5, "hi": 0.98, "top": 1.0}
    for accuracy in (10_000, 50):
        got = {r.g: tuple(r)[1:] for r in exact_percentiles(df, ["g"], "v", shares, accuracy).collect()}
        want = {r.g: tuple(r)[1:] for r in df.groupBy("g").agg(*[F.percentile("v", q) for q in shares.values()]).collect()}
        assert set(got) == set(want) == {"a", "b", "c", "d", None}
        assert all(x == y or abs(x - y) < 1e-9 for g in want for x, y in zip(got[g], want[g], strict=True))
    ranks = {(r.g, r.v): r.r for r in mean_ranks(df, "g", "v", "r", 4).collect()}
    for g in ("a", "b", "c", "d", None):
        v = pd.Series([np.inf if b is None else b for a, b in rows if a == g])
        assert all(ranks[g, None if x == np.inf else x] == k for x, k in zip(v, v.rank()))


def test_percentiles_keep_no_group_in_a_buffer(spark):
    from gridloom.plans import registry

    for name in ("msc15_percentile_clip", "agg28_global_summary"):
        shown = plan(registry.queries()[name](spark, "/root/testdata/sf0.001"))
        assert " percentile(" not in shown and "partial_percentile(" not in shown


def test_fits_do_not_search_texts_again(spark):
    from gridloom.plans import registry

    assert "regexp" not in plan(registry.queries()["arr33_pu_learning"](spark, "/root/testdata/sf0.001")).lower()
