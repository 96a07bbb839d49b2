"""Readers and sinks: strict schemas, locked grids, guarded appends, exact round trips."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.sources import sinks, tables

GRID = {"height": 8, "width": 8}


def cube(spark, day, value=1.0):
    rows = [(dt.datetime(2020, 1, day), "2020-01", r // 4, c // 4, r, c, value + r, None if (r + c) % 5 == 0 else float(c)) for r in range(8) for c in range(8)]
    return spark.createDataFrame(rows, "t timestamp_ntz, month string, block_y int, block_x int, row int, col int, vv double, vh double")


def test_store_lifecycle(spark, tmp_path):
    path = str(tmp_path / "cube")
    sinks.create_store(cube(spark, 1), path, GRID)
    with pytest.raises(Exception, match="exists"):
        sinks.create_store(cube(spark, 1), path, GRID)
    sinks.append_steps(cube(spark, 13), path, GRID)
    with pytest.raises(ValueError, match="time step"):
        sinks.append_steps(cube(spark, 13), path, GRID)
    with pytest.raises(ValueError, match="bands"):
        sinks.append_steps(cube(spark, 14).withColumn("extra", F.lit(1)), path, GRID)
    with pytest.raises(Exception, match="outside"):
        sinks.append_steps(cube(spark, 15).withColumn("row", F.col("row") + 3), path, GRID)
    assert spark.read.parquet(path).count() == 128
    later = cube(spark, 3).withColumn("month", F.lit("2020-02"))
    sinks.replace_months(later, path)
    sinks.replace_months(later.withColumn("vv", F.lit(9.0)), path)
    assert spark.read.parquet(path).groupBy("month").agg(F.count("*").alias("n"), F.max("vv").alias("m")).orderBy("month").collect() == [("2020-01", 128, 8.0), ("2020-02", 64, 9.0)]
    sinks.delete_month(spark, path, "2020-01")
    assert spark.read.parquet(path).count() == 64
    window = tables.read_window(spark, path, (2, 4), (5, 8), 4)
    assert window.count() == 6 and len(window.inputFiles()) >= 1


def test_chunks_round_trip(spark):
    c = cube(spark, 1)
    chunks = sinks.chunk_table(c, ["t", "block_y", "block_x"], "vh")
    assert chunks.count() == 4
    back = sinks.cells_of(chunks, ["t", "block_y", "block_x"], "vh")
    key = lambda df: sorted((r.row, r.col, r.vh is None, r.vh or 0) for r in df.collect())
    assert key(back) == key(c)


def test_strict_and_projected_reads(spark, tmp_path):
    path = str(tmp_path / "lut")
    ddl = "jpl_burst_id STRING, mgrs_tile_id STRING, n INT"
    spark.createDataFrame([("b1", "t1", 1), ("b2", "t2", 2)], ddl).write.parquet(path)
    assert tables.read_strict(spark, path, ddl).count() == 2
    with pytest.raises(ValueError, match="schema"):
        tables.read_strict(spark, path, ddl.replace("INT", "BIGINT"))
    got = tables.read_projected(spark, path, "mgrs_tile_id STRING, more DOUBLE", {"mgrs_tile_id": ["t2"]}).collect()
    assert [tuple(r) for r in got] == [("t2", None)]
    with pytest.raises(LookupError):
        tables.read_projected(spark, path, "mgrs_tile_id STRING", {"mgrs_tile_id": ["none"]})
    for name in ("ACQUISITIONS", "TILED_ACQUISITIONS", "BURST_LUT", "BURSTS", "TILES", "CELLS", "ITEMS", "SOURCE_LINKS"):
        assert len(tables.schema(getattr(tables, name))) >= 4


def test_pushdown_reaches_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/nation.parquet").where(F.col("n_nationkey").isin(3, 5)).select("n_name")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(n_nationkey, [3,5])]" in plan and "r_name" not in plan


def test_geojson_and_xml(spark):
    doc = {"type": "FeatureCollection", "features": [{"id": "a", "geometry": {"type": "Polygon", "coordinates": [[[0, 1], [4, 1], [4, 5], [0, 1]]]}}, {"id": "p", "geometry": {"type": "Point", "coordinates": [1, 2]}}]}
    got = tables.geojson_boxes(spark.createDataFrame([(json.dumps(doc),)], "value string")).collect()
    assert ("a", 0.0, 1.0, 4.0, 5.0) in [tuple(r) for r in got]
    xml = tables.xml_fields(spark.createDataFrame([("<m><id>x1</id><t><b>2</b></t></m>",), ("<m/>",)], "value string"), {"id": "m/id", "b": "m/t/b"}).collect()
    assert sorted(map(tuple, xml), key=str) == sorted([("x1", "2"), (None, None)], key=str)


def test_rasters_and_pairs(spark, tmp_path):
    a = np.arange(6, dtype="<f4")
    a[2] = -9999
    for name, raw in (("s1", a.tobytes()), ("s2", b"short"), ("s3", a.tobytes())):
        (tmp_path / f"{name}.bin").write_bytes(raw)
    got = {r.path[-6:-4]: r for r in tables.band_rasters(spark, str(tmp_path), 2, 3).collect()}
    assert got["s1"]["values"] == [0.0, 1.0, None, 3.0, 4.0, 5.0] and got["s2"].error == "not_a_raster"
    band = lambda rows: spark.createDataFrame(rows, "scene_id int, values array<float>, error string")
    vv = band([(1, [1.0], None), (2, [1.0], None), (3, None, "not_found"), (4, None, "network_error")])
    vh = band([(1, [2.0], None), (2, None, "not_found"), (3, [1.0], None), (4, [1.0], None)])
    assert [r.scene_id for r in tables.paired_scenes(vv, vh).collect()] == [1]
    with pytest.raises(RuntimeError):
        tables.paired_scenes(vv.where("scene_id = 4"), vh)


def test_catalogs_and_stac(spark, tmp_path):
    a = spark.createDataFrame([("t", "p", "2020-01", 1)], "tile_id string, product_type string, month string, v int")
    b = spark.createDataFrame([("t", "p", "2020-01", 2, "x"), ("u", "p", "2020-01", 3, "y")], "tile_id string, product_type string, month string, v int, extra string")
    got = sorted((r.tile_id, r.v, r.extra) for r in sinks.merge_catalogs([a, b], ["tile_id", "product_type", "month"], [F.col("v").desc()]).collect())
    assert got == [("t", 2, "x"), ("u", 3, "y")]
    items = spark.createDataFrame([("i1", "c", "17MPU", "ascending", "2020-01-01", (0.0, 1.0, 2.0, 3.0), "a.zarr", None)], f"id string, collection string, tile string, orbit_state string, datetime string, bbox {tables.BBOX}, zarr string, cog string")
    item = json.loads(items.select(sinks.stac_item({k: F.col(k) for k in ("id", "collection", "bbox", "tile", "datetime")}, {"zarr": F.col("zarr"), "cog": F.col("cog")}).alias("j")).first().j)
    assert item["bbox"] == [0, 1, 2, 3] and item["assets"] == {"zarr": {"href": "a.zarr"}} and item["properties"]["tile"] == "17MPU"
    assert json.loads(sinks.stac_collection(items, "c").first().collection)["summaries"]["tiles"] == ["17MPU"]


def test_provenance_links(spark, tmp_path):
    links = spark.createDataFrame([("o1", "s1", "g", "vv", "input")], tables.SOURCE_LINKS)
    outs, srcs = spark.createDataFrame([("o1",)], "output_id string"), spark.createDataFrame([("s1",)], "source_id string")
    sinks.write_provenance(links, outs, srcs, str(tmp_path / "l"), tables.SOURCE_LINKS)
    assert tables.read_strict(spark, str(tmp_path / "l"), tables.SOURCE_LINKS).count() == 1
    with pytest.raises(ValueError, match="links"):
        sinks.write_provenance(links, outs.where("false"), srcs, str(tmp_path / "m"), tables.SOURCE_LINKS)


def test_band_stats_and_previews(spark):
    s = {r.band: r for r in sinks.band_stats(cube(spark, 1), ["vv", "vh"]).collect()}
    assert s["vv"].n == 64 and s["vv"].mean == 4.5 and s["vh"].n == 52
    want = spark.createDataFrame([("a",), ("b",)], "month string")
    assert [r.month for r in sinks.missing_previews(want, want.where("month = 'a'"), ["month"]).collect()] == ["b"]
    typed = cube(spark, 1).select(*sinks.typed_bands({"vv": "value", "vh": "count"}))
    assert dict(typed.dtypes) == {"vv": "float", "vh": "smallint"} and typed.where("vh IS NULL").count() == 0


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_streams_do_not_depend_on_the_batches(spark, batches):
    from pyspark.sql import functions as F

    from gridloom.streaming import cube

    path = "/root/testdata/sf0.001/events.parquet"
    events = spark.read.parquet(path)
    step = [(F.col("user_id") % 70).alias("store"), F.to_date("ts").alias("day")]
    there = events.where("event_type = 'signup'").select(*step)
    got = cube.append_new_steps(cube.stream(spark, path, batches).select(*step), ["store", "day"], there)
    want = events.select(*step).distinct().exceptAll(there.distinct())
    assert 0 < got.count() == want.count() and got.exceptAll(want).isEmpty()
    late = cube.rejected_late(cube.stream(spark, path, batches).select("event_id", "ts"), "ts", 20)
    newest = events.agg(F.max("ts")).first()[0]
    assert {r.event_id for r in late.where("cause = 'permanent'").collect()} == {r.event_id for r in events.collect() if (newest - r.ts).total_seconds() > 20 * 86400}
    assert late.count() == events.count()
    seen = cube.footprints(cube.stream(spark, path, batches).select((F.col("user_id") % 7).alias("track"), (F.col("user_id") % 24).alias("burst")), "track", "burst")
    assert seen.count() == events.selectExpr("user_id % 7", "user_id % 24").distinct().count()
