"""Small literal cases of the operators: missing values, ties, edges, equivalences."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import names, radar
from gridloom.operators import composite, joins, pu, raster
from gridloom.operators.relational import missing_months, replace_keys, upsert
from gridloom.sources import phase_log, zarr3

NAN = float("nan")


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values()) or (1,)], list(values) or ["x"])
    return row.select(column.alias("r")).first()["r"]


def mosaic_cells(spark):
    """Two tracks with two scenes each on a 3 x 4 grid; both cover nine cells, so the lower track wins where it sees."""
    scenes = {
        (1, 1): [[1, 1, NAN, NAN], [1, 1, NAN, 1], [1, 1, 1, NAN]],
        (1, 13): [[3, 3, NAN, 3], [3, NAN, NAN, 3], [NAN, 3, NAN, NAN]],
        (2, 25): [[5, 5, 5, 5], [NAN, NAN, 5, NAN], [NAN, 5, 5, 5]],
        (2, 31): [[7, 7, 7, 7], [NAN, NAN, 7, NAN], [NAN, NAN, NAN, 7]],
    }
    rows = [("2020-01", r, c, track, float(v), None if np.isnan(v) else 0.5 * v) for (track, _), a in scenes.items() for r, line in enumerate(a) for c, v in enumerate(line)]
    return spark.createDataFrame(rows, "month string, row long, col long, track int, vv double, vh double")


def test_priority_mosaic_is_co_sourced(spark):
    got = {(r.row, r.col): r for r in composite.priority_mosaic(mosaic_cells(spark)).collect()}
    assert got[0, 0].track == 1 and got[0, 0].vv == 2.0 and got[0, 0].n_obs == 2
    assert got[0, 2].track == 2 and got[0, 2].vv == 6.0 and got[0, 2].vh == 3.0
    assert got[2, 3].n_obs == 2 and got[2, 0].n_obs == 1
    assert all(r.vh == r.vv / 2 for r in got.values())


def test_track_tie_goes_to_the_lower_track(spark):
    rows = [("m", 0, c, t, 1.0 * t, None) for t in (5, 3) for c in range(4)]
    df = spark.createDataFrame(rows, "month string, row long, col long, track int, vv double, vh double")
    assert {r.track for r in composite.priority_mosaic(df).collect()} == {3}


@pytest.mark.parametrize(("value", "scene", "positive"), [(None, None, None), (NAN, None, None), (0.0, 0.0, None), (-9999.0, None, None), (9999.0, None, 9999.0), (-2.0, -2.0, None), (0.3, 0.3, 0.3)])
def test_validity_rules(spark, value, scene, positive):
    df = spark.createDataFrame([(value,)], "v double").select(radar.finite(F.col("v"), 9999.0).alias("a"), radar.positive(F.col("v")).alias("b")).first()
    assert (df.a, df.b) == (scene, positive)


@pytest.mark.parametrize(("values", "want"), [([1.0, 2.0, 3.0, 100.0, 5.0, 6.0, 7.0, 8.0], (2 + 3 + 5 + 6 + 7 + 8) / 6), ([None] + [1.0] * 7, 1.0), ([None, None] + [1.0] * 6, None)])
def test_trimmed_mean(spark, values, want):
    got = spark.createDataFrame([(v,) for v in values], "v double").agg(composite.trimmed_mean(F.col("v"), 0.15).alias("m")).first().m
    assert got is None if want is None else abs(got - want) < 1e-12


def test_derived_bands_guard_zero(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 0.5), (None, 1.0)], "vv double, vh double")
    got = composite.derived_bands(df).collect()
    assert (got[0].vv_db, got[0].ratio, got[0].rvi) == (None, None, None)
    assert (got[1].vv_db, got[1].ratio) == (0.0, 0.5) and got[2].vv_db is None


def test_upsert_and_replace(spark):
    old = spark.createDataFrame([("t", "2020-01", 1), ("t", "2020-02", 2), (None, "2020-01", 3)], "tile string, month string, v int")
    new = spark.createDataFrame([("t", "2020-02", 9), ("u", "2020-01", 8)], "tile string, month string, v int")
    got = sorted(((r.tile or "", r.month, r.v) for r in upsert(old, new, ["tile", "month"]).collect()))
    assert got == [("", "2020-01", 3), ("t", "2020-01", 1), ("t", "2020-02", 9), ("u", "2020-01", 8)]
    assert replace_keys(old, new, ["tile", "month"]).count() == 4


def test_month_gaps_keep_null_groups(spark):
    df = spark.createDataFrame([("a", "2020-01"), ("a", "2020-04"), (None, "2019-12"), (None, "2020-02"), ("b", "2020-01")], "d string, month string")
    got = sorted((r.d or "", r.month) for r in missing_months(df, ["d"]).collect())
    assert got == [("", "2020-01"), ("a", "2020-02"), ("a", "2020-03")]


def test_window_join_bounds(spark):
    at = lambda d, h=0: dt.datetime(2024, 1, d, h)
    post = spark.createDataFrame([("x", at(20))], "k string, post timestamp_ntz")
    hist = spark.createDataFrame([("x", at(d)) for d in range(1, 21)] + [("y", at(10)), ("x", at(10, 1))], "k string, t timestamp_ntz")
    got = sorted(r.t for r in joins.window_join(post, hist, ["k"], "post", "t", 5, 10).collect())
    assert got == sorted([*(at(d) for d in range(10, 15)), at(10, 1)])


def test_points_in_rectangles(spark):
    rng = np.random.default_rng(0)
    rects = [(i, float(x), float(y), float(x + w), float(y + h)) for i, (x, y, w, h) in enumerate(rng.uniform(0, 30, (40, 4)))]
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-5, 65, (200, 2)))]
    got = sorted((r.p, r.g) for r in joins.points_in_rectangles(spark.createDataFrame(pts, "p int, x double, y double"), spark.createDataFrame(rects, "g int, xmin double, ymin double, xmax double, ymax double"), 7.0).collect())
    assert got == sorted((p, g) for p, x, y in pts for g, a, b, c, d in rects if a <= x < c and b <= y < d)


def test_grid_identity(spark):
    grid = lambda w: one(spark, names.grid_id(F.lit("17MPU"), F.lit("EPSG:32717"), F.array(*map(F.lit, (30.0, 0.0, 500000.0, 0.0, -30.0, 8500000.0))), F.lit(w), F.lit(16), F.lit(30.0), F.lit(8)))
    assert grid(24) != grid(25) and len(grid(24)) == 12


def test_names(spark):
    assert one(spark, names.utm_epsg(F.lit("17MPU"))) == 32717 and one(spark, names.utm_epsg(F.lit("33UXP"))) == 32633
    with pytest.raises(Exception, match="not a tile name"):
        one(spark, names.utm_epsg(F.lit("99ZZZ")))
    assert one(spark, names.subswath(F.lit("T018-038650-IW2"))) == ("IW2", 38650)
    assert one(spark, names.track_of_store(F.lit("a/b_TK12-18.zarr"))) == "12" and one(spark, names.track_of_store(F.lit("a/b"))) is None
    assert one(spark, names.month_in_name(F.lit("s1_201703_x.tif"))) == "2017-03" and one(spark, names.month_in_name(F.lit("s1_20171332"))) is None
    assert one(spark, names.rebase_path(F.lit("\\a\\b"), "p")) == "p/a/b" and one(spark, names.rebase_path(F.lit("p/a"), "p")) == "p/a"
    assert one(spark, names.sanitised_url(F.lit("https://h/x?a=1&Token=s&b=2#f"))) == "https://h/x?a=1&b=2#f"
    assert one(spark, names.sanitised_url(F.lit("https://h/x?X-Goog-Date=1&sv=2&sig=3&client%5Fsecret=4&a=%zz"))) == "https://h/x?a=%zz"
    assert one(spark, names.sanitised_url(F.lit("https://h/x?sv=2#token=1"))) is None and one(spark, names.sanitised_url(F.lit("https://h/x?sv=2"))) == "https://h/x?sv=2"
    assert one(spark, names.sanitised_url(F.lit("https://u:p@h/x"))) is None and one(spark, names.sanitised_url(F.lit("file:///x"))) is None


def test_utm_inverse(spark):
    got = one(spark, names.utm_to_lonlat(F.lit(500000.0), F.lit(10000000.0), F.lit(17), F.lit(True)))
    assert abs(got.lon + 81) < 1e-9 and abs(got.lat) < 1e-9
    got = one(spark, names.utm_to_lonlat(F.lit(448251.795), F.lit(5411932.678), F.lit(31), F.lit(False)))  # a known landmark in Paris
    assert abs(got.lon - 2.2945) < 2e-4 and abs(got.lat - 48.8582) < 2e-4


# --- rasters


def texture_case(seed=1, h=24, w=24):
    rng = np.random.default_rng(seed)
    q = rng.integers(0, 6, (h, w))
    q[:4] = 6
    return q


def test_texture_by_definition():
    q = texture_case(h=9, w=9)
    got = raster.texture(q, 6, angles=(0,))
    h, w = q.shape
    for r, c in ((4, 4), (8, 8), (5, 0), (4, 8)):
        pairs = []
        for y in range(r - 2, r + 3):
            for x in range(c - 2, c + 3):
                yy, xx = np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)
                a, b = q[yy, xx], q[yy, min(xx + 1, w - 1)]
                if a < 6 and b < 6:
                    pairs.append((a, b))
        p = np.array(pairs, float)
        _, n = np.unique(p, axis=0, return_counts=True)
        assert abs(got["contrast"][r, c] - ((p[:, 0] - p[:, 1]) ** 2).mean()) < 1e-9
        assert abs(got["homogeneity"][r, c] - (1 / (1 + (p[:, 0] - p[:, 1]) ** 2)).mean()) < 1e-9
        assert abs(got["entropy"][r, c] + (n / n.sum() * np.log(n / n.sum())).sum()) < 1e-9
    assert np.isnan(got["contrast"][0]).all()


@pytest.mark.parametrize(("halo", "same"), [(3, True), (0, False)])
def test_texture_by_halo_blocks(spark, halo, same):
    q = texture_case()
    whole = raster.texture(q, 6)["contrast"]
    rr, cc = np.indices(q.shape)
    df = spark.createDataFrame([(int(r), int(c), float(v)) for r, c, v in zip(rr.ravel(), cc.ravel(), q.ravel())], "row long, col long, q double")

    def run(key, pdf):
        a, r0, c0 = raster.as_array(pdf, "q")
        t = raster.texture(a.astype(int), 6)["contrast"]
        own = pdf[pdf.own]
        return own.assign(t=np.nan_to_num(t[own.row - r0, own.col - c0], nan=-1.0))[["row", "col", "t"]]

    out = raster.halo_explode(df, 8, halo, 24, 24).groupBy("by", "bx").applyInPandas(run, "row long, col long, t double").toPandas()
    got = np.full(q.shape, np.nan)
    got[out.row, out.col] = out.t
    assert len(out) == q.size
    assert (np.abs(got - np.nan_to_num(whole, nan=-1.0)).max() < 1e-9) == same


def test_enclosed_holes():
    a = np.ones((6, 6), bool)
    a[2:4, 2] = False
    a[0, 5] = a[5, 1] = False
    a[3, 4] = a[3, 5] = False
    assert raster.enclosed_holes(a).sum() == 2


def test_union_area_of_strips():
    strips = np.array([[0, 0.22 * i, 1, 0.22 * i + 0.24] for i in range(5)])
    assert abs(raster.union_area(strips) - 1.12) < 1e-9
    assert abs(raster.union_area(strips) - raster.union_area(np.delete(strips, 2, 0)) - 0.20) < 1e-9


def test_bilinear_does_not_bleed():
    a = np.array([[1.0, 4.0], [7.0, NAN]])
    b = raster.bilinear(a, 3)
    assert b.shape == (6, 6) and 1 <= np.nanmin(b) and np.nanmax(b) <= 7 + 1e-9


def test_smoothing_keeps_the_mask_and_converges():
    rng = np.random.default_rng(2)
    a = rng.gamma(4, 0.25, (40, 40))
    a[:5] = NAN
    for f in (raster.smooth_tv, raster.smooth_nlm):
        s = f(a)
        assert (np.isnan(s) == np.isnan(a)).all() and np.nanstd(np.log(s)) < np.nanstd(np.log(a))


def test_fill_nearest():
    a = np.array([[1.0, NAN, NAN], [NAN, NAN, 5.0]])
    assert raster.fill_nearest(a).tolist() == [[1, 1, 5], [1, 5, 5]]
    rng = np.random.default_rng(3)
    for shape, share in (((9, 13), 0.6), ((20, 4), 0.95), ((1, 30), 0.8), ((16, 16), 0.3)):
        a = np.where(rng.random(shape) < share, NAN, rng.random(shape))
        a[shape[0] // 2, shape[1] // 2] = 0.5
        ok = np.argwhere(~np.isnan(a))
        want = [[a[tuple(min(ok.tolist(), key=lambda p: ((p[0] - r) ** 2 + (p[1] - c) ** 2, p)))] for c in range(shape[1])] for r in range(shape[0])]
        assert raster.fill_nearest(a).tolist() == want


def test_fill_holes_keeps_what_reaches_the_border():
    a = np.ones((7, 7))
    a[3, 1:6], a[0, 6], a[1, 6], a[1, 5], a[5, 3] = NAN, NAN, NAN, NAN, NAN
    got = raster.fill_holes(a)
    assert np.isnan(got).sum() == 3 and np.isnan(got[[0, 1, 1], [6, 6, 5]]).all() and got[5, 3] == 1
    assert raster.fill_holes(np.full((2, 2), NAN)).shape == (2, 2)


def test_unknown_composite_method():
    with pytest.raises(ValueError):
        composite.reducer(F.col("x"), "mode")


def test_patch_origins():
    assert raster.patch_origins(10, 8, 4, 4) == ([0, 4], [0, 4])
    assert raster.patch_origins(10, 8, 4, 4, clamp=True) == ([0, 4, 6], [0, 4])
    assert raster.patch_origins(3, 3, 4, 2) == ([0], [0])


# --- sources


def test_phase_log(spark):
    lines = ["x [PHASE] query START tile=17MPU", "x [PHASE] query END tile=17MPU elapsed=14.70s rss=321.3MB delta=2MB", "x [PHASE] query FAILED tile=17MPU elapsed=1s rss=9MB", "other", "[PHASE] write END elapsed=2s elapsed=3s tile=17MPU"]
    got = {r.phase: r for r in phase_log.summarize(phase_log.parse(spark.createDataFrame([(x,) for x in lines], "value string"))).collect()}
    assert (got["query"].n, got["query"].elapsed, got["query"].max_rss, got["query"].n_failed) == (2, 15.7, 321.3, 1)
    assert got["write"].elapsed == 3.0


def test_zarr_round_trip(spark, tmp_path):
    import zstandard

    rng = np.random.default_rng(0)
    a = rng.normal(size=(3, 5, 7)).astype("<f4")
    a[0, 0, 0] = np.nan
    root = tmp_path / "VV"
    root.mkdir()
    (root / "zarr.json").write_text(zarr3.array_metadata(a.shape, (1, 4, 4)))
    pad = np.full((3, 8, 8), np.nan, "<f4")
    pad[:, :5, :7] = a
    for t in range(3):
        for y in range(2):
            for x in range(2):
                f = root / "c" / str(t) / str(y) / str(x)
                f.parent.mkdir(parents=True, exist_ok=True)
                f.write_bytes(zstandard.compress(pad[t : t + 1, 4 * y : 4 * y + 4, 4 * x : 4 * x + 4].tobytes(), 7))
    got = {(r.i0, r.i1, r.i2): r.value for r in zarr3.read_array(spark, str(root)).collect()}
    assert got == {(t, y, x): float(a[t, y, x]) for t in range(3) for y in range(5) for x in range(7) if not np.isnan(a[t, y, x])}
    assert {r.i0 for r in zarr3.read_array(spark, str(root), [1]).collect()} == {1}


def test_pu_learning_recovers_prior(spark):
    rng = np.random.default_rng(3)
    n = 4000
    y = rng.random(n) < 0.3
    x = rng.normal(np.where(y[:, None], 2.5, -2.5), 0.8, (n, 2))
    s = y & (rng.random(n) < 0.4)
    df = spark.createDataFrame([(float(a), float(b), int(c), int(d)) for (a, b), c, d in zip(x, s, y)], "x0 double, x1 double, s int, y int")
    model = pu.fit(df, ["x0", "x1"])
    assert abs(model.c - 0.4) < 0.08 and abs(model.prior - 0.3) < 0.08
    assert model.predict_proba(df).agg(F.avg(((F.col("probability_positive") > 0.5) == (F.col("y") == 1)).cast("double"))).first()[0] > 0.95


@pytest.mark.parametrize("parts", ["1", "4", "16"])
def test_results_do_not_depend_on_partitions(spark, parts):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = sorted(tuple(r) for r in composite.priority_mosaic(mosaic_cells(spark)).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert len(got) == 12 and got[0][:4] == ("2020-01", 0, 0, 2.0)
