import math
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prismal import BinAxis, BinGrid, Catalog, FDataset, config
from prismal.functions import geo, geodesy, image, track, transforms
from prismal.plans import query
from prismal.sinks import image as image_sink
from prismal.sinks import text
from prismal.sources import generator, granules, matrix, netcdf, readers, sections, store
from prismal.streaming import stateless


def cube(spark, nx=3, ny=2, nz=4):
    rows = [(x, y, z, 100.0 * x + 10 * y + z) for x in range(nx) for y in range(ny) for z in range(nz)]
    return FDataset(spark.createDataFrame(rows, "x int, y int, z int, v double"), ["x", "y", "z"], ["v"], "cube")


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hash")


def test_curry_and_back(spark):
    ds = cube(spark)
    assert sorted(ds.curry(1).uncurry().df.collect()) == sorted(ds.df.collect())
    inner = ds.curry(2).collect()[0]
    assert [s.z for s in inner.samples] == [0, 1, 2, 3]
    with pytest.raises(ValueError):
        ds.curry(3)
    with pytest.raises(ValueError):
        ds.curry(2).select("z > 1")


def test_reordering_needs_no_shuffle(spark):
    ds = cube(spark).group_by_variable("z", "y", "x")
    assert ds.domain == ["z", "y", "x"] and exchanges(ds.df) == 0
    assert cube(spark).curry(2).transpose().collect()[1].samples[0].v == 1.0
    flat = cube(spark).curry(2).transpose(flat=True)
    assert flat.domain == ["z", "x", "y"] and flat.nested is None and flat.count() == 24


def test_rgb_takes_one_shuffle(spark):
    assert exchanges(cube(spark).make_rgb(0, 1, 2).df) == 1
    assert exchanges(cube(spark).rgb_pivot(0, 1, 2).df) == 1
    assert cube(spark).make_rgb(0, 1, 2).eval(2, 1).df.first()[2:] == (210.0, 211.0, 212.0)
    assert all(map(math.isnan, cube(spark).make_rgb(0, 1, 9).df.first()[2:]))


def test_selections(spark):
    ds = cube(spark)
    assert ds.select("x >= 1").select("y=0").select("z != 3").count() == 6
    assert ds.select("v ~ 111.6").df.first().v == 112.0
    assert ds.contains("z", 0, 3).count() == 12
    assert ds.stride(2, 1, 2).count() == 2 * 2 * 2
    assert ds.drop(23).first().df.first().v == 213.0
    with pytest.raises(LookupError):
        ds.eval(9, 9, 9, strict=True)


def test_filters_reach_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    plan = FDataset(df, ["o_orderkey"], ["o_totalprice"]).select("o_orderkey = 7").project("o_totalprice").df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderkey,7)" in plan and "o_orderstatus" not in plan.split("ReadSchema")[1]


def test_substitution_and_joins(spark):
    ds = cube(spark)
    table = FDataset(spark.createDataFrame([(0, 400.0), (1, 410.0)], "z int, w double"), ["z"], ["w"])
    assert ds.substitute(table).domain == ["x", "y", "w"] and ds.substitute(table).count() == 12
    assert ds.substitute(table, "left").count() == 24
    assert ds.substitute_by(["x", "y"], ["a", "b"], lambda x, y: (x + y, x - y)).domain == ["a", "b", "z"]
    other = FDataset(ds.df.withColumnRenamed("v", "u"), ["x", "y", "z"], ["u"])
    assert ds.natural_join(other).range == ["v", "u"]
    assert ds.union(ds).count() == 48 and ds.union(ds, distinct=True).count() == 24


def test_nearest_and_linear(spark):
    ds = FDataset(spark.createDataFrame([("a", 1.0, 10.0), ("a", 2.0, 20.0), ("a", 3.0, 40.0)], "k string, x double, v double"), ["k", "x"], ["v"])
    at = spark.createDataFrame([("a", p) for p in (0.0, 1.5, 2.25, 3.0, 9.0)], "k string, p double")
    assert [r.v for r in ds.nearest(at, "p").df.orderBy("p").collect()] == [10.0, 10.0, 20.0, 40.0, 40.0]
    assert [r.v for r in ds.linear(at, "p").df.orderBy("p").collect()] == [None, 15.0, 25.0, 40.0, None]


def test_bins(spark):
    axis = BinAxis(0.0, 2.5, 4)
    df = spark.createDataFrame([(v,) for v in (-0.1, 0.0, 2.4, 2.5, 9.99, 10.0, float("nan"), None)], "v double")
    assert [r[0] for r in df.select(axis.index("v")).collect()] == [None, 0, 0, 1, 3, None, None, None]
    grid = BinGrid.from_extents((-108.27, 34.68), (-108.195, 34.76), 16)
    assert grid.shape == (4, 4) and grid.axes[0].nodes()[-1] == pytest.approx(-108.21375) and grid.axes[1].nodes()[-1] == pytest.approx(34.74)
    rows = grid.table(spark, ["lon", "lat"]).collect()
    assert len(rows) == 16 and rows[0] == (-108.27, 34.68) and rows[1].lat == pytest.approx(34.70)


def test_resampling_drops_outside_before_the_shuffle(spark):
    ds = cube(spark, 4, 4, 1).rename_variable("v", "f")
    out = ds.group_by_bin(BinGrid((BinAxis(0, 2, 1), BinAxis(0, 2, 2))), by=["x", "y"], keep=[])
    assert [(r.x, r.y, r.f) for r in out.ordered().df.collect()] == [(0.0, 0.0, 0.0), (0.0, 2.0, 20.0)]
    near = ds.nearest_in_bin(BinGrid((BinAxis(0, 4, 1), BinAxis(0, 4, 1))), by=["x", "y"])
    assert near.df.first().f == 220.0
    assert cube(spark).curry(2).resample(BinGrid((BinAxis(0, 2, 2), BinAxis(0, 2, 1)))).uncurry().count() == 8
    flat = FDataset(ds.df.drop("z"), ["x", "y"], ["f"])
    assert flat.bounding_box((0, 0), (4, 1), (2, 1)).count() == 2


@settings(max_examples=8, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.integers(1, 9), st.integers(1, 5))
def test_cube_has_every_voxel(spark, nx, ny, nz, parts):
    assert generator.cube(spark, nx, ny, nz, parts).count() == nx * ny * nz


def test_cube_values(spark):
    assert [r.value for r in generator.cube(spark, 2, 2, 1).collect()] == [3.0, 2.0, 4.0, 1.0]
    assert [r.value for r in generator.cube(spark, 1, 1, 3).collect()] == [0.0, 0.5, 1.0]
    with pytest.raises(ValueError):
        generator.cube(spark, 0, 1, 1)


def test_geostationary_places(spark):
    places = spark.createDataFrame([(41.0, -109.0), (48.2, 16.37), (51.51, 0.13)], "lat double, lon double")
    assert [r[0] for r in places.select(geo.is_visible("lat", "lon")).collect()] == [True, False, True]
    spots = {(0.0, 0.0): (2711.5, 5406), (0.0, -90.0): (2711.5, 1893), (40.0, -115.0): (822, 1261), (-40.0, -115.0): (4600, 1261)}
    for (lat, lon), want in spots.items():
        assert geo.index_of(lat, lon) == pytest.approx(want, abs=1)
    for lat, lon in ((0.1807, -78.47), (41.0, -109.0), (33.846162, -84.690932)):
        row, col = geo.geo_to_index(lat, lon)
        there = spark.range(1).select(row.alias("r"), col.alias("c"))
        assert there.select(*geo.index_to_geo("r", "c")).first() == pytest.approx((lat, lon), abs=1e-6)
        assert there.first() == pytest.approx(geo.index_of(lat, lon), abs=1e-6)
    with pytest.raises(ValueError):
        geo.index_of(0.0, 100.0)


def test_geodesics():
    # A published line: from 37 57 03.72030 S 144 25 29.52440 E, azimuth 306 52 05.37, 54972.271 m, to 37 39 10.15610 S 143 55 35.38390 E.
    degrees = lambda d, m, s: d + m / 60 + s / 3600
    start, end = (degrees(144, 25, 29.52440), -degrees(37, 57, 3.72030)), (degrees(143, 55, 35.38390), -degrees(37, 39, 10.15610))
    assert geodesy.direct(*start, degrees(306, 52, 5.37), 54972.271) == (pytest.approx(end[0], abs=2e-8), pytest.approx(end[1], abs=2e-8))
    azimuth, distance = geodesy.inverse(*start, *end)
    assert azimuth % 360 == pytest.approx(degrees(306, 52, 5.37), abs=2e-6) and distance == pytest.approx(54972.271, abs=2e-3)
    # A quarter of the equator.
    lon, lat = geodesy.direct(0.0, 0.0, 90.0, np.pi / 2 * geodesy.A)
    assert (lon, lat) == (pytest.approx(90.0, abs=1e-9), pytest.approx(0.0, abs=1e-9))
    a, d = geodesy.inverse(*geodesy.ORIGIN, *geodesy.direct(*geodesy.ORIGIN, np.array([30.0, 200.0]), np.array([1234.5, 300.0])))
    assert a % 360 == pytest.approx([30.0, 200.0], abs=1e-6) and d == pytest.approx([1234.5, 300.0], abs=1e-6)
    assert geodesy.inverse(1.0, 2.0, 1.0, 2.0)[1] == 0


def test_intensities(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 1.0, 2.0, 4.0, float("nan"))], "v double")
    assert image.percentiles(df, {"v": [0.5, 0.0, 1.0]}) == {"v": [1.5, 0.0, 4.0]}
    assert image.percentiles(df.limit(0), {"v": [0.5]}) == {"v": [None]}
    with pytest.raises(ValueError):
        image.percentiles(df, {"v": [1.5]})
    assert [r.v for r in image.with_stretch(df, ["v"], 0.0).collect()][:4] == [0.0, 0.25, 0.5, 1.0]
    assert [r[0] for r in df.select(image.to_byte("v", 0, 4)).limit(4).collect()] == [-128, -64, 0, 127]
    assert [r[0] for r in df.select(image.to_level("v", 0, 4)).collect()] == [0, 63, 127, 255, 0]
    assert df.select(image.rescale("v", 1, 1, 5, 9)).first()[0] == 5.0
    assert spark.range(1).select(image.packed_argb(F.lit(255), F.lit(0), F.lit(0))).first()[0] == -65536
    with pytest.raises(ValueError):
        image.with_stretch(df, ["v"], 0.5)


def test_images(spark, tmp_path):
    rows = [(x, y, x, y, 0.5) for x in (0.0, 0.5, 1.0) for y in (0.0, 0.5) if (x, y) != (0.5, 0.5)]
    ds = FDataset(spark.createDataFrame(rows, "x double, y double, r double, g double, b double"), ["x", "y"], ["r", "g", "b"])
    px = image_sink.pixels(ds)
    assert px.shape == (2, 3, 3) and px[0, 1].tolist() == [0, 0, 0] and px[1, 2].tolist()[:2] == [255, 0]
    image_sink.write(ds, str(tmp_path / "a.png"))
    data = (tmp_path / "a.png").read_bytes()
    assert data[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">II", data[16:24]) == (3, 2)
    assert len(zlib.decompress(data[41 : 41 + struct.unpack(">I", data[33:37])[0]])) == 2 * (1 + 9)
    colours = FDataset(spark.createDataFrame([(0, 0, -65536), (0, 1, -1)], "a int, b int, c int"), ["a", "b"], ["c"])
    assert image_sink.pixels(colours).tolist() == [[[255, 0, 0], [255, 255, 255]]]
    assert image_sink.encode(colours, "bmp")[:2] == b"BM"
    with pytest.raises(ValueError):
        image_sink.pixels(cube(spark))


def test_geotiff(spark):
    rows = [(40.0 + i, -104.0 + j, i, j, 127) for i in range(2) for j in range(3)]
    ds = FDataset(spark.createDataFrame(rows, "lat double, lon double, r int, g int, b int"), ["lat", "lon"], ["r", "g", "b"])
    about = image_sink.geo_extent(ds).first()
    assert (about.min_lon, about.min_lat, about.max_lon, about.max_lat) == (-104.5, 39.5, -101.5, 41.5)
    data = image_sink.geotiff(ds)
    n = struct.unpack("<H", data[8:10])[0]
    tags = {struct.unpack("<H", data[10 + 12 * i : 12 + 12 * i])[0]: struct.unpack("<I", data[18 + 12 * i : 22 + 12 * i])[0] for i in range(n)}
    assert (tags[256], tags[257], tags[279]) == (3, 2, 18)
    assert list(data[tags[273] :][:9]) == [1, 0, 127, 1, 1, 127, 1, 2, 127]
    assert struct.unpack("<6d", data[tags[33922] :][:48])[3:5] == (-104.5, 41.5)
    with pytest.raises(ValueError):
        image_sink.geotiff(ds.filter("lat = 40 and lon = -104"))


def test_text(spark, tmp_path):
    lines = text.encode(cube(spark)).decode().splitlines()
    assert lines[0] == "cube: (x, y, z) -> (v)" and lines[1] == "(0, 0, 0) -> (0.0)" and len(lines) == 25
    text.write(cube(spark).curry(2), str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 6


def test_grammar():
    for op in query.OPERATORS:
        for text in (f"ix{op}3", f"ix {op} 3", f" ix{op}'3' "):
            assert query.parse(text) == ("select", "ix", op, "3"), text
    assert query.parse("a!=~x.*y") == ("select", "a", "!=~", "x.*y")
    assert query.parse("a.b == 'c d'") == ("select", "a.b", "==", "c d")
    assert query.parse("a = 'x, (y)'") == ("select", "a", "=", "x, (y)")
    assert query.parse("t>=2020-01-01T00:00:00.5") == ("select", "t", ">=", "2020-01-01T00:00:00.5")
    assert query.parse("uncurry()") == ("call", "uncurry", []) and query.parse("f( )") == ("call", "f", [])
    assert query.parse("gbox(-110,10, -80,35)") == ("call", "gbox", ["-110", "10", "-80", "35"])
    assert query.parse("rename('a, b')") == ("call", "rename", ["a, b"])
    for bad in ("a=5,6", "a", "=3", "a<", "a='x", ".a=3", "a..b=3", "f(1", "f(1,)", "f(,)", "a b=3", "a=(3)", ""):
        with pytest.raises(ValueError):
            query.parse(bad)
    assert query.operations("a%3C3&&b='x&y'&c=p%26q&f()") == [("select", "a", "<", "3"), ("select", "b", "=", "x&y"), ("select", "c", "=", "p&q"), ("call", "f", [])]


def test_requests(spark, tmp_path):
    catalog = Catalog(spark)
    catalog.register("cube", cube)
    assert query.run_query("/dap/cube.txt?x>0&stride(1,1,2)", catalog)[0].count() == 8
    assert query.respond("cube.txt?take(1)", catalog).decode().splitlines()[1] == "(0, 0, 0) -> (0.0)"
    assert query.respond("cube.png?rgbImagePivot(0,1,2)", catalog)[:4] == b"\x89PNG"
    with pytest.raises(ValueError):
        query.run_query("cube?nothing()", catalog)
    with pytest.raises(LookupError):
        catalog.get("other")
    (tmp_path / "d.json").write_text('{"id": "orders", "uri": "/root/testdata/sf0.001/orders.parquet", "domain": ["o_orderkey"], "range": ["o_totalprice"]}')
    assert catalog.get(catalog.describe(str(tmp_path / "d.json"))).count() == 1500
    catalog.add(cube(spark))
    assert spark.sql("select count(*) from cube").first()[0] == 24


def test_sections():
    assert sections.spell(sections.with_stride(sections.parse("0:9:3, 1:4:2"), (2, 2))) == "0:6:6,1:1:4"
    assert sections.Range(1, 4, 2).every(1).last == 3 and sections.whole((3, 4))[1].count == 4
    with pytest.raises(ValueError):
        sections.with_stride(sections.parse("0:9"), (1, 2))
    assert netcdf.parse_uri("f.nc!/v#(0,0:2029:5,0:1353:5)")[:2] == ("f.nc", "v")
    assert netcdf.parse_uri("f.nc!/v") == ("f.nc", "v", None) and netcdf.parse_uri("f.nc")[:2] == ("f.nc", "")


def test_netcdf_plans_its_tasks():
    from pyspark.sql.types import StructType

    reader = netcdf._Reader({"path": "f.nc!/v#(3,0:5423:1,0:5423:1)", "stride": "1,2,2"}, StructType.fromDDL("y int, x int, v double"))
    parts = reader.partitions()
    assert len(parts) > 1 and parts[0].section.startswith("3:3:1,0:") and parts[0].section.endswith("0:5422:2")
    rows = sum(sections.parse(p.section)[1].count for p in parts)
    assert rows == 2712


def test_matrices(spark, tmp_path):
    for i in range(1, 4):
        (tmp_path / f"img{i:04d}.txt").write_text("\n".join(",".join(str(100 * i + 10 * r + c) for c in range(3)) for r in range(2)) + "\n")
    (tmp_path / "w.txt").write_text("900.0, 800.0, 700.0\n1,2,3\n")
    base = f"file://{tmp_path}"
    assert granules.numbered(spark, base, 3).df.orderBy("ix").first().uri.endswith("img0001.txt")
    ds = matrix.index_cube(spark, base, 3, 2)
    assert ds.count() == 12 and ds.eval(2, 1, 2).df.first().radiance == 312.0
    full = matrix.cube(spark, base, f"{base}/w.txt", 3)
    assert full.domain == ["x", "y", "wavelength"] and full.select("wavelength = 700").count() == 6
    assert matrix.image(spark, f"{base}/img0001.txt").count() == 6
    assert matrix.named_cube(spark, base, 1, 3).count() == 6
    listing = granules.from_listing(granules.list_files(spark, str(tmp_path)), r".*/img(?<num>\d{4})\.txt")
    assert [(r["index"], r.num) for r in listing.df.orderBy("index").collect()] == [(0, "0001"), (1, "0002"), (2, "0003")]


def test_readers_in_place(spark):
    lists = granules.listed(spark, [(1.0, "a"), (2.0, "b")])
    read = lambda df: df.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("v", F.concat("uri", "i"))
    ds = granules.with_reader(lists.select("wavelength > 1"), read, ["i"], ["v"])
    assert ds.domain == ["wavelength", "i"] and ds.count() == 3
    raw = spark.createDataFrame([(10.0,), (40000.0,)], "c double")
    got = [r.c for r in netcdf.calibrated(raw, "c", 2.0, 1.0).collect()]
    assert got[0] == 18.0 and math.isnan(got[1])


def test_track(spark):
    ds = FDataset(spark.createDataFrame([("a", float(x), float(x**3)) for x in range(6)], "k string, x double, v double"), ["k", "x"], ["v"])
    got = [r.slope for r in track.slopes(ds, "v").df.orderBy("x").collect()]
    assert got == [4.0, 4.0, 13.0, 28.0, 49.0, 49.0]
    assert track.polynomial(ds.df, "x", "v") == pytest.approx([1, 0, 0, 0], abs=1e-6)
    far = ds.df.selectExpr("x + 1000 as x", "2 * pow(x, 3) - x as v")
    at = lambda x: np.polyval(track.polynomial(far, "x", "v"), x)
    assert [at(1000 + x) for x in (0.0, 2.5, 5.0)] == pytest.approx([0.0, 28.75, 245.0], abs=0.01)
    part = spark.createDataFrame([(3.3,), (10.0,), (None,)], "d double").select(track.range_partition(F.col("d"), 10, 0.0, 10.0))
    assert [r[0] for r in part.collect()] == [3, 9, 9]


def test_partitions_and_caches(spark):
    assert cube(spark).partition_by_range(3).df.rdd.getNumPartitions() <= 3
    assert cube(spark).partition_by_set(BinAxis(0, 1, 3), 4).count() == 24
    cached = cube(spark).cached()
    assert cached.count() == 24
    cached.df.unpersist()


def test_streams(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    ds = stateless.as_function(stream, ["ts"], ["event_id", "value", "user_id"]).select("value > 50")
    names = FDataset(spark.range(1000).select(F.col("id").alias("user_id"), (F.col("id") * 2).alias("twice")), ["user_id"], ["twice"])
    joined = FDataset(ds.df, ["ts", "user_id"], ["value"]).substitute(names).df.withColumn("n", F.lit(1))
    q = joined.writeStream.format("memory").queryName("prismal_rows").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("prismal_rows").count() == src.filter("value > 50 and user_id < 1000").count()
    bins = stateless.binned(stream, "ts", "1 hour", "1 minute", {"n": F.count(F.lit(1))})
    q = bins.df.writeStream.format("memory").queryName("prismal_bins").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("prismal_bins").agg(F.sum("n")).first()[0] == src.count()


def test_percentiles_in_passes(spark, monkeypatch):
    monkeypatch.setattr(image, "SORTED", 50)
    monkeypatch.setattr(image, "RANGES", 8)
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.normal(size=900), np.full(700, 0.25), [1e9, -1e9, 5e-324, 0.0]])
    df = spark.createDataFrame([(float(v), float(-v)) for v in values], "v double, w double")
    ps = [0.0, 0.03, 0.3, 0.5, 0.77, 0.97, 1.0]
    got = image.percentiles(df, {"v": ps, "w": ps})
    assert got["v"] == pytest.approx(np.quantile(values, ps)) and got["w"] == pytest.approx(np.quantile(-values, ps))


def test_ranks(spark):
    from prismal.operators.ranks import ranked

    rows = ranked(spark.range(0, 3000, 3).repartition(5), "id", "at").collect()
    assert all(r.id == 3 * r["at"] for r in rows) and len(rows) == 1000
    ds = FDataset(spark.createDataFrame([(float(x * x), y) for x in range(40) for y in range(2)], "x double, y int"), ["x"], ["y"])
    assert sorted({r.x for r in ds.stride(7, index=False).df.collect()}) == [float(x * x) for x in range(0, 40, 7)]


def test_neighbours_over_ranges(spark):
    """One key in many ranges, places beyond and between them, keys without samples and samples without places."""
    rng = np.random.default_rng(9)
    xs = {"a": np.unique(rng.uniform(0, 100, 400)), "b": np.array([50.0]), "c": np.unique(rng.uniform(40, 41, 50))}
    ds = FDataset(spark.createDataFrame([(k, float(x), float(x) ** 2) for k, v in xs.items() for x in v], "k string, x double, v double"), ["k", "x"], ["v"])
    places = [(k, float(p)) for k in ("a", "b", "c", "d") for p in (*rng.uniform(-10, 110, 30), 50.0)]
    at = spark.createDataFrame(places, "k string, p double")
    near = {(r.k, r.p): r.v for r in ds.nearest(at, "p").df.collect()}
    line = {(r.k, r.p): r.v for r in ds.linear(at, "p").df.collect()}
    assert set(near) == set(line) == set(places)
    for k, p in places:
        x = xs.get(k)
        if x is None:
            assert near[k, p] is None and line[k, p] is None
            continue
        assert near[k, p] == x[np.abs(x - p).argmin()] ** 2
        inside = x[0] <= p <= x[-1]
        assert line[k, p] == (pytest.approx(np.interp(p, x, x**2)) if inside else None)


def test_images_are_evaluated_between_pixels(spark):
    ds = FDataset(spark.createDataFrame([(x / 2, 10.0 * y, x + 100.0 * y) for x in range(4) for y in range(3) if (x, y) != (3, 2)], "x double, y double, v double"), ["x", "y"], ["v"])
    grid = BinGrid((BinAxis(0.0, 0.5, 4), BinAxis(0.0, 10.0, 3)))
    at = spark.createDataFrame([(0.25, 5.0), (1.5, 10.0), (1.25, 15.0), (0.0, 20.0), (1.6, 0.0), (-0.1, 0.0), (1.0, 20.1)], "p double, q double")
    assert {tuple(r)[:2]: r.v for r in ds.bilinear(at, ("p", "q"), grid).df.collect()} == {(0.25, 5.0): 50.5, (1.5, 10.0): 103.0, (1.25, 15.0): None, (0.0, 20.0): 200.0, (1.6, 0.0): None, (-0.1, 0.0): None, (1.0, 20.1): None}
    assert {tuple(r)[:2]: r.v for r in ds.nearest_2d(at, ("p", "q"), grid).df.collect()} == {(0.25, 5.0): 101.0, (1.5, 10.0): 103.0, (0.0, 20.0): 200.0, (1.6, 0.0): 3.0, (-0.1, 0.0): 0.0, (1.0, 20.1): 202.0}


def test_transforms(spark):
    rows = spark.createDataFrame([(1200.0, 900.0), (2711.5, 2711.5), (3000.0, 4000.0)], "ix double, iy double")
    both = transforms.GEOSTATIONARY_INDEX.then(transforms.GEOSTATIONARY)
    lon, lat = both(F.col("ix"), F.col("iy"))
    there = rows.select("*", lon.alias("lon"), lat.alias("lat"))
    back = both.inverse(F.col("lon"), F.col("lat"))
    for r in there.select("*", back[0].alias("a"), back[1].alias("b")).collect():
        assert (r.a, r.b) == pytest.approx((r.ix, r.iy), abs=1e-6)
    scene = transforms.PUSHBROOM_INDEX.then(transforms.PUSHBROOM)
    lon, lat = scene(F.col("ix"), F.col("iy"))
    a, b = scene.inverse(F.col("lon"), F.col("lat"))
    for r in rows.select("*", lon.alias("lon"), lat.alias("lat")).select("*", a.alias("a"), b.alias("b")).collect():
        assert (r.a, r.b) == pytest.approx((r.ix, r.iy), abs=1e-4)
    track_lon, track_lat = transforms.STRAIGHT_TRACK(F.col("iy"), F.col("ix"))
    assert rows.select(track_lon, track_lat).first()[0] == pytest.approx(geodesy.ORIGIN[0], abs=0.3)
    with pytest.raises(ValueError):
        transforms.STRAIGHT_TRACK.inverse  # noqa: B018
    with pytest.raises(ValueError):
        cube(spark).geo_subset((0, 0), (1, 1), 4)


def test_subsets_by_place(spark):
    rows = [(x / 100, y / 100, w, 100.0 * x + 10 * y + w) for x in range(-5, 6) for y in range(-5, 6) for w in (1, 2)]
    ds = FDataset(spark.createDataFrame(rows, "x double, y double, w int, v double"), ["x", "y", "w"], ["v"], "geostationary a")
    out = ds.geo_subset((-100.0, -30.0), (-50.0, 30.0), 30)
    places = ds.transformed(transforms.GEOSTATIONARY).df.select("lon", "lat").collect()
    cells = {(math.floor((r.lon + 100) / 10), math.floor((r.lat + 30) / 10)) for r in places if -100 <= r.lon < -50 and -30 <= r.lat < 30}
    assert out.nested is not None and out.domain == ["lon", "lat"] and out.count() == len(cells) > 10
    assert all([s.w for s in r.samples] == [1, 2] for r in out.df.collect())
    there = ds.transformed(transforms.GEOSTATIONARY)
    assert sorted(map(repr, there.geo_subset((-100.0, -30.0), (-50.0, 30.0), 30).df.collect())) == sorted(map(repr, out.df.collect()))
    table = FDataset(spark.createDataFrame([(x, y, 10.0 + x, 20.0 + y) for x in range(3) for y in range(2)], "x int, y int, lon double, lat double"), ["x", "y"], ["lon", "lat"])
    swath = cube(spark)
    assert swath.geo_subset((10.0, 20.0), (13.0, 22.0), 6, table).count() == 6
    nested = swath.group_by_variable("z", "x", "y").curry(1)
    placed = nested.substitute_nested(table)
    assert placed.nested.domain == ["lon", "lat"] and placed.domain == ["z"]
    assert {tuple(s) for s in placed.ordered().df.first().samples} == {(10.0 + x, 20.0 + y, 100.0 * x + 10 * y) for x in range(3) for y in range(2)}
    with pytest.raises(ValueError):
        swath.substitute_nested(table)


def test_samples_settings_and_notebooks(spark):
    ds = FDataset.from_samples(spark, [(i, float(i)) for i in range(50)], "a int, b double", 1, "local")
    assert ds.domain == ["a"] and ds.count() == 50 and ds.df.rdd.getNumPartitions() > 1
    assert FDataset.from_samples(spark, [], "a int, b double", 1).count() == 0
    assert config.get(spark, "swath.stride") == "1"
    spark.conf.set("spark.prismal.swath.stride", "5")
    assert config.get(spark, "swath.stride") == "5"
    spark.conf.unset("spark.prismal.swath.stride")
    with pytest.raises(KeyError):
        config.get(spark, "nothing")
    assert cube(spark)._repr_png_() is None
    picture = FDataset(spark.createDataFrame([(0, 0, -1), (0, 1, -65536)], "x int, y int, c int"), ["x", "y"], ["c"])
    assert picture._repr_png_()[:4] == b"\x89PNG"
    sums = FDataset(spark.createDataFrame([("a", "x", 1.0), ("a", "x", 2.0), ("b", "y", 5.0)], "k string, c string, v double"), ["k", "c"], ["v"])
    assert {r.k: (r.x, r.y) for r in sums.pivot(["x", "y"], ["x", "y"], agg=F.sum).df.collect()} == {"a": (3.0, None), "b": (None, 5.0)}
    first = cube(spark).cached()
    catalog = Catalog(spark)
    catalog.add(first)
    catalog.add(cube(spark))
    assert not first.df.is_cached


def test_text_comes_in_chunks(spark):
    parts = list(text.stream(cube(spark), size=100))
    assert len(parts) > 4 and b"".join(parts) == text.encode(cube(spark))


def test_images_with_holes_tiles_and_formats(spark, monkeypatch):
    rows = [(x, y, 10 * x, y, 255) for x in range(4) for y in range(3) if (x + y) % 3]
    ds = FDataset(spark.createDataFrame(rows, "x int, y int, r int, g int, b int"), ["x", "y"], ["r", "g", "b"])
    full = {(r.x, r.y): (r.r, r.g, r.b) for r in image_sink.grid(ds).collect()}
    assert len(full) == 12 and full[0, 0] == (0.0, 0.0, 0.0) and full[3, 1] == (30.0, 1.0, 255.0)
    drawn = image_sink.tiles(ds, 2).collect()
    assert {(r.tile_x, r.tile_y) for r in drawn} == {(0, 0), (0, 1), (1, 0), (1, 1)} and all(r.png[:4] == b"\x89PNG" for r in drawn)
    gif = image_sink.encode(ds, "gif")
    assert gif[:6] == b"GIF87a" and struct.unpack("<HH", gif[6:10]) == (4, 3) and gif[-1:] == b";"
    assert image_sink.encode(ds, "wbmp")[:4] == b"\0\0\4\3"
    monkeypatch.setattr(image_sink, "MAX_PIXELS", 11)
    with pytest.raises(ValueError):
        image_sink.grid(ds)


def test_gif_pixels():
    data = np.zeros((7, 90, 3), np.uint8)
    data[2, 5], data[6, 89] = (255, 0, 0), (255, 255, 255)
    raw = image_sink.gif(data)
    palette, at, packed = raw[13 : 13 + 768], 13 + 768 + 11, b""
    while raw[at]:
        packed += raw[at + 1 : at + 1 + raw[at]]
        at += 1 + raw[at]
    bits = np.unpackbits(np.frombuffer(packed, np.uint8), bitorder="little")
    codes = [int((bits[i : i + 9] * (1 << np.arange(9))).sum()) for i in range(0, len(bits) // 9 * 9, 9)]
    colours = [tuple(palette[3 * c : 3 * c + 3]) for c in codes if c < 256]
    assert len(colours) == 630 and colours[2 * 90 + 5] == (255, 0, 0) and colours[-1] == (255, 255, 255) and colours[0] == (0, 0, 0)


def test_uris(tmp_path):
    assert store.parse("/a/b.nc") == ("file", "", "/a/b.nc") and store.parse("file:///a/b%20c") == ("file", "", "/a/b c")
    assert store.parse("s3://bucket/some/key.nc") == ("s3", "bucket", "some/key.nc")
    for bad in ("", "s3://bucket", "s3:///key"):
        with pytest.raises(ValueError):
            store.parse(bad)
    (tmp_path / "x.bin").write_bytes(bytes(range(256)) * 40)
    chunks = list(store.stream(f"file://{tmp_path}/x.bin"))
    assert [len(c) for c in chunks] == [4096, 4096, 2048] and b"".join(chunks) == bytes(range(256)) * 40
    assert store.local_copy("https://a/b.nc") == "https://a/b.nc" and store.local_copy(str(tmp_path / "x.bin")) == str(tmp_path / "x.bin")


def test_listing_of_a_store(spark, tmp_path):
    for name in ("test000", "test001", "fake"):
        (tmp_path / "test").mkdir(exist_ok=True)
        (tmp_path / "test" / name).write_text("x")
    store.connect(spark, "http://localhost:1", "nowhere")
    keys = store.listing(spark, f"file://{tmp_path}")
    assert {r.key for r in keys.collect()} == {"test/test000", "test/test001", "test/fake"}
    found = granules.from_listing(keys, r"test/test(?<num>\d{3})", "test/", key="key").df.collect()
    assert {(r["index"], r.key, r.num) for r in found} == {(0, "test/test000", "000"), (1, "test/test001", "001")}


def arrays_file(path, k):
    y, x = np.linspace(0.02, -0.02, 5), np.linspace(-0.03, 0.03, 7)
    np.savez(path, Rad=np.arange(35.0).reshape(5, 7) + 100 * k, y=y, x=x, bands=np.arange(70.0).reshape(2, 5, 7), longitude=np.add.outer(np.arange(5.0), np.arange(7.0) / 10), latitude=np.subtract.outer(np.arange(5.0), np.arange(7.0) / 10))
    return y, x


def test_granules_are_read(spark, tmp_path, monkeypatch):
    y, x = arrays_file(tmp_path / "a.npz", 0)
    arrays_file(tmp_path / "b.npz", 1)
    whole = netcdf.image(spark, f"{tmp_path}/a.npz!/Rad", names=("iy", "ix"))
    assert whole.count() == 35 and whole.eval(4, 6).df.first().radiance == 34.0
    part = netcdf.image(spark, f"{tmp_path}/a.npz!/bands#(1,0:4:2,0:6:1)", stride=(1, 1, 3), names=("iy", "ix"))
    assert {tuple(r) for r in part.df.collect()} == {(i, j, 35.0 + 14 * i + 3 * j) for i in range(3) for j in range(3)}
    monkeypatch.setattr(netcdf, "TASK_CELLS", 10)
    monkeypatch.setattr(netcdf, "BATCH_ROWS", 4)
    uris = granules.listed(spark, [(1.0, f"file://{tmp_path}/a.npz"), (2.0, f"{tmp_path}/b.npz!/Rad#(0:4:4,0:6:6)")])
    got = netcdf.read_granules(uris, ("iy", "ix"), variable="Rad")
    assert {tuple(r) for r in got.df.collect()} == {(1.0, i, j, 7.0 * i + j) for i in range(5) for j in range(7)} | {(2.0, i, j, 100 + 28.0 * i + 6 * j) for i in (0, 1) for j in (0, 1)}
    assert sorted(granules.with_reader(uris, lambda g: netcdf.read_granules(g, ("iy", "ix"), variable="Rad")).df.collect()) == sorted(got.df.collect())
    placed = readers.geostationary(spark, uris, section="(0:4:2,0:6:3)", cache=False)
    assert placed.domain == ["x", "y", "wavelength"] and placed.id == "geostationary"
    want = {(x[j], y[i], 1.0, 7.0 * i + j) for i in (0, 2, 4) for j in (0, 3, 6)} | {(x[j], y[i], 2.0, 100 + 7.0 * i + j) for i in (0, 4) for j in (0, 6)}
    assert {tuple(r) for r in placed.df.collect()} == want
    assert placed.geo_subset((-120.0, -60.0), (-30.0, 60.0), 6).count() > 0
    bands = granules.sections(spark, f"{tmp_path}/a.npz", [(1, "bands", 0), (13.5, "bands", 1)], rows=5, columns=7, stride=2)
    table = netcdf.geolocation(spark, f"{tmp_path}/a.npz", "0:4:2,0:6:2")
    swath = readers.swath(spark, bands, table)
    assert swath.count() == 24 and swath.domain == ["band", "longitude", "latitude"]
    assert swath.release().df.filter("band = 13.5").agg(F.max("radiance")).first()[0] == 69.0
    for bad in (f"{tmp_path}/none.npz!/Rad", None):
        with pytest.raises(Exception, match="can't open|without a uri"):
            netcdf.read_granules(FDataset(spark.createDataFrame([(1.0, bad)], "w double, uri string"), ["w"], ["uri"]), ("iy", "ix")).count()


def test_channels_are_found(spark, tmp_path):
    for n in (4, 6, 99):
        arrays_file(tmp_path / f"OR_ABI-L1b-RadF-M3C{n:02d}_s1.npz", n)
    found = readers.geostationary_granules(spark, f"file://{tmp_path}", "OR_ABI-L1b-RadF-M3C%02d_*.npz")
    assert {(r.wavelength, r.uri.rpartition("/")[2]) for r in found.df.collect()} == {(1370.0, "OR_ABI-L1b-RadF-M3C04_s1.npz"), (2200.0, "OR_ABI-L1b-RadF-M3C06_s1.npz")}


def test_matrices_of_equal_names(spark, tmp_path):
    for folder in ("a b", "c+d"):
        (tmp_path / folder).mkdir()
        for i in (1, 2):
            (tmp_path / folder / f"img{i:04d}.txt").write_text(f"{i},{len(folder)}\n")
    base = str(tmp_path / "a b")
    ds = matrix.index_cube(spark, base, 2)
    assert {tuple(r) for r in ds.df.collect()} == {(0, 0, 0, 1.0), (0, 0, 1, 3.0), (1, 0, 0, 2.0), (1, 0, 1, 3.0)}
    assert matrix.index_cube(spark, f"file://{tmp_path}/c+d", 2).count() == 4
    (tmp_path / "wavelength.txt").write_text("700.0,650.0\n")
    full = readers.pushbroom(spark, str(tmp_path / "c+d"), "../wavelength.txt", 2)
    assert full.domain == ["x", "y", "wavelength"] and full.count() == 4
    full.release()


def test_formats_are_read_by_another_library(spark):
    rng = np.random.default_rng(1)
    smooth = np.stack([np.add.outer(np.arange(37) * 3, np.arange(21) * 4), np.full((37, 21), 120), np.subtract.outer(np.full(37, 200), np.arange(21) * 5)], 2).astype(np.uint8)
    noisy = rng.integers(0, 256, (16, 40, 3)).astype(np.uint8)
    for data in (smooth, noisy, smooth[:1, :1]):
        for maker, most in ((image_sink.png, 0), (image_sink.bmp, 0), (image_sink.gif, 26), (image_sink.jpeg, 14 if data is not noisy else 45)):
            stream = spark._jvm.java.io.ByteArrayInputStream(bytearray(maker(data)))
            found = spark._jvm.javax.imageio.ImageIO.read(stream)
            assert (found.getWidth(), found.getHeight()) == (data.shape[1], data.shape[0]), maker
            for y in range(0, data.shape[0], 3):
                for x in range(0, data.shape[1], 4):
                    c = found.getRGB(x, y)
                    assert np.abs(np.array([c >> 16 & 255, c >> 8 & 255, c & 255]) - data[y, x].astype(int)).max() <= most, (maker, x, y)
