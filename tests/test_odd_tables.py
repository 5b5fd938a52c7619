"""Queries over tables that aren't one whole rectangle in one sorted file, against their SQL."""

import duckdb
import oracle
import pytest

from prismal import FDataset, workloads
from prismal.sinks import image as image_sink
from prismal.sources import granules, netcdf


def vectors(spark, folder, ids, files=3, label=lambda i: i % 10):
    rows = [(i, [float(i * 7 % 101 + k) for k in range(64)], label(i)) for i in ids]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(files).write.parquet(f"{folder}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{folder}/embeddings.parquet/*.parquet'")
    return con


def check(spark, con, folder, name):
    oracle.check(spark, con, str(folder), workloads.QUERIES[name], workloads.ORACLES[name])


@pytest.mark.parametrize("ids", [range(57), [3], [900, 5, 41]])
def test_bands_of_a_folder(spark, tmp_path, ids):
    check(spark, vectors(spark, tmp_path, ids), tmp_path, "granule_images")


def test_columns_of_tables_are_cut_like_arrays(spark, tmp_path):
    folder = str(tmp_path / "t.parquet")
    for k in range(3):
        spark.createDataFrame([(10 * k + i, [1000.0 * k + 10 * i + j for j in range(4)]) for i in range(5)], "n long, v array<double>").coalesce(1).write.mode("append").parquet(folder)
    ordered = [r for f in sorted(tmp_path.joinpath("t.parquet").glob("*.parquet")) for r in duckdb.sql(f"from '{f}'").fetchall()]
    uris = granules.listed(spark, [(1.0, f"{folder}!/v"), (2.0, f"{folder}!/v#(1:14:3,0:3:2)"), (3.0, f"{folder}!/v#(4:4:1,2:2:1)")])
    want = {(1.0, i, j, r[1][j]) for i, r in enumerate(ordered) for j in range(4)} | {(2.0, i, j, r[1][2 * j]) for i, r in enumerate(ordered[1::3]) for j in (0, 1)} | {(3.0, 0, 0, ordered[4][1][2])}
    assert {tuple(r) for r in netcdf.read_granules(uris, ("i", "j")).df.collect()} == want
    whole = netcdf.image(spark, f"{folder}!/v#(0:0:1,0:0:1)", section="(0:14:1,3:3:1)", names=("i",))
    assert {tuple(r) for r in whole.df.collect()} == {(i, r[1][3]) for i, r in enumerate(ordered)}
    numbers = netcdf.image(spark, f"{folder}!/n", stride=(2,), names=("i",))
    assert {tuple(r) for r in numbers.df.collect()} == {(i, float(r[0])) for i, r in enumerate(ordered[::2])}
    for bad in (f"{folder}!/w", f"{tmp_path}/none.parquet!/v", f"{folder}!/v#(0:1:1)"):
        with pytest.raises(ValueError):
            netcdf.image(spark, bad, names=("i",))


@pytest.mark.parametrize("ids", [range(57), [3], [900, 5, 41]])
def test_swath_of_a_folder(spark, tmp_path, ids):
    check(spark, vectors(spark, tmp_path, ids), tmp_path, "swath_reader")


@pytest.mark.parametrize("ids", [range(57), [900, 5, 41]])
def test_packed_image_lacks_pixels(spark, tmp_path, ids):
    check(spark, vectors(spark, tmp_path, ids), tmp_path, "packed_pixels")


def test_missing_pixels_are_black(spark):
    colours = FDataset(spark.createDataFrame([(0, 0, -65536), (2, 0, None), (2, 5, -1), (None, 5, -1)], "a int, b int, c int"), ["a", "b"], ["c"])
    assert image_sink.pixels(colours).tolist() == [[[255, 0, 0], [0, 0, 0]], [[0, 0, 0], [255, 255, 255]]]
    corners = FDataset(spark.createDataFrame([(40.0, 7.0, 1, 2, 3), (41.0, 8.0, 4, 5, 6), (40.0, 8.0, 7, 8, 9)], "lat double, lon double, r int, g int, b int"), ["lat", "lon"], ["r", "g", "b"])
    assert image_sink.geotiff(corners)[-12:] == bytes([0, 0, 0, 4, 5, 6, 1, 2, 3, 7, 8, 9])


@pytest.mark.parametrize("ids", [range(57), [900, 5, 41]])
def test_levels_of_an_image_that_lacks_pixels(spark, tmp_path, ids):
    check(spark, vectors(spark, tmp_path, ids), tmp_path, "image_levels")


def test_first_of_a_cell_beyond_a_turn(spark, tmp_path):
    check(spark, vectors(spark, tmp_path, [*range(300), *range(75640, 75660)]), tmp_path, "geo_subset")


def test_spectrum_of_a_cell_beyond_a_turn(spark, tmp_path):
    check(spark, vectors(spark, tmp_path, [*range(300), *range(75640, 75660)]), tmp_path, "geo_subset_spectra")


def test_angles_keep_their_turn(spark, tmp_path):
    check(spark, vectors(spark, tmp_path, [*range(300), *range(50900, 51000), 150580]), tmp_path, "transform_pair")


def test_no_task_sees_all_that_drop_leaves(spark):
    rows = [(i % 7, None if i % 3 == 0 else float(i % 3)) for i in range(100)]
    ds = FDataset(spark.createDataFrame(rows, "k long, v double").repartition(5), ["k"], ["v"])
    ordered = sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0.0))
    for n in (0, 1, 8, 20, 99, 100, 150):
        assert sorted(map(repr, map(tuple, ds.drop(n).df.collect()))) == sorted(map(repr, ordered[n:]))
        assert [tuple(r) for r in ds.drop(n).take(9).df.collect()] == ordered[n : n + 9]
    assert [tuple(r) for r in ds.drop(3).drop(4).take(2).df.collect()] == ordered[7:9]
    assert [r.k for r in ds.drop(20).filter("k > 3").take(2).df.collect()] == [4, 4]
    for left in (ds.drop(10), ds.drop(10).take(20)):
        left.df.collect()
        plan = left.df._jdf.queryExecution().executedPlan().toString()
        assert "GlobalLimit" not in plan and "Exchange SinglePartition" not in plan.replace("Exchange SinglePartition, EXECUTOR_BROADCAST", "")
