import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelframe import checkLoadBalancing, collapse_rdd_data, crossmatch_center, fit, knn, knn_pruned, prePartition, repartitionByCol, windowquery
from voxelframe.functions import predicates as P
from voxelframe.functions.coords import cart2sph, sph2cart
from voxelframe.functions.healpix import ang2pix_ring, to_healpix
from voxelframe.functions.sql import register
from voxelframe.operators.collapse import CollapseFunctions, collapse_kmeans, collapse_mean
from voxelframe.plans.base import sample_size
from voxelframe.shapes import Box, Point, Shell
from voxelframe.sources import generators
from voxelframe.sources.fits import write_fits
from voxelframe.sources.readers import convert, load
from voxelframe.streaming import stream_cell_counts, stream_window

OCTREE = {"geometry": "points", "colnames": "x,y,z", "coordSys": "cartesian", "gridtype": "octree"}


@pytest.mark.parametrize("kind,coord,n", [("point", [1, 1, 1], 2), ("shell", [1, 1, 1, 0, 2], 3), ("sphere", [1, 1, 1, 2], 3), ("box", [2, 0, 0, 0, 2, 0, 0, 0, 2], 2), ("sphere", [2, 1, 2, 1.8], 9)])
def test_window(spheres, kind, coord, n):
    assert windowquery(spheres.select("x", "y", "z"), kind, coord, "cartesian").count() == n


def test_window_errors_and_nulls(spark, spheres):
    xyz = spheres.select("x", "y", "z")
    for args, text in [((spheres, "point", [1, 1, 1], "cartesian"), "3 columns"), ((xyz, "point", [1, 1, 1], "polar"), "Coordinate system"), ((xyz, "cube", [1, 1, 1], "cartesian"), "windowType"), ((xyz, "box", [0] * 9, "spherical"), "cartesian")]:
        with pytest.raises(AssertionError, match=text):
            windowquery(*args)
    with pytest.raises(IndexError):
        windowquery(xyz, "sphere", [1, 1, 1], "cartesian")
    odd = spark.createDataFrame([(1, None, 1.0), (1, 1, 1.0)], "a long, b int, c float")
    out = windowquery(odd, "sphere", [1, 1, 1, 1], "cartesian")
    assert out.dtypes == [("a", "double"), ("b", "double"), ("c", "double")] and out.count() == 1


def test_box_window_is_pushed_down(spark, spheres, tmp_path):
    spheres.write.parquet(f"{tmp_path}/t")
    plan = windowquery(spark.read.parquet(f"{tmp_path}/t").select("x", "y", "z"), "sphere", [1, 1, 1, 1], "cartesian")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(x" in plan and "radius" not in plan.split("ReadSchema")[-1].split("\n")[0]


def test_knn(spark, spheres):
    xyz = spheres.select("x", "y", "z")
    assert [tuple(r) for r in knn(xyz, [0.2, 0.2, 0.2], 2, "cartesian", False).collect()] == [(1.0, 1.0, 1.0)] * 2
    assert knn(xyz, [0.2, 0.2, 0.2], 0, "cartesian", False).count() == 0
    assert knn(xyz, [0, 0, 0], 50, "cartesian", True).count() == 9  # as many as there are distinct centres
    assert knn(xyz.select(*(F.col(c).cast("int") for c in "xyz")), [0.2] * 3, 2, "cartesian").count() == 2
    with pytest.raises(AssertionError, match="3 columns"):
        knn(spheres, [0, 0, 0], 1, "cartesian")
    rows = generators.points(spark, 2000, seed=5).cache()
    for gridtype, n in (("octree", 64), ("onion", 10)):
        grid = fit(rows, OCTREE | {"gridtype": gridtype}, n)
        for p in ([0.5, 0.5, 0.5], [2.0, -1.0, 0.3]):
            want = knn(rows, p, 30, "cartesian").collect()
            assert [r[:3] for r in knn_pruned(grid.place(rows), p, 30, grid).collect()] == [tuple(r) for r in want]


def test_octree_labels(spark, spheres):
    grid = fit(spheres, OCTREE, 10)
    got = {tuple(r) for r in grid.place(spheres).select("x", "y", "z", "partition_id").collect()}
    assert grid.numPartitions == 8 and (1.0, 1.0, 3.0, 2) in got and (2.0, 2.0, 2.0, 6) in got
    near = Point(1.0, 1.0, 3.0)
    assert len(grid.neighbor_nodes(near)) == 7 and len(grid.neighbor_nodes(near, inclusive=True)) == 8
    assert all(grid.home(r[:3]) == r[3] for r in got)
    rows = generators.blobs(spark, 3000, seed=2).cache()
    deep = fit(rows, OCTREE, 512)
    for r in deep.place(rows).select("x", "y", "z", "partition_id").limit(300).collect():
        assert deep.home(r[:3]) == r[3] and any(i == r[3] and b.contains_xyz(*r[:3]) for i, b in deep.cells())


def test_octree_of_a_sample(spark):
    """A sample cuts much the same cells, and still labels every row."""
    rows = generators.blobs(spark, 30_000, seed=4).cache()
    whole, part = fit(rows, OCTREE, 512), fit(rows, OCTREE, 512, sampled=True)
    assert 0.5 < part.numPartitions / whole.numPartitions < 2 and part.place(rows).where("partition_id is null").isEmpty()
    assert fit(rows.limit(100), OCTREE, 8, sampled=True).numPartitions == fit(rows.limit(100), OCTREE, 8).numPartitions  # few rows: all of them


def test_prepartition(spark, spheres):
    o = {"geometry": "spheres", "colnames": "x,y,z,radius", "coordSys": "cartesian", "gridtype": "onion"}
    assert prePartition(spheres, o, 4).groupBy("partition_id").count().count() >= 2
    assert prePartition(spheres, o | {"gridtype": "current"}, 3).select("partition_id").distinct().count() == 3
    for bad, n, text in [(o, 0, "strictly greater"), (o | {"geometry": "boxes"}, 4, "Geometry"), (o | {"gridtype": "grid"}, 4, "Gridtype"), (o | {"coordSys": "x"}, 4, "Coordinate")]:
        with pytest.raises(AssertionError, match=text):
            prePartition(spheres, bad, n)
    empty = spheres.limit(0)
    for g in ("onion", "octree"):
        assert prePartition(empty, o | {"gridtype": g}, 8).count() == 0
    nulls = spark.createDataFrame([(None, 1.0, 1.0), (0.0, 0.0, 0.0)], "x double, y double, z double")
    for g in ("onion", "octree"):
        assert {r.partition_id is None for r in prePartition(nulls, OCTREE | {"gridtype": g}, 8).collect()} == {True, False}


def test_repartition(spark):
    df = spark.range(10).withColumn("val", (F.col("id") % 2).cast("int"))
    out = repartitionByCol(df, "val", True)
    assert out.rdd.getNumPartitions() == 2 and [len(p) for p in out.rdd.glom().collect()] == [5, 5] and out.schema == df.schema
    gaps = repartitionByCol(df.withColumn("val", F.col("val") * 3), "val", True)
    assert gaps.rdd.getNumPartitions() == 4  # largest label plus one
    words = repartitionByCol(df.withColumn("w", F.when(F.col("val") == 1, "b").otherwise(F.lit(None))), "w", False)
    assert words.rdd.getNumPartitions() == 2
    with pytest.raises(AssertionError):
        repartitionByCol(df, "val", True, 0)
    with pytest.raises(AssertionError):
        repartitionByCol(df.withColumn("val", F.lit("a")), "val", True)


def test_load(spark):
    df = spark.range(100).repartition(7)
    assert sum(r[0] for r in checkLoadBalancing(df, "frac").collect()) == pytest.approx(100)
    rows = checkLoadBalancing(spark.range(3).repartitionById(5, F.col("id").cast("int")), "size").collect()
    assert sorted((r.partition_id, r[0]) for r in rows) == [(0, 1.0), (1, 1.0), (2, 1.0), (3, 0.0), (4, 0.0)]
    for args, text in [(("x",), "kind"), (("frac", 0), "Total number")]:
        with pytest.raises(AssertionError, match=text):
            checkLoadBalancing(df, *args)


def test_crossmatch_against_brute_force(spark):
    a, b = generators.points(spark, 300, seed=1).cache(), generators.points(spark, 300, seed=9).cache()
    pa, pb = a.toPandas().to_numpy(), b.toPandas().to_numpy()
    near = np.sqrt(((pa[:, None] - pb[None]) ** 2).sum(axis=2)) <= 0.1
    assert crossmatch_center(a, b, 0.1).count() == near.sum()
    assert crossmatch_center(a, b, 0.1, "A").count() == near.any(axis=1).sum() and crossmatch_center(a, b, 0.1, "B").count() == near.any(axis=0).sum()
    assert crossmatch_center(a, a, 0.0).count() == 300


@pytest.mark.parametrize("fineness", [(), ((1, 2),), ((1, 3),)])
def test_crossmatch_of_dense_and_odd_tables(spark, monkeypatch, fineness):
    """Whichever side is larger and however fine the cubes, on their borders, between huge and missing coordinates; nothing beyond a count is broadcast."""
    from voxelframe.operators import crossmatch

    monkeypatch.setattr(crossmatch, "BROADCAST_ROWS", 20)
    monkeypatch.setattr(crossmatch, "FINENESS", fineness)
    rng = np.random.default_rng(5)
    odd = [[1e300, 0.0, 0.0], [float("inf"), 1.0, 1.0], [float("nan"), 1.0, 1.0], [1e16, 1e16, 0.0], [-0.0, 0.0, 1.0], [5.999999999999999, 0.6, 0.7]]
    pa = np.array(odd + (rng.integers(-6, 7, (400, 3)) / 2).tolist() + [[1.0, 1.0, 1.0]] * 3)
    pb = np.array(odd + rng.normal(0, 2, (60, 3)).tolist() + [[1.0, 1.0, 1.0], [0.0, 0.0, 1.0]])
    a = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(pa)] + [(-1, None, 1.0, 1.0)], "i int, x double, y double, z double")
    b = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(pb)] + [(-1, None, 1.0, 1.0)], "j int, x double, y double, z double")
    for eps in (0.0, 1.0, 3.0):
        with np.errstate(all="ignore"):
            d = pa[:, None] - pb[None]
            near = np.sqrt(d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1] + d[..., 2] * d[..., 2]) <= eps
        want = list(zip(*(x.tolist() for x in np.nonzero(near)), strict=True))
        for flip in (False, True):
            left, right = (b, a) if flip else (a, b)
            one, other = ("j", "i") if flip else ("i", "j")
            got = {kind: crossmatch_center(left, right, eps, kind, ("x", "y", "z"), ("x", "y", "z")) for kind in ("AB", "A", "B")}
            pairs = [(r[0], r[1]) for r in got["AB"].select(f"a.{one}", f"b.{other}").collect()]
            assert sorted((j, i) if flip else (i, j) for i, j in pairs) == sorted((i, j) for i, j in want)
            sides = [sorted({i for i, _ in want}), sorted({j for _, j in want})]
            assert [sorted(r[0] for r in got[k].select(c).collect()) for k, c in (("A", one), ("B", other))] == (sides[::-1] if flip else sides)
            if eps:
                assert all("Broadcast" not in got[k]._jdf.queryExecution().executedPlan().toString() for k in ("AB", "A", "B"))


@pytest.mark.parametrize("broadcast,crowded", [(200_000, 50_000), (20, 50_000), (20, 5)])
def test_crossmatch_tasks_follow_the_pairs(spark, monkeypatch, broadcast, crowded):
    """Small tables with many pairs: the pairs are made in many tasks, whatever few bytes are read, and none is lost."""
    from voxelframe.operators import crossmatch

    for name, value in (("BROADCAST_ROWS", broadcast), ("CROWDED", crowded), ("PAIRS_A_TASK", 2000)):
        monkeypatch.setattr(crossmatch, name, value, raising=False)
    rng = np.random.default_rng(11)
    pa, pb = rng.random((2000, 3)), rng.random((300, 3))
    a, b = (spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(x)], f"{c} int, x double, y double, z double").coalesce(1) for c, x in (("i", pa), ("j", pb)))
    near = np.sqrt(((pa[:, None] - pb[None]) ** 2).sum(axis=2)) <= 0.4
    for left, right in ((a, b), (b, a)):
        got = crossmatch_center(left, right, 0.4, "AB", ("x", "y", "z"), ("x", "y", "z"))
        one, other = ("a.i", "b.j") if left is a else ("b.i", "a.j")
        rows = got.select(F.col(one), F.col(other), F.spark_partition_id()).collect()
        assert sorted((i, j) for i, j, _ in rows) == list(zip(*(x.tolist() for x in np.nonzero(near)), strict=True))
        assert len({p for *_, p in rows}) > 20


def test_collapse(spark):
    rows = [[1.0, 2.0], [3.0, 4.0], [5.0, 6.0], [7.0, 8.0], [9.0, 10.0]]
    cf = CollapseFunctions()
    (center, n), = cf.mean(iter(rows))
    assert list(center) == [5.0, 6.0] and n == 5 and list(cf.mean(iter([]))) == [(None, 0)]
    got = collapse_rdd_data(spark.sparkContext.parallelize(rows, 2), cf.mean).collect()
    assert [(list(c), n) for c, n in got] == [([2.0, 3.0], 2), ([7.0, 8.0], 3)]
    assert collapse_rdd_data(spark.sparkContext.parallelize(rows, 6), cf.kmeans, 2).collect()[0] == ([None], 0)
    (c, n), = cf.kmeans(iter([[0.0, 0.0], [0.1, 0.0], [9.0, 9.0], [9.1, 9.0]]), 2)
    assert sorted(map(tuple, c)) == [pytest.approx((0.05, 0.0)), pytest.approx((9.05, 9.0))]
    df = spark.createDataFrame(rows, "x double, y double").repartition(3)
    assert sum(r.n for r in collapse_mean(df, ["x", "y"]).collect()) == 5 and collapse_kmeans(df, ["x", "y"], 1).count() == 3


def test_pixels_and_scalars(spark):
    one = spark.range(1)
    assert one.select(to_healpix(512, F.lit(45.0), F.lit(45.0))).first()[0] is not None
    # every direction at nside 1 falls in one of 12 base pixels, the poles in the first and last ring
    assert one.select(ang2pix_ring(1, F.lit(0.0), F.lit(0.0)), ang2pix_ring(1, F.lit(np.pi), F.lit(6.0))).first()[:] == (0, 11)
    assert sph2cart(*cart2sph(1.0, 2.0, 3.0)) == pytest.approx((1.0, 2.0, 3.0))
    assert sample_size(100, 10) == 100 and sample_size(10_000, 10) == 5000 and sample_size(10_000_000, 10) == 100_000
    register(spark)
    assert spark.sql("select vf_distance(0,0,0,1,1,1) d, vf_in_box(0,0,0,0,1,0,1,0,1) b, vf_sph2cart(1,0,0).z z").first()[:] == (pytest.approx(3**0.5), True, 1.0)


def test_predicates_agree_with_plain_shapes(spark):
    rng = np.random.default_rng(3)
    shapes = [Point(*map(float, rng.integers(0, 4, 3))) for _ in range(4)] + [Shell(Point(*map(float, rng.integers(0, 4, 3))), float(i), float(i + 2)) for i in range(3)]
    shapes += [Box.of(*map(float, rng.integers(0, 5, 6))) for _ in range(4)] + [Shell.of(0.0, 0.0, 0.0, False, -1.0, -1.0)]
    pairs = [(a, b) for a in shapes for b in shapes]
    got = spark.range(1).select(*(P.intersects(a, b).alias(f"c{k}") for k, (a, b) in enumerate(pairs))).first()
    for (a, b), g in zip(pairs, got, strict=True):
        assert a.intersects(b) == g, (a, b)
    ball, cube = Shell(Point(0.0, 0.0, 0.0), 0.0, 1.0), Box(0.9, 2.0, 0.9, 2.0, 0.9, 2.0)
    assert spark.range(1).select(P.shell_intersects_box(ball, cube), P.shell_intersects_box(ball, cube, exact=True)).first()[:] == (True, False)


def test_fits(spark, tmp_path):
    n = 2500
    write_fits(f"{tmp_path}/t.fits", {"x": np.arange(n, dtype="f4"), "k": np.arange(n, dtype="i8"), "y": np.linspace(0, 1, n)})
    df = load(spark, f"{tmp_path}/t.fits", hdu=1, rowspertask=1000)
    assert df.dtypes == [("x", "float"), ("k", "bigint"), ("y", "double")] and df.rdd.getNumPartitions() == 3
    assert df.agg(F.sum("k"), F.sum("y")).first()[:] == (n * (n - 1) // 2, pytest.approx(n / 2))
    for fmt in ("csv", "txt", "json", "parquet"):
        convert(spark, f"{tmp_path}/t.fits", f"{tmp_path}/{fmt}", fmt)
    assert load(spark, f"{tmp_path}/csv", "csv").count() == n and load(spark, f"{tmp_path}/parquet", "parquet").count() == n
    with pytest.raises(AssertionError):
        load(spark, "x.abc")
    assert generators.many_columns(spark, 5, 6).columns[-1] == "col5" and generators.spheres(spark, 5, "spherical").columns[:3] == ["Z_COSMO", "RA", "DEC"]


def test_fits_values(spark, tmp_path):
    """Scaled, unsigned and missing values, several values in a cell, logicals and text; only the wanted columns."""
    n = 300
    k = np.arange(n)
    columns = {
        "scaled": k.astype("i2"), "u16": (k - 2**15 + 40_000).astype("i2"), "u32": (k - 2**31 + 3_000_000_000).astype("i4"), "u64": k.astype("i8") + (5 - 2**63), "holes": np.where(k % 3 == 0, -99, k).astype("i4"),
        "vec": np.stack([k, k * 2, k * 3], axis=1).astype("f4"), "ok": np.where(k % 3 == 0, b"T", np.where(k % 3 == 1, b"F", b"\0")).astype("S1"), "name": np.array([f"s{i}" for i in k], dtype="S5"), "sb": k.astype("u1"), "small": (k % 250).astype("u1"),
    }
    write_fits(f"{tmp_path}/t.fits", columns, [("TSCAL1", 0.5), ("TZERO1", 10), ("TZERO2", 32768), ("TZERO3", 2147483648), ("TZERO4", 9223372036854775808), ("TNULL5", -99), ("TZERO9", -128)])
    df = load(spark, f"{tmp_path}/t.fits", rowspertask=100)
    assert dict(df.dtypes) == {"scaled": "double", "u16": "int", "u32": "bigint", "u64": "decimal(20,0)", "holes": "int", "vec": "array<float>", "ok": "boolean", "name": "string", "sb": "smallint", "small": "smallint"}
    rows = df.collect()
    for i in (0, 1, 2, 150, 299):
        r = rows[i]
        assert (r.scaled, r.u16, r.u32, int(r.u64)) == (10 + i / 2, 40_000 + i, 3_000_000_000 + i, 5 + i)
        assert r.holes == (None if i % 3 == 0 else i) and r.vec == [i, 2 * i, 3 * i] and r.ok == (True, False, None)[i % 3] and r.name == f"s{i}" and r.sb == i % 256 - 128 and r.small == i % 250
    some = load(spark, f"{tmp_path}/t.fits", columns="vec, u16")
    assert some.columns == ["vec", "u16"] and some.where("u16 = 40007").first().vec == [7.0, 14.0, 21.0]
    with pytest.raises(Exception, match="not supported"):
        write_fits(f"{tmp_path}/bad.fits", {"c": np.zeros(2, dtype="f8")}, [("TFORM1", "1C")])
        load(spark, f"{tmp_path}/bad.fits")


def test_placing_shapes_equals_all_pairs(spark):
    """Boxes and spheres of all sizes, outside ones, empty ones and nulls, against every leaf, on deep and flat trees."""
    points = generators.blobs(spark, 3000, seed=3).cache()
    rng = np.random.default_rng(8)
    rows = [(i, *map(float, np.r_[c, c + s][[0, 3, 1, 4, 2, 5]])) for i, (c, s) in enumerate(zip(rng.normal(size=(60, 3)) * 6, rng.random((60, 3)) * rng.choice([0, 1, 8], (60, 1)), strict=True))]
    rows += [(100, 1.0, 0.0, 1.0, 0.0, 1.0, 0.0), (101, None, 1.0, 0.0, 1.0, 0.0, 1.0), (102, 1e6, 1e6, 0.0, 1.0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "k int, a double, b double, c double, d double, e double, f double")
    for n in (1, 8, 512):
        grid = fit(points, OCTREE, n)
        got = sorted(map(tuple, grid.place_objects(df, Box(*"abcdef")).select("k", "partition_id").collect()))
        want = sorted((r[0], i) for r in rows if None not in r for i in grid.place_object(Box(*r[1:])))
        assert got == want and grid.place_objects(df, Box(*"abcdef")).columns == [*df.columns, "partition_id"]
        assert "Join" not in grid.place_objects(df, Box(*"abcdef"))._jdf.queryExecution().toString()
    with pytest.raises(AssertionError, match="fewer than"):
        fit(points, OCTREE, 8**7)


def test_crowds(spark, monkeypatch):
    """Copies in front of the nearest neighbours, and a cube that holds almost all rows: the plain results."""
    from voxelframe.operators import crossmatch, knn as knn_module, repartition

    df = spark.range(6000).select(*(F.when(F.col("id") < 5500, F.col("id") % 7).otherwise(F.col("id")).cast("double").alias(c) for c in "xyz"))
    want = sorted({tuple([float(i % 7 if i < 5500 else i)] * 3) for i in range(6000)})[:20]
    assert [tuple(r) for r in knn(df, [0, 0, 0], 20, "cartesian", True).collect()] == want
    monkeypatch.setattr(knn_module, "LAST_TRY", 10)
    assert [tuple(r) for r in knn(df, [0, 0, 0], 20, "cartesian", True).collect()] == want
    a, b = generators.points(spark, 400, seed=1).cache(), generators.points(spark, 300, seed=9).cache()
    counts = [crossmatch_center(a, b, 0.4, k).count() for k in ("AB", "A", "B")]
    monkeypatch.setattr(crossmatch, "CROWDED", 5)
    assert counts == [crossmatch_center(a, b, 0.4, k).count() for k in ("AB", "A", "B")] and counts[0] > 400
    words = spark.range(40).select(F.when(F.col("id") % 9 > 0, F.concat(F.lit("w"), F.col("id") % 9)).alias("w"))
    landed = [sorted({tuple(r) for r in repartitionByCol(words, "w", False).select("w", F.spark_partition_id()).collect()}, key=str)]
    monkeypatch.setattr(repartition, "BROADCAST_LABELS", 3)
    landed.append(sorted({tuple(r) for r in repartitionByCol(words, "w", False).select("w", F.spark_partition_id()).collect()}, key=str))
    assert landed[0] == landed[1] == sorted([(None, 0)] + [(f"w{k}", k) for k in range(1, 9)], key=str)


def test_knn_on_shapes(spark):
    rows = spark.createDataFrame([(k, float(k), float(k) + 2.0 * k) for k in range(20)], "k int, lo double, hi double")
    box = Box("lo", "hi", "lo", "hi", "lo", "hi")
    got = knn(rows, [6.0, 6.0, 6.0], 3, "cartesian", shape=box).collect()
    assert [r.k for r in got] == [3, 2, 4] and got[0].asDict().keys() == {"k", "lo", "hi"}
    assert knn(rows, [0, 0, 0], 1, "cartesian", shape=Shell(Point("lo", "lo", "lo"), 0.0, "hi")).first().k == 0


def test_column_shapes_agree_with_plain_ones(spark):
    rng = np.random.default_rng(4)
    boxes = [Box.of(*map(float, rng.integers(-3, 5, 6))) for _ in range(5)] + [Box.null()]
    shells = [Shell.of(float(rng.integers(0, 2)), 0.0, 0.0, False, float(a), float(a + b)) for a, b in rng.integers(0, 4, (5, 2))]
    p = Point(1.0, 2.0, -1.0)
    wanted, made = [], []
    for a in boxes:
        low, high = P.box_extents(a)
        made += [low, high, *P.box_center(a).xyz]
        wanted += [a.min_extent(), a.max_extent(), *a.center.xyz]
        for shape, plain in [(P.box_expanded(a, 1.0, 2.0, 3.0), a.expanded(1.0, 2.0, 3.0)), (P.box_expanded_outwards(a, 0.5), a.expanded_outwards(0.5)), (P.box_translated(a, 1.0, -1.0, 0.0), a.translated(1.0, -1.0, 0.0)), (P.box_including(a, p), a.including(p)), (P.box_including(a, boxes[0]), a.including(boxes[0]))]:
            made += shape.bounds
            wanted += plain.bounds
        made += [P.box_equals(a, b) for b in boxes]
        wanted += [a.equals(b) for b in boxes]
    for s in shells:
        for shape, plain in [(P.shell_expanded(s, 1.0), s.expanded(1.0)), (P.shell_inner_expanded(s, 2.0), s.inner_expanded(2.0)), (P.shell_outer_expanded(s, 2.0), s.outer_expanded(2.0)), (P.shell_including(s, p), s.including(p)), (P.shell_including(s, Shell(s.center, 1.0, 3.0)), s.including(Shell(s.center, 1.0, 3.0)))]:
            made += [F.lit(c) for c in (shape.r_in, shape.r_out)]
            wanted += [plain.r_in, plain.r_out]
        made += [P.shell_equals(s, o) for o in shells]
        wanted += [s.equals(o) for o in shells]
    got = spark.range(1).select(*(F.lit(c).alias(f"c{k}") for k, c in enumerate(made))).first()
    assert list(got) == pytest.approx(wanted)
    apart = spark.range(1).select(P.shell_including(shells[0], Shell(Point(9.0, 9.0, 9.0), 0.0, 1.0)).r_in).first()
    assert apart[0] is None


def test_command_lines(spark, spheres, tmp_path, capsys):
    from voxelframe.examples import knn as knn_line, partition, picture, window

    spheres.write.parquet(f"{tmp_path}/t.parquet")
    plain, distinct = knn_line.main([f"{tmp_path}/t.parquet", "-k", "3", "--grid", "octree", "--partitions", "8"])
    assert plain.count() == 3 and distinct.distinct().count() == 3
    assert window.main([f"{tmp_path}/t.parquet", "--window", "sphere", "--coordinates=1,1,1,2"]).count() == 3
    out = partition.main([f"{tmp_path}/t.parquet", "--partitions", "3", "--repeats", "1"])
    assert [r[0] for r in out] == list(partition.MODES) and all(r[1] > 0 for r in out) and out[0][2] == 3
    assert sum(map(len, picture.main([f"{tmp_path}/t.parquet", "--partitions", "3", "--fraction", "1.0"]).values())) == spheres.count()
    assert "rows inside" in capsys.readouterr().out


def test_accessor_and_session(spark, spheres):
    import voxelframe.accessor  # noqa: F401
    from voxelframe.session import load_user_conf

    xyz = spheres.select("x", "y", "z")
    assert xyz.voxel.window("sphere", [1, 1, 1, 2], "cartesian").count() == 3 and xyz.voxel.knn([0, 0, 0], 50, "cartesian", True).count() == 9
    labelled = spheres.voxel.prePartition(OCTREE, 8)
    assert labelled.voxel.repartitionByCol("partition_id", True, 8).voxel.checkLoadBalancing("size").count() == 8
    assert xyz.voxel.near(xyz, 0.0).count() >= 9
    conf = load_user_conf(spark)
    assert conf["spark.master"].startswith("local") and not any(k.startswith("spark.app.") for k in conf)


def test_elements_of_a_branch():
    """Down the cells that hold the shape, everything on the way and below."""
    from voxelframe.plans.octree import Octree

    rng = np.random.default_rng(6)
    tree = Octree(Box(0.0, 16.0, 0.0, 16.0, 0.0, 16.0), max_items=3)
    boxes = [Box(x, x + s, y, y + s, z, z + s) for (x, y, z), s in zip((rng.random((80, 3)) * 13).tolist(), (rng.random(80) * 3).tolist(), strict=True)]
    for b in boxes:
        tree.insert(b)

    def holds(node, b):  # the deepest cell of the tree that holds it
        below = [c for c in node.children if c.box.covers(b)]
        return [node, *holds(below[0], b)] if below else [node]

    for b in boxes[:30] + [Box(7.0, 9.0, 7.0, 9.0, 7.0, 9.0)]:
        path = holds(tree, b)
        want = [x for n in path[:-1] for x in n.elements] + [x for n in path[-1].nodes() for x in n.elements]
        assert sorted(map(str, tree.elements_near(b))) == sorted(map(str, want))
    assert sorted(map(str, tree.elements_near(Box(7.0, 9.0, 7.0, 9.0, 7.0, 9.0)))) == sorted(map(str, boxes))  # over the middle planes: all


def test_streams(spark, spheres, tmp_path):
    rows = spheres.withColumn("ts", F.timestamp_seconds(F.lit(0)))
    rows.write.parquet(f"{tmp_path}/in")
    grid = fit(spheres, OCTREE, 8)
    for name, make, want in [("w", lambda s: stream_window(s, "sphere", [1, 1, 1, 2], "cartesian", ("x", "y", "z")), 3), ("c", lambda s: stream_cell_counts(s, grid, "ts", "1 minute", "1 minute"), 8)]:
        q = make(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName(name).outputMode("append" if name == "w" else "complete").option("checkpointLocation", f"{tmp_path}/ck{name}").start()
        q.processAllAvailable()
        q.stop()
        assert spark.table(name).count() == want


def test_pixel_goldens(spark):
    one = spark.range(1)
    got = one.select(to_healpix(512, F.lit(1.0), F.lit(0.0)), to_healpix(512, F.lit(0.0), F.lit(0.0), thetaphi=True), to_healpix(2048, F.lit(np.pi), F.lit(0.0), thetaphi=True)).first()
    assert got[:] == (1571845, 0, 50331644)
