"""The registered queries of the spatial operators, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelframe.functions import coords as C
from voxelframe.functions import predicates as P
from voxelframe.functions.healpix import to_healpix
from voxelframe.operators.balance import checkLoadBalancing, label_load
from voxelframe.operators.collapse import collapse_kmeans, collapse_mean
from voxelframe.operators.crossmatch import crossmatch_center, crossmatch_healpix
from voxelframe.operators.knn import knn, knn_pruned
from voxelframe.operators.repartition import repartition_as, repartitionByCol
from voxelframe.operators.window import keep_metadata, window_filter, windowquery
from voxelframe.options import SpatialOptions
from voxelframe.plans.octree import data_envelope
from voxelframe.plans.onion import max_radius
from voxelframe.plans.partitioning import fit, prePartition
from voxelframe.shapes import Box, Point, Shell

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

PTS = "(select l_quantity x, l_extendedprice/1000 y, l_discount*100 z from lineitem)"
SPH = "(select l_quantity r, radians(l_partkey%181) theta, radians(l_suppkey%360) phi from lineitem)"
SKY = "(select l_orderkey k, l_partkey%360 ra, l_suppkey%181-90 \"dec\" from lineitem)"
BALLS = "(select p_partkey k, cast(p_size as double) x, p_retailprice/100 y, cast(p_partkey%50 as double) z, p_size/10.0 radius from part)"
CUST = "(select c_custkey ka, c_acctbal/100 x, cast(c_nationkey as double) y, cast(c_custkey%50 as double) z from customer)"
SUPP = "(select s_suppkey kb, s_acctbal/100 x, cast(s_nationkey as double) y, cast(s_suppkey%50 as double) z from supplier)"
EMB = "(select vec_id k, cast(embedding[1] as double) x, cast(embedding[2] as double) y, cast(embedding[3] as double) z from embeddings)"
EPS = 8.0


def _read(spark: SparkSession, d: str, t: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{t}.parquet")


def pts(spark, d):
    return _read(spark, d, "lineitem").select(F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_discount") * 100).alias("z"))


def sph(spark, d):
    return _read(spark, d, "lineitem").select(F.col("l_quantity").alias("r"), F.radians(F.col("l_partkey") % 181).alias("theta"), F.radians(F.col("l_suppkey") % 360).alias("phi"))


def sky(spark, d):
    return _read(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_partkey") % 360).alias("ra"), (F.col("l_suppkey") % 181 - 90).alias("dec"))


def balls(spark, d):
    p = _read(spark, d, "part")
    return p.select(F.col("p_partkey").alias("k"), F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") / 100).alias("y"), (F.col("p_partkey") % 50).cast("double").alias("z"), (F.col("p_size") / F.lit(10.0)).alias("radius"))


def cust(spark, d):
    return _read(spark, d, "customer").select(F.col("c_custkey").alias("ka"), (F.col("c_acctbal") / 100).alias("x"), F.col("c_nationkey").cast("double").alias("y"), (F.col("c_custkey") % 50).cast("double").alias("z"))


def supp(spark, d):
    return _read(spark, d, "supplier").select(F.col("s_suppkey").alias("kb"), (F.col("s_acctbal") / 100).alias("x"), F.col("s_nationkey").cast("double").alias("y"), (F.col("s_suppkey") % 50).cast("double").alias("z"))


def emb3(spark, d):
    return _read(spark, d, "embeddings").select(F.col("vec_id").alias("k"), *(F.get(F.col("embedding"), F.lit(i)).cast("double").alias(c) for i, c in enumerate("xyz")))


def query(sql: str | None = None):
    def wrap(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return wrap


def dist(a: str, b: str) -> str:
    (x, y, z), (u, v, w) = a.split(), b.split()
    return f"sqrt(({x}-({u}))*({x}-({u}))+({y}-({v}))*({y}-({v}))+({z}-({w}))*({z}-({w})))"


def dist_sph(a: str, b: str) -> str:
    (r, t, p), (q, u, s) = a.split(), b.split()
    return f"sqrt(greatest(0.0, {r}*{r}+{q}*{q}-2.0*{r}*{q}*(sin({t})*sin({u})*cos({p}-{s})+cos({t})*cos({u}))))"


# windows --------------------------------------------------------------------------------------------------------------


@query("select cast(p_size as double) x, cast(p_size*2.0 as double) y, cast(p_size*3.0 as double) z from part where p_size = 7")
def window_point(spark, d):
    s = _read(spark, d, "part").select(F.col("p_size").cast("double").alias("x"), (F.col("p_size") * 2.0).alias("y"), (F.col("p_size") * 3.0).alias("z"))
    return windowquery(s, "point", [7, 14, 21], "cartesian")


@query(f"select x, y, z from {PTS} where {dist('x y z', '25.3 40.7 5.1')} < 8.37")
def window_sphere(spark, d):
    return windowquery(pts(spark, d), "sphere", [25.3, 40.7, 5.1, 8.37], "cartesian")


@query(f"select x, y, z from {PTS} where {dist('x y z', '25.3 40.7 5.1')} >= 6.11 and {dist('x y z', '25.3 40.7 5.1')} < 9.37")
def window_shell(spark, d):
    return windowquery(pts(spark, d), "shell", [25.3, 40.7, 5.1, 6.11, 9.37], "cartesian")


@query(f"select x, y, z from {PTS} where x >= 10.5 and x < 30.5 and y >= 20.0005 and y < 45.0005 and z >= 1.5 and z < 7.5")
def window_box(spark, d):
    return windowquery(pts(spark, d), "box", [10.5, 45.0005, 1.5, 30.5, 20.0005, 3, 12, 30, 7.5], "cartesian")


@query(f"select round(r, 6) r, round(theta, 6) theta, round(phi, 6) phi from {SPH} where {dist_sph('r theta phi', '20.3 1.1 2.2')} < 9.77")
def window_sphere_spherical(spark, d):
    out = windowquery(sph(spark, d), "sphere", [20.3, 1.1, 2.2, 9.77], "spherical")
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


@query(f"select k, x, y, z from {EMB} where {dist('x y z', '0.05 0.05 0.05')} < 0.15")
def window_semi_join_meta(spark, d):
    e = emb3(spark, d)
    return keep_metadata(e, windowquery(e.select("x", "y", "z"), "sphere", [0.05, 0.05, 0.05, 0.15], "cartesian"), ["x", "y", "z"]).select("k", "x", "y", "z")


@query(f"select k from {EMB} where {dist('x y z', '0.05 0.05 0.05')} >= 0.1 and {dist('x y z', '0.05 0.05 0.05')} < 0.2")
def window_keep_columns(spark, d):
    return windowquery(emb3(spark, d), "shell", [0.05, 0.05, 0.05, 0.1, 0.2], "cartesian", coords=("x", "y", "z")).select("k")


def _ball():
    return Shell(Point("x", "y", "z"), 0.0, "radius")


@query(f"select k from {BALLS} where not (x-radius >= 30.25 or x+radius < 20.25 or y-radius >= 14.255 or y+radius < 9.255 or z-radius >= 35.25 or z+radius < 10.25)")
def window_ext_spheres_box(spark, d):
    return window_filter(balls(spark, d), _ball(), Box(20.25, 30.25, 9.255, 14.255, 10.25, 35.25)).select("k")


@query(f"select k from {BALLS} where {dist('x y z', '25.0 10.0 25.0')} + 12.123 >= 0 and not ({dist('x y z', '25.0 10.0 25.0')} + radius < 7.123) and {dist('x y z', '25.0 10.0 25.0')} <= 12.123 + radius")
def window_ext_spheres_shell(spark, d):
    return window_filter(balls(spark, d), _ball(), Shell(Point(25.0, 10.0, 25.0), 7.123, 12.123)).select("k")


@query(f"select k from {BALLS} where not (x >= 28.25 or x+radius < 20.25 or y >= 14.255 or y+radius < 9.255 or z >= 35.25 or z+radius < 10.25)")
def window_ext_boxes_box(spark, d):
    r = F.col("radius")
    row = Box("x", F.col("x") + r, "y", F.col("y") + r, "z", F.col("z") + r)
    return window_filter(balls(spark, d), row, Box(20.25, 28.25, 9.255, 14.255, 10.25, 35.25)).select("k")


# nearest neighbours ---------------------------------------------------------------------------------------------------


@query(f"select x, y, z from {PTS} order by {dist('x y z', '20.1 30.2 4.3')}, x, y, z limit 100")
def knn_cartesian(spark, d):
    return knn(pts(spark, d), [20.1, 30.2, 4.3], 100, "cartesian", False)


@query(f"select round(r, 6) r, round(theta, 6) theta, round(phi, 6) phi from {SPH} order by {dist_sph('r theta phi', '20.123 1.0 2.0')}, r, theta, phi limit 50")
def knn_spherical(spark, d):
    out = knn(sph(spark, d), [20.123, 1.0, 2.0], 50, "spherical", False)
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


@query(f"select x, y, z from (select distinct x, y, z from {PTS}) order by {dist('x y z', '20.1 30.2 4.3')}, x, y, z limit 100")
def knn_unique(spark, d):
    return knn(pts(spark, d), [20.1, 30.2, 4.3], 100, "cartesian", True)


@query(f"select k, x, y, z from {EMB} order by {dist('x y z', '0.1 0.0 -0.1')}, x, y, z limit 20")
def knn_pruned_octree(spark, d):
    e = emb3(spark, d)
    grid = fit(e, {"gridtype": "octree"}, 64)
    return knn_pruned(grid.place(e), [0.1, 0.0, -0.1], 20, grid).select("k", "x", "y", "z")


@query(f"with n as (select distinct x, y, z from {EMB} order by {dist('x y z', '0.1 0.0 -0.1')}, x, y, z limit 20) select k from {EMB} semi join n using (x, y, z)")
def knn_meta_semi(spark, d):
    e = emb3(spark, d)
    return keep_metadata(e, knn(e.select("x", "y", "z"), [0.1, 0.0, -0.1], 20, "cartesian", True), ["x", "y", "z"]).select("k")


@query(f"select k from (select k, {dist('x+radius/2 y+radius/2 z+radius/2', '25.0 10.0 25.0')} dd, x+radius/2 cx, y+radius/2 cy, z+radius/2 cz from {BALLS}) order by dd, cx, cy, cz, k limit 40")
def knn_boxes(spark, d):
    r = F.col("radius")
    row = Box("x", F.col("x") + r, "y", F.col("y") + r, "z", F.col("z") + r)
    return knn(balls(spark, d), [25.0, 10.0, 25.0], 40, "cartesian", shape=row).select("k")


# grids ----------------------------------------------------------------------------------------------------------------


def onion_sql(table: str, r: str, n: int, keep: str) -> str:
    return f"""with p as (select *, {r} d0 from {table}), m as (select max(d0)/{n} dz from p), s as (select unnest(range(1, {n})) i)
select {keep}, cast((select count(*) from s where s.i*m.dz <= p.d0) as int) partition_id from p, m"""


ONION = {"geometry": "points", "colnames": "x,y,z", "coordSys": "cartesian", "gridtype": "onion"}


@query(onion_sql(PTS, "sqrt(x*x+y*y+z*z)", 10, "x, y, z"))
def prepartition_onion(spark, d):
    return prePartition(pts(spark, d), ONION, 10)


@query(onion_sql(SPH, "sqrt(r*r)", 7, "round(r, 6) r"))
def prepartition_onion_spherical(spark, d):
    out = prePartition(sph(spark, d), {"geometry": "points", "colnames": "r,theta,phi", "coordSys": "spherical", "gridtype": "onion"}, 7)
    return out.select(F.round("r", 6).alias("r"), "partition_id")


@query(onion_sql(BALLS, "sqrt(x*x+y*y+z*z)", 10, "k"))
def prepartition_spheres_onion(spark, d):
    return prePartition(balls(spark, d), {"geometry": "spheres", "colnames": "x,y,z,radius", "coordSys": "cartesian", "gridtype": "onion"}, 10).select("k", "partition_id")


OCTREE_LEAVES = f"""e as (select * from {EMB}), b as (select min(x) x0, max(x)+0.001 x1, min(y) y0, max(y)+0.001 y1, min(z) z0, max(z)+0.001 z1, count(*) n from e),
c1 as (select *, (x0+x1)/2 mx, (y0+y1)/2 my, (z0+z1)/2 mz from b),
p1 as (select e.*, 4*cast(z < mz as int)+2*cast(y < my as int)+cast(x >= mx as int) o1, c1.* exclude (n), n from e, c1),
h1 as (select *, case when o1&1=1 then mx else x0 end a0, case when o1&1=1 then x1 else mx end a1, case when o1&2=2 then y0 else my end b0, case when o1&2=2 then my else y1 end b1,
 case when o1&4=4 then z0 else mz end g0, case when o1&4=4 then mz else z1 end g1 from p1),
p2 as (select *, 4*cast(z < (g0+g1)/2 as int)+2*cast(y < (b0+b1)/2 as int)+cast(x >= (a0+a1)/2 as int) o2 from h1),
k as (select o1 q, count(*) > ceil((select n from b)/512.0) big from p2 group by 1),
o as (select unnest(range(8)) q), g as (select o.q, coalesce(k.big, false) big from o left join k using (q)),
leaf as (select q o1, -1 o2, 1 lvl from g where not big union all select g.q, o.q, 2 from g, o where big),
ids as (select *, cast(row_number() over (order by lvl, o1, o2)-1 as int) partition_id from leaf)"""


@query(f"with {OCTREE_LEAVES} select p2.k, ids.partition_id from p2 join ids on p2.o1 = ids.o1 and (ids.o2 = -1 or ids.o2 = p2.o2)")
def prepartition_octree(spark, d):
    return prePartition(emb3(spark, d), {"gridtype": "octree"}, 64).select("k", "partition_id")


@query(f"with {OCTREE_LEAVES} select partition_id, lvl as level from ids")
def octree_leaves(spark, d):
    return fit(emb3(spark, d), {"gridtype": "octree"}, 64).leaf_table(spark).select("partition_id", "level")


@query(
    f"""with b as (select min(x-radius) x0, max(x+radius)+0.001 x1, min(y-radius) y0, max(y+radius)+0.001 y1, min(z-radius) z0, max(z+radius)+0.001 z1 from {BALLS}),
m as (select *, (x0+x1)/2 mx, (y0+y1)/2 my, (z0+z1)/2 mz from b),
c as (select cast(o as int) partition_id, case when o&1=1 then mx else x0 end a0, case when o&1=1 then x1 else mx end a1, case when o&2=2 then y0 else my end b0, case when o&2=2 then my else y1 end b1,
case when o&4=4 then z0 else mz end g0, case when o&4=4 then mz else z1 end g1 from m, (select unnest(range(8)) o))
select k, partition_id from {BALLS} s, c where not (x-radius >= a1 or x+radius < a0 or y-radius >= b1 or y+radius < b0 or z-radius >= g1 or z+radius < g0)"""
)
def place_object_octree(spark, d):
    s = balls(spark, d)
    grid = fit(s, {"geometry": "spheres", "colnames": "x,y,z,radius", "gridtype": "octree"}, 8)
    return grid.place_objects(s, _ball()).select("k", "partition_id")


@query("select cast(unnest([5, 3]) as int) neighbor, cast(4 as int) home")
def neighbors_onion(spark, d):
    grid = fit(pts(spark, d), ONION, 10)
    inside = Point(grid.dz * 4.5, 0.0, 0.0)
    return spark.createDataFrame([(i, grid.home(inside.xyz)) for i, _ in grid.neighbor_nodes(inside)], "neighbor int, home int")


@query("select count(*) n_rows, cast(6 as bigint) n_labels, cast(0 as int) first_label, cast(5 as int) last_label from lineitem")
def prepartition_current(spark, d):
    out = prePartition(pts(spark, d), {"geometry": "points", "gridtype": "current"}, 6)
    p = F.col("partition_id")
    return out.agg(F.count("*").alias("n_rows"), F.count_distinct(p).alias("n_labels"), F.min(p).alias("first_label"), F.max(p).alias("last_label"))


_CELLS = f"""b as (select min(x-radius) x0, max(x+radius)+0.001 x1, min(y-radius) y0, max(y+radius)+0.001 y1, min(z-radius) z0, max(z+radius)+0.001 z1 from {BALLS}),
m as (select *, (x0+x1)/2 mx, (y0+y1)/2 my, (z0+z1)/2 mz from b),
c as (select cast(o as int) partition_id, case when o&1=1 then mx else x0 end a0, case when o&1=1 then x1 else mx end a1, case when o&2=2 then y0 else my end b0, case when o&2=2 then my else y1 end b1,
case when o&4=4 then z0 else mz end g0, case when o&4=4 then mz else z1 end g1 from m, (select unnest(range(8)) o)),
h as (select partition_id home from c where 20.5 >= a0 and 20.5 < a1 and 12.5 >= b0 and 12.5 < b1 and 30.5 >= g0 and 30.5 < g1)"""


def _ball_grid(spark, d):
    return fit(balls(spark, d), {"geometry": "spheres", "colnames": "x,y,z,radius", "gridtype": "octree"}, 8)


@query(f"with {_CELLS} select partition_id, round(a0, 6) min_x, round(b0, 6) min_y, round(g0, 6) min_z from c where not (18.5 >= a1 or 22.5 < a0 or 10.5 >= b1 or 14.5 < b0 or 28.5 >= g1 or 32.5 < g0)")
def octree_partition_nodes(spark, d):
    found = _ball_grid(spark, d).partition_nodes(Shell.of(20.5, 12.5, 30.5, False, 0.0, 2.0))
    return spark.createDataFrame([(i, *(round(float(v), 6) for v in (b.min_x, b.min_y, b.min_z))) for i, b in found], "partition_id int, min_x double, min_y double, min_z double")


@query(f"with {_CELLS} select home, partition_id neighbor from c, h where partition_id <> home")
def neighbors_octree(spark, d):
    grid, p = _ball_grid(spark, d), Point(20.5, 12.5, 30.5)
    return spark.createDataFrame([(grid.home(p.xyz), i) for i, _ in grid.neighbor_nodes(p)], "home int, neighbor int")


@query("select * from (values ('onion', 4, 5), ('onion', 4, 3), ('onion', 9, 8)) t(grid, home, neighbor) union all "
       f"select * from (with {_CELLS} select 'octree', home, partition_id from c, h where partition_id <> home)")  # fmt: skip
def neighbors_secondary(spark, d):
    onion, octree = fit(pts(spark, d), ONION, 10), _ball_grid(spark, d)
    shells, home = dict(onion.cells()), octree.home((20.5, 12.5, 30.5))
    rows = [("onion", h, i) for h in (4, 9) for i, _ in onion.secondary_neighbor_nodes(shells[h], h)]
    rows += [("octree", home, i) for i, _ in octree.secondary_neighbor_nodes(dict(octree.cells())[home], home)]
    return spark.createDataFrame(rows, "grid string, home int, neighbor int")


@query(f"select min(x) min_x, max(x)+0.001 max_x, min(y) min_y, max(y)+0.001 max_y, min(z) min_z, max(z)+0.001 max_z from {PTS}")
def data_envelope_box(spark, d):
    b = data_envelope(pts(spark, d), SpatialOptions())
    return spark.createDataFrame([tuple(map(float, b.bounds))], "min_x double, max_x double, min_y double, max_y double, min_z double, max_z double")


@query(f"select max(sqrt(x*x+y*y+z*z)) max_radius from {PTS}")
def max_radius_value(spark, d):
    return spark.createDataFrame([(max_radius(pts(spark, d), SpatialOptions()),)], "max_radius double")


# exchange and load ----------------------------------------------------------------------------------------------------


@query("select o_orderkey, cast(o_orderkey%6 as int) part, cast(o_orderkey%6 as int) landed from orders")
def repartition_by_col_labeled(spark, d):
    o = _read(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 6).cast("int").alias("part"))
    return repartitionByCol(o, "part", True).withColumn("landed", F.spark_partition_id())


@query("select o_orderkey, o_orderpriority, cast(dense_rank() over (order by o_orderpriority)-1 as int) landed from orders")
def repartition_by_col_unlabeled(spark, d):
    o = _read(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return repartitionByCol(o, "o_orderpriority", False).withColumn("landed", F.spark_partition_id())


_LOAD = "select {} from (select o_orderkey%6 k, count(*) n from orders group by 1)"


@query(_LOAD.format('n*100.0/sum(n) over () "Load (%)", cast(k as int) partition_id'))
def load_balance_frac(spark, d):
    o = _read(spark, d, "orders").select((F.col("o_orderkey") % 6).cast("int").alias("part"))
    return checkLoadBalancing(repartitionByCol(o, "part", True), "frac")


@query(_LOAD.format('cast(n as double) "Load (#Rows)", cast(k as int) partition_id'))
def load_balance_size(spark, d):
    o = _read(spark, d, "orders").select((F.col("o_orderkey") % 6).cast("int").alias("part"))
    return checkLoadBalancing(repartitionByCol(o, "part", True), "size")


@query("select o_orderpriority, count(*) n_rows, count(*)*100.0/sum(count(*)) over () load_pct from orders group by 1")
def label_loads(spark, d):
    return label_load(_read(spark, d, "orders"), "o_orderpriority")


@query("select cast(k as int) partition_id, round(v, 6) v, n from (select o_orderkey%6 k, avg(o_totalprice) v, count(*) n from orders group by 1)")
def collapse_means(spark, d):
    o = _read(spark, d, "orders").select((F.col("o_orderkey") % 6).cast("int").alias("part"), F.col("o_totalprice").alias("v"))
    return collapse_mean(repartitionByCol(o, "part", True), ["v"]).withColumn("v", F.round("v", 6))


@query()
def collapse_kmeans_centers(spark, d):
    grid = prePartition(pts(spark, d), ONION, 4)
    return collapse_kmeans(repartitionByCol(grid, "partition_id", True), ["x", "y", "z"], 2)


_ONION4 = onion_sql(PTS, "sqrt(x*x+y*y+z*z)", 4, "x, y, z")


@query(f"select partition_id, count(*) n, cast(3 as bigint) clusters from ({_ONION4}) group by 1 having count(*) >= 3")
def collapse_kmeans_sizes(spark, d):
    """What of k-means SQL can say: k centres for each partition with k rows or more, and the partition's rows."""
    grid = prePartition(pts(spark, d), ONION, 4)
    return collapse_kmeans(repartitionByCol(grid, "partition_id", True), ["x", "y", "z"], 3).groupBy("partition_id", "n").agg(F.count_distinct("cluster").alias("clusters"))


@query(f"select partition_id, cast(0 as int) as cluster, round(avg(x), 6) x, round(avg(y), 6) y, round(avg(z), 6) z, count(*) n from ({_ONION4}) group by 1")
def collapse_kmeans_single(spark, d):
    """With one centre k-means is the mean."""
    grid = prePartition(pts(spark, d), ONION, 4)
    out = collapse_kmeans(repartitionByCol(grid, "partition_id", True), ["x", "y", "z"], 1)
    return out.select("partition_id", "cluster", *(F.round(c, 6).alias(c) for c in "xyz"), "n")


MODES = ("col", "range", "order", "rep", "col-no")


@query("select m mode, n rows_moved, l labels from (select count(*) n, cast(6 as bigint) l from orders), (select unnest(['col', 'range', 'order', 'rep', 'col-no']) m)")
def repartition_alternatives(spark, d):
    """The exact exchange and the ways it is compared with: each keeps all rows and labels."""
    o = _read(spark, d, "orders").select((F.col("o_orderkey") % 6).cast("int").alias("partition_id"))
    out = [repartition_as(o, m, 6).select(F.lit(m).alias("mode"), "partition_id") for m in MODES]
    whole = out[0]
    for x in out[1:]:
        whole = whole.union(x)
    return whole.groupBy("mode").agg(F.count("*").alias("rows_moved"), F.count_distinct("partition_id").alias("labels"))


# scalars --------------------------------------------------------------------------------------------------------------


@query(f"select k, round(sqrt(x*x+y*y+z*z), 6) r, round(atan2(sqrt(x*x+y*y), z), 6) theta, round(atan2(y, x), 6) phi from {EMB}")
def cart2sph_columns(spark, d):
    return emb3(spark, d).select("k", *(F.round(c, 6).alias(n) for c, n in zip(C.cartesian_to_spherical("x", "y", "z"), ("r", "theta", "phi"), strict=True)))


@query(f"select round(r*sin(theta)*cos(phi), 6)+0.0 x, round(r*sin(theta)*sin(phi), 6)+0.0 y, round(r*cos(theta), 6)+0.0 z from {SPH}")
def sph2cart_columns(spark, d):
    return sph(spark, d).select(*((F.round(c, 6) + 0.0).alias(n) for c, n in zip(C.spherical_to_cartesian("r", "theta", "phi"), "xyz", strict=True)))


@query(f'select k, round(pi()/2-radians("dec"), 6) theta, round(radians(ra), 6) phi from {SKY}')
def radec_thetaphi(spark, d):
    return sky(spark, d).select("k", F.round(C.dec2theta("dec"), 6).alias("theta"), F.round(C.ra2phi("ra"), 6).alias("phi"))


def pix_sql(nside: int, table: str, theta: str, phi: str, keep: str) -> str:
    n = nside
    return f"""select {keep}, cast(case when za <= 2.0/3.0 then {2 * n * (n - 1)} + (ring-1)*{4 * n} + ((cast(floor((jp+jm-{n}+1-ring%2+1)/2.0) as bigint)%{4 * n})+{4 * n})%{4 * n}
 when cz > 0 then 2*cr*(cr-1) + floor(tt*cr) else {12 * n * n} - 2*cr*(cr+1) + floor(tt*cr) end as bigint) pix
from (select *, {n}+1+jp-jm ring, floor((tt-floor(tt))*w)+floor((1-(tt-floor(tt)))*w)+1 cr
from (select *, cast(floor({n}*(0.5+tt)-{n}*cz*0.75) as bigint) jp, cast(floor({n}*(0.5+tt)+{n}*cz*0.75) as bigint) jm, {n}*sqrt(3.0*(1.0-za)) w
from (select *, abs(cz) za, (ph/(2*pi())-floor(ph/(2*pi())))*4.0 tt from (select *, cos({theta}) cz, {phi} ph from {table}))))"""


@query(pix_sql(64, SKY, 'pi()/2-pi()/180*"dec"', "pi()/180*ra", "k"))
def healpix_ring(spark, d):
    return sky(spark, d).select("k", to_healpix(64, "ra", "dec").alias("pix"))


@query(pix_sql(16, SPH, "theta", "phi", "round(r, 6) r"))
def healpix_thetaphi(spark, d):
    return sph(spark, d).select(F.round("r", 6).alias("r"), to_healpix(16, "theta", "phi", thetaphi=True).alias("pix"))


# matches --------------------------------------------------------------------------------------------------------------

_NEAR = dist("a.x a.y a.z", "b.x b.y b.z") + f" <= {EPS}"


def _match(spark, d, kind):
    return crossmatch_center(cust(spark, d), supp(spark, d), EPS, kind, ("x", "y", "z"), ("x", "y", "z"))


@query(f"select ka, kb from {CUST} a, {SUPP} b where {_NEAR}")
def crossmatch_center_ab(spark, d):
    return _match(spark, d, "AB").select("a.ka", "b.kb")


@query(f"select distinct ka from {CUST} a, {SUPP} b where {_NEAR}")
def crossmatch_center_a(spark, d):
    return _match(spark, d, "A").select("ka")


@query(f"select distinct kb from {CUST} a, {SUPP} b where {_NEAR}")
def crossmatch_center_b(spark, d):
    return _match(spark, d, "B").select("kb")


_SA = "(select c_custkey ka, c_custkey%360 ra, c_custkey%181-90 \"dec\" from customer)"
_SB = "(select s_suppkey kb, s_suppkey*7%360 ra, s_suppkey*7%181-90 \"dec\" from supplier)"
_PA = pix_sql(8, _SA, 'pi()/2-pi()/180*"dec"', "pi()/180*ra", "ka")
_PB = pix_sql(8, _SB, 'pi()/2-pi()/180*"dec"', "pi()/180*ra", "kb")


def _pixels(spark, d, kind):
    a = _read(spark, d, "customer").select(F.col("c_custkey").alias("ka"), (F.col("c_custkey") % 360).alias("ra"), (F.col("c_custkey") % 181 - 90).alias("dec"))
    b = _read(spark, d, "supplier").select(F.col("s_suppkey").alias("kb"), (F.col("s_suppkey") * 7 % 360).alias("ra"), (F.col("s_suppkey") * 7 % 181 - 90).alias("dec"))
    return crossmatch_healpix(a, b, 8, kind)


@query(f"select ka, kb from ({_PA}) join ({_PB}) using (pix)")
def crossmatch_healpix_ab(spark, d):
    return _pixels(spark, d, "AB").select("a.ka", "b.kb")


@query(f"select ka from ({_PA}) semi join ({_PB}) using (pix)")
def crossmatch_healpix_a(spark, d):
    return _pixels(spark, d, "A").select("ka")


@query(f"select kb from ({_PB}) semi join ({_PA}) using (pix)")
def crossmatch_healpix_b(spark, d):
    return _pixels(spark, d, "B").select("kb")


@query(f"select distinct a.pix healpix from ({_PA}) a join ({_PB}) b on a.pix = b.pix")
def crossmatch_healpix_pix(spark, d):
    return _pixels(spark, d, "healpix")


# shapes ---------------------------------------------------------------------------------------------------------------

def _row_box() -> Box:
    r = F.col("radius")
    return Box("x", F.col("x") + r, "y", F.col("y") + r * 2.0, "z", F.col("z") + r * 3.0)


_W = Box(20.25, 30.25, 9.255, 14.255, 10.25, 35.25)


@query(f"select k, round(radius*(radius*2.0)*(radius*3.0), 6) volume, round(radius, 6) len_x, round(radius*2.0, 6) len_y, round(radius*3.0, 6) len_z from {BALLS}")
def box_measures(spark, d):
    x, y, z = P.box_lengths(_row_box())
    return balls(spark, d).select("k", F.round(P.box_volume(_row_box()), 6).alias("volume"), F.round(x, 6).alias("len_x"), F.round(y, 6).alias("len_y"), F.round(z, 6).alias("len_z"))


@query(
    f"""select k, 20.25 <= x and x < 30.25 and 9.255 <= y and y < 14.255 and 10.25 <= z and z < 35.25 point_in,
x >= 20.25 and x+radius < 30.25 and y >= 9.255 and y+radius*2.0 < 14.255 and z >= 10.25 and z+radius*3.0 < 35.25 covered,
not (x >= 30.25 or x+radius < 20.25 or y >= 14.255 or y+radius*2.0 < 9.255 or z >= 35.25 or z+radius*3.0 < 10.25) meets from {BALLS}"""
)
def box_predicates(spark, d):
    return balls(spark, d).select("k", P.point_in_box(Point("x", "y", "z"), _W).alias("point_in"), P.box_covers_box(_W, _row_box()).alias("covered"), P.box_intersects_box(_W, _row_box()).alias("meets"))


@query(
    f"""select k, round(sqrt(pow(greatest(x-30.25, 20.25-(x+radius), 0.0), 2)+pow(greatest(y-14.255, 9.255-(y+radius*2.0), 0.0), 2)+pow(greatest(z-35.25, 10.25-(z+radius*3.0), 0.0), 2)), 6) gap from {BALLS}"""
)
def box_distances(spark, d):
    return balls(spark, d).select("k", F.round(P.box_distance(_W, _row_box()), 6).alias("gap"))


@query(f"select k, round(4*pi()*(radius*radius-(radius/2)*(radius/2)), 6) area from {BALLS}")
def shell_measures(spark, d):
    return balls(spark, d).select("k", F.round(P.shell_area(Shell(Point("x", "y", "z"), F.col("radius") / 2, "radius")), 6).alias("area"))


_D0 = dist("x y z", "25.0 10.0 25.0")


@query(
    f"""select k, {_D0} >= 7.123 and {_D0} < 12.123 center_in, not ({_D0}+radius < 7.123 or {_D0}+12.123 < 0.0) and {_D0} <= 12.123+radius meets,
{_D0}+radius <= 7.123 in_hole, {_D0} <= 9.0 near from {BALLS}"""
)
def shell_predicates(spark, d):
    s, c = Shell(Point(25.0, 10.0, 25.0), 7.123, 12.123), Point("x", "y", "z")
    return balls(spark, d).select("k", P.point_in_shell(c, s).alias("center_in"), P.shell_intersects_shell(s, _ball()).alias("meets"), P.shell_contains_shell(s, _ball()).alias("in_hole"), P.center_close_to(c, s.center, 9.0).alias("near"))


@query(f"select k, not (20.25 >= x+radius or 30.25 < x or 9.255 >= y+radius*2.0 or 14.255 < y or 10.25 >= z+radius*3.0 or 35.25 < z) meets from {BALLS}")
def box_region(spark, d):
    """Row boxes against the box around three points."""
    corners = (Point(20.25, 14.255, 12.0), Point(30.25, 9.255, 10.25), Point(25.0, 10.0, 35.25))
    return balls(spark, d).select("k", P.box_intersects_region(_row_box(), *corners).alias("meets"))


@query(
    f"""select k, round(x-1.5, 6) grown_x0, round(x+radius+1.5, 6) grown_x1, round(y+radius*2.0+0.25, 6) out_y1, round(z+2.0, 6) moved_z0, round(least(x, 25.0), 6) with_x0, round(greatest(y+radius*2.0, 10.0), 6) with_y1,
round((x+(x+radius))/2, 6) mid_x, round(radius, 6) shortest, round(radius*3.0, 6) longest, round(least(z, 10.25), 6) hull_z0, false same from {BALLS}"""
)
def box_transforms(spark, d):
    b, p = _row_box(), Point(25.0, 10.0, 25.0)
    grown, out, moved, around, hull = P.box_expanded(b, 1.5), P.box_expanded_outwards(b, 0.25), P.box_translated(b, 0.0, 0.0, 2.0), P.box_including(b, p), P.box_including(b, _W)
    short, long = P.box_extents(b)
    made = {"grown_x0": grown.min_x, "grown_x1": grown.max_x, "out_y1": out.max_y, "moved_z0": moved.min_z, "with_x0": around.min_x, "with_y1": around.max_y, "mid_x": P.box_center(b).x, "shortest": short, "longest": long, "hull_z0": hull.min_z}
    return balls(spark, d).select("k", *(F.round(c, 6).alias(n) for n, c in made.items()), P.box_equals(b, _W).alias("same"))


@query(
    f"""select k, round(radius/2+1.0, 6) grown_in, round(radius+1.0, 6) grown_out, round(case when radius/2+1.0 > radius then -1.0 else radius/2+1.0 end, 6) thin_in, round(radius+2.5, 6) wide_out,
round(case when d0 < radius/2 then d0 else radius/2 end, 6) with_in, round(case when d0 < radius then radius else d0+0.1 end, 6) with_out,
round(least(radius/2, 0.5), 6) joined_in, round(case when 3.0 >= radius then 3.0+0.1 else radius end, 6) joined_out, true same from (select *, {dist('x y z', '25.0 10.0 25.0')} d0 from {BALLS})"""
)
def shell_transforms(spark, d):
    c = Point("x", "y", "z")
    s, p = Shell(c, F.col("radius") / 2, "radius"), Point(25.0, 10.0, 25.0)
    grown, thin, wide, around, joined = P.shell_expanded(s, 1.0), P.shell_inner_expanded(s, 1.0), P.shell_outer_expanded(s, 2.5), P.shell_including(s, p), P.shell_including(s, Shell(c, 0.5, 3.0))
    made = {"grown_in": grown.r_in, "grown_out": grown.r_out, "thin_in": thin.r_in, "wide_out": wide.r_out, "with_in": around.r_in, "with_out": around.r_out, "joined_in": joined.r_in, "joined_out": joined.r_out}
    return balls(spark, d).select("k", *(F.round(v, 6).alias(n) for n, v in made.items()), P.shell_equals(s, s).alias("same"))
