"""Matches between two catalogues. Both forms are equi-joins, so they hash or sort-merge and scale out."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelframe.functions.coords import distance, spherical_to_cartesian
from voxelframe.functions.healpix import to_healpix
from voxelframe.options import is_spherical

CROWDED = 50_000  # rows of one side in a cube, beyond which the cube is dealt out
BROADCAST_ROWS = 200_000  # most rows that are broadcast
FINENESS = ((1000, 3), (100, 2))  # where an occupied cube of side epsilon holds so many rows on average, it is cut so finely along each axis
FURTHEST = 4e18  # number of the last cube
PAIRS_A_TASK = 5_000_000  # expected pairs of a task, where pairs are many beside rows
COPIES_A_TASK = 1_000_000  # of the smaller side
MOST_TASKS = 20_000
SPHERE = 4 / 3 * math.pi  # pairs within epsilon for one within a cube


def _located(df: DataFrame, names: Sequence[str], spherical: bool, side: str) -> DataFrame:
    """The rows as a struct, and their cartesian coordinates. Rows without a place, which match nothing, are left out."""
    cols = [F.col(f"`{n}`").cast("double") for n in names]
    xyz = spherical_to_cartesian(*cols) if spherical else cols
    out = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias(side), *(c.alias(f"{side}{k}") for k, c in enumerate(xyz)))
    for k in range(3):
        out = out.where(F.col(f"{side}{k}").isNotNull() & ~F.isnan(f"{side}{k}"))
    return out


def _number(x: Column, edge: float) -> Column:
    return F.floor(F.greatest(F.least(x / edge, F.lit(FURTHEST)), F.lit(-FURTHEST)))


def _occupancy(a: DataFrame, b: DataFrame, edge: float) -> tuple[dict[str, tuple[int, int, int]], float]:
    """Of each side: rows, occupied cubes, and most rows of a cube; and how many pairs share a cube."""
    both = [df.select(*(F.lit(int(s == t)).alias(t) for t in "ab"), *(_number(F.col(f"{s}{k}"), edge).alias(f"g{k}") for k in range(3))) for s, df in (("a", a), ("b", b))]
    cubes = both[0].union(both[1]).groupBy("g0", "g1", "g2").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    found = cubes.agg(*(f(s) for s in "ab" for f in (F.sum, lambda s: F.count_if(F.col(s) > 0), F.max)), F.sum(F.col("a").cast("double") * F.col("b"))).first()
    return {"a": tuple(n or 0 for n in found[:3]), "b": tuple(n or 0 for n in found[3:6])}, found[6] or 0.0


def _tasks(pairs: float, rows: float) -> int:
    """How many tasks so many pairs ask for; none in particular where they are few beside the rows that would have to move."""
    return min(math.ceil(pairs / PAIRS_A_TASK), MOST_TASKS) if pairs > 16 * rows else 0


def _reached(df: DataFrame, side: str, eps: float, cuts: int) -> DataFrame:
    """Each row once per cube that its sphere meets; rounding may add a cube, but takes none away."""
    edge, axes = eps / cuts, [F.col(f"{side}{k}") for k in range(3)]
    slack = [F.abs(x) * 1e-15 + eps * 1e-15 for x in axes]
    for k, x in enumerate(axes):
        own = _number(x, edge)
        lo = F.greatest(_number(x - slack[k] - eps, edge), own - (cuts + 1))
        hi = F.least(_number(x + slack[k] + eps, edge), own + (cuts + 1))
        df = df.withColumn(f"__h{k}", F.explode(F.sequence(lo, hi)))
    gaps = [F.greatest(F.greatest(F.col(f"__h{k}") * F.lit(edge) - x, x - (F.col(f"__h{k}") + 1) * F.lit(edge)) - 4 * slack[k], F.lit(0.0)) for k, x in enumerate(axes)]
    meets = F.sqrt(gaps[0] * gaps[0] + gaps[1] * gaps[1] + gaps[2] * gaps[2]) <= eps * (1 + 1e-12)
    beyond = F.greatest(*(F.abs(x) for x in axes)) >= edge * FURTHEST
    return df.where(meets | beyond)


def crossmatch_center(a: DataFrame, b: DataFrame, eps: float, return_type: str = "AB", coords_a: Sequence[str] | None = None, coords_b: Sequence[str] | None = None, coordSys: str = "cartesian") -> DataFrame:
    """Pairs of rows whose centres are at most ``eps`` apart; exact over the whole of both tables.

    Space is cut into cubes of side ``eps``, or finer ones where rows are dense;
    the side with fewer rows is sent to the cubes its spheres meet and the tables
    are joined on the cube. A cube that holds more than ``CROWDED`` rows of the
    other side is dealt out: these rows are spread over several keys, and what
    meets the cube goes to each. Rows and cubes are counted beforehand, and
    nothing beyond ``BROADCAST_ROWS`` rows is broadcast. Where ``AB`` has many
    pairs beside the rows, their expected number decides on the number of tasks,
    not the bytes that these read. ``AB`` returns structs ``a`` and ``b`` per
    pair, ``A`` or ``B`` the rows of one side that have a match (each once per
    row). ``eps = 0`` is coordinate equality.
    """
    if return_type not in ("AB", "A", "B"):
        raise AssertionError(f"returnType must be AB, A or B (got {return_type!r})")
    if eps < 0:
        raise AssertionError(f"epsilon must not be negative (got {eps})")
    spherical, eps = is_spherical(coordSys), float(eps)
    sides = {"a": _located(a, coords_a or a.columns[:3], spherical, "a"), "b": _located(b, coords_b or b.columns[:3], spherical, "b")}
    celled = 0 < eps < float("inf")
    held, shared = _occupancy(sides["a"], sides["b"], eps if celled else 1.0)
    few, many = ("a", "b") if held["a"][0] < held["b"][0] else ("b", "a")
    rows, cubes, most = held[many]
    wanted = return_type.lower()
    cuts = next((n for least, n in FINENESS if rows >= least * cubes > 0), 1)
    copies = (2 * cuts + 3) ** 3 if celled else 1
    tasks = _tasks(SPHERE * shared, rows + held[few][0]) if celled and wanted == "ab" else 0
    few_rows = sides[few]
    if wanted == few:  # equal places share their matches
        few_rows = few_rows.select(*(f"{few}{k}" for k in range(3))).distinct()
    if celled:
        if tasks:  # its copies are many, its files may be few
            few_rows = few_rows.repartition(min(tasks, math.ceil(held[few][0] * copies / COPIES_A_TASK)))
        few_rows = _reached(few_rows, few, eps, cuts)
        grid = [_number(F.col(f"{many}{k}"), eps / cuts) for k in range(3)]
    else:
        same = eps == 0
        few_rows = few_rows.withColumns({f"__h{k}": F.col(f"{few}{k}") if same else F.lit(0) for k in range(3)})
        grid = [F.col(f"{many}{k}") if same else F.lit(0) for k in range(3)]
    many_rows = sides[many].withColumns({f"__g{k}": g for k, g in enumerate(grid)})
    on = distance([F.col(f"{many}{k}") for k in range(3)], [F.col(f"{few}{k}") for k in range(3)]) <= F.lit(eps)
    if most > CROWDED or not celled:
        many_rows, few_rows = _dealt(many_rows, few_rows, many)
        on = on & (F.col("__own") == F.col("__to"))
    for k in range(3):
        on = (F.col(f"__g{k}") == F.col(f"__h{k}")) & on
    bounded = lambda df, n: F.broadcast(df) if n <= BROADCAST_ROWS else df.hint("merge")
    if wanted == "ab":
        if tasks and held[few][0] * copies <= BROADCAST_ROWS:
            many_rows = many_rows.repartition(tasks)
        elif tasks:
            dealt = "__own" in many_rows.columns
            many_rows = many_rows.repartition(tasks, *(f"__g{k}" for k in range(3)), *["__own"] * dealt)
            few_rows = few_rows.repartition(tasks, *(f"__h{k}" for k in range(3)), *["__to"] * dealt)
        return many_rows.join(bounded(few_rows, held[few][0] * copies), on).select("a", "b")
    if wanted == many:
        return many_rows.join(bounded(few_rows, held[few][0] * copies), on, "left_semi").select(f"{many}.*")
    met = few_rows.join(bounded(many_rows, rows), on, "left_semi").select(*(F.col(f"{few}{k}").alias(f"__m{k}") for k in range(3))).distinct()
    place = [F.col(f"{few}{k}") == F.col(f"__m{k}") for k in range(3)]
    return sides[few].join(bounded(met, held[few][0]), place, "left_semi").select(f"{few}.*")


def _dealt(many_rows: DataFrame, few_rows: DataFrame, many: str) -> tuple[DataFrame, DataFrame]:
    """Rows of crowded cubes get one of several numbers ``__own``; what meets such a cube goes there once for each as ``__to``."""
    crowded = many_rows.groupBy("__g0", "__g1", "__g2").agg(F.ceil(F.count("*") / F.lit(CROWDED)).alias("__parts")).where("__parts > 1")
    told = [F.col(f"{many}.`{f.name}`") for f in many_rows.schema[many].dataType if "map<" not in f.dataType.simpleString()]  # maps have no hash
    own = F.pmod(F.xxhash64(*told), F.coalesce("__parts", F.lit(1)))
    left = many_rows.join(crowded, ["__g0", "__g1", "__g2"], "left").withColumn("__own", own).drop("__parts")
    met = crowded.select(*(F.col(f"__g{k}").alias(f"__h{k}") for k in range(3)), "__parts")
    right = few_rows.join(met, ["__h0", "__h1", "__h2"], "left").withColumn("__to", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    return left, right


def crossmatch_healpix(a: DataFrame, b: DataFrame, nside: int, return_type: str = "AB", coords_a: Sequence[str] | None = None, coords_b: Sequence[str] | None = None, thetaphi: bool = False) -> DataFrame:
    """Rows of two spherical catalogues that fall in the same pixel.

    ``coords`` name the two angle columns (RA and Dec in degrees, or theta and
    phi). ``AB``: pairs as structs; ``A``/``B``: rows of one side with a match;
    ``healpix``: the pixels both sides occupy.
    """
    if return_type not in ("AB", "A", "B", "healpix"):
        raise AssertionError(f"returnType must be AB, A, B or healpix (got {return_type!r})")
    ya, za = coords_a or a.columns[1:3]
    yb, zb = coords_b or b.columns[1:3]
    pa, pb = to_healpix(nside, ya, za, thetaphi), to_healpix(nside, yb, zb, thetaphi)
    if return_type == "healpix":
        return a.select(pa.alias("healpix")).where("healpix is not null").intersect(b.select(pb.alias("healpix")))
    left = a.select(F.struct(*(F.col(f"`{c}`") for c in a.columns)).alias("a"), pa.alias("__p"))
    right = b.select(F.struct(*(F.col(f"`{c}`") for c in b.columns)).alias("b"), pb.alias("__q"))
    on = F.col("__p") == F.col("__q")
    if return_type == "AB":
        return left.join(right, on).select("a", "b")
    if return_type == "A":
        return left.join(right, on, "left_semi").select("a.*")
    return right.join(left, on, "left_semi").select("b.*")


CrossMatchCenter = crossmatch_center
CrossMatchHealpixIndex = crossmatch_healpix
