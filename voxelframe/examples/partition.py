"""Times the exact exchange against range, order and hash exchanges, and shows how even each is."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import functions as F

from voxelframe.examples import common
from voxelframe.operators.balance import checkLoadBalancing
from voxelframe.operators.repartition import repartition_as

MODES = ("col", "range", "order", "rep", "col-no")


def main(argv: Sequence[str] | None = None) -> list[tuple[str, float, int, float, float]]:
    p = common.parser(__doc__)
    p.add_argument("--modes", default=",".join(MODES), help="by commas")
    p.add_argument("--repeats", type=int, default=2, help="runs of each mode; the best counts")
    args = p.parse_args(argv)
    rows = common.labelled(common.session(), args, args.grid or "onion")
    n = args.partitions if args.partitions > 0 else rows.rdd.getNumPartitions()
    out = []
    for mode in args.modes.split(","):
        best, load = None, None
        for _ in range(args.repeats):
            began = time.perf_counter()
            load = checkLoadBalancing(repartition_as(rows, mode, n), "size").agg(F.count("*"), F.min("Load (#Rows)"), F.max("Load (#Rows)")).first()
            best = min(time.perf_counter() - began, best or 1e9)
        out.append((mode, best, *load))
        print(f"{mode}: {best:.3f} s, {load[0]} partitions of {load[1]:.0f} to {load[2]:.0f} rows")
    return out


if __name__ == "__main__":
    main()
