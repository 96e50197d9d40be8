"""Rows inside a point, sphere, shell or box window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from voxelframe.examples import common
from voxelframe.operators.window import windowquery


def main(argv: Sequence[str] | None = None) -> DataFrame:
    p = common.parser(__doc__)
    p.add_argument("--window", choices=("point", "sphere", "shell", "box"), default="sphere")
    p.add_argument("--coordinates", required=True, help="numbers of the window, by commas (write --coordinates=-1,... if the first is negative)")
    args = p.parse_args(argv)
    names = common.coordinates(args)
    rows = common.placed(common.session(), args)
    inside = windowquery(rows.select(*names), args.window, [float(v) for v in args.coordinates.split(",")], common.system(args))
    print(f"{inside.count()} rows inside")
    if args.picture:
        common.draw(args.picture, [("data", rows), ("inside", inside)], names)
    return inside


if __name__ == "__main__":
    main()
