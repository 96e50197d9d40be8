"""Nearest neighbours of a target, plain and distinct."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from voxelframe.examples import common
from voxelframe.operators.knn import knn


def main(argv: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    p = common.parser(__doc__)
    p.add_argument("--target", type=float, nargs=3, default=[0.2, 0.2, 0.2])
    p.add_argument("-k", type=int, default=100)
    args = p.parse_args(argv)
    names = common.coordinates(args)
    rows = common.placed(common.session(), args)
    plain, distinct = (knn(rows, args.target, args.k, common.system(args), unique, coords=names).select(*names) for unique in (False, True))
    print("nearest:")
    plain.show(args.k)
    print("nearest, distinct:")
    distinct.show(args.k)
    if args.picture:
        common.draw(args.picture, [("data", rows), ("nearest", plain), ("nearest, distinct", distinct)], names)
    return plain, distinct


if __name__ == "__main__":
    main()
