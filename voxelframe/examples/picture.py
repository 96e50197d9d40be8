"""A sample of the rows of each partition of a grid, one colour per partition."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from voxelframe.examples import common
from voxelframe.plotting import sample_by_partition, scatter3d_mpl


def main(argv: Sequence[str] | None = None) -> dict[int, np.ndarray]:
    p = common.parser(__doc__)
    p.add_argument("--fraction", type=float, default=0.001, help="share of the rows to show")
    args = p.parse_args(argv)
    rows = common.labelled(common.session(), args, args.grid or "onion")
    found = sample_by_partition(rows, common.coordinates(args), args.fraction)
    for label, part in sorted(found.items()):
        print(f"partition {label}: {len(part)} rows shown")
    if args.picture:
        ax = None
        for label, part in sorted(found.items()):
            ax = scatter3d_mpl(*part.T, label=str(label), axIn=ax)
        ax.figure.savefig(args.picture)
    return found


if __name__ == "__main__":
    main()
