"""Optional driver-side 3-D scatter plots. matplotlib is imported only when a plot is drawn."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sphere_mesh(x: float, y: float, z: float, r: float, steps: int = 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Surface of a sphere as three grids."""
    u, v = np.meshgrid(np.linspace(0, 2 * np.pi, 2 * steps), np.linspace(0, np.pi, steps), indexing="ij")
    return x + r * np.cos(u) * np.sin(v), y + r * np.sin(u) * np.sin(v), z + r * np.cos(v)


def sample_by_partition(df: DataFrame, names: Sequence[str], fraction: float, label: str = "partition_id", seed: int = 0) -> dict[int, np.ndarray]:
    """A sample of the rows of each label, for one colour per partition. Only the sample comes to the driver."""
    rows = df.select(label, *(F.col(f"`{n}`").cast("double").alias(n) for n in names)).sample(fraction, seed=seed).toPandas()
    return {int(k): g[list(names)].to_numpy() for k, g in rows.groupby(label)}


def scatter3d_mpl(x, y, z, radius=None, label: str | None = None, axIn=None, **kwargs):
    """Scatter of points, or of spheres if ``radius`` is given (one radius per point)."""
    if radius is not None and len(radius) != len(x):
        raise AssertionError("radius must have as many values as there are points")
    try:
        import matplotlib.pyplot as plt
    except ImportError as e:
        raise ImportError("plotting needs matplotlib") from e
    ax = axIn or plt.figure().add_subplot(projection="3d")
    ax.scatter(x, y, z, s=20 if radius is None else [r * 500 for r in radius], label=label, **kwargs)
    return ax
