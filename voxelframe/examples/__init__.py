"""Command lines: ``python -m voxelframe.examples.knn --help``, and likewise ``window``, ``partition`` and ``picture``."""
