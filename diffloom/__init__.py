"""Change-review analytics on Spark: snapshots, line and block differences, moves, review state."""
