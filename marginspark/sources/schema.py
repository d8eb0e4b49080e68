"""Schemas of the tables that jobs read and write."""

from __future__ import annotations

POINTS = "id bigint, x array<double>, y int"
DUALS = f"{POINTS}, zeta double, beta double, slot int, part int"
CENTERS = "cid int, cx array<double>"
COEF = "level int, id bigint, coef double"
MODEL = "j int, w double"
HISTORY = (
    "solver string, level int, n_parts int, n_rows bigint, n_support bigint, "
    "max_part_rows bigint, n_split_parts int, elapsed_ms bigint"
)
TRACE = "epoch int, round int, w array<double>, batch_loss double"
