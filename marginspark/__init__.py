"""Margin-distribution classifiers trained as Spark jobs.

Labelled points are DataFrames ``(id, x, y)``.  See the README for the layout.
"""

from marginspark.params import MarginParams
from marginspark.plans.hierarchy import POLICIES, fit_hierarchy
from marginspark.plans.variance_reduced import (
    fit_block_svrg,
    fit_stratified_svrg,
    fit_svrg,
)

__all__ = [
    "MarginParams",
    "POLICIES",
    "fit_hierarchy",
    "fit_svrg",
    "fit_stratified_svrg",
    "fit_block_svrg",
]
