"""Figures that steer the search; none of them changes the result."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sampling_efficiency(matches: Column, comparisons: Column) -> Column:
    """New agree sets for each comparison; 0 without comparisons."""
    return F.when(comparisons == 0, F.lit(0.0)).otherwise(matches / comparisons)


def validation_efficiency(candidates: Column, invalid: Column) -> Column:
    """The valid share of the candidates; 1 without candidates."""
    return F.when(candidates <= 0, F.lit(1.0)).otherwise((candidates - invalid) / candidates)


def worth_caching(records, clusters, records_after, clusters_after, least: float = 0.05):
    """Whether refining makes a stripped partition's mean cluster smaller by ``least`` or more; of columns or of numbers.

    The records are then in the clusters left and, those that became single, each by itself.
    Always if no cluster is left, never if there was none.
    """
    if isinstance(records, Column):
        after = records / (clusters_after + records - records_after)
        return F.when(clusters == 0, F.lit(False)).when(clusters_after == 0, F.lit(True)).otherwise(1 - after / (records / clusters) >= least)
    if not clusters or not clusters_after:
        return bool(clusters)
    return 1 - (records / (clusters_after + records - records_after)) / (records / clusters) >= least
