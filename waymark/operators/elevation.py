"""Elevation labels of accepted points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .temporal import stream

TAGS = ("ele_missing", "ele_unparsable", "ele_out_of_bounds", "ele_adjacent_duplicate")


def labels(points: DataFrame, floor: float = -500.0, ceiling: float = 9500.0) -> DataFrame:
    """points with the four TAGS. A duplicate repeats the elevation of the accepted row before, whatever its index; any bad row resets."""
    ele, absent = F.col("ele"), F.coalesce("ele_absent", F.lit(True))
    flag = lambda c: F.coalesce(c, F.lit(False))
    out = points.withColumns({
        "ele_missing": ele.isNull() & absent, "ele_unparsable": ele.isNull() & ~absent, "ele_out_of_bounds": flag((ele < floor) | (ele > ceiling)),
        "_ele": F.when(ele.between(floor, ceiling) & ~flag(F.col("ele_absent")), ele)})
    return out.withColumn("ele_adjacent_duplicate", flag(F.col("_ele") == F.lag("_ele").over(stream()))).drop("_ele")


def counts(labelled: DataFrame, *by: str) -> DataFrame:
    """Counts of the tags and of points without one of the first three, by track and the columns given."""
    bad = F.col("ele_missing") | F.col("ele_unparsable") | F.col("ele_out_of_bounds")
    return labelled.groupBy("track_id", *by).agg(*(F.count_if(t).alias(t) for t in TAGS), F.count_if(~bad).alias("valid"))
