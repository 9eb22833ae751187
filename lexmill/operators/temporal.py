"""As-of and interval joins without theta joins over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_backward(left: DataFrame, on: Column, right: DataFrame, right_on: Column, payload: list[str], by: list[str] | None = None) -> DataFrame:
    """Each left row with the payload of the last right row at or before it (ties: the greatest payload).

    Both sides are laid on one line and the last right value is carried forward by a window. Without keys the line would be one
    partition, so it is cut into months first: inside a month rows are carried by the window, and each month starts with
    the last value before it, taken from the right side's month ends alone.
    """
    value = F.struct(*payload)
    keys = by or []
    lefts = left.withColumns({"__on": on.cast("timestamp"), "__side": F.lit(1), "__v": F.lit(None)})
    rights = right.select(*keys, right_on.cast("timestamp").alias("__on"), F.lit(0).alias("__side"), value.alias("__v")).where("__on is not null")
    lefts = lefts.withColumn("__v", F.lit(None).cast(rights.schema["__v"].dataType))
    rights = rights.groupBy(*keys, "__on", "__side").agg(F.max("__v").alias("__v"))
    month = F.trunc(F.col("__on"), "month")
    line = lefts.unionByName(rights, allowMissingColumns=True).withColumn("__m", month)
    inside = Window.partitionBy(*keys, "__m").orderBy("__on", "__side").rowsBetween(Window.unboundedPreceding, 0)
    line = line.withColumn("__in", F.last("__v", ignorenulls=True).over(inside)).where("__side = 1")
    ends = rights.groupBy(*keys, month.alias("__em")).agg(F.max(F.struct("__on", "__v")).alias("__e"))
    months = left.select(*keys, F.trunc(on.cast("timestamp"), "month").alias("__em")).distinct()
    # months of either side, in order: the last end strictly before each (as many rows as months)
    steps = ends.select(*keys, "__em", F.col("__e.__v").alias("__v")).unionByName(months, allowMissingColumns=True)
    steps = steps.groupBy(*keys, "__em").agg(F.max("__v").alias("__v"))
    before = Window.partitionBy(*keys).orderBy("__em").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__em").alias("__sm"), F.last("__v", ignorenulls=True).over(before).alias("__before"))
    cond = F.col("__m") == F.col("__sm")
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"__k_{k}"))
    joined = line.join(steps, cond, "left").withColumn("__r", F.coalesce("__in", "__before"))
    return joined.select(*left.columns, *[F.col("__r")[p].alias(p) for p in payload])


def point_in_range(points: DataFrame, at: Column, ranges: DataFrame, lo: Column, hi: Column, width: float, columns: list[str]) -> DataFrame:
    """Inner join of points with the half-open ranges that hold them, as an equi-join on cells of ``width``."""
    r = ranges.select(*columns, lo.alias("__lo"), hi.alias("__hi")).where("__lo < __hi")
    r = r.withColumn("__cell", F.explode(F.sequence(F.floor(F.col("__lo") / width).cast("long"), F.floor(F.col("__hi") / width).cast("long"))))
    p = points.withColumn("__at", at).withColumn("__c", F.floor(F.col("__at") / width).cast("long"))
    return p.join(r, (F.col("__c") == F.col("__cell")) & (F.col("__at") >= F.col("__lo")) & (F.col("__at") < F.col("__hi"))).drop("__at", "__c", "__cell", "__lo", "__hi")


def status_for(applies_after: Column, tax_year: Column) -> Column:
    """applies if the year begins after the date, else not_yet; without a date unknown."""
    first = F.make_date(tax_year, F.lit(1), F.lit(1))
    return F.when(applies_after.isNull(), "unknown").when(first > applies_after, "applies").otherwise("not_yet")


def later_amendments(notes: DataFrame, sections: DataFrame) -> DataFrame:
    """(section_id, tax_year, heading, applies_after): amendments that don't reach the year yet, one row a note.

    ``sections``: section_id, tax_year. An equi-join on the section; an amendment of 1 January counts as later.
    """
    n = notes.where(F.col("topic").isin("effectiveDateOfAmendment", "prospectiveAmendment") & F.col("applies_after").isNotNull())
    n = n.select("section_id", "heading", "applies_after")
    rows = sections.select("section_id", "tax_year").distinct().join(n, "section_id")
    return rows.where(F.col("applies_after") >= F.make_date("tax_year", F.lit(1), F.lit(1))).select("section_id", "tax_year", "heading", "applies_after")
