"""Computations over time series of holdings and amounts: ownership shifts, limitation schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, IntegralType

#: Percentage points; strictly more is a change, this much makes a holder count.
CHANGE, FIVE_PERCENT = 50, 5
#: Three years in places (below).
YEARS = 2 * 31 * 36 + 1


def window_start(day: Column) -> Column:
    """Three years before; 29 February becomes 28 February."""
    return F.add_months(day, -36)


def _place(day: Column) -> Column:
    """A day as a number, three years a fixed distance apart; 29 February stands right behind the 28th, so that a window from it begins on the 28th."""
    leap = (F.month(day) == 2) & (F.day(day) == 29)
    return 2 * (31 * (12 * F.year(day) + F.month(day)) + F.day(day)) - F.when(leap, 1).otherwise(0)


def owner_shift(register: DataFrame, entity: str, day: str, holder: str, percent: str) -> DataFrame:
    """(entity, when, total_increase, changed): for every date of an entity's register, the sum over holders of the rise
    from the lowest holding in the three years to that date.

    The low also counts the last holding before the window. Holders who never reached five per cent up to the date are left out;
    of several rows of one holder and day the greatest counts. A holder's rise only changes on a day of a holding, or when one leaves the window:
    these changes, at most two a holding, are summed up along an entity's days. Dates and holders never meet in pairs.
    """
    kind = register.schema[percent].dataType
    exact = isinstance(kind, DecimalType | IntegralType)  # sums of changes have to be exact
    p = F.col(percent) if exact else F.col(percent).cast("decimal(28,12)")
    h = register.select(F.col(entity).alias("e"), F.col(day).cast("date").alias("d"), F.col(holder).alias("h"), p.alias("p")).where("e is not null and d is not null")
    h = h.groupBy("e", "h", "d").agg(F.max("p").alias("p")).repartition("e", "h")  # once for all that follows
    # a holding leaves when the next one, too, lies before the window: on the first day whose window begins after that one's day
    after = F.date_add("d", 1)
    leaves = F.date_add(F.add_months(after, 36), F.when((F.month(after) == 2) & (F.day(after) == 29), 1).otherwise(0))
    steps = F.array(F.struct(F.col("d").alias("t"), F.lit(True).alias("own"), F.struct("p").alias("held")), F.struct(leaves.alias("t"), F.lit(False).alias("own"), F.lit(None).cast(f"struct<p:{h.schema['p'].dataType.simpleString()}>").alias("held")))
    s = h.select("e", "h", F.explode(steps).alias("x")).select("e", "h", "x.*").groupBy("e", "h", "t").agg(F.max("own").alias("own"), F.max("held").alias("held"))
    s = s.withColumn("at", _place(F.col("t")))
    so_far = Window.partitionBy("e", "h").orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    inside = Window.partitionBy("e", "h").orderBy("at").rangeBetween(-YEARS, 0)
    before = Window.partitionBy("e", "h").orderBy("at").rangeBetween(Window.unboundedPreceding, -YEARS - 1)
    last = lambda w: F.last("held", ignorenulls=True).over(w)["p"]
    s = s.select("e", "h", "t", "own", last(so_far).alias("now"), F.least(F.min("held.p").over(inside), last(before)).alias("low"), F.max("held.p").over(so_far).alias("peak"))
    rise = F.when(F.col("peak") >= FIVE_PERCENT, F.greatest(F.col("now") - F.col("low"), F.lit(0)))
    s = s.select("e", "h", "t", "own", F.coalesce(rise, F.lit(0)).alias("rise"))
    change = F.col("rise") - F.coalesce(F.lag("rise").over(Window.partitionBy("e", "h").orderBy("t")), F.lit(0))
    days = s.withColumn("change", change).groupBy("e", "t").agg(F.max("own").alias("own"), F.sum("change").alias("change"))  # no more rows an entity than days
    total = F.sum("change").over(Window.partitionBy("e").orderBy("t").rowsBetween(Window.unboundedPreceding, 0))
    out = days.withColumn("total_increase", total).where("own").withColumn("changed", F.col("total_increase") > CHANGE)
    shown = F.col("total_increase") if exact else F.col("total_increase").cast(kind)
    return out.select(F.col("e").alias(entity), F.col("t").alias("when"), shown.alias("total_increase"), "changed")


def shift_summary(shifts: DataFrame, entity: str) -> DataFrame:
    """(entity, first_change, peak_when, peak): from ``owner_shift``, the first date of a change (null: none) and the greatest rise, of equal ones the earliest."""
    first = F.min(F.when(F.col("changed"), F.col("when"))).alias("first_change")
    top = F.max(F.struct("total_increase", (-F.unix_date("when")).alias("day"), "when"))
    rows = shifts.groupBy(entity).agg(first, top.alias("top"))
    return rows.select(entity, "first_change", F.col("top.when").alias("peak_when"), F.col("top.total_increase").alias("peak"))


def total_absorbed(schedule: DataFrame, id_col: str) -> DataFrame:
    """(id, total): what a limitation schedule's years absorb together."""
    return schedule.groupBy(id_col).agg(F.sum("absorbed").alias("total"))


def limitations(scenarios: DataFrame, rates: DataFrame) -> DataFrame:
    """Scenarios (id, change_date, value, rbig, continuity, short_days) with annual and first: the yearly ceiling and a short first year's.

    The rate is that of the exact month of the change; without one both are null, never a neighbour's. Built-in gains are added;
    without continuity of business the ceiling is 0. A short year counts days / 365. ``rates``: month, rate (per cent).
    """
    money = lambda c: F.round(c, 2).cast("decimal(20,2)")
    r = rates.select(F.col("month").alias("r_month"), F.col("rate").alias("r_rate"))
    rows = scenarios.join(r, F.trunc("change_date", "month") == F.col("r_month"), "left")
    base = money(F.col("value") * F.col("r_rate") / 100) + F.coalesce(F.col("rbig"), F.lit(0).cast("decimal(20,2)"))
    annual = F.when(F.col("r_rate").isNotNull(), F.when(F.coalesce("continuity", F.lit(True)), base).otherwise(F.lit(0)))
    rows = rows.withColumn("annual", annual.cast("decimal(20,2)"))
    return rows.withColumn("first", money(F.col("annual") * F.coalesce("short_days", F.lit(365)) / 365)).drop("r_month", "r_rate")


def carryover_checklist(provisions: DataFrame, root: str) -> DataFrame:
    """(id, num, heading, repealed): headed children's children of a subsection, in order of number."""
    rows = provisions.where(F.col("id").startswith(root + "/") & (F.size("path") == 2) & F.col("heading").isNotNull())
    return rows.select("id", "num", "heading", F.lower("heading").startswith("repealed").alias("repealed")).orderBy(F.col("num").try_cast("int"), "num")


def limitation_schedule(scenarios: DataFrame, id_col: str, annual: str, nol: str, incomes: str, first: str | None = None) -> DataFrame:
    """(id, year, available, absorbed, carry, remaining): a fold over each scenario's incomes.

    Each year's ceiling is the annual amount and what was carried; absorbed is the least of ceiling, income and what remains;
    unused ceiling carries forward. The fold is one expression on the row; a null income is no limit.
    """
    zero = F.lit(0).cast("decimal(20,2)")
    dec = lambda c: c.cast("decimal(20,2)")
    start = F.struct(zero.alias("carry"), dec(F.col(nol)).alias("remaining"), F.array().cast("array<struct<available:decimal(20,2),absorbed:decimal(20,2),carry:decimal(20,2),remaining:decimal(20,2)>>").alias("years"))

    def step(a: Column, income: Column) -> Column:
        share = F.when(F.size(a["years"]) == 0, F.coalesce(F.col(first), F.col(annual))).otherwise(F.col(annual)) if first else F.col(annual)
        ceiling = dec(share + a["carry"])
        used = dec(F.greatest(F.least(ceiling, dec(income), a["remaining"]), zero))  # least skips nulls
        row = F.struct(ceiling.alias("available"), used.alias("absorbed"), dec(ceiling - used).alias("carry"), dec(a["remaining"] - used).alias("remaining"))
        return F.struct(row["carry"].alias("carry"), row["remaining"].alias("remaining"), F.concat(a["years"], F.array(row)).alias("years"))

    years = F.aggregate(F.col(incomes), start, step, lambda a: a["years"])
    return scenarios.select(F.col(id_col), F.posexplode(years).alias("year", "y")).select(id_col, F.col("year").cast("long").alias("year"), "y.*")
