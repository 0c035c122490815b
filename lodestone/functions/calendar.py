"""Civil time to the four pillars: the sun's apparent longitude gives solar terms, day counts give day pillars.

Time is Shanghai civil time; the day pillar changes at midnight, year and month pillars at the exact term (start of
spring for the year). Longitudes follow the low-precision series of the sun (about 0.01 degrees, a quarter of an hour).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def sun_longitude(ts: Column) -> Column:
    """Apparent longitude of the sun in degrees at an instant."""
    t = (F.unix_micros(ts) / 1e6 / 86400.0 + 2440587.5 + 69.0 / 86400 - 2451545.0) / 36525.0
    mean = 280.46646 + 36000.76983 * t + 0.0003032 * t * t
    m = F.radians(357.52911 + 35999.05029 * t - 0.0001537 * t * t)
    centre = (1.914602 - 0.004817 * t) * F.sin(m) + (0.019993 - 0.000101 * t) * F.sin(2 * m) + 0.000289 * F.sin(3 * m)
    return F.pmod(mean + centre - 0.00569 - 0.00478 * F.sin(F.radians(125.04 - 1934.136 * t)), F.lit(360.0))


def pillars(ts: Column) -> dict[str, Column]:
    """year, month, day and hour as places 0..59 in the cycle of sixty."""
    local = F.from_utc_timestamp(ts, "Asia/Shanghai")
    longitude = sun_longitude(ts)
    month = F.floor(F.pmod(longitude - 315.0, F.lit(360.0)) / 30.0).cast("int")  # 0 from the start of spring on
    # Before the start of spring (longitudes 270 to 315 in the first months) the year is the one before.
    year = F.year(local) - F.when((F.month(local) <= 2) & (longitude < 315.0) & (longitude > 200.0), 1).otherwise(0)
    year_place = F.pmod(year - 4, F.lit(60))
    month_stem = (year_place % 5 * 2 + 2 + month) % 10
    month_branch = (month + 2) % 12
    day = F.pmod(F.unix_date(F.to_date(local)) + 17, F.lit(60))
    hour_branch = F.floor((F.hour(local) + 1) / 2).cast("int") % 12
    hour_stem = (day % 5 * 2 + hour_branch) % 10

    def place(stem: Column, branch: Column) -> Column:
        """The place with that stem and branch: 6 stem - 5 branch modulo 60."""
        return F.pmod(6 * stem - 5 * branch, F.lit(60)).cast("int")

    return {"year": year_place.cast("int"), "month": place(month_stem, month_branch), "day": day.cast("int"), "hour": place(hour_stem, hour_branch)}


def by_terms(df: DataFrame, at: str, terms: DataFrame) -> DataFrame:
    """df with the columns of the term in whose time its instant `at` falls; null before the first term and after the last.

    terms: `instant` and whatever belongs to it, from an exact table of solar terms (a few rows a year). Each term stands for the
    calendar months that its time touches, so instants meet one or two terms of their month by an equi-join.
    """
    own = [c for c in terms.columns if c != "instant"]
    month = lambda c: F.trunc(c, "month")
    spans = terms.select("instant", *own, F.lead("instant").over(Window.orderBy("instant")).alias("_next")).where("_next is not null")
    touched = spans.select("*", F.explode(F.sequence(month("instant"), month("_next"), F.expr("interval 1 month"))).alias("_month"))
    t = touched.select(F.col("_month").alias("_m"), F.col("instant").alias("_from"), F.col("_next").alias("_to"), *(F.col(c).alias(f"_t_{c}") for c in own))
    hit = (month(F.col("_at")) == F.col("_m")) & (F.col("_at") >= F.col("_from")) & (F.col("_at") < F.col("_to"))
    return df.select(F.struct("*").alias("_own"), F.col(at).alias("_at")).join(t, hit, "left").select("_own.*", *(F.col(f"_t_{c}").alias(c) for c in own))
