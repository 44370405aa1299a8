"""Report cards of employers: what they file, how it ends, what they pay against others in the same role, and grades for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutline.operators.ranks import below, percent_rank
from cutline.shared import small, stored

# The least figure for each grade, in order; what is under all of them is an F. Ranges are half-open.
VOLUME = [(500, "A"), (100, "B"), (20, "C"), (5, "D")]
APPROVAL = [(95, "A"), (90, "B"), (85, "C"), (80, "D")]
SALARY = [(0.8, "A"), (0.6, "B"), (0.3, "C"), (0.2, "D")]
CONVERSION = [(30, "A"), (20, "B"), (10, "C"), (5, "D")]
#: Days: under so many for each grade.
PROCESSING = [(180, "A"), (270, "B"), (365, "C"), (541, "D")]
#: The shares of the grades in the score; there are two sets of them.
WEIGHTS = {"volume": 25, "approval": 25, "salary": 30, "consistency": 20}
OTHER_WEIGHTS = {"volume": 20, "approval": 25, "salary": 35, "consistency": 20}
#: Pay periods of a year.
UNITS = {"hour": 2080, "week": 52, "bi-weekly": 26, "month": 12, "year": 1}
POINTS = {"A": 4, "B": 3, "C": 2, "D": 1, "F": 0}
OVERALL = [(3.5, "A"), (2.5, "B"), (1.5, "C"), (0.5, "D")]
STATS = ["n", "mean", "low", "high", "median"]


def annual(wage: Column, unit: Column) -> Column:
    """A wage by the year; null for an unknown unit."""
    factors = F.create_map(*(F.lit(x) for pair in UNITS.items() for x in pair))
    return wage * F.try_element_at(factors, F.lower(F.trim(unit)))


def grade(figure: Column, steps: list[tuple[float, str]]) -> Column:
    """The first grade whose least figure is reached, else F; null for no figure."""
    found = F.coalesce(*(F.when(figure >= least, letter) for least, letter in steps), F.lit("F"))
    return F.when(figure.isNotNull(), found)


def _under(figure: Column, steps: list[tuple[float, str]]) -> Column:
    return F.when(figure.isNotNull(), F.coalesce(*(F.when(figure < most, letter) for most, letter in steps), F.lit("F")))


def score(weights: dict[str, int]) -> Column:
    """The weighted mean of the points of grades (columns x_grade); those without a grade do not count."""
    points = F.create_map(*(F.lit(x) for pair in POINTS.items() for x in pair))
    parts = [(F.try_element_at(points, F.col(f"{name}_grade")), weight) for name, weight in weights.items()]
    total = sum((F.coalesce(p * w, F.lit(0)) for p, w in parts), F.lit(0))
    return F.try_divide(total.cast("double"), sum((F.when(p.isNotNull(), w).otherwise(0) for p, w in parts), F.lit(0)))


def cards(records: DataFrame, last_year: int, weights: dict[str, int] = WEIGHTS) -> DataFrame:
    """One row per employer of records (employer, source, role, year, certified, wage, days): its figures, a grade for each, score and overall grade.

    source is PERM or H-1B. volume: PERM records of the last year. approval: percent of all records that are certified.
    conversion: PERM records by H-1B records in percent, null without any. consistency: A for records in each of
    the last five years and more in the last than in the first, B for each of them, C for four, D for three.
    salary: the employer's mean ratio of a wage to the mean wage of its role, as a percent rank among employers.
    processing: median days of PERM records. Figures of an employer are sums that combine before
    their shuffle, the median is of day counts, and roles' means are joined by size.
    """
    roles = stored(records.where(F.col("wage").isNotNull()).groupBy(F.col("role").alias("of_role")).agg((F.sum(F.col("wage").cast("decimal(20,4)")).cast("double") / F.count("*")).alias("usual")))
    rows = records.join(small(roles), F.col("role").eqNullSafe(F.col("of_role")), "left")
    perm, years = F.col("source") == "PERM", range(last_year - 4, last_year + 1)
    in_year = {y: F.count_if(F.col("year") == y).alias(f"y{y}") for y in years}
    ratio = F.bround(F.try_divide(F.col("wage"), F.col("usual")), 6).cast("decimal(20,6)")
    one = rows.groupBy("employer").agg(
        F.count("*").alias("n"), F.count_if(perm).alias("perms"), F.count_if(F.col("source") == "H-1B").alias("h1bs"), F.count_if(perm & (F.col("year") == last_year)).alias("volume"),
        F.count_if("certified").alias("certified"), F.sum(ratio).alias("ratios"), F.count(ratio).alias("paid"), F.percentile(F.when(perm, F.col("days")), 0.5).alias("processing"), *in_year.values(),
    )
    filed = sum((F.when(F.col(f"y{y}") > 0, 1).otherwise(0) for y in years), F.lit(0))
    one = one.withColumns({"approval": F.col("certified") * 100.0 / F.col("n"), "conversion": F.try_divide(F.col("perms") * 100.0, F.col("h1bs")), "years": filed, "against_role": F.try_divide(F.col("ratios").cast("double"), F.col("paid"))})
    growing = F.col(f"y{last_year}") > F.col(f"y{last_year - 4}")
    steady = F.when((F.col("years") == 5) & growing, "A").when(F.col("years") == 5, "B").when(F.col("years") == 4, "C").when(F.col("years") == 3, "D").otherwise("F")
    ranked = percent_rank(stored(one), "against_role", name="salary").drop("rank")
    graded = ranked.withColumns({
        "volume_grade": grade(F.col("volume"), VOLUME), "approval_grade": grade(F.col("approval"), APPROVAL), "salary_grade": grade(F.col("salary"), SALARY), "consistency_grade": steady,
        "conversion_grade": grade(F.col("conversion"), CONVERSION), "processing_grade": _under(F.col("processing"), PROCESSING),
    })
    graded = graded.withColumn("score", score(weights)).withColumn("overall", grade(F.col("score"), OVERALL))
    figures = ["n", "volume", "approval", "salary", "years", "conversion", "processing"]
    return graded.select("employer", *figures, *(c for c in graded.columns if c.endswith("_grade")), "score", "overall")


def ranking(found: DataFrame, by: str = "score", least: int = 20, top: int = 100) -> DataFrame:
    """The first `top` cards with a place, by the named figure (null last), then employer; of employers with at least `least` records."""
    first = found.where(F.col("n") >= least).orderBy(F.desc_nulls_last(by), "employer").limit(top)
    return first.withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last(by), "employer")))  # of `top` rows


def compare(found: DataFrame, employers: list) -> DataFrame:
    """The cards of up to five employers."""
    if len(employers) > 5:
        raise ValueError("at most five employers can be compared")
    return found.where(F.col("employer").isin(employers))


def stats(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """(by, n, mean, low, high, median) of the values that are not null, the median exact: found by places among counts of values, so that no group is gathered. Without `by` one row, of no values nulls and 0."""
    by = by or []
    counts = below(rows.where(~F.isnan(F.col(value).cast("double"))), value, by)
    place = lambda p: F.max(F.when((F.col("below") <= p) & (p < F.col("below") + F.col("n")), F.col("value").cast("double")))
    low, high = F.expr("(total - 1) div 2"), F.expr("total div 2")
    made = counts.groupBy(*by).agg(F.sum("n").alias("all"), F.sum(F.col("value").cast("decimal(20,4)") * F.col("n")).alias("sum"), F.min("value").alias("low"), F.max("value").alias("high"), place(low).alias("a"), place(high).alias("b"))
    return made.select(*by, F.coalesce("all", F.lit(0)).cast("long").alias("n"), F.try_divide(F.col("sum").cast("double"), F.col("all")).alias("mean"), F.col("low").cast("double").alias("low"), F.col("high").cast("double").alias("high"), (F.col("a") + (F.col("b") - F.col("a")) * 0.5).alias("median"))


def profile(records: DataFrame, top: int = 20) -> DataFrame:
    """(employer, kind, value, n, mean, share, place): each employer's records by role, year and place of work, from one aggregate over grouping sets.

    share: percent of the employer's records. place: by n, then value; of roles only the first `top` are given. A null value is one of its own.
    Records are dealt by employer first, in parts of a bounded size (an employer of very many has several), so
    a task counts the values of its own employers and not of all.
    """
    kinds = {"role": "role", "year": "year", "location": "location"}
    rows = records.select("employer", F.col("role").cast("string").alias("role"), F.col("year").cast("string").alias("year"), F.col("location").cast("string").alias("location"), "wage").hint("rebalance", "employer")
    e, columns = F.col("employer"), [F.col(c) for c in kinds]
    sums = rows.groupingSets([(e,), *((e, c) for c in columns)], e, *columns).agg(F.count("*").alias("n"), F.sum(F.col("wage").cast("decimal(20,4)")).alias("total"), F.count("wage").alias("paid"), *(F.grouping(c).alias(f"no_{c}") for c in kinds))
    sums = stored(sums)
    kind = F.coalesce(*(F.when(F.col(f"no_{c}") == 0, F.lit(c)) for c in kinds))
    every = sums.withColumns({"kind": kind, "value": F.coalesce(*(F.when(F.col(f"no_{c}") == 0, F.col(c)) for c in kinds))})
    whole = every.where("kind is null").select(F.col("employer").alias("of"), F.col("n").alias("whole"))
    order = Window.partitionBy("employer", "kind").orderBy(F.desc("n"), F.asc_nulls_first("value"))
    placed = every.where("kind is not null").withColumn("place", F.row_number().over(order)).where((F.col("kind") != "role") | (F.col("place") <= top))
    found = placed.join(whole, F.col("employer").eqNullSafe(F.col("of")))
    return found.select("employer", "kind", "value", "n", F.try_divide(F.col("total").cast("double"), F.col("paid")).alias("mean"), (F.col("n") * 100.0 / F.col("whole")).alias("share"), "place")


def receipt_ranges(cases: DataFrame, width: int, statuses: list[str]) -> DataFrame:
    """(bucket, first, last, n, a share for each status, mean_days) of cases (receipt, status, days), by ranges of `width` receipt numbers; other statuses count in n only."""
    each = [(F.count_if(F.col("status") == s) * 1.0 / F.count("*")).cast("double").alias(f"share_{s.lower()}") for s in statuses]
    bucket = F.floor(F.col("receipt") / width).alias("bucket")
    return cases.where(F.col("receipt").isNotNull()).groupBy(bucket).agg(F.min("receipt").alias("first"), F.max("receipt").alias("last"), F.count("*").alias("n"), *each, F.try_divide(F.sum("days").cast("double"), F.count("days")).alias("mean_days"))
