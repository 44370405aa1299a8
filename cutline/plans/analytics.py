"""Queries over orders, their lines, customers, parts and suppliers, read as filings, wages, employers and titles; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutline.operators import history, matching, names, ranks, report_card, rollups, scenarios, series, stored_stats, text_index
from cutline.plans import sql
from cutline.shared import new_path, stored, written
from cutline.sources import delimited
from cutline.sources.bindings import cutoffs
from cutline.streaming import movement

SUBMISSION = "1993-06-01"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


FILING = {"key": "o_custkey", "value": "o_totalprice", "date": "o_orderdate", "id": "o_orderkey"}


def band_matches(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders")
    found = matching.best_matches(orders, orders, FILING)
    return found.select("o_orderkey", "match_id", "match_value", "match_date", "n_matches")


def percent_ranks(spark, sf_dir):
    return ranks.percent_rank(_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice")


def percent_ranks_by_priority(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.floor(F.col("o_totalprice") / 1000).alias("thousands"))
    return ranks.percent_rank(orders, "thousands", ["o_orderpriority"])


def histogram_equal_width(spark, sf_dir):
    return ranks.equal_width(_table(spark, sf_dir, "orders"), "o_totalprice", 20)


def histogram_equal_depth(spark, sf_dir):
    return ranks.equal_depth(_table(spark, sf_dir, "lineitem"), "l_quantity", 8, by=["l_returnflag"])


def yearly_trends(spark, sf_dir):
    return ranks.yearly_trend(_table(spark, sf_dir, "orders"), "o_totalprice", "o_orderdate", ["o_orderpriority"])


def stored_percentiles(spark, sf_dir):
    """Lines as wage records of employers, by source and year: stored up to 1998, then refreshed with the months after it."""
    lines = _table(spark, sf_dir, "lineitem").where("l_returnflag <> 'R'")
    rows = lines.select(F.col("l_suppkey").alias("employer"), F.col("l_linestatus").alias("source"), F.year("l_shipdate").alias("year"), F.trunc("l_shipdate", "month").alias("month"), F.col("l_extendedprice").alias("wage"))
    path, by = new_path(spark, "stored-stats"), ["employer", "source", "year"]
    months = [r[0] for r in rows.where("year >= 1999").select("month").distinct().collect()]
    stored_stats.build(rows.where("year < 1999"), path, by, "wage", "month")
    stored_stats.refresh(rows, path, months, by, "wage", "month")
    return stored_stats.view(spark, path, by, {"median": 0.5, "upper": 0.9})


#: What the search looks for.
TEXTS = ["Widget", "ring", "0042", "MACHIN", "er#00000012", "no such text", "E"]


def contained_text(spark, sf_dir):
    """Customers and parts of which a name or kind contains a text."""
    made = None
    for table, id, columns in (("customer", "c_custkey", ["c_name", "c_mktsegment"]), ("part", "p_partkey", ["p_name", "p_type"])):
        rows, path = _table(spark, sf_dir, table).select(id, *columns), new_path(spark, f"index-{table}")
        text_index.add(rows, path, id, columns)
        hits = text_index.search_each(rows, path, TEXTS, id, columns)
        hits = hits.select(F.lit(table).alias("kind"), "looked_for", F.col(id).alias("id"), *(F.col(c).alias(n) for c, n in zip(columns, ("name", "sort"), strict=True)))
        made = hits if made is None else made.unionByName(hits)
    return made


def monthly_movement(spark, sf_dir):
    return movement.movement(series.points(cutoffs(spark, sf_dir)), SUBMISSION)


def monthly_movement_stream(spark, sf_dir):
    """The same rows, by a stream that gets the months in two parts, each month of the second later than those of the first."""
    columns = [*series.SERIES, "publication_date", "cutoff_date"]
    points = stored(series.points(cutoffs(spark, sf_dir)).select(*columns))
    arriving, path, checkpoint = (new_path(spark, f"movement-{x}") for x in ("points", "table", "stream"))
    for early in (True, False):
        points.where((F.col("publication_date") < "1998-01-01") == early).write.mode("append").parquet(arriving)
        movement.keep_current(spark.readStream.schema(points.schema).parquet(arriving), path, checkpoint)
    return movement.read(spark, path, SUBMISSION)


#: How the names of parts are spelled, by the last digits of their keys.
SPELLED = "CASE p_partkey % 12 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name || ' Inc.' WHEN 2 THEN p_name || ', LLC' WHEN 3 THEN substr(p_name, 1, 2) || substr(p_name, 4) WHEN 4 THEN substr(p_name, 1, 1) || p_name WHEN 5 THEN substr(p_name, 1, 1) || 'x' || substr(p_name, 3) ELSE p_name END"


def canonical_names(spark, sf_dir):
    return names.canonical_names(_table(spark, sf_dir, "part").select(F.expr(SPELLED).alias("name")), "name")


def changelog(spark, sf_dir):
    """Customers and the priority of their last order of each day as a grade that holds until another is known; taken in by three batches in no order of time."""
    rows = _table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("day"), "o_orderkey", "o_orderpriority")
    key, values = ["o_custkey"], ["o_orderpriority"]
    seen, found = None, None
    for part in (1, 0, 2):
        batch = rows.where(F.col("o_orderkey") % 3 == part)
        seen = stored(history.observe(seen, batch, key, values, "day", "o_orderkey"))
        found = stored(history.intervals(seen, key, values, "day") if found is None else history.merge(found, seen, batch, key, values, "day"))
    return found


def changelog_as_of(spark, sf_dir):
    return history.as_of(changelog(spark, sf_dir), "1997-06-15").drop("valid_to")


def balance_rollup(spark, sf_dir):
    """Balances of customers by region, nation and segment, with shares and places."""
    nation, region = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    rows = _table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return rollups.rollup_shares(rows, ["r_name", "n_name", "c_mktsegment"], "c_acctbal")


def top_segments(spark, sf_dir):
    rows = _table(spark, sf_dir, "customer").join(_table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rollups.rollup_shares(rows, ["n_name", "c_mktsegment"], "c_acctbal", top=3).where("depth = 2").drop("depth")


def period_rates(spark, sf_dir):
    return scenarios.period_rates(series.points(cutoffs(spark, sf_dir)))


def wait_scenarios(spark, sf_dir):
    return scenarios.wait_scenarios(series.points(cutoffs(spark, sf_dir)), SUBMISSION)


def csv_orders(spark, sf_dir):
    """Orders written as lines of CSV by year, some of them spoilt, and read back: all rows that fit, and the keys of those that do not with the reason."""
    path, orders = new_path(spark, "csv-orders"), _table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    cents = F.when(k % 97 == 5, F.lit("a lot")).otherwise(F.round(F.col("o_totalprice") * 100).cast("long").cast("string"))
    status = F.when(k % 89 == 7, F.lit("")).otherwise(F.col("o_orderstatus"))
    line = F.concat_ws(",", k.cast("string"), F.when(k % 83 != 3, F.col("o_custkey").cast("string")), status, cents)
    orders.select(line.alias("value"), F.year("o_orderdate").alias("year")).write.partitionBy("year").text(path)
    rows = delimited.read(spark, path, "orderkey long, custkey long, status string, cents long", required=["status"], header=False)
    key = F.coalesce(F.when(F.col("reason") == "malformed", F.split("line", ",")[0].cast("long")), F.col("orderkey"))
    fits = lambda c: F.when(F.col("reason").isNull(), F.col(c)).alias(c)
    return rows.select(key.alias("orderkey"), fits("custkey"), fits("status"), fits("cents"), "year", "reason")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as records of employers: a PERM filing if still open by its line status, else an H-1B; the kind of part as the role, the customer's nation as the place of work."""
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_custkey")
    lines = _table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    lines = lines.join(_table(spark, sf_dir, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    lines = lines.join(_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    unit = F.element_at(F.array(*map(F.lit, ["Hour", "week", " Month", "Year", "Day"])), (F.col("l_orderkey") % 5 + 1).cast("int"))
    return lines.select(
        F.col("l_suppkey").alias("employer"), F.when(F.col("l_linestatus") == "O", "PERM").otherwise("H-1B").alias("source"), F.col("p_type").alias("role"), F.col("c_nationkey").alias("location"),
        F.year("l_shipdate").alias("year"), (F.col("l_returnflag") != "R").alias("certified"), report_card.annual(F.col("l_extendedprice"), unit).alias("wage"), F.abs(F.datediff("l_shipdate", "o_orderdate")).alias("days"),
    )


def report_cards(spark, sf_dir):
    return report_card.cards(_records(spark, sf_dir), last_year=2000)


def employer_ranking(spark, sf_dir):
    """The first hundred by score with the other weights; a top-k report."""
    return report_card.ranking(report_card.cards(_records(spark, sf_dir), 2000, report_card.OTHER_WEIGHTS)).select("place", "employer", "n", "score", "overall")


def compared_employers(spark, sf_dir):
    return report_card.compare(report_card.cards(_records(spark, sf_dir), 2000), [1, 3, 5, 8, 13])


def wage_stats(spark, sf_dir):
    """Of all wages by the year, and of each role's."""
    records = _records(spark, sf_dir)
    return report_card.stats(records, "wage", ["role"]).unionByName(report_card.stats(records, "wage").withColumn("role", F.lit("all roles")))


def wages_at_cost_of_living(spark, sf_dir):
    """Wages and their places among those of the role, as they are and at the cost of the place of work: a nation's mean order against that of all."""
    orders = _table(spark, sf_dir, "orders").join(_table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    mean = lambda total, n: total.cast("double") / n
    each = stored(orders.groupBy(F.col("c_nationkey").alias("location")).agg(F.sum(F.col("o_totalprice").cast("decimal(20,4)")).alias("total"), F.count("o_totalprice").alias("n")))
    usual = each.agg(mean(F.sum("total"), F.sum("n"))).first()[0]
    costs = each.select("location", F.round(mean(F.col("total"), F.col("n")) * 100 / F.lit(usual), 2).alias("cost"))
    records = written(_records(spark, sf_dir).select("employer", "role", "location", "year", "wage"), "records")
    return ranks.cost_adjusted(records, costs, "location", "wage", ["role"])


def employer_profiles(spark, sf_dir):
    return report_card.profile(_records(spark, sf_dir), top=3)


def receipt_ranges(spark, sf_dir):
    done = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("done"))
    cases = _table(spark, sf_dir, "orders").join(done, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return report_card.receipt_ranges(cases.select(F.col("o_orderkey").alias("receipt"), F.col("o_orderstatus").alias("status"), F.datediff("done", "o_orderdate").alias("days")), 500, ["F", "O"])


def reform_impact(spark, sf_dir):
    return scenarios.reform_impact(series.points(cutoffs(spark, sf_dir)), SUBMISSION)


QUERIES = {f.__name__: f for f in (band_matches, percent_ranks, percent_ranks_by_priority, histogram_equal_width, histogram_equal_depth, yearly_trends, stored_percentiles, contained_text, monthly_movement, monthly_movement_stream, canonical_names, changelog, changelog_as_of, balance_rollup, top_segments, period_rates, wait_scenarios, csv_orders, report_cards, employer_ranking, compared_employers, wage_stats, wages_at_cost_of_living, employer_profiles, receipt_ranges, reform_impact)}

def _like(kind: str, table: str, id: str, name: str, sort: str) -> str:
    return f"SELECT '{kind}' AS kind, t AS looked_for, {id} AS id, {name} AS name, {sort} AS sort FROM {table}, unnest({TEXTS}) u(t) WHERE lower({name}) LIKE '%' || lower(t) || '%' OR lower({sort}) LIKE '%' || lower(t) || '%'"


_MOVEMENT = f"""
    WITH {sql.BINDING}, {sql.points()},
    m AS (SELECT {sql.SERIES}, publication_date, cutoff_date, CAST(date_diff('day', lag(cutoff_date) OVER w, cutoff_date) AS INT) AS moved_days FROM points WINDOW w AS (PARTITION BY {sql.SERIES} ORDER BY publication_date)),
    t AS (SELECT *, avg(moved_days) OVER (PARTITION BY {sql.SERIES} ORDER BY publication_date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS trend_days, CAST(greatest(date_diff('day', cutoff_date, DATE '{SUBMISSION}'), 0) AS INT) AS gap FROM m)
    SELECT {sql.SERIES}, publication_date, cutoff_date, moved_days, trend_days, CASE WHEN cutoff_date IS NULL THEN 0 ELSE gap END AS gap_days,
      CASE WHEN cutoff_date IS NULL OR gap = 0 THEN 0.0::DOUBLE WHEN trend_days > 0 THEN gap / trend_days END AS wait_months
    FROM t
"""
_PERCENTILE = lambda p: f"s[CAST(floor((n - 1) * {p}) AS INT) + 1] + (s[least(CAST(floor((n - 1) * {p}) AS INT) + 2, n)] - s[CAST(floor((n - 1) * {p}) AS INT) + 1]) * ((n - 1) * CAST({p} AS DOUBLE) - floor((n - 1) * CAST({p} AS DOUBLE)))"
_NEAR = "row_number() OVER (PARTITION BY a.form ORDER BY b.n DESC, b.form)"
_NAMES = f"""
    WITH s AS (SELECT {SPELLED} AS variation, count(*) AS n FROM part GROUP BY 1),
    f AS MATERIALIZED (SELECT *, regexp_replace(trim(regexp_replace(lower(variation), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), '( (inc|llc))+$', '') AS form FROM s),
    g AS MATERIALIZED (SELECT form, sum(n) AS n FROM f GROUP BY form),
    p0 AS MATERIALIZED (SELECT form, root FROM (SELECT a.form, b.form AS root, {_NEAR} AS r FROM g a JOIN g b ON a.form = b.form OR length(a.form) >= 4 AND length(b.form) >= 4 AND levenshtein(a.form, b.form) = 1) WHERE r = 1),
    {", ".join(f"p{i + 1} AS MATERIALIZED (SELECT a.form, b.root FROM p{i} a JOIN p{i} b ON a.root = b.form)" for i in range(6))},
    v AS (SELECT f.*, root FROM f JOIN p6 USING (form))
    SELECT variation, n, first_value(variation) OVER (PARTITION BY root ORDER BY n DESC, variation) AS canonical FROM v
"""
_CHANGES = """
    WITH d AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, arg_max(o_orderpriority, o_orderkey) AS o_orderpriority FROM orders GROUP BY 1, 2),
    l AS (SELECT *, lag(o_orderpriority) OVER w AS was, row_number() OVER w AS r FROM d WINDOW w AS (PARTITION BY o_custkey ORDER BY day)),
    c AS (SELECT o_custkey, o_orderpriority, day AS valid_from, lead(day) OVER (PARTITION BY o_custkey ORDER BY day) AS valid_to FROM l WHERE r = 1 OR was IS DISTINCT FROM o_orderpriority)
"""


def _shares(levels: list[str], source: str) -> str:
    parts = []
    for depth in range(len(levels) + 1):
        given, parent = levels[:depth], levels[: max(0, depth - 1)]
        over = f"PARTITION BY {', '.join(parent)}" if parent else ""
        names = "".join(f"{c}, " for c in given) + "".join(f"NULL AS {c}, " for c in levels[depth:])
        parts.append(f"SELECT {names}{depth} AS depth, n, CAST(t AS DOUBLE) AS total, CAST(t AS DOUBLE) * 100 / CAST(sum(t) OVER ({over}) AS DOUBLE) AS share, CAST(row_number() OVER ({over} ORDER BY t DESC{''.join(f', {c}' for c in given)}) AS INT) AS place FROM (SELECT {''.join(f'{c}, ' for c in given)}count(*) AS n, sum(CAST(c_acctbal AS DECIMAL(38,4))) AS t FROM {source}{' GROUP BY ' + ', '.join(given) if given else ''})")
    return " UNION ALL ".join(parts)


_RATES = f"""
    WITH {sql.BINDING}, {sql.points()},
    e AS (SELECT {sql.SERIES}, CAST(year(publication_date) // 5 * 5 AS INT) AS period, count(*) AS n, min(publication_date) AS first_date, max(publication_date) AS last_date,
      arg_min(cutoff_date, publication_date) AS first_cutoff, arg_max(cutoff_date, publication_date) AS last_cutoff FROM points WHERE cutoff_date IS NOT NULL GROUP BY ALL),
    r AS (SELECT * EXCLUDE (first_cutoff), CASE WHEN last_date > first_date THEN date_diff('day', first_cutoff, last_cutoff) * CAST(12 AS DOUBLE) / date_diff('day', first_date, last_date) END AS months_per_year FROM e)
"""

_RECORDS = """
    WITH r AS (
      SELECT l_suppkey AS employer, CASE WHEN l_linestatus = 'O' THEN 'PERM' ELSE 'H-1B' END AS source, p_type AS role, c_nationkey AS location, CAST(year(l_shipdate) AS INT) AS year, l_returnflag <> 'R' AS certified,
        l_extendedprice * CASE l_orderkey % 5 WHEN 0 THEN 2080 WHEN 1 THEN 52 WHEN 2 THEN 12 WHEN 3 THEN 1 END AS wage, abs(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) AS days
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey
    )"""
_POINTS = "CASE %s_grade WHEN 'A' THEN 4 WHEN 'B' THEN 3 WHEN 'C' THEN 2 WHEN 'D' THEN 1 WHEN 'F' THEN 0 END"


def _cards(weights: dict[str, int]) -> str:
    def graded(figure: str, steps: list, sign: str = ">=") -> str:
        return f"CASE WHEN {figure} IS NULL THEN NULL " + " ".join(f"WHEN {figure} {sign} {at} THEN '{letter}'" for at, letter in steps) + " ELSE 'F' END"

    years = [f"CAST(count(*) FILTER (WHERE year = {y}) > 0 AS INT)" for y in range(1996, 2001)]
    top = " + ".join(f"coalesce({_POINTS % name} * {w}, 0)" for name, w in weights.items())
    under = " + ".join(f"CASE WHEN {name}_grade IS NULL THEN 0 ELSE {w} END" for name, w in weights.items())
    return f"""{_RECORDS},
    u AS (SELECT role, CAST(sum(CAST(wage AS DECIMAL(20,4))) AS DOUBLE) / count(wage) AS usual FROM r WHERE wage IS NOT NULL GROUP BY role),
    o AS (SELECT employer, count(*) AS n, count(*) FILTER (WHERE source = 'PERM') AS perms, count(*) FILTER (WHERE source = 'H-1B') AS h1bs, count(*) FILTER (WHERE source = 'PERM' AND year = 2000) AS volume,
      count(*) FILTER (WHERE certified) * CAST(100 AS DOUBLE) / count(*) AS approval, {" + ".join(years)} AS years, count(*) FILTER (WHERE year = 2000) > count(*) FILTER (WHERE year = 1996) AS growing,
      CAST(sum(CAST(round_even(wage / usual, 6) AS DECIMAL(20,6))) AS DOUBLE) / count(wage / usual) AS against, quantile_cont(days, 0.5) FILTER (WHERE source = 'PERM') AS processing FROM r LEFT JOIN u USING (role) GROUP BY employer),
    p AS (SELECT *, CASE WHEN h1bs > 0 THEN perms * CAST(100 AS DOUBLE) / h1bs END AS conversion, CASE WHEN against IS NOT NULL THEN percent_rank() OVER (PARTITION BY against IS NULL ORDER BY against) END AS salary FROM o),
    g AS (SELECT *, {graded("volume", report_card.VOLUME)} AS volume_grade, {graded("approval", report_card.APPROVAL)} AS approval_grade, {graded("salary", report_card.SALARY)} AS salary_grade,
      CASE WHEN years = 5 THEN CASE WHEN growing THEN 'A' ELSE 'B' END WHEN years = 4 THEN 'C' WHEN years = 3 THEN 'D' ELSE 'F' END AS consistency_grade,
      {graded("conversion", report_card.CONVERSION)} AS conversion_grade, {graded("processing", report_card.PROCESSING, "<")} AS processing_grade FROM p),
    s AS (SELECT *, CAST({top} AS DOUBLE) / ({under}) AS score FROM g),
    cards AS (SELECT employer, n, volume, approval, salary, years, conversion, processing, volume_grade, approval_grade, salary_grade, consistency_grade, conversion_grade, processing_grade, score, {graded("score", report_card.OVERALL)} AS overall FROM s)"""


def _wages(role: str) -> str:
    s = "list_sort(list(wage))"
    return f"SELECT {role}, count(wage) AS n, CAST(sum(CAST(wage AS DECIMAL(20,4))) AS DOUBLE) / count(wage) AS mean, min(wage) AS low, max(wage) AS high, {s}[(count(wage) - 1) // 2 + 1] + ({s}[count(wage) // 2 + 1] - {s}[(count(wage) - 1) // 2 + 1]) * CAST(0.5 AS DOUBLE) AS median FROM r WHERE wage IS NOT NULL"


def _profile(kind: str) -> str:
    return f"SELECT employer, '{kind}' AS kind, CAST({kind} AS VARCHAR) AS value, count(*) AS n, CAST(sum(CAST(wage AS DECIMAL(20,4))) AS DOUBLE) / nullif(count(wage), 0) AS mean, count(*) * CAST(100 AS DOUBLE) / any_value(whole) AS share, CAST(row_number() OVER (PARTITION BY employer ORDER BY count(*) DESC, CAST({kind} AS VARCHAR) NULLS FIRST) AS INT) AS place FROM w GROUP BY employer, {kind}"


ORACLE_SQL = {
    "report_cards": _cards(report_card.WEIGHTS) + " SELECT * FROM cards",
    "employer_ranking": _cards(report_card.OTHER_WEIGHTS) + " SELECT CAST(row_number() OVER (ORDER BY score DESC NULLS LAST, employer) AS INT) AS place, employer, n, score, overall FROM cards WHERE n >= 20 ORDER BY place LIMIT 100",
    "compared_employers": _cards(report_card.WEIGHTS) + " SELECT * FROM cards WHERE employer IN (1, 3, 5, 8, 13)",
    "wage_stats": f"{_RECORDS} {_wages('role')} GROUP BY role UNION ALL {_wages(chr(39) + 'all roles' + chr(39) + ' AS role')}",
    "wages_at_cost_of_living": _RECORDS + """,
        e AS (SELECT c_nationkey AS location, sum(CAST(o_totalprice AS DECIMAL(20,4))) AS total, count(o_totalprice) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
        c AS (SELECT location, round(CAST(total AS DOUBLE) / n * 100 / (SELECT CAST(sum(total) AS DOUBLE) / sum(n) FROM e), 2) AS cost FROM e),
        a AS (SELECT employer, role, location, year, wage, CASE WHEN cost > 0 THEN round(wage * 100 / cost, 2) END AS adjusted FROM r LEFT JOIN c USING (location))
        SELECT *, CASE WHEN wage IS NOT NULL THEN percent_rank() OVER (PARTITION BY role, wage IS NULL ORDER BY wage) END AS nominal_rank,
          CASE WHEN adjusted IS NOT NULL THEN percent_rank() OVER (PARTITION BY role, adjusted IS NULL ORDER BY adjusted) END AS adjusted_rank FROM a
    """,
    "employer_profiles": f"{_RECORDS}, w AS (SELECT *, count(*) OVER (PARTITION BY employer) AS whole FROM r), p AS ({' UNION ALL '.join(map(_profile, ('role', 'year', 'location')))}) SELECT * FROM p WHERE kind <> 'role' OR place <= 3",
    "receipt_ranges": """
        WITH d AS (SELECT l_orderkey, max(l_shipdate) AS done FROM lineitem GROUP BY 1),
        c AS (SELECT o_orderkey AS receipt, o_orderstatus AS status, date_diff('day', CAST(o_orderdate AS DATE), CAST(done AS DATE)) AS days FROM orders LEFT JOIN d ON o_orderkey = l_orderkey)
        SELECT receipt // 500 AS bucket, min(receipt) AS first, max(receipt) AS last, count(*) AS n, CAST(count(*) FILTER (WHERE status = 'F') AS DOUBLE) / count(*) AS share_f,
          CAST(count(*) FILTER (WHERE status = 'O') AS DOUBLE) / count(*) AS share_o, CAST(sum(days) AS DOUBLE) / nullif(count(days), 0) AS mean_days FROM c GROUP BY 1
    """,
    "reform_impact": _RATES + f""",
        b AS (SELECT {sql.SERIES}, arg_max(months_per_year, period) AS rate, greatest(date_diff('day', arg_max(last_cutoff, period), DATE '{SUBMISSION}'), 0) / CAST(30.4375 AS DOUBLE) AS gap FROM r GROUP BY ALL),
        w AS (SELECT b.*, m.rate AS other, m.visa_class_label IS NOT NULL AS known FROM b LEFT JOIN b m ON m.country = 'all' AND m.visa_category = b.visa_category AND m.action_type = b.action_type AND m.visa_class_label = b.visa_class_label),
        x AS (SELECT {sql.SERIES}, known, CASE WHEN gap = 0 THEN 0 WHEN rate > 0 THEN gap / rate END AS wait_before, CASE WHEN known THEN CASE WHEN gap = 0 THEN 0 WHEN other > 0 THEN gap / other END END AS wait_after FROM w)
        SELECT {sql.SERIES}, wait_before, wait_after, wait_after - wait_before AS change_years,
          CASE WHEN known THEN CASE WHEN coalesce(wait_after, 'inf'::DOUBLE) < coalesce(wait_before, 'inf'::DOUBLE) THEN 'winner' WHEN coalesce(wait_after, 'inf'::DOUBLE) > coalesce(wait_before, 'inf'::DOUBLE) THEN 'loser' ELSE 'same' END END AS outcome FROM x
    """,
    "canonical_names": _NAMES,
    "changelog": _CHANGES + " SELECT * FROM c",
    "changelog_as_of": _CHANGES + " SELECT o_custkey, o_orderpriority, valid_from FROM c WHERE valid_from <= DATE '1997-06-15' AND (valid_to IS NULL OR valid_to > DATE '1997-06-15')",
    "balance_rollup": _shares(["r_name", "n_name", "c_mktsegment"], "customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    "top_segments": "SELECT * EXCLUDE (depth) FROM (" + _shares(["n_name", "c_mktsegment"], "customer JOIN nation ON c_nationkey = n_nationkey") + ") WHERE depth = 2 AND place <= 3",
    "period_rates": _RATES + " SELECT * FROM r",
    "wait_scenarios": _RATES + f""",
        b AS (SELECT {sql.SERIES}, max(months_per_year) AS best, arg_max(months_per_year, period) AS latest, arg_max(last_cutoff, period) AS last_cutoff FROM r GROUP BY ALL),
        w AS (SELECT {sql.SERIES}, scenario, last_cutoff, greatest(date_diff('day', last_cutoff, DATE '{SUBMISSION}'), 0) / CAST(30.4375 AS DOUBLE) AS gap_months, CASE base WHEN 'best' THEN best ELSE latest END * CAST(factor AS DOUBLE) AS months_per_year
          FROM b, (VALUES ('optimistic', 'best', 1.0), ('current', 'latest', 1.0), ('pessimistic', 'latest', 0.5), ('doubled quota', 'latest', 2.0)) s(scenario, base, factor))
        SELECT *, CASE WHEN gap_months = 0 THEN 0 WHEN months_per_year > 0 THEN gap_months / months_per_year END AS wait_years FROM w
    """,
    "csv_orders": """
        WITH o AS (SELECT *, CASE WHEN o_orderkey % 97 = 5 OR o_orderkey % 83 = 3 THEN 'malformed' WHEN o_orderkey % 89 = 7 THEN 'missing status' END AS reason FROM orders)
        SELECT o_orderkey AS orderkey, CASE WHEN reason IS NULL THEN o_custkey END AS custkey, CASE WHEN reason IS NULL THEN o_orderstatus END AS status,
          CASE WHEN reason IS NULL THEN CAST(round(o_totalprice * 100) AS BIGINT) END AS cents, CAST(year(o_orderdate) AS INT) AS year, reason FROM o
    """,
    "stored_percentiles": f"""
        WITH g AS (
          SELECT l_suppkey AS employer, l_linestatus AS source, CAST(year(l_shipdate) AS INT) AS year, count(*) AS n, sum(CAST(l_extendedprice AS DECIMAL(20,4))) AS total,
            min(l_extendedprice) AS low, max(l_extendedprice) AS high, list(l_extendedprice ORDER BY l_extendedprice) AS s
          FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1, 2, 3
        )
        SELECT employer, source, year, n, CAST(total AS DOUBLE) / n AS mean, low, high, true AS exact, {_PERCENTILE(0.5)} AS median, {_PERCENTILE(0.9)} AS upper FROM g
    """,
    "contained_text": _like("customer", "customer", "c_custkey", "c_name", "c_mktsegment") + " UNION ALL " + _like("part", "part", "p_partkey", "p_name", "p_type"),
    "monthly_movement": _MOVEMENT,
    "monthly_movement_stream": _MOVEMENT,
    "band_matches": """
        WITH o AS (SELECT o_orderkey, o_custkey AS k, o_totalprice AS v, CAST(o_orderdate AS DATE) AS d FROM orders),
        r AS (SELECT k, v, d, min(o_orderkey) AS id FROM o WHERE v > 0 GROUP BY k, v, d),
        m AS (
          SELECT o.o_orderkey, r.id, r.v, r.d, row_number() OVER (PARTITION BY o.o_orderkey ORDER BY abs(r.v - o.v), r.d, r.id) AS place, count(*) OVER (PARTITION BY o.o_orderkey) AS n
          FROM o JOIN r ON r.k = o.k AND r.v BETWEEN o.v * CAST(0.9 AS DOUBLE) AND o.v * CAST(1.1 AS DOUBLE)
            AND r.d BETWEEN CAST(o.d + INTERVAL 6 MONTH AS DATE) AND CAST(o.d + INTERVAL 36 MONTH AS DATE)
          WHERE o.v > 0
        )
        SELECT o.o_orderkey, m.id AS match_id, m.v AS match_value, m.d AS match_date, coalesce(n, 0) AS n_matches
        FROM o LEFT JOIN m ON m.o_orderkey = o.o_orderkey AND place = 1
    """,
    "percent_ranks": "SELECT o_orderkey, o_totalprice, rank() OVER (ORDER BY o_totalprice) AS rank, percent_rank() OVER (ORDER BY o_totalprice) AS percent_rank FROM orders",
    "percent_ranks_by_priority": """
        WITH o AS (SELECT o_orderkey, o_orderpriority, CAST(floor(o_totalprice / 1000) AS BIGINT) AS thousands FROM orders)
        SELECT *, rank() OVER w AS rank, percent_rank() OVER w AS percent_rank FROM o WINDOW w AS (PARTITION BY o_orderpriority ORDER BY thousands)
    """,
    "histogram_equal_width": """
        WITH b AS (SELECT min(o_totalprice) AS low, max(o_totalprice) AS high, (max(o_totalprice) - min(o_totalprice)) / 20 AS width FROM orders),
        c AS (SELECT least(CAST(floor((o_totalprice - low) / width) AS INT), 19) AS bin, count(*) AS n FROM orders, b GROUP BY 1)
        SELECT CAST(i AS INT) AS bin, low + width * i AS low, CASE WHEN i = 19 THEN high ELSE low + width * (i + 1) END AS high, coalesce(n, 0) AS n
        FROM b, range(20) t(i) LEFT JOIN c ON c.bin = i
    """,
    "histogram_equal_depth": """
        WITH r AS (SELECT l_returnflag, l_quantity AS v, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) - 1 AS below, count(*) OVER (PARTITION BY l_returnflag) AS total FROM lineitem WHERE l_quantity IS NOT NULL)
        SELECT l_returnflag, CAST(below * 8 // total AS INT) AS bin, min(v) AS low, max(v) AS high, count(*) AS n FROM r GROUP BY 1, 2
    """,
    "yearly_trends": """
        WITH e AS (SELECT o_orderpriority, CAST(year(o_orderdate) AS INT) AS year, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(20,4))) AS DOUBLE) / count(*) AS mean FROM orders GROUP BY 1, 2)
        SELECT e.*, e.mean - p.mean AS change, (e.mean - p.mean) * 100 / p.mean AS change_percent
        FROM e LEFT JOIN e p ON p.o_orderpriority IS NOT DISTINCT FROM e.o_orderpriority AND p.year + 1 = e.year
    """,
}
