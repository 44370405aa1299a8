"""SQL with the results of the queries, over the same tables."""

from __future__ import annotations

FACT = "publication_date, visa_category, visa_class, action_type, country, cutoff_value, cutoff_date, is_current, is_unavailable"
SERIES = "visa_category, country, action_type, visa_class_label"

BINDING = """
cells AS (
  SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS publication_date,
    CASE WHEN o_custkey % 2 = 0 THEN 'employment_based' ELSE 'family_sponsored' END AS visa_category,
    CASE WHEN o_custkey % 2 = 0 THEN CASE o_orderkey % 3
        WHEN 0 THEN ['1st','2nd','3rd','4th','5th Set Aside: (Rural - 20%)']
        WHEN 1 THEN ['1 st','2 nd','3 rd','4 th','5th Unreserved (C5, T5, and all others)']
        ELSE ['EB1','EB2','Other Workers','Certain Religious Workers','Foo  Bar'] END
      ELSE CASE o_orderkey % 3
        WHEN 0 THEN ['1st','2A','2B','3rd','4th'] WHEN 1 THEN ['1 st','2 A','2 B','3 rd','4 th'] ELSE ['F1','F2A','F2B','F3','X'] END
    END[CAST(substr(o_orderpriority, 1, 1) AS INT)] AS visa_class,
    CASE o_orderstatus WHEN 'F' THEN 'final_action' WHEN 'O' THEN 'filing' END AS action_type,
    ['all','china','india','mexico','philippines','el_salvador_guatemala_honduras'][(o_custkey // 2) % 6 + 1] AS country,
    CASE WHEN o_orderkey % 11 = 0 THEN 'U' WHEN o_orderkey % 7 = 0 THEN 'C' WHEN o_orderkey % 13 = 0 THEN 'NA'
      ELSE strftime(CAST(date_trunc('month', o_orderdate) AS DATE) - CAST(floor(o_totalprice / 100) AS INT), '%Y-%m-%d') END AS value,
    o_orderkey AS row_ix
  FROM orders WHERE o_orderstatus IN ('F', 'O')
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY publication_date, visa_category, visa_class, action_type, country ORDER BY row_ix DESC) AS rn FROM cells
), facts AS (
  SELECT publication_date, visa_category, visa_class, action_type, country, value AS cutoff_value,
    CASE WHEN value = 'C' THEN publication_date ELSE TRY_CAST(CASE WHEN length(value) = 10 THEN value END AS DATE) END AS cutoff_date,
    value = 'C' AS is_current, value = 'U' AS is_unavailable
  FROM ranked WHERE rn = 1
), months0 AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS publication_date FROM orders),
months AS (
  SELECT publication_date, CASE WHEN month(publication_date) % 3 <> 0 THEN 'https://example.org/' || strftime(publication_date, '%Y-%m') END AS url
  FROM (SELECT publication_date FROM months0
    UNION ALL SELECT CAST(max(publication_date) + INTERVAL 1 MONTH AS DATE) FROM months0
    UNION ALL SELECT CAST(max(publication_date) + INTERVAL 2 MONTH AS DATE) FROM months0)
)"""

EMPLOYMENT = """CASE
  WHEN visa_class IN ('1st', '1 st') THEN 'EB-1: Priority Workers'
  WHEN visa_class IN ('2nd', '2 nd') THEN 'EB-2: Professionals with Advanced Degrees'
  WHEN visa_class IN ('3rd', '3 rd') THEN 'EB-3: Skilled Workers, Professionals'
  WHEN visa_class IN ('4th', '4 th') THEN 'EB-4: Special Immigrants'
  WHEN visa_class LIKE '%Rural%' THEN 'EB-5: Rural (20%)'
  WHEN visa_class LIKE '%Unreserved%' THEN 'EB-5: Unreserved'
  WHEN visa_class = 'Other Workers' THEN 'EB-3: Other Workers'
  WHEN visa_class LIKE '%Religious%' THEN 'EB-4: Religious Workers'
  WHEN visa_class = 'Foo  Bar' THEN 'Foo Bar' ELSE visa_class END"""
FAMILY = "CASE visa_class WHEN '1st' THEN 'F1' WHEN '1 st' THEN 'F1' WHEN '2A' THEN 'F2A' WHEN '2 A' THEN 'F2A' WHEN '2B' THEN 'F2B' WHEN '2 B' THEN 'F2B' WHEN '3rd' THEN 'F3' WHEN '3 rd' THEN 'F3' WHEN '4th' THEN 'F4' WHEN '4 th' THEN 'F4' ELSE visa_class END"
LABEL = "CASE label_key WHEN 'F1' THEN 'F1: Unmarried Sons/Daughters of U.S. Citizens' WHEN 'F2A' THEN 'F2A: Spouses/Children of Permanent Residents' WHEN 'F2B' THEN 'F2B: Unmarried Sons/Daughters (21+) of Permanent Residents' WHEN 'F3' THEN 'F3: Married Sons/Daughters of U.S. Citizens' WHEN 'F4' THEN 'F4: Brothers/Sisters of Adult U.S. Citizens' END"


def points(where: str = "TRUE") -> str:
    return f"""
shown AS (
  SELECT *, CASE WHEN visa_category = 'employment_based' THEN {EMPLOYMENT} ELSE {FAMILY} END AS label_key FROM facts WHERE {where}
), labelled AS (
  SELECT *, CASE WHEN visa_category = 'employment_based' THEN label_key ELSE {LABEL} END AS visa_class_label,
    CASE WHEN is_current THEN publication_date WHEN is_unavailable THEN NULL ELSE cutoff_date END AS cut
  FROM shown WHERE (visa_category = 'employment_based' AND label_key <> '' AND label_key <> visa_class)
    OR (visa_category <> 'employment_based' AND label_key IN ('F1', 'F2A', 'F2B', 'F3', 'F4'))
), points AS (
  SELECT {SERIES}, label_key, publication_date, cut AS cutoff_date, visa_class AS raw_class
  FROM (SELECT *, row_number() OVER (PARTITION BY {SERIES}, publication_date ORDER BY visa_class) AS first FROM labelled) WHERE first = 1
)"""


def projection(sub: str) -> str:
    return f"""
valid AS (
  SELECT *, row_number() OVER (PARTITION BY {SERIES} ORDER BY publication_date DESC) AS back,
    date_diff('day', DATE '2000-01-01', publication_date) AS x, date_diff('day', DATE '2000-01-01', cutoff_date) AS y
  FROM points WHERE cutoff_date IS NOT NULL
), dates AS (SELECT {SERIES}, count(*) AS n_dates FROM points GROUP BY ALL
), sums AS (
  SELECT {SERIES}, count(*) AS n, max(publication_date) AS last_pub, arg_max(cutoff_date, publication_date) AS last_cut,
    min(publication_date) FILTER (WHERE back <= 12) AS first_pub, arg_min(cutoff_date, publication_date) FILTER (WHERE back <= 12) AS first_cut,
    CAST(sum(x) AS BIGINT) AS sx, CAST(sum(y) AS BIGINT) AS sy, CAST(sum(x * y) AS BIGINT) AS sxy, CAST(sum(x * x) AS BIGINT) AS sxx
  FROM valid GROUP BY ALL
), rates AS (
  SELECT *, date_diff('day', first_cut, last_cut) / CAST(CASE WHEN date_diff('month', first_pub, last_pub) = 0 THEN 1 ELSE date_diff('month', first_pub, last_pub) END AS DOUBLE) AS rate,
    CASE WHEN n >= 6 AND n * sxx - sx * sx <> 0 THEN CAST(n * sxy - sx * sy AS DOUBLE) / CAST(n * sxx - sx * sx AS DOUBLE) END AS slope
  FROM dates LEFT JOIN sums USING ({SERIES})
), lines AS (SELECT *, (sy - slope * sx) / n AS icpt, date_diff('day', DATE '2000-01-01', DATE '{sub}') AS sd FROM rates
), ends AS (
  SELECT *, CASE WHEN slope > 0 THEN DATE '2000-01-01' + CAST(trunc(slope * date_diff('day', DATE '2000-01-01', last_pub) + icpt) AS INT) END AS trend,
    CASE WHEN slope > 0 AND abs((sd - icpt) / slope) < 2900000 THEN DATE '2000-01-01' + CAST(trunc((sd - icpt) / slope) AS INT) END AS hist,
    CASE WHEN rate > 0 THEN CAST(trunc(date_diff('day', last_cut, DATE '{sub}') / rate) AS INT) END AS wait
  FROM lines
), kinds AS (
  SELECT *, greatest(0, date_diff('month', last_pub, hist)) AS hist_wait,
    CASE WHEN n_dates < 2 OR n IS NULL OR n < 2 THEN NULL WHEN last_cut >= DATE '{sub}' THEN 'current' WHEN rate > 0 THEN 'projected'
      WHEN slope > 0 AND trend >= DATE '{sub}' THEN 'trend_current' WHEN slope > 0 THEN 'projected_historical' ELSE 'no_movement' END AS kind
  FROM ends
), projected AS (
  SELECT {SERIES}, CASE kind WHEN 'trend_current' THEN 'current' ELSE kind END AS status,
    CASE kind WHEN 'current' THEN 'Your application date has already been reached!'
      WHEN 'trend_current' THEN 'Your application date has already been reached (based on historical trend)!'
      WHEN 'no_movement' THEN 'No forward progress detected in recent months.'
      WHEN 'projected' THEN 'Estimated processing in ' || wait || ' months'
      WHEN 'projected_historical' THEN 'Estimated processing in ' || hist_wait || ' months (based on long-term trend)' END AS message,
    CASE kind WHEN 'projected' THEN CASE WHEN wait < 95000 THEN CASE WHEN last_pub + wait * 30 <= DATE '9999-12-31' THEN last_pub + wait * 30 END END
      WHEN 'projected_historical' THEN CASE WHEN hist <= DATE '9999-12-31' THEN hist END END AS estimated_date,
    CAST(CASE kind WHEN 'current' THEN 0 WHEN 'trend_current' THEN 0 WHEN 'projected' THEN wait WHEN 'projected_historical' THEN hist_wait END AS INT) AS months_to_wait,
    CASE kind WHEN 'projected' THEN round_even(rate, 1) WHEN 'projected_historical' THEN round_even(slope * 30, 1) END AS avg_progress_days_per_month,
    CASE kind WHEN 'projected_historical' THEN 'historical_regression' END AS method
  FROM kinds
)"""


CHART = """
ends2 AS (
  SELECT visa_class_label, min(publication_date) AS first_date, max(publication_date) AS last_date,
    arg_max(cutoff_date, publication_date) FILTER (WHERE cutoff_date IS NOT NULL) AS last_cutoff
  FROM points GROUP BY visa_class_label
), flags AS (
  SELECT ends2.*, estimated_date, estimated_date IS NOT NULL AND last_cutoff IS NOT NULL AS has_projection
  FROM ends2 JOIN projected USING (visa_class_label)
), idx AS (
  SELECT *, CAST(sum(1 + CAST(has_projection AS INT)) OVER w - (1 + CAST(has_projection AS INT)) AS INT) AS first_trace,
    row_number() OVER (ORDER BY visa_class_label) AS place,
    ['#0d6efd','#198754','#dc3545','#ffc107','#6f42c1','#fd7e14','#20c997','#e83e8c'][(row_number() OVER (ORDER BY visa_class_label) - 1) % 8 + 1] AS color
  FROM flags WINDOW w AS (ORDER BY visa_class_label)
)"""


def traces(sub: str) -> str:
    return f"""{CHART}, line AS (
  SELECT CAST(sum(1 + CAST(has_projection AS INT)) AS INT) AS trace_idx, arg_min(first_date, place) AS a,
    coalesce(max(estimated_date) FILTER (WHERE has_projection), arg_min(last_date, place)) AS b
  FROM idx HAVING count(*) > 0
), traces AS (
  SELECT first_trace AS trace_idx, 'history' AS kind, visa_class_label, publication_date AS x, cutoff_date AS y, color FROM points JOIN idx USING (visa_class_label)
  UNION ALL SELECT first_trace + 1, 'projection', visa_class_label, last_date, last_cutoff, color FROM idx WHERE has_projection
  UNION ALL SELECT first_trace + 1, 'projection', visa_class_label, estimated_date, DATE '{sub}', color FROM idx WHERE has_projection
  UNION ALL SELECT trace_idx, 'priority', NULL, a, DATE '{sub}', 'red' FROM line
  UNION ALL SELECT trace_idx, 'priority', NULL, b, DATE '{sub}', 'red' FROM line
)"""


def every_traces(sub: str) -> str:
    """The traces of all charts at once."""
    chart = "visa_category, country, action_type"
    made = traces(sub).replace("(ORDER BY visa_class_label)", f"(PARTITION BY {chart} ORDER BY visa_class_label)").replace("USING (visa_class_label)", f"USING ({chart}, visa_class_label)")
    made = made.replace("GROUP BY visa_class_label", f"GROUP BY {chart}, visa_class_label").replace("SELECT visa_class_label, min(publication_date)", f"SELECT {chart}, visa_class_label, min(publication_date)")
    made = made.replace("FROM idx HAVING count(*) > 0", f"FROM idx GROUP BY {chart}").replace("SELECT CAST(sum(1 + CAST(has_projection AS INT)) AS INT) AS trace_idx", f"SELECT {chart}, CAST(sum(1 + CAST(has_projection AS INT)) AS INT) AS trace_idx")
    for old in ("SELECT first_trace AS", "SELECT first_trace + 1", "SELECT trace_idx, 'priority'"):
        made = made.replace(old, old.replace("SELECT ", f"SELECT {chart}, "))
    return made


def values(columns: str, rows: list[str]) -> str:
    return f"SELECT * FROM (VALUES {', '.join(f'({r})' for r in rows)}) AS t({columns})"


#: What texts of pages become.
EMPLOYMENT_NAMES = {
    "EB-1: Priority Workers": ["1st", "1 st"],
    "EB-2: Professionals with Advanced Degrees": ["2nd"],
    "EB-3: Skilled Workers, Professionals": ["3rd"],
    "EB-3: Other Workers": ["3rd Other Workers", "Other Workers"],
    "EB-4: Special Immigrants": ["4th"],
    "EB-4: Religious Workers": ["4th Religious", "Certain RELIGIOUS Workers"],
    "EB-5: Rural (20%)": ["5th Set Aside: (Rural - 20%)", "5th Set Aside: (Rural: NR, RR - 20%)", "current 5"],
    "EB-5: High Unemployment (10%)": ["5th Set Aside: (High Unemployment - 10%)"],
    "EB-5: Infrastructure (2%)": ["5th Set Aside: (Infrastructure - 2%)", "5th Set Aside: Infrastructure (2%, including RI)"],
    "EB-5: Unreserved": ["5th Unreserved (C5, T5, and all others)"],
    "EB-5: Non-Regional Center": ["5th Non-Regional Center (C5 and T5)"],
    "EB-5: Targeted Employment Areas / Regional Centers": ["5th Targeted Employ-ment Areas"],
    "EB-5: Pilot Programs": ["5th Pilot Programs"],
    "EB-5: All Categories": ["EB5"],
    "Schedule A Workers": ["Schedule A Workers"],
    "Iraqi & Afghani Translators": ["Iraqi & Afghani Translators"],
    "Foo Bar": ["Foo  Bar"],
    "A-B": ["A - B"],
    **{x: [x] for x in ("C", "EB1", "EB-1", "RURAL (20%)", "High Unemployment (10%, including NH, RH)", "Infrastructure (2%, including RI)", "Unknown Visa Class XYZ")},
}
COUNTRIES = {"all": "Other Countries", "china": "China (mainland born)", "india": "India", "mexico": "Mexico", "philippines": "Philippines", "el_salvador_guatemala_honduras": "El Salvador/Guatemala/Honduras"}
_DATED = {"01DEC14": "2014-12-01", "01APR01": "2001-04-01", "01DEC98": "1998-12-01", "01JAN69": "1969-01-01", "01JAN68": "2068-01-01", "01dec14": "2014-12-01", "1DEC14": "2014-12-01"}
_TEXT = {
    "employment_class": values("name, display", [f"'{x}', '{shown}'" for shown, names in EMPLOYMENT_NAMES.items() for x in names]),
    "country_from_header": values("header, country", ["'CHINA-mainland born', 'china'", "'CHINA', NULL", "'INDIA', 'india'", "' india ', 'india'", "'MEXICO', 'mexico'", "'Philippines', 'philippines'", "'EL SALVADOR GUATEMALA HONDURAS', 'el_salvador_guatemala_honduras'", "'All Chargeability Areas Except Those Listed', 'all'", "E'All Chargeability  Areas\\nExcept Those Listed', 'all'", "'ALL AREAS', 'all'", "'DOMINICAN REPUBLIC', NULL", "'', NULL"]),
    "cell_dates": values("cell, cutoff_value, cutoff_date, is_current, is_unavailable", [*(f"'{c}', '{d}', DATE '{d}', false, false" for c, d in _DATED.items()), "'C', 'C', DATE '2025-12-01', true, false", "'U', 'U', NULL, false, true", *(f"'{c}', '{c}', NULL, false, false" for c in ("31FEB20", "01SEPT20", "", "NA", "2016-11-08"))]),
    "normalize_text": values("line, clean", ["'  multiple   spaces  ', 'multiple spaces'", "E'line\\nbreak\\nhere', 'line break here'", "E'tab\\ttab\\ttab', 'tab tab tab'", "'a' || chr(160) || 'b', 'a b'", "'', ''"]),
    "masked_dates": values("typed, masked, valid", ["'01/15/2024', '01/15/2024', true", "'1/5/2024', '15/20/24', true", "'01152024', '01/15/2024', false", "'0115', '01/15', false", "'1', '1', false", "'13/01/2024', '13/01/2024', false", "'02/30/2024', '02/30/2024', false", "'02/29/2024', '02/29/2024', true", "'01/32/2024', '01/32/2024', false", "'12/31/1989', '12/31/1989', false", "'01/01/2031', '01/01/2031', false", "'abc', '', false", "'', '', true", "'2024-01-01', '20/24/0101', false"]),
}


#: Headers of the countries' columns, and titles of the tables.
_HEADERS = {"all": "All Chargeability Areas Except Those Listed", "china": "CHINA-mainland born", "el_salvador_guatemala_honduras": "EL SALVADOR GUATEMALA HONDURAS", "india": "INDIA", "mexico": "MEXICO", "philippines": "PHILIPPINES"}
_TITLES = {("family_sponsored", "final_action"): "FINAL ACTION DATES FOR FAMILY-SPONSORED PREFERENCE CASES", ("family_sponsored", "filing"): "DATES FOR FILING FAMILY-SPONSORED VISA APPLICATIONS", ("employment_based", "final_action"): "FINAL ACTION DATES FOR EMPLOYMENT-BASED PREFERENCE CASES", ("employment_based", "filing"): "DATES FOR FILING OF EMPLOYMENT-BASED VISA APPLICATIONS"}
_FILE = "'visa-bulletin-for-' || lower(monthname(publication_date)) || '-' || year(publication_date) || '.html'"


def dealt(column: str, texts: list[tuple], results: str) -> str:
    """`results` (by `column`) for the texts that the orders have."""
    quoted = ", ".join("'" + t.replace("'", "''") + "'" for (t,) in texts)
    return f"WITH r AS ({results}), o AS (SELECT o_orderkey, [{quoted}][o_orderkey % {len(texts)} + 1] AS text FROM orders) SELECT o_orderkey, r.* FROM o JOIN r ON r.{column} = o.text"


def _pages(base: str) -> dict[str, str]:
    """What is found in the months' pages."""
    cell = "CASE WHEN length(cutoff_value) = 10 THEN upper(strftime(cutoff_date, '%d%b%y')) ELSE cutoff_value END"
    title = "CASE " + " ".join(f"WHEN visa_category = '{c}' AND action_type = '{a}' THEN '{t}'" for (c, a), t in _TITLES.items()) + " END"
    cells = " || ".join(f"'|' || coalesce(max({cell}) FILTER (WHERE country = '{c}'), '')" for c in _HEADERS)
    table = "publication_date, visa_category, action_type"
    bodies = f"""{base},
        b AS (SELECT {table}, visa_class, visa_class || {cells} AS cells FROM facts GROUP BY {table}, visa_class),
        n AS (SELECT *, row_number() OVER (PARTITION BY {table} ORDER BY visa_class) AS row_ix, dense_rank() OVER (PARTITION BY publication_date ORDER BY visa_category, action_type) - 1 AS table_ix FROM b),
        a AS (SELECT * FROM n UNION ALL SELECT DISTINCT {table}, NULL, 'Class|{"|".join(_HEADERS.values())}', 0, table_ix FROM n)"""
    outcomes = f"{base}, c AS (SELECT publication_date, count(DISTINCT (visa_category, action_type)) AS tables, count(DISTINCT (visa_category, action_type, visa_class)) AS rows FROM facts GROUP BY 1), p AS (SELECT {_FILE} AS url, publication_date, coalesce(tables, 0) AS tables, coalesce(rows, 0) AS rows, NULL::VARCHAR AS error FROM months LEFT JOIN c USING (publication_date))"
    file = "'visa-bulletin-for-' || monthname(publication_date) || '-' || year(publication_date) || '.html'"
    return {
        "table_extract": f"{bodies} SELECT {_FILE} AS url, publication_date, CAST(table_ix AS INT) AS table_ix, {title} AS title, CAST(row_ix AS INT) AS row_ix, cells FROM a",
        "unpivot_cells": f"{base}, k AS (SELECT DISTINCT {table}, visa_class FROM facts) SELECT publication_date, visa_category, visa_class, action_type, country, coalesce(cutoff_value, '') AS cutoff_value, cutoff_date, coalesce(is_current, false) AS is_current, coalesce(is_unavailable, false) AS is_unavailable FROM (SELECT * FROM k, unnest({list(_HEADERS)}) t(country)) LEFT JOIN facts USING ({table}, visa_class, country)",
        "page_outcomes": f"{outcomes} SELECT * FROM p",
        "page_counters": f"{outcomes} SELECT count(*) AS pages, count(*) AS succeeded, 0::BIGINT AS failed, CAST(sum(rows) AS BIGINT) AS rows, 0 AS exit_status FROM p",
        "index_links": f"{base} SELECT 'https://example.org/' || CASE month(publication_date) % 3 WHEN 1 THEN 'b/' ELSE 'a/' END || {file} AS url, publication_date FROM months UNION ALL SELECT 'https://example.org/a/' || {file}, publication_date FROM months WHERE month(publication_date) % 3 = 0 UNION ALL SELECT DISTINCT 'https://example.org/a/visa-bulletin-for-' || year(publication_date) || '.html', NULL::DATE FROM months",
    }


def queries(sub: str, one: str, texts: dict[str, tuple[str, list[tuple]]]) -> dict[str, str]:
    """By query name; the constants are those that the queries use."""
    base = f"WITH {BINDING}"
    every, chart = f"{base}, {points()}", f"{base}, {points(one)}, {projection(sub)}, {traces(sub)}"
    month_names = "lower(monthname(publication_date))"
    fiscal = "year(publication_date) + CASE WHEN month(publication_date) >= 10 THEN 1 ELSE 0 END"
    url = f"coalesce(nullif(url, ''), 'https://travel.state.gov/content/travel/en/legal/visa-law0/visa-bulletin/' || ({fiscal}) || '/visa-bulletin-for-' || {month_names} || '-' || year(publication_date) || '.html')"
    split = lambda rule: f"(SELECT *, row_number() OVER (PARTITION BY publication_date, visa_category, visa_class, action_type, country ORDER BY row_ix DESC) AS r FROM cells WHERE {rule})"
    typed = "publication_date, visa_category, visa_class, action_type, country, value AS cutoff_value, CASE WHEN value = 'C' THEN publication_date ELSE TRY_CAST(CASE WHEN length(value) = 10 THEN value END AS DATE) END AS cutoff_date, value = 'C' AS is_current, value = 'U' AS is_unavailable"
    key = "publication_date, visa_category, visa_class, action_type, country"
    keys = "visa_category, country, action_type"
    given = lambda c, rest, values, default: f"CASE WHEN c_custkey % {rest} < 2 THEN '{default}' ELSE {values}[c_custkey % {len(values)} + 1] END AS {c}"
    asked = ", ".join([given("visa_category", 5, ["family_sponsored", "employment_based"], "family_sponsored"), given("country", 7, ["all", "china", "india", "nowhere"], "all"), given("action_type", 4, ["final_action", "filing", "dates_for_filing"], "final_action")])
    results = _TEXT | {
        "family_class": values("name, display", ["'1st', 'F1'", "'1 st', 'F1'", "'2A', 'F2A'", "'2 A', 'F2A'", "'2B', 'F2B'", "'3rd', 'F3'", "'4th', 'F4'", "'F4', 'F4'", "'X', 'X'"]),
        "submission_dates": values("given, submission", [f"'{g}', DATE '{d}'" for g, d in (("01/15/2024", "2024-01-15"), ("1/5/2024", "2024-01-05"), ("2024-01-01", "2024-01-01"), ("2024-1-1", "2024-01-01"), ("invalid-date", "2025-12-01"), ("", "2025-12-01"), ("13/01/2024", "2025-12-01"), ("2024-02-30", "2025-12-01"))]),
    }
    return {
        "projection": f"{every}, {projection(sub)} SELECT * FROM projected",
        "class_points": f"{every} SELECT {SERIES}, publication_date, cutoff_date, raw_class FROM points",
        "class_series": f"{every} SELECT {SERIES}, min(CASE WHEN visa_category = 'employment_based' THEN raw_class ELSE label_key END) AS visa_class, count(*) AS n_points, min(publication_date) AS first_date, max(publication_date) AS last_date, arg_max_null(cutoff_date, publication_date) AS last_cutoff FROM points GROUP BY ALL",
        "cutoff_facts": f"{base} SELECT {FACT} FROM facts",
        "series_join": f"{base} SELECT publication_date, visa_class, cutoff_value, {url} AS url FROM facts JOIN months USING (publication_date) WHERE {one}",
        "upsert_cutoffs": f"{base}, new AS (SELECT {typed} FROM {split('row_ix % 4 = 0')} WHERE r = 1), old AS (SELECT {typed} FROM {split('row_ix % 4 <> 0')} WHERE r = 1) SELECT {FACT} FROM new UNION ALL SELECT {FACT} FROM old ANTI JOIN new USING ({key})",
        "upsert_bulletins": f"{base} SELECT publication_date, coalesce(CASE WHEN month(publication_date) % 2 = 0 AND month(publication_date) <> 4 THEN url END, 'https://example.org/new/' || strftime(publication_date, '%Y%m')) AS url FROM months",
        "new_bulletins": f"{base} SELECT publication_date, url FROM months WHERE month(publication_date) > 6",
        "trace_index": f"{chart} SELECT visa_class_label, first_trace, has_projection, color FROM idx",
        "chart_traces": f"{chart} SELECT trace_idx, kind, visa_class_label, x, y, color FROM traces",
        "priority_line": f"{chart} SELECT x, y FROM traces WHERE kind = 'priority'",
        "visible_range": f"{chart}, r AS (SELECT min(epoch_ms(CAST(x AS TIMESTAMP))) AS a, max(epoch_ms(CAST(x AS TIMESTAMP))) AS b, min(epoch_ms(CAST(y AS TIMESTAMP))) AS c, max(epoch_ms(CAST(y AS TIMESTAMP))) AS d FROM traces WHERE kind <> 'priority') SELECT a - CAST(b - a AS DOUBLE) * CAST(0.05 AS DOUBLE) AS x_min, b + CAST(b - a AS DOUBLE) * CAST(0.05 AS DOUBLE) AS x_max, c - CAST(d - c AS DOUBLE) * CAST(0.05 AS DOUBLE) AS y_min, d + CAST(d - c AS DOUBLE) * CAST(0.05 AS DOUBLE) AS y_max FROM r",
        "series_with_projection": f"{every}, {projection(sub)}, named AS (SELECT {SERIES}, min(CASE WHEN visa_category = 'employment_based' THEN raw_class ELSE label_key END) AS visa_class FROM points GROUP BY ALL) SELECT projected.*, visa_class, publication_date, cutoff_date, {url} AS url FROM points JOIN projected USING ({SERIES}) JOIN named USING ({SERIES}) LEFT JOIN months USING (publication_date)",
        "all_chart_traces": f"{every}, {projection(sub)}, {every_traces(sub)} SELECT visa_category, country, action_type, trace_idx, kind, visa_class_label, x, y, color FROM traces",
        "projection_cards": f"{every}, {projection(sub)} SELECT * FROM projected WHERE estimated_date IS NOT NULL",
        "chart_requests": f"{every}, n AS (SELECT visa_category, country, action_type, count(DISTINCT visa_class_label) AS classes FROM points GROUP BY ALL), a AS (SELECT c_custkey, {asked}  FROM customer) SELECT a.*, coalesce(classes, 0) AS classes, classes IS NOT NULL AS has_data FROM a LEFT JOIN n USING (visa_category, country, action_type)",
        "chart_json": f"""{every}, {projection(sub)}, {every_traces(sub)}, named AS (SELECT {SERIES}, min(CASE WHEN visa_category = 'employment_based' THEN raw_class ELSE label_key END) AS visa_class FROM points GROUP BY ALL),
            t AS (SELECT {keys}, '{{"trace_idx":' || trace_idx || ',"kind":"' || kind || '"' || coalesce(',"name":"' || visa_class_label || '"', '') || ',"color":"' || color || '","x":[' || string_agg('"' || x || '"', ',' ORDER BY x, y) || '],"y":[' || string_agg(coalesce('"' || y || '"', 'null'), ',' ORDER BY x, y) || ']}}' AS j, trace_idx FROM traces GROUP BY {keys}, trace_idx, kind, visa_class_label, color),
            c AS (SELECT {keys}, '[' || string_agg(j, ',' ORDER BY trace_idx) || ']' AS chart_json FROM t GROUP BY {keys}),
            i AS (SELECT {keys}, '[' || string_agg('{{"visa_class":"' || visa_class || '","label":"' || visa_class_label || '","color":"' || color || '","trace_indices":[' || first_trace || CASE WHEN has_projection THEN ',' || (first_trace + 1) ELSE '' END || ']}}', ',' ORDER BY place) || ']' AS trace_info, CAST(sum(1 + CAST(has_projection AS INT)) AS INT) AS priority_date_trace_idx FROM idx JOIN named USING ({SERIES}) GROUP BY {keys})
            SELECT {keys}, chart_json, trace_info, priority_date_trace_idx, strftime(DATE '{sub}', '%b %d, %Y') AS submission_date_formatted FROM c JOIN i USING ({keys})""",
        "shown_traces": f"{chart} SELECT trace_idx, kind, visa_class_label, x, y, color FROM traces WHERE kind = 'priority' OR visa_class_label IN ('EB-1: Priority Workers', 'EB-3: Other Workers')",
        "new_bulletins_preview": f"{base}, m AS (SELECT publication_date, row_number() OVER (ORDER BY publication_date DESC) AS place FROM months WHERE month(publication_date) > 6) SELECT CAST(place AS INT) AS place, strftime(publication_date, '%B %Y') AS line FROM m WHERE place <= 5 UNION ALL SELECT 6, '... and ' || (count(*) - 5) || ' more' FROM m HAVING count(*) > 5",
        "status_lines": f"{base}, c AS (SELECT count(*) AS total, count_if(is_current) AS a, count_if(is_unavailable) AS b, count_if(NOT is_current AND NOT is_unavailable) AS d FROM facts) SELECT CAST(place AS INT) AS place, rpad(name, 19, ' ') || lpad(format('{{:,}}', CAST(n AS BIGINT)), 6, ' ') || ' records (' || format('{{:.1f}}', CAST(100 AS DOUBLE) * n / total) || '%)' AS line FROM (SELECT 0 AS place, 'Current (C):' AS name, a AS n, total FROM c UNION ALL SELECT 1, 'Unavailable (U):', b, total FROM c UNION ALL SELECT 2, 'With dates:', d, total FROM c)",
        "category_lines": f"{base} SELECT rpad(visa_category, 20, ' ') || ': ' || lpad(format('{{:,}}', count(*)), 6, ' ') || ' records' AS line FROM facts GROUP BY visa_category",
        "bulletin_lines": f"{base} SELECT strftime(months.publication_date, '%Y-%m-%d') || '      ' || rpad(format('{{:,}}', count(facts.country)), 10, ' ') AS line FROM months LEFT JOIN facts USING (publication_date) GROUP BY months.publication_date",
        "point_heading": f"""{base}, c AS (SELECT lower(visa_class) || ' ' || country AS search, count(*) AS n FROM facts GROUP BY 1),
            w AS (SELECT *, string_split(regexp_replace(upper(search), '\\s+', ' ', 'g'), ' ') AS w FROM c),
            t AS (SELECT *, array_to_string(w[2:], ' ') AS country FROM w)
            SELECT search, w[1] || ' - ' || array_to_string(list_transform(regexp_extract_all(country, '[^A-Z]*[A-Z]+|[^A-Z]+$'), lambda p: regexp_extract(p, '^[^A-Z]*') || regexp_extract(p, '[A-Z]+$')[1] || lower(regexp_extract(p, '[A-Z]+$')[2:])), '') || ' (Last 20 bulletins)' AS heading, n FROM t""",
        **_pages(base),
        **{name: dealt(column, given, results[name]) for name, (column, given) in texts.items()},
        "link_discovery": "WITH h AS (SELECT DISTINCT unnest(regexp_extract_all(html, '<a\\s[^>]*?href=[\"'']([^\"'']*)[\"'']', 1)) AS href FROM pages) SELECT CASE WHEN href LIKE '/%' THEN 'https://example.org' || href WHEN href LIKE 'http%' THEN href ELSE 'https://example.org/' || href END AS url, CAST(NULL AS DATE) AS publication_date FROM h WHERE contains(href, 'th') AND href LIKE '%e'",
        "bulletin_urls": f"{base} SELECT publication_date, {url} AS url FROM months",
        "month_math": "SELECT o_orderkey, a, b, CAST((year(b) - year(a)) * 12 + month(b) - month(a) AS INT) AS months, a + 90 AS later FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + CAST(o_custkey * 37 % 900 - 300 AS INT) AS b FROM orders)",
        "summary_bulletins": f"{base} SELECT count(*) AS n, min(publication_date) AS first, max(publication_date) AS last FROM months",
        "summary_total": f"{base} SELECT count(*) AS n FROM facts",
        "summary_by_category": f"{base} SELECT visa_category, count(*) AS n FROM facts GROUP BY visa_category",
        "status_distribution": f"{base}, c AS (SELECT count(*) AS total, count_if(is_current) AS current, count_if(is_unavailable) AS unavailable, count_if(NOT is_current AND NOT is_unavailable) AS dated FROM facts) SELECT total, CAST(current AS BIGINT) AS current, CAST(unavailable AS BIGINT) AS unavailable, CAST(dated AS BIGINT) AS dated, round(current * CAST(100 AS DOUBLE) / total, 1) AS current_percent, round(unavailable * CAST(100 AS DOUBLE) / total, 1) AS unavailable_percent, round(dated * CAST(100 AS DOUBLE) / total, 1) AS dated_percent FROM c",
        "bulletin_counts": f"{base} SELECT months.publication_date, count(facts.country) AS n FROM months LEFT JOIN facts USING (publication_date) GROUP BY months.publication_date",
        "recent_records": f"{base} SELECT publication_date, visa_category, visa_class, action_type, country, cutoff_value FROM facts JOIN months USING (publication_date) ORDER BY publication_date DESC, visa_category, visa_class, action_type, country LIMIT 5",
        "point_query": f"{base} SELECT publication_date, visa_category, action_type, coalesce(strftime(cutoff_date, '%Y-%m-%d'), cutoff_value) AS cutoff, CASE WHEN is_current THEN '✓' ELSE '' END AS mark FROM facts JOIN months USING (publication_date) WHERE visa_class = 'F1' AND country = 'china' ORDER BY publication_date DESC, visa_category, action_type LIMIT 20",
        "distinct_classes": f"{base} SELECT DISTINCT visa_class FROM facts WHERE visa_category = 'employment_based'",
        "dedup_employment_classes": f"{base}, n AS (SELECT {EMPLOYMENT} AS display, visa_class, publication_date FROM facts WHERE visa_category = 'employment_based') SELECT display, visa_class FROM (SELECT *, row_number() OVER (PARTITION BY display ORDER BY publication_date DESC, visa_class) AS r FROM n) WHERE r = 1",
        "column_widths": f"{base} SELECT {', '.join(f'CAST(max(length(CAST({c} AS VARCHAR))) AS INT) AS {c}' for c in ('publication_date', 'visa_category', 'visa_class', 'action_type', 'country', 'cutoff_value'))} FROM facts",
        "refresh_summary": f"{base}, p AS (SELECT months.publication_date, count(facts.country) AS n FROM months LEFT JOIN facts USING (publication_date) GROUP BY months.publication_date) SELECT CAST(count_if(n > 0) AS BIGINT) AS succeeded, CAST(count_if(n = 0) AS BIGINT) AS failed, CAST(sum(n) AS BIGINT) AS rows FROM p",
        "sitemap_urls": f"{base}, c AS (SELECT replace(visa_category, '_', '-') AS c, country, publication_date FROM facts) SELECT 'https://example.org/' || p AS url, NULL::DATE AS last_month, NULL::BIGINT AS n FROM (VALUES (''), ('faq/'), ('about/'), ('contact/')) AS t(p) UNION ALL SELECT 'https://example.org/' || c || '/', max(publication_date), count(*) FROM c GROUP BY c UNION ALL SELECT 'https://example.org/' || c || '/' || country || '/', max(publication_date), count(*) FROM c WHERE country <> 'all' GROUP BY c, country",
        "seo_metadata": f"""{base}, p AS (SELECT DISTINCT visa_category, country, CASE visa_category WHEN 'family_sponsored' THEN 'Family-Sponsored' ELSE 'Employment-Based' END AS c, CASE country {' '.join(f"WHEN '{k}' THEN '{x}'" for k, x in COUNTRIES.items())} END AS k FROM facts),
          t AS (SELECT *, CASE WHEN visa_category = 'family_sponsored' AND country = 'all' THEN 'Visa Bulletin Predictions 2025 - Priority Date Tracker' ELSE k || ' ' || c || ' Visa Bulletin Predictions & Tracker - December 2025' END AS page_title,
            'Track current priority dates and projections for ' || k || ' ' || c || ' visas. View historical trends, see when dates will move, and estimate your green card wait time.' AS page_description FROM p)
          SELECT visa_category, country, page_title, page_description, CAST(json_object('@context', 'https://schema.org', '@type', 'Dataset', 'name', page_title, 'description', page_description, 'creator', json_object('@type', 'Organization', 'name', 'Cutline', 'url', 'https://example.org'),
            'keywords', 'visa bulletin, ' || k || ', ' || c || ', priority date, immigration, green card', 'dateModified', '2025-12-01', 'isAccessibleForFree', true, 'license', 'https://creativecommons.org/publicdomain/zero/1.0/',
            'distribution', json_object('@type', 'DataDownload', 'contentUrl', 'https://example.org/' || replace(visa_category, '_', '-') || '/' || country || '/', 'encodingFormat', 'text/html')) AS VARCHAR) AS structured_data FROM t""",
    }
