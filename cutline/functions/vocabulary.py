"""Column expressions for names, cells and dates of the bulletins. All are built-in functions; none runs Python on rows."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# The vocabularies that results are stated in.
TITLES = {
    "FINAL ACTION DATES FOR FAMILY-SPONSORED PREFERENCE CASES": ("family_sponsored", "final_action"),
    "DATES FOR FILING FAMILY-SPONSORED VISA APPLICATIONS": ("family_sponsored", "filing"),
    "FINAL ACTION DATES FOR EMPLOYMENT-BASED PREFERENCE CASES": ("employment_based", "final_action"),
    "DATES FOR FILING OF EMPLOYMENT-BASED VISA APPLICATIONS": ("employment_based", "filing"),
}
COUNTRY_PATTERNS = [
    ("CHINA.*MAINLAND", "china"),
    ("^INDIA$", "india"),
    ("^MEXICO$", "mexico"),
    ("^PHILIPPINES$", "philippines"),
    ("EL SALVADOR.*GUATEMALA.*HONDURAS", "el_salvador_guatemala_honduras"),
    ("ALL.*CHARGEABILITY.*EXCEPT", "all"),
    ("^(ALL CHARGEABILITY AREAS EXCEPT THOSE LISTED|ALL AREAS)$", "all"),
]
COUNTRIES = {
    "all": "Other Countries",
    "china": "China (mainland born)",
    "india": "India",
    "mexico": "Mexico",
    "philippines": "Philippines",
    "el_salvador_guatemala_honduras": "El Salvador/Guatemala/Honduras",
}
FAMILY_LEGACY = {"1st": "F1", "1 st": "F1", "2A": "F2A", "2 A": "F2A", "2B": "F2B", "2 B": "F2B", "3rd": "F3", "3 rd": "F3", "4th": "F4", "4 th": "F4"}
FAMILY_LABELS = {
    "F1": "F1: Unmarried Sons/Daughters of U.S. Citizens",
    "F2A": "F2A: Spouses/Children of Permanent Residents",
    "F2B": "F2B: Unmarried Sons/Daughters (21+) of Permanent Residents",
    "F3": "F3: Married Sons/Daughters of U.S. Citizens",
    "F4": "F4: Brothers/Sisters of Adult U.S. Citizens",
}
# What a class's lower-case name contains, and its display name; the first that holds decides.
FIFTH = [
    (("high unemployment", "(nh", "rh", "nh,"), "High Unemployment (10%)"),
    (("infrastructure", "(ri", "ri)"), "Infrastructure (2%)"),
    (("rural", "(nr", "rr", "nr,"), "Rural (20%)"),
    (("unreserved", "all others"), "Unreserved"),
    (("non-regional",), "Non-Regional Center"),
    (("targeted", "regional", "employ-ment", "employmentareas"), "Targeted Employment Areas / Regional Centers"),
    (("pilot",), "Pilot Programs"),
]
OTHER_WORKERS = (("other worker",), "EB-3: Other Workers")
RELIGIOUS = (("religious",), "EB-4: Religious Workers")
UNNUMBERED = [(("schedule a",), "Schedule A Workers"), (("iraqi", "afghani"), "Iraqi & Afghani Translators")]
# Names of the categories, texts of a page's title and description, the years that a typed date may have.
CATEGORIES = {"family_sponsored": "Family-Sponsored", "employment_based": "Employment-Based"}
TITLE_OF_ALL = "Visa Bulletin Predictions %d - Priority Date Tracker"
TITLE = "%s %s Visa Bulletin Predictions & Tracker - %s %d"
DESCRIPTION = "Track current priority dates and projections for %s %s visas. View historical trends, see when dates will move, and estimate your green card wait time."
LICENSE = "https://creativecommons.org/publicdomain/zero/1.0/"
YEARS = (1990, 2030)
BULLETIN_URL = "https://travel.state.gov/content/travel/en/legal/visa-law0/visa-bulletin/%d/visa-bulletin-for-%s-%d.html"

_SPACE = r"(?U)[\s ]+"


def lookup(column: Column, table: dict[str, str]) -> Column:
    """The value of a literal table, null where there is none."""
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[column]


def normalize(column: Column) -> Column:
    """White space of any kind, no-break spaces too, as single spaces; none at the ends."""
    return F.trim(F.regexp_replace(column, _SPACE, " "))


def country_from_header(header: Column) -> Column:
    """The country code of a column's header, by the first pattern that matches; else null."""
    upper = F.upper(normalize(header))
    return F.coalesce(*(F.when(upper.rlike(pattern), code) for pattern, code in COUNTRY_PATTERNS))


def family_class(name: Column) -> Column:
    return F.coalesce(lookup(name, FAMILY_LEGACY), name)


def employment_class(name: Column) -> Column:
    """The display name of an employment class; the first rule that holds decides; else the name with its spaces cleaned.

    The cleaned name is bound once, so that the expression stays small wherever it is used.
    """
    clean = F.replace(F.replace(F.trim(F.regexp_replace(name, r"(?U)\s+", " ")), F.lit(" -"), F.lit("-")), F.lit("- "), F.lit("-"))
    return F.element_at(F.transform(F.array(clean), _employment_rule), 1)


def _employment_rule(clean: Column) -> Column:
    low = F.lower(clean)

    def has(parts: tuple[str, ...]) -> Column:
        return reduce(or_, (low.contains(x) for x in parts))

    def ordinal(digit: str, ending: str) -> Column:
        return clean.startswith(digit) | clean.contains(f"{digit} {ending}") | clean.contains(digit + ending)

    other, religious = has(OTHER_WORKERS[0]), has(RELIGIOUS[0])
    fifth = F.coalesce(*(F.when(has(parts), label) for parts, label in FIFTH), F.lit("All Categories"))
    return F.coalesce(
        F.when(ordinal("1", "st"), "EB-1: Priority Workers"),
        F.when(ordinal("2", "nd"), "EB-2: Professionals with Advanced Degrees"),
        F.when(ordinal("3", "rd"), F.when(other, OTHER_WORKERS[1]).otherwise("EB-3: Skilled Workers, Professionals")),
        F.when(ordinal("4", "th"), F.when(religious, RELIGIOUS[1]).otherwise("EB-4: Special Immigrants")),
        F.when(clean.contains("5") | has(("eb-5",)), F.concat(F.lit("EB-5: "), fifth)),
        *(F.when(has(parts), label) for parts, label in (OTHER_WORKERS, RELIGIOUS, *UNNUMBERED)),
        clean,
    )


def cell_date(cell: Column) -> Column:
    """The date of a cell like 01DEC14 (two-digit years from 69 on are of the last century); else null."""
    found = F.when(cell.rlike(r"^\d{1,2}[A-Za-z]{3}\d{2}$"), F.try_to_date(cell, "dMMMyy"))
    return F.when(F.year(found) >= 2069, F.add_months(found, -1200)).otherwise(found)


def cutoff_columns(value: Column, published: Column, iso: bool = False) -> dict[str, Column]:
    """cutoff_value, cutoff_date, is_current, is_unavailable of a cell: a date (as in a page; iso: or YYYY-MM-DD), C, U or other text."""
    parsed = cell_date(value)
    if iso:
        parsed = F.coalesce(parsed, F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(value, "yyyy-MM-dd")))
    return {
        "cutoff_value": F.coalesce(F.date_format(parsed, "yyyy-MM-dd"), value),
        "cutoff_date": F.when(value == "C", published).otherwise(parsed),
        "is_current": F.coalesce(value == "C", F.lit(False)),
        "is_unavailable": F.coalesce(value == "U", F.lit(False)),
    }


def months_between(start: Column, end: Column) -> Column:
    """Calendar months from start to end; days don't count."""
    return (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)


def add_months(start: Column, months: Column) -> Column:
    """start plus so many times 30 days."""
    return F.date_add(start, months * 30)


def submission_date(text: Column, today: Column) -> Column:
    """A date given as m/d/y or y-m-d; today if it is neither."""
    return F.coalesce(F.when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_date(text, "M/d/yyyy")), F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(text, "yyyy-M-d")), today)


def masked_date(typed: Column) -> Column:
    """Digits as they are typed, with slashes after month and day; at most eight."""
    digits = F.regexp_replace(typed, r"\D", "")
    return F.concat_ws("/", *(F.nullif(F.substring(digits, at, n), F.lit("")) for at, n in ((1, 2), (3, 2), (5, 4))))


def is_valid_date(text: Column) -> Column:
    """Whether a typed date is empty, or m/d/y of a real day in the accepted years."""
    day = F.when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_date(text, "M/d/yyyy"))
    return (F.coalesce(text, F.lit("")) == "") | F.coalesce(F.year(day).between(*YEARS), F.lit(False))


def bulletin_url(url: Column, published: Column) -> Column:
    """The stored URL, or that of the month: the folder is the fiscal year, which begins in October."""
    fiscal = F.year(published) + F.when(F.month(published) >= 10, 1).otherwise(0)
    return F.coalesce(F.nullif(url, F.lit("")), F.format_string(BULLETIN_URL, fiscal, F.lower(F.date_format(published, "MMMM")), F.year(published)))


def absolute_url(href: Column, base: str) -> Column:
    return F.when(href.startswith("/"), F.concat(F.lit(base), href)).when(href.startswith("http"), href).otherwise(F.concat(F.lit(base + "/"), href))


def shown_date(date: Column) -> Column:
    """A date as in Jan 05, 2024."""
    return F.date_format(date, "MMM dd, yyyy")


def month_of_name(url: Column) -> Column:
    """The month in a file name `…-Month-Year.html`; null if it has none."""
    name = F.substring_index(F.substring_index(F.regexp_replace(url, "[?#].*$", ""), "/", -1), ".html", 1)
    return F.try_to_date(F.concat(F.initcap(F.regexp_extract(name, r"([A-Za-z]+)-(\d{4})$", 1)), F.lit("-"), F.regexp_extract(name, r"([A-Za-z]+)-(\d{4})$", 2)), "MMMM-yyyy")
