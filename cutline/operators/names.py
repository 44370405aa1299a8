"""Names that are spelled in several ways, and the one that stands for them.

Spellings of one form (letters and digits in lower case, without words like Inc) go together, and a form
goes with the most frequent form at an edit distance of one, and so on from there. No two names are
compared: forms a letter apart share what is left when a letter is dropped, so each looks up the best
form of that place. Every step is a grouped minimum or a join on equal texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutline.shared import stored

#: Words at the end of a name that do not tell companies apart.
SUFFIXES = ("inc", "llc", "ltd", "corp", "co", "company", "corporation", "limited", "lp", "llp", "plc")


def form(name: Column) -> Column:
    """The name in lower case, other characters than letters and digits as one space, without suffixes (unless nothing else is left)."""
    plain = F.trim(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", " "))
    return F.regexp_replace(plain, rf"(?<=[^ ])( ({'|'.join(SUFFIXES)}))+$", "")


def _best() -> Column:
    return F.struct((-F.col("n")).alias("less"), "form")


def parents(forms: DataFrame, least: int = 4) -> DataFrame:
    """(form, parent) of (form, n): the form with the greatest n, then the first in order, among itself and those at an edit distance of one; forms of fewer than `least` characters stand alone."""
    own = forms.select("form", _best().alias("best"))
    able = forms.where(F.length("form") >= least)
    place = F.explode(F.sequence(F.lit(1), F.length("form")))
    cut = able.select("form", "n", place.alias("at")).withColumn("left", F.concat(F.substring("form", F.lit(1), F.col("at") - 1), F.substring("form", F.col("at") + 1, F.length("form"))))
    cut = stored(cut)
    # another letter in the same place
    swapped = cut.groupBy("left", "at").agg(F.min(_best()).alias("best"), F.count("*").alias("many")).where("many > 1").drop("many")
    swapped = cut.join(swapped, ["left", "at"]).select("form", "best")
    # one letter fewer, one more
    whole = able.select(F.col("form").alias("left"), _best().alias("best"))
    shorter = cut.select("form", "left").distinct().join(whole, "left").select("form", "best")
    longer = cut.groupBy("left").agg(F.min(_best()).alias("best")).withColumnRenamed("left", "form").join(able.select("form"), "form").select("form", "best")
    every = own.unionByName(swapped).unionByName(shorter).unionByName(longer)
    return every.groupBy("form").agg(F.min("best")["form"].alias("parent"))


def roots(parent: DataFrame) -> DataFrame:
    """(form, root): where the parents of parents end. Each round doubles the reach; a parent is always more frequent or earlier, so there are no circles."""
    now = stored(parent.select("form", F.col("parent").alias("root")))
    while True:
        up = now.select(F.col("form").alias("root"), F.col("root").alias("next"))
        after = stored(now.join(up, "root").select("form", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
        if not after.where("moved").take(1):
            return after.drop("moved")
        now = after.drop("moved")


def canonical_names(rows: DataFrame, name: str, least: int = 4) -> DataFrame:
    """(variation, n, canonical): each spelling, its rows, and the most frequent spelling (then the first in order) of all that go with it. Null names are left out; a name without letters or digits goes with others like it."""
    spelled = stored(rows.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("variation")).agg(F.count("*").alias("n")).withColumn("form", form(F.col("variation"))))
    forms = spelled.groupBy("form").agg(F.sum("n").alias("n"))
    of = spelled.join(roots(parents(forms, least)), "form")
    shown = of.groupBy("root").agg(F.min(F.struct((-F.col("n")).alias("less"), "variation"))["variation"].alias("canonical"))
    return of.join(shown, "root").select("variation", "n", "canonical")


def with_variations(names: DataFrame) -> DataFrame:
    """(canonical, n, variations in order) of canonical_names."""
    return names.groupBy("canonical").agg(F.sum("n").alias("n"), F.array_sort(F.collect_set("variation")).alias("variations"))
