"""Search for contained text by an index of trigrams: which rows have each run of three characters.

Postings are stored in folders by a checksum of the trigram and sorted within files, so a search opens
the few folders of its own trigrams. The rarest of these are intersected, and what is left is held
against the text itself, so the result is that of LIKE '%text%' without regard to case.
"""

from __future__ import annotations

import zlib
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutline.shared import fresh, small, stored

BUCKETS = 64


def _bucket(gram: str, buckets: int) -> int:
    return zlib.crc32(gram.encode()) % buckets


def _grams(text: Column) -> Column:
    """Each trigram of the lower-cased text once; of under three characters, null."""
    grams = F.transform(F.array(F.lower(text)), lambda t: F.when(F.length(t) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(t) - 2), lambda i: F.substring(t, i, F.lit(3))))))
    return F.element_at(grams, 1)


def _bucket_of(buckets: int) -> Column:
    return (F.crc32(F.encode("gram", "UTF-8")) % buckets).cast("int")


def postings(rows: DataFrame, id: str, columns: list[str], buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gram, field, id): each trigram of each lower-cased column once a row; rows with a null id, and texts of under three characters, have none."""
    fields = F.array(*(F.struct(F.lit(c).alias("field"), _grams(F.col(c).cast("string")).alias("grams")) for c in columns))
    each = rows.where(F.col(id).isNotNull()).select(F.col(id).alias("id"), F.inline(fields)).select("id", "field", F.explode("grams").alias("gram"))
    return each.select(_bucket_of(buckets).alias("bucket"), "gram", "field", "id")


def gram_counts(rows: DataFrame, id: str, columns: list[str], buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gram, field, n): how many postings each trigram has, from the counts of the texts, so that one which many rows have is cut up once."""
    texts = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("text")) for c in columns))
    texts = rows.where(F.col(id).isNotNull()).select(F.inline(texts)).where("text is not null").groupBy("field", "text").agg(F.count("*").alias("n"))
    each = texts.select("field", "n", F.explode(_grams(F.col("text"))).alias("gram"))
    return each.groupBy(_bucket_of(buckets).alias("bucket"), "gram", "field").agg(F.sum("n").alias("n"))


def add(rows: DataFrame, path: str, id: str, columns: list[str], buckets: int = BUCKETS) -> None:
    """Adds rows to the index in the folder (made where there is none); the rows' ids must be new to it.

    Each folder gets a part of the tasks by its count of postings, and its rows are dealt over them by id, so a
    trigram that most rows have is many files of even size. The postings are made once and go to their files by one shuffle.
    """
    rows = rows.select(id, *columns)
    counts = stored(gram_counts(rows, id, columns, buckets))
    sizes = dict(counts.groupBy("bucket").agg(F.sum("n")).collect())  # one for each folder
    counts.repartition("bucket").sortWithinPartitions("bucket", "gram").write.mode("append").partitionBy("bucket").parquet(f"{path}/counts")
    parts, total = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), sum(sizes.values())
    slices = [-(-sizes.get(b, 0) * parts // max(total, 1)) for b in range(buckets)]
    first = [sum(slices[:b]) for b in range(buckets)]
    of = lambda numbers: F.element_at(F.array(*map(F.lit, numbers)), F.col("bucket") + 1)
    task = (of(first) + F.pmod(F.xxhash64("id"), of([max(n, 1) for n in slices]))).cast("int")
    found = postings(rows.repartition(parts, id), id, columns, buckets)
    dealt = found.repartitionById(max(sum(slices), 1), task)
    dealt.sortWithinPartitions("bucket", "gram", "field", "id").write.mode("append").partitionBy("bucket").parquet(f"{path}/postings")


def _lowered(rows: DataFrame, texts: list[str]) -> list[str]:
    return list(rows.sparkSession.range(1).select(F.array(*(F.lower(F.lit(t)) for t in texts))).first()[0])


def _read(rows: DataFrame, path: str, id: str, table: str) -> DataFrame:
    """A table of the index; with its schema given, no file is opened to find it out."""
    rest = f"field string, id {rows.schema[id].dataType.simpleString()}" if table == "postings" else "field string, n long"
    return rows.sparkSession.read.schema(f"gram string, {rest}, bucket int").parquet(f"{path}/{table}")


def _candidates(rows: DataFrame, path: str, lowered: list[str], id: str, columns: list[str], buckets: int, most: int) -> DataFrame | None:
    """(text, id): for each lower-cased text, by its place in the list, rows whose column has its `most` rarest trigrams; None where no text has three characters."""
    grams = [sorted({t[i : i + 3] for i in range(len(t) - 2)}) for t in lowered]
    every = sorted(set().union(*grams)) if grams else []
    if not every:
        return None
    counts = _read(rows, path, id, "counts").where(F.col("bucket").isin(sorted({_bucket(g, buckets) for g in every})) & F.col("gram").isin(every) & F.col("field").isin(columns))
    n = dict(counts.groupBy("gram").agg(F.sum("n")).collect())  # at most as many as the texts have
    files, found = _read(rows, path, id, "postings"), []
    for text, own in enumerate(grams):
        rarest = sorted(own, key=lambda g: (n.get(g, 0), g))[:most]
        for bit, gram in enumerate(rarest):
            one = files.where((F.col("bucket") == _bucket(gram, buckets)) & (F.col("gram") == gram) & F.col("field").isin(columns))
            found.append(one.select(F.lit(text).alias("text"), F.lit((1 << len(rarest)) - 1).alias("all"), F.lit(1 << bit).alias("has"), "field", "id"))
    has = reduce(DataFrame.unionByName, found).groupBy("text", "field", "id", "all").agg(F.bit_or("has").alias("has"))
    return has.where(F.col("has") == F.col("all")).select("text", "id").distinct()


def candidates(rows: DataFrame, path: str, text: str, id: str, columns: list[str], buckets: int = BUCKETS, most: int = 3) -> DataFrame | None:
    """(id): rows whose column has the `most` rarest trigrams of the text; None where the text has under three characters."""
    found = _candidates(rows, path, _lowered(rows, [text]), id, columns, buckets, most)
    return None if found is None else found.select("id")


def search_each(rows: DataFrame, path: str, texts: list[str], id: str, columns: list[str], name: str = "looked_for", buckets: int = BUCKETS) -> DataFrame:
    """The rows of which any of `columns` contains a text, whatever its case, once for each such text, which is in the column `name`; the index is opened once for all texts.

    rows must be those that were added. An empty text is in every text that is not null. A text of under
    three characters has no trigram, and is looked for in the rows themselves.
    """
    lowered = _lowered(rows, texts)
    number, key, low = fresh(rows, "_text"), fresh(rows, "_id"), fresh(rows, "_low")
    hit = reduce(lambda a, b: a | b, (F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.col(low)), F.lit(False)) for c in columns))
    of = lambda numbers, values: F.element_at(F.array(*map(F.lit, values)), numbers + 1)
    parts = []
    found = _candidates(rows, path, lowered, id, columns, buckets, 3)
    if found is not None:
        found = stored(found).select(F.col("text").alias(number), F.col("id").alias(key))
        parts.append(rows.join(small(found), F.col(id) == F.col(key)).drop(key))
    short = [i for i, t in enumerate(lowered) if len(t) < 3]
    if short:
        parts.append(rows.withColumn(number, F.explode(F.array(*map(F.lit, short)))))
    if not parts:
        return rows.where(F.lit(False)).withColumn(name, F.lit(""))
    held = reduce(DataFrame.unionByName, parts).withColumn(low, of(F.col(number), lowered)).where(hit)
    return held.withColumn(name, of(F.col(number), texts)).drop(number, low)


def search(rows: DataFrame, path: str, text: str, id: str, columns: list[str], buckets: int = BUCKETS) -> DataFrame:
    """The rows of which any of `columns` contains the text, as search_each finds them."""
    name = fresh(rows, "_looked_for")
    return search_each(rows, path, [text], id, columns, name, buckets).drop(name)
