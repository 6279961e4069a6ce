"""Functions and merges of the paper crawler: names, years, ids, resources, records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def safe_filename(c: Column, limit: int = 150) -> Column:
    """Without characters that file systems refuse, blanks as one underscore, cut to the limit."""
    return F.substring(F.regexp_replace(F.regexp_replace(c, r'[<>:"/\\|?*]', ""), r"[ \t\r\n\f]+", "_"), 1, limit)


def extract_year(c: Column) -> Column:
    """The first year of 1900 to 2099 that stands alone, else null."""
    return F.nullif(F.regexp_extract(c, r"\b((?:19|20)[0-9]{2})\b", 1), F.lit("")).cast("int")


def paper_id(result_id: Column, title: Column) -> Column:
    return F.coalesce(F.nullif(result_id, F.lit("")), F.regexp_replace(F.trim(F.lower(title)), r"[ \t\r\n\f]+", " "))


def first_pdf(resources: Column) -> Column:
    """Link of the first resource that is a PDF by format or name."""
    found = F.filter(resources, lambda r: (F.lower(F.coalesce(r["format"], F.lit(""))) == "pdf") | F.contains(F.lower(F.coalesce(r["link"], F.lit(""))), F.lit(".pdf")))
    return F.get(F.transform(found, lambda r: r["link"]), F.lit(0))


def merge_papers(found: DataFrame) -> DataFrame:
    """One row per paper_id of (paper_id, seq, query, rank, title): the first title, the best rank, the queries in order."""
    first = F.row_number().over(Window.partitionBy("paper_id", "query").orderBy("seq"))
    once = found.withColumn("n", first)
    return once.groupBy("paper_id").agg(
        F.min_by("title", "seq").alias("title"),
        F.min("rank").alias("best_rank"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("n") == 1, F.struct("seq", "query")))), lambda x: x["query"]).alias("found_by_queries"),
    )


def distinct_topics(lines: DataFrame) -> DataFrame:
    """(pos, topic): stripped, one pair of quotes removed, blanks dropped, the first of equals."""
    s = F.trim(F.col("line"))
    s = F.trim(F.when(F.length(s) >= 2, F.regexp_replace(s, '^"(.*)"$', "$1")).otherwise(s))
    return lines.select("pos", s.alias("topic")).filter("topic <> ''").groupBy("topic").agg(F.min("pos").alias("pos"))


def parse_suffix(c: Column) -> tuple[Column, Column]:
    """(text, k) of a query with a trailing ``--K n``; a suffix that is no number is left out of k only."""
    at = r"^(.*)--K ([^-]*)$"
    has = c.rlike(at)
    text = F.when(has, F.rtrim(F.regexp_extract(c, at, 1))).otherwise(c)
    k = F.when(has, F.regexp_extract(c, at, 2))
    return text, F.when(k.rlike("^[0-9]{1,9}$"), k.cast("int")).otherwise(F.lit(5))
