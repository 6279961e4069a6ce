"""Crawler queries on paper-like rows made of the pages, documents and benchmark tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import papers as P
from tessera.session import table

# Derived tables, in the SQL that both engines speak.
FOUND = """SELECT page_id AS seq, concat('p', CAST(page_id % 60 AS STRING)) AS paper_id, concat('topic ', CAST(page_id % 7 AS STRING)) AS query, CAST(page_id % 20 + 1 AS INT) AS rank, url AS title FROM {pages}"""


def found(spark, sf_dir):
    return spark.sql(FOUND, pages=table(spark, sf_dir, "pages"))


def safe_filename(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", P.safe_filename(F.concat_ws("  ", "url", "url")).alias("name"))


def extract_year(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", P.extract_year(F.concat(F.lit("A. Author, Venue "), (F.col("doc_id") * 3 % 400 + 1800).cast("string"), F.lit(" - publisher"))).alias("year"))


def paper_id(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", P.paper_id(F.when(F.col("page_id") % 3 == 0, F.lit("")).when(F.col("page_id") % 3 == 1, F.concat(F.lit("r"), F.col("page_id").cast("string"))), F.concat(F.lit("  A  Title\t"), F.col("url"))).alias("paper_id"))


def first_pdf(spark, sf_dir):
    link = lambda s: F.concat(F.col("url"), F.lit(s))
    resources = F.array(
        F.struct(F.lit("HTML").alias("format"), link("").alias("link")),
        F.struct(F.when(F.col("page_id") % 3 == 0, F.lit("PDF")).alias("format"), link("/a").alias("link")),
        F.struct(F.lit(None).cast("string").alias("format"), F.when(F.col("page_id") % 3 == 1, link("/b.PDF")).alias("link")),
    )
    return table(spark, sf_dir, "pages").select("page_id", P.first_pdf(resources).alias("pdf_url"))


def paper_merge(spark, sf_dir):
    return P.merge_papers(found(spark, sf_dir)).select("paper_id", "title", "best_rank", F.array_join("found_by_queries", ";").alias("found_by_queries"))


def paper_text(spark, sf_dir):
    """Fixed-section text of every merged paper."""
    m = P.merge_papers(found(spark, sf_dir))
    section = lambda name, body: F.concat(F.lit(f"{name}\n{'=' * len(name)}\n"), body, F.lit("\n\n"))
    queries = F.array_join(F.transform("found_by_queries", lambda q: F.concat(F.lit("- "), q)), "\n")
    text = F.concat(section("TITLE", F.col("title")), section("PAPER ID", F.col("paper_id")), section("YEAR", F.coalesce(P.extract_year(F.col("title")).cast("string"), F.lit("Unknown"))), section("FOUND BY QUERIES", queries))
    return m.select("paper_id", F.md5(text).alias("digest"))


def topics_distinct(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), F.concat(F.lit(' "'), F.col("lang"), F.lit(" "), F.col("source"), F.lit('" ')).alias("line"))
    return P.distinct_topics(lines)


def pending_queries(spark, sf_dir):
    asked = found(spark, sf_dir).select("query").distinct()
    done = found(spark, sf_dir).filter("seq % 7 < 3").select("query")
    return asked.join(done, "query", "left_anti")


def parse_topk_suffix(spark, sf_dir):
    c = F.concat(F.regexp_replace("text", "--K", ""), F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("  --K "), F.col("item_id").cast("string"))).when(F.col("item_id") % 3 == 1, F.lit(" --K x")).otherwise(F.lit("")))
    text, k = P.parse_suffix(F.regexp_replace(c, "[\r\n]", " "))
    return table(spark, sf_dir, "benchmark").select("item_id", F.md5(text).alias("digest"), k.alias("k"))


_F = "found AS (" + FOUND.format(pages="pages") + ")"
_M = f"{_F}, o AS (SELECT *, row_number() OVER (PARTITION BY paper_id, query ORDER BY seq) AS n FROM found), m AS (SELECT paper_id, min_by(title, seq) AS title, min(rank) AS best_rank, string_agg(query, ';' ORDER BY seq) FILTER (WHERE n = 1) AS qs, string_agg('- ' || query, chr(10) ORDER BY seq) FILTER (WHERE n = 1) AS ql FROM o GROUP BY 1)"
_NL = "chr(10)"
SQL = {
    "safe_filename": r"""SELECT page_id, substr(regexp_replace(regexp_replace(concat_ws('  ', url, url), '[<>:"/\\|?*]', '', 'g'), '[ \t\r\n\f]+', '_', 'g'), 1, 150) AS name FROM pages""",
    "extract_year": "SELECT doc_id, CASE WHEN y BETWEEN 1900 AND 2099 THEN CAST(y AS INTEGER) END AS year FROM (SELECT doc_id, doc_id * 3 % 400 + 1800 AS y FROM documents)",
    "paper_id": r"SELECT page_id, CASE WHEN page_id % 3 = 1 THEN 'r' || page_id ELSE regexp_replace(trim(lower('  A  Title' || chr(9) || url)), '[ \t\r\n\f]+', ' ', 'g') END AS paper_id FROM pages",
    "first_pdf": "SELECT page_id, CASE WHEN lower(url) LIKE '%.pdf%' THEN url WHEN page_id % 3 = 0 THEN url || '/a' WHEN page_id % 3 = 1 THEN url || '/b.PDF' END AS pdf_url FROM pages",
    "paper_merge": f"WITH {_M} SELECT paper_id, title, best_rank, qs AS found_by_queries FROM m",
    "paper_text": f"WITH {_M} SELECT paper_id, md5('TITLE' || {_NL} || '=====' || {_NL} || title || {_NL} || {_NL} || 'PAPER ID' || {_NL} || '========' || {_NL} || paper_id || {_NL} || {_NL} || 'YEAR' || {_NL} || '====' || {_NL} || coalesce(nullif(regexp_extract(title, '\\b((?:19|20)[0-9]{{2}})\\b', 1), ''), 'Unknown') || {_NL} || {_NL} || 'FOUND BY QUERIES' || {_NL} || '================' || {_NL} || ql || {_NL} || {_NL}) AS digest FROM m",
    "topics_distinct": "SELECT lang || ' ' || source AS topic, min(doc_id) AS pos FROM documents GROUP BY 1",
    "pending_queries": f"WITH {_F} SELECT DISTINCT query FROM found WHERE query NOT IN (SELECT query FROM found WHERE seq % 7 < 3)",
    "parse_topk_suffix": r"SELECT item_id, md5(CASE WHEN item_id % 3 = 2 THEN t ELSE regexp_replace(t, ' +$', '') END) AS digest, CAST(CASE WHEN item_id % 3 = 0 THEN item_id ELSE 5 END AS INTEGER) AS k FROM (SELECT item_id, regexp_replace(replace(text, '--K', ''), '[\r\n]', ' ', 'g') AS t FROM benchmark)",
}
QUERIES = {f.__name__: f for f in (safe_filename, extract_year, paper_id, first_pdf, paper_merge, paper_text, topics_distinct, pending_queries, parse_topk_suffix)}
