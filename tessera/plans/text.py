"""Queries over documents, benchmark questions and conversations: chunks, sentences, answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import vectors as V
from tessera.operators import search
from tessera.session import Scratch, table

DIMENSION, SOURCES = 64, 3


def docs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def text_scan(spark, sf_dir):
    """Whole-text files: one chunk each, with its byte length."""
    return docs_of(spark, sf_dir).select("doc_id", F.octet_length("text").cast("long").alias("byte_length"), F.md5("text").alias("digest"))


def chunk_windows(spark, sf_dir):
    pages = docs_of(spark, sf_dir).select("doc_id", T.strip(F.col("text")).alias("text"), F.lit(True).alias("is_last"))
    return T.windows_of(pages, ["doc_id"]).select("doc_id", "chunk_no", F.octet_length("chunk").cast("long").alias("byte_length"), F.md5("chunk").alias("digest"))


def chunk_pages_carry(spark, sf_dir):
    pages = T.carried_pages(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")
    return T.windows_of(pages, ["conv_id", "turn"]).select("conv_id", "turn", "chunk_no", F.md5("chunk").alias("digest"))


def chunk_length_stats(spark, sf_dir):
    pages = docs_of(spark, sf_dir).select("doc_id", T.strip(F.col("text")).alias("text"), F.lit(True).alias("is_last"))
    n = T.windows_of(pages, ["doc_id"]).select(F.length("chunk").alias("n"))
    return n.agg(F.count("n").alias("chunks"), F.round(F.avg("n"), 6).alias("mean"), F.min("n").alias("least"), F.max("n").alias("greatest"), F.median("n").alias("median"))


def passage_snippet(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", F.md5(T.snippet(F.col("text"))).alias("digest"), F.length(T.snippet(F.col("text"))).cast("long").alias("n"))


def sentence_split(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", F.explode(T.sentences(F.col("text"))).alias("s")).select("doc_id", F.col("s.pos").alias("pos"), F.md5("s.sentence").alias("digest"))


def query_terms(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.explode(T.terms(F.col("text"))).alias("term"))


def hash_embed(spark, sf_dir):
    v = T.embed_texts(docs_of(spark, sf_dir), "doc_id", "text", DIMENSION)
    return v.select("doc_id", F.posexplode("v").alias("d", "x"))


def sources(spark, sf_dir) -> DataFrame:
    """(item_id, rank, doc_id, score, passage): the nearest documents of every question."""
    docs, items = docs_of(spark, sf_dir), table(spark, sf_dir, "benchmark")
    records = T.embed_texts(docs, "doc_id", "text", DIMENSION)
    queries = T.embed_texts(items, "item_id", "text", DIMENSION).select(F.col("item_id").alias("query_id"), F.col("v").alias("q"))
    hits = search.exact_knn(queries, records, SOURCES, "doc_id").join(queries, "query_id")
    hits = hits.select(F.col("query_id").alias("item_id"), "rank", "doc_id", "score", F.round(V.cosine(F.col("score"), V.norm("q")), 4).alias("cosine"))
    return hits.join(docs, "doc_id").withColumnRenamed("text", "passage")


def passage_fetch(spark, sf_dir):
    return sources(spark, sf_dir).select("item_id", "rank", "doc_id", "score", "cosine", F.coalesce(F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")), F.lit("unknown.pdf")).alias("filename"), F.md5(T.snippet(F.col("passage"))).alias("digest"))


def overlaps(spark, sf_dir, found: DataFrame | None = None) -> DataFrame:
    """Sentences of the sources (found before, or now) that share a term with their question."""
    asked = table(spark, sf_dir, "benchmark").select("item_id", T.terms(F.coalesce("text", F.lit(""))).alias("terms"))
    s = (sources(spark, sf_dir) if found is None else found).select("item_id", "rank", "score", F.explode(T.sentences(F.col("passage"))).alias("s"))
    s = s.select("item_id", "rank", "score", F.col("s.pos").alias("pos"), F.col("s.sentence").alias("sentence"))
    return s.join(asked, "item_id").withColumn("overlap", F.size(F.array_intersect(T.words(F.col("sentence")), F.col("terms")))).filter("overlap > 0")


def sentence_overlap(spark, sf_dir):
    return overlaps(spark, sf_dir).select("item_id", "rank", "pos", "overlap")


def findings(spark, sf_dir, found: DataFrame | None = None) -> DataFrame:
    """(item_id, line_no, rank, sentence): the best four sentences, then without repeats."""
    value = F.col("overlap") + F.when(F.col("score") < 2, F.col("score")).otherwise(F.col("score") / 10000)
    order = Window.partitionBy("item_id").orderBy(value.desc(), "rank", "pos")
    four = overlaps(spark, sf_dir, found).withColumn("place", F.row_number().over(order)).filter("place <= 4")
    again = F.row_number().over(Window.partitionBy("item_id", "sentence").orderBy("place"))
    return four.withColumn("again", again).filter("again = 1").select("item_id", F.col("place").alias("line_no"), "rank", "sentence")


def extractive_answer(spark, sf_dir):
    return findings(spark, sf_dir).select("item_id", "line_no", "rank", F.md5("sentence").alias("digest"))


def number(c):
    return F.format_string("%.4f", c.cast("double"))


def context_of(found: DataFrame) -> DataFrame:
    block = F.concat(F.lit("[Source "), F.col("rank").cast("string"), F.lit("] Document: doc_"), F.col("doc_id").cast("string"), F.lit(".txt (Page 0, Match Score: "), number(F.col("cosine")), F.lit(')\nContent: "'), T.snippet(F.col("passage")), F.lit('"'))
    return found.groupBy("item_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("context"))


def grounded_context(spark, sf_dir):
    return context_of(sources(spark, sf_dir)).select("item_id", F.md5("context").alias("digest"), F.length("context").cast("long").alias("n"))


PROMPT = "Answer from the numbered sources only and cite them as [Source n].\n\nSources:\n"


def rag_prompt(spark, sf_dir):
    asked = context_of(sources(spark, sf_dir)).join(table(spark, sf_dir, "benchmark").select("item_id", "text"), "item_id")
    return asked.select("item_id", F.md5(F.concat(F.lit(PROMPT), F.col("context"), F.lit("\n\nQuestion: "), F.col("text"))).alias("digest"))


def rag_answer(spark, sf_dir):
    """Cited extractive answers: findings (or excerpts of two sources), then the top source; the sources are found once."""
    found = Scratch(spark, "answer").save(sources(spark, sf_dir), "sources")
    line = F.concat(F.lit("• "), F.col("sentence"), F.lit(" [Source "), F.col("rank").cast("string"), F.lit("]"))
    said = findings(spark, sf_dir, found).groupBy("item_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", line.alias("l")))), lambda x: x["l"]), "\n").alias("lines"))
    excerpt = F.concat(F.lit('• "'), T.strip(F.substring("passage", 1, 250)), F.lit('..." [Source '), F.col("rank").cast("string"), F.lit("]"))
    spare = found.filter("rank <= 2").groupBy("item_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", excerpt.alias("l")))), lambda x: x["l"]), "\n").alias("spare"))
    top = found.filter("rank = 1").select("item_id", F.concat(F.lit("Closest text: doc_"), F.col("doc_id").cast("string"), F.lit(".txt, page 0, cosine "), number(F.col("cosine")), F.lit(".")).alias("tail"))
    answer = F.concat(F.lit("What the sources say:\n"), F.coalesce("lines", "spare"), F.lit("\n\nWhere it stands:\n"), F.col("tail"))
    return top.join(spare, "item_id").join(said, "item_id", "left").select("item_id", F.md5(answer).alias("digest"))


_B = r"[ \t\r\n\f]"
_STRIP = "regexp_replace({0}, '^[ \\t\\r\\n\\f]+|[ \\t\\r\\n\\f]+$', '', 'g')"
_W = r"[\p{L}\p{N}_]+"
_TOK = rf"{_B}*(?:[\p{{L}}\p{{N}}_]+|[^ \t\r\n\f\p{{L}}\p{{N}}_])"
_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"
_D = "d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)"


def _windows(keys: str, pages: str) -> str:
    return rf"""tk AS (SELECT {keys}, text, is_last, regexp_extract_all(text, '{_TOK}') AS toks FROM {pages}),
tn AS (SELECT *, len(toks) AS n, CASE WHEN len(toks) <= 96 THEN 1 ELSE CAST(ceil((len(toks) - 96) / 64) AS BIGINT) + 1 END AS c0 FROM tk),
tc AS (SELECT *, CASE WHEN c0 > 1 AND NOT is_last AND n - 64 * (c0 - 1) IN (33, 34) THEN c0 - 1 ELSE c0 END AS c FROM tn),
ch AS (SELECT {keys}, CAST(i AS INTEGER) AS chunk_no, {_STRIP.format("array_to_string(toks[i * 64 + 1:i * 64 + 96], '')")} AS chunk FROM (SELECT *, unnest(range(0, c)) AS i FROM tc WHERE n >= 20)),
chunks AS (SELECT * FROM ch WHERE length(chunk) >= 50 UNION ALL SELECT {keys}, 0, text FROM tc WHERE n < 20 AND is_last AND length(text) >= 40)"""


_DOCCHUNKS = f"{_D}, pg AS (SELECT doc_id, {_STRIP.format('text')} AS text, true AS is_last FROM d), {_windows('doc_id', 'pg')}"
_EMB = rf"""ew AS (SELECT 'd' AS side, doc_id AS id, unnest(regexp_extract_all(lower(coalesce(text, '')), '{_W}')) AS t FROM documents
  UNION ALL SELECT 'q', item_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '{_W}')) FROM benchmark),
eh AS (SELECT side, id, CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) AS h FROM ew),
es AS (SELECT side, id, h % 64 AS d, sum(1 - 2 * ((h // 64) % 2)) AS c FROM eh GROUP BY 1, 2, 3),
en AS (SELECT side, id, sqrt(CAST(sum(c * c) AS DOUBLE)) AS z FROM es GROUP BY 1, 2),
ev AS MATERIALIZED (SELECT side, id, d, CASE WHEN z > 0 THEN CAST(trunc(CAST(c AS DOUBLE) / z * 127) AS INTEGER) ELSE 0 END AS x FROM es JOIN en USING (side, id))"""
_IDS = "ids AS (SELECT 'd' AS side, doc_id AS id FROM documents UNION ALL SELECT 'q', item_id FROM benchmark)"
_SRC = f"""{_D}, {_EMB},
sc AS (SELECT q.id AS item_id, v.id AS doc_id, sum(q.x * v.x) AS score FROM ev q JOIN ev v ON q.side = 'q' AND v.side = 'd' AND q.d = v.d GROUP BY 1, 2),
sa AS (SELECT item_id, doc_id, CAST(coalesce(score, 0) AS BIGINT) AS score FROM (SELECT item_id FROM benchmark) CROSS JOIN (SELECT doc_id FROM documents) LEFT JOIN sc USING (item_id, doc_id)),
sr AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM sa),
qz AS (SELECT id AS item_id, sqrt(CAST(sum(x * x) AS DOUBLE)) AS qn FROM ev WHERE side = 'q' GROUP BY 1),
src AS MATERIALIZED (SELECT item_id, rank, doc_id, score, round(greatest(-1.0, least(1.0, score / (qn * 127))), 4) AS cosine, text AS passage FROM sr JOIN qz USING (item_id) JOIN d USING (doc_id) WHERE rank <= 3)"""
_SNIP = "CASE WHEN length({0}) > 1000 THEN substr(translate({0}, chr(13) || chr(10), '  '), 1, 1000) || '...' ELSE translate({0}, chr(13) || chr(10), '  ') END"


def _sentences(keys: str, source: str, column: str) -> str:
    return rf"""SELECT * FROM (SELECT {keys}, CAST(i - 1 AS INTEGER) AS pos, {_STRIP.format("parts[i]")} AS sentence FROM (SELECT {keys}, parts, unnest(range(1, len(parts) + 1)) AS i
 FROM (SELECT {keys}, string_split(regexp_replace({column}, '([.!?]){_B}+', '\1' || chr(1), 'g'), chr(1)) AS parts FROM {source}))) WHERE length(sentence) >= 20"""


_OVER = rf"""{_SRC}, st AS ({_sentences("item_id, rank, score, cosine", "src", "passage")}),
qt AS (SELECT item_id, list_filter(list_distinct(regexp_extract_all(lower(text), '{_W}')), lambda w: NOT list_contains({_STOP}, w)) AS terms FROM benchmark),
ov AS MATERIALIZED (SELECT * FROM (SELECT st.*, len(list_intersect(list_distinct(regexp_extract_all(lower(sentence), '{_W}')), terms)) AS overlap FROM st JOIN qt USING (item_id)) WHERE overlap > 0)"""
_FIND = f"""{_OVER}, f4 AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY overlap + CASE WHEN score < 2 THEN score ELSE score / 10000 END DESC, rank, pos) AS place FROM ov),
fd AS (SELECT item_id, CAST(place AS INTEGER) AS line_no, rank, sentence FROM (SELECT *, row_number() OVER (PARTITION BY item_id, sentence ORDER BY place) AS again FROM f4 WHERE place <= 4) WHERE again = 1)"""
_CTX = f"""cx AS (SELECT item_id, string_agg('[Source ' || rank || '] Document: doc_' || doc_id || '.txt (Page 0, Match Score: ' || printf('%.4f', cosine) || ')' || chr(10) || 'Content: "' || {_SNIP.format("passage")} || '"', chr(10) || chr(10) ORDER BY rank) AS context FROM src GROUP BY 1)"""

SQL = {
    "text_scan": f"WITH {_D} SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS byte_length, md5(text) AS digest FROM d",
    "chunk_windows": f"WITH {_DOCCHUNKS} SELECT doc_id, chunk_no, CAST(octet_length(encode(chunk)) AS BIGINT) AS byte_length, md5(chunk) AS digest FROM chunks",
    "chunk_length_stats": f"WITH {_DOCCHUNKS} SELECT count(*) AS chunks, round(avg(length(chunk)), 6) AS mean, CAST(min(length(chunk)) AS INTEGER) AS least, CAST(max(length(chunk)) AS INTEGER) AS greatest, CAST(median(length(chunk)) AS DOUBLE) AS median FROM chunks",
    "chunk_pages_carry": rf"""WITH RECURSIVE cp AS (SELECT conv_id, turn, {_STRIP.format("coalesce(text, '')")} AS body FROM conversations),
cq AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, body) AS k, count(*) OVER (PARTITION BY conv_id) AS m FROM cp WHERE body <> ''),
fold AS (SELECT conv_id, 0::BIGINT AS k, 0::BIGINT AS turn, '' AS text, '' AS carry, false AS is_last FROM (SELECT DISTINCT conv_id FROM cq)
 UNION ALL
 SELECT conv_id, k, turn, body2, CASE WHEN k = m THEN '' WHEN len(toks) < 20 THEN body2
   WHEN len(toks) > 96 AND len(toks) - 64 * CAST(ceil((len(toks) - 96) / 64) AS BIGINT) IN (33, 34) THEN {_STRIP.format("array_to_string(toks[64 * CAST(ceil((len(toks) - 96) / 64) AS BIGINT) + 1:], '')")} ELSE '' END, k = m
 FROM (SELECT *, regexp_extract_all(body2, '{_TOK}') AS toks FROM (SELECT f.conv_id, q.k, q.turn, q.m, CASE WHEN f.carry = '' THEN q.body ELSE f.carry || ' ' || q.body END AS body2 FROM fold f JOIN cq q ON q.conv_id = f.conv_id AND q.k = f.k + 1))),
pg AS (SELECT conv_id, turn, text, is_last FROM fold WHERE k > 0), {_windows("conv_id, turn", "pg")}
SELECT conv_id, turn, chunk_no, md5(chunk) AS digest FROM chunks""",
    "passage_snippet": f"WITH {_D} SELECT doc_id, md5({_SNIP.format('text')}) AS digest, CAST(length({_SNIP.format('text')}) AS BIGINT) AS n FROM d",
    "sentence_split": f"WITH {_D} SELECT doc_id, pos, md5(sentence) AS digest FROM ({_sentences('doc_id', 'd', 'text')})",
    "query_terms": f"SELECT item_id, unnest(list_filter(list_distinct(regexp_extract_all(lower(text), '{_W}')), lambda w: NOT list_contains({_STOP}, w))) AS term FROM benchmark",
    "hash_embed": f"WITH {_EMB}, {_IDS} SELECT id AS doc_id, CAST(g AS INTEGER) AS d, coalesce(x, 0) AS x FROM ids CROSS JOIN (SELECT unnest(range(0, 64)) AS g) LEFT JOIN ev ON ev.side = ids.side AND ev.id = ids.id AND ev.d = g WHERE ids.side = 'd'".replace("SELECT id AS", "SELECT ids.id AS"),
    "passage_fetch": f"WITH {_SRC} SELECT item_id, rank, doc_id, score, cosine, 'doc_' || doc_id || '.txt' AS filename, md5({_SNIP.format('passage')}) AS digest FROM src",
    "sentence_overlap": f"WITH {_OVER} SELECT item_id, rank, pos, CAST(overlap AS INTEGER) AS overlap FROM ov",
    "extractive_answer": f"WITH {_FIND} SELECT item_id, line_no, rank, md5(sentence) AS digest FROM fd",
    "grounded_context": f"WITH {_SRC}, {_CTX} SELECT item_id, md5(context) AS digest, CAST(length(context) AS BIGINT) AS n FROM cx",
    "rag_prompt": f"WITH {_SRC}, {_CTX} SELECT item_id, md5('Answer from the numbered sources only and cite them as [Source n].' || chr(10) || chr(10) || 'Sources:' || chr(10) || context || chr(10) || chr(10) || 'Question: ' || text) AS digest FROM cx JOIN benchmark USING (item_id)",
    "rag_answer": f"""WITH {_FIND}, ln AS (SELECT item_id, string_agg('• ' || sentence || ' [Source ' || rank || ']', chr(10) ORDER BY line_no) AS lines FROM fd GROUP BY 1),
sp AS (SELECT item_id, string_agg('• "' || {_STRIP.format("substr(passage, 1, 250)")} || '..." [Source ' || rank || ']', chr(10) ORDER BY rank) AS spare FROM src WHERE rank <= 2 GROUP BY 1)
SELECT item_id, md5('What the sources say:' || chr(10) || coalesce(lines, spare) || chr(10) || chr(10) || 'Where it stands:' || chr(10) || 'Closest text: doc_' || doc_id || '.txt, page 0, cosine ' || printf('%.4f', cosine) || '.') AS digest
FROM src JOIN sp USING (item_id) LEFT JOIN ln USING (item_id) WHERE rank = 1""",
}
QUERIES = {f.__name__: f for f in (text_scan, chunk_windows, chunk_length_stats, chunk_pages_carry, passage_snippet, sentence_split, query_terms, hash_embed, passage_fetch, sentence_overlap, extractive_answer, grounded_context, rag_prompt, rag_answer)}
