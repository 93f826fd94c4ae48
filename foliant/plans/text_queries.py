"""Queries over texts, vectors and events, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import enrich as E
from foliant.operators import matching as V
from foliant.operators import pipeline as P
from foliant.operators import textrank as R
from foliant.sources import logs
from foliant.sources.tables import table
from foliant.sources.views import SQL as VIEWS
from foliant.sources.views import Archive
from foliant.streaming import events

QUERIES: dict = {}
SQL: dict[str, str] = {}


def add(name: str, f, sql: str | None = None) -> None:
    QUERIES[name] = f
    if sql:
        SQL[name] = sql


def _docs(spark: SparkSession, data: str) -> DataFrame:
    return table(spark, data, "documents")


def col(name: str, expr, sql: str) -> None:
    """A query that gives one value a document."""
    add(name, lambda s, d: _docs(s, d).select("doc_id", expr(F.col("text")).alias("v")), f"SELECT doc_id, {sql} AS v FROM documents")


_WORDS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')"
col("word_count", T.count_words, f"len({_WORDS})")
_CJK = r"len(regexp_extract_all(text, '[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]'))"
col("estimate_tokens", T.estimate_tokens, f"CASE WHEN {_CJK} > length(text) * 0.1 THEN ceil({_CJK} * 1.5 + (length(text) - {_CJK}) / 4.0) ELSE ceil(length(text) / 4.0) END::INTEGER")
col("estimate_tokens_from_words", lambda c: T.estimate_tokens_from_words(T.count_words(c)), f"round(len({_WORDS}) * 1.3)::INTEGER")
col("clean_up", T.clean_up, r"translate(text, '$€£¥¢%&*+=<>^|~@#\_[]{}', '')")
col("truncate_title", lambda c: T.truncate(c, 40), r"CASE WHEN trim(text) = '' THEN 'Unknown' WHEN length(text) <= 40 THEN text ELSE rtrim(substr(text, 1, 40), E' \t\n\r') END")
col("clean_code_block", lambda c: T.clean_code_block(F.concat(F.lit("```json\n"), c, F.lit("\n```  "))), r"regexp_replace(text, '^\s+|\s+$', '', 'g')")
col("split_sentences", lambda c: F.size(T.split_sentences(c)), r"len(regexp_split_to_array(regexp_replace(text, '([.!?])\s+', E'\\1\x01', 'g'), E'\x01|\n\n'))")
col("sanitize_filename", lambda c: T.sanitize_filename(F.substring(c, 1, 80)), r"translate(translate(substr(text, 1, 80), '/\', '__'), chr(13) || chr(10) || chr(34) || chr(39), '')")
col("truncate_bytes", lambda c: T.truncate_bytes(101)(c), "substr(text, 1, len(list_filter(range(1, least(length(text), 101) + 1), lambda i: octet_length(encode(substr(text, 1, i))) <= 101)))")
col("highlight", lambda c: T.highlight(F.concat(F.lit("<b>"), F.substring(c, 1, 20), F.lit("</b>")), "[", "]"), "'[' || substr(text, 1, 20) || ']'")
col("strip_tags", T.strip_tags, "regexp_replace(text, '<[^>]*>', '', 'g')")
col("sanitize_snippet", T.sanitize_snippet, """replace(replace(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&#34;'), '''', '&#39;'), '&lt;b&gt;', '<b>'), '&lt;/b&gt;', '</b>')""")
col("head_tail_words", lambda c: T.head_tail_words(c, 30, 20), rf"CASE WHEN len({_WORDS}) > 30 THEN array_to_string({_WORDS}[1:30], ' ') || E'\n\n[...]\n\n' || array_to_string({_WORDS}[len({_WORDS}) - least(20, len({_WORDS}) - 30) + 1:], ' ') ELSE array_to_string({_WORDS}, ' ') END")
col("normalize_for_embedding", T.normalize_for_embedding, r"trim(regexp_replace(regexp_replace(text, '[-_]', ' ', 'g'), '\s+', ' ', 'g'))")
col("match_body_bytes", lambda c: T.max_match_body_bytes(T.count_words(c)), f"least(greatest(len({_WORDS}) * 24, 262144), 4194304)")
col("contains_non_latin", T.contains_non_latin, r"regexp_matches(text, '[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}\p{Cyrillic}\p{Greek}\p{Arabic}\p{Hebrew}\p{Devanagari}\p{Thai}\p{Bengali}]')")
add("token_frequencies", lambda s, d: _docs(s, d).select(F.explode(T.lexemes(F.col("text"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")), r"SELECT token, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS token FROM documents) WHERE token <> '' GROUP BY 1")
add("normalize_names", lambda s, d: Archive(s, d).people.select("id", T.normalize_for_db("name").alias("normalized")), "SELECT DISTINCT id, normalized_name AS normalized FROM people")
add("normalize_tags", lambda s, d: Archive(s, d).tag.select("id", T.normalize_tags(F.array("name")).alias("tags")), r"SELECT id, list_filter([trim(regexp_replace(regexp_replace(strip_accents(translate(lower(trim(name)), '-_', '  ')), '[^a-z ]', '', 'g'), ' +', ' ', 'g'))], lambda x: x <> '') AS tags FROM tag")


def filter_tags(spark: SparkSession, data: str) -> DataFrame:
    """Tag names of each live document, filtered against its people, the persons whose names share a word with its tags, all types and its title."""
    a = Archive(spark, data)
    names = a.tag.select(F.col("id").alias("tag_id"), F.get(T.normalize_tags(F.array("name")), F.lit(0)).alias("t"))
    tags = a.document_tag.join(names, "tag_id").filter("t is not null").groupBy("document_id").agg(F.array_sort(F.collect_set("t")).alias("tags"))
    people = a.document_people.join(a.people.select(F.col("id").alias("people_id"), "normalized_name"), "people_id").groupBy("document_id").agg(F.collect_set("normalized_name").alias("people"))
    types = a.document_type.agg(F.collect_set(T.normalize_for_db("name")).alias("types"))  # a small fixed table
    d = a.live.select(F.col("id").alias("document_id"), T.normalize_for_db("title").alias("title"))
    # Only a person all of whose words stand in a tag's reach can bar it: those whose names share a word with it are enough.
    words = lambda c: F.explode(F.split(c, " ")).alias("w")
    everyone = a.people.select(F.col("normalized_name").alias("k")).filter("k is not null").distinct()
    met = tags.select(F.explode("tags").alias("t")).distinct().select("t", words("t")).join(everyone.select("k", words("k")), "w").groupBy("t").agg(F.collect_set("k").alias("ks"))
    known = tags.select("document_id", F.explode("tags").alias("t")).join(met, "t").groupBy("document_id").agg(F.array_distinct(F.flatten(F.collect_set("ks"))).alias("known"))
    x = d.join(tags, "document_id").join(people, "document_id", "left").join(known, "document_id", "left").join(F.broadcast(types), F.lit(True))
    return x.select("document_id", E.filter_tags(F.col("tags"), F.col("people"), F.col("known"), F.col("title"), F.col("types")).alias("tags"))


_NORM = r"trim(regexp_replace(regexp_replace(strip_accents(translate(lower(trim({})), '-_', '  ')), '[^a-z ]', '', 'g'), ' +', ' ', 'g'))"
_TOKS = "list_filter(string_split({}, ' '), lambda x: x <> '')"
add(
    "filter_tags",
    filter_tags,
    VIEWS
    + f""", t AS (SELECT DISTINCT dt.document_id, {_NORM.format("g.name")} AS t FROM document_tag dt JOIN tag g ON g.id = dt.tag_id),
own AS (SELECT dp.document_id, flatten(list({_TOKS.format("p.normalized_name")})) AS ws FROM document_people dp JOIN persons p ON p.id = dp.people_id GROUP BY 1),
kinds AS (SELECT flatten(list({_TOKS.format(_NORM.format("name"))})) AS ws FROM document_type),
k AS (SELECT DISTINCT {_TOKS.format("normalized_name")} AS ws FROM persons WHERE normalized_name <> ''),
x AS (SELECT t.document_id, t.t, {_TOKS.format("t.t")} AS ws, coalesce(own.ws, []) AS people, {_TOKS.format(_NORM.format("coalesce(l.title, '')"))} AS title FROM t JOIN live l ON l.id = t.document_id LEFT JOIN own ON own.document_id = t.document_id WHERE t.t <> ''),
kept AS (SELECT document_id, t FROM x, kinds WHERE len(x.ws) BETWEEN 1 AND 3 AND NOT list_has_any(x.ws, people) AND NOT list_has_any(x.ws, kinds.ws) AND NOT list_has_all(title, x.ws)
AND NOT (len(x.ws) >= 2 AND EXISTS (SELECT 1 FROM k WHERE list_has_all(k.ws, x.ws))))
SELECT d.document_id, coalesce((SELECT list(t ORDER BY t)[1:5] FROM kept WHERE kept.document_id = d.document_id), []) AS tags FROM (SELECT DISTINCT document_id FROM x) d""",
)

_TI = r"SELECT doc_id, token, n, sum(n) OVER (PARTITION BY doc_id) AS size FROM (SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS token FROM documents) WHERE token <> '' GROUP BY ALL)"
add("tf_idf_best", lambda s, d: R.tf_idf(_docs(s, d), "doc_id", "text").groupBy("doc_id").agg(F.max("score").alias("score")), f"SELECT doc_id, round(max(n / size * ln(((SELECT count(*) FROM documents) + 1) / (df + 1))), 8) AS score FROM ({_TI}) t JOIN (SELECT token, count(*) AS df FROM ({_TI}) GROUP BY 1) USING (token) GROUP BY 1")


def tags_suggested(spark: SparkSession, data: str) -> DataFrame:
    """Tags for each live document, from the tag table by the vectors of names and titles; all names where none is near enough."""
    a = Archive(spark, data)
    names = a.tag.select("name").distinct()
    tags = V.encode(names, "name", V.hashed_encoder(64), "name").select(F.col("name").alias("t"), F.col("embedding").alias("v"))
    docs = V.encode(a.live.filter("title is not null"), "title", V.hashed_encoder(64)).select(F.col("id").alias("q"), F.col("embedding").alias("v"))
    return P.suggestions(a.live.select("id"), V.similar(docs, tags, 0.4, 5), names)


add("tags_suggested", tags_suggested)
add("textrank_chunks", lambda s, d: R.chunk_rows(_docs(s, d), "doc_id", "text"))
add("textrank_reduce", lambda s, d: R.reduce(_docs(s, d), "doc_id", "text", -4))
add("analyze_documents", lambda s, d: E.analyze(R.reduce(_docs(s, d), "doc_id", "text", 2000), "doc_id", "text"))


def _centroids(s: SparkSession, d: str) -> DataFrame:
    """A tag vector for each label: the mean of its vectors."""
    return V.mean_pool(table(s, d, "embeddings"), "label", "embedding", 64)


def tag_match_topn(s: SparkSession, d: str) -> DataFrame:
    return V.similar(table(s, d, "embeddings").selectExpr("vec_id as q", "embedding as v"), _centroids(s, d).selectExpr("label as t", "embedding as v"), 0.02, 3)


def tag_consolidate(s: SparkSession, d: str) -> DataFrame:
    q = table(s, d, "embeddings").selectExpr("vec_id as q", "embedding as v", "cast(vec_id as string) as name")
    return V.consolidate(q, _centroids(s, d).selectExpr("concat('label ', label) as t", "embedding as v"), 0.03).select("q", "result")


_CENTROIDS = "SELECT label, list(v ORDER BY i) AS c FROM (SELECT label, i, round(avg(v), 6) AS v FROM (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL) GROUP BY label"
_SIM = f"SELECT e.vec_id AS q, l.label AS t, round(list_dot_product(e.embedding::DOUBLE[], l.c), 6) AS similarity FROM embeddings e, ({_CENTROIDS}) l"
add("tag_match_topn", tag_match_topn, f"SELECT q, t, similarity FROM ({_SIM}) WHERE similarity >= 0.02 QUALIFY row_number() OVER (PARTITION BY q ORDER BY similarity DESC, t) <= 3")
add("tag_consolidate", tag_consolidate, f"SELECT v.vec_id AS q, coalesce('label ' || x.t, v.vec_id::VARCHAR) AS result FROM embeddings v LEFT JOIN (SELECT q, t FROM ({_SIM}) WHERE similarity >= 0.03 QUALIFY row_number() OVER (PARTITION BY q ORDER BY similarity DESC, t::VARCHAR) = 1) x ON x.q = v.vec_id")
add("mean_pool", lambda s, d: V.mean_pool(table(s, d, "embeddings"), "label", "embedding", 64).select("label", F.posexplode("embedding").alias("i", "v")), "SELECT label, i - 1 AS i, round(avg(v), 6) AS v FROM (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL")
add("encode_tags", lambda s, d: V.encode(Archive(s, d).tag, "name", V.hashed_encoder(16)))


def log_lines(s: SparkSession, d: str) -> DataFrame:
    """The events as a log: every third one starts an entry."""
    e = table(s, d, "events")
    line = F.when(F.col("event_id") % 3 == 0, F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "event_type")).otherwise(F.concat(F.lit("  at "), "event_type"))
    return e.select(F.concat(F.lit("log"), F.col("user_id") % 50).alias("file"), F.col("event_id").alias("pos"), line.alias("line"))


add("log_merge", lambda s, d: logs.merge(log_lines(s, d)), r"""WITH l AS (SELECT 'log' || (user_id % 50) AS file, event_id AS pos, CASE WHEN event_id % 3 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || event_type ELSE '  at ' || event_type END AS line, event_id % 3 = 0 AS start FROM events),
e AS (SELECT *, sum(start::INT) OVER (PARTITION BY file ORDER BY pos) AS entry FROM l) SELECT file, entry::BIGINT AS entry, string_agg(line, E'\n' ORDER BY pos) AS text FROM e WHERE entry > 0 GROUP BY file, entry""")
add("events_hourly", lambda s, d: events.hourly(table(s, d, "events")), "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
