"""Retrieval queries: vectors, keywords, fusion, filters, pages, captures and enrichment."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.functions import ranking, vector
from engram.operators import enrich, episodic, filters, keyword_index, search, vector_index
from engram.sources import views
from engram.sources.views import DOC_NOW, EVENT_NOW, with_views
from engram.storage import new_folder

QUERY = "the toxic quality of on and"
START, END = datetime(2024, 1, 10), datetime(2024, 1, 20, 12)


def knn_topk(spark: SparkSession, sf: str) -> DataFrame:
    return search.nearest(views.vectors(spark, sf), views.vector_of(spark, sf)).select("id", "similarity")


def knn_page_offset(spark: SparkSession, sf: str) -> DataFrame:
    return search.nearest(views.vectors(spark, sf), views.vector_of(spark, sf), limit=10, offset=20).select("id", "similarity")


def knn_threshold_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return search.lookup(views.vectors(spark, sf), views.vector_of(spark, sf), 0.1, 3).select("id", "label", "similarity")


def knn_argmax_batch(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.vectors(spark, sf)
    asked = rows.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    return search.lookup_many(rows, asked, 0.1, others_only=True)


def _dated_vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Every vector with a type and a date by its id, and the query set: ids divisible by 20."""
    rows = views.vectors(spark, sf).selectExpr(
        "id", "embedding", "CASE WHEN id % 7 = 0 THEN 'personal_profile' ELSE 'note' END AS type", "timestamp_ntz '2024-01-01 00:00:00' + make_interval(0, 0, 0, CAST(id % 90 AS INT)) AS created_at"
    )
    return rows, rows.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_embedding"))


def ivf_topk(spark: SparkSession, sf: str) -> DataFrame:
    rows, asked = _dated_vectors(spark, sf)
    return vector_index.search(vector_index.build(rows), asked, 10)


def ivf_rerank(spark: SparkSession, sf: str) -> DataFrame:
    rows, asked = _dated_vectors(spark, sf)
    return vector_index.search_ranked(vector_index.build(rows), asked, DOC_NOW, 10)


def ivf_rerank_all_lists(spark: SparkSession, sf: str) -> DataFrame:
    """The same where a query looks into every list and compares every row, so that SQL gives the same rows."""
    rows, asked = _dated_vectors(spark, sf)
    index = vector_index.build(rows)
    return vector_index.search_ranked(index, asked, DOC_NOW, 10, len(index.centres), every=True)


def vector_match(spark: SparkSession, sf: str) -> DataFrame:
    """Every row's nearest other one at or above a similarity, both sides dealt to cells."""
    rows, _ = _dated_vectors(spark, sf)
    asked = rows.select(F.col("id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    return vector_index.match(rows, asked, 0.4, others_only=True)


def list_deep_page(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return filters.deep_page(rows, F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber"), limit=25, offset=5000).select("l_orderkey", "l_linenumber")


def recency_calendar(spark: SparkSession, sf: str) -> DataFrame:
    n = views.notes(spark, sf)
    return n.select("id", F.round(ranking.recency_calendar(F.col("created_at"), F.lit(DOC_NOW).cast("timestamp_ntz"), F.col("type")), 6).alias("recency"))


def recency_elapsed(spark: SparkSession, sf: str) -> DataFrame:
    n = views.captures(spark, sf)
    return n.select("id", F.round(ranking.recency_elapsed(F.col("created_at"), F.lit(EVENT_NOW).cast("timestamp_ntz")), 6).alias("recency"))


def weighted_score(spark: SparkSession, sf: str) -> DataFrame:
    m = views.memory(spark, sf)
    sim = vector.cosine_to(F.col("embedding"), views.vector_of(spark, sf))
    recency = ranking.recency_calendar(F.col("created_at"), F.lit(DOC_NOW).cast("timestamp_ntz"), F.col("type"))
    return m.select("id", F.round(sim, 6).alias("similarity"), F.round(ranking.page_score(sim, recency), 6).alias("score"))


def filter_time_range(spark: SparkSession, sf: str) -> DataFrame:
    c = views.captures(spark, sf)
    return c.where(filters.time_range(F.col("created_at"), EVENT_NOW, START, END)).select("id", "type", "created_at")


def filter_max_age(spark: SparkSession, sf: str) -> DataFrame:
    c = views.captures(spark, sf)
    return c.where(filters.time_range(F.col("created_at"), EVENT_NOW, max_age_days=7)).select("id", "type", "created_at")


def filter_in_notin(spark: SparkSession, sf: str) -> DataFrame:
    return views.captures(spark, sf).where(filters.types_in(F.col("type"), ["click", "view", "error"], "error")).select("id", "type")


def filter_json_path(spark: SparkSession, sf: str) -> DataFrame:
    return views.captures(spark, sf).where(filters.metadata_is(F.col("metadata"), "k", "5")).select("id", "user_id", "type")


def filter_json_null(spark: SparkSession, sf: str) -> DataFrame:
    c = views.captures(spark, sf)
    return c.where(filters.metadata_missing(F.col("metadata"), "overlayTainted") & filters.metadata_not_in(F.col("metadata"), "k", ["1", "2", "3"])).select("id", "metadata")


def filter_like_session(spark: SparkSession, sf: str) -> DataFrame:
    return views.notes(spark, sf).where(filters.session_like(F.col("metadata"), "s7")).select("id", "metadata")


def filter_json_session(spark: SparkSession, sf: str) -> DataFrame:
    return views.notes(spark, sf).where(filters.metadata_is(F.col("metadata"), "sessionId", "s7")).select("id", "metadata")


def entity_ilike_any(spark: SparkSession, sf: str) -> DataFrame:
    return views.entities(spark, sf).where(filters.any_ilike(F.col("entity"), ["TOXIC_1", "ality_0"])).select("memory_id", "type", "entity")


def distinct_entity_ids(spark: SparkSession, sf: str) -> DataFrame:
    return search.named_ids(views.entities(spark, sf), "any toxic! ones")


def list_paged(spark: SparkSession, sf: str) -> DataFrame:
    return filters.sorted_page(views.captures(spark, sf), limit=25, offset=50).select("id", "type", "created_at")


def list_total_hasmore(spark: SparkSession, sf: str) -> DataFrame:
    return filters.page_info(views.captures(spark, sf).where("type = 'click'"), 25, 50)


def multi_key_sort(spark: SparkSession, sf: str) -> DataFrame:
    p = views.table(spark, sf, "part")
    return filters.top(p.select("p_partkey", "p_size", "p_retailprice", "p_brand"), F.desc("p_size"), F.desc("p_retailprice"), F.asc("p_brand"), F.asc("p_partkey"), limit=50)


def conditional_sort_first(spark: SparkSession, sf: str) -> DataFrame:
    c = views.captures(spark, sf)
    return filters.preferred_first(c, F.get_json_object("metadata", "$.k") == "7", F.desc("created_at"), F.asc("id"), limit=5).select("id", "metadata", "created_at")


def recent_capture(spark: SparkSession, sf: str) -> DataFrame:
    now = datetime(2024, 1, 20)
    return episodic.recent(views.captures(spark, sf), now, "5", 86_400, app_key="k").select("id", "metadata", "created_at")


def severity_sort(spark: SparkSession, sf: str) -> DataFrame:
    s = views.table(spark, sf, "supplier").select("s_suppkey", "s_name", F.when(F.col("s_suppkey") % 3 == 0, "soft").otherwise("hard").alias("severity"))
    return s.orderBy(F.desc("severity"), F.asc("s_suppkey"))


def latest_one(spark: SparkSession, sf: str) -> DataFrame:
    return filters.top(views.captures(spark, sf), F.desc("created_at"), F.asc("id"), limit=1).select("id", "created_at")


def session_best(spark: SparkSession, sf: str) -> DataFrame:
    return filters.best_per(views.captures(spark, sf).select("id", "user_id", "value"), "user_id", F.desc("value"), F.asc("id"), limit=3)


def episodic_dedup_hour(spark: SparkSession, sf: str) -> DataFrame:
    out = episodic.dedup_hourly(views.captures(spark, sf), ["k"])
    return out.select("type", "key_k", "hour", "id", "user_id", "created_at", F.col("value").alias("least_value"), "captures")


def episodic_dedup_bm25(spark: SparkSession, sf: str) -> DataFrame:
    n = views.wide(views.notes(spark, sf))
    scores = search.bm25(n, QUERY).withColumn("score", F.round("score", 4))
    out = episodic.search(n.drop("source_text"), ["appName"], scores, limit=40)
    return out.select("type", "key_appName", "hour", "id", "created_at", "captures", "score")


def episodic_raw(spark: SparkSession, sf: str) -> DataFrame:
    c = views.captures(spark, sf).where(filters.metadata_is(F.col("metadata"), "k", "9"))
    return episodic.search(c, ["k"], dedup=False, limit=30).select("id", "type", "created_at")


def bm25_scores(spark: SparkSession, sf: str) -> DataFrame:
    return search.bm25(views.wide(views.notes(spark, sf)), QUERY).select("id", F.round("score", 4).alias("score"))


def _benchmark_queries(spark: SparkSession, sf: str) -> DataFrame:
    return views.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _keyword_index(spark: SparkSession, sf: str) -> keyword_index.KeywordIndex:
    """All notes, in two refreshes: the notes of one type come with a text in the second only."""
    n = views.wide(views.notes(spark, sf)).select("id", "type", "source_text")
    index = keyword_index.KeywordIndex(spark, new_folder(spark, "keywords"), n.schema["id"].dataType)
    index.refresh(n.withColumn("source_text", F.when(F.col("type") != "de", F.col("source_text"))))
    index.refresh(n, n.where("type = 'de' OR type IS NULL"))
    return index


def keyword_index_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The scores of bm25_scores by the kept index."""
    asked = spark.createDataFrame([(0, QUERY)], "query_id long, query string")
    return _keyword_index(spark, sf).scores(asked).select("id", "score")


def keyword_index_best(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best notes of every benchmark item's whole text."""
    return _keyword_index(spark, sf).best(_benchmark_queries(spark, sf), 10)


def bm25_minmax(spark: SparkSession, sf: str) -> DataFrame:
    s = search.bm25(views.wide(views.notes(spark, sf)), QUERY).select("id", F.round("score", 4).alias("score"))
    best = filters.top(s, F.desc("score"), F.asc("id"), limit=75)
    return search.min_max(best).select("id", "score", F.round("scaled", 4).alias("scaled"))


def _hybrid(spark: SparkSession, sf: str, cut: float | None) -> DataFrame:
    return search.hybrid(views.memory(spark, sf), views.entities(spark, sf), QUERY, views.vector_of(spark, sf), DOC_NOW, min_similarity=cut).select("id", "type", "created_at", "similarity", F.round("score", 4).alias("score"))


def hybrid_fusion(spark: SparkSession, sf: str) -> DataFrame:
    return _hybrid(spark, sf, None)


def hybrid_fusion_cut(spark: SparkSession, sf: str) -> DataFrame:
    return _hybrid(spark, sf, 0.2)


def enrich_entities(spark: SparkSession, sf: str) -> DataFrame:
    rows = enrich.with_entities(views.notes(spark, sf).select("id", "type"), views.entities(spark, sf))
    return rows.select("id", "type", F.array_join(F.transform("entities", lambda e: F.concat_ws("=", e["type"], e["entity"])), ",").alias("entities"))


def enrich_page(spark: SparkSession, sf: str) -> DataFrame:
    page = filters.sorted_page(views.notes(spark, sf).select("id", "type", "created_at"), limit=25)
    rows = enrich.with_entities(page, views.entities(spark, sf))
    return rows.select("id", "type", "created_at", F.size("entities").alias("n_entities"))


def health_left_join(spark: SparkSession, sf: str) -> DataFrame:
    health = views.table(spark, sf, "supplier").select(
        F.col("s_name").alias("skill_name"),
        F.when(F.col("s_suppkey") % 4 == 0, "ok").otherwise("failed").alias("status"),
        F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, int(s_suppkey * 7 % 60))").alias("last_checked_at"),
    )
    skills = views.table(spark, sf, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_name").alias("name"), (F.col("s_acctbal") > 0).alias("enabled"))
    return enrich.unhealthy(health, skills)


def semi_delete_entities(spark: SparkSession, sf: str) -> DataFrame:
    gone = views.notes(spark, sf).where("type = 'de'")
    return enrich.rows_of(views.entities(spark, sf), gone).select("memory_id", "type", "entity")


def anti_keep_entities(spark: SparkSession, sf: str) -> DataFrame:
    gone = views.notes(spark, sf).where("type = 'de'")
    return enrich.rows_not_of(views.entities(spark, sf), gone).select("memory_id", "type", "entity")


def anti_migrate(spark: SparkSession, sf: str) -> DataFrame:
    c = views.captures(spark, sf).select("id", "type", "created_at")
    source, target = c, c.where("type = 'click' AND id % 2 = 0")
    left, moved = enrich.move_missing(source, target, F.col("type") == "click")
    return left.withColumn("place", F.lit("memory")).unionByName(moved.withColumn("place", F.lit("episodic")))


def _brand_rules(spark: SparkSession, sf: str) -> DataFrame:
    return views.table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("context_key"), F.col("p_name").alias("rule_text"), F.col("p_size").alias("priority"),
        (F.col("p_partkey") % 5).alias("verified_count"), (F.col("p_partkey") % 3).alias("hit_count"), F.when(F.col("p_partkey") % 7 == 0, "retired").when(F.col("p_partkey") % 2 == 0, "active").alias("status"),
    )


def group_rules_by_key(spark: SparkSession, sf: str) -> DataFrame:
    return enrich.rules_by_key(_brand_rules(spark, sf)).select("context_key", F.array_join("rules", "|").alias("rules"))


def vector_stats(spark: SparkSession, sf: str) -> DataFrame:
    s = vector.statistics(F.col("embedding"))
    return views.vectors(spark, sf).select("id", F.round(s["mean"], 6).alias("mean"), F.round(s["stddev"], 6).alias("stddev"), F.round(s["norm"], 4).alias("norm"), F.round(s["least"], 6).alias("least"), F.round(s["largest"], 6).alias("largest"), s["dims"].cast("long").alias("dims"))


def vector_head(spark: SparkSession, sf: str) -> DataFrame:
    return views.vectors(spark, sf).select("id", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"), F.size(F.slice("embedding", 1, 5)).cast("long").alias("shown"), F.when(F.col("embedding").isNull(), "NULL").otherwise("HAS_EMBEDDING").alias("status"))


def lsh_topk(spark: SparkSession, sf: str) -> DataFrame:
    return search.approximate_nearest(views.vectors(spark, sf).select("id", "embedding"), views.vector_of(spark, sf)).select("id", "similarity")


_TOK = "list_filter(regexp_split_to_array(lower(source_text), '[^a-z]+'), lambda w: w <> '')"
_TERMS = ", ".join(f"('{t}')" for t in search.query_terms(QUERY))
_BM25 = f"""tok AS (SELECT id, {_TOK} AS ws FROM notes),
terms AS (SELECT * FROM (VALUES {_TERMS}) t(term)),
figs AS (SELECT count(*)::DOUBLE AS n, avg(len(ws)) AS avgdl FROM tok),
tf AS (SELECT id, term, len(ws)::DOUBLE AS dl, len(list_filter(ws, lambda w: w = term))::DOUBLE AS tf FROM tok, terms),
df AS (SELECT term, sum(CASE WHEN tf > 0 THEN 1 ELSE 0 END)::DOUBLE AS df FROM tf GROUP BY term),
bm AS (SELECT id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 4) AS score
       FROM tf JOIN df USING (term), figs WHERE tf > 0 GROUP BY id)"""
#: The search runs over rows that have a vector, so its keyword figures do too.
_FUSE = _BM25.replace("FROM notes)", "FROM memory)") + """,
light AS (SELECT id, type, created_at, list_cosine_similarity(embedding, v) AS sim FROM memory, q),
page AS (SELECT * FROM light ORDER BY round(0.7 * sim + 0.3 / (1 + ln(1 + greatest(datediff('day', created_at, TIMESTAMP '2025-03-01'), 0))), 6) DESC, id LIMIT 25),
top AS (SELECT * FROM bm WHERE score > 0 ORDER BY score DESC, id LIMIT 75),
mm AS (SELECT id, CASE WHEN (SELECT max(score) FROM top) > (SELECT min(score) FROM top) THEN (score - (SELECT min(score) FROM top)) / ((SELECT max(score) FROM top) - (SELECT min(score) FROM top)) ELSE 0 END AS scaled FROM top),
named AS (SELECT DISTINCT memory_id AS id FROM entities WHERE entity ILIKE '%the%' OR entity ILIKE '%toxic%' OR entity ILIKE '%quality%' OR entity ILIKE '%and%'),
ids AS (SELECT id FROM page UNION SELECT id FROM mm),
fused AS (SELECT m.id, m.type, m.created_at, round(coalesce(p.sim, 0), 6) AS similarity,
  round(0.5 * coalesce(p.sim, 0) + 0.25 * coalesce(mm.scaled, 0) + 0.15 / (1 + ln(1 + greatest(floor(epoch_us(TIMESTAMP '2025-03-01')::DOUBLE / 86400000000 - epoch_us(m.created_at)::DOUBLE / 86400000000), 0))) + CASE WHEN n.id IS NULL THEN 0 ELSE 0.1 END, 6) AS raw
  FROM ids JOIN memory m USING (id) LEFT JOIN page p USING (id) LEFT JOIN mm USING (id) LEFT JOIN named n USING (id)),
best AS (SELECT * FROM fused ORDER BY raw DESC, id LIMIT 25)
SELECT id, type, created_at, similarity, round(raw, 4) AS score FROM best"""

ORACLES = {
    "knn_topk": with_views("q", rest="SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], v), 6) AS similarity FROM embeddings, q ORDER BY 2 DESC, 1 LIMIT 25"),
    "knn_page_offset": with_views("q", rest="SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], v), 6) AS similarity FROM embeddings, q ORDER BY 2 DESC, 1 LIMIT 10 OFFSET 20"),
    "knn_threshold_lookup": with_views("q", rest="SELECT vec_id AS id, label, round(list_cosine_similarity(embedding::DOUBLE[], v), 6) AS similarity FROM embeddings, q WHERE similarity >= 0.1 ORDER BY 3 DESC, 1 LIMIT 3"),
    "ivf_rerank_all_lists": f"""WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, CASE WHEN vec_id % 7 = 0 THEN 'personal_profile' ELSE 'note' END AS type, DATE '2024-01-01' + CAST(vec_id % 90 AS INT) AS day FROM embeddings),
      p AS (SELECT a.id AS query_id, b.id, b.type, b.day, round(list_cosine_similarity(a.e, b.e), 6) AS similarity FROM v a JOIN v b ON a.id % 20 = 0),
      f AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) <= 40),
      s AS (SELECT query_id, id, similarity, round(0.7 * similarity + 0.3 * CASE WHEN type = 'personal_profile' THEN 1.0::DOUBLE ELSE 1.0::DOUBLE / (1.0 + ln(1.0 + greatest(DATE '{DOC_NOW:%Y-%m-%d}' - day, 0))) END, 8) AS score FROM f)
      SELECT query_id, id, similarity, score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 10""",
    "list_deep_page": "SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 25 OFFSET 5000",
    "vector_match": """WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings),
      p AS (SELECT a.id AS query_id, b.id, round(list_cosine_similarity(a.e, b.e), 6) AS similarity FROM v a JOIN v b ON a.id <> b.id)
      SELECT query_id, id, similarity FROM p WHERE similarity >= 0.4 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) = 1""",
    "knn_argmax_batch": """SELECT query_id, id, similarity FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity,
      row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) DESC, b.vec_id) AS r
      FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id) WHERE r = 1 AND similarity >= 0.1""",
    "recency_calendar": with_views("notes", rest="SELECT id, round(CASE WHEN type = 'personal_profile' THEN 1.0 ELSE 1 / (1 + ln(1 + greatest(datediff('day', created_at, TIMESTAMP '2025-03-01'), 0))) END, 6) AS recency FROM notes"),
    "recency_elapsed": with_views("captures", rest="SELECT id, round(1 / (1 + ln(1 + greatest((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(created_at)) // 86400000000, 0))), 6) AS recency FROM captures"),
    "weighted_score": with_views("notes", "memory", "q", rest="SELECT id, round(list_cosine_similarity(embedding, v), 6) AS similarity, round(0.7 * list_cosine_similarity(embedding, v) + 0.3 / (1 + ln(1 + greatest(datediff('day', created_at, TIMESTAMP '2025-03-01'), 0))), 6) AS score FROM memory, q"),
    "filter_time_range": with_views("captures", rest="SELECT id, type, created_at FROM captures WHERE created_at >= TIMESTAMP '2024-01-10' AND created_at <= TIMESTAMP '2024-01-20 12:00:00'"),
    "filter_max_age": with_views("captures", rest="SELECT id, type, created_at FROM captures WHERE created_at >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY"),
    "filter_in_notin": with_views("captures", rest="SELECT id, type FROM captures WHERE type IN ('click', 'view', 'error') AND type <> 'error' AND type <> 'screen_capture'"),
    "filter_json_path": with_views("captures", rest="SELECT id, user_id, type FROM captures WHERE k = '5'"),
    "filter_json_null": with_views("captures", rest="SELECT id, metadata FROM captures WHERE json_extract_string(metadata, '$.overlayTainted') IS NULL AND k IS NOT NULL AND k NOT IN ('1', '2', '3')"),
    "filter_like_session": with_views("notes", rest="SELECT id, metadata FROM notes WHERE metadata LIKE '%\"sessionId\":\"s7\"%'"),
    "filter_json_session": with_views("notes", rest="SELECT id, metadata FROM notes WHERE json_extract_string(metadata, '$.sessionId') = 's7'"),
    "entity_ilike_any": with_views("entities", rest="SELECT memory_id, type, entity FROM entities WHERE entity ILIKE '%TOXIC_1%' OR entity ILIKE '%ality_0%'"),
    "distinct_entity_ids": with_views("entities", rest="SELECT DISTINCT memory_id AS id FROM entities WHERE entity ILIKE '%any%' OR entity ILIKE '%toxic%' OR entity ILIKE '%ones%'"),
    "list_paged": with_views("captures", rest="SELECT id, type, created_at FROM captures ORDER BY created_at DESC, id LIMIT 25 OFFSET 50"),
    "list_total_hasmore": with_views("captures", rest="SELECT count(*) AS total, 75 < count(*) AS has_more FROM captures WHERE type = 'click'"),
    "multi_key_sort": "SELECT p_partkey, p_size, p_retailprice, p_brand FROM part ORDER BY p_size DESC, p_retailprice DESC, p_brand, p_partkey LIMIT 50",
    "conditional_sort_first": with_views("captures", rest="SELECT id, metadata, created_at FROM captures ORDER BY CASE WHEN k = '7' THEN 0 ELSE 1 END, created_at DESC, id LIMIT 5"),
    "recent_capture": with_views("captures", rest="SELECT id, metadata, created_at FROM captures WHERE created_at >= TIMESTAMP '2024-01-20' - INTERVAL 86400 SECOND ORDER BY CASE WHEN k = '5' THEN 0 ELSE 1 END, created_at DESC, id LIMIT 1"),
    "severity_sort": "SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 3 = 0 THEN 'soft' ELSE 'hard' END AS severity FROM supplier ORDER BY severity DESC, s_suppkey",
    "latest_one": with_views("captures", rest="SELECT id, created_at FROM captures ORDER BY created_at DESC, id LIMIT 1"),
    "session_best": with_views("captures", rest="SELECT id, user_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, id) AS r FROM captures) WHERE r <= 3"),
    "episodic_dedup_hour": with_views("captures", rest="SELECT type, k AS key_k, date_trunc('hour', created_at) AS hour, min(id) AS id, min(user_id) AS user_id, min(created_at) AS created_at, min(value) AS least_value, count(*) AS captures FROM captures GROUP BY type, k, date_trunc('hour', created_at)"),
    "episodic_dedup_bm25": with_views("notes", rest=f""", {_BM25},
      g AS (SELECT type, user_id AS "key_appName", date_trunc('hour', created_at) AS hour, min(id) AS id, min(created_at) AS created_at, count(*) AS captures, max(coalesce(score, 0)) AS score
      FROM notes LEFT JOIN bm USING (id) GROUP BY 1, 2, 3) SELECT * FROM g ORDER BY score DESC, created_at DESC, id LIMIT 40""").replace("\n,", ",", 1),
    "episodic_raw": with_views("captures", rest="SELECT id, type, created_at FROM captures WHERE k = '9' ORDER BY created_at DESC, id LIMIT 30"),
    "keyword_index_scores": with_views("notes", rest=f", {_BM25} SELECT id, score FROM bm").replace("\n,", ",", 1),
    "keyword_index_best": """WITH words AS (SELECT doc_id AS id, w FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z]+')) AS w FROM documents) WHERE w <> ''),
      size AS (SELECT doc_id AS id, coalesce(n, 0)::DOUBLE AS dl FROM documents LEFT JOIN (SELECT id, count(*) AS n FROM words GROUP BY id) s ON s.id = doc_id),
      figs AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM size),
      tf AS (SELECT id, w, count(*)::DOUBLE AS tf FROM words GROUP BY id, w), df AS (SELECT w, count(*)::DOUBLE AS df FROM tf GROUP BY w),
      asked AS (SELECT DISTINCT item_id AS query_id, w FROM (SELECT item_id, unnest(string_split_regex(lower(text), '[^a-z]+')) AS w FROM benchmark) WHERE w <> ''),
      scored AS (SELECT query_id, id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 4) AS score
        FROM asked JOIN df USING (w) JOIN tf USING (w) JOIN size USING (id), figs GROUP BY query_id, id)
      SELECT query_id, id, score FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 10""",
    "bm25_scores": with_views("notes", rest=f", {_BM25} SELECT id, score FROM bm").replace("\n,", ",", 1),
    "bm25_minmax": with_views("notes", rest=f""", {_BM25}, top AS (SELECT * FROM bm ORDER BY score DESC, id LIMIT 75)
      SELECT id, score, round(CASE WHEN max(score) OVER () > min(score) OVER () THEN (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) ELSE 0 END, 4) AS scaled FROM top""").replace("\n,", ",", 1),
    "hybrid_fusion": with_views("notes", "memory", "entities", "q", rest=f", {_FUSE}").replace("\n, tok", ", tok", 1),
    "hybrid_fusion_cut": with_views("notes", "memory", "entities", "q", rest=f", {_FUSE} WHERE similarity >= 0.2").replace("\n, tok", ", tok", 1),
    "enrich_entities": with_views("notes", "entities", rest="SELECT n.id, n.type, coalesce(string_agg(e.type || '=' || e.entity, ',' ORDER BY e.type, e.entity), '') AS entities FROM notes n LEFT JOIN entities e ON e.memory_id = n.id GROUP BY n.id, n.type"),
    "enrich_page": with_views("notes", "entities", rest="SELECT n.id, n.type, n.created_at, CAST((SELECT count(*) FROM entities e WHERE e.memory_id = n.id) AS INTEGER) AS n_entities FROM (SELECT * FROM notes ORDER BY created_at DESC, id LIMIT 25) n"),
    "health_left_join": """WITH h AS (SELECT s_name AS skill_name, CASE WHEN s_suppkey % 4 = 0 THEN 'ok' ELSE 'failed' END AS status, TIMESTAMP '2024-01-01' + to_minutes(CAST(s_suppkey * 7 % 60 AS INTEGER)) AS last_checked_at FROM supplier),
      s AS (SELECT s_name AS name, s_acctbal > 0 AS enabled FROM supplier WHERE s_suppkey % 3 = 0)
      SELECT skill_name, status, last_checked_at, coalesce(enabled, false) AS enabled FROM h LEFT JOIN s ON s.name = h.skill_name WHERE status <> 'ok'""",
    "semi_delete_entities": with_views("notes", "entities", rest="SELECT memory_id, type, entity FROM entities WHERE memory_id IN (SELECT id FROM notes WHERE type = 'de')"),
    "anti_keep_entities": with_views("notes", "entities", rest="SELECT memory_id, type, entity FROM entities WHERE memory_id NOT IN (SELECT id FROM notes WHERE type = 'de')"),
    "anti_migrate": with_views("captures", rest="""SELECT id, type, created_at, 'memory' AS place FROM captures WHERE type <> 'click'
      UNION ALL SELECT id, type, created_at, 'episodic' FROM captures WHERE type = 'click'"""),
    "group_rules_by_key": """SELECT p_brand AS context_key, string_agg(p_name, '|' ORDER BY p_size DESC, p_partkey % 5 DESC, p_partkey % 3 DESC, p_partkey) AS rules FROM part
      WHERE p_partkey % 7 <> 0 GROUP BY p_brand""",
    "vector_stats": """SELECT vec_id AS id, round(list_avg(e), 6) AS mean, round(list_stddev_pop(e), 6) AS stddev, round(sqrt(list_sum(list_transform(e, lambda x: x * x))), 4) AS norm,
      round(list_min(e), 6) AS least, round(list_max(e), 6) AS largest, len(e) AS dims FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)""",
    "vector_head": "SELECT vec_id AS id, round(embedding[1]::DOUBLE, 6) AS first, len(embedding[1:5]) AS shown, CASE WHEN embedding IS NULL THEN 'NULL' ELSE 'HAS_EMBEDDING' END AS status FROM embeddings",
}

QUERIES = {
    f.__name__: f
    for f in (
        knn_topk, knn_page_offset, knn_threshold_lookup, knn_argmax_batch, recency_calendar, recency_elapsed, weighted_score, filter_time_range, filter_max_age, filter_in_notin, filter_json_path,
        filter_json_null, filter_like_session, filter_json_session, entity_ilike_any, distinct_entity_ids, list_paged, list_total_hasmore, multi_key_sort, conditional_sort_first, recent_capture,
        keyword_index_scores, keyword_index_best, severity_sort, latest_one, session_best, episodic_dedup_hour, episodic_dedup_bm25, episodic_raw, bm25_scores, bm25_minmax, hybrid_fusion, hybrid_fusion_cut, enrich_entities, enrich_page,
        health_left_join, semi_delete_entities, anti_keep_entities, anti_migrate, group_rules_by_key, vector_stats, vector_head, lsh_topk, ivf_topk,
        ivf_rerank, ivf_rerank_all_lists, vector_match, list_deep_page,
    )
}
