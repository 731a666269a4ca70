"""Changes, rules, text, folds, streams and statistics as queries."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.functions import embedding, text
from engram.operators import folds, kept_embeddings, mutate, rules, upkeep
from engram.sources import views
from engram.sources.views import EVENT_NOW, with_views
from engram.storage import materialize, new_folder
from engram.streaming import captures as stream

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query, with the SQL that gives the same rows where there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- changes -------------------------------------------------------------------------------------


@query("""SELECT user_id, event_id AS id, event_type, ts AS updated_at FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, ts DESC, event_id DESC) AS r
  FROM (SELECT *, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS n FROM events)) WHERE r = 1""")
def upsert_latest_wins(spark: SparkSession, sf: str) -> DataFrame:
    e = views.table(spark, sf, "events").select("user_id", F.col("event_id").alias("id"), "event_type", F.col("ts").alias("updated_at"))
    return mutate.latest_wins(e.where("id % 2 = 1"), e.where("id % 2 = 0"), "user_id")


@query("""WITH k AS (SELECT doc_id, lower(trim(text)) AS t, lang FROM documents), b AS (SELECT * FROM k WHERE doc_id % 3 = 0), c AS (SELECT * FROM k WHERE doc_id % 3 <> 0)
  SELECT doc_id AS id, lang FROM b UNION ALL SELECT min(doc_id), lang FROM c WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.t = c.t AND b.lang = c.lang) GROUP BY t, lang""")
def upsert_skip_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    d = views.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.xxhash64(F.lower(F.trim("text"))).alias("h"), "lang")
    return mutate.insert_new(d.where("id % 3 = 0"), d.where("id % 3 <> 0"), [F.col("h"), F.col("lang")]).select("id", "lang")


@query("""WITH c AS (SELECT p_brand AS b, trim(p_name) AS t, p_partkey AS i FROM part) SELECT 'site' AS context_type, lower(trim(b)) AS context_key, t AS rule_text, min(i) AS id FROM c GROUP BY 2, 3""")
def upsert_context_rules(spark: SparkSession, sf: str) -> DataFrame:
    p = views.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.lit("host").alias("context_type"), F.concat(F.lit(" "), F.upper("p_brand")).alias("context_key"), F.concat("p_name", F.lit(" ")).alias("rule_text"))
    return mutate.upsert_context_rules(p.limit(0), p).select("context_type", "context_key", "rule_text", "id")


@query("""WITH k AS (SELECT c_custkey AS id, lower(trim(c_mktsegment)) AS key, c_name AS value_ref FROM customer)
  SELECT key, max(id) AS id FROM k GROUP BY key""")
def upsert_profile(spark: SparkSession, sf: str) -> DataFrame:
    c = views.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit(" "), "c_mktsegment").alias("key"), F.col("c_name").alias("value_ref"), F.lit(EVENT_NOW).cast("timestamp_ntz").alias("updated_at"))
    return mutate.upsert_profile(c.limit(0), c).select("key", "id")


@query("""WITH b AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 2 = 0), c AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 2 = 1),
  m AS (SELECT c.id AS change_id, b.id, round(list_cosine_similarity(b.v, c.v), 6) AS s FROM b, c), n AS (SELECT *, row_number() OVER (PARTITION BY change_id ORDER BY s DESC, id) AS r FROM m WHERE s >= 0.25),
  i AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, change_id DESC) AS r2 FROM n WHERE r = 1)
  SELECT b.id, coalesce('prompt ' || i.change_id, 'prompt ' || b.id) AS prompt_text FROM b LEFT JOIN i ON i.id = b.id AND i.r2 = 1
  UNION ALL SELECT c.id, 'prompt ' || c.id FROM c WHERE c.id NOT IN (SELECT change_id FROM n WHERE r = 1)""")
def semantic_dedup_upsert(spark: SparkSession, sf: str) -> DataFrame:
    p = views.vectors(spark, sf).select("id", F.lit("a,b").alias("tags"), F.concat(F.lit("prompt "), "id").alias("prompt_text"), "embedding", F.lit(EVENT_NOW).cast("timestamp_ntz").alias("updated_at"))
    return mutate.upsert_prompts(p.where("id % 2 = 0"), p.where("id % 2 = 1"), 0.25).select("id", "prompt_text")


@query("""WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, CASE label % 3 WHEN 0 THEN 'web_search' WHEN 1 THEN 'memory_store' ELSE 'nonsense' END AS i FROM embeddings),
  m AS (SELECT c.id, b.i AS stored, row_number() OVER (PARTITION BY c.id ORDER BY round(list_cosine_similarity(b.v, c.v), 6) DESC, b.id) AS r FROM v b, v c
        WHERE b.id % 2 = 0 AND c.id % 2 = 1 AND c.i <> 'nonsense' AND round(list_cosine_similarity(b.v, c.v), 6) >= 0.25)
  SELECT id, i AS correct_intent FROM v WHERE id % 2 = 0
  UNION ALL SELECT v.id, v.i FROM v LEFT JOIN m ON m.id = v.id AND m.r = 1 WHERE v.id % 2 = 1 AND v.i <> 'nonsense' AND (stored IS NULL OR stored <> v.i)""")
def semantic_intent_upsert(spark: SparkSession, sf: str) -> DataFrame:
    intent = F.when(F.col("label") % 3 == 0, "web_search").when(F.col("label") % 3 == 1, "memory_store").otherwise("nonsense")
    p = views.vectors(spark, sf).select("id", "embedding", intent.alias("correct_intent"))
    return mutate.upsert_intents(p.where("id % 2 = 0"), p.where("id % 2 = 1"), 0.25).select("id", "correct_intent")


@query("SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 5 = 0 THEN 'patched' ELSE c_mktsegment END AS segment, c_acctbal AS balance FROM customer")
def patch_update(spark: SparkSession, sf: str) -> DataFrame:
    c = views.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    changes = c.where("id % 5 = 0").select("id", F.lit("patched").alias("segment"), F.lit(0.0).alias("balance"))
    return mutate.patch(c, changes, "id", ["segment"])


@query("SELECT c_custkey AS id, CAST(c_custkey % 4 + coalesce(n, 0) AS BIGINT) AS hit_count FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def hit_count_apply(spark: SparkSession, sf: str) -> DataFrame:
    base = views.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 4).alias("hit_count"))
    return mutate.add_hits(base, views.table(spark, sf, "orders").select(F.col("o_custkey").alias("id"))).select("id", F.col("hit_count").cast("long").alias("hit_count"))


@query("SELECT s_suppkey AS id, s_name AS name, s_suppkey % 6 <> 0 AS enabled FROM supplier WHERE s_suppkey % 10 <> 0")
def flag_and_delete(spark: SparkSession, sf: str) -> DataFrame:
    s = views.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit(True).alias("enabled"))
    return mutate.delete_where(mutate.set_where(s, F.col("id") % 6 == 0, "enabled", F.lit(False)), F.col("id") % 10 == 0)


@query(with_views("notes", "entities", rest="""SELECT 'memory' AS place, id, '' AS entity FROM notes WHERE NOT (user_id = 'src3' AND type = 'en')
  UNION ALL SELECT 'entity', memory_id, entity FROM entities WHERE memory_id NOT IN (SELECT id FROM notes WHERE user_id = 'src3' AND type = 'en')"""))
def delete_cascade(spark: SparkSession, sf: str) -> DataFrame:
    n = views.notes(spark, sf).drop("source_text")
    base, ents, _ = mutate.delete_memories(n, views.entities(spark, sf), n.where("type = 'en'"), "src3")
    return base.select(F.lit("memory").alias("place"), "id", F.lit("").alias("entity")).unionByName(ents.select(F.lit("entity").alias("place"), F.col("memory_id").alias("id"), "entity"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 8 = 0 THEN 'cancelled' ELSE 'running' END AS status FROM orders ORDER BY id DESC LIMIT 100""")
def task_list(spark: SparkSession, sf: str) -> DataFrame:
    o = views.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.lit(None).cast("timestamp_ntz").alias("completed_at"))
    made = mutate.create_tasks(o.limit(0).withColumns({"status": F.lit(""), "started_at": F.lit(EVENT_NOW).cast("timestamp_ntz")}), o, EVENT_NOW)
    done = mutate.set_where(made, F.col("id") % 8 == 0, "status", F.lit("cancelled"))
    return done.orderBy(F.desc("started_at"), F.desc("id")).limit(100).select("id", "status")


@query()
def ingest_memories(spark: SparkSession, sf: str) -> DataFrame:
    d = views.table(spark, sf, "documents").select(
        F.col("source").alias("user_id"), F.col("text"), F.lit(None).cast("string").alias("type"),
        F.array(F.struct(F.lit("SOURCE").alias("type"), F.col("source").alias("value"), F.lit(None).cast("string").alias("entity_type"), F.lit(None).cast("string").alias("normalized"))).alias("entities"),
        F.lit('{"a":1}').alias("metadata"), F.lit(None).cast("string").alias("screenshot"), F.lit(None).cast("string").alias("extracted_text"),
    )
    memories, ents, refused = mutate.ingest(d, embedding.embedder(), EVENT_NOW)
    n = ents.groupBy("memory_id").agg(F.count("*").alias("n_entities"))
    stored = memories.join(n, memories.id == n.memory_id, "left").select("id", "user_id", "type", F.size("embedding").alias("dims"), "n_entities", F.lit(None).cast("string").alias("error"))
    return stored.unionByName(refused.select(F.lit(None).cast("string").alias("id"), "user_id", "type", F.lit(None).cast("int").alias("dims"), F.lit(None).cast("long").alias("n_entities"), "error"))


# --- retention, health, statistics ------------------------------------------------------------------


@query("SELECT min(o_orderdate) AS oldest, max(o_orderdate) AS newest, count(*) AS total, CAST((epoch_us(max(o_orderdate)) - epoch_us(min(o_orderdate))) // 86400000000 AS BIGINT) AS days FROM orders")
def retention_span(spark: SparkSession, sf: str) -> DataFrame:
    return upkeep.span(views.table(spark, sf, "orders"), "o_orderdate")


@query("""WITH c AS (SELECT min(o_orderdate) + INTERVAL 365 DAY AS edge FROM orders) SELECT 'memory' AS place, o_orderkey AS id, CAST(0 AS INTEGER) AS line FROM orders, c WHERE o_orderdate >= edge
  UNION ALL SELECT 'entity', l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders, c WHERE o_orderdate < edge)""")
def retention_purge(spark: SparkSession, sf: str) -> DataFrame:
    o = views.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"))
    items = views.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("memory_id"), "l_linenumber")
    kept, left = upkeep.retain(o, items)
    return kept.select(F.lit("memory").alias("place"), "id", F.lit(0).alias("line")).unionByName(left.select(F.lit("entity").alias("place"), F.col("memory_id").alias("id"), F.col("l_linenumber").alias("line")))


@query("""WITH m AS (SELECT d.doc_id, e.embedding IS NOT NULL AS h FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id)
  SELECT count(*) AS total, count(*) FILTER (h) AS with_embedding, count(*) FILTER (NOT h) AS without_embedding, count(*) FILTER (doc_id % 2 = 0) AS last_hour, round(100.0 * count(*) FILTER (h) / count(*), 1) AS coverage FROM m""")
def embedding_coverage(spark: SparkSession, sf: str) -> DataFrame:
    d = views.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 2 == 0, F.lit(EVENT_NOW)).otherwise(F.lit(datetime(2024, 1, 1))).cast("timestamp_ntz").alias("created_at"))
    return upkeep.embedding_health(d.join(views.vectors(spark, sf).select("id", "embedding"), "id", "left"), EVENT_NOW)


@query("""WITH s AS (SELECT event_type, list_sort(list(value)) AS v FROM events GROUP BY 1)
  SELECT event_type, v[CAST(ceil(0.5 * len(v)) AS INT)] AS p50, v[CAST(ceil(0.95 * len(v)) AS INT)] AS p95, v[CAST(ceil(0.99 * len(v)) AS INT)] AS p99 FROM s""")
def percentile_nearest_rank(spark: SparkSession, sf: str) -> DataFrame:
    return upkeep.nearest_rank(views.table(spark, sf, "events"), "value", 0.5, 0.95, 0.99, by="event_type")


@query("SELECT event_type AS action, count(*) AS requests, count(*) FILTER (value > 50) AS errors, round(avg(value), 4) AS mean_millis, round(sum(value), 2) AS total_millis FROM events GROUP BY 1")
def request_metrics(spark: SparkSession, sf: str) -> DataFrame:
    e = views.table(spark, sf, "events").select(F.col("event_type").alias("action"), F.col("value").alias("millis"), (F.col("value") > 50).alias("failed"))
    return upkeep.request_statistics(e).select("action", "requests", "errors", F.round("mean_millis", 4).alias("mean_millis"), F.round("total_millis", 2).alias("total_millis"))


@query("SELECT count(*) FILTER (event_type = 'view') AS hits, count(*) AS lookups, count(*) FILTER (event_type = 'view') / count(*) AS rate FROM events")
def cache_hit_rate(spark: SparkSession, sf: str) -> DataFrame:
    return upkeep.hit_rate(views.table(spark, sf, "events"), F.col("event_type") == "view")


# --- rules ---------------------------------------------------------------------------------------

_STOP = ", ".join(f"'{w}'" for w in rules.STOP_WORDS)
_WORDS = f"list_filter(regexp_split_to_array(lower({{}}), '[^A-Za-z0-9_]+'), lambda w: length(w) > 2 AND w NOT IN ({_STOP}))"
_CONSTRAINTS = """c AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'global' ELSE 'mail' END AS scope, 'never delete account number ' || s_suppkey AS rule,
  CASE s_suppkey % 5 WHEN 0 THEN ['signup.*'] WHEN 1 THEN ['mail.send', 'file.*'] ELSE ['none.x'] END AS blocks, CASE WHEN s_suppkey % 3 = 0 THEN 'soft' ELSE 'hard' END AS severity,
  CASE WHEN s_suppkey % 4 = 0 THEN sha256('1234') END AS pin FROM supplier)"""


def _constraints(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    return views.table(spark, sf, "supplier").select(
        k.alias("id"), F.when(k % 2 == 0, "global").otherwise("mail").alias("scope"), F.concat(F.lit("never delete account number "), k).alias("rule"),
        F.when(k % 5 == 0, '["signup.*"]').when(k % 5 == 1, '["mail.send", "file.*"]').otherwise('["none.x"]').alias("blocks"),
        F.when(k % 3 == 0, "soft").otherwise("hard").alias("severity"), F.when(k % 4 == 0, F.sha2(F.lit("1234"), 256)).alias("override_pin"),
    )


def _requests(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(1, "mail", ["Signup.start"], None, None), (2, "global", ["file.write"], None, "1234"), (3, "mail", [], "please delete files", " 1234 "), (4, "other", ["nothing"], "hello there", None)],
        "request_id long, scope string, actions array<string>, message string, pin string",
    )


@query(f"""WITH {_CONSTRAINTS}, r AS (SELECT * FROM (VALUES (1, 'mail', ['Signup.start'], '', NULL), (2, 'global', ['file.write'], '', '1234'), (3, 'mail', [], 'please delete files', '1234'), (4, 'other', ['nothing'], 'hello there', NULL)) t(request_id, scope, actions, message, given)),
  h AS (SELECT r.request_id, c.*, c.pin IS NOT NULL AND given IS NOT NULL AND c.pin = sha256(given) AND severity = 'hard' AS unlocked FROM r JOIN c ON c.scope IN ('global', r.scope)
    WHERE len(list_filter(blocks, lambda b: len(list_filter(actions, lambda a: regexp_matches(a, '(?i)^' || replace(replace(b, '.', '\\.'), '*', '.*') || '$'))) > 0)) > 0
      OR len(list_intersect({_WORDS.format('rule')}, {_WORDS.format('message')})) > 0)
  SELECT CAST(r.request_id AS BIGINT) AS request_id, count(*) FILTER (severity = 'hard' AND NOT unlocked) > 0 AS blocked, coalesce(string_agg(rule, '|' ORDER BY rule) FILTER (severity = 'hard' AND NOT unlocked), '') AS hard_blocks,
    coalesce(string_agg(rule, '|' ORDER BY rule) FILTER (severity = 'hard' AND NOT unlocked AND pin IS NOT NULL), '') AS pin_protected, coalesce(string_agg(rule, '|' ORDER BY rule) FILTER (severity = 'soft'), '') AS soft_warnings
  FROM r LEFT JOIN h USING (request_id) GROUP BY 1""")
def constraint_check(spark: SparkSession, sf: str) -> DataFrame:
    out = rules.check_constraints(_constraints(spark, sf), _requests(spark))
    return out.select("request_id", "blocked", *(F.array_join(c, "|").alias(c) for c in ("hard_blocks", "pin_protected", "soft_warnings")))


_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query(f"""WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN 'global' ELSE c_mktsegment END AS scope, c_custkey % 3 AS kind, CASE WHEN c_custkey % 5 = 0 THEN 'soft' ELSE 'hard' END AS severity, c_custkey % 7 = 0 AS pin FROM customer),
  r AS (SELECT o_orderkey AS request_id, o_custkey AS k, list_extract({list(_SEGMENTS)}, CAST(o_orderkey % 6 + 1 AS INTEGER)) AS scope, o_orderkey % 2 = 0 AS says, o_orderkey % 3 = 0 AS pin FROM orders),
  near AS (SELECT r.request_id, c.* EXCLUDE (scope), c.pin AND r.pin AND severity = 'hard' AS unlocked FROM r JOIN c ON r.k // 10 = c.k // 10
    WHERE (r.scope IS NULL OR c.scope IN ('global', r.scope)) AND (c.kind = 0 OR (c.k = r.k AND (c.kind = 1 OR r.says))))
  SELECT request_id, coalesce(bool_or(severity = 'hard' AND NOT unlocked), false) AS blocked, CAST(count(*) FILTER (severity = 'hard' AND NOT unlocked) AS INTEGER) AS n_hard,
    CAST(count(*) FILTER (severity = 'hard' AND NOT unlocked AND near.pin) AS INTEGER) AS n_pin, CAST(count(*) FILTER (severity = 'soft') AS INTEGER) AS n_soft FROM r LEFT JOIN near USING (request_id) GROUP BY 1""")
def constraint_check_orders(spark: SparkSession, sf: str) -> DataFrame:
    """A rule for each customer, a request for each order: globs by their start and by their end, words, a scope or none."""
    k, o = F.col("c_custkey"), F.col("o_orderkey")
    text = lambda form, *c: F.format_string(form, *c)
    held = views.table(spark, sf, "customer").select(
        k.alias("id"), F.when(k % 4 == 0, "global").otherwise(F.col("c_mktsegment")).alias("scope"), F.concat(F.lit("never sell to "), F.col("c_name")).alias("rule"),
        F.when(k % 3 == 0, text('["order.%d.*"]', F.floor(k / 10))).when(k % 3 == 1, text('["none.x", "*.%d"]', k)).otherwise('["none.y"]').alias("blocks"),
        F.when(k % 5 == 0, "soft").otherwise("hard").alias("severity"), F.when(k % 7 == 0, F.sha2(F.lit("1234"), 256)).alias("override_pin"),
    )
    asked = views.table(spark, sf, "orders").select(
        o.alias("request_id"), F.get(F.array(*(F.lit(x) for x in _SEGMENTS)), o % 6).alias("scope"), F.array(text("ORDER.%d.%d", F.floor(F.col("o_custkey") / 10), F.col("o_custkey"))).alias("actions"),
        F.when(o % 2 == 0, text("pay for %09d now", F.col("o_custkey"))).alias("message"), F.when(o % 3 == 0, " 1234 ").alias("pin"),
    )
    out = rules.check_constraints(held, asked)
    return out.select("request_id", "blocked", *(F.size(c).alias(n) for n, c in (("n_hard", "hard_blocks"), ("n_pin", "pin_protected"), ("n_soft", "soft_warnings"))))


@query("""SELECT p_partkey AS id, p_type, regexp_matches(p_type, '(?i)^standard.*tin$') OR regexp_matches(p_type, '(?i)^.*\\.x$') OR regexp_matches(p_type, '(?i)^PROMO.*$') AS matched FROM part""")
def glob_match(spark: SparkSession, sf: str) -> DataFrame:
    globs = F.array(F.lit("standard*tin"), F.lit("*.x"), F.lit("PROMO*"))
    return views.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_type", rules.any_glob(globs, F.array("p_type")).alias("matched"))


@query(f"SELECT doc_id AS id, len(list_intersect({_WORDS.format('text')}, {_WORDS.format(chr(39) + 'the and idiot tion que with account' + chr(39))})) > 0 AS overlaps FROM documents")
def token_overlap(spark: SparkSession, sf: str) -> DataFrame:
    d = views.wide(views.table(spark, sf, "documents"))
    return d.select(F.col("doc_id").alias("id"), F.arrays_overlap(rules.content_words(F.col("text")), rules.content_words(F.lit("the and idiot tion que with account"))).alias("overlaps"))


@query("SELECT c_custkey AS id, sha256(trim(upper(c_name || ' '))) AS pin FROM customer")
def pin_hash(spark: SparkSession, sf: str) -> DataFrame:
    return views.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), rules.pin_hash(F.concat("c_name", F.lit(" "))).alias("pin"))


_PROBES = ("what did I say first?", "what topics did we discuss?", "summarize our conversation", "what is the weather", "as you mentioned, the plan", "you said that earlier? you told me before", "it was what we wanted", "our plans", "tell me about things we discussed", "go back to what you had")


def _any(names: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"regexp_matches(t, '{p}')" for n in names for p in rules.CASCADE_PATTERNS[n]) + ")"


_TRIED = " ".join(f"WHEN {' AND '.join(_any((n,)) for n in ((name, 'pronoun') if name == 'anaphora' else (name,)))} THEN ['{kind}', '{sure}', '{rules.REASONS[name]}']" for name, kind, sure in rules.WITHIN[:-1])


@query(f"""WITH p AS (SELECT * FROM (VALUES {", ".join(f"('{p}')" for p in _PROBES)}) v(probe)), x AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'
  UNION ALL SELECT -row_number() OVER (ORDER BY probe), h, probe FROM p, (VALUES (0), (1)) w(h)),
  y AS (SELECT *, lower(text) AS t, turn > 0 AS ctx FROM x), z AS (SELECT *, CASE WHEN ctx THEN CASE {_TRIED} ELSE ['GENERAL', '0.5', '{rules.REASONS["none"]}'] END
    ELSE CASE WHEN {_any(("discourse",))} OR ({_any(("pronoun",))} AND {_any(("temporal",))}) THEN ['POSITIONAL', '0.7', '{rules.REASONS["strong"]}'] ELSE ['GENERAL', '0.95', '{rules.REASONS["alone"]}'] END END AS r FROM y)
  SELECT text, ctx AS has_context, r[1] AS classification, CAST(r[2] AS DOUBLE) AS confidence, r[1] <> 'GENERAL' AS is_conversational, r[3] AS reasoning FROM z""")
def classify_conversational(spark: SparkSession, sf: str) -> DataFrame:
    turns = views.table(spark, sf, "conversations").where("role = 'user'").select("text", (F.col("turn") > 0).alias("has_context"))
    probes = spark.createDataFrame([(p, c) for p in _PROBES for c in (False, True)], "text string, has_context boolean")
    both = turns.unionByName(probes)
    return both.select("text", "has_context", *(c.alias(k) for k, c in rules.classify_query(F.col("text"), F.col("has_context")).items()))


_CONTRACT = "'---' || chr(10) || 'name: ' || n || chr(10) || 'description: \"d ' || i || '\"' || chr(10) || 'exec_path: ' || p || chr(10) || 'exec_type: ' || x || chr(10) || '---' || chr(10) || b"


@query("""WITH k AS (SELECT p_partkey AS i FROM part), f AS (SELECT i, CASE WHEN i % 5 = 0 THEN 'Bad Name' ELSE 'tool.n' || i END AS n, CASE i % 4 WHEN 0 THEN 'node' WHEN 1 THEN 'shell' WHEN 2 THEN 'python' ELSE 'perl' END AS x,
  CASE WHEN i % 7 = 0 THEN '/etc/a.sh' WHEN i % 4 = 2 THEN '~/skills/a.py' WHEN i % 11 = 0 THEN '~/skills/a.cjs' WHEN i % 13 = 0 THEN '~/skills/a.md' ELSE '~/skills/a.sh' END AS p, CASE WHEN i % 3 = 0 THEN 'short' ELSE repeat('body text ', 8) END AS b FROM k)
  SELECT i AS id, CASE WHEN i % 17 = 0 THEN 'no frontmatter' WHEN n = 'Bad Name' THEN 'invalid name' WHEN x = 'perl' THEN 'invalid exec_type' WHEN p = '/etc/a.sh' THEN 'path outside the skills folder'
    WHEN x = 'node' AND p LIKE '%.md' THEN 'node needs a script' WHEN p LIKE '%.cjs' AND x <> 'node' THEN 'script needs node' WHEN p LIKE '%.py' AND x <> 'python' THEN 'python file needs python'
    WHEN x = 'python' AND p NOT LIKE '%.py' THEN 'python needs a python file' WHEN b = 'short' THEN 'body too short' END AS error,
    CASE WHEN i % 17 <> 0 THEN replace(p, '~/', '/home/u/') END AS resolved_path, CASE WHEN i % 17 <> 0 THEN 'd ' || i END AS description FROM f""")
def contract_validate(spark: SparkSession, sf: str) -> DataFrame:
    f = views.wide(views.table(spark, sf, "part")).selectExpr(
        "p_partkey AS i", "CASE WHEN p_partkey % 5 = 0 THEN 'Bad Name' ELSE concat('tool.n', p_partkey) END AS n", "CASE p_partkey % 4 WHEN 0 THEN 'node' WHEN 1 THEN 'shell' WHEN 2 THEN 'python' ELSE 'perl' END AS x",
        "CASE WHEN p_partkey % 7 = 0 THEN '/etc/a.sh' WHEN p_partkey % 4 = 2 THEN '~/skills/a.py' WHEN p_partkey % 11 = 0 THEN '~/skills/a.cjs' WHEN p_partkey % 13 = 0 THEN '~/skills/a.md' ELSE '~/skills/a.sh' END AS p",
        "CASE WHEN p_partkey % 3 = 0 THEN 'short' ELSE repeat('body text ', 8) END AS b",
    )
    contract = F.expr("concat('---\\n', 'name: ', n, '\\ndescription: \"d ', i, '\"\\nexec_path: ', p, '\\nexec_type: ', x, '\\n---\\n', b)")
    rows = f.select(F.col("i").alias("id"), F.when(F.col("i") % 17 == 0, "nothing here").otherwise(contract).alias("contract_md"))
    out = rules.validate_contract(rows, "/home/u/skills/", "/home/u", ("/tokens/",))
    return out.select("id", "error", "resolved_path", F.col("fm")["description"].alias("description"))


# --- text ----------------------------------------------------------------------------------------


@query("SELECT page_id AS id, trim(regexp_replace(regexp_replace(html, '\\s+', ' ', 'g'), '[^\\x20-\\x7E]', '', 'g')) AS cleaned FROM pages")
def clean_ocr(spark: SparkSession, sf: str) -> DataFrame:
    return views.wide(views.table(spark, sf, "pages")).select(F.col("page_id").alias("id"), text.clean(F.col("html")).alias("cleaned"))


@query("""SELECT page_id AS id, coalesce(array_to_string(list_filter(list_transform(string_split(html, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10)), '') AS lines FROM pages""")
def clean_lines(spark: SparkSession, sf: str) -> DataFrame:
    return views.wide(views.table(spark, sf, "pages")).select(F.col("page_id").alias("id"), text.clean_lines(F.col("html")).alias("lines"))


_NAMED = "concat(text, ' see report-two.pdf or src/main.py and notes-of-may Jan 26, also My-File.JSON ', doc_id, '.txt')"


@query(f"""WITH d AS (SELECT doc_id, concat(text, ' see report-two.pdf or src/main.py and notes-of-may Jan 26, also My-File.JSON ', doc_id, '.txt') AS t FROM documents),
  m AS (SELECT doc_id, list_concat(regexp_extract_all(t, '{text.STANDARD_NAME}'), regexp_extract_all(t, '{text.DATED_NAME}', 1)) AS ms FROM d)
  SELECT doc_id AS id, list_aggregate(list_sort(list_distinct(ms)), 'string_agg', '|') AS files FROM m""")
def extract_filenames(spark: SparkSession, sf: str) -> DataFrame:
    d = views.wide(views.table(spark, sf, "documents")).select("doc_id", F.expr(_NAMED).alias("t"))
    return d.select(F.col("doc_id").alias("id"), F.array_join(F.array_sort(text.file_names(F.col("t"))), "|").alias("files"))


@query()
def extract_filenames_fragments(spark: SparkSession, sf: str) -> DataFrame:
    d = views.wide(views.table(spark, sf, "documents")).select("doc_id", F.concat("text", F.lit(" cbs-rep noise chloe.pdf and q-two- more istian.pdf")).alias("t"))
    return d.select(F.col("doc_id").alias("id"), text.broken_names_udf()("t").alias("files"))


@query("""WITH x AS (SELECT doc_id, list_filter(string_split(text || chr(10) || 'const a = ' || doc_id || chr(10) || ' letter', chr(10)), lambda l: regexp_matches(trim(l), '^(export|import|function|const|let|var)\\b')) AS s FROM documents)
  SELECT doc_id AS id, array_to_string(s, '|') AS snippets FROM x""")
def code_snippets(spark: SparkSession, sf: str) -> DataFrame:
    d = views.table(spark, sf, "documents").select("doc_id", F.concat("text", F.lit("\nconst a = "), "doc_id", F.lit("\n letter")).alias("t"))
    return d.select(F.col("doc_id").alias("id"), F.array_join(text.code_snippets(F.col("t")), "|").alias("snippets"))


@query("""SELECT doc_id AS id, sha256(replace(replace(text || ' a.pdf b.py a.pdf', 'a.pdf', ''), 'b.py', '')) AS redacted FROM documents""")
def redact_files(spark: SparkSession, sf: str) -> DataFrame:
    d = views.wide(views.table(spark, sf, "documents"))
    t = F.concat("text", F.lit(" a.pdf b.py a.pdf"))
    return d.select(F.col("doc_id").alias("id"), F.sha2(text.redact(t, F.array(F.lit("a.pdf"), F.lit("b.py"))), 256).alias("redacted"))


@query("""WITH t AS (SELECT doc_id, lower(text || CASE doc_id % 5 WHEN 0 THEN ' Results and Agents' WHEN 1 THEN ' electron results' WHEN 2 THEN ' You just switched to the' WHEN 3 THEN ' agents' ELSE '' END) AS l FROM documents)
  SELECT doc_id AS id, (l LIKE '%results%' AND l LIKE '%agents%') OR (l LIKE '%electron%' AND (l LIKE '%results%' OR l LIKE '%agents%')) OR l LIKE '%ask or drag-drop anything here%' OR l LIKE '%copilot screen assistant%' OR l LIKE '%you just switched to the%' AS tainted FROM t""")
def overlay_taint(spark: SparkSession, sf: str) -> DataFrame:
    d = views.wide(views.table(spark, sf, "documents"))
    k = F.col("doc_id") % 5
    t = F.concat("text", F.when(k == 0, " Results and Agents").when(k == 1, " electron results").when(k == 2, " You just switched to the").when(k == 3, " agents").otherwise(""))
    return d.select(F.col("doc_id").alias("id"), text.overlay_tainted(t).alias("tainted"))


@query("""SELECT event_id AS id, CASE WHEN event_type IN ('error', 'click') THEN replace(props, '}', ',"overlayTainted":true}') ELSE props END AS metadata FROM events""")
def taint_backfill(spark: SparkSession, sf: str) -> DataFrame:
    c = views.captures(spark, sf).withColumn("source_text", F.when(F.col("type").isin("error", "click"), "Results | Agents").otherwise("nothing"))
    return upkeep.flag_tainted(c).select("id", "metadata")


_APPS = ", ".join(f"('{a}', '{k}')" for a, k in text.APP_KINDS.items())


@query(f"""WITH m AS (SELECT * FROM (VALUES {_APPS}) v(app, kind)), e AS (SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN 'Slack' WHEN 1 THEN 'iTerm2' WHEN 2 THEN 'Zed' ELSE event_type END AS app FROM events)
  SELECT id, app, coalesce(kind, 'other') AS kind FROM e LEFT JOIN m USING (app)""")
def app_category(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id") % 4
    e = views.table(spark, sf, "events").select(F.col("event_id").alias("id"), F.when(k == 0, "Slack").when(k == 1, "iTerm2").when(k == 2, "Zed").otherwise(F.col("event_type")).alias("app"))
    return e.select("id", "app", text.app_kind(F.col("app")).alias("kind"))


@query("SELECT s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN 'safe' WHEN 1 THEN 'keychain' ELSE 'plain' END AS kind, regexp_replace(lower(s_name || ' A#b'), '[^a-z0-9_]', '_', 'g') AS key FROM supplier")
def profile_values(spark: SparkSession, sf: str) -> DataFrame:
    s = views.table(spark, sf, "supplier")
    ref = F.concat(F.when(F.col("s_suppkey") % 3 == 0, "SAFE:").when(F.col("s_suppkey") % 3 == 1, "KEYTAR:").otherwise(""), "s_name")
    return s.select(F.col("s_suppkey").alias("id"), text.value_kind(ref).alias("kind"), text.boundary_key(F.concat("s_name", F.lit(" A#b"))).alias("key"))


@query("SELECT doc_id AS id, sha256(source || ': ' || lang || chr(10) || CASE WHEN length(text) > 2000 THEN text[1:2000] || '...' ELSE text END) AS summary FROM documents")
def summary_for_embedding(spark: SparkSession, sf: str) -> DataFrame:
    d = views.table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("id"), F.sha2(text.summary_for_embedding(F.col("source"), F.col("lang"), F.col("text")), 256).alias("summary"))


@query()
def gibberish_filter(spark: SparkSession, sf: str) -> DataFrame:
    d = views.wide(views.table(spark, sf, "pages"))
    d = materialize(d.select(F.col("page_id").alias("id"), text.strip_tags(text.clean(F.col("html"))).alias("t")), "cleaned")  # read twice
    return d.select("id", text.without_gibberish_udf(text.common_words(d, "t"))("t").alias("filtered"))


@query()
def screen_text_chain(spark: SparkSession, sf: str) -> DataFrame:
    d = views.wide(views.table(spark, sf, "documents")).select("doc_id", F.expr(_NAMED).alias("t"))
    return text.with_screen_text(d, "t", text.common_words(d, "t")).select(F.col("doc_id").alias("id"), "files", "snippets", "filtered")


@query()
def fallback_embedding(spark: SparkSession, sf: str) -> DataFrame:
    rows = embedding.embed_distinct(views.table(spark, sf, "benchmark").select("text"))
    return rows.select(F.xxhash64("text").alias("text_hash"), F.transform("embedding", lambda x: F.round(x, 9)).alias("embedding"))


@query("""WITH t AS (SELECT turn, text FROM conversations WHERE trim(text) <> ''), a AS (SELECT DISTINCT text FROM t WHERE turn = 0), n AS (SELECT count(*) AS n, count(DISTINCT text) AS d FROM t)
  SELECT step, CAST(requests AS BIGINT) AS requests, CAST(misses AS BIGINT) AS misses, CAST(requests - misses AS BIGINT) AS hits, (requests - misses) / requests AS hit_rate FROM (
    SELECT 1 AS step, (SELECT count(*) FROM t WHERE turn = 0) AS requests, (SELECT count(*) FROM a) AS misses
    UNION ALL SELECT 2, (SELECT count(*) FROM t WHERE turn = 0) + n, d FROM n
    UNION ALL SELECT 3, (SELECT count(*) FROM t WHERE turn = 0) + 2 * n, 2 * d FROM n)""")
def embedding_cache(spark: SparkSession, sf: str) -> DataFrame:
    """Requests, hits and misses so far after first turns are embedded, all turns an hour later, and all turns when the entries have ended."""
    turns = views.table(spark, sf, "conversations").select("turn", "text")
    store = kept_embeddings.EmbeddingStore(spark, new_folder(spark, "embeddings"))
    out = []
    for step, (rows, hours) in enumerate(((turns.where("turn = 0"), 0), (turns, 1), (turns, 49)), 1):
        store.embed(rows.select("text"), EVENT_NOW + timedelta(hours=hours))
        out.append(store.figures().withColumn("step", F.lit(step)))
    return out[0].unionByName(out[1]).unionByName(out[2])


# --- folds ---------------------------------------------------------------------------------------

_KINDS = {"click": "positive_feedback", "purchase": "task_success", "error": "task_failure", "signup": "user_insult", "view": "natural_decay"}


def _mood_events(spark: SparkSession, sf: str) -> DataFrame:
    pairs = [x for k, v in _KINDS.items() for x in (F.lit(k), F.lit(v))]
    return views.table(spark, sf, "events").withColumn("event_type", F.try_element_at(F.create_map(*pairs), F.col("event_type")))


_FOLD = """WITH e AS (SELECT user_id, ts, event_id, event_type AS t, CASE event_type WHEN 'click' THEN 0.15 WHEN 'purchase' THEN 0.10 WHEN 'error' THEN -0.08 WHEN 'signup' THEN -0.25 ELSE 0.0 END::DOUBLE AS dv,
  CASE event_type WHEN 'click' THEN 0.05 WHEN 'error' THEN 0.05 WHEN 'signup' THEN 0.10 ELSE 0.0 END::DOUBLE AS da FROM events),
  l AS (SELECT user_id, list({'v': dv, 'a': da, 'z': t = 'view'} ORDER BY ts, event_id) AS xs, count(*) FILTER (t = 'signup') AS hurt_count, count(*) FILTER (t = 'click') AS joy_count FROM e GROUP BY user_id),
  f AS (SELECT user_id, hurt_count, joy_count, list_reduce(list_prepend({'v': 0.0::DOUBLE, 'a': 0.0::DOUBLE, 'z': false}, xs), lambda s, x: {'v': greatest(-1.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN x.z THEN s.v * 0.98::DOUBLE ELSE s.v + x.v END)),
    'a': greatest(-1.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN x.z THEN s.a * 0.98::DOUBLE ELSE s.a + x.a END)), 'z': false}) AS s FROM l)"""


@query(_FOLD + " SELECT user_id, round(s.v, 6) AS valence, round(s.a, 6) AS arousal, CAST(0.3 AS DOUBLE) AS dominance, hurt_count, joy_count FROM f")
def mood_fold(spark: SparkSession, sf: str) -> DataFrame:
    m = folds.mood(_mood_events(spark, sf), "user_id")
    return m.select("user_id", F.round("valence", 6).alias("valence"), F.round("arousal", 6).alias("arousal"), "dominance", "hurt_count", "joy_count")


@query("""SELECT i AS id, v AS valence, a AS arousal, CASE WHEN v > 0.5 AND a > 0.3 THEN 'joyful' WHEN v >= 0.1 AND v <= 0.5 THEN 'content' WHEN v > -0.1 AND v < 0.1 THEN 'neutral' WHEN v <= -0.5 AND a <= 0 THEN 'hurt'
  WHEN v < -0.3 AND a > 0.4 THEN 'angry' WHEN v < -0.1 AND a < 0 THEN 'withdrawn' ELSE 'neutral' END AS mood_label FROM (SELECT c_custkey AS i, (c_custkey % 41 - 20) / 20.0::DOUBLE AS v, (c_custkey % 17 - 8) / 8.0::DOUBLE AS a FROM customer)""")
def mood_labels(spark: SparkSession, sf: str) -> DataFrame:
    c = views.table(spark, sf, "customer").selectExpr("c_custkey AS id", "(c_custkey % 41 - 20) / 20.0D AS valence", "(c_custkey % 17 - 8) / 8.0D AS arousal")
    return c.withColumn("mood_label", folds.mood_label(F.col("valence"), F.col("arousal")))


@query()
def mood_overlay(spark: SparkSession, sf: str) -> DataFrame:
    traits = spark.createDataFrame([("user_interests", "maps"), ("user_projects", ""), ("speaker_profile", "female_adult")], "trait_key string, trait_value string")
    return folds.overlay(folds.mood(_mood_events(spark, sf), "user_id"), traits).select("user_id", "mood_label", "overlay")


@query("""WITH l AS (SELECT user_id, list(value::DOUBLE ORDER BY ts, event_id) AS x, count(*) AS n FROM events GROUP BY 1)
  SELECT user_id, n AS sample_count, round(list_reduce(x, lambda a, b: a * 0.9::DOUBLE + b * 0.1::DOUBLE), 6) AS first, round(list_reduce(list_transform(x, lambda v: v * 2), lambda a, b: a * 0.9::DOUBLE + b * 0.1::DOUBLE), 6) AS second FROM l""")
def ema_fold(spark: SparkSession, sf: str) -> DataFrame:
    e = views.table(spark, sf, "events").withColumn("features", F.array(F.col("value").cast("double"), F.col("value") * 2.0))
    out = folds.moving_average(e, "user_id", order=("ts", "event_id"))
    return out.select("user_id", "sample_count", F.round(F.col("features")[0], 6).alias("first"), F.round(F.col("features")[1], 6).alias("second"))


# --- captures ------------------------------------------------------------------------------------

_W = "OVER (PARTITION BY user_id ORDER BY ts, capture_id)"
FORGET = 6 * 3600


@query(with_views("screen", rest=f"SELECT capture_id, user_id, ts FROM (SELECT *, lag(ocr_raw) {_W} AS b FROM screen) WHERE b IS DISTINCT FROM ocr_raw"))
def consecutive_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return stream.drop_repeats(views.screen(spark, sf)).select("capture_id", "user_id", "ts")


@query(with_views("screen", rest=f"SELECT capture_id, app, title, a IS DISTINCT FROM app OR t IS DISTINCT FROM title AS changed FROM (SELECT *, lag(app) {_W} AS a, lag(title) {_W} AS t FROM screen)"))
def title_change(spark: SparkSession, sf: str) -> DataFrame:
    return stream.title_changes(views.screen(spark, sf)).select("capture_id", "app", "title", "changed")


@query(with_views("screen", rest="SELECT capture_id, last_value(CASE WHEN app NOT LIKE '%Electron%' THEN app END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, capture_id ROWS UNBOUNDED PRECEDING) AS real_app FROM screen"))
def last_real_app(spark: SparkSession, sf: str) -> DataFrame:
    return stream.last_real_app(views.screen(spark, sf)).select("capture_id", "real_app")


@query(with_views("screen", rest=f"SELECT capture_id, width FROM (SELECT *, lag(width) {_W} AS w FROM screen) WHERE abs(width - w) > 100"))
def resize_trigger(spark: SparkSession, sf: str) -> DataFrame:
    return stream.resizes(views.screen(spark, sf)).select("capture_id", "width")


_GATED = f"""a AS (SELECT *, lag(app) {_W} AS pa, lag(title) {_W} AS pt, lag(capture_id) {_W} AS pc FROM screen WHERE idle_ms <= 300000 AND app NOT LIKE '%Electron%'),
  b AS (SELECT *, pc IS NULL OR pa <> app OR pt <> title AS changed FROM a), c AS (SELECT * FROM b WHERE (changed OR diff_ratio > 0.15) AND length(ocr_raw) >= 10), d AS (SELECT *, lag(ocr_raw) {_W} AS po FROM c)
  SELECT capture_id, user_id, app, title, changed FROM d WHERE changed OR po IS DISTINCT FROM ocr_raw"""


@query(with_views("screen", rest=", " + _GATED).replace("\n, a AS", ", a AS", 1))
def capture_chain(spark: SparkSession, sf: str) -> DataFrame:
    return stream.gated(views.screen(spark, sf)).select("capture_id", "user_id", "app", "title", "changed")


def _streamed(spark: SparkSession, sf: str, forget: int | None) -> DataFrame:
    """The chain as a stream over the same rows, run until nothing is left, and read back from its sink."""
    folder = new_folder(spark, "stream")
    views.wide(views.screen(spark, sf)).write.parquet(f"{folder}/in")
    source = spark.readStream.schema(views.screen(spark, sf).schema).parquet(f"{folder}/in")
    stored = stream.gated_stream(source, forget=forget, keep=("capture_id", "user_id", "app", "title"), groups=stream.GROUPS)
    run = stream.store_batches(stored, f"{folder}/out", f"{folder}/state", once=True)
    run.awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("capture_id", "user_id", "app", "title", "changed")


@query(with_views("screen", rest=", " + _GATED).replace("\n, a AS", ", a AS", 1))
def capture_chain_stream(spark: SparkSession, sf: str) -> DataFrame:
    return _streamed(spark, sf, None)


_FORGETS = f"""a AS (SELECT *, lag(app) {_W} AS pa, lag(title) {_W} AS pt, coalesce(ts - lag(ts) {_W} > INTERVAL {FORGET} SECONDS, true) AS opens FROM screen WHERE idle_ms <= 300000 AND app NOT LIKE '%Electron%'),
  b AS (SELECT *, opens OR pa <> app OR pt <> title AS changed, sum(CAST(opens AS INTEGER)) {_W} AS run FROM a), c AS (SELECT * FROM b WHERE (changed OR diff_ratio > 0.15) AND length(ocr_raw) >= 10),
  d AS (SELECT *, lag(ocr_raw) {_W} AS po, lag(run) {_W} AS pr FROM c) SELECT capture_id, user_id, app, title, changed FROM d WHERE changed OR po IS DISTINCT FROM ocr_raw OR pr IS DISTINCT FROM run"""


@query(with_views("screen", rest=", " + _FORGETS).replace("\n, a AS", ", a AS", 1))
def capture_chain_forgets(spark: SparkSession, sf: str) -> DataFrame:
    """The chain where a user is new again after six hours without a capture."""
    return stream.gated(views.screen(spark, sf), forget=FORGET).select("capture_id", "user_id", "app", "title", "changed")


@query(with_views("screen", rest=", " + _FORGETS).replace("\n, a AS", ", a AS", 1))
def capture_chain_forgets_stream(spark: SparkSession, sf: str) -> DataFrame:
    return _streamed(spark, sf, FORGET)


@query(with_views("screen", rest="""SELECT session_id, capture_id, array_to_string(f, '|') AS new_lines FROM (SELECT 's' || user_id AS session_id, capture_id,
  list_filter(string_split(ocr_raw, chr(10)), lambda x: length(x) > 5 AND NOT list_contains(string_split(coalesce(lag(ocr_raw) OVER (PARTITION BY user_id ORDER BY ts, capture_id), 'common last line'), chr(10)), x)) AS f
  FROM screen WHERE app = 'click') WHERE len(f) > 0"""))
def watch_new_lines(spark: SparkSession, sf: str) -> DataFrame:
    s = views.screen(spark, sf)
    sessions = s.select("user_id").distinct().select("user_id", F.concat(F.lit("s"), "user_id").alias("session_id"), F.lit("click").alias("app"), F.lit("common last line").alias("baseline"))
    return stream.watch(s, sessions).select("session_id", "capture_id", F.array_join("new_lines", "|").alias("new_lines"))


@query(with_views("screen", rest="SELECT capture_id AS memory_id, 'APP' AS type, app AS entity, lower(app) AS normalized_value FROM screen UNION ALL SELECT capture_id, 'WINDOW_TITLE', title, lower(title) FROM screen UNION ALL SELECT capture_id, 'FILE', 'A.pdf', 'a.pdf' FROM screen"))
def capture_entities(spark: SparkSession, sf: str) -> DataFrame:
    return stream.capture_entities(views.screen(spark, sf).withColumn("files", F.array(F.lit("A.pdf"))))
