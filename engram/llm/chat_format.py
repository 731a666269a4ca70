"""Tool-call linking for chat data, with DataFrame functions only.

Calls and results meet in a hash join on their identifier; calls are ordered topologically along
their parents by pointer doubling (each round joins every call with what its pointer points at, so
chains of any length take a logarithm of rounds); arguments are validated against the tools' schemas
as variants; every call becomes one line of canonical JSON (sorted keys, no blanks).

Repeated identifiers are brought together by aggregation before any join: the first call (by place,
then arguments) and the first result (by place, then content) count, and the numbers of both are
told. No list of calls or results is gathered.

Defined results: a call without identifier cannot be linked (status no_id, one row each); a parent
that is no call counts as none; a call whose parents run in a circle has status cycle and no depth;
a result without call gives one row with status orphan for its identifier, results without
identifier likewise; arguments that are no JSON object are invalid; null contents are kept as null;
an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.storage import materialize

#: Tools and their arguments: name -> (type, required).
Schemas = dict[str, dict[str, tuple[str, bool]]]
#: A turn of a user asks for a reply.
TURN_TOOLS: Schemas = {"reply": {"prompt": ("string", True), "turn": ("integer", True)}}
#: What a JSON type is as the type of a variant.
TYPES = {"string": "^STRING$", "integer": "^(BIGINT|DECIMAL\\(\\d+,0\\))$", "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", "boolean": "^BOOLEAN$", "array": "^ARRAY", "object": "^OBJECT"}


def argument_errors(name: Column, parsed: Column, schemas: Schemas) -> Column:
    """Faults of a call's parsed arguments, as an array of strings in the schema's order."""
    kind = F.schema_of_variant(parsed)
    known = F.lit(None).cast("array<string>")
    for tool, fields in schemas.items():
        faults = []
        for field, (wanted, required) in fields.items():
            value = F.try_variant_get(parsed, f"$['{field}']", "variant")
            got = F.schema_of_variant(value)
            absent = value.isNull()
            faults.append(F.when(absent, F.lit(f"{field}: missing") if required else F.lit(None)).when(~got.rlike(TYPES[wanted]), F.lit(f"{field}: not {wanted}")))
        keys = F.json_object_keys(F.to_json(parsed))
        extra = F.transform(F.array_sort(F.array_except(keys, F.array(*map(F.lit, fields)))), lambda k: F.concat(k, F.lit(": unknown")))
        known = F.when(name == tool, F.concat(F.filter(F.array(*faults), lambda x: x.isNotNull()), extra)).otherwise(known)
    return (
        F.when(parsed.isNull() | ~kind.startswith("OBJECT"), F.array(F.lit("arguments: no object")))
        .otherwise(F.coalesce(known, F.array(F.lit("name: unknown tool"))))
    )


def depths(calls: DataFrame) -> DataFrame:
    """call_id and depth (calls above it; null in a circle), from call_id (distinct, not null) and parent_id."""
    known = calls.select(F.col("call_id").alias("up"))
    state = calls.select("call_id", F.col("parent_id").alias("up")).join(known.withColumn("there", F.lit(True)), "up", "left")
    state = materialize(state.select("call_id", F.when(F.col("there"), F.col("up")).alias("up"), F.when(F.col("there"), 1).otherwise(0).cast("long").alias("depth")), "depths")
    open_, rounds = state.where("up IS NOT NULL").count(), 0
    most = state.count().bit_length() + 1
    while open_ and rounds < most:
        above = state.select(F.col("call_id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        state = state.join(above, "up", "left").select("call_id", F.col("next").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        state = materialize(state, "depths")
        open_, rounds = state.where("up IS NOT NULL").count(), rounds + 1
    return state.select("call_id", F.when(F.col("up").isNull(), F.col("depth")).alias("depth"))


def link_calls(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """One row for each call identifier, and each identifier that only results have.

    calls: group_id, call_id, parent_id, name, arguments (JSON), place; results: group_id, call_id,
    content, place. Out: group_id, call_id, parent_id, depth, status (linked, no_result, cycle,
    orphan, no_id), n_calls, n_results, args_valid, errors, line.
    """
    named = calls.where(F.col("call_id").isNotNull())
    first = F.min(F.struct("place", F.coalesce("arguments", F.lit("")).alias("key"), "arguments", "name", "parent_id", "group_id"))
    one = materialize(named.groupBy("call_id").agg(first.alias("c"), F.count("*").alias("n_calls")).select("call_id", "n_calls", "c.group_id", "c.parent_id", "c.name", "c.arguments"), "calls")
    answer = F.min(F.struct("place", F.coalesce("content", F.lit("")).alias("key"), "content", "group_id"))
    answers = results.groupBy("call_id").agg(answer.alias("r"), F.count("*").alias("n_results")).select("call_id", "n_results", F.col("r.content").alias("content"), F.col("r.group_id").alias("result_group"), F.lit(True).alias("answered"))
    both = one.join(depths(one), "call_id").withColumn("asked", F.lit(True)).join(answers, "call_id", "full_outer")
    status = F.when(F.col("asked").isNull(), F.when(F.col("call_id").isNull(), "no_id").otherwise("orphan")).when(F.col("depth").isNull(), "cycle").when(F.col("answered"), "linked").otherwise("no_result")
    linked = both.select(F.coalesce("group_id", "result_group").alias("group_id"), "call_id", "parent_id", "depth", status.alias("status"), "n_calls", "n_results", "name", "arguments", "content")
    lost = calls.where(F.col("call_id").isNull()).select("group_id", "call_id", "parent_id", F.lit(None).cast("long").alias("depth"), F.lit("no_id").alias("status"), F.lit(1).cast("long").alias("n_calls"), F.lit(0).cast("long").alias("n_results"), "name", "arguments", F.lit(None).cast("string").alias("content"))
    rows = linked.unionByName(lost).withColumn("parsed", F.try_parse_json("arguments"))
    is_call = F.coalesce("n_calls", F.lit(0)) > 0
    rows = rows.withColumn("errors", F.when(is_call, F.array_join(argument_errors(F.col("name"), F.col("parsed"), schemas), "; ")))
    # keys in sorted order; arguments are sorted as variants are
    line = F.concat(
        F.lit('{"arguments":'), F.coalesce(F.to_json("parsed"), F.lit("null")),
        F.lit(',"depth":'), F.coalesce(F.col("depth").cast("string"), F.lit("null")),
        F.lit(',"id":'), quoted(F.col("call_id")), F.lit(',"name":'), quoted(F.col("name")),
        F.lit(',"parent":'), quoted(F.col("parent_id")), F.lit(',"result":'), quoted(F.col("content")), F.lit("}"),
    )
    return rows.select("group_id", "call_id", "parent_id", "depth", "status", F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_results", F.lit(0)).alias("n_results"), (F.col("errors") == "").alias("args_valid"), "errors", line.alias("line"))


def quoted(column: Column) -> Column:
    """A string as JSON; null as null."""
    written = F.to_json(F.struct(column.alias("a")))  # {"a":"..."}
    return F.when(column.isNull(), F.lit("null")).otherwise(F.substring(written, F.lit(6), F.length(written) - 6))


def turns_as_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """conv_id, turn, role, text as calls and results.

    A user's turn is a call of the tool reply, the assistant's next turn its result; the user's turn
    before last in the same conversation is the parent.
    """
    ident = lambda back: F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") - back).cast("string"))
    whole = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    calls = turns.where("role = 'user'").select(
        F.col("conv_id").alias("group_id"),
        F.when(whole, ident(0)).alias("call_id"),
        F.when(whole, ident(2)).alias("parent_id"),
        F.lit("reply").alias("name"),
        F.to_json(F.struct(F.col("text").alias("prompt"), "turn")).alias("arguments"),
        F.col("turn").alias("place"),
    )
    results = turns.where("role = 'assistant'").select(F.col("conv_id").alias("group_id"), F.when(whole, ident(1)).alias("call_id"), F.col("text").alias("content"), F.col("turn").alias("place"))
    return calls, results


def link_turns(turns: DataFrame) -> DataFrame:
    """Linked calls of a table of conversations."""
    calls, results = turns_as_calls(turns)
    return link_calls(calls, results, TURN_TOOLS).withColumnRenamed("group_id", "conv_id")


#: The same result in DuckDB; depth by recursion along the parents.
ORACLE = r"""
WITH RECURSIVE u AS (SELECT conv_id, turn, text, conv_id || ':' || turn AS call_id, conv_id || ':' || (turn - 2) AS parent_id FROM conversations WHERE role = 'user'),
c AS (SELECT call_id, count(*) AS n_calls, min(conv_id) AS conv_id, min(parent_id) AS parent_id, min(turn) AS turn, min(text) AS text FROM u GROUP BY call_id),
r AS (SELECT conv_id || ':' || (turn - 1) AS call_id, count(*) AS n_results, min(conv_id) AS conv_id, min(text) AS content FROM conversations WHERE role = 'assistant' GROUP BY 1),
d AS (SELECT call_id, 0 AS depth FROM c WHERE parent_id NOT IN (SELECT call_id FROM c)
      UNION ALL SELECT c.call_id, d.depth + 1 FROM c JOIN d ON c.parent_id = d.call_id),
j AS (SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, c.parent_id, CAST(d.depth AS BIGINT) AS depth,
      CASE WHEN c.call_id IS NULL THEN 'orphan' WHEN r.call_id IS NULL THEN 'no_result' ELSE 'linked' END AS status,
      coalesce(n_calls, 0) AS n_calls, coalesce(n_results, 0) AS n_results, c.call_id IS NOT NULL AS asked, c.turn, c.text, r.content
      FROM c LEFT JOIN d USING (call_id) FULL JOIN r ON r.call_id = c.call_id)
SELECT conv_id, call_id, parent_id, depth, status, n_calls, n_results,
       CASE WHEN asked THEN text IS NOT NULL END AS args_valid,
       CASE WHEN asked THEN CASE WHEN text IS NULL THEN 'prompt: missing' ELSE '' END END AS errors,
       '{"arguments":' || CASE WHEN asked THEN '{' || CASE WHEN text IS NULL THEN '' ELSE '"prompt":' || CAST(to_json(text) AS VARCHAR) || ',' END || '"turn":' || turn || '}' ELSE 'null' END
       || ',"depth":' || coalesce(CAST(depth AS VARCHAR), 'null') || ',"id":' || CAST(to_json(call_id) AS VARCHAR)
       || ',"name":' || CASE WHEN asked THEN '"reply"' ELSE 'null' END || ',"parent":' || coalesce('"' || parent_id || '"', 'null')
       || ',"result":' || coalesce(CAST(to_json(content) AS VARCHAR), 'null') || '}' AS line
FROM j
"""
