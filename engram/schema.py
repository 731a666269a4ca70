"""Tables of the data model as Spark schemas, and the rules every stored record obeys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Vectors that the default embedder makes.
DIMENSION = 384
MAX_TEXT, MAX_ENTITIES = 10_000, 100
_STAMPS = "created_at timestamp_ntz, updated_at timestamp_ntz"
_MEMORY = f"id string, user_id string, type string, source_text string, metadata string, screenshot string, extracted_text string, embedding array<float>, {_STAMPS}"
_ENTITY = "id string, memory_id string, entity string, type string, entity_type string, normalized_value string, created_at timestamp_ntz"

SCHEMAS: dict[str, str] = {
    "memory": _MEMORY,
    "episodic_memory": _MEMORY,
    "memory_entities": _ENTITY,
    "episodic_entities": _ENTITY,
    "skill_prompts": f"id string, tags string, prompt_text string, embedding array<float>, hit_count int, {_STAMPS}",
    "context_rules": f"id string, context_type string, context_key string, rule_text string, category string, source string, hit_count int, status string, priority int, verified_count int, failed_count int, last_verified_at timestamp_ntz, user_note string, {_STAMPS}",
    "api_rules": f"id string, service string, rule_type string, rule_text string, code_pattern string, fix_hint string, source string, hit_count int, {_STAMPS}",
    "intent_overrides": f"id string, example_prompt string, correct_intent string, wrong_intent string, embedding array<float>, source string, hit_count int, {_STAMPS}",
    "phrase_preferences": f"id string, example_phrase string, delivery string, service string, metadata string, embedding array<float>, source string, hit_count int, {_STAMPS}",
    "installed_skills": f"id string, name string, description string, contract_md string, exec_path string, exec_type string, enabled boolean, source_domain string, source_action string, {_STAMPS}",
    "skill_health": "skill_name string, status string, errors string, last_checked_at timestamp_ntz, auto_repaired boolean",
    "personality_state": "id string, valence double, arousal double, dominance double, mood_label string, mood_reason string, hurt_count int, joy_count int, reset_at timestamp_ntz, updated_at timestamp_ntz",
    "personality_traits": f"id string, trait_key string, trait_value string, source string, weight double, {_STAMPS}",
    "voice_fingerprint": f"id string, speaker_id string, speaker_name string, features array<double>, sample_count int, gender string, age_group string, angry_count int, loud_count int, whisper_count int, {_STAMPS}",
    "user_profile": f"id string, key string, value_ref string, sensitive boolean, service string, label string, {_STAMPS}",
    "user_constraints": f"id string, scope string, rule string, blocks string, severity string, override_pin string, {_STAMPS}",
    "pending_tasks": "id string, original_prompt string, sub_prompt string, intent string, step_order int, plan_context string, status string, completion_signal string, completion_arg string, started_at timestamp_ntz, completed_at timestamp_ntz, result string, error_text string, session_id string, user_id string",
}


def migrate(df: DataFrame, table: str) -> DataFrame:
    """Bring an older version of a table to the present schema: missing columns are added as null, others cast."""
    spark = df.sparkSession
    wanted = spark.createDataFrame([], SCHEMAS[table]).schema
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted))


def text_error(text: Column) -> Column:
    """Why a text may not be stored; null if it may. Length counts before trimming."""
    return (
        F.when(text.isNull() | (text == ""), "text must be a non-empty string")
        .when(F.length(text) > MAX_TEXT, f"text is longer than {MAX_TEXT} characters")
        .when(F.trim(text) == "", "text is blank")
    )


def valid_metadata(metadata: Column) -> Column:
    """JSON text of an object; null or broken JSON becomes {}."""
    parsed = F.try_parse_json(metadata)
    return F.when(parsed.isNull() | ~F.schema_of_variant(parsed).startswith("OBJECT"), F.lit("{}")).otherwise(F.to_json(parsed))


def valid_entities(entities: Column) -> Column:
    """The first 100 entities that have a type and a value."""
    ok = lambda e: (F.coalesce(e["type"], F.lit("")) != "") & (F.coalesce(e["value"], F.lit("")) != "")
    return F.slice(F.filter(F.coalesce(entities, F.array().cast("array<struct<type:string,value:string,entity_type:string,normalized:string>>")), ok), 1, MAX_ENTITIES)


def memory_id(millis: Column, text: Column, repeat: Column | None = None) -> Column:
    """mem_<milliseconds>_<SHA-256 of the text>, from the second repeat on with its number, so that a rerun gives the same id."""
    own = F.concat(F.lit("mem_"), millis.cast("string"), F.lit("_"), F.sha2(text, 256))
    return own if repeat is None else F.when(repeat > 1, F.concat(own, F.lit("_"), repeat.cast("string"))).otherwise(own)
