"""States that depend on the order of events: moving averages and moods.

One step of either maps the state before to the state after, and steps in a row make one map of the same form. So a key's events are
cut into segments of SEGMENT events, each segment becomes one map, segments in a row become one again, and the map of all is
applied to the first state. No task holds a key's history. A key of one segment is folded step by step, as if there were no
segments; beyond that results agree but for the rounding of sums.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Change of valence and arousal by event; decay shrinks both instead.
DELTAS = {
    "positive_feedback": (0.15, 0.05), "user_insult": (-0.25, 0.10), "user_raised_voice": (-0.10, 0.08), "user_frustrated": (-0.08, 0.06),
    "task_success": (0.10, 0.0), "task_failure": (-0.08, 0.05), "ignored": (-0.05, -0.08), "repetitive_request": (-0.05, 0.0),
    "discovery_made": (0.12, 0.10), "proactive_act_done": (0.08, 0.05), "natural_decay": (0.0, 0.0),
}
DECAY, DOMINANCE = 0.02, 0.3
#: How each mood asks one to behave.
GUIDANCE = {
    "joyful": "You are in high spirits. Be warm, engaged, and slightly more expressive than usual.",
    "content": "You are in a good place. Respond normally — warm, willing, and efficient.",
    "neutral": "You are composed and neutral. Be direct and efficient. Minimal pleasantries.",
    "withdrawn": "You are subdued. Be terse. Add a natural 1-2 second pause before responding. Do not initiate.",
    "hurt": "You are emotionally wounded. Be very brief. You may decline to engage with trivial requests. Warmth is available but guarded.",
    "angry": "You are unsettled. Keep responses to one sentence. Do not engage with chitchat. Prioritize tasks over pleasantries.",
}


#: Events in a segment, and maps that make one of the next level.
SEGMENT = 1000
#: Levels before the maps of a key are put together: with two, a key of a billion events has some thousand maps left.
LEVELS = 2


def in_segments(df: DataFrame, key: str, order: Sequence[str], step: Column, together: Callable[[Column], Column], segment: int = SEGMENT) -> DataFrame:
    """key and map: the map of all of a key's steps in order; ``together`` makes one of an array of maps.

    Range partitions by key and order number the events, so a key may span any number of tasks; groups of ``segment`` numbers
    give the segments, and the first numbers of these the order of the next level.
    """
    ranged = df.select(key, *order, step.alias("map")).repartitionByRange(key, *order, F.hash("map")).sortWithinPartitions(key, *order, F.hash("map"))
    maps = ranged.select(key, F.monotonically_increasing_id().alias("n"), "map")
    for level in range(LEVELS):
        lists = maps.groupBy(key, F.floor(F.col("n") / segment ** (level + 1)).alias("s")).agg(F.min("n").alias("n"), F.array_sort(F.collect_list(F.struct("n", "map"))).alias("maps"))
        maps = lists.select(key, "n", together(F.transform("maps", lambda x: x["map"])).alias("map"))
    whole = maps.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("n", "map"))).alias("maps"))
    return whole.select(key, together(F.transform("maps", lambda x: x["map"])).alias("map"))


def clamp(value: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value))


def mood_label(valence: Column, arousal: Column) -> Column:
    return (
        F.when((valence > 0.5) & (arousal > 0.3), "joyful")
        .when((valence >= 0.1) & (valence <= 0.5), "content")
        .when((valence > -0.1) & (valence < 0.1), "neutral")
        .when((valence <= -0.5) & (arousal <= 0.0), "hurt")
        .when((valence < -0.3) & (arousal > 0.4), "angry")
        .when((valence < -0.1) & (arousal < 0.0), "withdrawn")
        .otherwise("neutral")
    )


def guidance(label: Column) -> Column:
    pairs = [x for k, v in GUIDANCE.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), label), F.lit(GUIDANCE["neutral"]))


def mood(events: DataFrame, key: str, kind: str = "event_type", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """The mood of each key after its events; the clamp at every step makes the order matter.

    A step is x -> clamp(a * x + b, low, high), and so are two steps in a row.
    """
    deltas = [x for k, v in DELTAS.items() for x in (F.lit(k), F.struct(F.lit(v[0]).alias("v"), F.lit(v[1]).alias("a")))]
    given, decays = F.element_at(F.create_map(*deltas), F.col(kind)), F.col(kind) == "natural_decay"
    known = events.where(F.col(kind).isin(*DELTAS))

    def step(delta: str) -> Column:
        return F.struct(F.when(decays, 1.0 - DECAY).otherwise(1.0).alias("a"), F.when(decays, 0.0).otherwise(given[delta]).alias("b"), F.lit(-1.0).alias("low"), F.lit(1.0).alias("high"))

    def moved(now: Column, then: Column) -> Column:
        held = lambda x: F.greatest(then["low"], F.least(then["high"], then["a"] * x + then["b"]))
        return F.struct((then["a"] * now["a"]).alias("a"), (then["a"] * now["b"] + then["b"]).alias("b"), held(now["low"]).alias("low"), held(now["high"]).alias("high"))

    def together(maps: Column) -> Column:
        rest = F.slice(maps, 2, F.greatest(F.size(maps), F.lit(1)))
        return F.aggregate(rest, maps[0], lambda s, x: F.struct(moved(s["v"], x["v"]).alias("v"), moved(s["a"], x["a"]).alias("a")))

    ends = in_segments(known, key, order, F.struct(step("v").alias("v"), step("a").alias("a")), together)
    at_zero = lambda m: F.greatest(m["low"], F.least(m["high"], m["b"]))
    counts = known.groupBy(F.col(key).alias("its_key")).agg(
        F.sum(F.when(F.col(kind) == "user_insult", 1).otherwise(0)).alias("hurt_count"), F.sum(F.when(F.col(kind) == "positive_feedback", 1).otherwise(0)).alias("joy_count")
    )
    states = ends.select(key, at_zero(F.col("map.v")).alias("valence"), at_zero(F.col("map.a")).alias("arousal"), F.lit(DOMINANCE).alias("dominance"))
    out = states.join(counts, F.col(key).eqNullSafe(F.col("its_key"))).drop("its_key")
    return out.withColumn("mood_label", mood_label(F.col("valence"), F.col("arousal")))


def moving_average(samples: DataFrame, key: str, features: str = "features", order: tuple[str, ...] = ("ts",), alpha: float = 0.10) -> DataFrame:
    """Exponential moving average of feature arrays; the first sample starts it and gives its length, alpha of 1 or more replaces.

    A segment's map holds what it is if it comes first, and otherwise the weight left to the state before and the weighted sum added.
    """
    x = F.col(features).cast("array<double>")
    if alpha >= 1:
        last = F.max_by(features, F.struct(*order, F.hash(features)))
        return samples.groupBy(key).agg(last.alias("features"), F.count("*").alias("sample_count"))
    keep, new = F.lit(1.0 - alpha), F.lit(alpha)
    step = F.struct(x.alias("first"), keep.alias("weight"), F.transform(x, lambda v: F.coalesce(v.cast("double"), F.lit(0.0)) * new).alias("added"))

    def blend(state: Column, then: Column) -> Column:
        return F.transform(state, lambda v, i: v * then["weight"] + F.coalesce(F.get(then["added"], i), F.lit(0.0)))

    def joined(now: Column, then: Column) -> Column:
        zero = lambda v: F.coalesce(v, F.lit(0.0))
        added = F.zip_with(now["added"], then["added"], lambda p, q: zero(p) * then["weight"] + zero(q))
        return F.struct(blend(now["first"], then).alias("first"), (now["weight"] * then["weight"]).alias("weight"), added.alias("added"))

    def together(maps: Column) -> Column:
        return F.aggregate(F.slice(maps, 2, F.greatest(F.size(maps), F.lit(1))), maps[0], joined)

    ends = in_segments(samples, key, order, step, together)
    counts = samples.groupBy(F.col(key).alias("its_key")).agg(F.count("*").alias("sample_count"))
    return ends.join(counts, F.col(key).eqNullSafe(F.col("its_key"))).select(key, F.col("map.first").alias("features"), "sample_count")


def overlay(state: DataFrame, traits: DataFrame, title: str = "LIVE STATE") -> DataFrame:
    """One text block a state row: mood, guidance, and the traits that have a value."""
    bar = "═" * 47
    held = traits.where("trait_value <> ''").groupBy().agg(F.map_from_entries(F.collect_list(F.struct("trait_key", "trait_value"))).alias("t"))
    both = state.join(F.broadcast(held))  # one row
    value = lambda k: F.try_element_at(F.col("t"), F.lit(k))
    line = lambda name, k: F.when(F.coalesce(value(k), F.lit("")) != "", F.concat(F.lit(f"{name}: "), value(k)))
    parts = F.split(value("speaker_profile"), "_")
    sex, age = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    who = F.when(age == "child", "child").when(sex == "female", "female adult").when(sex == "male", "male adult").otherwise(sex)
    call = F.when(age == "child", '"friend"').when(sex == "female", '"ma\'am"').when(sex == "male", '"sir"').otherwise("none")
    speaker = F.when(value("speaker_profile") != "", F.concat(F.lit("Speaker profile: "), who, F.lit(" — address as "), call, F.lit(" when appropriate")))
    label = F.coalesce("mood_label", mood_label(F.col("valence"), F.col("arousal")))
    mood_line = F.concat(F.lit("Mood: "), label, F.lit(" (valence: "), F.format_number("valence", 2), F.lit(", arousal: "), F.format_number("arousal", 2), F.lit(")"))
    lines = [F.lit(bar), F.lit(title), F.lit(bar), mood_line, F.concat(F.lit("Behavioral guidance: "), guidance(label)), line("User interests", "user_interests"), line("Active projects", "user_projects"), line("Available skills", "available_skills"), line("Relationship note", "relationship_style"), speaker, F.lit(bar)]
    return both.select(*state.columns, F.concat_ws("\n", *lines).alias("overlay"))
