"""Constraints, contracts and query classes as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.functions.text import ascii_edges

#: Words that carry no meaning in a rule.
STOP_WORDS = ("the", "and", "from", "that", "this", "with", "not", "let", "can", "you", "for", "are", "was", "its", "all", "any", "but", "our", "they", "been", "have", "has", "will", "would", "could", "should", "never", "dont", "also", "just", "make", "sure")


#: Literal characters by which a glob is looked up, at most.
END = 16


def content_words(text: Column) -> Column:
    """Lower-case words of three letters or more that are no stop words."""
    words = F.split(F.lower(text), r"[^A-Za-z0-9_]+")
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS))


def glob_pattern(glob: Column) -> Column:
    """A regular expression for a glob: dots are dots, a star is anything, either case."""
    return F.concat(F.lit("(?i)^"), F.replace(F.replace(glob, F.lit("."), F.lit(r"\.")), F.lit("*"), F.lit(".*")), F.lit(r"\z"))


def any_glob(blocks: Column, actions: Column) -> Column:
    """Whether any action matches any glob."""
    return F.exists(blocks, lambda b: F.exists(actions, lambda a: F.regexp_like(a, glob_pattern(b))))


def pin_hash(pin: Column) -> Column:
    return F.sha2(F.trim(F.upper(pin)), 256)


def _plain_ends(glob: Column) -> Column:
    """The literal characters at one end of a glob by which it can be looked up, as a key; "" where there are none."""
    low = _ascii_lower(glob)
    head, tail = F.substring(F.regexp_extract(low, r"^[^*]*", 0), 1, END), F.substring(F.reverse(F.regexp_extract(low, r"[^*]*$", 0)), 1, END)
    return F.when(F.regexp_like(glob, F.lit(r"[\\^$|?+()\[\]{}]")), F.lit("")).when(head != "", F.concat(F.lit("<"), head)).when(tail != "", F.concat(F.lit(">"), tail)).otherwise(F.lit(""))


def _ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def glob_pairs(globs: DataFrame, actions: DataFrame) -> DataFrame:
    """Distinct pairs (glob, action) that match.

    Globs are looked up by the literal characters at their start, or else at their end (END at most), and only actions with
    the same ones are tried; a glob without any (``*x*``, or one that is a regular expression) is tried on every distinct action.
    """
    held = globs.where("glob IS NOT NULL").select("glob").distinct().withColumn("key", _plain_ends(F.col("glob")))
    lengths = sorted(r[0] for r in held.select(F.length("key")).distinct().collect())  # END + 2 numbers at most
    low = _ascii_lower(F.col("action"))
    ends = [F.concat(F.lit(mark), F.substring(text, 1, n - 1)) for mark, text in (("<", low), (">", F.reverse(low))) for n in lengths if n]
    keys = F.array_distinct(F.array(F.lit(""), *ends))
    asked = actions.where("action IS NOT NULL").select("action").distinct().select("action", F.explode(keys).alias("key"))
    return asked.join(held, "key").where(F.regexp_like(F.col("action"), glob_pattern(F.col("glob")))).select("glob", "action")


def matching_constraints(constraints: DataFrame, requests: DataFrame) -> DataFrame:
    """Constraints that apply to each request (request_id, scope, actions array, message, pin); ids are unique on either side.

    A constraint without blocks applies to everything of its scope. A request meets the constraints of its own scope and of the
    global one, or all where it names none. Rules are found by their words, their globs and, if they block everything, their
    scope; no pair of a request and a constraint that have none of these in common is made.
    """
    named = F.col("scope") != ""
    reach = F.when(named, F.array_distinct(F.array(F.lit("in global"), F.concat(F.lit("in "), F.col("scope"))))).otherwise(F.array(F.lit("any")))
    held = constraints.select(
        "id", F.explode(F.array(F.concat(F.lit("in "), F.col("scope")), F.lit("any"))).alias("reach"),
        F.coalesce(F.from_json("blocks", "array<string>"), F.array().cast("array<string>")).alias("globs"), F.array_distinct(content_words(F.coalesce("rule", F.lit("")))).alias("words"),
    )
    asked = requests.select("request_id", F.explode(reach).alias("reach"), F.coalesce("actions", F.array().cast("array<string>")).alias("actions"), F.array_distinct(content_words(F.coalesce("message", F.lit("")))).alias("words"))
    everything = held.where(F.size("globs") == 0).select("id", "reach").join(asked.select("request_id", "reach"), "reach")
    by_words = held.select("id", "reach", F.explode("words").alias("word")).join(asked.select("request_id", "reach", F.explode("words").alias("word")), ["reach", "word"])
    globs = held.select("id", "reach", F.explode("globs").alias("glob"))
    actions = asked.select("request_id", "reach", F.explode("actions").alias("action"))
    by_globs = globs.join(glob_pairs(globs, actions), "glob").join(actions, ["reach", "action"])
    pairs = everything.select("request_id", "id").unionByName(by_words.select("request_id", "id")).unionByName(by_globs.select("request_id", "id")).distinct()
    hit = pairs.join(constraints, "id").join(requests.drop("scope"), "request_id")
    unlocked = F.col("override_pin").isNotNull() & F.coalesce(F.col("override_pin") == pin_hash(F.col("pin")), F.lit(False))
    return hit.withColumn("unlocked", unlocked & (F.col("severity") == "hard"))


def check_constraints(constraints: DataFrame, requests: DataFrame) -> DataFrame:
    """For each request: blocked, hard_blocks, pin_protected, soft_warnings; requests that match nothing too."""
    hit = matching_constraints(constraints, requests)
    hard, soft = F.col("severity") == "hard", F.col("severity") == "soft"
    listed = lambda c: F.sort_array(F.collect_list(F.when(c, F.col("rule"))))
    found = hit.groupBy("request_id").agg(
        F.bool_or(hard & ~F.col("unlocked")).alias("blocked"),
        listed(hard & ~F.col("unlocked")).alias("hard_blocks"),
        listed(hard & ~F.col("unlocked") & F.col("override_pin").isNotNull()).alias("pin_protected"),
        listed(soft).alias("soft_warnings"),
    )
    out = requests.select("request_id").join(found, "request_id", "left").withColumn("blocked", F.coalesce("blocked", F.lit(False)))
    return out.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("hard_blocks", "pin_protected", "soft_warnings")})


# The patterns by which a query is classed.
_PRONOUN = r"\b(we|our|you said|i said|you mentioned|you told|i asked|we discussed|we talked|we covered)\b"
_ANAPHORA = r"\b(that|this|it|those|these)\b.*\b(we|you|i)\b"
_DEMONSTRATIVE = r"\b(that thing|this topic|those points|these ideas)\b"
_TEMPORAL = (
    r"\b(earlier|before|previously|just now|a moment ago|you just)\b.*\b(said|mentioned|told|discussed|explained)\b",
    r"\b(said|mentioned|told|discussed|explained)\b.*\b(earlier|before|previously|just now|a moment ago)\b",
)
_POSITIONAL = (
    r"\b(first|last|initial|latest)\b.*\b(we|you|i)\b.*\b(said|mentioned|discussed|talked)\b",
    r"\b(what did (i|we|you))\b.*\b(say|ask|discuss|mention|talk about)\b",
    r"\b(beginning|start|end)\b.*\b(of (our|the) (conversation|discussion|chat))\b",
    r"\b(go back to|return to|back to)\b.*\b(what (we|you|i))\b",
)
_TOPICAL = (
    r"\b(what (did|have) (we|i|you))\b.*\b(discuss|talk about|cover|chat about)\b",
    r"\b(topics|things|points|issues)\b.*\b((we|i|you) (discussed|covered|mentioned|talked about))\b",
    r"\b(our (conversation|discussion|chat))\b.*\b(about|regarding|concerning)\b",
)
_OVERVIEW = (
    r"\b(summarize|recap|sum up|overview of)\b.*\b(our|this|the)\b.*\b(conversation|discussion|chat)\b",
    r"\b(what (did|have) (we|i|you))\b.*\b(chat|talk)\b.*\babout\b",
    r"\b(give me (a|an))\b.*\b(summary|recap|overview)\b.*\b(of (our|this|the) (conversation|discussion))\b",
)
_DISCOURSE = r"\b(like (you|i) (said|mentioned)|as (you|i) (mentioned|said|explained)|you were saying|i was saying)\b"
#: (condition with context, class, confidence) in the order they are tried.
CASCADE_PATTERNS = {"discourse": (_DISCOURSE,), "positional": (*_POSITIONAL, *_TEMPORAL), "topical": _TOPICAL, "overview": _OVERVIEW, "anaphora": (_ANAPHORA, _DEMONSTRATIVE), "pronoun": (_PRONOUN,), "temporal": _TEMPORAL}


#: What is said for each outcome; the last two without a conversation.
REASONS = {
    "discourse": "Explicit discourse marker referencing previous conversation",
    "positional": "Positional reference to conversation history with context",
    "topical": "Query asks about topics discussed in our conversation",
    "overview": "Query requests summary of our conversation",
    "anaphora": "Anaphoric reference to previous conversation content",
    "pronoun": "Conversational pronouns present but no clear reference to conversation history",
    "none": "No conversational context or patterns detected",
    "strong": "Strong conversational markers present, but no session context available",
    "alone": "No conversation context exists - treating as general query",
}
#: What is tried with a conversation, in order: name, class and confidence; "none" always fits.
WITHIN = (("discourse", "POSITIONAL", 0.98), ("positional", "POSITIONAL", 0.95), ("topical", "TOPICAL", 0.92), ("overview", "OVERVIEW", 0.90), ("anaphora", "POSITIONAL", 0.85), ("pronoun", "GENERAL", 0.60), ("none", "GENERAL", 0.50))


def classify_query(query: Column, has_context: Column) -> dict[str, Column]:
    """classification, confidence, is_conversational and reasoning of a query, with or without a conversation before it."""
    low = F.lower(query)
    found = {k: [F.regexp_like(low, F.lit(ascii_edges(p))) for p in v] for k, v in CASCADE_PATTERNS.items()}
    says = {k: F.greatest(*v) if len(v) > 1 else v[0] for k, v in found.items()}
    says["anaphora"] = says["anaphora"] & says["pronoun"]
    outcome = lambda name, c, p: F.struct(F.lit(c).alias("c"), F.lit(p).alias("p"), F.lit(REASONS[name]).alias("r"))
    alone = F.when(says["discourse"] | (says["pronoun"] & says["temporal"]), outcome("strong", "POSITIONAL", 0.70)).otherwise(outcome("alone", "GENERAL", 0.95))
    within = outcome(*WITHIN[-1])
    for name, kind, sure in reversed(WITHIN[:-1]):
        within = F.when(says[name], outcome(name, kind, sure)).otherwise(within)
    got = F.when(F.coalesce(has_context, F.lit(False)), within).otherwise(alone)
    return {"classification": got["c"], "confidence": got["p"], "is_conversational": got["c"] != "GENERAL", "reasoning": got["r"]}


#: The form of a skill's name, the fields a contract needs, and what may run it.
SKILL_NAME = r"^[a-z][a-z0-9]*(\.[a-z][a-z0-9]*)+$"
REQUIRED = ("name", "description", "exec_path", "exec_type")
EXEC_TYPES = ("node", "shell", "python")


def frontmatter(contract: Column) -> Column:
    """The key: value lines between the first two --- lines as a map; null without such a block. The last value of a key counts."""
    block = F.regexp_extract(contract, r"^---\s*\n([\s\S]*?)\n---", 1)
    lines = F.filter(F.split(block, "\n"), lambda x: F.instr(x, ":") > 0)
    strip = lambda x: F.regexp_replace(x, "^[\"']|[\"']$", "")
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), strip(F.trim(F.substring(x, F.instr(x, ":") + 1, F.length(x)))).alias("value")))
    named = F.filter(pairs, lambda p: p["key"] != "")
    last = F.filter(named, lambda p, i: ~F.exists(F.slice(named, i + 2, F.greatest(F.size(named), F.lit(1))), lambda q: q["key"] == p["key"]))
    return F.when(F.regexp_like(contract, F.lit(r"^---\s*\n[\s\S]*?\n---")), F.map_from_entries(last))


def validate_contract(contracts: DataFrame, base: str, home: str = "", forbidden: Sequence[str] = (), column: str = "contract_md") -> DataFrame:
    """Adds fm (the frontmatter), exec_path resolved, and error: the first rule a contract breaks, or null.

    base: the folder that scripts must lie in; home: what ~ stands for; forbidden: strings the body must not hold.
    """
    held = contracts.withColumn("fm", frontmatter(F.col(column)))
    get = lambda k: F.col("fm")[k]
    path = F.when(get("exec_path").startswith("~/"), F.concat(F.lit(home.rstrip("/") + "/"), F.substring(get("exec_path"), 3, 1 << 20))).otherwise(get("exec_path"))
    held = held.withColumn("resolved_path", path).withColumn("body", F.regexp_replace(F.col(column), r"^---\s*\n[\s\S]*?\n---", ""))
    p, kind, body = F.col("resolved_path"), get("exec_type"), F.col("body")
    error = F.when(F.col("fm").isNull(), F.lit("no frontmatter"))
    for field in REQUIRED:
        error = error.when(F.coalesce(get(field), F.lit("")) == "", F.lit(f"missing field: {field}"))
    error = (
        error.when(~F.regexp_like(get("name"), F.lit(SKILL_NAME)), F.lit("invalid name"))
        .when(~kind.isin(*EXEC_TYPES), F.lit("invalid exec_type"))
        .when(~p.startswith(base), F.lit("path outside the skills folder"))
        .when((kind == "node") & p.endswith(".md"), F.lit("node needs a script"))
        .when((p.endswith(".cjs") | p.endswith(".js")) & (kind != "node"), F.lit("script needs node"))
        .when(p.endswith(".py") & (kind != "python"), F.lit("python file needs python"))
        .when((kind == "python") & ~p.endswith(".py"), F.lit("python needs a python file"))
        .when(F.regexp_count(body, F.lit("(?m)^```")) % 2 != 0, F.lit("odd number of fences"))
        .when(F.length(F.regexp_replace(body, r"^\s+|\s+$", "")) < 50, F.lit("body too short"))
    )
    for word in forbidden:
        error = error.when(body.contains(word), F.lit("forbidden content"))
    return held.withColumn("error", error).drop("body")
