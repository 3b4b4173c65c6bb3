"""Chat formatting: tool calls linked to their results, put in order, validated, written as canonical JSON."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feira.llm.common import prepare, ranked, table
from feira.session import write_and_read

_TYPES = {
    "string": "^STRING",
    "integer": "^BIGINT",
    "number": "^(BIGINT|DECIMAL|DOUBLE|FLOAT)",
    "boolean": "^BOOLEAN",
    "array": "^ARRAY<",
    "object": "^OBJECT<",
}


def argument_errors(name: Column, arguments: Column, parsed: Column, schemas: dict[str, dict]) -> Column:
    """What is wrong with a call's arguments (JSON text) under its tool's schema, as an array of texts.

    ``parsed`` is the arguments as a variant, a column of its own so that it is parsed once.
    Schemas use a part of JSON Schema: type, required, properties, additionalProperties, enum, minimum,
    maximum, minLength, maxLength. They are parameters of bounded size and become one expression.
    """
    out = F.array(F.concat(F.lit("unknown tool "), F.coalesce(name, F.lit("null"))))
    for tool, schema in schemas.items():
        checks = []
        for key, rule in schema.get("properties", {}).items():
            value = F.try_variant_get(parsed, f"$.{key}", "variant")
            missing = value.isNull()
            if key in schema.get("required", ()):
                checks.append(F.when(missing, F.lit(f"{key} is missing")))
            if "type" in rule:
                fits = F.schema_of_variant(value).rlike(_TYPES[rule["type"]])
                checks.append(F.when(~missing & ~fits, F.lit(f"{key} is not of type {rule['type']}")))
            text = F.try_variant_get(parsed, f"$.{key}", "string")
            number = F.try_variant_get(parsed, f"$.{key}", "double")
            length = F.char_length(text)
            bounds = (
                ("minimum", number < rule.get("minimum")) if "minimum" in rule else None,
                ("maximum", number > rule.get("maximum")) if "maximum" in rule else None,
                ("minLength", length < rule.get("minLength")) if "minLength" in rule else None,
                ("maxLength", length > rule.get("maxLength")) if "maxLength" in rule else None,
                ("enum", ~text.isin(rule.get("enum"))) if "enum" in rule else None,
            )
            checks += [F.when(broken, F.lit(f"{key} breaks {what}")) for what, broken in filter(None, bounds)]
        if schema.get("additionalProperties") is False:
            extra = F.array_except(F.json_object_keys(arguments), F.array(*map(F.lit, schema["properties"])))
            checks.append(F.when(F.size(extra) > 0, F.concat(F.lit("unknown: "), F.array_join(F.array_sort(extra), ","))))
        errors = F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")
        out = F.when(name == tool, errors).otherwise(out)
    broken = parsed.isNull() | ~F.schema_of_variant(parsed).startswith("OBJECT")
    return F.when(broken, F.array(F.lit("arguments are not a JSON object"))).otherwise(out)


def depths(calls: DataFrame) -> DataFrame:
    """(key, depth, cyclic) from (key, parent): how many calls a call follows, by pointer doubling.

    In each round a call adds the depth that its pointer's target has gathered and moves the pointer on to
    the target's, so a chain of n is done in log2(n) rounds. Pointers left after that many run in a circle.
    """
    known = calls.select(F.col("key").alias("parent_key"))
    start = calls.join(known, F.col("parent") == F.col("parent_key"), "left")
    state = start.select("key", F.col("parent_key").alias("at"), F.col("parent_key").isNotNull().cast("long").alias("depth"))
    state = write_and_read(state, "depths")
    for _ in range(math.ceil(math.log2(max(state.count(), 2))) + 1):
        if not state.filter("at is not null").head(1):
            break
        target = state.select(F.col("key").alias("to"), F.col("at").alias("next"), F.col("depth").alias("more"))
        moved = state.join(target, F.col("at") == F.col("to"), "left")
        state = write_and_read(
            moved.select("key", F.col("next").alias("at"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")),
            "depths",
        )
    cyclic = F.col("at").isNotNull()
    return state.select("key", F.when(~cyclic, F.col("depth")).alias("depth"), cyclic.alias("cyclic"))


def link(
    calls: DataFrame,
    results: DataFrame,
    schemas: dict[str, dict],
    every_result: bool = False,
    other_turns: DataFrame | None = None,
) -> DataFrame:
    """One row per call and per result without a call: conv_id, call_id, position, status, errors, json.

    ``calls``: conv_id, call_id, turn, name, arguments (JSON text), after (the call that it waits for, or null).
    ``results``: conv_id, call_id, turn, content. They are joined by conversation and identifier. ``position``
    numbers a conversation's rows so that a call comes after the one that it waits for: by depth in the chain of
    ``after``, then turn, then identifier. ``json`` has keys in order, no blanks, and the arguments rewritten
    with theirs in order.

    Status, the first that holds: orphan (a result without a call), repeated (a later call with an identifier
    already taken in the conversation, or all of the same turn but one), cyclic (its ``after`` runs in a
    circle; ordered last), invalid (``errors`` says why), early (its result stands before it), open (no result),
    ok. Of several results for an identifier the first by turn counts; with ``every_result`` each of the others is a
    row of its own, ordered last, with the status repeated result. ``other_turns`` (conv_id, turn, role, content) are
    neither calls nor results; each is a row ordered last, named by its role, with the status no call.

    * Null conv_id or call_id are never linked: such a call is open or invalid, such a result an orphan. An
      ``after`` that names no call counts as null.
    * Null arguments are invalid; null content stays null. Empty tables give no rows. Other columns are
      not read.

    Texts move once: calls and results meet in one aggregate by (conversation, identifier), which keeps the first of
    either and collapses repeats before its shuffle. All that decides order goes on without texts, with a hash
    in place of each. Repeated calls, orphans and rows without identifiers are found by a written table of such
    identifiers, broadcast by Spark where it is small. Nothing gathers a conversation.
    """
    prepare(calls.sparkSession)
    ids = ["conv_id", "call_id"]
    no_text = F.lit(None).cast("string")
    rows = calls.select(*ids, F.col("turn").cast("long").alias("turn"), "name", F.col("arguments").alias("text"), "after", F.lit(True).alias("is_call"))
    rows = rows.union(
        results.select(*ids, F.col("turn").cast("long").alias("turn"), no_text, F.col("content"), no_text, F.lit(False))
    )
    if other_turns is not None:
        role = F.coalesce("role", F.lit("no role"))
        turn = F.col("turn").cast("long").alias("turn")
        rows = rows.union(other_turns.select("conv_id", no_text, turn, role, F.col("content"), no_text, F.lit(False)))
    rows = rows.withColumn("digest", F.xxhash64("name", "text"))
    keyed = rows.filter(F.col("conv_id").isNotNull() & F.col("call_id").isNotNull())
    is_call = F.col("is_call")

    heads = keyed.groupBy(*ids).agg(
        F.min(F.when(is_call, F.struct("turn", "digest", "after"))).alias("call"), F.count_if(is_call).alias("n_calls"),
        F.count_if(~is_call).alias("n_results"),
    )
    heads = write_and_read(heads, "calls")
    others = _others(rows, heads.filter("n_calls <> 1 or n_results > 1" if every_result else "n_calls <> 1"), every_result)

    firsts = heads.filter("n_calls > 0").select(*ids, "call.*")
    key = F.to_json(F.struct(*ids))
    parent = F.when(F.col("after").isNotNull(), F.to_json(F.struct("conv_id", F.col("after").alias("call_id"))))
    depth = depths(firsts.select(key.alias("key"), parent.alias("parent"))).withColumnRenamed("key", "_depth_key")
    slim = firsts.join(depth, key == F.col("_depth_key"))
    last = F.lit(1 << 62)
    slim = slim.select(*ids, "turn", "digest", F.lit(None).cast("long").alias("_row"), F.coalesce("depth", last).alias("_late"), "cyclic")
    slim = slim.union(others.select(*ids, "turn", "digest", "_row", last, F.lit(False)))
    places = ranked(slim, ["conv_id"], ["_late", "turn", "call_id", "digest"])

    one = F.when(is_call, F.struct("turn", "digest", "after", "name", "text"))
    answer = F.when(~is_call, F.struct("turn", "digest", "text"))
    pairs = keyed.groupBy(*ids).agg(F.min(one).alias("call"), F.min(answer).alias("answer"))
    pairs = pairs.join(places.filter("_row is null").select(*ids, "_rank", "cyclic"), ids)
    status = (
        F.when(F.col("cyclic"), "cyclic")
        .when(F.size("errors") > 0, "invalid")
        .when(F.col("answer.turn") < F.col("call.turn"), "early")
        .when(F.col("answer").isNull(), "open")
        .otherwise("ok")
    )
    pairs = pairs.select(
        *ids, "_rank", "cyclic", "call", "answer", F.col("call.name").alias("name"), F.col("call.text").alias("arguments"), F.col("answer.text").alias("result")
    )
    checked = argument_errors(F.col("name"), F.col("arguments"), F.col("_parsed"), schemas)
    pairs = pairs.withColumn("_parsed", F.try_parse_json("arguments"))
    pairs = pairs.withColumn("errors", checked).withColumn("status", status)

    rest = others.join(places.filter("_row is not null").select("_row", "_rank"), "_row")
    argument, content = F.when(is_call, F.col("text")), F.when(~is_call, F.col("text"))
    rest = rest.select(*ids, "_rank", "is_call", "is_repeat", "name", argument.alias("arguments"), content.alias("result"))
    errors = F.when(is_call, checked).otherwise(F.array().cast("array<string>"))
    rest = rest.withColumn("_parsed", F.try_parse_json("arguments"))
    status = (
        F.when(~is_call & F.col("name").isNotNull(), "no call")
        .when(~is_call & F.col("is_repeat"), "repeated result")
        .when(~is_call, "orphan")
        .when(F.col("is_repeat"), "repeated").when(F.size("errors") > 0, "invalid").otherwise("open")
    )
    rest = rest.withColumn("errors", errors).withColumn("status", status)

    columns = [*ids, "_rank", "name", "arguments", "_parsed", "result", "errors", "status"]
    both = pairs.select(*columns).union(rest.select(*columns))
    return both.select(*ids, F.col("_rank").alias("position"), "status", "errors", canonical().alias("json"))


def _others(rows: DataFrame, odd: DataFrame, every_result: bool) -> DataFrame:
    """Rows that are no first call and no answer, with a row number: repeated calls and, if wanted, results, orphans,
    rows without identifiers.

    ``odd`` has the identifiers of no call, or of several calls or results, with their numbers.
    """
    ids = ["conv_id", "call_id"]
    odd = write_and_read(odd.select(*ids, "n_calls"), "odd-calls")
    kept = ["conv_id", "call_id", "turn", "name", "text", "after", "is_call", "digest"]
    is_call, n_calls = F.col("is_call"), F.col("n_calls")
    wanted = is_call & (n_calls > 1) | ~is_call & (F.lit(every_result) | (n_calls == 0))
    found = rows.join(odd, ids).filter(wanted).select(*kept, (n_calls > 0).alias("is_repeat"))
    loose = rows.filter(F.col("conv_id").isNull() | F.col("call_id").isNull()).select(*kept, F.lit(False))
    others = write_and_read(found.union(loose).withColumn("_row", F.monotonically_increasing_id()), "other-calls")
    # Of the repeats of a call, and of a result, the first is the one that is linked.
    order = F.min(F.struct("turn", "digest", "after", "_row"))
    first = others.filter("is_repeat").groupBy(*ids, "is_call").agg(order["_row"].alias("_row"))
    first = write_and_read(first.select("_row"), "repeated-firsts")
    return others.join(first, "_row", "left_anti")


def canonical() -> Column:
    """The row as JSON: keys in order, no blanks, nulls kept; arguments that are no JSON stay a text."""
    parsed = F.col("_parsed")
    fields = {
        "arguments": parsed,
        "call_id": F.col("call_id"),
        "conv_id": F.col("conv_id"),
        "errors": F.col("errors"),
        "name": F.col("name"),
        "position": F.col("_rank"),
        "result": F.col("result"),
        "status": F.col("status"),
    }
    whole = F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]), {"ignoreNullFields": "false"})
    text = F.to_json(F.struct(*[(F.col("arguments") if k == "arguments" else c).alias(k) for k, c in fields.items()]), {"ignoreNullFields": "false"})
    return F.when(parsed.isNull(), text).otherwise(whole)


# Tools that the conversations are read as: a user's turn asks, the assistant's next turn answers.
TOOLS = {
    "answer": {
        "properties": {
            "text": {"type": "string", "minLength": 1, "maxLength": 1500},
            "lines": {"type": "integer", "minimum": 1, "maximum": 12},
            "words": {"type": "integer", "minimum": 3},
        },
        "required": ["text", "lines"],
        "additionalProperties": False,
    },
    "translate": {
        "properties": {"text": {"type": "string", "minLength": 1}, "script": {"type": "string", "enum": ["latin"]}},
        "required": ["text", "script"],
    },
}


def as_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results read from conversations (conv_id, turn, role, text).

    A user's turn t is call ``t<t>``: of ``translate`` if it has letters beyond ASCII, else of ``answer``. It waits for the
    call of turn t - 2. An assistant's turn t is the result of call ``t<t - 1>``.
    """
    text = F.coalesce("text", F.lit(""))
    plain = F.octet_length(text) == F.char_length(text)
    user = turns.filter("role = 'user'")
    words = F.size(F.array_remove(F.split(text, r"\s+"), ""))
    answer = F.to_json(F.struct(words.alias("words"), text.alias("text"), F.size(F.split(text, "\n")).alias("lines")))
    translate = F.to_json(F.struct(text.alias("text"), F.lit("latin").alias("script")))
    calls = user.select(
        "conv_id",
        F.concat(F.lit("t"), F.col("turn")).alias("call_id"),
        "turn",
        F.when(plain, "answer").otherwise("translate").alias("name"),
        F.when(plain, answer).otherwise(translate).alias("arguments"),
        F.when(F.col("turn") >= 2, F.concat(F.lit("t"), F.col("turn") - 2)).alias("after"),
    )
    results = turns.filter("role = 'assistant'").select(
        "conv_id", F.concat(F.lit("t"), F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content")
    )
    return calls, results


def other_turns(turns: DataFrame) -> DataFrame:
    """Turns of neither the user nor the assistant, those without a role too."""
    other = ~F.coalesce(F.col("role").isin("user", "assistant"), F.lit(False))
    return turns.filter(other).select("conv_id", "turn", "role", F.col("text").alias("content"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations")
    calls, results = as_calls(turns)
    out = link(calls, results, TOOLS, every_result=True, other_turns=other_turns(turns))
    return out.select("conv_id", "call_id", "position", "status", F.array_join("errors", "; ").alias("errors"), "json")
