"""Model messages as columns: decisions, arguments, routes, facts, compact states, event logs and safe provenance."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.functions.text import kind_of, strip_fences

# Fixed values.
SECRET_KEYS = r"(?i)gold|answer|label|reference|target"
SECRET_WORDS = ["gold", "answer", "label", "reference", "target"]
#: What may stand for an argument's kind, as schema_of_variant names it; a boolean passes as a number, as its language has it.
KINDS = {"str": ["STRING"], "int": ["BIGINT", "BOOLEAN"], "number": ["BIGINT", "BOOLEAN", "DOUBLE", "FLOAT", "DECIMAL"]}
#: What a policy is told after a repeated call, and once it has findings.
NOT_REPEAT = "This call was made before. Stop with final_answer if the findings suffice; ask something else if not."
HINT = "Stop with final_answer only if the findings answer the whole question; ask something else if not."


def decision(raw: Column) -> Column:
    """struct<kind, thought, plan, tool, args> of a loosely written decision, fences taken off: kind is final before tool before plan, else invalid.

    final_answer counts if it is neither false, 0, null nor empty; a tool is a text that is not blank; args that are no object are {}; a
    plan is a list, and its blank items are left out.
    """
    body = strip_fences(raw)
    v = F.try_parse_json(body)
    final, tool, thought = (F.get_json_object(body, f"$.{k}") for k in ("final_answer", "tool", "thought"))
    truthy = final.isNotNull() & ~F.lower(final).isin("", "false", "0", "0.0", "null", "[]", "{}")
    named = (kind_of(v, "$.tool") == "STRING") & (F.trim(F.coalesce(tool, F.lit(""))) != "")
    listed = F.filter(F.transform(F.from_json(F.get_json_object(body, "$.plan"), "array<string>"), lambda x: F.trim(x)), lambda x: x != "")
    plan = F.when(kind_of(v, "$.plan").startswith("ARRAY"), listed)
    args = F.when(kind_of(v, "$.args").startswith("OBJECT"), F.get_json_object(body, "$.args")).otherwise("{}")
    good = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    kind = F.when(good & truthy, "final").when(good & named, "tool").when(good & plan.isNotNull(), "plan").otherwise("invalid")
    return F.struct(kind.alias("kind"), F.trim(F.coalesce(thought, F.lit(""))).alias("thought"), plan.alias("plan"), F.when(kind == "tool", F.trim(tool)).alias("tool"), F.when(kind == "tool", args).alias("args"))


def argument_error(args: Column, schema: dict[str, tuple[str, bool]]) -> Column:
    """What is wrong with a JSON object of arguments, else null: unknown names, then the first argument that is missing or of another kind.

    schema: name to (str, int, number or anything else for any kind; required). A null counts as absent.
    """
    v = F.try_parse_json(args)
    unknown = F.array_sort(F.array_except(F.json_object_keys(args), F.array(*map(F.lit, schema)).cast("array<string>")))
    out = F.when(v.isNull() | ~F.schema_of_variant(v).startswith("OBJECT"), "args must be a JSON object")
    out = out.when(F.size(unknown) > 0, F.concat(F.lit("unknown args: "), F.array_join(unknown, ", ")))
    for name, (kind, required) in schema.items():
        said = kind_of(v, f"$['{name}']")
        none = said.isNull() | (said == "VOID")
        if required:
            out = out.when(none, f"missing required arg '{name}'")
        if kind in KINDS:
            out = out.when(~none & ~F.regexp_extract(said, "^([A-Z]+)", 1).isin(*KINDS[kind]), f"arg '{name}' must be {kind}")
    return out


def route(raw: Column, message: Column) -> Column:
    """struct<use_docs, use_memory, write_memory, query> of a router's JSON: a field that is absent is true, no JSON object means all of
    them, an empty message none; a query that is blank is the message."""
    body, said = strip_fences(raw), F.trim(F.coalesce(message, F.lit("")))
    v = F.try_parse_json(body)
    good = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))

    def flag(name: str) -> Column:
        kind, text = kind_of(v, f"$.{name}"), F.get_json_object(body, f"$.{name}")
        falsy = (kind == "VOID") | text.isin("", "0", "0.0", "false", "[]", "{}") & ~((kind == "STRING") & (text != ""))
        return (said != "") & F.coalesce(~good | kind.isNull() | ~falsy, F.lit(True))

    query = F.trim(F.coalesce(F.get_json_object(body, "$.rewritten_query"), F.lit("")))
    query = F.when(said == "", "").when(good & (query != ""), query).otherwise(said)
    return F.struct(*[flag(n).alias(n) for n in ("use_docs", "use_memory", "write_memory")], query.alias("query"))


FACT = "struct<fact_object:string,fact_content:string,visibility:string>"


def facts(raw: Column) -> Column:
    """array<struct<fact_object, fact_content, visibility>> of an extractor's JSON in any of three shapes: an object of facts, a list of
    them, or a list of such objects; facts without content are left out, and no JSON has none. visibility is as it stands."""
    body = strip_fences(raw)
    v = F.try_parse_json(body)
    fields = "fact_object string, fact_content string, visibility string, facts array<struct<fact_object:string,fact_content:string,visibility:string>>"
    one = F.from_json(body, f"struct<{fields.replace(' string', ':string').replace('facts array', 'facts:array').replace(', ', ',')}>")
    many = F.from_json(body, f"array<struct<{fields.replace(' string', ':string').replace('facts array', 'facts:array').replace(', ', ',')}>>")
    empty = F.array().cast(f"array<{FACT}>")
    flat = lambda x: F.struct(x["fact_object"].alias("fact_object"), x["fact_content"].alias("fact_content"), x["visibility"].alias("visibility"))
    listed = F.flatten(F.transform(many, lambda x: F.when(x["facts"].isNotNull(), x["facts"]).otherwise(F.array(flat(x)))))
    found = F.when(F.schema_of_variant(v).startswith("ARRAY"), listed).when(F.schema_of_variant(v).startswith("OBJECT"), one["facts"])
    clean = F.transform(F.coalesce(found, empty), lambda x: F.struct(F.trim(F.coalesce(x["fact_object"], F.lit(""))).alias("fact_object"), F.trim(F.coalesce(x["fact_content"], F.lit(""))).alias("fact_content"), x["visibility"].alias("visibility")))
    return F.filter(clean, lambda x: x["fact_content"] != "")


def safe_provenance(entries: Column) -> Column:
    """A map without the keys that may hold labels."""
    return F.map_filter(entries, lambda k, v: ~k.rlike(SECRET_KEYS))


def _safe(value: dict) -> dict | None:
    out = {}
    for k, v in value.items():
        if any(w in k.lower() for w in SECRET_WORDS):
            continue
        if isinstance(v, dict):
            if inner := _safe(v):
                out[k] = inner
        elif not isinstance(v, list) or not any(isinstance(x, (dict, list)) for x in v):
            out[k] = v
    return out or None


@F.pandas_udf(T.StringType())
def safe_json(text: pd.Series) -> pd.Series:
    """A JSON object without the keys, at any depth, that may hold labels, and without lists of lists or objects; null where nothing is left."""

    def one(s: str | None) -> str | None:
        try:
            value = json.loads(s)
        except (TypeError, ValueError):
            return None
        kept = _safe(value) if isinstance(value, dict) else None
        return json.dumps(kept, ensure_ascii=False, sort_keys=True) if kept else None

    return text.map(one)


def compact(observations: Column, last: int = 4, most: int = 5_000) -> Column:
    """The last few of array<string>, each cut."""
    return F.transform(F.slice(observations, -F.least(F.lit(last), F.greatest(F.size(observations), F.lit(1))), last), lambda x: F.substring(x, 1, most))


def state(question: Column, remaining: Column, tools: Column, history: Column, last_message: Column, budget: int = 24_000) -> Column:
    """What a policy is shown, as JSON with keys in order: calls so far, the last four findings (5,000 characters each), the last message (512)
    and a hint; beyond the budget without the findings, and beyond it still the question's beginning alone.

    history: array<struct<step_index, tool, args (JSON text), ok, error, observation>>.
    """
    calls = F.transform(history, lambda e: F.struct(*[e[k].alias(k) for k in ("args", "error", "ok", "step_index", "tool")]))
    found = F.transform(F.filter(history, lambda e: F.coalesce(e["ok"], F.lit(False)) & (F.coalesce(e["observation"], F.lit("")) != "")), lambda e: e["observation"])
    message = F.coalesce(last_message, F.lit(""))
    again = F.contains(F.lower(message), F.lit("duplicate call"))
    hint = F.when(~again & (F.size(calls) > 0) & (F.size(found) > 0), HINT)

    def said(**fields: Column) -> Column:
        return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))

    asked = F.coalesce(question, F.lit(""))
    whole = said(available_tools=tools, decision_hint=hint, last_message=F.substring(message, 1, 512), previous_tool_calls=calls, question=asked, remaining_steps=remaining, required_next_action=F.when(again, NOT_REPEAT), retrieved_evidence=compact(found))
    less = said(available_tools=tools, last_message=F.substring(message, 1, 128), observation_truncated=F.lit(True), previous_tool_calls=calls, question=F.substring(asked, 1, max(budget // 3, 64)), remaining_steps=remaining)
    least = said(observation_truncated=F.lit(True), question=F.substring(asked, 1, 64), remaining_steps=remaining)
    return F.when(F.length(whole) <= budget, whole).when(F.length(less) <= budget, less).otherwise(least)


def tiered(events: Column, budget: int = 24_000) -> Column:
    """Tool events as JSON: whole if the budget allows, else with each observation cut to its share of the budget, else a summary.

    events: array<struct<step_index, tool, args (JSON text), ok, observation>>.
    """
    share = F.greatest(F.floor(F.lit(budget) / F.greatest(F.size(events), F.lit(1))) - 160, F.lit(64)).cast("int")
    row = lambda e, names, n, cut: F.struct(*[e[k].alias(k) for k in names], F.substring(e["observation"], F.lit(1), n).alias("observation"), cut.alias("observation_truncated"))
    whole = F.to_json(events)
    long = lambda e: F.when(F.length(e["observation"]) > share, F.lit(True))
    shared = F.to_json(F.transform(events, lambda e: row(e, ("step_index", "tool", "args", "ok"), share, long(e))))
    summary = F.to_json(F.transform(events, lambda e: row(e, ("step_index", "tool", "ok"), F.lit(64), F.lit(True))))
    return F.when(F.length(whole) <= budget, whole).when(F.length(shared) <= budget, shared).otherwise(summary)


def trajectory(steps: Column) -> Column:
    """Steps as lines to read: array<struct<step_index, tool, args, ok, error, thought, observation>>."""

    def line(s: Column) -> Column:
        status = F.when(F.coalesce(s["ok"], F.lit(False)), "ok").otherwise(F.concat(F.lit("ERROR: "), F.coalesce(s["error"], F.lit("None"))))
        called = F.concat(s["tool"], F.lit("("), F.coalesce(s["args"], F.lit("{}")), F.lit(") -> "))
        head = F.concat(F.lit("["), s["step_index"].cast("string"), F.lit("] "), F.coalesce(called, F.lit("")), status)
        more = lambda name, key, n: F.when(F.coalesce(s[key], F.lit("")) != "", F.concat(F.lit(f"\n    {name}: "), F.substring(s[key], 1, n))).otherwise("")
        return F.concat(head, more("thought", "thought", 1 << 30), more("obs", "observation", 300))

    return F.array_join(F.transform(steps, line), "\n")
