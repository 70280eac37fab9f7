"""Chat formatting with tool-call linking.

Rows (conv_id, turn, role, text) become canonical JSON records. An assistant
text that is a JSON object with ``tool_calls`` (a list of objects with ``id``,
``name`` and ``arguments``) makes calls; a ``tool`` text that is a JSON object
with ``tool_call_id`` is a result. Results are hash-joined to the calls of their
conversation by identifier. Messages stand in topological order: by turn, but a
result waits until its call has been made. Arguments are validated against the
tool's schema. Records are serialised with sorted keys and no blanks.

A record holds the messages of ``part_turns`` turns, and where these are more
than ``record_messages`` messages, runs of so many of them: no conversation, turn
or missing key of any size is ever gathered in one task.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from skein.operators.pairs import numbered

from .common import bounded, cut

PART_TURNS = 256
#: Messages of a record at most.
RECORD_MESSAGES = 4_096
#: Tools that a table may describe.
MOST_TOOLS = 10_000

#: Schemas of the tools whose arguments are checked by default: name -> JSON schema.
SCHEMAS: dict[str, dict] = {}

#: Types of JSON Schema, and keywords that describe and never reject.
_TYPES = ("object", "array", "string", "boolean", "null", "number", "integer")
_NOTES = {"$schema", "$id", "$comment", "$defs", "definitions", "title", "description", "default", "examples", "format", "deprecated", "readOnly", "writeOnly"}
_KEYWORDS = {
    "type", "enum", "const", "allOf", "anyOf", "oneOf", "not", "$ref", "properties", "required", "additionalProperties", "minProperties", "maxProperties", "items", "minItems", "maxItems",
    "uniqueItems", "minLength", "maxLength", "pattern", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf",
}

_SURROGATE = re.compile("[\ud800-\udfff]")


def canonical(value) -> str:
    """JSON with sorted keys, no blanks and raw non-ASCII characters.

    Lone surrogates, which no encoding holds, stay escapes. Values that JSON has
    no form for (not finite) raise ``ValueError``.
    """
    text = json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"), allow_nan=False)
    return _SURROGATE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


# Schemas --------------------------------------------------------------------------


def checked_schema(schema, root=None):
    """The schema itself; ``ValueError`` if it uses what ``valid`` does not know."""
    root = schema if root is None else root
    if isinstance(schema, bool):
        return schema
    if not isinstance(schema, dict):
        raise ValueError("a schema is an object or a boolean")
    unknown = set(schema) - _KEYWORDS - _NOTES
    if unknown:
        raise ValueError(f"unknown keywords {sorted(unknown)}")
    kinds = schema.get("type", [])
    for kind in [kinds] if isinstance(kinds, str) else kinds:
        if kind not in _TYPES:
            raise ValueError(f"unknown type {kind!r}")
    if "$ref" in schema:
        _referred(schema["$ref"], root)
    if "pattern" in schema:
        re.compile(schema["pattern"])
    below = [*schema.get("properties", {}).values(), *schema.get("$defs", {}).values(), *schema.get("definitions", {}).values()]
    below += [x for k in ("allOf", "anyOf", "oneOf") for x in schema.get(k, ())] + [schema[k] for k in ("not", "items", "additionalProperties") if k in schema]
    for x in below:
        checked_schema(x, root)
    return schema


def _referred(ref: str, root):
    if not isinstance(ref, str) or not ref.startswith("#"):
        raise ValueError(f"only references within the schema are known, not {ref!r}")
    at = root
    for name in ref[1:].split("/")[1:]:
        name = name.replace("~1", "/").replace("~0", "~")
        if not isinstance(at, dict) or name not in at:
            raise ValueError(f"nothing at {ref!r}")
        at = at[name]
    return at


def _plain(value):
    """A form in which equal JSON values are equal (1 and 1.0 are, 1 and true are not)."""
    if isinstance(value, bool) or value is None:
        return (str(value),)
    if isinstance(value, (int, float)):
        return int(value) if value == int(value) else value
    if isinstance(value, list):
        return ("list", *map(_plain, value))
    if isinstance(value, dict):
        return ("dict", *sorted((k, _plain(v)) for k, v in value.items()))
    return value


def _is(value, kind: str) -> bool:
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if kind == "integer":
        return number and value == int(value)
    if kind == "number":
        return number
    return isinstance(value, {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}[kind])


def valid(value, schema, root=None) -> bool:
    """Whether a value meets a JSON schema.

    The keywords are those of ``_KEYWORDS``; ``items`` and ``additionalProperties``
    take a schema or a boolean, references stay within the schema. A number
    without a fraction is an integer. Schemas with other keywords are refused by
    ``checked_schema`` before any row is read.
    """
    root = schema if root is None else root
    if isinstance(schema, bool):
        return schema
    if "$ref" in schema and not valid(value, _referred(schema["$ref"], root), root):
        return False
    if "type" in schema:
        kinds = schema["type"]
        if not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
            return False
    if "enum" in schema and _plain(value) not in [_plain(x) for x in schema["enum"]]:
        return False
    if "const" in schema and _plain(value) != _plain(schema["const"]):
        return False
    if not all(valid(value, x, root) for x in schema.get("allOf", ())):
        return False
    if "anyOf" in schema and not any(valid(value, x, root) for x in schema["anyOf"]):
        return False
    if "oneOf" in schema and sum(valid(value, x, root) for x in schema["oneOf"]) != 1:
        return False
    if "not" in schema and valid(value, schema["not"], root):
        return False
    if isinstance(value, dict):
        known, more = schema.get("properties", {}), schema.get("additionalProperties", True)
        if any(k not in value for k in schema.get("required", ())):
            return False
        if not schema.get("minProperties", 0) <= len(value) <= schema.get("maxProperties", len(value)):
            return False
        return all(valid(v, known[k] if k in known else more, root) for k, v in value.items())
    if isinstance(value, list):
        if not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", len(value)):
            return False
        if schema.get("uniqueItems") and len({_plain(x) for x in value}) < len(value):
            return False
        return all(valid(v, schema.get("items", True), root) for v in value)
    if isinstance(value, str):
        return schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)) and ("pattern" not in schema or re.search(schema["pattern"], value) is not None)
    if _is(value, "number"):
        if not schema.get("minimum", value) <= value <= schema.get("maximum", value):
            return False
        if "exclusiveMinimum" in schema and value <= schema["exclusiveMinimum"] or "exclusiveMaximum" in schema and value >= schema["exclusiveMaximum"]:
            return False
        return "multipleOf" not in schema or math.isclose(value / schema["multipleOf"], round(value / schema["multipleOf"]), rel_tol=1e-12, abs_tol=1e-12)
    return True


def tool_schemas(tools: DataFrame) -> dict[str, dict]:
    """Schemas from rows (name, schema as JSON), at most ``MOST_TOOLS`` of them; of
    rows that share a name the one whose text comes first counts."""
    rows = tools.select("name", "schema").filter("name IS NOT NULL AND schema IS NOT NULL").distinct().limit(MOST_TOOLS + 1).collect()
    if len(rows) > MOST_TOOLS:
        raise ValueError(f"more than {MOST_TOOLS} tools")
    return {name: json.loads(schema) for name, schema in sorted(((r["name"], r["schema"]) for r in rows), reverse=True)}


# Messages -----------------------------------------------------------------------------


def _not_json(name: str):
    raise ValueError(f"{name} is not JSON")


def _number(text: str) -> float:
    value = float(text)
    return value if math.isfinite(value) else _not_json(text)


def _object(text: str | None) -> dict:
    """The JSON object that a text is, or an empty one. ``NaN``, infinities and
    numbers too large for a double are not JSON here."""
    if not text or not text.lstrip()[:1] == "{":
        return {}
    try:
        value = json.loads(text, parse_constant=_not_json, parse_float=_number)
    except (ValueError, RecursionError):
        return {}
    return value if isinstance(value, dict) else {}


def message(turn, role, text, schemas: dict[str, dict]) -> tuple[str, list[str], int, str | None]:
    """(canonical message, its calls' ids, invalid calls, id that it answers).

    Identifiers are given as canonical JSON strings. An object nested too deeply
    to be written or checked counts as plain text.
    """
    try:
        return _structured(turn, role, text, schemas)
    except RecursionError:
        return canonical({"content": text, "role": role, "turn": turn}), [], 0, None


def _structured(turn, role, text, schemas):
    out = {"content": text, "role": role, "turn": turn}
    ids, wrong, answers = [], 0, None
    if role == "assistant":
        body = _object(text)
        calls = body.get("tool_calls")
        if isinstance(calls, list) and calls and all(isinstance(c, dict) and isinstance(c.get("id"), str) for c in calls):
            made = []
            for c in calls:
                arguments, name = c.get("arguments"), c.get("name")
                if isinstance(arguments, str):  # JSON within JSON
                    arguments = _object(arguments) or ({} if arguments.strip() == "{}" else arguments)
                good = isinstance(name, str) and isinstance(arguments, dict) and valid(arguments, schemas.get(name, {}))
                wrong += not good
                ids.append(canonical(c["id"]))
                made.append({"arguments": arguments, "id": c["id"], "name": name, "valid": good})
            out["tool_calls"], out["content"] = made, body.get("content")
    elif role == "tool":
        body = _object(text)
        if isinstance(body.get("tool_call_id"), str):
            out["content"], out["tool_call_id"] = body.get("content"), body["tool_call_id"]
            answers = canonical(body["tool_call_id"])
    return canonical(out), ids, wrong, answers


PARSED = "conv_id bigint, turn bigint, message string, calls array<string>, n_invalid bigint, answers string"


def _parser(schemas):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turns, roles, texts = (batch.column(i).to_pylist() for i in (1, 2, 3))
            rows = [message(*row, schemas) for row in zip(turns, roles, texts)]
            made, calls, wrong, answers = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(made, pa.string()), pa.array(calls, pa.list_(pa.string())), pa.array(wrong, pa.int64()), pa.array(answers, pa.string())],
                ["conv_id", "turn", "message", "calls", "n_invalid", "answers"],
            )

    return run


def _chunked(placed: DataFrame, most: int) -> DataFrame:
    """Add ``chunk``: 0, or for a record of more than ``most`` messages the run of so
    many, in order, that a message is in.

    Rows of such records are range-partitioned by the whole order, so that not one
    record is ever one task's.
    """
    key = ["conv_id", "part"]
    sizes = placed.groupBy(*key).agg(F.count("*").alias("_n")).filter(F.col("_n") > most)
    hot = cut(sizes.select(F.struct(*key).alias("_key")))
    if hot.isEmpty():
        return placed.withColumn("chunk", F.lit(0).cast("long"))
    keyed = placed.withColumn("_key", F.struct(*key))
    marked = cut(keyed.join(bounded(hot.withColumn("_hot", F.lit(True))).withColumnRenamed("_key", "_k"), F.col("_key").eqNullSafe(F.col("_k")), "left").drop("_k"))
    many = numbered(marked.filter("_hot"), ["_key", "_at"], "_place")
    first = many.groupBy("_key").agg(F.min("_place").alias("_first")).withColumnRenamed("_key", "_k")
    many = many.join(bounded(cut(first)), F.col("_key").eqNullSafe(F.col("_k"))).withColumn("chunk", F.floor((F.col("_place") - F.col("_first")) / F.lit(most)).cast("long"))
    few = marked.filter("_hot IS NULL").withColumn("chunk", F.lit(0).cast("long"))
    columns = [*placed.columns, "chunk"]
    return few.select(*columns).unionByName(many.select(*columns))


def records(messages: DataFrame, schemas: dict[str, dict] | DataFrame | None = None, *, part_turns: int = PART_TURNS, record_messages: int = RECORD_MESSAGES) -> DataFrame:
    """Canonical records of conversations.

    Returns ``conv_id``, ``part`` (the turns ``part * part_turns`` and on; a
    linked result counts with its call), ``chunk`` (0, or the run of
    ``record_messages`` messages of a part that has more), ``n_messages``,
    ``n_calls``, ``n_linked`` (results with a call), ``n_orphans`` (results
    without), ``n_invalid`` (calls whose arguments fail their schema or are no
    object) and ``record``. Identical rows are one message; of calls that share an
    identifier the earliest counts; messages of the same turn stand by their JSON;
    a null turn comes before all others, in part -1; rows without ``conv_id`` are
    one conversation (whose results have no calls); null text is null content;
    text that is no JSON object (``NaN`` included) is plain content; lone
    surrogates stay escapes; an empty table gives no rows.

    ``schemas``: name -> JSON schema, or a table (name, schema). Keywords that
    ``valid`` does not know are refused; tools without a schema take any object.
    Other columns are ignored.
    """
    schemas = tool_schemas(schemas) if isinstance(schemas, DataFrame) else SCHEMAS if schemas is None else schemas
    for schema in schemas.values():
        checked_schema(schema)
    columns = [F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text"]
    parsed = messages.select(*columns).mapInArrow(_parser(schemas), PARSED)
    parsed = parsed.groupBy("conv_id", "turn", "message").agg(F.first("calls").alias("calls"), F.first("n_invalid").alias("n_invalid"), F.first("answers").alias("answers"))
    parsed = cut(parsed)
    calls = parsed.filter(F.size("calls") > 0).select(F.col("conv_id").alias("c"), F.col("turn").alias("call_turn"), F.explode("calls").alias("id"))
    calls = calls.groupBy("c", "id").agg(F.min(F.struct(F.coalesce("call_turn", F.lit(-1)).alias("t"))).alias("call"))
    # Only results look for a call, so that no other row is dealt by conversation here.
    results = parsed.filter("answers IS NOT NULL").join(calls, (F.col("conv_id") == F.col("c")) & (F.col("answers") == F.col("id")), "left").drop("c", "id")
    linked = parsed.filter("answers IS NULL").withColumn("call", F.lit(None).cast("struct<t:bigint>")).unionByName(results)
    turn = F.coalesce("turn", F.lit(-1))
    # A linked result waits for its call: it follows it at once if its turn was earlier.
    waits = F.col("call").isNotNull() & (F.col("call.t") >= turn)
    at = F.struct(F.when(waits, F.col("call.t")).otherwise(turn).alias("turn"), waits.cast("int").alias("waits"), turn.alias("own"), F.col("message").alias("message"))
    linked = linked.withColumn("_at", at).withColumn("part", F.floor(F.col("_at.turn") / F.lit(part_turns)).cast("long"))
    placed = _chunked(linked.select("conv_id", "part", "_at", F.size("calls").alias("calls"), "call", "answers", "n_invalid"), record_messages)
    own = placed.groupBy("conv_id", "part", "chunk").agg(
        F.count("*").alias("n_messages"),
        F.sum("calls").cast("long").alias("n_calls"),
        F.count("call").alias("n_linked"),
        (F.count("answers") - F.count("call")).alias("n_orphans"),
        F.sum("n_invalid").cast("long").alias("n_invalid"),
        F.array_join(F.transform(F.array_sort(F.collect_list("_at")), lambda x: x["message"]), ",").alias("_messages"),  # at most record_messages
    )
    id_, part, chunk = F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), F.col("part").cast("string"), F.col("chunk").cast("string")
    record = F.concat(F.lit('{"chunk":'), chunk, F.lit(',"conv_id":'), id_, F.lit(',"messages":['), F.col("_messages"), F.lit('],"part":'), part, F.lit("}"))
    return own.withColumn("record", record).drop("_messages")


def digest(made: DataFrame) -> DataFrame:
    """The result columns of the registered query."""
    return made.withColumn("record_sha256", F.sha2("record", 256)).drop("record")


#: Calls, results, their links and the records in DuckDB. Rows whose text is no call
#: and no result are serialised; linked results of an earlier turn are moved to their call.
ORACLE = r"""
WITH c0 AS (SELECT DISTINCT conv_id, turn, role, text, CASE WHEN starts_with(ltrim(text), '{') THEN TRY_CAST(text AS JSON) END AS body FROM conversations),
c1 AS (SELECT *, CASE WHEN role = 'assistant' AND json_type(body, '$.tool_calls') = 'ARRAY' THEN json_array_length(body, '$.tool_calls') ELSE 0 END AS n_calls,
       CASE WHEN role = 'tool' AND json_type(body, '$.tool_call_id') = 'VARCHAR' THEN body ->> '$.tool_call_id' END AS answers FROM c0),
k AS (SELECT conv_id, id, min(turn) AS t FROM (SELECT conv_id, turn, unnest(json_extract_string(body, '$.tool_calls[*].id')) AS id FROM c1 WHERE n_calls > 0) GROUP BY conv_id, id),
m AS (SELECT c1.*, k.t, CASE WHEN k.t >= turn THEN k.t ELSE turn END AS place, coalesce(k.t >= turn, false) AS waits, CAST(CASE WHEN answers IS NULL THEN json_object('content', text, 'role', role, 'turn', turn)
       ELSE json_object('content', json_extract(body, '$.content'), 'role', role, 'tool_call_id', answers, 'turn', turn) END AS VARCHAR) AS message
      FROM c1 LEFT JOIN k ON c1.conv_id = k.conv_id AND c1.answers = k.id)
SELECT conv_id, place // 256 AS part, CAST(0 AS BIGINT) AS chunk, count(*) AS n_messages, CAST(sum(n_calls) AS BIGINT) AS n_calls, count(t) AS n_linked, count(answers) - count(t) AS n_orphans, CAST(0 AS BIGINT) AS n_invalid,
       sha256('{"chunk":0,"conv_id":' || conv_id || ',"messages":[' || string_agg(message, ',' ORDER BY place, waits, turn, message) || '],"part":' || (place // 256) || '}') AS record_sha256
FROM m GROUP BY conv_id, place // 256
"""
