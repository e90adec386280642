"""Tool-call linking, in DataFrame functions only.

Calls and results are hash-joined by identifier, calls are put in topological order of what they wait for,
arguments are checked against the tool's schema, and each linked call is serialised as canonical JSON (keys in
order, no blanks).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, table

#: Spark's names of JSON types by the names that schemas use.
TYPES = {"string": "STRING", "integer": "BIGINT", "number": "(BIGINT|DECIMAL.*|DOUBLE)", "boolean": "BOOLEAN", "array": "ARRAY.*", "object": "OBJECT.*"}


def _anchors(waits: DataFrame, calls: int) -> DataFrame:
    """call_id, to, dist: the next call up the line that waits for none or for several, and how many steps away it is.

    waits: call_id, many (calls it waits for) and one of them. Steps double in each round, so a line of n calls
    takes log n rounds. A call that comes to no such call stands in or behind a cycle and is left out.
    """
    alone = F.col("many") == 1
    state = cut(waits.select("call_id", F.when(alone, F.col("one")).otherwise(F.col("call_id")).alias("to"), alone.cast("long").alias("dist"), (~alone).alias("done")))
    steps = 1
    while steps <= 2 * calls and not state.where("NOT done").isEmpty():
        further = state.select(F.col("call_id").alias("to"), F.col("to").alias("next"), F.col("dist").alias("more"), F.col("done").alias("there"))
        state = cut(state.where("NOT done").join(further, "to").select("call_id", F.col("next").alias("to"), (F.col("dist") + F.col("more")).alias("dist"), F.col("there").alias("done")).unionByName(state.where("done")))
        steps *= 2
    return state.where("done").drop("done")


def levels(calls: DataFrame) -> DataFrame:
    """call_id, level: 0 without a known predecessor, else one more than the highest of them; null in or behind a cycle.

    Lines of calls that wait for one other each are followed by doubling. What is left, calls that wait for
    several, takes one round of joins for each of them that stand in a row. Ids that no call has are no predecessors.
    """
    ids = calls.select("call_id").distinct()
    edges = cut(calls.select("call_id", F.explode("waits_for").alias("needs")).distinct().join(ids.withColumnRenamed("call_id", "needs"), "needs", "left_semi"))
    waits = cut(ids.join(edges.groupBy("call_id").agg(F.count("*").alias("many"), F.min("needs").alias("one")), "call_id", "left").withColumn("many", F.coalesce("many", F.lit(0))))
    anchors = cut(_anchors(waits, waits.count()))
    known = cut(waits.where("many = 0").select("call_id", F.lit(0).cast("long").alias("level")))
    # Calls that wait for several: each way to an anchor with its length; a way without an anchor never gets a level.
    ways = edges.join(waits.where("many > 1").select("call_id"), "call_id", "left_semi")
    ways = cut(ways.join(anchors.select(F.col("call_id").alias("needs"), "to", (F.col("dist") + 1).alias("dist")), "needs", "left").select("call_id", "to", "dist", F.lit(0).cast("long").alias("reached"), F.lit(True).alias("open")))
    newest = known
    while not ways.isEmpty() and not newest.isEmpty():
        ways = ways.join(newest.withColumnRenamed("call_id", "to"), "to", "left")
        ways = cut(ways.select("call_id", "to", "dist", F.when(F.col("level").isNotNull(), F.col("level") + F.col("dist")).otherwise(F.col("reached")).alias("reached"), (F.col("open") & F.col("level").isNull()).alias("open")))
        newest = cut(ways.groupBy("call_id").agg(F.max("reached").alias("level"), F.bool_or("open").alias("open")).where("NOT open").select("call_id", "level"))
        known = known.unionByName(newest)
        ways = cut(ways.join(newest.select("call_id"), "call_id", "left_anti"))
    found = anchors.join(known.withColumnRenamed("call_id", "to"), "to").select("call_id", (F.col("level") + F.col("dist")).cast("int").alias("level"))
    return ids.join(found, "call_id", "left")


def _depth(schemas: DataFrame) -> int:
    """How deep the schemas' keys go: a. b. c is three deep, and so is a[].c."""
    deep = F.expr("aggregate(fields, 1, (d, f) -> greatest(d, 1 + regexp_count(coalesce(f.key, ''), '\\\\.|\\\\[]')))")
    return schemas.agg(F.max(deep)).first()[0] or 1


def _entries(arguments: str, fields: str, depth: int):
    """Every value that a schema looks at: path, type and JSON text. Values in an object stand at parent.key, those in an array at parent[].

    A value's own parts are only looked at where some key of the schema lies behind it, so its depth bounds theirs.
    """
    levels = [f"transform(map_entries(from_json({arguments}, 'map<string, variant>')), e -> named_struct('path', e.key, 'value', e.value))"]
    inside = "transform(map_entries(from_json(to_json(e.value), 'map<string, variant>')), c -> named_struct('path', concat(e.path, '.', c.key), 'value', c.value))"
    items = "transform(from_json(to_json(e.value), 'array<variant>'), c -> named_struct('path', concat(e.path, '[]'), 'value', c))"
    for _ in range(depth - 1):
        parts = f"""CASE WHEN NOT exists({fields}, f -> startswith(f.key, concat(e.path, '.')) OR startswith(f.key, concat(e.path, '[]'))) THEN NULL
            WHEN startswith(schema_of_variant(e.value), 'OBJECT') THEN {inside} WHEN startswith(schema_of_variant(e.value), 'ARRAY') THEN {items} END"""
        levels.append(f"flatten(filter(transform({levels[-1]}, e -> {parts}), x -> x IS NOT NULL))")
    return F.expr(f"transform(concat({', '.join(levels)}), e -> named_struct('path', e.path, 'type', schema_of_variant(e.value), 'text', to_json(e.value)))")


def _errors(fields: str, entries: str, listed: bool):
    """Missing, mistyped and unknown arguments, and values that aren't listed, sorted; each once."""
    pattern = "map(" + ", ".join(f"'{k}', '^{v}$'" for k, v in TYPES.items()) + ")"
    own = f"filter({entries}, e -> e.path = f.key)"
    parent = r"regexp_replace(f.key, '(\\.[^.\\[]*|\\[])$', '')"
    needed = rf"IF({parent} = f.key, 1, size(filter({entries}, e -> e.path = {parent} AND startswith(e.type, 'OBJECT'))))"
    values = f"transform(filter({{0}}, f -> f.values IS NOT NULL AND exists({own}, e -> NOT array_contains(f.values, e.text))), f -> concat('value ', f.key)),".format(fields) if listed else ""
    return F.expr(f"""array_sort(array_distinct(concat(
        transform(filter({fields}, f -> f.required AND NOT endswith(f.key, '[]') AND size({own}) < {needed}), f -> concat('missing ', f.key)),
        transform(filter({fields}, f -> exists({own}, e -> NOT e.type RLIKE {pattern}[f.type])), f -> concat('type ', f.key)), {values}
        transform(filter({entries}, e -> NOT endswith(e.path, '[]') AND NOT exists({fields}, f -> f.key = e.path)), e -> concat('unknown ', e.path)))))""")


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """conv_id, turn, call_id, level, status, valid, errors, canonical of each call and of each result without one.

    calls: conv_id, turn, call_id, name, arguments (JSON), waits_for (array of call ids). results: call_id, seq,
    content. schemas: name, fields (array of key, type, required and, if there are any, values), one row a tool. Other
    columns, whatever their names, are left out.

    A key names an argument, and a dotted one a part of it: a.b is b in the object a, a[] the items of an array, a[].b
    what each of them has. An object none of whose parts is named may hold anything. values lists what is allowed, as
    JSON text. A required part is missing if an object that should hold it is there without it.

    status is linked, unanswered (no result) or orphan (a result without call: no canonical form). A repeated
    call id counts once, the first by conv_id, turn and the rest; of several results of a call, the first by seq
    and content. Nulls come first in these. Arguments that are no JSON object, or a tool without a schema, are
    errors, and canonical then holds no arguments. A null call id links with nothing: it is unanswered or orphan.
    """
    calls = calls.select("conv_id", "turn", "call_id", "name", "arguments", "waits_for")
    results, schemas = results.select("call_id", "seq", "content"), schemas.select("name", "fields")
    known = calls.where("call_id IS NOT NULL").groupBy("call_id").agg(F.min(F.struct("conv_id", "turn", "name", "arguments", "waits_for")).alias("c")).select("call_id", "c.*")
    nameless = calls.where("call_id IS NULL").withColumn("level", F.lit(0))
    ordered = known.join(levels(known.select("call_id", "waits_for")), "call_id")
    first = results.where("call_id IS NOT NULL").groupBy("call_id").agg(F.min(F.struct("seq", "content")).alias("r")).select("call_id", "r.content", F.lit(True).alias("answered"))
    linked = ordered.unionByName(nameless).join(first.hint("shuffle_hash"), "call_id", "left").join(schemas, "name", "left")
    linked = linked.withColumn("entries", _entries("arguments", "fields", _depth(schemas)))
    linked = linked.withColumn("parsed", F.when(F.col("entries").isNotNull(), F.expr("try_parse_json(arguments)")))
    errors = F.when(F.col("fields").isNull(), F.array(F.lit("no schema"))).when(F.col("parsed").isNull(), F.array(F.lit("no JSON object"))).otherwise(_errors("fields", "entries", "values" in schemas.schema["fields"].dataType.elementType.names))
    linked = linked.withColumn("errors", errors)
    canonical = F.to_json(F.struct(F.col("parsed").alias("arguments"), F.col("call_id").alias("id"), "name", F.col("content").alias("result")))
    out = linked.select("conv_id", "turn", "call_id", "level", F.when(F.col("answered"), "linked").otherwise("unanswered").alias("status"), (F.size("errors") == 0).alias("valid"), "errors", canonical.alias("canonical"))
    lost = results.join(known.select("call_id"), "call_id", "left_anti")
    typed = {f.name: f.dataType for f in out.schema.fields}
    return out.unionByName(lost.select("call_id", F.lit("orphan").alias("status"), *(F.lit(None).cast(typed[c]).alias(c) for c in out.columns if c not in ("call_id", "status"))))


SCHEMAS = """SELECT * FROM VALUES
    ('answer', array(named_struct('key', 'query', 'type', 'string', 'required', true), named_struct('key', 'turn', 'type', 'integer', 'required', true), named_struct('key', 'draft', 'type', 'boolean', 'required', false))),
    ('search', array(named_struct('key', 'query', 'type', 'string', 'required', true), named_struct('key', 'turn', 'type', 'integer', 'required', true), named_struct('key', 'limit', 'type', 'number', 'required', true)))
    AS t(name, fields)"""


def op6_tool_calls(spark, sf_dir: str) -> DataFrame:
    """Each assistant turn of conversations as a call (search in turns divisible by 3, else answer) and each user turn as the result of the turn before it.

    A call waits for the one two turns before it, so a conversation is one line of calls.
    """
    rows = table(spark, sf_dir, "conversations")
    name_of = lambda conv, turn: F.concat_ws(":", F.lit("call"), conv.cast("string"), turn.cast("string"))
    arguments = F.to_json(F.struct("turn", F.col("text").alias("query"), F.when(F.col("turn") % 3 == 0, F.size(F.split("text", " "))).alias("limit"), F.when(F.col("turn") % 5 == 0, F.lit("yes")).alias("draft")))
    calls = rows.where("role = 'assistant'").select(
        "conv_id", "turn", name_of(F.col("conv_id"), F.col("turn")).alias("call_id"), F.when(F.col("turn") % 3 == 0, "search").otherwise("answer").alias("name"), arguments.alias("arguments"),
        F.array(name_of(F.col("conv_id"), F.col("turn") - 2)).alias("waits_for"),
    )
    results = rows.where("role = 'user'").select(name_of(F.col("conv_id"), F.col("turn") - 1).alias("call_id"), F.col("turn").alias("seq"), F.col("text").alias("content"))
    out = link(calls, results, spark.sql(SCHEMAS))
    return out.select("conv_id", "turn", "call_id", "level", "status", "valid", F.array_join("errors", ",").alias("errors"), F.sha2("canonical", 256).alias("canonical_sha256"), F.length("canonical").alias("canonical_chars"))


OP6_SQL = """
WITH RECURSIVE calls AS (
  SELECT conv_id, turn, 'call:' || conv_id || ':' || turn AS call_id, CASE WHEN turn % 3 = 0 THEN 'search' ELSE 'answer' END AS name, text,
    'call:' || conv_id || ':' || (turn - 2) AS needs
  FROM conversations WHERE role = 'assistant'),
results AS (SELECT 'call:' || conv_id || ':' || (turn - 1) AS call_id, text AS content FROM conversations WHERE role = 'user'),
levels AS (
  SELECT call_id, 0 AS level FROM calls WHERE needs NOT IN (SELECT call_id FROM calls)
  UNION ALL SELECT c.call_id, l.level + 1 FROM calls c JOIN levels l ON c.needs = l.call_id),
linked AS (
  SELECT c.conv_id, c.turn, c.call_id, l.level, CASE WHEN r.call_id IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
    array_to_string(list_filter([
      CASE WHEN c.text IS NULL THEN 'missing query' END, CASE WHEN c.turn % 5 = 0 AND c.name = 'answer' THEN 'type draft' END,
      CASE WHEN c.turn % 5 = 0 AND c.name = 'search' THEN 'unknown draft' END], lambda x: x IS NOT NULL), ',') AS errors,
    '{"arguments":{' || CASE WHEN c.turn % 5 = 0 THEN '"draft":"yes",' ELSE '' END || CASE WHEN c.turn % 3 = 0 THEN '"limit":' || len(string_split(c.text, ' ')) || ',' ELSE '' END
      || coalesce('"query":' || to_json(c.text)::VARCHAR || ',', '') || '"turn":' || c.turn || '},"id":"' || c.call_id || '","name":"' || c.name || '"' || coalesce(',"result":' || to_json(r.content)::VARCHAR, '') || '}' AS canonical
  FROM calls c JOIN levels l ON c.call_id = l.call_id LEFT JOIN results r ON c.call_id = r.call_id)
SELECT conv_id, turn, call_id, level, status, errors = '' AS valid, errors, sha256(canonical) AS canonical_sha256, length(canonical) AS canonical_chars FROM linked
UNION ALL SELECT NULL, NULL, call_id, NULL, 'orphan', NULL, NULL, NULL, NULL FROM results WHERE call_id NOT IN (SELECT call_id FROM calls)
"""
