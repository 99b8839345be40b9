"""Structural contracts of nested data under open-world rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwood.sources.workspace import written

#: The type of what an empty list would hold: in a required structure it matches any other.
UNKNOWN = "UNKNOWN"
#: Levels that one pass opens.
LEVELS = 8


def _type(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, BOOLEAN, BIGINT (whole numbers of any size), DOUBLE (numbers with a point or exponent, 1.0 too) or NULL (JSON null)."""
    full = F.schema_of_variant(v)
    kind = F.regexp_extract(full, "^[A-Z]+", 0)
    return F.when(kind == "VOID", "NULL").when(full.rlike(r"^DECIMAL\((19|[23]\d),0"), "BIGINT").when(kind == "DECIMAL", "DOUBLE").otherwise(kind)


def step(key: Column) -> Column:
    """A key as a step of a path: .key if it is a plain name, else quoted, so that no two paths look alike."""
    quoted = F.concat(F.lit('["'), F.replace(F.replace(key, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"]'))
    return F.when(key.rlike(r"\A[A-Za-z_][A-Za-z0-9_]*\z"), F.concat(F.lit("."), key)).otherwise(quoted)


def _found(path: Column, type_: Column, v: Column) -> Column:
    """A place with its type; v stays only where there is something to be opened."""
    return F.struct(path.alias("path"), type_.alias("type"), F.when(type_.isin("OBJECT", "ARRAY"), v).alias("v"))


def _opened() -> Column:
    """A row's place, and the places inside of its value if that has not been opened: an array of structs (path, type, v)."""
    at, kind, v = F.col("path"), F.col("type"), F.col("v")
    keys = F.map_entries(F.expr("try_cast(v AS map<string, variant>)"))
    items = F.transform(keys, lambda x: _found(F.concat(at, step(x["key"])), _type(x["value"]), x["value"]))
    first = F.expr("try_variant_get(v, '$[0]', 'variant')")
    element = F.array(_found(F.concat(at, F.lit("[]")), F.when(first.isNull(), UNKNOWN).otherwise(_type(first)), first))
    own = F.array(F.struct(at.alias("path"), kind.alias("type"), F.lit(None).cast("variant").alias("v")))
    return F.when(v.isNull(), own).when(kind == "OBJECT", F.concat(own, items)).otherwise(F.concat(own, element))


def alike(json: Column) -> Column:
    """Valid JSON with one value for all of a type: equal texts, equal structure. Keys, nulls, odd numbers and white space stay.

    Strings become "", whole numbers of up to 18 digits 1, other plain numbers
    1.5, booleans true; of a list of such values the first stays. Control
    characters, which no valid JSON holds, stand for them in between, so that
    only keys have quotes.
    """
    text = F.replace(F.replace(json, F.lit("\\\\"), F.lit("\x01")), F.lit('\\"'), F.lit("\x02"))
    free = r"(?<![\d.eE+-])-?"
    for mark, found in (("\x03", r'"[^"]*+"'), ("\x04", free + r"\d{1,18}+(?![\d.eE])"), ("\x05", free + r"\d{1,15}+\.\d{1,15}+(?![\d.eE])"), ("\x06", "true|false"), ("\x07", r'(\[[^\[\]{}",]++),[^\[\]{}"]*+\]')):
        text = F.regexp_replace(text, r'("[^"]*+"\s*+:)|' + found, f"$1{'$2' if mark == chr(7) else ''}{mark}")
        text = F.replace(text, F.lit(f":{mark}"), F.lit(":"))  # a key is followed by the mark, too
    for mark, value in zip("\x07\x06\x05\x04\x03\x02\x01", ("]", "true", "1.5", "1", '""', '\\"', "\\\\"), strict=True):
        text = F.replace(text, F.lit(mark), F.lit(value))
    return text


def infer_structure(rows: DataFrame, entity: str, json_col: str, depth: int | None = None) -> DataFrame:
    """(entity, path, type, n_records) of JSON values down to ``depth`` levels (None: all).

    '$' is the value itself; '.name' follows for a key, or '["any key"]' if it is
    no plain name; '[]' is a list's first element, which is UNKNOWN in an empty
    list. JSON null is a type of its own (NULL). n_records: how many records have
    that type there; null and unreadable values are no records. ``entity`` may be
    a column of any type that can be grouped, a struct too.

    Values that differ in nothing but strings and numbers (``alike``) are counted
    first and opened once. LEVELS levels are opened in one pass over them; only
    what lies deeper takes another one. Only emptiness reaches the driver.
    """
    v = F.col("v")
    valid = rows.where(F.try_parse_json(json_col).isNotNull()).select(F.col(entity).alias("entity"), alike(F.col(json_col)).alias("json"))
    now = valid.groupBy("entity", "json").agg(F.count("*").alias("n")).select("entity", "n", F.parse_json("json").alias("v")).select("entity", "n", F.inline(F.array(_found(F.lit("$"), _type(v), v))))
    done, left = [], depth
    while True:
        for _ in range(LEVELS if left is None else min(LEVELS, left)):
            now = now.select("entity", "n", F.inline(_opened()))
        now = written(now, "structure")
        left = None if left is None else max(0, left - LEVELS)
        if left == 0 or now.where("v is not null").isEmpty():
            break
        done.append(now.where("v is null"))
        now = now.where("v is not null")
    for x in done:
        now = now.unionAll(x)
    return now.groupBy("entity", "path", "type").agg(F.sum("n").alias("n_records"))


def required_paths(structure: DataFrame) -> DataFrame:
    """(entity, path, type): the paths that every record of an entity has, with the types that they have there."""
    records = structure.where("path = '$'").groupBy("entity").agg(F.sum("n_records").alias("records"))
    paths = structure.groupBy("entity", "path").agg(F.sum("n_records").alias("here"))
    always = paths.join(records, "entity").where("here = records").select("entity", "path")
    return structure.select("entity", "path", "type").join(always, ["entity", "path"], "left_semi")


def superset_check(required: DataFrame, actual: DataFrame) -> DataFrame:
    """(entity, n_records, n_missing, n_mismatched, satisfied): every record has each required path with a required type; more paths are allowed.

    required: (entity, path, type), several types of a path being alternatives;
    actual: what ``infer_structure`` gives (without n_records: one record each).
    n_missing and n_mismatched count records, summed over the required paths. A
    path inside of a missing or differing one counts as well. An entity without
    records misses all of its paths once.
    """
    if "n_records" not in actual.columns:
        actual = actual.withColumn("n_records", F.lit(1).cast("long"))
    allowed = required.groupBy("entity", "path").agg(F.collect_set("type").alias("types"))  # a handful of types
    records = actual.where("path = '$'").groupBy("entity").agg(F.sum("n_records").alias("records"))
    here = allowed.join(actual.select("entity", "path", F.col("type").alias("have"), F.col("n_records").alias("n")), ["entity", "path"], "left")
    fits = F.array_contains("types", F.lit(UNKNOWN)) | F.array_contains("types", F.col("have"))
    paths = here.groupBy("entity", "path").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(~fits, F.col("n"))), F.lit(0)).alias("n_wrong"))
    each = paths.join(records, "entity", "left").withColumn("n_missing", F.greatest(F.coalesce("records", F.greatest("n", F.lit(1))) - F.col("n"), F.lit(0)))
    return each.groupBy("entity").agg(
        F.coalesce(F.max("records"), F.lit(0)).cast("long").alias("n_records"), F.sum("n_missing").alias("n_missing"), F.sum("n_wrong").alias("n_mismatched"), (F.sum(F.col("n_missing") + F.col("n_wrong")) == 0).alias("satisfied"),
    )


def contract_report(checked: DataFrame, edges: DataFrame, depth: int = 2) -> DataFrame:
    """(entity, dependent, hop, place): what depends on each violated entity, direct dependents first."""
    from driftwood.operators.graph import bounded_bfs, dependents_order

    violated = checked.where("not satisfied").select(F.col("entity").alias("node"))
    return dependents_order(bounded_bfs(edges, violated, depth, "reverse")).select(F.col("seed").alias("entity"), F.col("node").alias("dependent"), "hop", F.col("place").cast("long").alias("place"))


def contract_status(rows: DataFrame, json_col: str, known: Column) -> DataFrame:
    """A status for each row: unavailable (no value), invalid (not JSON), skipped (no contract known), ok."""
    value = F.col(json_col)
    status = F.when(value.isNull(), "unavailable").when(F.try_parse_json(value).isNull(), "invalid").when(~known, "skipped").otherwise("ok")
    return rows.withColumn("status", status)
