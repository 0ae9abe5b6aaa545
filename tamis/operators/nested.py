"""Problem 6: deeply nested reports as related flat tables.

Findings, evidence, timings and metadata of scan reports become child tables that name their report and, for
evidence, their finding. Evidence is JSON of no fixed shape: it is parsed once into a variant, and its merged schema is
inferred over all rows (``merged_schema``). The schema tells how many levels there are; each is exploded once, and every
row carries its own surrogate key, that of its parent and its ordinal, so a child table joins back to its parent. Where
elements of different shapes meet, the schema ends in a variant; what nests below such a place is flattened by a worker.
``child_tables`` gives the typed tables of the merged schema, one for each array level.

Results: a report delivered twice counts once (by report_id); null findings, maps and evidence give no rows; null
elements keep their positions; evidence that is no valid JSON, or a string that holds none, gives no rows; JSON nulls,
empty arrays and empty objects give no values; null values of maps keep their keys. Other columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.functions.session import cut

# The metadata keys that hold a JSON array of strings.
ARRAY_KEYS = ["comments", "hidden_text", "hex_blobs", "pdf_comments", "embedded_files"]
#: The members of an object or array as (step of the path, variant); null for scalars.
CHILDREN = """coalesce(transform(try_variant_get(_v, '$', 'array<variant>'), (x, i) -> struct(concat('[', i, ']') as step, x as v)),
transform(map_entries(try_variant_get(_v, '$', 'map<string,variant>')), e -> struct(concat('.', e.key) as step, e.value as v)))"""
END = "\u241ctamis\u241c"  # stands after the text in an array, and is the second element only if the text is one whole value
LEVELS_A_PLAN = 16  # deeper evidence is cut off after so many levels, to keep plans small


def one_each(reports: DataFrame) -> DataFrame:
    return reports.dropDuplicates(["report_id"])


def findings(reports: DataFrame) -> DataFrame:
    """report_id, finding_no and the fields of each non-null finding."""
    flat = reports.select("report_id", F.posexplode("findings").alias("finding_no", "f")).where("f is not null")
    return flat.select("report_id", "finding_no", "f.*")


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def parsed(text: Column) -> Column:
    """The variant of the JSON in a text; a JSON string is read once more; null unless the whole text is one JSON value."""
    get = lambda v, path, kind: F.try_variant_get(v, path, kind)
    whole = lambda v: F.when((get(v, "$[1]", "string") == END) & get(v, "$[2]", "variant").isNull(), get(v, "$[0]", "variant"))
    once = lambda x: let(F.try_parse_json(F.concat(F.lit("["), x, F.lit(f',"{END}"]'))), whole)
    is_text = lambda v: F.schema_of_variant(v) == "STRING"
    # only text that begins with a quotation mark can be a JSON string
    return F.when(text.rlike(r'\A\s*"'), let(once(text), lambda v: F.when(is_text(v), once(get(v, "$", "string"))).otherwise(v))).otherwise(once(text))


def nesting(schema: str) -> int:
    """How deep arrays and objects nest in a schema string; names between back quotes do not count."""
    depth = deepest = 0
    for c in re.sub(r"`(?:[^`]|``)*`", "", schema):
        depth += (c == "<") - (c == ">")
        deepest = max(deepest, depth)
    return deepest


def merged_schema(df: DataFrame, variant: str, *by: str) -> DataFrame:
    """One merged schema for each value of ``by``: of the objects, the arrays and the scalars apart. Its size grows with the number of distinct paths."""
    kind = F.expr(f"case when {variant} is null then null when try_variant_get({variant}, '$', 'array<variant>') is not null then 'array' when try_variant_get({variant}, '$', 'map<string,variant>') is not null then 'object' else 'scalar' end")
    # the count, and not a filter of the rows, leaves out nulls: a filter would be pushed down and have the JSON parsed twice
    return df.select(*by, kind.alias("kind"), variant).groupBy(*by, "kind").agg(F.expr(f"schema_of_variant_agg({variant})").alias("merged"), F.count(variant).alias("n")).where("n > 0")


def _below(text: str, path: str) -> list[tuple[str, str, int, str, str]]:
    """path, parent path, ordinal, value, type of the scalars below a nested value."""
    out, todo = [], [(path, "", 0, json.loads(text))]
    while todo:
        at, parent, ordinal, v = todo.pop()
        if isinstance(v, dict | list):
            inside = ((f"{at}.{k}", x) for k, x in v.items()) if isinstance(v, dict) else ((f"{at}[{i}]", x) for i, x in enumerate(v))
            todo += [(p, at, i, x) for i, (p, x) in enumerate(inside)]
        elif v is not None:
            value, kind = (json.dumps(v), "BOOLEAN") if isinstance(v, bool) else (v, "STRING") if isinstance(v, str) else (json.dumps(v), "BIGINT" if isinstance(v, int) else "DOUBLE")
            out.append((at, parent, ordinal, value, kind))
    return out


def _deeper(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    kind = pa.list_(pa.struct([("path", pa.string()), ("parent_path", pa.string()), ("ordinal", pa.int32()), ("value", pa.string()), ("type", pa.string())]))
    for texts, paths in batches:
        rows = [[dict(zip(("path", "parent_path", "ordinal", "value", "type"), x)) for x in _below(t, p)] for t, p in zip(texts.to_pylist(), paths.to_pylist())]
        yield pa.array(rows, kind)


def surrogate(keys: list[str], path: str) -> Column:
    """The key of a nested value, from the keys of its record and its path."""
    return F.when(F.col(path).isNotNull(), F.xxhash64(*keys, path))


def flatten(df: DataFrame, variant: str, keys: list[str], levels: int | None = None) -> DataFrame:
    """``keys``, path, parent_path, ordinal, value, type, row_key, parent_key of each scalar inside the variants; paths as ``$.key[0]``.

    ``levels``: how often to explode; by default as deep as the merged schema nests."""
    if levels is None:
        levels = max((nesting(r["merged"]) for r in merged_schema(df, variant).collect()), default=0)
    at = df.select(*keys, F.lit("$").alias("path"), F.lit(None).cast("string").alias("parent_path"), F.lit(None).cast("int").alias("ordinal"), F.col(variant).alias("_v"))
    for level in range(levels):
        inside = F.col("_c").isNotNull()
        opened = at.select("*", F.expr(CHILDREN).alias("_all"))
        at = opened.select("*", F.posexplode_outer("_all").alias("_pos", "_c")).where("_pos is not null or _all is null").select(
            *keys,
            F.when(inside, F.concat("path", "_c.step")).otherwise(F.col("path")).alias("path"),
            F.when(inside, F.col("path")).otherwise(F.col("parent_path")).alias("parent_path"),
            F.when(inside, F.col("_pos")).otherwise(F.col("ordinal")).alias("ordinal"),
            F.when(inside, F.col("_c.v")).otherwise(F.col("_v")).alias("_v"),
        )
        if level % LEVELS_A_PLAN == LEVELS_A_PLAN - 1:
            at = cut(at.withColumn("_v", F.to_json("_v"))).withColumn("_v", F.parse_json("_v"))
    typed = at.withColumn("type", F.expr("case when _v is not null then substring_index(schema_of_variant(_v), '<', 1) end"))
    nested = F.col("type").isin("OBJECT", "ARRAY")
    own = F.array(F.struct("path", "parent_path", "ordinal", F.expr("try_variant_get(_v, '$', 'string')").alias("value"), "type"))
    scalar = typed.where(~F.col("type").isin("VOID", "OBJECT", "ARRAY")).select(*keys, F.explode(own).alias("_s"))
    deep = typed.where(nested).select(*keys, F.explode(F.arrow_udf(_deeper, "array<struct<path: string, parent_path: string, ordinal: int, value: string, type: string>>")(F.to_json("_v"), F.col("path"))).alias("_s"))
    every = scalar.unionByName(deep).select(*keys, "_s.*")
    return every.withColumns({"row_key": surrogate(keys, "path"), "parent_key": surrogate(keys, "parent_path")})


def child_tables(df: DataFrame, variant: str, keys: list[str]) -> dict[str, DataFrame]:
    """The typed tables of the merged schema of the object variants: ``$`` for the objects, and one for each array level (path with ``[]``).

    Each has ``keys``, row_key, parent_key, ordinal and a column for each scalar or variant field (named by its path below the
    level); an array's elements that are no objects stand in ``value``. Fields whose name needs quoting are left to ``flatten``."""
    merged = merged_schema(df, variant).where("kind = 'object'").select("merged").first()
    if merged is None:
        return {}
    whole = df.sparkSession.range(0).select(F.expr(f"cast(null as {merged[0].replace('OBJECT<', 'STRUCT<')})").alias("s")).schema["s"].dataType
    out: dict[str, DataFrame] = {}

    def table(name: str, rows: DataFrame, kind) -> None:
        fields, arrays = [], []

        def walk(node, at: str, column: Column) -> None:
            if node.typeName() == "struct":
                for f in node.fields:
                    if re.fullmatch(r"\w+", f.name):
                        walk(f.dataType, f"{at}.{f.name}" if at else f.name, column.getField(f.name))
            elif node.typeName() == "array":
                arrays.append((at, node.elementType, column))
            else:
                fields.append(column.alias(at.replace(".", "_") or "value"))

        walk(kind, "", F.col("_value"))
        out[name] = rows.select(*keys, "row_key", "parent_key", "ordinal", *fields)
        for at, element, column in arrays:
            inner = rows.select(*keys, F.col("row_key").alias("parent_key"), F.posexplode(column).alias("ordinal", "_value"))
            child = f"{name}.{at}[]" if at else f"{name}[]"
            table(child, inner.withColumn("row_key", F.xxhash64("parent_key", F.lit(child), "ordinal")), element)

    top = df.select(*keys, F.lit(None).cast("bigint").alias("parent_key"), F.lit(0).alias("ordinal"), F.try_variant_get(variant, "$", whole.simpleString()).alias("_value"))
    table("$", top.where("_value is not null").withColumn("row_key", F.xxhash64(*keys, F.lit("$"))), whole)
    return out


def evidence(reports: DataFrame) -> DataFrame:
    """report_id, finding_no, path, parent_path, ordinal, value, type, row_key, parent_key of each scalar in the evidence of a finding."""
    return flatten(findings(reports).select("report_id", "finding_no", parsed(F.col("evidence")).alias("_json")), "_json", ["report_id", "finding_no"])


def timings(reports: DataFrame) -> DataFrame:
    return reports.select("report_id", F.explode("timings_ms").alias("stage", "ms"))


def metadata(reports: DataFrame) -> DataFrame:
    """report_id, path, key, ordinal, value; the elements of the keys that hold arrays, the values of all others."""
    flat = reports.select("report_id", F.explode("metadata").alias("key", "value"))
    plain = flat.where(~F.col("key").isin(ARRAY_KEYS)).select("report_id", F.col("key").alias("path"), "key", F.lit(None).cast("int").alias("ordinal"), "value")
    many = flat.where(F.col("key").isin(ARRAY_KEYS)).select("report_id", "key", F.posexplode(F.from_json("value", "array<string>")).alias("ordinal", "value"))
    return plain.unionByName(many.select("report_id", F.concat("key", F.lit("["), "ordinal", F.lit("]")).alias("path"), "key", "ordinal", "value"))


def found(reports: DataFrame) -> DataFrame:
    """child, report_id, finding_no, path: one row for each row of a child table."""
    once = one_each(reports.select("report_id", "findings", "timings_ms", "metadata"))
    no = F.lit(-1).alias("finding_no")
    parts = [
        findings(once).select(F.lit("finding").alias("child"), "report_id", "finding_no", F.lit("$").alias("path")),
        evidence(once).select(F.lit("evidence").alias("child"), "report_id", "finding_no", "path"),
        timings(once).select(F.lit("timing").alias("child"), "report_id", no, F.col("stage").alias("path")),
        metadata(once).select(F.lit("metadata").alias("child"), "report_id", no, "path"),
    ]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every
