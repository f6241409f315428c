"""Keys of nested configurations at any depth: VARIANT values walked level by level by a recursive query."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Levels that a walk goes down at most; deeper configurations are an error, not cut off.
DEEPEST = 500


def _wraps(v: str) -> str:
    """An object whose only key is `value` stands for what that holds (configurations are exported so)."""
    return f"coalesce(json_object_keys(to_json({v})) = array('value'), false)"


def walked(rows: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """id, depth, path, key, value (VARIANT) of everything within each row's JSON text, the whole text (depth 0) included.

    Objects and arrays are opened level by level, whatever their shape; a level is one step of the recursion, and its rows
    are dealt out as any rows are. A text that isn't JSON, or null, has one row without a value. Elements of arrays have no
    key; a repeated key of one object is an error of the parser, so such a text counts as no JSON.
    """
    spark = rows.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")  # a walk has as many rows as there are keys
    source = rows.selectExpr(f"`{id_col}` AS id", f"try_parse_json(`{json_col}`) AS v")
    # what a wrapper holds takes its place: its depth, path and key
    query = f"""
    WITH RECURSIVE walk(id, depth, path, key, value, wraps) MAX RECURSION LEVEL {DEEPEST} AS (
      SELECT id, 0, '$', CAST(NULL AS STRING), v, {_wraps('v')} FROM {{source}}
      UNION ALL
      SELECT walk.id, walk.depth + int(NOT wraps), CASE WHEN wraps THEN walk.path ELSE concat(walk.path, coalesce(concat('.', e.key), concat('[', e.pos, ']'))) END,
             CASE WHEN wraps THEN walk.key ELSE e.key END, e.value, {_wraps('e.value')}
      FROM walk, LATERAL variant_explode(walk.value) e)
    SELECT id, depth, path, key, value FROM walk WHERE NOT wraps"""
    return spark.sql(query, source=source)


def found_keys(rows: DataFrame, id_col: str, json_col: str, key: str) -> DataFrame:
    """id, depth, path, value of each occurrence of a key at any depth, within arrays and within other occurrences too."""
    return walked(rows, id_col, json_col).where(f"key = '{key}'").drop("key")
