"""Queries on nested configurations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.nested import found_keys, walked
from ..sources.views import table
from .registry import query

# What stands before and after a configuration, by the remainder of its id. `value` wraps.
SHAPES = (
    ("", ""),
    ('{"value": ', "}"),
    ('{"model": {"estimator": ', ', "seed": 1}}'),
    ('{"runs": [1, {"config": {"value": ', '}}, "x"]}'),
    ('{"a": [[{"b": [', ', {"k": 7}]}], {"value": {"k": {"value": 8}}}]}'),
    ('{"k": {"c": {"d": {"e": {"value": ', "}}}}}"),
    ('{"value": {"other": [', "]"),  # cut off: no JSON
)
CONFIG_SQL = "CASE event_id % 7 " + " ".join(f"WHEN {i} THEN '{a}' || props || '{b}'" for i, (a, b) in enumerate(SHAPES)) + " END AS config"
#: json_tree counts wrappers as levels; these have no name of their own in a path.
_TREE = f"c AS (SELECT event_id, {CONFIG_SQL} FROM events), t AS (SELECT event_id, key, type, atom, replace(replace(fullkey, '\"', ''), '.value', '') AS path FROM c, json_tree(CASE WHEN json_valid(config) THEN config END::JSON) t)"
_DEPTH = "len(regexp_extract_all(path, '[.]|\\['))"


def configs(spark, sf_dir):
    config = F.lit(None).cast("string")
    for i, (a, b) in enumerate(SHAPES):
        config = F.when(F.col("event_id") % len(SHAPES) == i, F.concat(F.lit(a), "props", F.lit(b))).otherwise(config)
    return table(spark, sf_dir, "events").select("event_id", config.alias("config"))


@query(f"WITH {_TREE}, k AS (SELECT event_id, path, max(atom) AS atom FROM t WHERE path LIKE '%.k' GROUP BY ALL) SELECT event_id, CAST({_DEPTH} AS INTEGER) AS depth, path, CAST(atom AS VARCHAR) AS value FROM k")
def deep_key_search(spark, sf_dir):
    """Every occurrence of a key, at any depth and within arrays, wrappers being taken off at each level; null for objects."""
    found = found_keys(configs(spark, sf_dir), "event_id", "config", "k")
    return found.select(F.col("id").alias("event_id"), "depth", "path", F.expr("CASE WHEN schema_of_variant(value) NOT LIKE 'OBJECT%' THEN to_json(value) END").alias("value"))


@query(f"WITH {_TREE}, p AS (SELECT event_id, path FROM t GROUP BY ALL) SELECT {_DEPTH} AS depth, regexp_replace(path, '\\[\\d+\\]', '[]', 'g') AS path, count(*) AS rows, count(DISTINCT event_id) AS configs FROM p GROUP BY ALL")
def config_shape(spark, sf_dir):
    """Which paths there are in all configurations (places in arrays left out), how often and in how many of them."""
    rows = walked(configs(spark, sf_dir), "event_id", "config").where("value IS NOT NULL")
    return rows.groupBy(F.col("depth").cast("long").alias("depth"), F.regexp_replace("path", r"\[\d+\]", "[]").alias("path")).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("id").alias("configs"))
