"""Queries on result tables: latest and best rows, resumption, lookups, pivots, rollups and report lines."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.latex import latex_escaped, latex_sql
from ..operators.ranks import quantiles
from ..sources.views import HISTORY_SQL, RUNS_SQL, history, runs, table
from .registry import query

CFG = ("dataset", "priority")
#: Means in ten-thousandths as integers, from sums in cents: no engine rounds them its own way.
MEAN = "cast(round(sum(rate) * 100) as bigint) * 100 div count(rate)"
MEAN_SQL = "CAST(round(sum(rate) * 100) AS BIGINT) * 100 // count(rate)"


def _first(rows, keys, *order):
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("rn = 1").drop("rn")


def _first_sql(order: str) -> str:
    return f"WITH {RUNS_SQL} SELECT dataset, priority, run_id, status, rate FROM runs QUALIFY row_number() OVER (PARTITION BY dataset, priority ORDER BY {order}) = 1"


SHOWN = ("dataset", "priority", "run_id", "status", "rate")


@query(_first_sql("ts DESC, run_id DESC"))
def latest_run_per_key(spark, sf_dir):
    return _first(runs(spark, sf_dir), CFG, F.desc("ts"), F.desc("run_id")).select(*SHOWN)


@query(_first_sql("run_id DESC"))
def last_append_row(spark, sf_dir):
    return _first(runs(spark, sf_dir), CFG, F.desc("run_id")).select(*SHOWN)


@query(_first_sql("run_id"))
def first_dedup(spark, sf_dir):
    return _first(runs(spark, sf_dir), CFG, "run_id").select(*SHOWN)


@query(_first_sql("CASE status WHEN 'F' THEN 0 WHEN 'P' THEN 1 ELSE 2 END, ts DESC, run_id DESC"))
def dedup_priority(spark, sf_dir):
    rank = F.when(F.col("status") == "F", 0).when(F.col("status") == "P", 1).otherwise(2)
    return _first(runs(spark, sf_dir), CFG, rank, F.desc("ts"), F.desc("run_id")).select(*SHOWN)


@query(f"WITH {RUNS_SQL}, m AS (SELECT dataset, priority, status, avg(rate) AS mean FROM runs GROUP BY ALL), b AS (SELECT dataset, arg_max(priority || '/' || status, round(mean, 6)) AS cfg FROM m GROUP BY ALL) SELECT runs.dataset, priority, status, run_id, rate FROM runs JOIN b ON runs.dataset = b.dataset AND cfg = priority || '/' || status")
def best_config_rows(spark, sf_dir):
    """The rows of each data set's configuration with the highest mean rate."""
    rows = runs(spark, sf_dir)
    means = rows.groupBy("dataset", "priority", "status").agg(F.round(F.avg("rate"), 6).alias("mean"))
    best = means.groupBy("dataset").agg(F.max_by(F.struct("priority", "status"), "mean").alias("b")).select("dataset", "b.*")
    return rows.join(best, ["dataset", "priority", "status"], "left_semi").select("dataset", "priority", "status", "run_id", "rate")


@query(f"WITH {RUNS_SQL}, r AS (SELECT dataset, priority, run_id, CAST(floor(rate / 10000) AS BIGINT) AS bin FROM runs) SELECT * FROM r QUALIFY rank() OVER (PARTITION BY dataset, priority ORDER BY bin DESC) = 1")
def best_in_group_ties(spark, sf_dir):
    rows = runs(spark, sf_dir).select("dataset", "priority", "run_id", F.floor(F.col("rate") / 10000).alias("bin"))
    # a row a group, so that no group's rows meet in one task; they have all their ties by an equality with it
    tops = rows.groupBy(*CFG).agg(F.max("bin").alias("bin"))
    return rows.join(tops, [*CFG, "bin"], "left_semi").select("dataset", "priority", "run_id", "bin")


@query("WITH n AS (SELECT count(DISTINCT o_orderstatus) AS n FROM orders), c AS (SELECT o_custkey FROM orders, n GROUP BY o_custkey, n HAVING count(DISTINCT o_orderstatus) = n) SELECT o_orderkey AS run_id, o_custkey AS path, o_orderstatus AS configuration FROM orders WHERE o_custkey IN (SELECT o_custkey FROM c)")
def common_path_semi_join(spark, sf_dir):
    """Results of the paths that every configuration has."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("path"), F.col("o_orderstatus").alias("configuration"))
    pairs = orders.select("path", "configuration").distinct()
    wanted = pairs.agg(F.count_distinct("configuration").alias("n"))
    common = pairs.groupBy("path").agg(F.count(F.lit(1)).alias("c")).join(wanted, F.col("c") == F.col("n")).select("path")
    return orders.join(common, "path", "left_semi").select("run_id", "path", "configuration")


@query("SELECT c_custkey, c_name, s.s AS status FROM customer, (SELECT DISTINCT o_orderstatus AS s FROM orders) s WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = s.s)")
def resume_anti_join(spark, sf_dir):
    """What is left to do: each customer and configuration without a result yet. Statuses are a handful: one row's array."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("status"))
    statuses = orders.agg(F.collect_set("status").alias("all"))
    grid = table(spark, sf_dir, "customer").select("c_custkey", "c_name").crossJoin(statuses).select("c_custkey", "c_name", F.explode("all").alias("status"))
    return grid.join(orders, ["c_custkey", "status"], "left_anti").select("c_custkey", "c_name", "status")


@query(f"WITH {RUNS_SQL} SELECT run_id, dataset, priority, status FROM runs WHERE NOT (priority = '1-URGENT' AND status = 'F')")
def reset_filter(spark, sf_dir):
    return runs(spark, sf_dir).where(~((F.col("priority") == "1-URGENT") & (F.col("status") == "F"))).select("run_id", "dataset", "priority", "status")


MEANS = f"m AS (SELECT dataset, priority, status, {MEAN_SQL} AS mean FROM runs GROUP BY ALL)"


@query(f"WITH {RUNS_SQL}, {MEANS} SELECT n_name AS dataset, p.priority, coalesce(f.mean, -1) AS finished, coalesce(o.mean, -1) AS open FROM nation CROSS JOIN (SELECT DISTINCT priority FROM runs) p LEFT JOIN m f ON f.dataset = n_name AND f.priority = p.priority AND f.status = 'F' LEFT JOIN m o ON o.dataset = n_name AND o.priority = p.priority AND o.status = 'O'")
def rate_lookup_left_join(spark, sf_dir):
    """A report row for every data set and priority, its rates looked up, -1 where there are none."""
    means = runs(spark, sf_dir).groupBy("dataset", "priority", "status").agg(F.expr(MEAN).alias("mean"))
    names = table(spark, sf_dir, "nation").select(F.col("n_name").alias("dataset"))
    priorities = table(spark, sf_dir, "orders").agg(F.collect_set("o_orderpriority").alias("all"))
    grid = names.crossJoin(priorities).select("dataset", F.explode("all").alias("priority"))
    for status, name in (("F", "finished"), ("O", "open")):
        grid = grid.join(means.where(F.col("status") == status).select("dataset", "priority", F.col("mean").alias(name)), ["dataset", "priority"], "left")
    return grid.fillna(-1, ["finished", "open"])


@query(f"WITH {RUNS_SQL} SELECT dataset, {', '.join(f'''CAST(round(sum(rate) FILTER (status = '{s}') * 100) AS BIGINT) * 100 // (count(*) FILTER (status = '{s}')) AS {s.lower()}''' for s in 'FOP')} FROM runs GROUP BY dataset")
def report_pivot(spark, sf_dir):
    return runs(spark, sf_dir).groupBy("dataset").pivot("status", ["F", "O", "P"]).agg(F.expr(MEAN)).toDF("dataset", "f", "o", "p")


@query(f"WITH {RUNS_SQL}, t AS (SELECT dataset, round(min(rate), 4) AS least, round(avg(rate), 4) AS mean, round(max(rate), 4) AS most FROM runs GROUP BY dataset) SELECT dataset, unnest(['least', 'mean', 'most']) AS measure, unnest([least, mean, most]) AS value FROM t")
def table_melt(spark, sf_dir):
    wide = runs(spark, sf_dir).groupBy("dataset").agg(F.round(F.min("rate"), 4).alias("least"), F.round(F.avg("rate"), 4).alias("mean"), F.round(F.max("rate"), 4).alias("most"))
    return wide.unpivot("dataset", ["least", "mean", "most"], "measure", "value")


@query(f"WITH {RUNS_SQL}, t AS (SELECT dataset, priority, {', '.join(f'''CAST(round(sum(rate) FILTER (status = '{s}') * 100) AS BIGINT) * 100 // (count(*) FILTER (status = '{s}')) AS {s.lower()}''' for s in 'FOP')} FROM runs GROUP BY ALL) SELECT dataset, priority, greatest(f, o, p) AS best, f >= greatest(f, o, p) AS f_bold FROM t")
def rowwise_best(spark, sf_dir):
    wide = runs(spark, sf_dir).groupBy("dataset", "priority").pivot("status", ["F", "O", "P"]).agg(F.expr(MEAN)).toDF("dataset", "priority", "f", "o", "p")
    best = F.greatest("f", "o", "p")
    return wide.select("dataset", "priority", best.alias("best"), (F.col("f") >= best).alias("f_bold"))


TAU = 0.99


@query(f"""WITH {HISTORY_SQL}, d AS (SELECT *, greatest(t - lag(t) OVER w, 0) AS gap, step AS i FROM history WINDOW w AS (PARTITION BY run_id ORDER BY step)), g AS (SELECT run_id, i, v, CASE WHEN i = 0 THEN 0 WHEN gap <= 0 THEN 1 ELSE gap END AS dt FROM d),
    c AS (SELECT *, sum(dt) OVER (PARTITION BY run_id) - sum(dt) OVER (PARTITION BY run_id ORDER BY i) AS ahead FROM g)
    SELECT run_id, count(*) AS points, round(sum(CASE WHEN i = 0 THEN v ELSE (1 - exp(-dt / {TAU})) * v END * exp(-ahead / {TAU})), 3) AS ema FROM c GROUP BY run_id""")
def ema_time_weighted(spark, sf_dir):
    """The last value of a time-weighted moving average, in closed form: no step waits for the one before it."""
    order = Window.partitionBy("run_id").orderBy("step")
    gap = F.col("t") - F.lag("t").over(order)
    rows = history(spark, sf_dir).withColumn("dt", F.when(F.col("step") == 0, 0).when(gap <= 0, 1).otherwise(gap))
    rows = rows.withColumn("ahead", F.sum("dt").over(Window.partitionBy("run_id")) - F.sum("dt").over(order))
    part = F.when(F.col("step") == 0, F.col("v")).otherwise((1 - F.exp(-F.col("dt") / TAU)) * F.col("v"))
    return rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("points"), F.round(F.sum(part * F.exp(-F.col("ahead") / TAU)), 3).alias("ema"))


@query(f"WITH {RUNS_SQL} SELECT domain, dataset, count(*) AS n, CAST(round(sum(rate) * 100) AS BIGINT) AS cents, CAST(grouping(domain, dataset) AS BIGINT) AS level FROM runs GROUP BY ROLLUP (domain, dataset)")
def subset_rollup(spark, sf_dir):
    """Counts and cents of each subset, each domain and all. Wholes are summed as decimals and what is left of them as
    doubles, so that a sum is rounded once and doesn't depend on the order in which millions of rates come."""
    whole = F.rint("rate")
    parts = runs(spark, sf_dir).groupBy("domain", "dataset").agg(F.count(F.lit(1)).alias("n"), F.sum(whole.cast("decimal(28,0)")).alias("whole"), F.sum(F.col("rate") - whole).alias("rest"))
    total = F.sum("whole").cast("double") + F.sum("rest")
    return parts.rollup("domain", "dataset").agg(F.sum("n").alias("n"), F.round(total * 100).cast("long").alias("cents"), F.grouping_id().cast("long").alias("level"))


@query(f"WITH {RUNS_SQL}, c AS (SELECT domain, status, count(*) AS n FROM runs GROUP BY ALL) SELECT domain, status, n, round(100.0 * n / sum(n) OVER (PARTITION BY domain), 6) AS percent FROM c")
def percent_per_subset(spark, sf_dir):
    counts = runs(spark, sf_dir).groupBy("domain", "status").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("domain")), 6))


@query(f"WITH {RUNS_SQL} SELECT dataset, round(quantile_cont(rate, 0.25), 4) AS q1, round(quantile_cont(rate, 0.5), 4) AS q2, round(quantile_cont(rate, 0.75), 4) AS q3, round(min(rate), 4) AS least, round(max(rate), 4) AS most FROM runs GROUP BY dataset")
def box_stats(spark, sf_dir):
    found = quantiles(runs(spark, sf_dir), "dataset", "rate", {"least": 0.0, "q1": 0.25, "q2": 0.5, "q3": 0.75, "most": 1.0})
    return found.select("dataset", *(F.round(q, 4).alias(q) for q in ("q1", "q2", "q3", "least", "most")))


@query("SELECT o_orderkey AS run_id, 'priority:' || o_orderpriority[3:] || '-status:' || o_orderstatus || '-key:' || o_custkey AS params, sha256('priority:' || o_orderpriority[3:] || '-status:' || o_orderstatus || '-key:' || o_custkey) AS params_hash FROM orders")
def param_string_hash(spark, sf_dir):
    params = F.concat_ws("-", F.concat(F.lit("priority:"), F.substring("o_orderpriority", 3, 99)), F.concat(F.lit("status:"), "o_orderstatus"), F.concat(F.lit("key:"), F.col("o_custkey").cast("string")))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), params.alias("params"), F.sha2(params, 256).alias("params_hash"))


_PARAMS_SQL = "'status:' || o_orderstatus || '-key:' || o_custkey || CASE WHEN o_orderkey % 3 = 0 THEN '-scale:' || (o_orderkey % 8) / 8.0::DOUBLE ELSE '' END || CASE WHEN o_orderkey % 5 = 0 THEN '-flag' ELSE '' END"


@query(f"WITH p AS (SELECT o_orderkey AS run_id, {_PARAMS_SQL} AS params FROM orders) SELECT run_id, regexp_extract(params, 'status:([^-]*)', 1) AS status, CAST(regexp_extract(params, 'key:([^-]*)', 1) AS BIGINT) AS key, TRY_CAST(nullif(regexp_extract(params, 'scale:([^-]*)', 1), '') AS DOUBLE) AS scale, len(string_split(params, '-')) AS fields, params LIKE '%-flag' AS flag FROM p")
def param_parse(spark, sf_dir):
    """Reads key:value-key:value strings back into columns; some lack a field, some have one without a value."""
    scale = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("scale:"), ((F.col("o_orderkey") % 8) / 8).cast("string")))
    params = F.concat_ws("-", F.concat(F.lit("status:"), "o_orderstatus"), F.concat(F.lit("key:"), F.col("o_custkey").cast("string")), scale, F.when(F.col("o_orderkey") % 5 == 0, "flag"))
    parsed = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.str_to_map(params, F.lit("-"), F.lit(":")).alias("m"))
    field = lambda name: F.element_at("m", name)
    return parsed.select("run_id", field("status").alias("status"), field("key").cast("long").alias("key"), field("scale").cast("double").alias("scale"), F.cardinality("m").cast("long").alias("fields"), F.map_contains_key("m", "flag").alias("flag"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, coalesce(json_extract_string(props, '$.k.value'), json_extract_string(props, '$.k')) AS unwrapped FROM events")
def json_config_extract(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").select("event_id", F.expr("try_cast(get_json_object(props, '$.k') as long)").alias("k"), F.coalesce(F.get_json_object("props", "$.k.value"), k).alias("unwrapped"))


@query(f"WITH {RUNS_SQL}, t AS (SELECT domain, dataset, status, CASE WHEN count(*) > 20 THEN CAST(floor(avg(rate)) AS BIGINT) END AS mean FROM runs GROUP BY ALL), m AS (SELECT *, max(mean) OVER (PARTITION BY dataset) AS top FROM t), l AS (SELECT domain, dataset, {latex_sql("replace(dataset, ' ', '_')")} || ' & ' || string_agg(CASE WHEN mean IS NULL THEN '---' WHEN mean = top THEN '\\textbf{{' || mean || '}}' ELSE CAST(mean AS VARCHAR) END, ' & ' ORDER BY status) || ' \\\\' AS cells FROM m GROUP BY domain, dataset), r AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY domain) AS n FROM l WINDOW w AS (PARTITION BY domain ORDER BY dataset)) SELECT domain, i, CASE WHEN domain = 'AFRICA' THEN '% ' ELSE '' END || CASE WHEN i = 1 THEN '\\multirow{{' || n || '}}{{*}}{{' || {latex_sql('domain')} || '}} & ' ELSE ' & ' END || cells AS line FROM r")
def latex_rows(spark, sf_dir):
    """Table rows: the domain over several rows, names escaped, the best in bold, dashes for too few runs, a domain commented out."""
    mean = F.when(F.count(F.lit(1)) > 20, F.floor(F.avg("rate")).cast("long"))
    means = runs(spark, sf_dir).groupBy("domain", "dataset", "status").agg(mean.alias("mean"))
    top = F.max("mean").over(Window.partitionBy("dataset"))
    shown = F.col("mean").cast("string")
    cell = means.withColumn("cell", F.when(F.col("mean").isNull(), "---").when(F.col("mean") == top, F.concat(F.lit("\\textbf{"), shown, F.lit("}"))).otherwise(shown))
    lines = cell.groupBy("domain", "dataset").agg(F.expr("array_join(transform(array_sort(collect_list(struct(status, cell))), c -> c.cell), ' & ')").alias("cells"))
    of = Window.partitionBy("domain")
    rows = lines.withColumn("i", F.row_number().over(of.orderBy("dataset"))).withColumn("n", F.count(F.lit(1)).over(of).cast("string"))
    head = F.when(F.col("i") == 1, F.concat(F.lit("\\multirow{"), "n", F.lit("}{*}{"), latex_escaped(F.col("domain")), F.lit("} & "))).otherwise(" & ")
    line = F.concat(F.when(F.col("domain") == "AFRICA", "% ").otherwise(""), head, latex_escaped(F.replace("dataset", F.lit(" "), F.lit("_"))), F.lit(" & "), "cells", F.lit(" \\\\"))
    return rows.select("domain", F.col("i").cast("long").alias("i"), line.alias("line"))


@query("SELECT c_custkey, coalesce(TRY_CAST(nullif(CASE WHEN c_custkey % 5 = 0 THEN 'NA' ELSE CAST(c_nationkey AS VARCHAR) END, 'NA') AS BIGINT), -1) AS value, lower(CASE WHEN c_custkey % 2 = 0 THEN 'True' ELSE '0' END) IN ('true', '1') AS flag FROM customer")
def coerce_columns(spark, sf_dir):
    """Text to numbers with errors as null (then -1), and text to booleans."""
    text = F.when(F.col("c_custkey") % 5 == 0, "NA").otherwise(F.col("c_nationkey").cast("string"))
    flag = F.when(F.col("c_custkey") % 2 == 0, "True").otherwise("0")
    return table(spark, sf_dir, "customer").select("c_custkey", F.coalesce(F.nullif(text, F.lit("NA")).try_cast("long"), F.lit(-1)).alias("value"), F.lower(flag).isin("true", "1").alias("flag"))


@query("WITH p AS (SELECT p_partkey, 'stems/' || CASE WHEN p_size % 2 = 0 THEN 'train' ELSE 'test' END || '/' || replace(p_name, ' ', '_') || '.' || p_size || '.' || p_brand || '.wav' AS path FROM part), n AS (SELECT *, string_split(path, '/')[-1] AS name, string_split(path, '/')[-2] AS split FROM p) SELECT p_partkey, split_part(name, '.', 1) AS song, string_split(name, '.')[-2] AS stem, split, split = 'train' AS is_train, string_split(name, '.')[-1] AS extension FROM n")
def path_parsing(spark, sf_dir):
    """From a path: the song (before the first dot of its name), the stem (the last but one part), the folder's split."""
    split = F.when(F.col("p_size") % 2 == 0, "train").otherwise("test")
    name = F.concat_ws(".", F.replace("p_name", F.lit(" "), F.lit("_")), F.col("p_size").cast("string"), "p_brand", F.lit("wav"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.split(F.concat_ws("/", F.lit("stems"), split, name), "/").alias("path"))
    rows = rows.select("p_partkey", F.element_at("path", -1).alias("name"), F.element_at("path", -2).alias("split"))
    parts = F.split("name", r"\.")
    return rows.select("p_partkey", F.substring_index("name", ".", 1).alias("song"), F.element_at(parts, -2).alias("stem"), "split", (F.col("split") == "train").alias("is_train"), F.element_at(parts, -1).alias("extension"))
