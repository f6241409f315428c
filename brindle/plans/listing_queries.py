"""Queries that list, name and format: sorts by derived keys, filters by group, nested fields, label sets, code tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.latex import latex_escaped, latex_sql
from ..operators.numbering import numbered
from ..session import kept
from ..sources.views import HISTORY_SQL, MONO_SQL, RUNS_SQL, STEREO_SQL, history, runs, table, wave_mono, wave_stereo
from .registry import query
from .report_queries import MEAN, MEAN_SQL, TAU

#: Rows of a report: at most 125 configurations, so one window over all of them stays small.
REPORT_SQL = f"{RUNS_SQL}, report AS (SELECT dataset, priority, CASE WHEN priority <> '5-LOW' THEN {MEAN_SQL} END AS mean, CASE WHEN count(*) FILTER (status = 'P') > 8 THEN 'Stereo' ELSE 'Mono' END AS channels FROM runs GROUP BY dataset, priority)"


def report(spark, sf_dir):
    mean = F.when(F.col("priority") != "5-LOW", F.expr(MEAN))
    channels = F.when(F.count_if(F.col("status") == "P") > 8, "Stereo").otherwise("Mono")
    return runs(spark, sf_dir).groupBy("dataset", "priority").agg(mean.alias("mean"), channels.alias("channels"))


@query(f"WITH {REPORT_SQL} SELECT dataset, priority, coalesce(mean, -1) AS mean, row_number() OVER (ORDER BY report.mean DESC NULLS LAST, dataset, priority) AS line FROM report")
def sort_nulls_last(spark, sf_dir):
    line = F.row_number().over(Window.orderBy(F.desc_nulls_last("mean"), "dataset", "priority"))
    return report(spark, sf_dir).select("dataset", "priority", F.coalesce("mean", F.lit(-1)).alias("mean"), line.alias("line"))


@query(f"WITH {REPORT_SQL}, t AS (SELECT *, coalesce(CAST(mean // 1000000 AS VARCHAR), '--') AS shown FROM report) SELECT dataset, priority, channels, shown, row_number() OVER (ORDER BY CASE channels WHEN 'Mono' THEN 0 ELSE 1 END, CASE shown WHEN '--' THEN 'infinity'::DOUBLE ELSE CAST(shown AS DOUBLE) END, dataset, priority) AS line FROM t")
def sort_by_derived_key(spark, sf_dir):
    """Mono before stereo, and rows without a number after those with one."""
    shown = report(spark, sf_dir).withColumn("shown", F.coalesce(F.expr("mean div 1000000").cast("string"), F.lit("--")))
    order = (F.when(F.col("channels") == "Mono", 0).otherwise(1), F.when(F.col("shown") == "--", float("inf")).otherwise(F.expr("try_cast(shown as double)")), "dataset", "priority")
    return shown.select("dataset", "priority", "channels", "shown", F.row_number().over(Window.orderBy(*order)).alias("line"))


@query(f"WITH {RUNS_SQL}, a AS (SELECT dataset, 'FLAC' AS compressor, {MEAN_SQL} AS rate, FALSE AS is_estimated FROM runs WHERE status = 'F' GROUP BY dataset), b AS (SELECT dataset, 'estimate' AS compressor, 34043 AS rate, TRUE AS is_estimated FROM runs WHERE status = 'O' GROUP BY dataset) SELECT * FROM a UNION ALL SELECT * FROM b")
def union_results(spark, sf_dir):
    """Measured and estimated results as one table; the estimates lack a column."""
    rows = runs(spark, sf_dir)
    measured = rows.where("status = 'F'").groupBy("dataset").agg(F.lit("FLAC").alias("compressor"), F.expr(MEAN).alias("rate"), F.lit(False).alias("is_estimated"))
    estimates = rows.where("status = 'O'").select("dataset").distinct().select("dataset", F.lit("estimate").alias("compressor"), F.lit(34043).cast("long").alias("rate"))
    return measured.unionByName(estimates, allowMissingColumns=True).fillna(True, ["is_estimated"])


@query("""WITH o AS (SELECT o_custkey AS worker, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, o_orderkey % 10 AS digit, substr(o_orderpriority, 1, 1) AS intelligibility FROM orders)
    SELECT worker, (i - 1) // 3 AS sheet, CAST((i - 1) % 3 + 1 AS INTEGER) AS recording, CAST(digit AS VARCHAR) AS digit, intelligibility FROM o""")
def wide_to_long_by_pattern(spark, sf_dir):
    """Survey answers in columns Answer.recording_{i}_{question}, a row for each worker's sheet of three, as a row for each recording."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("worker"), "o_orderkey", (F.col("o_orderkey") % 10).cast("string").alias("digit"), F.substring("o_orderpriority", 1, 1).alias("intelligibility"))
    first = numbered(orders, "worker", ["o_orderkey"], "n").withColumn("sheet", F.expr("n div 3")).withColumn("i", F.col("n") % 3 + 1)
    wide = first.groupBy("worker", "sheet").agg(*(F.max(F.when(F.col("i") == k, F.col(q))).alias(f"Answer.recording_{k}_{q}") for k in (1, 2, 3) for q in ("digit", "intelligibility")))
    answers = wide.unpivot(["worker", "sheet"], [F.col(f"`{c}`") for c in wide.columns if c not in ("worker", "sheet")], "question", "answer").where("answer is not null")
    named = answers.select("worker", "sheet", F.regexp_extract("question", r"recording_(\d+)_", 1).cast("int").alias("recording"), F.regexp_extract("question", r"_(\w+)$", 1).alias("q"), "answer")
    parts = named.withColumn("q", F.regexp_replace("q", r"^.*\d_", ""))
    return parts.groupBy("worker", "sheet", "recording").pivot("q", ["digit", "intelligibility"]).agg(F.max("answer"))


@query(f"WITH {HISTORY_SQL}, d AS (SELECT *, greatest(t - lag(t) OVER w, 0) AS gap FROM history WINDOW w AS (PARTITION BY run_id ORDER BY step)), g AS (SELECT run_id, step, (v - 200000) / 50000 AS v, CASE WHEN step = 0 THEN 0 WHEN gap <= 0 THEN 1 ELSE gap END AS dt FROM d), c AS (SELECT *, sum(dt) OVER (PARTITION BY run_id) - sum(dt) OVER (PARTITION BY run_id ORDER BY step) AS ahead FROM g), e AS (SELECT run_id, sum(CASE WHEN step = 0 THEN v ELSE (1 - exp(-dt / {TAU})) * v END * exp(-ahead / {TAU})) AS ema FROM c GROUP BY run_id) SELECT run_id, CASE WHEN round(ema, 4) > 0.01 THEN round(8 / ema, 3) END AS rate FROM e")
def ema_rate(spark, sf_dir):
    """Eight bits over the time-weighted mean of bits per byte; no rate where that isn't positive."""
    w = Window.partitionBy("run_id").orderBy("step")
    gap = F.greatest(F.col("t") - F.lag("t").over(w), F.lit(0))
    dt = F.when(F.col("step") == 0, 0).when(gap <= 0, 1).otherwise(gap)
    rows = history(spark, sf_dir).select("run_id", "step", ((F.col("v") - 200000) / 50000).alias("v"), dt.alias("dt"))
    ahead = F.sum("dt").over(Window.partitionBy("run_id")) - F.sum("dt").over(w)
    share = F.when(F.col("step") == 0, F.col("v")).otherwise((1 - F.exp(-F.col("dt") / TAU)) * F.col("v"))
    means = rows.withColumn("part", share * F.exp(-ahead / TAU)).groupBy("run_id").agg(F.sum("part").alias("ema"))
    return means.select("run_id", F.when(F.round("ema", 4) > 0.01, F.round(8 / F.col("ema"), 3)).alias("rate"))


@query("WITH t AS (SELECT l_orderkey, l_linenumber, l_returnflag AS bits, l_linestatus AS channels, CASE WHEN l_linenumber > 1 THEN CAST(l_quantity AS BIGINT) END AS n FROM lineitem) SELECT bits, channels, n, count(*) AS runs FROM t WHERE n IS NULL OR n IN (1, 8, CASE WHEN bits = 'A' AND channels = 'F' THEN 32 ELSE 48 END) GROUP BY ALL")
def group_rule_filter(spark, sf_dir):
    """Keeps block sizes 1, 8 and the largest that the group allows, and rows without one."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("bits"), F.col("l_linestatus").alias("channels"), F.when(F.col("l_linenumber") > 1, F.col("l_quantity").cast("long")).alias("n"))
    most = F.when((F.col("bits") == "A") & (F.col("channels") == "F"), 32).otherwise(48)
    return items.where(F.col("n").isNull() | F.col("n").isin(1, 8) | (F.col("n") == most)).groupBy("bits", "channels", "n").agg(F.count(F.lit(1)).alias("runs"))


@query(f"WITH {MONO_SQL} SELECT track_id, count(*) AS size, count(*) * 441 // 160 // 64 AS chunks FROM wave GROUP BY track_id HAVING count(*) * 441 // 160 // 64 >= 3")
def min_length_filter(spark, sf_dir):
    """Tracks that have enough chunks after their rate is scaled."""
    sizes = wave_mono(spark, sf_dir).groupBy("track_id").agg(F.count(F.lit(1)).alias("size"))
    return sizes.withColumn("chunks", F.expr("size * 441 div 160 div 64")).where("chunks >= 3")


@query("SELECT p_partkey, CASE WHEN lower(p_type) LIKE 'promo%' THEN 1 WHEN regexp_matches(lower(p_type), '^(large|medium)') THEN CAST(regexp_extract(p_brand, '(\\d+)', 1) AS BIGINT) ELSE -1 END AS estimator FROM part")
def name_to_enum(spark, sf_dir):
    """A number for a configuration's name: fixed for some, read from the name for others."""
    kind, number = F.lower("p_type"), F.regexp_extract("p_brand", r"(\d+)", 1).cast("long")
    return table(spark, sf_dir, "part").select("p_partkey", F.when(kind.startswith("promo"), 1).when(kind.rlike("^(large|medium)"), number).otherwise(-1).cast("long").alias("estimator"))


@query("SELECT p_partkey, format('{:,}', CAST(round(p_retailprice * 100) AS BIGINT)) AS thousands, format('{:.2f} kHz', (p_size * 250) / 1000.0) AS khz, p_size || CASE WHEN p_size % 2 = 1 THEN 'M' ELSE 'S' END AS channels FROM part")
def number_formats(spark, sf_dir):
    """Thousands separators, kilohertz, and sizes with a mono or stereo suffix."""
    cents = F.round(F.col("p_retailprice") * 100).cast("long")
    return table(spark, sf_dir, "part").select("p_partkey", F.format_number(cents, 0).alias("thousands"), F.format_string("%.2f kHz", F.col("p_size") * 250 / 1000.0).alias("khz"), F.concat(F.col("p_size").cast("string"), F.when(F.col("p_size") % 2 == 1, "M").otherwise("S")).alias("channels"))


@query(f"WITH t AS (SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN props || '_50%~' || event_type || '$x^2 & c:\\d #1' END AS s FROM events) SELECT event_id, {latex_sql('s')} AS tex FROM t")
def latex_escape(spark, sf_dir):
    s = F.when(F.col("event_id") % 11 != 0, F.concat("props", F.lit("_50%~"), "event_type", F.lit("$x^2 & c:\\d #1")))
    return table(spark, sf_dir, "events").select("event_id", latex_escaped(s).alias("tex"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN TIMESTAMP '1970-01-01 00:00:00' ELSE date_trunc('second', o_orderdate) END AS ts FROM orders")
def timestamp_fallback(spark, sf_dir):
    """Time stamps written and parsed; the least one where there is none that can be read."""
    shown = F.when(F.col("o_orderkey") % 5 == 0, "not yet").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    parsed = F.expr("try_to_timestamp(shown, 'yyyy-MM-dd HH:mm:ss')").cast("timestamp_ntz")
    return table(spark, sf_dir, "orders").withColumn("shown", shown).select("o_orderkey", F.coalesce(parsed, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")).alias("ts"))


@query("SELECT event_id, CASE event_id % 5 WHEN 4 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events")
def nested_key_search(spark, sf_dir):
    """One key of configurations that nest it in different places, or wrap it, or lack it."""
    shapes = [F.concat(F.lit(a), "props", F.lit(b)) for a, b in (("", ""), ('{"value": ', "}"), ('{"model": {"estimator": ', "}}"), ('{"config": {"value": ', "}}"))]
    config = F.when(F.col("event_id") % 5 == 4, '{"other": 1}')
    for i, shape in enumerate(shapes):
        config = config.when(F.col("event_id") % 5 == i, shape)
    found = F.coalesce(*(F.get_json_object("config", p) for p in ("$.k", "$.value.k", "$.model.estimator.k", "$.config.value.k")))
    return table(spark, sf_dir, "events").withColumn("config", config).select("event_id", found.cast("long").alias("k"))


@query("SELECT r_name, n_name AS key, n_nationkey AS value, [n_nationkey, n_nationkey, n_nationkey]::VARCHAR AS repeated FROM nation JOIN region ON n_regionkey = r_regionkey")
def map_inverse(spark, sf_dir):
    """Maps from key to name turned round, and a value repeated."""
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    maps = nations.groupBy("r_name").agg(F.map_from_entries(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("m"))
    turned = maps.select("r_name", F.explode(F.map_from_arrays(F.map_values("m"), F.map_keys("m"))).alias("key", "value"))
    return turned.withColumn("repeated", F.concat(F.lit("["), F.array_join(F.array_repeat("value", 3), ", "), F.lit("]")))


@query("WITH c AS (SELECT o_custkey, o_orderpriority AS p, count(*) AS n FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY ALL) SELECT o_custkey, p AS class, n AS weight FROM c QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, p) = 1")
def map_argmax(spark, sf_dir):
    """The class of most weight in a map from codes to weights, some codes being left out."""
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey", F.col("o_orderpriority").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    maps = counts.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("p", "n"))).alias("codes"))
    best = F.array_max(F.transform(F.map_entries(F.map_filter("codes", lambda k, v: k != "5-LOW")), lambda e: F.struct(e["value"].alias("n"), (-F.ascii(e["key"])).alias("order"), e["key"].alias("p"))))
    return maps.withColumn("best", best).where("best is not null").select("o_custkey", F.col("best.p").alias("class"), F.col("best.n").alias("weight"))


@query("SELECT event_id, (event_id % 500) // 50 AS label, 'f' || event_id % 500 AS filename FROM events")
def generated_dimension_join(spark, sf_dir):
    """Rows joined with a generated table of 500 file names and their labels."""
    names = spark.range(500).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("filename"), F.expr("id div 50").alias("label"))
    events = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("f"), (F.col("event_id") % 500).cast("string")).alias("filename"))
    return events.join(F.broadcast(names), "filename").select("event_id", "label", "filename")


@query(f"WITH {STEREO_SQL} SELECT track_id, count(*) AS n, CAST(sum(abs(l - r)) AS BIGINT) AS difference FROM wave GROUP BY track_id")
def positional_zip_join(spark, sf_dir):
    """Two channels kept as tables of their own, joined sample by sample."""
    both = kept(wave_stereo(spark, sf_dir), "channels")
    zipped = both.select("track_id", "n", "l").join(both.select("track_id", "n", "r"), ["track_id", "n"])
    return zipped.groupBy("track_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.abs(F.col("l") - F.col("r"))).alias("difference"))


@query("SELECT l_orderkey AS ecg_id, string_agg(DISTINCT r_name, ',' ORDER BY r_name) AS classes FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'AFRICA' GROUP BY l_orderkey")
def code_table_classes(spark, sf_dir):
    """The classes of each record's codes, by a table of codes; codes without a class are left out."""
    codes = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region").where("r_name <> 'AFRICA'"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("s_suppkey").alias("code"), F.col("r_name").alias("class"))
    records = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("ecg_id")).agg(F.map_from_entries(F.collect_set(F.struct("l_suppkey", F.lit(100.0)))).alias("scp_codes"))
    exploded = records.select("ecg_id", F.explode("scp_codes").alias("code", "weight"))
    return exploded.join(codes, "code").groupBy("ecg_id").agg(F.array_join(F.array_sort(F.collect_set("class")), ",").alias("classes"))


@query("WITH f AS (SELECT l_orderkey, l_returnflag AS flag, min((l_linenumber, l_partkey, l_suppkey)) AS first FROM lineitem GROUP BY ALL) SELECT l_orderkey, string_agg(flag, ',' ORDER BY first, flag) AS flags FROM f GROUP BY l_orderkey")
def ordered_unique(spark, sf_dir):
    """The distinct values of a list in the order in which they first occur."""
    first = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"))).alias("v"))
    return first.select("l_orderkey", F.array_join(F.array_distinct("v.l_returnflag"), ",").alias("flags"))


@query("WITH l AS (SELECT o_custkey AS id, list_sort(list(DISTINCT substr(o_orderpriority, 1, 1))) AS labels FROM orders GROUP BY ALL), k AS (SELECT id, list_filter(labels, lambda x: x IN ('1', '2', '4')) AS common FROM l) SELECT id, array_to_string(common, ',') AS common FROM k WHERE len(common) > 0")
def label_intersection(spark, sf_dir):
    """Records with the labels that they have of a given set, those without any left out."""
    labels = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.collect_set(F.substring("o_orderpriority", 1, 1)).alias("labels"))
    common = labels.select("id", F.array_intersect("labels", F.array(*map(F.lit, "124"))).alias("common"))
    return common.where(F.size("common") > 0).select("id", F.array_join(F.array_sort("common"), ",").alias("common"))


@query(f"WITH {STEREO_SQL} SELECT track_id, n // 8 AS frame, string_agg(l || ':' || r, ' ' ORDER BY n) AS pairs FROM wave GROUP BY ALL")
def transpose_channels(spark, sf_dir):
    """Frames of two rows of samples turned into rows of two samples."""
    frames = wave_stereo(spark, sf_dir).groupBy("track_id", F.expr("n div 8").alias("frame")).agg(F.array_sort(F.collect_list(F.struct("n", "l", "r"))).alias("v"))
    zipped = frames.select("track_id", "frame", F.arrays_zip(F.col("v.l").alias("l"), F.col("v.r").alias("r")).alias("z"))
    return zipped.select("track_id", "frame", F.array_join(F.transform("z", lambda p: F.concat_ws(":", p["l"].cast("string"), p["r"].cast("string"))), " ").alias("pairs"))


@query("WITH c AS (SELECT l_orderkey AS id, bool_or(l_returnflag = 'A')::INT AS a, bool_or(l_returnflag = 'N')::INT AS n, bool_or(l_returnflag = 'R')::INT AS r, max(l_linestatus) AS status FROM lineitem GROUP BY ALL) SELECT id, a, n, r, dense_rank() OVER (ORDER BY status) - 1 AS code FROM c")
def binarize_and_encode(spark, sf_dir):
    """A column of zeros and ones for each label, and a number for each class (of a handful) in order."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set("l_returnflag").alias("labels"), F.max("l_linestatus").alias("status"))
    classes = rows.select("status").distinct().select("status", (F.dense_rank().over(Window.orderBy("status")) - 1).cast("long").alias("code"))
    return rows.join(classes, "status").select("id", *(F.array_contains("labels", c).cast("int").alias(c.lower()) for c in "ANR"), "code")


@query("SELECT p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY regexp_replace(p_name, '\\d+', '', 'g'), CAST(p_partkey % 1000 AS BIGINT), p_partkey) AS place FROM part")
def natural_sort(spark, sf_dir):
    """Names in natural order: the numbers in them count as numbers."""
    named = table(spark, sf_dir, "part").withColumn("name", F.concat(F.regexp_replace("p_name", r"\d+", ""), F.lit("#"), (F.col("p_partkey") % 1000).cast("string")))
    named = named.select("p_type", "p_partkey", F.regexp_replace("name", r"#\d+$", "#").alias("stem"), F.lpad(F.regexp_extract("name", r"(\d+)$", 1), 12, "0").alias("number"))
    # the first bytes of a stem as a number, by which types with very many names are cut
    lead = F.conv(F.rpad(F.hex(F.substring(F.encode("stem", "utf-8"), 1, 6)), 12, "0"), 16, 10).cast("double")
    ranked = numbered(named.withColumn("lead", lead), "p_type", ["lead", "stem", "number", "p_partkey"], "place")
    return ranked.select("p_partkey", (F.col("place") + 1).alias("place"))


@query("WITH g AS (SELECT n_regionkey AS band, n_nationkey % 3 AS fs, count(*) AS n FROM nation GROUP BY ALL), w AS (SELECT band, max(n * 10 + (n + 1) * 2) AS width FROM g GROUP BY band) SELECT band, width, CAST(coalesce(sum(width) OVER (ORDER BY band ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM w")
def layout_packing(spark, sf_dir):
    """Where each band of a chart begins: as wide as its widest row, one after the other."""
    rows = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("band"), (F.col("n_nationkey") % 3).alias("fs")).agg(F.count(F.lit(1)).alias("n"))
    widths = rows.groupBy("band").agg(F.max(F.col("n") * 10 + (F.col("n") + 1) * 2).alias("width"))
    before = F.sum("width").over(Window.orderBy("band").rowsBetween(Window.unboundedPreceding, -1))
    return widths.select("band", "width", F.coalesce(before, F.lit(0)).alias("start"))


@query("SELECT coalesce(CASE WHEN c_acctbal >= 0 THEN c_mktsegment END, 'null') AS config, count(*) AS runs FROM customer GROUP BY 1")
def null_group(spark, sf_dir):
    """Runs by a configuration value; those without it are a group called null."""
    value = F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").groupBy(F.coalesce(value, F.lit("null")).alias("config")).agg(F.count(F.lit(1)).alias("runs"))
