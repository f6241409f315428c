"""Queries that write text files in the shared folder and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import fresh_path
from ..sources.files import append_csv, files_below, read_csv, read_ts, to_ts_lines, union_of_globs, write_chunks
from ..sources.views import HISTORY_SQL, MONO_SQL, RUNS_SQL, history, runs, table, wave_mono
from .registry import query


@query("SELECT 'root/' || p_brand || '/' || p_partkey AS path, p_size AS sample_rate FROM part WHERE p_size % 2 = 0 AND p_retailprice > 910")
def manifest_scan(spark, sf_dir):
    """A manifest in CSV: the rows that are mixes of the training split, filtered in the scan, below a root."""
    parts = table(spark, sf_dir, "part")
    manifest = parts.select(F.concat_ws("/", "p_brand", F.col("p_partkey").cast("string")).alias("path"), F.col("p_size").alias("sample_rate"), (F.col("p_size") % 2 == 0).alias("is_train"), (F.col("p_retailprice") > 910).alias("is_mix"))
    path = fresh_path(spark, "manifest")
    append_csv(manifest, path)
    rows = read_csv(spark, path, "path string, sample_rate int, is_train boolean, is_mix boolean").where("is_train and is_mix")
    return rows.select(F.concat(F.lit("root/"), "path").alias("path"), "sample_rate")


@query("SELECT o_orderkey AS run_id, o_orderpriority AS priority FROM orders WHERE o_orderstatus IN ('F', 'P')")
def union_of_globs_scan(spark, sf_dir):
    root = fresh_path(spark, "globs")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("priority"), "o_orderstatus")
    orders.write.partitionBy("o_orderstatus").parquet(root)
    return union_of_globs(spark, root, "run_id bigint, priority string", "*=F", "*=P")


@query("SELECT r_name AS song, count(*) AS files FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA' GROUP BY r_name")
def recursive_glob_scan(spark, sf_dir):
    """Files found at any depth below a root, but for those in one folder."""
    root = fresh_path(spark, "tree")
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    nations.select(F.lit("split_data").alias("kind"), "n_name", F.concat("n_name", F.lit(".mix.wav")).alias("value"), "r_name").repartition(25, "n_name").write.partitionBy("kind", "n_name", "r_name").text(root)
    found = files_below(spark, root, "*.txt", "r_name=ASIA")
    return found.groupBy(F.regexp_extract("path", "r_name=([^/]*)", 1).alias("song")).agg(F.countDistinct(F.regexp_extract("path", "n_name=([^/]*)", 1)).alias("files"))


@query("SELECT c_custkey AS path, CASE WHEN c_acctbal >= 0 THEN round(c_acctbal, 2) END AS rate, c_acctbal IS NULL OR c_acctbal < 0 AS missing FROM customer")
def csv_append_na(spark, sf_dir):
    """A result table in CSV, appended to batch by batch, with NA where there is no result."""
    path = fresh_path(spark, "results")
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("path"), F.when(F.col("c_acctbal") >= 0, F.round("c_acctbal", 2)).alias("rate"))
    for batch in range(2):
        append_csv(rows.where(F.col("path") % 2 == batch), path)
    back = read_csv(spark, path, "path bigint, rate double")
    return back.select("path", "rate", F.col("rate").isNull().alias("missing"))


@query("SELECT o_orderpriority AS priority, count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders GROUP BY o_orderpriority")
def csv_column_pruning(spark, sf_dir):
    """Two columns of a wide CSV table."""
    path = fresh_path(spark, "wide")
    orders = table(spark, sf_dir, "orders")
    append_csv(orders, path)
    rows = read_csv(spark, path, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate string, o_orderpriority string").select("o_orderpriority", "o_totalprice")
    return rows.groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))


@query("SELECT kind, (SELECT count(*) FROM supplier) + (kind = 'csv')::INT * 0 AS lines, (SELECT max(s_suppkey) FROM supplier) AS last FROM (SELECT unnest(['csv', 'json', 'text']) AS kind)")
def text_helpers(spark, sf_dir):
    """Lines, and the last key, of one table written as JSON, as text and as CSV."""
    path = fresh_path(spark, "helpers")
    keys = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"))
    keys.write.json(f"{path}/json")
    keys.select(F.col("key").cast("string")).write.text(f"{path}/text")
    append_csv(keys, f"{path}/csv")
    back = {"json": spark.read.schema("key bigint").json(f"{path}/json"), "text": spark.read.text(f"{path}/text").select(F.col("value").cast("long").alias("key")), "csv": read_csv(spark, f"{path}/csv", "key bigint")}
    counted = [rows.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("lines"), F.max("key").alias("last")) for kind, rows in back.items()]
    return counted[0].union(counted[1]).union(counted[2])


@query("SELECT n_name AS method, 's' || s_suppkey || '.wav' AS filename, s_suppkey % 50 AS uid FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def headerless_space_scan(spark, sf_dir):
    """Survey keys: method, file name and id by spaces, without a header."""
    path = fresh_path(spark, "keys")
    suppliers = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    suppliers.select("n_name", F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit(".wav")), F.col("s_suppkey") % 50).write.option("sep", " ").csv(path)
    return read_csv(spark, path, "method string, filename string, uid bigint", sep=" ", header=False)


@query("SELECT p_name AS text, p_size AS label FROM part")
def tsv_column_subset(spark, sf_dir):
    """The text and label columns of a tab-separated table with a header."""
    path = fresh_path(spark, "tsv")
    table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size").write.option("sep", "\t").option("header", True).csv(path)
    rows = read_csv(spark, path, "id bigint, text string, brand string, label int", sep="\t")
    return rows.select("text", "label")


@query(f"WITH {MONO_SQL}, f AS (SELECT track_id, n // 64 AS frame, CASE WHEN x % 10 <> 0 THEN x END AS x FROM wave) SELECT track_id || '-' || frame AS label, count(*) AS size, count(*) - count(x) AS n_missing, CAST(coalesce(sum(x), 0) AS BIGINT) AS total FROM f GROUP BY track_id, frame")
def ts_file_parser(spark, sf_dir):
    """Frames as lines of time-series text with tags, comments and missing values, parsed back."""
    path = fresh_path(spark, "ts")
    frames = wave_mono(spark, sf_dir).groupBy("track_id", F.expr("n div 64").alias("frame")).agg(F.array_sort(F.collect_list(F.struct("n", F.when(F.col("x") % 10 != 0, F.col("x")).alias("x")))).alias("v"))
    lines = to_ts_lines(frames.select(F.col("v.x").alias("v"), F.concat_ws("-", "track_id", "frame").alias("label")), "v", "label")
    spark.createDataFrame([("# a comment",), ("@problemName frames",), ("@data",)], "value string").write.text(path)
    lines.write.mode("append").text(path)
    rows = read_ts(spark, path)
    total = F.aggregate("values", F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("label", F.size("values").cast("long").alias("size"), F.col("n_missing").cast("long").alias("n_missing"), total.alias("total"))


@query(f"WITH {RUNS_SQL} SELECT run_id, dataset, priority, status = 'F' AS finished, round(8 / (1 + run_id % 7), 6) AS rate, round(rate, 2) AS size FROM runs WHERE status <> 'P'")
def tracker_export(spark, sf_dir):
    """Runs as a tracker exports them (nested config with wrapped values, summary), read with one schema."""
    path = fresh_path(spark, "tracker")
    rows = runs(spark, sf_dir)
    config = F.struct(F.struct(F.col("dataset").alias("value")).alias("dataset"), F.struct(F.struct(F.col("priority").alias("value")).alias("priority")).alias("model"))
    summary = F.struct((1 + F.col("run_id") % 7).alias("bpb"), F.col("rate").alias("size"))
    rows.select("run_id", F.when(F.col("status") == "F", "finished").when(F.col("status") == "O", "running").alias("state"), config.alias("config"), summary.alias("summary")).write.json(path)
    back = spark.read.schema("run_id bigint, state string, config struct<dataset:struct<value:string>,model:struct<priority:struct<value:string>>>, summary struct<bpb:double,size:double>").json(path)
    return back.where("state is not null").select("run_id", F.col("config.dataset.value").alias("dataset"), F.col("config.model.priority.value").alias("priority"), (F.col("state") == "finished").alias("finished"), F.round(8 / F.col("summary.bpb"), 6).alias("rate"), F.round("summary.size", 2).alias("size"))


@query(f"WITH {HISTORY_SQL}, m AS (SELECT run_id, step, unnest(['train/loss', 'val/loss']) AS metric, unnest([v, CASE WHEN step % 2 = 1 THEN 2 * v END]) AS v FROM history) SELECT run_id, metric, count(*) AS steps, CAST(arg_min(step, round(v * 100) * 1000000 + step) AS BIGINT) AS best_step, round(min(v), 2) AS best, CAST(max(step) AS BIGINT) AS last_step, round(arg_max(v, step), 2) AS last FROM m WHERE v IS NOT NULL GROUP BY ALL")
def tracker_history(spark, sf_dir):
    """The metric histories of runs as a tracker exports them (a line a step, metrics logged now and then), read back by
    metric: the steps that have it, its least value and its last one."""
    path = fresh_path(spark, "histories")
    logged = F.create_map(F.lit("train/loss"), F.col("v"), F.lit("val/loss"), F.when(F.col("step") % 2 == 1, 2 * F.col("v")))
    history(spark, sf_dir).select("run_id", F.col("step").alias("_step"), logged.alias("metrics")).write.json(path)
    lines = spark.read.schema("run_id bigint, _step bigint, metrics map<string,double>").json(path)
    rows = lines.select("run_id", F.col("_step").alias("step"), F.explode("metrics").alias("metric", "v")).where("v is not null")
    least = F.min(F.struct(F.round(F.col("v") * 100).alias("cents"), "step", "v")).alias("least")
    found = rows.groupBy("run_id", "metric").agg(F.count(F.lit(1)).alias("steps"), least, F.min("v").alias("best"), F.max(F.struct("step", "v")).alias("last"))
    return found.select("run_id", "metric", "steps", F.col("least.step").alias("best_step"), F.round("best", 2).alias("best"), F.col("last.step").alias("last_step"), F.round("last.v", 2).alias("last"))


@query("SELECT conv_id // 16 AS chunk, role, count(*) AS lines, CAST(sum(length(text)) AS BIGINT) AS chars, min(conv_id) AS first FROM conversations GROUP BY ALL")
def jsonl_sink_merge(spark, sf_dir):
    """Inferences as JSON lines in a folder a chunk, merged once all chunks are committed."""
    path = fresh_path(spark, "inferences")
    rows = table(spark, sf_dir, "conversations").select(F.expr("conv_id div 16").alias("chunk"), "conv_id", "turn", F.struct("role", "text").alias("input"))
    write_chunks(rows, path, "chunk")
    merged = spark.read.schema("chunk bigint, conv_id bigint, turn bigint, input struct<role:string,text:string>").json(path)
    return merged.groupBy("chunk", F.col("input.role").alias("role")).agg(F.count(F.lit(1)).alias("lines"), F.sum(F.char_length("input.text")).alias("chars"), F.min("conv_id").alias("first"))


@query("SELECT n_regionkey AS folder, count(*) AS files, count(*) = 5 AS complete FROM nation GROUP BY n_regionkey")
def directory_discovery(spark, sf_dir):
    """Folders found below a root, with the number of their files against the number there should be."""
    root = fresh_path(spark, "folders")
    nations = table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", F.col("n_name").alias("value"))
    nations.repartition(25, "n_nationkey").write.partitionBy("n_regionkey", "n_nationkey").text(root)
    found = files_below(spark, root, "*.txt", "").select(F.regexp_extract("path", r"n_regionkey=(\d+)", 1).cast("int").alias("folder"), F.regexp_extract("path", r"n_nationkey=(\d+)", 1).alias("file"))
    counted = found.distinct().groupBy("folder").agg(F.count(F.lit(1)).alias("files"))
    return counted.select("folder", "files", (F.col("files") == 5).alias("complete"))


@query("SELECT o_orderkey AS run_id, o_orderstatus AS status, o_orderpriority AS priority FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')")
def reset_rewrite(spark, sf_dir):
    """Deletes one configuration's rows from a result table by rewriting the partition that holds it, and no other."""
    path = fresh_path(spark, "reset")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"))
    orders.write.partitionBy("status").parquet(path)
    known = spark.read.schema("run_id bigint, priority string, status string").parquet(path)
    kept = known.where("status = 'F' and priority <> '1-URGENT'")
    fresh = fresh_path(spark, "reset-part")
    kept.write.parquet(fresh)
    spark.read.schema(kept.schema).parquet(fresh).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("status").parquet(path)
    return spark.read.schema("run_id bigint, priority string, status string").parquet(path).select("run_id", "status", "priority")
