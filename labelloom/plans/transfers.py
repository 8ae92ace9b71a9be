"""Sources and sinks: what is written into the shared folder comes back whole, and is what the query returns."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelloom.operators import manifest as mf
from labelloom.plans.registry import query, values
from labelloom.sources import files as fs
from labelloom.sources.config import read_config, with_paths
from labelloom.sources.extracts import supervised
from labelloom.streaming import incremental, status


@query("A3_extracts", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'O')")
def a3(t):
    """Partitions by status; writing one of them again replaces it and leaves the others."""
    path = fs.scratch(t.spark, "extracts")
    rows = t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus")
    fs.write_partitions(rows, path, "o_orderstatus")
    fs.write_partitions(rows.where("o_orderstatus = 'F'"), path, "o_orderstatus")
    return fs.read_table(t.spark, path, ["o_orderkey", "o_totalprice", "o_orderstatus"], "o_orderstatus in ('F', 'O')")


@query("A4_supervised_extracts", "SELECT 'priority ' || substr(o_orderpriority, 1, 1) AS name, 'ok' AS status, count(*) AS n_rows FROM orders GROUP BY o_orderpriority UNION ALL SELECT 'broken', 'failed', NULL UNION ALL SELECT 'known', 'skipped', NULL")
def a4(t):
    """A dataset for each priority, extracted side by side, beside one that fails and one that is there already."""
    rows = t.orders.select("o_orderkey", "o_totalprice", "o_orderpriority")
    names = [r[0] for r in rows.select("o_orderpriority").distinct().orderBy("o_orderpriority").collect()]  # priorities are a fixed handful
    datasets = {f"priority {p[0]}": (lambda p=p: rows.where(F.col("o_orderpriority") == p)) for p in names}
    datasets |= {"broken": lambda: rows.select(F.raise_error(F.lit("no such column")).alias("x")), "known": lambda: rows}
    status = supervised(t.spark, datasets, fs.scratch(t.spark, "datasets"), seconds=600, done=["known"])
    return status.select("name", "status", "n_rows")


@query("A6_csv_table", "SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_size % 2 = 1")
def a6(t):
    """Rows marked for use, one a key, although the file holds each row twice."""
    path = fs.scratch(t.spark, "parts")
    rows = t.part.select("p_partkey", "p_name", "p_retailprice", (F.col("p_size") % 2).alias("use"))
    fs.write_csv(rows.union(rows), path)
    return fs.read_csv(t.spark, path, "p_partkey long, p_name string, p_retailprice double, use int", key="p_partkey", where="use = 1").drop("use")


@query(
    "A7_csv_columns",
    "SELECT c_nationkey, array_to_string(list_sort(list(DISTINCT c_mktsegment)), '|') AS segments, count(*) AS s_n, max(c_acctbal) AS s_top FROM customer GROUP BY c_nationkey",
)
def a7(t):
    """Structs become columns and arrays joined text."""
    path = fs.scratch(t.spark, "nested")
    nested = t.customer.groupBy("c_nationkey").agg(
        F.array_sort(F.collect_set("c_mktsegment")).alias("segments"), F.struct(F.count("*").alias("n"), F.max("c_acctbal").alias("top")).alias("s"))
    fs.write_csv(nested, path)
    return fs.read_csv(t.spark, path, "c_nationkey int, segments string, s_n long, s_top double")


@query("A8_tsv_text", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CASE WHEN n_regionkey = 1 THEN '' ELSE CAST(n_regionkey AS VARCHAR) END AS n_regionkey FROM nation")
def a8(t):
    """All columns text, missing values empty."""
    path = fs.scratch(t.spark, "nations")
    rows = t.nation.select("n_nationkey", "n_name", F.when(F.col("n_regionkey") != 1, F.col("n_regionkey")).alias("n_regionkey"))
    rows.write.option("sep", "\t").option("header", True).csv(path)
    return fs.read_tsv_text(t.spark, path, ["n_nationkey", "n_name", "n_regionkey"]).drop("ord")


@query("A10_json_lines_strict", "SELECT conv_id, turn, role, text FROM conversations")
def a10(t):
    path = fs.scratch(t.spark, "conversations")
    fs.write_json_lines(t.conversations, path)
    return fs.read_json_lines(t.spark, path, "conv_id long, turn long, role string, text string", strict=True)


@query("A13_json_lines_appended", "SELECT s_suppkey, CASE WHEN s_nationkey > 9 THEN s_name END AS s_name FROM supplier")
def a13(t):
    """Two writes to one folder; nulls come back as nulls."""
    path = fs.scratch(t.spark, "suppliers")
    rows = t.supplier.select("s_suppkey", F.when(F.col("s_nationkey") > 9, F.col("s_name")).alias("s_name"))
    fs.write_json_lines(rows.where("s_suppkey % 2 = 0"), path)
    fs.write_json_lines(rows.where("s_suppkey % 2 <> 0"), path, append=True)
    return fs.read_json_lines(t.spark, path, "s_suppkey long, s_name string")


@query("A14_json_document", "SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name AS value FROM nation")
def a14(t):
    """One JSON object as rows of its keys, comments left out."""
    path = fs.scratch(t.spark, "document")
    pairs = t.nation.select(F.col("n_nationkey").cast("string").alias("key"), F.col("n_name").alias("value"))
    fs.write_map_document(pairs.union(values(t.spark, [("_note", "not a key")], "key string, value string")), path)
    return fs.read_map_document(t.spark, path).drop("ord")


@query("A16_files", "SELECT * FROM (VALUES ('nation.parquet'), ('orders.parquet'), ('part.parquet'), ('pages.parquet'), ('region.parquet')) v(name) WHERE name LIKE 'n%' OR name LIKE 'r%'")
def a16(t):
    """Files by pattern and size, without reading them."""
    return fs.files(t.spark, t.folder, "[nr]*.parquet", 8 << 30).select("name")


@query("A17_sidecar_tables", "SELECT 'raw' AS kind, lang, source AS label, count(*) AS n FROM documents GROUP BY ALL UNION ALL SELECT 'clean', lang, upper(source), count(*) FROM documents GROUP BY ALL UNION ALL SELECT 'mapping', lang, concat(source, '>', upper(source)), count(*) FROM documents GROUP BY ALL")
def a17(t):
    """Counts of raw and clean labels and the mapping between them, each written by group."""
    path = fs.scratch(t.spark, "sidecars")
    fs.write_sidecars(t.documents.select("lang", "source", F.upper("source").alias("clean")), path, "lang", "source", "clean")
    label = {"raw_counts": F.col("source"), "clean_counts": F.col("clean"), "mapping": F.concat("source", F.lit(">"), "clean")}
    parts = [t.spark.read.parquet(f"{path}/{table}").select(F.lit(table.removesuffix("_counts")).alias("kind"), "lang", c.alias("label"), "n") for table, c in label.items()]
    return parts[0].union(parts[1]).union(parts[2])


@query(
    "A21_manifest",
    "WITH s AS (SELECT o_custkey, max(CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 1 ELSE 0 END) AS p FROM orders GROUP BY o_custkey) "
    "SELECT c_custkey, CASE p WHEN 2 THEN 'done' WHEN 1 THEN 'skipped' WHEN 0 THEN 'failed' END AS status FROM customer LEFT JOIN s ON c_custkey = o_custkey",
)
def a21(t):
    """A manifest read from its file: the best status of each key, joined to the inputs."""
    path = fs.scratch(t.spark, "manifest")
    s = F.col("o_orderstatus")
    fs.write_csv(t.orders.select("o_custkey", "o_orderkey", F.when(s == "F", "done").when(s == "O", "skipped").otherwise("failed").alias("status")), path)
    best = mf.best_status(fs.read_csv(t.spark, path, "o_custkey long, o_orderkey long, status string"), "o_custkey", order="o_orderkey")
    return t.customer.select("c_custkey").join(best.select(F.col("o_custkey").alias("c_custkey"), "status"), "c_custkey", "left")


@query(
    "A24_report",
    "SELECT * FROM (VALUES (0, '# Regions'), (1, ''), (2, '## nations by region'), (3, ''), (4, '| n_regionkey | n |'), (5, '| --- | --- |')) v(ord, line) "
    "UNION ALL SELECT 6 + n_regionkey, concat('| ', n_regionkey, ' | ', count(*), ' |') FROM nation GROUP BY n_regionkey",
)
def a24(t):
    """A report as its lines, by way of the file."""
    path = fs.scratch(t.spark, "report")
    fs.write_report(path, "Regions", nations_by_region=t.nation.groupBy("n_regionkey").agg(F.count("*").alias("n")).orderBy("n_regionkey"))
    return t.spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.rtrim("value", F.lit("\n")), "\n")).alias("ord", "line"))


@query("I_each_file_once", "SELECT n_nationkey, n_name FROM nation")
def each_file_once(t):
    """Two passes over a folder that gains a file in between; no file is taken twice."""
    inbox, out, marks = (fs.scratch(t.spark, name) for name in ("inbox", "taken", "marks"))
    rows = t.nation.select("n_nationkey", "n_name")
    for part in ("n_nationkey < 10", "n_nationkey >= 10"):
        fs.write_json_lines(rows.where(part), inbox, append=True)
        incremental.ingest(t.spark, inbox, "n_nationkey int, n_name string", out, marks)
    return t.spark.read.parquet(out)


@query("A15_settings", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey >= 5 AND n_nationkey < 20")
def a15(t):
    """Bounds and a table's place from a YAML file: its relative path is taken from the folder of the tables."""
    path = fs.scratch(t.spark, "settings")
    fs.write_text(t.spark, "table: nation.parquet\nbounds:\n  least: 5\n  below: 20\n", path)
    settings = with_paths(read_config(t.spark, path), t.folder, "table")
    bounds = settings["bounds"]
    return fs.read_table(t.spark, settings["table"], ["n_nationkey", "n_name"], f"n_nationkey >= {bounds['least']} and n_nationkey < {bounds['below']}")


@query("A20_status_stream", "WITH r AS (SELECT o_custkey, CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'skipped' ELSE 'failed' END AS status, o_orderkey FROM orders), p AS (SELECT *, CASE status WHEN 'ok' THEN 5 WHEN 'skipped' THEN 3 ELSE 1 END AS p FROM r), n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY p DESC, o_orderkey DESC) AS n FROM p) SELECT o_custkey, status, o_orderkey FROM n WHERE n = 1")
def a20_stream(t):
    """Status rows of orders in three batches of files: of each customer the best, the last of equals, kept in state."""
    path = fs.scratch(t.spark, "states")
    status_ = F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "O", "skipped").otherwise("failed")
    rows = t.orders.select("o_custkey", status_.alias("status"), "o_orderkey", F.lit("2024-01-01 00:00:00").alias("at"))
    for k in range(3):  # each call goes on where the last one was
        rows.where(F.col("o_orderkey") % 3 == k).write.mode("append").json(f"{path}/in")
        status.follow(t.spark, f"{path}/in", "o_custkey long, status string, o_orderkey long, at timestamp", f"{path}/log", f"{path}/checkpoint", "o_custkey", "o_orderkey", "at")
    log = t.spark.read.schema("o_custkey long, status string, o_orderkey long, at timestamp").parquet(f"{path}/log")
    return status.current(log, "o_custkey", "o_orderkey").select("o_custkey", "status", "o_orderkey")
