"""Readers and writers with declared schemas, strict or tolerant; nothing infers a schema."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def _schema(spark: SparkSession, ddl: str) -> StructType:
    return spark.createDataFrame([], ddl).schema


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; only a local session may do without it.

    A local session without that setting gets a temporary folder, one for the application; on a cluster executors
    couldn't see it, so there the setting is required.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _temporary(spark.sparkContext.applicationId)


@cache
def _temporary(application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="labelloom-")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, below one folder for each application.

    That folder goes when the driver ends.
    """
    own = f"{shared_dir(spark)}/labelloom-{spark.sparkContext.applicationId}"
    where = spark._jvm.org.apache.hadoop.fs.Path(own)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(where):
        store.mkdirs(where)
        store.deleteOnExit(where)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, *paths: str) -> None:
    """Deletes tables that scratch named, once nothing needs to be computed from them any more."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None, where: str | None = None) -> DataFrame:
    """Parquet, with the columns and rows asked for; both reach the scan."""
    df = spark.read.parquet(path)
    df = df.where(where) if where else df
    return df.select(*columns) if columns else df


def read_csv(spark: SparkSession, path: str, ddl: str, key: str | None = None, where: str | None = None) -> DataFrame:
    """CSV with a header; with key one row for each of its values, rows without it left out."""
    df = spark.read.schema(ddl).option("header", True).option("enforceSchema", False).csv(path)
    df = df.where(where) if where else df
    return df.where(F.col(key).isNotNull()).dropDuplicates([key]) if key else df


def read_tsv_text(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """TSV with a header, all columns text, missing values empty, and the row's place in the file as ord.

    ord counts lines from the file's beginning, so a file is read whole by one task: these are hand-kept alias tables.
    Of several files those with smaller names come first. Columns are found by the header's names, whatever their order.
    """
    files_ = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("_file"), F.split("value", "\r?\n").alias("lines"))
    rows = files_.select("_file", F.split(F.element_at("lines", 1), "\t").alias("names"), F.posexplode("lines").alias("_at", "line")).where("_at > 0 and trim(line) <> ''")
    cells = F.split("line", "\t")
    found = [F.coalesce(F.try_element_at(cells, F.nullif(F.array_position("names", F.lit(c)), F.lit(0)).cast("int")), F.lit("")).alias(c) for c in columns]
    return rows.select(*found, F.struct("_file", "_at").alias("ord"))


def read_json_lines(spark: SparkSession, path: str, ddl: str, strict: bool = False) -> DataFrame:
    """JSON lines. strict: a malformed line fails the read; else such lines are left out (see malformed_lines)."""
    if strict:
        return spark.read.schema(ddl).option("mode", "FAILFAST").json(path)
    lines = _parsed_lines(spark, path, ddl).where("p._corrupt is null")
    return lines.select("p.*").drop("_corrupt")


def _parsed_lines(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    schema = _schema(spark, ddl).add("_corrupt", StringType())
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.withColumn("p", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))


def malformed_lines(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """The lines that read_json_lines leaves out, as text."""
    return _parsed_lines(spark, path, ddl).where("p._corrupt is not null").select("value")


def accepted_records(df: DataFrame, array: str, label: str) -> DataFrame:
    """Rows with a non-empty array and a label."""
    return df.where((F.size(array) > 0) & F.col(label).isNotNull())


def read_json_document(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    return spark.read.schema(ddl).option("multiLine", True).json(path)


def read_map_document(spark: SparkSession, path: str) -> DataFrame:
    """key, value and ord of a file with one JSON object; names that begin with _ are comments."""
    doc = spark.read.text(path, wholetext=True)
    pairs = doc.select(F.posexplode(F.map_entries(F.from_json("value", "map<string,string>"))).alias("ord", "e"))
    return pairs.select("e.key", "e.value", "ord").where(~F.col("key").startswith("_"))


def write_map_document(pairs: DataFrame, path: str, most: int = 1_000_000) -> None:
    """key and value as one JSON object in one file, in order of key: a table of at most `most` rows, which are counted first."""
    if pairs.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows for one JSON object")
    doc = pairs.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value"))))).alias("value"))
    doc.coalesce(1).write.mode("overwrite").text(path)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """text as the one file of a folder, in any store that Spark writes to."""
    spark.createDataFrame([(text.removesuffix("\n"),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def files(spark: SparkSession, path: str, glob: str = "*", most_bytes: int | None = None) -> DataFrame:
    """path, name and size of the files in a folder, those above most_bytes left out; contents aren't read."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"))
    return (df.where(F.col("size") <= most_bytes) if most_bytes else df).orderBy("name")


def flat(df: DataFrame) -> DataFrame:
    """Structs as columns struct_field, and arrays joined by |, as CSV needs."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, StructType):
            out += [F.col(f"{f.name}.{g.name}").alias(f"{f.name}_{g.name}") for g in f.dataType.fields]
        elif f.dataType.typeName() == "array":
            out.append(F.array_join(F.col(f.name).cast("array<string>"), "|").alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    rows = flat(df)
    (rows.coalesce(1) if one_file else rows).write.mode("overwrite").option("header", True).csv(path)


def write_json_lines(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", False).json(path)


def write_partitions(df: DataFrame, path: str, *keys: str) -> None:
    """Parquet by keys; only the partitions that df holds are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def write_sidecars(df: DataFrame, path: str, group: str, label: str, clean: str) -> None:
    """Label counts before and after cleaning, the mapping between them, and a profile, each a table by group."""
    from labelloom.operators.cleaning import profile

    write_partitions(df.groupBy(group, label).agg(F.count("*").alias("n")), f"{path}/raw_counts", group)
    write_partitions(df.groupBy(group, clean).agg(F.count("*").alias("n")), f"{path}/clean_counts", group)
    write_partitions(df.groupBy(group, label, clean).agg(F.count("*").alias("n")), f"{path}/mapping", group)
    if {"tissue", "disease"} <= set(df.columns):
        write_partitions(profile(df, group, clean, "tissue", "disease"), f"{path}/profile", group)


def report_lines(title: str, **tables: DataFrame) -> DataFrame:
    """Markdown of tables as rows (ord, value), every row of them: a part's lines are made where its rows are.

    ord: number of the table, then its partition and place, so `orderBy("ord")` keeps the order of a sorted table.
    """
    spark = next(iter(tables.values())).sparkSession
    out = spark.createDataFrame([(0, 0, 0, f"# {title}")], "t int, k int, at long, value string")
    for t, (name, df) in enumerate(tables.items(), 1):
        head = ["", f"## {name.replace('_', ' ')}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
        cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]
        lines = df.select(F.lit(t).alias("t"), F.lit(1).alias("k"), F.monotonically_increasing_id().alias("at"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))
        out = out.unionByName(spark.createDataFrame([(t, 0, k, x) for k, x in enumerate(head)], out.schema)).unionByName(lines)
    return out.select(F.struct("t", "k", "at").alias("ord"), "value")


def write_report(path: str, title: str, **tables: DataFrame) -> None:
    """The report as the one text file of a folder: a task of its own streams the sorted lines, none pass the driver."""
    report_lines(title, **tables).orderBy("ord").select("value").coalesce(1).write.mode("overwrite").text(path)
