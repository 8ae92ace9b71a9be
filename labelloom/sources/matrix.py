"""Cells by genes as compressed rows in blocks: a Spark data source, read in parallel with pushed filters and written with a commit.

A matrix is a folder. A block is an Arrow file of some thousand cells: cell, columns about the cell, and the stored
genes (numbers, ascending) and values as lists, whose offsets are the row starts. _matrix.json names the genes and
the blocks that count, with the least and largest value of each column in it; it is written last and replaced as a whole,
so a matrix is as it was until a write has succeeded. Folders are named as pyarrow's file systems do (a path, file://,
s3://, hdfs://; s3a:// is s3://), so any executor can read its blocks.

Options: layout ("long": a row a stored value, with the gene's name; "rows": a row a cell, with arrays genes and values),
block_rows (cells of a block written), genes (names as a JSON list, when written).

A cell without stored values is a row of empty arrays, and no row of the long layout. Null values aren't stored; columns about
cells may be null.
"""

from __future__ import annotations

import json
import operator
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from labelloom.operators.sides import sent

MANIFEST, AT_ONCE = "_matrix.json", 1 << 18
COMPARED = {ds.EqualTo: operator.eq, ds.GreaterThan: operator.gt, ds.GreaterThanOrEqual: operator.ge, ds.LessThan: operator.lt, ds.LessThanOrEqual: operator.le}
IN_ARROW = {ds.EqualTo: pc.equal, ds.GreaterThan: pc.greater, ds.GreaterThanOrEqual: pc.greater_equal, ds.LessThan: pc.less, ds.LessThanOrEqual: pc.less_equal}


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1).rstrip("/"))


def manifest(path: str) -> dict:
    """The matrix's genes, columns and blocks; empty if there is none yet."""
    store, at = _place(path)
    if store.get_file_info(f"{at}/{MANIFEST}").type == fs.FileType.NotFound:
        return {"genes": [], "columns": [], "blocks": []}
    with store.open_input_stream(f"{at}/{MANIFEST}") as f:
        return json.loads(f.read())


@dataclass
class Block(ds.InputPartition):
    file: str
    filters: list = field(default_factory=list)

    def __post_init__(self) -> None:
        self.value = None


@dataclass
class Written(ds.WriterCommitMessage):
    blocks: list[dict]


def may_hold(block: dict, f: ds.Filter) -> bool:
    """Whether a block with these least and largest values can hold a row that f lets through."""
    name = f.attribute[0]
    low, high = block["low"].get(name), block["high"].get(name)
    if low is None:  # nulls alone
        return isinstance(f, ds.IsNull)
    if isinstance(f, ds.EqualTo):
        return low <= f.value <= high
    if isinstance(f, ds.In):
        return any(v is not None and low <= v <= high for v in f.value)
    if isinstance(f, (ds.GreaterThan, ds.GreaterThanOrEqual)):
        return COMPARED[type(f)](high, f.value)
    if isinstance(f, (ds.LessThan, ds.LessThanOrEqual)):
        return COMPARED[type(f)](low, f.value)
    return True


def passes(table: pa.Table, f: ds.Filter) -> pa.ChunkedArray:
    """Which rows f lets through."""
    column = table[f.attribute[0]]
    if isinstance(f, ds.IsNotNull):
        return column.is_valid()
    if isinstance(f, ds.IsNull):
        return column.is_null()
    if isinstance(f, ds.In):
        return pc.is_in(column, pa.array([v for v in f.value if v is not None], column.type))
    return pc.fill_null(IN_ARROW[type(f)](column, pa.scalar(f.value, column.type)), False)


class MatrixReader(ds.DataSourceReader):
    def __init__(self, path: str, schema: StructType, long: bool) -> None:
        self.path, self.out, self.long, self.filters = path, to_arrow_schema(schema), long, []
        self.known = manifest(path)

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:  # noqa: N802
        """Comparisons of a cell's columns with values are applied here, to blocks by their extremes and then to rows."""
        own = {"cell", *(name for name, _ in self.known["columns"])}
        for f in filters:
            kinds = (*COMPARED, ds.In, ds.IsNull, ds.IsNotNull)
            if isinstance(f, kinds) and len(f.attribute) == 1 and f.attribute[0] in own and not (isinstance(f, tuple(COMPARED)) and f.value is None):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Block]:
        return [Block(b["file"], self.filters) for b in self.known["blocks"] if all(may_hold(b, f) for f in self.filters)]

    def read(self, partition: Block | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark asks so if there are no partitions
            return
        store, at = _place(self.path)
        with store.open_input_file(f"{at}/{partition.file}") as f:
            table = pa.ipc.open_file(f).read_all()
        for x in partition.filters:
            table = table.filter(passes(table, x))
        table = table.combine_chunks()
        if not self.long:
            yield from table.select(self.out.names).cast(self.out).to_batches()
            return
        names = pa.array(self.known["genes"], pa.string())
        starts = np.r_[0, np.cumsum(pc.list_value_length(table["genes"]).to_numpy())]
        step = max(1, AT_ONCE * len(table) // max(1, int(starts[-1])))
        for first in range(0, len(table), step):
            part = table.slice(first, step)
            of = pa.array(np.repeat(np.arange(len(part)), np.diff(starts[first : first + len(part) + 1])))
            columns = [part[c].take(of).combine_chunks() for c in self.out.names[:-2]]
            genes = names.take(pc.list_flatten(part["genes"]).combine_chunks())
            columns += [genes, pc.list_flatten(part["values"]).combine_chunks()]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, self.out, strict=True)], schema=self.out)


class MatrixWriter(ds.DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, genes: list[str], rows: int, overwrite: bool) -> None:
        self.path, self.genes, self.rows, self.overwrite, self.own = path, genes, rows, overwrite, uuid.uuid4().hex
        self.columns = [[f.name, f.dataType.simpleString()] for f in schema.fields if f.name not in ("cell", "genes", "values")]
        if {"cell", "genes", "values"} - set(schema.names):
            raise ValueError("a matrix needs the columns cell, genes and values")

    def _block(self, table: pa.Table) -> dict:
        store, at = _place(self.path)
        store.create_dir(at, recursive=True)
        name = f"block-{self.own}-{uuid.uuid4().hex}.arrow"
        table = table.combine_chunks()
        with store.open_output_stream(f"{at}/{name}") as f, pa.ipc.new_file(f, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(table)
        ends = {c: pc.min_max(table[c]).as_py() for c in ("cell", *(name for name, _ in self.columns))}
        return {"file": name, "rows": len(table), "stored": int(pc.sum(pc.list_value_length(table["genes"])).as_py() or 0), "low": {c: v["min"] for c, v in ends.items()}, "high": {c: v["max"] for c, v in ends.items()}}

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        done, held, n = [], [], 0
        try:
            for batch in iterator:
                held.append(batch)
                n += batch.num_rows
                while n >= self.rows:
                    table = pa.Table.from_batches(held)
                    done.append(self._block(table.slice(0, self.rows)))
                    held, n = table.slice(self.rows).to_batches(), n - self.rows
            if n:
                done.append(self._block(pa.Table.from_batches(held)))
        except BaseException:
            self._drop(done)  # what this attempt has written counts nowhere
            raise
        return Written(done)

    def _drop(self, blocks: list[dict]) -> None:
        store, at = _place(self.path)
        for b in blocks:
            if store.get_file_info(f"{at}/{b['file']}").type != fs.FileType.NotFound:
                store.delete_file(f"{at}/{b['file']}")

    def commit(self, messages: list[Written | None]) -> None:
        before = manifest(self.path)
        new = [b for m in messages if m for b in m.blocks]
        if before["blocks"] and not self.overwrite and (before["genes"], before["columns"]) != (self.genes, self.columns):
            self._drop(new)
            raise ValueError("rows can only be appended to a matrix of the same genes and columns")
        blocks = sorted(new + ([] if self.overwrite else before["blocks"]), key=lambda b: (b["low"]["cell"] is not None, b["low"]["cell"] or 0, b["file"]))
        store, at = _place(self.path)
        store.create_dir(at, recursive=True)
        with store.open_output_stream(f"{at}/{MANIFEST}.new") as f:
            f.write(json.dumps({"genes": self.genes, "columns": self.columns, "blocks": blocks}).encode())
        store.move(f"{at}/{MANIFEST}.new", f"{at}/{MANIFEST}")
        if self.overwrite:
            self._clear({b["file"] for b in blocks})

    def _clear(self, keep: set[str], of: str = "block-") -> None:
        store, at = _place(self.path)
        for f in store.get_file_info(fs.FileSelector(at, allow_not_found=True)):
            if f.base_name.startswith(of) and f.base_name not in keep:
                store.delete_file(f.path)

    def abort(self, messages: list[Written | None]) -> None:
        """Deletes all blocks of this write, those of tasks whose messages never came too. Blocks that a task goes on to
        write until it is killed count nowhere, and go with the next overwrite."""
        self._clear(set(), f"block-{self.own}-")


class CellMatrix(ds.DataSource):
    """spark.read.format("cellmatrix").load(folder), df.write.format("cellmatrix").save(folder) once it is registered."""

    @classmethod
    def name(cls) -> str:
        return "cellmatrix"

    def _long(self) -> bool:
        layout = self.options.get("layout", "long")
        if layout not in ("long", "rows"):
            raise ValueError(f"no such layout: {layout}")
        return layout == "long"

    def schema(self) -> StructType:
        own = "".join(f", `{name}` {kind}" for name, kind in manifest(self.options["path"])["columns"])
        return "cell bigint" + own + (", gene string, value double" if self._long() else ", genes array<int>, `values` array<double>")

    def reader(self, schema: StructType) -> MatrixReader:
        return MatrixReader(self.options["path"], schema, self._long())

    def writer(self, schema: StructType, overwrite: bool) -> MatrixWriter:
        return MatrixWriter(self.options["path"], schema, json.loads(self.options.get("genes", "[]")), int(self.options.get("block_rows", 4_096)), overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CellMatrix)


def read_matrix(spark: SparkSession, path: str, layout: str = "long") -> DataFrame:
    register(spark)
    return spark.read.format("cellmatrix").option("layout", layout).load(path)


def write_matrix(cells: DataFrame, counts: DataFrame, path: str, columns: tuple[str, ...] = (), mode: str = "errorifexists", block_rows: int = 4_096, most_genes: int = 1_000_000) -> None:
    """cells (cell and columns about it, one row each) and counts (cell, gene, value; one row at most for each cell and
    gene, nulls and zeros aren't stored) as a matrix, blocks in order of cell. Names of genes, most_genes at most, lie in its manifest."""
    spark = cells.sparkSession
    if mode == "errorifexists" and manifest(path)["blocks"]:
        raise ValueError(f"there is a matrix in {path}")
    names = [r["gene"] for r in counts.select(F.col("gene").cast("string").alias("gene")).where("gene is not null").distinct().orderBy("gene").limit(most_genes + 1).collect()]
    if len(names) > most_genes:
        raise ValueError(f"more than {most_genes} genes")
    if mode == "append" and manifest(path)["blocks"]:
        names = known if not set(names) - set(known := manifest(path)["genes"]) else names
    kinds = StructType([StructField("_gene", StringType()), StructField("_k", IntegerType())])
    places = sent(spark.createDataFrame([(g, k) for k, g in enumerate(names)], kinds), most_genes)
    stored = counts.where("value <> 0").join(places, F.col("gene").cast("string") == F.col("_gene"))
    rows = stored.groupBy(F.col("cell").alias("_cell")).agg(F.sort_array(F.collect_list(F.struct(F.col("_k").alias("k"), F.col("value").cast("double").alias("v")))).alias("_row"))
    met = cells.select("cell", *columns).join(rows, F.col("cell") == F.col("_cell"), "left")
    none = F.array().cast(ArrayType(IntegerType())), F.array().cast(ArrayType(DoubleType()))
    out = met.select(F.col("cell").cast("long").alias("cell"), *columns, F.coalesce(F.transform("_row", lambda x: x["k"]), none[0]).alias("genes"), F.coalesce(F.transform("_row", lambda x: x["v"]), none[1]).alias("values"))
    register(spark)
    writer = out.repartitionByRange("cell").sortWithinPartitions("cell").write.format("cellmatrix").mode("append" if mode != "overwrite" else mode)
    writer.option("genes", json.dumps(names)).option("block_rows", block_rows).save(path)
