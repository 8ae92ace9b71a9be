"""The cell matrix source: round trips, pruned partitions, pushed filters, commit and abort."""

import os
import random

import pytest
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from labelloom.sources import matrix


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rng = random.Random(2)
    cells = [(k, rng.choice(["b cell", "t cell", None]), f"donor {k // 100}") for k in range(500)]
    counts = [(k, f"g{g}", float(rng.randint(1, 9))) for k in range(500) if k % 50 for g in rng.sample(range(40), 5)] + [(3, "gone", 0.0), (4, "g0", None)]
    path = str(tmp_path_factory.mktemp("matrix") / "m")
    frames = spark.createDataFrame(cells, "cell long, label string, donor string").repartition(3), spark.createDataFrame(counts, "cell long, gene string, value double").repartition(5)
    matrix.write_matrix(*frames, path, ("label", "donor"), block_rows=64)
    return path, cells, [c for c in counts if c[2]]


def test_round_trip(spark, made):
    path, cells, counts = made
    about = {k: (label, donor) for k, label, donor in cells}
    got = matrix.read_matrix(spark, f"file://{path}")
    assert got.columns == ["cell", "label", "donor", "gene", "value"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((k, *about[k], g, v) for k, g, v in counts), key=str)
    rows = matrix.read_matrix(spark, path, "rows").collect()
    assert len(rows) == 500 and sum(not r["genes"] for r in rows) == 10 and all(r["genes"] == sorted(r["genes"]) for r in rows)
    known = matrix.manifest(path)
    assert "gone" in known["genes"] and sum(b["stored"] for b in known["blocks"]) == len(counts) and all(b["rows"] <= 64 for b in known["blocks"])


@pytest.mark.parametrize(("where", "kept"), [
    ("cell = 250", lambda k, label, donor: k == 250), ("cell >= 100 and cell < 130", lambda k, label, donor: 100 <= k < 130),
    ("donor = 'donor 4'", lambda k, label, donor: donor == "donor 4"), ("donor in ('donor 0', 'x', null)", lambda k, label, donor: donor == "donor 0"),
    ("label is null and cell <= 99", lambda k, label, donor: label is None and k <= 99), ("label = 'b cell' and value > 4", None), ("cell > 1000", lambda k, label, donor: False),
])
def test_filters(spark, made, where, kept):
    path, cells, counts = made
    got = matrix.read_matrix(spark, path).where(where)
    about = {k: (label, donor) for k, label, donor in cells}
    kept = kept or (lambda k, label, donor: label == "b cell")
    want = sorted((k, g, v) for k, g, v in counts if kept(k, *about[k]) and ("value" not in where or v > 4))
    assert sorted((r["cell"], r["gene"], r["value"]) for r in got.collect()) == want
    if "donor" in where or "cell" in where.replace("b cell", ""):
        assert got.rdd.getNumPartitions() < len(matrix.manifest(path)["blocks"])


def test_pruning_of_partitions(made):
    path = made[0]
    reader = matrix.MatrixReader(path, StructType(), True)
    everything = len(reader.partitions())
    left = list(reader.pushFilters([ds.EqualTo(("cell",), 250), ds.EqualTo(("gene",), "g1"), ds.Not(ds.EqualTo(("cell",), 1))]))
    assert [type(f) for f in left] == [ds.EqualTo, ds.Not] and len(reader.partitions()) == 1 < everything


def test_append_and_overwrite(spark, tmp_path):
    path = str(tmp_path / "m")
    cells = lambda *ids: spark.createDataFrame([(k,) for k in ids], "cell long")
    counts = lambda *rows: spark.createDataFrame(list(rows), "cell long, gene string, value double")
    matrix.write_matrix(cells(1, 2), counts((1, "a", 1.0), (2, "b", 2.0)), path)
    with pytest.raises(ValueError):
        matrix.write_matrix(cells(3), counts((3, "a", 1.0)), path)
    matrix.write_matrix(cells(3), counts((3, "a", 5.0)), path, mode="append")
    assert sorted(map(tuple, matrix.read_matrix(spark, path).collect())) == [(1, "a", 1.0), (2, "b", 2.0), (3, "a", 5.0)]
    with pytest.raises(Exception, match="same genes"):
        matrix.write_matrix(cells(4), counts((4, "new", 1.0)), path, mode="append")
    assert matrix.read_matrix(spark, path).count() == 3
    matrix.write_matrix(cells(9), counts((9, "z", 1.0)), path, mode="overwrite")
    assert [tuple(r) for r in matrix.read_matrix(spark, path).collect()] == [(9, "z", 1.0)]
    assert len([f for f in os.listdir(path) if f.endswith(".arrow")]) == len(matrix.manifest(path)["blocks"])


def test_a_failed_write_leaves_the_matrix_as_it_was(spark, tmp_path):
    path = str(tmp_path / "m")
    one = spark.createDataFrame([(1,)], "cell long")
    matrix.write_matrix(one, one.select("cell", F.lit("a").alias("gene"), F.lit(1.0).alias("value")), path)
    before = matrix.manifest(path)
    bad = spark.range(400, numPartitions=4).select(F.col("id").alias("cell"), F.array(F.lit(0)).alias("genes"), F.array(F.when(F.col("id") == 399, F.raise_error(F.lit("broken")).cast("double")).otherwise(1.0)).alias("values"))
    with pytest.raises(Exception, match="broken"):
        bad.write.format("cellmatrix").mode("overwrite").option("genes", '["a"]').option("block_rows", 10).save(path)
    assert matrix.manifest(path) == before and matrix.read_matrix(spark, path).count() == 1
    writer = matrix.MatrixWriter(path, bad.schema, ["a"], 10, True)
    done = writer.write(iter(bad.where("cell < 25").toArrow().to_batches()))
    assert len(done.blocks) >= 3 and all(os.path.exists(f"{path}/{b['file']}") for b in done.blocks)
    writer.abort([None])
    assert not any(os.path.exists(f"{path}/{b['file']}") for b in done.blocks) and matrix.manifest(path) == before
    matrix.write_matrix(one, one.select("cell", F.lit("a").alias("gene"), F.lit(2.0).alias("value")), path, mode="overwrite")
    assert {f for f in os.listdir(path) if f.endswith(".arrow")} == {b["file"] for b in matrix.manifest(path)["blocks"]}


def test_no_cells(spark, tmp_path):
    none = spark.createDataFrame([], "cell long, gene string, value double")
    matrix.write_matrix(none.select("cell"), none, str(tmp_path / "m"))
    assert matrix.read_matrix(spark, str(tmp_path / "m")).count() == 0
