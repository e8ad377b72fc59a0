import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.sources.arrays import read_arrays, write_arrays


@pytest.mark.parametrize("kind, rows_per_file, rows_per_task", [("float", 7, 3), ("double", 1000, 10), ("long", 50, 1000)])
def test_round_trip_in_ranges(spark, tmp_path, kind, rows_per_file, rows_per_task):
    rows = spark.range(103).select("id", F.array("id", F.col("id") * 2, -F.col("id")).cast(f"array<{kind}>").alias("vec"), F.lit(1).alias("other")).orderBy(F.desc("id"))
    write_arrays(rows, f"{tmp_path}/a", rowsPerFile=rows_per_file)
    got = read_arrays(spark, f"{tmp_path}/a", rowsPerTask=rows_per_task)
    assert got.schema["vec"].dataType.elementType.simpleString() == {"long": "bigint"}.get(kind, kind)
    assert sorted((r.id, *r.vec) for r in got.collect()) == [(i, i, 2 * i, -i) for i in range(103)]
    (tmp_path / "a/part-of-a-lost-task.npy").write_bytes(b"?")
    assert got.count() == 103


def test_files_from_elsewhere(spark, tmp_path):
    matrix = np.arange(10.0).reshape(5, 2)
    np.save(f"{tmp_path}/m.npy", matrix)
    assert sorted((r.id, r.vec) for r in read_arrays(spark, f"{tmp_path}/m.npy", rowsPerTask=2).collect()) == [(i, list(r)) for i, r in enumerate(matrix)]
    np.save(f"{tmp_path}/empty.npy", matrix[:0])
    assert read_arrays(spark, f"{tmp_path}/empty.npy").count() == 0
    np.save(f"{tmp_path}/f.npy", np.asfortranarray(matrix))
    with pytest.raises(Exception, match="isn't a matrix"):
        read_arrays(spark, f"{tmp_path}/f.npy").count()


@pytest.mark.parametrize("ids, vecs", [([0, 2], [[1.0], [1.0]]), ([0, 0], [[1.0], [1.0]]), ([1], [[1.0]]), ([0, 1], [[1.0], [1.0, 2.0]]), ([0], [[None]]), ([0], [None])])
def test_what_isnt_a_matrix_raises(spark, tmp_path, ids, vecs):
    rows = spark.createDataFrame(list(zip(ids, vecs)), "id long, vec array<double>")
    with pytest.raises(Exception):
        write_arrays(rows, f"{tmp_path}/a")
    assert not (tmp_path / "a/manifest.json").exists()


def test_empty_table(spark, tmp_path):
    write_arrays(spark.createDataFrame([], "id long, vec array<double>"), f"{tmp_path}/a")
    assert read_arrays(spark, f"{tmp_path}/a").count() == 0
