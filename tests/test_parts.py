import gzip
import json

import pytest
from pyspark.sql import types as T

from glyphmill.sources.parts import accepted, read_parts, rejected, retried, stream_parts

COLUMNS = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType())])


def lines(*rows):
    return "".join(json.dumps({"id": i, "text": t, "other": 1}) + "\n" for i, t in rows).encode()


def test_tries_again_with_longer_waits():
    waits, answers = [], [OSError("a"), OSError("b"), b"ok"]

    def read():
        x = answers.pop(0)
        if isinstance(x, Exception):
            raise x
        return x

    assert retried(read, 3, 0.5, waits.append) == b"ok" and waits == [0.5, 1.0]
    answers[:] = [OSError("a"), OSError("b")]
    with pytest.raises(OSError, match="b"):
        retried(read, 2, 0.5, waits.append)


def test_bad_parts_are_reported_and_good_ones_whole(spark, tmp_path):
    good = gzip.compress(lines((3, "c"), (4, None)))
    files = {"a.jsonl": lines((1, "é\n"), (2, "")), "b.jsonl.gz": good, "c.jsonl.gz": good[:-9], "d.jsonl": b'{"id": 5}\n{"id": ', "e.jsonl": b'{"id": "x"}\n', "f.jsonl": b"", "_g.jsonl": b"?", "h.txt": b"?"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "deep/_not").mkdir(parents=True)
    (tmp_path / "deep/a.jsonl").write_bytes(lines((9, "deep")))
    (tmp_path / "deep/_not/a.jsonl").write_bytes(b"?")
    for size in (1, 16):
        rows = read_parts(spark, str(tmp_path), COLUMNS, partsPerTask=size)
        assert sorted((r.id, r.text, r._part) for r in accepted(rows).collect()) == [(1, "é\n", "a.jsonl"), (2, "", "a.jsonl"), (3, "c", "b.jsonl.gz"), (4, None, "b.jsonl.gz"), (9, "deep", "deep/a.jsonl")]
        assert sorted(r.part for r in rejected(rows).collect()) == ["c.jsonl.gz", "d.jsonl", "e.jsonl"]
    assert read_parts(spark, f"{tmp_path}/none", COLUMNS).count() == 0


def test_stream_resumes_after_the_last_part(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, data in enumerate((lines((1, "a")), b"{", lines((2, "b"), (3, "c")))):
        (tmp_path / f"in/{i}.jsonl").write_bytes(data)
        query = stream_parts(spark, f"{tmp_path}/in", COLUMNS).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out")
        query.awaitTermination()
    rows = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(r.id for r in accepted(rows).collect()) == [1, 2, 3] and [r.part for r in rejected(rows).collect()] == ["1.jsonl"]
