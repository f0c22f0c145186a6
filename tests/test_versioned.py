"""Versions of a stored table: what a failed or killed writer leaves unchanged, and which buckets are written."""

import os
import signal
import subprocess
import sys
import textwrap
import time

import pytest
from pyspark.sql import functions as F

from tremolo.operators import retrieval, search
from tremolo.sources import versioned


def table(spark, rows):
    return spark.createDataFrame(rows, "chunk_id string, text string")


def got(spark, path):
    return sorted(map(tuple, versioned.read(spark, path).collect()))


def folders(path):
    return {f for f in os.listdir(path) if f.startswith("v")}


def test_only_changed_buckets_are_written(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(f"k{i}", "one") for i in range(200)]
    first = versioned.write(table(spark, rows), "chunk_id", path, buckets=16)
    assert got(spark, path) == sorted(rows) and first.number == 1 and len(first.folders) == 16
    where = {r.chunk_id: r.b for r in table(spark, rows).select("chunk_id", versioned.bucket(F.col("chunk_id"), 16).alias("b")).collect()}
    hit = where["k7"]
    new = [(k, "two" if k == "k7" else t) for k, t in rows]
    second = versioned.write(table(spark, new), "chunk_id", path, {hit}, buckets=16)
    assert got(spark, path) == sorted(new)
    assert {k for k in second.folders if second.folders[k] != first.folders[k]} == {hit}
    assert sorted(r.chunk_id for r in versioned.read(spark, path, {hit}).collect()) == sorted(k for k, b in where.items() if b == hit)
    gone = [r for r in new if where[r[0]] != hit]
    third = versioned.write(table(spark, gone), "chunk_id", path, {hit}, buckets=16)
    assert got(spark, path) == sorted(gone) and hit not in third.folders
    assert versioned.write(table(spark, []), "chunk_id", path, buckets=16).folders == {} and got(spark, path) == []
    with pytest.raises(FileNotFoundError):
        versioned.read(spark, str(tmp_path / "none"))


def test_failed_writers_leave_the_old_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    rows = [(f"k{i}", "one") for i in range(50)]
    versioned.write(table(spark, rows), "chunk_id", path)
    bad = table(spark, [(k, "two") for k, _ in rows]).withColumn("text", F.when(F.col("chunk_id") == "k33", F.raise_error(F.lit("broken"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="broken"):
        versioned.write(bad, "chunk_id", path)
    assert got(spark, path) == sorted(rows)

    def lost(*_):
        raise OSError("lost before the switch")

    with monkeypatch.context() as m:
        m.setattr(versioned, "_switch", lost)
        with pytest.raises(OSError):
            versioned.write(table(spark, [("a", "b")]), "chunk_id", path)
    assert got(spark, path) == sorted(rows) 
    assert len(folders(path)) > 1 and versioned.clean(spark, path)
    assert len(folders(path)) == 1 and got(spark, path) == sorted(rows)
    stale = versioned.current(spark, path)
    switch = versioned._switch
    real = versioned.current
    versioned.write(table(spark, rows[:9]), "chunk_id", path)
    with monkeypatch.context() as m:  # a writer that began before the last one ended
        answers = iter([stale])
        m.setattr(versioned, "current", lambda *a: next(answers, None) or real(*a))
        with pytest.raises(RuntimeError, match="meanwhile"):
            versioned.write(table(spark, rows[:5]), "chunk_id", path)
    assert switch is versioned._switch and got(spark, path) == sorted(rows[:9])


def test_readers_of_the_version_before_go_on(spark, tmp_path):
    path = str(tmp_path / "t")
    versioned.write(table(spark, [("a", "1")]), "chunk_id", path)
    reader = versioned.read(spark, path)
    versioned.write(table(spark, [("b", "2")]), "chunk_id", path)
    assert [r.chunk_id for r in reader.collect()] == ["a"] and got(spark, path) == [("b", "2")]
    versioned.write(table(spark, [("c", "3")]), "chunk_id", path)
    assert len(folders(path)) == 2  # the first one's folder is gone


KILLED = """
    import sys, time
    from pyspark.sql import functions as F
    from tremolo.session import local_session
    from tremolo.sources import versioned

    spark = local_session(cores=1, partitions=1)
    path, mark = sys.argv[1:]

    @F.udf("string")
    def slow(text):
        open(mark, "a").close()
        time.sleep(120)
        return text

    rows = spark.range(100).selectExpr("concat('n', id) AS chunk_id", "'new' AS text")
    versioned.write(rows.withColumn("text", slow("text")), "chunk_id", path)
"""


def test_killed_writer(spark, tmp_path):
    path, mark = str(tmp_path / "t"), tmp_path / "began"
    rows = [("a", "1"), ("b", "2")]
    versioned.write(table(spark, rows), "chunk_id", path)
    writer = subprocess.Popen([sys.executable, "-c", textwrap.dedent(KILLED), path, str(mark)], start_new_session=True, stderr=subprocess.DEVNULL)
    try:
        for _ in range(600):
            if mark.exists() or writer.poll() is not None:
                break
            time.sleep(0.1)
        assert mark.exists()
    finally:
        os.killpg(writer.pid, signal.SIGKILL)
        writer.wait()
    assert got(spark, path) == rows
    versioned.write(table(spark, rows[:1]), "chunk_id", path)
    assert got(spark, path) == rows[:1]


def test_index_embeds_new_texts_only(spark, tmp_path):
    from tests.test_search import text
    from tremolo.sources import knowledge

    path, count = str(tmp_path / "index"), spark.sparkContext.accumulator(0)

    def embed(column):
        @F.udf("array<double>")
        def run(t):
            count.add(1)
            return [float(len(t))]

        return run(column)

    make = lambda bodies: knowledge.entries(spark.createDataFrame([text(k, "w", ["c"], b) for k, b in bodies.items()], "name string, text string"))
    bodies = {f"kind{k}": "calm words. " * 60 for k in range(6)}
    n = search.write_index(make(bodies), embed, path).first()["count"]
    assert count.value == n > 6
    search.write_index(make(bodies), embed, path)
    assert count.value == n and versioned.current(spark, path).number == 1
    less = search.write_index(make(bodies | {"kind3": "other"}), embed, path).first()
    assert count.value == n + 1 and versioned.current(spark, path).number == 2 and less.pruned == n - less["count"] > 0
    rows = search.open_index(spark, path).collect()
    assert len(rows) == less["count"] and all(r.embedding == [float(len(r.text))] for r in rows)
    search.write_index(make(bodies | {"kind3": "other"}), embed, path, model="another")
    assert count.value == n + 1 + less["count"]
    with pytest.raises(Exception, match="no vectors"):
        search.write_index(make(bodies), lambda t: F.raise_error(F.lit("no vectors")).cast("array<double>"), path, model="another")
    assert search.open_index(spark, path).count() == less["count"] and search.status(spark, path).first()["count"] == less["count"]
    assert retrieval.rebuilt(search.open_index(spark, path), search.open_index(spark, path))[1].first().added == 0
