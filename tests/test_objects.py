"""Stored objects: prefixes are replaced whole, or nothing is."""

import os
import time

import pytest
from pyspark.sql import functions as F

from tamarack.operators import pages
from tamarack.sources import objects as O


def rows(spark, items, data=b"x"):
    return spark.createDataFrame([(p, k, bytearray(data)) for p, k in items], "prefix string, object_key string, data binary")


def keys(spark, root, prefix=""):
    return sorted(r["object_key"] for r in O.heads(spark, root, prefix).collect())


def test_prefixes_are_replaced(spark, tmp_path):
    root = f"{tmp_path}/o"
    O.write_objects(rows(spark, [("d/a", f"d/a/p{i}.md") for i in range(5)] + [("d/b", "d/b/p0.md")]), root)
    O.write_objects(rows(spark, [("d/a", "d/a/p9.md"), ("d/a", "d/a/sub/p1.md")], b"new"), root)
    assert keys(spark, root) == ["d/a/p9.md", "d/a/sub/p1.md", "d/b/p0.md"] and os.listdir(f"{root}/{O.STAGING}") == []
    assert {bytes(r["data"]) for r in O.bodies(spark, root, "d/a").collect()} == {b"new"} and O.heads(spark, root, "d/b/p0.md").first()["size"] == 1
    assert O.delete_prefix(root, "d/a") == 2 and O.delete_prefix(root, "d/none") == 0 and keys(spark, root) == ["d/b/p0.md"]
    gone = {r["object_key"]: r["deleted"] for r in O.delete_objects(spark.createDataFrame([("d/b/p0.md",), ("d/q",)], "object_key string"), root).collect()}
    assert gone == {"d/b/p0.md": True, "d/q": False} and keys(spark, root) == [] and not os.path.exists(f"{root}/d")


@pytest.mark.parametrize("key", ["d/../../out.md", "/d/x.md", "d//x.md", "d/./x.md", "d/_hidden", "d/.x", "", "d\\..\\..\\x", "e/x.md"])
def test_keys_outside_are_refused(spark, tmp_path, key):
    root = f"{tmp_path}/o"
    O.write_objects(rows(spark, [("d", "d/old.md")]), root)
    with pytest.raises(Exception, match="key|below"):
        O.write_objects(rows(spark, [("d", "d/a.md"), ("d", key)]), root)
    assert keys(spark, root) == ["d/old.md"] and os.listdir(f"{root}/{O.STAGING}") == [] and os.listdir(tmp_path) == ["o"]


def test_a_task_that_fails_midway_leaves_nothing(spark, tmp_path):
    root = f"{tmp_path}/o"
    O.write_objects(rows(spark, [("d/a", "d/a/old.md")]), root)
    fails = F.udf(lambda k: b"x" if k != "d/q/p1.md" else 1 // 0, "binary")
    bad = rows(spark, [("d/a", "d/a/p0.md"), ("d/q", "d/q/p0.md"), ("d/q", "d/q/p1.md")]).withColumn("data", fails("object_key"))
    with pytest.raises(Exception, match="ZeroDivision"):
        O.write_objects(bad, root)
    assert keys(spark, root) == ["d/a/old.md"] and os.listdir(f"{root}/{O.STAGING}") == []


def test_a_commit_that_was_cut_off_is_finished(spark, tmp_path, monkeypatch):
    root = f"{tmp_path}/o"
    fs, path = O.opened(root) if os.makedirs(root) is None else None
    writer = O._Writer(root)
    batch = rows(spark, [(f"d{i}", f"d{i}/old.md") for i in range(4)])
    O.write_objects(batch, root)
    staged = writer.write(iter(rows(spark, [(f"d{i}", f"d{i}/new.md") for i in range(4)]).toArrow().to_batches()))
    moved = []

    def move(fs, old, new):
        if len(moved) == 3:
            raise OSError("lost")
        moved.append(new)
        real(fs, old, new)

    real = O._move
    monkeypatch.setattr(O, "_move", move)
    monkeypatch.setattr(O, "MOVERS", 1)
    with pytest.raises(OSError):
        writer.commit([staged])
    monkeypatch.setattr(O, "_move", real)
    assert O.recover(root) == 1 and keys(spark, root) == [f"d{i}/new.md" for i in range(4)]
    # without a commit nothing is published, and what is old goes
    O._Writer(root).write(iter(rows(spark, [("d9", "d9/x.md")]).toArrow().to_batches()))
    assert O.recover(root) == 0 and len(os.listdir(f"{root}/{O.STAGING}")) == 1
    time.sleep(0.01)
    assert O.recover(root, abandoned=0.0) == 0 and os.listdir(f"{root}/{O.STAGING}") == [] and "d9/x.md" not in keys(spark, root)


def test_page_bodies(spark, tmp_path):
    units = spark.createDataFrame([(1, 5, " b \n"), (1, 3, "a"), (2, 1, None), (3, 1, "late")], "doc_id int, unit_no int, markdown string")
    names = spark.createDataFrame([(1, "My doc.pdf"), (2, "x.md"), (3, "x.md"), (4, "none.md")], "doc_id int, original_filename string")
    root = f"{tmp_path}/o"
    O.write_objects(pages.page_objects(units, names), root)
    got = {r["object_key"]: bytes(r["data"]) for r in O.bodies(spark, root, "documents").collect()}
    assert got == {"documents/My-doc.pdf/pages/page-0001.md": b"a\n", "documents/My-doc.pdf/pages/page-0002.md": b"b\n", "documents/x.md/pages/page-0001.md": b"late\n"}
    O.write_objects(pages.page_objects(units.limit(0), names), root)
    assert len(keys(spark, root)) == 3


def test_a_large_prefix_is_written_by_many_tasks_and_listed_by_tasks(spark, tmp_path):
    root = f"{tmp_path}/o"
    many = spark.range(400).select(F.lit("d").alias("prefix"), F.format_string("d/%d/%03d.md", F.col("id") % 3, F.col("id")).alias("object_key"), F.encode(F.repeat(F.col("id").cast("string"), F.lit(2000)), "utf-8").alias("data"))
    for _ in range(2):  # the second replaces the first
        O.write_objects(many, root)
    assert O.heads(spark, root).count() == 400 and os.listdir(f"{root}/{O.STAGING}") == []
    assert not any("binaryFile" in x for x in (O.heads(spark, root)._jdf.queryExecution().toString(), O.bodies(spark, root)._jdf.queryExecution().toString()))
    got, want = O.bodies(spark, root).select("object_key", "data"), many.select("object_key", "data")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    twice = many.unionByName(many.where("object_key = 'd/0/399.md'"))
    with pytest.raises(Exception, match="comes twice"):
        O.write_objects(twice, root)
    staged = O._Writer(root).write(iter(many.limit(3).toArrow().to_batches()))
    assert staged.prefixes == 1  # a number: names of prefixes don't go to the driver
