"""Objects in packs: prefixes are replaced whole, or nothing is, and small objects take about their size."""

import os

import pytest
from pyspark.sql import functions as F

from tamarack.operators import pages
from tamarack.plans import queries
from tamarack.sources.packs import PackedObjects


def rows(spark, items, data=b"x"):
    return spark.createDataFrame([(p, k, bytearray(data)) for p, k in items], "prefix string, object_key string, data binary")


def held(stored, prefix=""):
    return {r["object_key"]: bytes(r["data"]) for r in stored.bodies(prefix).collect()}


def packs(root):
    return os.listdir(f"{root}/objects")


def test_prefixes_are_replaced(spark, tmp_path):
    root = f"{tmp_path}/o"
    stored = PackedObjects(spark, root)
    assert held(stored) == {}
    stored.write(rows(spark, [("d/a", f"d/a/p{i}.md") for i in range(5)] + [("d/b", "d/b/p0.md"), ("d/b/c", "d/b/c/q"), ("d/a", "d/a/s/p")]))
    stored.write(rows(spark, [("d/a/s", "d/a/s/r")], b"sub"))
    assert sorted(held(stored, "d/a")) == [*(f"d/a/p{i}.md" for i in range(5)), "d/a/s/r"]
    stored.write(rows(spark, [("d/a", "d/a/p9.md"), ("d/a", "d/a/sub/p1.md")], b"new"))
    want = {"d/a/p9.md": b"new", "d/a/sub/p1.md": b"new", "d/b/p0.md": b"x", "d/b/c/q": b"x"}
    assert held(stored) == want and {r["size"] for r in stored.heads("d/a").collect()} == {3} and stored.heads("d/b/p0.md").first()["size"] == 1
    assert {r["object_key"]: r["deleted"] for r in stored.delete(spark.createDataFrame([("d/b/p0.md",), ("d/q",)], "object_key string")).collect()} == {"d/b/p0.md": True, "d/q": False}
    assert sorted(held(stored)) == ["d/a/p9.md", "d/a/sub/p1.md", "d/b/c/q"]
    stored.repack()
    assert sorted(held(stored)) == ["d/a/p9.md", "d/a/sub/p1.md", "d/b/c/q"] and len(stored._packs()) == 1
    assert stored.vacuum(keep=1, older_than=-1) >= 4 and len(packs(root)) == 1
    assert stored.delete_prefix("d/a") == 2 and stored.delete_prefix("d/none") == 0 and sorted(held(stored)) == ["d/b/c/q"]
    stored.write(rows(spark, [("d/a", "d/a/p9.md")], b"again"))
    assert held(stored) == {"d/a/p9.md": b"again", "d/b/c/q": b"x"}


def test_keys_outside_or_twice_are_refused(spark, tmp_path):
    root = f"{tmp_path}/o"
    stored = PackedObjects(spark, root)
    stored.write(rows(spark, [("d", "d/old.md")]))
    for key in ("d/../../out.md", "/d/x.md", "d//x.md", "d/./x.md", "d/_hidden", "d/.x", "d/x/", "", None, "d\\..\\..\\x", "e/x.md", "d/b.md"):
        with pytest.raises(Exception, match="key|below|twice"):
            stored.write(rows(spark, [("d", "d/a.md"), ("d", "d/b.md"), ("d", key)]))
    assert list(held(stored)) == ["d/old.md"] and len(packs(root)) == 1


def test_of_two_writers_at_once_both_are_seen(spark, tmp_path, monkeypatch):
    stored, other = PackedObjects(spark, f"{tmp_path}/o"), PackedObjects(spark, f"{tmp_path}/o")
    real, asked = stored._packs, []

    def late():
        if not asked:
            asked.append(1)
            other.write(rows(spark, [("d", "d/1"), ("e", "e/1")], b"first"))
        return real()

    monkeypatch.setattr(stored, "_packs", late)
    stored.write(rows(spark, [("d", "d/2")], b"second"))
    assert held(stored) == {"d/2": b"second", "e/1": b"first"} and [p["number"] for p in real()] == [0, 1]


def test_page_bodies(spark, tmp_path):
    units = spark.createDataFrame([(1, 5, " b \n"), (1, 3, "a"), (2, 1, None), (3, 1, "late")], "doc_id int, unit_no int, markdown string")
    names = spark.createDataFrame([(1, "My doc.pdf"), (2, "x.md"), (3, "x.md"), (4, "none.md")], "doc_id int, original_filename string")
    stored = PackedObjects(spark, f"{tmp_path}/o")
    for some in (units, units.limit(0)):
        stored.write(pages.page_objects(some, names))
        assert held(stored, "documents") == {"documents/My-doc.pdf/pages/page-0001.md": b"a\n", "documents/My-doc.pdf/pages/page-0002.md": b"b\n", "documents/x.md/pages/page-0001.md": b"late\n"}


def test_stored_pages_take_no_more_disk_than_their_bodies(spark, tmp_path, monkeypatch):
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.concat(F.lit("words "), F.repeat(F.sha2(F.col("id").cast("string"), 256), F.lit(3))).alias("text"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    root = f"{tmp_path}/o"
    monkeypatch.setattr(queries, "scratch", lambda spark: f"file://{root}")
    out = queries.QUERIES["stored_pages"](spark, str(tmp_path)).collect()
    assert len(out) == len({r["object_key"] for r in out}) == 480  # every fifth is empty
    places = [os.path.join(d, f) for d, folders, files in os.walk(root) for f in [*folders, *files]]
    assert sum(os.lstat(p).st_blocks * 512 for p in places) < 480 * 1000  # a file in a folder each takes 480 times 4096 and more
