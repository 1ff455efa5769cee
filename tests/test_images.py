"""Images are described once, whatever happens to the tasks."""

import os
import time

import pytest
from pyspark.sql import functions as F

from tamarack.operators import images as I, sync


@pytest.fixture()
def log(tmp_path):
    os.makedirs(f"{tmp_path}/log")
    return f"{tmp_path}/log"


def asked(log):
    return sorted(x for n in os.listdir(log) for line in open(f"{log}/{n}") for x in line.split())


def model(log, broken=()):
    def describe(rows):
        if any(r["image_hash"] in broken for r in rows):
            raise ValueError("no answer")
        with open(f"{log}/{os.getpid()}", "a") as f:
            f.write(" ".join(r["image_hash"] for r in rows) + "\n")
        return [f" about {r['image_hash']} of {len(r['image_bytes'])} " for r in rows]

    return describe


def table(spark, names):
    return spark.createDataFrame([(n, bytearray(b"xyz")) for n in names], "image_hash string, image_bytes binary")


def test_each_hash_is_asked_for_once(spark, tmp_path, log):
    names = [f"h{i}" for i in range(40)]
    claims = I.Claims(f"{tmp_path}/claims")
    out = I.described_images(table(spark, names + names).repartition(4), model(log), claims, batch=3)
    for _ in range(3):  # run again, as tasks are
        rows = {r["image_hash"]: r["semantic_text"] for r in out.collect()}
    assert rows == {n: f"about {n} of 3" for n in names} and asked(log) == sorted(names)
    assert max(len(line.split()) for n in os.listdir(log) for line in open(f"{log}/{n}")) <= 3
    assert not [f for _, _, fs in os.walk(f"{tmp_path}/claims") for f in fs if f.endswith(".claim")]


def test_failures_leave_images_free(spark, tmp_path, log):
    claims = I.Claims(f"{tmp_path}/claims")
    df = table(spark, ["a", "b", "c"]).coalesce(1)
    first = {r["image_hash"]: (r["semantic_text"], r["error"]) for r in I.described_images(df, model(log, {"b"}), claims, batch=1).collect()}
    assert first["a"] == ("about a of 3", None) and first["b"] == (None, "describe_error: no answer") and first["c"][1] is None
    again = {r["image_hash"]: r["error"] for r in I.described_images(df, model(log), claims, batch=1).collect()}
    assert again == {"a": None, "b": None, "c": None} and asked(log) == ["a", "b", "c"]
    short = I.described_images(table(spark, ["d"]), lambda rows: [], claims).first()
    assert "0 texts for 1" in short["error"]


def test_claims_stand_for_their_lease(spark, tmp_path, log):
    claims = I.Claims(f"{tmp_path}/claims", lease=60)
    assert claims.take("a") and not claims.take("a") and claims.take("b")
    os.utime(f"{claims._place('b')}.claim", (time.time() - 61,) * 2)  # whose executor was lost
    rows = {r["image_hash"]: (r["semantic_text"], r["error"]) for r in I.described_images(table(spark, ["a", "b", None]), model(log), claims).collect()}
    assert rows == {"a": (None, I.CLAIMED), "b": ("about b of 3", None)} and asked(log) == ["b"]


def test_texts_are_stored(spark, tmp_path, log):
    images = spark.createDataFrame([("a", None, "png"), ("b", "old", "png"), ("c", "", None)], "image_hash string, semantic_text string, mime_type string")
    pending = sync.pending_images(images, images)
    assert sorted(r[0] for r in pending.select("image_hash").collect()) == ["a", "c"]
    found = I.described_images(pending.withColumn("image_bytes", F.lit(b"z")), model(log, {"c"}), I.Claims(f"{tmp_path}/claims"), batch=1)
    out = {r["image_hash"]: r["semantic_text"] for r in I.set_image_texts(images, found).collect()}
    assert out == {"a": "about a of 1", "b": "old", "c": ""}
    assert I.described_images(table(spark, []), model(log), I.Claims(f"{tmp_path}/claims")).count() == 0
