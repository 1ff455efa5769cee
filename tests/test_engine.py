"""Sources, snapshots, the engine and streams."""

import os

import pytest
from pyspark.sql import Window, functions as F

from tamarack.operators import events as batch
from tamarack.plans import queries as core
from tamarack.plans.engine import Engine
from tamarack.sources import files
from tamarack.sources.store import SnapshotStore
from tamarack.streaming import sessions


def write(folder, **texts):
    for name, text in texts.items():
        path = os.path.join(folder, name.replace("__", "/").replace("_md", ".md").replace("_html", ".html"))
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(text if isinstance(text, bytes) else text.encode())


def test_scan_decode_and_list(spark, tmp_path):
    write(tmp_path, a_md="# Über\n\n$ 5", sub__b_html="<p>x</p>", c_txt="no")
    write(tmp_path, gbk_md="中文内容".encode("gbk"))
    found = files.scan(spark, str(tmp_path))
    assert sorted(r["relative_path"] for r in found.collect()) == ["a.md", "gbk.md", "sub/b.html"]
    assert [r["relative_path"] for r in files.glob(found, "**/*.html").collect()] == ["sub/b.html"] and files.glob(found, "*.md").count() == 2
    assert found.where("relative_path = 'gbk.md'").select(files.decode_any(F.col("bytes"))).first()[0] == "中文内容"
    parsed = files.parse(found.unionByName(found.limit(1).withColumn("suffix", F.lit(".pdf")).withColumn("relative_path", F.lit("p.pdf"))))
    assert parsed.where("relative_path = 'p.pdf'").first()["error"].startswith("unsupported") and parsed.where("relative_path = 'sub/b.html'").first()["content"] == "x"
    assert files.parse(found.limit(1).withColumn("suffix", F.lit(".pdf")), {".pdf": lambda b: 1 // 0}).first()["error"].startswith("parse_error")
    assert [(r["name"], r["kind"]) for r in files.list_directory(spark, str(tmp_path)).collect()][0] == ("sub", "directory")
    assert files.list_directory(spark, f"{tmp_path}/none").count() == 0
    assert files.folder_preview(parsed).count() == 4


def test_index_search_change_and_forget(spark, tmp_path):
    root, store = f"{tmp_path}/in", f"{tmp_path}/store"
    write(root, a_agreement_md="Purchase price is $45,000,000 for all.", b_schedule_md="The schedule of March 3, 2021 and its report.")
    engine = Engine(spark, store, root, embed=lambda ts: [[float("price" in t.lower()), 1.0] for t in ts])
    first = engine.index()
    assert (first.indexed, first.failed, first.deleted, first.embeddings) == (2, 0, 0, 2)
    again = engine.index()
    assert (again.indexed, again.skipped) == (0, 2) and engine.chunks.count() == 2
    hits = engine.search("price", "document_type = agreement").collect()
    assert hits[0]["relative_path"] == "a_agreement.md" and hits[0]["matched_by"] == "semantic+metadata"
    assert engine.search_pages("purchase price", "mentions_currency = true").first()["matched_by"] == "page_content+metadata"
    os.unlink(f"{root}/b_schedule.md")
    write(root, a_agreement_md="Another text.", c_md="New")
    changed = engine.index_if_stale()
    assert (changed.indexed, changed.deleted) == (2, 1) and engine.index_if_stale() is None
    assert engine.status().first()["documents"] == 2 and engine.list_documents("new", 1, 5).count() == 0
    name = engine.create_collection("mine", "2024-01-01")
    ids = engine.documents.where("relative_path = 'c.md'").select("doc_id")
    engine.attach(name, ids)
    assert [r["doc_id"] for r in engine.resolve_scope(name).collect()] == [ids.first()[0]]
    engine.delete(ids)
    assert engine.resolve_scope(name).count() == 0
    engine.delete(ids, physically=True)
    assert engine.documents.where("relative_path = 'c.md'").count() == 0 and {r["value"] for r in engine.facets(["extension"]).collect()} == {".md"}


def test_facade_changes(spark, tmp_path):
    root = f"{tmp_path}/in"
    write(root, a_md="# One\n\nalpha", b_md="# Two\n\nbeta")
    engine = Engine(spark, f"{tmp_path}/store", root)
    engine.index()
    assert engine.store.read("corpora").count() == 1 and engine.store.read("document_pages").count() == 2
    folders = engine.store.current()[1]["documents"]
    write(root, a_md="# One\n\nanother")
    engine.index()
    after = engine.store.current()[1]["documents"]
    a, b = (engine.documents.where(F.col("relative_path") == f"{n}.md").select("doc_id") for n in "ab")
    assert engine.store.read("corpora").count() == 1 and sum(after[k] != folders.get(k) for k in after) == 1  # one bucket of two
    engine.save_schema("first", "{}", now="2024-01-01")
    engine.save_schema("second", "{}", now="2024-01-02")
    assert [r["name"] for r in engine.schema().collect()] == ["second"]
    c = engine.create_collection("mine", "2024-01-01")
    engine.attach(c, a.unionByName(b))
    engine.detach(c, b)
    assert [r[0] for r in engine.resolve_scope(c).collect()] == [a.first()[0]]
    engine.rename_collection(c, "ours", "2024-01-03")
    engine.delete_collection(c, "2024-01-04")
    assert tuple(engine.store.read("collections").select("name", "is_deleted").first()) == ("ours", True)
    stub = engine.upsert_stub("up/new.md", "new.md", "key", 3)
    again = engine.upsert_stub("a.md", "renamed.md")
    rows = {r["doc_id"]: r for r in engine.documents.collect()}
    assert len(rows) == 3 and rows[stub]["content"] == "" and rows[stub]["parsed_is_complete"] is False
    assert again == a.first()[0] and "another" in rows[again]["content"] and rows[again]["original_filename"] == "renamed.md"
    engine.set_attributes(b, metadata_json='{"x":1}', is_deleted=True)
    assert engine.documents.where("relative_path = 'b.md'").select("metadata_json", "is_deleted").first() == ('{"x":1}', True)
    with pytest.raises(ValueError):
        engine.set_attributes(b, doc_id="x")
    engine.delete(a, physically=True)
    for table, key in (("documents", "doc_id"), ("chunks", "doc_id"), ("parsed_units", "doc_id"), ("document_pages", "document_id")):
        assert engine.store.read(table).where(F.col(key) == again).count() == 0, table


def test_folders_status_and_sessions(spark, tmp_path):
    root = f"{tmp_path}/in"
    write(root, a_md="alpha", sub__b_md="beta", _hidden__c_md="x")
    os.makedirs(f"{root}/.git")
    row = files.folder_listing(spark, root).first()
    assert (row["current"], row["parent"], row["files_count"], row["error"]) == (root, str(tmp_path), 1, None) and row["folders"] == ["_hidden", "sub"]
    assert files.folder_listing(spark, f"{root}/a.md").first()["error"] == "not a directory" and files.folder_listing(spark, f"{root}/no").first()["error"] == "path not found"
    engine = Engine(spark, f"{tmp_path}/store", root)
    assert engine.folder_status().first()["indexed"] is False
    engine.index()
    engine.save_schema("first", '{"fields": [{"name": "x", "type": "string"}, {"type": "y"}], "metadata_profile": {}}', now="2024-01-01")
    status = engine.folder_status().first()
    assert (status["indexed"], status["document_count"], status["schema_name"], status["has_metadata"], status["has_embeddings"], status["schema_fields"]) == (True, 2, "first", True, False, ["x"])
    log = spark.createDataFrame([(1, 1, "2024-01-01 00:00:00", "start", "{}"), (1, 2, "2024-01-01 00:00:05", "complete", "{}"), (2, 1, "2024-01-01 00:00:01", "start", "{}")], "session_id bigint, event_id bigint, ts string, type string, data string").withColumn("ts", F.col("ts").cast("timestamp"))
    engine.append_events(log.where("event_id = 1"))
    engine.append_events(log)  # what is known isn't added again
    assert {(r["session_id"], r["state"]) for r in engine.sessions().collect()} == {(1, "completed"), (2, "running")}
    assert [r["sequence"] for r in engine.session_events(1, after=1).collect()] == [2] and engine.session_events(1).count() == 2
    engine.prune_sessions("2024-01-01 01:00:00")
    assert [r["session_id"] for r in engine.sessions().collect()] == [2]


def test_second_writer_fails(spark, tmp_path):
    store = SnapshotStore(spark, f"{tmp_path}/s")
    rows = spark.createDataFrame([("c", "d")], "collection_id string, doc_id string")
    store.commit(collection_documents=rows)

    class Late(SnapshotStore):
        def _written(self, name, df):
            out = super()._written(name, df)
            store.commit(collection_documents=rows)  # someone commits while this one writes
            return out

    with pytest.raises(OSError):
        Late(spark, f"{tmp_path}/s").commit(collection_documents=rows.limit(0))
    assert store.read("collection_documents").count() == 1


def test_one_of_many_writers_commits(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    store = SnapshotStore(spark, f"{tmp_path}/s")
    rows = spark.createDataFrame([("c", "d")], "collection_id string, doc_id string")

    def commit(_):
        try:
            SnapshotStore(spark, f"{tmp_path}/s").commit(collection_documents=rows)
            return True
        except OSError:
            return False

    with ThreadPoolExecutor(6) as pool:
        won = sum(pool.map(commit, range(6)))
    assert won >= 1 and store.current()[0] == won - 1 and store.read("collection_documents").count() == 1
    number = store.current()[0] + 1
    assert store._claimed(number) and not store._claimed(number)  # who took it is gone
    with pytest.raises(OSError):
        store.commit(collection_documents=rows)
    assert store.release(number) and not store.release(number - 1)
    store.commit(collection_documents=rows.limit(0))
    assert store.read("collection_documents").count() == 0


def test_old_snapshots_are_removed(spark, tmp_path):
    store = SnapshotStore(spark, f"{tmp_path}/s", buckets=4)
    for i in range(4):
        rows = spark.createDataFrame([(f"c{i}", f"d{i}")], "collection_id string, doc_id string")
        store.commit({"collection_documents": (rows, rows)}, collections=spark.createDataFrame([(f"c{i}", "n", None, None, False)], "collection_id string, name string, created_at timestamp, updated_at timestamp, is_deleted boolean"))
    assert store.vacuum(keep=1) == 0  # all is young
    named = {f.split("/bucket=")[0] for buckets in store.current()[1].values() for f in buckets.values()}
    written = {f"{tmp_path}/s/{t}/{f}" for t in ("collections", "collection_documents") for f in os.listdir(f"{tmp_path}/s/{t}")}
    assert store.vacuum(keep=1, older_than=0) == len(written - named) >= 3  # the collections of three commits, and buckets that were written again
    assert {f"{tmp_path}/s/{t}/{f}" for t in ("collections", "collection_documents") for f in os.listdir(f"{tmp_path}/s/{t}")} == named
    assert store.read("collection_documents").count() == 4 and store.read("collections").count() == 1 and len(store._pointers()) == 1
    rows = spark.createDataFrame([("c9", "d9")], "collection_id string, doc_id string")
    store.commit({"collection_documents": (rows, rows)})
    assert store.current()[0] == 4 and store.read("collection_documents").count() == 5


def test_streams_say_what_batches_say(spark, tmp_path):
    if not os.path.isdir("/root/testdata/sf0.001"):
        return
    rows = core.events_of(spark, "/root/testdata/sf0.001").where("session_id < 40").select("event_id", "session_id", "ts", "type", "data")
    for part in range(3):  # in order of time, as a log grows
        rows.orderBy("ts", "event_id").withColumn("n", F.ntile(3).over(Window.orderBy("ts", "event_id"))).where(F.col("n") == part + 1).drop("n").coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
        query = sessions.session_states(sessions.read_events(spark, f"{tmp_path}/log"), minutes=10**6).writeStream.foreachBatch(lambda df, _: df.write.mode("append").parquet(f"{tmp_path}/states")).option("checkpointLocation", f"{tmp_path}/cp").outputMode("update").trigger(availableNow=True).start()
        assert query.awaitTermination(120)
    last = spark.read.parquet(f"{tmp_path}/states").groupBy("session_id").agg(F.max_by("state", "sequence").alias("state"), F.max("sequence").alias("n"))
    got = {r["session_id"]: (r["state"], r["n"]) for r in last.collect()}
    counts = {r["session_id"]: r["count"] for r in rows.groupBy("session_id").count().collect()}
    assert got == {r["session_id"]: (r["state"], counts[r["session_id"]]) for r in batch.final_states(rows).collect()}
