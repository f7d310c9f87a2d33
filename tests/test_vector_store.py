import json

import pytest

from helixspark.streaming.upserts import stream_upserts
from helixspark.vector import layout
from helixspark.vector.store import SCHEMA, VectorStore


def record(chunk, vector, text=""):
    return {"id": chunk, "chunk_id": chunk, "space_id": "s", "vector": vector, "text": text, "metadata": "{}"}


@pytest.fixture
def store(spark, tmp_path):
    s = VectorStore(spark, str(tmp_path))
    s.ensure_table("s", 4)
    return s


THREE = [record("c0", [1, 0, 0, 0]), record("c1", [0, 1, 0, 0]), record("c2", [1, 1, 0, 0])]


def test_layout():
    assert layout.shard_of("space-abc") == "shard_a8"
    assert len({layout.shard_of(f"space-{k}") for k in range(1000)}) >= 50
    for bad in ("", "..", "a/b"):
        with pytest.raises(ValueError):
            layout.space_path("/b", bad)


def test_search_upsert_delete_and_drop(store):
    assert store.ping("s") and store.stats("s")["table_rows"] == 0
    assert store.upsert_json("s", "[]") == 0
    assert store.upsert_json("s", json.dumps(THREE)) == 3
    found = json.loads(store.search_json("s", "[1, 0, 0, 0]", 2))
    assert [r["chunk_id"] for r in found] == ["c0", "c2"] and found[1]["distance"] == 1.0 and found[1]["score"] == 0.0
    assert [r["chunk_id"] for r in json.loads(store.search_json("s", "[1, 0, 0, 0]", 2, "chunk_id <> 'c0'"))] == ["c2", "c1"]
    assert store.upsert_json("s", json.dumps([record("c0", [0, 0, 0, 1], "it's")])) == 1
    assert store.stats("s")["table_rows"] == 3
    assert store.upsert_json("s", json.dumps([record("c9", [1, 2, 3])])) == 1
    assert store.table("s").where("vector is null").count() == 1
    assert store.delete_chunks("s", ["c1", "no'ne"]) == 2
    assert sorted(r["chunk_id"] for r in store.table("s").collect()) == ["c0", "c2", "c9"]
    with pytest.raises(ValueError):
        store.ensure_table("s", 5)
    with pytest.raises(ValueError):
        store.nearest("s", [], 3)
    store.drop_table("s")
    assert store.commit_of("s") is None
    with pytest.raises(LookupError):
        store.drop_table("s")


def test_repeated_chunks_in_a_batch_are_kept(store):
    assert store.upsert_json("s", json.dumps([THREE[0], THREE[0]])) == 2
    assert store.stats("s")["table_rows"] == 2


def test_writers_keep_what_others_committed(spark, store, tmp_path):
    """Two writers that start from the same version, by upsert, deletion, index and merge: nothing committed is lost."""
    other = VectorStore(spark, str(tmp_path))
    stale = store.commit_of("s")
    assert store.upsert_json("s", json.dumps(THREE[:1])) == 1 and store.upsert_json("s", json.dumps(THREE[1:2])) == 1
    held, other.commit_of = other.commit_of, lambda space, calls=[]: stale if not calls.append(1) and len(calls) < 3 else held(space)
    assert other.upsert_json("s", json.dumps([record("b1", [0, 0, 1, 0])])) == 1
    assert sorted(r["chunk_id"] for r in store.table("s").collect()) == ["b1", "c0", "c1"]
    base = store.commit_of("s")
    assert other.delete_chunks("s", ["c0"]) == 1
    store._replace("s", base, store.table("s", base), base.index)
    assert sorted(r["chunk_id"] for r in other.table("s").collect()) == ["b1", "c1"]
    store.optimize_index("s")
    assert sorted(r["chunk_id"] for r in other.table("s").collect()) == ["b1", "c1"] and len(store.commit_of("s").parts) == 1


def test_a_write_leaves_other_parts_alone(spark, store, tmp_path):
    store.upsert_json("s", json.dumps(THREE))
    folder = store._path("s")
    before = {name: store.files.names(f"{folder}/{name}") for name in store.files.names(folder) if name.startswith("part")}
    store.upsert_json("s", json.dumps([record("c0", [0, 0, 0, 1])]))
    store.delete_chunks("s", ["c1"])
    assert all(store.files.names(f"{folder}/{name}") == files for name, files in before.items())
    assert [spark.read.parquet(f"{folder}/{p.path}").count() for p in store.commit_of("s").parts] == [3, 1, 1]
    assert {r["chunk_id"]: list(r["vector"]) for r in store.table("s").collect()} == {"c0": [0, 0, 0, 1], "c2": [1, 1, 0, 0]}


def test_nearest_many_like_one_by_one(spark, store):
    rows = [(str(i), str(i), "s", [float(i % 5), float(i % 3), float(i // 40), 0.5], "", "{}") for i in range(120)]
    store.upsert("s", spark.createDataFrame(rows, SCHEMA))
    queries = spark.createDataFrame([(k, rows[k][3]) for k in range(0, 120, 20)] + [(999, [1.0])], "query_id long, vector array<float>")
    many = {}
    for r in store.nearest_many("s", queries, 7, "chunk_id <> '20'", block=3).collect():
        many.setdefault(r["query_id"], set()).add((r["chunk_id"], r["distance"]))
    assert sorted(many) == list(range(0, 120, 20))
    for k, found in many.items():
        assert found == {(r["chunk_id"], r["distance"]) for r in store.nearest("s", rows[k][3], 7, "chunk_id <> '20'").collect()}


def test_index_recall(spark, store):
    rows = [(str(i), str(i), "s", [i / 300, 2 * i / 300, float(i % 7), 0.0], "", "{}") for i in range(300)]
    store.upsert("s", spark.createDataFrame(rows, SCHEMA))
    store.create_index("s", cells=8)
    store.optimize_index("s")
    assert store.stats("s")["indexed"] and store.table("s").where("cell is null").count() == 0
    hits = total = 0
    for q in rows[::30]:
        exact = {r["chunk_id"] for r in store.nearest("s", q[3], 5).collect()}
        hits += len(exact & {r["chunk_id"] for r in store.nearest("s", q[3], 5, probes=4).collect()})
        total += 5
    assert hits / total >= 0.9


def test_stream_upserts(spark, store, tmp_path):
    spark.createDataFrame([(r["id"], r["chunk_id"], "s", [float(x) for x in r["vector"]], "", "{}") for r in THREE], SCHEMA).write.parquet(str(tmp_path / "in"))
    stream_upserts(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), store, "s", str(tmp_path / "cp"), once=True).awaitTermination()
    assert store.stats("s")["table_rows"] == 3
