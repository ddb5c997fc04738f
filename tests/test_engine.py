import random
import threading

import pytest
from pyspark.sql import functions as F

from vecloom.operators.fold import fold, fold_onto
from vecloom.plans.engine import Engine
from vecloom.plans.render import render
from vecloom.plans.sql import Count, Create, Select, SqlError, parse
from vecloom.sources.files import Store
from vecloom.sources.oplog import Moved, OpLog
from vecloom.sources.payload import read_payload
from vecloom.streaming.follower import Follower
from vecloom.types import OPERATION, AlreadyExistsError, CorruptionError, FencedError, IndexOptions, NotFoundError, PrunedError, ValidationError, tagged_map, untagged_map


def replay(ops):
    """The fold, step by step."""
    state = {}
    for o in ops:
        if o["op"] == "delete":
            state.pop(o["id"], None)
        elif o["op"] == "update":
            state[o["id"]] = (state.get(o["id"], (None,))[0], o["metadata"], o["document"], o["seq"])
        else:
            state[o["id"]] = (o["embedding"], o["metadata"], o["document"], o["seq"])
    return state


def some_ops(rng, n):
    out = []
    for i in range(n):
        op = rng.choice(["add", "upsert", "update", "delete"])
        full = op != "delete"
        out.append({"id": f"r{rng.randint(0, 12)}", "op": op, "seq": i + 1, "epoch": 0, "embedding": [float(i)] if op in ("add", "upsert") else None,
                    "metadata": rng.choice([None, {"n": i}]) if full else None, "document": rng.choice([None, f"d{i}"]) if full else None})
    return out


def frame(spark, ops):
    names = [f.name for f in OPERATION.fields]
    return spark.createDataFrame([tuple({**o, "metadata": tagged_map(o["metadata"])}[n] for n in names) for o in ops], OPERATION)


def rows(df):
    return {r["id"]: (r["embedding"], untagged_map(r["metadata"]), r["document"], r["seq"]) for r in df.collect()}


def test_fold_equals_replay(spark):
    rng = random.Random(8)
    for n in (1, 40, 120):
        ops = some_ops(rng, n)
        log = frame(spark, ops)
        assert rows(fold(log)) == replay(ops)
        assert rows(fold_onto(fold(log.where(F.col("seq") <= n // 2)), log.where(F.col("seq") > n // 2))) == replay(ops)


def test_log_append_range_prune_recover(spark, tmp_path):
    log = OpLog(spark, str(tmp_path / "log"))
    ops = [{"id": f"d{i}", "op": "add", "embedding": [float(i)]} for i in range(5)]
    assert log.append(ops[:3]) == 3 and log.append(ops[3:]) == 5 and log.append([]) == 5
    seqs = lambda df: sorted(r["seq"] for r in df.collect())
    assert seqs(log.read()) == [1, 2, 3, 4, 5] and seqs(log.read(3)) == [3, 4, 5] and seqs(log.read(10)) == [] and seqs(log.read(4, 2)) == []
    again = OpLog(spark, str(tmp_path / "log"))
    assert again.last_seq == 5 and again.recover() == 0
    again.prune(2)
    assert seqs(again.read()) == [3, 4, 5] and again.recover() == 0
    bulk = spark.createDataFrame([(f"b{i}", i) for i in range(100)], "id string, n int").select("id", "n", F.lit(None).cast("array<float>").alias("embedding"), F.lit(None).cast(OPERATION["metadata"].dataType).alias("metadata"), F.lit("x").alias("document"), F.lit("upsert").alias("op"))
    assert again.append_frame(bulk.repartition(7), "n") == 105
    assert [r["id"] for r in again.read(6).orderBy("seq").collect()] == [f"b{i}" for i in range(100)]
    # the last batch is lost: the prefix before it stays
    Store(spark, str(tmp_path / "log")).delete(again._state["batches"][-1]["path"])
    assert again.recover() == 100 and again.last_seq == 5


def test_fencing_cuts_older_epochs(spark, tmp_path):
    log = OpLog(spark, str(tmp_path / "log"), epoch=3)
    log.append([{"id": "a", "op": "add"}])
    log.epoch = 2
    log.append([{"id": "b", "op": "add"}])
    assert log.recover() == 1 and log.last_seq == 1


def test_snapshots_survive_damage(spark, tmp_path):
    log = OpLog(spark, str(tmp_path / "log"))
    log.append([{"id": f"c{i}", "op": "add", "embedding": [1.0]} for i in range(4)])
    assert log.checkpoint() == 4 == log.checkpoint()
    log.append([{"id": "c0", "op": "delete"}])
    log.checkpoint()
    log.append([{"id": "c9", "op": "update", "document": "only metadata"}])
    want = rows(log.records())
    assert set(want) == {"c1", "c2", "c3", "c9"} and want["c9"][0] is None
    log.store.delete(log._state["snapshots"][-1]["path"])
    assert rows(OpLog(spark, str(tmp_path / "log")).records()) == want
    log.store.delete(log._state["snapshots"][0]["path"])
    log._commit(lambda state: {**state, "kept_from": 4})
    with pytest.raises(CorruptionError):
        log.records()


def test_opening_cuts_a_damaged_tail(spark, tmp_path):
    log = OpLog(spark, str(tmp_path / "log"))
    for i in range(3):
        log.append([{"id": f"c{i}", "op": "add", "embedding": [1.0]}, {"id": f"x{i}", "op": "add", "embedding": [1.0]}])
    for file in (tmp_path / "log" / log._state["batches"][1]["path"]).glob("*.parquet"):
        file.write_bytes(file.read_bytes()[:-20])
    again = OpLog(spark, str(tmp_path / "log"))
    assert again.last_seq == 2 and set(rows(again.records())) == {"c0", "x0"}
    assert again.append([{"id": "n", "op": "add", "embedding": [1.0]}]) == 3


def test_pruned_operations_are_not_silently_missing(spark, tmp_path):
    log = OpLog(spark, str(tmp_path / "log"))
    log.append([{"id": f"c{i}", "op": "add", "embedding": [1.0]} for i in range(4)])
    log.prune(2)
    for first in (1, 2):
        with pytest.raises(PrunedError):
            log.read(first)
    assert log.read(3).count() == 2 and log.read().count() == 2


def test_two_handles_lose_nothing(spark, tmp_path):
    a, b = OpLog(spark, str(tmp_path / "log")), OpLog(spark, str(tmp_path / "log"))
    assert a.append([{"id": "p", "op": "upsert", "embedding": [1.0]}]) == 1
    assert b.append([{"id": "q", "op": "upsert", "embedding": [1.0]}]) == 2
    with pytest.raises(Moved):
        a.append([{"id": "r", "op": "upsert"}], after=1)
    assert set(rows(a.refresh().records())) == {"p", "q"} and [r["seq"] for r in a.read().orderBy("seq").collect()] == [1, 2]


def test_threads_with_handles_of_their_own(engine):
    c = engine.create_collection("c", options=IndexOptions(sync_threshold=30, batch_size=20))
    c.add(["seed"], [[0, 0]])
    c.build_index(1)
    failures, doubles = [], []

    def work(n):
        try:
            own = Engine(engine.spark, engine.store.root).collection("c")
            for turn in range(5):
                own.add([f"t{n}-{turn}-{i}" for i in range(5)], [[n + 1, i] for i in range(5)], [{"n": n}] * 5)
                try:
                    own.add([f"shared{turn}"], [[9, 9]])
                    doubles.append(turn)
                except AlreadyExistsError:
                    pass
                found = own.query([[n + 1, 0]], 3, {"n": n}).collect()
                assert {r["id"].split("-")[0] for r in found} == {f"t{n}"}
        except Exception as error:  # noqa: BLE001
            failures.append(error)

    threads = [threading.Thread(target=work, args=(n,)) for n in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failures
    assert sorted(doubles) == list(range(5))  # one of four got each shared id
    assert engine.collection("c").count() == 1 + 100 + 5
    seqs = sorted(r["seq"] for r in c.records().collect())
    assert seqs == list(range(1, 107)) and c.log.last_seq == 106


def test_catalogs_of_two_handles_agree(engine):
    a, b = engine.catalog, Engine(engine.spark, engine.store.root).catalog
    a.create_tenant("one")
    b.create_tenant("two")
    a.create_database("two", "d")
    with pytest.raises(AlreadyExistsError):
        b.create_database("two", "d")
    c = engine.create_collection("c")
    b.update_dimension(c.config.id, 3)
    with pytest.raises(ValidationError):
        a.update_dimension(c.config.id, 4)
    with pytest.raises(ValidationError):
        c.add(["a"], [[1, 2]])  # a handle that doesn't know the dimension yet
    assert c.count() == 0


def test_index_outlives_checkpoints_and_handles(engine):
    c = engine.create_collection("t", 2, "l2", options=IndexOptions(max_scan=5, batch_size=4))
    c.add([f"e{i:02d}" for i in range(40)], [[i, 0] for i in range(40)])
    c.build_index(5)
    ids = lambda at, q, k=2: [r["id"] for r in at.query([q], k, ef=1000).orderBy("rank").collect()]
    for turn in range(3):
        c.upsert([f"e{turn:02d}"], [[100 + turn, 0]])
        c.checkpoint()
        assert ids(c, [100 + turn, 0], 1) == [f"e{turn:02d}"]
    again = Engine(engine.spark, engine.store.root).collection("t")
    assert again.index() is not None and again.committed_count() == 40 and again.flushed_seq() == 43
    assert ids(again, [0, 0]) == ["e03", "e04"] and ids(again, [101, 0], 1) == ["e01"]
    again.delete(["e03"])
    assert ids(c, [0, 0]) == ["e04", "e05"]  # written by another handle, not yet in the index
    # damage: searches go on exactly, and the next flush builds the index anew
    engine.store.delete(f"{c.config.id}/index")
    last = Engine(engine.spark, engine.store.root).collection("t")
    assert last.index() is None and ids(last, [0, 0]) == ["e04", "e05"]
    assert last.flush(force=True) and last.committed_count() == 39


def test_bulk_writes(engine, spark):
    c = engine.create_collection("b")
    frame_ = lambda rows_: spark.createDataFrame(rows_, "id string, embedding array<float>, metadata map<string,struct<s:string,b:boolean,i:bigint,f:double>>, document string")
    assert c.upsert_frame(frame_([(f"r{i:03d}", [float(i), 1.0], tagged_map({"n": i}), f"d{i}") for i in range(50)])) == 50
    assert c.count() == 50 and c.config.dimension == 2 and c.get(["r007"]).first()["document"] == "d7"
    assert c.upsert_frame(frame_([])) == 50
    for bad in ([(None, [1.0, 2.0], None, None)], [("", [1.0, 2.0], None, None)], [("x", [1.0], None, None)], [("x", None, None, None)], [("x", [1.0, 2.0], None, None), ("y", [1.0], None, None)]):
        with pytest.raises(ValidationError):
            c.upsert_frame(frame_(bad))
    assert c.count() == 50


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path / "engine"))


def test_writes_and_their_checks(engine):
    c = engine.create_collection("c", space="l2")
    c.add(["a", "b"], [[1, 0], [0, 1]], [{"x": 1}, {"x": "y"}], ["one", "two"])
    assert c.config.dimension == 2 and c.count() == 2
    for bad in (lambda: c.add(["d"], [[1]]), lambda: c.add([], []), lambda: c.add(["d", "d"], [[1, 1]] * 2), lambda: c.add(["d"], [[1, 1], [2, 2]]), lambda: c.add(["x" * 513], [[1, 1]]), lambda: c.upsert(["d"], [[1, 1]], [{"n": None}])):
        with pytest.raises(ValidationError):
            bad()
    with pytest.raises(AlreadyExistsError):
        c.add(["z", "a"], [[1, 1], [1, 1]])
    with pytest.raises(NotFoundError):
        c.update(["a", "nobody"], documents=["x", "y"])
    assert c.count() == 2 and c.log.last_seq == 2
    c.upsert(["a", "a"], [[5, 5], [6, 6]])
    c.update(["b"], documents=["new"])
    c.delete(["nobody"])
    got = {r["id"]: r for r in c.get(None, include=("embeddings",)).collect()}
    assert got["a"]["embedding"] == [6, 6] and got["a"]["metadata"] is None and got["a"]["document"] is None
    assert got["b"]["embedding"] == [0, 1] and got["b"]["metadata"] is None and got["b"]["document"] == "new"
    asked = c.get(["b", "nobody", "b"]).collect()
    assert [(r["id"], r["found"]) for r in asked] == [("b", True), ("nobody", False), ("b", True)]
    assert Engine(engine.spark, engine.store.root).collection("c").count() == 2


def test_query_filters_index_checkpoint(engine):
    c = engine.create_collection("t", 2, "l2", options=IndexOptions(max_scan=5))
    c.add([f"e{i:02d}" for i in range(30)], [[i, 0] for i in range(30)], [{"tag": "abc"[i % 3], "score": i} for i in range(30)], [f"doc {i}" for i in range(30)])
    ids = lambda df: [r["id"] for r in df.orderBy("query_id", "rank").collect()]
    assert ids(c.query([[0, 0]], 3)) == ["e00", "e01", "e02"]
    assert ids(c.query([[0, 0], [29, 0]], 2, {"tag": "b"})) == ["e01", "e04", "e28", "e25"]
    assert ids(c.query([[0, 0]], 50, {"score": {"$gt": 27}})) == ["e28", "e29"]
    assert set(c.query([[0, 0]], 1, include=("distances", "documents", "metadatas")).columns) == {"query_id", "rank", "id", "distance", "document", "metadata"}
    c.build_index(5)
    c.upsert(["e00"], [[100, 0]], [{"tag": "z"}])
    assert ids(c.query([[0, 0]], 2, ef=1000)) == ["e01", "e02"] and ids(c.query([[100, 0]], 1, ef=1000)) == ["e00"]
    assert ids(c.query([[0, 0]], 2, {"tag": "a"}, ef=1000, oversampling=9)) == ["e03", "e06"]
    assert c.checkpoint() == 31 and c.count() == 30 and c.committed_count() == 30 and c.flushed_seq() == 31
    stats = c.optimize()
    assert stats.records == stats.indexed == c.indexed_count() == 30
    assert ids(c.query([[0, 0]], 1)) == ["e01"]
    for bad in (lambda: c.query([], 1), lambda: c.query([[0, 0]] * 101, 1), lambda: c.query([[0, 0]], 1001), lambda: c.query([[0]], 1)):
        with pytest.raises(ValidationError):
            bad()


def test_auto_checkpoint(engine):
    c = engine.create_collection("auto", options=IndexOptions(sync_threshold=3))
    c.add(["a", "b"], [[1], [2]])
    assert c.log.snapshot_seq == 0
    c.add(["c"], [[3]])
    assert c.log.snapshot_seq == 3 and c.count() == 3


def test_catalog(engine):
    with pytest.raises(ValidationError):
        engine.create_collection("")
    c = engine.create_collection("one", metadata={"k": 1})
    with pytest.raises(AlreadyExistsError):
        engine.create_collection("one")
    assert engine.create_collection("one", get=True).config.id == c.config.id == engine.collection(c.config.id).config.id
    with pytest.raises(NotFoundError):
        engine.catalog.create_database("nobody", "d")
    engine.catalog.create_tenant("t")
    engine.catalog.create_database("t", "d")
    engine.create_collection("one", tenant="t", database="d")
    assert len(engine.list_collections()) == 2 and len(engine.list_collections("t", "d")) == 1
    assert engine.catalog.advance(c.config.id, 9) == 9 == engine.catalog.advance(c.config.id, 3)
    engine.catalog.update_metadata(c.config.id, {"k": 2})
    assert Engine(engine.spark, engine.store.root).collection("one").config.metadata == {"k": 2}
    assert engine.catalog.frame().count() == 2
    engine.delete_collection("one")
    with pytest.raises(NotFoundError):
        engine.collection("one")


def test_snapshot_and_restore(engine, tmp_path):
    c = engine.create_collection("s")
    c.add(["a", "b"], [[1], [2]])
    engine.snapshot(str(tmp_path / "backup"))
    c.delete(["a"])
    engine.restore(str(tmp_path / "backup"))
    again = engine.collection("s")
    assert again.count() == 2 and again.log.last_seq == 2
    again.add(["d"], [[3]])
    assert again.log.last_seq == 3 and again.count() == 3


def test_delta_reaches_a_follower(engine, tmp_path):
    c = engine.create_collection("f")
    c.add([f"d{i}" for i in range(5)], [[i] for i in range(5)])
    assert [c.delta(n).count() for n in (1, 3, 10)] == [5, 3, 0]
    follower = Follower(engine.spark, engine.store.path(c.config.id), str(tmp_path / "follower"))
    run = lambda: follower.start(str(tmp_path / "checkpoint"), available_now=True).awaitTermination()
    run()
    assert rows(follower.state()) == rows(c.records())
    c.delete(["d1"])
    c.update(["d2"], documents=["x"])
    run()
    assert rows(follower.state()) == rows(c.records())
    assert rows(c.apply(frame(engine.spark, [{"id": "d0", "op": "delete", "seq": 99, "epoch": 0, "embedding": None, "metadata": None, "document": None}]))).keys() == {"d2", "d3", "d4"}


def test_late_follower_starts_from_the_snapshot(engine, tmp_path):
    c = engine.create_collection("f")
    for i in range(3):
        c.upsert([f"d{i}", "x"], [[i], [i]])
        c.checkpoint()
    with pytest.raises(PrunedError):
        c.delta(1)
    follower = Follower(engine.spark, engine.store.path(c.config.id), str(tmp_path / "follower"), buckets=4)
    assert follower.catch_up() == 6 == follower.applied
    assert rows(follower.state()) == rows(c.records()) and set(rows(follower.state())) == {"d0", "d1", "d2", "x"}
    c.delete(["d0"])
    before = follower._pointer()["paths"]
    assert follower.catch_up() == 7 and rows(follower.state()) == rows(c.records())
    after = follower._pointer()["paths"]
    assert sum(before.get(b) != after.get(b) for b in {*before, *after}) == 1  # only the bucket that was touched
    # a rewritten log brings nothing deleted back
    c.upsert(["z"], [[1]])
    c.log.prune(7)
    assert follower.catch_up() == 8 and set(rows(follower.state())) == {"d1", "d2", "x", "z"}


def test_follower_stops_at_an_older_epoch(spark, tmp_path):
    log = OpLog(spark, str(tmp_path / "log"), epoch=1)
    log.append([{"id": "a", "op": "upsert", "embedding": [1.0]}])
    log.epoch = 0
    log.append([{"id": "b", "op": "upsert", "embedding": [1.0]}])
    log.epoch = 1
    log.append([{"id": "c", "op": "upsert", "embedding": [1.0]}])
    follower = Follower(spark, str(tmp_path / "log"), str(tmp_path / "follower"), epoch=1)
    assert follower.catch_up() == 1 and set(rows(follower.state())) == {"a"}
    with pytest.raises(FencedError):
        follower.catch_up()


def test_query_language(engine):
    engine.sql("CREATE COLLECTION books")
    c = engine.collection("books")
    c.add(["a", "b", "c"], [[1, 0], [0, 1], [1, 1]], [{"n": 1}, {"n": 2, "t": "x where y"}, {"n": 3}], ["one", "two", "three"])
    c = engine.collection("books")
    assert engine.sql("select count(*) from books;").first()[0] == 3
    ids = lambda text, current=None: [r["id"] for r in engine.sql(text, current).collect()]
    assert ids("SELECT id FROM books LIMIT 2") == ["a", "b"]
    assert ids("SELECT * FROM * WHERE n <> 2", "books") == ["a", "c"]
    assert ids("SELECT * FROM books WHERE t = 'x where y'") == ["b"]
    assert ids('SELECT * FROM books WHERE {"n": {"$in": [1, 3]}} NEAREST TO [1, 1] LIMIT 1') == ["c"]
    assert ids("SELECT id, distance FROM books NEAREST TO [0, 1] WHERE n >= 2 LIMIT 2") == ["b", "c"]
    assert engine.sql("SELECT id, document FROM books").columns == ["id", "document"]
    with pytest.raises(SqlError):
        engine.sql("SELECT * FROM *")


def test_parser():
    assert parse("create collection x") == Create("x")
    assert parse("SELECT COUNT(*) FROM x") == Count("x")
    assert parse("SELECT * FROM x NEAREST TO [1,2] LIMIT 3 VERTICAL") == Select("x", None, None, (1.0, 2.0), 3, True)
    for bad in ("DROP x", "SELECT FROM x", "SELECT * FROM x LIMIT y", "SELECT * FROM x WHERE a ~ 1", "SELECT * FROM x NEAREST TO [a]", "SELECT * FROM x NEAREST TO [1", "SELECT * FROM x HAVING", "SELECT nope FROM x", "SELECT * FROM"):
        with pytest.raises(ValidationError):
            parse(bad)


def test_rendering(spark):
    df = spark.createDataFrame([("a", 0.123456, "x" * 50), ("b", None, None)], "id string, distance double, document string")
    table = render(df)
    assert "0.1235" in table and "x" * 37 + "..." in table and table.endswith("2 rows in set")
    assert render(df, "csv").splitlines()[1] == "a,0.1235," + "x" * 50
    assert '"distance": 0.123456' in render(df, "json") and "*** row 2 ***" in render(df, "vertical")
    assert render(df.limit(0)) == "Empty set"


def test_payload_file(spark, tmp_path):
    path = tmp_path / "p.json"
    path.write_text('{"ids": ["a", "b"], "embeddings": [[1, 2], [3, 4]], "metadatas": [{"i": 5, "f": 5.5, "s": "5", "b": true}, null], "documents": ["x", null]}')
    got = {r["id"]: r for r in read_payload(spark, str(path)).collect()}
    assert untagged_map(got["a"]["metadata"]) == {"i": 5, "f": 5.5, "s": "5", "b": True} and isinstance(untagged_map(got["a"]["metadata"])["i"], int)
    assert got["b"]["metadata"] is None and got["b"]["embedding"] == [3, 4] and got["b"]["document"] is None
