import pytest

from vecloom.operators.clock import advanced, high_water, unfenced
from vecloom.plans.engine import Engine
from vecloom.plans.requests import Requests, handle, heartbeat, preflight
from vecloom.plans.shell import Shell
from vecloom.types import IndexOptions


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path / "engine"))


def test_requests(engine):
    r = Requests(engine)
    made = r.create({"name": "c", "space": "l2"})
    assert r.create({"name": "c", "get_or_create": True})["id"] == made["id"] and r.describe("c")["dimension"] is None
    assert handle(r.create, {"name": "c"})[0] == 409 and handle(r.create, {"name": ""})[0] == 400 and handle(r.describe, "no")[0] == 404
    assert handle(r.add, "c", {"ids": []})[0] == 400
    shelf = [("dune", [0, 3], {"pages": 412, "genre": "novel"}, "sand"), ("emma", [4, 0], {"pages": 474}, None), ("ilias", [5, 1], {"genre": "epic", "pages": 700}, "wrath"), ("odes", [9, 9], None, "short")]
    ids, vectors, metadatas, documents = (list(x) for x in zip(*shelf))
    assert r.add(made["id"], {"ids": ids, "embeddings": vectors, "metadatas": metadatas, "documents": documents}) == {"seq": 4}
    assert r.count("c") == 4
    assert r.query("c", {"query_embeddings": [[5, 0]]}) == {"ids": [["emma", "ilias", "dune", "odes"]]}
    got = r.query("c", {"query_embeddings": [[5, 0], [0, 0]], "n_results": 2, "where": {"pages": {"$gt": 450}}, "include": ["distances", "metadatas", "documents"]})
    assert got == {"ids": [["emma", "ilias"], ["emma", "ilias"]], "distances": [[1.0, 1.0], [16.0, 26.0]], "metadatas": [[metadatas[1], metadatas[2]]] * 2, "documents": [[None, "wrath"]] * 2}
    assert r.query("c", {"query_embeddings": [[1, 1]], "where_filter": {"genre": "essay"}, "include": ["distances"]}) == {"ids": [[]], "distances": [[]]}
    assert handle(r.query, "c", {"query_embeddings": [[0, 0]], "include": ["nothing"]})[0] == 400
    assert handle(r.query, "c", {"query_embeddings": [[0, 0]], "where": {"a": {"$bad": 1}}})[0] == 400
    r.update("c", {"ids": ["dune"], "documents": ["spice"]})
    assert r.get("c", {"ids": ["dune", "none", "dune"], "include": ["embeddings"]}) == {"ids": ["dune", "dune"], "metadatas": [None, None], "documents": ["spice", "spice"], "embeddings": [[0.0, 3.0]] * 2}
    assert r.get("c", {"where": {"pages": {"$gte": 474, "$lt": 700}}})["ids"] == ["emma"] and r.get("c", {"limit": 2})["ids"] == ["dune", "emma"]
    r.upsert("c", {"ids": ["odes"], "embeddings": [[5, 5]]})
    r.delete("c", {"ids": ["dune", "emma", "never"]})
    assert r.get("c", {}) == {"ids": ["ilias", "odes"], "metadatas": [metadatas[2], None], "documents": ["wrath", None]}
    assert [c["name"] for c in r.list()] == ["c"] and r.list({"offset": 1}) == []
    r.drop("c")
    assert handle(r.count, "c")[0] == 404 and heartbeat() and preflight()["max_batch_size"] == 10_000


def test_shell(engine, tmp_path):
    said = []
    shell = Shell(engine, said.append)
    for line in ("\\create c", "\\use c", "SELECT COUNT(*) FROM *", "\\format csv", "SELECT * FROM c", "\\d", "\\d c", "\\x", "SELECT COUNT(*) FROM c", "\\timing", "SELECT COUNT(*) FROM c VERTICAL", "", "\\nope", "DROP c", "\\help"):
        shell.line(line)
    assert "| 0 " in said[0] and said[1] == "id,metadata,document\n" and said[2].startswith("name,dimension") and "space: l2" in said[3] and "row 1" in said[4]
    assert [s for s in said if s.startswith("error")][1:] == ["error: unknown command \\nope", said[-2]]
    script = tmp_path / "script"
    script.write_text("\\format json\nSELECT COUNT(*) FROM c\n")
    shell.line(f"\\o {tmp_path / 'out'}")
    shell.line(f"\\i {script}")
    shell.line("\\o")
    assert '"count": 0' in (tmp_path / "out").read_text()
    shell.line("\\drop c")
    shell.line("\\quit")
    assert shell.current is None and not shell.open and not engine.list_collections()


def test_command_line(spark, tmp_path):
    from vecloom.__main__ import main

    said = []
    payload = tmp_path / "p.json"
    payload.write_text('{"ids": ["a", "b"], "embeddings": [[1, 2], [3, 4]], "metadatas": [{"n": 1}, null], "documents": ["x", null]}')
    assert main([str(tmp_path / "e"), "--load", "c", str(payload), "--format", "csv", "-c", "SELECT COUNT(*) FROM c", "-c", "SELECT id FROM c NEAREST TO [3, 4] LIMIT 1"], spark, said.append) == 0
    assert [x.split("\n")[1] for x in said] == ["2", "b"]
    assert main([str(tmp_path / "e"), "-c", "SELECT * FROM nothing"], spark, said.append) == 1


def test_flush_brings_the_index_up_to_date(engine):
    c = engine.create_collection("c", 1, "l2", options=IndexOptions(batch_size=3, max_scan=2))
    c.add([f"e{i}" for i in range(10)], [[i] for i in range(10)])
    c.build_index(3)
    c.delete(["e0"])
    assert c.flushed_seq() == 10 and c.committed_count() == 10
    c.upsert(["e1", "n"], [[50], [0]])
    assert c.flushed_seq() == 13 and c.committed_count() == 10
    assert [r["id"] for r in c.query([[0]], 3, ef=1000).orderBy("rank").collect()] == ["n", "e2", "e3"]
    assert not c.flush() and c.flush(force=True)


def test_clocks(spark):
    a = spark.createDataFrame([("n1", 5), ("n2", 3)], "node string, seq long")
    b = spark.createDataFrame([("n1", 4), ("n2", 9), ("n3", 1)], "node string, seq long")
    after = advanced(a, b)
    assert {tuple(r) for r in after.collect()} == {("n1", 5), ("n2", 9), ("n3", 1)} and tuple(high_water(after).first()) == ("n3", 1)
    log = spark.createDataFrame([(1, 2), (2, 2), (3, 1), (4, 2)], "seq long, epoch long")
    assert [r["seq"] for r in unfenced(log, 2).collect()] == [1, 2] and unfenced(log, 0).count() == 4
