import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vecloom.llm import linededup, mixing, registry, simhash, toxicity

FOLDER = "/root/testdata/sf0.001"


def test_stages_keep_their_promises(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "simhash_dedup", "mixing", "packing"]
    a = stages["toxicity"](spark, docs, FOLDER).cache()
    score = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, spark.read.parquet(f"{FOLDER}/labels.parquet")).collect()}
    assert {r["doc_id"] for r in a.collect()} == {i for i, s in score.items() if s < 0.5} and a.columns == columns
    b = stages["line_dedup"](spark, a, FOLDER).cache()
    edited = {r["doc_id"]: r["text"] for r in linededup.deduplicated(a).collect()}
    assert b.columns == columns and all(r["text"] == edited[r["doc_id"]] and r["n_chars"] == len(r["text"]) for r in b.collect())
    assert {i for i, t in edited.items() if t.strip()} == {r["doc_id"] for r in b.collect()}
    c = stages["simhash_dedup"](spark, b, FOLDER).cache()
    groups = {r["doc_id"]: r["component_id"] for r in simhash.near_texts(b).collect()}
    assert c.columns == columns and {r["doc_id"] for r in c.collect()} == set(groups.values())
    d = stages["mixing"](spark, c, FOLDER).cache()
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(c).collect() if r["copies"]}
    assert d.columns == columns and {r["doc_id"]: r["count"] for r in d.groupBy("doc_id").count().collect()} == copies
    e = stages["packing"](spark, d, FOLDER)
    assert {r["doc_id"]: r["count"] for r in e.where("piece = 0").groupBy("doc_id").count().collect()} == copies


def test_run_and_empty(spark, tmp_path):
    assert corpus_pipeline.run(spark, FOLDER).count() > 0
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).count() == 0


def test_stages_take_nulls_and_repeats(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    none = docs.limit(1).select(*[F.lit(None).cast(t).alias(c) for c, t in docs.dtypes])
    out = docs.union(docs.limit(3)).union(none).union(none)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, FOLDER)
        assert out.columns == docs.columns
    assert corpus_pipeline.STAGES[-1][1](spark, out, FOLDER).count() > 0


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_its_sql(spark, name):
    got = registry.QUERIES[name](spark, FOLDER)
    rows = got.collect()
    assert rows
    if name not in registry.ORACLES:
        return
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    want = con.execute(registry.ORACLES[name])
    names = [x[0] for x in want.description]
    columns = sorted(got.columns)
    assert sorted(names) == columns
    assert sorted((tuple(r[c] for c in columns) for r in rows), key=repr) == sorted((tuple(r[names.index(c)] for c in columns) for r in want.fetchall()), key=repr)
