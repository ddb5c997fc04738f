import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.operators.ivf import IvfIndex
from vecloom.queries import QUERIES


def recall(spark, folder, name, eligible):
    got = {(r["query_id"], r["vec_id"]) for r in QUERIES[name](spark, folder).collect()}
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    v = np.array([r["embedding"] for r in rows], float)
    ids, may = np.array([r["vec_id"] for r in rows]), np.array([eligible(r) for r in rows])
    want = set()
    for q in {q for q, _ in got}:
        gap = ((v - v[ids == q][0]) ** 2).sum(axis=1)
        order = np.lexsort((ids, gap.round(6)))
        want |= {(q, int(i)) for i in ids[[o for o in order if may[o]][:10]]}
    return len(got & want) / len(want)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall_is_nineteen_twentieths(spark, sf):
    assert recall(spark, f"/root/testdata/{sf}", "knn_ivf", lambda r: True) >= 0.95
    assert recall(spark, f"/root/testdata/{sf}", "knn_postfilter_ivf", lambda r: r["label"] < 5) >= 0.95


def test_measured_probes_find_most(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(1500, 8)))]
    e = spark.createDataFrame(rows, "id long, embedding array<float>").cache()
    index = IvfIndex.build(e, str(tmp_path / "i"), "l2")
    assert index.nprobe > index.probes(40)
    asked = e.where("id % 30 = 0").select(F.col("id").alias("query_id"), "embedding")
    near, exact = ({(r["query_id"], r["id"]) for r in index.search(asked, 10, n).collect()} for n in (index.nprobe, None))
    assert len(near & exact) >= 0.95 * len(exact)
