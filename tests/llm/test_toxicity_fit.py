import numpy as np
from vecloom.llm import toxicity


def test_every_pattern_counts_beyond_the_drivers_rows(spark, monkeypatch):
    """Many frequent patterns without voter 2, and rare ones in which only it speaks."""
    fit = spark.createDataFrame([([(0, i + 1)], 50, 0.1) for i in range(40)] + [([(1, 1), (2, i + 1)], 1, 0.95) for i in range(10)] + [([], 500, 0.05)], "votes array<struct<v:int,n:int>>, n long, p double")
    blocks = toxicity._blocks(fit.repartition(3)).cache()
    here = toxicity._fitted(blocks, 3, steps=20)
    monkeypatch.setattr(toxicity, "FIT_ROWS", 40)
    there = toxicity._fitted(blocks, 3, steps=20)
    assert np.allclose(here[0], there[0]) and np.isclose(here[1], there[1])
    assert there[0][2] > 0


def test_scores_do_not_depend_on_the_limit(spark, make, monkeypatch):
    rows = [(i, " ".join(["plain", "words"] + ["zzgrob"] * (i % 3 == 0) + [f"zzgrob{'x' * j}" for j in range(i % 7) if i % 3 == 0])) for i in range(120)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(120)], "doc_id long, quality int, toxic int")
    fitted = toxicity._fitted
    monkeypatch.setattr(toxicity, "_fitted", lambda *a: fitted(*a, steps=10))
    all_ = {r["doc_id"]: r["score"] for r in toxicity.scored(make(rows), labels).collect()}
    monkeypatch.setattr(toxicity, "FIT_ROWS", 2)
    few = {r["doc_id"]: r["score"] for r in toxicity.scored(make(rows), labels).collect()}
    assert all(abs(all_[i] - few[i]) < 1e-9 for i in all_)
