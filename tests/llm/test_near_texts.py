import random

import numpy as np
import pytest

import corpus_pipeline
from vecloom.llm import common, shingles, simhash


def plain_sets(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def plain_kept(rows):
    first, up = {}, {}
    for i, t in sorted(rows):
        up[i] = first.setdefault(plain_sets(t), i)
    sets = list(first)
    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x], sets[y]
            if 5 * len(a & b) >= 4 * len(a | b):
                p, q = first[a], first[b]
                while up[p] != p:
                    p = up[p]
                while up[q] != q:
                    q = up[q]
                up[max(p, q)] = min(p, q)
    return {i for i in up if up[i] == i}


def edited(rng, words, n):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def test_near_copies_with_edited_words_go(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        rows += [" ".join(words), *(edited(rng, words, n) for n in (1, 2, 3, 4, 5, 12))]
    rows += ["", None, "two words", "Two  words", "other words"]
    rows = list(enumerate(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_kept(rows)
    assert len(want) < 50
    assert {r["doc_id"] for r in simhash.keep_one(docs).collect()} == want
    assert {r["doc_id"] for r in corpus_pipeline.dedup_near(spark, docs, "").collect()} == want


def test_near_texts_names_components(spark):
    rows = [(7, "a b c d e f"), (3, "a b c d e f"), (None, "x"), (5, "x"), (5, "y"), (5, "y"), (5, "z"), (None, "only null"), (None, "only null")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.near_texts(docs).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["component_id"] or -1) for r in got) == sorted([(False, 7, 3), (False, 3, 3), (True, 0, 5), (False, 5, 5), (False, 5, 5), (False, 5, 5), (False, 5, 5), (True, 0, -1), (True, 0, -1)])
    # one row of each component, also where doc_ids repeat
    assert sorted((r["doc_id"] or -1, r["text"]) for r in simhash.keep_one(docs).collect()) == [(-1, "only null"), (3, "a b c d e f"), (5, "x"), (5, "y"), (5, "z")]


@pytest.mark.parametrize("how", ["texts", "bits"])
def test_repeated_doc_ids_with_other_texts(spark, how):
    a, b = "one two three four five six seven", "quite another text that has its own words"
    docs = spark.createDataFrame([(3, a), (5, a), (5, b)], "doc_id long, text string")
    found = None if how == "texts" else simhash.near_duplicates(docs)
    assert sorted((r["doc_id"], r["text"]) for r in simhash.keep_one(docs, found).collect()) == [(3, a), (5, b)]


def test_clashing_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b", 5), (2, "a b", 6), (3, None, 7)], "doc_id long, text string, n long").selectExpr("*", "1 as key", "2 as root", "3 as id", "4 as band", "5 as fp", "6 as s")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["n"] for r in kept.collect()) == [5, 7]
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_release_deletes_what_is_no_longer_read(spark, tmp_path):
    before = common.mark()
    a, b = common.cut(spark.range(5)), common.cut(spark.range(3))
    common.release(spark, before, b)
    assert b.count() == 3 and common.mark() == before + 1
    with pytest.raises(Exception, match="(?i)exist"):
        spark.read.parquet(a.inputFiles()[0]).count()
    common.release(spark, before)
    assert common.mark() == before


def test_chains_and_groups_around_a_far_smallest_member(spark):
    """Chains: each text is like the next only, so one star a bucket can't link them."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(40):
        rows.append((i, " ".join(words)))
        words[7 * i % 300] = f"v{i}"
        words[(7 * i + 150) % 300] = f"u{i}"
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.keep_one(docs).collect()} == plain_kept(rows)


def test_groups_that_share_bands_without_links_are_ruled_out_by_marks(spark, monkeypatch):
    """120 texts around one, 0.6 to 0.75 alike, with a few linked pairs among them: nearly every pair shares a band."""
    rng = random.Random(6)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    rows = [edited(rng, base, 4) for _ in range(110)]
    rows += [t + " tail" for t in rng.sample(rows, 10)]
    rows = list(enumerate(rows))
    compared, verified = [], shingles.verified
    monkeypatch.setattr(shingles, "verified", lambda near, *rest: compared.append(near.count()) or verified(near, *rest))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_kept(rows)
    assert 100 < len(want) < 120
    assert {r["doc_id"] for r in simhash.keep_one(docs).collect()} == want
    # of 7,140 pairs, only those that marks can't rule out are compared by their shingles
    assert sum(compared) < 200


def test_marks_never_rule_out_a_near_pair():
    rng = np.random.default_rng(7)
    for n in (1, 4, 5, 9, 40, 300, 3000):
        for _ in range(20):
            common_ = rng.integers(0, 1 << 63, n, np.uint64)
            more = rng.integers(0, 1 << 63, n // 4, np.uint64)
            cut_at = rng.integers(0, n // 4 + 1)
            a, b = np.unique(np.concatenate([common_, more[:cut_at]])), np.unique(np.concatenate([common_, more[cut_at:]]))
            both = len(np.intersect1d(a, b))
            assert 5 * both >= 4 * (len(a) + len(b) - both)
            apart = int(np.bitwise_count((shingles.marks(a) ^ shingles.marks(b)).view(np.uint64)).sum())
            assert 9 * apart <= len(a) + len(b)


@pytest.mark.parametrize("bits", [64, 1 << 23])
def test_only_doubtful_texts_are_shuffled(spark, monkeypatch, bits):
    """Whatever the size of the sieve, the result is the same; at its own size it catches the doubtful rows alone."""
    monkeypatch.setattr(common, "SIEVE", bits)
    caught, sieved = [], simhash.sieved

    def counted(rows, key, through, caught_=True, **named):
        got = sieved(rows, key, through, **({"caught": caught_} | named))
        if named.get("caught", caught_):
            caught.append(got.count())
        return got

    monkeypatch.setattr(simhash, "sieved", counted)
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{rng.randrange(5000)}" for _ in range(30))) for i in range(300)]
    rows += [(300 + i, f"{t} end") for i, (_, t) in enumerate(rows[:7])] + [(400, rows[9][1]), (None, rows[11][1]), *rows[20:23]]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = simhash.keep_one(docs).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(300))
    assert len(caught) == 2
    if bits > 64:
        # seven near pairs share bands; seven near copies, two equal texts, and three repeated rows, twice each, are doubtful
        assert caught == [14, 7 + 2 + 6]
