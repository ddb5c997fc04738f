"""Operators over whole tables, against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.llm import common, linededup, simhash, spotsigs, toxicity, warc


def union_find(n, pairs):
    up = list(range(n))

    def find(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(9)
    n = 400
    pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(260)] + [(i, i + 1) for i in range(300, 360)] + [(5, 5)]
    root = union_find(n, pairs)
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: root[i] for p in pairs if p[0] != p[1] for i in p}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_groups(ids, fps, radius=3):
    order = np.argsort(ids)
    f = np.array(fps, np.uint64)[order]
    root = union_find(len(f), [(i, i + 1 + int(j)) for i in range(len(f)) for j in np.flatnonzero(np.bitwise_count(f[i + 1 :] ^ f[i]) <= radius)])
    return {ids[order[i]]: ids[order[root[i]]] for i in range(len(f))}


def test_near_duplicates(docs, rows, clashing, make):
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(clashing).collect()}
    assert got == plain_groups([r[0] for r in rows], [simhash.fingerprint(r[1]) for r in rows])
    keep = lambda df: simhash.keep_one(df, simhash.near_duplicates(df))
    assert sorted(r["doc_id"] for r in keep(docs).collect()) == sorted(set(got.values())) and keep(clashing).columns == clashing.columns
    odd = make([(1, "a b c"), (1, "a b c"), (None, "x y z"), (None, "x y z"), (2, None), (3, "")])
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in keep(odd).collect()) == [(False, 1), (False, 2), (True, None)]
    assert simhash.near_duplicates(make([])).count() == 0


def test_simhash_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/documents.parquet").collect()
    fps = [simhash.fingerprint(r["text"]) for r in rows]
    want = plain_groups([r["doc_id"] for r in rows], fps)
    got = simhash.op3_simhash(spark, folder).collect()
    assert sorted(map(tuple, got)) == sorted((r["doc_id"], f"{fp:016x}", want[r["doc_id"]]) for r, fp in zip(rows, fps))


@pytest.mark.parametrize("bucket", [4096, 64, 4, 1])
def test_links_join_all_pairs_within_the_radius(spark, bucket):
    """A dense group, pairs at each distance, and noise; small buckets are divided."""
    rng = random.Random(12)
    center = rng.getrandbits(64)
    fps = {center} | {center ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3))) for _ in range(60)}
    for _ in range(40):
        x = rng.getrandbits(64)
        fps |= {x, x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5)))}
    fps = sorted(fps)
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    root = {r["node"] & (1 << 64) - 1: r["root"] & (1 << 64) - 1 for r in common.components(simhash.links(df, bucket=bucket)).collect()}
    want = plain_groups(fps, fps)
    groups = {}
    for f in fps:
        groups.setdefault(want[f], set()).add(f)
    assert {frozenset(g) for g in groups.values() if len(g) > 1} == {frozenset(f for f in root if root[f] == r) for r in set(root.values())}


def test_masks_cover_every_near_pair():
    rng = random.Random(1)
    for rows in (10, 1 << 26, 1 << 33, 1 << 40):
        masks = simhash.first_masks(rows)
        for _ in range(200):
            diff = sum(1 << b for b in rng.sample(range(64), 3))
            assert any(not m & diff for m in masks)
            m = next(m for m in masks if not m & diff)
            assert any(not x & diff for x in simhash.finer_masks(m))


def plain_dedup(rows, min_words):
    """Every run of lines of so many words that stands earlier, by all pairs of suffixes."""
    suffixes = []
    for id, text in rows:
        lines = [(i, x) for i, x in enumerate((text or "").encode().split(b"\n")) if x.split()]
        suffixes += [(id, p, lines) for p in range(len(lines))]
    gone = {id: set() for id, _ in rows}
    for k, (id, p, lines) in enumerate(suffixes):
        for _, q, before in suffixes[:k]:
            n = 0
            while p + n < len(lines) and q + n < len(before) and lines[p + n][1] == before[q + n][1]:
                n += 1
            if sum(len(x.split()) for _, x in lines[p : p + n]) >= min_words:
                gone[id] |= set(range(lines[p][0], lines[p + n - 1][0] + 1))
    return {id: None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone[id]) for id, text in rows}


@pytest.mark.parametrize("min_words", [6, 25])
def test_repeated_runs_go(make, min_words):
    rng = random.Random(min_words)
    line = lambda: " ".join(rng.choice("abcdefgh") + str(rng.randint(0, 3)) for _ in range(rng.randint(1, 6)))
    pool = [line() for _ in range(12)]
    passage = [line() for _ in range(7)]
    rows = []
    for i in range(30):
        lines = [rng.choice(pool) if rng.random() < 0.6 else rng.choice(["", line()]) for _ in range(rng.randint(0, 14))]
        if rng.random() < 0.4:
            lines[3:3] = passage[rng.randint(0, 2) :]
        rows.append((i, "\n".join(lines)))
    rows += [(40, None), (41, ""), (42, "\n\n"), (43, rows[2][1]), (44, "\n".join(["x y"] * 60)), (45, "\n".join([pool[0]] * 5 + passage))]
    got = {r["doc_id"]: r["text"] for r in linededup.deduplicated(make(rows), min_words).collect()}
    assert got == plain_dedup(rows, min_words)


def test_line_dedup_edges(docs, clashing, make):
    out = linededup.deduplicated(clashing)
    assert set(clashing.columns) < set(out.columns) and out.count() == clashing.count()
    text = "\n".join(" ".join(f"w{i}{j}" for j in range(9)) for i in range(6))
    got = [(r["doc_id"], r["text"] == text) for r in linededup.deduplicated(make([(5, text), (5, text), (9, text)])).orderBy("doc_id").collect()]
    assert got == [(5, True), (5, True), (9, False)]
    assert linededup.deduplicated(make([])).count() == 0


def plain_signatures(text):
    import re

    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())
    content = [i for i, x in enumerate(w) if x not in spotsigs.ANCHORS]
    out = []
    for k, p in enumerate(content):
        rest = [w[i] for i in content[k : k + 2]]
        out += [" ".join([w[i], *rest]) for i in range(content[k - 1] + 1 if k else 0, p)]
    if not out:
        out = [" ".join(w[i] for i in content[k : k + 3]) for k in range(len(content))] or ([" ".join(w)] if w else [])
    return sorted({hashlib.md5(x.encode()).hexdigest()[:16] for x in out})


def jaccard(a, b):
    a, b = set(a), set(b)
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def test_spotsigs(spark, docs, rows, clashing, make):
    text = {r[0]: r[1] or "" for r in rows}
    ids = sorted(text, reverse=True)
    for df in (docs, clashing, docs.repartition(7)):
        got = {r["doc_id"]: r for r in spotsigs.fingerprints(df).collect()}
        assert set(got) == set(text)
        for i, id in enumerate(ids):
            after, third = ids[(i + 1) % len(ids)], len(text[id]) // 3
            edited = text[id][: len(text[id]) - third] + text[after][:third]
            assert got[id]["edited"] == edited and got[id]["signatures"] == plain_signatures(text[id])
            assert got[id]["edited_signatures"] == plain_signatures(edited) and got[id]["next_signatures"] == plain_signatures(text[after])
    one = spotsigs.fingerprints(make([(7, "a lone text of the kind")])).first()
    assert one["edited"] == "a lone text of t" + "a lone " and one["next_signatures"] == one["signatures"]
    assert spotsigs.fingerprints(make([])).count() == 0
    assert spotsigs.fingerprints(make([(None, "x"), (None, "y"), (1, "z")])).count() == 3


def test_spotsigs_classes(make, clashing, rows):
    """Components of all pairs that are alike enough, by comparing all with all."""
    rng = random.Random(3)
    base = [" ".join(rng.choice(["the", "of", "and", *[f"w{i}" for i in range(60)]]) for _ in range(rng.randint(5, 80))) for _ in range(25)]
    texts = base + [t + " tail" for t in base] + [t.replace("w1 ", "") for t in base] + base[:4] + ["", "", None, "the of", "of the"]
    common_ = "the lorem ipsum of dolor sit and amet consectetur"
    texts += [f"{common_} the {a} {b} of {b} {a}" for a in ("x", "y") for b in ("u", "v", "w")]
    cases = [(make(list(enumerate(texts))), list(enumerate(texts))), (clashing, [r[:2] for r in rows])]
    for df, told in cases:
        ids, sets = [i for i, _ in told], [plain_signatures(t) for _, t in told]
        order = sorted(range(len(ids)), key=lambda k: ids[k])
        root = union_find(len(ids), [(x, y) for x in range(len(ids)) for y in range(x) if sets[order[x]] == sets[order[y]] or (sets[order[x]] and sets[order[y]] and jaccard(sets[order[x]], sets[order[y]]) >= 0.8)])
        got = {r["doc_id"]: r for r in spotsigs.near_classes(df).collect()}
        assert {i: got[i]["near_id"] for i in ids} == {ids[order[k]]: ids[order[root[k]]] for k in range(len(ids))}
        first = {}
        for k in order:
            first.setdefault(tuple(sets[k]), ids[k])
        assert {i: got[i]["class_id"] for i in ids} == {ids[k]: first[tuple(sets[k])] for k in range(len(ids))}
    assert spotsigs.near_classes(make([])).count() == 0
    assert sorted(((r["doc_id"] is None, r["near_id"]) for r in spotsigs.near_classes(make([(None, "x y z"), (4, "x y z"), (4, "a b c"), (None, None)])).collect()), key=repr) == sorted([(False, 4), (False, 4), (True, None), (True, 4)], key=repr)


def test_spotsigs_classes_find_the_words_of_a_text_once(make):
    """No step on the way to a class may find the words of a text again for each of its words."""
    plan = spotsigs.classes(make([(1, "the lorem ipsum dolor"), (2, "x")]))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan


def test_toxicity(spark, make):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("aeioutnsr") for _ in range(rng.randint(2, 8)))
    bad = ["zzgrob", "zzfies", "zzdumm"]
    rows, labels = [], []
    for i in range(900):
        w = [word() for _ in range(rng.randint(5, 60))]
        toxic = int(rng.random() < 0.2)
        for _ in range(rng.randint(1, 3) if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w)))
        if i % 2:
            labels.append((i, 1, toxic))
    rows += [(1000, None), (1001, ""), (1002, "zzgrob zzdumm"), (1003, "zzgrob " + "word " * 20_000)]
    told = spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(make(rows), told).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    wrong = [i for i, t in rows if (got[i] >= 0.5) != any(b in (t or "") for b in bad)]
    assert len(wrong) <= 0.02 * len(rows)
    assert got[1000] == got[1001] < 0.5 < got[1002]
    # labels of held-out rows are never learnt from
    import zlib

    flipped = spark.createDataFrame([(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels], "doc_id long, quality int, toxic int")
    assert {r["doc_id"]: r["score"] for r in toxicity.scored(make(rows), flipped).collect()} == got
    assert {r["score"] for r in toxicity.scored(make(rows), told.limit(0)).collect()} == {0.0}
    assert toxicity.scored(make([]), told).count() == 0
    odd = make(rows).selectExpr("*", "1 as votes", "2 as score", "3 as toxic", "4 as n", "5 as v", "6 as voters")
    assert {r["doc_id"]: r["score"] for r in toxicity.scored(odd, told).collect()} == got
    kept = toxicity.accepted(odd, told)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {i for i, x in got.items() if x < 0.5}


def test_warc_round_trip(spark):
    html = ["<p>" + "x" * 200, "<p>" + "x" * 200, "short", "short", None, "", "é" * 60, "é" * 60, "\r\n\r\n" * 40, "<b>" + "y" * 100_000, "<p>" + "x" * 200]
    rows = [(20 - i, f"http://e/{i}\r\nX: y", h) for i, h in enumerate(html)] + [(None, None, html[0]), (10, "again", html[10])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).repartition(3)
    index = warc.write(pages)
    got = warc.read(index).collect()
    first = {}
    for id, _, h in rows:
        if id is not None and h and len(h.encode()) >= 100:
            first[h] = min(id, first.get(h, id))
    want = sorted((id, None if (r := first.get(h or "")) is None or r == id else r) for id, _, h in rows if id is not None)
    assert sorted((r["page_id"], r["refers_to"]) for r in got if r["page_id"] is not None) == want
    text = {id: h or "" for id, _, h in rows}
    for r in got:
        assert (r["record_type"] == "revisit") == (r["refers_to"] is not None) == (r["payload"] is None)
        body = text[r["page_id"]].encode()
        assert r["declared_bytes"] == len(body) and r["declared_digest"] == hashlib.sha256(body).hexdigest()
        assert r["payload"] in (None, text[r["page_id"]])
    some = warc.read(index.where("page_id in (11, 20, 16)")).collect()
    assert sorted(r["page_id"] for r in some) == [11, 16, 20]
    assert warc.read(warc.write(pages.limit(0))).count() == 0


def test_archives_are_plain_gzip_members(spark):
    import gzip
    from pathlib import Path

    index = warc.write(spark.createDataFrame([(1, "u", "a" * 150), (2, "v", "b")], "page_id long, url string, html string").coalesce(1)).orderBy("offset").collect()
    raw = gzip.decompress(Path(index[0]["file"]).read_bytes())
    assert raw.count(b"WARC/1.1\r\n") == 2 and b"a" * 150 in raw
    assert index[1]["offset"] == index[0]["length"]


def test_spotsigs_anchored_chains_are_found_once(make):
    """A lambda expression that is named twice in a projection is evaluated twice."""
    rows = spotsigs.with_signatures(make([(1, "the lorem ipsum dolor")]), "text", "s")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("flatten(transform") == 1 and rows.first()["s"] == plain_signatures("the lorem ipsum dolor")


def test_spotsigs_classes_shuffle_few_signatures(make, monkeypatch):
    """Signatures of one set alone aren't kept with their counts; those of several bring them together."""
    written, plain = [], spotsigs.cut
    monkeypatch.setattr(spotsigs, "cut", lambda df: written.append(plain(df)) or written[-1])
    base = " ".join(f"the w{i} x{i}" for i in range(20))
    got = {r["doc_id"]: r["near_id"] for r in spotsigs.near_classes(make([(1, base), (2, f"{base} the tail end"), (3, "the other text of three")])).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
    often = [t for t in written if t.columns == ["s", "df"]]
    assert len(often) == 1 and {r["df"] for r in often[0].collect()} == {2}
