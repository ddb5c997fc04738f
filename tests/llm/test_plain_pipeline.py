"""Whole query outputs and the whole pipeline, against plain versions over a small folder."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from test_corpus_operators import plain_dedup
from test_near_texts import plain_kept
from test_plain_operators import BASE, best_fit, plain_licence, plain_mix, plain_pii

import corpus_pipeline
from vecloom.llm import licenses, linededup, pii, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def held_out(id):
    return id is not None and zlib.crc32(str(id).encode()) % 5 == 0


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Texts with toxic words, repeated lines, copies, personal data, licences, odd rows."""
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("aeiounrstl") for _ in range(rng.randint(2, 8)))
    bad, passage = ["zzgrob", "zzfies", "zzdumm"], [" ".join(word() for _ in range(9)) for _ in range(8)]
    rows, labels = [], []
    for i in range(260):
        lines = [" ".join(word() for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(1, 8))]
        toxic = rng.random() < 0.25
        if toxic:
            lines[0] += " " + " ".join(rng.choice(bad) for _ in range(rng.randint(1, 3))) + (" zzfies zzdumm" if rng.random() < 0.5 else "")
        if rng.random() < 0.2:
            lines[1:1] = passage[rng.randint(0, 3) :]
        if rng.random() < 0.1:
            lines.append(rng.choice(["mail a.b@c.org now", "released under the MIT license", "from 10.0.0.1", "call +49 30 1234567"]))
        rows.append((i, "\n".join(lines), "en", f"s{i % 5}" if i % 13 else None, 0))
        if i % 2:
            labels.append((i, 1, int(toxic)))
    rows += [(1000 + i, rows[i][1], "en", "s1", 0) for i in range(0, 60, 3)]
    rows += [(2000 + i, rows[i][1] + " more", "en", "s2", 0) for i in range(0, 60, 4)]
    rows += [(3000, None, "en", "s1", 0), (3001, "", None, "s1", 0), (3002, " \n\t", "en", None, 0), (None, "without an id", "en", "s1", 0), (3003, "word " * 3000, "en", "s3", 0)]
    rng.shuffle(rows)
    at = tmp_path_factory.mktemp("plain")
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at), rows, labels


def plain_votes(text, starts):
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    out = Counter()
    for w in set(words):
        for n in sorted({len(s) for s in starts}):
            if len(w) >= n and w[:n] in starts:
                out[starts.index(w[:n])] += 1
                break
    for i, (_, test) in enumerate(toxicity.PATTERNS, len(starts)):
        if words and test(text, len(words)):
            out[i] = 1
    return out


def plain_lexicon(rows, told):
    counts = {}
    for id, text, *_ in rows:
        if id in told:
            for s in {w[:n] for w in re.findall(r"[^\W\d_]+", (text or "").lower()) for n in range(3, 11) if len(w) >= n}:
                c = counts.setdefault(s, [0, 0])
                c[0] += told[id]
                c[1] += 1
    share = sum(told.values()) / len(told)

    def gain(t, n):
        p = (t + share) / (n + 1)
        return n * (p * math.log2(p / share) + (1 - p) * math.log2((1 - p) / (1 - share)))

    order = sorted(counts, key=lambda s: (-gain(*counts[s]), s))
    chosen, unrelated = [], lambda s: not any(s.startswith(c) or c.startswith(s) for c in chosen)
    holds = {s: [i for i, (id, text, *_) in enumerate(rows) if id in told and any(w.startswith(s) for w in re.findall(r"[^\W\d_]+", (text or "").lower()))] for s in order if counts[s][0] >= 5 and counts[s][0] >= 0.6 * counts[s][1]}
    covered = set()
    for s in list(holds)[: 20 * 96]:
        left = [told[rows[i][0]] for i in holds[s] if i not in covered]
        if len(chosen) < 96 and unrelated(s) and not (left.count(0) >= 2 and left.count(1) < 0.6 * len(left)):
            chosen.append(s)
            covered |= set(holds[s])
    for s in [s for s in order if counts[s][1] * share >= 12 and 4 * counts[s][0] <= counts[s][1] * share][: 20 * 96]:
        if len(chosen) < 112 and unrelated(s):
            chosen.append(s)
    return chosen, share


def plain_scores(rows, labels):
    """The label model over single texts instead of counted patterns, and the classifier."""
    told = {i: t for i, _, t in labels if not held_out(i)}
    starts, share = plain_lexicon(rows, told)
    m = len(starts) + len(toxicity.PATTERNS)
    votes = [plain_votes(r[1], starts) for r in rows]
    spoke = np.array([[float(v in x) for v in range(m)] for x in votes])
    label = np.array([told.get(r[0], -1) for r in rows])
    toxic, clean = (label == 1).astype(float), (label == 0).astype(float)
    rate = lambda n, of: np.clip((n + 0.02) / (of + 1.0), 1e-5, 1 - 1e-5)
    alpha, beta = rate(toxic @ spoke, toxic.sum()), rate(clean @ spoke, clean.sum())
    alone, both = spoke.sum(axis=0), spoke.T @ spoke
    place = {v: i for i, v in enumerate(sorted(range(m), key=lambda v: (-alone[v], v)))}
    parents = []
    for v in range(m):
        best = (0.0, -1)
        for u in range(m):
            e = len(rows) * (share * alpha[u] * alpha[v] + (1 - share) * beta[u] * beta[v])
            if place[u] < place[v] and both[u, v] > 2 * e:
                best = max(best, ((both[u, v] - e) / max(1.0, alone[v]), u))
        parents.append(best[1])
    beside = np.array([[x[v] and parents[v] >= 0 and x[parents[v]] for v in range(m)] for x in spoke]) > 0
    scale = (toxic.sum() + clean.sum()) / len(rows)
    p = None
    for _ in range(toxicity.ROUNDS + 1):
        wt, wc = (toxic, clean) if p is None else (toxic + scale * p, clean + scale * (1 - p))
        logs = np.zeros((2, m))
        for v in range(m):
            up = spoke[:, parents[v]] > 0 if parents[v] >= 0 else np.zeros(len(rows), bool)
            said = spoke[:, v] > 0
            logs[0, v] = math.log(rate(wt[said & ~up].sum(), wt[~up].sum()) / rate(wc[said & ~up].sum(), wc[~up].sum()))
            if parents[v] >= 0:
                a, b, na, nb = wt[said & up].sum(), wc[said & up].sum(), wt[up].sum(), wc[up].sum()
                common = (a + b + 0.5) / (na + nb + 1)
                logs[1, v] = math.log((a + 5 * common) / (na + 5)) - math.log((b + 5 * common) / (nb + 5))
        z = math.log(share / (1 - share)) + (spoke * np.where(beside, logs[1], logs[0])).sum(axis=1)
        p = 1 / (1 + np.exp(-z))
    x = np.array([[1 + math.log(v[k]) if k in v else 0.0 for k in range(m)] for v in votes])
    w, b = np.zeros(m), math.log(p.mean() / (1 - p.mean()))
    norm = 1e-8 + np.sqrt((x * x).mean(axis=0))
    for _ in range(300):
        off = p - 1 / (1 + np.exp(-(x @ w + b)))
        step = (x * off[:, None]).mean(axis=0)
        w = np.clip(w + 4.0 * (step / norm**2 * np.minimum(1.0, norm * 10) - 1e-5 * w), -12, 12)
        b += off.mean()
    z = x @ w + b
    known = label >= 0
    cuts = sorted(set(np.round(z[known], 9)), reverse=True)
    good = [i for i, c in enumerate(cuts) if (label[known & (z >= c - 1e-9)] == 1).mean() >= 0.998]
    if good:
        i = good[-1]
        z = z - max(0.0, (cuts[i] + cuts[i + 1]) / 2 if i + 1 < len(cuts) else cuts[i])
    return dict(zip(range(len(rows)), 1 / (1 + np.exp(-z))))


def test_toxicity_query(spark, folder):
    at, rows, labels = folder
    want = plain_scores(rows, labels)
    got = toxicity.op8_toxicity(spark, at).collect()
    key = lambda id: -1 if id is None else id
    assert sorted(key(r["doc_id"]) for r in got) == sorted(key(r[0]) for r in rows)
    plain = {rows[i][0]: s for i, s in want.items()}
    for r in got:
        assert r["score"] == pytest.approx(plain[r["doc_id"]], abs=2e-3)
        assert r["predicted"] == int(r["score"] >= 0.5) and r["held_out"] is held_out(r["doc_id"])
    text = {r[0]: r[1] or "" for r in rows}
    assert sum((r["score"] >= 0.5) != ("zz" in text[r["doc_id"]]) for r in got) <= 5


def test_linededup_query(spark, folder):
    at, rows, _ = folder
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    after = plain_dedup([r[:2] for r in order], 25)
    want = sorted((-1 if id is None else id, (text or "").count("\n") - (after[id] or "").count("\n"), hashlib.sha256((after[id] or "").encode()).hexdigest()) for id, text, *_ in rows)
    got = linededup.op6_linededup(spark, at).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_deleted"] if r["n_chars"] else r["n_deleted"] - (r["n_deleted"] > 0), r["text_sha256"]) for r in got) == want
    assert any(r["n_deleted"] for r in got)


def test_pii_query(spark, folder):
    at, rows, _ = folder
    want = {}
    for id, text, *_ in rows:
        spans = plain_pii(text or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        want[id] = tuple(sum(s[0] == k for s in spans) for k, _, _ in BASE), hashlib.sha256(joined.encode()).hexdigest(), set(filter(None, joined.split(",")))
    got = pii.op4_pii(spark, at).collect()
    assert len(got) == len(rows)
    for r in got:
        counts, sha, spans = want[r["doc_id"]]
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == counts and r["base_sha256"] == sha
        told = list(filter(None, r["spans"].split(",")))
        assert spans <= set(told) and told == sorted(told, key=lambda s: (pii.KINDS.index(s.split(":")[0]), *map(int, s.split(":")[1:])))
    assert any(sum(x[0]) for x in want.values())


def test_licence_query(spark, folder):
    at, rows, _ = folder
    got = {r["doc_id"]: r for r in licenses.op7_licenses(spark, at).collect()}
    assert len(got) == len(rows)
    for id, text, *_ in rows:
        assert tuple(got[id])[1:6] == plain_licence(text)
        assert set(filter(None, got[id]["base_labels"].split(","))) <= set(filter(None, got[id]["labels"].split(",")))


def test_pipeline(spark, folder):
    """Each stage on all that its predecessor kept, up to the packed sequences."""
    at, rows, labels = folder
    score = plain_scores(rows, labels)
    kept = [r for i, r in enumerate(rows) if score[i] < 0.5]
    assert len(kept) < len(rows)
    order = sorted(kept, key=lambda r: (r[0] is not None, r[0] or 0))
    after = plain_dedup([r[:2] for r in order], 25)
    texts = {r[0]: after[r[0]] for r in kept if (after[r[0]] or "").strip() or after[r[0]] == r[1]}
    assert len(texts) < len(kept)
    first = plain_kept([(-1 if id is None else id, t) for id, t in texts.items() if id is not None])
    # a row without id is no text's first unless it stands alone
    alone = None in texts and len(plain_kept([(i, t) for i, t in enumerate(texts.values())])) > len(first)
    final = {id: t for id, t in texts.items() if id in first or (id is None and alone)}
    assert len(final) < len(texts)
    docs = spark.read.parquet(f"{at}/documents.parquet")
    names, columns = [n for n, _ in corpus_pipeline.STAGES], docs.columns
    assert names == ["toxicity", "line_dedup", "simhash_dedup", "mixing", "packing"]
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        docs = stage(spark, docs, at).cache()
        assert docs.columns == columns
        assert {r["doc_id"]: r["text"] for r in docs.collect()} == [{r[0]: r[1] for r in kept}, texts, final][n]
        assert all(r["text"] is None or n == 0 or r["n_chars"] in (len(r["text"]), 0) for r in docs.collect())
    ids = {r[0]: r for r in rows}
    remaining = [(id, t, "en", ids[id][3], 0) for id, t in final.items()]
    plan = plain_mix(remaining)
    mixed = corpus_pipeline.STAGES[3][1](spark, docs, at).cache()
    copies = Counter(r["doc_id"] for r in mixed.collect())
    assert mixed.columns == columns and set(copies.values()) <= {1, 2}
    given, target, largest = Counter(), {}, Counter()
    for r, (n, _, t) in zip(remaining, plan):
        given[r[3]] += n * copies[r[0]]
        target[r[3]], largest[r[3]] = t, max(largest[r[3]], n)
    assert all(abs(given[s] - target[s]) <= largest[s] / 2 + 1e-6 for s in target)
    packed = corpus_pipeline.run(spark, at).collect()
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == copies
    lengths = [r["length"] for r in packed]
    assert len({r["sequence_id"] for r in packed}) <= best_fit(lengths) * 1.01 + 1
