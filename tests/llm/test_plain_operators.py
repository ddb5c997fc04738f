"""Operators on single rows, against plain versions."""

import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vecloom.llm import licenses, mixing, packing, pii, quality, simhash
from vecloom.llm.common import cut

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_quality(text):
    text = text or ""
    w = WORD.findall(text)
    grams = list(zip(w, w[1:], w[2:]))
    counts = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if counts[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(docs, rows):
    got = {r["doc_id"]: tuple(r)[1:6] for r in quality.judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()}
    assert got == {r[0]: plain_quality(r[1]) for r in rows}


def test_quality_of_empty_and_clashing_tables(make, clashing, rows):
    assert quality.judged(make([])).count() == 0
    got = {r["doc_id"]: tuple(r)[1:6] for r in quality.judged(clashing).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()}
    assert got == {r[0]: plain_quality(r[1]) for r in rows}


def test_quality_verdicts(make):
    good = "\n".join(f"the word{i} of a{i} plain{i} text that{i} is in{i} line and{i} sense" for i in range(12))
    junk = " ".join(f"wo{i}%%% th{i}***" for i in range(40))
    again = "say it again and " * 40
    table_ = " | ".join(f"cellword{i}" for i in range(60))
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality.judged(make([(1, good), (2, junk), (3, again), (4, table_), (5, None), (6, "short")])).collect()}
    assert got == {1: (False, True), 2: (False, False), 3: (True, False), 4: (False, False), 5: (True, False), 6: (True, False)}


BASE = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 13 <= len(re.sub("[^0-9]", "", m)) <= 19 and pii.luhn(re.sub("[^0-9]", "", m))),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
]


def plain_pii(text):
    return [(k, *m.span()) for k, p, ok in BASE for m in p.finditer(text) if ok(m[0])]


PERSONAL = [
    "write to a.b@c.example.com, or x@y and z@q.org.", "a@b.c@d.e@f.g", "@@a@@b.c..d", "from 1.2.3.4 to 256.1.1.1 and 1.2.3.4.5.6.7.8", "0001.2.3.4 1.2.3",
    "pay 4111 1111 1111 1111 or 4111-1111-1111-1112 4111111111111111", "call +1 (212) 555-0123, +12 or +49 30 1234567 +123456789012345678", "é4111111111111111 中@b.co",
    "12345678901234567890123456789", "1 2 3 4 5 6 7 8 9 0 1 2 3", "+1+1+1 (((", "a" * 50_000 + "@", "1" * 50_000, "@" * 5_000, "1." * 5_000, "", "no data at all",
]


def test_pii_base_and_more():
    import random

    rng = random.Random(2)
    cases = PERSONAL + ["".join(rng.choice("a1.@+- 4(") for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    for text in cases:
        if len(text) < 10_000:
            assert pii.base_spans(text) == plain_pii(text), text
        else:
            pii.base_spans(text)
    for n in range(10, 20):
        text = " ".join(f"4{i:015d}" for i in range(n * 37))
        assert pii.base_spans(text) == plain_pii(text)


def test_field_links_distant_tokens():
    model = pii.trained()
    secret = "Zk3jH8xQp2mN5vT"
    text = f"use token = {secret} here " + "and so on " * 50 + f"then {secret} again, and version 2.1 of 2024"
    spans = pii.field_spans(text, pii.base_spans(text), model)
    assert [text[a:b] for k, a, b in spans if k == "secret"] == [secret, secret]
    alone = f"then {secret} again, and version 2.1 of 2024"
    assert not pii.field_spans(alone, [], model)
    assert not pii.field_spans("There were 12 of them in 1998, at 10:30, for $4.50 each; see page 7.", [], model)
    a, b = pii.trained(), pii.trained()
    assert (a[0] == b[0]).all() and a[1] == b[1] and a[1] > 0


def test_pii_frame(docs, rows, clashing, make):
    got = {r["doc_id"]: r for r in pii.detected(clashing).collect()}
    assert set(got) == {r[0] for r in rows}
    for id, text, *_ in rows:
        assert got[id]["base"] == ",".join(f"{k}:{a}:{b}" for k, a, b in plain_pii(text or ""))
        assert set(filter(None, got[id]["base"].split(","))) <= set(got[id]["spans"].split(","))
    assert pii.detected(make([])).count() == 0



def plain_licence(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = [(i, label) for label, p in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    return len(w), len(found), min((i for i, _ in found), default=None), max((i for i, _ in found), default=None), ",".join(sorted({x for _, x in found}))


def test_licence_phrases(make, docs, rows, clashing):
    texts = [
        "Released under the MIT License.", "CC BY-NC 4.0; cc by nc cc-by-nc", "under the\nApache License, Version 2.0", "under-the-mit--license under the mit licenses", None, "",
        "This work is licensed under the GNU General Public License, version 3.", "cc by nc" * 3, "É under the MIT license",
    ]
    got = {r["doc_id"]: r for r in licenses.scanned(make(list(enumerate(texts)))).collect()}
    for i, text in enumerate(texts):
        assert tuple(got[i])[1:6] == plain_licence(text)
        assert set(filter(None, got[i]["base_labels"].split(","))) <= set(filter(None, got[i]["labels"].split(",")))
        assert 0 <= got[i]["score"] <= 1
    assert got[6]["labels"] == "gpl" and got[6]["base_labels"] == "" and got[6]["score"] == 1
    wide = {r["doc_id"]: tuple(r)[1:6] for r in licenses.scanned(clashing).collect()}
    assert wide == {r[0]: plain_licence(r[1]) for r in rows}


def test_licence_spans_survive_edits(make):
    full = licenses.TEMPLATES["mit"][2]
    w = full.split()
    edited = " ".join([*"some words before".split(), *w[:20], "really", *w[20:40], *w[41:], *"and after".split()])
    got = {r["doc_id"]: r for r in licenses.scanned(make([(1, edited), (2, " ".join(w[:12])), (3, full), (3, full)])).collect()}
    assert got[1]["labels"] == "mit" and 0.75 <= got[1]["score"] < 1 and got[2]["labels"] == "" and got[3]["score"] == 1
    span = licenses.spans(cut(licenses.prepared(make([(1, edited)])))).first()
    assert (span["first"], span["last"]) == (3, 3 + len(w) - 1)
    assert licenses.scanned(make([])).count() == 0


@pytest.mark.parametrize("histogram", [{}, {5: 1}, {1024: 3}, {341: 7, 342: 5, 683: 4, 682: 2}, {1: 5000}, {600: 9, 424: 3, 400: 8, 24: 2}, {512: 5}, {513: 3, 511: 3, 2: 9}])
def test_packing_plan(histogram):
    plan = packing.plan(histogram)
    assert all(sum(p) <= 1024 and n > 0 and sum(3 * x > 1024 for x in p) <= 2 for p, n in plan)
    used = Counter()
    for p, n in plan:
        for x in p:
            used[x] += n
    assert used == Counter(histogram)
    total = sum(k * n for k, n in histogram.items())
    assert sum(n for _, n in plan) >= -(-total // 1024)


def test_packing_plan_is_near_the_bound():
    import random

    rng = random.Random(6)
    for top in (200, 600, 1024):
        h = Counter(rng.randint(1, top) for _ in range(5000))
        large = sum(n for k, n in h.items() if k > 512)
        bound = max(large, -(-sum(k * n for k, n in h.items()) // 1024))
        assert sum(n for _, n in packing.plan(h)) <= bound * (1.01 if top < 1024 else 1.03) + 1


@pytest.fixture(scope="module")
def plain_ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: [*plain.encode(text, add_special_tokens=False).ids, 2]


def as_list(held):
    return [int.from_bytes(held[i : i + 4], "little") for i in range(0, len(held), 4)]


def test_ids_equal_the_tokenizers(plain_ids):
    import random

    own = packing.Encoder()
    rng = random.Random(4)
    odd = ["", " ", "a  b", " a", "a ", "a\n b", "a \nb", "x<|endoftext|>y z", " <|endoftext|> b", "a<|endoftext|><|endoftext|>", "don't 'll", "a \u3000 b", "a\u2003 b", "a\x1c b", "a\x85\n\nb", "a\xa0\xa0 b\xa0", "é ü", "1 234", "中文 字", "\u180e x\u180e y", "\U0001f600 \U0001f600"]
    alphabets = (" \n\tab'é1. ", " \n\x1c\x1f\x85\xa0\u2003\u3000a.", " 中é\u0301ǅǆªº²½×÷\u0250\u1e9e'sS", "<|endoftx> \n")
    for text in [*odd, *("".join(rng.choice(a) for _ in range(rng.randint(1, 20))) for a in alphabets for _ in range(500))]:
        assert as_list(own.ids(text)) == plain_ids(text), repr(text)


@pytest.mark.parametrize("text", [" " * 2_000_000, "\n" * 2_000_000, "a" + " \n\t" * 700_000 + "b", "\xa0 " * 300_000, "x" * 1_000_000], ids=("spaces", "newlines", "mixed", "odd", "letters"))
def test_long_runs_have_the_tokenizers_ids(text, plain_ids):
    assert as_list(packing.Encoder().ids(text)) == plain_ids(text)


def test_a_forgetful_encoder_is_the_same(monkeypatch, plain_ids, rows):
    monkeypatch.setattr(packing, "REMEMBERED", 5)
    own = packing.Encoder()
    for r in rows[:40]:
        assert as_list(own.ids(r[1] or "")) == plain_ids(r[1] or "")


def test_pieces_that_come_again_are_merged_once(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 5)
    made = []
    known = packing._Known(lambda key: made.append(key) or key.encode())
    for i in range(100):
        assert known["often"] == b"often" and known[f"once{i}"] == f"once{i}".encode()
        assert len(known) <= 5 and len(known._earlier) <= 5
    assert made.count("often") == 1 and len(made) == 101


def test_tasks_of_a_worker_share_an_encoder(spark, monkeypatch):
    import pyarrow as pa

    class Rows:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return run

    loaded, load = [], packing.Encoder.__init__
    monkeypatch.setattr(packing.Encoder, "__init__", lambda self, *a: loaded.append(a) or load(self, *a))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["a b", None])], ["doc_id", "text"])
    # each task gets the function anew
    first, again = ([b.to_pylist() for b in packing.pieces(Rows(), end=7)([batch])] for _ in range(2))
    assert first == again and [r["ids"][-4:] for b in first for r in b] == [b"\7\0\0\0"] * 2
    assert loaded == [("byte_bpe_50k", 7)]


def best_fit(lengths, capacity=1024):
    """Sequences that plain best-fit decreasing takes, piece by piece."""
    from bisect import bisect_left, insort

    gaps = []
    for n in sorted(lengths, reverse=True):
        at = bisect_left(gaps, n)
        gap = gaps.pop(at) if at < len(gaps) else capacity
        insort(gaps, gap - n)
    return len(gaps)


def check_packed(got, rows, plain_ids):
    """Every piece of every row's ids, in sequences without gaps or overlaps."""
    want = Counter()
    for id, text, *_ in rows:
        ids = plain_ids(text or "")
        first = len(ids) % 1024 or 1024
        at = 0
        for piece, size in enumerate([first, *[1024] * ((len(ids) - first) // 1024)]):
            want[id, piece, at, size, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[at : at + size]))] += 1
            at += size
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    seq = {}
    for r in got:
        seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    lengths = [r["length"] for r in got]
    assert -(-sum(lengths) // 1024) <= len(seq) <= best_fit(lengths) * 1.01 + 1


@pytest.mark.parametrize("together", [100_000, 7])
def test_packed_documents(rows, clashing, make, plain_ids, monkeypatch, together):
    monkeypatch.setattr(packing, "TOGETHER", together)
    got = packing.packed(clashing).collect()
    check_packed(got, rows, plain_ids)
    assert all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in got)
    same = [(None, "a b c")] * 60 + [(1, "a b c")] * 40 + [(2, None), (2, "x " * 3000)]
    check_packed(packing.packed(make(same), ids=False).collect(), same, plain_ids)
    joined = packing.sequences(packing.packed(make([(1, "a b"), (1, "a b"), (2, None)]))).collect()
    assert len(joined) == 1 and joined[0]["length"] * 4 == len(joined[0]["ids"])
    assert packing.packed(make([])).count() == 0


def test_packing_query(spark, plain_ids):
    folder = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = packing.op5_packing(spark, folder)
    assert got.dtypes == [("doc_id", "bigint"), ("piece", "int"), ("start", "bigint"), ("length", "bigint"), ("ids_crc32", "bigint"), ("sequence_id", "bigint"), ("offset", "bigint")]
    check_packed(got.collect(), rows, plain_ids)


def test_targets():
    assert mixing.targets({"b": 100, "a": 100, None: 100}) == {"a": 200.0, "b": pytest.approx(500 / 3), None: pytest.approx(250 / 3)}
    sizes = {f"s{i}": 10 * (i + 1) for i in range(9)} | {None: 50}
    got = mixing.targets(sizes)
    assert sum(got.values()) == pytest.approx(1.5 * sum(sizes.values())) and all(got[s] <= 2 * sizes[s] + 1e-9 for s in sizes)
    assert mixing.targets({"a": 0}) == {"a": 0.0}


def test_flow_repeats_as_little_as_it_can():
    # the shared pattern can serve either source; only x needs it
    given = mixing.flow({("x",): 10, ("x", "y"): 10, ("y",): 30}, {"x": 18, "y": 30})
    assert sum(n for (_, s), n in given.items() if s == "x") == pytest.approx(18) and sum(n for (_, s), n in given.items() if s == "y") == pytest.approx(30)
    for p, n in ((("x",), 10), (("x", "y"), 10), (("y",), 30)):
        assert sum(v for (q, _), v in given.items() if q == p) <= n + 1e-6
    # a pattern given to one source is taken back for another that has nothing else
    given = mixing.flow({("x", "y"): 10, ("y",): 10}, {"y": 10, "x": 10})
    assert given[("x", "y"), "x"] == pytest.approx(10)
    assert mixing.flow({("x",): 10}, {"x": 17})[("x",), "x"] == pytest.approx(17)


def test_mix(docs, rows, clashing, make):
    got = mixing.mix(clashing).collect()
    assert len(got) == len(rows)
    n = {r[0]: len(WORD.findall(r[1] or "")) for r in rows}
    assert all(r["size"] == n[r["doc_id"]] and 0 <= r["copies"] <= 2 for r in got)
    by = {}
    for r in got:
        by.setdefault(r["pattern"][0], []).append(r)
    for rows_ in by.values():
        assert abs(sum(r["size"] * r["copies"] for r in rows_) - rows_[0]["target"]) <= max(r["size"] for r in rows_) / 2 + 1
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted((r["doc_id"], r["copies"]) for r in got) == sorted((r["doc_id"], r["copies"]) for r in again)
    out = mixing.mixed(clashing)
    assert out.columns == clashing.columns and Counter(r["doc_id"] for r in out.collect()) == Counter({r["doc_id"]: r["copies"] for r in got if r["copies"]})
    assert mixing.mix(make([])).count() == 0 and mixing.mix(make([(1, None)])).first()["copies"] == 0


def plain_mix(rows):
    """(size, source_size, target) of every row, and the words that each source should give."""
    size = [len(WORD.findall(r[1] or "")) for r in rows]
    totals = Counter()
    for n, r in zip(size, rows):
        totals[r[3]] += n
    ordered = sorted((s for s in totals if s is not None), key=str.encode) + [None] * (None in totals)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(ordered)}
    # by halving: the level at which sources that aren't full give 150 % together
    low, high = 0.0, 4.0 * sum(totals.values()) + 1
    goal = min(1.5 * sum(totals.values()), 2.0 * sum(totals.values()))
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(2 * totals[s], level * weight[s]) for s in ordered) < goal else (low, level)
    return [(n, totals[r[3]], min(2 * totals[r[3]], low * weight[r[3]])) for n, r in zip(size, rows)]


def check_mix(got, rows):
    want = plain_mix(rows)
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted(((r["doc_id"], r["size"], r["source_size"]) for r in got), key=key) == sorted(((r[0], n, s) for r, (n, s, _) in zip(rows, want)), key=key)
    target, taken, largest = {}, Counter(), Counter()
    source = {}
    for r, (n, _, t) in zip(rows, want):
        target[r[3]], largest[r[3]] = t, max(largest[r[3]], n)
        source[r[0]] = r[3]
    for r in got:
        assert r["taken"] in (0, r["size"], 2 * r["size"]) and r["target"] == pytest.approx(target[source[r["doc_id"]]], abs=1e-6)
        taken[source[r["doc_id"]]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6 for s in target)


def test_mixing_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = mixing.op9_mixing(spark, folder)
    assert got.dtypes[:5] == [("doc_id", "bigint"), ("size", "bigint"), ("source_size", "bigint"), ("target", "double"), ("taken", "bigint")]
    check_mix(got.collect(), rows)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, mixing.op9_mixing(spark, folder).collect()))


@pytest.mark.parametrize("case", ["equal", "null_ids", "zeros"])
def test_rows_that_repeat_are_taken_one_by_one(make, case):
    text = "a b c d"
    if case == "equal":
        rows = [(1, text, "en", "a", 7)] * 1000 + [(2, "w " * 50, "en", "b", 1)] * 40
    elif case == "null_ids":
        rows = [(None, text, "en", "a", 7)] * 300 + [(None, "x y", "en", "a", 7)] * 200
    else:
        rows = [(1, text, "en", "a", 7)] * 20 + [(i, None, "en", "a", 0) for i in range(200)] + [(500 + i, "x " * 30, "en", "a", 0) for i in range(9)]
    df = make(rows).repartition(5)
    got = mixing.mix(df)
    check_mix(got.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")).collect(), rows)
    out = mixing.mixed(df)
    assert out.columns == df.columns
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == sum((Counter({(r["doc_id"], r["text"]): r["copies"]}) for r in got.join(df.select(F.col("doc_id").alias("d"), "text", F.size(F.split("text", " ")).alias("w")).distinct(), F.expr("doc_id <=> d and (size = w or size = w - 1)")).select("doc_id", "text", "copies").collect()), Counter())


def test_flow_costs_what_the_cheapest_does():
    """Overlapping patterns against a linear program solved by trying all whole flows."""
    import random
    from itertools import product

    rng = random.Random(8)
    for _ in range(25):
        patterns = rng.sample([("x",), ("y",), ("x", "y"), ("y", "z"), ("z",)], 3)
        capacity = {p: rng.randint(1, 3) for p in patterns}
        sources = sorted({s for p in patterns for s in p})
        quota = {s: rng.randint(0, 4) for s in sources}
        arcs = [(p, s) for p in patterns for s in p]
        best = None
        for amounts in product(range(5), repeat=len(arcs)):
            given = dict(zip(arcs, amounts))
            of = {p: sum(n for (q, _), n in given.items() if q == p) for p in patterns}
            to = {s: sum(n for (_, t), n in given.items() if t == s) for s in sources}
            if any(of[p] > 2 * capacity[p] for p in patterns) or any(to[s] > quota[s] for s in sources):
                continue
            key = (-sum(to.values()), sum(max(0, of[p] - capacity[p]) for p in patterns))
            best = min(best or key, key)
        got = mixing.flow(capacity, quota)
        of = {p: sum(n for (q, _), n in got.items() if q == p) for p in patterns}
        to = {s: sum(n for (_, t), n in got.items() if t == s) for s in sources}
        assert all(of[p] <= 2 * capacity[p] + 1e-6 for p in patterns) and all(to[s] <= quota[s] + 1e-6 for s in sources)
        assert (-sum(to.values()), sum(max(0, of[p] - capacity[p]) for p in patterns)) == pytest.approx(best)


def test_overlapping_sources(spark):
    import random

    rng = random.Random(3)
    choices = [["a"], ["b"], ["a", "b"], ["b", "c"], ["c", "a", "b"], None]
    rows = [(i, " ".join(["w"] * rng.randint(1, 30)), rng.choice(choices)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source array<string>")
    got = mixing.mix(df).collect()
    sizes, capacity = Counter(), Counter()
    for _, t, s in rows:
        p = tuple(sorted(s)) if s else (None,)
        capacity[p] += len(t.split())
        for x in p:
            sizes[x] += len(t.split())
    flow = mixing.flow(dict(capacity), mixing.targets(dict(sizes)))
    want, taken = Counter(), Counter()
    for (p, _), n in flow.items():
        want[p] += n
    for r in got:
        taken[tuple(r["pattern"])] += r["size"] * r["copies"]
    assert all(abs(taken[p] - want[p]) <= 15 + 1e-6 for p in capacity)


def test_fingerprint_by_the_bit():
    import xxhash

    def plain(text):
        w = text.encode().lower().split()
        grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))

    for text in ("", "a", "A b", "a b c", "a b c d e f g h", "É b É b É b", "x " * 500):
        assert simhash.fingerprint(text) == plain(text)
    assert simhash.fingerprint(None) == 0
    long = " ".join(str(i % 977) for i in range(70_000))
    assert simhash.fingerprint(long) == plain(long)
