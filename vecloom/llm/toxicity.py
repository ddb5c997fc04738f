"""Toxicity by weak supervision: voters, a generative label model, a linear classifier.

Voters are word beginnings that labelled toxic texts favour or avoid (a lexicon found
in a bounded sample of labelled rows) and a few patterns of writing. A voter speaks or
abstains; what its voice is worth, for toxic or for clean, the label model estimates.
That model is generative: a text has a hidden class, and voters form a tree in which a
voter that goes with another one more often than their classes explain has that one for
its parent. Its parameters are how often each voter speaks in either class, where its
parent speaks and where it doesn't, so accuracies and correlations are estimated
together, by expectation maximization over the vote patterns of all texts, counted;
the labelled rows enter as prior counts. To abstain is no evidence, as most voters
speak for one language only. Posterior labels then train a logistic regression on how
often voters speak, and its sigmoid is the score; its base is lowered until nearly all
labelled rows that it calls toxic are.

Only rows whose crc32(doc_id as text) mod 5 is not 0 are learnt from; labels, lang,
source and doc_id are no inputs of a score.

Defined results: a null or empty text gets the score of a text without votes; null
labels are ignored, contradicting ones count as toxic; without labelled rows every
score is 0; repeated rows are scored alike; an empty table gives an empty result;
other columns pass through ``accepted`` unchanged.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm.common import cut, lit_array, slices, table

#: Labelled rows that the lexicon is found in, at most; and distinct votes up to which the classifier is fitted on the driver.
TRAIN_ROWS, FIT_ROWS = 8_000, 20_000
#: Voters of the lexicon, the lengths of the word beginnings, and what they must show.
VOTERS, LENGTHS = 96, range(3, 11)
LEAST_TOXIC, LEAST_SHARE = 5, 0.6
#: Voters for clean: how many, and how many texts they would have in toxic texts by
#: chance of which they have a quarter at most.
CLEAN_VOTERS, LEAST_EXPECTED = 16, 12
ROUNDS = 12
#: Texts that the common rate of a voter beside its parent weighs as much as.
PRIOR = 5.0
#: Share of the labelled rows at 0.5 and above that are toxic, at least.
PRECISION = 0.998
SEED = 23
_WORD = re.compile(r"[^\W\d_]+")
_FLUSH = 200_000

#: Patterns of writing, each a voter.
PATTERNS = (
    ("shouting", lambda t, n: sum(map(str.isupper, t)) > 0.5 * len(t) - t.count(" ")),
    ("exclamations", lambda t, n: t.count("!!") >= 3),
    ("symbols", lambda t, n: 10 * sum(map(t.count, "#*$%&|<>")) > n),
    ("insult", lambda t, n: _INSULT.search(t) is not None),
)
_INSULT = re.compile(r"(?i)\byou(?:'re| are)? (?:such )?an? \w+")


def held_out():
    """A row without doc_id has no remainder and isn't held out; it has no label either."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def _starts(text: str) -> dict[str, int]:
    """Beginnings of a text's words, and of how many distinct words each is one."""
    out: dict[str, int] = {}
    for word in set(_WORD.findall(text.lower())):
        for n in LENGTHS:
            if n > len(word):
                break
            out[word[:n]] = out.get(word[:n], 0) + 1
    return out


def _labelled(labels: DataFrame, rows: int) -> DataFrame:
    """(doc_id, toxic): at most ``rows`` labelled rows that may be learnt from."""
    once = labels.where("toxic is not null and doc_id is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return once.orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(rows)


def lexicon(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, voters: int = VOTERS) -> tuple[list[str], float, int]:
    """Word beginnings that labelled toxic texts favour, the best first, then those that
    they avoid; the share of toxic rows, and how many rows were learnt from."""
    told = cut(_labelled(labels, rows))
    sample = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(told), "doc_id").select("text", F.col("toxic").cast("int"))

    def count(batches):
        have: dict[str, list[int]] = {}

        def flush():
            keys = list(have)
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([have[k][0] for k in keys], pa.int64()), pa.array([have[k][1] for k in keys], pa.int64())], ["start", "toxic", "n"])
            have.clear()
            return out

        for batch in batches:
            for part in slices(batch, 32):
                for text, toxic in zip(part.column(0), part.column(1).to_pylist()):
                    for start in _starts(text.as_py() or ""):
                        own = have.setdefault(start, [0, 0])
                        own[0] += toxic
                        own[1] += 1
                if len(have) > _FLUSH:
                    yield flush()
        yield flush()

    totals = told.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("toxic")).first()
    if not totals["n"] or not totals["toxic"]:
        return [], 0.0, totals["n"]
    share = totals["toxic"] / totals["n"]
    counts = sample.mapInArrow(count, "start string, toxic long, n long").groupBy("start").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
    # how much better than chance, in bits: toxic texts gained less the clean ones that come with them
    p = (F.col("toxic") + share) / (F.col("n") + 1)
    gain = F.col("n") * (p * F.log2(p / share) + (1 - p) * F.log2((1 - p) / (1 - share)))
    is_toxic = (F.col("toxic") >= LEAST_TOXIC) & (F.col("toxic") >= LEAST_SHARE * F.col("n"))
    is_clean = (F.col("n") * share >= LEAST_EXPECTED) & (4 * F.col("toxic") <= F.col("n") * share)
    found = cut(counts.select("*", gain.alias("gain"), is_toxic.alias("for_toxic"), is_clean.alias("for_clean")).where("for_toxic or for_clean"))
    by_gain = lambda of: [r["start"] for r in found.where(of).orderBy(F.desc("gain"), "start").limit(20 * voters).collect()]
    toxic_starts = by_gain("for_toxic")
    chosen = _sifted(toxic_starts, _holders(sample, toxic_starts), voters)
    for start in by_gain("for_clean"):
        if len(chosen) < voters + CLEAN_VOTERS and not any(start.startswith(c) or c.startswith(start) for c in chosen):
            chosen.append(start)
    return chosen, share, totals["n"]


def _holders(sample: DataFrame, starts: list[str]) -> list[tuple[list[int], int]]:
    """For each labelled text which of ``starts`` its words begin with, and its label;
    at most ``TRAIN_ROWS`` short lists."""
    known = {s: i for i, s in enumerate(starts)}

    def run(batches):
        for batch in batches:
            for part in slices(batch, 32):
                held = [sorted(known[s] for s in _starts(t.as_py() or "").keys() & known.keys()) for t in part.column(0)]
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.list_(pa.int32())), part.column(1)], ["held", "toxic"])

    return [(r["held"], r["toxic"]) for r in sample.mapInArrow(run, "held array<int>, toxic int").collect()]


def _sifted(starts: list[str], rows: list[tuple[list[int], int]], most: int) -> list[str]:
    """The best of ``starts`` without those that only go along with better ones: where
    no better one speaks, a voter must keep its share of toxic texts as well."""
    of: dict[int, list[int]] = {}
    for i, (held, _) in enumerate(rows):
        for v in held:
            of.setdefault(v, []).append(i)
    toxic, covered, chosen = np.array([t for _, t in rows]), np.zeros(len(rows), bool), []
    for v, start in enumerate(starts):
        if len(chosen) == most:
            break
        if any(start.startswith(c) or c.startswith(start) for c in chosen):
            continue
        own = np.array(of.get(v, []), int)
        left = own[~covered[own]]
        if len(left) - toxic[left].sum() >= 2 and toxic[left].sum() < LEAST_SHARE * len(left):
            continue
        chosen.append(start)
        covered[own] = True
    return chosen


def _voter(starts: list[str]):
    """A function from a text to {voter: how often} of those that don't abstain."""
    at = {s: i for i, s in enumerate(starts)}
    lengths = sorted({len(s) for s in starts})

    def of(text: str | None) -> dict[int, int]:
        text = text or ""
        words = _WORD.findall(text.lower())
        found: dict[int, int] = {}
        for word in set(words):
            for n in lengths:
                if (i := at.get(word[:n])) is not None:
                    found[i] = found.get(i, 0) + 1
                    break
        for i, (_, test) in enumerate(PATTERNS, len(starts)):
            if words and test(text, len(words)):
                found[i] = 1
        return found

    return of


def votes(docs: DataFrame, starts: list[str]) -> DataFrame:
    """doc_id and votes: (voter, how often) of those that don't abstain, in one pass."""
    voter = _voter(starts)
    kind = pa.list_(pa.struct([("v", pa.int32()), ("n", pa.int32())]))

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                rows = []
                for text in part.column(1):
                    found = voter(text.as_py())
                    rows.append([{"v": v, "n": found[v]} for v in sorted(found)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, kind)], ["doc_id", "votes"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, votes array<struct<v:int,n:int>>")


class LabelModel:
    """``parents``: each voter's, -1 for none; ``beside`` and ``alone``: what its voice
    adds to the log odds of toxic where its parent speaks too, and where it doesn't;
    ``base``: the log odds of a text on which all abstain."""

    def __init__(self, parents: list[int], beside: np.ndarray, alone: np.ndarray, base: float):
        self.parents, self.beside, self.alone, self.base = parents, beside, alone, base

    def log_odds(self, voters):
        beside, alone = (lit_array([float(x) for x in w], "double") for w in (self.beside, self.alone))
        said = lambda v: F.when(_with_parent(voters, v, self.parents), F.get(beside, v)).otherwise(F.get(alone, v))
        return F.lit(self.base) + F.aggregate(voters, F.lit(0.0), lambda acc, v: acc + said(v))

    def posterior(self, voters):
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-self.log_odds(voters)))


def _with_parent(voters, v, parents: list[int]):
    return F.array_contains(voters, F.get(lit_array(parents, "int"), v))


def tree(alone: np.ndarray, together: dict[tuple[int, int], float], expected) -> list[int]:
    """Each voter's parent: that of the more common ones whose company it has most beyond
    what ``expected(a, b)`` says, if that is more than as often again."""
    order = sorted(range(len(alone)), key=lambda v: (-alone[v], v))
    place = {v: i for i, v in enumerate(order)}
    best: dict[int, tuple[float, int]] = {}
    for (a, b), n in sorted(together.items()):
        child, parent = (a, b) if place[a] > place[b] else (b, a)
        if n > 2 * (e := expected(a, b)):
            best[child] = max(best.get(child, (0.0, -1)), ((n - e) / max(1.0, alone[child]), parent))
    return [best.get(v, (0.0, -1))[1] for v in range(len(alone))]


def label_model(patterns: DataFrame, told: DataFrame, n_voters: int, share: float, rounds: int = ROUNDS) -> LabelModel:
    """``patterns`` (voters, n): vote patterns of all texts and their counts; ``told``
    (voters, toxic, n): those of labelled rows. Only sums for each voter, and for each
    pair of voters, come to the driver."""
    # correlations: how often two voters speak together beyond what their classes explain
    pair = patterns.select("n", F.explode("voters").alias("a"), "voters").select("n", "a", F.explode("voters").alias("b")).where("a <= b").groupBy("a", "b").agg(F.sum("n").alias("n"))
    together = {(r["a"], r["b"]): float(r["n"]) for r in pair.collect()}  # voters squared at most
    single = np.array([together.pop((v, v), 0.0) for v in range(n_voters)])
    total = told.agg(F.sum(F.col("toxic") * F.col("n")).alias("toxic"), F.sum("n").alias("n")).first()
    toxic, clean = float(total["toxic"]), float(total["n"] - total["toxic"])
    every = float(patterns.agg(F.sum("n")).first()[0] or 0)
    base = math.log(share / (1 - share))

    def sums(rows: DataFrame, parents: list[int], p) -> np.ndarray:
        """[beside its parent or not, voter]: texts in which it speaks, weighed by ``p``."""
        out = np.zeros((2, n_voters))
        spoken = rows.select("voters", F.col("n").cast("double").alias("n"), p.alias("p")).select("n", "p", "voters", F.explode("voters").alias("v"))
        for r in spoken.groupBy("v", _with_parent(F.col("voters"), F.col("v"), parents).cast("int").alias("f")).agg(F.sum(F.col("n") * F.col("p")).alias("s")).collect():
            out[r["f"], r["v"]] = r["s"]
        return out

    none = [-1] * n_voters
    own = [sums(told, none, of)[0] for of in (F.col("toxic"), 1 - F.col("toxic"))]
    alpha, beta = (_rate(own[0], toxic), _rate(own[1], clean))
    parents = tree(single, together, lambda a, b: every * (share * alpha[a] * alpha[b] + (1 - share) * beta[a] * beta[b]))
    told_sums = [sums(told, parents, of) for of in (F.col("toxic"), 1 - F.col("toxic"))]
    all_sums = sums(patterns, parents, F.lit(1.0))
    # labelled rows count as much as all others together
    scale = (toxic + clean) / max(1.0, every)
    model = LabelModel(parents, *estimated(parents, *told_sums, toxic, clean), base)
    for _ in range(rounds):
        p = model.posterior(F.col("voters"))
        found = sums(patterns, parents, p)
        mass = float(patterns.agg(F.sum(p * F.col("n"))).first()[0] or 0.0)
        new = LabelModel(parents, *estimated(parents, told_sums[0] + scale * found, told_sums[1] + scale * (all_sums - found), toxic + scale * mass, clean + scale * (every - mass)), base)
        done = max(np.abs(new.beside - model.beside).max(initial=0), np.abs(new.alone - model.alone).max(initial=0)) < 1e-3
        model = new
        if done:
            break
    return model


def _rate(votes: np.ndarray, of) -> np.ndarray:
    return np.clip((votes + 0.02) / (of + 1.0), 1e-5, 1 - 1e-5)


def estimated(parents: list[int], toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float) -> tuple[np.ndarray, np.ndarray]:
    """What each voter's voice is worth beside its parent and without it, from how often
    (``toxic``, ``clean``: [beside or not, voter]) it speaks in either class. Beside its
    parent the rate of both classes together is the prior: then nothing new is said."""
    up = np.array(parents)
    speaks = [np.where(up >= 0, x.sum(axis=0)[up], 0.0) for x in (toxic, clean)]
    silent = [n - s for n, s in zip((n_toxic, n_clean), speaks)]
    alone = np.log(_rate(toxic[0], np.maximum(silent[0], 0)) / _rate(clean[0], np.maximum(silent[1], 0)))
    common = (toxic[1] + clean[1] + 0.5) / (speaks[0] + speaks[1] + 1.0)
    beside = np.log((toxic[1] + PRIOR * common) / (speaks[0] + PRIOR)) - np.log((clean[1] + PRIOR * common) / (speaks[1] + PRIOR))
    return np.where(up >= 0, beside, 0.0), alone


def _blocks(fit: DataFrame) -> DataFrame:
    """Rows (votes, n, p) packed: how many voters speak in each row, which, and 1 + log of
    how often; then p and n."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                spoken = batch.column(0)
                flat = spoken.flatten()
                sizes = np.diff(spoken.offsets.to_numpy()).astype(np.int64)
                v, n = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("v", "n"))
                parts = [sizes, v.astype(np.int64), 1 + np.log(n.astype(float)), batch.column(2).to_numpy(zero_copy_only=False).astype(float), batch.column(1).to_numpy(zero_copy_only=False).astype(float)]
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64()), *[pa.array([x.tobytes()], pa.binary()) for x in parts]], ["rows", "sizes", "v", "x", "p", "n"])

    return fit.select("votes", F.col("n").cast("double"), "p").mapInArrow(run, "rows long, sizes binary, v binary, x binary, p binary, n binary")


def _sums(block, n_voters: int, at: tuple[np.ndarray, float] | None) -> np.ndarray:
    """What a block adds to the gradient at (weights, base); without these to the sums of
    squares of the features, of the soft labels and of the counts."""
    sizes, v = (np.frombuffer(block[k], np.int64) for k in ("sizes", "v"))
    x, p, n = (np.frombuffer(block[k], np.float64) for k in ("x", "p", "n"))
    row = np.repeat(np.arange(len(sizes)), sizes)
    if at is None:
        return np.append(np.bincount(v, n[row] * x * x, n_voters), [n @ p, n.sum()])
    off = n * (p - 1 / (1 + np.exp(-(np.bincount(row, x * at[0][v], len(sizes)) + at[1]))))
    return np.append(np.bincount(v, x * off[row], n_voters), off.sum())


def _fitted(blocks: DataFrame, n_voters: int, steps: int = 300, here: int | None = None) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels; features are 1 + log of how often each voter
    speaks. Every row counts: up to ``here`` rows the gradients are summed on the driver,
    beyond them where the blocks are, and a vector a task comes back."""
    rows = blocks.agg(F.sum("rows")).first()[0] or 0
    local = blocks.collect() if rows <= (FIT_ROWS if here is None else here) else None

    def total(at):
        if local is not None:
            return np.sum([_sums(r, n_voters, at) for r in local], axis=0)

        def run(batches):
            out = 0.0
            for batch in batches:
                for r in batch.to_pylist():
                    out = out + _sums(r, n_voters, at)
            if np.ndim(out):
                yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["s"])

        return np.sum([np.frombuffer(r["s"], np.float64) for r in blocks.mapInArrow(run, "s binary").collect()], axis=0)

    first = total(None)
    of = first[-1]
    share = first[-2] / of
    w, b = np.zeros(n_voters), math.log(max(1e-6, share) / max(1e-6, 1 - share))
    scale = 1e-8 + np.sqrt(first[:n_voters] / of)  # rare voters learn as fast as common ones
    for _ in range(steps):
        off = total((w, b)) / of
        w = w + 4.0 * (off[:-1] / scale**2 * np.minimum(1.0, scale * 10) - 1e-5 * w)
        b += 1.0 * off[-1]
        w = np.clip(w, -12, 12)
    return w, float(b)


class Classifier:
    """Voters with the weights of a logistic regression."""

    def __init__(self, starts: list[str], weights: np.ndarray, base: float):
        self.starts, self.weights, self.base = starts, [float(w) for w in weights], float(base)

    def of_votes(self, votes: str = "votes"):
        """The score as a Column over votes."""
        at = lit_array(self.weights, "double")
        z = F.aggregate(votes, F.lit(self.base), lambda acc, v: acc + F.get(at, v["v"]) * (F.lit(1.0) + F.log(v["n"].cast("double"))))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))

    def of_text(self, text: str = "text"):
        """The score as a Column over whole texts, so that rows can be scored where they are."""
        voter, weights, base = _voter(self.starts), self.weights, self.base

        @F.pandas_udf("double")
        def score(texts: pd.Series) -> pd.Series:
            out = []
            for t in texts:
                found = voter(t)
                z = base
                for v in sorted(found):
                    z += weights[v] * (1 + math.log(found[v]))
                out.append(1 / (1 + math.exp(-z)))
            return pd.Series(out, dtype=float)

        return score(F.col(text).cast("string"))


def fitted(docs: DataFrame, labels: DataFrame) -> tuple[Classifier | None, DataFrame | None]:
    """The classifier and the votes of ``docs`` that it was fitted on; nothing where
    there are no labelled rows to learn from."""
    starts, share, rows = lexicon(docs, labels)
    if not starts:
        return None, None
    n_voters = len(starts) + len(PATTERNS)
    spoken = cut(votes(docs, starts))
    voters = F.transform("votes", lambda x: x["v"]).alias("voters")
    patterns = cut(spoken.select(voters).groupBy("voters").agg(F.count(F.lit(1)).alias("n")))
    told = cut(spoken.join(F.broadcast(_labelled(labels, rows)), "doc_id").select(voters, F.col("toxic").cast("int")).groupBy("voters", "toxic").agg(F.count(F.lit(1)).alias("n")))
    model = label_model(patterns, told, n_voters, share)
    # texts whose votes are the same are one row with a count
    fit = spoken.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).select("votes", "n", model.posterior(F.transform("votes", lambda x: x["v"])).alias("p"))
    weights, base = _fitted(cut(_blocks(fit)), n_voters)
    known = spoken.join(F.broadcast(_labelled(labels, rows)), "doc_id").groupBy("votes", F.col("toxic").cast("int").alias("toxic")).agg(F.count(F.lit(1)).alias("n"))
    odds = [(base + sum(weights[v] * (1 + math.log(n)) for v, n in r["votes"]), r["toxic"], r["n"]) for r in known.collect()]  # of labelled rows
    return Classifier(starts, weights, base - _excess(odds)), spoken


def _excess(odds: list[tuple[float, int, int]], precision: float = PRECISION) -> float:
    """By how much the log odds (of labelled rows: log odds, toxic, count) are too high:
    above that the share ``precision`` of the rows is toxic."""
    toxic = every = 0
    found, after = None, False
    ordered = sorted(odds, key=lambda x: -x[0])
    for i, (z, t, n) in enumerate(ordered):
        if after:
            found, after = (found + z) / 2 if z < found else found, False
        toxic, every = toxic + t * n, every + n
        if (i + 1 == len(ordered) or ordered[i + 1][0] < z) and toxic >= precision * every:
            found, after = z, True
    return max(0.0, found) if found is not None else 0.0




def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score) for every row of ``docs``."""
    classifier, spoken = fitted(docs, labels)
    if classifier is None:
        return docs.select(F.col("doc_id").cast("long"), F.lit(0.0).alias("score"))
    return spoken.select("doc_id", classifier.of_votes().alias("score"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is below the threshold. The texts are scored a
    second time where they lie: that costs a pass, but no text is shuffled."""
    classifier, _ = fitted(docs, labels)
    return docs if classifier is None else docs.where(classifier.of_text() < threshold)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
