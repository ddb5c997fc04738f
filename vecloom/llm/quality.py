"""Quality rules: a table of thresholds compiled into one projection.

Every rule is a ratio with a lower and an upper bound; ``verdict`` turns the table
into a single boolean column, and ``measures`` holds what the ratios are made of.
All of it is built-in functions: no user functions, no shuffle, one narrow stage.

Defined results: a null or blank text has no words and fails the base rule; repeated
rows are judged each on their own; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm.common import SPACES, table

MIN_WORDS = 50
#: Percent of the words that may stand in repeated three-word windows.
MAX_REPEATED = 50
SYMBOLS = "[#*$%&|<>]"
STOP_WORDS = (
    "the of and to in is that for with as was by on are this be it from or an "
    "le la les de des du et un une en que qui est dans pour pas sur au par "
    "der die das und ist nicht ein eine mit von zu den dem auf für im sich "
    "el los las del y que en un una es por con para se no"
).split()

#: name, (numerator, denominator), least, most. A bound of None does not hold.
RULES = (
    ("mean_word_length", ("word_chars", "n_words"), 2.0, 20.0),
    ("symbol_ratio", ("n_symbols", "n_words"), None, 0.1),
    ("stop_word_ratio", ("n_stop", "n_words"), 0.02, None),
    ("dup_line_ratio", ("n_dup_lines", "n_lines"), None, 0.5),
    ("bullet_line_ratio", ("n_bullets", "n_lines"), None, 0.9),
    ("ellipsis_line_ratio", ("n_ellipses", "n_lines"), None, 0.3),
)


def _repeated(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more in one text."""
    n = F.size(words)
    window = lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("p"))
    return F.when(n >= 4, F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), window)))


def _covered(windows: Column) -> Column:
    same = lambda x, k: F.coalesce(x["h"] == F.get(windows, k)["h"], F.lit(False))
    found = F.filter(windows, lambda x, k: same(x, k + 1) | same(x, k - 1))
    starts = F.sort_array(F.transform(found, lambda x: x["p"]))
    step = lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"), p.alias("last"))
    return F.coalesce(F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), step)["n"], F.lit(0))


def measures(docs: DataFrame) -> DataFrame:
    """doc_id with the counts that the rules divide, one row for each row of ``docs``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACES))
    split = docs.select(
        "doc_id",
        text.alias("t"),
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+")).alias("words"),
        F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "").alias("lines"),
    )
    stop = STOP_WORDS
    return split.select("doc_id", "t", "words", "lines", _repeated(F.col("words")).alias("windows")).select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.regexp_replace("t", SYMBOLS + "+", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _covered(F.col("windows")).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(stop))).cast("long").alias("n_stop"),
        F.size(F.filter("lines", lambda x: F.ltrim(x).rlike("^[-*•]"))).cast("long").alias("n_bullets"),
        F.size(F.filter("lines", lambda x: F.rtrim(x).rlike("(\\.\\.\\.|…)$"))).cast("long").alias("n_ellipses"),
    )


def verdict(rules=RULES) -> Column:
    """One column for the whole table of rules; a ratio over nothing is zero."""
    held = [F.lit(True)]
    for _, (top, below), least, most in rules:
        ratio = F.when(F.col(below) > 0, F.col(top) / F.col(below)).otherwise(F.lit(0.0))
        held += [] if least is None else [ratio >= least]
        held += [] if most is None else [ratio <= most]
    return reduce(lambda a, b: a & b, held)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(MAX_REPEATED) * F.col("n_words"))


def judged(docs: DataFrame, rules=RULES) -> DataFrame:
    return measures(docs).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))

ORACLE = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents),
w AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
      FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 1, 1))) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM w) WHERE n > 1),
c AS (SELECT doc_id, sum(least(3, i - p)) AS n_repeat
      FROM (SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -5) AS p FROM r) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines,
         len(list_filter(words, lambda x: lower(x) IN ({_STOP}))) AS n_stop,
         len(list_filter(lines, lambda x: regexp_matches(ltrim(x, ' '), '^[-*•]'))) AS n_bullets,
         len(list_filter(lines, lambda x: regexp_matches(rtrim(x, ' '), '([.][.][.]|…)$'))) AS n_ellipses
  FROM d LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
             greatest(n_words, 1)::DOUBLE AS nw, greatest(n_lines, 1)::DOUBLE AS nl FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars / nw BETWEEN 2 AND 20 AND n_symbols / nw <= 0.1 AND n_stop / nw >= 0.02
         AND n_dup_lines / nl <= 0.5 AND n_bullets / nl <= 0.9 AND n_ellipses / nl <= 0.3 AS kept
FROM b
"""
