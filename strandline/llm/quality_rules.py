"""Quality rules as a short-circuit cascade, in DataFrame functions alone.

Each rule is a predicate that is true when a document fails. On a bounded sample every
rule's cost a row (the time of a job over the repeated sample, less that of the same job
without a rule) and rejection share are measured, then rules are ordered by rejections per
second and joined into one CASE: it stops at the first failure, so dear rules run only on
what cheap ones let through. A text is split into words once, and a rule's features are
worked out inside its own branch. The order never changes which documents are kept, since
a document goes if any rule fails.

The sample is the first rows that Spark finds; it can't change results, only their speed.

Defined results: a null or blank text has no words and fails `few_words`; repeated rows are
judged each, ties in worth keep the given order of rules; texts of any length count whole;
an empty table gives an empty result; other columns, whatever their names, pass through.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, table, unused

#: Rows on which costs are measured, how often they are repeated, and the characters of a text that are timed; they only order the rules.
SAMPLE_ROWS = 200
REPEATS = 2
SAMPLE_CHARS = 20_000
#: What separates words, the symbols, and the window in words.
BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once, also where body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def word_chars(words: Column) -> Column:
    return F.length(F.array_join(words, "")).cast("long")


def symbols(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(SYMBOLS)).cast("long")


def dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows that occur twice or more in the text; each word counts once."""

    def hashes(h: Column) -> Column:
        return F.transform(
            F.slice(h, 1, F.greatest(F.size(h) - (window - 1), F.lit(0))),
            lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, window)]),
        )

    def covered(h: Column) -> Column:
        ranked = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        starts = let(
            ranked,
            lambda s: F.array_sort(
                F.transform(
                    F.filter(
                        s, lambda e, k: F.get(s, k - 1)["h"].eqNullSafe(e["h"]) | F.get(s, k + 1)["h"].eqNullSafe(e["h"])
                    ),
                    lambda e: e["i"],
                )
            ),
        )
        steps = let(starts, lambda p: F.transform(p, lambda x, k: F.coalesce(F.least(F.get(p, k + 1) - x, F.lit(window)), F.lit(window))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    hashed = let(F.transform(words, lambda w: F.xxhash64(w)), hashes)
    return let(hashed, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0)).cast("long")


class Rule(NamedTuple):
    """fails(c) is true for documents to reject; c has a Column for each name it may ask for."""

    name: str
    fails: Callable[[dict[str, Column]], Column]


#: The base rules, then the method's own. Limits are wide: they aim at machine noise alone.
BASE = [
    Rule("few_words", lambda c: c["n_words"] < 10),
    Rule("repeated_windows", lambda c: 100 * c["n_repeat_words"] > 20 * c["n_words"]),
]
RULES = [
    *BASE,
    Rule("symbol_share", lambda c: 10 * c["n_symbols"] > 3 * c["word_chars"]),
    Rule("repeated_lines", lambda c: 2 * c["n_dup_lines"] > c["n_lines"]),
    Rule("word_length", lambda c: (c["word_chars"] < 2 * c["n_words"]) | (c["word_chars"] > 30 * c["n_words"])),
    Rule("shouting", lambda c: 10 * c["n_upper"] > 6 * c["word_chars"]),
]


def lines(text: Column) -> Column:
    return F.size(F.split(F.coalesce(text, F.lit("")), "\n")).cast("long")


def uppers(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[A-Z]")).cast("long")


class Features(dict):
    """Every feature as an expression over a text and its words, made when a rule asks for it."""

    def __init__(self, text: Column, words: Column, known: dict[str, Column] | None = None):
        super().__init__(known or {})
        self.make = {
            "n_words": lambda: F.size(words).cast("long"),
            "word_chars": lambda: word_chars(words),
            "n_symbols": lambda: symbols(text),
            "n_dup_lines": lambda: dup_lines(text),
            "n_repeat_words": lambda: repeat_words(words),
            "n_lines": lambda: lines(text),
            "n_upper": lambda: uppers(text),
        }

    def __missing__(self, name: str) -> Column:
        return self.setdefault(name, self.make[name]())


def ordered(sample: DataFrame, rules: list[Rule], repeats: int = REPEATS) -> list[Rule]:
    """The rules by rejections per second on the sample (a column `text`), best first; ties keep the given order."""
    many = sample.coalesce(1).select(F.explode(F.array_repeat("text", repeats)).alias("text"))

    def seconds(fails: Callable[[Column, Column], Column]) -> tuple[float, float]:
        """Time of a job over the repeated sample, the better of two runs, and the share rejected."""
        job = many.agg(F.count(F.lit(1)).alias("n"), F.count_if(on_words(F.col("text"), fails)).alias("bad"))
        best = math.inf
        for _ in range(2):  # the first run also compiles
            began = time.monotonic()
            row = job.first()
            best = min(best, time.monotonic() - began)
        return best, ((row["bad"] or 0) + 0.5) / (row["n"] + 1)

    base, _ = seconds(lambda text, parts: F.size(parts) < 0)
    worth = []
    for k, rule in enumerate(rules):
        took, share = seconds(lambda text, parts, rule=rule: rule.fails(Features(text, parts)))
        worth.append((-share / max(took - base, 0.05 * base), k))  # beneath that, times are noise
    return [rules[k] for _, k in sorted(worth)]


def on_words(text: Column, body: Callable[[Column, Column], Column]) -> Column:
    """body(text, words) with the words split once a row, wherever Spark puts the expression."""
    return let(words(text), lambda parts: body(text, parts))


def sampled(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """The beginnings of some texts, fetched from as few partitions as hold them."""
    short = docs.select(F.substring(F.coalesce("text", F.lit("")), 1, SAMPLE_CHARS).alias("text")).limit(rows).collect()
    return docs.sparkSession.createDataFrame(short, "text string")


def first_failure(rules: list[Rule], columns: dict[str, Column]) -> Column:
    """The name of the first rule that fails, null if none does."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(rule.fails(columns), F.lit(rule.name)).otherwise(out)
    return out


def cascade(docs: DataFrame, name: str, rules: list[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs with a column `name`: the first rule that rejects the row, or null."""
    order = ordered(sampled(docs, sample_rows), rules)
    failed = on_words(F.col("text"), lambda text, parts: first_failure(order, Features(text, parts)))
    return docs.select(*[col(c) for c in docs.columns], failed.alias(name))


def kept(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """The rows that no rule rejects, all columns as they came."""
    (failed,) = unused(docs, "__failed")
    return cascade(docs, failed, rules).where(col(failed).isNull()).select(*[col(c) for c in docs.columns])


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base counts of every document, and what the cascade decides."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    order = ordered(sampled(docs), RULES)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def counted(text: Column, parts: Column) -> Column:
        """The counts, which the query returns and so needs for every row."""
        made = Features(text, parts)
        return F.struct(*[made[n].alias(n) for n in names])

    def judged(text: Column, c: Column) -> Column:
        known = Features(text, F.array().cast("array<string>"), {n: c[n] for n in names})
        return F.struct(*[c[n].alias(n) for n in names], (BASE[0].fails(known) | BASE[1].fails(known)).alias("base_failed"), first_failure(order, known).isNull().alias("kept"))

    text = F.col("text")
    made = on_words(text, lambda t, parts: let(counted(t, parts), lambda c: judged(t, c)))
    return docs.select("doc_id", made.alias("made")).select("doc_id", "made.*")


OP8_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), p AS (
  SELECT r, unnest(w) AS x, unnest(range(len(w))) AS i FROM d
), g AS (
  SELECT r, i, x, lead(x, 1) OVER o AS x1, lead(x, 2) OVER o AS x2, lead(x, 3) OVER o AS x3, lead(x, 4) OVER o AS x4
  FROM p WINDOW o AS (PARTITION BY r ORDER BY i)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x, x1, x2, x3, x4) AS n FROM g WHERE x4 IS NOT NULL) WHERE n > 1
), covered AS (
  SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS j FROM twice) GROUP BY r
), f AS (
  SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
           - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
         coalesce(covered.n, 0) AS n_repeat_words,
         len(string_split(t, chr(10))) AS n_lines,
         length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper
  FROM d LEFT JOIN covered USING (r)
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 10 * n_symbols > 3 * word_chars
            OR 2 * n_dup_lines > n_lines OR word_chars < 2 * n_words OR word_chars > 30 * n_words
            OR 10 * n_upper > 6 * word_chars) AS kept
FROM f
"""
