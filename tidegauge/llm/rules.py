"""Quality rules whose cutoffs are chosen under a bound on false rejection.

A rule rejects a text when a measure of it is above a cutoff. Cutoffs come from a
fixed list, loosest first. For every stratum (language) the labelled good texts
say how many of them a cutoff would reject. A cutoff is allowed if the exact
binomial test rules out, at the corrected level, that the true rate of false
rejection is above the rule's share of the limit. Cutoffs are tested in order and
the last allowed one is taken; the level is divided by rules and strata
(Bonferroni), the limit by rules, so that with the given confidence no stratum
loses more than ``limit`` of its good texts through all rules together. A rule
with too little evidence in a stratum rejects nothing there.

Cases: a null text has no words and fails the base rules; a null stratum is a
stratum of its own; a stratum without labels has no cutoffs; repeated rows each
give a row; contradicting labels of one document count as its lowest; an empty
table or no labels are no error; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.common import cut, map_arrow, query, table
from tidegauge.llm.spans import mix, slices, windows

#: Rule: measured per hundred of; cutoffs, loosest first.
RULES: dict[str, tuple[str, str, tuple[int, ...]]] = {
    "symbols": ("n_symbols", "n_words", (300, 200, 150, 100, 80, 60, 50, 40, 30, 20, 15, 10)),
    "dup_lines": ("n_dup_lines", "n_lines", (90, 80, 70, 60, 50, 40, 30, 20, 10)),
    "repeats": ("n_repeat_words", "n_words", (50, 45, 40, 35, 30, 25, 20, 15, 10)),
    "long_words": ("word_chars", "n_words", (3000, 2000, 1500, 1200, 1000, 900, 800)),
    "capitals": ("n_capitals", "word_chars", (95, 90, 80, 70, 60, 50, 40, 30, 20)),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")
LIMIT, RISK = 0.02, 0.05
#: Strata above which the cutoffs are joined instead of being sent to every task.
FEW_STRATA = 10_000


def _among(characters: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters.encode())] = True
    return out


SYMBOL, CAPITAL = _among("#*$%&|<>"), _among("ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys stand more than once, and which of them are not the first of their kind."""
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    same = sorted_keys[1:] == sorted_keys[:-1]
    later = np.zeros(len(keys), bool)
    later[order[1:][same]] = True
    again = later.copy()
    again[order[:-1][same]] = True
    return again, later


def _own(hashes: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Hashes told apart by text."""
    owner = np.repeat(np.arange(len(borders) - 1, dtype=np.uint64), np.diff(borders))
    return mix(hashes ^ mix(owner + np.uint64(1)))


def _per_text(marked: np.ndarray, borders: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(marked)])[borders])


def counts(docs: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, stratum, the counts of every whole text, and a struct ``carried`` with the columns in ``carry``."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list[np.ndarray]] = []
            for _, _, texts in slices(batch.column(2)):
                starts, ends, borders = texts.words()
                words = np.diff(borders)
                space_sums = np.zeros(len(texts.data) + 1, np.int64)
                np.cumsum((texts.data & 0xC0) != 0x80, out=space_sums[1:])
                chars = _per_text(space_sums[ends] - space_sums[starts], borders)
                first, last, among = texts.lines()
                filled = np.searchsorted(starts, last) > np.searchsorted(starts, first)
                kept_at = np.concatenate([[0], np.cumsum(filled)])[among]
                _, later = _repeated(_own(texts.hashes(first[filled], last[filled]), kept_at))
                run, run_at = windows(texts.hashes(starts, ends), borders, 3)
                again, _ = _repeated(_own(run, run_at))
                runs = np.diff(run_at)
                again &= np.repeat(words >= 3, runs)
                step = np.zeros(len(starts) + 4, np.int64)
                here = (np.repeat(borders[:-1] - run_at[:-1], runs) + np.arange(len(run)))[again]
                np.add.at(step, here, 1)
                np.add.at(step, here + 3, -1)
                covered = np.cumsum(step)[: len(starts)] > 0
                found.append(
                    [
                        words,
                        chars,
                        texts.count(SYMBOL[texts.data]),
                        _per_text(later, kept_at),
                        _per_text(covered, borders),
                        np.diff(kept_at),
                        texts.count(CAPITAL[texts.data]),
                    ]
                )
            columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * len(COUNTS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array(c, pa.int64()) for c in columns], *batch.columns[3:]],
                names=["doc_id", "stratum", *COUNTS, *inner],
            )

    inner = [f"carry_{i}" for i in range(len(carry))]
    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        F.col(stratum).cast("string").alias("stratum"),
        F.col(text).alias("text"),
        *[F.col(c).alias(i) for c, i in zip(carry, inner)],
    )
    more = "".join(f", {f.name} {f.dataType.simpleString()}" for f in rows.schema[3:])
    out = map_arrow(rows, measure, "doc_id long, stratum string, " + ", ".join(f"{c} long" for c in COUNTS) + more)
    if not carry:
        return out
    return out.select("doc_id", "stratum", *COUNTS, F.struct(*[F.col(i).alias(c) for c, i in zip(carry, inner)]).alias("carried"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def binomial_tail(k: int, n: int, rate: float) -> float:
    """P(X <= k) for X binomial(n, rate)."""
    return sum(
        math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(rate) + (n - i) * math.log1p(-rate))
        for i in range(k + 1)
    )


def allowed(rejected: list[int], n: int, rate: float, level: float) -> int:
    """How many cutoffs of a list, loosest first, pass the test one after the other."""
    for passed, k in enumerate(rejected):
        # far above the mean the test cannot pass, and the sum would be long
        if k > n * rate or binomial_tail(k, n, rate) > level:
            return passed
    return len(rejected)


def choose_cutoffs(good: DataFrame, limit: float = LIMIT, risk: float = RISK) -> dict[str | None, dict[str, int]]:
    """Cutoffs by stratum and rule from the counts of labelled good texts.

    Only a table of strata by rules by cutoffs reaches the driver.
    """
    def above(a: str, b: str, c: int) -> Column:
        return F.sum(F.when(100 * F.col(a) > c * F.col(b), 1).otherwise(0)).alias(f"{a}:{b}:{c}")

    sums = [above(a, b, c) for a, b, grid in RULES.values() for c in grid]
    rows = good.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *sums).collect()
    level, rate = risk / (len(RULES) * max(1, len(rows))), limit / len(RULES)
    chosen: dict[str | None, dict[str, int]] = {}
    for row in rows:
        for rule, (a, b, grid) in RULES.items():
            passed = allowed([row[f"{a}:{b}:{c}"] for c in grid], row["n"], rate, level)
            if passed:
                chosen.setdefault(row["stratum"], {})[rule] = grid[passed - 1]
    return chosen


def judge(measured: DataFrame, cutoffs: dict[str | None, dict[str, int]]) -> DataFrame:
    """Adds base_failed, kept and the list of rules that reject."""
    spark = measured.sparkSession
    rows = [(s is not None, s or "", [c.get(r) for r in RULES]) for s, c in cutoffs.items()]
    small = spark.createDataFrame(rows, "known boolean, own string, cutoffs array<int>")
    small = F.broadcast(small) if len(rows) <= FEW_STRATA else small
    broken = [
        F.when(100 * F.col(a) > F.get("cutoffs", F.lit(i)) * F.col(b), F.lit(rule)) for i, (rule, (a, b, _)) in enumerate(RULES.items())
    ]
    joined = measured.withColumn("known", F.col("stratum").isNotNull()).withColumn("own", F.coalesce("stratum", F.lit("")))
    joined = joined.join(small, ["known", "own"], "left").withColumn("rejected_by", F.array_compact(F.array(*broken)))
    joined = joined.withColumn("base_failed", base_failed())
    return joined.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0)).drop("known", "own", "cutoffs")


def good_texts(measured: DataFrame, labels: DataFrame) -> DataFrame:
    """The measured texts that a label calls good and the base rules pass."""
    marked = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality")).filter("quality = 1")
    return measured.filter(~base_failed()).join(marked.select("doc_id"), "doc_id")


def quality_rules(docs: DataFrame, labels: DataFrame, limit: float = LIMIT, risk: float = RISK, carry: tuple[str, ...] = ()) -> DataFrame:
    """Every document with its counts, base_failed, kept, rejected_by and, if columns are carried, the struct ``carried``.

    The counts are written once. With carried columns they are counted again on
    the way of the whole rows, which costs less than joining these.
    """
    measured = cut(counts(docs))
    cutoffs = choose_cutoffs(good_texts(measured, labels), limit, risk)
    return judge(counts(docs, carry=carry) if carry else measured, cutoffs)


def _sql() -> str:
    grid = " union all ".join(
        f"select '{rule}' as rule, {c} as cutoff, sum((100 * {a} > {c} * {b})::int) as k, count(*) as n, lang from good group by lang"
        for rule, (a, b, cutoffs) in RULES.items()
        for c in cutoffs
    )
    verdict = " or ".join(
        f"coalesce(100 * {a} > (select min(cutoff) from chosen where rule = '{rule}' and chosen.lang is not distinct from m.lang) * {b}, false)"
        for rule, (a, b, _) in RULES.items()
    )
    rate, level = LIMIT / len(RULES), RISK / len(RULES)
    return rf"""
with docs as (select row_number() over () as num, doc_id, lang, coalesce(text, '') as text from documents),
worded as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words from docs),
lines as (
  select num, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines
  from (select num, unnest(string_split(text, chr(10))) as line from docs)
  where regexp_matches(line, '[^\x20\x09-\x0D]') group by num),
runs as (
  select num, spot, words[spot:spot + 2] as run
  from (select num, words, unnest(range(1, len(words) - 1)) as spot from worded)),
again as (select num, unnest([spot, spot + 1, spot + 2]) as word from (select *, count(*) over (partition by num, run) as n from runs) where n > 1),
repeats as (select num, count(distinct word) as n_repeat_words from again group by num),
measured as (
  select doc_id, lang, len(words) as n_words, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::bigint as word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines,
         coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(n_lines, 0) as n_lines,
         length(regexp_replace(text, '[^A-Z]', '', 'g')) as n_capitals
  from worded left join lines using (num) left join repeats using (num)),
m as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from measured),
good as (select m.* from m join (select doc_id from labels group by doc_id having min(quality) = 1) using (doc_id) where not base_failed),
grid as ({grid}),
chosen as (
  select rule, cutoff, lang from grid
  where k <= n * {rate} and list_sum(list_transform(range(0, k::bigint + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)
    + i * ln({rate}) + (n - i) * ln(1 - {rate})))) <= {level} / (select count(distinct coalesce(lang, chr(0))) from good))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not ({verdict}) as kept
from m
"""


@query("op5_rules", _sql())
def op5_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
