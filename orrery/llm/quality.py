"""Quality rules: a threshold table compiled into one Spark projection, without user functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import WORD

#: Frequent function words of the corpus languages.
STOP_WORDS = (
    "the of and to in a is that for it was on with as are by this be or not at from but have "
    "der die das und in den von zu mit sich des auf ist im dem nicht ein eine als auch "
    "le la les de des et en un une du que est pour qui dans au par sur pas avec "
    "el los las y que del se por con una su para es al lo como más pero sus"
).split()
SYMBOLS = "#*$%&|<>"
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """Keep a document if ``low <= 1000 * value / per <= high``; per-mille bounds keep the arithmetic integral.

    A document whose ``per`` is 0 passes.
    """

    name: str
    value: str
    per: str
    low: int | None = None
    high: int | None = None

    def passes(self) -> Column:
        value, per = F.col(self.value) * 1000, F.col(self.per)
        ok = F.lit(True)
        if self.low is not None:
            ok = ok & (value >= per * self.low)
        if self.high is not None:
            ok = ok & (value <= per * self.high)
        return (per == 0) | ok


#: Length, symbol, stop-word and line ratios in thousandths.
RULES = (
    Rule("word_length", "word_chars", "n_words", low=2000, high=14000),
    Rule("symbols_per_word", "n_symbols", "n_words", high=100),
    Rule("stop_words", "n_stop_words", "n_words", low=5),
    Rule("repeated_lines", "n_dup_lines", "n_lines", high=500),
)


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body`` (a lambda variable is never inlined)."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(hashes: Column) -> Column:
    """Words covered by windows of ``WINDOW`` words that occur twice or more in the array."""
    zero = F.lit(0).cast("bigint")

    def count(v: Column) -> Column:
        def covered(s: Column) -> Column:
            same = lambda e, j: F.coalesce(F.get(s, j)["x"] == e["x"], F.lit(False))
            hit = F.transform(s, lambda e, j: F.when(same(e, j - 1) | same(e, j + 1), e["i"]))
            starts = F.array_sort(F.filter(hit, lambda i: i.isNotNull()))
            add = lambda a, i: F.struct((a["n"] + i + WINDOW - F.greatest(i, a["end"])).alias("n"), (i + WINDOW).alias("end"))
            return F.aggregate(starts, F.struct(zero.alias("n"), zero.alias("end")), add)["n"]

        ranked = F.array_sort(F.transform(v, lambda x, i: F.struct(x.alias("x"), i.cast("bigint").alias("i"))))
        return F.when(F.size(F.array_distinct(v)) == F.size(v), zero).otherwise(_let(ranked, covered))

    windows = F.transform(
        F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - (WINDOW - 1), F.lit(0))),
        lambda x, i: F.xxhash64(x, *(F.get(hashes, i + k) for k in range(1, WINDOW))),
    )
    return F.when(F.size(hashes) <= WINDOW, zero).otherwise(_let(windows, count))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts the rules use to every row of ``docs``; the input's other columns stay.

    A null text counts as empty: all counts are 0. A line counts if it has a word. Input columns
    that have the name of a count are replaced. Windows are compared by 64-bit hashes.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(WORD))
    line = _let(lines, lambda x: F.struct(F.size(x).cast("bigint").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines")))
    word = _let(
        F.regexp_extract_all(body, F.lit(WORD), F.lit(0)),
        lambda w: F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("bigint").alias("n_stop_words"),
            _let(F.transform(w, lambda x: F.xxhash64(x)), _repeat_words).alias("n_repeat_words"),
        ),
    )
    at = _unused(docs, "word"), _unused(docs, "line")
    out = docs.withColumns({
        at[0]: word,
        at[1]: line,
        "word_chars": F.length(F.regexp_replace(body, r"[\x20\x09-\x0D]+", "")).cast("bigint"),
        "n_symbols": F.length(F.regexp_replace(body, "[^#*$%&|<>]+", "")).cast("bigint"),
    })
    names = {"n_words": at[0], "n_stop_words": at[0], "n_repeat_words": at[0], "n_lines": at[1], "n_dup_lines": at[1]}
    return out.withColumns({k: F.col(f"`{v}`")[k] for k, v in names.items()}).drop(*at)


def _unused(docs: DataFrame, name: str) -> str:
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """``docs`` with counts, ``base_failed`` and ``kept``, compiled from ``rules`` into one projection.

    Empty or null texts fail the base rule (under 20 words). Repeated rows are judged alike and all
    stay. Texts of any length are judged whole. Columns of ``docs`` that have the name of a count or
    verdict are replaced by it, all others stay. An empty table gives an empty table.
    """
    out = measure(docs, text)
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    verdict = ~failed
    for rule in rules:
        verdict = verdict & rule.passes()
    return out.withColumns({"base_failed": failed, "kept": verdict})


def filter_quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns of ``docs``.

    The body is packed in one struct, so no column name of the input can clash.
    """
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), F.col("text"))
    return apply_rules(packed, rules).where("kept").select("__row.*")


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_stop_words", "n_repeat_words", "base_failed", "kept"]


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return apply_rules(docs).select(*COLUMNS)


OP1_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
w AS (SELECT doc_id, i, array_to_string(ws[i:i+7], ' ') AS g
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM d)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (
        SELECT doc_id, unnest(range(i, i + 8)) AS p
        FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM w) WHERE c > 1) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) AS BIGINT) AS n_lines,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(len(list_filter(ws, lambda x: lower(x) IN ({", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))}))) AS BIGINT) AS n_stop_words,
         CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 20 OR n_repeat_words * 100 > n_words * 30 AS base_failed FROM m)
SELECT *, NOT base_failed
  AND (n_words = 0 OR (word_chars * 1000 >= n_words * 2000 AND word_chars * 1000 <= n_words * 14000))
  AND (n_words = 0 OR n_symbols * 1000 <= n_words * 100)
  AND (n_words = 0 OR n_stop_words * 1000 >= n_words * 5)
  AND (n_lines = 0 OR n_dup_lines * 1000 <= n_lines * 500) AS kept
FROM b
"""
