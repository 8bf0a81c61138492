"""Quality rules as a short-circuit cascade of column expressions.

Every rule is a boolean column.  Cost and selectivity of the rules outside the base are measured on a
sample, and the rules then stand in one CASE expression, ordered by rejections per unit of cost, so
that a text rejected early never pays for the rest.  A text is kept only if no rule rejects it, so the
order changes the time and the name of the first reason, never the verdict.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.tables import written

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]+"
WINDOW = 8
SAMPLE_ROWS = 1000
#: Thresholds of the rules.
MOST_SYMBOLS = 0.3
MOST_CAPITALS = 0.5
WORD_LENGTH = (2.0, 20.0)
MOST_DUP_LINES = 0.5
LEAST_LETTERS = 0.5
MOST_BULLETS = 0.9


def _repeated_words(words: Column, hashes: Column) -> Column:
    """Words covered by the windows whose hash occurs twice or more among ``hashes``."""
    # windows beside an equal one in the order of their hashes, back in the order of the text
    ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = F.transform(
        F.array(ordered),
        lambda s: F.sort_array(F.transform(
            F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]).eqNullSafe(True) | (F.get(s, k + 1)["h"] == x["h"]).eqNullSafe(True)),
            lambda x: x["i"],
        )),
    )[0]
    spans = F.transform(
        F.array(twice),
        lambda p: F.aggregate(
            F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))),
            F.lit(0), lambda total, x: total + x,
        ),
    )[0]
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), spans).otherwise(0).cast("long")


def _joined(column: str, ahead: int) -> Column:
    """Hash of each element with the one ``ahead`` places on.

    The lambda names no other column: a filter that the optimizer moves below this projection would
    put that column's expression inside the loop.
    """
    return F.zip_with(column, F.slice(column, ahead + 1, F.size(column)), lambda a, b: F.xxhash64(a, b))


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, the text as ``_text`` and the base counts (see ``quality_rules``)."""
    lines = F.filter(F.split("_text", "\n"), lambda x: F.rlike(x, F.lit(WORD)))
    return (
        docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
        .withColumn("_words", F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)))
        .withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("_ones", F.transform("_words", lambda w: F.xxhash64(w)))
        .withColumn("_twos", _joined("_ones", 1))
        .withColumn("_fours", _joined("_twos", 2))
        .withColumn("_hashes", F.slice(_joined("_fours", 4), 1, F.greatest(F.size("_words") - (WINDOW - 1), F.lit(0))))
        .withColumn("_lines", lines)
        .select(
            "doc_id", "_text", "n_words",
            F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
            (F.octet_length("_text") - F.octet_length(F.regexp_replace("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
            F.size("_lines").cast("long").alias("n_lines"),
            (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
            _repeated_words(F.col("_words"), F.col("_hashes")).alias("n_repeat_words"),
        )
        .withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    )


def _share_without(pattern: str) -> Column:
    """Share of the text's characters that match."""
    n = F.char_length("_text")
    return (n - F.char_length(F.regexp_replace("_text", pattern, ""))) / F.greatest(n, F.lit(1))


def rules() -> dict[str, Column]:
    """Rejecting conditions over ``measures`` of texts that pass the base."""
    mean = F.col("word_chars") / F.greatest("n_words", F.lit(1))
    return {
        "symbols": F.col("n_symbols") > MOST_SYMBOLS * F.col("n_words"),
        "word_length": (mean < WORD_LENGTH[0]) | (mean > WORD_LENGTH[1]),
        "dup_lines": F.col("n_dup_lines") > MOST_DUP_LINES * F.col("n_lines"),
        "capitals": _share_without(r"\p{Lu}+") > MOST_CAPITALS,
        "letters": _share_without(r"\p{L}+") < LEAST_LETTERS,
        "bullets": F.regexp_count("_text", F.lit(r"(?m)^[\x20\x09]*[-*•]")) > MOST_BULLETS * F.col("n_lines"),
    }


def measured_order(docs: DataFrame, conditions: dict[str, Column], sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Rule names by rejections per second, both measured on a sample of about ``sample_rows`` rows."""
    share = min(1.0, sample_rows / max(1, docs.count()))
    sample = written(docs.sparkSession, measures(docs.sample(share, seed=7)), "sample").filter(~F.col("base_failed"))
    gain = {}
    for name, rule in conditions.items():
        rejected = sample.agg(F.count_if(rule))
        rejected.collect()  # compiles
        began = time.perf_counter()
        n = rejected.collect()[0][0]
        gain[name] = n / max(time.perf_counter() - began, 1e-6)
    return sorted(conditions, key=lambda name: -gain[name])


def cascade(order: list[str], conditions: dict[str, Column]) -> Column:
    """Name of the first rule that rejects, null if none does."""
    out = F.when(F.col("base_failed"), F.lit("base"))
    for name in order:
        out = out.when(conditions[name], F.lit(name))
    return out


def quality_rules(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, and ``reason``, the first rule that rejected.

    Words are ``[^\\x20\\x09-\\x0D]+``.  A null text counts as empty: zeros, base_failed, not kept.
    Repeated rows and null ids are rows like any other, other columns are ignored, an empty table
    gives no rows.  All work is per row in the JVM, without a shuffle; the sample only sets the order.
    """
    conditions = rules()
    return (
        measures(docs)
        .withColumn("reason", cascade(measured_order(docs, conditions, sample_rows), conditions))
        .select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
            F.col("reason").isNull().alias("kept"), "reason",
        )
    )


#: The counts and the verdict in DuckDB; without the reason, whose name depends on the measured order.
SQL = f"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l,
         row_number() OVER () AS rn
  FROM documents
), windows AS (
  SELECT rn, i, array_to_string(w[i:i + 7], ' ') AS win
  FROM (SELECT rn, w, unnest(generate_series(1, len(w) - 7)) AS i FROM base WHERE len(w) >= 8)
), twice AS (
  SELECT rn, unnest(list(i)) AS i FROM windows GROUP BY rn, win HAVING count(*) >= 2
), hit AS (
  SELECT rn, count(DISTINCT i + k) AS n FROM twice, range(8) AS r(k) GROUP BY rn
), counts AS (
  SELECT doc_id, t, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (strlen(t) - strlen(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM base LEFT JOIN hit USING (rn)
), judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counts
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR n_symbols > {MOST_SYMBOLS} * n_words
    OR word_chars / greatest(n_words, 1) < {WORD_LENGTH[0]} OR word_chars / greatest(n_words, 1) > {WORD_LENGTH[1]}
    OR n_dup_lines > {MOST_DUP_LINES} * n_lines
    OR 1 - length(regexp_replace(t, '\\p{{Lu}}', '', 'g')) / greatest(length(t), 1) > {MOST_CAPITALS}
    OR 1 - length(regexp_replace(t, '\\p{{L}}', '', 'g')) / greatest(length(t), 1) < {LEAST_LETTERS}
    OR len(regexp_extract_all(t, '(?m)^[\\x20\\x09]*[-*•]')) > {MOST_BULLETS} * n_lines) AS kept
FROM judged
"""
