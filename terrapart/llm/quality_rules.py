"""Quality rules: document statistics and cross-document line frequency, in DataFrame expressions only.

Lines are normalised (lower case, single spaces) and hashed; for each host the distinct documents (by doc_id,
or by content where that is null) that hold a line are counted, exact copies included. A line held by more than ``max_line_docs`` documents and more than ``max_line_percent`` percent of its host's
documents is removed. A document that keeps less than ``min_left_percent`` percent of its words is depleted.

Scale: texts never move. What is shuffled is one narrow row for each line; counts are combined before each
shuffle, and the join that marks removed lines is salted, so that a line or host with a third of all rows
is spread over many tasks. Memory in a task follows its longest document.

Edge cases: null text counts as empty (no words, base_failed); a null source is a host of its own; null and
repeated doc_ids are allowed, since rows are identified by id and content; rows repeated in full get equal
results; input columns named like a result are replaced; an empty table gives an empty result. Three-word
windows are compared by 64-bit hashes within one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapart.llm.common import WORD_BREAKS, let, text_of, words_of

#: Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

SALTS = 32
#: What tells documents apart: the id, and for null ids the content.
DOCUMENT = ["__tp_id", "__tp_content"]
RESULTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed_words", "n_removed_lines", "kept"]


def repeat_words(words: Column) -> Column:
    """Words that lie in three-word windows found twice or more among words."""

    def covered(w: Column) -> Column:
        windows = F.when(
            F.size(w) >= 3,
            F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(w[i], w[i + 1], w[i + 2]).alias("h"), i.alias("i"))),
        ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
        twice = let(F.sort_array(windows), lambda s: F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])))
        places = F.sort_array(F.transform(twice, lambda x: x["i"]))
        gaps = let(places, lambda p: F.transform(p, lambda v, i: F.least(F.lit(3), v - F.get(p, i - 1))))
        return F.aggregate(gaps, F.lit(0), lambda total, gap: total + gap).cast("long")

    return let(words, covered)


def normalised(line: Column) -> Column:
    return F.lower(F.array_join(words_of(line), " "))


def dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def statistics(docs: DataFrame) -> DataFrame:
    """docs with the base statistics and base_failed; text is read once and leaves no wide column behind."""
    text = F.col("__tp_text")
    stats = (
        docs.withColumn("__tp_text", text_of())
        .withColumn("__tp_words", words_of(text))
        .withColumn("n_words", F.size("__tp_words").cast("long"))
        .withColumn("n_repeat_words", repeat_words(F.col("__tp_words")))
        .withColumn("word_chars", F.length(F.translate(text, WORD_BREAKS + " ", "")).cast("long"))
        .withColumn("n_symbols", (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"))
        .withColumn("n_dup_lines", dup_lines(text))
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return stats.withColumn("base_failed", failed).drop("__tp_text", "__tp_words")


def identified(docs: DataFrame) -> DataFrame:
    """docs with a row identity that takes null and repeated ids, and the text's hash."""
    return docs.withColumns(
        {
            "__tp_id": F.coalesce(F.col("doc_id"), F.lit(-(2**63))),
            "__tp_row": F.xxhash64(F.col("source"), F.lit(0), F.col("text"), F.col("doc_id").isNull()),
            "__tp_content": F.when(F.col("doc_id").isNull(), F.xxhash64(text_of())).otherwise(F.lit(0)),
            "__tp_host": F.coalesce(F.col("source"), F.lit("\x00")),
        }
    )


def line_occurrences(docs: DataFrame) -> DataFrame:
    """A row for each line with a word: row identity, host, content, place, line hash and number of words."""
    facts = F.transform(F.split(text_of(), "\n"), lambda line: F.struct(F.xxhash64(normalised(line)).alias("h"), F.size(words_of(line)).alias("w")))
    return (
        identified(docs)
        .select("__tp_id", "__tp_row", "__tp_content", "__tp_host", F.posexplode(facts).alias("__tp_at", "__tp_line"))
        .select("__tp_id", "__tp_row", "__tp_content", "__tp_host", "__tp_at", F.col("__tp_line.h").alias("__tp_h"), F.col("__tp_line.w").alias("__tp_w"))
        .filter("__tp_w > 0")
    )


def frequent_lines(docs: DataFrame, max_line_docs: int, max_line_percent: float) -> DataFrame:
    """(host, line hash) above both limits."""
    lines = line_occurrences(docs)
    counted = lines.groupBy("__tp_host", "__tp_h", *DOCUMENT).agg(F.lit(1).alias("__tp_one")).groupBy("__tp_host", "__tp_h").agg(F.count("*").alias("__tp_docs"))
    hosts = (
        identified(docs)
        .groupBy("__tp_host", *DOCUMENT)
        .agg(F.lit(1).alias("__tp_one"))
        .groupBy("__tp_host")
        .agg(F.count("*").alias("__tp_host_docs"))
    )
    return (
        counted.filter(F.col("__tp_docs") > max_line_docs)
        .join(hosts, "__tp_host")
        .filter(F.col("__tp_docs") * 100 > F.col("__tp_host_docs") * F.lit(float(max_line_percent)))
        .select("__tp_host", "__tp_h")
    )


def removed_lines(docs: DataFrame, max_line_docs: int, max_line_percent: float) -> DataFrame:
    """For each document with removed lines: their places and their number of words."""
    salted = frequent_lines(docs, max_line_docs, max_line_percent).withColumn("__tp_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    lines = line_occurrences(docs).withColumn("__tp_salt", F.pmod(F.xxhash64("__tp_id", "__tp_row"), F.lit(SALTS)).cast("int"))
    hits = lines.join(salted, ["__tp_host", "__tp_h", "__tp_salt"])
    once = hits.groupBy("__tp_id", "__tp_row", "__tp_at").agg(F.first("__tp_w").alias("__tp_w"))
    return once.groupBy("__tp_id", "__tp_row").agg(
        F.sum("__tp_w").alias("__tp_gone_words"), F.count("*").alias("__tp_gone_lines"), F.collect_list("__tp_at").alias("__tp_gone")
    )


def quality_rules(docs: DataFrame, max_line_docs: int = 20, max_line_percent: float = 2.0, min_left_percent: float = 30.0) -> DataFrame:
    """docs with RESULTS added: statistics, base_failed, what was removed, and kept.

    kept: not base_failed, and at least min_left_percent percent of the words are left. The column
    ``clean_text`` is the text without its removed lines (null stays null).
    """
    gone = removed_lines(docs.select("doc_id", "text", "source"), max_line_docs, max_line_percent)
    scored = identified(statistics(docs)).join(gone, ["__tp_id", "__tp_row"], "left")
    lines = F.split(F.col("text"), "\n")
    left = let(lines, lambda x: F.array_join(F.transform(F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("__tp_gone"))), lambda i: x[i]), "\n"))
    left_words = F.col("n_words") - F.col("n_removed_words")
    return (
        scored.withColumn("n_removed_words", F.coalesce("__tp_gone_words", F.lit(0)).cast("long"))
        .withColumn("n_removed_lines", F.coalesce("__tp_gone_lines", F.lit(0)).cast("long"))
        .withColumn("kept", ~F.col("base_failed") & (left_words * 100 >= F.col("n_words") * F.lit(float(min_left_percent))))
        .withColumn("clean_text", F.when(F.col("__tp_gone").isNull(), F.col("text")).otherwise(left))
        .drop("__tp_id", "__tp_row", "__tp_content", "__tp_host", "__tp_gone", "__tp_gone_words", "__tp_gone_lines")
    )


def passed(scored: DataFrame) -> DataFrame:
    """The kept rows. The condition is opaque on purpose, or the planner would move it below the join and compute the statistics a second time."""
    return scored.filter(F.when(F.rand(0) >= 0, F.col("kept")))


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_rules(docs).select("doc_id", *RESULTS)


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), windows AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
), twice AS (
  SELECT doc_id, unnest([i, i + 1, i + 2]) AS p
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1
), repeats AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM twice GROUP BY doc_id
), lines AS (
  SELECT doc_id, source, t, line,
         lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'), ' ')) AS k,
         len(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS nw
  FROM (SELECT doc_id, source, t, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), dups AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines GROUP BY doc_id
), hosts AS (
  SELECT source, count(DISTINCT doc_id) AS host_docs FROM d GROUP BY source
), frequent AS (
  SELECT l.source, l.k FROM (SELECT source, k, count(DISTINCT doc_id) AS n FROM lines GROUP BY source, k) l
  JOIN hosts h ON l.source IS NOT DISTINCT FROM h.source
  WHERE l.n > 20 AND l.n * 100 > h.host_docs * 2.0
), removed AS (
  SELECT l.doc_id, sum(l.nw) AS n_removed_words, count(*) AS n_removed_lines
  FROM lines l JOIN frequent f ON l.k = f.k AND l.source IS NOT DISTINCT FROM f.source GROUP BY l.doc_id
), s AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         coalesce(n_removed_words, 0)::BIGINT AS n_removed_words, coalesce(n_removed_lines, 0)::BIGINT AS n_removed_lines
  FROM d LEFT JOIN repeats USING (doc_id) LEFT JOIN dups USING (doc_id) LEFT JOIN removed USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_removed_words, n_removed_lines,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
         AND (n_words - n_removed_words) * 100 >= n_words * 30.0 AS kept
FROM s
"""
