"""Line-first quality rules: bad lines go first, then documents that lost too much of their text.

Everything is computed inside the row by array functions, so nothing is shuffled and a long document costs n log n. Only DataFrame
functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.llm.columns import let, packed, quoted, unpacked
from candela.llm.registry import query, table

SPACE = " \t\n\x0b\x0c\r"
GAP, WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
# Phrases of boilerplate lines, in any case.
BOILERPLATE = (
    "all rights reserved|copyright|licensed under|terms of use|terms of service|privacy policy|cookie|javascript|click here|"
    "subscribe|sign up|log in|read more|lorem ipsum"
)
TERMINAL = r"[.!?…:;][\x22'”’»)\]]*[\x20\x09-\x0D]*$"
NOISE = r"[#*$%&|<>•·]|!!"
FEW_WORDS = 10  # a line without a closing mark is a fragment if it has fewer words than this
NOISE_SHARE = 30  # percent of a line's words that may carry noise marks
LOST_SHARE = 50  # percent of a document's words that may go with bad lines
RESULTS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "clean_words", "clean_text", "kept",
]


def count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def bad_line(line: Column) -> Column:
    """Whether a line fails the rules: navigation or symbol noise, boilerplate, or a short line without a closing mark.
    Lines without words are not bad: they carry no text."""
    words = count_words(line)
    noisy = 100 * F.regexp_count(line, F.lit(NOISE)) > NOISE_SHARE * words
    fragment = (words < FEW_WORDS) & ~line.rlike(TERMINAL)
    return (words > 0) & (noisy | fragment | line.rlike(f"(?i)({BOILERPLATE})"))


def repeated_words(words: Column, window: int = 8) -> Column:
    """How many words stand in windows of ``window`` words that occur twice or more in the array, first occurrences included.

    Windows are compared by 64-bit hashes. Only if some are equal, they are sorted to find which.
    """

    def covered(hashes: Column) -> Column:
        order = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(pairs: Column) -> Column:
            twice = F.filter(
                pairs,
                lambda e, i: (F.get(pairs, i - 1).h == e.h) | (F.get(pairs, i + 1).h == e.h),
            )
            return F.sort_array(F.transform(twice, lambda e: e.i))

        def width(at: Column) -> Column:
            return F.aggregate(
                F.transform(at, lambda p, i: F.least(F.lit(window), F.coalesce(F.get(at, i + 1) - p, F.lit(window)))),
                F.lit(0),
                lambda total, x: total + x,
            )

        return let(order, lambda pairs: let(starts(pairs), width))

    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (window - 1)), lambda i: F.xxhash64(F.slice(words, i, window)))
    return F.when(F.size(words) < window, 0).otherwise(
        let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))
    )


def judge(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every document with its counts, ``base_failed``, the text left by the line rules (``clean_text``, its words in
    ``clean_words``) and ``kept``.

    ``base_failed``: fewer than 20 words, or more than 30 % of the words repeat. ``kept``: base rules met, and at most half of the
    words went with bad lines. Null text counts as empty: no words, hence base_failed and not kept. Repeated rows stay, each judged
    alike; empty tables give empty results; input columns named like a result are replaced by it, all others are kept.
    """
    body = F.coalesce(F.col(quoted(text)), F.lit(""))
    words = F.array_remove(F.split(body, GAP), "")
    lines = F.split(body, "\n")
    full = F.filter(lines, lambda line: line.rlike(WORD))
    measured = packed(
        docs,
        body.alias("body"),
        let(
            words, lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).cast("long").alias("again"))
        ).alias("w"),
        let(full, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        F.char_length(F.translate(body, SPACE, "")).cast("long").alias("word_chars"),
        (F.char_length(body) - F.char_length(F.translate(body, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.array_join(F.filter(lines, lambda line: ~bad_line(line)), "\n").alias("clean_text"),
    )
    counted = measured.select(
        "*",
        F.col("w.n").alias("n_words"),
        F.col("w.again").alias("n_repeat_words"),
        count_words(F.col("clean_text")).cast("long").alias("clean_words"),
    )
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    lost = 100 * (F.col("n_words") - F.col("clean_words")) > LOST_SHARE * F.col("n_words")
    judged = counted.select("*", failed.alias("base_failed"), (~failed & ~lost).alias("kept"))
    return unpacked(judged, docs.columns, RESULTS)


@query(
    "op2_quality_rules",
    r"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS body FROM documents),
w AS (SELECT n, doc_id, body, list_filter(string_split_regex(body, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
  list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT n, unnest(range(1, len(words) - 6)) AS p, words FROM w WHERE len(words) >= 8),
k AS (SELECT n, p, array_to_string(words[p:p + 7], ' ') AS s FROM win),
twice AS (SELECT n, s FROM k GROUP BY n, s HAVING count(*) > 1),
again AS (SELECT n, count(DISTINCT q) AS again FROM (SELECT n, unnest(range(p, p + 8)) AS q FROM k JOIN twice USING (n, s))
  GROUP BY n),
line AS (SELECT n, unnest(lines) AS x FROM w),
line_words AS (SELECT n, x, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS lw FROM line),
clean AS (SELECT n, sum(lw) AS clean_words FROM line_words
  WHERE NOT (100 * len(regexp_extract_all(x, '[#*$%&|<>•·]|!!')) > 30 * lw
    OR (lw < 10 AND NOT regexp_matches(x, '[.!?…:;][\x22''”’»)\]]*[\x20\x09-\x0D]*$'))
    OR regexp_matches(x, '(?i)(all rights reserved|copyright|licensed under|terms of use|terms of service|privacy policy|cookie|javascript|click here|subscribe|sign up|log in|read more|lorem ipsum)'))
  GROUP BY n),
c AS (SELECT doc_id, len(words) AS n_words, coalesce(again, 0) AS n_repeat_words, coalesce(clean_words, 0) AS clean_words,
  length(regexp_replace(body, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
  length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines FROM w LEFT JOIN again USING (n) LEFT JOIN clean USING (n)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
  CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND NOT 100 * (n_words - clean_words) > 50 * n_words AS kept FROM f""",
)
def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
