"""Quality rules judged per host: failures are counted by host and rule, rates are shrunk towards an
empirical beta prior over all hosts, and the verdict on a host goes back to its documents.

Everything is DataFrame work.  Hosts are aggregated with partial sums before the shuffle.  For the join
back the rows of a host are dealt to parts and its verdict stands in each of them, so a host with a
third of all rows is shared out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.scratch import stage

#: Rules on the counts of one document; a document that breaks one counts as a failure of its host.
RULES = {
    "short": "n_words < 50",
    "repeats": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "lines": "10 * n_dup_lines > 3 * n_lines",
    "word_length": "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 12 * n_words)",
}
BASE = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"
PARTS = 64
WHITE = "[\\\\x20\\\\x09-\\\\x0D]+"


def measure(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """Counts of each document: ``doc_id, host, n_words, word_chars, n_symbols, n_lines, n_dup_lines,
    n_repeat_words``.

    A null text has no words.  Repeated windows are found within the row: windows are sorted with
    their positions, equal neighbours give the repeated positions, and the gaps between those the
    number of words they cover.  Windows are compared as text, their hash only speeds up the sort.
    """
    steps = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(host).cast("string").alias("host"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("body"),
    )
    steps = steps.select(
        "doc_id", "host",
        F.expr(f"array_remove(split(body, '{WHITE}'), '')").alias("words"),
        F.expr("regexp_count(body, '[#*$%&|<>]')").alias("n_symbols"),
        F.expr("filter(split(body, '\\\\n'), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]')").alias("lines"),
    )
    steps = steps.select(
        "doc_id", "host", "n_symbols", F.size("words").alias("n_words"),
        F.length(F.array_join("words", "")).alias("word_chars"), F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.expr(
            "CASE WHEN size(words) < 3 THEN NULL ELSE transform(sequence(0, size(words) - 3),"
            " i -> concat_ws(' ', words[i], words[i + 1], words[i + 2])) END"
        ).alias("windows"),
    )
    steps = steps.withColumn(
        "sorted", F.expr("sort_array(transform(windows, (w, i) -> struct(xxhash64(w) AS h, w AS w, i AS i)))")
    ).drop("windows")
    steps = steps.withColumn(
        "again",
        F.expr(
            "sort_array(filter(transform(sorted, (x, j) -> CASE WHEN x.w = get(sorted, j - 1).w"
            " OR x.w = get(sorted, j + 1).w THEN x.i END), p -> p IS NOT NULL))"
        ),
    ).drop("sorted")
    covered = F.expr(
        "CASE WHEN size(again) > 0 THEN 3 + aggregate(transform(again, (p, j) ->"
        " CASE WHEN j = 0 THEN 0 ELSE least(3, p - get(again, j - 1)) END), 0, (a, x) -> a + x) ELSE 0 END"
    )
    return steps.withColumn("n_repeat_words", covered).select(
        "doc_id", "host",
        *[F.col(c).cast("bigint") for c in
          ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")],
    )


def host_verdicts(measured: DataFrame, rules: dict[str, str] = RULES, max_rate: float = 0.5) -> DataFrame:
    """One row per host: ``host, host_docs, worst_rule, worst_rate, host_failed``.

    For each rule the prior is fitted by moments: mean ``m`` is the overall rate, and the strength
    follows from the variance of the rates between hosts beyond what the sizes of hosts explain.
    Without such variance all hosts get the overall rate.  A host fails when its worst shrunk rate is
    above ``max_rate``.  Rows without a host get no verdict.
    """
    named = measured.filter("host IS NOT NULL")
    sums = named.groupBy("host").agg(
        F.count("*").alias("n"),
        *[F.sum(F.expr(f"CASE WHEN {rule} THEN 1 ELSE 0 END")).alias(name) for name, rule in rules.items()],
    )
    stack = ", ".join(f"'{name}', {name}" for name in rules)
    cells = sums.selectExpr("host", "n", f"stack({len(rules)}, {stack}) AS (rule, failed)")
    prior = cells.groupBy("rule").agg(
        (F.sum("failed") / F.sum("n")).alias("m"),
        (F.sum(F.col("failed") * F.col("failed") / F.col("n")) / F.sum("n")).alias("square"),
        (F.count("*") / F.sum("n")).alias("hosts_per_doc"),
    ).selectExpr(
        "rule", "m", "greatest(square - m * m - m * (1 - m) * hosts_per_doc, 0) AS between",
    ).selectExpr(
        "rule", "m", "CASE WHEN between > 1e-12 THEN greatest(m * (1 - m) / between - 1, 1) END AS strength",
    )
    rates = cells.join(prior, "rule").selectExpr(
        "host", "n", "rule",
        "CASE WHEN strength IS NULL THEN m ELSE (failed + strength * m) / (n + strength) END AS rate",
    )
    return rates.groupBy("host").agg(
        F.max("n").alias("host_docs"),
        F.max(F.struct("rate", "rule")).alias("worst"),
    ).select(
        "host", "host_docs", F.col("worst.rule").alias("worst_rule"), F.col("worst.rate").alias("worst_rate"),
        (F.col("worst.rate") > max_rate).alias("host_failed"),
    )


def judge(docs: DataFrame, max_rate: float = 0.5, doc_id: str = "doc_id", text: str = "text",
          host: str = "source") -> DataFrame:
    """The counts of every row with ``base_failed``, the verdict on its host, and ``kept``.

    Repeated rows are judged one by one.  A row without a host is judged by itself.  Other columns are
    ignored; no rows give no rows.
    """
    measured = stage(measure(docs, doc_id, text, host), "host-rules")
    verdicts = host_verdicts(measured, max_rate=max_rate).withColumn(
        "part", F.explode(F.expr(f"sequence(0, {PARTS - 1})")))
    base = measured.withColumn("base_failed", F.expr(BASE)).withColumn(
        "part", F.expr(f"cast(pmod(xxhash64(doc_id, n_words, word_chars), {PARTS}) AS int)"))
    return base.join(verdicts, ["host", "part"], "left").drop("part").withColumn(
        "kept", ~F.col("base_failed") & ~F.coalesce(F.col("host_failed"), F.lit(False))
    )


def op2(docs: DataFrame) -> DataFrame:
    return judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_lines", "worst_rule",
    )


OP2_SQL = """
WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS body FROM documents),
w AS (SELECT doc_id, host, body, regexp_extract_all(body, '[^\\x20\\x09-\\x0D]+') AS words,
    list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
win AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cover AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY 1),
m AS (SELECT w.doc_id, host, CAST(len(words) AS bigint) AS n_words,
    CAST(length(array_to_string(words, '')) AS bigint) AS word_chars,
    CAST(len(regexp_extract_all(body, '[#*$%&|<>]')) AS bigint) AS n_symbols, CAST(len(lines) AS bigint) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS bigint) AS n_dup_lines,
    CAST(coalesce(c.n, 0) AS bigint) AS n_repeat_words FROM w LEFT JOIN cover c ON c.doc_id = w.doc_id),
cells AS (SELECT host, rule, count(*) AS n, sum(CASE WHEN failed THEN 1 ELSE 0 END) AS failed FROM (
    SELECT host, unnest(['short', 'repeats', 'symbols', 'lines', 'word_length']) AS rule,
      unnest([n_words < 50, 100 * n_repeat_words > 50 * n_words, 10 * n_symbols > n_words,
        10 * n_dup_lines > 3 * n_lines,
        n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 12 * n_words)]) AS failed
    FROM m WHERE host IS NOT NULL) GROUP BY 1, 2),
moments AS (SELECT rule, sum(failed) / sum(n) AS m, sum(failed * failed / n) / sum(n) AS square,
    count(*) / sum(n) AS per_doc FROM cells GROUP BY 1),
prior AS (SELECT rule, m, CASE WHEN square - m * m - m * (1 - m) * per_doc > 1e-12
    THEN greatest(m * (1 - m) / (square - m * m - m * (1 - m) * per_doc) - 1, 1) END AS strength FROM moments),
rates AS (SELECT host, rule, CASE WHEN strength IS NULL THEN m ELSE (failed + strength * m) / (n + strength) END AS rate
    FROM cells JOIN prior USING (rule)),
verdict AS (SELECT host, max(rate) > 0.5 AS host_failed,
    max({'rate': rate, 'rule': rule})['rule'] AS worst_rule FROM rates GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT coalesce(host_failed, false) AS kept,
  n_lines, worst_rule
FROM m LEFT JOIN verdict USING (host)
"""
