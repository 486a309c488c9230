"""Queries p2, p4, p7, p8, p9 and p10 with their SQL for the comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions.names import canonical, micros
from loomline.llm import mixing
from loomline.llm.percentiles import combine, frequencies, percentiles
from loomline.llm.residue import find_residue
from loomline.llm.source_check import check_files, rates
from loomline.llm.tokens import encode
from loomline.llm.topn import top_n
from loomline.session import written
from loomline.sources.tables import table


# 4. newest successful runs


def _successes(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "runs").where(canonical("status") == "success")
    return runs.select(canonical("task_name").alias("task_name"), micros("started_at").alias("started"), "run_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return top_n(_successes(spark, d), "task_name", "started", ["run_id"], 3).select("task_name", "run_id")


def p4_ranked(spark: SparkSession, d: str) -> DataFrame:
    return top_n(_successes(spark, d), "task_name", "started", ["run_id"], 3).select("task_name", "run_id", F.col("rank").cast("int").alias("rank"))


# 7. durations


def _monthly(spark: SparkSession, d: str) -> DataFrame:
    """Counts of (month, task_name, us): each run once, those with both times that don't end before they start."""
    runs = table(spark, d, "runs").select(canonical("task_name").alias("task_name"), "run_id", micros("started_at").alias("s"), micros("finished_at").alias("f"))
    runs = runs.where("task_name is not null and f >= s").groupBy("task_name", "run_id", "s", "f").agg(F.lit(1).alias("one"))
    runs = runs.select(F.date_format(F.timestamp_micros("s"), "yyyy-MM").alias("month"), "task_name", (F.col("f") - F.col("s")).alias("us"))
    return frequencies(runs, ["month", "task_name"], "us")


def p7_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """The months' counts are written, combined and read off; error_ms is the stated bound."""
    months = written(_monthly(spark, d), "months")
    found = percentiles(combine(months, "task_name", "us"), "task_name", "us", (50, 90, 99))
    return found.select("task_name", "n", *[(F.col(f"p{p}") / 1000).alias(f"p{p}_ms") for p in (50, 90, 99)], F.lit(0.0).alias("error_ms"))


def p7_monthly(spark: SparkSession, d: str) -> DataFrame:
    """The same for each month."""
    both = _monthly(spark, d).select(F.to_json(F.struct("month", "task_name")).alias("g"), "us", "n")
    found = percentiles(both, "g", "us", (50, 90, 99))
    return found.select(
        F.get_json_object("g", "$.month").alias("month"), F.get_json_object("g", "$.task_name").alias("task_name"), "n", *[(F.col(f"p{p}") / 1000).alias(f"p{p}_ms") for p in (50, 90, 99)]
    )


# 2. files that do not parse


def _checked(spark: SparkSession, d: str) -> DataFrame:
    return check_files(table(spark, d, "tasks"), "file_path", "sql")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _checked(spark, d).where(F.size("faults") > 0).select(F.col("path").alias("file_path"))


def p2_faults(spark: SparkSession, d: str) -> DataFrame:
    """Every fault of every file, in order; the first is the cause that the file is reported for."""
    found = _checked(spark, d).select("path", "language", F.posexplode("faults").alias("k", "f"))
    return found.select(F.col("path").alias("file_path"), "language", (F.col("k") + 1).alias("fault_no"), "f.line", "f.message")


def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    return rates(_checked(spark, d))


# 8. token ids


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode(table(spark, d, "documents"), "text", ["doc_id"])


# 9. mixing sources


def _mixed(spark: SparkSession, d: str, corpus: bool = False) -> DataFrame:
    """corpus: ask for as many tokens as the sources with a target hold, instead of the most at which all shares hold."""
    sized, targets = written(encode(table(spark, d, "documents"), "text", ["doc_id", "source"], lengths_only=True), "sizes"), table(spark, d, "mix_targets")
    total = sized.join(F.broadcast(targets.select("source").distinct()), "source", "left_semi").agg(F.sum("n_tokens")).first()[0] if corpus else None
    return mixing.copies(sized, targets, total=total)


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(_mixed(spark, d))


def p9_schedule(spark: SparkSession, d: str) -> DataFrame:
    """Every copy with the slot in which its block goes out."""
    return _mixed(spark, d)


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(written(_mixed(spark, d), "copies"), table(spark, d, "mix_targets"))


def p9_corpus_mix(spark: SparkSession, d: str) -> DataFrame:
    """A mixture of the corpus's size: scarce sources stop at max_repeats, the others share the rest."""
    return mixing.mixture(_mixed(spark, d, corpus=True))


def p9_corpus_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares of that mixture, with what scarce sources fall short of."""
    return mixing.shares(written(_mixed(spark, d, corpus=True), "copies"), table(spark, d, "mix_targets"))


# 10. residue


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return find_residue(table(spark, d, "documents"), "doc_id", "text").select("doc_id")


def p10_residue(spark: SparkSession, d: str) -> DataFrame:
    """Where the residue is: the unit of each document that windows cover most."""
    return find_residue(table(spark, d, "documents"), "doc_id", "text")


def p10_clean(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id) of the documents that stay."""
    docs = table(spark, d, "documents")
    return docs.select("doc_id").join(find_residue(docs, "doc_id", "text").select("doc_id"), "doc_id", "left_anti")


QUERIES = {
    "p2_found": p2_found, "p2_faults": p2_faults, "p2_rates": p2_rates, "p4_found": p4_found, "p4_ranked": p4_ranked, "p7_percentiles": p7_percentiles, "p7_monthly": p7_monthly,
    "p8_ids": p8_ids, "p9_mix": p9_mix, "p9_schedule": p9_schedule, "p9_shares": p9_shares, "p9_corpus_mix": p9_corpus_mix, "p9_corpus_shares": p9_corpus_shares,
    "p10_found": p10_found, "p10_residue": p10_residue, "p10_clean": p10_clean,
}

_NAME = "nullif(lower(trim({}, ' \t\r\n')), '')"
_RANKED = f"""SELECT task_name, run_id, CAST(k AS INTEGER) AS rank FROM (
  SELECT task_name, run_id, row_number() OVER (PARTITION BY task_name ORDER BY started_at DESC, run_id) AS k FROM (
    SELECT DISTINCT {_NAME.format('task_name')} AS task_name, run_id, started_at FROM runs
    WHERE {_NAME.format('status')} = 'success' AND started_at IS NOT NULL)
  WHERE task_name IS NOT NULL) WHERE k <= 3"""


def _quantiles(keys: str) -> str:
    picks = ", ".join(f"min(ms) FILTER (k >= (n * {p} + 99) // 100) AS p{p}_ms" for p in (50, 90, 99))
    return f"""WITH r AS (SELECT DISTINCT {_NAME.format('task_name')} AS task_name, run_id, started_at, finished_at FROM runs),
v AS (SELECT task_name, strftime(started_at, '%Y-%m') AS month, (epoch_us(finished_at) - epoch_us(started_at)) / 1000.0 AS ms
      FROM r WHERE task_name IS NOT NULL AND finished_at >= started_at),
o AS (SELECT {keys}, CAST(ms AS DOUBLE) AS ms, row_number() OVER (PARTITION BY {keys} ORDER BY ms) AS k, count(*) OVER (PARTITION BY {keys}) AS n FROM v)
SELECT {keys}, n, {picks}"""


ORACLE = {
    "p4_found": f"SELECT task_name, run_id FROM ({_RANKED})",
    "p4_ranked": _RANKED,
    "p7_percentiles": _quantiles("task_name") + ", CAST(0 AS DOUBLE) AS error_ms FROM o GROUP BY task_name, n",
    "p7_monthly": _quantiles("month, task_name") + " FROM o GROUP BY month, task_name, n",
}
