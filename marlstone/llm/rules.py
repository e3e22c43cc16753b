"""Quality rules by host, in DataFrame functions only.

Each whole text gets counts and a list of rules that it fails.  Failures are summed by host,
a beta prior is fitted to the hosts' failure rates by moments (their variance less what chance alone
gives hosts of their sizes), each host's rate is shrunk
toward the prior's mean, and hosts whose shrunk rate exceeds ``max_rate`` are rejected.
The verdict is joined back: a document is kept if its own base rules hold and its host is not rejected.

Words are maximal runs outside ``[\\x20\\x09-\\x0D]``.  ``n_repeat_words`` counts the
words that lie in a window of three words whose word sequence occurs at least twice in the text.

Defined results: a null or empty text has zero counts and fails (fewer than 50
words); a text of any length is counted whole; a null host is a host of its own; equal rows are separate documents; a host whose
rate equals ``max_rate`` stays; an empty table gives no rows; of docs only doc_id, text and the host are used, so no other
column's name can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A host is rejected if its shrunk share of failing documents is above this.
MAX_RATE = 0.5
#: Least and most documents that the prior counts as: with few hosts, or hosts that differ by chance only, the moments give none or any number.
LEAST_WEIGHT, MOST_WEIGHT = 1.0, 1000.0
_BLANK = " \t\n\x0b\x0c\r"


def _cover(places: Column) -> Column:
    """How many positions the windows [p, p + 3) at sorted places cover."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda acc, p: F.struct((acc["n"] + p + 3 - F.greatest(p, acc["end"])).alias("n"), (p + 3).alias("end"))
    return F.aggregate(places, start, step, lambda acc: acc["n"].cast("long"))


def counts(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines and the columns in keep."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", *keep, text.alias("__text"), F.btrim(text, F.lit(_BLANK)).alias("__bare"))
    rows = rows.select(
        "doc_id",
        *keep,
        "__text",
        F.when(F.col("__bare") == "", F.array().cast("array<string>")).otherwise(F.split("__bare", r"[\x20\x09-\x0D]+")).alias("__words"),
        F.filter(F.split("__text", "\n"), lambda x: F.btrim(x, F.lit(_BLANK)) != "").alias("__lines"),
    )
    # the hash of three words at each word but the last two
    rows = rows.select(
        "*",
        F.slice(F.transform("__words", lambda w, i: F.xxhash64(w, F.get("__words", i + 1), F.get("__words", i + 2))), F.lit(1), F.greatest(F.size("__words") - 2, F.lit(0))).alias("__windows"),
    )
    some = F.size(F.array_distinct("__windows")) < F.size("__windows")
    rows = rows.select("*", F.when(some, F.array_sort(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("__sorted"))
    twin = lambda x, k: F.coalesce(x["h"] == F.get("__sorted", k - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get("__sorted", k + 1)["h"], F.lit(False))
    places = F.array_sort(F.transform(F.filter("__sorted", twin), lambda x: x["i"]))
    return rows.select(
        "doc_id",
        *keep,
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        (F.length("__text") - F.length(F.regexp_replace("__text", "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(_cover(places), F.lit(0).cast("long")).alias("n_repeat_words"),
        F.size("__lines").cast("long").alias("n_lines"),
    )


def failures() -> dict[str, Column]:
    """Rule name to whether a row of ``counts`` fails it; the first two are the base rules."""
    n = F.col("n_words")
    return {
        "short": n < MIN_WORDS,
        "repetitive": 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n,
        "symbols": 10 * F.col("n_symbols") > n,
        "line_copies": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
        "word_length": (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 15 * n),
    }


def host_rates(judged: DataFrame) -> DataFrame:
    """host, n_docs, n_failed, rate shrunk toward the mean of a beta prior; judged: host, failed."""
    hosts = judged.groupBy("host").agg(F.count("*").alias("n_docs"), F.count_if("failed").alias("n_failed"))
    each = F.col("n_failed") / F.col("n_docs")
    mean, spread, chance = hosts.agg((F.sum("n_failed") / F.sum("n_docs")), F.var_pop(each), F.avg(1 / F.col("n_docs"))).first()
    mean = min(max(mean or 0.0, 1e-4), 1 - 1e-4)
    spread = (spread or 0.0) - mean * (1 - mean) * (chance or 0.0)
    weight = min(max(mean * (1 - mean) / max(spread, 1e-9) - 1, LEAST_WEIGHT), MOST_WEIGHT)
    return hosts.withColumn("rate", (F.col("n_failed") + mean * weight) / (F.col("n_docs") + weight))


def judge(docs: DataFrame, host: str = "source", max_rate: float = MAX_RATE) -> DataFrame:
    """counts of each row with its failed rules, base_failed, host_rate and kept."""
    rules = failures()
    rows = counts(docs.withColumn("__host", F.col(host).cast("string")).select("doc_id", "text", F.col("__host").alias("host")), "host")
    named = F.array_compact(F.array(*[F.when(failed, F.lit(name)) for name, failed in rules.items()]))
    base = rules["short"] | rules["repetitive"]
    # narrow rows are written once: the rates and the join both read them
    rows = common.materialize(rows.select("*", named.alias("failed_rules"), base.alias("base_failed")), "counts")
    rates = host_rates(rows.select("host", (F.size("failed_rules") > 0).alias("failed"))).select(F.col("host").alias("__of"), F.col("rate").alias("host_rate"))
    joined = rows.join(rates, F.col("host").eqNullSafe(F.col("__of"))).drop("__of")
    return joined.withColumn("kept", ~F.col("base_failed") & (F.col("host_rate") <= max_rate))


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    found = judge(common.read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("host_rate", 6).alias("host_rate"))
