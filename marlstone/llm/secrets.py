"""Secret scans over a trigram index, in DataFrame functions only.

``trigram_query`` derives from a regular expression which lower-cased trigrams any match
must hold, as alternatives of sets.  The index has a posting (trigram, document) for each of
the rules' trigrams that a document holds; postings joined with the queries and
counted per document and alternative give the candidates, which the regular expression
verifies.  A rule without mandatory trigrams scans every document.

Matches are leftmost and do not overlap within a rule; spans are code points, the end is
exclusive.  Defined results: null or empty texts have no spans; texts of any length are scanned whole; equal rows are
separate documents; of rules that match at one start the one listed first goes first; an empty table gives no rows;
of docs only doc_id and text are used, so no other column's name can clash.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common


def parsed(pattern: str):
    """The parts of a pattern, (operation, argument) each, as Python's own parser has them: it has no public interface, so all use of it is here."""
    return re._parser.parse(pattern)


#: Alternatives that a query may have; beyond it a part of the expression is left out (a weaker, still sound query).
MOST_ALTERNATIVES = 64


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: A match counts only if this group has at least so many characters.
    group: int = 0
    min_length: int = 1


#: Fixed values.  A run of [0-9a-f]+ or AKIA[A-Z0-9]+ that is too short holds no longer match, so their least length is in the pattern.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE_RULES + MORE_RULES

Query = list[frozenset[str]]  # alternatives of trigrams that all must be there
ANY: Query = [frozenset()]


def _both(a: Query, b: Query) -> Query:
    made = list(dict.fromkeys(x | y for x, y in product(a, b)))
    if len(made) > MOST_ALTERNATIVES:
        return min(a, b, key=lambda q: (q == ANY, len(q)))
    return made


def _of_strings(strings: set[str]) -> Query:
    return list(dict.fromkeys(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in sorted(strings)))


def _part(op, arg) -> tuple[set[str] | None, Query]:
    """The exact strings of a part, if few, and else what its matches must hold."""
    name = str(op)
    if name == "LITERAL":
        return {chr(arg).lower()}, ANY
    if name == "IN" and all(str(o) == "LITERAL" for o, _ in arg) and len(arg) <= 8:
        return {chr(a).lower() for _, a in arg}, ANY
    if name == "AT":
        return {""}, ANY
    if name == "SUBPATTERN":
        return _sequence(arg[-1])
    if name == "BRANCH":
        parts = [_sequence(x) for x in arg[1]]
        if all(strings is not None for strings, _ in parts):
            return set().union(*(strings for strings, _ in parts)), ANY
        return None, list(dict.fromkeys(s for strings, query in parts for s in (query if strings is None else _of_strings(strings))))
    if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        least, most, inner = arg
        strings, query = _sequence(inner)
        if strings is not None and (least, most) == (0, 1):
            return strings | {""}, ANY
        if strings is not None and least == most and len(strings) ** least <= MOST_ALTERNATIVES:
            return {"".join(x) for x in product(strings, repeat=least)}, ANY
        if least:
            return None, query if strings is None else _of_strings(strings)
    return None, ANY  # classes, optional parts, anything else: no demand


def _sequence(parts) -> tuple[set[str] | None, Query]:
    open_strings, query, exact = {""}, ANY, True
    for op, arg in parts:
        strings, own = _part(op, arg)
        if strings is not None and len(strings) * len(open_strings) <= MOST_ALTERNATIVES:
            open_strings = {a + b for a in open_strings for b in strings}
            continue
        query = _both(query, _of_strings(open_strings))
        query = _both(query, own)
        open_strings, exact = strings or {""}, False
    if exact:
        return open_strings, ANY
    return None, _both(query, _of_strings(open_strings))


def trigram_query(pattern: str) -> Query:
    """Alternatives, any of which every match of the pattern satisfies; ANY if it demands nothing."""
    strings, query = _sequence(parsed(pattern))
    query = query if strings is None else _of_strings(strings)
    least = [a for a in query if not any(b < a for b in query)]  # what demands more than another adds nothing
    return ANY if frozenset() in least else least


def query_table(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame:
    """rule (its place), alternative, needed (its size), trigram: as many rows as the rules' patterns make."""
    rows = [(at, k, len(alternative), t) for at, r in enumerate(rules) for k, alternative in enumerate(trigram_query(r.pattern)) for t in sorted(alternative)]
    return spark.createDataFrame(rows, "rule int, alternative int, needed int, trigram string")


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """trigram, key: the inverted index, restricted to the trigrams asked for; docs: key, text."""
    lower = docs.select("key", F.lower(F.coalesce("text", F.lit(""))).alias("lower"))
    there = F.array_compact(F.array(*[F.when(F.contains("lower", F.lit(t)), F.lit(t)) for t in trigrams]))
    return lower.select("key", F.explode(there).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """key, rules (a bit each): the rules with mandatory trigrams whose query a document satisfies."""
    table = query_table(docs.sparkSession, rules)
    trigrams = sorted({t for r in rules for a in trigram_query(r.pattern) for t in a})
    # the query table is as small as the rules; a document is in a posting list once
    hits = postings(docs, trigrams).join(F.broadcast(table), "trigram")
    met = hits.groupBy("key", "rule", "alternative", "needed").agg(F.count_distinct("trigram").alias("n")).where("n = needed")
    return met.groupBy("key").agg(F.bit_or(F.expr("shiftleft(1L, rule)")).alias("rules"))


def _matches(rule: Rule, at: int) -> Column:
    """(kind, place, gap, whole, value) of a rule's matches in ``__text``: their place in order, and the lengths of what stands before them, of all and of the part that counts."""
    pattern = F.lit(rule.pattern)
    parts = F.transform(F.split("__text", rule.pattern, -1), lambda x: F.length(x))
    whole = F.transform(F.regexp_extract_all("__text", pattern, 0), lambda x: F.length(x))
    value = F.transform(F.regexp_extract_all("__text", pattern, rule.group), lambda x: F.length(x)) if rule.group else whole
    rows = F.arrays_zip(F.slice(parts, F.lit(1), F.size(whole)).alias("gap"), whole.alias("whole"), value.alias("value"))
    return F.transform(rows, lambda r, n: F.struct(F.lit(at).alias("kind"), n.alias("place"), r["gap"].alias("gap"), r["whole"].alias("whole"), r["value"].alias("value")))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and spans, an array of (start, kind, end) with kind the rule's place in rules, sorted.

    Matches are rows, and where they start is a running sum over those of a text: time follows their number.  Texts are not shuffled, only matches are.
    """
    key = F.xxhash64("doc_id", "text")  # equal keys share candidates and matches
    rows = docs.select(F.coalesce("text", F.lit("")).alias("__text"), key.alias("__key"))
    # few documents are candidates: their keys are sent to the texts, not the texts to a join
    found = common.narrow_side(common.materialize(candidates(docs.select(key.alias("key"), "text"), rules).withColumnRenamed("key", "__of"), "candidates"))
    joined = rows.join(found, rows["__key"] == F.col("__of"), "left")
    none = F.array().cast("array<struct<kind:int,place:int,gap:int,whole:int,value:int>>")
    each = []
    for at, rule in enumerate(rules):
        if trigram_query(rule.pattern) == ANY:
            gate = F.col("__text").rlike(rule.pattern)  # full scan
        else:
            gate = F.coalesce(F.col("rules").bitwiseAND(1 << at) != 0, F.lit(False))
        each.append(F.when(gate, _matches(rule, at)).otherwise(none))
    # outer: a plain explode puts a filter on the array's size below it, which matches every pattern twice
    matches = joined.select("__key", F.explode_outer(F.concat(*each)).alias("m")).where("m IS NOT NULL").select("__key", "m.*")
    once = matches.groupBy("__key", "kind", "place").agg(*[F.first(c).alias(c) for c in ("gap", "whole", "value")])  # many rows may be one text
    end = F.sum(F.col("gap") + F.col("whole")).over(Window.partitionBy("__key", "kind").orderBy("place")).cast("int")
    least = F.element_at(F.array(*[F.lit(r.min_length) for r in rules]), F.col("kind") + 1)
    kept = once.withColumn("end", end).where(F.col("value") >= least)
    spans = kept.groupBy("__key").agg(F.sort_array(F.collect_list(F.struct((F.col("end") - F.col("whole")).alias("start"), "kind", "end"))).alias("spans"))
    spans = common.materialize(spans, "spans")
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return docs.select("doc_id", key.alias("__key")).join(spans, "__key", "left").select("doc_id", F.coalesce("spans", empty).alias("spans"))


def written(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end of each span, joined by commas."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_secret_scans(spark, sf_dir: str) -> DataFrame:
    spans = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{BASE_RULES[k].kind}")
    base = F.filter("spans", lambda s: s["kind"] < len(BASE_RULES))
    return spans.select("doc_id", n(0), n(1), n(2), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
