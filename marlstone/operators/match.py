"""Metadata predicates and scores: each predicate is a Column over chunk columns, true if any wanted value matches."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import lexicon
from ..functions import text as T


def _any(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns, F.lit(False))


def department_names(value: str) -> set[str]:
    """All names of the department that a value is a key, full name, alias or keyword of; else the value."""
    for key, full, aliases, keywords in lexicon.DEPARTMENTS:
        names = {key, full, *aliases, *keywords}
        if value in names:
            return names
    return {value}


def department(values: list[str]) -> Column:
    """Substring either way of any of the department's names; an empty department matches everything, and so does 全校."""
    own = F.col("dept_short")
    names = sorted(set().union(*(department_names(v) for v in values)))
    return (own == "全校") | _any([own.contains(n) | F.lit(n).contains(own) for n in names])


def course(values: list[str]) -> Column:
    name = F.lower("course_name")
    return _any([(name == v) | (F.lower(T.strip_parens(F.col("course_name"))) == v) | name.contains(v) for v in map(str.lower, values)])


def shared_characters(value: str, name: Column) -> Column:
    """At least max(2, floor(0.67 len)) characters of the value occur in the name; both have two or more."""
    need = max(2, int(0.67 * len(value)))
    hits = reduce(lambda a, b: a + b, [F.when(name.contains(c), 1).otherwise(0) for c in value], F.lit(0))
    return (F.lit(len(value)) >= 2) & (F.length(name) >= 2) & (hits >= need)


def person(value: str, name: Column) -> Column:
    """Substring either way, else enough shared characters."""
    value = value.lower()
    name = F.lower(name)
    return name.contains(value) | ((name != "") & F.lit(value).contains(name)) | shared_characters(value, name)


def teacher(values: list[str]) -> Column:
    own = F.lower(F.coalesce("teacher", F.lit("")))
    bare = [v.replace("老師", "").replace("教授", "").lower() for v in values]
    return _any([own.contains(v) | shared_characters(v, own) for v in bare])


def weekday(values: list[str]) -> Column:
    where = F.when(F.col("schedule") != "", F.col("schedule")).otherwise(F.col("text"))
    return _any([where.contains(v) for v in values])


def normal_grade(value: str) -> str:
    value = value.removeprefix("大")
    return dict(zip("12345", "一二三四五")).get(value, value)


def grade(values: list[str]) -> Column:
    bare = F.regexp_replace("grade", "^大", "")
    return F.translate(bare, "12345", "一二三四五").isin(*map(normal_grade, values))


def periods(values: list[str]) -> Column:
    """Overlap with the class periods of the schedule; only the first value counts, and no parse means no match."""
    start, _, end = values[0].partition("-")
    first = F.regexp_extract("schedule", r"第(\d+)節", 1)
    last = F.coalesce(F.nullif(F.regexp_extract("schedule", r"第\d+節\s*[~～-]\s*第(\d+)節", 1), F.lit("")), first)
    return (first != "") & ~((first.cast("int") > int(end or start)) | (last.cast("int") < int(start)))


def ge_domain(values: list[str]) -> Column:
    own = F.coalesce("ge_domain", F.lit(""))
    return (own != "") & _any([own.contains(v) | F.lit(v).contains(own) for v in values])


def _contains(column: str) -> Callable[[list[str]], Column]:
    return lambda values: _any([F.col(column).contains(v) for v in values])


def _equals(column: str) -> Callable[[list[str]], Column]:
    return lambda values: F.col(column).isin(*values)


#: Filter key to predicate.
PREDICATES: dict[str, Callable[[list[str]], Column]] = {
    "dept_short": department,
    "course_name_keyword": course,
    "teacher": teacher,
    "day_of_week": weekday,
    "grade": grade,
    "required_or_elective": _contains("required_or_elective"),
    "time_period": periods,
    "semester": _equals("semester"),
    "academic_year": _equals("academic_year"),
    "class_group": _equals("class_group"),
    "is_evening": lambda values: F.col("is_evening"),  # the row's flag; the wanted value is not looked at
    "classroom": _contains("classroom"),
    "ge_domain": ge_domain,
}

EXCLUSIVE = {"dept_short", "grade", "day_of_week", "time_period", "semester", "academic_year"}
STRONG = {"teacher", "course_name_keyword", "classroom"}


@dataclass(frozen=True)
class Filters:
    """Wanted values by key; the driver rewrites them before any plan is made."""

    wanted: dict[str, list[str]] = field(default_factory=dict)
    first_query: str = ""

    def exempt(self) -> Filters:
        """Drop keys that would contradict the others."""
        w = dict(self.wanted)
        drop: set[str] = set()
        if len(w.get("course_name_keyword", [])) >= 2:
            drop |= {"semester", "academic_year"}
        years = [g for g in ("大一", "大二", "大三", "大四", "一年級", "二年級", "三年級", "四年級") if g in self.first_query]
        if len(w.get("grade", [])) >= 2 or len(years) >= 2 or "跨年級" in self.first_query or "年級比較" in self.first_query:
            drop.add("grade")
        if "teacher" in w or "classroom" in w:
            drop |= {"grade", "dept_short"}
        if "course_name_keyword" in w:
            drop.add("grade")
        return Filters({k: v for k, v in w.items() if k not in drop}, self.first_query)

    def weights(self, key: str) -> tuple[float, float]:
        """Reward of a match, penalty of a miss."""
        named = "course_name_keyword" in self.wanted or "teacher" in self.wanted
        if key in EXCLUSIVE and not (named and key in ("semester", "academic_year")):
            return 2.0, -100.0
        return (5.0, -3.0) if key in STRONG else (3.0, -2.0)


def soft_score(filters: Filters) -> Column:
    """Rewards and penalties summed over all filters; nothing is removed.  Several courses or grades take no penalties."""
    lenient = len(filters.wanted.get("course_name_keyword", [])) >= 2 or len(filters.wanted.get("grade", [])) >= 2
    f = filters.exempt()
    score = F.lit(0.0)
    for key, values in f.wanted.items():
        gain, loss = f.weights(key)
        score = score + F.when(PREDICATES[key](values), gain).otherwise(0.0 if lenient else loss)
    return score


#: Weight of each key in the normalised score.
SHARES = {"dept_short": 0.3, "grade": 0.25, "required_or_elective": 0.25, "teacher": 0.2, "course_name_keyword": 0.3, "ge_domain": 0.3, "day_of_week": 0.3}
INTENT_SHARE = 0.2


def normal_score(filters: Filters, intent_sections: list[str] | None = None) -> Column:
    """Matched weight over possible weight, 0 without filters; the weekday is looked for in the text."""
    keys = [k for k in filters.wanted if k in SHARES]
    possible = sum(SHARES[k] for k in keys) + (INTENT_SHARE if intent_sections else 0.0)
    if not possible:
        return F.lit(0.0)
    total = F.lit(0.0)
    for k in keys:
        hit = _any([F.col("text").contains(v) for v in filters.wanted[k]]) if k == "day_of_week" else PREDICATES[k](filters.wanted[k])
        total = total + F.when(hit, SHARES[k]).otherwise(0.0)
    if intent_sections:
        total = total + F.when(F.col("section").isin(*intent_sections), INTENT_SHARE).otherwise(0.0)
    return total / possible


_PREFIXES = ("[自訂]", "[課程]", "[期中考]", "[期末考]")


def title_matches(title: Column, keyword: str) -> Column:
    """Tier (1 to 5) at which a keyword matches a calendar title, 0 for none."""
    normal = lambda c: F.translate(F.lower(c), "週台", "周臺")
    word = keyword.lower().replace("週", "周").replace("台", "臺")
    bare = title
    for p in _PREFIXES:
        bare = F.trim(F.replace(bare, F.lit(p), F.lit("")))
    bare, whole = normal(bare), normal(title)
    import re

    parts = [p.strip() for p in re.split(r"跟|與|和|及|、|,|\s+", word) if len(p.strip()) >= 2]
    clean = F.translate(whole, "[]", "")
    either = lambda p: bare.contains(p) | whole.contains(p)
    tier = F.when(F.lit(keyword == "*"), 1).when(either(word), 2).when(_any([either(p) for p in parts]), 3)
    if len(word) >= 4:
        every = reduce(lambda a, b: a & b, [clean.contains(c) for c in sorted(set(word))])
        some = _any([clean.contains(word[i : i + 3]) for i in range(len(word) - 2)])
        gaps = ".{0,3}".join(re.sub(r"([^\w])", r"\\\1", c) for c in word)
        tier = tier.when(every & some, 4).when(bare.rlike(gaps) | whole.rlike(gaps), 5)
    return tier.otherwise(0)
