"""From a question to a structured route: rules as Columns over a ``questions`` frame, and the driver's rewriting of filters."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon
from ..functions.dictionary import Dictionary, consumed_names, with_names
from ..operators.match import Filters

YEAR_TERM = r"(\d{3})\s*(?:年|學年度|級|級的)?\s*(?:第([一二12])學期|([上下])學期?|-([12])|的?([上下]))"
TERM = r"(?:大[一二三四]|[一二三四]|碩[一二])([上下])|第([一二12])學期|([上下])學期"
PERIOD_RANGE = r"第([一二三四五六七八九十\d]+)[到至~\-]第?([一二三四五六七八九十\d]+)[堂節課]"
CLASSROOM = r"([A-Z]\d{3}(?:-\d)?)"
CLASS_GROUP = "[一二三四五]([甲乙丙丁])|([甲乙丙丁])班"


@dataclass(frozen=True)
class Route:
    query_type: str = "general"
    filters: Filters = field(default_factory=Filters)
    confidence: float = 0.3
    search_queries: tuple[str, ...] = ()
    is_chitchat: bool = False
    is_career_planning: bool = False


def _groups(question: Column, pattern: str, *groups: int) -> Column:
    """The first non-empty of some groups of the first match; null without one."""
    return F.coalesce(*[F.nullif(F.regexp_extract(question, pattern, g), F.lit("")) for g in groups])


def _map(value: Column, pairs: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in pairs.items())), value)


def any_word(question: Column, words) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: question.contains(w))


def academic_year(question: Column) -> Column:
    return _groups(question, YEAR_TERM, 1)


def semester(question: Column) -> Column:
    """With the year if there is one, else on its own."""
    pairs = {"一": "1", "二": "2", "上": "1", "下": "2", "1": "1", "2": "2"}
    with_year = _groups(question, YEAR_TERM, 2, 3, 4, 5)
    alone = _groups(question, TERM, 1, 2, 3)
    return _map(F.when(question.rlike(YEAR_TERM), with_year).otherwise(alone), pairs)


def weekday(question: Column) -> Column:
    out = None
    for d in lexicon.WEEKDAYS:
        day = "日天" if d == "日" else d
        hit = question.rlike(f"禮拜[{day}]|星期[{day}]|[週周]{d}")
        out = F.when(hit, f"星期{d}") if out is None else out.when(hit, f"星期{d}")
    return out


GRADES = "一二三四五"


def grade(question: Column) -> Column:
    """A spoken year of study, or one behind the short name of a department that the question names (資工三); none for general and physical education."""
    out = F.when(question.rlike("大一|一年級"), "一")
    for g in GRADES[1:]:
        out = out.when(question.rlike(f"大{g}|{g}年級"), g)
    spoken = out.when(question.rlike("碩一|研一"), "碩一").when(question.rlike("碩二|研二"), "碩二")
    behind = lambda name: F.coalesce(*[F.when(question.contains(F.concat(name, F.lit(g))), g) for g in GRADES])
    named = F.transform(departments(question), lambda d: behind(F.regexp_replace(d, "[系碩]", "")))
    return F.when(~(_sports(question) | question.contains("通識")), F.coalesce(spoken, F.get(F.array_compact(named), F.lit(0))))


def class_group(question: Column) -> Column:
    return _groups(question, CLASS_GROUP, 1, 2)


def period_range(question: Column) -> Column:
    """'2-4' from a spoken range of periods; null if a number is not known."""
    numbers = {**{c: str(i + 1) for i, c in enumerate("一二三四五六七八九十")}, "十一": "11", **{str(i): str(i) for i in range(1, 14)}}
    a, b = (_map(_groups(question, PERIOD_RANGE, g), numbers) for g in (1, 2))
    return F.concat(a, F.lit("-"), b)


#: Spoken time of day to class periods, first hit wins.
SPOKEN_PERIODS = {"早上": "第1節 第2節 第3節 第4節 上午", "上午": "第1節 第2節 第3節 第4節", "下午": "第5節 第6節 第7節 第8節 第9節", "晚上": "第10節 第11節 第12節 夜間"}


def with_periods(question: Column) -> Column:
    """The question with the class periods of the first time of day that it names."""
    out = question
    for spoken, formal in reversed(SPOKEN_PERIODS.items()):
        out = F.when(question.contains(spoken), F.concat(question, F.lit(f" ({formal})"))).otherwise(out)
    return out


def schedule_topic(question: Column, courses: Column) -> Column:
    """Which part of a timetable a question is about: free, day, credits, course (one of ``courses`` is named) or full."""
    named = F.exists(courses, lambda c: (c != "") & question.contains(c))
    return (
        F.when(any_word(question, ["空堂", "有空", "沒課", "沒有課", "下課"]), "free")
        .when(weekday(question).isNotNull() | F.lower(question).rlike("monday|tuesday|wednesday|thursday|friday|saturday|sunday"), "day")
        .when(any_word(question, ["學分", "幾學分", "修了多少"]), "credits")
        .when(named, "course")
        .otherwise("full")
    )


def classroom(question: Column) -> Column:
    return _groups(question, CLASSROOM, 1)


def required_or_elective(question: Column) -> Column:
    """The word if it filters; not if the question asks whether a course is one.  A recommendation means electives."""
    word = F.when(question.contains("必修"), "必修").when(question.contains("選修"), "選修")
    asking = question.rlike("(是|是否|算|為).{0,3}?(必修|選修).{0,2}?[嗎呢]") | question.rlike("(必修|選修)嗎")
    return F.when(word.isNotNull(), F.when(~asking, word)).when(any_word(question, ["推薦", "建議", "推介", "適合"]), "選修")


def ge_domain(question: Column) -> Column:
    return F.when(question.contains("通識"), F.when(question.contains("人文"), "人文").when(question.contains("社會"), "社會").when(question.contains("自然"), "自然"))


def question_type(question: Column) -> Column:
    """Ladder of intents, first hit wins."""
    has = lambda words: any_word(question, words)
    personal = has(lexicon.PERSONAL_WORDS) | (question.contains("我") & ~has(lexicon.FOR_ME_WORDS))
    return (
        F.when(personal & has(lexicon.TRANSCRIPT_WORDS), "personal_transcript")
        .when(personal & has(lexicon.SCHEDULE_WORDS), F.when(has(lexicon.RECOMMEND_WORDS), "course_info").otherwise("personal_schedule"))
        .when(any_word(F.lower(question), lexicon.PROFESSOR_WORDS), "professor_info")
        .when(has(lexicon.CALENDAR_WORDS), "calendar_action")
        .when(has(lexicon.ACADEMIC_WORDS), "academic_calendar")
        .when(has(lexicon.POLICY_WORDS), "policy_rules")
        .when(has(lexicon.COURSE_WORDS), "course_info")
        .otherwise("general")
    )


def department_dictionary() -> dict[str, str]:
    return {n: key for key, full, aliases, keywords in lexicon.DEPARTMENTS for n in (key, full, *aliases, *keywords)}


def entities(question: Column, names: dict[str, str] | Dictionary) -> Column:
    """array<string> of dictionary values in a question: longest match first, consuming.  names: as large as a registry."""
    return consumed_names(question, names if isinstance(names, Dictionary) else Dictionary(names))


def teachers(question: Column, names: Dictionary) -> Column:
    """Teachers of a registry whom a question names, with or without their titles."""
    return entities(F.regexp_replace(question, "老師|教授", ""), names)


def courses(question: Column, names: Dictionary) -> Column:
    return entities(question, names)


def with_teachers(rows: DataFrame, question: Column, names: DataFrame) -> DataFrame:
    """rows with ``teachers`` of a registry of any size (name), as by ``teachers``."""
    return with_names(rows, F.regexp_replace(question, "老師|教授", ""), names, "teachers")


def with_courses(rows: DataFrame, question: Column, names: DataFrame) -> DataFrame:
    return with_names(rows, question, names, "courses")


def _sports(question: Column) -> Column:
    """Physical education for all, not the department of it."""
    return question.contains("體育") & ~any_word(question, ["運休", "運動與休閒", "體育系", "體育學系"])


def departments(question: Column) -> Column:
    """Short names; a master's question names the master's programme.  General education and physical education overrule."""
    found = entities(question, department_dictionary())
    master = any_word(question, ["碩", "研究所"])
    named = F.transform(found, lambda d: F.when(master & d.contains("系"), F.replace(d, F.lit("系"), F.lit("碩"))).when(master, F.concat(d, F.lit("碩"))).otherwise(d))
    return F.when(_sports(question), F.array(F.lit("日大學體育"))).when(question.contains("通識"), F.array(F.lit("通識中心"))).otherwise(named)


#: What is asked about, by who asks for its teachers or courses, and the words that are searched instead.
SUBJECTS = {
    ("英文", "英語", "英"): "應英系 英文老師 大一英文 英文課 應用英語學系",
    ("體育", "運動"): "體育課 體育老師 體育室 推薦",
    ("通識",): "通識課 通識老師 通識中心 推薦",
    ("資工", "資訊工程", "csie"): "資工系 資工老師 資訊工程學系 資工",
    ("電機", "電機工程", "ee"): "電機系 電機老師 電機工程學系 電機",
    ("企管", "企業管理", "ba"): "企管系 企管老師 企業管理學系 企管",
    ("工管", "工業工程"): "工管系 工管老師 工業工程與管理學系 工管",
    ("觀光", "觀光管理"): "觀光系 觀光老師 觀光管理學系 觀光",
}
SUBJECT_DEPARTMENTS = (
    "資工", "電機", "電子", "土木", "食品", "企管", "觀光", "運休", "工管", "資管", "國際", "建築", "海邊", "應英", "華語", "都景", "護理", "長照", "社工", "機械", "化工", "網媒",
)


#: Departments that are asked for without teacher, professor or course, and their search words.
BARE_SUBJECTS = {
    ("英文", "英文系", "應英", "應英系", "應用英語學系"): "應英系 應用英語學系 英文課 英文老師",
    ("資工", "資工系", "資訊工程學系", "csie"): "資工系 資工老師 資訊工程學系 資工",
    ("電機", "電機系", "電機工程學系", "ee"): "電機系 電機老師 電機工程學系 電機",
}


def opinion_query(question: Column, nicknames: dict[str, str] | None = None) -> Column:
    """Search words for a question that ends in teacher, professor or course: those of its subject, else of the department, person or course before it.

    Without such an ending a department gives its words and anything else stays. nicknames (in lower case, to names) are
    looked up for the whole question first, with or without teacher or professor behind them; a null question gives null.
    """
    said = F.trim(question)
    if nicknames:
        said = F.coalesce(_map(F.lower(said), {nick + ending: name for nick, name in nicknames.items() for ending in ("", "老師", "教授")}), said)
    subject = F.trim(F.regexp_extract(said, "^(.+?)(?:教授|老師|課)$", 1))
    known = _map(subject, {name: words for names, words in SUBJECTS.items() for name in names})
    bare = F.replace(subject, F.lit("系"), F.lit(""))
    words = lambda name, *ends: F.concat_ws(" ", *[F.concat(name, F.lit(e)) for e in ends])
    other = F.when(any_word(subject, SUBJECT_DEPARTMENTS), words(bare, "系", "老師", "課")).when(F.length(subject) <= 4, words(subject, " 老師 評價", " 教授")).otherwise(words(subject, " 老師", " 課"))
    alone = F.coalesce(_map(F.lower(said), {name: found for names, found in BARE_SUBJECTS.items() for name in names}), said)
    return F.when(said.isNotNull(), F.when(subject == "", alone).otherwise(F.coalesce(known, other)))


def search_queries(question: Column, rewritten: Column, most: int = 4) -> Column:
    """The question first, then its rewritings, each once."""
    return F.slice(F.array_distinct(F.concat(F.array(question), rewritten)), 1, most)


def existing(question: Column, names: Column) -> Column:
    """Only the entities that are literally in the question and hold no digit."""
    return F.filter(names, lambda n: question.contains(n) & ~n.rlike(r"\d"))


def needs_history(question: Column) -> Column:
    """A pronoun and no department named."""
    return question.rlike("他|她|它|這門|那門|這個|那個") & (F.size(departments(question)) == 0)


_NULL = "explicit null"


def plan_filters(by_rules: dict[str, list[str]], by_model: dict[str, list[str] | None] | None = None, *, career: bool = False, term: tuple[str, str] | None = None, first_query: str = "") -> Filters:
    """Merge, relax and complete filters before any plan is made.

    A model's course, teacher, term win over the rules', which win otherwise; a model's
    explicit None removes a key and keeps defaults away.  A course lifts the grade, a teacher the
    grade and department, two courses the term, two departments department and grade, career planning the term.
    The current term (year, semester) is filled in where none is named, unless in career planning.
    """
    wanted: dict[str, list[str]] = {}
    closed: set[str] = set()
    model = by_model or {}
    for key in [*by_rules, *(k for k in model if k not in by_rules)]:
        if key in model and model[key] is None:
            closed.add(key)
        elif key in model and (key in ("course_name_keyword", "teacher", "semester", "academic_year") or key not in by_rules):
            wanted[key] = list(model[key])
        else:
            wanted[key] = list(by_rules[key])
    lift: set[str] = set()
    if "course_name_keyword" in wanted:
        lift.add("grade")
    if "teacher" in wanted:
        lift |= {"grade", "dept_short"}
    if len(wanted.get("course_name_keyword", [])) >= 2 or career:
        lift |= {"academic_year", "semester"}
    if len(wanted.get("dept_short", [])) >= 2:
        lift |= {"dept_short", "grade"}
    wanted = {k: v for k, v in wanted.items() if k not in lift}
    if term and not career and "course_name_keyword" not in lift:
        for key, value in zip(("academic_year", "semester"), term, strict=True):
            if key not in wanted and key not in closed and key not in lift:
                wanted[key] = [value]
    return Filters(wanted, first_query)


#: Words that bind a question to a time, so that the current term holds; words of course names; years of study in digits.
TIME_WORDS = ("星期", "禮拜", "週", "周", "今天", "明天", "空堂", "幾點", "下午", "上午", "節", "堂")
COURSE_NAME_WORDS = ("系統", "概論", "原理", "實驗", "微處理器", "程式設計", "微算機")
YEARS_OF_STUDY = {"1": "一", "2": "二", "3": "三", "4": "四", "5": "五"}
ABOUT_COURSES = ("course_info", "schedule")


def repaired(model: dict[str, list[str] | None], courses: frozenset[str] = frozenset(), teachers: frozenset[str] = frozenset()) -> dict[str, list[str] | None]:
    """A model's filters with courses that it took for teachers among the courses, teachers without titles, and none that hold a digit."""
    said = model.get("teacher")
    if said is None:
        return dict(model)
    moved = [t for t in said if t not in teachers and (t in courses or any(w in t for w in COURSE_NAME_WORDS))]
    bare = [re.sub("(?:老師|教授)$", "", t).strip() for t in said if t not in moved]
    out = {k: v for k, v in model.items() if k != "teacher"}
    if people := [t for t in bare if t and not re.search(r"\d", t)]:
        out["teacher"] = people
    if moved:
        out["course_name_keyword"] = list(dict.fromkeys([*(out.get("course_name_keyword") or []), *moved]))
    return out


def decide(
    question: str, rule_type: str, by_rules: dict[str, list[str]], model: dict | None = None, *,
    term: tuple[str, str] | None = None, profile: dict[str, str] | None = None, courses: frozenset[str] = frozenset(), teachers: frozenset[str] = frozenset(), most: int = 5,
) -> Route:
    """The route of one question from its rules and what a model said of it (query_type, filters, search_queries, is_chitchat, is_career_planning); None if the model failed.

    Of questions about courses, those bound to a time get the current term even where the model refused one; the others lose the year of study.
    Who names no teacher, room, course or department asks about their own department and, if bound to a time, year.
    """
    if model is None:
        return Route(rule_type, Filters(by_rules, question), 0.3, (question,))
    kind, career = model.get("query_type") or rule_type, bool(model.get("is_career_planning"))
    said = repaired(model.get("filters") or {}, courses, teachers)
    merged = {**by_rules, **said}
    timed = any(w in question for w in TIME_WORDS) or bool(merged.get("day_of_week") or merged.get("time_period"))
    about = kind in ABOUT_COURSES
    bound = about and timed and not career
    if bound:
        said = {k: v for k, v in said.items() if v is not None or k not in ("academic_year", "semester")}
    wanted = dict(plan_filters(by_rules, said, career=career, term=term if bound else None, first_query=question).wanted)
    if about and not timed and not career:
        wanted.pop("grade", None)
    if about and profile and not {"teacher", "classroom", "course_name_keyword", "dept_short"} & wanted.keys():
        if own := profile.get("department"):
            wanted["dept_short"] = [own]
        if bound and "grade" not in wanted and (year := str(profile.get("grade") or "")):
            wanted["grade"] = [YEARS_OF_STUDY.get(year, year)]
    queries = tuple(dict.fromkeys([question, *(model.get("search_queries") or [])]))[:most]
    return Route(kind, Filters(wanted, question), 0.9 if wanted else 0.7, queries, bool(model.get("is_chitchat")), career)


#: What handles a question, by its type; a general one without filters is chitchat.
HANDLERS = {"personal_schedule": "schedule", "personal_transcript": "transcript", "academic_calendar": "calendar_search", "calendar_action": "calendar"}


def dispatch(route: Route) -> str:
    if route.is_chitchat or route.query_type == "general" and not route.filters.wanted:
        return "chitchat"
    return HANDLERS.get(route.query_type, "retrieval")


def precise(route: Route) -> bool:
    """A named course or teacher needs no rewritten queries."""
    return bool({"course_name_keyword", "teacher"} & set(route.filters.wanted))
