"""Dates, class periods and intervals.  Nothing here asks for the current time: pass the reference day."""

from __future__ import annotations

import datetime as dt
import re
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon

_HAN_NUMBER = {ord(c): str(n) for c, n in lexicon.HAN_DIGITS.items() if n < 10} | {ord("拾"): "十"}


def han_number(text: str) -> int:
    """A Han or Arabic number up to 99; a run of digits without a ten is read digit by digit.

    Around a ten, a digit that is left out is a one in front and a zero behind.
    """
    places = text.strip().translate(_HAN_NUMBER).partition("十")
    written = f"{places[0] or 1}{places[2] or 0}" if places[1] else places[0]
    return int(re.sub(r"\D", "", written) or 0)


def relative_day(text: Column, ref: Column) -> Column:
    """The first relative-day word, longest first, replaced once by its date."""
    out = text
    for word, days in reversed(lexicon.RELATIVE_DAYS):
        at = F.locate(word, text)
        done = F.concat(F.substring(text, F.lit(1), at - 1), F.date_format(F.date_add(ref, days), "yyyy-MM-dd"), F.substring(text, at + len(word), F.length(text)))
        out = F.when(at > 0, done).otherwise(out)
    return out


def next_weekday(ref: Column, weekday: Column) -> Column:
    """The next day with this weekday (0: Monday); today counts."""
    return F.date_add(ref, F.pmod(weekday - F.weekday(ref), F.lit(7)))


def weekday_of_next_week(ref: Column, weekday: Column) -> Column:
    return F.date_add(ref, F.pmod(weekday - F.weekday(ref), F.lit(7)) + 7)


def date_label(day: Column) -> Column:
    """M月D日(週X)."""
    names = F.array(*[F.lit(c) for c in lexicon.WEEKDAYS])
    return F.concat(F.month(day).cast("string"), F.lit("月"), F.day(day).cast("string"), F.lit("日(週"), F.get(names, F.weekday(day)), F.lit(")"))


def weekday_argument(text: Column, ref: Column) -> Column:
    """1 to 7 from a digit or a Han weekday; the reference day's own otherwise."""
    han = F.create_map(*chain.from_iterable((F.lit(c), F.lit(i + 1)) for i, c in enumerate(lexicon.WEEKDAYS + "天")))
    digit = F.regexp_extract(text, r"^\s*([1-7])\s*$", 1)
    word = F.regexp_extract(text, "(?:週|周|禮拜|星期)([一二三四五六日天])", 1)
    found = F.when(word == "天", 7).otherwise(F.try_element_at(han, word))
    return F.when(digit != "", digit.cast("int")).when(word != "", found).otherwise(F.weekday(ref) + 1)


def repaired_end(start: Column, end: Column, all_day: Column) -> Column:
    """An end after the start: a missing one is two hours later, one that is not later a day (all-day) or an hour."""
    day, hour, two = F.make_interval(days=F.lit(1)), F.make_interval(hours=F.lit(1)), F.make_interval(hours=F.lit(2))
    return F.when(end.isNull(), F.when(all_day, start + day).otherwise(start + two)).when(end <= start, F.when(all_day, start + day).otherwise(start + hour)).otherwise(end)


def list_range(start: Column, end: Column, target: Column, now: Column) -> tuple[Column, Column]:
    """The window that a calendar listing searches: from the start to the end, else to the day after the target, else 30 days;
    the target's day if there is no start; the next 7 days if there is neither."""
    days = lambda t, n: t + F.make_interval(days=F.lit(n))
    after = days(target, 1)
    to = F.coalesce(end, F.when(after > start, after), days(start, 30))
    low = F.coalesce(start, target, now)
    return low, F.when(start.isNotNull(), to).when(target.isNotNull(), days(target, 1)).otherwise(days(now, 7))


#: What asks for all events of the calendar, and for the whole timetable, to be removed.
CLEAR_WORDS = ("所有", "全部", "清空", "所有行程", "全部行程", "全部行事曆", "所有行事曆", "所有新增的行事曆", "全刪")
TIMETABLE_WORDS = ("課表", "所有課", "全部課", "課程表", "我的課表", "課程", "所有課程")


def removal_keyword(name: Column, intent: Column) -> Column:
    """The title keyword of a removal: ``*`` for everything, the course prefix for the timetable, else the name itself."""
    everything = name.isin(*CLEAR_WORDS) | ((name == "*") & intent.isin("custom_event", "course_schedule_event"))
    return F.when(everything, "*").when((intent == "import_schedule") | name.isin(*TIMETABLE_WORDS), "[課程]").otherwise(name)


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return ~((a_start > b_end) | (a_end < b_start))


#: Halves of the day, by what they do to an hour.
BEFORE_NOON = ("上午", "早上", "早", "凌晨")
AFTER_NOON = ("下午", "晚上", "晚", "夜間")

#: Letter of a word's kind and the words: the first kind that fits is taken, so longer words stand first.
_WORDS = {
    "r": "|".join(w for w, _ in lexicon.RELATIVE_DAYS),
    "w": "下\\s*(?:週|禮拜|星期)\\s*[" + lexicon.WEEKDAYS + "天]",
    "a": "|".join(BEFORE_NOON),
    "p": "|".join(AFTER_NOON),
    "n": "[" + "".join(lexicon.HAN_DIGITS) + "]+|[0-9]+",
    "q": "禮拜", "m": "月", "d": "[日號]", "t": "天", "b": "[後后]", "s": "/", "k": "第", "j": "節", "o": "點", "f": "分", "h": "半", "u": "[到至~-]",
}
_WORD = re.compile("|".join(f"(?P<{kind}>{words})" for kind, words in _WORDS.items()))
#: Phrases over the letters of neighbouring words; at one place the first that fits is taken.
_PHRASES = {
    "relative": "r", "after": "n[td]b", "week": "w", "day": "nm(?!n[td]b)nd?|nsn|n(?:d)", "clock": "[ap]?non?f?h?(?:u[ap]?non?f?h?)?", "period": "knj", "weekday": "q",
}
_PHRASE = re.compile("|".join(f"(?P<{name}>{kinds})" for name, kinds in _PHRASES.items()))


def _words(text: str) -> tuple[str, list[re.Match]]:
    """A letter per word, a space where other text stands between two, and the words (None for the others)."""
    kinds, words, at = "", [], 0
    for word in _WORD.finditer(text):
        if text[at : word.start()].strip():
            kinds += " "
            words.append(None)
        kinds += word.lastgroup
        words.append(word)
        at = word.end()
    return kinds, words


def _clock(words: list[re.Match]) -> str:
    """Times in 24 hours.  Of a range, the half of the day holds for both ends; without one at the end, an end before the start is after noon."""
    out, half, start = "", "", None
    for before, word in zip([None, *words], words):
        kind, said, behind = word.lastgroup, word.group(), before.lastgroup if before else ""
        if kind in "ap":
            half = kind
        elif kind == "n" and behind == "o":
            out += f"{han_number(said)}分"
        elif kind == "n":
            hour = han_number(said)
            hour += 12 * (half == "p" and hour < 12) - 12 * (half == "a" and hour == 12)
            if start is not None and start < 12 and hour < start and behind == "u":
                hour += 12
            start = hour
            out += str(hour)
        elif kind in "ouh":
            out += said
    return out


def normalise_text(text: str | None, ref: dt.date) -> str | None:
    """Han dates, weekdays, clock times and class periods of a text in digits; days counted from ref as ISO dates.

    Only one relative-day word is replaced: the first one of the kind that stands first in the lexicon.
    """
    if not text:
        return text
    kinds, words = _words(text)
    chosen = next((m for w, _ in lexicon.RELATIVE_DAYS for m in words if m and m.group() == w), None)
    day = lambda n: (ref + dt.timedelta(n)).isoformat()
    digits = lambda found: "".join(str(han_number(m.group())) if m.lastgroup == "n" else m.group() for m in found)
    out, at = [], 0
    for phrase in _PHRASE.finditer(kinds):
        found = words[phrase.start() : phrase.end()]
        name = phrase.lastgroup
        if name == "relative":
            said = found[0].group()
            written = day(dict(lexicon.RELATIVE_DAYS)[said]) if found[0] is chosen else said
        elif name == "after":
            written = day(han_number(found[0].group()))
        elif name == "week":
            weekday = min(6, (lexicon.WEEKDAYS + "天").index(found[0].group()[-1]))
            written = day((weekday - ref.weekday()) % 7 + 7)
        elif name == "weekday":
            written = "星期"
        else:
            written = _clock(found) if name == "clock" else digits(found)
        out += [text[at : found[0].start()], written]
        at = found[-1].end()
    return "".join([*out, text[at:]])


def normalised(text: Column, ref: dt.date) -> Column:
    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([normalise_text(x, ref) for x in column.to_pylist()], pa.string())

    return run(text)
