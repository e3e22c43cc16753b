"""Text functions as Columns; what is sequential within one string is an Arrow-batched function."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dictionary, lexicon


#: Stop words of several characters are words of the text, so that a question can drop them whole.
STOP_DICTIONARY = dictionary.protected(lexicon.STOP_WORDS)


def tokens(text: Column, names: dictionary.Dictionary = STOP_DICTIONARY) -> Column:
    """Lower-cased runs of letters and digits; of texts with Han characters the names of a dictionary whole, and the rest of Han runs as overlapping pairs."""
    has_han = (F.octet_length(text) > F.char_length(text)) & text.rlike(r"\p{IsHan}")  # most texts are ASCII, which a look at their sizes tells
    return F.when(has_han, dictionary.segmented(F.when(has_han, text), names)).otherwise(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


def tokenizer(names: Iterable[str] = ()) -> Callable[[Column], Column]:
    """A tokenizer that also keeps some names whole, for the corpus and its questions alike."""
    own = dictionary.protected([*lexicon.STOP_WORDS, *names])
    return lambda text: tokens(text, own)


def query_tokens(text: Column, tokenize: Callable[[Column], Column] = tokens) -> Column:
    """Tokens of a query: longer than one character and not a stop word (the corpus keeps all)."""
    stop = F.array(*[F.lit(w) for w in lexicon.STOP_WORDS])
    return F.filter(tokenize(text), lambda t: (F.length(t) > 1) & ~F.array_contains(stop, t))


def strip_parens(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "[（(][^）)]*[）)]", ""))


def strip_emoji(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE0F}\x{200D}]", ""))


def escape_markup(text: Column) -> Column:
    return F.translate(text, "<", "＜")


def is_trivial(text: Column) -> Column:
    """Nothing to answer: at most two characters without emoji, or a greeting."""
    bare = F.lower(strip_emoji(text))
    return (F.length(bare) <= 2) | bare.isin("hello", "hi there", "thanks", "good morning", "你好", "哈囉")


def clip_message(role: Column, text: Column) -> Column:
    """User messages keep 1000 characters; long assistant messages their beginning and end."""
    long_reply = F.concat(F.left(text, F.lit(800)), F.lit("…"), F.right(text, F.lit(300)))
    return F.when((role == "user") & (F.length(text) > 1000), F.left(text, F.lit(1000))).when((role == "assistant") & (F.length(text) > 1200), long_reply).otherwise(text)


def markdown_to_html(text: Column) -> Column:
    escaped = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    bold = F.regexp_replace(escaped, r"\*\*([^*\n]+)\*\*", "<b>$1</b>")
    italic = F.regexp_replace(bold, r"\*([^*\n]+)\*", "<i>$1</i>")
    code = F.regexp_replace(italic, "`([^`\n]+)`", "<code>$1</code>")
    return F.regexp_replace(code, r"\[([^\]\n]+)\]\((https?://[^)\s]+)\)", '<a href="$2">$1</a>')


def bare_links(text: Column) -> Column:
    """[t](u) to [t](<u>) and a URL on its own to <u>."""
    wrapped = F.regexp_replace(text, r"\]\((https?://[^)\s]+)\)", "](<$1>)")
    return F.regexp_replace(wrapped, r"(?<![<(])(https?://[^\s<>)]+)", "<$1>")


_PROTECTED = re.compile(r"```.*?```|`[^`]*`|\[[^\]]*\]\([^)]*\)|https?://\S+", re.S)
_HAN = "⺀-⿟぀-ヿ㐀-䶿一-鿿豈-﫿"
_GAPS = (re.compile(f"([{_HAN}])([A-Za-z0-9])"), re.compile(f"([A-Za-z0-9%])([{_HAN}])"))


def space_text(text: str | None) -> str | None:
    """One space between Han and Latin or digits, but not inside code, links and URLs."""
    if text is None:
        return None
    parts, at = [], 0
    for kept in _PROTECTED.finditer(text):
        parts += [(text[at : kept.start()], True), (kept.group(), False)]
        at = kept.end()
    parts.append((text[at:], True))
    out = []
    for part, free in parts:
        for gap in _GAPS if free else ():
            part = gap.sub(r"\1 \2", part)
        out.append(part)
    return "".join(out)


_MARKS = re.compile(r"```(?:\w{1,16}\n)?|`|\*\*|\*|~~|\|\||__|\n[ \t]*\n")
#: Below this limit the marks of a message would leave no room for its text.
LEAST_MARKED = 64


class _Span(NamedTuple):
    """Marked text: where its marks begin and end, and what has to be written to open and to close it anew."""

    start: int
    opened: int
    closing: int
    end: int
    mark: str
    unmark: str


def _spans(text: str) -> list[_Span]:
    """The marked stretches of a text in order: code fences, code within a line, and emphasis within a paragraph; nested, never crossing.

    A mark without its partner is text. A fence that is never closed runs to the end.
    """
    spans: list[_Span] = []
    open_: list[re.Match] = []
    ticks = {m.start(): m for m in _MARKS.finditer(text)}
    starts, at = sorted(ticks), 0
    fences = [s for s in starts if ticks[s].group().startswith("```")]
    at_fence = 0
    for start in starts:
        m = ticks[start]
        mark = m.group()
        if start < at:
            continue
        if mark.startswith("```"):
            while at_fence < len(fences) and fences[at_fence] <= start:
                at_fence += 1
            closing = fences[at_fence] if at_fence < len(fences) else len(text)
            at = min(closing + 3, len(text))
            spans.append(_Span(start, m.end(), closing, at, mark if mark.endswith("\n") else mark + "\n", "\n```"))
            open_.clear()
        elif mark == "`":
            line_end = text.find("\n", start)
            closing = text.find("`", m.end(), line_end if line_end >= 0 else len(text))
            if closing > m.end():
                at = closing + 1
                spans.append(_Span(start, m.end(), closing, at, "`", "`"))
        elif mark.startswith("\n"):
            open_.clear()
        elif (depth := next((i for i in range(len(open_) - 1, -1, -1) if open_[i].group() == mark), None)) is not None and not text[start - 1].isspace():
            first = open_[depth]
            if first.end() < start:
                spans.append(_Span(first.start(), first.end(), start, m.end(), mark, mark))
            del open_[depth:]
        elif not text[m.end() : m.end() + 1].isspace() and mark not in {o.group() for o in open_}:
            open_.append(m)
    return sorted(spans)


def message_cuts(text: str, limit: int, least: float = 1 / 3) -> list[tuple[str, int, int, str]]:
    """Parts of a message as (marks opened anew, start, end, marks closed): each part with its marks has at most ``limit`` characters.

    A part ends at a blank line, a line end, a space, or hard, in the later two thirds of its room; what lies between two parts is white space.
    """
    spans = _spans(text) if limit >= LEAST_MARKED else []
    cuts, start, reopened, first = [], 0, [], 0
    while len(text) - start > limit - sum(len(s.mark) for s in reopened):
        before = "".join(s.mark for s in reopened)
        room = max(1, limit - 8 - len(before))  # for the marks to be closed
        while True:
            cut = next((at for edge in ("\n\n", "\n", " ") if (at := text.rfind(edge, start, start + room)) >= start + max(1, room * least)), start + room)
            while first < len(spans) and spans[first].end <= start:
                first += 1
            over: list[_Span] = []
            for s in spans[first:]:
                if s.start >= cut:
                    break
                if s.end > cut:
                    over.append(s)
            inner = next((s for s in over if cut <= s.opened), None)  # nothing of it would be in this part: it goes to the next
            if inner is not None and inner.start > start:
                cut = inner.start
                over = [s for s in over if s.start < cut]
            skip = "\n" if any(s.unmark == "\n```" for s in over) else "\n "  # the indentation of code is kept
            after = cut
            while after < len(text) and text[after] in skip and (skip == "\n " or after == cut):
                after += 1
            done = [s for s in over if s.closing <= after and s.unmark != "\n```"]  # all of it is in this part
            if done:
                cut = after = max(s.end for s in done)
                over = [s for s in over if s.end > cut]
            behind = "".join(s.unmark for s in reversed(over))
            excess = cut - start + len(before) + len(behind) - limit
            if excess <= 0 or room <= excess + 1:
                break
            room -= excess
        cuts.append((before, start, cut, behind))
        start, reopened = after, over
    if start < len(text) or not cuts:
        cuts.append(("".join(s.mark for s in reopened), start, len(text), ""))
    return cuts


def split_message(text: str | None, limit: int, least: float = 1 / 3) -> list[str]:
    """Parts of at most ``limit`` characters (``message_cuts``); fences, code and emphasis that a cut divides are closed and opened anew.

    An empty or null text is one empty part; limits under 64 leave marks alone.
    """
    text = text or ""
    return [before + text[start:end] + behind for before, start, end, behind in message_cuts(text, limit, least)]


def split_lines(text: str | None, limit: int = 4000) -> list[str]:
    """Parts of at most ``limit`` characters, cut at the last line end that fits, or hard."""
    rest, parts = text or "", []
    while len(rest) > limit:
        at = rest.rfind("\n", 0, limit)
        at = at if at > 0 else limit
        parts.append(rest[:at])
        rest = rest[at:].lstrip("\n")
    return [*parts, rest] if rest or not parts else parts


def framed(role: str, text: Column) -> Column:
    """A text between tags of its role, its own markup escaped so that it cannot close them."""
    return F.concat(F.lit(f"<{role}>\n"), escape_markup(text), F.lit(f"\n</{role}>"))


def char_overlap(a: str, b: str) -> float:
    """Share of positions of the shorter text that hold the same character."""
    n = min(len(a), len(b))
    return sum(x == y for x, y in zip(a, b)) / n if n else 0.0


def drop_repeated_block(text: str | None, least: int = 50, same: float = 0.4) -> str | None:
    """The text without its second half if that repeats the first, found at a paragraph or line edge."""
    if text is None or len(text) < 2 * least:
        return text
    middle = len(text) // 2
    for edge in sorted((m.end() for m in re.finditer("\n+", text)), key=lambda at: abs(at - middle)):
        head, tail = text[:edge].strip(), text[edge:].strip()
        if abs(edge - middle) <= len(text) * 0.15 and min(len(head), len(tail)) >= least and char_overlap(head, tail) > same:
            return head
    return text


#: Texts of a batch that are Python objects at a time.
SLICE = 16


def _in_slices(function, arrow: pa.DataType, column: pa.Array) -> pa.Array:
    done = [pa.array([function(x) for x in column.slice(at, SLICE).to_pylist()], arrow) for at in range(0, len(column), SLICE)]
    return pa.concat_arrays(done) if done else pa.array([], arrow)


def _batched(function, kind: str, arrow):
    @F.arrow_udf(kind)
    def run(column: pa.Array) -> pa.Array:
        return _in_slices(function, arrow, column)

    return run


def spaced(text: Column) -> Column:
    return _batched(space_text, "string", pa.string())(text)


def message_parts(text: Column, limit: int) -> Column:
    return _batched(lambda x: split_message(x, limit), "array<string>", pa.list_(pa.string()))(text)


def line_parts(text: Column, limit: int = 4000) -> Column:
    return _batched(lambda x: split_lines(x, limit), "array<string>", pa.list_(pa.string()))(text)


def without_repeats(text: Column) -> Column:
    return _batched(drop_repeated_block, "string", pa.string())(text)
