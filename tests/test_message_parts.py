import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.functions import text as T


def unmarked(text):
    """How often each mark is left open."""
    return [(s.mark, s.start) for s in T._spans(text) if s.closing == len(text) and s.unmark == "\n```"]


@pytest.mark.parametrize("text,parts", [
    ("**" + "word " * 30 + "end**", lambda ps: all(p.startswith("**") and p.endswith("**") for p in ps)),
    ("```py\n" + "    x = 1\n" * 20 + "```", lambda ps: all(p.startswith("```py\n") and p.endswith("```") and "\n   x" not in p for p in ps)),
    ("||~~" + "word " * 30 + "end~~||", lambda ps: all(p.startswith("||~~") and p.endswith("~~||") for p in ps)),
    ("* " + "item word " * 20 + "\n* second *and* third", lambda ps: not any(p.endswith("**") for p in ps)),
    ("a `" + "b " * 60 + "` c", lambda ps: all(p.count("`") % 2 == 0 for p in ps)),
    ("x" * 75 + " **bold** " + "y" * 40, lambda ps: "".join(ps).count("**") == 2),
    ("2 * 3 ** 4 " * 20, lambda ps: "".join(ps).replace(" ", "") == "2*3**4" * 20),
])
def test_marks_are_whole_in_each_part(text, parts):
    got = T.split_message(text, 80)
    assert len(got) > 1 and all(len(p) <= 80 for p in got) and parts(got), got


pieces = st.lists(st.sampled_from(["word", "字", " ", "\n", "\n\n", "**", "*", "`", "```", "```py\n", "~~", "||", "__", "x" * 40, "  ", "* "]), max_size=60).map("".join)


@settings(max_examples=400, deadline=None)
@given(pieces, st.integers(64, 200))
def test_nothing_is_lost(text, limit):
    cuts = T.message_cuts(text, limit)
    parts = T.split_message(text, limit)
    assert all(len(p) <= limit for p in parts)
    assert cuts[0][1] == 0 and cuts[-1][2] == len(text) or not text[cuts[-1][2] :].strip("\n ")
    for (_, _, end, closed), (opened, start, _, _) in zip(cuts, cuts[1:]):
        assert not text[end:start].strip("\n ")
        assert re.findall(r"[*_~|`]+", opened) and closed or not (opened or closed)
    for (before, _, _, behind), part in zip(cuts[:-1], parts):
        assert not unmarked(part)  # a fence that is opened is closed
        assert before == "" or part.startswith(before)


@settings(max_examples=200, deadline=None)
@given(pieces, st.integers(1, 63))
def test_small_limits_cut_plain_text(text, limit):
    parts = T.split_message(text, limit)
    assert all(len(p) <= limit for p in parts) and re.sub(r"[\n ]", "", "".join(parts)) == re.sub(r"[\n ]", "", text)


def test_time_grows_in_a_straight_line():
    for text in ("**a** " * 100_000, "`" * 300_000, "```" * 100_000, "*a " * 200_000, "~~" + "word " * 100_000 + "~~", "||a" * 100_000):
        began = time.time()
        T.split_message(text, 1900)
        assert time.time() - began < 15
