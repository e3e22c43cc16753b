import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlstone.functions.loose import mended
from marlstone.sources import readers as S


@pytest.mark.parametrize("said,meant", [
    ("{'a': 'it's', 'b': [True, None, False]}", {"a": "it's", "b": [True, None, False]}),
    ("{a: 1, b_2: two words, c: {d: [1 , 2 3]}}", {"a": 1, "b_2": "two words", "c": {"d": [1, 2, 3]}}),
    ('{"a": 1 "b": "x" "c": [1, {"d": 2} {"e": 3}]}', {"a": 1, "b": "x", "c": [1, {"d": 2}, {"e": 3}]}),
    ('{"a": 1, // note\n /* more */ "b": 2,}', {"a": 1, "b": 2}),
    ('Use {braces} so: {"a": "}"} done {', {"a": "}"}),
    ('{"a": 12.', {"a": 12}), ('{"a": 1, "b', {"a": 1}), ('{"a": 1, "b":', {"a": 1}), ('{"a": "x\\', {"a": "x"}), ('{"a": , "b": 007}', {"a": None, "b": "007"}),
    ('{"a": "line\nbreak", "b": "\\ud83d\\ude00\\q"}', {"a": "line\nbreak", "b": "😀q"}), ('{"a": [1, 2}', {"a": [1, 2]}), ("{}", {}),
    ('```json\n{"學分": 3, "課": "微積分\n```', {"學分": 3, "課": "微積分"}), ('{"a": 1, "b": 2]}', {"a": 1, "b": 2}),
])
def test_faults_are_mended(said, meant):
    assert json.loads(mended(said)) == meant


@pytest.mark.parametrize("said", [None, "", "nothing", "{oops", "{", "{]", "{" * 5000, "[" * 5000 + "{"])
def test_no_object_no_change(said):
    out = mended(said)
    assert out == said or json.loads(out) in ({}, [])


leaves = st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text()
values = st.dictionaries(st.text(), st.recursive(leaves, lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(), x, max_size=4), max_leaves=12), min_size=1)


@settings(max_examples=300, deadline=None)
@given(values, st.booleans())
def test_valid_json_keeps_its_meaning(value, plain):
    assert json.loads(mended("so: " + json.dumps(value, ensure_ascii=plain) + " ok")) == value


simple = st.text("abcXYZ 課程,:{}[]", max_size=12)
plain_values = st.dictionaries(st.from_regex(r"[a-z]{1,6}", fullmatch=True), st.recursive(st.none() | st.booleans() | st.integers() | simple, lambda x: st.lists(x, max_size=4), max_leaves=8), min_size=1)


@settings(max_examples=300, deadline=None)
@given(plain_values)
def test_damaged_json_is_read(value):
    assert json.loads(mended(repr(value))) == value  # single quotes and other literals
    bare = "{" + " ".join(f"{k}: {json.dumps(v)}" for k, v in value.items()) + ",}"  # bare keys, no commas
    assert json.loads(mended(bare)) == value


@settings(max_examples=200, deadline=None)
@given(plain_values, st.data())
def test_cut_json_keeps_whole_members(value, data):
    text = json.dumps(value)
    cut = text[: data.draw(st.integers(1, len(text)))]
    whole = json.loads(text)
    out = mended(cut)
    if out != cut or cut == text:
        got = json.loads(out)
        assert list(got) == list(whole)[: len(got)] and all(got[k] == whole[k] for k in list(got)[:-1])


def test_damaged_rows_reach_the_table(spark):
    rows = spark.createDataFrame([(1, "{'schedule': {gpa: 80 'name': 'x'}}"), (2, "{gpa: 70"), (3, "{oops"), (4, None), (5, "")], "id int, json string")
    good, bad = S.json_records(rows, "gpa int, name string")
    assert {(r.id, r.record.gpa, r.record.name) for r in good.collect()} == {(1, 80, "x"), (2, 70, None)}
    assert {r.id for r in bad.collect()} == {3, 4, 5}
    assert rows.select(S.repaired_json(F.col("json"))).count() == 5
