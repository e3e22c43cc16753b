"""Segmentation by a dictionary, names found by an automaton, chunks of whole sentences."""

import itertools
import pickle
import random
import time

import pytest
from pyspark.sql import functions as F

from marlstone.functions import chunking as C
from marlstone.functions import dictionary as N
from marlstone.functions import text as T
from marlstone.operators import retrieve as R
from marlstone.plans import route


def one_by_one(text: str, names: dict[str, str]) -> list[str]:
    """Every name in turn, the longest first."""
    found = []
    for name, value in sorted(names.items(), key=lambda x: -len(x[0])):
        if name and name in text:
            if value not in found:
                found.append(value)
            text = text.replace(name, "")
    return found


def test_names_are_consumed_as_if_tried_in_turn():
    rng = random.Random(1)
    word = lambda most: "".join(rng.choice("ab資工") for _ in range(rng.randint(0, most)))
    for _ in range(3000):
        names = {word(4): rng.choice("xyz") for _ in range(rng.randint(0, 8))}
        text = word(14)
        assert N.Dictionary(names).consumed(text) == one_by_one(text, names)


def test_time_does_not_follow_the_number_of_names():
    took = []
    for n in (100, 100_000):
        names = pickle.loads(pickle.dumps(N.Dictionary(f"name{i:06d}" for i in range(n))))
        names.consumed("built")
        began = time.perf_counter()
        for i in range(300):
            assert names.consumed(f"請問name{i % 100:06d}老師") == [f"name{i % 100:06d}"]
        took.append(time.perf_counter() - began)
    assert took[1] < 5 * took[0] + 0.05


def test_matches_are_all_occurrences():
    rng = random.Random(2)
    for _ in range(300):
        names = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 4))) for _ in range(5)}
        text = "".join(rng.choice("ab") for _ in range(12))
        expected = sorted((i + len(n), n) for n in names for i in range(12) if text.startswith(n, i))
        assert sorted(N.Dictionary(names).matches(text)) == expected


def plain_cost(text: str, names: set[str]) -> tuple[int, int]:
    """Fewest characters outside names, and fewest names for that."""
    best = [(0, 0)]
    for end in range(1, len(text) + 1):
        options = [(best[end - 1][0] + 1, best[end - 1][1])]
        options += [(best[end - len(n)][0], best[end - len(n)][1] + 1) for n in names if end >= len(n) and text[:end].endswith(n)]
        best.append(min(options))
    return best[-1]


def test_paths_leave_the_fewest_characters_outside():
    rng = random.Random(3)
    for _ in range(1000):
        names = {"".join(rng.choice("天地人") for _ in range(rng.randint(2, 4))) for _ in range(rng.randint(0, 5))}
        text = "".join(rng.choice("天地人 ") for _ in range(rng.randint(0, 15)))
        path = N.Dictionary(names).path(text)
        assert all(text[a:b] in names for a, b in path) and all(x[1] <= y[0] for x, y in itertools.pairwise(path))
        assert (len(text) - sum(b - a for a, b in path), len(path)) == plain_cost(text, names)


def test_names_do_not_split_latin_words():
    d = N.protected(["C語言", "art", "ab系"])
    assert d.segments("學C語言 partC語言 ab系 xab系") == ["學", "c語言", "partc", "語言", "ab系", "xab", "系"]


@pytest.mark.parametrize(
    "question,names,terms",
    [
        ("請問一下資料庫在哪裡", [], ["資料", "料庫"]),
        ("請問一下資料庫在哪裡", ["資料庫"], ["資料庫"]),
        ("想知道陳鍾誠老師的C語言", ["陳鍾誠", "C語言"], ["陳鍾誠", "c語言"]),
        ("微積分（一）有沒有開課", ["微積分（一）"], ["微積分（一）"]),
        ("who knows", ["資料庫"], ["who", "knows"]),
        ("", ["資料庫"], []),
    ],
)
def test_question_terms(spark, question, names, terms):
    df = spark.createDataFrame([(question,), (None,)], "q string")
    got = [r[0] for r in df.select(T.query_tokens(F.col("q"), T.tokenizer(names))).collect()]
    assert got == [terms, None]


def test_a_name_is_one_term_of_the_index(spark):
    rows = [(1, "陳鍾誠老師教資料庫系統"), (2, "鍾誠路的資料"), (3, "系統程式 陳鍾誠"), (4, None), (5, "")]
    df = spark.createDataFrame(rows, "node_id long, text string")
    tokenize = T.tokenizer(["陳鍾誠", "資料庫系統"])
    index = R.keyword_index(df, tokenize=tokenize)
    ask = lambda q: {r.node_id for r in R.bm25(index, df.limit(1).select(F.lit(0).alias("query_id"), F.explode(T.query_tokens(F.lit(q), tokenize)).alias("term"))).collect()}
    assert ask("請問陳鍾誠的課表") == {1, 3}
    assert ask("資料庫系統在哪裡") == {1}
    assert ask("資料") == {2}


def test_teachers_and_courses_of_a_question(spark):
    df = spark.createDataFrame([("王小明老師的線性代數跟線性",), (None,), ("",)], "q string")
    people, titles = N.Dictionary(["王小明", "小明"]), N.Dictionary(["線性", "線性代數", "代數"])
    got = [tuple(r) for r in df.select(route.teachers(F.col("q"), people), route.courses(F.col("q"), titles)).collect()]
    assert got == [(["王小明"], ["線性代數", "線性"]), ([], []), ([], [])]


def test_year_does_not_count_for_general_and_physical_education(spark):
    df = spark.createDataFrame([("通識有什麼大一的課",), ("大二體育",), ("大二體育系",), ("大一的課",)], "q string")
    assert [r[0] for r in df.select(route.grade(F.col("q"))).collect()] == [None, None, "二", "一"]


def test_too_many_names_are_refused(spark):
    df = spark.range(5).selectExpr("cast(id AS string) AS name")
    assert N.names_of(df.union(df), most=5) == list("01234")
    with pytest.raises(ValueError):
        N.names_of(df, most=4)


def mixed_text(rng, sentences: int) -> str:
    out = []
    for _ in range(sentences):
        n = rng.choice([1, 3, 9, 40])
        if rng.random() < 0.5:
            out.append("".join(rng.choice("天地玄黃宇宙洪荒") for _ in range(n)) + rng.choice("。！，") + rng.choice(["", "」", "\n"]))
        else:
            out.append(" ".join(rng.choice(["alpha", "b", "c.d", "3.14", "語a言"]) for _ in range(n)) + rng.choice([". ", "! ", '." ', ", ", "\n\n", " "]))
    return "".join(out)


@pytest.mark.parametrize("size,overlap", [(1, 0), (7, 3), (20, 19), (50, 8)])
def test_chunks_keep_the_budget_and_lose_nothing(size, overlap):
    rng = random.Random(size)
    for _ in range(150):
        text = mixed_text(rng, rng.randint(0, 25))
        spans = C.token_spans(text)
        ends = C.sentence_ends(text, spans, size)
        chunks = list(C.chunks_of(text, size, overlap))
        assert all(n <= size and len(C.token_spans(part)) == n for _, n, _, part in chunks)
        covered = set()
        for k, (first, n, char, part) in enumerate(chunks):
            assert text[char : char + len(part)] == part and first in [0, *ends] and first + n in ends
            covered |= set(range(first, first + n))
            if k:
                before, size_before = chunks[k - 1][:2]
                shared = before + size_before - first
                assert before < first and 0 <= shared <= overlap
                assert first + n > before + size_before
        assert covered == set(range(len(spans)))
        if not overlap:
            assert "".join(c for _, _, _, part in chunks for c in part if not c.isspace()) == "".join(c for c in text if not c.isspace())


def test_han_text_is_cut():
    chunks = list(C.chunks_of("資料庫系統。" * 4000))
    assert len(chunks) > 14 and all(n <= C.SIZE for _, n, _, _ in chunks)
    assert all(part.startswith("資料庫") and part.endswith("。") for *_, part in chunks)
    assert [n for _, n, _, _ in C.chunks_of("漢" * 22_000, 1536, 128)] == [1536] * 14 + [496]
    with pytest.raises(ValueError):
        list(C.chunks_of("a", 5, 5))


def test_chunk_rows_keep_columns(spark, monkeypatch):
    monkeypatch.setattr(C, "FLUSH", 3)
    df = spark.createDataFrame([(1, "一二三。四五。", "x"), (2, None, "y"), (3, " \n", "z"), (3, "a b c. d e", None)], "id long, text string, chunk string")
    out = C.chunk_rows(df, 4, 0)
    assert out.columns == ["id", "text", "_chunk", "chunk", "first_token", "n_tokens", "first_char"]
    assert sorted(map(tuple, out.collect()), key=repr) == [(1, "一二三。", "x", 0, 0, 4, 0), (1, "四五。", "x", 1, 4, 3, 4), (3, "a b c.", None, 0, 0, 3, 0), (3, "d e", None, 1, 3, 2, 7)]
    assert C.chunk_rows(df.limit(0)).count() == 0


def test_names_of_a_table_are_found_as_by_a_dictionary(spark):
    from marlstone.functions import dictionary as D

    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("ab資") for _ in range(n))
    names = sorted({word(rng.choice([1, 2, 3, 5, 9, 17, 20])) for _ in range(40)} - {"a"})
    texts = [None, "", "zzz", names[-1] * 40] + [word(rng.choice([0, 3, 30])) + rng.choice(names) + word(4) for _ in range(40)] + ["x" * 300 + n + "y" * 300 for n in names if len(n) > 16]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    plain = D.Dictionary(names)
    for held in (names, ["ab", "cd", "bd"], []):
        plain, table = D.Dictionary(sorted(held)), spark.createDataFrame([(n,) for n in [*held, None, ""]], "name string")
        some = rows.union(spark.createDataFrame([(900, "acdbcdd"), (901, "abcd")], rows.schema))
        got = {r.id: r.found for r in D.with_names(some, F.col("text"), table, "found").collect()}
        assert got == {r.id: plain.consumed(r.text or "") for r in some.collect()}


def test_route_names_collects_no_registry(spark, sf_dir, monkeypatch):
    from marlstone.functions import dictionary as D
    from marlstone.plans import catalogue

    monkeypatch.setattr(D, "names_of", lambda *a, **k: (_ for _ in ()).throw(ValueError("too many names")))
    assert catalogue.QUERIES["route_names"](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/customer.parquet").count()
