import pytest
from helpers import DOCS, corpus, frame, similar_groups

from marlstone.llm import decontaminate as D

ITEM = "Alice has 12 apples and gives 5 kg of pears to Bob before the market closes at noon today"
ITEMS = [(1, ITEM), (2, None), (3, "tiny item here"), (4, ""), (5, ITEM), (6, "A B C D E F G H I J K L"), (7, "the quick brown fox jumps over the lazy dog while seven wizards watch from a hill")]


def bench(spark, rows=None):
    return spark.createDataFrame(ITEMS if rows is None else rows, "item_id long, text string")


def docs(spark, texts):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS)


@pytest.mark.parametrize("probe", [D.PROBE_WINDOWS, -1])
def test_leaks(spark, monkeypatch, probe):
    monkeypatch.setattr(D, "PROBE_WINDOWS", probe)
    other = ITEM.replace("Alice", "Carol").replace("12", "7").replace("5 kg", "9 lb").replace("Bob", "Dave")
    texts = ["intro words. " + ITEM + ". more", "so " + other, other.replace("Dave", "Carol"), None, "", "a TINY item here b", "nothing of the sort is in this one at all", ITEM[: len(ITEM) // 3]]
    rows = D.leaks(docs(spark, texts), bench(spark)).collect()
    assert sorted((r.doc_id, r.item_id, r.verbatim) for r in rows) == [(0, 1, True), (1, 1, False)]


@pytest.mark.parametrize("probe", [D.PROBE_WINDOWS, -1])
def test_copies_in_few_literal_words(spark, monkeypatch, probe):
    monkeypatch.setattr(D, "PROBE_WINDOWS", probe)
    table = "Year 1990 1991 1992 1993 Rome 14 15 16 17 Oslo 3 4 5 6 Lima 19 20 21 22"
    hill = ITEMS[6][1]
    texts = ["so A B C D E F G H I J K L it is", "a b c d e f g h i j k l", hill.upper(), hill.title(), "see " + table, table.replace("1", "7"), "Intro words here", "A C B E D G F I H K J L"]
    rows = D.leaks(docs(spark, texts), bench(spark, [*ITEMS, (8, table)])).collect()
    assert sorted((r.doc_id, r.item_id, r.verbatim, r.share) for r in rows) == [(0, 6, True, 1), (1, 6, True, 1), (2, 7, True, 1), (3, 7, True, 1), (4, 8, True, 1)]


def test_a_slot_out_of_line_costs_its_windows_only(spark):
    sums = "Anna picks 3 red apples and then 4 green apples from the old tree before lunch and sells 2 of them"
    tale = "yesterday morning Mary went down to the market with a basket and a list of things that she had to buy and there Mary met the baker who sold bread and cake to all of them"
    texts = [sums.replace("3", "5").replace("4", "5"), tale.replace("Mary met", "Maria met"), tale.replace("Mary", "Maria"), sums, tale.replace("went down to the market with a basket and a list of things that she had to", "should")]
    rows = D.leaks(docs(spark, texts), bench(spark, [(1, sums), (2, tale)])).collect()
    assert sorted((r.doc_id, r.item_id, r.verbatim, r.share == 1) for r in rows) == [(0, 1, False, True), (1, 2, False, False), (2, 2, False, True), (3, 1, True, True)]


def test_short_items_and_repeated_rows(spark):
    d = docs(spark, ["x tiny item here y"])
    rows = D.leaks(d.union(d), bench(spark)).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(0, 3)}
    assert D.drop_leaks(d.union(d), bench(spark)).count() == 0


def test_an_answer_of_a_word_is_no_leak(spark):
    items = [(1, "yes"), (2, "in 1990"), (3, "tiny item here"), (4, None), (5, "a b c d"), (6, "這是一個關於台灣最高的山究竟是哪一座而且有多高的問題"), (7, "yes")]
    texts = ["well yes it was", "in 1990 a b c d", "a tiny item here", "x 這是一個關於台灣最高的山究竟是哪一座而且有多高的問題 y"]
    found = D.leaks(docs(spark, texts), bench(spark, items)).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(2, 3), (3, 6)]
    assert sorted(r.item_id for r in D.too_short(bench(spark, items)).collect()) == [1, 2, 4, 5, 7]


def test_every_item_is_searched_for_if_asked(spark):
    items = [(1, "yes"), (2, "in 1990"), (4, None), (5, "")]
    found = D.leaks(docs(spark, ["well yes it was", "in 1990 a b"]), bench(spark, items), lone_chars=0).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(0, 1), (1, 2)]
    assert [r.item_id for r in D.too_short(bench(spark, items), lone_chars=0).orderBy("item_id").collect()] == [4, 5]


def test_a_preamble_that_all_items_share_pairs_nothing(spark, monkeypatch):
    preamble = "read the following question with care and then write down the answer that you think is right"
    own = lambda k: " ".join(f"w{k}x{j}" for j in range(26))
    items = [(k, f"{preamble} {own(k)}") for k in range(40)]
    texts = [f"{preamble} and nothing else {k}" for k in range(30)] + [f"so {preamble} {own(7)} yes", own(9)]
    joined = []
    real = D.common.materialize
    monkeypatch.setattr(D.common, "materialize", lambda df, name: (lambda out: joined.append(out.count()) or out if name == "pairs" else out)(real(df, name)))
    rows = D.leaks(docs(spark, texts), bench(spark, items)).collect()
    assert sorted((r.doc_id, r.item_id, r.verbatim) for r in rows) == [(30, 7, True), (31, 9, True)]
    assert joined == [2]  # not 31 documents with 40 items


def test_clashing_columns_and_long_texts(spark):
    long = "word " * 200_000 + ITEM
    d = docs(spark, [long, None, ""]).selectExpr("*", "1 AS __doc_id", "2 AS __key", "3 AS hash", "4 AS item_id")
    out = D.drop_leaks(d, bench(spark))
    assert out.columns == d.columns and sorted(r.doc_id for r in out.collect()) == [1, 2]


def test_slots():
    t = D.Templates([b"Anna ate 3,5 kg of kg plums, (42) -- 7"])
    assert t.kind.tolist() == [D.NAME, D.LITERAL, D.NUMBER, D.UNIT, D.LITERAL, D.LITERAL, D.LITERAL, D.NUMBER, D.LITERAL, D.NUMBER]
    assert t.slots(0, 4) == ["3anna", "13,5", "2kg"]


def test_clean_documents_and_columns_stay(spark):
    df = frame(spark, extra=True)
    out = D.drop_leaks(df, bench(spark))
    assert out.columns == df.columns and out.count() == len(corpus())


def test_empty_tables(spark):
    assert D.leaks(frame(spark, []), bench(spark)).count() == 0
    assert D.leaks(frame(spark), bench(spark, [])).count() == 0
    assert D.drop_leaks(frame(spark), bench(spark, [])).count() == len(corpus())


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as P

    from marlstone.llm import common, lines, pieces

    at = common.read(spark, sf_dir, "documents")
    columns = at.columns
    for name, stage in P.STAGES[:-1]:
        before, at = at, common.materialize(stage(spark, at, sf_dir), name)
        assert at.columns == columns
        texts = {r.doc_id: r.text for r in before.collect()}
        kept = {r.doc_id: r.text for r in at.collect()}
        assert kept.keys() <= texts.keys() and len(kept) > 0.5 * len(texts)
        if name == "line_dedup":
            expected = {r.doc_id: r.text for r in lines.dedup(before).collect()}
            assert kept == expected and kept != texts
        elif name == "near_dedup":
            ids = sorted(texts)
            assert kept.keys() == {ids[k] for k in similar_groups([texts[i] for i in ids])}
        else:
            assert all(kept[i] == texts[i] for i in kept)
    last = P.STAGES[-1][1](spark, at, sf_dir).collect()
    assert {r.doc_id for r in last} == {r.doc_id for r in at.collect()} and all(r.round_trip for r in last)
    assert {r.doc_id for r in P.run(spark, sf_dir).collect()} == {r.doc_id for r in last}
    assert pieces.load().pieces


def test_pipeline_of_awkward_rows(spark, tmp_path):
    import corpus_pipeline as P

    from marlstone.llm import common

    def folder(name, rows):
        at = f"{tmp_path}/{name}"
        frame(spark, rows, extra=True).write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([(4, 1, 0), (7, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
        bench(spark).write.parquet(f"{at}/benchmark.parquet")
        return at

    rows = [*corpus(), (500, "before " + ITEM + " after", None, None, 1), (501, "before " + ITEM + " after", None, None, 1)]
    at = folder("rows", rows)
    docs = common.read(spark, at, "documents")
    stages = {}
    for name, stage in P.STAGES:
        docs = stages[name] = common.materialize(stage(spark, docs, at), name)
    assert all(stages[name].columns == stages["toxicity"].columns for name in list(stages)[:-1])
    seen = {name: sorted([(r.doc_id, r.text) for r in df.collect()], key=repr) for name, df in stages.items()}
    assert len(seen["toxicity"]) == len(seen["line_dedup"]) == len(rows)
    before = sorted(set(seen["line_dedup"]), key=repr)
    assert len(set(seen["near_dedup"])) == len(set(similar_groups([t for _, t in before])))
    assert [x for x in seen["near_dedup"] if x[0] == 500] and not [x for x in seen["near_dedup"] if x[0] == 501]
    assert [x for x in seen["near_dedup"] if x[0] != 500] == seen["decontamination"] == seen["encoding"]
    assert all(r.round_trip for r in stages["encoding"].collect())
    assert sorted([(r.doc_id, r.text) for r in P.run(spark, at).collect()], key=repr) == seen["encoding"]
    assert P.run(spark, folder("none", [])).count() == 0
