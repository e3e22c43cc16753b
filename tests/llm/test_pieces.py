import random

import pytest
from helpers import corpus, frame

from marlstone.llm import pieces


def best(vocabulary, token):
    """Plain dynamic programme over all pieces that end at a position."""
    state = [(0.0, ())]
    for end in range(1, len(token) + 1):
        score, ids = state[end - 1]
        options = [(score + vocabulary.fallback, 0, ids + tuple(vocabulary.byte_ids[b] for b in token[end - 1].encode()))]
        for start in range(max(0, end - 20), end):
            if token[start:end] in vocabulary.scores:
                s, i = vocabulary.scores[token[start:end]]
                options.append((state[start][0] + s, end - start, state[start][1] + (i,)))
        top = max(options, key=lambda o: o[:2])
        state.append((top[0], top[2]))
    return state[-1][1]


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load()


def test_viterbi_and_trie_against_plain_search(vocabulary, monkeypatch):
    rng = random.Random(3)
    texts = ["", " ", "hello world", " a  b ", "漢字😀 x\ty\n\nz é", "a" * 400, *("".join(rng.choice("abcehtinor é漢\t\n ") for _ in range(rng.randint(0, 60))) for _ in range(150))]
    encoder, trie = pieces.Encoder(vocabulary), pieces.CountingTrie(vocabulary)
    for small in (False, True):
        if small:  # tables that overflow give the same results
            monkeypatch.setattr(pieces, "CACHE", 3)
            monkeypatch.setattr(pieces, "NODES", 40)
        for text in texts:
            ids = []
            for token in pieces.pre_tokens(text):
                expected = best(vocabulary, token)
                assert encoder[token] == expected and trie[token] == len(expected)
                ids += expected
            assert pieces.decode_ids(vocabulary, ids) == text


def test_whole_texts_round_trip(spark):
    rows = pieces.encode(frame(spark, extra=True)).collect()
    assert len(rows) == len(corpus()) and all(r.round_trip for r in rows)
    assert all(len(r.token_ids) == r.n_tokens for r in rows)
    counted = pieces.count(frame(spark)).collect()
    assert sorted([(r.doc_id, r.n_tokens) for r in rows], key=repr) == sorted([(r.doc_id, r.n_tokens) for r in counted], key=repr)


def test_text_that_holds_the_mark_for_a_space(spark, vocabulary):
    texts = ["a▁b", "▁", " ▁ x", "▁▁漢"]
    df = frame(spark, [(i, t, None, None, None) for i, t in enumerate(texts)])
    rows = pieces.encode(df).collect()
    assert all(r.round_trip for r in rows) and [r.n_tokens for r in sorted(rows)] == [r.n_tokens for r in sorted(pieces.count(df).collect())]
    assert sorted(r.t for r in pieces.encode(df).select(pieces.decode("token_ids").alias("t")).collect()) == sorted(texts)


def test_columns_stay(spark):
    df = frame(spark, extra=True).selectExpr("*", "'x' AS n_tokens", "array(1) AS more", "timestamp'2024-01-01' AS at")
    for out, made in ((pieces.encode(df, keep_ids=False), ["n_tokens", "ids_sha256", "round_trip"]), (pieces.count(df), ["n_pretokens", "n_tokens"])):
        assert out.columns == [c for c in df.columns if c != "n_tokens"] + made
        assert sorted([(r.doc_id, r.text) for r in out.collect()], key=repr) == sorted([(r.doc_id, r.text) for r in df.collect()], key=repr)


def field(number, value):
    if isinstance(value, int):
        return bytes([number * 8, value])
    return bytes([number * 8 + 2, len(value)]) + value


def test_unsupported_models_are_refused():
    piece = field(1, field(1, b"ab") + bytes([2 * 8 + 5]) + b"\0\0\0\0")
    plain = field(3, field(1, b"identity") + field(4, 0))
    assert pieces.dummy_prefix(piece + plain) is True
    assert pieces.dummy_prefix(field(3, field(3, 0) + field(4, 0))) is False
    for settings in (field(2, b"table") + field(4, 0), field(3, 1), field(4, 1), field(4, 0) + field(5, 0)):
        with pytest.raises(ValueError):
            pieces.dummy_prefix(field(3, settings))
    with pytest.raises(ValueError):
        pieces.dummy_prefix(field(1, field(1, b"ab") + field(3, 4)) + plain)


def test_pre_tokens_longer_than_the_trie(spark, monkeypatch):
    texts = ["x" * 3000 + " y", "ab" * 2000, None]
    df = frame(spark, [(i, t, None, None, None) for i, t in enumerate(texts)])
    expected = {r.doc_id: r.n_tokens for r in pieces.encode(df).collect()}
    monkeypatch.setattr(pieces, "NODES", 500)
    trie = pieces.CountingTrie(pieces.load())
    assert {i: sum(trie[x] for x in pieces.pre_tokens(t)) for i, t in enumerate(texts)} == expected


def test_decode_column(spark):
    rows = pieces.encode(frame(spark)).select(pieces.decode("token_ids").alias("text")).collect()
    assert sorted(r.text for r in rows) == sorted(r[1] or "" for r in corpus())
    assert spark.createDataFrame([([None, -1, 10**6],), (None,)], "x array<int>").select(pieces.decode("x").alias("t")).collect()[0].t == ""


def test_empty_table(spark):
    assert pieces.encode(frame(spark, [])).count() == 0 and pieces.count(frame(spark, [])).count() == 0
