"""Encoding, decoding and counting of SentencePiece unigram pieces.

The pieces, scores and settings of a SentencePiece model file are read with the public
``sentencepiece`` library; segmentation is done here.  A text becomes
``U+2581 + text`` (if the model has a dummy prefix) with every space as U+2581.  The encoding is the sequence of pieces with the largest score
sum, where each piece costs ``TIE`` more, so that the fewest pieces win among equal
sums; then the longest last piece wins, and so on backwards.  A code point that
no piece covers, and a U+2581 of the text itself, costs ``lowest score - 10`` (and half a TIE) and becomes its UTF-8 byte
pieces (the unknown id where the model has none), so with byte pieces decoding restores every text.

``load`` refuses models that need more than that: another normaliser than the identity, removal of extra white
space, spaces that are not escaped, user-defined pieces, or pieces with a U+2581 behind another character.  Without such
pieces the best segmentation of a text is the concatenation of those of its *pre-tokens*, cut before every run of U+2581.

``encode`` runs an Aho-Corasick automaton of the pieces over a pre-token once;
the matches that end at a position come along the output links and relax the
best score there.  ``count`` inserts pre-tokens in a trie, computes the forward score of
a trie node once, whichever pre-tokens share the prefix, and stores the number
of pieces at the terminal node.  Both keep results of earlier pre-tokens in tables of
bounded size, per task.

Defined results: null encodes as an empty text; the empty text gives no pieces; texts of any length are encoded whole;
repeated rows each give a row; an empty table gives no rows; columns of docs with a name of the results
are replaced by them, all others stay; lone surrogates can't occur in a Spark string.  Decoding null or unknown ids skips them.
"""

from __future__ import annotations

import functools
import hashlib
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Where the vocabulary files of this installation are; every entry point takes another path.
MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
META = "▁"
#: Stands for a U+2581 of the text: a lone surrogate, which no Spark string and no piece holds.
OWN_META = "\ud800"
#: Most pre-tokens kept by an encoder, most nodes kept by a counting trie, longest pre-token kept.
CACHE = 400_000
NODES = 600_000
LONGEST = 64
TIE = 2.0**-20

_PRE_TOKEN = re.compile(f"{META}+[^{META}]*|[^{META}]+")


@dataclass(frozen=True)
class Vocabulary:
    pieces: tuple[str, ...]
    #: Score of each piece that takes part in segmentation.
    scores: dict[str, tuple[float, int]]
    #: Piece id of each byte, or the unknown id 256 times.
    byte_ids: tuple[int, ...]
    fallback: float
    texts: tuple[bytes, ...]
    dummy_prefix: bool = True


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message, in order."""
    at = 0

    def varint() -> int:
        nonlocal at
        n = shift = 0
        while True:
            byte = raw[at]
            at += 1
            n |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return n

    while at < len(raw):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
            continue
        size = varint() if kind == 2 else 8 if kind == 1 else 4
        yield number, raw[at : at + size]
        at += size


def dummy_prefix(model: bytes) -> bool:
    """Whether the model puts a space before texts; raises ValueError for settings that ``encode`` would not honour."""
    settings: dict = {}
    for number, value in _fields(model):
        if number == 3:  # normaliser: 2 its table, 3 dummy prefix, 4 remove extra white space, 5 escape white space
            settings = dict(_fields(value))
        elif number == 1 and dict(_fields(value)).get(3) == 4:
            raise ValueError("user-defined pieces are not supported")
    if settings.get(2):
        raise ValueError(f"the normaliser {settings.get(1, b'').decode() or 'of the model'} is not supported: only the identity is")
    if settings.get(4, 1) or not settings.get(5, 1):
        raise ValueError("removal of extra white space and spaces that are not escaped are not supported")
    return bool(settings.get(3, 1))


@functools.lru_cache(maxsize=2)
def load(model_file: str = MODEL_FILE) -> Vocabulary:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    pieces = tuple(sp.id_to_piece(range(sp.get_piece_size())))
    scores, byte_ids, texts = {}, {}, []
    for i, piece in enumerate(pieces):
        if sp.is_byte(i):
            byte_ids[int(piece[1:-1], 16)] = i
            texts.append(bytes([int(piece[1:-1], 16)]))
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            texts.append(b"")
        else:
            texts.append(piece.replace(META, " ").encode())
            if META in piece.lstrip(META):
                raise ValueError(f"piece {piece!r} would cross the edge of a pre-token")
            scores[piece] = (sp.get_score(i) - TIE, i)
    lowest = min((s for s, _ in scores.values()), default=0.0)
    return Vocabulary(pieces, scores, tuple(byte_ids.get(b, sp.unk_id()) for b in range(256)), lowest - 10 - TIE / 2, tuple(texts), dummy_prefix(sp.serialized_model_proto()))


def pre_tokens(text: str | None, prefix: bool = True) -> list[str]:
    return _PRE_TOKEN.findall(META * prefix + text.replace(META, OWN_META).replace(" ", META)) if text else []


def _bytes(char: str) -> bytes:
    return (META if char == OWN_META else char).encode()


class Encoder(dict):
    """Pre-token to piece ids, filled on demand and emptied when full."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.fallback, self.byte_ids = vocabulary.fallback, vocabulary.byte_ids
        self.automaton = ahocorasick.Automaton()
        for piece, (score, i) in vocabulary.scores.items():
            self.automaton.add_word(piece, (len(piece), score, i))
        self.automaton.make_automaton()

    def __missing__(self, token: str) -> tuple[int, ...]:
        ids = self.viterbi(token)
        if len(token) <= LONGEST:
            if len(self) >= CACHE:
                self.clear()
            self[token] = ids
        return ids

    def viterbi(self, token: str) -> tuple[int, ...]:
        n = len(token)
        best, last = [0.0] * (n + 1), [_FALLBACK] * (n + 1)  # score sum up to a position, its last piece
        at, fallback = 0, self.fallback
        for end, match in self.automaton.iter(token):
            end += 1
            while at < end:  # positions are final once the automaton is past them
                best[at + 1] = best[at] + fallback
                at += 1
            total = best[end - match[0]] + match[1]
            if total > best[end]:  # of equal ones the longest stays: the automaton gives it first
                best[end], last[end] = total, match
        out: list[int] = []
        while n:
            length, _, i = last[n]
            if i < 0:
                out += [self.byte_ids[b] for b in reversed(_bytes(token[n - 1]))]
            else:
                out.append(i)
            n -= length
        return tuple(reversed(out))


_FALLBACK = (1, 0.0, -1)


class CountingTrie(dict):
    """Pre-token to its number of ids; forward scores of prefixes are shared by all pre-tokens that begin alike."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.fallback = vocabulary.fallback
        #: Trie of reversed pieces: walking back from a node stops where no piece goes on.
        self.back: dict = {}
        for piece, (score, _) in vocabulary.scores.items():
            node = self.back
            for c in reversed(piece):
                node = node.setdefault(c, {})
            node[""] = score
        self.clear()

    def clear(self):
        self.child: dict[int, int] = {}
        self.parent, self.char = [0], [""]
        self.best, self.ids = array("d", [0.0]), array("i", [0])

    def forward(self, parent: int, char: str) -> tuple[float, int]:
        """Best score sum and its number of ids at the child of a node by a character."""
        best, parents, chars = self.best, self.parent, self.char
        top, origin, node = best[parent] + self.fallback, -1, parent
        branch = self.back.get(char)
        while branch is not None:
            score = branch.get("")
            if score is not None and (total := best[node] + score) >= top:  # >=: the longest of equal ones
                top, origin = total, node
            if not node:
                break
            branch = branch.get(chars[node])
            node = parents[node]
        return top, self.ids[parent] + len(_bytes(char)) if origin < 0 else self.ids[origin] + 1

    def __missing__(self, token: str) -> int:
        if len(self.parent) + len(token) > NODES:
            self.clear()  # a pre-token longer than that has the trie to itself
        node, child = 0, self.child
        for c in token:
            key = node << 21 | ord(c)
            below = child.get(key)
            if below is None:
                score, ids = self.forward(node, c)
                below = child[key] = len(self.parent)
                self.parent.append(node)
                self.char.append(c)
                self.best.append(score)
                self.ids.append(ids)
            node = below
        found = self.ids[node]
        if len(token) <= LONGEST:
            if len(self) >= CACHE:
                dict.clear(self)
            self[token] = found
        return found


def decode_ids(vocabulary: Vocabulary, ids) -> str:
    texts = vocabulary.texts
    raw = b"".join(texts[i] for i in ids if i is not None and 0 <= i < len(texts))
    return raw[vocabulary.dummy_prefix and raw.startswith(b" ") :].decode("utf-8", "replace")


def _kept(docs: DataFrame, keep: list[str] | None, *made: tuple[str, T.DataType]) -> tuple[DataFrame, list[str], T.StructType]:
    """docs, the columns of it that stay (all, or those in keep), and the schema of those and the columns made."""
    names = {name for name, _ in made}
    stay = [c for c in (docs.columns if keep is None else keep) if c not in names]
    fields = [docs.schema[c] for c in stay] + [T.StructField(*x) for x in made]
    return docs.select(*dict.fromkeys([*stay, "text"])), stay, T.StructType(fields)


def encode(docs: DataFrame, model_file: str = MODEL_FILE, keep_ids: bool = True, keep: list[str] | None = None) -> DataFrame:
    """docs (all columns, or those in keep) with n_tokens, token_ids (unless keep_ids is false), ids_sha256 (little-endian int32), round_trip: decoding gives the text back."""
    ids = [("token_ids", T.ArrayType(T.IntegerType()))] if keep_ids else []
    rows, stay, schema = _kept(common.small_batches(docs), keep, ("n_tokens", T.LongType()), *ids, ("ids_sha256", T.StringType()), ("round_trip", T.BooleanType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load(model_file)
        encoder = Encoder(vocabulary)
        for batch in common.rows_of(batches):
            start, size = 0, 0
            lengths = [len(t or "") for t in batch.column("text").to_pylist()]
            for row in range(len(lengths)):
                size += lengths[row]
                if size >= common.SLICE_BYTES or row == len(lengths) - 1:
                    yield encoded(vocabulary, encoder, batch.slice(start, row + 1 - start))
                    start, size = row + 1, 0

    def encoded(vocabulary, encoder, batch) -> pa.RecordBatch:
        rows, digests, same = [], [], []
        for text in batch.column("text").to_pylist():
            ids = np.fromiter(chain.from_iterable(map(encoder.__getitem__, pre_tokens(text, vocabulary.dummy_prefix))), np.int32)
            rows.append(ids)
            digests.append(hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest())
            same.append(decode_ids(vocabulary, ids.tolist()) == (text or ""))
        offsets = np.cumsum([0, *map(len, rows)]).astype(np.int32)
        out = {c: batch.column(c) for c in stay} | {"n_tokens": np.diff(offsets).astype(np.int64)}
        if keep_ids:
            out["token_ids"] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows)))
        return pa.RecordBatch.from_pydict(out | {"ids_sha256": digests, "round_trip": same})

    return rows.mapInArrow(run, schema)


def decode(ids: Column, model_file: str = MODEL_FILE) -> Column:
    """The text of an array of piece ids."""

    @F.arrow_udf("string")
    def decoded(column: pa.Array) -> pa.Array:
        vocabulary = load(model_file)
        return pa.array([decode_ids(vocabulary, x or ()) for x in column.to_pylist()], pa.string())

    return decoded(ids)


def count(docs: DataFrame, model_file: str = MODEL_FILE, keep: list[str] | None = None) -> DataFrame:
    """docs (all columns, or those in keep) with n_pretokens and n_tokens: the number of ids that ``encode`` gives."""
    rows, stay, schema = _kept(common.small_batches(docs), keep, ("n_pretokens", T.LongType()), ("n_tokens", T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load(model_file)
        trie = CountingTrie(vocabulary)
        for batch in common.rows_of(batches):
            pre, total = [], []
            for text in batch.column("text").to_pylist():
                tokens = pre_tokens(text, vocabulary.dummy_prefix)
                pre.append(len(tokens))
                total.append(sum(map(trie.__getitem__, tokens)))
            out = {c: batch.column(c) for c in stay} | {"n_pretokens": pa.array(pre, pa.int64()), "n_tokens": pa.array(total, pa.int64())}
            yield pa.RecordBatch.from_pydict(out)

    return rows.mapInArrow(run, schema)


def op4_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encode(common.read(spark, sf_dir, "documents"), keep=["doc_id"])


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    return count(common.read(spark, sf_dir, "documents"), keep=["doc_id"])
