"""Many names looked for at once: an Aho-Corasick automaton, longest-first consuming, and the best path of names through a text.

A ``Dictionary`` travels to tasks as its plain names; the automaton is built from them once in each task that uses it, so time per
text depends on the text's length and on what is found in it, not on the number of names.  Names of a table of any size are not sent: ``with_names``
joins them to the texts by their rarest pieces, and each text gets a dictionary of what it holds.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import sinks

#: The code points of the Han script.
HAN = "⺀-⺙⺛-⻳⼀-⿕々〇〡-〩〸-〻㐀-䶿一-鿿豈-舘並-龎\U00020000-\U0002FA1F\U00030000-\U000323AF"
_HAN_CHAR = re.compile(f"[{HAN}]")
_RUN = re.compile(rf"[{HAN}]+|(?:(?![{HAN}])[^\W_])+")

#: Most names that are taken from a table into a dictionary: some 30 MB, sent once to each executor.
MOST_NAMES = 1_000_000


class Dictionary:
    """Names with values, in the order in which they are preferred among names of one length."""

    def __init__(self, names: dict[str, str] | Iterable[str]):
        self.names = dict(names) if isinstance(names, dict) else {n: n for n in names}
        self.names.pop("", None)
        self._nodes: tuple | None = None

    def __getstate__(self) -> dict:
        return {"names": self.names, "_nodes": None}

    def _automaton(self) -> tuple[list[dict[str, int]], list[int], list[str | None], list[int]]:
        """Of each node: its children, where to go on if none fits, the name that ends there, and the next shorter node with a name."""
        if self._nodes is None:
            children: list[dict[str, int]] = [{}]
            name: list[str | None] = [None]
            for word in self.names:
                at = 0
                for c in word:
                    if c not in children[at]:
                        children[at][c] = len(children)
                        children.append({})
                        name.append(None)
                    at = children[at][c]
                name[at] = word
            fail, shorter = [0] * len(children), [0] * len(children)
            queue = deque(children[0].values())
            while queue:
                at = queue.popleft()
                for c, child in children[at].items():
                    back = fail[at]
                    while back and c not in children[back]:
                        back = fail[back]
                    fail[child] = children[back].get(c, 0)
                    queue.append(child)
                shorter[at] = fail[at] if name[fail[at]] is not None else shorter[fail[at]]
            self._nodes = (children, fail, name, shorter)
        return self._nodes

    def matches(self, text: str) -> Iterator[tuple[int, str]]:
        """(end, name) of every occurrence, by end, longer names first."""
        children, fail, name, shorter = self._automaton()
        at = 0
        for end, c in enumerate(text, 1):
            while at and c not in children[at]:
                at = fail[at]
            at = children[at].get(c, 0)
            found = at if name[at] is not None else shorter[at]
            while found:
                yield end, name[found]
                found = shorter[found]

    def consumed(self, text: str) -> list[str]:
        """Values of the names found in a text, longest name first, each once; a found name is taken out, and what stood around it closes up."""
        return list(dict.fromkeys(self.names[name] for name, _ in self.taken(text)))

    def taken(self, text: str) -> Iterator[tuple[str, str]]:
        """The names that are taken out of a text, in order, each with what is then left of it."""
        if not hasattr(self, "_order"):
            self._order = {n: (-len(n), k) for k, n in enumerate(self.names)}
        order, last = self._order, (-float("inf"), -1)
        while True:
            # as if every name were tried in turn: the next one in order that what is left of the text holds
            ahead = min((order[n] for _, n in self.matches(text) if order[n] > last), default=None)
            if ahead is None:
                return
            name = self._names_in_order()[ahead[1]]
            text, last = text.replace(name, ""), ahead
            yield name, text

    def _names_in_order(self) -> list[str]:
        if not hasattr(self, "_listed"):
            self._listed = list(self.names)
        return self._listed

    def path(self, text: str) -> list[tuple[int, int]]:
        """The places of names on the best path through a text: fewest characters outside names, then fewest names, then the longest first.

        A name never begins or ends within a run of letters or digits of another script than Han.
        """
        n = len(text)
        inside = [False] * (n + 1)  # a cut there would split such a run
        for m in _RUN.finditer(text):
            if not _HAN_CHAR.match(m.group()):
                inside[m.start() + 1 : m.end()] = [True] * (m.end() - m.start() - 1)
        starts: dict[int, list[int]] = {}
        for end, name in self.matches(text):
            start = end - len(name)
            if not inside[start] and not inside[end]:
                starts.setdefault(start, []).append(end)
        if not starts:
            return []
        best: list[tuple[int, int, int]] = [(0, 0, 0)] * (n + 1)  # characters outside, names, where to go next
        for at in range(n - 1, -1, -1):
            out, words, _ = best[at + 1]
            choice = (out + 1, words, at + 1)
            for end in sorted(starts.get(at, ()), reverse=True):
                out, words, _ = best[end]
                if (out, words + 1) < choice[:2] or (out, words + 1) == choice[:2] and choice[2] == at + 1:
                    choice = (out, words + 1, end)
            best[at] = choice
        places, at = [], 0
        while at < n:
            then = best[at][2]
            if then in starts.get(at, ()) and (best[at][0], best[at][1]) == (best[then][0], best[then][1] + 1):
                places.append((at, then))
            at = then
        return places

    def segments(self, text: str) -> list[str]:
        """Lower-cased tokens: names of the best path whole, of the rest runs of letters and digits, Han runs cut into overlapping pairs."""
        text = text.lower()
        out, at = [], 0
        for start, end in self.path(text):
            out += _plain(text[at:start])
            out.append(text[start:end])
            at = end
        return out + _plain(text[at:])


def _plain(text: str) -> list[str]:
    out = []
    for m in _RUN.finditer(text):
        run = m.group()
        out += [run[i : i + 2] for i in range(len(run) - 1)] if len(run) > 2 and _HAN_CHAR.match(run) else [run]
    return out


def protected(names: Iterable[str]) -> Dictionary:
    """The names that segmentation keeps whole: those of two characters or more with a Han character, lower-cased.

    Texts without Han characters are cut at the edges of letters and digits only, so a name without any would stay whole in some texts and not in others.
    """
    return Dictionary(sorted({n.lower() for n in names if len(n) > 1 and _HAN_CHAR.search(n)}))


def names_of(rows: DataFrame, column: str = "name", most: int = MOST_NAMES) -> list[str]:
    """The distinct names of a table, for a dictionary; more than ``most`` are refused."""
    found = [r[0] for r in rows.select(column).where(F.col(column).isNotNull()).distinct().limit(most + 1).collect()]  # bounded
    if len(found) > most:
        raise ValueError(f"more than {most} names do not fit a dictionary that is sent to each executor")
    return sorted(found)


def _function(run, kind: str, arrow: pa.DataType):
    @F.arrow_udf(kind)
    def batch(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else run(x) for x in column.to_pylist()], arrow)

    return batch


def consumed_names(text: Column, names: Dictionary) -> Column:
    """array<string>: the values of the names in a text, longest first, consuming; a null text has none."""
    return F.coalesce(_function(names.consumed, "array<string>", pa.list_(pa.string()))(text), F.array().cast("array<string>"))


def segmented(text: Column, names: Dictionary) -> Column:
    return _function(names.segments, "array<string>", pa.list_(pa.string()))(text)


#: Characters of the longest pieces by which names of a table meet texts, and of the parts that long texts are cut into for it.
PIECE, PART = 16, 256


def _size() -> Column:
    """The piece size of a name: the largest power of two that it has room for, up to PIECE."""
    out = F.lit(1)
    for k in (2**n for n in range(1, PIECE.bit_length())):
        out = F.when(F.length("name") >= k, k).otherwise(out)
    return out


def _pieces(text: Column, size: Column) -> Column:
    places = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1))
    return F.explode(F.array_distinct(F.transform(places, lambda i: F.xxhash64(F.substring(text, i, size)))))


def with_names(rows: DataFrame, text: Column, names: DataFrame, column: str) -> DataFrame:
    """rows with ``column``, the names (of a table with a column ``name``, of any size) that a text holds: longest first, consuming, as by ``consumed_names``.

    A name stands for itself; those of one length come in order.  Each name meets the texts by that of its pieces which the fewest names have.  What closes
    up around a name that is taken out may hold further names, so the texts left behind are looked at again until nothing new is found.
    """
    own = sinks.kept(names.select("name").where("name <> ''").distinct().withColumn("size", _size()), "names")
    sizes = [r[0] for r in own.select("size").distinct().collect()]  # powers of two up to PIECE
    pieces = own.select("name", _pieces(F.col("name"), F.col("size")).alias("piece"))
    often = pieces.groupBy("piece").agg(F.count("*").alias("n"))
    rarest = sinks.kept(pieces.join(often, "piece").groupBy("name").agg(F.min(F.struct("n", "piece")).alias("r")).select("name", "r.piece"), "pieces")
    part = F.explode(F.transform(F.sequence(F.lit(0), (F.length("left") - 1), F.lit(PART)), lambda i: F.substring("left", i + 1, F.lit(PART + PIECE - 1))))

    def holding(texts: DataFrame) -> DataFrame:
        """(said, name) of texts (said, left) with a name within ``left``."""
        parts = texts.where("left <> ''").select(F.xxhash64("left").alias("key"), part.alias("part"))
        spread = parts.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)  # few small files may hold them all
        sized = spread.select("key", "part", F.explode(F.array(*[F.lit(k) for k in sizes])).alias("size"))
        grams = sized.select("key", _pieces(F.col("part"), F.col("size")).alias("piece"))
        met = grams.join(rarest, "piece").select("key", "name").distinct()
        return met.join(texts.withColumn("key", F.xxhash64("left")), "key").where(F.col("left").contains(F.col("name"))).select("said", "name").distinct()

    asked = sinks.kept(rows.select(text.alias("said")).where("said <> ''").distinct(), "said")
    held, texts = None, asked.withColumn("left", F.col("said"))
    while sizes:
        found = holding(texts)
        found = sinks.kept(found if held is None else found.join(held, ["said", "name"], "left_anti"), "held")
        if held is not None and found.isEmpty():
            break
        held = found if held is None else held.union(found)
        known = held.join(found.select("said").distinct(), "said", "left_semi").groupBy("said").agg(F.collect_list("name").alias("names"))
        texts = sinks.kept(known.select("said", F.explode(_left_behind("said", "names")).alias("left")), "left")
    if held is None:
        return rows.withColumn(column, F.array().cast("array<string>"))
    known = held.groupBy("said").agg(F.collect_list("name").alias("names")).select(F.col("said").alias("__said"), _taken("said", "names").alias(column))
    joined = rows.withColumn("__text", text).join(known, F.col("__text") == F.col("__said"), "left").drop("__text", "__said")
    return joined.withColumn(column, F.coalesce(column, F.array().cast("array<string>")))


def _each(run):
    @F.arrow_udf("array<string>")
    def batch(text: pa.Array, names: pa.Array) -> pa.Array:
        return pa.array([run(Dictionary(sorted(n.as_py())), t.as_py()) for t, n in zip(text, names, strict=True)], pa.list_(pa.string()))

    return batch


def _taken(text: str, names: str) -> Column:
    return _each(lambda d, t: d.consumed(t))(text, names)


def _left_behind(text: str, names: str) -> Column:
    return _each(lambda d, t: [left for _, left in d.taken(t)])(text, names)
