"""JSON as models write it: single quotes, bare keys, missing commas, literals of other languages, talk around it, and input that ends early."""

from __future__ import annotations

import json
import re

_SPACE = re.compile(r"(?:\s|//[^\n]*|/\*.*?\*/)*", re.S)
_KEY = re.compile(r"[^\s:={}\[\],\"']+")
_WORD = re.compile(r"[^,{}\[\]\n]+")
_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?")
_ESCAPE = re.compile(r"\\(u[0-9a-fA-F]{4}|.?)", re.S)
_LITERALS = {"true": "true", "True": "true", "false": "false", "False": "false", "null": "null", "None": "null", "undefined": "null", "NaN": "null"}
_SHORT = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
MOST_DEEP = 100


def _unescaped(raw: str) -> str:
    """The characters of a string; an escape that means nothing stands for its character, one that is cut off for nothing."""
    if "\\" not in raw:
        return raw
    text = _ESCAPE.sub(lambda m: chr(int(m[1][1:], 16)) if len(m[1]) == 5 else _SHORT.get(m[1], m[1]), raw)
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


class _Reader:
    """Recursive descent over a text; each method gives the JSON of what it read and moves on."""

    def __init__(self, text: str, at: int = 0):
        self.text, self.at = text, at

    def peek(self) -> str:
        self.at = _SPACE.match(self.text, self.at).end()
        return self.text[self.at : self.at + 1]

    def value(self, depth: int = 0) -> str | None:
        """None where no value stands."""
        c = self.peek()
        if c in ("{", "["):
            if depth == MOST_DEEP:
                raise ValueError("too deep")
            self.at += 1
            return self.members(depth + 1) if c == "{" else self.items(depth + 1)
        if c in ('"', "'"):
            return json.dumps(self.string(c), ensure_ascii=False)
        return None if c in ("", ",", "}", "]", ":") else self.word()

    def members(self, depth: int) -> str:
        found: list[str] = []
        while c := self.peek():
            if c in "}]":
                self.at += c == "}"
                break
            if c == ",":
                self.at += 1
                continue
            if c in "\"'":
                key = self.string(c)
            elif m := _KEY.match(self.text, self.at):
                key, self.at = m.group(), m.end()
            else:
                raise ValueError("no key")
            if self.peek() not in (":", "="):
                if self.at < len(self.text) or not found:
                    raise ValueError("a key without a value")
                break
            self.at += 1
            value = self.value(depth)
            if value is not None or self.at < len(self.text):
                found.append(f"{json.dumps(key, ensure_ascii=False)}: {value or 'null'}")
        return "{" + ", ".join(found) + "}"

    def items(self, depth: int) -> str:
        found: list[str] = []
        while c := self.peek():
            if c in "]}":
                self.at += c == "]"
                break
            if c in ",:":
                self.at += 1
                continue
            found.append(self.value(depth))
        return "[" + ", ".join(found) + "]"

    def string(self, quote: str) -> str:
        """A single quote within a word does not end a string."""
        text, start = self.text, self.at + 1
        at = start
        while (end := text.find(quote, at)) >= 0:
            slashes = end - len(text[start:end].rstrip("\\")) - start
            if slashes % 2 == 0 and not (quote == "'" and text[end + 1 : end + 2].isalnum()):
                self.at = end + 1
                return _unescaped(text[start:end])
            at = end + 1
        self.at = len(text)
        return _unescaped(text[start:])

    def word(self) -> str:
        m = _WORD.match(self.text, self.at)
        word = re.split(r"\s+(?=[\w\"']+\s*:)", m.group(), maxsplit=1)[0]  # the next key, where a comma is missing
        parts = word.split()
        if all(p in _LITERALS or _NUMBER.fullmatch(p) for p in parts):
            word = parts[0]  # of numbers in a row each is a value
        self.at += len(word)
        word = word.strip()
        if word in _LITERALS:
            return _LITERALS[word]
        number = word.rstrip(".eE+-") if self.at == len(self.text) else word  # cut within a number
        if _NUMBER.fullmatch(number):
            return number
        return json.dumps(word, ensure_ascii=False)


def mended(said: str | None) -> str | None:
    """The first object that a text holds, as JSON; the text itself if there is none.

    Keys without a value, at the end of a text that was cut, are left out; a null text gives null.
    """
    if said is None or "{" not in said:
        return said
    text = re.sub(r"\s*`+\s*\Z", "", said)
    at = text.find("{")
    while at >= 0:
        reader = _Reader(text, at)
        try:
            return reader.value()
        except ValueError:
            at = text.find("{", max(reader.at, at + 1))
    return said
