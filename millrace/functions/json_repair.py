"""Repair of JSON that a model wrote: a push-down automaton that always goes on, and closes what is open at the end."""

from __future__ import annotations

import json
import re

#: Characters that open a text, and the one that closes it.
QUOTES = {'"': '"', "'": "'", "“": "”", "‘": "’", "`": "`"}
#: Words that stand for JSON's constants, in lower case.
WORDS = {"true": "true", "false": "false", "null": "null", "none": "null", "undefined": "null", "nan": "null"}
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "/": "/", "\\": "\\", '"': '"', "'": "'", "`": "`"}
_SPACE = re.compile(r"(?:\s+|//[^\n]*|/\*(?:[^*]|\*(?!/))*(?:\*/|\Z)|#[^\n]*)+")
_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?\Z", re.ASCII)
_LOOSE = re.compile(r"([-+]?)0*(\d*)(?:\.(\d*))?([eE][-+]?\d+)?\Z", re.ASCII)
_KEY = re.compile(r"[^\s:,{}\[\]\"]+")
_VALUE = re.compile(r"[^,{}\[\]\n\"]+")


def repair_json(text: str) -> str | None:
    """The JSON value that a text was meant to be; null if nothing in it opens one.

    Valid JSON stays as it is.  Else the first ``{`` or ``[`` begins the value,
    and what follows its end is left out.  The automaton knows what is open (a
    stack of objects and lists) and what it waits for, and has a rule for every
    character:

    - texts in other quotes, with line ends, unknown escapes or quotes inside are
      texts: a quote ends one if a separator, a bracket or the end follows;
    - keys and values without quotes are texts, or numbers and constants in any
      spelling (``True``, ``None``, ``+.5``, ``007``);
    - commas and colons may be missing or too many, a key without a value has null;
    - comments are left out;
    - a bracket that closes an outer object or list closes the inner ones, one
      that closes nothing is left out;
    - at the end, what is open is closed, and a key that was cut off goes.
    """
    try:
        json.loads(text, parse_constant=_refuse)
        return text
    except (ValueError, RecursionError):
        pass
    start = re.search(r"[{\[]", text)
    return _Automaton(text, start.start()).run() if start else None


def _refuse(word: str):
    raise ValueError(word)


class _Automaton:
    def __init__(self, text: str, at: int):
        self.text, self.at = text, at
        self.out: list[str] = []
        #: What is open: ``{`` or ``[``, and how many members it has.
        self.open: list[list] = []
        #: A key that waits for its value, and whether its colon was there.
        self.key: str | None = None
        self.colon = False

    def run(self) -> str:
        n = len(self.text)
        while True:
            if m := _SPACE.match(self.text, self.at):
                self.at = m.end()
            if self.at >= n:
                break
            c = self.text[self.at]
            if c in "{[":
                self.opened(c)
            elif c in "}]":
                self.closed(c)
                if not self.open:
                    break
            elif c == ",":
                self.at += 1
                self.without_value()
            elif c == ":":
                self.at += 1
                self.colon = self.key is not None
            elif c in QUOTES:
                self.said(*self.quoted(c))
            else:
                self.bare()
        if self.key is not None and self.colon:
            self.without_value()
        self.key = None
        while self.open:
            self.out.append("}" if self.open.pop()[0] == "{" else "]")
        return "".join(self.out)

    def before(self) -> None:
        """The comma and the key in front of a value."""
        if self.open:
            if self.open[-1][1]:
                self.out.append(", ")
            self.open[-1][1] += 1
        if self.key is not None:
            self.out.append(f"{self.key}: ")
            self.key, self.colon = None, False

    def without_value(self) -> None:
        if self.key is not None:
            self.before()
            self.out.append("null")

    def waits_for_key(self) -> bool:
        return bool(self.open) and self.open[-1][0] == "{" and self.key is None

    def opened(self, c: str) -> None:
        self.at += 1
        if self.waits_for_key():
            if len(self.open) < 2 or self.open[-2][0] == "{":
                return
            self.out.append("}")  # another member of the list around this object
            self.open.pop()
        self.before()
        self.out.append(c)
        self.open.append([c, 0])

    def closed(self, c: str) -> None:
        self.at += 1
        opening = "{" if c == "}" else "["
        if all(kind != opening for kind, _ in self.open):
            return
        while True:
            if self.open[-1][0] == "{":
                self.without_value()
            kind = self.open.pop()[0]
            self.out.append("}" if kind == "{" else "]")
            if kind == opening:
                return

    def quoted(self, quote: str) -> tuple[str, bool]:
        """The text that begins here, and whether it ends."""
        close, text, parts, i = QUOTES[quote], self.text, [], self.at + 1
        while i < len(text):
            c = text[i]
            if c == "\\":
                code = re.compile(r"\\u([0-9a-fA-F]{4})").match(text, i)
                if code:
                    parts.append(chr(int(code[1], 16)))
                    i = code.end()
                elif i + 1 < len(text):
                    parts.append(ESCAPES.get(text[i + 1], "\\" + text[i + 1]))
                    i += 2
                else:
                    i += 1
            elif c == close and self.ends(i + 1, close):
                self.at = i + 1
                return "".join(parts), True
            else:
                parts.append(c)
                i += 1
        self.at = i
        return "".join(parts), False

    def ends(self, at: int, close: str) -> bool:
        """Whether a quote before ``at`` ends its text."""
        m = _SPACE.match(self.text, at)
        end = m.end() if m else at
        if end >= len(self.text):
            return True
        c = self.text[end]
        if self.waits_for_key():
            return c == ":" or c in ",}" or end > at
        return c in ",}]" or c == ":" and self.open[-1][0] == "[" or end > at and (c in QUOTES or c in "{[")

    def said(self, value: str, whole: bool) -> None:
        # Surrogates that escapes have put together are one character; one alone is none.
        value = value.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
        said = json.dumps(value, ensure_ascii=False)
        if self.waits_for_key():
            self.key, self.colon = (said, False) if whole else (None, False)
        else:
            self.before()
            self.out.append(said)

    def bare(self) -> None:
        """A key or value without quotes."""
        key = self.waits_for_key()
        m = (_KEY if key else _VALUE).match(self.text, self.at)
        word = re.split(r"\s(?=//|#|/\*)", m[0])[0] if m else self.text[self.at]
        if not key:
            # Words up to the next key, if a comma is missing.
            word = re.split(r"\s+(?=\S+\s*:(?!//))", word)[0] if self.open[-1][0] == "{" else word
            parts = word.split()
            if len(parts) > 1 and all(constant(p)[0] != '"' for p in parts):
                word = parts[0]
        self.at += len(word) or 1
        word = word.strip()
        if not word:
            return
        if key:
            self.said(word, True)
            return
        self.before()
        self.out.append(constant(word))


def constant(word: str) -> str:
    """A number or a constant in JSON's spelling; other words as a text."""
    if _NUMBER.match(word):
        return word
    if word.lower() in WORDS:
        return WORDS[word.lower()]
    m = _LOOSE.match(word)
    if m and (m[2] or m[3] or re.fullmatch(r"[-+]?0+\.?", word)):
        return f"{'-' if m[1] == '-' else ''}{m[2] or '0'}{'.' + m[3] if m[3] else ''}{m[4] or ''}"
    return json.dumps(word, ensure_ascii=False)
