"""A line-oriented text serialization of nested values: one record a line, or laid out over several.

Values: null `~`, booleans, numbers, quoted strings, dates and times, lists
`[..]`, tuples `(..)`, sets `set(..)`, dicts `{k: v}`, records `name(k=v)` and
arrays `array([..])`.  Nothing is imported or evaluated while reading: a record's
name stays a name unless it is on a list of known ones.
"""

from __future__ import annotations

import datetime as dt
import json
import re
from collections.abc import Callable, Iterator
from decimal import Decimal
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import C, col


class NotationError(ValueError):
    """Text that isn't the notation, with the place."""


class Record(dict):
    """A record: its fields, and the name of its type."""

    def __init__(self, name: str, *a, **k):
        super().__init__(*a, **k)
        self.name = name

    def __eq__(self, other):
        return isinstance(other, Record) and other.name == self.name and dict.__eq__(self, other)

    __hash__ = None


def _plain(v: Any) -> str:
    if v is None:
        return "~"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, np.integer)):
        return str(int(v))
    if isinstance(v, (float, np.floating)):
        f = float(v)
        return "nan" if f != f else ("inf" if f > 0 else "-inf") if f in (float("inf"), float("-inf")) else repr(f)
    if isinstance(v, Decimal):
        return f"decimal({json.dumps(str(v))})"
    if isinstance(v, dt.datetime):
        return v.isoformat(sep=" ")
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, dt.time):
        return v.isoformat()
    if isinstance(v, (bytes, bytearray)):
        import base64

        return f"bytes({json.dumps(base64.b64encode(bytes(v)).decode())})"
    if isinstance(v, str):
        return json.dumps(v, ensure_ascii=False)
    raise TypeError(f"{type(v).__name__} can't be written")


def encode(v: Any, layout: int = 0, depth: int = 0) -> str:
    """layout 0: one line; 1: the fields of the outermost value on lines; 2: all levels on lines."""
    spread = layout == 2 or (layout == 1 and depth == 0)

    def items(open_: str, close: str, parts: list[str]) -> str:
        if not parts or not spread:
            return open_ + ", ".join(parts) + close
        pad = "\n" + "    " * (depth + 1)
        return open_ + pad + ("," + pad).join(parts) + "\n" + "    " * depth + close

    sub = lambda x: encode(x, layout, depth + 1)
    if isinstance(v, Record):
        return items(v.name + "(", ")", [f"{k}={sub(x)}" for k, x in v.items()])
    if isinstance(v, dict):
        return items("{", "}", [f"{sub(k)}: {sub(x)}" for k, x in v.items()])
    if isinstance(v, (set, frozenset)):
        return items("set(", ")", sorted(sub(x) for x in v))
    if isinstance(v, tuple):
        return items("(", ")", [sub(v[0]) + ","] if len(v) == 1 else [sub(x) for x in v])
    if isinstance(v, list):
        return items("[", "]", [sub(x) for x in v])
    if isinstance(v, np.ndarray):
        return f"array({encode(v.tolist(), 0)})"
    return _plain(v)


_TOKEN = re.compile(
    r"""\s*(?:(?P<stamp>\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:[+-]\d{2}:\d{2})?)|(?P<date>\d{4}-\d{2}-\d{2})|(?P<time>\d{2}:\d{2}:\d{2}(?:\.\d+)?)
    |(?P<float>[+-]?(?:\d+\.\d*|\.\d+|\d+(?=[eE]))(?:[eE][+-]?\d+)?)|(?P<inf>-inf\b)|(?P<int>[+-]?\d+)|(?P<str>"(?:[^"\\]|\\.)*")|(?P<word>[A-Za-z_][\w.]*)|(?P<mark>[~\[\](){},:=]))""",
    re.X,
)


class _Reader:
    def __init__(self, text: str, known: dict[str, Callable] | None = None):
        self.text, self.at, self.known = text, 0, known or {}
        self.kind = self.value = None
        self.next()

    def next(self) -> None:
        if not self.text[self.at :].strip():
            self.kind = self.value = None
            self.at = len(self.text)
            return
        m = _TOKEN.match(self.text, self.at)
        if not m:
            raise NotationError(f"unexpected text at {self.at}: {self.text[self.at : self.at + 20]!r}")
        self.at, self.kind, self.value = m.end(), m.lastgroup, m[m.lastgroup]

    def take(self, mark: str) -> None:
        if self.kind != "mark" or self.value != mark:
            raise NotationError(f"{mark!r} is missing before {self.at}")
        self.next()

    def is_(self, mark: str) -> bool:
        return self.kind == "mark" and self.value == mark

    def list_(self, close: str, one: Callable) -> tuple[list, bool]:
        out, comma = [], False
        while not self.is_(close):
            out.append(one())
            comma = self.is_(",")
            if comma:
                self.next()
            elif not self.is_(close):
                raise NotationError(f"',' or {close!r} is missing before {self.at}")
        self.next()
        return out, comma

    def pair(self) -> tuple:
        k = self.read()
        self.take(":")
        k = tuple(k) if isinstance(k, list) else k
        return k, self.read()

    def argument(self) -> tuple:
        if self.kind == "word":
            back, kind, value = self.at, self.kind, self.value
            self.next()
            if self.is_("="):
                self.next()
                return value, self.read()
            self.at, self.kind, self.value = back, kind, value
        return None, self.read()

    def read(self) -> Any:
        kind, v = self.kind, self.value
        if kind is None:
            raise NotationError("the text ends too early")
        self.next()
        if kind == "stamp":
            return dt.datetime.fromisoformat(v)
        if kind == "date":
            return dt.date.fromisoformat(v)
        if kind == "time":
            return dt.time.fromisoformat(v)
        if kind in ("float", "inf"):
            return float(v)
        if kind == "int":
            return int(v)
        if kind == "str":
            return json.loads(v, strict=False)
        if kind == "mark":
            if v == "~":
                return None
            if v == "[":
                return self.list_("]", self.read)[0]
            if v == "(":
                items, comma = self.list_(")", self.read)
                return tuple(items) if comma or len(items) != 1 else items[0]
            if v == "{":
                return dict(self.list_("}", self.pair)[0])
            raise NotationError(f"unexpected {v!r} before {self.at}")
        if v in ("true", "false", "nan", "inf") and not self.is_("("):
            return {"true": True, "false": False, "nan": float("nan"), "inf": float("inf")}[v]
        if not self.is_("("):
            raise NotationError(f"unknown word {v!r} before {self.at}")
        self.next()
        args = self.list_(")", self.argument)[0]
        plain = [x for k, x in args if k is None]
        if v == "set":
            return {tuple(x) if isinstance(x, list) else x for x in plain}
        if v == "array":
            return np.array(plain[0])
        if v == "decimal":
            return Decimal(plain[0])
        if v == "bytes":
            import base64

            return base64.b64decode(plain[0])
        fields = {k: x for k, x in args if k is not None}
        return self.known[v](**fields) if v in self.known else Record(v, fields)


def decode(text: str, known: dict[str, Callable] | None = None) -> Any:
    """The value of one text."""
    r = _Reader(text, known)
    v = r.read()
    if r.kind is not None:
        raise NotationError(f"text is left at {r.at}")
    return v


def load(text: str, known: dict[str, Callable] | None = None) -> Iterator[Any]:
    """All values of a text, one after the other."""
    r = _Reader(text, known)
    while r.kind is not None:
        yield r.read()


def to_json(v: Any) -> str:
    """As JSON: sets and arrays are lists, records objects with `_type`, keys texts."""

    def plain(x):
        if isinstance(x, Record):
            return {"_type": x.name, **{k: plain(y) for k, y in x.items()}}
        if isinstance(x, dict):
            return {k if isinstance(k, str) else _plain(k) if not isinstance(k, tuple) else encode(k): plain(y) for k, y in x.items()}
        if isinstance(x, (set, frozenset)):
            return sorted((plain(y) for y in x), key=str)
        if isinstance(x, (list, tuple)):
            return [plain(y) for y in x]
        if isinstance(x, np.ndarray):
            return x.tolist()
        if isinstance(x, float) and (x != x or x in (float("inf"), float("-inf"))):
            return str(x)
        return x if x is None or isinstance(x, (bool, int, float, str)) else str(x)

    return json.dumps(plain(v), ensure_ascii=False)


def notation_encode(x: C, layout: int = 0) -> Column:
    """The notation of JSON text."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: encode(json.loads(v), layout), na_action="ignore")

    return run(col(x))


def notation_decode(x: C) -> Column:
    """VARIANT of the notation; null for what can't be read."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def one(v):
            try:
                return to_json(decode(v))
            except NotationError:
                return None

        return s.map(one, na_action="ignore")

    return F.try_parse_json(run(col(x)))
