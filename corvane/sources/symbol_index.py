"""Symbol indexes in their binary format (protocol buffers): documents, symbols, occurrences and relationships as rows; names out of symbol strings."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

MAX_INDEX_BYTES = 256 << 20
MAX_COORDINATE = (1 << 31) - 1


class IndexFault(ValueError):
    """Bytes that are no symbol index."""


def _varint(data: memoryview, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise IndexFault("a number doesn't end")
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value & (1 << 64) - 1, at


def fields(data: memoryview):
    """(number, value) of a message's fields: whole numbers, or the bytes of a part; fixed-size numbers are skipped over."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        number, kind = key >> 3, key & 7
        if not number:
            raise IndexFault("field 0")
        if kind == 0:
            value, at = _varint(data, at)
            yield number, value
        elif kind == 2:
            size, at = _varint(data, at)
            if at + size > len(data):
                raise IndexFault("a part doesn't end")
            yield number, data[at : at + size]
            at += size
        elif kind in (1, 5):
            at += 8 if kind == 1 else 4
            if at > len(data):
                raise IndexFault("a number doesn't end")
        else:
            raise IndexFault("an unknown kind of field")


def _text(value: object) -> str:
    if isinstance(value, int):
        raise IndexFault("a number in place of a text")
    try:
        return bytes(value).decode("utf-8")
    except UnicodeDecodeError:
        raise IndexFault("a text that is no UTF-8") from None


def _numbers(value: object) -> list[int]:
    if isinstance(value, int):
        return [value]
    out, at = [], 0
    while at < len(value):
        number, at = _varint(value, at)
        out.append(number)
    return out


def _occurrence(data: memoryview) -> tuple[str, bool, int, int]:
    symbol, roles, spans, typed = "", 0, [], None
    for number, value in fields(data):
        if number == 1:
            spans += _numbers(value)
        elif number == 2:
            symbol = _text(value)
        elif number == 3:
            roles = value if isinstance(value, int) else 0
        elif number == 8 and not isinstance(value, int):  # a range on one line
            part = dict(fields(value))
            typed = (part.get(1, 0), part.get(1, 0))
        elif number == 9 and not isinstance(value, int):  # a range over lines
            part = dict(fields(value))
            typed = (part.get(1, 0), part.get(3, 0))
    if typed is None:
        if len(spans) not in (3, 4):
            raise IndexFault("a range of a wrong size")
        typed = (spans[0], spans[2] if len(spans) == 4 else spans[0])
    if not 0 <= typed[0] <= typed[1] <= MAX_COORDINATE:
        raise IndexFault("a range that runs backwards")
    return symbol, bool(roles & 1), typed[0] + 1, typed[1] + 1


def _information(data: memoryview) -> tuple[str, int, list[str]]:
    symbol, kind, targets = "", 0, []
    for number, value in fields(data):
        if number == 1:
            symbol = _text(value)
        elif number == 5 and isinstance(value, int):
            kind = value
        elif number == 4 and not isinstance(value, int):
            part = dict(fields(value))
            if part.get(3, 0):
                targets.append(_text(part.get(1, memoryview(b""))))
    return symbol, kind, targets


def read_index(content: bytes) -> list[tuple]:
    """Rows (record, path, symbol, text, definition, start_line, end_line, kind, target) of record document, occurrence, symbol or implements; lines count from 1."""
    if len(content) > MAX_INDEX_BYTES:
        raise IndexFault("too large")
    rows: list[tuple] = []

    def about(data: memoryview, path: str | None) -> None:
        symbol, kind, targets = _information(data)
        rows.append(("symbol", path, symbol, None, None, None, None, kind, None))
        rows.extend(("implements", path, symbol, None, None, None, None, None, t) for t in targets)

    for number, value in fields(memoryview(content)):
        if number == 2 and not isinstance(value, int):
            parts = list(fields(value))
            path = next((_text(v) for n, v in reversed(parts) if n == 1), "")
            text = next((_text(v) for n, v in reversed(parts) if n == 5), "")
            rows.append(("document", path, None, text, None, None, None, None, None))
            for n, v in parts:
                if n == 2 and not isinstance(v, int):
                    symbol, definition, start, end = _occurrence(v)
                    rows.append(("occurrence", path, symbol, None, definition, start, end, None, None))
                elif n == 3 and not isinstance(v, int):
                    about(v, path)
        elif number == 3 and not isinstance(value, int):
            about(value, None)
    return rows


ROWS = "record string, path string, symbol string, text string, definition boolean, start_line long, end_line long, kind long, target string"


def read_indexes(files: DataFrame, content: str = "content", name: str = "index") -> DataFrame:
    """The rows of every index of a table (index, content); a file that is no index gives one row of record `fault` with the reason as text."""
    import pandas as pd

    ship(files.sparkSession)

    def run(batches):
        for batch in batches:
            for key, data in zip(batch[name], batch[content], strict=True):
                try:
                    rows = read_index(bytes(data))
                except IndexFault as reason:
                    rows = [("fault", None, None, str(reason), None, None, None, None, None)]
                out = pd.DataFrame(rows, columns=[x.split(" ")[0] for x in ROWS.split(", ")])
                for column in ("start_line", "end_line", "kind"):
                    out[column] = out[column].astype("Int64")
                out.insert(0, name, key)
                yield out

    return files.select(name, content).mapInPandas(run, f"{name} string, {ROWS}")


_SIMPLE = re.compile(r"[\w+$-]+")


def symbol_name(symbol: str) -> tuple[str, str, bool] | None:
    """(name, qualified name, navigable) of a global symbol: four words, then descriptors; None for local and malformed ones and those without a name.

    A descriptor is a plain or quoted name and its mark; parameters in brackets count as no name. Two spaces in one of the words stand for one.
    """
    if symbol.startswith("local "):
        return None
    head = re.match(r"(?:(?:[^ ]|  )* ){4}", symbol)
    if not head:
        return None
    at, names, navigable = head.end(), [], False
    while at < len(symbol):
        closing = {"[": "]", "(": ")"}.get(symbol[at])
        if closing:
            end = symbol.find(closing, at + 1)
            if end < 0:
                return None
            at, navigable = end + 1, False
            continue
        if symbol[at] == "`":
            quoted = re.match(r"`((?:[^`]|``)*)`(?!`)", symbol[at:])
            if not quoted or any(not c.isprintable() for c in quoted[1]):
                return None
            name, at = quoted[1].replace("``", "`"), at + quoted.end()
        else:
            plain = _SIMPLE.match(symbol, at)
            if not plain:
                return None
            name, at = plain[0], plain.end()
        if at >= len(symbol):
            return None
        mark, at = symbol[at], at + 1
        if mark == "(":
            end = symbol.find(").", at)
            if end < 0:
                return None
            at = end + 2
        elif mark not in "/#.!:":
            return None
        navigable = mark != ":"
        if navigable:
            names.append(name)
    return (names[-1], "::".join(names), navigable) if names else None


def with_names(symbols: DataFrame, symbol: str = "symbol") -> DataFrame:
    """Adds name, qualified and navigable to distinct symbols; null for symbols without a name."""
    import pandas as pd

    ship(symbols.sparkSession)

    def named(column):
        return pd.DataFrame([symbol_name(s) or (None, None, None) for s in column], columns=["name", "qualified", "navigable"])

    read = F.pandas_udf(named, "name string, qualified string, navigable boolean")
    return symbols.withColumn("__n", read(F.col(symbol))).select("*", "__n.name", "__n.qualified", "__n.navigable").drop("__n")
