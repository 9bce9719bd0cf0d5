"""Front matter as JSON: a bounded subset of YAML with nested mappings and lists, read once a document."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

MAX_DEPTH, MAX_BYTES = 16, 64 * 1024


class HeaderError(ValueError):
    """A header outside the subset."""


def _scalar(text: str) -> object:
    text = text.strip()
    if text[:1] in ("'", '"'):
        if len(text) < 2 or text[-1] != text[0]:
            raise HeaderError("an open quote")
        return text[1:-1]
    if text.startswith("["):
        if not text.endswith("]"):
            raise HeaderError("an open list")
        inner = text[1:-1].strip()
        return [_scalar(x) for x in re.split(r",\s*(?=(?:[^\"']|\"[^\"]*\"|'[^']*')*$)", inner)] if inner else []
    if text in ("", "~", "null"):
        return None
    if text in ("true", "false"):
        return text == "true"
    if re.fullmatch(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?", text):
        return int(text) if "." not in text else float(text)
    if text[0] in "{&*!|>%@`":
        raise HeaderError("outside the subset")
    return text


def parse_header(header: str) -> dict:
    """A mapping; doubled keys, tabs, and uneven indents are refused."""
    if len(header.encode()) > MAX_BYTES or "\t" in header:
        raise HeaderError("too large, or a tab")
    rows = [(len(x) - len(x.lstrip(" ")), x.strip()) for x in header.splitlines() if x.strip() and not x.lstrip().startswith("#")]
    at = 0

    def block(indent: int, depth: int) -> object:
        nonlocal at
        if depth > MAX_DEPTH:
            raise HeaderError("too deep")
        is_list = rows[at][1].startswith("- ") or rows[at][1] == "-"
        out: object = [] if is_list else {}
        while at < len(rows) and rows[at][0] == indent and (rows[at][1].startswith("- ") or rows[at][1] == "-") == is_list:
            text = rows[at][1]
            if is_list:
                rest = text[1:].strip()
                if rest and re.match(r"[A-Za-z0-9_][\w./-]*:(?:\s|$)", rest):
                    rows[at] = (indent + len(text) - len(rest), rest)
                    out.append(block(rows[at][0], depth + 1))
                    continue
                at += 1
                out.append(_scalar(rest) if rest else block(rows[at][0], depth + 1) if at < len(rows) and rows[at][0] > indent else None)
                continue
            match = re.match(r"([A-Za-z0-9_][\w./-]*):(?:\s+(.*))?$", text)
            if not match or match[1] in out:
                raise HeaderError("no key, or a doubled one")
            at += 1
            nested = at < len(rows) and (rows[at][0] > indent or rows[at][0] == indent and rows[at][1].startswith("- "))
            out[match[1]] = _scalar(match[2]) if match[2] else block(rows[at][0], depth + 1) if nested else None
        if at < len(rows) and rows[at][0] > indent:
            raise HeaderError("an uneven indent")
        return out

    if not rows:
        return {}
    value = block(rows[0][0], 0)
    if at < len(rows) or not isinstance(value, dict):
        raise HeaderError("no mapping")
    return value


def _json_of(header: str | None) -> str | None:
    try:
        return None if header is None else json.dumps(parse_header(header), ensure_ascii=False)
    except HeaderError:
        return None


def with_json(rows: DataFrame, header: str, out: str) -> DataFrame:
    """Adds the header as JSON, null if there is none or it can't be read; only this column goes through Python."""
    ship(rows.sparkSession)
    read = F.pandas_udf(lambda column: column.map(_json_of), "string")
    return rows.withColumn(out, read(F.col(header)))
