"""Headers of files by their syntax, their flat fields, and facts that lines of code show."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship

# How files of an extension write their header.
SYNTAXES = {
    "markdown": ["md", "markdown"], "slash": ["rs", "java", "js", "jsx", "ts", "tsx", "go", "cs"], "c": ["c", "cc", "cpp", "cxx", "h", "hh", "hpp"], "hash": ["py", "rb", "sh", "bash", "zsh", "yaml", "yml", "toml", "ini", "cfg"],
}
def syntax(path: Column) -> Column:
    """markdown, slash, c or hash by extension, null for other files."""
    table = F.create_map(*[F.lit(x) for kind, names in SYNTAXES.items() for e in names for x in (e, kind)])
    return F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.([^.]*)$", 1)))


def header(path: Column, text: Column) -> Column:
    """struct(raw, rows, error): the rows between the fences without their comment signs, how many rows of the file the header takes, and why it can't be taken; all null without a header."""
    kind = syntax(path)
    lines = F.split(text, "\r?\n")
    fence = lambda x: F.coalesce(F.trim(F.regexp_replace(x, "\t", " ")) == "---", F.lit(False))
    place = lambda rows: F.array_position(F.transform(rows, fence), True).cast("int")
    none = F.lit(None)
    made = lambda raw, rows, error: F.struct(raw.cast("string").alias("raw"), rows.cast("int").alias("rows"), error.cast("string").alias("error"))
    failed, absent = made(none, none, F.lit("open-header")), made(none, none, none)
    part = lambda rows, begin, n: F.array_join(F.slice(rows, begin, F.greatest(n, F.lit(0))), "\n")
    # markdown: the first row is a fence, and so is a later one
    rest = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
    markdown = F.when(text.rlike(r"\A\x{FEFF}?[ \t]*---[ \t]*\r?(?:\n|\z)"), F.when(place(rest) > 0, made(part(rest, 1, place(rest) - 1), place(rest) + 1, none)).otherwise(failed)).otherwise(absent)

    def commented(mark: str) -> Column:
        """Rows of comments at the top of the file, the first two fences among them."""
        inner = F.transform(lines, lambda x: F.when(x.rlike(rf"^[ \t]*{mark}"), F.regexp_replace(x, rf"^[ \t]*{mark}[/!]? ?", "")))
        stop = F.array_position(F.transform(inner, lambda x: x.isNull()), True).cast("int")
        run = F.slice(inner, 1, F.when(stop > 0, stop - 1).otherwise(F.size(inner)))
        first = place(run)
        after = F.slice(run, first + 1, F.greatest(F.size(run) - first, F.lit(0)))
        found = F.when(first == 0, absent).when(place(after) == 0, failed).otherwise(made(part(after, 1, place(after) - 1), first + place(after), none))
        return F.when(text.rlike(rf"(?m)^[ \t]*{mark}[/!]?[ \t]*---[ \t]*\r?$"), found).otherwise(absent)

    # a block: every row has a star up to the fence, after which the comment ends
    starred = F.transform(rest, lambda x: F.when(x.rlike(r"^[ \t]*\*(?!/)"), F.regexp_replace(x, r"^[ \t]*\* ?", "")))
    end = place(starred)
    whole = F.forall(F.slice(starred, 1, F.greatest(end - 1, F.lit(0))), lambda x: x.isNotNull()) & (F.trim(F.get(rest, end)) == "*/")
    block = F.when(text.rlike(r"\A[ \t]*/\*[ \t]*---[ \t]*\r?\n"), F.when((end > 0) & F.coalesce(whole, F.lit(False)), made(part(starred, 1, end - 1), end + 2, none)).otherwise(failed)).otherwise(absent)
    return F.when(kind == "markdown", markdown).when((kind == "c") & text.rlike(r"\A\s*/\*"), block).when(kind.isin("slash", "c"), commented("//")).when(kind == "hash", commented("#")).otherwise(absent)


class FieldError(ValueError):
    """A header outside the flat subset."""


def _scalar(text: str) -> str:
    text = text.strip()
    for quote in "\"'":
        if len(text) > 1 and text[0] == text[-1] == quote:
            text = text[1:-1]
            break
    if not text.strip():
        raise FieldError("empty scalar")
    return text.strip()


def flat_fields(body: str) -> list[tuple[str, str]]:
    """(key, value) of `key: value` rows, of lists in brackets and of indented rows with a dash; raises FieldError for all else."""
    out: list[tuple[str, str]] = []
    listed: list | None = None  # key, indent, whether it has an item
    for raw in body.splitlines():
        row = raw.strip()
        if not row or row.startswith("#"):
            continue
        if row.startswith("- "):
            if listed is None or len(raw) - len(raw.lstrip()) <= listed[1]:
                raise FieldError("an item without a key")
            out.append((listed[0], _scalar(row[2:])))
            listed[2] = True
            continue
        if listed is not None and not listed[2]:
            raise FieldError("an empty value")
        listed = None
        key, sign, value = row.partition(":")
        key, value = key.strip(), value.strip()
        if not sign or not re.fullmatch("[A-Za-z0-9_.-]+", key) or value[:1] in ("{", "|", ">") and value:
            raise FieldError("no field")
        if not value:
            listed = [key, len(raw) - len(raw.lstrip()), False]
        elif value.startswith("[") != value.endswith("]"):
            raise FieldError("an open list")
        else:
            out += [(key, _scalar(v)) for v in (value[1:-1].split(",") if value.startswith("[") else [value])]
    if listed is not None and not listed[2]:
        raise FieldError("an empty value")
    return out


def declared(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((path, key, value), (path, error)): fields of the files' headers; a header that can't be read gives none. Only headers pass through Python."""
    import pandas as pd

    ship(files.sparkSession)
    text = F.coalesce("text", F.lit(""))
    rows = files.select("path", header(F.col("path"), text).alias("h")).where("h.raw is not null or h.error is not null")

    def read(raw):
        out = []
        for body in raw:
            try:
                out.append((None if body is None else [{"key": k, "value": v} for k, v in flat_fields(body)], None))
            except FieldError as reason:
                out.append((None, str(reason)))
        return pd.DataFrame(out, columns=["fields", "error"])

    parsed = rows.withColumn("p", F.pandas_udf(read, "fields array<struct<key:string,value:string>>, error string")(F.col("h.raw")))
    fields = parsed.select("path", F.explode("p.fields").alias("f")).select("path", "f.key", "f.value")
    return fields, parsed.select("path", F.coalesce("h.error", "p.error").alias("error")).where("error is not null")


def inferred(files: DataFrame) -> DataFrame:
    """(path, key, value, confidence) that lines show: filename, symbol, import, test and dependency, each once a file."""
    text = F.coalesce("text", F.lit(""))
    rows = files.select("path", text.alias("text"))
    symbol = r"(?:pub )?(?:(?:fn|struct|enum|trait|class|def|function) )([A-Za-z0-9_]+)"
    shapes = [
        ("symbol", "medium", rf"(?m)^[ \t]*{symbol}"), ("import", "low", r"(?m)^[ \t]*(?:use|import|from) +([^\s;]+)"), ("import", "low", r"(?m)^[ \t]*require\(['\"]*([^'\"\s]+)"),
        ("test", "high", r"(?m)^[ \t]*def test_([A-Za-z0-9_]+)"), ("test", "high", rf"(?m)^[ \t]*#\[test\][ \t]*\r?\n[ \t]*{symbol}"),
    ]
    found = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(c).alias("confidence"), F.regexp_extract_all("text", F.lit(p), F.lit(1)).alias("values")) for k, c, p in shapes])
    # names of a manifest's dependency sections
    sections = F.filter(F.split("text", r"(?m)^[ \t]*(?=\[[^\n]*\][ \t]*\r?$)"), lambda s: s.rlike(r"\A\[(?:dev-|build-)?dependencies\]"))
    names = F.flatten(F.transform(sections, lambda s: F.regexp_extract_all(s, F.lit(r"(?m)^[ \t]*([A-Za-z0-9_.-]+)[ \t]*="), F.lit(1))))
    manifest = F.when(F.endswith("path", F.lit("Cargo.toml")), F.struct(F.lit("dependency").alias("key"), F.lit("medium").alias("confidence"), names.alias("values")))
    name = F.struct(F.lit("filename").alias("key"), F.lit("high").alias("confidence"), F.array(F.regexp_extract("path", r"([^/\\]*)$", 1)).alias("values"))
    many = rows.select("path", F.explode(F.array_compact(F.concat(found, F.array(manifest), F.array(name)))).alias("s")).select("path", "s.key", "s.confidence", F.explode("s.values").alias("value"))
    return many.where("value <> ''").select("path", "key", "value", "confidence").distinct()
