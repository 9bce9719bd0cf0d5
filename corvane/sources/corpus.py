"""Corpus tables: files from document tables or file trees, path classes, roles, traits, descriptions."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx

# Extensions by role.
SCRIPTS = ["sh", "py", "js", "jsx", "mjs", "cjs", "ts", "tsx", "mts", "cts", "rs", "go", "rb", "cpp", "java"]
DOCUMENTS = ["md", "rst", "adoc", "sdoc", "html"]
SETTINGS = ["json", "yaml", "yml", "toml", "ini", "conf", "txt", "timer", "service", "xml", "csv", "list", "cfg"]
OFFICE = ["docx", "xlsx", "pptx", "pdf"]


def files_from_documents(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(path, text, doc_id, source, lang, active, canonical, public_safe, confidence, freshness): documents as Markdown files, traits from labels."""
    path = F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/doc-"), F.col("doc_id").cast("string"), F.lit(".md"))
    base = docs.select(path.alias("path"), "text", "doc_id", "source", "lang")
    if labels is not None:
        base = base.join(labels.select("doc_id", "quality", "toxic"), "doc_id", "left")
    else:
        base = base.withColumns({"quality": F.lit(None).cast("int"), "toxic": F.lit(None).cast("int")})
    traits = {
        "active": F.when(F.col("quality") == 1, 3).otherwise(0), "canonical": F.when((F.col("quality") == 1) & (F.col("doc_id") % 5 == 0), 1).otherwise(0),
        "public_safe": F.when(F.col("toxic") == 0, 1).otherwise(0), "confidence": F.lit(50), "freshness": F.lit(""),
    }
    return base.withColumns(traits).drop("quality", "toxic")


def glob_regex(glob: str) -> str:
    """An anchored pattern for a path glob: ** spans segments, * stays within one."""
    parts = []
    for segment in glob.split("/"):
        parts.append("**" if segment == "**" else "".join("[^/]*" if c == "*" else re.escape(c) for c in re.split(r"(\*)", segment) if c))
    pattern = ""
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        if part == "**":
            pattern += ".*" if last else "(?:[^/]+/)*"
        else:
            pattern += part + ("" if last else "/")
    return f"^{pattern}$"


def classify(path: Column, classes: list[tuple[str, int, list[str]]]) -> tuple[Column, Column]:
    """(tier, class name) of the first class with a glob that matches; tier 0 and null without one."""
    tier, name = F.lit(0), F.lit(None).cast("string")
    for label, level, globs in reversed(classes):
        hit = path.rlike("|".join(map(glob_regex, globs)))
        tier, name = F.when(hit, level).otherwise(tier), F.when(hit, F.lit(label)).otherwise(name)
    return tier, name


def parse_classes(text: str) -> list[tuple[str, int, list[str]]]:
    """Classes from the strict subset `classes: - name/tier/globs`; raises ValueError for anything else."""
    if len(text.encode()) > 64 * 1024:
        raise ValueError("too large")
    if "\t" in text:
        raise ValueError("tab indent")
    lines = [x.rstrip() for x in text.splitlines() if x.strip() and not x.lstrip().startswith("#")]
    if not lines or lines[0] != "classes:":
        raise ValueError("classes: expected")
    found: list[dict] = []
    for line in lines[1:]:
        match = re.fullmatch(r"  - (name|tier|globs): (.+)|    (name|tier|globs): (.+)", line)
        if not match:
            raise ValueError(f"unexpected line: {line}")
        key, value = (match[1], match[2]) if match[1] else (match[3], match[4])
        if match[1]:
            found.append({})
        if not found or key in found[-1]:
            raise ValueError(f"misplaced or doubled key: {key}")
        if key == "globs":
            items = [x.strip().strip("\"'") for x in value.strip()[1:-1].split(",")] if re.fullmatch(r"\[.*\]", value.strip()) else []
            if not items or not all(items):
                raise ValueError("empty globs")
            found[-1][key] = items
        elif key == "tier":
            if not re.fullmatch("[0-9]", value):
                raise ValueError("tier outside 0..9")
            found[-1][key] = int(value)
        else:
            found[-1][key] = value.strip("\"'")
    if any(set(x) != {"name", "tier", "globs"} for x in found):
        raise ValueError("a class lacks a key")
    return [(x["name"], x["tier"], x["globs"]) for x in found]


def path_role(path: Column) -> Column:
    """test, doc, config or code, by extension and the path's words."""
    ext = F.lower(tx.extension(path))
    tested = F.arrays_overlap(tx.words(path), F.array(*map(F.lit, ["test", "tests", "spec", "specs"])))
    return F.when(ext.isin(SCRIPTS) & tested, "test").when(ext.isin(DOCUMENTS), "doc").when(ext.isin(SETTINGS), "config").otherwise("code")


def is_list_row(row: Column) -> Column:
    """A path row, or a `key: value` or `key = value` row."""
    return row.rlike(r"^(?:/|\./|~/|[A-Za-z]:\\)\S+$") | row.rlike(r"^[^\s:=]+\s*[:=]")


def content_role(path: Column, text: Column) -> Column:
    """The path's role; plain text is a document unless at least half of its meaningful rows are list rows."""
    rows = F.filter(F.transform(F.split(text, "\r?\n"), lambda r: F.regexp_replace(r, r"^\s+|\s+$", "")), lambda r: (r != "") & ~r.rlike("^[#;]"))
    listed = F.size(F.filter(rows, is_list_row)) * 2 >= F.size(rows)
    role = path_role(path)
    is_text = (role == "config") & (F.lower(tx.extension(path)) == "txt")
    return F.when(is_text, F.when((F.size(rows) > 0) & listed, "config").otherwise("doc")).otherwise(role)


def filename_words(path: Column) -> Column:
    """The name without extension; an index or README document has its directory's name before."""
    name = tx.base_name(path)
    parent = F.try_element_at(F.split(path, "/"), F.lit(-2))
    special = F.lower(name).isin("index", "readme") & (path_role(path) == "doc") & parent.isNotNull()
    return F.when(special, F.concat_ws(" ", parent, name)).otherwise(name)


def excluded_from_brief(path: Column) -> Column:
    """Office documents, the description sidecar and stored results don't rank."""
    return F.lower(tx.extension(path)).isin(OFFICE) | path.startswith(".corvane/")


def valid_descriptions(spark: SparkSession, lines: DataFrame, files: DataFrame) -> DataFrame:
    """(path, description) from rows (ord, line) of JSON {path, sha256, description}: malformed, doubled and stale ones dropped, the first of a path stays."""
    from pyspark.sql import Window

    parsed = lines.where(F.octet_length("line") <= 4096).select("ord", F.from_json("line", "path string, sha256 string, description string").alias("j")).select("ord", "j.*")
    parsed = parsed.where("path is not null and sha256 is not null and description is not null").where(F.octet_length("description") <= 2048)
    fresh = parsed.join(files.select("path", F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256")), ["path", "sha256"])
    first = F.row_number().over(Window.partitionBy("path").orderBy("ord"))
    return fresh.withColumn("__n", first).where("__n = 1").select("path", "description")


class ScanLimit(RuntimeError):
    """A tree with more files or bytes than a scan may take."""


def scan_tree(spark: SparkSession, root: str, glob: str | None = None, max_file_bytes: int = 1 << 20, max_files: int | None = None, max_total_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(files, diagnostics) below a folder: text files within the limit, and why others were left out.

    With max_files or max_total_bytes a tree beyond them is refused as a whole (ScanLimit); only names and sizes are read for that.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    raw = reader.load(root)
    prefix = "^" + re.escape(root if "://" in root or root.startswith("file:") else f"file:{root}").replace("file:", "file:/*", 1).rstrip("/") + "/"
    path = F.regexp_replace("path", prefix.replace("file:/*/", "file:/+"), "")
    rows = raw.select(path.alias("path"), "content", F.col("length").alias("bytes")).where(~ignored(F.col("path")))
    if max_files is not None or max_total_bytes is not None:
        found = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.when(F.col("bytes") <= max_file_bytes, F.col("bytes"))), F.lit(0)).alias("bytes")).first()
        if max_files is not None and found["n"] > max_files or max_total_bytes is not None and found["bytes"] > max_total_bytes:
            raise ScanLimit(f"{found['n']} files, {found['bytes']} bytes")
    # a NUL byte, or no UTF-8, among the first 512 bytes; a character that the cut splits counts as none
    head = F.substring("content", 1, 512)
    head_bad = F.hex(head).rlike("^(?:[0-9A-F]{2})*?00") | ~F.is_valid_utf8(head.cast("string"))
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    kind = F.when(F.col("bytes") > max_file_bytes, F.when(head_bad, "unsupported-input").otherwise("oversized-input")).when(~valid, "unsupported-input")
    marked = rows.withColumn("kind", kind)
    files = marked.where("kind is null").select("path", F.col("content").cast("string").alias("text"), F.col("bytes").cast("int").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    return files, marked.where("kind is not null").select("kind", "path", F.col("bytes").alias("actual"), F.lit(max_file_bytes).alias("limit"))


# Folders that no scan enters.
IGNORED = [".git", ".bearing", "target", "node_modules", "vendor", "generated", "cache", "caches"]


def ignored(path: Column, rules: list[str] | None = None) -> Column:
    """Whether a path has an ignored component, or the last of the rules that match it isn't a negation."""
    hit = F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, IGNORED)))
    verdict = F.lit(False)
    for rule in rules or []:
        negated, pattern = rule.startswith("!"), rule.lstrip("!").strip("/")
        regex = fnmatch.translate(pattern).replace("(?s:", "(?:").replace(r")\z", ")").replace(r")\Z", ")").replace(".*", "[^/]*")
        verdict = F.when(path.rlike(f"(?:^|/){regex}(?:/|$)"), F.lit(not negated)).otherwise(verdict)
    return hit | verdict
