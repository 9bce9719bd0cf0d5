"""Office documents and PDFs as anchor rows: bounded ZIP and XML reading, one row a paragraph, cell, shape or text run.

`anchors(files)` takes (path, content) and gives (path, format, id, role, locator, text, digest, refusal). A file outside the limits, or with parts
that could act, gives one row with its refusal and no text.
"""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.parsers import expat

import pandas as pd
from pyspark.sql import DataFrame

from ..session import ship

# Limits of packages.
MAX_ENTRIES, MAX_ENTRY_BYTES, MAX_RATIO, MAX_DEPTH, MAX_NODES = 4_096, 64 << 20, 100, 256, 1_000_000

_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_S = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_A = "http://schemas.openxmlformats.org/drawingml/2006/main"
_ACTIVE = re.compile(r"(?i)^\s*=?\s*(?:\+|-|@)?\s*(?:cmd\||dde|.*\b(?:webservice|filterxml|importdata|importxml|importhtml|importrange|call|register\.id|exec)\s*\(|.*\[[^\]]+\.xls)")


class Refusal(ValueError):
    """Why a document isn't read; a code only."""


class Node:
    """An XML element with its namespace, attributes, children and text."""

    __slots__ = ("attributes", "children", "name", "text")

    def __init__(self, name: str, attributes: dict[str, str]) -> None:
        self.name, self.attributes, self.children, self.text = name, attributes, [], ""

    def all(self, name: str) -> Iterator[Node]:
        """Elements of the name below, in their order."""
        for child in self.children:
            if child.name == name:
                yield child
            yield from child.all(name)

    def get(self, name: str, default: str = "") -> str:
        """An attribute by its local name."""
        return next((v for k, v in self.attributes.items() if k.split(" ")[-1] == name), default)


def parse_xml(data: bytes) -> Node:
    """The root of a document without a document type, within limits of depth and size."""
    parser = expat.ParserCreate(namespace_separator=" ")
    root = Node("", {})
    stack, count = [root], 0

    def start(name, attributes):
        nonlocal count
        count += 1
        if len(stack) > MAX_DEPTH or count > MAX_NODES:
            raise Refusal("xml-limit")
        node = Node(name, attributes)
        stack[-1].children.append(node)
        stack.append(node)

    def refuse(*_):
        raise Refusal("xml-doctype")

    def text(value):
        stack[-1].text += value

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler, parser.StartDoctypeDeclHandler = start, lambda _: stack.pop(), text, refuse
    try:
        parser.Parse(data, True)
    except expat.ExpatError:
        raise Refusal("xml-malformed") from None
    return root


def open_package(data: bytes) -> dict[str, bytes]:
    """The parts of a ZIP package by name; refuses bombs, unsafe names, encryption and macros."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except (zipfile.BadZipFile, ValueError):
        raise Refusal("zip-malformed") from None
    infos = archive.infolist()
    if len(infos) > MAX_ENTRIES:
        raise Refusal("zip-entries")
    if len({i.filename for i in infos}) < len(infos):
        raise Refusal("zip-duplicate")
    parts, total = {}, 0
    for info in infos:
        if info.filename.startswith(("/", "\\")) or ".." in info.filename.split("/"):
            raise Refusal("zip-path")
        if info.flag_bits & 1:
            raise Refusal("zip-encrypted")
        if info.file_size > MAX_ENTRY_BYTES or info.file_size > MAX_RATIO * max(info.compress_size, 1) + 4096:
            raise Refusal("zip-ratio")
        if "vbaProject" in info.filename or "/embeddings/" in info.filename or "/activeX/" in info.filename:
            raise Refusal("active-content")
        total += info.file_size
        if total > 4 * MAX_ENTRY_BYTES:
            raise Refusal("zip-total")
        try:
            parts[info.filename] = archive.read(info)
        except (zipfile.BadZipFile, zlib.error, NotImplementedError):
            raise Refusal("zip-malformed") from None
    if "[Content_Types].xml" not in parts:
        raise Refusal("no-content-types")
    for name, content in parts.items():
        if name.endswith(".rels") and b'TargetMode="External"' in content and re.search(rb"(?:attachedTemplate|oleObject|externalLink)", content):
            raise Refusal("external-target")
    return parts


def relationships(parts: dict[str, bytes], source: str) -> dict[str, str]:
    """Targets by relationship id of a part."""
    folder, _, name = source.rpartition("/")
    rels = parts.get(f"{folder}/_rels/{name}.rels" if folder else f"_rels/{name}.rels")
    out = {}
    for rel in parse_xml(rels).children[0].children if rels else []:
        target = rel.get("Target")
        pieces: list[str] = [] if target.startswith("/") else folder.split("/") if folder else []
        for piece in target.strip("/").split("/"):
            pieces = pieces[:-1] if piece == ".." else pieces + [piece] if piece != "." else pieces
        out[rel.get("Id")] = "/".join(pieces)
    return out


def read_docx(data: bytes) -> Iterator[tuple[str, str, str]]:
    """(role, locator, text) of paragraphs, table cells, notes and comments."""
    parts = open_package(data)
    if "word/document.xml" not in parts:
        raise Refusal("no-main-part")
    body = next(parse_xml(parts["word/document.xml"]).all(f"{_W} body"), None)
    if body is None:
        raise Refusal("no-main-part")
    inserted = lambda p: "".join(t.text for t in p.all(f"{_W} t"))
    block = 0
    for child in body.children:
        if child.name == f"{_W} p":
            block += 1
            style = next((s.get("val") for s in child.all(f"{_W} pStyle")), "")
            listed = next(child.all(f"{_W} numPr"), None) is not None
            kind = "title" if style == "Title" else "heading" if style.startswith("Heading") else "caption" if style == "Caption" else "list-item" if listed else "paragraph"
            yield kind, f"block {block}", inserted(child)
        elif child.name == f"{_W} tbl":
            block += 1
            for r, row in enumerate((x for x in child.children if x.name == f"{_W} tr"), 1):
                for c, cell in enumerate((x for x in row.children if x.name == f"{_W} tc"), 1):
                    yield "cell", f"block {block} row {r} column {c}", "\n".join(inserted(p) for p in cell.all(f"{_W} p"))
    for role, part in (("footnote", "word/footnotes.xml"), ("endnote", "word/endnotes.xml"), ("comment", "word/comments.xml")):
        if part in parts:
            for note in parse_xml(parts[part]).all(f"{_W} {role}"):
                yield role, f"{role} {note.get('id')}", inserted(note)


def cell_place(reference: str) -> tuple[int, int]:
    """(row, column) of A1."""
    match = re.fullmatch(r"([A-Z]{1,3})([1-9][0-9]{0,6})", reference)
    if not match:
        raise Refusal("cell-reference")
    column = 0
    for letter in match[1]:
        column = column * 26 + ord(letter) - 64
    return int(match[2]), column


def read_xlsx(data: bytes) -> Iterator[tuple[str, str, str]]:
    """(role, locator, text) of cells: lexical numbers, shared and inline strings, formulas with their cached value."""
    parts = open_package(data)
    if "xl/workbook.xml" not in parts:
        raise Refusal("no-main-part")
    rels = relationships(parts, "xl/workbook.xml")
    shared = ["".join(t.text for t in si.all(f"{_S} t")) for si in parse_xml(parts["xl/sharedStrings.xml"]).all(f"{_S} si")] if "xl/sharedStrings.xml" in parts else []
    for sheet in parse_xml(parts["xl/workbook.xml"]).all(f"{_S} sheet"):
        part = parts.get(rels.get(sheet.get("id"), ""))
        if part is None:
            raise Refusal("no-sheet-part")
        row_no = 0
        for row in parse_xml(part).all(f"{_S} row"):
            row_no = int(row.get("r") or row_no + 1)
            column = 0
            for cell in (c for c in row.children if c.name == f"{_S} c"):
                _, column = cell_place(cell.get("r")) if cell.get("r") else (row_no, column + 1)
                value = next((v.text for v in cell.children if v.name == f"{_S} v"), None)
                formula = next((f.text for f in cell.children if f.name == f"{_S} f"), None)
                kind = cell.get("t", "n")
                if kind == "s":
                    if value is None or not value.isdigit() or int(value) >= len(shared):
                        raise Refusal("shared-string")
                    value = shared[int(value)]
                elif kind == "inlineStr":
                    value = "".join(t.text for t in cell.all(f"{_S} t"))
                elif kind == "b":
                    value = {"1": "TRUE", "0": "FALSE"}.get(value or "", value)
                elif kind == "n" and value is not None and not re.fullmatch(r"-?[0-9]*\.?[0-9]+(?:[eE][+-]?[0-9]+)?", value):
                    raise Refusal("cell-value")
                if formula and _ACTIVE.search(formula):
                    raise Refusal("active-formula")
                if value is not None or formula:
                    yield "formula" if formula else "cell", f"{sheet.get('name')}!R{row_no}C{column}", f"={formula} [cached: {value or ''}]" if formula else value


def read_pptx(data: bytes) -> Iterator[tuple[str, str, str]]:
    """(role, locator, text) of shapes in their order on slides, and of notes."""
    parts = open_package(data)
    if "ppt/presentation.xml" not in parts:
        raise Refusal("no-main-part")
    rels = relationships(parts, "ppt/presentation.xml")
    slides = [rels.get(s.get("id") if not s.get("id").isdigit() else next(v for k, v in s.attributes.items() if k.endswith(" id")), "") for s in parse_xml(parts["ppt/presentation.xml"]).all("http://schemas.openxmlformats.org/presentationml/2006/main sldId")]
    if len(set(slides)) < len(slides):
        raise Refusal("slide-doubled")
    for number, name in enumerate(slides, 1):
        if name not in parts:
            raise Refusal("no-slide-part")
        for shape_no, shape in enumerate(parse_xml(parts[name]).all(f"{_A} p"), 1):
            text = "".join(t.text for t in shape.all(f"{_A} t"))
            if text:
                yield "shape", f"slide {number} paragraph {shape_no}", text
        notes = next((t for t in relationships(parts, name).values() if "notesSlide" in t), None)
        if notes in parts:
            yield "notes", f"slide {number} notes", "".join(t.text for t in parse_xml(parts[notes]).all(f"{_A} t"))


_ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}
_SHOWN = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|\[|\]|-?[0-9.]+|[A-Za-z'\"*]+|/[^\s/\[\]()<>]+", re.S)


def _pdf_string(token: bytes) -> str:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        return raw.decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("latin-1")
    text = token[1:-1].decode("latin-1")
    return re.sub(r"\\([0-7]{1,3}|\r?\n|.)", lambda m: chr(int(m[1], 8) & 255) if m[1][0] in "01234567" else "" if "\n" in m[1] else _ESCAPES.get(m[1], m[1]), text, flags=re.S)


def read_pdf(data: bytes) -> Iterator[tuple[str, str, str]]:
    """(role, locator, text) of text blocks by page: objects are found by their heads, streams are inflated within limits; scripts, launches and forms that submit are refused."""
    if not data.startswith(b"%PDF-"):
        raise Refusal("pdf-header")
    if re.search(rb"/(?:JavaScript|JS|Launch|SubmitForm|ImportData|EmbeddedFile|RichMedia)\b", data):
        raise Refusal("active-content")
    if b"/Encrypt" in data:
        raise Refusal("encrypted")
    objects: dict[int, tuple[bytes, bytes | None]] = {}
    for match in re.finditer(rb"(?<![0-9])([0-9]{1,8}) [0-9]{1,5} obj\b(.*?)endobj", data, re.S):
        head, _, rest = match[2].partition(b"stream")
        body = None
        if rest:
            raw = re.sub(rb"^\r?\n", b"", rest.rsplit(b"endstream", 1)[0])
            if b"/FlateDecode" in head:
                unpacker = zlib.decompressobj()
                try:
                    body = unpacker.decompress(raw, MAX_ENTRY_BYTES)
                except zlib.error:
                    raise Refusal("stream-malformed") from None
                if unpacker.unconsumed_tail:
                    raise Refusal("stream-limit")
            else:
                body = raw
        objects[int(match[1])] = (head, body)
    for head, body in list(objects.values()):
        if body is not None and b"/ObjStm" in head:
            first, count = (int(re.search(rb"/%s\s+([0-9]+)" % k, head)[1]) for k in (b"First", b"N"))
            numbers = [int(x) for x in body[:first].split()][: 2 * count]
            ends = [*numbers[3::2], len(body) - first]
            for number, begin, end in zip(numbers[::2], numbers[1::2], ends, strict=False):
                objects.setdefault(number, (body[first + begin : first + end], None))
    pages, seen = [], set()

    def walk(number: int, depth: int) -> None:
        if number in seen or depth > 64 or len(pages) > 10_000:
            raise Refusal("page-tree")
        seen.add(number)
        head = objects.get(number, (b"", None))[0]
        kids = re.search(rb"/Kids\s*\[([^\]]*)\]", head)
        if kids:
            for kid in re.findall(rb"([0-9]+)\s+[0-9]+\s+R", kids[1]):
                walk(int(kid), depth + 1)
        else:
            pages.append(head)

    roots = [int(m[1]) for h, _ in objects.values() if re.search(rb"/Type\s*/Catalog", h) for m in [re.search(rb"/Pages\s+([0-9]+)", h)] if m]
    if not roots:
        raise Refusal("no-pages")
    walk(roots[-1], 0)
    for number, head in enumerate(pages, 1):
        listed = re.search(rb"/Contents\s*(?:\[([^\]]*)\]|([0-9]+)\s+[0-9]+\s+R)", head)
        ids = [int(x) for x in re.findall(rb"([0-9]+)\s+[0-9]+\s+R", listed[1] or b"")] if listed and listed[1] is not None else [int(listed[2])] if listed else []
        content = b"\n".join(objects.get(i, (b"", b""))[1] or b"" for i in ids)
        lines: list[str] = []
        blocks, waiting = [], []
        for token in _SHOWN.findall(content):
            if token[:1] in b"(<" and token[:1]:
                waiting.append(_pdf_string(token))
            elif token in (b"Tj", b"TJ", b"'", b'"'):
                lines.append("".join(waiting))
                waiting = []
            elif token in (b"Td", b"TD", b"T*", b"Tm") and lines and lines[-1]:
                lines.append("")
            elif token == b"ET":
                blocks.append(" ".join(x for x in lines if x).strip())
                lines, waiting = [], []
        for place, text in enumerate((b for b in blocks if b), 1):
            yield "block", f"page {number} block {place}", text


READERS = {"docx": read_docx, "xlsx": read_xlsx, "pptx": read_pptx, "pdf": read_pdf}


def read_document(path: str, data: bytes) -> list[tuple[str, str, str, str, str, str | None]]:
    """(format, id, role, locator, text, refusal) rows of one document."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind not in READERS:
        return [(kind, "", "", "", "", "unsupported-format")]
    try:
        rows = list(READERS[kind](data))
    except Refusal as reason:
        return [(kind, "", "", "", "", str(reason))]
    return [(kind, f"{kind}:{hashlib.sha256(f'{path} {locator}'.encode()).hexdigest()[:32]}", role, locator, text, None) for role, locator, text in rows]


def anchors(files: DataFrame) -> DataFrame:
    """(path, format, id, role, locator, text, digest, refusal) of (path, content) rows."""
    ship(files.sparkSession)

    def run(batches):
        for pdf in batches:
            rows = [(p, *row) for p, c in zip(pdf["path"], pdf["content"], strict=True) for row in read_document(p, bytes(c))]
            out = pd.DataFrame(rows, columns=["path", "format", "id", "role", "locator", "text", "refusal"])
            out["digest"] = [hashlib.sha256(t.encode()).hexdigest() for t in out["text"]]
            yield out[["path", "format", "id", "role", "locator", "text", "digest", "refusal"]]

    return files.select("path", "content").mapInPandas(run, "path string, format string, id string, role string, locator string, text string, digest string, refusal string")


def discover(files: DataFrame, limit: int = 64) -> DataFrame:
    """The first `limit` office documents by path."""
    from pyspark.sql import functions as F

    return files.where(F.lower("path").rlike(r"\.(?:docx|xlsx|pptx|pdf)$")).orderBy("path").limit(limit)
