"""Converters from binary formats to Markdown: a registry that callers extend."""

from __future__ import annotations

import csv
import functools
import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

Converter = Callable[[bytes], str | None]


def notebook(content: bytes) -> str | None:
    """Cells of a notebook: Markdown as it is, code fenced."""
    cells = json.loads(content.decode("utf-8", "replace")).get("cells", [])
    parts = []
    for cell in cells:
        source = "".join(cell.get("source", []))
        parts.append(f"```\n{source}\n```" if cell.get("cell_type") == "code" else source)
    return "\n\n".join(p for p in parts if p.strip()) or None


def table(content: bytes) -> str | None:
    """A CSV file as a Markdown table."""
    rows = [r for r in csv.reader(io.StringIO(content.decode("utf-8", "replace"))) if r]
    if not rows:
        return None
    line = lambda cells: "| " + " | ".join(c.replace("|", "\\|").replace("\n", " ") for c in cells) + " |"
    return "\n".join([line(rows[0]), line(["---"] * len(rows[0])), *map(line, rows[1:])])


def _parts(content: bytes, wanted: Callable[[str], bool]) -> Iterator[tuple[str, ElementTree.Element]]:
    """XML members of a ZIP archive in natural order; an archive that unpacks to over ``MOST_UNPACKED`` is refused."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        if sum(i.file_size for i in archive.infolist()) > MOST_UNPACKED:
            raise ValueError("archive unpacks to too much")
        for name in sorted((n for n in archive.namelist() if wanted(n)), key=lambda n: [int(p) if p.isdigit() else p for p in re.split(r"(\d+)", n)]):
            yield name, ElementTree.fromstring(archive.read(name))


def _local(node: ElementTree.Element) -> str:
    return node.tag.rsplit("}", 1)[-1]


def _said(node: ElementTree.Element, text: str = "t") -> str:
    return "".join(x.text or "" for x in node.iter() if _local(x) == text)


def _grid(rows: list[list[str]]) -> str:
    out = io.StringIO()
    csv.writer(out).writerows(rows)
    return table(out.getvalue().encode()) or ""


def word_document(content: bytes) -> str | None:
    """Paragraphs of a DOCX file; headings by their style, tables as Markdown tables."""
    out: list[str] = []
    for _, root in _parts(content, lambda n: n == "word/document.xml"):
        for block in next(x for x in root if _local(x) == "body"):
            if _local(block) == "tbl":
                rows = [[_said(c).strip() for c in r if _local(c) == "tc"] for r in block if _local(r) == "tr"]
                out.append(_grid(rows))
            elif _local(block) == "p" and (said := _said(block).strip()):
                style = next((v for x in block.iter() if _local(x) == "pStyle" for k, v in x.attrib.items() if k.endswith("val")), "")
                level = re.fullmatch(r"[Hh]eading ?([1-6])", style)
                out.append("#" * int(level[1]) + " " + said if level else said)
    return "\n\n".join(out) or None


def slides(content: bytes) -> str | None:
    """Slides of a PPTX file, each under a header with its number."""
    out = []
    for k, (_, root) in enumerate(_parts(content, lambda n: re.fullmatch(r"ppt/slides/slide\d+\.xml", n) is not None), 1):
        said = [s for p in root.iter() if _local(p) == "p" and (s := _said(p).strip())]
        out.append("\n\n".join([f"# Slide {k}", *said]))
    return "\n\n".join(out) or None


def workbook(content: bytes) -> str | None:
    """Sheets of an XLSX file as Markdown tables, each under a header with its name."""
    shared: list[str] = []
    names: list[str] = []
    out = []
    for name, root in _parts(content, lambda n: n in ("xl/sharedStrings.xml", "xl/workbook.xml")):
        if name.endswith("workbook.xml"):
            names = [s.attrib.get("name", "") for s in root.iter() if _local(s) == "sheet"]
        else:
            shared = [_said(s) for s in root if _local(s) == "si"]
    for k, (_, root) in enumerate(_parts(content, lambda n: re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n) is not None)):
        rows = []
        for row in (r for r in root.iter() if _local(r) == "row"):
            cells: list[str] = []
            for c in row:
                letters = re.match(r"[A-Z]*", c.attrib.get("r", ""))[0]
                place = functools.reduce(lambda n, x: n * 26 + ord(x) - 64, letters, 0) - 1
                cells += [""] * (place - len(cells))
                value = _said(c, "v")
                cells.append(shared[int(value)] if c.attrib.get("t") == "s" and value else _said(c) if c.attrib.get("t") == "inlineStr" else value)
            rows.append(cells)
        if rows:
            wide = max(map(len, rows))
            out.append(f"## {names[k] if k < len(names) else k + 1}\n\n" + _grid([r + [""] * (wide - len(r)) for r in rows]))
    return "\n\n".join(out) or None


def book(content: bytes) -> str | None:
    """Chapters of an EPUB file: headings and paragraphs of its XHTML members, by name."""
    out = []
    for _, root in _parts(content, lambda n: n.lower().endswith((".xhtml", ".html", ".htm"))):
        for node in root.iter():
            kind = _local(node)
            if re.fullmatch(r"h[1-6]|p|li", kind) and (said := " ".join("".join(node.itertext()).split())):
                out.append("#" * int(kind[1]) + " " + said if kind[0] == "h" else "- " + said if kind == "li" else said)
    return "\n\n".join(out) or None


CONVERTERS: dict[str, Converter] = {".ipynb": notebook, ".csv": table, ".docx": word_document, ".pptx": slides, ".xlsx": workbook, ".epub": book}
#: Suffixes of files that are no text: without a conversion they have no chunks.
BINARY = (".pdf", ".docx", ".pptx", ".xlsx", ".epub", ".png", ".jpg", ".jpeg")
#: Bytes that an archive may unpack to.
MOST_UNPACKED = 256 << 20
PLAIN = (".md", ".txt", ".rst")


def register(suffix: str, converter: Converter) -> None:
    CONVERTERS[suffix.lower()] = converter


def convert(suffix: str, content: bytes) -> str | None:
    """Markdown, or None where there is no converter, or it fails or gives nothing."""
    found = CONVERTERS.get(suffix)
    if found is None:
        return None
    try:
        return found(content) or None
    except Exception:
        return None
