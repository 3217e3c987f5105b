"""Texts of office files: one small helper per format, used on the rows of a Spark task.

The formats are ZIP archives of XML, so the standard library reads them.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from xml.etree import ElementTree as ET

MAX_PART = 256 << 20  # bytes of an unpacked part; a larger one is an error, not a full memory


def _part(package: zipfile.ZipFile, name: str):
    if package.getinfo(name).file_size > MAX_PART:
        raise ValueError(f"{name} unpacks to more than {MAX_PART} bytes")
    return ET.fromstring(package.read(name))


def _listed(package: zipfile.ZipFile, main: str, tag: str) -> list[str]:
    """The parts that the elements ``tag`` of the main part refer to, in their order."""
    folder, name = posixpath.split(main)
    targets = {r.get("Id"): r.get("Target") for r in _part(package, f"{folder}/_rels/{name}.rels")}
    # r:id comes beside a plain id; only the former is namespaced.
    ids = [next(v for k, v in e.attrib.items() if k.endswith("}id")) for e in _part(package, main).iterfind(f".//{{*}}{tag}")]
    return [posixpath.normpath(posixpath.join("/" + folder, targets[i])).lstrip("/") for i in ids]


def _runs(paragraph, breaks: dict[str, str]) -> str:
    return "".join(e.text or "" if e.tag.endswith("}t") else breaks.get(e.tag.rsplit("}", 1)[-1], "") for e in paragraph.iter())


def docx_text(package: zipfile.ZipFile) -> str:
    """Every paragraph of the body, each followed by a line feed."""
    paragraphs = _part(package, "word/document.xml").iterfind("./{*}body/{*}p")
    return "".join(_runs(p, {"tab": "\t", "br": "\n", "cr": "\n"}) + "\n" for p in paragraphs)


def pptx_text(package: zipfile.ZipFile) -> str:
    """The text of every text shape, slide by slide, each followed by a line feed."""
    slides = [_part(package, name) for name in _listed(package, "ppt/presentation.xml", "sldId")]
    shapes = [s for slide in slides for s in slide.iterfind("./{*}cSld/{*}spTree/{*}sp")]
    return "".join("\n".join(_runs(p, {"br": "\v"}) for p in s.iterfind("./{*}txBody/{*}p")) + "\n" for s in shapes)


def xlsx_text(package: zipfile.ZipFile) -> str:
    """The cells that the first sheet stores, tabs between cells and line feeds between rows.

    Empty cells are not filled in, so a text is never larger than its file's cells.
    """
    shared = []
    if "xl/sharedStrings.xml" in package.namelist():
        shared = [_runs(s, {}) for s in _part(package, "xl/sharedStrings.xml").iterfind("./{*}si")]

    def value(cell) -> str:
        kind = cell.get("t")
        raw = _runs(cell, {}) if kind == "inlineStr" else cell.findtext("./{*}v") or ""
        return shared[int(raw)] if kind == "s" and raw else {"0": "False", "1": "True"}[raw] if kind == "b" and raw else raw

    rows = _part(package, _listed(package, "xl/workbook.xml", "sheet")[0]).iterfind("./{*}sheetData/{*}row")
    return "\n".join("\t".join(value(c) for c in row.iterfind("./{*}c")) for row in rows)


READERS = {".docx": docx_text, ".pptx": pptx_text, ".xlsx": xlsx_text}


def read_document(extension: str, content: bytes) -> tuple[str | None, str, str | None]:
    """(text, status, error) of one file; status is ok, unsupported or error."""
    if extension not in READERS:
        return None, "unsupported", f"no reader for {extension}"
    try:
        return READERS[extension](zipfile.ZipFile(io.BytesIO(content))), "ok", None
    except Exception as e:  # a damaged file is a row with a status, not a failed job
        return None, "error", f"{type(e).__name__}: {e}"
