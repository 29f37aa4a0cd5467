"""DOCX and XLSX files as rows, read from their zip parts with the standard library."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

CELLS = "path string, sheet_ix int, sheet string, row int, col int, value string, error string"
TEXTS = "path string, md string, images array<struct<name: string, content: binary>>, error string"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _name(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _all(e: ElementTree.Element, name: str) -> list[ElementTree.Element]:
    return [x for x in e.iter() if _name(x) == name]


def _attr(e: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), None)


def _parts(z: zipfile.ZipFile, of: str) -> dict[str, str]:
    """Target part of each relationship of a part."""
    folder, base = posixpath.split(of)
    at = f"{folder}/_rels/{base}.rels"
    if at not in z.namelist():
        return {}
    return {r.get("Id"): posixpath.normpath(posixpath.join(folder, r.get("Target"))) if not r.get("Target").startswith("/") else r.get("Target")[1:] for r in ElementTree.fromstring(z.read(at))}


def column_number(ref: str) -> int:
    """0 for A1, 27 for AB7."""
    n = 0
    for ch in re.match("[A-Z]+", ref).group():
        n = n * 26 + ord(ch) - ord("A") + 1
    return n - 1


def sheet_cells(content: bytes) -> Iterator[tuple[int, str, int, int, str]]:
    """(sheet_ix, sheet, row, col, value) of every filled cell, in workbook order."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in _all(si, "t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        targets = _parts(z, "xl/workbook.xml")
        for ix, sheet in enumerate(_all(ElementTree.fromstring(z.read("xl/workbook.xml")), "sheet")):
            with z.open(targets[sheet.get(f"{_REL}id")]) as part:
                for _, e in ElementTree.iterparse(part):
                    if _name(e) == "c":
                        value = _value(e, shared)
                        if value is not None:
                            ref = e.get("r")
                            yield ix, sheet.get("name"), int(re.search(r"\d+", ref).group()) - 1, column_number(ref), value
                    if _name(e) == "row":
                        e.clear()


def _value(cell: ElementTree.Element, shared: list[str]) -> str | None:
    kind = cell.get("t")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in _all(cell, "t"))
    v = next((x.text for x in cell if _name(x) == "v"), None)
    if v is None:
        return None
    return shared[int(v)] if kind == "s" else {"1": "True", "0": "False"}.get(v, v) if kind == "b" else v


def docx_markdown(content: bytes) -> tuple[str, list[tuple[str, bytes]]]:
    """(Markdown, images in order of appearance); headings, lists, tables, bold and italic runs are kept."""
    images: list[tuple[str, bytes]] = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        targets = _parts(z, "word/document.xml")

        def picture(blip: ElementTree.Element) -> str:
            part = targets.get(_attr(blip, "embed"))
            if part is None or part not in z.namelist():
                return ""
            suffix = part.rpartition(".")[2].lower()
            name = f"docx_img_{len(images) + 1}.{'jpg' if suffix == 'jpeg' else suffix}"
            images.append((name, z.read(part)))
            return f"![](images/{name})"

        def run(r: ElementTree.Element) -> str:
            out = ""
            for x in r.iter():
                kind = _name(x)
                out += (x.text or "") if kind == "t" else "\t" if kind == "tab" else "  \n" if kind == "br" else picture(x) if kind == "blip" else ""
            on = {_name(p) for p in r.iter() if _name(p) in ("b", "i") and _attr(p, "val") not in ("0", "false")}
            mark = ("**" if "b" in on else "") + ("*" if "i" in on else "")
            core = out.strip()
            return out if not mark or not core else out.replace(core, f"{mark}{core}{mark[::-1]}", 1)

        def paragraph(p: ElementTree.Element) -> str:
            text = "".join(map(run, _all(p, "r"))).strip()
            style = next((_attr(s, "val") or "" for s in _all(p, "pStyle")), "")
            level = re.fullmatch(r"[Hh]eading\s*([1-6])", style)
            if not text:
                return ""
            return f"{'#' * int(level[1])} {text}" if level else f"* {text}" if _all(p, "numPr") else text

        blocks: list[tuple[bool, str]] = []
        for e in _all(ElementTree.fromstring(z.read("word/document.xml")), "body")[0]:
            if _name(e) == "p":
                text = paragraph(e)
                blocks.append((text.startswith("* "), text))
            elif _name(e) == "tbl":
                rows = [[" ".join(filter(None, map(paragraph, _all(c, "p")))).replace("|", "\\|") for c in r if _name(c) == "tc"] for r in e if _name(r) == "tr"]
                width = max(map(len, rows), default=0)
                lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
                blocks.append((False, "\n".join(lines[:1] + ["| " + " | ".join(["---"] * width) + " |"] + lines[1:]) if width else ""))
    md, before = "", False
    for item, text in blocks:
        if text:
            md += ("\n" if item and before else "\n\n" if md else "") + text
            before = item
    return md, images


def _failed(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"


def xlsx_cells(files: DataFrame) -> DataFrame:
    """Cells of workbooks in (path, content); a file that cannot be read gives one row with its error."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "sheet_ix", "sheet", "row", "col", "value", "error"]
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                rows = []
                try:
                    for cell in sheet_cells(content):
                        rows.append((path, *cell, None))
                        if len(rows) == 50_000:
                            yield pd.DataFrame(rows, columns=names)
                            rows = []
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, TypeError, ValueError, IndexError) as e:
                    rows.append((path, None, None, None, None, None, _failed(e)))
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(read, CELLS)


def docx_texts(files: DataFrame) -> DataFrame:
    """Markdown and images of documents in (path, content); error instead for a file that cannot be read."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    md, images = docx_markdown(content)
                    row = (path, md, [{"name": n, "content": c} for n, c in images], None)
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, TypeError, ValueError, IndexError) as e:
                    row = (path, None, [], _failed(e))
                yield pd.DataFrame([row], columns=["path", "md", "images", "error"])

    return files.select("path", "content").mapInPandas(read, TEXTS)
