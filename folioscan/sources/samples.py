"""Small sample files, made with the standard library."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
X = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'

# The sample contents.
PARAGRAPHS = ["サンプル文書（Word）", "", "消費税について", "消費税は10%です。軽減税率は8%です。", "", "全文検索システムのテスト用サンプルです。"]
ROWS = [("項目", "金額", "消費税"), ("商品A", 1000, 100), ("商品B", 2000, 200)]


def _zip(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for name, text in parts.items():
            archive.writestr(name, text)
    return out.getvalue()


def _relations(targets: list[str]) -> str:
    return '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{k}" Target="{t}"/>' for k, t in enumerate(targets, 1)) + "</Relationships>"


def docx(paragraphs: list[str], table: list[str] = ()) -> bytes:
    """A Word file with paragraphs, and a table with one paragraph per cell."""
    p = lambda t: f"<w:p><w:r><w:t>{escape(t)}</w:t></w:r></w:p>"
    cells = "".join(f"<w:tc>{p(t)}</w:tc>" for t in table)
    body = "".join(map(p, paragraphs)) + (f"<w:tbl><w:tr>{cells}</w:tr></w:tbl>" if table else "")
    return _zip({"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>"})


def xlsx(sheets: list[list[tuple]], shared: bool = False) -> bytes:
    """An Excel file; its texts are shared strings or stand in their cells."""
    strings: list[str] = []

    def cell(value) -> str:
        if not isinstance(value, str):
            return f"<c><v>{value}</v></c>"
        if not shared:
            return f'<c t="inlineStr"><is><t>{escape(value)}</t></is></c>'
        strings.append(value)
        return f'<c t="s"><v>{len(strings) - 1}</v></c>'

    parts = {f"xl/worksheets/sheet{k}.xml": f"<worksheet {X}><sheetData>" + "".join("<row>" + "".join(map(cell, row)) + "</row>" for row in rows) + "</sheetData></worksheet>" for k, rows in enumerate(sheets, 1)}
    parts["xl/workbook.xml"] = f"<workbook {X} {R}><sheets>" + "".join(f'<sheet name="s{k}" r:id="r{k}"/>' for k in range(1, len(sheets) + 1)) + "</sheets></workbook>"
    parts["xl/_rels/workbook.xml.rels"] = _relations([f"worksheets/sheet{k}.xml" for k in range(1, len(sheets) + 1)])
    parts["xl/sharedStrings.xml"] = f"<sst {X}>" + "".join(f"<si><t>{escape(s)}</t></si>" for s in strings) + "</sst>"
    return _zip(parts)


def pptx(slides: list[list[str]]) -> bytes:
    """A PowerPoint file with runs of text on its slides."""
    parts = {f"ppt/slides/slide{k}.xml": f"<p:sld xmlns:p='p' {A}>" + "".join(f"<a:p><a:r><a:t>{escape(t)}</a:t></a:r></a:p>" for t in runs) + "</p:sld>" for k, runs in enumerate(slides, 1)}
    ids = "".join(f'<p:sldId id="{255 + k}" r:id="r{k}"/>' for k in range(1, len(slides) + 1))
    parts["ppt/presentation.xml"] = f"<p:presentation xmlns:p='p' {R}><p:sldIdLst>{ids}</p:sldIdLst></p:presentation>"
    parts["ppt/_rels/presentation.xml.rels"] = _relations([f"slides/slide{k}.xml" for k in range(1, len(slides) + 1)])
    return _zip(parts)


def files() -> dict[str, bytes]:
    """Sample files by path."""
    return {
        "/samples/sample.docx": docx(PARAGRAPHS, ["表の中"]),
        "/samples/sample.xlsx": xlsx([ROWS]),
        "/samples/shared.xlsx": xlsx([ROWS, [("二枚目",)]], shared=True),
        "/samples/sample.pptx": pptx([["一枚目", " ", "消費税"], ["二枚目"]]),
        "/samples/broken.docx": b"no archive",
        "/samples/sjis.txt": "消費税は10%です。軽減税率は8%です。".encode("cp932"),
        "/samples/utf16.txt": "消費税".encode("utf-16"),
        "/samples/utf8.txt": "消費税".encode(),
    }
