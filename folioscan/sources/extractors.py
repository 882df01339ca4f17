"""Text extractors: from a file's bytes to its text, by extension."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

from folioscan import schema as S

#: XML namespaces of Office files.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
X = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
REL = "{http://schemas.openxmlformats.org/package/2006/relationships}"


def decode_text(data: bytes) -> str:
    """Bytes as text: by byte-order mark, else UTF-8, else the likeliest charset, else
    UTF-8 with replacement characters. Never fails."""
    for mark, charset in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe\x00\x00", "utf-32"), (b"\x00\x00\xfe\xff", "utf-32"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(mark):
            return data.decode(charset, errors="replace")
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        pass
    try:
        from charset_normalizer import from_bytes

        best = from_bytes(data).best()
        if best is not None:
            return str(best)
    except ImportError:
        for charset in ("cp932", "euc-jp", "cp1252"):
            try:
                return data.decode(charset)
            except UnicodeDecodeError:
                continue
    return data.decode("utf-8", errors="replace")


def extract_text(data: bytes) -> str:
    """A text file's text; files over 10 MiB are refused."""
    if len(data) > S.MAX_TEXT_FILE_BYTES:
        raise ValueError(f"file of {len(data)} bytes is over {S.MAX_TEXT_FILE_BYTES}")
    return decode_text(data)


def _part(archive: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    try:
        data = archive.read(name)  # a lookup; the list of names is as long as a file has slides
    except KeyError:
        return None
    return ElementTree.fromstring(data)


def _targets(archive: zipfile.ZipFile, part: str) -> dict[str, str]:
    """Relationship ids of a part and the parts they lead to."""
    folder, _, name = part.rpartition("/")
    found = _part(archive, f"{folder}/_rels/{name}.rels")
    out = {}
    for x in found.iter(f"{REL}Relationship") if found is not None else ():
        target = x.get("Target", "")
        out[x.get("Id")] = target.lstrip("/") if target.startswith("/") else f"{folder}/{target}"
    return out


def extract_docx(data: bytes, include_tables: bool = False) -> str:
    """The paragraphs of the body that aren't blank, a line each; those in tables only
    with ``include_tables``."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        root = _part(archive, "word/document.xml")
    body = root.find(f"{W}body") if root is not None else None
    if body is None:
        return ""
    paragraphs = body.iter(f"{W}p") if include_tables else body.findall(f"{W}p")
    texts = ("".join(t.text or "" for t in p.iter(f"{W}t")) for p in paragraphs)
    return "".join(t + "\n" for t in texts if t.strip())


def extract_xlsx(data: bytes, compat: bool = False) -> str:
    """The cells of each row that aren't empty, joined by tabs; an empty line after
    each sheet. Text in the cell itself is read too, unless ``compat``."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        book = _part(archive, "xl/workbook.xml")
        strings = _part(archive, "xl/sharedStrings.xml")
        shared = ["".join(t.text or "" for t in s.iter(f"{X}t")) for s in strings.findall(f"{X}si")] if strings is not None else []
        targets, out = _targets(archive, "xl/workbook.xml"), []
        for sheet in book.iter(f"{X}sheet") if book is not None else ():
            root = _part(archive, targets.get(sheet.get(f"{R}id"), ""))
            for row in root.iter(f"{X}row") if root is not None else ():
                cells = [_cell(c, shared, compat) for c in row.findall(f"{X}c")]
                if any(cells):
                    out.append("\t".join(c for c in cells if c))
            out.append("")
    return "".join(x + "\n" for x in out)


def _cell(cell: ElementTree.Element, shared: list[str], compat: bool) -> str:
    if cell.get("t") == "inlineStr" and not compat:
        return "".join(t.text or "" for t in cell.iter(f"{X}t"))
    value = cell.findtext(f"{X}v") or ""
    if cell.get("t") == "s" and value.isdigit() and int(value) < len(shared):
        return shared[int(value)]
    return value


def extract_pptx(data: bytes) -> str:
    """Every run of text that isn't blank on a line of its own; an empty line after each slide."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        deck, targets, out = _part(archive, "ppt/presentation.xml"), _targets(archive, "ppt/presentation.xml"), []
        ids = [x.get(f"{R}id") for x in deck.iter() if x.tag.endswith("}sldId")] if deck is not None else []
        for name in (targets[i] for i in ids if i in targets):
            slide = _part(archive, name)
            if slide is not None:
                out += [t.text for t in slide.iter(f"{A}t") if (t.text or "").strip()] + [""]
    return "".join(x + "\n" for x in out)


def extract_pdf(data: bytes) -> str:
    """The text of each page and an empty line, where a PDF library is installed."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise ValueError("no PDF library is installed") from e
    return "".join((page.extract_text() or "") + "\n\n" for page in PdfReader(io.BytesIO(data)).pages)


class Registry:
    """Extractors in the order they were added; the first that has an extension reads it."""

    def __init__(self) -> None:
        self._known: list[tuple[frozenset[str], Callable[[bytes], str]]] = []

    def add(self, extensions, extractor: Callable[[bytes], str]) -> None:
        """Let ``extractor`` read files with these extensions."""
        self._known.append((frozenset(e.lower() for e in extensions), extractor))

    def get(self, ext: str) -> Callable[[bytes], str] | None:
        """The extractor of an extension, or none."""
        return next((f for known, f in self._known if ext.lower() in known), None)

    def extensions(self) -> list[str]:
        """Every extension that can be read, once."""
        return sorted(set().union(*[known for known, _ in self._known]))


def default_registry() -> Registry:
    """Extractors for text, Office and PDF files."""
    out = Registry()
    out.add(S.TEXT_EXTENSIONS, extract_text)
    out.add([".docx"], extract_docx)
    out.add([".xlsx"], extract_xlsx)
    out.add([".pptx"], extract_pptx)
    out.add(S.PDF_EXTENSIONS, extract_pdf)
    return out
