"""Text of office files: documents, workbooks and slides, from their zipped parts."""

from __future__ import annotations

import io
import re
import zipfile

from granary.sources.markup import Lines, attribute, events, local

ENTRY_BYTES, TOTAL_BYTES, MAX_PARTS = 64 << 20, 16 << 20, 512
KINDS = {"docx": "docx docm dotx dotm", "xlsx": "xlsx xlsm xltx xltm", "pptx": "pptx pptm ppsx ppsm potx potm"}
KIND_OF = {e: k for k, text in KINDS.items() for e in text.split()}


class Parts:
    """Parts of a zip container by name, the first of equal names; unpacked bytes are bounded."""

    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        self.info: dict[str, zipfile.ZipInfo] = {}
        for i in self.zip.infolist():
            self.info.setdefault(i.filename, i)
        self.left = TOTAL_BYTES

    def text(self, name: str) -> str | None:
        info = self.info.get(name)
        if info is None or info.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED) or info.file_size > min(ENTRY_BYTES, self.left):
            return None
        most = min(ENTRY_BYTES, self.left)
        with self.zip.open(info) as f:
            data = f.read(most + 1)
        if len(data) > most:
            return None
        self.left -= len(data)
        return data.decode("utf-8", "replace")


def number(part: str) -> int:
    digits = re.search(r"[0-9]+", part.rsplit("/", 1)[-1])
    return int(digits[0]) if digits else 0


def flow(xml: str, out: Lines, breaks: dict[str, str], hidden: str | None = None) -> None:
    """Paragraphs as lines and table rows as cells with bars, of a document or a slide."""
    para: list[str] = []
    cell: list[str] = []
    row: list[str] = []
    cells, shown, gone = 0, False, 0
    for kind, name, _ in events(xml):
        tag = local(name) if kind != "text" else ""
        if kind == "text":
            if shown and not gone:
                para.append(name)
        elif kind == "empty":
            para.append(breaks.get(tag, ""))
        elif tag == "t":
            shown = kind == "open"
        elif tag == hidden:
            gone = max(0, gone + (1 if kind == "open" else -1))
        elif tag == "tc":
            if kind == "open":
                cells, cell = cells + 1, []
            else:
                cells = max(0, cells - 1)
                row.append(" ".join(cell))
                cell = []
        elif tag == "tr":
            if kind == "close":
                out.push(" | ".join(row))
            row = []
        elif tag == "p" and kind == "close":
            line, para = "".join(para), []
            if not cells:
                for part in line.split("\n"):
                    out.push(part)
            elif line.strip():
                cell.append(line.strip())
    if "".join(para).strip():
        out.push("".join(para))


def docx(parts: Parts) -> str:
    xml = parts.text("word/document.xml")
    if xml is None:
        raise ValueError("no word/document.xml (not a .docx?)")
    out = Lines()
    flow(xml, out, {"tab": "\t", "br": "\n", "cr": "\n"}, "delText")
    return out.text()


def runs(xml: str, group: str) -> list[str]:
    """Text runs of each element of a name, joined."""
    out: list[str] = []
    held: list[str] = []
    inside = False
    for kind, name, _ in events(xml):
        tag = local(name) if kind != "text" else ""
        if kind == "text" and inside:
            held.append(name)
        elif tag == "t":
            inside = kind == "open"
        elif tag == group:
            if kind == "close":
                out.append("".join(held))
            held = []
    return out


def sheet_parts(parts: Parts) -> list[tuple[str, str]]:
    """Names and parts of the sheets in the workbook's order; by part number where it can't be read."""
    targets: dict[str, str] = {}
    for kind, name, attrs in events(parts.text("xl/_rels/workbook.xml.rels") or ""):
        if kind in ("open", "empty") and local(name) == "Relationship":
            key, target = attribute(attrs, "Id"), attribute(attrs, "Target")
            if key is not None and target is not None:
                targets.setdefault(key, target)
    found: list[tuple[str, str]] = []
    for kind, name, attrs in events(parts.text("xl/workbook.xml") or ""):
        if kind in ("open", "empty") and local(name) == "sheet":
            n = len(found) + 1
            key = attribute(attrs, "r:id") or attribute(attrs, "id")
            target = targets.get(key or "", f"worksheets/sheet{n}.xml")
            found.append((attribute(attrs, "name") or f"Sheet {n}", target[1:] if target.startswith("/") else f"xl/{target.removeprefix('./')}"))
    found = [(n, p) for n, p in found if p in parts.info]
    if not found:
        names = sorted((p for p in parts.info if re.fullmatch(r"xl/worksheets/sheet.*\.xml", p)), key=number)
        found = [(f"Sheet {i}", p) for i, p in enumerate(names, 1)]
    return found[:MAX_PARTS]


def sheet_rows(xml: str, shared: list[str], out: Lines) -> None:
    row: list[str] = []
    held: list[str] = []
    form = ""
    value = inline = False
    for kind, name, attrs in events(xml):
        tag = local(name) if kind != "text" else ""
        if kind == "text":
            if value or (inline and form != "s"):
                held.append(name)
        elif tag == "v":
            value = kind == "open"
        elif tag == "t":
            inline = kind == "open"
        elif tag == "row" and kind != "empty":
            while kind == "close" and row and not row[-1]:
                row.pop()
            if kind == "close" and row:
                out.push(" | ".join(row))
            row = []
        elif tag == "c" and kind == "empty":
            row.append("")
        elif tag == "c" and kind == "open":
            form, held = attribute(attrs, "t") or "", []
        elif tag == "c":
            text = "".join(held)
            held = []
            if form == "s":
                at = text.strip()
                text = shared[int(at)] if at.isdigit() and int(at) < len(shared) else ""
            row.append(re.sub(r"[\r\n]", " ", text).strip())


def xlsx(parts: Parts) -> str:
    shared = runs(parts.text("xl/sharedStrings.xml") or "", "si")
    out = Lines()
    for name, part in sheet_parts(parts):
        xml = parts.text(part)
        if xml is not None:
            out.push(f"## {name}")
            sheet_rows(xml, shared, out)
            out.push("")
    if not out.rows:
        raise ValueError("no worksheet rows in this .xlsx")
    return out.text()


def pptx(parts: Parts) -> str:
    slides = sorted((p for p in parts.info if re.fullmatch(r"ppt/slides/slide.*\.xml", p)), key=number)[:MAX_PARTS]
    if not slides:
        raise ValueError("no slides in this .pptx")
    out = Lines()
    for i, part in enumerate(slides, 1):
        xml = parts.text(part)
        if xml is None:
            continue
        out.push(f"Slide {i}")
        flow(xml, out, {"br": "\n"})
        notes = parts.text(f"ppt/notesSlides/notesSlide{number(part)}.xml")
        if notes is not None:
            said = Lines()
            flow(notes, said, {"br": "\n"})
            body = [x for x in said.rows if x.strip() and not x.strip().isdecimal()]
            if body:
                out.push("Notes: " + " ".join(body))
        out.push("")
    return out.text()


def extract(extension: str, data: bytes) -> str:
    """Text of an office file, or ValueError."""
    try:
        parts = Parts(data)
    except (zipfile.BadZipFile, NotImplementedError, OSError) as e:
        raise ValueError(f"not a readable .{extension} file: {e}") from None
    text = {"docx": docx, "xlsx": xlsx, "pptx": pptx}[KIND_OF[extension]](parts)
    if not text.strip():
        raise ValueError(f"no text in this .{extension} file")
    return text
