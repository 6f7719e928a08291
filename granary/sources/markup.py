"""Events of XML and HTML text, entities and attributes. Lenient: a broken tag ends the document."""

from __future__ import annotations

import re
from collections.abc import Iterator

#: Named entities that documents use.
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "ensp": " ", "emsp": " ", "thinsp": " ",
    "mdash": "—", "ndash": "–", "hellip": "…", "rsquo": "’", "rsquor": "’", "lsquo": "‘", "ldquo": "“", "rdquo": "”",
    "bull": "•", "middot": "·", "copy": "©", "reg": "®", "trade": "™", "deg": "°", "euro": "€", "pound": "£",
    "times": "×", "laquo": "«", "raquo": "»", "shy": "", "zwj": "", "zwnj": "",
}
_TAG_REST = re.compile(r"""[^"'>]*(?:(?:"[^"]*"|'[^']*')[^"'>]*)*>""")
_ATTR = re.compile(r"""\s*=\s*(?:"([^"]*)"|'([^']*)')""")


def _char(name: str) -> str | None:
    if not name.startswith("#"):
        return ENTITIES.get(name)
    digits, base = (name[2:], 16) if name[1:2] in ("x", "X") else (name[1:], 10)
    try:
        code = int(digits, base) if digits.isalnum() else -1
    except ValueError:
        return None
    return chr(code) if 0 <= code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF else None


def decode(text: str) -> str:
    """Entities as characters. One that is unknown, or whose semicolon is not within 12 bytes, stays."""
    if "&" not in text:
        return text
    out, at = [], 0
    while (amp := text.find("&", at)) >= 0:
        out.append(text[at:amp])
        near = text[amp : amp + 12].encode("utf-8", "surrogatepass")[:12].decode("utf-8", "ignore")
        end = near.find(";")
        if end < 0:
            out.append("&")
            at = amp + 1
            continue
        char = _char(near[1:end])
        out.append(near[: end + 1] if char is None else char)
        at = amp + end + 1
    return "".join(out) + text[at:]


def attribute(attrs: str, name: str) -> str | None:
    """A quoted attribute; reading stops at the first that is not quoted."""
    at = 0
    while (eq := attrs.find("=", at)) >= 0:
        key = attrs[at:eq].strip().lstrip("/ \t\r\n")
        found = _ATTR.match(attrs, eq)
        if not found:
            return None
        if key == name:
            return decode(found[1] if found[1] is not None else found[2])
        at = found.end()
    return None


def events(text: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes); kinds: open, empty, close, text."""
    at, n = 0, len(text)
    while at < n:
        lt = text.find("<", at)
        plain = text[at : lt if lt >= 0 else n]
        if plain:
            yield "text", decode(plain), ""
        if lt < 0:
            return
        if text.startswith("<!--", lt):
            end = text.find("-->", lt + 4)
            at = end + 3 if end >= 0 else n
        elif text.startswith("<![CDATA[", lt):
            end = text.find("]]>", lt + 9)
            yield "text", text[lt + 9 : end if end >= 0 else n], ""
            at = end + 3 if end >= 0 else n
        elif text.startswith(("<?", "<!"), lt):
            end = text.find(">", lt)
            at = end + 1 if end >= 0 else n
        else:
            tag = _TAG_REST.match(text, lt + 1)
            if not tag:
                return
            inner, at = tag[0][:-1], tag.end()
            if inner.startswith("/"):
                yield "close", inner[1:].strip(), ""
                continue
            empty = inner.endswith("/")
            body = inner[:-1] if empty else inner
            name = re.split(r"[ \t\r\n]", body, maxsplit=1)[0]
            yield "empty" if empty else "open", name, body[len(name) :]


def local(name: str) -> str:
    return name.rsplit(":", 1)[-1]


class Lines:
    """Lines of text with at most one blank line between two, none at the start."""

    def __init__(self) -> None:
        self.rows: list[str] = []

    def push(self, line: str) -> None:
        line = line.rstrip()
        if line or (self.rows and self.rows[-1]):
            self.rows.append(line)

    def text(self) -> str:
        return "\n".join(self.rows).rstrip("\n")
