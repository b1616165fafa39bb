"""A page parser of PDF files without further libraries: text with its place, from flate-coded or plain content streams.

Reads objects wherever they stand (object streams included), pages in the order of the page tree, text operators with their
matrices, and fonts' ToUnicode maps. Encrypted files, other filters than flate and pictures of text give no blocks.
Lines that follow each other closely at one margin form a block, as a layout reader would have it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
REFERENCE = re.compile(rb"(\d+)\s+\d+\s+R")
TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/\[\]()<>]+|[-+]?\d*\.?\d+|[A-Za-z'\"][A-Za-z0-9*]*", re.S)
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
LIGATURES = str.maketrans({"ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl"})


class Document:
    """The objects of a file by number."""

    def __init__(self, data: bytes):
        if b"/Encrypt" in data:
            raise ValueError("the file is encrypted")
        if not data.lstrip()[:5].startswith(b"%PDF-"):
            raise ValueError("not a PDF file")
        self.objects = {int(m[1]): m[2] for m in OBJECT.finditer(data)}
        for body in list(self.objects.values()):
            if b"/ObjStm" in body[:400]:
                self._unpack(body)
        self.trailers = [m for m in re.findall(rb"trailer\s*(<<.*?>>)\s*startxref", data, re.S)] + [b for b in self.objects.values() if b"/XRef" in b[:400]]

    def _unpack(self, body: bytes) -> None:
        inner = self.stream(body)
        n, first = (int(self.number(body, key) or 0) for key in (b"N", b"First"))
        heads = list(map(int, inner[:first].split()[: 2 * n]))
        for i in range(n):
            end = heads[2 * i + 3] if i + 1 < n else len(inner) - first
            self.objects.setdefault(heads[2 * i], inner[first + heads[2 * i + 1] : first + end])

    @staticmethod
    def number(body: bytes, key: bytes) -> float | None:
        m = re.search(rb"/" + key + rb"\s+([-\d.]+)", body)
        return float(m[1]) if m else None

    def stream(self, body: bytes) -> bytes:
        m = STREAM.search(body)
        if not m:
            return b""
        if b"/FlateDecode" not in body[: m.start()]:
            return m[1] if b"/Filter" not in body[: m.start()] else b""
        out = zlib.decompressobj()
        try:
            return out.decompress(m[1])
        except zlib.error:
            return b""

    def value(self, body: bytes, key: bytes) -> bytes:
        """What a dictionary holds under a key: a referenced object's body, or the text up to the value's end."""
        m = re.search(rb"/" + key + rb"(?![A-Za-z])\s*(\d+\s+\d+\s+R|\[[^\]]*\]|<<.*|\((?:[^()\\]|\\.)*\)|<[0-9A-Fa-f]*>|/?[^\s/<>\[\]()]+)", body, re.S)
        if not m:
            return b""
        ref = REFERENCE.fullmatch(m[1].strip())
        return self.objects.get(int(ref[1]), b"") if ref else _balanced(m[1])

    def title(self) -> str | None:
        for t in self.trailers:
            found = self.value(self.value(t, b"Info"), b"Title")
            if found and (text := _string(found, None).strip()):
                return text
        return None

    def pages(self) -> list[tuple[bytes, bytes]]:
        """(page, inherited resources) in reading order."""
        root = next((b for b in self.objects.values() if re.search(rb"/Type\s*/Catalog", b)), b"")
        out: list[tuple[bytes, bytes]] = []
        seen: set[bytes] = set()

        def walk(node: bytes, resources: bytes, box: bytes) -> None:
            if node in seen:
                return
            seen.add(node)
            resources = self.value(node, b"Resources") or resources
            box = self.value(node, b"MediaBox") or box
            kids = self.value(node, b"Kids")
            if kids:
                for ref in REFERENCE.findall(kids):
                    walk(self.objects.get(int(ref), b""), resources, box)
            elif node:
                out.append((node + b" /MediaBox " + box, resources))

        walk(self.value(root, b"Pages"), b"", b"[0 0 612 792]")
        return out or [(b, b"") for b in self.objects.values() if re.search(rb"/Type\s*/Page\b", b)]

    def contents(self, page: bytes) -> bytes:
        m = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", page)
        return b"\n".join(self.stream(self.objects.get(int(r), b"")) for r in REFERENCE.findall(m[1])) if m else b""

    def fonts(self, resources: bytes) -> dict[bytes, dict[int, str] | None]:
        table = self.value(resources, b"Font")
        out = {}
        for name, ref in re.findall(rb"(/[^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", table):
            font = self.objects.get(int(ref), b"")
            out[name] = _unicode_map(self.stream(self.value(font, b"ToUnicode"))) if b"/ToUnicode" in font else None
        return out


def _balanced(text: bytes) -> bytes:
    if not text.startswith(b"<<"):
        return text
    depth = 0
    for m in re.finditer(rb"<<|>>", text):
        depth += 1 if m[0] == b"<<" else -1
        if not depth:
            return text[: m.end()]
    return text


def _raw(token: bytes) -> bytes:
    if token.startswith(b"<"):
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    return re.sub(rb"\\(\d{1,3}|\r?\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else b"" if m[1] in (b"\n", b"\r\n") else ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.S)


def _string(token: bytes, mapped: dict[int, str] | None) -> str:
    raw = _raw(token)
    if raw.startswith(b"\xfe\xff"):
        return raw[2:].decode("utf-16-be", "replace")
    if mapped:
        wide = max(mapped) > 255 or token.startswith(b"<") and len(raw) % 2 == 0
        codes = [int.from_bytes(raw[i : i + 2], "big") for i in range(0, len(raw), 2)] if wide else list(raw)
        return "".join(mapped.get(c, "") for c in codes).translate(LIGATURES)
    return raw.decode("cp1252", "replace").translate(LIGATURES)


def _unicode_map(cmap: bytes) -> dict[int, str]:
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    out: dict[int, str] = {}
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        out |= {int(a, 16): text(b) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block)}
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for a, b, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            first = text(to)
            out |= {c: first[:-1] + chr(ord(first[-1]) + c - int(a, 16)) for c in range(int(a, 16), int(b, 16) + 1)}
    return out


def _lines(content: bytes, fonts: dict) -> Iterator[tuple[float, float, float, str]]:
    """(x, y, size, text) of what is shown, y from the page's bottom."""
    stack: list = []
    x = y = line_x = line_y = lead = 0.0
    size, scale, font, in_array, parts = 12.0, 1.0, None, False, []

    def show(text: str) -> tuple[float, float, float, str]:
        return x, y, abs(size * scale) or 12.0, text

    for m in TOKEN.finditer(content):
        t = m[0]
        if t == b"[":
            in_array, parts = True, []
        elif t == b"]":
            in_array = False
            stack.append(parts)
        elif t[:1] in b"(</" or t[:1] in b"-+.0123456789":
            item = t if t[:1] in b"(</" else float(t)
            (parts if in_array else stack).append(item)
        else:
            try:
                if t == b"BT":
                    x = y = line_x = line_y = 0.0
                elif t == b"Tf":
                    font, size = fonts.get(stack[-2]), stack[-1]
                elif t == b"TL":
                    lead = stack[-1]
                elif t in (b"Td", b"TD"):
                    line_x, line_y = line_x + stack[-2] * scale, line_y + stack[-1] * scale
                    x, y = line_x, line_y
                    lead = -stack[-1] if t == b"TD" else lead
                elif t == b"Tm":
                    scale = abs(stack[-3]) or 1.0
                    line_x, line_y = stack[-2], stack[-1]
                    x, y = line_x, line_y
                elif t == b"T*":
                    line_y -= lead * scale
                    x, y = line_x, line_y
                elif t in (b"'", b'"'):
                    line_y -= lead * scale
                    x, y = line_x, line_y
                    yield show(_string(stack[-1], font))
                elif t == b"Tj":
                    yield show(_string(stack[-1], font))
                elif t == b"TJ":
                    # A wide step between letters is a space.
                    yield show("".join(_string(p, font) if isinstance(p, bytes) else " " if p < -180 else "" for p in stack[-1]))
            except (IndexError, TypeError, ValueError):
                pass
            stack = []


def parse(content: bytes) -> Iterator[tuple]:
    """(page_num, page_width, page_height, block_no, x0, y0, x1, y1, text) of every block, y from the page's top."""
    doc = Document(content)
    for number, (page, resources) in enumerate(doc.pages(), 1):
        box = [float(v) for v in re.findall(rb"[-\d.]+", re.findall(rb"/MediaBox\s*\[([^\]]*)\]", page)[-1])[:4]] if b"/MediaBox" in page else [0, 0, 612, 792]
        width, height = box[2] - box[0], box[3] - box[1]
        rows: list[list] = []  # [x, top, size, text]
        for x, y, size, text in _lines(doc.contents(page), doc.fonts(resources)):
            top = height - (y - box[1]) - size
            if rows and abs(rows[-1][1] - top) < 0.3 * size and x >= rows[-1][0]:
                gap = " " if not rows[-1][3].endswith(" ") and not text.startswith(" ") and x > rows[-1][0] else ""
                rows[-1][3] += gap + text
            elif text.strip():
                rows.append([x - box[0], top, size, text])
        blocks: list[list[list]] = []
        for row in rows:
            last = blocks[-1][-1] if blocks else None
            if last and 0 < row[1] - last[1] < 1.7 * last[2] and abs(row[0] - last[0]) < 4 * last[2]:
                blocks[-1].append(row)
            else:
                blocks.append([row])
        for k, block in enumerate(blocks):
            right = max(r[0] + 0.5 * r[2] * len(r[3]) for r in block)
            yield number, width, height, k, min(r[0] for r in block), block[0][1], min(right, width), block[-1][1] + block[-1][2], "\n".join(r[3].strip() for r in block)


def title_of(content: bytes) -> str | None:
    """The title a file's own data give it, null without one."""
    return Document(content).title()
