"""PDF pages as lists of paragraphs: by pymupdf where it is installed, else by a reduced reader.

The reduced reader follows the page tree of unencrypted files and shows the strings of plain and deflated
content streams; it knows no fonts' own encodings and no object streams."""

from __future__ import annotations

import re
import zlib


class Unreadable(ValueError):
    pass


def pages(content: bytes) -> list[list[str]]:
    try:
        import pymupdf
    except ImportError:
        return plain_pages(content)
    try:
        file = pymupdf.open(stream=content, filetype="pdf")
    except Exception as error:
        raise Unreadable(f"cannot open the PDF: {error}") from error
    if file.needs_pass:
        raise Unreadable("the PDF has a password")
    found = [[" ".join(b[4].split()) for b in page.get_text("blocks") if b[6] == 0] for page in file]
    return [[p for p in page if p] for page in found]


_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _literal(raw: bytes) -> str:
    def put(m: re.Match) -> bytes:
        x = m[1]
        return bytes([int(x, 8) & 255]) if x.isdigit() else b"" if x in (b"\n", b"\r\n") else _ESCAPES.get(x, x)

    raw = re.sub(rb"\\([0-7]{1,3}|\r\n|.|\n)", put, raw, flags=re.S)
    return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("cp1252", "replace")


_STRING = rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>"
_SHOWN = re.compile(rb"(?P<array>\[(?:" + _STRING + rb"|[^\]()<])*\])\s*TJ|(?P<one>" + _STRING + rb")\s*(?:Tj|'|\")|(?P<move>\bT\*|\bTD\b|\bTd\b|\bTm\b|\bET\b)", re.S)


def _shown(data: bytes) -> list[str]:
    lines: list[str] = [""]
    for m in _SHOWN.finditer(data):
        if m["move"]:
            lines.append("")
            continue
        for s in re.findall(_STRING, m["array"] or m["one"], re.S):
            if s[:1] == b"(":
                lines[-1] += _literal(s[1:-1])
            else:
                digits = re.sub(rb"\s", b"", s[1:-1])
                lines[-1] += bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()).decode("cp1252", "replace")
    return [x for x in (" ".join(line.split()) for line in lines) if x]


def plain_pages(content: bytes) -> list[list[str]]:
    if not content.lstrip().startswith(b"%PDF"):
        raise Unreadable("not a PDF")
    if re.search(rb"/Encrypt\b", content):
        raise Unreadable("the PDF has a password")
    objects = {int(m[1]): m[2] for m in re.finditer(rb"(?<!\d)(\d+)\s+\d+\s+obj\b(.*?)\bendobj", content, re.S)}
    kids = {n: [int(k) for k in re.findall(rb"(\d+)\s+\d+\s+R", m[1])] for n, body in objects.items() if (m := re.search(rb"/Kids\s*\[(.*?)\]", body, re.S))}
    children = {k for own in kids.values() for k in own}
    order: list[int] = []
    todo = [n for n in kids if n not in children]
    while todo:
        n = todo.pop(0)
        if n in kids:
            todo = kids[n] + todo
        elif n in objects and n not in order:
            order.append(n)
    if not order:
        raise Unreadable("no pages found")
    out = []
    for n in order:
        m = re.search(rb"/Contents\s*(\[.*?\]|\d+\s+\d+\s+R)", objects[n], re.S)
        lines: list[str] = []
        for key in re.findall(rb"(\d+)\s+\d+\s+R", m[1]) if m else []:
            body = objects.get(int(key), b"")
            stream = re.search(rb"stream\r?\n(.*?)\r?\n?endstream", body, re.S)
            if stream:
                data = stream[1]
                if b"/FlateDecode" in body[: stream.start()]:
                    data = zlib.decompressobj().decompress(data)
                lines += _shown(data)
        out.append(lines)
    return out
