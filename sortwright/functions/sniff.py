"""What a file is, from its first bytes: an ordered list of signatures, the first that fits wins."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (label, offset, signatures).
SIGNATURES = (
    ("pdf", 0, (b"%PDF",)),
    ("zip", 0, (b"PK\x03\x04", b"PK\x05\x06")),
    ("png", 0, (b"\x89PNG\r\n\x1a\n",)),
    ("jpeg", 0, (b"\xff\xd8\xff",)),
    ("gif", 0, (b"GIF87a", b"GIF89a")),
)
RIFF = {"webp": b"WEBP", "audio": b"WAVE", "video": b"AVI "}
HEIC = (b"heic", b"heix", b"mif1", b"msf1", b"hevc", b"avif")
AUDIO_BRANDS = (b"M4A ", b"M4B ", b"M4P ")
MORE = (
    ("audio", 0, (b"ID3", b"\xff\xfb", b"\xff\xf3", b"\xff\xf2", b"fLaC", b"OggS")),
    ("video", 0, (b"\x1a\x45\xdf\xa3",)),
    ("tar", 0, (b"\x1f\x8b", b"BZh", b"\xfd7zXZ\x00")),
    ("tar", 257, (b"ustar",)),
    ("archive", 0, (b"7z\xbc\xaf\x27\x1c", b"Rar!")),
    ("rtf", 0, (b"{\\rtf",)),
    ("sqlite", 0, (b"SQLite format 3\x00",)),
    ("windows-program", 0, (b"MZ",)),
    ("mac-program", 0, (b"\xcf\xfa\xed\xfe", b"\xce\xfa\xed\xfe", b"\xca\xfe\xba\xbe")),
    ("linux-program", 0, (b"\x7fELF",)),
    ("mac-installer", 0, (b"xar!",)),
    ("linux-package", 0, (b"!<arch>", b"\xed\xab\xee\xdb")),
    ("font", 0, (b"OTTO", b"\x00\x01\x00\x00", b"wOFF", b"wOF2", b"true")),
)
# How pages and messages begin.
HTML = r"(?is)\A\s*(<!doctype html|<html)"
MAIL_START = r"(?m)\A(Return-Path|Received|Delivered-To|MIME-Version|From|Message-ID):"
MAIL_HEAD = r"(?mi)^(Subject|Date):"


def _at(head: Column, offset: int, signature: bytes) -> Column:
    return F.substring(head, offset + 1, len(signature)) == F.lit(signature)


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def sniff(head: Column, name: Column | None = None, tail: Column | None = None) -> Column:
    """head: the first 8192 bytes; tail: the last 512, where disk images carry their mark."""
    rules: list[tuple[Column, str]] = [(_any([_at(head, o, s) for s in some]), label) for label, o, some in SIGNATURES]
    riff = {label: _at(head, 0, b"RIFF") & _at(head, 8, kind) for label, kind in RIFF.items()}
    boxed = _at(head, 4, b"ftyp")
    rules.append((riff["webp"], "webp"))
    rules.append((boxed & _any([_at(head, 8, b) for b in HEIC]), "heic"))
    rules.append((boxed & _any([_at(head, 8, b) for b in AUDIO_BRANDS]), "audio"))
    rules.append((boxed, "video"))
    for label, offset, some in MORE:
        test = _any([_at(head, offset, s) for s in some])
        rules.append((test | riff[label] if label in riff else test, label))
    if tail is not None:
        rules.append((_at(tail, 0, b"koly"), "mac-disk-image"))
    text = F.decode(head, "ISO-8859-1")
    rules.append((F.instr(F.substring(text, 1, 4096), "\0") > 0, "binary"))
    text = F.regexp_replace(text, "^(?:\u00ef\u00bb\u00bf)+", "")
    rules += text_rules(text, name)
    out = F.lit("text")
    for test, label in reversed(rules):
        out = F.when(test, F.lit(label)).otherwise(out)
    return out


def text_rules(text: Column, name: Column | None = None) -> list[tuple[Column, str]]:
    found = [(text.rlike(HTML), "html"), (text.rlike(MAIL_START) & text.rlike(MAIL_HEAD), "email")]
    if name is not None:
        found.append((F.lower(name).endswith(".ipynb") & text.rlike(r"\A\s*\{"), "notebook"))
    return found


def text_kind(text: Column) -> Column:
    """The text-only branches, for strings rather than files."""
    out = F.lit("text")
    for test, label in reversed(text_rules(F.substring(text, 1, 8192))):
        out = F.when(test, F.lit(label)).otherwise(out)
    return out


def label_of(head: bytes, name: str = "", tail: bytes = b"") -> str:
    """The same for one file's bytes, without Spark."""
    brand = head[8:12] if head[4:8] == b"ftyp" else None
    riff = next((label for label, kind in RIFF.items() if head[:4] == b"RIFF" and head[8:12] == kind), None)
    for label, at, signs in SIGNATURES:
        if head.startswith(signs, at):
            return label
    if riff == "webp":
        return riff
    if brand is not None:
        return "heic" if brand in HEIC else "audio" if brand in AUDIO_BRANDS else "video"
    for label, at, signs in MORE:
        if head.startswith(signs, at) or riff == label:
            return label
    if tail.startswith(b"koly"):
        return "mac-disk-image"
    text = head.decode("latin-1")
    if "\0" in text[:4096]:
        return "binary"
    text = re.sub("^(?:\u00ef\u00bb\u00bf)+", "", text)
    if re.search(HTML, text):
        return "html"
    if re.search(MAIL_START, text) and re.search(MAIL_HEAD, text):
        return "email"
    return "notebook" if name.lower().endswith(".ipynb") and text.lstrip().startswith("{") else "text"
