"""What a PDF says, or shows if it is a scan.

``READERS`` are tried in order, the first that is there reads: each gives ``Pages``, or has none to give. A scan's picture comes from the
page itself if its stream can be taken as it is (``DECODERS``), else from poppler's renderer.
"""

from __future__ import annotations

import importlib.util
import shutil
import subprocess
import tempfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import Path
from typing import TYPE_CHECKING, Any

import numpy as np

if TYPE_CHECKING:
    from .extract import Blob

#: Pages whose text is read, and characters from which a PDF counts as text.
LEADING, ENOUGH = 3, 40


@dataclass
class Pages:
    text: str = ""
    title: str = ""
    number: int | None = None
    locked: bool = False
    pictures: Iterator[bytes] = field(default_factory=lambda: iter(()))

    @property
    def extent(self) -> str:
        if self.number is None:
            return "PDF"
        return "1 page" if self.number == 1 else f"{self.number} pages"

    @property
    def spoken(self) -> bool:
        return len(self.text.strip()) >= ENOUGH

    def titled(self) -> str:
        """The text, below the title unless it begins with it."""
        if not self.title or self.title.casefold() in self.text[:200].casefold():
            return self.text
        return f"Title: {self.title}\n{self.text}"


# Pictures


def chunk(tag: bytes, body: bytes) -> bytes:
    return len(body).to_bytes(4, "big") + tag + body + zlib.crc32(body, zlib.crc32(tag)).to_bytes(4, "big")


def png(width: int, height: int, raw: bytes, channels: int) -> bytes | None:
    """A PNG file of 8-bit grey (one channel) or RGB (three) pixels; none if there are too few."""
    if len(raw) < width * height * channels:
        return None
    rows = np.zeros((height, 1 + width * channels), np.uint8)  # each begins with its filter: 0, none
    rows[:, 1:] = np.frombuffer(raw, np.uint8, width * height * channels).reshape(height, -1)
    colour = {1: 0, 3: 2}[channels]
    header = width.to_bytes(4, "big") + height.to_bytes(4, "big") + bytes((8, colour, 0, 0, 0))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def _pixels(stream: Any) -> bytes | None:
    channels = {"/DeviceGray": 1, "/DeviceRGB": 3}.get(str(stream.get("/ColorSpace")))
    if channels is None or stream.get("/BitsPerComponent", 8) != 8:
        return None
    return png(stream["/Width"], stream["/Height"], stream.get_data(), channels)


#: How a picture's stream becomes a file, by its filters.
DECODERS: dict[tuple[str, ...], Callable[[Any], bytes | None]] = {("/DCTDecode",): lambda s: s._data, ("/FlateDecode", "/DCTDecode"): lambda s: s._data, ("/FlateDecode",): _pixels}


def _drawn(page: Any) -> Iterator[bytes]:
    """The pictures of a page that can be taken, largest first."""
    streams = [x.get_object() for x in page.get("/Resources", {}).get("/XObject", {}).values()]
    images = [s for s in streams if s.get("/Subtype") == "/Image"]
    for s in sorted(images, key=lambda s: -int(s.get("/Width", 0)) * int(s.get("/Height", 0)))[:1]:
        filters = s.get("/Filter", [])
        names = tuple(map(str, filters)) if isinstance(filters, list) else (str(filters),)
        take = DECODERS.get(names) or DECODERS.get(names[-1:] if names[-1:] == ("/DCTDecode",) else names)
        if take and (made := take(s)):
            yield made


# Readers


def _pypdf(f: Blob) -> Pages | None:
    if importlib.util.find_spec("pypdf") is None:
        return None
    from pypdf import PdfReader

    doc = PdfReader(f.stream())
    if doc.is_encrypted and not doc.decrypt(""):
        return Pages(locked=True)
    first = list(doc.pages[:LEADING])
    said = "\n".join(p.extract_text() or "" for p in first)
    title = (doc.metadata.title if doc.metadata else None) or ""
    return Pages(said, str(title).strip(), len(doc.pages), pictures=_drawn(first[0]) if first else iter(()))


def _pdftotext(f: Blob) -> Pages | None:
    if not shutil.which("pdftotext"):
        return None
    command = ["pdftotext", "-l", str(LEADING)]
    return Pages(f.on_disk(lambda path: subprocess.run([*command, path, "-"], capture_output=True, text=True, timeout=30).stdout))


READERS: dict[str, Callable[[Any], Pages | None]] = {"pypdf": _pypdf, "pdftotext": _pdftotext}


def support() -> str:
    """The name of the reader that will be used; empty without any."""
    there = {"pypdf": importlib.util.find_spec("pypdf") is not None, "pdftotext": shutil.which("pdftotext") is not None}
    return next((name for name in READERS if there[name]), "")


def pages(f: Blob) -> Pages:
    return next((found for read in READERS.values() if (found := read(f))), Pages())


def rendered(f: Blob, most: int) -> Iterator[bytes]:
    """The first page as poppler draws it."""
    if not shutil.which("pdftoppm"):
        return
    with tempfile.TemporaryDirectory() as d:
        command = ["pdftoppm", "-singlefile", "-png", "-r", "110", "-f", "1", "-l", "1"]
        f.on_disk(lambda path: subprocess.run([*command, path, f"{d}/page"], capture_output=True, timeout=60))
        for made in Path(d).glob("page.png"):
            yield made.read_bytes()[:most]
