"""Texts in the headers of rasters: PNG chunks, JPEG and GIF comments, EXIF directories."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .surfaces import PAYLOAD

#: EXIF's tags of further directories; sizes of its types; chunks that hold no text.
DIRECTORIES = (0x8769, 0x8825, 0xA005)
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
PIXELS = (b"IHDR", b"IDAT", b"IEND", b"PLTE")
NUMBERS = {3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}


def png_chunks(body: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = 8
    while at + 8 <= len(body):
        size, kind = struct.unpack(">I4s", body[at : at + 8])
        yield kind, body[at + 8 : at + 8 + size]
        if kind == b"IEND":
            return
        at += 12 + size


def _png(body: bytes) -> Iterator[tuple[str, bytes]]:
    for kind, data in png_chunks(body):
        key, _, value = data.partition(b"\0")
        text, raw = None, data
        try:
            if kind == b"tEXt":
                text = value
            elif kind == b"zTXt":
                text = raw = zlib.decompress(value[1:])
            elif kind == b"iTXt":
                rest = value[2:].split(b"\0", 2)[2]
                text = zlib.decompress(rest) if value[:1] == b"\1" else rest
        except (zlib.error, IndexError):
            pass
        name = kind.decode("latin-1")
        if text:
            yield f"img_meta:info:{key.decode('latin-1')}", text
            yield f"img_meta:png_text:{key.decode('latin-1')}", text
        if kind not in PIXELS:
            yield f"img_chunk:{name}{':raw' if kind == b'zTXt' and text is None else ''}", raw
        if kind == b"eXIf":
            yield from exif(data)


def _jpeg(body: bytes) -> Iterator[tuple[str, bytes]]:
    at = 2
    while at + 4 <= len(body) and body[at] == 0xFF and body[at + 1] != 0xDA:
        kind, size = body[at + 1], struct.unpack(">H", body[at + 2 : at + 4])[0]
        data = body[at + 4 : at + 2 + size]
        if kind == 0xFE:
            yield "img_meta:info:comment", data
            yield "img_meta:jpeg_comment", data
        elif kind == 0xE1 and data[:6] == b"Exif\0\0":
            yield "img_meta:info:exif", data
            yield from exif(data[6:])
        at += 2 + max(2, size)


def _gif(body: bytes) -> Iterator[tuple[str, bytes]]:
    """Comments: what follows 21 FE, in blocks up to an empty one."""
    at = body.find(b"\x21\xfe")
    while at >= 0:
        at, text = at + 2, b""
        while at < len(body) and body[at]:
            text += body[at + 1 : at + 1 + body[at]]
            at += 1 + body[at]
        yield "img_meta:info:comment", text
        at = body.find(b"\x21\xfe", at)


def exif(tiff: bytes) -> list[tuple[str, bytes]]:
    """Entries of the first directory and of those it names, text as it stands, numbers as text; a broken one ends there."""
    out: list[tuple[str, bytes]] = []
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if not order or len(tiff) < 8:
        return out
    todo, known = [(struct.unpack(order + "I", tiff[4:8])[0], "exif")], set()
    while todo:
        start, name = todo.pop(0)
        if start in known or start + 2 > len(tiff):
            continue
        known.add(start)
        for k in range(struct.unpack(order + "H", tiff[start : start + 2])[0]):
            entry = tiff[start + 2 + 12 * k : start + 14 + 12 * k]
            if len(entry) < 12:
                break
            tag, kind, n = struct.unpack(order + "HHI", entry[:8])
            size = SIZES.get(kind, 0) * n
            here = struct.unpack(order + "I", entry[8:])[0]
            data = entry[8 : 8 + size] if size <= 4 else tiff[here : here + size]
            if tag in DIRECTORIES:
                todo.append((here, f"exif_ifd{tag:#x}"))
            if kind in NUMBERS and len(data) == size:
                data = " ".join(map(str, struct.unpack(f"{order}{n}{NUMBERS[kind]}", data))).encode()
            elif kind == 2:
                data = data.rstrip(b"\0")
            out.append((f"img_meta:{name}:{tag}", data))
    return out


def texts(body: bytes) -> list[tuple[str, bytes]]:
    """(name, bytes) of a raster's texts; none for other bodies."""
    if body[:8] == b"\x89PNG\r\n\x1a\n":
        return list(_png(body))
    if body[:2] == b"\xff\xd8":
        return list(_jpeg(body))
    return list(_gif(body)) if body[:4] == b"GIF8" else []


@F.pandas_udf(PAYLOAD)
def _texts(body: pd.Series) -> pd.Series:
    return pd.Series([None if b is None else [{"sub": s, "data": d} for s, d in texts(b)] for b in body], dtype=object)


def metadata_texts(body: Column) -> Column:
    """texts() of a binary column, as array<struct<sub, data>>."""
    return F.coalesce(_texts(body), F.array().cast("array<struct<sub:string,data:binary>>"))
