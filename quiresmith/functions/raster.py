"""Image files: sizes and transparency by their headers, and a plain PNG writer."""

from __future__ import annotations

import struct
import zlib

#: Pixels of an image at most.
MAX_PIXELS = 40_000_000


def facts(data: bytes) -> dict | None:
    """format, width, height, has_alpha of an image; None if it is none that is known."""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            width, height, _, color = struct.unpack_from(">IIBB", data, 16)
            alpha = color in (4, 6) or b"tRNS" in data[33 : max(33, data.find(b"IDAT"))]
            return {"format": "PNG", "width": width, "height": height, "has_alpha": alpha}
        if data[:3] == b"\xff\xd8\xff":
            at = 2
            while at + 9 < len(data):
                if data[at] != 0xFF:
                    return None
                marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
                if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                    height, width = struct.unpack_from(">HH", data, at + 5)
                    return {"format": "JPEG", "width": width, "height": height, "has_alpha": False}
                at += 2 + size
        if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
            kind = data[12:16]
            if kind == b"VP8X":
                w, h = (int.from_bytes(data[a : a + 3], "little") + 1 for a in (24, 27))
                return {"format": "WEBP", "width": w, "height": h, "has_alpha": bool(data[20] & 16)}
            if kind == b"VP8L":
                bits = int.from_bytes(data[21:25], "little")
                return {"format": "WEBP", "width": (bits & 0x3FFF) + 1, "height": (bits >> 14 & 0x3FFF) + 1, "has_alpha": bool(bits >> 28 & 1)}
            if kind == b"VP8 ":
                w, h = struct.unpack_from("<HH", data, 26)
                return {"format": "WEBP", "width": w & 0x3FFF, "height": h & 0x3FFF, "has_alpha": False}
        if data[:4] == b"GIF8":
            w, h = struct.unpack_from("<HH", data, 6)
            return {"format": "GIF", "width": w, "height": h, "has_alpha": False}
        if data[:2] == b"BM":
            w, h = struct.unpack_from("<ii", data, 18)
            return {"format": "BMP", "width": w, "height": abs(h), "has_alpha": False}
    except struct.error:
        return None
    return None


def write_png(width: int, height: int, rgb: bytes) -> bytes:
    """An RGB image as PNG."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    lines = b"".join(b"\0" + rgb[3 * width * y : 3 * width * (y + 1)] for y in range(height))
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines, 9)) + chunk(b"IEND", b"")


def recompress_png(data: bytes) -> bytes:
    """A PNG with its pixel data deflated again as hard as can be, other chunks but the critical ones
    and transparency left out; lossless."""
    at, kept, pixels = 8, [], b""
    while at + 12 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if kind == b"IDAT":
            pixels += body
        elif kind in (b"IHDR", b"PLTE", b"tRNS"):
            kept.append((kind, body))
        at += 12 + size
    if not pixels:
        raise ValueError("no pixel data")
    kept += [(b"IDAT", zlib.compress(zlib.decompress(pixels), 9)), (b"IEND", b"")]
    out = b"\x89PNG\r\n\x1a\n"
    for kind, body in kept:
        out += struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return out
