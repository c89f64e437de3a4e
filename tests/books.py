"""Small synthetic archives and fonts."""

import io
import struct
import zipfile
import zlib

from quiresmith.functions import raster, sfnt

CONTAINER = '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OPS/package.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'


def opf(items, spine=(), meta="", guide="", version="3.0"):
    rows = "".join(f'<item id="{i}" href="{h}" media-type="{m}"{p}/>' for i, h, m, p in items)
    refs = "".join(f'<itemref idref="{i}"/>' for i in spine)
    return f'<?xml version="1.0" encoding="utf-8"?><package xmlns="http://www.idpf.org/2007/opf" version="{version}"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>T</dc:title>{meta}</metadata><manifest>{rows}</manifest><spine toc="ncx">{refs}</spine>{guide}</package>'


def epub(members, first=True):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        if first:
            z.writestr("mimetype", "application/epub+zip")
        z.writestr("META-INF/container.xml", CONTAINER)
        for name, data in members:
            z.writestr(name, data)
        if not first:
            z.writestr("mimetype", "application/epub+zip", zipfile.ZIP_DEFLATED)
    return out.getvalue()


def png(width=2, height=2):
    return raster.write_png(width, height, b"\x10\x20\x30" * (width * height))


def webp():
    body = b"VP8X" + struct.pack("<I", 10) + bytes([16, 0, 0, 0]) + (1).to_bytes(3, "little") + (1).to_bytes(3, "little")
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"WEBP" + body


def font(chars, family="Fam"):
    text = family.encode("utf-16-be")
    name = struct.pack(">HHH", 0, 1, 18) + struct.pack(">HHHHHH", 3, 1, 0x409, 1, len(text), 0) + text
    return sfnt.assemble(b"\0\1\0\0", {b"cmap": sfnt.write_cmap({ord(c): i + 1 for i, c in enumerate(chars)}), b"name": name, b"head": b"\0" * 54, b"glyf": b"\1" * 10})


XHTML = '<html xmlns="http://www.w3.org/1999/xhtml"><head><title>t</title>{head}</head><body>{body}</body></html>'


def xhtml(body, head=""):
    return XHTML.format(body=body, head=head)


def woff(data):
    flavor, parts = sfnt.tables(data)
    at, entries, body = 44 + 20 * len(parts), b"", b""
    for tag, raw in sorted(parts.items()):
        packed = zlib.compress(raw)
        packed = packed if len(packed) < len(raw) else raw
        entries += struct.pack(">4sIIII", tag, at, len(packed), len(raw), 0)
        body += packed + b"\0" * (-len(packed) % 4)
        at += len(packed) + -len(packed) % 4
    head = struct.pack(">4s4sIHHI", b"wOFF", flavor, at, len(parts), 0, len(data)) + b"\0" * 24
    return head + entries + body
