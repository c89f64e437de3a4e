"""Font files: the table directory, names, and the Unicode character map."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Mapping


class FontError(ValueError):
    pass


def unwrap(data: bytes) -> bytes:
    """A plain font file; WOFF is unpacked, WOFF 2 is not supported."""
    if data[:4] == b"wOF2":
        raise FontError("WOFF 2 needs a decoder that is not here")
    if data[:4] != b"wOFF":
        return data
    flavor, n = data[4:8], struct.unpack_from(">H", data, 12)[0]
    tables = {}
    for i in range(n):
        tag, at, packed, size, _ = struct.unpack_from(">4sIIII", data, 44 + 20 * i)
        raw = data[at : at + packed]
        tables[tag] = zlib.decompress(raw) if packed < size else raw
    return assemble(flavor, tables)


def tables(data: bytes) -> tuple[bytes, dict[bytes, bytes]]:
    data = unwrap(data)
    if data[:4] not in (b"\0\1\0\0", b"OTTO", b"true"):
        raise FontError("no font file")
    out = {}
    for i in range(struct.unpack_from(">H", data, 4)[0]):
        tag, _, at, size = struct.unpack_from(">4sIII", data, 12 + 16 * i)
        if at + size > len(data):
            raise FontError("a table leaves the file")
        out[tag] = data[at : at + size]
    return data[:4], out


def _sum(data: bytes) -> int:
    data += b"\0" * (-len(data) % 4)
    return sum(struct.unpack(f">{len(data) // 4}I", data)) & 0xFFFFFFFF


def assemble(flavor: bytes, parts: Mapping[bytes, bytes]) -> bytes:
    """A font file of tables, checksums and the head's adjustment computed anew."""
    parts = dict(parts)
    if len(parts.get(b"head", b"")) >= 12:
        parts[b"head"] = parts[b"head"][:8] + b"\0\0\0\0" + parts[b"head"][12:]
    n = len(parts)
    power = max(1, n).bit_length() - 1
    head = flavor + struct.pack(">HHHH", n, 16 << power, power, 16 * n - (16 << power))
    at, entries, body, head_at = 12 + 16 * n, b"", b"", None
    for tag in sorted(parts):
        raw = parts[tag]
        if tag == b"head":
            head_at = at
        entries += struct.pack(">4sIII", tag, _sum(raw), at, len(raw))
        body += raw + b"\0" * (-len(raw) % 4)
        at += len(raw) + -len(raw) % 4
    out = head + entries + body
    if head_at is not None and len(parts[b"head"]) >= 12:
        out = out[: head_at + 8] + struct.pack(">I", (0xB1B0AFBA - _sum(out)) & 0xFFFFFFFF) + out[head_at + 12 :]
    return out


def _subtables(cmap: bytes) -> list[tuple[int, int, int]]:
    n = struct.unpack_from(">H", cmap, 2)[0]
    return [struct.unpack_from(">HHI", cmap, 4 + 8 * i) for i in range(n)]


def _is_unicode(platform: int, encoding: int) -> bool:
    return platform == 0 or platform == 3 and encoding in (1, 10)


def read_cmap(data: bytes) -> dict[int, int]:
    """Code point to glyph number, of the widest Unicode subtable."""
    _, parts = tables(data)
    cmap = parts.get(b"cmap")
    if cmap is None:
        raise FontError("no character map")
    best: dict[int, int] = {}
    for platform, encoding, at in _subtables(cmap):
        if _is_unicode(platform, encoding):
            got = _read_subtable(cmap, at)
            if len(got) > len(best):
                best = got
    return best


def _read_subtable(cmap: bytes, at: int) -> dict[int, int]:
    kind = struct.unpack_from(">H", cmap, at)[0]
    out: dict[int, int] = {}
    if kind == 4:
        n = struct.unpack_from(">H", cmap, at + 6)[0] // 2
        ends, starts, deltas, offsets = (struct.unpack_from(f">{n}H", cmap, at + 14 + k * 2 * n + (2 if k else 0)) for k in range(4))
        base = at + 16 + 6 * n
        for i in range(n):
            for c in range(starts[i], ends[i] + 1):
                if c == 0xFFFF:
                    continue
                if offsets[i] == 0:
                    g = (c + deltas[i]) & 0xFFFF
                else:
                    g = struct.unpack_from(">H", cmap, base + 2 * i + offsets[i] + 2 * (c - starts[i]))[0]
                    g = (g + deltas[i]) & 0xFFFF if g else 0
                if g:
                    out[c] = g
    elif kind == 12:
        for i in range(struct.unpack_from(">I", cmap, at + 12)[0]):
            a, b, g = struct.unpack_from(">III", cmap, at + 16 + 12 * i)
            out.update({c: g + c - a for c in range(a, b + 1)})
    return out


def _runs(mapping: Mapping[int, int]) -> list[tuple[int, int, int]]:
    out: list[list[int]] = []
    for c in sorted(mapping):
        g = mapping[c]
        if out and c == out[-1][1] + 1 and g == out[-1][2] + c - out[-1][0]:
            out[-1][1] = c
        else:
            out.append([c, c, g])
    return [tuple(r) for r in out]


def write_cmap(mapping: Mapping[int, int]) -> bytes:
    """A character map with a format 4 subtable, and a format 12 one where code points need it."""
    low = _runs({c: g for c, g in mapping.items() if c < 0xFFFF}) + [(0xFFFF, 0xFFFF, 0)]
    n = len(low)
    power = n.bit_length() - 1
    four = struct.pack(">HHHH", 2 * n, 2 << power, power, 2 * n - (2 << power))
    four += b"".join(struct.pack(">H", r[1]) for r in low) + b"\0\0" + b"".join(struct.pack(">H", r[0]) for r in low)
    four += b"".join(struct.pack(">H", (r[2] - r[0]) & 0xFFFF if r[0] != 0xFFFF else 1) for r in low) + b"\0\0" * n
    four = struct.pack(">HHH", 4, len(four) + 6, 0) + four
    records = [(0, 3, four), (3, 1, four)]
    if any(c >= 0xFFFF for c in mapping):
        runs = _runs(mapping)
        twelve = struct.pack(">HHIII", 12, 0, 16 + 12 * len(runs), 0, len(runs)) + b"".join(struct.pack(">III", *r) for r in runs)
        records.append((3, 10, twelve))
    at, head, body, places = 4 + 8 * len(records), b"", b"", {}
    for platform, encoding, raw in records:
        if raw not in places:
            places[raw] = at + len(body)
            body += raw
        head += struct.pack(">HHI", platform, encoding, places[raw])
    return struct.pack(">HH", 0, len(records)) + head + body


def remap(data: bytes, moves: Mapping[int, int]) -> bytes:
    """The font with the glyph of each code point in ``moves`` under the code point it moves to."""
    flavor, parts = tables(data)
    old = read_cmap(data)
    new = {c: g for c, g in old.items() if c not in moves}
    new.update({moves[c]: old[c] for c in moves if c in old})
    return assemble(flavor, {**parts, b"cmap": write_cmap(new)})


def names(data: bytes) -> list[str]:
    """Family, full and PostScript names (and the typographic ones), in order, each once."""
    _, parts = tables(data)
    raw = parts.get(b"name", b"")
    if len(raw) < 6:
        return []
    _, n, base = struct.unpack_from(">HHH", raw)
    out = []
    for i in range(n):
        platform, encoding, _, kind, size, at = struct.unpack_from(">HHHHHH", raw, 6 + 12 * i)
        if kind in (1, 4, 6, 16):
            text = raw[base + at : base + at + size].decode("mac_roman" if platform == 1 else "utf-16-be", "replace").strip("\0 ")
            if text and text not in out:
                out.append(text)
    return out
