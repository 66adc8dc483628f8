"""Sizes of pictures, from the headers of their files."""

from __future__ import annotations

import struct


def natural_size(data: bytes) -> tuple[int, int] | None:
    """Width and height in pixels of a PNG, GIF, BMP, JPEG or WebP; None for anything else."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return struct.unpack("<HH", data[6:10])
    if data[:2] == b"BM" and len(data) >= 26:
        width, height = struct.unpack("<ii", data[18:26])
        return abs(width), abs(height)
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return _webp(data)
    return _jpeg(data) if data[:2] == b"\xff\xd8" else None


def _webp(data: bytes) -> tuple[int, int] | None:
    kind = data[12:16]
    if kind == b"VP8X" and len(data) >= 30:
        return 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
    if kind == b"VP8L" and len(data) >= 25:
        bits = int.from_bytes(data[21:25], "little")
        return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
    if kind == b"VP8 " and len(data) >= 30:
        width, height = struct.unpack("<HH", data[26:30])
        return width & 0x3FFF, height & 0x3FFF
    return None


def _jpeg(data: bytes) -> tuple[int, int] | None:
    at = 2
    while at + 9 <= len(data):
        if data[at] != 0xFF:
            at += 1
            continue
        marker = data[at + 1]
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return width, height
        if marker == 0xFF or 0xD0 <= marker <= 0xD8 or marker == 0x01:
            at += 1 if marker == 0xFF else 2
            continue
        at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return None


def display_size(width: int | None, height: int | None, natural: tuple[int, int] | None) -> tuple[int, int] | None:
    """The size the HTML gives, an open side in proportion; else the natural one."""
    if width is not None and height is not None:
        return width, height
    if not natural or min(natural) <= 0:
        return None
    if width is not None:
        return width, int(width * natural[1] / natural[0] + 0.5)
    if height is not None:
        return int(height * natural[0] / natural[1] + 0.5), height
    return natural
