"""Encoders of straight-alpha RGBA rasters (height x width x 4, uint8)."""

from __future__ import annotations

import struct
import zlib

import numpy as np

FORMATS = ("png", "jpeg", "jpg", "tiff", "bmp", "pdf")


def unpremultiply(pixels: np.ndarray) -> np.ndarray:
    """Straight alpha from premultiplied; fully transparent pixels are zero."""
    a = pixels[..., 3:].astype(np.uint32)
    rgb = np.where(a > 0, np.minimum((pixels[..., :3].astype(np.uint32) * 255 + a // 2) // np.maximum(a, 1), 255), 0)
    return np.concatenate([rgb, a], axis=-1).astype(np.uint8)


def flatten(pixels: np.ndarray, background: tuple[int, int, int] = (255, 255, 255)) -> np.ndarray:
    """RGB over a background."""
    a = pixels[..., 3:].astype(np.uint32)
    return ((pixels[..., :3].astype(np.uint32) * a + np.array(background, dtype=np.uint32) * (255 - a) + 127) // 255).astype(np.uint8)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(pixels: np.ndarray, dpi: float) -> bytes:
    h, w = pixels.shape[:2]
    rows = np.concatenate([np.zeros((h, 1), np.uint8), pixels.reshape(h, w * 4)], axis=1)
    per_metre = round(dpi / 0.0254)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + _chunk(b"pHYs", struct.pack(">IIB", per_metre, per_metre, 1)) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + _chunk(b"IEND", b"")


def bmp(pixels: np.ndarray) -> bytes:
    h, w = pixels.shape[:2]
    rgb = flatten(pixels)[::-1, :, ::-1].reshape(h, w * 3)
    rows = np.pad(rgb, ((0, 0), (0, -w * 3 % 4))).tobytes()
    return b"BM" + struct.pack("<IHHI", 54 + len(rows), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(rows), 2835, 2835, 0, 0) + rows


def tiff(pixels: np.ndarray) -> bytes:
    h, w = pixels.shape[:2]
    data = pixels.tobytes()
    tags = [(256, 4, 1, w), (257, 4, 1, h), (258, 3, 4, 8), (259, 3, 1, 1), (262, 3, 1, 2), (273, 4, 1, 0), (277, 3, 1, 4), (278, 4, 1, h), (279, 4, 1, len(data)), (338, 3, 1, 2)]
    extra = 8 + 2 + 12 * len(tags) + 4
    values = {258: extra, 273: extra + 8}
    body = b"".join(struct.pack("<HHII", t, k, n, values.get(t, v)) for t, k, n, v in tags)
    return b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(tags)) + body + struct.pack("<I", 0) + struct.pack("<4H", 8, 8, 8, 8) + data


def pdf(pixels: np.ndarray, dpi: float) -> bytes:
    """One page that the image fills at ``dpi``."""
    h, w = pixels.shape[:2]
    image = zlib.compress(flatten(pixels).tobytes(), 6)
    x, y = w / dpi * 72, h / dpi * 72
    draw = f"q {x:.4f} 0 0 {y:.4f} 0 0 cm /I Do Q".encode()
    objects = [
        b"<< /Type /Catalog /Pages 2 0 R >>",
        b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>",
        f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {x:.4f} {y:.4f}] /Resources << /XObject << /I 4 0 R >> >> /Contents 5 0 R >>".encode(),
        f"<< /Type /XObject /Subtype /Image /Width {w} /Height {h} /ColorSpace /DeviceRGB /BitsPerComponent 8 /Filter /FlateDecode /Length {len(image)} >>\nstream\n".encode() + image + b"\nendstream",
        f"<< /Length {len(draw)} >>\nstream\n".encode() + draw + b"\nendstream",
    ]
    out, places = b"%PDF-1.4\n", []
    for k, body in enumerate(objects, 1):
        places.append(len(out))
        out += f"{k} 0 obj\n".encode() + body + b"\nendobj\n"
    table = f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n" + "".join(f"{p:010d} 00000 n \n" for p in places)
    return out + table.encode() + f"trailer\n<< /Size {len(objects) + 1} /Root 1 0 R >>\nstartxref\n{len(out)}\n%%EOF\n".encode()


# The standard quantisation tables and Huffman code lengths and symbols of baseline JPEG.
_LUMA = "16 11 10 16 24 40 51 61 12 12 14 19 26 58 60 55 14 13 16 24 40 57 69 56 14 17 22 29 51 87 80 62 18 22 37 56 68 109 103 77 24 35 55 64 81 104 113 92 49 64 78 87 103 121 120 101 72 92 95 98 112 100 103 99"
_DC_LENGTHS, _DC_SYMBOLS = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]), bytes(range(12))


def _zigzag() -> list[int]:
    return [y * 8 + x for y, x in sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else -p[0]))]


def _even_codes() -> tuple[bytes, bytes]:
    """A valid table for all 256 run and size symbols: eight-bit codes for the first 254, longer ones for the last two."""
    symbols = sorted(range(256), key=lambda s: (s & 15) + (s >> 4))
    return bytes([0] * 7 + [254] + [2] + [0] * 7)[:16], bytes(symbols)


def _codes(lengths: bytes, symbols: bytes) -> dict[int, tuple[int, int]]:
    """Code and bits of each symbol."""
    out, code, at = {}, 0, 0
    for bits, n in enumerate(lengths, 1):
        for s in symbols[at : at + n]:
            out[s] = (code, bits)
            code += 1
        at += n
        code <<= 1
    return out


def _table(codes: dict[int, tuple[int, int]]) -> np.ndarray:
    """Codes and bits by symbol."""
    out = np.zeros((256, 2), dtype=np.int64)
    for symbol, found in codes.items():
        out[symbol] = found
    return out


_ZIGZAG = _zigzag()
_AC_LENGTHS, _AC_SYMBOLS = _even_codes()
_DC, _AC = _table(_codes(_DC_LENGTHS, _DC_SYMBOLS)), _table(_codes(_AC_LENGTHS, _AC_SYMBOLS))
_K = np.arange(8)
_BASIS = np.cos((2 * _K[None, :] + 1) * _K[:, None] * np.pi / 16) * np.where(_K[:, None] == 0, np.sqrt(1 / 8), 0.5)
_POWERS = 1 << np.arange(20)
_WORDS = 1 << 18  # codes written at a time


def _amounts(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of bits of each value, and these bits."""
    size = np.searchsorted(_POWERS, np.abs(v), side="right")
    return size, np.where(v >= 0, v, v + (1 << size) - 1)


def _entropy(blocks: np.ndarray) -> bytes:
    """The entropy-coded segment of ``blocks`` (blocks x 3 planes x 64 in zigzag order)."""
    n = len(blocks)
    blocks = blocks.reshape(n * 3, 64)
    steps = np.diff(blocks[:, 0].reshape(n, 3), axis=0, prepend=0).ravel()
    # A plane's block gives one code for its first value, one for each other value that is not 0, sixteen zeros as often as needed before, and an end.
    row, col = np.nonzero(blocks[:, 1:])
    before = np.concatenate(([-1], col[:-1]))
    if len(row):
        before[np.concatenate(([True], row[1:] != row[:-1]))] = -1
    zeros = (col - before[: len(col)] - 1) if len(row) else col
    size, low = _amounts(blocks[row, col + 1])
    first, first_low = _amounts(steps)
    ends = np.flatnonzero(blocks[:, 63] == 0)
    skips = np.repeat(np.arange(len(row)), zeros >> 4)
    symbol = ((zeros & 15) << 4) | size
    # Codes with their value's bits behind, ordered by block, place and kind.
    value = np.concatenate([(_DC[first, 0] << first) | first_low, np.full(len(skips), _AC[0xF0, 0]), (_AC[symbol, 0] << size) | low, np.full(len(ends), _AC[0, 0])])
    bits = np.concatenate([_DC[first, 1] + first, np.full(len(skips), _AC[0xF0, 1]), _AC[symbol, 1] + size, np.full(len(ends), _AC[0, 1])])
    place = np.concatenate([np.arange(n * 3) * 256, row[skips] * 256 + 2 * col[skips] + 1, row * 256 + 2 * col + 2, ends * 256 + 255])
    order = np.argsort(place, kind="stable")
    value, bits = value[order], bits[order]
    parts, rest = [], np.zeros(0, dtype=np.uint8)
    for at in range(0, len(value), _WORDS):
        v, b = value[at : at + _WORDS], bits[at : at + _WORDS]
        shift = np.repeat(np.cumsum(b), b) - 1 - np.arange(int(b.sum()))
        rest = np.concatenate([rest, ((np.repeat(v, b) >> shift) & 1).astype(np.uint8)])
        whole = len(rest) // 8 * 8
        parts.append(np.packbits(rest[:whole]).tobytes())
        rest = rest[whole:]
    if len(rest):
        parts.append(np.packbits(np.concatenate([rest, np.ones(8 - len(rest), dtype=np.uint8)])).tobytes())
    return b"".join(parts).replace(b"\xff", b"\xff\0")


def jpeg(pixels: np.ndarray, quality: int) -> bytes:
    """Baseline JPEG without chroma subsampling, on white."""
    quality = min(max(int(quality), 1), 100)
    factor = 5000 // quality if quality < 50 else 200 - 2 * quality
    q = np.clip((np.array(_LUMA.split(), dtype=int) * factor + 50) // 100, 1, 255)
    rgb = flatten(pixels).astype(np.float64)
    h, w = rgb.shape[:2]
    rgb = np.pad(rgb, ((0, -h % 8), (0, -w % 8), (0, 0)), mode="edge")
    r, g, b = rgb[..., 0], rgb[..., 1], rgb[..., 2]
    planes = [0.299 * r + 0.587 * g + 0.114 * b - 128, -0.168736 * r - 0.331264 * g + 0.5 * b, 0.5 * r - 0.418688 * g - 0.081312 * b]
    cells = np.stack(planes).reshape(3, rgb.shape[0] // 8, 8, rgb.shape[1] // 8, 8).transpose(1, 3, 0, 2, 4)
    freq = _BASIS @ cells @ _BASIS.T
    blocks = np.rint(freq.reshape(-1, 3, 64) / q)[..., _ZIGZAG].astype(np.int64)

    def segment(kind: int, body: bytes) -> bytes:
        return bytes([255, kind]) + struct.pack(">H", len(body) + 2) + body

    head = b"\xff\xd8" + segment(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0") + segment(0xDB, b"\0" + bytes(int(q[z]) for z in _ZIGZAG))
    head += segment(0xC0, struct.pack(">BHHB", 8, h, w, 3) + b"\x01\x11\0\x02\x11\0\x03\x11\0") + segment(0xC4, b"\0" + _DC_LENGTHS + _DC_SYMBOLS) + segment(0xC4, b"\x10" + _AC_LENGTHS + _AC_SYMBOLS)
    return head + segment(0xDA, b"\x03\x01\0\x02\0\x03\0\0?\0") + _entropy(blocks) + b"\xff\xd9"


def encode(pixels: np.ndarray, kind: str, quality: int = 92, dpi: float = 96.0) -> bytes:
    kind = kind.lower()
    if kind == "png":
        return png(pixels, dpi)
    if kind in ("jpeg", "jpg"):
        return jpeg(pixels, quality)
    if kind == "tiff":
        return tiff(pixels)
    if kind == "bmp":
        return bmp(pixels)
    if kind == "pdf":
        return pdf(pixels, dpi)
    raise ValueError(f"unsupported format {kind!r}; use one of {', '.join(FORMATS)}")
