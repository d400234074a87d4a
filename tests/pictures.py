"""Pictures and archives made by hand."""

import struct
import zipfile
import zlib

import numpy as np


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def gradient(width: int, height: int) -> np.ndarray:
    y, x = np.mgrid[0:height, 0:width]
    return np.stack([x * 255 // max(width - 1, 1), y * 255 // max(height - 1, 1), (x + y) % 256], axis=2).astype(np.uint8)


def png(width: int, height: int, image: np.ndarray | None = None) -> bytes:
    image = gradient(width, height) if image is None else image
    rows = b"".join(b"\0" + r.tobytes() for r in image)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(rows)) + _chunk(b"IEND", b"")


def bmp(width: int, height: int) -> bytes:
    line = (width * 3 + 3) // 4 * 4
    body = b"".join(r[:, ::-1].tobytes().ljust(line, b"\0") for r in gradient(width, height)[::-1])
    return b"BM" + struct.pack("<IIIIiiHHIIiiII", 54 + len(body), 0, 54, 40, width, height, 1, 24, 0, len(body), 0, 0, 0, 0) + body


def archive(path, members: dict[str, bytes]) -> str:
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for name, content in members.items():
            out.writestr(name, content)
    return str(path)
