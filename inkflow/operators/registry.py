"""Plugins for picture formats: decoders by name, one encoder.

The built-in ones leave pixels to the JVM. A plugin that overrides decode (or encode) brings its own codec, which runs
in Arrow-batched Python on the rows of its format only.
"""

from __future__ import annotations

import struct
from abc import ABC, abstractmethod
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from inkflow.functions import magic


class UnsupportedImage(ValueError):
    """A format that is recognised but can't be decoded here."""


class RegistryError(RuntimeError):
    """A plugin that exists already, or one that is missing."""


class Decoder(ABC):
    """A format: its name, endings, first bytes, and its header's size."""

    name: str
    extensions: tuple[str, ...]
    magic: bytes

    def matched(self, content: Column) -> Column:
        return magic.matches(content, self.magic)

    def size_column(self, content: Column) -> Column | None:
        """struct<width, height> in functions of the JVM, where there are some; null or a size of 0 where the header is damaged."""
        return None

    @abstractmethod
    def size(self, content: bytes) -> tuple[int, int] | None:
        """(width, height) from the header; None if it is damaged."""

    #: Whether pictures of the format can be decoded; else they raise UnsupportedImage.
    decodable = True

    def decode(self, content: bytes) -> np.ndarray:
        """Rows, columns, (blue, green, red) as bytes. Formats that don't override this are decoded by the JVM."""
        raise UnsupportedImage(f"{self.name} is decoded by the JVM")

    def own_codec(self) -> bool:
        return type(self).decode is not Decoder.decode


class Encoder(ABC):
    """The output's format: name is its ending."""

    name: str

    def encode(self, image: np.ndarray, quality: int, progressive: bool, optimize: bool) -> bytes:
        """The bytes of a picture (rows, columns, (blue, green, red)). An encoder that doesn't override this writes JPEG by the JVM."""
        raise NotImplementedError

    def own_codec(self) -> bool:
        return type(self).encode is not Encoder.encode


class Jpeg(Decoder):
    name, extensions, magic = "jpeg", (".jpg", ".jpeg"), magic.JPEG

    def size_column(self, content: Column) -> Column:
        return F.call_function("inkflow_jpeg_size", content)

    def size(self, content: bytes) -> tuple[int, int] | None:
        at, end = 2, len(content)
        while at + 9 <= end:
            if content[at] != 0xFF:
                return None
            kind = content[at + 1]
            if kind == 0xFF:  # fill
                at += 1
            elif kind == 0x01 or 0xD0 <= kind <= 0xD8:  # no length follows
                at += 2
            elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):  # a frame header
                height, width = struct.unpack_from(">HH", content, at + 5)
                return (width, height) if width and height else None
            else:
                at += 2 + int.from_bytes(content[at + 2 : at + 4], "big")
        return None


class Png(Decoder):
    name, extensions, magic = "png", (".png",), magic.PNG

    def size_column(self, content: Column) -> Column:
        return magic.png_size(content)

    def size(self, content: bytes) -> tuple[int, int] | None:
        return struct.unpack_from(">II", content, 16) if len(content) >= 24 else None


class Bmp(Decoder):
    name, extensions, magic = "bmp", (".bmp",), magic.BMP

    def size_column(self, content: Column) -> Column:
        return magic.bmp_size(content)

    def size(self, content: bytes) -> tuple[int, int] | None:
        if len(content) < 26:
            return None
        width, height = struct.unpack_from("<ii", content, 18)
        return width, abs(height)


class Webp(Decoder):
    """Lossless pictures are decoded; lossy ones are recognised and measured only."""

    name, extensions, magic = "webp", (".webp",), magic.WEBP

    def size_column(self, content: Column) -> Column:
        return magic.webp_size(content)

    def size(self, content: bytes) -> tuple[int, int] | None:
        kind, body = content[12:16], content[20:]
        if kind == b"VP8 " and len(body) >= 10 and body[3:6] == b"\x9d\x01\x2a":
            width, height = struct.unpack_from("<HH", body, 6)
            return width & 0x3FFF, height & 0x3FFF
        if kind == b"VP8L" and len(body) >= 5 and body[0] == 0x2F:
            bits = int.from_bytes(body[1:5], "little")
            return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
        if kind == b"VP8X" and len(body) >= 10:
            return int.from_bytes(body[4:7], "little") + 1, int.from_bytes(body[7:10], "little") + 1
        return None


class JpegEncoder(Encoder):
    name = ".jpg"


class Registry:
    """Decoders in the order of their registration, and the encoder that was registered last."""

    def __init__(self) -> None:
        self.decoders: dict[str, Decoder] = {}
        self._encoder: Encoder | None = None

    def register_decoder(self, decoder: Decoder) -> None:
        name = decoder.name.lower().lstrip(".")
        if name in self.decoders:
            raise RegistryError(f"a decoder named {name} exists already")
        self.decoders[name] = decoder

    def register_encoder(self, encoder: Encoder) -> None:
        self._encoder = encoder

    @property
    def encoder(self) -> Encoder:
        if self._encoder is None:
            raise RegistryError("no encoder is registered")
        return self._encoder

    def supports(self, engine: Column) -> Column:
        """Whether a decoder of that name is registered and has a codec."""
        return F.coalesce(engine.isin(*(n for n, d in self.decoders.items() if d.decodable)), F.lit(False))

    def patterns(self) -> dict[str, bytes]:
        return {n: d.magic for n, d in self.decoders.items()}

    def extensions(self) -> list[str]:
        """All endings, decoder after decoder; one that two decoders name is listed twice."""
        return [e for d in self.decoders.values() for e in d.extensions]


@lru_cache(maxsize=1)
def default() -> Registry:
    found = Registry()
    for decoder in (Jpeg(), Bmp(), Png(), Webp()):
        found.register_decoder(decoder)
    found.register_encoder(JpegEncoder())
    return found
