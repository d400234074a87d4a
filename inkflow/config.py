"""Settings of a conversion, checked when they are made."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field

VERSION = "0.1.0"


class OptionError(ValueError):
    """A setting that cannot be used."""


# Spellings that the options accept.
CHARSETS = {"ja": "ShiftJIS", "ja-jp": "ShiftJIS", "zh": "GB18030", "zh-cn": "GB18030", "ko": "EUC-KR", "ko-kr": "EUC-KR"}
CHARSET_NAMES = {"ShiftJIS": "ja", "GB18030": "zh", "EUC-KR": "ko"}
CODECS = {"ShiftJIS": "windows-31j", "GB18030": "GB18030", "EUC-KR": "x-windows-949"}  # the JVM's names
DCT_METHODS = ("float", "ifast", "islow")
KERNELS = ("nearest-neighbor", "bilinear", "bicubic", "mitchell-netravali", "lanczos2", "lanczos3")
RATIO, QUALITY = 70, 90


def percent(text: str | int, default: int) -> int:
    """1 to 100; larger numbers are 100, smaller ones the default."""
    if not re.fullmatch(r"[+-]?[0-9]+", str(text)) or not -(2**63) <= int(text) < 2**63:
        raise OptionError(f"not a whole number: {text!r}")
    n = int(text)
    return 100 if n >= 100 else n if n > 0 else default


def parse_charsets(text: str) -> tuple[str, ...]:
    """Encodings in order; a spelling counts once. The last unknown token is the one named."""
    if not text:
        raise OptionError("no charset given")
    tokens = dict.fromkeys(text.lower().split(","))
    if bad := [t for t in tokens if t not in CHARSETS]:
        raise OptionError(f"unknown charset: {bad[-1]!r}")
    return tuple(CHARSETS[t] for t in tokens)


def format_charsets(encodings: tuple[str, ...]) -> str:
    if bad := [e for e in encodings if e not in CHARSET_NAMES]:
        raise OptionError(f"unknown encoding: {bad[0]!r}")
    return ",".join(dict.fromkeys(CHARSET_NAMES[e] for e in encodings))


def one_of(text: str, known: tuple[str, ...], what: str) -> str:
    if text not in known:
        raise OptionError(f"{what} {text!r} is not supported: {', '.join(known)}")
    return text


def is_local(path: str) -> bool:
    """Whether a path names no file system, or that of the machine."""
    return re.match(r"[A-Za-z][A-Za-z0-9+.-]+:/", path) is None or path.startswith("file:/")


def absolute(path: str) -> str:
    """The absolute local path, that of a file: URI too; URIs of other file systems stay."""
    return os.path.abspath(re.sub(r"^file:(//)?(?=/)", "", path)) if is_local(path) else path.rstrip("/")


def zip_name(path: str) -> str:
    return path if path.endswith(".zip") else path + ".zip"


def default_output(source: str) -> str:
    """<stem>_resize<ext> beside the source, then .zip where that isn't the ending."""
    folder, base = os.path.split(source)
    dot = base.rfind(".")
    stem, ext = (base[:dot], base[dot:]) if dot >= 0 else (base, "")
    return zip_name(os.path.join(folder, f"{stem}_resize{ext}"))


@dataclass(frozen=True)
class Jpeg:
    quality: int = QUALITY
    optimize: bool = False
    progressive: bool = False
    dct: str = "ifast"

    def __post_init__(self) -> None:
        one_of(self.dct, DCT_METHODS, "DCT method")


@dataclass(frozen=True)
class Config:
    """A conversion; source must exist, the final output name must not.

    Local paths are checked here; those of other file systems when a session is there, and the output's once more at the end.
    """

    source: str
    output: str = ""
    ratio: int = RATIO
    kernel: str = "lanczos3"
    charsets: tuple[str, ...] = ("ShiftJIS", "GB18030")
    password: str | None = None
    delete_source: bool = False
    jpeg: Jpeg = field(default_factory=Jpeg)
    show_time: bool = False
    debug: bool = False

    def __post_init__(self) -> None:
        one_of(self.kernel, KERNELS, "interpolation")
        source = absolute(self.source)
        if is_local(source) and not os.path.exists(source):
            raise OptionError(f"{source} does not exist")
        output = zip_name(absolute(self.output)) if self.output else default_output(source)
        if is_local(output) and os.path.exists(output):
            raise OptionError(f"{output} exists")
        object.__setattr__(self, "source", source)
        object.__setattr__(self, "output", output)
        object.__setattr__(self, "ratio", percent(self.ratio, RATIO))
