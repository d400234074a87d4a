"""python -m inkflow [options] (zip file, rar file or folder)"""

from __future__ import annotations

import argparse
import sys

from inkflow import config as settings
from inkflow.log import set_up
from inkflow.operators.registry import RegistryError
from inkflow.plans import conversion
from inkflow.session import local_session


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="inkflow", description="Resizes the pictures of an archive or folder into a new zip.")
    p.add_argument("source")
    p.add_argument("--charset", nargs="?", const="ja,zh", default="ja,zh", help="encodings of member names, in the order they are tried")
    p.add_argument("--delete-org", action="store_true", help="delete the source afterwards")
    p.add_argument("--pwd", help="password of the source")
    p.add_argument("-o", "--out", default="", help="output file; by default the source's name with _resize")
    p.add_argument("-r", "--ratio", default="70", help="per cent; 70 fits to a width of 1280")
    p.add_argument("-q", "--quality", default="90", help="per cent")
    p.add_argument("--resize-mode", default="lanczos3", choices=settings.KERNELS)
    p.add_argument("--optimizer", action="store_true", help="optimise entropy coding")
    p.add_argument("--progressive", action="store_true", help="write progressive JPEG")
    p.add_argument("--dct", default="ifast", choices=settings.DCT_METHODS, help="checked only: the encoder has one method")
    p.add_argument("--show-time", action="store_true")
    p.add_argument("--debug", action="store_true")
    p.add_argument("--version", action="version", version=settings.VERSION)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    log = set_up(a.debug)
    try:
        config = settings.Config(
            source=a.source, output=a.out, ratio=settings.percent(a.ratio, settings.RATIO), kernel=a.resize_mode, charsets=settings.parse_charsets(a.charset), password=a.pwd, delete_source=a.delete_org,
            jpeg=settings.Jpeg(settings.percent(a.quality, settings.QUALITY), a.optimizer, a.progressive, a.dct), show_time=a.show_time, debug=a.debug,
        )
        conversion.run(local_session(), config)
    except RegistryError as error:  # a mistake in plugins, not in the input
        log.critical("%s", error)
        return 111
    except Exception as error:
        log.error("%s", error)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
