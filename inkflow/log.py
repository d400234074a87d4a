"""The package's log: up to INFO on standard output, warnings and worse on standard error."""

from __future__ import annotations

import logging
import sys


def set_up(debug: bool = False) -> logging.Logger:
    log = logging.getLogger("inkflow")
    log.setLevel(logging.DEBUG if debug else logging.INFO)
    log.propagate = True
    for handler in [h for h in log.handlers if getattr(h, "of_inkflow", False)]:
        log.removeHandler(handler)
    low, high = logging.StreamHandler(sys.stdout), logging.StreamHandler(sys.stderr)
    low.addFilter(lambda record: record.levelno < logging.WARNING)
    high.setLevel(logging.WARNING)
    for handler in (low, high):
        handler.of_inkflow = True
        handler.setFormatter(logging.Formatter("%(levelname)s %(message)s"))
        log.addHandler(handler)
    return log
