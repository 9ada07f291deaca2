"""Level-gated log lines of fixed columns: time, level, component, message."""

from __future__ import annotations

import sys
import time
from typing import TextIO

LEVELS = {"debug": 0, "info": 1, "warn": 2, "error": 3}


def parse_level(name: str) -> int:
    """The level of a name in any case; unknown names count as info."""
    return LEVELS.get(name.strip().lower(), LEVELS["info"])


class Log:
    def __init__(self, component: str, level: str = "info", out: TextIO | None = None):
        self.component, self.least, self.out = component, parse_level(level), out or sys.stderr

    def write(self, level: str, message: str) -> bool:
        """Whether the line was written."""
        if parse_level(level) < self.least:
            return False
        self.out.write(f"{time.strftime('%Y-%m-%dT%H:%M:%SZ', time.gmtime())} {level.upper():<5} {self.component:<12} {message}\n")
        return True
