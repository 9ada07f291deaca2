"""JSON values as the wire format writes them: sorted keys, numbers as 64-bit floats, and escapes of markup characters."""

from __future__ import annotations

import json
from typing import Any


def parse(text: str) -> Any:
    """The value of a JSON text; ValueError if it is none. Numbers become floats, NaN and infinities are no JSON."""

    def refuse(name: str) -> None:
        raise ValueError(f"{name} is no JSON number")

    return json.loads(text, parse_int=float, parse_constant=refuse)


def number(x: float) -> str:
    """Shortest digits that give the float again, in plain notation from 1e-6 up to 1e21."""
    if x == 0:
        return "-0" if str(x)[0] == "-" else "0"
    text = repr(x)
    mantissa, _, power = text.partition("e")
    sign = "-" if text[0] == "-" else ""
    whole, _, part = mantissa.lstrip("-").partition(".")
    part = "" if part == "0" else part
    point = len(whole) + int(power or 0)
    figures = (whole + part).lstrip("0")
    point -= len(whole + part) - len((whole + part).lstrip("0"))
    figures = figures.rstrip("0") or "0"
    if 1e-6 <= abs(x) < 1e21:
        if point <= 0:
            return f"{sign}0.{'0' * -point}{figures}"
        if point >= len(figures):
            return sign + figures + "0" * (point - len(figures))
        return f"{sign}{figures[:point]}.{figures[point:]}"
    power_ = point - 1
    return f"{sign}{figures[0]}{'.' + figures[1:] if len(figures) > 1 else ''}e{'-' if power_ < 0 else '+'}{abs(power_):02d}"


def text(s: str) -> str:
    out = json.dumps(s, ensure_ascii=False)
    for c in "<>&\u2028\u2029":
        if c in out:
            out = out.replace(c, f"\\u{ord(c):04x}")
    return out


def write(v: Any) -> str:
    if isinstance(v, dict):
        return "{" + ",".join(f"{text(k)}:{write(v[k])}" for k in sorted(v)) + "}"
    if isinstance(v, list):
        return "[" + ",".join(map(write, v)) + "]"
    if isinstance(v, str):
        return text(v)
    if isinstance(v, bool) or v is None:
        return json.dumps(v)
    return number(float(v))
