"""Durations as text and as microseconds."""

from __future__ import annotations

import re

# Units of a duration in microseconds, under today's and older names.
UNITS = {"w": 604_800_000_000, "d": 86_400_000_000, "h": 3_600_000_000, "min": 60_000_000, "t": 60_000_000, "m": 60_000_000, "s": 1_000_000, "ms": 1000, "l": 1000, "us": 1, "u": 1}
_PART = re.compile(r"\s*(\d*\.?\d+)?\s*([A-Za-z]+)")


def micros(text: str | int) -> int:
    """'3h', '1d12h', '20min', '30S' ... or microseconds themselves."""
    if isinstance(text, int):
        return text
    total, at = 0.0, 0
    while at < len(text.strip()):
        m = _PART.match(text, at)
        unit = m and UNITS.get(m[2] if m[2] in UNITS else m[2].lower())
        if not unit:
            raise ValueError(f"not a duration: {text!r}")
        total += float(m[1] or 1) * unit
        at = m.end()
    return int(total)


def readable(us: int, *, padded: bool = False) -> str:
    """1d2h3m4s; parts that are zero are left out, or all are two digits wide if padded."""
    out, rest = [], abs(int(us)) // 1_000_000
    for unit, size in (("d", 86_400), ("h", 3600), ("m", 60), ("s", 1)):
        n, rest = divmod(rest, size)
        if padded:
            out.append(f"{n:02d}{unit}")
        elif n:
            out.append(f"{n}{unit}")
    return ("-" if us < 0 else "") + ("".join(out) or "0s")


def function_name(fn) -> str:
    """Of a name, a function or a partial of one."""
    if isinstance(fn, str):
        return fn
    return getattr(fn, "__name__", None) or function_name(fn.func)
