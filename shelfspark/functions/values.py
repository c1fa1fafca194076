"""Literal values of queries, read once on the driver."""

from __future__ import annotations

import re

_NUMBER = re.compile(r"[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?|inf|infinity|nan)", re.I)
_SCALE = {"k": 1e3, "m": 1e6, "g": 1e9}


def number(text: str) -> float | None:
    """1000, 2k, 1.5mb, 3g; None if it is no number."""
    t = text.strip().lower().rstrip("b")
    scale = _SCALE.get(t[-1:], 1.0)
    body = (t[:-1] if t[-1:] in _SCALE else t).strip()
    return float(body) * scale if _NUMBER.fullmatch(body) else None


def days_from_civil(year: int, month: int, day: int) -> int:
    """Days since 1970-01-01 in the proleptic Gregorian calendar; months and days beyond their range carry over."""
    y, m = (year - 1, month + 9) if month <= 2 else (year, month - 3)  # years from March
    return 365 * y + y // 4 - y // 100 + y // 400 + (153 * m + 2) // 5 + day - 1 - 719468


def date_range(text: str) -> tuple[float, float] | None:
    """[from, to) in seconds of a year, month or day; parts that are no numbers are left out."""
    parts = [int(p) for p in re.split(r"[-/:]", text) if re.fullmatch(r"[+-]?\d+", p)]
    if not parts:
        return None
    y = parts[0]
    if len(parts) == 1:
        lo, hi = days_from_civil(y, 1, 1), days_from_civil(y + 1, 1, 1)
    elif len(parts) == 2:
        lo = days_from_civil(y, parts[1], 1)
        hi = days_from_civil(y + 1, 1, 1) if parts[1] == 12 else days_from_civil(y, parts[1] + 1, 1)
    else:
        lo = days_from_civil(y, parts[1], parts[2])
        hi = lo + 1
    return lo * 86400.0, hi * 86400.0
