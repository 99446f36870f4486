"""Time expressions of requests, resolved on the driver to epoch nanoseconds."""

from __future__ import annotations

import re
from datetime import datetime, timezone

SECOND = 10**9
# Duration units in nanoseconds.
UNITS = {"ns": 1, "us": 10**3, "µs": 10**3, "μs": 10**3, "ms": 10**6, "s": SECOND, "m": 60 * SECOND, "h": 3600 * SECOND}
LONG = {"d": 86_400 * SECOND, "w": 7 * 86_400 * SECOND}
_PART = re.compile(r"(\d+\.?\d*|\.\d+)(ns|us|µs|μs|ms|s|m|h)")
_RFC = re.compile(r"(\d{4})-(\d\d)-(\d\d)T(\d\d):(\d\d):(\d\d)(?:[.,](\d+))?(?:(Z)|([+-])(\d\d):(\d\d))\Z")


def duration(text: str) -> int | None:
    """Nanoseconds of ``15m``, ``1h30m``, ``1.5d``, ``2w``; None if it is none."""
    if text[-1:] in LONG and len(text) > 1:
        try:
            n = float(text[:-1])
        except ValueError:
            return None
        return int(n * LONG[text[-1]]) if n >= 0 and n == n and "_" not in text else None
    if text == "0":
        return 0
    at, total = 0, 0.0
    while at < len(text):
        m = _PART.match(text, at)
        if not m:
            return None
        total += float(m[1]) * UNITS[m[2]]
        at = m.end()
    return int(total) if text else None


def rfc3339(text: str) -> int | None:
    m = _RFC.match(text)
    if not m:
        return None
    try:
        whole = int(datetime(*map(int, m.groups()[:6]), tzinfo=timezone.utc).timestamp())
    except ValueError:
        return None
    shift = 0 if m[8] else (1 if m[9] == "+" else -1) * (int(m[10]) * 3600 + int(m[11]) * 60)
    return (whole - shift) * SECOND + int((m[7] or "0")[:9].ljust(9, "0"))


def parse_time(text: str, default: int, now: int) -> int:
    """``now``, ``-15m``, epoch seconds to nanoseconds by magnitude, RFC 3339; anything else is the default."""
    text = text.strip()
    if text == "now":
        return now
    if text.startswith("-") and (d := duration(text[1:])) is not None:
        return now - d
    if re.fullmatch(r"[+-]?\d+", text) and -(2**63) <= int(text) < 2**63:
        n = int(text)
        for least, factor in ((10**17, 1), (10**14, 10**3), (10**11, 10**6)):
            if n > least:
                return n * factor
        return n * SECOND
    found = rfc3339(text)
    return default if found is None else found


def query_range(start: str, end: str, now: int) -> tuple[int, int]:
    """A query's range; by default the last hour and a minute ahead."""
    return parse_time(start, now - 3600 * SECOND, now), parse_time(end, now + 60 * SECOND, now)


def export_range(start: str, end: str, now: int) -> tuple[int, int]:
    return parse_time(start, now - 3600 * SECOND, now), parse_time(end, now, now)
