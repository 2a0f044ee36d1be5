"""Zone transition tables and vectorised wall-clock conversion (numpy only).

A table holds every change of a zone's offset between SPAN[0] and SPAN[1], read
once per process from the zone database and stamped with that database's
version.  Values outside the span take the same rules one by one.
"""

from __future__ import annotations

import functools
import zoneinfo
from datetime import UTC, datetime, timedelta
from pathlib import Path

import numpy as np

SPAN = (1900, 2150)
_EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


@functools.cache
def database_version() -> str:
    """Version of the zone database in use; ``unknown`` if it carries none."""
    for d in zoneinfo.TZPATH:
        for name, take in (("tzdata.zi", lambda s: s.split("\n", 1)[0].split()[-1]), ("+VERSION", str.strip)):
            p = Path(d, name)
            if p.exists():
                return take(p.read_text())
    try:
        import tzdata

        return tzdata.IANA_VERSION
    except ImportError:
        return "unknown"


def _offset(zone: zoneinfo.ZoneInfo, second: int) -> int:
    return int((_EPOCH + timedelta(seconds=second)).astimezone(zone).utcoffset().total_seconds())


@functools.cache
def transitions(name: str) -> tuple[np.ndarray, np.ndarray] | None:
    """(starts, offsets): from starts[i] (UTC seconds) on, the zone is offsets[i] seconds ahead.  None for an unknown zone."""
    try:
        zone = zoneinfo.ZoneInfo(name)
    except (zoneinfo.ZoneInfoNotFoundError, ValueError, OSError):
        return None
    lo, hi = (int((datetime(y, 1, 1, tzinfo=UTC) - _EPOCH).total_seconds()) for y in SPAN)
    starts, offsets = [np.iinfo(np.int64).min // 2], [_offset(zone, lo)]
    at = lo
    while at < hi:  # offsets never change twice within a day
        nxt = min(at + 86_400 * 4, hi)
        o = _offset(zone, nxt)
        if o != offsets[-1]:
            a, b = at, nxt
            while b - a > 1:
                m = (a + b) // 2
                a, b = (m, b) if _offset(zone, m) == offsets[-1] else (a, m)
            starts.append(b)
            offsets.append(_offset(zone, b))
            at = b
        else:
            at = nxt
    return np.array(starts, dtype=np.int64), np.array(offsets, dtype=np.int64)


def wall_to_utc(name: str, wall: np.ndarray, first_moment: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """UTC seconds of wall-clock seconds in a zone, and whether each fixes exactly one instant.

    Times that a change skips or repeats are not fixed.  With ``first_moment``
    the wall time stands for the first instant at or after it, so a skipped
    midnight gives the moment of the change and a repeated one its first pass.
    Unknown zones fix nothing.
    """
    wall = np.asarray(wall, dtype=np.int64)
    tab = transitions(name)
    if tab is None:
        return np.zeros_like(wall), np.zeros(len(wall), dtype=bool)
    starts, offs = tab
    ends = np.append(starts[1:], np.iinfo(np.int64).max // 2)
    k0 = np.searchsorted(starts, wall, side="right") - 1
    hits = np.zeros(len(wall), dtype=np.int64)
    utc = np.full(len(wall), np.iinfo(np.int64).max, dtype=np.int64)
    after = np.full(len(wall), np.iinfo(np.int64).max, dtype=np.int64)
    for d in (-1, 0, 1):  # offsets stay within a day, changes are further apart
        k = np.clip(k0 + d, 0, len(starts) - 1)
        ok = (k == k0 + d) & (wall - offs[k] >= starts[k]) & (wall - offs[k] < ends[k])
        hits += ok
        utc = np.where(ok, np.minimum(utc, wall - offs[k]), utc)
        after = np.where((k == k0 + d) & (wall < starts[k] + offs[k]), np.minimum(after, starts[k]), after)
    if first_moment:
        return np.where(hits > 0, utc, after), (hits > 0) | (after < np.iinfo(np.int64).max)
    return utc, hits == 1
