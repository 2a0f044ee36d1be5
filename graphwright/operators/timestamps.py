"""Timestamps of many spellings as one UTC instant.

Each text is reduced to its shape (digits to ``0`` one by one, runs of letters
to ``a``), each distinct shape is mapped once to a parser, and all values of a
parser are converted together, through zone transition tables where a
wall-clock time needs one.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphwright.functions import zones
from graphwright.functions.text import source_of

# Minutes ahead of UTC of zone abbreviations in common use.
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "UT": 0, "Z": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "NPT": 345, "HKT": 480, "SGT": 480, "AWST": 480, "JST": 540, "KST": 540, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
    "NST": -210, "NDT": -150, "AST": -240, "ADT": -180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
    "AKST": -540, "AKDT": -480, "HST": -600,
}
# Abbreviations that several countries share; the home zone decides.
SHARED = {("IST", "Asia/Kolkata"): 330, ("IST", "Europe/Dublin"): 60, ("IST", "Asia/Jerusalem"): 120}
MONTHS = {m: i + 1 for i, m in enumerate("JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split())}
WEEKDAYS = {d: i for i, d in enumerate("MON TUE WED THU FRI SAT SUN".split())}

_TIME = r"(?P<h>\d{1,2}):(?P<mi>\d\d)(?::(?P<s>\d\d)(?:[.,](?P<f>\d+))?)?"
_HALF = r"(?: ?(?P<half>[AP]M))?"
_ZONE = r"(?: ?(?P<z>Z|[+-]\d\d:?\d\d|[+-]\d\d|\[[A-Z0-9_+\-/]+\]|[A-Z]+(?:/[A-Z0-9_+\-]+)*))?"
_MON = r"(?P<mon>[A-Z]{3})[A-Z]*"
#: (name, pattern of upper-cased text).  The first that fits the shape takes it.
FORMATS = [
    ("iso", rf"(?P<y>\d{{4}})-(?P<m>\d\d)-(?P<d>\d\d)(?:[T ]{_TIME}{_ZONE})?"),
    ("compact", rf"(?P<y>\d{{4}})(?P<m>\d\d)(?P<d>\d\d)(?:T?(?P<h>\d\d)(?P<mi>\d\d)(?P<s>\d\d)(?:[.,](?P<f>\d+))?{_ZONE})?"),
    ("count", r"(?P<n>\d{10}|\d{13}|\d{16}|\d{19})(?:\.(?P<f>\d+))?"),
    ("month", r"(?P<y>\d{4})-(?P<m>\d\d)"),
    ("week", rf"(?P<y>\d{{4}})-?W(?P<w>\d\d)-?(?P<wd>\d)(?:[T ]{_TIME}{_ZONE})?"),
    ("ordinal", rf"(?P<y>\d{{4}})-(?P<yd>\d{{3}})(?:[T ]{_TIME}{_ZONE})?"),
    ("slash", rf"(?P<p>\d{{1,2}})/(?P<q>\d{{1,2}})/(?P<y>\d{{4}}|\d\d)(?: {_TIME}{_HALF}{_ZONE})?"),
    ("dots", rf"(?P<d>\d{{1,2}})\.(?P<m>\d{{1,2}})\.(?P<y>\d{{4}}|\d\d)(?: {_TIME}{_HALF}{_ZONE})?"),
    ("day first", rf"(?:(?P<dow>[A-Z]{{3}})[A-Z]*, ?)?(?P<d>\d{{1,2}})[ -]{_MON}[ -](?P<y>\d{{4}}|\d\d)(?:[ T]{_TIME}{_HALF}{_ZONE})?"),
    ("month first", rf"(?:(?P<dow>[A-Z]{{3}})[A-Z]*,? )?{_MON} (?P<d>\d{{1,2}}),? (?P<y>\d{{4}})(?:,? {_TIME}{_HALF}{_ZONE})?"),
]
PATTERNS = {name: re.compile(p + r"\Z") for name, p in FORMATS}
_LETTERS = re.compile(r"[^\W\d_]+")
_DIGIT = re.compile(r"\d")


def shape(text: str) -> str:
    """Character-class mask of a text: digits one by one, letters by runs, the rest as it is."""
    return _DIGIT.sub("0", _LETTERS.sub("a", text))


def tidy(text: str) -> str:
    """Compatibility form, single spaces, upper case."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).replace("−", "-")
    return " ".join(text.split()).upper()


def _num(s: pd.Series, missing: int = 0) -> np.ndarray:
    return pd.to_numeric(s, errors="coerce").fillna(missing).to_numpy(dtype=np.int64)


class ShapeParser:
    """Maps shapes to parsers (each once) and converts values parser by parser."""

    def __init__(self) -> None:
        self.known: dict[str, list[str]] = {}

    def formats_of(self, mask: str, example: str) -> list[str]:
        """Names of the formats that texts of this shape can have, by the first example seen and by the shape itself."""
        if mask not in self.known:
            kinds = [n for n, p in PATTERNS.items() if p.match(example)] if mask.count("a") == 0 else []
            if not kinds:  # words decide as well as the shape: try every format whose fixed marks fit
                kinds = [n for n in PATTERNS if _could_fit(n, mask)]
            self.known[mask] = kinds
        return self.known[mask]

    def parse(self, texts: pd.Series, home: pd.Series, day_first: pd.Series) -> pd.Series:
        """Microseconds since 1970 in UTC, <NA> where the text does not fix exactly one instant."""
        out = pd.Series(pd.NA, index=texts.index, dtype="Int64")
        clean = texts.dropna().map(tidy)
        clean = clean[clean != ""]
        if clean.empty:
            return out
        masks = clean.map(shape)
        groups: dict[str, list] = {}
        for mask, idx in masks.groupby(masks, sort=False).groups.items():
            for kind in self.formats_of(mask, clean[idx[0]]):
                groups.setdefault(kind, []).append(idx)
        for kind in PATTERNS:
            if kind in groups:
                idx = groups[kind][0].append(groups[kind][1:]) if len(groups[kind]) > 1 else groups[kind][0]
                idx = idx[out[idx].isna()]
                if len(idx):
                    v, ok = _convert(kind, clean[idx], home[idx], day_first[idx])
                    out[idx[ok]] = v[ok]
        return out


def _could_fit(kind: str, mask: str) -> bool:
    lead = {"iso": r"0000-00-00", "compact": r"0{8}", "count": r"0{10,19}", "month": r"0000-00$", "week": r"0000-?a00", "ordinal": r"0000-000", "slash": r"00?/00?/00", "dots": r"00?\.00?\.00", "day first": r"(a, ?)?00?[ -]a", "month first": r"(a,? )?a 00?"}
    return re.match(lead[kind], mask) is not None


def _convert(kind: str, s: pd.Series, home: pd.Series, day_first: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    g = s.str.extract(PATTERNS[kind])
    n = len(s)
    none = pd.Series([None] * n, index=s.index, dtype=object)
    get = lambda k: g[k] if k in g else none
    frac = _num(get("f").astype("string").str.slice(0, 6).str.pad(6, side="right", fillchar="0"))
    frac = np.where(get("f").isna(), 0, frac)
    if kind == "count":
        ok = g["n"].notna().to_numpy()
        size = g["n"].str.len().fillna(10).to_numpy()
        value = np.array([int(x) if isinstance(x, str) else 0 for x in g["n"]], dtype=np.int64)
        micros = np.select([size == 10, size == 13, size == 16], [value * 1_000_000 + frac, value * 1000, value], value // 1000)
        return micros, ok & ((size == 10) | get("f").isna().to_numpy())
    ok = g["y"].notna().to_numpy()
    year = _num(g["y"])
    year = np.where(g["y"].str.len().fillna(4).to_numpy() == 2, 2000 + year, year)
    month, day = _num(get("m"), 1), _num(get("d"), 1)
    if "mon" in g:
        month = g["mon"].map(MONTHS)
        ok &= month.notna().to_numpy()
        month = month.fillna(1).to_numpy(dtype=np.int64)
    if kind == "slash":
        first = day_first.to_numpy(dtype=object)
        ok &= np.array([isinstance(x, bool | np.bool_) for x in first])
        first = np.array([x is True or x is np.True_ for x in first])
        p, q = _num(g["p"]), _num(g["q"])
        day, month = np.where(first, p, q), np.where(first, q, p)
    ok &= (year >= 1) & (year < 9999) & (month >= 1) & (month <= 12) & (day >= 1) & (day <= 31)
    safe_year = np.where(ok, year, 2000)
    m64 = (safe_year - 1970) * 12 + np.where(ok, month, 1) - 1
    days = m64.astype("datetime64[M]").astype("datetime64[D]").astype(np.int64) + np.where(ok, day, 1) - 1
    ok &= days < (m64 + 1).astype("datetime64[M]").astype("datetime64[D]").astype(np.int64)
    if kind in ("week", "ordinal"):
        jan1 = (safe_year - 1970).astype("datetime64[Y]").astype("datetime64[D]").astype(np.int64)
        nxt = (safe_year - 1969).astype("datetime64[Y]").astype("datetime64[D]").astype(np.int64)
        if kind == "ordinal":
            yd = _num(g["yd"])
            ok &= (yd >= 1) & (yd <= nxt - jan1)
            days = jan1 + yd - 1
        else:
            w, wd = _num(g["w"]), _num(g["wd"])
            monday = lambda j: j + 3 - (j + 3 + 3) % 7  # Monday of the week that holds 4 January
            start = monday(jan1)
            ok &= (w >= 1) & (w <= (monday(nxt) - start) // 7) & (wd >= 1) & (wd <= 7)
            days = start + (w - 1) * 7 + wd - 1
    if "dow" in g:
        dow = g["dow"].map(WEEKDAYS)
        said = g["dow"].notna().to_numpy()
        ok &= ~said | (dow.fillna(-1).to_numpy() == (days + 3) % 7)
    timed = get("h").notna().to_numpy()
    hour, minute, sec = _num(get("h")), _num(get("mi")), _num(get("s"))
    half = get("half")
    has_half = half.notna().to_numpy()
    ok &= ~has_half | ((hour >= 1) & (hour <= 12))
    hour = np.where(has_half, hour % 12 + np.where(half == "PM", 12, 0), hour)
    ok &= (hour <= 23) & (minute <= 59) & (sec <= 59)
    wall = days * 86_400 + hour * 3600 + minute * 60 + sec
    utc = np.zeros(n, dtype=np.int64)
    zone = get("z").to_numpy(dtype=object)
    home_v = home.to_numpy(dtype=object)
    named = np.array([z if isinstance(z, str) else None for z in zone], dtype=object)
    # one conversion per zone named, home zone where that matters, and texts with or without a time
    zone_code, zone_names = pd.factorize(pd.Series(named, dtype=object))
    home_code, home_names = pd.factorize(pd.Series(home_v, dtype=object))
    local = np.array([*(str(x).isalpha() for x in zone_names), True])[zone_code]
    home_code = np.where(local, home_code, -1)
    at = np.flatnonzero(ok)
    mixed = ((zone_code + 1) * (len(home_names) + 1) + home_code + 1) * 2 + timed
    _, start, group = np.unique(mixed[at], return_index=True, return_inverse=True)
    for k, first in enumerate(at[start]):
        rows = at[group == k]
        z, h, t = (zone_names[zone_code[first]] if zone_code[first] >= 0 else None), (home_names[home_code[first]] if home_code[first] >= 0 else None), bool(timed[first])
        fixed = _fixed_offset(z, h) if z is not None else None
        if fixed is not None:
            utc[rows] = wall[rows] - fixed * 60
        else:
            name = _zone_name(z) if z is not None else h
            u, good = zones.wall_to_utc(name, wall[rows], first_moment=not t) if isinstance(name, str) else (wall[rows], np.zeros(len(rows), dtype=bool))
            utc[rows], ok[rows] = u, good
    return utc * 1_000_000 + frac, ok


def _fixed_offset(z: str, home: str | None) -> int | None:
    m = re.fullmatch(r"([+-])(\d\d):?(\d\d)?", z)
    if m:
        h, mi = int(m[2]), int(m[3] or 0)
        return (1 if m[1] == "+" else -1) * (h * 60 + mi) if h <= 18 and mi <= 59 else None
    z = z.strip("[]")
    return SHARED.get((z, home), ABBREVIATIONS.get(z))


_NAMES: dict[str, str] = {}


def _zone_name(z: str) -> str | None:
    """The database's spelling of a zone named in any case; None if it has none."""
    if not _NAMES:
        import zoneinfo

        _NAMES.update({n.upper(): n for n in zoneinfo.available_timezones()})
    return _NAMES.get(z.strip("[]"))


def normalise_timestamps(entities: DataFrame, registry: DataFrame, fields: tuple[str, ...] = ("valid_from", "valid_to")) -> DataFrame:
    """(row_id, field, text, shape, utc_micros) of every text in ``fields``; null texts give no row.

    ``utc_micros`` is null where the text does not fix exactly one instant:
    blank or worded texts, impossible dates or times, wall-clock times that a
    clock change skips or repeats, times without a date, the year 9999, a
    weekday that contradicts the date, and local texts of a source that the
    registry does not have.  Digits beyond microseconds are cut off.  Rows are
    taken as they come: repeated rows give repeated results.  Of several
    registry rows for a source the smallest (home_zone, day_first) counts.
    """
    reg = registry.groupBy("source").agg(F.min(F.struct("home_zone", "day_first")).alias("_r")).select(F.col("source").alias("_source"), F.col("_r.home_zone").alias("_zone"), F.col("_r.day_first").alias("_dayfirst"))
    rows = entities.select("row_id", source_of(F.col("source_key")).alias("_source"), *fields).join(reg, "_source", "left")
    texts = rows.select("row_id", "_zone", "_dayfirst", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])).alias("_x"))
    texts = texts.select("row_id", "_zone", "_dayfirst", "_x.field", "_x.text").filter(F.col("text").isNotNull())
    version = zones.database_version()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if zones.database_version() != version:
            raise RuntimeError(f"zone database {zones.database_version()} here, {version} on the driver")
        parser = ShapeParser()
        for b in batches:
            b = b.reset_index(drop=True)
            micros = parser.parse(b["text"], b["_zone"], b["_dayfirst"])
            yield pd.DataFrame({"row_id": b["row_id"], "field": b["field"], "text": b["text"], "shape": b["text"].map(lambda t: shape(tidy(t))), "utc_micros": micros})

    return texts.mapInPandas(run, "row_id bigint, field string, text string, shape string, utc_micros bigint")


def shape_report(entities: DataFrame, registry: DataFrame) -> DataFrame:
    """Per shape: texts and how many of them fix an instant."""
    return normalise_timestamps(entities, registry).groupBy("shape").agg(F.count("*").alias("texts"), F.count("utc_micros").alias("fixed"))
