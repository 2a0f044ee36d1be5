"""Matching records of one thing across sources that share no key.

Every attribute of a record becomes terms of one inverted index.  BM25 finds
each record's nearest records: terms that are too common to lift a record over
the least score that counts make no candidates (exact, because their greatest
contributions together stay below it).  Of the others, those whose agreement
cannot be positive by the attributes that native expressions compare are left
out (exact as well: what is not compared yet is taken at its best); the rest are
judged by how names, identifiers, validity, place and operator agree.  A pair
stands if each is the other's nearest in its source and its confidence, a
logistic function of its score and of the gap to the runner-up, calibrated on
pairs that both carry call signs, is high enough.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphwright.functions.similarity import haversine_km
from graphwright.functions.text import source_of
from graphwright.llm import spelling
from graphwright.operators.timestamps import normalise_timestamps
from graphwright.session import cut

#: BM25 constants; share of its own score that a record's candidate must reach.
K1, B, LEAST_SHARE = 1.2, 0.75, 0.3
#: Pairs with identifiers on both sides on which the confidence is calibrated: the first so many by hash.
CALIBRATION_ROWS = 20_000
#: Pairs that both carry call signs are judged from this bound on their agreement: the calibration needs pairs that disagree as well.
LABELLED_FROM = -8.0
#: Confidence from which a pair counts as one thing, and the evidence that it needs besides: the calibration rests on
#: pairs with call signs, which call signs helped to propose, so it alone would accept pairs whose evidence speaks against them.
LEAST_CONFIDENCE, LEAST_SCORE = 0.5, 0.0
#: Labels that the calibration weighs as many as, however many there are, so that it behaves alike at every size.
LABEL_WEIGHT = 500
#: Weights of (score, gap, 1) before any label is seen.
PRIOR = (2.0, 0.7, 0.0)
DAY = 86_400_000_000
TYPES = ("Sensor", "Station", "Venue")

# Words for sides and levels, for structures and for kinds of things, each with its other spellings.
SIDES = {"north": "n nord northern nth", "south": "s sud sued southern sth", "east": "e ost est eastern", "west": "w ouest western", "upper": "upr up uppr", "lower": "lwr low lowr"}
STRUCTURES = {
    "harbour": "harbor hbr harb", "pier": "jetty pr jty", "quarry": "pit qry qrry", "tower": "twr tow", "hall": "hse house hll", "depot": "dpt dep", "bridge": "brg br bdg", "weir": "barrage wr dam", "field": "fld fd", "ridge": "rdg rg",
    "church": "ch kirche eglise", "school": "sch schl ecole", "lighthouse": "lt lth", "lock": "sluice lck", "canal": "cnl chan channel", "tunnel": "tnl tun", "reservoir": "resvr rsvr res", "terminal": "term trm", "warehouse": "whse wrhs", "museum": "mus", "theatre": "theater thtr",
    "stadium": "stad arena", "library": "lib bibl", "market": "mkt mkts", "airport": "aerodrome arpt apt", "hospital": "hosp hsp", "square": "sq platz", "park": "pk prk", "mill": "mll", "mine": "mn colliery", "island": "isl isle", "mountain": "mtn berg", "river": "riv fluss", "lake": "lk lac", "valley": "vly vall",
}
KINDS = frozenset("sensor probe gauge gage sens station stn post sta venue site rooms room".split())
NUMBERS = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6}
_SIDE = {w: k for k, v in SIDES.items() for w in [k, *v.split()]}
_STRUCTURE = {w: k for k, v in STRUCTURES.items() for w in [k, *v.split()]}


_KNOWN = {w: ("side", k) for w, k in _SIDE.items()} | {w: ("structure", k) for w, k in _STRUCTURE.items()} | {w: ("kind", w) for w in KINDS}


def _word(w: str) -> tuple[str, str] | None:
    """(side, structure or kind, full form) of a word; words with one typo count if only one known word is that near."""
    if w in _KNOWN:
        return _KNOWN[w]
    if len(w) >= 4:
        near = {k for x, k in _KNOWN.items() if len(x) >= 4 and spelling.distance(w, x, 1) == 1}
        return near.pop() if len(near) == 1 else None
    return None


def read_thing(text: str) -> dict:
    """place (other words), side, structure and number that a thing's name states."""
    out: dict = {"place": [], "side": None, "structure": None, "number": None}
    for raw in re.findall(r"[^\W_]+", spelling.fold(text)):
        w = spelling.unscan(raw)
        if raw.isdigit():
            out["number"] = int(raw) if len(raw) < 6 else None
        elif raw in NUMBERS:
            out["number"] = NUMBERS[raw]
        elif raw in ("no", "nr", "number"):
            continue
        elif (known := _word(w)) and (known[0] == "kind" or out[known[0]] is None):
            if known[0] != "kind":
                out[known[0]] = known[1]
        else:
            out["place"].append(w)
    return out


def read_degrees(text: str | None, most: float) -> float | None:
    """A coordinate with point or comma, sign or compass letter; None if it is none within ``most``."""
    m = re.fullmatch(r"\s*([NSEWO])?\s*([+\-−]?)\s*(\d{1,3}(?:[.,]\d+)?)\s*°?\s*([NSEWO])?\s*", (text or "").upper())
    if not m:
        return None
    v = float(m[3].replace(",", ".")) * (-1 if m[2] in ("-", "−") else 1) * (-1 if (m[1] or m[4] or "") in ("S", "W") and m[2] not in ("-", "−") else 1)
    return v if abs(v) <= most else None


def kilometres(a: tuple[float, float], b: tuple[float, float]) -> float:
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0088 * math.asin(min(1.0, math.sqrt(h)))


def _codes(m, name: str) -> list[str]:
    for k, v in m or []:
        if k == name:
            return [c for x in (v if v is not None else []) if x and (c := re.sub(r"[\W_]+", "", x).upper())]
    return []


def _describe(t: pd.DataFrame) -> pd.DataFrame:
    rows = []
    for r in t.itertuples(index=False):
        names = [read_thing(x) for x in (r.names if r.names is not None else []) if x]
        n = names[0] if names else {"place": [], "side": None, "structure": None, "number": None}
        attrs = dict(r.attributes or [])
        lat, lon = read_degrees(attrs.get("latitude"), 90), read_degrees(attrs.get("longitude"), 180)
        if lat is None or lon is None or (lat == 0 and lon == 0):
            lat = lon = None
        hints = [h.rsplit("/", 1)[-1] for h in (r.neighbors if r.neighbors is not None else []) if h] + [attrs.get("place") or ""]
        hints = [spelling.unscan(spelling.fold(h)).strip() for h in hints if h.strip()]
        org = next((o for x in (r.affiliations if r.affiliations is not None else []) if x and (o := spelling.read_org(x))), ())
        calls, permits = sorted(set(_codes(r.identifiers, "callsign"))), sorted(set(_codes(r.identifiers, "permit")))
        places = sorted({*n["place"], *hints})
        terms = {f"w:{v}" for w in places for v in spelling.deletions(w)}  # words one typo apart share one of these
        terms |= {f"c:{c}" for c in calls} | {f"p:{c}" for c in permits} | {f"o:{w}" for w in org}
        terms |= {f"{k}:{n[k]}" for k in ("side", "structure", "number") if n[k] is not None}
        if lat is not None:  # two grids, half a cell apart each way
            terms |= {f"l{i}{j}:{math.floor(lat / 0.03 + i / 2)},{math.floor(lon / 0.03 + j / 2)}" for i in (0, 1) for j in (0, 1)}
        for k, v in (("f", r.since), ("t", r.until)):
            if v is not None and not pd.isna(v):
                terms |= {f"{k}{h}:{int(v // (60 * DAY) + h / 2)}" if h == 0 else f"{k}{h}:{int((v + 30 * DAY) // (60 * DAY))}" for h in (0, 1)}
        rows.append((r.key, r.grp, r.source, n["place"], hints, n["side"], n["structure"], n["number"], lat, lon, calls, permits, list(org), r.since, r.until, sorted(terms)))
    out = pd.DataFrame(rows, columns="key grp source place hints side structure number lat lon calls permits org since until terms".split())
    for c in ("number", "since", "until"):
        out[c] = out[c].astype("Int64")
    return out


_DESCRIBED = "key string, grp string, source string, place array<string>, hints array<string>, side string, structure string, number bigint, lat double, lon double, calls array<string>, permits array<string>, org array<string>, since bigint, until bigint, terms array<string>"


def describe(entities: DataFrame, registry: DataFrame) -> DataFrame:
    """One row of attributes and index terms per key of a thing; of several rows the latest ``stored_at``, then the largest ``row_id``, counts."""
    rows = entities.filter(F.col("entity_type").isin(*TYPES) & F.col("source_key").isNotNull())
    cols = ["row_id", "source_key", "entity_type", "graph_id", "normalized_names", "identifiers", "affiliations", "neighbors", "attributes", "valid_from", "valid_to"]
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("entity_type", "source_key").orderBy(F.desc_nulls_last("stored_at"), F.desc("row_id")))).filter("_n = 1").select(*cols)
    times = normalise_timestamps(rows, registry).groupBy("row_id").agg(*[F.max(F.when(F.col("field") == f, F.col("utc_micros"))).alias(a) for f, a in (("valid_from", "since"), ("valid_to", "until"))])
    flat = rows.join(times, "row_id", "left").select(
        F.col("source_key").alias("key"), F.concat_ws("|", "entity_type", "graph_id").alias("grp"), source_of(F.col("source_key")).alias("source"), F.col("normalized_names").alias("names"),
        F.map_entries("identifiers").alias("identifiers"), "affiliations", "neighbors", F.map_entries("attributes").alias("attributes"), "since", "until",
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            pairs = lambda m: None if m is None else [(x["key"], x["value"]) for x in m]
            yield _describe(t.assign(identifiers=t["identifiers"].map(pairs), attributes=t["attributes"].map(pairs)))

    return flat.mapInPandas(run, _DESCRIBED)


def weigh(things: DataFrame) -> DataFrame:
    """(key, grp, source, term, w): the inverted index with BM25 weights within each group."""
    size = things.groupBy("grp").agg(F.count("*").alias("N"), F.avg(F.size("terms")).alias("avg"))
    post = things.select("key", "grp", "source", F.size("terms").alias("len"), F.explode("terms").alias("term"))
    seen = post.groupBy("grp", "term").agg(F.count("*").alias("df")).join(size, "grp")
    idf = F.log1p((F.col("N") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return post.join(seen, ["grp", "term"]).withColumn("w", idf * (K1 + 1) / (1 + K1 * (1 - B + B * F.col("len") / F.col("avg")))).withColumn("most", idf * (K1 + 1) / (1 + K1 * (1 - B))).select("key", "grp", "source", "term", "w", "most", "df")


def candidates(index: DataFrame) -> DataFrame:
    """Distinct (grp, a, b), a < b, of different sources that share a term too rare to be left out.

    The commonest terms of a record whose greatest weights sum to less than
    LEAST_SHARE of its own score cannot bring a record over that score alone.
    """
    by_key = Window.partitionBy("grp", "key")
    x = index.withColumn("own", F.sum("w").over(by_key)).withColumn("upto", F.sum("most").over(by_key.orderBy("most", "term").rowsBetween(Window.unboundedPreceding, 0)))
    x = x.withColumn("h", F.xxhash64("grp", "term"))
    ask = x.filter((F.col("upto") >= F.col("own") * LEAST_SHARE) & (F.col("df") > 1)).select("h", "grp", F.col("key").alias("q"), F.col("source").alias("s"))
    post = x.filter("df > 1").select("h", F.col("key").alias("d"), F.col("source").alias("r"))
    hit = ask.join(post, "h").filter("q <> d and s <> r")
    return hit.select("grp", F.least("q", "d").alias("a"), F.greatest("q", "d").alias("b")).distinct()


def agreement(x: dict, y: dict) -> tuple[float, float]:
    """(evidence without call signs, evidence of call signs) that two records describe one thing; together positive if they more likely do."""
    s = -1.0
    pa, pb = x["place"] or x["hints"], y["place"] or y["hints"]
    if not any(spelling.alike(p, q) for p in (*pa, *x["hints"]) for q in (*pb, *y["hints"])):
        s -= 6.0
    else:
        s += 1.0
    for k, gain, loss in (("side", 1.5, 8.0), ("structure", 1.5, 8.0)):
        if x[k] is not None and y[k] is not None:
            s += gain if x[k] == y[k] else -loss
    m, n = x["number"], y["number"]
    if m is not None and n is not None:
        s += 0.7 if m == n else -8.0
    elif max(m or 1, n or 1) > 1:
        s -= 1.0
    if x["lat"] is not None and y["lat"] is not None:
        km = kilometres((x["lat"], x["lon"]), (y["lat"], y["lon"]))
        if km > 1 and abs(y["lon"]) <= 90:  # latitude and longitude can have been put down the wrong way round
            km = min(km, kilometres((x["lat"], x["lon"]), (y["lon"], y["lat"])))
        s += 2.5 if km < 0.15 else 1.2 if km < 0.3 else -0.5 if km < 0.5 else -3.0 if km < 0.9 else -7.0
    a, b, c, d = x["since"], x["until"], y["since"], y["until"]
    # where a record ends before it begins, one of its times is wrong and neither speaks against a pair
    wrong = (a is not None and b is not None and b < a) or (c is not None and d is not None and d < c)
    if a is not None and c is not None:
        gap = abs(a - c) / DAY
        s += 2.0 if gap <= 31 else 0.0 if gap <= 62 or wrong else -4.0 if gap <= 200 else -7.0
    if b is not None and d is not None:
        gap = abs(b - d) / DAY
        s += 1.5 if gap <= 31 else 0.0 if gap <= 62 or wrong else -2.0
    if wrong:
        pass
    elif (b is not None and c is not None and b < c - 20 * DAY) or (d is not None and a is not None and d < a - 20 * DAY):
        s -= 8.0
    if x["permits"] and y["permits"]:
        s += 0.7 if set(x["permits"]) & set(y["permits"]) else -1.0
    if x["org"] and y["org"]:
        s += 0.5 if spelling.same_org_name(tuple(x["org"]), tuple(y["org"])) else -1.0
    call = 0.0
    if x["calls"] and y["calls"]:
        call = 4.0 if set(x["calls"]) & set(y["calls"]) else 0.0 if any(spelling.distance(p, q, 1) == 1 for p in x["calls"] for q in y["calls"]) else -3.0
    return s, call


#: Attributes that ``most_agreement`` compares.
BOUND_BY = ("side", "structure", "number", "lat", "lon", "since", "until", "calls", "permits")


def most_agreement(x: Column, y: Column) -> Column:
    """The most that ``agreement`` can come to, from the attributes in BOUND_BY: places and operators are taken to agree, call signs to be near."""
    both = lambda k: x[k].isNotNull() & y[k].isNotNull()
    no = lambda c: F.coalesce(c, F.lit(False))
    s = F.lit(0.5)
    for k in ("side", "structure"):
        s = s + F.when(both(k), F.when(x[k] == y[k], 1.5).otherwise(-8.0)).otherwise(0.0)
    s = s + F.when(both("number"), F.when(x["number"] == y["number"], 0.7).otherwise(-8.0)).when(F.greatest(F.coalesce(x["number"], F.lit(1)), F.coalesce(y["number"], F.lit(1))) > 1, -1.0).otherwise(0.0)
    km = haversine_km(x["lat"], x["lon"], y["lat"], y["lon"])
    km = F.when((km > 1) & (F.abs(y["lon"]) <= 90), F.least(km, haversine_km(x["lat"], x["lon"], y["lon"], y["lat"]))).otherwise(km)
    s = s + F.when(~(both("lat") & both("lon")), 0.0).when(km < 0.1501, 2.5).when(km < 0.3001, 1.2).when(km < 0.5001, -0.5).when(km < 0.9001, -3.0).otherwise(-7.0)
    wrong = no(x["until"] < x["since"]) | no(y["until"] < y["since"])
    gap = F.abs(x["since"] - y["since"]) / DAY
    s = s + F.when(~both("since"), 0.0).when(gap <= 31, 2.0).when((gap <= 62) | wrong, 0.0).when(gap <= 200, -4.0).otherwise(-7.0)
    gap = F.abs(x["until"] - y["until"]) / DAY
    s = s + F.when(~both("until"), 0.0).when(gap <= 31, 1.5).when((gap <= 62) | wrong, 0.0).otherwise(-2.0)
    s = s + F.when(~wrong & (no(x["until"] < y["since"] - 20 * DAY) | no(y["until"] < x["since"] - 20 * DAY)), -8.0).otherwise(0.0)
    listed = lambda k: (F.size(x[k]) > 0) & (F.size(y[k]) > 0)
    s = s + F.when(listed("permits"), F.when(F.arrays_overlap(x["permits"], y["permits"]), 0.7).otherwise(-1.0)).otherwise(0.0)
    return s + F.when(listed("calls") & F.arrays_overlap(x["calls"], y["calls"]), 4.0).otherwise(0.0)


def _judge(pairs: DataFrame, things: DataFrame, index: DataFrame) -> DataFrame:
    """(grp, a, b, sa, sb, ab, ba, rest, call, label) of the pairs that can agree or are labelled: BM25 both ways, evidence, and whether call signs agree (null if a side has none or they are near)."""
    some = lambda k: things.select("grp", F.col("key").alias(k), F.struct(*BOUND_BY).alias(f"{k}_"))
    most, labelled = most_agreement(F.col("a_"), F.col("b_")), (F.size("a_.calls") > 0) & (F.size("b_.calls") > 0)
    near = pairs.join(some("a"), ["grp", "a"]).join(some("b"), ["grp", "b"]).filter((most > 0) | (labelled & (most > LABELLED_FROM))).select("grp", "a", "b")
    own = index.groupBy("grp", "key").agg(F.map_from_entries(F.collect_list(F.struct("term", "w"))).alias("ws"))
    full = things.drop("terms").join(own, ["grp", "key"])
    cols = [c for c in full.columns if c not in ("grp", "key")]
    side = lambda k: full.select("grp", F.col("key").alias(k), F.struct(*cols).alias(f"{k}_"))
    both = near.join(side("a"), ["grp", "a"]).join(side("b"), ["grp", "b"])
    clean = lambda r: {k: (None if v is None or (isinstance(v, float) and math.isnan(v)) else v) for k, v in r.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            rows = []
            for g, a, b, x, y in zip(t["grp"], t["a"], t["b"], t["a_"], t["b_"], strict=True):
                x, y = clean(x), clean(y)
                wx, wy = dict(x["ws"]), dict(y["ws"])
                shared = wx.keys() & wy.keys()
                for r in (x, y):
                    for k in ("place", "hints", "calls", "permits", "org"):
                        r[k] = list(r[k]) if r[k] is not None else []
                rest, call = agreement(x, y)
                label = 1.0 if call > 0 else 0.0 if call < 0 else None  # call signs that differ in one letter say neither
                rows.append((g, a, b, x["source"], y["source"], sum(wy[k] for k in shared), sum(wx[k] for k in shared), rest, call, label))
            yield pd.DataFrame(rows, columns=["grp", "a", "b", "sa", "sb", "ab", "ba", "rest", "call", "label"])

    return both.mapInPandas(run, "grp string, a string, b string, sa string, sb string, ab double, ba double, rest double, call double, label double")


def calibrate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of (score, gap, 1) by logistic regression with a prior, in Newton steps that are halved until the loss falls; the prior if the labels cannot fix them."""
    prior = np.array(PRIOR)
    if len(y) < 50 or y.min() == y.max():
        return prior
    z, w, k = np.column_stack([np.clip(x, -20, 20), np.ones(len(x))]), prior, LABEL_WEIGHT / len(y)

    def loss(v: np.ndarray) -> float:
        t = z @ v
        return float(k * (np.logaddexp(0, t).sum() - y @ t) + ((v - prior) ** 2).sum() / 2)

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(k * (z * (p * (1 - p))[:, None]).T @ z + np.eye(3), k * z.T @ (p - y) + (w - prior))
        size = 1.0
        while loss(w - size * step) > loss(w) and size > 1e-6:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return w


def match_things(entities: DataFrame, registry: DataFrame) -> DataFrame:
    """(left_key, right_key, score, gap, confidence) of the pairs of records of different sources that describe one thing.

    Only rows of type Sensor, Station or Venue with a key count; records of
    different types or graphs never match.  Missing or unreadable attributes
    count neither for nor against a pair.  Of equally near records of a source
    the one with the greater BM25 score, then the smaller key, is nearest;
    ``gap`` is the lead over the next record of the source that can agree, 10
    at most.  The calibration sees the evidence without call signs, which are
    its labels.  Empty tables give no rows; other columns are ignored.
    """
    things = cut(describe(entities, registry))
    index = cut(weigh(things))
    judged = cut(_judge(candidates(index), things, index)).withColumn("score", F.col("rest") + F.col("call"))
    c = judged.select("grp", F.col("a").alias("q"), F.col("b").alias("d"), F.col("sb").alias("r"), F.col("ab").alias("bm"), "score", "rest", "label")
    c = c.unionByName(judged.select("grp", F.col("b").alias("q"), F.col("a").alias("d"), F.col("sa").alias("r"), F.col("ba").alias("bm"), "score", "rest", "label"))
    near = Window.partitionBy("grp", "q", "r").orderBy(F.desc("score"), F.desc("bm"), "d")
    ranked = c.withColumn("k", F.row_number().over(near)).withColumn("second", F.lead("score").over(near)).filter("k = 1")
    ranked = ranked.withColumn("gap", F.least(F.lit(10.0), F.coalesce(F.col("score") - F.col("second"), F.lit(10.0))))
    one, two = ranked.filter("q < d"), ranked.filter("q > d").select("grp", F.col("d").alias("q"), F.col("q").alias("d"), F.col("gap").alias("gap2"))
    mutual = cut(one.join(two, ["grp", "q", "d"]).select(F.col("q").alias("left_key"), F.col("d").alias("right_key"), "score", "rest", F.least("gap", "gap2").alias("gap"), "label"))
    known = mutual.filter("label is not null").orderBy(F.xxhash64("left_key", "right_key")).limit(CALIBRATION_ROWS).select("rest", "gap", "label").toPandas()
    w = calibrate(known[["rest", "gap"]].to_numpy(dtype=float), known["label"].to_numpy(dtype=float))
    p = 1 / (1 + F.exp(-(F.lit(float(w[0])) * F.col("score") + F.lit(float(w[1])) * F.col("gap") + F.lit(float(w[2])))))
    return mutual.withColumn("confidence", p).filter((F.col("confidence") >= LEAST_CONFIDENCE) & (F.col("score") > LEAST_SCORE)).select("left_key", "right_key", "score", "gap", "confidence")
