"""Orphan references and timestamps against brute force on small fixtures."""

import datetime as dt
import random
import zoneinfo

import numpy as np
import pandas as pd

from graphwright.functions import zones
from graphwright.operators import bloom, orphans
from graphwright.operators.timestamps import ShapeParser, normalise_timestamps

T = lambda d: dt.datetime(2025, 1, d)
AUDIT = "audit_id string, recorded_at timestamp, plan_id string, trace_id string, operation_ids array<string>, source_candidate_ids array<string>, field string"
PARENT = "field string, ref_id string, stored_at timestamp, removed_at timestamp"


def brute(audit, parents):
    out = set()
    for a in audit:
        refs = [("plan_id", a[2]), ("trace_id", a[3]), *[("operation_ids", x) for x in a[4] or []], *[("source_candidate_ids", x) for x in a[5] or []]]
        for f, r in refs:
            if r is None or not r.strip():
                continue
            r = r.strip()
            rows = [p for p in parents if p[0] == f and p[1] == r]
            if not rows:
                out.add((a[0], f, r, "missing"))
            elif a[1] is not None:
                if all(p[2] is not None and p[2] > a[1] for p in rows):
                    out.add((a[0], f, r, "late"))
                else:
                    by = [p for p in rows if p[2] is not None and p[2] <= a[1]]
                    if by and all(p[3] is not None and p[3] <= a[1] for p in by):
                        out.add((a[0], f, r, "deleted"))
    return out


def test_orphans_match_brute_force(spark):
    rnd = random.Random(5)
    ids = [f"id{i}" for i in range(12)]
    parents = [(f, rnd.choice(ids[:8]), rnd.choice([None, *map(T, range(1, 20))]), rnd.choice([None, None, *map(T, range(5, 25))])) for f in ("plan_id", "trace_id", "operation_ids", "source_candidate_ids") for _ in range(14)]
    pick = lambda: rnd.choice([None, "", "  ", "hot", *ids, f" {rnd.choice(ids)} "])
    audit = [(f"a{i % 50}", rnd.choice([None, *map(T, range(1, 25))]), pick(), pick(), rnd.choice([None, [], [pick(), pick()]]), rnd.choice([None, [pick()]]), "clash") for i in range(120)]
    got = orphans.find_orphans(spark.createDataFrame(audit, AUDIT), spark.createDataFrame(parents, PARENT)).select("audit_id", "field", "ref_id", "reason").distinct().collect()
    assert {tuple(r) for r in got} == brute(audit, parents)


def test_orphans_of_empty_tables(spark):
    audit = [("a", T(1), "p", None, [], None, "x"), ("b", None, "p", None, None, None, None)]
    none = spark.createDataFrame([], PARENT)
    assert {tuple(r) for r in orphans.find_orphans(spark.createDataFrame(audit, AUDIT), none).select("audit_id", "reason").collect()} == {("a", "missing"), ("b", "missing")}
    assert orphans.find_orphans(spark.createDataFrame([], AUDIT), none).count() == 0
    rep = orphans.orphan_report(spark.createDataFrame(audit, AUDIT), none).collect()
    assert sorted((r.field, r.month, r.references, r.missing) for r in rep if r.month) == [("plan_id", "2025-01", 1, 1)]


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(3000).selectExpr("'f' as field", "cast(id as string) as ref_id")
    bits = bloom.build(keys, ["field", "ref_id"], 64).scalar()
    out = spark.range(6000).selectExpr("'f' as field", "cast(id as string) as ref_id").withColumn("hit", bloom.might_contain(bits, ["field", "ref_id"], 64))
    assert out.filter("cast(ref_id as int) < 3000 and not hit").count() == 0


def test_wall_clock_against_zoneinfo():
    rnd = np.random.default_rng(3)
    for name in ("Europe/Berlin", "America/New_York", "Asia/Kathmandu", "Australia/Sydney", "Europe/London"):
        z = zoneinfo.ZoneInfo(name)
        walls = rnd.integers(0, 2_000_000_000, 300).tolist()
        starts, offs = zones.transitions(name)
        walls += [int(s + o + d) for s, o in zip(starts[1:][-60:], offs[1:][-60:], strict=True) for d in (-5400, -1800, 0, 1800, 5400)]
        utc, ok = zones.wall_to_utc(name, np.array(walls))
        for w, u, k in zip(walls, utc, ok, strict=True):
            naive = dt.datetime(1970, 1, 1) + dt.timedelta(seconds=w)
            hits = set()
            for fold in (0, 1):
                t = naive.replace(tzinfo=z, fold=fold).astimezone(dt.UTC)
                if t.astimezone(z).replace(tzinfo=None) == naive:
                    hits.add(int(t.timestamp()))
            assert k == (len(hits) == 1) and (not k or hits == {int(u)})


def parse(text, home="Europe/Berlin", day_first=True):
    v = ShapeParser().parse(pd.Series([text], dtype=object), pd.Series([home]), pd.Series([day_first], dtype=object)).iloc[0]
    return None if v is pd.NA else (dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=int(v))).isoformat()


def test_spellings():
    cases = {
        "2024-06-06T23:37:21Z": "2024-06-06T23:37:21", " 2024-06-06t23:37:21.123456789z\t": "2024-06-06T23:37:21.123456", "2024-07-01T10:00:00": "2024-07-01T08:00:00", "20180516035245": "2018-05-16T01:52:45",
        "1546760874343": "2019-01-06T07:47:54.343000", "1563358742": "2019-07-17T10:19:02", "17/09/2015 06:22": "2015-09-17T04:22:00", "27.12.23 21:07": "2023-12-27T20:07:00", "2009-W44-7": "2009-10-31T23:00:00",
        "2012-161": "2012-06-08T22:00:00", "2015-09": "2015-08-31T22:00:00", "26 JUN 2020": "2020-06-25T22:00:00", "May 14, 2020 5:55:51 PM": "2020-05-14T15:55:51", "Jul 15, 2009 4:12:14 AM AEST": "2009-07-14T18:12:14",
        "Fri, 02 Jun 2023 16:25:15 +0545": "2023-06-02T10:40:15", "2020-07-11T19:54:37[Asia/Tokyo]": "2020-07-11T10:54:37", "2019-04-05 05:37:56 europe/london": "2019-04-05T04:37:56", "２０１３-０１-１９T２３:５４:４８Z": "2013-01-19T23:54:48",
        "2023-10-29 02:30:00 CEST": "2023-10-29T00:30:00", "20150226T055536Z": "2015-02-26T05:55:36", "20/2/2023 12:12 am": "2023-02-19T23:12:00",
    }
    assert {k: parse(k) for k in cases} == cases


def test_texts_that_fix_nothing():
    for t in ("", "  ", "unknown", "2019-04-31", "2021-13-05T08:00:00Z", "2018-06-07T25:10:00+01:00", "9999-12-31", "0000-00-00 00:00:00", "12:40", "since spring", "2023-10-29 02:30:00", "2023-03-26 02:30:00", "31/11/2020 09:15", "?", "2021-02-29", "2021-366", "2021-W53-1", "Mon, 02 Jun 2023 16:25:15 +0000", "x" * 20000):
        assert parse(t) is None, t
    assert parse("2024-07-01T10:00:00", home=None) is None and parse("01/02/2024 10:00", day_first=None) is None
    assert parse("04/23/2012 05:40", day_first=False) == "2012-04-23T03:40:00"


def test_timestamps_frame(spark):
    e = spark.createDataFrame([(1, "feed/a/x", "2024-07-01T10:00:00", None, "c"), (1, "feed/a/x", "2024-07-01T10:00:00", None, "c"), (2, None, "2024-07-01", "2024-07-01T10:00:00Z", None), (3, "other", "2024-07-01", "", "d")], "row_id bigint, source_key string, valid_from string, valid_to string, home_zone string")
    r = spark.createDataFrame([("feed/a", "Asia/Tokyo", True)], "source string, home_zone string, day_first boolean")
    got = sorted((x.row_id, x.field, x.utc_micros) for x in normalise_timestamps(e, r).collect() if x.utc_micros is not None)
    assert got == [(1, "valid_from", 1719795600000000), (1, "valid_from", 1719795600000000), (2, "valid_to", 1719828000000000)]
    assert normalise_timestamps(e.limit(0), r).count() == 0 and normalise_timestamps(e, r.limit(0)).filter("utc_micros is not null").count() == 1
