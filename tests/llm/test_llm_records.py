"""Grouping, survivors, names and matching on small fixtures."""

import datetime as dt
import random

import pytest

from graphwright.llm import components, match, names, spelling, survivor

T = lambda d: dt.datetime(2025, 1, d)
ENTITY = "row_id bigint, source_key string, graph_id string, entity_type string, normalized_names array<string>, identifiers map<string,array<string>>, affiliations array<string>, neighbors array<string>, attributes map<string,string>, valid_from string, valid_to string, source_reliability double, embedding array<double>, stored_at timestamp, left_key string"


def roots(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            up[max(find(a), find(b))] = min(find(a), find(b))
    return {x: find(x) for x in up}


@pytest.mark.parametrize("finish", [0, 50, 40_000])
def test_components_against_union_find(spark, finish):
    rnd = random.Random(4)
    edges = [(f"c{i}", f"c{i + 1}") for i in range(40)] + [("hub", f"s{i}") for i in range(60)] + [(f"r{rnd.randint(0, 60)}", f"r{rnd.randint(0, 60)}") for _ in range(50)] + [(None, "x"), ("y", "y"), ("hub", "s1")]
    got = {r.v: r.root for r in components.components(spark.createDataFrame(edges, "a string, b string"), finish=finish).collect()}
    want = roots(edges)
    assert set(got) == set(want)
    by_got, by_want = {}, {}
    for v in want:
        by_got.setdefault(got[v], set()).add(v)
        by_want.setdefault(want[v], set()).add(v)
    assert sorted(map(sorted, by_got.values())) == sorted(map(sorted, by_want.values()))


M = "match_id bigint, left_key string, right_key string, decided_at timestamp, link_kind string, source_key string"
C = "cluster_id string, version bigint, entity_type string, members array<string>"


def test_hops_keep_the_plan_linear(spark):
    loops = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "b"), ("a", "a"), ("b", "b"), ("c", "c")], "src string, dst string")
    best = spark.createDataFrame([("a", 0.0, "a", True), ("b", 1.5, "b", False), ("c", 5.0, "c", False)], "v string, t double, c string, moved boolean")
    for _ in range(3):
        best = components._hop(loops, best, 7)
    assert best._jdf.queryExecution().analyzed().toString().count("Join ") == 3
    assert {(r.v, r.t, r.c) for r in best.collect()} == {("a", 0.0, "a"), ("b", 1.0, "a"), ("c", 2.0, "a")}


def test_keys_are_distinct_without_a_shuffle(spark):
    keys = names._person_keys(spark.createDataFrame([("g", "jo|abcdef abcdef"), ("h", "j|abcdef")], "graph_id string, v string"))
    rows = keys.collect()
    assert len(rows) == len(set(rows)) and {r.graph_id for r in rows} == {"g", "h"}
    assert "Exchange" not in keys._jdf.queryExecution().executedPlan().toString()


def test_group_keys(spark):
    m = spark.createDataFrame([(1, "a", "b", T(1), "SAME_AS", ""), (2, "b", "a", T(2), None, ""), (3, "b", "c", T(1), "SAME_AS", ""), (4, "c", "b", T(1), "POSSIBLY_SAME_AS", ""), (5, "d", "e", None, "SAME_AS", ""), (6, "e", "e", T(1), "SAME_AS", ""), (7, None, "e", T(1), "SAME_AS", ""), (8, "e", "f", T(3), "SAME_AS", ""), (8, "e", "f", T(3), "SAME_AS", "")], M)
    c = spark.createDataFrame([("x", 1, "Concept", ["a", "z"]), ("x", 2, "Concept", ["f", "q", "q", None]), ("x", 2, "Concept", ["f", "q"]), ("y", 1, "Paper", ["a", "b"]), ("w", 1, "Concept", ["solo"]), (None, 1, "Concept", ["m", "n"])], C)
    assert {tuple(r) for r in components.group_keys(m, c).collect()} == {(k, "d") for k in "defq"}
    assert components.group_keys(m.limit(0), c.limit(0)).count() == 0


def entity(n, key, kind, nm=None, ids=None, aff=None, attrs=None, frm=None, to=None, rel=None, graph="g", at=1):
    return (n, key, graph, kind, nm, ids, aff, [], attrs or {}, frm, to, rel, None, T(at), "clash")


def test_survivors(spark):
    e = [
        entity(1, "s/a", "Paper", ["n/a"], {"doi": ["10.1"]}, attrs={"venue": "V"}, rel=0.9), entity(2, "s/b", "Paper", ["Title"], {"doi": ["--"]}, attrs={"venue": "W", "publisher": "P"}, rel=0.9, at=2), entity(3, "s/c", "Paper", [], None, attrs=None, rel=None),
        entity(4, "s/b", "Paper", ["Old"], None, rel=1.0, at=1), entity(5, "s/d", "Paper", None, None, attrs={"publisher": "unbekannt", "venue": " "}, rel=0.1),
    ]
    cl = spark.createDataFrame([("c", 1, "Paper", ["s/d"]), ("c", 3, "Paper", ["s/a", "s/b", "s/c", "s/zz", "s/b"]), ("d", 1, "Paper", ["s/d", "s/c"]), ("e", 1, "Paper", ["s/a"])], C)
    ev = spark.createDataFrame([("MERGE", ("c",)), ("MERGE", ("c",)), ("MERGE", ("d",)), ("SPLIT", ("e",)), ("MERGE", None), ("MERGE", (None,))], "kind string, plan struct<cluster_id:string>")
    m = survivor.merge_members(spark.createDataFrame(e, ENTITY), cl, ev)
    got = {(r.cluster_id, r.field): r.source_key for r in survivor.choose_stated(m).collect()}
    assert got == {("c", "name"): "s/b", ("c", "doi"): "s/a", ("c", "venue"): "s/b", ("c", "publisher"): "s/b", ("c", "into"): "s/b", ("d", "into"): "s/d"}
    assert survivor.choose_stated(m.limit(0)).count() == 0


def test_truth_discovery_follows_agreement(spark):
    rows = []
    for c in range(8):
        rows += [(f"c{c}", f"{s}/{c}", None, T(1), v, None, None, None, None) for s, v in (("good", f"right {c}"), ("fair", f"RIGHT {c}"), ("bad", f"wrong {c}"))]
    rows += [("last", "good/9", None, T(1), "yes", None, None, None, None), ("last", "bad/9", None, T(1), "a no", None, None, None, None)]
    m = spark.createDataFrame(rows, "cluster_id string, source_key string, reliability double, stored_at timestamp, name string, doi string, venue string, proposed_year string, publisher string")
    got = {r.cluster_id: r.value for r in survivor.discover(m).collect()}
    assert got["last"] == "yes" and all(got[f"c{c}"].lower() == f"right {c}" for c in range(8))
    assert survivor.discover(m.limit(0)).count() == 0


def test_reading_names():
    same = lambda a, b: spelling.same_person_name(spelling.read_person(a), spelling.read_person(b))
    assert same("Jürgen H. Godrairvik-Beigandild", "prof. dr. juergen godrairvik-beigandild") == 2
    assert same("Becky Feipelique", "feipelique, rebecca") == 2 and same("e. laimoulari", "Elizabeth Laimoulari, PhD") == 1
    assert same("emeka geiyouello", "matthias geiyouello") == 0 and same("robert richard wimairktun", "robert theodore wimairktun") == 0
    assert spelling.read_person("") is None and spelling.read_person("...") is None
    org = lambda a, b: spelling.same_org_name(spelling.read_org(a), spelling.read_org(b))
    assert org("univ. of polar tran., raiwemund", "Raiwemund University of Polar Transport Ltd") == 2
    assert org("asr graivorkow s.a.", "Agency of Seismic Records, Graivorkow") == 1 and org("agency of crop genetics, x-town", "agency of grid safety, x-town") == 0


def test_roles_and_given_names():
    assert spelling.roles("Dr. Qorvin van Haldmark") == (["qorvin"], ["haldmark"]) and spelling.roles("haldmark, Q. qorvin, PhD") == (["qorvin"], ["haldmark"]) and spelling.roles("haldmark") == ([], [])
    given = spelling.Given({"qorvin": 60, "sellis": 9, "qorvn": 5, "qorbin": 40})
    assert given.full("qorvn") == "qorvin" and given.full("qorbin") == "qorbin"
    assert [given.full(w) for w in ("qorvin", "qorvni", "haldmark", "bob", "sel")] == ["qorvin", "qorvin", None, "robert", None]
    assert spelling.read_person("haldmark qorvin", given) == (("qorvin",), ("haldmark",))
    same = lambda a, b: spelling.same_person_name(spelling.read_person(a), spelling.read_person(b))
    assert all(same(f"{a} Haldmark", f"haldmark, {b}") == 2 for a, b in (("Michael", "Mike"), ("Jim", "James"), ("Charles", "Chuck"), ("Patty", "Patricia")))


def test_words_within_two_edits_share_a_key():
    rnd = random.Random(5)
    letters = "abcdefghij"
    for _ in range(2000):
        w = "".join(rnd.choice(letters) for _ in range(rnd.randint(8, 12)))
        v = w
        for _ in range(2):
            i = rnd.randrange(len(v))
            v = rnd.choice([v[:i] + v[i + 1 :], v[:i] + rnd.choice(letters) + v[i:], v[:i] + rnd.choice(letters) + v[i + 1 :]])
        if min(len(w), len(v)) >= 7:
            assert spelling.two_edit_keys(w) & spelling.two_edit_keys(v), (w, v)


def test_short_forms_that_no_table_has(spark):
    forms = [("qorvin", "zib"), ("sellisa", "lalo"), ("haddeus", "puck"), ("wendrith", "tosk"), ("ombrel", "jex"), ("karissol", "dunna"), ("velmior", "hag"), ("istrane", "fip")]
    parts, rows, n = ["hald", "bren", "tosk", "wirr", "lest", "corv"], [], 0
    for i, (long, short) in enumerate(forms):
        for s in parts:
            for name in (long, short):
                rows.append(entity(n, f"s/{n:03}", "Person", [f"{name} {s}mark{'abcdefgh'[i] * 3}"], None, [f"institute of polar records, {s}{'klmnopqr'[i] * 4}"]))
                n += 1
    rows.append(entity(990, "s/990", "Person", ["qorvin haldmarkaaa"], None, ["agency of tidal mapping, elsewhere"]))
    rows.append(entity(991, "s/991", "Person", ["dunna haldmarkaaa"], None, ["institute of polar records, haldkkkk"]))
    got = {(r.left_key, r.right_key) for r in names.find_variants(spark.createDataFrame(rows, ENTITY)).collect()}
    # the first place of work has three given names under one surname and is no evidence; its short form is linked by that of the others
    assert got == {(f"s/{2 * i:03}", f"s/{2 * i + 1:03}") for i in range(48)}
    assert names.find_variants(spark.createDataFrame(rows[:4], ENTITY)).count() == 0


def test_variants(spark):
    p = lambda n, k, nm, aff, g="g": entity(n, k, "Person", nm, None, aff, graph=g)
    a, b = ["company of textile conservation, paklaisel"], ["agency of seismic records, neivailtesk"]
    rows = [
        p(1, "s/1", ["Rebecca Hamirild"], a), p(2, "s/2", ["harnirild, rebecca josephine"], ["paklaisel textile conservation company"]), p(3, "s/3", ["becky hamirlid"], a), p(4, "s/4", ["Rebecca Hamirild"], b), p(5, "s/5", ["R. Hamirild"], a),
        p(6, "s/6", ["rebecca hamirild"], a, "other"), p(7, "s/7", None, None), p(8, "s/8", [""], [None]), p(9, None, ["Rebecca Hamirild"], a), p(10, "s/1", ["Rebecca Hamirild"], a), p(11, "s/11", ["Anthony Yaserholm"], []), p(12, "s/12", ["anthony yaserhlom"], a),
        entity(20, "o/1", "Organization", ["Company of Textile Conservation, Paklaisel"]), entity(21, "o/2", "Organization", ["cotc paklaisel ltd"]), entity(22, "o/3", "Organization", ["textile cons. co. (paklaisle)"]), entity(23, "o/4", "Organization", ["Agency of Textile Conservation, Paklaisel"]),
    ]
    got = {(r.left_key, r.right_key) for r in names.find_variants(spark.createDataFrame(rows, ENTITY)).collect()}
    one = ["s/1", "s/2", "s/3", "s/5"]
    want = {(x, y) for i, x in enumerate(one) for y in one[i + 1 :]} | {("s/11", "s/12")} | {("o/1", "o/2"), ("o/1", "o/3"), ("o/2", "o/3")}
    assert got == want
    assert names.find_variants(spark.createDataFrame([], ENTITY)).count() == 0


def test_matching(spark):
    v = lambda n, k, nm, lat, lon, frm, to, ids=None: entity(n, k, "Station", [nm] if nm else None, ids, ["agency of coastal ecology, skeibrenwyn"], {"latitude": lat, "longitude": lon} if lat else {}, frm, to)
    rows = [
        v(1, "feed/a/1", "skeibrenwyn north tower stn 1", "10.0001", "20.0001", "2015-01-01", "2018-01-01", {"callsign": ["AB 12"]}), v(2, "feed/b/1", "tower n., skeibrenwny post", "10,0004", "20,0003", "2015-01-09T00:00:00Z", None, {"callsign": ["ab-12"]}),
        v(3, "feed/b/2", "skeibrenwyn north tower post 1", "10.0002", "20.0002", "2018-06-01", "2021-01-01"), v(4, "feed/a/2", "skeibrenwyn south tower stn 1", "10.0131", "20.0001", "2015-01-01", "2018-01-01"), v(5, "feed/b/3", "s tower skeibrenwyn", "10.0133N", "20.0002E", None, "2018-01-03"),
        v(6, "feed/c/1", None, None, None, None, None), v(7, "feed/a/1", "old name", None, None, None, None)[:13] + (None, "clash"), v(8, "feed/c/2", "x" * 3000, "0.0", "0.0", "bad", "bad"),
    ]
    reg = spark.createDataFrame([(s, "UTC", True) for s in ("feed/a", "feed/b", "feed/c")], "source string, home_zone string, day_first boolean")
    got = match.match_things(spark.createDataFrame(rows, ENTITY), reg).collect()
    assert {(r.left_key, r.right_key) for r in got} == {("feed/a/1", "feed/b/1"), ("feed/a/2", "feed/b/3")}
    assert all(0.5 < r.confidence <= 1 for r in got)
    assert match.match_things(spark.createDataFrame([], ENTITY), reg).count() == 0


def test_degrees():
    f = match.read_degrees
    assert [f(x, 90) for x in ("1.5", "-1,5", "1.5S", "S 1.5", "91", "", None, "abc")] == [1.5, -1.5, -1.5, -1.5, None, None, None, None]


def test_variants_at_a_hot_place(spark):
    kinds, fields, topics = ["institute", "agency", "centre", "laboratory"], ["freight", "polar", "crop", "textile", "coastal"], ["analytics", "genetics", "safety"]
    many = [f"{f} {t} {k} praterholm" for k in kinds for f in fields for t in topics]
    odd = ["freight analytics institute pratreholm", "freight anal. institute praterholm", "fai praterholm", "frieght analytics inst. praterholm", "praterhlom freight analitics inst"]
    rows = [entity(i, f"o/{i:03}", "Organization", [n]) for i, n in enumerate([*many, *odd])]
    got = {(r.left_key, r.right_key) for r in names.find_variants(spark.createDataFrame(rows, ENTITY)).collect()}
    one = [f"o/{i:03}" for i in (0, *range(len(many), len(many) + len(odd)))]
    assert got == {(x, y) for i, x in enumerate(one) for y in one[i + 1 :]}


def test_names_that_agree_share_a_key():
    common = {w: 100 - i for i, w in enumerate("institute agency freight analytics polar transport stipurkine conservation coastal".split())}
    tokens = spelling.WordTokens(common)
    full = ("analytics", "freight", "institute", "stipurkine")
    variants = [full, ("anal.", "freight", "institute", "stipurkine"), ("analytics", "frieght", "institute", "stipurkine"), ("analytics", "freight", "institute", "stiprukinee"), ("analytics", "freight", "institute", "nv2", "stipurkine"), ("aif", "stipurkine"), ("aiof", "stipurkine"), ("aif", "stiprukine"), ("inst.", "fsa")]
    keys = {v: (spelling.rarest_together(list(v), tokens), {k for k, n in spelling.acronym_keys(list(v), tokens) if n == 1}, {k for k, n in spelling.acronym_keys(list(v), tokens) if n == 2}) for v in variants}
    seen = 0
    for a in variants:
        for b in variants:
            if a != b and spelling.same_org_name(a, b):
                seen += 1
                assert keys[a][0] & keys[b][0] or keys[a][1] & keys[b][2] or keys[a][2] & keys[b][1], (a, b)
    assert seen >= 30


def test_matching_at_a_hot_site(spark):
    t = lambda n, k, nm, frm, org=None: entity(n, k, "Station", [nm], None, [org] if org else [], {}, frm, None)
    org, piers = "agency of coastal ecology, skeibrenwyn", ["pier", "quarry", "depot", "weir"]
    rows = [t(1, "feed/a/1", "skeibrenwyn tower", "2015-01-01", org), t(2, "feed/b/1", "tower, skeibrenwny", "2015-01-20")]
    rows += [t(10 + i, f"feed/b/x{i}", f"skeibrenwyn {piers[i % 4]}", "2015-01-01", org) for i in range(300)]
    rows += [t(400 + i, f"feed/c/y{i}", f"{'abcdefghijklmnopqrst'[i % 20] * 2}{'klmno'[i % 5]}holmstead{i % 7} tower", "2019-05-05") for i in range(600)]
    reg = spark.createDataFrame([(s, "UTC", True) for s in ("feed/a", "feed/b", "feed/c")], "source string, home_zone string, day_first boolean")
    got = {(r.left_key, r.right_key) for r in match.match_things(spark.createDataFrame(rows, ENTITY), reg).collect()}
    assert ("feed/a/1", "feed/b/1") in got


def test_words_far_apart_are_not_aligned():
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdeß") for _ in range(rnd.randint(1, 8))) for _ in range(120)]

    def edits(a, b):
        d = {(i, j): i or j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    assert all(spelling.distance(a, b, most) == min(edits(a, b), most + 1) for a in words for b in words for most in (1, 2))
    before = spelling._edits.cache_info().misses
    assert spelling.distance("harbour", "wetlands") == 3 and spelling.same_org_name(("cargo", "harbour", "wetlands"), ("institute", "mapping", "polytech")) == 0
    assert spelling._edits.cache_info().misses == before
    # one word more on one side, an acronym for two words, and a word without a partner on each side
    a = ("institute", "mapping", "tidal")
    assert [spelling.same_org_name(x, y) for p, q in ((a, (*a, "fx")), (a, ("institute", "mt")), (a, ("institute", "mapping", "polar"))) for x, y in ((p, q), (q, p))] == [2, 2, 1, 1, 0, 0]


def test_keys_are_made_in_all_tasks(spark):
    few = spark.createDataFrame([("g", f"w{i}") for i in range(40)], "graph_id string, v string").coalesce(1)
    k = names._keyed(names._spread(few), lambda: lambda v: [(v, 0), (v, 0), ("all", 1), (v[:2], 0)])
    assert k.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
    rows = [tuple(r) for r in k.collect()]
    assert len(rows) == len(set(rows)) == 110 and len({r[3] for r in rows if r[2] == 1}) == 1
