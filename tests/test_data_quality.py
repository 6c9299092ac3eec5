import itertools
import math
import random
import re
from collections import Counter
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabulary.functions import geo
from tabulary.operators import multivalue, orphans, spatial


def split(spark, texts):
    rows = spark.createDataFrame([(i, "f", t) for i, t in enumerate(texts)], "row_id long, field string, text string")
    out = {}
    for r in multivalue.split_values(rows).collect():
        out.setdefault(r["row_id"], {})[r["position"]] = r["value"]
    return [[out.get(i, {}).get(p) for p in range(1, len(out.get(i, {})) + 1)] for i in range(len(texts))]


def test_dialects(spark):
    texts = ['A | "B, c" | D', "A;B;;C;", '"say ""x""" / E', "“p | q”\tR", "[1\n2\n3]", "Oriens:12, Oriens:13; Oriens:14", None, "", "  ", "|;", "A - B (c)", "x" * 5000 + "|y", '"open | A', "｜A｜B"]
    expected = [["A", "B, c", "D"], ["A", "B", "C"], ['say "x"', "E"], ["p | q", "R"], ["1", "2", "3"], ["Oriens:12", "Oriens:13", "Oriens:14"], [], [], [], [], ["A - B (c)"], ["x" * 5000, "y"], ['"open', "A"], ["A", "B"]]
    assert split(spark, texts) == expected


def test_known_values_stay_whole(spark):
    """A comma inside a value that the table knows as one does not part it."""
    known = ['"ALPHA BETA, PARS ALTERA"'] * 30
    assert split(spark, [*known, "ALPHA BETA, PARS ALTERA | GAMMA DELTA"])[-1] == ["ALPHA BETA, PARS ALTERA", "GAMMA DELTA"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abc XYZ:,|;\"", min_size=1, max_size=8).map(str.strip).filter(bool), min_size=1, max_size=5))
def test_quoted_round_trip(values):
    packed = " | ".join('"' + v.replace('"', '""') + '"' for v in values)
    plain, regions = multivalue.readings(packed)[0]
    assert not plain and regions.values("|") == [v.strip() for v in values]


def brute_cheapest(text, bits):
    """(cost, values) over every subset of the marks, each parsed by cutting the text at its characters."""
    marks = sorted({c for c in text if multivalue.separates(c)})
    best = None
    for size in range(len(marks), -1, -1):
        for chosen in itertools.combinations(marks, size):
            parts = [p.strip() for p in re.split("[" + "".join(map(re.escape, chosen)) + "]", text)] if chosen else [text.strip()]
            values = [p for p in parts if any(c.isalnum() for c in p)]
            alone = {m: max(0, sum(any(c.isalnum() for c in p) for p in text.split(m)) - 1) for m in marks}
            n = sum(alone[m] for m in chosen)
            cost = sum(map(bits, values)) + (n * math.log2(n) if n else 0) - sum(alone[m] * math.log2(alone[m]) for m in chosen if alone[m])
            cost -= size * math.log2(multivalue.SEPARATES) + (len(marks) - size) * math.log2(1 - multivalue.SEPARATES)
            if best is None or round(cost, 6) < best[0]:
                best = round(cost, 6), values
    return best


@settings(max_examples=80, deadline=None)
@given(st.text("abA :;,|/&#~\t=", max_size=24), st.dictionaries(st.text("abA ;,", min_size=1, max_size=4), st.floats(0.5, 9), max_size=6))
def test_cheapest_dialect_is_exact(text, book):
    """The search agrees with all 2^n dialects, for any number of marks and any code book."""
    text = text.strip()
    bits = lambda v: min(book.get(v, 1e9), multivalue.spelled_bits(v))
    (_, regions), *rest = multivalue.readings(text)
    spans = [(need, inner, n * bits(v), n * sum(map(str.isalnum, v)), n) for (need, inner, v), n in Counter(regions.spans()).items()]
    cost, _ = multivalue.cheapest(spans)
    want = brute_cheapest(text, bits) if any(c.isalnum() for c in text) else None
    assert not rest and (want is None or abs(cost - want[0]) < 1e-4)


def test_fields_of_many_marks(spark):
    """Ten marks of which three are known to belong to a value: the parse keeps them, which no subset close to all marks would."""
    known = ['"alpha & beta # gamma ~ delta"'] * 40
    assert split(spark, [*known, "one; two, three| four/ five= six\tseven; alpha & beta # gamma ~ delta"])[-1] == ["one", "two", "three", "four", "five", "six", "seven", "alpha & beta # gamma ~ delta"]


def test_empty_table(spark):
    assert multivalue.split_values(spark.createDataFrame([], "row_id long, field string, text string")).count() == 0


def test_orphans(spark):
    at = datetime(2024, 5, 1)
    refs = spark.createDataFrame([("t", 1, "f", "p", 7, at), ("t", 2, "f", "p", 8, at), ("t", 3, "f", "p", None, at), ("t", 4, "f", "p", 9, at), ("t", 5, "f", "p", 7, None), ("t", 6, "f", "q", 7, at)], "source_table string, row_id long, field string, target string, ref_key long, at timestamp")
    targets = spark.createDataFrame([("p", 7, at, None), ("p", 8, datetime(2024, 1, 1), at), ("p", 9, datetime(2024, 1, 1), datetime(2024, 2, 1)), ("p", 9, datetime(2024, 4, 1), None), ("p", None, at, None)], "target string, key long, created timestamp, ended timestamp")
    assert sorted(r["row_id"] for r in orphans.direct_orphans(refs, targets).collect()) == [2, 5, 6]
    assert orphans.direct_orphans(refs, targets.limit(0)).count() == 5 and orphans.direct_orphans(refs.limit(0), targets).count() == 0


def test_cascade(spark):
    direct = spark.createDataFrame([("a", 1)], "source_table string, row_id long")
    records = spark.createDataFrame([("a", 1, "k1"), ("b", 1, "k2"), ("b", 2, "k3"), ("c", 1, "k4"), ("c", 2, None)], "source_table string, row_id long, own_key string")
    links = spark.createDataFrame([("b", 1, "a", "k1"), ("b", 2, "a", "kx"), ("c", 1, "b", "k2"), ("a", 1, "c", "k4"), ("c", 2, "b", None)], "source_table string, row_id long, parent_table string, parent_key string")
    got = {(r["source_table"], r["row_id"]): r["level"] for r in orphans.cascade(direct, records, links).collect()}
    assert got == {("a", 1): 0, ("b", 1): 1, ("c", 1): 2}


def ring_contains(ring, x, y):
    inside = False
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
        if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
            inside = not inside
    return inside


@pytest.mark.parametrize("seed", range(12))
def test_triangulation(seed):
    """Star-shaped polygons with holes: areas agree, and triangles contain what even-odd says."""
    import math

    rnd = random.Random(seed)
    star = lambda cx, cy, lo, hi, n: [(cx + r * math.cos(2 * math.pi * i / n), cy + r * math.sin(2 * math.pi * i / n)) for i in range(n) for r in [rnd.uniform(lo, hi)]]
    rings = [star(0, 0, 3, 6, 24), star(-1, 0, 0.2, 0.6, 7), star(1.2, 0.4, 0.2, 0.7, 9)][: 1 + seed % 3]
    triangles, parity = geo.triangulate(rings)
    assert not parity and len(triangles) == sum(map(len, rings)) - 2 + 2 * (len(rings) - 1)
    for _ in range(300):
        x, y = rnd.uniform(-6, 6), rnd.uniform(-6, 6)
        want = sum(ring_contains(r, x, y) for r in rings) % 2 == 1
        assert want == any(geo._holds(*t, (x, y)) for t in triangles)


def test_crossing_ring_goes_by_parity():
    triangles, parity = geo.triangulate([[(0, 0), (4, 4), (4, 0), (0, 4)]])
    assert parity and sum(geo._holds(*t, (3.5, 2)) for t in triangles) % 2 == 1 and sum(geo._holds(*t, (2, 0.5)) for t in triangles) % 2 == 0


def test_regions(spark):
    square = '{"type":"Polygon","coordinates":[[[0,0],[2,0],[2,2],[0,2],[0,0]],[[0.5,0.5],[0.5,1],[1,1],[1,0.5],[0.5,0.5]]]}'
    right = '{"type":"MultiPolygon","coordinates":[[[[2,0],[4,0],[4,2],[2,2],[2,0]]],[[[10,10],[11,10],[11,11],[10,10]]]]}'
    regions = spark.createDataFrame([(1, square), (2, right), (3, None), (4, "{}"), (5, "nonsense"), (6, '{"type":"Point","coordinates":[0,0]}')], "region long, geometry string")
    points = spark.createDataFrame([(1, 1.5, 1.5), (2, 0.7, 0.7), (3, 1.0, 2.0), (4, 1.0, 3.0), (5, 10.2, 10.9), (6, None, 1.0), (7, 1.0, 1.7), (8, 50.0, 50.0), (9, 0.0, 0.0)], "key long, lat double, lon double")
    got = sorted(map(tuple, spatial.inside_regions(points, regions).collect()))
    assert got == [(1, 1), (3, 1), (4, 2), (5, 2), (7, 1), (9, 1)]  # a point on the shared edge counts once, for the lower region
    assert spatial.inside_regions(points, regions.limit(0)).count() == 0 and spatial.inside_regions(points.limit(0), regions).count() == 0


def test_near_pairs(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for i in range(60)]
    rows += [(100 + i, lat + rnd.uniform(-0.002, 0.002), lon + rnd.uniform(-0.002, 0.002)) for i, (_, lat, lon) in enumerate(rows) if abs(lat) < 89]
    rows += [(300, 10.0, 179.9999), (301, 10.0, -179.9999), (302, 89.9999, 0.0), (303, 89.9999, 180.0), (304, 5.0, 5.0), (305, 5.0, 5.0)]

    def km(a, b):
        import math

        p, q = math.radians(a[1]), math.radians(b[1])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * geo.EARTH_KM * math.asin(min(1, math.sqrt(h)))

    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and km(a, b) <= 0.2}
    got = [tuple(r) for r in spatial.near_pairs(spark.createDataFrame(rows, "key long, lat double, lon double"), 0.2).select("key_a", "key_b").collect()]
    assert len(got) == len(set(got)) and set(got) == want and {(300, 301), (302, 303), (304, 305)} <= want


def test_nearest_region(spark):
    square = '{"type":"Polygon","coordinates":[[[0,1],[1,1],[1,2],[0,2],[0,1]]]}'
    regions = spark.createDataFrame([(1, 0, square)], "region long, ord int, geometry string")
    points = spark.createDataFrame([(1, 0.0, 0.5), (2, 0.99, 0.5), (3, 0.99, 1.05)], "key long, lat double, lon double")
    got = {r["key"]: round(r["km"], 2) for r in spatial.nearest_region(points, regions, 200.0).collect()}
    assert got[1] == 110.57 and got[2] == 1.11 and len(got) == 3
    assert {r["key"] for r in spatial.nearest_region(points, regions, 5.0).collect()} == {2}


@pytest.mark.parametrize("name", ["p2_found", "p3_found", "p5_found", "p5_report"])
def test_odd_tables(spark, odd_tables, data, name):
    from tabulary.plans import catalog

    query = catalog.queries()[name]
    assert query(spark, str(odd_tables["empty"])).count() == 0 and query(spark, str(odd_tables["nulls"])).count() == 0
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(query(spark, str(odd_tables["clash"]))) == rows(query(spark, data))


def test_nearest_region_at_the_date_line_and_the_poles(spark):
    box = lambda x, y: f'{{"type": "Polygon", "coordinates": [[[{x}, {y}], [{x + 0.05}, {y}], [{x + 0.05}, {y + 0.05}], [{x}, {y + 0.05}], [{x}, {y}]]]}}'
    regions = spark.createDataFrame([(1, 1, box(179.9, 10.0)), (2, 2, box(-179.95, 40.0)), (3, 3, box(20.0, 89.6))], "region long, ord long, geometry string")
    points = spark.createDataFrame([(1, 10.02, -179.97), (2, 40.02, 179.99), (3, 89.7, 22.0), (4, 0.0, 0.0)], "key long, lat double, lon double")
    assert {r["key"]: r["region"] for r in spatial.nearest_region(points, regions, 15.0).collect()} == {1: 1, 2: 2, 3: 3}
