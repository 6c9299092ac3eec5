import random

import pytest
from pyspark.sql import functions as F

from tabulary.functions import rules as R
from tabulary.operators import audit, extract, linkage, pages, relational, render, resolve, search, tree
from tabulary.sources import readers, writers

SOURCE = """XXXVI. Dux Mesopotamiae.
Sub dispositione viri spectibilis ducis Mesopotamiae:
     Equites scutarii Illyriciani, Amidae.
     Equites promoti Illyriciani, Resain - Theodosiopoli.
     Item:
          Ala secunda nova Aegyptiorum, Cartha.
Officium autem habet ita:
     Principem.
     Habet autem dignitates:
II. Comes.
     Fabricae sunt infrascriptae:
          scutaria Augusta.
     Alia:"""


def lines(spark):
    return tree.with_chapters(tree.lines_of(spark.createDataFrame([("D", SOURCE)], "document string, text string")))


def test_chapter_tree(spark):
    nodes = {r["line"]: r for r in tree.parse_chapters(lines(spark), R.HEADINGS, R.UNITS).collect()}
    assert (nodes[2]["type"], nodes[3]["tag"], nodes[6]["parent_line"], nodes[7]["type"], nodes[8]["suppress"]) == ("administration", "equites", 5, "officium", True)
    assert nodes[11]["type"] == "factoryGroup" and nodes[12]["tag"] == "factory" and nodes[13]["parent_line"] == 11
    assert [p["line"] for p in nodes[6]["path"]] == [2, 5]


def test_headings_match_the_stack(spark):
    by_window = {r["line"]: r["parent_line"] for r in tree.headings_by_indent(lines(spark)).collect()}
    rows = sorted(lines(spark).collect(), key=lambda r: r["line"])
    stack, chapter = [], None
    for r in rows:
        if r["chapter_no"] != chapter:
            stack, chapter = [], r["chapter_no"]
        while stack and r["level"] <= stack[-1][1]:
            stack.pop()
        assert by_window[r["line"]] == (stack[-1][0] if stack else None)
        if r["label"].endswith(":"):
            stack.append((r["line"], r["level"]))


def test_chapter_ranges_and_roman(spark):
    ranges = sorted(map(tuple, tree.chapter_ranges(lines(spark)).select("line_start", "line_end").collect()))
    assert ranges == [(1, 9), (10, 13)]
    n = spark.range(0, 4001).select("id", tree.roman(F.col("id")).alias("r")).withColumn("b", tree.roman_number(F.col("r")))
    assert n.where("id between 1 and 3999 and b <> id").count() == 0
    assert n.where("id in (0, 4000) and r = ''").count() == 2 and n.where("id = 36 and r = 'XXXVI'").count() == 1


def test_tree_checks(spark):
    nodes = spark.createDataFrame([("a", None, 0, "document"), ("b", "a", 1, "chapter"), ("c", "z", 1, "block"), ("d", "e", 1, "x"), ("e", "d", 2, "x"), ("f", "f", 0, "x")], "node_id string, parent_id string, level int, kind string")
    problems = {(r[0], r[1]) for r in tree.check_tree(nodes).collect()}
    assert {("b", "CHAPTER_TITLE"), ("c", "MISSING_PARENT"), ("c", "EMPTY_BLOCK"), ("f", "SELF_PARENT")} <= problems
    assert {r["node_id"] for r in tree.unreachable(nodes.select("node_id", "parent_id")).collect()} == {"c", "d", "e", "f"}


def test_xml_round_trip(spark):
    texts = spark.createDataFrame([("D", "<root><chapter id='1'><title>Dux</title><unit>Ala &amp; x</unit></chapter></root>"), ("bad", "<a>"), ("none", None)], "document string, text string")
    nodes = readers.xml_tree(texts)
    assert {r["tag"] for r in nodes.collect()} == {"root", "chapter", "title", "unit"}
    again = readers.xml_tree(writers.tree_xml(nodes))
    key = lambda df: sorted(map(tuple, df.select("index_path", "tag", "text").collect()))
    assert key(nodes) == key(again)


def test_search_language():
    assert [t[0] for t in search.tokens("(LATIN x)")] == ["(", "term", "in", "term", ")"]  # operators in capitals count within words
    assert search.simple_boolean("a and b and c") is None and search.simple_boolean("a or b") == ("a", "or", "b")
    node = search.parse("A libellis IN (Dux AND Oriens)")
    assert node.kind == "in" and node.left.value == "a libellis" and node.right.kind == "and"
    assert search.parse("(a") is None and search.parse("IN") is None and search.display_terms("A NOT IN (b OR c)") == ["a", "b", "c"]


def test_search_scores(spark):
    rows = [(1, "Equites scutarii", "x", "Dux Arabiae"), (2, "scutarii", None, None), (3, "prescutarii", "", "scutaria"), (4, None, None, None)]
    fields = (search.Field("text", 140), search.Field("unit", 120), search.Field("chapter", 80, "context"))
    index = search.index(spark.createDataFrame(rows, "id long, text string, unit string, chapter string"), fields)
    score = lambda q: {r["id"]: r["score"] for r in search.search(index, q, fields).collect()}
    assert score("scutarii") == {1: 1000890890, 2: 1001141140}
    assert score("scut") == {1: 10**9 + 690 * 1000 + 690, 2: 10**9 + 690 * 1000 + 690, 3: 10**9 + 510 * 1000 + 510}
    assert score("equites IN dux") == {1: (10**9 + 890890) + (710 * 1000 + 710) + 5000}
    assert set(score("scutarii NOT IN dux")) == {2, 3} and score("") == {} and score("(") == {}
    assert set(score("equites or zzz")) == {1}


def test_relational(spark):
    df = spark.createDataFrame([(1, "a", None), (1, "b", 2), (None, "c", 1), (None, "d", 0)], "k int, v string, n int")
    assert {r["v"] for r in relational.keep_one(df, ["k"], F.asc_nulls_last("n")).collect()} == {"b", "d"}
    ids = [r["id"] for r in relational.sequential_ids(df, "G%03d", "id", F.asc("v")).orderBy("v").collect()]
    assert ids == ["G001", "G002", "G003", "G004"]
    assert {(r["k"], r["position"], r["v"]) for r in relational.positions(df, ["k"], F.asc("v")).collect()} == {(1, 1, "a"), (1, 2, "b"), (None, 1, "c"), (None, 2, "d")}
    assert relational.keep_one(df.limit(0), ["k"], F.asc("n")).count() == 0
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), (None, "q")], "a string, b string")
    assert {r[0] for r in relational.closure(edges, spark.createDataFrame([("a",)], "node string")).collect()} == {"a", "b", "c"}
    filled = relational.update_blanks(spark.createDataFrame([(1, "", None), (2, "q", None), (3, None, 1.0)], "k int, t string, x double"), spark.createDataFrame([(1, "new", 5.0), (2, "no", 6.0)], "k int, t string, x double"), "k", ["t", "x"])
    assert {tuple(r) for r in filled.select("k", "t", "x").collect()} == {(1, "new", 5.0), (2, "q", 6.0), (3, None, 1.0)}
    rules = spark.createDataFrame([(1, "Comes limitis", "L"), (2, "Comes", "C")], "priority int, pattern string, value string")
    texts = spark.createDataFrame([("Comes limitis X",), ("Comes",), ("Com",), (None,)], "t string")
    assert [r["value"] for r in relational.first_rule(texts, "t", rules).orderBy(F.asc_nulls_last("t")).collect()] == [None, "C", "L", None]


def test_extraction():
    g = extract.Reader(["africae", "arabiae", "daciae ripensis"])
    assert g.station("Cartha, nunc Sala") == [("place", "Cartha", "tail"), ("place", "Sala", "alternate")]
    assert g.station("Siscia in Africae") == [("place", "Siscia", "tail"), ("province", "Africae", "tail")]
    assert g.station("Aquis daciae ripensis") == [("place", "Aquis", "tail"), ("province", "daciae ripensis", "tail")]
    assert g.station("contra Acinco in barbarico in castello Onagrino") == [("place", "Onagrino", "castello")]
    assert g.station("prope Bononia") == [("place", "Bononia", "prope")] and g.station("A siue B") == [("place", "A", "tail"), ("place", "B", "tail")]
    assert g.workshop("scutaria Augusta") == ("scutaria", [("place", "Augusta", "factory")])
    assert g.within("thesaurorum per Syriam et Romam - x", "praepositus") == [("place", "per Syriam", "unit"), ("place", "Romam", "unit")]
    assert g.line("limitis Tentheitani", "", "", True) == [("place", "Tentheitani", "limes")]
    assert g.station("") == []


def test_unit_fields(spark):
    df = spark.createDataFrame([("Praefectus legionis primae [sic], Constantina.",), ("",), (None,)], "t string")
    rows = df.select(*[c.alias(n) for n, c in extract.unit_fields(F.col("t")).items()]).collect()
    assert tuple(rows[0]) == ("Praefectus", "praefectus", "legionis primae", "Constantina") and rows[1]["unit"] == "" and rows[2]["tail"] == ""


def decided(spark, rows):
    schema = "occ_id string, place_id int, method string, similarity double, tier int, context_status string, feature_score int, place_source string, has_hard boolean"
    return {r["occ_id"]: (r["outcome"], r["place_id"], r["match_type"], r["is_conflict"]) for r in resolve.decide(spark.createDataFrame(rows, schema)).collect()}


def test_decisions(spark):
    got = decided(spark, [
        ("hard", 1, "EXACT", 1.0, 0, "HARD_MATCH", 0, "", True), ("hard", 2, "EXACT", 1.0, 0, "HARD_MISMATCH", 0, "", True),
        ("near", 3, "FUZZY", 0.95, 0, "HARD_NEAR_MATCH", 0, "", True), ("blank", 4, "FUZZY", 0.87, 0, "SOFT_MATCH", 0, "", False),
        ("conflict", 5, "EXACT", 1.0, 0, "HARD_MISMATCH", 0, "", True), ("lone", 6, "EXACT", 1.0, 0, "NO_CONTEXT", 0, "", False), ("limes", 7, "FUZZY", 0.95, 0, "NO_CONTEXT", 0, "limes", False),
        ("fort", 8, "EXACT", 1.0, 0, "NO_CONTEXT", 4, "", False), ("fort", 9, "EXACT", 1.0, 0, "NO_CONTEXT", 2, "", False), ("tie", 10, "EXACT", 1.0, 0, "NO_CONTEXT", 2, "", False), ("tie", 11, "EXACT", 1.0, 0, "NO_CONTEXT", 2, "", False),
        ("region", 12, "EXACT", 1.0, 0, "REGION_MATCH", 0, "", False), ("region", 13, "EXACT", 1.0, 0, "REGION_MISMATCH", 0, "", False),
    ])
    more = decided(spark, [
        ("two", 1, "EXACT", 1.0, 0, "SOFT_MISMATCH", 0, "", False), ("two", 2, "EXACT", 1.0, 0, "NO_CONTEXT", 0, "", False),
        ("open", 1, "EXACT", 1.0, 0, "HARD_MISMATCH", 0, "", True), ("open", 2, "EXACT", 1.0, 0, "HARD_UNVERIFIED", 0, "", True),
        ("mixed", 1, "EXACT", 1.0, 0, "HARD_MISMATCH", 0, "", True), ("mixed", 2, "EXACT", 1.0, 0, "SOFT_MATCH", 0, "", True),
        ("wide", 1, "EXACT", 1.0, 0, "SOFT_MATCH", 2, "", False), ("wide", 2, "EXACT", 1.0, 0, "SOFT_MATCH", 2, "", False), ("wide", 3, "EXACT", 1.0, 0, "SOFT_NEAR_MATCH", 4, "", False),
        ("nulls", 1, "FUZZY", None, 0, "NO_POLYGON", 0, None, None),
    ])
    assert more["two"] == ("AMBIGUOUS", None, None, False) and more["open"] == ("AMBIGUOUS", None, None, False)
    assert more["mixed"] == ("AMBIGUOUS", None, None, True)  # soft evidence never decides beside a hard province
    assert more["wide"] == ("MATCH", 3, "FEATURE_EXACT", False) and more["nulls"][0] == "AMBIGUOUS"
    assert got["hard"] == ("MATCH", 1, "CONTEXT_EXACT", False) and got["near"] == ("MATCH", 3, "CONTEXT_NEAR_FUZZY", False)
    assert got["blank"] == ("MATCH", 4, "", False)  # a lone confirmed near form below 0.90 has no type
    assert got["conflict"] == ("MATCH", 5, "CONTEXT_CONFLICT_EXACT", True) and got["lone"][2] == "EXACT_NO_CONTEXT" and got["limes"][0] == "AMBIGUOUS"
    assert got["fort"][1:3] == (8, "FEATURE_EXACT") and got["tie"][0] == "AMBIGUOUS" and got["region"][2] == "REGION_EXACT"


def test_rendering(spark):
    df = spark.createDataFrame([("scutaria",), ("scutaria et hastaria",), ("sagittaria, mirabilia",), ("armorum omnium.",), ("",), (None,)], "d string")
    got = [tuple(r) for r in df.select(*[c.alias(n) for n, c in render.factory_phrase(F.col("d")).items()]).collect()]
    assert got[:5] == [("shield factory", []), ("shield and spear factory", []), ("arrow and mirabilia factory", ["mirabilia"]), ("factory for all kinds of arms", []), ("factory", [])] and got[5][0] == "factory"


@pytest.mark.parametrize("cutoff", [0.55, 0.7])
def test_letters_lose_no_likeness(spark, cutoff):
    """Every pair that reaches the cutoff meets, also without a pair of letters in common; pairs that do not meet cannot reach it."""
    from difflib import SequenceMatcher

    rnd = random.Random(3)
    texts = sorted({"oea", "oreia", "a", "ab", "ba", "é", "aaaa", "aabb", *("".join(rnd.choice("abcdeiorst ") for _ in range(rnd.randint(1, 9))).strip() for _ in range(160))} - {""})
    df = spark.createDataFrame([(t,) for t in texts], "a string")
    met = {tuple(r) for r in linkage.meet_by_letters(df, df.withColumnRenamed("a", "b"), cutoff).collect()}
    like = {(a, b) for a in texts for b in texts if SequenceMatcher(None, a, b).ratio() >= cutoff}
    assert like <= met and ("oea", "oreia") in met
    names = spark.createDataFrame([(1, "Oreia"), (2, "Oea"), (3, "Roma"), (4, None)], "place_id int, name string")
    got = linkage.province_candidates(spark.createDataFrame([("Oea",), (None,), ("",)], "province string"), names)
    assert [(r["rank"], r["place_id"], r["score"]) for r in got.orderBy("rank").collect()] == [(1, 2, "1.000"), (2, 1, "0.750")]


def test_pages_and_audit(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, n int")
    assert sorted(r["n"] for r in pages.keep_all_if_empty(df, "k", F.col("n") == 1).collect()) == [1, 3]
    try:
        audit.require_columns(df, ["k", "missing"])
        raise AssertionError("must fail")
    except ValueError:
        pass
    assert [tuple(r) for r in audit.frequency(df, "k", 1, "n").collect()] == [("a", 2, 1)]


def test_delimited(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('﻿id;name\n1;"a ""q""; b"\n;\n2;x,y\n', encoding="utf-8")
    back = readers.read_delimited(spark, str(path))
    assert [tuple(r) for r in back.orderBy("id").collect()] == [("1", 'a "q"; b'), ("2", "x,y")]


def test_streams(spark, tmp_path, data):
    from tabulary.streaming import incremental

    events = spark.read.parquet(f"{data}/events.parquet").select(F.col("user_id"), F.col("event_type").alias("node"), F.col("ts").cast("timestamp").alias("ts"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = incremental.table_stream(spark, str(tmp_path / "in"), 1)
    incremental.drain(incremental.windowed_counts(stream, "ts", "node", late="400 days"), str(tmp_path / "out"), str(tmp_path / "c1"))
    assert spark.read.parquet(str(tmp_path / "out")).count() >= 0


def test_json_arrays_that_end_or_go_wrong(tmp_path):
    import pandas as pd

    def items(text, chunk=1 << 20):
        path = tmp_path / "g.json"
        path.write_text(text, encoding="utf-8")
        return [i for f in readers.json_array_items(iter([pd.DataFrame({"uri": [path.as_uri()]})]), chunk=chunk) for i in f["item"]]

    assert items('{"@graph":[1234567,89 , "a"]}', chunk=3) == ["1234567", "89", '"a"'] and items('{"x": "@graph", "@graph" : []}') == []
    assert items('{"pad": "' + "x" * 10_000 + '", "@graph": [1]}', chunk=64) == ["1"]
    for broken in ('{"@graph":[{"a":1},{"a":2},{"a":', '{"@graph":[1', '{"x":[1]}', "", '{"@graph":[1 2]}'):
        with pytest.raises(ValueError):
            items(broken)


def test_writers_replace_whole_folders(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([(1, "a")], "id int, v string")
    writers.write_delimited(df, path, ["id", "v"])
    with pytest.raises(Exception):  # noqa: B017  a write that fails leaves what was there
        writers.write_delimited(df.select("id", F.raise_error(F.lit("stop")).cast("string").alias("v")), path, ["id", "v"])
    assert [tuple(r) for r in readers.read_delimited(spark, path).collect()] == [("1", "a")] and len(list(tmp_path.iterdir())) == 1
    writers.write_delimited(df.limit(0), path, ["id", "v"])
    assert spark.read.csv(path).count() <= 1


def test_selections(spark):
    clicks = spark.createDataFrame([(1, "A", "x", 5), (2, "a ", None, 9), (3, "B", "q", 1), (4, None, "x", 1)], "id int, name string, qualifier string, line int")
    mentions = spark.createDataFrame([(10, "A", "x", 5), (11, "A", "y", 9), (12, "A", "x", 7), (13, "b", None, 3)], "mention_id int, name string, qualifier string, line int")
    got = {r["id"]: (r["shown"], r["selected"]) for r in pages.selected_mentions(clicks, mentions).collect()}
    assert got == {1: (2, 10), 2: (3, 11), 3: (1, 13), 4: (0, None)}
    there = spark.createDataFrame([(1, 1, "A", "d", "c", None, ""), (2, 2, "A", "d", "c", "u", None), (3, 3, "A", None, None, None, None)], "occurrence_id int, ord int, name string, document string, chapter string, unit string, office string")
    places = spark.createDataFrame([(1, ["a", None], "D", "c", "U", None), (2, ["A"], None, None, None, None), (3, ["z"], "d", "c", "u", "o")], "id int, names array<string>, document string, chapter string, unit string, office string")
    assert {r["id"]: (r["occurrence_id"], r["score"]) for r in pages.picked_occurrences(places, there).collect()} == {1: (2, 11), 2: (1, 0)}


def test_unique_keys(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    assert relational.assert_unique(df, ["v"]).count() == 3
    with pytest.raises(Exception, match="duplicate key: 1"):
        relational.assert_unique(df, ["k"]).collect()


def test_json_array_in_chunks(spark, tmp_path):
    import json

    path = tmp_path / "graph.json"
    path.write_text("﻿" + json.dumps({"x": [1], "@graph": [{"id": i, "t": "é" * 50} for i in range(500)], "y": 2}), encoding="utf-8")
    import pandas as pd

    rows = pd.concat(readers.json_array_items(iter([pd.DataFrame({"uri": [path.as_uri()]})]), chunk=777))
    assert len(rows) == 500 and json.loads(rows["item"].iloc[499]) == {"id": 499, "t": "é" * 50}
    assert readers.json_array(spark, [path.as_uri()]).count() == 500


def test_most_shared_is_the_best_of_all_pairs(spark):
    chance = random.Random(3)
    weights = {"a": 4, "b": 3, "c": 4, "d": 25}
    row = lambda: tuple(chance.choice([None, 1, 2, 3]) for _ in weights)
    seekers = [(i, chance.choice("xyz"), *row()) for i in range(150)] + [(149, "x", 1, 1, 1, 1)] * 2
    offers = [(chance.choice("xxy"), *row(), chance.choice([-30, -20, 0, 5]), i // 2, f"o{i}") for i in range(60)]
    want = {}
    for i, key, *mine in seekers:
        scores = [(w + sum(v for v, m, t in zip(weights.values(), mine, theirs, strict=True) if m is not None and m == t), o, name) for k, *theirs, w, o, name in offers if k == key]
        for points, o, name in scores:
            want[i] = min(want.get(i, (0, 10**9)), (-max(points, 0), o, -points, name))
    columns = ", ".join(f"{c} int" for c in weights)
    got = relational.most_shared(spark.createDataFrame(seekers, f"id int, key string, {columns}"), spark.createDataFrame(offers, f"key string, {columns}, worth int, ord int, offer string"), weights)
    assert {r["id"]: (r["offer"], r["score"]) for r in got.collect()} == {i: (w[3], -w[2]) for i, w in want.items()} and got.count() == len(want)


MENTIONS, GAZETTEER = "id int, place_name string, line int, qualifier string", "place_id string, name string, line int, qualifier string, confidence string, ord int"


def test_scored_with_overrides_pairs_nothing(spark):
    mentions = spark.createDataFrame([(1, "A ", 5, "Fort"), (2, "a", 5, ""), (3, "a", None, None), (4, "B", 5, "fort"), (4, "B", 5, "fort"), (5, "c", 5, "fort"), (6, None, 5, "fort")], MENTIONS)
    gazetteer = [("p", "a", 5, "", "hold", 1), ("q", "A", 5, "FORT", "hold", 2), ("r", "a", None, None, "accepted", 3), ("s", "a", 6, "fort", "provisional", 4), ("t", "b", 5, "fort", "accepted", 5), ("u", "c", 9, "", "Hold", 6), ("v", "C", 9, "x", None, 7)]
    overrides = spark.createDataFrame([("B", "X")], "place_name string, place_id string")
    got = resolve.scored(mentions, spark.createDataFrame(gazetteer, GAZETTEER), overrides)
    assert sorted(map(tuple, got.collect())) == [(1, "q", 255), (2, "p", 230), (3, "r", 5), (4, "X", 1000), (5, "u", -20)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 3  # with the overrides, for the result and for what they leave, and of what they leave; the gazetteer is in none


def test_picked_occurrences_pair_nothing(spark):
    there = spark.createDataFrame([(5, 5, "A ", "d", "c", None, ""), (6, 6, "a", "d", " ", "u", "o"), (7, 7, "B", "d", "c", "u", "o")], "occurrence_id int, ord int, name string, document string, chapter string, unit string, office string")
    places = spark.createDataFrame([(1, ["a", "b"], "D", "c", "x", "o"), (2, ["A", None], "d", "C", "u", None), (2, ["A", None], "d", "C", "u", None), (3, ["", " "], "d", "c", "u", "o")], "id int, names array<string>, document string, chapter string, unit string, office string")
    got = pages.picked_occurrences(places, there)
    assert sorted(map(tuple, got.collect())) == [(1, 7, 10), (2, 5, 8)]
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
