from tests.conftest import DATA

from tabulary.plans import link_queries, publish_queries, text_queries


def folder(spark, tmp_path, **tables):
    """A folder of test tables with the given rows (dicts; columns left out are null)."""
    for name, rows in tables.items():
        schema = spark.read.parquet(f"{DATA}/{name}.parquet").schema
        spark.createDataFrame([tuple(r.get(c) for c in schema.names) for r in rows], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_rank_uses_the_context_score(spark, tmp_path):
    row = lambda i, status, score, name: {"rowId": i, "occurrenceId": "o", "contextStatus": status, "contextScore": score, "nameSimilarity": name}
    rows = [row(1, "SOFT_MISMATCH", 0.1, 1.0), row(2, "SOFT_MISMATCH", 0.7, 0.9), row(3, "SOFT_MISMATCH", None, 1.0), row(4, "HARD_MATCH", 0.0, 0.8), row(5, "SOFT_MISMATCH", 0.7, 0.95)]
    ranked = link_queries.resolve_rank(spark, folder(spark, tmp_path, place_conflict_context=rows)).orderBy("candidate_rank").collect()
    assert [r["row_id"] for r in ranked] == [4, 5, 2, 1, 3]


def test_context_status_expands_targets_and_falls_through(spark, tmp_path):
    row = lambda i, **more: {"rowId": i, "contextText": "", **more}
    rows = [
        row(1, hardProvince="Belagulia maior", gisProvince="BELAGULIAE MAIOR"),  # alike
        row(2, hardProvince="Nusquam", gisProvince="TUSCOVIA"),  # stands for the second packed name
        row(3, hardProvince="Nusquam", gisProvince="BELAGULIAE MAIOR"),
        row(4, hardProvince="Xyz", softProvince="Tuscovia", gisProvince="TUSCOVIA"),  # unknown, so soft
        row(5, hardProvince="Xyz", softProvince="Qqq", region="In Italia", gisProvince="CAMPANIA"),  # unknown, so region
        row(6, hardProvince="Xyz", chapter="Dux Tuscoviae", contextText="Dux Tuscoviae", gisProvince="TUSCOVIA"),  # unknown, so chapter
        row(7, softProvince="Xyz", chapter="Dux Tuscoviae", nearestProvince="CAMPANIA", nearestKm=3.0, contextText="in Tuscovia"),
        row(8, hardProvince="Xyz", chapter="Dux Alienus", gisProvince="TUSCOVIA"),
        row(9, hardProvince="Thebaidos", nearestProvince="THEBAIS", nearestKm=1.0),  # a fixed form
        row(10, hardProvince="Xyz"),
    ]
    polygons = [{"geojsonId": i, "gisProvince": n} for i, n in enumerate(("BELAGULIAE MAIOR", "TUSCOVIA", "CAMPANIA", "THEBAIS"))]
    gazetteer = [{"rowId": 1, "canonicalName": "nusquam", "geojsonNames": '"ALIA, QUAE ET MAIOR"; TUSCOVIA'}]
    got = link_queries.resolve_context_status(spark, folder(spark, tmp_path, place_conflict_context=rows, province_polygon=polygons, province_gazetteer=gazetteer))
    assert [(r["context_status"], r["full_score"]) for r in got.orderBy("row_id").collect()] == [
        ("HARD_MATCH", 1), ("HARD_MATCH", 1), ("HARD_MISMATCH", 0), ("SOFT_MATCH", 1), ("REGION_MATCH", 1), ("SOFT_MATCH", 1), ("SOFT_NEAR_MISMATCH", 0), ("NO_CONTEXT", 0), ("HARD_NEAR_MATCH", 1), ("NO_POLYGON", 0),
    ]


def test_tails_are_split_at_every_known_province(spark, tmp_path):
    row = lambda i, name, region: {"rowId": i, "unit": "Cohors prima", "placeName": name, "region": region}
    rows = [row(1, "Amida", "Mesopotamiae"), row(2, "Ad Fontes", "Nusquam minore"), row(3, "Tuscovia", None), row(4, "Altera apuliae et calabriae", None)]
    gazetteer = [{"rowId": 1, "canonicalName": "Nusquam minor", "notitiaForms": "Nusquam minor|Nusquam  minore"}]
    got = text_queries.extract_tail_geo(spark, folder(spark, tmp_path, place_conflict_context=rows, province_gazetteer=gazetteer, province_polygon=[{"geojsonId": 1, "gisProvince": "TUSCOVIA"}]))
    assert [(r["tag"], r["value"]) for r in got.orderBy("tail", "ord").collect()] == [
        ("place", "Ad Fontes"), ("province", "Nusquam minore"), ("place", "Altera"), ("province", "apuliae et calabriae"), ("place", "Amida"), ("province", "Mesopotamiae"), ("province", "Tuscovia"),
    ]


def test_every_packed_reference_is_looked_up(spark, tmp_path):
    names = ['"TUSCOVIA, ORA"', ", CAMPANIA", "CAMPANIA / Nusquam\tTuscovia, ora", None, "“CAMPANIA”；“TUSCOVIA, ORA”", ""]
    polygons = [{"geojsonId": 7, "gisProvince": "CAMPANIA"}, {"geojsonId": 8, "gisProvince": "TUSCOVIA, ORA"}, {"geojsonId": 9, "gisProvince": "CAMPANIA"}]
    sf = folder(spark, tmp_path, province_gazetteer=[{"rowId": i, "geojsonNames": n} for i, n in enumerate(names)], province_polygon=polygons)
    got = publish_queries.province_references(spark, sf).orderBy("id", "position").collect()
    assert [(r["id"], r["polygon"]) for r in got if r["id"] != 2] == [(0, "8"), (1, "9"), (3, ""), (4, "9"), (4, "8"), (5, "")]
    assert [r["polygon"] for r in got if r["id"] == 2][:2] == ["9", ""]


def test_resolve_scored_pairs_nothing(spark, tmp_path):
    row = lambda i, name, line, tier, place: {"rowId": i, "candidate": name, "pleiadesName": name.lower(), "sourceLine": line, "tier": tier, "pleiadesId": place}
    rows = [row(1, "A", 5, 2, "p"), row(2, "A", 6, 0, "q"), row(3, "a ", None, 1, "r"), row(3, "a ", None, 1, "r"), row(4, "a", 5, None, "s"), row(5, "B", 1, 2, "t")]
    got = link_queries.resolve_scored(spark, folder(spark, tmp_path, place_conflict_context=rows))
    assert sorted(map(tuple, got.collect())) == [(1, "p", 230), (2, "q", 255), (3, "q", 5), (4, "p", 230), (5, "t", 230)]
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
