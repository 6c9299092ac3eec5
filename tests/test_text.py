from pyspark.sql import functions as F

from tabulary.functions import morphology as M
from tabulary.functions import similarity as Z
from tabulary.functions import text as X


def one(spark, make, *values):
    names = [f"c{i}" for i in range(len(values))]
    df = spark.createDataFrame([values], ", ".join(f"{n} string" for n in names))
    return df.select(make(*[F.col(n) for n in names]).alias("v")).first()["v"]


def test_latin_key(spark):
    for name, key in (("Amidae", "amide"), ("Aegyptus", "egiptus"), ("Philadelphia", "filadelfia"), ("Thilbisme", "tilbisme"), ("", ""), (None, "")):
        assert one(spark, X.latin_key, name) == key


def test_clean_name(spark):
    assert one(spark, X.clean_name, "  (Sīscia)  nova. ") == "Siscia) nova"
    assert one(spark, X.clean_name_local, "(castra) ..Siscia") == "Siscia"
    assert one(spark, X.clean_name_local, "-12.5") == "12.5"  # why it must not see coordinates
    assert one(spark, X.clean_name, "Æmona") == "Aemona"


def test_norms_differ(spark):
    assert one(spark, X.norm_gazetteer, "Uico. (Nova)") == "uico nova "
    assert one(spark, X.norm_probe, "Juvavum") == "ivvavvm"
    assert one(spark, X.norm_province, "Phrygia V") == "frigia u"
    assert one(spark, X.norm_label, "Asia.. ") == "asia."
    assert one(spark, X.norm_form, "ﬁnes;:") == "fines"
    assert one(spark, X.document_key, "Occidens") == "occidentis" and one(spark, X.document_key, "pars_oriens") == "pars oriens"


def test_stems(spark):
    assert one(spark, X.stem_key, "Insignia viri illustris magistri peditum in praesenti") == ["magistr", "pedit", "praesent"]


def test_block_type(spark):
    assert one(spark, X.block_type, "Sub dispositione viri") == "Sub dispositione"
    assert one(spark, X.block_type, "Duces duodecim") == "Duces" and one(spark, X.block_type, "Magistri scriniorum quattuor omnes") == "Magistri scriniorum"


def test_lists(spark):
    assert one(spark, X.latin_list, "scutorum, scordiscorum et armorum.") == ["scutorum", "scordiscorum", "armorum"]
    assert one(spark, X.without_prefix, "Sirmensis scutaria.", "Sirmensis") == "scutaria"
    assert one(spark, X.without_prefix, "Sirmensisx", "Sirmensis") == "Sirmensisx"


def test_highlight_and_escape(spark):
    assert one(spark, lambda c: X.highlighted(c, ["ala", "alae"]), "Ala et alae") == "<mark>Ala</mark> et <mark>alae</mark>"
    assert one(spark, X.html_escaped, "<a & 'b'>") == "&lt;a &amp; &#39;b&#39;&gt;"
    assert one(spark, X.unquoted, '"say ""x"""') == 'say "x"'


def test_case_variants(spark):
    assert one(spark, M.case_variants, "Amidae") == ["Amidae", "Amida", "Amidais"]
    assert one(spark, M.case_variants, "Altino") == ["Altino", "Altinum", "Altinus", "Altinos"]
    assert one(spark, M.case_variants, "") == []
    assert [v[0] for v in variants(spark, "Altino", "")] == ["Altino", "Altinum", "Altinus", "Altinos"]


def test_toponymic(spark):
    made = one(spark, M.toponymic_variants, "Sirmiensis")
    assert made[0]["value"] == "Sirm" and made[0]["rule"] == "toponymic_iensis_stem" and "Sirmium" not in [m["value"] for m in made]


def variants(spark, name, source):
    rows = M.variant_rows(spark.createDataFrame([(name, source)], "place_name string, place_source string")).orderBy("ord").collect()
    assert [r["ord"] for r in rows] == list(range(len(rows)))
    return [(r["value"], r["rule"], r["tier"]) for r in rows]


def test_candidates_order(spark):
    assert variants(spark, "Resain - Theodosiopoli", "tail")[:3] == [("Resain - Theodosiopoli", "original", 0), ("Resain", "alias", 0), ("Theodosiopoli", "alias", 0)]
    assert [v[0] for v in variants(spark, "sirmensis", "factory")] == ["sirmensis", "Sirmium"]
    assert ("Castra Martis", "in_castris", 0) in variants(spark, "milites in castris Martis", "tail")
    assert variants(spark, None, None) == [] and variants(spark, "", "limes")[0][0] == "Limes"


def test_qualifiers(spark):
    assert one(spark, M.qualifier_variants, "Augusta (Raetia ii)") == ["raetia ii", "raetia secunda"]
    assert one(spark, M.qualifier_variants, "Augusta") == []


def test_edit_distance(spark):
    bounded = lambda a, b: one(spark, lambda x, y: Z.bounded_edits(x, y, 2), a, b)
    assert (bounded("amide", "amida"), bounded("abc", "abcdef"), bounded("", "ab"), bounded("", "")) == (1, 3, 2, 0)


def test_scores(spark):
    assert one(spark, Z.expected_to_actual, "Aegypti", "AEGYPTUS HERCULIA") == 1.0
    assert one(spark, Z.expected_to_actual, "dux", "ASIA") == 0.0
    assert one(spark, Z.similarity, "", "a") == 0.0
    assert one(spark, Z.actual_to_context, "ASIA", "provincia Asiae") == 1.0
    assert one(spark, Z.sequence_ratio, "abcd", "bcde") == 0.75
    assert one(spark, Z.provinces_compatible, "Syria", "Syriae") and not one(spark, Z.provinces_compatible, "", "Syria")
    assert one(spark, Z.stem_score, "Mesopotamia", "in mesopotamiae finibus") == 100
