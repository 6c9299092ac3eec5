"""Entity resolution: candidates, context scores, and the decision between match, conflict, ambiguous and unmatched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulary.functions.morphology import variant_rows
from tabulary.functions.rules import feature_score, macro_region, non_point
from tabulary.functions.similarity import AUTO_SIMILARITY, CONTEXT_THRESHOLD, MIN_MARGIN, NEAR_KM, best_form_ratio, forms_context, forms_likeness, name_forms, provinces_compatible
from tabulary.functions.text import clean_name, latin_key, norm_name
from tabulary.operators.linkage import blocked_fuzzy_join
from tabulary.operators.relational import keep_one, most_shared
from tabulary.session import written

# The weight of a context status in ranking.
STATUS_WEIGHT = {"HARD_MATCH": 7, "HARD_NEAR_MATCH": 6, "SOFT_MATCH": 5, "SOFT_NEAR_MATCH": 4, "REGION_MATCH": 3, "REGION_NEAR_MATCH": 2}
# The large regions and their provinces.
REGIONS = {
    "ITALIA": ["AEMILIA ET LIGURIA", "APULIA ET CALABRIA", "CAMPANIA", "FLAMINIA ET PICENUM", "LUCANIA ET BRUTTII", "TUSCIA ET UMBRIA", "VENETIA ET HISTRIA", "SICILIA", "SARDINIA", "CORSICA"],
    "GALLIAE": ["AQUITANIA I", "AQUITANIA II", "BELGICA I", "BELGICA II", "GERMANIA I", "GERMANIA II", "LUGDUNENSIS I", "LUGDUNENSIS II", "NARBONENSIS I", "NARBONENSIS II", "NOVEM POPULI", "SEQUANIA", "VIENNENSIS", "ALPES COTTIAE", "ALPES GRAIAE ET POENINAE", "ALPES MARITIMAE"],
    "BRITANNIA": ["BRITANNIAE I AND II"],
    "ILLYRICUM": ["PANNONIA INFERIOR", "PANNONIA SUPERIOR", "SAVIA", "NORICUM MEDITERRANEUM", "NORICUM RIPENSE", "DALMATIA", "PRAEVALITANA", "DARDANIA", "DACIA MEDITERRANEA", "DACIA RIPENSIS", "MACEDONIA", "ACHAIA", "EPIRUS NOVA", "EPIRUS VETUS", "THESSALIA"],
    "ORIENS": ["SYRIA COELE", "PHOENICE", "AUGUSTA LIBANENSIS", "PALAESTINA", "ARABIA", "CILICIA", "CYPRUS", "OSRHOENE", "MESOPOTAMIA", "AUGUSTA EUPHRATENSIS"],
    "PONTICA": ["BITHYNIA", "PAPHLAGONIA", "GALATIA", "CAPPADOCIA", "ARMENIA MINOR", "PONTUS POLEMONIACUS", "DIOSPONTUS"],
    "ASIANA": ["ASIA", "LYDIA", "CARIA", "PHRYGIA I", "PHRYGIA II", "LYCIA ET PAMPHYLIA", "PISIDIA", "HELLESPONTUS", "INSULAE"],
    "THRACIAE": ["EUROPA", "THRACIA", "HAEMIMONTUS", "RHODOPE", "MOESIA INFERIOR", "SCYTHIA"],
    "AFRICA": ["AFRICA PROCONSULARIS", "BYZACENA", "NUMIDIA CIRTENSIS", "NUMIDIA MILITIANA", "MAURETANIA CAESARIENSIS", "MAURETANIA SITIFENSIS", "TRIPOLITANA"],
    "HISPANIA": ["BAETICA", "LUSITANIA", "TARRACONENSIS", "GALLAECIA", "CARTBAGINIENSIS"],
}
# Names of polygons, each with a form of a province that stands for it.
PROVINCE_ALIASES = [
    ("ACHAIA", "achaiae"), ("AEMILIA ET LIGURIA", "aemiliae"), ("AEMILIA ET LIGURIA", "aemilia"), ("AEMILIA ET LIGURIA", "liguriae"),
    ("ALPES COTTIAE", "alpium cottiarum"), ("ALPES GRAIAE ET POENINAE", "alpium poeninarum et graiarum"), ("ALPES MARITIMAE", "alpium maritimarum"),
    ("APULIA ET CALABRIA", "apuliae et calabriae"), ("AQUITANIA I", "aquitanicae primae"), ("AQUITANIA II", "aquitanicae secundae"), ("ARABIA", "arabiae"),
    ("ASIA", "asiae"), ("AUGUSTA EUPHRATENSIS", "augusta eufratensi"), ("AUGUSTA EUPHRATENSIS", "augusta euphratensi"), ("BAETICA", "baeticae"),
    ("BELGICA I", "belgicae primae"), ("BELGICA II", "belgicae secundae"), ("BELGICA II", "balgicae secundae"), ("BITHYNIA", "bithyniae"),
    ("BRITANNIAE I AND II", "britanniae"), ("BRITANNIAE I AND II", "britanniarum"), ("BYZACENA", "byzacii"), ("CAMPANIA", "campaniae"),
    ("CAPPADOCIA", "cappadociae primae"), ("CAPPADOCIA", "cappadociae secundae"), ("CARIA", "cariae"), ("GALLAECIA", "callaeciae"), ("GALLAECIA", "callaecia"),
    ("CILICIA", "ciliciae"), ("CORSICA", "corsicae"), ("CRETA", "cretae"), ("CYPRUS", "cypri"), ("DACIA MEDITERRANEA", "daciae mediterraneae"),
    ("DACIA RIPENSIS", "daciae ripensis"), ("DALMATIA", "dalmaticarum"), ("DARDANIA", "dardaniae"), ("EPIRUS NOVA", "epiri nouae"), ("EPIRUS VETUS", "epiri ueteris"),
    ("EUROPA", "europae"), ("FLAMINIA ET PICENUM", "flaminiae et piceni annonarii"), ("FLAMINIA ET PICENUM", "flaminia"), ("GALATIA", "galatiae"),
    ("GERMANIA I", "germaniae primae"), ("GERMANIA I", "mogontiacensis"), ("GERMANIA II", "germaniae secundae"), ("HAEMIMONTUS", "haemimonti"),
    ("HELLESPONTUS", "hellesponti"), ("INSULAE", "insularum"), ("LIBYA INFERIOR", "libyae inferioris"), ("LIBYA SUPERIOR", "libyae superioris"),
    ("LUCANIA ET BRUTTII", "lucaniae et brittiorum"), ("LUGDUNENSIS I", "lugdunensis primae"), ("LUGDUNENSIS II", "lugdunensis secundae"), ("LUSITANIA", "lusitaniae"),
    ("LYCIA ET PAMPHYLIA", "lyciae"), ("LYCIA ET PAMPHYLIA", "pamfyliae"), ("LYDIA", "lydiae"), ("MACEDONIA", "macedoniae"),
    ("MAURETANIA SITIFENSIS", "mauretaniae sitifensis"), ("MAURETANIA TINGITANA", "tingitaniae"), ("MESOPOTAMIA", "mesopotamiae"),
    ("NARBONENSIS I", "narbonensis primae"), ("NARBONENSIS II", "narbonensis secundae"), ("NORICUM MEDITERRANEUM", "norici mediterranei"),
    ("NORICUM RIPENSE", "norici ripensis"), ("NOVEM POPULI", "novempopulanae"), ("OSRHOENE", "osroehenae"), ("OSRHOENE", "osrhoenae"), ("PALAESTINA", "palaestinae"),
    ("PAPHLAGONIA", "paflagoniae"), ("PISIDIA", "pisidiae"), ("PONTUS POLEMONIACUS", "ponti polemoniaci"), ("PRAEVALITANA", "praeualitanae"), ("RHODOPE", "rhodopae"),
    ("SARDINIA", "saradiniae"), ("SAVIA", "saviae"), ("SCYTHIA", "scythiae"), ("SEQUANIA", "maximae sequanorum"), ("SICILIA", "siciliae"), ("SYRIA COELE", "syriae"),
    ("TARRACONENSIS", "tarraconensis"), ("THEBAIS", "thebaidos"), ("THESSALIA", "thessaliae"), ("THRACIA", "thraciae"), ("TRIPOLITANA", "tripolitanae"),
    ("TUSCIA ET UMBRIA", "tusciae et umbriae"), ("VALERIA", "valeriae"), ("VALERIA", "valeriae ripensis"), ("VENETIA ET HISTRIA", "venetiae et histriae"),
    ("VIENNENSIS", "viennensis"), ("PANNONIA INFERIOR", "pannoniae"), ("PANNONIA SUPERIOR", "pannoniae"), ("PANNONIA SUPERIOR", "pannoniae primae"),
    ("PANNONIA INFERIOR", "pannoniae secundae"), ("PANNONIA INFERIOR", "pannoniae secundae ripariensis"), ("MOESIA SUPERIOR", "moesiae primae"),
    ("MOESIA INFERIOR", "moesiae secundae"), ("RAETIA", "raetiae"), ("RAETIA", "raetiae primae"), ("RAETIA", "raetiae secundae"),
    ("RAETIA", "raetiae primae et secundae"), ("AEGYPTUS HERCULIA", "aegypti"), ("AEGYPTUS IOVIA", "aegypti"), ("PHOENICE", "foenicis"),
    ("AUGUSTA LIBANENSIS", "foenicis"), ("ARMENIA MINOR", "armeniae"),
]


def candidates(occurrences: DataFrame, names: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """Candidates of every occurrence from the first stage that has any: anchors, equal variants, near variants.

    occurrences (occ_id, place_name, place_source), names (place_id, name), anchors (place_name, place_id, name) or
    None. A place comes once per occurrence: of equal variants the one of the lowest tier and shortest form, of near
    ones the most alike. The near stage only sees names the earlier stages left. All is worked out once for every distinct
    name and source, and joined to the occurrences last. (occ_id, place_id, name,
    candidate, rule, tier, similarity, method, stage)
    """
    columns = ["place_id", "name", "candidate", "rule", "tier", "similarity", "method", "stage"]
    own = ["place_name", "place_source"]
    mentions = occurrences.select("occ_id", *[F.coalesce(c, F.lit("")).alias(c) for c in own])
    keyed = names.withColumn("norm", norm_name(F.col("name"))).where("norm <> ''")
    spread = written(variant_rows(mentions).withColumnRenamed("value", "candidate").withColumn("norm", norm_name(F.col("candidate"))), "variants")
    exact = keep_one(spread.join(keyed, "norm"), [*own, "place_id"], F.asc("tier"), F.length("candidate").asc(), F.asc("ord"), F.asc("name"))
    found = exact.withColumns({"similarity": F.lit(1.0), "method": F.lit("EXACT"), "stage": F.lit(1)}).select(*own, *columns)
    if anchors is not None:
        fixed = mentions.select(*own).distinct().join(anchors, "place_name").select(*own, "place_id", "name", F.col("place_name").alias("candidate"), F.lit("anchor").alias("rule"), F.lit(0).alias("tier"), F.lit(1.0).alias("similarity"), F.lit("EXACT").alias("method"), F.lit(0).alias("stage"))
        found = fixed.unionByName(found.join(fixed.select(*own).distinct(), own, "left_anti"))
    rest = spread.join(found.select(*own).distinct(), own, "left_anti").withColumn("form", latin_key(F.col("candidate"))).withColumnRenamed("norm", "variant_norm")
    near = blocked_fuzzy_join(rest, names.withColumn("name_key", latin_key(F.col("name"))))
    near = keep_one(near, [*own, "place_id"], F.desc("similarity"), F.asc("tier"), F.asc("ord"), F.asc("name")).withColumns({"method": F.lit("FUZZY"), "stage": F.lit(2)})
    return mentions.join(found.unionByName(near.select(*own, *columns)), own).select("occ_id", *columns)


def _named(df: DataFrame, column: str, forms: str) -> DataFrame:
    return written(df.select(column).distinct().withColumn(forms, name_forms(F.col(column))), "forms")


def _with_like_words(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, name) of a (key, forms e) and b (name, forms a) that hold words 0.82 alike, by equality on the letter pairs such words share."""
    pair = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - 1, F.lit(1))), lambda i: F.substring(w, i, F.lit(2)))
    grams = lambda word: F.explode(F.array_distinct(F.flatten(F.transform(word, pair)))).alias("gram")
    left, right = a.select(key, F.explode("e").alias("x")), b.select("name", F.explode("a").alias("y"))
    words = left.select("x").distinct().select("x", grams(F.col("x"))).join(right.select("y").distinct().select("y", grams(F.col("y"))), "gram").select("x", "y").distinct()
    alike = words.where(best_form_ratio(F.col("x"), F.col("y")) >= CONTEXT_THRESHOLD)
    return left.join(alike, "x").join(right, "y").select(key, "name").distinct()


def province_targets(expected: DataFrame, polygons: DataFrame, aliases: DataFrame) -> DataFrame:
    """(expected, targets): the polygon names an expected province may stand for, by alias of it or of a part joined by et, or alike in 0.82.

    expected (expected), polygons (name), aliases (alias, name). Distinct names only. The likeness of names is a mean over
    words, so names meet by words 0.82 alike, and these by a letter pair that their case forms share; nothing is lost by it.
    """
    parts = expected.where("expected <> ''").distinct().withColumn("part", F.explode(F.array_union(F.array("expected"), F.filter(F.transform(F.split("expected", r"(?i)\bet\b"), lambda p: F.trim(p)), lambda p: p != ""))))
    by_alias = parts.withColumn("alias", norm_name(F.col("part"))).join(aliases, "alias").join(polygons, "name", "left_semi").select("expected", "name")
    a, b = _named(parts, "part", "e"), _named(polygons, "name", "a")
    alike = _with_like_words(a, b, "part").join(a, "part").join(b, "name").where(forms_likeness(F.col("e"), F.col("a")) >= CONTEXT_THRESHOLD).select("part", "name")
    by_score = parts.join(alike, "part").select("expected", "name")
    return by_alias.unionByName(by_score).groupBy("expected").agg(F.array_sort(F.collect_set("name")).alias("targets"))


def geographic_chapters(chapters: DataFrame, polygons: DataFrame) -> DataFrame:
    """(chapter): the chapters (chapter) whose title fits the name of some polygon (name) in 0.82, which takes a word 0.82 like one of the name."""
    a, b = _named(chapters.where("chapter <> ''"), "chapter", "e"), _named(polygons, "name", "a")
    return _with_like_words(a, b, "chapter").join(a, "chapter").join(b, "name").where(forms_context(F.col("a"), F.col("e")) >= CONTEXT_THRESHOLD).select("chapter").distinct()


def region_targets(region: Column) -> Column:
    """The provinces of a large region, by its name or as a title names it, as an array, [] for none."""
    own = F.upper(clean_name(region))
    large = F.create_map(*[x for name, provinces in REGIONS.items() for x in (F.lit(name), F.array(*[F.lit(p) for p in provinces]))])
    return F.coalesce(large[own], large[macro_region(region, F.lit(""))], F.array().cast("array<string>"))


def context_status(df: DataFrame) -> DataFrame:
    """df with context_status and context_score by the strongest evidence that has targets: hard, soft, region, then the chapter's own geography.

    Needs hard, hard_targets, soft, soft_targets, region_targets, actual, nearest, nearest_km, chapter_geography
    (boolean) and context_text; null or '' polygons are none.
    """
    actual, nearest = F.coalesce("actual", F.lit("")), F.coalesce("nearest", F.lit(""))
    close = (nearest != "") & (F.col("nearest_km") <= NEAR_KM)
    size = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    status, score = F.when(actual == "", "NO_POLYGON").otherwise("NO_CONTEXT"), F.lit(0.0)
    own = F.coalesce("chapter_geography", F.lit(False))
    df = df.withColumns({"_actual": name_forms(actual), "_nearest": name_forms(nearest), "_text": name_forms(F.col("context_text")), "_hard": name_forms(F.col("hard")), "_soft": name_forms(F.col("soft"))})
    by_actual, by_nearest = forms_context(F.col("_actual"), F.col("_text")), forms_context(F.col("_nearest"), F.col("_text"))
    soft_name = lambda s, tag: F.when(s >= CONTEXT_THRESHOLD, f"SOFT_{tag}MATCH").otherwise(f"SOFT_{tag}MISMATCH")
    status = F.when((actual != "") & own, soft_name(by_actual, "")).when((actual == "") & close & own, soft_name(by_nearest, "NEAR_")).otherwise(status)
    score = F.when((actual != "") & own, by_actual).when((actual == "") & close & own, by_nearest).otherwise(score)
    for strength, targets, expected in (("REGION", "region_targets", None), ("SOFT", "soft_targets", "_soft"), ("HARD", "hard_targets", "_hard")):
        held, near = F.array_contains(targets, actual), F.array_contains(targets, nearest)
        miss = lambda p, e=expected: F.lit(0.0) if e is None else forms_likeness(F.col(e), F.col(p))
        named = F.when(actual != "", F.when(held, f"{strength}_MATCH").otherwise(f"{strength}_MISMATCH")).when(close, F.when(near, f"{strength}_NEAR_MATCH").otherwise(f"{strength}_NEAR_MISMATCH")).otherwise(f"{strength}_UNVERIFIED")
        value = F.when(actual != "", F.when(held, F.lit(1.0)).otherwise(miss("_actual"))).when(close, F.when(near, F.lit(1.0)).otherwise(miss("_nearest"))).otherwise(F.lit(0.0))
        status, score = F.when(size(targets), named).otherwise(status), F.when(size(targets), value).otherwise(score)
    return df.withColumn("context_status", status).withColumn("context_score", score).drop("_actual", "_nearest", "_text", "_hard", "_soft")


def rank_candidates(df: DataFrame) -> DataFrame:
    """df with candidate_rank per occ_id: status weight, context score, similarity and feature score high first, tier low first, then place_id."""
    weight = F.coalesce(F.create_map(*[F.lit(x) for p in STATUS_WEIGHT.items() for x in p])[F.col("context_status")], F.lit(0))
    order = [weight.desc(), F.desc("context_score"), F.desc("similarity"), F.desc("feature_score"), F.asc("tier"), F.asc("place_id")]
    return df.withColumn("candidate_rank", F.row_number().over(W.partitionBy("occ_id").orderBy(*order)))


#: The kinds of evidence, by status: direct and near matches of each strength, contradicted, and open (neither).
EVIDENCE = {"HARD_MATCH": "hard", "HARD_NEAR_MATCH": "hard_near", "SOFT_MATCH": "soft", "SOFT_NEAR_MATCH": "soft_near", "REGION_MATCH": "region", "REGION_NEAR_MATCH": "region_near"}
FEATURE_SCORES = (4, 2, 0, -2)


def _evidence(df: DataFrame) -> DataFrame:
    """One row per occurrence with, for each kind of evidence, its candidates counted by feature score and its best one."""
    status = F.col("context_status")
    kind = F.coalesce(F.create_map(*[F.lit(x) for p in EVIDENCE.items() for x in p])[status], F.when(status.endswith("MISMATCH"), "miss").otherwise("open"))
    best = F.struct((-F.col("feature_score")).alias("f"), (-F.coalesce("similarity", F.lit(0.0))).alias("s"), "tier", "place_id", "method", F.coalesce("place_source", F.lit("")).alias("source"), F.col("context_status").contains("NEAR").alias("near"))
    per = df.withColumn("kind", kind).groupBy("occ_id", "kind").agg(
        *[F.count_if(F.col("feature_score") == v).alias(f"n{i}") for i, v in enumerate(FEATURE_SCORES)], F.min(best).alias("best"), F.max("has_hard").alias("has_hard"),
        F.count_if(status.isin("HARD_MISMATCH", "HARD_NEAR_MISMATCH")).alias("hard_miss"), F.count_if(status == "HARD_UNVERIFIED").alias("hard_open"),
    )
    facts = F.map_from_entries(F.collect_list(F.struct("kind", F.struct(F.array("n0", "n1", "n2", "n3").alias("n"), "best"))))
    return per.groupBy("occ_id").agg(facts.alias("e"), F.max("has_hard").alias("has_hard"), F.sum("hard_miss").alias("hard_miss"), F.sum("hard_open").alias("hard_open"))


def _pool(kinds: Column) -> Column:
    """The candidates of some kinds of evidence together: how many, by feature score, and the best; null for none."""
    parts = F.array_compact(F.transform(kinds, lambda k: F.col("e")[k]))
    none = F.array(*[F.lit(0).cast("bigint")] * len(FEATURE_SCORES))
    counts = F.aggregate(parts, none, lambda acc, p: F.zip_with(acc, p["n"], lambda x, y: x + y))
    return F.when(F.size(parts) > 0, F.struct(counts.alias("n"), F.aggregate(counts, F.lit(0).cast("bigint"), lambda x, y: x + y).alias("size"), F.array_min(F.transform(parts, lambda p: p["best"])).alias("best")))


def _by_feature(pool: Column) -> Column:
    """Whether the best of two or more stands out by its feature: alone at the top, at 4 with a lead of 2, or at 2 above the negative."""
    values = F.flatten(F.transform(pool["n"], lambda n, i: F.array_repeat(F.array(*[F.lit(v) for v in FEATURE_SCORES])[i], F.least(n, F.lit(2)).cast("int"))))
    top, second = F.get(values, F.lit(0)), F.get(values, F.lit(1))
    clear = (top > second) & (((top >= 4) & (top - second >= 2)) | ((top >= 2) & (second < 0)))
    return F.coalesce((pool["size"] >= 2) & clear & (_sure(pool) != ""), F.lit(False))


def _sure(pool: Column) -> Column:
    return F.when(pool["best"]["method"] == "EXACT", "EXACT").when(-pool["best"]["s"] >= AUTO_SIMILARITY, "FUZZY").otherwise("")


def decide(df: DataFrame) -> DataFrame:
    """Per occurrence: chosen place with match_type, and whether it is a conflict or ambiguous.

    df: scored candidates (occ_id, place_id, method, similarity, tier, context_status, feature_score of
    FEATURE_SCORES, place_source, has_hard). Candidates are counted by kind of evidence in a partial aggregation, eight
    rows an occurrence at most, whatever its candidates; the decision is an expression over these. With a hard province
    the pool is its direct matches, else its near ones; without, the soft ones, else those of the region. A pool of
    one is the match; of several the one that stands out by its feature is, first within the pool, then among all direct and
    near matches of the strongest kind, or, where nothing matches, among candidates that nothing contradicts. A sole
    candidate is the match when nothing contradicts it, or as a conflict when its hard province does. A lone
    near-alike candidate below 0.90 that its context confirms is chosen without a type, as documented. Output: (occ_id,
    outcome, place_id, match_type, is_conflict), outcome MATCH or AMBIGUOUS.
    """
    kinds = lambda *names: F.array(*[F.lit(n) for n in names])
    has = lambda name: F.col("e")[name].isNotNull()
    direct_or_near = lambda name: F.when(has(name), kinds(name)).otherwise(kinds(f"{name}_near"))
    either = lambda name: has(name) | has(f"{name}_near")
    own = F.when(F.col("has_hard"), direct_or_near("hard")).when(either("soft"), direct_or_near("soft")).otherwise(direct_or_near("region"))
    wide = F.when(either("hard"), kinds("hard", "hard_near")).when(either("soft"), kinds("soft", "soft_near")).when(either("region"), kinds("region", "region_near")).otherwise(kinds("open"))
    facts = _evidence(df.withColumn("has_hard", F.coalesce("has_hard", F.lit(False)))).withColumns({"own": _pool(own), "wide": _pool(wide), "all": _pool(F.map_keys("e"))})
    facts = facts.withColumn("is_conflict", F.col("has_hard") & ~either("hard") & (F.col("hard_miss") > 0) & (F.col("hard_open") == 0))
    sure, near = _sure(F.col("own")), F.when(F.col("own.best.near"), "NEAR_").otherwise("")
    prefix = F.when(~F.col("has_hard") & ~either("soft"), "REGION_").otherwise("CONTEXT_")
    sole, sure_sole = F.col("all.size") == 1, _sure(F.col("all"))
    stands_alone = sole & (F.col("e")["miss"].isNull()) & ((sure_sole == "EXACT") | ((sure_sole == "FUZZY") & (F.col("all.best.source") != "limes")))
    pick = lambda pool, kind: F.struct(F.col(f"{pool}.best.place_id").alias("place_id"), kind.alias("match_type"))
    choice = (
        F.when(F.col("own.size") == 1, pick("own", F.when(sure == "", "").otherwise(F.concat(prefix, near, sure))))
        .when(F.col("is_conflict") & sole & (sure_sole != ""), pick("all", F.concat(F.lit("CONTEXT_CONFLICT_"), sure_sole)))
        .when(_by_feature(F.col("own")), pick("own", F.concat(F.lit("FEATURE_"), sure)))
        .when(_by_feature(F.col("wide")), pick("wide", F.concat(F.lit("FEATURE_"), _sure(F.col("wide")))))
        .when(stands_alone, pick("all", F.concat(sure_sole, F.lit("_NO_CONTEXT"))))
    )
    return facts.select("occ_id", F.when(choice.isNotNull(), "MATCH").otherwise("AMBIGUOUS").alias("outcome"), choice["place_id"].alias("place_id"), choice["match_type"].alias("match_type"), "is_conflict")


def decision_rows(df: DataFrame, decisions: DataFrame, top: int = 5) -> DataFrame:
    """The candidates to show for every occurrence in conflict and for every ambiguous one, ranked, `top` at most: df's columns, candidate_rank and report.

    An occurrence may be in both reports. df: as rank_candidates takes it; decisions: of decide.
    """
    reports = F.array_compact(F.array(F.when(F.col("is_conflict"), "CONFLICT"), F.when(F.col("outcome") == "AMBIGUOUS", "AMBIGUOUS")))
    wanted = decisions.select("occ_id", F.explode(reports).alias("report"))
    return rank_candidates(df).where(F.col("candidate_rank") <= top).join(wanted, "occ_id")


def decide_local(df: DataFrame) -> DataFrame:
    """The simpler decision by one expected province: (occ_id, outcome, place_id, match_type).

    df: (occ_id, place_id, method, similarity, tier, expected, province, has_coordinates, feature_type). With an
    expected province a single candidate inside it is the match, a near-alike one of several if 0.06 ahead; a sole
    candidate outside is rejected. Without one, a single viable candidate is.
    """
    expected = F.coalesce("expected", F.lit("")) != ""
    status = F.when(~expected, "NO_CONTEXT").when(~F.col("has_coordinates"), "NO_COORDS").when(F.coalesce("province", F.lit("")) == "", "OUTSIDE_POLYGONS").when(provinces_compatible(F.col("expected"), F.col("province")), "INSIDE_EXPECTED").otherwise("OUTSIDE_EXPECTED")
    by = W.partitionBy("occ_id")
    tagged = df.withColumn("province_status", status).withColumn("viable", (F.col("province_status") != "OUTSIDE_EXPECTED") & ~non_point(F.col("feature_type")))
    tagged = tagged.withColumn("inside", F.col("viable") & (F.col("province_status") == "INSIDE_EXPECTED")).withColumns({"n": F.count("*").over(by), "n_inside": F.count_if("inside").over(by), "n_viable": F.count_if("viable").over(by)})
    order = W.partitionBy("occ_id").orderBy(F.when(F.col("inside"), 0).when(F.col("viable"), 1).otherwise(2), F.desc("similarity"), F.asc("tier"), F.asc("place_id"))
    top = tagged.withColumns({"_n": F.row_number().over(order), "second": F.lead(F.when(F.col("inside"), F.col("similarity"))).over(order)}).where("_n = 1")
    exact, auto = F.col("method") == "EXACT", F.col("similarity") >= AUTO_SIMILARITY
    kind = (
        F.when(expected & (F.col("n_inside") == 1), F.concat(F.lit("CONTEXT_"), F.col("method")))
        .when(expected & (F.col("n_inside") > 1) & ~exact & auto & (F.col("similarity") - F.col("second") >= MIN_MARGIN), "CONTEXT_FUZZY")
        .when(~expected & (F.col("n_viable") == 1) & (exact | auto), F.concat("method", F.lit("_NO_CONTEXT")))
    )
    rejected = expected & (F.col("n") == 1) & (F.col("province_status") == "OUTSIDE_EXPECTED")
    return top.withColumn("match_type", kind).select("occ_id", F.when(F.col("match_type").isNotNull(), "MATCH").when(rejected, "REJECTED").otherwise("AMBIGUOUS").alias("outcome"), F.when(F.col("match_type").isNotNull(), F.col("place_id")).alias("place_id"), F.coalesce("match_type", F.lit("")).alias("match_type"))


def with_feature_score(df: DataFrame) -> DataFrame:
    return df.withColumn("feature_score", feature_score(F.col("feature_type"), F.col("unit"), F.col("chapter")))


def strict(mentions: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """(id, status, place_id): by the mention's own place id, else by a name that is unique, else ambiguous or unresolved."""
    ids = gazetteer.select(F.col("place_id").alias("_own")).distinct()
    names = gazetteer.groupBy(F.lower(F.trim("name")).alias("_k")).agg(F.count_distinct("place_id").alias("_c"), F.min("place_id").alias("_one"))
    joined = mentions.join(ids, mentions["place_id"] == F.col("_own"), "left").join(names, F.lower(F.trim(mentions["place_name"])) == F.col("_k"), "left")
    status = F.when(F.col("_own").isNotNull(), "ID").when(F.col("_c") == 1, "UNIQUE").when(F.col("_c") > 1, "AMBIGUOUS").otherwise("UNRESOLVED")
    return joined.select("id", status.alias("status"), F.coalesce("_own", F.when(F.col("_c") == 1, F.col("_one"))).alias("place_id"))


def first_by_names(mentions: DataFrame, gazetteer: DataFrame, columns: list[str], order: str) -> DataFrame:
    """(id, place_id): the first gazetteer row, by `order`, that has the mention's name in any of the columns."""
    keys = gazetteer.select("place_id", order, F.explode(F.array_distinct(F.array_compact(F.array(*[F.lower(F.trim(c)) for c in columns])))).alias("_k"))
    first = keys.groupBy("_k").agg(F.min_by("place_id", order).alias("place_id"))
    return mentions.join(first, F.lower(F.trim("place_name")) == F.col("_k")).select("id", first["place_id"])


def scored(mentions: DataFrame, gazetteer: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """(id, place_id, score): the gazetteer row of the mention's name with the best evidence.

    A shared source line counts 250, an agreeing qualifier 25, accepted 5, confirmed 3, provisional or hold -20; a row
    of the override table (place_name, place_id) decides at once. Nothing above 0 falls back to the first row.
    mentions (id, place_name, line, qualifier), gazetteer (place_id, name, line, qualifier, confidence, ord). No mention
    is paired with the rows of its name, see most_shared.
    """
    confidence = F.lower("confidence")
    worth = F.when(confidence == "accepted", 5).when(confidence == "confirmed", 3).when(confidence.isin("provisional", "hold"), -20).otherwise(0)
    named = lambda c: [F.lower(F.trim(c)).alias("key"), "line", F.lower(F.when(F.col("qualifier") != "", F.col("qualifier"))).alias("qualifier")]
    best = most_shared(mentions.select("id", *named("place_name")), gazetteer.select(*named("name"), worth.alias("worth"), "ord", F.col("place_id").alias("offer")), {"line": 250, "qualifier": 25}).withColumnRenamed("offer", "place_id")
    if overrides is None:
        return best
    fixed = mentions.join(overrides, "place_name").select("id", overrides["place_id"], F.lit(1000).alias("score")).distinct()
    return fixed.unionByName(best.join(fixed, "id", "left_anti"))
