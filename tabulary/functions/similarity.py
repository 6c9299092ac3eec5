"""Similarity of names and contexts, as column expressions wherever a built-in carries them."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulary.functions.morphology import normal_word_forms, word_forms
from tabulary.functions.text import latin_key, let, meaningful_tokens, norm_name, norm_search, province_tokens

# Thresholds of the linkage.
MAX_EDITS, MIN_SIMILARITY, AUTO_SIMILARITY, MIN_MARGIN, CONTEXT_THRESHOLD, NEAR_KM = 2, 0.86, 0.90, 0.06, 0.82, 15.0


def bounded_edits(a: Column, b: Column, limit: int) -> Column:
    """Edit distance, or limit + 1 when it is more."""
    d = F.levenshtein(a, b, limit)
    return F.when(d < 0, limit + 1).otherwise(d)


def _ratio(a: Column, b: Column) -> Column:
    return 1.0 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))


def similarity(a: Column, b: Column) -> Column:
    """1 - distance / length of the longer, on spelling keys; 0 when either is empty."""
    return let(latin_key(a), lambda ka: let(latin_key(b), lambda kb: F.when((ka == "") | (kb == ""), F.lit(0.0)).otherwise(_ratio(ka, kb))))


def word_similarity(a: Column, b: Column) -> Column:
    """The best ratio of any two case forms; 0 when a word has none."""
    return best_form_ratio(word_forms(a), word_forms(b))


def best_form_ratio(fa: Column, fb: Column) -> Column:
    pairs = F.flatten(F.transform(fa, lambda x: F.transform(fb, lambda y: _ratio(x, y))))
    return F.coalesce(F.array_max(pairs), F.lit(0.0))


def name_forms(column: Column) -> Column:
    """The case forms of each meaningful word: array<array<string>>. Computed once per name, it carries both scores below."""
    return F.transform(meaningful_tokens(column), normal_word_forms)


def _best_per_token(left: Column, right: Column) -> Column:
    return F.transform(left, lambda fa: F.array_max(F.transform(right, lambda fb: best_form_ratio(fa, fb))))


def forms_likeness(e: Column, a: Column) -> Column:
    """expected_to_actual on name_forms."""
    total = F.aggregate(_best_per_token(e, a), F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(e) == 0) | (F.size(a) == 0), F.lit(0.0)).otherwise(total / F.size(e))


def forms_context(a: Column, c: Column) -> Column:
    """actual_to_context on name_forms."""
    scores = F.sort_array(_best_per_token(a, c), asc=False)
    return F.when((F.size(a) == 0) | (F.size(c) == 0), F.lit(0.0)).when(F.size(a) == 1, scores[0]).otherwise(0.65 * scores[0] + 0.35 * scores[1])


def expected_to_actual(expected: Column, actual: Column) -> Column:
    """Mean over the words of expected of the best likeness to a word of actual; 0 when either has none."""
    return forms_likeness(name_forms(expected), name_forms(actual))


def actual_to_context(actual: Column, context: Column) -> Column:
    """The best likeness of a word of actual, or 0.65 of the best and 0.35 of the second; 0 when either has none."""
    return forms_context(name_forms(actual), name_forms(context))


def _letters(texts: pd.Series) -> np.ndarray:
    """Counts of letters in 32 buckets, a row per text."""
    counts = np.zeros((len(texts), 32), dtype=np.int16)
    codes, inverse = pd.factorize(texts)
    kinds = np.array([np.bincount(np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32) & 31, minlength=32) for t in inverse], dtype=np.int16).reshape(-1, 32)
    return kinds[codes] if len(kinds) else counts


def _ratios(a: pd.Series, b: pd.Series, least: float) -> pd.Series:
    """Ratios, 0 where the letters in common rule out `least`: matched letters are at most those, so no pair that reaches it is lost."""
    length = (a.str.len() + b.str.len()).to_numpy()
    bound = np.where(length > 0, 2.0 * np.minimum(_letters(a), _letters(b)).sum(axis=1) / np.maximum(length, 1), 1.0)
    out, matcher, last = np.zeros(len(a)), SequenceMatcher(None), None
    left, right = a.to_numpy(), b.to_numpy()
    for i in np.nonzero(bound >= least)[0]:
        if right[i] != last:
            matcher.set_seq2(last := right[i])
        matcher.set_seq1(left[i])
        out[i] = matcher.ratio()
    return pd.Series(out)


def sequence_ratio(a: Column, b: Column, least: float = 0.0) -> Column:
    """Ratcliff-Obershelp likeness, or 0 where it cannot reach `least`; sorted by b, its index is built once for each b."""

    @F.pandas_udf(T.DoubleType())
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return _ratios(x, y, least)

    return ratio(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))


def provinces_compatible(expected: Column, actual: Column, targets: Column | None = None) -> Column:
    """Equal, one within the other, an alias (targets: array of keys), a pair of like words, or 0.80 alike as a whole."""
    e, a = norm_name(expected), norm_name(actual)
    te, ta = province_tokens(expected), province_tokens(actual)
    like = F.exists(te, lambda x: F.exists(ta, lambda y: x.contains(y) | y.contains(x) | (similarity(x, y) >= CONTEXT_THRESHOLD)))
    alias = F.coalesce(F.array_contains(targets, a), F.lit(False)) if targets is not None else F.lit(False)
    both = (F.coalesce(expected, F.lit("")) != "") & (F.coalesce(actual, F.lit("")) != "")
    return both & (e.contains(a) | a.contains(e) | alias | like | (similarity(expected, actual) >= 0.80))


def stem_score(query: Column, context: Column) -> Column:
    """100 when context contains query, else 15 for each word whose first six letters (of four at least) occur in it."""
    q, c = norm_search(query), norm_search(context)
    words = F.filter(F.split(q, " "), lambda w: F.length(w) >= 4)
    hits = F.size(F.filter(words, lambda w: c.contains(F.left(w, F.lit(6)))))
    return F.when((q != "") & c.contains(q), 100).otherwise(hits * 15)
