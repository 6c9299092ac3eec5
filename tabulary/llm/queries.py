"""Queries of the llm operators and their oracle SQL."""

from __future__ import annotations

from tabulary.llm import canonical, glyphs, leaks, mixing, pii, topn


def queries():
    return {"p1_found": topn.found, "p4_found": canonical.found, "p6_found": glyphs.found, "p6_normalized": glyphs.normalized, "p7_found": leaks.found, "p7_near": leaks.near, "p8_mix": mixing.p8_mix, "p8_shares": mixing.p8_shares, "p9_found": pii.found, "p9_redacted": pii.redacted}


def oracle_sql():
    return {"p1_found": topn.FOUND_SQL, "p4_found": canonical.FOUND_SQL, "p6_found": glyphs.FOUND_SQL, "p6_normalized": glyphs.NORMALIZED_SQL, "p7_found": leaks.FOUND_SQL}
