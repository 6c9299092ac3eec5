"""Core queries on packed fields, places near places and broken references."""

from __future__ import annotations

from tabulary.operators import multivalue, orphans, spatial

QUERIES = {"p2_found": spatial.found, "p3_found": multivalue.found, "p5_found": orphans.found, "p5_report": orphans.report, "p5_inherited": orphans.inherited}
SQL = {"p2_found": spatial.FOUND_SQL, "p3_found": multivalue.FOUND_SQL, "p5_found": orphans.FOUND_SQL, "p5_report": orphans.REPORT_SQL, "p5_inherited": orphans.INHERITED_SQL}
