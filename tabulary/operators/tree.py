"""Indented or marked text as a tree: lines, chapters, headings, nodes with paths, and checks on them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulary.functions.text import squeeze

INDENT = 5
CHAPTER = r"^([IVXLCDM]+)\.\s*(.*)$"
ROMAN = [(1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")]
PLACEABLE = ("office", "unit", "place", "province", "region", "function", "factory", "treasury")


def lines_of(texts: DataFrame, document: str = "document", text: str = "text") -> DataFrame:
    """(document, line, raw, level, label): the non-blank lines of whole texts with their number from 1 and indent level."""
    spread = texts.select(F.col(document).alias("document"), F.posexplode(F.split(F.regexp_replace(F.col(text), "﻿", ""), "\r?\n")).alias("line", "raw"))
    spread = spread.withColumn("line", F.col("line") + 1).withColumn("raw", F.regexp_replace("raw", r"\s+$", "")).where("raw <> ''")
    return spread.withColumn("level", F.floor((F.length("raw") - F.length(F.ltrim("raw"))) / INDENT).cast("int")).withColumn("label", F.trim("raw"))


def line_text(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (document, line) with the text of its line, '' when there is none."""
    return wanted.join(lines.select("document", "line", squeeze(F.col("raw")).alias("source_text")), ["document", "line"], "left").fillna("", ["source_text"])


def with_chapters(lines: DataFrame) -> DataFrame:
    """lines with chapter_no (running from 1, 0 before the first), is_chapter, chapter_roman and chapter_title carried on."""
    by = W.partitionBy("document").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    tagged = lines.withColumn("is_chapter", F.col("label").rlike(CHAPTER)).withColumn("chapter_no", F.sum(F.col("is_chapter").cast("int")).over(by))
    own = lambda i: F.last(F.when(F.col("is_chapter"), F.regexp_extract("label", CHAPTER, i)), ignorenulls=True).over(by)
    return tagged.withColumn("chapter_roman", own(1)).withColumn("chapter_title", F.regexp_replace(own(2), r"\.$", ""))


def chapter_ranges(lines: DataFrame) -> DataFrame:
    """(document, chapter_no, line_start, line_end): from a chapter's line to the one before the next, or the document's last."""
    chapters = with_chapters(lines)
    last = chapters.groupBy("document").agg(F.max("line").alias("last"))
    starts = chapters.where("is_chapter").withColumn("next", F.lead("line").over(W.partitionBy("document").orderBy("line")))
    return starts.join(last, "document").select("document", "chapter_no", F.col("line").alias("line_start"), F.coalesce(F.col("next") - 1, F.col("last")).alias("line_end"))


def lines_in_ranges(lines: DataFrame, ranges: DataFrame) -> DataFrame:
    """Lines after the first of the range that holds them; ranges of a document do not overlap, so the last start before a line decides."""
    marks = ranges.select("document", F.col("line_start").alias("line"), F.struct("chapter_no", "line_start", "line_end").alias("_r"))
    merged = lines.withColumn("_r", F.lit(None).cast(marks.schema["_r"].dataType)).unionByName(marks, allowMissingColumns=True)
    at = F.last("_r", ignorenulls=True).over(W.partitionBy("document").orderBy("line", F.col("_r").isNull()).rowsBetween(W.unboundedPreceding, 0))
    return merged.withColumn("_at", at).where("raw is not null and line > _at.line_start and line <= _at.line_end").select(*lines.columns, F.col("_at.chapter_no").alias("chapter_no"))


def headings_by_indent(lines: DataFrame) -> DataFrame:
    """lines with is_block and parent_line: the nearest open heading (ending in ':') with a smaller indent, null at the top.

    A heading is closed by any later line indented no deeper, so what is open is a stack that every line trims. Lines
    stream through in order, chapter by chapter, whatever their depth; memory is the open headings of one chapter.
    """
    scope = [c for c in ("document", "chapter_no") if c in lines.columns]
    names = [f.name for f in lines.schema]
    at, line, level, label = [names.index(c) for c in scope], names.index("line"), names.index("level"), names.index("label")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lines.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, stack = None, []
        for batch in batches:
            blocks, parents = [], []
            for row in batch[names].itertuples(index=False, name=None):
                if [row[i] for i in at] != here:
                    here, stack = [row[i] for i in at], []
                while stack and stack[-1][0] >= row[level]:
                    stack.pop()
                parents.append(stack[-1][1] if stack else None)
                blocks.append(str(row[label]).endswith(":"))
                if blocks[-1]:
                    stack.append((row[level], row[line]))
            yield batch.assign(is_block=blocks, parent_line=pd.array(parents, dtype="Int64"))

    return lines.repartition(*scope).sortWithinPartitions(*scope, "line").mapInPandas(run, f"{fields}, is_block boolean, parent_line bigint").withColumn("parent_line", F.col("parent_line").cast(lines.schema["line"].dataType))


def flat_blocks(lines: DataFrame, rules: DataFrame) -> DataFrame:
    """Rule-driven flat structure: (.., kind, parent_line, level): a line of a rule is a block of its chapter, any other an entry of the current container."""
    from tabulary.operators.relational import first_rule

    marked = first_rule(lines, "label", rules)
    scope = W.partitionBy("document", "chapter_no").orderBy("line").rowsBetween(W.unboundedPreceding, -1)
    current = F.last(F.when((F.col("container") == "Y"), F.col("line")), ignorenulls=True).over(scope)
    ruled = F.col("pattern").isNotNull()
    return marked.withColumn("parent_line", F.when(~ruled, current)).withColumn("kind", F.coalesce("node_type", F.lit("entry"))).withColumn("depth", F.when(~ruled & F.col("parent_line").isNotNull(), 3).otherwise(2))


NODES = "document string, chapter_no int, line int, parent_line int, tag string, type string, level int, text string, suppress boolean, owner_title string, path array<struct<line:int,type:string,title:string>>"
PRODUCTION = r"(?i)^;*(?:armorum|armamentaria|sagittaria|loricaria|scutaria|scutorum|arcuaria|spatharia|balistaria|clibanaria|hastaria)\b"
#: What a line does to the open headings, by where it stands and what it is: (place, kind, what happens, its parent).
#: Places: staff and factory, below such a heading, and open, anywhere else. `push` closes headings as deep as the line and
#: opens it, `append` opens it below all, `trim` only closes, `keep` leaves them. Parents: the stack's top, or a line.
MOVES = [
    ("any", "staff heading", "push", "stack"),
    ("any", "factory heading", "push", "stack"),
    ("staff", "rank heading", "append", "staff_line"),
    ("factory", "production", "keep", "workshop_line"),
    ("factory", "heading", "keep", "factory_line"),
    ("factory", "text", "keep", "workshop_line"),
    ("any", "heading", "push", "stack"),
    ("any", "production", "push", "stack"),
    ("any", "rank heading", "push", "stack"),
    ("staff", "text", "keep", "rank_line"),
    ("any", "text", "trim", "stack"),
]


def with_modes(lines: DataFrame) -> DataFrame:
    """lines with kind, place (staff, factory or open), move and parent (see MOVES), all by running windows of a chapter.

    A staff or factory heading begins a stretch. A factory lasts until the next such heading; a staff until a heading as shallow as
    its own, other than its rank list, or a line as shallow that no rank list has been opened for.
    """
    low, heading = F.lower(squeeze(F.col("label"))), F.col("label").endswith(":")
    kind = (
        F.when(low.startswith("officium") & F.col("label").rlike("[:;]$"), "staff heading").when(heading & low.startswith("fabricae "), "factory heading")
        .when(heading & low.startswith("habet autem dignitates"), "rank heading").when(heading & low.rlike(PRODUCTION), "production").when(heading, "heading").otherwise("text")
    )
    scope = W.partitionBy("document", "chapter_no").orderBy("line")
    begins = F.col("kind").isin("staff heading", "factory heading")
    marked = lines.withColumn("kind", kind).withColumn("stretch", F.count_if(begins).over(scope.rowsBetween(W.unboundedPreceding, 0)))
    stretch = W.partitionBy("document", "chapter_no", "stretch").orderBy("line")
    before, upto = stretch.rowsBetween(W.unboundedPreceding, -1), stretch.rowsBetween(W.unboundedPreceding, 0)
    first = marked.withColumns({"opened_by": F.first("kind").over(upto), "opened_at": F.first("line").over(upto), "opened_level": F.first("level").over(upto)}).withColumn("opened_by", F.when(F.col("stretch") > 0, F.col("opened_by")))
    own = F.col("opened_level")
    ranks = (F.col("kind") == "rank heading") & (F.col("level") == own)
    ranked = first.withColumns({"is_rank": ranks, "rank_line": F.last(F.when(ranks, F.col("line")), ignorenulls=True).over(before), "workshop": F.last(F.when(F.col("kind").isin("heading", "rank heading"), F.col("line")), ignorenulls=True).over(before)})
    stays = F.when(F.col("kind") == "text", (F.col("level") > own) | ((own > 0) & (F.col("level") == own) & F.col("rank_line").isNull())).otherwise((F.col("level") > own) | F.col("is_rank"))
    left = F.max((~stays & ~begins).cast("int")).over(upto) == 1
    place = F.when(F.col("opened_by") == "factory heading", "factory").when((F.col("opened_by") == "staff heading") & ~left, "staff").otherwise("open")
    placed = ranked.withColumn("place", place)
    told = F.when((F.col("kind") == "rank heading") & ~((F.col("place") == "staff") & F.col("is_rank")), "heading").otherwise(F.col("kind"))
    placed = placed.withColumn("kind", told)
    parents = {"stack": F.lit(None).cast("int"), "staff_line": F.col("opened_at"), "factory_line": F.col("opened_at"), "workshop_line": F.coalesce("workshop", "opened_at"), "rank_line": F.coalesce("rank_line", "opened_at")}
    move = parent = None
    for where, what, does, hangs in MOVES:
        fits = (F.col("kind") == what) & (F.lit(True) if where == "any" else F.col("place") == where)
        move = F.when(fits, does) if move is None else move.when(fits, does)
        parent = F.when(fits, parents[hangs]) if parent is None else parent.when(fits, parents[hangs])
    return placed.withColumns({"move": move, "told_parent": parent})


def _stream(body: DataFrame, schema: str, machine) -> DataFrame:
    """Runs machine() -> step(row) over the lines of each chapter in order; lines stream through, so a chapter may be of any length.

    Chapters are spread by (document, chapter) and sorted within the partitions; a fresh machine starts with each.
    """
    names = [c.split()[0] for c in re.sub(r"<[^>]*>+", "", schema).split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, step = None, None
        for batch in batches:
            rows = []
            for row in zip(*[batch[c].tolist() for c in body_columns], strict=True):
                if row[:2] != at:
                    at, step = row[:2], machine()
                rows.append(step(*row))
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({"parent_line": "Int32"})

    body_columns = body.columns
    return body.repartition("document", "chapter_no").sortWithinPartitions("document", "chapter_no", "line").mapInPandas(run, schema)


def _body(lines: DataFrame, *extra: Column) -> DataFrame:
    return lines.where("chapter_no > 0 and not is_chapter").select("document", F.col("chapter_no").cast("int").alias("chapter_no"), F.col("line").cast("int").alias("line"), *extra, "label")


def parse_chapters(lines: DataFrame, heading_types: list[tuple[str, str]], unit_types: list[tuple[str, str]]) -> DataFrame:
    """Nodes of every chapter by the open headings, with factory and staff modes (see NODES and MOVES).

    lines: with document, chapter_no, line, level, label. Kinds, modes, types and the parents that modes dictate are
    columns; only the stack itself streams through the chapter in order, so a chapter may be of any length.
    """
    from tabulary.functions.rules import first_prefix

    body = with_modes(_body(lines, F.col("level")))
    heads = F.col("kind").endswith("heading") | ((F.col("kind") == "production") & (F.col("place") != "factory"))
    title = F.trim(F.regexp_replace("label", "[:;]$", ""))
    works = (F.col("place") == "factory") & ~heads
    typed = F.when(heads, first_prefix(F.col("label"), heading_types)).when(works, "factory").otherwise(first_prefix(F.col("label"), unit_types))
    ready = body.select("document", "chapter_no", "line", "level", "move", F.col("told_parent").cast("int").alias("told_parent"), heads.alias("heads"), (F.col("kind") == "staff heading").alias("staff"), ((F.col("place") == "staff") & (F.col("kind") == "text")).alias("held"), typed.alias("type"), F.when(heads, title).otherwise(F.col("label")).alias("title"), "label")

    def machine():
        stack: list[dict] = []  # open headings
        known: dict[int, dict] = {}  # every heading of the chapter that lines may hang on

        def step(document, number, line, level, move, told, heads, staff, held, kind, title, label):
            if move in ("push", "trim"):
                del stack[level:]
            parent = (stack[-1] if stack else None) if told != told or told is None else known[int(told)]
            path = [*parent["path"], {"line": parent["line"], "type": parent["type"], "title": parent["title"]}] if parent else []
            suppress = bool(held) or (move == "trim" and any(h["staff"] for h in stack))
            if heads:
                known[line] = {"line": line, "type": kind, "title": title, "staff": bool(staff), "path": path}
                if move in ("push", "append"):
                    stack.append(known[line])
            return document, number, line, parent["line"] if parent else None, "group" if heads else kind, kind, level, title, suppress, label if staff else None, path

        return step

    return _stream(ready, NODES, machine)


def adjacency(lines: DataFrame) -> DataFrame:
    """Adjacency list of the older parser: blocks close on an equal or shallower heading, entries only when something deeper was seen.

    (document, chapter_no, line, parent_line, level, kind, text).
    """

    def machine():
        stack: list[list[int]] = []  # line, indent, level, whether deeper was seen

        def step(document, number, line, indent, label):
            block = label.endswith(":")
            while stack and (indent <= stack[-1][1] if block else indent < stack[-1][1] or (indent == stack[-1][1] and stack[-1][3])):
                stack.pop()
            for open_ in stack:
                open_[3] |= indent > open_[1]
            parent, level = (stack[-1][0], stack[-1][2] + 1) if stack else (None, 2)
            if block:
                stack.append([line, indent, level, 0])
            return document, number, line, parent, level, "block" if block else "entry", label[:-1].strip() if block else label.rstrip(".")

        return step

    return _stream(_body(lines, (F.length("raw") - F.length(F.ltrim("raw"))).alias("indent")), "document string, chapter_no int, line int, parent_line int, level int, kind string, text string", machine)


def index_navigator(lines: DataFrame, groups: list[str]) -> DataFrame:
    """(document, line, parent_line, level, label) of the index, which is each document's first chapter numbered I: groups by their beginnings, regions ('Per ..') in them, entries in the nearest.

    lines: of with_chapters. The chapter is level 1; entries before any group hang on it.
    """
    first = lines.where("is_chapter and chapter_roman = 'I'").groupBy("document").agg(F.min("chapter_no").alias("_c"), F.min("line").alias("_start"))
    inside = lines.join(first, "document").where(F.col("chapter_no") == F.col("_c"))
    label = F.regexp_replace(F.regexp_replace("label", r"\.+$", ""), ":+$", "")
    begins = F.lit(False)
    for g in groups:
        begins = begins | label.startswith(g)
    kind = F.when(F.col("is_chapter"), "chapter").when(begins, "group").when(label.startswith("Per "), "region").otherwise("entry")
    before = W.partitionBy("document").orderBy("line").rowsBetween(W.unboundedPreceding, -1)
    told = inside.withColumn("_k", kind).withColumn("_g", F.last(F.when(F.col("_k") == "group", F.col("line")), ignorenulls=True).over(before))
    told = told.withColumn("_r", F.last(F.when(F.col("_k").isin("group", "region"), F.struct(F.col("_k").alias("k"), "line")), ignorenulls=True).over(before))
    region = F.when(F.col("_r.k") == "region", F.col("_r.line"))
    parent = F.when(F.col("_k") == "group", F.col("_start")).when(F.col("_k") == "region", F.col("_g")).when(F.col("_k") == "entry", F.coalesce(region, "_g", "_start"))
    level = F.when(F.col("_k") == "chapter", 1).when(F.col("_k") == "group", 2).when(F.col("_k") == "region", 3).when(region.isNotNull(), 4).when(F.col("_g").isNotNull(), 3).otherwise(2)
    return told.select("document", "line", parent.alias("parent_line"), level.alias("level"), F.when(F.col("_k") == "chapter", F.col("label")).otherwise(label).alias("label"))


def province_references(nodes: DataFrame, categories: list[tuple[str, str]]) -> DataFrame:
    """(document, line, source_class, source_group, name): the entries of the index chapter below a block of a category (pattern, class), with the block directly within it that holds them.

    nodes: of parse_chapters. Entries of any depth count; blocks are none.
    """
    from tabulary.functions.rules import first_match

    first = nodes.groupBy("document").agg(F.min("chapter_no").alias("_c"))
    below = nodes.join(first, "document").where((F.col("chapter_no") == F.col("_c")) & (F.col("tag") != "group") & (F.size("path") > 0))
    named = below.withColumn("source_class", first_match(F.col("path")[0]["title"], [(rf"(?i)\b{p}\b", c) for p, c in categories]))
    return named.where("source_class is not null and trim(text) <> ''").select("document", "line", "source_class", F.coalesce(F.get("path", F.lit(1))["title"], F.lit("")).alias("source_group"), squeeze(F.col("text")).alias("name"))


def context_text(nodes: DataFrame, shown: tuple[str, ...] = ("place", "province", "region", "title"), stop: tuple[str, ...] = ("chapter", "document")) -> DataFrame:
    """(node_id, context): from each node up to its chapter the marks of the nodes, the texts of their shown children, and the node's own text.

    nodes (node_id, parent_id, tag, ord, text, marks array<string>). Ancestors come from one recursive query over the
    ids; nothing above the first chapter or document on the way is taken.
    """
    from tabulary.functions.text import norm_place_text

    kids = nodes.where(F.col("parent_id").isNotNull() & F.col("tag").isin(*shown) & (F.trim("text") != "")).groupBy(F.col("parent_id").alias("_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.col("node_id").alias("i"), F.trim("text").alias("t")))), lambda s: s["t"]).alias("_kids"))
    own = nodes.select(F.col("node_id").alias("_id"), F.col("tag").alias("_tag"), "marks").join(kids, "_id", "left")
    parts = own.select("_id", "_tag", F.array_join(F.concat(F.coalesce("marks", F.array().cast("array<string>")), F.coalesce("_kids", F.array().cast("array<string>"))), " ").alias("_part"))
    up = paths(nodes, "node_id", "parent_id", "tag").select("node", "path", F.reverse("ids").alias("ids"), F.reverse("path").alias("tags"))
    end = F.array_min(F.filter(F.transform("tags", lambda t, i: F.when(t.isin(*stop), i + 1)), lambda i: i.isNotNull()))
    spread = up.select("node", F.posexplode(F.slice("ids", F.lit(1), F.coalesce(end, F.size("ids")))).alias("n", "_id"))
    joined = spread.join(parts, "_id").groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "_part"))), lambda s: s["_part"]).alias("_parts"))
    text = nodes.select(F.col("node_id").alias("node"), F.trim(F.coalesce("text", F.lit(""))).alias("_own"))
    whole = joined.join(text, "node").select("node", F.array_join(F.concat(F.slice("_parts", F.lit(1), F.lit(1)), F.array("_own"), F.slice("_parts", F.lit(2), F.size("_parts"))), " ").alias("c"))
    return whole.select(F.col("node").alias("node_id"), norm_place_text(F.col("c")).alias("context"))


def roman(number: Column) -> Column:
    """A number from 1 to 3999 as a Roman numeral, '' otherwise."""
    table = F.array(*[F.struct(F.lit(v).alias("v"), F.lit(s).alias("s")) for v, s in ROMAN])
    zero = F.struct(number.cast("int").alias("n"), F.lit("").alias("t"))
    step = lambda acc, r: F.struct((acc["n"] % r["v"]).cast("int").alias("n"), F.concat(acc["t"], F.repeat(r["s"], F.floor(acc["n"] / r["v"]).cast("int"))).alias("t"))
    return F.when(number.between(1, 3999), F.aggregate(table, zero, step, lambda a: a["t"])).otherwise("")


def roman_number(text: Column) -> Column:
    """The value of a Roman numeral, smaller signs before larger ones taken off; null for anything else."""
    letters = F.filter(F.split(F.upper(F.trim(text)), ""), lambda c: c != "")
    values = F.transform(letters, lambda c: F.create_map(*[F.lit(x) for v, s in ROMAN if len(s) == 1 for x in (s, v)])[c])
    signed = F.transform(values, lambda v, i: F.when(v < F.coalesce(F.get(values, i + 1), F.lit(0)), -v).otherwise(v))
    return F.when(text.rlike(r"(?i)^\s*[IVXLCDM]+\s*$"), F.aggregate(signed, F.lit(0), lambda a, v: a + v))


def paths(nodes: DataFrame, node: str, parent: str, value: str, depth: int = 64) -> DataFrame:
    """nodes with path: the values from the root down to each node, by one recursive query; nodes below no root are left out."""
    return nodes.sparkSession.sql(
        f"""WITH RECURSIVE up (node, path, ids) MAX RECURSION LEVEL {depth} AS (
              SELECT {node}, array(CAST({value} AS STRING)), array(CAST({node} AS STRING)) FROM {{n}} WHERE {parent} IS NULL
              UNION ALL SELECT n.{node}, concat(up.path, array(CAST(n.{value} AS STRING))), concat(up.ids, array(CAST(n.{node} AS STRING))) FROM up JOIN {{n}} n ON n.{parent} = up.node)
            SELECT node, path, ids FROM up""",
        n=nodes,
    )


def nearest(path: Column, condition) -> Column:
    """The last element of a path array that fits, which is the nearest ancestor; null when none does."""
    return F.get(F.reverse(F.filter(path, condition)), F.lit(0))


def visible_parent(path: Column, hidden: list[str]) -> Column:
    """The nearest ancestor whose tag is not hidden; hidden tags hand their children up."""
    return nearest(F.slice(path, F.lit(1), F.greatest(F.size(path) - 1, F.lit(0))), lambda p: ~p.isin(hidden))


def children_text(nodes: DataFrame) -> DataFrame:
    """(parent, texts): a map from tag to the texts of the direct children with it, in order; nodes (parent, tag, text, ord)."""
    per = nodes.where("parent is not null and text <> ''").groupBy("parent", "tag").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda s: s["text"]).alias("texts"))
    return per.groupBy("parent").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tag", "texts")))).alias("texts"))


def own_text(title: Column, texts: Column, text: Column) -> Column:
    """A node's own text: its title, else its semantic children joined, else the text of a leaf; never that of descendants."""
    parts = F.array_join(F.flatten(F.array_compact(F.array(*[texts[t] for t in PLACEABLE]))), " ")
    return F.coalesce(F.nullif(squeeze(title), F.lit("")), F.nullif(squeeze(parts), F.lit("")), F.when(texts.isNull(), squeeze(text)), F.lit(""))


def aligned(left: DataFrame, right: DataFrame) -> DataFrame:
    """left with the text of the parallel tree: the node at the same index path with the same tag, else the first with the same line, else its own.

    Both: (document, index_path, tag, line, text).
    """
    same = right.select("document", "index_path", "tag", F.col("text").alias("_same"))
    lines = right.where("line is not null").groupBy("document", "line").agg(F.min_by("text", "index_path").alias("_line"))
    return left.join(same, ["document", "index_path", "tag"], "left").join(lines, ["document", "line"], "left").withColumn("parallel", F.coalesce("_same", "_line", "text")).drop("_same", "_line")


def short_title(title: Column) -> Column:
    """The first and last word of a title."""
    words = F.filter(F.split(title, r"\s+"), lambda w: w != "")
    return F.when(F.size(words) > 2, F.concat_ws(" ", words[0], F.element_at(words, -1))).otherwise(F.array_join(words, " "))


def check_tree(nodes: DataFrame) -> DataFrame:
    """(node_id, problem) for nodes (node_id, parent_id, level, kind): missing or own parent, level not one below the parent's, chapters without exactly one title, empty blocks."""
    parents = nodes.select(F.col("node_id").alias("_p"), F.col("level").alias("_l"))
    counts = nodes.where("parent_id is not null").groupBy(F.col("parent_id").alias("node_id")).agg(F.count("*").alias("_n"), F.count_if(F.col("kind") == "title").alias("_t"))
    joined = nodes.join(parents, F.col("parent_id") == F.col("_p"), "left").join(counts, "node_id", "left").fillna(0, ["_n", "_t"])
    has = F.col("parent_id").isNotNull()
    problems = F.array_compact(F.array(
        F.when(has & F.col("_p").isNull(), "MISSING_PARENT"), F.when(F.col("parent_id") == F.col("node_id"), "SELF_PARENT"), F.when(F.col("_p").isNotNull() & (F.col("level") != F.col("_l") + 1), "LEVEL"),
        F.when((F.col("kind") == "chapter") & (F.col("_t") != 1), "CHAPTER_TITLE"), F.when(F.col("kind").isin("block", "heading") & (F.col("_n") == 0), "EMPTY_BLOCK"),
    ))
    return joined.select("node_id", F.explode(problems).alias("problem"))


def unreachable(nodes: DataFrame, rounds: int = 10_000) -> DataFrame:
    """Nodes (node_id, parent_id) that no root reaches: orphans and members of cycles. Semi-joins a level at a time, each written."""
    from tabulary.session import written

    edges = nodes.select("node_id", "parent_id")
    frontier = written(edges.where("parent_id is null").select("node_id"), "reach")
    reached = frontier
    for _ in range(rounds):
        frontier = written(edges.join(frontier.select(F.col("node_id").alias("parent_id")), "parent_id", "left_semi").select("node_id").join(reached, "node_id", "left_anti").distinct(), "reach")
        if frontier.isEmpty():
            return nodes.join(reached, "node_id", "left_anti")
        reached = reached.unionByName(frontier)
    raise ValueError(f"the tree is deeper than {rounds} levels")


def xml_nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Recursive XML to node rows, for mapInPandas over (document, text); comments and processing instructions are passed over."""
    import xml.etree.ElementTree as ET

    for batch in batches:
        rows = []
        for document, text in zip(batch["document"], batch["text"], strict=True):
            try:
                root = ET.fromstring(text or "")
            except ET.ParseError:
                continue
            stack = [(root, None, 1, "")]
            count = 0
            while stack:
                element, parent, order, base = stack.pop()
                count += 1
                path = f"{base}/{order:05d}"
                rows.append((document, count, parent, order, path, element.tag, " ".join((element.text or "").split()), dict(element.attrib)))
                own = count
                stack += [(child, own, i, path) for i, child in reversed(list(enumerate(element, 1)))]
        yield pd.DataFrame(rows, columns=["document", "node_id", "parent_id", "ord", "index_path", "tag", "text", "attrs"]).astype({"parent_id": "Int64"})


XML_SCHEMA = "document string, node_id bigint, parent_id bigint, ord int, index_path string, tag string, text string, attrs map<string,string>"
