"""Readers: delimited text with a sniffed delimiter, JSON graphs, GeoJSON, XML and whole texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulary.operators.tree import XML_SCHEMA, xml_nodes


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    """; or tab when the first non-blank line has more of it than of commas, else ','. Reads that line only."""
    first = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    line = first[0][0] if first else ""
    best = max(",;\t", key=lambda d: (line.count(d), d == ","))
    return best if line.count(best) else ","


def read_delimited(spark: SparkSession, path: str, delimiter: str | None = None, trim: bool = False) -> DataFrame:
    """A file with a header, all columns text. Doubled quotes, line breaks in quotes and a byte order mark are understood; rows all empty are dropped."""
    df = spark.read.csv(path, header=True, sep=delimiter or sniff_delimiter(spark, path), quote='"', escape='"', multiLine=True, inferSchema=False, ignoreLeadingWhiteSpace=trim, ignoreTrailingWhiteSpace=trim)
    df = df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])
    return df.where(F.greatest(*[F.coalesce(F.trim(F.col(f"`{c}`")), F.lit("")) for c in df.columns], F.lit("")) != "")


def alternatives(df: DataFrame, *names: str) -> Column:
    """The first non-blank of columns of which any may be missing, '' when none has a value."""
    present = [F.nullif(F.trim(F.col(f"`{n}`").cast("string")), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*present, F.lit(""))


def read_lines(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(document, text) of whole files, for lines_of; one row per file."""
    parts = [spark.read.text(path, wholetext=True).select(F.lit(name).alias("document"), F.col("value").alias("text")) for name, path in paths.items()]
    return reduce(DataFrame.unionByName, parts)


def combined(lines: DataFrame) -> DataFrame:
    """Lines of all documents with a 'DOCUMENT: name' line (0) before each."""
    marks = lines.select("document").distinct().select("document", F.lit(0).alias("line"), F.concat(F.lit("DOCUMENT: "), "document").alias("raw"))
    return lines.select("document", "line", "raw").unionByName(marks)


def graph_records(texts: DataFrame) -> DataFrame:
    """(record) as VARIANT of JSON documents (text): the members of @graph or features, or of a list."""
    parsed = texts.select(F.parse_json("text").alias("j"))
    pick = lambda path: F.try_variant_get("j", path, "array<variant>")
    return parsed.select(F.explode(F.coalesce(pick("$['@graph']"), pick("$.features"), pick("$"))).alias("record"))


def geo_features(texts: DataFrame) -> DataFrame:
    """(ord, properties, geometry) of GeoJSON collections (text): polygons and multipolygons only."""
    schema = "features array<struct<type:string,properties:map<string,string>,geometry:string>>"
    rows = texts.select(F.posexplode(F.from_json("text", schema)["features"]).alias("ord", "f")).select("ord", "f.properties", "f.geometry")
    return rows.where(F.get_json_object("geometry", "$.type").isin("Polygon", "MultiPolygon"))


def xml_tree(texts: DataFrame) -> DataFrame:
    """Nodes of XML documents (document, text): id, parent, order, index path, tag, text and attributes; a document that does not parse has none and is listed by xml_errors."""
    return texts.select("document", "text").mapInPandas(xml_nodes, XML_SCHEMA)


def xml_errors(texts: DataFrame) -> DataFrame:
    """(document, error) of the XML documents (document, text) that do not parse; null text is no document."""
    def failed(batches):
        import xml.etree.ElementTree as ET

        for batch in batches:
            rows = []
            for document, text in zip(batch["document"], batch["text"], strict=True):
                try:
                    ET.fromstring(text)
                except ET.ParseError as e:
                    rows.append((document, str(e)))
            yield batch.iloc[:0][["document"]].assign(error="") if not rows else type(batch)(rows, columns=["document", "error"])

    return texts.select("document", "text").where("text is not null").mapInPandas(failed, "document string, error string")


def read_chapter_urls(spark: SparkSession, path: str) -> DataFrame:
    """(document, chapter, folio, url) of a delimited file of chapters; rows without document, chapter number or url are out, of repeated chapters the last stays."""
    rows = read_delimited(spark, path)
    missing = [c for c in ("document", "chapter", "start_folio", "url") if c not in rows.columns]
    if missing:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    clean = rows.select(F.trim("document").alias("document"), F.trim("chapter").try_cast("int").alias("chapter"), F.trim("start_folio").alias("folio"), F.trim("url").alias("url"), F.monotonically_increasing_id().alias("_o")).where("document <> '' and chapter <> 0 and url <> ''")
    return clean.groupBy("document", "chapter").agg(F.max_by(F.struct("folio", "url"), "_o").alias("v")).select("document", "chapter", "v.folio", "v.url")


def with_urls(chapters: DataFrame, urls: DataFrame) -> DataFrame:
    """chapters (document, chapter, ..) with the folio and url of their chapter, null where there is none."""
    return chapters.join(urls, ["document", "chapter"], "left")


def shape(texts: DataFrame) -> DataFrame:
    """(schema): the merged shape of JSON documents (text)."""
    return texts.select(F.schema_of_variant_agg(F.parse_json("text")).alias("schema"))


def optional_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet table at a path, or an empty one of that schema when there is none."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def json_array_items(batches, key: str = "@graph", chunk: int = 1 << 20):
    """Members of the array under a key of JSON files, a chunk at a time, for mapInPandas over (uri): (uri, ord, item text).

    The file is never held whole: the decoder takes one member after another from a sliding buffer, and before the key
    only as much is kept as the key is long. A member is taken when what follows it has been read, so a number is never
    cut at the edge of a chunk. ValueError for a file without the key, and for one that ends or goes wrong within the array.
    """
    import codecs
    import json

    import pandas as pd
    from pyarrow import fs

    decoder, name = json.JSONDecoder(), f'"{key}"'
    for batch in batches:
        for uri in batch["uri"]:
            system, path = fs.FileSystem.from_uri(uri)
            with system.open_input_stream(path) as raw:
                decode, buffer, state, rows, n, ended = codecs.getincrementaldecoder("utf-8-sig")().decode, "", "key", [], 0, False
                while state != "done":
                    data = raw.read(chunk)
                    ended = not data
                    buffer += decode(data, final=ended)
                    if state == "key":
                        at = buffer.find(name)
                        buffer, state = (buffer[at + len(name) :], "start") if at >= 0 else (buffer[-len(name) :], "key")
                    if state == "start" and (rest := buffer.lstrip(" \r\n\t:")):
                        if rest[0] != "[":
                            buffer, state = rest, "key"
                            continue
                        buffer, state = rest[1:], "items"
                    while state == "items":
                        buffer = buffer.lstrip(" \r\n\t,")
                        if buffer.startswith("]"):
                            state = "done"
                            break
                        try:
                            item, end = decoder.raw_decode(buffer)
                        except ValueError:
                            break
                        after = buffer[end:].lstrip(" \r\n\t")
                        if not after or after[0] not in ",]":
                            if after:
                                raise ValueError(f"{uri}: item {n} of {key} is followed by {after[:20]!r}")
                            break
                        rows.append((uri, n, json.dumps(item, ensure_ascii=False)))
                        n, buffer = n + 1, after
                        if len(rows) >= 5000:
                            yield pd.DataFrame(rows, columns=["uri", "ord", "item"])
                            rows = []
                    if ended and state != "done":
                        raise ValueError(f"{uri}: " + (f"no array {key}" if state != "items" else f"ends within {key} after {n} items"))
                yield pd.DataFrame(rows, columns=["uri", "ord", "item"])


def json_array(spark: SparkSession, uris: list[str], key: str = "@graph") -> DataFrame:
    """(uri, ord, item): the members of one large array per file, read in constant memory, a file a task."""
    from functools import partial

    files = spark.createDataFrame([(u,) for u in uris], "uri string").repartition(max(1, len(uris)), "uri")
    return files.mapInPandas(partial(json_array_items, key=key), "uri string, ord bigint, item string")
