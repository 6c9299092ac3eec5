"""Writers: fixed columns, ; or , delimited, JSON documents, XML rows and reports. A table that is written anew is first written beside the old one, then put in its place."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@contextmanager
def replacing(spark: SparkSession, path: str) -> Iterator[str]:
    """A folder beside path to write to; on success it takes path's place by renames, and on failure path stays as it was."""
    jvm, beside, old = spark._jvm.org.apache.hadoop.fs, f"{path.rstrip('/')}.new-{uuid.uuid4().hex}", f"{path.rstrip('/')}.old-{uuid.uuid4().hex}"
    target = jvm.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        yield beside
        had = files.exists(target)
        if had and not files.rename(target, jvm.Path(old)):
            raise OSError(f"{path} cannot be moved aside")
        if not files.rename(jvm.Path(beside), target):
            if had:
                files.rename(jvm.Path(old), target)
            raise OSError(f"{path} cannot be replaced")
        if had:
            files.delete(jvm.Path(old), True)
    finally:
        files.delete(jvm.Path(beside), True)


def write_delimited(df: DataFrame, path: str, columns: Sequence[str], sep: str = ",", strict: bool = False) -> None:
    """The columns in their order, null as empty. strict: fail on any other column; else leave it out. A missing one is empty."""
    extra = [c for c in df.columns if c not in columns]
    if strict and extra:
        raise ValueError(f"columns that are not written: {', '.join(extra)}")
    out = df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast("string").alias(c) for c in columns])
    with replacing(df.sparkSession, path) as beside:
        out.write.csv(beside, header=True, sep=sep, quote='"', escape='"', emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def json_entries(df: DataFrame, key: str, metadata: dict[str, str]) -> DataFrame:
    """(value): one JSON line per entry, {"key": ..., "entry": {...}}, and one of metadata; the document is the folder of lines, so no task holds it whole."""
    body = df.select(F.to_json(F.struct(F.col(key).alias("key"), F.struct(*[c for c in df.columns if c != key]).alias("entry"))).alias("value"))
    head = df.sparkSession.createDataFrame([(list(metadata.items()),)], "m array<struct<k:string,v:string>>").select(F.to_json(F.struct(F.map_from_entries("m").alias("metadata"))).alias("value"))
    return head.unionByName(body)


def write_xml(df: DataFrame, path: str, row: str, root: str) -> None:
    """Flat rows as XML elements."""
    with replacing(df.sparkSession, path) as beside:
        df.write.format("xml").option("rowTag", row).option("rootTag", root).save(beside)


def tree_xml(nodes: DataFrame) -> DataFrame:
    """(document, text): indented XML of node rows (document, node_id, parent_id, ord, tag, text, attrs); a document is one group."""
    import pandas as pd

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        import xml.etree.ElementTree as ET

        made, root = {}, None
        for r in pdf.sort_values(["node_id"]).itertuples():
            element = made[r.node_id] = ET.Element(r.tag, dict(r.attrs or {}))
            element.text = r.text or None
            if pd.isna(r.parent_id):
                root = element
        for r in pdf.sort_values(["parent_id", "ord"]).itertuples():
            if not pd.isna(r.parent_id):
                made[int(r.parent_id)].append(made[r.node_id])
        ET.indent(root, "    ")
        return pd.DataFrame({"document": [pdf["document"].iloc[0]], "text": [ET.tostring(root, encoding="unicode")]})

    return nodes.groupBy("document").applyInPandas(build, "document string, text string")


def write_report(report: DataFrame, path: str) -> None:
    """A report (section, key, value) as lines of text, in order."""
    lines = report.orderBy("section", "key").select(F.concat_ws("\t", "section", "key", F.col("value").cast("string")).alias("value"))
    with replacing(report.sparkSession, path) as beside:
        lines.write.text(beside)
