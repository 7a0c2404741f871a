"""Scans and sinks: JSON lines, text, archives of XHTML, device logs, chat files."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: fixed values: fields that hold a line's text, in the order they are tried
TEXT_FIELDS = ("text", "content", "body", "ocr", "truth", "sentence")
UNIT = "path string, ordinal int, text string"


def jsonl_units(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): one unit a line; the first conventional text field that is there, else the longer string values.

    A line that is no JSON object is its own text.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value").filter(F.trim("value") != "")
    fields = F.from_json("value", T.MapType(T.StringType(), T.StringType()), {"mode": "PERMISSIVE"})
    named = F.coalesce(*[F.col("fields")[f] for f in TEXT_FIELDS])
    long = F.array_join(F.filter(F.map_values("fields"), lambda v: F.length(v) > 20), "\n")
    is_object = F.col("fields").isNotNull() & (F.size("fields") > 0)
    return lines.withColumn("fields", fields).select("path", F.when(is_object, F.coalesce(named, long)).otherwise(F.col("value")).alias("text"))


def text_units(spark: SparkSession, path: str) -> DataFrame:
    """(path, ordinal, text): blocks between blank lines of whole files."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", r"\n[ \t\r]*\n")).alias("ordinal", "text"))
    return whole.withColumn("text", F.btrim("text", F.lit(" \t\r\n"))).filter("text <> ''")


def epub_units(spark: SparkSession, path: str) -> DataFrame:
    """(path, ordinal, text): the spine items of each archive, in order, as XHTML; an unreadable archive has none."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(_spines, UNIT)


def _spines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import io
    import posixpath
    import zipfile
    from xml.etree import ElementTree

    local = lambda e: e.tag.rsplit("}", 1)[-1]
    for batch in batches:
        rows = []
        for path, content in zip(batch["path"], batch["content"], strict=True):
            try:
                book = zipfile.ZipFile(io.BytesIO(content))
                root = ElementTree.fromstring(book.read("META-INF/container.xml"))
                opf = next(e.get("full-path") for e in root.iter() if local(e) == "rootfile")
                package = ElementTree.fromstring(book.read(opf))
                hrefs = {e.get("id"): e.get("href") for e in package.iter() if local(e) == "item"}
                spine = [hrefs[e.get("idref")] for e in package.iter() if local(e) == "itemref" and e.get("idref") in hrefs]
                rows += [(path, i, book.read(posixpath.normpath(posixpath.join(posixpath.dirname(opf), h))).decode("utf-8", "replace")) for i, h in enumerate(spine)]
            except (zipfile.BadZipFile, KeyError, StopIteration, ElementTree.ParseError):
                continue
        yield pd.DataFrame(rows, columns=["path", "ordinal", "text"])


def device_logs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of all *.jsonl logs under path; conflict copies, dot files and malformed lines are left out."""
    rows = spark.read.schema(schema).option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", "true").option("mode", "DROPMALFORMED").json(path)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return rows.filter(~name.contains("sync-conflict") & ~name.startswith("."))


def write_chat(rows: DataFrame, path: str, system: str, source: str, target: str) -> None:
    """One {"messages": [...]} object a line, of a system, a user and an assistant turn."""
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    messages = F.array(turn("system", F.lit(system)), turn("user", F.col(source)), turn("assistant", F.col(target)))
    rows.select(F.to_json(F.struct(messages.alias("messages"))).alias("value")).write.mode("overwrite").text(path)


def write_reports(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines, nulls left out."""
    rows.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)
