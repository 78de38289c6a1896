"""Readers of table files in many formats, by content as much as by name.

Files are found and sniffed on the executors (``binaryFile``, first bytes); big delimited text goes to Spark's own
readers. Formats that Spark can't read are parsed a file per row; a file that can't be parsed has a reason instead of rows.
"""

from __future__ import annotations

import csv
import gzip
import html.parser
import io
import json
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.functions.text import make_unique
from lodeseek.operators import profile

ENCODINGS = ("utf-8", "utf-8-sig", "latin-1", "cp1252", "utf-16")
SEPARATORS = (None, ",", ";", "\t", "|")
ZIP_ORDER = ("csv", "tsv", "txt", "xlsx", "xls", "json")
ROWS = "path string, row_no long, cells map<string,string>, reason string"


class Unreadable(ValueError):
    """A file without a table, with the reason."""


def discover(spark: SparkSession, root: str, limit: int | None = None) -> DataFrame:
    """(path, relative_path, size), sorted by path; a limit is at least 1."""
    base = root.rstrip("/").removeprefix("file:")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.regexp_replace("path", r"^file:/*(?=/)", "").alias("__p"), F.col("length").alias("size"))
    files = files.select("path", F.substring("__p", len(base) + 2, 100_000).alias("relative_path"), "size").orderBy("path")
    return files if limit is None else files.limit(max(1, limit))


def signature(content: Column) -> Column:
    """S3: zip, html, blank or other, by the first bytes."""
    head = F.lower(F.decode(F.substring(content, 1, 400), "ISO-8859-1"))
    blank = F.decode(F.substring(content, 1, 65536), "ISO-8859-1").rlike(r"^\s*$")
    page = F.regexp_replace(head, r"^[\s﻿ï»¿]+", "").rlike(r"^(<!doctype html|<html|<head|<body)")
    return F.when(F.hex(F.substring(content, 1, 4)).isin("504B0304", "504B0506", "504B0708"), "zip").when(page, "html").when(blank, "blank").otherwise("other")


def streamable(path: Column, kind: Column) -> Column:
    """Whether a file can be scanned in parts: csv, txt and gz that are neither zip nor blank."""
    return F.lower(path).rlike(r"\.(csv|txt|gz)$") & ~kind.isin("zip", "blank")


def csv_frame(data: bytes) -> pd.DataFrame:
    """The first of 5 encodings x 5 separators (the first sniffed) that parses; rows of another length go."""
    for encoding in ENCODINGS:
        try:
            text = data.decode(encoding)
        except UnicodeError:
            continue
        for sep in SEPARATORS:
            try:
                dialect = sep or csv.Sniffer().sniff(text.lstrip().split("\n", 1)[0], ",;\t|").delimiter
                rows = [r for r in csv.reader(io.StringIO(text), delimiter=dialect) if r]
            except csv.Error:
                continue
            if rows and any(c.strip() for c in rows[0]):
                width = len(rows[0])
                return pd.DataFrame([r + [""] * (width - len(r)) for r in rows[1:] if len(r) <= width], columns=make_unique(rows[0]), dtype=str)
    raise Unreadable("csv_unparsable")


def json_frame(data: bytes) -> pd.DataFrame:
    """One document, else a document a line."""
    try:
        text = data.decode("utf-8-sig")
    except UnicodeError:
        raise Unreadable("json_undecodable") from None
    try:
        found = json.loads(text)
    except ValueError:
        try:
            found = [json.loads(x) for x in text.splitlines() if x.strip()]
        except ValueError:
            raise Unreadable("json_unparsable") from None
    if isinstance(found, dict):
        lists = [v for v in found.values() if isinstance(v, list)]
        found = pd.DataFrame(found).to_dict("records") if lists and len(lists) == len(found) and len({*map(len, lists)}) == 1 else [found]
    return pd.DataFrame([x if isinstance(x, dict) else {"value": x} for x in found])


class _Tables(html.parser.HTMLParser):
    """Cells of the first table of a page."""

    def __init__(self):
        super().__init__()
        self.rows, self.depth, self.done, self.cell = [], 0, False, None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.depth += 1
        elif self.depth == 1 and not self.done:
            if tag == "tr":
                self.rows.append([])
            elif tag in ("td", "th"):
                self.cell = []

    def handle_endtag(self, tag):
        if self.depth == 1 and not self.done and tag in ("td", "th") and self.cell is not None:
            if not self.rows:
                self.rows.append([])
            self.rows[-1].append(" ".join("".join(self.cell).split()))
            self.cell = None
        if tag == "table" and self.depth:
            self.depth -= 1
            self.done = self.done or self.depth == 0

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


def html_frame(data: bytes) -> pd.DataFrame:
    """The first table; a page without one has none."""
    parser = _Tables()
    parser.feed(data.decode("utf-8", "replace"))
    rows = [r for r in parser.rows if r]
    if not rows:
        raise Unreadable("html_non_tabular")
    width = len(rows[0])
    return pd.DataFrame([(r + [""] * width)[:width] for r in rows[1:]], columns=make_unique(rows[0]), dtype=str)


def excel_frame(data: bytes, extension: str) -> pd.DataFrame:
    """Needs an installed reader; without one it is a dependency error, which may be tried again."""
    try:
        return pd.read_excel(io.BytesIO(data), engine="xlrd" if extension == "xls" else "openpyxl", dtype=str)
    except ImportError as missing:
        raise Unreadable("missing_dependency_" + ("xlrd" if extension == "xls" else "openpyxl")) from missing
    except Exception as bad:  # noqa: BLE001
        raise Unreadable("excel_unparsable") from bad


def zip_frame(data: bytes) -> pd.DataFrame:
    """The first member that parses, by order of extensions; empty ones are passed over."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile:
        raise Unreadable("zip_unreadable") from None
    for ext in ZIP_ORDER:
        for member in sorted(archive.namelist()):
            if member.lower().endswith("." + ext) and archive.getinfo(member).file_size:
                try:
                    return frame(member, archive.read(member))
                except Unreadable:
                    continue
    raise Unreadable("zip_no_tabular_member")


def frame(path: str, data: bytes) -> pd.DataFrame:
    """A table from a file's name and bytes."""
    name = path.lower()
    ext = name.rsplit(".", 1)[-1] if "." in name.rsplit("/", 1)[-1] else ""
    if not data[:65536].strip():
        raise Unreadable("empty_file")
    if ext == "gz":
        try:
            inner = gzip.decompress(data)
        except (OSError, EOFError, zlib.error):
            raise Unreadable("gz_corrupt") from None
        for read in (csv_frame, json_frame):
            try:
                return read(inner)
            except Unreadable:
                continue
        raise Unreadable("gz_unparsable")
    if ext in ("csv", "tsv"):
        return html_frame(data) if data[:400].lstrip().lower().startswith((b"<!doctype html", b"<html")) else zip_frame(data) if data[:2] == b"PK" else csv_frame(data)
    if ext in ("xls", "xlsx"):
        return excel_frame(data, ext)
    if ext in ("json", "jsonl", "ndjson"):
        return json_frame(data)
    if ext in ("html", "htm"):
        return html_frame(data)
    if ext == "zip":
        return zip_frame(data)
    if ext == "txt":
        try:
            got = csv_frame(data)
            if got.shape[1] > 1:
                return got
        except Unreadable:
            pass
        return pd.DataFrame({"text": data.decode("utf-8", "replace").splitlines()})
    if ext in ("parquet", "feather", "orc"):
        import pyarrow as pa
        from pyarrow import feather, orc, parquet

        source = pa.BufferReader(data)
        try:
            return (parquet.read_table(source) if ext == "parquet" else feather.read_table(source) if ext == "feather" else orc.read_table(source)).to_pandas()
        except (pa.ArrowException, OSError):
            raise Unreadable(f"{ext}_unparsable") from None
    for read in (zip_frame, lambda x: excel_frame(x, "xlsx"), html_frame, csv_frame, json_frame):
        try:
            return read(data)
        except (Unreadable, UnicodeError):
            continue
    raise Unreadable("unknown_format")


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, row_no, cells, reason): every cell of every table file as text, nested values as JSON; one row with a reason for a
    file without a table, and for one that breaks its reader in any way."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, data in zip(batch["path"], batch["content"]):
                try:
                    t = frame(path, data)
                    cell = lambda v: None if v is None or v is pd.NA or (isinstance(v, float) and v != v) else json.dumps(v, ensure_ascii=False) if isinstance(v, (dict, list)) else str(v)
                    rows = [{str(k): cell(v) for k, v in r.items()} for r in t.to_dict("records")]
                    yield pd.DataFrame({"path": path, "row_no": range(len(rows)), "cells": rows, "reason": None})
                except Exception as why:  # noqa: BLE001  one bad file is a row with its reason, never the end of the read
                    reason = str(why) if isinstance(why, Unreadable) else f"unreadable_{type(why).__name__}"
                    yield pd.DataFrame({"path": [path], "row_no": [None], "cells": [None], "reason": [reason]})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "content")
    return files.mapInPandas(parse, ROWS)


def read_delimited(spark: SparkSession, path: str, sep: str = ",", encoding: str = "utf-8") -> DataFrame:
    """A big file in parts, all columns as text, malformed rows dropped."""
    return spark.read.csv(path, sep=sep, header=True, inferSchema=False, encoding=encoding, mode="DROPMALFORMED")


def two_passes(spark: SparkSession, path: str, n: int, seed: int = 42, sep: str = ",") -> tuple[DataFrame, DataFrame]:
    """Of a big delimited file the statistics of every row, and a sample of at most n rows, each from a scan of its own
    that Spark splits; neither holds the file."""
    rows = read_delimited(spark, path, sep)
    h = F.xxhash64(F.struct(*(F.col(f"`{c}`") for c in rows.columns)), F.lit(seed))
    return profile.global_stats(rows), rows.withColumn("__h", h).orderBy("__h", *(F.col(f"`{c}`") for c in rows.columns)).limit(n).drop("__h")


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """A record a line; a bad line is an error, or else dropped."""
    return spark.read.schema(schema).json(path, mode="FAILFAST" if strict else "DROPMALFORMED")
