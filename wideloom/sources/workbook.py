"""Folders of .xlsx workbooks: one file per row of a binary scan, parsed inside the tasks."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

ROWS_SCHEMA = "file string, row_no int, cells array<string>"


def scan_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """``(file, row_no, cells)`` of the first sheet of every workbook under ``path``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInPandas(_rows, ROWS_SCHEMA)


def read_workbooks(spark: SparkSession, path: str, *, infer: bool = True) -> DataFrame:
    """Table of all workbooks; the first row of each file is its header, matched by name."""
    from wideloom.sources.tables import NA_TOKENS, infer_types, typed

    rows = scan_workbooks(spark, path)
    headers = rows.where("row_no = 0").select(F.explode("cells").alias("name")).where("name IS NOT NULL") \
        .distinct().orderBy("name")
    first = rows.where("row_no = 0").orderBy("file").limit(1).select("cells").collect()
    order = {n: i for i, n in enumerate(first[0]["cells"])} if first else {}
    names = sorted((r["name"] for r in headers.collect()), key=lambda n: (order.get(n, len(order)), n))
    heads = rows.where("row_no = 0").select("file", F.col("cells").alias("header"))
    # One header row per file, while a file has many rows.
    body = rows.where("row_no > 0").join(heads, "file")
    cell = lambda n: F.try_element_at("cells", F.array_position("header", F.lit(n)).cast("int"))
    text = body.select(*[F.when(F.array_contains("header", F.lit(n)), cell(n)).alias(n) for n in names])
    text = text.select(*[F.when(~F.col(f"`{n}`").isin(*NA_TOKENS), F.col(f"`{n}`")).alias(n) for n in names])
    return typed(text, infer_types(text)) if infer else text


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            cells = list(first_sheet(content))
            yield pd.DataFrame({"file": path, "row_no": range(len(cells)), "cells": cells})


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def first_sheet(content: bytes) -> Iterator[list[str | None]]:
    """Cell texts of the first sheet, row by row."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = set(book.namelist())
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
            shared = ["".join(t.text or "" for t in item.iter() if _local(t.tag) == "t") for item in root]
        width, rows = 0, []
        for _, node in ElementTree.iterparse(io.BytesIO(book.read(_sheet_path(book)))):
            if _local(node.tag) != "row":
                continue
            row: dict[int, str | None] = {}
            for cell in (c for c in node if _local(c.tag) == "c"):
                at = _column(cell.get("r")) if cell.get("r") else len(row)
                row[at] = _text(cell, shared)
            if row:
                width = max(width, max(row) + 1)
                rows.append(row)
            node.clear()
        for row in rows:
            yield [row.get(i) for i in range(width)]


def _sheet_path(book: zipfile.ZipFile) -> str:
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    sheet = next(n for n in root.iter() if _local(n.tag) == "sheet")
    wanted = next(v for k, v in sheet.attrib.items() if _local(k) == "id")
    links = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    target = next(n.get("Target") for n in links if n.get("Id") == wanted)
    return target.lstrip("/") if target.startswith("/") else "xl/" + target


def _column(reference: str) -> int:
    index = 0
    for letter in re.match(r"[A-Z]+", reference).group():
        index = index * 26 + ord(letter) - 64
    return index - 1


def _text(cell: ElementTree.Element, shared: list[str]) -> str | None:
    kind = cell.get("t")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter() if _local(t.tag) == "t")
    value = next((n.text for n in cell if _local(n.tag) == "v"), None)
    if value is None:
        return None
    if kind == "s":
        return shared[int(value)]
    if kind == "b":
        return "True" if value == "1" else "False"
    return value
