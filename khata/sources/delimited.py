"""Delimited files under an unknown preamble: bytes to cells, and which column means what."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from khata.functions.text import header_key

# Files past this size are refused, and how the 0x80-0x9f bytes of cp1252 read.
MAX_BYTES = 256 * 1024 * 1024
_HIGH = {
    0x80: "€", 0x82: "‚", 0x83: "ƒ", 0x84: "„", 0x85: "…", 0x86: "†", 0x87: "‡", 0x88: "ˆ", 0x89: "‰",
    0x8A: "Š", 0x8B: "‹", 0x8C: "Œ", 0x8E: "Ž", 0x91: "‘", 0x92: "’", 0x93: "“", 0x94: "”", 0x95: "•",
    0x96: "–", 0x97: "—", 0x98: "˜", 0x99: "™", 0x9A: "š", 0x9B: "›", 0x9C: "œ", 0x9E: "ž", 0x9F: "Ÿ",
}
_UNDEFINED = "[\x81\x8d\x8f\x90\x9d]"


class RefusedFile(ValueError):
    """A file that cannot be taken for what it should be."""


def read_files(spark: SparkSession, path: str, strict: bool = True, most: int = MAX_BYTES) -> DataFrame:
    """(file, content) of every file. Files of more than ``most`` bytes stop a strict job; a lenient one lists them by ``oversized``."""
    if strict:
        large = [r["file"] for r in oversized(spark, path, most).select("file").take(3)]
        if large:
            raise RefusedFile(f"more than {most} bytes: {large}")
    return (
        spark.read.format("binaryFile").load(path)
        .filter(F.col("length") <= most)
        .select(F.col("path").alias("file"), "content")
    )


def oversized(spark: SparkSession, path: str, most: int = MAX_BYTES) -> DataFrame:
    """(file, reason) of files past the limit; reads no content."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length")
    return files.filter(F.col("length") > most).select("file", F.format_string("%d bytes are more than the %d taken", "length", F.lit(most)).alias("reason"))


def decoded(content: Column) -> Column:
    """UTF-8 with or without a mark, else cp1252, else latin-1."""
    utf8 = content.cast("string")
    latin = F.decode(content, "ISO-8859-1")
    windows = F.translate(latin, "".join(map(chr, _HIGH)), "".join(_HIGH.values()))
    text = F.when(F.is_valid_utf8(utf8), utf8).when(latin.rlike(_UNDEFINED), latin).otherwise(windows)
    return F.regexp_replace(text, "^﻿", "")


def _line_cells(line: Column) -> Column:
    """Cells of one line, however many; a quoted cell loses its quotes and its doubled quotes become single."""
    quoted = F.transform(
        # a comma counts when an even number of quotes follows it
        F.split(line, ',(?=(?:[^"]*"[^"]*")*[^"]*$)', -1),
        lambda c: F.when(F.startswith(c, F.lit('"')), F.replace(F.regexp_replace(c, '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(c),
    )
    return F.when(F.contains(line, F.lit('"')), quoted).otherwise(F.split(line, ",", -1))


def cells(files: DataFrame) -> DataFrame:
    """(file, line, cells) of every line, numbered from one.

    Lines are split in the JVM. Only a file in which some line holds an odd number of
    quotes, so that a cell may run over the line end, goes through the csv module.
    """
    texts = files.select("file", decoded(F.col("content")).alias("text"))
    split = texts.withColumn("lines", F.split("text", "\r\n|\r|\n"))
    odd = F.exists("lines", lambda line: F.length(F.regexp_replace(line, '[^"]', "")) % 2 == 1)
    split = split.withColumn("runs_over", odd)

    plain = (
        split.filter("NOT runs_over")
        .select("file", F.posexplode("lines").alias("_at", "raw"))
        .select("file", (F.col("_at") + 1).cast("bigint").alias("line"), _line_cells(F.col("raw")).alias("cells"))
    )

    def by_module(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, text in zip(batch["file"], batch["text"]):
                held: list = []
                for at, row in enumerate(csv.reader(io.StringIO(text)), start=1):
                    held.append((name, at, row))
                    if len(held) == 10_000:
                        yield pd.DataFrame(held, columns=["file", "line", "cells"])
                        held = []
                if held:
                    yield pd.DataFrame(held, columns=["file", "line", "cells"])

    wrapped = split.filter("runs_over").select("file", "text").mapInPandas(
        by_module, "file string, line bigint, cells array<string>"
    )
    return plain.unionByName(wrapped).filter(F.exists("cells", lambda c: F.trim(c) != ""))


def _named_exactly(words: tuple[str, ...]):
    return lambda i: F.col("_keys")[i].isin(*words)


def _free_and_starting(words: tuple[str, ...], spare: int):
    def test(i: Column) -> Column:
        key = F.col("_keys")[i]
        starts = F.lit(False)
        for word in words:
            starts = starts | (F.startswith(key, F.lit(word)) & (F.length(key) - len(word) < spare))
        return starts & ~F.array_contains(F.col("_taken"), i)

    return test


def map_columns(rows: DataFrame, roles: dict[str, tuple[str, ...]], spare: int | None) -> DataFrame:
    """Adds one column per role: the place of the cell that names it, NULL when none does.

    Exact names go first. With ``spare``, a role still open takes the first free cell
    that starts with one of its names and is fewer than ``spare`` characters longer.
    """
    out = rows.withColumn("_keys", F.transform("cells", header_key))
    places = F.sequence(F.lit(0), F.size("_keys") - 1)

    for role, words in roles.items():
        out = out.withColumn(role, F.array_min(F.filter(places, _named_exactly(words))))
    if spare is not None:
        out = out.withColumn("_taken", F.array_compact(F.array(*[F.col(r) for r in roles])))
        for role, words in roles.items():
            free = F.array_min(F.filter(places, _free_and_starting(words, spare)))
            out = out.withColumn(role, F.coalesce(F.col(role), free))
            out = out.withColumn("_taken", F.array_union("_taken", F.array_compact(F.array(F.col(role)))))
        out = out.drop("_taken")
    return out.drop("_keys")


def cell(role: str) -> Column:
    """The trimmed cell of a role, blank when the row or the role is not there."""
    at = F.col(f"head.{role}")
    return F.trim(F.coalesce(F.when(at < F.size("cells"), F.try_element_at("cells", at + 1)), F.lit("")))


def best_header(rows: DataFrame, roles: dict, score: Column, first_lines: int, enough: Column, spare: int | None) -> DataFrame:
    """Per file the line that looks most like the header, as (file, header_line, head)."""
    mapped = map_columns(rows.filter(F.col("line") <= first_lines), roles, spare)
    named = F.struct(*roles)
    scored = mapped.withColumn("_score", score).withColumn("_enough", enough)
    best = scored.groupBy("file").agg(
        F.max_by(
            F.struct("line", named.alias("head"), "_enough"), F.struct(F.col("_score"), -F.col("line"))
        ).alias("b")
    )
    return best.select("file", F.col("b.line").alias("header_line"), F.col("b.head").alias("head"), F.col("b._enough").alias("readable"))


def named_roles(roles: dict) -> Column:
    """How many roles a line names."""
    total = F.lit(0)
    for role in roles:
        total = total + F.col(role).isNotNull().cast("int")
    return total
