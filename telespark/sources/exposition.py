"""Metric samples in text exposition format: reading and writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_FIELDS = r"^\s*([^\s{]+)\s*(\{(?:[^\"{}]|\"(?:[^\"\\]|\\.)*\")*\})?\s+(\S+)"
_LABEL = r'([A-Za-z_][A-Za-z0-9_]*)\s*=\s*"((?:[^"\\]|\\.)*)"'


def unescaped(c: Column) -> Column:
    """A label value as it was before its backslashes, quotes and line ends were escaped; other escapes stay."""
    signs = F.regexp_extract_all(c, F.lit(r"(?s)\\.|[^\\]|\\$"), F.lit(0))
    told = F.transform(signs, lambda x: F.when(x == "\\\\", "\\").when(x == '\\"', '"').when(x == "\\n", "\n").otherwise(x))
    return F.when(c.contains("\\"), F.array_join(told, "")).otherwise(c)


def _labels(braces: Column) -> Column:
    """Names and values of a line's labels; of a repeated name the last counts."""
    names, values = (F.regexp_extract_all(braces, F.lit(_LABEL), F.lit(k)) for k in (1, 2))
    last = F.filter(F.arrays_zip(names.alias("k"), values.alias("v")), lambda e, i: ~F.array_contains(F.slice(names, i + 2, F.greatest(F.size(names) - i - 1, F.lit(0))), e["k"]))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["k"].alias("key"), unescaped(e["v"]).alias("value"))))


def parse_exposition(lines: DataFrame, column: str = "value") -> DataFrame:
    """metric, labels and value of each line that holds a sample.  Blank lines, comments and lines without a number go."""
    line = F.col(column)
    text = lines.where((F.trim(line) != "") & ~line.startswith("#"))
    labels = _labels(F.regexp_extract(line, _FIELDS, 2))
    number = F.regexp_replace(F.regexp_extract(line, _FIELDS, 3), "^[+]Inf$", "Infinity")
    out = text.select(*(c for c in lines.columns if c != column), F.regexp_extract(line, _FIELDS, 1).alias("metric"), labels.alias("labels"), number.try_cast("double").alias("value"))
    return out.where((F.col("metric") != "") & F.col("value").isNotNull())


def read_exposition(spark: SparkSession, path: str, *, streaming: bool = False) -> DataFrame:
    """The samples of text files, ts being the time of the file."""
    lines = (spark.readStream if streaming else spark.read).format("text").load(path)
    rows = parse_exposition(lines.select("value", F.col("_metadata.file_modification_time").alias("ts")))
    return rows.select("metric", "labels", "ts", "value")


def escaped(c: Column) -> Column:
    """A label value with its backslashes, quotes and line ends escaped."""
    for sign, mark in ((r"\\", r"\\\\"), ('"', r'\\"'), ("\n", r"\\n")):
        c = F.regexp_replace(c, sign, mark)
    return c


def to_exposition(samples: DataFrame) -> DataFrame:
    """One line of text for each sample (metric, labels, value); labels in order of their names, dots in them as _."""
    pairs = F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(F.translate(e["key"], ".", "_"), F.lit('="'), escaped(e["value"]), F.lit('"')))
    body = F.when(F.size("labels") > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise(F.lit(""))
    return samples.select(F.concat("metric", body, F.lit(" "), F.col("value").cast("string")).alias("value"))
