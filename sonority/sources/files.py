"""Readers and writers of the text formats: word lists, running text, feature tables and grammars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonority.functions.features import FeatureTable
from sonority.functions.grammar import Grammar
from sonority.functions.segments import lexicon, references, serialised, word_list


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``value``; only line feeds end a line, and bytes that are no UTF-8 become replacement characters."""
    raw = spark.read.text(path, lineSep="\n")
    return raw.select(F.make_valid_utf8("value").alias("value"))


def read_word_list(spark: SparkSession, path: str, table: FeatureTable, strict: bool = False) -> DataFrame:
    """The lexicon ``word, freq`` of a word list; rows of the same word are summed."""
    rows = word_list(read_lines(spark, path), table.segments, strict)
    return rows.groupBy(references(F.col("segs"), table.segments).alias("word")).agg(F.sum("freq").alias("freq"))


def read_text(spark: SparkSession, path: str, table: FeatureTable) -> DataFrame:
    """The lexicon ``word, freq`` of running text; what looks like a frequency is a word like any other."""
    return lexicon(read_lines(spark, path).withColumnRenamed("value", "text"), table.segments)


def write_word_list(rows: DataFrame, path: str, table: FeatureTable, spaced: bool = False) -> None:
    """``segs, freq`` as lines of text."""
    serialised(rows, table.segments, spaced).write.text(path)


def read_feature_table(spark: SparkSession, path: str) -> FeatureTable:
    """A feature table is small: one row of text on the driver."""
    return FeatureTable.parse(spark.read.text(path, wholetext=True).first()[0])


def read_grammar(spark: SparkSession, path: str) -> Grammar:
    return Grammar.parse(spark.read.text(path, wholetext=True).first()[0])


def write_rules(grammar: Grammar, spark: SparkSession, path: str) -> None:
    """The rules with full weights as Parquet, for the text form rounds them."""
    grammar.frame(spark).coalesce(1).write.parquet(path)
