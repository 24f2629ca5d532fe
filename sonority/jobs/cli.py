"""Command line: ``learn`` a grammar from a lexicon, or ``gibber`` words from a grammar."""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sonority.functions.classes import Settings
from sonority.functions.features import LATIN
from sonority.functions.grammar import sampled_frame
from sonority.functions.segments import named, serialised
from sonority.jobs.learner import SAMPLES, THRESHOLDS, check_thresholds, learn, salad_lexicon
from sonority.sources import files


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="sonority")
    out.add_argument("-f", "--features", help="feature table as CSV; the Latin table if absent")
    out.add_argument("-n", "--samples", type=int, default=SAMPLES)
    out.add_argument("-o", "--output", help="file to write; standard output is always written")
    kinds = out.add_subparsers(dest="command", required=True)
    l = kinds.add_parser("learn")
    l.add_argument("lexicon")
    l.add_argument("-c", "--collate", action="store_true", help="the lexicon is running text")
    l.add_argument("--thresholds", type=float, nargs="+", default=list(THRESHOLDS))
    l.add_argument("-e", "--edges", action="store_true")
    l.add_argument("-3", "--trigrams", nargs="*", metavar="FEATURE")
    l.add_argument("-l", "--long", nargs="*", metavar="FEATURE", dest="broken")
    l.add_argument("--rules", type=int, help="stop after so many rules")
    g = kinds.add_parser("gibber")
    g.add_argument("grammar")
    g.add_argument("--spaced", action="store_true")
    g.add_argument("-s", "--shuffle", action="store_true", help="words as drawn, not as a lexicon")
    return out


def run(spark: SparkSession, argv: list[str]) -> str:
    args = parser().parse_args(argv)
    table = files.read_feature_table(spark, args.features) if args.features else LATIN
    if args.command == "learn":
        check_thresholds(args.thresholds)
        read = files.read_text if args.collate else files.read_word_list
        words = read(spark, args.lexicon, table)
        kinds = Settings(args.edges, tuple(args.trigrams) if args.trigrams is not None else None, tuple(args.broken) if args.broken is not None else None)
        text = learn(words, table, kinds, args.thresholds, args.samples, args.rules).text()
    else:
        drawn = sampled_frame(spark, files.read_grammar(spark, args.grammar), table, args.samples)
        rows = drawn.withColumn("freq", F.lit(1)).orderBy(F.xxhash64("row_id")) if args.shuffle else salad_lexicon(drawn).orderBy("word")
        lines = serialised(rows.select(named(F.col("word"), table.segments).alias("segs"), "freq"), table.segments, args.spaced)
        text = "".join(r["value"] + "\n" for r in lines.collect())
    if args.output:
        Path(args.output).write_text(text, encoding="utf-8")
    return text


def main() -> None:
    import sys

    spark = SparkSession.builder.appName("sonority").getOrCreate()
    print(run(spark, sys.argv[1:]), end="")


if __name__ == "__main__":
    main()
