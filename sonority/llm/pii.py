"""Personal data: base patterns, and identifiers discovered by bootstrapped contextual extraction.

The base kinds are found by their patterns and checks. Every base span is also a seed of a bootstrap: base spans and tokens
that look like identifiers are the instances, the words around them are the lexical patterns, and both are scored over their graph in
rounds until nothing changes. A pattern is as sure as the share of its instances' scores, an instance as sure as its patterns
together; seeds stay at one. What sure patterns hold beyond the seeds is added with kind ``id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonority.llm.common import forget, met, table, text_or_empty, written
from sonority.llm.spans import let, matches

#: Fixed values of the base kinds, in the order that breaks ties. Loops over groups are possessive; the first two start
#: where a run of their characters does or where the last match ended, which is where the leftmost match starts.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Tokens that may be identifiers: of any length, with a digit or a sign that joins handles. The long ones, of eight or
#: more characters with four digits, name one thing wherever they stand; the others only in a sure context.
CANDIDATE = r"(?<!\S)(?=[^\s0-9@_]*+[0-9@_])\S++"
LONG = r"^(?=.{8})(?:[^0-9]*+[0-9]){4}"
#: A pattern needs so many different seeds, and both patterns and instances so high a score; scores are settled when none
#: moves by more than this. They only rise from round to round, and are at most one.
LEAST_SEEDS, LEAST_SCORE, SETTLED = 5, 0.8, 1e-3


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """Every second digit from the right counts twice, digit by digit, and the sum ends in zero."""
    turned = F.reverse(_digits(value))
    each = F.transform(F.sequence(F.lit(1), F.length(turned)), lambda i: F.substring(turned, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    return F.aggregate(F.transform(each, lambda d: F.when(d > 9, d - 9).otherwise(d)), F.lit(0), lambda a, d: a + d) % 10 == 0


def _passes(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(F.regexp_replace(p, "^0+(?=.)", "").try_cast("int"), F.lit(999)) <= 255))
    if kind == "card":
        return _luhn(value)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _named(rank: int, kind: str) -> Column:
    """The matches of a kind that pass its check, as spans."""
    passing = F.filter(F.col(f"_{kind}"), lambda m: _passes(kind, m["value"]))
    return F.transform(passing, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind"), m["value"].alias("value"), m["first"].alias("first"), m["last"].alias("last")))


def _count(kind: str) -> Column:
    return F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def _may_have(kind: str, text: Column) -> Column:
    return F.contains(text, F.lit("@")) if kind == "email" else F.contains(text, F.lit("+")) if kind == "phone" else text.rlike("[0-9]")


def base_spans(docs: DataFrame) -> DataFrame:
    """Rows ``doc_id, _key, _text, _base``: all base spans by start, then kind. ``_key`` names the text."""
    out = docs.select("doc_id", text_or_empty().alias("_text"))
    none = F.from_json(F.lit("[]"), "array<struct<start:int,end:int,value:string,first:int,last:int>>")
    for k in KINDS:
        out = out.withColumn(f"_{k}", F.when(_may_have(k, F.col("_text")), matches(F.col("_text"), PATTERNS[k], words=True)).otherwise(none))
    named = [_named(i, k) for i, k in enumerate(KINDS)]
    return out.select("doc_id", F.xxhash64("_text").alias("_key"), "_text", F.array_sort(F.concat(*named)).alias("_base"))


def _word(tokens: Column, at: Column) -> Column:
    """A word of a context without what is no letter or digit at its ends; a sign alone is a word too."""
    raw = F.when(at >= 0, F.coalesce(F.get(tokens, at), F.lit(""))).otherwise(F.lit(""))
    return let(raw, lambda r: F.lower(F.coalesce(F.nullif(F.regexp_replace(r, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""), F.lit("")), r)))


def _apart(found: Column, base: Column) -> Column:
    """Candidate tokens in which no base span lies, told by sorting both by the number of their token."""
    taken = F.array_distinct(F.flatten(F.transform(base, lambda b: F.sequence(b["first"], b["last"]))))
    none, text = F.lit(None).cast("int"), F.lit(None).cast("string")

    def entry(word: Column, kind: int, start: Column, value: Column) -> Column:
        return F.struct(word.alias("word"), F.lit(kind).alias("kind"), start.alias("start"), value.alias("value"))

    both = F.array_sort(F.concat(F.transform(taken, lambda w: entry(w, 0, none, text)), F.transform(found, lambda m: entry(m["first"], 1, m["start"], m["value"]))))
    beside = let(both, lambda x: F.zip_with(x, F.concat(F.array(F.lit(-1)), F.transform(x, lambda e: e["word"])), lambda e, w: F.struct(e.alias("e"), w.alias("w"))))
    return F.transform(F.filter(beside, lambda x: (x["e"]["kind"] == 1) & (x["e"]["word"] != x["w"])), lambda x: x["e"])


def instances(found: DataFrame) -> DataFrame:
    """Base spans, which are the seeds, and identifier-like tokens: ``doc_id, _key, start, end, value, seed, by``.

    ``by`` has an instance's patterns: the two words before it, and the word on each side. Words are found by their number in
    the text, so a text costs about its length and its number of instances.
    """
    text = F.col("_text")

    def instance(tokens: Column, start: Column, value: Column, first: Column, last: Column, seed: bool) -> Column:
        words = [_word(tokens, first - 2).alias("l2"), _word(tokens, first - 1).alias("l1"), _word(tokens, last + 1).alias("r1")]
        return F.struct(start.alias("start"), value.alias("value"), F.lit(seed).alias("seed"), *words)

    def every(tokens: Column, base: Column, others: Column) -> Column:
        return F.concat(
            F.transform(base, lambda b: instance(tokens, b["start"], b["value"], b["first"], b["last"], True)),
            F.transform(others, lambda m: instance(tokens, m["start"], m["value"], m["word"], m["word"], False)),
        )

    spans = let(F.col("_base"), lambda base: let(F.split(text, r"\s+"), lambda tokens: every(tokens, base, _apart(matches(text, CANDIDATE, words=True), base))))
    held = found.where(text.rlike("[0-9@_]")).select("doc_id", "_key", F.explode(spans).alias("m")).select("doc_id", "_key", "m.*")
    # the span of a token is the token without what is not a letter or digit at its ends; a base span stays whole
    head = F.when(F.col("seed"), 0).otherwise(F.length(F.regexp_extract("value", r"^[^\p{L}\p{N}]*", 0)))
    core = F.when(F.col("seed"), F.col("value")).otherwise(F.regexp_replace("value", r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    by = F.array(F.concat_ws("\t", F.lit("LL"), "l2", "l1"), F.concat_ws("\t", F.lit("LR"), "l1", "r1"))
    return held.select("doc_id", "_key", (F.col("start") + head).alias("start"), (F.col("start") + head + F.length(core)).alias("end"), core.alias("value"), "seed", by.alias("by")).where("value <> ''")


def _together(trust: str = "trust") -> Column:
    """Patterns together: one less the product of their doubts."""
    return 1 - F.exp(F.sum(F.log(1 - F.least(trust, F.lit(0.999)))))


def scored(tokens: DataFrame, least_seeds: int = LEAST_SEEDS, least_score: float = LEAST_SCORE) -> tuple[DataFrame, DataFrame]:
    """Instances ``value, score, seed`` and sure patterns ``pattern, trust`` when the scores have settled; seeds stay at one.

    The graph joins patterns to distinct values, so repeated documents don't add to a pattern's certainty. A pattern of very
    many values, or a value in very many patterns, is joined where its edges lie.
    """
    graph = written(
        tokens.select("value", "seed", F.explode("by").alias("pattern")).groupBy("pattern", "value").agg(F.max("seed").alias("seed")), "pii-graph"
    )
    # a pattern without enough seeds never counts
    able = graph.groupBy("pattern").agg(F.count_if("seed").alias("seeds"), F.count("*").alias("of")).where(F.col("seeds") >= least_seeds)
    edges = written(met(graph, able.select("pattern", "of"), "pattern", "of", graph.count()).select("pattern", "value", "seed"), "pii-edges")
    n = edges.count()
    values = written(edges.groupBy("value").agg(F.max("seed").alias("seed"), F.count("*").alias("of")), "pii-values", n)
    score, sure = values.withColumn("score", F.col("seed").cast("double")), None
    while True:
        by_value = met(edges.select("pattern", "value"), score.select("value", "score", "of"), "value", "of", n)
        trust = by_value.groupBy("pattern").agg((F.sum("score") / (F.count("*") + 1)).alias("trust"), F.count("*").alias("of"))
        old_sure, sure = sure, written(trust.where(F.col("trust") >= least_score / 2), "pii-sure", n)
        part = met(edges.select("pattern", "value"), sure, "pattern", "of", n).groupBy("value").agg(_together().alias("any"))
        # a value without a sure pattern stays, so that a seed counts in each round
        new = score.select("value", "seed", "of", F.col("score").alias("old")).join(part, "value", "left")
        new = written(new.select("value", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("any", F.lit(0.0))).alias("score"), "seed", "of", "old"), "pii-scores", n)
        moved = new.agg(F.max(F.abs(F.col("score") - F.col("old")))).first()[0] or 0.0
        if old_sure is not None:
            forget(old_sure)
            forget(score)
        score = new
        if moved <= SETTLED:
            return score, sure


def discovered(tokens: DataFrame, least_seeds: int = LEAST_SEEDS, least_score: float = LEAST_SCORE) -> DataFrame:
    """Values that sure patterns hold: ``value, score``."""
    score, _ = scored(tokens, least_seeds, least_score)
    return score.where(~F.col("seed") & (F.col("score") >= least_score)).select("value", "score")


def added(tokens: DataFrame) -> DataFrame:
    """Places of discovered identifiers: ``doc_id, _key, start, end``."""
    score, sure = scored(tokens)
    place = ["doc_id", "_key", "start", "end"]
    others = tokens.where("not seed").withColumn("long", F.col("value").rlike(LONG))
    total = tokens.count()
    seen = others.where("long").groupBy("value").agg(F.count("*").alias("of"))
    sure_values = score.where(~F.col("seed") & (F.col("score") >= LEAST_SCORE)).select("value").join(seen, "value")
    known = met(others.where("long"), sure_values, "value", "of", total).select(*place)
    # a null id is its own group; copies of a row share their places
    here = others.where("not long").select(*place, F.explode("by").alias("pattern")).distinct()
    often = sure.select("pattern", "trust").join(here.groupBy("pattern").agg(F.count("*").alias("of")), "pattern")
    here = met(here, often, "pattern", "of", 2 * total)
    return known.union(here.groupBy(*place).agg(_together().alias("score")).where(F.col("score") >= LEAST_SCORE).select(*place)).distinct()


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """Find personal data in every whole text.

    :param docs: ``doc_id, text`` and any other columns, which are ignored. Null text counts as empty and has no spans.
        Repeated rows and rows with a null ``doc_id`` are all returned. An empty table gives no rows.
    :return: ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans``.
    """
    found = base_spans(docs)
    tokens = written(instances(found), "pii-tokens")
    rank = F.lit(len(KINDS)).alias("rank")
    more = added(tokens).groupBy("doc_id", "_key").agg(F.collect_list(F.struct("start", rank, "end", F.lit("id").alias("kind"))).alias("_more"))
    slim = found.select("doc_id", "_key", F.transform("_base", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))).alias("_base"))
    all_of = slim.join(more.withColumnsRenamed({"doc_id": "_id", "_key": "_k"}), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_k")), "left")
    spans = F.array_sort(F.concat("_base", F.coalesce("_more", F.from_json(F.lit("[]"), "array<struct<start:int,rank:int,end:int,kind:string>>"))))
    return all_of.select("doc_id", *map(_count, KINDS), F.sha2(_joined(F.col("_base")).cast("binary"), 256).alias("base_sha256"), _joined(spans).alias("spans"))


def query(spark, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
