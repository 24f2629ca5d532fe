"""Queries of folds over words, weighted automata, grammars as text and the objective, over the corpus's own counts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonority.functions import automata, vectors
from sonority.functions import segments as S
from sonority.functions.classes import Settings, class_frame, candidates, membership
from sonority.functions.features import LATIN
from sonority.functions.globs import parse_glob
from sonority.functions.grammar import Grammar, directional, objective, sampled_frame, unit_floats, unknown_frame
from sonority.functions.violations import of_globs
from sonority.jobs.corpus import _BIGRAM_COUNTS, _LEN, _SEGMENTS, CLASSES, ENC, SEGS, WORDS, _lines, docs, ends_sql, words
from sonority.jobs.grammars import _BASE, _COUNTED, _NASALS, _RULES, _VOWELS, _counted_classes, _rules, _seen, vowel_of

# Weights and a direction for consonant pairs and vowel pairs.
_PAIR_WEIGHTS, _DIRECTION = (0.5, 0.25), (1.0, -2.0)
# Factors of vowels and of consonants in the fold of words.
_FACTORS = (0.9, 0.8)


def _vowel(seg):
    return F.getbit(F.lit(_VOWELS).cast("long"), (seg - 1).cast("int")) == 1


def _vowel_sql(seg: str) -> str:
    return f"(({_VOWELS}::bigint >> ({seg} - 1)) & 1 = 1)"


def _q_strict(spark, d):
    found = S.word_list(_lines(spark, d), SEGS, strict=True)
    return found.groupBy(F.array_join("segs", " ").alias("segs"), "freq").agg(F.count("*").alias("n"))


_STRICT = f"""with lines as (select doc_id, unnest(string_split(lower(coalesce(text, '')), chr(10))) as line from documents),
v as (select string_split(concat_ws(chr(9), line, case doc_id % 5 when 0 then '3' when 1 then 'x' when 2 then '4 5' when 3 then '-2' end), chr(9)) as fields from lines),
f as (select fields[1] as token, list_filter(regexp_split_to_array(array_to_string(fields[2:], ' '), '[ \\t\\n\\x0B\\f\\r\\p{{Zs}}]+'), lambda x: x <> '') as rest from v),
s as (select {_SEGMENTS} as segs, rest, case when len(rest) = 1 and regexp_full_match(rest[1], '-?[0-9]+') then try_cast(rest[1] as int) end as freq from f)
select array_to_string(segs, ' ') as segs, coalesce(freq, 1)::int as freq, count(*) as n from s where len(segs) > 0 and (freq is not null or len(rest) = 0) group by all"""


def _q_skeletons(spark, d):
    """Each word's vowels and consonants, joined in order."""
    shape = automata.transduced(F.col("word"), F.lit(""), lambda s: F.when(_vowel(s), "V").otherwise("C"), lambda a, b: F.concat(a, b))
    return words(spark, d).groupBy(shape.alias("skeleton")).agg(F.sum("freq").alias("n"))


_SKELETONS = f"with {WORDS} select array_to_string(list_transform(word, lambda s: case when {_vowel_sql('s')} then 'V' else 'C' end), '') as skeleton, sum(freq)::bigint as n from lex group by all"


def _q_word_expectations(spark, d):
    """Each word in the semiring of expectations: the product of its segments' factors, and that times its vowels."""

    def weight(s):
        p = F.when(_vowel(s), F.lit(_FACTORS[0])).otherwise(F.lit(_FACTORS[1]))
        return vectors.expectation(p, F.array(F.when(_vowel(s), p).otherwise(F.lit(0.0))))

    one = vectors.expectation(F.lit(1.0), F.array(F.lit(0.0)))
    told = automata.transduced(F.col("word"), one, weight, vectors.times)
    return words(spark, d).select(F.array_join("word", " ").alias("ids"), told.alias("x")).select("ids", F.round("x.p", 9).alias("p"), F.round(F.col("x.v")[0], 9).alias("v"))


_WORD_EXPECTATIONS = f"""with {WORDS}, k as (select array_to_string(word, ' ') as ids, len(word) as n, len(list_filter(word, lambda s: {_vowel_sql('s')})) as a from lex)
select ids, round(pow({_FACTORS[0]}::double, a) * pow({_FACTORS[1]}::double, n - a), 9) as p, round(a * pow({_FACTORS[0]}::double, a) * pow({_FACTORS[1]}::double, n - a), 9) as v from k"""


def _q_class_products(spark, d):
    """For each class, the chance that a segment of the corpus is none of its segments, each drawn by itself: a product."""
    seen = _seen(spark, d).select("seg_id", "n")
    total = seen.agg(F.sum("n").alias("total"))
    member = membership(class_frame(spark, LATIN), len(SEGS))
    shares = seen.crossJoin(F.broadcast(total)).select("seg_id", (1 - F.col("n") / F.col("total")).alias("p"))
    return member.join(F.broadcast(shares), "seg_id").groupBy("class_id").agg(F.round(F.product("p"), 9).alias("p"))


_CLASS_PRODUCTS = f"{_BASE}, {CLASSES} select class_id, round(product(1 - n / (select sum(n) from seen)), 9) as p from member join seen using (seg_id) group by class_id"


def _q_weighted_edges(spark, d):
    """Edges of the automaton of vowels with the counts of consonant pairs and vowel pairs, weighted."""
    pairs = S.ngrams(words(spark, d), 2)
    edges = pairs.groupBy(vowel_of("s1").alias("q"), F.col("s2").alias("seg_id"), vowel_of("s2").alias("q2")).agg(F.sum("n").alias("n"))
    counted = edges.withColumn("c", F.array(((F.col("q") == 0) & (F.col("q2") == 0)).cast("int"), ((F.col("q") == 1) & (F.col("q2") == 1)).cast("int")))
    return automata.weighted(counted, _PAIR_WEIGHTS, _DIRECTION).select("q", "seg_id", "q2", "n", F.round("p", 9).alias("p"), F.round("v", 9).alias("v"))


_STATES = f"st as (select ({_VOWELS}::bigint >> (s1 - 1)) & 1 as q, s2 as seg_id, ({_VOWELS}::bigint >> (s2 - 1)) & 1 as q2, sum(n)::bigint as n from bg group by all)"
_WEIGHTED_EDGES = f"""{_BASE}, {_BIGRAM_COUNTS}, {_STATES}, c as (select *, case when q + q2 = 0 then {_PAIR_WEIGHTS[0]} when q + q2 = 2 then {_PAIR_WEIGHTS[1]} else 0 end as w, case when q + q2 = 0 then {_DIRECTION[0]} when q + q2 = 2 then {_DIRECTION[1]} else 0 end as u from st)
select q::int as q, seg_id, q2::int as q2, n, round(exp(-w::double), 9) as p, round(exp(-w::double) * u, 9) as v from c"""


def _q_joined_automata(spark, d):
    """The automaton that meets vowel pairs beside the one that meets nasal pairs, joined by and, and by or."""
    pairs = S.ngrams(words(spark, d), 2)

    def table(mask):
        def bit(name):
            return F.getbit(F.lit(mask).cast("long"), (F.col(name) - 1).cast("int")) == 1

        return pairs.select(bit("s1").cast("int").alias("q"), F.col("s2").alias("seg_id"), bit("s2").cast("int").alias("q2"), (bit("s1") & bit("s2")).alias("w")).distinct()

    both = automata.product_frame(table(_VOWELS), table(_NASALS))
    return both.select("seg_id", "qa", "qb", "qa2", "qb2", (F.col("wa") & F.col("wb")).alias("both"), (F.col("wa") | F.col("wb")).alias("either"))


_JOINED_AUTOMATA = f"""{_BASE}, {_BIGRAM_COUNTS},
a as (select distinct (({_VOWELS}::bigint >> (s1 - 1)) & 1)::int as q, s2 as seg_id, (({_VOWELS}::bigint >> (s2 - 1)) & 1)::int as q2 from bg),
b as (select distinct (({_NASALS}::bigint >> (s1 - 1)) & 1)::int as q, s2 as seg_id, (({_NASALS}::bigint >> (s2 - 1)) & 1)::int as q2 from bg)
select seg_id, a.q as qa, b.q as qb, a.q2 as qa2, b.q2 as qb2, (a.q * a.q2 = 1 and b.q * b.q2 = 1) as both, (a.q * a.q2 = 1 or b.q * b.q2 = 1) as either from a join b using (seg_id)"""


def _q_distinct_segments(spark, d):
    """Words by the segments that they have, in the order in which these come first."""
    return words(spark, d).groupBy(F.array_join(F.array_distinct("word"), " ").alias("ids")).agg(F.sum("freq").alias("n"))


_DISTINCT_SEGMENTS = f"with {WORDS} select array_to_string(list_filter(word, lambda s, i: list_position(word, s) = i), ' ') as ids, sum(freq)::bigint as n from lex group by all"


def _q_mirrored(spark, d):
    """Segments of a word beside those of its reverse, place by place."""
    zipped = words(spark, d).select("freq", F.explode(F.arrays_zip(F.col("word").alias("a"), F.reverse("word").alias("b"))).alias("z"))
    return zipped.groupBy(F.col("z.a").alias("s"), F.col("z.b").alias("t")).agg(F.sum("freq").alias("n"))


_MIRRORED = f"with {WORDS} select word[i] as s, word[len(word) + 1 - i] as t, sum(freq)::bigint as n from lex, unnest(range(1, len(word) + 1)) r(i) group by all"


def _q_unit_draws(spark, d):
    """A number in [0, 1) for each document, by its id and the seed."""

    @F.pandas_udf("double")
    def draw(ids):
        import pandas as pd

        return pd.Series(unit_floats(1, ids.to_numpy(), 2))

    return docs(spark, d).where("doc_id is not null").select("doc_id", F.round(draw("doc_id"), 12).alias("u"))


def _mixed(x: str, by: int) -> str:
    return f"(({x})::uhugeint * {by}::uhugeint % 18446744073709551616::uhugeint)::ubigint"


_UNIT_DRAWS = f"""with a as (select doc_id, ((({_mixed('doc_id', 0x9E3779B97F4A7C15)})::uhugeint + {3 * 0xBF58476D1CE4E5B9 % 2**64}::uhugeint + {0x94D049BB133111EB}::uhugeint) % 18446744073709551616::uhugeint)::ubigint as h from documents where doc_id is not null),
b as (select doc_id, {_mixed('xor(h, h >> 30)', 0xBF58476D1CE4E5B9)} as h from a), c as (select doc_id, {_mixed('xor(h, h >> 27)', 0x94D049BB133111EB)} as h from b)
select doc_id, round(xor(h, h >> 31)::double / 18446744073709551616.0::double, 12) as u from c"""


def _corpus_grammar(spark, d) -> Grammar:
    rules = _rules(spark, d).orderBy("name").collect()
    lengths = {r["len"]: r["n"] for r in S.length_frequencies(words(spark, d)).where("len > 0").collect()}
    return Grammar(lengths, [parse_glob(_RULES[r["name"]]) for r in rules], [r["weight"] for r in rules])


def _q_sampled_lengths(spark, d):
    """How many of the sampled words have each length: as many words as there are documents."""
    sampled = sampled_frame(spark, _corpus_grammar(spark, d), LATIN, docs(spark, d).count())
    return sampled.groupBy(F.size("word").alias("len")).agg(F.count("*").alias("n"))


_SAMPLED_LENGTHS = f"""{_LEN}, k as (select count(*) as k from documents), s as (select len, (lead(round_even(k * lo, 0), 1, k::double) over (order by lo) - round_even(k * lo, 0))::bigint as n from cdf, k where len > 0)
select len, n from s where n > 0"""


def _q_grammar_text(spark, d):
    """The corpus's grammar, written as text and read again: its lengths, and its rules with the newest first."""
    read = Grammar.parse(_corpus_grammar(spark, d).text())
    lengths = spark.createDataFrame([("length", k, float(n), "") for k, n in read.lengths.items()], "kind string, at int, value double, glob string")
    rules = read.frame(spark).orderBy(F.desc("ordinal"))
    newest = rules.select(F.lit("rule").alias("kind"), (F.lit(len(read.rules) - 1) - F.col("ordinal")).alias("at"), F.col("weight").alias("value"), "glob")
    return lengths.union(newest)


def _grammar_text_sql() -> str:
    each = ", ".join(ends_sql(k, g) for k, g in _RULES.items())
    names = sorted(_RULES)
    sums = " union all ".join(f"""select {len(names) - 1 - names.index(k)} as "at", '{parse_glob(g)}' as "glob", sum(freq * {k}) as violations from v""" for k, g in _RULES.items())
    return f"""{_LEN}, {ENC}, v as (select freq, {each} from enc), s as ({sums})
select 'length' as kind, len as "at", n::double as value, '' as "glob" from lengths where len > 0
union all select 'rule', "at"::int, printf('%.3f', round(ln((select sum(freq * len(word)) from lex) / (violations + 1)), 6))::double, "glob" from s"""


#: Rules of which some name features that the table lacks.
_NAMED = {"r1": "[+liquid][+nasal]", "r2": "[+nasal −tense −atr]C", "r3": "CC", "r4": "[¬ +liquid]V#"}


def _q_unknown_features(spark, d):
    """Rules that name features which the table lacks, and their violations without those."""
    rules = {k: parse_glob(g) for k, g in _NAMED.items()}
    lacking = unknown_frame(spark, rules, LATIN.frame(spark).select("feat").distinct())
    return of_globs(words(spark, d), rules, LATIN).join(F.broadcast(lacking), "name").select("name", "unknown", "violations")


_UNKNOWN = f"""with {WORDS}, {ENC}, v as (select freq, {', '.join(ends_sql(k, g) for k, g in _NAMED.items())} from enc)
select 'r1' as name, 'liquid' as unknown, coalesce(sum(freq * r1), 0)::bigint as violations from v union all select 'r2', 'atr tense', coalesce(sum(freq * r2), 0)::bigint from v union all select 'r4', 'liquid', coalesce(sum(freq * r4), 0)::bigint from v"""


def _q_objective(spark, d):
    """The objective of consonant pairs and vowel pairs over the corpus, its gradient, and its slope in a direction."""
    held = words(spark, d)
    rows = S.length_frequencies(held).collect()
    if len(rows) < 2:
        return spark.createDataFrame([], "name string, value double")
    lengths = np.zeros(len(rows))
    for r in rows:
        lengths[r["len"]] = r["n"]
    globs = {"cc": parse_glob("CC"), "vv": parse_glob("VV")}
    counts = {r["name"]: r["violations"] for r in of_globs(held, globs, LATIN).collect()}
    m, observed, w, u = Grammar({}, list(globs.values())).automaton(LATIN), np.array([counts[k] for k in globs], float), np.array(_PAIR_WEIGHTS), np.array(_DIRECTION)
    value, slope = objective(m, lengths, observed)(w)
    told = [("value", value), ("cc", float(slope[0])), ("vv", float(slope[1])), ("along", directional(m, lengths, observed, w, u))]
    return spark.createDataFrame(told, "name string, value double").withColumn("value", F.round("value", 2))


_A, _B = _PAIR_WEIGHTS
_NV = _VOWELS.bit_count()
_NC = len(SEGS) - _NV
_OBJECTIVE = f"""{_LEN.replace("with ", "with recursive ", 1)}, {_BIGRAM_COUNTS}, {_STATES},
ob as materialized (select coalesce(sum(n) filter (q + q2 = 0), 0)::double as cc, coalesce(sum(n) filter (q + q2 = 2), 0)::double as vv from st),
walk(len, c, v, cc, cv, vc, vv) as (select 1, {_NC}::double, {_NV}::double, 0::double, 0::double, 0::double, 0::double
  union all select len + 1, c * {_NC} * exp(-{_A}::double) + v * {_NC}, c * {_NV} + v * {_NV} * exp(-{_B}::double),
    (cc + c) * {_NC} * exp(-{_A}::double) + cv * {_NC}, cc * {_NV} + cv * {_NV} * exp(-{_B}::double),
    vc * {_NC} * exp(-{_A}::double) + vv * {_NC}, vc * {_NV} + (vv + v) * {_NV} * exp(-{_B}::double) from walk where len < (select max(len) from lengths)),
t as materialized (select sum(n * ln(c + v)) as z, sum(n * (cc + cv) / (c + v)) as ecc, sum(n * (vc + vv) / (c + v)) as evv from walk join lengths using (len) where n > 0)
select 'value' as name, round(cc * {_A} + vv * {_B} + z + {_A + _B}, 2) as value from ob, t union all select 'cc', round(cc - ecc + 1, 2) from ob, t union all select 'vv', round(vv - evv + 1, 2) from ob, t
union all select 'along', round({_DIRECTION[0]} * (cc - ecc) + {_DIRECTION[1]} * (vv - evv) + {sum(_DIRECTION)}, 2) from ob, t"""


def _q_all_candidates(spark, d):
    """All families over the corpus's classes: how many candidates each has, and where they stand in the order of trying."""
    held = _counted_classes(spark, d).drop("tokens")
    found = candidates(spark, LATIN, Settings(edges=True, trigrams=("syllabic",), broken=("syllabic",)), held)
    return found.groupBy("family").agg(F.count("*").alias("n"), F.min("ordinal").alias("first"), F.max("ordinal").alias("last"))


_ALL_CANDIDATES = f"""{_COUNTED}, k as (select *, label in ('[]', '[+syllabic]', '[−syllabic]') as core, inverted::int as i from counted),
f as (select 0 as rank, 'single' as family, count(*) as n from k where not inverted union all select 1, 'edge', 2 * count(*) from k where not inverted
  union all select 2, 'bigram', count(*) from k a join k b on a.i + b.i <= 1 union all select 3, 'edge_bigram', 2 * count(*) from k a join k b on a.i + b.i <= 1
  union all select 4, 'trigram', count(*) from k a join k b on a.i + b.i <= 1 join k c on a.i + b.i + c.i <= 1 and (a.core or b.core or c.core)
  union all select 5, 'long_distance', 3 * count(*) from k a, k b)
select family, n, (sum(n) over (order by rank) - n + 1)::int as first, (sum(n) over (order by rank))::int as last from f"""


QUERIES = {
    "word_list_strict": _q_strict,
    "word_skeletons": _q_skeletons,
    "word_expectations": _q_word_expectations,
    "class_products": _q_class_products,
    "weighted_edges": _q_weighted_edges,
    "automata_and_or": _q_joined_automata,
    "distinct_segments": _q_distinct_segments,
    "mirrored_pairs": _q_mirrored,
    "unit_draws": _q_unit_draws,
    "sampled_lengths": _q_sampled_lengths,
    "grammar_text": _q_grammar_text,
    "unknown_features": _q_unknown_features,
    "objective_slopes": _q_objective,
    "candidates_all": _q_all_candidates,
}

SQL = {
    "word_list_strict": _STRICT,
    "word_skeletons": _SKELETONS,
    "word_expectations": _WORD_EXPECTATIONS,
    "class_products": _CLASS_PRODUCTS,
    "weighted_edges": _WEIGHTED_EDGES,
    "automata_and_or": _JOINED_AUTOMATA,
    "distinct_segments": _DISTINCT_SEGMENTS,
    "mirrored_pairs": _MIRRORED,
    "unit_draws": _UNIT_DRAWS,
    "sampled_lengths": _SAMPLED_LENGTHS,
    "grammar_text": _grammar_text_sql(),
    "unknown_features": _UNKNOWN,
    "objective_slopes": _OBJECTIVE,
    "candidates_all": _ALL_CANDIDATES,
}
