"""Queries over classes, candidates, automata and grammars, each over the corpus's own counts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonority.functions import automata, classes as C, features
from sonority.functions import segments as S
from sonority.functions.features import LATIN, FeatureTable
from sonority.functions.globs import parse_glob
from sonority.functions.grammar import Grammar, sampled_frame
from sonority.functions.violations import of_globs, of_singles, reach_counts
from sonority.jobs.corpus import _BIGRAM_COUNTS, _TOK, CELLS, CLASSES, SEG_TABLE, SEGS, WORDS, docs, words
from sonority.jobs.learner import learn
from sonority.sources.tables import new_path
from sonority.streaming.collate import collate, collated

_N = len(SEGS)
_SEEN = "seen as (select seg, seg_id, n from segtab join (select s1, sum(freq)::bigint as n from (select freq, word[i] as s1 from lex, unnest(range(1, len(word) + 1)) t(i)) group by s1) on s1 = seg_id)"
_BASE = f"with {WORDS}, {SEG_TABLE}, {CELLS}, {_SEEN}"


def _seen(spark, d) -> DataFrame:
    """Segments of the corpus: ``seg, seg_id, n``."""
    return S.ngrams(words(spark, d), 1).join(F.broadcast(LATIN.segment_frame(spark)), F.col("s1") == F.col("seg_id")).select("seg", "seg_id", "n")


def _q_cells(spark, d):
    return LATIN.frame(spark).join(_seen(spark, d).drop("seg"), "seg_id").select("seg_id", "seg", "feat_id", "feat", "state", "n")


def _q_pivot(spark, d):
    """The table over the segments that the corpus has; others are null."""
    seen = _seen(spark, d).select("seg_id", F.lit(True).alias("has"))
    cells = LATIN.frame(spark).join(seen, "seg_id", "left").withColumn("state", F.when(F.col("has"), F.col("state")))
    return features.wide(cells)


_PIVOT = _BASE + " select feat_id, feat, " + ", ".join(f"max(case when seg = '{s}' and seg in (select seg from seen) then state end) as \"{s}\"" for s in SEGS) + " from cells group by feat_id, feat"


def _letters(spark, d) -> DataFrame:
    chars = S.tokens(docs(spark, d)).select(F.explode(F.split("token", "")).alias("seg")).where(F.col("seg").rlike(r"^\p{L}$"))
    return chars.distinct()


def _q_reseg(spark, d):
    return features.resegmented(LATIN.frame(spark), _letters(spark, d))


_RESEG = f"""{_BASE}, letters as (select distinct c as seg from (select unnest(regexp_extract_all(token, '(?s).')) as c from tw) where regexp_matches(c, '^\\p{{L}}$'))
select l.seg, f.feat_id, f.feat, coalesce(c.state, '0') as state from letters l cross join (select distinct feat_id, feat from cells) f left join cells c on c.seg = l.seg and c.feat_id = f.feat_id"""


def _q_membership(spark, d):
    member = C.membership(C.class_frame(spark, LATIN), _N)
    return member.join(F.broadcast(_seen(spark, d)), "seg_id").select("class_id", "seg", "n")


def _counted_classes(spark, d, classes=C.class_frame) -> DataFrame:
    """Classes with the corpus's number of their segments; those that it never shows are left out."""
    held = classes(spark, LATIN)
    counts = of_singles(S.ngrams(words(spark, d), 1), C.membership(held, _N), held.select(F.col("class_id").alias("c1")))
    return held.join(counts.where("violations > 0"), held["class_id"] == F.col("c1")).select(held["*"], F.col("violations").alias("tokens"))


def _q_classes(spark, d):
    return _counted_classes(spark, d, C.by_generality).select("class_id", F.col("size").cast("int").alias("size"), "inverted", "label", "tokens")


_COUNTED = f"{_BASE}, {CLASSES}, counted as (select class_id, mask, size, inverted, label, sum(n)::bigint as tokens from classes join member using (class_id) join seen using (seg_id) group by all)"
_CORE = ["syllabic", "sonorant", "nasal", "high"]


def _core_frame(spark, names) -> DataFrame:
    return spark.createDataFrame([(i, n, m) for i, (n, m) in enumerate(C.core(LATIN, list(names)))], "ord int, label string, mask long").coalesce(1)


def _q_core(spark, d):
    cores = _core_frame(spark, _CORE)
    member = C.membership(cores.select(F.col("ord").alias("class_id"), "mask"), _N)
    sums = member.join(_seen(spark, d), "seg_id").groupBy("class_id").agg(F.sum("n").alias("tokens"))
    return cores.join(sums, F.col("ord") == F.col("class_id"), "left").select("ord", "label", F.coalesce("tokens", F.lit(0)).alias("tokens"))


def _core_sql() -> str:
    full, known = (1 << _N) - 1, LATIN.known()
    rows = [f"(0, '[]', {full}::bigint)"] + [f"({k + 1 + (0 if s == '+' else len(_CORE))}, '[{'+' if s == '+' else '−'}{f}]', (select coalesce(sum(1::bigint << (seg_id - 1)), 0)::bigint from cells where feat_id = {known[f]} and state = '{s}'))" for s in "+-" for k, f in enumerate(_CORE)]
    return f"""{_BASE}, raw(o, label, mask) as (values {', '.join(rows)}),
kept as (select label, mask, row_number() over (order by o) - 1 as ord from (select *, row_number() over (partition by mask order by o) as r from raw where mask <> 0) where r = 1)
select ord::int as ord, label, coalesce((select sum(n) from seen where (mask >> (seg_id - 1)) & 1 = 1), 0)::bigint as tokens from kept"""


def _q_family(build, broken: bool = False):
    """Candidates of a family over the corpus's classes, by weight."""

    def run(spark, d):
        held = _counted_classes(spark, d).drop("tokens")
        found = build(held, _core_frame(spark, ["syllabic"])) if broken else build(held)
        keys = ["weight", "final"] if "final" in found.columns else ["weight"]
        return found.groupBy(*[F.col(k).cast("int").alias(k) if k == "weight" else F.col(k) for k in keys]).agg(F.count("*").alias("n_candidates"))

    return run


_FAMILIES = {
    "single": "select -size as weight, count(*) as n_candidates from counted where not inverted group by 1",
    "edge": "select -size as weight, final, count(*) as n_candidates from counted, (values (true), (false)) e(final) where not inverted group by 1, 2",
    "bigram": "select -a.size - b.size as weight, count(*) as n_candidates from counted a join counted b on not (a.inverted and b.inverted) group by 1",
    "edge_bigram": "select -a.size - b.size as weight, final, count(*) as n_candidates from counted a join counted b on not (a.inverted and b.inverted), (values (true), (false)) e(final) group by 1, 2",
    "trigram": """, k as (select *, label in ('[]', '[+syllabic]', '[−syllabic]') as core, inverted::int as i from counted)
select case when a.core then -b.size - c.size when b.core then -a.size - c.size else -a.size - b.size end as weight, count(*) as n_candidates
from k a join k b on a.i + b.i <= 1 join k c on a.i + b.i + c.i <= 1 and (a.core or b.core or c.core) group by 1""",
    "longdistance": "select -a.size - b.size as weight, 3 * count(*) as n_candidates from counted a, counted b group by 1",
}


def _q_candidate_rows(spark, d):
    """Candidates over the corpus's classes with both edges, in the order in which they are tried."""
    held = _counted_classes(spark, d).drop("tokens")
    label = F.broadcast(held.select("class_id", "label"))
    found = C.candidates(spark, LATIN, C.Settings(edges=True), held)
    named = found.join(label.toDF("c1", "l1"), "c1").join(label.toDF("c2", "l3"), "c2", "left")
    ends = (F.when(F.col("final") == F.lit(False), "#").otherwise(""), F.when(F.col("final"), "#").otherwise(""))
    return named.select("ordinal", "family", F.concat(ends[0], "l1", F.coalesce("l3", F.lit("")), ends[1]).alias("glob"), "weight")


_CANDIDATE_ROWS = """, f as (
  select 0 as rank, 'single' as family, class_id as c1, 0 as c2, null::boolean as final, -size as weight, label as "glob" from counted where not inverted
  union all select 1, 'edge', class_id, 0, final, -size, case when final then label || '#' else '#' || label end from counted, (values (true), (false)) e(final) where not inverted
  union all select 2, 'bigram', a.class_id, b.class_id, null, -a.size - b.size, a.label || b.label from counted a join counted b on not (a.inverted and b.inverted)
  union all select 3, 'edge_bigram', a.class_id, b.class_id, final, -a.size - b.size, case when final then a.label || b.label || '#' else '#' || a.label || b.label end
    from counted a join counted b on not (a.inverted and b.inverted), (values (true), (false)) e(final))
select row_number() over (order by rank, weight, c1, c2, final desc)::int as ordinal, family, "glob", weight from f"""


def _q_reach(spark, d):
    """Violations of every class, any vowels, and every class, summed by the weight of the pair."""
    counts = reach_counts(words(spark, d), C.members(LATIN, False, [("+", "syllabic")]))
    return counts.groupBy(F.bit_count("reach").cast("int").alias("reached"), "seg").agg(F.sum("n").alias("n"))


_VOWELS = C.members(LATIN, False, [("+", "syllabic")])
_REACH = f"""with {WORDS}, p as (select word, freq, j, list_distinct(list_filter(range(1, j - 1), lambda i: len(list_filter(word[i + 1:j - 1], lambda s: ({_VOWELS}::bigint >> (s - 1)) & 1 = 0)) = 0)) as places
  from lex, unnest(range(1, len(word) + 1)) t(j)),
q as (select len(list_distinct(list_transform(places, lambda i: word[i]))) as reached, word[j] as seg, freq from p where len(places) > 0)
select reached::int as reached, seg::int as seg, sum(freq)::bigint as n from q group by all"""


def vowel_of(name: str):
    """1 for a vowel's id, 0 for a consonant's."""
    return (F.lit(_VOWELS).cast("long").bitwiseAND(F.pow(F.lit(2.0), F.col(name) - 1).cast("long")) != 0).cast("int")


def _edges(spark, d) -> DataFrame:
    """An automaton from the corpus: states are whether the last segment is a vowel, edges have the chances of segments."""
    pairs = S.ngrams(words(spark, d), 2)
    states = pairs.select(vowel_of("s1").alias("q"), F.col("s2").alias("seg_id"), vowel_of("s2").alias("q2"), "n")
    sums = states.groupBy("q", "seg_id", "q2").agg(F.sum("n").alias("n"))
    totals = sums.groupBy("q").agg(F.sum("n").alias("total"))
    return sums.join(F.broadcast(totals), "q").select("q", "seg_id", "q2", "n", (F.col("n") / F.col("total")).alias("p"))


_EDGES = f"""{_BASE}, {_BIGRAM_COUNTS}, st as (select ({_VOWELS}::bigint >> (s1 - 1)) & 1 as q, s2 as seg_id, ({_VOWELS}::bigint >> (s2 - 1)) & 1 as q2, sum(n)::bigint as n from bg group by all),
edges as (select q::int as q, seg_id, q2::int as q2, n, n / sum(n) over (partition by q) as p from st),
ab as (select q, q2, sum(p * exp(-(case when q = 0 and q2 = 0 then 1 else 0 end))) as p, max(case when q = 0 and q2 = 0 then 1 else 0 end) as c from edges group by q, q2)"""


def _q_product(spark, d):
    """The automaton of vowels run beside that of nasals; weights are the corpus's counts."""
    pairs = S.ngrams(words(spark, d), 2)
    nasal = C.members(LATIN, False, [("+", "nasal")])

    def bit(name):
        return (F.lit(nasal).cast("long").bitwiseAND(F.pow(F.lit(2.0), F.col(name) - 1).cast("long")) != 0).cast("int")

    def table(of):
        return pairs.select(of("s1").alias("q"), F.col("s2").alias("seg_id"), of("s2").alias("q2"), "n").groupBy("q", "seg_id", "q2").agg(F.sum("n").alias("w"))

    return automata.product_frame(table(vowel_of), table(bit))


_NASALS = C.members(LATIN, False, [("+", "nasal")])
_PRODUCT = f"""{_BASE}, {_BIGRAM_COUNTS},
a as (select (({_VOWELS}::bigint >> (s1 - 1)) & 1)::int as q, s2 as seg_id, (({_VOWELS}::bigint >> (s2 - 1)) & 1)::int as q2, sum(n)::bigint as w from bg group by all),
b as (select (({_NASALS}::bigint >> (s1 - 1)) & 1)::int as q, s2 as seg_id, (({_NASALS}::bigint >> (s2 - 1)) & 1)::int as q2, sum(n)::bigint as w from bg group by all)
select seg_id, a.q as qa, b.q as qb, a.q2 as qa2, b.q2 as qb2, a.w as wa, b.w as wb from a join b using (seg_id)"""


#: Share of the pairs with a first segment from which a second one counts as following it.
_SHARE = 0.02


def _strong(spark, d) -> DataFrame:
    """Pairs of segments as edges: those with at least a fiftieth of all pairs with their first segment."""
    pairs = S.ngrams(words(spark, d), 2)
    totals = pairs.groupBy("s1").agg(F.sum("n").alias("of"))
    found = pairs.join(F.broadcast(totals), "s1").where(F.col("n") >= F.lit(_SHARE) * F.col("of")).select(F.col("s1").alias("q"), F.col("s2").alias("seg_id"), F.col("s2").alias("q2"))
    # bounded by the square of the feature table's segments: the corpus is read once, not once a round
    return spark.createDataFrame(found.collect(), found.schema).coalesce(1)


_STRONG = f"{_BASE}, {_BIGRAM_COUNTS}, e as materialized (select s1, s2 from (select *, sum(n) over (partition by s1) as whole from bg) where n >= {_SHARE} * whole)"


def _q_reachable(spark, d):
    return automata.reachable(_strong(spark, d), spark.range(1).select(F.lit(SEGS.index("a") + 1).alias("q")))


_REACHABLE = f"""{_STRONG.replace("with ", "with recursive ", 1)}, walk(q, steps) as (select {SEGS.index('a') + 1}, 0 union select s2, steps + 1 from walk join e on s1 = q where steps < {len(SEGS)})
select q::int as q, min(steps) as steps from walk group by q"""


def _q_reverse(spark, d):
    return automata.reversed_frame(_strong(spark, d)).select("q2", "seg_id", F.array_join("sources", " ").alias("sources"))


_REVERSE = f"{_STRONG} select s2 as q2, s2 as seg_id, array_to_string(list_sort(list(s1)), ' ') as sources from e group by s2"


def _q_partition_total(spark, d):
    """Over all words: the logarithm of each length's mass, and the expected consonant pairs, times the words of the length."""
    hops = _edges(spark, d).groupBy("q", "q2").agg(F.sum("p").alias("p")).collect()  # one row for each pair of two states
    p = {(r["q"], r["q2"]): float(r["p"]) for r in hops}
    a = {k: F.lit(p.get(k, 0.0) * (math.exp(-1) if k == (0, 0) else 1.0)) for k in ((0, 0), (0, 1), (1, 0), (1, 1))}
    start = F.struct(F.lit(1.0).alias("p0"), F.lit(0.0).alias("p1"), F.lit(0.0).alias("v0"), F.lit(0.0).alias("v1"))

    def step(m, _):
        return F.struct(
            (m["p0"] * a[0, 0] + m["p1"] * a[1, 0]).alias("p0"), (m["p0"] * a[0, 1] + m["p1"] * a[1, 1]).alias("p1"),
            ((m["v0"] + m["p0"]) * a[0, 0] + m["v1"] * a[1, 0]).alias("v0"), (m["v0"] * a[0, 1] + m["v1"] * a[1, 1]).alias("v1"),
        )

    lengths = S.length_frequencies(words(spark, d)).where("len > 0 and n > 0")
    told = lengths.select("len", "n", F.aggregate(F.sequence(F.lit(1), "len"), start, step).alias("m"))
    z = F.col("m.p0") + F.col("m.p1")
    return told.agg(F.round(F.sum(F.col("n") * F.ln(z)), 4).alias("log_partition"), F.round(F.sum(F.col("n") * (F.col("m.v0") + F.col("m.v1")) / z), 4).alias("expected"))


_PARTITION_TOTAL = f"""{_EDGES.replace("with ", "with recursive ", 1)}, a as materialized (select sum(case when q = 0 and q2 = 0 then p end) as aa, sum(case when q = 0 and q2 = 1 then p end) as ab, sum(case when q = 1 and q2 = 0 then p end) as ba, sum(case when q = 1 and q2 = 1 then p end) as bb from ab),
lf as materialized (select len(word) as len, sum(freq) as n from lex group by all),
walk(len, p0, p1, v0, v1) as (select 0, 1.0::double, 0.0::double, 0.0::double, 0.0::double
  union all select len + 1, p0 * aa + p1 * ba, p0 * ab + p1 * bb, (v0 + p0) * aa + v1 * ba, v0 * ab + v1 * bb from walk, a where len < (select max(len) from lf))
select round(sum(n * ln(p0 + p1)), 4) as log_partition, round(sum(n * (v0 + v1) / (p0 + p1)), 4) as expected from walk join lf using (len)"""

_RULES = {"r1": "CC", "r2": "VV", "r3": "#[+nasal]", "r4": "[−sonorant][+nasal]"}


def _rules(spark, d) -> DataFrame:
    """Rules with weights from the corpus: the logarithm of segments to violations."""
    held = words(spark, d)
    found = of_globs(held, {k: parse_glob(g) for k, g in _RULES.items()}, LATIN)
    total = held.agg(F.sum(F.col("freq") * F.size("word")).alias("total"))
    shown = F.create_map(*[F.lit(x) for k, g in _RULES.items() for x in (k, str(parse_glob(g)))])
    return found.crossJoin(F.broadcast(total)).select("name", F.round(F.ln(F.col("total") / (F.col("violations") + 1)), 6).alias("weight"), shown[F.col("name")].alias("glob"))


def _q_serialise(spark, d):
    return _rules(spark, d).select("name", F.format_string("%.3f  %s", "weight", "glob").alias("line"))


def _serialise_sql() -> str:
    from sonority.jobs.corpus import ENC, ends_sql

    each = ", ".join(ends_sql(k, g) for k, g in _RULES.items())
    sums = " union all ".join(f"select '{k}' as name, '{parse_glob(g)}' as shown, sum(freq * {k}) as violations from v" for k, g in _RULES.items())
    return f"with {WORDS}, {ENC}, v as (select freq, {each} from enc), s as ({sums}) select name, printf('%.3f  %s', round(ln((select sum(freq * len(word)) from lex) / (violations + 1)), 6), shown) as line from s"


#: The Latin table with a few features, so that a grammar is soon learnt to its end.
_FEW = ("syllabic", "nasal", "labial")
BROAD = FeatureTable(SEGS, _FEW, tuple(LATIN.states[LATIN.features.index(f)] for f in _FEW))


def _q_learn(spark, d):
    """The grammar that the corpus learns over the broad features with the default sample, until no candidate is left under a threshold."""
    return learn(words(spark, d), BROAD).frame(spark)


def _q_stream(spark, d):
    """The lexicon, collated from a stream of the documents' files."""
    folder = new_path(spark, "collate")
    # documents.parquet is a file or a folder of files: Spark tells which, for it may be the only one that reaches the path
    source = docs(spark, d)
    inside = any(f.rsplit("/", 2)[1] == "documents.parquet" for f in source.inputFiles())
    reader = spark.readStream.schema(source.schema)
    stream = reader.parquet(f"{d}/documents.parquet") if inside else reader.option("pathGlobFilter", "documents.parquet").parquet(d)
    collate(stream, SEGS, f"{folder}/batches", f"{folder}/checkpoint")
    return collated(spark, f"{folder}/batches").select(F.array_join("word", " ").alias("ids"), "freq")


QUERIES = {
    "feature_table_long": _q_cells,
    "feature_table_pivot": _q_pivot,
    "reseg_feature_table": _q_reseg,
    "class_membership": _q_membership,
    "classes_by_generality": _q_classes,
    "core_classes": _q_core,
    "candidates_single_stats": _q_family(C.singles),
    "candidates_edge_stats": _q_family(C.edge_singles),
    "candidates_bigram_stats": _q_family(C.bigrams),
    "candidates_edge_bigram_stats": _q_family(C.edge_bigrams),
    "candidates_trigram_stats": _q_family(C.trigrams, True),
    "candidates_longdistance_stats": _q_family(C.long_distance, True),
    "candidate_rows": _q_candidate_rows,
    "reach_counts": _q_reach,
    "partition_total": _q_partition_total,
    "automaton_product": _q_product,
    "reachable_states": _q_reachable,
    "reverse_edges": _q_reverse,
    "grammar_serialise": _q_serialise,
    "learn_small": _q_learn,
    "collate_stream": _q_stream,
}

SQL = {
    "feature_table_long": f"{_BASE} select c.seg_id, c.seg, feat_id, feat, state, n from cells c join seen using (seg_id)",
    "feature_table_pivot": _PIVOT,
    "reseg_feature_table": _RESEG,
    "class_membership": f"{_BASE}, {CLASSES} select class_id, seg, n from member join seen using (seg_id)",
    "classes_by_generality": f"{_COUNTED} select class_id, size, inverted, label, tokens from counted",
    "core_classes": _core_sql(),
    **{f"candidates_{k}_stats": f"{_COUNTED} {v}" for k, v in _FAMILIES.items()},
    "candidate_rows": f"{_COUNTED} {_CANDIDATE_ROWS}",
    "reach_counts": _REACH,
    "partition_total": _PARTITION_TOTAL,
    "automaton_product": _PRODUCT,
    "reachable_states": _REACHABLE,
    "reverse_edges": _REVERSE,
    "grammar_serialise": _serialise_sql(),
    "collate_stream": f"with {WORDS} select array_to_string(word, ' ') as ids, freq from lex",
}
