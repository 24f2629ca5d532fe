"""Queries over a grammar's automaton: masses and expectations of all lengths, sampled words, pruned states, words in pieces, candidates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonority.functions import automata, classes as C
from sonority.functions import segments as S
from sonority.functions.features import LATIN
from sonority.functions.globs import parse_glob
from sonority.functions.grammar import certificate, fit_weights, Grammar, sampled_frame
from sonority.functions.violations import of_globs
from sonority.jobs.corpus import _LIST, ENC, SEGS, WORDS, classes_sql, docs, ends_sql, words
from sonority.jobs.folds import _corpus_grammar
from sonority.jobs.grammars import _REACHABLE, _RULES, _strong, BROAD
from sonority.sources.tables import written

_N, _NAMES = len(SEGS), sorted(_RULES)


def _masses(spark, d) -> tuple[DataFrame, int]:
    """Masses of the corpus's grammar up to the corpus's longest word."""
    grammar = _corpus_grammar(spark, d)
    m, longest = grammar.automaton(LATIN), max(grammar.lengths, default=0)
    return automata.masses(automata.edge_frame(spark, m), automata.end_frame(spark, m), grammar.weights, longest, _N)


def _q_partition(spark, d):
    """The logarithm of each length's mass."""
    return _masses(spark, d).select("len", F.round(F.ln("z") + F.col("len") * F.ln(F.lit(float(_N))), 6).alias("log_z"))


def _q_expected(spark, d):
    """How often a word of each length is expected to violate each rule."""
    sums = _masses(spark, d).select("len", *[F.round(F.col(f"v{i}") / F.col("z"), 6).alias(k) for i, k in enumerate(_NAMES)])
    return sums.unpivot(["len"], _NAMES, "name", "expected")


def _has(segment: str, state: str, feature: str) -> str:
    """Whether a segment id, which may be 0, is in a class."""
    return f"({segment} > 0 and (({C.members(LATIN, False, [(state, feature)])}::bigint >> greatest({segment} - 1, 0)) & 1) = 1)"


_ONE = ", ".join(ends_sql(k, g) for k, g in _RULES.items())
#: The rules' weights, and the weight of each segment after each other one; 0 stands for a word's start.
_STEPS = f"""{WORDS}, {ENC}, vi as (select freq, {_ONE} from enc),
w as materialized (select {', '.join(f"round(ln((select sum(freq * len(word)) from lex) / (sum(freq * {k}) + 1)), 6) as w_{k}" for k in _NAMES)} from vi),
id as (select range as s from range(0, {_N + 1})),
pair as (select a.s as prev, b.s as s, ({_has('a.s', '-', 'syllabic')} and {_has('b.s', '-', 'syllabic')})::int as c_r1, ({_has('a.s', '+', 'syllabic')} and {_has('b.s', '+', 'syllabic')})::int as c_r2,
  (a.s = 0 and {_has('b.s', '+', 'nasal')})::int as c_r3, ({_has('a.s', '-', 'sonorant')} and {_has('b.s', '+', 'nasal')})::int as c_r4
  from id a join (select s from id where s > 0) b on true),
tr as materialized (select prev, s, {', '.join(f'c_{k}' for k in _NAMES)}, exp(-({' + '.join(f'w_{k} * c_{k}' for k in _NAMES)})) / {_N} as p from pair, w)"""
_VS = ", ".join(f"v_{k}" for k in _NAMES)
_WALK = f"""with recursive {_STEPS}, top as (select max(len(word)) as top from lex),
m(len, s, p, {_VS}) as (select 0, 0::bigint, 1.0::double, {', '.join('0.0::double' for _ in _NAMES)}
  union all select len + 1, tr.s, sum(m.p * tr.p), {', '.join(f'sum(m.v_{k} * tr.p + m.p * tr.p * c_{k})' for k in _NAMES)} from m join tr on tr.prev = m.s where len < (select top from top) group by len + 1, tr.s)"""
_PARTITION = f"{_WALK} select len, round(ln(sum(p)) + len * ln({_N}::double), 6) as log_z from m group by len"
_EXPECTED = f"{_WALK} " + " union all ".join(f"select len, '{k}' as name, round(sum(v_{k}) / sum(p), 6) as expected from m group by len" for k in _NAMES)


def _q_sample(spark, d):
    """As many words as the corpus has documents, sampled from its grammar."""
    drawn = sampled_frame(spark, _corpus_grammar(spark, d), LATIN, docs(spark, d).count())
    return drawn.select("row_id", F.array_join(S.named(F.col("word"), SEGS), " ").alias("segs"))


def _times(x: str, by: int) -> str:
    return f"(({x})::uhugeint * {by}::uhugeint % 18446744073709551616::uhugeint)::ubigint"


#: The hash number of a row and a step, and its place in [0, 1).
_HASH = f"""(({_times('row_id', 0x9E3779B97F4A7C15)}::uhugeint + {_times('k + 1', 0xBF58476D1CE4E5B9)}::uhugeint + {0x94D049BB133111EB}::uhugeint) % 18446744073709551616::uhugeint)::ubigint"""
#: Weights of what may follow are found backwards; a row's segment is the first whose running sum goes beyond its number.
_SAMPLE = f"""with recursive {_STEPS}, top as (select max(len(word)) as top from lex),
b(j, s, b) as (select 0, s, 1.0::double from id union all select j + 1, tr.prev, sum(tr.p * b.b) from b join tr on tr.s = b.s where j < (select top from top) group by j + 1, tr.prev),
cum as materialized (select j, prev, tr.s, sum(tr.p * b.b) over (partition by j, prev order by tr.s) as run, sum(tr.p * b.b) over (partition by j, prev order by tr.s rows between unbounded preceding and unbounded following) as total from tr join b on b.s = tr.s),
lf as (select len(word) as len, sum(freq) as n from lex group by all), z as (select count(*)::double as k from documents),
cdf as (select len, coalesce(sum(n) over (order by len rows between unbounded preceding and 1 preceding), 0) / sum(n) over () as lo from lf),
ed as (select len, round_even(k * lo, 0)::bigint as a, lead(round_even(k * lo, 0), 1, k) over (order by len)::bigint as e from cdf, z),
rw as materialized (select row_id, len, k - 1 as k from ed, unnest(range(a, e)) t(row_id), unnest(range(1, len + 1)) u(k)),
h1 as (select row_id, k, len, {_HASH} as h from rw), h2 as (select row_id, k, len, {_times('xor(h, h >> 30)', 0xBF58476D1CE4E5B9)} as h from h1), h3 as (select row_id, k, len, {_times('xor(h, h >> 27)', 0x94D049BB133111EB)} as h from h2),
u as materialized (select row_id, k, len, xor(h, h >> 31)::double / 18446744073709551616.0::double as u from h3),
st(row_id, k, s) as (select distinct row_id, 0::bigint, 0::bigint from rw
  union all select st.row_id, st.k + 1, coalesce(min(case when cum.run > u.u * cum.total then cum.s end), {_N}) from st join u on u.row_id = st.row_id and u.k = st.k join cum on cum.j = u.len - 1 - u.k and cum.prev = st.s group by st.row_id, st.k)
select row_id, string_agg({_LIST}[s], ' ' order by k) as segs from st where k > 0 group by row_id"""


def _q_renumbered(spark, d):
    """The states that are reached from "a", with numbers of their own."""
    return automata.renumbered(_strong(spark, d), spark.range(1).select(F.lit(SEGS.index("a") + 1).alias("q")))


_RENUMBERED = f"select q as old, (row_number() over (order by steps, q) - 1)::int as new from ({_REACHABLE})"
_PIECES = {"p1": "VC+V", "p2": "CC", "p3": "C+C#", "p4": "#[+nasal]…C"}


def _q_piecewise(spark, d):
    """Violations of rules, with every word in pieces of seven segments."""
    held = written(words(spark, d).select(F.monotonically_increasing_id().alias("id"), "word", "freq"), "words")
    found = []
    for name, text in _PIECES.items():
        g = parse_glob(text)
        counts = automata.piecewise(held.select("id", "word"), automata.counter(g.initial, g.final, g.sets(LATIN), _N), 7, 3)
        found.append(held.select("id", "freq").join(counts, "id").agg(F.lit(name).alias("name"), F.sum(F.col("freq") * F.col("count")).alias("violations")))
    return S.union_all(found).select("name", F.coalesce("violations", F.lit(0)).alias("violations"))


_PIECEWISE = f"with {WORDS}, {ENC}, v as (select freq, {', '.join(ends_sql(k, g) for k, g in _PIECES.items())} from enc) " + " union all ".join(f"select '{k}' as name, coalesce(sum(freq * {k}), 0)::bigint as violations from v" for k in _PIECES)


def _q_wide_candidates(spark, d):
    """Candidates of three parts and long-distance ones over the classes that the corpus has, as rows in order."""
    seen = words(spark, d).select(F.explode("word").alias("s")).distinct()
    bits = seen.agg(F.coalesce(F.bit_or(F.expr("shiftleft(1L, s - 1)")), F.lit(0)).alias("seen"))
    held = C.class_frame(spark, BROAD).crossJoin(F.broadcast(bits)).where(F.col("mask").bitwiseAND(F.col("seen")) != 0).drop("seen")
    held = written(held, "classes", 1)
    label = F.broadcast(held.select("class_id", "label"))
    found = C.candidates(spark, BROAD, C.Settings(False, ("syllabic",), ("syllabic",)), held)
    named = found.join(label.toDF("c1", "l1"), "c1").join(label.toDF("c2", "lb"), "c2", "left").join(label.toDF("c3", "l3"), "c3", "left")
    between = F.when(F.col("l2").isNotNull(), F.concat("l2", F.lit("₁"))).otherwise(F.coalesce("lb", F.lit("")))
    return named.select("ordinal", "family", F.concat("l1", between, F.coalesce("l3", F.lit(""))).alias("glob"), "weight")


_WIDE = f"""with {WORDS}, {classes_sql(BROAD)}, seen as (select distinct unnest(word) as seg_id from lex),
k as (select class_id, size, inverted, inverted::int as i, label, label in ('[]', '[+syllabic]', '[−syllabic]') as core from classes where class_id in (select class_id from member join seen using (seg_id))),
mid(place, l) as (values (1, '[]'), (2, '[+syllabic]'), (3, '[−syllabic]')),
f as (select 0 as rank, 'single' as family, class_id as c1, 0 as c2, 0 as place, 0 as c3, -size as weight, label as "glob" from k where not inverted
  union all select 2, 'bigram', a.class_id, b.class_id, 0, 0, -a.size - b.size, a.label || b.label from k a join k b on not (a.inverted and b.inverted)
  union all select 4, 'trigram', a.class_id, b.class_id, 0, c.class_id, case when a.core then -b.size - c.size when b.core then -a.size - c.size else -a.size - b.size end, a.label || b.label || c.label
    from k a join k b on a.i + b.i <= 1 join k c on a.i + b.i + c.i <= 1 and (a.core or b.core or c.core)
  union all select 5, 'long_distance', a.class_id, 0, place, c.class_id, -a.size - c.size, a.label || l || '₁' || c.label from k a, mid, k c)
select row_number() over (order by rank, weight, c1, c2, place, c3)::int as ordinal, family, "glob", weight from f"""

#: Rules of single, disjoint classes: two that words have less of than they might, one that they have more of.
_PLAIN = {"p1": "[+round]", "p2": "[+voice −sonorant]", "p3": "[+nasal]"}


def _q_certificate(spark, d):
    """The best weights of rules of single classes, and that they are the best."""
    held = words(spark, d)
    rules = {k: parse_glob(g) for k, g in _PLAIN.items()}
    observed = written(of_globs(held, rules, LATIN), "observed", 1)
    lengths = written(S.length_frequencies(held).where("len > 0"), "lengths", 1)
    number = {r["len"]: r["n"] for r in lengths.collect()}
    if not number:
        return spark.createDataFrame([], "name string, weight double, observed long, share double, optimal boolean")
    counts = {r["name"]: float(r["violations"]) for r in observed.collect()}
    m = Grammar(number, list(rules.values()), [0.0] * len(rules)).automaton(LATIN)
    best = fit_weights(m, np.array([number.get(k, 0) for k in range(max(number) + 1)], float), np.array([counts[k] for k in rules]), np.zeros(len(rules)), 1e-7, 500, 1e-8)
    masses = automata.masses(automata.edge_frame(spark, m), automata.end_frame(spark, m), best.tolist(), max(number), _N)
    told = certificate(masses, lengths, observed, dict(zip(rules, best.tolist())))
    return told.select("name", F.round("weight", 4).alias("weight"), "observed", F.round(F.col("expected") / (F.col("observed") + 1), 4).alias("share"), "optimal")


def _certificate_sql() -> str:
    """In closed form: with weights for the first two, the expected counts of these are the observed ones and one."""
    size = [parse_glob(g).sets(LATIN)[0][1].bit_count() for g in _PLAIN.values()]
    sums = ", ".join(f"sum(freq * {k})::bigint as o{i}" for i, k in enumerate(_PLAIN))
    r0, r1 = "(o0 + 1) / t", "(o1 + 1) / t"
    return f"""with {WORDS}, {ENC}, v as (select freq, len(word) as n, {', '.join(ends_sql(k, g) for k, g in _PLAIN.items())} from enc),
s as (select {sums}, sum(freq * n)::double as t from v), x as (select *, {_N - size[0] - size[1]} / (1 - {r0} - {r1}) as whole from s)
select 'p1' as name, round(-ln({r0} * whole / {size[0]}), 4) as weight, o0 as observed, 1.0 as share, true as optimal from x
union all select 'p2', round(-ln({r1} * whole / {size[1]}), 4), o1, 1.0, true from x
union all select 'p3', 0.0, o2, round({size[2]} * t / whole / (o2 + 1), 4), true from x"""


QUERIES = {
    "weights_certificate": _q_certificate,
    "partition_by_length": _q_partition,
    "expected_violations": _q_expected,
    "sample_words": _q_sample,
    "renumbered_states": _q_renumbered,
    "piecewise_violations": _q_piecewise,
    "candidate_rows_wide": _q_wide_candidates,
}
SQL = {
    "weights_certificate": _certificate_sql(),
    "partition_by_length": _PARTITION,
    "expected_violations": _EXPECTED,
    "sample_words": _SAMPLE,
    "renumbered_states": _RENUMBERED,
    "piecewise_violations": _PIECEWISE,
    "candidate_rows_wide": _WIDE,
}
