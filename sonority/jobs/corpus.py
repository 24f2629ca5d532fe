"""Queries over the corpus: lexicons, lengths, segments, n-grams and violations, each with SQL of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sonority.functions import segments as S
from sonority.functions import stats, vectors
from sonority.functions.classes import class_frame, membership, bigrams
from sonority.functions.features import LATIN
from sonority.functions.globs import body, parse_glob
from sonority.functions.violations import family_totals, glob_count, of_bigrams, of_globs

SEGS = LATIN.segments


def docs(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(spark, sf_dir: str, *keys: str) -> DataFrame:
    return S.lexicon(docs(spark, sf_dir), SEGS, *keys)


# -- SQL shared by the oracles
_LIST = "[" + ", ".join(f"'{s}'" for s in SEGS) + "]"
_TOK = "tok as (select doc_id, lang, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[ \\t\\n\\x0B\\f\\r\\p{Zs}]+')) as token from documents)"
_SEGMENTS = f"regexp_extract_all(token, '{S.alternation(SEGS)}')"
WORDS = f"{_TOK}, tw as (select lang, token, count(*) as n from tok where token <> '' group by all), sw as (select lang, token, n, {_SEGMENTS} as segs from tw), lw as (select lang, list_transform(segs, lambda x: list_position({_LIST}, x)) as word, segs, n from sw where len(segs) > 0), lex as (select word, any_value(segs) as segs, sum(n)::bigint as freq from lw group by word)"
CELLS = "cells(seg_id, seg, feat_id, feat, state) as (values " + ", ".join(f"({s + 1}, '{seg}', {f}, '{feat}', '{LATIN.states[f][s]}')" for f, feat in enumerate(LATIN.features) for s, seg in enumerate(SEGS)) + ")"
SEG_TABLE = "segtab(seg_id, seg) as (values " + ", ".join(f"({i + 1}, '{s}')" for i, s in enumerate(SEGS)) + ")"


def classes_sql(table) -> str:
    full, known = (1 << len(SEGS)) - 1, table.known()
    rows = ", ".join(f"({2 * f + (s == '-')}, '{'−' if s == '-' else s}{name}', {table.mask(name, s)}::bigint)" for name, f in known.items() for s in "+-")
    return f"""lit(o, t, m) as (values {rows}),
c0 as (select {full}::bigint as mask, []::int[] as ords, []::varchar[] as parts),
c1 as (select m as mask, [o] as ords, [t] as parts from lit),
c2 as (select mask & m as mask, list_append(ords, o) as ords, list_append(parts, t) as parts from c1 join lit on o // 2 > ords[-1] // 2),
c3 as (select mask & m as mask, list_append(ords, o) as ords, list_append(parts, t) as parts from c2 join lit on o // 2 > ords[-1] // 2),
plain as (select * from c0 union all select * from c1 union all select * from c2 union all select * from c3),
both_ as (select mask, ords, parts, 0 as inv from plain union all select xor(mask, {full}), ords, parts, 1 from plain),
firsts as (select *, row_number() over (partition by mask order by inv, len(ords), ords) as r from both_ where mask <> 0),
classes as (select row_number() over (order by bit_count(mask) desc, mask) as class_id, mask, bit_count(mask)::int as size, inv = 1 as inverted,
  (case when inv = 1 then '[¬ ' else '[' end) || array_to_string(parts, ' ') || ']' as label from firsts where r = 1),
member as (select class_id, i::int as seg_id from classes, range(1, {len(SEGS) + 1}) t(i) where (mask >> (i - 1)) & 1 = 1)"""


CLASSES = classes_sql(LATIN)


def ends_sql(name: str, text: str) -> str:
    """Places where some match of a glob ends, counted by definition over prefixes of ``enc``."""
    g = parse_glob(text)
    pattern = ("^" if g.initial else "") + body(g.sets(LATIN)) + "$"
    if g.final:
        return f"regexp_matches(enc, '{pattern}')::int as {name}"
    return f"len(list_filter(range(1, length(enc) + 1), lambda i: regexp_matches(substr(enc, 1, i), '{pattern}'))) as {name}"


ENC = "enc as (select lang, word, sum(n)::bigint as freq, any_value(array_to_string(list_transform(word, lambda i: chr((57344 + i)::int)), '')) as enc from lw group by lang, word)"


def _q_collate(spark, d):
    return words(spark, d).select(F.array_join(S.named(F.col("word"), SEGS), " ").alias("segs"), "freq")


def _lines(spark, d):
    lines = docs(spark, d).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    field = F.when(F.col("doc_id") % 5 == 0, "3").when(F.col("doc_id") % 5 == 1, "x").when(F.col("doc_id") % 5 == 2, "4 5").when(F.col("doc_id") % 5 == 3, "-2")
    return lines.select(F.concat_ws("\t", F.lower("line"), field).alias("value"))


def _q_wordlist(spark, d):
    found = S.word_list(_lines(spark, d), SEGS)
    return found.groupBy(F.array_join("segs", " ").alias("segs"), "freq").agg(F.count("*").alias("n"))


_WORDLIST = f"""with lines as (select doc_id, unnest(string_split(lower(coalesce(text, '')), chr(10))) as line from documents),
v as (select string_split(concat_ws(chr(9), line, case doc_id % 5 when 0 then '3' when 1 then 'x' when 2 then '4 5' when 3 then '-2' end), chr(9)) as fields from lines),
f as (select fields[1] as token, list_filter(regexp_split_to_array(array_to_string(fields[2:], ' '), '[ \\t\\n\\x0B\\f\\r\\p{{Zs}}]+'), lambda x: x <> '') as rest from v),
s as (select {_SEGMENTS} as segs, case when len(rest) = 1 and regexp_full_match(rest[1], '-?[0-9]+') then coalesce(try_cast(rest[1] as int), 1) else 1 end as freq from f)
select array_to_string(segs, ' ') as segs, freq::int as freq, count(*) as n from s where len(segs) > 0 group by all"""


def _q_serialised(spark, d):
    rows = words(spark, d).select(S.named(F.col("word"), SEGS).alias("segs"), "freq")
    return S.serialised(rows, SEGS).groupBy("value").agg(F.count("*").alias("n"))


_JOINED = f"""array_to_string(list_transform(range(1, len(segs) + 1), lambda i: (case when i > 1 and len(list_filter({_LIST},
  lambda s: starts_with(segs[i - 1] || segs[i], s) and not starts_with(segs[i - 1], s))) > 0 then '''' else '' end) || segs[i]), '')"""


def _q_joined(spark, d):
    return words(spark, d).select(S.joined(S.named(F.col("word"), SEGS), SEGS).alias("text"), "freq")


def _q_spaced(spark, d):
    rows = words(spark, d).select(S.named(F.col("word"), SEGS).alias("segs"), "freq")
    return S.serialised(rows, SEGS, spaced=True)


def _q_segments(spark, d):
    counts = S.ngrams(words(spark, d), 1)
    return counts.join(F.broadcast(LATIN.segment_frame(spark)), F.col("s1") == F.col("seg_id")).select("seg", "n")


def _q_unknown(spark, d):
    chars = S.tokens(docs(spark, d)).select("n", F.explode(F.split("token", "")).alias("symbol")).where("symbol <> ''")
    counts = chars.groupBy("symbol").agg(F.sum("n").alias("n"))
    return counts.join(LATIN.segment_frame(spark), F.col("symbol") == F.col("seg"), "left_anti")


def _q_hist(spark, d):
    return S.length_frequencies(words(spark, d)).select("len", F.col("n").cast("long").alias("n"))


def _q_pdf(spark, d):
    lengths = S.length_frequencies(words(spark, d))
    return lengths.select("len", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 9).alias("p"))


def _cdf(spark, d):
    return stats.cumulative(S.length_frequencies(words(spark, d)), "len", "n")


def _q_cdf(spark, d):
    return _cdf(spark, d).select("len", F.round("p", 9).alias("p"), F.round("lo", 9).alias("lo"))


def _q_strata(spark, d):
    return stats.stratified(_cdf(spark, d), "len", 3000)


_LEN = f"with {WORDS}, seen as (select len(word) as len, sum(freq)::bigint as n from lex group by all), lengths as (select t.i::int as len, coalesce(n, 0)::bigint as n from range(0, (select max(len) + 1 from seen)) t(i) left join seen on seen.len = t.i), cdf as (select len, n, n / sum(n) over () as p, coalesce(sum(n) over (order by len rows between unbounded preceding and 1 preceding), 0) / sum(n) over () as lo from lengths where n > 0)"


def _q_lookup(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet").select("event_id", (F.abs(F.col("value")) % 1.0).alias("u"))
    return stats.looked_up(events, "u", _cdf(spark, d), "len").select("event_id", "len")


def _q_ngrams(n):
    def run(spark, d):
        return S.ngrams(words(spark, d), n)

    return run


def _q_edges(spark, d):
    """First and last pairs of words, from one pass over the lexicon."""
    totals = family_totals(words(spark, d), True, False, []).where(F.col("kind").isin("2i", "2f"))
    return totals.select("s1", "s2", "n", (F.col("kind") == "2f").alias("final"))


def _ngram_sql(n: int) -> str:
    cols = ", ".join(f"word[i + {k}] as s{k + 1}" for k in range(n))
    keys = ", ".join(f"s{k + 1}" for k in range(n))
    return f"with {WORDS}, g as (select freq, {cols} from lex, unnest(range(1, len(word) - {n - 2})) t(i)) select {keys}, sum(freq)::bigint as n from g group by {keys}"


def _q_violations_bigram(spark, d):
    classes = class_frame(spark, LATIN)
    return of_bigrams(S.ngrams(words(spark, d), 2), membership(classes, len(SEGS)), bigrams(classes)).select("c1", "c2", "weight", "violations")


_BIGRAM_COUNTS = "bg as (select s1, s2, sum(freq)::bigint as n from (select freq, word[i] as s1, word[i + 1] as s2 from lex, unnest(range(1, len(word))) t(i)) group by all)"
_PAIR_COUNTS = "half as (select class_id as c1, s2, sum(n) as n from bg join member on s1 = seg_id group by all), pair as (select c1, class_id as c2, sum(n)::bigint as violations from half join member on s2 = seg_id group by all)"
_VIOLATIONS = f"""with {WORDS}, {_BIGRAM_COUNTS}, {CLASSES}, {_PAIR_COUNTS}
select a.class_id as c1, b.class_id as c2, -a.size - b.size as weight, coalesce(violations, 0) as violations
from classes a join classes b on not (a.inverted and b.inverted) left join pair on pair.c1 = a.class_id and pair.c2 = b.class_id"""

#: The globs that the pattern queries count.
ANCHORED = {"initial_cc": "#CC", "final_cc": "CC#", "initial_v": "#V", "whole_cvc": "#CVC#", "final_nasal": "[+nasal]#", "initial_run": "#C₁V"}
DISTANT = {"v_c_v": "VC₁V", "stop_v_nasal": "[−continuant]V₁[+nasal]", "nasal_any_nasal": "[+nasal]…[+nasal]", "v_c_v_final": "VC₁V#", "cc_run": "C₁C", "not_v_pair": "[¬ +syllabic][−syllabic]"}
SCORED = {"cc": "CC", "vv": "VV", "nasal_stop": "[+nasal][−continuant]", "final_voiced": "[−sonorant +voice]#"}
WEIGHTS = (0.5, 0.25, 1.0, 2.0)


def _q_globs(globs: dict[str, str]):
    def run(spark, d):
        return of_globs(words(spark, d), {k: parse_glob(g) for k, g in globs.items()}, LATIN).select("name", "violations")

    return run


def _globs_sql(globs: dict[str, str]) -> str:
    each = ", ".join(ends_sql(k, g) for k, g in globs.items())
    total = " union all ".join(f"select '{k}' as name, coalesce(sum(freq * {k}), 0)::bigint as violations from v" for k in globs)
    return f"with {WORDS}, {ENC}, v as (select freq, {each} from enc) {total}"


def _q_by_lang(spark, d):
    found = of_globs(words(spark, d, "lang"), {k: parse_glob(g) for k, g in SCORED.items()}, LATIN, "lang")
    return found.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("name", "violations"))).alias("x")).select("lang", F.array_join(F.transform("x", lambda s: F.concat_ws("=", s["name"], s["violations"].cast("string"))), ",").alias("counts"))


_BY_LANG = f"with {WORDS}, {ENC}, v as (select lang, freq, {', '.join(ends_sql(k, g) for k, g in SCORED.items())} from enc) select lang, " + " || ',' || ".join(f"'{k}=' || sum(freq * {k})::bigint" for k in sorted(SCORED)) + " as counts from v group by lang"


def _q_scores(spark, d):
    enc = words(spark, d).select("word", F.array_join("word", " ").alias("ids"), S.encoded(F.col("word")).alias("enc"))
    counts = F.array(*[glob_count("word", "enc", parse_glob(t), LATIN) for t in SCORED.values()])
    return enc.select("ids", F.round(F.exp(-S.dot(F.array(*map(F.lit, WEIGHTS)), counts)), 9).alias("score"))


_SCORES = f"with {WORDS}, {ENC}, w as (select word, any_value(enc) as enc from enc group by word), v as (select word, {', '.join(ends_sql(k, g) for k, g in SCORED.items())} from w) select array_to_string(word, ' ') as ids, round(exp(-(" + " + ".join(f"{w} * {k}" for w, k in zip(WEIGHTS, SCORED)) + ")), 9) as score from v"


def _oe(spark, d):
    """Segment pairs of English against all other languages, scaled to as many pairs."""
    counts = S.ngrams(words(spark, d, "lang"), 2, "lang")
    by = counts.groupBy("s1", "s2").agg(F.sum(F.when(F.col("lang") == "en", F.col("n")).otherwise(0)).alias("o"), F.sum(F.when(F.col("lang") == "en", 0).otherwise(F.col("n"))).alias("x"))
    every = Window.partitionBy()  # pairs of segments: bounded by the feature table
    return by.select("s1", "s2", "o", (F.col("x") * (F.sum("o").over(every) / F.sum("x").over(every))).alias("e"))


def _q_oe(spark, d):
    return _oe(spark, d).select("s1", "s2", F.col("o").cast("long").alias("o"), F.round("e", 4).alias("e"), F.round(stats.upper_ratio(F.col("o"), F.col("e")), 6).alias("score"))


_OE_SQL = f"""with {WORDS}, lb as (select lang, n, word[i] as s1, word[i + 1] as s2 from lw, unnest(range(1, len(word))) t(i)),
ox as (select s1, s2, sum(case when lang = 'en' then n else 0 end)::bigint as o, sum(case when lang = 'en' then 0 else n end)::bigint as x from lb group by all),
oe as (select s1, s2, o, x * (sum(o) over () / sum(x) over ()) as e from ox), pe as (select *, (o + 0.5) / (e + 1) as p from oe),
sc as (select *, case when p >= 1 then 1.0 else least(1.0, p + 3 * sqrt(p * (1 - p) / (e + 1))) end as score from pe)"""


def _q_next(spark, d):
    """The first pair in order, rarest label last, whose score is under the threshold and that is not yet chosen."""
    scored = _oe(spark, d).withColumn("score", stats.upper_ratio(F.col("o"), F.col("e")))
    chosen = scored.where("score < 0.01").select("s1", "s2")
    return scored.where("score < 0.1").join(chosen, ["s1", "s2"], "left_anti").orderBy(F.desc("e"), "s1", "s2").limit(1).select("s1", "s2", F.round("score", 6).alias("score"))


def _q_langs(spark, d):
    """Words of English documents with a toxic label that stand in no document labelled otherwise."""
    labels = spark.read.parquet(f"{d}/labels.parquet")
    toxic = docs(spark, d).join(labels.where("toxic = 1"), "doc_id", "left_semi")
    other = docs(spark, d).join(labels.where("toxic = 0"), "doc_id", "left_semi")
    found = S.lexicon(toxic.where("lang = 'en'"), SEGS).join(S.lexicon(other, SEGS), "word", "left_anti")
    return found.select(F.array_join("word", " ").alias("ids"), "freq")


_LANGS = f"""with {_TOK}, t as (select doc_id, lang, {_SEGMENTS} as segs from tok where token <> ''),
w as (select doc_id, lang, list_transform(segs, lambda x: list_position({_LIST}, x)) as word from t where len(segs) > 0)
select array_to_string(word, ' ') as ids, count(*) as freq from w
where lang = 'en' and doc_id in (select doc_id from labels where toxic = 1) and word not in (select word from w where doc_id in (select doc_id from labels where toxic = 0)) group by word"""


def _q_subsequences(spark, d):
    return S.triples(words(spark, d)).select(F.concat_ws(" ", "s1", "s2", "s3").alias("ids"), "n")


_SUBSEQUENCES = f"""with {WORDS}, p as (select word, freq, i, word[i] as s2 from lex, unnest(range(2, len(word))) t(i)),
h as (select i, s2, freq, word, word[j] as s1, count(*) as k from p, unnest(range(1, i)) t(j) group by all)
select s1 || ' ' || s2 || ' ' || word[j] as ids, sum(freq * k)::bigint as n from h, unnest(range(i + 1, len(word) + 1)) t(j) group by all"""


def _q_vectors(spark, d):
    """Norms and products of the embeddings, and the expectation of two of their entries taken as weights."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    pair = vectors.times(vectors.expectation(F.abs(v[0]), F.slice(v, 1, 2)), vectors.plus(vectors.expectation(F.abs(v[1]), F.slice(v, 2, 2)), vectors.expectation(F.lit(1.0), F.slice(v, 3, 1))))
    return spark.read.parquet(f"{d}/embeddings.parquet").select(
        "vec_id", F.round(vectors.norm(v), 6).alias("l2"), F.round(vectors.absolute(v), 6).alias("l1"), F.aggregate(vectors.signs(v), F.lit(0.0), lambda s, x: s + x).cast("int").alias("signs"),
        F.round(vectors.inner(vectors.normalised(v), F.reverse(v)), 6).alias("turned"), F.round(pair["p"], 6).alias("p"), F.round(pair["v"][0], 6).alias("v0"),
    )


_VECTORS = """with e as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings)
select vec_id, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) as l2, round(list_sum(list_transform(v, lambda x: abs(x))), 6) as l1, list_sum(list_transform(v, lambda x: sign(x)))::int as signs,
  round(list_sum(list_transform(range(1, len(v) + 1), lambda i: v[i] * v[len(v) + 1 - i])) / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) as turned,
  round(abs(v[1]) * (abs(v[2]) + 1), 6) as p, round(abs(v[1]) * (v[2] + v[3]) + v[1] * (abs(v[2]) + 1), 6) as v0 from e"""

QUERIES = {
    "vector_algebra": _q_vectors,
    "collate_words": _q_collate,
    "wordlist_parse_freq": _q_wordlist,
    "wordlist_serialise": _q_serialised,
    "wordlist_serialise_spaced": _q_spaced,
    "join_segments": _q_joined,
    "segment_frequency": _q_segments,
    "unknown_symbols": _q_unknown,
    "length_histogram_dense": _q_hist,
    "length_pdf": _q_pdf,
    "length_cdf": _q_cdf,
    "stratified_lengths": _q_strata,
    "cdf_lookup": _q_lookup,
    "bigram_counts": _q_ngrams(2),
    "trigram_counts": _q_ngrams(3),
    "edge_ngram_counts": _q_edges,
    "word_subsequences": _q_subsequences,
    "violations_bigram": _q_violations_bigram,
    "violations_anchored": _q_globs(ANCHORED),
    "violations_longdistance": _q_globs(DISTANT),
    "multi_violation_vector": _q_by_lang,
    "maxent_score": _q_scores,
    "oe_scores": _q_oe,
    "next_constraint": _q_next,
    "lexicon_by_lang_compare": _q_langs,
}

SQL = {
    "vector_algebra": _VECTORS,
    "collate_words": f"with {WORDS} select array_to_string(segs, ' ') as segs, freq from lex",
    "wordlist_parse_freq": _WORDLIST,
    "wordlist_serialise": f"with {WORDS}, v as (select {_JOINED} || case when freq = 1 then '' else chr(9) || freq end as value from lex) select value, count(*) as n from v group by value",
    "wordlist_serialise_spaced": f"with {WORDS} select array_to_string(segs, ' ') || case when freq = 1 then '' else chr(9) || freq end as value from lex",
    "join_segments": f"with {WORDS} select {_JOINED} as text, freq from lex",
    "segment_frequency": f"with {WORDS} select seg, sum(freq)::bigint as n from (select unnest(segs) as seg, freq from lex) group by seg",
    "unknown_symbols": f"with {_TOK}, ch as (select unnest(regexp_extract_all(token, '(?s).')) as symbol from tok where token <> '') select symbol, count(*) as n from ch where symbol not in (select unnest({_LIST})) group by symbol",
    "length_histogram_dense": f"{_LEN} select len, n from lengths",
    "length_pdf": f"{_LEN} select len, round(n / (select sum(n) from lengths), 9) as p from lengths",
    "length_cdf": f"{_LEN} select len, round(p, 9) as p, round(lo, 9) as lo from cdf",
    "stratified_lengths": f"{_LEN} select len, (lead(round_even(3000 * lo, 0), 1, 3000.0) over (order by lo) - round_even(3000 * lo, 0))::bigint as draws from cdf",
    "cdf_lookup": f"{_LEN}, ev as (select event_id, abs(value) % 1.0 as u from events) select event_id, len from ev asof join cdf on ev.u >= cdf.lo",
    "bigram_counts": _ngram_sql(2),
    "trigram_counts": _ngram_sql(3),
    "edge_ngram_counts": f"with {WORDS} select word[len(word) - 1] as s1, word[len(word)] as s2, sum(freq)::bigint as n, true as final from lex where len(word) > 1 group by 1, 2 union all select word[1], word[2], sum(freq)::bigint, false from lex where len(word) > 1 group by 1, 2",
    "word_subsequences": _SUBSEQUENCES,
    "violations_bigram": _VIOLATIONS,
    "violations_anchored": _globs_sql(ANCHORED),
    "violations_longdistance": _globs_sql(DISTANT),
    "multi_violation_vector": _BY_LANG,
    "maxent_score": _SCORES,
    "oe_scores": f"{_OE_SQL} select s1, s2, o, round(e, 4) as e, round(score, 6) as score from sc",
    "next_constraint": f"{_OE_SQL} select s1, s2, round(score, 6) as score from sc where score < 0.1 and score >= 0.01 order by e desc, s1, s2 limit 1",
    "lexicon_by_lang_compare": _LANGS,
}
