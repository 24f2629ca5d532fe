"""Queries over lexicons that are kept, edited and put in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonority.functions import lexicons as L
from sonority.functions import segments as S
from sonority.functions.features import LATIN
from sonority.jobs.corpus import _JOINED, _LIST, _TOK, _lines, SEGS, WORDS, docs, words

#: The same letters without digraphs.
SINGLE = LATIN.resegmented([s for s in SEGS if len(s) == 1])


def _q_sorted(spark, d) -> DataFrame:
    """The lexicon in the order of its words, each with its place."""
    found = L.placed(words(spark, d), "word")
    return found.select("place", F.array_join(S.named(F.col("word"), SEGS), " ").alias("segs"), "freq")


_SORTED = f"with {WORDS} select row_number() over (order by word) as place, array_to_string(segs, ' ') as segs, freq from lex"


def _q_edited(spark, d) -> DataFrame:
    """The lexicon after the events as changes to its rows: an event names a place, errors delete, other events put a frequency.

    The places go half as far again as the lexicon, so that rows come in too.
    """
    base = L.placed(words(spark, d), "word").select("place", F.array_join(S.named(F.col("word"), SEGS), " ").alias("segs"), "freq")
    size = base.agg(F.count("*").alias("size"))
    events = spark.read.parquet(f"{d}/events.parquet").crossJoin(F.broadcast(size)).where("size > 0")
    place = F.col("event_id") * 7919 % F.expr("size + cast(size / 2 as bigint) + 1") + 1
    op = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "view", "insert").otherwise("update")
    changes = events.select(place.alias("place"), F.concat(F.lit("of "), F.col("event_type")).alias("segs"), F.floor("value").cast("long").alias("freq"), F.col("ts").alias("seq"), op.alias("op"))
    return L.merged(base, changes, ["place"])


_EDITED = f"""with {WORDS}, base as materialized (select row_number() over (order by word) as place, array_to_string(segs, ' ') as segs, freq from lex),
z as (select count(*) as size from base),
c as (select event_id * 7919 % (size + floor(size / 2)::bigint + 1) + 1 as place, 'of ' || event_type as segs, floor(value)::bigint as freq, ts, event_type from events, z where size > 0 and ts is not null and event_id is not null),
l as (select * from (select *, row_number() over (partition by place order by ts desc, event_type = 'error', segs desc nulls last, freq desc nulls last) as r from c) where r = 1)
select coalesce(l.place, base.place) as place, case when l.place is null then base.segs else l.segs end as segs, case when l.place is null then base.freq else l.freq end as freq
from base full join l on base.place = l.place where l.place is null or l.event_type <> 'error'"""


def _source(spark, d) -> DataFrame:
    """The texts' words, their lines as a word list, and the lexicon's words as if they were entered by hand."""
    return L.kept(L.of_text(docs(spark, d)), L.of_list(_lines(spark, d)), L.of_edits(words(spark, d), LATIN))


def _q_resegmented(spark, d) -> DataFrame:
    """Lexicons under another table, from a kept source: the texts are not read again."""
    return L.resegmented(_source(spark, d), SINGLE).select("kind", F.array_join(S.named(F.col("word"), SINGLE.segments), " ").alias("segs"), "freq")


_CUT = f"regexp_extract_all({{}}, '{S.alternation(SINGLE.segments)}')"
_RESEGMENTED = f"""with {WORDS},
lines as (select doc_id, unnest(string_split(lower(coalesce(text, '')), chr(10))) as line from documents where text is not null),
v as (select string_split(concat_ws(chr(9), line, case doc_id % 5 when 0 then '3' when 1 then 'x' when 2 then '4 5' when 3 then '-2' end), chr(9)) as fields from lines),
f as (select fields[1] as token, list_filter(regexp_split_to_array(array_to_string(fields[2:], ' '), '[ \\t\\n\\x0B\\f\\r\\p{{Zs}}]+'), lambda x: x <> '') as rest from v),
s as (select 'text' as kind, {_CUT.format('token')} as segs, n from tw
  union all select 'list', {_CUT.format('token')}, case when len(rest) = 1 and regexp_full_match(rest[1], '-?[0-9]+') then coalesce(try_cast(rest[1] as int), 1) else 1 end from f
  union all select 'custom', {_CUT.format(f"({_JOINED})")}, freq from lex)
select kind, array_to_string(segs, ' ') as segs, sum(n)::bigint as freq from s where len(segs) > 0 group by all"""

QUERIES = {"sorted_lexicon": _q_sorted, "edited_lexicon": _q_edited, "resegmented_lexicon": _q_resegmented}
SQL = {"sorted_lexicon": _SORTED, "edited_lexicon": _EDITED, "resegmented_lexicon": _RESEGMENTED}
