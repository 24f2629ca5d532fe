"""Mixing sources to target weights by hierarchical budgeting.

A token budget is dealt down a tree of domains, languages and sources. At each node the children get shares by weight;
a child that cannot use its share, for its tokens times the allowed epochs are fewer, leaves the rest to its siblings,
and only what a whole subtree cannot use goes to the siblings of its root. Each leaf then takes its documents in the
order of seeded epochs: whole epochs first, then the prefix of the next whose tokens fit.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonority.llm import common
from sonority.llm.common import met, table, text_or_empty, written

#: Weights of the tree that the query and the pipeline use; what is not named has the weight of "".
WEIGHTS = {
    "domain": {"books": 0.3, "code": 0.1, "news": 0.2, "web": 0.4, "": 0.1},
    "lang": {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1, "": 0.05},
    "source": {"": 1.0},
}
#: Share of all tokens that the budget is, epochs that a document may be taken in, and the seed of their orders.
SHARE, EPOCHS, SEED = 0.9, 2, 17
#: Documents in a slice of an epoch's order, about: only the slice in which a leaf's prefix ends is sorted.
SLICE_ROWS = 2000
_LEAF = ["_domain", "_lang", "_source"]


def domain_of(source: Column) -> Column:
    """The example's domains: by the first hexadecimal digit of the source's MD5."""
    first = F.substring(F.md5(source), 1, 1)
    return F.when(first < "4", "books").when(first < "8", "code").when(first < "c", "news").otherwise("web")


def with_leaf(docs: DataFrame) -> DataFrame:
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    return docs.withColumns({
        "_domain": domain_of(source),
        "_lang": F.coalesce(F.col("lang").cast("string"), F.lit("")),
        "_source": source,
    })


def _n_tokens() -> Column:
    return F.regexp_count(text_or_empty(), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def _weight(level: str, weights: dict) -> Column:
    own = weights[level]
    out = F.lit(float(own[""]))
    for name, w in own.items():
        if name:
            out = F.when(F.col(f"_{level}") == name, F.lit(float(w))).otherwise(out)
    return out


def _share_out(nodes: DataFrame, parent: list[str], child: str) -> DataFrame:
    """Deal each parent's ``budget`` to its children by ``w``, each at most ``cap``; what is left goes to siblings.

    With children sorted by cap to weight, the water level is the largest of (budget - caps before) / (weights from
    here on).
    """
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    up = by.orderBy(F.col("cap") / F.col("w"), child)
    before = F.coalesce(F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("w").over(up.rowsBetween(0, Window.unboundedFollowing))
    levelled = nodes.withColumn("_f", (F.col("budget") - before) / rest).withColumn("_level", F.max("_f").over(by))
    return levelled.withColumn("got", F.least(F.col("cap").cast("double"), F.col("w") * F.col("_level"))).drop("_f", "_level")


def budgets(leaves: DataFrame, weights: dict = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, budget: int | None = None) -> DataFrame:
    """Token budget of each leaf.

    A weight of 0 excludes: its nodes and all below them get nothing, whatever their siblings leave, and can't take up a shortage of
    theirs. Where all weights are 0, nothing is taken.

    :param leaves: ``_domain, _lang, _source, tokens``.
    :return: the leaves with ``take``, whole tokens.
    """
    given = [w for own in weights.values() for w in own.values()]
    if any(w < 0 for w in given):
        raise ValueError("weights must not be below zero")
    every = leaves
    if 0 in given:
        leaves = leaves.where((_weight("domain", weights) > 0) & (_weight("lang", weights) > 0) & (_weight("source", weights) > 0))
    cap = F.sum("tokens") * epochs
    total = every.agg(F.floor(F.coalesce(F.sum("tokens"), F.lit(0)) * F.lit(share)).cast("double").alias("budget")) if budget is None else every.agg(F.lit(float(budget)).alias("budget"))
    at = total
    for depth, level in enumerate(("domain", "lang", "source")):
        parent, own = _LEAF[:depth], _LEAF[depth]
        nodes = leaves.groupBy(*parent, own).agg(cap.alias("cap")).withColumn("w", _weight(level, weights))
        given = nodes.join(at, parent) if parent else nodes.crossJoin(F.broadcast(at))
        at = _share_out(given, parent, own).select(*parent, own, F.col("got").alias("budget"))
    got = F.coalesce("budget", F.lit(0.0))
    return every.join(at, _LEAF, "left").withColumn("take", F.floor(got + F.lit(1e-6)).cast("long")).drop("budget")


def beside(rows: DataFrame, leaves: DataFrame, how_many: int, size: str = "docs") -> DataFrame:
    """``rows`` with what ``leaves`` tells of their leaf.

    Leaves are broadcast if they are few; of more than that, those with many rows are, and the rows of the others are shuffled.

    :param leaves: a row for each leaf, with its number of rows as ``size``; ``how_many``: the number of all rows.
    """
    if leaves.count() <= common.BROADCAST_ROWS:
        return rows.join(F.broadcast(leaves), _LEAF)
    return met(rows, leaves, _LEAF, size, max(1, how_many))


def _order(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def plan(docs: DataFrame, weights: dict = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: int = SEED, slice_rows: int = SLICE_ROWS, budget: int | None = None) -> DataFrame:
    """How each leaf is taken: ``_domain, _lang, _source, docs, _whole, _cut``: its rows, whole epochs, and the last order key of the next
    epoch that still fits (null: none).

    A prefix sum over a leaf that may hold a third of all rows is made in steps: tokens of slices of the order, their
    running sum, and a sort of the single slice in which the prefix ends.
    """
    sized = written(with_leaf(docs.select("doc_id", "lang", "source", "text")).select("doc_id", *_LEAF, _n_tokens().alias("n")), "sizes")
    leaves = sized.groupBy(*_LEAF).agg(F.sum("n").alias("tokens"), F.count("*").alias("docs"))
    taken = budgets(leaves, weights, share, epochs, budget).select(
        *_LEAF, "docs", "tokens", F.when(F.col("tokens") > 0, F.floor(F.col("take") / F.col("tokens"))).otherwise(F.lit(0)).cast("long").alias("_whole"),
        F.when(F.col("tokens") > 0, F.col("take") % F.col("tokens")).otherwise(F.lit(0)).alias("rest"),
    )
    taken = written(taken, "budgets")
    most, rows = taken.agg(F.max("docs"), F.sum("docs")).first()
    most = most or 1
    digits = max(1, math.ceil(math.log(max(most / slice_rows, 1.001), 16)))
    keyed = beside(sized, taken.drop("tokens"), rows or 0).select(*_LEAF, "n", "rest", "_whole", _order(seed, F.col("_whole"), F.col("doc_id")).alias("key"))
    keyed = keyed.withColumn("slice", F.substring("key", 1, digits))
    sums = keyed.groupBy(*_LEAF, "slice", "rest").agg(F.sum("n").alias("n"))
    running = F.sum("n").over(Window.partitionBy(*_LEAF).orderBy("slice"))
    ends = sums.select(*_LEAF, "slice", "rest", (running - F.col("n")).alias("before"), running.alias("upto"))
    ends = ends.where("upto > rest").groupBy(*_LEAF).agg(F.min_by(F.struct("slice", "before"), "slice").alias("end")).select(*_LEAF, "end.slice", "end.before")
    last = keyed.join(ends, [*_LEAF, "slice"])
    inside = F.col("before") + F.sum("n").over(Window.partitionBy(*_LEAF, "slice").orderBy("key").rangeBetween(Window.unboundedPreceding, 0))
    cut = last.select(*_LEAF, "rest", "key", inside.alias("upto")).where("upto <= rest").groupBy(*_LEAF).agg(F.max("key").alias("cut"))
    # where not even the first of the slice fits, all slices before it are taken
    whole = taken.join(ends, _LEAF, "left").join(cut, _LEAF, "left")
    return whole.select(*_LEAF, "docs", "_whole", F.when(F.col("slice").isNull(), F.lit("g")).otherwise(F.coalesce("cut", "slice")).alias("_cut"))


def mixed(docs: DataFrame, weights: dict = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: int = SEED, budget: int | None = None) -> DataFrame:
    """The documents that are taken, with all their columns, their ``_domain`` and ``_copies``, the epochs they are in.

    Whether a row is taken depends on it and its leaf's plan alone, so texts are not shuffled, unless there are more leaves than are
    broadcast; then those of small leaves are. A null language or source
    is one of its own; a null or empty text has no tokens and is taken if its place in the order is. Repeated rows of
    one id share their place: all are taken or none. An empty table gives no rows.
    """
    how = written(plan(docs, weights, share, epochs, seed, budget=budget), "mix")
    rows = how.agg(F.sum("docs")).first()[0] or 0
    how = how.withColumnRenamed("docs", "_docs")
    placed = beside(with_leaf(docs), how, rows, "_docs").withColumn("_copies", (F.col("_whole") + (_order(seed, F.col("_whole"), F.col("doc_id")) <= F.col("_cut")).cast("long")))
    return placed.where("_copies > 0").select(*docs.columns, "_domain", "_copies")


def query(spark, sf_dir: str) -> DataFrame:
    found = mixed(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("_domain").alias("domain"), "lang", "source", _n_tokens().alias("n_tokens"), F.col("_copies").alias("copies"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A taken document stands once for each epoch that it is in."""
    found = mixed(docs).withColumn("_copies", F.explode(F.array_repeat(F.lit(1), F.col("_copies").cast("int"))))
    return found.select(docs.columns)


def _sql() -> str:
    def case(level: str) -> str:
        own = WEIGHTS[level]
        return "case " + " ".join(f"when {level} = '{k}' then {v}" for k, v in own.items() if k) + f" else {own['']} end" if len(own) > 1 else str(own[""])

    steps, at = [], f"(select floor(sum(tokens) * {SHARE})::double as budget from leaves)"
    for depth, level in enumerate(("domain", "lang", "source")):
        parent = ["domain", "lang", "source"][:depth]
        keys = ", ".join([*parent, level])
        by = f"partition by {', '.join(parent)}" if parent else ""
        using = f"join {at} using ({', '.join(parent)})" if parent else f"cross join {at}"
        steps.append(f"""n{depth} as (select *, (budget - coalesce(sum(cap) over ({by} order by cap / w, {level} rows between unbounded preceding and 1 preceding), 0))
    / sum(w) over ({by} order by cap / w, {level} rows between current row and unbounded following) as f
  from (select {keys}, sum(tokens) * {EPOCHS} as cap, {case(level)}::double as w from leaves group by {keys}) {using}),
g{depth} as (select {keys}, least(cap::double, w * max(f) over ({by})) as budget from n{depth})""")
        at = f"g{depth}"
    return f"""
with d as (
  select doc_id, lang as l, source as s, coalesce(lang, '') as lang, coalesce(source, '') as source, substr(md5(coalesce(source, '')), 1, 1) as x,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as n
  from documents),
t as (select *, case when x < '4' then 'books' when x < '8' then 'code' when x < 'c' then 'news' else 'web' end as domain from d),
leaves as (select domain, lang, source, sum(n) as tokens from t group by all),
{', '.join(steps)},
p as (select domain, lang, source, case when tokens > 0 then floor(floor(budget + 1e-6) / tokens)::bigint else 0 end as whole,
    case when tokens > 0 then floor(budget + 1e-6)::bigint % tokens else 0 end as rest from leaves join g2 using (domain, lang, source)),
k as (select t.*, whole, rest, md5(concat_ws(':', '{SEED}', whole::varchar, coalesce(doc_id::varchar, ''))) as key from t join p using (domain, lang, source)),
c as (select *, whole + (sum(n) over (partition by domain, lang, source order by key) <= rest)::bigint as copies from k)
select doc_id, domain, l as lang, s as source, n as n_tokens, copies from c where copies > 0
"""


SQL = _sql()
