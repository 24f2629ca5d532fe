"""Matches of a pattern with their places, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Matches that are placed one after another; the runs of so many are placed among themselves first.
RUN = 128


def let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def matches(text: Column, pattern: str, context: bool = False, words: bool = False) -> Column:
    """Leftmost non-overlapping matches: ``array<struct<start, end, value>>``, in code points, end exclusive.

    The pieces between the matches and the matches themselves add up to the places. Sums are made in runs, so that a text
    costs about its length and its number of matches. With ``context``, each match also has ``left`` and ``right``: the text
    beside it, up to the matches next to it. With ``words``, each has ``first`` and ``last``: the numbers of the runs of
    white space before its start and before its end, for matches that neither begin nor end with white space.

    :param pattern: a Java pattern that never matches the empty string; its loops over groups should be possessive,
        for those run in constant stack.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def zip_up(pieces: Column) -> Column:
        rest = F.greatest(F.size(pieces) - 1, F.lit(0))
        out = F.zip_with(found, F.slice(pieces, F.lit(1), rest), lambda m, p: F.struct(m.alias("m"), p.alias("p")))
        if context:
            out = F.zip_with(out, F.slice(pieces, F.lit(2), rest), lambda x, q: F.struct(x["m"].alias("m"), x["p"].alias("p"), q.alias("q")))
        return out

    kind = "start:int,end:int,value:string" + (",left:string,right:string" if context else "") + (",first:int,last:int" if words else "")

    def gaps(x: Column) -> Column:
        return F.regexp_count(x, F.lit(r"\s+"))

    def size(held: Column, x: Column) -> Column:
        out = [(held["at"] + F.length(x["p"]) + F.length(x["m"])).alias("at")]
        if words:
            out.append((held["gap"] + gaps(x["p"]) + gaps(x["m"])).alias("gap"))
        return F.struct(*out)

    zero = F.struct(F.lit(0).alias("at"), *([F.lit(0).alias("gap")] if words else []))

    def cut(zipped: Column) -> Column:
        return F.when(F.size(zipped) > 0, F.transform(F.sequence(F.lit(1), F.size(zipped), F.lit(RUN)), lambda i: F.slice(zipped, i, RUN)))

    def summed(a: Column, b: Column) -> Column:
        return F.struct(*[(a[n] + b[n]).alias(n) for n in (("at", "gap") if words else ("at",))])

    def starts(runs: Column) -> Column:
        """Where each run starts: the sums of the runs before it."""
        return F.aggregate(F.transform(runs, lambda r: F.aggregate(r, zero, size)), F.array(zero), lambda held, s: F.concat(held, F.array(summed(F.element_at(held, -1), s))))

    def add(held: Column, x: Column) -> Column:
        start = held["now"]["at"] + F.length(x["p"])
        fields = [start.alias("start"), (start + F.length(x["m"])).alias("end"), x["m"].alias("value")]
        if context:
            fields += [x["p"].alias("left"), x["q"].alias("right")]
        if words:
            first = held["now"]["gap"] + gaps(x["p"])
            fields += [first.alias("first"), (first + gaps(x["m"])).alias("last")]
        return F.struct(size(held["now"], x).alias("now"), F.concat(held["out"], F.array(F.struct(*fields))).alias("out"))

    empty = F.from_json(F.lit("[]"), "array<struct<" + kind + ">>")

    def place(runs: Column) -> Column:
        return F.zip_with(runs, F.slice(starts(runs), F.lit(1), F.size(runs)), lambda r, s: F.aggregate(r, F.struct(s.alias("now"), empty.alias("out")), add, lambda held: held["out"]))

    zipped = let(F.split(text, pattern, -1), zip_up)
    return F.coalesce(F.flatten(let(let(zipped, cut), place)), empty)
