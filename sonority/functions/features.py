"""Feature tables: segments by features, each state one of ``+ - 0``."""

from __future__ import annotations

import csv
import io
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# What reads as plus and as minus; everything else is zero.
PLUS, MINUS = frozenset("+✓√"), frozenset("-−")


@dataclass(frozen=True)
class FeatureTable:
    """``states[f][s]`` is the state of feature ``f`` in segment ``s``; segment ids start at 1, feature ids at 0."""

    segments: tuple[str, ...]
    features: tuple[str, ...]
    states: tuple[tuple[str, ...], ...]

    @classmethod
    def parse(cls, text: str, read: Callable[[str], str] = str) -> FeatureTable:
        """Read CSV with a header of segments, which ``read`` makes of its cells, and a feature in each row.

        Blanks before a cell don't count, blanks after it do. Rows of another width than the header's are dropped.
        A table without segments or features, or with a segment twice, is refused.
        """
        rows = [[cell.lstrip(" \t") for cell in row] for row in csv.reader(io.StringIO(text))]
        if not rows or len(rows[0]) < 2:
            raise ValueError("the table has no segments")
        segments = tuple(map(read, rows[0][1:]))
        if len(set(segments)) < len(segments):
            raise ValueError("a segment stands twice in the header")
        body = [r for r in rows[1:] if len(r) == len(rows[0])]
        if not body:
            raise ValueError("the table has no features")
        return cls(segments, tuple(r[0] for r in body), tuple(tuple("+" if c in PLUS and c else "-" if c in MINUS and c else "0" for c in r[1:]) for r in body))

    def csv(self) -> str:
        out = io.StringIO()
        rows = csv.writer(out, lineterminator="\n")
        rows.writerow(["", *self.segments])
        rows.writerows([f, *s] for f, s in zip(self.features, self.states))
        return out.getvalue()

    def known(self) -> dict[str, int]:
        """Feature ids by name; of equal names the last counts."""
        return {f: i for i, f in enumerate(self.features)}

    def resegmented(self, segments: list[str]) -> FeatureTable:
        """The same features over other segments; new ones have zero states, and a segment named twice counts once."""
        once, at = tuple(dict.fromkeys(segments)), {s: i for i, s in enumerate(self.segments)}
        return FeatureTable(once, self.features, tuple(tuple(row[at[s]] if s in at else "0" for s in once) for row in self.states))

    def mask(self, feature: str, state: str) -> int:
        """Bits of the segments with a state; bit ``i`` stands for segment id ``i + 1``."""
        row = self.states[self.known()[feature]]
        return sum(1 << i for i, s in enumerate(row) if s == state)

    def frame(self, spark: SparkSession) -> DataFrame:
        """``seg_id, seg, feat_id, feat, state``: a row for each cell."""
        rows = [(s + 1, seg, f, feat, self.states[f][s]) for f, feat in enumerate(self.features) for s, seg in enumerate(self.segments)]
        return spark.createDataFrame(rows, "seg_id int, seg string, feat_id int, feat string, state string").coalesce(1)

    def segment_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i + 1, s) for i, s in enumerate(self.segments)], "seg_id int, seg string").coalesce(1)


def wide(cells: DataFrame) -> DataFrame:
    """Rows of features with a column for each segment; the segments are read from the cells."""
    order = [r["seg"] for r in cells.select("seg_id", "seg").distinct().orderBy("seg_id").collect()]
    return cells.groupBy("feat_id", "feat").pivot("seg", order).agg(F.first("state"))


def resegmented(cells: DataFrame, segments: DataFrame) -> DataFrame:
    """Cells over the segments of another table ``seg``; those without cells have zero states."""
    features = cells.select("feat_id", "feat").distinct()
    wanted = segments.select("seg").distinct().crossJoin(F.broadcast(features))
    return wanted.join(cells.select("seg", "feat_id", "state"), ["seg", "feat_id"], "left").select("seg", "feat_id", "feat", F.coalesce("state", F.lit("0")).alias("state"))


_LATIN = """,a,e,i,o,u,y,á,à,é,è,ê,í,ó,ú,ä,ö,ü,p,b,m,f,v,w,t,d,n,s,z,l,r,c,k,g,q,j,h,x,ß,ç,ñ,sh,ch,th
syllabic,+,+,+,+,+,+,+,+,+,+,+,+,+,+,+,+,+,-,-,-,-,-,-,-,-,-,-,-,-,-,-,-,-,-,-,-,-,-,-,-,-,-,-
sonorant,+,+,+,+,+,+,+,+,+,+,+,+,+,+,+,+,+,-,-,+,-,-,+,-,-,+,-,-,+,+,-,-,-,-,+,-,-,-,-,+,-,-,-
continuant,+,+,+,+,+,+,+,+,+,+,+,+,+,+,+,+,+,-,-,-,+,+,+,-,-,-,+,+,+,+,-,-,-,-,+,+,+,+,+,-,+,-,+
voice,+,+,+,+,+,+,+,+,+,+,+,+,+,+,+,+,+,-,+,+,-,+,+,-,+,+,-,+,+,+,-,-,+,-,+,-,-,-,-,+,-,-,-
nasal,-,-,-,-,-,-,-,-,-,-,-,-,-,-,-,-,-,-,-,+,-,-,-,-,-,+,-,-,-,-,-,-,-,-,-,-,-,-,-,+,-,-,-
labial,0,0,0,0,0,0,0,0,0,0,0,0,0,0,0,0,0,+,+,+,+,+,+,-,-,-,-,-,-,-,-,-,-,-,-,-,-,-,-,-,-,-,-
coronal,0,0,0,0,0,0,0,0,0,0,0,0,0,0,0,0,0,-,-,-,-,-,-,+,+,+,+,+,+,+,-,-,-,-,-,-,-,+,+,+,+,+,+
dorsal,0,0,0,0,0,0,0,0,0,0,0,0,0,0,0,0,0,-,-,-,-,-,-,-,-,-,-,-,-,-,+,+,+,+,+,-,+,-,-,-,-,-,-
high,-,-,+,-,+,+,-,-,-,-,-,+,-,+,-,-,+,0,0,0,0,0,+,0,0,0,0,0,0,0,0,+,+,0,+,0,0,0,0,0,0,0,0
front,-,+,+,-,-,+,-,-,+,+,+,+,-,-,+,+,+,0,0,0,0,0,0,0,0,0,0,0,0,0,0,0,0,0,0,0,0,0,0,0,0,0,0
round,-,-,-,+,+,-,-,-,-,-,-,-,+,+,-,+,+,0,0,0,0,0,+,0,0,0,0,0,0,0,0,0,0,0,0,0,0,0,0,0,0,0,0
"""

#: Our own table for the Latin letters of English, German, French and Spanish, and three digraphs.
LATIN = FeatureTable.parse(_LATIN)
