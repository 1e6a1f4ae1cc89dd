"""The operators of a traced plan, their edge tables, and end-to-end lineage composed from these.

Every `Traced` operator records how its rows come from those of its inputs. Rows are
named by as few ids as name them: a join with a side that is unique on the join
columns has the ids of its other side only. An equi join has two edge tables, tied by
an address (the values of its join columns):

    build   address <- row of the right side     one row for each right row
    probe   row of the left side <- address      one row for each left row

so a join of n and m rows has n + m edges, however many pairs a hot key makes, and
writing them down runs no join. `expand` follows them from chosen rows downwards: the
rows asked for restrict the probe edges, their addresses the build edges (as semi joins,
which the optimizer moves below the joins that made the inputs).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowtrace.operators.attach import left_join, matching, measure, sized
from rowtrace.session import cut

On = tuple[tuple[str, str], ...]


@dataclass(frozen=True)
class Op:
    """One operator.

    frame   its rows, with the ids in `key` and the columns that later joins need
    key     ids that name a row
    rids    ids of all base rows below
    on      equi join: equal columns of the two inputs
    unique  sets of columns on which no two rows are equal
    prefix  put before the ids of the input (a further occurrence)
    """

    kind: str
    frame: DataFrame
    key: tuple[str, ...]
    rids: tuple[str, ...]
    inputs: tuple[Op, ...] = ()
    on: On = ()
    unique: frozenset[frozenset[str]] = field(default=frozenset())
    prefix: str = ""

    def at(self, frame: DataFrame) -> Op:
        """The same rows after a projection."""
        return replace(self, frame=frame)

    def narrowed(self, frame: DataFrame) -> Op:
        return Op("filter", frame, self.key, self.rids, (self,), unique=self.unique)

    def renamed(self, frame: DataFrame, prefix: str) -> Op:
        """Ids get a prefix; other columns keep their names."""
        return Op(
            "rename", frame, tuple(prefix + r for r in self.key), tuple(prefix + r for r in self.rids), (self,), unique=self.unique, prefix=prefix
        )

    def joined(self, other: Op, frame: DataFrame, on: Sequence[tuple[str, str]], outer: bool = False) -> Op:
        """Equi join; the right side is the build side."""
        right_unique = any(columns <= {r for _, r in on} for columns in other.unique)
        key = self.key if right_unique else self.key + other.key
        kind = "left_join" if outer else "join"
        return Op(kind, frame, key, self.rids + other.rids, (self, other), tuple(on), self.unique if right_unique else frozenset())

    def paired(self, other: Op, frame: DataFrame, kind: str) -> Op:
        """Any other join: a row is named by its two rows."""
        return Op(kind, frame, self.key + other.key, self.rids + other.rids, (self, other))

    # -- edge tables ----------------------------------------------------------------

    def probe(self) -> DataFrame:
        """Rows of the left side and their addresses `_a0`, `_a1`, ..."""
        left = self.inputs[0]
        return left.frame.select(*left.key, *[F.col(c).alias(f"_a{i}") for i, (c, _) in enumerate(self.on)])

    def build(self) -> DataFrame:
        """Addresses and the rows of the right side."""
        right = self.inputs[1]
        return right.frame.select(*[F.col(c).alias(f"_a{i}") for i, (_, c) in enumerate(self.on)], *right.key)

    def edges(self) -> DataFrame:
        """(side, out_id, in_id), ids as text; the address of a join is between its two sides."""

        def table(side: str, frame: DataFrame, out: Sequence[str], into: Sequence[str]) -> DataFrame:
            return frame.select(F.lit(side).alias("side"), as_text(out).alias("out_id"), as_text(into).alias("in_id"))

        address = [f"_a{i}" for i in range(len(self.on))]
        if self.on:
            left, right = self.inputs
            build = table("build", self.build(), address, right.key)
            return build.unionByName(table("probe", self.probe(), left.key, address))
        if len(self.inputs) == 2:
            left, right = self.inputs
            return table("lhs", self.frame, self.key, left.key).unionByName(table("rhs", self.frame, self.key, right.key))
        below = tuple(k.removeprefix(self.prefix) for k in self.key)
        if self.kind == "rename":
            pairs = self.inputs[0].frame.select(*[F.col(b).alias(k) for b, k in zip(below, self.key, strict=True)])
            return table("in", pairs, self.key, self.key)
        return table("in", self.frame, self.key, self.key)

    def walk(self) -> Iterator[Op]:
        """All operators below and this one, inputs first."""
        for below in self.inputs:
            yield from below.walk()
        yield self

    # -- composition ------------------------------------------------------------------

    def anchor(self, columns: Sequence[str]) -> Op:
        """The operator furthest down the left sides whose rows already have `columns`: all rows that later joins make
        of one of them agree in these."""
        if self.on and set(columns) <= set(self.inputs[0].frame.columns):
            return self.inputs[0].anchor(columns)
        return self

    def expand(self, rows: DataFrame, few: bool = False, prefix: str = "") -> DataFrame:
        """`rows` name rows of this operator, or of an anchor below it; all ids of base rows are added.

        `few`: the rows are a selection. They are written down between joins, and restrict the edges of the next one.
        """
        if not self.inputs:
            return rows
        if self.kind in ("filter", "rename"):
            return self.inputs[0].expand(rows, few, prefix + self.prefix)
        left, right = self.inputs
        rows = left.expand(rows, few, prefix)
        if self.on and not {prefix + k for k in right.key} <= set(rows.columns):
            rows = self._follow(rows, few, prefix)
        return right.expand(rows, few, prefix)

    def _follow(self, rows: DataFrame, few: bool, prefix: str) -> DataFrame:
        """Left rows -> addresses -> right rows."""
        left, right = self.inputs
        address = [f"_a{i}" for i in range(len(self.on))]
        probe, build = self.probe(), self.build()
        if few:
            chosen = measure(rows)
            rows = chosen.frame
            asked = rows.select(*[F.col(prefix + k).alias(f"_w_{k}") for k in left.key]).distinct()
            here = matching([F.col(k) for k in left.key], [F.col(f"_w_{k}") for k in left.key])
            probe = probe.join(sized(asked, bound=chosen.rows), here, "left_semi")
            probe = cut(probe)
            found = probe.select(*[F.col(a).alias(f"_w{a}") for a in address]).dropna().distinct()
            # no more addresses than probe rows, and of these no more than rows asked for
            build = build.join(sized(found, bound=chosen.rows), _equal(address, [f"_w{a}" for a in address]), "left_semi")
        probe = probe.select(*[F.col(k).alias(f"_p_{k}") for k in left.key], *[F.col(a).alias(f"_p{a}") for a in address])
        build = build.select(*[F.col(a).alias(f"_b{a}") for a in address], *[F.col(k).alias(prefix + k) for k in right.key])
        tied = rows.join(probe, matching([F.col(prefix + k) for k in left.key], [F.col(f"_p_{k}") for k in left.key]))
        on = [(f"_p{a}", f"_b{a}") for a in address]
        whole = left_join(tied, build, on) if self.kind == "left_join" else tied.join(build, _equal(*zip(*on, strict=True)))
        return whole.select(*rows.columns, *[prefix + k for k in right.key])


def _equal(left: Sequence[str], right: Sequence[str]) -> Column:
    condition = F.lit(True)
    for a, b in zip(left, right, strict=True):
        condition = condition & (F.col(a) == F.col(b))
    return condition


def as_text(columns: Sequence[str]) -> Column:
    """Values as one text, parted by `|`; a missing one is empty."""
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
