"""Relations that remember the base rows they were made from."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowtrace.functions.exact import Aggregate, aggregate
from rowtrace.operators.attach import Branch, any_of, attach, inequality_join, join_values, known_keys_join, left_join, matching, measure, ordinal, over_groups, sized
from rowtrace.operators.graph import Op, as_text
from rowtrace.session import DEFAULT_LIMITS, Limits, keep
from rowtrace.sources.tables import key_columns

On = Sequence[tuple[str, str]]


def _pairs(on: On) -> Column:
    condition = F.lit(True)
    for left, right in on:
        condition = condition & (F.col(left) == F.col(right))
    return condition


@dataclass(frozen=True)
class Sub:
    """Rows of a subquery that the outer rows depend on.

    `link` names columns found in both the outer rows and `frame`; an outer row
    depends on the sub rows with equal link values (no link: on all of them).
    `single` says that at most one outer row has a given link value, so that the
    joined form is no larger than `frame`. `outer` are the rows of which the existence
    test left `made`: joined to `frame`, they give the same rows as `made` does.
    """

    name: str
    frame: DataFrame
    rids: tuple[str, ...]
    link: tuple[str, ...] = ()
    single: bool = False
    op: Op | None = None
    outer: DataFrame | None = None
    made: DataFrame | None = None


@dataclass(frozen=True)
class Traced:
    """A relation with one id column per base-table occurrence.

    Every operator keeps the id columns and records itself in `op` (None where the
    rows were made some other way). Existence tests filter like semi and anti joins;
    what they looked at is kept aside in `subs`.
    """

    df: DataFrame
    rids: tuple[str, ...]
    subs: tuple[Sub, ...] = ()
    op: Op | None = None

    @staticmethod
    def scan(df: DataFrame) -> Traced:
        rids = tuple(c for c in df.columns if c.endswith("_rid"))
        unique = frozenset(frozenset(columns) for r in rids if (columns := key_columns(r)))
        return Traced(df, rids, op=Op("scan", df, rids, rids, unique=unique))

    def where(self, *conditions: Column) -> Traced:
        return self.narrowed(self.df.filter(reduce(Column.__and__, conditions)))

    def narrowed(self, df: DataFrame) -> Traced:
        """Some of the rows, perhaps with further columns."""
        return replace(self, df=df, op=self.op and self.op.at(self.df).narrowed(df))

    def _paired(self, other: Traced, df: DataFrame, kind: str) -> Op | None:
        return self.op.at(self.df).paired(other.op.at(other.df), df, kind) if self.op and other.op else None

    def select(self, *columns: Column | str) -> Traced:
        return replace(self, df=self.df.select(*columns, *self.rids))

    def join(self, other: Traced, on: On | Column, how: str = "inner") -> Traced:
        """Equi or theta join; with how="left" the right ids are null where unmatched."""
        if how == "left" and not isinstance(on, Column):
            joined = left_join(self.df, other.df, list(on))
        else:
            joined = self.df.join(other.df, on if isinstance(on, Column) else _pairs(on), how)
        if isinstance(on, Column):
            op = self._paired(other, joined, "theta_join" if how == "inner" else "outer_join")
        else:
            op = self.op and other.op and self.op.at(self.df).joined(other.op.at(other.df), joined, on, how == "left")
        return Traced(joined, self.rids + other.rids, self.subs + other.subs, op)

    def product(self, other: Traced) -> Traced:
        """Every pair of rows; the smaller side is broadcast if it was measured to be small."""
        pairs = self.df.join(sized(other.df), how="cross")
        return Traced(pairs, self.rids + other.rids, self.subs + other.subs, self._paired(other, pairs, "product"))

    def join_below(self, other: Traced, low: str, high: str, or_equal: bool = False) -> Traced:
        """Theta join on self.low < other.high (or <=)."""
        joined = inequality_join(self.df, other.df, low, high, or_equal)
        return Traced(joined, self.rids + other.rids, self.subs + other.subs, self._paired(other, joined, "theta_join"))

    def join_any(self, other: Traced, *branches: Branch) -> Traced:
        """Theta join on a disjunction of equalities and ranges."""
        joined = any_of(self.df, other.df, branches)
        return Traced(joined, self.rids + other.rids, self.subs + other.subs, self._paired(other, joined, "theta_join"))

    def union(self, other: Traced) -> Traced:
        """UNION ALL; an id column of only one side is null in the rows of the other."""
        frame = self.df.unionByName(other.df, allowMissingColumns=True)
        more = tuple(r for r in other.rids if r not in self.rids)
        return Traced(frame, self.rids + more, self.subs + other.subs)

    def exists(self, inner: Traced, on: On, name: str = "sub", single: bool = False) -> Traced:
        """EXISTS / IN: each outer row also depends on every inner row it matches."""
        df = known_keys_join(self.df, inner.df, on, "left_semi")
        renamed = inner.df.select(*[F.col(r).alias(l) for l, r in on], *inner.rids)
        sub = Sub(name, renamed, inner.rids, tuple(l for l, _ in on), single, inner.op, self.df, df)
        return replace(self.narrowed(df), subs=self.subs + (sub,) + inner.subs)

    def not_exists(self, inner: DataFrame, on: On) -> Traced:
        """NOT EXISTS: what is absent adds no dependency."""
        return self.narrowed(known_keys_join(self.df, inner, on, "left_anti"))

    def exists_only(self, inner: DataFrame, on: On, rare: bool = False) -> Traced:
        """Keeps the rows that have a partner, as a filter that adds no dependency; `rare`: few are likely to have one."""
        return self.narrowed(known_keys_join(self.df, inner, on, "left_semi", rare))

    def not_in(self, column: str, inner: Traced, value: str, name: str = "sub", capture: str = "all") -> Traced:
        """NOT IN: depends on the whole inner result (capture="all") or on nothing ("none").

        SQL's three-valued rule: one null among the inner values, or a null on
        the left with a non-empty inner side, rejects the row.
        """
        values = inner.df.select(F.col(value).alias("_value"))
        facts = values.agg(
            F.count(F.lit(1)).alias("n"), F.count("_value").alias("known")
        ).select(F.struct("n", "known").alias("facts"))
        df = known_keys_join(self.df, values, [(column, "_value")], "left_anti")
        df = df.withColumn("_facts", facts.scalar())
        df = df.filter(
            (F.col("_facts.n") == 0) | (F.col(column).isNotNull() & (F.col("_facts.n") == F.col("_facts.known")))
        ).drop("_facts")
        subs = self.subs
        if capture == "all":
            subs += (Sub(name, inner.df.select(*inner.rids), inner.rids, op=inner.op),)
        return replace(self.narrowed(df), subs=subs)

    def depends_on(self, inner: Traced, link: Sequence[str] = (), name: str = "sub", single: bool = False) -> Traced:
        """Adds the rows behind a scalar subquery (correlated through `link`, or not at all)."""
        sub = Sub(name, inner.df.select(*link, *inner.rids), inner.rids, tuple(link), single, inner.op)
        return replace(self, subs=self.subs + (sub,))

    def prefixed(self, prefix: str) -> Traced:
        """The same rows as a further occurrence: id columns get a prefix."""
        renamed = {r: prefix + r for r in self.rids}
        df = self.df.withColumnsRenamed(renamed)
        return replace(self, df=df, rids=tuple(renamed.values()), op=self.op and self.op.at(self.df).renamed(df, prefix))

    def distinct(self, columns: Sequence[str]) -> DataFrame:
        """Distinct values of the data columns, without ids."""
        return self.df.select(*columns).distinct()

    def traced_distinct(self, columns: Sequence[str]) -> Lineage:
        """DISTINCT with its lineage: a group-by on all columns, whose rows depend on every row with their values."""
        order = tuple(F.col(x) for x in columns)
        return Lineage(core=self, keys=tuple(columns), aggregates={"_rows": F.count(F.lit(1))}, outputs=tuple(columns), order=order)

    def measured(self) -> Traced:
        """The same rows written down and counted: joins broadcast them if they were found to be small.

        For the small side of a join whose size cannot be told beforehand, such as a join of small tables: the other
        side is then not shuffled for it.
        """
        return replace(self, df=sized(self.df))

    def kept(self, reuse: bool = True) -> Traced:
        """Persisted if a result and its lineage are both going to read it."""
        return replace(self, df=keep(self.df)) if reuse else self


@dataclass(frozen=True)
class Level:
    """An inner group-by of the core rows; `groups` holds its result where that is cheaper to get elsewhere."""

    keys: tuple[str, ...]
    aggregates: dict[str, Aggregate]
    groups: DataFrame | None = None


@dataclass(frozen=True)
class Lineage:
    """A query: its result, and for every output row the base rows behind it.

    core        the rows below the first aggregate, with ids
    keys        group keys; empty with aggregates for a single-row result
    aggregates  name -> aggregate over core
    finish      output name -> expression over keys and aggregates
    having      filter over keys and aggregates
    base        ready-made result relation, where it is cheaper than core's own
    base_rids   ids found in `base`, one per output row
    base_rows   row count of `base`, where it was counted
    levels      inner group-bys, whose values are group keys further out, or are compared with the rows
    only        filter over core columns and values of the levels
    over        window form of a ready-made `base`: aggregates over the groups, and `over_only`, a filter on them
    order       total order of the outputs, and `limit` on it
    """

    core: Traced
    outputs: tuple[str, ...]
    order: tuple[Column, ...]
    keys: tuple[str, ...] = ()
    aggregates: dict[str, Aggregate] = field(default_factory=dict)
    finish: dict[str, Column] = field(default_factory=dict)
    having: Column | None = None
    base: DataFrame | None = None
    base_rids: tuple[str, ...] = ()
    base_rows: int | None = None
    levels: tuple[Level, ...] = ()
    only: Column | None = None
    over: dict[str, Aggregate] = field(default_factory=dict)
    over_only: Column | None = None
    limit: int | None = None
    limits: Limits = DEFAULT_LIMITS

    # -- result ---------------------------------------------------------------

    def _finished(self, frame: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
        if self.having is not None:
            frame = frame.filter(self.having)
        columns = [self.finish[c].alias(c) if c in self.finish else F.col(c) for c in self.outputs]
        return frame.select(*columns, *[c for c in extra if c not in self.outputs])

    @property
    def grouped(self) -> bool:
        return bool(self.aggregates) or self.base is not None

    def _base(self, extra: Sequence[str] = ()) -> DataFrame:
        """Unordered outputs, before the limit."""
        if self.base is not None:
            return self.base.select(*self.outputs, *[c for c in extra if c not in self.outputs])
        if not self.aggregates:
            return self._finished(self._levelled("join"), extra)
        named = [aggregate(part).alias(name) for name, part in self.aggregates.items()]
        return self._finished(self._levelled("join").groupBy(*self.keys).agg(*named), extra)

    def result(self) -> DataFrame:
        """The plain query answer; id columns are pruned from its plan."""
        if self.grouped and not self.keys:
            return self._base()
        frame = self._base().orderBy(*self.order)
        return frame.limit(self.limit) if self.limit is not None else frame

    def _top(self) -> DataFrame:
        frame = self._base([*self.keys, *self.base_rids])
        if self.limit is not None:
            frame = frame.orderBy(*self.order).limit(self.limit)
        return frame

    def pinned(self) -> Lineage:
        """The same query with its outputs computed once, written down and counted.

        For questions that read the outputs several times.
        """
        if not (self.grouped and self.keys) or self.base_rows is not None:
            return self
        top = measure(self._top())
        return replace(self, base=top.frame, base_rows=top.rows, aggregates={}, finish={}, having=None)

    def answered(self, other: Lineage) -> Lineage:
        """This query with the outputs that `other`, the same query over the same rows, has written down."""
        if other.base_rows is None or self.base_rids:
            return self.pinned()
        return replace(self, base=other.base, base_rows=other.base_rows, aggregates={}, finish={}, having=None)

    def _bound(self) -> int | None:
        return self.limit if self.base_rows is None else self.base_rows

    # -- lineage --------------------------------------------------------------

    def links(self) -> list[str]:
        """Columns that tie main rows to sub rows."""
        names = [c for sub in self.core.subs if not sub.single for c in sub.link]
        return list(dict.fromkeys(names))

    def _levelled(self, strategy: str) -> DataFrame:
        """Core rows with the values of the inner group-bys they belong to."""
        rows = self.core.df
        for level in self.levels:
            if strategy == "window":
                rows = over_groups(rows, list(level.keys), level.aggregates, self.limits)
            else:
                named = [aggregate(part).alias(name) for name, part in level.aggregates.items()]
                groups = rows.groupBy(*level.keys).agg(*named) if level.groups is None else level.groups
                rows = join_values(rows, groups, list(level.keys))
        return rows if self.only is None else rows.filter(self.only)

    def main(self, strategy: str = "join", indexed: bool = False) -> DataFrame:
        """One row per output row and core row: outputs (or their index), links, ids.

        strategy="window" attaches group values to the rows, "join" joins the
        finished groups back; both give the same rows.
        """
        if strategy not in ("join", "window"):
            raise ValueError(f"unknown strategy {strategy!r}")
        singles = [sub for sub in self.core.subs if sub.single]
        links = self.links()
        carried = list(dict.fromkeys([*links, *[c for sub in singles for c in sub.link]]))
        rows = self._levelled(strategy)
        if len(singles) == 1 and singles[0].made is self.core.df and not self.levels and strategy == "join" and self.grouped:
            rows = singles[0].outer  # the join with the sub rows, further down, is the existence test as well
        if not self.grouped:
            rows = self._finished(rows, [*carried, *self.core.rids])
            if self.limit is not None:
                rows = rows.orderBy(*self.order).limit(self.limit)
            if indexed:
                rows = ordinal(rows, list(self.order), limits=self.limits, bound=self.limit)
        elif strategy == "window" and self.aggregates and self.limit is None and not indexed:
            rows = over_groups(rows, list(self.keys), self.aggregates, self.limits)
            rows = self._finished(rows, [*carried, *self.core.rids])
        else:
            top = self._top()
            if indexed and self.keys:
                top = ordinal(top, list(self.order), limits=self.limits, bound=self._bound())
            elif indexed:
                top = top.select(F.lit(0).cast("long").alias("out_index"), "*")
            if strategy == "window" and self.over:
                rows = over_groups(rows, list(self.keys), self.over, self.limits).filter(self.over_only)
            own = dict.fromkeys([*self.keys, *carried, *self.core.rids])
            rows = attach(rows.select(*own), top, list(self.keys), self.limits, self._bound())
        head = ["out_index"] if indexed else list(self.outputs)
        rids = [*self.base_rids, *self.core.rids]
        for sub in singles:
            rows = self._expand(rows, sub)
            rids += sub.rids
        return rows.select(*head, *[c for c in links if c not in head], *rids)

    @staticmethod
    def _expand(rows: DataFrame, sub: Sub) -> DataFrame:
        renamed = sub.frame.select(*[F.col(c).alias(f"_l_{c}") for c in sub.link], *sub.rids)
        condition = _pairs([(c, f"_l_{c}") for c in sub.link])
        return rows.join(renamed, condition).drop(*[f"_l_{c}" for c in sub.link])

    def branches(self, main: DataFrame) -> list[tuple[Sub, DataFrame]]:
        """Sub rows that some main row depends on, one relation per subquery."""
        found = []
        for sub in self.core.subs:
            if sub.single:
                continue
            frame = sub.frame
            if sub.link:
                frame = known_keys_join(frame, main, [(c, c) for c in sub.link], "left_semi")
            found.append((sub, frame.select(*sub.link, *sub.rids)))
        return found

    def frame(self, strategy: str = "join", indexed: bool = False) -> DataFrame:
        """Whole lineage. With subqueries it is factorised.

        Main rows (`branch` = "main") and sub rows are stored once each and meet
        on the link columns, so its size is the sum of the branches where the
        joined form would be their product.
        """
        source = self.pinned() if indexed else self
        main = source.main(strategy, indexed)
        branches = self.branches(main)
        if not branches:
            return main
        whole = main.select(F.lit("main").alias("branch"), "*")
        for sub, rows in branches:
            whole = whole.unionByName(
                rows.select(F.lit(sub.name).alias("branch"), "*"), allowMissingColumns=True
            )
        return whole

    def composed(self) -> DataFrame:
        """As `frame(indexed=True)`, put together from the edge tables of the operators.

        Outputs lead to the ids of the rows of their groups, those to the rows of both
        sides of the last join by its address edges, and so on down to the scans. Plans
        with a step that recorded no operator are captured as a whole.
        """
        whole, subs = self.core, self.core.subs
        if whole.op is None or any(sub.op is None for sub in subs):
            return self.frame(indexed=True)
        made = {name for level in self.levels for name in level.aggregates}
        links = [c for sub in subs for c in sub.link]
        needed = {*self.keys, *links, *[k for level in self.levels for k in level.keys]} - made
        top = whole.op.at(whole.df)
        start = top.anchor(needed) if self.grouped and all(level.groups is not None for level in self.levels) else top
        slim = tuple(replace(sub, rids=sub.op.key, frame=sub.frame.select(*sub.link, *sub.op.key)) for sub in subs)
        source = self.pinned()
        if self.grouped and not self.keys:
            source = replace(self, base=self.result(), aggregates={}, finish={}, having=None)
        source = replace(source, core=Traced(start.frame, start.key, slim))
        few = self.limit is not None
        main = top.expand(source.main(indexed=True), few)
        for sub in subs:
            main = sub.op.expand(main, few) if sub.single else main
        head = ["out_index", *[c for c in self.links() if c != "out_index"], *self.base_rids, *whole.rids]
        main = main.select(*head, *[r for sub in subs if sub.single for r in sub.rids])
        result = main.select(F.lit("main").alias("branch"), "*") if any(not sub.single for sub in subs) else main
        for slim_sub, rows in source.branches(main):
            sub = next(s for s in subs if s.name == slim_sub.name and s.op.key == slim_sub.rids)
            rows = sub.op.expand(rows, few).select(F.lit(sub.name).alias("branch"), *sub.link, *sub.rids)
            result = result.unionByName(rows, allowMissingColumns=True)
        return result

    def edges(self) -> DataFrame:
        """(op_id, side, out_id, in_id) of every operator, ids as text: the tables that `composed` reads.

        The last two are the group-by (`0` row -> group, `1` group -> output), whose
        address is the group's key.
        """
        found = []
        numbered = [("", self.core.op), *[(f"{sub.name}_", sub.op) for sub in self.core.subs]]
        for name, op in numbered:
            if op is None:
                raise ValueError("a step of this plan recorded no operator")
            for number, below in enumerate(op.walk()):
                found.append(below.edges().select(F.lit(f"{name}{below.kind}_{number}").alias("op_id"), "side", "out_id", "in_id"))
        source = self.pinned()
        op = self.core.op.at(self.core.df)
        if self.grouped:
            core = op.frame if not self.levels else source._levelled("join")
            by = as_text(self.keys) if self.keys else F.lit("")
            found.append(core.select(F.lit("group").alias("op_id"), F.lit("0").alias("side"), by.alias("out_id"), as_text(op.key).alias("in_id")))
            if self.keys:
                top = ordinal(source._top(), list(self.order), limits=self.limits, bound=source._bound())
                outputs = top.select(F.col("out_index").cast("string").alias("out_id"), by.alias("in_id"))
            else:
                outputs = source.result().select(F.lit("0").alias("out_id"), F.lit("").alias("in_id"))
            found.append(outputs.select(F.lit("group").alias("op_id"), F.lit("1").alias("side"), "out_id", "in_id"))
        return reduce(DataFrame.unionByName, found)

    def long(self, by: Sequence[str], strategy: str = "join") -> DataFrame:
        """Whole lineage as (out_id, branch, relation, rid), one row per id.

        out_id is the text of the columns `by` for main rows, of the link columns
        for linked sub rows, and "*" (every output) for other sub rows.
        """
        main = self.main(strategy)

        def unpivot(rows: DataFrame, ident: Sequence[str], branch: str, rids: Sequence[str]) -> DataFrame:
            out_id = F.concat_ws("|", *[F.col(c).cast("string") for c in ident]) if ident else F.lit("*")
            pairs = [F.struct(F.lit(r).alias("relation"), F.col(r).cast("string").alias("rid")) for r in rids]
            rows = rows.select(out_id.alias("out_id"), F.lit(branch).alias("branch"), F.explode(F.array(*pairs)).alias("x"))
            return rows.select("out_id", "branch", "x.relation", "x.rid").filter("rid is not null")

        whole = unpivot(main, by, "main", [c for c in main.columns if c.endswith("_rid")])
        for sub, rows in self.branches(main):
            whole = whole.union(unpivot(rows, sub.link, sub.name, sub.rids))
        return whole

    def flat(self, by: Sequence[str], wanted: DataFrame, bound: int | None = None) -> DataFrame:
        """Joined form for chosen outputs: each main row with every sub row it depends on.

        Its size is the product of the branches, hence only for a selection;
        `frame` holds the same lineage for all outputs.
        """
        rows = self._chosen(self.main(), by, wanted, bound)
        for sub, frame in self.branches(rows):
            if sub.link:
                rows = self._expand(rows, replace(sub, frame=frame))
            else:
                rows = rows.join(sized(frame, self.limits), how="cross")
        links = [c for c in self.links() if c not in self.outputs]
        return rows.drop(*links)

    def traced(self, by: Sequence[str], wanted: DataFrame | None, bound: int | None = None) -> DataFrame:
        """(relation, n, last): how many base rows of each relation the chosen outputs have, and the largest id.

        Outputs are chosen by the columns `by` of `wanted`; None: all of them. The product of main and sub rows is not
        built.
        """
        main = self.main() if wanted is None else self._chosen(self.main(), by, wanted, bound)
        found = []
        for rows, rids in [(main, [x for x in main.columns if x.endswith("_rid")]), *[(rows, sub.rids) for sub, rows in self.branches(main)]]:
            counts = [F.count_distinct(r).alias(f"n_{r}") for r in rids]
            one = rows.agg(*counts, *[F.max(r).cast("string").alias(r) for r in rids])
            each = F.array(*[F.struct(F.lit(r).alias("relation"), F.col(f"n_{r}").alias("n"), F.col(r).alias("last")) for r in rids])
            found.append(one.select(F.inline(each)))
        return reduce(DataFrame.unionByName, found)

    def _chosen(self, main: DataFrame, by: Sequence[str], wanted: DataFrame, bound: int | None) -> DataFrame:
        """Main rows whose outputs have their columns `by` in `wanted`.

        The values of a single output go into the plan as literals: unlike a join they are pushed to all scans that
        they can restrict.
        """
        if bound == 1:
            row = wanted.select(*by).first()
            same = [F.col(c).isNull() if row[c] is None else F.col(c) == F.lit(row[c]) for c in by] if row else [F.lit(False)]
            return main.filter(reduce(Column.__and__, same))
        picked = wanted.select(*[F.col(c).alias(f"_w_{c}") for c in by])
        condition = matching([F.col(c) for c in by], [F.col(f"_w_{c}") for c in by])
        return main.join(sized(picked, self.limits, bound), condition, "left_semi")

    def recover(self) -> DataFrame:
        """The result, read back from its lineage."""
        outputs = self.main().select(*self.outputs)
        return outputs.distinct().orderBy(*self.order) if self.order else outputs.distinct()

    def wanted(self, rows: int, by: Sequence[str]) -> DataFrame:
        """The first `rows` outputs in key order."""
        top = self._top().select(*self.outputs) if self.grouped else self.result()
        return top.orderBy(*by).limit(rows) if by else top

    def backward(
        self, by: Sequence[str], rows: int | None = None, wanted: DataFrame | None = None, bound: int | None = None
    ) -> DataFrame:
        """Per output: number of joined lineage rows, and the largest id per relation.

        Asked for the outputs in `wanted` (distinct values of the columns `by`),
        for the first `rows` in the order of `by`, or for all of them. Counts of
        linked branches multiply, so the product is never built.
        """
        source = self.pinned()
        main = source.main()
        if rows is not None and wanted is None and by:
            wanted, bound = source.wanted(rows, by), rows
        if wanted is not None and by:
            main = self._chosen(main, by, wanted, bound)
        subs = self.branches(main)
        links = [c for c in self.links() if c not in by]
        main_rids = [c for c in main.columns if c.endswith("_rid")]
        step = main.groupBy(*by, *links).agg(
            F.count(F.lit(1)).alias("n"), *[F.max(c).alias(c) for c in main_rids]
        )
        for sub, frame in subs:
            counted = frame.groupBy(*sub.link).agg(
                F.count(F.lit(1)).alias("_n"), *[F.max(c).alias(c) for c in sub.rids]
            )
            step = attach_counts(step, counted, sub.link)
        rids = main_rids + [c for sub, _ in subs for c in sub.rids]
        totals = [F.sum("n").alias("n"), *[F.max(c).alias(c) for c in rids]]
        return step.groupBy(*by).agg(*totals) if by else step.agg(*totals)

def attach_counts(step: DataFrame, counted: DataFrame, link: Sequence[str]) -> DataFrame:
    """Multiplies main counts by the counts of a sub branch."""
    if link:
        joined = step.join(counted, list(link))
    else:
        packed = counted.select(F.struct(*counted.columns).alias("v")).scalar()
        joined = step.select("*", packed.alias("_v")).select(*step.columns, "_v.*")
    return joined.withColumn("n", F.col("n") * F.col("_n")).drop("_n")
