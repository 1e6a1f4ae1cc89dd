"""Base tables with row ids and the derived columns the workload needs."""

from __future__ import annotations

import re
from copy import copy
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowtrace.session import DEFAULT_LIMITS, fresh_path

MONEY = "decimal(12,2)"


def money(name: str) -> Column:
    return F.col(name).cast(MONEY)


# Columns of the base tables that every folder has (partsupp as a whole may be missing), and their types.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "partsupp": "ps_partkey long, ps_suppkey long, ps_availqty long, ps_supplycost double",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
}


# Primary keys, by the prefix of the table's columns.
PRIMARY = {
    "r": ("regionkey",), "n": ("nationkey",), "s": ("suppkey",), "c": ("custkey",), "p": ("partkey",), "o": ("orderkey",),
    "ps": ("partkey", "suppkey"),
}


def key_columns(rid: str) -> tuple[str, ...]:
    """Key columns that stand beside an id: `n1_rid` -> `n1_nationkey`; none if they are not known."""
    prefix = rid.removesuffix("_rid")
    return tuple(f"{prefix}_{column}" for column in PRIMARY.get(prefix.rstrip("0123456789"), ()))


SLASHES = ":/+"  # `file:/a` and `file:///a` are one path
#: Bits of an id that hold the position in a file; those above hold the file's number.
POSITION_BITS = 40


def place_id(file: Column, position: Column) -> Column:
    return F.shiftleft(file.cast("long"), POSITION_BITS) + position


def _text(*parts: Column | str) -> Column:
    columns = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.concat_ws("-", *[c.cast("string") for c in columns])


def _pick(remainder: Column, values: list[str]) -> Column:
    """values[remainder], as one CASE expression."""
    chosen = F.when(remainder == 0, values[0])
    for position, value in enumerate(values[1:-1], start=1):
        chosen = chosen.when(remainder == position, value)
    return chosen.otherwise(values[-1])


def _shift(day: Column, days: Column) -> Column:
    return F.date_add(day, days.cast("int"))


class Tables:
    """Reads one data folder; every property is a DataFrame with a `<prefix>_rid` column.

    rid="keys": ids made of the key columns, the same in any engine.
    rid="file": the number of the file and the position in it, in one long; needs no key. `files` and `places` lead
    back to the paths.

    Columns that the files hold are read as they are (brought to the types below);
    only those they lack are derived. A stored `partsupp` is read; otherwise it is
    derived once for each `Tables` and written to the shared folder.
    """

    def __init__(self, spark: SparkSession, folder: str, rid: str = "keys"):
        if rid not in ("keys", "file"):
            raise ValueError(f"unknown rid mode {rid!r}")
        self.spark = spark
        self.folder = folder.rstrip("/")
        self.rid = rid
        self._raw: dict[str, DataFrame] = {}
        self._listed: dict[str, list[str]] = {}
        #: What was written for later questions, by name: it lives as long as this object.
        self.stores: dict[str, Any] = {}

    def unnamed(self) -> Tables:
        """The same tables with empty ids, for questions that count rows: no ids are made, shuffled or kept for them.

        What was read, derived and written is shared with this object.
        """
        other = copy(self)
        other.rid = "empty"
        return other

    def raw(self, name: str) -> DataFrame:
        if name not in self._raw:
            self._raw[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._raw[name]

    def stored(self, name: str) -> bool:
        """Whether the folder has this table."""
        try:
            self.raw(name)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return False
        return True

    def with_rid(self, name: str, rid: str, keys: list[str], days: tuple[str, ...] = (), **derived: Column) -> DataFrame:
        """Table, its row id, and derived values for the columns that the files lack. `days` are brought to dates.

        `_metadata` has to be read next to the scan, hence one select for all.
        """
        located = self.rid == "file"
        if located:
            value = F.col("_metadata.row_index")
        elif self.rid == "empty":
            value = F.lit(None).cast("long")
        else:
            value = F.col(keys[0]) if len(keys) == 1 else _text(*keys)
        found = dict(self.raw(name).dtypes)
        wanted = {part.split()[0]: part.split()[1].replace("long", "bigint") for part in SCHEMAS[name.rstrip('*')].split(",")}
        columns = []
        for column in dict.fromkeys([*wanted, *derived]):
            if column not in found and column in derived:
                columns.append(derived[column].alias(column))
            elif column in days:
                columns.append(F.col(column).cast("date").alias(column))
            elif wanted.get(column, found.get(column)) != found.get(column) and column in found:
                columns.append(F.col(column).cast(wanted[column]).alias(column))
            else:
                columns.append(F.col(column))
        if not located:
            return self.raw(name).select(*columns, value.alias(rid))
        paths = self._paths(name)
        if len(paths) == 1:
            return self.raw(name).select(*columns, value.alias(rid))
        rows = self.raw(name).select(*columns, value.alias("_position"), F.regexp_replace(F.col("_metadata.file_path"), SLASHES, ":/").alias("_path"))
        files = self.files(name)
        files = F.broadcast(files) if len(paths) <= DEFAULT_LIMITS.broadcast_rows else files
        named = [c for c in rows.columns if c not in ("_position", "_path")]
        return rows.join(files, F.col("_path") == F.col("path")).select(*named, place_id(F.col("file"), F.col("_position")).alias(rid))

    def _paths(self, name: str) -> list[str]:
        """Files of a table in the order of their numbers: the driver's own listing."""
        if name not in self._listed:
            self._listed[name] = sorted({re.sub(SLASHES, ":/", path) for path in self.raw(name).inputFiles()})
            if len(self._listed[name]) >= 1 << (63 - POSITION_BITS):
                raise ValueError(f"{name} has more files than ids can number")
        return self._listed[name]

    def files(self, name: str) -> DataFrame:
        """(file, path) of a table read with rid="file"."""
        return self.spark.createDataFrame(list(enumerate(self._paths(name))), "file long, path string")

    def places(self, name: str, ids: DataFrame, rid: str) -> DataFrame:
        """`ids` with the path of the file and the position in it that the id column `rid` stands for."""
        files = self.files(name).withColumnsRenamed({"file": "_file", "path": "file_path"})
        position = F.col(rid).bitwiseAND(F.lit((1 << POSITION_BITS) - 1)).alias("row_index")
        found = ids.select("*", F.shiftright(rid, POSITION_BITS).alias("_f"), position)
        return found.join(files, F.col("_f") == F.col("_file")).drop("_f", "_file")

    @property
    def region(self) -> DataFrame:
        return self.with_rid("region", "r_rid", ["r_regionkey"])

    @property
    def nation(self) -> DataFrame:
        return self.with_rid("nation", "n_rid", ["n_nationkey"])

    @property
    def supplier(self) -> DataFrame:
        return self.with_rid(
            "supplier",
            "s_rid",
            ["s_suppkey"],
            s_address=F.concat(F.lit("saddr-"), F.col("s_suppkey").cast("string")),
            s_phone=_text(F.col("s_nationkey") + 10, "s_suppkey"),
            s_comment=F.when(F.col("s_acctbal") < 0, "Customer has Complaints").otherwise("quiet"),
        )

    @property
    def customer(self) -> DataFrame:
        return self.with_rid(
            "customer",
            "c_rid",
            ["c_custkey"],
            c_address=F.concat(F.lit("caddr-"), F.col("c_custkey").cast("string")),
            c_phone=_text(F.col("c_nationkey") + 10, "c_custkey"),
            c_comment=F.concat(F.lit("c"), (F.col("c_custkey") % 97).cast("string")),
        )

    @property
    def part(self) -> DataFrame:
        size = _pick(F.col("p_partkey") % 3, ["SM", "MED", "LG"])
        shape = _pick(F.col("p_partkey") % 4, ["CASE", "BOX", "PACK", "PKG"])
        return self.with_rid(
            "part",
            "p_rid",
            ["p_partkey"],
            p_mfgr=F.concat(F.lit("Manufacturer#"), (F.col("p_partkey") % 5 + 1).cast("string")),
            p_container=F.concat(size, F.lit(" "), shape),
        )

    @property
    def orders(self) -> DataFrame:
        return self.with_rid(
            "orders",
            "o_rid",
            ["o_orderkey"],
            days=("o_orderdate",),
            o_shippriority=F.lit(0),
            o_comment=F.when(F.col("o_orderkey") % 5 == 0, "special packages requests").otherwise("plain"),
        )

    @property
    def lineitem(self) -> DataFrame:
        order, line = F.col("l_orderkey"), F.col("l_linenumber")
        part, supp = F.col("l_partkey"), F.col("l_suppkey")
        shipped = F.col("l_shipdate").cast("date")
        return self.with_rid(
            "lineitem",
            "l_rid",
            ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"],
            days=("l_shipdate", "l_commitdate", "l_receiptdate"),
            l_commitdate=_shift(shipped, (order * 7 + line * 13 + part) % 61 - 30),
            l_receiptdate=_shift(shipped, (order * 5 + line * 11 + supp) % 30 + 1),
            l_shipmode=_pick((order + line) % 7, ["MAIL", "SHIP", "AIR", "AIR REG", "RAIL", "TRUCK", "FOB"]),
            l_shipinstruct=_pick(
                (part + line) % 4, ["DELIVER IN PERSON", "COLLECT COD", "NONE", "TAKE BACK RETURN"]
            ),
        )

    @property
    def partsupp(self) -> DataFrame:
        """The stored table, or one row per (part, supplier) that lineitem knows."""
        if self.stored("partsupp"):
            return self.with_rid("partsupp", "ps_rid", ["ps_partkey", "ps_suppkey"])
        if "partsupp*" not in self._raw:
            pairs = self.raw("lineitem").groupBy("l_partkey", "l_suppkey")
            made = pairs.agg(
                F.min("l_extendedprice").cast("double").alias("ps_supplycost"),
                F.sum(F.col("l_quantity").cast("int")).alias("ps_availqty"),
            ).select(
                F.col("l_partkey").alias("ps_partkey"),
                F.col("l_suppkey").alias("ps_suppkey"),
                "ps_supplycost",
                "ps_availqty",
            )
            path = fresh_path(self.spark, "partsupp")
            made.write.parquet(path)
            self._raw["partsupp*"] = self.spark.read.schema(made.schema).parquet(path)
        return self.with_rid("partsupp*", "ps_rid", ["ps_partkey", "ps_suppkey"])

    @property
    def events(self) -> DataFrame:
        return self.with_rid("events", "e_rid", ["event_id"])

    def occurrence(self, name: str, prefix: str) -> DataFrame:
        """A further occurrence of a table in one query: `n_name` -> `n1_name` for prefix `n1`."""
        frame: DataFrame = getattr(self, name)
        return frame.select([F.col(c).alias(prefix + c[c.index("_"):]) for c in frame.columns])
