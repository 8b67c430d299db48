"""Tables, views, sequences, stages, snapshots and metadata, over Spark's Parquet tables and temp views.

A table is a set of immutable Parquet folders behind a temp view of its name. A statement that changes rows is one DataFrame
expression over the version before; its result is written as the next version, then the view is moved to it. One that adds
rows writes only these, beside the folders that are there; one that changes columns is a projection over the version before
and writes nothing. Older versions stay readable, so a snapshot is a copy of the dictionary of tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

DEFAULT_ROOT = "file:///tmp/checkpoints"  # of local sessions without spark.checkpoint.dir
_ACTION = "__action"


class WarehouseError(RuntimeError):
    pass


@dataclass
class Table:
    frame: DataFrame
    kind: str = "TABLE"
    query: str | None = None  # of a dynamic table
    base: DataFrame | None = None  # the rows before those in parts, if any
    parts: tuple[str, ...] = ()  # folders of appended rows


@dataclass
class Sequence_:
    start: int
    increment: int
    last: int | None = None

    def reserve(self, n: int) -> int:
        """The first of n values."""
        first = self.start if self.last is None else self.last + self.increment
        self.last = first + (n - 1) * self.increment
        return first


@dataclass
class Context:
    """Names that context functions give. The dialect's defaults."""

    user: str = "EMULATOR_USER"
    role: str = "ACCOUNTADMIN"
    database: str = "EMULATOR_DB"
    schema: str = "PUBLIC"
    warehouse: str = "EMULATOR_WH"


@dataclass
class Warehouse:
    spark: SparkSession
    root: str | None = None
    tables: dict[str, Table] = field(default_factory=dict)
    views: dict[str, str] = field(default_factory=dict)
    sequences: dict[str, Sequence_] = field(default_factory=dict)
    stages: dict[str, str] = field(default_factory=dict)
    databases: set[str] = field(default_factory=lambda: {"EMULATOR_DB"})
    schemas: set[tuple[str, str]] = field(default_factory=lambda: {("EMULATOR_DB", "PUBLIC")})
    context: Context = field(default_factory=Context)
    _saved: dict[str, Table] | None = None

    def __post_init__(self) -> None:
        base = self.root or self.spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not self.spark.sparkContext.master.startswith("local"):
                raise WarehouseError("spark.checkpoint.dir names no shared folder, and no root is given")
            base = DEFAULT_ROOT
        self.root = f"{base.rstrip('/')}/tables-{uuid.uuid4().hex}"

    # tables

    def _written(self, name: str, rows: DataFrame) -> str:
        path = f"{self.root}/{name}/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return path

    def _stored(self, name: str, rows: DataFrame) -> DataFrame:
        return self.spark.read.schema(rows.schema).parquet(self._written(name, rows))

    def _version(self, name: str, rows: DataFrame, kind: str = "TABLE", query: str | None = None) -> DataFrame:
        path = self._written(name, rows)
        return self._set(name, Table(self.spark.read.schema(rows.schema).parquet(path), kind, query, parts=(path,)))

    def _set(self, name: str, table: Table) -> DataFrame:
        self.tables[name] = table
        table.frame.createOrReplaceTempView(name)
        return table.frame

    def table(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise WarehouseError(f"no table {name}")
        return self.tables[name].frame

    def create_table(self, name: str, source: DataFrame | StructType | str, or_replace: bool = False, if_not_exists: bool = False, kind: str = "TABLE") -> DataFrame:
        """From a schema (empty) or a query's rows; an empty query keeps its columns."""
        if name in self.tables and not or_replace:
            if if_not_exists:
                return self.table(name)
            raise WarehouseError(f"table {name} is there already")
        rows = source if isinstance(source, DataFrame) else self.spark.createDataFrame([], source)
        return self._version(name, rows, kind)

    def attach(self, name: str, frame: DataFrame) -> DataFrame:
        """A table of rows that are stored elsewhere and stay there; the first change of rows makes a version of its own."""
        return self._set(name, Table(frame, base=frame))

    def create_dynamic_table(self, name: str, query: str, or_replace: bool = False) -> DataFrame:
        """A table of a query's rows that refresh() brings up to date."""
        self.create_table(name, self.spark.sql(query), or_replace, kind="DYNAMIC TABLE")
        self.tables[name].query = query
        return self.table(name)

    def refresh(self, name: str) -> DataFrame:
        query = self.tables[name].query if name in self.tables else None
        if not query:
            raise WarehouseError(f"{name} is not a dynamic table")
        return self._version(name, self.spark.sql(query), "DYNAMIC TABLE", query)

    def drop_table(self, name: str, if_exists: bool = False) -> None:
        if name not in self.tables and not if_exists:
            raise WarehouseError(f"no table {name}")
        if self.tables.pop(name, None):
            self.spark.catalog.dropTempView(name)

    def _next(self, name: str, rows: DataFrame) -> DataFrame:
        old = self.tables[name]
        return self._version(name, rows, old.kind, old.query)

    def _projected(self, name: str, rows: DataFrame) -> DataFrame:
        """The next version is these columns of the version before, or a part of its rows; nothing is written."""
        old = self.tables[name]
        return self._set(name, Table(rows, old.kind, old.query, base=rows))

    def compact(self, name: str) -> DataFrame:
        """The table rewritten as one folder, after many appends or changes of columns."""
        return self._next(name, self.table(name))

    # rows

    def insert(self, name: str, rows: DataFrame, columns: Sequence[str] | None = None) -> int:
        """Appends rows by position to these columns (by default all); others are null. How many.

        Only the new rows are written. Their number is that in the footers of the new files.
        """
        target, old = self.table(name), self.tables[name]
        columns = list(columns or target.columns)
        if len(rows.columns) != len(columns):
            raise WarehouseError("number of columns differs")
        given = dict(zip(columns, rows.columns, strict=True))
        new = rows.select(*((F.col(f"`{given[f.name]}`") if f.name in given else F.lit(None)).cast(f.dataType).alias(f.name) for f in target.schema))
        path = self._written(name, new)
        read, parts = self.spark.read.schema(target.schema), (*old.parts, path)
        added = read.parquet(*parts)
        self._set(name, Table(old.base.unionByName(added) if old.base is not None else added, old.kind, old.query, old.base, parts))
        return read.parquet(path).count()

    def update(self, name: str, values: Mapping[str, str | Column], where: str | Column | None = None) -> int:
        """Sets columns on rows that meet the condition; rows on which it is null stay. How many."""
        target, met = self.table(name), self._met(where)
        if unknown := set(values) - set(target.columns):
            raise WarehouseError(f"no columns {sorted(unknown)}")
        rows = target.select(*(F.when(met, (F.expr(values[f.name]) if isinstance(values[f.name], str) else values[f.name]).cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name) if f.name in values else F.col(f.name) for f in target.schema))
        n = target.where(met).count()
        self._next(name, rows)
        return n

    def delete(self, name: str, where: str | Column | None = None) -> int:
        """Removes rows that meet the condition; rows on which it is null stay. How many."""
        target, met = self.table(name), self._met(where)
        before = target.count()  # of stored rows both counts come from the files' footers
        return before - self._next(name, target.where(~met)).count()

    @staticmethod
    def _met(where: str | Column | None) -> Column:
        if where is None:
            return F.lit(True)
        return F.coalesce(F.expr(where) if isinstance(where, str) else where, F.lit(False))

    def truncate(self, name: str) -> None:
        self._projected(name, self.table(name).where("false"))

    def merge(self, name: str, source: DataFrame, on: Sequence[str], update: Mapping[str, str] | None = None, insert: Mapping[str, str] | None = None,
              update_if: str = "true", delete_if: str | None = None, insert_if: str = "true") -> dict[str, int]:
        """MERGE by one full outer join on columns that both have. Expressions name the target's columns as t.x and the source's as s.x.

        Matched rows that meet delete_if go, those that meet update_if are updated; source rows without a match that meet
        insert_if are inserted. A target row that several source rows match, and that is changed, is an error. Rows with a
        null key match nothing. The result is written once, with what befell each row; deleted rows lose their cells and are left
        out by a filter on that column.
        """
        target = self.table(name)
        t = target.withColumn("__t", F.lit(True)).alias("t")
        s = source.withColumn("__s", F.lit(True)).alias("s")
        keys = [F.col(f"t.{k}") == F.col(f"s.{k}") for k in on]
        joined = t.join(s, keys, "full")
        matched = F.col("t.__t").isNotNull() & F.col("s.__s").isNotNull()
        deletes = matched & self._met(delete_if) if delete_if else F.lit(False)
        updates = matched & ~deletes & self._met(update_if) if update else F.lit(False)
        inserts = F.col("t.__t").isNull() & self._met(insert_if) if insert else F.lit(False)
        if update or delete_if:
            repeated = source.dropna(subset=list(on)).groupBy(*on).count().where("count > 1")
            if not repeated.isEmpty() and not repeated.join(target, list(on), "left_semi").isEmpty():  # the second join only where keys repeat
                raise WarehouseError("several source rows match one target row")
        cells = []
        for f in target.schema:
            old = F.col(f"t.{f.name}")
            new = F.when(updates, F.expr(update[f.name]).cast(f.dataType)) if update and f.name in update else None
            put = F.expr(insert[f.name]).cast(f.dataType) if insert and f.name in insert else F.lit(None).cast(f.dataType)
            cells.append((new.when(inserts, put) if new is not None else F.when(inserts, put)).otherwise(old).alias(f.name))
        action = F.when(deletes, "deleted").when(updates, "updated").when(inserts, "inserted").when(F.col("t.__t").isNull(), "none").otherwise("kept")
        stays = f"`{_ACTION}` IN ('updated', 'inserted', 'kept')"
        merged = joined.select(*cells, action.alias(_ACTION))
        rows = self._stored(name, merged.select(*(F.when(F.expr(stays), F.col(f"`{c}`")).alias(c) for c in target.columns), _ACTION))
        counts = {r[_ACTION]: r["count"] for r in rows.groupBy(_ACTION).count().collect()}  # five at most
        self._projected(name, rows.where(stays).drop(_ACTION))
        return {k: counts.get(k, 0) for k in ("inserted", "updated", "deleted")}

    # columns

    def add_column(self, name: str, column: str, kind: str) -> None:
        self._projected(name, self.table(name).withColumn(column, F.lit(None).cast(kind)))

    def drop_column(self, name: str, column: str) -> None:
        if column not in self.table(name).columns:
            raise WarehouseError(f"no column {column}")
        self._projected(name, self.table(name).drop(column))

    def rename_column(self, name: str, old: str, new: str) -> None:
        if old not in self.table(name).columns:
            raise WarehouseError(f"no column {old}")
        self._projected(name, self.table(name).withColumnRenamed(old, new))

    def rename_table(self, old: str, new: str) -> None:
        if new in self.tables:
            raise WarehouseError(f"table {new} is there already")
        table = self.tables[old] if old in self.tables else None
        if table is None:
            raise WarehouseError(f"no table {old}")
        self.drop_table(old)
        self._set(new, table)

    # views, sequences, snapshots, names

    def create_view(self, name: str, query: str) -> DataFrame:
        frame = self.spark.sql(query)
        frame.createOrReplaceTempView(name)
        self.views[name] = query
        return frame

    def drop_view(self, name: str, if_exists: bool = False) -> None:
        if self.views.pop(name, None) is None and not if_exists:
            raise WarehouseError(f"no view {name}")
        self.spark.catalog.dropTempView(name)

    def create_sequence(self, name: str, start: int = 1, increment: int = 1) -> None:
        self.sequences[name] = Sequence_(start, increment)

    def nextval(self, name: str) -> int:
        return self.sequences[name].reserve(1)

    def currval(self, name: str) -> int:
        if self.sequences[name].last is None:
            raise WarehouseError(f"sequence {name} has no value yet")
        return self.sequences[name].last

    def with_sequence(self, rows: DataFrame, name: str, column: str, order: Sequence[str]) -> DataFrame:
        """rows with the sequence's next values in this order. Numbers come from counts of range partitions, so no task gets all rows."""
        ordered = self._stored(f"sequence-{name}", rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id()))
        sizes = ordered.groupBy("__p").agg(F.count("*").alias("n"))
        before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
        offsets = sizes.select("__p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__o"))
        sequence = self.sequences[name]
        first = sequence.reserve(ordered.count())
        inside = F.col("__i").bitwiseAND(F.lit((1 << 33) - 1))  # the row's number in its partition
        return ordered.join(offsets, "__p").withColumn(column, F.lit(first) + (F.col("__o") + inside) * sequence.increment).drop("__p", "__i", "__o")

    def begin(self) -> None:
        if self._saved is not None:
            raise WarehouseError("a transaction is open")
        self._saved = dict(self.tables)

    def commit(self) -> None:
        self._saved = None

    def rollback(self) -> None:
        if self._saved is None:
            return
        for name in [n for n in self.tables if n not in self._saved]:
            self.drop_table(name)
        for name, table in self._saved.items():
            self._set(name, table)
        self._saved = None

    def create_database(self, name: str, if_not_exists: bool = False, or_replace: bool = False) -> None:
        if name in self.databases and not (if_not_exists or or_replace):
            raise WarehouseError(f"database {name} is there already")
        self.databases.add(name)
        self.schemas.add((name, "PUBLIC"))

    def drop_database(self, name: str, if_exists: bool = False) -> None:
        if name not in self.databases and not if_exists:
            raise WarehouseError(f"no database {name}")
        self.databases.discard(name)
        self.schemas = {(d, s) for d, s in self.schemas if d != name}

    def create_schema(self, name: str) -> None:
        self.schemas.add((self.context.database, name))

    def drop_schema(self, name: str, if_exists: bool = False) -> None:
        if (self.context.database, name) not in self.schemas and not if_exists:
            raise WarehouseError(f"no schema {name}")
        self.schemas.discard((self.context.database, name))

    def use(self, database: str | None = None, schema: str | None = None) -> None:
        if database:
            self.databases.add(database)
            self.context.database = database
        if schema:
            self.context.schema = schema

    def context_columns(self) -> dict[str, Column]:
        """current_user, current_role, current_database, current_schema and current_warehouse, to be put into a select."""
        c = self.context
        return {f"current_{n}": F.lit(getattr(c, n)).alias(f"current_{n}") for n in ("user", "role", "database", "schema", "warehouse")}

    def create_function(self, name: str, parameters: str, returns: str, body: str) -> None:
        """An SQL function, which Spark inlines into the plans that use it."""
        self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {returns} RETURN {body}")

    def drop_function(self, name: str, if_exists: bool = False) -> None:
        self.spark.sql(f"DROP TEMPORARY FUNCTION {'IF EXISTS ' * if_exists}{name}")

    # metadata

    def show_tables(self) -> DataFrame:
        rows = [(n, self.context.database, self.context.schema, t.kind, "Y" if t.kind == "DYNAMIC TABLE" else "N", "Y" if t.kind == "ICEBERG TABLE" else "N") for n, t in sorted(self.tables.items()) if not n.startswith("_")]
        rows += [(n, self.context.database, self.context.schema, "VIEW", "N", "N") for n in sorted(self.views)]
        return self.spark.createDataFrame(rows, "name string, database_name string, schema_name string, kind string, is_dynamic string, is_iceberg string")

    def show_schemas(self) -> DataFrame:
        return self.spark.createDataFrame(sorted(self.schemas), "database_name string, name string")

    def show_databases(self) -> DataFrame:
        return self.spark.createDataFrame([(d,) for d in sorted(self.databases)], "name string")

    def describe(self, name: str) -> DataFrame:
        return self.spark.createDataFrame([(f.name, type_name(f.dataType.simpleString()), "COLUMN", "Y" if f.nullable else "N") for f in self.table(name).schema], "name string, type string, kind string, `null` string")

    def information_schema(self) -> dict[str, DataFrame]:
        """tables, columns and schemata as DataFrames, also registered as temp views information_schema_<name>, for any query."""
        tables = self.show_tables().select(F.col("database_name").alias("table_catalog"), F.col("schema_name").alias("table_schema"), F.col("name").alias("table_name"), F.when(F.col("kind") == "VIEW", "VIEW").otherwise("BASE TABLE").alias("table_type"))
        cells = [(self.context.database, self.context.schema, n, f.name, i, "YES" if f.nullable else "NO", type_name(f.dataType.simpleString())) for n, t in sorted(self.tables.items()) for i, f in enumerate(t.frame.schema, 1)]
        columns = self.spark.createDataFrame(cells, "table_catalog string, table_schema string, table_name string, column_name string, ordinal_position int, is_nullable string, data_type string")
        schemata = self.show_schemas().select(F.col("database_name").alias("catalog_name"), F.col("name").alias("schema_name"))
        out = {"tables": tables, "columns": columns, "schemata": schemata}
        for n, frame in out.items():
            frame.createOrReplaceTempView(f"information_schema_{n}")
        return out


#: Spark type -> the dialect's name of it. Fixed values.
TYPE_NAMES = {"bigint": "NUMBER(38,0)", "int": "NUMBER(38,0)", "smallint": "NUMBER(38,0)", "tinyint": "NUMBER(38,0)", "double": "FLOAT", "float": "FLOAT", "string": "VARCHAR(16777216)",
              "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP_LTZ(9)", "timestamp_ntz": "TIMESTAMP_NTZ(9)", "binary": "BINARY(8388608)"}


def type_name(spark_type: str) -> str:
    if spark_type.startswith("decimal"):
        return "NUMBER" + spark_type.removeprefix("decimal")
    return TYPE_NAMES.get(spark_type, "VARIANT")
