"""A composable query builder over related tables: filter, exclude, order_by and friends compile to semi-joins and expressions.

Paths join names with `__`. A scalar relation is a many-to-one hop; a plural relation means "any such row exists", to any depth; a
last part that names a lookup applies it. Computed attributes are used like stored ones. A length lookup on a plural relation counts rows. Keyword conditions hold independently of each
other, so two paths over one relation may be met by different rows. Everything is resolved when the query is built, so an
unknown name fails at once.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tierspan.functions.lookups import CARDINALITY, LOOKUPS, ORDERED, equals


#: Keys that rows are dealt between where they are numbered; sizes of that many ranges are summed by one task.
RANGES = 64


class DoesNotExist(LookupError):
    """No row matches."""


class MultipleObjectsReturned(LookupError):
    """Several rows match where one is wanted."""


@dataclass(frozen=True)
class Entity:
    """A table: its key, its default order, and relations as name -> (entity, foreign key)."""

    key: str
    order: tuple[str, ...]
    scalars: dict[str, tuple[str, str]] = field(default_factory=dict)
    plurals: dict[str, tuple[str, str]] = field(default_factory=dict)
    #: relations in which a row belongs to its parent only if it starts in [start, end) of it
    timed: frozenset[str] = frozenset()
    #: computed attributes: name -> SQL over the table's own columns
    derived: dict[str, str] = field(default_factory=dict)
    #: attributes that a row has from a scalar relation: name -> (path, value where there is none)
    carried: dict[str, tuple[str, Any]] = field(default_factory=dict)


@dataclass(frozen=True)
class Query:
    """A lazy, immutable query over one entity of `tables`."""

    tables: dict[str, DataFrame]
    graph: dict[str, Entity]
    entity: str
    steps: tuple[tuple[str, tuple[tuple[str, Any], ...]], ...] = ()
    ordering: tuple[str, ...] = ()
    root: DataFrame | None = None

    def all(self) -> Query:
        return replace(self)

    def filter(self, **conditions: Any) -> Query:
        self._check(conditions)
        return replace(self, steps=(*self.steps, ("filter", tuple(conditions.items()))))

    def exclude(self, **conditions: Any) -> Query:
        """Rows that don't meet all conditions together; rows with absent values stay."""
        self._check(conditions)
        return replace(self, steps=(*self.steps, ("exclude", tuple(conditions.items()))))

    def order_by(self, *fields: str) -> Query:
        return replace(self, ordering=fields)

    def from_items(self, keys: DataFrame) -> Query:
        """The same entity restricted to the rows whose key is in the first column of `keys`."""
        name = keys.columns[0]
        base = self.tables[self.entity]
        return replace(self, root=base.join(keys.select(F.col(name).alias("_key")).distinct(), base[self.graph[self.entity].key] == F.col("_key"), "left_semi"), steps=(), ordering=())

    def related(self, name: str) -> Query:
        """A query over a related entity: all its rows that a row of this query leads to, each once."""
        node, target = self.graph[self.entity], None
        if name in node.scalars:
            target, own = node.scalars[name]
            their = self.graph[target].key
        elif name in node.plurals:
            target, their = node.plurals[name]
            own = node.key
        else:
            raise AttributeError(f"{self.entity} has no relation {name!r}")
        timed = name in node.timed
        ours = self.rows().select(F.col(own).alias("_own"), *([F.col("start").alias("_s"), F.col("end").alias("_e")] if timed else [])).distinct()
        other = self.tables[target]
        on = other[their] == F.col("_own")
        if timed:
            on = on & (other["start"] >= F.col("_s")) & (other["start"] < F.col("_e"))
        return replace(self, entity=target, root=other.join(ours, on, "left_semi"), steps=(), ordering=())

    def rows(self) -> DataFrame:
        """The matching rows, unordered."""
        df = self.tables[self.entity] if self.root is None else self.root
        for kind, conditions in self.steps:
            if kind == "filter":
                for path, value in conditions:
                    df = self._keep(df, self.entity, path.split("__"), value)
            else:
                df = self._drop(df, conditions)
        return df

    def df(self) -> DataFrame:
        """The matching rows, ordered: by the fields asked for, ties by the entity's default order."""
        df = self.rows()
        if not self.ordering:
            return df.orderBy(*self.graph[self.entity].order)
        names, keys = df.columns, []
        for k, name in enumerate(self.ordering):
            path = name.lstrip("-").split("__")
            df = self._attach(df, self.entity, path, f"_order{k}")
            keys.append(F.col(f"_order{k}").desc() if name.startswith("-") else F.col(f"_order{k}").asc())
        return df.orderBy(*keys, *self.graph[self.entity].order).select(*names)

    def numbered(self, name: str = "place") -> DataFrame:
        """The matching rows with their place, from 1, in the query's order, without sorting them in one task.

        Rows are dealt to ranges between a few keys, drawn by hash; a row's place is how many rows lie in the ranges before, and its rank
        in its own range.
        """
        df, columns, keys = self.rows(), [], []
        for k, field_ in enumerate([*self.ordering, *self.graph[self.entity].order]):
            df = self._attach(df, self.entity, field_.lstrip("-").split("__"), f"_order{k}")
            columns.append(f"_order{k}")
            keys.append(F.col(f"_order{k}").desc() if field_.startswith("-") else F.col(f"_order{k}").asc())
        own = [c for c in df.columns if c not in columns]
        drawn = df.select(*columns).orderBy(F.xxhash64(*columns)).limit(RANGES).collect()

        def follows(bound) -> Column:
            """Whether a row stands at or behind a bound: nulls come first, last where the order falls."""
            out, same = F.lit(False), F.lit(True)
            for k, c in enumerate(columns):
                there, kind = F.col(c), df.schema[c].dataType
                falls = k < len(self.ordering) and self.ordering[k].startswith("-")
                at = F.lit(bound[c]).cast(kind)
                behind = (there < at) if falls else (there > at)
                if bound[c] is None:
                    behind = F.lit(False) if falls else there.isNotNull()
                elif falls:
                    behind = behind | there.isNull()
                out, same = out | (same & F.coalesce(behind, F.lit(False))), same & there.eqNullSafe(at)
            return out | same

        part = F.lit(0)
        for bound in drawn:
            part = part + follows(bound).cast("int")
        dealt = df.withColumn("_part", part)
        sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
        before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
        ranked = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy("_part").orderBy(*keys)))
        return ranked.join(F.broadcast(before), "_part").select(*own, (F.col("_before") + F.col("_rank")).alias(name))

    def count(self) -> int:
        return self.rows().count()

    def get(self, **conditions: Any):
        found = self.filter(**conditions).rows().limit(2).collect()
        if not found:
            raise DoesNotExist(f"no {self.entity} matches {conditions}")
        if len(found) > 1:
            raise MultipleObjectsReturned(f"several {self.entity} match {conditions}")
        return found[0]

    def get_or_none(self, **conditions: Any):
        try:
            return self.get(**conditions)
        except DoesNotExist:
            return None

    def get_n(self, n: int) -> DataFrame:
        """The first n rows in the query's order: a top-n plan, no full sort."""
        return self.df().limit(n)

    def get_one(self):
        found = self.get_n(1).collect()
        if not found:
            raise IndexError(f"no {self.entity}")
        return found[0]

    def describe(self) -> str:
        steps = "".join(f".{kind}({', '.join(f'{k}={v!r}' for k, v in c)})" for kind, c in self.steps)
        return f"{self.entity}{steps}" + (f".order_by{self.ordering}" if self.ordering else "")

    # resolution of paths

    def _check(self, conditions: dict[str, Any]) -> None:
        for path, value in conditions.items():
            self._keep(self.tables[self.entity], self.entity, path.split("__"), value)

    def _column(self, entity: str, name: str, path: list[str]) -> tuple[Column, T.DataType]:
        """A stored or computed attribute and its type."""
        table, derived = self.tables[entity], self.graph[entity].derived
        if name in table.columns:
            return F.col(name), table.schema[name].dataType
        if name not in derived:
            raise AttributeError(f"{entity} has no attribute {name!r} (in {'__'.join(path)})")
        made = F.expr(derived[name])
        return made, table.select(made).schema[0].dataType

    def _compare(self, entity: str, column: Column, kind: T.DataType, parts: list[str], value: Any) -> Column:
        if len(parts) == 1:
            return equals(column, value, kind)
        if len(parts) == 2 and parts[1] in LOOKUPS:
            return LOOKUPS[parts[1]](column, value, kind)
        raise AttributeError(f"{entity}.{parts[0]} is no relation (in {'__'.join(parts)})")

    def _test(self, entity: str, parts: list[str], value: Any) -> Column | None:
        """The condition if it concerns the entity's own columns alone."""
        node = self.graph[entity]
        if parts[0] in node.scalars or parts[0] in node.plurals or parts[0] in node.carried:
            return None
        return self._compare(entity, *self._column(entity, parts[0], parts), parts, value)

    def _matching(self, entity: str, parts: list[str], value: Any) -> tuple[str, DataFrame, str, bool]:
        """Rows of the related entity that meet the rest of a path: (own column, rows, their column, timed)."""
        node, name, rest = self.graph[entity], parts[0], parts[1:]
        if name in node.scalars:
            target, fk = node.scalars[name]
            if not rest:
                return fk, self.tables[target].where(equals(F.col(self.graph[target].key), value, self.tables[target].schema[self.graph[target].key].dataType)), self.graph[target].key, False
            return fk, self._keep(self.tables[target], target, rest, value), self.graph[target].key, False
        target, fk = node.plurals[name]
        return node.key, self._keep(self.tables[target], target, rest, value), fk, name in node.timed

    def _semi(self, df: DataFrame, own: str, rows: DataFrame, their: str, timed: bool, how: str) -> DataFrame:
        found = rows.select(F.col(their).alias("_fk"), *([F.col("start").alias("_at")] if timed else [])).distinct()
        condition = df[own] == F.col("_fk")
        if timed:
            condition = condition & (F.col("_at") >= df["start"]) & (F.col("_at") < df["end"])
        return df.join(found, condition, how)

    def _list_lookup(self, entity: str, parts: list[str]) -> int | None:
        """Where a path has its first plural relation, if it ends in a lookup: such a lookup sees the list of related rows."""
        if parts[-1] not in LOOKUPS:
            return None
        at = entity
        for k, name in enumerate(parts[:-1]):
            if name in self.graph[at].plurals:
                return k
            if name not in self.graph[at].scalars:
                return None
            at = self.graph[at].scalars[name][0]
        return None

    def _keep(self, df: DataFrame, entity: str, parts: list[str], value: Any) -> DataFrame:
        test = self._test(entity, parts, value)
        if test is not None:
            return df.where(test)
        if self._related(entity, parts):
            return self._semi(df, *self._matching(entity, parts, value), "left_semi")
        return self._flag(df, entity, parts, value, "_met").where("_met").drop("_met")

    def _related(self, entity: str, parts: list[str]) -> bool:
        """Whether a path asks for the existence of a related row."""
        node = self.graph[entity]
        lists = self._list_lookup(entity, parts) == 0 or len(parts) == 1 and parts[0] in node.plurals
        return not lists and (parts[0] in node.scalars or parts[0] in node.plurals)

    def _flag(self, df: DataFrame, entity: str, parts: list[str], value: Any, flag: str) -> DataFrame:
        """Add boolean `flag`: whether a row meets a condition; null where that is unknown. Rows are flagged themselves, not their keys."""
        test = self._test(entity, parts, value)
        if test is not None:
            return df.withColumn(flag, test)
        if parts[0] in self.graph[entity].carried:
            found = self._attach(df, entity, parts[:1], "_carried")
            return found.withColumn(flag, self._compare(entity, F.col("_carried"), found.schema["_carried"].dataType, parts, value)).drop("_carried")
        if self._list_lookup(entity, parts) == 0:
            return self._counted(df, entity, parts, value, flag)
        if not self._related(entity, parts):
            return self._same_list(df, entity, parts[0], value, flag)
        own, rows, their, timed = self._matching(entity, parts, value)
        if timed:
            # a row may hold several starts: the keys of those that hold any, as only entities of one row a key have such relations
            rows, their = self._semi(self.tables[entity], own, rows, their, True, "left_semi"), own
        met = rows.select(F.col(their).alias("_fk")).where("_fk IS NOT NULL").distinct().withColumn(flag, F.lit(True))
        return df.join(met, df[own] == met["_fk"], "left").drop("_fk").withColumn(flag, F.coalesce(flag, F.lit(False)))

    def _counted(self, df: DataFrame, entity: str, parts: list[str], value: Any, flag: str) -> DataFrame:
        lookup = parts[-1]
        if lookup in ORDERED:
            raise TypeError(f"{lookup} can't order a list of {parts[0]}")
        if lookup == "len":
            LOOKUPS["len"](None, value, None)
        if lookup not in CARDINALITY:
            return df.withColumn(flag, F.lit(False))
        return self._with_count(df, entity, parts[0]).withColumn(flag, CARDINALITY[lookup](F.col("_n"), value)).drop("_n")

    def _with_count(self, df: DataFrame, entity: str, name: str) -> DataFrame:
        node = self.graph[entity]
        target, fk = node.plurals[name]
        related = self.tables[target]
        if name in node.timed:
            own = self.tables[entity].select(F.col(node.key).alias("_fk"), F.col("start").alias("_s"), F.col("end").alias("_e"))
            related = related.join(own, (related[fk] == own["_fk"]) & (related["start"] >= own["_s"]) & (related["start"] < own["_e"])).select("_fk")
        else:
            related = related.select(F.col(fk).alias("_fk"))
        counts = related.groupBy("_fk").agg(F.count(F.lit(1)).alias("_n"))
        return df.join(counts, df[node.key] == counts["_fk"], "left").drop("_fk").withColumn("_n", F.coalesce("_n", F.lit(0)))

    def _same_list(self, df: DataFrame, entity: str, name: str, value: Iterable[Any], flag: str) -> DataFrame:
        """Flag rows whose related keys, in default order, are the given list."""
        node = self.graph[entity]
        target, fk = node.plurals[name]
        other = self.graph[target]
        keys = self.tables[target].groupBy(F.col(fk).alias("_fk")).agg(F.transform(F.array_sort(F.collect_list(F.struct(*other.order, F.col(other.key).alias("_id")))), lambda x: x["_id"]).alias("_ids"))
        wanted = F.array(*map(F.lit, value)) if list(value) else F.array().cast(keys.schema["_ids"].dataType)
        return df.join(keys, df[node.key] == keys["_fk"], "left").withColumn(flag, F.coalesce("_ids", F.array().cast(keys.schema["_ids"].dataType)) == wanted).drop("_fk", "_ids")

    def _drop(self, df: DataFrame, conditions: tuple[tuple[str, Any], ...]) -> DataFrame:
        columns, together = df.columns, F.lit(True)
        for k, (path, value) in enumerate(conditions):
            parts = path.split("__")
            test = self._test(self.entity, parts, value)
            if test is None:
                df, test = self._flag(df, self.entity, parts, value, f"_met{k}"), F.col(f"_met{k}")
            together = together & test
        return df.where(~F.coalesce(together, F.lit(False))).select(*columns)

    def _attach(self, df: DataFrame, entity: str, path: list[str], alias: str) -> DataFrame:
        if len(path) == 1 and path[0] in self.graph[entity].carried:
            far, default = self.graph[entity].carried[path[0]]
            return self._attach(df, entity, far.split("__"), alias).withColumn(alias, F.coalesce(alias, F.lit(default)))
        if len(path) == 1:
            return df.withColumn(alias, self._column(entity, path[0], path)[0])
        if path[0] not in self.graph[entity].scalars:
            raise AttributeError(f"can't order {entity} by {'__'.join(path)}")
        target, fk = self.graph[entity].scalars[path[0]]
        other = self._attach(self.tables[target], target, path[1:], alias).select(F.col(self.graph[target].key).alias("_key"), alias)
        return df.join(other, df[fk] == other["_key"], "left").drop("_key")
