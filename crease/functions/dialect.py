"""SQL text for Spark, and the few spellings that differ in the engine that checks it."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace


#: Tables that no season is asked of.
WHOLE = ("ask", "attacks", "deliveries")


@dataclass(frozen=True)
class Dialect:
    """`tables`: the SQL of each table that a query begins with; `stored`: which of them, and fp, are read as written; `parts`: into how many parts Spark deals large tables (0: as it likes)."""

    name: str
    tables: dict[str, str]
    events: str = "events"
    pages: str = "pages"
    as_of: str = "date '1998-08-02'"
    stored: dict[str, str] = field(default_factory=dict)
    parts: int = 0

    @property
    def base(self) -> str:
        """Begins a query with the tables' CTEs."""
        return "WITH " + ",\n".join(f"{k} AS ({self.stored.get(k, v)})" for k, v in self.tables.items())

    def of_season(self, season: str) -> Dialect:
        """The same tables, with the matches of one season only."""
        if not re.fullmatch(r"[0-9A-Za-z/ -]+", season):
            raise ValueError(f"no season: {season!r}")
        only = lambda sql: f"SELECT * FROM ({sql}) x WHERE season = '{season}'"
        return replace(self, tables={**self.tables, "matches": only(self.tables["matches"])}, stored={k: v if k in WHOLE else only(v) for k, v in self.stored.items()})

    def parted(self, table: str, key: str, times: int = 1) -> str:
        """The table, in Spark dealt by key into `times` parts for each of `parts`: its own choice puts many keys into one task, whose sorts and windows hold them all."""
        return f"(SELECT /*+ REPARTITION({self.parts * times}, {key}) */ * FROM {table}) {table}" if self.name == "spark" and self.parts else table

    def r(self, x: str, n: int) -> str:
        """Half-even rounding of the binary value: what is rounded to a whole number is x * 10^n as a double."""
        return f"{f'rint(({x}) * 1e{n})' if self.name == 'spark' else f'round_even(({x}) * 1e{n}, 0)'} / 1e{n}"

    def days(self, later: str, earlier: str) -> str:
        return f"datediff({later}, {earlier})" if self.name == "spark" else f"date_diff('day', {earlier}, {later})"

    def rate(self, a: str, b: str, times: str, n: int, default: str = "0e0") -> str:
        """a / b * times, rounded; `default` where b is 0."""
        x = self.r(f"({a}) / nullif({b}, 0) * {times}", n)
        return x if default == "null" else f"coalesce({x}, {default})"

    def mean(self, x: str, digits: int, key: str = "") -> str:
        """An aggregate: the mean of values of at most `digits` digits. Spark adds them as decimals, so that the order in which rows arrive can't turn a half when the mean is rounded; or, given a key and groups of a few rows, as doubles like the SQL, from the largest key down."""
        if self.name != "spark":
            return f"avg({x})"
        if key:
            return f"aggregate(sort_array(collect_list(struct({key} AS k, {x} AS x)) FILTER (WHERE {x} IS NOT NULL), false), 0e0, (a, v) -> a + v.x) / nullif(count({x}), 0)"
        return f"cast(sum(cast({x} as decimal(28, {digits}))) as double) / count({x})"

    def add_days(self, date: str, n: str) -> str:
        return f"date_add({date}, {n})" if self.name == "spark" else f"cast({date} + cast({n} as int) as date)"

    def grid(self, last: str) -> str:
        """A relation (g) of the integers from 1 to `last`."""
        return f"(SELECT explode(sequence(1, {last})) AS g)" if self.name == "spark" else f"(SELECT unnest(range(1, {last} + 1)) AS g)"

    def steps(self, last: str) -> str:
        """One row for each integer from 1 to `last` (rounded down), which may be a column."""
        n = f"cast(floor({last}) as int)"
        return f"explode(sequence(1, greatest({n}, 1)))" if self.name == "spark" else f"unnest(range(1, greatest({n}, 1) + 1))"

    def each(self, n: int) -> str:
        """In a list of columns: one row for each integer from 0 to `n` - 1."""
        return f"explode(sequence(0, {n - 1}))" if self.name == "spark" else f"unnest(range(0, {n}))"

    def latest(self, x: str, window: str) -> str:
        """The last value of `x` within `window` that isn't missing."""
        return f"last_value({x}, true) OVER ({window})" if self.name == "spark" else f"last_value({x} IGNORE NULLS) OVER ({window})"

    def faded(self, x: str, fade: str, window: str) -> str:
        """Sum of `x` over `window` where it isn't missing, each value weighing `fade` times the one after it; 0 over no rows."""
        if self.name == "spark":
            return f"aggregate(collect_list({x}) OVER ({window}), 0e0, (a, v) -> a * {fade} + v)"
        return f"coalesce(list_reduce(list({x}) FILTER (WHERE {x} IS NOT NULL) OVER ({window}), lambda a, v: a * {fade} + v), 0e0)"

    def joined(self, x: str, by: str, order: str) -> str:
        """An aggregate: the texts `x`, separated by `by`."""
        return f"listagg({x}, '{by}') WITHIN GROUP (ORDER BY {order})" if self.name == "spark" else f"string_agg({x}, '{by}' ORDER BY {order})"

    def counted(self, key: str, n: str) -> str:
        """An aggregate: a map of the keys that aren't missing to their `n`, in the order of keys."""
        if self.name == "spark":
            return f"map_from_entries(array_sort(collect_list(struct({key} AS k, {n} AS n)) FILTER (WHERE {key} IS NOT NULL)))"
        return f"map_from_entries(list({{'k': {key}, 'n': {n}}} ORDER BY {key}) FILTER (WHERE {key} IS NOT NULL))"

    def at(self, counted: str, key: str) -> str:
        """What a map of counts has for a key; 0 if nothing."""
        return f"coalesce({f'try_element_at({counted}, {key!r})' if self.name == 'spark' else f'{counted}[{key!r}]'}, 0)"

    def listed(self, counted: str) -> str:
        """A map of counts as text: key and count, in the order of keys."""
        if self.name == "spark":
            return f"array_join(transform(map_entries({counted}), e -> concat(e.key, ': ', cast(e.value as string))), ', ')"
        return f"coalesce(array_to_string(list_transform(map_entries({counted}), lambda e: concat(e.key, ': ', cast(e.value as varchar))), ', '), '')"

    def text(self, x: str) -> str:
        return f"cast({x} as {'string' if self.name == 'spark' else 'varchar'})"

    def clamp(self, x: str, low: str, high: str) -> str:
        return f"greatest({low}, least({high}, {x}))"


def count(condition: str) -> str:
    return f"cast(count(*) FILTER (WHERE {condition}) as bigint)"


def total(x: str, condition: str = "true") -> str:
    return f"cast(coalesce(sum({x}) FILTER (WHERE {condition}), 0) as bigint)"


def phase(fmt: str, x: str = "over_no") -> str:
    a, b = (6, 15) if fmt == "T20" else (10, 40)
    return f"CASE WHEN {x} < {a} THEN 'powerplay' WHEN {x} < {b} THEN 'middle' ELSE 'death' END"


def overs(fmt: str) -> int:
    return 20 if fmt == "T20" else 50
