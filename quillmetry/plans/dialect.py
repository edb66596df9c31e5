"""One query text, two engines: small differences between Spark SQL and the checking engine's SQL, in one place."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillmetry.plans.catalog import ORACLE, QUERIES
from quillmetry.sources.tables import table


def rounded(x: str) -> str:
    """A full double: nothing is rounded, the comparison with the checking engine allows for the order of summation."""
    return f"cast({x} as double)"


class Spark:
    explode, size, distinct, sort = "explode", "size", "array_distinct", "array_sort"

    def t(self, name: str) -> str:
        return "{" + name + "}"

    def re(self, pattern: str) -> str:
        return "r'" + pattern.replace("'", "\\x27") + "'"

    def month(self, x: str) -> str:
        return f"cast(date_trunc('MONTH', {x}) as timestamp_ntz)"

    def month_key(self, x: str) -> str:
        return f"date_format({x}, 'yyyy-MM')"

    def micros(self, x: str) -> str:
        return f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {x})"

    def days(self, a: str, b: str) -> str:
        return f"cast(datediff(cast({a} as date), cast({b} as date)) as bigint)"

    def all(self, text: str, pattern: str) -> str:
        return f"regexp_extract_all({text}, {self.re(pattern)}, 0)"

    def count(self, text: str, pattern: str) -> str:
        return f"cast(regexp_count({text}, {self.re(pattern)}) as bigint)"

    def like(self, text: str, pattern: str) -> str:
        return f"({text} rlike {self.re(pattern)})"

    def sub(self, text: str, pattern: str, to: str) -> str:
        return f"regexp_replace({text}, {self.re(pattern)}, '{to}')"

    def group(self, text: str, pattern: str, k: int) -> str:
        return f"regexp_extract({text}, {self.re(pattern)}, {k})"

    def split(self, text: str, pattern: str) -> str:
        return f"split({text}, {self.re(pattern)})"

    def at(self, arr: str, i: str) -> str:
        return f"element_at({arr}, cast({i} as int))"

    def seq(self, a: str, b: str) -> str:
        return f"(case when {b} >= {a} then sequence(cast({a} as int), cast({b} as int)) else cast(array() as array<int>) end)"

    def part(self, arr: str, start: str, n: str) -> str:
        return f"slice({arr}, cast({start} as int), cast({n} as int))"

    def map(self, arr: str, x: str, body: str) -> str:
        return f"transform({arr}, {x} -> {body})"

    def keep(self, arr: str, x: str, body: str) -> str:
        return f"filter({arr}, {x} -> {body})"

    def total(self, arr: str) -> str:
        return f"aggregate({arr}, cast(0 as double), (acc, x) -> acc + x)"

    def join(self, arr: str, sep: str) -> str:
        return f"array_join({arr}, '{sep}')"

    def gather(self, x: str, order: str) -> str:
        return f"transform(array_sort(collect_list(struct({order} as o, {x} as v))), z -> z.v)"

    def plus(self, x: str, days: int) -> str:
        return f"({x} + interval '{days}' day)"

    def sha(self, x: str) -> str:
        return f"sha2({x}, 256)"

    def json(self, x: str, key: str) -> str:
        return f"get_json_object({x}, '$.{key}')"

    def ntz(self, x: str) -> str:
        return f"cast({x} as timestamp_ntz)"

    def div(self, a: str, b: str) -> str:
        return f"try_divide({a}, {b})"

    def bits(self, a: str) -> str:
        return f"bit_count({a})"

    def argmax(self, x: str, by: str) -> str:
        return f"max_by({x}, {by})"

    def argmin(self, x: str, by: str) -> str:
        return f"min_by({x}, {by})"

    def skew(self, x: str) -> str:
        return f"(case when count({x}) < 3 or coalesce(var_pop({x}), 0) = 0 then 0.0 else skewness({x}) end)"

    def struct(self, **fields: str) -> str:
        return "struct(" + ", ".join(f"{v} as {k}" for k, v in fields.items()) + ")"


class Duck(Spark):
    explode, size, distinct, sort = "unnest", "len", "list_distinct", "list_sort"

    def t(self, name: str) -> str:
        return name

    def re(self, pattern: str) -> str:
        return "'" + pattern.replace("'", "''") + "'"

    def month(self, x: str) -> str:
        return f"cast(date_trunc('month', {x}) as timestamp)"

    def month_key(self, x: str) -> str:
        return f"strftime({x}, '%Y-%m')"

    def micros(self, x: str) -> str:
        return f"epoch_us({x})"

    def days(self, a: str, b: str) -> str:
        return f"cast(cast({a} as date) - cast({b} as date) as bigint)"

    def all(self, text: str, pattern: str) -> str:
        return f"regexp_extract_all({text}, {self.re(pattern)})"

    def count(self, text: str, pattern: str) -> str:
        return f"cast(len({self.all(text, pattern)}) as bigint)"

    def like(self, text: str, pattern: str) -> str:
        return f"regexp_matches({text}, {self.re(pattern)})"

    def sub(self, text: str, pattern: str, to: str) -> str:
        return f"regexp_replace({text}, {self.re(pattern)}, '{to}', 'g')"

    def split(self, text: str, pattern: str) -> str:
        return f"regexp_split_to_array({text}, {self.re(pattern)})"

    def at(self, arr: str, i: str) -> str:
        return f"{arr}[cast({i} as int)]"

    def seq(self, a: str, b: str) -> str:
        return f"range(cast({a} as bigint), cast({b} as bigint) + 1)"

    def part(self, arr: str, start: str, n: str) -> str:
        return f"list_slice({arr}, cast({start} as bigint), cast({start} as bigint) + cast({n} as bigint) - 1)"

    def map(self, arr: str, x: str, body: str) -> str:
        return f"list_transform({arr}, lambda {x}: {body})"

    def keep(self, arr: str, x: str, body: str) -> str:
        return f"list_filter({arr}, lambda {x}: {body})"

    def total(self, arr: str) -> str:
        return f"coalesce(list_sum({arr}), 0.0)"

    def join(self, arr: str, sep: str) -> str:
        return f"array_to_string({arr}, '{sep}')"

    def gather(self, x: str, order: str) -> str:
        return f"list({x} order by {order})"

    def plus(self, x: str, days: int) -> str:
        return f"({x} + interval {days} day)"

    def sha(self, x: str) -> str:
        return f"sha256({x})"

    def json(self, x: str, key: str) -> str:
        return f"json_extract_string(case when json_valid({x}) then {x} end, '$.{key}')"

    def ntz(self, x: str) -> str:
        return f"cast({x} as timestamp)"

    def div(self, a: str, b: str) -> str:
        return f"({a}) / nullif({b}, 0)"

    def argmax(self, x: str, by: str) -> str:
        return f"arg_max({x}, {by})"

    def argmin(self, x: str, by: str) -> str:
        return f"arg_min({x}, {by})"

    def skew(self, x: str) -> str:
        m = f"avg({x})"
        third = f"(avg({x} * {x} * {x}) - 3 * {m} * avg({x} * {x}) + 2 * {m} * {m} * {m})"
        return f"(case when count({x}) < 3 or coalesce(var_pop({x}), 0) = 0 then 0.0 else {third} / power(var_pop({x}), 1.5) end)"

    def struct(self, **fields: str) -> str:
        return "{" + ", ".join(f"'{k}': {v}" for k, v in fields.items()) + "}"


def spelled(name: str, oracle: str, *tables: str) -> Callable[[Callable[[], str]], Callable[[], str]]:
    """Register a query in Spark's SQL with an oracle that is written by hand, not made from the same text."""

    def add(f: Callable[[], str]) -> Callable[[], str]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return spark.sql(f(), **{t: table(spark, sf_dir, t) for t in tables})

        run.__doc__ = f.__doc__
        QUERIES[name], ORACLE[name] = run, oracle
        return f

    return add


def both(name: str, *tables: str) -> Callable[[Callable[[Spark], str]], Callable[[Spark], str]]:
    """Register a query whose text is a function of the dialect; the named tables are its inputs."""

    def add(f: Callable[[Spark], str]) -> Callable[[Spark], str]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return spark.sql(f(Spark()), **{t: table(spark, sf_dir, t) for t in tables})

        run.__doc__ = f.__doc__
        QUERIES[name], ORACLE[name] = run, f(Duck())
        return f

    return add
