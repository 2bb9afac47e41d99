"""The few words in which Spark SQL and DuckDB differ."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


class Spark:
    name = "spark"

    def t(self, table: str) -> str:
        return "{" + table + "}"

    def days(self, a: str, b: str) -> str:
        return f"datediff({b}, {a})"

    def half_even(self, x: str, n: int = 0) -> str:
        return f"bround({x}, {n})"

    def sha256(self, x: str) -> str:
        return f"sha2(cast({x} as binary), 256)"

    def strset(self, x: str) -> str:
        return f"array_join(array_sort(collect_set(cast({x} as string))), ',')"

    def percentile(self, x: str, p: float) -> str:
        return f"percentile({x}, {p})"

    def like(self, x: str, pattern: str) -> str:
        return f"regexp_like({x}, r'{pattern}')"

    def replace(self, x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, r'{pattern}', '{by}')"

    def json(self, x: str, key: str) -> str:
        return f"get_json_object({x}, '$.{key}')"

    def contains(self, x: str, y: str) -> str:
        return f"contains({x}, {y})"

    def words(self, x: str) -> str:
        return f"array_distinct(regexp_extract_all(lower({x}), r'[a-z0-9]+', 0))"

    def overlap(self, a: str, b: str) -> str:
        return f"size(array_intersect({a}, {b}))"

    def div(self, a: str, b: str) -> str:
        return f"({a} div {b})"

    def first_chars(self, x: str, n: int) -> str:
        return f"substring({x}, 1, {n})"

    def spark_sql(self, session: SparkSession, sf_dir: str, sql: str, **frames: DataFrame) -> DataFrame:
        used = {t: session.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in sql}
        return session.sql(sql, **used, **frames)


class Duck(Spark):
    name = "duckdb"

    def t(self, table: str) -> str:
        return table

    def days(self, a: str, b: str) -> str:
        return f"date_diff('day', {a}, {b})"

    def half_even(self, x: str, n: int = 0) -> str:
        return f"round_even({x}, {n})"

    def sha256(self, x: str) -> str:
        return f"sha256({x})"

    def strset(self, x: str) -> str:
        return f"string_agg(DISTINCT cast({x} as varchar), ',' ORDER BY cast({x} as varchar))"

    def percentile(self, x: str, p: float) -> str:
        return f"quantile_cont({x}, {p})"

    def like(self, x: str, pattern: str) -> str:
        return f"regexp_matches({x}, '{pattern}')"

    def replace(self, x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, '{pattern}', '{by}', 'g')"

    def json(self, x: str, key: str) -> str:
        return f"json_extract_string({x}, '$.{key}')"

    def words(self, x: str) -> str:
        return f"list_distinct(regexp_extract_all(lower({x}), '[a-z0-9]+'))"

    def overlap(self, a: str, b: str) -> str:
        return f"len(list_intersect({a}, {b}))"

    def div(self, a: str, b: str) -> str:
        return f"({a} // {b})"


SPARK, DUCK = Spark(), Duck()
