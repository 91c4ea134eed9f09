"""The few places where Spark SQL and DuckDB SQL differ, so that one text can state a query for both."""

from __future__ import annotations


class Spark:
    name = "spark"
    div = "div"
    pct = "percentile"
    now = "TIMESTAMP_NTZ'2001-09-30 00:00:00'"

    def base(self, table: str) -> str:
        return f"motorlens_{table}"

    def trunc(self, x: str) -> str:
        """Whole number, cut towards zero."""
        return f"CAST({x} AS BIGINT)"

    def days(self, start: str, n: str) -> str:
        return f"date_add({start}, CAST({n} AS INT))"

    def between_days(self, start: str, end: str) -> str:
        return f"datediff(CAST({end} AS DATE), CAST({start} AS DATE))"

    def percent(self, x: str) -> str:
        """Mean of a share of two decimals as a percentage of two, halves up; from whole numbers, so that the order of the rows doesn't count."""
        return f"((200 * sum(CAST(round({x} * 100) AS BIGINT)) + count({x})) div (2 * count({x}))) / 100.0D"

    def words(self, x: str) -> str:
        """Lower-case runs of letters and digits."""
        return f"filter(split(regexp_replace(lower({x}), '[^\\\\p{{L}}\\\\p{{Nd}}]+', ' '), ' '), w -> w <> '')"

    def joined(self, x: str, by: str) -> str:
        return f"listagg({x}, ',') WITHIN GROUP (ORDER BY {by})"

    def size(self, x: str) -> str:
        return f"size({x})"

    def values(self, rows: str, names: str) -> str:
        return f"(SELECT * FROM VALUES {rows} AS t({names}))"

    def json(self, x: str, key: str) -> str:
        return f"get_json_object({x}, '$.{key}')"

    def listed(self, n: str, fields: dict[str, str]) -> str:
        """A list of ``n`` (0: none) structures of ``fields``, whose texts may name the running number ``i``."""
        return f"CASE WHEN {n} > 0 THEN transform(sequence(1, {n}), i -> named_struct({', '.join(f'{chr(39)}{k}{chr(39)}, {v}' for k, v in fields.items())})) END"

    def hash60(self, x: str) -> str:
        """The first 60 bits of the MD5 of a text."""
        return f"CAST(conv(substr(md5({x}), 1, 15), 16, 10) AS BIGINT)"

    def xor(self, x: str, y: str) -> str:
        return f"({x} ^ {y})"

    def item(self, x: str, i: int) -> str:
        """Element ``i`` (from 0) of a list."""
        return f"{x}[{i}]"

    def pcts(self, x: str, shares: tuple) -> str:
        """Several percentiles from one buffer."""
        return f"percentile({x}, array({', '.join(map(str, shares))}))"

    def rx(self, x: str, pattern: str) -> str:
        return f"{x} RLIKE '{pattern}'"


class Duck(Spark):
    name = "duckdb"
    div = "//"
    pct = "quantile_cont"
    now = "TIMESTAMP '2001-09-30 00:00:00'"

    def base(self, table: str) -> str:
        return table

    def trunc(self, x: str) -> str:
        return f"CAST(trunc({x}) AS BIGINT)"

    def days(self, start: str, n: str) -> str:
        return f"CAST({start} + CAST({n} AS INT) AS DATE)"

    def between_days(self, start: str, end: str) -> str:
        return f"date_diff('day', CAST({start} AS DATE), CAST({end} AS DATE))"

    def percent(self, x: str) -> str:
        return f"round(100 * avg({x}), 2)"

    def words(self, x: str) -> str:
        return f"list_filter(string_split(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{Nd}}]+', ' ', 'g'), ' '), lambda w: w <> '')"

    def joined(self, x: str, by: str) -> str:
        return f"string_agg({x}, ',' ORDER BY {by})"

    def size(self, x: str) -> str:
        return f"len({x})"

    def values(self, rows: str, names: str) -> str:
        return f"(SELECT * FROM (VALUES {rows}) AS t({names}))"

    def json(self, x: str, key: str) -> str:
        return f"json_extract_string({x}, '$.{key}')"

    def listed(self, n: str, fields: dict[str, str]) -> str:
        return f"list_transform(range(1, {n} + 1), lambda i: {{{', '.join(f'{chr(39)}{k}{chr(39)}: {v}' for k, v in fields.items())}}})"

    def hash60(self, x: str) -> str:
        return f"CAST('0x' || substr(md5({x}), 1, 15) AS BIGINT)"

    def xor(self, x: str, y: str) -> str:
        return f"xor({x}, {y})"

    def item(self, x: str, i: int) -> str:
        return f"{x}[{i + 1}]"

    def pcts(self, x: str, shares: tuple) -> str:
        return f"quantile_cont({x}, [{', '.join(map(str, shares))}])"

    def rx(self, x: str, pattern: str) -> str:
        return f"regexp_matches({x}, '{pattern}')"


SPARK, DUCK = Spark(), Duck()
