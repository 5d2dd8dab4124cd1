"""The few places where Spark SQL and DuckDB spell the same expression differently."""

from __future__ import annotations


class Spark:
    name = "spark"
    S = "STRING"
    explode = "explode"

    @staticmethod
    def text(pattern: str) -> str:
        """A string literal without escapes."""
        return "r'" + pattern.replace("'", "''") + "'" if "'" not in pattern else 'r"' + pattern + '"'

    def rlike(self, x: str, pattern: str) -> str:
        return f"({x} RLIKE {self.text(pattern)})"

    def replace_all(self, x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, {self.text(pattern)}, {self.text(by)})"

    def extract(self, x: str, pattern: str, group: int = 1) -> str:
        return f"regexp_extract({x}, {self.text(pattern)}, {group})"

    def extract_all(self, x: str, pattern: str) -> str:
        return f"regexp_extract_all({x}, {self.text(pattern)}, 0)"

    def words(self, x: str) -> str:
        """Words of a text that is not blank."""
        return f"split(trim({x}), {self.text('[ \\t\\n\\r\\f\\x0B]+')})"

    def transform(self, array: str, var: str, body: str) -> str:
        return f"transform({array}, {var} -> {body})"

    def sequence(self, a: str, b: str) -> str:
        return f"sequence({a}, {b})"

    def size(self, x: str) -> str:
        return f"size({x})"

    def joined(self, x: str, order: str | None = None, sep: str = ",") -> str:
        """Group concatenation in order."""
        if order is None:
            return f"array_join(sort_array(collect_list({x})), '{sep}')"
        return f"array_join(transform(sort_array(collect_list(struct({order}, {x} AS joined_value))), s -> s.joined_value), '{sep}')"

    def percentile(self, x: str, p: float) -> str:
        return f"percentile({x}, {p})"

    def day(self, ts: str) -> str:
        return f"date_format({ts}, 'yyyyMMdd')"

    def json_field(self, x: str, field: str) -> str:
        return f"get_json_object({x}, '$.{field}')"

    def slice(self, array: str, start: str, length: str) -> str:
        return f"slice({array}, {start}, {length})"

    def join_array(self, array: str, sep: str = " ") -> str:
        return f"array_join({array}, '{sep}')"

    def distinct(self, array: str) -> str:
        return f"array_distinct({array})"

    def concat_arrays(self, *arrays: str) -> str:
        return f"concat({', '.join(arrays)})"

    def try_int(self, x: str) -> str:
        return f"try_cast({x} AS INT)"

    def md5_number(self, x: str) -> str:
        """A stable pseudo-random number below 2**28 from a string."""
        return f"CAST(conv(substr(md5({x}), 1, 7), 16, 10) AS BIGINT)"

    def atan2(self, y: str, x: str) -> str:
        return f"atan2({y}, {x})"


class Duck(Spark):
    name = "duckdb"
    S = "VARCHAR"
    explode = "unnest"

    @staticmethod
    def text(pattern: str) -> str:
        return "'" + pattern.replace("'", "''") + "'"

    def rlike(self, x: str, pattern: str) -> str:
        return f"regexp_matches({x}, {self.text(pattern)})"

    def replace_all(self, x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, {self.text(pattern)}, {self.text(by.replace('$', chr(92)))}, 'g')"

    def extract_all(self, x: str, pattern: str) -> str:
        return f"regexp_extract_all({x}, {self.text(pattern)})"

    def words(self, x: str) -> str:
        return f"string_split_regex(trim({x}, chr(32) || chr(9) || chr(10) || chr(13)), {self.text('[ \\t\\n\\r\\f\\x0B]+')})"

    def transform(self, array: str, var: str, body: str) -> str:
        return f"list_transform({array}, lambda {var}: {body})"

    def sequence(self, a: str, b: str) -> str:
        return f"generate_series({a}, {b})"

    def size(self, x: str) -> str:
        return f"len({x})"

    def joined(self, x: str, order: str | None = None, sep: str = ",") -> str:
        return f"string_agg({x}, '{sep}' ORDER BY {order or x})"

    def percentile(self, x: str, p: float) -> str:
        return f"quantile_cont({x}, {p})"

    def day(self, ts: str) -> str:
        return f"strftime({ts}, '%Y%m%d')"

    def json_field(self, x: str, field: str) -> str:
        return f"({x}->>'$.{field}')"

    def slice(self, array: str, start: str, length: str) -> str:
        return f"list_slice({array}, {start}, {start} + {length} - 1)"

    def join_array(self, array: str, sep: str = " ") -> str:
        return f"array_to_string({array}, '{sep}')"

    def distinct(self, array: str) -> str:
        """By place, for list_distinct does not keep the order."""
        return f"list_filter({array}, lambda v, k: list_position({array}, v) = k)"

    def concat_arrays(self, *arrays: str) -> str:
        return f"list_concat({', '.join(arrays)})"

    def try_int(self, x: str) -> str:
        return f"TRY_CAST({x} AS INTEGER)"

    def md5_number(self, x: str) -> str:
        return f"CAST(('0x' || substr(md5({x}), 1, 7)) AS BIGINT)"


SPARK, DUCK = Spark(), Duck()
