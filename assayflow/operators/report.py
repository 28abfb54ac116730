"""Result presentation helpers shared by the registered queries."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

REPORT_DECIMALS = 6
#: Probabilities keep this many digits after the first, however small they are.
REPORT_DIGITS = 6
P_COLUMNS = ("p_value", "p_bh", "p_threshold", "LR_P_Value")
#: Values this close below a half count as the half, so that two engines
#: whose sums differ in the last bits round an exact half alike.
HALF_MARGIN = 1.3e-9


def significant(value: Column, digits: int = REPORT_DIGITS) -> Column:
    """A value with ``digits`` digits after its first one."""
    return F.when(value == 0, F.lit(0.0)).when(
        value.isNotNull(), F.format_string(f"%.{digits}e", value).cast("double"))


def round_doubles(df: DataFrame, decimals: int = REPORT_DECIMALS) -> DataFrame:
    """Round every floating column: probabilities to significant digits, all
    others to a fixed number of decimals.

    Used for exchanged result tables: two engines summing the same doubles in
    a different order differ in the last bits, and p-values from an
    incomplete-beta routine and from numerical integration agree to ~1e-10.
    The library operators themselves return full precision.
    """
    def shown(name: str) -> Column:
        value = F.col(f"`{name}`")
        return significant(value) if name in P_COLUMNS else F.round(value + HALF_MARGIN, decimals)

    return df.select(*[shown(f.name).alias(f.name) if isinstance(f.dataType, (DoubleType, FloatType))
                       else F.col(f"`{f.name}`") for f in df.schema.fields])


def sql_round(expr: str, decimals: int = REPORT_DECIMALS) -> str:
    return f"round({expr}, {decimals})"


def _closing(sql: str, at: int) -> int:
    """The index of the bracket that closes the one at ``at``."""
    depth = 0
    for i in range(at, len(sql)):
        depth += {"(": 1, ")": -1}.get(sql[i], 0)
        if depth == 0:
            return i
    raise ValueError("unbalanced brackets")


def sql_reported(sql: str) -> str:
    """SQL with every ``round(x, 6)`` written as ``round_doubles`` rounds: by
    significant digits if its name is that of a probability."""
    tail = f", {REPORT_DECIMALS}"
    at = 0
    while (start := sql.find("round(", at)) >= 0:
        end = _closing(sql, start + 5)
        inner = sql[start + 6:end]
        at = start + 6
        if not inner.endswith(tail):
            continue
        value = inner[:-len(tail)]
        named = re.match(r"\s+AS\s+(\w+)", sql[end + 1:])
        if named and named.group(1) in P_COLUMNS:
            new = f"(CASE WHEN ({value}) = 0 THEN 0.0 ELSE printf('%.{REPORT_DIGITS}e', ({value}))::DOUBLE END)"
        else:
            new = f"round(({value}) + {HALF_MARGIN!r}, {REPORT_DECIMALS})"
            at = start + 7
        sql = sql[:start] + new + sql[end + 1:]
    return sql
