"""Helpers that assemble the DuckDB oracle strings."""

from __future__ import annotations

from sparkfeat.sources.fixtures import ORDER_PROFILE_SQL


def with_profile(*ctes: str) -> str:
    """WITH order_profile AS (...), <ctes>"""
    parts = [ORDER_PROFILE_SQL.strip()] + [c.strip() for c in ctes if c]
    return "WITH " + ",\n".join(parts) + "\n"


def union_stats(cols, table: str, select_tmpl: str, where_notnull: bool = True,
                group: str = "") -> str:
    """UNION ALL of one SELECT per column; ``{c}`` is the column name."""
    outs = []
    for c in cols:
        w = f" WHERE {c} IS NOT NULL" if where_notnull else ""
        g = (" GROUP BY " + group.format(c=c)) if group else ""
        outs.append(f"SELECT '{c}' AS feature, " + select_tmpl.format(c=c) + f" FROM {table}{w}{g}")
    return "\nUNION ALL\n".join(outs)


def r6(expr: str) -> str:
    # + 0.0 turns -0.0 into 0.0, as Spark's decimal rounding does
    return f"(round({expr}, 6) + 0.0)"


def sig6_sql(expr: str) -> str:
    """6 significant digits with exact powers of ten (twin of ``sig6``)."""
    e = f"CAST(floor(log10(abs({expr}))) AS INTEGER)"
    return (f"(CASE WHEN {expr} IS NULL OR {expr} = 0 THEN {expr} "
            f"WHEN 5 - {e} >= 0 THEN round({expr} * pow(10, 5 - {e})) / pow(10, 5 - {e}) "
            f"ELSE round({expr} / pow(10, {e} - 5)) * pow(10, {e} - 5) END)")
