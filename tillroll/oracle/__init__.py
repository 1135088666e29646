"""DuckDB statements used as the correctness oracle (tests and the driver)."""

from __future__ import annotations

from tillroll.oracle.fixtures_sql import with_fixtures


def oracle_statements() -> dict[str, str]:
    from tillroll.oracle import insights_sql, reports_sql, writes_sql
    out: dict[str, str] = {}
    for mod in (reports_sql, writes_sql, insights_sql):
        for name, (tables, body) in mod.SQL.items():
            out[name] = with_fixtures(tables, body)
    # In batches, the result is that of all at once.
    for name, whole in (("merge_cart_lines_batches", "merge_cart_lines"), ("sessionize_logins_batches", "sessionize_logins"),
                        ("daily_history_kept", "daily_history"), ("apply_order_status_stored", "apply_order_status")):
        out[name] = out[whole]
    return out
