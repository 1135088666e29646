"""DuckDB oracle text for the browser-side computations."""

from __future__ import annotations

from tillroll.oracle.reports_sql import AS_OF, SQL as REPORTS
from tillroll.schema import CATEGORY_EMOJIS, CATEGORY_NAMES, PESO

MENU_TABLES, MENU = REPORTS["active_menu"]
DAILY_TABLES, DAILY = REPORTS["daily_report"]
HOURS_TABLES, HOURS = REPORTS["hours_report"]
TX_TABLES, TX = REPORTS["cashier_transactions"]


def _header(col: str) -> str:
    cases = " ".join(f"when {k} then '{CATEGORY_EMOJIS[k]} {v}'" for k, v in CATEGORY_NAMES.items())
    return f"case {col} {cases} else ' Category ' || {col} end"


def _tenths(n: str, d: int) -> str:
    t = f"((abs({n}) * 10 + {d // 2}) // {d})"
    return f"(case when {t} <> 0 and {n} < 0 then '-' else '' end || ({t} // 10)::varchar || '.' || ({t} % 10)::varchar)"


def _count_rows(name: str, today: str, yday: str) -> str:
    d = f"({today} - {yday})"
    signed = f"(case when {d} > 0 then '+' else '' end || format('{{:,}}', {d}))"
    return (f"select '{name}' metric, format('{{:,}}', {today}) today, "
            f"case when {d} = 0 then '0' else {signed} end delta, "
            f"case when {d} = 0 then 'No change vs yesterday' else {signed} || ' vs yesterday' end comparison "
            f"from d")


def _peso_whole(x: str) -> str:
    return f"'{PESO}' || format('{{:,.0f}}', round(cast({x} as decimal(18,2)), 0))"


def _money_rows(name: str, today: str, yday: str) -> str:
    d = f"cast({today} - {yday} as decimal(18,2))"
    sign = f"(case when {d} > 0 then '+' else '-' end)"
    return (f"select '{name}' metric, {_peso_whole(today)} today, "
            f"case when {d} = 0 then '{PESO}0' else {sign} || {_peso_whole(f'abs({d})')} end delta, "
            f"case when {d} = 0 then 'No change vs yesterday' "
            f"else {sign} || '{PESO}' || format('{{:,.2f}}', abs({d})) || ' vs yesterday' end comparison from d")


def _hours_rows() -> str:
    d = "(seconds_clocked - seconds_clocked_yesterday)"
    sign = f"(case when {d} > 0 then '+' else '-' end)"
    return (f"select 'hours' metric, {_tenths('seconds_clocked', 3600)} || 'h' today, "
            f"staff_count::varchar || ' staff' delta, "
            f"case when {d} = 0 then 'No change vs yesterday' "
            f"else {sign} || {_tenths(f'abs({d})', 3600)} || 'h vs yesterday' end comparison from h")


COMPARISON = (f", d AS ({DAILY}), h AS ({HOURS})\n"
              + "\nunion all\n".join([
                  _count_rows("transactions", "transactions_made", "transactions_made_yesterday"),
                  _money_rows("revenue", "daily_revenue", "daily_revenue_yesterday"),
                  _count_rows("refunded", "orders_refunded", "orders_refunded_yesterday"),
                  _count_rows("voided", "orders_voided", "orders_voided_yesterday"),
                  _hours_rows()]))

METRICS = ("transactions_made", "daily_revenue", "orders_refunded", "refunded_total",
           "orders_voided", "voided_total", "seconds_clocked", "staff_count")


def _money(m: str) -> bool:
    return m.endswith(("revenue", "total"))


def _cast(expr: str, m: str) -> str:
    return f"cast({expr} as {'decimal(18,2)' if _money(m) else 'bigint'})"


def _history() -> str:
    def cnt(s):
        return f"sum(case when status = '{s}' then 1 else 0 end)::bigint"

    def amt(s):
        return f"cast(sum(case when status = '{s}' then total else 0 end) as decimal(18,2))"

    od = f"""od AS (select day, {cnt('completed')} transactions_made, {amt('completed')} daily_revenue,
          {cnt('refunded')} orders_refunded, {amt('refunded')} refunded_total,
          {cnt('voided')} orders_voided, {amt('voided')} voided_total
        from (select status, total, cast(case status when 'completed' then completed_at
                                                    when 'refunded' then refunded_at
                                                    when 'voided' then voided_at end as date) AS day
              from pos_orders) x where day is not null group by day)"""
    sd = f"""sd AS (select cast(logged_in_at as date) AS day,
          sum(date_sub('second', logged_in_at, coalesce(logged_out_at, {AS_OF})))::bigint seconds_clocked,
          count(distinct user_id)::bigint staff_count
        from pos_user_sessions group by 1)"""
    cols = ", ".join(_cast(f"coalesce({'od' if i < 6 else 'sd'}.{m}, 0)", m) + f" {m}"
                     for i, m in enumerate(METRICS))
    spine = f"""spine AS (select cast(unnest(generate_series(
          least(min(day), cast({AS_OF} as date))::timestamp, greatest(max(day), cast({AS_OF} as date))::timestamp,
          interval 1 day)) as date) AS day from (select day from od union all select day from sd))"""
    days = (f"{spine}, days AS (select spine.day, {cols} from spine left join od on od.day = spine.day "
            f"left join sd on sd.day = spine.day)")
    ycols = ", ".join(_cast(f"coalesce(y.{m}, 0)", m) + f" {m}_yesterday" for m in METRICS)
    return f", {od}, {sd}, {days} select t.*, {ycols} from days t left join days y on y.day = t.day - 1"


SHOWING = ("'Showing ' || product_count::varchar || case when product_count = 1 then ' item' else ' items' end "
           "showing_text")

SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "category_counts": (("products", "categories"), f"""select category, product_count, {SHOWING} from (
        select cast(c.id as varchar) category, count(p.id)::bigint product_count
        from pos_categories c left join pos_products p on p.category_id = c.id group by c.id
        union all select 'all', count(*)::bigint from pos_products) t"""),
    "category_counts_available": (("products", "categories"), f"""select category, product_count, {SHOWING} from (
        select cast(c.id as varchar) category, count(p.id)::bigint product_count
        from pos_categories c left join pos_products p on p.category_id = c.id and p.is_available = 1
        group by c.id
        union all select 'all', count(*)::bigint from pos_products where is_available = 1) t"""),
    "menu_by_category": (MENU_TABLES, f"select * from ({MENU}) m where m.category_id = 2"),
    "products_grouped": (MENU_TABLES, f"""select category_id, {_header('category_id')} header,
          row_number() over (partition by category_id order by id) - 1 pos,
          id, name, description, base_price, image_url, has_options
        from ({MENU}) m"""),
    "kitchen_status": (("orders",), f"""select active_orders,
          case when active_orders > 0 then m else 0 end oldest_wait_minutes,
          case when active_orders = 0 then '0m' when m < 60 then m::varchar || 'm'
               else (m // 60)::varchar || 'h ' || (m % 60)::varchar || 'm' end oldest_wait
        from (select count(*)::bigint active_orders,
                greatest(floor(date_sub('second', min(created_at), {AS_OF}) / 60), 0)::bigint m
              from pos_orders where status = 'pending') k"""),
    "daily_comparison": (tuple(sorted(set(DAILY_TABLES + HOURS_TABLES))), COMPARISON),
    "daily_history": (("orders", "user_sessions"), _history()),
    "transaction_labels": (TX_TABLES, f"""select id, cashier_id, 'Order #' || id title,
          coalesce(completed_at, created_at) display_time, item_count::varchar || ' item(s)' items_text,
          '{PESO}' || format('{{:,.2f}}', total) total_text, status,
          upper(substr(status, 1, 1)) || substr(status, 2) || ' Order' status_title
        from ({TX}) t"""),
}
