"""DuckDB text of the derived point-of-sale tables (FIXTURES.md).

Each oracle statement carries the definitions it needs as CTEs named
``pos_<table>``; the raw Parquet tables are the driver's views.
"""

from __future__ import annotations

T0 = "TIMESTAMP '2024-01-01 00:00:00'"


def ADD(n: str, t: str) -> str:
    return f"({t} + to_seconds(cast({n} as bigint)))"


def SEC(ts: str) -> str:
    return f"date_trunc('second', {ts})"


# name -> (dependencies, select text)
DEFS: dict[str, tuple[tuple[str, ...], str]] = {
    "users": ((), f"""select cast(c_custkey as bigint) id, 'user'||c_custkey username, c_name name,
        'user'||c_custkey||'@example.org' email,
        case c_custkey%25 when 0 then 'Manager' when 1 then 'Kitchen' else 'Cashier' end role,
        case when c_acctbal<0 then 'disabled' else 'active' end is_active,
        {ADD('c_custkey*61', T0)} created_at from customer"""),
    "categories": ((), """select cast(dense_rank() over(order by p_type) as int) id, p_type name
        from (select distinct p_type from part) t"""),
    "products": (("categories",), """select cast(p_partkey as bigint) id, c.id category_id,
        p_name||' '||p_partkey name, p_brand description,
        cast(p_retailprice as decimal(10,2)) base_price,
        case when p_size%3=0 then '/img/'||p_partkey end image_url,
        case when p_size%5=0 then 0 else 1 end is_available
        from part join pos_categories c on c.name=p_type"""),
    "product_sizes": (("products",), """select id*3+k id, id product_id,
        case k when 0 then 'Small' when 1 then 'Medium' else 'Large' end label,
        cast(base_price+50*k as decimal(10,2)) price
        from pos_products cross join (values (0),(1),(2)) x(k) where id%3=0"""),
    "product_addons": (("products",), """select id*2+k id, id product_id, 'Addon '||k name,
        cast(5+10*k as decimal(10,2)) extra_price,
        case when (id+k)%3=0 then 0 else 1 end is_available
        from pos_products cross join (values (0),(1)) x(k) where id%4=1"""),
    "orders_base": ((), f"""select o_orderkey id, o_custkey cashier_id,
        o_custkey*4+o_orderkey%4 session_id,
        case o_orderstatus when 'F' then 'completed' when 'P' then 'pending'
          else case cast(floor(o_orderkey/30) as bigint)%3 when 0 then 'voided'
               when 1 then 'refunded' else 'held' end end status,
        cast(o_totalprice as decimal(10,2)) subtotal,
        case when o_orderpriority='1-URGENT' then 'rush' end notes,
        case when o_orderkey%2=0 then 'cash' else 'gcash' end payment_method,
        {ADD('(o_orderkey%30)*86400+(o_orderkey*7919)%86400', T0)} created_at from orders"""),
    "orders": (("orders_base",), f"""select id,cashier_id,session_id,status,subtotal,
        cast(round(subtotal*0.12,2) as decimal(10,2)) tax_amount,
        cast(case when id%4=0 then round(subtotal*0.05,2) else 0 end as decimal(10,2)) discount_amount,
        cast(case when id%4=0 then round(subtotal*1.07,2) else round(subtotal*1.12,2) end
             as decimal(10,2)) total,
        payment_method, notes, created_at,
        case when status in ('completed','refunded') then {ADD('60+id%1800', 'created_at')} end completed_at,
        case when status in ('completed','refunded') and id%5<>0 then (id%6)*25+1 end completed_by,
        case when status='voided' then {ADD('120+id%3600', 'created_at')} end voided_at,
        case when status='refunded' then {ADD('3600+(id*31)%90000', 'created_at')} end refunded_at
        from pos_orders_base"""),
    "lines": ((), """select l_orderkey*1000+row_number() over(partition by l_orderkey
          order by l_linenumber,l_partkey,l_suppkey,l_quantity,l_extendedprice,l_shipdate,l_discount,l_tax) id,
        l_orderkey order_id, l_partkey product_id, l_suppkey, l_linenumber, l_returnflag,
        cast(l_quantity as int) quantity, cast(l_extendedprice as decimal(10,2)) unit_price
        from lineitem"""),
    "order_items": (("lines", "products", "product_sizes"), """select l.id, l.order_id, l.product_id,
        p.name product_name, s.id product_size_id, s.label size_label, l.quantity, l.unit_price,
        cast(l.quantity*l.unit_price as decimal(10,2)) line_subtotal
        from pos_lines l join pos_products p on p.id=l.product_id
        left join pos_product_sizes s on s.product_id=l.product_id and s.id=l.product_id*3+l.l_linenumber%4"""),
    "order_item_addons": (("lines", "product_addons"), """select l.id*2+a.id%2 id, l.id order_item_id,
        a.id addon_id, a.name addon_name, l.quantity, a.extra_price addon_price,
        cast(l.quantity*a.extra_price as decimal(10,2)) addon_subtotal
        from pos_lines l join pos_product_addons a on a.product_id=l.product_id where l.l_suppkey%2=0"""),
    "payments": (("orders",), """select id, id order_id, payment_method, total amount_due,
        total amount_received, cast(0 as decimal(10,2)) change_due,
        cast(null as varchar(100)) reference_no, created_at paid_at
        from pos_orders where status<>'held'"""),
    "user_sessions": ((), f"""select event_id id, user_id, {SEC('ts')} logged_in_at,
        case when event_id%7<>0 then {ADD('cast(floor(value*60) as bigint)', SEC('ts'))} end logged_out_at
        from events where event_type='signup'"""),
    "login_events": ((), """select event_id id, user_id, ts,
        case event_type when 'signup' then 'login' else 'logout' end event_type
        from events where event_type in ('signup','error')"""),
    "registrations": ((), f"""select cast(s_suppkey+1 as bigint) id,
        case when s_suppkey%10=0 then 'USER'||s_suppkey else 'applicant'||s_suppkey end username,
        s_name name,
        case when s_suppkey%10=1 then 'user'||s_suppkey||'@example.org'
             else 'applicant'||s_suppkey||'@example.org' end email,
        'Cashier' role, case when s_suppkey%6=5 then 'Rejected' else 'Pending' end status,
        {ADD('s_suppkey*3600', T0)} submitted_at from supplier"""),
    "registration_requests": ((), """select cast(s_suppkey+1 as bigint) registration_id from supplier
        where s_suppkey%3<>2 union all select 1000000"""),
    "signups": ((), f"""select cast(s_suppkey as bigint) id,
        case when s_suppkey%4=0 then 'user'||s_suppkey when s_suppkey%4=1 then 'Applicant'||s_suppkey
             when s_suppkey%7<5 then 'New'||(s_suppkey//7) else 'new'||s_suppkey||'x' end username,
        case when s_suppkey%14<6 then 'pair'||(s_suppkey//14)||'@example.org'
             else 'new'||s_suppkey||'@example.org' end email,
        {ADD('((s_suppkey*37)%1009)*60', T0)} requested_at from supplier"""),
    "status_events": (("lines", "orders"), f"""select l.order_id, l.id seq,
        case l.l_returnflag when 'A' then 'complete' when 'N' then 'voided' else 'refunded' end event_type,
        case when l.l_suppkey%5=0 then 1 else o.cashier_id end actor_id,
        {ADD('(l.id%1000)*60', 'o.created_at')} event_time
        from pos_lines l join pos_orders o on o.id=l.order_id where l.l_suppkey%2=1"""),
    "staff_updates": ((), """select event_id seq, user_id,
        case event_type when 'error' then 'disabled' when 'click' then 'active' else 'paused' end is_active,
        user_id+event_id%2 manager_id from events where event_type in ('error','click','view')"""),
    "availability_updates": ((), """select event_id seq, cast(event_id%200 as bigint) product_id,
        cast(event_id%3 as int) is_available from events where event_type='view'"""),
    "image_updates": ((), """select event_id seq, cast(event_id%200 as bigint) product_id,
        '/assets/products/product_'||event_id||'.png' image_url from events where event_type='purchase'"""),
    "carts": ((), f"""select o_orderkey cart_id, o_custkey cashier_id, o_orderkey%4=0 discount,
        case o_orderkey%3 when 0 then 'cash' when 1 then 'gcash' else 'card' end payment_method,
        case o_orderpriority when '1-URGENT' then chr(10)||' rush'||chr(9) when '2-HIGH' then chr(10) else '' end notes,
        {ADD('(o_orderkey%30)*86400+(o_orderkey*7919)%86400', T0)} created_at from orders"""),
    "cart_lines": (("lines", "product_sizes"), """select l.id line_id, l.order_id cart_id, l.product_id,
        s.id size_id, case when l.quantity%10=0 then 0 else l.quantity end quantity,
        l.l_suppkey%2=0 with_addons
        from pos_lines l left join pos_product_sizes s
          on s.product_id=l.product_id and s.id=l.product_id*3+l.l_linenumber%4"""),
    "cart_adds": (("lines",), """select id seq, order_id cart_id, product_id%7 product_id,
        cast(null as int) size_id, product_id%2 addon_id,
        case when id%11=0 then 0 when l_returnflag='R' then -1 else 1 end change from pos_lines"""),
}


def _closure(names) -> list[str]:
    order: list[str] = []

    def visit(n):
        if n in order:
            return
        for d in DEFS[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    return order


def with_fixtures(tables, body: str) -> str:
    """One statement: the CTEs ``tables`` need (in dependency order) + ``body``.

    ``body`` may start with further CTEs of its own (``name AS (...), ...``
    followed by the final select); pass it with a leading comma then.
    """
    ctes = ",\n".join(f"pos_{n} AS ({DEFS[n][1]})" for n in _closure(tables))
    if body.lstrip().startswith(","):
        return f"WITH RECURSIVE {ctes}{body}"
    return f"WITH RECURSIVE {ctes}\n{body}"
