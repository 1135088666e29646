"""DuckDB oracle text for the batch write paths.

Order-dependent operators are written the direct way here (running sums,
LEAD and row-numbered windows over each key), independent of the Spark
operators' aggregate formulations.
"""

from __future__ import annotations

from tillroll.oracle.reports_sql import AS_OF, KITCHEN_QUEUE

Q1 = "coalesce(nullif({q}, 0), 1)"

ADDON_AVAIL = "from pos_product_addons a where a.product_id = cl.product_id and a.is_available = 1"
PRICED = f"""pl AS (select cl.line_id, cl.cart_id, cl.product_id, p.name product_name, cl.size_id,
        s.label size_label, cl.quantity, cl.with_addons,
        (case when cl.with_addons then (select count(*) {ADDON_AVAIL}) else 0 end)::bigint addon_count,
        cast(case when cl.with_addons then coalesce((select sum(a.extra_price) {ADDON_AVAIL}), 0) else 0 end
             as decimal(18,2)) addon_total,
        cast(coalesce(s.price, p.base_price)
             + case when cl.with_addons then coalesce((select sum(a.extra_price) {ADDON_AVAIL}), 0) else 0 end
             as decimal(10,2)) unit_price
      from pos_cart_lines cl join pos_products p on p.id = cl.product_id
      left join pos_product_sizes s on s.id = cl.size_id and s.product_id = cl.product_id)"""
PRICED_TABLES = ("cart_lines", "products", "product_sizes", "product_addons")

_q = Q1.format(q="quantity")
TOTALS = f"""tt AS (select cart_id, count(*)::bigint line_count, sum({_q})::bigint item_count,
        cast(sum(unit_price * {_q}) as decimal(18,2)) sub from pl group by cart_id),
    tot AS (select c.cart_id, coalesce(tt.line_count, 0)::bigint line_count, coalesce(tt.item_count, 0)::bigint item_count,
        cast(round(coalesce(tt.sub, 0), 2) as decimal(18,2)) subtotal,
        cast(round(case when c.discount then coalesce(tt.sub, 0) * 0.05 else 0 end, 2) as decimal(18,2))
          discount_amount,
        cast(round(coalesce(tt.sub, 0) * 0.12, 2) as decimal(18,2)) tax_amount,
        cast(round(coalesce(tt.sub, 0) - case when c.discount then coalesce(tt.sub, 0) * 0.05 else 0 end
                   + coalesce(tt.sub, 0) * 0.12, 2) as decimal(18,2)) total
      from pos_carts c left join tt on tt.cart_id = c.cart_id)"""
CHECKOUT = """judged AS (select c.*, tot.subtotal, tot.tax_amount, tot.discount_amount, tot.total,
        case when tot.line_count = 0 then 'no_items'
             when c.payment_method is null or c.payment_method not in ('cash', 'gcash')
             then 'invalid_payment_method' end reason
      from pos_carts c join tot on tot.cart_id = c.cart_id),
    logins AS (select user_id, logged_in_at, max(id) id, arg_max_null(logged_out_at, id) ended
      from pos_user_sessions group by user_id, logged_in_at),
    seated AS (select j.cart_id, j.cashier_id, j.created_at, l.id login,
        coalesce(l.id is not null and (l.ended is null or l.ended > j.created_at), false) still_open
      from judged j asof left join logins l on l.user_id = j.cashier_id and l.logged_in_at <= j.created_at
      where j.reason is null),
    placed AS (select cart_id, cashier_id, case when still_open then login
          else (select coalesce(max(id), 0) from pos_user_sessions)
               + first_value(cart_id) over (partition by cashier_id, login, still_open order by created_at, cart_id) end session_id,
        case when not still_open
             then min(created_at) over (partition by cashier_id, login, still_open) end opened
      from seated),
    co AS (select j.cart_id id, j.cashier_id, p.session_id::bigint session_id,
        case when j.reason is null then 'pending' end status,
        cast(round(subtotal, 2) as decimal(10,2)) subtotal, cast(round(tax_amount, 2) as decimal(10,2)) tax_amount,
        cast(round(discount_amount, 2) as decimal(10,2)) discount_amount, cast(round(total, 2) as decimal(10,2)) total,
        payment_method, nullif(trim(notes, chr(9) || chr(10) || chr(13) || ' '), '') notes, j.created_at,
        j.reason reject_reason
      from judged j left join placed p on p.cart_id = j.cart_id)"""
TOTALS_TABLES = PRICED_TABLES + ("carts",)
CHECKOUT_TABLES = TOTALS_TABLES + ("user_sessions",)

CI = "collate nocase.noaccent"


def _exists_identity(table: str, row: str) -> str:
    return (f"exists (select 1 from {table} x where x.username {CI} = {row}.username "
            f"or x.email {CI} = {row}.email)")


REQ = "req AS (select distinct registration_id from pos_registration_requests)"
PEND = "pend AS (select * from pos_registrations where status = 'Pending')"
ACCEPT = f"""acc AS (select req.registration_id,
        case when p.id is null then 'not_pending' when {_exists_identity('pos_users', 'p')} then 'conflict'
             else 'accepted' end outcome
      from req left join pend p on p.id = req.registration_id)"""
REG_TABLES = ("registration_requests", "registrations", "users")

STATUS = """ev AS (select e.*, o.id o_id, o.cashier_id o_cashier, o.status base_status, u.role actor_role
      from pos_status_events e left join pos_orders o on o.id = e.order_id
      left join pos_users u on u.id = e.actor_id),
    cl AS (select *, coalesce(o_id is not null and case when event_type in ('voided', 'refunded')
                                                       then actor_id = o_cashier
                                                       when event_type = 'complete'
                                                       then actor_role in ('Kitchen', 'Manager') end, false) valid
      from ev),
    w AS (select *, coalesce(sum(case when valid then 1 else 0 end) over (partition by order_id order by seq
                  rows between unbounded preceding and 1 preceding), 0) earlier_valid from cl),
    ap AS (select *, valid and (event_type <> 'complete' or (base_status = 'pending' and earlier_valid = 0)) applied
      from w),
    last AS (select order_id, arg_max(event_type, seq) last_type,
        max(event_time) filter (where event_type = 'complete') complete_time,
        max(actor_id) filter (where event_type = 'complete') complete_actor,
        arg_max(event_time, seq) filter (where event_type = 'voided') void_time,
        arg_max(event_time, seq) filter (where event_type = 'refunded') refund_time
      from ap where applied group by order_id)"""
STATUS_TABLES = ("orders", "status_events", "users")


def _latest(table: str, key: str, value: str, valid: str = "true") -> str:
    return f"lat AS (select {key} k, arg_max({value}, seq) v from {table} where {valid} group by {key})"


PRODUCT_COLS = "p.id, p.category_id, p.name, p.description, p.base_price, p.image_url"

HELD = """ct AS (select c.cart_id, c.cashier_id, c.created_at, c.discount,
        sum(cl.quantity)::bigint item_count, cast(sum(l.unit_price * cl.quantity) as decimal(18,2)) sub
      from pos_carts c join pos_cart_lines cl on cl.cart_id = c.cart_id join pos_lines l on l.id = cl.line_id
      join pos_products p on p.id = cl.product_id
      group by c.cart_id, c.cashier_id, c.created_at, c.discount)"""

# Sign-ups replayed one by one in (requested_at, id) order, carrying the names and mails taken so far.
REPLAY = f"""queue AS (select s.*, lower(s.username) u, lower(s.email) e, row_number() over (order by requested_at, id) turn,
        case when {_exists_identity('pos_users', 's')} then 'user_exists'
             when {_exists_identity('pos_registrations', 's')} then 'request_exists' end before
      from pos_signups s),
    replay AS (select 0::bigint turn, []::varchar[] us, []::varchar[] es, null::varchar outcome
      union all
      select q.turn, if(r.o = 'accepted', list_append(us, u), us), if(r.o = 'accepted', list_append(es, e), es), r.o
      from replay join queue q on q.turn = replay.turn + 1
      cross join lateral (select coalesce(q.before, if(list_contains(us, q.u) or list_contains(es, q.e),
                                                       'request_exists', 'accepted')) o) r)"""


def _outcomes(updates: str, table: str, key: str, refusal: str = "") -> str:
    return (f"select seq, {key}, case {refusal} when {key} not in (select id from {table}) then 'not_found' "
            f"else 'updated' end outcome from {updates}")


SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "price_lines": (PRICED_TABLES, f", {PRICED} select * from pl"),
    "merge_cart_lines": (("cart_adds",), """, k AS (select cart_id,
          product_id::varchar || '|' || coalesce(size_id::varchar, 'base') || '|' || coalesce(addon_id::varchar, '')
            cart_key, seq, change from pos_cart_adds),
        z AS (select *, max(case when change = 0 then seq end) over (partition by cart_id, cart_key) removed from k),
        r AS (select cart_id, cart_key, seq, sum(change) over (partition by cart_id, cart_key order by seq
                rows between unbounded preceding and current row) s from z where removed is null or seq > removed),
        f AS (select cart_id, cart_key, (arg_max(s, seq) - least(0, min(s)))::bigint quantity
              from r group by cart_id, cart_key)
        select * from f where quantity > 0"""),
    "cart_totals": (TOTALS_TABLES, f", {PRICED}, {TOTALS} select * from tot"),
    "checkout_orders": (CHECKOUT_TABLES, f", {PRICED}, {TOTALS}, {CHECKOUT} select * from co"),
    "checkout_items": (CHECKOUT_TABLES, f""", {PRICED}, {TOTALS}, {CHECKOUT}
        select pl.line_id id, pl.cart_id order_id, pl.product_id, pl.product_name,
          case when pl.size_id <> 0 then pl.size_id end product_size_id, nullif(pl.size_label, '') size_label,
          {_q} quantity, cast(round(pl.unit_price, 2) as decimal(10,2)) unit_price,
          cast(round(pl.unit_price * {_q}, 2) as decimal(10,2)) line_subtotal
        from pl where pl.cart_id in (select id from co where reject_reason is null)"""),
    "checkout_addons": (CHECKOUT_TABLES, f""", {PRICED}, {TOTALS}, {CHECKOUT}
        select cl.line_id order_item_id, a.id addon_id, a.name addon_name, {Q1.format(q='cl.quantity')} quantity,
          cast(round(a.extra_price, 2) as decimal(10,2)) addon_price,
          cast(round(a.extra_price * {Q1.format(q='cl.quantity')}, 2) as decimal(10,2)) addon_subtotal
        from pos_cart_lines cl join pos_product_addons a on a.product_id = cl.product_id and a.is_available = 1
        where cl.with_addons and cl.cart_id in (select id from co where reject_reason is null)"""),
    "checkout_payments": (CHECKOUT_TABLES, f""", {PRICED}, {TOTALS}, {CHECKOUT}
        select id order_id, payment_method, total amount_due, total amount_received,
          cast(0 as decimal(10,2)) change_due, cast(null as varchar) reference_no, created_at paid_at
        from co where reject_reason is null"""),
    "checkout_sessions": (CHECKOUT_TABLES, f""", {PRICED}, {TOTALS}, {CHECKOUT}
        select distinct session_id::bigint id, cashier_id user_id, opened logged_in_at from placed where opened is not null"""),
    "checkout_write_set": (CHECKOUT_TABLES, f""", {PRICED}, {TOTALS}, {CHECKOUT},
        taken AS (select * from co where reject_reason is null),
        li AS (select cast(round(pl.unit_price * {_q}, 2) as decimal(10,2)) amount from pl where pl.cart_id in (select id from taken)),
        ad AS (select cast(round(a.extra_price * {Q1.format(q='cl.quantity')}, 2) as decimal(10,2)) amount
          from pos_cart_lines cl join pos_product_addons a on a.product_id = cl.product_id and a.is_available = 1
          where cl.with_addons and cl.cart_id in (select id from taken))
        select 'orders' table_name, count(*) n_rows, cast(sum(total) as decimal(30,2)) amount from taken
        union all select 'order_items', count(*), cast(sum(amount) as decimal(30,2)) from li
        union all select 'order_item_addons', count(*), cast(sum(amount) as decimal(30,2)) from ad
        union all select 'payments', count(*), cast(sum(total) as decimal(30,2)) from taken
        union all select 'user_sessions', count(distinct session_id), cast(null as decimal(30,2)) from placed where opened is not null"""),
    "accept_registrations": (REG_TABLES, f", {REQ}, {PEND}, {ACCEPT} select * from acc"),
    "accept_registrations_users": (REG_TABLES, f""", {REQ}, {PEND}, {ACCEPT}
        select cast((select max(id) from pos_users) + p.id as bigint) id, p.username, p.name, p.email, p.role,
          'active' is_active, {AS_OF} created_at
        from pend p join acc on acc.registration_id = p.id and acc.outcome = 'accepted'"""),
    "accept_registrations_remaining": (REG_TABLES, f""", {REQ}, {PEND}, {ACCEPT}
        select * from pos_registrations
        where id not in (select registration_id from acc where outcome = 'accepted')"""),
    "reject_registrations": (("registration_requests", "registrations"), f""", {REQ}, {PEND}
        select req.registration_id, case when p.id is not null then 'deleted' else 'not_pending' end outcome
        from req left join pend p on p.id = req.registration_id"""),
    "reject_registrations_remaining": (("registration_requests", "registrations"), f""", {REQ}, {PEND}
        select * from pos_registrations
        where id not in (select p.id from pend p join req on req.registration_id = p.id)"""),
    "registration_conflicts": (("signups", "users", "registrations"), f""", {REPLAY}
        select q.id, q.username, q.email, replay.outcome from replay join queue q using (turn)"""),
    "apply_order_status": (STATUS_TABLES, f""", {STATUS}
        select o.id, o.cashier_id, o.session_id,
          coalesce(case l.last_type when 'complete' then 'completed' else l.last_type end, o.status) status,
          o.subtotal, o.tax_amount, o.discount_amount, o.total, o.payment_method, o.notes, o.created_at,
          coalesce(l.complete_time, o.completed_at) completed_at,
          coalesce(l.complete_actor, o.completed_by) completed_by,
          coalesce(l.void_time, o.voided_at) voided_at, coalesce(l.refund_time, o.refunded_at) refunded_at
        from pos_orders o left join last l on l.order_id = o.id"""),
    "order_status_outcomes": (STATUS_TABLES, f""", {STATUS}
        select order_id, seq, event_type, case when applied then 'applied' else 'refused' end outcome from ap"""),
    "kitchen_queue_stream": (STATUS_TABLES + ("order_items",), f""", {STATUS}, after AS (
          select o.id, o.cashier_id, coalesce(case l.last_type when 'complete' then 'completed' else l.last_type end, o.status) status,
            o.notes, o.created_at, o.total from pos_orders o left join last l on l.order_id = o.id)
        {KITCHEN_QUEUE.replace('pos_orders', 'after')}"""),
    "staff_status_outcomes": (("users", "staff_updates"), _outcomes("pos_staff_updates", "pos_users", "user_id",
        "when is_active is null or is_active not in ('active', 'disabled') then 'invalid_status' "
        "when manager_id = user_id and is_active = 'disabled' then 'own_account'")),
    "availability_outcomes": (("products", "availability_updates"), _outcomes(
        "pos_availability_updates", "pos_products", "product_id",
        "when is_available is null or is_available not in (0, 1) then 'invalid_value'")),
    "image_outcomes": (("products", "image_updates"), _outcomes("pos_image_updates", "pos_products", "product_id")),
    "apply_staff_status": (("users", "staff_updates"), f""", {_latest('pos_staff_updates', 'user_id', 'is_active',
        "is_active in ('active', 'disabled') and not (manager_id = user_id and is_active = 'disabled')")}
        select u.id, u.username, u.name, u.email, u.role, coalesce(l.v, u.is_active) is_active, u.created_at
        from pos_users u left join lat l on l.k = u.id"""),
    "apply_availability": (("products", "availability_updates"), f""", {_latest('pos_availability_updates',
        'product_id', 'is_available', 'is_available in (0, 1)')}
        select {PRODUCT_COLS}, coalesce(l.v, p.is_available) is_available
        from pos_products p left join lat l on l.k = p.id"""),
    "apply_image_url": (("products", "image_updates"), f""", {_latest('pos_image_updates', 'product_id',
        'image_url')}
        select p.id, p.category_id, p.name, p.description, p.base_price, coalesce(l.v, p.image_url) image_url,
          p.is_available
        from pos_products p left join lat l on l.k = p.id"""),
    "sessionize_logins": (("login_events",), """select id, user_id, logged_in_at, logged_out_at from (
          select id, user_id, event_type, ts logged_in_at,
            case lead(event_type) over w when 'logout' then lead(ts) over w when 'login' then ts end logged_out_at
          from pos_login_events window w as (partition by user_id order by ts, id)) s
        where event_type = 'login'"""),
    "held_cart_totals": (("carts", "cart_lines", "lines", "products"), f""", {HELD}
        select cashier_id::varchar || '-' || strftime(created_at, '%Y%m%d') holder_id,
          (row_number() over (partition by cashier_id, cast(created_at as date) order by created_at, cart_id))::int
            position,
          'Held Order #' || row_number() over (partition by cashier_id, cast(created_at as date)
                                               order by created_at, cart_id) title,
          'hold-' || cart_id held_id, item_count,
          cast(round(sub, 2) as decimal(18,2)) subtotal,
          cast(round(case when discount then sub * 0.05 else 0 end, 2) as decimal(18,2)) discount_amount,
          cast(round(sub * 0.12, 2) as decimal(18,2)) tax_amount,
          cast(round(sub - case when discount then sub * 0.05 else 0 end + sub * 0.12, 2) as decimal(18,2)) total
        from ct
        union all
        select distinct cashier_id::varchar || '-' || strftime(created_at, '%Y%m%d') || '-odd', 1, 'Held Order #1', 'odd', 5,
          cast(10.005 * 2 + 4 * 2.5 as decimal(18,2)), 0.00, cast((10.005 * 2 + 4 * 2.5) * 0.12 as decimal(18,2)),
          cast((10.005 * 2 + 4 * 2.5) * 1.12 as decimal(18,2))
        from ct where cashier_id % 7 = 5"""),
}
