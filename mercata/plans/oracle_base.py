"""Fixture views in DuckDB SQL, inlined as CTEs into every oracle query.

These are the same stand-in tables that ``mercata.sources.fixtures`` builds
with the DataFrame API; the oracle SQL for each registered query references
them by name (``fx_orders`` ...) and :func:`with_fixtures` prepends exactly the
views it uses.
"""

from __future__ import annotations

import re

FIXTURE_CTES = {
    "fx_customers": """fx_customers as (
  select c_custkey as customer_id, n_name as customer_state, r_name as customer_region
  from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)""",
    "fx_items": """fx_items as (
  select l_orderkey as order_id, l_linenumber as order_item_id, l_partkey as product_id,
    l_suppkey as seller_id, cast(l_extendedprice as decimal(18,2)) as price from lineitem)""",
    "fx_orders": """fx_orders as (
  select o_orderkey as order_id, o_custkey as customer_id,
    case o_orderstatus when 'F' then 'delivered' when 'P' then 'shipped' else 'created' end as order_status,
    o_orderdate as purchase_ts,
    o_orderdate + to_hours(cast(o_orderkey % 72 as int)) as approved_ts,
    case when qmin is not null then o_orderdate + to_hours(cast(o_orderkey % 72 as int)) + to_days(cast(qmin % 7 as int)) end as carrier_ts,
    case when qmax is not null and o_orderkey % 97 <> 0 then o_orderdate + to_days(cast(qmax as int)) + to_hours(cast(o_orderkey % 24 as int)) end as delivered_ts,
    o_orderdate + to_days(30) as estimated_ts
  from orders left join (select l_orderkey, cast(min(l_quantity) as int) as qmin, cast(max(l_quantity) as int) as qmax
                         from lineitem group by l_orderkey) q on o_orderkey = l_orderkey)""",
    "fx_products": """fx_products as (
  select p_partkey as product_id, case when p_partkey % 50 <> 0 then p_brand end as product_category_name from part)""",
    "fx_translation": """fx_translation as (
  select distinct p_brand as product_category_name, lower(replace(p_brand, '#', '_')) as product_category_name_english
  from part where p_brand <> 'Brand#13')""",
    "fx_payments": """fx_payments as (
  select o_orderkey as order_id, 1 as payment_sequential, o_orderpriority as payment_type,
    cast(o_totalprice as decimal(18,2)) as payment_value from orders)""",
    "fx_reviews": """fx_reviews as (
  select l_orderkey as order_id, cast(6 - ceil(l_quantity / 10) as int) as review_score from lineitem where l_returnflag <> 'N')""",
    "fx_applicants": """fx_applicants as (
  select l_orderkey, l_partkey, l_suppkey,
    case when (l_orderkey * 7919 + l_partkey * 104729 + l_suppkey * 31) % 200 < l_quantity then 1 else 0 end as target,
    l_quantity as f_utilisation, l_discount as f_debt, l_tax as f_rate,
    case when l_partkey % 10 <> 0 then l_extendedprice end as f_income,
    case when l_suppkey % 20 = 0 then l_linenumber else 0 end as f_late_count from lineitem)""",
    "fx_applicants_multi": """fx_applicants_multi as (
  select l_orderkey, l_partkey, l_suppkey,
    case when (l_orderkey * 7919 + l_partkey * 104729 + l_suppkey * 31) % 400
      < l_quantity + 5 * cast(round(l_discount * 100) as int) + 5 * cast(round(l_tax * 100) as int) then 1 else 0 end as target,
    l_quantity as f_utilisation, l_discount as f_debt, l_tax as f_rate,
    case when l_partkey % 10 <> 0 then l_extendedprice end as f_income,
    case when l_suppkey % 20 = 0 then l_linenumber else 0 end as f_late_count from lineitem)""",
    "fx_ab": """fx_ab as (
  select cast(user_id % 2 + 1 as int) as dmp_id, user_id, case when event_type = 'click' then 1 else 0 end as click from events)""",
    "fx_ab_many": """fx_ab_many as (
  select cast(user_id % 3 as int) as experiment_id, cast(user_id % 2 + 1 as int) as dmp_id, user_id,
    case when event_type = 'click' and user_id % 3 <> 2 then 1 else 0 end as click from events)""",
}


def with_fixtures(sql: str) -> str:
    """Prepend the fixture views that ``sql`` references as CTEs."""
    used = [name for name in FIXTURE_CTES if re.search(rf"\b{name}\b", sql)]
    if not used:
        return sql
    head = ",\n".join(FIXTURE_CTES[name] for name in used)
    body = sql.lstrip()
    if body.lower().startswith("with recursive "):
        return f"with recursive {head},\n{body[15:]}"
    if body.lower().startswith("with "):
        return f"with {head},\n{body[5:]}"
    return f"with {head}\n{body}"


def money_ratio_sql(num: str, den: str) -> str:
    """Exact half-up rounding of a non-negative decimal sum / count to cents."""
    return (f"cast(cast((cast(({num}) * 100 as hugeint) * 2 + ({den})) // (2 * ({den})) as decimal(18,0))"
            f" * 0.01 as decimal(18,2))")
