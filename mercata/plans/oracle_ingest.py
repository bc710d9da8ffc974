"""DuckDB oracle SQL for the ingest entries: what the files' contents must come back as."""

ORACLES = {
    "ingest_counts": """
select 'orders' as table_name, count(*) as row_count, 0::bigint as bad_rows from orders
union all select 'order_items', count(*), count(*) filter (where l_orderkey % 101 = 0) from lineitem
union all select 'order_reviews', count(*), 0 from lineitem where l_returnflag <> 'N'""",
    "ingest_reviews": """
select concat(l_orderkey, '-', l_linenumber) as review_id, cast(l_orderkey as varchar) as order_id,
  cast(6 - ceil(l_quantity / 10) as int) as review_score,
  case when l_partkey % 7 <> 0 then concat('Part ', l_partkey) end as review_comment_title,
  concat('said "', l_returnflag, '",', chr(10), 'then,', chr(10), '"', l_suppkey, '"') as review_comment_message
from lineitem where l_returnflag <> 'N'""",
    "ingest_orders": """
select cast(order_id as varchar) as order_id, cast(customer_id as varchar) as customer_id, order_status,
  strftime(purchase_ts, '%Y-%m-%d %H:%M:%S') as order_purchase_timestamp,
  strftime(delivered_ts, '%Y-%m-%d %H:%M:%S') as order_delivered_customer_date
from fx_orders""",
    "ingest_items": """
select cast(order_id as varchar) as order_id, case when order_id % 101 <> 0 then cast(order_item_id as int) end as order_item_id,
  cast(product_id as varchar) as product_id, cast(price as double) as price from fx_items""",
    "ingest_headerless": "select dmp_id, cast(user_id as bigint) as user_id, cast(click as int) as click from fx_ab",
    "ingest_indexed": """
select cast(l_orderkey as bigint) as row_id, cast(target as int) as bad, cast(f_utilisation as double) as utilisation, cast(f_debt as double) as debt,
  cast(f_income as double) as income, cast(f_late_count as int) as late from fx_applicants""",
}
