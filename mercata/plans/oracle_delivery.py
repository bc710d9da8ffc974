"""DuckDB oracle SQL for the delivery operators."""

from mercata.sources.tables import TEST_TABLES

DUR = """dur as (
  select order_id,
    datesub('hour', purchase_ts, approved_ts) as approval_hours,
    datesub('day', approved_ts, carrier_ts) as handover_days,
    datesub('day', carrier_ts, delivered_ts) as shipping_days,
    datesub('day', purchase_ts, delivered_ts) as total_days,
    case when delivered_ts > estimated_ts then 'Delayed' else 'OnTime' end as delivery_status
  from fx_orders
  where order_status = 'delivered' and delivered_ts is not null and carrier_ts is not null and approved_ts is not null)"""

LONG = """long as (
  select 'approval_hours' as stage, approval_hours as value from dur
  union all select 'handover_days', handover_days from dur
  union all select 'shipping_days', shipping_days from dur)"""

# One row per delivered order, then its reviews rolled up: averages over reviews are weighted sums.
JUDGED = """facts as (
  select order_id, customer_id, delivered_ts > estimated_ts as is_late,
    date_diff('day', estimated_ts, delivered_ts) as late_days, datesub('day', purchase_ts, delivered_ts) as days_taken
  from fx_orders where order_status = 'delivered' and delivered_ts is not null),
votes as (
  select order_id, count(*) as n, count(review_score) as n_scored, sum(review_score) as points,
    count_if(review_score < 3) as bad, count_if(review_score > 3) as good
  from fx_reviews group by order_id),
judged as (select * from facts join votes using (order_id))"""


def _share(part: str, whole: str) -> str:
    return f"cast(coalesce({part}, 0) as double) * 100.0 / cast({whole} as double)"


def _by_status(late: str) -> str:
    return f"""by_status as (
  select if({late}, 'Delayed', 'On Time') as delivery_status, count(*) as order_count,
    cast(sum(points) as double) / cast(sum(n_scored) as double) as avg_score,
    {_share('sum(bad)', 'sum(n)')} as bad_rate_pct, {_share('sum(good)', 'sum(n)')} as good_rate_pct
  from judged group by all)"""


# Weighted group figures: w rows of the joined tables stand behind an order.
def _figures(lines: str) -> str:
    return f"""count(*) as order_count,
    cast(coalesce(sum(n * {lines}) filter (where is_late), 0) as double) / cast(sum(n * {lines}) as double) * 100.0 as delay_rate_pct,
    cast(sum(points * {lines}) as double) / cast(sum(n_scored * {lines}) as double) as avg_score,
    cast(sum(days_taken * n * {lines}) as double) / cast(sum(n * {lines}) as double) as avg_delivery_days"""


REGION = f"""by_state as (
  select customer_state as state, {_figures('1')}
  from judged join fx_customers using (customer_id) group by all having order_count > 150)"""

BASKETS = """baskets as (
  select order_id, product_category_name_english as category, count(*) as lines
  from fx_items join (select product_id, product_category_name_english
                      from fx_products join fx_translation using (product_category_name)) using (product_id)
  group by all)"""


def _w(*ctes: str) -> str:
    return "with " + ",\n".join(ctes) + "\n"


ORACLES = {
    "fulfilment_durations": _w(DUR) + "select * from dur",
    "fulfilment_summary": _w(DUR) + """
select count(*) as n_orders,
  cast(count(*) filter (where delivery_status = 'Delayed') as double) * 100.0 / cast(count(*) as double) as delay_rate_pct,
  avg(approval_hours) as mean_approval_hours, avg(handover_days) as mean_handover_days,
  avg(shipping_days) as mean_shipping_days, avg(total_days) as mean_total_days,
  median(total_days) as median_total_days
from dur""",
    "stage_boxplot": _w(DUR, LONG) + """, st as (
  select stage, count(*) as n, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.5) as median,
    quantile_cont(value, 0.75) as q3 from long where value is not null group by stage)
select st.stage, st.n, st.q1, st.median, st.q3, st.q3 - st.q1 as iqr,
  min(case when cast(l.value as double) >= st.q1 - 1.5 * (st.q3 - st.q1) then cast(l.value as double) end) as whisker_low,
  max(case when cast(l.value as double) <= st.q3 + 1.5 * (st.q3 - st.q1) then cast(l.value as double) end) as whisker_high,
  count(*) filter (where cast(l.value as double) < st.q1 - 1.5 * (st.q3 - st.q1)
                      or cast(l.value as double) > st.q3 + 1.5 * (st.q3 - st.q1)) as n_outliers
from st join long l on l.stage = st.stage where l.value is not null
group by st.stage, st.n, st.q1, st.median, st.q3""",
    "total_days_histogram": _w(DUR) + """, d as (select cast(total_days as double) as v from dur where total_days < 60),
r as (select min(v) as lo, max(v) as hi from d),
b as (select case when r.hi = r.lo then 0 else cast(least(floor((d.v - r.lo) / ((r.hi - r.lo) / 50.0)), 49) as int) end as bin
      from d, r),
c as (select bin, count(*) as n from b group by bin)
select cast(g.range as int) as bin, r.lo + ((r.hi - r.lo) / 50.0) * g.range as bin_lo,
  r.lo + ((r.hi - r.lo) / 50.0) * (g.range + 1) as bin_hi, coalesce(c.n, 0) as count
from range(50) g, r left join c on c.bin = g.range""",
    "delay_vs_score": _w(JUDGED, _by_status("is_late")) + "select * from by_status",
    "delay_vs_score_calendar": _w(JUDGED, _by_status("late_days > 0")) + "select * from by_status",
    "delay_score_gap": _w(JUDGED, _by_status("is_late")) + """, sides as (
  select t.avg_score as on_time_score, d.avg_score as delayed_score,
    t.bad_rate_pct as on_time_bad_rate_pct, d.bad_rate_pct as delayed_bad_rate_pct
  from (select * from by_status where delivery_status = 'On Time') t
  full join (select * from by_status where delivery_status = 'Delayed') d on true)
select *, on_time_score - delayed_score as score_gap, delayed_bad_rate_pct - on_time_bad_rate_pct as bad_rate_gap from sides""",
    "delay_by_region": _w(JUDGED, REGION) + """
select *, delay_rate_pct > median(delay_rate_pct) over () as above_median,
  max(delay_rate_pct) over () - min(delay_rate_pct) over () as delay_rate_spread
from by_state""",
    "delay_by_category": _w(JUDGED, BASKETS) + f"""
select category, {_figures('lines')}
from judged join baskets using (order_id) group by all having order_count > 200""",
    "delay_dose_response": _w(JUDGED) + f""", bands(severity_rank, above, upto, delay_severity) as (
  values (0, null, 0, 'On Time / Early'), (1, 0, 3, '1-3 days late'), (2, 3, 7, '4-7 days late'),
         (3, 7, 14, '8-14 days late'), (4, 14, null, '>14 days late'))
select delay_severity, severity_rank, count(*) as order_count,
  cast(sum(points) as double) / cast(sum(n_scored) as double) as avg_score, {_share('sum(bad)', 'sum(n)')} as bad_rate_pct
from judged join bands on coalesce(late_days > above, true) and coalesce(late_days <= upto, true) group by all""",
    "stored_row_counts": "\nunion all ".join(f"select '{t}' as table_name, count(*) as row_count from {t}" for t in TEST_TABLES),
    "table_row_counts": """
select 'customers' as table_name, count(*) as row_count from fx_customers
union all select 'orders', count(*) from fx_orders
union all select 'order_items', count(*) from fx_items
union all select 'order_payments', count(*) from fx_payments
union all select 'order_reviews', count(*) from fx_reviews
union all select 'products', count(*) from fx_products
union all select 'category_translation', count(*) from fx_translation""",
    "data_quality_checks": """
select count(*) as n_orders,
  cast(count(*) filter (where order_status = 'delivered') as double) * 100.0 / cast(count(*) as double) as status_share_pct,
  count(*) filter (where delivered_ts < purchase_ts) as delivered_before_purchase,
  (select cast(count(*) filter (where review_score is null) as double) * 100.0 / cast(count(*) as double) from fx_reviews)
    as review_score_null_pct
from fx_orders""",
    "delay_by_region_extremes": _w(JUDGED, REGION) + """, placed as (
  select state, order_count, delay_rate_pct, row_number() over (order by delay_rate_pct desc, state) as down,
    row_number() over (order by delay_rate_pct, state desc) as up from by_state)
select state, order_count, delay_rate_pct, 'top' as side from placed where down <= 10
union all select state, order_count, delay_rate_pct, 'bottom' from placed where up <= 5""",
    "delay_by_category_top": _w(JUDGED, BASKETS) + f"""
select category, order_count, delay_rate_pct, 'top' as side
from (select category, {_figures('lines')} from judged join baskets using (order_id) group by all having order_count > 200)
order by delay_rate_pct desc, category limit 20""",
}
