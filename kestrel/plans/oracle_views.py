"""The bridge views written independently as ANSI SQL for the DuckDB oracle.

Each entry is a CTE body over the driver's pre-registered tables.  A query
lists the CTEs it needs; ``with_views`` emits them in dependency order.
"""

from __future__ import annotations

AS_OF = "DATE '2001-06-01'"

_LINE_KEY = ("concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, "
             "cast(l_quantity as integer))")
_U = "(l_linestatus = 'O' and l_returnflag = 'N')"
_SCHED = ("(case o_orderpriority when '1-URGENT' then 0 when '2-HIGH' then 1 "
          "when '3-MEDIUM' then 2 else 4 end)")
_MODE = ("(case o_orderpriority when '1-URGENT' then 'Same Day' when '2-HIGH' then 'First Class' "
         "when '3-MEDIUM' then 'Second Class' else 'Standard Class' end)")
_ACT = "(((date_diff('day', cast(o_orderdate as date), cast(l_shipdate as date)) % 7) + 7) % 7)"

VIEWS: dict[str, tuple[list[str], str]] = {}

VIEWS["geo"] = ([], """
  select n_nationkey, n_name, r_name from nation join region on n_regionkey = r_regionkey""")

VIEWS["orders_f"] = (["geo"], f"""
  select
    cast(l_orderkey as double) as order_id,
    cast(l_orderkey * 8 + l_linenumber as double) as order_item_id,
    cast(l_partkey as double) as product_card_id,
    cast(o_custkey as double) as customer_id,
    cast(o_orderdate as date) as order_day,
    cast(l_shipdate as date) as shipping_day,
    cast({_ACT} as double) as actual_shipping_days,
    cast({_SCHED} as double) as scheduled_shipping_days,
    cast({_ACT} as double) - cast({_SCHED} as double) as delivery_delay_days,
    cast({_SCHED} as double) - cast({_ACT} as double) as shipping_ahead_days,
    cast(case when {_ACT} > {_SCHED} then 1 else 0 end as bigint) as late_delivery_flag,
    l_extendedprice * (1 - l_discount) - l_quantity * p_retailprice as benefit_per_order,
    l_extendedprice as sales,
    case when l_extendedprice <> 0 then
      (l_extendedprice * (1 - l_discount) - l_quantity * p_retailprice) / l_extendedprice * 100.0
    end as profit_margin_pct,
    l_discount as order_item_discount_rate,
    l_discount * 100 as discount_rate_pct,
    l_quantity as order_item_quantity,
    c_mktsegment as customer_segment,
    r_name as market,
    n_name as order_region,
    o_orderstatus as order_status,
    {_MODE} as shipping_mode,
    p_name as product_name,
    p_type as category_name,
    p_brand as department_name,
    {_LINE_KEY} as line_key
  from lineitem
  join orders on l_orderkey = o_orderkey
  join customer on o_custkey = c_custkey
  join geo on c_nationkey = n_nationkey
  join part on l_partkey = p_partkey""")

VIEWS["part_sales"] = ([], """
  select l_partkey, sum(l_quantity) as sold,
         sum(cast(l_extendedprice as decimal(12,2))) as revenue,
         count(*) as lines,
         avg(case when l_returnflag = 'R' then 1 else 0 end) as return_share
  from lineitem group by l_partkey""")

VIEWS["skus_f"] = (["geo", "part_sales"], """
  select
    'SKU' || cast(p_partkey as varchar) as sku,
    p_type as product_type,
    s_name as supplier_name,
    sn.n_name as supplier_location,
    p_retailprice as product_price,
    cast((p_partkey * 11) % 100 as double) as availability,
    coalesce(ps.sold, 0.0) as products_sold,
    coalesce(cast(ps.revenue as double), 0.0) as revenue_generated,
    cast(p_size * 40 as double) as stock_levels,
    cast((p_partkey * 11) % 100 as double) - cast(p_size * 40 as double) as inventory_gap,
    case when p_size * 40 <> 0 then coalesce(ps.sold, 0.0) / cast(p_size * 40 as double) end
      as sell_through_rate,
    cast(1 + (p_partkey * 7) % 30 as double) as source_lead_time_days,
    cast(1 + (p_partkey * 3) % 30 as double) as manufacturing_lead_time_days,
    cast(1 + (p_partkey * 7) % 30 as double) - cast(1 + (p_partkey * 3) % 30 as double)
      as lead_time_gap_days,
    cast(1 + p_partkey % 10 as double) as shipping_times,
    p_retailprice * 0.01 as shipping_cost,
    case when coalesce(ps.lines, 0) <> 0 then p_retailprice * 0.01 / cast(ps.lines as double) end
      as shipping_cost_per_unit,
    cast(p_size * 20 as double) as production_volumes,
    p_retailprice * 0.6 as manufacturing_costs,
    case when p_size * 20 <> 0 then p_retailprice * 0.6 / cast(p_size * 20 as double) end
      as manufacturing_cost_per_unit,
    case p_partkey % 3 when 0 then 'Pass' when 1 then 'Fail' else 'Pending' end as inspection_result,
    ps.return_share * 5.0 as defect_rate_raw,
    cast(coalesce(ps.return_share * 5.0 > 1, false) as bigint) as defect_rate_out_of_range_flag,
    cast(case p_partkey % 3 when 0 then 1 else 0 end as bigint) as quality_pass_flag,
    cast(case p_partkey % 3 when 1 then 1 else 0 end as bigint) as quality_fail_flag,
    case p_partkey % 4 when 0 then 'Road' when 1 then 'Rail' when 2 then 'Air' else 'Sea' end
      as transportation_mode,
    'Route ' || case p_partkey % 3 when 0 then 'A' when 1 then 'B' else 'C' end as route,
    p_partkey
  from part
  cross join (select count(*) as n_supp from supplier) ns
  left join part_sales ps on ps.l_partkey = p_partkey
  left join supplier on s_suppkey = p_partkey % ns.n_supp
  left join geo sn on sn.n_nationkey = s_nationkey""")

VIEWS["dim_products"] = ([], """
  select p_partkey as product_id, 'SKU' || cast(p_partkey as varchar) as sku,
         p_name as product_name, p_type as category, p_brand as brand,
         cast(cast(p_retailprice as decimal(12,2)) * 0.6 as decimal(12,2)) as unit_cost,
         cast(p_retailprice as decimal(12,2)) as unit_price
  from part""")

VIEWS["dim_locations"] = (["geo"], """
  select cast(n_nationkey as bigint) as location_id, 'LOC-' || cast(n_nationkey as varchar) as location_code,
         n_name as location_name,
         case when n_nationkey % 2 = 0 then 'warehouse' else 'distribution_center' end as location_type,
         r_name as region
  from geo""")

VIEWS["dim_suppliers"] = (["geo"], """
  select s_suppkey as supplier_id, 'SUP-' || cast(s_suppkey as varchar) as supplier_code,
         s_name as supplier_name, n_name as country, r_name as region,
         cast(1 + s_suppkey % 14 as integer) as default_lead_time_days
  from supplier join geo on s_nationkey = n_nationkey""")

VIEWS["dim_carriers"] = ([], """
  select carrier_id, 'CAR-' || cast(carrier_id as varchar) as carrier_code,
         'Carrier ' || cast(carrier_id as varchar) as carrier_name,
         (['road','rail','ocean','air','multimodal'])[carrier_id + 1] as transport_mode
  from (select distinct cast(l_linenumber % 5 as bigint) as carrier_id from lineitem)""")

VIEWS["b_po"] = ([], f"""
  select {_LINE_KEY} as po_number, l_suppkey as supplier_id, l_partkey as product_id,
    cast(l_shipdate as date) - 10 as order_date,
    cast(l_shipdate as date) as expected_delivery_date,
    case when {_U} then null
         else cast(l_shipdate as date) + cast((l_orderkey + l_partkey) % 7 - 3 as integer) end
      as actual_delivery_date,
    cast(l_quantity as integer) as ordered_quantity,
    case when {_U} then 0 else cast(cast(l_quantity as integer) - l_orderkey % 2 as integer) end
      as received_quantity,
    case when l_returnflag = 'R'
         then cast(floor((cast(l_quantity as integer) - l_orderkey % 2) / 10) as integer) else 0 end
      as defect_quantity,
    cast(cast(l_extendedprice / l_quantity * 0.6 as decimal(38,9)) as decimal(12,2)) as unit_cost,
    case when {_U} then 'placed' when l_linestatus = 'F' then 'received' else 'closed' end as status
  from lineitem""")

VIEWS["b_inv"] = ([], """
  select product_id || '-' || location_id || '-' || strftime(snapshot_date, '%Y-%m-%d') as snapshot_id,
    product_id, location_id, snapshot_date, q,
    cast(size * 4 + q % 50 as integer) as on_hand_quantity,
    least(cast(size * 4 + q % 50 as integer), cast(q % 20 as integer)) as reserved_quantity,
    cast(size * 4 + q % 50 as integer) - least(cast(size * 4 + q % 50 as integer), cast(q % 20 as integer))
      as available_quantity,
    cast((product_id * 13) % 150 as integer) as reorder_point,
    cast(floor(cast((product_id * 13) % 150 as integer) / 3) as integer) as safety_stock,
    cast(cast(price as decimal(12,2)) * 0.6 as decimal(12,2)) as unit_cost,
    cast(cast(size * 4 + q % 50 as integer) * cast(cast(price as decimal(12,2)) * 0.6 as decimal(12,2))
         as decimal(14,2)) as inventory_value
  from (
    select l_partkey as product_id, cast(s_nationkey as bigint) as location_id,
           cast(date_trunc('month', l_shipdate) as date) as snapshot_date,
           cast(sum(cast(l_quantity as integer)) as integer) as q,
           max(p_size) as size, max(p_retailprice) as price
    from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey
    group by 1, 2, 3)""")

VIEWS["b_dem"] = ([], """
  select demand_date, product_id, location_id, q as quantity_demanded,
         q - q % 5 as quantity_sold, q % 5 as lost_sales_quantity, revenue
  from (
    select cast(o_orderdate as date) as demand_date, l_partkey as product_id,
           cast(c_nationkey as bigint) as location_id,
           cast(sum(cast(l_quantity as integer)) as integer) as q,
           sum(cast(l_extendedprice as decimal(14,2))) as revenue
    from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
    group by 1, 2, 3)""")

VIEWS["b_ship"] = ([], f"""
  select *,
    case when actual_delivery_date is null then null
         else greatest(date_diff('day', expected_delivery_date, actual_delivery_date), 0) end as delay_days,
    actual_delivery_date > expected_delivery_date as is_delayed
  from (
    select {_LINE_KEY} as shipment_id, {_LINE_KEY} as shipment_number,
      cast(l_linenumber % 5 as bigint) as carrier_id,
      cast(s_nationkey as bigint) as source_location_id, cast(c_nationkey as bigint) as destination_location_id,
      l_suppkey as supplier_id, l_partkey as product_id,
      cast(l_shipdate as date) as ship_date,
      cast(l_shipdate as date) + cast({_SCHED} as integer) as expected_delivery_date,
      case when {_U} then null
           else cast(l_shipdate as date) + cast((l_orderkey + l_partkey) % 7 as integer) end
        as actual_delivery_date,
      cast(l_quantity as integer) as shipped_quantity,
      case when {_U} then 0 else cast(l_quantity as integer) end as delivered_quantity,
      cast(cast(l_extendedprice as decimal(12,2)) * 0.02 as decimal(12,2)) as freight_cost,
      cast(100 + (l_orderkey % 50) * 10 as decimal(10,2)) as distance_km,
      case when {_U} then 'in_transit' else 'delivered' end as status
    from lineitem join orders on l_orderkey = o_orderkey
    join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey)""")

VIEWS["b_fc"] = (["b_inv"], f"""
  select product_id, location_id, cast(h as bigint) as forecast_horizon_days,
    {AS_OF} + cast((product_id * 7 + location_id * 3) % 40 - 10 as integer)
            - (case when h = 30 then 5 else 0 end) as forecast_date,
    cast(product_id % 50 + location_id + h as decimal(14,2)) as predicted_quantity,
    cast({AS_OF} - h as timestamp) as created_at
  from (select distinct product_id, location_id from b_inv) k
  cross join (values (7), (30)) hs(h)""")

VIEWS["b_rec"] = (["b_inv"], f"""
  select 'REC-' || snapshot_id as inventory_recommendation_id, product_id, location_id,
    snapshot_date as recommendation_date, on_hand_quantity as current_stock,
    cast(q as decimal(14,2)) as forecasted_demand, reorder_point, safety_stock,
    cast(greatest(reorder_point * 2 - available_quantity, 0) as integer) as recommended_order_quantity,
    case when available_quantity <= reorder_point / 2 then 'high'
         when available_quantity <= reorder_point then 'medium' else 'low' end as priority,
    case when snapshot_date >= {AS_OF} - interval 12 month then 'open' else 'completed' end as status,
    cast(snapshot_date as timestamp) as created_at
  from b_inv""")

VIEWS["b_br"] = (["b_rec"], """
  select 'BR-' || inventory_recommendation_id as business_recommendation_id,
    inventory_recommendation_id, product_id, location_id, 'reorder' as recommendation_type,
    case when reorder_point - current_stock > 60 then 'critical'
         when reorder_point - current_stock > 30 then 'high'
         when reorder_point - current_stock > 0 then 'medium' else 'low' end as severity,
    status, created_at
  from b_rec where current_stock <= reorder_point * 2""")

VIEWS["b_score"] = (["b_po"], """
  select *, case when overall_score <= 40 then 'high' when overall_score <= 70 then 'medium'
                 else 'low' end as risk_tier,
         cast(score_date as timestamp) as created_at
  from (
    select *, cast(round(quality_score * 0.30 + delivery_score * 0.25 + cost_score * 0.25
                         + reliability_score * 0.20, 2) as decimal(5,2)) as overall_score
    from (
      select supplier_id, score_date,
        cast(round(cast(on_time as decimal(20,4)) * 100 / n, 2) as decimal(5,2)) as delivery_score,
        cast(round(100 - coalesce(cast(defects as decimal(20,4)) * 100 / nullif(cast(received as decimal(20,4)), 0), 0), 2)
             as decimal(5,2)) as quality_score,
        cast((supplier_id * 37) % 100 as decimal(5,2)) as cost_score,
        cast(round(cast(done as decimal(20,4)) * 100 / n, 2) as decimal(5,2)) as reliability_score
      from (
        select supplier_id, last_day(expected_delivery_date) as score_date, count(*) as n,
          sum(case when actual_delivery_date is not null and actual_delivery_date <= expected_delivery_date
                   then 1 else 0 end) as on_time,
          sum(received_quantity) as received, sum(defect_quantity) as defects,
          sum(case when status <> 'placed' then 1 else 0 end) as done
        from b_po group by 1, 2)))""")

VIEWS["b_pred"] = (["b_ship"], """
  select shipment_id, cast(p as decimal(5,4)) as predicted_delay_probability,
         cast(null as decimal(8,2)) as predicted_delay_days,
         case when p >= 0.7 then 'high' when p >= 0.3 then 'medium' else 'low' end as risk_level,
         cast(ship_date as timestamp) as created_at
  from (select *, case when date_diff('day', ship_date, expected_delivery_date) <= 2
                       then 0.75 + least(freight_cost * 0.005, 0.20)
                       when date_diff('day', ship_date, expected_delivery_date) >= 5 then 0.12
                       else 0.38 end as p from b_ship)
  union all
  select shipment_id, cast(0.5 as decimal(5,4)), cast(null as decimal(8,2)), 'medium',
         cast(ship_date - 1 as timestamp)
  from b_ship where carrier_id = 0""")


def with_views(names: list[str], body: str) -> str:
    """``WITH`` clause holding ``names`` and their dependencies, then ``body``."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for dep in VIEWS[n][0]:
            visit(dep)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS ({VIEWS[n][1]}\n)" for n in order)
    return f"WITH {ctes}\n{body}"


def r(expr: str, scale: int) -> str:
    """Decimal HALF_UP rounding of a double expression, back to double."""
    return f"CAST(ROUND(CAST({expr} AS DECIMAL(38,9)), {scale}) AS DOUBLE)"
