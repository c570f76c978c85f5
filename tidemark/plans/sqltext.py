"""Common table expressions, in DuckDB's SQL, that give the same feeds and layers as the operators."""

_PM = lambda a, n: f"((({a}) % {n}) + {n}) % {n}"

FEEDS = {
    "li": "select *, cast(l_shipdate as date) as ship, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, date_diff('day', date '1970-01-01', cast(l_shipdate as date))) as po_id from lineitem",
    "carrier": f"""
      select po_id as purchase_order_id, l_suppkey, d, order_date, ship as event_date, ship - d::int as expected,
        case when not (l_linestatus = 'O' and ship >= date '2001-10-05') then ship end as actual,
        case l_returnflag || l_linestatus when 'AF' then 'DL' when 'AO' then 'TRANSIT' when 'RO' then 'customs' when 'RF' then 'De' when 'NO' then 'Loaded' when 'NF' then 'zz9' end as raw_status,
        case {_PM("l_partkey", 5)} when 0 then 'MAERSK' when 1 then 'FEDEX' when 2 then 'MSC' when 3 then 'DHL' else 'LOCAL' end as carrier_type,
        floor(l_extendedprice) as cargo_value_usd, s_nationkey::varchar as origin_port, c_nationkey::varchar as destination_port
      from (select li.*, cast(o_orderdate as date) as order_date, o_custkey, {_PM("date_diff('day', cast(o_orderdate as date), ship)", 21)} - 9 as d from li join orders on l_orderkey = o_orderkey)
      join supplier on l_suppkey = s_suppkey join customer on o_custkey = c_custkey""",
    "po": f"""
      select po_id as purchase_order_id, l_suppkey as supplier_id, l_partkey as sku_id, l_quantity as order_quantity, l_extendedprice / l_quantity as unit_cost_usd,
        case {_PM("l_orderkey", 6)} when 0 then ' fob' when 1 then 'EXW' when 2 then 'CIF' when 3 then 'DDP' when 4 then 'fca' end as incoterm
      from li where {_PM("l_orderkey", 50)} <> 0""",
    "sup_raw": f"""
      select s_suppkey as supplier_id, case when {_PM("s_suppkey", 11)} <> 10 then '  ' || lower(s_name) || ' ' end as supplier_name, lower(n_name) as country_code, r_name as region,
        'cat' || ({_PM("s_suppkey", 6)}) as primary_category, case when {_PM("s_suppkey", 13)} <> 12 then floor(s_acctbal * 1000)::double end as annual_spend_usd,
        {_PM("s_suppkey * 7", 46)} - 1 as avg_lead_time_days, case when {_PM("s_suppkey", 4)} in (0, 2) then 1 else 0 end as sole_source_flag, {_PM("s_suppkey", 3)} + 1 as tier, ({_PM("s_suppkey * 13", 101)})::double as financial_score
      from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey""",
    "o_nation": "select *, cast(o_orderdate as date) as order_date from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey",
    "conflict": f"select n_name as country_code, order_date as event_date, ({_PM('o_orderkey * 7', 21)} - 10)::double as goldstein, {_PM('o_custkey', 50)} as num_articles, ({_PM('o_orderkey', 11)} - 5)::double as avg_tone from o_nation",
    "governance": f"select n_name as country_code, year, ({_PM('n_nationkey * 7 + year', 51)} - 25)::double / 10 as wgi from nation, (select unnest(range(1995, 2002))::int as year) where {_PM('n_nationkey + year', 9)} <> 0",
    "trade": f"select n_name as country_code, date_trunc('month', order_date)::date as month, ({_PM('o_orderkey', 100)})::double / 100 as deficit, ({_PM('o_orderkey', 17)} = 0)::int as dispute, ({_PM('o_orderkey', 50)})::double / 50 as hhi from o_nation",
    "commodity": "select p_brand as commodity_code, ship as price_date, avg(l_extendedprice / l_quantity) as close_price from li join part on l_partkey = p_partkey group by all",
    "ports": f"select n_name as country_code, ship as event_date, ({_PM('l_orderkey * 3', 240)})::double as wait from li join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey where l_linenumber = 1",
    "gold_orders": f"select l_suppkey as supplier_id, purchase_order_id as order_id, order_date, (d <= {_PM('l_suppkey', 13)} - 6)::int as on_time, d::double as delay from carrier",
    "gold_shipments": f"select l_suppkey as supplier_id, case when raw_status = 'De' then 'LOST' when raw_status = 'DL' and d > {_PM('l_suppkey', 7)} then 'DELAYED' else 'ON_TIME' end as status, (greatest(d, 0) + {_PM('l_suppkey', 20)})::double as delay from carrier",
    "inventory": f"""
      select p_partkey as sku_id, {_PM("p_partkey", "n_sup")} as supplier_id, (p_size * 10)::double as stock, coalesce(dd, 0)::double as daily_demand,
        (p_size * 10)::double / nullif(coalesce(dd, 0)::double, 0) as days_of_supply, coalesce(dr, 0)::double as avg_daily_revenue, p_retailprice as unit_cost_usd
      from part cross join (select count(*) as n_sup from supplier) left join (select l_partkey, sum(l_quantity) / 365 as dd, sum(l_extendedprice) / 365 as dr from li where ship > date '2001-11-05' - 365 group by 1) on p_partkey = l_partkey""",
    "risk_sup": f"select s_suppkey as supplier_id, greatest(1, {_PM('s_suppkey * 7', 46)} - 1)::double as lt_mean, 1.1::double + ({_PM('s_suppkey', 20)})::double / 10 as factor from supplier",
    "weeks": "select floor(date_diff('day', date '1995-01-01', event_date) / 7)::int as scenario_id, l_suppkey as supplier_id, d from carrier",
    "scenarios": """
      select scenario_id, supplier_id, case when share >= 0.75::double then 1 else 0 end as disrupted, lt_mean + late as lead
      from (select scenario_id, supplier_id, avg((d > 3)::int::double) as share, avg(greatest(d, 0)::double) as late from weeks group by 1, 2) join risk_sup using (supplier_id)""",
    "edges": f"""
      select src, dst, flow_volume, least(1.0::double, flow_volume / sum(flow_volume) over (partition by src) * (1 + ({_PM("src * 37", 100)})::double / 50)) as c, 
        (round(least(1.0::double, flow_volume / sum(flow_volume) over (partition by src) * (1 + ({_PM("src * 37", 100)})::double / 50)) + ({_PM("src * 37", 100)})::double / 100 + ({_PM("src * 31 + dst * 17", 100)})::double / 100, 6) > 1.3::double)::int as contagion_label
      from (select a.l_suppkey as src, b.l_suppkey as dst, round(sum(a.l_extendedprice), 2) as flow_volume from li a join li b on a.l_partkey = b.l_partkey and a.ship = b.ship and a.l_suppkey <> b.l_suppkey group by 1, 2)""",
    "spread": """
      select scenario_id, supplier_id, coalesce(disrupted, 0)::int as disrupted, lead, greatest(coalesce(disrupted, 0), coalesce(hit, 0))::int as second from scenarios full join (
        select scenario_id, dst as supplier_id, 1 as hit from (select scenario_id, supplier_id as src from scenarios where disrupted = 1) join edges using (src) group by 1, 2 having round(sum(c), 8) > 0.5) using (scenario_id, supplier_id)""",
    "whole_stock": f"""
      select p_partkey as sku_id, {_PM("p_partkey", "n_sup")} as supplier_id, (p_size * 10)::double as stock, coalesce(dd, 0)::double as daily_demand,
        (p_size * 10)::double / nullif(coalesce(dd, 0)::double, 0) as days_of_supply, coalesce(dr, 0)::double as avg_daily_revenue, p_retailprice as unit_cost_usd
      from part cross join (select count(*) as n_sup from supplier) left join (select l_partkey, sum(l_quantity) / 2500 as dd, sum(l_extendedprice) / 2500 as dr from lineitem group by 1) on p_partkey = l_partkey""",
    "order_edges": f"""
      select src, dst, flow_volume, least(1.0::double, flow_volume / sum(flow_volume) over (partition by src) * (1 + ({_PM("src * 37", 100)})::double / 50)) as c
      from (select a.l_suppkey as src, b.l_suppkey as dst, round(sum(a.l_extendedprice), 2) as flow_volume from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_suppkey <> b.l_suppkey group by 1, 2)""",
    "whole_spread": """
      select scenario_id, supplier_id, coalesce(disrupted, 0)::int as disrupted, lead, greatest(coalesce(disrupted, 0), coalesce(hit, 0))::int as second from scenarios full join (
        select scenario_id, dst as supplier_id, 1 as hit from (select scenario_id, supplier_id as src from scenarios where disrupted = 1) join order_edges using (src) group by 1, 2 having round(sum(c), 8) > 0.5) using (scenario_id, supplier_id)""",
    "scores": f"select doc_id, quality::int as y, ({_PM('n_chars', 1000)})::double / 1000 as p, ({_PM('n_chars * 7', 1000)})::double / 1000 as p2 from labels join documents using (doc_id)",
    "ev": "select value::double as value, hour(ts)::double as hour, least(value / 500, 1.0::double) as score, ts < timestamp '2024-01-16' as ref from events",
    "sold": "select p_brand as sku, n_regionkey as region, floor(date_diff('day', date '1995-01-01', ship) / 7)::int as t, sum(l_quantity) as q from li join part on l_partkey = p_partkey join o_nation on l_orderkey = o_orderkey group by all",
    "demand": "select sku, region, t, coalesce(q, 0)::double as demand from (select distinct sku, region from sold) cross join (select unnest(range(a, b + 1))::int as t from (select min(t)::bigint as a, max(t)::bigint as b from sold)) left join sold using (sku, region, t)",
    "lagged": "select *, lag(demand, 52) over (partition by sku, region order by t) as naive from demand",
    # ------------------------------------------------------------ layers
    "ship": """
      select *, 1.0::double - case when purchase_order_id is null then 0.35::double else 0 end - case when supplier_id is null then 0.30::double else 0 end - case when status = 'UNKNOWN' then 0.20::double else 0 end - case when delay_days < -7 then 0.15::double else 0 end as dq_score
      from (
        select c.purchase_order_id, l_suppkey, event_date, order_date, expected, origin_port, destination_port, cargo_value_usd, supplier_id, sku_id,
          case raw_status when 'DL' then 'DELIVERED' when 'De' then 'EXCEPTION' when 'TRANSIT' then 'IN_TRANSIT' when 'customs' then 'CUSTOMS_HOLD' when 'Loaded' then 'VESSEL_LOADED' else 'UNKNOWN' end as status,
          case when carrier_type in ('MAERSK', 'MSC') then 'OCEAN' when carrier_type in ('FEDEX', 'DHL') then 'AIR_PARCEL' else 'TRUCK' end as transport_mode,
          case when actual is not null then date_diff('day', expected, actual)::double else greatest(0, date_diff('day', expected, date '2001-11-05'))::double end as delay_days,
          order_quantity * coalesce(unit_cost_usd, 0) as order_value, case when upper(trim(incoterm)) in ('EXW', 'FCA', 'FAS', 'FOB') then 1 when incoterm is null then null else 0 end as origin_risk
        from carrier c left join po using (purchase_order_id))""",
    "sup": """
      select *, 1.0::double - 0.40::double * no_id - 0.20::double * no_name - 0.20::double * no_country - 0.10::double * bad_spend - 0.10::double * bad_lead as dq_score
      from (select *, (supplier_id is null)::int as no_id, (supplier_name is null)::int as no_name, (country_code is null)::int as no_country, (annual_spend_usd < 0)::int as bad_spend, (avg_lead_time_days <= 0)::int as bad_lead from sup_raw)""",
    "evs": "select *, (delay_days > 0)::int as late, (delay_days <= 0)::int as ok, case when status = 'EXCEPTION' then 1 else 0 end as disrupted from ship where dq_score >= 0.6 and supplier_id is not null",
    "roll": """
      select *, avg(ok::double) over w7 as on_time_7, avg(ok::double) over w30 as on_time_30, avg(ok::double) over w90 as on_time_90, avg(delay_days) over w30 as delay_30, avg(delay_days) over w90 as delay_90, stddev(delay_days) over w90 as delay_std_90,
        sum(disrupted) over w90 as disruptions_90, count(*) over w90 as total_90
      from evs window w7 as (partition by supplier_id order by event_date, purchase_order_id rows between 6 preceding and current row),
        w30 as (partition by supplier_id order by event_date, purchase_order_id rows between 29 preceding and current row), w90 as (partition by supplier_id order by event_date, purchase_order_id rows between 89 preceding and current row)""",
    "isl": "select *, sum(late) over (partition by supplier_id order by event_date, purchase_order_id rows unbounded preceding) as island, max(case when disrupted = 1 then event_date end) over (partition by supplier_id order by event_date, purchase_order_id rows unbounded preceding) as last_disruption from roll",
    "streaks": "select *, sum(ok) over (partition by supplier_id, island order by event_date, purchase_order_id rows unbounded preceding)::bigint as streak from isl",
    "route": "select origin_port, destination_port, count(*) as n, avg(label::double) as rate, quantile_disc(delay_days, 0.5) as median_delay, stddev(delay_days) as std_delay, avg(cargo_value_usd) as avg_cargo from (select *, case when delay_days > 3 or status in ('EXCEPTION', 'CUSTOMS_HOLD') then 1 else 0 end as label from ship where dq_score >= 0.6) group by 1, 2",
    "g_conflict": "select country_code, event_date, avg(goldstein) as goldstein, sum(num_articles)::bigint as articles, avg(avg_tone) as tone, count(*) as n_events, greatest(0, least(1, (10 - avg(goldstein)) / 20)) as conflict_score from conflict group by 1, 2",
    "g_gov": "select country_code, year, wgi, greatest(0, least(1, (2.5::double - wgi) / 5)) as instability from governance",
    "g_trade": "select country_code, month, avg(deficit) as deficit, sum(dispute)::bigint as disputes, avg(hhi) as hhi, least(1, 0.1::double * sum(dispute) + 0.5::double * avg(deficit)) as trade_score from trade group by 1, 2",
    "g_comm_rows": "select *, case when m > 0 then s / m else 0 end as vol from (select *, stddev(close_price) over w as s, avg(close_price) over w as m from commodity window w as (partition by commodity_code order by price_date rows between 29 preceding and current row))",
    "g_comm": "select price_date, avg(vol) as vol from g_comm_rows group by 1",
    "g_port": "select country_code, event_date, avg(wait) as wait, least(1, avg(wait) / 168) as port_score from ports group by 1, 2",
    "geo": """
      select *, greatest(0, least(1, 0.30::double * instability + 0.25::double * trade_score + 0.20::double * conflict_score + 0.15::double * port_score + 0.10::double * volatility)) as geo_score from (
        select c.country_code, c.event_date, conflict_score, coalesce(instability, 0.5::double) as instability, coalesce(trade_score, 0.0::double) as trade_score, coalesce(vol, 0.0::double) as volatility, coalesce(port_score, 0.0::double) as port_score
        from g_conflict c left join g_port p using (country_code, event_date) left join g_gov g on c.country_code = g.country_code and year(c.event_date) = g.year
        left join g_trade t on c.country_code = t.country_code and date_trunc('month', c.event_date) = t.month left join g_comm m on c.event_date = m.price_date)""",
    "scen_loss": """
      select scenario_id, round(coalesce(loss, 0), 4)::double as loss from (select distinct scenario_id from spread) left join (
        select scenario_id, sum(greatest(0, coalesce(lead, lt_mean) - coalesce(days_of_supply, 0)) * avg_daily_revenue + avg_daily_revenue * lt_mean * (factor - 1)) as loss
        from spread join risk_sup using (supplier_id) join inventory using (supplier_id) where second = 1 group by 1) using (scenario_id)""",
    "whole_loss": """
      select scenario_id, round(coalesce(loss, 0), 4)::double as loss from (select distinct scenario_id from whole_spread) left join (
        select scenario_id, sum(greatest(0, coalesce(lead, lt_mean) - coalesce(days_of_supply, 0)) * avg_daily_revenue + avg_daily_revenue * lt_mean * (factor - 1)) as loss
        from whole_spread join risk_sup using (supplier_id) join whole_stock using (supplier_id) where second = 1 group by 1) using (scenario_id)""",
}


NODES = "nd as (select s_suppkey as id, ((s_suppkey * 37) % 100)::double / 100 as p from supplier)"
_RANKS = "".join(
    f", r{i} as materialized (select nd.id, 0.15::double / n + 0.85::double * (coalesce(got, 0) + loose / n) as rank from nd cross join sz cross join (select coalesce(sum(rank), 0) as loose from r{i - 1} where id not in (select src from ot)) left join (select dst as id, sum(rank * w) as got from wt join r{i - 1} on src = id group by 1) using (id))"
    for i in range(1, 11)
)
PAGERANK = f"{NODES}, sz as (select count(*) as n from nd), ot as (select src, sum(flow_volume) as o from edges group by 1), wt as (select src, dst, flow_volume / o as w from edges join ot using (src)), r0 as (select id, 1.0::double / n as rank from nd cross join sz) {_RANKS}"
SECOND_ORDER = "so as (select id, coalesce(1 - exp(s), 0) as score from nd left join (select dst as id, sum(ln(1 - least(p * c, 0.999999::double))) as s from edges join nd on src = nd.id group by 1) using (id))"


def with_feeds(query: str) -> str:
    """The query after all feeds that it needs."""
    needed: list[str] = []

    def visit(text: str) -> None:
        import re

        words = set(re.findall(r"\w+", text))
        for name, body in FEEDS.items():
            if name in words and name not in needed and body != text:
                needed.append(name)
                visit(body)

    visit(query)
    order = [n for n in FEEDS if n in needed]
    head = ",\n".join(f"{n} as ({FEEDS[n]})" for n in order)
    if not head:
        return query
    return f"with {head}\n{query}" if not query.lstrip().lower().startswith("with ") else f"with {head}, {query.lstrip()[5:]}"

