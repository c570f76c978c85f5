"""The feeds of the engine, derived from the star schema of the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import columns as C
from tidemark.sources.tables import load

AS_OF = "2001-11-05"


def days(a: str | Column, b: str | Column) -> Column:
    return F.datediff(b, a)


def _pairs(sold: DataFrame, *group: str) -> DataFrame:
    """src, v, dst, n for all ordered pairs of suppliers of a group; ``sold`` has a row (l_suppkey, v, n) for each of them."""
    of = sold.groupBy(*group).agg(F.collect_list(F.struct("l_suppkey", "v", "n")).alias("of"))
    each = of.select(F.explode("of").alias("own"), "of").select(F.col("own.l_suppkey").alias("src"), F.col("own.v").alias("v"), F.explode("of").alias("other"))
    return each.select("src", "v", F.col("other.l_suppkey").alias("dst"), F.col("other.n").alias("n")).filter("src <> dst")


class Feeds:
    """Feeds over one folder of tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return load(self.spark, self.folder, name)

    def lines(self) -> DataFrame:
        """Order lines with a key of their own and the ship day."""
        li = self.table("lineitem").withColumn("ship", F.to_date("l_shipdate"))
        return li.withColumn("po_id", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.unix_date("ship")))

    def carrier(self) -> DataFrame:
        """One tracking event per order line; most delays lie between -9 and 11 days."""
        orders = self.table("orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("order_date"))
        orders = orders.join(self.table("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))  # before the lines, which are many times as many
        suppliers = self.table("supplier").select("s_suppkey", "s_nationkey")
        joined = self.lines().join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        d = F.pmod(days("order_date", "ship"), F.lit(21)) - 9
        ongoing = (F.col("l_linestatus") == "O") & (F.col("ship") >= F.lit("2001-10-05").cast("date"))
        kind = F.concat("l_returnflag", "l_linestatus")
        raw = F.create_map(*(F.lit(x) for x in ("AF", "DL", "AO", "TRANSIT", "RO", "customs", "RF", "De", "NO", "Loaded", "NF", "zz9")))
        carriers = F.array(*(F.lit(x) for x in ("MAERSK", "FEDEX", "MSC", "DHL", "LOCAL")))
        return joined.withColumn("d", d).select(
            F.col("po_id").alias("purchase_order_id"),
            "l_orderkey",
            "l_suppkey",
            "d",
            "order_date",
            F.col("ship").alias("event_date"),
            F.col("ship").cast("timestamp").alias("event_timestamp"),
            F.date_sub("ship", F.col("d")).cast("timestamp").alias("expected_delivery_date"),
            F.when(~ongoing, F.col("ship").cast("timestamp")).alias("actual_delivery_date"),
            raw[kind].alias("raw_status"),
            F.element_at(carriers, (F.pmod("l_partkey", F.lit(5)) + 1).cast("int")).alias("carrier_type"),
            F.concat(F.lit("$ "), F.floor("l_extendedprice").cast("bigint").cast("string")).alias("cargo_value_usd"),
            F.col("s_nationkey").cast("string").alias("origin_port"),
            F.col("c_nationkey").cast("string").alias("destination_port"),
        )

    def purchase_orders(self) -> DataFrame:
        terms = F.array(F.lit(" fob"), F.lit("EXW"), F.lit("CIF"), F.lit("DDP"), F.lit("fca"), F.lit(None).cast("string"))
        return (
            self.lines()
            .filter(F.pmod("l_orderkey", F.lit(50)) != 0)
            .select(
                F.col("po_id").alias("purchase_order_id"),
                "l_orderkey",
                F.col("l_suppkey").alias("supplier_id"),
                F.col("l_partkey").alias("sku_id"),
                F.col("l_quantity").alias("order_quantity"),
                (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_cost_usd"),
                F.element_at(terms, (F.pmod("l_orderkey", F.lit(6)) + 1).cast("int")).alias("incoterm"),
            )
        )

    def supplier_master(self) -> DataFrame:
        nations = self.table("nation").join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        k = F.col("s_suppkey")
        text = lambda c: c.cast("string")
        flags = F.array(*(F.lit(x) for x in ("Y", "no", "TRUE", "0")))
        return (
            self.table("supplier")
            .join(F.broadcast(nations), F.col("s_nationkey") == F.col("n_nationkey"))
            .select(
                k.alias("supplier_id"),
                F.when(F.pmod(k, F.lit(11)) != 10, F.concat(F.lit("  "), F.lower("s_name"), F.lit(" "))).alias("supplier_name"),
                F.lower("n_name").alias("country_code"),
                F.col("r_name").alias("region"),
                F.concat(F.lit("cat"), text(F.pmod(k, F.lit(6)))).alias("primary_category"),
                F.when(F.pmod(k, F.lit(13)) != 12, F.concat(F.lit("$"), text(F.floor(F.col("s_acctbal") * 1000).cast("bigint")))).alias("annual_spend_usd"),
                F.lit("spot").alias("contract_type"),
                F.lit("30").alias("payment_terms_days"),
                text(F.pmod(k * 7, F.lit(46)) - 1).alias("avg_lead_time_days"),
                F.element_at(flags, (F.pmod(k, F.lit(4)) + 1).cast("int")).alias("sole_source_flag"),
                text(F.pmod(k, F.lit(3)) + 1).alias("tier"),
                F.lit("2001-10-01 00:00:00").alias("erp_last_updated"),
                text(F.pmod(k * 13, F.lit(101))).alias("financial_score_ext"),
            )
        )

    def _order_nations(self) -> DataFrame:
        orders = self.table("orders").withColumn("order_date", F.to_date("o_orderdate"))
        nations = self.table("nation").select("n_nationkey", "n_name")
        customers = self.table("customer").select("c_custkey", "c_nationkey")
        return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))

    def conflict(self) -> DataFrame:
        return self._order_nations().select(
            F.col("n_name").alias("country_code"),
            F.date_format("order_date", "yyyyMMdd").alias("event_date_str"),
            (F.pmod(F.col("o_orderkey") * 7, F.lit(21)) - 10).cast("double").alias("goldstein_scale"),
            F.pmod("o_custkey", F.lit(50)).alias("num_articles"),
            (F.pmod("o_orderkey", F.lit(11)) - 5).cast("double").alias("avg_tone"),
        )

    def governance(self) -> DataFrame:
        years = self.spark.range(1995, 2002).select(F.col("id").cast("int").alias("year"))
        score = (F.pmod(F.col("n_nationkey") * 7 + F.col("year"), F.lit(51)) - 25).cast("double") / 10
        return self.table("nation").crossJoin(years).filter(F.pmod(F.col("n_nationkey") + F.col("year"), F.lit(9)) != 0).select(F.col("n_name").alias("country_code"), "year", score.alias("political_stability_wgi"))

    def trade(self) -> DataFrame:
        return self._order_nations().select(
            F.col("n_name").alias("reporter_country_code"),
            F.date_format("order_date", "yyyy-MM").alias("period"),
            (F.pmod("o_orderkey", F.lit(100)).cast("double") / 100).alias("trade_deficit_ratio"),
            (F.pmod("o_orderkey", F.lit(17)) == 0).cast("int").alias("tariff_dispute_flag"),
            (F.pmod("o_orderkey", F.lit(50)).cast("double") / 50).alias("import_concentration_hhi"),
        )

    def commodity(self) -> DataFrame:
        parts = self.table("part").select("p_partkey", "p_brand")
        lines = self.lines().join(parts, F.col("l_partkey") == F.col("p_partkey"))
        return lines.groupBy(F.col("p_brand").alias("commodity_code"), F.col("ship").alias("price_date")).agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("close_price"))

    def ports(self) -> DataFrame:
        nations = self.table("supplier").join(F.broadcast(self.table("nation")), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
        lines = self.lines().filter("l_linenumber = 1").join(nations, F.col("l_suppkey") == F.col("s_suppkey"))
        return lines.select(F.col("n_name").alias("country_code"), F.col("ship").alias("event_date"), F.pmod(F.col("l_orderkey") * 3, F.lit(240)).cast("double").alias("wait_time_hours"))

    def dated_lines(self) -> DataFrame:
        """Order lines with the day of their order and their delay; what the third layer needs of the tracking events."""
        orders = self.table("orders").select("o_orderkey", F.to_date("o_orderdate").alias("order_date"))
        lines = self.lines().join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        return lines.select(F.col("l_suppkey").alias("supplier_id"), "po_id", "order_date", F.concat("l_returnflag", "l_linestatus").alias("kind"), (F.pmod(days("order_date", "ship"), F.lit(21)) - 9).alias("d"))

    def gold_orders(self) -> DataFrame:
        return self.dated_lines().select("supplier_id", F.col("po_id").alias("order_id"), "order_date", (F.col("d") <= F.pmod("supplier_id", F.lit(13)) - 6).cast("int").alias("on_time_flag"), F.col("d").cast("double").alias("delay_days"))

    def gold_shipments(self) -> DataFrame:
        status = F.when(F.col("kind") == "RF", "LOST").when((F.col("kind") == "AF") & (F.col("d") > F.pmod("supplier_id", F.lit(7))), "DELAYED").otherwise("ON_TIME")
        late = (F.greatest("d", F.lit(0)) + F.pmod("supplier_id", F.lit(20))).cast("double")
        return self.dated_lines().select("supplier_id", F.col("po_id").alias("shipment_id"), status.alias("status"), late.alias("delay_days"))

    def inventory(self) -> DataFrame:
        """Stock by part and its demand in the year up to the day of the report."""
        recent = F.col("ship") > F.date_sub(F.lit(AS_OF).cast("date"), 365)
        return self._stock(self.lines().filter(recent), 365)

    def whole_inventory(self) -> DataFrame:
        """Stock by part and its demand over all lines, which are of about 2500 days."""
        return self._stock(self.table("lineitem"), 2500)

    def _stock(self, lines: DataFrame, days: int) -> DataFrame:
        n_suppliers = self.table("supplier").agg(F.count("*").alias("n_suppliers"))
        sold = lines.groupBy("l_partkey").agg((F.sum("l_quantity") / days).alias("daily_demand"), (F.sum("l_extendedprice") / days).alias("avg_daily_revenue"))
        parts = self.table("part").crossJoin(F.broadcast(n_suppliers)).join(sold, F.col("p_partkey") == F.col("l_partkey"), "left")
        demand = F.coalesce("daily_demand", F.lit(0.0))
        return parts.select(
            F.col("p_partkey").alias("sku_id"),
            F.pmod("p_partkey", "n_suppliers").alias("supplier_id"),
            (F.col("p_size") * 10).cast("double").alias("stock"),
            demand.alias("daily_demand"),
            F.try_divide((F.col("p_size") * 10).cast("double"), F.nullif(demand, F.lit(0.0))).alias("days_of_supply"),
            F.coalesce("avg_daily_revenue", F.lit(0.0)).alias("avg_daily_revenue"),
            F.col("p_retailprice").alias("unit_cost_usd"),
        )

    def risk_suppliers(self) -> DataFrame:
        """Mean lead time and price of substitution by supplier."""
        k = F.col("s_suppkey")
        return self.table("supplier").select(k.alias("supplier_id"), F.greatest(F.lit(1.0), (F.pmod(k * 7, F.lit(46)) - 1).cast("double")).alias("avg_lead_time_days"), (F.lit(1.1) + F.pmod(k, F.lit(20)) / 10).alias("substitution_cost_factor"))

    def scenarios(self) -> DataFrame:
        """Historical weeks as scenarios: the suppliers with lines in a week, disrupted if most of them were late.

        Lines meet their orders and go by supplier from then on, once each: a supplier has as many rows as weeks.
        """
        orders = self.table("orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("order_date"))
        orders = orders.join(self.table("customer").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "order_date")
        lines = self.table("lineitem").select("l_orderkey", F.col("l_suppkey").alias("supplier_id"), F.to_date("l_shipdate").alias("ship")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        d = F.pmod(days("order_date", "ship"), F.lit(21)) - 9
        weeks = lines.select("supplier_id", F.floor(days(F.lit("1995-01-01").cast("date"), "ship") / 7).cast("int").alias("scenario_id"), d.alias("d")).repartition("supplier_id")
        seen = weeks.groupBy("scenario_id", "supplier_id").agg(F.avg((F.col("d") > 3).cast("double")).alias("share"), F.avg(F.greatest("d", F.lit(0)).cast("double")).alias("late"))
        joined = seen.join(self.risk_suppliers(), "supplier_id")
        return joined.select("scenario_id", "supplier_id", F.when(F.col("share") >= 0.75, 1).otherwise(0).alias("disrupted"), (F.col("avg_lead_time_days") + F.col("late")).alias("lead_time_draw"))

    def edges(self) -> DataFrame:
        """Suppliers that ship the same part on the same day, with the flow between them.

        A part has a few lines a day, so its pairs are few, and a supplier has about seven neighbours at any size of the
        tables: most others are two, three or more hops away. The label leans on the flow and the source's own risk.
        """
        lines = self.table("lineitem").select("l_partkey", F.to_date("l_shipdate").alias("ship"), "l_suppkey", "l_extendedprice")
        lines = lines.filter("l_partkey is not null and ship is not null and l_suppkey is not null").repartition("l_partkey", "ship")
        here = Window.partitionBy("l_partkey", "ship")
        shared = lines.withColumns({"_a": F.min("l_suppkey").over(here), "_b": F.max("l_suppkey").over(here)}).filter("_a <> _b")  # few: all that follows is small
        sold = shared.groupBy("l_partkey", "ship", "l_suppkey").agg(F.sum("l_extendedprice").alias("v"), F.count("*").alias("n"))
        flow = _pairs(sold, "l_partkey", "ship").select("src", "dst", (F.col("v") * F.col("n")).alias("v")).repartition("src").groupBy("src", "dst").agg(C.rounded(F.sum("v"), 2).alias("flow_volume"))
        share = F.col("flow_volume") / F.sum("flow_volume").over(Window.partitionBy("src"))
        spread = F.least(F.lit(1.0), share * (1 + F.pmod(F.col("src") * 37, F.lit(100)) / 50))
        noise = F.pmod(F.col("src") * 31 + F.col("dst") * 17, F.lit(100)) / 100
        lean = C.rounded(F.col("c") + F.pmod(F.col("src") * 37, F.lit(100)) / 100 + noise, 6)
        return flow.withColumn("c", spread).withColumn("contagion_label", (lean > 1.3).cast("int"))

    def order_edges(self) -> DataFrame:
        """Suppliers that share an order, with the flow between them: most pairs of suppliers. An order has a few lines, so its pairs are few.

        An order's suppliers stand in one row, which is sent to each of them; pairs are rows only where the source lies.
        """
        lines = self.table("lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice").filter("l_orderkey is not null and l_suppkey is not null").repartition("l_orderkey")
        sold = lines.groupBy("l_orderkey", "l_suppkey").agg(F.sum("l_extendedprice").alias("v"), F.count("*").cast("int").alias("n"))
        orders = sold.groupBy("l_orderkey").agg(F.collect_list(F.struct("l_suppkey", "v", "n")).alias("of")).filter(F.size("of") > 1)
        each = orders.select(F.explode("of").alias("own"), "of").select(F.col("own.l_suppkey").alias("src"), F.col("own.v").alias("v"), "of")
        others = F.flatten(F.transform(F.filter("of", lambda x: x["l_suppkey"] != F.col("src")), lambda x: F.array_repeat(x["l_suppkey"], x["n"])))  # one for each line
        sent = each.select("src", "v", others.alias("others")).repartition("src")
        flow = sent.select("src", "v", F.explode("others").alias("dst")).groupBy("src", "dst").agg(C.rounded(F.sum("v"), 2).alias("flow_volume"))
        share = F.col("flow_volume") / F.sum("flow_volume").over(Window.partitionBy("src"))
        return flow.withColumn("c", F.least(F.lit(1.0), share * (1 + F.pmod(F.col("src") * 37, F.lit(100)) / 50)))

    def main_edges(self, k: int = 10) -> DataFrame:
        """Of each source the k largest flows."""
        order = Window.partitionBy("src").orderBy(F.col("flow_volume").desc(), "dst")
        return self.edges().withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k).drop("_n")

    def market_skus(self) -> DataFrame:
        """A part as sold to one nation, with each supplier that ships it there: many have a single one."""
        orders = self.table("orders").join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
        lines = self.table("lineitem").select("l_orderkey", "l_partkey", "l_suppkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        return lines.select(F.concat_ws("-", "l_partkey", "c_nationkey").alias("sku_id"), F.col("l_suppkey").alias("supplier_id"))

    def labelled_scores(self) -> DataFrame:
        docs = self.table("documents").select("doc_id", "n_chars")
        p = lambda x: F.pmod(x, F.lit(1000)).cast("double") / 1000
        return self.table("labels").join(docs, "doc_id").select("doc_id", F.col("quality").cast("int").alias("y"), p(F.col("n_chars")).alias("p"), p(F.col("n_chars") * 7).alias("p2"))

    def drift(self) -> tuple[DataFrame, DataFrame]:
        """Events before and from the cut: value, hour and an output score."""
        rows = self.table("events").select("ts", F.col("value").cast("double").alias("value"), F.hour("ts").cast("double").alias("hour"), F.least(F.col("value") / 500, F.lit(1.0)).alias("score"))
        cut = F.lit("2024-01-16").cast("timestamp")
        return rows.filter(F.col("ts") < cut).drop("ts"), rows.filter(F.col("ts") >= cut).drop("ts")

    def demand(self) -> DataFrame:
        """Weekly demand by brand and region, with 0 for weeks without any."""
        orders = self.table("orders").join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(self.table("nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "n_regionkey")
        parts = self.table("part").select("p_partkey", "p_brand")
        week = F.floor(days(F.lit("1995-01-01").cast("date"), "ship") / 7).cast("int")
        lines = self.lines().join(parts, F.col("l_partkey") == F.col("p_partkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        sold = lines.groupBy(F.col("p_brand").alias("sku"), F.col("n_regionkey").alias("region"), week.alias("t")).agg(F.sum("l_quantity").alias("q"))
        span = sold.agg(F.min("t").alias("a"), F.max("t").alias("b"))
        spine = sold.select("sku", "region").distinct().crossJoin(F.broadcast(span)).select("sku", "region", F.explode(F.sequence("a", "b")).alias("t"))
        return spine.join(sold, ["sku", "region", "t"], "left").select("sku", "region", "t", F.coalesce("q", F.lit(0.0)).alias("demand"))

    def risk_events(self) -> DataFrame:
        n_suppliers = self.table("supplier").agg(F.count("*").alias("n_suppliers"))
        value = F.col("value")
        severity = F.when(value < 25, "LOW").when(value < 60, "MEDIUM").when(value < 120, "HIGH").otherwise("CRITICAL")
        status = F.when(F.col("ts") >= F.lit("2024-01-24").cast("timestamp"), "ACTIVE").otherwise("CLOSED")
        return self.table("events").crossJoin(F.broadcast(n_suppliers)).select("event_id", "ts", "event_type", severity.alias("severity"), status.alias("status"), "value", F.array_distinct(F.array(F.pmod("user_id", "n_suppliers"), F.pmod(F.col("user_id") * 7 + F.col("event_id"), F.col("n_suppliers")))).alias("affected_supplier_ids"))
