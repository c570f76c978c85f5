"""The training set, with its SQL, and queries of trained models, which have none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import gold, models, network, scoring, silver
from tidemark.operators import training as training_set
from tidemark.plans.registry import register
from tidemark.plans.relational import country, nodes, ships, sups
from tidemark.plans.sqltext import with_feeds
from tidemark.plans.statistics import FEATURES
from tidemark.sources.adapters import Feeds
from tidemark.sources.stored import store

#: The features of the risk classifier; all are of days before the cut-off.
INPUTS = [
    "on_time_rate_7", "on_time_rate_30", "on_time_rate_90", "ewm_proxy", "delay_mean_30", "delay_mean_90", "delay_std_90", "drift_proxy", "disruption_rate_90", "days_since_disruption", "on_time_streak", "geo_score", "political_stability", "trade_score",
    "volatility", "financial_risk", "payment_delay_proxy", "network_pagerank", "second_order_contagion_score", "lead_time_variance", "trend_proxy", "port_score", "transit_route_risk", "order_volume_30", "order_volume_90", "spend_share_pct",
]

_DATED = [c for c in INPUTS if c not in ("network_pagerank", "second_order_contagion_score")]
_TRAINING = """
with newest as (select * from (select *, row_number() over (partition by supplier_id, event_date order by purchase_order_id desc) as rn from streaks) where rn = 1),
cuts as (select unnest(generate_series(date_trunc('month', min(event_date)) + interval 1 month, date_trunc('month', max(event_date) - interval 29 days), interval 1 month))::date as cutoff from ship),
lab as (select *, case when delay_days > 3 or status in ('EXCEPTION', 'CUSTOMS_HOLD') then 1 else 0 end as label from ship where dq_score >= 0.6),
rd as (select route, event_date, sum(n) over w as n, sum(hits) over w as hits from (select origin_port || '|' || destination_port as route, event_date, count(*) as n, sum(label) as hits from lab group by 1, 2) window w as (partition by route order by event_date)),
base as (select s.supplier_id, upper(country_code) as country, 1 - financial_score / 100 as financial_risk, greatest(coalesce(annual_spend_usd, 0), 0) / (select sum(greatest(coalesce(annual_spend_usd, 0), 0)) from sup) * 100 as share, cutoff from sup s cross join cuts where dq_score >= 0.7),
h as (select b.*, l.* exclude (supplier_id) from base b asof left join newest l on b.supplier_id = l.supplier_id and b.cutoff > l.event_date),
hg as (select h.*, g.* exclude (country_code, event_date) from h asof left join geo g on h.country = g.country_code and h.cutoff > g.event_date),
hr as (select hg.*, rd.n as rn_, rd.hits from hg asof left join rd on hg.origin_port || '|' || hg.destination_port = rd.route and hg.cutoff > rd.event_date)
select supplier_id, cutoff::varchar as cutoff, coalesce((select max(disrupted) from evs where evs.supplier_id = hr.supplier_id and evs.event_date >= cutoff and evs.event_date < cutoff + interval 30 days), 0)::int as label,
  round(coalesce(on_time_7, 1), 4) as on_time_rate_7, round(coalesce(on_time_30, 1), 4) as on_time_rate_30, round(coalesce(on_time_90, 1), 4) as on_time_rate_90, round(coalesce(on_time_30 * 0.2::double + on_time_90 * 0.8::double, 1), 4) as ewm_proxy,
  round(coalesce(delay_30, 0), 4) + 0.0 as delay_mean_30, round(coalesce(delay_90, 0), 4) + 0.0 as delay_mean_90, round(coalesce(delay_std_90, 0), 4) as delay_std_90, round(coalesce(abs(delay_30 - delay_90) / (delay_90 + 1e-9::double), 0), 3) + 0.0 as drift_proxy,
  round(coalesce(disruptions_90 / (total_90 + 1e-9::double), 0), 4) as disruption_rate_90, coalesce(date_diff('day', last_disruption, cutoff), 365)::double as days_since_disruption, coalesce(streak, 30)::double as on_time_streak,
  round(coalesce(geo_score, 0.3::double), 7) as geo_score, round(2.5::double - 5 * coalesce(instability, 0.3::double), 4) as political_stability, round(coalesce(trade_score, 0), 7) as trade_score, round(coalesce(volatility, 0), 7) as volatility, round(coalesce(financial_risk, 0.3::double), 4) as financial_risk,
  round(coalesce(delay_90 / 30, 0), 4) + 0.0 as payment_delay_proxy, round(coalesce(case when delay_90 > 0 then delay_std_90 / delay_90 else 0 end, 0), 3) as lead_time_variance, round(coalesce((delay_30 - delay_90) / 60, 0), 4) + 0.0 as trend_proxy, round(coalesce(port_score, 0), 7) as port_score,
  round(coalesce(case when rn_ >= 10 then hits / rn_::double when rn_ is not null then 0.25::double end, 0), 4) as transit_route_risk, round(coalesce(total_90 / 3::double, 0), 4) as order_volume_30, coalesce(total_90, 0)::double as order_volume_90, round(share, 4) as spend_share_pct from hr"""


def training(f: Feeds) -> DataFrame:
    """The point-in-time set, stored, as fits read it many times; of the shipments only the columns that it rests on."""
    used = ("supplier_id", "event_date", "purchase_order_id", "delay_days", "canonical_status", "dq_score", "origin_port", "destination_port")
    shipments = store(ships(f).select(*used), "bronze-shipments")
    geo = store(country(f).select("country_code", "event_date", *training_set.COUNTRY), "country-days")
    cuts = store(training_set.cutoffs(shipments), "cut-offs")
    return store(training_set.point_in_time(sups(f), shipments, geo, cuts), "training")


@register("risk_training", with_feeds(_TRAINING))
def risk_training(spark: SparkSession, d: str) -> DataFrame:
    """What was known of each supplier at each cut-off, and whether a disrupted shipment came in the 30 days from it on."""
    wide = {"drift_proxy": 3, "lead_time_variance": 3, "geo_score": 7, "trade_score": 7, "volatility": 7, "port_score": 7}
    return training(Feeds(spark, d)).select("supplier_id", F.col("cutoff").cast("string").alias("cutoff"), "label", *(C.rounded(F.col(c).cast("double"), wide.get(c, 4)).alias(c) for c in _DATED))


def split_rows(f: Feeds, names: list[str] = _DATED) -> tuple[DataFrame, DataFrame]:
    """Earlier rows with folds and later ones, features assembled, each row named by supplier and cut-off."""
    rows = training(f).withColumn("sample_id", F.concat_ws("@", "supplier_id", "cutoff"))
    early, late = training_set.time_split(rows, "cutoff")
    early = store(models.folds(early, "sample_id", "label"), "training-rows")
    return models.assemble(early, names), models.assemble(late, names)


@register("gbt_scores")
def gbt_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of cut-offs after all those that the model learned from."""
    early, late = split_rows(Feeds(spark, d))
    scores = models.probability(models.boosted(early, "label", rounds=10), late).select("sample_id", "supplier_id", "cutoff", "label", "p")
    return models.score_table(scores, "sample_id")


@register("cv")
def cv(spark: SparkSession, d: str) -> DataFrame:
    rows = split_rows(Feeds(spark, d))[0].select("label", "fold", "features")
    found = models.search(rows, "label")
    grid = [({p.name: v for p, v in params.items()}, auc) for params, auc in zip(found.getEstimatorParamMaps(), found.avgMetrics, strict=True)]
    return spark.createDataFrame([(int(g["maxDepth"]), float(g["stepSize"]), float(a)) for g, a in grid], "max_depth int, step_size double, mean_auc double")


@register("cv_halving")
def cv_halving(spark: SparkSession, d: str) -> DataFrame:
    """The table of trials of a search over nine dimensions, the grid's settings among them."""
    rows = store(split_rows(Feeds(spark, d))[0].select("label", "fold", "features"), "search-rows")
    return models.halving(rows, "label", [*models.GRID, *models.draw_points(8)])


@register("platt")
def platt(spark: SparkSession, d: str) -> DataFrame:
    return models.calibrated(split_rows(Feeds(spark, d))[0], "label", "sample_id")


@register("attribution")
def attribution(spark: SparkSession, d: str) -> DataFrame:
    """The five strongest features of each supplier and cut-off after those learned from."""
    early, late = split_rows(Feeds(spark, d))
    return models.attribution(early, "label", "sample_id", _DATED, late, strongest=5)


@register("iforest")
def iforest(spark: SparkSession, d: str) -> DataFrame:
    """A line's score of the forest goes with it through its tails, so the two aren't joined."""
    lines = Feeds(spark, d).lines()
    forest = models.isolation_forest(lines, "po_id", list(FEATURES), carried=list(FEATURES))
    rows = store(scoring.tail_rows(forest, lines, list(FEATURES), ["po_id", "iso_score"]), "forest-tails")
    return scoring.ensemble(scoring.row_scores(rows, "po_id"), "iso_score", "score", 0.6)


@register("ensemble_eval")
def ensemble_eval(spark: SparkSession, d: str) -> DataFrame:
    """The ensemble of forest and tails against the disruption labels of shipments, of which nothing else is stored."""
    labels = store(silver.labelled(ships(Feeds(spark, d))).select(F.col("purchase_order_id").alias("po_id"), "label"), "labels")
    return scoring.detector_report(iforest(spark, d).join(labels, "po_id"), "label", "ensemble", 0.6)


@register("contagion_lr")
def contagion_lr(spark: SparkSession, d: str) -> DataFrame:
    f = Feeds(spark, d)
    edges = store(f.edges(), "edges")  # read for each hop and for the rows, which themselves are read for the fit and the scores
    hops = store(network.mean_neighbours(nodes(f), edges, ["p"]), "hops")
    return models.edge_contagion(hops, edges, ["p", "p_hop1", "p_hop2"])


@register("node_risk")
def node_risk(spark: SparkSession, d: str) -> DataFrame:
    """Chance of each supplier to be disrupted in one of the last eight weeks, from its rate of disrupted weeks before and that of
    its neighbours."""
    f = Feeds(spark, d)
    weeks = store(f.scenarios().select("scenario_id", F.col("supplier_id").alias("id"), "disrupted"), "weeks")
    marked = weeks.crossJoin(F.broadcast(weeks.agg((F.max("scenario_id") - 8).alias("last"))))
    late = F.col("scenario_id") > F.col("last")
    known = marked.groupBy("id").agg(F.avg(F.when(~late, F.col("disrupted"))).alias("p"), F.max(F.when(late, F.col("disrupted"))).alias("label")).fillna(0, ["p", "label"])
    ids = nodes(f).select("id").join(known, "id", "left").fillna(0, ["p", "label"])
    return models.node_risk(network.mean_neighbours(ids, f.edges(), ["p"]).join(ids.select("id", "label"), "id"), ["p", "p_hop1", "p_hop2"])


@register("supplier_narrative")
def supplier_narrative(spark: SparkSession, d: str) -> DataFrame:
    """The three strongest reasons for each supplier's risk at the newest cut-off, as text."""
    early, late = split_rows(Feeds(spark, d))
    newest = late.crossJoin(F.broadcast(late.agg(F.max("cutoff").alias("_newest")))).filter("cutoff = _newest").drop("_newest")
    return gold.narrative(models.attribution(early, "label", "supplier_id", _DATED, newest, strongest=3), "supplier_id")


@register("attribution_top")
def attribution_top(spark: SparkSession, d: str) -> DataFrame:
    """The ten features of largest mean attribution."""
    early, late = split_rows(Feeds(spark, d))
    return scoring.importances(models.attribution(early, "label", "sample_id", _DATED, late), "value")
