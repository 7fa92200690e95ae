"""From signals to a verdict: six signals, evidence, abstention with reasons, and text that only tells what was found."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import stats
from tidemark.operators.confidence import GATE, softmin, tier
from tidemark.operators.series import decayed_sum, z_scores
from tidemark.operators.signals import ALPHA, CLAIM_SQL, SIGNALS, SIGNALS_SQL, claim, six_signals
from tidemark.registry import query
from tidemark.session import written
from tidemark.sources.tables import FACTS, daily_events, sales, table


_SOFT = f"case when least({', '.join(SIGNALS)}) <= 0 then 0 else pow(({' + '.join(f'pow({c}, -4)' for c in SIGNALS)}) / 6, -0.25) end"
_FAILED = "concat_ws(',', " + ", ".join(f"case when {c} < {GATE} then '{c}' end" for c in SIGNALS) + ")"
#: Bins of the raw confidence that is calibrated, and the share of months, the earlier ones, whose outcomes calibrate it.
BINS, EARLIER = 20, 0.6
_BELIEF = f"""{SIGNALS_SQL}, r as (select *, round({_SOFT}, 6) as raw, {_FAILED} as failed from s),
  rb as (select *, least(floor(raw * {BINS}), {BINS - 1})::int as bin from r),
  mo as (select month from (select month, row_number() over (order by month) as i, count(*) over () as n from (select distinct month from rb)) where i <= floor({EARLIER} * n)),
  bn as (select bin, count(*) as n, sum(held::int) as y from rb where held is not null and month in (select month from mo) group by bin),
  pr as (select a.bin as lo, b.bin as hi, sum(c.y) / sum(c.n) as m from bn a join bn b on a.bin <= b.bin join bn c on c.bin between a.bin and b.bin group by all),
  lw as (select i.bin, lo, min(m) as m from bn i join pr on lo <= i.bin and hi >= i.bin group by all),
  im as (select bin, round(max(m), 6) as probability from lw group by bin),
  d as (select rb.*, coalesce(probability, raw) as probability, case when failed <> '' then 'abstain' when coalesce(probability, raw) >= 0.75 then 'high' when coalesce(probability, raw) >= 0.5 then 'moderate' when coalesce(probability, raw) >= 0.3 then 'low' else 'insufficient' end as verdict from rb left join im using (bin))"""


@query("signals_c1_c6", f"{SIGNALS_SQL} select * from s")
def signals_query(spark: SparkSession, sf: str) -> DataFrame:
    return six_signals(spark, sf)


def isotonic(pairs: DataFrame, score: str = "raw", outcome: str = "held", bins: int = BINS) -> DataFrame:
    """bin, n, probability: the rising curve nearest to the outcomes' shares by bin of score, weighted by their number.

    Its value at a bin is the greatest, over the runs' beginnings up to it, of the least mean of runs that end at or after
    it: joins over at most ``bins`` rows, whatever the input.
    """
    bin_of = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    b = written(pairs.where(F.col(outcome).isNotNull()).groupBy(bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(outcome).cast("int")).alias("y")), "bins")
    runs = b.select(F.col("bin").alias("lo")).join(b.select(F.col("bin").alias("hi")), F.col("lo") <= F.col("hi"))
    means = runs.join(b, F.col("bin").between(F.col("lo"), F.col("hi"))).groupBy("lo", "hi").agg((F.sum("y") / F.sum("n")).alias("m"))
    least = b.join(means, (F.col("lo") <= F.col("bin")) & (F.col("hi") >= F.col("bin"))).groupBy("bin", "n", "lo").agg(F.min("m").alias("m"))
    return least.groupBy("bin", "n").agg(F.round(F.max("m"), 6).alias("probability"))


def earlier(rows: DataFrame, share: float = EARLIER) -> DataFrame:
    """month: the first ``share`` of the months, so that what is calibrated on them is applied to months it hasn't seen."""
    m = rows.select("month").distinct()
    ordered = m.withColumns({"i": F.row_number().over(Window.orderBy("month")), "n": F.count(F.lit(1)).over(Window.partitionBy())})  # a row a month
    return ordered.where(F.col("i") <= F.floor(share * F.col("n"))).select("month")


def beliefs(spark: SparkSession, sf: str) -> DataFrame:
    """Signals, raw, failed, probability, verdict of each movement: a calibrated tier, or an abstention that names every signal below its gate."""
    x = [F.col(c) for c in SIGNALS]
    failed = F.concat_ws(",", *[F.when(c < GATE, F.lit(n)) for c, n in zip(x, SIGNALS, strict=True)])
    r = written(six_signals(spark, sf).withColumns({"raw": F.round(softmin(*x), 6), "failed": failed}), "raw-beliefs")
    curve = isotonic(r.join(earlier(r), "month", "left_semi")).select("bin", "probability")
    r = r.withColumn("bin", F.least(F.floor(F.col("raw") * BINS), F.lit(BINS - 1)).cast("int")).join(curve, "bin", "left")
    r = r.withColumn("probability", F.coalesce("probability", "raw"))
    return r.withColumn("verdict", F.when(F.col("failed") != "", "abstain").otherwise(tier(F.col("probability"))))


@query("calibration_curve", f"{_BELIEF} select im.bin, n, probability from im join bn using (bin)")
def calibration_curve(spark: SparkSession, sf: str) -> DataFrame:
    """From raw confidence to the share of movements that held, rising."""
    x = [F.col(c) for c in SIGNALS]
    s = six_signals(spark, sf).withColumn("raw", F.round(softmin(*x), 6))
    return isotonic(s.join(earlier(s), "month", "left_semi"))


@query("decide_abstain", f"{_BELIEF} select region, month, raw, failed, probability, verdict from d")
def decide(spark: SparkSession, sf: str) -> DataFrame:
    return beliefs(spark, sf).select("region", "month", "raw", "failed", "probability", "verdict")


@query("abstention_report", f"{_BELIEF}, u as (select unnest(string_split(failed, ',')) as signal from d where failed <> '') select signal, count(*) as n, case signal when 'c1' then 'wait for more history or a larger movement' when 'c2' then 'split by another dimension' when 'c3' then 'refit the baseline' when 'c4' then 'ask the owner of the feed for the missing days' when 'c5' then 'ask for documents on the month' else 'tell by template' end as next_step from u group by signal")
def abstention_report(spark: SparkSession, sf: str) -> DataFrame:
    """What would have to change before a claim could be made, by how often it stood in the way."""
    steps = dict(zip(SIGNALS, ("wait for more history or a larger movement", "split by another dimension", "refit the baseline", "ask the owner of the feed for the missing days", "ask for documents on the month", "tell by template"), strict=True))
    u = beliefs(spark, sf).where("failed <> ''").select(F.explode(F.split("failed", ",")).alias("signal"))
    said = F.coalesce(*[F.when(F.col("signal") == k, F.lit(v)) for k, v in steps.items()])
    return u.groupBy("signal").agg(F.count(F.lit(1)).alias("n")).withColumn("next_step", said)


@query("evidence_bundle", f"{_BELIEF} select region, count(*) as n_bundles, count(*) filter (verdict = 'abstain') as n_abstained, round(sum(abs(impact)), 2) as impact, count(distinct lead) as leads from d group by region")
def evidence_bundle(spark: SparkSession, sf: str) -> DataFrame:
    """Bundles as nested values, written to JSON and read again: what is told later comes from them alone."""
    scope = F.struct("region", F.col("month").cast("string").alias("month"))
    bundle = F.struct(scope.alias("scope"), F.col("impact").alias("gap_abs"), "lead", F.struct(*SIGNALS).alias("signals"), F.split("failed", ",").alias("failed"), F.col("verdict").alias("tier"))
    text = beliefs(spark, sf).select(F.to_json(bundle).alias("j"))
    schema = "scope struct<region:string,month:string>, gap_abs double, lead string, signals struct<c1:double,c2:double,c3:double,c4:double,c5:double,c6:double>, failed array<string>, tier string"
    b = text.select(F.from_json("j", schema).alias("b")).select("b.*")
    return b.groupBy(F.col("scope.region").alias("region")).agg(F.count(F.lit(1)).alias("n_bundles"), F.count_if(F.col("tier") == "abstain").alias("n_abstained"), F.round(F.sum(F.abs("gap_abs")), 2).alias("impact"), F.count_distinct("lead").alias("leads"))


def chance(p: Column) -> Column:
    """Four digits, halves up: engines print a tie differently."""
    return F.format_string("%.4f", F.floor(p * 10000 + 0.5) / 10000)


_PERSONAS = {"executive": "{region} {claim} in {month}.", "analyst": "{region} {claim} in {month}, led by {lead}; p = {p}, {stories} stories, confidence {tier}.", "operator": "{month}: check {lead} in {region}."}
_SAID = {
    "executive": "region || ' ' || claim || ' in ' || month || '.'",
    "analyst": "region || ' ' || claim || ' in ' || month || ', led by ' || lead || '; p = ' || printf('%.4f', floor(p * 10000 + 0.5) / 10000) || ', ' || stories || ' stories, confidence ' || verdict || '.'",
    "operator": "month || ': check ' || lead || ' in ' || region || '.'",
}


@query("narrative_template", f"{_BELIEF}, c as (select *, {CLAIM_SQL} as claim from d), n as ({' union all '.join(f'select region, month, verdict, {chr(39)}{k}{chr(39)} as persona, {v} as told from c' for k, v in _SAID.items())}) select region, month, persona, case when verdict = 'abstain' then 'No claim about ' || region || ' in ' || month || ': the data cannot support one.' else told end as said from n")
def narrative_template(spark: SparkSession, sf: str) -> DataFrame:
    """A sentence for each persona from the bundle alone; an abstention says so and tells no number."""
    d = beliefs(spark, sf)
    values = {"region": F.col("region"), "month": F.col("month").cast("string"), "claim": claim(F.col("pct"), F.col("impact")), "lead": F.col("lead"), "p": chance(F.col("p")), "stories": F.col("stories").cast("string"), "tier": F.col("verdict")}

    def filled(template: str) -> Column:
        pieces = re.split(r"\{(\w+)\}", template)
        return F.concat(*[values[x] if k % 2 else F.lit(x) for k, x in enumerate(pieces)])

    told = F.explode(F.array(*[F.struct(F.lit(k).alias("persona"), filled(v).alias("told")) for k, v in _PERSONAS.items()]))
    none = F.concat(F.lit("No claim about "), "region", F.lit(" in "), F.col("month").cast("string"), F.lit(": the data cannot support one."))
    n = d.select("region", "month", "verdict", told.alias("x"))
    return n.select("region", "month", "x.persona", F.when(F.col("verdict") == "abstain", none).otherwise(F.col("x.told")).alias("said"))


@query("golden_path", f"{_BELIEF}, g as (select region, month, verdict, abs(z) >= 1.5 and abs(pct) >= 0.1 as material, p <= {ALPHA} as detected from d) select detected, material, verdict, count(*) as n from g group by all")
def golden_path(spark: SparkSession, sf: str) -> DataFrame:
    """From detection over materiality to the verdict: how many movements take each path."""
    g = beliefs(spark, sf)
    return g.groupBy((F.col("p") <= ALPHA).alias("detected"), ((F.abs("z") >= 1.5) & (F.abs("pct") >= 0.1)).alias("material"), "verdict").agg(F.count(F.lit(1)).alias("n"))


#: What the evidence is asked for, ranks of sources, characters of a whole story, and figures of a well-sourced one.
_ASKED, _TIERS, _WHOLE, _FIGURES = ("license", "token", "the", "rights"), 4, 2000.0, 10.0


def evidence_weight(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, source, n_chars) with source_tier and conf: the share of the question's words that a document
    holds, its source's tier, how much of a whole story it is, and how many figures can be extracted, equally.

    Tiers come from a source's standing: the number that its name ends with, as a registry of sources would have it.
    """
    words = F.array_distinct(F.split(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z0-9]+", " "), " "))
    held = F.size(F.array_intersect(words, F.array(*map(F.lit, _ASKED)))) / float(len(_ASKED))
    figures = F.least(F.lit(1.0), F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[0-9]+"), F.lit(0))) / _FIGURES)
    tier = F.coalesce(F.nullif(F.regexp_extract(F.coalesce("source", F.lit("")), "([0-9]+)$", 1), F.lit("")).cast("int"), F.lit(0)) % _TIERS
    whole = F.least(F.lit(1.0), F.coalesce("n_chars", F.lit(0)) / _WHOLE)
    return docs.withColumn("source_tier", tier).withColumn("conf", F.round(0.25 * held + 0.25 * (1 - F.col("source_tier") / float(_TIERS)) + 0.25 * whole + 0.25 * figures, 6))


_WORDS_SQL = "list_distinct(string_split(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g'), ' '))"
_WEIGHT = f"""t as (select *, (coalesce(nullif(regexp_extract(coalesce(source, ''), '([0-9]+)$', 1), '')::int, 0) % {_TIERS})::int as source_tier from documents),
  ev as (select *, round(0.25 * len(list_intersect({_WORDS_SQL}, {list(_ASKED)})) / {float(len(_ASKED))}::double + 0.25 * (1 - source_tier / {float(_TIERS)}::double) + 0.25 * least(1.0, coalesce(n_chars, 0) / {_WHOLE}::double) + 0.25 * least(1.0, len(regexp_extract_all(coalesce(text, ''), '[0-9]+')) / {_FIGURES}::double), 6) as conf from t)"""


@query("evidence_conf", f"with {_WEIGHT} select doc_id, conf, source_tier from ev")
def evidence_conf(spark: SparkSession, sf: str) -> DataFrame:
    """How much each document counts as evidence."""
    return evidence_weight(table(spark, sf, "documents")).select("doc_id", "conf", "source_tier")


@query("corroboration", f"with {_WEIGHT}, d as (select lang, md5(text) as story, max(round(0.6 * conf, 6)) as p from ev group by all), t2 as (select lang, round(1 - exp(sum(ln(1 - least(p, 1 - 1e-9)))), 8) as any_of, count(*) as stories from d where p >= 0.3 group by 1) select *, any_of >= 0.3 as sufficient from t2")
def corroboration(spark: SparkSession, sf: str) -> DataFrame:
    """Independent stories that each may hold, copies counted once; too little of it and the engine abstains."""
    d = evidence_weight(table(spark, sf, "documents")).groupBy("lang", F.md5("text").alias("story")).agg(F.max(F.round(0.6 * F.col("conf"), 6)).alias("p")).where("p >= 0.3")
    any_of = F.round(1 - F.exp(F.sum(F.log(1 - F.least(F.col("p"), F.lit(1 - 1e-9))))), 8)
    return d.groupBy("lang").agg(any_of.alias("any_of"), F.count(F.lit(1)).alias("stories")).withColumn("sufficient", F.col("any_of") >= 0.3)


@query("min_attainable_p", f"{FACTS} select series, count(*) as n, round(1 / (count(*) + 1), 8) as min_p, count(*) >= 5 / 0.05 - 1 as conformal_can_reject from daily_events group by 1")
def min_attainable_p(spark: SparkSession, sf: str) -> DataFrame:
    """The smallest conformal p that a history can give, and whether a scan of five series could reject by it."""
    n = F.count(F.lit(1))
    return daily_events(spark, sf).groupBy("series").agg(n.alias("n"), F.round(1 / (n + 1), 8).alias("min_p"), (n >= 5 / 0.05 - 1).alias("conformal_can_reject"))


_GRID = (1.0, 2.0, 4.0, 7.0)


@query("adstock_halflife", f"{FACTS}, w as (select t, max(case when series = 'purchase' then y end) as y, max(case when series = 'click' then y end) as x from daily_events group by t), g as (select unnest({list(_GRID)}) as h), a as (select h, u.t, any_value(u.y) as y, sum(w.x * pow(0.5, (u.t - w.t) / h)) as s from w u join w on w.t <= u.t, g group by h, u.t), r as (select h, regr_r2(y, s) as r2 from a group by h) select h as half_life, round(r2, 6) as r2, row_number() over (order by round(r2, 9) desc, h) = 1 as chosen from r")
def adstock_halflife(spark: SparkSession, sf: str) -> DataFrame:
    """The half-life of carry-over whose regression fits best, all candidates in one job."""
    pick = lambda s: F.max(F.when(F.col("series") == s, F.col("y")))
    w = written(daily_events(spark, sf).groupBy("t").agg(pick("purchase").alias("y"), pick("click").alias("x")), "two-series")
    a = None
    for h in _GRID:  # no power grows with t
        one = decayed_sum(w.withColumns({"h": F.lit(h), "series": F.lit(str(h))}), "x", 0.5 ** (1 / h), "s").select("h", "t", "y", "s")
        a = one if a is None else a.unionByName(one)
    r = a.groupBy("h").agg(F.regr_r2("y", "s").alias("r2"))
    first = F.row_number().over(Window.orderBy(F.round("r2", 9).desc(), "h")) == 1
    return r.select(F.col("h").alias("half_life"), F.round("r2", 6).alias("r2"), first.alias("chosen"))


@query("croston_tsb")
def croston_tsb(spark: SparkSession, sf: str) -> DataFrame:
    """Forecasts of intermittent demand by product: size and chance of a sale, smoothed apart."""
    month = F.months_between(F.trunc("d", "month"), F.lit("1995-01-01").cast("date")).cast("int").alias("t")
    return smoothed(sales(spark, sf).groupBy("sku", month).agg(F.sum("units").alias("units")))


def smoothed(monthly: DataFrame) -> DataFrame:
    """sku, chance, size, forecast of each product. monthly: sku, t (month), units; a row a month with sales.

    A product is one row with as many values as months, and an Arrow batch of products is smoothed at once.
    """
    series = monthly.groupBy("sku").agg(F.sort_array(F.collect_list(F.struct("t", "units"))).alias("s"))
    series = series.select("sku", F.col("s.t").alias("t"), F.transform("s.units", lambda u: u.cast("double")).alias("units"))
    return series.mapInArrow(stats.tsb_batches, "sku long, chance double, size double, forecast double")


#: Words that affirm and that deny; what a document says more of is its stance.
_YES, _NO = ("up", "more", "rose", "gain", "increase", "all", "good", "better", "first", "new"), ("down", "less", "fell", "loss", "decrease", "not", "no", "never", "bad", "without")


def stances(docs: DataFrame, event: Column) -> DataFrame:
    """event, n, agreeing, agreement, contradictory: documents of an event by their stance; those without one don't count."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+", " "), " ")
    said = lambda of: F.size(F.filter("w", lambda x: x.isin(*of)))
    d = docs.select(event.alias("event"), words.alias("w")).select("event", said(_YES).alias("yes"), said(_NO).alias("no")).where("yes <> no")
    n, yes = F.count(F.lit(1)), F.count_if(F.col("yes") > F.col("no"))
    return d.groupBy("event").agg(n.alias("n"), yes.alias("agreeing"), F.round(yes / n, 8).alias("agreement"), ((yes > 0) & (yes < n)).alias("contradictory"))


@query("contradictions", f"with w as (select source as event, string_split(regexp_replace(lower(coalesce(text, '')), '[^a-z]+', ' ', 'g'), ' ') as w from documents), d as (select event, len(list_filter(w, lambda x: list_contains({list(_YES)}, x))) as y, len(list_filter(w, lambda x: list_contains({list(_NO)}, x))) as n from w) select event, count(*) as n, count(*) filter (y > d.n) as agreeing, round(count(*) filter (y > d.n) / count(*), 8) as agreement, count(*) filter (y > d.n) not in (0, count(*)) as contradictory from d where y <> d.n group by 1")
def contradictions(spark: SparkSession, sf: str) -> DataFrame:
    """How far the documents of one source agree, by what they say."""
    return stances(table(spark, sf, "documents"), F.col("source"))


@query("false_positive_rate", f"{FACTS}, z as (select series, t, (y - avg(y) over (partition by series)) / stddev(y) over (partition by series) as z from daily_events) select count(*) as n, count(*) filter (abs(z) > 3) as alarms, round(count(*) filter (abs(z) > 3) / count(*), 8) as rate from z where t between 5 and 20")
def false_positive_rate(spark: SparkSession, sf: str) -> DataFrame:
    """Alarms in a period without events."""
    alarm = F.count_if(F.abs("z") > 3)
    return z_scores(daily_events(spark, sf)).where("t between 5 and 20").agg(F.count(F.lit(1)).alias("n"), alarm.alias("alarms"), F.round(alarm / F.count(F.lit(1)), 8).alias("rate"))


_ORDER = ("insufficient", "low", "moderate", "high")


@query("entailment_cap", f"{_BELIEF} select case when verdict = 'high' then 'moderate' else verdict end as verdict, count(*) as n from d group by 1")
def entailment_cap(spark: SparkSession, sf: str) -> DataFrame:
    """Without a model that judges entailment only numbers are checked, and no tier goes above moderate."""
    d = decide(spark, sf)
    capped = F.when(F.col("verdict") == _ORDER[3], _ORDER[2]).otherwise(F.col("verdict"))
    return d.groupBy(capped.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query("adaptation_route", f"{FACTS}, s as (select sku, count(distinct d) as n_days, count(distinct region) as regions, stddev(units) / avg(units) as cv from sales group by 1), l as (select date_diff('day', min(d), max(d)) + 1 as len from sales) select sku, case when n_days < 28 then 'pooled_launch' when n_days / len < 0.02 then 'croston_tsb' when regions < 2 then 'correlated_kpis' when cv > 0.6 then 'poisson_bands' else 'mstl' end as operator from s, l")
def adaptation_route(spark: SparkSession, sf: str) -> DataFrame:
    """Which baseline a product's data can bear: one pass over the sales, whose days and regions are sets by product."""
    days, regions = F.size(F.collect_set("d")), F.size(F.collect_set("region"))
    lines = sales(spark, sf).select("sku", "d", "region", "units").repartition("sku")  # lines travel as they are, not as sets of one line each
    s = lines.groupBy("sku").agg(days.alias("n"), regions.alias("regions"), (F.stddev("units") / F.avg("units")).alias("cv"), F.min("d").alias("first"), F.max("d").alias("last"))
    s = written(s, "products")
    s = s.crossJoin(s.agg((F.datediff(F.max("last"), F.min("first")) + 1).alias("len")))  # one row
    operator = F.when(F.col("n") < 28, "pooled_launch").when(F.col("n") / F.col("len") < 0.02, "croston_tsb").when(F.col("regions") < 2, "correlated_kpis").when(F.col("cv") > 0.6, "poisson_bands").otherwise("mstl")
    return s.select("sku", operator.alias("operator"))
