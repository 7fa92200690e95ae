"""Quality rules whose thresholds come from mergeable quantile sketches.

Each document gets integer measures in thousandths. A sketch of a measure is a log-linear histogram: a value
keeps its leading ``PRECISION`` bits, so a quantile is off by at most one part in 2**(PRECISION - 1), and two
sketches merge by adding counts, in any order, with the same result. Sketches are kept per language and source;
those of small sources are replaced by the merged sketch of their language, and those of small languages by the
merged sketch of all. Fences drawn from the quartiles replace fixed cutoffs.

Defined cases: a null text has no words; a very long text is judged whole, by counts that grow with its words; null
languages and sources form groups of their own; a value equal to a fence is kept; empty tables give empty results;
repeated rows are judged one by one and count as often as they occur; columns of the input named like a measure stay
as they are in ``quality_filter``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import boxed, let, materialize, table, unboxed, words

#: Bits of a value that a sketch keeps.
PRECISION = 8
#: Documents that a source or language needs for thresholds of its own.
MIN_DOCS = 100
#: Measure: (does a low value fail too, slack in thousandths, below which a spread isn't telling).
RULES = {
    "word_length": (True, 1500),
    "symbols": (False, 20),
    "dup_lines": (False, 400),
    "repeats": (False, 250),
    "stutter": (False, 200),
}
#: Fences lie this many spreads (median to quartile) beyond the quartiles.
SPREADS = 4
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _repeat_words(w: Column) -> Column:
    """Words in the 8-word windows that the text holds twice or more."""

    def covered(h: Column) -> Column:
        at = let(
            F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
            lambda s: F.array_sort(
                F.transform(
                    F.filter(s, lambda x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))),
                    lambda x: x["i"],
                )
            ),
        )
        return let(at, lambda p: F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(8), F.coalesce(F.get(p, j + 1) - x, F.lit(8)))), F.lit(0).cast("int"), lambda a, x: a + x))

    hashes = F.when(F.size(w) > 8, F.transform(F.sequence(F.lit(1), F.size(w) - 7), lambda i: F.xxhash64(F.slice(w, i, 8)))).otherwise(F.array().cast("array<bigint>"))
    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))


def measures(text: Column) -> Column:
    """Struct of the base counts and of the measures that the rules judge."""
    t = F.coalesce(text, F.lit(""))

    def of(w: Column, lines: Column) -> Column:
        n, chars = F.size(w), F.length(F.array_join(w, ""))
        symbols = F.length(t) - F.length(F.regexp_replace(t, "[#*$%&|<>]", ""))
        dup = F.size(lines) - F.size(F.array_distinct(lines))
        return let(
            F.struct(n.alias("n"), chars.alias("c"), symbols.alias("s"), dup.alias("d"), _repeat_words(w).alias("r"), F.size(lines).alias("l"), F.size(F.filter(w, lambda a, i: F.coalesce(F.get(w, i - 1) == a, F.lit(False)))).alias("e")),
            lambda x: F.struct(
                x["n"].cast("long").alias("n_words"),
                x["c"].cast("long").alias("word_chars"),
                x["s"].cast("long").alias("n_symbols"),
                x["d"].cast("long").alias("n_dup_lines"),
                x["r"].cast("long").alias("n_repeat_words"),
                _thousandths(x["c"], x["n"]).alias("word_length"),
                _thousandths(x["s"], x["c"]).alias("symbols"),
                _thousandths(x["d"], x["l"]).alias("dup_lines"),
                _thousandths(x["r"], x["n"]).alias("repeats"),
                _thousandths(x["e"], x["n"]).alias("stutter"),
            ),
        )

    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return let(words(text), lambda w: let(lines, lambda x: of(w, x)))


def _thousandths(a: Column, b: Column) -> Column:
    return F.when(b > 0, F.floor(a.cast("long") * 1000 / b)).otherwise(F.lit(0)).cast("long")


def with_measures(df: DataFrame, text: str = "text") -> DataFrame:
    """``__row``, with all columns of ``df``, and ``m``, its measures."""
    return boxed(df).withColumn("m", measures(F.col(f"__row.`{text}`")))


def _bucket(v: Column) -> Column:
    """Upper end of the sketch's bucket that holds ``v``: its bits below the leading ``PRECISION`` set to 1."""
    shift = F.greatest(F.length(F.bin(v)) - PRECISION, F.lit(0))
    return let(shift, lambda s: F.call_function("shiftleft", F.call_function("shiftright", v, s) + F.lit(1).cast("long"), s) - 1)


def sketches(measured: DataFrame) -> DataFrame:
    """lang, source, rule, bucket, n: one sketch for each language, source and rule, of documents above the base rules."""
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("v")) for r in RULES])
    return (
        measured.where(~_base_failed())
        .select("lang", "source", F.explode(rules).alias("x"))
        .groupBy("lang", "source", F.col("x.rule").alias("rule"), _bucket(F.col("x.v")).alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """keys, docs, q25, q50, q75 of the sketches merged by ``keys``; buckets are few, so windows over them are small."""
    merged = sketch.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys)
    below = merged.withColumns({"upto": F.sum("n").over(w.orderBy("bucket")), "docs": F.sum("n").over(w)})
    at = lambda q: F.min(F.when(F.col("upto") * 100 >= F.col("docs") * q, F.col("bucket"))).alias(f"q{q}")
    return below.groupBy(*keys).agg(F.max("docs").alias("docs"), at(25), at(50), at(75))


def fit_thresholds(measured: DataFrame) -> DataFrame:
    """lang, source, and for each rule its lowest and highest value kept; one row for each language and source.

    ``measured`` has lang, source and the fields of ``measures``.
    """
    own = materialize(sketches(measured), "sketch")
    at = [(keys, _quantiles(own, [*keys, "rule"])) for keys in (["lang", "source"], ["lang"], [])]
    groups = own.select("lang", "source", "rule").distinct()
    levels = groups
    for k, (keys, q) in enumerate(at):
        q = q.select(*[F.col(c).alias(f"__{c}") for c in [*keys, "rule"]], F.struct("docs", "q25", "q50", "q75").alias(f"level{k}"))
        levels = levels.join(q, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in [*keys, "rule"]])).drop(*[f"__{c}" for c in [*keys, "rule"]])
    use = F.when(F.col("level0.docs") >= MIN_DOCS, F.col("level0")).when(F.col("level1.docs") >= MIN_DOCS, F.col("level1")).otherwise(F.col("level2"))
    x = levels.select("lang", "source", "rule", use.alias("x"))
    slack = F.coalesce(*[F.when(F.col("rule") == r, F.lit(s)) for r, (_, s) in RULES.items()])
    two_sided = F.coalesce(*[F.when(F.col("rule") == r, F.lit(b)) for r, (b, _) in RULES.items()])
    high = F.col("x.q75") + F.greatest(SPREADS * (F.col("x.q75") - F.col("x.q50")), slack)
    low = F.when(two_sided, F.col("x.q25") - F.greatest(SPREADS * (F.col("x.q50") - F.col("x.q25")), slack)).otherwise(F.lit(-1))
    fences = x.select("lang", "source", "rule", low.cast("long").alias("low"), high.cast("long").alias("high"))
    wide = fences.groupBy("lang", "source").agg(*[F.max(F.when(F.col("rule") == r, F.col(e))).alias(f"{r}_{e}") for r in RULES for e in ("low", "high")])
    return materialize(wide, "thresholds")


def _base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def judge(measured: DataFrame, thresholds: DataFrame) -> DataFrame:
    """``measured`` with base_failed and kept.

    The thresholds are a written table, so the planner broadcasts them by their true size or joins by shuffle.
    Rows of a language and source in which all documents fail the base rules have no thresholds and are not kept.
    """
    t = thresholds.select(F.struct(*thresholds.columns).alias("__t"))
    joined = measured.join(t, F.col("lang").eqNullSafe(F.col("__t.lang")) & F.col("source").eqNullSafe(F.col("__t.source")), "left")
    within = reduce(lambda a, b: a & b, [F.col(r).between(F.col(f"__t.{r}_low"), F.col(f"__t.{r}_high")) for r in RULES])
    return joined.withColumns({"base_failed": _base_failed(), "kept": F.coalesce(~_base_failed() & within, F.lit(False))}).drop("__t")


def quality_filter(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of ``df`` that the rules keep, with its own columns."""
    fields = [*BASE, *RULES]
    flat = with_measures(df, text).select("__row", F.col(f"__row.`{lang}`").alias("lang"), F.col(f"__row.`{source}`").alias("source"), *[F.col(f"m.{c}").alias(c) for c in fields])
    # rows are written with their measures, so that these are computed once; the sketches read their columns alone
    flat = materialize(flat, "measured")
    return unboxed(judge(flat, fit_thresholds(flat)).where("kept").select("__row"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", measures(F.col("text")).alias("m"))
    measured = materialize(docs.select("doc_id", "lang", "source", *[F.col(f"m.{c}").alias(c) for c in [*BASE, *RULES]]), "measures", rebalance=True)
    return judge(measured, fit_thresholds(measured)).select("doc_id", *BASE, "base_failed", "kept", *RULES)


def _oracle() -> str:
    slack = " ".join(f"when '{r}' then {s}" for r, (_, s) in RULES.items())
    low = " or ".join(f"rule = '{r}'" for r, (b, _) in RULES.items() if b)
    stack = " union all ".join(f"select lang, source, '{r}' as rule, {r} as v from m where not base_failed" for r in RULES)
    fence = ", ".join(f"max(case when rule = '{r}' then {e} end) as {r}_{e}" for r in RULES for e in ("low", "high"))
    within = " and ".join(f"{r} between {r}_low and {r}_high" for r in RULES)
    level = lambda k, keys: f"""l{k} as (select {keys} rule, max(docs) as docs, min(case when upto * 100 >= docs * 25 then bucket end) as q25,
          min(case when upto * 100 >= docs * 50 then bucket end) as q50, min(case when upto * 100 >= docs * 75 then bucket end) as q75
        from (select {keys} rule, bucket, sum(n) over (partition by {keys} rule order by bucket) as upto, sum(n) over (partition by {keys} rule) as docs
              from (select {keys} rule, bucket, sum(n) as n from sk group by {keys} rule, bucket)) group by {keys} rule)"""  # noqa: E731
    return rf"""
with d as materialized (
  select row_number() over () as rid, doc_id, lang, source, coalesce(text, '') as t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l
  from documents
), p as (
  select rid, unnest(range(1, len(w) - 6)) as i, w from d where len(w) >= 8
), g as (select rid, i, count(*) over (partition by rid, array_to_string(w[i:i+7], ' ')) as c from p
), r as (select rid, sum(least(8, coalesce(nxt - i, 8))) as n_repeat_words
    from (select rid, i, lead(i) over (partition by rid order by i) as nxt from g where c > 1) group by rid
), m0 as (
  select doc_id, lang, source, len(w) as n_words, coalesce(length(array_to_string(w, '')), 0) as word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols,
    len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) as n_stutter,
    len(l) - len(list_distinct(l)) as n_dup_lines, len(l) as n_lines,
    coalesce(n_repeat_words, 0)::bigint as n_repeat_words
  from d left join r using (rid)
), m as (
  select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
    case when n_words > 0 then word_chars * 1000 // n_words else 0 end as word_length,
    case when word_chars > 0 then n_symbols * 1000 // word_chars else 0 end as symbols,
    case when n_lines > 0 then n_dup_lines * 1000 // n_lines else 0 end as dup_lines,
    case when n_words > 0 then n_repeat_words * 1000 // n_words else 0 end as repeats,
    case when n_words > 0 then n_stutter * 1000 // n_words else 0 end as stutter
  from m0
), v as ({stack}
), sk as (
  select lang, source, rule, (((v >> s) + 1) << s) - 1 as bucket, count(*) as n
  from (select *, greatest(length(bin(v)) - {PRECISION}, 0)::int as s from v) group by all
), {level(0, "lang, source,")}, {level(1, "lang,")}, {level(2, "")},
u as (
  select l0.lang, l0.source, l0.rule,
    case when l0.docs >= {MIN_DOCS} then l0.q25 when l1.docs >= {MIN_DOCS} then l1.q25 else l2.q25 end as q25,
    case when l0.docs >= {MIN_DOCS} then l0.q50 when l1.docs >= {MIN_DOCS} then l1.q50 else l2.q50 end as q50,
    case when l0.docs >= {MIN_DOCS} then l0.q75 when l1.docs >= {MIN_DOCS} then l1.q75 else l2.q75 end as q75
  from l0 join l1 on l0.rule = l1.rule and l0.lang is not distinct from l1.lang join l2 on l0.rule = l2.rule
), f as (
  select lang, source, rule, q75 + greatest({SPREADS} * (q75 - q50), slack) as high,
    case when {low} then q25 - greatest({SPREADS} * (q50 - q25), slack) else -1 end as low
  from (select *, case rule {slack} end as slack from u)
), fw as (select lang, source, {fence} from f group by lang, source)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines, n_repeat_words,
  base_failed, not base_failed and coalesce({within}, false) as kept,
  word_length::bigint as word_length, symbols::bigint as symbols, dup_lines::bigint as dup_lines, repeats::bigint as repeats, stutter::bigint as stutter
from m left join fw on m.lang is not distinct from fw.lang and m.source is not distinct from fw.source
"""


QUERIES = {"op1_quality_rules": op1_quality_rules}
ORACLES = {"op1_quality_rules": _oracle()}
