"""License scans: windows of a text against license templates by the Dice coefficient over word bigrams.

Text is normalised to lower-case ASCII letters and digits, whatever its lines, so a notice is found wrapped, indented
or in the midst of a long text. A window is a run of bigrams that begins and ends with bigrams of the template; others
at its ends would only lower the coefficient, 2 * common / (window's + template's), over distinct bigrams. A
coefficient of t or more needs at least t / (2 - t) of the template's bigrams and a window of at most (2 - t) / t times
as many, which bounds windows from both sides and prunes templates: one that can reach t in a text shares with it one
of any 1 - t / (2 - t) of its bigrams, and one more.

So the bigrams of all texts are looked up, row by row, in a set of these few of each template, the rarest among the
templates and the longest first; only texts with one of them go on, each distinct text once, and meet their templates in
joins. The set travels with the plan, some ten bytes for each bigram of a third of the templates' text, whatever the
number of documents; templates are a table of any size. The result doesn't depend on the choice of bigrams.

Defined cases: a null text equals an empty one; texts or templates of fewer than two words match nothing; a very long
text is scanned whole, in time that grows with its hits times the template's size; of a template's windows the best
counts, then the first, then the shortest; equal coefficients are ordered by the license's name; equal texts have equal
results; a column of the input named like the result gives way to it; an empty table or no templates give an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import boxed, let, materialize, table, text_key, unboxed
from tidemark.llm.license_texts import TEMPLATES

#: Thousandths.
THRESHOLD = 800
_MATCHES = "array<struct<dice:int,license:string,start:int,end:int>>"


def word_list(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z0-9]+", " ")), " "), lambda x: x != "")


def bigrams(text: Column) -> Column:
    """Hashes of the bigrams, in the order of the text."""
    return let(word_list(text), lambda w: F.transform(F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.xxhash64(F.get(w, i), x)))


def template_table(spark: SparkSession, templates: dict[str, str], threshold: int = THRESHOLD) -> DataFrame:
    """license, b, n, need, most, seeds: bigrams and their number, bounds of a window, and the bigrams to look for."""
    raw = spark.createDataFrame(sorted(templates.items()), "license string, text string")
    words = raw.select("license", word_list(F.col("text")).alias("w"))
    pairs = words.select("license", F.explode(F.array_distinct(F.transform(F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), lambda x, i: F.struct(F.get("w", i).alias("one"), x.alias("two"))))).alias("x"))
    pairs = pairs.select("license", F.xxhash64("x.one", "x.two").alias("h"), (F.length("x.one") + F.length("x.two")).alias("length"))
    spread = pairs.withColumn("known", F.count(F.lit(1)).over(Window.partitionBy("h")))
    ranked = spread.withColumn("rank", F.row_number().over(Window.partitionBy("license").orderBy("known", F.desc("length"), "h")))
    sized = ranked.groupBy("license").agg(F.sort_array(F.collect_set("h")).alias("b"), F.count(F.lit(1)).cast("int").alias("n"), F.sort_array(F.collect_list(F.struct("rank", "h"))).alias("r"))
    need = F.ceil(F.col("n") * threshold / (2000 - threshold)).cast("int")
    most = F.floor(F.col("n") * (2000 - threshold) / threshold).cast("int")
    seeds = F.transform(F.slice("r", F.lit(1), F.col("n") - need + 1), lambda x: x["h"])
    return materialize(sized.select("license", "b", "n", need.alias("need"), most.alias("most"), seeds.alias("seeds")), "templates", rebalance=True)


def _best(b: Column, before: Column, known: Column, n: Column, need: Column, most: Column) -> Column:
    """(dice, -start, -end) of the best window, in bigrams; null without any.

    b: the text's bigrams; before: for each the place where it was last, or -1; known: the template's bigrams.
    """

    def of(hit: Column) -> Column:
        places = F.filter(F.transform(hit, lambda x, i: F.when(x, i)), lambda i: i.isNotNull())
        return let(places, lambda p: F.array_max(F.transform(F.filter(p, lambda x, k: F.get(p, k + need - 1) - x < most), lambda x: window(hit, x))))

    def window(hit: Column, start: Column) -> Column:
        def step(a: Column, k: Column) -> Column:
            fresh = F.get(before, k) < start
            counted = F.struct((a["d"] + F.when(fresh, 1).otherwise(0)).alias("d"), (a["o"] + F.when(fresh & F.get(hit, k), 1).otherwise(0)).alias("o"))
            best = lambda c: F.greatest(a["best"], F.struct(F.floor(2000 * c["o"] / (c["d"] + n)).cast("int").alias("dice"), (-start).alias("start"), (-k).alias("end")))
            return let(counted, lambda c: F.struct(c["d"].alias("d"), c["o"].alias("o"), F.when(c["o"] > a["o"], best(c)).otherwise(a["best"]).alias("best")))

        zero = F.struct(F.lit(0).alias("d"), F.lit(0).alias("o"), F.struct(F.lit(0).alias("dice"), (-start).alias("start"), (-start).alias("end")).alias("best"))
        return F.aggregate(F.sequence(start, F.least(start + most, F.size(b)) - 1), zero, step, lambda a: a["best"])

    return let(F.transform(b, lambda x: F.array_contains(known, x)), of)


def _last_seen(b: Column) -> Column:
    """For each bigram the place where the same one was last, or -1."""
    order = F.array_sort(F.transform(b, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    pairs = let(order, lambda s: F.transform(s, lambda x, j: F.struct(x["i"].alias("i"), F.when(F.get(s, j - 1)["h"] == x["h"], F.get(s, j - 1)["i"]).otherwise(-1).alias("p"))))
    return F.transform(F.array_sort(pairs), lambda x: x["p"])


def license_matches(docs: DataFrame, templates: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """t1, t2, matches: (dice in thousandths, license, first word, end) of the templates in a text, best first.

    docs: text, t1, t2; templates: as ``template_table`` makes them. Texts without a match have no row.
    """
    seeds = templates.select("license", F.explode("seeds").alias("h"))
    wanted = sorted(r["h"] for r in seeds.select("h").distinct().collect())  # of the templates, not of the texts
    if not wanted:
        return docs.sparkSession.createDataFrame([], f"t1 long, t2 long, matches {_MATCHES}")
    texts = docs.where(F.exists(bigrams(F.col("text")), lambda x: x.isin(wanted))).groupBy("t1", "t2").agg(F.first("text").alias("text"))
    said = texts.select("t1", "t2", bigrams(F.col("text")).alias("said"))
    said = materialize(said.select("t1", "t2", "said", _last_seen(F.col("said")).alias("before"), F.array_distinct(F.filter("said", lambda x: x.isin(wanted))).alias("met")), "licenses-texts")
    met = said.select("t1", "t2", F.explode("met").alias("h")).join(seeds, "h").select("t1", "t2", "license").distinct()
    tried = said.drop("met").join(met, ["t1", "t2"]).join(templates.drop("seeds"), "license")
    best = tried.select("t1", "t2", "license", _best(*[F.col(c) for c in ("said", "before", "b", "n", "need", "most")]).alias("x")).where(F.col("x.dice") >= threshold)
    ordered = best.groupBy("t1", "t2").agg(F.sort_array(F.collect_list(F.struct((-F.col("x.dice")).alias("dice"), "license", (-F.col("x.start")).alias("start"), (2 - F.col("x.end")).alias("end")))).alias("m"))
    matches = F.transform("m", lambda x: F.struct((-x["dice"]).alias("dice"), x["license"].alias("license"), x["start"].alias("start"), x["end"].alias("end")))
    return materialize(ordered.select("t1", "t2", matches.cast(_MATCHES).alias("matches")), "licenses-found", rebalance=True)


def with_licenses(df: DataFrame, text: str = "text", templates: dict[str, str] | None = None, threshold: int = THRESHOLD) -> DataFrame:
    """``df`` and license_matches."""
    box = boxed(df)
    t = F.col(f"__row.`{text}`").cast("string")
    known = template_table(df.sparkSession, TEMPLATES if templates is None else templates, threshold)
    found = license_matches(box.select(t.alias("text"), *text_key(t)), known, threshold)
    keys = text_key(t)
    joined = box.join(found, (keys[0] == F.col("t1")) & (keys[1] == F.col("t2")), "left")
    return unboxed(joined, F.coalesce("matches", F.array().cast(_MATCHES)).alias("license_matches"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    m = F.col("license_matches")
    return docs.select(
        "doc_id",
        F.size(m).cast("long").alias("n_matches"),
        F.get(m, F.lit(0))["license"].alias("license"),
        F.get(m, F.lit(0))["dice"].alias("dice"),
        F.array_join(F.array_sort(F.transform(m, lambda x: x["license"])), ",").alias("licenses"),
        F.array_join(F.transform(m, lambda x: F.concat_ws(":", x["license"], x["start"].cast("string"), x["end"].cast("string"))), ",").alias("spans"),
    )


def _oracle() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = " union all ".join(f"select {quoted(name)} as license, {quoted(t)} as text" for name, t in sorted(TEMPLATES.items()))
    said = "list_filter(string_split(lower(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '')"
    return rf"""
with t as ({rows}),
tw as (select license, {said} as w from t),
tb as (select distinct license, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as bg from tw),
tn as (select license, bg, count(*) over (partition by license) as n from tb),
d as materialized (select row_number() over () as rid, doc_id, {said} as w from documents),
g as materialized (select rid, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as bg, unnest(range(0, len(w) - 1)) as pos from d),
h as materialized (select g.rid, g.pos, tn.license, tn.n from (select rid, license from g join tn using (bg) group by rid, license, n having count(distinct bg) * {2000 - THRESHOLD} >= {THRESHOLD} * n) c
  join tn on c.license = tn.license join g on g.rid = c.rid and g.bg = tn.bg),
p as materialized (select rid, pos, coalesce(lag(pos) over (partition by rid, bg order by pos), -1) as prev from g where rid in (select rid from h)),
v as (select a.rid, a.license, a.n, a.pos as s, b.pos as e from h a join h b on a.rid = b.rid and a.license = b.license and b.pos >= a.pos and b.pos < a.pos + a.n * {2000 - THRESHOLD} // {THRESHOLD}),
c as (select v.rid, v.license, v.n, v.s, v.e, count(*) filter (k.prev < v.s) as d, count(*) filter (k.prev < v.s and hk.pos is not null) as o
  from v join p k on k.rid = v.rid and k.pos between v.s and v.e left join h hk on hk.rid = v.rid and hk.license = v.license and hk.pos = k.pos group by v.rid, v.license, v.n, v.s, v.e),
b as (select rid, license, max({{'x': 2000 * o // (d + n), 's': -s, 'e': -e}}) as m from c group by rid, license),
r as (select rid, count(*) as n, list({{'d': -m.x, 'l': license}} order by -m.x, license)[1] as best, string_agg(license, ',' order by license) as licenses,
  string_agg(license || ':' || -m.s || ':' || (2 - m.e), ',' order by -m.x, license) as spans from b where m.x >= {THRESHOLD} group by rid)
select doc_id, coalesce(n, 0)::bigint as n_matches, best.l as license, (-best.d)::int as dice, coalesce(licenses, '') as licenses, coalesce(spans, '') as spans
from d left join r using (rid)
"""


QUERIES = {"op3_license_scan": op3_license_scan}
ORACLES = {"op3_license_scan": _oracle()}
