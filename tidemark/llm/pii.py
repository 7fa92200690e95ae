"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust their score.

Spans are given as kind:start:end in code points, end exclusive, and are found with JVM expressions only: the
pieces between matches give the positions. Patterns are possessive, so no text makes them backtrack or recurse
deeply. Where a pattern begins with a run of characters, a match may only start at the run's start or where the
last match ended, as any later start would be preceded by an earlier one. Places are running sums, taken in blocks of as
many matches as there are blocks, and context is cut from a block's own text, so a text of very many matches takes little
more than its length.

Base kinds are email, ip, card (12 to 19 digits, Luhn) and phone (9 to 15 digits). The method adds iban (mod-97),
secret (a long hexadecimal word, or one that begins like a known provider's key) and account (8 to 18 digits in a row
that no other kind takes, told from other numbers by its context alone). A span's score is its kind's prior, plus
``CONTEXT`` where a word that speaks for its kind occurs within ``NEAR`` code points before it, less ``CONTEXT`` where
one does that speaks against it (samples, checksums, order numbers), within 0 and 1. Added kinds are kept from
``THRESHOLD`` on. Base kinds are kept whatever their score, as the contract has it; their score says how sure they are,
and ``with_spans`` and ``redact`` leave out those below ``least``.

Defined cases: a null text is empty; an empty text has no spans and the hash of the empty string; a very long text is
searched whole, without recursion; spans of one start are ordered by kind as listed; repeated rows are treated alike;
columns of the input named like a result give way to it; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import boxed, let, table, unboxed

LOCAL = "[A-Za-z0-9._%+-]"
LABEL = "[A-Za-z0-9-]"
EMAIL = rf"(?:\G|(?<!{LOCAL})){LOCAL}++@{LABEL}++(?:\.{LABEL}++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]){11,30}+(?![A-Za-z0-9])"
SECRET = r"(?<![A-Za-z0-9+/_])(?:[A-Fa-f0-9]{32,}|(?:AKIA|ASIA)[A-Z0-9]{16}|gh[opsu]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9_-]{20,})(?![A-Za-z0-9+/_])"
ACCOUNT = r"(?<![A-Za-z0-9.+-])[0-9]{8,18}(?![A-Za-z0-9.-])"
#: Score of a span without context, in thousandths.
PRIOR = {"email": 900, "ip": 600, "card": 800, "phone": 700, "iban": 700, "secret": 400, "account": 300}
#: Score of a secret that begins like a provider's key.
MARKED = 700
CONTEXT = 300
THRESHOLD = 600
NEAR = 40
#: Words that speak for a kind, and against it.
NEARBY = {
    "email": r"(?i)\b(?:e-?mail|contact|write|mailto)\b",
    "ip": r"(?i)\b(?:ip|host|server|address)\b",
    "card": r"(?i)\b(?:card|visa|credit|debit|payment)\b",
    "phone": r"(?i)\b(?:tel|phone|call|mobile|fax)\b",
    "iban": r"(?i)\b(?:iban|account|bank|konto|compte|cuenta)\b",
    "secret": r"(?i)\b(?:token|secret|key|password|passwd|bearer|api)\b",
    "account": r"(?i)\b(?:account|acct|konto|compte|cuenta|passport|ssn|social security)\b",
}
AGAINST = {
    "email": r"(?i)\b(?:example|sample|noreply)\b",
    "ip": r"(?i)\b(?:version|release|section|chapter)\b",
    "card": r"(?i)\b(?:order|isbn|tracking|invoice)\b",
    "phone": r"(?i)\b(?:order|isbn|example)\b",
    "iban": r"(?i)\b(?:example|sample|specimen)\b",
    "secret": r"(?i)\b(?:sha1|sha256|md5|checksum|digest|commit|revision|etag)\b",
    "account": r"(?i)\b(?:order|isbn|population|views|bytes)\b",
}
#: Base kinds, in the order that breaks ties of spans with one start.
KINDS = ("email", "ip", "card", "phone")
ADDED = ("iban", "secret", "account")


def luhn(number: Column) -> Column:
    """Whether the digits of ``number`` (digits only) pass the Luhn check."""
    n = F.length(number)
    digits = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(number, n - i + 1, F.lit(1)).cast("int"))
    added = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0)))
    return F.aggregate(added, F.lit(0), lambda a, d: a + d) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number (capital letters and digits only) leaves 1 when divided by 97."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))
    values = F.transform(F.split(turned, ""), lambda c: F.when(c.rlike("[A-Z]"), F.ascii(c) - 55).otherwise(c.cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, v: F.when(v.isNull(), a).otherwise((a * F.when(v > 9, 100).otherwise(10) + v) % 97)) == 1


def _confirmed(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(m, "\\."), lambda p: F.regexp_replace(p, "^0+", "").rlike("^(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return let(digits, lambda d: F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        return mod97(F.regexp_replace(m, "[^A-Z0-9]", ""))
    return F.lit(True)


def _blocks(values: str) -> Column:
    """The numbers of the blocks of an array that isn't empty; blocks have about as many values as there are blocks."""
    return F.sequence(F.lit(0), ((F.size(values) - 1) / _block_size(values)).cast("int"))


def _block_size(values: str) -> Column:
    return F.ceil(F.sqrt(F.size(values))).cast("int")


def _block(values: str, b: Column) -> Column:
    return F.slice(values, b * _block_size(values) + 1, _block_size(values))


def _before(df: DataFrame, made: dict[str, tuple[str, Callable[[Column, Column], Column]]]) -> DataFrame:
    """``df`` with, under each name, for each number of an array what a function makes of 0 and all numbers before it.

    Folds run over the blocks, then over their results, and then within each block from where it begins.
    """
    none = F.array().cast("array<int>")
    run = lambda values, start, f: F.aggregate(values, F.struct(start.alias("at"), none.alias("out")), lambda a, x: F.struct(f(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])
    some = lambda v, x: F.when(F.size(v) > 0, x).otherwise(none)
    totals = lambda v, f: some(v, F.transform(_blocks(v), lambda b: F.aggregate(_block(v, b), F.lit(0), f)))
    inside = lambda k, v, f: some(v, F.flatten(F.transform(_blocks(v), lambda b: run(_block(v, b), F.get(f"{k}_o", b), f))))
    df = df.withColumns({f"{k}_t": totals(v, f) for k, (v, f) in made.items()})
    df = df.withColumns({f"{k}_o": run(F.col(f"{k}_t"), F.lit(0), f) for k, (_, f) in made.items()})
    return df.withColumns({k: inside(k, v, f) for k, (v, f) in made.items()})


def _scored(values: str, text: Column, kind: str) -> Column:
    """start, rank, kind, end, score of each of the placed matches; what stands before them is cut from a block's own text."""
    rank = (*KINDS, *ADDED).index(kind)
    prior = lambda m: F.when(m.rlike(r"^(?:AKIA|ASIA|gh[opsu]_|sk-)"), MARKED).otherwise(PRIOR[kind]) if kind == "secret" else F.lit(PRIOR[kind])
    context = lambda said: F.when(said.rlike(NEARBY[kind]), CONTEXT).otherwise(0) - F.when(said.rlike(AGAINST[kind]), CONTEXT).otherwise(0)

    def scored(block: Column) -> Column:
        first = F.greatest(F.element_at(block, 1)["start"] - NEAR, F.lit(0))
        own = F.struct(first.alias("at"), F.substring(text, first + 1, F.element_at(block, -1)["start"] - first).alias("said"))
        near = lambda o, x: F.substring(o["said"], F.greatest(x["start"] - NEAR - o["at"], F.lit(0)) + 1, F.least(x["start"] - o["at"], F.lit(NEAR)))
        score = lambda o, x: F.greatest(F.lit(0), F.least(F.lit(1000), prior(x["m"]) + let(near(o, x), context)))
        return let(own, lambda o: F.transform(block, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), x["end"].alias("end"), score(o, x).alias("score"))))

    return F.when(F.size(values) > 0, F.flatten(F.transform(_blocks(values), lambda b: scored(_block(values, b))))).otherwise(F.array().cast(_SPANS))


_SPANS = "array<struct<start:int,rank:int,kind:string,end:int,score:int>>"


def _alone(df: DataFrame, spans: str, taken: str) -> DataFrame:
    """``df`` with those of ``spans`` in __alone that overlap none of ``taken``: both in one order, the furthest end of what is
    taken so far on the one side, and the nearest start of what is taken later on the other."""
    marked = lambda a, t: F.transform(a, lambda s: F.struct(s["start"].alias("start"), F.lit(t).alias("taken"), s["end"].alias("end"), s.alias("span")))
    far = F.lit(2**31 - 1)  # starts are held as distances from a number that no place reaches
    both = F.when(F.size(spans) > 0, F.array_sort(F.concat(marked(taken, True), marked(spans, False))))
    df = df.withColumn("__both", both).withColumn("__both", F.coalesce("__both", F.slice(marked(spans, False), 1, 0)))
    df = df.withColumns({"__ends": F.transform("__both", lambda s: F.when(s["taken"], s["end"]).otherwise(0)), "__starts": F.reverse(F.transform("__both", lambda s: F.when(s["taken"], far - s["start"]).otherwise(0)))})
    df = _before(df, {"__reach": ("__ends", lambda a, b: F.greatest(a, b)), "__next": ("__starts", lambda a, b: F.greatest(a, b))})
    at = F.arrays_zip(F.col("__both").alias("s"), F.col("__reach").alias("r"), F.reverse("__next").alias("n"))
    free = F.filter(at, lambda z: ~z["s"]["taken"] & (z["r"] <= z["s"]["start"]) & (far - z["n"] >= z["s"]["end"]))
    return df.withColumn("__alone", F.transform(free, lambda z: z["s"]["span"]))


def find_spans(df: DataFrame, least: int = 0) -> DataFrame:
    """``df`` (of names without two leading underscores but __row) with __spans: all spans of its ``__t``, which is never
    null, in the order of start and kind, with scores in thousandths from ``least`` on.

    A step a projection: each is evaluated once, and the analyzer meets no expression of many levels.
    """
    text = F.col("__t")
    number = text.rlike("[0-9][0-9 -]{10}")
    kinds = {
        "email": (EMAIL, F.contains(text, F.lit("@"))),
        "ip": (IP, text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")),
        "card": (CARD, number),
        "phone": (PHONE, text.rlike(r"\+[0-9]")),
        "iban": (IBAN, text.rlike("[A-Z]{2}[0-9]{2}")),
        "secret": (SECRET, text.rlike("[A-Fa-f0-9]{32}|A[KS]IA[A-Z0-9]|gh[opsu]_|sk-")),
        "account": (ACCOUNT, text.rlike("[0-9]{8}") & text.rlike(NEARBY["account"])),
    }
    own = df.columns
    df = df.withColumns({f"__f_{k}": F.when(needs, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")) for k, (pattern, needs) in kinds.items()})
    step = lambda k, pattern: F.zip_with(F.slice(F.split(text, pattern), 1, F.size(f"__f_{k}")), f"__f_{k}", lambda gap, m: F.length(gap) + F.length(m))
    df = df.withColumns({f"__s_{k}": F.when(F.size(f"__f_{k}") > 0, step(k, pattern)).otherwise(F.array().cast("array<int>")) for k, (pattern, _) in kinds.items()})
    df = _before(df, {f"__b_{k}": (f"__s_{k}", lambda a, x: a + x) for k in kinds})
    place = lambda z: F.struct((z["at"] + z["step"] - F.length(z["m"])).alias("start"), (z["at"] + z["step"]).alias("end"), z["m"].alias("m"))
    df = df.withColumns({f"__p_{k}": F.transform(F.arrays_zip(F.col(f"__b_{k}").alias("at"), F.col(f"__s_{k}").alias("step"), F.col(f"__f_{k}").alias("m")), place) for k in kinds})
    confirmed = lambda k: F.filter(f"__p_{k}", lambda x: _confirmed(k, x["m"]))
    df = df.withColumns({f"__p_{k}": confirmed(k) for k in kinds})
    df = df.withColumns({f"__x_{k}": _scored(f"__p_{k}", text, k) for k in kinds})
    sure = F.filter(F.concat(*[F.col(f"__x_{k}") for k in (*KINDS, "iban", "secret")]), lambda s: (s["rank"] < len(KINDS)) | (s["score"] >= THRESHOLD))
    df = df.withColumns({"__sure": sure, "__accounts": F.filter("__x_account", lambda s: s["score"] >= THRESHOLD)})
    kept = F.concat("__sure", "__alone")
    df = _alone(df, "__accounts", "__sure").withColumn("__spans", F.array_sort(F.filter(kept, lambda s: s["score"] >= least) if least else kept))
    # one row each; a caller's filter on what is made of the spans stops here, and isn't rewritten into all the steps above
    return df.select(*[f"`{c}`" for c in own], F.explode(F.array("__spans")).alias("__spans"))


def with_spans(df: DataFrame, text: str = "text", least: int = 0) -> DataFrame:
    """``df`` and pii, its spans with scores of ``least`` thousandths or more."""
    return unboxed(find_spans(boxed(df).withColumn("__t", F.coalesce(F.col(f"__row.`{text}`"), F.lit(""))), least), F.col("__spans").alias("pii"))


def redact(df: DataFrame, text: str = "text", least: int = 0) -> DataFrame:
    """``df`` with each span of its text replaced by its kind in angle brackets; of overlapping ones the first."""
    box = find_spans(boxed(df).withColumn("__t", F.coalesce(F.col(f"__row.`{text}`"), F.lit(""))), least)
    cut = F.aggregate(
        "__spans",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.when(
            s["start"] >= a["at"],
            F.struct(s["end"].alias("at"), F.concat(a["out"], F.substring(F.col("__t"), a["at"] + 1, s["start"] - a["at"]), F.lit("<"), s["kind"], F.lit(">")).alias("out")),
        ).otherwise(a),
        lambda a: F.concat(a["out"], F.substring(F.col("__t"), a["at"] + 1, F.length(F.col("__t")))),
    )
    return unboxed(box.withColumn("__cut", F.when(F.col(f"__row.`{text}`").isNotNull(), cut)), F.col("__cut").alias(text))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op4_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = find_spans(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("__t"))).withColumnRenamed("__spans", "pii")
    count = lambda k: F.size(F.filter("pii", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("pii", lambda s: s["rank"] < len(KINDS))
    return docs.select(
        "doc_id", *[count(k) for k in KINDS], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("pii")).alias("spans"), *[count(k) for k in ADDED], F.size("pii").cast("long").alias("n_spans"),
        F.array_join(F.transform("pii", lambda s: s["score"].cast("string")), ",").alias("scores"),
    )


QUERIES = {"op4_pii_spans": op4_pii_spans}
ORACLES: dict[str, str] = {}
