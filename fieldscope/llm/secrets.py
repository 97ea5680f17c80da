"""Secret scans: three pattern kinds and a randomness battery, in DataFrame
functions only.

The battery takes every long token, infers its encoding and tests the
hypothesis "random in that encoding": chi-squared uniformity of its symbols and
of their classes (upper case, lower case, rest), runs above and below the middle
of the alphabet, serial correlation of neighbouring symbols. Fisher's method
combines them. A random token keeps
the hypothesis; ordinary words, paths and repeated marks reject it. Where
the line is drawn is decided within strata of encoding and length, over the
tokens of all documents, so that the share of ordinary tokens among those kept
as random is bounded in every length class. Both errors are measured on planted
tokens (tests).

The corpus-wide part is a histogram of p-values: its size is bounded by
strata x bins, whatever the input.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

# Fixed patterns of the base kinds, and the least length of what they name.
KINDS = (
    ("assign", r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
# What a text must contain for a kind to be looked for at all. A run of
# hexadecimal digits is maximal, so its length can be asked for directly.
GATES = (r"""(?:[wW][oO][rR][dD]|[wW][dD]|[eE][tT]|[eE][nN]|[eE][yY])["']?\x20*[:=]""", r"AKIA[A-Z0-9]{16}", r"[0-9a-f]{24}")
SEARCH = (KINDS[0][1], KINDS[1][1], r"[0-9a-f]{24,}")

TOKEN, LEAST_TOKEN = r"[A-Za-z0-9+/_=-]{24,}", 24
# encoding, test, alphabet; the first that fits is inferred
ENCODINGS = (
    ("hex", r"^(?:[0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef"),
    ("base32", r"^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", r"^(?:[0-9a-z]+|[0-9A-Z]+)$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base62", r"^[0-9A-Za-z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", r"^(?:[0-9A-Za-z+/]+|[0-9A-Za-z_-]+)={0,2}$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
)
CLASSES = ("A-Z", "a-z", "0-9+/")  # classes of symbols, as parts of a pattern
RATE = 0.01  # of true secrets among the dismissed tokens
FALSE_SHARE = 0.05  # of ordinary tokens among those kept as random
PER_NAT, MOST_BIN = 20, 2_000  # bins of -ln p
UPPER_BINS = 14  # bins of p-values above one half


def _matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, match) in code points, left to right. What stands
    between two matches comes from a split at the same pattern."""
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(F.transform(between, lambda x: F.length(x)).alias("gap"), found.alias("hit"))
    none = F.expr("cast(array() AS array<struct<start: int, end: int, hit: string>>)")

    def put(acc, x):
        start = acc["at"] + x["gap"]
        end = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        one = F.array(F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("hit")))
        return F.struct(end.alias("at"), F.when(x["hit"].isNotNull(), F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    folded = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("out")), put)["out"]
    return F.when(F.size(found) > 0, folded).otherwise(none)


def base_spans(text: Column) -> Column:
    """Array of (start, kind number, end) of the three kinds, in order."""
    none = F.expr("cast(array() AS array<struct<start: int, k: int, end: int>>)")

    def of_kind(k: int) -> Column:
        _, pattern, group, least = KINDS[k]
        named = (lambda x: F.length(F.regexp_extract(x["hit"], pattern, group))) if group else (lambda x: F.length(x["hit"]))
        kept = F.filter(_matches(text, SEARCH[k]), lambda x: named(x) >= least)
        spans = F.transform(kept, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("k"), x["end"].alias("end")))
        return F.when(text.rlike(GATES[k]), spans).otherwise(none)

    parts = [of_kind(k) for k in range(len(KINDS))]
    return F.array_sort(F.concat(*parts))


def _let(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal, by a rational form whose relative error
    stays small in the tail."""

    def from_t(v):
        z, t = v["z"], v["t"]
        poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
        return F.struct(z.alias("z"), (F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly).alias("tail"))

    tail = _let(_let(z, lambda z: F.struct(z.alias("z"), (1 / (1 + 0.2316419 * F.abs(z))).alias("t"))), from_t)
    return _let(tail, lambda v: F.when(v["z"] >= 0, v["tail"]).otherwise(1 - v["tail"]))


def battery(token: Column) -> Column:
    """Struct (stratum, bin): encoding and length class, and the bin of
    -ln p of the combined tests, for one token."""
    encoding = F.when(F.lit(False), F.lit(""))
    for name, fits, _ in ENCODINGS:
        encoding = encoding.when(token.rlike(fits), F.lit(name))
    return _let(F.struct(encoding.alias("e"), token.alias("t")), _tested)


def _tested(x: Column) -> Column:
    encoding, token = x["e"], x["t"]
    of = lambda f: F.coalesce(*[F.when(encoding == name, f(alphabet)) for name, _, alphabet in ENCODINGS])
    # one way of writing: lower case where case says nothing, no padding, one pair of marks
    plain = F.when(encoding.isin("hex", "base36"), F.lower(token)).otherwise(F.translate(F.rtrim(token, F.lit("=")), "-_", "+/"))
    return _let(F.struct(encoding.alias("e"), plain.alias("t"), of(F.lit).alias("a"), of(lambda a: F.lit(float(len(a)))).alias("k")), _judged)


def _judged(x: Column) -> Column:
    length = F.length(x["t"])
    work = F.struct(x["t"].alias("t"), x["a"].alias("a"), x["k"].alias("k"), length.cast("double").alias("n"),
                    F.transform(F.filter(F.split(x["t"], ""), lambda c: c != ""), lambda c: F.call_function("instr", x["a"], c).cast("double")).alias("s"))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda acc, v: acc + v)

    def sums(w: Column) -> Column:
        t, k, n, s = w["t"], w["k"], w["n"], w["s"]
        counts = F.transform(F.sequence(F.lit(1), k.cast("int")), lambda i: n - F.length(F.replace(t, F.substr(w["a"], i, F.lit(1)), F.lit(""))))
        pairs = F.zip_with(F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s) - 1), lambda x, y: F.struct(((x > k / 2) != (y > k / 2)).cast("double").alias("turn"), (x * y).alias("xy")))
        # how upper case, lower case and the rest share the token, against their
        # shares of the alphabet; the likelihood ratio form tells a class that is missing
        left = lambda text, marks: F.length(F.regexp_replace(text, f"[^{marks}]", "")).cast("double")
        classes = F.transform(F.array(*[F.struct(left(t, m).alias("seen"), (left(w["a"], m) / k).alias("share")) for m in CLASSES]), lambda c: F.struct((c["share"] > 0).cast("double").alias("there"), F.when(c["seen"] > 0, 2 * c["seen"] * F.log(c["seen"] / (n * c["share"]))).otherwise(0.0).alias("off")))
        return F.struct(_let(classes, lambda c: F.struct(total(F.transform(c, lambda x: x["off"])).alias("chi"), (total(F.transform(c, lambda x: x["there"])) - 1).alias("df"))).alias("classes"),
                        k.alias("k"), n.alias("n"), total(F.transform(counts, lambda c: c * c)).alias("squares"), total(s).alias("sum"), total(F.transform(s, lambda x: x * x)).alias("sum_squares"),
                        total(F.transform(s, lambda x: (x > k / 2).cast("double"))).alias("high"), (F.element_at(s, 1) + F.element_at(s, -1)).alias("ends"),
                        _let(pairs, lambda p: F.struct(total(F.transform(p, lambda q: q["turn"])).alias("turns"), total(F.transform(p, lambda q: q["xy"])).alias("lag"))).alias("p"))

    def moments(v: Column) -> Column:
        n, mean = v["n"], v["sum"] / v["n"]
        return F.struct(v.alias("v"), F.greatest(v["k"] / n * v["squares"] - n, F.lit(0.0)).alias("chi"), (2 * v["high"] * (n - v["high"]) / n + 1).alias("runs"),
                        (v["sum_squares"] - n * mean * mean).alias("spread"), (v["p"]["lag"] - mean * (2 * v["sum"] - v["ends"]) + (n - 1) * mean * mean).alias("lag"))

    def scores(m: Column) -> Column:
        n, df = m["v"]["n"], m["v"]["k"] - 1
        z_of = lambda chi, df: (F.pow(chi / df, 1 / 3) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        z_chi = F.greatest(z_of(m["chi"], df), z_of(F.greatest(m["v"]["classes"]["chi"], F.lit(0.0)), m["v"]["classes"]["df"]))
        var_runs = (m["runs"] - 1) * (m["runs"] - 2) / (n - 1)
        z_runs = F.when(var_runs > 0, F.abs(1 + m["v"]["p"]["turns"] - m["runs"]) / F.sqrt(var_runs)).otherwise(0.0)
        z_serial = F.when(m["spread"] > 0, F.abs(m["lag"] / m["spread"] + 1 / n) * F.sqrt(n)).otherwise(0.0)
        nats = lambda p: -F.log(F.greatest(p, F.lit(1e-290)))
        # the larger of two statistics of uniformity: its p-value counts twice
        return F.greatest(nats(_upper_tail(z_chi)) - math.log(2), F.lit(0.0)) + nats(2 * _upper_tail(z_runs)) + nats(2 * _upper_tail(z_serial))

    fisher = lambda s: F.least(F.floor(F.greatest(s - F.log(1 + s + s * s / 2), F.lit(0.0)) * PER_NAT), F.lit(MOST_BIN)).cast("int")
    fits = x["e"].isNotNull() & (length >= LEAST_TOKEN)
    length_class = F.floor(F.log2(F.greatest(length, F.lit(1)))).cast("int")
    return F.struct(F.when(fits, F.concat(x["e"], F.lit(":"), length_class)).alias("stratum"),
                    F.when(fits, _let(_let(_let(_let(work, sums), moments), scores), fisher)).alias("bin"))


def tokens(text: Column) -> Column:
    """Array of (start, end, stratum, bin) of the long tokens of a text."""
    none = F.expr("cast(array() AS array<struct<start: int, end: int, stratum: string, bin: int>>)")

    def one(x):
        return _let(battery(x["hit"]), lambda b: F.struct(x["start"].alias("start"), x["end"].alias("end"), b["stratum"].alias("stratum"), b["bin"].alias("bin")))

    return F.when(text.rlike(TOKEN), F.transform(_matches(text, TOKEN), one)).otherwise(none)


def dismissal_bins(docs: DataFrame, rate: float = RATE, false_share: float = FALSE_SHARE) -> dict[str, int]:
    """Per stratum the bin from which on "random" is rejected: the smaller of
    two limits, on binned p-values.

    The first is Benjamini-Hochberg's, so a token that is clearly not random
    goes however rare its stratum is. The second bounds the false discoveries,
    ordinary tokens among those kept: the number of random tokens is estimated
    from the upper half of the p-values, one-sided at 95 %, and as many bins are
    kept as leave the share of others among the kept within ``false_share``.
    Strata and bins are bounded, and so is what reaches the driver: one row per
    stratum.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    each = docs.select(text.alias("t")).filter(F.col("t").rlike(TOKEN)).select(F.explode(tokens(F.col("t"))).alias("x")).filter("x.stratum IS NOT NULL")
    bins = each.groupBy(F.col("x.stratum").alias("stratum"), F.col("x.bin").alias("bin")).count()
    stratum = W.partitionBy("stratum")
    up, down = stratum.orderBy("bin"), stratum.orderBy(F.desc("bin"))
    upper = F.sum(F.when(F.col("bin") < UPPER_BINS, F.col("count")).otherwise(0)).over(stratum)
    ranked = bins.select("stratum", "bin", F.sum("count").over(down).alias("rank"), F.sum("count").over(stratum).alias("m"),
                         F.sum("count").over(up).alias("kept"), F.lead("bin").over(up).alias("next"), upper.alias("upper"))
    p = lambda b: F.exp(-F.col(b) / PER_NAT)
    random = (F.col("upper") + 1 + 1.64 * F.sqrt("upper")) / (1 - math.exp(-UPPER_BINS / PER_NAT))
    within = F.col("kept") * (1 - false_share) <= random * (1 - F.coalesce(p("next"), F.lit(0.0)))
    first = F.min(F.when(p("bin") <= rate * F.col("rank") / F.col("m"), F.col("bin")))
    second = F.max(F.when(within & (F.coalesce("next", F.lit(MOST_BIN + 1)) >= UPPER_BINS), F.coalesce("next", F.lit(MOST_BIN + 1))))
    limits = ranked.groupBy("stratum").agg(F.least(first, second).alias("limit")).filter(F.col("limit") <= MOST_BIN)
    return {r[0]: r[1] for r in limits.collect()}


def find(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """``docs`` with a column ``found``: (start, kind number, end, kind) of the
    base kinds and of ``random`` tokens that overlap none of them, by start.

    Null texts read as empty. Other columns pass unchanged; a column named
    ``found`` is replaced.
    """
    dismissed = dismissal_bins(docs, rate)
    text = F.coalesce(F.col("text"), F.lit(""))
    base = base_spans(text)
    limits = F.create_map(*[F.lit(v) for kv in sorted(dismissed.items()) for v in kv]) if dismissed else None

    def kept(x):
        if limits is None:
            return x["stratum"].isNotNull()
        limit = F.element_at(limits, x["stratum"])
        return x["stratum"].isNotNull() & (limit.isNull() | (x["bin"] < limit))

    staged = docs.withColumn("found", F.struct(base.alias("base"), tokens(text).alias("tokens")))
    free = lambda x: ~F.exists(F.col("found.base"), lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    extra = F.transform(F.filter("found.tokens", lambda x: kept(x) & free(x)), lambda x: F.struct(x["start"].alias("start"), F.lit(3).alias("k"), x["end"].alias("end")))
    return staged.withColumn("found", F.array_sort(F.concat("found.base", extra)))


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in ("assign", "access", "hex", "random")])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """The contract's row per document; ``n_random`` counts the added spans."""
    d = find(docs, rate)
    n = lambda k: F.size(F.filter("found", lambda x: x["k"] == k)).cast("long")
    return d.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
                    F.sha2(_written(F.filter("found", lambda x: x["k"] < 3)), 256).alias("base_sha256"),
                    _written(F.col("found")).alias("spans"), n(3).alias("n_random"))


def redact(docs: DataFrame, mark: str = "[SECRET]", rate: float = RATE) -> DataFrame:
    """``docs`` with every found span (overlapping ones as one) replaced by
    ``mark``; texts without one, null texts and all other columns unchanged."""
    cols = docs.columns
    aside = "_" * max(map(len, cols)) + "found"  # longer than any column, so no clash
    d = find(docs.withColumnRenamed("found", aside) if "found" in cols else docs, rate)
    keep = [F.col(f"`{aside}`").alias("found") if c == "found" else F.col(f"`{c}`") for c in cols]

    def put(acc, x):
        fresh = x["start"] >= acc["at"]
        piece = F.concat(F.substr(F.col("text"), acc["at"] + 1, x["start"] - acc["at"]), F.lit(mark))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], F.array(piece))).otherwise(acc["out"]).alias("out"))

    folded = F.aggregate("found", F.struct(F.lit(0).alias("at"), F.expr("cast(array() AS array<string>)").alias("out")), put,
                         lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(F.col("text"), acc["at"] + 1)))
    d = d.withColumn("text", F.when(F.size("found") > 0, folded).otherwise(F.col("text")))
    return d.select(*keep)
