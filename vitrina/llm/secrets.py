"""Secret scans: plain patterns, and a randomness test battery for everything else.

The battery looks at runs of 20 or more characters of the Base64 alphabets. "=" ends a run, be it
between a name and its value or in a query string, and belongs to it only as padding, with nothing of
the alphabets behind. The smallest alphabet that holds a run is inferred (hexadecimal, letters, Base32,
base36, each in either case, with digits also in groups with dashes; else Base64), its characters become
numbers, and three tests ask whether those could be uniform and independent: chi-squared over the alphabet, runs above and below the middle, and
correlation of neighbours. Fisher's method combines the three. Which candidates are cleared as not
random is decided per length class by Benjamini-Hochberg over all candidates of the corpus, so that
short strings, which tell little, are not judged by the many long ones; what is not cleared is a
secret. The step-up rule runs on a histogram of p-values with fixed bins: a few rows per length class.

Everything is DataFrame functions. Offsets are code points, ends exclusive. NULL and empty texts have
no spans; texts are scanned whole. Repeated rows give equal spans. Other columns pass through (columns
named like an output are replaced).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrina.llm.common import fresh_name

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # a maximal run of 18 or more: shorter ones fail, and so do their tails
HEX = r"[0-9a-f]{16,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}(?:={1,6}(?![A-Za-z0-9+/_=-]))?"
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE36 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
BASE16 = "0123456789abcdef"
LETTERS, BOTH_CASES, SHORTEST = BASE64[:26], BASE64[:52], 20
#: Lower ends of the length classes.
LENGTHS = (20, 28, 40, 64, 128)
#: Share of truly random strings among those cleared that is accepted, and histogram bins per decade.
RATE, BINS, DECADES = 0.05, 20, 40


#: Elements that a scan gathers at a time: arrays grow by copies, so they are kept short.
SCANNED = 256


def scanned(items: Column, zero: Column, advance, emit, kind: str) -> Column:
    """``emit(state, item)`` of every item, the state going on with ``advance(state, item)``; an array of
    ``kind``. Outputs are gathered in pieces, so that long arrays take time in proportion."""
    none = F.array().cast(f"array<{kind}>")
    pieces = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(items) - 1) / SCANNED).cast("int")), lambda k: F.slice(items, k * SCANNED + 1, F.lit(SCANNED))
    )

    def within(acc: Column, piece: Column) -> Column:
        return F.aggregate(
            piece,
            F.struct(acc["state"].alias("state"), none.alias("out")),
            lambda a, x: F.struct(
                advance(a["state"], x).alias("state"), F.concat(a["out"], F.array(emit(a["state"], x))).alias("out")
            ),
        )

    whole = F.aggregate(
        pieces,
        F.struct(zero.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out")),
        lambda acc, piece: let(
            within(acc, piece),
            lambda made: F.struct(made["state"].alias("state"), F.concat(acc["out"], F.array(made["out"])).alias("out")),
        ),
        lambda acc: F.flatten(acc["out"]),
    )
    return F.when(F.size(items) > 0, whole).otherwise(none)


def located(text: Column, hits: Column, pattern: str) -> Column:
    """``(start, end)`` of all matches ``hits`` of ``pattern``: gaps and matches alternate."""
    gaps = F.split(text, pattern, -1)
    start = lambda at, x: at + F.length(x["gap"])
    end = lambda at, x: at + F.length(x["gap"]) + F.length(x["hit"])
    return scanned(
        F.arrays_zip(hits.alias("hit"), F.slice(gaps, 1, F.size(hits)).alias("gap")),
        F.lit(0),
        end,
        lambda at, x: F.struct(start(at, x).alias("start"), end(at, x).alias("end")),
        "struct<start:int,end:int>",
    )


def outside(runs: Column, plain: Column) -> Column:
    """Places in ``runs`` of those that lie within no span of ``plain``. By start, and longest first, a span
    comes before what it holds: a run is outside when no span so far ends at its end or behind."""
    backed = lambda s, place: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), place.alias("place"))
    events = F.array_sort(F.concat(F.transform(plain, lambda s: backed(s, F.lit(-1))), F.transform(runs, backed)))
    found = scanned(
        events,
        F.lit(0),
        lambda end, x: F.when(x["place"] < 0, F.greatest(end, -x["back"])).otherwise(end),
        lambda end, x: F.when((x["place"] >= 0) & (end < -x["back"]), x["place"]),
        "int",
    )
    return F.filter(found, lambda place: place.isNotNull())


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def upper_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal variable, to about 1e-7 (a rational approximation)."""

    def tail(s: Column) -> Column:
        t = s["t"]
        poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
        half = poly * F.exp(-s["z"] * s["z"] / 2) / 2
        return F.when(s["z"] >= 0, half).otherwise(1 - half)

    return let(z, lambda v: let(F.struct(v.alias("z"), (1 / (1 + 0.3275911 / math.sqrt(2) * F.abs(v))).alias("t")), tail))


def encoding(token: Column) -> Column:
    """Struct of the characters that count and the smallest alphabet that holds them; NULL for a run
    with "=" inside or with more than padding behind."""
    body = F.regexp_replace(token, "=+$", "")
    bare = F.translate(body, "-", "")
    of = lambda chars, alphabet: F.struct(chars.alias("chars"), F.lit(alphabet).alias("alphabet"))
    holds = lambda lower, upper: body.rlike(f"^([{lower}]+|[{upper}]+)$") | (
        body.rlike(f"^([{lower}]{{4,}}(-[{lower}]{{4,}})+|[{upper}]{{4,}}(-[{upper}]{{4,}})+)$") & body.rlike("[0-9]")
    )
    return F.when(
        (F.length(body) >= SHORTEST - 2) & ~body.rlike("="),
        F.when(holds("0-9a-f", "0-9A-F"), of(F.lower(bare), BASE16))
        .when(body.rlike("^([a-z]+|[A-Z]+)$"), of(F.upper(bare), LETTERS))
        .when(body.rlike("^[a-zA-Z]+$"), of(body, BOTH_CASES))
        .when(holds("a-z2-7", "A-Z2-7"), of(F.upper(bare), BASE32))
        .when(holds("a-z0-9", "A-Z0-9"), of(F.upper(bare), BASE36))
        .otherwise(of(F.translate(body, "-_", "+/"), BASE64)),
    )


def combined_p(token: Column) -> Column:
    """P-value of the battery under "uniform and independent"; NULL for a run that is no candidate."""

    def tests(e: Column) -> Column:
        size, n = F.length(e["alphabet"]).cast("double"), F.length(e["chars"])
        codes = F.transform(F.split(e["chars"], ""), lambda c: F.instr(e["alphabet"], c).cast("double") - 1)
        return let(F.struct(size.alias("size"), n.cast("double").alias("n"), codes.alias("codes")), sums)

    def sums(s: Column) -> Column:
        codes, last = s["codes"], s["n"].cast("int") - 1
        neighbours = F.zip_with(
            F.slice(codes, F.lit(1), last), F.slice(codes, F.lit(2), last), lambda a, b: F.struct(a.alias("a"), b.alias("b"))
        )
        squares = F.aggregate(
            F.array_distinct(codes),
            F.lit(0.0),
            lambda acc, c: acc + let(F.size(F.filter(codes, lambda x: x == c)).cast("double"), lambda k: k * k),
        )
        high = F.size(F.filter(codes, lambda x: x >= s["size"] / 2)).cast("double")
        changes = F.size(F.filter(neighbours, lambda x: (x["a"] >= s["size"] / 2) != (x["b"] >= s["size"] / 2)))
        middle = (s["size"] - 1) / 2
        product = F.aggregate(neighbours, F.lit(0.0), lambda acc, x: acc + (x["a"] - middle) * (x["b"] - middle))
        return let(
            F.struct(
                s["size"].alias("size"), s["n"].alias("n"), squares.alias("squares"), (2 * high * (s["n"] - high)).alias("mixed"),
                changes.cast("double").alias("changes"), product.alias("product"),
            ),
            scores,
        )

    def scores(s: Column) -> Column:
        size, n = s["size"], s["n"]
        chi = (size / n * s["squares"] - n - (size - 1)) / F.sqrt(2 * (size - 1) * (n - 1) / n)
        spread = F.sqrt(s["mixed"] * F.greatest(s["mixed"] - n, F.lit(0.0)) / (n * n * (n - 1)))
        runs = let(spread, lambda d: F.when(d > 0, (s["changes"] - s["mixed"] / n) / d).otherwise(F.lit(9.0)))
        serial = s["product"] / ((size * size - 1) / 12 * F.sqrt(n - 1))
        evidence = F.array(upper_tail(chi), 2 * upper_tail(F.abs(runs)), 2 * upper_tail(F.abs(serial)))
        bounded = lambda p: F.log(F.greatest(F.least(p, F.lit(1.0)), F.lit(1e-30)))
        half = -F.aggregate(evidence, F.lit(0.0), lambda acc, p: acc + bounded(p))
        # chi-squared with six degrees of freedom
        return let(half, lambda h: F.exp(-h) * (1 + h + h * h / 2))

    return let(encoding(token), lambda e: F.when(e.isNotNull(), tests(e)))


def length_class(length: Column) -> Column:
    return sum(((length >= low).cast("int") for low in LENGTHS[1:]), F.lit(0))


def p_bin(p: Column) -> Column:
    """Histogram bin: higher for smaller p."""
    return F.greatest(F.least(F.floor(-F.log10(F.greatest(p, F.lit(1e-300))) * BINS), F.lit(BINS * DECADES)), F.lit(0)).cast("int")


def clearing_bins(docs: DataFrame, rate: float = RATE) -> dict[int, int]:
    """Per length class the bin from which on candidates are cleared, by Benjamini-Hochberg over all
    candidates of ``docs(text)``. A class without an entry clears none."""
    seen = docs.select(F.explode(matches(F.coalesce("text", F.lit("")), CANDIDATE)).alias("token"))
    tested = seen.select(length_class(F.length("token")).alias("size"), combined_p(F.col("token")).alias("p")).filter("p is not null")
    bins = tested.groupBy("size", p_bin(F.col("p")).alias("bin")).agg(F.count("*").alias("n"))
    within = Window.partitionBy("size")
    steps = bins.withColumns(
        {"below": F.sum("n").over(within.orderBy(F.desc("bin"))), "all": F.sum("n").over(within)}
    )
    passed = steps.filter(F.pow(F.lit(10.0), -F.col("bin") / BINS) <= rate * F.col("below") / F.col("all"))
    return {r["size"]: r["bin"] for r in passed.groupBy("size").agg(F.min("bin").alias("bin")).collect()}


def find_secrets(docs: DataFrame, clear: dict[int, int], out: str = "secrets") -> DataFrame:
    """``docs(text, ...)`` with column ``out``: an array of ``(start, kind, end)`` by start and then
    kind, ``kind`` being the place in ``KINDS``. Random runs within a plain span are not repeated."""
    text = F.coalesce(F.col("text"), F.lit(""))
    kinded = lambda spans, kind: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))
    names, plain_name = [fresh_name(docs, f"{out}_hits{k}") for k in range(4)], fresh_name(docs, f"{out}_plain")
    hits = docs.withColumns({n: matches(text, p) for n, p in zip(names, (ASSIGN, ACCESS, HEX, CANDIDATE))})
    assigns, access, hexes, runs = map(F.col, names)
    long_enough = F.transform(matches(text, ASSIGN, 2), lambda v: F.length(v) >= 12)
    kept_assigns = F.when(
        F.size(assigns) > 0,
        F.transform(
            F.filter(
                F.arrays_zip(located(text, assigns, ASSIGN).alias("span"), long_enough.alias("ok")), lambda x: x["ok"]
            ),
            lambda x: x["span"],
        ),
    ).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
    base = hits.withColumn(
        plain_name,
        F.concat(
            kinded(kept_assigns, 0), kinded(located(text, access, ACCESS), 1), kinded(located(text, hexes, HEX), 2)
        ),
    )
    cleared = F.create_map(*(F.lit(x) for pair in clear.items() for x in pair)) if clear else None

    def is_random(token: Column) -> Column:
        never = F.lit(BINS * DECADES + 1)
        bound = never if cleared is None else F.coalesce(cleared[length_class(F.length(token))], never)
        return F.coalesce(p_bin(combined_p(token)) < bound, F.lit(False))

    plain = F.col(plain_name)
    spans = located(text, runs, CANDIDATE)
    random_runs = F.when(
        F.size(runs) > 0,
        let(
            spans,
            lambda all_spans: F.transform(
                F.filter(outside(all_spans, plain), lambda place: is_random(F.get(runs, place))),
                lambda place: F.get(all_spans, place),
            ),
        ),
    ).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
    found = base.withColumn(out, F.array_sort(F.concat(plain, kinded(random_runs, 3))))
    return found.drop(plain_name, *names)


def written(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
