"""URL filter: host and path rules, and a character language-model ratio for the rest.

URLs that a rule judges are the training text: two interpolated (Witten-Bell) Markov models of order
up to 4 over characters, one of allowed and one of blocked URLs, estimated on all of them but a
held-out part. A URL scores the log-likelihood difference of its characters over their number; the
threshold is where the held-out scores of both classes, taken as normal, are equally far out. Models
and scores are tables: counts are kept per character sequence of five, of which the alphabet bounds
the number, and each distinct URL is scored once.

Defined cases: a URL that is NULL or holds no "://" has an empty host and path, fits no rule and is
scored as an empty text. If either class has no held-out URL the threshold is 0, and without any
training URL every score is 0, so what no rule judges is allowed. Repeated rows get equal verdicts;
extra columns pass through (columns named like an output are replaced). Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrina.llm.common import fresh_name, stored

# The rules of the production filter.
RULES = {
    "org/": "allow",
    "example.org/es/": "block",
    "example.org/en/1": "block",
    "com/fr/": "allow",
    "com/de/": "block",
}
ORDER = 5  # characters of the longest sequence: four of context and one predicted
ALPHABET = 256.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(rest: Column) -> Column:
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)


def path_of(rest: Column) -> Column:
    return F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """Struct of the longest fitting rule and its verdict, or NULL."""
    chosen = F.lit(None)
    for rule in sorted(rules, key=lambda r: (len(r), r.index("/"), r)):  # the last tested first
        name, start = rule[: rule.index("/")], rule[rule.index("/") :]
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        chosen = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(rules[rule]).alias("verdict"))).otherwise(chosen)
    return chosen


def held_out(url: Column) -> Column:
    """Three sixteenths of the URLs, by hash."""
    return F.substring(F.md5(url), 1, 1).isin("0", "1", "2")


def sequences(urls: DataFrame) -> DataFrame:
    """One row per character of ``text`` and its end: ``gram``, the character after its context."""
    padded = F.concat(F.lit("\x02" * (ORDER - 1)), F.col("text"), F.lit("\x03"))
    places = F.sequence(F.lit(1), F.length("text") + 1)
    return urls.withColumn("gram", F.explode(F.transform(places, lambda i: F.substring(padded, i, F.lit(ORDER)))))


def gram_scores(grams: DataFrame) -> DataFrame:
    """``(gram, score)`` of ``(gram, good, bad)`` counts: the log ratio of the smoothed probabilities."""
    each = grams.withColumn("order", F.explode(F.sequence(F.lit(1), F.lit(ORDER)))).withColumns(
        {"tail": F.substring("gram", ORDER + 1 - F.col("order"), F.col("order"))}
    ).withColumn("context", F.substring("tail", F.lit(1), F.col("order") - 1))
    tails = each.groupBy("tail", "context").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    contexts = tails.groupBy("context").agg(
        F.sum("good").alias("h_good"),
        F.sum("bad").alias("h_bad"),
        F.count_if(F.col("good") > 0).alias("k_good"),
        F.count_if(F.col("bad") > 0).alias("k_bad"),
    )
    known = tails.join(contexts, "context").drop("context")
    steps = (
        each.select("gram", "order", "tail")
        .join(known, "tail")
        .groupBy("gram")
        .agg(F.sort_array(F.collect_list(F.struct("order", "good", "bad", "h_good", "h_bad", "k_good", "k_bad"))).alias("steps"))
    )

    def probability(kind: str) -> Column:
        return F.aggregate(
            "steps",
            F.lit(1.0 / ALPHABET),
            lambda p, s: F.when(
                s[f"h_{kind}"] > 0, (s[kind] + s[f"k_{kind}"] * p) / (s[f"h_{kind}"] + s[f"k_{kind}"])
            ).otherwise(p),
        )

    return steps.select("gram", (F.log(probability("good")) - F.log(probability("bad"))).alias("score"))


def url_scores(urls: DataFrame) -> DataFrame:
    """``(url, score)`` of distinct ``(url, text, verdict)``; ``verdict`` is NULL where no rule fits."""
    marked = urls.withColumns(
        {
            "good": ((F.col("verdict") == "allow") & ~held_out(F.col("url"))).cast("int"),
            "bad": ((F.col("verdict") == "block") & ~held_out(F.col("url"))).cast("int"),
        }
    ).fillna(0, ["good", "bad"])
    each = sequences(marked)
    grams = each.groupBy("gram").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    return (
        each.select("url", "gram")
        .join(gram_scores(grams), "gram")
        .groupBy("url")
        .agg((F.sum("score") / F.count("*")).alias("score"))
    )


def threshold(scores: DataFrame) -> float:
    """Of held-out ``(verdict, score)``: equally many standard deviations from both class means."""
    of = {
        r["verdict"]: (r["mean"], r["dev"] + 1e-9)
        for r in scores.groupBy("verdict").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("dev")).collect()
    }
    if "allow" not in of or "block" not in of:
        return 0.0
    (good, good_dev), (bad, bad_dev) = of["allow"], of["block"]
    return (good * bad_dev + bad * good_dev) / (good_dev + bad_dev)


def filter_urls(pages: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """``pages(url, ...)`` with ``host``, ``path``, ``rule`` (NULL where none fits) and ``verdict``."""
    plain = F.coalesce("url", F.lit(""))
    key, verdict = fresh_name(pages, "judged_url"), fresh_name(pages, "judged")
    judged = pages.withColumns({"host": host_of(after_scheme(plain)), "path": path_of(after_scheme(plain)), key: plain})
    judged = judged.withColumn(verdict, ruled(F.col("host"), F.col("path"), rules))
    urls = judged.select(
        F.col(key).alias("url"), F.lower(after_scheme(F.col(key))).alias("text"), F.col(verdict)["verdict"].alias("verdict")
    ).distinct()
    scores, _ = stored(
        urls.join(url_scores(urls), "url").select("url", "verdict", held_out(F.col("url")).alias("held"), "score"), "url-scores"
    )
    bound = threshold(scores.filter("held and verdict is not null"))
    good = fresh_name(judged, "good_url")
    scored = scores.select(F.col("url").alias(key), (F.col("score") >= bound).alias(good))
    return (
        judged.join(scored, key, "left")
        .withColumns(
            {
                "rule": F.col(verdict)["rule"],
                "verdict": F.coalesce(F.col(verdict)["verdict"], F.when(F.col(good), "allow").otherwise("block")),
            }
        )
        .drop(key, verdict, good)
    )
