"""Quality rules: word and repetition counts, and divergence from language references.

A document is kept when it passes the base rules and its histograms do not diverge from those of its
language: the Jensen-Shannon distance (base 2, 0 to 1) between the document and the reference is
taken over character classes and over common words, each only when the text is long enough for the
figure to mean anything. The references are measured on all documents of a language that pass the
base rules, for every language of the corpus: the common words of the four below are given, those of
any other are its ``FREQUENT_WORDS`` most frequent ones, counted by Spark. What reaches the driver is one
row per language and histogram cell, of which there are fixed numbers; languages that are not given need
``MIN_DOCUMENTS`` and one in ``MOST_LANGUAGES`` of all documents, which bounds their number.

Defined cases: a NULL or empty text has no words and fails the base rules. For a document whose language
is NULL or has no reference only the base rules count: a clean text of a language that the references
do not know is far from all of them. Texts are judged whole. Repeated rows
get equal verdicts; other columns pass through (a column named like the output is replaced).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrina.llm.common import short_batches, stored

# Common function words by language, whose frequencies are measured on the corpus.
COMMON_WORDS = {
    "en": "the of and to in a is that for it as was with be by on not he his from at this are or an they which you have had",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont la avec son aux",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si",
}
SPACES = "\t\n\x0b\x0c\r "
SYMBOLS = "#*$%&|<>"
#: Languages that are not given: their common words, and what makes a reference usable.
FREQUENT_WORDS, MIN_DOCUMENTS, MOST_LANGUAGES = 50, 100, 10_000
CLASSES = 7  # lower, upper, digit, white space, sentence punctuation, other ASCII, beyond ASCII
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rules:
    """``min_chars`` and ``min_words`` guard the two distances, which are noisy below them. Up to
    ``steady_chars`` bytes and ``steady_words`` words they may be larger, by up to the slack."""

    min_base_words: int = 50
    max_repeat_percent: int = 50
    min_chars: int = 200
    min_words: int = 100
    steady_chars: int = 1_000
    class_slack: float = 0.06
    max_class_distance: float = 0.315
    steady_words: int = 300
    word_slack: float = 0.03
    max_word_distance: float = 0.33


def _class_table() -> np.ndarray:
    kinds = np.full(256, 5)
    kinds[128:] = 6
    for kind, chars in enumerate((range(97, 123), range(65, 91), range(48, 58), map(ord, SPACES), map(ord, ".,;:!?'\"()-"))):
        kinds[list(chars)] = kind
    return kinds


CLASS_OF_BYTE = _class_table()


def class_histogram(raw: bytes) -> np.ndarray:
    """UTF-8 bytes by character class. A character beyond ASCII counts once per byte."""
    by_byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    return np.bincount(CLASS_OF_BYTE, weights=by_byte, minlength=CLASSES)


class TextFacts:
    """What one pass over a text gives: the base counts and the distinct words with their counts."""

    def __init__(self, text: str | None) -> None:
        text = text or ""
        self.raw = raw = text.encode()
        words = raw.split()  # bytes split on exactly the six ASCII white-space characters
        index: dict[bytes, int] = {}
        ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
        self.words, self.counts = index, np.bincount(ids, minlength=len(index)) if words else np.zeros(0, np.int64)
        lines = [line for line in raw.split(b"\n") if line.strip(b"\t\n\x0b\x0c\r ")]
        self.base = (
            len(words),
            len(text) - sum(map(text.count, SPACES)),
            sum(map(text.count, SYMBOLS)),
            len(lines) - len(set(lines)),
            repeated_words(ids, len(index)),
        )


def repeated_words(ids: np.ndarray, distinct: int, width: int = 3) -> int:
    """Words in windows of ``width`` words that the text holds twice or more."""
    n = ids.size - width + 1
    if n < 2:
        return 0
    key, span = ids[:n], distinct
    for k in range(1, width):
        if span * distinct >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1]
            span = n
        key, span = key * distinct + ids[k : n + k], span * distinct
    order = np.argsort(key)
    key = key[order]
    same = key[1:] == key[:-1]
    again = np.zeros(n, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    edges = np.zeros(ids.size + 1, np.int64)
    edges[:n] += again
    edges[width : n + width] -= again
    return int((np.cumsum(edges[:-1]) > 0).sum())


def base_fails(base: tuple[int, ...], rules: Rules) -> bool:
    return base[0] < rules.min_base_words or 100 * base[4] > rules.max_repeat_percent * base[0]


def class_bound(size: int, rules: Rules) -> float:
    """Largest class distance allowed for a text of ``size`` bytes."""
    return rules.max_class_distance + rules.class_slack * max(0.0, 1 - size / rules.steady_chars)


def word_bound(words: int, rules: Rules) -> float:
    """Largest common-word distance allowed for a text of ``words`` words."""
    return rules.max_word_distance + rules.word_slack * max(0.0, 1 - words / rules.steady_words)


def plain_words(facts: TextFacts) -> Iterator[tuple[str, int]]:
    """Words of up to 13 bytes with their counts, case and edge punctuation aside."""
    for (word, _), n in zip(facts.words.items(), facts.counts.tolist()):
        if len(word) < 14:
            yield word.decode().strip(".,;:!?\"'()").lower(), n


def common_word_histogram(facts: TextFacts, words: dict[str, int]) -> np.ndarray:
    """Counts of the listed words, and of all others last."""
    found = np.zeros(len(words) + 1)
    for word, n in plain_words(facts):
        at = words.get(word)
        if at is not None:
            found[at] += n
    found[-1] = facts.counts.sum() - found[:-1].sum()
    return found


def js_distance(a: np.ndarray, b: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms, base 2."""
    p, q = a / a.sum(), b / b.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)
    return float(np.sqrt(max(0.0, parts.sum() / 2)))


def word_index(lang: str) -> dict[str, int]:
    return {w: i for i, w in enumerate(dict.fromkeys(COMMON_WORDS[lang].split()))}


@dataclass(frozen=True)
class Reference:
    """What texts of one language look like: the class histogram, the common words and their histogram."""

    classes: np.ndarray
    index: dict[str, int]
    words: np.ndarray


def language_references(docs: DataFrame, rules: Rules = Rules()) -> dict[str, Reference]:
    """References of the languages that ``docs(text, lang)`` holds, over all documents that pass the base
    rules."""
    given = {lang: word_index(lang) for lang in COMMON_WORDS}
    known = docs.select("lang", "text").filter("lang IS NOT NULL AND text IS NOT NULL")

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, list[np.ndarray]] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                facts = TextFacts(text)
                if base_fails(facts.base, rules):
                    continue
                words = common_word_histogram(facts, given[lang]) if lang in given else np.zeros(0)
                found = [class_histogram(facts.raw), words, np.ones(1)]
                sums[lang] = [a + b for a, b in zip(found, sums[lang])] if lang in sums else found
        cells = [(lang, kind, i, n) for lang, found in sums.items() for kind, h in enumerate(found) for i, n in enumerate(h)]
        yield pd.DataFrame(cells, columns=["lang", "kind", "cell", "n"])

    cells = known.mapInPandas(gather, "lang string, kind int, cell int, n double").groupBy("lang", "kind", "cell")
    measured, _ = stored(cells.agg(F.sum("n").alias("n")), "references")
    documents = measured.filter("kind = 2").select("lang", F.col("n").alias("documents"))
    least = max(MIN_DOCUMENTS, (documents.agg(F.sum("documents")).first()[0] or 0) / MOST_LANGUAGES)
    usable = documents.filter(F.col("lang").isin(*given) | (F.col("documents") >= least))
    cells = measured.join(usable.select("lang"), "lang", "left_semi").collect()
    classes: dict[str, np.ndarray] = {}
    words = {lang: np.zeros(len(index) + 1) for lang, index in given.items()}
    for c in cells:
        if c.kind == 0:
            classes.setdefault(c.lang, np.zeros(CLASSES))[c.cell] = c.n
        elif c.kind == 1:
            words[c.lang][c.cell] = c.n
    others = frequent_words(known, sorted(set(classes) - set(given)), rules)
    return {
        lang: Reference(h, given[lang], words[lang]) if lang in given else Reference(h, *others[lang]) for lang, h in classes.items()
    }


def frequent_words(docs: DataFrame, langs: list[str], rules: Rules) -> dict[str, tuple[dict[str, int], np.ndarray]]:
    """The most frequent words of each of ``langs``, and their histogram with all other words last."""
    if not langs:
        return {}
    wanted = frozenset(langs)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: Counter[tuple[str, str | None]] = Counter()
            for lang, text in zip(batch["lang"], batch["text"]):
                facts = TextFacts(text) if lang in wanted else None
                if facts is None or base_fails(facts.base, rules):
                    continue
                for word, n in plain_words(facts):
                    found[lang, word] += n
                found[lang, None] += int(facts.counts.sum())
            yield pd.DataFrame([(*k, n) for k, n in found.items()], columns=["lang", "word", "n"])

    counts = docs.mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    top = counts.filter("word IS NOT NULL AND word <> ''").withColumn("rank", first).filter(F.col("rank") <= FREQUENT_WORDS)
    rows = top.unionByName(counts.filter("word IS NULL").withColumn("rank", F.lit(0))).collect()
    out = {}
    for lang in langs:
        listed = sorted((r.rank, r.word, r.n) for r in rows if r.lang == lang and r.rank)
        total = sum(r.n for r in rows if r.lang == lang and not r.rank)
        histogram = np.array([n for _, _, n in listed] + [total - sum(n for _, _, n in listed)], float)
        out[lang] = {w: i for i, (_, w, _) in enumerate(listed)}, histogram
    return out


def quality(text: Column, lang: Column, references: dict[str, Reference], rules: Rules = Rules()) -> Column:
    """Struct of the base counts, ``base_failed``, both distances (NULL where a guard or a missing
    reference leaves them out) and ``kept``."""
    def distances(facts: TextFacts, name: str) -> tuple[float | None, float | None]:
        classes = words = None
        if len(facts.raw) >= rules.min_chars:
            classes = js_distance(class_histogram(facts.raw), references[name].classes)
        if facts.base[0] >= rules.min_words:
            words = js_distance(common_word_histogram(facts, references[name].index), references[name].words)
        return classes, words

    def judge(text: str | None, lang: str | None) -> tuple:
        facts = TextFacts(text)
        if base_fails(facts.base, rules):
            return (*facts.base, True, None, None, False)
        classes, words = distances(facts, lang) if lang in references else (None, None)
        near = (classes or 0) <= class_bound(len(facts.raw), rules)
        kept = near and (words or 0) <= word_bound(facts.base[0], rules)
        return (*facts.base, False, classes, words, kept)

    @F.pandas_udf(
        ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, class_distance double, word_distance double, kept boolean"
    )
    def verdict(texts: pd.Series, langs: pd.Series) -> pd.DataFrame:
        rows = [judge(*x) for x in zip(texts, langs)]
        frame = pd.DataFrame(rows, columns=[*COUNTS, "base_failed", "class_distance", "word_distance", "kept"])
        return frame.astype({"class_distance": float, "word_distance": float})

    return verdict(text, lang)


def judge_documents(docs: DataFrame, rules: Rules = Rules(), out: str = "quality") -> DataFrame:
    """``docs(text, lang, ...)`` with the verdict struct in column ``out``."""
    short_batches(docs.sparkSession)
    references = language_references(docs, rules)
    return docs.withColumn(out, quality(F.col("text"), F.col("lang"), references, rules))
