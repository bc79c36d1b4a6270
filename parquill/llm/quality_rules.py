"""Quality rules by distribution divergence.

A text's histograms of character classes and of common words are compared with its language's references
by the Jensen-Shannon distance. The references are the sums over all the corpus's documents of that
language; common words are the language's most frequent ones, all others are one class. Short texts have
noisy histograms, so each distance counts only from a minimum length on.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parquill.llm.arrow import BLANK, Cache, raw, tidy
from parquill.runtime import checkpoint

#: Character classes.
CLASSES = ("lower", "upper", "digit", "stop", "bracket", "symbol", "other")
#: Common words of a language, and languages with references of their own; rarer ones share one.
COMMON_WORDS, LANGUAGES = 50, 1_000
#: Distances (0 to 1) from which a long text fails, and the words from which distances count.
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE, GUARD_WORDS = 0.19, 0.35, 50
#: Squared class distance that one number, address or key may make up in a text, times its words.
ODD_WORDS = 2.2
#: Base rules: fewest words, and the share of words in repeated windows, in hundredths.
LEAST_WORDS, MOST_REPEATED = 50, 50
SYMBOLS = b"#*$%&|<>"
_EDGE = ".,;:!?\"'()[]{}"
#: A common word is more than one in so many; a part names words that are more than one in so many; words of a part.
COMMON_SHARE, NAMED_SHARE, PART_WORDS = 1_000, 10_000, 2_000_000


def class_of(c: str) -> int:
    """A character's place in ``CLASSES``."""
    if c.isalpha():
        return 1 if c.isupper() else 0
    if c.isdigit():
        return 2
    if c in ".,;:!?'\"-":
        return 3
    if c in "()[]{}/":
        return 4
    return 5 if unicodedata.category(c)[0] in "SP" else 6


#: Each ASCII byte's class by a one; blanks have none.
_ASCII = bytes(range(128))
_CLASS_OF_BYTE = np.array([[int(class_of(chr(c)) == k and c not in BLANK) for k in range(len(CLASSES))] for c in range(128)], np.int64)


def class_histogram(text: bytes) -> np.ndarray:
    """A text's characters by class, without ASCII blanks."""
    out = np.bincount(np.frombuffer(text, np.uint8), minlength=256)[:128] @ _CLASS_OF_BYTE
    if not text.isascii():
        for c, n in Counter(text.translate(None, _ASCII).decode("utf-8", "replace")).items():
            out[class_of(c)] += n
    return out


def core(word: bytes) -> str:
    return word.decode("utf-8", "replace").lower().strip(_EDGE)


def divergence(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms, 0 to 1; 0 if one is empty."""
    if not p.sum() or not q.sum():
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    part = lambda x: float((x[x > 0] * np.log2(x[x > 0] / m[x > 0])).sum())
    return float(np.sqrt(max(0.0, (part(p) + part(q)) / 2)))


def limits(n: int, class_distance: float, word_distance: float) -> tuple[float, float]:
    """Both limits for a text of n words: a long text's, widened by what chance adds.

    The divergence of n draws from their own distribution over k classes is (k - 1) / (8 n ln 2) on average.
    """
    n = max(1, n)
    return float(np.sqrt(class_distance**2 + ODD_WORDS / n)), float(np.sqrt(word_distance**2 + COMMON_WORDS / (8 * n * np.log(2))))


def base_counts(text: bytes) -> tuple[int, int, int, int, int, list[bytes]]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text, and its words."""
    words = text.split()
    n = len(words)
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else int(np.count_nonzero((np.frombuffer(joined, np.uint8) & 0xC0) != 0x80))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip(BLANK)]
    return n, chars, symbols, len(lines) - len({*lines}), repeated(words), words


def repeated(words: list[bytes]) -> int:
    """Words in 3-word windows found twice or more, the first included."""
    if len(words) < 4:
        return 0
    windows = [*zip(words, words[1:], words[2:], strict=False)]
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    twice = np.fromiter((counts[w] > 1 for w in windows), bool, len(windows))
    covered = np.zeros(len(words), bool)
    for i in range(3):
        covered[i : len(windows) + i] |= twice
    return int(covered.sum())


def references(texts: DataFrame, languages: int = LANGUAGES) -> dict[str, tuple[np.ndarray, dict[str, int], np.ndarray]]:
    """By language: class histogram, common words' places, and their histogram with the rest last.

    ``texts`` has ``lang`` and ``text``. '' is the reference of all languages together. Common words are
    those ``COMMON_WORDS`` most frequent ones that are more than one word in ``COMMON_SHARE``.

    Tasks first name words with their counts in a part, but for those of one in ``NAMED_SHARE`` or less of
    a language's words there. So a word's named counts miss one in ``NAMED_SHARE`` of the language's words
    at most, whatever the parts are: words that may be common by this bound are candidates, a thousand or
    so of a language at most, and all documents are counted for them. Languages beyond the ``languages``
    largest have no reference of their own, but count in that of all, so what tasks hold stays bounded.
    """
    named = T.StructType([T.StructField("lang", T.StringType()), T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        size = 0

        def out() -> pa.RecordBatch:
            rows = []
            for lang, words in held.items():
                total, by_core = words.total(), Counter()
                for w, n in words.items():
                    by_core[core(w)] += n
                rows.append((lang, None, total))
                rows += [(lang, w, n) for w, n in by_core.items() if w and n * NAMED_SHARE > total]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=named.names)

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), raw(batch.column(1)), strict=True):
                words = text.split()
                if words:
                    held.setdefault(lang, Counter()).update(words)
                    size += len(words)
            if size > PART_WORDS:
                yield out()
                size = 0
        yield out()

    found = checkpoint(texts.mapInArrow(tidy(name), named).groupBy("lang", "word").agg(F.sum("n").alias("n")))
    totals, words = found.filter("word is null").select("lang", F.col("n").alias("total")), found.filter("word is not null")
    largest = totals.filter("lang is not null").orderBy(F.desc("total"), "lang").limit(languages)
    all_words = {r["lang"]: r["total"] for r in largest.collect()}
    every = totals.agg(F.sum("total")).first()[0] or 0
    if not every:
        return {}
    # The least named count of a common word: one in COMMON_SHARE without one in NAMED_SHARE.
    least = NAMED_SHARE // COMMON_SHARE - 1
    by_lang = words.join(F.broadcast(largest), "lang").filter(F.col("n") * NAMED_SHARE > F.col("total") * least).select("lang", "word", "n")
    by_all = words.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") * NAMED_SHARE > every * least)
    asked = {lang: [] for lang in all_words}
    for r in by_lang.collect():  # NAMED_SHARE / least for each language at most
        asked[r["lang"]].append((r["n"], r["word"]))
    asked = {lang: _may_lead(x, all_words[lang]) for lang, x in asked.items()}
    asked_all = _may_lead([(r["n"], r["word"]) for r in by_all.collect()], every)
    union = {w: i for i, w in enumerate(sorted({*asked_all, *(w for x in asked.values() for w in x)}))}
    width = len(union)
    counted = T.StructType([T.StructField("lang", T.StringType()), T.StructField("at", T.LongType()), T.StructField("n", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = Cache(lambda w: union.get(core(w), -1))
        held: dict[str | None, Counter] = {}
        classes: dict[str | None, np.ndarray] = {}
        wanted_all = {union[w] for w in asked_all}
        for batch in batches:
            seen: dict[str | None, list[np.ndarray]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), raw(batch.column(1)), strict=True):
                words = text.split()
                if words:
                    lang = lang if lang in all_words else None
                    seen.setdefault(lang, []).append(np.fromiter(map(place.__getitem__, words), np.int64, len(words)))
                    classes[lang] = classes.get(lang, 0) + class_histogram(text)
            for lang, places in seen.items():
                own = wanted_all | {union[w] for w in asked.get(lang, ())}
                held.setdefault(lang, Counter()).update({i: n for i, n in zip(*map(np.ndarray.tolist, np.unique(np.concatenate(places), return_counts=True)), strict=True) if i in own})
        rows = [(lang, i, n) for lang, c in held.items() for i, n in c.items()] + [(lang, width + i, int(n)) for lang, c in classes.items() for i, n in enumerate(c)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=counted.names)

    sums: dict[str | None, Counter] = {}
    for r in texts.mapInArrow(tidy(count), counted).groupBy("lang", "at").agg(F.sum("n").alias("n")).collect():  # candidates of each language and of all
        sums.setdefault(r["lang"], Counter())[r["at"]] = r["n"]

    def reference(n: Counter, words: list[str], total: int) -> tuple[np.ndarray, dict[str, int], np.ndarray]:
        best = sorted((-n[union[w]], w) for w in words if n[union[w]] * COMMON_SHARE > total)[:COMMON_WORDS]
        common = [-k for k, _ in best]
        return np.array([n[width + i] for i in range(len(CLASSES))], float), {w: i for i, (_, w) in enumerate(best)}, np.array([*common, total - sum(common)], float)

    out = {lang: reference(sums[lang], asked[lang], total) for lang, total in all_words.items()}
    out[""] = reference(sum(sums.values(), Counter()), asked_all, every)
    return out


def _may_lead(named: list[tuple[int, str]], total: int) -> list[str]:
    """Words that may be among the ``COMMON_WORDS`` most frequent, by named counts that may miss one in ``NAMED_SHARE``."""
    order = sorted((n for n, _ in named), reverse=True)
    least = order[COMMON_WORDS - 1] if len(order) >= COMMON_WORDS else 0
    return [w for n, w in named if n * NAMED_SHARE + total >= least * NAMED_SHARE]


def quality_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_class_distance: float = MAX_CLASS_DISTANCE, max_word_distance: float = MAX_WORD_DISTANCE, languages: int = LANGUAGES) -> DataFrame:
    """Judges every whole text: base counts, base verdict, both distances, and ``kept``.

    ``base_failed``: fewer than ``LEAST_WORDS`` words or over half of them in repeated windows. ``kept``
    is false if so, or if the text has ``GUARD_WORDS`` words and a distance exceeds ``limits`` for its length.
    Texts of a language beyond the ``languages`` largest are compared with the reference of all languages;
    those of null language are a language of their own.

    Null and empty texts have no words, so they fail the base rules. Rows that repeat count and are
    judged each; null ids stay. An empty table gives an empty result.
    """
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("?")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    known = references(texts, languages)
    longs = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    out = T.StructType([T.StructField("doc_id", T.LongType()), *[T.StructField(c, T.LongType()) for c in longs], T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("class_distance", T.DoubleType()), T.StructField("word_distance", T.DoubleType())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A word's place among all languages' common words, and that place's in each language.
        union = {w: i for i, w in enumerate(sorted({w for _, words, _ in known.values() for w in words}))}
        of_lang = {lang: np.array([words.get(w, len(words)) for w in union] + [len(words)]) for lang, (_, words, _) in known.items()}
        place = Cache(lambda w: union.get(core(w), len(union)))
        for batch in batches:
            rows = []
            for lang, text in zip(batch.column(1).to_pylist(), raw(batch.column(2)), strict=True):
                *counts, words = base_counts(text)
                n, again = counts[0], counts[4]
                failed = n < LEAST_WORDS or 100 * again > MOST_REPEATED * n
                class_distance = word_distance = 0.0
                if words and known:
                    lang = lang if lang in known else ""
                    reference, _, common = known[lang]
                    class_distance = divergence(class_histogram(text), reference)
                    at = of_lang[lang][np.fromiter(map(place.__getitem__, words), np.int64, n)]
                    word_distance = divergence(np.bincount(at, minlength=len(common)).astype(float), common)
                most_class, most_word = limits(n, max_class_distance, max_word_distance)
                bad = n >= GUARD_WORDS and (class_distance > most_class or word_distance > most_word)
                rows.append((*counts, failed, not failed and not bad, class_distance, word_distance))
            columns = [batch.column(0), *[pa.array([r[i] for r in rows], f.dataType.simpleString().replace("bigint", "int64").replace("boolean", "bool").replace("double", "float64")) for i, f in enumerate(out.fields[1:])]]
            yield pa.RecordBatch.from_arrays(columns, names=out.names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("?")).alias("lang"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(judge), out)
