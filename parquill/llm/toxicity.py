"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features: densities of a lexicon, second-person words near its words, capitals, punctuation and
obfuscation. The lexicon has fixed words and what the labelled sample teaches: words and word beginnings
that stand far more often in texts labelled toxic.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parquill.llm.arrow import Cache, raw, tidy
from parquill.llm.gbt import BoostedTrees, Isotonic

#: Insults that count without being learned, and words that address the reader.
INSULTS = ("idiot", "moron", "loser", "stupid", "scum", "trash", "worthless", "pathetic", "disgusting", "dumb", "imbécile", "crétin", "connard", "abruti", "dummkopf", "arschloch", "trottel", "vollidiot", "imbécil", "estúpido", "idiota", "pendejo")
SECOND_PERSON = ("you", "your", "yours", "u", "ur", "tu", "toi", "te", "ton", "ta", "tes", "vous", "votre", "vos", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tú", "ti", "usted", "ustedes", "vosotros")
#: Digits and signs that stand for letters.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
#: Labelled rows that a fit uses at most, which bounds what the lexicon learns.
SAMPLE_ROWS = 12_000
#: Every so many of them calibrate, and teach neither lexicon nor trees.
CALIBRATES = 5
#: Words around a lexicon word in which second person counts as near.
NEAR = 6
MIN_PREFIX, MAX_PREFIX = 4, 6
#: Steps of a lexicon weight of 1.
WEIGHT = 64
_STRIP = ".,;:!?\"'()[]{}<>«»“”„…-*_~"


def plain(word: str) -> tuple[str, bool]:
    """The word's letters, and whether it was obfuscated: signs or digits within, or letters drawn out."""
    core = word.strip(_STRIP).lower()
    if core.isalpha():
        short = core
    else:
        short = "".join(c for c in core.translate(LEET) if c.isalpha())
    mixed = not core.isalpha() and len(short) >= 3 and sum(c.isalpha() for c in core) * 5 >= 2 * len(core)
    drawn = any(short[i] == short[i + 1] == short[i + 2] for i in range(len(short) - 2))
    if drawn:
        short = "".join(c for i, c in enumerate(short) if i < 2 or not c == short[i - 1] == short[i - 2])
    return short, bool(short) and (mixed or drawn)


def parts(word: str) -> list[str]:
    """What the lexicon may have of a word: itself, and its beginnings with a mark."""
    return [word, *[f"{word[:n]}-" for n in range(MIN_PREFIX, min(MAX_PREFIX, len(word) - 1) + 1)]]


class Featurizer:
    NAMES = ("lexicon", "fixed", "learned_words", "learned_prefixes", "weight", "hits", "near", "second", "capital_words", "capitals", "exclaim", "question", "punctuation", "obfuscated", "obfuscated_hits", "digits", "words", "word_length")

    def __init__(self, learned: dict[str, float]) -> None:
        self.learned = learned
        fixed, second = {*INSULTS}, {*SECOND_PERSON}

        def judge(word: bytes) -> int:
            text = word.decode("utf-8", "replace")
            core, hidden = plain(text)
            weight = max((learned.get(p, 0.0) for p in parts(core)), default=0.0)
            code = (core in fixed) | 2 * (core in learned) | 4 * any(p in learned for p in parts(core)[1:]) | 8 * (core in second) | 16 * (len(core) > 1 and text.strip(_STRIP).isupper()) | 32 * hidden
            return code | int(weight * WEIGHT) << 6

        self.judge = Cache(judge)

    def __call__(self, text: bytes) -> list[float]:
        words = text.split()
        n = len(words)
        if not n:
            return [0.0] * len(self.NAMES)
        judged = np.fromiter(map(self.judge.__getitem__, words), np.int64, n)
        code = judged & 63
        hit = (code & 7) > 0
        hits = int(hit.sum())
        near, weight = 0, 0.0
        if hits:
            at = np.flatnonzero(hit)
            weight = float((judged[at] >> 6).sum()) / WEIGHT
            second = np.cumsum(np.concatenate([[0], (code & 8) > 0]))
            near = int((second[np.minimum(n, at + NEAR + 1)] > second[np.maximum(0, at - NEAR)]).sum())
        size = max(1, len(text))
        upper = size - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        digits = size - len(text.translate(None, b"0123456789"))
        signs = size - len(text.translate(None, b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"))
        share = lambda bit: float(((code & bit) > 0).sum()) / n
        return [hits / n, share(1), share(2), share(4), weight / n, float(np.log1p(hits)), near / max(1, hits), share(8), share(16), upper / size, text.count(b"!") / n, text.count(b"?") / n, signs / size, share(32), float((hit & ((code & 32) > 0)).sum()) / n, digits / size, float(np.log1p(n)), size / n]


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, most: int, where: str, id_col: str = "doc_id") -> DataFrame:
    """``docs`` rows of at most ``most`` labels (0 or 1) under the SQL condition, by a hash of the id, with ``label``; of several labels of one id the smallest."""
    few = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).filter(where).select(F.col(id_col).cast("long").alias("_label_id"), F.col(label_col).cast("int").alias("label"))
    few = few.groupBy("_label_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("_label_id"), "_label_id").limit(most)
    return docs.join(F.broadcast(few), docs[id_col].cast("long") == few["_label_id"])  # at most `most` rows of two numbers


def learn_lexicon(sample: DataFrame, text_col: str, least: int = 5, odds: float = 2.5) -> dict[str, float]:
    """Words and beginnings in ``least`` documents labelled 1 whose document odds are higher there by ``odds`` in logarithm."""
    kind = T.StructType([T.StructField("part", T.StringType()), T.StructField("label", T.IntegerType()), T.StructField("n", T.LongType())])

    def counter(wanted: set[str] | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """Documents by part and label, of all parts or of those wanted."""

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for batch in batches:
                for text, label in zip(raw(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                    cores = {plain(w.decode("utf-8", "replace"))[0] for w in {*text.split()}} - {""}
                    own = {p for c in cores for p in parts(c)}
                    seen[label].update(own if wanted is None else own & wanted)
            rows = [(p, label, n) for label, c in seen.items() for p, n in c.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64())], names=kind.names)

        return count

    texts = sample.select(text_col, "label")
    totals = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    # First the parts of texts labelled 1 that are frequent there, then how often texts labelled 0 have them.
    frequent = texts.filter("label = 1").mapInArrow(counter(None), kind).groupBy("part").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    wanted = {r["part"]: r["n"] for r in frequent.collect()}  # of a sample, and in `least` of its texts
    clean = texts.filter("label = 0").mapInArrow(counter(set(wanted)), kind).groupBy("part").agg(F.sum("n").alias("n"))
    other = {r["part"]: r["n"] for r in clean.collect()}  # of those wanted
    odds_of = {p: float(np.log((n + 0.5) / (bad + 1)) - np.log((other.get(p, 0) + 0.5) / (good + 1))) for p, n in wanted.items()}
    return {p: w for p, w in sorted(odds_of.items()) if w >= odds}


def toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Scores every whole text: ``doc_id``, ``held_out``, ``score`` (0 to 1) and ``predicted`` (score >= 0.5).

    Labels are learned from only where crc32 of the id as text is not divisible by 5, from at most
    ``sample_rows`` of them, taken by a hash of the id; ``held_out`` marks the other ids. A fifth of
    the sample, by another hash, calibrates, and neither lexicon nor trees learn from it. Only the text is
    an input of a score.

    Null or empty texts are scored like any text, with all features 0. Null labels and labels other than
    0 and 1 are not learned from; without labels every score is the same. Rows with a null id have null
    ``held_out``; repeated rows are scored each. An empty table gives an empty result.
    """
    where = f"crc32(cast(cast(`{id_col}` as string) as binary)) % 5 <> 0"
    sample = labelled_sample(docs.select(id_col, text_col), labels, label_col, sample_rows, where, id_col).select(F.col("_label_id").alias("id"), text_col, "label").persist()
    calibrates = F.pmod(F.xxhash64("id", F.lit(9)), F.lit(CALIBRATES)) == 0
    try:
        learned = learn_lexicon(sample.filter(~calibrates), text_col)
        made = T.StructType([T.StructField("id", T.LongType()), T.StructField("label", T.IntegerType()), T.StructField("fold", T.BooleanType()), T.StructField("features", T.ArrayType(T.DoubleType()))])

        def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            features = Featurizer(learned)
            for batch in batches:
                rows = [features(t) for t in raw(batch.column(1))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(rows, pa.list_(pa.float64()))], names=["id", "label", "fold", "features"])

        rows = sorted(sample.withColumn("fold", calibrates).mapInArrow(tidy(describe), made).collect())  # sample_rows rows of 18 numbers at most
    finally:
        sample.unpersist()
    x = np.array([r["features"] for r in rows]).reshape(len(rows), len(Featurizer.NAMES))
    y = np.array([r["label"] for r in rows], float)
    fold = np.array([r["fold"] for r in rows], bool)
    model = BoostedTrees().fit(x[~fold], y[~fold])
    calibrated = Isotonic().fit(model.margin(x[fold]), y[fold])
    out = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Featurizer(learned)
        for batch in batches:
            found = np.array([features(t) for t in raw(batch.column(1))]).reshape(len(batch), len(Featurizer.NAMES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(calibrated(model.margin(found)))], names=["doc_id", "score"])

    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(tidy(score), out)
    held = F.expr("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0")
    return scored.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))
