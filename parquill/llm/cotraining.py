"""Quality classifier by co-training.

Two classifiers see different things: one the text's content, the other the page's metadata (source,
language, lengths, line layout). In each round either labels the unlabelled rows that it is surest of,
and those join the other's training rows. At the end both are calibrated on labelled rows that neither
was trained on, and a logistic regression over their calibrated log-odds gives the final score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parquill.llm.arrow import raw, tidy
from parquill.llm.gbt import BoostedTrees, Isotonic, logistic
from parquill.llm.toxicity import labelled_sample

#: Labelled and unlabelled rows that a fit uses at most.
LABELLED, UNLABELLED = 10_000, 6_000
#: Rounds, the share of the unlabelled rows that a view may label in each, and how sure it must be.
ROUNDS, SHARE, SURE = 3, 0.1, 0.95
_UPPER, _LOWER, _DIGIT = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789"
_STOP, _SIGN = b".,;:'\"-", b"#*$%&|<>@^~`+=_\\{}[]/"
HASHED = 12
CONTENT, META = 20, 8 + 2 * HASHED


def content(text: bytes) -> list[float]:
    """Features of the text as it is written."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * CONTENT
    size = sum(map(len, words))
    left = lambda signs: (len(text) - len(text.translate(None, signs))) / size
    lengths = np.fromiter(map(len, words), np.int64, n)
    kinds = {*words}
    windows = {*zip(words, words[1:], words[2:], strict=False)}
    upper, lower = left(_UPPER), left(_LOWER)
    return [
        upper,
        lower,
        left(_DIGIT),
        left(_STOP),
        left(_SIGN),
        left(b"!"),
        left(b"?"),
        left(b"|"),
        1 - min(1.0, upper + lower + left(_DIGIT) + left(_STOP) + left(_SIGN)),
        size / n,
        float(lengths.std()),
        float((lengths <= 3).mean()),
        float((lengths >= 15).mean()),
        len(kinds) / n,
        len(windows) / max(1, n - 2),
        sum(map(bytes.__eq__, words, words[1:])) / n,
        sum(map(bytes.isupper, words)) / n,
        sum(w[-1:] in b".!?" for w in words) / n,
        float(np.log1p(n)),
        upper / max(1e-9, upper + lower),
    ]


def metadata(text: bytes, source: str | None, lang: str | None) -> list[float]:
    """Features of the page around the words: where it is from, how long it is, how it is laid out."""
    lines = text.split(b"\n")
    lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    hashed = np.zeros(2 * HASHED)
    hashed[zlib.crc32((source or "").encode()) % HASHED] = 1
    hashed[HASHED + zlib.crc32((lang or "").encode()) % HASHED] = 1
    kinds = len({*lines})
    return [float(np.log1p(len(text))), float(np.log1p(len(lines))), float(np.log1p(lengths.mean())), float(np.log1p(lengths.max())), float((lengths == 0).mean()), kinds / len(lines), float(source is None), float(lang is None), *hashed]


class CoTraining:
    """Two views of the same rows: ``x[0]`` and ``x[1]``."""

    def __init__(self, rounds: int = ROUNDS, share: float = SHARE, sure: float = SURE) -> None:
        self.rounds, self.share, self.sure = rounds, share, sure

    def fit(self, x: tuple[np.ndarray, np.ndarray], y: np.ndarray, fresh: tuple[np.ndarray, np.ndarray]) -> CoTraining:
        """x, y: labelled rows; fresh: unlabelled ones. A quarter of the labelled rows calibrates."""
        fold = np.arange(len(y)) % 4 == 0
        train = [[v[~fold], y[~fold]] for v in x]
        n = len(fresh[0])
        free = [np.ones(n, bool), np.ones(n, bool)]  # what each view has not been given
        prior = (y[~fold].sum() + 1) / (len(y[~fold]) + 2)
        self.given = [0, 0]
        for k in range(self.rounds + 1):
            self.models = [BoostedTrees(trees=40).fit(*t) for t in train]
            if k == self.rounds or not n:
                break
            margins = [m.margin(f) for m, f in zip(self.models, fresh, strict=True)]
            for view in (0, 1):
                other = 1 - view
                p = 1 / (1 + np.exp(-margins[view]))
                for label, sure, part in ((1.0, p, prior), (0.0, 1 - p, 1 - prior)):  # in the classes' proportions
                    most = int(self.share * n * part)
                    best = np.argsort(-np.where(free[other], sure, -1), kind="stable")[:most]
                    best = best[(sure[best] >= self.sure) & free[other][best]]
                    free[other][best] = False
                    train[other] = [np.concatenate([train[other][0], fresh[other][best]]), np.concatenate([train[other][1], np.full(len(best), label)])]
                    self.given[other] += len(best)
        self.calibrated = [Isotonic().fit(m.margin(v[fold]), y[fold]) for m, v in zip(self.models, x, strict=True)]
        self.weights = logistic(self._odds((x[0][fold], x[1][fold])), y[fold]) if len(np.unique(y[fold])) == 2 else np.array([1.0, 0.0, 0.0])
        return self

    def _odds(self, x: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        p = np.stack([c(m.margin(v)) for c, m, v in zip(self.calibrated, self.models, x, strict=True)], 1)
        p = np.clip(p, 1e-4, 1 - 1e-4)
        return np.log(p / (1 - p))

    def score(self, x: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Probability of class 1, and both views' calibrated ones."""
        odds = self._odds(x)
        return 1 / (1 + np.exp(-(odds @ self.weights[:2] + self.weights[2]))), 1 / (1 + np.exp(-odds))


def _views(texts: Iterable[bytes], sources: list, langs: list) -> tuple[np.ndarray, np.ndarray]:
    both = [(content(text), metadata(text, source, lang)) for text, source, lang in zip(texts, sources, langs, strict=True)]
    return tuple(np.array([b[i] for b in both]).reshape(len(both), n) for i, n in enumerate((CONTENT, META)))


def quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", label_col: str = "quality", labelled: int = LABELLED, unlabelled: int = UNLABELLED, threshold: float = 0.5) -> DataFrame:
    """Scores every whole text: ``doc_id``, ``score`` (1: good), both views' scores and ``kept``.

    Fitted on at most ``labelled`` labelled and ``unlabelled`` unlabelled rows, both taken by a hash of
    the id. ``kept`` is score >= ``threshold``.

    Null or empty texts, sources and languages are scored like any others. Null labels and labels other
    than 0 and 1 are not learned from; without labels of both classes every score is the same. Repeated
    rows are scored each; null ids stay. An empty table gives an empty result.
    """
    score_of = fit_quality(docs, labels, id_col, text_col, source_col, lang_col, label_col, labelled, unlabelled)
    out = T.StructType([T.StructField("doc_id", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in ("score", "content_score", "metadata_score")]])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, each = score_of.score(_views(raw(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array(each[:, 0].copy()), pa.array(each[:, 1].copy())], names=out.names)

    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), *[F.col(c).cast("string") for c in (text_col, source_col, lang_col)]).mapInArrow(tidy(score), out)
    return scored.withColumn("kept", F.col("score") >= threshold)


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str, label_col: str, labelled: int, unlabelled: int) -> CoTraining:
    used = docs.select(id_col, text_col, source_col, lang_col)
    with_labels = labelled_sample(used, labels, label_col, labelled, "true", id_col).select(F.col("_label_id").alias("id"), text_col, source_col, lang_col, "label")
    without = docs.select(F.col(id_col).cast("long").alias("id")).filter("id is not null").join(labels.select(F.col(id_col).cast("long").alias("id")).distinct(), "id", "left_anti").distinct().orderBy(F.xxhash64("id"), "id").limit(unlabelled).withColumnRenamed("id", "_free_id")
    fresh = used.join(F.broadcast(without), used[id_col].cast("long") == without["_free_id"]).select(F.col("_free_id").alias("id"), text_col, source_col, lang_col, F.lit(-1).alias("label"))
    kind = T.StructType([T.StructField("id", T.LongType()), T.StructField("label", T.IntegerType()), *[T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("a", "b")]])

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = _views(raw(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(4), pa.array(a.tolist(), pa.list_(pa.float64())), pa.array(b.tolist(), pa.list_(pa.float64()))], names=kind.names)

    rows = sorted(with_labels.union(fresh).mapInArrow(tidy(describe), kind).collect())  # labelled + unlabelled rows of 52 numbers at most
    known, free = [r for r in rows if r["label"] >= 0], [r for r in rows if r["label"] < 0]
    views = lambda some: tuple(np.array([r[v] for r in some]).reshape(len(some), w) for v, w in (("a", CONTENT), ("b", META)))
    return CoTraining().fit(views(known), np.array([r["label"] for r in known], float), views(free))


def keep_good(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5, **columns: str) -> DataFrame:
    """``docs`` without the rows that the classifier rejects; all columns stay, each row is judged by itself."""
    names = {"id_col": "doc_id", "text_col": "text", "source_col": "source", "lang_col": "lang", "label_col": "quality"} | columns
    model = fit_quality(docs, labels, *[names[k] for k in ("id_col", "text_col", "source_col", "lang_col", "label_col")], LABELLED, UNLABELLED)
    at = [docs.columns.index(names[k]) for k in ("text_col", "source_col", "lang_col")]

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, source, lang = (batch.column(i) for i in at)
            p, _ = model.score(_views(raw(text), source.cast(pa.string()).to_pylist(), lang.cast(pa.string()).to_pylist()))
            yield batch.filter(pa.array(p >= threshold))

    return docs.mapInArrow(tidy(keep), docs.schema)
