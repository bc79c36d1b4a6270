"""Secret scans: base patterns, and a linear-chain conditional random field that adds spans.

The field tags words as begin, inside or outside of a secret, from the word and its shape, the neighbouring
words themselves and their shapes, and features of the whole text, and is decoded by Viterbi. It is trained on a bounded sample
whose silver labels are the base patterns' matches, with the naming word hidden in half of the cases so
that shape and context alone must do; what is not plain but matches no pattern is shown as well. Base
matches hold no blank, so inside is learned from bodies of private keys and from windows in which a
matched value goes on over several words of its signs, as wrapped secrets do.
"""

from __future__ import annotations

import functools
import math
import random
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parquill.llm.arrow import Cache, mix, raw, tidy
from parquill.runtime import checkpoint

#: The base patterns, with the group whose length counts and its least.
PATTERNS = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 32),
}
KINDS = (*PATTERNS, "crf")
_NAMES = re.compile(r"pass(?:word|wd)|secret|token|api_?key", re.I | re.A)
#: Bodies of private keys, which silver labels have besides the base patterns: secrets over several words.
_BODY = re.compile(r"-----BEGIN (?:[A-Z0-9]+\x20)*PRIVATE KEY(?: BLOCK)?-----[\x20\x09-\x0D]+([A-Za-z0-9+/=\x20\x09-\x0D]*[A-Za-z0-9+/=])[\x20\x09-\x0D]+-----END[A-Z0-9\x20]*-----")
#: Least signs of a value that is also shown as the first of several lines.
WRAP_SIGNS = 16
_LEAD = re.compile(rf"^.*(?:{_NAMES.pattern})[\"']?[:=]?[\"']?", re.I | re.A)
#: What is not plain behind such a word may be a secret that no pattern has.
NAMING = frozenset("password passwd pwd pass secret token key apikey api_key auth credential credentials login bearer access private id user".split())
#: Texts whose windows train the field at most, words of a window, and hashed features.
SAMPLE_ROWS, WINDOW, FEATURES = 12_000, 24, 1 << 18
#: Windows of a text around secrets, and around other words, at most.
SECRET_WINDOWS, OTHER_WINDOWS = 2, 2
#: Places of one word's features: of its own, of the text, of the word before and of the one after.
OWN, FILE, BEFORE, AFTER = slice(0, 10), slice(10, 12), slice(12, 15), slice(15, 18)
MOST_FEATURES = 18
O, B, I = 0, 1, 2  # noqa: E741
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Words and forms of words whose scores a task holds before it starts anew.
MOST_WORDS, MOST_FORMS = 300_000, 50_000
_EDGE = "\"'`,;:()[]{}<>.!?"


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base patterns' matches, in code points."""
    out = []
    for kind, (pattern, group, least) in PATTERNS.items():
        out += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if len(m[group]) >= least]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[1])))


def shape(word: str) -> str:
    """Upper, lower, digit and other signs, runs as one."""
    kinds = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c if c in "=:_-./+\"'" else "#" for c in word[:64])
    return re.sub(r"(.)\1+", r"\1", kinds)[:12]


def _signs(word: str) -> str:
    return f"q{'=' in word}{':' in word}"


def _name(word: str) -> str:
    """The word itself as a feature, whatever its language."""
    return f"w{word.strip(_EDGE).lower()}"


def _form(word: str) -> list[str]:
    """Features of a word's form. Words of one form share what these score."""
    core = word.strip(_EDGE)
    n = len(core)
    counts = Counter(core)
    entropy = -sum(k / n * math.log2(k / n) for k in counts.values()) if n else 0.0
    digits, upper, lower = (sum(map(f, core)) for f in (str.isdigit, str.isupper, str.islower))
    mixed = f"{upper > 0:d}{lower > 0:d}{digits > 0:d}"
    switches = sum(a.isdigit() != b.isdigit() for a, b in zip(core, core[1:], strict=False)) if digits else 0
    return [f"n{min(n, 48) // 4}", f"e{int(entropy * 2)}", f"d{digits * 8 // n if n else 0}", f"m{mixed}", f"x{min(switches, 24) // 3}", f"s{shape(word)}", f"=n{n >= 8}{n >= 16}{n >= 32}{mixed}", f"@{'@' in core}{core.count('.')}", _signs(word)]


def _own(word: str) -> list[str]:
    """Features of a word by itself. Words with other signs than letters have none of their own name: a code is seen once, and its name would only learn its label by heart."""
    return [*_form(word), *([_name(word)] if word.strip(_EDGE).isalpha() else [])]


def _near(word: str) -> list[str]:
    """Features of a word for its neighbours."""
    return [_name(word), f"h{shape(word)}", _signs(word)]


def _hash(names: Sequence[str], place: str) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(f"{place}{x}") % FEATURES for x in names], np.int64)


def file_feature(n_words: int, codes: int) -> list[str]:
    """Features of the text: its length, and its share of words with digits or signs inside."""
    return [f"f{min(12, int(math.log2(n_words + 1)))}", f"g{min(8, 16 * codes // max(1, n_words))}"]


class Sample:
    """Windows to train on. Words share few rows of features of a kind, so sums are taken over distinct rows."""

    def __init__(self, features: np.ndarray, tags: np.ndarray, size: int = FEATURES) -> None:
        n, words, k = features.shape
        self.shape, self.real, self.size = (n, words), tags >= 0, size
        at = np.where(features < 0, size, features).reshape(n * words, k)
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        for part in (OWN, FILE, BEFORE, AFTER):
            rows = np.ascontiguousarray(at[:, part])
            if rows.shape[1]:
                key = mix((rows.astype(np.uint64) * mix(np.arange(1, rows.shape[1] + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))).sum(1))
                _, first, which = np.unique(key, return_index=True, return_inverse=True)
                self.parts.append((rows[first], which))
        self.gold = np.eye(3)[np.where(self.real, tags, 0)] * self.real[..., None]
        both = self.real[:, 1:, None]
        self.gold_moves = np.einsum("ntx,nty->xy", self.gold[:, :-1], self.gold[:, 1:] * both)

    def gradient(self, w: np.ndarray, a: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """The mean log-likelihood of the tags, and its gradients by weights and moves. Probabilities are scaled word by word."""
        n, words = self.shape
        score = sum(w[rows].sum(1)[which] for rows, which in self.parts).reshape(n, words, 3)
        top = score.max(2, keepdims=True)
        emit = np.exp(score - top)
        move = np.exp(a)
        move[O, I] = 0
        ahead, back = np.zeros((n, words, 3)), np.ones((n, words, 3))
        ahead[:, 0] = emit[:, 0] * [1, 1, 0]
        scale = np.ones((n, words, 1))
        scale[:, 0] = ahead[:, 0].sum(1, keepdims=True)
        ahead[:, 0] /= scale[:, 0]
        for t in range(1, words):
            step = (ahead[:, t - 1] @ move) * emit[:, t]
            scale[:, t] = np.where(self.real[:, t, None], step.sum(1, keepdims=True), 1)
            ahead[:, t] = np.where(self.real[:, t, None], step / scale[:, t], ahead[:, t - 1])
        for t in range(words - 2, -1, -1):
            step = (emit[:, t + 1] * back[:, t + 1]) @ move.T / scale[:, t + 1]
            back[:, t] = np.where(self.real[:, t + 1, None], step, back[:, t + 1])
        real = self.real[..., None]
        node = ahead * back * real
        node /= np.where(real, node.sum(2, keepdims=True), 1)
        after = np.where(real[:, 1:], emit[:, 1:] * back[:, 1:] / scale[:, 1:], 0)
        edge = np.einsum("ntx,nty->xy", ahead[:, :-1], after) * move
        diff = (self.gold - node).reshape(-1, 3)
        grad = np.zeros((self.size + 1, 3))
        for rows, which in self.parts:
            for c in range(3):
                summed = np.bincount(which, diff[:, c], len(rows))
                grad[:, c] += np.bincount(rows.reshape(-1), np.repeat(summed, rows.shape[1]), self.size + 1)
        grad[self.size] = 0
        given = ((score - top) * self.gold).sum() + (self.gold_moves * a).sum() - np.log(scale[self.real]).sum()
        return float(given) / n, grad / n, (self.gold_moves - edge) / n


class Field:
    """A linear-chain conditional random field over three tags; inside may follow only begin and inside."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray) -> None:
        self.weights, self.moves = weights, moves  # FEATURES x 3, 3 x 3

    @classmethod
    def fit(cls, features: np.ndarray, tags: np.ndarray, rounds: int = 80, rate: float = 0.3, penalty: float = 1e-4) -> Field:
        """features: windows x words x features of a word (-1: none); tags: windows x words (-1: no word).

        Maximises the conditional likelihood by adaptive gradient steps.
        """
        used, at = np.unique(features, return_inverse=True)  # only features that occur are learned
        sample = Sample(at.reshape(features.shape) + (-1 if len(used) and used[0] < 0 else 0), tags, len(used))
        w, a = np.zeros((sample.size + 1, 3)), np.zeros((3, 3))
        seen_w, seen_a = np.full_like(w, 1e-6), np.full_like(a, 1e-6)
        for _ in range(rounds if len(features) else 0):
            _, grad, grad_a = sample.gradient(w, a)
            grad -= penalty * w
            grad_a -= penalty * a
            seen_w += grad**2
            seen_a += grad_a**2
            w += rate * grad / np.sqrt(seen_w)
            a += rate * grad_a / np.sqrt(seen_a)
        out = np.zeros((FEATURES, 3))
        out[used[used >= 0]] = w[: int((used >= 0).sum())]
        return cls(out, a)

    def tags(self, score: np.ndarray) -> np.ndarray:
        """The best tags by Viterbi of words x 3 scores.

        Where outside leads by more than moves and the next word's change from inside to begin can make
        up, it stands on the best path whatever the neighbours are, so only the stretches between such
        words are decoded. (A path with another tag there gains by outside: two moves change, or three
        if the next word is inside, which then becomes begin as it may not follow outside.)
        """
        out = np.zeros(len(score), np.int64)
        lead = score[:, O] - score[:, 1:].max(1)
        lead[:-1] -= np.maximum(0, score[1:, I] - score[1:, B])
        spread = 3 * float(self.moves.max() - self.moves.min())
        doubt = np.flatnonzero(lead <= spread)
        if not len(doubt):
            return out
        cuts = np.flatnonzero(np.diff(doubt) > 1) + 1
        for stretch in np.split(doubt, cuts):
            first, last = stretch[0], stretch[-1]
            out[first : last + 1] = self._viterbi(score[first : last + 1], first > 0, last + 1 < len(score))
        return out

    def _viterbi(self, score: np.ndarray, before: bool, after: bool) -> np.ndarray:
        move = self.moves.copy()
        move[O, I] = -1e9
        best = score[0] + (move[O] if before else np.array([0, 0, -1e9]))
        came = np.zeros((len(score), 3), np.int64)
        for t in range(1, len(score)):
            to = best[:, None] + move
            came[t] = to.argmax(0)
            best = to.max(0) + score[t]
        if after:
            best = best + move[:, O]
        tag = int(best.argmax())
        out = np.zeros(len(score), np.int64)
        for t in range(len(score) - 1, -1, -1):
            out[t] = tag
            tag = int(came[t, tag])
        return out


class _Classes(dict):
    """A sign's class by its code point, for str.translate: signs that features tell apart stay."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        kind = c.isupper() << 3 | c.islower() << 2 | c.isalpha() << 1 | c.isdigit()
        # Private code points stand for the classes, so none meets a sign that stays.
        self[code] = c if c in _EDGE + "=:_-./+\"'@" else chr(0xE000 + kind)
        return self[code]


class Scanner:
    """Finds the base spans and those that the field adds."""

    def __init__(self, field: Field) -> None:
        self.field = field
        w = field.weights
        self.files = Cache(lambda key: w[_hash(file_feature(*key), "f")].sum(0), 1_000)
        self.classes = _Classes()
        self.names = np.concatenate([w, np.zeros((1, 3))])
        self._start()

    def _start(self) -> None:
        self.table = np.zeros((1024, 9))  # scores of words: own, for the next word, for the one before
        self.used = 0
        self.fresh: list[int] = []  # of words without a row yet: the form's row, places of the names' weights
        self.forms: dict[tuple, int] = {}
        self.form_table = np.zeros((1024, 9))
        self.words = Cache(self._word, 1 << 62)

    def _word(self, word: bytes) -> int:
        """The word's row, and two flags: a base pattern may start in it; its core is no plain word."""
        text = word.decode("utf-8", "replace")
        core = text.strip(_EDGE)
        # These tell all features of the form: the signs' classes, and how often the core has each of its signs.
        form = (text.translate(self.classes), tuple(sorted(map(core.count, set(core)))) if len(core) <= 48 else text)
        at = self.forms.get(form)
        if at is None:
            at = self.forms[form] = len(self.forms)
            if at == len(self.form_table):
                self.form_table = np.concatenate([self.form_table, np.zeros_like(self.form_table)])
            own, near, w = _form(text), _near(text)[1:], self.field.weights
            self.form_table[at] = np.concatenate([w[_hash(own, "o")].sum(0), w[_hash(near, "p")].sum(0), w[_hash(near, "n")].sum(0)])
        plain, name, digest = core.isalpha(), _name(text), xxhash.xxh3_64_intdigest
        self.fresh += at, digest("o" + name) % FEATURES if plain else FEATURES, digest("p" + name) % FEATURES, digest("n" + name) % FEATURES
        base = bool(_NAMES.search(text)) or "AKIA" in text or len(word) >= 32
        self.used += 1
        return (self.used - 1) << 2 | base << 1 | (not plain)

    def _fill(self) -> None:
        """Rows of the fresh words."""
        if not self.fresh:
            return
        new = np.array(self.fresh, np.int64).reshape(-1, 4)
        self.fresh.clear()
        while self.used > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[self.used - len(new) : self.used] = self.form_table[new[:, 0]] + self.names[new[:, 1:]].reshape(-1, 9)

    def spans(self, data: bytes) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
        """Base spans, and all of them with the field's that touch none, by start."""
        words = data.split()
        if not words:
            return [], []
        n = len(words)
        if self.used >= MOST_WORDS or len(self.forms) >= MOST_FORMS:
            self._start()
        known = np.fromiter(map(self.words.__getitem__, words), np.int64, n)
        self._fill()
        rows = self.table[known >> 2]
        score = rows[:, :3] + self.files[n, int((known & 1).sum())]
        score[1:] += rows[:-1, 3:6]
        score[:-1] += rows[1:, 6:]
        tags = self.field.tags(score)
        may = bool((known & 2).any())
        if not may and not tags.any():
            return [], []
        text = data.decode("utf-8", "replace")
        base = base_spans(text) if may else []
        more = [(a, "crf", b) for a, b in self._tagged(text, tags) if not any(a < e and s < b for s, _, e in base)] if tags.any() else []
        return base, sorted(base + more, key=lambda s: (s[0], KINDS.index(s[1])))

    @staticmethod
    def _tagged(text: str, tags: np.ndarray) -> list[tuple[int, int]]:
        """Spans of tagged words, without signs at their ends."""
        out: list[tuple[int, int]] = []
        for tag, m in zip(tags, _WORD.finditer(text), strict=True):
            if tag == O:
                continue
            start, end = m.start() + len(m[0]) - len(m[0].lstrip(_EDGE)), m.end() - (len(m[0]) - len(m[0].rstrip(_EDGE)))
            if start >= end:
                continue
            if tag == I and out:
                out[-1] = (out[-1][0], end)
            else:
                out.append((start, end))
        return out


def _lines(value: str, draw: int) -> list[str]:
    """One to three more lines of a value's signs, the last one shorter."""
    order = random.Random(draw)
    lines = ["".join(order.sample(value, len(value))) for _ in range(order.randrange(1, 4))]
    lines[-1] = lines[-1][: order.randrange(len(value) // 2, len(value) + 1)]
    return lines


def windows(data: bytes, number: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Training windows of a text, (features, tags) by word.

    Around base matches and private keys' bodies, ``SECRET_WINDOWS`` at most; one with a matched value over
    several words; around other words that are not plain, ``OTHER_WINDOWS`` at most; for one text in four
    anywhere. Which ones is drawn from the text's hash.
    """
    text = data.decode("utf-8", "replace")
    found = [(m.start(), m.end(), m[0]) for m in _WORD.finditer(text)]
    if not found:
        return []
    tags = np.zeros(len(found), np.int64)
    starts = np.array([a for a, _, _ in found])
    middles, values, known = [], [], set()
    place = lambda at: int(np.searchsorted(starts, at, "right") - 1)
    for m in _BODY.finditer(text):
        first, last = place(m.start(1)), place(m.end(1) - 1)
        tags[first], tags[first + 1 : last + 1] = B, I
        known.update(range(place(m.start()), place(m.end() - 1) + 1))
        middles.append(first)
    for start, kind, end in base_spans(text):
        if kind == "assign":  # the value, not its name
            m = PATTERNS["assign"][0].match(text, start)
            start = m.start(2)
        first = place(start)
        tags[first] = tags[first] or B
        middles.append(first)
        if kind != "access" and end - start >= WRAP_SIGNS and tags[first] == B:
            values.append((first, text[start:end]))
    odd = [i for i, (_, _, w) in enumerate(found) if not w.strip(_EDGE).isalpha()]
    codes, draw = len(odd), xxhash.xxh3_64_intdigest(data, number & 0xFFFFFFFF)
    # What is not plain and follows a naming word may be a secret that no pattern has: windows with it teach nothing.
    doubt = [i for i in odd if tags[i] == O and i not in known and any(w.strip(_EDGE).lower() in NAMING for _, _, w in found[max(0, i - 2) : i])]
    others = [i for i in odd if tags[i] == O and i not in doubt]
    order = random.Random(draw)
    middles = order.sample(middles, min(SECRET_WINDOWS, len(middles))) + order.sample(others, min(OTHER_WINDOWS, len(others))) + [draw % len(found)] * (draw >> 60 < 4)
    whole = _hash(file_feature(len(found), codes), "f")
    out = []
    for k, (middle, value) in enumerate([*((m, "") for m in middles), *([values[draw % len(values)]] if values else [])]):
        a = max(0, middle - WINDOW // 2)
        if any(a <= i < a + WINDOW for i in doubt):
            continue
        some, own_tags = [w for _, _, w in found[a : a + WINDOW]], tags[a : a + WINDOW].copy()
        hide = (number + k) % 2 == 0
        some = [(_LEAD.sub("", w) or "x") if hide else w for w in some]
        if value:
            lines = _lines(value, draw)
            word, at = found[middle][2], middle - a
            some[at : at + 1] = [value if hide else word[: word.index(value) + len(value)], *lines]
            own_tags = np.concatenate([own_tags[: at + 1], [I] * len(lines), own_tags[at + 1 :]])[:WINDOW]
            some = some[:WINDOW]
        rows = np.full((len(some), MOST_FEATURES), -1, np.int64)
        for i, w in enumerate(some):
            own = _hash(_own(w), "o")
            rows[i, : len(own)], rows[i, FILE] = own, whole
            if i:
                rows[i, BEFORE] = _hash(_near(some[i - 1]), "p")
            if i + 1 < len(some):
                rows[i, AFTER] = _hash(_near(some[i + 1]), "n")
        out.append((rows, own_tags))
    return out


#: What a text with a base match or a private key has somewhere, for Spark's reader of patterns.
_MAY = r"(?i:pass(?:word|wd)|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{8}|AKIA[A-Z0-9]{12}|[0-9a-f]{32}|PRIVATE KEY"


def fit_field(docs: DataFrame, id_col: str, text_col: str, rows: int) -> Field:
    """Trains on at most ``rows`` texts: half of them, or all that there are, with a match, the others without, each taken by a hash of the id."""
    text = F.col(text_col).cast("string")
    # All but hexadecimal matches have one of these, so the long pattern is tried on few texts.
    likely = functools.reduce(Column.__or__, [F.contains(text, F.lit(x)) for x in ("=", ":", "AKIA", "PRIVATE KEY")])
    has = F.when(likely, F.rlike(text, F.lit(_MAY))).otherwise(F.rlike(text, F.lit("[0-9a-f]{32}")))
    marked = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(has, F.lit(False)).alias("has")).filter("id is not null")
    ids = checkpoint(marked.groupBy("id").agg(F.max("has").alias("has")))
    by_hash = lambda some, n: some.orderBy(F.xxhash64("id"), "id").limit(n).select(F.col("id").alias("_field_id"))
    few = by_hash(ids.filter("has"), rows // 2).union(by_hash(ids.filter("not has"), rows - rows // 2))
    kind = T.StructType([T.StructField("id", T.LongType()), T.StructField("features", T.ArrayType(T.IntegerType())), T.StructField("tags", T.ArrayType(T.IntegerType()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(doc, w) for doc, one in zip(batch.column(0).to_pylist(), raw(batch.column(1)), strict=True) for w in windows(one, doc)]
            yield pa.RecordBatch.from_pydict({"id": pa.array([d for d, _ in out], pa.int64()), "features": pa.array([w[0].ravel() for _, w in out], pa.list_(pa.int32())), "tags": pa.array([w[1] for _, w in out], pa.list_(pa.int32()))})

    used = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    got = used.join(F.broadcast(few), used["id"] == few["_field_id"]).select("id", "text").mapInArrow(tidy(cut), kind).toArrow()  # rows texts' windows, 6 each at most
    order = np.argsort(got["id"].to_numpy(), kind="stable")
    all_features, all_tags = got["features"].combine_chunks(), got["tags"].combine_chunks()
    x, y = np.full((len(order), WINDOW, MOST_FEATURES), -1, np.int32), np.full((len(order), WINDOW), -1, np.int64)
    for i, j in enumerate(order):
        t = all_tags[int(j)].values.to_numpy()
        y[i, : len(t)] = t
        x[i, : len(t)] = all_features[int(j)].values.to_numpy().reshape(len(t), MOST_FEATURES)
    return Field.fit(x, y)


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Every whole text's secrets: ``doc_id``, ``base`` and ``spans``, arrays of (start, kind, end) by start.

    Kinds are ``assign``, ``access`` and ``hex``, found by the base patterns, and in ``spans`` also ``crf``,
    the field's spans that touch no base one. Places are in code points, the end exclusive.

    Null and empty texts have no span. Rows that repeat are scanned each; null ids stay but do not train.
    Without any match to learn from the field adds nothing. An empty table gives an empty result.
    """
    field = fit_field(docs, id_col, text_col, sample_rows)
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("end", T.LongType())]))
    out = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("base", span), T.StructField("spans", span)])
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(field)
        for batch in batches:
            found = [scanner.spans(t) for t in raw(batch.column(1))]
            named = [[[{"start": a, "kind": k, "end": b} for a, k, b in x[i]] for x in found] for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, arrow) for x in named]], names=out.names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(tidy(scan), out)
