import random
import re

import numpy as np

from parquill.llm import secrets
from parquill.llm.secrets import B, FEATURES, I, O, Field, base_spans, scan_secrets

ASSIGN = re.compile(r"""((?:p|P)(?:a|A)(?:s|S)(?:s|S)(?:(?:w|W)(?:o|O)(?:r|R)(?:d|D)|(?:w|W)(?:d|D))|(?:s|S)(?:e|E)(?:c|C)(?:r|R)(?:e|E)(?:t|T)|(?:t|T)(?:o|O)(?:k|K)(?:e|E)(?:n|N)|(?:a|A)(?:p|P)(?:i|I)_?(?:k|K)(?:e|E)(?:y|Y))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(a, ("assign", "access", "hex")[k], b) for a, k, b in sorted(out)]


CASES = [
    "", "password=abc token=abcdefgh", "token=short token='longenough1'", "My API_KEY : \"abcd.efgh=\" é", "ſecret=abcdefgh toKen=abcdefgh apikey=abcdefghi", "AKIA123456789012 AKIAAKIA123 xAKIA1234567890123y",
    "0123456789abcdef0123456789abcdef" * 2, "token = \"0123456789abcdef0123456789abcdef01\"", "password=\nabcdefgh", "passwd=secret=abcdefgh", "é" * 50 + "secret:12345678\n",
]


def test_base_spans_equal_brute_force(spark):
    draw = random.Random(7)
    bits = ["password", "token", "=", ": ", "\"", "abcdefgh", "12345678", "AKIA", "A1B2C3D4E5F6", "deadbeef" * 4, " ", "\n", "é", "x"]
    texts = CASES + ["".join(draw.choice(bits) for _ in range(draw.randrange(25))) for _ in range(400)]
    assert all(base_spans(t) == brute(t) for t in texts)
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*texts, None])], "doc_id long, text string, spans string").repartition(3)
    for r in scan_secrets(frame).collect():
        want = brute(texts[r["doc_id"]] if r["doc_id"] < len(texts) else None)
        assert [(s["start"], s["kind"], s["end"]) for s in r["base"]] == want
        assert [s for s in r["spans"] if s["kind"] != "crf"] == r["base"] and sorted(r["spans"], key=lambda s: s["start"]) == r["spans"]


def test_the_field_adds_secrets_that_no_pattern_has(spark):
    draw = random.Random(8)
    words = ["the", "login", "of", "plain", "words", "mail", "to", "user.12@mail3.example.com", "4532", "call", "10.0.0.1", "soon.", "and"]
    some = lambda n: " ".join(draw.choice(words) for _ in range(n))
    code = lambda n: "".join(draw.choice("0123456789abcdef") for _ in range(n))
    rows = [(i, f"{some(20)} password={code(18)} {some(20)}" if i % 2 else some(40)) for i in range(600)]
    rows += [(1000 + i, f"{some(20)} pwd {code(18)} {some(20)}") for i in range(20)] + [(2000 + i, some(60)) for i in range(20)]
    got = {r["doc_id"]: r for r in scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = 0
    for i in range(20):
        text = rows[600 + i][1]
        at = text.index("pwd ") + 4
        found += any(s["kind"] == "crf" and (s["start"], s["end"]) == (at, at + 18) for s in got[1000 + i]["spans"])
        assert not got[2000 + i]["spans"]
    assert found >= 15


def test_the_field_learns_contexts_of_any_language(spark):
    draw = random.Random(11)
    words = ["das", "nuevo", "avec", "plain", "words", "mail", "to", "call", "soon.", "and"]
    some = lambda n: " ".join(draw.choice(words) for _ in range(n))
    code = lambda n: "".join(draw.choice("0123456789abcdef") for _ in range(n))
    # Codes that no pattern has are secrets behind a word that silver labels have before theirs, and none behind another.
    rows = [(i, f"{some(20)} {draw.choice(['Passwort', 'clave'])} token={code(18)} {some(20)}" if i % 4 < 2 else f"{some(20)} commit {code(18)} {some(20)}") for i in range(600)]
    rows += [(1000 + i, f"{some(20)} {['Passwort', 'clave'][i % 2]} {code(18)} {some(20)}") for i in range(20)] + [(2000 + i, f"{some(20)} commit {code(18)} {some(20)}") for i in range(20)]
    got = {r["doc_id"]: r for r in scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(any(s["kind"] == "crf" and s["end"] - s["start"] == 18 for s in got[1000 + i]["spans"]) for i in range(20)) >= 15
    assert sum(bool(got[2000 + i]["spans"]) for i in range(20)) <= 2


def test_scores_of_all_words_are_those_of_their_features(monkeypatch):
    draw = np.random.default_rng(12)
    monkeypatch.setattr(secrets, "MOST_WORDS", 3)
    field = Field(draw.normal(size=(FEATURES, 3)), np.zeros((3, 3)))
    scanner = secrets.Scanner(field)
    for _ in range(3):
        scanner.spans("Passwort: qwertzuiop hunter2 clave".encode())
        for w in ("Passwort:", "qwertzuiop", "hunter2"):
            want = [field.weights[secrets._hash(f(w), p)].sum(0) for f, p in ((secrets._own, "o"), (secrets._near, "p"), (secrets._near, "n"))]
            assert np.allclose(scanner.table[scanner.words[w.encode()] >> 2], np.concatenate(want))
    monkeypatch.setattr(secrets, "MOST_WORDS", 10_000)
    monkeypatch.setattr(secrets, "MOST_FORMS", 500)
    signs = random.Random(12)
    words = ["".join(signs.choice("abcABC0123éÉßªº²٣中=:_-./+\"'@#$,;(\ue000") for _ in range(signs.randrange(1, 9) if i % 9 else 70)) for i in range(3000)]
    words += ["".join(signs.choice("abAB") for _ in range(signs.randrange(1, 9))) for _ in range(1000)]
    for k in range(0, len(words), 50):
        scanner.spans(" ".join(words[k : k + 50]).encode())
        for w in words[k : k + 50]:
            want = [field.weights[secrets._hash(f(w), p)].sum(0) for f, p in ((secrets._own, "o"), (secrets._near, "p"), (secrets._near, "n"))]
            assert np.allclose(scanner.table[scanner.words[w.encode()] >> 2], np.concatenate(want)), w
    scanner._start()
    scanner.spans("Passwort: qwertzuiop hunter2 clave".encode())
    assert scanner.used <= 4 + 3 and len({*secrets._near("clave")} & {*secrets._near("horas")}) < 3


def test_viterbi_equals_all_paths():
    draw = np.random.default_rng(9)
    for _ in range(200):
        n = int(draw.integers(1, 7))
        field = Field(np.zeros((FEATURES, 3)), draw.normal(size=(3, 3)) * 2)
        score = draw.normal(size=(n, 3)) * 4
        best, top = None, -np.inf
        for path in np.ndindex(*[3] * n):
            if path[0] == I or any(a == O and b == I for a, b in zip(path, path[1:], strict=False)):
                continue
            value = sum(score[i, t] for i, t in enumerate(path)) + sum(field.moves[a, b] for a, b in zip(path, path[1:], strict=False))
            if value > top:
                best, top = path, value
        assert tuple(field.tags(score)) == best


def test_inside_is_trained_and_a_secret_over_several_words_is_one_span(spark):
    draw = random.Random(13)
    words = ["the", "login", "of", "plain", "words", "mail", "to", "4532", "call", "soon.", "and"]
    some = lambda n: " ".join(draw.choice(words) for _ in range(n))
    code = lambda n: "".join(draw.choice("0123456789abcdefABCDEFxyzXYZ") for _ in range(n))
    text = f"{some(20)} token={code(40)} {some(20)}"
    assert any((tags == I).any() for _, tags in secrets.windows(text.encode(), 1))
    key = f"-----BEGIN RSA PRIVATE KEY-----\n{code(64)}\n{code(64)}\n-----END RSA PRIVATE KEY-----"
    assert any(((tags == B).sum(), (tags == I).sum()) == (1, 1) for _, tags in secrets.windows(f"{some(20)} {key} {some(20)}".encode(), 1))
    rows = [(i, f"{some(20)} token={code(40)} {some(20)}") for i in range(600)]
    wrapped = ["\n".join(code(40) for _ in range(3)) + "\n" + code(25) for _ in range(20)]
    late = [(None, f"{some(20)}\n{w}\n{some(20)}") for w in wrapped]
    got = [r for r in scan_secrets(spark.createDataFrame(rows + late, "doc_id long, text string").coalesce(1)).collect() if r["doc_id"] is None]
    found = [any((s["start"], s["end"]) == (t.index(w), t.index(w) + len(w)) for s in r["spans"]) for r, (_, t), w in zip(got, late, wrapped, strict=True)]
    assert sum(found) >= 15


def test_a_word_before_an_inside_is_decoded():
    field = Field(np.zeros((FEATURES, 3)), np.zeros((3, 3)))
    assert field.tags(np.array([[20.0, 0, 0], [0, 0, 100]])).tolist() == [B, I]
    draw = np.random.default_rng(14)
    for _ in range(300):
        n = int(draw.integers(1, 6))
        field = Field(np.zeros((FEATURES, 3)), draw.normal(size=(3, 3)) / 2)
        score = draw.normal(size=(n, 3)) * 8
        valid = [p for p in np.ndindex(*[3] * n) if p[0] != I and (O, I) not in zip(p, p[1:], strict=False)]
        value = lambda p: sum(score[i, t] for i, t in enumerate(p)) + sum(field.moves[a, b] for a, b in zip(p, p[1:], strict=False))
        assert tuple(field.tags(score)) == max(valid, key=value)


def test_gradient_follows_the_likelihood():
    draw = np.random.default_rng(10)
    tags = draw.choice([O, O, O, B], (200, 8))
    features = np.where(tags[..., None] == B, 5, 9)
    field = Field.fit(features, tags, rounds=60)
    assert field.weights[5, B] > field.weights[5, O] and field.weights[9, O] > field.weights[9, B]


def test_gradient_equals_differences():
    draw = np.random.default_rng(15)
    tags = draw.choice([O, O, B], (6, 7))
    tags[draw.random((6, 7)) < 0.3] = I
    for row in tags:
        for t in range(7):
            if row[t] == I and (t == 0 or row[t - 1] == O):
                row[t] = B
    tags[0, 4:] = tags[1, 1:] = -1
    features = draw.integers(-1, 40, (6, 7, 18))
    sample = secrets.Sample(features, tags)
    w, a = np.zeros((FEATURES + 1, 3)), draw.normal(size=(3, 3))
    w[:40] = draw.normal(size=(40, 3))
    value, grad, grad_a = sample.gradient(w, a)
    # The likelihood by all paths of the second window's one word and of the first window's four.
    total = 0.0
    for x, y in zip(features, tags, strict=True):
        n = int((y >= 0).sum())
        score = np.where(x[:n, :, None] >= 0, w[x[:n]], 0).sum(1)
        paths = [p for p in np.ndindex(*[3] * n) if p[0] != I and (O, I) not in zip(p, p[1:], strict=False)]
        of = lambda p, s=score: sum(s[i, t] for i, t in enumerate(p)) + sum(a[i, j] for i, j in zip(p, p[1:], strict=False))
        total += of(tuple(y[:n])) - np.logaddexp.reduce([of(p) for p in paths])
    assert np.isclose(value, total / 6)
    step = 1e-5
    for at in [(3, 0), (7, 1), (11, 2), (39, 1)]:
        w[at] += step
        up = sample.gradient(w, a)[0]
        w[at] -= 2 * step
        down = sample.gradient(w, a)[0]
        w[at] += step
        assert np.isclose((up - down) / (2 * step), grad[at], atol=1e-6)
    for at in [(O, B), (B, I), (I, I), (B, O)]:
        a[at] += step
        up = sample.gradient(w, a)[0]
        a[at] -= 2 * step
        down = sample.gradient(w, a)[0]
        a[at] += step
        assert np.isclose((up - down) / (2 * step), grad_a[at], atol=1e-6)


def test_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(secrets, "MOST_WORDS", 2_000)
    monkeypatch.setattr(secrets, "MOST_FORMS", 1_000)
    draw, scanner = random.Random(16), secrets.Scanner(Field(np.zeros((FEATURES, 3)), np.zeros((3, 3))))
    for _ in range(200):
        scanner.spans(" ".join("".join(draw.choice("abcdefgh12345") for _ in range(12)) for _ in range(100)).encode())
        assert len(scanner.table) <= 4096 and len(scanner.words) <= 2_100 and len(scanner.forms) <= 1_100


def test_texts_with_matches_train_however_rare(spark):
    draw = random.Random(17)
    code = lambda n: "".join(draw.choice("0123456789abcdef") for _ in range(n))
    rows = [(i, f"plain words before password={code(18)} and plain words behind" if i % 100 == 0 else "plain words only, and no more of them") for i in range(3000)]
    field = secrets.fit_field(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 60)
    base, spans = secrets.Scanner(field).spans(f"plain words before pwd {code(18)} and plain words behind".encode())
    assert not base and [k for _, k, _ in spans] == ["crf"]


def test_edges(spark):
    kind = "doc_id long, text string"
    rows = [(1, None), (2, ""), (None, "password=abcdefgh"), (3, "x" * 200_000), (3, "password=abcdefgh"), (3, "password=abcdefgh")]
    got = scan_secrets(spark.createDataFrame(rows, kind)).collect()
    assert sum(len(r["base"]) for r in got) == 3 and len(got) == 6
    assert scan_secrets(spark.createDataFrame([], kind)).count() == 0
