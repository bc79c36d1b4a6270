import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from parquill.llm import packing
from parquill.llm.packing import Packer, encoder, pack_documents

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [None, "", " \n", "Hello, World. it's The END.", "don't <|endoftext|> a<|startoftext|>b", "Écoles é e\u0301 x\u0301. ß. ẞ İ ıK ſ", "日本語 한글, Привет. ١٢٣ 123.45", "...,., a.,b 5. é. ª º µ.", "a\x0bb\x0cc\rd\x1ce\u00a0f\u2003g", "tail\u0301. é.\u0301", "word " * 9000, "x" * 30_000]


def reference(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 2]


def check(rows, texts, limit=4096, segments=1024):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for key, text in texts.items():
        ids, at = reference(text), 0
        for r in sorted(by_doc[key], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids)) and np.frombuffer(r["ids"], "<u4").tolist() == ids[at : at + r["length"]]
            at += r["length"]
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= limit and len(pieces) <= segments
    return len(by_sequence)


def test_every_id_is_in_one_piece(spark):
    texts = dict(enumerate(TEXTS))
    frame = spark.createDataFrame([(k, t, 1, b"x") for k, t in texts.items()], "doc_id long, text string, start int, ids binary").coalesce(1)
    check(pack_documents(frame).collect(), texts)


def test_little_is_padded(spark):
    draw = random.Random(4)
    texts = {i: " ".join(draw.choice(["red", "green", "bluish", "antidisestablishment"]) for _ in range(draw.randrange(0, 900))) for i in range(300)}
    rows = pack_documents(spark.createDataFrame([*texts.items()], "doc_id long, text string").coalesce(1)).collect()
    used = sum(len(reference(t)) for t in texts.values())
    check(rows, texts)
    lengths = Counter()
    for r in rows:
        lengths[r["sequence_id"]] += r["length"]
    padding = sum(4096 - n for n in lengths.values() if n & (n - 1))
    assert padding <= 0.004 * used and sum(n < 4000 for n in lengths.values()) <= 12


def test_limits_and_repeated_rows(spark):
    frame = spark.createDataFrame([(1, "a")] * 50 + [(None, "b")], "doc_id long, text string").coalesce(1)
    rows = pack_documents(frame, max_segments=8).collect()
    assert len(rows) == 51 and sum(r["length"] for r in rows) == 102
    assert pack_documents(frame.limit(0)).count() == 0


def test_word_cache_equals_the_tokenizer():
    words = encoder(PATH)
    for text in TEXTS:
        ids = b"".join(words[w] for w in (text or "").encode().lower().split())
        assert np.frombuffer(ids, "<u4").tolist() == reference(text)[:-1]


@pytest.mark.parametrize("cut", [True, False])
def test_vectors_keep_all_limits(cut):
    draw = random.Random(5)
    items = [[i, 0, n := draw.randrange(1, 90), draw.randrange(0, n + 1)] for i in range(300)]
    packer = Packer(100, 6, 60, cut)
    pieces, waits = packer.pack([list(x) for x in items], True)
    assert not waits
    sums = defaultdict(lambda: np.zeros(3, int))
    for _, _, n, loss, sequence, offset in pieces:
        if sequence >= 0:
            assert offset == sums[sequence][0]
            sums[sequence] += [n, 1, loss]
    assert all((s <= [100, 6, 60]).all() for s in sums.values())
    for key, _, n, loss in items:
        own = [p for p in pieces if p[0] == key]
        assert sum(p[2] for p in own) == n and sum(p[3] for p in own) == loss
        assert cut or len(own) == 1 and (own[0][4] >= 0) == (loss <= 60)
    bound = max(-(-sum(x[2] for x in items) // 100), -(-sum(x[3] for x in items) // 60), -(-300 // 6))
    assert len(sums) <= 1.35 * bound + 7


def test_instruction_data_keeps_the_limit_on_loss(spark):
    draw = random.Random(6)
    rows = [(i, " ".join(["ask"] * draw.randrange(0, 60)), " ".join(["answer"] * draw.randrange(0, 40))) for i in range(200)]
    frame = spark.createDataFrame([*rows, (900, "ask " * 300, "no"), (901, None, "answer " * 99)], "doc_id long, prompt string, text string").coalesce(1)
    for whole in (True, False):
        got = pack_documents(frame, prompt_col="prompt", max_tokens=256, max_segments=8, max_loss=64, whole=whole).collect()
        sums, by_doc = defaultdict(lambda: np.zeros(3, int)), Counter()
        for r in got:
            by_doc[r["doc_id"]] += r["loss"]
            if r["sequence_id"] is not None:
                sums[r["sequence_id"]] += [r["length"], 1, r["loss"]]
        assert all((s <= [256, 8, 64]).all() for s in sums.values()) and max(s[2] for s in sums.values()) > 60
        assert all(by_doc[i] == len(reference(text)) for i, _, text in rows)
        if whole:
            assert len(got) == 202 and {r["doc_id"] for r in got if r["sequence_id"] is None} == {900, 901}


def test_windows_and_longer_documents_lose_nothing_and_keep_the_rows_order(spark, monkeypatch):
    monkeypatch.setattr(packing, "WINDOW_TOKENS", 6000)
    draw = random.Random(7)
    texts = {i: " ".join(draw.choice(["red", "green", "bluish"]) for _ in range(draw.choice([5, 300, 900, 9000]))) for i in range(60)}
    frame = spark.createDataFrame([*texts.items()], "doc_id long, text string").coalesce(1).sortWithinPartitions("doc_id")
    rows = pack_documents(frame).collect()
    check(rows, texts)
    short = frame.filter("length(text) < 9000")
    means = defaultdict(list)
    for r in pack_documents(short).collect():
        means[r["sequence_id"]] += [r["doc_id"]] * r["length"]
    places = [np.mean(means[s]) for s in sorted(means) if len(means[s]) == 4096]
    assert len(places) > 3 and places == sorted(places)
