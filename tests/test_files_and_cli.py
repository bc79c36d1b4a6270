import json
import sys
from types import SimpleNamespace

import pytest

from parquill import adapters, cli, training
from parquill.errors import AdapterExistsError, AdapterMismatchError, AdapterPathError, AdapterProvenanceError, DestinationError, ReasoningLeakError, SourceReadError, SplitTooSmallError, TrainerFailedError, TruncatedTranslationError
from parquill.operators.records import PromptShape
from parquill.plans.validate import SplitReport
from parquill.sources import readers, sinks
from parquill.translator import Translator


@pytest.mark.parametrize(("name", "expected"), [("doc.txt", "doc.ko.txt"), ("doc", "doc.ko"), ("a.tar.gz", "a.tar.ko.gz")])
def test_output_names(name, expected, tmp_path):
    assert sinks.output_path(name, tmp_path).name == expected


def test_part_files(tmp_path):
    with sinks.PartFile(tmp_path / "a") as out:
        out.write("x")
        assert not (tmp_path / "a").exists() and (tmp_path / "a.part").read_text() == "x"
    assert (tmp_path / "a").read_text() == "x"
    with pytest.raises(RuntimeError), sinks.PartFile(tmp_path / "b") as out:
        out.write("y")
        raise RuntimeError
    assert not (tmp_path / "b").exists() and (tmp_path / "b.part").read_text() == "y"


def test_destinations_are_guarded(tmp_path):
    (tmp_path / "in.txt").write_text("x")
    (tmp_path / "out").mkdir()
    (tmp_path / "out/in.ko.txt").write_text("y")
    with pytest.raises(DestinationError):
        sinks.check_destination(tmp_path / "in.txt", tmp_path / "in.txt", force=True)
    with pytest.raises(DestinationError):
        sinks.plan_batch([tmp_path / "in.txt"], tmp_path / "out")
    assert len(sinks.plan_batch([tmp_path / "in.txt"], tmp_path / "out", force=True)) == 1
    (tmp_path / "d").mkdir()
    (tmp_path / "d/in.txt").write_text("x")
    with pytest.raises(DestinationError):
        sinks.plan_batch([tmp_path / "in.txt", tmp_path / "d/in.txt"], tmp_path / "new")
    assert not (tmp_path / "new").exists()


def test_documents_in_other_encodings(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("Привет\r\nмир".encode("windows-1251"))
    (tmp_path / "b.txt").write_bytes("﻿Привет\rмир".encode())
    assert readers.read_documents(spark, [str(tmp_path / "a.txt")], "windows-1251").first()["text"] == "Привет\nмир"
    assert readers.read_documents(spark, [str(tmp_path / "b.txt")]).first()["text"] == "Привет\nмир"
    with pytest.raises(SourceReadError):
        readers.read_documents(spark, [str(tmp_path / "a.txt")])
    with pytest.raises(LookupError):
        readers.read_documents(spark, [str(tmp_path / "a.txt")], "no-codec")


def test_provenance_decisions(tmp_path, monkeypatch):
    said = []
    check = lambda **x: adapters.check_adapter(tmp_path / "a", model="m", fingerprint="f", warn=said.append, **x)
    with pytest.raises(AdapterProvenanceError):
        check()
    (tmp_path / "a").mkdir()
    assert check() is None and len(said) == 1
    adapters.write_provenance(tmp_path / "a", adapters.Provenance("m", "f"))
    assert check() == adapters.Provenance("m", "f") and len(said) == 1
    for other in (adapters.Provenance("x", "f"), adapters.Provenance("m", "x")):
        adapters.write_provenance(tmp_path / "a", other)
        with pytest.raises(AdapterMismatchError):
            check()
        assert check(allow_mismatch=True) == other
    for bad in ("{", "[]", '{"schema_version": 1}', json.dumps({"schema_version": 2, "base_model_id": "m", "prompt_shape_fingerprint": "f"})):
        adapters.provenance_path(tmp_path / "a").write_text(bad)
        with pytest.raises(AdapterProvenanceError):
            check(allow_mismatch=True)
    monkeypatch.setenv(adapters.MODEL_VARIABLE, " env ")
    assert adapters.resolve_model(" ") == "env" and adapters.resolve_model("x") == "x"
    monkeypatch.delenv(adapters.MODEL_VARIABLE)
    assert adapters.resolve_model() == adapters.DEFAULT_MODEL and adapters.resolve_adapter(" ") is None


def splits(folder, n=3):
    shape = PromptShape()
    rows = "".join(json.dumps({"messages": [*shape.messages(f"s{i}"), {"role": "assistant", "content": "t"}]}) + "\n" for i in range(n))
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "train.jsonl").write_text(rows)
    return str(folder)


def test_training_launch(spark, tmp_path):
    data, seen = splits(tmp_path / "data"), []
    config = training.TrainingConfig(data, adapter_path=str(tmp_path / "out"), iterations=5, seed=0, batch_size=2, mask_prompt=True)
    path, report = training.train_adapter(spark, config, runner=lambda argv: seen.append(argv) or 0)
    argv = seen[0]
    assert argv[:4] == [sys.executable, "-m", "mlx_lm", "lora"] and argv[argv.index("--iters") + 1] == "5" and argv[argv.index("--seed") + 1] == "0"
    assert "--mask-prompt" in argv and "--train" in argv and "--grad-checkpoint" not in argv and "--learning-rate" not in argv
    assert adapters.read_provenance(path).prompt_shape_fingerprint == PromptShape().fingerprint() and report.rows["train.jsonl"] == 3
    (path / "w.safetensors").write_text("x")
    with pytest.raises(AdapterExistsError):
        training.train_adapter(spark, config, runner=lambda _: 0)
    with pytest.raises(TrainerFailedError):
        training.train_adapter(spark, training.TrainingConfig(data, adapter_path=str(tmp_path / "o2")), runner=lambda _: 3)
    with pytest.raises(AdapterPathError):
        training.adapter_path(training.TrainingConfig(data, adapter_path=f"{data}/x"))
    with pytest.raises(TypeError):
        training.TrainingConfig(rank=8)


def test_preflight():
    report = SplitReport("d", {"train.jsonl": 4, "valid.jsonl": 1, "test.jsonl": 0}, ())
    with pytest.raises(SplitTooSmallError, match="valid.jsonl has 1"):
        training.preflight(report, 2)
    assert training.preflight(report, 1).notices == () and len(training.preflight(report, None).notices) == 1


def translator(parts, **tokenizer):
    said = {}
    tok = SimpleNamespace(apply_chat_template=lambda messages, **x: said.update(messages=messages, **x) or "p", **tokenizer)
    made = Translator("m", loader=lambda *a, **x: (None, tok), generator=lambda *a, **x: iter(SimpleNamespace(text=t, finish_reason=r) for t, r in parts))
    return made, said


def test_translator_guards():
    made, said = translator([(" не", None), ("т ", "stop")])
    assert made.translate("да") == "нет" and said["messages"] == PromptShape().messages("да") and said["enable_thinking"] is False
    with pytest.raises(TruncatedTranslationError) as error:
        translator([("нет", "length")])[0].translate("да")
    assert error.value.partial_text == "нет"
    with pytest.raises(ReasoningLeakError):
        translator([("<t>нет", "length")], think_start="<t>")[0].translate("да")
    with pytest.raises(TruncatedTranslationError):
        translator([])[0].translate("да")


def shout(*_):
    def run(text):
        if "!" in text:
            raise ValueError
        return text.upper()

    return run


def test_cli(spark, tmp_path, capsys):
    run = lambda *argv, **x: cli.main([str(a) for a in argv], spark=spark, make=shout, **x)
    assert run("translate", " да ") == 0 and capsys.readouterr().out == "ДА\n"
    for bad in (["translate", "x", "--input", "y"], ["translate", "--input", "a", "--input", "b"], ["translate", " "], ["translate", "x", "--output", "y"]):
        with pytest.raises(SystemExit) as error:
            run(*bad)
        assert error.value.code == 2
    a, b = tmp_path / "a.txt", tmp_path / "b.txt"
    a.write_text("да\n\nнет\n", encoding="utf-8")
    b.write_text("да\n\nнет!\n", encoding="utf-8")
    assert run("translate", "--input", a, "--output", tmp_path / "o.txt") == 0
    assert (tmp_path / "o.txt").read_text(encoding="utf-8") == "ДА\n\nНЕТ\n"
    assert run("translate", "--input", a, "--input", b, "--output-dir", tmp_path / "o") == 1
    assert "[[UNTRANSLATED chunk=1]]" in (tmp_path / "o/b.ko.txt").read_text(encoding="utf-8")
    assert run("translate", "--input", a, "--output-dir", tmp_path / "o") == 2
    capsys.readouterr()
    (tmp_path / "p.txt").write_text("".join(f"и {i} ||| 번 {i}\n" for i in range(20)), encoding="utf-8")
    assert run("prepare-data", tmp_path / "p.txt", "--output-dir", tmp_path / "s") == 0
    assert run("prepare-data", tmp_path / "p.txt", "--output-dir", tmp_path / "s") == 1
    assert run("validate-data", "--data", tmp_path / "s") == 0 and "train.jsonl: 16 rows" in capsys.readouterr().out
    assert run("train", "--data", tmp_path / "s", "--adapter-path", tmp_path / "ad", "--iters", 1, runner=lambda _: 0) == 0
    assert run("evaluate", "--test-file", tmp_path / "s/test.jsonl", "--adapter-path", tmp_path / "ad", "--out", tmp_path / "ev") == 0
    assert "verdict" in capsys.readouterr().out and run("evaluate", "--test-file", tmp_path / "s/test.jsonl") == 1


def test_probes(spark):
    assert [r["text"] for r in readers.probes(spark).orderBy("pos").collect()] == list(readers.PROBES)
    assert readers.run_probes(str.upper, ["а", "б"]) == ("А", "Б")
