"""The seam for a model: prompt, token stream, guards. Models themselves are plugged in."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

from parquill import adapters
from parquill.errors import ReasoningLeakError, TruncatedTranslationError
from parquill.operators.records import PromptShape

MAX_TOKENS = 512
#: Tokenizer attributes that hold reasoning delimiters.
DELIMITERS = ("think_start", "think_end")


class Translator:
    """Translates one text at a time with a model that ``loader`` loads and ``generator`` runs.

    ``loader(model_id[, adapter_path=...])`` gives model and tokenizer; ``generator(model, tokenizer,
    prompt=..., max_tokens=...)`` yields parts with ``text`` and ``finish_reason``. Both default to the
    packages of the local runtime, imported only then.
    """

    def __init__(self, model: str | None = None, *, adapter: str | None = None, allow_mismatch: bool = False, shape: PromptShape | None = None, loader: Callable[..., tuple[Any, Any]] | None = None, generator: Callable[..., Iterable[Any]] | None = None) -> None:
        self.shape = shape or PromptShape()
        self.model_id, self.adapter = adapters.resolve_model(model), adapters.resolve_adapter(adapter)
        if loader is None or generator is None:
            import mlx_lm

            loader, generator = loader or mlx_lm.load, generator or mlx_lm.stream_generate
        self._generate, extra = generator, {}
        if self.adapter is not None:
            adapters.check_adapter(self.adapter, model=self.model_id, fingerprint=self.shape.fingerprint(), allow_mismatch=allow_mismatch)
            extra = {"adapter_path": self.adapter}
        self.model, self.tokenizer = loader(self.model_id, **extra)

    def translate(self, text: str, *, max_tokens: int = MAX_TOKENS) -> str:
        """The translation alone; a leaked reasoning delimiter or an unfinished answer is an error."""
        prompt = self.tokenizer.apply_chat_template(self.shape.messages(text), add_generation_prompt=True, tokenize=False, enable_thinking=False)
        parts = [(p.text, p.finish_reason) for p in self._generate(self.model, self.tokenizer, prompt=prompt, max_tokens=max_tokens)]
        said, reason = "".join(t for t, _ in parts).strip(), parts[-1][1] if parts else None
        for mark in (getattr(self.tokenizer, name, None) for name in DELIMITERS):
            if mark and mark in said:
                raise ReasoningLeakError(mark, said)
        if reason != "stop":
            raise TruncatedTranslationError(max_tokens=max_tokens, partial_text=said, finish_reason=reason)
        return said
