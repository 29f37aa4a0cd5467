"""Chat formatting with a black-box template and spans found by rendering prefixes.

A template is any function of a list of (role, text) to a string. The renderer renders successive
prefixes of a conversation and compares each output with the one before: what is added is the new
turn's span, and an output that does not continue the one before shows a template that rewrites
history. A second rendering with a sentinel for the text tells where in its span the text lies.
Control strings inside roles and texts are escaped reversibly by `escape`.

Conversations stream through tasks sorted by conv_id and turn, a turn at a time. Every prefix is
rendered whole, in time that grows with the square of a conversation's turns. Only for a template
whose attribute `concatenative` says that it renders each turn by itself, one after another, do
prefixes restart every `PAGE` turns, which gives the same in time and memory in proportion.

Null roles and texts count as empty, rows of a null conv_id as one conversation, equal turns stand in
order of role and text, and repeated rows are turns each. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Template = Callable[[list[tuple[str, str]]], str]
PAGE = 32
#: Strings that tokenizers and templates give a meaning to.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<|system|>", "<|user|>", "<|assistant|>")
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_TURN = re.compile(r"<\|im_start\|>((?:(?!<\|im_end\|>)[^\n])*)\n(.*?)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    """Doubles backslashes, then breaks each control string with one behind its first character."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def marked(messages: list[tuple[str, str]]) -> str:
    """The template in use: a start mark with the role, the text, an end mark."""
    return "".join(f"<|im_start|>{escape(role).replace(chr(10), chr(92) + 'n')}\n{escape(text)}<|im_end|>\n" for role, text in messages)


marked.concatenative = True


def restarts(template: Template, turns: int) -> bool:
    """Whether a prefix of so many turns may be dropped."""
    return turns >= PAGE and getattr(template, "concatenative", False)


def read_back(rendered: str) -> list[tuple[str, str]]:
    """The turns of a rendering by `marked`."""
    return [(_role(r), unescape(t)) for r, t in _TURN.findall(rendered)]


def _role(escaped: str) -> str:
    return re.sub(r"\\(\\|n)?", lambda m: {"n": "\n", "\\": "\\", None: ""}[m[1]], escaped)


def _sentinel(*texts: str) -> str:
    return next(c for c in map(chr, range(0xE000, 0xF8FF)) if not any(c in t for t in texts))


def next_span(template: Template, before: list[tuple[str, str]], rendered: str, role: str, text: str) -> tuple[str, int, int, int, int, bool]:
    """(rendering, turn's start and end, its text's start and end, history rewritten) of one turn more; rendered: of those before."""
    out = template([*before, (role, text)])
    rewritten = not out.startswith(rendered)
    start = len(rendered)
    if rewritten:
        start = next((i for i, (a, b) in enumerate(zip(out, rendered, strict=False)) if a != b), min(len(out), len(rendered)))
    mark = _sentinel(out)
    probe = template([*before, (role, mark)])
    at = probe.rfind(mark)
    if at < 0:  # the template leaves this turn's text out
        return out, start, len(out), start, start, rewritten
    return out, start, len(out), at, len(out) - (len(probe) - at - 1), rewritten


class _Conversation:
    def __init__(self, key, template: Template) -> None:
        self.key, self.template = key, template
        self.turns, self.chars, self.loss_chars, self.rewritten = 0, 0, 0, False
        self.sha, self.loss = hashlib.sha256(), hashlib.sha256()
        self.before: list[tuple[str, str]] = []
        self.rendered = ""

    def add(self, role: str, text: str) -> None:
        if restarts(self.template, len(self.before)):
            self.chars += len(self.rendered)
            self.before, self.rendered = [], ""
        out, start, end, a, b, rewritten = next_span(self.template, self.before, self.rendered, role, text)
        for r, t in read_back(out[start:end]):
            self.sha.update(f"{r}\n{t}\n".encode("utf-8", "surrogatepass"))
            self.turns += 1
            if r == "assistant":
                shown = unescape(out[a:b])
                self.loss.update(shown.encode("utf-8", "surrogatepass"))
                self.loss_chars += len(shown)
        self.rewritten |= rewritten
        self.before.append((role, text))
        self.rendered = out

    def row(self) -> tuple:
        return (self.key, self.turns, self.sha.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars + len(self.rendered), self.rewritten)


COLUMNS = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites_history"]


def formatted(conversations: DataFrame, template: Template = marked) -> DataFrame:
    """For each conversation: its turns and the text under the loss mask, read back from the rendering."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = None
        for b in batches:
            out = []
            for key, role, text in zip(b["key"], b["role"], b["text"], strict=True):
                if now is None or now.key != key:
                    if now is not None:
                        out.append(now.row())
                    now = _Conversation(key, template)
                now.add(role or "", text or "")
            yield pd.DataFrame(out, columns=COLUMNS)
        if now is not None:
            yield pd.DataFrame([now.row()], columns=COLUMNS)

    rows = conversations.select(F.col("conv_id").cast("string").alias("key"), "conv_id", "turn", "role", "text").fillna("", ["key", "role", "text"])
    made = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInPandas(run, "conv_id string, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, rewrites_history boolean")
    return made.withColumn("conv_id", F.when(F.col("conv_id") != "", F.col("conv_id")).cast("bigint"))


def spans(conversations: DataFrame, template: Template = marked) -> DataFrame:
    """Each turn's rendered piece and the place of its text in it, for trainers that need the text itself."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, before, rendered, nth = None, [], "", 0
        for b in batches:
            out = []
            for k, role, text in zip(b["key"], b["role"], b["text"], strict=True):
                if k != key or restarts(template, len(before)):
                    nth = 0 if k != key else nth
                    key, before, rendered = k, [], ""
                rendered, start, end, x, y, rewritten = next_span(template, before, rendered, role, text)
                before.append((role, text))
                out.append((k, nth, rendered[start:end], x - start, y - start, role == "assistant", rewritten))
                nth += 1
            yield pd.DataFrame(out, columns=["conv_id", "nth", "rendered", "text_start", "text_end", "in_loss", "rewrites_history"])

    rows = conversations.select(F.col("conv_id").cast("string").alias("key"), "conv_id", "turn", "role", "text").fillna("", ["key", "role", "text"])
    made = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInPandas(run, "conv_id string, nth int, rendered string, text_start int, text_end int, in_loss boolean, rewrites_history boolean")
    return made.withColumn("conv_id", F.when(F.col("conv_id") != "", F.col("conv_id")).cast("bigint"))
