"""Asking a model: samples to messages, batches to a generator, and its decoded texts to answer rows.

Models take rows in batches and pad each to its longest prompt. ``Batched`` makes batches of prompts of like length, as
large as the model takes: rows are numbered over the whole table by length, so every batch is full and little is padded. A
batch that fails is asked again, then in halves, so that one bad row doesn't take others along.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip, without_echo, without_thoughts
from .order import batched
from .prompts import answers, chat, decoding, layout_of

#: Rows that a model takes at once, the others 32; models whose thoughts are to be turned off, or cut from the answer.
BATCH = {
    256: ("meta-llama/Meta-Llama-3.1-8B-Instruct", "mistralai/Mistral-7B-Instruct-v0.3", "zai-org/glm-4-9b-chat-hf", "google/gemma-3-12b-it", "google/gemma-2-9b-it", "Qwen/Qwen3-8B"),
    128: ("allenai/Olmo-3-7B-Instruct", "microsoft/phi-4", "Qwen/Qwen3-14B"),
    64: ("deepseek-ai/DeepSeek-V2-Lite-Chat", "moonshotai/Moonlight-16B-A3B-Instruct", "nvidia/NVIDIA-Nemotron-Nano-9B-v2"),
}
UNTHINKING = ("Qwen/Qwen3-8B", "Qwen/Qwen3-14B")
THINKING = "deepseek-ai/DeepSeek-R1"


def settings(model: str) -> dict:
    """Decoding, batch size and whether the chat template is to turn thinking off."""
    size = next((n for n, models in BATCH.items() if model in models), 32)
    return decoding(model) | {"batch_size": size} | ({"enable_thinking": False} if model in UNTHINKING else {})


def infer(samples: DataFrame, model: str, generator, layout: str | None = None) -> DataFrame:
    """samples (as by prompts.samples) -> answer rows with llm_output.

    The generator takes rows with their messages as ``input`` and adds ``llm_output``, the decoded text; if it adds ``previous``
    as well, the decoded prompt that the text repeats, that is cut off.
    """
    asked = samples.withColumn("input", chat(F.lit(layout or layout_of(model))))
    out = generator.generate(asked)
    text = strip(without_echo("llm_output", "previous") if "previous" in out.columns else F.col("llm_output"))
    return answers(out, without_thoughts(text) if THINKING in model else text)


#: What tells samples apart, and puts prompts of one length in order.
KEYS = ("Q_number", "LoE", "LoQ", "property")


def prompt_length(messages: str | Column = "input") -> Column:
    """Characters of all messages."""
    return F.aggregate(messages, F.lit(0), lambda n, m: n + F.length(m["content"]))


def in_batches(asked: DataFrame, size: int) -> DataFrame:
    """Rows with messages as ``input`` -> with prompt_length and batch: batches of ``size`` in the order of length."""
    return batched(asked.withColumn("prompt_length", prompt_length()), size, "prompt_length", *(k for k in KEYS if k in asked.columns))


def batch_report(in_batches_: DataFrame) -> DataFrame:
    """(batch, n, longest, padding): rows, longest prompt and characters that padding adds."""
    longest = F.max("prompt_length")
    return in_batches_.groupBy("batch").agg(F.count("*").alias("n"), longest.alias("longest"), (longest * F.count("*") - F.sum("prompt_length")).alias("padding"))


def asked_for(function: Callable[[list, dict], list[str]], batch: list, how: dict, tries: int) -> list[tuple[str | None, str | None]]:
    """(text, error) of each row: a failing batch is asked ``tries`` times, then each half of it in the same way."""
    for n in range(tries):
        try:
            texts = function(batch, how)
            if len(texts) != len(batch):
                raise ValueError(f"{len(texts)} texts for {len(batch)} prompts")
            return [(t, None) for t in texts]
        except Exception as e:  # noqa: BLE001 - whatever a model raises is the row's error in the end
            if n + 1 == tries and len(batch) == 1:
                return [(None, f"{type(e).__name__}: {e}")]
    half = len(batch) // 2
    return asked_for(function, batch[:half], how, tries) + asked_for(function, batch[half:], how, tries)


class Batched:
    """A generator of a Python function (messages of a batch, settings of the model) -> decoded texts.

    Adds llm_output, the row's error or null, the batch and the prompt's length. A batch is never split over tasks.
    """

    def __init__(self, model: str, function: Callable[[list, dict], list[str]], tries: int = 3, settings_: dict | None = None):
        self.how = settings_ or settings(model)
        self.function, self.tries = function, tries

    def generate(self, asked: DataFrame) -> DataFrame:
        function, how, tries = self.function, self.how, self.tries
        rows = in_batches(asked, how["batch_size"])

        def answered(batch: pd.DataFrame) -> pd.DataFrame:
            got = asked_for(function, batch["input"].tolist(), how, tries)
            return batch.assign(llm_output=[t for t, _ in got], error=[e for _, e in got])

        def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = None
            for frame in frames:
                held = frame if held is None else pd.concat([held, frame], ignore_index=True)
                if len(held):
                    open_ = held["batch"] == held["batch"].iloc[-1]
                    for _, batch in held[~open_].groupby("batch", sort=False):
                        yield answered(batch)
                    held = held[open_]
            if held is not None and len(held):
                yield answered(held)

        schema = ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes), "llm_output string", "error string"])
        return rows.repartition("batch").sortWithinPartitions("batch", "prompt_length").mapInPandas(call, schema)
