"""Providers for staged annotation from models that run in Python, and a retriever.

A model is anything a loader returns; it is loaded once a partition, sees texts in Arrow
batches, and is closed when the partition ends. Prompts and models are the caller's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadmill.operators import repair, retrieve, units
from threadmill.plans.annotate import Provider
from threadmill.session import cut


def generate(df: DataFrame, key: str, prompt: Column, load: Callable[[], object], run: Callable[[object, list[str]], Sequence[str]], batch: int = 8) -> DataFrame:
    """(key, output, error): what a model says to every prompt; one of output and error is null.

    ``run`` gets the loaded model and up to ``batch`` prompts. A batch that fails is tried
    prompt by prompt, so one bad prompt costs only itself.
    """

    def partition(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        try:
            for f in frames:
                if not len(f):
                    continue
                model = load() if model is None else model
                yield pd.DataFrame({key: f["k"], **_answers(model, f["p"].tolist(), run, batch)})
        finally:
            if hasattr(model, "close"):
                model.close()

    rows = df.select(F.col(key).alias("k"), prompt.alias("p"))
    return rows.mapInPandas(partition, f"{key} {df.schema[key].dataType.simpleString()}, output string, error string")


def _answers(model: object, prompts: list[str], run: Callable, batch: int) -> dict[str, list]:
    out: list[str | None] = []
    errors: list[str | None] = []
    for at in range(0, len(prompts), batch):
        part = prompts[at : at + batch]
        try:
            got = list(run(model, part))
            out, errors = out + got, errors + [None] * len(part)
        except Exception:  # noqa: BLE001 - a provider may raise anything
            for p in part:
                try:
                    out.append(list(run(model, [p]))[0])
                    errors.append(None)
                except Exception as e:  # noqa: BLE001
                    out.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
    return {"output": out, "error": errors}


def label_provider(prompt: Column, load: Callable, run: Callable, keys: Sequence[str]) -> Provider:
    """A provider of labels: its model's output is parsed, or its labels are recovered from it."""

    def provider(df: DataFrame) -> DataFrame:
        said = cut(generate(df, "post_id", prompt, load, run))
        read = said.select("post_id", "error", repair.parse_labels(list(keys))("output").alias("r"))
        error = F.coalesce("error", F.when(F.col("r.status") == "missing", "labels missing"))
        return read.select("post_id", *[F.col(f"r.{k}").alias(k) for k in keys], error.alias("error"))

    return provider


def unit_provider(prompt: Column, load: Callable, run: Callable) -> Provider:
    """A provider of units; broken output gives the units that can be recovered, else an error."""

    def provider(df: DataFrame) -> DataFrame:
        said = cut(generate(df, "post_id", prompt, load, run))
        read = said.select("post_id", "error", repair.parse_units("output").alias("r"))
        result = units.read_payload(F.concat(F.lit('{"units":'), F.col("r.units"), F.lit("}")))
        error = F.coalesce("error", F.when(F.col("r.units").isNull(), F.concat(F.lit("units "), F.col("r.status"))))
        return read.select("post_id", result["units"].alias("units"), error.alias("error"))

    return provider


def judge_provider(prompt: Column, load: Callable, run: Callable) -> Provider:
    """A provider of verdicts, in the order the output gives them."""

    def provider(df: DataFrame) -> DataFrame:
        said = cut(generate(df, "post_id", prompt, load, run))
        each = said.where("error is null").select("post_id", F.posexplode(repair.parse_verdicts("output")).alias("seq", "v")).select("post_id", "seq", "v.unit_id", "v.judge_verdict", F.lit(None).cast("string").alias("error"))
        failed = said.where("error is not null").select("post_id", F.lit(0), F.lit(None).cast("string"), F.lit(None).cast("string"), "error")
        return each.union(failed)

    return provider


def retriever(gold: DataFrame, text: Column, k: int = 5, min_primary: int = 1, min_proxy: int = 0) -> Callable[[DataFrame], DataFrame]:
    """A function posts -> (post_id, examples): the k results closest in wording, as JSON, best first.

    ``gold`` is checked once: it needs so many primary and proxy candidates, all grounded.
    With k of 0 or less there are no examples.
    """
    ready = units.require_seed(gold, min_primary, min_proxy)
    side = lambda df, c: df.select(F.col("post_id").alias("id"), c.alias("text"), "language", "country")
    labels = ready.select(F.col("post_id").alias("gid"), F.to_json(F.struct("post_id", "relevance_label", "experiencer_label", "content_function", "units")).alias("example"))

    def of(posts: DataFrame) -> DataFrame:
        if k <= 0:
            return posts.select("post_id", F.array().cast("array<string>").alias("examples"))
        top = retrieve.lexical_topk(side(posts, text), side(ready, text), k)
        rows = top.join(labels, "gid").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "example"))).alias("e"))
        return rows.select(F.col("qid").alias("post_id"), F.transform("e", lambda x: x["example"]).alias("examples"))

    return of
