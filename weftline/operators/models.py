"""Model-backed tasks: functions by (task, provider), run as vectorised UDFs; a deterministic offline provider."""

from __future__ import annotations

from collections.abc import Callable, Collection, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.plans.graph import Operator, Port
from weftline.sources.kv import ModelCatalog
from weftline.streaming.queue import JobQueue

RunFn = Callable[[Iterator[pd.DataFrame], str], Iterator[pd.Series]]
_REGISTRY: dict[tuple[str, str], tuple[RunFn, str]] = {}


#: Tasks that a provider does by a column expression: they stay in the engine.
_COLUMNS: dict[tuple[str, str], Callable[..., Column]] = {}


def register(task: str, provider: str, fn: RunFn, returns: str) -> None:
    """A function over batches of rows, in Python workers."""
    _REGISTRY[task, provider] = fn, returns


def register_columns(task: str, provider: str, fn: Callable[..., Column]) -> None:
    """A function of the input columns that returns the output column."""
    _COLUMNS[task, provider] = fn


def dispatch(df: DataFrame, task: str, provider: str, inputs: list[str], output: str, model: str = "model") -> DataFrame:
    """df with the task's output column; unknown pairs raise. Batches stream through one worker, which loads a model once."""
    if (task, provider) in _COLUMNS:
        return df.withColumn(output, _COLUMNS[task, provider](*[F.col(c) for c in inputs]))
    if (task, provider) not in _REGISTRY:
        raise KeyError(f"provider {provider} has no function for {task}")
    fn, returns = _REGISTRY[task, provider]

    @F.pandas_udf(returns)
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        yield from fn(batches, model)

    return df.withColumn(output, run(F.struct(*inputs)))


_LOADED: dict[str, object] = {}


def loaded(model: str, load: Callable[[str], object]) -> object:
    """The worker's copy of a model by its name: loaded once, however often tasks are made anew."""
    if model not in _LOADED:
        _LOADED[model] = load(model)
    return _LOADED[model]


def embedding(text: Column, size: int = 64) -> Column:
    """A hashed bag of words, normalised: the same vector for the same text everywhere; no words give zeros."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0))
    digits = lambda w, at, n: F.conv(F.substr(F.md5(w), F.lit(at), F.lit(n)), 16, 10).cast("int")
    places = F.transform(words, lambda w: F.struct((digits(w, 1, 4) % size).alias("k"), (1 - 2 * (digits(w, 5, 1) % 2)).alias("v")))
    zeros = F.array_repeat(F.lit(0), size)

    def put(held: Column, p: Column) -> Column:
        return F.transform(held, lambda x, i: F.when(i == p["k"], x + p["v"]).otherwise(x))

    # lambda variables hold what was worked out, so each step is done once
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0), lambda t, x: t + x * x))
    both = F.transform(F.array(F.aggregate(places, zeros, put)), lambda c: F.struct(c.alias("c"), norm(c).alias("n")))
    return F.get(F.transform(both, lambda s: F.transform(s["c"], lambda x: F.when(s["n"] == 0, 0.0).otherwise(x / s["n"]))), F.lit(0))


def rewrite_prompt(prompt: Column, text: Column) -> Column:
    """prompt, a line end and the text; the text alone without a prompt."""
    return F.when(prompt.isNull() | (prompt == ""), text).otherwise(F.concat(prompt, F.lit("\n"), text))


def rewritten(text: Column, prompt: Column) -> Column:
    """The offline provider's rewriting: white space made even, the first letter a capital. What comes out as it went in raises."""
    even = F.regexp_replace(F.trim(text), r"\s+", " ")
    out = F.concat(F.upper(F.substr(even, F.lit(1), F.lit(1))), F.substr(even, F.lit(2)))
    return F.when(out == rewrite_prompt(prompt, text), F.raise_error(F.lit("the text came out as it went in"))).otherwise(out)


def summary(text: Column, sentences: int = 1) -> Column:
    """The first sentences: the offline provider's extract."""
    return F.regexp_extract(text, rf"^(?s)((?:.*?[.!?](?:\s|$)){{1,{sentences}}}|.*)", 1)


def answer(context: Column, question: Column) -> Column:
    """The sentence of the context that shares most words with the question, the first of several."""
    bag = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    parts = F.split(context, r"(?<=[.!?])\s+")
    scored = F.transform(parts, lambda s, i: F.struct((-F.size(F.array_intersect(bag(s), bag(question)))).alias("n"), i.alias("i"), s.alias("s")))
    return F.get(F.array_sort(scored), F.lit(0))["s"]


def generated(prompt: Column) -> Column:
    """The offline provider goes on with the prompt's last sentence."""
    return F.concat(prompt, F.lit(" "), F.element_at(F.split(F.trim(prompt), r"(?<=[.!?])\s+"), -1))


def translated(text: Column, source: Column, target: Column) -> Column:
    """The offline provider knows no language: it marks the text with the pair. The target language is an output of its own."""
    return F.concat(F.lit("["), source, F.lit(">"), target, F.lit("] "), text)


register_columns("TextEmbeddingTask", "offline", embedding)
register_columns("TextGenerationTask", "offline", generated)
register_columns("TextRewriterTask", "offline", rewritten)
register_columns("TextSummaryTask", "offline", summary)
register_columns("TextQuestionAnswerTask", "offline", answer)
register_columns("TextTranslationTask", "offline", translated)

#: The ports of DownloadModel, by the task that a model must be connected to.
PORTS = {"embedding_model": "TextEmbeddingTask", "generation_model": "TextGenerationTask", "summarization_model": "TextSummaryTask", "question_answering_model": "TextQuestionAnswerTask", "translation_model": "TextTranslationTask", "rewriting_model": "TextRewriterTask"}


def download(catalog: ModelCatalog, fetch: Callable[[str], None] | None = None) -> DataFrame:
    """Every model with its dimensions, whether it normalises, and a column a port; fetch is called with each name. A side effect: never held."""
    out = catalog.ports(PORTS)
    if fetch is not None:
        for row in catalog.models.select("name").toLocalIterator():
            fetch(row.name)
    return out


def job_rows(df: DataFrame, task: str, models: DataFrame, queues: Collection[str], inputs: list[str], model: str = "model") -> DataFrame:
    """(id, input, queue) of jobs for a model task: the model's provider names the queue. Missing models or queues raise."""
    known = models.select(F.col("name").alias(model), "provider")
    found = df.join(known, model, "left")
    name = F.coalesce(F.col(model), F.lit("null"))
    check = F.when(F.col(model).isNull(), F.raise_error(F.lit("a job has no model"))).when(F.col("provider").isNull(), F.raise_error(F.concat(F.lit("no model "), name))).when(~F.col("provider").isin(*queues), F.raise_error(F.concat(F.lit("no queue for provider "), F.col("provider"))))
    body = F.to_json(F.struct(F.lit(task).alias("taskType"), *inputs, model))
    return found.select(F.col("id"), body.alias("input"), F.coalesce(check.cast("string"), F.col("provider")).alias("queue"))


def queue_operator(name: str, queue: JobQueue) -> Operator:
    """A task that submits its rows (id, input) to a queue, runs the queue until they are done, and returns (id, status, output, error)."""

    def run(rows: DataFrame) -> dict[str, DataFrame]:
        queue.add(rows)
        while queue.process():
            pass
        return {"rows": queue.jobs.join(rows.select("id"), "id", "left_semi").select("id", "status", "output", "error")}

    return Operator(name, run, [Port("rows", "table", required=True)], [Port("rows", "table")], side_effects=True)
