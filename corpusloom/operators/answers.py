"""From retrieved chunks to prompts, answer tokens, event streams and costs."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.config import Settings, get_settings

# Fixed value: what stands between two chunks of a prompt.
CHUNK_SEPARATOR = "\n\n---\n\n"
EMPTY_CONTEXT = "Context: none was found."
NO_CHUNKS_ANSWER = "Nothing was found."

# Price per million tokens, in CNY; unknown models cost nothing.
PRICES = {"doubao-seed-2.0-pro": (3.20, 16.00)}


class GenerationError(Exception):
    """The answer client is missing its configuration, or its service failed."""


class AnswerClient(Protocol):
    """Streams (fragment, usage) pairs; usage is (prompt_tokens, completion_tokens) or None."""

    def stream(
        self, messages: list[dict[str, str]]
    ) -> Iterable[tuple[str | None, tuple[int, int] | None]]: ...


def _collect_ranked(value: Column) -> Column:
    """Values of one query in rank order; at most top_k (50) chunks, so the array is bounded."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", value.alias("value"))))
    return F.transform(ordered, lambda row: row["value"])


def chunk_text(namespace: Column, path: Column, symbol: Column, text: Column) -> Column:
    header = F.concat(F.lit("["), F.concat_ws(":", namespace, path, symbol), F.lit("]"))
    return F.concat(header, F.lit("\n"), text)


def prompts(queries: DataFrame, hydrated: DataFrame, settings: Settings | None = None) -> DataFrame:
    """(query_id, context, user_message, messages) for every query, hits or not.

    The first message is the settings' ``system_prompt``.
    """
    system = (settings or get_settings()).system_prompt
    part = chunk_text(F.col("namespace"), F.col("path"), F.col("symbol"), F.col("text"))
    contexts = hydrated.groupBy("query_id").agg(
        F.array_join(_collect_ranked(part), CHUNK_SEPARATOR).alias("context")
    )
    question = F.concat(F.lit("\n\nQuestion: "), F.col("question"))
    user = F.when(F.col("context").isNull(), F.concat(F.lit(EMPTY_CONTEXT), question)).otherwise(
        F.concat(F.lit("Context:\n\n"), F.col("context"), question)
    )

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    joined = queries.select("query_id", "question").join(contexts, "query_id", "left")
    return joined.select(
        "query_id",
        "context",
        user.alias("user_message"),
        F.array(message("system", F.lit(system)), message("user", user)).alias("messages"),
    )


def namespace_counts(hydrated: DataFrame) -> DataFrame:
    """(query_id, namespace, n, first_rank): chunks per namespace of a result."""
    return hydrated.groupBy("query_id", "namespace").agg(
        F.count("*").alias("n"), F.min("rank").alias("first_rank")
    )


def mock_answers(queries: DataFrame, hydrated: DataFrame) -> DataFrame:
    """(query_id, answer): namespaces by number of chunks, ties by first appearance."""
    line = F.concat(F.lit("  "), F.col("namespace"), F.lit(": "), F.col("n"), F.lit(" chunks"))
    lines = F.array_sort(F.collect_list(F.struct(-F.col("n"), "first_rank", line.alias("line"))))
    summary = namespace_counts(hydrated).groupBy("query_id").agg(
        F.concat_ws(
            "\n",
            F.concat(
                F.lit("Hits by namespace ("), F.count("*"), F.lit("):")
            ),
            F.transform(lines, lambda row: row["line"]),
        ).alias("answer")
    )
    joined = queries.select("query_id").join(summary, "query_id", "left")
    return joined.withColumn("answer", F.coalesce("answer", F.lit(NO_CHUNKS_ANSWER)))


def token_fragments(answer: Column) -> Column:
    """Streamed fragments of a text: its words with single blanks between them."""
    words = F.split(answer, " ", -1)
    return F.flatten(
        F.transform(
            words, lambda word, i: F.when(i == 0, F.array(word)).otherwise(F.array(F.lit(" "), word))
        )
    )


def token_cost(tokens: DataFrame, prices: Mapping[str, tuple[float, float]] = PRICES) -> DataFrame:
    """Add input_cost and output_cost to rows of (model, prompt_tokens, completion_tokens)."""

    def price(column: int) -> Column:
        known = [x for model, pair in prices.items() for x in (F.lit(model), F.lit(pair[column]))]
        return F.coalesce(F.create_map(*known)[F.col("model")], F.lit(0.0))

    return tokens.withColumns(
        {
            "input_cost": F.col("prompt_tokens") / 1_000_000 * price(0),
            "output_cost": F.col("completion_tokens") / 1_000_000 * price(1),
        }
    )


def event_stream(
    queries: DataFrame, summaries: DataFrame, answers: DataFrame, debug: DataFrame | None = None
) -> DataFrame:
    """(query_id, seq, event, data): ``retrieved``, then ``token`` …, then ``done``.

    ``answers`` holds query_id and fragments. A query with retrieval_only has no tokens. Each
    query's events are built from its one row; sequence numbers need no sorting of events.
    """
    fields = [c for c in summaries.columns if c not in ("query_id", "rank")]
    chunk_lists = summaries.groupBy("query_id").agg(
        _collect_ranked(F.struct(*fields)).alias("chunks")
    )
    joined = queries.select("query_id", "retrieval_only").join(chunk_lists, "query_id", "left")
    payload = [F.coalesce(F.col("chunks"), F.array()).alias("chunks")]
    if debug is not None:
        stages = [c for c in debug.columns if c != "query_id"]
        joined = joined.join(debug.select("query_id", F.struct(*stages).alias("debug")), "query_id", "left")
        payload.append(F.col("debug"))
    joined = joined.join(answers, "query_id", "left")

    def event(name: str, data: Column) -> Column:
        return F.struct(F.lit(name).alias("event"), data.cast("string").alias("data"))

    options = {"ignoreNullFields": "false"}
    tokens = F.when(
        F.col("retrieval_only") | F.col("fragments").isNull(), F.array().cast("array<string>")
    ).otherwise(F.col("fragments"))
    events = F.concat(
        F.array(event("retrieved", F.to_json(F.struct(*payload), options))),
        F.transform(tokens, lambda token: event("token", token)),
        F.array(event("done", F.lit(""))),
    )
    return joined.select("query_id", F.posexplode(events).alias("seq", "_event")).select(
        "query_id", "seq", "_event.event", "_event.data"
    )


def wire_format(event: Column, data: Column) -> Column:
    """One server-sent event as text; line breaks in the data open further data lines."""
    lines = F.concat(F.lit("data: "), F.array_join(F.split(data, "\n", -1), "\ndata: "))
    return F.concat(F.lit("event: "), event, F.lit("\n"), lines, F.lit("\n\n"))


def _ask(load_client: Callable[[], AnswerClient], keep_errors: bool):
    def reply(client: AnswerClient, messages) -> tuple:
        fragments, usage = [], (None, None)
        plain = [{"role": m["role"], "content": m["content"]} for m in messages]
        for fragment, counted in client.stream(plain):
            if fragment:
                fragments.append(fragment)
            usage = counted or usage
        return fragments, *usage, None

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = None
        for frame in frames:
            out = []
            for query_id, messages in zip(frame["query_id"], frame["messages"], strict=True):
                client = client or load_client()
                try:
                    out.append((query_id, *reply(client, messages)))
                except Exception as problem:
                    if not keep_errors:
                        raise
                    out.append((query_id, None, None, None, f"{type(problem).__name__}: {problem}"))
                    client = None  # the next request has a new client
            columns = ["query_id", "fragments", "prompt_tokens", "completion_tokens", "error"]
            answer = pd.DataFrame(out, columns=columns)
            yield answer.astype({"prompt_tokens": "Int64", "completion_tokens": "Int64"})

    return ask


def generate_answers(
    prompted: DataFrame,
    load_client: Callable[[], AnswerClient],
    settings: Settings | None = None,
    keep_errors: bool = False,
) -> DataFrame:
    """(query_id, fragments, prompt_tokens, completion_tokens, error, model, costs) from a real client.

    Usage comes with the last fragment; without it the token and cost columns stay null. A failing
    service raises and fails the task, which Spark tries again; with ``keep_errors`` a request that fails has its error
    and no fragments, and the others are answered.
    """
    settings = settings or get_settings()
    query_type = prompted.schema["query_id"].dataType.simpleString()
    answered = prompted.select("query_id", "messages").mapInPandas(
        _ask(load_client, keep_errors),
        f"query_id {query_type}, fragments array<string>, prompt_tokens long, completion_tokens long, error string",
    )
    return token_cost(answered.withColumn("model", F.lit(settings.answer_model)))


def answer_usage(answers: DataFrame) -> DataFrame:
    """One row per model: requests, failed ones, answers without usage, tokens and costs."""
    failed = F.col("error").isNotNull()
    return answers.groupBy("model").agg(
        F.count("*").alias("requests"),
        F.count_if(failed).alias("failed"),
        F.count_if(~failed & F.col("prompt_tokens").isNull()).alias("without_usage"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("prompt_tokens", "completion_tokens", "input_cost", "output_cost")],
    )


def get_answerer(
    settings: Settings | None = None, load_client: Callable[[], AnswerClient] | None = None
) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """(queries, hydrated) → (query_id, fragments, …). A missing key is an error, never a mock."""
    settings = settings or get_settings()
    if settings.use_mock_answers:
        return lambda queries, hydrated: mock_answers(queries, hydrated).select(
            "query_id", token_fragments(F.col("answer")).alias("fragments")
        )
    if not settings.answer_api_key:
        raise GenerationError("answers are not mocked but no API key is set")
    if load_client is None:
        raise GenerationError("a real answerer needs a client factory")
    return lambda queries, hydrated: generate_answers(
        prompts(queries, hydrated), load_client, settings
    )
