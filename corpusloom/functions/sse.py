"""Server-sent events: one stream body is one row and is parsed inside it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import strip


def parse_field(line: Column) -> Column:
    """struct<field, value> of a line, or null for blanks and comments.

    Exactly one blank after the colon is dropped; a line without a colon is a field without value.
    """
    parsed = F.struct(
        F.regexp_extract(line, r"(?s)^([^:]*)", 1).alias("field"),
        F.regexp_extract(line, r"(?s)^[^:]*: ?(.*)$", 1).alias("value"),
    )
    return F.when((line == "") | F.startswith(line, F.lit(":")), None).otherwise(parsed)


def parse_events(body: Column) -> Column:
    """``array<struct<event, data>>`` of a whole stream body.

    A blank line ends an event. The last ``event`` field names it; its ``data`` lines are joined
    by line breaks. Blocks without a known field give no event.
    """

    def frame(block: Column) -> Column:
        fields = F.filter(
            F.transform(F.split(block, "\n", -1), parse_field), lambda f: f.isNotNull()
        )
        names = F.filter(fields, lambda f: f["field"] == "event")
        data = F.filter(fields, lambda f: f["field"] == "data")
        return F.struct(
            strip(F.get(names, F.size(names) - 1)["value"]).alias("event"),
            F.array_join(F.transform(data, lambda f: f["value"]), "\n").alias("data"),
            F.size(data).alias("n_data"),
        )

    frames = F.transform(F.split(body, "\n{2,}", -1), frame)
    return F.filter(frames, lambda f: f["event"].isNotNull() | (f["n_data"] > 0))


def stream_events(streams: DataFrame, key: str, body: str = "body") -> DataFrame:
    """(key, seq, event, data) of stream bodies."""
    events = F.posexplode_outer(parse_events(F.col(body))).alias("seq", "_event")
    return streams.select(key, events).where(F.col("_event").isNotNull()).select(
        key, "seq", "_event.event", "_event.data"
    )


def answer_text(streams: DataFrame, key: str, body: str = "body") -> DataFrame:
    """(key, retrieved, answer): the retrieved payload and the tokens up to ``done``."""
    events = F.col("_events")
    done = F.array_position(F.transform(events, lambda e: e["event"]), F.lit("done")).cast("int")
    until = F.when(done > 0, F.slice(events, F.lit(1), done)).otherwise(events)
    tokens = F.filter(until, lambda e: (e["event"] == "token") & (e["n_data"] > 0))
    retrieved = F.filter(events, lambda e: e["event"] == "retrieved")
    return streams.select(key, parse_events(F.col(body)).alias("_events")).select(
        key,
        F.get(retrieved, F.lit(0))["data"].alias("retrieved"),
        F.array_join(F.transform(tokens, lambda e: e["data"]), "").alias("answer"),
    )
