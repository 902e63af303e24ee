"""Running a translation backend over batches of segments.

A backend is a plain object that is sent to the workers. It is called once a batch, inside ``mapInPandas``-like
stages, never from a column expression, and the stage's result is materialised before it is read again, so that a
call isn't repeated by the optimiser. A lost task does repeat its batches.
"""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versoflow.functions.repair import parse_responses
from versoflow.functions.text import EMPTY_RESPONSE
from versoflow.operators.context import previous_context
from versoflow.operators.glossary import as_list, first_terms
from versoflow.operators.status import batches
from versoflow.session import materialize


class Backend(Protocol):
    """What a translation service must offer: a reply, as raw text, for a request of items, context and glossary."""

    def reply(self, request: dict) -> str: ...


class Identity:
    """Gives every text back as it came."""

    def change(self, text: str) -> str:
        return text

    def reply(self, request: dict) -> str:
        return json.dumps([{"id": x["id"], "translation": self.change(x["text"])} for x in request["items"]], ensure_ascii=False)


class Upper(Identity):
    """Gives every text back in upper case."""

    def change(self, text: str) -> str:
        return text.upper()


class Faulty(Upper):
    """Upper case with the faults of real services, chosen by the first id and the size of the batch: fences, cut replies, missing ids."""

    def reply(self, request: dict) -> str:
        good, first = super().reply(request), request["items"][0]["id"]
        kind = (first // 5 + len(request["items"])) % 5
        if kind == 1:
            return f"```json\n{good}\n```"
        if kind == 2:
            return good[: max(1, len(good) * 2 // 3)]
        if kind == 3:
            return json.dumps([{"id": x["id"], "translation": x["text"].upper()} for x in request["items"][:-1]], ensure_ascii=False)
        return "" if kind == 4 else good


BACKENDS: dict[str, Callable[[], Backend]] = {"identity": Identity, "upper": Upper, "faulty": Faulty}


def with_retries(call: Callable[[], str], attempts: int = 3, first_wait: float = 1.0, most: float = 30.0, sleep: Callable[[float], None] = time.sleep) -> str:
    """The result of a call that may fail: tried again with waits that double, then the last error is raised."""
    for k in range(attempts):
        try:
            return call()
        except Exception:
            if k == attempts - 1:
                raise
            sleep(min(most, first_wait * 2**k) * (1 + 0.1 * random.random()))
    raise AssertionError("unreachable")


#: Terms of a glossary that a prompt is given, at most: the first by appearance.
MOST_TERMS = 20_000


def requests(segments: DataFrame, batch_size: int, glossary: DataFrame | None = None, max_chunk: int = 2000, max_context: int = 2000) -> DataFrame:
    """One row a batch: doc_id, batch_id, vision, expected_ids, items (JSON), context, glossary_text.

    The context is that of the batch's first segment; the glossary is one row of at most MOST_TERMS terms, so it is broadcast.
    """
    rows = batches(previous_context(segments, max_chunk, max_context), batch_size)
    ordered = F.array_sort(F.collect_list(F.struct("segment_id", "row_id", F.coalesce("original_text", F.lit("")).alias("text"), "context")))
    grouped = rows.groupBy("doc_id", F.col("batch_no").alias("batch_id")).agg(F.bool_or("vision").alias("vision"), ordered.alias("rows"))
    items = F.to_json(F.transform("rows", lambda r: F.struct(r["segment_id"].alias("id"), r["text"].alias("text"))))
    out = grouped.select(
        "doc_id", "batch_id", "vision", F.transform("rows", lambda r: r["segment_id"]).alias("expected_ids"), items.alias("items"), F.col("rows")[0]["context"].alias("context")
    )
    if glossary is None:
        return out.withColumn("glossary_text", F.lit(""))
    return out.crossJoin(F.broadcast(as_list(first_terms(glossary, MOST_TERMS)).select("glossary_text")))  # one bounded row


RESPONSES = "doc_id bigint, batch_id bigint, expected_ids array<bigint>, raw_text string, error string"


def call(requests_: DataFrame, backend: Backend, attempts: int = 3, partitions: int | None = None, first_wait: float = 1.0) -> DataFrame:
    """Raw replies. A batch whose calls all fail gets a null reply and the error; other batches go on."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                request = {"items": json.loads(r.items), "context": r.context, "glossary": r.glossary_text, "vision": bool(r.vision)}
                try:
                    raw, error = with_retries(lambda: backend.reply(request), attempts, first_wait), None  # noqa: B023
                except Exception as e:
                    raw, error = None, f"{type(e).__name__}: {e}"
                out.append((r.doc_id, r.batch_id, list(r.expected_ids), raw, error))
            yield pd.DataFrame(out, columns=["doc_id", "batch_id", "expected_ids", "raw_text", "error"])

    limited = requests_ if partitions is None else requests_.repartition(partitions)
    return materialize(limited.mapInPandas(run, RESPONSES))


def translate(segments: DataFrame, backend: Backend, batch_size: int = 5, glossary: DataFrame | None = None, attempts: int = 3) -> DataFrame:
    """Segments (unique by doc_id and segment_id) with ``translated_text`` and ``route`` from the backend.

    Empty translations become the marker of an empty response.
    """
    replies = call(requests(segments, batch_size, glossary), backend, attempts)
    parsed = parse_responses(replies).select("doc_id", "segment_id", F.when(F.col("translation") == "", EMPTY_RESPONSE).otherwise(F.col("translation")).alias("__t"), "route")
    return segments.join(parsed, ["doc_id", "segment_id"], "left").withColumn("translated_text", F.coalesce("__t", "translated_text")).drop("__t")


def two_phase(segments: DataFrame, backend: Backend, extract: Callable[[DataFrame], DataFrame], batch_size: int = 5, ratio: float = 0.1) -> DataFrame:
    """The preamble is translated first, terms are extracted from it, then everything is translated with the glossary."""
    from versoflow.operators.glossary import merged
    from versoflow.operators.status import preamble

    head = translate(preamble(segments, ratio), backend, batch_size)
    glossary = materialize(merged(extract(head)))
    return translate(segments, backend, batch_size, glossary)


def run_counters(results: DataFrame, seconds: float) -> DataFrame:
    """One row: segments processed, successful, batches, and segments a second."""
    from versoflow.functions.text import is_success

    return results.agg(
        F.count("*").alias("processed"), F.count_if(is_success("translated_text")).alias("success"), (F.count("*") / F.lit(max(seconds, 1e-9))).alias("per_second")
    )


def prompt_lengths(requests_: DataFrame) -> DataFrame:
    """doc_id, batch_id, characters of each request's whole prompt."""
    from versoflow.functions.prompts import text_prompt

    return requests_.select("doc_id", "batch_id", F.char_length(text_prompt("context", "items", "glossary_text")).alias("n_chars"))
