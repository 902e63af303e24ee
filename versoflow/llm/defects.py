"""Problem 2: defective replies with their type of defect.

Method: language posteriors of prompt and reply from character n-gram naive Bayes are compared: a reply whose likeliest
language is its prompt's may be a copy, one of neither the target language nor a mixture with it is in a wrong language.
Truncation comes from the end-of-text n-gram likelihoods of problem 4, refusals from a naive Bayes classifier of words
(``refusal``). The first type that applies counts: empty, refusal, copy, wrong_language, truncated.

Defined results: only rows of type ``text`` with a non-blank prompt are judged; rows without a book have no target
language and are never ``wrong_language``. Repeated rows count each for itself. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versoflow.llm.truncation import judged, reply_features


def classify(segments: DataFrame, books: DataFrame, samples: DataFrame, glossary: DataFrame | None = None) -> DataFrame:
    """Every prompt with its reply's defect (null if sound), the languages of both, and the log-odds of a cut."""
    rows = judged(reply_features(segments, samples, glossary, True), books)
    whole = F.split("reply_lang", ",")
    foreign = (F.col("reply_lang") != "") & F.col("target_lang").isNotNull() & ~F.array_contains(whole, F.col("target_lang"))
    defect = (
        F.when(F.col("empty"), "empty")
        .when(F.col("refusal") > 0, "refusal")
        .when(F.col("copy"), "copy")
        .when(foreign, "wrong_language")
        .when(F.col("cut"), "truncated")
    )
    return rows.where("content_type = 'text' and not prompt_blank").select(
        "row_id", "doc_id", defect.alias("defect"), "prompt_lang", "reply_lang", "target_lang", "cut_log_odds"
    )


def found(segments: DataFrame, books: DataFrame, samples: DataFrame, glossary: DataFrame | None = None) -> DataFrame:
    return classify(segments, books, samples, glossary).where("defect is not null").select("row_id", "defect")
