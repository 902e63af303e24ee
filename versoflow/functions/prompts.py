"""Prompts as column expressions. The wording is this library's own; any of it may be given instead."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from versoflow.functions.text import _c, is_blank, strip

BASE = "Translate the given passages faithfully and completely. Keep numbers, names, headings and markup. Add nothing."
TEXT_FORM = 'Answer with a JSON array of objects {"id": number, "translation": text}, one for each passage, and nothing else.'
VISION_FORM = "Read the page in the picture in its order of reading and give its translation as Markdown."
TITLES_FORM = "Translate these chapter titles. Answer with a JSON object from each title to its translation."
TERMS_FORM = "List the names and terms of these passages with their translations as a JSON object."
REPAIR_FORM = "The following answer is not valid JSON. Give it again as valid JSON, without changing its content."
BEGINNING = "(the document begins here)"


def system_instruction(role: Column | str | None = None, style: Column | str | None = None, glossary: Column | str | None = None, vision: bool = False, base: str | None = None) -> Column:
    """The base, the form of the answer, and what is known of the mode and the glossary, as paragraphs."""

    def part(head: str, x: Column | str | None) -> Column:
        return F.lit(None).cast("string") if x is None else F.when(~is_blank(x), F.concat(F.lit(head), strip(x)))

    return F.concat_ws("\n\n", F.lit(base or BASE), F.lit(VISION_FORM if vision else TEXT_FORM), part("Role: ", role), part("Style: ", style), part("Use these translations:\n", glossary))


def text_prompt(context: Column | str, items: Column | str, glossary: Column | str | None = None) -> Column:
    """Context (or that the document begins), glossary if there is one, and the items to translate."""
    before = F.concat(F.lit("What comes before:\n"), F.when(is_blank(context), F.lit(BEGINNING)).otherwise(_c(context)))
    terms = F.lit(None).cast("string") if glossary is None else F.when(~is_blank(glossary), F.concat(F.lit("Use these translations:\n"), _c(glossary)))
    return F.concat_ws("\n\n", before, terms, F.concat(F.lit("Passages:\n"), _c(items)))


def titles_prompt(titles: Column | str) -> Column:
    """``titles`` is an array of titles."""
    return F.concat(F.lit(TITLES_FORM + "\n\n"), F.to_json(_c(titles)))


def terms_prompt(text: Column | str, most: int = 8000) -> Column:
    return F.concat(F.lit(TERMS_FORM + "\n\n"), F.left(_c(text), F.lit(most)))


def repair_prompt(answer: Column | str) -> Column:
    return F.concat(F.lit(REPAIR_FORM + "\n\n"), _c(answer))
