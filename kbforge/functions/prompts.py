"""Prompts for a language model, one column each, in this engine's own words. Every reply is asked for as one JSON object."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of a document that its judge sees; pairs asked for per chunk; search keywords asked for.
JUDGED, PAIRS, KEYWORDS = 3500, 8, 20


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit("")) for p in parts])


def keywords(requirement: Column, most: int = KEYWORDS) -> Column:
    """Reply: {"keywords": [string]}."""
    return _text("Requirement: ", requirement, f'\nName at most {most} web search keywords that lead to pages for it.\nJSON only: {{"keywords": ["..."]}}')


def url_judge(requirement: Column, url: Column, title: Column, snippet: Column) -> Column:
    """Reply: {"relevant": bool, "reason": string, "category": string}."""
    return _text("Requirement: ", requirement, "\nURL: ", url, "\nTitle: ", title, "\nSnippet: ", snippet, '\nIs this page worth reading for it?\nJSON only: {"relevant": true, "reason": "...", "category": "..."}')


def content_judge(requirement: Column, title: Column, url: Column, content: Column) -> Column:
    """Reply: {"useful": bool, "category": string, "reason": string}. Only the head of the content is shown."""
    return _text("Requirement: ", requirement, "\nTitle: ", title, "\nURL: ", url, "\nText:\n", F.substring(content, 1, JUDGED), '\nCan question-answer pairs be made from it?\nJSON only: {"useful": true, "category": "...", "reason": "..."}')


def qa_pairs(title: Column, url: Column, category: Column, chunk: Column, most: int = PAIRS) -> Column:
    """Reply: {"qa_pairs": [{"question", "answer", "category", "source_title", "source_url", "evidence"}]}."""
    return _text(
        "Title: ", title, "\nURL: ", url, "\nCategory: ", category, "\nText:\n", chunk,
        f"\nWrite at most {most} question-answer pairs that the text alone answers, each with its evidence quoted from the text; none if it answers nothing."
        '\nJSON only: {"qa_pairs": [{"question": "...", "answer": "...", "category": "...", "source_title": "...", "source_url": "...", "evidence": "..."}]}',
    )
