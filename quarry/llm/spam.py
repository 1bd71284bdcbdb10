"""Pages of keywords, link lists and product tags.

A trigram model of function words and the classes of the words between them, trained on the sentence
lines of the whole crawl, scores every line and the page. Lines whose perplexity lies outside the
limits of prose, on either side, are keywords, and so is the text of a container (or beside
containers) that repeats its word pairs in pieces of 60 words, as stuffing with function words does.
A page is spam if no container holds a passage of normal lines, its own perplexity is abnormal too,
and its words come again, while it is no template, filler or list of gaps (see quarry.llm.residue).
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from quarry.llm.residue import gaps, is_spam, settle
from quarry.llm.structure import analyse


def spam_pages(records: DataFrame) -> DataFrame:
    """record_seq, n_keywords, n_prose, perplexity of spam pages.

    Empty pages and pages of a few words are none. Null headers, sites or content give no row.
    Repeated records each give a row; extra input columns are ignored.
    """
    analysis = analyse(records)
    found = settle(analysis).filter(is_spam()).join(gaps(analysis), "page", "left_anti")
    return found.selectExpr("record_seq", "keywords AS n_keywords", "article AS n_prose", "perplexity")
