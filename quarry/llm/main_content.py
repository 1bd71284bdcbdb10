"""Main body of each page, by consensus of the pages of a host.

Every page scores its containers by the prose in them and votes for the generalised tag-class path
of the best one. Votes are counted per host, and the winning path cuts the main body out of each
page. Short sentences in it that the host repeats from page to page are notices, not content; what
is learnt of them on hosts with many pages (their masked form) also holds for hosts with few.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry import workspace
from quarry.llm.pages import columns, contents, page_records, text_lines
from quarry.llm.residue import demoted
from quarry.llm.structure import analyse

#: A sentence is a notice if so many pages of its host hold it, and such a share of them.
NOTICE_PAGES, NOTICE_SHARE = 8, 0.01
#: A masked sentence is a notice everywhere if so many lines have it and most of them are notices of their host.
KNOWN_LINES, KNOWN_SHARE = 10, 0.5
#: A sentence that is a notice of so many hosts is one everywhere.
KNOWN_HOSTS = 3


def winning_paths(analysis: DataFrame) -> DataFrame:
    """site, win, pages of every site of which some page has an article; a tie goes to the first path in order."""
    votes = analysis.filter("has_article AND path IS NOT NULL").groupBy("site", "path").agg(F.count("*").alias("n"), F.sum("article").alias("prose"))
    best = F.max_by("path", F.struct("n", "prose", "path"))
    return votes.groupBy("site").agg(best.alias("win"), F.sum("n").alias("pages"))


def main_lines(records: DataFrame) -> DataFrame:
    """record_seq, line_no of the main body of each page.

    Pages without prose (spam, error messages, empty or null content) give no row. Pages of a null
    site have one path in common like those of any other. A page that lacks the winning path keeps
    its own best container. Repeated records each give their rows; extra input columns are ignored.
    """
    analysis = analyse(records, with_lines=True, with_residue=False)
    analysis = analysis.drop("forms").join(demoted(analysis), "page", "left_anti")
    # written, so that its size is known: line arrays are shuffled by site only if there are too many sites to send
    wins = workspace.written(winning_paths(analysis), "wins").withColumnRenamed("site", "of_site")
    pages = analysis.filter("has_article").join(wins, F.col("site").eqNullSafe(F.col("of_site")), "left")
    at = F.coalesce(F.when(F.exists("lines", lambda x: x["path"] == F.col("win")), F.col("win")), F.col("path"), F.col("win"))
    kept = pages.withColumn("at", at).select(
        "record_seq",
        "site",
        "pages",
        F.explode(F.filter("lines", lambda x: (x["path"] == F.col("at")) | F.startswith(x["path"], F.concat(F.col("at"), F.lit("/"))))).alias("line"),
    )
    kept = kept.select("record_seq", "site", "pages", "line.*")
    plain = kept.filter("key IS NULL").select("record_seq", F.col("no").alias("line_no"))
    asked = kept.filter("key IS NOT NULL")
    held = asked.groupBy("site", "key", "template").agg(F.count("*").alias("n"), F.max("pages").alias("pages"))
    held = held.withColumn("own", (F.col("n") >= NOTICE_PAGES) & (F.col("n") >= NOTICE_SHARE * F.col("pages")))
    known = (
        held.groupBy("template")
        .agg(F.sum("n").alias("n"), F.sum(F.when(F.col("own"), F.col("n")).otherwise(0)).alias("owned"))
        .filter((F.col("n") >= KNOWN_LINES) & (F.col("owned") >= KNOWN_SHARE * F.col("n")))
        .select(F.col("template").alias("known"))
    )
    common = held.filter("own").groupBy("key").agg(F.count("*").alias("hosts")).filter(F.col("hosts") >= KNOWN_HOSTS).select(F.col("key").alias("common"))
    notices = held.filter("own").select(F.col("site").alias("of_site"), F.col("key").alias("of_key"))
    sentences = (
        asked.join(known, F.col("template") == F.col("known"), "left_anti")
        .join(common, F.col("key") == F.col("common"), "left_anti")
        .join(notices, F.col("site").eqNullSafe(F.col("of_site")) & (F.col("key") == F.col("of_key")), "left_anti")
        .select("record_seq", F.col("no").alias("line_no"))
    )
    return plain.unionByName(sentences)


def main_texts(records: DataFrame) -> DataFrame:
    """record_seq, text of the main body of each page that has one; rows of an equal record_seq must be equal."""
    kept = main_lines(records).groupBy("record_seq").agg(F.collect_set("line_no").alias("kept"))  # lines of one page
    pages = page_records(records).join(kept, "record_seq")

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for (seq, lines), content in zip(columns(batch, "record_seq", "kept"), contents(batch)):
                wanted = set(lines)
                rows.append({"record_seq": seq, "text": "\n".join(t for no, t in text_lines(content) if no in wanted)})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("record_seq", pa.int64()), ("text", pa.string())]))

    return pages.mapInArrow(part, "record_seq bigint, text string")
