"""Template residue and pages that only hold an error message, filler or a demand for scripts.

No list of phrases is used: what is residue shows when the lines of many records are aligned. A
line's skeleton has its names, numbers and paths as slots. Skeletons that come again with other
values in their slots, and that hardly ever stand on a page with an article, are templates; so are
ends of lines (four words before or after whatever a slot holds) of which the same is true.

* Template pages: what is left of a page's prose without the lines of templates makes no article, and
  some line of it is one; so is a page with an article's worth of such lines. A page without an article that was sent with an error status needs no second
  record to be aligned with. Pages that mainly repeat words of their own are spam, not residue.
* Filler: pages without an article that mostly consist of words no article uses but other pages
  without an article do. Such a default text is the same words everywhere, keywords differ by page.
* Gaps: a slot that still holds its variable's name. Marks around a single word whose few values come
  again and again are those of a template language, and the words are variables' names; one mark at
  either side, with other words inside, makes a gap if such a name stands in it record after record.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry import workspace
from quarry.llm.structure import ARTICLE, analyse

#: A skeleton is a template if so many lines have it, and at most such a share of them stands on pages with an article.
TEMPLATE_LINES, BESIDE = 3, 0.1
#: Pages without an article on which a word of filler stands, share of such words, and of words of its own that a page of filler repeats.
FILLER_PAGES, FILLER_SHARE, OWN_SHARE = 3, 0.5, 0.12
#: Largest share of a page of filler that may be one and the same word.
ONE_WORD = 0.15
#: A word comes again if it stands so often on its page; share of such words on pages of keywords, and on those that may be either.
AGAIN, KEYWORD_SHARE, MAYBE_SHARE = 3, 0.5, 0.35
#: Marks are a template language's if so many gaps have them, and their names are at most such a share as different.
MARKED_GAPS, DIFFERENT = 3, 0.5
#: Share of the gaps of other marks that must hold a known name.
KNOWN_SHARE = 0.5


def _lines(pages: DataFrame, *keep: str) -> DataFrame:
    return pages.select(*keep, F.inline("forms"))


def _unsure(analysis: DataFrame) -> DataFrame:
    """page of the pages whose prose is no article without the lines that come again with other values, written."""
    claims = analysis.filter("has_article AND NOT damaged")
    alike = _lines(analysis).groupBy("form").agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))
    varied = alike.filter((F.col("n") >= TEMPLATE_LINES) & (F.col("low") < F.col("high"))).select("form")
    gone = _lines(claims, "page", "article").filter("words > 0").join(varied, "form", "left_semi").groupBy("page").agg(F.sum("words").alias("gone"), F.max("article").alias("article"))
    return workspace.written(gone.filter(F.col("article") - F.col("gone") < ARTICLE).select("page"), "unsure")


def _templates(bare: DataFrame, asked: DataFrame, sure: DataFrame) -> DataFrame:
    """key, differ of the keys asked for (page, key) of bare pages that hardly ever stand on sure ones (key), written."""
    again = asked.groupBy("key").agg(F.count("*").alias("pages"))
    lines = _lines(bare).groupBy(F.col("form").alias("key")).agg(F.count("*").alias("lines"), (F.min("key") < F.max("key")).alias("differ"))
    counted = again.join(lines, "key", "left").withColumn("n", F.greatest("pages", F.coalesce("lines", F.lit(0)))).filter(F.col("n") >= TEMPLATE_LINES)
    beside = sure.join(counted.select("key"), "key", "left_semi").groupBy("key").agg(F.count("*").alias("beside"))
    n_beside = F.coalesce("beside", F.lit(0))
    return workspace.written(counted.join(beside, "key", "left").filter(n_beside <= BESIDE * (n_beside + F.col("n"))).select("key", F.coalesce("differ", F.lit(True)).alias("differ")), "templates")


def _lost(pages: DataFrame, differing: DataFrame) -> DataFrame:
    """page, lost: words of prose in lines of templates."""
    return _lines(pages, "page").filter("words > 0").join(differing, "form", "left_semi").groupBy("page").agg(F.sum("words").alias("lost"))


def _is_demoted() -> F.Column:
    return F.col("has_article") & (F.col("article") - F.coalesce("lost", F.lit(0)) < ARTICLE)


def demoted(analysis: DataFrame) -> DataFrame:
    """page of the pages whose article is none, as it consists of the lines of templates; written."""
    unsure = _unsure(analysis)
    slim = analysis.select("page", "has_article", "damaged", "article", "forms")
    doubtful = slim.join(unsure, "page", "left_semi")
    bare = workspace.written(slim.filter("NOT has_article").unionByName(doubtful), "bare")
    keys = F.array_distinct(F.transform("forms", lambda f: f["form"]))
    wanted = _lines(bare.filter("has_article")).filter("words > 0").select(F.col("form").alias("key")).distinct()
    asked = bare.select("page", F.explode(keys).alias("key")).join(wanted, "key", "left_semi")
    sure = slim.filter("has_article").join(unsure, "page", "left_anti").select(F.explode(keys).alias("key"))
    differing = _templates(bare, asked, sure).filter("differ").select(F.col("key").alias("form"))
    claims = bare.filter("has_article")
    return workspace.written(claims.join(_lost(claims, differing), "page", "left").filter(_is_demoted()).select("page"), "demoted")


def settle(analysis: DataFrame) -> DataFrame:
    """What pages without an article are, after all pages were compared; written to the shared folder.

    page, record_seq, status, perplexity, normal, demoted, formed, filler, template, keywords, article,
    n_words, n_again; demoted are pages whose article is none.
    """
    unsure = _unsure(analysis)
    slim = analysis.drop("lines", "variables", "path")
    bare = workspace.written(slim.filter("NOT has_article").unionByName(slim.join(unsure, "page", "left_semi")), "bare")
    every = F.array_union(F.transform("forms", lambda f: f["form"]), F.col("edges"))
    asked = bare.select("page", F.explode(every).alias("key"))
    sure = analysis.filter("has_article").join(unsure, "page", "left_anti").select(F.explode(every).alias("key"))
    templates = _templates(bare, asked, sure)
    held = asked.join(templates.select("key"), "key", "left_semi").select("page").distinct().withColumn("template", F.lit(True))
    differing = templates.filter("differ").select(F.col("key").alias("form"))
    formed = _lines(bare, "page").filter("fluent > 0").join(differing, "form", "left_semi").groupBy("page").agg(F.sum("fluent").alias("formed"))
    found = bare.join(held, "page", "left").join(_lost(bare.filter("has_article"), differing), "page", "left").join(formed, "page", "left").join(filler(analysis, bare), "page", "left")
    found = found.filter(~F.col("has_article") | _is_demoted()).select(
        "page",
        "record_seq",
        "status",
        "perplexity",
        "normal",
        F.col("has_article").alias("demoted"),
        (F.coalesce("formed", F.lit(0)) >= ARTICLE).alias("formed"),
        F.coalesce("filler", F.lit(False)).alias("filler"),
        F.coalesce("template", F.lit(False)).alias("template"),
        "keywords",
        "article",
        F.aggregate("uses", F.lit(0), lambda a, u: a + u["n"]).alias("n_words"),
        F.aggregate("uses", F.lit(0), lambda a, u: a + F.when(u["n"] >= AGAIN, u["n"]).otherwise(0)).alias("n_again"),
    )
    return workspace.written(found, "settled")


def filler(analysis: DataFrame, bare: DataFrame) -> DataFrame:
    """page, filler of the pages without an article: whether ARTICLE or more words are mostly such as only such pages share."""
    uses = bare.filter("NOT has_article").select("page", F.inline("uses"))
    of_articles = analysis.filter("has_article").select(F.explode("uses.word").alias("word")).distinct()
    shared = uses.filter("small").groupBy("word").agg(F.count("*").alias("pages")).filter(F.col("pages") >= FILLER_PAGES).select("word")
    only = shared.join(of_articles, "word", "left_anti").withColumn("default", F.lit(True))
    each = uses.join(only, "word", "left").groupBy("page").agg(
        F.sum("n").alias("n"),
        F.max("n").alias("most"),
        F.sum(F.when(F.col("default"), F.col("n")).otherwise(0)).alias("n_default"),
        F.sum(F.when(F.col("default").isNull() & (F.col("n") >= AGAIN), F.col("n")).otherwise(0)).alias("own"),
    )
    return each.select("page", ((F.col("n") >= ARTICLE) & (F.col("n_default") >= FILLER_SHARE * F.col("n")) & (F.col("own") < OWN_SHARE * F.col("n")) & (F.col("most") < ONE_WORD * F.col("n"))).alias("filler"))


def _again() -> F.Column:
    return F.col("n_again") / F.greatest("n_words", F.lit(1))


def is_residue() -> F.Column:
    """Whether a settled page is residue: rows of settle()."""
    error = F.col("template") | (F.coalesce("status", F.lit(0)) >= 400)
    return F.col("demoted") | F.col("formed") | F.col("filler") | (error & (_again() < KEYWORD_SHARE))


def is_spam() -> F.Column:
    """Whether a settled page is spam: not residue, of abnormal perplexity, and words that come again."""
    return ~is_residue() & ~F.col("normal") & (_again() >= MAYBE_SHARE)


def gaps(analysis: DataFrame) -> DataFrame:
    """page of the pages with a slot that holds a variable's name."""
    found = analysis.filter("size(variables) > 0").select("page", F.inline("variables"))
    pairs = found.groupBy("wrap", "name").agg(F.count("*").alias("n"), F.max("sure").alias("sure"))
    marks = pairs.filter("sure").groupBy("wrap").agg(F.sum("n").alias("n"), F.count("*").alias("names"))
    closed = marks.filter((F.col("n") >= MARKED_GAPS) & (F.col("names") <= DIFFERENT * F.col("n"))).select("wrap")
    names = pairs.filter("sure").join(closed, "wrap", "left_semi").select("name").distinct()
    known = pairs.join(names.withColumn("known", F.lit(True)), "name", "left")
    held = known.groupBy("wrap").agg(F.max("sure").alias("sure"), F.sum("n").alias("n"), F.sum(F.when(F.col("known"), F.col("n")).otherwise(0)).alias("n_known"), F.count("known").alias("names"))
    enough = (F.col("n_known") >= KNOWN_SHARE * F.col("n")) & (F.col("sure") | ((F.col("n") >= MARKED_GAPS) & (F.col("names") >= 2)))
    good = held.filter(enough & (F.col("n_known") > 0)).select("wrap")
    return found.join(good, "wrap", "left_semi").join(names, "name", "left_semi").select("page").distinct()


def residue_pages(records: DataFrame) -> DataFrame:
    """record_seq, kind (gap, filler, error) of pages with template residue.

    A page that is filler or an error and has a gap gives two rows. Template pages are called errors,
    as their form does not tell filler from an error. A template needs TEMPLATE_LINES lines and marks
    MARKED_GAPS gaps: what comes more seldom is not found, except on pages sent with an error status.
    Null status counts as none; null or empty content gives no row. Repeated records each give their
    row; extra input columns are ignored.
    """
    analysis = analyse(records)
    with_gap = analysis.select("page", "record_seq").join(gaps(analysis), "page", "left_semi").select("record_seq", F.lit("gap").alias("kind"))
    kind = F.when(F.col("filler"), "filler").otherwise("error")
    return with_gap.unionByName(settle(analysis).filter(is_residue()).select("record_seq", kind.alias("kind")))
