"""The main content of web pages: blocks scored by their text, their links and their neighbours, as windows over rows."""

from __future__ import annotations

import html

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from stratum.sources.batches import by_row

#: Words from which a block counts as text of its own; one word in so many may be a link.
LEAST_WORDS, ONE_LINKED_IN = 10, 3
#: Elements that hold no text, that start a block, that can hold many, and that are never main content.
UNSEEN = ("script", "style", "noscript", "template", "svg")
BLOCKS = ("h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "tr", "td", "th", "dt", "dd", "pre", "blockquote", "figcaption", "body")
CONTAINERS = ("div", "section", "article", "main", "header", "ul", "ol", "dl", "table", "figure", "center")
ASIDES = ("nav", "aside", "footer", "form", "button", "select", "dialog", "menu")
#: Words in a class, id or role that mark a container as no main content.
HINTS = ("ad", "ads", "advert", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "cookie", "cookies", "footer", "menu", "nav", "navbar", "navigation", "pagination", "popup", "promo", "related", "share", "sharing", "sidebar", "social", "sponsored", "subscribe", "widget")

#: The same patterns serve the SQL that checks the query.
DROPPED = "(?is)<!--.*?(?:-->|\\z)|<head\\b.*?</head\\s*>|" + "|".join(rf"<{t}\b.*?(?:</{t}\s*>|\z)" for t in UNSEEN)
SPACES = r"(?i)<br\b[^>]*>|&nbsp;|&#160;|&#xa0;|[\x01\x02]"
TAGS = rf"(?is)<(/?(?:{'|'.join(BLOCKS + CONTAINERS + ASIDES)})\b[^>]*)>"
LINKS = r"(?is)<a\b[^>]*>(.*?)(?:</a\s*>|\z)"
HINTED = rf"""(?i)\b(?:class|id|role)\s*=\s*(?:"[^"]*\b(?:{"|".join(HINTS)})\b|'[^']*\b(?:{"|".join(HINTS)})\b|(?:{"|".join(HINTS)})\b)"""
STOPS = r"""[.!?…][)"'»”’]*$"""


def _text(inline: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(inline, r"<[^>]*>", ""), r"\s+", " "))


def _words(text: Column) -> Column:
    return F.when(text == "", 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit(" "))) + 1)


@F.arrow_udf(StringType())
def _decoded(text: pa.Array) -> pa.Array:
    """Text with its character references as characters."""
    return by_row((text,), lambda t: None if t is None else " ".join(html.unescape(t).split()), pa.string())


def segments(pages: DataFrame) -> DataFrame:
    """page_id, seg_no, tag, shut, hinted, text, n_words, n_linked over (page_id, html): a page cut at the tags that start or end a block.

    ``text`` is what follows the tag, without inline tags, in the page's own references. A ``>`` in
    an attribute ends its tag. A null page gives no rows.
    """
    marked = F.regexp_replace(F.regexp_replace(F.regexp_replace("html", DROPPED, " "), SPACES, " "), TAGS, "\x01$1\x02")
    x = pages.select("page_id", F.posexplode(F.split(F.concat(F.lit("body\x02"), marked), "\x01")).alias("seg_no", "seg"))
    head, body = F.get(F.split("seg", "\x02"), F.lit(0)), F.get(F.split("seg", "\x02"), F.lit(1))
    x = x.select("page_id", "seg_no", head.alias("head"), _text(body).alias("text"), _text(F.array_join(F.regexp_extract_all(body, F.lit(LINKS), F.lit(1)), " ")).alias("linked"))
    return x.select("page_id", "seg_no", F.lower(F.regexp_extract("head", r"^/?([A-Za-z0-9]+)", 1)).alias("tag"), F.startswith("head", F.lit("/")).alias("shut"), F.col("head").rlike(HINTED).alias("hinted"), "text", _words(F.col("text")).alias("n_words"), _words(F.col("linked")).alias("n_linked"))


def covered(parts: DataFrame) -> DataFrame:
    """Segments with ``aside``: how many open elements around them are no main content.

    Elements of a name close as they opened: at each depth of a name openings and closings
    take turns, so a closing ends what the row before it at its depth opened. One that is
    never closed lasts to the end of its page; a stray closing ends nothing.
    """
    holds, bad = F.col("tag").isin(*CONTAINERS, *ASIDES), F.col("tag").isin(*ASIDES) | F.col("hinted")
    parts = parts.repartition("page_id")  # one exchange, which all windows below share
    of = Window.partitionBy("page_id", "tag").orderBy("seg_no")
    depth = F.sum(F.when(F.col("shut"), -1).otherwise(1)).over(of)
    x = parts.withColumn("opens", (holds & ~F.col("shut") & bad).cast("int")).withColumn("depth", depth + F.when(F.col("shut"), 1).otherwise(0))
    before = F.lag("opens", 1, 0).over(Window.partitionBy("page_id", "tag", "depth").orderBy("seg_no"))
    x = x.withColumn("closes", F.when(F.col("shut"), before).otherwise(0))
    return x.withColumn("aside", F.sum(F.col("opens") - F.col("closes")).over(Window.partitionBy("page_id").orderBy("seg_no"))).drop("opens", "closes", "depth")


def judged(parts: DataFrame) -> DataFrame:
    """page_id, seg_no, tag, text, aside, stays over the segments of ``covered`` that have text.

    Long blocks of few links outside of asides are good; blocks in asides or of many links are
    bad; the rest takes after the nearest good or bad block before and after it: headings
    after the one that follows, whole sentences after either, other texts need both, or the one there is.
    """
    x = parts.where("text <> ''").withColumn("head", ~F.col("shut") & F.col("tag").rlike("^h[1-6]$"))
    bad = (F.col("aside") > 0) | (F.col("n_linked") * ONE_LINKED_IN > F.col("n_words"))
    x = x.withColumn("good", F.when(bad, False).when(~F.col("head") & (F.col("n_words") >= LEAST_WORDS), True))
    w = Window.partitionBy("page_id")
    earlier = F.last("good", True).over(w.orderBy("seg_no").rowsBetween(Window.unboundedPreceding, -1))
    later = F.last("good", True).over(w.orderBy(F.desc("seg_no")).rowsBetween(Window.unboundedPreceding, -1))
    x = x.withColumn("earlier", earlier).withColumn("later", later)
    either = F.coalesce("earlier", F.lit(False)) | F.coalesce("later", F.lit(False))
    both = F.coalesce("earlier", "later", F.lit(False)) & F.coalesce("later", "earlier", F.lit(False))
    stays = F.when(F.col("good").isNotNull(), F.col("good")).when(F.col("head"), F.coalesce("later", F.lit(False))).when(F.col("text").rlike(STOPS), either).otherwise(both)
    return x.select("page_id", "seg_no", F.when(~F.col("shut"), F.col("tag")).otherwise("p").alias("tag"), "text", "aside", stays.alias("stays"))


def main_content(pages: DataFrame) -> DataFrame:
    """page_id, block_no, block_type, section_path, text, byte_start over (page_id, html), page_id unique.

    A page of which nothing stays gives all its blocks outside of asides, and all it has if there
    are none. ``byte_start`` is the block's place in the page's texts joined by blank lines.
    """
    w = Window.partitionBy("page_id")
    x = judged(covered(segments(pages)))
    rank = F.when(F.col("stays"), 2).when(F.col("aside") <= 0, 1).otherwise(0)
    x = x.withColumn("rank", rank).withColumn("best", F.max("rank").over(w)).where("rank = best")
    x = x.withColumn("text", _decoded("text")).where("text <> ''")
    level = F.when(F.col("tag").rlike("^h[1-6]$"), F.substring("tag", 2, 1).cast("int"))
    so_far = w.orderBy("seg_no")
    at = {n: F.last(F.when(level == n, F.struct("seg_no", "text")), True).over(so_far) for n in range(1, 7)}
    x = x.select("*", *(c.alias(f"h{n}") for n, c in at.items()))
    above = {n: F.greatest(F.lit(-1), F.lit(-1), *(F.coalesce(F.col(f"h{m}.seg_no"), F.lit(-1)) for m in range(1, n))) for n in at}
    path = F.array_join(F.array_compact(F.array(*(F.when(F.col(f"h{n}.seg_no") > above[n], F.col(f"h{n}.text")) for n in at))), " > ")
    kind = F.when(level.isNotNull(), "heading").when(F.col("tag").isin("li", "dt", "dd"), "list_item").when(F.col("tag").isin("tr", "td", "th"), "table").when(F.col("tag") == "pre", "code").otherwise("paragraph")
    start = F.coalesce(F.sum(F.octet_length("text").cast("long") + 2).over(so_far.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return x.select("page_id", (F.row_number().over(so_far) - 1).alias("block_no"), kind.alias("block_type"), path.alias("section_path"), "text", start.alias("byte_start"))
