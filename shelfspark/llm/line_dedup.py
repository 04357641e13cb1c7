"""Line dedup by site-relative frequency: lines on more than a share of a host's pages are boilerplate."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import fresh, stored

#: Share of a host's pages from which a line is boilerplate, and on how many pages it must stand at least.
RATIO, LEAST_PAGES = 0.2, 3
#: Boilerplate lines of all hosts up to which they are broadcast; more are joined by host.
BROADCAST_LINES = 100_000

#: What a page's visible lines are made from, in this order: dropped elements, line breaks, other tags.
HIDDEN = r"(?is)<!--.*?-->|<head([ \t\r\n][^>]*)?>.*?</head>|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>"
BREAKS = r"(?is)</?(p|br|div|li|ul|ol|dl|dt|dd|h1|h2|h3|h4|h5|h6|article|nav|footer|header|section|main|aside|table|tr|td|th|form|pre|blockquote|body|html)([ \t\r\n/][^>]*)?>"
TAG = r"(?s)<[^>]*>"
#: Character references that are replaced, the ampersand last.
REFERENCES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))
BLANKS = r"[ \t\r\f\x{a0}]+"

#: The same languages as ``HIDDEN`` and ``BREAKS`` for the plan: one sign to look for, no step back.
_HIDDEN = r"(?i)<(?:!--[^-]*+(?:-(?!->)[^-]*+)*+-->|head(?:[ \t\r\n][^>]*+)?+>[^<]*+(?:<(?!/head>)[^<]*+)*+</head>|s(?:cript[^>]*+>[^<]*+(?:<(?!/script>)[^<]*+)*+</script>|tyle[^>]*+>[^<]*+(?:<(?!/style>)[^<]*+)*+</style>))"
_BREAKS = r"(?i)</?+(?:p(?:re)?+|d(?:iv|[ltd])|li|[uo]l|h(?:[1-6]|eader|tml)|t(?:able|[rdh])|b(?:r|ody|lockquote)|a(?:rticle|side)|nav|fo(?:oter|rm)|section|main)(?:[ \t\r\n/][^>]*+)?+>"
#: References that few pages hold: all but the last three.
_SELDOM = "&(?:nbsp|[lg]t|quot|#39);"
#: Blanks that are not one space already; texts without these signs hold none.
_WIDE, _BLANK_SIGNS = r"[ \t\r\f\x{a0}]{2,}+|[\t\r\f\x{a0}]", ("  ", "\t", "\r", "\f", "\xa0")


def host_of(url: Column) -> Column:
    """Host in lower case without user, port and ``www.``; empty for nulls and for what is no address."""
    found = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)
    return F.regexp_replace(F.regexp_replace(found, r"^.*@|:[0-9]*$", ""), r"^www\.", "")


def _single_spaced(text: Column) -> Column:
    wide = reduce(or_, [F.contains(text, F.lit(sign)) for sign in _BLANK_SIGNS])
    return F.when(wide, F.regexp_replace(text, _WIDE, " ")).otherwise(text)


def html_text(html: Column) -> Column:
    """Visible text of a page, a line for each block."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), _HIDDEN, "")
    text = F.regexp_replace(F.regexp_replace(text, _BREAKS, "\n"), TAG, "")
    replaced = lambda references: reduce(lambda t, r: F.replace(t, F.lit(r[0]), F.lit(r[1])), references, text)
    text = F.when(F.rlike(text, F.lit(_SELDOM)), replaced(REFERENCES)).otherwise(replaced(REFERENCES[-3:]))
    text = F.replace(_single_spaced(text), F.lit(" \n"), F.lit("\n"))
    return F.btrim(F.regexp_replace(text, r"\n[ \n]++", "\n"), F.lit(" \n"))


def plain(text: Column) -> Column:
    """``text`` with each line as it is compared: one space for blanks inside a line, none at its ends."""
    text = F.replace(F.replace(_single_spaced(text), F.lit(" \n"), F.lit("\n")), F.lit("\n "), F.lit("\n"))
    return F.btrim(text, F.lit(" "))


def _key(line: Column) -> Column:
    """128 bits that stand for a plain line, as text: arrays of such values are intersected by hash."""
    return F.concat(F.hex(F.xxhash64(line)), F.lit("-"), F.hex(F.xxhash64(F.lit("second half"), line)))


def boilerplate(df: DataFrame, host_col: str, text_col: str, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """host and drop (keys of its boilerplate lines), one row for each host that has any.

    A page counts a line once. Lines are counted by host and key before they are shuffled, so neither a
    large host nor a line on every page gathers in one task. A host has at most (lines of its average
    page) / ``ratio`` such lines.
    """
    pages = df.select(F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    lines = pages.select("host", F.explode(F.array_distinct(F.split(plain(F.col("text")), "\n"))).alias("line"))
    keys = lines.filter("line <> ''").select("host", _key(F.col("line")).alias("key"))
    counts = keys.groupBy("host", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_pages)
    frequent = counts.join(totals, "host").filter(F.col("n") >= F.col("pages") * ratio)
    return frequent.groupBy("host").agg(F.sort_array(F.collect_list("key")).alias("drop"))


def drop_boilerplate(df: DataFrame, host_col: str, text_col: str, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """``df`` with boilerplate lines taken out of ``text_col``, and the columns n_lines and n_dropped.

    A line is boilerplate if at least ``least_pages`` and at least the share ``ratio`` of its host's rows
    contain it. Lines are compared without blanks at their ends; those without any other character are never
    counted or dropped. Null hosts are one host, null texts are empty, repeated rows count each, texts
    keep the order of their lines, and rows stay even when no line is left. Columns of ``df`` stay: where it
    has an n_lines or n_dropped, the new one has an underscore after its name (``fresh``).
    """
    its_host, its_drop, its_plain, its_hits, its_left, n_lines, n_dropped = fresh(df, "_host", "_drop", "_plain", "_hits", "_left", "n_lines", "n_dropped")
    found = stored(boilerplate(df, host_col, text_col, ratio, least_pages)).select(F.col("host").alias(its_host), F.col("drop").alias(its_drop))
    if (found.agg(F.sum(F.size(its_drop))).first()[0] or 0) <= BROADCAST_LINES:
        found = F.broadcast(found)
    text = F.coalesce(F.col(text_col), F.lit(""))
    joined = df.join(found, F.coalesce(F.col(host_col).cast("string"), F.lit("")) == F.col(its_host), "left")
    joined = joined.withColumn(its_plain, F.split(plain(text), "\n"))
    lines, lean, drop = F.split(text, "\n"), F.col(its_plain), F.col(its_drop)
    # a host's list may be long, so a document first takes what it shares with it; then a line goes if its key is there
    keys = F.transform(lean, lambda line: F.when(line != "", _key(line)))
    joined = joined.withColumn(its_hits, F.when(drop.isNotNull(), F.array_intersect(keys, drop)))
    hits = F.col(its_hits)
    stays = lambda line, i: (F.get(lean, i) == "") | ~F.array_contains(hits, _key(F.get(lean, i)))
    out = joined.withColumn(its_left, F.when(hits.isNull() | (F.size(hits) == 0), lines).otherwise(F.filter(lines, stays)))
    out = out.withColumns({n_lines: F.size(F.array_remove(lean, "")).cast("long"), n_dropped: (F.size(lean) - F.size(its_left)).cast("long")})
    return out.withColumn(text_col, F.array_join(its_left, "\n")).drop(its_left, its_hits, its_plain, its_host, its_drop)


#: The same in DuckDB, for ``pages``: page_id, host, n_lines, n_dropped, text.
def pages_sql(ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> str:
    text = f"regexp_replace(coalesce(html, ''), '{HIDDEN}', '', 'g')"
    text = f"regexp_replace(regexp_replace({text}, '{BREAKS}', chr(10), 'g'), '{TAG}', '', 'g')"
    for name, character in REFERENCES:
        text = f"replace({text}, '{name}', '{character.replace(chr(39), chr(39) * 2)}')"
    host = r"regexp_extract(lower(coalesce(url, '')), '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1)"
    host = rf"regexp_replace(regexp_replace({host}, '^.*@|:[0-9]*$', '', 'g'), '^www\.', '')"
    return f"""
WITH p AS (SELECT row_number() OVER () AS k, page_id, {host} AS host, string_split({text}, chr(10)) AS raw FROM pages),
q AS (SELECT k, page_id, host, list_filter(list_transform(raw, lambda x: trim(regexp_replace(x, '{BLANKS}', ' ', 'g'))), lambda x: x <> '') AS lines FROM p),
l AS (SELECT k, host, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM q),
t AS (SELECT host, count(*) AS pages FROM q GROUP BY host),
f AS (SELECT host, line FROM (SELECT host, line, count(DISTINCT k) AS n FROM l GROUP BY host, line) JOIN t USING (host) WHERE n >= {least_pages} AND n >= pages * CAST({ratio} AS DOUBLE)),
d AS (SELECT l.k, count(f.line) AS n_dropped, coalesce(string_agg(CASE WHEN f.line IS NULL THEN l.line END, chr(10) ORDER BY i), '') AS text
      FROM l LEFT JOIN f ON l.host = f.host AND l.line = f.line GROUP BY l.k)
SELECT page_id, host, CAST(len(lines) AS BIGINT) AS n_lines, CAST(coalesce(n_dropped, 0) AS BIGINT) AS n_dropped, coalesce(text, '') AS text FROM q LEFT JOIN d USING (k)
"""
