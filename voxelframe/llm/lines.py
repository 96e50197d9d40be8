"""Line deduplication by site-relative frequency (operator 7), in DataFrame functions only.

A line is boilerplate of a site if more than a given share of the site's pages
contain it, whatever the size of the site. Counts are of pages, so a line
repeated within one page counts once; a line on one page only is repeated by no
other page and is never boilerplate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelframe.llm.common import bounded, saved

RATIO = 0.08  # share of a site's pages above which a line is dropped

#: Fixed patterns: elements whose text is no text of the page, and tags that end a line. What is never closed ends with
#: the page (a head: where the body begins), and a tag ends before the next one, so no text is scanned twice.
_SILENT = "|".join(rf"<{t}\b.*?(?:</{t}\s*>|\z)" for t in ("script", "style", "noscript", "template"))
HIDDEN = rf"(?is)<head\b.*?(?:</head\s*>|<body\b[^<>]*>|\z)|{_SILENT}|<!--.*?(?:-->|\z)"
BREAKS = r"(?i)</?(?:p|div|li|ul|ol|nav|footer|header|article|section|main|aside|h[1-6]|br|hr|tr|td|th|table|pre|form|blockquote|body|html)\b[^<>]*>"
TAG = r"<[^<>]*>"


def host_of(url: Column) -> Column:
    """Host of a URL in lower case; empty for a null or malformed one."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def html_text(html: Column) -> Column:
    """Visible text of a page, one line per block element. Entities stay as they are."""
    shown = F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, "\n")
    return F.regexp_replace(F.regexp_replace(shown, BREAKS, "\n"), TAG, "")


def _key(line: Column) -> Column:
    """A line by its hash, white space around it apart; told apart by 64 bits within one site."""
    return F.xxhash64(F.trim(line))


def site_boilerplate(pages: DataFrame, ratio: float = RATIO) -> DataFrame:
    """``(site, hashes)`` from ``(site, keys)``: per site the lines in more than ``ratio`` of its pages (and in two or more).

    Both counts are aggregated before the shuffle, so a site that holds a third
    of all pages is no task's burden. The ratio is compared as a decimal, exactly.
    """
    seen = pages.select("site", F.explode(F.array_distinct(F.array_compact("keys"))).alias("line")).groupBy("site", "line").agg(F.count("*").alias("n")).where("n > 1")
    totals = pages.groupBy("site").agg(F.count("*").alias("total"))
    share = F.lit(str(ratio)).cast("decimal(9,8)")
    return seen.join(totals, "site").where(F.col("n") > F.col("total") * share).groupBy("site").agg(F.sort_array(F.collect_list("line")).alias("hashes"))


def _member(buckets: Column, key: Column) -> Column:
    """Whether a hash is in one of the buckets that :func:`_buckets` deals hashes to."""
    return F.array_contains(F.get(buckets, F.pmod(key, F.size(buckets)).cast("int")), key)


def _buckets(hashes: Column) -> Column:
    """Hashes dealt to about as many lists as each list then holds, so that a look into one costs the root of their number."""
    n = F.greatest(F.ceil(F.sqrt(F.size(hashes))).cast("int"), F.lit(1))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda b: F.filter(hashes, lambda h: F.pmod(h, n) == b))


def drop_boilerplate(docs: DataFrame, text: Column, site: Column, ratio: float = RATIO) -> DataFrame:
    """The input with ``clean_text``, ``n_lines`` and ``n_dropped``.

    Columns ``site``, ``lines``, ``keys``, ``hashes``, ``bad`` and ``kept`` of the
    input are replaced or dropped. Blank lines are kept and not counted. A null
    text is empty; a null site is one like any other. A site's list has at most
    (lines per page / ratio) entries; all lists are broadcast while their entries
    number at most ``common.BROADCAST_ROWS``, beyond that pages are joined by site,
    a large site being split by adaptive execution. The texts are not shuffled in
    the first case.
    """
    named = docs.drop("hashes", "bad").withColumns({"site": F.coalesce(site, F.lit("")), "lines": F.split(F.coalesce(text, F.lit("")), "\n")})
    named = named.withColumn("keys", F.transform("lines", lambda x: F.when(F.trim(x) != "", _key(x))))
    boilerplate = saved(site_boilerplate(named.select("site", "keys"), ratio), "boilerplate")
    entries = boilerplate.agg(F.sum(F.size("hashes"))).first()[0] or 0
    joined = named.join(bounded(boilerplate, entries), "site", "left")
    joined = joined.withColumn("bad", F.when(F.col("hashes").isNotNull(), F.array_intersect(F.array_compact("keys"), "hashes")))
    joined = joined.withColumn("bad", F.when(F.size("bad") > 0, _buckets(F.col("bad"))))
    kept = F.filter("lines", lambda x, i: ~F.coalesce(_member(F.col("bad"), F.get("keys", i)), F.lit(False)))
    joined = joined.withColumn("kept", F.when(F.col("bad").isNull(), F.col("lines")).otherwise(kept))
    out = joined.withColumns({"clean_text": F.array_join("kept", "\n"), "n_lines": F.size(F.array_compact("keys")).cast("long"), "n_dropped": (F.size("lines") - F.size("kept")).cast("long")})
    return out.drop("lines", "keys", "kept", "hashes", "bad")


def clean_pages(pages: DataFrame) -> DataFrame:
    """``(page_id, site, n_lines, n_dropped, clean_text)`` per page of ``(page_id, url, html)``; the site is the host.

    The visible texts are worked out once and saved, since they are read twice.
    """
    text = saved(pages.select("page_id", host_of(F.col("url")).alias("host"), html_text(F.col("html")).alias("page_text")), "page_texts")
    return drop_boilerplate(text, F.col("page_text"), F.col("host")).select("page_id", "site", "n_lines", "n_dropped", "clean_text")


def _sql(pattern: str) -> str:
    return pattern.replace("'", "''")


ORACLE_SQL = rf"""with p as (select row_number() over () rid, page_id, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) site,
 string_split(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '{_sql(HIDDEN)}', chr(10), 'g'), '{_sql(BREAKS)}', chr(10), 'g'), '{TAG}', '', 'g'), chr(10)) lines from pages),
x as (select rid, site, unnest(lines) line, unnest(range(len(lines))) i from p),
c as (select site, trim(line, ' ') k, count(distinct rid) n from x where trim(line, ' ') <> '' group by all),
b as (select c.site, k from c join (select site, count(*) total from p group by 1) t on c.site = t.site where n > 1 and n > total*{RATIO}),
y as (select x.*, b.k is not null bad from x left join b on x.site = b.site and trim(x.line, ' ') = b.k),
z as (select rid, cast(count(*) filter (trim(line, ' ') <> '') as bigint) n_lines, cast(count(*) filter (bad) as bigint) n_dropped, coalesce(string_agg(line, chr(10) order by i) filter (not bad), '') t from y group by 1)
select page_id, site, n_lines, n_dropped, sha256(t) text_sha256 from p join z using (rid)"""
