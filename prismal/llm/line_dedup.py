"""Line dedup by each line's share of its site's pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, hot_keys, materialize, salted_join

#: A line goes if it is on more than this share of its host's pages, and on this many at least, which only leaves out chance repeats of small hosts.
RATIO, MIN_PAGES = 0.05, 3
#: Largest table of boilerplate that is broadcast, by its measured number of lines.
BROADCAST_LINES = 500_000


def host_of(url: Column) -> Column:
    """The host that a URL names, in lower case; null for what isn't one."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def _lines(text: str):
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def boilerplate_lines(docs: DataFrame, host: str, text: str, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, line hashes) of hosts that have boilerplate. A line counts once a page; lines without a word don't count.

    Sums are partial before they shuffle, so a host with a third of all pages, or a line on all of them, is one
    row a task. A host has at most lines-a-page / ratio lines above the ratio, so its array is of bounded size.
    """
    docs = docs.select(F.col(host).alias("host"), F.col(text).alias("text")).filter("host is not null")
    found = F.array_distinct(F.transform(F.filter(_lines("text"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: F.xxhash64(x)))
    seen = docs.select("host", F.explode(found).alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    seen = materialize(seen.filter(F.col("n") >= min_pages), "lines")
    pages = materialize(docs.groupBy("host").agg(F.count(F.lit(1)).alias("pages")), "pages")
    often = seen.join(pages, "host").filter(F.col("n") > F.lit(ratio) * F.col("pages"))
    return often.groupBy("host").agg(F.collect_list("line").alias("boilerplate"))


def drop_boilerplate(docs: DataFrame, host: str = "source", doc_id: str = "doc_id", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """docs with boilerplate lines taken out of the text; adds n_lines and n_dropped.

    A line is what stands between newlines, compared as it is. Rows without a host, hosts with fewer than
    min_pages pages, and lines without a word stay as they are; a null text stays null and counts as one empty
    line. A page all of whose lines go keeps its row, with an empty text. Repeated rows each count as a page. An empty
    table gives an empty one. Other columns are carried along under whatever name; those that have the names of those
    added are replaced.

    Rows aren't shuffled where the table of boilerplate, whose size is counted first, is small enough to be
    broadcast; else they are joined by host, hot hosts being salted.
    """
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    with Scratch():
        found = materialize(boilerplate_lines(docs, host, text, ratio, min_pages), "boilerplate", keep=True)
    size = found.agg(F.coalesce(F.sum(F.size("boilerplate") + 4), F.lit(0)).alias("n")).first()["n"]
    # The caller's columns travel in one, so that no name of theirs clashes.
    rows = docs.select(F.struct(*kept).alias("row"), F.col(host).alias("host"), F.col(doc_id).alias("id"))
    if size <= BROADCAST_LINES:
        rows = rows.join(F.broadcast(found), "host", "left")
    else:
        # A null host matches nothing; its rows are spread. The rows are written, as they are read for the hot hosts too.
        rows = rows.withColumn("host", F.coalesce("host", F.concat(F.lit("\0"), F.xxhash64("id").cast("string"))))
        counts = rows.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
        hot = hot_keys(counts, "host", "n", docs.count())
        rows = salted_join(rows, found, "host", "id", rows.sparkSession.createDataFrame(hot.collect(), hot.schema), "left")
    rows = rows.select("row", F.col(f"row.`{text}`").alias("text"), F.split(F.coalesce(F.col(f"row.`{text}`"), F.lit("")), "\n", -1).alias("lines"), "boilerplate")
    # The page's own boilerplate is a short list, met by hash.
    own = F.coalesce(F.array_intersect(F.transform("lines", lambda x: F.xxhash64(x)), "boilerplate"), F.array().cast("array<bigint>"))
    rows = rows.withColumn("gone", own)
    left = F.when(F.size("gone") == 0, F.col("lines")).otherwise(F.filter("lines", lambda x: ~(x.rlike(r"[^\x20\x09-\x0D]") & F.array_contains("gone", F.xxhash64(x)))))
    rows = rows.withColumn("left", left)
    n_dropped = (F.size("lines") - F.size("left")).cast("long")
    rows = rows.withColumn("text", F.when(n_dropped == 0, F.col("text")).otherwise(F.array_join("left", "\n")))
    columns = [F.col("text").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in kept]
    return rows.select(*columns, F.size("lines").cast("long").alias("n_lines"), n_dropped.alias("n_dropped"))


ORACLE_SQL = f"""
WITH lines AS (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
pages AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
often AS (
  SELECT l.source, line FROM (SELECT DISTINCT doc_id, source, line FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')) l JOIN pages USING (source)
  GROUP BY l.source, line, pages HAVING count(*) >= {MIN_PAGES} AND count(*) > {RATIO}::DOUBLE * pages),
marked AS (SELECT l.doc_id, l.pos, l.line, o.line IS NOT NULL AS gone FROM lines l LEFT JOIN often o ON l.source = o.source AND l.line = o.line)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS text_sha256
FROM marked GROUP BY doc_id
"""
