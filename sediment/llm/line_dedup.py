"""Line dedup by site-relative frequency.

Pages are grouped by host. For each host and line, the pages that contain the line are divided by the host's pages;
lines above a boilerplate ratio are dropped from every page of that host, at all their places.

Texts are never shuffled: only (host, line hash) pairs are, after a count within each partition. Of a host, at most
(lines a page) / ratio lines can pass the ratio, so the table of boilerplate lines stays small beside the pages. It is
written to the shared folder, and broadcast only if it has at most ``BROADCAST_LINES`` lines, else joined by a shuffle
of hosts in which AQE splits hot ones.

Defined results:

* a line is compared without leading and trailing spaces, tabs and carriage returns; blank lines are never dropped;
* a line counts once a page, however often it stands there; in ``clean_lines``, as in its SQL, repeated rows are pages of
  their own; ``drop_boilerplate`` counts copies of a document as one page, see ``boilerplate_apart``;
* a null text stays null and counts as a page without lines; an empty one stays empty;
* null and empty hosts are one host;
* lines are told apart by 64-bit hashes;
* very long texts are read whole; an empty table gives an empty result;
* extra columns are kept by ``drop_boilerplate``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import with_text, written

RATIO = 0.03  #: a line that more than this share of a host's pages has is boilerplate
LEAST_PAGES = 5  #: and at least so many pages must have it
BROADCAST_LINES = 1_000_000  #: beyond so many boilerplate lines (16 MB or so) their table is joined by a shuffle


def _trimmed(line: Column) -> Column:
    return F.trim(line, F.lit(" \t\r"))


def _host(docs: DataFrame, host: str) -> Column:
    return F.coalesce(docs[host].cast("string"), F.lit(""))


def boilerplate(docs: DataFrame, host: str = "source", ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """``host`` and ``bad``, the hashes of its boilerplate lines; hosts without any are left out."""
    lines = F.array_distinct(F.transform(F.filter(F.transform(F.split("text", "\n"), _trimmed), lambda x: x != ""), lambda x: F.xxhash64(x)))
    pages = docs.select(_host(docs, host).alias("host"), F.col("text"))
    total = pages.groupBy("host").agg(F.count(F.lit(1)).alias("total"))
    counts = pages.select("host", F.explode(lines).alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_pages)
    return counts.join(total, "host").where(F.col("n") > F.lit(float(ratio)) * F.col("total")).groupBy("host").agg(F.array_sort(F.collect_set("line")).alias("bad"))


def boilerplate_apart(docs: DataFrame, host: str = "source", ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """The same, but only lines that stand in otherwise different pages.

    Pages with the same lines are one page. Lines that pass the ratio among those are looked at again: pages of which
    such lines are half of the characters or more, as near copies are, count as one page if their longest such line is
    the same. The ratio is then taken once more, of the pages so counted.
    """
    trimmed = F.filter(F.transform(F.split("text", "\n"), _trimmed), lambda x: x != "")
    lines = F.array_sort(F.array_distinct(F.transform(trimmed, lambda x: F.struct(F.length(x).alias("n"), F.xxhash64(x).alias("line")))))
    pages = written(docs.select(_host(docs, host).alias("host"), F.coalesce(lines, F.array().cast("array<struct<n:int,line:bigint>>")).alias("lines")).distinct(), "line-sets")

    def passing(of: DataFrame, key: list[str]) -> DataFrame:
        total = of.select("host", *key).distinct().groupBy("host") if key else of.groupBy("host")
        counts = of.select("host", *key, F.explode("lines.line").alias("line"))
        counts = (counts.distinct() if key else counts).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_pages)
        return counts.join(total.agg(F.count(F.lit(1)).alias("total")), "host").where(F.col("n") > F.lit(float(ratio)) * F.col("total")).groupBy("host").agg(F.array_sort(F.collect_set("line")).alias("bad"))

    maybe = written(passing(pages, []), "boilerplate-maybe")
    shared = F.filter("lines", lambda x: F.array_contains("bad", x["line"]))
    size = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x["n"])
    met = _joined(pages, maybe).select("host", "lines", F.coalesce(shared, F.array().cast("array<struct<n:int,line:bigint>>")).alias("shared"))
    own = size(F.col("shared")) * 2 < size(F.col("lines"))
    key = F.when(own | (F.size("shared") == 0), F.xxhash64("lines")).otherwise(F.array_max("shared")["line"])
    return passing(met.select("host", key.alias("page"), F.col("shared").alias("lines")), ["page"])


def _joined(rows: DataFrame, bad: DataFrame) -> DataFrame:
    size = bad.agg(F.coalesce(F.sum(F.size("bad")), F.lit(0)).alias("n")).first()["n"]
    return rows.join(F.broadcast(bad) if size <= BROADCAST_LINES else bad, "host", "left")


def _cleaned(docs: DataFrame, host: str, bad: DataFrame) -> DataFrame:
    """``docs`` as the struct column ``row`` and ``bad``; the struct keeps the input's names out of the way."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), _host(docs, host).alias("host"))
    return _joined(rows, written(bad, "boilerplate")).select("row", "bad")


def _kept(text: Column, bad: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(bad, F.xxhash64(_trimmed(x))))
    return F.when(bad.isNull(), text).otherwise(F.array_join(lines, "\n"))


def drop_boilerplate(docs: DataFrame, host: str = "source", ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """``docs`` with the lines of ``boilerplate_apart`` taken out of ``text``; ``n_chars`` follows the text."""
    rows = _cleaned(docs, host, boilerplate_apart(docs, host, ratio, least_pages))
    at = {c.lower(): c for c in docs.columns}["text"]
    replaced = rows.select(F.col("row").withField(at, _kept(F.col("row")[at], F.col("bad"))).alias("row")).select("row.*")
    return with_text(replaced, F.col(at))


def clean_lines(docs: DataFrame, host: str = "source", ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """``doc_id``, the text that stays, and its numbers of lines before and after: one row for each input row."""
    rows = _cleaned(docs, host, boilerplate(docs, host, ratio, least_pages))
    out = rows.select(F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("was"), _kept(F.col("row.text"), F.col("bad")).alias("text"))
    count = lambda c: F.coalesce(F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")
    return out.select("doc_id", "text", F.when(F.col("was") == "", 0).otherwise(count(F.col("was"))).cast("long").alias("n_lines"), F.when(F.col("text") == "", 0).otherwise(count(F.col("text"))).cast("long").alias("n_kept"))


def clean_sql(docs: str = "documents", ratio: float = RATIO, least_pages: int = LEAST_PAGES, columns: str = "") -> str:
    """The same in DuckDB's SQL; ``columns`` instead selects those of the document from ``d`` with the kept text as ``kept``."""
    trim = "trim(x, ' ' || chr(9) || chr(13))"
    out = columns or """d.doc_id, kept AS text,
  CASE WHEN coalesce(d.text, '') = '' THEN 0 ELSE len(string_split(d.text, chr(10))) END::BIGINT AS n_lines,
  CASE WHEN coalesce(kept, '') = '' THEN 0 ELSE len(string_split(kept, chr(10))) END::BIGINT AS n_kept"""
    return f"""
SELECT {out} FROM (SELECT d.*, CASE WHEN bad IS NULL THEN text ELSE
    coalesce(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(bad, {trim})), chr(10)), text) END AS kept
  FROM {docs} d LEFT JOIN (
    SELECT n.host, list(n.line) AS bad FROM (
      SELECT host, line, count(*) AS n FROM (
        SELECT coalesce(source, '') AS host,
          unnest(list_distinct(list_filter(list_transform(string_split(text, chr(10)), lambda x: {trim}), lambda x: x <> ''))) AS line
        FROM {docs}) GROUP BY host, line) n
    JOIN (SELECT coalesce(source, '') AS host, count(*) AS total FROM {docs} GROUP BY 1) t ON n.host = t.host
    WHERE n.n >= {least_pages} AND n.n > {float(ratio)!r}::DOUBLE * total GROUP BY n.host) b ON b.host = coalesce(d.source, '')) d"""
