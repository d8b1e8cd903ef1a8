"""Parsing stages over the tables there are; the literal formats are covered by tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import result_text, web_text
from ..sources.tables import parquet
from .base import COMBOS, query


@query("section_islands", "SELECT event_id, CAST(sum(CAST(event_type = 'signup' AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS island FROM events")
def section_islands(spark, d):
    """Sections opened by marks in each user's events."""
    return result_text.islands(parquet(spark, d, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup").select("event_id", "island")


@query("carry_forward", "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried FROM events")
def carry_forward(spark, d):
    """The last purchase so far."""
    value = F.when(F.col("event_type") == "purchase", F.col("value"))
    return result_text.carried(parquet(spark, d, "events"), ["user_id"], ["ts", "event_id"], value, "carried").select("event_id", "carried")


@query("html_extract", COMBOS.split(", combos AS")[0].rsplit(",\ncombos", 1)[0] + """ , e AS (SELECT page_id, regexp_extract_all(html, 'href="/([^"]*)"', 1) AS cells FROM pages)
SELECT page_id, class_id, coalesce(cells[class_id % 20 * 6 + class_id // 20 + 1], '') AS cell FROM e, outcomes""")
def html_extract(spark, d):
    """Cells of a page laid on the fixed order of outcomes."""
    return web_text.odds_cells(parquet(spark, d, "pages"), 'href="/([^"]*)"')


@query("html_clean", r"""SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \t\n\r\f]+', ' ', 'g'), ' ')) AS text_md5 FROM pages""")
def html_clean(spark, d):
    return parquet(spark, d, "pages").select("page_id", F.md5(F.encode(web_text.clean(F.col("html")), "UTF-8")).alias("text_md5"))


@query("entry_lines", r"""WITH t AS (SELECT l_orderkey, l_linenumber, l_suppkey, (l_linenumber - 1) % 6 + 1 AS lane, 1000 + l_suppkey % 9000 AS no, l_quantity AS q, l_tax FROM lineitem)
SELECT DISTINCT CAST(lane AS INTEGER) AS lane, CAST(no AS INTEGER) AS racer_no, 'A1' AS grade, 1 AS f_count, 0 AS l_count, CASE WHEN q + 0.25 <= 10.5 AND q + 0.25 >= 2.5 THEN q + 0.25 END AS win_rate, CASE WHEN q + 0.25 >= 10 THEN q + 0.25 END AS quinella FROM t""")
def entry_lines(spark, d):
    """Racelist lines made from orders, read back."""
    l = parquet(spark, d, "lineitem")
    line = F.concat_ws(" ", ((F.col("l_linenumber") - 1) % 6 + 1).cast("int"), (F.col("l_suppkey") % 9000 + 1000), F.lit("A1 F1 L0"), (F.col("l_quantity").cast("int")).cast("string"))
    line = F.concat(line, F.lit(".25"))
    return l.select(*web_text.entry(line)).distinct()


@query("best_table", """WITH t AS (SELECT l_orderkey AS page_id, CAST(l_suppkey % 2 AS INTEGER) AS table_no, l_linenumber AS lane, l_partkey AS racer_no FROM lineitem),
s AS (SELECT page_id, table_no, count(DISTINCT lane) AS u, count(lane) AS n, count(racer_no) AS i FROM t GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY u DESC, n DESC, i DESC, table_no) AS r FROM s)
SELECT page_id, table_no, count(*) AS n FROM t JOIN b USING (page_id, table_no) WHERE r = 1 GROUP BY ALL""".replace("count(*) AS n FROM t JOIN b USING", "count(*) AS k FROM t JOIN b USING"))
def best_table(spark, d):
    t = parquet(spark, d, "lineitem").select(F.col("l_orderkey").alias("page_id"), (F.col("l_suppkey") % 2).cast("int").alias("table_no"), F.col("l_linenumber").alias("lane"), F.col("l_partkey").alias("racer_no"))
    return web_text.best_table(t).groupBy("page_id", "table_no").agg(F.count("*").alias("k"))


@query("date_seq", "SELECT strftime(x, '%Y-%m-%d') AS day, 'k' || strftime(x, '%y%m%d') || '.lzh' AS file, 'archive/' || strftime(x, '%Y%m') || '/k' || strftime(x, '%y%m%d') AS url FROM (SELECT unnest(generate_series(DATE '2025-03-30', DATE '2025-05-02', INTERVAL 1 DAY)) AS x)")
def date_seq(spark, d):
    return web_text.archive_plan(spark, "2025-03-30", "2025-05-02", "archive/{yyyymm}/k{yymmdd}").withColumn("day", F.col("day").cast("string"))
