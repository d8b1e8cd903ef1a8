"""Pages and result text written from the races there are, and read back: the SQL has what was written."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..cluster import shared_dir
from ..dims import VENUES, outcomes
from ..sources import page_tables, result_text
from .base import COMBOS, RUNNERS, SCORED, query, races, rounded, runners, scored


def gathered(rows, html: Column, key: str = "race", order: str = "lane"):
    """key and the html of its rows, in order, joined."""
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, html.alias("h")))), lambda x: x["h"]), "").alias("rows"))


def td(value, attributes: str = "") -> Column:
    return F.concat(F.lit(f"<td{attributes}>"), value if isinstance(value, Column) else F.col(value).cast("string"), F.lit("</td>"))


def racelist_pages(spark, d):
    """A page a race: a table of a column over all lanes, a decoy for every other race, and the racelist in row groups."""
    r = runners(spark, d)
    line = F.concat(
        F.lit("<tbody><tr>"), td("lane", ' rowspan="2"'), td(F.concat((F.col("racer_no") % 9000 + 1000).cast("string"), F.lit(" <b>A1</b>"))),
        td(F.concat(F.lit("F1 L0 "), F.col("win_rate").cast("int").cast("string"), F.lit(".25"))), F.lit("</tr><tr>"), td(F.lit("x"), " colspan=2"), F.lit("</tr></tbody>"),
    )
    rows = gathered(r, line)
    decoy = F.when(F.col("race") % 2 == 0, "<table class=is-w495><tr><td>1 9999</td></tr></table>").otherwise("")
    return rows.select(F.col("race").alias("page_id"), F.concat(F.lit("<html><table><tr><th>head"), decoy, F.lit("</table><table class='a is-w495' id=table2>"), F.col("rows"), F.lit("</table>")).alias("html"))


@query("page_grid", RUNNERS + """ , l AS (SELECT race, lane, CAST(racer_no % 9000 + 1000 AS VARCHAR) || ' A1' AS name, 'F1 L0 ' || CAST(CAST(win_rate AS INTEGER) AS VARCHAR) || '.25' AS line FROM runners),
c AS (SELECT race, lane, 2 * lane - 2 AS r, 0 AS c, CAST(lane AS VARCHAR) AS text FROM l UNION ALL SELECT race, lane, 2 * lane - 1, 0, CAST(lane AS VARCHAR) FROM l UNION ALL
  SELECT race, lane, 2 * lane - 2, 1, name FROM l UNION ALL SELECT race, lane, 2 * lane - 2, 2, line FROM l UNION ALL SELECT race, lane, 2 * lane - 1, 1, 'x' FROM l UNION ALL SELECT race, lane, 2 * lane - 1, 2, 'x' FROM l)
SELECT race AS page_id, CAST(lane AS INTEGER) AS body, CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col, text FROM c""")
def page_grid(spark, d):
    """Cells of each page's racelist at all places they span."""
    grid = page_tables.cells(racelist_pages(spark, d)).where("table_id = 'table2'")
    return grid.select("page_id", "body", "row", "col", "text")


@query("racelist_rows", RUNNERS + """ SELECT race AS page_id, lane, CAST(racer_no % 9000 + 1000 AS INTEGER) AS racer_no, 'A1' AS grade, 1 AS f_count, 0 AS l_count,
CASE WHEN floor(win_rate) + 0.25 BETWEEN 2.5 AND 10.5 THEN floor(win_rate) + 0.25 END::DOUBLE AS win_rate, CASE WHEN floor(win_rate) + 0.25 BETWEEN 10 AND 100 THEN floor(win_rate) + 0.25 END::DOUBLE AS quinella FROM runners""")
def racelist_rows(spark, d):
    """Entries of the preferred table of each page."""
    return page_tables.racelist(racelist_pages(spark, d))


def prerace_pages(spark, d):
    """A pre-race page a race: exhibit, tilt and parts by lane, and the start display in the order of finish."""
    r = runners(spark, d).withColumn("exhibit", F.round("exhibit", 2).cast("string")).withColumn("time", F.concat(F.lit("."), F.lpad((F.col("motor") % 100).cast("string"), 2, "0")))
    cells = [td("lane"), td(F.lit("photo")), td(F.lit("name")), td(F.lit("52.0kg")), td("exhibit"), td(F.concat(F.lit("-0."), (F.col("boat") % 10).cast("string"))), td(F.lit("4")), td(F.when(F.col("motor") % 3 == 0, "リング×１").otherwise(""))]
    rows = gathered(r, F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")))
    spans = gathered(r, F.concat(F.lit('<span class="table1_boatImage1Number">'), F.col("lane").cast("string"), F.lit('</span><span class="table1_boatImage1Time is-x">'), "time", F.lit("</span>")), order="finish").withColumnRenamed("rows", "spans")
    return rows.join(spans, "race").select(F.col("race").alias("page_id"), F.concat(F.lit("<table><tr><th>枠</th><th>展示タイム</th></tr>"), "rows", F.lit("</table>"), "spans").alias("html"))


@query("prerace_lanes", RUNNERS + """ SELECT race AS page_id, lane, CAST(CAST(round(exhibit, 2) AS DOUBLE) AS VARCHAR) AS exhibit, '-0.' || CAST(boat % 10 AS VARCHAR) AS tilt, CASE WHEN motor % 3 = 0 THEN 'リング×1' END AS parts,
  '0.' || lpad(CAST(motor % 100 AS VARCHAR), 2, '0') AS st, finish AS course FROM runners""")
def prerace_lanes(spark, d):
    """Exhibit, tilt, parts, start timing and course of each lane of a page."""
    return page_tables.prerace_lanes(prerace_pages(spark, d))


@query("odds_cells", SCORED + """ SELECT race AS page_id, class_id, coalesce(CAST(odds AS VARCHAR), '') AS cell FROM scored""".replace("coalesce(CAST(odds AS VARCHAR), '')", "CASE WHEN odds IS NULL THEN '-' ELSE CAST(CAST(odds AS DECIMAL(10,2)) AS VARCHAR) END"))
def odds_cells(spark, d):
    """Odds of pages whose cells the pattern finds, and of pages where only their table has them."""
    s = scored(spark, d).join(F.broadcast(outcomes(spark).select("class_id", "fixed_pos")), "class_id")
    value = F.when(F.col("odds").isNull(), "-").otherwise(F.col("odds").cast("decimal(10,2)").cast("string"))
    plain = F.concat(F.lit('<td class="oddsPoint">'), value, F.lit("</td>"))
    other = F.concat(F.lit('<td class="x oddsPoint is-y"><span>'), value, F.lit("</span></td><td>no</td>"))
    pages = gathered(s, F.when(F.col("race") % 4 != 0, plain).otherwise(other), order="fixed_pos")
    pages = pages.select(F.col("race").alias("page_id"), F.concat(F.lit("<table><tr>"), "rows", F.lit("</tr></table>")).alias("html"))
    return page_tables.odds_cells(pages, '<td class="oddsPoint">(.*?)</td>', "oddsPoint")


CODES = ("15", "02", "16", "12", "24")  # 24 stands for the venue 99, which has no name
NUMBERED = COMBOS + f""" , num AS (SELECT *, CASE venue WHEN '99' THEN '24' ELSE venue END AS code, row_number() OVER (PARTITION BY date, venue ORDER BY race) AS race_no FROM races),
few AS (SELECT *, w1 || '-' || w2 || '-' || w3 AS combo, race % 900 * 10 + 100 AS payout FROM num WHERE race_no <= 12), names(code, name) AS (VALUES {', '.join(f"('{c}', '{VENUES[c]}')" for c in CODES)})"""


def numbered(spark, d):
    """The first twelve races of each day and venue, with their number."""
    df = races(spark, d).select("race", "date", "w1", "w2", "w3", F.when(F.col("venue") == "99", "24").otherwise(F.col("venue")).alias("code"))
    df = df.withColumn("race_no", F.row_number().over(Window.partitionBy("date", "code").orderBy("race"))).where("race_no <= 12")
    names = F.create_map(*[F.lit(x) for c in CODES for x in (c, VENUES[c])])
    return df.select("*", F.element_at(names, F.col("code")).alias("name"), F.concat_ws("-", "w1", "w2", "w3").alias("combo"), (F.col("race") % 900 * 10 + 100).cast("long").alias("payout"))


def slashed(date: str = "date") -> Column:
    return F.concat(F.substring(date, 1, 4), F.lit("/ "), F.substring(date, 5, 2).cast("int").cast("string"), F.lit("/ "), F.substring(date, 7, 2).cast("int").cast("string"))


def result_texts(spark, d, damaged: bool = False):
    """file, text: a result file a day, its venues as sections with head, weather, payouts and a block a race.

    damaged: one race in seven lacks its last lane, one label in eleven names a lane twice.
    """
    r = runners(spark, d).where((F.col("race") % 7 != 0) | (F.col("lane") != 6) if damaged else F.lit(True)).join(numbered(spark, d).select("race", "code", "name", "race_no", "combo", "payout"), "race")
    line = F.concat(
        F.lit("\n "), F.lpad(F.col("finish").cast("string"), 2, "0"), F.lit("  "), F.col("lane").cast("string"), F.lit(" "), (F.col("racer_no") % 9000 + 1000).cast("string"), F.lit(" name "),
        F.col("motor").cast("string"), F.lit(" "), F.col("boat").cast("string"), F.lit(" 6."), F.lpad((F.col("motor") % 100).cast("string"), 2, "0"), F.lit(" "), F.col("course").cast("string"), F.lit(" 0."), F.lpad((F.col("boat") % 100).cast("string"), 2, "0"),
    )
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("finish", line.alias("l")))), lambda x: x["l"]), "")
    per_race = r.groupBy("date", "code", "name", "race_no", "combo", "payout").agg(lines.alias("l"))
    block = F.concat(F.lit("\n\n "), F.col("race_no").cast("string"), F.lit("R  特選   H1800m  晴  風  北  3m  波  2cm"), "l")
    label = F.when(F.lit(damaged) & (F.col("payout") % 11 == 0), "1-1-2").otherwise(F.col("combo"))
    paid = F.concat(F.lit("\n "), F.col("race_no").cast("string"), F.lit("R  "), label, F.lit("  "), F.format_number("payout", 0))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("race_no", c.alias("l")))), lambda x: x["l"]), "")
    per_venue = per_race.groupBy("date", "code", "name").agg(joined(paid).alias("paid"), joined(block).alias("blocks"))
    head = F.concat(F.col("code"), F.lit("KBGN\n"), "name", F.lit("［成績］\nボートレース"), "name", F.lit("  第 1日 "), slashed(), F.lit("\n\n[払戻金]"))
    text = F.concat(head, "paid", F.lit("\n"), "blocks", F.lit("\n"), "code", F.lit("KEND\n"))
    return per_venue.groupBy("date").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("code", text.alias("t")))), lambda x: x["t"]), "").alias("text")).select(F.concat(F.lit("k"), F.substring("date", 3, 6), F.lit(".txt")).alias("file"), "text")


@query("result_records", NUMBERED + """ SELECT few.date, few.code AS venue_code, name AS venue, race_no, r.lane, r.finish, CAST(r.racer_no % 9000 + 1000 AS INTEGER) AS racer_no, r.motor, r.boat, round(6 + (r.motor % 100) / 100.0, 2)::DOUBLE AS exhibit, r.course, round((r.boat % 100) / 100.0, 2)::DOUBLE AS st,
  combo, CAST(payout AS BIGINT) AS payout, '晴' AS weather, '北' AS wind_dir, 3.0::DOUBLE AS wind_speed_mps, 2.0::DOUBLE AS wave_cm FROM few JOIN names USING (code) JOIN runners r ON r.race = few.race""")
def result_records(spark, d):
    """All runners of the result files with their race's head and payout: sections, venues, dates, weather, payouts, blocks and runner lines."""
    got = result_text.race_records(result_text.lines_of(result_texts(spark, d)))
    return rounded(got.select("date", "venue_code", "venue", "race_no", "lane", "finish", "racer_no", "motor", "boat", "exhibit", "course", "st", "combo", "payout", "weather", "wind_dir", "wind_speed_mps", "wave_cm"), 2)


@query("payout_tables", NUMBERED + """ SELECT few.date, name AS venue, CAST(race_no AS INTEGER) AS race_no, combo, CAST(payout AS BIGINT) AS payout FROM few JOIN names USING (code)""")
def payout_tables(spark, d):
    """Payouts by the venue and date carried over the lines."""
    got = result_text.payout_tables(result_text.lines_of(result_texts(spark, d)), {c: VENUES[c] for c in CODES})
    return got.select("date", "venue", "race_no", "combo", "payout")


@query("ingest_counters", NUMBERED + """ SELECT count(DISTINCT date) AS files, count(DISTINCT (date, code)) AS section_marks, CAST(sum(CASE WHEN race % 7 = 0 THEN 5 ELSE 6 END) AS BIGINT) AS runner_lines, count(*) AS races, count(*) FILTER (WHERE race % 7 = 0) AS short_races,
  count(*) AS payout_lines, count(*) FILTER (WHERE payout % 11 = 0) AS invalid_labels, CAST(sum(CASE WHEN race % 7 = 0 THEN 0 ELSE 6 END) AS BIGINT) AS records FROM few""")
def ingest_counters(spark, d):
    """What the parser counted while it wrote its records: files, sections, runner lines, races left out, labels that can't be."""
    lines = result_text.lines_of(result_texts(spark, d, damaged=True))
    records, seen = result_text.counted_records(lines)
    path = f"{shared_dir(spark)}/records-{uuid.uuid4().hex}"
    records.write.parquet(path)
    counts = {k: int(v) for o in seen.values() for k, v in o.get.items()}
    out = spark.read.schema(records.schema).parquet(path).agg(F.count("*").alias("records"))
    return out.select(*[F.lit(counts[c]).cast("long").alias(c) for c in ("files", "section_marks", "runner_lines", "races", "short_races", "payout_lines", "invalid_labels")], "records")
