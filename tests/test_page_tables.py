"""Tables of pages, racelists, odds and pre-race pages, and the carried payout tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from hexlane.sources import page_tables as pt
from hexlane.sources import result_text


def pages(spark, *html):
    return spark.createDataFrame([(i, h, "x") for i, h in enumerate(html)], "page_id long, html string, text string")


def grid(html):
    g = pt.Grid()
    g.feed(html)
    return {(c[0], c[4], c[5]): c[9] for c in g.finish()}


def test_spans_fill_the_grid():
    got = grid("<table><tr><th rowspan=2>a</th><td colspan='2'>b</td></tr><tr><td>c</td><td rowspan='9'>d</td></tr><tr><td>e<td>f</table>")
    assert got == {(0, 0, 0): "a", (0, 0, 1): "b", (0, 0, 2): "b", (0, 1, 0): "a", (0, 1, 1): "c", (0, 1, 2): "d", (0, 2, 0): "e", (0, 2, 1): "f", (0, 2, 2): "d"}


def test_nested_broken_and_odd_tables():
    got = grid("<table><tr><td>x <table><tr><td>in</td></tr></table> y</td><td>z</td></tr></table>")
    assert got[0, 0, 0].split() == ["x", "in", "y"] and got[1, 0, 0] == "in" and got[0, 0, 1] == "z"
    assert grid("no table <td>x</td> </table>") == {} and grid("") == {}
    assert grid("<table><td>no row") == {(0, 0, 0): "no row"}
    assert grid("<table><tr><td colspan=x rowspan=-1>a<br>b<script>var s='<td>';</script></td></tr></table>") == {(0, 0, 0): "a b"}
    assert len(grid("<table><tr><td colspan=99999>a</td></tr></table>")) == pt.LARGEST_SPAN


def test_cells_of_many_pages(spark):
    df = pages(spark, "<table id=t class='a b'><tbody><tr><td class='c d'>1</td></tr></tbody><tbody><tr><td>2</td></tr></tbody></table>", None, "", "<p>x</p>").repartition(2)
    got = {(r.page_id, r.table_no, r.table_id, r.table_class, r.body, r.row, r.col, r.cell_class, r.text) for r in pt.cells(df).collect()}
    assert got == {(0, 0, "t", "a b", 1, 0, 0, "c d", "1"), (0, 0, "t", "a b", 2, 1, 0, None, "2")}


def test_preferred_table(spark):
    t = lambda a, x="1 1234": f"<table {a}><tr><td>{x}</td></tr></table>"
    df = pages(
        spark, t("") + t("") + t("id=table2"), t("") + t("class='q is-w495'") + t("class=is-w495"), t("class=is-w495") + t("", "no"), t("", "only"), t("class=is-w495") + t("") + t("")
    )
    assert {r.page_id: r.table_no for r in pt.preferred_tables(pt.cells(df)).collect()} == {0: 2, 1: 2, 2: 1, 3: 0, 4: 1}


def test_racelist_takes_the_first_row_of_a_group(spark):
    line = lambda lane, no: f"<tr><td rowspan=2>{lane}</td><td>{no} A1</td><td>F1 L0 5.50 40.20</td></tr>"
    grouped = "<table id=table2>" + "".join(f"<tbody>{line(i, 4000 + i)}<tr><td>{i} 9999 B1</td></tr></tbody>" for i in range(1, 7)) + f"<tbody>{line(1, 5555)}</tbody></table>"
    plain = "<table><tr><td>head</td></tr>" + "".join(line(i, 4100 + i) for i in range(1, 4)) + line(1, 7777) + "</table>"
    got = {(r.page_id, r.lane): (r.racer_no, r.grade, r.f_count, r.win_rate, r.quinella) for r in pt.racelist(pages(spark, grouped, plain)).collect()}
    assert got[0, 1] == (4001, "A1", 1, 5.5, 40.2) and len(got) == 9 and got[1, 1][0] == 4101 and got[0, 6][0] == 4006


def test_odds_fall_back_to_the_cells(spark):
    fast = "".join(f'<td class="oddsPoint">{i}.5</td>' for i in range(120))
    slow = "<table>" + "".join("<tr>" + "".join(f'<td class="x oddsPoint is-y"><span>{r * 12 + c}.5</span></td><td>no</td>' for c in range(12)) + "</tr>" for r in range(9)) + "</table>"
    got = {(r.page_id, r.class_id): r.cell for r in pt.odds_cells(pages(spark, fast, slow, "nothing"), '<td class="oddsPoint">(.*?)</td>', "oddsPoint").collect()}
    at = lambda i: i % 20 * 6 + i // 20
    assert len(got) == 360 and all(got[0, i] == f"{at(i)}.5" and got[1, i] == (f"{at(i)}.5" if at(i) < 108 else "") and got[2, i] == "" for i in range(120))


def before(rows, spans=""):
    return "<table><tr><td>別</td></tr></table><table><tr><th>展示</th></tr>" + "".join("<tr>" + "".join(f"<td>{x}</td>" for x in r) + "</tr>" for r in rows) + "</table>" + spans


def show(order, times):
    return "".join(f'<span class="table1_boatImage1Number is-type{n}">{n}</span><span class="table1_boatImage1Time">{t}</span>' for n, t in zip(order, times, strict=True))


def test_prerace_lanes(spark):
    row = lambda lane, e, tilt, part: [lane, "p", "n", "52.0", e, tilt, "x", part]
    one = before([row(1, "6.80", "-0.5", ""), row("２", "6.9", "0.0", "リング×１"), ["short", "row"], row("a", "1", "1", "1"), row(1, "6.81", "0.5", "")], show([2, 1, 3, 4, 5, 6], [".12", "F.01", "0.10", ".2", ".3", ".4"]))
    two = before([row(3, "", "1.0", "")], show([1, 2, 3], [".1", ".2", ".3"]))
    got = {(r.page_id, r.lane): tuple(r)[2:] for r in pt.prerace_lanes(pages(spark, one, two, "<p>")).collect()}
    assert got == {(0, 1): ("6.81", "0.5", None, "F.01", 2), (0, 2): ("6.9", "0.0", "リング×1", "0.12", 1), (1, 3): (None, "1.0", None, None, None)}


def test_racelist_prerace(spark):
    table = "<table><tr><td>9</td><td>1 1 1 6.00</td></tr></table><table><tr><th>枠</th><th>展示タイム</th><th>ST</th></tr><tr><td>1</td><td>6.83</td><td>0.18</td></tr><tr><td>x</td><td>2</td><td>6.90 and 7.00</td></tr><tr><td>1</td><td>none</td><td>0.21</td></tr><tr><td>a</td><td>b</td><td>c</td><td>3</td><td>6.5</td></tr></table>"
    loose = "<table><tr><td>4</td><td>16.83 5.55</td></tr></table>"
    got = {(r.page_id, r.lane): (r.exhibit, r.st) for r in pt.racelist_prerace(pages(spark, table, loose)).collect()}
    assert got == {(0, 1): (6.83, 0.21), (0, 2): (6.9, None), (1, 4): (5.55, None)}


def test_prerace_text_carries_the_lane(spark):
    lines = ["head 6.11 0.5", "1 name", "52.0kg", "6.80  -0.5", "プロペラ", "２ 6.91 0.0", "ピストン×2 リング", "1 again 9.99 1.0", "3", "", "x 6.70 1.5 キャブ", "4.5 not a lane"]
    df = spark.createDataFrame([(7, i, x) for i, x in enumerate(lines)], "page_id long, pos int, line string")
    got = {r.lane: tuple(r)[2:] for r in pt.prerace_text(df).collect()}
    assert got == {1: ("6.80", "-0.5", "プロペラ"), 2: ("6.91", "0.0", "ピストン リング"), 3: ("6.70", "1.5", "キャブ")}
    table = spark.createDataFrame([(7, 1, None, "0.5", None, "0.10", 2)], "page_id long, lane int, exhibit string, tilt string, parts string, st string, course int")
    both = {r.lane: tuple(r)[2:] for r in pt.with_text_fallback(table, pt.prerace_text(df)).collect()}
    assert len(both) == 6 and both[1] == ("6.80", "0.5", "プロペラ", "0.10", 2) and both[3][0] == "6.70" and both[6] == (None,) * 5


def test_payout_tables_carry_venue_and_date(spark):
    a = """[払戻金]
 1R  1-2-3  100
ボートレース丸　亀 2025/ 3/30
[払戻金]
ボートレース戸田 1R
 1R  1-2-3  1,230
  12R 6-5-4 50 R
 R passed over 2026/1/1
 2R  2-1-3  999
end of it 2025/04/01
 3R  1-2-3  7
ボートレース児島
[払戻金]
 3R  3-1-2  77

 4R  1-2-3  7"""
    b = " 9R 1-2-3 5\n[払戻金]\n 1R 1-2-3 5\n\n2025/3/30 ボートレース丸亀\n[払戻金]\n 1R  4-5-6  40\n 1R  4-5-6  41"
    df = result_text.lines_of(spark.createDataFrame([("a.txt", a), ("b.txt", b)], "file string, text string"))
    got = {tuple(r) for r in result_text.payout_tables(df, {"15": "丸亀", "16": "児島"}).collect()}
    assert got == {("20250330", "丸亀", 1, "4-5-6", 41, "b.txt"), ("20250330", "丸亀", 12, "6-5-4", 50, "a.txt"), ("20250330", "丸亀", 2, "2-1-3", 999, "a.txt"), ("20250401", "児島", 3, "3-1-2", 77, "a.txt")}
    assert result_text.payout_tables(df.where(F.lit(False)), {"15": "丸亀"}).count() == 0


def test_short_reader_reads_as_the_parser():
    """Pages of plain tags go through TOKEN; what it finds is what the parser finds."""
    plain = [
        "<table class=is-w495 id='t'><tr><th rowspan=\"2\">a <b>b</b></th><td colspan=2>c</td></tr><tr><td>d<br>e<td>f</tr></table>x",
        "<tr><td>out</td></tr><table><td>1<table id=in><tr><td>2</td></tr></table>3</td><tbody><tr><td>4</tbody></table>",
        "<table id=a id=b><tr><td class='x y' rowspan=3>1</td></tr><tr><td>  2\n 3</td></tr></table>",
    ]
    odd = ["<TABLE><TR><TD>1 &amp; 2</TABLE>", "<table><tr><td nowrap>1<!-- <td> --></td></table>", "<table><tr><td>1 > 0</td><script>'<td>'</script></table>", "<table><tr><td>a<br/>b</td><td", ""]
    for page in plain + odd:
        slow = pt.Grid()
        slow.feed(page)
        assert pt.Grid().read(page) == slow.finish()
    assert all(not pt.UNUSUAL.search(p) and "".join(t[0] for t in pt.TOKEN.findall(p)) == p for p in plain)


def test_pages_are_parsed_once(spark):
    """One Python step and no aggregation between the pages and their lanes; before, each parsed its pages two or three times."""
    df = spark.createDataFrame([(i, "<table><tr><td>1 1234 A1</td></tr></table>") for i in range(300)], "page_id long, html string")
    for got in (pt.racelist(df), pt.prerace_lanes(df), pt.odds_cells(df, "<td class=x>(.*?)</td>", "x"), pt.cells(df)):
        plan = got._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("MapInArrow") == 1
        assert "Aggregate" not in plan
    assert pt.cells(df).count() == 300
