from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from hexlane.functions import scalars
from hexlane.sources import fixed_width, result_text, web_text

TEXT = """15KBGN
丸　亀　[成績]  第1日
2025/ 3/30  丸亀
[払戻金]
  1R  1-2-3    600
  2R  ２－１－３    1,230
   1R  予選  H1800m  晴れ 風 北東 3m 波 2cm
01  1 4444 AAA BBB 23  45  6.78   1    0.12     1.49.5
02  2 4445 AAA BBB 10  11  6.80   2    0.15     1.50.1
03  3 4446 AAA BBB 12  13  6.90   3    0.20     1.51.0
04  4 4447 AAA BBB 14  15  6.91   4    0.21     1.52.0
F1  5 4448 AAA BBB 16  17  6.92   5   F0.01
K0  6 4449 AAA BBB 18  19  6.93
   2R  予選  H1800m  曇り 風 無風 0m 波 1cm
01  1 4444 AAA BBB 23  45  6.78   1    0.12
15KEND
02KBGN
戸田[成績]
  1R  3-2-1    900
"""


@pytest.fixture(scope="module")
def lines(spark):
    return result_text.lines_of(spark.createDataFrame([("/x/K250331.TXT", TEXT), ("/x/K250401.TXT", "nothing here")], "file string, text string"))


def test_sections_and_heads(lines):
    heads = {(r.file[-10:], r.section): r for r in result_text.section_heads(result_text.sections(lines)).collect()}
    first = heads["250331.TXT", 1]
    assert (first.venue_code, first.venue, first.date) == ("15", "丸亀", "20250330")
    assert (first.weather, first.wind_dir, first.wind_speed_mps, first.wave_cm) == ("晴れ", "北東", 3.0, 2.0)
    second = heads["250331.TXT", 2]
    assert (second.venue_code, second.date) == ("02", "20250331")
    bare = heads["250401.TXT", 0]
    assert (bare.venue, bare.venue_code, bare.date) == ("UNKNOWN", "00", "20250401")


def test_payouts(lines):
    got = {(r.section, r.race_no): (r.combo, r.payout) for r in result_text.payouts(result_text.sections(lines)).collect()}
    assert got == {(1, 1): ("1-2-3", 600), (1, 2): ("2-1-3", 1230), (2, 1): ("3-2-1", 900)}


def test_runners_need_six(lines):
    got = {r.lane: r for r in result_text.runners(result_text.sections(lines)).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6]
    r = got[1]
    assert (r.finish, r.racer_no, r.motor, r.boat, r.exhibit, r.course, r.st) == (1, 4444, 23, 45, 6.78, 1, 0.12)
    assert (got[5].finish, got[5].st, got[5].st_raw) == (99, -0.01, "F0.01")
    assert (got[6].finish, got[6].exhibit, got[6].st) == (99, 6.93, None)


def test_race_records(lines):
    got = result_text.race_records(lines).collect()
    assert len(got) == 6 and {r.combo for r in got} == {"1-2-3"}


def test_read_lines(spark, tmp_path):
    (tmp_path / "K250330.TXT").write_text(TEXT, encoding="utf-8")
    assert result_text.payouts(result_text.sections(result_text.read_lines(spark, str(tmp_path)))).count() == 3


@pytest.mark.parametrize(
    ("raw", "combo"), [("１－２－３", "1-2-3"), ("1=2=3", "1-2-3"), ("1 2 3", "1-2-3"), ("12", ""), ("", ""), (None, "")]
)
def test_combo_normalize(spark, raw, combo):
    assert spark.createDataFrame([(raw,)], "x string").select(scalars.combo_normalize(F.col("x"))).first()[0] == combo


@pytest.mark.parametrize(
    ("raw", "value"), [("F.05", 0.05), (".5", 0.5), ("5CM", 5.0), ("3m", 3.0), ("1,200", 1200.0), ("-", 0.0), ("nan", 0.0), ("inf", 0.0), (None, 0.0), ("12℃", 12.0), ("６．７８", 6.78)]
)
def test_safe_double(spark, raw, value):
    assert spark.createDataFrame([(raw,)], "x string").select(scalars.safe_double(F.col("x"))).first()[0] == value


def record() -> bytes:
    b = bytearray(b"0" * 198)
    b[0:4] = b"4444"
    b[4:20] = "山田　太郎".encode("shift_jis").ljust(16)
    b[20:35] = b"YAMADA".ljust(15)
    b[39:41] = b"A1"
    b[58:62], b[62:66], b[79:82] = b"0756", b"0459", b"016"
    b[82:95] = b"0120459016123"
    return bytes(b) + "香川県".encode("shift_jis")


def test_fixed_width(spark):
    df = spark.createDataFrame([(record(),), (b"short",), (b"x" * 210,)], "record binary")
    rows = fixed_width.parse_records(df).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.racer_no, r.name, r.grade, r.win_rate, r.place_rate, r.avg_st, r.birthplace) == (4444, "山田　太郎", "A1", 7.56, 45.9, 0.16, "香川県")
    assert (r.course1_entry_count, r.course1_place_rate, r.course1_avg_st, r.course1_avg_st_rank) == (12, 45.9, 0.16, 1.23)


def test_read_racers(spark, tmp_path):
    (tmp_path / "racers").write_bytes(record() + b"\r\n" + record() + b"\n")
    assert fixed_width.read_racers(spark, str(tmp_path)).count() == 1


def test_odds_cells_run_out(spark):
    df = spark.createDataFrame([(1, "<td>1.5</td><td>2.5</td>"), (2, None)], "page_id long, html string")
    got = {(r.page_id, r.class_id): r.cell for r in web_text.odds_cells(df, r"<td>([\d.]+)</td>").collect()}
    assert len(got) == 240 and got[1, 0] == "1.5" and got[1, 20] == "2.5" and got[1, 1] == "" and got[2, 0] == ""


def test_entry_and_prerace(spark):
    df = spark.createDataFrame([("1 4444 A1 山田 F1 L0 0.15 7.56 45.90", "天候 晴れ 風向 北東 風速 3m 波高 2cm")], "a string, b string")
    r = df.select(*web_text.entry(F.col("a")), *web_text.prerace(F.col("b"))).first()
    assert (r.lane, r.racer_no, r.grade, r.f_count, r.win_rate, r.quinella) == (1, 4444, "A1", 1, 7.56, 45.9)
    assert (r.weather, r.wind_dir, r.wind_speed, r.wave) == ("晴れ", "北東", 3.0, 2.0)
