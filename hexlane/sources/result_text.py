"""Race result text to typed tables: sections, venues, dates, weather, payouts, blocks and runners.

Everything works on a table of lines (file, pos, line) with built-in functions; carried state is a running sum or the last
non-null value over a file's lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..dims import VENUES
from ..functions.scalars import narrow, start_timing

WIND = "(無風|北東|北西|南東|南西|北|東|南|西)"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, pos, line of all text files below a path, in any case of the ending."""
    whole = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.[tT][xX][tT]").text(path, wholetext=True)
    return lines_of(whole.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text")))


def lines_of(texts: DataFrame) -> DataFrame:
    """file, pos, line of rows file, text."""
    return texts.select("file", F.posexplode(F.split("text", r"\r?\n")).alias("pos", "line"))


def date_of_file(file: Column) -> Column:
    digits = F.regexp_extract(F.regexp_extract(file, r"([^/]*)$", 1), r"(\d{6})", 1)
    return F.when(digits != "", F.concat(F.lit("20"), digits))


def islands(df: DataFrame, keys: list[str], order: list[str], start: Column, out: str = "island") -> DataFrame:
    """Number of starts so far in each key's order: rows from one start to the next share it, 0 before the first."""
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(out, F.sum(F.coalesce(start.cast("int"), F.lit(0))).over(upto).cast("int"))


def carried(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    """The last non-null value up to each row."""
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(out, F.last(value, ignorenulls=True).over(upto))


def sections(lines: DataFrame) -> DataFrame:
    """Lines with their section and its venue code: NNKBGN to NNKEND, an open one to the next start or the end; a file without marks is one section."""
    mark = F.regexp_extract("line", r"^\s*(\d{2})KBGN", 1)
    end = F.col("line").rlike(r"^\s*\d{2}KEND")
    out = islands(lines, ["file"], ["pos"], mark != "", "section")
    own = Window.partitionBy("file", "section")
    out = out.withColumn("code", F.max(F.when(mark != "", mark)).over(own)).withColumn("_end", F.min(F.when(end, F.col("pos"))).over(own))
    marked = F.max("section").over(Window.partitionBy("file")) > 0
    out = out.withColumn("_marked", marked).where(~F.col("_marked") | (F.col("section") > 0))
    return out.where((mark == "") & ~end & (F.col("_end").isNull() | (F.col("pos") < F.col("_end")))).drop("_end", "_marked")


def section_heads(secs: DataFrame) -> DataFrame:
    """file, section, venue_code, venue, date, weather, wind_dir, wind_speed_mps, wave_cm."""
    at = F.row_number().over(Window.partitionBy("file", "section").orderBy("pos"))
    text = narrow(F.col("line"))
    name = F.when((F.col("_n") <= 80) & text.contains("[成績]"), F.regexp_extract(F.regexp_replace(text, r"[\s　]", ""), r"^(.*?)\[成績\]", 1))
    second = F.when((F.col("_n") <= 120) & text.contains("ボートレース"), F.regexp_extract(F.regexp_replace(text, r"[\s　]", ""), r"ボートレース(\p{L}+)", 1))
    day = F.regexp_extract(text, r"(\d{4})/\s*(\d{1,2})/\s*(\d{1,2})", 0)
    ymd = F.concat(F.regexp_extract(text, r"(\d{4})/\s*(\d{1,2})/\s*(\d{1,2})", 1), *[F.lpad(F.regexp_extract(text, r"(\d{4})/\s*(\d{1,2})/\s*(\d{1,2})", i), 2, "0") for i in (2, 3)])
    weather = text.contains("風") & text.contains("波")
    rows = secs.withColumn("_n", at)
    first = lambda value: F.min_by(value, F.when(value.isNotNull() & (value != ""), F.col("pos")))
    got = rows.groupBy("file", "section").agg(
        F.min("code").alias("code"), first(name).alias("head"), first(second).alias("other"), first(F.when((F.col("_n") <= 300) & (day != ""), ymd)).alias("date"), first(F.when(weather, text)).alias("w")
    )
    names = F.create_map(*[F.lit(x) for kv in VENUES.items() for x in kv])
    codes = F.create_map(*[F.lit(x) for k, v in VENUES.items() for x in (v, k)])
    venue = F.coalesce(F.element_at(names, F.col("code")), F.nullif("head", F.lit("")), F.nullif("other", F.lit("")), F.lit("UNKNOWN"))
    number = lambda pattern: F.nullif(F.regexp_extract("w", pattern, 1), F.lit("")).try_cast("double")
    return got.withColumn("venue", venue).select(
        "file", "section", F.coalesce("code", F.element_at(codes, F.col("venue")), F.lit("00")).alias("venue_code"), "venue",
        F.coalesce("date", date_of_file(F.col("file")), F.lit("00000000")).alias("date"),
        F.nullif(F.regexp_extract("w", r"(晴れ|晴|曇り|くもり|曇|雨|雪|霧)", 1), F.lit("")).alias("weather"),
        F.nullif(F.regexp_extract("w", rf"風\s*{WIND}", 1), F.lit("")).alias("wind_dir"),
        number(r"風[^0-9]*(\d+(?:\.\d+)?)\s*m").alias("wind_speed_mps"), number(r"波\s*(\d+(?:\.\d+)?)\s*cm").alias("wave_cm"),
    )


def payouts(secs: DataFrame, seen: Observation | None = None) -> DataFrame:
    """file, section, race_no, combo, payout from the lines `nR a-b-c payout`; the last of a race counts."""
    text = narrow(F.col("line"))
    pattern = r"^\s*(\d{1,2})R\s+([1-6])\s*-\s*([1-6])\s*-\s*([1-6])\s+([\d,]+)"
    part = lambda i: F.regexp_extract(text, pattern, i)
    rows = secs.where(text.rlike(pattern)).select("file", "section", "pos", part(1).cast("int").alias("race_no"), F.concat_ws("-", part(2), part(3), part(4)).alias("combo"), F.regexp_replace(part(5), ",", "").try_cast("long").alias("payout"))
    if seen is not None:
        rows = rows.observe(seen, F.count("*").alias("payout_lines"), F.count_if(F.size(F.array_distinct(F.split("combo", "-"))) < 3).alias("invalid_labels"))
    return rows.groupBy("file", "section", "race_no").agg(F.max_by("combo", "pos").alias("combo"), F.max_by("payout", "pos").alias("payout"))


def payout_tables(lines: DataFrame, venues: dict[str, str]) -> DataFrame:
    """date, venue, race_no, combo, payout, file from tables under [払戻金], with the venue and date of the lines before them.

    A line that says ボートレース sets the venue if it names one of `venues` (names by code), a date anywhere in a line the date;
    both hold to the end of the file only. A table is the lines after its mark while they are payouts; a line that is none but has
    an R in it is passed over, an empty line or any other ends it, and lines inside it set nothing. Tables without a venue or date
    are left out. Of a race that is there twice the last line of the last file counts.
    """
    text = narrow(F.col("line"))
    bare = F.regexp_replace(text, r"[\s　]", "")
    venue = None
    for name in venues.values():
        venue = F.when(bare.contains(name), name) if venue is None else venue.when(bare.contains(name), name)
    row = r"^\s*(\d{1,2})R\s+([1-6]-[1-6]-[1-6])\s+([\d,]+)"
    day = r"(\d{4})/\s*(\d{1,2})/\s*(\d{1,2})"
    part = lambda p, i: F.regexp_extract(text, p, i)
    out = lines.withColumn("_mark", F.col("line").contains("[払戻金]")).withColumn("_pay", text.rlike(row))
    out = out.withColumn("_ends", ~F.col("_mark") & ~F.col("_pay") & ((bare == "") | ~text.contains("R")))
    # a table is open from its mark to the first line that ends it
    out = carried(out, ["file"], ["pos"], F.when(F.col("_mark"), F.lit(True)).when(F.col("_ends"), F.lit(False)), "_in")
    inside = F.coalesce("_in", F.lit(False)) & ~F.col("_mark")
    ymd = F.when(part(day, 1) != "", F.concat(part(day, 1), F.lpad(part(day, 2), 2, "0"), F.lpad(part(day, 3), 2, "0")))
    out = carried(out, ["file"], ["pos"], F.when(~inside & F.col("line").contains("ボートレース"), venue), "venue")
    out = carried(out, ["file"], ["pos"], F.when(~inside, ymd), "date")
    rows = out.where(inside & F.col("_pay") & F.col("venue").isNotNull() & F.col("date").isNotNull())
    rows = rows.select("date", "venue", part(row, 1).cast("int").alias("race_no"), part(row, 2).alias("combo"), F.regexp_replace(part(row, 3), ",", "").try_cast("long").alias("payout"), "file", "pos")
    last = rows.groupBy("date", "venue", "race_no").agg(F.max_by(F.struct("combo", "payout", "file"), F.struct("file", "pos")).alias("x"))
    return last.select("date", "venue", "race_no", "x.*")


def race_blocks(secs: DataFrame) -> DataFrame:
    """file, section, race_no, start, stop: detail blocks at the first `nR … H…m` line of each race, up to the next block."""
    text = narrow(F.col("line"))
    race = F.regexp_extract(text, r"^\s*(\d{1,2})R\s.*H\s*\d*\s*m", 1).try_cast("int")
    starts = secs.withColumn("race_no", race).where("race_no between 1 and 12").groupBy("file", "section", "race_no").agg(F.min("pos").alias("start"))
    stop = F.lead("start").over(Window.partitionBy("file", "section").orderBy("start"))
    return starts.withColumn("stop", F.coalesce(stop, F.lit(2**31 - 1)))


RUNNER = r"^\s*([0-9A-Z][0-9A-Z ])\s+([1-6])\s+(\d{4})\s+(.*)$"


def runner_columns(line: Column) -> list[Column]:
    """finish (99 if none), lane, racer_no, motor, boat, exhibit, course, st (the exhibit time is never taken for it), st_raw."""
    line = narrow(line)
    part = lambda i: F.regexp_extract(line, RUNNER, i)
    tokens = F.split(F.trim(part(4)), r"[\s　]+")
    is_exhibit = lambda t: t.rlike(r"^\d\.\d{2}$")
    place = F.coalesce(F.array_position(F.transform(tokens, is_exhibit), True).cast("int"), F.lit(0))
    before = F.filter(F.slice(tokens, 1, F.greatest(place - 1, F.lit(0))), lambda t: t.rlike(r"^\d{1,3}$"))
    after = F.when(place > 0, F.slice(tokens, place + 1, F.size(tokens))).otherwise(tokens)
    st = F.get(F.reverse(F.filter(after, lambda t: t.rlike(r"^[FL]?\d?\.\d{2}$"))), F.lit(0))
    course = F.get(F.reverse(F.filter(after, lambda t: t.rlike(r"^[1-6]$"))), F.lit(0))
    number = lambda i: F.get(F.reverse(before), F.lit(i)).try_cast("int")
    return [
        F.coalesce(F.when(F.trim(part(1)).rlike(r"^\d+$"), F.trim(part(1)).try_cast("int")), F.lit(99)).alias("finish"),
        part(2).try_cast("int").alias("lane"), part(3).try_cast("int").alias("racer_no"), number(1).alias("motor"), number(0).alias("boat"),
        F.when(place > 0, F.get(tokens, place - 1).try_cast("double")).alias("exhibit"), course.try_cast("int").alias("course"),
        start_timing(st).alias("st"), st.alias("st_raw"),
    ]


def runners(secs: DataFrame, seen: Observation | None = None) -> DataFrame:
    """The first six runners of each block; races with fewer are left out."""
    blocks = race_blocks(secs)
    rows = secs.join(blocks, ["file", "section"]).where((F.col("pos") > F.col("start")) & (F.col("pos") < F.col("stop")) & narrow(F.col("line")).rlike(RUNNER))
    race = Window.partitionBy("file", "section", "race_no")
    rows = rows.withColumn("_k", F.row_number().over(race.orderBy("pos"))).withColumn("_n", F.count("*").over(race))
    if seen is not None:
        rows = rows.observe(seen, F.count_if(F.col("_k") == 1).alias("races"), F.count_if((F.col("_k") == 1) & (F.col("_n") < 6)).alias("short_races"))
    rows = rows.where("_n >= 6 and _k <= 6")
    return rows.select("file", "section", "race_no", *runner_columns(F.col("line")))


def counted_records(lines: DataFrame) -> tuple[DataFrame, dict[str, Observation]]:
    """race_records with counters that any action on it fills, in the same pass: an observation each of lines, races and labels.

    lines: files, lines, section marks and runner lines. races: block races with a runner, and those of them with fewer than six,
    which are left out. labels: payout lines, and those whose combo isn't three different lanes; these stay in the records.
    """
    seen = {name: Observation(name) for name in ("lines", "races", "labels")}
    # each is below an exchange that takes all rows, so that no join ends it early
    text = narrow(F.col("line"))
    lines = lines.observe(seen["lines"], F.count_if(F.col("pos") == 0).alias("files"), F.count("*").alias("lines"), F.count_if(F.col("line").rlike(r"^\s*\d{2}KBGN")).alias("section_marks"), F.count_if(text.rlike(RUNNER)).alias("runner_lines"))
    secs = sections(lines)
    out = runners(secs, seen["races"]).join(section_heads(secs), ["file", "section"])
    return out.join(payouts(secs, seen["labels"]), ["file", "section", "race_no"], "left"), seen


def race_records(lines: DataFrame) -> DataFrame:
    """All runners with their race's head and payout."""
    secs = sections(lines)
    return runners(secs).join(section_heads(secs), ["file", "section"]).join(payouts(secs), ["file", "section", "race_no"], "left")
