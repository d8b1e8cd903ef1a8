"""Tables of pages as rows of cells on a grid, and what racelist, odds and pre-race pages say in them.

Reading the tags needs a state machine, so each page goes through the standard HTML parser in an Arrow batch (pages of plain tags
through a short one that reads the same); all that follows (which table, which row is whose, what fills what) is expressions over
the page's arrays of rows or cells. A page stays one row until its lanes are told, so it is parsed once and nothing is exchanged.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import ship
from ..dims import LANES, OUTCOMES, outcomes
from ..functions.scalars import narrow
from .web_text import clean, entry, first_by_lane

LARGEST_SPAN = 1000
CELL = "table_no int, table_id string, table_class string, body int, row int, col int, cell int, tag string, cell_class string, text string, origin boolean"
SILENT = ("script", "style")


class Grid(HTMLParser):
    """Cells (table_no, table_id, table_class, body, row, col, cell, tag, cell_class, text, origin) of a page's tables.

    Tables are numbered from 0 in the order they open; a table inside a cell has its own cells, and its text is part of the outer
    cell's too. body counts the table's row groups, 0 for rows outside of one; row and col are places on the grid, cell is the
    number of the cell in its row. A cell over several rows or columns stands at each of its places, origin at the first. Rows and
    cells that aren't closed end with the next one, or with their table.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.cells: list[tuple] = []
        self.open: list[dict] = []
        self.tables = 0
        self.silent = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = dict(attrs)
        if tag in SILENT:
            self.silent += 1
        elif tag == "table":
            self.open.append({"no": self.tables, "id": a.get("id"), "class": a.get("class"), "body": 0, "bodies": 0, "row": -1, "taken": {}, "cell": None, "number": 0})
            self.tables += 1
        elif self.open:
            t = self.open[-1]
            if tag in ("thead", "tbody", "tfoot"):
                self.end_cell(t)
                t["bodies"] += 1
                t["body"] = t["bodies"]
            elif tag == "tr":
                self.end_cell(t)
                t["row"] += 1
                t["number"] = 0
            elif tag in ("td", "th"):
                self.end_cell(t)
                if t["row"] < 0:
                    t["row"] = 0
                t["cell"] = {"tag": tag, "class": a.get("class"), "rows": span(a.get("rowspan")), "cols": span(a.get("colspan")), "text": []}
            else:
                self.handle_data(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        elif self.open:
            t = self.open[-1]
            if tag in ("td", "th"):
                self.end_cell(t)
            elif tag == "tr":
                self.end_cell(t)
            elif tag in ("thead", "tbody", "tfoot"):
                self.end_cell(t)
                t["body"] = 0
            elif tag == "table":
                self.end_cell(t)
                self.open.pop()
            else:
                self.handle_data(" ")

    def handle_data(self, data: str) -> None:
        if not self.silent:
            for t in self.open:
                if t["cell"] is not None:
                    t["cell"]["text"].append(data)

    def end_cell(self, t: dict) -> None:
        c, t["cell"] = t["cell"], None
        if c is None:
            return
        row, col, text = t["row"], 0, " ".join("".join(c["text"]).split())
        while (row, col) in t["taken"]:
            col += 1
        for r in range(row, row + c["rows"]):
            for k in range(col, col + c["cols"]):
                if (r, k) not in t["taken"]:
                    t["taken"][r, k] = True
                    self.cells.append((t["no"], t["id"], t["class"], t["body"], r, k, t["number"], c["tag"], c["class"], text, (r, k) == (row, col)))
        t["number"] += 1

    def read(self, page: str) -> list[tuple]:
        """The cells of a whole page."""
        if not UNUSUAL.search(page):
            tokens = TOKEN.findall(page)
            if sum(map(len, (t[0] for t in tokens))) == len(page):
                for whole, end, tag, attributes in tokens:
                    if not tag:
                        self.handle_data(whole)
                    elif end:
                        self.handle_endtag(tag)
                    else:
                        # a repeated attribute counts by its last value, as in the parser's list made a dict
                        self.handle_starttag(tag, [(n, v[1:-1] if v[:1] in QUOTES else v) for n, v in ATTRIBUTE.findall(attributes)] if attributes else ())
                return self.finish()
        self.feed(page)
        return self.finish()

    def finish(self) -> list[tuple]:
        self.close()
        while self.open:
            self.end_cell(self.open.pop())
        last: dict[int, int] = {}
        for c in self.cells:
            if c[10]:
                last[c[0]] = max(last.get(c[0], 0), c[4])
        return [c for c in self.cells if c[4] <= last[c[0]]]  # a span ends with its table


# pages of lower-case tags with valued attributes and text without references are read by TOKEN; UNUSUAL has all else that HTMLParser knows
NAME, VALUE = "[a-z][a-z0-9-]*", r"\"[^\"<>&]*\"|'[^'<>&]*'|[^\s\"'<>&=/`]+"
TOKEN = re.compile(rf"((?:<(/?)({NAME})((?:[ \t\n\r\f]+{NAME}=(?:{VALUE}))*)>)|[^<>&]+)")
ATTRIBUTE = re.compile(rf"({NAME})=({VALUE})")
UNUSUAL = re.compile(r"[&\x00]|<[!?]|</[^>]*\s|<(?:script|style|textarea|title|xmp|iframe|noembed|noframes|noscript|plaintext|svg|math)\b", re.I)
QUOTES = ("'", '"')


def span(value: str | None) -> int:
    return min(max(int(value), 1), LARGEST_SPAN) if value and value.strip().isdigit() else 1


FLUSH = 20_000  # cells of a batch that goes back


def parsed(pages: DataFrame, keep: tuple[str, ...], fields: str, shape: Callable[[list[tuple]], list[tuple]], html: str = "html") -> DataFrame:
    """keep and `grid`, an array of what shape makes of the cells of each page (a null page has none). Rows are as many as pages."""
    ship(pages.sparkSession)
    kinds = [f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep]
    names, types = zip(*((c.split()[0], ARROW[c.split()[1]]) for c in fields.split(", ")), strict=True)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            start, found, ends, many = 0, [], [0], 0
            for i, page in enumerate(b.column(len(keep)).to_pylist()):
                if page is not None:
                    cells = Grid().read(page)
                    many += len(cells)
                    found.extend(shape(cells))
                ends.append(len(found))
                if many >= FLUSH or i + 1 == b.num_rows:
                    columns = zip(*found, strict=True) if found else [()] * len(names)
                    items = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
                    kept = [b.column(k).slice(start, len(ends) - 1) for k in range(len(keep))]
                    yield pa.RecordBatch.from_arrays([*kept, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)], [*keep, "grid"])
                    start, found, ends, many = i + 1, [], [0], 0

    return pages.select(*keep, html).mapInArrow(task, ", ".join([*kinds, f"grid array<struct<{', '.join(c.replace(' ', ':') for c in fields.split(', '))}>>"]))


ARROW = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
ROW = "table_no int, table_id string, table_class string, body int, row int, texts array<string>, tags array<string>"


def as_rows(found: list[tuple]) -> list[tuple]:
    """Rows of a page in order of table and row: the texts and tags of their own cells; body is the last their cells are in."""
    rows: dict[tuple[int, int], list] = {}
    for no, table_id, table_class, body, row, _, _, tag, _, text, origin in found:
        if origin:
            r = rows.setdefault((no, row), [no, table_id, table_class, body, row, [], []])
            r[3] = max(r[3], body)
            r[5].append(text)
            r[6].append(tag)
    return [tuple(rows[k]) for k in sorted(rows)]


def page_rows(pages: DataFrame, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """keep and `grid`: each page's rows as as_rows gives them."""
    return parsed(pages, keep, ROW, as_rows)


def cells(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key and the cells of all tables of pages (a null page has none)."""
    return parsed(pages.where(F.col(html).isNotNull()), (key,), CELL, list, html).select(key, F.inline("grid"))


def named(**fields: Column) -> Column:
    """A struct; aliases inside of lambdas may get lost."""
    return F.named_struct(*[x for name, c in fields.items() for x in (F.lit(name), c)])


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once: a column's expression may be put into a lambda, where each element would work it out."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def has_class(column: str, name: str) -> Column:
    return F.coalesce(F.array_contains(F.split(column, r"\s+"), name), F.lit(False))


def row_texts(grid: DataFrame, key: str = "page_id") -> DataFrame:
    """key, table_no, body, row, texts (of the row's own cells, in order) and text (joined by spaces)."""
    own = grid.where("origin").groupBy(key, "table_no", "row").agg(F.max("body").alias("body"), F.array_sort(F.collect_list(F.struct("cell", "text", "tag"))).alias("c"))
    return own.select(key, "table_no", "body", "row", F.col("c.text").alias("texts"), F.col("c.tag").alias("tags"), F.array_join("c.text", " ").alias("text"))


# odds


def odds_cells(pages: DataFrame, pattern: str, mark: str) -> DataFrame:
    """page_id, class_id, cell: the pattern's matches laid on the fixed order of outcomes, and where a page has fewer than 120 of them, its cells of class `mark`.

    Missing ones are ''. The table is only read on pages that the pattern doesn't fill.
    """
    dims = outcomes(pages.sparkSession).select("class_id", "fixed_pos")  # 120 rows
    fast = pages.select("page_id", "html", F.filter(F.transform(F.regexp_extract_all("html", F.lit(pattern), F.lit(1)), clean), lambda x: x != "").alias("v"))
    both = parsed(fast.select("page_id", "v", F.when(F.size("v") < OUTCOMES, F.col("html")).alias("html")), ("page_id", "v"), CELL, list)
    marked = F.filter("grid", lambda c: c["origin"] & F.coalesce(F.array_contains(F.split(c["cell_class"], r"\s+"), mark), F.lit(False)))
    slow = F.transform(F.array_sort(F.transform(marked, lambda c: named(table_no=c["table_no"], row=c["row"], col=c["col"], text=c["text"]))), lambda x: x["text"])
    values = both.select("page_id", F.when(F.size("v") >= OUTCOMES, F.col("v")).otherwise(F.coalesce(slow, F.array().cast("array<string>"))).alias("v"))
    return values.crossJoin(F.broadcast(dims)).select("page_id", "class_id", F.coalesce(F.get("v", F.col("fixed_pos")), F.lit("")).alias("cell"))


# racelists


def preferred_table(rows: Column, table_id: str = "table2", table_class: str = "is-w495") -> Column:
    """Number of the table with the id among a page's rows; else the second of the class; else the second of all; else the only one."""
    tables = F.array_distinct(F.transform(rows, lambda r: named(no=r["table_no"], id=r["table_id"], kind=r["table_class"])))
    own = lambda t: F.coalesce(F.array_contains(F.split(t["kind"], r"\s+"), table_class), F.lit(False))
    nth = lambda found, i: F.get(found, F.lit(i))["no"]
    return bound(tables, lambda t: F.coalesce(nth(F.filter(t, lambda x: x["id"] == table_id), 0), nth(F.filter(t, own), 1), nth(t, 1), nth(t, 0)))


def preferred_tables(grid: DataFrame) -> DataFrame:
    """page_id, table_no of the preferred table of pages as cells."""
    tables = grid.groupBy("page_id").agg(F.array_sort(F.collect_set(F.struct("table_no", "table_id", "table_class"))).alias("grid"))
    return tables.select("page_id", preferred_table(F.col("grid")).alias("table_no"))


def racelist(pages: DataFrame) -> DataFrame:
    """page_id and one entry a lane of each page's preferred table: from the first row of each row group, or all rows where it has none."""
    # the rows of a group follow one another, so its first is one that the row before it isn't of
    first = lambda g: F.filter(g, lambda r, i: (r["body"] > 0) & ((i == 0) | (F.get(g, i - 1)["body"] != r["body"])))
    table = bound(preferred_table(F.col("grid")), lambda no: F.filter("grid", lambda r: r["table_no"] == no))
    heads = bound(table, lambda g: F.when(F.exists(g, lambda r: r["body"] > 0), first(g)).otherwise(g))
    found = page_rows(pages)
    rows = found.select("page_id", F.explode(heads).alias("r")).select("page_id", F.col("r.row").alias("pos"), F.array_join("r.texts", " ").alias("text"))
    return first_by_lane(rows.select("page_id", "pos", *entry(F.col("text"))).where("lane is not null")).drop("pos")


# pre-race pages


# fixed values: places of the columns in the table that says 展示, and the classes of the start display
EXHIBIT_COL, TILT_COL, PARTS_COL, LEAST_COLS = 4, 5, 7, 8
NUMBER_MARK, TIME_MARK = "boatImage1Number", "boatImage1Time"


def marked_spans(html: Column, mark: str) -> Column:
    """Texts of the spans of a class that holds mark, in page order."""
    found = F.regexp_extract_all(html, F.lit(rf'(?s)<span[^>]*class="[^"]*{mark}[^"]*"[^>]*>(.*?)</span>'), F.lit(1))
    return F.transform(found, lambda x: F.trim(narrow(clean(x))))


def prerace_lanes(pages: DataFrame) -> DataFrame:
    """page_id, lane, exhibit, tilt, parts, st, course (texts; null where the page doesn't say) of each lane of a pre-race page.

    The first table that says 展示 has a row of eight cells or more a lane; of two rows of a lane the later counts. A lane cell
    over several rows is read once. Course is the place in the start display (of pages that show six boats and six times), where
    the boats stand in that order; of a boat shown twice the last place counts. st has the 0 before its point.
    """
    shown = pages.select("page_id", "html", marked_spans(F.col("html"), NUMBER_MARK).alias("n"), marked_spans(F.col("html"), TIME_MARK).alias("t"))
    found = page_rows(shown, ("page_id", "n", "t"))
    says = F.get(F.filter("grid", lambda r: F.array_join(r["texts"], " ").contains("展示")), F.lit(0))["table_no"]
    own = lambda r: F.transform(F.filter(r["texts"], lambda x, i: F.get(r["tags"], i) == "td"), narrow)
    rows = F.filter(F.transform(bound(says, lambda no: F.filter("grid", lambda r: r["table_no"] == no)), own), lambda c: F.size(c) >= LEAST_COLS)
    text = lambda c, i: F.nullif(F.trim(F.get(c, F.lit(i))), F.lit(""))
    said = F.transform(rows, lambda c: named(lane=F.trim(F.get(c, F.lit(0))).try_cast("int"), exhibit=text(c, EXHIBIT_COL), tilt=text(c, TILT_COL), parts=text(c, PARTS_COL)))
    st = lambda x: F.when(F.startswith(x, F.lit(".")), F.concat(F.lit("0"), x)).otherwise(x)
    display = F.when((F.size("n") == 6) & (F.size("t") == 6), F.transform("n", lambda x, i: named(lane=x.try_cast("int"), st=st(F.get("t", i)), course=i + 1)))
    last = lambda rows, lane: F.get(F.reverse(F.filter(rows, lambda r: r["lane"] == lane)), F.lit(0))
    found = found.select("page_id", said.alias("said"), display.alias("display"), F.explode(F.array(*map(F.lit, LANES))).alias("lane"))
    found = found.select("page_id", "lane", last("said", F.col("lane")).alias("x"), last("display", F.col("lane")).alias("y")).where("x is not null")
    return found.select("page_id", "lane", "x.exhibit", "x.tilt", "x.parts", "y.st", "y.course")


def racelist_prerace(pages: DataFrame) -> DataFrame:
    """page_id, lane, exhibit (4.00 to 9.99) and st (0.00 to 1.99), the last of each that the rows of a lane say.

    Rows are those of the first table that speaks of 展示, of ST or スタート, and of 艇, 枠 or 進入, or all rows of all tables where
    there is none; a row is of the lane that stands alone in one of its first three cells.
    """
    grid = cells(pages)
    rows = row_texts(grid)
    said = rows.groupBy("page_id", "table_no").agg(F.array_join(F.collect_list("text"), " ").alias("all"))
    target = said.where(F.col("all").contains("展示") & F.col("all").rlike("ST|スタート") & F.col("all").rlike("艇|枠|進入")).groupBy("page_id").agg(F.min("table_no").alias("_target"))
    rows = rows.join(target, "page_id", "left").where(F.col("_target").isNull() | (F.col("table_no") == F.col("_target")))
    lane = F.get(F.filter(F.slice("texts", 1, 3), lambda x: x.rlike("^[1-6]$")), F.lit(0)).try_cast("int")
    found = lambda p: F.nullif(F.regexp_extract("text", p, 1), F.lit("")).try_cast("double")
    rows = rows.select("page_id", "table_no", "row", lane.alias("lane"), found(r"\b([4-9]\.[0-9]{2})\b").alias("exhibit"), found(r"\b([0-1]\.[0-9]{2})\b").alias("st")).where("lane is not null")
    place = F.struct("table_no", "row")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(c)
    return rows.groupBy("page_id", "lane").agg(last("exhibit"), last("st")).where("exhibit is not null or st is not null")


# fixed values: words of a replaced part, and the shapes of numbers in lines of text
PART_WORDS = "リング|キャブ|ギヤ|ピストン|シリンダ|電気|プロペラ"


def prerace_text(lines: DataFrame) -> DataFrame:
    """page_id, lane, exhibit, tilt, parts of pages as lines (page_id, pos, line), where tables are broken.

    A line that begins with a lane opens that lane (the first time only); lines up to the next lane are its own. Exhibit and tilt
    are the first pair of numbers in them, parts the first line that names one.
    """
    text = narrow(F.col("line"))
    lane = F.nullif(F.regexp_extract(text, r"^\s*([1-6])(?![0-9.])", 1), F.lit("")).try_cast("int")
    upto = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.min("pos").over(Window.partitionBy("page_id", "_at"))
    rows = lines.select("page_id", "pos", text.alias("text"), lane.alias("_at")).withColumn("_start", F.when(F.col("_at").isNotNull() & (first == F.col("pos")), F.col("_at")))
    # a repeated lane number opens nothing, but ends what was open
    mark = F.when(F.col("_start").isNotNull(), F.col("_start")).when(F.col("_at").isNotNull(), 0)
    rows = rows.withColumn("lane", F.last(mark, True).over(upto)).where("lane > 0")
    pair = r"(?<![0-9.])(\d\.\d{2})\s+(-?\d+(?:\.\d+)?)(?![0-9.])"
    has = F.col("text").rlike(pair)
    part = lambda i: F.min_by(F.regexp_extract("text", pair, i), F.when(has, F.col("pos")))
    named = F.col("text").rlike(PART_WORDS)
    words = F.min_by(F.array_join(F.regexp_extract_all("text", F.lit(f"({PART_WORDS})"), F.lit(1)), " "), F.when(named, F.col("pos")))
    return rows.groupBy("page_id", "lane").agg(part(1).alias("exhibit"), part(2).alias("tilt"), words.alias("parts"))


def with_text_fallback(rows: DataFrame, other: DataFrame) -> DataFrame:
    """All six lanes of every page of rows or other: what the tables say, else what the text says, else null."""
    pages = rows.select("page_id").union(other.select("page_id")).distinct()
    lanes = rows.sparkSession.createDataFrame([(i,) for i in LANES], "lane int")
    filled = other.select("page_id", "lane", *[F.col(c).alias(f"_{c}") for c in ("exhibit", "tilt", "parts")])
    out = pages.crossJoin(F.broadcast(lanes)).join(rows, ["page_id", "lane"], "left").join(filled, ["page_id", "lane"], "left")
    return out.select("page_id", "lane", *[F.coalesce(c, f"_{c}").alias(c) for c in ("exhibit", "tilt", "parts")], "st", "course")
