"""Lines of recurring templates, found by a fixed-depth tree of token count and leading tokens.

Main path: DataFrame functions only. A line's tokens with a digit become <*>. Its leaf in the tree is its number of tokens and
its first DEPTH tokens. Within a leaf, a token at a position is constant if lines in at least SUPPORT texts have it there,
else it is generalised to <*>: that gives the line's template. A template with a constant word (a token with a letter) and no
more than LOOSE of its tokens generalised so (a number that the whole leaf has at a position is constant, whatever its value)
recurs if lines in at least SUPPORT different texts have it, and all its lines are dropped. Equal texts count once, so whole
copies do not erase each other. Counts are of (line, text) pairs, taken after equal lines are merged, so a line that a third
of all documents has is one row.

Nulls and edges: a null text has no lines; empty and blank lines are kept; an empty text has one empty line; equal rows get
equal results; a null doc_id is kept; an empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import row_id, table, written

DEPTH, SUPPORT, LOOSE = 3, 4, 0.4
BROADCAST_LEAVES = 500_000
GAP = r"[ \t\x0B\f\r]+"
LETTER = r"\p{L}"
VARIABLE = r"[^ \t\n\x0B\f\r0-9]*[0-9][^ \t\n\x0B\f\r]*"


def drop_templates(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept: texts without the lines of recurring templates."""
    docs = docs.select("doc_id", "text", row_id("doc_id", "text").alias("rk"))
    lines = docs.where("text is not null").select("rk", row_id("text").alias("th"), F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    # most lines have no digit and single spaces, and are not rewritten
    raw = F.when(F.col("raw").rlike("[0-9]"), F.regexp_replace("raw", VARIABLE, "<*>")).otherwise(F.col("raw"))
    raw = F.when(F.col("raw").rlike(r"[\t\x0B\f\r]|  "), F.regexp_replace(raw, GAP, " ")).otherwise(raw)
    lines = lines.withColumn("line", F.trim(raw)).where("line <> ''")
    tokens = F.split("line", " ")
    leaf = F.xxhash64(F.size(tokens), *[F.coalesce(F.get(tokens, F.lit(i)), F.lit("")) for i in range(DEPTH)])
    lines = lines.select("rk", "th", "pos", "line", leaf.alias("leaf"))

    leaves = lines.select("leaf", "th").distinct().groupBy("leaf").count().where(F.col("count") >= SUPPORT).select("leaf")
    leaves = written(leaves, "leaves")
    if leaves.count() <= BROADCAST_LEAVES:
        leaves = F.broadcast(leaves)
    lines = written(lines.join(leaves, "leaf", "left_semi").withColumn("lh", F.xxhash64("line")), "leaf-lines")

    merged = lines.groupBy("leaf", "lh", "th").agg(F.min("line").alias("line")).groupBy("leaf", "lh").agg(F.count("*").alias("n"), F.min("line").alias("line"))
    merged = written(merged, "merged-lines")
    at = merged.select("leaf", "lh", "n", F.posexplode(F.split("line", " ")).alias("i", "token"))
    constant = at.groupBy("leaf", "i", "token").agg(F.sum("n").alias("_n")).where(F.col("_n") >= SUPPORT).drop("_n")
    token, free = F.when(F.col("_c"), F.col("token")).otherwise("<*>"), F.col("_c").isNull()
    shaped = at.join(constant.withColumn("_c", F.lit(True)), ["leaf", "i", "token"], "left").groupBy("leaf", "lh", "n")
    shaped = shaped.agg(F.array_sort(F.collect_list(F.struct("i", token.alias("t"), free.alias("free")))).alias("_t"))
    said = F.exists("_t", lambda x: ~x["free"] & x["t"].rlike(LETTER)) & (F.size(F.filter("_t", lambda x: x["free"])) <= F.size("_t") * LOOSE)
    shaped = written(shaped.where(said).select("leaf", "lh", "n", F.array_join("_t.t", " ").alias("template")), "templates")
    recurring = shaped.groupBy("leaf", "template").agg(F.sum("n").alias("_n")).where(F.col("_n") >= SUPPORT).drop("_n")
    doomed = shaped.join(recurring, ["leaf", "template"], "left_semi").select("leaf", "lh")
    gone = lines.join(doomed, ["leaf", "lh"], "left_semi").groupBy("rk").agg(F.collect_set("pos").alias("gone"))

    every = F.split("text", "\n")
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.filter(every, lambda x, i: ~F.array_contains("gone", i)), "\n"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(every))
    return docs.join(gone, "rk", "left").select("doc_id", n_lines.cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), F.coalesce(kept, F.lit("")).alias("kept"))


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines of recurring templates."""
    return drop_templates(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


ORACLE = rf"""
WITH d AS (SELECT doc_id, text, coalesce(CAST(doc_id AS VARCHAR), '-') || ' ' || md5(coalesce(text, '-')) AS rk FROM documents),
raw AS (SELECT rk, md5(text) AS th, unnest(string_split(regexp_replace(text, '[^ \t\n\v\f\r]*[0-9][^ \t\n\v\f\r]*', '<*>', 'g'), chr(10))) AS raw,
        generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d WHERE text IS NOT NULL),
l0 AS (SELECT rk, th, pos, trim(regexp_replace(raw, '[ \t\v\f\r]+', ' ', 'g'), ' ') AS line FROM raw),
l AS MATERIALIZED (SELECT *, string_split(line, ' ') AS tk FROM l0 WHERE line <> ''),
lf AS MATERIALIZED (SELECT rk, th, pos, line, concat_ws(chr(10), len(tk), coalesce(tk[1], ''), coalesce(tk[2], ''), coalesce(tk[3], '')) AS leaf FROM l),
ok AS (SELECT leaf FROM lf GROUP BY leaf HAVING count(DISTINCT th) >= {SUPPORT}),
m AS MATERIALIZED (SELECT leaf, line, count(DISTINCT th) AS n FROM lf SEMI JOIN ok USING (leaf) GROUP BY leaf, line),
t AS MATERIALIZED (SELECT leaf, line, n, unnest(string_split(line, ' ')) AS token, generate_subscripts(string_split(line, ' '), 1) AS i FROM m),
c AS (SELECT leaf, i, token FROM t GROUP BY leaf, i, token HAVING sum(n) >= {SUPPORT}),
s AS (SELECT t.leaf, t.line, t.n, list(CASE WHEN c.token IS NULL THEN '<*>' ELSE t.token END ORDER BY t.i) AS tpl, count(*) FILTER (WHERE c.token IS NULL) AS free, bool_or(regexp_matches(coalesce(c.token, ''), '\p{{L}}')) AS said
      FROM t LEFT JOIN c ON t.leaf = c.leaf AND t.i = c.i AND t.token = c.token GROUP BY t.leaf, t.line, t.n),
s2 AS (SELECT leaf, line, n, array_to_string(tpl, ' ') AS template FROM s WHERE said AND free <= len(tpl) * {LOOSE}),
r AS (SELECT leaf, template FROM s2 GROUP BY leaf, template HAVING sum(n) >= {SUPPORT}),
dm AS (SELECT leaf, line FROM s2 SEMI JOIN r USING (leaf, template)),
g AS (SELECT rk, list(DISTINCT pos) AS gone FROM lf SEMI JOIN dm USING (leaf, line) GROUP BY rk)
SELECT doc_id, CAST(CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END AS BIGINT) AS n_lines,
  CAST(coalesce(len(gone), 0) AS BIGINT) AS n_dropped,
  sha256(coalesce(CASE WHEN gone IS NULL THEN text ELSE coalesce(array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: NOT list_contains(gone, i)), chr(10)), '') END, '')) AS kept_sha256
FROM d LEFT JOIN g USING (rk)
"""
