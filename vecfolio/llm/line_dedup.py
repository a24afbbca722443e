"""Line dedup by content-defined chunks, in DataFrame operations only.

Lines are what newlines part; blank lines take no part and follow the line
before them. A line is repeated if its bytes occur more than once in the corpus
(its hash finds the bucket, the bytes decide). Consecutive repeated lines make
a run. Within a run a rolling hash over the last two line hashes ends a chunk
where it falls under a bound, and a line of ``long_line`` words is a chunk of
its own; chunk ends depend on content only, so shifted passages are cut alike
from the first end inside on. A chunk also ends between two lines that follow
each other only once in the corpus, so that a line beside a passage that is
repeated elsewhere doesn't join the passage's first or last chunk (``edges``).
Chunks of runs of two lines or of ``long_line`` words that occur again are
removed everywhere but at the first place by (doc_id, row hash, line).

Defined results: a null text stays null; an empty one stays empty; a document
all of whose lines go is kept with an empty text; a passage repeated within one
document counts as repeated; rows equal in all columns are one document and all
show the same result; other columns are carried; no rows give no rows. Lines of
different bytes but one hash are left alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, materialise, packed, table, unpacked

LONG_LINE = 50
#: The rolling hash ends a chunk if its first hex digit is below this.
BOUND = "8"


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, row_hash, line_no, pos, upto, line): lines that aren't blank.

    ``line_no`` counts them, ``pos`` counts all lines, ``upto`` is where the
    next one that isn't blank is.
    """
    split = docs.select("doc_id", "row_hash", F.split("text", "\n", -1).alias("all")).withColumn(
        "some", F.expr(r"filter(transform(all, (l, i) -> struct(i as pos, l as line)), x -> x.line rlike '[^\\x20\\x09-\\x0D]')")
    )
    return split.select(
        "doc_id", "row_hash", F.size("all").alias("n"), F.posexplode(F.expr(
            "transform(some, (x, i) -> struct(x.pos as pos, get(some, i + 1).pos as upto, x.line as line))"
        )).alias("line_no", "x")
    ).select("doc_id", "row_hash", "line_no", "x.pos", F.coalesce("x.upto", "n").alias("upto"), "x.line")


def removed_lines(docs: DataFrame, long_line: int = LONG_LINE, edges: bool = True) -> DataFrame:
    """(doc_id, row_hash, removed, n_removed): places of the lines to remove.

    With ``edges`` a chunk also ends between two lines that follow each other
    only once in the corpus, and between equal lines; the rolling hash begins anew.
    """
    # hashes travel as 16 bytes
    h = F.unhex(F.md5("line"))
    each = lines(docs)
    bytes_equal = each.groupBy("line").agg(F.count(F.lit(1)).alias("n")).withColumn("h", h)
    repeated = bytes_equal.groupBy("h").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("variants")).filter(
        "n > 1 and variants = 1"
    )
    narrow = each.select("doc_id", "row_hash", "line_no", "pos", "upto", h.alias("h"), F.regexp_count("line", F.lit(WORD)).alias("words"))
    # a table of its own, so that the join reads two shuffles and a hot line's rows can be dealt to several tasks
    found = narrow.join(materialise(repeated.select("h")), "h", "left_semi")
    doc = ["doc_id", "row_hash"]
    # dealt by document from here on; else the sum below would stay with the join's lines and keep a hot one whole
    found = found.repartition(*doc)
    # equal rows are one document
    found = found.groupBy(*doc, "line_no", "pos", "upto", "h", "words").agg(F.count(F.lit(1)).alias("copies"))
    in_doc = Window.partitionBy(*doc).orderBy("line_no")
    found = found.withColumn("starts_run", F.coalesce(F.col("line_no") - F.lag("line_no").over(in_doc) != 1, F.lit(True)))
    found = found.withColumn("edge", F.col("starts_run"))
    if edges:
        found = materialise(found.withColumn("before", F.when(~F.col("starts_run"), F.lag("h").over(in_doc))))
        pairs = found.filter("before <> h").groupBy("before", "h").agg(F.count(F.lit(1)).alias("n"))
        # a chunk with a pair that occurs once can't occur again
        often = materialise(pairs.filter("n > 1").select("before", "h", F.lit(False).alias("parted")))
        found = found.join(often, ["before", "h"], "left")
        found = found.withColumn("edge", F.coalesce("parted", F.lit(True)))
    before = F.when(F.col("edge"), F.lit("")).otherwise(F.lower(F.hex(F.lag("h").over(in_doc))))
    rolling = F.md5(F.concat(before, F.lower(F.hex("h"))))
    found = found.withColumn("ends", (F.substring(rolling, 1, 1) < BOUND) | (F.col("words") >= long_line))
    starts = F.col("edge") | F.lag("ends").over(in_doc) | (F.col("words") >= long_line)
    found = found.withColumn("starts", F.coalesce(starts, F.lit(True)))
    upto = in_doc.rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumn("run", F.sum(F.col("starts_run").cast("int")).over(upto)).withColumn(
        "chunk", F.sum(F.col("starts").cast("int")).over(upto)
    )
    in_run = Window.partitionBy(*doc, "run")
    found = found.withColumn("run_lines", F.count(F.lit(1)).over(in_run)).withColumn("run_words", F.sum("words").over(in_run))
    chunks = materialise(
        found.filter((F.col("run_lines") > 1) | (F.col("run_words") >= long_line))
        .groupBy(*doc, "chunk")
        .agg(
            F.array_sort(F.collect_list(F.struct("line_no", "h", "pos", "upto"))).alias("has"),
        )
        .select(
            *doc,
            F.col("has")[0]["line_no"].alias("first_line"),
            # a repeated line's hash stands for one text only, so these bytes are equal where the chunk's are
            F.unhex(F.array_join(F.transform("has.h", F.hex), "")).alias("key"),
            F.expr("flatten(transform(has, x -> sequence(x.pos, x.upto - 1)))").alias("places"),
            F.size("has").alias("chunk_lines"),
        )
    )
    first = chunks.groupBy("key").agg(F.min(F.struct(*doc, "first_line")).alias("first"), F.count(F.lit(1)).alias("n"))
    # a table of its own for the same reason
    again = chunks.join(materialise(first.filter("n > 1").drop("n")), "key").filter(~F.struct(*doc, "first_line").eqNullSafe(F.col("first")))
    return again.groupBy(*doc).agg(
        F.flatten(F.collect_list("places")).alias("removed"), F.sum("chunk_lines").alias("n_removed")
    )


def dedup_lines(docs: DataFrame, long_line: int = LONG_LINE, edges: bool = True) -> DataFrame:
    """``docs`` with repeated chunks removed from text, and a column ``n_removed``."""
    need = ["doc_id", "text"]
    keyed = packed(docs, need).withColumn("row_hash", F.xxhash64(*need, "_rest"))
    gone = removed_lines(keyed.select("doc_id", "row_hash", "text"), long_line, edges).withColumnRenamed("doc_id", "_id")
    met = keyed.join(gone, (keyed["row_hash"] == gone["row_hash"]) & keyed["doc_id"].eqNullSafe(gone["_id"]), "left").drop(
        keyed["row_hash"]
    )
    with_lines = met.withColumn("_lines", F.split("text", "\n", -1))
    kept = F.expr(r"array_join(transform(array_except(sequence(0, size(_lines) - 1), removed), i -> _lines[i]), '\n')")
    text = F.when(F.col("removed").isNull(), F.col("text")).otherwise(kept)
    out = with_lines.withColumn("text", text).withColumn("n_removed", F.coalesce("n_removed", F.lit(0)).cast("long"))
    return unpacked(out, docs.columns, need, ("n_removed",))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select(
        "doc_id", "n_removed", F.length("text").cast("long").alias("kept_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), "text"
    )


#: One row an id: the check tables have no repeated rows.
OP6_SQL = rf"""
WITH every AS (
  SELECT doc_id, i AS pos, parts[i + 1] AS line, len(parts) AS n
  FROM (SELECT doc_id, parts, unnest(range(len(parts))) AS i
        FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))
), filled AS (
  SELECT doc_id, pos, line, md5(line) AS h, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words,
    row_number() OVER w AS line_no, coalesce(lead(pos) OVER w, n) AS upto
  FROM every WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
  WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), found AS (
  SELECT * FROM filled WHERE line IN (SELECT line FROM filled GROUP BY line HAVING count(*) > 1)
), runs AS (
  SELECT *, coalesce(line_no - lag(line_no) OVER w <> 1, true) AS starts_run, CASE WHEN line_no - lag(line_no) OVER w = 1 THEN lag(h) OVER w END AS before
  FROM found WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)
), often AS (
  SELECT before, h, true AS joined FROM runs WHERE before <> h GROUP BY before, h HAVING count(*) > 1
), edged AS (
  SELECT r.*, joined IS NULL AS edge FROM runs r LEFT JOIN often USING (before, h)
), ended AS (
  SELECT *, left(md5(CASE WHEN edge THEN '' ELSE before END || h), 1) < '{BOUND}' OR words >= {LONG_LINE} AS ends FROM edged
), marked AS (
  SELECT *, coalesce(edge OR lag(ends) OVER w OR words >= {LONG_LINE}, true) AS starts
  FROM ended WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)
), numbered AS (
  SELECT *, sum(starts_run::INT) OVER w AS run, sum(starts::INT) OVER w AS chunk
  FROM marked WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)
), sized AS (
  SELECT *, count(*) OVER r AS run_lines, sum(words) OVER r AS run_words
  FROM numbered WINDOW r AS (PARTITION BY doc_id, run)
), chunks AS (
  SELECT doc_id, chunk, min(line_no) AS first_line, string_agg(line, chr(10) ORDER BY line_no) AS body
  FROM sized WHERE run_lines > 1 OR run_words >= {LONG_LINE} GROUP BY doc_id, chunk
), again AS (
  SELECT doc_id, chunk FROM (
    SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, first_line) AS k FROM chunks) WHERE k > 1
), gone AS (
  SELECT s.doc_id, s.pos, s.upto FROM sized s JOIN again USING (doc_id, chunk)
), kept AS (
  SELECT e.doc_id, string_agg(e.line, chr(10) ORDER BY e.pos) AS text
  FROM every e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.pos >= g.pos AND e.pos < g.upto
  WHERE g.doc_id IS NULL GROUP BY e.doc_id
), counted AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_removed, 0)::BIGINT AS n_removed,
  CASE WHEN d.text IS NULL THEN NULL ELSE length(coalesce(k.text, '')) END::BIGINT AS kept_chars,
  sha256(coalesce(k.text, '')) AS text_sha256,
  CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM documents d LEFT JOIN kept k USING (doc_id) LEFT JOIN counted USING (doc_id)
"""
