"""Line dedup by repeated windows of three consecutive lines, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depdelver.llm.rows import column, whole
from depdelver.session import cut

LINES = 3


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """row, its text, and key (null, id, text's hash), by which documents are ordered and told apart."""
    i, t = column(doc_id), column(text)
    key = F.struct(i.isNull().alias("none"), F.coalesce(i.cast("long"), F.lit(0).cast("long")).alias("id"), F.xxhash64(t).alias("h"))
    return docs.select(whole(docs).alias("row"), t.alias("text"), key.alias("key"))


def repeated(docs: DataFrame, doc_id: str, text: str, lines: int) -> DataFrame:
    """Of every document with lines to remove: key and gone, their distinct numbers from 0."""
    trimmed = F.transform(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(" \t\r")))
    at = F.when(F.size("l") >= lines, F.sequence(F.lit(0), F.size("l") - lines)).otherwise(F.array().cast("array<int>"))

    def window(i: Column) -> Column:
        own = [F.get(F.col("l"), i + j) for j in range(lines)]
        blank = F.length(F.concat(*own)) == 0
        return F.struct(i.alias("pos"), blank.alias("blank"), F.xxhash64(*own).alias("h1"), F.xxhash64(F.lit(1), *own).alias("h2"))

    rows = _keyed(docs, doc_id, text).where(F.col("text").isNotNull()).select("key", trimmed.alias("l"))
    rows = rows.select("key", F.explode(F.transform(at, window)).alias("w")).select("key", "w.*").where(~F.col("blank")).drop("blank")
    windows = cut(rows)
    first = windows.groupBy("h1", "h2").agg(F.min(F.struct("key", "pos")).alias("first"), F.count("*").alias("n"))
    first = cut(first.where(F.col("n") > 1).drop("n"))
    later = windows.join(first, ["h1", "h2"]).where(F.struct("key", "pos") != F.col("first"))
    # Where a window overlaps the first one in the same document, the first one stays whole.
    start = F.when(F.col("key") == F.col("first.key"), F.greatest("pos", F.col("first.pos") + lines)).otherwise(F.col("pos"))
    end = F.col("pos") + (lines - 1)
    covered = later.select("key", start.alias("a"), end.alias("b")).where(F.col("a") <= F.col("b")).distinct()
    spans = covered.groupBy("key").agg(F.collect_list(F.sequence("a", "b")).alias("s"))
    return spans.select("key", F.array_distinct(F.flatten("s")).alias("gone"))


def dedup_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lines: int = LINES, report: bool = False) -> DataFrame:
    """The documents without the lines covered by later occurrences of repeated windows.

    A window is ``lines`` consecutive lines of a document, compared without spaces, tabs and
    carriage returns at their ends; windows of blank lines only do not count. Ids are whole
    numbers, as such or as text; any other text raises CAST_INVALID_INPUT. The first occurrence, by (doc_id with null last, hash of the text, place), stays whole; what later
    ones cover is removed, and the lines that are left are joined again. Texts with fewer lines,
    empty and null ones stay as they are; rows with the same id and text are one document listed
    twice and get the same result; a document may lose all its lines and then has an empty text;
    all columns are kept, whatever their names. ``report`` adds n_lines and n_removed.

    Windows are told apart by two hashes of 64 bits and counted before they move; the join back
    reads two tables as they are, so that one window in a third of all documents is split by
    adaptive execution; texts move once, to meet the numbers of their removed lines.
    """
    gone = cut(repeated(docs, doc_id, text, lines))
    d, g = _keyed(docs, doc_id, text).alias("d"), gone.alias("g")
    rows = d.join(g.hint("merge"), F.col("d.key") == F.col("g.key"), "left")  # the same plan at every size
    # A text is split once, whatever is asked of its lines.
    rows = rows.select("d.row", "g.gone", F.split(F.col("d.row")[text], "\n").alias("l"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("l") - 1), F.col("gone"))
    new = F.when(F.col("gone").isNull(), F.col("row")[text]).otherwise(F.array_join(F.transform(kept, lambda i: F.get("l", i)), "\n"))
    out = [new.alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns]
    if report:
        out += [F.coalesce(F.size("l"), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed")]
    return rows.select(*out)


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs, report=True).select("doc_id", "n_lines", "n_removed", "text")


SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
i AS (SELECT doc_id, list_transform(l, lambda x: trim(x, ' ' || chr(9) || chr(13))) AS l, unnest(range(0, len(l) - 2)) AS pos FROM d WHERE len(l) >= 3),
w AS (SELECT doc_id, pos, l[pos + 1] || chr(10) || l[pos + 2] || chr(10) || l[pos + 3] AS w FROM i WHERE length(l[pos + 1] || l[pos + 2] || l[pos + 3]) > 0),
f AS (SELECT w, min((doc_id, pos)) AS first FROM w GROUP BY w HAVING count(*) > 1),
c AS (
  SELECT DISTINCT w.doc_id, unnest(range(CASE WHEN w.doc_id = f.first[1] THEN greatest(w.pos, f.first[2] + 3) ELSE w.pos END, w.pos + 3)) AS pos
  FROM w JOIN f ON w.w = f.w WHERE (w.doc_id, w.pos) <> f.first
), g AS (SELECT doc_id, count(*) AS n, list(pos) AS gone FROM c GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(len(l), 0) AS BIGINT) AS n_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
       CASE WHEN n IS NULL THEN text ELSE array_to_string(list_filter(l, lambda x, k: NOT list_contains(gone, k - 1)), chr(10)) END AS text
FROM d LEFT JOIN g USING (doc_id)
"""
