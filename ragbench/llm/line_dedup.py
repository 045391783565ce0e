"""Deletion of repeated runs of lines, by winnowing over line hashes, in DataFrame functions only.

A *run* is a sequence of consecutive lines with words (lines without words are passed over) that holds at least
``min_words`` words. A line is deleted if it is part of a run that equals a run at an earlier position: in a
document with a smaller id, or further up in the same document.

How it is found:

1. Select. The minimal runs forward from each line and backward from each line (at most ``min_words`` lines, as each
   has a word) are the winnowing windows. Of each window the line with the least hash, the leftmost of equal ones, is
   selected. Neighbouring windows mostly select the same line, so the selected positions are sparse; equal runs
   select equal lines, so a repeated run is guaranteed to have a selected line whose hash stands at two positions.
2. Join. Positions are joined by hash; those whose hash no other position has are done with, and so are documents
   without any other.
3. Extend. From each position left, both ways: the windows that selected it are compared as a whole (128 bits), the
   first place of each is kept, all later ones are matches. As a window starts and one ends at every line, matches
   reach both ends of a repeated run, also where its parts have their first places in several documents. No two
   positions are ever paired, so a line that a third of all documents have costs a row for each of them.
4. Delete. Overlapping matches of a document are merged into maximal runs, which are cut out in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ragbench.llm.common import SPACE, SPACES_RE, Columns, stored

MIN_WORDS = 50


def _doc() -> WindowSpec:
    return Window.partitionBy("doc")


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACE))


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc, line_no, h, h2, words before and after) for each line with words of (doc, text); equal docs count once."""
    lines = docs.select("doc", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")).select("doc", "line_no", _trimmed(F.col("line")).alias("line")).where("line <> ''")
    hashed = lines.select("doc", "line_no", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("h2"), F.size(F.split("line", SPACES_RE, -1)).alias("words"))
    # One shuffle by document serves the windows by line, too.
    once = hashed.repartition("doc").withColumn("copy", F.row_number().over(Window.partitionBy("doc", "line_no").orderBy("h"))).where("copy = 1").drop("copy")
    upto = F.sum("words").over(_doc().orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    return once.withColumn("after", upto).withColumn("before", F.col("after") - F.col("words")).drop("words")


def _windows(min_words: int) -> tuple:
    return _doc().orderBy("before").rangeBetween(0, min_words - 1), _doc().orderBy("after").rangeBetween(1 - min_words, 0)


def selected(lines: DataFrame, min_words: int) -> DataFrame:
    """(doc, h, line_no): the lines that windows of at least ``min_words`` words select, each once."""
    def least(over) -> Column:
        return F.when(F.max("after").over(over) - F.min("before").over(over) >= min_words, F.min(F.struct("h", "line_no")).over(over))

    both = lines.select("doc", F.array(*map(least, _windows(min_words))).alias("w"))
    return both.select("doc", F.explode("w").alias("w")).where("w is not null").select("doc", "w.h", "w.line_no").distinct()


def extended(lines: DataFrame, min_words: int) -> DataFrame:
    """(doc, first, last, c1, c2) for each window whose selected line is ``hot``, with the hashes of its content."""
    def made(over) -> Column:
        whole = F.max("after").over(over) - F.min("before").over(over) >= min_words
        return F.when(whole & F.min(F.struct("h", "line_no", "hot")).over(over)["hot"], F.struct(
            F.min("line_no").over(over).alias("first"), F.max("line_no").over(over).alias("last"),
            F.xxhash64(F.collect_list("h").over(over)).alias("c1"), F.xxhash64(F.collect_list("h2").over(over)).alias("c2"),
        ))

    both = lines.select("doc", F.array(*map(made, _windows(min_words))).alias("w"))
    return both.select("doc", F.explode("w").alias("w")).where("w is not null").select("doc", "w.*")


def runs_of(matches: DataFrame) -> DataFrame:
    """(doc, cuts): the maximal runs of lines that the matches (doc, first, last) cover, in order, with the line before each that was cut last."""
    before = F.max("last").over(_doc().orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1))
    starts = matches.withColumn("new", F.coalesce(F.col("first") > before, F.lit(True)).cast("int"))
    runs = starts.withColumn("run", F.sum("new").over(_doc().orderBy("first", "last").rowsBetween(Window.unboundedPreceding, 0)))
    merged = runs.groupBy("doc", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    merged = merged.withColumn("upto", F.coalesce(F.lag("last").over(_doc().orderBy("run")), F.lit(-1)))
    return merged.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("first", "last", "upto"))).alias("cuts"))


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_words: int = MIN_WORDS) -> DataFrame:
    """All rows and columns, with later repeated runs deleted from ``text``; adds ``n_lines`` and ``n_removed``.

    Null and empty texts stay as they are and have no lines. Lines are compared without white space at their
    ends. Rows that equal each other in id and text count as one document (each gets the same result); rows
    with the same id and other texts are ordered by a hash of the text. Null ids come first. Columns named like
    the two outputs are replaced, all others stay, whatever their names. An empty table gives an empty table. A
    document's lines are sorted in one task, which may spill; the work grows in proportion to their number.
    """
    table = Columns(docs)
    text, doc_id = table.name(text), table.name(doc_id)
    keyed = table.rows.withColumn("doc", F.struct(F.col(doc_id).alias("id"), F.xxhash64(text).alias("key")))
    lines = stored(lines_of(keyed.select("doc", F.col(text).alias("text"))), "lines")
    marks = stored(selected(lines, min_words), "selected")
    place = F.struct("doc", "line_no")
    repeated = stored(marks.groupBy("h").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo != hi").select("h"), "repeated")
    hot = stored(marks.join(repeated.hint("merge"), "h", "left_semi").select("doc", "line_no", F.lit(True).alias("hot")), "hot")
    some = lines.join(hot.select("doc").distinct().hint("merge"), "doc", "left_semi").join(hot.hint("merge"), ["doc", "line_no"], "left")
    windows = stored(extended(some.withColumn("hot", F.coalesce("hot", F.lit(False))), min_words), "windows")
    place = F.struct("doc", "first")
    firsts = stored(windows.groupBy("c1", "c2").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo != hi").select("c1", "c2", "lo"), "firsts")
    later = windows.join(firsts.hint("merge"), ["c1", "c2"]).where(place > F.col("lo")).select("doc", "first", "last")
    cuts = stored(runs_of(later), "cuts")

    out = keyed.join(cuts.hint("merge"), "doc", "left").withColumn("lines", F.split(text, "\n", -1))
    blank = lambda x: _trimmed(x) == ""
    part = lambda first, last: F.slice("lines", first + 1, F.greatest(last - first + 1, F.lit(0)))
    # Between the runs all lines stay; of a run's lines those without words do.
    kept = F.flatten(F.transform("cuts", lambda c: F.concat(part(c["upto"] + 1, c["first"] - 1), F.filter(part(c["first"], c["last"]), blank))))
    tail = part(F.element_at("cuts", -1)["last"] + 1, F.size("lines") - 1)
    gone = F.aggregate("cuts", F.lit(0), lambda n, c: n + F.size(F.filter(part(c["first"], c["last"]), lambda x: ~blank(x))))
    some_cut = F.col("cuts").isNotNull()
    n_lines = F.when(F.col(text).isNull(), 0).otherwise(F.size(F.filter("lines", lambda x: ~blank(x))))
    new = F.when(some_cut, F.array_join(F.concat(kept, tail), "\n")).otherwise(F.col(text))
    return table.done(out, {"n_lines": n_lines.cast("long"), "n_removed": F.when(some_cut, gone).otherwise(0).cast("long")}, {text: new})


def op5_line_dedup(docs: DataFrame) -> DataFrame:
    """The query: every document with its remaining text."""
    return dedup_lines(docs.select("doc_id", "text"))


#: DuckDB SQL for the query: every minimal run, its first place by content, and the lines that later places cover.
ORACLE = rf"""
WITH raw AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l0 AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS line_no, unnest(ls) AS raw_line FROM raw WHERE text IS NOT NULL),
l1 AS (SELECT doc_id, line_no, trim(raw_line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM l0),
l2 AS (SELECT doc_id, line_no, line, len(regexp_split_to_array(line, '{SPACES_RE}')) AS words FROM l1 WHERE line <> ''),
l3 AS (SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY line_no)::BIGINT AS after FROM l2),
l AS (SELECT *, after - words AS before FROM l3),
w AS (
  SELECT doc_id, min(line_no) OVER f AS a, max(line_no) OVER f AS b, list(line) OVER f AS content, max(after) OVER f - min(before) OVER f AS n FROM l
    WINDOW f AS (PARTITION BY doc_id ORDER BY before RANGE BETWEEN CURRENT ROW AND {MIN_WORDS - 1} FOLLOWING)
  UNION ALL
  SELECT doc_id, min(line_no) OVER f, max(line_no) OVER f, list(line) OVER f, max(after) OVER f - min(before) OVER f FROM l
    WINDOW f AS (PARTITION BY doc_id ORDER BY after RANGE BETWEEN {MIN_WORDS - 1} PRECEDING AND CURRENT ROW)),
k AS (SELECT doc_id, a, b, min(row(doc_id, a)) OVER (PARTITION BY array_to_string(content, chr(10))) AS lo FROM w WHERE n >= {MIN_WORDS}),
g AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS line_no FROM k WHERE row(doc_id, a) > lo),
c AS (SELECT l1.doc_id, string_agg(raw_line, chr(10) ORDER BY l0.line_no) FILTER (g.doc_id IS NULL OR line = '') AS kept,
    count(*) FILTER (line <> '') AS n_lines, count(*) FILTER (g.doc_id IS NOT NULL AND line <> '') AS n_removed
  FROM l0 JOIN l1 USING (doc_id, line_no) LEFT JOIN g USING (doc_id, line_no) GROUP BY l1.doc_id)
SELECT raw.doc_id, CASE WHEN text IS NOT NULL THEN coalesce(kept, '') END AS text, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed
FROM raw LEFT JOIN c USING (doc_id)"""
