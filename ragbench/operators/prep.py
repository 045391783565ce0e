"""Clean-up of page texts: headers, wrapped lines, blocks, broken words, sections."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragbench.functions.text import fold
from ragbench.operators.strings import similar_strings
from ragbench.sources.shared import written

#: Ligatures U+FB00 to U+FB06 and their letters.
LIGATURES = (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st"))


def clean_line(line: Column) -> Column:
    """Ligatures spelt out, white space collapsed."""
    for a, b in LIGATURES:
        line = F.replace(line, F.lit(a), F.lit(b))
    return F.btrim(F.regexp_replace(line, r"(?U)\s+", " "))


def page_lines(pages: DataFrame) -> DataFrame:
    """(doc, page, line_no, line, edge) of pages (doc, page, text): non-empty lines; edge: one of the first or last two."""
    rows = pages.select("doc", "page", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")).withColumn("line", clean_line(F.col("line"))).where("line <> ''")
    w = Window.partitionBy("doc", "page")
    return rows.withColumn("edge", (F.row_number().over(w.orderBy("line_no")) <= 2) | (F.row_number().over(w.orderBy(F.desc("line_no"))) <= 2))


def masked(line: Column) -> Column:
    return F.regexp_replace(line, r"\d", "#")


def running_lines(lines: DataFrame, share: float = 0.3) -> DataFrame:
    """(doc, mask): edge lines, digits masked, on at least ``share`` of a document's pages."""
    pages = lines.groupBy("doc").agg(F.countDistinct("page").alias("pages"))
    seen = lines.where("edge").groupBy("doc", masked(F.col("line")).alias("mask")).agg(F.countDistinct("page").alias("n"))
    return seen.hint("merge").join(pages, "doc").where(F.col("n") >= share * F.col("pages")).select("doc", "mask")


#: Fixed value: the stamp of a publisher of laws.
STAMPS = ("leismunicipais.com.br",)


def without_running_lines(lines: DataFrame, running: DataFrame, stamps: tuple[str, ...] = STAMPS) -> DataFrame:
    """Lines that are neither running headers, bare page numbers nor a publisher's stamp (any of ``stamps``, letter case aside)."""
    kept = lines.withColumn("mask", F.when(F.col("edge"), masked(F.col("line"))))
    kept = kept.join(running.hint("merge"), ["doc", "mask"], "left_anti").where(~F.col("line").rlike(r"^\d{1,4}$")).drop("mask")
    for stamp in stamps:
        kept = kept.where(~F.contains(F.lower("line"), F.lit(stamp)))
    return kept


def join_wrapped(lines: DataFrame) -> DataFrame:
    """(doc, para, text): a line goes on from the one before unless that ends a sentence or this begins with a capital or a number; a hyphen before a small letter is undone."""
    w = Window.partitionBy("doc").orderBy("page", "line_no")
    before = F.lag("line").over(w)
    hyphen = before.rlike(r"\p{L}-$") & F.col("line").rlike(r"^\p{Ll}")
    goes_on = F.coalesce(hyphen | (~before.rlike(r"[.!?:;]$") & F.col("line").rlike(r"^[^\p{Lu}\d]")), F.lit(False))
    rows = lines.withColumn("new", (~goes_on).cast("int")).withColumn("hyphen", F.coalesce(hyphen, F.lit(False)))
    rows = rows.withColumn("para", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    piece = F.concat(F.when(F.col("hyphen"), "\u0001").otherwise(" "), F.col("line"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "line_no", piece.alias("piece")))), lambda x: x["piece"]), "")
    return rows.groupBy("doc", "para").agg(F.btrim(F.replace(text, F.lit("-\u0001"), F.lit(""))).alias("text"))


def lift_labels(lines: DataFrame) -> DataFrame:
    """A line that is a label only (it ends with a colon) after a value line goes in front of that value."""
    w = Window.partitionBy("doc", "page").orderBy("line_no")
    after = F.lead("line").over(w)
    label = F.col("line").rlike(":$")
    lifted = F.when(~label & after.rlike(":$"), F.concat(after, F.lit(" "), F.col("line"))).otherwise(F.col("line"))
    used = label & ~F.coalesce(F.lag("line").over(w).rlike(":$"), F.lit(True))
    return lines.withColumn("_l", lifted).withColumn("_u", used).where("not _u").withColumn("line", F.col("_l")).drop("_l", "_u")


def vocabulary(texts: DataFrame) -> DataFrame:
    words = texts.select(F.explode(F.regexp_extract_all("text", F.lit(r"([\p{L}]+)"), F.lit(1))).alias("word"))
    return words.groupBy(F.lower("word").alias("word")).agg(F.count("*").alias("n"))


def repair_words(broken: DataFrame, vocab: DataFrame, mark: str = "�", fallback: str = "ti") -> DataFrame:
    """(word, fixed, known): a word with lost ligatures takes the most frequent candidate in the vocabulary, else the fallback."""
    options = F.array(*map(F.lit, ("ff", "fi", "fl", "ffi", "ffl", "ti", "tt")))
    c = broken.select("word").distinct().select("word", F.explode(options).alias("o")).select("word", F.replace("word", F.lit(mark), F.col("o")).alias("candidate"))
    best = c.hint("merge").join(vocab, F.lower("candidate") == vocab["word"]).groupBy(c["word"].alias("w")).agg(F.max(F.struct("n", "candidate"))["candidate"].alias("best"))
    words = broken.select("word").distinct()
    return words.hint("merge").join(best, words["word"] == best["w"], "left").select("word", F.coalesce("best", F.replace("word", F.lit(mark), F.lit(fallback))).alias("fixed"), F.col("best").isNotNull().alias("known"))


def pack(paragraphs: DataFrame, limit: int = 800) -> DataFrame:
    """(doc, block, text): a document's paragraphs in order, packed greedily into blocks of at most ``limit`` characters.

    A task runs through its documents' paragraphs in order and holds one block.
    """
    in_order = paragraphs.where("text is not null").select("doc", "para", "text").repartition("doc").sortWithinPartitions("doc", "para", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, block, held, size = None, 0, [], 0
        for batch in batches:
            out = []
            for doc, text in zip(batch["doc"], batch["text"]):
                if doc != last:
                    out.append((last, block, held))
                    last, block, held, size = doc, 0, [], 0
                elif size and size + 1 + len(text) > limit:
                    out.append((last, block, held))
                    block, held, size = block + 1, [], 0
                size += len(text) + (1 if size else 0)
                held = [*held, text] if size > len(text) else [text]
            yield framed(out)
        yield framed([(last, block, held)])

    def framed(rows: list[tuple]) -> pd.DataFrame:
        rows = [(doc, block, text) for doc, block, held in rows if (text := "\n".join(held))]
        return pd.DataFrame(rows, columns=["doc", "block", "text"])

    return in_order.select("doc", "text").mapInPandas(run, T.StructType([T.StructField("doc", paragraphs.schema["doc"].dataType), T.StructField("block", T.IntegerType()), T.StructField("text", T.StringType())]))


def sections(paragraphs: DataFrame, heading: str, article: str) -> DataFrame:
    """(doc, article_no, heading, text): paragraphs grouped by article starts, under the last heading before them."""
    w = Window.partitionBy("doc").orderBy("para").rowsBetween(Window.unboundedPreceding, 0)
    rows = paragraphs.withColumn("heading", F.last(F.when(F.col("text").rlike(heading), F.col("text")), True).over(w)).withColumn("article_no", F.sum(F.col("text").rlike(article).cast("int")).over(w))
    rows = rows.where(~F.col("text").rlike(heading) & (F.col("article_no") > 0))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("para", "text"))), lambda x: x["text"]), "\n")
    return rows.groupBy("doc", "article_no").agg(F.min_by("heading", "para").alias("heading"), text.alias("text"))


def guide_pairs(lines: DataFrame, page_number: str = r"\s(\d{1,4})$") -> DataFrame:
    """(doc, agency, title, page) of a contents list: a line with a page number is an entry of the last line without one before it."""
    w = Window.partitionBy("doc").orderBy("page", "line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("entry", F.col("line").rlike(page_number))
    rows = rows.withColumn("agency", F.last(F.when(~F.col("entry"), F.col("line")), True).over(w))
    return rows.where("entry and agency is not null").select("doc", "agency", F.regexp_replace("line", page_number, "").alias("title"), F.regexp_extract("line", page_number, 1).cast("int").alias("target"))


def nearest_titles(wanted: DataFrame, titles: DataFrame, cutoff: float = 0.9) -> DataFrame:
    """(id, title, nearest, ratio): the most alike title (name) of each wanted one (id, title), of at least ``cutoff``.

    All titles count (``similar_strings`` is exact); the ratio is the Indel ratio over 100. Ties go to the smaller name.
    """
    wanted = written(wanted.select("id", "title", fold(F.col("title")).alias("left_id")), "wanted")
    titles = written(titles.select("name", fold(F.col("name")).alias("right_id")).groupBy("right_id").agg(F.min("name").alias("name")), "titles")
    close = written(similar_strings(wanted.select(F.col("left_id").alias("id"), F.col("left_id").alias("text")).distinct(), titles.select(F.col("right_id").alias("id"), F.col("right_id").alias("text")), 100 * cutoff), "close")
    near = wanted.join(close, "left_id").join(titles, "right_id")
    best = near.groupBy("id", "title").agg(F.min(F.struct((-F.col("ratio")).alias("far"), F.col("name"))).alias("best"))
    return best.select("id", "title", F.col("best.name").alias("nearest"), (-F.col("best.far") / 100).alias("ratio"))


def audit(matches: DataFrame, most: int = 2) -> DataFrame:
    """(qid, problem) of a question set, from the blocks (doc) that hold each hop's evidence (qid, hop, doc or null, secondary).

    Evidence that no block holds; evidence that a secondary source holds; all hops in the same blocks; more than ``most``
    blocks for a hop.
    """
    hops = matches.groupBy("qid", "hop").agg(F.count("doc").alias("n"), F.array_sort(F.collect_set("doc")).alias("docs"), F.bool_or(F.col("doc").isNotNull() & F.coalesce("secondary", F.lit(False))).alias("secondary"))
    by = hops.groupBy("qid").agg(F.min("n").alias("least"), F.max("n").alias("greatest"), F.bool_or(F.coalesce("secondary", F.lit(False))).alias("secondary"), F.countDistinct("docs").alias("kinds"), F.count("*").alias("hops"))
    found = (
        F.when(F.col("least") == 0, "unmatched evidence"), F.when(F.col("secondary"), "secondary source"),
        F.when((F.col("least") > 0) & (F.col("hops") > 1) & (F.col("kinds") == 1), "hops in the same blocks"), F.when(F.col("greatest") > most, "more than two blocks"),
    )
    return by.select("qid", F.explode(F.array_compact(F.array(*found))).alias("problem"))
