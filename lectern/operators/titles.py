"""Whether titles are borne out by the names around them: a verdict for each book."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.quality import structural_marker
from lectern.functions.titles import name_residuals, plain_words, says_something, title_residuals, title_words
from lectern.operators.steps import Steps, spread


def verdicts(books: DataFrame, files: DataFrame, book: str, order: str) -> DataFrame:
    """(book, verdict, sources, evidence, suggested): ``agree`` with the sources that share a word with the title, ``contradict`` if there are sources and none does, else ``abstain``.

    ``books`` hold title, folder, authors, series, franchise, ``files`` the stems by ``order``. Sources are the folder and what all
    files say that say anything: words held by as many of them as there are, as the first writes them. Authors, series and
    franchise are taken out first. Nulls are empty.
    """
    steps = Steps(books.sparkSession)
    listed = F.coalesce("authors", F.array().cast("array<string>"))
    known = F.filter(F.array("series", "franchise"), lambda t: t.isNotNull() & (t != ""))
    rows = spread(books.select(book, "title", F.coalesce("folder", F.lit("")).alias("folder"), listed.alias("authors"), known.alias("_known")), book).withColumn("_all", F.concat("authors", "_known"))
    # residuals are written before rows are filtered by them: pushed below them, a filter would repeat all their steps
    # a mark of structure (``Chapter 1``) says nothing and isn't cut
    stems = spread(files.where(~structural_marker(F.col("stem"))).select(book, order, "stem"), book)
    said = steps.keep(name_residuals(stems.join(rows.select(book, "_all"), book), "stem", "_all", "_said").select(book, order, plain_words(F.col("_said")).alias("_words")))
    said = said.where(F.size("_words") > 0)
    n = said.groupBy(book).agg(F.count("*").alias("_n"))
    words = said.select(book, order, F.posexplode("_words").alias("_at", "_word")).groupBy(book, "_word").agg(F.count("*").alias("_c"), F.min(F.struct(order, "_at")).alias("_first"))
    shared = words.join(n, book).where("_c = _n").groupBy(book).agg(F.array_sort(F.collect_list(F.struct("_first", "_word"))).alias("_held"))  # at most one name's words
    shared = shared.select(book, F.array_join(F.transform("_held", lambda x: x["_word"]), " ").alias("_files"))
    rows = name_residuals(title_residuals(rows, "title", "_known", "authors", "_tag"), "folder", "_all", "_folder")
    rows = steps.keep(rows.select(book, "title", "_tag", "_folder")).join(shared, book, "left")
    rows = rows.withColumn("_files", F.when(says_something(F.col("_files")), F.col("_files")).otherwise("")).select(book, "title", "_tag", "_folder", "_files", title_words(F.col("_tag")).alias("_words"))
    sources = F.filter(F.array(F.struct(F.lit("folder").alias("source"), F.col("_folder").alias("text")), F.struct(F.lit("filename").alias("source"), F.col("_files").alias("text"))), lambda s: s["text"] != "")
    rows = rows.withColumn("_sources", sources)
    rows = rows.withColumn("sources", F.transform(F.filter("_sources", lambda s: F.arrays_overlap("_words", title_words(s["text"]))), lambda s: s["source"]))
    rows = rows.withColumn("verdict", F.when((F.col("_tag") == "") | (F.size("_sources") == 0), "abstain").when(F.size("sources") > 0, "agree").otherwise("contradict"))
    first, case = F.get("_sources", F.lit(0)), F.col("verdict")
    evidence = F.when(case == "agree", F.concat(F.lit('tag "'), "_tag", F.lit('" ~ '), F.get("sources", F.lit(0)))).when(case == "contradict", F.concat(F.lit('metadata title "'), "_tag", F.lit('" vs '), first["source"], F.lit(' "'), first["text"], F.lit('"'))).otherwise("")
    suggested = F.when(case == "agree", F.col("title")).when(case == "contradict", first["text"])
    return rows.select(book, "verdict", F.when(case == "agree", F.col("sources")).otherwise(F.array().cast("array<string>")).alias("sources"), evidence.alias("evidence"), suggested.alias("suggested"))
