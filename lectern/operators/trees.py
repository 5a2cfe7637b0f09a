"""Passes over a tree of folders, level by level: sums from the leaves up, messages from the root down. No node meets all its ancestors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators.steps import Steps


def folders(paths: DataFrame, path: str = "path") -> DataFrame:
    """(node, parent, depth, name) of all folders on the paths of ``paths`` (``/a/b``), the root ``/`` at depth 0 without a parent. Null paths don't count."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    prefixes = F.transform(F.sequence(F.lit(0), F.size("_p")), lambda k: F.slice("_p", F.lit(1), k))
    held = paths.where(F.col(path).isNotNull()).select(parts.alias("_p")).distinct().select(F.explode(prefixes).alias("_p")).distinct()
    text = lambda p: F.concat(F.lit("/"), F.array_join(p, "/"))
    n = F.size("_p")
    return held.select(text(F.col("_p")).alias("node"), F.when(n > 0, text(F.slice("_p", F.lit(1), n - 1))).alias("parent"), n.alias("depth"), F.coalesce(F.try_element_at("_p", F.lit(-1)), F.lit("")).alias("name"))


def deepest(nodes: DataFrame) -> int:
    return nodes.agg(F.max("depth")).first()[0] or 0


def roll_up(nodes: DataFrame, facts: DataFrame, keys: list[str], merge: dict[str, Callable[[str], Column]]) -> DataFrame:
    """(node, keys, values): the facts of each node's whole subtree, merged by key.

    ``facts`` are (node, keys, values); ``merge`` says how a value's column is merged (``F.sum``, ``F.min`` ...), so that every
    level is summed up before it moves to the one above. Facts of unknown nodes are left out.
    """
    steps = Steps(nodes.sparkSession)
    values = list(merge)
    own = steps.keep(facts.select("node", *keys, *values).join(nodes.select("node", "parent", "depth"), "node"))
    merged = lambda rows: rows.groupBy("node", "parent", "depth", *keys).agg(*(f(c).alias(c) for c, f in merge.items()))
    above = nodes.select(F.col("node").alias("parent"), F.col("parent").alias("_up"))
    out = level = None
    for depth in range(deepest(nodes), -1, -1):
        here = own.where(F.col("depth") == depth)
        if level is not None:
            risen = level.join(above, "parent").select(F.col("parent").alias("node"), F.col("_up").alias("parent"), F.lit(depth).alias("depth"), *keys, *values)
            here = here.select(*risen.columns).unionByName(risen)
        level = steps.keep(merged(here))
        out = level if out is None else out.unionByName(level)
    return out.select("node", *keys, *values)


def pass_down(nodes: DataFrame, message: Callable[[Column], Column], kind: str) -> DataFrame:
    """``nodes`` with ``message``: what each makes of its parent's, which is null at the root, as a column of type ``kind``."""
    steps = Steps(nodes.sparkSession)
    own = steps.keep(nodes)
    out = level = None
    for depth in range(deepest(own) + 1):
        here = own.where(F.col("depth") == depth)
        if level is None:
            met = here.withColumn("_above", F.lit(None).cast(kind))
        else:
            met = here.join(level.select(F.col("node").alias("parent"), F.col("message").alias("_above")), "parent", "left")
        level = steps.keep(met.withColumn("message", message(F.col("_above")).cast(kind)).drop("_above").select(*nodes.columns, "message"))
        out = level if out is None else out.unionByName(level)
    return out


def coarse_kinds(nodes: DataFrame, books: DataFrame) -> DataFrame:
    """``nodes`` with ``n_dirs``, ``n_books``, ``n_files``, ``kind``, ``kind_confidence`` and ``book_like`` (children of kind container or grouping).

    From the leaves up: ``container`` holds several books of its own or files beside folders; ``title`` is a leaf with one book;
    ``grouping`` has mostly titles and groupings below; the rest is ``unknown``. ``books`` are (node, n_files); where most titles
    stand, one level above, a grouping is surer by 0.1.
    """
    steps = Steps(nodes.sparkSession)
    own_books = books.groupBy("node").agg(F.count("*").alias("n_books"), F.sum("n_files").alias("n_files"))
    dirs = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_dirs"))
    whole = nodes.join(own_books, "node", "left").join(dirs, "node", "left")
    whole = steps.keep(whole.fillna(0, ["n_books", "n_files", "n_dirs"]))
    out = level = None
    for depth in range(deepest(nodes), -1, -1):
        here = whole.where(F.col("depth") == depth)
        if level is None:
            met = here.withColumns({"_like": F.lit(0).cast("long"), "book_like": F.lit(0).cast("long")})
        else:
            sums = level.groupBy(F.col("parent").alias("node")).agg(F.count(F.when(F.col("kind").isin("title", "grouping"), 1)).alias("_like"), F.count(F.when(F.col("kind").isin("container", "grouping"), 1)).alias("book_like"))
            met = here.join(sums, "node", "left").fillna(0, ["_like", "book_like"])
        loose, beside = F.col("n_books") > 1, (F.col("n_files") > 0) & (F.col("n_dirs") > 0)
        share = F.col("_like") / F.greatest(F.col("n_dirs"), F.lit(1))
        kind = F.when(loose | beside, "container").when((F.col("n_books") == 1) & (F.col("n_dirs") == 0), "title").when(share > 0.5, "grouping").otherwise("unknown")
        sure = F.when(loose, 0.9).when(beside, 0.7).when(F.col("kind") == "title", 1.0).when(F.col("kind") == "grouping", F.bround(share, 2)).otherwise(0.0)
        level = steps.keep(met.withColumn("kind", kind).withColumn("kind_confidence", sure).drop("_like"))
        out = level if out is None else out.unionByName(level)
    modal = modal_title_depth(out)
    raised = F.when((F.col("kind") == "grouping") & (F.col("depth") == F.lit(modal) - 1), F.round(F.least(F.lit(1.0), F.col("kind_confidence") + 0.1), 2)).otherwise(F.col("kind_confidence"))
    return out.withColumn("kind_confidence", raised)


def modal_title_depth(kinds: DataFrame) -> int | None:
    """The depth at which most nodes of kind title stand, the smaller one of several; None without titles."""
    top = kinds.where("kind = 'title'").groupBy("depth").agg(F.count("*").alias("n")).agg(F.max_by("depth", F.struct("n", -F.col("depth")))).first()
    return top[0]
