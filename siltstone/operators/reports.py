"""Readable reports of graph questions: lines in order, cut at a budget of characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def description(label: Column, kind: Column, file: Column, line: Column) -> Column:
    """``label [kind] @ file:line``; parts that are missing are left out."""
    place = F.concat(F.lit(" @ "), file, F.coalesce(F.concat(F.lit(":"), line.cast("string")), F.lit("")))
    return F.concat(F.coalesce(label, F.lit("?")), F.lit(" ["), F.coalesce(kind, F.lit("")), F.lit("]"), F.coalesce(place, F.lit("")))


def describe_nodes(nodes: DataFrame) -> DataFrame:
    """``node, label, source_file, start_line, end_line, about``."""
    return nodes.select("node", "label", "source_file", "start_line", "end_line", description(F.col("label"), F.col("kind"), F.col("source_file"), F.col("start_line")).alias("about"))


def hit_lines(hits: DataFrame, nodes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``keys, pos, line`` of hits (keys, node, distance, relation, via): ``[d1] about (relation ← label)``."""
    about = describe_nodes(nodes)
    via = about.select(F.col("node").alias("via"), F.col("label").alias("via_label"))
    rows = hits.join(about.select("node", "about"), "node", "left").join(via, "via", "left")
    arrow = F.when(F.col("via").isNotNull(), F.concat(F.lit(" ← "), F.coalesce("via_label", F.col("via").cast("string")))).otherwise("")
    text = F.format_string("  [d%d] %s (%s%s)", F.col("distance"), F.coalesce("about", F.concat(F.col("node").cast("string"), F.lit(" []"))), "relation", arrow)
    order = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("distance", *([F.desc("in_degree")] if "in_degree" in hits.columns else []), "node")
    return rows.select(*(keys or []), F.row_number().over(order).alias("pos"), text.alias("line"))


def cut_lines(lines: DataFrame, budget: int, keys: list[str] | None = None, title: str = "", empty: str = "  (none found in graph)") -> DataFrame:
    """``keys, pos, line``: lines (keys, pos, line) up to the first that would pass the budget, then how many more there are.

    The title has pos 0 and counts; the marker doesn't. Without keys an empty
    input gives the title and ``empty``; per key, keys without lines give none.
    """
    by = keys or []
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy("pos")
    used = lines.withColumn("used", F.sum(F.length("line")).over(w.rowsBetween(Window.unboundedPreceding, 0)) + len(title))
    kept = used.where(F.col("used") <= budget).select(*by, F.col("pos").cast("int").alias("pos"), "line")
    left = used.groupBy(*by).agg(F.count_if(F.col("used") > budget).alias("n"), F.count("*").alias("all"))
    more = left.where("n > 0").select(*by, F.lit((1 << 31) - 1).alias("pos"), F.format_string("  … %d more truncated", "n").alias("line"))
    heads = left if not by else left.select(*by)
    head = heads.select(*by, F.lit(0).alias("pos"), F.lit(title).alias("line"))
    out = kept.unionByName(more).unionByName(head) if title else kept.unionByName(more)
    if by:
        return out
    none = left.where("all = 0").select(F.lit(1).alias("pos"), F.lit(empty).alias("line"))
    return out.unionByName(none)


def joined(lines: DataFrame, keys: list[str] | None = None, name: str = "report", limit: int | None = None) -> DataFrame:
    """``keys, name``: the lines (keys, pos, line) of each key as one text; for reports, which have a budget."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    return lines.groupBy(*(keys or [])).agg((F.substring(text, 1, limit) if limit else text).alias(name))


def fitting_blocks(blocks: DataFrame, budget: int, keys: list[str], skip: bool = False) -> DataFrame:
    """Blocks (keys, pos, n) that fit a budget of characters.

    By default up to the first that doesn't; with ``skip`` that one is left out
    and later, smaller ones may follow. Skipping needs an order-dependent fold
    over the lengths of a key's blocks; leave texts out. Rows come back with ``fits``.
    """
    w = Window.partitionBy(*keys).orderBy("pos")
    if not skip:
        return blocks.withColumn("fits", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)) <= budget)
    schema = ", ".join(f"{c} {t}" for c, t in blocks.dtypes)

    def fold(pdf):
        used, out = 0, []
        pdf = pdf.sort_values("pos", kind="stable")
        for n in pdf["n"]:
            ok = used + n <= budget
            used += n if ok else 0
            out.append(ok)
        return pdf.assign(fits=out)

    return blocks.groupBy(*keys).applyInPandas(fold, f"{schema}, fits boolean")
