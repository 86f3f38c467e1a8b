"""Words to lines, segments, slots, rows, paragraphs and lists. Every operator keeps the page as its
partition key, so a page is never split and pages spread over the cluster."""

from __future__ import annotations


from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quirefold.functions.geometry import enclosing, height, index_quantile, rounded
from quirefold.functions.text import LIST_MARKER, LIST_PREFIX, fold_lines

PAGE = ["doc_id", "page"]
GAP_EM = 2.2  # a wider horizontal gap splits a line


def with_line(words: DataFrame) -> DataFrame:
    """A line key: the recogniser's, else quarters of the top edge."""
    return words.withColumn(
        "line_key", F.when(F.size("line_id") > 0, F.array_join(F.col("line_id").cast("array<string>"), "-")).otherwise(F.concat(F.lit("y"), F.bround(F.col("y0") / 4).cast("int")))
    )


def lines(words: DataFrame) -> DataFrame:
    """One row per line: box, median size, confidence and style weighted by characters."""
    w = F.greatest(F.lit(1), F.length("text"))
    return (
        with_line(words.where(F.col("text").isNotNull()))
        .groupBy(*PAGE, "line_key")
        .agg(
            F.count("*").alias("n_words"),
            *enclosing(),
            F.median("size").alias("size"),
            F.sum(w).alias("weight"),
            F.sum(F.nanvl("confidence", F.lit(0.0)) * w).alias("conf_sum"),
            F.sum(F.when(F.col("bold"), w).otherwise(0)).alias("bold_sum"),
            F.sum(F.when(F.col("italic"), w).otherwise(0)).alias("italic_sum"),
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "word_no", "text"))), lambda s: s["text"]), " ").alias("text"),
        )
        .withColumns(
            {
                "confidence": rounded(F.col("conf_sum") / F.col("weight")),
                "bold_ratio": rounded(F.col("bold_sum") / F.col("weight")),
                "italic_ratio": rounded(F.col("italic_sum") / F.col("weight")),
            }
        )
        .drop("conf_sum", "bold_sum", "italic_sum")
    )


def segments(words: DataFrame) -> DataFrame:
    """Words with their segment number in the line: a gap of more than GAP_EM em starts a new one,
    except after a list marker that begins the line."""
    line = Window.partitionBy(*PAGE, "line_key").orderBy("x0", "word_no")
    whole = Window.partitionBy(*PAGE, "line_key")
    em = F.greatest(F.lit(4.0), F.median("size").over(whole))
    d = with_line(words.where(F.col("text").isNotNull())).withColumns(
        {"em": em, "gap": F.col("x0") - F.lag("x1").over(line), "k": F.row_number().over(line), "before": F.lag("text").over(line)}
    )
    marker = (F.col("k") == 2) & F.col("before").rlike(LIST_MARKER)
    return d.withColumn("starts", F.when((F.col("gap") > GAP_EM * F.col("em")) & ~marker, 1).otherwise(0)).withColumn(
        "segment_no", F.sum("starts").over(line.rowsBetween(Window.unboundedPreceding, 0))
    )


def slots(boxes: DataFrame, tolerance: float = 4.0) -> DataFrame:
    """Merged x intervals of a page's boxes: islands by the running right edge."""
    w = Window.partitionBy(*PAGE).orderBy("x0", "x1", "y0", "y1")
    edge = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = boxes.withColumn("edge", edge).withColumn("new", F.when(F.col("edge").isNull() | (F.col("x0") > F.col("edge") + tolerance), 1).otherwise(0))
    return (
        d.withColumn("slot_no", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*PAGE, "slot_no")
        .agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.count("*").alias("n"))
    )


def margins(line_rows: DataFrame) -> DataFrame:
    """Left and right text margin of a page by index quantiles over its lines (bounded by the page)."""
    return line_rows.groupBy(*PAGE).agg(
        index_quantile(F.collect_list("x0"), 0.2).alias("left_margin"), index_quantile(F.collect_list("x1"), 0.8).alias("right_margin")
    )


def single_lines(line_rows: DataFrame) -> DataFrame:
    """Lines with `single`: whether no other line of the page shares half of the lower one's height."""
    o = line_rows.select(*PAGE, *[F.col(c).alias(f"o_{c}") for c in ("line_key", "y0", "y1")])
    share = (F.least("y1", "o_y1") - F.greatest("y0", "o_y0") > 0.5 * F.least(F.col("y1") - F.col("y0"), F.col("o_y1") - F.col("o_y0"))) & (F.col("line_key") != F.col("o_line_key"))
    crowded = line_rows.join(o, PAGE).where(share).select(*PAGE, "line_key").distinct().withColumn("crowded", F.lit(True))
    return line_rows.join(crowded, [*PAGE, "line_key"], "left").withColumn("single", F.col("crowded").isNull()).drop("crowded")


def wide_margins(line_rows: DataFrame) -> DataFrame:
    """doc_id, page, n_wide, left_margin, right_margin from lines with `single` and the page's `width`."""
    wide = F.col("single") & (F.col("x1") - F.col("x0") >= 0.45 * F.col("width"))
    s = line_rows.withColumn("wide", wide).groupBy(*PAGE).agg(
        F.count_if("wide").alias("n_wide"), F.max("width").alias("width"), F.collect_list(F.when(F.col("wide"), F.col("x0"))).alias("l"), F.collect_list(F.when(F.col("wide"), F.col("x1"))).alias("r"), F.collect_list("x0").alias("all")
    )  # bounded by a page's lines
    left = index_quantile(F.when(F.size("l") > 0, F.col("l")).otherwise(F.col("all")), 0.2)
    right = F.when(F.size("l") > 0, index_quantile(F.col("r"), 0.8)).otherwise(F.col("width") - index_quantile(F.col("all"), 0.2))
    return s.select(*PAGE, "n_wide", rounded(left).alias("left_margin"), rounded(right).alias("right_margin"))


def body_size(blocks: DataFrame, default: float = 12.0) -> DataFrame:
    """The size at which half of the paragraph characters are reached, to half points."""
    order = Window.partitionBy("doc_id").orderBy("size", "page", "block_no")
    d = blocks.where((F.col("kind") == "paragraph") & F.col("size").isNotNull() & (F.col("size") > 0) & (F.length("text") > 0))
    d = d.withColumns(
        {
            "reached": F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0)),
            "total": F.sum(F.length("text")).over(Window.partitionBy("doc_id")),
        }
    )
    first = d.where(F.col("reached") * 2 >= F.col("total")).groupBy("doc_id").agg(F.min("size").alias("size"))
    return first.select("doc_id", (F.bround(F.col("size") * 2) / 2).alias("body_size"))


def paragraphs_by_window(line_rows: DataFrame, pitch: float = 0.75) -> DataFrame:
    """Paragraphs of lines by pairwise tests: a large gap, another size or weight, a list prefix, or a
    line before that ended short of the margin. (The tests on whole paragraphs are in flow_paragraphs.)"""
    order = Window.partitionBy(*PAGE).orderBy("y0", "x0", "line_key")
    d = line_rows.join(margins(line_rows), PAGE)
    gap, em = F.col("y0") - F.lag("y1").over(order), F.greatest(F.lit(4.0), F.lag("size").over(order))
    starts = (
        F.lag("y0").over(order).isNull()
        | (gap > pitch * em)
        | (F.abs(F.col("size") - F.lag("size").over(order)) > 0.2 * F.lag("size").over(order))
        | ((F.lag("bold_ratio").over(order) >= 0.6) != (F.col("bold_ratio") >= 0.6))
        | F.col("text").rlike(LIST_PREFIX)
        | (F.lag("x1").over(order) < F.col("right_margin") - 2.5 * em)
    )
    d = d.withColumn("starts", F.when(starts, 1).otherwise(0)).withColumn("paragraph_no", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return (
        d.groupBy(*PAGE, "paragraph_no")
        .agg(
            F.count("*").alias("n_lines"),
            F.sum("n_words").alias("n_words"),
            F.min("y0").alias("y0"),
            F.max("y1").alias("y1"),
            F.sort_array(F.collect_list(F.struct("y0", "x0", "line_key", "text"))).alias("parts"),
        )
        .withColumn("text", fold_lines(F.transform("parts", lambda p: p["text"])))
        .drop("parts")
    )


def list_groups(blocks: DataFrame) -> DataFrame:
    """List items with the number of their run of consecutive items and a level by indent."""
    order = Window.partitionBy(*PAGE).orderBy("y0", "x0", "block_no")
    item = F.col("kind") == "list_item"
    d = blocks.where(F.col("block_type") == "paragraph").withColumns({"item": item, "before": F.coalesce(F.lag(item).over(order), F.lit(False))})
    d = d.withColumn("opens", F.when(F.col("item") & ~F.col("before"), 1).otherwise(0)).withColumn(
        "list_no", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0))
    )
    own = Window.partitionBy(*PAGE, "list_no").orderBy("y0", "x0", "block_no")
    step = F.greatest(F.lit(18.0), 1.6 * F.coalesce("size", F.lit(12.0)))
    level = F.least(F.lit(8), F.greatest(F.lit(0), F.floor((F.col("x0") - F.first("x0").over(own) + 4.0) / step)))
    return d.where("item").withColumn("level_no", level.cast("int"))


def vertical_spacing(blocks: DataFrame) -> DataFrame:
    """Space before each paragraph: its gap to the block above less a fifth of its size, 0 to 30."""
    order = Window.partitionBy(*PAGE).orderBy("y0", "x0", "block_no")
    gap = F.col("y0") - F.lag("y1").over(order) - 0.2 * F.coalesce("size", F.lit(12.0))
    return blocks.withColumn("space_before", F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(30.0), gap)), F.lit(0.0))).where("block_type = 'paragraph'")


def by_page(df: DataFrame, order: list[str], visit: Callable[[list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """Rows of each page, in order, through a Python function. Pages are hashed to partitions and sorted
    there, and batches are cut at pages, so no data frame is built per page; `visit` gets the rows as
    tuples of (doc_id, page, *order, ...) and returns rows of `schema`."""
    names = [c.split()[0] for c in schema.split(", ")]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        for pdf in batches:
            held += list(pdf.itertuples(index=False, name=None))
            out: list[tuple] = []
            start = 0
            for i in range(1, len(held)):
                if held[i][0] != held[start][0] or held[i][1] != held[start][1]:
                    out += visit(held[start:i])
                    start = i
            held = held[start:]
            yield pd.DataFrame(out, columns=names)
        if held:
            yield pd.DataFrame(visit(held), columns=names)

    rest = [c for c in df.columns if c not in (*PAGE, *order)]
    keyed = df.select(*PAGE, *order, *rest).repartition(*PAGE)
    return keyed.sortWithinPartitions(*PAGE, *order).mapInPandas(walk, schema)


def _rows_of_page(rows: list[tuple]) -> list[tuple]:
    """Segments of a page to visual rows: each joins the first row whose centre is near and which it
    doesn't overlap sideways. rows: doc_id, page, cy, x0, line_key, segment_no, y0, x1, h."""
    found: list[dict] = []
    home_of = []
    for _, _, cy, x0, _, _, y0, x1, h in rows:
        home = None
        for k, r in enumerate(found):
            if abs(cy - r["sum"] / r["n"]) <= 0.45 * min(h, r["h"]) and all(x1 <= a or x0 >= b for a, b in r["spans"]):
                home = k
                break
        if home is None:
            found.append({"sum": cy, "n": 1, "h": h, "spans": [(x0, x1)], "top": y0})
            home = len(found) - 1
        else:
            r = found[home]
            r["sum"] += cy
            r["n"] += 1
            r["h"] = min(r["h"], h)
            r["spans"].append((x0, x1))
            r["top"] = min(r["top"], y0)
        home_of.append(home)
    rank = {k: i for i, k in enumerate(sorted(range(len(found)), key=lambda k: (found[k]["top"], k)))}
    return [(r[0], r[1], r[4], r[5], rank[k]) for r, k in zip(rows, home_of)]


def visual_rows(segment_rows: DataFrame) -> DataFrame:
    """Greedy rows over segments (doc_id, page, line_key, segment_no and box), page by page."""
    d = segment_rows.select(*PAGE, ((F.col("y0") + F.col("y1")) / 2).alias("cy"), "x0", "line_key", "segment_no", "y0", "x1", height().alias("h"))
    return by_page(d, ["cy", "x0", "line_key", "segment_no"], _rows_of_page, "doc_id bigint, page int, line_key string, segment_no bigint, row_no int")


def _flow_page(rows: list[tuple]) -> list[tuple]:
    """Lines of a page in reading order to paragraphs, with the tests on the paragraph so far. rows:
    doc_id, page, y0, x0, line_key, y1, x1, size, bold_ratio, item, first_share, left, right."""
    left, right = rows[0][11], rows[0][12]
    gaps = sorted(g for g in (b[2] - a[5] for a, b in zip(rows, rows[1:])) if g >= 0)
    heights = sorted(r[5] - r[2] for r in rows)
    pitch = gaps[len(gaps) // 2] if gaps else 0.3 * heights[len(heights) // 2]
    out: list[tuple] = []
    group: list[tuple] = []
    number = 0
    for cur in rows:
        new = not group
        if group:
            prev, first = group[-1], group[0]
            em, gap = max(4.0, prev[7]), cur[2] - prev[5]
            if first[9]:
                new = cur[9] or not (cur[3] >= first[3] + 0.3 * em and gap <= 0.6 * em)
            else:
                inner = min((x[3] for x in group[1:]), default=left)
                space = 0.3 * em
                wrapped = prev[6] + space + (cur[6] - cur[3]) * cur[10] > right - 0.5 * space
                new = (
                    gap > max(0.75 * pitch, 0.6 * em)
                    or abs(cur[7] - prev[7]) > 0.2 * prev[7]
                    or (prev[8] >= 0.6) != (cur[8] >= 0.6)
                    or cur[9]
                    or (prev[6] < right - 2.5 * em and not wrapped)
                    or cur[3] > min(inner, prev[3]) + 0.8 * em
                )
        if new:
            number += 1
            group = []
        group.append(cur)
        out.append((cur[0], cur[1], cur[4], number))
    return out


def flow_paragraphs(line_rows: DataFrame) -> DataFrame:
    """Paragraph number of each line with tests that look at the whole paragraph, page by page."""
    head = F.length(F.regexp_extract("text", r"^\s*(\S*)", 1)) / F.greatest(F.lit(1), F.length("text"))
    d = line_rows.join(margins(line_rows), PAGE).select(
        *PAGE, "y0", "x0", "line_key", "y1", "x1", "size", "bold_ratio", F.col("text").rlike(LIST_PREFIX).alias("item"), head.alias("head"), "left_margin", "right_margin"
    )
    return by_page(d, ["y0", "x0", "line_key"], _flow_page, "doc_id bigint, page int, line_key string, paragraph_no int")


def grid_rows(segment_rows: DataFrame, columns: int = 3, rows: int = 3, tolerance: float = 6.0) -> DataFrame:
    """Runs of at least `rows` consecutive visual rows with `columns` segments whose left edges agree."""

    def find(page: list[tuple]) -> list[tuple]:
        found, run, line = [], [], []

        def close() -> None:
            if len(run) >= rows:
                found.append((page[0][0], page[0][1], len(run), len(run[0])))

        lines: dict[int, list[float]] = {}
        for _, _, row_no, x0 in page:
            lines.setdefault(row_no, []).append(x0)
        for line in lines.values():
            if len(line) >= columns and (not run or len(line) == len(run[-1]) and all(abs(a - b) <= tolerance for a, b in zip(line, run[-1]))):
                run.append(line)
            else:
                close()
                run = [line] if len(line) >= columns else []
        close()
        return found

    return by_page(segment_rows.select(*PAGE, "row_no", "x0"), ["row_no", "x0"], find, "doc_id bigint, page int, n_rows int, n_columns int")


def style_runs(words: DataFrame) -> DataFrame:
    """Consecutive words of a line in one style merged: text, least confidence, words."""
    line = Window.partitionBy(*PAGE, "line_key").orderBy("word_no")
    d = with_line(words.where(F.col("text").isNotNull()))
    style = F.struct("bold", "italic", "underline", "source_region")
    d = d.withColumn("new", F.when(F.lag(style).over(line).eqNullSafe(style), 0).otherwise(1)).withColumn(
        "run_no", F.sum("new").over(line.rowsBetween(Window.unboundedPreceding, 0))
    )
    return d.groupBy(*PAGE, "line_key", "run_no").agg(
        F.count("*").alias("n_words"),
        F.min(F.nanvl("confidence", F.lit(0.0))).alias("confidence"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("word_no", "text"))), lambda s: s["text"]), " ").alias("text"),
    )


def ocr_sizes(words: DataFrame) -> DataFrame:
    """Size of each OCR line from the height at the 80 % index of its lettered words."""
    d = with_line(words.where(F.col("source_region").startswith("ocr") & F.col("text").rlike(r"\p{L}"))).withColumn("h", height())
    tall = d.groupBy(*PAGE, "line_key").agg(index_quantile(F.collect_list("h"), 0.8).alias("tallest"))
    return tall.withColumn("size", F.greatest(F.lit(6.0), F.least(F.lit(40.0), F.col("tallest") / 0.9)))


