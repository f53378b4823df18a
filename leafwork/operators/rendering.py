"""Rendering of laid-out words: tables by columns, margins by tags, strings of HTML, marked spans, selections."""

from __future__ import annotations

from bisect import bisect_left, insort
from itertools import groupby, pairwise
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafwork.operators.groups import by_groups, joined, keyed, kinds
from leafwork.operators.layout import GROUP_SPACE, WORD_SPACE

#: Fixed: how far, in heights of the string, duplicates may lie off each other: across, along, and at their ends.
SHIFT, TOP, END = 1.0, 0.2, 0.1
#: Fixed: the gap between lines of one paragraph, in heights, and how well their left edges meet.
LINE_GAP, LEFT_EDGE = 0.5, 0.4


class Columns:
    """Known positions of a table and the columns of text that they stand in; of equal positions the first one holds."""

    def __init__(self) -> None:
        self.column: dict[float, int] = {}
        self.rank: dict[float, int] = {}
        self.order: list[float] = []

    def add(self, at: float, column: int) -> None:
        if at == at and at not in self.column:
            self.column[at] = column
            self.rank[at] = len(self.order)
            insort(self.order, at)

    def nearest(self, x: float, most: float) -> int | None:
        """The column of the known position nearest to x, the first known of equally near ones, if it is within `most`."""
        i = bisect_left(self.order, x)
        around = self.order[max(0, i - 1) : i + 1]
        if not around:
            return None
        least = min(abs(at - x) for at in around)
        if not least <= most:
            return None
        return self.column[min((at for at in around if abs(at - x) == least), key=self.rank.__getitem__)]

    def between(self, x: float) -> int | None:
        """The column of x by the line through the nearest known positions on both sides."""
        if x in self.column:
            return self.column[x]
        i = bisect_left(self.order, x)
        if not 0 < i < len(self.order):
            return None
        low, high = self.order[i - 1], self.order[i]
        return int(self.column[low] + (x - low) * (self.column[high] - self.column[low]) / (high - low))


def table_text(baselines: list, lefts: list, rights: list, texts: list, sizes: list) -> str:
    """The words of one cluster, by baseline and left edge, as lines of text whose columns stand below each other.

    Words a space apart make a group. A group goes where an earlier one had its left edge, else its right edge, else its
    middle; else between known columns, by its left, then its right edge; else after as many spaces as fit the gap.
    """
    lines: list[str] = []
    known = Columns()
    left = min((x for x in lefts if x == x), default=float("nan"))
    rows = (r for r in zip(baselines, lefts, rights, texts, sizes, strict=True) if r[0] == r[0])
    for _, words in groupby(rows, key=itemgetter(0)):
        groups: list[list] = []  # text, x1, x2, the last word's x1 and size, the first one's size
        for _, x1, x2, text, size in words:
            least = min(groups[-1][4], size) if groups else size
            if groups and x1 - groups[-1][2] <= GROUP_SPACE * least:
                g = groups[-1]
                g[0] += (" " if x1 - g[2] > WORD_SPACE * least else "") + text
                g[2:5] = [x2, x1, size]
            else:
                groups.append([text, x1, x2, x1, size, size])
        line, edge = "", left
        for k, (text, x1, x2, last_x1, last_size, first_size) in enumerate(groups):
            n, col = len(text), len(line)
            back = 0
            found = known.nearest(x1, GROUP_SPACE * first_size)
            if found is None:
                found, back = known.nearest(x2, GROUP_SPACE * last_size), n
            if found is None:
                found, back = known.nearest((x2 + last_x1) / 2, GROUP_SPACE * last_size), n // 2
            if found is None:
                found, back = known.between(x1), 0
            if found is None:
                found, back = known.between(x2), n
            spaces = max(0, found - back - col) if found is not None else max(0, int((x1 - edge) / ((x2 - x1) / n) + 0.5)) if n and x2 > x1 else 0
            begin = col + (spaces if spaces or not k else 1)
            line = line.ljust(begin) + text
            known.add(x1, begin)
            if n > 2:
                known.add((x1 + x2) / 2, (len(line) - 1 + begin) // 2)
                known.add(x2, len(line) - 1)
            edge = x2
        lines.append(line)
    return "\n".join(lines)


def rendered_tables(words: DataFrame) -> DataFrame:
    """(doc_id, page, cluster_id, text) of words (doc_id, page, cluster_id, baseline, x1, x2, text, font_size); a task takes cluster by cluster."""
    keys, sides = ["doc_id", "page", "cluster_id"], ["baseline", "x1", "x2", "font_size"]

    def render(clusters: pa.Table, starts: np.ndarray) -> pa.Table:
        baseline, x1, x2, size = (clusters[c].to_numpy().tolist() for c in sides)
        text = clusters["text"].to_pylist()
        found = [table_text(baseline[i:j], x1[i:j], x2[i:j], text[i:j], size[i:j]) for i, j in pairwise(starts)]
        return clusters.select(keys).take(pa.array(starts[:-1])).append_column("text", pa.array(found, pa.string()))

    narrow = words.select(*keys, *[F.col(c).cast("double").alias(c) for c in sides], "text")
    kinds = {c: words.schema[c].dataType.simpleString() for c in keys}
    return by_groups(narrow, keys, ["baseline", "x1", "x2", "text"], render, ", ".join([*[f"{c} {k}" for c, k in kinds.items()], "text string"]))


def column_positions(groups: DataFrame, *keys: str) -> DataFrame:
    """groups (keys, baseline, x1, text) with col, the running width of those before on the line, one space between."""
    before = Window.partitionBy(*keys, "baseline").orderBy("x1").rowsBetween(Window.unboundedPreceding, -1)
    return groups.withColumn("col", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)))


def tagged(sections: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, page, text): sections (doc_id, page, reading_pos, category, text) in order, margins and headers in tags of their names; categories in skip are left out."""
    name = F.lower(F.replace("category", F.lit("_MARGIN"), F.lit("")))
    plain = F.col("category").isin("TEXT", "DATA")
    text = F.when(plain, F.col("text")).otherwise(F.concat(F.lit("<"), name, F.lit(">"), "text", F.lit("</"), name, F.lit(">")))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("reading_pos", text.alias("t")))), lambda s: s["t"])
    kept = sections.where(~F.col("category").isin(*skip)) if skip else sections
    return kept.groupBy("doc_id", "page").agg(F.array_join(parts, "\n").alias("text"))


def marked_spans(words: DataFrame, *keys: str) -> DataFrame:
    """(keys, mcid, span, font, x1, x2, text): runs of words (keys, pos, mcid, font, text, x1, x2) of one mark and font."""
    order = Window.partitionBy(*keys).orderBy("pos")
    fresh = (F.col("mcid") != F.lag("mcid").over(order)) | (F.col("font") != F.lag("font").over(order))
    marked = words.withColumn("span", F.sum(F.coalesce(fresh, F.lit(True)).cast("int")).over(order) - 1)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"])
    return marked.groupBy(*keys, "mcid", "span", "font").agg(F.min("x1").alias("x1"), F.max("x2").alias("x2"), F.array_join(parts, " ").alias("text"))


def replaced_spans(spans: DataFrame, actual: DataFrame, *keys: str) -> DataFrame:
    """spans with the replacement text (keys, mcid, actual) of their mark, where it has one, at the first span of the mark."""
    first = F.col("span") == F.min("span").over(Window.partitionBy(*keys, "mcid"))
    met = spans.join(actual, [*keys, "mcid"], "left").withColumn("first", first)
    return met.where(F.col("actual").isNull() | F.col("first")).withColumn("text", F.coalesce("actual", "text")).drop("actual", "first")


def without_shadows(strings: DataFrame, *keys: str) -> DataFrame:
    """strings (keys, id, text, x1, y1, x2, y2) less duplicates: the same text again, almost at the same place, after it by y, then x.

    Equal texts meet by cells of about their height, never all of a page.
    """
    height = F.col("y2") - F.col("y1")
    scale = F.ceil(F.log2(F.greatest(height, F.lit(1e-6)))).cast("int")
    cell = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("s")))
    # texts meet by two hashes, so that copies are narrow
    absent = F.col("text").isNull()
    told = [F.xxhash64("text", absent).alias("t1"), F.xxhash64(F.lit(1), "text", absent).alias("t2")]
    marked = strings.select(*keys, "id", *told, "x1", "y1", "x2", "y2", height.alias("h"), scale.alias("s"))
    left = marked.withColumn("cx", cell("x1")).withColumn("cy", cell("y1"))
    steps = F.array(F.lit(-1), F.lit(0), F.lit(1))
    right = marked.withColumn("s", F.explode(F.transform(steps, lambda d: F.col("s") + d)))
    right = right.withColumn("cx", F.explode(F.transform(steps, lambda d: cell("x1") + d))).withColumn("cy", F.explode(F.transform(steps, lambda d: cell("y1") + d)))
    a, b = left.alias("a"), right.alias("b")
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*keys, "t1", "t2", "s", "cx", "cy")]
    later = F.struct("b.y1", "b.x1", "b.id") > F.struct("a.y1", "a.x1", "a.id")
    close = (F.col("b.x1") < F.col("a.x1") + SHIFT * F.col("a.h")) & (F.abs(F.col("b.y1") - F.col("a.y1")) < TOP * F.col("a.h")) & (F.abs(F.col("b.y2") - F.col("a.y2")) < TOP * F.col("a.h")) & (F.abs(F.col("b.x2") - F.col("a.x2")) < END * F.col("a.h"))
    gone = a.join(b, [*on, later & close]).select(*[F.col(f"b.{c}").alias(c) for c in (*keys, "id")]).distinct()
    return strings.join(gone, [*keys, "id"], "left_anti")


def paragraphs(strings: DataFrame, *keys: str, line_break: str = "<br/>") -> DataFrame:
    """(keys, run, x1, y1, x2, y2, text): strings that follow each other on a line, or on lines below that begin at the same place."""
    order = Window.partitionBy(*keys).orderBy("y1", "x1", "id")
    last = lambda c: F.lag(c).over(order)
    height = last("y2") - last("y1")
    along = (F.col("y1") < last("y2")) & (F.col("x1") - last("x2") > -0.5 * height) & (F.col("x1") - last("x2") < height)
    gap = F.col("y1") - last("y2")
    below = (gap >= 0) & (gap < LINE_GAP * height) & (F.abs(F.col("x1") - last("x1")) < LEFT_EDGE)
    joint = F.when(along, F.when(F.col("x1") - last("x2") > WORD_SPACE * height, " ").otherwise("")).when(below, line_break)
    marked = strings.withColumn("joint", joint).withColumn("run", F.sum(F.col("joint").isNull().cast("int")).over(order) - 1)
    piece = F.struct("y1", "x1", "id", F.concat(F.coalesce("joint", F.lit("")), "text").alias("t"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda s: s["t"]), "")
    out = marked.groupBy(*keys, "run").agg(*[f(c).alias(c) for f, c in ((F.min, "x1"), (F.min, "y1"), (F.max, "x2"), (F.max, "y2"))], text.alias("text"))
    return out


def text_boxes(words: DataFrame) -> DataFrame:
    """words with chars: a box (char, x1, x2) for each character, of equal widths."""
    step = (F.col("x2") - F.col("x1")) / F.length("text")
    chars = F.filter(F.split("text", ""), lambda c: c != "")
    return words.withColumn("chars", F.transform(chars, lambda c, i: F.struct(c.alias("char"), (F.col("x1") + i * step).alias("x1"), (F.col("x1") + (i + 1) * step).alias("x2"))))


def padded_lines(words: DataFrame, *keys: str) -> DataFrame:
    """(keys, baseline, text): physical layout, each word at the column of its left edge, one space at least after the one before."""
    order = Window.partitionBy(*keys, "baseline").orderBy("x1")
    gap = F.col("x1") - F.coalesce(F.lag("x2").over(order), F.lit(0))
    space = F.greatest(F.round(gap).cast("int"), F.lag("x2").over(order).isNotNull().cast("int"))
    piece = F.struct("x1", F.concat(F.repeat(F.lit(" "), space), "text").alias("t"))
    return words.withColumn("piece", piece).groupBy(*keys, "baseline").agg(F.array_join(F.transform(F.array_sort(F.collect_list("piece")), lambda s: s["t"]), "").alias("text"))


def changes(*keys: np.ndarray) -> np.ndarray:
    """Whether each row differs from the one before in a key; the first one does."""
    return np.append(True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) if len(keys[0]) else np.zeros(0, bool)


def column_numbers(page: np.ndarray, x1: np.ndarray, x2: np.ndarray, box: np.ndarray) -> np.ndarray:
    """The column of each word on its page, by boxes as layout.reading_order() has them: a box opens a column where none before it, by left edge, reaches it."""
    by_box = np.lexsort((box, page))
    first = changes(page[by_box], box[by_box])
    starts = np.flatnonzero(first)
    left, right = np.minimum.reduceat(x1[by_box], starts), np.maximum.reduceat(x2[by_box], starts)
    owner, number = page[by_box][starts], box[by_box][starts]
    order = np.lexsort((number, left, owner))
    opens = changes(owner[order])
    # pages lie apart, so that the running maximum of one never reaches into the next
    apart = owner[order] * (right.max() - min(left.min(), right.min()) + 1)
    before = np.append(0, np.maximum.accumulate(right[order] + apart)[:-1])
    fresh = opens | (before < left[order] + apart)
    running = np.cumsum(fresh)
    column = np.empty(len(order), np.int64)
    column[order] = running - running[opens][np.cumsum(opens) - 1]
    out = np.empty(len(page), np.int64)
    out[by_box] = column[np.cumsum(first) - 1]
    return out


def text_by_modes(words: DataFrame, modes: tuple[str, ...], box: str | None = None) -> DataFrame:
    """(doc_id, page, and the modes' texts) of words (doc_id, page, content_pos, column_no, baseline, x1, text), one line of text for each line.

    raw takes lines and words as the content has them, physical goes down the page across its columns, reading goes down
    one column after the other. With `box`, a column of whole numbers, words have x2 instead of column_no, and columns are found by
    the boxes of words of equal `box`. Words are shuffled once, by page, whatever the number of modes; pages go to Python in batches of many.
    """
    placed = ["x2", box] if box else ["column_no"]

    def texts(pages: pa.Table, starts: np.ndarray) -> pa.Table:
        page = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        place, x1, baseline = (keyed(pages[c]) for c in ("content_pos", "x1", "baseline"))
        column = column_numbers(page, x1, keyed(pages["x2"]), keyed(pages[box])) if box else keyed(pages["column_no"])
        out = pages.select(["doc_id", "page"]).take(pa.array(starts[:-1]))
        for mode in modes:
            if mode == "raw":
                order = np.lexsort((place, baseline, column, page))
                line = changes(page[order], column[order], baseline[order])
                number = np.cumsum(line) - 1
                order = order[np.lexsort((place[order], number, place[order][line][number], page[order]))]
            elif mode == "physical":
                order = np.lexsort((place, x1, column, baseline, page))
            elif mode == "reading":
                order = np.lexsort((place, x1, baseline, column, page))
            else:
                raise ValueError(f"no such mode: {mode}")
            line = changes(page[order], baseline[order], *([] if mode == "physical" else [column[order]]))
            text = pages["text"].take(pa.array(order))
            known = pc.is_valid(text).to_numpy()
            before = np.cumsum(known) - known
            spaced = known & (before > before[line][np.cumsum(line) - 1])
            broken = line & ~changes(page[order])
            pieces = pc.binary_join_element_wise(pc.if_else(pa.array(broken), "\n", ""), pc.if_else(pa.array(spaced), " ", ""), pc.fill_null(text, ""), "")
            out = out.append_column(mode, joined(pieces, starts))
        return out

    narrow = words.select("doc_id", "page", "content_pos", *placed, "baseline", "x1", "text")
    return by_groups(narrow, ["doc_id", "page"], ["content_pos", "text"], texts, ", ".join([kinds(narrow, "doc_id", "page"), *[f"{m} string" for m in modes]]))


def text_by_mode(words: DataFrame, mode: str) -> DataFrame:
    """(doc_id, page, text) of words in one of the modes of text_by_modes()."""
    return text_by_modes(words, (mode,)).withColumnRenamed(mode, "text")


def rotated_order(rotation: Column, baseline: Column, x1: Column, x2: Column) -> list[Column]:
    """Sort keys of words: by lines, then along them, in the direction of their rotation."""
    turned = rotation.isin(1, 2)
    return [rotation, F.when(turned, -baseline).otherwise(baseline), F.when(rotation.isin(2, 3), -x2).otherwise(x1)]
