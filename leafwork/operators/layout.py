"""Page layout: lines, clusters of words, sections, reading order and rendering.

Rules are per page or cluster, so every operator partitions by (doc_id, page) at the finest that its semantics allow.
Order-dependent geometry runs page by page in Arrow batches of many pages; all else is built-in expressions.
"""

from __future__ import annotations

import heapq
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafwork.operators.documents import dropped, written
from leafwork.operators.groups import begins, by_groups, by_runs, doubles, exceeds, extreme, joined, kinds, lagged

#: Fixed: shares of the page's height and width that make a margin, and the limits of the text rule.
HEADER, FOOTER, LEFT, RIGHT = 0.08, 0.90, 0.06, 0.95
DENSITY, WORDS_PER_LINE = 0.7, 5
#: Fixed: word gaps, in font sizes.
WORD_BREAK, OVERLAP_BREAK, WORD_SPACE, GROUP_SPACE = 0.1, 0.2, 0.1, 0.9
#: Fixed: distances of words of one cluster, in font sizes, along and across the lines.
NEAR_X, NEAR_Y = 1.0, 1.4
#: Sides of the cells of a proximity join, in reaches: wider ones copy less and compare more.
NEAR_CELLS = 8
#: Fixed: characters under TINY in width and height, and how many of them a page may have.
TINY, TINY_MOST = 3, 50_000
#: Texts that the pattern ^\\s$ finds: white space, and a line's end after it.
BLANKS = pa.array([s + e for s in " \t\n\v\f\r" for e in ("", "\n", "\r", "\r\n", "\x85", "\u2028", "\u2029") if s + e != "\r\n"])
#: Fixed: the share of slant that makes text diagonal, and the size from which a lone capital is a drop cap.
DIAGONAL, DROP_CAP = 0.1, 20


def is_alphabetic(text: Column) -> Column:
    return text.rlike("[A-Za-z]")


def rotation_class(m0: Column, m1: Column, m2: Column, m3: Column) -> Column:
    """Quarter turns of a font matrix, by its greater diagonal."""
    upright = F.abs(m0 * m3) > F.abs(m1 * m2)
    return F.when(upright, F.when((m0 > 0) | (m3 < 0), 0).otherwise(2)).otherwise(F.when(m2 > 0, 1).otherwise(3))


def is_diagonal(m0: Column, m1: Column) -> Column:
    return F.when(F.abs(m0) >= F.abs(m1), F.abs(m1) > DIAGONAL * F.abs(m0)).otherwise(F.abs(m0) > DIAGONAL * F.abs(m1))


def is_drop_cap(text: Column, size: Column) -> Column:
    return (F.length(text) == 1) & text.rlike("^\\p{Lu}$") & (size >= DROP_CAP)


def shown(text: Column, blank: Column) -> Column:
    """What an empty glyph stands for: a space, unless it is one."""
    return F.when(blank & ~text.rlike("^\\s$"), F.lit(" ")).otherwise(text)


def sound(chars: pa.Table, width: float | None, height: float | None) -> pa.Table:
    """chars without NUL and NaN, and those inside the page if its width and height are given."""
    x1, x2, base = (doubles(chars[c]) for c in ("x1", "x2", "baseline"))
    rules = [pc.invert(pc.fill_null(pc.is_nan(c), False)) for c in (x1, x2, base)] + [pc.not_equal(chars["text"], "\0")]
    if width is not None:
        rules += [pc.greater_equal(x2, 0.0), pc.less_equal(x1, float(width)), pc.greater_equal(base, 0.0), pc.less_equal(base, float(height))]
    return chars.filter(reduce(pc.and_, [pc.fill_null(r, False) for r in rules])).combine_chunks()


def bounds(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where the groups of a table begin, and the last ends."""
    return marks(np.concatenate([[True], begins(table, keys)])[: len(table)])


def uncrowded(chars: pa.Table, starts: np.ndarray, most: int) -> np.ndarray:
    """Which characters stay if of those under TINY both ways each page keeps the first `most`; those of one char_pos share a number."""
    tiny = pc.and_kleene(exceeds(float(TINY), pc.subtract(doubles(chars["x2"]), doubles(chars["x1"]))), exceeds(float(TINY), doubles(chars["font_size"])))
    count = np.concatenate([[0], np.cumsum(pc.fill_null(tiny, False).to_numpy())])
    begin = np.union1d(starts, np.flatnonzero(begins(chars, ["char_pos"])) + 1)
    number = np.repeat(count[begin[1:]], np.diff(begin)) - np.repeat(count[starts[:-1]], np.diff(starts))
    return pc.fill_null(pc.or_kleene(pc.invert(tiny), pa.array(number <= most)), False).to_numpy()


def page_chars(chars: pa.Table, width: float | None, height: float | None, most: int) -> pa.Table:
    """What on_page_chars() keeps of whole pages."""
    inside = sound(chars, width, height)
    return inside.filter(pa.array(uncrowded(inside, bounds(inside, ["doc_id", "page"]), most))).combine_chunks()


def on_page_chars(chars: DataFrame, width: float, height: float) -> DataFrame:
    """chars inside the page, without NUL and NaN; of characters under TINY both ways the first TINY_MOST of each page.

    Characters may come as runs: rows whose char_pos, text, x1 and x2 are lists.
    """
    most = TINY_MOST
    return by_runs(chars, ["doc_id", "page"], ["char_pos"], lambda pages, starts: page_chars(pages, width, height, most), kinds(chars, *chars.columns))


def chars_to_words(chars: DataFrame, width: float | None = None, height: float | None = None) -> DataFrame:
    """(doc_id, page, word, text, x1, x2, baseline) from (doc_id, page, char_pos, text, x1, x2, baseline, font_size), and rotation, if it is there.

    A word ends at white space, a change of baseline, size or rotation, a gap of more than 0.1 or an overlap of more
    than 0.2 font sizes. A character within 0.1 font sizes of the one before, the same, on its baseline, is fake bold
    and goes. NaN positions and NUL characters go. With width and height, only what on_page_chars() keeps is read.
    Characters may come as runs, as there. Pages go to Python many at a time, sorted once.
    """
    own, most = ["doc_id", "page"], TINY_MOST
    turned = ["rotation"] if "rotation" in chars.columns else []
    narrow = chars.select(*own, "char_pos", "text", "x1", "x2", "baseline", "font_size", *turned)

    def found(pages: pa.Table, _: np.ndarray) -> pa.Table:
        pages = sound(pages, None, None) if width is None else page_chars(pages, width, height, most)
        before = lambda c: lagged(c, first)
        moved = lambda c: pc.abs(pc.subtract(c, before(c)))
        first = np.concatenate([[True], begins(pages, own)])[: len(pages)]
        x1, size, base = (doubles(pages[c]) for c in ("x1", "font_size", "baseline"))
        near = [exceeds(pc.multiply(size, 0.1), moved(x1)), exceeds(pc.multiply(size, 0.2), moved(base)), pc.equal(pages["text"], before(pages["text"]))]
        pages = pages.filter(pc.invert(reduce(pc.and_, [pc.fill_null(c, False) for c in near]))).combine_chunks()
        first = np.concatenate([[True], begins(pages, own)])[: len(pages)]
        size, base, blank = doubles(pages["font_size"]), doubles(pages["baseline"]), pc.is_in(pages["text"], BLANKS)
        gap = pc.subtract(doubles(pages["x1"]), before(doubles(pages["x2"])))
        breaks = [exceeds(gap, pc.multiply(size, WORD_BREAK)), exceeds(pc.multiply(size, -OVERLAP_BREAK), gap), before(blank)]
        breaks += [exceeds(*p) for c in (base, size) for p in ((c, before(c)), (before(c), c))]
        breaks += [pc.not_equal(pages[c], before(pages[c])) for c in turned]
        count = np.cumsum(pc.fill_null(reduce(pc.or_kleene, breaks), True).to_numpy())
        word = count - np.repeat(count[first], np.diff(marks(first)))
        shown = pages.append_column("word", pa.array(word, pa.int64())).filter(pc.invert(blank)).combine_chunks()
        at = bounds(shown, [*own, "word"])
        out = shown.select([*own, "word"]).take(pa.array(at[:-1]))
        parts = {"text": joined(shown["text"], at), "x1": extreme(shown["x1"], at[:-1], True), "x2": extreme(shown["x2"], at[:-1], False), "baseline": extreme(shown["baseline"], at[:-1], True)}
        for name, column in parts.items():
            out = out.append_column(name, column)
        return out

    return by_runs(narrow, own, ["char_pos", "text"], found, f"{kinds(narrow, *own)}, word long, {kinds(narrow, 'text', 'x1', 'x2', 'baseline')}")


def line_boxes(words: DataFrame, *keys: str) -> DataFrame:
    """The box of every line (keys, baseline): its union of word boxes, words, and sum of word widths."""
    alpha = F.count_if(is_alphabetic(F.col("text")))
    return words.groupBy(*keys, "baseline").agg(F.min("x1").alias("x1"), F.max("x2").alias("x2"), F.count(F.lit(1)).alias("n_words"), F.sum(F.col("x2") - F.col("x1")).alias("ink"), alpha.alias("alpha_words"))


def cluster_boxes(words: DataFrame, *keys: str) -> DataFrame:
    """One row for each cluster (keys): box, lines, words, alphabetic words, and the density of its lines of two words or more."""
    lines = line_boxes(words, *keys)
    many = F.col("n_words") > 1
    ink, room = F.sum(F.when(many, F.col("ink"))), F.sum(F.when(many, F.col("x2") - F.col("x1")))
    return lines.groupBy(*keys).agg(
        F.min("x1").alias("x1"), F.min("baseline").alias("y1"), F.max("x2").alias("x2"), (F.max("baseline") + 1).alias("y2"),
        F.count(F.lit(1)).alias("n_lines"), F.sum("n_words").alias("n_words"), F.sum("alpha_words").alias("alpha_words"),
        F.round(F.coalesce(ink / room, F.lit(0.0)), 6).alias("density"),
    )


def body_category() -> Column:
    """TEXT for clusters of dense lines of many words and for single lines, DATA for others."""
    rule = (F.col("n_lines") > 1) & (F.col("density") > DENSITY) & (F.col("alpha_words") / F.col("n_lines") > WORDS_PER_LINE)
    return F.when(rule | (F.col("n_lines") == 1), "TEXT").otherwise("DATA")


def page_category(width: float, height: float) -> Column:
    """Margin labels by box, later rules winning in the order header, left, footer, right; the body's label otherwise."""
    return F.when(F.col("x1") >= RIGHT * width, "RIGHT_MARGIN").when(F.col("y1") >= FOOTER * height, "FOOTER").when(F.col("x2") <= LEFT * width, "LEFT_MARGIN").when(F.col("y2") <= HEADER * height, "HEADER").otherwise(body_category())


def near_words(x1: np.ndarray, x2: np.ndarray, y: np.ndarray, size: np.ndarray, turn: np.ndarray, ids: np.ndarray, near_x: float, near_y: float) -> np.ndarray:
    """The cluster of each word of one page: the least word of all it reaches by steps to near words of its rotation.

    Words come by rotation, then height, so that each meets only those within reach above and below.
    """
    root = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
    reach, place = near_y * size.max(), turn * (y.max() - y.min() + 2 * near_y * size.max() + 1) + y - y.min()
    a, b = [], []
    for i in range(0, len(ids), 64):
        part = slice(i, i + 64)
        low = np.searchsorted(place, place[part][0] - reach, side="left")
        other = slice(low, np.searchsorted(place, place[part][-1] + reach, side="right"))
        least = np.minimum(size[part, None], size[None, other])
        dx = np.minimum.reduce([np.abs(p[part, None] - q[None, other]) for p in (x1, x2) for q in (x1, x2)])
        dx[(x1[part, None] <= x2[None, other]) & (x1[None, other] <= x2[part, None])] = 0
        dy = np.abs(y[part, None] - y[None, other])
        p, q = np.nonzero((dx <= near_x * least) & (dy <= near_y * least) & (turn[part, None] == turn[None, other]))
        a.append(p + i)
        b.append(q + low)
    a, b = np.concatenate(a), np.concatenate(b)
    a, b = a[a < b], b[a < b]
    at = np.empty(len(root), np.int64)
    at[root] = np.arange(len(root))
    while True:  # roots are ranks of ids; each round also looks up what the root itself has found
        old = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = np.minimum(root, root[at[root]])
        if (old == root).all():
            break
    return np.sort(ids)[root]


def cluster_words(words: DataFrame, near_x: float = NEAR_X, near_y: float = NEAR_Y) -> DataFrame:
    """(doc_id, page, word_id, cluster_id): single linkage with a cut-off, by page and rotation. A task takes page by page."""
    turn = F.col("rotation") if "rotation" in words.columns else F.lit(0)
    places = {"x1": F.col("x1"), "x2": F.col("x2"), "row": F.col("row"), "font_size": F.col("font_size"), "rotation": turn}
    narrow = words.select("doc_id", "page", F.col("word_id").cast("long").alias("word_id"), *[c.cast("double").alias(k) for k, c in places.items()])
    kind = narrow.schema["doc_id"].dataType.simpleString()

    def clusters(pages: pa.Table, starts: np.ndarray) -> pa.Table:
        x1, x2, y, size, turns, ids = (pages[c].to_numpy() for c in ("x1", "x2", "row", "font_size", "rotation", "word_id"))
        found = [near_words(x1[i:j], x2[i:j], y[i:j], size[i:j], turns[i:j], ids[i:j], near_x, near_y) for i, j in pairwise(starts)]
        return pa.table({"doc_id": pages["doc_id"], "page": pages["page"].cast(pa.int32()), "word_id": pages["word_id"], "cluster_id": np.concatenate(found)})

    return by_groups(narrow, ["doc_id", "page"], ["rotation", "row", "word_id"], clusters, f"doc_id {kind}, page int, word_id long, cluster_id long")


def clusters_by_size(clustered: DataFrame) -> DataFrame:
    """(doc_id, page, cluster_id, n, size_rank): a page's clusters by their numbers of words, the largest first, ties by id."""
    sizes = clustered.groupBy("doc_id", "page", "cluster_id").agg(F.count(F.lit(1)).alias("n"))
    return sizes.withColumn("size_rank", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy(F.desc("n"), "cluster_id")))


def touched_cells(points: DataFrame, dx: float, dy: float) -> DataFrame:
    """points (x, y) with (cx, cy), once for each cell of NEAR_CELLS reaches that lies within dx and dy of them."""
    # a little more than the reach, so that no rounding loses a pair at its end
    along = lambda c, reach: F.explode(F.sequence(F.floor((F.col(c) - 1.001 * reach) / (NEAR_CELLS * reach)), F.floor((F.col(c) + 1.001 * reach) / (NEAR_CELLS * reach))))
    return points.withColumn("cx", along("x", dx)).withColumn("cy", along("y", dy))


def near_pairs(left: DataFrame, right: DataFrame, by: list[str], dx: float, dy: float) -> DataFrame:
    """Pairs of points (by, id, x, y) within dx and dy: a proximity join on grid cells instead of all pairs.

    Cells are NEAR_CELLS times as wide and high as the reach, and the right side is copied to those that its reach touches,
    1.6 on average, so the equi-join on the cell finds each pair once. Other columns come along as left_<name> and right_<name>.
    Sides are merged, never broadcast, so nothing of them passes the driver.
    """
    wide, high = NEAR_CELLS * dx, NEAR_CELLS * dy
    more = lambda side, name: [F.col(c).alias(f"{name}_{c}") for c in side.columns if c not in (*by, "id", "x", "y")]
    own = left.select(*by, F.col("id").alias("left_id"), F.col("x").alias("lx"), F.col("y").alias("ly"), *more(left, "left"), F.floor(F.col("x") / wide).alias("cx"), F.floor(F.col("y") / high).alias("cy"))
    copies = touched_cells(right, dx, dy)
    around = copies.select(*by, F.col("id").alias("right_id"), F.col("x").alias("rx"), F.col("y").alias("ry"), *more(right, "right"), "cx", "cy")
    return own.join(around.hint("merge"), [*by, "cx", "cy"]).where((F.abs(F.col("lx") - F.col("rx")) <= dx) & (F.abs(F.col("ly") - F.col("ry")) <= dy)).drop("cx", "cy")


def marks(flags: np.ndarray) -> np.ndarray:
    """Where flags are set, and the end."""
    return np.append(np.flatnonzero(flags), len(flags))


def spaced(words: pa.Table, first: np.ndarray, space: float) -> tuple[pa.Array, pa.Array]:
    """(gaps to the word before, texts with a space before them where the gap is over `space`) of words in order; first: whether a word begins a line."""
    gap = pc.subtract(doubles(words["x1"]), lagged(doubles(words["x2"]), first))
    return gap, pc.binary_join_element_wise(pc.if_else(pc.fill_null(exceeds(gap, space), False), " ", ""), words["text"], "")


def word_groups(words: DataFrame, *keys: str, gap: float | None = GROUP_SPACE, space: float = WORD_SPACE) -> DataFrame:
    """(keys, baseline, grp, x1, x2, text): words of a line joined while gaps are at most `gap`, with a space above `space`.

    A given gap must be over 0 and at most 10; None joins all words of a line. Lines go to Python in batches of many.
    """
    if gap is not None and not 0 < gap <= 10:
        raise ValueError(f"no such gap between columns: {gap}")
    by = [*keys, "baseline"]

    def grouped(lines: pa.Table, starts: np.ndarray) -> pa.Table:
        first = np.zeros(len(lines), bool)
        first[starts[:-1]] = True
        step, pieces = spaced(lines, first, space)
        fresh = pc.is_null(step) if gap is None else pc.fill_null(exceeds(step, float(gap)), True)
        at = marks(fresh.to_numpy())
        number = np.arange(len(at) - 1)
        of_line = np.searchsorted(starts, at[:-1], side="right") - 1
        grp = number - np.searchsorted(at, starts[:-1])[of_line]
        found = {"grp": pa.array(grp, pa.int64()), "x1": extreme(lines["x1"], at[:-1], True), "x2": extreme(lines["x2"], at[:-1], False), "text": pc.utf8_ltrim(joined(pieces, at), characters=" ")}
        out = lines.select(by).take(pa.array(at[:-1]))
        for name, column in found.items():
            out = out.append_column(name, column)
        return out

    narrow = words.select(*by, "x1", "x2", "text")
    return by_groups(narrow, by, ["x1", "x2", "text"], grouped, f"{kinds(narrow, *by)}, grp long, {kinds(narrow, 'x1', 'x2', 'text')}")


def page_text(words: DataFrame, eol: str = "\n") -> DataFrame:
    """(doc_id, page, text): the words of a page in reading order, spaces where words are apart, eol between lines.

    Words may come as runs: rows whose text, x1 and x2 are lists. Pages go to Python many at a time, sorted once.
    """
    own = ["doc_id", "page"]

    def whole(pages: pa.Table, starts: np.ndarray) -> pa.Table:
        line = np.concatenate([[True], begins(pages, [*own, "baseline"])])
        pieces = spaced(pages, line, WORD_SPACE)[1]
        line[starts[:-1]] = False
        ends = pc.if_else(pa.array(line), eol, "")
        text = joined(pc.binary_join_element_wise(ends, pc.fill_null(pieces, ""), ""), starts)
        return pages.select(own).take(pa.array(starts[:-1])).append_column("text", text)

    narrow = words.select(*own, "baseline", "x1", "x2", "text")
    return by_runs(narrow, own, ["baseline", "x1", "x2", "text"], whole, kinds(narrow, *own, "text"))


def merged_margins(boxes: DataFrame) -> DataFrame:
    """boxes (doc_id, page, box_id, category, x1, y1, x2, y2) with those of one margin of a page put together: n of them, under the least id.

    Headers, footers and side margins are margins; other boxes stay as they are, each with n = 1, and boxes without a category as well.
    """
    margin = F.coalesce(F.col("category").isin("HEADER", "FOOTER", "LEFT_MARGIN", "RIGHT_MARGIN"), F.lit(False))
    least, most = ([f(c).alias(c) for c in cs] for f, cs in ((F.min, ("x1", "y1")), (F.max, ("x2", "y2"))))
    whole = boxes.groupBy("doc_id", "page", "category", F.when(margin, None).otherwise(F.col("box_id")).alias("_own"))
    return whole.agg(F.min("box_id").alias("box_id"), *least, *most, F.count(F.lit(1)).alias("n")).select("doc_id", "page", "box_id", "category", "x1", "y1", "x2", "y2", "n")


def merge_boxes(boxes: dict[int, tuple], fixed: np.ndarray) -> list[tuple]:
    """(box_id, merged_id, x1, y1, x2, y2): boxes of one page merged nearest first, unless the union hits a fixed one; ties by id.

    Distances wait in a heap; those of boxes that have since grown or gone are passed over.
    """
    owner, grown = {k: k for k in boxes}, dict.fromkeys(boxes, 0)
    away = lambda p, q: max(p[0] - q[2], q[0] - p[2], 0) ** 2 + max(p[1] - q[3], q[1] - p[3], 0) ** 2
    near = [(away(boxes[i], boxes[j]), i, j, 0, 0) for i in boxes for j in boxes if i < j]
    heapq.heapify(near)
    while near:
        _, i, j, a, b = heapq.heappop(near)
        if i not in boxes or j not in boxes or (grown[i], grown[j]) != (a, b):
            continue
        p, q = boxes[i], boxes[j]
        x1, y1, x2, y2 = union = (min(p[0], q[0]), min(p[1], q[1]), max(p[2], q[2]), max(p[3], q[3]))
        if ((fixed[:, 0] <= x2) & (x1 <= fixed[:, 2]) & (fixed[:, 1] <= y2) & (y1 <= fixed[:, 3])).any():
            continue  # until one of the two grows
        boxes[i], grown[i] = union, grown[i] + 1
        del boxes[j]
        owner[j] = i
        for k in boxes:
            if k != i:
                low, high = min(i, k), max(i, k)
                heapq.heappush(near, (away(boxes[low], boxes[high]), low, high, grown[low], grown[high]))

    def last(k: int) -> int:
        while owner[k] != k:
            k = owner[k]
        return k

    return [(k, last(k), *boxes[last(k)]) for k in sorted(owner)]


def data_regions(boxes: DataFrame) -> DataFrame:
    """(doc_id, page, box_id, merged_id, x1, y1, x2, y2) of the UNKNOWN boxes of (doc_id, page, box_id, category, x1, y1, x2, y2)."""
    sides = ["x1", "y1", "x2", "y2"]
    names = ["doc_id", "page", "box_id", "merged_id", *sides]

    def regions(pages: pa.Table, starts: np.ndarray) -> pa.Table:
        place = np.stack([pages[c].to_numpy() for c in sides], axis=1)
        unknown = pc.fill_null(pc.equal(pages["category"], "UNKNOWN"), False).to_numpy()
        docs, numbers, ids = (pages[c].to_pylist() for c in ("doc_id", "page", "box_id"))
        rows = []
        for i, j in pairwise(starts):
            open_ = {ids[k]: tuple(place[k].tolist()) for k in range(i, j) if unknown[k]}
            rows += [(docs[i], numbers[i], *r) for r in merge_boxes(open_, place[i:j][~unknown[i:j]])]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), *[pa.float64()] * 4]
        return pa.table([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    narrow = boxes.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("page").cast("int").alias("page"), F.col("box_id").cast("long").alias("box_id"), "category", *[F.col(c).cast("double").alias(c) for c in sides])
    return by_groups(narrow, ["doc_id", "page"], ["box_id"], regions, "doc_id long, page int, box_id long, merged_id long, x1 double, y1 double, x2 double, y2 double")


def attach_scripts(candidates: DataFrame, cap: int = 4) -> DataFrame:
    """(doc_id, page, script_id, target_id): scripts attached to targets, nearest pairs first.

    candidates: (doc_id, page, script_id, target_id, distance). A script goes to one target, a target takes up to
    `cap`; ties by ids. Greedy acceptance depends on all earlier ones of the page, so it runs page by page.
    """
    names = ["doc_id", "page", "script_id", "target_id"]

    def accept(pages: pa.Table, starts: np.ndarray) -> pa.Table:
        scripts, targets, kept = pages["script_id"].to_pylist(), pages["target_id"].to_pylist(), []
        for i, j in pairwise(starts):
            taken, full = set(), {}
            for k in range(i, j):
                s, t = scripts[k], targets[k]
                if s not in taken and t not in taken and full.get(t, 0) < cap:
                    taken.add(s)
                    full[t] = full.get(t, 0) + 1
                    kept.append(k)
        return pages.select(names).take(pa.array(kept, pa.int64()))

    narrow = candidates.select(*[F.col(c).cast("int" if c == "page" else "long").alias(c) for c in names], "distance")
    return by_groups(narrow, names[:2], [F.asc_nulls_last("distance"), "script_id", "target_id"], accept, "doc_id long, page int, script_id long, target_id long")


#: Of the target's font size: how large a script may be, how far from the tail it begins, and how far off the baseline it stands.
SCRIPT_SIZE, SCRIPT_GAP, SCRIPT_OFF = 0.85, 0.6, 0.8


def script_chains(words: DataFrame) -> DataFrame:
    """(doc_id, page, word_id, head_id): each word with the word that it is attached to as a script, itself if to none.

    words: (doc_id, page, word_id, x1, x2, baseline, font_size). A script is smaller than its target, begins near the
    target's tail and stands off its baseline by less than its height. Each round pairs targets and scripts that are each
    other's nearest, ties by ids; the script's own tail becomes the target's, so that chains grow and scripts may have
    scripts. Rounds end when nothing is attached, after as many as the longest chain has words; each is a proximity join on
    grid cells, written, and all joins are merges, so that nothing is collected for a broadcast. Words with a null place or size are attached to none.
    """
    own = ["doc_id", "page"]
    placed = words.where("x1 is not null and x2 is not null and baseline is not null and font_size > 0")
    now, path = written(placed.select(*own, "word_id", F.col("x1").cast("double").alias("x1"), F.col("x2").cast("double").alias("tail"), F.col("baseline").cast("double").alias("base"), F.col("font_size").cast("double").alias("size")))
    largest = now.agg(F.max("size")).first()[0]
    attached, paths = [], []
    while largest:
        script = now.select(*own, F.col("word_id").alias("id"), F.col("x1").alias("x"), F.col("base").alias("y"), "size", "tail")
        target = now.select(*own, F.col("word_id").alias("id"), F.col("tail").alias("x"), F.col("base").alias("y"), "size")
        near = near_pairs(script, target, own, SCRIPT_GAP * largest, SCRIPT_OFF * largest).where("left_id <> right_id")
        reach = F.col("right_size")
        fits = (F.col("left_size") <= SCRIPT_SIZE * reach) & (F.abs(F.col("lx") - F.col("rx")) <= SCRIPT_GAP * reach) & (F.abs(F.col("ly") - F.col("ry")) <= SCRIPT_OFF * reach)
        away = F.pow(F.col("lx") - F.col("rx"), F.lit(2)) + F.pow(F.col("ly") - F.col("ry"), F.lit(2))
        chosen = near.where(fits).groupBy(*own, "left_id").agg(F.min(F.struct(away.alias("d"), "right_id", "left_tail")).alias("t"))
        pairs = chosen.groupBy(*own, F.col("t.right_id").alias("right_id")).agg(F.min(F.struct("t.d", "left_id", "t.left_tail")).alias("s"))
        found, where = written(pairs.select(*own, F.col("s.left_id").alias("left_id"), "right_id", F.col("s.left_tail").alias("more")))
        paths.append(where)
        if found.isEmpty():
            break
        attached.append(found)
        # a pair's target may itself be a script of this round; what it takes in follows it
        told = found.select(*own, F.col("left_id").alias("word_id"), F.lit(True).alias("gone"), F.lit(None).cast("double").alias("more")).unionByName(found.select(*own, F.col("right_id").alias("word_id"), F.lit(None).cast("boolean").alias("gone"), "more"))
        told = told.groupBy(*own, "word_id").agg(F.max("gone").alias("gone"), F.max("more").alias("more"))
        before = path
        now, path = written(now.join(told.hint("merge"), [*own, "word_id"], "left").where("gone is null").withColumn("tail", F.greatest("tail", F.coalesce("more", "tail"))).drop("gone", "more"))
        dropped(now, before)
    out = words.select(*own, "word_id")
    if not attached:
        return out.withColumn("head_id", F.col("word_id"))
    links = attached[0]
    for f in attached[1:]:
        links = links.unionByName(f)
    heads, _ = written(links.select(*own, F.col("left_id").alias("word_id"), F.col("right_id").alias("head_id")))
    for p in paths:
        dropped(heads, p)
    return out.join(heads.hint("merge"), [*own, "word_id"], "left").withColumn("head_id", F.coalesce("head_id", "word_id"))


def reading_order(boxes: DataFrame) -> DataFrame:
    """boxes with (column_no, reading_pos): header first, margins, body, footer; the body by columns of overlapping x, then y."""
    rank = F.when(F.col("category") == "HEADER", 0).when(F.col("category") == "LEFT_MARGIN", 1).when(F.col("category") == "RIGHT_MARGIN", 2).when(F.col("category") == "FOOTER", 4).otherwise(3)
    by_x = Window.partitionBy("doc_id", "page", "rank").orderBy("x1", "y1", "box_id")
    reach = F.max("x2").over(by_x.rowsBetween(Window.unboundedPreceding, -1))
    ranked = boxes.withColumn("rank", rank).withColumn("fresh", (F.coalesce(reach, F.lit(-1e18)) < F.col("x1")).cast("int"))
    ranked = ranked.withColumn("column_no", F.sum("fresh").over(by_x) - 1)
    order = Window.partitionBy("doc_id", "page").orderBy("rank", "column_no", "y1", "x1", "box_id")
    return ranked.withColumn("reading_pos", F.row_number().over(order) - 1).drop("rank", "fresh")


def align_baselines(words: DataFrame) -> DataFrame:
    """words (doc_id, page, cluster_id, word_id, x1, y1, y2, baseline, font_size) with small baseline steps taken out.

    In reading order, a word that overlaps the last line's box and is off its baseline by less than half its font
    size moves there; a word below that box starts a new one. Each word depends on those before, so it runs by cluster.
    """

    moved = ["y1", "y2", "baseline"]

    def align(clusters: pa.Table, starts: np.ndarray) -> pa.Table:
        y1, y2, baseline, size = (clusters[c].to_numpy().tolist() for c in (*moved, "font_size"))
        shift = []
        for i, j in pairwise(starts):
            bottom, line = -np.inf, -np.inf
            for k in range(i, j):
                if bottom <= y1[k]:
                    bottom, line = y2[k], baseline[k]
                    shift.append(0.0)
                else:
                    shift.append(line - baseline[k] if abs(line - baseline[k]) < 0.5 * size[k] else 0.0)
        for c in moved:
            at = clusters.column_names.index(c)
            clusters = clusters.set_column(at, c, pa.array(clusters[c].to_numpy() + np.array(shift), clusters.schema.field(c).type, from_pandas=True))
        return clusters

    return by_groups(words, ["doc_id", "page", "cluster_id"], [F.asc_nulls_last(c) for c in ("baseline", "x1", "word_id")], align, words.schema)


def merge_fragments(words: DataFrame, *keys: str) -> DataFrame:
    """(keys, baseline, x1, x2, text): neighbours on a baseline at most 0.1 font sizes apart become one word, by pairs.

    Pairs don't chain: of three such neighbours the first two merge and the third stays.
    """
    order = Window.partitionBy(*keys, "baseline").orderBy("x1", "x2", "text")
    least = F.least("font_size", F.lag("font_size").over(order))
    apart = F.coalesce(F.col("x1") - F.lag("x2").over(order) > WORD_SPACE * least, F.lit(True))
    marked = words.withColumn("run", F.sum(apart.cast("int")).over(order))
    inside = Window.partitionBy(*keys, "baseline", "run").orderBy("x1", "x2", "text")
    paired = marked.withColumn("pair", F.floor((F.row_number().over(inside) - 1) / 2))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x1", "x2", "text"))), lambda s: s["text"]), "")
    return paired.groupBy(*keys, "baseline", "run", "pair").agg(F.min("x1").alias("x1"), F.max("x2").alias("x2"), text.alias("text")).drop("run", "pair")
