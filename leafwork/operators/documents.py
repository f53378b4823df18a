"""Document-level structures: links, outlines, destinations, trees, layers, fonts, and set operations on documents."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """df as a table in the folder that all executors share, which cuts its lineage, and the table's path."""
    spark = df.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="spark-leafwork-")
        spark.conf.set("spark.checkpoint.dir", shared)
    path = f"{shared.rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def dropped(df: DataFrame, path: str) -> None:
    """Removes a table of written() that nothing reads any more; df: any frame of the session."""
    at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def outline_tree(headings: DataFrame, doc: str = "page_id") -> DataFrame:
    """headings (doc, pos, level, title) with parent: the nearest heading before it of a lower level, null at the top.

    One running maximum for each level of heading; no join.
    """
    before = Window.partitionBy(doc).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    last = {k: F.max(F.when(F.col("level") == k, F.col("pos"))).over(before) for k in range(6)}
    parent = F.greatest(*[F.when(F.col("level") > k, last[k]) for k in range(6)])
    return headings.withColumn("parent", parent)


def ancestry(nodes: DataFrame, node: str, parent: str, doc: str, name: str) -> DataFrame:
    """(d, n, depth, line, names): for each node of a tree the nodes from its root down to itself, and their names.

    Every round doubles the ancestors that a node knows, so trees of any depth take about log2 of it in rounds, each
    written. Nodes in a cycle or below a missing parent are left out; null names are empty.
    """
    rows = nodes.select(F.col(doc).alias("d"), F.col(node).alias("n"), F.col(parent).alias("up"), F.lit(0).alias("depth"), F.array(node).alias("line"), F.array(F.coalesce(F.col(name), F.lit(""))).alias("names"))
    known, _ = written(rows)
    for _ in range(known.count().bit_length() + 1):
        if known.where("up is not null").isEmpty():
            break
        above = known.select("d", F.col("n").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"), F.col("line").alias("l"), F.col("names").alias("t"))
        moved = known.where("up is not null").join(above, ["d", "up"]).select("d", "n", F.col("next").alias("up"), (F.col("depth") + F.col("more") + 1).alias("depth"), F.concat("l", "line").alias("line"), F.concat("t", "names").alias("names"))
        known, _ = written(known.where("up is null").unionByName(moved))
    return known.where("up is null").drop("up")


def walk_down(nodes: DataFrame, node: str, parent: str, doc: str, name: str) -> DataFrame:
    """(doc, node, depth, path): names from the root down, joined by ' / '; see ancestry()."""
    return ancestry(nodes, node, parent, doc, name).select("d", "n", "depth", F.array_join("names", " / ").alias("path")).toDF(doc, node, "depth", "path")


def subtree_text(nodes: DataFrame, node: str, parent: str, doc: str, text: str, order: str, eol: str = "\n") -> DataFrame:
    """(doc, node, text): the text of each node and all below it, in the order of a column that numbers nodes depth first."""
    lines = ancestry(nodes, node, parent, doc, text).select("d", "n", F.explode("line").alias("top"))
    said = nodes.select(F.col(doc).alias("d"), F.col(node).alias("n"), F.col(order).alias("o"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("o", "t"))), lambda s: s["t"])
    return lines.join(said, ["d", "n"]).groupBy("d", "top").agg(F.array_join(parts, eol).alias("text")).toDF(doc, node, "text")


def attributes(nodes: DataFrame, stated: DataFrame, node: str, parent: str, owners: list[str]) -> DataFrame:
    """nodes with effective: the value that the first of the owners states (node, owner, value), else the nearest ancestor's."""
    rank = F.array_position(F.array(*map(F.lit, owners)), F.col("owner"))
    own = stated.where(rank > 0).groupBy(node).agg(F.min_by("value", rank).alias("_own"))
    return inherited(nodes.join(own, node, "left"), node, parent, "_own").drop("_own")


def resolved_roles(roles: DataFrame, standard: DataFrame) -> DataFrame:
    """(role, type) of a role map (role, target): the first standard type (type) on the way; roles that end nowhere or in a circle have none."""
    stop = standard.select(F.col("type").alias("_stop")).distinct()
    marked = roles.select("role", "target").join(stop, F.col("role") == F.col("_stop"), "left_anti").join(stop, F.col("target") == F.col("_stop"), "left")
    tree = marked.select("role", F.when(F.col("_stop").isNull(), F.col("target")).alias("above"), F.col("_stop").alias("own"))
    return inherited(tree, "role", "above", "own").select("role", F.col("effective").alias("type"))


def inherited(nodes: DataFrame, node: str, parent: str, value: str) -> DataFrame:
    """nodes with effective: their own value, or else the nearest ancestor's, however far up.

    Every round doubles the ancestors that a node has asked, so chains of n nodes take about log2(n) of them; nodes of
    a cycle without any value stay without. Joins are merges, so that no nodes are collected for a broadcast.
    """
    # a node asks on while it has no value; equal rows of one node are asked once
    open_up = F.when(F.col(value).isNull(), F.col(parent))
    asked, _ = written(nodes.select(F.col(node).alias("_n"), F.col(value).alias("_v"), open_up.alias("_up")).distinct())
    for _ in range(asked.count().bit_length()):
        if asked.where("_up is not null").isEmpty():
            break
        above = asked.select(F.col("_n").alias("_up"), F.col("_v").alias("_above"), F.col("_up").alias("_next"))
        asked, _ = written(asked.join(above.hint("merge"), "_up", "left").select("_n", F.coalesce("_v", "_above").alias("_v"), F.when(F.coalesce("_v", "_above").isNull(), F.col("_next")).alias("_up")))
    found = asked.select(F.col("_n").alias("_to"), F.col("_v").alias("_found")).dropDuplicates(["_to", "_found"])
    first = nodes.select("*", F.when(F.col(value).isNull(), F.col(node)).alias("_to"))
    return first.join(found.hint("merge"), "_to", "left").withColumn("effective", F.coalesce(value, "_found")).drop("_to", "_found")


def first_wins(sources: list[DataFrame], key: str) -> DataFrame:
    """The union of tables of equal columns, a key's row from the first table that has it."""
    marked = None
    for i, s in enumerate(sources):
        s = s.withColumn("_from", F.lit(i))
        marked = s if marked is None else marked.unionByName(s)
    rank = F.row_number().over(Window.partitionBy(key).orderBy("_from"))
    return marked.withColumn("_rank", rank).where("_rank = 1").drop("_from", "_rank")


def visible(states: Column, policy: Column) -> Column:
    """Whether content shows, by its layers' states (null for unknown ones, which count as on) and policy; AnyOn by default."""
    on = F.transform(states, lambda s: F.coalesce(s, F.lit(True)))
    return F.when(F.size(on) == 0, True).when(policy == "AllOn", F.forall(on, lambda s: s)).when(policy == "AllOff", F.forall(on, lambda s: ~s)).when(policy == "AnyOff", F.exists(on, lambda s: ~s)).otherwise(F.exists(on, lambda s: s))


def visible_by(expression: list | int, states: Column) -> Column:
    """A visibility expression, nested lists of Not, And, Or and layer numbers, as a column."""
    if isinstance(expression, int):
        return F.coalesce(F.get(states, F.lit(expression)), F.lit(True))
    head, *rest = expression
    parts = [visible_by(x, states) for x in rest]
    if head == "Not":
        return ~parts[0]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if head == "And" else out | p
    return out


def page_range(pages: DataFrame, first: int = 1, last: int | None = None, parity: int | None = None, page: str = "page") -> DataFrame:
    """The pages first to last, to the end if no last is given; only odd (1) or even (0) ones if parity says so.

    A range that ends before it begins is refused.
    """
    if last is not None and last < first:
        raise ValueError(f"wrong page range: {first} to {last}")
    found = pages.where(F.col(page) >= first)
    if last is not None:
        found = found.where(F.col(page) <= last)
    return found if parity is None else found.where(F.pmod(F.col(page), F.lit(2)) == parity)


def pending(listed: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return listed.join(done.select(key), key, "left_anti")


def restored(rows: DataFrame, saved: DataFrame, keys: list[str]) -> DataFrame:
    """rows with valid: whether a checkpoint has their keys."""
    return rows.join(saved.select(*keys).distinct().withColumn("valid", F.lit(True)), keys, "left").withColumn("valid", F.coalesce("valid", F.lit(False)))


def replaced(rows: DataFrame, newer: DataFrame, key: str) -> DataFrame:
    return rows.join(newer.select(key), key, "left_anti").unionByName(newer)


def concatenated(parts: list[DataFrame], key: str) -> DataFrame:
    """Tables one after the other, keys moved past the greatest before; the offsets are one number a table."""
    out, start = None, 0
    for p in parts:
        moved = p.withColumn(key, F.col(key) + start)
        out = moved if out is None else out.unionByName(moved)
        start += (p.agg(F.max(key)).first()[0] or 0) + 1
    return out


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows as often."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node) of all that edges (src, dst) reach from roots (node), roots included; cycles end as nothing new comes."""
    read = edges.sparkSession.read
    edges, _ = written(edges)
    fresh, path = written(roots.select("node").distinct())
    known, paths = fresh, [path]
    while not fresh.isEmpty():
        kind = known.schema["node"].dataType
        new = fresh.join(edges, fresh["node"] == edges["src"]).select(F.col("dst").cast(kind).alias("node")).distinct()
        fresh, path = written(new.join(known, "node", "left_anti"))
        paths.append(path)
        known = read.schema(known.schema).parquet(*paths)
    return known


def profile(events: DataFrame, name: str, value: str) -> DataFrame:
    return events.groupBy(name).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 2).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"))


def outline_insert(outline: DataFrame, doc: int, parent: int | None, pos: int, node: int, title: str) -> DataFrame:
    """outline (doc_id, node, parent, pos, title) with an entry put at pos below parent; later siblings move by one."""
    sibling = (F.col("doc_id") == doc) & F.col("parent").eqNullSafe(F.lit(parent)) & (F.col("pos") >= pos)
    moved = outline.withColumn("pos", F.when(sibling, F.col("pos") + 1).otherwise(F.col("pos")))
    row = outline.sparkSession.range(1).select(*[F.lit(v).cast(outline.schema[c].dataType).alias(c) for c, v in (("doc_id", doc), ("node", node), ("parent", parent), ("pos", pos), ("title", title))])
    return moved.unionByName(row.select(*outline.columns))


def outline_remove(outline: DataFrame, doc: int, node: int) -> DataFrame:
    """outline without an entry and all below it; later siblings close the gap."""
    mine = outline.where(F.col("doc_id") == doc)
    below = reachable(mine.where("parent is not null").select(F.col("parent").alias("src"), F.col("node").alias("dst")), mine.where(F.col("node") == node).select("node"))
    gone = below.select("node", F.lit(doc).cast(outline.schema["doc_id"].dataType).alias("doc_id"))
    at = mine.where(F.col("node") == node).select("doc_id", F.col("parent").alias("_p"), F.col("pos").alias("_at"))
    rest = outline.join(gone, ["doc_id", "node"], "left_anti").join(F.broadcast(at), "doc_id", "left")  # one row
    later = F.col("parent").eqNullSafe(F.col("_p")) & (F.col("pos") > F.col("_at"))
    return rest.withColumn("pos", F.when(later, F.col("pos") - 1).otherwise(F.col("pos"))).select(*outline.columns)


def outline_set(outline: DataFrame, docs: DataFrame, fresh: DataFrame) -> DataFrame:
    """outline with the whole outlines of docs (doc_id) replaced by fresh (doc_id, node, parent, pos, title), which may have none for some of them.

    Siblings of fresh are numbered anew from 0, in the order of their pos, ties by node; entries for documents that docs doesn't name are left out.
    """
    docs = docs.select("doc_id").distinct()
    beside = Window.partitionBy("doc_id", "parent").orderBy("pos", "node")
    put = fresh.join(docs, "doc_id", "left_semi").withColumn("pos", (F.row_number().over(beside) - 1).cast(outline.schema["pos"].dataType))
    return outline.join(docs, "doc_id", "left_anti").unionByName(put.select(*outline.columns))


def info_value(info: Column, key: str) -> Column:
    """The value of a key of a document's information, a map; null where it has none."""
    return F.try_element_at(info, F.lit(key))


def info_set(info: Column, changes: dict[str, str | None]) -> Column:
    """A document's information with some values set, and those of None removed; null counts as empty, and an empty map becomes null."""
    given = F.coalesce(info, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    kept = F.map_filter(given, lambda k, _: ~k.isin(*changes))
    new = {k: v for k, v in changes.items() if v is not None}
    out = F.map_concat(kept, F.create_map(*[F.lit(x) for kv in new.items() for x in kv])) if new else kept
    return F.when(F.size(out) > 0, out)


def unique_names(files: DataFrame, taken: DataFrame, root: str, number: str, ending: str, unique: str = "unique_name") -> DataFrame:
    """files with a name each that no other has: root-NNN.ending, numbered on past the names taken (name).

    Files of a root and ending are numbered from one more than the greatest number that a taken name of theirs has, in the order of
    `number`; a frequent root is ranked in one task.
    """
    parts = F.regexp_extract("name", r"^(.*)-([0-9]{1,9})\.([^.]*)$", 2)
    used = taken.where(parts != "").select(F.regexp_extract("name", r"^(.*)-([0-9]{1,9})\.([^.]*)$", 1).alias("_r"), F.regexp_extract("name", r"^(.*)-([0-9]{1,9})\.([^.]*)$", 3).alias("_e"), parts.cast("int").alias("_n"))
    last = used.groupBy("_r", "_e").agg(F.max("_n").alias("_last"))
    rank = F.row_number().over(Window.partitionBy(root, ending).orderBy(number))
    met = files.withColumn("_rank", rank).join(last, (F.col(root) == F.col("_r")) & (F.col(ending) == F.col("_e")), "left")
    n = F.coalesce(F.col("_last") + 1, F.lit(0)) + F.col("_rank") - 1
    return met.withColumn(unique, F.concat(F.col(root), F.lit("-"), F.lpad(n.cast("string"), F.greatest(F.lit(3), F.length(n.cast("string"))), F.lit("0")), F.lit("."), F.col(ending))).drop("_rank", "_r", "_e", "_last")


def outline_retitle(outline: DataFrame, doc: int, node: int, title: str) -> DataFrame:
    return outline.withColumn("title", F.when((F.col("doc_id") == doc) & (F.col("node") == node), title).otherwise(F.col("title")))


def qualified_names(fields: DataFrame) -> DataFrame:
    """(doc_id, node, name): form fields' names from the root down, joined by dots; fields without a name add nothing."""
    names = ancestry(fields, "node", "parent", "doc_id", "title").select("d", "n", F.array_join(F.filter("names", lambda p: p != ""), ".").alias("name"))
    return names.toDF("doc_id", "node", "name")


def latest(versions: DataFrame, key: str, version: str) -> DataFrame:
    """The row of the greatest version of each key of an append-only table; keys of any number of versions are pre-aggregated."""
    rest = [c for c in versions.columns if c != key]
    top = versions.groupBy(key).agg(F.max_by(F.struct(*rest), version).alias("_top"))
    return top.select(key, *[F.col("_top")[c].alias(c) for c in rest])


def merged_names(trees: list[DataFrame], name: str) -> DataFrame:
    """Name trees of several documents as one; of equal names the first document's stands, whatever their number."""
    marked = None
    for i, t in enumerate(trees):
        t = t.select(name, F.struct(F.lit(i).alias("_from"), *[c for c in t.columns if c != name]).alias("_row"))
        marked = t if marked is None else marked.unionByName(t)
    first = marked.groupBy(name).agg(F.min("_row").alias("_row"))
    return first.select(name, *[F.col("_row")[c].alias(c) for c in trees[0].columns if c != name])


def inside_links(strings: DataFrame, links: DataFrame, by: list[str]) -> DataFrame:
    """strings (by, id, x1, x2) with the link (by, link, lx1, lx2) whose box holds them, the first of several; null without.

    by names the page and the line, so boxes meet by an equi-join.
    """
    held = (F.col("x1") >= F.col("lx1")) & (F.col("x2") <= F.col("lx2"))
    found = strings.join(links, by).where(held).groupBy(*by, "id").agg(F.min("link").alias("link"))
    return strings.join(found, [*by, "id"], "left")


def first_match(rows: DataFrame, cache: DataFrame, key: str, order: str) -> DataFrame:
    """rows with the columns of the first row of their key in cache, by order; null where it has none."""
    rest = [c for c in cache.columns if c not in (key, order)]
    first = cache.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("_hit"))
    return rows.join(first, key, "left").select(*rows.columns, *[F.col("_hit")[c].alias(c) for c in rest])


def new_fonts(fonts: DataFrame, start: int, n: int, page: str = "page_id") -> DataFrame:
    """(font, page) of the fonts that the pages from start on, n of them, show first: what a scan that goes on from a cursor tells."""
    shown = fonts.groupBy("font").agg(F.min(page).alias(page))
    return shown.where((F.col(page) >= start) & (F.col(page) < start + n))
