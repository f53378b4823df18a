"""Registered formats, ordered trees, objects, programs, cursors and lines of two directions: brute force and odd cases."""

from __future__ import annotations

import gzip
import random
import struct
import unicodedata

import pytest
from pyspark.sql import functions as F

from leafwork.functions import text
from leafwork.operators import objects, trees
from leafwork.sources import registered
from leafwork.streaming import streams


# registered formats


def glyph_file(path, rows):
    path.write_bytes(gzip.compress(b"".join(struct.pack("<IQii", c, n, w, h) + b for c, n, w, h, b in rows)))


def test_glyph_files_by_format(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(registered, "READ_BYTES", 7)
    registered.register(spark)
    glyph_file(tmp_path / "a.glyphs.gz", [(65, 3, 2, 2, b"abcd"), (66, 1, 0, 0, b""), (67, 9, 3, 1, b"xyz")])
    whole = gzip.compress(struct.pack("<IQii", 68, 1, 1, 1) + b"q" + struct.pack("<IQii", 69, 1, 9, 9) + b"short")
    (tmp_path / "b.glyphs.gz").write_bytes(whole)
    (tmp_path / "c.glyphs.gz").write_bytes(b"not compressed")
    (tmp_path / "d.glyphs.gz").write_bytes(b"")
    (tmp_path / ".hidden.glyphs.gz").write_bytes(b"x")
    got = spark.read.format("leafwork").load(str(tmp_path))
    assert sorted((r.unicode, r.n, r.width, r.height, bytes(r.bitmap)) for r in got.collect()) == [(65, 3, 2, 2, b"abcd"), (66, 1, 0, 0, b""), (67, 9, 3, 1, b"xyz"), (68, 1, 1, 1, b"q")]


@pytest.mark.parametrize("piece", [1, 13, 64, 1 << 20])
def test_work_lists_are_cut_anywhere(spark, tmp_path, piece):
    registered.register(spark)
    rows = [(f"p{i}", "c" * (i % 9), f"a{i}", "d", "é" if i % 2 else None) for i in range(60)]
    body = "header, whatever it says\n# note\n" + "".join("\t".join(x or "" for x in r) + ("\r\n" if i % 4 == 0 else "\n") for i, r in enumerate(rows)) + "too\tfew\n" + "\t".join(["last"] * 5)
    (tmp_path / "x.worklist.tsv").write_text(body, newline="")
    got = spark.read.format("leafwork").option("pieceBytes", piece).load(f"file://{tmp_path}")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([tuple(x or None for x in r) for r in rows] + [("last",) * 5], key=repr)


def test_the_last_registered_format_wins(spark, tmp_path):
    class Shouting(registered.Format):
        name, schema = "shouting", "said string"

        def supports(self, path):
            return path.endswith(".glyphs.gz")

        def rows(self, file, path, low, high):
            yield (path.rpartition("/")[2].upper(),)

    glyph_file(tmp_path / "a.glyphs.gz", [(65, 3, 1, 1, b"a")])
    before = list(registered.FORMATS)
    try:
        registered.register(spark, Shouting())
        assert spark.read.format("leafwork").load(str(tmp_path)).collect() == [("A.GLYPHS.GZ",)]
        assert spark.read.format("leafwork").option("kind", "glyphs").load(str(tmp_path)).count() == 1
    finally:
        registered.FORMATS[:] = before
        registered.register(spark)
    (tmp_path / "b.pdf").write_bytes(b"x")
    with pytest.raises(Exception, match="no registered format"):
        spark.read.format("leafwork").load(str(tmp_path)).collect()
    empty = tmp_path / "none"
    empty.mkdir()
    assert spark.read.format("leafwork").option("kind", "glyphs").load(str(empty)).collect() == []


def test_written_files_and_streams_of_them(spark, tmp_path):
    registered.register(spark)
    rows = spark.range(200).select(F.lit("").alias("source"), F.col("id").cast("int").alias("unicode"), F.col("id").alias("n"), F.lit(1).alias("width"), F.lit(2).alias("height"), F.lit(b"ab").alias("bitmap"))
    path = str(tmp_path / "g")

    def add(part, mode="append"):
        rows.where(part).repartition(3).write.format("leafwork").option("suffix", ".glyphs.gz").mode(mode).save(path)

    def run():
        stream = spark.readStream.format("leafwork").option("kind", "glyphs").load(path)
        stream.writeStream.foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{tmp_path}/out/b={i}")).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        return sorted(r.unicode for r in spark.read.parquet(f"{tmp_path}/out").collect())

    add("id < 50")
    assert run() == list(range(50))
    assert run() == list(range(50))
    add("id >= 50")
    assert run() == list(range(200))
    add("id < 7", "overwrite")
    assert spark.read.format("leafwork").load(path).count() == 7


# trees


def walked(rows):
    """Places by recursion over rows (doc, node, parent, pos)."""
    out = {}
    kids = {}
    for d, n, up, pos in rows:
        kids.setdefault((d, up), []).append((pos, n))
    for d in {r[0] for r in rows}:
        order, leaf, stack = [0], [0], []

        def visit(n, up, depth):
            mine = order[0]
            order[0] += 1
            below = sorted(kids.get((d, n), []))
            leafno = None
            if not below:
                leafno, leaf[0] = leaf[0], leaf[0] + 1
            for _, c in below:
                visit(c, n, depth + 1)
            out[d, n] = (d, n, up, mine, order[0] - 1, depth, leafno)

        for _, n in sorted(kids.get((d, None), [])):
            visit(n, None, 0)
    return sorted(out.values(), key=repr)


def test_tree_order(spark):
    rng = random.Random(1)
    rows = [(1, i, i - 1 if i else None, 0) for i in range(200)] + [(2, 0, None, 0)] + [(2, i, 0, rng.randrange(9)) for i in range(1, 150)]
    rows += [(3, i, rng.choice([None, *range(i)]) if i else None, rng.randrange(3)) for i in range(80)] + [(4, 7, None, 1)]
    want = walked(rows)
    lost = [(5, 1, 2, 0), (5, 2, 1, 0), (5, 3, 99, 0), (5, 4, None, 0), (5, 5, 1, 1)]
    df = spark.createDataFrame(rows + lost + rows[:3], "doc long, node long, parent long, pos long").withColumn("w", F.lit(1))
    got = trees.tree_order(df, "node", "parent", "pos", "doc")
    assert got.columns == ["doc", "node", "parent", "preorder", "last", "depth", "leaf"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([*want, (5, 4, None, 0, 0, 0, 0)], key=repr)
    assert trees.tree_order(df.where("false"), "node", "parent", "pos", "doc").collect() == []


def test_tree_differences(spark):
    rows = [(1, 0, None, "r", "x"), (1, 1, 0, "a", None), (1, 2, 0, "b", "y"), (1, 3, 1, "b", "z"), (1, 4, 3, "c", "t"), (2, 0, None, "r", "same")]
    other = [(1, 10, None, "r", "x"), (1, 11, 10, "a", None), (1, 12, 10, "b", "changed"), (1, 15, 12, "n", "new"), (1, 16, 15, "n", "below"), (2, 5, None, "r", "same")]
    kind = "doc long, node long, parent long, key string, value string"
    a, b = spark.createDataFrame(rows, kind), spark.createDataFrame(other, kind)
    found = trees.tree_differences(a, b, "node", "parent", "key", "value", "doc")
    assert sorted(map(tuple, found.collect()), key=repr) == sorted([(1, 2, 3, None, "left"), (1, 1, 2, 12, "value"), (1, 2, None, 15, "right")], key=repr)
    order = trees.tree_order(a.withColumn("pos", F.col("node")), "node", "parent", "pos", "doc")
    assert trees.first_difference(found, order, "node", "doc").collect() == [(1, 2, 3, None, "left")]
    assert trees.tree_differences(a, a, "node", "parent", "key", "value", "doc").collect() == []


def test_a_deep_chain_differs_at_its_end(spark):
    nodes = spark.range(300).select(F.lit(1).alias("doc"), F.col("id").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), F.lit("k").alias("key"), F.lit("v").alias("value"))
    other = nodes.withColumn("value", F.when(F.col("node") == 299, "w").otherwise("v"))
    assert trees.tree_differences(nodes, other, "node", "parent", "key", "value", "doc").collect() == [(1, 299, 299, 299, "value")]


# objects


def test_united(spark):
    kind = "doc_id long, num long, fields array<struct<key:string,ref:long>>"
    rows = [(7, 1, [("a", 2), ("b", None)]), (7, 2, [("a", 1), ("lost", 50)]), (9, 0, []), (9, 4, None), (9, 5, [("x", 4), ("x", 0)]), (20_000, 3, [("s", 3)]), (None, 1, []), (9, 0, [])]
    got = objects.united(spark.createDataFrame(rows, kind))
    assert sorted((r.doc_id, r.old, r.num, None if r.fields is None else [x.ref for x in r.fields]) for r in got.collect()) == [(7, 1, 1, [2, None]), (7, 2, 2, [1, None]), (9, 0, 3, []), (9, 4, 7, None), (9, 5, 8, [7, 3]), (20_000, 3, 12, [12])]
    assert objects.united(spark.createDataFrame([], kind)).collect() == []
    names = spark.createDataFrame([("n", 2, 5), ("n", 1, 9), ("m", 3, 1), (None, 1, 1)], "name string, doc long, at long")
    assert sorted(map(tuple, objects.first_named(names, "name", "doc").collect())) == [("m", 3, 1), ("n", 1, 9)]


def test_states_of_a_log(spark, tmp_path):
    rng = random.Random(3)
    log = [(rng.randrange(30), v, rng.random() < 0.3, f"b{v}") for v in range(400)]
    df = spark.createDataFrame(log, "key long, version long, deleted boolean, body string")

    def brute(at):
        now, dead = {}, {}
        for k, v, gone, body in log:
            if v <= at:
                dead[k] = dead.get(k, 0) + gone
                now[k] = None if gone else (k, v, body, None)
        return sorted((k, v[1], v[2], dead[k]) for k, v in now.items() if v)

    rows = lambda d: sorted((r.key, r.version, r.body, r.generation) for r in d.collect())
    for at in (0, 57, 399):
        assert rows(objects.state_at(df, "key", "version", at)) == brute(at)
    small = objects.compacted(df, "key", "version", 100)
    again = objects.compacted(small, "key", "version", 200)
    assert again.count() < df.count()
    for at in (200, 301, None):
        assert rows(objects.state_of(again, "key", "version", at)) == brute(399 if at is None else at)
    objects.append_changes(str(tmp_path / "log"), df.where("version < 10"))
    objects.append_changes(str(tmp_path / "log"), df.where("version >= 10"))
    assert rows(objects.state_at(spark.read.parquet(str(tmp_path / "log")), "key", "version")) == brute(399)


def test_visibility_programs(spark):
    rng = random.Random(4)

    def made(depth):
        if depth == 0 or rng.random() < 0.3:
            i = rng.choice([0, 1, 2, 3, 9])
            return [("Layer", i)], (lambda s, i=i: s[i] if i < len(s) and s[i] is not None else True)
        op = rng.choice(["Not", "And", "Or"])
        parts = [made(depth - 1) for _ in range(1 if op == "Not" else rng.randrange(4))]
        rules = [p[1] for p in parts]
        rule = {"Not": lambda s: not rules[0](s), "And": lambda s: all(r(s) for r in rules), "Or": lambda s: any(r(s) for r in rules)}[op]
        return [x for p in parts for x in p[0]] + [(op, len(parts))], rule

    rows, want = [], []
    for i in range(200):
        program, rule = made(rng.randrange(7))
        states = [rng.choice([True, False, None]) for _ in range(4)]
        rows.append((i, program, states))
        want.append((i, rule(states)))
    rows += [(1000, None, [False]), (1001, [], None)]
    want += [(1000, True), (1001, True)]
    kind = "id long, program array<struct<op:string,arg:int>>, states array<boolean>"
    shown = lambda rows: spark.createDataFrame(rows, kind).select("id", objects.visible_program(F.col("program"), F.col("states")).alias("v"))
    assert sorted(map(tuple, shown(rows).collect())) == want
    for bad, what in (([("Layer", 0), ("Layer", 1)], "results left"), ([("And", 2)], "too few"), ([("Layer", 0)] + [("Not", 1)] * 60, "too deep"), ([("Layer", 0), ("Xor", 1)], "no such operator")):
        with pytest.raises(Exception, match=what):
            shown([(1, bad, [True])]).collect()


# cursor


def test_font_cursor_goes_on(spark, tmp_path):
    rng = random.Random(6)
    rows = [(rng.randrange(4), p, rng.choice("abcdefghij")) for p in range(120)] + [(None, 1, "z"), (1, None, "z"), (1, 2, None)]
    df = spark.createDataFrame(rows, "doc long, page long, font string")

    def run(state, out):
        with streams.keyed_state(spark):
            told = streams.font_cursor(streams.read_stream(spark, f"{tmp_path}/in", df.schema))
            told.writeStream.outputMode("append").foreachBatch(lambda d, i: d.write.mode("overwrite").parquet(f"{tmp_path}/{out}/b={i}")).option("checkpointLocation", f"{tmp_path}/{state}").trigger(availableNow=True).start().awaitTermination()
        return sorted((r.doc, r.font, r.page) for r in spark.read.parquet(f"{tmp_path}/{out}").collect())

    first = {}
    for d, p, f in rows:
        if None not in (d, p, f):
            first[d, f] = min(p, first.get((d, f), p))
    want = sorted((d, f, p) for (d, f), p in first.items())
    df.where("page < 40 or page is null").write.mode("append").parquet(f"{tmp_path}/in")
    half = run("s1", "o1")
    assert half == [x for x in want if x[2] < 40]
    df.where("page >= 30").write.mode("append").parquet(f"{tmp_path}/in")  # some pages come again
    assert run("s1", "o1") == want == run("s2", "o2")


# two directions


def seen_order(s, right):
    """Levels by the rules for weak and neutral characters, then reversal from the highest level down."""
    clusters = []
    for c in s:
        if clusters and unicodedata.category(c).startswith("M"):
            clusters[-1] += c
        else:
            clusters.append(c)
    kinds = []
    for c in clusters:
        kind = unicodedata.bidirectional(c[0])
        kinds.append({"AL": "R", "AN": "EN"}.get(kind, kind))
    base, given = "R" if right else "L", list(kinds)
    for i, k in enumerate(given):  # separators and ends inside and beside numbers
        if k in ("CS", "ES", "ET"):
            j = i
            while j < len(given) and given[j] in ("CS", "ES", "ET"):
                j += 1
            b = i
            while b > 0 and given[b - 1] in ("CS", "ES", "ET"):
                b -= 1
            left, after = b > 0 and given[b - 1] == "EN", j < len(given) and given[j] == "EN"
            ends_before, ends_after = all(x == "ET" for x in given[b : i + 1]), all(x == "ET" for x in given[i:j])
            if left and after or left and ends_before or after and ends_after:
                kinds[i] = "*"
    kinds = ["EN" if k == "*" else k for k in kinds]
    strong = base
    for i, k in enumerate(kinds):
        if k in ("L", "R"):
            strong = k
        elif k == "EN" and strong == "L":
            kinds[i] = "L"
        elif k != "EN":
            kinds[i] = "N"
    side = lambda k: "R" if k == "EN" else k
    levels = []
    for i, k in enumerate(kinds):
        if k == "N":
            before = next((side(x) for x in reversed(kinds[:i]) if x != "N"), base)
            after = next((side(x) for x in kinds[i:] if x != "N"), base)
            k = before if before == after else base
        levels.append({"L": 2 if right else 0, "R": 1, "EN": 2}[k])
    order = list(range(len(clusters)))
    for level in (2, 1):
        i = 0
        while i < len(order):
            j = i
            while j < len(order) and levels[order[j]] >= level:
                j += 1
            order[i:j] = order[i:j][::-1]
            i = max(j, i + 1)
    return "".join(clusters[i] for i in order)


def test_lines_of_two_directions(spark):
    rng = random.Random(8)
    chars = ["a", "B", "é", "é", "א", "ב", "ג", "בָ", "ش", "1", "2", "37", " ", " ", "(", "!", ",", ".", "-", "%", "$"]
    lines = ["".join(rng.choices(chars, k=rng.randrange(14))) for _ in range(1500)] + ["abc אבג 12.5% דה xyz", "", "אב, גד (ab 12) הו", "1.1" * 4000, "א1." * 4000]
    df = spark.createDataFrame(list(enumerate(lines)) + [(-1, None)], "i int, s string")
    for right in (False, True):
        got = dict(map(tuple, df.select("i", text.visual_order(F.col("s"), right)).collect()))
        assert got.pop(-1) is None
        bad = [(s, got[i], seen_order(s, right)) for i, s in enumerate(lines[:-2]) if got[i] != seen_order(s, right)]
        assert not bad, bad[:3]


# glyph names


def test_glyph_names(spark):
    names = ["Aacute", "emdash", "Alpha", "omegatonos", "Gcommaaccent", "Scedilla", "fi", "ohungarumlaut", "iotadieresistonos", "Lambda", "zdotaccent", "quotesingle", "Ydieresis", "one.oldstyle", "A", "uni0041", "u1F600", "g65", "nosuchname", "", ".notdef", "uni"]
    want = "ÁÁ"[:1] + "—ΑώĢŞﬁőΐΛż'Ÿ1AA😀A"
    df = spark.createDataFrame(list(enumerate(names)), "i int, name string")
    assert [r.c for r in df.orderBy("i").select(text.glyph_code(F.col("name")).alias("c")).collect()] == [*map(ord, want), None, None, None, None]
    composed = [("f_f_i.alt", "ffi"), ("uni00410042", "AB"), ("T_h_uni0065", "The"), ("u1F600_A", "😀A"), ("uniD800", None), ("A_nosuch", None), ("", None), ("u110000", None), ("Aacute_emdash", "Á—"), (None, None)]
    df = spark.createDataFrame(composed, "name string, want string")
    assert all(r.said == r.want for r in df.select("want", text.glyph_text(F.col("name")).alias("said")).collect())


# outlines, information, names of files


def test_outline_set(spark):
    from leafwork.operators import documents

    kind = "doc_id long, node long, parent long, pos int, title string"
    old = spark.createDataFrame([(1, 1, None, 0, "a"), (1, 2, 1, 0, "b"), (2, 1, None, 0, "keep"), (3, 1, None, 0, "gone")], kind)
    new = spark.createDataFrame([(1, 9, None, 7, "y"), (1, 8, None, 3, "x"), (1, 5, 9, 3, "z"), (4, 1, None, 0, "nobody's")], kind)
    docs = spark.createDataFrame([(1,), (3,), (1,)], "doc_id long")
    assert sorted(map(tuple, documents.outline_set(old, docs, new).collect()), key=repr) == sorted([(2, 1, None, 0, "keep"), (1, 8, None, 0, "x"), (1, 9, None, 1, "y"), (1, 5, 9, 0, "z")], key=repr)


def test_information_and_file_names(spark):
    from leafwork.operators import documents

    df = spark.createDataFrame([(1, {"Title": "t", "Author": "a"}), (2, None), (3, {"Author": "a"})], "i int, info map<string,string>").orderBy("i")
    assert [r.v for r in df.select(documents.info_value(F.col("info"), "Title").alias("v")).collect()] == ["t", None, None]
    assert [r.m for r in df.select(documents.info_set(F.col("info"), {"Author": None, "Title": "new"}).alias("m")).collect()] == [{"Title": "new"}] * 3
    assert [r.m for r in df.select(documents.info_set(F.col("info"), {"Author": None}).alias("m")).collect()] == [{"Title": "t"}, None, None]
    files = spark.createDataFrame([("img", 5, "png"), ("img", 2, "png"), ("img", 1, "ppm"), ("other", 0, "png")], "root string, n int, ending string")
    taken = spark.createDataFrame([("img-000.png",), ("img-041.png",), ("img-x.png",), ("zzz",), (None,)], "name string")
    got = documents.unique_names(files, taken, "root", "n", "ending")
    assert sorted(r.unique_name for r in got.collect()) == ["img-000.ppm", "img-042.png", "img-043.png", "other-000.png"]
