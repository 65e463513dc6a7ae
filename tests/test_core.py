import random
import struct

import pytest
from pyspark.sql import functions as F

from quirelake.functions import geometry, labels
from quirelake.functions import text as tx
from quirelake.operators import asof, boxes, ordered, pages, search, series, trees
from quirelake.operators.sessions import sessionize
from quirelake.sources import formats, sinks


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).collect()[0]["x"]


# ---- sessions -----------------------------------------------------------------------------

VIEW = "id int, visitor_hash string, created_at timestamp_ntz, k string, extra int"


def brute_sessions(events, gap):
    out = []
    for key in sorted({k for _, k, _ in events if k}):
        times = sorted({(t, i) for i, k, t in events if k == key})
        run = []
        for t, _ in times:
            if run and t - run[-1] > gap:
                out.append((key, run[0], run[-1], len(run)))
                run = []
            run.append(t)
        out.append((key, run[0], run[-1], len(run)))
    return sorted(out)


def test_sessions_match_brute_force(spark):
    random.seed(1)
    events = [(i, random.choice(["a", "a", "a", "b", "c"]), random.randrange(0, 90_000) * 1_000_000) for i in range(600)]
    events += events[:50]  # whole copies
    df = spark.createDataFrame(events, "id int, visitor_hash string, us long").withColumn("created_at", F.timestamp_micros("us").cast("timestamp_ntz"))
    got = rows(sessionize(df).select("visitor_hash", "start_us", "end_us", "n_events"))
    assert sorted(got) == brute_sessions(set(events), 1_800_000_000)


def test_session_borders_nulls_and_ties(spark):
    gap = 1_800_000_000
    data = [(1, "a", 0), (2, "a", gap), (3, "a", 2 * gap + 1), (3, "a", 2 * gap + 1), (None, "a", 2 * gap + 1), (None, "a", 2 * gap + 1), (4, None, 5), (5, "", 5), (6, "b", None), (7, "a", 0)]
    df = spark.createDataFrame(data, "id int, visitor_hash string, us long").select("id", "visitor_hash", F.timestamp_micros("us").cast("timestamp_ntz").alias("created_at"), F.lit("x").alias("k"), F.lit(1).alias("t"))
    got = rows(sessionize(df).select("visitor_hash", "start_us", "end_us", "duration_us", "n_events"))
    assert got == [("a", 0, gap, gap, 3), ("a", 2 * gap + 1, 2 * gap + 1, 0, 3)]
    assert sessionize(df.limit(0)).count() == 0


# ---- text ---------------------------------------------------------------------------------


@pytest.mark.parametrize("text,query", [("aaaa", "aa"), ("The the THE", "the"), ("a.b(a.b", "a.b("), (r"x\Ey\E", r"\E"), ("", "a"), ("abc", "  "), ("über Über", "über")])
def test_match_starts(spark, text, query):
    found, at, low = [], 0, text.lower()
    if query.strip():
        while (at := low.find(query.lower(), at)) >= 0:
            found.append(at)
            at += len(query)
    assert one(spark, tx.match_starts(F.col("t"), query), t=text) == found


def test_search_excerpts_and_nulls(spark):
    df = spark.createDataFrame([(1, "x" * 50 + " Needle\n end"), (2, None), (3, "")], "page int, text string")
    r = search.search(df, "page", "text", "needle").collect()
    assert len(r) == 1 and r[0]["excerpt"]["prefix"] and not r[0]["excerpt"]["suffix"]
    assert r[0]["excerpt"]["match"] == "Needle" and r[0]["excerpt"]["after"] == " end" and r[0]["excerpt"]["before"] == "x" * 39 + " "


def test_scalar_text(spark):
    assert one(spark, tx.comparable(F.col("t")), t="  A  B ") == "a b"
    assert one(spark, tx.shorten(F.col("t"), 120), t="y" * 121) == "y" * 117 + "..."
    assert [one(spark, tx.size_label(F.col("n")), n=n) for n in (5, 1024, 20480, 5 * 1024**3)] == ["5 B", "1.00 KB", "20.0 KB", "5.00 GB"]
    assert one(spark, tx.parse_pdf_date(F.col("t")), t="D:20240101010000+01'00'") == 1704067200
    assert one(spark, tx.site_url(F.col("t")), t=" example.org// ") == "https://example.org"
    assert one(spark, tx.common_prefix(F.col("a"), F.col("b")), a="abcx", b="abdx") == 2


# ---- labels -------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "text,total,want",
    [("1, 3-5, 8", 10, [1, 3, 4, 5, 8]), ("1-3, 2-4", 10, [1, 2, 3, 4]), ("8-15", 10, [8, 9, 10]), ("0, -1, 1", 10, [1]), ("abc, 2, xyz", 10, [2]), ("abc", 10, []), ("", 10, []), ("5, 1, 3", 10, [1, 3, 5]), ("2 - 4", 10, [2, 3, 4]), ("10, 11, 12", 10, [10])],
)
def test_page_lists(spark, text, total, want):
    assert one(spark, labels.pages_of(F.col("t"), F.lit(total)), t=text) == want


def test_labels(spark):
    assert one(spark, labels.roman(F.col("n")), n=1994) == "MCMXCIV"
    assert one(spark, labels.from_roman(F.col("t")), t="mcmxciv") == 1994
    assert one(spark, labels.from_roman(F.col("t")), t="IIII") is None
    assert one(spark, labels.alphabetic(F.col("n")), n=28) == "BB"
    assert one(spark, labels.page_range(F.col("t"), F.lit(9)), t="7 .. 3") == (3, 7)
    assert one(spark, labels.page_range(F.col("t"), F.lit(5)), t="7") is None
    assert [one(spark, labels.spread_start(F.col("p"), F.lit("facing-first-single"), F.lit(6)), p=p) for p in range(1, 7)] == [1, 2, 2, 4, 4, 6]
    df = spark.createDataFrame([(p,) for p in (1, 2, 3, 9)], "p int")
    assert [r["label"] for r in pages.with_labels(df, "p", [(2, "r", "", 3), (9, None, "End", 1)]).orderBy("p").collect()] == ["1", "iii", "iv", "End"]


def test_runs_and_inferred_ranges(spark):
    df = spark.createDataFrame([("f", p) for p in (1, 2, 2, 3, 7, None)], "f string, p int")
    assert rows(pages.compact(df, ["f"], "p")) == [("f", "1-3,7")]
    texts = ["i", "ii", "iii", "1", "2", "A-9", "A-10"]
    df = spark.createDataFrame([("d", i + 1, t) for i, t in enumerate(texts)], "d string, p int, t string")
    got = rows(series.infer_label_ranges(df, ["d"], "p", "t"))
    assert got == [("d", 1, "r", "", 1), ("d", 4, "D", "", 1), ("d", 6, "D", "A-", 9)]


# ---- boxes, trees, time -------------------------------------------------------------------


def test_neighbours_match_brute_force(spark):
    random.seed(2)
    data = [(i % 3, i, x := random.uniform(0, 50), y := random.uniform(0, 50), x + random.uniform(0, 20), y + random.uniform(0, 20)) for i in range(90)]
    df = spark.createDataFrame(data, "page int, id int, left double, top double, right double, bottom double")
    want = sorted((a[0], a[1], b[1]) for a in data for b in data if a[0] == b[0] and a[1] < b[1] and a[2] <= b[4] and b[2] <= a[4] and a[3] <= b[5] and b[3] <= a[5])
    assert sorted(map(tuple, boxes.neighbours(df, 7.0).collect())) == want


def test_fragments_and_clusters(spark):
    df = spark.createDataFrame([(1, 1, 100.0, 100.0, 300.0, 300.0), (1, 2, 260.0, 280.0, 420.0, 480.0), (1, 3, 900.0, 900.0, 901.0, 901.0)], "page int, id int, left double, top double, right double, bottom double")
    f = boxes.fragments(df, (50, 60, 360, 460))
    assert rows(f.select("id", "left", "top", "right", "bottom")) == [(1, 100.0, 100.0, 300.0, 300.0), (2, 260.0, 280.0, 360.0, 460.0)]
    assert rows(boxes.union_box(f, ["page"])) == [(1, 100.0, 100.0, 360.0, 460.0)]
    assert {tuple(r) for r in boxes.clusters(df).collect()} == {(1, 1, 0), (1, 2, 1), (1, 3, 2)}
    assert one(spark, geometry.iou(tuple(F.lit(x) for x in (0.0, 0.0, 2.0, 2.0)), tuple(F.lit(x) for x in (1.0, 0.0, 3.0, 2.0))), t=1) == pytest.approx(1 / 3)


def test_trees(spark):
    n = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, 4), (6, 5), (9, 77), (10, 10)], "id int, parent int")
    up = trees.closure(n)
    assert {r["ancestor"]: r["distance"] for r in up.where("id = 6").collect()} == {6: 0, 5: 1, 4: 2, 3: 3, 2: 4, 1: 5}
    assert dict(trees.visible_counts(n).collect())[1] == 6
    assert rows(trees.top_selected(n, n.where("id IN (2, 5, 9)"))) == [(2,), (9,)]
    assert rows(trees.delete_with_branches(n, n.where("id = 3")).select("id")) == [(1,), (10,), (2,), (9,)]


def test_asof(spark):
    left = spark.createDataFrame([(i, "a", t) for i, t in enumerate((1, 5, 100, 3_000_000))] + [(9, None, 5)], "id int, k string, us long").withColumn("at", F.timestamp_micros("us")).drop("us")
    right = spark.createDataFrame([("a", 5, "x"), ("a", 90, "y"), ("b", 1, "z")], "k string, us long, v string").withColumn("at", F.timestamp_micros("us")).drop("us")
    got = {r["id"]: r["v"] for r in asof.asof_latest(left, right, ["k"], "at", "v").collect()}
    assert got == {0: None, 1: "x", 2: "y", 3: "y", 9: None}


def test_timers(spark):
    data = [(i, "u", t) for i, t in enumerate((0, 1, 2, 10, 11, 30))]
    df = spark.createDataFrame(data, "i int, u string, s long").withColumn("at", F.timestamp_seconds("s")).withColumn("d", F.lit(8.0))
    s = 1_000_000
    assert [r["i"] for r in ordered.debounce(df, ["u"], "at", "i", 2 * s).orderBy("i").collect()] == [2, 4, 5]
    assert rows(ordered.batches(df, ["u"], "at", "i", 5 * s, 2 * s).select("run", "batch", "n")) == [(1, 0, 2), (1, 1, 1), (2, 0, 2), (3, 0, 1)]
    assert [r["i"] for r in ordered.throttle(df, ["u"], "at", "i", 9 * s).orderBy("i").collect()] == [0, 3, 4, 5]
    assert [r["steps"] for r in ordered.accumulate(df, ["u"], "at", "i", "d", 10.0, 5 * s).orderBy("i").collect()] == [0, 1, 1, 0, 1, 0]
    assert ordered.debounce(df.limit(0), ["u"], "at", "i", s).count() == 0
    odd = df.withColumn("t", F.lit("own")).unionByName(spark.createDataFrame([(7, None, 1), (8, "u", None)], "i int, u string, s long").withColumn("at", F.timestamp_seconds("s")).withColumn("d", F.lit(None).cast("double")).withColumn("t", F.lit("x")))
    kept = ordered.debounce(odd, ["u"], "at", "i", 2 * s)
    assert kept.columns == odd.columns and {(r["i"], r["t"]) for r in kept.collect()} == {(2, "own"), (4, "own"), (5, "own")}


def test_series(spark):
    df = spark.createDataFrame([(v,) for v in (1, 1, 2, 9, 9, 10)], "v int")
    assert series.otsu(df, "v").collect()[0]["threshold"] == 2.0
    bend = spark.createDataFrame([("a", float(x), 3.0 * x * x + 1) for x in range(5)] + [("b", 1.0, 1.0), ("b", 2.0, 5.0)], "k string, x double, y double")
    got = dict(series.curvature(bend, ["k"], "x", "y").collect())
    assert got["a"] == pytest.approx(12.0) and got["b"] == 0.0
    image = spark.createDataFrame([(1, 2, bytearray([0, 10, 2, 20]))], "id int, w int, px binary")
    assert rows(series.profile(image, "id", "w", "px")) == [(1, 0, 1.0), (1, 1, 15.0)]


# ---- formats and sinks --------------------------------------------------------------------


def test_netpbm():
    assert formats.parse_netpbm(b"P5 # comment\n2 1\n255\n" + bytes([10, 20])) == (2, 1, 1, bytes([10, 20]))
    assert formats.parse_netpbm(b"P6 1 1 255 " + bytes([200, 100, 50]))[3] == bytes([200, 100, 50])
    for bad in (b"P4 1 1\n", b"P5 2 2 255\n\x01", b"P5 x"):
        with pytest.raises(ValueError):
            formats.parse_netpbm(bad)
    assert formats.parse_netpbm(sinks.grey_map(2, 1, b"ab"))[3] == b"ab"


def test_headers_and_outlines(spark):
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", 640, 480)
    assert one(spark, formats.png_size(F.col("c")), c=bytearray(png)) == (640, 480)
    assert formats.image_dpi(png + b"..pHYs" + struct.pack(">II", 11811, 11811) + b"\x01") == 300
    assert formats.image_dpi(b"\xff\xd8\xff\xe0\x00\x10JFIF\x00\x01\x02\x01\x00\x96\x00\x96") == 150
    nodes = formats.parse_outline('(bookmarks ("Chapter \\"1\\"" "#1" ("Section" "#5")) ("End" "x"))')
    assert [(n["title"], n["page_index"], n["parent"], n["depth"]) for n in nodes] == [('Chapter "1"', 0, None, 0), ("Section", 4, 0, 1), ("End", None, None, 0)]
    assert formats.parse_outline("nothing") == [] and formats.parse_outline(None) == []


def test_index_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("f", 1, "a\nb"), ("f", 2, "")], "doc string, page_number int, text string")
    sinks.write_index(df, str(tmp_path / "i"), ["doc"])
    assert rows(spark.read.json(str(tmp_path / "i")).select("doc", "page_number", "text")) == rows(df)
    (tmp_path / "m.json").write_text('{"version": 2, "pages": {"3": {"path": "p3"}, "x": {"path": "no"}}}')
    assert rows(formats.read_manifest(spark, str(tmp_path / "m.json"))) == [(3, "p3")]


# ---- the entry points ---------------------------------------------------------------------


def test_queries_and_sql_agree():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert "p5_found" in e.queries()


# ---- greedy matchings ---------------------------------------------------------------------


def test_greedy(spark):
    from quirelake.operators import greedy

    box = "page int, id long, left double, top double, right double, bottom double"
    marks = spark.createDataFrame([(1, 1, 0.0, 0.0, 1.0, 1.0), (1, 2, 0.0, 0.0, 1.0, 1.0), (1, 3, 5.0, 5.0, 6.0, 6.0)], box)
    hints = spark.createDataFrame([(1, 10, 0.0, 0.0, 1.0, 0.9), (1, 11, 0.0, 0.0, 1.0, 0.5), (2, 12, 5.0, 5.0, 6.0, 6.0)], box)
    assert rows(greedy.assign(marks, hints)) == [(1, 1, 10), (1, 2, 11)]
    at = spark.createDataFrame([(1, 1, 0.0, 0.0), (1, 2, 0.0, 0.0), (1, 3, 500.0, 0.0), (2, 4, 0.0, 0.0)], "page int, id long, x double, y double")
    assert rows(greedy.place_markers(at)) == [(1, 1, 0.0, 0.0), (1, 2, 30.0, 0.0), (1, 3, 500.0, 0.0), (2, 4, 0.0, 0.0)]
    c = [
        (1, 0, 1, "5R", None, "", 0.0, 0.0, 0.1, 0.1),
        (1, 1, 2, None, "u", "note", 0.0, 0.0, 0.1, 0.1),
        (1, 2, 3, "5R", None, "x", 0.9, 0.9, 1.0, 1.0),
        (1, 3, 4, "6R", None, None, 0.0, 0.0, 0.1, 0.1),
        (2, 0, 5, "5R", None, "", 0.0, 0.0, 0.1, 0.1),
    ]
    df = spark.createDataFrame(c, "page int, place int, id long, ann_id string, uid string, text string, left double, top double, right double, bottom double").withColumn("markup", F.lit(True))
    assert rows(greedy.resolve(df.withColumn("markup", F.lit(False)))) == [(1, 1, 1), (1, 2, 2), (1, 3, 1), (1, 4, 4), (2, 5, 5)]
    assert rows(greedy.resolve(df)) == [(1, 1, 1), (1, 2, 1), (1, 3, 1), (1, 4, 4), (2, 5, 5)]


# ---- whole jobs ---------------------------------------------------------------------------


def query(name):
    import __spark_entry__ as e

    return e.queries()[name]


def test_excerpts_of_all_documents(spark, tmp_path):
    text = "«Über\u00a0 \ufeff the\u2028дом» " + "é" * 50
    spark.createDataFrame([(1, text), (2, None), (3, "in the end")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = rows(query("proj_p02_excerpts")(spark, str(tmp_path)))
    assert got == [(3, 3, False, False, "in ", "the ", "end")]
    text = "«Über\u00a0\ufeff the дом»\u2003" + "é" * 50
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert rows(query("proj_p02_excerpts")(spark, str(tmp_path))) == [(1, 8, False, True, "«Über ", "the ", "дом» " + "é" * 35)]


def test_word_bounds(spark, tmp_path):
    def brute(text, at):
        blank = lambda i: text[i] in " \t\n\u00a0\ufeff"
        if blank(at):
            at = min((i for i in range(len(text)) if not blank(i)), key=lambda i: (abs(i - at), i), default=at)
        start, stop = at, at + 1
        while start > 0 and not blank(start - 1):
            start -= 1
        while stop < len(text) and not blank(stop):
            stop += 1
        return start, stop

    texts = ["ab  cd", "один\u00a0\n два\ufeffé  ", "   x", "y   "]
    cases = [(t, i) for t in texts for i in range(len(t))]
    df = spark.createDataFrame(cases, "t string, i int")
    got = {(r["t"], r["i"]): tuple(r["w"]) for r in df.select("t", "i", tx.word_bounds(F.col("t"), F.col("i")).alias("w")).collect()}
    assert got == {(t, i): brute(t, i) for t, i in cases}
    assert one(spark, tx.word_bounds(F.col("t"), F.lit(1)), t="   ") == (1, 2)
    spark.createDataFrame([(1, "a é"), (2, "ab "), (3, ""), (4, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert rows(query("x33_word_bounds")(spark, str(tmp_path))) == [(1, 2, 3), (2, 0, 2)]


def test_common_ends_of_whole_texts(spark, tmp_path):
    random.seed(3)
    texts = ["é" * 100 + "a", "é" * 100 + "b" + "z" * 80, "z" * 80, "", "z", "".join(random.choice("ab") for _ in range(300)), None]
    df = spark.createDataFrame([(i, "f", i, t) for i, t in enumerate(texts)], "page_id long, pdf_path string, page_number int, text string")
    df.write.parquet(str(tmp_path / "page_text.parquet"))
    assert [r[1] for r in rows(query("x27_common_prefixes")(spark, str(tmp_path)))] == [100, 0, 0, 0, 0]
    assert [r[1] for r in rows(query("x27_common_suffixes")(spark, str(tmp_path)))] == [0, 80, 0, 0, 0]
    assert one(spark, tx.common_prefix(F.col("a"), F.col("b")), a="x" * 5000, b="x" * 4097) == 4097


def test_layout_of_all_suppliers(spark, tmp_path):
    spark.range(0, 131).withColumnRenamed("id", "s_suppkey").write.parquet(str(tmp_path / "supplier.parquet"))
    got = {r[0]: tuple(r)[1:] for r in query("proj_p08_layout_rects")(spark, str(tmp_path)).collect()}
    want = {1: (0.0, 0.0, 1.0, 1.0)}
    for k in range(2, 131):
        x, y, w, h = want[k // 2]
        r, second = max(0.1, min(0.9, k // 2 % 11 / 10)), k % 2 == 1
        part = 1 - r if second else r
        want[k] = (x + w * r * second, y, w * part, h) if k // 2 % 3 == 0 else (x, y + h * r * second, w, h * part)
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k], abs=2e-9) for k in want)


def test_best_overlap_or_nearest(spark):
    box = "page int, id long, left double, top double, right double, bottom double"
    b = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0), (1, 2, 9.0, 0.0, 30.0, 10.0), (2, 3, 30.0, 0.0, 40.0, 10.0), (2, 4, 45.0, 0.0, 45.0, 10.0), (3, 5, 51.0, 0.0, 61.0, 10.0), (4, 6, 40.0, 0.0, 50.0, 10.0), (4, 7, 0.0, 40.0, 10.0, 50.0)], box)
    marks = spark.createDataFrame([(1, 9, 9.5, 0.0, 10.5, 1.0), (2, 9, 0.0, 0.0, 10.0, 10.0), (3, 9, 0.0, 0.0, 10.0, 10.0), (4, 9, 0.0, 0.0, 10.0, 10.0), (4, 10, 0.0, 0.0, 0.0, 10.0)], box)
    got = {tuple(r)[:3]: r["score"] for r in boxes.best_overlap(b, marks).collect()}
    assert got == {(1, 9, 1): pytest.approx(0.5 / 100.5), (2, 9, 3): 0.0, (4, 9, 6): 0.0}


def test_grey_maps_of_all_documents(spark, tmp_path):
    texts = [(1, "дом и сад"), (2, "abcdefgh"), (3, "é"), (4, ""), (5, None), (6, "éé")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert rows(query("s12_grey_maps")(spark, str(tmp_path))) == [(1, 4, 4), (2, 4, 2), (3, None, None), (4, None, None), (5, None, None), (6, 4, 1)]


def test_sizes_of_large_documents(spark, tmp_path):
    sizes = [(1, 1048575), (2, 1048576), (3, 30 * 1048576), (4, 5 * 1024**3), (5, None), (6, 0)]
    spark.createDataFrame(sizes, "doc_id long, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert [r[1] for r in rows(query("x04_document_sizes")(spark, str(tmp_path)))] == ["1024 KB", "1.0 MB", "30 MB", "5.0 GB", "Unknown size", "Unknown size"]
