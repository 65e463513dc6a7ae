import pytest
from pyspark.sql import functions as F

from quirelake.functions import colours as co
from quirelake.functions import comments as cm
from quirelake.functions import files as fi
from quirelake.functions import labels as lb
from quirelake.operators import links, trees


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_destination_numbers(spark):
    rows = [(2, 5), (5, 5), (99, 5), (-1, 5), (0, 0), (None, 5)]
    assert [r[0] for r in values(spark, rows, "a int, n int", fi.destination_index(F.col("a"), F.col("n")))] == [2, 4, None, None, None, None]


def test_colours(spark):
    rows = [([255.0, 128.2, 0.0],), (None,), ([1.0, 2.0],), ([float("nan"), -4.0, 300.0],)]
    assert [r[0] for r in values(spark, rows, "c array<double>", co.rgb_to_hex(F.col("c")))] == ["#ff8000", None, None, "#0000ff"]
    rows = [("#abc",), ("  #A1b2C3  ",), ("blue",), ("#xyz123",), (None,)]
    assert [r[0] for r in values(spark, rows, "c string", co.bookmark_colour(F.col("c")))] == ["#aabbcc", "#a1b2c3", None, None, None]
    assert values(spark, [("#f00",), ("red",)], "c string", co.with_opacity(F.col("c"), F.lit(0.5))) == [("rgba(255, 0, 0, 0.5)",), ("red",)]


def test_languages_from_right_to_left_first(spark):
    rows = [(["eng", "heb", "fra", "syr"],), (["eng", "heb", "eng", "heb", "deu"],), (["eng", "ara", None, ""],), ([],)]
    want = [["heb", "syr", "eng", "fra"], ["heb", "eng", "deu"], ["eng", "ara"], []]
    assert [list(r[0]) for r in values(spark, rows, "c array<string>", fi.rtl_first(F.col("c")))] == want


def test_labels_of_pages(spark):
    labels = ["i", "ii", "A"]
    rows = [(" 2 ", labels), ("II", labels), ("a", labels), ("9", labels), ("", labels), (None, labels), ("ii", labels[:2])]
    assert [r[0] for r in values(spark, rows, "t string, l array<string>", lb.find_page(F.col("t"), F.lit(3), F.col("l")))] == [2, 2, 3, None, None, None, None]
    rows = [(1, ["x"]), (2, ["x", "2"]), (3, ["x"]), (1, None), (1, [" "])]
    assert [r[0] for r in values(spark, rows, "p int, l array<string>", lb.page_indicator(F.col("p"), F.col("l")))] == ["x (1)", "2", "3", "1", "1"]


def test_pages_of_a_tools_output(spark):
    rows = [("a\f b \f", 0), ("a\fb", 3), ("a\fb\fc", 2), ("", 0), (None, 2), ("\f", 0)]
    got = [r[0] and list(r[0]) for r in values(spark, rows, "t string, n int", fi.stdout_pages(F.col("t"), F.col("n")))]
    assert got == [["a", "b"], ["a", "b", ""], ["a", "b"], [""], None, [""]]


def test_moving_an_element(spark):
    rows = [([1, 2, 3, 4], 0, 2), ([1, 2, 3, 4], 3, 0), ([1, 2], 0, 5), ([1, 2], 1, 1), ([], 0, 1)]
    assert [list(r[0]) for r in values(spark, rows, "l array<int>, a int, b int", fi.move_element(F.col("l"), F.col("a"), F.col("b")))] == [[2, 3, 1, 4], [4, 1, 2, 3], [1, 2], [1, 2], []]


def test_keys_and_points(spark):
    rows = [("s", 3, "9R", "u", "7"), ("", 3, None, "", "7"), (None, 1, None, None, None)]
    got = values(spark, rows, "s string, p int, a string, u string, i string", cm.memory_keys(*[F.col(c) for c in "spaui"]))
    assert list(got[0][0]) == ["stable:s", "ann:3:9R", "ann:any:9R", "uid:3:u", "uid:any:u", "id:3:7", "id:any:7"]
    assert list(got[1][0]) == ["id:3:7", "id:any:7"] and list(got[2][0]) == []
    rows = [("a", "u", "editor", "t", True, 5, 1), (None, "", "pdf", "  ", False, None, None)]
    schema = "a string, u string, s string, t string, n boolean, m int, r int"
    assert [r[0] for r in values(spark, rows, schema, cm.merge_points(*[F.col(c) for c in "ausTnmr".replace("T", "t")]))] == [215, 0]


@pytest.mark.parametrize("count,name", [(0, "combined.pdf"), (1, "/a/b.pdf"), (2, "/a/b-combined.pdf")])
def test_combined_name(spark, count, name):
    assert values(spark, [("/a/b.png",)], "p string", fi.combined_name(F.col("p"), F.lit(count))) == [(name,)]


def test_export_and_validity(spark):
    rows = [(" /a/x.JPG ",), ("/a.b/x",), ("/a/x.gif",)]
    got = [tuple(r[0]) for r in values(spark, rows, "p string", fi.image_export(F.col("p")))]
    assert got == [("/a/x.JPG", "jpeg"), ("/a.b/x.png", "png"), ("/a/x.gif.png", "png")]
    rows = [([1.0, 2.0],), ([],), ([0.0],), ([1.5],), (None,), ([None],)]
    assert [r[0] for r in values(spark, rows, "p array<double>", fi.valid_pages(F.col("p")))] == [True, False, False, False, False, False]


def test_runs_and_clips(spark):
    t = spark.createDataFrame([(1, "ab\n\ncde"), (2, ""), (3, None)], "k int, text string")
    runs = links.text_runs(t, ["k"])
    assert sorted((r["k"], r["run"], r["run_start"], r["run_end"]) for r in runs.collect()) == [(1, 0, 0, 2), (1, 1, 3, 3), (1, 2, 4, 7), (2, 0, 0, 0)]
    hits = spark.createDataFrame([(1, 1, 5), (1, 2, 4)], "k int, start_offset int, end_offset int")
    got = {(r["start_offset"], r["run"], r["clip_start"], r["clip_end"]) for r in links.clipped_hits(runs, hits, ["k"]).collect()}
    # an empty run within a hit is met, with nothing to show
    assert got == {(1, 0, 1, 2), (1, 1, 0, 0), (1, 2, 0, 1), (2, 1, 0, 0)}


def test_alignment_prefers_context_then_place(spark):
    rows = [(1, "a cat sat. the cat ran. a cat hid", "cat", "the ", " ran", 0), (2, "cat cat", "cat", "", "", 1), (3, "dog", "cat", "", "", 0), (4, None, "cat", "", "", 0)]
    df = spark.createDataFrame(rows, "hit int, text string, word string, before string, after string, expected int")
    assert {tuple(r) for r in links.aligned(df).collect()} == {(1, 1), (2, 1)}


def test_tab_order(spark):
    groups = spark.createDataFrame([("a", 1), ("b", 2)], "grp string, grp_order int")
    members = spark.createDataFrame([("a", "t1", 1), ("a", "t2", 2), ("b", "t3", 1), ("b", "t1", 2)], "grp string, item string, item_order int")
    items = spark.createDataFrame([("t3", 1), ("detached", 2), ("t2", 3), ("t1", 4)], "item string, own_order int")
    got = [r["item"] for r in links.merged_order(groups, members, items).orderBy("place").collect()]
    assert got == ["t1", "t2", "t3", "detached"]


def test_moving_branches(spark):
    nodes = spark.createDataFrame([(1, None, 1), (2, 1, 1), (3, 1, 2), (4, 3, 1), (5, None, 2)], "id long, parent long, ord int")
    pick = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id long")
    tree = lambda df: {(r["id"], r["parent"], r["place"]) for r in df.collect()}
    assert tree(trees.move_branches(nodes, pick(3, 4), 1, "before")) == {(3, None, 1), (1, None, 2), (5, None, 3), (2, 1, 1), (4, 3, 1)}
    assert tree(trees.move_branches(nodes, pick(5), 3, "child")) == {(1, None, 1), (2, 1, 1), (3, 1, 2), (4, 3, 1), (5, 3, 2)}
    same = {(1, None, 1), (2, 1, 1), (3, 1, 2), (4, 3, 1), (5, None, 2)}
    assert tree(trees.move_branches(nodes, pick(3), 4, "after")) == same == tree(trees.move_branches(nodes, pick(3), 99, "after"))


def test_deep_and_circular_trees(spark):
    chain = [(i, i - 1 if i else None) for i in range(150)]
    nodes = spark.createDataFrame(chain + [(1000, 1001), (1001, 1000), (1002, 1001), (1003, 5555), (None, 3)], "id long, parent long")
    assert trees.closure(nodes).count() == 150 * 151 // 2 + 4
    asked = trees.closure(nodes, asked=nodes.where("id IN (149, 1002)")).groupBy("id").count().collect()
    assert {tuple(r) for r in asked} == {(149, 150), (1002, 1)}


def test_changed_sets_and_hydration(spark):
    a = spark.createDataFrame([("f", 1), ("f", 1), ("g", 2)], "k string, v int")
    b = spark.createDataFrame([("f", 1), ("g", 2), ("h", 3)], "k string, v int")
    assert {tuple(r) for r in links.changed_sets(a, b, "k", ["v"]).collect()} == {("f", True), ("g", False), ("h", True)}
    c = spark.createDataFrame([(1, "old", False, ["a", "b"]), (2, "new", False, ["b"]), (3, " ", False, ["a", "b"]), (4, "", True, ["a"]), (5, None, False, ["z"])], "id int, text string, has_note boolean, keys array<string>")
    got = {r["id"]: (r["text"], r["from_key"]) for r in links.hydrated(c).collect()}
    assert got == {1: ("old", None), 2: ("new", None), 3: ("old", "a"), 4: ("", None), 5: (None, None)}


def test_index_folders(spark, tmp_path):
    from quirelake.sources import index

    path = str(tmp_path / "index")
    assert index.read_index_dir(spark, path) is None
    rows = [("a.pdf", 1, "one"), ("a.pdf", 2, ""), ("b.pdf", 1, "é"), ("b.pdf", 0, "none"), (None, 1, "none")]
    index.write_index_dir(spark.createDataFrame(rows, "document string, page_number int, text string"), path)
    assert {tuple(r) for r in index.read_index_dir(spark, path).collect()} == {("a.pdf", 1, "one"), ("a.pdf", 2, ""), ("b.pdf", 1, "é")}
    index.write_index_dir(spark.createDataFrame([("c.pdf", 3, "new")], "document string, page_number int, text string"), path)
    assert {tuple(r) for r in index.read_index_dir(spark, path).collect()} == {("c.pdf", 3, "new")}
    assert [p.name for p in tmp_path.iterdir()] == ["index"]


def test_documents_written_and_read(spark):
    from quirelake.sources import sinks

    d = spark.createDataFrame([(1, "a <b>\n& c", False), (2, None, True), (3, "x\x07y", None)], "id int, text string, r boolean")
    got = {r["id"]: tuple(r)[1:] for r in sinks.read_docx(sinks.to_docx(d, "id", "text", "r"), "id").collect()}
    assert got == {1: (True, 2, False, "a <b>\n& c"), 2: (True, 1, True, ""), 3: (True, 1, False, "xy")}
    bad = spark.createDataFrame([(1, bytearray(b"PKno"))], "id int, content binary")
    assert sinks.read_docx(bad, "id").collect()[0]["sound"] is False
