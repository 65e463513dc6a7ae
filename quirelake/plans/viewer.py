"""What a viewer derives from its tables: labels, colours, destinations, highlights, exports, tree edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirelake.functions import colours as co
from quirelake.functions import comments as cm
from quirelake.functions import files as fi
from quirelake.functions import labels as lb
from quirelake.functions import text as tx
from quirelake.operators import links, trees
from quirelake.plans.annotations import _C, comments
from quirelake.plans.registry import query
from quirelake.runtime import table

# ---- subtypes and notes: spellings in turn, by the comment's number -----------------------

SPELLINGS = [" Highlight", "UNDERLINE", "squiggly", "strikeout", "Text", "note-linked", "FreeText ", "typewriter", "note-inline", "Ink", "line", "straight-line", "square", "GeomSquare", "rectangle", "circle", "geomcircle", "ellipse", "polygon", "stamp", "Popup", "strike-through", "caret", ""]
_SUB = "WITH s AS (SELECT doc_id, kind, CASE WHEN doc_id % 29 = 0 THEN NULL ELSE [" + ", ".join(f"'{x}'" for x in SPELLINGS) + "][doc_id % 24 + 1] END AS subtype FROM documents), t AS (SELECT *, lower(trim(coalesce(subtype, ''))) AS p FROM s) "


def _subtypes(spark: SparkSession, folder: str) -> DataFrame:
    d = F.col("doc_id")
    said = F.element_at(F.array(*[F.lit(x) for x in SPELLINGS]), (d % 24 + 1).cast("int"))
    return table(spark, folder, "documents").select("doc_id", "kind", F.when(d % 29 != 0, said).alias("subtype"))


@query(
    _SUB
    + "SELECT doc_id, CASE WHEN p = 'highlight' THEN 'Highlight' WHEN p = 'underline' THEN 'Underline' WHEN p = 'squiggly' THEN 'Squiggle' WHEN p = 'strikeout' THEN 'Strike Out' WHEN p IN ('text', 'note-linked') THEN 'Pop-up Note' "
    "WHEN p IN ('freetext', 'typewriter', 'note-inline') THEN 'Inline Note' WHEN p = 'ink' THEN 'Freehand Line' WHEN p IN ('line', 'straight-line') THEN 'Line' WHEN p IN ('square', 'geomsquare', 'rectangle') THEN 'Rectangle' "
    "WHEN p IN ('circle', 'geomcircle', 'ellipse') THEN 'Circle' WHEN p = 'polygon' THEN 'Polygon' WHEN p = 'stamp' THEN 'Stamp' ELSE 'Annotation' END AS label FROM t"
)
def proj_p10_kind_labels(spark: SparkSession, folder: str) -> DataFrame:
    return _subtypes(spark, folder).select("doc_id", cm.kind_label(F.col("subtype")).alias("label"))


@query(_SUB + "SELECT doc_id, p IN ('highlight', 'underline', 'squiggly', 'strikeout') AS markup, p = 'popup' AS popup FROM t")
def f06_markup_subtypes(spark: SparkSession, folder: str) -> DataFrame:
    s = F.col("subtype")
    return _subtypes(spark, folder).select("doc_id", cm.is_text_markup(s).alias("markup"), cm.is_popup(s).alias("popup"))


@query(_SUB + ", n AS (SELECT doc_id, regexp_replace(p, '[^a-z0-9]+', '', 'g') AS n FROM t) SELECT doc_id, CASE n WHEN 'strikethrough' THEN 'strikeout' WHEN 'typewriter' THEN 'freetext' WHEN 'noteinline' THEN 'freetext' WHEN 'notelinked' THEN 'text' ELSE n END AS token FROM n")
def x02_subtype_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return _subtypes(spark, folder).select("doc_id", cm.subtype_token(F.col("subtype")).alias("token"))


@query(_SUB + "SELECT doc_id FROM t WHERE doc_id % 10 = 3 OR lower(coalesce(subtype, '')) LIKE '%popup%' OR lower(coalesce(subtype, '')) LIKE '%text%' OR lower(coalesce(subtype, '')) LIKE '%note%' OR regexp_matches(replace(kind, '_', ' '), '\\b(note|comment|sticky)\\b', 'i')")
def f05_note_types(spark: SparkSession, folder: str) -> DataFrame:
    label = F.replace("kind", F.lit("_"), F.lit(" "))
    return _subtypes(spark, folder).where(cm.is_note(F.col("doc_id") % 10 == 3, F.col("subtype"), label)).select("doc_id")


# ---- identities --------------------------------------------------------------------------

_KEYS = (
    _C
    + ", k AS (SELECT id, text, has_note, list_distinct(list_filter([CASE WHEN stable <> '' THEN 'stable:' || stable END, 'ann:' || page || ':' || ann_id, 'ann:any:' || ann_id, CASE WHEN uid <> '' THEN 'uid:' || page || ':' || uid END, CASE WHEN uid <> '' THEN 'uid:any:' || uid END, 'id:' || page || ':' || id, 'id:any:' || id], lambda x: x IS NOT NULL)) AS keys, "
    "list_filter([CASE WHEN stable <> '' THEN 'stable:' || stable END, 'ann:' || page || ':' || ann_id, 'ann:any:' || ann_id, CASE WHEN uid <> '' THEN 'uid:' || page || ':' || uid END, CASE WHEN uid <> '' THEN 'uid:any:' || uid END, 'id:' || page || ':' || id, 'id:any:' || id], lambda x: x IS NOT NULL) AS ordered FROM "
    "(SELECT *, id % 13 = 5 AS has_note, CASE WHEN ann_id IS NOT NULL THEN 'ann:' || page || ':' || ann_id WHEN uid <> '' THEN 'uid:' || page || ':' || uid ELSE 'src:' || source || ':' || page || ':' || id END AS stable FROM c)) "
)


def _keyed(spark: SparkSession, folder: str) -> DataFrame:
    c = comments(spark, folder)
    stable = cm.stable_key(F.col("page"), F.col("ann_id"), F.col("uid"), F.col("source"), F.col("id"))
    return c.select("*", (F.col("id") % 13 == 5).alias("has_note"), cm.memory_keys(stable, F.col("page"), F.col("ann_id"), F.col("uid"), F.col("id")).alias("keys"))


@query(_KEYS + "SELECT id, unnest(keys) AS key FROM k")
def proj_p04_lookup_keys(spark: SparkSession, folder: str) -> DataFrame:
    return _keyed(spark, folder).select("id", F.explode("keys").alias("key"))


@query(
    _KEYS
    + ", m AS (SELECT key, arg_max(text, id) AS known FROM (SELECT id, text, unnest(ordered) AS key FROM k WHERE trim(text) <> '') GROUP BY key), "
    "a AS (SELECT id, unnest(ordered) AS key, generate_subscripts(ordered, 1) AS n FROM k WHERE trim(text) = '' AND NOT has_note), "
    "g AS (SELECT id, arg_min(known, n) AS known, arg_min(key, n) AS key FROM a JOIN m USING (key) GROUP BY id) SELECT k.id, length(coalesce(g.known, k.text)) AS size, md5(coalesce(g.known, k.text)) AS digest, g.key AS from_key FROM k LEFT JOIN g USING (id)"
)
def j11_hydrated_comments(spark: SparkSession, folder: str) -> DataFrame:
    got = links.hydrated(_keyed(spark, folder))
    return got.select("id", F.length("text").cast("long").alias("size"), F.md5("text").alias("digest"), "from_key")


@query(
    _C
    + "SELECT page, id FROM (SELECT page, id, row_number() OVER (PARTITION BY page ORDER BY CASE WHEN ann_id IS NOT NULL THEN 110 ELSE 0 END + CASE WHEN uid <> '' THEN 55 ELSE 0 END + CASE WHEN source = 'editor' THEN 22 ELSE 0 END + CASE WHEN trim(text) <> '' THEN 12 ELSE 0 END "
    "+ CASE WHEN id % 13 = 5 THEN 8 ELSE 0 END + CASE WHEN coalesce(at_us, 0) <> 0 THEN 5 ELSE 0 END + CASE WHEN w > 0 AND h > 0 THEN 3 ELSE 0 END DESC, coalesce(at_us, 0) DESC, id) AS k FROM c) WHERE k = 1"
)
def o03_merge_priority(spark: SparkSession, folder: str) -> DataFrame:
    rect = F.when((F.col("w") > 0) & (F.col("h") > 0), F.lit(1))
    points = cm.merge_points(F.col("ann_id"), F.col("uid"), F.col("source"), F.col("text"), F.col("id") % 13 == 5, F.col("at_us"), rect)
    best = F.min(F.struct((-points).alias("p"), (-F.coalesce("at_us", F.lit(0))).alias("t"), "id")).alias("m")
    return comments(spark, folder).groupBy("page").agg(best).select("page", F.col("m.id").alias("id"))


@query(_C + "SELECT id, coalesce(nullif(trim(CASE WHEN id % 3 = 0 THEN '  ' WHEN id % 3 = 1 THEN ' rich ' || id END), ''), nullif(trim(CASE WHEN id % 2 = 0 THEN uid END), ''), nullif(trim(text), ''), '') AS shown FROM c")
def x25_coalesced_text(spark: SparkSession, folder: str) -> DataFrame:
    rich = F.when(F.col("id") % 3 == 0, "  ").when(F.col("id") % 3 == 1, F.concat(F.lit(" rich "), F.col("id").cast("string")))
    return comments(spark, folder).select("id", cm.first_text(rich, F.when(F.col("id") % 2 == 0, F.col("uid")), F.col("text")).alias("shown"))


@query(_C + "SELECT id FROM c WHERE CASE WHEN id % 2 = 0 THEN sqrt(w * w + h * h) >= 0.005 ELSE w >= 0.005 AND h >= 0.005 END")
def f18_drawn_shapes(spark: SparkSession, folder: str) -> DataFrame:
    # even ones are lines, the others have an area
    least = 0.005
    line = F.sqrt(F.col("w") * F.col("w") + F.col("h") * F.col("h")) >= least
    return comments(spark, folder).where(F.when(F.col("id") % 2 == 0, line).otherwise((F.col("w") >= least) & (F.col("h") >= least))).select("id")


@query(_C + ", x AS (SELECT id, page, uid FROM c WHERE uid <> ''), l AS (SELECT DISTINCT uid, 1 + CAST(hash_k AS BIGINT) AS given FROM (SELECT uid, min(page) % 7 AS hash_k FROM x GROUP BY uid)) SELECT uid, page, id FROM (SELECT l.uid, x.page, x.id, row_number() OVER (PARTITION BY l.uid ORDER BY x.page <> l.given, x.page, x.id) AS k FROM l JOIN x USING (uid)) WHERE k = 1")
def j13_preferred_page(spark: SparkSession, folder: str) -> DataFrame:
    # the page asked for if the editor is there, else the first page that has it
    x = comments(spark, folder).where("uid <> ''")
    asked = x.groupBy("uid").agg((F.min("page") % 7 + 1).alias("given"))
    first = F.min(F.struct((F.col("page") != F.col("given")).alias("other"), "page", "id")).alias("m")
    return x.join(asked, "uid").groupBy("uid").agg(first).select("uid", F.col("m.page").alias("page"), F.col("m.id").alias("id"))


# ---- colours -----------------------------------------------------------------------------

_COLOUR = "WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN [CAST(p_partkey AS DOUBLE), 2.0] ELSE [CAST(p_partkey * 7 % 320 - 30 AS DOUBLE), p_retailprice / 8, p_size * 5.5] END AS rgb, CASE p_partkey % 5 WHEN 0 THEN '#a' || p_size % 10 || 'C' WHEN 1 THEN '  #A1b2C' || p_size % 10 || ' ' WHEN 2 THEN 'blue' WHEN 3 THEN '#xyz123' END AS said FROM part) "


def _coloured(spark: SparkSession, folder: str) -> DataFrame:
    k, digit = F.col("p_partkey"), (F.col("p_size") % 10).cast("string")
    rgb = F.when(k % 11 == 0, F.array(k.cast("double"), F.lit(2.0))).otherwise(F.array((k * 7 % 320 - 30).cast("double"), F.col("p_retailprice") / 8, F.col("p_size") * 5.5))
    said = F.when(k % 5 == 0, F.concat(F.lit("#a"), digit, F.lit("C"))).when(k % 5 == 1, F.concat(F.lit("  #A1b2C"), digit, F.lit(" "))).when(k % 5 == 2, "blue").when(k % 5 == 3, "#xyz123")
    return table(spark, folder, "part").select("p_partkey", rgb.alias("rgb"), said.alias("said"))


@query(
    _COLOUR
    + ", h AS (SELECT *, list_transform(rgb, lambda x: printf('%02x', CAST(greatest(0, least(255, floor(x + 0.5))) AS INT))) AS hx, lower(trim(said)) AS s FROM p) SELECT p_partkey, CASE WHEN len(rgb) >= 3 THEN '#' || hx[1] || hx[2] || hx[3] END AS colour, "
    "CASE WHEN regexp_matches(s, '^#[0-9a-f]{3}$') THEN '#' || s[2] || s[2] || s[3] || s[3] || s[4] || s[4] WHEN regexp_matches(s, '^#[0-9a-f]{6}$') THEN s END AS bookmark FROM h"
)
def x14_hex_colours(spark: SparkSession, folder: str) -> DataFrame:
    return _coloured(spark, folder).select("p_partkey", co.rgb_to_hex(F.col("rgb")).alias("colour"), co.bookmark_colour(F.col("said")).alias("bookmark"))


@query(
    _COLOUR
    + ", h AS (SELECT p_partkey, trim(said) AS s, CASE WHEN len(trim(said)) = 4 THEN trim(said)[2] || trim(said)[2] || trim(said)[3] || trim(said)[3] || trim(said)[4] || trim(said)[4] ELSE trim(said)[2:7] END AS f FROM p WHERE said IS NOT NULL AND said <> '#xyz123') "
    "SELECT p_partkey, CASE WHEN s[1] = '#' THEN 'rgba(' || CAST('0x' || f[1:2] AS INT) || ', ' || CAST('0x' || f[3:4] AS INT) || ', ' || CAST('0x' || f[5:6] AS INT) || ', 0.4)' ELSE s END AS css FROM h"
)
def x15_css_colours(spark: SparkSession, folder: str) -> DataFrame:
    rows = _coloured(spark, folder).where("said IS NOT NULL AND said <> '#xyz123'")
    return rows.select("p_partkey", co.with_opacity(F.trim("said"), F.lit(0.4)).alias("css"))


# ---- destinations, labels, progress ------------------------------------------------------

_FILES = "WITH n AS (SELECT pdf_path, CAST(max(page_number) AS BIGINT) AS n_pages FROM page_text GROUP BY 1), d AS (SELECT DISTINCT pdf_path, CAST(page_number AS BIGINT) AS p FROM page_text) "


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "page_text").select("pdf_path", F.col("page_number").cast("long").alias("p")).distinct()


@query(
    _FILES
    + ", r AS (SELECT page_id, page_number * 2 - 3 AS raw, n_pages FROM page_text JOIN n USING (pdf_path)) SELECT page_id, CAST(CASE WHEN raw >= 0 AND raw < n_pages THEN raw WHEN raw > 0 AND raw <= n_pages THEN raw - 1 END AS BIGINT) AS dest FROM r"
)
def x30_destinations(spark: SparkSession, folder: str) -> DataFrame:
    t = table(spark, folder, "page_text")
    n = t.groupBy("pdf_path").agg(F.max("page_number").cast("long").alias("n_pages"))
    return t.join(n, "pdf_path").select("page_id", fi.destination_index(F.col("page_number") * 2 - 3, F.col("n_pages")).alias("dest"))


@query(
    _FILES
    + ", i AS (SELECT DISTINCT r.pdf_path, m.request_id || '/' || m.match_index AS item, m.page_number AS p, m.match_index % 4 AS k FROM search_match m JOIN search_request r USING (request_id)), "
    "x AS (SELECT i.*, EXISTS (SELECT 1 FROM d WHERE d.pdf_path = i.pdf_path AND d.p = i.p) AS there, n_pages FROM i LEFT JOIN n USING (pdf_path)) "
    "SELECT pdf_path AS file, item, CAST(CASE WHEN k = 0 AND there AND p % 2 = 1 THEN p - 1 WHEN k = 0 AND there THEN CASE WHEN p < n_pages THEN p ELSE p - 1 END WHEN k = 1 AND there THEN p - 1 WHEN k = 2 AND p < n_pages THEN p WHEN k = 2 AND p <= n_pages THEN p - 1 END AS BIGINT) AS page_index FROM x"
)
def j15_destinations(spark: SparkSession, folder: str) -> DataFrame:
    # items in turn: a name (odd pages' names stand for references, others for numbers), a
    # reference, a number, a name nobody knows
    d = _pages(spark, folder)
    r = table(spark, folder, "search_request").select("request_id", F.col("pdf_path").alias("file")).distinct()
    p, k = F.col("page_number"), F.col("match_index") % 4
    items = table(spark, folder, "search_match").join(r, "request_id").select(
        "file",
        F.concat_ws("/", "request_id", F.col("match_index").cast("string")).alias("item"),
        F.when(k == 0, F.concat(F.lit("p"), p.cast("string"))).when(k == 3, "lost").alias("name"),
        F.when(k == 1, F.concat(F.lit("R"), p.cast("string"))).alias("ref"),
        F.when(k == 2, p.cast("long")).alias("number"),
    ).distinct()
    odd = F.col("p") % 2 == 1
    names = d.select(F.col("pdf_path").alias("file"), F.concat(F.lit("p"), F.col("p").cast("string")).alias("name"), F.when(odd, F.concat(F.lit("R"), F.col("p").cast("string"))).alias("ref"), F.when(~odd, F.col("p")).alias("number"))
    refs = d.select(F.col("pdf_path").alias("file"), F.concat(F.lit("R"), F.col("p").cast("string")).alias("ref"), (F.col("p") - 1).cast("int").alias("page_index"))
    n = d.groupBy(F.col("pdf_path").alias("file")).agg(F.max("p").alias("n_pages"))
    return links.destinations(items, names, refs, n)


_LABELS = _FILES + ", a AS (SELECT pdf_path, n_pages, list_transform(range(1, n_pages + 1), lambda p: CASE WHEN p % 9 = 0 THEN ' ' WHEN p <= 3 THEN 'ab'[1:1] || repeat('I', CAST(p AS INT)) ELSE CAST(p - 3 AS VARCHAR) END) AS labels FROM n) "


def _labelled(spark: SparkSession, folder: str) -> DataFrame:
    n = table(spark, folder, "page_text").groupBy("pdf_path").agg(F.max("page_number").alias("n_pages"))
    one = lambda p: F.when(p % 9 == 0, " ").when(p <= 3, F.concat(F.lit("a"), F.repeat(F.lit("I"), p.cast("int")))).otherwise((p - 3).cast("string"))
    return n.select("pdf_path", "n_pages", F.transform(F.sequence(F.lit(1), "n_pages"), one).alias("labels"))


@query(
    _LABELS
    + ", q AS (SELECT pdf_path, n_pages, labels, unnest([' aii ', '2', 'AIII', '', 'x', '0', CAST(n_pages + 1 AS VARCHAR)]) AS typed FROM a), t AS (SELECT *, trim(typed) AS s FROM q) "
    "SELECT pdf_path, typed, CAST(CASE WHEN s = '' THEN NULL WHEN TRY_CAST(s AS INT) BETWEEN 1 AND n_pages THEN CAST(s AS INT) ELSE coalesce(nullif(list_position(labels, s), 0), nullif(list_position(list_transform(labels, lambda x: lower(x)), lower(s)), 0)) END AS INT) AS page FROM t"
)
def x10_pages_by_label(spark: SparkSession, folder: str) -> DataFrame:
    typed = F.array(*[F.lit(x) for x in (" aii ", "2", "AIII", "", "x", "0")], (F.col("n_pages") + 1).cast("string"))
    q = _labelled(spark, folder).select("*", F.explode(typed).alias("typed"))
    return q.select("pdf_path", "typed", lb.find_page(F.col("typed"), F.col("n_pages"), F.col("labels")).alias("page"))


@query(_LABELS + ", p AS (SELECT a.pdf_path, d.p, trim(labels[d.p]) AS s FROM a JOIN d USING (pdf_path)) SELECT pdf_path, CAST(p AS INT) AS page, CASE WHEN s = '' OR s IS NULL OR s = CAST(p AS VARCHAR) THEN CAST(p AS VARCHAR) ELSE s || ' (' || p || ')' END AS shown FROM p")
def x11_page_indicators(spark: SparkSession, folder: str) -> DataFrame:
    d = _pages(spark, folder).select("pdf_path", F.col("p").cast("int").alias("page"))
    return _labelled(spark, folder).join(d, "pdf_path").select("pdf_path", "page", lb.page_indicator(F.col("page"), F.col("labels")).alias("shown"))


@query(_FILES + "SELECT page_id, CAST(CASE WHEN page_number - 1 <= 0 OR n_pages <= page_number - 1 THEN 0 ELSE floor((page_id * 137 % 90001) / (page_number - 1) * (n_pages - page_number + 1) + 0.5) END AS BIGINT) AS eta_ms FROM page_text JOIN n USING (pdf_path)")
def a12_progress(spark: SparkSession, folder: str) -> DataFrame:
    # page k is at work, those before it are done; the time so far differs from page to page
    t = table(spark, folder, "page_text")
    n = t.groupBy("pdf_path").agg(F.max("page_number").alias("n_pages"))
    return t.join(n, "pdf_path").select("page_id", fi.remaining_ms(F.col("page_id") * 137 % 90001, F.col("page_number") - 1, F.col("n_pages")).alias("eta_ms"))


@query(_FILES + "SELECT page_id, CAST(CASE WHEN page_number % 7 = 6 THEN NULL WHEN page_number % 7 = 5 THEN 0 ELSE floor(page_number * 100.0 / n_pages + 0.5) END AS BIGINT) AS pct FROM page_text JOIN n USING (pdf_path)")
def a26_progress_percent(spark: SparkSession, folder: str) -> DataFrame:
    t = table(spark, folder, "page_text")
    n = t.groupBy("pdf_path").agg(F.max("page_number").alias("n_pages"))
    k = F.col("page_number") % 7
    phase, total = F.when(k == 6, "preparing").otherwise("recognising"), F.when(k == 5, 0).otherwise(F.col("n_pages"))
    return t.join(n, "pdf_path").select("page_id", fi.percent(phase, F.col("page_number"), total).alias("pct"))


# ---- text runs and highlights ------------------------------------------------------------

_RUNS = "WITH t AS (SELECT page_id, string_split(text, chr(10)) AS l FROM page_text WHERE text IS NOT NULL), r AS (SELECT page_id, i AS run, CAST(coalesce(list_sum(list_transform(l[1:i], lambda x: length(x) + 1)), 0) AS BIGINT) AS s, length(l[i + 1]) AS n FROM (SELECT page_id, l, unnest(range(len(l))) AS i FROM t)) "


@query(_RUNS + "SELECT page_id, CAST(run AS INT) AS run, CAST(s AS INT) AS run_start, CAST(s + n AS INT) AS run_end FROM r")
def w11_run_offsets(spark: SparkSession, folder: str) -> DataFrame:
    return links.text_runs(table(spark, folder, "page_text").select("page_id", "text"), ["page_id"]).drop("run_text")


@query(
    _RUNS
    + ", h AS (SELECT DISTINCT m.request_id, m.match_index, m.start_offset, m.end_offset, p.page_id FROM search_match m JOIN search_request q USING (request_id) JOIN page_text p ON p.pdf_path = q.pdf_path AND p.page_number = m.page_number) "
    "SELECT request_id, match_index, page_id, CAST(run AS INT) AS run, CAST(greatest(start_offset, s) - s AS INT) AS clip_start, CAST(least(end_offset, s + n) - s AS INT) AS clip_end FROM h JOIN r USING (page_id) WHERE start_offset < s + n AND end_offset > s"
)
def j04_clipped_hits(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "page_text").select("page_id", "pdf_path", "page_number", "text")
    requests = table(spark, folder, "search_request").select("request_id", "pdf_path").distinct()
    hits = table(spark, folder, "search_match").select("request_id", "match_index", "page_number", "start_offset", "end_offset").distinct()
    hits = hits.join(requests, "request_id").join(pages.drop("text"), ["pdf_path", "page_number"]).select("page_id", "request_id", "match_index", "start_offset", "end_offset")
    # only the texts that have a hit are cut into runs
    runs = links.text_runs(pages.join(hits.select("page_id").distinct(), "page_id", "left_semi").select("page_id", "text"), ["page_id"])
    return links.clipped_hits(runs, hits, ["page_id"]).select("request_id", "match_index", "page_id", "run", "clip_start", "clip_end")


@query(
    "WITH m AS (SELECT DISTINCT m.request_id || ':' || m.match_index AS hit, m.page_match_index, m.excerpt, q.pdf_path, m.page_number FROM search_match m JOIN search_request q USING (request_id)), "
    "h AS (SELECT m.hit || '@' || p.page_id AS hit, p.text, excerpt.match AS w, excerpt.before AS b, excerpt.after AS f, page_match_index AS e FROM m JOIN page_text p ON p.pdf_path = m.pdf_path AND p.page_number = m.page_number WHERE p.text IS NOT NULL AND length(excerpt.match) > 0), "
    "s AS (SELECT *, string_split(lower(text), lower(w)) AS pt FROM h), o AS (SELECT *, unnest(range(1, len(pt))) AS i FROM s), "
    "a AS (SELECT *, CAST(list_sum(list_transform(pt[1:i], lambda x: length(x))) + (i - 1) * length(w) AS BIGINT) AS st FROM o), "
    "c AS (SELECT hit, i, e, lower(regexp_replace(b, '\\s+', ' ', 'g')) AS tb, lower(regexp_replace(f, '\\s+', ' ', 'g')) AS tf, lower(regexp_replace(text[greatest(st - 40, 0) + 1 : st], '\\s+', ' ', 'g')) AS cb, lower(regexp_replace(text[st + length(w) + 1 : st + length(w) + 40], '\\s+', ' ', 'g')) AS cf FROM a), "
    "k AS (SELECT hit, i, len(list_filter(range(1, 42), lambda n: n <= least(length(tb), length(cb)) AND tb[-n:] = cb[-n:])) + len(list_filter(range(1, 42), lambda n: n <= least(length(tf), length(cf)) AND tf[1:n] = cf[1:n])) - abs(i - 1 - e) AS p FROM c) "
    "SELECT hit, CAST(i - 1 AS INT) AS best FROM (SELECT *, row_number() OVER (PARTITION BY hit ORDER BY p DESC, i) AS r FROM k) WHERE r = 1"
)
def j19_aligned_hits(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "page_text").select("page_id", "pdf_path", "page_number", "text")
    requests = table(spark, folder, "search_request").select("request_id", "pdf_path").distinct()
    m = table(spark, folder, "search_match").select("request_id", "match_index", "page_number", "page_match_index", "excerpt").distinct().join(requests, "request_id").join(pages, ["pdf_path", "page_number"])
    name = F.concat(F.concat_ws(":", "request_id", F.col("match_index").cast("string")), F.lit("@"), F.col("page_id").cast("string"))
    hits = m.select(name.alias("hit"), "text", F.col("excerpt.match").alias("word"), F.col("excerpt.before").alias("before"), F.col("excerpt.after").alias("after"), F.col("page_match_index").alias("expected"))
    return links.aligned(hits)


_WORDS = "WITH w AS (SELECT vec_id AS id, vec_id // 50 AS page, floor(abs(embedding[2]) * 60) AS y, floor(abs(embedding[4]) * 300) + 1 AS h FROM embeddings) "


def _words(spark: SparkSession, folder: str) -> DataFrame:
    e = lambda i, k: F.floor(F.abs(F.element_at("embedding", i)) * k)
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.floor(F.col("vec_id") / 50).alias("page"), e(2, 60).alias("y"), (e(4, 300) + 1).alias("h"))


@query(_WORDS + "SELECT id, coalesce(abs(lead(y) OVER o - y) > h * 0.5, true) AS is_last FROM w WINDOW o AS (PARTITION BY page ORDER BY id)")
def w02_last_words(spark: SparkSession, folder: str) -> DataFrame:
    o = Window.partitionBy("page").orderBy("id")
    return _words(spark, folder).select("id", F.coalesce(F.abs(F.lead("y").over(o) - F.col("y")) > F.col("h") * 0.5, F.lit(True)).alias("is_last"))


@query(_WORDS + ", c AS (SELECT id, page, CASE WHEN y <> lag(y) OVER (PARTITION BY page ORDER BY id) THEN 1 ELSE 0 END AS new FROM w) SELECT id, CAST(sum(new) OVER (PARTITION BY page ORDER BY id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS line FROM c")
def w03_lines_by_key(spark: SparkSession, folder: str) -> DataFrame:
    o = Window.partitionBy("page").orderBy("id")
    new = F.when(F.col("y") != F.lag("y").over(o), 1).otherwise(0)
    return _words(spark, folder).withColumn("new", new).select("id", F.sum("new").over(o.rowsBetween(Window.unboundedPreceding, 0)).alias("line"))


# ---- files and exports -------------------------------------------------------------------

_PATHS = "WITH f AS (SELECT page_id, pdf_path || ['.jpg', '.TIFF', '', '.png  ', '.gif', '.jpeg'][page_id % 6 + 1] AS path FROM page_text) "


@query(_PATHS + "SELECT page_id, trim(path) || CASE WHEN regexp_matches(lower(trim(path)), '\\.(png|jpe?g|tiff?)$') THEN '' ELSE '.png' END AS target, CASE WHEN regexp_matches(lower(trim(path)), '\\.jpe?g$') THEN 'jpeg' WHEN regexp_matches(lower(trim(path)), '\\.tiff?$') THEN 'tiff' ELSE 'png' END AS format FROM f")
def x32_export_paths(spark: SparkSession, folder: str) -> DataFrame:
    ends = F.array(*[F.lit(x) for x in (".jpg", ".TIFF", "", ".png  ", ".gif", ".jpeg")])
    t = table(spark, folder, "page_text").select("page_id", fi.image_export(F.concat("pdf_path", F.element_at(ends, (F.col("page_id") % 6 + 1).cast("int")))).alias("x"))
    return t.select("page_id", F.col("x.path").alias("target"), F.col("x.format").alias("format"))


@query("WITH d AS (SELECT DISTINCT pdf_path, page_number FROM page_text WHERE page_number > 0), n AS (SELECT *, row_number() OVER (PARTITION BY pdf_path ORDER BY page_number) AS k, count(*) OVER (PARTITION BY pdf_path) AS n FROM d) SELECT pdf_path, page_number, CASE WHEN n = 1 THEN pdf_path ELSE regexp_replace(pdf_path, '\\.[^./]*$', '') || '-' || lpad(CAST(k AS VARCHAR), CAST(greatest(3, length(CAST(k AS VARCHAR))) AS INT), '0') || regexp_extract(pdf_path, '(\\.[^./]*)$', 1) END AS name FROM n")
def k05_export_names(spark: SparkSession, folder: str) -> DataFrame:
    by = Window.partitionBy("pdf_path")
    d = table(spark, folder, "page_text").where("page_number > 0").select("pdf_path", "page_number").distinct()
    n = d.withColumn("k", F.row_number().over(by.orderBy("page_number"))).withColumn("n", F.count(F.lit(1)).over(by))
    return n.select("pdf_path", "page_number", fi.numbered_name(F.col("pdf_path"), F.col("k"), F.col("n")).alias("name"))


@query("WITH r AS (SELECT request_id, CASE WHEN page_count % 4 = 0 THEN CAST([] AS INT[]) ELSE [page_count, page_count - 5, length(query)] END AS pages FROM (SELECT DISTINCT request_id, page_count, query FROM search_request)) SELECT request_id, len(pages) > 0 AND len(list_filter(pages, lambda p: p IS NULL OR p < 1)) = 0 AS ok FROM r")
def f11_valid_pages(spark: SparkSession, folder: str) -> DataFrame:
    r = table(spark, folder, "search_request").select("request_id", "page_count", "query").distinct()
    n = F.col("page_count")
    pages = F.when(n % 4 == 0, F.array().cast("array<int>")).otherwise(F.array(n, n - 5, F.length("query")))
    return r.select("request_id", fi.valid_pages(pages).alias("ok"))


@query(
    "WITH r AS (SELECT doc_id, doc_id % 4 AS expected, string_split(replace(text, chr(10) || chr(10), chr(12)), chr(12)) AS p FROM documents WHERE text IS NOT NULL), "
    "q AS (SELECT doc_id, CASE WHEN expected > 0 THEN list_concat(p, list_transform(range(greatest(expected - len(p), 0)), lambda i: ''))[1:expected] WHEN len(p) > 1 AND NOT regexp_matches(p[-1], '[^ \\t\\n\\r\\f\\v]') THEN p[1:len(p) - 1] ELSE p END AS p FROM r), "
    "x AS (SELECT doc_id, unnest(p) AS page, generate_subscripts(p, 1) AS n FROM q) SELECT doc_id, CAST(n AS INT) AS page_number, md5(trim(page, ' ' || chr(9) || chr(10) || chr(11) || chr(13))) AS digest FROM x"
)
def s02_form_feed_pages(spark: SparkSession, folder: str) -> DataFrame:
    # a tool's output: blank lines stand for form feeds, three of four documents have an expected page count
    said = F.replace("text", F.lit("\n\n"), F.lit("\f"))
    pages = table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(fi.stdout_pages(said, F.col("doc_id") % 4)).alias("n", "page"))
    return pages.select("doc_id", (F.col("n") + 1).alias("page_number"), F.md5("page").alias("digest"))


@query("WITH s AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN ' ' || n_chars || chr(10) WHEN 1 THEN '-3' WHEN 2 THEN 'none' WHEN 3 THEN '0' ELSE n_chars || ' dpi' END AS said FROM documents), n AS (SELECT doc_id, TRY_CAST(nullif(regexp_extract(trim(said, ' ' || chr(10)), '^(\\d+)', 1), '') AS INT) AS n FROM s) SELECT doc_id, CASE WHEN n > 0 THEN n END AS pages, CASE WHEN n > 0 THEN n ELSE 300 END AS dpi FROM n")
def s11_probes(spark: SparkSession, folder: str) -> DataFrame:
    k, n = F.col("doc_id") % 5, F.col("n_chars").cast("string")
    said = F.when(k == 0, F.concat(F.lit(" "), n, F.lit("\n"))).when(k == 1, "-3").when(k == 2, "none").when(k == 3, "0").otherwise(F.concat(n, F.lit(" dpi")))
    flat = F.trim(said)
    return table(spark, folder, "documents").select("doc_id", fi.probed_pages(flat).alias("pages"), fi.probed_dpi(flat).alias("dpi"))


@query("SELECT id, CASE WHEN b < 1024 THEN CAST(b AS VARCHAR) || ' B' ELSE CASE WHEN v >= 10 THEN printf('%.1f', v) ELSE printf('%.2f', v) END || ' ' || ['KB', 'MB', 'GB', 'TB'][u] END AS label FROM (SELECT id, b, u, b / pow(1024, u) AS v FROM (SELECT id, b, CASE WHEN b < 1048576 THEN 1 WHEN b < 1073741824 THEN 2 WHEN b < 1099511627776 THEN 3 ELSE 4 END AS u FROM (SELECT id, size * [1, 64, 4096, 16777216][id % 4 + 1] // CASE WHEN id % 9 = 0 THEN 100000000 ELSE 1 END AS b FROM release_asset)))")
def x03_byte_labels(spark: SparkSession, folder: str) -> DataFrame:
    scale = F.element_at(F.array(*[F.lit(x).cast("long") for x in (1, 64, 4096, 16777216)]), (F.col("id") % 4 + 1).cast("int"))
    size = F.floor(F.col("size") * scale / F.when(F.col("id") % 9 == 0, 100000000).otherwise(1)).cast("long")
    return table(spark, folder, "release_asset").select("id", tx.size_label(size).alias("label"))


# ---- lists and trees ---------------------------------------------------------------------

_LISTS = "WITH l AS (SELECT pdf_path, array_agg(page_id ORDER BY page_id) AS ids, count(*) AS n FROM page_text GROUP BY 1), m AS (SELECT pdf_path, ids, n, n % 4 AS a, n % 3 + 1 AS b FROM l) "


@query(_LISTS + ", r AS (SELECT *, list_concat(ids[1:a], ids[a + 2:]) AS rest FROM m) SELECT pdf_path, array_to_string(CASE WHEN a < n AND b < n AND a <> b THEN list_concat(rest[1:b], list_concat([ids[a + 1]], rest[b + 1:])) ELSE ids END, ',') AS ids FROM r")
def u20_moved_elements(spark: SparkSession, folder: str) -> DataFrame:
    l = table(spark, folder, "page_text").groupBy("pdf_path").agg(F.array_sort(F.collect_list("page_id")).alias("ids"))
    n = F.size("ids")
    return l.select("pdf_path", F.array_join(F.transform(fi.move_element(F.col("ids"), n % 4, n % 3 + 1), lambda x: x.cast("string")), ",").alias("ids"))


@query("WITH l AS (SELECT doc_id, [CASE WHEN doc_id % 3 = 0 THEN 'eng' END, lang, 'syr', CASE WHEN doc_id % 2 = 0 THEN 'heb' ELSE '' END, 'eng', lang] AS codes FROM documents), f AS (SELECT doc_id, list_filter(codes, lambda c: c IS NOT NULL AND c <> '') AS c FROM l), u AS (SELECT doc_id, list_filter(c, lambda x, i: list_position(c, x) = i) AS c FROM f) SELECT doc_id, array_to_string(list_concat(list_filter(c, lambda x: x IN ('heb', 'syr')), list_filter(c, lambda x: x NOT IN ('heb', 'syr'))), '+') AS codes FROM u")
def o12_rtl_first(spark: SparkSession, folder: str) -> DataFrame:
    d = F.col("doc_id")
    codes = F.array(F.when(d % 3 == 0, "eng"), F.col("lang"), F.lit("syr"), F.when(d % 2 == 0, "heb").otherwise(""), F.lit("eng"), F.col("lang"))
    return table(spark, folder, "documents").select("doc_id", F.array_join(fi.rtl_first(codes), "+").alias("codes"))


@query("WITH g AS (SELECT r_regionkey AS g, row_number() OVER (ORDER BY r_name DESC) AS o FROM region), t AS (SELECT n.n_nationkey AS item, n.n_name, CASE WHEN n.n_nationkey % 4 <> 1 THEN g.o END AS o FROM nation n JOIN g ON n.n_regionkey = g.g) SELECT item, CAST(row_number() OVER (ORDER BY o IS NULL, o, CASE WHEN o IS NOT NULL THEN n_name END, item) AS INT) AS place FROM t")
def j20_merged_tabs(spark: SparkSession, folder: str) -> DataFrame:
    # groups are the regions, their tabs the nations but for every fourth, which are left over
    n, r = table(spark, folder, "nation"), table(spark, folder, "region")
    # a fixed table of five regions
    groups = r.select(F.col("r_regionkey").alias("grp"), F.row_number().over(Window.orderBy(F.col("r_name").desc())).alias("grp_order"))
    members = n.where("n_nationkey % 4 <> 1").select(F.col("n_regionkey").alias("grp"), F.col("n_nationkey").alias("item"), F.col("n_name").alias("item_order"))
    return links.merged_order(groups, members, n.select(F.col("n_nationkey").alias("item"), F.col("n_nationkey").alias("own_order")))


@query("WITH v AS (SELECT pdf_path, page_number, coalesce(lang, '') AS lang, row_number() OVER (PARTITION BY pdf_path, page_number ORDER BY page_id) AS a, row_number() OVER (PARTITION BY pdf_path, page_number ORDER BY page_id DESC) AS z FROM page_text), d AS ((SELECT pdf_path, page_number, lang FROM v WHERE a = 1 EXCEPT ALL SELECT pdf_path, page_number, lang FROM v WHERE z = 1) UNION ALL (SELECT pdf_path, page_number, lang FROM v WHERE z = 1 EXCEPT ALL SELECT pdf_path, page_number, lang FROM v WHERE a = 1)) SELECT DISTINCT pdf_path, pdf_path IN (SELECT pdf_path FROM d) AS dirty FROM page_text")
def a25_changed_files(spark: SparkSession, folder: str) -> DataFrame:
    # the first extraction of each page is the baseline, the last one is what stands now
    pick = lambda f: F.coalesce(f("lang", "page_id"), F.lit("")).alias("lang")
    t = table(spark, folder, "page_text").withColumn("lang", F.coalesce("lang", F.lit("")))
    g = t.groupBy("pdf_path", "page_number")
    return links.changed_sets(g.agg(pick(F.max_by)), g.agg(pick(F.min_by)), "pdf_path", ["page_number", "lang"])


_MOVE = "WITH RECURSIVE t AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey >= 4 THEN s_suppkey // 4 END AS parent, CAST(s_suppkey AS DOUBLE) AS ord FROM supplier), b AS (SELECT id FROM t WHERE id IN (5, 9, 21) UNION SELECT t.id FROM t JOIN b ON t.parent = b.id) "


def _outline(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("s_suppkey")
    return table(spark, folder, "supplier").select(key.cast("long").alias("id"), F.when(key >= 4, F.floor(key / 4)).alias("parent"), key.alias("ord"))


@query(_MOVE + ", m AS (SELECT id, CASE WHEN id IN (5, 9) THEN 1 ELSE parent END AS parent, CASE WHEN id IN (5, 9) THEN 6.5 ELSE ord END AS ord, ord AS own FROM t) SELECT id, parent, CAST(row_number() OVER (PARTITION BY parent ORDER BY ord, own) AS INT) AS place FROM m")
def u12_moved_branches(spark: SparkSession, folder: str) -> DataFrame:
    # 21 lies under 5 and goes with it; 6 is a child of 1
    return trees.move_branches(_outline(spark, folder), spark.createDataFrame([(5,), (9,), (21,)], "id long"), 6, "after")


@query(_MOVE + "SELECT id, parent, CAST(row_number() OVER (PARTITION BY parent ORDER BY ord) AS INT) AS place FROM t")
def u12_rejected_drop(spark: SparkSession, folder: str) -> DataFrame:
    # 22 lies under 5: a branch is not dropped into itself
    return trees.move_branches(_outline(spark, folder), spark.createDataFrame([(5,)], "id long"), 22, "child")


@query("WITH p AS (SELECT i AS x, CAST(abs(embedding[i]) AS DOUBLE) AS v FROM embeddings, range(1, 9) r(i)) SELECT CAST(x AS INT) AS x, round(sum(v), 4) AS total, round(avg(v), 6) AS mean, round(var_pop(v), 6) AS variance, round(quantile_cont(v, 0.9), 6) AS p90 FROM p GROUP BY x")
def a16_projections(spark: SparkSession, folder: str) -> DataFrame:
    # a row of pixels for each vector, projected on its first eight columns
    v = table(spark, folder, "embeddings").select(F.posexplode(F.slice("embedding", 1, 8)).alias("x", "v")).select((F.col("x") + 1).alias("x"), F.abs("v").cast("double").alias("v"))
    return v.groupBy("x").agg(F.round(F.sum("v"), 4).alias("total"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.var_pop("v"), 6).alias("variance"), F.round(F.percentile("v", 0.9), 6).alias("p90"))


@query("WITH o AS (SELECT o_orderkey, o_custkey, o_totalprice FROM orders) SELECT o_orderkey, CAST(ntile(4) OVER w AS INT) AS quarter, round(percent_rank() OVER w, 9) AS pr, round(cume_dist() OVER w, 9) AS cd FROM o WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)")
def w12_ranks(spark: SparkSession, folder: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey")
    return table(spark, folder, "orders").select("o_orderkey", F.ntile(4).over(w).alias("quarter"), F.round(F.percent_rank().over(w), 9).alias("pr"), F.round(F.cume_dist().over(w), 9).alias("cd"))


# ---- render plans: the page asked for last is the current one ----------------------------

_PLAN = "WITH f AS (SELECT pdf_path, CAST(max(page_number) AS INT) AS n FROM page_text GROUP BY 1), w AS (SELECT pdf_path, n, n // 2 + 1 AS cur, n // 3 + 1 AS v0, n // 3 + 3 AS v1 FROM f), p AS (SELECT *, CAST(unnest(range(1, n + 1)) AS INT) AS page FROM w) "


def _plan(spark: SparkSession, folder: str) -> DataFrame:
    f = table(spark, folder, "page_text").groupBy("pdf_path").agg(F.max("page_number").alias("n"))
    third = F.floor(F.col("n") / 3).cast("int")
    w = f.select("pdf_path", "n", (F.floor(F.col("n") / 2) + 1).cast("int").alias("cur"), (third + 1).alias("v0"), (third + 3).alias("v1"))
    return w.select("*", F.explode(F.sequence(F.lit(1), "n")).alias("page"))


@query(_PLAN + "SELECT pdf_path, page, CAST(row_number() OVER (PARTITION BY pdf_path ORDER BY k, page) AS INT) AS place FROM (SELECT pdf_path, page, CASE WHEN page = cur THEN 0 WHEN abs(page - cur) <= 1 THEN 1 WHEN page BETWEEN v0 - 1 AND v1 + 1 THEN 2 WHEN abs(page - cur) <= 8 THEN 3 END AS k FROM p WHERE page % 5 <> 4) WHERE k IS NOT NULL")
def o08_render_queue(spark: SparkSession, folder: str) -> DataFrame:
    # every fifth page is rendered already
    near = lambda n: F.abs(F.col("page") - F.col("cur")) <= n
    k = F.when(F.col("page") == F.col("cur"), 0).when(near(1), 1).when(F.col("page").between(F.col("v0") - 1, F.col("v1") + 1), 2).when(near(8), 3)
    p = _plan(spark, folder).where("page % 5 <> 4").withColumn("k", k).where("k IS NOT NULL")
    return p.select("pdf_path", "page", F.row_number().over(Window.partitionBy("pdf_path").orderBy("k", "page")).alias("place"))


_SHOWN = _PLAN + ", d AS (SELECT DISTINCT r.pdf_path, m.page_number AS page FROM search_match m JOIN search_request r USING (request_id)) "


def _rendered(spark: SparkSession, folder: str) -> DataFrame:
    r = table(spark, folder, "search_request").select("request_id", "pdf_path").distinct()
    return table(spark, folder, "search_match").join(r, "request_id").select("pdf_path", F.col("page_number").alias("page")).distinct()


@query(_SHOWN + "SELECT pdf_path, page, CAST((row_number() OVER (PARTITION BY pdf_path ORDER BY page) - 1) // 3 AS INT) AS batch FROM p ANTI JOIN d USING (pdf_path, page) WHERE page BETWEEN v0 - 2 AND v1 + 2")
def f19_pages_to_render(spark: SparkSession, folder: str) -> DataFrame:
    todo = _plan(spark, folder).where("page BETWEEN v0 - 2 AND v1 + 2").join(_rendered(spark, folder), ["pdf_path", "page"], "left_anti")
    w = Window.partitionBy("pdf_path").orderBy("page")
    return todo.select("pdf_path", "page", F.floor((F.row_number().over(w) - 1) / 3).cast("int").alias("batch"))


@query(_SHOWN + "SELECT d.pdf_path, d.page FROM d LEFT JOIN w USING (pdf_path) WHERE w.n IS NULL OR NOT d.page BETWEEN greatest(1, v0 - 2) AND least(n, v1 + 2)")
def f19_pages_to_drop(spark: SparkSession, folder: str) -> DataFrame:
    kept = _plan(spark, folder).where("page BETWEEN v0 - 2 AND v1 + 2")
    return _rendered(spark, folder).join(kept.select("pdf_path", "page"), ["pdf_path", "page"], "left_anti")


@query(
    _C
    + ", a AS (SELECT id, page, ann_id, uid, source, id + 1 AS other FROM c WHERE id % 2 = 1), b AS (SELECT id, page, ann_id, uid, source FROM c WHERE id % 2 = 0), "
    "m AS (SELECT a.id, 1 AS k, b.id AS hit FROM a JOIN b ON a.page = b.page AND a.ann_id = b.ann_id UNION ALL SELECT a.id, 2, b.id FROM a JOIN b ON a.page = b.page AND a.uid = b.uid AND a.uid <> '' UNION ALL SELECT a.id, 3, b.id FROM a JOIN b ON a.page = b.page AND a.other = b.id) "
    "SELECT id, CAST(k AS INT) AS step, hit FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k, hit) AS r FROM m) WHERE r = 1"
)
def j12_cascading_lookup(spark: SparkSession, folder: str) -> DataFrame:
    # by annotation and page, else by editor and page, else by id and page; of several the first
    c = comments(spark, folder)
    a, b = c.where("id % 2 = 1").withColumn("other", F.col("id") + 1), c.where("id % 2 = 0")
    # of the rows that share a key only the first can win, so each key keeps one
    keep = lambda cols: b.where(" AND ".join(f"{x} <> ''" for x in cols[1:])).groupBy(*cols).agg(F.min("id").alias("hit"))
    steps = [
        a.join(keep(["page", "ann_id"]), ["page", "ann_id"]).select("id", F.lit(1).alias("k"), "hit"),
        a.join(keep(["page", "uid"]), ["page", "uid"]).select("id", F.lit(2).alias("k"), "hit"),
        a.select("id", "page", F.col("other").alias("hit")).join(b.select("page", F.col("id").alias("hit")), ["page", "hit"]).select("id", F.lit(3).alias("k"), "hit"),
    ]
    best = steps[0].unionAll(steps[1]).unionAll(steps[2]).groupBy("id").agg(F.min(F.struct("k", "hit")).alias("m"))
    return best.select("id", F.col("m.k").alias("step"), F.col("m.hit").alias("hit"))


# ---- routes, settings, versions, responses -----------------------------------------------

@query(
    "WITH p AS (SELECT DISTINCT pdf_path FROM page_text), g AS (SELECT grp, array_agg(pdf_path ORDER BY pdf_path) AS ps FROM (SELECT md5(pdf_path)[1:2] AS grp, CASE WHEN md5(pdf_path)[3:3] = '0' THEN pdf_path || '.txt' ELSE pdf_path END AS pdf_path FROM p) GROUP BY 1) "
    "SELECT grp, CASE WHEN len(list_filter(ps, lambda x: NOT regexp_matches(lower(x), '\\.(pdf|djvu|djv)$'))) > 0 THEN 'invalid' WHEN len(list_filter(ps, lambda x: regexp_matches(lower(x), '\\.djvu?$'))) > 0 THEN CASE WHEN len(ps) = 1 THEN 'djvu' ELSE 'invalid' END WHEN len(ps) = 1 THEN 'pdf' ELSE 'combined' END AS route FROM g"
)
def f17_open_routes(spark: SparkSession, folder: str) -> DataFrame:
    # requests of a few files each; one in sixteen files is of a kind that cannot be opened
    p = table(spark, folder, "page_text").select("pdf_path").distinct()
    h = F.md5("pdf_path")
    p = p.select(F.substring(h, 1, 2).alias("grp"), F.when(F.substring(h, 3, 1) == "0", F.concat("pdf_path", F.lit(".txt"))).otherwise(F.col("pdf_path")).alias("path"))
    return p.groupBy("grp").agg(F.array_sort(F.collect_list("path")).alias("ps")).select("grp", fi.open_route(F.col("ps")).alias("route"))


@query(
    "WITH s AS (SELECT doc_id, doc_id % 7 AS k FROM documents) SELECT doc_id, CASE WHEN k IN (0, 3) THEN 2 ELSE 1 END AS version, CASE WHEN k = 1 THEN 'A' || doc_id ELSE '' END AS author, CASE WHEN k = 2 THEN 'dark' ELSE 'light' END AS theme, CASE WHEN k IN (0, 4) THEN 'fr' ELSE 'en' END AS locale, CASE WHEN k = 3 THEN true END AS suppress, CASE WHEN k = 4 THEN '1.2' END AS skipped FROM s"
)
def proj_p14_settings(spark: SparkSession, folder: str) -> DataFrame:
    # seven kinds of stored settings, the sixth of wrong types and the last no JSON
    k = F.col("doc_id") % 7
    raw = (
        F.when(k == 0, '{"version": 2, "locale": "fr", "theme": "blue"}')
        .when(k == 1, F.concat(F.lit('{"authorName": "A'), F.col("doc_id").cast("string"), F.lit('", "version": "3"}')))
        .when(k == 2, '{"theme": "dark", "locale": "xx"}')
        .when(k == 3, '{"version": 2, "suppress": true, "skipped": "  "}')
        .when(k == 4, '{"skipped": " 1.2 ", "locale": "fr", "suppress": "yes"}')
        .when(k == 5, '{"version": null, "authorName": 5, "theme": ["dark"], "locale": 1}')
        .otherwise("{broken")
    )
    return table(spark, folder, "documents").select("doc_id", fi.settings(raw).alias("s")).select("doc_id", "s.*")


_VERSIONS = "WITH v AS (SELECT DISTINCT CASE CAST(id AS BIGINT) % 5 WHEN 0 THEN 'v' || version WHEN 1 THEN version || '-beta.2' WHEN 2 THEN ' V' || version || '.0' WHEN 3 THEN split_part(version, '.', 1) ELSE version END AS v FROM landing_download WHERE version IS NOT NULL AND id IS NOT NULL), p AS (SELECT v, string_split(string_split(regexp_replace(trim(v), '^[vV]', ''), '-')[1], '.') AS p FROM v) "


@query(_VERSIONS + "SELECT v, CAST(rank() OVER (ORDER BY coalesce(TRY_CAST(p[1] AS INT), 0), coalesce(TRY_CAST(p[2] AS INT), 0), coalesce(TRY_CAST(p[3] AS INT), 0), coalesce(TRY_CAST(p[4] AS INT), 0)) AS INT) AS place FROM p")
def o14_version_order(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("id") % 5
    said = F.when(k == 0, F.concat(F.lit("v"), "version")).when(k == 1, F.concat("version", F.lit("-beta.2"))).when(k == 2, F.concat(F.lit(" V"), "version", F.lit(".0"))).when(k == 3, F.element_at(F.split("version", r"\."), 1)).otherwise(F.col("version"))
    v = table(spark, folder, "landing_download").where("version IS NOT NULL AND id IS NOT NULL").select(said.alias("v")).distinct()
    # the distinct versions of one product; equal ones share a place
    return v.select("v", F.rank().over(Window.orderBy(fi.version_parts(F.col("v")))).alias("place"))


@query("SELECT page_id, text IS NOT NULL AS success, CASE WHEN text IS NOT NULL THEN md5(text) END AS digest, CASE WHEN text IS NULL THEN CASE WHEN page_number % 2 = 0 THEN 'page ' || page_number ELSE 'Unknown error' END END AS error FROM page_text")
def proj_p15_responses(spark: SparkSession, folder: str) -> DataFrame:
    error = F.when(F.col("page_number") % 2 == 0, F.concat(F.lit("page "), F.col("page_number").cast("string")))
    r = table(spark, folder, "page_text").select("page_id", fi.recognition_response(F.col("text").isNotNull(), F.col("text"), error).alias("r"))
    return r.select("page_id", "r.success", F.md5("r.text").alias("digest"), "r.error")


@query("SELECT DISTINCT id, country, CASE WHEN id % 3 <> 0 THEN city END AS city, region FROM landing_page_view")
def x20_geo_headers(spark: SparkSession, folder: str) -> DataFrame:
    # every third request lacks the header of the city
    v = table(spark, folder, "landing_page_view").select("id", "country", "city", "region").distinct()
    full = F.create_map(F.lit("x-vercel-ip-country"), F.col("country"), F.lit("x-vercel-ip-country-region"), F.col("region"))
    headers = F.when(F.col("id") % 3 != 0, F.map_concat(full, F.create_map(F.lit("x-vercel-ip-city"), F.col("city")))).otherwise(full)
    return v.select("id", fi.geo(headers).alias("g")).select("id", "g.*")


@query("SELECT CASE WHEN script IN ('latin', 'cyrillic') THEN 'latin or cyrillic' WHEN script = 'greek' THEN 'greek' WHEN script = 'rtl' THEN 'rtl' END AS family, string_agg(code, ',' ORDER BY code) AS codes FROM (SELECT code, script FROM ocr_language UNION ALL SELECT * FROM (VALUES ('ell', 'greek'), ('heb', 'rtl'), ('syr', 'rtl'))) GROUP BY 1")
def f16_language_groups(spark: SparkSession, folder: str) -> DataFrame:
    more = spark.createDataFrame([("ell", "greek"), ("heb", "rtl"), ("syr", "rtl")], "code string, script string")
    s = F.col("script")
    family = F.when(s.isin("latin", "cyrillic"), "latin or cyrillic").when(s.isin("greek", "rtl"), s)
    langs = table(spark, folder, "ocr_language").select("code", "script").unionAll(more)
    return langs.groupBy(family.alias("family")).agg(F.array_join(F.array_sort(F.collect_list("code")), ",").alias("codes"))


@query("WITH j AS (SELECT page_id, '{\"version\": ' || page_id % 4 || ', \"pages\": {\"' || page_number || '\": {\"path\": \"p\"}, \"x\": {\"path\": \"q\"}}}' AS m, CAST(page_number + page_id % 2 AS VARCHAR) AS asked FROM page_text) SELECT page_id, CAST(m->>'$.version' AS INT) >= 2 AS has_data, CAST(m->>'$.version' AS INT) >= 2 AND list_contains(json_keys(m, '$.pages'), asked) AS has_page FROM j")
def f15_ocr_presence(spark: SparkSession, folder: str) -> DataFrame:
    page = F.col("page_number").cast("string")
    m = F.concat(F.lit('{"version": '), (F.col("page_id") % 4).cast("string"), F.lit(', "pages": {"'), page, F.lit('": {"path": "p"}, "x": {"path": "q"}}}'))
    j = table(spark, folder, "page_text").select("page_id", F.from_json(m, "version int, pages map<string, struct<path: string>>").alias("m"), (F.col("page_number") + F.col("page_id") % 2).cast("string").alias("asked"))
    data = F.coalesce(F.col("m.version") >= 2, F.lit(False))
    return j.select("page_id", data.alias("has_data"), (data & F.coalesce(F.map_contains_key("m.pages", F.col("asked")), F.lit(False))).alias("has_page"))


# ---- outlines, shapes, labels ------------------------------------------------------------

@query(
    "WITH s AS (SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN '   ' ELSE ' ' || s_name || ' ' END AS title, CASE WHEN s_suppkey % 7 <> 0 THEN s_nationkey * 2.5 - 6 END AS page, CASE s_suppkey % 3 WHEN 0 THEN ' ' WHEN 1 THEN 'Dest' || s_nationkey END AS dest, CASE s_suppkey % 3 WHEN 0 THEN '#aBc' WHEN 1 THEN '#xyz123' END AS colour FROM supplier) "
    "SELECT id, CASE WHEN trim(title) = '' THEN 'Untitled' ELSE trim(title) END AS title, CAST(greatest(0, least(19, trunc(page))) AS BIGINT) * CASE WHEN page IS NULL THEN NULL ELSE 1 END AS page_index, CASE WHEN trim(dest) <> '' THEN dest END AS named_dest, CASE WHEN colour = '#aBc' THEN '#aabbcc' END AS colour FROM s"
)
def proj_p09_bookmarks(spark: SparkSession, folder: str) -> DataFrame:
    # bookmarks of a document of twenty pages
    k, pages = F.col("s_suppkey"), 20
    s = table(spark, folder, "supplier").select(
        k.alias("id"),
        F.trim(F.when(k % 4 == 0, "   ").otherwise(F.concat(F.lit(" "), "s_name", F.lit(" ")))).alias("title"),
        F.when(k % 7 != 0, F.col("s_nationkey") * 2.5 - 6).alias("page"),
        F.when(k % 3 == 0, " ").when(k % 3 == 1, F.concat(F.lit("Dest"), F.col("s_nationkey").cast("string"))).alias("dest"),
        F.when(k % 3 == 0, "#aBc").when(k % 3 == 1, "#xyz123").alias("colour"),
    )
    index = F.when(F.col("page").isNotNull(), F.greatest(F.lit(0), F.least(F.lit(pages - 1), F.col("page").cast("long"))))
    return s.select(
        "id", F.when(F.col("title") == "", "Untitled").otherwise(F.col("title")).alias("title"), index.cast("long").alias("page_index"),
        F.when(F.trim("dest") != "", F.col("dest")).alias("named_dest"), co.bookmark_colour(F.col("colour")).alias("colour"),
    )


@query(_C + ", x AS (SELECT page, unnest(array_agg(struct_pack(id := id, w := w) ORDER BY id)) AS s FROM c GROUP BY page) SELECT page, s.id AS id, round(CASE WHEN s.id % 10 = 4 THEN s.w * 2 ELSE s.w END, 9) AS width FROM x WHERE s.id % 10 <> 7")
def u19_edited_shapes(spark: SparkSession, folder: str) -> DataFrame:
    # lists of shapes by page: some are widened by their id, some deleted, then all are listed
    lists = comments(spark, folder).groupBy("page").agg(F.array_sort(F.collect_list(F.struct("id", "w"))).alias("shapes"))
    wider = F.transform("shapes", lambda s: F.when(s["id"] % 10 == 4, F.struct(s["id"].alias("id"), (s["w"] * 2).alias("w"))).otherwise(s))
    kept = F.filter(wider, lambda s: s["id"] % 10 != 7)
    return lists.select("page", F.explode(kept).alias("s")).select("page", "s.id", F.round("s.w", 9).alias("width"))


@query(_LABELS + "SELECT a.pdf_path, CAST(d.p AS INT) AS page, CASE WHEN d.p BETWEEN 3 AND least(6, n_pages) THEN 'B-' || (d.p - 3 + 5) ELSE labels[d.p] END AS label FROM a JOIN d USING (pdf_path)")
def u17_overlaid_labels(spark: SparkSession, folder: str) -> DataFrame:
    # pages 3 to 6 are numbered anew: B-5, B-6, ...
    d = _pages(spark, folder).select("pdf_path", F.col("p").cast("int").alias("page"))
    segment = lb.label(F.lit("D"), F.lit("B-"), F.lit(5), F.col("page") - 3)
    return _labelled(spark, folder).join(d, "pdf_path").select("pdf_path", "page", F.when(F.col("page").between(3, F.least(F.lit(6), "n_pages")), segment).otherwise(F.get("labels", F.col("page") - 1)).alias("label"))


@query()
def u17_ranges_after_overlay(spark: SparkSession, folder: str) -> DataFrame:
    from quirelake.operators import series

    return series.infer_label_ranges(u17_overlaid_labels(spark, folder), ["pdf_path"], "page", "label")


@query(_PLAN + ", k AS (SELECT pdf_path, n, page, row_number() OVER (PARTITION BY pdf_path ORDER BY md5(pdf_path || '/' || page || '/7')) AS r FROM p WHERE page NOT IN (1, n // 2 + 1, n)) SELECT pdf_path, page FROM p WHERE page IN (1, n // 2 + 1, n) UNION ALL SELECT pdf_path, page FROM k WHERE r <= 3")
def u14_sampled_pages(spark: SparkSession, folder: str) -> DataFrame:
    # first, middle and last page, and three others by a seeded hash
    p = _plan(spark, folder)
    fixed = F.col("page").isin(1) | (F.col("page") == F.col("cur")) | (F.col("page") == F.col("n"))
    draw = F.md5(F.concat_ws("/", "pdf_path", F.col("page").cast("string"), F.lit("7")))
    others = p.where(~fixed).withColumn("r", F.row_number().over(Window.partitionBy("pdf_path").orderBy(draw))).where("r <= 3")
    return p.where(fixed).select("pdf_path", "page").unionAll(others.select("pdf_path", "page"))


@query("WITH e AS (SELECT user_id, event_type || '/' || CAST(floor(value) AS BIGINT) AS key, max(epoch_us(ts)) AS seen FROM events WHERE value IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2) SELECT user_id, key FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seen DESC, key) AS r FROM e) WHERE r <= 32")
def t08_cached_keys(spark: SparkSession, folder: str) -> DataFrame:
    # a cache of 32 entries for each user: only writing an entry makes it new again
    e = table(spark, folder, "events").where("value IS NOT NULL AND ts IS NOT NULL")
    key = F.concat_ws("/", "event_type", F.floor("value").cast("string"))
    last = e.groupBy("user_id", key.alias("key")).agg(F.max("ts").alias("at"))
    r = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("at").desc(), "key"))
    return last.withColumn("r", r).where("r <= 32").select("user_id", "key")


_HALVES = "WITH h AS (SELECT vec_id, vec_id // 2 AS sheet, vec_id % 2 AS half, CASE WHEN vec_id % 9 <> 0 THEN floor(abs(embedding[1]) * 400) END AS x, floor(abs(embedding[2]) * 400) AS y, floor(abs(embedding[3]) * 300) + 300 AS w, floor(abs(embedding[4]) * 300) + 300 AS hh FROM embeddings), s AS (SELECT sheet, min(y) FILTER (WHERE x IS NOT NULL) AS y1, max(y + hh) FILTER (WHERE x IS NOT NULL) AS y2 FROM h GROUP BY 1) "


@query(_HALVES + "SELECT vec_id, CAST(CASE WHEN x IS NULL THEN 0 WHEN half = 0 THEN greatest(0, x - 30) ELSE 0 END AS BIGINT) AS x1, CAST(CASE WHEN x IS NULL OR half = 0 THEN 1000 ELSE least(1000, x + w + 30) END AS BIGINT) AS x2, CAST(CASE WHEN x IS NULL THEN 0 ELSE greatest(0, y1 - 30) END AS BIGINT) AS y1, CAST(CASE WHEN x IS NULL THEN 1000 ELSE least(1000, y2 + 30) END AS BIGINT) AS y2 FROM h JOIN s USING (sheet)")
def a19_shared_bounds(spark: SparkSession, folder: str) -> DataFrame:
    # halves of sheets of 1000 by 1000: both get the outermost top and bottom, each its own outer
    # edge; a half without content is not cropped
    e = lambda i, k: F.floor(F.abs(F.element_at("embedding", i)) * k)
    v = F.col("vec_id")
    h = table(spark, folder, "embeddings").select("vec_id", F.floor(v / 2).alias("sheet"), (v % 2).alias("half"), F.when(v % 9 != 0, e(1, 400)).alias("x"), e(2, 400).alias("y"), (e(3, 300) + 300).alias("w"), (e(4, 300) + 300).alias("h"))
    there, pad, side = F.col("x").isNotNull(), 30, 1000
    s = h.groupBy("sheet").agg(F.min(F.when(there, F.col("y"))).alias("top"), F.max(F.when(there, F.col("y") + F.col("h"))).alias("bottom"))
    cropped = lambda value, other: F.when(there, value).otherwise(other).cast("long")
    return h.join(s, "sheet").select(
        "vec_id",
        cropped(F.when(F.col("half") == 0, F.greatest(F.lit(0), F.col("x") - pad)).otherwise(0), 0).alias("x1"),
        cropped(F.when(F.col("half") == 0, side).otherwise(F.least(F.lit(side), F.col("x") + F.col("w") + pad)), side).alias("x2"),
        cropped(F.greatest(F.lit(0), F.col("top") - pad), 0).alias("y1"),
        cropped(F.least(F.lit(side), F.col("bottom") + pad), side).alias("y2"),
    )


@query("SELECT lang, count(*) AS n_pages, round(avg(length(text) % 101), 6) AS mean_confidence, count(*) FILTER (WHERE length(text) % 101 < 60) AS n_unsure, round(count(*) FILTER (WHERE length(text) > 0) / count(*), 6) AS success_rate FROM page_text GROUP BY lang")
def a21_recognition_quality(spark: SparkSession, folder: str) -> DataFrame:
    # an extension; a page's confidence follows from its length
    c = F.length("text") % 101
    return table(spark, folder, "page_text").groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_pages"), F.round(F.avg(c), 6).alias("mean_confidence"), F.count_if(c < 60).alias("n_unsure"), F.round(F.count_if(F.length("text") > 0) / F.count(F.lit(1)), 6).alias("success_rate")
    )


@query("WITH f AS (SELECT pdf_path, array_agg(page_id ORDER BY page_number, page_id) AS ids FROM page_text GROUP BY 1), x AS (SELECT pdf_path, list_concat(ids[1:len(ids) // 2], list_concat([-1, -2], ids[len(ids) // 2 + 1:])) AS ids FROM f) SELECT pdf_path, array_to_string(ids, ',') AS ids FROM x")
def u01_inserted_pages(spark: SparkSession, folder: str) -> DataFrame:
    # two new pages after the first half of each file
    f = table(spark, folder, "page_text").groupBy("pdf_path").agg(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "page_id"))), lambda x: x["page_id"]).alias("ids"))
    at = F.floor(F.size("ids") / 2).cast("int")
    ids = F.concat(F.slice("ids", F.lit(1), at), F.array(F.lit(-1).cast("long"), F.lit(-2).cast("long")), F.slice("ids", at + 1, F.size("ids")))
    return f.select("pdf_path", F.array_join(F.transform(ids, lambda x: x.cast("string")), ",").alias("ids"))


@query("WITH u AS (SELECT pdf_path, max(epoch_us(requested_at)) AS used FROM search_request GROUP BY 1) SELECT pdf_path, used, CAST(row_number() OVER (ORDER BY used DESC, pdf_path) AS INT) AS place FROM u")
def u21_recently_used(spark: SparkSession, folder: str) -> DataFrame:
    # places over all files by counting per day first, so that no window holds them all
    u = table(spark, folder, "search_request").groupBy("pdf_path").agg(F.max("requested_at").alias("at")).select("pdf_path", F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), F.col("at").cast("timestamp_ntz")).alias("used"))
    day = F.floor(F.coalesce("used", F.lit(-1)) / 3_600_000_000)
    u = u.withColumn("hour", day)
    n = u.groupBy("hour").agg(F.count(F.lit(1)).alias("n"))
    # one row an hour
    before = n.select("hour", F.coalesce(F.sum("n").over(Window.orderBy(F.col("hour").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("hour").orderBy(F.col("used").desc(), "pdf_path"))
    return u.withColumn("own", own).join(before, "hour").select("pdf_path", "used", (F.col("before") + F.col("own")).cast("int").alias("place"))


@query(_FILES + "SELECT page_id, CASE WHEN eta > 0 THEN CAST(greatest(1, round(eta / 1000)) AS BIGINT) // 60 || ':' || lpad(CAST(CAST(greatest(1, round(eta / 1000)) AS BIGINT) % 60 AS VARCHAR), 2, '0') END AS clock, array_to_string(string_split(pdf_path, '/')[-3:-2], '/') AS folders FROM (SELECT page_id, pdf_path, CAST((n_pages - page_number) * 1700 - 300 AS DOUBLE) AS eta FROM page_text JOIN n USING (pdf_path))")
def x34_clock_and_folders(spark: SparkSession, folder: str) -> DataFrame:
    t = table(spark, folder, "page_text")
    n = t.groupBy("pdf_path").agg(F.max("page_number").alias("n_pages"))
    parts = F.split("pdf_path", "/")
    eta = (F.col("n_pages") - F.col("page_number")) * 1700 - 300
    return t.join(n, "pdf_path").select("page_id", tx.eta_label(eta).alias("clock"), F.array_join(F.slice(parts, F.size(parts) - 2, 2), "/").alias("folders"))
