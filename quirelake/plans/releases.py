"""Release-asset and visit-record queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirelake.functions import releases as fx
from quirelake.plans.registry import query
from quirelake.runtime import table

_EXT = "CASE WHEN lower({0}) LIKE '%.tar.gz' THEN 'tar.gz' ELSE regexp_extract(lower({0}), '\\.([^.]*)$', 1) END"
_PLATFORM = (
    "CASE WHEN contains(lower({0}), 'darwin') OR contains(lower({0}), 'mac') OR {1} IN ('dmg', 'pkg') THEN 'macos' "
    "WHEN contains(lower({0}), 'win') OR {1} IN ('exe', 'msi') THEN 'windows' "
    "WHEN contains(lower({0}), 'linux') OR {1} IN ('appimage', 'deb', 'rpm', 'tar.gz') THEN 'linux' ELSE 'unknown' END"
)
_ARCH = (
    "CASE WHEN regexp_matches(lower({0}), '\\b(universal|all)\\b') THEN 'universal' WHEN regexp_matches(lower({0}), 'arm64|aarch64|armv8') THEN 'arm64' "
    "WHEN regexp_matches(lower({0}), 'x64|x86_64|amd64|win64') THEN 'x64' ELSE 'unknown' END"
)
_UA_P = "CASE WHEN regexp_matches(u, 'macintosh|mac os x|darwin') THEN 'macos' WHEN regexp_matches(u, 'windows|win32|win64') THEN 'windows' WHEN regexp_matches(u, 'linux|x11') THEN 'linux' ELSE 'unknown' END"
_UA_A = "CASE WHEN regexp_matches(u, 'arm64|aarch64|armv8|apple silicon') THEN 'arm64' WHEN regexp_matches(u, 'x86_64|x64|amd64|wow64|intel|win64') THEN 'x64' ELSE 'unknown' END"
_E = _EXT.format("name")


@query(f"SELECT id, {_E} AS ext, {_PLATFORM.format('name', _E)} AS os, {_ARCH.format('name')} AS cpu FROM release_asset")
def proj_p11_asset_names(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("name")
    return table(spark, folder, "release_asset").select("id", fx.extension(n).alias("ext"), fx.platform(n).alias("os"), fx.arch(n).alias("cpu"))


@query(f"WITH a AS (SELECT id, name, {_E} AS ext FROM release_asset) SELECT id FROM a WHERE ext IN ('appimage', 'deb', 'dmg', 'exe', 'msi', 'pkg', 'rpm', 'tar.gz', 'zip') AND NOT contains(lower(name), 'latest-mac')")
def f07_installers(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "release_asset").where(fx.is_installer(F.col("name"))).select("id")


@query(
    "SELECT id FROM release_asset WHERE NOT (platform = 'windows' AND extension = 'exe' AND arch = 'unknown' AND "
    "(SELECT count(DISTINCT arch) FROM release_asset WHERE platform = 'windows' AND extension = 'exe' AND arch IN ('x64', 'arm64')) = 2)"
)
def f08_specific_builds(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "release_asset")
    exe = (F.col("platform") == "windows") & (F.col("extension") == "exe")
    both = a.where(exe).agg((F.bool_or(F.col("arch") == "x64") & F.bool_or(F.col("arch") == "arm64")).alias("both"))
    # one row
    return a.crossJoin(F.broadcast(both)).where(~(exe & (F.col("arch") == "unknown") & F.coalesce("both", F.lit(False)))).select("id")


_LABEL = (
    "CASE platform WHEN 'macos' THEN 'macOS' WHEN 'windows' THEN 'Windows' WHEN 'linux' THEN 'Linux' ELSE 'Unknown OS' END || "
    "CASE arch WHEN 'arm64' THEN ' ARM64' WHEN 'x64' THEN ' x64' WHEN 'universal' THEN ' Universal' ELSE '' END || ' (' || "
    "CASE extension WHEN 'appimage' THEN 'AppImage' ELSE upper(extension) END || ')'"
)


@query(f"SELECT id, {_LABEL} AS label FROM release_asset")
def x22_installer_labels(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "release_asset")
    return a.select("id", fx.installer_label(F.col("platform"), F.col("arch"), F.col("extension")).alias("label"))


_RANK = (
    "CASE p.platform WHEN 'macos' THEN coalesce(list_position(['dmg','pkg','zip'], a.extension), 8) WHEN 'windows' THEN coalesce(list_position(['exe','msi'], a.extension), 7) "
    "WHEN 'linux' THEN coalesce(list_position(['deb','appimage','rpm','tar.gz','zip'], a.extension), 10) ELSE coalesce(list_position(['dmg','exe','deb','appimage','zip'], a.extension), 10) END"
)
_ARANK = (
    "CASE WHEN p.arch = 'unknown' THEN CASE a.arch WHEN 'universal' THEN 0 WHEN 'unknown' THEN 1 ELSE 2 END "
    "ELSE CASE WHEN a.arch = p.arch THEN 0 WHEN a.arch = 'universal' THEN 1 WHEN a.arch = 'unknown' THEN 2 ELSE 3 END END"
)


@query(
    f"""
WITH p AS (SELECT DISTINCT {_UA_P} AS platform, {_UA_A} AS arch FROM (SELECT lower(coalesce(user_agent, '')) AS u FROM landing_page_view)),
c AS (SELECT p.platform, p.arch, a.*, {_RANK} AS r, {_ARANK} AS ar FROM p, release_asset a WHERE a.platform = p.platform OR p.platform = 'unknown'
      OR NOT EXISTS (SELECT 1 FROM release_asset b WHERE b.platform = p.platform))
SELECT platform, arch, name FROM (SELECT platform, arch, name, row_number() OVER (PARTITION BY platform, arch ORDER BY r, ar, platform_1 = 'unknown', name) AS k FROM
(SELECT p.platform, p.arch, a.name, a.platform AS platform_1, {_RANK} AS r, {_ARANK} AS ar FROM p, release_asset a WHERE a.platform = p.platform OR p.platform = 'unknown')) WHERE k = 1
"""
)
def o06_recommended(spark: SparkSession, folder: str) -> DataFrame:
    agent = F.col("user_agent")
    profiles = table(spark, folder, "landing_page_view").select(fx.agent_platform(agent).alias("platform"), fx.agent_arch(agent).alias("arch")).distinct()
    assets = table(spark, folder, "release_asset").select("name", "extension", F.col("platform").alias("os"), F.col("arch").alias("cpu"))
    # at most twelve profiles meet a fixed table of assets
    met = profiles.join(F.broadcast(assets), (F.col("os") == F.col("platform")) | (F.col("platform") == "unknown"))
    order = F.struct(
        fx.format_rank(F.col("platform"), F.col("extension")).alias("r"), fx.arch_rank(F.col("cpu"), F.col("arch")).alias("a"), (F.col("os") == "unknown").alias("u"), "name"
    )
    return met.groupBy("platform", "arch").agg(F.min(order).alias("b")).select("platform", "arch", F.col("b.name").alias("name"))


@query(
    """
SELECT platform, CASE arch WHEN 'unknown' THEN 'x64' ELSE arch END AS cpu, min(name) AS name FROM release_asset
WHERE (platform, CASE arch WHEN 'unknown' THEN 'x64' ELSE arch END, id) IN (SELECT (platform, CASE arch WHEN 'unknown' THEN 'x64' ELSE arch END, min(id)) FROM release_asset GROUP BY 1, 2, platform, arch = 'unknown')
GROUP BY 1, 2
""".replace("(SELECT (platform, CASE arch WHEN 'unknown' THEN 'x64' ELSE arch END, min(id)) FROM release_asset GROUP BY 1, 2, platform, arch = 'unknown')", "(SELECT platform, c, min(id) FROM (SELECT platform, CASE arch WHEN 'unknown' THEN 'x64' ELSE arch END AS c, id FROM release_asset) GROUP BY platform, c)")
)
def a09_first_per_arch(spark: SparkSession, folder: str) -> DataFrame:
    cpu = F.when(F.col("arch") == "unknown", "x64").otherwise(F.col("arch"))
    a = table(spark, folder, "release_asset").select("platform", cpu.alias("cpu"), "id", "name")
    return a.groupBy("platform", "cpu").agg(F.min_by("name", "id").alias("name"))


@query("SELECT id, CAST(row_number() OVER (ORDER BY platform, arch, extension, name, id) AS INT) AS place FROM release_asset")
def o07_installer_order(spark: SparkSession, folder: str) -> DataFrame:
    # a fixed table of a hundred rows
    w = Window.orderBy("platform", "arch", "extension", "name", "id")
    return table(spark, folder, "release_asset").select("id", F.row_number().over(w).alias("place"))


@query(f"SELECT platform, arch, count(*) AS n FROM (SELECT {_UA_P} AS platform, {_UA_A} AS arch FROM (SELECT lower(coalesce(user_agent, '')) AS u FROM landing_page_view)) GROUP BY 1, 2")
def proj_p12_agents(spark: SparkSession, folder: str) -> DataFrame:
    a = F.col("user_agent")
    v = table(spark, folder, "landing_page_view").select(fx.agent_platform(a).alias("platform"), fx.agent_arch(a).alias("arch"))
    return v.groupBy("platform", "arch").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT id, path[1:500] AS path, referrer[1:2000] AS referrer, country[1:2] AS country, city[1:100] AS city, user_agent[1:500] AS user_agent FROM landing_page_view")
def proj_p13_truncated_views(spark: SparkSession, folder: str) -> DataFrame:
    cut = lambda c, n: F.substring(c, 1, n).alias(c)
    return table(spark, folder, "landing_page_view").select("id", cut("path", 500), cut("referrer", 2000), cut("country", 2), cut("city", 100), cut("user_agent", 500))


@query("SELECT id, CASE WHEN coalesce(path, '') = '' THEN 'path' WHEN coalesce(visitor_hash, '') = '' THEN 'visitor' WHEN user_agent IS NULL THEN 'agent' END AS missing FROM landing_page_view WHERE coalesce(path, '') = '' OR coalesce(visitor_hash, '') = '' OR user_agent IS NULL")
def f10_rejected_views(spark: SparkSession, folder: str) -> DataFrame:
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    missing = F.when(blank("path"), "path").when(blank("visitor_hash"), "visitor").when(F.col("user_agent").isNull(), "agent")
    return table(spark, folder, "landing_page_view").select("id", missing.alias("missing")).where("missing IS NOT NULL")


@query("SELECT id, sha256(coalesce(city, '') || ':' || coalesce(user_agent, '') || ':' || strftime(created_at, '%Y-%m-%d')) AS visitor FROM landing_page_view")
def x19_visitor_hash(spark: SparkSession, folder: str) -> DataFrame:
    part = lambda c: F.coalesce(F.col(c), F.lit(""))
    text = F.concat_ws(":", part("city"), part("user_agent"), F.date_format("created_at", "yyyy-MM-dd"))
    return table(spark, folder, "landing_page_view").select("id", F.sha2(text, 256).alias("visitor"))


@query("SELECT strftime(created_at, '%Y-%m-%d') AS view_day, count(DISTINCT nullif(visitor_hash, '')) AS visitors, count(DISTINCT id) AS views FROM landing_page_view GROUP BY 1")
def a22_daily_visitors(spark: SparkSession, folder: str) -> DataFrame:
    v = table(spark, folder, "landing_page_view").select(F.date_format("created_at", "yyyy-MM-dd").alias("view_day"), F.nullif("visitor_hash", F.lit("")).alias("who"), "id")
    # two aggregations by themselves: a joint one would expand every row
    who = v.groupBy("view_day", "who").agg(F.lit(1).alias("x")).groupBy("view_day").agg(F.count("who").alias("visitors"))
    ids = v.groupBy("view_day", "id").agg(F.lit(1).alias("x")).groupBy("view_day").agg(F.count("id").alias("views"))
    return who.join(ids, "view_day")


@query("SELECT country, platform, CAST(count(DISTINCT id) AS BIGINT) AS downloads FROM landing_download GROUP BY ROLLUP(country, platform)")
def a23_download_rollup(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "landing_download").select("id", "country", "platform").distinct()
    return d.rollup("country", "platform").agg(F.count_distinct("id").alias("downloads"))


@query("SELECT d.id, coalesce(a.size, 0) AS size FROM (SELECT DISTINCT id, file_name FROM landing_download) d LEFT JOIN release_asset a ON a.name = d.file_name")
def ext_download_sizes(spark: SparkSession, folder: str) -> DataFrame:
    # a fixed dimension of a hundred assets
    assets = F.broadcast(table(spark, folder, "release_asset").select(F.col("name").alias("file_name"), "size"))
    d = table(spark, folder, "landing_download").select("id", "file_name").distinct()
    return d.join(assets, "file_name", "left").select("id", F.coalesce("size", F.lit(0)).alias("size"))


@query("SELECT d.id, v.id AS view_id FROM (SELECT DISTINCT id, visitor_hash, created_at FROM landing_download WHERE visitor_hash <> '') d ASOF JOIN (SELECT visitor_hash, created_at, max(id) AS id FROM landing_page_view WHERE visitor_hash <> '' GROUP BY 1, 2) v ON d.visitor_hash = v.visitor_hash AND d.created_at >= v.created_at")
def j03_view_before_download(spark: SparkSession, folder: str) -> DataFrame:
    from quirelake.operators.asof import asof_latest

    d = table(spark, folder, "landing_download").where("visitor_hash <> ''").select("id", "visitor_hash", "created_at").distinct()
    v = table(spark, folder, "landing_page_view").where("visitor_hash <> ''").groupBy("visitor_hash", "created_at").agg(F.max("id").alias("view_id"))
    return asof_latest(d, v, ["visitor_hash"], "created_at", "view_id").where("view_id IS NOT NULL").select("id", "view_id")


@query("SELECT DISTINCT ON (visitor_hash) visitor_hash, path, created_at FROM landing_page_view WHERE visitor_hash <> '' ORDER BY visitor_hash, created_at DESC, id DESC")
def t04_latest_view(spark: SparkSession, folder: str) -> DataFrame:
    v = table(spark, folder, "landing_page_view").where("visitor_hash <> ''")
    last = v.groupBy("visitor_hash").agg(F.max(F.struct("created_at", "id", "path")).alias("l"))
    return last.select("visitor_hash", F.col("l.path").alias("path"), F.col("l.created_at").alias("created_at"))
