"""The registered queries of the catalog engine, each with its DuckDB twin."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import boxes, catalog, markup, pixels, ranges, rules, running, scoring
from ..sources import archives
from ..sources.config import action_lists, read_config
from ..streaming.ingest import ingest
from . import pipeline
from .views import scratch, table, view, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
c = F.col


def query(sql: str | None = None, views: str = "") -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = with_views(views, sql) if views else sql
        return f

    return add


# Pages and chapters of the views -------------------------------------------------------------------------------------

IMAGES = "regexp_matches(name, '\\.(jpg|jpeg|png|gif|bmp|tiff|tif|webp|avif|heic|heif|jxl|jp2)$')"
CHAPTERS = "ch as (select *, lead(start) over (partition by book order by start) - 1 as e from v2)"
#: Pages with the chapter they fall into, the last one whose start they reach.
ASSIGNED = "asg as (select p.*, x.ord, x.number, x.start as chapter_start from v1 p asof left join v2 x on p.book = x.book and p.page >= x.start)"
#: Base number and part of a chapter.
BASED = """bs as (select book, ord, number, start, cast(floor(number) as int) as base,
  case when number <> floor(number) then cast(split_part(cast(number as varchar), '.', 2) as int) end as part from v2)"""


@query(f"select book, name, row_number() over (partition by book order by name) - 1 as index, count(*) over (partition by book) as total_count from v1 where {IMAGES}", "v1")
def scan_catalog(spark, sf):
    return catalog.number_pages(view(spark, sf, "v1")).select("book", "name", "index", "total_count")


@query("""select distinct case when contains(path, '/') then split_part(path, '/', 1) else path end as book, case when contains(path, '/') then 'folder' else 'cbz' end as container
  from (select case when book % 3 = 0 then concat('Book ', book, '.cbz') else concat('Book ', book, '/', name) end as path from v1)""", "v1")
def scan_books(spark, sf):
    p = view(spark, sf, "v1").select(F.when(c("book") % 3 == 0, F.concat(F.lit("Book "), c("book").cast("string"), F.lit(".cbz"))).otherwise(F.concat(F.lit("Book "), c("book").cast("string"), F.lit("/"), c("name"))).alias("path"))
    return catalog.books(p)


@query("select book, name, page from v1 where not (page % 2 = 0)", "v1")
def skip_existing(spark, sf):
    p = view(spark, sf, "v1")
    return catalog.skip_existing(p.select("book", "name", "page"), p.filter(c("page") % 2 == 0))


@query("select archive, count(*) as n_pages, min(name) as first_name, max(name) as last_name from (select concat('Series ', book, ' v', lpad(cast(book % 100 as varchar), 2, '0'), '.cbz') as archive, name from v1) group by archive", "v1")
def sink_pack(spark, sf):
    """What each archive holds, read back from the archives that the sink writes."""
    p = view(spark, sf, "v1").select(c("name").cast("binary").alias("content"), "name", F.concat(F.lit("Series "), c("book").cast("string"), F.lit(" v"), F.format_string("%02d", c("book") % 100), F.lit(".cbz")).alias("archive"))
    path = scratch(spark, "packs")
    archives.write_archives(p, path, "packed")
    packs = archives.read_archives(spark, path, images=False, content=False)
    return packs.groupBy(F.substring_index("archive", "/", -1).alias("archive")).agg(F.count("*").alias("n_pages"), F.min("name").alias("first_name"), F.max("name").alias("last_name"))


@query("select image, count(*) as n, min(v) as lo, max(v) as hi, round(avg(v), 6) as mean from v3 group by image", "v3")
def sink_manifest(spark, sf):
    """The rows of the manifest, read back from what the sink writes."""
    rows = view(spark, sf, "v3").groupBy("image").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.round(F.avg("v"), 6).alias("mean"))
    path = scratch(spark, "manifest")
    archives.write_manifest(rows, path)
    return spark.read.schema(rows.schema).json(path)


@query(f"select concat('Series ', book, '.cbz') as archive, 'CBZ' as container, name, row_number() over (partition by book order by name) - 1 as index, count(*) over (partition by book) as total_count, length(name) as length from v1 where {IMAGES}", "v1")
def scan_archives(spark, sf):
    """Members of the archives that the packing sink makes of all pages, read by ranges."""
    p = view(spark, sf, "v1").select(F.concat(F.lit("Series "), c("book").cast("string"), F.lit(".cbz")).alias("archive"), "name", c("name").cast("binary").alias("content"))
    path = scratch(spark, "scanned")
    archives.write_archives(p, path)
    found = archives.read_archives(spark, path, split=16 << 10)
    return found.filter(F.length("content") == c("length")).select(F.substring_index("archive", "/", -1).alias("archive"), "container", "name", "index", "total_count", "length")


def _heads() -> F.Column:
    """Heads of a PNG, JPEG, GIF or WebP of the page's size, by turns; text where the page is a text file."""
    big = lambda x, n: F.lpad(F.hex(x), n, F.lit("0"))
    little = lambda x, n: F.concat(*(F.substring(big(x, n), k, 2) for k in range(n - 1, 0, -2)))
    w, h, colour = c("width"), c("height"), c("width") == c("height")
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), big(w, 8), big(h, 8), F.lit("08"), F.when(colour, "02").otherwise("00"), F.lit("00000000000000"))
    # an application's segment and a table before the frame header
    jpeg = F.concat(F.lit("FFD8FFE000060102FFC0FFDB000300FFC2000B08"), big(h, 4), big(w, 4), F.when(colour, "03").otherwise("01"), F.lit("012200"))
    gif = F.concat(F.lit(b"GIF89a".hex()), little(w, 4), little(h, 4), F.lit("800000"))
    webp = F.concat(F.lit((b"RIFF" + bytes(4) + b"WEBPVP8X" + bytes((10, 0, 0, 0, 0, 0, 0, 0))).hex()), little(w - 1, 6), little(h - 1, 6))
    kind = c("page") % 4
    return F.when(c("name").endswith(".txt"), c("name").cast("binary")).otherwise(F.unhex(F.when(kind == 0, png).when(kind == 1, jpeg).when(kind == 2, gif).otherwise(webp)))


def _scanned(spark, sf):
    """Sizes read from the headers of images in archives that are packed from all pages."""
    p = view(spark, sf, "v1").select(c("book").cast("string").alias("archive"), F.concat(c("page").cast("string"), F.lit(".png")).alias("name"), _heads().alias("content"))
    path = scratch(spark, "archives")
    archives.write_archives(p, path)
    members = archives.read_archives(spark, path)
    where = (F.substring_index("archive", "/", -1).cast("long").alias("book"), F.regexp_extract("name", r"^(\d+)", 1).cast("int").alias("page"))
    return members.select(*where, archives.image_meta(c("content")).alias("m")).select("book", "page", "m.*")


@query("""select book, page, case page % 4 when 0 then 'PNG' when 1 then 'JPEG' when 2 then 'GIF' else 'WEBP' end as format, width, height, case when page % 4 >= 2 or width = height then 3 else 1 end as nChannels
  from v1 where not ends_with(name, '.txt')""", "v1")
def scan_image_meta(spark, sf):
    return _scanned(spark, sf).filter("height > 0")


@query("select book, page from v1 where ends_with(name, '.txt')", "v1")
def scan_broken(spark, sf):
    return archives.broken_images(_scanned(spark, sf)).select("book", "page")


@query("select concat('v', book) as book, ord, number, start from v2", "v1 v2")
def scan_config(spark, sf):
    """Chapters of configurations that are written from the chapter view, a JSON object a line."""
    chapters = F.transform(F.sort_array(F.collect_list(F.struct("ord", "number", "start"))), lambda x: F.struct(x.number.alias("number"), x.start.alias("start")))
    volume = view(spark, sf, "v2").groupBy("book").agg(chapters.alias("chapters"))
    config = volume.select(F.lit("Series").alias("title"), F.array(F.struct(F.concat(F.lit("v"), c("book").cast("string")).alias("path"), "chapters")).alias("volumes"))
    path = scratch(spark, "config")
    config.write.json(path)
    return read_config(spark, path, multi_line=False)["chapters"].select("book", "ord", "number", "start")


@query("select page_id, pos, href as name from v4", "v4")
def fix_text_names(spark, sf):
    """Names garbled by the wrong code page come back as they were."""
    high = bytes(range(128, 256))
    garbled = F.translate(F.decode(F.encode("href", "utf-8"), "iso-8859-1"), high.decode("latin-1"), high.decode("cp437"))
    return view(spark, sf, "v4").select("page_id", "pos", N.fix_text_name(garbled).alias("name"))


@query("select event_id, event_type, length(event_type) as n from events")
def stream_ingest(spark, sf):
    """All events, taken in by a stream that runs twice; the second run finds nothing new."""
    at = scratch(spark, "ingest")
    schema = table(spark, sf, "events").schema
    for _ in range(2):
        ingest(spark, f"{sf}/event[s].parquet", schema, f"{at}/done", f"{at}/seen", lambda df: df.select("event_id", "event_type", F.length("event_type").alias("n")), ("event_id",)).awaitTermination()
    return spark.read.parquet(f"{at}/done")


# Rules ----------------------------------------------------------------------------------------------------------------

_TREE = {"op": "and", "rules": [
    {"op": "or", "rules": [{"op": "condition", "field": "event_type", "operator": "in", "value": ["click", "view"]}, {"op": "condition", "field": "k2", "operator": ">=", "value": 5}]},
    {"op": "not", "rule": {"op": "condition", "field": "k2", "operator": "!=", "value": 3}},
]}
_FACTS = "f as (select *, nullif(k, 0) as k2 from v5)"


def _facts(spark, sf):
    return view(spark, sf, "v5").withColumn("k2", F.nullif("k", F.lit(0)))


@query(f", {_FACTS} select event_id, event_type, k2 from f where (event_type in ('click', 'view') or coalesce(k2 >= 5, false)) and not coalesce(k2 <> 3, false)", "v5")
def rule_filter(spark, sf):
    return rules.rule_filter(_facts(spark, sf), _TREE).select("event_id", "event_type", "k2")


@query(f""", {_FACTS} select event_id, coalesce(k2 = 4, false) as r_eq, coalesce(k2 = 4, false) as r_is, coalesce(k2 <> 4, false) as r_ne, coalesce(k2 <> 4, false) as r_not_is,
  coalesce(k2 > 4, false) as r_gt, coalesce(k2 < 4, false) as r_lt, coalesce(k2 >= 4, false) as r_ge, coalesce(k2 <= 4, false) as r_le,
  coalesce(k2 in (1, 2), false) as r_in, coalesce(k2 not in (1, 2), false) as r_not_in, contains('click view', event_type) as r_text from f""", "v5")
def rule_ops(spark, sf):
    k = c("k2")
    ops = {"r_eq": "==", "r_is": "IS", "r_ne": "!=", "r_not_is": "not is", "r_gt": ">", "r_lt": "<", "r_ge": ">=", "r_le": "<="}
    return _facts(spark, sf).select("event_id", *(rules.condition(k, o, 4).alias(n) for n, o in ops.items()), rules.condition(k, "in", [1, 2]).alias("r_in"), rules.condition(k, "not in", [1, 2]).alias("r_not_in"), rules.condition(c("event_type"), "in", "click view").alias("r_text"))


@query(f", {_FACTS} select event_id, coalesce(user_id % 7 = k2, false) as eq, k2 is null or user_id % 7 <> k2 as ne, coalesce(user_id % 7 > k2, false) as gt from (select *, user_id % 7 as u from f)", "v5")
def rule_ctx_ref(spark, sf):
    f = _facts(spark, sf).withColumn("u", c("user_id") % 7)
    test = lambda op: rules.rule({"op": "condition", "field": "u", "operator": op, "value": "ctx:k2"}, f.columns)
    return f.select("event_id", test("==").alias("eq"), test("!=").alias("ne"), test(">").alias("gt"))


# Predicates and lookups -----------------------------------------------------------------------------------------------


@query("select page_id, mx1 - mx0 as media_width, cx1 - cx0 as box_width from v6b where mx1 - mx0 > (cx1 - cx0) * 2", "v6b")
def filter_wide_box(spark, sf):
    b = view(spark, sf, "v6b")
    return b.filter(boxes.is_wide(c("mx0"), c("mx1"), c("cx0"), c("cx1"))).select("page_id", (c("mx1") - c("mx0")).alias("media_width"), (c("cx1") - c("cx0")).alias("box_width"))


@query("select image, vec_id, bool_and(r = g and r = b) as palette_gray from v3c group by image, vec_id", "v3c")
def filter_palette_gray(spark, sf):
    p = view(spark, sf, "v3c").groupBy("image", "vec_id").agg(F.collect_list(F.struct("r", "g", "b")).alias("palette"))
    return p.select("image", "vec_id", F.forall("palette", lambda x: (x.r == x.g) & (x.r == x.b)).alias("palette_gray"))


@query("select image, count(*) as n_bands from (select distinct image, pos % 3 as band from v3) group by image having count(*) <> 1", "v3")
def filter_nongray(spark, sf):
    bands = view(spark, sf, "v3").select("image", (c("pos") % 3).alias("band")).distinct()
    return bands.groupBy("image").agg(F.count("*").alias("n_bands")).filter("n_bands <> 1")


@query("select book, page, name from v1 where page between 0 and 4 or page between 9 and 9 or page % 2 = 1", "v1")
def page_select(spark, sf):
    return catalog.select_pages(view(spark, sf, "v1"), "1-5,10,even").select("book", "page", "name")


@query("select book, page, coalesce(case when page % 11 = 0 then true end, case when page % 13 = 0 then true end, width = height) as is_color from v1", "v1")
def color_page_flag(spark, sf):
    p = view(spark, sf, "v1")
    return catalog.color_flag(p, p.filter("page % 11 = 0"), p.filter("page % 13 = 0"), c("width") == c("height")).select("book", "page", "is_color")


@query("select book, page, 'level-1' as step, case when page % 10 = 0 then 'copy' when page % 10 = 5 then 'ignore' end as action from v1", "v1")
def skip_lookup(spark, sf):
    p = view(spark, sf, "v1").select("book", "page", F.lit("level-1").alias("step"))
    skips = p.filter("page % 5 = 0").withColumn("action", F.when(c("page") % 10 == 0, "copy").otherwise("ignore"))
    return catalog.skip_action(p, skips)


# Joins ----------------------------------------------------------------------------------------------------------------


def _assigned(spark, sf):
    return ranges.assign_chapters(view(spark, sf, "v1"), view(spark, sf, "v2"))


@query(f", {ASSIGNED} select book, page, name, ord, number from asg where ord is not null", "v1 v2")
def join_page_chapter(spark, sf):
    return _assigned(spark, sf).filter("ord is not null").select("book", "page", "name", "ord", "number")


_SPREADS = "sp as (select book, page as start, page + 1 as e, page // 10 as ord from v1 where page % 10 in (2, 3))"


@query(f""", {_SPREADS}, hit as (select p.book, p.page, min(s.ord) as ord from v1 p join sp s on p.book = s.book and p.page between s.start and s.e where not contains(p.name, '-0') group by p.book, p.page),
  n as (select *, count(*) over (partition by book, ord) as k from hit) select book, page, ord from n where k >= 2""", "v1")
def join_page_spread(spark, sf):
    p = view(spark, sf, "v1")
    sp = p.filter("page % 10 in (2, 3)").select("book", c("page").alias("start"), (c("page") + 1).alias("end"), F.floor(c("page") / 10).alias("ord"))
    return ranges.spread_pages(p.select("book", "page", "name"), sp, c("name").contains("-0")).select("book", "page", "ord")


@query(""", s as (select book, page + k as page, concat(page, '-', page + 1, '-', page + 2) as spread from v1 cross join (values (0), (1), (2)) as t(k) where page % 6 = 4)
  select p.book, p.page, spread from v1 p join s on p.book = s.book and p.page = s.page""", "v1")
def join_spread_list(spark, sf):
    p = view(spark, sf, "v1")
    text = lambda k: (c("page") + k).cast("string")
    lists = p.filter("page % 6 = 4").select("book", F.concat_ws("-", text(0), text(1), text(2)).alias("spread"))
    return ranges.spread_members(p.select("book", "page"), lists).select("book", "page", "spread")


@query("select p.book, p.page, case when p.page = 0 then 'Cover' when p.page = 3 then 'ToC' end as tag from v1 p", "v1")
def join_meta_tag(spark, sf):
    p = view(spark, sf, "v1").select("book", "page")
    meta = p.filter("page in (0, 3)").select("book", "page", F.when(c("page") == 0, "Cover").otherwise("ToC").alias("tag"))
    return p.join(meta, ["book", "page"], "left")


_PUB = "case book % 4 when 0 then 'digital' when 1 then 'scan' when 2 then 'web' else 'none' end"
_PUBS = "pt(key, image, archive) as (values ('digital', 'dig', 'Digital'), ('magazine', 'mag', 'c2c'), ('scan', 'c2c', 'c2c'), ('web', 'web', 'Digital'), ('digital-raw', 'raw-d', 'Digital'), ('magazine-raw', 'raw-m', 'c2c'), ('mix', 'mix', 'Digital'), ('none', '', 'Digital'))"


def _publications(spark):
    return F.broadcast(spark.createDataFrame([x[:3] for x in N.PUBLICATIONS], "key string, image string, archive string"))


def _with_publication(spark, df):
    return df.withColumn("key", F.expr(_PUB)).join(_publications(spark), "key")


@query(f", {_PUBS} select book, key, image, archive from (select distinct book, {_PUB} as key from v1) join pt using (key)", "v1")
def join_pub_type(spark, sf):
    return _with_publication(spark, view(spark, sf, "v1").select("book").distinct()).select("book", "key", "image", "archive")


@query(""", a as (select folder, row_number() over (partition by folder order by stem_a) as place, stem_a as stem, size_a from v6a), b as (select folder, row_number() over (partition by folder order by stem_b) as place, stem_b, size_b from v6a)
  select folder, stem, size_a, size_b, case when size_a <= size_b then 'A' else 'B' end as pick from a join b using (folder, place) where stem = stem_b""", "v6a")
def join_mixmatch(spark, sf):
    """Folders of 97 pairs; where a stem differs, what follows it by name no longer agrees by place."""
    p = view(spark, sf, "v6a")
    return ranges.mix_and_match(p.select("folder", c("stem_a").alias("stem"), c("size_a").alias("size")), p.select("folder", c("stem_b").alias("stem"), c("size_b").alias("size"))).select("folder", "stem", "size_a", "size_b", "pick")


@query(""", m as (select page_id as doc, concat('i', pos % 5) as id, max_by(href, pos) as href from v4 where pos <> 2 group by all), s as (select page_id as doc, pos, concat('i', pos % 6) as id from v4)
  select s.doc, s.pos, s.id, m.href from s left join m on s.doc = m.doc and s.id = m.id""", "v4")
def join_spine_manifest(spark, sf):
    v = view(spark, sf, "v4")
    m = v.filter("pos <> 2").select(c("page_id").alias("doc"), F.concat(F.lit("i"), (c("pos") % 5).cast("string")).alias("id"), "href", "pos")
    s = v.select(c("page_id").alias("doc"), "pos", F.concat(F.lit("i"), (c("pos") % 6).cast("string")).alias("id"))
    found, missing = markup.spine_order(m, s)
    return found.select("doc", "pos", "id", "href").unionByName(missing.select("doc", "pos", "id"), allowMissingColumns=True)


@query("select folder, concat(stem_a, '.png') as old, concat(upper(stem_b), '.jpg') as new from v6a a where lower(stem_a) = lower(stem_b)", "v6a")
def join_replacements(spark, sf):
    """Stems recur in every folder; they meet in their own."""
    p = view(spark, sf, "v6a")
    old = p.select("folder", F.concat("stem_a", F.lit(".png")).alias("file"), c("stem_a").alias("stem"))
    new = p.select("folder", F.concat(F.upper("stem_b"), F.lit(".jpg")).alias("file"), F.upper("stem_b").alias("stem"))
    return markup.match_replacements(old, new, ("folder",))[0]


@query("select distinct book, concat('level-', page % 4) as step from v1 where page % 4 not in (1, 2)", "v1")
def join_validate_steps(spark, sf):
    steps = ranges.step_names(spark.createDataFrame([(0, "level"), (1, "rename"), (2, "level")], "pos int, kind string")).select("step")
    skips = view(spark, sf, "v1").select("book", F.concat(F.lit("level-"), (c("page") % 4).cast("string")).alias("step")).distinct()
    return skips.join(F.broadcast(steps), "step", "left_anti").select("book", "step")


_LUT = "case when v < 20 then 0 when v > 230 then 255 else cast(round_even(pow((v - 20) / 210.0, 1 / 0.9) * 255, 0) as int) end"


@query(f"select image, vec_id, pos, v, {_LUT} as out from v3", "v3")
def join_lut_apply(spark, sf):
    lut = pixels.level_lut(spark.range(1).select(F.lit(20).alias("black"), F.lit(230).alias("white"), F.lit(0.9).alias("gamma"))).select("v", "out")
    return view(spark, sf, "v3").join(F.broadcast(lut), "v").select("image", "vec_id", "pos", "v", "out")


# Aggregations ---------------------------------------------------------------------------------------------------------


@query("select book, concat(width, 'x', height) as size, count(*) as n, min(name) as first_name, max(name) as last_name from v1 group by all", "v1")
def agg_imagesize(spark, sf):
    return catalog.image_sizes(view(spark, sf, "v1")).select("book", "size", "n", c("names").getItem(0).alias("first_name"), F.element_at("names", -1).alias("last_name"))


_STATUS = "case when page % 9 = 0 then 'IGNORED' when height = 1200 then 'COPIED' when width = height then 'GRAYSCALED' else 'PROCESSED' end"


@query(f"select {_STATUS} as status, count(*) as n from v1 group by all", "v1")
def agg_status(spark, sf):
    return catalog.status_counts(view(spark, sf, "v1").withColumn("status", F.expr(_STATUS)))


@query("select q as quality, count(*) as n, case when q < 0 or q > 95 then -1 when q >= 92 then 0 when q >= 81 then 1 when q >= 69 then 2 else 3 end as level from (select page % 103 - 1 as q from v1) group by all", "v1")
def agg_quality(spark, sf):
    return catalog.quality_histogram(view(spark, sf, "v1").select((c("page") % 103 - 1).alias("quality")))


_HIST = "hist as (select i.image, b.v, coalesce(n, 0) as n from (select distinct image from v3) i cross join (select unnest(range(256)) as v) b left join (select image, v, count(*) as n from v3 group by all) k on i.image = k.image and b.v = k.v)"


@query(f", {_HIST} select * from hist", "v3")
def agg_histogram(spark, sf):
    return pixels.histogram(view(spark, sf, "v3"))


_SHADES = """w as (select image, min(v) as lo, max(v) as hi, count(*) as total from v3 group by image),
  b as (select image, total, case when lo = hi then 128 else cast(least(255, floor((v - lo) / (hi - lo) * 256)) as int) end as shade from v3 join w using (image)),
  sh as (select image, shade, count(*) as n, count(*) / total * 100 as pct from b group by image, shade, total having count(*) > ceil(total * 0.01))"""


def _shades(spark, sf):
    return pixels.shades(view(spark, sf, "v3"), 1.0)


@query(f", {_SHADES} select image, shade, n, round(pct, 9) as pct from sh", "v3")
def agg_shades(spark, sf):
    return _shades(spark, sf).withColumn("pct", F.round("pct", 9))


@query("select image, bool_and(r = g and r = b) as is_gray from v3c group by image", "v3c")
def agg_is_gray(spark, sf):
    return pixels.is_gray(view(spark, sf, "v3c"))


_KEYS = "ky as (select image, 4 * (r - g) * (r - g) + (r + g - 2 * b) * (r + g - 2 * b) as d2, row_number() over (partition by image order by 4 * (r - g) * (r - g) + (r + g - 2 * b) * (r + g - 2 * b) desc) as place from v3c)"
_REST = f"{_KEYS}, rs as (select image, d2, least(sqrt(d2 / 4.0), 285.0) / 285.0 as d from ky where place > 17)"
_FEATURES = """select image, count(*) as n, round(avg(d), 6) as mean, round(stddev_pop(d), 6) as std, round(case when var_pop(d) > 0 then (avg(d * d * d) - 3 * avg(d) * avg(d * d) + 2 * pow(avg(d), 3)) / pow(var_pop(d), 1.5) else 0 end, 6) as skew,
  round(case when var_pop(d) > 0 then kurtosis_pop(d) else 0 end, 6) as kurt, round(sqrt(sum(d * d)), 6) as l2, round(quantile_cont(d, 0.25), 6) as q25, round(quantile_cont(d, 0.5), 6) as q50, round(quantile_cont(d, 0.75), 6) as q75, round(max(d), 6) as q100 from rs group by image"""


def _keys(spark, sf):
    return pixels.colour_keys(view(spark, sf, "v3c"))


@query(f", {_REST} {_FEATURES}", "v3c")
def agg_color_features(spark, sf):
    """From the pixels themselves."""
    px = view(spark, sf, "v3c").withColumn("d2", 4 * F.pow(c("r") - c("g"), F.lit(2)) + F.pow(c("r") + c("g") - 2 * c("b"), F.lit(2)))
    rest = px.withColumn("place", F.row_number().over(Window.partitionBy("image").orderBy(F.desc("d2")))).filter("place > 17").withColumn("d", pixels.colourfulness(c("d2")))
    r = lambda x: F.round(F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0)), 6)
    at = lambda q: F.round(F.percentile("d", F.lit(q)), 6)
    return rest.groupBy("image").agg(F.count("*").alias("n"), r(F.avg("d")).alias("mean"), r(F.stddev_pop("d")).alias("std"), r(F.skewness("d")).alias("skew"), r(F.kurtosis("d")).alias("kurt"), r(F.sqrt(F.sum(c("d") * c("d")))).alias("l2"), at(0.25).alias("q25"), at(0.5).alias("q50"), at(0.75).alias("q75"), r(F.max("d")).alias("q100"))


@query(f", {_REST} {_FEATURES}", "v3c")
def agg_color_features_hist(spark, sf):
    """From key counts: the scalable form."""
    f = pixels.colour_features(_keys(spark, sf))
    return f.select("image", "n", *(F.round(x, 6).alias(x) for x in ("mean", "std", "skew", "kurt", "l2", "q25", "q50", "q75", "q100")))


@query(f", {_KEYS}, h as (select image, count(*) filter (where least(sqrt(d2 / 4.0), 285.0) / 285.0 >= 0.1) as hits from ky group by image) select image, hits, least(hits, 2) / 2 as t2, least(hits, 16) / 16 as t16, least(hits, 128) / 128 as t128, least(hits, 1024) / 1024 as t1024 from h", "v3c")
def agg_threshold_counts(spark, sf):
    return pixels.threshold_shares(_keys(spark, sf), 0.1)


@query("select book, count(distinct vol) as n_volumes, min(vol) as first_volume, max(vol) as last_volume, count(distinct vol) > 1 as omnibus from (select book, book % 100 + page // 200 as vol from v1) group by book", "v1")
def agg_omnibus(spark, sf):
    v = view(spark, sf, "v1").withColumn("vol", c("book") % 100 + F.floor(c("page") / 200))
    return v.groupBy("book").agg(F.countDistinct("vol").alias("n_volumes"), F.min("vol").alias("first_volume"), F.max("vol").alias("last_volume"), (F.countDistinct("vol") > 1).alias("omnibus"))


_JOINED = "select book, page // 4 as spread, cast(sum(width) as bigint) as width, max(height) as height, case when bool_and(height = 1200) then 'L' else 'RGB' end as mode, {ext} as ext, count(*) as n from (select *, regexp_extract(name, '\\.([^.]+)$', 1) as x from v1) group by all"


def _spread_dims(spark, sf):
    p = view(spark, sf, "v1").withColumn("spread", F.floor(c("page") / 4)).withColumn("mode", F.when(c("height") == 1200, "L").otherwise("RGB"))
    return catalog.join_size(p, ["book", "spread"])


@query(f"select book, spread, width, height, mode, n from ({_JOINED.format(ext='null')})", "v1")
def agg_join_dims(spark, sf):
    return _spread_dims(spark, sf).select("book", "spread", "width", "height", "mode", "n")


@query(f"select book, spread, ext from ({_JOINED.format(ext=chr(99) + 'ase when bool_or(x = ' + repr('png') + ') then ' + repr('png') + ' else ' + repr('jpg') + ' end')})", "v1")
def agg_pick_ext(spark, sf):
    return _spread_dims(spark, sf).select("book", "spread", "ext")


@query(f", {BASED} select book, base, count(*) as group_size, min(part) as least_part, min(number) as first_number, max(number) as last_number from bs group by all", "v1 v2")
def agg_extra_pack(spark, sf):
    g = ranges.base_groups(view(spark, sf, "v2"))
    return g.select("book", "base", "group_size", "least_part", c("numbers").getItem(0).alias("first_number"), F.element_at("numbers", -1).alias("last_number"))


@query(f", {_SHADES}, n as (select image, count(*) as n from sh group by image) select image, n, case when n <= 1 then 1 else cast(pow(2, ceil(log2(greatest(ceil(log2(n)), 1)))) as int) end as bits from n", "v3")
def agg_bitdepth(spark, sf):
    n = _shades(spark, sf).groupBy("image").agg(F.count("*").alias("n"))
    return n.withColumn("bits", pixels.bit_depth(c("n").cast("double")))


@query("select book, number, count(*) as n from (select book, floor(number) as number from v2) group by all having count(*) > 1", "v1 v2")
def agg_duplicates(spark, sf):
    return catalog.duplicates(view(spark, sf, "v2").select("book", F.floor("number").cast("double").alias("number")), ["book", "number"])


@query("select book, new_name, count(*) as n from (select book, concat('p', page // 2) as new_name from v1) group by all having count(*) > 1", "v1")
def agg_distinct_names(spark, sf):
    return catalog.duplicates(view(spark, sf, "v1").select("book", F.concat(F.lit("p"), F.floor(c("page") / 2).cast("string")).alias("new_name")), ["book", "new_name"])


# Windows and sequences ------------------------------------------------------------------------------------------------


@query(f", {CHAPTERS} select book, ord, number, start, e as \"end\", e is null as is_single from ch", "v1 v2")
def win_chapter_end(spark, sf):
    return ranges.chapter_ends(view(spark, sf, "v2")).select("book", "ord", "number", "start", "end", "is_single")


def _digits(total: str) -> str:
    return f"greatest(3, length(cast({total} + 10 as varchar)))"


@query(f""", r as (select *, row_number() over (partition by book order by name) + 9 as n, {_digits('count(*) over (partition by book)')} as g from v1)
  select book, name, concat('Test - v01 - p', lpad(cast(n as varchar), greatest(g, length(cast(n as varchar)))::int, '0'), regexp_extract(name, '(\\.[^.]+)$', 1)) as new_name from r""", "v1")
def win_shift_rename(spark, sf):
    """Each book in up to eight ranges of names."""
    return ranges.shift_names(view(spark, sf, "v1"), 10, "Test", "v01", parts=8).select("book", "name", "new_name")


@query(f""", u as (select *, last_value(case when width < height then width end ignore nulls) over (partition by book, height order by name rows unbounded preceding) as w1 from v1),
  s as (select *, cast(case when width > height then greatest(floor(width / coalesce(w1, 1)), 1) else 1 end as int) as span from u),
  r as (select *, 10 + sum(span) over (partition by book order by name rows unbounded preceding) - span as n, {_digits('count(*) over (partition by book)')} as g from s)
  select book, name, span, concat('p', lpad(cast(n as varchar), greatest(g, length(cast(n as varchar)))::int, '0'), case when span > 1 then concat('-', lpad(cast(n + span - 1 as varchar), greatest(g, length(cast(n + span - 1 as varchar)))::int, '0')) else '' end, regexp_extract(name, '(\\.[^.]+)$', 1)) as new_name from r""", "v1")
def win_shift_spreads(spark, sf):
    return ranges.shift_names(view(spark, sf, "v1"), 10, spreads=True).select("book", "name", "span", "new_name")


@query("select book, pos, concat(kind, '-', row_number() over (partition by book, kind order by pos)) as step from (select book, page as pos, case page % 3 when 0 then 'level' when 1 then 'rename' else 'pack' end as kind from v1)", "v1")
def win_step_names(spark, sf):
    s = view(spark, sf, "v1").select("book", c("page").alias("pos"), F.when(c("page") % 3 == 0, "level").when(c("page") % 3 == 1, "rename").otherwise("pack").alias("kind"))
    return ranges.step_names(s, ("book",)).select("book", "pos", "step")


_RUNS = f"""{_HIST}, tot as (select *, ceil(sum(n) over (partition by image) * (0.25 / 100)) as need from hist), roi as (select * from tot where v <= 60),
  chg as (select *, case when n <> lag(n, 1, -1) over (partition by image order by v) then 1 else 0 end as g from roi), run as (select *, sum(g) over (partition by image order by v rows unbounded preceding) as run from chg),
  rr as (select image, run, any_value(n) as n, min(v) as l, max(v) as r, any_value(need) as need from run group by all),
  pk as (select *, lag(n, 1, 0) over (partition by image order by run) as b, lead(n, 1, 0) over (partition by image order by run) as a from rr),
  peaks as (select image, cast(floor((l + r) / 2) as int) as bin, n as height, n >= need as enough from pk where n > b and n > a)"""


def _peaks(spark, sf):
    hist = pixels.histogram(view(spark, sf, "v3"))
    return hist, pixels.local_peaks(hist)


@query(f", {_RUNS} select * from peaks", "v3")
def win_local_peaks(spark, sf):
    return _peaks(spark, sf)[1].select("image", "bin", "height", "enough")


@query(f""", {_RUNS}, near as (select p.image, p.bin, p.height, max(case when h.n > p.height and h.v < p.bin then h.v end) as lo, min(case when h.n > p.height and h.v > p.bin then h.v end) as hi from peaks p join roi h on p.image = h.image group by all),
  mins as (select p.image, p.bin, p.height, p.lo, p.hi, min(case when h.v <= p.bin and h.v > coalesce(p.lo, -1) then h.n end) as ml, min(case when h.v >= p.bin and h.v < coalesce(p.hi, 256) then h.n end) as mr from near p join roi h on p.image = h.image group by all)
  select image, bin, height, height - greatest(case when lo is null then 0 else ml end, case when hi is null then 0 else mr end) as prominence from mins""", "v3")
def win_peak_prominence(spark, sf):
    hist, peaks = _peaks(spark, sf)
    return pixels.prominences(peaks, hist).select("image", "bin", "height", "prominence")


@query(f", {_RUNS} select i.image, coalesce(arg_max(bin, struct_pack(h := height, b := -bin)) filter (where enough), arg_max(bin, struct_pack(h := height, b := -bin)), 0) as level from (select distinct image from v3) i left join peaks p on i.image = p.image group by i.image", "v3")
def win_pick_peak(spark, sf):
    return pixels.pick_peak(pixels.level_runs(pixels.histogram(view(spark, sf, "v3"))))


@query(""", f as (select book, page, page % 5 = 0 as is_blank, last_value(case when page % 5 <> 0 then width end ignore nulls) over (partition by book order by page rows unbounded preceding) as width,
  last_value(case when page % 5 <> 0 then height end ignore nulls) over (partition by book order by page rows unbounded preceding) as height from v1)
  select book, page, is_blank, width, height, row_number() over (partition by book order by page) - 1 as out from f where width is not null""", "v1")
def win_blank_fill(spark, sf):
    return ranges.fill_blank_sizes(view(spark, sf, "v1").withColumn("is_blank", c("page") % 5 == 0))


@query(""", m as (select book, page, width, row_number() over (partition by book order by page) as n, first_value(width) over (partition by book order by page) as w1 from v1),
  k as (select *, n > 1 and width > case when 2 * w1 - 80 < w1 then w1 + 150 else 2 * w1 - 80 end as center from m),
  g as (select *, sum(center::int) over (partition by book order by page rows unbounded preceding) as run from k),
  h as (select *, case when run = 0 then n - 2 else row_number() over (partition by book, run order by page) - 2 end as place from g)
  select book, page, case when n = 1 then 'cover' when center then 'center' when place % 2 = 0 then 'right' else 'left' end as side from h""", "v1")
def win_page_side(spark, sf):
    return ranges.page_sides(view(spark, sf, "v1")).select("book", "page", "side")


@query("select library, book, printf('%02d', row_number() over (partition by library order by book) - 1) as key from (select distinct book % 7 as library, book from v1)", "v1")
def win_oneshot_keys(spark, sf):
    return ranges.oneshot_keys(view(spark, sf, "v1").select((c("book") % 7).alias("library"), "book").distinct())


@query(f", {BASED} select book, ord, number, base, row_number() over (partition by book, base order by number) as rank from bs", "v1 v2")
def win_extra_rank(spark, sf):
    return ranges.base_rank(view(spark, sf, "v2")).select("book", "ord", "number", "base", "rank")


# Order, sets, explodes ------------------------------------------------------------------------------------------------


@query("select book, name, row_number() over (partition by book order by regexp_extract(name, '^(.*)\\.[^.]*$', 1) desc, name desc) as place from v1", "v1")
def sort_pages(spark, sf):
    stem = F.regexp_extract("name", r"^(.*)\.[^.]*$", 1)
    return running.places(view(spark, sf, "v1").select("book", "name", stem.alias("stem")), ("book",), ("stem", "name"), 8, descending=True).select("book", "name", "place")


@query(f", {_KEYS} select image, d2, count(*) as taken from ky where place <= 17 group by all", "v3c")
def topk_colour(spark, sf):
    return pixels.top_colours(_keys(spark, sf)).filter("taken > 0").select("image", "d2", "taken")


@query(f", {_SHADES} select image, shade, row_number() over (partition by image order by n desc, shade) as place from sh", "v3")
def sort_shades(spark, sf):
    return _shades(spark, sf).select("image", "shade", F.row_number().over(Window.partitionBy("image").orderBy(F.desc("n"), "shade")).alias("place"))


@query(f""", {_SHADES}, k as (select image, count(*) as n_shades, list(shade order by n desc, shade) as l, list(shade order by shade) as s from sh group by image),
  t as (select *, cast(pow(2, case when ceil(log2(n_shades)) <= 1 then 1 when ceil(log2(n_shades)) <= 3 then 2 when ceil(log2(n_shades)) <= 6 then 4 else 8 end) as int) as target from k)
  select image, n_shades, array_to_string(case when n_shades <= 1 then l when target < n_shades then s[1:target] else list_concat(l, [255 for x in range(target - n_shades)]) end, ',') as palette from t""", "v3")
def pad_shades(spark, sf):
    return pixels.padded_shades(_shades(spark, sf)).select("image", "n_shades", F.concat_ws(",", F.transform("palette", lambda x: x.cast("string"))).alias("palette"))


@query("select name, count(*) as n from (select name from v1 where book % 3 <> 1 union all select name from v1 where book % 3 <> 0) group by name", "v1")
def union_merge(spark, sf):
    p = view(spark, sf, "v1").select("book", F.concat(F.lit("x/"), c("name")).alias("name"))
    return catalog.merge_books([p.filter("book % 3 <> 1"), p.filter("book % 3 <> 0")])[0].groupBy("name").agg(F.count("*").alias("n"))


def _named(spark, sf):
    """Every page of a chapter with its full name."""
    ch = ranges.base_rank(view(spark, sf, "v2"))
    ch = ch.withColumn("text", N.chapter_text(c("number"), F.when(c("book") % 6 > 0, (c("book") % 100).cast("double")), c("group_size"), c("least_part"), c("rank")))
    p = ranges.assign_chapters(view(spark, sf, "v1").drop("width"), ch, ("ord", "number", "text")).filter("ord is not null")
    p = _with_publication(spark, p.withColumn("a", N.parse_page(c("name"))["a"]))
    quality = N.quality_suffix(F.lit("auto"), c("height"))
    full = N.page_of_chapter(
        F.concat(F.lit("Series "), c("book").cast("string")), F.when(c("book") % 5 > 0, F.lit("Real Publisher")), c("text"), F.when(c("ord") % 2 == 0, F.concat(F.lit("Part "), c("ord").cast("string"))), F.format_string("%03d", "a"), c("image"), F.lit("crd"),
        F.when(c("page") % 50 == 5, F.lit("Extra")), quality, (c("book") % 3).cast("int"),
    )
    return p.withColumn("full_name", full)


_NAMED = f"""{ASSIGNED}, {BASED}, {_PUBS}, grp as (select book, base, count(*) as k, min(part) as lp from bs group by all), rk as (select *, row_number() over (partition by book, base order by number) as rank from bs),
  j as (select a.*, r.base, r.part, r.rank, g.k, g.lp, pt.image as tag, cast(regexp_extract(a.name, '^(.*)p([0-9]{{1,3}})-?([0-9]{{1,3}})?(.*)', 2) as int) as pa from (select *, {_PUB} as key from asg where ord is not null) a join rk r on a.book = r.book and a.ord = r.ord join grp g on r.book = g.book and r.base = g.base join pt on pt.key = a.key),
  t as (select *, case when part is null then false when k > 1 then lp >= 5 else part >= 5 end as split from j),
  nm as (select *, concat('Series ', book, ' - c', printf('%03d', base), case when part is null then '' when split then concat('x', part - 4) when k > 1 then concat('x', rank) else 'x1' end,
    case when part is null or split then '' else concat(' (c', printf('%03d', base), '.', part, ')') end, ' (', case when book % 6 > 0 then concat('v', printf('%02d', book % 100)) else 'OShot' end, ') - p', printf('%03d', pa),
    case when page % 50 = 5 then ' [Extra]' when tag <> '' then ' ' else '' end, case when tag <> '' then concat(case when page % 50 = 5 then ' ' else '' end, '[', tag, ']') else '' end,
    case when ord % 2 = 0 then concat(' [Part ', ord, ']') else '' end, ' [', case when book % 5 > 0 then 'Real Publisher' else 'Unknown Publisher' end, '] [crd]',
    case when height >= 2000 then ' {{HQ}}' when height <= 1500 then ' {{LQ}}' else '' end, case when book % 3 > 1 then concat(' {{r', book % 3, '}}') else '' end) as full_name from t)"""


@query(f", {_NAMED} select book, page, full_name from nm", "v1 v2")
def fmt_page_name(spark, sf):
    return _named(spark, sf).select("book", "page", "full_name")


_CH = r"^Series [0-9]+ - c([0-9]+)([#x.][0-9]{1,2})? \(?c?([0-9]{1,4}\.[0-9]{1,4})?\)? ?\(?(v[0-9]+([#x][0-9]{1,3})?|[A-Za-z\-]+)?\)? ?- p[0-9]+x?[0-9]?-?[0-9]+x?[0-9]?.*"
_PARSED = f"""{_NAMED}, pr as (select book, page, nullif(regexp_extract(full_name, '{_CH}', 1), '') as ch, nullif(regexp_extract(full_name, '{_CH}', 2), '') as ex, nullif(regexp_extract(full_name, '{_CH}', 3), '') as actual,
  nullif(regexp_extract(full_name, '{_CH}', 4), '') as vol, nullif(regexp_extract(full_name, '{_CH}', 5), '') as volex from nm)"""
_KEYED = f"""{_PARSED}, kd as (select *, concat(case when vol is null then '' when not regexp_matches(vol, '^v[0-9]+$') then '00.' else concat(printf('%02d', cast(regexp_extract(vol, '^v([0-9]+)', 1) as int)), '.') end,
  case when actual is not null then concat(printf('%03d', cast(split_part(actual, '.', 1) as int)), '.', cast(split_part(actual, '.', 2) as int)) else printf('%03d', cast(ch as int)) end,
  case when ex is not null and actual is null then concat('.', cast(substr(ex, 2) as int) + case when contains(ex, '.') then 0 else 4 end) else '' end) as key from pr)"""


def _parsed(spark, sf):
    return _named(spark, sf).select("book", "page", "name", *(x.alias(k) for k, x in N.parse_chapter(c("full_name"), "Series [0-9]+").items()))


@query(f", {_PARSED} select book, page, ch, ex, actual, vol, volex from pr", "v1 v2")
def parse_chapter(spark, sf):
    return _parsed(spark, sf).select("book", "page", "ch", "ex", "actual", "vol", "volex")


def _keyed(spark, sf):
    p = _parsed(spark, sf)
    return p.withColumn("key", N.chapter_key({k: c(k) for k in ("ch", "ex", "actual", "vol", "volex", "title")}))


@query(f", {_KEYED} select book, page, key from kd", "v1 v2")
def chapter_key(spark, sf):
    return _keyed(spark, sf).select("book", "page", "key")


@query(f", {_KEYED} select book, key, count(*) as n_pages, min(page) as first_page, max(page) as last_page from kd group by all", "v1 v2")
def split_autosplit(spark, sf):
    return _keyed(spark, sf).groupBy("book", "key").agg(F.count("*").alias("n_pages"), F.min("page").alias("first_page"), F.max("page").alias("last_page"))


@query(f", {ASSIGNED} select book, number, count(*) as n_pages from asg where ord is not null group by all", "v1 v2")
def split_manual(spark, sf):
    p = view(spark, sf, "v1").withColumn("stem", F.regexp_extract("name", r"p([0-9]+(?:-[0-9]+)?)\.[^.]*$", 1))
    p = p.withColumn("page", N.extract_page(c("stem"))).select("book", "page", "name")
    return ranges.assign_chapters(p, view(spark, sf, "v2")).filter("ord is not null").groupBy("book", "number").agg(F.count("*").alias("n_pages"))


@query("select book, name, case when page % 11 = 0 then 'color' when regexp_extract(name, '\\.([^.]+)$', 1) in ('png', 'webp', 'bmp', 'tiff', 'tif') and width <> height then 'regray' else 'keep' end as route from v1", "v1")
def split_color(spark, sf):
    p = view(spark, sf, "v1")
    return p.select("book", "name", catalog.route_by_color(c("page") % 11 == 0, c("width") != c("height"), catalog.suffix(c("name"))).alias("route"))


@query("select book, cast(n as int) as number, printf('v%02d', n) as path from (select book, unnest(range(1, book % 5 + 2)) as n from (select distinct book from v1))", "v1")
def gen_volumes(spark, sf):
    b = view(spark, sf, "v1").select("book").distinct().select("book", F.explode(F.sequence(F.lit(1), (c("book") % 5 + 1).cast("int"))).alias("number"))
    return b.withColumn("path", F.format_string("v%02d", "number"))


_SPLIT = "pp as (select *, cast(regexp_extract(name, '^(.*)p([0-9]{1,3})-?([0-9]{1,3})?(.*)', 2) as int) as a, try_cast(regexp_extract(name, '^(.*)p([0-9]{1,3})-?([0-9]{1,3})?(.*)', 3) as int) as b from v1)"


@query(f", {_SPLIT} select book, name, a as page, width // 2 as half_width from pp where b is not null union all select book, name, b, width - width // 2 from pp where b is not null", "v1")
def explode_spread_split(spark, sf):
    p = view(spark, sf, "v1").drop("page")
    at = N.parse_page(c("name"))
    return catalog.split_spread(p.withColumns({"a": at["a"], "b": at["b"]})).select("book", "name", "page", "half_width")


@query(f", {_SPLIT} select book, page, name from pp where b is null", "v1")
def except_skipped(spark, sf):
    p = view(spark, sf, "v1").select("book", "page", "name")
    joined = p.filter(N.parse_page(c("name"))["b"].isNotNull())
    return p.join(joined, ["book", "page"], "left_anti")


# Scalars --------------------------------------------------------------------------------------------------------------


@query("select book, name, regexp_extract(name, '^(.*)p([0-9]{1,3})-?([0-9]{1,3})?(.*)', 1) as before, cast(regexp_extract(name, '^(.*)p([0-9]{1,3})-?([0-9]{1,3})?(.*)', 2) as int) as a, try_cast(regexp_extract(name, '^(.*)p([0-9]{1,3})-?([0-9]{1,3})?(.*)', 3) as int) as b, regexp_extract(name, '^(.*)p([0-9]{1,3})-?([0-9]{1,3})?(.*)', 4) as after from v1", "v1")
def parse_page(spark, sf):
    return view(spark, sf, "v1").select("book", "name", *(x.alias(k) for k, x in N.parse_page(c("name")).items()))


_CMX = r"^([\s\S]+?)(?:- (v[0-9]{1,3}))?(\.[0-9]{1,2})? - p([0-9]{1,3})-?([0-9]{1,3})?"


@query(f"select book, name, regexp_extract(name, '{_CMX}', 1) as t, nullif(regexp_extract(name, '{_CMX}', 2), '') as vol, nullif(regexp_extract(name, '{_CMX}', 3), '') as volex, try_cast(regexp_extract(name, '{_CMX}', 4) as int) as a, try_cast(regexp_extract(name, '{_CMX}', 5) as int) as b from v1", "v1")
def parse_comix(spark, sf):
    return view(spark, sf, "v1").select("book", "name", *(x.alias(k) for k, x in N.parse_comix(c("name")).items()))


_VOL = r"^Series v([0-9]+\.?[0-9]{1,2}?).*[\[\(]crd.*"


@query(f"select book, page, nullif(regexp_extract(concat('Series v', printf('%02d', book % 100), case when page % 4 = 0 then '.5' else '' end, ' (2023) (Digital) ', case when page % 3 = 0 then '[crd]' else '[abc]' end), '{_VOL}', 1), '') as volume from v1", "v1")
def parse_volume(spark, sf):
    text = F.concat(F.lit("Series v"), F.format_string("%02d", c("book") % 100), F.when(c("page") % 4 == 0, ".5").otherwise(""), F.lit(" (2023) (Digital) "), F.when(c("page") % 3 == 0, "[crd]").otherwise("[abc]"))
    return view(spark, sf, "v1").select("book", "page", N.parse_volume(text, "Series", "crd").alias("volume"))


_TEXTS = "case page % 5 when 0 then 'v02' when 1 then 'oneshot' when 2 then 'v3' when 3 then null else 'v10' end"


@query(f"select book, page, case when {_TEXTS} = 'oneshot' then null when page % 5 = 3 then 7.0 else cast(concat(regexp_extract({_TEXTS}, '([0-9]+)', 1), case when page % 3 = 0 then '.5' else '' end) as double) end as volume from v1", "v1")
def volume_value(spark, sf):
    p = view(spark, sf, "v1").withColumn("vol", F.expr(_TEXTS)).withColumn("volex", F.when((c("page") % 3 == 0) & c("vol").isNotNull(), "x5"))
    return p.select("book", "page", N.volume_value(c("vol"), c("volex"), F.lit(7.0)).alias("volume"))


@query("select book, page, cast(case when contains(stem, '007') then 700 else split_part(stem, '-', 1)::int end as int) as found from (select *, regexp_extract(name, 'p([0-9]+(?:-[0-9]+)?)\\.', 1) as stem from v1)", "v1")
def extract_page(spark, sf):
    p = view(spark, sf, "v1").withColumn("stem", F.regexp_extract("name", r"p([0-9]+(?:-[0-9]+)?)\.", 1))
    return p.select("book", "page", N.extract_page(c("stem"), custom={"007": 700}).alias("found"))


@query("""select book, ord, case when ord % 3 = 0 then 1 when ord % 3 = 1 then 5 end as n_pages, case when ord % 3 = 0 then true when ord % 3 = 1 then false end as is_single, case when ord % 3 < 2 then start end as first_page, case when ord % 3 = 0 then start when ord % 3 = 1 then start + 4 end as last_page from v2""", "v1 v2")
def parse_range(spark, sf):
    text = F.when(c("ord") % 3 == 0, c("start").cast("string")).when(c("ord") % 3 == 1, F.concat_ws("-", c("start").cast("string"), (c("start") + 4).cast("string"))).otherwise("a-b")
    r = N.parse_range(text)
    return view(spark, sf, "v2").select("book", "ord", F.when(r["pages"].isNotNull(), F.size(r["pages"])).alias("n_pages"), r["is_single"].alias("is_single"), F.element_at(r["pages"], 1).alias("first_page"), F.element_at(r["pages"], -1).alias("last_page"))


@query('select book, ord, case when ord % 2 = 0 then number else least(number, 3.5) end as start, case when ord % 2 = 1 and number <> 3.5 then greatest(number, 3.5) end as "end" from v2', "v1 v2")
def parse_volume_arg(spark, sf):
    text = F.when(c("ord") % 2 == 0, c("number").cast("string")).otherwise(F.concat(c("number").cast("string"), F.lit("-3.5")))
    return view(spark, sf, "v2").select("book", "ord", *(x.alias(k) for k, x in N.parse_volume_arg(text).items()))


@query("select page_id, cx0 as top, case when page_id % 4 >= 1 then 10.0 else cx0 end as \"right\", case when page_id % 4 >= 2 then 7.5 else cx0 end as bottom, case page_id % 4 when 0 then cx0 when 1 then 10.0 when 2 then 10.0 else 1.0 end as \"left\" from v6b", "v6b")
def parse_box(spark, sf):
    n = c("page_id") % 4
    text = F.concat(c("cx0").cast("string"), F.when(n >= 1, " 10").otherwise(""), F.when(n >= 2, "/7.5").otherwise(""), F.when(n >= 3, " 1").otherwise(""))
    return view(spark, sf, "v6b").select("page_id", N.parse_box(text).alias("x")).select("page_id", "x.*")


_FMT = "case when number = floor(number) then printf('%03d', cast(number as int)) else concat(printf('%03d', cast(floor(number) as int)), 'x', case when cast(split_part(cast(number as varchar), '.', 2) as int) >= 5 then cast(split_part(cast(number as varchar), '.', 2) as int) - 4 else cast(split_part(cast(number as varchar), '.', 2) as int) end) end"


@query(f"select book, ord, {_FMT} as text from (select book, ord, number + case when ord % 4 = 0 then 0.25 else 0 end as number from v2)", "v1 v2")
def fmt_number(spark, sf):
    return view(spark, sf, "v2").select("book", "ord", N.fmt_number(c("number") + F.when(c("ord") % 4 == 0, 0.25).otherwise(0.0)).alias("text"))


@query(f"select book, ord, case when ord % 3 = 0 then concat('v', printf('%02d', ord)) when ord % 3 = 1 then concat('v', printf('%02d', ord), '-', printf('%02d', ord + 2)) else {_FMT} end as text from v2", "v1 v2")
def fmt_volume_text(spark, sf):
    v = c("ord").cast("double")
    return view(spark, sf, "v2").select("book", "ord", N.fmt_volume_text(F.when(c("ord") % 3 < 2, v), F.when(c("ord") % 3 == 1, v + 2), c("number")).alias("text"))


@query(f", {_PUBS} select book, concat('Series ', book, case when book % 2 = 0 then concat(' v', printf('%02d', book % 100)) else '' end, ' (2023) ', case when book % 5 = 0 then '(Fixed) ' else '' end, '(', archive, ') [crd]', case when book % 3 > 1 then concat(' (v', book % 3, ')') else '' end) as archive_name from (select distinct book, {_PUB} as key from v1) join pt using (key)", "v1")
def fmt_archive_name(spark, sf):
    b = _with_publication(spark, view(spark, sf, "v1").select("book").distinct())
    volume = F.when(c("book") % 2 == 0, N.fmt_volume_text((c("book") % 100).cast("double")))
    return b.select("book", N.fmt_archive_name(F.concat(F.lit("Series "), c("book").cast("string")), F.lit(2023), c("archive"), F.lit("crd"), volume, F.when(c("book") % 5 == 0, F.lit(" Fixed ")), (c("book") % 3).cast("int")).alias("archive_name"))


@query("select book, page, case when height >= 2000 then 'HQ' when height <= 1500 then 'LQ' end as quality from v1", "v1")
def quality_suffix(spark, sf):
    return view(spark, sf, "v1").select("book", "page", N.quality_suffix(F.lit("Auto"), c("height")).alias("quality"))


@query("""select page_id, pos, translate(href, '/:<>"\\?*|#', '／：＜＞”＼？⋆｜') as safe from v4""", "v4")
def secure_name(spark, sf):
    return view(spark, sf, "v4").select("page_id", "pos", N.secure_name(c("href")).alias("safe"))


@query("""select page_id, pos, translate(url, ':<>"\\?*|#', ':<>"\\?*|') as name from v4""", "v4")
def unsecure_name(spark, sf):
    """All swaps but that of the slash are undone."""
    url = N.secure_name(F.replace("url", F.lit("/"), F.lit("~")))
    return view(spark, sf, "v4").select("page_id", "pos", F.replace(N.unsecure_name(url), F.lit("~"), F.lit("/")).alias("name"))


@query("select book, page, concat('Title ', page) as title from v1", "v1")
def clean_title(spark, sf):
    return view(spark, sf, "v1").select("book", "page", N.clean_title(F.concat(F.lit("Title "), c("page").cast("string"), F.when(c("page") % 2 == 0, "]").otherwise(""))).alias("title"))


@query(f"select book, page, lower({_TEXTS}) in ('na', 'oshot', 'oneshot', 'one-shot', 'one shot') as oneshot from v1", "v1")
def is_oneshot(spark, sf):
    return view(spark, sf, "v1").select("book", "page", N.is_oneshot(F.expr(_TEXTS)).alias("oneshot"))


@query(f"select book, page, not regexp_matches(coalesce({_TEXTS}, ''), '^v[0-9]+$') as not_volume from v1", "v1")
def is_not_volume(spark, sf):
    return view(spark, sf, "v1").select("book", "page", N.is_not_volume(F.expr(_TEXTS)).alias("not_volume"))


@query("select event_id, concat(case when s >= 86400 then concat(s // 86400, 'd') else '' end, case when s % 86400 >= 3600 then concat(s % 86400 // 3600, 'h') else '' end, case when s % 3600 >= 60 then concat(s % 3600 // 60, 'm') else '' end, case when s % 60 > 0 or s = 0 then concat(s % 60, 's') else '' end) as elapsed from (select event_id, event_id * 37 as s from v5)", "v5")
def fmt_elapsed(spark, sf):
    return view(spark, sf, "v5").select("event_id", N.fmt_elapsed(c("event_id") * 37).alias("elapsed"))


@query("select page_id, pos, concat('id=', page_id, ' at ', href, ' {other}') as text from v4", "v4")
def fmt_template(spark, sf):
    return view(spark, sf, "v4").select("page_id", "pos", N.fmt_template(F.lit("id={id} at {href} {other}"), {"id": c("page_id").cast("string"), "href": c("href")}).alias("text"))


_GAMMA = "case when b = 0 then 1.0 when b <= 127 then round_even(ln((0.5 - b / 255.0) / (1 - b / 255.0)) / ln(0.5::double) * 100, 0) / 100 end"


@query(f"select image, b, {_GAMMA} as gamma from (select distinct image, v as b from v3)", "v3")
def level_gamma(spark, sf):
    return view(spark, sf, "v3").select("image", c("v").alias("b")).distinct().withColumn("gamma", pixels.gamma_of(c("b")))


@query("select image, v, case when v < lo + 10 then 0 when v > hi - 10 then 255 else cast(round_even(pow((v - lo - 10) / (hi - lo - 20), 1 / 0.8) * 255, 0) as int) end as out from (select image, min(v) as lo, max(v) as hi from v3 group by image), (select unnest(range(256)) as v)", "v3")
def level_lut(spark, sf):
    r = view(spark, sf, "v3").groupBy("image").agg((F.min("v") + 10).alias("black"), (F.max("v") - 10).alias("white")).withColumn("gamma", F.lit(0.8))
    return pixels.level_lut(r).select("image", "v", "out")


@query(f"select image, b, concat(round_even(b / 255.0 * 10000, 0) / 100 + 1, ',', round_even((255 - b) / 255.0 * 10000, 0) / 100, '%,', {_GAMMA}) as params from (select distinct image, v as b from v3 where v <= 100)", "v3")
def level_params(spark, sf):
    b = view(spark, sf, "v3").filter("v <= 100").select("image", c("v").alias("b")).distinct()
    return b.withColumn("params", pixels.level_params(c("b"), 255 - c("b"), 1))


@query("select book, page, case when (page % 70 <= 0 and 255 - page % 3 >= 255) or page % 70 > 60 then case when width = height then 'COPIED' else 'GRAYSCALED' end else 'PROCESSED' end as status from v1", "v1")
def level_decision(spark, sf):
    return view(spark, sf, "v1").select("book", "page", pixels.level_decision(c("page") % 70, 255 - c("page") % 3, c("width") == c("height")).alias("status"))


@query("select image, vec_id, pos, cast(floor(round_even(v * 3.0::double / 255, 0) * 255 / 3) as int) as out from v3", "v3")
def posterize_lut(spark, sf):
    return view(spark, sf, "v3").select("image", "vec_id", "pos", pixels.posterize(c("v"), 2).alias("out"))


@query(f""", {_SHADES}, k as (select image, count(*) as n from sh group by image), t as (select image, case when n <= 1 then n else cast(pow(2, case when ceil(log2(n)) <= 1 then 1 when ceil(log2(n)) <= 3 then 2 when ceil(log2(n)) <= 6 then 4 else 8 end) as int) end as size from k)
  select image, size, cast(greatest(floor(log2(size)), 1) as int) as bits, case when greatest(floor(log2(size)), 1) >= 8 then 'COPIED' else 'PROCESSED' end as status from t""", "v3")
def autoposterize_decision(spark, sf):
    p = pixels.padded_shades(_shades(spark, sf)).withColumn("size", F.size("palette"))
    return p.select("image", "size", pixels.autoposterize(c("size")).alias("x")).select("image", "size", "x.*")


@query("select image, vec_id, pos, case when v <= 42 then 0 when v <= 127 then 85 when v <= 212 then 170 else 255 end as out from v3", "v3")
def posterize_nearest(spark, sf):
    return view(spark, sf, "v3").select("image", "vec_id", "pos", pixels.nearest_shade(c("v"), F.array(*map(F.lit, (0, 85, 170, 255)))).alias("out"))


@query("select image, vec_id, px, cast(floor(r * 0.299::double + g * 0.587::double + b * 0.114::double + 0.5::double) as int) as gray from v3c", "v3c")
def to_gray(spark, sf):
    return view(spark, sf, "v3c").select("image", "vec_id", "px", pixels.to_gray(c("r"), c("g"), c("b")).alias("gray"))


@query("select image, vec_id, pos, round(case when hi > lo then (v - lo) / (hi - lo) else 0 end, 9) as stretched from (select *, min(v) over (partition by image) as lo, max(v) over (partition by image) as hi from v3)", "v3")
def contrast_stretch(spark, sf):
    return pixels.contrast_stretch(view(spark, sf, "v3")).select("image", "vec_id", "pos", F.round("stretched", 9).alias("stretched"))


@query("select book, ord, ord % 2 = 1 as omnibus, number as first, concat(case when number = floor(number) then cast(cast(number as int) as varchar) else cast(number as varchar) end, case when ord % 2 = 1 then concat('-', cast(floor(number) as int) + 2) else '' end) as shown from v2", "v1 v2")
def volume_display(spark, sf):
    end = F.when(c("ord") % 2 == 1, F.floor("number").cast("double") + 2)
    return view(spark, sf, "v2").select("book", "ord", *(x.alias(k) for k, x in N.volume_display(c("number"), end).items()))


@query(f", {CHAPTERS} select book, ord, concat(printf('%03d', start), '-', case when e is null then 'end' else printf('%03d', e) end) as shown from ch", "v1 v2")
def range_display(spark, sf):
    return ranges.chapter_ends(view(spark, sf, "v2")).select("book", "ord", N.range_display(c("start"), c("end")).alias("shown"))


@query("select book, page, cast(trunc(width * least(800.0::double / width, 1000.0::double / height)) as int) as w, cast(trunc(height * least(800.0::double / width, 1000.0::double / height)) as int) as h, cast(trunc(width * (900.0::double / height)) as int) as by_height from v1", "v1")
def resize_dims(spark, sf):
    w, h = catalog.resize(c("width"), c("height"), "fit", 800, 1000)
    return view(spark, sf, "v1").select("book", "page", w.alias("w"), h.alias("h"), catalog.resize(c("width"), c("height"), "height", h=900)[0].alias("by_height"))


@query("select book, page, 10 as x0, 20 as y0, width - 30 as x1, height - 40 as y1 from v1", "v1")
def crop_dims(spark, sf):
    return view(spark, sf, "v1").select("book", "page", catalog.crop(c("width"), c("height"), 10, 20, 30, 40).alias("x")).select("book", "page", "x.*")


def _plain(df):
    return df.select(*(c(f.name).cast("double").alias(f.name) if f.dataType.typeName() == "decimal" else c(f.name) for f in df.schema.fields))


@query("select page_id, greatest(0.0::double, cx0 - 2.5) as x0, greatest(0.0::double, cy0 - 12) as y0, cx1 + 3 as x1, cy1 + 4 as y1 from v6b", "v6b")
def box_expand(spark, sf):
    b = view(spark, sf, "v6b").select("page_id", boxes.expand(c("cx0"), c("cy0"), c("cx1"), c("cy1"), 12, 3, 4, 2.5).alias("x"))
    return _plain(b.select("page_id", "x.*"))


@query("select page_id, cx0 as x0, least(mx1, mx1 - (cx0 - mx0)) as x1, greatest(mx0, mx0 + (mx1 - cx1)) as left_x0 from v6b", "v6b")
def box_widen(spark, sf):
    b = view(spark, sf, "v6b").select("page_id", boxes.widen(c("mx0"), c("mx1"), c("cx0"), c("cx1")).alias("x"), boxes.widen(c("mx0"), c("mx1"), c("cx0"), c("cx1"), "left").getField("x0").alias("left_x0"))
    return _plain(b.select("page_id", "x.*", "left_x0"))


@query("""select p_partkey as page, case when p_partkey % 4 = 0 then concat('own', p_partkey) when (p_partkey // 10) % 3 = 0 then concat('box', p_partkey // 10) when (p_partkey // 100) % 2 = 0 then concat('top', p_partkey // 100) else concat('media', p_partkey) end as box from part""")
def box_inherit(spark, sf):
    p = table(spark, sf, "part").select("p_partkey")
    k = c("p_partkey")
    text = lambda *xs: F.concat(*(x.cast("string") if not isinstance(x, str) else F.lit(x) for x in xs))
    none = F.lit(None).cast("string")
    pages = p.select(text("p", k).alias("node"), text("m", F.floor(k / 10)).alias("parent"), F.when(k % 4 == 0, text("own", k)).alias("box"), text("media", k).alias("media"), F.lit(True).alias("is_page"))
    mid = F.floor(k / 10)
    middle = p.select(text("m", mid).alias("node"), text("t", F.floor(k / 100)).alias("parent"), F.when(mid % 3 == 0, text("box", mid)).alias("box"), none.alias("media"), F.lit(False).alias("is_page")).distinct()
    top = p.select(text("t", F.floor(k / 100)).alias("node"), none.alias("parent"), F.when(F.floor(k / 100) % 2 == 0, text("top", F.floor(k / 100))).alias("box"), none.alias("media"), F.lit(False).alias("is_page")).distinct()
    return boxes.inherit(pages.unionByName(middle).unionByName(top), 2).select(F.substring("page", 2, 20).cast("long").alias("page"), "box")


# Markup ---------------------------------------------------------------------------------------------------------------


@query("select page_id, pos, case when pos % 5 = 0 then concat('OPS/text/', replace(href, '/', '')) when pos % 5 = 1 then substr(href, 2) when pos % 5 = 2 then concat('OPS/', replace(href, '/', '')) when pos % 5 = 3 then null else concat('OPS/x/', replace(href, '/', '')) end as path from v4", "v4")
def resolve_href(spark, sf):
    name = F.replace("href", F.lit("/"), F.lit(""))
    n = c("pos") % 5
    href = F.when(n == 0, F.concat(F.lit("./"), name, F.lit("#top"))).when(n == 1, c("href")).when(n == 2, F.concat(F.lit("../"), name)).when(n == 3, F.concat(F.lit("https://x.org/"), name)).otherwise(F.concat(F.lit("OPS/x/"), name))
    return view(spark, sf, "v4").select("page_id", "pos", markup.resolve_href(F.lit("OPS/text/page.xhtml"), href).alias("path"))


_TAGGED = "concat('href=\"', {}, '\"')"


@query(f"""select page_id, md5(case when lo = hi then replace(html, {_TAGGED.format('hi')}, 'href="/new"')
  else replace(replace(replace(html, {_TAGGED.format('lo')}, {_TAGGED.format('chr(1)')}), {_TAGGED.format('hi')}, 'href="/new"'), {_TAGGED.format('chr(1)')}, {_TAGGED.format('hi')}) end) as digest
  from pages join (select page_id, min(href) as lo, max(href) as hi from v4 group by page_id) using (page_id)""", "v4")
def rewrite_refs(spark, sf):
    """In every page its least link becomes its greatest, and that one a new name: a chain, taken as one step."""
    ends = view(spark, sf, "v4").groupBy("page_id").agg(F.min("href").alias("lo"), F.max("href").alias("hi"))
    pair = lambda old, new: F.struct(old.alias("old"), new.alias("new"))
    last = pair(c("hi"), F.lit("/new"))
    mapping = ends.select("page_id", F.inline(F.when(c("lo") == c("hi"), F.array(last)).otherwise(F.array(pair(c("lo"), c("hi")), last))))
    pages = table(spark, sf, "pages").join(ends.select("page_id"), "page_id")
    return markup.rewrite_refs(pages.select("page_id", "html"), mapping, within=("page_id",), key="page_id").select("page_id", F.md5("html").alias("digest"))


@query("select page_id, pos, href as ref from v4", "v4")
def extract_refs(spark, sf):
    """Links stand in for images: the pages have none."""
    images = F.regexp_replace(F.col("html"), r'<a href="', '<img src="')
    return table(spark, sf, "pages").select("page_id", F.posexplode(markup.image_refs(images)).alias("pos", "ref"))


@query("select page_id, pos, case when pos % 3 = 0 then href end as src from v4", "v4")
def image_only_page(spark, sf):
    n = c("pos") % 3
    one = F.concat(F.lit("<html><head><title>x</title></head><body><div>\n<img src=\""), c("href"), F.lit('"/>'))
    page = F.when(n == 0, F.concat(one, F.lit("</div></body></html>"))).when(n == 1, F.concat(one, F.lit("words</div></body></html>"))).otherwise(F.concat(one, one, F.lit("</div></body></html>")))
    return view(spark, sf, "v4").select("page_id", "pos", markup.image_only(page).alias("src"))


@query("select book, page, 'me@x.org' as artist, name as title, regexp_matches(name, '\\.(jpg|jpeg|png|tiff|tif)$') as allowed from v1", "v1")
def tag_map(spark, sf):
    tags = N.tag_map(c("name"), F.lit("me@x.org"))
    return view(spark, sf, "v1").select("book", "page", tags["Artist"].alias("artist"), tags["Title"].alias("title"), catalog.suffix(c("name")).isin("jpg", "jpeg", "png", "tiff", "tif").alias("allowed"))


# User models and pipelines --------------------------------------------------------------------------------------------


@query("""select book, page, case when width = height then false else (p1 + 0.5) / 2 >= 0.5 end as is_color, case when width = height then 100 else cast(floor(greatest((p1 + 0.5) / 2, 1 - (p1 + 0.5) / 2) * 100) as int) end as confidence, width = height as should_convert
  from (select book, page, width, height, (page % 16) / 16.0::double as p1 from v1)""", "v1")
def udf_model(spark, sf):
    """A model's vote, asked only where a cheap test doesn't decide (here, by the shape of the page)."""

    def make_predict():
        import numpy as np

        return lambda x: np.stack([x[:, 0] / 16, np.full(len(x), 0.5)], axis=1)

    p = view(spark, sf, "v1").withColumn("f0", (c("page") % 16).cast("double")).withColumn("f1", F.lit(0.0))
    answers = {"is_color": F.lit(False), "confidence": F.lit(100), "should_convert": F.lit(True)}
    scored = scoring.guarded_scores(p, c("width") == c("height"), answers, ["f0", "f1"], make_predict, 2)
    return scored.select("book", "page", "is_color", "confidence", "should_convert")


@query("select book, page, cast(regexp_extract(name, 'p([0-9]+)', 1) as int) as found from v1", "v1")
def udf_regex(spark, sf):
    stem = F.regexp_extract("name", r"(p[0-9]+(?:-[0-9]+)?)\.", 1)
    return view(spark, sf, "v1").select("book", "page", N.extract_page(F.regexp_replace(stem, r"-[0-9]+$", ""), r"^p([0-9]+)()$").alias("found"))


@query("select image, vec_id as y, pos as x, v as out from v3", "v3")
def tile_score(spark, sf):
    """With a model that gives back its input, so must the blend."""
    v = view(spark, sf, "v3")
    px = v.select(c("image").cast("int").alias("label"), c("vec_id").cast("int").alias("image"), F.lit(0).alias("y"), c("pos").alias("x"), c("v"))
    out = scoring.tile_score(px.select("image", "y", "x", "v"), 16, 2, lambda block: block)
    labels = px.select("image", "label").distinct()
    return out.join(labels, "image").select(c("label").alias("image"), c("image").cast("long").alias("y"), "x", "out")


_ACTIONS = [
    {"kind": "rescale", "mode": "fit", "w": 800, "h": 1000, "conditions": {"op": "condition", "field": "height", "operator": ">=", "value": 2000}},
    {"kind": "autolevel"},
    {"kind": "pack", "prefix": "Series "},
]


@query("""select book, page, case when height >= 2000 and page % 10 <> 0 then cast(trunc(width * least(800.0::double / width, 1000.0::double / height)) as int) else width end as width, case when page % 70 <= 0 or page % 70 > 60 then case when width = height then 'COPIED' else 'GRAYSCALED' end else 'PROCESSED' end as status,
  concat('Series ', book, '.cbz') as archive, case when height >= 2000 and page % 10 <> 0 then 'rescale-1:done' else 'rescale-1:ignored' end as first_step from v1""", "v1")
def pipeline_run(spark, sf):
    p = view(spark, sf, "v1")
    p = p.withColumns({"black": c("page") % 70, "white": F.lit(255), "is_color": c("width") == c("height")})
    skips = p.filter("page % 10 = 0").select("book", "page", F.lit("rescale-1").alias("step"))
    done = pipeline.run_pipeline(p, _ACTIONS, skips)
    return done.select("book", "page", "width", "status", "archive", c("history").getItem(0).alias("first_step"))


@query("""select 'unsorted_start' as "check", cast(book as varchar) as book, cast(start as varchar) as detail from (select book, start, lag(start) over (partition by book order by ord) as b from (select book, ord, case when ord % 7 = 6 then 1 else start end as start from v2)) where start <= b
  union all select 'duplicate_start', cast(book as varchar), '1' from v2 where ord % 7 = 6 group by book having count(*) > 1
  union all select 'unknown_step', cast(book as varchar), 'level-9' from v2 where ord = 2
  union all select 'unknown_action', null, 'interrupt'""", "v1 v2")
def pipeline_validate(spark, sf):
    ch = view(spark, sf, "v2").withColumn("start", F.when(c("ord") % 7 == 6, 1).otherwise(c("start")))
    volumes = ch.select(F.concat(F.lit("v"), c("book").cast("string")).alias("path")).distinct()
    steps = ranges.step_names(spark.createDataFrame([(0, "level"), (1, "interrupt")], "pos int, kind string"))
    return pipeline.violations(ch, volumes, steps, ch.filter("ord = 2").select("book", F.lit("level-9").alias("step")))


_LIST_A = [
    {"kind": "rescale", "rescale": {"mode": "fit", "width": 800, "height": 1000}, "kernel": "lanczos", "conditions": {"op": "and", "rules": [{"op": "condition", "field": "height", "operator": ">=", "value": 2000}, {"op": "not", "rule": {"op": "condition", "field": "width", "operator": "==", "value": "ctx:height"}}]}},
    {"kind": "color_detect"},
    {"kind": "level", "black_level": 20, "white_level": 255, "skip_color": True},
    {"kind": "spreads"},
    {"kind": "change_cwd", "directory": "done"},
    {"kind": "pack"},
]
_LIST_B = [{"kind": "shift_rename", "start": 3, "conditions": {"op": "condition", "field": "page", "operator": "not in", "value": [0, 1, 5]}}, {"kind": "shift_rename", "start": 1, "title": "Again"}, {"kind": "posterize", "bpc": 4}]


def _written_config(spark, sf) -> str:
    """The path of configurations, a line for each book: skip lists, colour pages, spreads, and one of two lists of actions."""
    p = view(spark, sf, "v1")
    pages = lambda test: F.array_sort(F.collect_list(F.when(test, c("page"))))
    volume = p.groupBy("book").agg(pages(c("page") % 10 == 0).alias("none"), pages(c("page") % 11 == 0).alias("colors"), F.array_sort(F.collect_list(F.when(c("page") % 40 == 6, F.array(c("page"), c("page") + 1)))).alias("spreads"))
    whole = c("book") % 4 != 3
    skips = F.array(F.struct(F.lit("rescale-1").alias("step"), F.lit("copy").alias("action"), c("none").alias("pages")), F.struct(F.lit("shift_rename-2").alias("step"), F.lit("ignore").alias("action"), c("none").alias("pages")))
    fields = F.struct(
        F.concat(F.lit("v"), c("book").cast("string")).alias("path"), F.when(whole, F.lit(1.5)).alias("number"), F.when(~whole, F.array(c("book"), c("book") + 1)).alias("number_range"),
        F.lit(2020).alias("year"), "spreads", "colors", F.filter(skips, lambda x: (F.size(x.pages) > 0) & (x.step == F.when(c("book") % 2 == 0, "rescale-1").otherwise("shift_rename-2"))).alias("skip_actions"),
    )
    # a number, or a range of numbers, under one name
    text = F.replace(F.to_json(F.array(fields)), F.lit('"number_range"'), F.lit('"number"'))
    actions = F.when(c("book") % 2 == 0, F.lit(json.dumps(_LIST_A))).otherwise(F.lit(json.dumps(_LIST_B)))
    path = scratch(spark, "configurations")
    volume.select(F.concat(F.lit('{"title":"Series","publisher":"P","credit":"crd","email":"me@x.org","volumes":'), text, F.lit(',"actions":'), actions, F.lit("}"))).write.text(path)
    return path


_DO = "(height >= 2000 and width <> height and page % 10 <> 0)"
_CONFIGURED = f"""cf as (select book, page, name, {_DO} as fits, page % 40 = 6 as s0, page % 40 = 7 as s1, height, width, row_number() over (partition by book order by name) as k, {_digits('count(*) over (partition by book)').replace('+ 10', '+ 1')} as g, page % 11 = 0 as col from v1)"""


@query(f""", {_CONFIGURED} select 'v' || book as book, page,
    case when book % 2 = 0 and fits then cast(trunc(width * least(800.0::double / width, 1000.0::double / height)) as int) else width end as width,
    case when book % 2 = 0 then case when col then 'COPIED' else 'PROCESSED' end else 'PROCESSED' end as status,
    case when book % 2 = 0 and s0 then page || '-' || (page + 1) when book % 2 = 0 and s1 then (page - 1) || '-' || page end as spread,
    case when book % 2 = 0 then 'Series ' || case when book % 4 = 3 then 'v' || printf('%02d', book) || '-' || printf('%02d', book + 1) else 'v01.5' end || ' (2020) (Digital) (crd).cbz' end as archive,
    case when book % 2 = 0 then 'done/v' || book else 'posterized/v' || book end as cwd,
    case when book % 2 = 0 then case when fits then 'rescale-1:done' when page % 10 = 0 then 'rescale-1:copied' else 'rescale-1:ignored' end when page in (0, 1, 5) then 'shift_rename-1:ignored' else 'shift_rename-1:done' end as first_step from cf""", "v1")
def config_run(spark, sf):
    """Configurations with nested conditions, skip lists, colour pages and spreads, written, read back and run over all pages."""
    p = view(spark, sf, "v1").withColumn("book", F.concat(F.lit("v"), c("book").cast("string")))
    done = pipeline.run_config(spark, _written_config(spark, sf), p, multi_line=False).pages
    return done.select("book", "page", "width", "status", "spread", "archive", "cwd", c("history").getItem(0).alias("first_step"))


@query(f""", {_CONFIGURED}, n as (select book, count(*) as pages_in, count(*) filter (where fits) as d0, count(*) filter (where page % 10 = 0) as tens from cf where book % 2 = 0 group by book)
  select 'v' || book as volume, step, pages_in, case when step = 'rescale-1' then d0 else pages_in end as pages_done, case when step in ('change_cwd-1', 'pack-1') then 'done' when step in ('level-1', 'spreads-1') then 'leveled' else 'rescaled' end || '/v' || book as cwd
  from n, (values ('rescale-1'), ('color_detect-1'), ('level-1'), ('spreads-1'), ('change_cwd-1'), ('pack-1')) as t(step)""", "v1")
def pipeline_dry_run(spark, sf):
    """What each step of a configured list of actions would meet and do in each volume."""
    t = read_config(spark, _written_config(spark, sf), multi_line=False)
    p = view(spark, sf, "v1").filter("book % 2 = 0").withColumn("book", F.concat(F.lit("v"), c("book").cast("string")))
    actions = next(x for text, x in action_lists(t["volumes"]) if x[0]["kind"] == "rescale")
    report = pipeline.dry_run(p, actions, pipeline.Inputs(skips=t["skips"], colors=t["colors"], spreads=t["spreads"], volumes=t["volumes"]))
    return report.select("volume", "step", "pages_in", "pages_done", "cwd")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Which pages go to which chapter, and under what name."""
    return _named(spark, sf).groupBy("book", "ord", "number").agg(F.count("*").alias("n_pages"), F.min("full_name").alias("first_name"), F.max("full_name").alias("last_name"))


@query(f", {_NAMED} select book, ord, number, count(*) as n_pages, min(full_name) as first_name, max(full_name) as last_name from nm group by all", "v1 v2")
def catalog_chapters(spark, sf):
    return flagship(spark, sf)
