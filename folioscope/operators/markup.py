"""References in markup: found, resolved, ordered and rewritten."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IMAGE = r"""(?i)<(?:img\b[^>]*?\bsrc|image\b[^>]*?\bhref)\s*=\s*["']([^"']*)["']"""
TAG = r"<\s*([a-zA-Z][\w:.-]*)"
#: Tags that may wrap the one image of an image page, and tags without content.
WRAPPERS = ("html", "body", "div", "p", "span", "figure", "section", "article", "main", "center", "a", "img", "image", "svg", "g", "br")
IGNORED = ("script", "style", "title", "desc", "metadata", "head", "meta", "link")


def fold_path(parts: Column) -> Column:
    """Path parts without ``.`` and ``..``; null where it climbs out."""
    empty = F.struct(F.array().cast("array<string>").alias("p"), F.lit(True).alias("ok"))

    def step(acc: Column, part: Column) -> Column:
        p, ok = acc.getField("p"), acc.getField("ok")
        up = F.struct(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))).alias("p"), (ok & (F.size(p) > 0)).alias("ok"))
        down = F.struct(F.concat(p, F.array(part)).alias("p"), ok.alias("ok"))
        return F.when(part.isin("", "."), acc).when(part == "..", up).otherwise(down)

    return F.aggregate(parts, empty, step, lambda acc: F.when(acc.getField("ok"), acc.getField("p")))


def resolve_href(base: Column, href: Column) -> Column:
    """An href's path seen from a base file; null for external references and paths that leave the root."""
    base_parts = fold_path(F.split(F.replace(base, F.lit("\\"), F.lit("/")), "/"))
    clean = F.regexp_replace(F.trim(href), r"#.*$", "")
    scheme = F.lower(F.regexp_extract(clean, r"^([a-zA-Z][a-zA-Z0-9+.\-]*):", 1))
    external = ~scheme.isin("", "file") | F.regexp_replace(clean, r"^[a-zA-Z]+:", "").startswith("//")
    path = F.regexp_replace(F.regexp_replace(clean, r"^file:", ""), r"\?.*$", "")
    # a plus sign is itself in a path; a percent sign without two hex digits too
    escaped = F.regexp_replace(F.replace(path, F.lit("+"), F.lit("%2B")), r"%(?![0-9A-Fa-f]{2})", "%25")
    path = F.replace(F.try_url_decode(escaped), F.lit("\\"), F.lit("/"))
    parts = F.split(path, "/")
    folder = F.slice(base_parts, 1, F.greatest(F.size(base_parts) - 1, F.lit(0)))
    # a path that begins with the base's own top folder is one from the root
    first = F.get(F.filter(parts, lambda x: ~x.isin("", ".")), F.lit(0))
    from_root = path.startswith("/") | (F.get(base_parts, F.lit(0)) == first)
    target = F.when(path == "", base_parts).when(F.coalesce(from_root, F.lit(False)), fold_path(parts)).otherwise(fold_path(F.concat(folder, parts)))
    return F.when(~external, F.array_join(target, "/"))


def image_refs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(IMAGE), F.lit(1))


def image_only(html: Column) -> Column:
    """The source of a page's one image, if it holds nothing else but wrappers; else null."""
    body = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style|title|desc|metadata|head)\b.*?</\1\s*>", ""), r"(?s)<!--.*?-->|<\?.*?\?>|<!.*?>", "")
    tags = F.transform(F.regexp_extract_all(body, F.lit(TAG), F.lit(1)), lambda t: F.lower(F.regexp_replace(t, r"^.*:", "")))
    plain = F.forall(tags, lambda t: t.isin(*WRAPPERS, *IGNORED))
    text = F.trim(F.regexp_replace(F.regexp_replace(body, r"<[^>]*>", ""), r"\s+", ""))
    refs = image_refs(body)
    return F.when(plain & (text == "") & (F.size(refs) == 1), F.nullif(refs.getItem(0), F.lit("")))


#: Inside a tag: up to its end nothing but attributes follows.
_IN_TAG = r"""(?=(?:[^<>"']|"[^"]*"|'[^']*')*+>)"""
#: A comment, a css url, or an attribute with its value; of a style the urls inside are found instead.
_PIECE = rf"""(?is)<!--.*?-->|\burl\(\s*+(?:"[^"]*"|'[^']*'|[^)"']*+)\s*+\)|(?<![\w:.-])(?!style\s*+=)[\w:.-]++\s*+=\s*+(?:"[^"]*"|'[^']*'|[^\s"'<>]++){_IN_TAG}"""
#: What stands before, in and behind the reference of a piece.
_ATTRIBUTE = r"""(?is)^((?:[\w.-]+:)?(?:src|href)\s*=\s*["']?)(.*?)(["']?)$"""
_URL = r"""(?is)^(url\(\s*["']?)(.*?)(["']?\s*\))$"""
_SET = r"""(?is)^(srcset\s*=\s*["'])(.*)(["'])$"""
#: A candidate of a srcset: white space, its reference, and its descriptor.
_CANDIDATE = r"(?s)^(\s*)(\S*)(.*)$"


def _rewritten(html: Column, swap: Callable[[Column], Column]) -> Column:
    """``html`` with each reference replaced by ``swap`` of it, all at once: what is put in isn't looked at again."""
    group = lambda x, pattern, n: F.regexp_extract(x, pattern, n)
    whole = lambda x, pattern: F.concat(group(x, pattern, 1), swap(group(x, pattern, 2)), group(x, pattern, 3))
    several = lambda x: F.concat(group(x, _SET, 1), F.array_join(F.transform(F.split(group(x, _SET, 2), ","), lambda y: whole(y, _CANDIDATE)), ","), group(x, _SET, 3))
    piece = lambda x: F.when(x.rlike(_ATTRIBUTE), whole(x, _ATTRIBUTE)).when(x.rlike(_URL), whole(x, _URL)).when(x.rlike(_SET), several(x)).otherwise(x)
    between, pieces = F.split(html, _PIECE, -1), F.regexp_extract_all(html, F.lit(_PIECE), F.lit(0))
    return F.array_join(F.flatten(F.zip_with(between, F.transform(pieces, piece), lambda a, b: F.array(a, b))), "")


def page_refs(html: Column) -> Column:
    """The distinct references of a page: of ``src`` and ``href`` (with any prefix), ``srcset`` and css ``url()``, outside comments."""
    pieces = F.regexp_extract_all(html, F.lit(_PIECE), F.lit(0))
    of_set = lambda x: F.transform(F.split(F.regexp_extract(x, _SET, 2), ","), lambda y: F.regexp_extract(y, _CANDIDATE, 2))
    each = F.transform(pieces, lambda x: F.when(x.rlike(_ATTRIBUTE), F.array(F.regexp_extract(x, _ATTRIBUTE, 2))).when(x.rlike(_URL), F.array(F.regexp_extract(x, _URL, 2))).when(x.rlike(_SET), of_set(x)).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.filter(F.flatten(each), lambda x: F.trim(x) != ""))


def relative_href(base: Column, target: Column) -> Column:
    """The path from a base file's folder to a file, both seen from the root, percent-encoded."""
    parts = F.split(base, "/")
    folder, to = F.slice(parts, 1, F.size(parts) - 1), F.split(target, "/")
    apart = F.array_position(F.zip_with(folder, to, lambda a, b: F.coalesce(a == b, F.lit(False))), F.lit(False))
    common = F.least(F.when(apart > 0, apart - 1).otherwise(F.size(folder)), F.size(to) - 1).cast("int")
    path = F.concat(F.array_repeat(F.lit(".."), F.size(folder) - common), F.slice(to, common + 1, F.size(to) - common))
    code = F.url_encode(F.array_join(path, "/"))
    for plain, escaped in (("%20", "+"), ("/", "%2F"), ("~", "%7E"), ("%2A", "*")):
        code = F.replace(code, F.lit(escaped), F.lit(plain))
    return code


def rewrite_refs(pages: DataFrame, mapping: DataFrame, html: str = "html", key: str = "page_id", base: str | None = None, within: tuple[str, ...] = ()) -> DataFrame:
    """Pages with their references replaced as ``mapping(old, new)`` says, all at once: a mapping may swap names.

    A reference is looked up as it stands.  With ``base``, a column with the page's
    own path, it is resolved from there: ``old`` and ``new`` are paths from the
    root, and what is put in is relative to the page again, with the query and
    fragment that were there; references that lead elsewhere stay.  ``within``
    are columns of both tables, as of a book, in which a mapping holds.

    Pages and mapping meet by reference, in a join, so either may be large; a
    page's own pairs come back to it as one map.  Of several new names of an old one
    the least is taken; a null page stays null.
    """
    look_up = list(dict.fromkeys((key, *within)))
    refs = pages.select(*look_up, *([F.col(base).alias("_base")] if base else []), F.explode(page_refs(F.col(html))).alias("_ref")).distinct()
    ref = F.trim("_ref")
    if base:
        relative = (F.regexp_extract(ref, r"^([a-zA-Z][a-zA-Z0-9+.\-]*:|//)", 1) == "") & (F.regexp_extract(ref, r"^([^?#]*)", 1) != "")
        refs = refs.withColumn("old", F.when(relative, resolve_href(F.col("_base"), ref))).filter("old is not null")
    else:
        refs = refs.withColumn("old", ref)
    one = mapping.groupBy(*within, "old").agg(F.min("new").alias("new"))
    met = refs.join(one, [*within, "old"])
    if base:
        met = met.withColumn("new", F.concat(relative_href(F.col("_base"), F.col("new")), F.regexp_extract(ref, r"^[^?#]*(.*)$", 1)))
    padded = F.concat(F.regexp_extract("_ref", r"^(\s*)", 1), "new", F.regexp_extract("_ref", r"(\s*)$", 1))
    found = met.select(*look_up, "_ref", padded.alias("new")).distinct().groupBy(*look_up).agg(F.map_from_entries(F.collect_list(F.struct("_ref", "new"))).alias("_map"))
    swapped = _rewritten(F.col(html), lambda x: F.coalesce(F.col("_map")[x], x))
    return pages.join(found, look_up, "left").withColumn(html, F.when(F.col("_map").isNotNull(), swapped).otherwise(F.col(html))).select(*pages.columns)


def spine_order(manifest: DataFrame, spine: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Spine entries with their hrefs (of one id given twice the last counts), and entries that are missing."""
    hrefs = manifest.groupBy("doc", "id").agg(F.max_by("href", "pos").alias("href"))
    return spine.join(hrefs, ["doc", "id"]), spine.join(hrefs, ["doc", "id"], "left_anti")


def match_replacements(old: DataFrame, new: DataFrame, within: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Old and new files of equal stems, letter case aside; and what is ambiguous either way.

    ``within`` are columns of both tables, as of a folder, in which names are matched.
    """
    o = old.select(*within, F.col("file").alias("old"), F.lower("stem").alias("stem")).dropDuplicates([*within, "old"])
    n = new.select(*within, F.col("file").alias("new"), F.lower("stem").alias("stem"))
    both = o.join(n, [*within, "stem"])
    both = both.withColumn("n_new", F.count("*").over(Window.partitionBy(*within, "old"))).withColumn("n_old", F.count("*").over(Window.partitionBy(*within, "new")))
    return both.filter("n_new = 1 and n_old = 1").select(*within, "old", "new"), both.filter("n_new > 1 or n_old > 1").select(*within, "old", "new")
