"""Page, chapter, volume and release names as column expressions, both ways.

A chapter or volume number is a double; a whole one is written as an integer,
another one with the digits after its point (``13.5``: base 13, part 5).
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Publication key, tag in page names, tag in release names, description.
PUBLICATIONS = (
    ("digital", "dig", "Digital", "Digital release"),
    ("magazine", "mag", "c2c", "Magazine release"),
    ("scan", "c2c", "c2c", "Scanned release"),
    ("web", "web", "Digital", "Web release without volumes"),
    ("digital-raw", "raw-d", "Digital", "Digital raw release"),
    ("magazine-raw", "raw-m", "c2c", "Magazine raw release"),
    ("mix", "mix", "Digital", "Mixed release"),
    ("none", "", "Digital", "No tag in page names"),
)
#: Publication tags that a titled page name may hold.
PAGE_TAGS = ("dig", "web", "c2c", "mag", "scan", "paper", "raw", "raw-d", "raw-dig", "raw-digital", "raw-m", "raw-mag", "raw-magazine")
#: Brackets around the credit of a release name.
BRACKETS = {"square": ("[", "]"), "round": ("(", ")"), "curly": ("{", "}")}
#: Words of a book without volumes.
ONESHOT = ("na", "oshot", "oneshot", "one-shot", "one shot")
#: Characters that file names can't hold, and what stands for them.
UNSAFE, SAFE = '/:<>"\\?*|#', "／：＜＞”＼？⋆｜"
RESTORE_FROM, RESTORE_TO = "：＜＞”“’‘＼？⋆｜", ":<>\"\"''\\?*|"
#: Ranges of emoji.
EMOJI = r"[\x{1F1E0}-\x{1F1FF}\x{1F300}-\x{1F5FF}\x{1F600}-\x{1F64F}\x{1F680}-\x{1F6FF}\x{1F700}-\x{1F77F}\x{1F780}-\x{1F7FF}\x{1F800}-\x{1F8FF}\x{1F900}-\x{1F9FF}\x{1FA00}-\x{1FA6F}\x{1FA70}-\x{1FAFF}\x{2702}-\x{27B0}]"

#: The grammar of page names, which decides what names are taken apart and how; by its parts.
_PAGES = "p([0-9]{1,3})-?([0-9]{1,3})?"
PAGE = rf"(?d)^(.*){_PAGES}(.*)"
_COMIX_VOLUME, _COMIX_PART = r"(?:- (v[0-9]{1,3}))?", r"(\.[0-9]{1,2})?"
COMIX = rf"^([\s\S]+?){_COMIX_VOLUME}{_COMIX_PART} - {_PAGES}"
_NUMBER, _PART = "([0-9]+)", "([#x.][0-9]{1,2})?"
_ACTUAL = r"\(?c?([0-9]{1,4}\.[0-9]{1,4})?\)?"
_VOLUME = r"\(?(v[0-9]+([#x][0-9]{1,3})?|[A-Za-z\-]+)?\)?"
_TAIL = "p[0-9]+x?[0-9]?-?[0-9]+x?[0-9]?.*"
_CHAPTER = f" - c{_NUMBER}{_PART} {_ACTUAL} ?{_VOLUME} ?- {_TAIL}"


def _quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9 ])", r"\\\1", text)


def group(name: Column, pattern: str, k: int) -> Column:
    """A group of a match, or null where it took no part."""
    return F.nullif(F.regexp_extract(name, pattern, k), F.lit(""))


def parse_page(name: Column) -> dict[str, Column]:
    """First and last page of a name, by its last ``p`` with digits."""
    return {"before": F.regexp_extract(name, PAGE, 1), "a": group(name, PAGE, 2).cast("int"), "b": group(name, PAGE, 3).cast("int"), "after": F.regexp_extract(name, PAGE, 4)}


def parse_comix(name: Column) -> dict[str, Column]:
    return {"t": group(name, COMIX, 1), "vol": group(name, COMIX, 2), "volex": group(name, COMIX, 3), "a": group(name, COMIX, 4).cast("int"), "b": group(name, COMIX, 5).cast("int")}


def volume_pattern(title: str, credit: str | None = None) -> str:
    return rf"(?d)^{title} v([0-9]+\.?[0-9]{{1,2}}?).*" + (rf"[\[\(]{credit}.*" if credit else "")


def parse_volume(name: Column, title: str, credit: str | None = None) -> Column:
    """The volume text of a release name of ``title``, or null."""
    return group(name, volume_pattern(_quoted(title), credit), 1)


def chapter_pattern(title: str, publisher: str | None = None) -> str:
    if publisher is None:
        return rf"(?d)^{title}{_CHAPTER}"
    tags = "|".join(_quoted(t) for t in PAGE_TAGS)
    return rf"(?d)^{title}{_CHAPTER} \[(?:{tags})\] (?:\[(.*)\] )?\[{publisher}.*"


def parse_chapter(name: Column, title: str, publisher: str | None = None) -> dict[str, Column]:
    """Parts of a page name; ``title`` and ``publisher`` are patterns (quote plain text first)."""
    pattern = chapter_pattern(title, publisher)
    out = {k: group(name, pattern, i) for i, k in enumerate(("ch", "ex", "actual", "vol", "volex"), 1)}
    out["title"] = group(name, pattern, 6) if publisher is not None else F.lit(None).cast("string")
    return out


def is_whole(number: Column) -> Column:
    return number == F.floor(number)


def base_of(number: Column) -> Column:
    return F.split_part(number.cast("string"), F.lit("."), F.lit(1)).cast("int")


def part_of(number: Column) -> Column:
    """Digits after the point, as a number; null for a whole number."""
    return F.when(~is_whole(number), F.split_part(number.cast("string"), F.lit("."), F.lit(2)).cast("int"))


def padded(number: Column, digits: int) -> Column:
    return F.when(number.isNotNull(), F.format_string(f"%0{digits}d", number.cast("long")))


def fmt_number(number: Column, digits: int = 3, minus: bool = True, sep: str = "x") -> Column:
    """``013`` or ``013x1``: a split chapter's part counts from 5 on as 1 (with ``minus``)."""
    part = part_of(number)
    shown = F.when(part >= 5, part - 4).otherwise(part) if minus else part
    return F.when(is_whole(number), padded(number, digits)).otherwise(F.concat(padded(base_of(number), digits), F.lit(sep), shown.cast("string")))


def fmt_volume_text(start: Column | None = None, end: Column | None = None, chapter: Column | None = None) -> Column:
    """``v01``, ``v01-02``, or a chapter's text; the volume wins."""
    none = F.lit(None).cast("double")
    start, end, chapter = (none if x is None else x for x in (start, end, chapter))
    volume = F.concat(F.lit("v"), fmt_number(start, 2, False, "."), F.coalesce(F.concat(F.lit("-"), fmt_number(end, 2, False, ".")), F.lit("")))
    return F.coalesce(volume, fmt_number(chapter, 3, True, "x"))


def fmt_archive_name(title: Column, year: Column, archive_tag: Column, credit: Column, volume: Column, extra: Column, revision: Column, bracket: str = "square") -> Column:
    left, right = BRACKETS.get(bracket.lower(), BRACKETS["square"])
    return F.concat(
        title, F.coalesce(F.concat(F.lit(" "), volume), F.lit("")), F.lit(" ("), year.cast("string"), F.lit(") "),
        F.coalesce(F.concat(F.lit("("), F.trim(extra), F.lit(") ")), F.lit("")), F.lit("("), archive_tag, F.lit(f") {left}"), credit, F.lit(right),
        F.when(revision > 1, F.concat(F.lit(" (v"), revision.cast("string"), F.lit(")"))).otherwise(F.lit("")),
    )


def fmt_page_name(title: Column, publisher: Column, number: Column, chapter_name: Column, page: Column, image_tag: Column, credit: Column, volume: Column, extra: Column, quality: Column, revision: Column, group_size: Column, least_part: Column, rank: Column) -> Column:
    """A page's full name.

    ``group_size``, ``least_part`` and ``rank`` describe the chapters of one base
    number: how many there are, their least part, and this one's place (from 1).
    Without groups give 1, null and 1.
    """
    return page_of_chapter(title, publisher, chapter_text(number, volume, group_size, least_part, rank), chapter_name, page, image_tag, credit, extra, quality, revision)


def chapter_text(number: Column, volume: Column, group_size: Column, least_part: Column, rank: Column) -> Column:
    """What the names of a chapter's pages share, `` - c013x1 (c013.5) (v01) - p``: worked out once for a chapter, it needn't be for each page."""
    part, base = part_of(number), padded(base_of(number), 3)
    split = F.when(group_size > 1, least_part >= 5).otherwise(part >= 5)
    place = F.when(group_size > 1, rank).otherwise(F.lit(1))
    number_text = F.concat(base, F.when(part.isNull(), "").when(split, F.concat(F.lit("x"), (part - 4).cast("string"))).otherwise(F.concat(F.lit("x"), place.cast("string"))))
    shown = F.when(part.isNull() | split, "").otherwise(F.concat(F.lit(" (c"), base, F.lit("."), part.cast("string"), F.lit(")")))
    return F.concat(F.lit(" - c"), number_text, shown, F.lit(" ("), F.coalesce(F.concat(F.lit("v"), fmt_number(volume, 2)), F.lit("OShot")), F.lit(") - p"))


def page_of_chapter(title: Column, publisher: Column, chapter: Column, chapter_name: Column, page: Column, image_tag: Column, credit: Column, extra: Column, quality: Column, revision: Column) -> Column:
    """A page's full name, ``chapter`` from :func:`chapter_text`."""
    has_tag, has_extra = F.coalesce(image_tag, F.lit("")) != "", extra.isNotNull()
    middle = F.when(has_extra, F.concat(F.lit(" ["), extra, F.lit("]"))).when(has_tag, " ").otherwise("")
    tag = F.when(has_tag, F.concat(F.when(has_extra, " ").otherwise(""), F.lit("["), image_tag, F.lit("]"))).otherwise("")
    return F.concat(
        title, chapter, page, middle, tag,
        F.coalesce(F.concat(F.lit(" ["), chapter_name, F.lit("]")), F.lit("")), F.lit(" ["), F.coalesce(F.nullif(publisher, F.lit("")), F.lit("Unknown Publisher")), F.lit("] ["), credit, F.lit("]"),
        F.coalesce(F.concat(F.lit(" {"), quality, F.lit("}")), F.lit("")), F.when(revision > 1, F.concat(F.lit(" {r"), revision.cast("string"), F.lit("}"))).otherwise(""),
    )


def is_oneshot(text: Column) -> Column:
    return F.lower(text).isin(*ONESHOT)


def is_not_volume(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(r"^v[0-9]+$") == F.lit(False)


def clean_title(title: Column) -> Column:
    return F.regexp_replace(title, r"\]$", "")


def actual_or(actual: Column, chapter: Column) -> Column:
    """A chapter's own number as text (``012`` or ``012.3``), or its number in the name."""
    dotted = actual.contains(".")
    value = F.try_to_number(actual, F.lit("9999.9999")).cast("double")
    own = F.when(dotted, F.concat(padded(base_of(value), 3), F.lit("."), F.split_part(value.cast("string"), F.lit("."), F.lit(2)))).otherwise(padded(actual.try_cast("int"), 3))
    return F.coalesce(F.when(actual != "", own), padded(chapter.cast("int"), 3))


def chapter_key(parts: dict[str, Column], has_publisher: bool = False) -> Column:
    """The key that pages of one chapter share, from :func:`parse_chapter`."""
    vol, volex, ex, title = parts["vol"], parts["volex"], parts["ex"], parts["title"]
    extra = F.substring(ex, 2, 9).cast("int")
    digits = F.regexp_extract(vol, r"^v([0-9]+)", 1).cast("int")
    volume = (
        F.when(vol.isNull(), "")
        .when(volex.isNull() & is_not_volume(vol), "00.")
        .otherwise(F.concat(padded(digits, 2), F.lit("."), F.when(volex.isNotNull(), F.concat((F.substring(volex, 2, 9).cast("int") + 4).cast("string"), F.lit("."))).otherwise("")))
    )
    added = F.when(ex.isNotNull() & parts["actual"].isNull(), F.concat(F.lit("."), (extra + F.when(ex.contains("."), 0).otherwise(4)).cast("string"))).otherwise("")
    named = F.concat(F.lit(" - "), clean_title(title))
    alone = F.when(title.isNull() & ex.isNotNull() & F.lit(has_publisher), F.concat(F.lit(" - Extra "), extra.cast("string"))).otherwise("")
    return F.concat(volume, actual_or(parts["actual"], parts["ch"]), added, F.coalesce(named, alone))


def volume_value(vol: Column, volex: Column, default: Column) -> Column:
    """A volume's number from its texts; null for a book without volumes, ``default`` where nothing was found."""
    number = F.concat(F.regexp_extract(vol, r"([0-9]+)", 1), F.coalesce(F.regexp_replace(volex, r"^[^0-9]", "."), F.lit(""))).try_cast("double")
    return F.when(is_oneshot(vol), F.lit(None).cast("double")).otherwise(F.coalesce(number, default))


def extract_page(name: Column, rewrite: str | None = None, custom: dict[str, int] | None = None) -> Column:
    """First page of a name's stem: by a custom map of substrings (first hit), else ``a-b``, ``a~b`` or ``a``."""
    text = F.regexp_replace(name, rewrite, "$1-$2") if rewrite else name
    text = F.regexp_replace(text, r"-+$", "")
    found = F.coalesce(F.regexp_extract(text, r"^([0-9]+)[-~][0-9]+$", 1).try_cast("int"), text.try_cast("int"))
    for key, page in reversed(list((custom or {}).items())):
        found = F.when(name.contains(key), F.lit(page)).otherwise(found)
    return found


def parse_range(text: Column) -> dict[str, Column]:
    """``x-y``: all pages of it; ``x``: that page on, an open range.  Null where it is no range."""
    pieces = F.split(F.trim(text), "-")
    first, second = pieces.getItem(0).try_cast("int"), F.get(pieces, F.lit(1)).try_cast("int")
    single, pair = F.size(pieces) == 1, F.size(pieces) == 2
    pages = F.when(single & first.isNotNull(), F.array(first)).when(pair & (first <= second), F.sequence(first, second)).when(pair & (first > second), F.array().cast("array<int>"))
    return {"pages": pages, "is_single": F.when(single & first.isNotNull(), True).when(pair & first.isNotNull() & second.isNotNull(), False)}


def parse_volume_arg(text: Column) -> dict[str, Column]:
    """``1``, ``1.5`` or ``1-2`` as start and end; reversed ends are swapped."""
    pieces = F.split(F.trim(text), "-")
    first, second = pieces.getItem(0).try_cast("double"), F.get(pieces, F.lit(1)).try_cast("double")
    return {"start": F.when(second.isNotNull(), F.least(first, second)).otherwise(first), "end": F.when(second.isNotNull() & (first != second), F.greatest(first, second))}


def parse_box(text: Column) -> Column:
    """One to four numbers, by spaces or slashes, as top, right, bottom, left."""
    n = F.filter(F.split(F.trim(text), r"[\s/]+"), lambda x: x != "")
    v = F.transform(n, lambda x: x.try_cast("double"))
    pick = lambda *at: F.struct(*(v.getItem(k).alias(x) for k, x in zip(at, ("top", "right", "bottom", "left"))))
    return F.when(F.exists(v, lambda x: x.isNull()), None).when(F.size(v) == 1, pick(0, 0, 0, 0)).when(F.size(v) == 2, pick(0, 1, 0, 1)).when(F.size(v) == 3, pick(0, 1, 2, 1)).when(F.size(v) == 4, pick(0, 1, 2, 3))


def quality_suffix(quality: Column, height: Column, low: int = 1500, high: int = 2000) -> Column:
    return F.when(F.lower(quality).isin("auto", "mixed"), F.when(height >= high, "HQ").when(height <= low, "LQ")).otherwise(quality)


def secure_name(name: Column) -> Column:
    return F.regexp_replace(F.translate(name, UNSAFE, SAFE), EMOJI, "_")


def unsecure_name(name: Column) -> Column:
    return F.translate(name, RESTORE_FROM, RESTORE_TO)


def fmt_elapsed(seconds: Column) -> Column:
    """``1d2h3m4s`` without zero parts; null where negative."""
    s = seconds.cast("long")
    parts = [(F.floor(s / 86400), "d"), (F.floor(s % 86400 / 3600), "h"), (F.floor(s % 3600 / 60), "m")]
    text = [F.when(n > 0, F.concat(n.cast("string"), F.lit(u))).otherwise("") for n, u in parts]
    last = F.when((s % 60 > 0) | (s < 60) & (s % 60 == s) & (s == 0), F.concat((s % 60).cast("string"), F.lit("s"))).otherwise("")
    return F.when(s >= 0, F.concat(*text, last))


def fmt_template(template: Column, values: dict[str, Column]) -> Column:
    """``{key}`` replaced for known keys; others, and null values, stay as they are."""
    for key, value in values.items():
        template = F.coalesce(F.replace(template, F.lit(f"{{{key}}}"), value), template)
    return template


def volume_display(start: Column, end: Column) -> dict[str, Column]:
    text = lambda x: F.when(is_whole(x), x.cast("long").cast("string")).otherwise(x.cast("string"))
    return {"omnibus": end.isNotNull(), "first": start, "shown": F.concat(text(start), F.coalesce(F.concat(F.lit("-"), text(end)), F.lit("")))}


def range_display(start: Column, end: Column) -> Column:
    return F.concat(padded(start, 3), F.lit("-"), F.coalesce(padded(end, 3), F.lit("end")))


def tag_map(title: Column, email: Column) -> Column:
    """The seven metadata tags of an image."""
    pairs = [("XPComment", email), ("Artist", email), ("XPAuthor", email), ("XPTitle", title), ("ImageDescription", title), ("Title", title), ("Description", title)]
    return F.create_map(*(x for k, v in pairs for x in (F.lit(k), v)))


def fix_text_name(name: Column) -> Column:
    """A name whose UTF-8 bytes were read as code page 437, repaired; any other name as it is."""
    high = bytes(range(128, 256))
    page, latin = high.decode("cp437"), high.decode("latin-1")
    readable = F.translate(name, page, "").rlike(r"^[\x00-\x7F]*$")
    raw = F.encode(F.translate(name, page, latin), "iso-8859-1").cast("string")
    return F.when(readable & F.is_valid_utf8(raw), raw).otherwise(name)
