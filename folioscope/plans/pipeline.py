"""A configured list of actions over all volumes, as one lazy plan, its static checks and its dry run."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..operators.catalog import duplicates, resize, route_by_color, suffix, unsorted_starts
from ..operators.pixels import autoposterize, level_decision
from ..operators.ranges import assign_chapters, base_rank, first_range, shift_names
from ..operators.rules import rule
from ..operators.scoring import tile_score
from ..sources.config import action_lists, read_config

Action = Callable[[DataFrame, dict[str, Any]], DataFrame]
Model = Callable[[np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Inputs:
    """What a pipeline reads beside its pages; each is optional.

    ``skips(book, page, step[, action])``, ``meta(book, page, tag)`` and ``colors(book, page)`` are lists of pages;
    ``spreads(book, ord, start, end)`` and ``chapters(book, ord, number, title, start)`` are ranges; ``volumes`` is
    that of a configuration; ``pixels(book, page, y, x, v)`` and ``models`` are for the kinds that score images.
    """

    skips: DataFrame | None = None
    meta: DataFrame | None = None
    colors: DataFrame | None = None
    spreads: DataFrame | None = None
    chapters: DataFrame | None = None
    volumes: DataFrame | None = None
    pixels: DataFrame | None = None
    models: dict[str, Model] = field(default_factory=dict)


@dataclass(frozen=True)
class Outcome:
    """Pages after all steps, and their pixels, where any were given."""

    pages: DataFrame
    pixels: DataFrame | None = None


def _shift_rename(df: DataFrame, p: dict[str, Any]) -> DataFrame:
    out = shift_names(df, p.get("start", 0), p.get("title"), p.get("volume"), p.get("reverse", False), p.get("spreads", False))
    return out.withColumn("name", F.col("new_name")).drop("new_name", "first_page", "span")


def _rename(df: DataFrame, p: dict[str, Any]) -> DataFrame:
    """Full page names from the chapter that a page falls into and its volume; a page before every chapter keeps its name."""
    v, ch = (lambda x: F.col(f"_volume.{x}")), (lambda x: F.col(f"_chapter.{x}"))
    parsed = N.parse_page(F.col("name"))
    number = F.concat_ws("-", N.padded(parsed["a"], 3), N.padded(parsed["b"], 3))
    title = F.coalesce(F.lit(p.get("title")), v("volume_title"), v("title"))
    quality = N.quality_suffix(v("quality"), F.col("height"))
    tag = reduce(lambda x, t: F.when(v("pub_type") == t[0], F.lit(t[1])).otherwise(x), N.PUBLICATIONS, F.lit(None).cast("string"))
    full = N.fmt_page_name(
        title, v("publisher"), ch("number"), ch("title"), number, tag, v("credit"), F.when(~v("oneshot"), v("number")), F.col("_tag"), quality, v("revision"), ch("group_size"), ch("least_part"), ch("rank"),
    )
    return df.withColumn("name", F.coalesce(F.concat(full, F.regexp_extract("name", r"(\.[^.]+)$", 1)), F.col("name")))


def _rescale(df: DataFrame, p: dict[str, Any]) -> DataFrame:
    w, h = resize(F.col("width"), F.col("height"), p["mode"], p.get("w"), p.get("h"))
    return df.withColumn("_w", w).withColumn("height", h).withColumn("width", F.col("_w")).drop("_w")


def _level(df: DataFrame, p: dict[str, Any]) -> DataFrame:
    """By the levels given, or those in columns ``black`` and ``white``; colour pages may be left as they are."""
    black, white = (F.lit(p[c]) if c in p else F.col(c) for c in ("black", "white"))
    status = level_decision(black, white, F.col("is_color"), p.get("limit", 60), p.get("skip_white", False))
    return df.withColumn("status", F.when(F.col("is_color"), "COPIED").otherwise(status) if p.get("skip_color") else status)


def _posterize(df: DataFrame, p: dict[str, Any]) -> DataFrame:
    """To the given bits, or to what the count of shades in ``column`` asks for."""
    if bits := p.get("bits"):
        return df.withColumn("bits", F.lit(bits)).withColumn("status", F.lit("COPIED" if bits >= 8 else "PROCESSED"))
    decided = autoposterize(F.col(p.get("column", "shades")))
    return df.withColumn("bits", decided["bits"]).withColumn("status", decided["status"])


def _regray(df: DataFrame, p: dict[str, Any]) -> DataFrame:
    """Pages without colour whose format can be written anew without loss become gray, the others are copied."""
    gray = route_by_color(F.col("is_color"), F.lit(True), suffix(F.col("name"))) == "regray"
    return df.withColumn("status", F.when(gray, "GRAYSCALED").otherwise("COPIED"))


def _spreads(df: DataFrame, p: dict[str, Any]) -> DataFrame:
    """The first spread that holds the page: of those given (texts like ``4-5``), or else of the volume's own."""
    if "spreads" not in p:
        return df.withColumn("spread", F.col("_spread"))
    inside = [F.when(F.col("page").between(*(int(x) for x in (text.split("-")[0], text.split("-")[-1]))), F.lit(text)) for text in p["spreads"]]
    return df.withColumn("spread", F.coalesce(*inside) if inside else F.lit(None).cast("string"))


def _color_detect(df: DataFrame, p: dict[str, Any]) -> DataFrame:
    """By the volume's list, else by ``column``."""
    return df.withColumn("is_color", F.coalesce(F.col("_listed"), F.col(p["column"]) if "column" in p else F.col("is_color"), F.lit(False)))


def _score(df: DataFrame, p: dict[str, Any]) -> DataFrame:
    """The page's own part of a step that scores its pixels."""
    scale = int(p.get("scale", 1))
    grown = df.withColumns({c: F.col(c) * scale for c in ("width", "height") if c in df.columns and scale != 1})
    return grown.withColumn("status", F.lit("PROCESSED"))


#: Kinds of actions that are column, window or tile work.
ACTIONS: dict[str, Action] = {
    "shift_rename": _shift_rename,
    "rename": _rename,
    "rescale": _rescale,
    "spreads": _spreads,
    "posterize": _posterize,
    "autoposterize": _posterize,
    "regray": _regray,
    "autolevel": _level,
    "level": _level,
    "denoise": _score,
    "upscale": _score,
    "tagging": lambda df, p: df.withColumn("tag", F.lit(p["title"]) if p.get("title") else F.coalesce("_volume.volume_title", "_volume.title")),
    "color_detect": _color_detect,
    "move_color": lambda df, p: df.withColumn("route", route_by_color(F.col("is_color"), F.lit(True), suffix(F.col("name")))),
    "change_cwd": lambda df, p: df,
    "pack": lambda df, p: df.withColumn("archive", F.concat(F.lit(p["prefix"]), F.col("book").cast("string"), F.lit(".cbz")) if "prefix" in p else F.col("_volume.archive")),
}
#: The folder that a kind writes to, where its action names none.
FOLDERS = {"autolevel": "leveled", "level": "leveled", "posterize": "posterized", "rescale": "rescaled", "denoise": "output", "upscale": "output"}


def _archive_name() -> Column:
    """A volume's archive, from its own columns: once for a volume, not for each page."""
    v = F.col
    tag = reduce(lambda x, t: F.when(v("pub_type") == t[0], F.lit(t[2])).otherwise(x), N.PUBLICATIONS, F.lit(None).cast("string"))
    volume = F.when(~v("oneshot"), N.fmt_volume_text(v("number"), v("number_end")))
    make = lambda bracket: N.fmt_archive_name(F.coalesce(v("volume_title"), v("title")), v("year"), tag, v("credit"), volume, v("extra_text"), v("revision"), bracket)
    bracket = F.coalesce(F.lower(v("bracket_type")), F.lit("round"))
    return F.concat(F.when(bracket == "square", make("square")).when(bracket == "curly", make("curly")).otherwise(make("round")), F.lit(".cbz"))


def steps_of(actions: Sequence[dict[str, Any]]) -> list[tuple[str, dict[str, Any]]]:
    seen: dict[str, int] = {}
    out = []
    for a in actions:
        seen[a["kind"]] = seen.get(a["kind"], 0) + 1
        out.append((f"{a['kind']}-{seen[a['kind']]}", a))
    return out


def folder_after(folder: str | None, action: dict[str, Any]) -> str | None:
    """Where the pages are after an action: in a folder of its own, named by it or by its kind, or where they were."""
    if action["kind"] == "change_cwd":
        return action["path"]
    return action.get("base_path", FOLDERS[action["kind"]]) if action["kind"] in FOLDERS else folder


def _page_lists(inputs: Inputs) -> DataFrame | None:
    """All lists of pages as one table, a row for each page: its skip lists' steps, its tag, whether it is listed as coloured."""
    none = F.lit(None).cast("string")
    parts = []
    if inputs.skips is not None:
        action = F.col("action") if "action" in inputs.skips.columns else none
        parts.append(inputs.skips.select("book", "page", F.struct(F.col("step").alias("step"), action.alias("action")).alias("skip"), none.alias("tag"), F.lit(False).alias("listed")))
    skip = F.lit(None).cast("struct<step:string,action:string>")
    if inputs.meta is not None:
        parts.append(inputs.meta.select("book", "page", skip.alias("skip"), "tag", F.lit(False).alias("listed")))
    if inputs.colors is not None:
        parts.append(inputs.colors.select("book", "page", skip.alias("skip"), none.alias("tag"), F.lit(True).alias("listed")))
    if not parts:
        return None
    both = reduce(DataFrame.unionByName, parts)
    return both.groupBy("book", "page").agg(F.sort_array(F.collect_set("skip")).alias("_skips"), F.max("tag").alias("_tag"), F.bool_or("listed").alias("_in_colors"))


def _with_inputs(pages: DataFrame, kinds: set[str], inputs: Inputs) -> DataFrame:
    """Pages with what the given kinds of actions read of the inputs, each joined once for all of them."""
    df = pages
    lists = _page_lists(inputs)
    if lists is not None:
        df = df.join(lists, ["book", "page"], "left")
    else:
        df = df.withColumns({"_skips": F.lit(None).cast("array<struct<step:string,action:string>>"), "_tag": F.lit(None).cast("string"), "_in_colors": F.lit(None).cast("boolean")})
    # a page that no list names is judged otherwise
    df = df.withColumn("_listed", F.when(F.col("_in_colors"), True)).drop("_in_colors")
    if kinds & {"rename", "pack", "tagging"} and inputs.volumes is not None:
        volumes = inputs.volumes.withColumn("archive", _archive_name()) if "archive" in kinds else inputs.volumes
        fields = [c for c in volumes.columns if c not in ("book", "config", "actions", "pos")]
        df = df.join(volumes.select("book", F.struct(*fields).alias("_volume")).dropDuplicates(["book"]), "book", "left")
    if "rename" in kinds:
        if inputs.chapters is None or inputs.volumes is None:
            raise ValueError("renaming needs chapters and volumes")
        columns = ("number", "title", "group_size", "least_part", "rank")
        ranked = base_rank(inputs.chapters).select("book", "start", *columns)
        packed = assign_chapters(df, ranked.select("book", "start", F.struct(*columns).alias("_chapter")), ("_chapter",))
        df = packed.drop("chapter_start")
    if "spreads" in kinds and inputs.spreads is not None:
        ranges = inputs.spreads.select("book", "ord", "start", "end")
        hits = first_range(pages.select("book", "page").distinct(), ranges)
        text = F.concat_ws("-", "start", F.coalesce("end", "start"))
        hits = hits.join(ranges.select("book", "ord", text.alias("_spread")), ["book", "ord"]).select("book", "page", "_spread")
        df = df.join(hits, ["book", "page"], "left")
    elif "spreads" in kinds:
        df = df.withColumn("_spread", F.lit(None).cast("string"))
    return df


def run(pages: DataFrame, actions: Sequence[dict[str, Any]], inputs: Inputs = Inputs()) -> Outcome:
    """All actions over all books as one plan.

    A page on a step's skip list, or that fails an action's ``conditions``, passes
    that step unchanged; ``history`` says what each step did with it.  Lists and
    ranges meet the pages once, however many actions read them.  Kinds that score
    images run on the pixels of the pages they apply to, in tiles.
    """
    steps = steps_of(actions)
    if wrong := [a["kind"] for _, a in steps if a["kind"] not in ACTIONS]:
        raise ValueError(f"no such action: {wrong[0]}")
    # a pack without a prefix names archives by their volumes
    kinds = {a["kind"] for _, a in steps} | {"archive" for _, a in steps if a["kind"] == "pack" and "prefix" not in a}
    df = _with_inputs(pages.withColumn("cwd", F.col("book").cast("string")).withColumn("history", F.array().cast("array<string>")), kinds, inputs)
    if "is_color" not in df.columns and inputs.colors is not None:
        df = df.withColumn("is_color", F.coalesce("_listed", F.lit(False)))
    pixels, folder = inputs.pixels, None
    for step, action in steps:
        skip = F.get(F.filter("_skips", lambda x: x.step == step), F.lit(0))
        apply = F.coalesce(~F.exists("_skips", lambda x: x.step == step), F.lit(True))
        if conditions := action.get("conditions"):
            apply = apply & rule(conditions, df.columns)
        before = df.columns
        df = df.withColumn("_do", apply).withColumn("_why", F.coalesce(skip.action, F.lit("ignore"))).withColumns({f"_old_{c}": F.col(c) for c in before if not c.startswith("_")})
        done = ACTIONS[action["kind"]](df, action)
        after = [c for c in done.columns if c not in ("_do", "_why") and not c.startswith("_old_")]
        kept = lambda c: F.when(F.col("_do"), F.col(c)).otherwise(F.col(f"_old_{c}")) if c in before else F.when(F.col("_do"), F.col(c))
        merged = {c: F.col(c) if c.startswith("_") else kept(c) for c in after}  # noqa: B023
        said = F.when(F.col("_do"), "done").when(F.col("_why") == "copy", "copied").when(F.col("_why") == "move", "moved").otherwise("ignored")
        merged["history"] = F.concat("history", F.array(F.concat(F.lit(f"{step}:"), said)))
        folder = folder_after(folder, action)
        # the folder is the volume's, whatever becomes of a page
        merged["cwd"] = F.concat_ws("/", F.lit(folder).cast("string"), F.col("book").cast("string"))
        if action["kind"] in ("denoise", "upscale") and pixels is not None:
            pixels = _score_pixels(pixels, df.filter("_do").select("book", "page"), action, inputs.models)
        df = done.select(*(x.alias(c) for c, x in merged.items()))
    return Outcome(df.drop(*(c for c in df.columns if c.startswith("_") and c not in pages.columns)), pixels)


def _score_pixels(pixels: DataFrame, wanted: DataFrame, p: dict[str, Any], models: dict[str, Model]) -> DataFrame:
    """Pixels of the wanted pages through a model, tile by tile; the others as they are."""
    if p.get("model") not in models:
        raise ValueError(f"no such model: {p.get('model')}")
    marked = pixels.join(wanted.distinct().withColumn("_wanted", F.lit(True)), ["book", "page"], "left")
    own = marked.filter("_wanted").drop("_wanted")
    scored = tile_score(own, int(p.get("tile_size", 128)), int(p.get("tile_overlap", 0)), models[p["model"]], keys=("book", "page"), scale=int(p.get("scale", 1)), padding=255 if p.get("background") == "white" else 0)
    rest = marked.filter("_wanted is null").drop("_wanted")
    return rest.select("book", "page", "y", "x", "v").unionByName(scored.select("book", "page", "y", "x", F.col("out").cast(pixels.schema["v"].dataType).alias("v")))


def run_pipeline(pages: DataFrame, actions: Sequence[dict[str, Any]], skips: DataFrame | None = None, **inputs: Any) -> DataFrame:
    """The pages of :func:`run`."""
    return run(pages, actions, Inputs(skips=skips, **inputs)).pages


def run_config(spark: SparkSession, path: str, pages: DataFrame, multi_line: bool = True, pixels: DataFrame | None = None, models: dict[str, Model] | None = None) -> Outcome:
    """Run the configurations under a path over the pages of their volumes (``book`` is a volume's path).

    Volumes with the same list of actions share a plan; pages of no volume are left out.
    """
    t = read_config(spark, path, multi_line)
    found = []
    for text, actions in action_lists(t["volumes"]):
        own = t["volumes"].filter(F.col("actions").eqNullSafe(F.lit(text)))
        listed = t["colors"] if any(a["kind"] in ("color_detect", "move_color", "regray", "level", "autolevel") for a in actions) and "is_color" not in pages.columns else None
        mine = lambda df: df.join(own.select("book").distinct(), "book", "left_semi")  # noqa: E731, B023
        inputs = Inputs(skips=t["skips"], meta=t["meta"], colors=listed, spreads=t["spreads"], chapters=t["chapters"], volumes=own, pixels=mine(pixels) if pixels is not None else None, models=models or {})
        found.append(run(mine(pages), actions, inputs))
    if not found:
        raise ValueError(f"no volumes in {path}")
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (x.pages for x in found))
    return Outcome(rows, reduce(DataFrame.unionByName, (x.pixels for x in found)) if pixels is not None else None)


def dry_run(pages: DataFrame, actions: Sequence[dict[str, Any]], inputs: Inputs = Inputs()) -> DataFrame:
    """``volume, place, step, kind, cwd, pages_in, pages_done``: what each step would meet and do in each volume.

    Counted on what conditions and skip lists say; names, windows and pixels that no
    condition asks for are pruned from the plan.
    """
    steps = steps_of(actions)
    history = run(pages, actions, inputs).pages.select("book", "history")
    done = [F.count_if(F.get("history", F.lit(k)) == f"{step}:done").alias(f"d{k}") for k, (step, _) in enumerate(steps)]
    counts = history.groupBy("book").agg(F.count("*").alias("pages_in"), *done)
    folder, rows = None, []
    for k, (step, action) in enumerate(steps):
        folder = folder_after(folder, action)
        cwd = F.concat_ws("/", F.lit(folder).cast("string"), F.col("book").cast("string"))
        rows.append(F.struct(F.lit(k).alias("place"), F.lit(step).alias("step"), F.lit(action["kind"]).alias("kind"), cwd.alias("cwd"), F.col("pages_in").alias("pages_in"), F.col(f"d{k}").alias("pages_done")))
    return counts.select(F.col("book").alias("volume"), F.inline(F.array(*rows)))


def violations(chapters: DataFrame, volumes: DataFrame, steps: DataFrame, skips: DataFrame) -> DataFrame:
    """``check, book, detail`` of everything wrong with a configuration."""

    def found(name: str, df: DataFrame, book: Any, detail: Any) -> DataFrame:
        return df.select(F.lit(name).alias("check"), book.cast("string").alias("book"), detail.cast("string").alias("detail"))

    out = [
        found("duplicate_chapter", duplicates(chapters, ["book", "number"]), F.col("book"), F.col("number")),
        found("duplicate_start", duplicates(chapters, ["book", "start"]), F.col("book"), F.col("start")),
        found("unsorted_start", unsorted_starts(chapters), F.col("book"), F.col("start")),
        found("duplicate_path", duplicates(volumes, ["path"]), F.lit(None), F.col("path")),
        found("unknown_step", skips.join(steps.select("step"), "step", "left_anti"), F.col("book"), F.col("step")),
        found("unknown_action", steps.filter(~F.col("kind").isin(*ACTIONS)), F.lit(None), F.col("kind")),
    ]
    return reduce(DataFrame.unionByName, out)


def config_violations(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """The same for configurations in files, with fields they may not have, missing names and numbers, empty ranges of numbers, and pages tagged twice."""
    t = read_config(spark, path, multi_line)
    volumes = t["volumes"].withColumn("path", F.col("book"))
    rows = violations(t["chapters"], volumes, t["actions"], t["skips"])
    more = {
        "unknown_field": t["unknown"].select("book", F.col("field").alias("detail")),
        "missing_number": volumes.filter("number is null").select("book", F.lit("number").alias("detail")),
        "missing_path": volumes.filter("book is null").select("book", F.col("pos").cast("string").alias("detail")),
        "omnibus_range": volumes.filter("number = number_end").select("book", F.col("number").cast("string").alias("detail")),
        "duplicate_tag": duplicates(t["meta"], ["book", "page"]).select("book", F.col("page").cast("string").alias("detail")),
        "unknown_publication": volumes.filter(~F.col("pub_type").isin(*(x[0] for x in N.PUBLICATIONS))).select("book", F.col("pub_type").alias("detail")),
    }
    return reduce(DataFrame.unionByName, (df.select(F.lit(k).alias("check"), "book", "detail") for k, df in more.items()), rows)


def status_report(pages: DataFrame) -> DataFrame:
    """Pages by book and status, in the order of statuses."""
    return pages.groupBy("book", "status").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("book")))
