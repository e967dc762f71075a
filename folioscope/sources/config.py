"""Pipeline configurations in JSON, read as variants, flattened into typed tables, and their actions as what a pipeline takes.

Fields of more than one type (a volume's number or range of numbers, colour
pages or ``auto``, one page or several) and nested rules don't fit one schema, so
a file is parsed as a variant and each field is taken by its own type.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHAPTERS = "array<struct<number:double,title:string,start:int>>"
SKIPS = "array<struct<step:string,action:string,pages:array<int>>>"
#: The fields of a configuration's volume.
VOLUME_FIELDS = ("path", "number", "title", "year", "oneshot", "spreads", "colors", "meta_naming", "chapters", "extra_text", "revision", "quality", "pub_type", "skip_actions", "metafields")
#: Different lists of actions that one set of configurations may have; each is a plan of its own.
MOST_LISTS = 64


def _configs(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    """``config``, the key of its text, and ``v``; malformed JSON is an error."""
    text = spark.read.text(path, wholetext=multi_line).filter(F.trim("value") != "")
    return text.select(F.xxhash64("value").alias("config"), F.parse_json("value").alias("v"))


def _volumes(configs: DataFrame) -> DataFrame:
    """A row for each volume with the series' fields and its own variant ``x``."""
    series = lambda *names: [F.variant_get("v", f"$.{n}", "string").alias(n) for n in names]
    return configs.select("config", *series("title", "publisher", "credit", "email", "bracket_type", "base_path"), F.to_json(F.variant_get("v", "$.actions", "variant")).alias("actions"), F.posexplode(F.variant_get("v", "$.volumes", "array<variant>")).alias("pos", "x"))


def _own(name: str, kind: str) -> Column:
    return F.variant_get("x", f"$.{name}", kind)


def read_config(spark: SparkSession, path: str, multi_line: bool = True) -> dict[str, DataFrame]:
    """Tables ``volumes``, ``chapters``, ``spreads``, ``meta``, ``colors``, ``skips``, ``actions`` and ``unknown``.

    A file is one configuration, or holds one on each line (without
    ``multi_line``).  Malformed JSON and fields of a wrong type are errors; ``unknown``
    lists fields of volumes that a configuration doesn't have.  ``number_end`` is the end of
    an omnibus; ``actions`` has each action's kind, step name, flat ``params`` and the whole as JSON.
    """
    configs = _configs(spark, path, multi_line)
    volumes = _volumes(configs)
    pair = F.try_variant_get("x", "$.number", "array<double>")
    colors = F.try_variant_get("x", "$.colors", "array<int>")
    pages = F.coalesce(F.try_variant_get("m", "$.page", "array<int>"), F.array(F.try_variant_get("m", "$.page", "int")))
    book = _own("path", "string").alias("book")
    part = lambda name, kind: volumes.select(book, F.posexplode(_own(name, kind)).alias("ord", "p"))
    meta = part("meta_naming", "array<variant>").select("book", F.col("p").alias("m"))
    one = configs.select("config", F.posexplode(F.variant_get("v", "$.actions", "array<variant>")).alias("pos", "a"))
    kind = F.variant_get("a", "$.kind", "string")
    given = F.map_keys(F.variant_get("x", "$", "map<string,variant>"))
    place = F.row_number().over(Window.partitionBy("config", "kind").orderBy("pos"))
    actions = one.select("config", "pos", kind.alias("kind"), F.try_variant_get("a", "$.params", "map<string,string>").alias("params"), F.to_json("a").alias("spec"))
    return {
        "volumes": volumes.select(
            "config", "title", "publisher", "credit", "email", "bracket_type", "base_path", "actions", "pos", book,
            F.coalesce(F.try_variant_get("x", "$.number", "double"), F.least(pair[0], pair[1])).alias("number"), F.when(F.size(pair) > 1, F.greatest(pair[0], pair[1])).alias("number_end"),
            _own("title", "string").alias("volume_title"), _own("year", "int").alias("year"), F.coalesce(_own("oneshot", "boolean"), F.lit(False)).alias("oneshot"),
            _own("extra_text", "string").alias("extra_text"), F.coalesce(_own("revision", "int"), F.lit(1)).alias("revision"), F.when(F.array_contains(given, "quality"), _own("quality", "string")).otherwise("auto").alias("quality"),
            F.coalesce(_own("pub_type", "string"), F.lit("digital")).alias("pub_type"), F.coalesce(F.try_variant_get("x", "$.colors", "string") == "auto", F.lit(False)).alias("auto_colors"),
        ),
        "chapters": part("chapters", CHAPTERS).select("book", "ord", "p.*"),
        "spreads": part("spreads", "array<array<int>>").select("book", "ord", F.col("p").getItem(0).alias("start"), F.get("p", F.lit(1)).alias("end")),
        "meta": meta.select("book", F.explode(pages).alias("page"), F.variant_get("m", "$.tag", "string").alias("tag")),
        "colors": volumes.select(book, F.explode(colors).alias("page")),
        "skips": part("skip_actions", SKIPS).select("book", "p.step", "p.action", F.explode("p.pages").alias("page")),
        "actions": actions.withColumn("step", F.concat_ws("-", "kind", place.cast("string"))),
        "unknown": volumes.select(book, F.explode(given).alias("field")).filter(~F.col("field").isin(*VOLUME_FIELDS)),
    }


def as_parameters(action: dict[str, Any]) -> dict[str, Any]:
    """An action of a configuration under the names that a pipeline's actions use."""
    out = {k: v for k, v in action.items() if k != "params"} | {k: _plain(v) for k, v in (action.get("params") or {}).items()}
    size = out.pop("rescale", None) or {}
    renamed = {"width": "w", "height": "h", "factor": "w", "mode": "mode"} if size else {}
    out |= {renamed[k]: v for k, v in size.items() if k in renamed}
    for old, new in (("spreads_aware", "spreads"), ("upper_limit", "limit"), ("directory", "path"), ("black_level", "black"), ("white_level", "white"), ("contrast_strectch", "contrast_stretch")):
        if old in out:
            out[new] = out.pop(old)
    if out.get("kind") == "posterize" and "bpc" in out:
        bits = out.pop("bpc")
        out |= {} if bits == "auto" else {"bits": bits}
    return out


def _plain(value: Any) -> Any:
    """A parameter given as text, as what it says."""
    try:
        return json.loads(value) if isinstance(value, str) else value
    except ValueError:
        return value


def action_lists(volumes: DataFrame) -> list[tuple[str | None, list[dict[str, Any]]]]:
    """The different lists of actions of ``read_config(...)["volumes"]``, each with its JSON."""
    found = [r["actions"] for r in volumes.select("actions").distinct().limit(MOST_LISTS + 1).collect()]
    if len(found) > MOST_LISTS:
        raise ValueError(f"there are more than {MOST_LISTS} different lists of actions; run their configurations apart")
    return [(x, [as_parameters(a) for a in json.loads(x or "[]") or []]) for x in sorted(found, key=lambda x: x or "")]
