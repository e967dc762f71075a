"""Configurations of every kind of field, run over pages and pixels; one join for all lists; dry runs and guards."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.operators import scoring
from folioscope.plans import pipeline
from folioscope.sources.config import action_lists, as_parameters, read_config

CONFIG = {
    "title": "Series", "publisher": "P", "credit": "crd", "email": "e", "bracket_type": "square", "base_path": "in", "more": {"ignored": 1},
    "volumes": [
        {"path": "v01", "number": 1, "year": 2020, "chapters": [{"number": 1, "start": 0, "title": "One"}, {"number": 2.5, "start": 3}], "spreads": [[1, 2]], "colors": [0], "meta_naming": [{"tag": "Cover", "page": 0}, {"tag": "Ad", "page": [2, 4]}], "skip_actions": [{"step": "denoise-1", "action": "copy", "pages": [1]}, {"step": "rescale-1", "action": "move", "pages": [2, 3]}, {"step": "tagging-1", "action": "ignore", "pages": [0]}]},
        {"path": "v02", "number": [4, 3], "title": "Other", "year": 2021, "oneshot": False, "colors": "auto", "chapters": [{"number": 3, "start": 0}], "revision": 2, "quality": None, "pub_type": "scan", "extra_text": "Omnibus"},
    ],
    "actions": [
        {"kind": "denoise", "model": "m", "tile_size": 64, "tile_overlap": 4, "kernel": "x"},
        {"kind": "rescale", "rescale": {"mode": "multiply", "factor": 2}, "conditions": {"op": "or", "rules": [{"op": "condition", "field": "height", "operator": ">", "value": 10}, {"op": "not", "rule": {"op": "condition", "field": "page", "operator": "in", "value": [0, 5]}}]}},
        {"kind": "rename"}, {"kind": "tagging", "title": "T"}, {"kind": "spreads"}, {"kind": "pack"},
    ],
}


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    at = tmp_path_factory.mktemp("config") / "c.json"
    at.write_text(json.dumps(CONFIG, indent=2))
    return str(at)


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(b, p, f"Series - v{b[1:]} - p{p:03d}.png", 8, 12 if p == 1 else 10) for b in ("v01", "v02", "v09") for p in range(6)]
    return spark.createDataFrame(rows, "book string, page int, name string, width int, height int")


@pytest.fixture(scope="module")
def pixels(spark):
    rows = [(b, p, y, x, (37 * p + 11 * y + 5 * x) % 256) for b in ("v01", "v02") for p in range(3) for y in range(10) for x in range(8)]
    return spark.createDataFrame(rows, "book string, page int, y int, x int, v int")


def test_fields_of_several_types(spark, path):
    t = read_config(spark, path)
    v = {r["book"]: r for r in t["volumes"].collect()}
    assert (v["v01"]["number"], v["v01"]["number_end"], v["v02"]["number"], v["v02"]["number_end"]) == (1.0, None, 3.0, 4.0)
    assert (v["v01"]["auto_colors"], v["v02"]["auto_colors"]) == (False, True) and v["v01"]["quality"] == "auto" and v["v02"]["revision"] == 2
    assert {(r["page"], r["tag"]) for r in t["meta"].collect()} == {(0, "Cover"), (2, "Ad"), (4, "Ad")}
    assert [tuple(r) for r in t["colors"].collect()] == [("v01", 0)]
    assert sorted((r["step"], r["action"], r["page"]) for r in t["skips"].collect()) == [("denoise-1", "copy", 1), ("rescale-1", "move", 2), ("rescale-1", "move", 3), ("tagging-1", "ignore", 0)]
    assert [r["step"] for r in t["actions"].orderBy("pos").collect()] == ["denoise-1", "rescale-1", "rename-1", "tagging-1", "spreads-1", "pack-1"]
    ((_, actions),) = action_lists(t["volumes"])
    assert actions[1]["conditions"] == CONFIG["actions"][1]["conditions"] and (actions[1]["mode"], actions[1]["w"]) == ("multiply", 2)
    assert t["unknown"].count() == 0


def test_parameters_under_their_names():
    assert as_parameters({"kind": "shift_rename", "spreads_aware": True}) == {"kind": "shift_rename", "spreads": True}
    assert as_parameters({"kind": "posterize", "bpc": "auto"}) == {"kind": "posterize"} and as_parameters({"kind": "posterize", "bpc": 2})["bits"] == 2
    assert as_parameters({"kind": "level", "params": {"limit": "60", "title": "a b"}}) == {"kind": "level", "limit": 60, "title": "a b"}
    assert as_parameters({"kind": "change_cwd", "directory": "x"})["path"] == "x"


def test_a_configuration_runs(spark, path, pages, pixels):
    double = lambda block: np.clip(block * 2, 0, 1)
    done = pipeline.run_config(spark, path, pages, pixels=pixels, models={"m": double})
    rows = {(r["book"], r["page"]): r for r in done.pages.collect()}
    # v09 is no volume of the configuration
    assert {b for b, _ in rows} == {"v01", "v02"} and len(rows) == 12
    assert rows["v01", 0]["history"] == ["denoise-1:done", "rescale-1:ignored", "rename-1:done", "tagging-1:ignored", "spreads-1:done", "pack-1:done"]
    assert rows["v01", 1]["history"][:2] == ["denoise-1:copied", "rescale-1:done"] and rows["v01", 2]["history"][1] == "rescale-1:moved"
    assert [rows["v01", p]["width"] for p in range(6)] == [8, 16, 8, 8, 16, 8] and rows["v02", 2]["width"] == 16
    assert [rows["v01", p]["spread"] for p in range(4)] == [None, "1-2", "1-2", None]
    assert rows["v01", 0]["name"] == "Series - c001 (v01) - p000 [Cover] [dig] [One] [P] [crd] {LQ}.png"
    assert rows["v01", 4]["name"] == "Series - c002x1 (v01) - p004 [Ad] [dig] [P] [crd] {LQ}.png"
    assert rows["v02", 1]["name"] == "Other - c003 (v03) - p001 [c2c] [P] [crd] {r2}.png"
    assert rows["v01", 5]["archive"] == "Series v01 (2020) (Digital) [crd].cbz" and rows["v02", 5]["archive"] == "Other v03-04 (2021) (Omnibus) (c2c) [crd] (v2).cbz"
    assert rows["v01", 5]["cwd"] == "rescaled/v01" and rows["v01", 1]["tag"] == "T" and rows["v01", 0]["tag"] is None
    before = {(r["book"], r["page"], r["y"], r["x"]): r["v"] for r in pixels.collect()}
    after = {(r["book"], r["page"], r["y"], r["x"]): r["v"] for r in done.pixels.collect()}
    assert after == {k: v if k[:2] == ("v01", 1) else min(255, 2 * v) for k, v in before.items()}


def test_larger_tiles_make_larger_pages(spark, pages, pixels):
    grow = lambda block: block.repeat(2, axis=0).repeat(2, axis=1)
    done = pipeline.run(pages, [{"kind": "upscale", "model": "m", "scale": 2, "tile_size": 6, "tile_overlap": 1}], pipeline.Inputs(pixels=pixels, models={"m": grow}))
    want = {(r["book"], r["page"], 2 * r["y"] + i, 2 * r["x"] + j): r["v"] for r in pixels.collect() for i in (0, 1) for j in (0, 1)}
    assert {(r["book"], r["page"], r["y"], r["x"]): r["v"] for r in done.pixels.collect()} == want
    assert {(r["width"], r["height"]) for r in done.pages.select("width", "height").collect()} == {(16, 20), (16, 24)}
    with pytest.raises(ValueError):
        pipeline.run(pages, [{"kind": "denoise", "model": "none"}], pipeline.Inputs(pixels=pixels))


def test_all_lists_meet_the_pages_in_one_join(spark, path, pages):
    t = read_config(spark, path)
    actions = [{"kind": "rescale", "mode": "multiply", "w": 2}, {"kind": "tagging", "title": "T"}, {"kind": "posterize", "bits": 4}, {"kind": "tagging", "title": "U"}, {"kind": "rescale", "mode": "width", "w": 9}]
    df = pipeline.run(pages, actions, pipeline.Inputs(skips=t["skips"], meta=t["meta"], colors=t["colors"])).pages
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1


def test_a_dry_run_touches_no_more_than_it_must(spark, path, pages):
    t = read_config(spark, path)
    ((_, actions),) = action_lists(t["volumes"])
    actions = [*actions, {"kind": "shift_rename"}]
    inputs = pipeline.Inputs(skips=t["skips"], meta=t["meta"], spreads=t["spreads"], chapters=t["chapters"], volumes=t["volumes"])
    report = pipeline.dry_run(pages.filter("book <> 'v09'"), actions, inputs)
    got = {(r["volume"], r["step"]): (r["pages_in"], r["pages_done"], r["cwd"]) for r in report.collect()}
    assert got["v01", "denoise-1"] == (6, 5, "output/v01") and got["v01", "rescale-1"] == (6, 2, "rescaled/v01") and got["v02", "rescale-1"] == (6, 4, "rescaled/v02")
    assert got["v02", "pack-1"] == (6, 6, "rescaled/v02") and len(got) == 14
    # the renaming's window isn't computed
    names = [x for x in report._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window" in x]
    assert not any("row_number() windowspecdefinition(book" in x and "name" in x for x in names)


def test_what_is_wrong_with_a_configuration(spark, tmp_path):
    bad = {"title": "T", "volumes": [{"path": "a", "number": [2, 2], "chapters": [{"number": 1, "start": 5}, {"number": 1, "start": 3}], "colour": [1], "meta_naming": [{"tag": "x", "page": [1, 2]}, {"tag": "y", "page": 2}], "skip_actions": [{"step": "level-2", "action": "copy", "pages": [1]}], "pub_type": "book"}, {"path": "a"}], "actions": [{"kind": "level"}, {"kind": "interrupt"}]}
    (tmp_path / "c.json").write_text(json.dumps(bad))
    got = {(r["check"], r["book"], r["detail"]) for r in pipeline.config_violations(spark, str(tmp_path / "c.json")).collect()}
    assert got == {
        ("duplicate_chapter", "a", "1.0"), ("unsorted_start", "a", "3"), ("duplicate_path", None, "a"), ("unknown_step", "a", "level-2"), ("unknown_action", None, "interrupt"),
        ("unknown_field", "a", "colour"), ("missing_number", "a", "number"), ("omnibus_range", "a", "2.0"), ("duplicate_tag", "a", "2"), ("unknown_publication", "a", "book"),
    }
    assert pipeline.config_violations(spark, str(tmp_path / "c.json")).count() == len(got)


def test_the_guard_keeps_decided_rows_from_the_model(spark):
    asked = spark.sparkContext.accumulator(0)

    def make_predict():
        def predict(x):
            asked.add(len(x))
            return np.stack([x[:, 0], x[:, 0]], axis=1)

        return predict

    df = spark.createDataFrame([(k, float(k % 2), None if k == 5 else k < 90) for k in range(100)], "k int, f double, gray boolean")
    answers = {"is_color": F.lit(False), "confidence": F.lit(100), "should_convert": F.lit(True)}
    out = scoring.guarded_scores(df, F.col("gray"), answers, ["f"], make_predict, 2)
    rows = {r["k"]: (r["is_color"], r["confidence"], r["should_convert"]) for r in out.collect()}
    assert asked.value == 11
    assert rows == {k: (k % 2 == 1, 100, False) if k >= 90 or k == 5 else (False, 100, True) for k in range(100)}
