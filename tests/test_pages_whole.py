"""Labelled pairs of long pages, deep and large JSON, and many labels."""

import json

from partloom.operators import pages


def pairs(spark, html):
    return [(r.kind, r.label, r.value) for r in pages.labelled_pairs(spark.createDataFrame([(1, html)], "page_id long, html string")).orderBy("ord").collect()]


def test_json_of_the_whole_page(spark):
    filler = "<p>" + "filler " * 40_000 + "</p>"
    blob = json.dumps({"pad": ["x" * 100] * 5000, "specs": [{"name": "Backing", "value": "PSA"}]})
    got = pairs(spark, f'<body>{filler}{filler}<script type="application/json">{blob}</script>{filler}<p>Grit Size: P80</p></body>')
    assert ("json", "Backing", "PSA") in got and ("html", "Grit Size", "P80") in got


def test_json_walk_is_not_cut(spark):
    deep = {"name": "Deep Label", "value": "1 in"}
    for _ in range(60):
        deep = {"in": [deep]}
    many = {f"label{i}": f"v{i}" for i in range(2500)}
    script = '<script type="application/json">{}</script>'.format
    got = pairs(spark, script(json.dumps(many)) + script("not json") * 9 + script("[" * 100_000) + script(json.dumps(deep)))
    assert {("json", f"label{i}", f"v{i}") for i in range(2500)} | {("json", "Deep Label", "1 in")} == set(got)


def test_limit_of_pairs_is_the_markups(spark):
    lines = "".join(f"<p>Label{i:03d}x: v{i}</p>" for i in range(100))
    got = pairs(spark, lines + '<script type="application/ld+json">' + json.dumps({"Label000x": "other", "Label099x": "found", "Plating": "zinc"}) + "</script>")
    assert [x for x in got if x[0] == "html"] == [("html", f"Label{i:03d}x", f"v{i}") for i in range(80)]
    assert [x for x in got if x[0] == "json"] == [("json", "Label099x", "found"), ("json", "Plating", "zinc")]
