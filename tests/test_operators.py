"""Operators without an SQL twin, and cases that the tables don't have."""

import json

import pytest
from pyspark.sql import functions as F

from quire import pipeline
from quire.operators import compare, convert, forms, layout, lines, metrics, mutate, pageset, search, security, tables, validate
from quire.sources import pdf
from quire.streaming import sessions


def test_lines_fold():
    span = lambda t, x, y, size=10.0: {"text": t, "x": x, "y": y, "width": 5.0, "font_size": size, "font_name": ""}
    found = lines.fold_lines([span("b", 20, 100), span("a", 5, 103), span("low", 0, 80), span("zero", 0, 60, 0.0), span("same", 9, 65, 0.0)])
    assert [[s["text"] for s in f["spans"]] for f in found] == [["a", "b"], ["low"], ["zero", "same"]]
    assert found[0]["box"] == (5, 100, 25, 113)


def test_lcs():
    ops = compare.lcs_ops(["a", "b", "c"], ["a", "x", "c", "d"])
    assert [(o[0], o[1] or o[2]) for o in ops] == [("removed", "b"), ("added", "x"), ("added", "d")]
    assert compare.lcs_ops([], ["a"]) == [("added", None, "a", None, 0)] and compare.lcs_ops(["a"], ["a"]) == []
    assert [o[0] for o in compare.merged_ops([("removed", "hello world", None, 0, None), ("added", None, "hello there", None, 0)])] == ["changed"]
    assert [o[0] for o in compare.merged_ops([("removed", "éééé", None, 0, None), ("added", None, "éxxxxxxx", None, 0)])] == ["removed", "added"]
    import random

    r = random.Random(0)
    for _ in range(30):
        a, b = ([r.choice("abc") for _ in range(r.randint(0, 9))] for _ in range(2))
        ops = compare.lcs_ops(a, b)
        gone, new = {o[3] for o in ops if o[0] == "removed"}, {o[4] for o in ops if o[0] == "added"}
        assert [x for i, x in enumerate(a) if i not in gone] == [x for i, x in enumerate(b) if i not in new]


def test_same_pages_have_no_ops(spark):
    df = spark.createDataFrame([(1, 1, 0, "a"), (1, 2, 0, "b")], "doc_id long, page int, line_idx int, text string")
    assert compare.diff_lines(df, df).count() == 0


def test_cluster_points():
    square = [(x, y) for x in (0, 30) for y in (0, 30)]
    far = [(x, y) for x in (500, 530) for y in (500, 530)]
    labels = tables.cluster_points(square + far)
    assert labels[0] == labels[3] and labels[4] == labels[7] != labels[0]
    assert len(set(tables.cluster_points(square + [(x, 0) for x in (500, 530)]))) == 1  # a shared row joins them


def test_axis_keeps_the_last_kept(spark):
    row = spark.range(1).select(tables.axis(F.array(*[F.lit(float(x)) for x in (9, 0, 2, 4, 3.5)])).alias("a")).first()
    assert row.a == [0.0, 3.5, 9.0]


def test_empty_and_single_column_layout(spark):
    df = spark.createDataFrame([(1, 1, 0, "x", 50.0, 400.0, 80.0, 410.0)], "doc_id long, page int, line_idx int, text string, x0 double, y0 double, x1 double, y1 double")
    assert [r.region for r in layout.analyze(df, 612.0, 792.0).collect()] == ["body_column"]
    assert layout.analyze(df.limit(0), 612.0, 792.0).count() == 0


def test_page_ranges(spark):
    df = spark.createDataFrame([("1-3,2,7",), ("5-2",), ("a",), (None,), ("4",)], "r string")
    assert [r.p for r in df.select(search.page_numbers(F.col("r")).alias("p")).collect()] == [[1, 2, 3, 7], None, None, None, [4]]
    with pytest.raises(ValueError):
        search.select_pages(spark.range(1).selectExpr("1 AS page"), "9-1")


def test_stamp_and_merge(spark):
    things = spark.createDataFrame([(1, 1, 0, 0.0, 0.0, 5.0, 5.0, "t")], "doc_id long, page int, z int, x double, y double, width double, height double, text string")
    out = pageset.stamp(things, things.withColumn("text", F.lit("s")), x=10, scale=2, over=False).orderBy("z").collect()
    assert [(r.text, r.x, r.width) for r in out] == [("s", 10.0, 10.0), ("t", 0.0, 5.0)]
    a = spark.createDataFrame([(9, 1, "a")], "doc_id long, page int, text string")
    assert [r.text for r in pageset.merge_documents(a, a.withColumn("text", F.lit("b"))).orderBy("page").collect()] == ["a", "b"]
    with pytest.raises(ValueError):
        pageset.merge_documents()
    with pytest.raises(ValueError):
        pageset.rotate(a.withColumn("rotation", F.lit(0)), [(1, 45)])
    f = spark.createDataFrame([("x", 1), ("x", 2)], "name string, nth int")
    assert [r.name for r in pageset.merge_fields(f, "nth").collect()] == ["x", "doc2_x"]


def test_redaction(spark):
    spans = spark.createDataFrame([(1, 1, 0, 0, "secret", 0.0, 0.0, 50.0, 10.0), (1, 1, 0, 1, "over", 40.0, 2.0, 50.0, 10.0), (1, 1, 1, 0, "touch", 90.0, 0.0, 9.0, 10.0)], "doc_id long, page int, line_idx int, span_idx int, text string, x double, y double, width double, font_size double")
    kept, gone = security.redact_text(spans, "SECRET", case_sensitive=False)
    assert [r.text for r in kept.collect()] == ["touch"] and sorted(r.text for r in gone.collect()) == ["over", "secret"]
    none = security.redact_text(spans, "s.cret")[1]
    assert none.count() == 0  # literal unless regex is asked for


def test_security_columns(spark):
    df = spark.createDataFrame([(1, "text"), (2, None)], "doc_id long, text string")
    sealed = security.encrypt_column(df, "text", "pw")
    assert [r.text for r in security.decrypt_column(sealed, "text", "pw").orderBy("doc_id").collect()] == ["text", None]
    assert security.decrypt_column(sealed, "text", "no").filter("text IS NOT NULL").count() == 0
    signed = security.sign_column(df, "text", "k").withColumns({"not_before": F.timestamp_micros(F.lit(0)), "not_after": F.expr("timestamp'2999-01-01'")})
    assert [r.message for r in security.verify(signed.filter("doc_id = 1"), "text", "k").collect()] == ["valid"]
    assert [r.message for r in security.verify(signed.filter("doc_id = 1").withColumn("text", F.lit("t")), "text", "k").collect()] == ["the signed bytes were changed"]
    kept, removed = security.sanitize_objects(spark.createDataFrame([(1, "JavaScript"), (2, "Page"), (3, "URI")], "id long, kind string"), links=False)
    assert sorted(r.id for r in kept.collect()) == [2, 3] and sorted(r.category for r in removed.collect()) == ["action", "javascript"]


def test_forms(spark):
    nodes = spark.createDataFrame([(1, 0, None, "g", "Tx", 1), (1, 1, 0, "a", None, None), (1, 2, 0, "b", "Btn", 1 << 16)], "doc_id long, id int, parent int, t string, ft string, ff int")
    got = {r.name: r for r in forms.described(forms.qualified(nodes)).collect()}
    assert set(got) == {"g.a", "g.b"} and got["g.a"].type == "text" and got["g.a"].read_only and got["g.b"].type == "push_button"
    fields = spark.createDataFrame([(1, "x", "text", 0, "old", 1), (1, "r", "text", 1, "old", 1)], "doc_id long, name string, type string, ff int, value string, page int")
    filled, lost = forms.fill(fields, spark.createDataFrame([(1, "x", "new"), (1, "r", "no"), (1, "z", "no")], "doc_id long, name string, value string"))
    assert {r.name: r.value for r in filled.collect()} == {"x": "new", "r": "old"} and sorted(r.name for r in lost.collect()) == ["r", "z"]
    pages = spark.createDataFrame([(1, 1)], "doc_id long, page int")
    made, refused = forms.create(fields, spark.createDataFrame([(1, "n", "text", 1), (1, "x", "text", 1), (1, "m", "text", 7), (1, "u", "unknown", 1)], "doc_id long, name string, type string, page int"), pages)
    assert made.count() == 3 and {r.name: r.error for r in refused.collect()} == {"x": "name is taken", "m": "no such page", "u": "unknown type"}
    assert forms.has_form(pages, fields).first().has_form
    changed = forms.modify(fields, spark.createDataFrame([(1, "x", None, 2)], "doc_id long, name string, value string, ff int"), ["value", "ff"])
    assert {(r.name, r.value, r.ff) for r in changed.collect()} == {("x", "old", 2), ("r", "old", 1)}


def test_validation(spark):
    docs = spark.createDataFrame([(1, False, "pdfaid:part pdfaid:conformance", True, False, False), (2, True, None, False, True, True)], "doc_id long, encrypted boolean, xmp string, output_intent boolean, transparency boolean, javascript boolean")
    found = validate.pdf_a(docs)
    assert {r.rule for r in found.filter("doc_id = 2").collect()} == {"encryption", "xmp.missing", "output_intent.missing", "transparency.group", "javascript.action"}
    assert {r.doc_id: r.compliant for r in validate.report(docs, found).collect()} == {1: True, 2: False}
    fixed, actions = validate.fixes(docs)
    assert validate.pdf_a(fixed).count() == 0 and {r.category for r in actions.collect()} == {"encryption", "metadata", "color", "actions", "transparency"}
    fonts = spark.createDataFrame([(1, 1, "F", None), (1, 2, "G", True)], "doc_id long, page int, name string, embedded boolean")
    assert [r.message for r in validate.font_issues(fonts).collect()] == ["not embedded: F"]


def test_mutations(spark):
    marks = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "doc_id long, title string, page int")
    pages = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, page int")
    out, bad = mutate.set_bookmarks(marks, spark.createDataFrame([(1, "n", 1), (1, "m", 9)], "doc_id long, title string, page int"), pages)
    assert sorted(r.title for r in out.collect()) == ["b", "n"] and [r.title for r in bad.collect()] == ["m"]
    notes = spark.createDataFrame([(1, 1, 0, "Link", 0.0, 0.0), (1, 1, 1, "Text", 0.0, 0.0)], "doc_id long, page int, annot_idx int, type string, x0 double, y0 double")
    assert [r.annot_idx for r in mutate.remove_annotations(notes, ["link"], [0, 1]).collect()] == [1]
    assert mutate.add_annotation(notes, pages, notes.filter("annot_idx = 0").drop("annot_idx")).agg(F.max("annot_idx")).first()[0] == 2
    objects = spark.createDataFrame([(i, b"same" if i in (1, 2) else bytes([i]), "F") for i in range(5)], "id long, content binary, filter string")
    edges = spark.createDataFrame([(0, 1), (0, 2), (2, 3)], "src long, dst long")
    assert sorted(r.id for r in mutate.optimize(objects, edges, spark.range(1)).collect()) == [0, 1, 3]
    x = mutate.watermark(spark.createDataFrame([(1, 1, 600.0, 800.0)], "doc_id long, page int, width double, height double"), "AB", position="bottom_left").first().watermark
    assert (x.x, x.y, x.layer) == (50.0, 50.0, "over")


def test_metrics(spark):
    a = spark.createDataFrame([("t", 0, 0, 1, 1, "A  b"), ("t", 0, 1, 1, 1, "x")], "t string, row int, col int, row_span int, col_span int, text string")
    b = a.filter("col = 0").withColumn("text", F.lit("a b"))
    r = metrics.cell_scores(a, b, ["t"]).first()
    assert (r.precision, r.recall, round(r.f1, 4)) == (0.5, 1.0, 0.6667)
    assert metrics.averages(metrics.topology_scores(a, a, ["t"])).first().f1 == 1.0
    pairs = spark.createDataFrame([(1, 1, 1, 1, 0.9), (1, 1, 1, 2, 0.8), (1, 1, 2, 1, 0.85), (1, 1, 2, 2, 0.4)], "doc_id long, page int, f long, t long, iou double")
    assert [(r.f, r.t) for r in metrics.match(pairs).collect()] == [(1, 1)]


PAGE = b"<html><body><h1>Top</h1><p>text</p></body></html>"


def test_pipeline(spark, tmp_path):
    for n, c in (("a.html", PAGE), ("b.html", PAGE), ("c.pdf", pdf.write([{"spans": [{"text": "my secret", "x": 10, "y": 10}, {"text": "open", "x": 10, "y": 60}]}]))):
        (tmp_path / n).write_bytes(c)
    p = pipeline.Builder("p", str(tmp_path)).on_error("collect_errors").redact("secret").extract_text().save(str(tmp_path / "out" / "{stem}.{ext}.txt")).build()
    rows = pipeline.run(spark, p)
    got = {r.path.rpartition("/")[2]: r for r in rows.collect()}
    assert [got[k].status for k in ("a.html", "b.html", "c.pdf")] == ["failed", "failed", "success"] and "PDF" in got["a.html"].error and got["c.pdf"].text == "open"
    assert pipeline.write(rows) == 1 and (tmp_path / "out" / "c.pdf.txt").read_text() == "open"
    assert tuple(pipeline.rollup(rows).first()) == (3, 1, 2, 0)
    assert pipeline.progress(rows, 3).count() == 5
    first = pipeline.run(spark, pipeline.Pipeline("p", p.input, p.steps, False, "fail_fast"))
    assert [r.path.rpartition("/")[2] for r in first.collect()] == ["a.html"]
    skipped = pipeline.run(spark, pipeline.Pipeline("p", p.input, p.steps, True, "skip"))
    assert tuple(pipeline.rollup(skipped).first()) == (3, 1, 0, 2)


def test_pipeline_definitions():
    p = pipeline.Pipeline.parse(json.dumps({"input": "x/*", "steps": [{"type": "convert", "format": "docx"}, {"type": "save", "path": "{stem}.docx"}]}))
    assert pipeline.Pipeline.parse(p.to_json()) == p and p.on_error == "fail_fast"
    for bad in ({"input": "", "steps": [{"type": "to_markdown"}]}, {"input": "x", "steps": []}, {"input": "x", "steps": [{"type": "no"}]}, {"input": "x", "steps": [{"type": "convert"}]}, {"input": "x", "steps": [{"type": "convert", "format": "no"}]}, {"input": "x", "steps": [{"type": "to_markdown"}], "on_error": "no"}, []):
        with pytest.raises(pipeline.PipelineError):
            pipeline.Pipeline.parse(json.dumps(bad))
    assert pipeline.names("a/b.tar.gz") == {"filename": "b.tar.gz", "stem": "b.tar", "ext": "gz"} and pipeline.names("")["stem"] == "document"


def test_convert_writes_what_print_lines_says(spark):
    df = spark.createDataFrame([(1, 1, 0, "heading", "H", 1, None), (1, 1, 1, "paragraph", "word " * 2000, None, None)], "doc_id long, page int, block_idx int, type string, text string, level int, indent_level int")
    rows = convert.print_lines(df).collect()
    assert max(r.page for r in rows) == (len(rows) - 1) // 50 + 1
    made = convert.convert_blocks(df, "pdf").first().content
    assert pdf.read(bytes(made))["page_count"] == max(r.page for r in rows)


def test_session_stream(spark, tmp_path):
    events = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:30:00"), (1, "2024-01-01 05:00:00"), (2, "2024-01-03 00:00:00")], "user_id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = sessions.session_stream(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.user_id, r.events) for r in spark.sql("SELECT * FROM found").collect()}
    assert {(1, 2), (1, 1)} <= got
    batch = sessions.sessions(events)
    assert {(r.user_id, r.events) for r in batch.collect()} == {(1, 2), (1, 1), (2, 1)}


def test_deep_forms_and_rings(spark):
    deep = [(1, i, i - 1 if i else None, f"n{i}", "Tx" if i == 0 else None, None) for i in range(20)]
    ring = [(2, 0, 1, "a", "Tx", 0), (2, 1, 0, "b", "Tx", 0), (2, 2, 0, "leaf", "Tx", 0), (2, 3, 77, "orphan", "Tx", 0)]
    nodes = spark.createDataFrame(deep + ring, "doc_id long, id int, parent int, t string, ft string, ff int")
    assert [(r.doc_id, r.name, r.ft) for r in forms.qualified(nodes).collect()] == [(1, ".".join(f"n{i}" for i in range(20)), "Tx")]
    assert forms.qualified(nodes.limit(0)).count() == 0


def test_parents_of_any_level(spark):
    rows = [(1, i, n) for i, n in enumerate([9, 10, 11, 12, 10, None, 40, 3])]
    got = mutate.parents(spark.createDataFrame(rows, "doc_id long, ord int, level int"), ["doc_id"], "ord").orderBy("ord").collect()
    assert [r.parent for r in got] == [None, 0, 1, 2, 0, None, 4, None]
    assert got[0].asDict().keys() == {"doc_id", "ord", "level", "parent"}


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from quire import storage

    conf = SimpleNamespace(get=lambda k: None)
    on = lambda master: SimpleNamespace(sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, getConf=lambda: conf, master=master, setCheckpointDir=lambda at: None))
    for master in ("spark://x:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            storage.shared_dir(on(master))
    storage.shared_dir(on("local[2]"))
