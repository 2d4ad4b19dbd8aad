"""Versions, reports, stored tables, uploads, providers, streaming and the entry point."""

import io
import json
import random
import subprocess
import sys
import time
import zipfile
from datetime import date, datetime
from pathlib import Path

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lexmill import providers, service
from lexmill.operators import analytics, enrichment, filters, index, lifecycle, search
from lexmill.schemas import schema
from lexmill.sources import bodies, tables, uploads
from lexmill.streaming.ingest import ingest_stream

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import this module

POINTS = schema("chunk_id string, document_id string, parent_id string, version string, chunk_index int, effective_date date, effective_until date, is_actual boolean, text string")
REGISTRY = schema("document_id string, version string, source_title string, is_active boolean, created_at string")


def points(spark, *rows):
    return spark.createDataFrame([(c, d, f"{d}:1", v, i, date(2026, 1, 1), None, True, t) for c, d, v, i, t in rows], POINTS)


def test_whole_documents_are_replaced(spark):
    old = points(spark, ("a0", "a", "v1", 0, "x"), ("a1", "a", "v2", 0, "orphan"), ("b0", "b", "v1", 0, "y"))
    registry = spark.createDataFrame([("a", "v1", "A", True, "t1"), ("a", "v2", "A", True, "t1"), ("b", "v1", "B", True, "t1")], REGISTRY)
    new = points(spark, ("n0", "a", "v2", 0, "new"), ("n0", "a", "v2", 5, "later"))
    rows = spark.createDataFrame([("a", "v2", "A2", True, "t2")], REGISTRY)
    after, reg, report = lifecycle.ingest_documents(old, registry, new, rows)
    assert sorted((r.chunk_id, r.text) for r in after.collect()) == [("a1", "orphan"), ("b0", "y"), ("n0", "later")]
    assert sorted(map(tuple, reg.collect())) == [("a", "v1", "A", False, "t1"), ("a", "v2", "A2", True, "t1"), ("b", "v1", "B", True, "t1")]
    assert tuple(report.first()) == ("a", "v2", 2, ["v1"])
    purged, _, _ = lifecycle.ingest_documents(old, registry, new, rows, purge_same_version=True)
    assert sorted(r.chunk_id for r in purged.collect()) == ["b0", "n0"]
    again, _, _ = lifecycle.ingest_documents(after, reg, new, rows)
    assert sorted(r.chunk_id for r in again.collect()) == sorted(r.chunk_id for r in after.collect())


def test_sections_are_superseded(spark):
    old = points(spark, ("a0", "a", "v1", 0, "x"), ("a1", "a", "v1", 1, "x"), ("c0", "c", "v1", 0, "z"))
    new = points(spark, ("n0", "a", "v2", 0, "new")).withColumn("effective_date", F.lit("2026-02-01").cast("date"))
    after, report = lifecycle.ingest_sections(old, new)
    got = {r.chunk_id: (r.is_actual, r.effective_until) for r in after.collect()}
    assert got == {"a0": (False, date(2026, 2, 1)), "a1": (False, date(2026, 2, 1)), "c0": (True, None), "n0": (True, None)}
    assert tuple(report.first()) == ("a:1", ["a0", "a1"])
    same, report = lifecycle.ingest_sections(after, new)  # the same version again replaces nothing
    assert report.count() == 0 and same.count() == 4
    assert [r.chunk_id for r in lifecycle.as_of(after, F.lit("2026-01-15").cast("date")).orderBy("chunk_id").collect()] == ["a0", "a1", "c0"]
    assert after.where(filters.replaced_section(F.lit("a:1"), F.lit("v1"))).count() == 1


def test_several_versions_in_one_batch(spark):
    """As if they came one after the other: the last is in force, the earlier ones are history."""
    old = points(spark, ("a0", "a", "v1", 0, "x"))
    registry = spark.createDataFrame([("a", "v1", "A", True, "t1")], REGISTRY)
    new = points(spark, ("n2", "a", "v2", 0, "two"), ("n3", "a", "v3", 0, "three"), ("b1", "b", "v1", 0, "b"))
    rows = spark.createDataFrame([("a", "v2", "A", True, "t2"), ("a", "v3", "A", True, "t3"), ("b", "v1", "B", True, "t3"), ("b", "v1", "B again", True, "t2")], REGISTRY)
    after, reg, report = lifecycle.ingest_documents(old, registry, new, rows)
    assert sorted(r.chunk_id for r in after.collect()) == ["b1", "n3"]
    assert sorted((r.document_id, r.version, r.is_active) for r in reg.collect()) == [("a", "v1", False), ("a", "v2", False), ("a", "v3", True), ("b", "v1", True)]
    assert sorted(map(tuple, report.collect())) == [("a", "v3", 1, ["v1", "v2"]), ("b", "v1", 1, [])]
    after, _, _ = lifecycle.ingest_documents(old, registry, new, rows, order=F.when(F.col("version") == "v2", 9).otherwise(0))
    assert sorted(r.chunk_id for r in after.collect()) == ["b1", "n2"]


def test_two_updates_of_a_section(spark):
    old = points(spark, ("a0", "a", "v1", 0, "x"), ("a9", "a", "v3", 1, "y"), ("c0", "c", "v1", 0, "z"))
    dated = lambda df, d: df.withColumn("effective_date", F.lit(d).cast("date"))
    new = dated(points(spark, ("n2", "a", "v2", 0, "two"), ("m2", "a", "v2", 1, "two")), "2026-02-01").unionByName(dated(points(spark, ("n3", "a", "v3", 0, "three")), "2026-03-01"))
    after, report = lifecycle.ingest_sections(old, new)
    got = {r.chunk_id: (r.is_actual, r.effective_until) for r in after.collect()}
    feb, mar = date(2026, 2, 1), date(2026, 3, 1)
    assert got == {"a0": (False, feb), "a9": (False, feb), "c0": (True, None), "n2": (False, mar), "m2": (False, mar), "n3": (True, None)}
    assert after.count() == 6 and tuple(report.first()) == ("a:1", ["a0", "a9"])


def test_deletes_and_listings(spark):
    old = points(spark, ("a0", "a", "v1", 1, "x"), ("a1", "a", "v2", 0, "x"), ("b0", "b", "v1", 0, "y"))
    assert lifecycle.delete_document(old, "a").count() == 1 and lifecycle.delete_document(old, "a", "v1").count() == 2
    assert lifecycle.delete_document(old, "none").count() == 3
    assert [r.chunk_id for r in lifecycle.list_chunks(old, "a").collect()] == ["a1", "a0"]
    assert {r.document_id: r.versions for r in lifecycle.versions(old).collect()} == {"a": ["v1", "v2"], "b": ["v1"]}
    assert lifecycle.keep_newest(old, "document_id", by="chunk_index").count() == 2


def test_dashboard(spark):
    registry = spark.createDataFrame([("a", "v1", "A", True, ""), ("b", "v1", "B", True, ""), ("b", "v0", "B", False, "")], REGISTRY)
    p = points(spark, ("a0", "a", "v1", 0, ""))
    stages = ("query_expansion", "embed_query", "hybrid_search", "rerank")
    logs = spark.createDataFrame([(datetime(2026, 1, 10), *[1.0] * 4), (datetime(2026, 1, 19, 12), 2.0, 4.0, 6.0, None), (datetime(2026, 1, 20), 4.0, 4.0, 6.0, 8.0)], "created_at timestamp, " + ", ".join(f"latency_{s}_ms double" for s in stages))
    row = analytics.dashboard(registry, logs, p, F.lit("2026-01-20").cast("timestamp")).first()
    assert (row.documents_total, row.documents_active, row.distinct_documents, row.search_logs_total, row.points_count, row.mismatches) == (3, 2, 2, 3, 1, 1)
    assert (row.avg_latency_query_expansion_ms, row.avg_latency_rerank_ms) == (3.0, 8.0)
    late = analytics.dashboard(registry, logs, p, F.lit("2027-01-01").cast("timestamp")).first()
    assert late.avg_latency_embed_query_ms is None and late.last_search_at is None
    many = spark.range(201).select(F.col("id").cast("string").alias("document_id"), F.lit("v").alias("version"), F.lit(True).alias("is_active"))
    assert analytics.dashboard(many, logs, p, F.lit("2026-01-20").cast("timestamp")).first().mismatches is None


def test_requests_and_documents_are_checked(spark):
    q = spark.createDataFrame([(" ", 5), ("x", 0), ("x", 21), ("x", None), (None, 5)], "query string, top_k int")
    assert [r[0] for r in q.select(filters.request_problem()).collect()] == ["empty query", "top_k out of range", "top_k out of range", None, "empty query"]
    d = spark.createDataFrame([("labor_code", ["t"]), ("labor_code", []), ("case_law", ["t"]), ("authorial", None)], "category string, topics array<string>")
    assert [r[0] for r in d.select(filters.document_problem()).collect()] == ["topics not allowed for category", None, None, None]
    assert [r[0] for r in d.select(filters.document_problem(True)).collect()][2:] == ["section update not allowed for category"] * 2


def store_of(spark, path, buckets=4):
    return tables.SnapshotStore(spark, f"file://{path}", {"points": tables.TableSpec(POINTS, "document_id"), "registry": tables.TableSpec(REGISTRY, "document_id")}, buckets)


def test_snapshots_change_whole(spark, tmp_path):
    table = tables.SnapshotTable(spark, f"file://{tmp_path}/points", POINTS, "chunk_id")
    assert table.read().count() == 0
    table.replace(points(spark, ("a0", "a", "v1", 0, "x")))
    table.upsert(points(spark, ("a1", "a", "v1", 1, "y"), ("a0", "a", "v1", 0, "z")), "chunk_id")
    assert sorted((r.chunk_id, r.text) for r in table.read().collect()) == [("a0", "z"), ("a1", "y")]
    for bad in (lambda: table.replace(table.read().drop("text")), lambda: table.upsert(points(spark), "document_id")):
        with pytest.raises(ValueError):
            bad()
    table.replace(table.read())
    table.replace(table.read())
    assert table.read().count() == 2 and len(list((tmp_path / "points" / "_versions").glob("[0-9]*"))) == 2


def test_only_touched_buckets_are_written(spark, tmp_path):
    store = store_of(spark, tmp_path, 16)
    many = points(spark, *[(f"c{i}", f"d{i}", "v1", 0, "x") for i in range(60)])
    first = store.begin().commit({"points": (many, None)})
    new = points(spark, ("n", "d7", "v2", 0, "y"))
    touched = first.touched(new, "points", "registry")["points"]
    second = store.begin().commit({"points": (lifecycle.upsert(first.read("points", touched), new, "chunk_id"), touched)})
    changed = {b for b, p in second.parts["points"].items() if first.parts["points"][b] != p}
    assert len(second.lookup("points", new, "document_id").inputFiles()) == 1 and second.lookup("points", new, "document_id").count() == 2
    assert [r.chunk_id for r in second.lookup("points", new, "chunk_id").collect()] == ["n"]
    assert store.problems() == []
    other = tables.SnapshotStore(spark, f"file://{tmp_path}", {"points": tables.TableSpec(schema("document_id string, version int, extra string"), "document_id")}, 16)
    assert {p.partition(": ")[2] for p in other.problems()} == {"column version is string, not int", "column extra is missing"}
    assert changed == set(touched) and len(second.parts["points"]) > 10 and second.read("points").count() == 61
    with pytest.raises(ValueError):
        store.begin().commit({"points": (many, touched)})
    assert store.begin().read("points").count() == 61


def test_writers_of_one_version_exclude_each_other(spark, tmp_path):
    store = store_of(spark, tmp_path)
    store.begin().commit({"points": (points(spark, ("a", "a", "v1", 0, "x")), None)})
    one, two = store.begin(), store_of(spark, tmp_path).begin()
    one.commit({"points": (points(spark, ("b", "b", "v1", 0, "x")), None)})
    with pytest.raises(tables.ConcurrentChange):
        two.commit({"points": (points(spark, ("c", "c", "v1", 0, "x")), None)})
    assert [r.chunk_id for r in store.begin().read("points").collect()] == ["b"]


def test_a_crash_at_any_step_leaves_a_version(spark, tmp_path, monkeypatch):
    """Killed before and after every file operation of a change, a reader sees the old or the new rows, never fewer."""
    state = lambda s: [sorted(r[0] for r in s.begin().read(t).select("document_id").collect()) for t in ("points", "registry")]
    rows = lambda d: {"points": (points(spark, (d, d, "v1", 0, "x")), None), "registry": (spark.createDataFrame([(d, "v1", "T", True, "t")], REGISTRY), None)}
    steps = 0
    while True:
        path = tmp_path / str(steps)
        store = store_of(spark, path)
        for d in ("o", "p", "q"):  # so that the next change has folders to delete
            store.begin().commit(rows(d))
        calls = [0]

        class Killed(Exception):
            pass

        def dying(real, after):
            def run(*args):
                calls[0] += 1
                if calls[0] > steps and not after:
                    raise Killed
                out = real(*args)
                if calls[0] > steps:
                    raise Killed
                return out

            return run

        after = steps % 2 == 1
        monkeypatch.setattr(tables.SnapshotStore, "_put", dying(tables.SnapshotStore._put, after))
        monkeypatch.setattr(tables.SnapshotStore, "write", dying(tables.SnapshotStore.write, after))
        monkeypatch.setattr(tables.SnapshotStore, "_purge", dying(tables.SnapshotStore._purge, after))
        try:
            store.begin().commit(rows("n"))
            died = False
        except Killed:
            died = True
        monkeypatch.undo()
        assert state(store) in ([["q"], ["q"]], [["n"], ["n"]])
        store.begin().commit(rows("m"))  # and the next change works
        assert state(store) == [["m"], ["m"]]
        if not died:
            break
        steps += 1
    assert steps >= 4
    folders = lambda: len(list((path / "data").iterdir()))
    store.write("points", points(spark, ("x", "x", "v1", 0, "x")))  # by a writer that died
    held = folders()
    assert store.vacuum(1) == 0 and folders() == held
    assert store.vacuum(-1) >= 1 and folders() < held and state(store) == [["m"], ["m"]]
    (path / "_versions" / ".half").write_text('{"parts"')  # a pointer whose writer died within it has no number yet
    store.begin().commit(rows("l"))
    assert state(store) == [["l"], ["l"]]
    for f in (path / "_versions").iterdir():
        f.unlink()
    with pytest.raises(OSError):
        store.begin()


def test_a_writer_between_the_steps_of_another(spark, tmp_path, monkeypatch):
    """Whatever happens between a writer's look and its pointer, one alone succeeds and nothing is lost."""
    store = store_of(spark, tmp_path)
    one = lambda d: {"points": (points(spark, (d, d, "v1", 0, "x")), None)}
    store.begin().commit(one("o"))
    real = tables.SnapshotStore._put
    for others in (1, 2, 4):  # so many that the slow writer's number may be free again
        slow, seen = store.begin(), []

        def held(self, *args, others=others, seen=seen):
            if not seen:
                seen.append(1)
                for i in range(others):
                    store_of(spark, tmp_path).begin().commit(one(f"fast{i}"))
            return real(self, *args)

        monkeypatch.setattr(tables.SnapshotStore, "_put", held)
        with pytest.raises(tables.ConcurrentChange):
            slow.commit(one("slow"))
        monkeypatch.undo()
        assert [r.chunk_id for r in store.begin().read("points").collect()] == [f"fast{others - 1}"]
    assert all(f.name.isdigit() for f in (tmp_path / "_versions").iterdir())


def test_large_buckets_split(spark, tmp_path):
    """A change writes about as much whatever the store holds."""
    store = tables.SnapshotStore(spark, f"file://{tmp_path}", {"points": tables.TableSpec(POINTS, "document_id")}, 2, 30_000)
    noise = random.Random(5).randbytes(200_000).hex()

    def changed(*rows):
        before, new = store.begin(), points(spark, *rows)
        touched = before.touched(new, "points")["points"]
        after = before.commit({"points": (lifecycle.upsert(before.read("points", touched), new, "chunk_id"), touched)})
        return sum(p["bytes"] for b, p in after.parts["points"].items() if before.parts.get("points", {}).get(b) != p), after.parts["points"]

    text = lambda i: noise[i * 180 : i * 180 + 300]
    _, few = changed(*[(f"c{i}", f"d{i}", "v1", 0, text(i)) for i in range(200)])
    small, _ = changed(("n1", "d1", "v2", 0, "y"))
    changed(*[(f"c{i}", f"d{i}", "v1", 0, text(i)) for i in range(200, 2000)])
    large, many = changed(("n2", "d1", "v3", 0, "y"))
    assert large < 2 * small and len(many) > 4 * len(few) and max(p["bytes"] for p in many.values()) < 60_000
    now = store.begin()
    for b in sorted(many)[::7]:  # every row is in the bucket of its key
        d, v = map(int, b.split("-"))
        found = store.rows_of("points", [many[b]["path"]])
        assert found.where(F.pmod(F.xxhash64("document_id"), F.lit(1 << d)) != v).count() == 0
    assert now.read("points").count() == now.read("points").select("chunk_id").distinct().count() == 2002
    assert [r.chunk_id for r in now.lookup("points", points(spark, ("a", "d777", "v", 0, "x")), "document_id").collect()] == ["c777"]


def test_sums_are_added_and_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "MOST_ADDED", 3)
    monkeypatch.setattr(tables, "ADDED_SHARE", 50)
    kind = schema("token string, tf double, n bigint")
    store = tables.SnapshotStore(spark, f"file://{tmp_path}", {"frequencies": tables.TableSpec(kind, "token", sums="n")}, 4)
    more = lambda *rows: spark.createDataFrame([(t, 1.0, n) for t, n in rows], kind)
    store.begin().commit({"frequencies": (more(("a", 5), ("b", 1)), None)})
    kept = []
    for rows in ([("a", -2), ("c", 1)], [("b", -1)], [("c", 4)], [("d", 1)], []):
        now = store.begin().commit({}, None, {"frequencies": more(*rows)})
        kept.append(len(now.added["frequencies"]))
    assert kept == [1, 2, 3, 0, 1] or kept == [1, 2, 3, 0, 0]
    assert sorted(map(tuple, store.begin().read("frequencies").collect())) == [("a", 1.0, 3), ("c", 1.0, 5), ("d", 1.0, 1)]
    with pytest.raises(ValueError):
        store_of(spark, tmp_path / "other").write_added("points", points(spark))


def test_logs_are_appended_by_day(spark, tmp_path):
    kind = schema("request_id string, created_at timestamp")
    log = tables.LogTable(spark, f"{tmp_path}/logs", kind)
    for i, at in enumerate((datetime(2026, 1, 1), datetime(2026, 1, 2, 10), datetime(2026, 1, 3))):
        log.append(spark.createDataFrame([(str(i), at)], kind))
    assert log.read().count() == 3 and [r.request_id for r in log.read("2026-01-02 11:00:00").collect()] == ["2"]
    plan = log.read("2026-01-02 11:00:00")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx(body, header=""):
    out = io.BytesIO()
    ns = f'xmlns:w="{W}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}<w:sectPr><w:headerReference r:id='h1'/></w:sectPr></w:body></w:document>")
        z.writestr("word/styles.xml", f"<w:styles {ns}><w:style w:styleId='Up'><w:rPr><w:vertAlign w:val='superscript'/></w:rPr></w:style><w:style w:styleId='Down'><w:basedOn w:val='Up'/></w:style></w:styles>")
        z.writestr("word/_rels/document.xml.rels", "<Relationships xmlns='http://schemas.openxmlformats.org/package/2006/relationships'><Relationship Id='h1' Target='header1.xml'/></Relationships>")
        z.writestr("word/header1.xml", f"<w:hdr {ns}><w:p><w:r><w:t>{header}</w:t></w:r></w:p></w:hdr>")
    return out.getvalue()


def run(text, props=""):
    return f"<w:r><w:rPr>{props}</w:rPr><w:t>{text}</w:t></w:r>"


def test_documents_are_read_in_order(spark):
    up, styled, based = "<w:vertAlign w:val='superscript'/>", "<w:rStyle w:val='Up'/>", "<w:rStyle w:val='Down'/>"
    body = (
        f"<w:p>{run('Статья 133')}{run('1', up)}{run('. Размер')}</w:p><w:p>{run('Статья 195')}{run('2', styled)}{run(' и 7')}{run('3', based)}</w:p>"
        f"<w:p>{run('слово')}{run('1', up)}</w:p><w:p/><w:p>{run('см. ')}<w:hyperlink>{run('ссылка')}</w:hyperlink></w:p>"
        f"<w:tbl><w:tr><w:tc><w:p>{run('a')}</w:p><w:p>{run('b')}</w:p></w:tc><w:tc><w:p>{run('c')}</w:p></w:tc></w:tr></w:tbl>"
    )
    want = "Статья 133.1. Размер\nСтатья 195.2 и 7.3\nслово1\nсм. ссылка\na\nb\nc\nверх"
    assert uploads.docx_text(docx(body, "верх")) == want
    files = [("x/A.DOCX", docx(body, "верх")), ("b.txt", "привет".encode()), ("c.md", b"# t"), ("d.txt", b"\xff\xfe"), ("e.exe", b""), ("f.docx", b"no zip"), ("g.pdf", b"%PDF"), ("noext", b"")]
    texts, rejects = uploads.extract(spark.createDataFrame(files, "path string, content binary"))
    assert {r.path: r.text for r in texts.collect()} == {"x/A.DOCX": want, "b.txt": "привет", "c.md": "# t"}
    reasons = {r.path: r.reason for r in rejects.collect()}
    assert set(reasons) == {"d.txt", "e.exe", "f.docx", "g.pdf", "noext"} and "unsupported" in reasons["e.exe"]


def packed(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in parts.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), content)
    return out.getvalue()


def test_damaged_documents_are_refused_one_by_one(spark, monkeypatch):
    ns = f'xmlns:w="{W}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    whole = docx(f"<w:p>{run('text')}</w:p>")
    cut = bytearray(packed(word__document_xml=f"<w:document {ns}><w:body>{'<w:p/>' * 500}</w:body></w:document>"))
    cut[60:75] = bytes(15)  # within the packed part
    encrypted = bytearray(whole)
    for mark, at in ((b"PK\x03\x04", 6), (b"PK\x01\x02", 8)):
        for i in range(len(encrypted) - 4):
            if encrypted[i : i + 4] == mark:
                encrypted[i + at] |= 1
    odd = packed(word__document_xml=f"<w:document {ns}><w:body><w:sectPr><w:headerReference r:id='none'/></w:sectPr></w:body></w:document>")
    files = {"no_body.docx": packed(word__document_xml=f"<w:document {ns}/>"), "cut.docx": bytes(cut), "encrypted.docx": bytes(encrypted), "no_part.docx": odd, "null.docx": b"", "good.docx": whole}
    texts, rejects = uploads.extract(spark.createDataFrame(list(files.items()), "path string, content binary"))
    assert [r.path for r in texts.collect()] == ["good.docx"] and {r.path for r in rejects.collect()} == files.keys() - {"good.docx"}
    monkeypatch.setattr(uploads, "MAX_PART_BYTES", 1000)
    with pytest.raises(ValueError, match="over 1000 bytes"):
        uploads.file_text("bomb.docx", packed(word__document_xml="<x>" + " " * 100_000 + "</x>"))


def test_files_are_found_and_large_ones_refused(spark, tmp_path, monkeypatch):
    (tmp_path / "a.txt").write_text("текст", encoding="utf-8")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.md").write_text("x" * 50)
    monkeypatch.setattr(uploads, "MAX_FILE_BYTES", 40)
    texts, rejects = uploads.read_uploads(spark, str(tmp_path))
    assert [r.text for r in texts.collect()] == ["текст"] and [r.reason for r in rejects.collect()] == ["too large"]
    with pytest.raises(ValueError):
        uploads.file_text("a.txt", b"x" * 41)


class Failing:
    dims = 2

    def enrich(self, text):
        if "bad" in text:
            raise RuntimeError("no answer")
        return json.dumps({"synthetic_title": "T", "hypothetical_questions": [text, " ", "q1", "q2"]})

    def embed(self, texts):
        return [[float(len(t)), 1.0] for t in texts]


def test_enrichment_is_all_or_nothing_per_document(spark, monkeypatch):
    rows = [("a", 0, "ok"), ("a", 1, "fine"), ("b", 0, "ok"), ("b", 1, "bad")]
    df = spark.createDataFrame(rows, "document_id string, chunk_index int, text string")
    # pauses are short here: the workers import the module anew
    good, report = enrichment.enrich_chunks(df.where("text <> 'bad'"), Failing(), 2)
    assert sorted((r.document_id, r.hypothetical_questions) for r in good.collect()) == [("a", ["fine", "q1", "q2"]), ("a", ["ok", "q1", "q2"]), ("b", ["ok", "q1", "q2"])]
    embedded, failed = enrichment.embed_chunks(good, Failing(), 2)
    row = embedded.where("text = 'ok' and document_id = 'a'").first()
    assert row.chunk_vector == [5.0, 1.0] and row.question_vectors == [[2.0, 1.0]] * 3 and failed.count() == report.count() == 0
    kept, report = enrichment.enrich_chunks(df, Failing(), 1)
    assert {r.document_id for r in kept.collect()} == {"a"}
    assert tuple(report.first()) == ("b", [1], "no answer")


def test_breaker_limiter_and_retries():
    now = [0.0]
    breaker = providers.CircuitBreaker(threshold=2, recovery=10, clock=lambda: now[0])
    for _ in range(2):
        breaker.before()
        breaker.after(False)
    with pytest.raises(providers.CircuitOpen):
        breaker.before()
    now[0] = 10
    breaker.before()
    breaker.after(True)
    breaker.before()
    waits = []
    limiter = providers.RateLimiter(4, clock=lambda: now[0], sleep=waits.append)
    for _ in range(3):
        limiter.wait()
    assert waits == [0.25, 0.5]
    calls, pauses = [], []
    guard = providers.Resilient(retries=3, sleep=pauses.append)

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise ValueError("no")
        return x * 2

    assert guard.call(flaky, 4) == 8 and len(pauses) == 2 and 0.5 <= pauses[0] <= 0.55 and 1.0 <= pauses[1] <= 1.1
    with pytest.raises(providers.ProviderError):
        guard.call(lambda: 1 / 0)
    assert providers.backoff(20, rng=lambda: 0) == 10


def test_the_breaker_counts_calls_and_is_waited_for():
    now, pauses, asked = [0.0], [], []

    def sleep(seconds):
        pauses.append(seconds)
        now[0] += seconds

    guard = providers.Resilient(breaker=providers.CircuitBreaker(clock=lambda: now[0]), sleep=sleep)

    def ask(x):
        asked.append(x)
        if x == "down":
            raise ValueError(x)
        if x == "odd":
            raise providers.ContentError(x)
        return x

    for x in ["down"] * 4 + ["odd"] * 9:
        with pytest.raises(providers.ProviderError, match=x):
            guard.call(ask, x)
    assert asked == ["down"] * 12 + ["odd"] * 9 and guard.breaker.failures == 4 and not guard.breaker.rest()
    with pytest.raises(providers.ProviderError, match="down"):
        guard.call(ask, "down")
    assert guard.breaker.rest() == pytest.approx(30) and guard.call(ask, "good") == "good" and pauses[-1] == pytest.approx(30)
    assert not guard.breaker.failures and not guard.breaker.rest()


def test_bad_rows_spoil_no_good_ones(spark):
    rows = [("a", None), ("b", None), ("c", "one two"), ("d", "—"), ("e", "…"), ("f", "three"), ("g", "!")] + [(f"h{i}", f"word {i}") for i in range(3)]
    df = spark.createDataFrame([(d, 0, t) for d, t in rows], "document_id string, chunk_index int, text string").coalesce(1)
    enriched, unanswered = enrichment.enrich_chunks(df, providers.LeadEnricher(), None)
    embedded, unplaced = enrichment.embed_chunks(enriched, providers.HashEmbedder(8), None)
    assert sorted(r.document_id for r in embedded.collect()) == ["c", "f", "h0", "h1", "h2"]
    assert sorted((r.document_id, r.error) for r in unanswered.collect()) == [("a", "no text"), ("b", "no text")]
    assert sorted((r.document_id, r.error) for r in unplaced.collect()) == [(d, "empty vector") for d in "deg"]
    twice = spark.createDataFrame([(d, 0, "bad" if d in "ab" else "ok") for d in "abcd"], "document_id string, chunk_index int, text string").coalesce(1)
    kept, report = enrichment.enrich_chunks(twice, Failing(), None)  # errors of the provider, two in a row
    assert sorted(r.document_id for r in kept.collect()) == ["c", "d"]
    assert sorted((r.document_id, r.error) for r in report.collect()) == [("a", "no answer"), ("b", "no answer")]


def test_offline_providers():
    embedder = providers.HashEmbedder(8)
    a, b = embedder.embed(["one two", "one two"])
    assert a == b and sum(x * x for x in a) == pytest.approx(1)
    with pytest.raises(providers.ProviderError):
        embedder.embed(["—"])
    assert providers.OverlapReranker().rerank("a b", ["x", "b", "a b"], 5) == [3, 2]
    assert json.loads(providers.SameQuery().expand("q"))["variants"][0]["sub_question"] == "q"
    assert len(json.loads(providers.LeadEnricher().enrich("some words"))["hypothetical_questions"]) == 3


def test_words_that_cancel_out_are_no_empty_text():
    """w3 and w4 have one place and different signs."""
    (v,) = providers.HashEmbedder(8).embed(["w4 w3"])
    assert sum(x * x for x in v) == pytest.approx(1) and v == [abs(x) for x in providers.HashEmbedder(8).embed(["w4"])[0]]


def test_marks_of_emphasis_in_a_text_are_no_failure(spark):
    """Questions of '___' alone hold a word; a text of '***' has none and fails where it is embedded, as in the query's SQL."""
    texts = ["___", "***", '"*x*"', "a b c d e ___ - -"]
    chunks = spark.createDataFrame([(str(i), str(i), 0, t) for i, t in enumerate(texts)], "chunk_id string, document_id string, chunk_index int, text string")
    enriched, unanswered = enrichment.enrich_chunks(chunks, providers.LeadEnricher(), None)
    embedded, unplaced = enrichment.embed_chunks(enriched, providers.HashEmbedder(8), None)
    assert unanswered.count() == 0 and [(r.document_id, r.error) for r in unplaced.collect()] == [("1", "empty vector")]
    assert {r.document_id: r.synthetic_title for r in embedded.collect()} == {"0": "___", "2": '"*x*"', "3": "a b c d e ___ - -"}


def test_no_document_fails_for_words_that_cancel_out(spark):
    rows = spark.createDataFrame([("a", 0, "w4 w3", "w3 w4", ["w4 w3?", "x", "y"]), ("b", 0, "—", "w3 w4", ["x", "y", "z"])], "document_id string, chunk_index int, text string, synthetic_title string, hypothetical_questions array<string>")
    embedded, failed = enrichment.embed_chunks(rows, providers.HashEmbedder(8), None)
    assert [r.document_id for r in embedded.collect()] == ["a", "b"] and not failed.take(1)


def test_streamed_documents_are_ingested(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    store = store_of(spark, tmp_path / "store")

    def build(batch):
        made = batch.select(F.concat("d", "v").alias("chunk_id"), F.col("d").alias("document_id"), F.col("d").alias("parent_id"), F.col("v").alias("version"), F.lit(0).alias("chunk_index"), F.lit(None).cast("date").alias("effective_date"), F.lit(None).cast("date").alias("effective_until"), F.lit(True).alias("is_actual"), F.lit("t").alias("text"))
        return made, batch.select(F.col("d").alias("document_id"), F.col("v").alias("version"), F.lit("T").alias("source_title"), F.lit(True).alias("is_active"), F.lit("now").alias("created_at"))

    def feed(name, rows):
        (tmp_path / "in" / name).write_text("\n".join(json.dumps({"d": d, "v": v}) for d, v in rows))
        stream = spark.readStream.schema("d string, v string").json(f"{tmp_path}/in")
        ingest_stream(stream, build, store, f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()

    def state():
        now = store.begin()
        return sorted(x.chunk_id for x in now.read("points").collect()), {(x.document_id, x.version): x.is_active for x in now.read("registry").collect()}

    feed("1.json", [("a", "v1"), ("b", "v1")])
    feed("2.json", [("a", "v2"), ("b", "v2"), ("b", "v3")])  # two versions of one document in a batch
    want = ["av2", "bv3"], {("a", "v1"): False, ("a", "v2"): True, ("b", "v1"): False, ("b", "v2"): False, ("b", "v3"): True}
    assert state() == want
    # killed after the version was published and before the stream notes the batch: the replay changes nothing
    real = tables.Snapshot.commit

    def dies(self, *args):
        real(self, *args)
        raise RuntimeError("killed")

    monkeypatch.setattr(tables.Snapshot, "commit", dies)
    with pytest.raises(Exception, match="killed"):
        feed("3.json", [("a", "v4")])
    monkeypatch.undo()
    number, after = store.begin().number, state()
    assert after[1][("a", "v2")] is False and after[0] == ["av4", "bv3"]
    feed("4.json", [("c", "v1")])
    assert store.begin().number == number + 1 and state()[0] == ["av4", "bv3", "cv1"]


class Unsure(providers.QuoteEnricher):
    """Answers that break the contract at first, and never any for some texts."""

    def __init__(self):
        self.asked = {}

    def enrich(self, text):
        self.asked[text] = self.asked.get(text, 0) + 1
        if "never" in text:
            return json.dumps({"synthetic_title": "", "hypothetical_questions": []})
        return super().enrich(text) if self.asked[text] > 1 else "no JSON"


def document(d, version, text, category="authorial", topics=()):
    return (d, version, category, "S", "both", list(topics), date(2026, 1, 1), text)


DOCUMENTS = "document_id string, version string, category string, source_title string, audience string, topics array<string>, effective_date date, raw_text string"


def test_service_from_documents_to_answers(spark, tmp_path, monkeypatch):
    store = service.open_store(spark, f"file://{tmp_path}/store", 4)
    day = F.lit("2026-01-02").cast("date")
    rows = [
        document("a", "v1", "# One\nalpha beta\n# Two\ngamma"), document("b", "v1", "old words"), document("b", "v2", "delta alpha"), document("c", "v1", "never"),
        document("e", "v1", " "), document("f", "v1", "x", "labor_code", ["t"]), document("g", "v1", "\n\n".join(["word " * 390] * 4)), document("n", "v1", None), document("z", "v1", "ЧАСТЬ ПЕРВАЯ"),
    ]
    done = service.ingest(store, spark.createDataFrame(rows, DOCUMENTS), Unsure(), providers.LetterEmbedder(26), day, calls=(1, 1), max_chunks=3)
    reasons = {r.document_id: r.reason for r in done.refused.collect()}
    assert reasons == {"c": "no title", "e": "empty text", "n": "empty text", "f": "topics not allowed for category", "g": "too many chunks", "z": "no chunks"}
    now = store.begin()
    points = now.read("points").collect()
    assert sorted((p.document_id, p.version, p.section_title, p.text) for p in points) == [("a", "v1", "Two", "gamma"), ("b", "v2", "b", "delta alpha")]  # sections without a number share their id
    assert {(r.document_id, r.version): r.is_active for r in now.read("registry").collect() if r.document_id == "b"} == {("b", "v1"): False, ("b", "v2"): True}
    asked = spark.createDataFrame([(1, "alpha delta", None, None, None, 3), (2, "\n\t", None, None, None, 3), (3, "zzz", "seeker", None, "case_law", None), (4, "—", None, None, None, 3)], "query_id int, query string, audience string, topic string, category string, top_k int")
    answers = service.search(now, asked, providers.SameQuery(), providers.LetterEmbedder(26), providers.OverlapReranker())
    found = {(r.query_id, r.position): r.document_id for r in answers.results.collect()}
    assert found[(1, 1)] == "b"
    assert {r.query_id: (r.outcome, r.error) for r in answers.outcomes.collect()} == {1: ("ok", None), 3: ("empty", None), 4: ("error", "empty vector")}
    assert [tuple(r) for r in answers.refused.collect()] == [(2, "empty query")]
    assert answers.counts == {"variants": 3, "unplaced": 1, "dense": 2, "question": 6, "sparse": 1, "fused": 2, "results": 1}
    logged = service.log_rows(answers, asked.withColumn("request_id", F.col("query_id").cast("string")), F.current_timestamp()).collect()
    one = next(r for r in logged if r.request_id == "1")
    assert len(logged) == 2 and one.query_variants == ["alpha delta"] and len(one.dense_candidates) == 8 and [c.chunk_id for c in one.rrf_candidates][0] == one.reranked_chunk_ids[0]
    assert json.loads(one.final_response)["chunks"][0]["chunk_id"] == one.reranked_chunk_ids[0]
    answers.release()
    # another writer publishes in between: the ingest begins again from the new version
    real, raced = tables.Snapshot.commit, []

    def slower(self, *args, **kwargs):
        if not raced:
            raced.append(1)
            real(store.begin(), {})
        return real(self, *args, **kwargs)

    monkeypatch.setattr(tables.Snapshot, "commit", slower)
    service.ingest(store, spark.createDataFrame([document("h", "v1", "omega")], DOCUMENTS), providers.QuoteEnricher(), providers.LetterEmbedder(26), day, calls=(None, None))
    monkeypatch.undo()
    later = store.begin()
    assert {"a", "b", "h"} <= {r.document_id for r in later.read("points").collect()} and later.read("postings").where("token = 'omega'").count() == 1


def test_an_ingest_asks_tokenizes_and_writes_points_once(spark, tmp_path, monkeypatch):
    """Answers are read once, chunks tokenized once, and points written once besides the table that they are made in."""
    tokenized, read, real = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0), (index.indexed, enrichment.parse_enrichment)

    def counted(rows, seen):
        def run(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        return rows.mapInArrow(run, rows.schema)

    monkeypatch.setattr(index, "indexed", lambda rows: real[0](counted(rows, tokenized)))
    monkeypatch.setattr(enrichment, "parse_enrichment", lambda rows: real[1](counted(rows, read)))
    store = service.open_store(spark, str(tmp_path / "store"), 4)
    rows, of = [document(f"d{i}", "v1", f"alpha beta {i}") for i in range(9)], (providers.QuoteEnricher(), providers.LetterEmbedder(26), F.lit("2026-01-02").cast("date"))
    for n in (1, 2):
        service.ingest(store, spark.createDataFrame(rows, DOCUMENTS), *of, calls=(None, None)).release()
        assert (tokenized.value, read.value) == (9 * n, 9 * n)
    now = store.begin()
    kept = {(r.token, r.tf): r.n for r in now.read("frequencies").collect()}
    assert kept == {(r.token, r.tf): r.n for r in index.frequencies(now.read("postings")).collect()} and kept[("alpha", 1.0)] == 9


def test_settled_points_are_not_shuffled(spark, tmp_path, monkeypatch):
    """As without the promise, whichever keys are few; where none are, by a shuffle."""
    old = points(spark, *[(f"{d}{i}", d, "v1", i, "x") for d in "abcd" for i in range(2)], ("a9", "a", "v2", 9, "orphan"))
    new = points(spark, ("n0", "a", "v2", 0, "new"), ("n1", "a", "v2", 1, "new"), ("b0", "b", "v1", 0, "again"), ("e0", "e", "v1", 0, "first"))
    rows = spark.createDataFrame([(d, v, "T", True, "t2") for d, v in (("a", "v1"), ("a", "v2"), ("b", "v1"), ("e", "v1"))], REGISTRY)
    registry = spark.createDataFrame([(d, "v1", "T", True, "t1") for d in "abcd"], REGISTRY)
    for name, df in {"old": old, "new": new}.items():
        df.write.parquet(str(tmp_path / name))
    old, new = (spark.read.schema(POINTS).parquet(str(tmp_path / name)) for name in ("old", "new"))
    brief = lambda found: [sorted(map(str, df.collect())) for df in found]
    for purge in (False, True):
        want = brief(lifecycle.ingest_documents(old, registry, new, rows, purge))
        for few, wide in ((100, False), (0, True)):
            monkeypatch.setattr(lifecycle, "FEW_KEYS", few)
            found = lifecycle.ingest_documents(old, registry, new, rows, purge, settled=True)
            assert brief(found) == want
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
            try:
                plan = lifecycle.ingest_documents(old, registry, new, rows, purge, settled=True)[0]._jdf.queryExecution().sparkPlan().toString()
            finally:
                spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
            assert ("BroadcastHashJoin [chunk_id" not in plan) == wide


class Fiftieth:
    """Takes the candidate that has the word, wherever it stands."""

    def rerank(self, query, candidates, top):
        assert all(len(c) <= 2500 for c in candidates)
        return [i for i, c in enumerate(candidates, 1) if "needle" in c]


def test_all_candidates_reach_the_reranker(spark, tmp_path):
    store = service.open_store(spark, f"file://{tmp_path}/store", 2)
    kinds = ("labor_code", "case_law", "federal_law", "other_npa", "authorial")
    # many ways to be found: 60 documents with texts of few letters
    texts = ["alpha beta " + " ".join(chr(97 + (i * j) % 26) * (1 + i % 5) for j in range(1, 4)) + (" needle" if i == 53 else "") + " tail" * (900 if i == 7 else 1) for i in range(60)]
    rows = [document(f"d{i}", "v1", t, kinds[i % 5]) for i, t in enumerate(texts)]
    service.ingest(store, spark.createDataFrame(rows, DOCUMENTS), providers.QuoteEnricher(), providers.LetterEmbedder(26), F.lit("2026-01-02").cast("date"), calls=(None, None)).release()
    asked = spark.createDataFrame([(1, "alpha beta", None, None, kinds[53 % 5], 3), (2, "alpha beta tail", None, None, None, 3)], "query_id int, query string, audience string, topic string, category string, top_k int")
    answers = service.search(store.begin(), asked, providers.HalfQuery(), providers.LetterEmbedder(26), Fiftieth(), depths=search.Depths(60, 60, 60, 60, 60, 60))
    ranks = {(r.query_id, r.chunk_id): r["rank"] for r in answers.candidates.collect()}
    got = {r.query_id: (r.position, r.document_id, r.chunk_id) for r in answers.results.collect()}
    assert {q: x[:2] for q, x in got.items()} == {1: (1, "d53"), 2: (1, "d53")}
    assert sum(q == 2 for q, _ in ranks) >= 60 and ranks[2, got[2][2]] > 20
    answers.release()


def test_service_updates_sections(spark, tmp_path):
    store = service.open_store(spark, f"file://{tmp_path}/store", 4)
    day = F.lit("2026-01-02").cast("date")
    of = (providers.QuoteEnricher(), providers.LetterEmbedder(26), day, (None, None))
    law = [document("law", "v1", "Статья 1. Alpha\nold alpha\nСтатья 2. Beta\nold beta", "labor_code")]
    service.ingest(store, spark.createDataFrame(law, DOCUMENTS), of[0], of[1], of[2], calls=of[3])
    kind = "document_id string, section_number string, section_title string, version string, category string, source_title string, audience string, topics array<string>, effective_date date, raw_text string"
    rows = [("law", "1", "Alpha", "v2", "labor_code", "S", "both", [], date(2026, 2, 1), "new alpha"), ("law", "1", "Alpha", "v2", "labor_code", "S", "both", [], date(2026, 1, 9), "an older text"),
            ("law", "2", "Beta", "v2", "authorial", "S", "both", [], date(2026, 2, 1), "x"), ("law", None, "Beta", "v2", "labor_code", "S", "both", [], date(2026, 2, 1), "x")]
    done = service.update_sections(store, spark.createDataFrame(rows, kind), *of)
    assert [(r.section_number, r.chunks_count, r.superseded_chunks) for r in done.report.collect()] == [("1", 1, 1)]
    assert sorted((r.section_number or "", r.reason) for r in done.refused.collect()) == [("", "no section number"), ("2", "section update not allowed for category")]
    now = store.begin()
    assert sorted((p.parent_id, p.version, p.text, p.is_actual, p.effective_until) for p in now.read("points").collect()) == [
        ("law:1", "v1", "old alpha", False, date(2026, 2, 1)), ("law:1", "v2", "new alpha", True, None), ("law:2", "v1", "old beta", True, None)]
    assert sorted((r.token, r.tf) for r in now.read("postings").collect()) == [("alpha", 1.0), ("alpha", 1.0), ("beta", 1.0), ("new", 1.0), ("old", 1.0), ("old", 1.0)]
    good, bad = service.read_requests(spark.createDataFrame([(1, '{"query": "old beta", "top_k": 2}'), (2, "["), (3, None), (4, '{"query": "x", "category": "poems"}')], "query_id int, body string"))
    assert sorted((r.query_id, r.reason) for r in bad.collect()) == [(2, "not a request"), (3, "not a request"), (4, "unknown category")]
    found = service.search(now, good, providers.SameQuery(), providers.LetterEmbedder(26), providers.OverlapReranker())
    body = json.loads(service.responses(found).first().response)
    assert [c["text"] for c in body["chunks"]] == ["old beta"] and body["chunks"][0]["section_number"] == "2"


def test_a_provider_s_rate_is_shared(spark):
    class Slow(providers.LetterEmbedder):
        rate = 20.0

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    df = spark.createDataFrame([(i, "ab") for i in range(12)], "query_id int, query string")
    start = datetime.now()
    assert enrichment.embed_queries(df, Slow(2), 1).where("vector is not null").count() == 12
    assert (datetime.now() - start).total_seconds() > 11 / 20


def test_calls_in_flight_keep_their_order(spark):
    class Slow:
        dims = 2

        def embed(self, texts):
            time.sleep(0.05)
            if texts[0] == "7":
                raise providers.ContentError("seven")
            return [[float(texts[0]), 1.0]]

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    df = spark.createDataFrame([(i, str(i)) for i in range(60)], "query_id int, query string").coalesce(1)
    enrichment.embed_queries(df.limit(1), Slow(), 1, 1).collect()
    start = time.perf_counter()
    rows = enrichment.embed_queries(df, Slow(), None, 10).collect()
    assert time.perf_counter() - start < 2  # one after the other they take three seconds
    assert [(r.query_id, r.vector) for r in rows] == [(i, None if i == 7 else [float(i), 1.0]) for i in range(60)] and rows[7].error == "seven"


def test_streamed_documents_are_found(spark, tmp_path):
    """The stream keeps the term index and its counts in step with the points."""
    (tmp_path / "in").mkdir()
    store = service.open_store(spark, f"file://{tmp_path}/store", 4)
    day = F.lit("2026-01-02").cast("date")
    service.ingest(store, spark.createDataFrame([document("d1", "v1", "alpha beta gamma"), document("d2", "v1", "alpha")], DOCUMENTS), providers.QuoteEnricher(), providers.LetterEmbedder(26), day, calls=(None, None)).release()

    def build(batch):
        kept = store.begin().read("points").where("false")
        blank = {f.name: F.lit(None).cast(f.dataType) for f in kept.schema}
        made = blank | {"chunk_id": F.concat("d", F.lit("-new")), "document_id": F.col("d"), "parent_id": F.col("d"), "version": F.lit("v2"), "chunk_index": F.lit(0), "category": F.lit("authorial"), "is_actual": F.lit(True), "text": F.col("t")}
        row = {f.name: F.lit(None).cast(f.dataType) for f in store.begin().read("registry").schema} | {"document_id": F.col("d"), "version": F.lit("v2"), "is_active": F.lit(True)}
        return batch.select(*[v.alias(k) for k, v in made.items()]), batch.select(*[v.alias(k) for k, v in row.items()])

    (tmp_path / "in" / "1.json").write_text(json.dumps({"d": "d1", "t": "delta epsilon delta"}))
    stream = spark.readStream.schema("d string, t string").json(f"{tmp_path}/in")
    ingest_stream(stream, build, store, f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    now = store.begin()
    assert sorted((r.chunk_id[:6], r.token, r.tf) for r in now.read("postings").where("document_id = 'd1'").collect()) == [("d1-new", "delta", 2.0), ("d1-new", "epsilon", 1.0)]
    counts = sorted(map(tuple, now.read("frequencies").collect()))
    assert counts == sorted(map(tuple, index.frequencies(now.read("postings")).collect())) == [("alpha", 1.0, 1), ("delta", 2.0, 1), ("epsilon", 1.0, 1)]
    asked = spark.createDataFrame([(1, "delta gamma", None, None, None)], "query_id int, query string, audience string, topic string, category string")
    found = search.sparse_best(now.read("points"), now.read("postings"), now.read("frequencies"), asked, 2, 20)
    assert [r.chunk_id for r in found.collect()] == ["d1-new"]


def test_bodies(spark):
    good = {"document_id": "d", "category": "authorial", "raw_text": "x", "source_title": "S", "audience": "both", "version": "v", "effective_date": "2026-01-02", "topics": ["t"], "more": {"a": 1}}
    cases = [
        good, {**good, "topics": None}, {k: v for k, v in good.items() if k != "topics"}, {}, {**good, "document_id": "", "raw_text": 5, "version": None}, {**good, "topics": [1], "audience": "all"}, {**good, "topics": "t"},
        {**good, "effective_date": "02.01.2026"}, {**good, "effective_date": "2026-13-01"}, {**good, "raw_text": "x" * 2_000_001}, {**good, "topics": []}, {**good, "topics": ["t", None]},
    ]
    rows = [(i, json.dumps(x)) for i, x in enumerate(cases)] + [(100, "["), (101, None), (102, "[]"), (103, '"x"')]
    documents, refused = bodies.read_ingests(spark.createDataFrame(rows, "request_id int, body string"))
    assert {r.request_id: (r.document_id, r.topics, r.effective_date) for r in documents.collect()} == {i: ("d", ["t"] if i == 0 else [], date(2026, 1, 2)) for i in (0, 2, 10)}
    missing = [f"{f}: missing" for f in ("document_id", "category", "raw_text", "source_title", "audience", "version", "effective_date")]
    assert {r.request_id: r.problems for r in refused.collect()} == {
        1: ["topics: not a list of strings"], 3: missing, 4: ["document_id: empty", "raw_text: not a string", "version: not a string"], 5: ["audience: unknown", "topics: not a list of strings"], 6: ["topics: not a list of strings"],
        7: ["effective_date: not a date"], 8: ["effective_date: not a date"], 9: ["raw_text: too long"], 11: ["topics: not a list of strings"], **{i: ["not an object"] for i in (100, 101, 102, 103)}}
    section = {k: v for k, v in good.items() if k != "document_id"} | {"section_title": ""}
    given = spark.createDataFrame([(1, "law", "5", json.dumps(section)), (2, "law", "5", json.dumps(section | {"section_title": "T"}))], "request_id int, document_id string, section_number string, body string")
    made, refused = bodies.read_section_updates(given)
    assert [(r.document_id, r.section_number, r.section_title) for r in made.collect()] == [("law", "5", "T")] and refused.first().problems == ["section_title: empty"]
    report = spark.createDataFrame([("d", "v", 2, ["u"])], "document_id string, version string, chunks_count int, replaced_versions array<string>")
    assert json.loads(bodies.ingest_responses(report).first().response) == {"document_id": "d", "version": "v", "chunks_count": 2, "replaced_versions": ["u"], "not_removed_versions": []}


def test_entry_works_without_the_training_operators():
    """With the subpackage and the pipeline hidden, the entry point imports and offers the engine's queries."""
    root = Path(__file__).resolve().parent.parent
    code = (
        "import sys, importlib.util as u; real = u.find_spec\n"
        "def hidden(name, *a):\n"
        "    if name.startswith('lexmill.llm') or name == 'corpus_pipeline': raise ModuleNotFoundError(name)\n"
        "    return real(name, *a)\n"
        "u.find_spec = hidden\n"
        "import __spark_entry__ as e; q = e.queries(); assert 'hybrid_search' in q and not [n for n in q if n.startswith('op') and n[2].isdigit()]\n"
        "assert 'lexmill.llm' not in sys.modules and set(e.oracle_sql()) <= set(q)"
    )
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
