import datetime as dt
import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from wideloom.operators import runlog, similarity
from wideloom.plans.flow import Stages, feedback_row
from wideloom.sources import store, tables, workbook

NOW = dt.datetime(2024, 5, 1, 12)


def entry(i, table="models", minute=0, **payload):
    return {"id": f"m{i}", "table_name": table, "project_id": "p1", "source_agent": "a", "timestamp": NOW + dt.timedelta(minutes=minute), "payload": payload}


# Files -----------------------------------------------------------------------------------------

def test_csv_types_tokens_and_quotes(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('a,b,c,d,"e ""x"".y",f\n1,1.5,True,x,"p, q",NA\n2,NA,False,NA,"say ""hi""",\n3,2e3,True,null,z,n/a\n', encoding="utf-8")
    df = tables.read_table(spark, str(path))
    assert [t for _, t in df.dtypes] == ["bigint", "double", "boolean", "string", "string", "double"]
    assert [tuple(r) for r in df.collect()] == [(1, 1.5, True, "x", "p, q", None), (2, None, False, None, 'say "hi"', None), (3, 2000.0, True, None, "z", None)]


def test_csv_encoding_falls_back_to_latin1(spark, tmp_path):
    (tmp_path / "u.csv").write_bytes("name\ncafé\n".encode("utf-8"))
    (tmp_path / "l.csv").write_bytes("name\ncafé\n".encode("latin-1"))
    for f, enc in (("u.csv", "UTF-8"), ("l.csv", "ISO-8859-1")):
        assert tables.csv_encoding(spark, str(tmp_path / f)) == enc
        assert tables.read_table(spark, str(tmp_path / f)).head()[0] == "café"


def test_csv_cells_over_lines(spark, tmp_path):
    (tmp_path / "n.csv").write_text('a,b\n1,"x\ny"\n2,z\n')
    assert tables.csv_traits(spark, str(tmp_path / "n.csv")) == ("UTF-8", True)
    assert [tuple(r) for r in tables.read_table(spark, str(tmp_path / "n.csv")).collect()] == [(1, "x\ny"), (2, "z")]


def test_csv_with_a_given_schema(spark, tmp_path):
    (tmp_path / "s.csv").write_text("a,b\n1,2\n")
    assert tables.read_table(spark, str(tmp_path / "s.csv"), schema="a int, b double").dtypes == [("a", "int"), ("b", "double")]


def test_dispatch_refuses_what_it_cannot_read(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        tables.read_table(spark, str(tmp_path / "none.csv"))
    (tmp_path / "x.xls").write_text("")
    with pytest.raises(ValueError):
        tables.read_table(spark, str(tmp_path / "x.xls"))


def book(sheets):
    """A workbook of one sheet with shared, inline, number and boolean cells."""
    shared: list[str] = []
    body = []
    for i, row in enumerate(sheets, 1):
        cells = []
        for j, v in enumerate(row):
            at = f"{chr(65 + j)}{i}"
            if v is None:
                continue
            if isinstance(v, bool):
                cells.append(f'<c r="{at}" t="b"><v>{int(v)}</v></c>')
            elif isinstance(v, (int, float)):
                cells.append(f'<c r="{at}"><v>{v}</v></c>')
            elif v.startswith("="):
                cells.append(f'<c r="{at}" t="inlineStr"><is><t>{v[1:]}</t></is></c>')
            else:
                shared.append(v)
                cells.append(f'<c r="{at}" t="s"><v>{len(shared) - 1}</v></c>')
        body.append(f'<row r="{i}">{"".join(cells)}</row>')
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} {rel}><sheets><sheet name="S" sheetId="1" r:id="rId7"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId7" Target="worksheets/first.xml"/></Relationships>')
        z.writestr("xl/worksheets/first.xml", f'<worksheet {ns}><sheetData>{"".join(body)}</sheetData></worksheet>')
        z.writestr("xl/sharedStrings.xml", f'<sst {ns}>{"".join(f"<si><t>{s}</t></si>" for s in shared)}</sst>')
    return out.getvalue()


def test_workbook_folder(spark, tmp_path):
    folder = tmp_path / "books.xlsx"
    folder.mkdir()
    (folder / "a.xlsx").write_bytes(book([["id", "name", "ok"], [1, "ann", True], [2, "=bo", False]]))
    (folder / "b.xlsx").write_bytes(book([["name", "id", "extra"], ["cy", 3, 1.5], [None, 4, "NA"]]))
    df = tables.read_table(spark, str(folder))
    assert dict(df.dtypes) == {"id": "bigint", "name": "string", "ok": "boolean", "extra": "double"}
    assert sorted(tuple(r) for r in df.select("id", "name", "ok", "extra").collect()) == [
        (1, "ann", True, None), (2, "bo", False, None), (3, "cy", None, 1.5), (4, None, None, None)]
    assert workbook.scan_workbooks(spark, str(folder)).count() == 6


def test_store_and_catalogue(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", 1.5), (2, "y", None), (3, None, 2.5)], "A int, B string, C double")
    path = store.store_table(df, str(tmp_path), "toy", project_id="p1", when=NOW)
    assert store.load_table(spark, path).exceptAll(df).count() == 0
    row = store.catalogue(runlog.read_log(spark, f"{tmp_path}/log")).head()
    assert (row["name"], row["n_rows"], row["path"]) == ("toy", 3, path)
    assert runlog.runs_with_schema(store.catalogue(runlog.read_log(spark, f"{tmp_path}/log")), df).count() == 1


def test_fingerprint_ignores_order_but_not_copies(spark):
    df = spark.range(100).select("id", (F.col("id") % 7).alias("v"))
    base = store.table_fingerprint(df).head()
    assert store.table_fingerprint(df.orderBy(F.desc("id")).repartition(5)).head() == base
    assert store.table_fingerprint(df.unionAll(df.limit(1))).head() != base
    assert store.table_fingerprint(df.limit(0)).head()["fingerprint"] == 0


# Log -------------------------------------------------------------------------------------------

def test_log_roundtrip_replace_and_delete(spark, tmp_path):
    path = str(tmp_path / "log")
    runlog.append(runlog.log_rows(spark, [entry(1, kind="model", n=[1, 2]), entry(2, kind="data")]), path)
    runlog.append(runlog.log_rows(spark, [entry(1, minute=5, kind="model", n=[3])]), path)
    log = runlog.read_log(spark, path)
    assert log.count() == 3 and runlog.live(log).count() == 2
    assert runlog.get(log, "m1").head()["payload"] == '{"kind": "model", "n": [3]}'
    gone = runlog.tombstones(log, ["m1", "nothing"])
    assert gone.count() == 1
    after = log.unionByName(gone)
    assert [r["id"] for r in runlog.live(after).collect()] == ["m2"] and runlog.get(after, "m1").count() == 0


def test_log_filters(spark):
    log = runlog.log_rows(spark, [entry(1, minute=1, type="model", acc=0.8, agent="a"), entry(2, minute=2, type="model", acc=0.9), entry(3, minute=3, type="cleaning", ok=True)])
    ids = lambda **kw: [r["id"] for r in runlog.query(log, "models", **kw).collect()]
    assert ids(filters={"type": "model"}) == ["m2", "m1"] and ids(filters={"acc": [0.8, 0.7]}) == ["m1"]
    assert ids(filters={"ok": True}) == ["m3"] and ids(filters={"nope": 1}) == []
    assert ids(filters={"type": "model"}, limit=1) == [] and ids(filters={"type": "model"}, limit=1, limit_after_filter=True) == ["m2"]
    assert ids(project_id="other") == [] and ids(limit=2) == ["m3", "m2"]


def test_log_stats_of_empty_and_full(spark):
    empty = runlog.log_rows(spark, [])
    assert runlog.table_stats(empty).count() == 0
    assert {r["table_name"]: r["entries"] for r in runlog.memory_stats(empty).collect()} == dict.fromkeys(runlog.MAIN_TABLES, 0)
    full = runlog.log_rows(spark, [entry(i, "feature_history", i) for i in range(3)])
    assert runlog.table_stats(full).head()["entries"] == 3


def test_entries_of_the_stages(spark):
    made = [runlog.dataset_profile_entry("p", NOW, {"rows": 5}), runlog.feature_entry("p", NOW, "f", 0.1),
            runlog.feature_entry("p", NOW, "g", 0.0), runlog.model_entry("p", NOW, "forest", {"f1": 0.5})]
    log = runlog.log_rows(spark, [m[0] for m in made])
    texts = runlog.text_rows(spark, [{**m[1], "embedding": [1.0, float(i)]} for i, m in enumerate(made)])
    assert {r["table_name"]: r["entries"] for r in runlog.memory_stats(log, texts).collect()} == {
        "past_projects": 1, "user_preferences": 0, "feature_history": 2, "model_performance": 1, "text_entries": 4}
    assert [t.tags for t in texts.where("id = 'p-g-text'").collect()] == [["feature_engineering", "failed_feature"]]
    assert {r["id"] for r in runlog.canned_search(texts, "successful_features", [1.0, 1.0]).collect()} == {"p-f-text", "p-g-text"}


def test_run_views(spark):
    t = lambda m: NOW + dt.timedelta(minutes=m)
    log = spark.createDataFrame([("s", "ingestion", True, t(0)), ("s", "profiling", False, t(1)), ("s", "profiling", True, t(3)), ("r", "ingestion", False, t(0))],
                                "session string, phase string, success boolean, ts timestamp")
    got = {r["session"]: (r["completed"], r["progress_pct"], r["failed"]) for r in runlog.progress(log).collect()}
    assert got == {"s": (2, 25.0, ["profiling"]), "r": (0, 0.0, ["ingestion"])}
    assert {r["session"]: r["seconds"] for r in runlog.elapsed(log).collect()} == {"s": 180.0, "r": 0.0}
    assert sorted(tuple(r) for r in runlog.missing_prerequisites(log, "cleaning").collect()) == [("r", "ingestion"), ("r", "profiling")]


def test_stage_rollback_and_resume(spark, tmp_path):
    stages = Stages(spark, str(tmp_path), "run1")
    frame = lambda v: spark.createDataFrame([(v,)], "v int")
    for stage, v in (("ingestion", 1), ("cleaning", 2), ("features", 3)):
        stages.save(stage, frame(v))
    assert stages.last_stage() == "features" and stages.rollback("cleaning").head()[0] == 2
    assert Stages(spark, str(tmp_path), "run1").last_stage() == "cleaning"
    with pytest.raises(KeyError):
        stages.load("features")
    stages.save("features", frame(4))
    assert stages.load("features").head()[0] == 4 and stages.load("ingestion").head()[0] == 1
    assert feedback_row(spark, "run1", "cleaning", "keep it", {"skip": "x"}).head()["overrides"] == {"skip": "x"}


# Neighbours ------------------------------------------------------------------------------------

def brute(vectors, k):
    v = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    s = np.round(v @ v.T, 12)
    np.fill_diagonal(s, -np.inf)
    return {i: [int(j) for j in np.lexsort((np.arange(len(v)), -s[i]))[:k]] for i in range(len(v))}


@pytest.mark.parametrize("kw", [{}, {"broadcast_bytes": 0, "block_rows": 9}])
def test_nearest_is_exact_with_many_copies(spark, kw):
    rng = np.random.default_rng(2)
    vectors = np.round(rng.normal(size=(60, 4)), 2)
    vectors[20:40] = vectors[20]
    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id int, embedding array<double>")
    got = similarity.nearest(base.withColumnRenamed("id", "query_id"), base, 3, exclude_self=True, **kw)
    found: dict = {}
    for r in sorted(got.collect(), key=lambda r: r["rank"]):
        found.setdefault(r["query_id"], []).append(r["id"])
    assert found == brute(vectors, 3)


def test_search_edges(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0], ["t"]), ("b", [0.0, 0.0], ["t"]), ("c", [-1.0, 0.0], ["u"]), ("d", None, ["t"])],
                               "id string, embedding array<float>, tags array<string>")
    assert [(r["id"], r["score"]) for r in similarity.search(df, [2.0, 0.0]).collect()] == [("a", 1.0), ("c", -1.0)]
    assert [r["id"] for r in similarity.search(df, [2.0, 0.0], tags=["u"]).collect()] == ["c"]
    none = df.limit(0).withColumnRenamed("id", "query_id")
    assert similarity.nearest(none, df, 2).count() == 0
    assert similarity.nearest(df.withColumnRenamed("id", "query_id"), df.limit(0), 2).count() == 0


def test_fingerprint_tells_nulls_and_borders(spark):
    rows = [[(None, "z")], [("", "z")], [("x|y", "z")], [("x", "y|z")]]
    assert len({store.table_fingerprint(spark.createDataFrame(r, "a string, b string")).head()["fingerprint"] for r in rows}) == 4


def test_json_filter_values(spark):
    from wideloom.operators.runlog import matches
    df = spark.createDataFrame([('{"a": null, "k.x": 5, "n": 5.0, "t": true, "s": "q"}',), ("{}",)], "payload string")
    for f, n in (({"a": None}, 1), ({"n": 5}, 1), ({"k.x": 5.0}, 1), ({"t": True}, 1), ({"s": ["p", "q"]}, 1), ({"missing": None}, 0), ({"s": 5}, 0)):
        assert df.where(matches("payload", f)).count() == n, f


def test_vectors_of_other_lengths_are_not_compared(spark):
    from wideloom.operators.similarity import nearest
    base = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0, 5.0, 5.0]), (3, [1.0, 0.0, 0.0])], "id bigint, embedding array<double>")
    q = spark.createDataFrame([(7, [1.0, 0.0, 0.0]), (8, [2.0, 0.0])], "query_id bigint, embedding array<double>")
    got = sorted((r["query_id"], r["id"], r["score"]) for r in nearest(q, base, 5).collect())
    assert got == [(7, 3, 1.0), (8, 1, 1.0)]


def test_large_counts_do_not_overflow(spark):
    from wideloom.operators import evaluate
    s = spark.createDataFrame([(1, 0.9)], "label int, score double")
    assert evaluate.curve_areas(s).count() == 1
    big = spark.sql("SELECT CAST(100000000000 AS BIGINT) AS neg, CAST(100000000000 AS BIGINT) AS c")
    assert big.selectExpr("sum(CAST(neg AS DOUBLE) * (c + c) / 2.0) AS a").head()["a"] == 1e22


def test_checksums_are_of_all_bytes_in_order(spark, tmp_path, monkeypatch):
    """Files larger than a part of a read, with and without a last line feed, marks and packed bytes."""
    import gzip
    import hashlib
    rng = np.random.default_rng(2)
    mark = b"\xef\xbb\xbf"
    files = {"big": rng.integers(0, 256, 3_000_000, np.uint8).tobytes(), "fed": b"a\r\nb\n\n", "open": b"a\nb", "feed": b"\n", "mark": mark, "marked": mark + b"x\ny",
             "marked_fed": mark + b"\nx\n", "long": b"z" * 500_000 + b"\n" + bytes(range(256)) * 9, "t.gz": gzip.compress(b"some text\n" * 99), "a b%20[c].bin": b"\r\x00\xff"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    monkeypatch.setattr(store, "BATCH_BYTES", 4_000)
    sizes = "spark.sql.files.maxPartitionBytes"
    spark.conf.set(sizes, "70000")
    try:
        found = store.file_checksums(spark, f"{tmp_path}/*")
        assert spark.conf.get(sizes) == "70000"
        rows = found.collect()
    finally:
        spark.conf.unset(sizes)
    assert {r["file"]: (r["length"], r["md5"]) for r in rows} == {n: (len(d), hashlib.md5(d).hexdigest()) for n, d in files.items()} and len(rows) == len(files)
    empty = tmp_path / "empty"
    empty.mkdir()
    (empty / "e").write_bytes(b"")   # listed by no reader
    assert store.file_checksums(spark, str(empty)).collect() == []


def test_checksums_hold_no_file_whole(spark, tmp_path, monkeypatch):
    """Python sees a file in batches that add up to it, each far smaller."""
    (tmp_path / "big").write_bytes(np.random.default_rng(2).integers(0, 256, 3_000_000, np.uint8).tobytes())
    monkeypatch.setattr(store, "BATCH_BYTES", 40_000)
    most = spark.sparkContext.accumulator(0)
    digests = store._digests

    def looked(batches):
        def each():
            for batch in batches:
                most.add(int(batch.column(2).nbytes > 400_000))
                yield batch
        return digests(each())
    monkeypatch.setattr(store, "_digests", looked)
    assert store.file_checksums(spark, str(tmp_path)).count() == 1 and most.value == 0
