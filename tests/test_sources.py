from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from cohortflow.operators import fingerprint, idmap, readiness, validate
from cohortflow.sources import files, landed, sinks, tables


def test_read_by_suffix_and_matrix_cells(spark, tmp_path):
    path = tmp_path / "m.tsv"
    path.write_text("sample_id\tG.1\tG2\ns1\t1.5\tNaN\ns2\t\t4\n")
    cells = tables.read_matrices(spark, [{"path": str(path), "role": "matrix", "modality": "rna"}, {"path": "x.pdf", "role": "unknown", "modality": "rna"}])
    assert {(r.sample_id, r.feature): r.value for r in cells.collect()} == {("s1", "G.1"): 1.5, ("s1", "G2"): None, ("s2", "G.1"): None, ("s2", "G2"): 4.0}
    with pytest.raises(ValueError, match="use .parquet"):
        tables.read_table(spark, "a.xlsx")
    with pytest.raises(ValueError, match="sample_id"):
        tables.matrix_cells(spark.createDataFrame([(1.0,)], "g double"), "rna")


def test_id_and_structure_maps(spark, tmp_path):
    ids = tmp_path / "ids.csv"
    ids.write_text("modality,source_id,target_id\nprotein,P1,G1\n")
    assert tables.read_id_map(spark, str(ids)).first().target_id_type == "undeclared"
    good = tmp_path / "s.tsv"
    good.write_text("# note\nModality\tFeature_ID\tSMILES\nmet\tglucose\tC1\n\nmet\tempty\t\nmet\tglucose\tC1\n")
    assert [tuple(r) for r in tables.read_structure_map(spark, str(good)).collect()] == [("met", "glucose", "C1")]
    bad = tmp_path / "b.tsv"
    bad.write_text("modality\tfeature_id\tsmiles\nmet\tx\tC\nmet\tx\tO\n")
    with pytest.raises(ValueError, match="several structures"):
        tables.read_structure_map(spark, str(bad))


def test_id_map(spark):
    features = spark.createDataFrame([("protein", p) for p in ("P1", "P2", "P3")] + [("rna", "R1")], "modality string, source_id string")
    table = spark.createDataFrame([("protein", "P1", "G1", "gene"), ("protein", "P1", "G2", "gene"), ("protein", "P2", "G3", "gene"), ("protein", "P2", "G3", "gene")], "modality string, source_id string, target_id string, target_id_type string")
    mapped = idmap.map_features(features, table)
    assert mapped.where("modality = 'protein'").count() == 4
    s = idmap.map_summary(mapped).where("modality = 'protein'").first()
    assert (s.n_features, s.n_mapped, s.n_unmapped, s.n_ambiguous, s.n_pairs) == (3, 2, 1, 1, 3)
    assert [r.source_id for r in idmap.blocking_sources(mapped).collect()] == ["P1"]
    r1 = mapped.where("source_id = 'R1'").first()
    assert (r1.target_id, r1.target_id_type, r1.unmapped) == ("R1", "identity", False)


def test_json_path_through_lists(spark):
    doc = json.dumps({"hits": [{"e": {"gene": "G1"}}, {"e": [{"gene": "G2"}, {"gene": 7}]}, {"e": {"gene": {"x": 1}}}, {"e": {"gene": True}}]})
    out = idmap.values_at_path(spark.createDataFrame([("a", doc)], "k string, j string"), "j", ["hits", "e", "gene"], ["k"])
    assert sorted(r.value for r in out.collect()) == ["7", "G1", "G2"]


NAMES = {
    "lane.fastq.gz": "rejected_raw", "GSE1_series_matrix.txt.gz": "matrix", "counts.tsv": "matrix", "run.mzML": "rejected_raw", "a.tar.gz": "archive",
    "b.zip": "archive", "samples.tsv": "sample_sheet", "readme.pdf": "unknown", "x.fq.bz2": "rejected_raw", "data.d": "rejected_raw", "t.parquet": "matrix",
    "reads.fastq.tar.gz": "rejected_raw", "sample_matrix.parquet": "matrix",
}


def test_file_roles(spark):
    df = spark.createDataFrame([(n,) for n in NAMES], "name string")
    assert {r["name"]: r.role for r in df.select("name", files.file_role(F.col("name")).alias("role")).collect()} == NAMES


def test_requests(spark):
    rows = [
        ("a", None, "GSE12", None, None, None), ("b", None, "GDS5", None, None, None), ("c", None, "pxd1", None, None, None), ("d", None, "E-MTAB-1", None, None, None),
        ("e", "arrayexpress", "E-1", None, None, None), ("f", None, None, "http://x/y.tsv", None, None), ("g", None, None, None, "/tmp/a.tsv", None),
        ("h", None, None, None, None, "10.1/x"), ("i", None, "ZZZ", None, None, None), ("j", "sra", "SRR1", None, None, None), ("k", None, "GSM1x", None, None, None),
    ]
    df = spark.createDataFrame(rows, "id string, source string, accession string, url string, local_path string, paper_doi string")
    got = {r.id: (r.resolved, r.reject) for r in files.source_of(df).collect()}
    assert got == {
        "a": ("geo", None), "b": ("geo", "dataset_not_series"), "c": ("pride", None), "d": ("biostudies", None), "e": ("biostudies", None), "f": ("url", None),
        "g": ("local", None), "h": ("doi", None), "i": (None, "cannot_infer_source"), "j": ("sra", "source_not_served"), "k": (None, "cannot_infer_source"),
    }
    ids = df.select("id", files.dataset_id(F.lit("geo"), F.col("accession"), F.lit("dir/My File.v1.tsv")).alias("x"))
    assert {r.id: r.x for r in ids.where("id IN ('a', 'f')").collect()} == {"a": "geo_gse12", "f": "geo_my_file.v1"}


def test_url_parts(spark):
    df = spark.createDataFrame([("https://H.org/a/b%20c+d.tsv?x=1#f",), ("file:///etc/x",), ("http://h",)], "url string")
    got = {r.url: (r.scheme, r.host, r.filename, r.allowed) for r in files.url_parts(df).collect()}
    assert got["https://H.org/a/b%20c+d.tsv?x=1#f"] == ("https", "h.org", "b c+d.tsv", True)
    assert not got["file:///etc/x"][3] and got["http://h"][2] == "downloaded_file"


def test_a_matrix_of_twenty_thousand_columns(spark, tmp_path):
    """One scan and one step, whatever the width; rows are spread over tasks."""
    import numpy as np

    n, p = 12, 20_000
    values = np.random.default_rng(1).normal(size=(n, p)).round(3)
    lines = ["\t".join(["G0", "sample_id", *[f"G{j}" for j in range(1, p)]])] + ["\t".join([repr(float(v[0])), f"s{i}", *map(repr, v[1:].tolist())]) for i, v in enumerate(values)]
    (tmp_path / "wide.tsv").write_text("\n".join(lines) + "\n")
    cells = tables.read_matrices(spark, [{"path": str(tmp_path / "wide.tsv"), "role": "matrix", "modality": "rna"}])
    plan = cells._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 2000 and cells.count() == n * p
    assert cells.groupBy("sample_id").agg(F.round(F.sum("value"), 6).alias("v")).count() == n
    some = {(r.sample_id, r.feature): r.value for r in cells.where("feature IN ('G0', 'G7', 'G19999')").collect()}
    assert some == {(f"s{i}", f"G{j}"): float(values[i, j]) for i in range(n) for j in (0, 7, 19_999)}
    wide = spark.createDataFrame([("a", 1.5, float("nan"), 3), ("b", None, 2.0, None)], "sample_id string, x double, `y.z` float, w int")
    assert sorted(tuple(r) for r in tables.matrix_cells(wide, "m").select("sample_id", "feature", F.coalesce("value", F.lit(-1.0))).collect()) == [
        ("a", "w", 3.0), ("a", "x", 1.5), ("a", "y.z", -1.0), ("b", "w", -1.0), ("b", "x", -1.0), ("b", "y.z", 2.0)]
    with pytest.raises(ValueError, match="sample_id"):
        (tmp_path / "none.csv").write_text("a,b\n1,2\n")
        tables.read_matrices(spark, [{"path": str(tmp_path / "none.csv"), "role": "matrix", "modality": "rna"}])


def test_matrices_are_written_and_read(spark, tmp_path):
    cells = spark.createDataFrame([("s1", "b", 1.25), ("s1", "a", -3.0), ("s2", "b", None), ("s3", "c#", 1e-9)], "sample_id string, feature string, value double")
    sinks.write_matrix(cells, str(tmp_path / "m.tsv"))
    got = tables.read_matrices(spark, [{"path": str(tmp_path / "m.tsv"), "role": "matrix", "modality": "x"}])
    assert sorted((r.sample_id, r.feature, r.value) for r in got.where("value IS NOT NULL").collect()) == [("s1", "a", -3.0), ("s1", "b", 1.25), ("s3", "c#", 1e-9)]
    assert got.count() == 9


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    good = spark.range(100).select("id", (F.col("id") % 3).cast("string").alias("part"))
    broken = spark.range(100).select(F.when(F.col("id") == 99, F.raise_error(F.lit("late")).cast("bigint")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="late"):
        sinks.publish({"good": (good, ["part"]), "broken": (broken, [])}, str(tmp_path / "run"))
    assert list(tmp_path.iterdir()) == []
    sinks.publish({"good": (good, ["part"])}, str(tmp_path / "run"))
    assert [p.name for p in tmp_path.iterdir()] == ["run"] and spark.read.parquet(str(tmp_path / "run/good")).count() == 100
    with pytest.raises(sinks.PublishFailed, match="exists"):
        sinks.publish({"good": (good, [])}, str(tmp_path / "run"))


def test_what_is_read_back_is_compared(spark, tmp_path, monkeypatch):
    draws = spark.range(50).select(F.rand().alias("x"))
    calls = []
    monkeypatch.setattr(sinks, "_content", lambda df: calls.append(1) or [F.count("*").alias("rows"), F.lit(len(calls)).cast("decimal(38,0)").alias("hash")])
    with pytest.raises(sinks.PublishFailed, match="differs"):
        sinks.publish({"t": (draws, [])}, str(tmp_path / "run"))
    assert list(tmp_path.iterdir()) == []


def test_verify_landed(spark, tmp_path):
    for name in ("a.tsv", "b.tsv", "c.tsv"):
        (tmp_path / name).write_bytes(name.encode())
    md5 = hashlib.md5(b"a.tsv").hexdigest().upper()
    rows = [("a.tsv", None, f"MD5:{md5}", "md5"), ("b.tsv", None, "0" * 64, "sha256"), ("c.tsv", "f" * 64, None, None), ("gone.tsv", None, None, None)]
    expected = spark.createDataFrame(rows, "filename string, sha256 string, official_checksum string, official_checksum_alg string")
    digests = files.landed_digests(spark, str(tmp_path))
    assert {r.filename: r.status for r in files.verify_landed(expected, digests, 100).collect()} == {"a.tsv": "ok", "b.tsv": "official_mismatch", "c.tsv": "sha256_mismatch", "gone.tsv": "missing"}
    assert files.verify_landed(expected, digests, 2).where("status = 'too_large'").count() == 3


def test_verify_landed_by_data_set(spark, tmp_path):
    for name in ("one", "two"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "m.tsv").write_bytes(name.encode())
    digests = files.landed_digests(spark, str(tmp_path), by_dataset=True)
    rows = [(name, "m.tsv", hashlib.sha256(name.encode()).hexdigest(), None, None) for name in ("one", "two")] + [("three", "m.tsv", None, None, None)]
    expected = spark.createDataFrame(rows, "dataset_id string, filename string, sha256 string, official_checksum string, official_checksum_alg string")
    got = sorted((r.dataset_id, r.filename, r.status) for r in files.verify_landed(expected, digests, 100).collect())
    assert got == [("one", "m.tsv", "ok"), ("three", "m.tsv", "missing"), ("two", "m.tsv", "ok")]


def test_captured_text_and_taxa(spark):
    df = spark.createDataFrame([("s", "a\u0000b", " Shell "), ("s", "x", "Metadata")], "source string, text string, kind string")
    got = files.capture_text(df, "source", "text", "kind").collect()
    assert got[0].text == "ab" and got[0].refused and got[0].sha256 == hashlib.sha256(b"ab").hexdigest() and not got[1].refused
    names = spark.createDataFrame([(" Human ",), ("yeti",), (None,)], "n string")
    assert [r.taxon_id for r in files.taxon_ids(names, "n").collect()] == [9606, None, None]


def test_project_listing_layouts(spark):
    a = {"fileName": "x.raw", "fileCategory": "OTHER", "md5": "m", "fileSizeBytes": 5, "downloadLink": "http://h/x.raw"}
    b = {"filename": "t.tsv", "category": "raw", "sha256": "s", "checksum": "c", "publicFileLocations": [{"value": "ftp://h/t"}, {"value": "http://h/t"}]}
    c = {"fileName": "u.tsv", "ftpLocation": ["http://h/u"]}
    docs = [json.dumps([a]), json.dumps({"_embedded": {"files": [b]}}), json.dumps({"files": [c, {"fileName": ""}]}), json.dumps({"_embedded": [c]}), "not json", "{}"]
    out = landed.project_files(spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, j string"), "j", ["i"])
    got = {r.i: (r.filename, r.role, r.url, r.size_bytes, r.official_checksum, r.official_checksum_alg) for r in out.collect()}
    assert got == {
        0: ("x.raw", "rejected_raw", "http://h/x.raw", 5, "m", "md5"), 1: ("t.tsv", "rejected_raw", None, None, "s", "sha256"),
        2: ("u.tsv", "matrix", "http://h/u", None, None, None), 3: ("u.tsv", "matrix", "http://h/u", None, None, None),
    }


def test_study_walk(spark):
    doc = {
        "attributes": [{"name": "Title", "value": "old"}],
        "section": {
            "attributes": [{"name": "title ", "value": "new"}],
            "files": [[{"path": "/d/a.tsv", "size": 3, "attributes": [{"name": "MD5", "value": "q"}]}, {"name": "b.zip", "type": "file", "sha256": " h "}], {"name": "plain"}],
            "subsections": [{"files": [{"path": "c.fastq.gz"}]}],
        },
    }
    nodes = landed.json_nodes(spark.createDataFrame([("S-1", json.dumps(doc))], "acc string, j string"), "j", ["acc"])
    got = {r.filename: (r.role, r.url, r.size_bytes, r.official_checksum, r.official_checksum_alg) for r in landed.study_files(nodes, "acc", ["acc"]).collect()}
    base = landed.STUDY_FILES
    assert got == {
        "a.tsv": ("matrix", f"{base}/S-1/d/a.tsv", 3, "q", "md5"), "b.zip": ("archive", f"{base}/S-1/b.zip", None, "h", "sha256"),
        "c.fastq.gz": ("rejected_raw", f"{base}/S-1/c.fastq.gz", None, None, None),
    }
    attributes = {r.name: r.value for r in landed.study_attributes(nodes, ["acc"]).collect()}
    assert attributes == {"title": "new", "md5": "q"}


def test_listing_and_summaries(spark):
    html = '<a href="../">up</a><A class="x" HREF="/p/GSE1_series_matrix.txt.gz">m</A><a href="index.html">i</a><b href="no.tsv">'
    out = landed.listing_links(spark.createDataFrame([("http://h/s/", html)], "base string, html string"), "html", "base", [])
    assert [(r.filename, r.role, r.url) for r in out.collect()] == [("GSE1_series_matrix.txt.gz", "matrix", "http://h/s/GSE1_series_matrix.txt.gz")]
    summary = {"result": {"uids": ["7"], "7": {"title": "", "taxon": "Homo sapiens"}}}
    s = landed.series_summary(spark.createDataFrame([("7", "GSE1", json.dumps(summary))], "uid string, acc string, j string"), "j", "uid", "acc", []).first()
    assert (s.title, s.organism, s.abstract) == ("GEO GSE1", "Homo sapiens", "")
    hits = {"result": {"uids": ["9"], "9": {"uid": "9", "elocationid": "doi: 10.1/ab ", "title": "T", "pubdate": "2020 Jan"}}}
    h = landed.summary_hits(spark.createDataFrame([(json.dumps(hits),)], "j string"), "j", []).collect()
    assert [(r.pmid, r.doi, r.title, r.year) for r in h] == [("9", "10.1/ab", "T", "2020")]
    listed = {"resultList": {"result": [{"pmid": 5, "title": "T", "pubYear": "1999", "abstractText": "A"}]}}
    r = landed.result_list_hits(spark.createDataFrame([(json.dumps(listed),)], "j string"), "j", []).first()
    assert (r.pmid, r.doi, r.year, r.abstract) == ("5", None, "1999", "A")


def test_readiness(spark):
    d = "dataset_id string, license string, organism string, taxon_id int, sampling_design string, pairing_level string, units_reviewed boolean, sheet_state string, status string, n_unresolved int"
    i = "dataset_id string, role string, path string, sha256 string, official_checksum string"
    datasets = spark.createDataFrame([("good", "CC0", "human", 9606, "longitudinal", "same_biospecimen", True, "parsed", "approved", 0), ("bad", "unknown", "undeclared", None, None, None, None, "none", "required", 2)], d)
    inventory = spark.createDataFrame([("good", "matrix", "p", "h", None), ("good", "rejected_raw", None, None, None), ("bad", "archive", "p", None, "c")], i)
    gates = readiness.readiness_gates(datasets, inventory)
    level = {(r.dataset_id, r.gate): r.level for r in gates.collect()}
    assert len(level) == 26
    assert {g for (k, g), v in level.items() if k == "good" and v != "green"} == {"raw_excluded", "license", "sample_sheet"}
    assert level["bad", "processed_matrix"] == level["bad", "checksums"] == level["bad", "human_review"] == "red"
    assert level["bad", "official_checksum"] == level["bad", "archives"] == "yellow"
    assert {r.dataset_id: r.blocking for r in readiness.blocking(gates).collect()} == {"good": False, "bad": True}


def test_fingerprint_ignores_order_and_sees_changes(spark):
    a = spark.createDataFrame([(1, 0.1 + 0.2, "x"), (2, None, "y"), (2, None, "y")], "k int, v double, s string")
    b = a.select("s", "v", "k").orderBy(F.col("k").desc()).repartition(3)
    one = fingerprint.fingerprint(a, "t").first()
    assert one.digest == fingerprint.fingerprint(b, "t").first().digest and one.n_rows == 3
    assert one.digest != fingerprint.fingerprint(a.distinct(), "t").first().digest
    changed = a.withColumn("s", F.when(F.col("k") == 1, "z").otherwise(F.col("s")))
    diff = fingerprint.fingerprint_diff(fingerprint.fingerprint(a, "t"), fingerprint.fingerprint(changed, "t"))
    assert [(r.name, r.status) for r in diff.collect()] == [("t", "changed")]


def test_metric_sink_skips_undefined(spark, tmp_path):
    rows = sinks.metric_rows(spark.createDataFrame([("m", 1.0, None, float("inf"))], "model string, a double, b double, c double"), ["model"], ["a", "b", "c"])
    skipped = sinks.append_metrics(rows, str(tmp_path / "metrics"))
    assert sorted(r.metric for r in skipped.collect()) == ["b", "c"]
    sinks.append_metrics(rows, str(tmp_path / "metrics"))
    assert spark.read.parquet(str(tmp_path / "metrics")).count() == 2


def test_manifest_rules(spark):
    declared = spark.createDataFrame([("d", "rna"), ("d", "protein")], "dataset_id string, modality string")
    listed = spark.createDataFrame([("d", "matrix", "rna"), ("d", "matrix", "lipid"), ("d", "archive", "protein")], "dataset_id string, role string, modality string")
    assert {(r.modality, r.reason) for r in validate.manifest_modality_gaps(declared, listed).collect()} == {("protein", "no_matrix_file"), ("lipid", "unknown_modality")}
    assert [r.reason for r in validate.spline_violations(spark.createDataFrame([(1.0,), (2.0,)], "time double"), 4).collect()] == ["too_few_times"]
    assert validate.objective_leaks(spark.createDataFrame([("train",), ("test",)], "split string")).count() == 1


def test_row_projections_run_on_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("x.tsv\ny.bam\n")
    stream = spark.readStream.schema("name string").csv(str(tmp_path / "in")).select("name", files.file_role(F.col("name")).alias("role"))
    q = stream.writeStream.format("memory").queryName("roles").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.name, r.role) for r in spark.table("roles").select(F.col("name").alias("name"), "role").collect()} == {("x.tsv", "matrix"), ("y.bam", "rejected_raw")}
