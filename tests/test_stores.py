import warnings

import pytest
from pyspark.sql import functions as F

from ranklake.config import SignLoad
from ranklake.errors import DuplicateIdError, OptionError, StaleRevisionError, StoreError, StorePathWarning, UnknownFilterKeyWarning, UnsavedWriteWarning
from ranklake.operators import dense, filters, sparse
from ranklake.shared import shared_dir
from ranklake.sources import readers  # noqa: F401
from ranklake.stores import bundle, frameworks, generations, ltr_cache
from ranklake.stores.files import Files, relative, writer_lock
from ranklake.stores.records import Records
from ranklake.streaming import ingest

V = {"a": [1.0, 2, 3, 4], "b": [4.0, 3, 2, 1], "c": [1.0, 3, 2, 4], "d": [2.0, 1, 4, 3]}


def filled(spark, ids="abc", **options):
    s = Records(spark, **options)
    s.add_lists(list(ids), [V[i] for i in ids], [f"doc {i}" for i in ids], [{"n": n, "kind": "x" if n else "y"} for n, _ in enumerate(ids)])
    return s


def ids(df):
    return [r.id for r in df.collect()]


def test_changes_of_records(spark):
    s = filled(spark)
    assert ids(s.records()) == ["a", "b", "c"] and s.dim == 4
    with pytest.raises(DuplicateIdError):
        s.add_lists(["d", "a"], [V["d"], V["a"]], ["", ""])
    with pytest.raises(DuplicateIdError):
        s.add_lists(["d", "d"], [V["d"]] * 2, ["", ""])
    with pytest.raises(StoreError):
        s.add_lists(["d"], [V["d"]], [None])
    with pytest.raises(StoreError):
        s.add_lists(["d"], [V["d"]], ["x"], [{"n": float("nan")}])
    assert len(s) == 3  # nothing was added in part
    s.add_lists(["b", "d"], [V["a"], V["d"]], ["new b", "doc d"], upsert=True)
    rows = s.records().collect()
    assert [r.id for r in rows] == ["a", "b", "c", "d"] and [r.u64_id for r in rows] == [0, 3, 2, 4] and rows[1].document == "new b"
    assert [r.id for r in s.get(["d", "nope", "a", "d"]).collect()] == ["d", "a", "d"]
    assert s.delete("a") and not s.delete(["a"])
    with pytest.raises(StoreError):
        s.delete(["b", "nope"], missing_ok=False)
    assert len(s) == 3
    s.check()


def test_search_of_records(spark):
    s = filled(spark)
    assert ids(s.search_by_vector(V["a"], 2)) == ["a", "c"]
    assert ids(s.search_by_vector(V["a"], 9, {"kind": "x"})) == ["c", "b"]
    assert ids(s.search_by_vector(V["a"], 9, lambda m: m["n"] == 1)) == ["b"]
    assert ids(s.search_by_vector(V["a"], 9, lambda d, m: d == "doc c")) == ["c"]
    assert ids(s.search_by_vector(V["a"], 0)) == [] and ids(Records(spark).search_by_vector(V["a"], 3)) == []
    with pytest.raises(OptionError):
        s.search_by_vector(V["a"], -1)
    with pytest.raises(OptionError):
        s.search_by_vector(V["a"], 1, {"n": 1}, s.allowlist({"n": 1}))
    with pytest.warns(UnknownFilterKeyWarning):
        assert ids(s.search_by_vector(V["a"], 3, {"nope": 1})) == []


def test_publishing(spark, tmp_path):
    path = str(tmp_path / "store")
    s = filled(spark)
    generations.save(s, path)
    other = generations.load(spark, path)
    assert ids(other.records()) == ["a", "b", "c"] and generations.verify(spark, path).count() == 0
    with pytest.warns(UnsavedWriteWarning):
        s.delete("a")
    generations.save(s)
    other.warn_unsaved = False
    other.delete("b")
    with pytest.raises(StaleRevisionError):
        generations.save(other)
    with pytest.raises(StaleRevisionError):
        generations.save(filled(spark), path)
    assert ids(generations.load(spark, path).records()) == ["b", "c"]
    patched = spark.createDataFrame([("b", '{"f": 0.1}')], "id string, metadata string")
    with pytest.raises(StaleRevisionError):
        generations.patch_metadata(spark, path, "0:x", patched)
    generations.patch_metadata(spark, path, s.revision, patched)
    assert generations.load(spark, path).get("b").first().metadata == '{"f": 0.1}'
    assert generations.audit(spark, path).count() == 3 and generations.inspect(spark, path).first().retained == 2
    with pytest.raises(StoreError):
        generations.load(spark, path, "other name")
    out = str(tmp_path / "json")
    generations.export_json(spark, path, out)
    copy = generations.import_json(spark, out, str(tmp_path / "copy"))
    assert ids(copy.search_by_vector(V["c"], 1)) == ["c"]
    with pytest.raises(StoreError):
        generations.import_json(spark, out, str(tmp_path / "copy"))


def test_empty_stores_and_paths(spark, tmp_path):
    path = str(tmp_path / "e")
    generations.save(Records(spark), path)
    assert len(generations.load(spark, path)) == 0 and generations.load(spark, path).dim is None
    with pytest.warns(StorePathWarning):
        generations.check_fresh(spark, path)
    (tmp_path / "plain").write_text("x")
    with pytest.raises(StoreError):
        generations.check_fresh(spark, str(tmp_path / "plain"))
    (tmp_path / "other").mkdir()
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        generations.check_fresh(spark, str(tmp_path / "other"))
        generations.check_fresh(spark, str(tmp_path / "missing"))
    (tmp_path / "other" / "x").write_text("x")
    with pytest.warns(StorePathWarning):
        generations.check_fresh(spark, str(tmp_path / "other"))
    with pytest.raises(StoreError):
        generations.save(Records(spark))


def test_damage_is_found(spark, tmp_path):
    path = tmp_path / "s"
    generations.save(filled(spark), str(path))
    part = next((path / "generations/g-00000001").glob("part-*.parquet"))
    raw = part.read_bytes()
    part.write_bytes(raw[:-1] + bytes([raw[-1] ^ 1]))
    next((path / "generations/g-00000001").glob(".part-*.crc")).unlink()
    with pytest.raises(StoreError, match="digest"):
        generations.load(spark, str(path))
    part.unlink()
    assert "missing" in generations.verify(spark, str(path)).first().problem
    commit = path / "commits/00000001.json"
    commit.write_text(commit.read_text().replace('"count": 3', '"count": 4'))
    (path / "commits/.00000001.json.crc").unlink()
    with pytest.raises(StoreError, match="not valid"):
        generations.load(spark, str(path))


def test_clean_up(spark, tmp_path):
    path = str(tmp_path / "s")
    s = filled(spark)
    generations.save(s, path)
    s.warn_unsaved = False
    for i in "abc":
        s.delete(i)
        generations.save(s)
    files = Files(spark, path)
    (tmp_path / "s/generations/g-00000099").mkdir()
    (tmp_path / "s/generations/junk").mkdir()
    generations.pin(spark, path, "generations/g-00000001")
    states = {r.path[-2:]: (r.state, r.pinned) for r in generations.scan(files).collect()}
    assert states == {"01": ("retained", True), "02": ("retained", False), "03": ("retained", False), "04": ("active", False), "99": ("partial", False), "nk": ("debris", False)}
    dry = generations.gc(spark, path, 1, dry_run=True)
    assert dry["deleted"] == [] and [p[-2:] for p in dry["reclaimable"]] == ["02", "99"] and files.exists("generations/g-00000002")
    generations.record_gc(files, ["generations/g-00000003"], "deleting")  # as if a run had been cut off
    done = generations.gc(spark, path, 1)
    assert [p[-2:] for p in done["deleted"]] == ["02", "03", "99"]
    assert {r.state for r in generations.latest_states(generations.gc_events(files)).collect()} == {"deleted"}
    with pytest.raises(StoreError):
        generations.remove_debris(spark, path, "generations/g-00000001")
    generations.remove_debris(spark, path, "generations/junk")
    assert not files.exists("generations/junk") and len(generations.load(spark, path)) == 0
    with writer_lock(files), pytest.raises(StoreError, match="writer"):
        generations.save(s)


def vectors(spark, n=8, dim=64):
    return spark.range(n).select(F.col("id").alias("row_id"), F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: F.sin(i * (F.col("id") + 1)).cast("float")).alias("embedding"))


def test_bundles(spark, tmp_path):
    path = str(tmp_path / "b")
    v = vectors(spark)
    text = sparse.build(v.select("row_id", F.concat(F.lit("word number "), F.col("row_id").cast("string"), F.lit(" abc")).alias("text")))
    bundle.write(dense.build(v), path, auxiliaries=bundle.text_auxiliaries(text) | {bundle.Auxiliary.optional("note", "note.txt"): b"hello"})
    index, own = bundle.open_hybrid(spark, path)
    assert index.rows.count() == 8 and own.describe().first().doc_count == 8 and generations.classify(spark, path) == "bundle"
    assert generations.verify(spark, path).count() == 0 and {r.component for r in bundle.stats(spark, path).collect()} == {"rows", "sparse", "manifest.json", "note.txt"}
    (tmp_path / "b/note.txt").unlink()
    assert generations.verify(spark, path).count() == 0  # it is optional
    bundle.write(dense.build(vectors(spark, 5)), path)  # in place of the other
    assert len(bundle.load(spark, path)) == 5 and not (tmp_path / "b/sparse").exists() and [p.name for p in tmp_path.iterdir() if "b" in p.name] == ["b"]
    (tmp_path / "b").rename(tmp_path / ".b.bak-1")
    assert len(bundle.load(spark, path)) == 5 and not (tmp_path / ".b.bak-1").exists()
    for options in ({"kind": "slots"}, {"bits": 4}, {"dim": 32}, {"sign": SignLoad.FORBID}):
        with pytest.raises(StoreError):
            bundle.load(spark, path, **options)
    (tmp_path / "b/extra").write_text("x")
    with pytest.raises(StoreError, match="not in the manifest"):
        bundle.load(spark, path)
    for bad in ("/abs", "../up", "a//b", "", "manifest.json", "rows/x"):
        with pytest.raises(StoreError):
            bundle._check_auxiliaries([bundle.Auxiliary("x", bad)])
    with pytest.raises(StoreError):
        bundle.write(dense.lazy(), path, spark=spark)
    with pytest.raises(DuplicateIdError):
        bundle.write(dense.build(v.unionByName(v)), str(tmp_path / "twice"))
    assert not (tmp_path / "twice").exists() and relative("a/b") == "a/b"


def test_models_and_tables_in_bundles(spark, tmp_path):
    import json

    from ranklake.plans.text import MODEL

    rows = spark.createDataFrame([(0, 1, 1.0, [3.0, 1.0])], "qid long, row_id long, label float, features array<float>")
    more = ltr_cache.auxiliaries(rows, spark.createDataFrame([(0, "q")], "qid long, query string"))
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    bundle.write(dense.build(vectors(spark)), good, auxiliaries=more | {bundle.Auxiliary("model", "model.json"): json.dumps(MODEL).encode()})
    assert bundle.load_model(spark, good).model_id == "stumps" and generations.verify(spark, good).count() == 0
    bundle.write(dense.build(vectors(spark)), bad, auxiliaries={bundle.Auxiliary("model", "model.json"): b"{}"})
    assert "missing fields" in generations.verify(spark, bad).first().problem
    with pytest.raises(StoreError):
        bundle.auxiliary(spark, bad, "nope")


def test_command_line(spark, tmp_path, capsys):
    from ranklake.__main__ import main

    store, b = str(tmp_path / "s"), str(tmp_path / "b")
    generations.save(filled(spark), store)
    bundle.write(dense.build(vectors(spark)), b)
    for args in (["verify", b], ["inspect", store], ["stats", store], ["gc", store, "--dry-run"], ["audit", store], ["export", store, str(tmp_path / "out")], ["import", str(tmp_path / "out"), str(tmp_path / "again")]):
        assert main(args, spark) == 0
    assert '"generation": "generations/g-00000001"' in capsys.readouterr().out
    commit = tmp_path / "s/commits/00000001.json"
    commit.write_text("{}")
    (tmp_path / "s/commits/.00000001.json.crc").unlink()
    assert main(["verify", store], spark) == 1


def test_feature_cache(spark, tmp_path):
    rows = spark.createDataFrame([("q", 10, 1.0, [3.0, 1.0]), ("q", 20, 0.0, [2.0, 2.0])], "qid string, row_id long, label float, features array<float>")
    q = spark.createDataFrame([("q", "text"), ("r", "none")], "qid string, query string")
    path = str(tmp_path / "f")
    ltr_cache.write(rows, q, ["a", "b"], path)
    got, own, m = ltr_cache.read(spark, path)
    assert m["rows"] == 2 and {tuple(r) for r in ltr_cache.groups(got, own).collect()} == {("q", 2), ("r", 0)}
    for bad in (rows.selectExpr("qid", "row_id", "float('nan') as label", "features"), rows.unionByName(rows), rows.selectExpr("'z' as qid", "row_id", "label", "features"), rows.selectExpr("qid", "row_id", "label", "slice(features, 1, 1) as features")):
        with pytest.raises(ValueError):
            ltr_cache.check(bad, ["a", "b"], q)
    (tmp_path / "f/queries/more").write_text("x")
    with pytest.raises(StoreError):
        ltr_cache.verify(spark, path)


def embed(texts):
    return [[float(len(t)), float(t.count("a")), float(t.count("b")), 0.5] for t in texts]


def test_text_store(spark, tmp_path):
    s = frameworks.TextStore.from_texts(spark, ["aaa", "bbb bb", "ab"], embed, [{"x": 1}, {"x": 2}, None], ["1", "2", "3"])
    assert ids(s.similarity_search("aaa", 1)) == ["1"] and s.get_count() == 3
    assert ids(s.similarity_search("aaa", 4, {"x": 2})) == ["2"] and "score" in s.similarity_search_with_score("ab").columns
    with pytest.raises(DuplicateIdError):
        s.add_texts(["x", "y"], ids=["9", "9"])
    assert s.delete(where={"x": 2}) and ids(s.get_by_ids(["3", "2", "1"])) == ["3", "1"]
    with pytest.raises(OptionError):
        s.delete()
    for f in (s.max_marginal_relevance_search, s.similarity_search_with_relevance_scores):
        with pytest.raises(NotImplementedError):
            f("x")
    s.save_local(str(tmp_path / "t"))
    assert frameworks.TextStore.load_local(spark, str(tmp_path / "t"), embedder=embed).get_count() == 2
    with pytest.raises(OptionError):
        frameworks.TextStore(spark).similarity_search("x")


def test_node_store(spark, tmp_path):
    s = frameworks.NodeStore(spark)
    s.add([{"id": i, "text": f"t{i}", "embedding": V[i], "metadata": {"k": n}, "ref_doc_id": "r" if n else None} for n, i in enumerate("abc")])
    assert ids(s.query(V["a"], 2)) == ["a", "c"] and ids(s.query(V["a"], where={"filters": [{"key": "k", "operator": ">", "value": 0}]}, node_ids=["b", "a"])) == ["b"]
    assert ids(s.query(V["a"], doc_ids=["r"])) == ["c", "b"] and ids(s.query(V["a"], doc_ids=["None"])) == ["a"]
    with pytest.raises(NotImplementedError):
        s.query(V["a"], mode="mmr")
    assert '"id": "b"' in s.get_nodes(["b"]).first().node
    s.persist(str(tmp_path / "n/store.json"))
    assert len(frameworks.NodeStore.from_persist_path(spark, str(tmp_path / "n/store.json"))) == 3
    s.store.warn_unsaved = False
    assert s.delete("r") and not s.delete_nodes() and s.delete_nodes(["a"]) and len(s) == 0


def test_document_store(spark, tmp_path):
    doc = lambda i, text=None: {"id": i, "content": text or i, "embedding": V[i], "meta": {"m": i}}
    s = frameworks.DocumentStore(spark)
    assert s.write_documents([doc("a"), doc("b")]) == 2
    with pytest.raises(DuplicateIdError):
        s.write_documents([doc("a")], "FAIL")
    assert s.write_documents([doc("a"), doc("c"), doc("c", "later")], "SKIP") == 1
    assert s.write_documents([doc("c", "one"), doc("c", "two"), doc("d")], "OVERWRITE") == 2 and s.count_documents() == 4
    assert s.store.get("c").first().document == "two"
    with pytest.raises(OptionError):
        s.write_documents([doc("a")], "MERGE")
    r = frameworks.Retriever(s, {"field": "meta.m", "operator": "in", "value": ["b", "c"]})
    assert ids(r.run(V["a"])) == ["c", "b"] and ids(r.run(V["a"], {"field": "id", "operator": "==", "value": "d"}, 1)) == ["d"]
    s.delete_documents(["a"])
    assert sorted(ids(s.filter_documents())) == ["b", "c", "d"]
    s.save(str(tmp_path / "d"))
    assert frameworks.DocumentStore.from_dict(spark, s.to_dict()).count_documents() == 3


def test_content_store(spark, tmp_path):
    s = frameworks.ContentStore(spark, path=str(tmp_path / "c"), embedder=embed, auto_save=True)
    assert s.upsert("h", [{"content": "one a"}, {"content": "two", "name": "n"}]) == ["h:0", "h:1"] and s.exists()
    assert s.upsert("h", [{"content": "one again"}]) == ["h:0"] and s.get_count() == 1
    with pytest.raises(DuplicateIdError):
        s.insert("h", [{"content": "one"}])
    s.insert("g", [{"id": "z", "content": "bbb", "name": "n", "meta_data": {"k": 1}}])
    assert s.id_exists("z") and s.content_hash_exists("g") and s.name_exists("n") and not s.name_exists("m")
    assert ids(s.search("bbb", 1)) == ["z"] and s.get_supported_search_types() == ["vector"]
    assert len(frameworks.ContentStore.load(spark, str(tmp_path / "c"))) == 2
    assert s.delete_by_metadata({"k": 1}) and s.delete_by_content_id("h") and not s.delete_by_name("n") and not s.delete()


def test_streams(spark, tmp_path):
    v = vectors(spark, 9)
    for k in range(3):
        v.filter(F.col("row_id") % 3 == k).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(v.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    for _ in range(2):  # the second run finds nothing new
        ingest.append_vectors(stream, str(tmp_path / "rows"), str(tmp_path / "checkpoint"), 64).awaitTermination()
    index = ingest.read(spark, str(tmp_path / "rows"), 64)
    assert len(index) == 9
    q = v.selectExpr("row_id as qid", "embedding")
    same = lambda i: sorted((r.qid, r["rank"], r.row_id) for r in dense.search(i, q, 3).collect())
    assert same(index) == same(dense.build(v))


def test_shared_folder_is_found(spark):
    assert shared_dir(spark) and filters.nested_keys({"operator": "AND", "conditions": [{"field": "meta.a.b"}, {"field": "c"}, {"field": "id"}]}) == {"a", "c"}
