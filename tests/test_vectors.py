import numpy as np
import pytest

from sparkvec.db import NO_ID, VectorDb
from sparkvec.errors import Corrupt, DimensionMismatch, IdOutOfRange, InvalidArgument
from sparkvec.functions import distance
from sparkvec.operators import evaluate, hnsw, knn, pq
from sparkvec.sources.store import VectorStore
from sparkvec.sources.vecs import read_vecs
from sparkvec.streaming.ingest import gaps, ingest


def frame(spark, rows, name="vec_id", column="embedding"):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], f"{name} long, {column} array<float>")


def naive(rows, q, k, by):
    v, q = np.asarray(rows, np.float32).astype(float), np.asarray(q, np.float32).astype(float)
    d = {"l2": lambda: ((v - q) ** 2).sum(1), "dot": lambda: -(v @ q), "cosine": lambda: 1 - v @ q / np.sqrt((v * v).sum(1) * (q @ q))}[by]()
    return [(int(i), d[i]) for i in np.lexsort((np.arange(len(d)), d))[:k]]


@pytest.mark.parametrize("by", ["l2", "dot", "cosine"])
def test_knn_equals_a_naive_sort(spark, by):
    r = np.random.default_rng(7)
    rows, q = r.uniform(-1, 1, (300, 24)), r.uniform(-1, 1, (5, 24))
    found = knn.knn(frame(spark, rows), frame(spark, q, "qid", "q"), 10, by).orderBy("qid", "rank").collect()
    for i in range(5):
        own = [(x["vec_id"], x["distance"]) for x in found if x["qid"] == i]
        assert [x[0] for x in own] == [x[0] for x in naive(rows, q[i], 10, by)]
        assert np.allclose([x[1] for x in own], [x[1] for x in naive(rows, q[i], 10, by)])


@pytest.mark.parametrize("by", ["l2", "dot", "cosine"])
def test_many_neighbours_are_ranked_without_a_shuffle_of_pairs(spark, monkeypatch, by):
    r = np.random.default_rng(8)
    rows = np.repeat(r.uniform(-1, 1, (50, 8)), 6, 0)  # many ties
    v, q = frame(spark, rows).repartition(5), frame(spark, rows[::7], "qid", "q")
    q = q.unionAll(q.where("qid = 3"))  # a query id of two rows
    few = sorted(map(tuple, knn.knn(v, q, 310, by).collect()))
    for name, value in (("FEW", 100), ("QUERIES_A_COPY", 9), ("HELD", 1000), ("SCORED", 700), ("SENT", 64), ("ROW_BLOCK", 128)):
        monkeypatch.setattr(knn, name, value)
    assert sorted(map(tuple, knn.knn(v, q, 310, by).collect())) == few and len(few) == 42 * 300 + 310
    assert sorted(map(tuple, knn.knn(v, q, 120, by).collect())) == [x for x in few if x[1] <= 120]
    assert knn.knn(v, q.limit(0), 310).count() == 0 and knn.knn(v.limit(0), q, 310).count() == 0
    plan = knn.knn(v, q, 310, by)._jdf.queryExecution().toString()
    assert "Window" not in plan and "copy" in plan


def test_ties_go_to_the_id_and_k_may_exceed_n(spark):
    v, q = frame(spark, [[1, 1], [1, 1], [0, 0]]), frame(spark, [[0, 0]], "qid", "q")
    assert [x["vec_id"] for x in knn.knn(v, q, 10).orderBy("rank").collect()] == [2, 0, 1]
    pad = knn.padded(knn.knn(v, q, 5), q, 5).orderBy("rank").collect()
    assert [x["vec_id"] for x in pad] == [2, 0, 1, None, None] and pad[4]["distance"] == float("inf")
    assert knn.knn(v, q, 0).count() == 0


def test_zero_norm_cosine_is_one_and_lengths_must_agree(spark):
    from pyspark.sql import functions as F

    one = spark.sql("select array(0f, 0f) a, array(1f, 2f) b, array(1f) c")
    assert one.select(distance.cosine_distance(F.col("a"), F.col("b"))).first()[0] == 1.0
    with pytest.raises(Exception, match="different lengths"):
        one.where(distance.same_length(F.col("b"), F.col("c"))).collect()
    with pytest.raises(ValueError):
        distance.metric("l1")


def test_graph_search_finds_neighbours_and_is_sound(spark):
    r = np.random.default_rng(1)
    rows = r.uniform(-5, 5, (10, 16))[r.integers(0, 10, 800)] + r.uniform(-1, 1, (800, 16))
    v, q = frame(spark, rows), frame(spark, rows[:20], "qid", "q")
    config = hnsw.HnswConfig(8, 64)
    edges = hnsw.build(v, config, 2).cache()
    assert tuple(hnsw.violations(edges, 8).first()) == (0, 0, 0)
    assert hnsw.orphans(edges, hnsw.entries(edges)).count() <= 8
    assert knn.recall(hnsw.search(v, edges, q, 10, 64, config, 2), knn.knn(v, q, 10), 10).first()[0] >= 0.95
    with pytest.raises(ValueError):
        hnsw.HnswConfig(1)


def test_quantization_round_trip_and_checks(spark):
    r = np.random.default_rng(2)
    rows = r.uniform(-3, 3, (16, 16))[r.integers(0, 16, 600)] + r.uniform(-0.3, 0.3, (600, 16))
    v = frame(spark, rows)
    book = pq.train(v, 16, 4, 5).cache()
    decoded = pq.decode(pq.encode(v, book, 4), book).orderBy("vec_id").collect()
    lost = ((np.array([x["decoded"] for x in decoded]) - rows) ** 2).sum() / ((rows - rows.mean(0)) ** 2).sum()
    assert lost < 0.05
    for m, most, error in ((0, 1000, InvalidArgument), (3, 1000, InvalidArgument), (4, 255, InvalidArgument)):
        with pytest.raises(error):
            pq.train(v, 16, m, 5, most)
    with pytest.raises(Corrupt):
        pq.train(v.limit(10), 16, 4, 5)
    with pytest.raises(Corrupt):
        pq.train(v, 16, 4, 5, by="dot")


def test_database_keeps_what_was_added(spark, tmp_path):
    r = np.random.default_rng(3)
    rows = r.standard_normal((300, 8)).astype(np.float32)
    db = VectorDb(spark, str(tmp_path / "db"), 8, m=8, ef_construction=50)
    ids, _ = db.search(rows[:1], 3)
    assert (ids == NO_ID).all()
    assert db.add(rows[:200]) == 0 and db.add(rows[200:]) == 200 and len(db) == 300
    assert np.array_equal(db.get(250), rows[250])
    with pytest.raises(IdOutOfRange):
        db.get(300)
    with pytest.raises(DimensionMismatch):
        db.add(rows[:, :4])
    ids, d = db.search(rows[:5], 1)
    assert ids[:, 0].tolist() == [0, 1, 2, 3, 4] and np.allclose(d, 0)
    with pytest.raises(RuntimeError):
        db.search_pq(rows[:5], 1)
    assert db.search_pq(rows[:5], 0)[0].shape == (5, 0)
    db.train_pq(4, 3)
    assert db.search_pq(rows[:5], 1)[0][:, 0].tolist() == [0, 1, 2, 3, 4]
    db.checkpoint()
    again = VectorDb(spark, str(tmp_path / "db"), 8, m=4, metric="dot")
    assert len(again) == 300 and again.config.m == 8 and again.config.metric == "l2"
    with pytest.raises(ValueError):
        VectorDb(spark, str(tmp_path / "db"), 9)


def test_stream_ingestion_takes_each_batch_once(spark, tmp_path):
    store = VectorStore.create(spark, str(tmp_path / "s"), 2)
    frame(spark, [[1, 2], [3, 4]], "ord").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ord long, embedding array<float>").parquet(str(tmp_path / "in"))
    for _ in range(2):
        ingest(stream, store, str(tmp_path / "c")).awaitTermination()
    assert [r["vec_id"] for r in store.frame().orderBy("vec_id").collect()] == [0, 1]
    assert store.append(frame(spark, [[9, 9]], "ord"), batch=0) == 2 and store.state["rows"] == 2
    for crc in (tmp_path / "s").glob(".manifest*"):
        crc.unlink()
    newest = sorted((tmp_path / "s").glob("manifest-*"))[-1]
    newest.write_text(newest.read_text().replace("rows", "r0ws"))
    with pytest.raises(Corrupt):
        VectorStore.open(spark, str(tmp_path / "s"))


def test_vecs_files_and_gaps(spark, tmp_path):
    rec = lambda *x: np.array([len(x)], "<i4").tobytes() + np.array(x, "<f4").tobytes()
    (tmp_path / "a.fvecs").write_bytes(rec(1, 2) + rec(3, 4))
    assert [r["embedding"] for r in read_vecs(spark, str(tmp_path / "a.fvecs")).orderBy("vec_id").collect()] == [[1, 2], [3, 4]]
    (tmp_path / "b.fvecs").write_bytes(rec(1, 2) + rec(3, 4, 5))
    with pytest.raises(Exception, match="different lengths"):
        read_vecs(spark, str(tmp_path / "b.fvecs")).collect()
    ids = spark.createDataFrame([(x,) for x in (0, 1, 3, 4, 9)], "vec_id long")
    assert sorted(map(tuple, gaps(ids, 4).collect())) == [(1, 3), (4, 9)]


def test_a_crash_between_any_two_steps_loses_nothing(spark, tmp_path):
    path = str(tmp_path / "s")
    store = VectorStore.create(spark, path, 2)
    store.append(frame(spark, [[1, 2], [3, 4]], "ord"))
    rows = lambda: [r["vec_id"] for r in VectorStore.open(spark, path).frame().orderBy("vec_id").collect()]
    frame(spark, [[5, 6]]).write.parquet(f"{path}/batch-unnamed")  # written, but its manifest wasn't begun
    assert rows() == [0, 1]
    whole = sorted((tmp_path / "s").glob("manifest-*"))[-1].read_text()
    for cut in (0, 3, len(whole) // 2, len(whole) - 1):  # the next manifest is incomplete
        (tmp_path / "s" / "manifest-000000000099").write_text(whole[:cut])
        assert rows() == [0, 1]
    later = VectorStore.open(spark, path)
    assert later.append(frame(spark, [[5, 6]], "ord")) == 2 and rows() == [0, 1, 2]
    with pytest.raises(Corrupt, match="another writer"):
        store.append(frame(spark, [[7, 8]], "ord"))
    assert rows() == [0, 1, 2]
    for f in (tmp_path / "s").glob("*manifest*"):
        f.unlink()
    for again in (lambda: VectorStore.create(spark, path, 2), lambda: VectorDb(spark, path, 2)):
        with pytest.raises(Corrupt):
            again()


def test_damaged_batches_are_found(spark, tmp_path):
    store = VectorStore.create(spark, str(tmp_path / "s"), 2)
    store.append(frame(spark, [[1, 2], [3, 4]], "ord"))
    store.verify()
    batch = f"{tmp_path}/s/{store.state['batches'][0]['name']}"
    for rows in ([[1, 2]], [[1, 2], [3, 4], [5, 6]], [[1, 2], [3]]):
        frame(spark, rows).write.mode("overwrite").parquet(batch)
        with pytest.raises(Corrupt):
            store.verify()


def test_other_widths_are_errors_not_neighbours(spark):
    v, q = frame(spark, [[1, 1], [1, 1, 1], [0, 0]]), frame(spark, [[0, 0]], "qid", "q")
    for search in (lambda: knn.nearest(v, [0.0, 0.0], 2), lambda: knn.knn(v, q, 2), lambda: pq.reranked(spark.createDataFrame([(0, 1)], "qid long, vec_id long"), v, q, 1)):
        with pytest.raises(Exception, match="dimensions|lengths"):
            search().collect()


def test_codes_are_those_of_the_folds_also_in_ties():
    r = np.random.default_rng(5)
    book = r.integers(-2, 3, (2, 256, 4)).astype(float)  # many centroids are equal
    v = r.integers(-2, 3, (300, 8)).astype(float)
    codes = pq.nearest_codes(v, book)
    for x, own in zip(v, codes, strict=True):
        for s in range(2):
            d = [sum((a - b) ** 2 for a, b in zip(x[4 * s : 4 * s + 4], c, strict=True)) for c in book[s]]
            assert own[s] == d.index(min(d))


def test_blocks_of_queries_give_what_one_block_gives(spark, monkeypatch):
    r = np.random.default_rng(6)
    v, q = frame(spark, r.standard_normal((200, 8))), frame(spark, r.standard_normal((7, 8)), "qid", "q")
    whole = sorted(map(tuple, knn.knn(v, q, 5).collect()))
    monkeypatch.setattr(knn, "QUERY_BLOCK", 3)
    assert sorted(map(tuple, knn.knn(v, q, 5).collect())) == whole


def test_search_by_codes_joins_no_codes_with_queries(spark):
    v, q = frame(spark, np.random.default_rng(7).standard_normal((300, 8))), frame(spark, [[0] * 8], "qid", "q")
    book = pq.train(v, 8, 2, 2)
    plan = pq.flat_search(pq.encode(v, book, 4), q, book, 4, 3)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_added_rows_extend_graph_and_codes(spark, tmp_path, monkeypatch):
    import sparkvec.db

    monkeypatch.setattr(sparkvec.db, "SHARD_ROWS", 150)
    rows = np.random.default_rng(8).standard_normal((500, 8)).astype(np.float32)
    db = VectorDb(spark, str(tmp_path / "db"), 8, m=8, ef_construction=50)
    db.add(rows[:400])
    db.train_pq(2, 2)
    assert db.search_pq(rows[:3], 1)[0][:, 0].tolist() == [0, 1, 2]
    first = {p["folder"] for p in db.store.state["settings"]["graph"]["parts"]}
    db.add(rows[400:])
    assert db.pq_inconsistent_ids() == (list(range(400, 500)), 400, 500)
    assert db.search_pq(rows[497:], 1)[0][:, 0].tolist() == db.search(rows[497:], 1)[0][:, 0].tolist() == [497, 498, 499]
    parts = db.store.state["settings"]["graph"]["parts"]
    assert first < {p["folder"] for p in parts} and [p["first"] for p in parts] == [0, 2]
    assert db.pq_inconsistent_ids() == ([], 500, 500)
    db.verify()


def test_commands(spark, tmp_path, capsys):
    from sparkvec.__main__ import main

    path = str(tmp_path / "db")
    assert main(["ingest", path, "8", "40", "20"], spark) == 0
    out = capsys.readouterr().out.split("\n")
    assert out[:40] == [f"ACK {i}" for i in range(40)] and out[40] == "DONE 40"
    assert main(["verify", path, "8", "40"], spark) == 0 and capsys.readouterr().out.startswith("OK len=40 orphans=")
    assert main(["verify", path, "8", "41"], spark) == 1
    assert main(["search", path, "8", "7", "2"], spark) == 0 and capsys.readouterr().out.split("\t")[0] == "7"
    assert main(["orphans", path, "8"], spark) == 0
    assert main(["ingest", path, "8", "40", "0"], spark) == 1
    assert main(["verify", path, "9", "1"], spark) == 1
    assert main([], spark) == main(["search", path, "8", "7"], spark) == main(["orphans", path, "x"], spark) == 2


def test_vectors_by_id_and_sift_files(spark, tmp_path):
    from sparkvec.sources.synthetic import BY_ID, BY_PLACE, vectors_of
    from sparkvec.sources.vecs import load_sift

    v = vectors_of(np.array([0, 1, 2**40]), 3)
    for i, own in zip((0, 1, 2**40), v, strict=True):
        for j, x in enumerate(own):
            assert x == np.float32(((i * BY_ID + j * BY_PLACE) % 2**64) >> 33) / np.float32(2**32 - 1) - np.float32(0.5)
    rec = lambda kind, *x: np.array([len(x)], "<i4").tobytes() + np.array(x, kind).tobytes()
    (tmp_path / "sift_base.fvecs").write_bytes(rec("<f4", 1, 2) + rec("<f4", 3, 4))
    (tmp_path / "sift_query.fvecs").write_bytes(rec("<f4", 3, 4))
    (tmp_path / "sift_groundtruth.ivecs").write_bytes(rec("<i4", 1, 0))
    base, queries, truth = load_sift(spark, str(tmp_path))
    assert knn.recall(knn.knn(base, queries, 2), truth, 2).first()[0] == 1.0 and load_sift(spark, str(tmp_path), 1)[0].count() == 1


def test_measures_of_a_search(spark, tmp_path):
    times = spark.createDataFrame([(float(x),) for x in (4, 1, 3, 2)], "ms double")
    assert evaluate.percentiles(times).first().asDict() == {"p50_ms": 2.5, "p99_ms": pytest.approx(float(np.percentile([1, 2, 3, 4], 99)))}
    assert evaluate.percentiles(times.limit(0)).first()["p50_ms"] is None
    r = np.random.default_rng(8)
    v = spark.createDataFrame([(i, [float(x) for x in r.normal(size=8)]) for i in range(120)], "vec_id long, embedding array<float>")
    q = v.where("vec_id < 4").selectExpr("vec_id qid", "embedding q")
    truth = knn.knn(v, q, 10)
    found = evaluate.measure(lambda own, ef: knn.knn(v, own, min(ef, 10)), q, truth, 10, "exact", 1.5, (5, 64), 2)
    rows = {x["ef_search"]: x for x in found.collect()}
    assert rows[64]["recall@10"] == 1.0 and rows[5]["recall@10"] == 0.5
    assert all(x["p99_ms"] >= x["p50_ms"] > 0 and x["qps"] > 0 for x in rows.values())
    evaluate.write_csv(found, str(tmp_path / "csv"))
    lines = next((tmp_path / "csv").glob("*.csv")).read_text().splitlines()
    assert lines[0] == "engine,ef_search,recall@10,p50_ms,p99_ms,qps,build_or_train_s" and [x.split(",")[1] for x in lines[1:]] == ["5", "64"]
    with pytest.raises(InvalidArgument):
        evaluate.measure(lambda own, ef: own, q, truth, 10, "exact", 0, (5,), 0)
