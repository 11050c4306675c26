"""The queries by name, each with the SQL that it must equal where SQL can express it.

Batch searches take as queries every vector whose id is divisible by 20, neighbour graphs all. K neighbours are asked for; M parts are used for
product quantization; graphs have SHARDS shards. Queries that need a codebook without training take the first 256 vectors
as centroids, so that SQL can follow.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkvec.functions import distance as dist
from sparkvec.operators import hnsw, knn, pq
from sparkvec.plans.saved import folder, saved
from sparkvec.sources.store import VectorStore, assign_ids
from sparkvec.sources.synthetic import BY_ID, BY_PLACE, DROPPED, by_id, clusters
from sparkvec.streaming import ingest

K, M, SHARDS, EF = 10, 8, 4, 128
DIM = 64
WIDTH = DIM // M
CONFIG = hnsw.HnswConfig(m=16, ef_construction=100)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def asked(v: DataFrame) -> DataFrame:
    return v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))


def first_vector(v: DataFrame) -> list[float]:
    return v.where("vec_id = 0").first()["embedding"]


def seed_codebook(v: DataFrame) -> DataFrame:
    sub = F.explode(F.sequence(F.lit(0), F.lit(M - 1)))
    rows = v.where(F.col("vec_id") < pq.CENTROIDS).select(F.col("vec_id").cast("int").alias("code"), sub.alias("sub"), "embedding")
    return rows.select("sub", "code", pq.part(F.col("embedding"), F.col("sub"), WIDTH).cast("array<double>").alias("centroid"))


def near_graph(v: DataFrame) -> DataFrame:
    """The exact neighbour graph: each vector links to those of its K + 1 nearest that it isn't itself. Written once, as
    its readers take it several times."""
    n = knn.knn(v, v.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q")), K + 1)
    linked = n.where("qid <> vec_id").groupBy(F.col("qid").alias("node_id")).agg(F.array_sort(F.collect_list("vec_id")).alias("neighbors"))
    return saved(linked.select(F.lit(0).alias("shard"), "node_id", F.lit(0).alias("layer"), "neighbors"), "neighbours")


def _pairs(name: str) -> Callable[[SparkSession, str], DataFrame]:
    """Each vector against the first one."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        v = vectors(spark, sf_dir)
        q = F.array(*map(F.lit, first_vector(v)))
        if name == "inner_product":
            return v.select("vec_id", dist.inner_product(q, F.col("embedding")).alias("value"))
        return v.where(dist.same_length(q, F.col("embedding"))).select("vec_id", dist.metric(name)(q, F.col("embedding")).alias("value"))

    return run


def _nearest(by: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        v = vectors(spark, sf_dir)
        return knn.nearest(v, first_vector(v), K, by)

    return run


def _knn(k: int, by: str = "l2") -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: knn.knn(vectors(spark, d), asked(vectors(spark, d)), k, by)


def _padded(spark: SparkSession, d: str) -> DataFrame:
    """Searches one label's vectors, as padding shows only where there are fewer than k."""
    v = vectors(spark, d)
    n = knn.knn(v.where("label = 0"), asked(v), K * 10)
    return knn.padded(n, asked(v), K * 10)


def _knn_exceeds(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    return knn.knn(v, asked(v), v.count() + 1)


def _append(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    return assign_ids(v.select(F.col("vec_id").alias("ord"), "label"), "ord", v.count()).select("ord", "label", "vec_id")


def _stored(spark: SparkSession, d: str) -> VectorStore:
    """All vectors in a new collection, ids in the table's order of ids; opened again, as a later caller would."""
    path = folder(spark, "collection")
    VectorStore.create(spark, path, DIM).append(vectors(spark, d).select(F.col("vec_id").alias("ord"), "embedding"))
    return VectorStore.open(spark, path, DIM)


def _doubles(v: DataFrame) -> DataFrame:
    return v.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))


def _scan_store(spark: SparkSession, d: str) -> DataFrame:
    store = _stored(spark, d)
    store.verify()
    return _doubles(store.frame())


def _lookup(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(42, [float(x) for x in _stored(spark, d).get(42)])], "vec_id long, embedding array<double>")


def _stats(spark: SparkSession, d: str) -> DataFrame:
    state = _stored(spark, d).state
    return spark.createDataFrame([(state["rows"], state["dim"], state["rows"] == 0)], "n long, dim long, is_empty boolean")


def _lloyd(spark: SparkSession, d: str) -> DataFrame:
    """One round from the seed centroids: each centroid's points and their mean."""
    import numpy as np
    import pandas as pd

    v = vectors(spark, d)
    book = pq.book_of(seed_codebook(v))
    parts = v.select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(M - 1))).alias("sub"), "embedding").select("vec_id", "sub", pq.part(F.col("embedding"), F.col("sub"), WIDTH).alias("x"))

    def moved(rows: pd.DataFrame) -> pd.DataFrame:
        sub = int(rows["sub"].iloc[0])
        n, means = pq.lloyd_round(np.stack(rows["x"].to_numpy()).astype(np.float64), book[sub])
        own = np.flatnonzero(n)
        return pd.DataFrame({"sub": sub, "code": own, "n": n[own], "centroid": [[round(float(x), 6) + 0.0 for x in c] for c in means[own]]})

    moves = parts.groupBy("sub").applyInPandas(moved, "sub int, code int, n long, centroid array<double>")
    return moves.select("sub", "code", "n", F.posexplode("centroid").alias("pos", "mean"))


def _uncovered(spark: SparkSession, d: str) -> DataFrame:
    """Codes were made before a third of the vectors came; those that search by codes can't see."""
    v = vectors(spark, d)
    return ingest.unindexed(v, _encoded(v.where("vec_id % 3 <> 1 or vec_id < 256")))


def _log(v: DataFrame) -> DataFrame:
    """An insert log: an entry a vector, and those whose id is divisible by 3 delivered once more."""
    n = v.agg(F.count(F.lit(1)).alias("n"))
    again = v.where("vec_id % 3 = 0").crossJoin(F.broadcast(n)).select((F.col("vec_id") + F.col("n")).alias("lsn"), "vec_id")
    return v.select(F.col("vec_id").alias("lsn"), "vec_id").unionByName(again)


def _encoded(v: DataFrame) -> DataFrame:
    return pq.encode(v, seed_codebook(v), WIDTH)


def _pq_error(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    decoded = pq.decode(_encoded(v), seed_codebook(v))
    means = v.select(F.posexplode("embedding").alias("pos", "x")).groupBy("pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))
    spread = v.select(F.posexplode("embedding").alias("pos", "x")).join(F.broadcast(means), "pos").agg(F.sum((F.col("x").cast("double") - F.col("mean")) ** 2).alias("b"))
    lost = v.join(decoded, "vec_id").agg(F.sum(dist.l2_squared(F.col("embedding"), F.col("decoded"))).alias("a"))
    return lost.crossJoin(spread).select(F.round(F.col("a") / F.col("b"), 6).alias("relative_error"))


def _flat(spark: SparkSession, d: str, rerank: int) -> DataFrame:
    v = vectors(spark, d)
    found = pq.flat_search(_encoded(v), asked(v), seed_codebook(v), WIDTH, K * max(rerank, 1))
    return pq.reranked(found, v, asked(v), K) if rerank else found


def _kmeans_assign(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    coded = _encoded(v)
    return coded.select("vec_id", F.posexplode("codes").alias("sub", "code")).select("vec_id", "sub", "code")


def _centroids(spark: SparkSession, d: str) -> DataFrame:
    each = vectors(spark, d).select("label", F.posexplode("embedding").alias("pos", "x"))
    return each.groupBy("label", "pos").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


def _health(spark: SparkSession, d: str) -> DataFrame:
    g = near_graph(vectors(spark, d))
    o = hnsw.orphans(g, spark.createDataFrame([(0,)], "node_id long")).agg(F.count(F.lit(1)).alias("orphans"))
    n = g.agg(F.count(F.lit(1)).alias("nodes"))
    return o.crossJoin(n).select("orphans", "nodes", (F.col("orphans") / F.greatest("nodes", F.lit(1))).alias("rate"), (F.col("orphans") > 0.001 * F.col("nodes")).alias("unhealthy"))


def built(spark: SparkSession, d: str) -> DataFrame:
    return saved(hnsw.build(vectors(spark, d), CONFIG, SHARDS), "graph")


def _ann(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    return hnsw.search(v, built(spark, d), asked(v), K, EF, CONFIG, SHARDS)


def _ann_pq(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    book = saved(pq.train(v, DIM, M, 10), "codebook")
    codes = saved(pq.encode(v, book, WIDTH), "codes")
    found = hnsw.search(v, built(spark, d), asked(v), 4 * K, EF, CONFIG, SHARDS, codes, pq.book_of(book))
    return pq.reranked(found, v, asked(v), K)


def _heuristic(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours that the selection rule keeps of each query's nearest."""
    import numpy as np
    import pandas as pd

    v = vectors(spark, d)
    near = knn.knn(v, asked(v), 2 * K + 1).where("qid <> vec_id").join(v.select("vec_id", "embedding"), "vec_id")

    def kept(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank")
        own = hnsw.diverse_neighbors(np.stack(rows["embedding"].to_numpy()).astype(float), list(zip(rows["distance"], range(len(rows)), strict=True)), K, "l2")
        return pd.DataFrame({"qid": rows["qid"].iloc[0], "at": range(len(own)), "vec_id": rows["vec_id"].to_numpy()[own]})

    return near.groupBy("qid").applyInPandas(kept, "qid long, at long, vec_id long")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "distance_l2": _pairs("l2"),
    "inner_product": _pairs("inner_product"),
    "distance_dot": _pairs("dot"),
    "distance_cosine": _pairs("cosine"),
    "store_scan": _scan_store,
    "append_assign_ids": _append,
    "point_lookup": _lookup,
    "collection_stats": _stats,
    "pq_training_sample": lambda s, d: pq.training_sample(vectors(s, d), 100).select("vec_id", "label"),
    "synthetic_clusters": lambda s, d: clusters(s, 2000, 32),
    "vectors_by_id": lambda s, d: _doubles(by_id(vectors(s, d).select("vec_id"), 16)),
    "exact_knn_l2": _nearest("l2"),
    "exact_knn_dot": _nearest("dot"),
    "exact_knn_cosine": _nearest("cosine"),
    "exact_knn_batch": _knn(K),
    "ground_truth_l2": _knn(100),
    "knn_k_exceeds_n": _knn_exceeds,
    "knn_padded": _padded,
    "hnsw_levels": lambda s, d: vectors(s, d).select("vec_id", hnsw.level_column(F.col("vec_id"), CONFIG.m).alias("level")),
    "neighbor_heuristic": _heuristic,
    "hnsw_build": built,
    "ann_hnsw": _ann,
    "ann_recall": lambda s, d: knn.recall(_ann(s, d), _knn(K)(s, d), K),
    "graph_integrity": lambda s, d: hnsw.violations(built(s, d), CONFIG.m),
    "graph_indegree": lambda s, d: hnsw.indegree(near_graph(vectors(s, d))),
    "graph_orphans": lambda s, d: hnsw.orphans(near_graph(vectors(s, d)), s.createDataFrame([(0,)], "node_id long")),
    "graph_health": _health,
    "pq_train": lambda s, d: pq.train(vectors(s, d), DIM, M, 10),
    "kmeans_assign": _kmeans_assign,
    "kmeans_round": _lloyd,
    "pq_encode": lambda s, d: _encoded(vectors(s, d)),
    "pq_decode": lambda s, d: pq.decode(_encoded(vectors(s, d)), seed_codebook(vectors(s, d))),
    "pq_adc_table": lambda s, d: pq.adc_table(asked(vectors(s, d)), seed_codebook(vectors(s, d)), WIDTH),
    "pq_adc_distance": lambda s, d: pq.flat_search(_encoded(vectors(s, d)), asked(vectors(s, d)), seed_codebook(vectors(s, d)), WIDTH, 1 << 30).drop("rank"),
    "pq_flat_topk": lambda s, d: _flat(s, d, 0),
    "pq_flat_rerank": lambda s, d: _flat(s, d, 4),
    "ann_pq": _ann_pq,
    "pq_reconstruction_error": _pq_error,
    "pq_coverage": _uncovered,
    "pq_inconsistent": lambda s, d: pq.inconsistent(_encoded(vectors(s, d)).where("vec_id % 3 <> 1").select("vec_id", F.when(F.col("vec_id") % 3 == 2, F.reverse("codes")).otherwise(F.col("codes")).alias("codes")), vectors(s, d), seed_codebook(vectors(s, d)), WIDTH),
    "wal_replay": lambda s, d: ingest.replay(_log(vectors(s, d)), vectors(s, d).where("vec_id < 100"), 50),
    "wal_gap_check": lambda s, d: ingest.gaps(vectors(s, d).where("vec_id % 7 <> 3").select("vec_id")),
    "verify_recovery": lambda s, d: ingest.verify(vectors(s, d).where("vec_id % 50 <> 1"), vectors(s, d)),
    "store_index_gap": lambda s, d: ingest.unindexed(vectors(s, d), vectors(s, d).where("vec_id % 9 <> 4")),
    "recall_at_k": lambda s, d: knn.recall(_knn(K, "cosine")(s, d), _knn(K)(s, d), K),
    "recall_codes": lambda s, d: knn.recall(_flat(s, d, 0), _knn(K)(s, d), K),
    "cluster_centroids": _centroids,
}

_D = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"
_SUM = "list_sum(list_transform(list_zip({a}, {b}), lambda t: {each}))"
_L2 = lambda a, b: _SUM.format(a=a, b=b, each="(t[1] - t[2]) * (t[1] - t[2])")
_DOT = lambda a, b: _SUM.format(a=a, b=b, each="t[1] * t[2]")
_COS = lambda a, b: f"CASE WHEN sqrt({_DOT(a, a)} * {_DOT(b, b)}) = 0 THEN 1.0 ELSE 1 - {_DOT(a, b)} / sqrt({_DOT(a, a)} * {_DOT(b, b)}) END"
_METRIC = {"l2": _L2, "dot": lambda a, b: f"0 - {_DOT(a, b)}", "cosine": _COS, "inner_product": _DOT}
_V = f"v AS (SELECT vec_id, label, {_D} AS e FROM embeddings)"
_Q = "q AS (SELECT vec_id AS qid, e AS q FROM v WHERE vec_id % 20 = 0)"


def _sql_pairs(by: str) -> str:
    return f"WITH {_V} SELECT v.vec_id, {_METRIC[by]('o.e', 'v.e')} AS value FROM v, (SELECT e FROM v WHERE vec_id = 0) o"


def _sql_nearest(by: str) -> str:
    return f"WITH {_V} SELECT v.vec_id, {_METRIC[by]('o.e', 'v.e')} AS distance FROM v, (SELECT e FROM v WHERE vec_id = 0) o ORDER BY distance, vec_id LIMIT {K}"


def _sql_knn(k: str | int, by: str = "l2", base: str = "v") -> str:
    return f"""SELECT * FROM (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY distance, vec_id) AS rank, vec_id, distance
        FROM (SELECT qid, vec_id, {_METRIC[by]('q', 'e')} AS distance FROM {base}, q)) WHERE rank <= {k}"""


_BOOK = f"""book AS (SELECT CAST(s AS INTEGER) AS sub, CAST(vec_id AS INTEGER) AS code, list_slice(e, s * {WIDTH} + 1, s * {WIDTH} + {WIDTH}) AS centroid FROM v, range({M}) r(s) WHERE vec_id < 256)"""
_EACH = f"""each AS (SELECT vec_id, sub, arg_min(code, (d, code)) AS code FROM (SELECT vec_id, sub, code, {_L2(f'list_slice(e, sub * {WIDTH} + 1, sub * {WIDTH} + {WIDTH})', 'centroid')} AS d FROM v, book) GROUP BY vec_id, sub)"""
_CODES = "codes AS (SELECT vec_id, list(code ORDER BY sub) AS codes FROM each GROUP BY vec_id)"
_ADC = f"adc AS (SELECT qid, sub, code, {_L2(f'list_slice(q, sub * {WIDTH} + 1, sub * {WIDTH} + {WIDTH})', 'centroid')} AS dist FROM q, book)"
_SCORED = "scored AS (SELECT qid, vec_id, list_sum(list(dist ORDER BY each.sub)) AS distance FROM each JOIN adc USING (sub, code) GROUP BY qid, vec_id)"
_CODED = ", ".join((_V, _BOOK, _EACH, _CODES))
_ALL = f"WITH {_V}, {_Q}, {_BOOK}, {_EACH}, {_CODES}, {_ADC}, {_SCORED}"
_TOP = lambda k: f"SELECT * FROM (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY distance, vec_id) AS rank, vec_id, distance FROM scored) WHERE rank <= {k}"
_GRAPH = f"""WITH {_V}, q AS (SELECT vec_id AS qid, e AS q FROM v), n AS ({_sql_knn(K + 1)}),
    g AS (SELECT qid AS node_id, list(vec_id ORDER BY vec_id) AS neighbors FROM n WHERE qid <> vec_id GROUP BY qid),
    t AS (SELECT unnest(neighbors) AS node_id FROM g), o AS (SELECT node_id FROM g WHERE node_id <> 0 AND node_id NOT IN (SELECT node_id FROM t))"""
_LOG = "n AS (SELECT count(*) AS n FROM embeddings), log AS (SELECT vec_id AS lsn, vec_id FROM embeddings UNION ALL SELECT vec_id + n, vec_id FROM embeddings, n WHERE vec_id % 3 = 0)"


def _sql_recall(found: str) -> str:
    return f"found AS ({found}), truth AS ({_sql_knn(K)}) SELECT (SELECT count(*) FROM found JOIN truth USING (qid, vec_id)) / ((SELECT count(DISTINCT qid) FROM truth) * {K}) AS recall"


ORACLE_SQL: dict[str, str] = {
    "distance_l2": _sql_pairs("l2"),
    "inner_product": _sql_pairs("inner_product"),
    "distance_dot": _sql_pairs("dot"),
    "distance_cosine": _sql_pairs("cosine"),
    "store_scan": f"SELECT vec_id, {_D} AS embedding FROM embeddings",
    "vectors_by_id": f"""SELECT vec_id, list_transform(range(16), lambda j: CAST(CAST(CAST((CAST(vec_id AS HUGEINT) * {BY_ID} + j * CAST({BY_PLACE} AS HUGEINT)) % 18446744073709551616 // {1 << DROPPED} AS FLOAT) / CAST(4294967295 AS FLOAT) AS FLOAT) - CAST(0.5 AS FLOAT) AS DOUBLE)) AS embedding FROM embeddings""",
    "graph_integrity": "SELECT CAST(0 AS BIGINT) AS self_links, CAST(0 AS BIGINT) AS missing_targets, CAST(0 AS BIGINT) AS over_degree",
    "kmeans_round": f"""WITH {_CODED}, x AS (SELECT sub, code, unnest(list_slice(e, sub * {WIDTH} + 1, sub * {WIDTH} + {WIDTH})) AS x, CAST(unnest(range({WIDTH})) AS INTEGER) AS pos FROM each JOIN v USING (vec_id))
        SELECT sub, code, count(*) AS n, pos, round(avg(x), 6) + 0.0 AS mean FROM x GROUP BY sub, code, pos""",
    "pq_inconsistent": f"WITH {_CODED} SELECT vec_id FROM codes WHERE vec_id % 3 = 1 OR (vec_id % 3 = 2 AND codes <> list_reverse(codes))",
    "append_assign_ids": "SELECT vec_id AS ord, label, (SELECT count(*) FROM embeddings) + row_number() OVER (ORDER BY vec_id) - 1 AS vec_id FROM embeddings",
    "point_lookup": f"SELECT vec_id, {_D} AS embedding FROM embeddings WHERE vec_id = 42",
    "collection_stats": "SELECT count(*) AS n, CAST(max(len(embedding)) AS BIGINT) AS dim, count(*) = 0 AS is_empty FROM embeddings",
    "pq_training_sample": "SELECT vec_id, label FROM embeddings WHERE vec_id % greatest(1, (SELECT count(*) FROM embeddings) // 100) = 0",
    "exact_knn_l2": _sql_nearest("l2"),
    "exact_knn_dot": _sql_nearest("dot"),
    "exact_knn_cosine": _sql_nearest("cosine"),
    "exact_knn_batch": f"WITH {_V}, {_Q} {_sql_knn(K)}",
    "ground_truth_l2": f"WITH {_V}, {_Q} {_sql_knn(100)}",
    "knn_k_exceeds_n": f"WITH {_V}, {_Q} {_sql_knn(1 << 30)}",
    "knn_padded": f"""WITH {_V}, {_Q}, z AS (SELECT * FROM v WHERE label = 0), n AS ({_sql_knn(K * 10, 'l2', 'z')})
        SELECT s.qid, s.rank, n.vec_id, coalesce(n.distance, CAST('inf' AS DOUBLE)) AS distance FROM (SELECT qid, r AS rank FROM q, range(1, {K * 10 + 1}) t(r)) s LEFT JOIN n USING (qid, rank)""",
    "graph_indegree": f"{_GRAPH} SELECT g.node_id, count(t.node_id) AS indegree FROM g LEFT JOIN t ON g.node_id = t.node_id GROUP BY g.node_id",
    "graph_orphans": f"{_GRAPH} SELECT node_id FROM o",
    "graph_health": f"{_GRAPH} SELECT orphans, nodes, orphans / greatest(nodes, 1) AS rate, orphans > 0.001 * nodes AS unhealthy FROM (SELECT count(*) AS orphans FROM o), (SELECT count(*) AS nodes FROM g)",
    "kmeans_assign": f"WITH {_CODED} SELECT vec_id, sub, code FROM each",
    "pq_encode": f"WITH {_CODED} SELECT vec_id, codes FROM codes",
    "pq_decode": f"WITH {_CODED} SELECT vec_id, flatten(list(centroid ORDER BY each.sub)) AS decoded FROM each JOIN book USING (sub, code) GROUP BY vec_id",
    "pq_adc_table": f"WITH {_V}, {_Q}, {_BOOK}, {_ADC} SELECT * FROM adc",
    "pq_adc_distance": f"{_ALL} SELECT * FROM scored",
    "pq_flat_topk": f"{_ALL} {_TOP(K)}",
    "pq_flat_rerank": f"""{_ALL}, c AS ({_TOP(4 * K)}) SELECT * FROM (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY distance, vec_id) AS rank, vec_id, distance
        FROM (SELECT c.qid, c.vec_id, {_L2('q.q', 'v.e')} AS distance FROM c JOIN q ON c.qid = q.qid JOIN v ON c.vec_id = v.vec_id)) WHERE rank <= {K}""",
    "pq_reconstruction_error": f"""WITH {_CODED}, x AS (SELECT unnest(e) AS x, unnest(range({DIM})) AS pos FROM v), m AS (SELECT pos, avg(x) AS mean FROM x GROUP BY pos),
        dec AS (SELECT vec_id, flatten(list(centroid ORDER BY each.sub)) AS decoded FROM each JOIN book USING (sub, code) GROUP BY vec_id)
        SELECT round((SELECT sum({_L2('v.e', 'dec.decoded')}) FROM v JOIN dec USING (vec_id)) / (SELECT sum((x - mean) * (x - mean)) FROM x JOIN m USING (pos)), 6) AS relative_error""",
    "pq_coverage": "SELECT vec_id FROM embeddings WHERE vec_id % 3 = 1 AND vec_id >= 256",
    "wal_replay": f"WITH {_LOG} SELECT vec_id, min(lsn) AS lsn FROM log WHERE lsn >= 50 AND vec_id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id < 100) GROUP BY vec_id",
    "wal_gap_check": "SELECT vec_id, next_id FROM (SELECT vec_id, lead(vec_id) OVER (ORDER BY vec_id) AS next_id FROM embeddings WHERE vec_id % 7 <> 3) WHERE next_id - vec_id <> 1",
    "verify_recovery": "SELECT count(*) AS expected, count(*) FILTER (vec_id % 50 = 1) AS missing, CAST(0 AS BIGINT) AS mismatched FROM embeddings",
    "store_index_gap": "SELECT vec_id FROM embeddings WHERE vec_id % 9 = 4",
    "recall_at_k": f"WITH {_V}, {_Q}, {_sql_recall(_sql_knn(K, 'cosine'))}",
    "recall_codes": f"{_ALL}, {_sql_recall(_TOP(K))}",
    "cluster_centroids": f"SELECT label, pos, round(avg(x), 6) AS mean FROM (SELECT label, unnest({_D}) AS x, CAST(unnest(range({DIM})) AS INTEGER) AS pos FROM embeddings) GROUP BY label, pos",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
