"""Token divergences and embedding distances."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import adapters as A
from checks.registry import check, r, tidy
from hearken.operators import divergence as D
from hearken.operators import vectors as V
from hearken.sources.tokens import first_codebook, read_embeddings, token_table

BOTH = """bt AS (SELECT coalesce(p.pair_key, q.pair_key) AS pair_key, coalesce(p.step, q.step) AS step, coalesce(p.token_id, q.token_id) AS token_id, p.logprob AS lp, q.logprob AS lq
    FROM (SELECT * FROM tok WHERE side = 'p') p FULL JOIN (SELECT * FROM tok WHERE side = 'q') q ON p.pair_key = q.pair_key AND p.step = q.step AND p.token_id = q.token_id)"""
DIV = f"""{A.TOKENS}, {BOTH}, bm AS (SELECT *, ln((coalesce(exp(lp), 0) + coalesce(exp(lq), 0)) / 2) AS lm FROM bt),
    dv AS (SELECT pair_key, step, coalesce(sum(exp(lp) * (lp - lq)), 0) AS kl_pq, coalesce(sum(exp(lq) * (lq - lp)), 0) AS kl_qp,
        0.5 * coalesce(sum(exp(lp) * (lp - lm)), 0) + 0.5 * coalesce(sum(exp(lq) * (lq - lm)), 0) AS js,
        coalesce(-sum(exp(lp) * lp), 0) AS entropy_p, coalesce(-sum(exp(lq) * lq), 0) AS entropy_q FROM bm GROUP BY 1, 2 HAVING count(lp) > 0 AND count(lq) > 0)"""


@check("d12_divergence", f"WITH {DIV} SELECT pair_key, step, " + ", ".join(f"{r(c)} AS {c}" for c in ("kl_pq", "kl_qp", "js", "entropy_p", "entropy_q")) + " FROM dv")
def d12(spark, sf):
    return tidy(D.divergence(A.tokens(spark, sf)))


@check("d12_common_extent", f"WITH {A.TOKENS}, mx AS (SELECT pair_key, least(max(step) FILTER (side = 'p'), max(step) FILTER (side = 'q')) AS s, "
       "least(max(token_id) FILTER (side = 'p'), max(token_id) FILTER (side = 'q')) AS t FROM tok GROUP BY 1) "
       f"SELECT tok.pair_key, side, count(*) AS n, {r('sum(exp(logprob))')} AS mass FROM tok JOIN mx ON mx.pair_key = tok.pair_key WHERE step <= s AND token_id <= t GROUP BY 1, 2")
def d12e(spark, sf):
    return tidy(D.common_extent(A.tokens(spark, sf)).groupBy("pair_key", "side").agg(F.count(F.lit(1)).alias("n"), F.sum(F.exp("logprob")).alias("mass")))


TOP = f"""{A.TOKENS}, tk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pair_key, side, step ORDER BY round(logprob, 9) DESC, token_id) AS rank FROM tok) WHERE rank <= 3)"""


def _top3(spark, sf):
    t = A.tokens(spark, sf).withColumn("logprob", F.round("logprob", 9))
    return D.top_k(t, ["pair_key", "side", "step"], 3)


@check("f3_top_k_tokens", f"WITH {TOP} SELECT pair_key, side, step, token_id, {r('logprob')} AS logprob, rank FROM tk")
def f3(spark, sf):
    return tidy(_top3(spark, sf))


@check("d13_c14_divergence_topk", f"WITH {TOP.replace('tok AS', 'tok0 AS').replace('FROM tok)', 'FROM (SELECT pair_key, side, step, token_id, round(logprob, 9) AS logprob FROM tok0) x)')}, "
       f"{BOTH.replace('FROM tok WHERE', 'FROM tk WHERE')}, fl AS (SELECT pair_key, step, coalesce(exp(lp), 0) AS rp, coalesce(exp(lq), 0) AS rq FROM bt), "
       """ms AS (SELECT pair_key, step, greatest(1 - sum(rp), 1e-12) AS op, greatest(1 - sum(rq), 1e-12) AS oq FROM fl GROUP BY 1, 2 HAVING count(*) FILTER (rp > 0) > 0 AND count(*) FILTER (rq > 0) > 0),
       al AS (SELECT fl.pair_key, fl.step, greatest(rp, 1e-12) AS p, greatest(rq, 1e-12) AS q FROM fl JOIN ms ON ms.pair_key = fl.pair_key AND ms.step = fl.step UNION ALL SELECT pair_key, step, op, oq FROM ms),
       nm AS (SELECT pair_key, step, p / sum(p) OVER w AS p, q / sum(q) OVER w AS q FROM al WINDOW w AS (PARTITION BY pair_key, step)) """
       f"SELECT pair_key, step, {r('sum(p * (ln(p) - ln(q)))')} AS kl_pq, {r('sum(q * (ln(q) - ln(p)))')} AS kl_qp, "
       f"{r('sum(0.5 * p * (ln(p) - ln((p + q) / 2)) + 0.5 * q * (ln(q) - ln((p + q) / 2)))')} AS js, 'topk_approx' AS type FROM nm GROUP BY 1, 2")
def d13(spark, sf):
    return tidy(D.divergence_topk(_top3(spark, sf)))


@check("d14_summarize", f"WITH {DIV} SELECT pair_key, count(*) AS num_steps, " + ", ".join(
    f"{r(f'avg({c})')} AS {c}_mean, {r(f'stddev_pop({c})')} AS {c}_std, {r(f'min({c})')} AS {c}_min, {r(f'max({c})')} AS {c}_max, "
    f"{r(f'quantile_cont({c}, 0.5)')} AS {c}_p50, {r(f'quantile_cont({c}, 0.9)')} AS {c}_p90, {r(f'quantile_cont({c}, 0.95)')} AS {c}_p95" for c in ("kl_pq", "kl_qp", "js"))
    + f", {r('avg(entropy_p)')} AS entropy_p_mean, {r('avg(entropy_q)')} AS entropy_q_mean FROM dv GROUP BY 1")
def d14(spark, sf):
    return tidy(D.summarize(D.divergence(A.tokens(spark, sf)), ["pair_key"], ["kl_pq", "kl_qp", "js"], ["entropy_p", "entropy_q"]))


@check("a6_token_table", f"WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS token_id, unnest(embedding) AS v FROM embeddings) "
       f"SELECT token_id, count(*) AS n, {r('sum(CAST(v AS DOUBLE))', 4)} AS s, 'full' AS kind FROM e GROUP BY 1")
def a6(spark, sf):
    e = A.load(spark, sf, "embeddings").select(F.col("vec_id").alias("pair_key"), F.lit("p").alias("side"), F.lit(0).alias("step"), F.col("embedding").alias("logprobs"))
    t = token_table(e)
    return tidy(t.groupBy("token_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("logprob").alias("s")), 4)


@check("a7_read_embeddings", f"SELECT vec_id, len(embedding) AS dims, {r('list_sum([CAST(x AS DOUBLE) for x in embedding])')} AS total FROM embeddings")
def a7(spark, sf):
    e = read_embeddings(spark, f"{sf}/embeddings.parquet", "vec_id")
    return tidy(e.select("vec_id", F.size("embedding").alias("dims"), V.dot(F.col("embedding"), F.transform("embedding", lambda x: F.lit(1.0))).alias("total")))


@check("h6_first_codebook", f"SELECT vec_id, {r('list_sum([CAST(embedding[i] AS DOUBLE) for i in range(1, 65, 4)])')} AS total FROM embeddings")
def h6(spark, sf):
    e = first_codebook(A.load(spark, sf, "embeddings").withColumn("embedding", F.col("embedding")), "embedding")
    return tidy(e.select("vec_id", F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double")).alias("total")))


_DOT = "list_sum([CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE) for z in list_zip({a}, {b})])"


def _dot(a, b):
    return _DOT.format(a=a, b=b)


COS = f"({_dot('ref', 'test')} / (greatest(sqrt({_dot('ref', 'ref')}), 1e-8) * greatest(sqrt({_dot('test', 'test')}), 1e-8)))"


@check("d16_vector_distances", f"WITH {A.VEC} SELECT pair_key, {r(COS)} AS cosine_similarity, {r(f'1.0 - {COS}')} AS cosine_distance, "
       f"{r('sqrt(list_sum([pow(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE), 2) for z in list_zip(ref, test)]))')} AS l2_distance FROM vp")
def d16(spark, sf):
    return tidy(V.vector_distances(A.vec_pairs(spark, sf)).select("pair_key", "cosine_similarity", "cosine_distance", "l2_distance"))


@check("c6_pair_items", f"SELECT r.vec_id AS key, {r(_dot('r.embedding', 't.embedding'))} AS dot FROM embeddings r JOIN embeddings t ON t.vec_id = r.vec_id WHERE r.label < t.vec_id")
def c6(spark, sf):
    e = A.load(spark, sf, "embeddings").withColumnRenamed("vec_id", "key")
    p = V.pair_items(e.drop("label"), e.filter("label < key").drop("label"), "key")
    return tidy(p.select("key", V.dot(F.col("ref"), F.col("test")).alias("dot")))


POOL = """ed AS (SELECT label, generate_subscripts(embedding, 1) AS d, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
    pd AS (SELECT label, d, avg(v) AS m, stddev_samp(v) AS s FROM ed GROUP BY 1, 2)"""


@check("d15_pool_embeddings", f"WITH {POOL} SELECT CAST(label AS BIGINT) AS label, d AS dim, {r('m')} AS value FROM pd UNION ALL SELECT label, d + 64, {r('s')} FROM pd")
def d15(spark, sf):
    p = V.pool_embeddings(A.load(spark, sf, "embeddings"), ["label"], how="mean_std")
    return tidy(p.select("label", F.posexplode("embedding").alias("dim", "value")).withColumn("dim", F.col("dim") + 1))


@check("d17_set_moments", f"""WITH {POOL}, n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) SELECT CAST(pd.label AS BIGINT) AS label, max(n) AS n_rows,
    {r('sum(m * m)')} AS mean_norm2, {r('sum(s * s + 1e-6)')} AS cov_trace FROM pd JOIN n ON n.label = pd.label GROUP BY 1""")
def d17m(spark, sf):
    return tidy(V.set_summary(V.moments(A.load(spark, sf, "embeddings"), set_col="label"), "label"))


HALVES = POOL.replace("SELECT label, generate", "SELECT CAST(label >= 5 AS INT) AS label, generate")


def halves(spark, sf):
    """All embeddings as two sets: labels below five and the others."""
    return A.load(spark, sf, "embeddings").withColumn("label", (F.col("label") >= 5).cast("int"))


@check("d17_frechet_parts", f"""WITH {HALVES}, a AS (SELECT * FROM pd WHERE label = 0), b AS (SELECT * FROM pd WHERE label = 1)
    SELECT {r('sum((a.m - b.m) * (a.m - b.m))')} AS mean_term, {r('sum(a.s * a.s + 1e-6)')} AS trace_left, {r('sum(b.s * b.s + 1e-6)')} AS trace_right,
    (SELECT count(*) FROM embeddings WHERE label < 5) AS n_left, (SELECT count(*) FROM embeddings WHERE label >= 5) AS n_right,
    CAST(1 AS BIGINT) AS root_is_consistent FROM a JOIN b ON a.d = b.d""")
def d17p(spark, sf):
    """The root trace cannot be written in SQL; its bound 0 <= tr root <= sqrt(tr Cx * tr Cy) and the total are certified."""
    f = V.frechet(halves(spark, sf), 0, 1, set_col="label")
    ok = (
        (F.col("root_trace") >= 0)
        & (F.col("root_trace") <= F.sqrt(F.col("trace_left") * F.col("trace_right")) + 1e-9)
        & (F.abs(F.col("frechet_distance") - (F.col("mean_term") + F.col("trace_left") + F.col("trace_right") - 2 * F.col("root_trace"))) < 1e-9)
    )
    return tidy(f.withColumn("root_is_consistent", ok).drop("frechet_distance", "root_trace"))
