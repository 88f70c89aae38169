"""Queries on embeddings, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import vectors as V
from ..session import table

_UNIT = """
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) v FROM embeddings WHERE embedding IS NOT NULL),
u AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v) + 1e-5)) u FROM e)"""
_RANK = (
    _UNIT
    + """, m AS (SELECT label, list(x ORDER BY pos) v FROM (SELECT label, pos, avg(x) x FROM (SELECT label, unnest(u) x, unnest(range(len(u))) pos FROM u WHERE label IS NOT NULL) GROUP BY 1, 2) GROUP BY 1),
p AS (SELECT label cand, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v) + 1e-5)) proto FROM m),
r AS (SELECT vec_id, label, cand, 100 * list_dot_product(u, proto) score, row_number() OVER (PARTITION BY vec_id ORDER BY list_dot_product(u, proto) DESC, cand) AS rank FROM u, p)"""
)


def _emb(spark, d):
    return table(spark, d, "embeddings")


def rank_topk_accuracy(spark, d):
    return V.topk_accuracy(V.own_ranks(_emb(spark, d)))


def label_space_top5(spark, d):
    r = V.ranked_labels(_emb(spark, d), 5)
    return r.select("vec_id", "cand", F.round("score", 4).alias("score"), "rank")


def avg_pairwise_cosine(spark, d):
    r = V.mean_pairwise_cosine(_emb(spark, d), "label")
    return r.select("label", "n", F.round("avg_cos", 6).alias("avg_cos"), (F.col("avg_cos") > 0.9).alias("too_alike"))


def pair_cosines(spark, d):
    """All pairs inside groups of four neighbouring vectors (the frames of one video)."""
    e = _emb(spark, d).where("embedding is not null").select(F.floor(F.col("vec_id") / 4).alias("grp"), "vec_id", "embedding")
    b = e.select("grp", F.col("vec_id").alias("vec_b"), F.col("embedding").alias("eb"))
    return e.join(b, "grp").where("vec_id < vec_b").select(F.col("vec_id").alias("vec_a"), "vec_b", F.round(A.cosine(F.col("embedding"), F.col("eb")), 6).alias("cos"))


def class_max_sum(spark, d):
    r = V.class_max_sum(_emb(spark, d), "label", "embedding")
    return r.select("label", F.round("expectation", 4).alias("expectation"), (F.col("expectation") < 1.0).alias("too_few"))


def contrastive_loss(spark, d):
    """Batches of 32 neighbouring vectors; y is the unit vector moved by one place."""
    u = _emb(spark, d).where("embedding is not null").select(F.floor(F.col("vec_id") / 32).alias("batch"), "vec_id", A.unit(F.col("embedding")).alias("x"))
    u = u.withColumn("y", F.concat(F.slice("x", 2, 1_000_000), F.slice("x", 1, 1)))
    return V.contrastive_loss(u, "batch", "vec_id", "x", "y", 10.0).select("batch", "n", F.round("loss", 5).alias("loss"))


def masked_loss(spark, d):
    """Mean of a loss over flagged rows by label, with a guard against empty groups."""
    e = _emb(spark, d).where("embedding is not null").select("label", F.col("embedding")[0].cast("double").alias("loss"), (F.col("embedding")[1] > 0).cast("int").alias("flag"))
    return e.groupBy("label").agg(F.round(F.sum(F.col("loss") * F.col("flag")) / (F.sum("flag") + 1e-5), 6).alias("masked_mean"))


def one_hot_pool(spark, d):
    r = V.one_hot_pool(_emb(spark, d), "label", F.col("embedding")[0] > 0, "embedding")
    return r.select("label", "pos", F.round("total", 4).alias("total"))


def softmax_argmax(spark, d):
    x = F.slice(F.col("embedding").cast("array<double>"), 1, 5)
    rows = _emb(spark, d).where("size(embedding) >= 5").select("vec_id", x.alias("x"))
    p = A.softmax(F.col("x"))
    return rows.select("vec_id", A.argmax(F.col("x")).alias("pred"), F.round(F.array_max(p), 6).alias("prob"), F.round(F.array_max(A.log_softmax(F.col("x"))), 6).alias("log_prob"))


def joint_head(spark, d):
    """Argmax of the sum of two heads' softmaxes."""
    e = F.col("embedding").cast("array<double>")
    rows = _emb(spark, d).where("size(embedding) >= 10").select("vec_id", F.slice(e, 1, 5).alias("a"), F.slice(e, 6, 5).alias("t"))
    both = F.zip_with(A.softmax(F.col("a")), A.softmax(F.col("t")), lambda x, y: x + y)
    return rows.select("vec_id", A.argmax(F.col("a")).alias("audio"), A.argmax(F.col("t")).alias("text"), A.argmax(both).alias("joint"))


def accuracy_heads(spark, d):
    """Accuracy of three heads against the label modulo 5; padding rows have no label."""
    gold = _emb(spark, d).where("label is not null").select("vec_id", F.pmod("label", F.lit(5)).alias("gold"))
    j = joint_head(spark, d).join(gold, "vec_id")
    return j.agg(*[F.round(F.avg((F.col(h) == F.col("gold")).cast("int")), 6).alias(f"{h}_acc") for h in ("audio", "text", "joint")], F.count("*").alias("n"))


def missing_counts_wrong(spark, d):
    """Items without an answer count as wrong: those of which the best label leads by less than
    one point are left unanswered."""
    gold = _emb(spark, d).select("vec_id", "label")
    two = V.ranked_labels(_emb(spark, d), 2).groupBy("vec_id").agg(F.min_by("cand", "rank").alias("cand"), (F.max("score") - F.min("score")).alias("lead"))
    ans = two.where("lead >= 1").select("vec_id", "cand")
    return gold.join(ans, "vec_id", "left").agg(F.round(F.avg(F.coalesce((F.col("cand") == F.col("label")).cast("int"), F.lit(0))), 6).alias("accuracy"), F.count("*").alias("n"))


def distinct_top5(spark, d):
    """Labels as verb * 2 + noun: the first five different nouns of each ranking."""
    r = V.ranked_labels(_emb(spark, d)).withColumn("noun", F.floor(F.col("cand") / 2))
    first = r.groupBy("vec_id", "noun").agg(F.min("rank").alias("first_rank"))
    k = first.withColumn("k", F.row_number().over(Window.partitionBy("vec_id").orderBy("first_rank")))
    return k.where("k <= 5").select("vec_id", "noun", "first_rank", "k")


def qa_pairs(spark, d):
    """Two heads that must both be right: accuracy of the answer, of the reason, and of both."""
    gold = _emb(spark, d).where("label is not null").select("vec_id", F.pmod("label", F.lit(5)).alias("gold"))
    j = joint_head(spark, d).join(gold, "vec_id").select((F.col("audio") == F.col("gold")).cast("int").alias("a"), (F.col("text") == F.col("gold")).cast("int").alias("r"))
    return j.agg(F.round(F.avg("a"), 6).alias("qa"), F.round(F.avg("r"), 6).alias("qar"), F.round(F.avg(F.col("a") * F.col("r")), 6).alias("both"), F.count("*").alias("n"))


def part_accuracy(spark, d):
    """Labels as verb * 2 + noun: top-1 and top-5 accuracy of the label, of its verb and of its
    noun, the last two over different values in order of their first place."""
    r = V.ranked_labels(_emb(spark, d)).where("label is not null")
    parts = F.array(F.struct(F.lit("action").alias("part"), F.col("cand").alias("v"), (F.col("cand") == F.col("label")).alias("hit")), F.struct(F.lit("verb").alias("part"), F.floor(F.col("cand") / 2).alias("v"), (F.floor(F.col("cand") / 2) == F.floor(F.col("label") / 2)).alias("hit")), F.struct(F.lit("noun").alias("part"), (F.col("cand") % 2).alias("v"), (F.col("cand") % 2 == F.col("label") % 2).alias("hit")))
    first = r.select("vec_id", "rank", F.explode(parts).alias("x")).groupBy("vec_id", "x.part", "x.v").agg(F.min("rank").alias("rank"), F.max("x.hit").alias("hit"))
    place = first.withColumn("k", F.row_number().over(Window.partitionBy("vec_id", "part").orderBy("rank")))
    best = place.groupBy("vec_id", "part").agg(F.min(F.when(F.col("hit"), F.col("k"))).alias("k"))
    return best.groupBy("part").agg(F.round(F.avg((F.coalesce(F.col("k"), F.lit(99)) <= 1).cast("int")), 6).alias("top1"), F.round(F.avg((F.coalesce(F.col("k"), F.lit(99)) <= 5).cast("int")), 6).alias("top5"), F.count("*").alias("n"))


def dimension_stats(spark, d):
    """Mean and deviation of each place of the vectors."""
    rows = _emb(spark, d).where("embedding is not null").select(F.posexplode("embedding").alias("pos", "x"))
    return rows.groupBy("pos").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"), F.round(F.stddev_pop(F.col("x").cast("double")), 6).alias("std"))


def batch_topk(spark, d):
    """The 20 greatest scores of the whole batch."""
    r = V.ranked_labels(_emb(spark, d), 1).orderBy(F.desc("score"), "vec_id").limit(20)
    return r.select("vec_id", "cand", F.round("score", 4).alias("score"))


_SM = _UNIT + """, s AS (SELECT vec_id, label, v[1:5] a, v[6:10] t FROM e WHERE len(v) >= 10),
x AS (SELECT *, list_transform(a, lambda z: exp(z - list_max(a))) ea, list_transform(t, lambda z: exp(z - list_max(t))) et FROM s),
y AS (SELECT *, list_transform(ea, lambda z: z / list_sum(ea)) pa, list_transform(et, lambda z: z / list_sum(et)) pt FROM x),
j AS (SELECT *, [pa[1] + pt[1], pa[2] + pt[2], pa[3] + pt[3], pa[4] + pt[4], pa[5] + pt[5]] b FROM y),
h AS (SELECT vec_id, label, list_position(a, list_max(a)) - 1 AS audio, list_position(t, list_max(t)) - 1 AS text, list_position(b, list_max(b)) - 1 AS joint FROM j)"""

QUERIES = {f.__name__: f for f in (rank_topk_accuracy, label_space_top5, avg_pairwise_cosine, pair_cosines, class_max_sum, contrastive_loss, masked_loss, one_hot_pool, softmax_argmax, joint_head, accuracy_heads, missing_counts_wrong, distinct_top5, batch_topk, qa_pairs, part_accuracy, dimension_stats)}
SQL = {
    "qa_pairs": _SM + "SELECT round(avg(CAST(audio = label % 5 AS INT)), 6) AS qa, round(avg(CAST(text = label % 5 AS INT)), 6) AS qar, round(avg(CAST(audio = label % 5 AND text = label % 5 AS INT)), 6) AS both, count(*) AS n FROM h WHERE label IS NOT NULL",
    "part_accuracy": _RANK + ", x AS (SELECT vec_id, rank, unnest(['action', 'verb', 'noun']) part, unnest([cand, cand // 2, cand % 2]) v, unnest([cand = label, cand // 2 = label // 2, cand % 2 = label % 2]) hit FROM r WHERE label IS NOT NULL), fx AS (SELECT vec_id, part, v, min(rank) rank, bool_or(hit) hit FROM x GROUP BY 1, 2, 3), pl AS (SELECT *, row_number() OVER (PARTITION BY vec_id, part ORDER BY rank) k FROM fx), b AS (SELECT vec_id, part, coalesce(min(k) FILTER (hit), 99) k FROM pl GROUP BY 1, 2) SELECT part, round(avg(CAST(k <= 1 AS INT)), 6) AS top1, round(avg(CAST(k <= 5 AS INT)), 6) AS top5, count(*) AS n FROM b GROUP BY 1",
    "dimension_stats": _UNIT + "SELECT CAST(pos AS INT) AS pos, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM (SELECT unnest(v) x, unnest(range(len(v))) pos FROM e) GROUP BY 1",
    "rank_topk_accuracy": _RANK + "SELECT round(100 * avg(CAST(rank <= 1 AS INT)), 3) top1, round(100 * avg(CAST(rank <= 5 AS INT)), 3) top5, round(100 * avg(CAST(rank <= 10 AS INT)), 3) top10, count(*) n FROM r WHERE cand = label",
    "label_space_top5": _RANK + "SELECT vec_id, cand, round(score, 4) AS score, rank FROM r WHERE rank <= 5",
    "avg_pairwise_cosine": _UNIT + ", q AS (SELECT label, count(*) n FROM e GROUP BY 1), c AS (SELECT a.label, avg(list_cosine_similarity(a.v, b.v)) c FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY 1) SELECT q.label, n, round(c, 6) AS avg_cos, c > 0.9 AS too_alike FROM q LEFT JOIN c USING (label)",
    "pair_cosines": _UNIT + "SELECT a.vec_id AS vec_a, b.vec_id AS vec_b, round(list_cosine_similarity(a.v, b.v), 6) AS cos FROM e a JOIN e b ON a.vec_id // 4 = b.vec_id // 4 AND a.vec_id < b.vec_id",
    "class_max_sum": _UNIT + ", m AS (SELECT label, pos, max(x) x FROM (SELECT label, unnest(v) x, unnest(range(len(v))) pos FROM e) GROUP BY 1, 2) SELECT label, round(sum(CASE WHEN CAST(x AS FLOAT) > 0.3 THEN x ELSE 0 END), 4) AS expectation, sum(CASE WHEN x > 0.3 THEN x ELSE 0 END) < 1.0 AS too_few FROM m GROUP BY 1",
    "contrastive_loss": _UNIT + """, xy AS (SELECT vec_id // 32 AS batch, vec_id, u x, list_concat(u[2:], u[1:1]) y FROM u),
z AS (SELECT a.batch, a.vec_id i, b.vec_id j, 10 * list_dot_product(a.x, b.y) z FROM xy a JOIN xy b USING (batch)),
r AS (SELECT batch, i, max(z) + ln(sum(exp(z - m))) l, max(CASE WHEN i = j THEN z END) o FROM (SELECT *, max(z) OVER (PARTITION BY batch, i) m FROM z) GROUP BY 1, 2),
c AS (SELECT batch, j, max(z) + ln(sum(exp(z - m))) l, max(CASE WHEN i = j THEN z END) o FROM (SELECT *, max(z) OVER (PARTITION BY batch, j) m FROM z) GROUP BY 1, 2)
SELECT r.batch, count(*) AS n, round((avg(r.l - r.o) + any_value(k)) / 2, 5) AS loss FROM r JOIN (SELECT batch, avg(l - o) k FROM c GROUP BY 1) USING (batch) GROUP BY 1""",
    "masked_loss": _UNIT + "SELECT label, round(sum(v[1] * CAST(v[2] > 0 AS INT)) / (sum(CAST(v[2] > 0 AS INT)) + 1e-5), 6) AS masked_mean FROM e GROUP BY 1",
    "one_hot_pool": _UNIT + "SELECT label, CAST(pos AS INT) AS pos, round(sum(x), 4) AS total FROM (SELECT label, unnest(v) x, unnest(range(len(v))) pos FROM e WHERE v[1] > 0) GROUP BY 1, 2",
    "softmax_argmax": _UNIT + ", s AS (SELECT vec_id, v[1:5] a FROM e WHERE len(v) >= 5), x AS (SELECT vec_id, a, list_max(a) m, list_sum(list_transform(a, lambda z: exp(z - list_max(a)))) t FROM s) SELECT vec_id, CAST(list_position(a, m) - 1 AS INT) AS pred, round(1 / t, 6) AS prob, round(-ln(t), 6) AS log_prob FROM x",
    "joint_head": _SM + "SELECT vec_id, CAST(audio AS INT) AS audio, CAST(text AS INT) AS text, CAST(joint AS INT) AS joint FROM h",
    "accuracy_heads": _SM + "SELECT round(avg(CAST(audio = label % 5 AS INT)), 6) AS audio_acc, round(avg(CAST(text = label % 5 AS INT)), 6) AS text_acc, round(avg(CAST(joint = label % 5 AS INT)), 6) AS joint_acc, count(*) AS n FROM h WHERE label IS NOT NULL",
    "missing_counts_wrong": _RANK + "SELECT round(avg(coalesce(CAST(r.cand = g.label AS INT), 0)), 6) AS accuracy, count(*) AS n FROM embeddings g LEFT JOIN (SELECT vec_id, arg_min(cand, rank) cand FROM r WHERE rank <= 2 GROUP BY 1 HAVING max(score) - min(score) >= 1) r ON g.vec_id = r.vec_id",
    "distinct_top5": _RANK + ", f AS (SELECT vec_id, cand // 2 AS noun, min(rank) AS first_rank FROM r GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY first_rank) k FROM f) SELECT vec_id, CAST(noun AS BIGINT) AS noun, first_rank, k FROM k WHERE k <= 5",
    "batch_topk": _RANK + "SELECT vec_id, cand, round(score, 4) AS score FROM r WHERE rank = 1 ORDER BY r.score DESC, vec_id LIMIT 20",
}
