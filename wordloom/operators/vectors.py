"""Vector operators: label spaces, rankings, similarity, contrastive loss, pooling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import dot, unit

#: The largest label space that is broadcast; a larger one is taken in blocks of this size.
LABEL_BLOCK = 20_000


def prototypes(vectors: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """(label, proto): the mean of each label's unit vectors, made a unit vector. Sums are
    taken element by element, with partial aggregation, so a label may have any size."""
    parts = vectors.where(F.col(label).isNotNull() & F.col(vector).isNotNull()).select(label, F.posexplode(unit(F.col(vector))).alias("pos", "x"))
    mean = parts.groupBy(label, "pos").agg(F.avg("x").alias("x"))
    rows = mean.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("v"))  # one entry a dimension
    return rows.select(label, unit(F.transform("v", lambda p: p["x"])).alias("proto"))


def against_labels(queries: DataFrame, labels: DataFrame, q: Column, l: Column, scale: float = 100.0) -> DataFrame:  # noqa: E741
    """Every query row with every label and their score. The label space is a stated set,
    whose size is counted: it is broadcast whole, or in blocks of LABEL_BLOCK."""
    blocks = (max(labels.count(), 1) - 1) // LABEL_BLOCK + 1
    out = None
    for b in range(blocks):
        part = labels if blocks == 1 else labels.where(F.pmod(F.xxhash64(*labels.columns), F.lit(blocks)) == b)
        rows = queries.join(F.broadcast(part), how="cross").withColumn("score", scale * dot(q, l))
        out = rows if out is None else out.unionByName(rows)
    return out


def label_rankings(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, ranking): each vector's labels by falling score, equal scores by label, as
    an array of struct(s, cand), s the negative score. The label space is one row that all
    vectors see, so a ranking is made inside its vector's row, without a shuffle; more than
    LABEL_BLOCK labels are an error: ranked_by_blocks takes any number."""
    protos = prototypes(vectors).select(F.struct(F.col("label").alias("cand"), "proto").alias("p"))
    few = F.assert_true(F.count("*") <= LABEL_BLOCK, F.lit("too many labels for one row"))
    space = protos.agg(F.collect_list("p").alias("space"), few.alias("_few")).where(F.col("_few").isNull()).drop("_few")
    q = vectors.where("embedding is not null").select("vec_id", "label", unit(F.col("embedding")).alias("u"))
    ranking = F.array_sort(F.transform("space", lambda p: F.struct((-100.0 * dot(F.col("u"), p["proto"])).alias("s"), p["cand"].alias("cand"))))
    return q.join(F.broadcast(space), how="cross").select("vec_id", "label", ranking.alias("ranking"))  # with one row


def ranked_labels(vectors: DataFrame, most: int | None = None) -> DataFrame:
    """(vec_id, label, cand, score, rank): each vector's labels by falling score, all or the
    first `most`; equal scores by label."""
    r = label_rankings(vectors)
    first = F.col("ranking") if most is None else F.slice("ranking", 1, most)
    return r.select("vec_id", "label", F.posexplode(first).alias("pos", "x")).select("vec_id", "label", "x.cand", (-F.col("x.s")).alias("score"), (F.col("pos") + 1).alias("rank"))


def ranked_by_blocks(vectors: DataFrame, most: int) -> DataFrame:
    """What ranked_labels gives with `most`, for label spaces of any size: each block of labels
    gives a vector its best ones, of which the best of all blocks are taken."""
    protos = prototypes(vectors).select(F.col("label").alias("cand"), "proto")
    q = vectors.where("embedding is not null").select("vec_id", "label", unit(F.col("embedding")).alias("u"))
    rows = against_labels(q, protos, F.col("u"), F.col("proto")).drop("u", "proto")
    # The limit on the rank is taken in each partition before rows are shuffled.
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("score"), "cand"))).where(F.col("rank") <= most)


def own_ranks(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, cand, rank): the rank of each vector's own label; none without one."""
    r = label_rankings(vectors).where("label is not null")
    return r.select("vec_id", "label", F.col("label").alias("cand"), F.array_position(F.transform("ranking", lambda x: x["cand"]), F.col("label")).cast("int").alias("rank")).where("rank > 0")


def topk_accuracy(ranked: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """One row: percentages of queries whose own label is among the first k."""
    own = ranked.where("cand = label")
    return own.agg(*[F.round(100 * F.avg((F.col("rank") <= k).cast("int")), 3).alias(f"top{k}") for k in ks], F.count("*").alias("n"))


def mean_pairwise_cosine(vectors: DataFrame, group: str, vector: str = "embedding") -> DataFrame:
    """(group, n, avg_cos): the mean over all pairs of a group, by (|sum u|^2 - n) / (n (n - 1))
    for exact unit vectors u; no pair is formed. Vectors without length are left out;
    groups of one have a null mean."""
    parts = vectors.where(F.col(vector).isNotNull()).select(group, unit(F.col(vector), 0.0).alias("u")).where("u[0] is not null")
    n = parts.groupBy(group).agg(F.count("*").alias("n"))
    total = parts.select(group, F.posexplode("u").alias("pos", "x")).groupBy(group, "pos").agg(F.sum("x").alias("s")).groupBy(group).agg(F.sum(F.col("s") * F.col("s")).alias("ss"))
    return n.join(total, group).select(group, "n", ((F.col("ss") - F.col("n")) / F.nullif(F.col("n") * (F.col("n") - 1), F.lit(0))).alias("avg_cos"))


def class_max_sum(frames: DataFrame, group: str, scores: str, threshold: float = 0.3) -> DataFrame:
    """(group, expectation): per class the greatest score over a group's frames, summed
    where it exceeds the threshold."""
    top = frames.select(group, F.posexplode(scores).alias("cls", "p")).groupBy(group, "cls").agg(F.max("p").alias("m"))
    return top.groupBy(group).agg(F.sum(F.when(F.col("m") > threshold, F.col("m").cast("double")).otherwise(0.0)).alias("expectation"))


def contrastive_loss(pairs: DataFrame, batch: str, row: str, x: str, y: str, scale: float = 1.0) -> DataFrame:
    """(batch, n, loss): mean over a batch of (logsumexp of a row's products - its own) / 2,
    both ways. Products are formed within a batch only, whose size the training fixes."""
    a = pairs.select(batch, F.col(row).alias("i"), F.col(x).alias("x"))
    b = pairs.select(batch, F.col(row).alias("j"), F.col(y).alias("y"))
    z = a.join(b, batch).select(batch, "i", "j", (scale * dot(F.col("x"), F.col("y"))).alias("z"))

    def one_way(by: str) -> DataFrame:
        top = F.max("z").over(Window.partitionBy(batch, by))
        rows = z.withColumn("m", top).groupBy(batch, by).agg((F.max("m") + F.ln(F.sum(F.exp(F.col("z") - F.col("m"))))).alias("lse"), F.max(F.when(F.col("i") == F.col("j"), F.col("z"))).alias("own"))
        return rows.groupBy(batch).agg(F.count("*").alias("n"), F.avg(F.col("lse") - F.col("own")).alias("l"))

    r, c = one_way("i"), one_way("j").select(batch, F.col("l").alias("l2"))
    return r.join(c, batch).select(batch, "n", ((F.col("l") + F.col("l2")) / 2).alias("loss"))


def one_hot_pool(tokens: DataFrame, pointer: str, flag: Column, vector: str) -> DataFrame:
    """(pointer, pos, total): sums of the vectors that point to one place, where flag."""
    rows = tokens.where(flag & F.col(vector).isNotNull()).select(pointer, F.posexplode(vector).alias("pos", "x"))
    return rows.groupBy(pointer, "pos").agg(F.sum(F.col("x").cast("double")).alias("total"))
