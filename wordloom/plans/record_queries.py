"""Queries on packed records: packing, masking, sampling, pivots, naming, with SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import text as T
from ..operators import evaluation as EV
from ..operators import masking as M
from ..operators import packing as P
from ..operators import sampling as SA
from ..operators import segments as S
from ..operators import words as W
from ..operators.examples import build_examples
from ..operators.numbering import epochs, numbered, zipped
from ..rand import uniform, uniform_sql
from ..session import table


def _seg(spark, d):
    """Each segment once: of copies, the one that arrived last."""
    s = table(spark, d, "segment_k2f")
    cols = ["youtube_id", "video_src_index", "start_time", "end_time", "playback_speed", "tok_ids", "tok_start_times", "tok_end_times", "title", "tags", "random_text"]
    return s.groupBy("record_id", "seg_idx").agg(F.max_by(F.struct(*cols), "arrived_at").alias("x")).select("record_id", "seg_idx", *[f"x.{c}" for c in cols])


_S = "WITH s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY record_id, seg_idx ORDER BY arrived_at DESC) k FROM segment_k2f) WHERE k = 1)"
#: Rows of a shard on the average: shards grow in number with the table, not in size.
SHARD_ROWS = 500


def _shards(df, rows: int = SHARD_ROWS) -> int:
    return max(1, df.count() // rows)  # a scan of one column's counts


def _documents(spark, d):
    """random_text of all segments as documents, in shards by record."""
    s = _seg(spark, d).where("size(random_text) > 0")
    n = _shards(table(spark, d, "segment_k2f"))
    return s.select(F.pmod("record_id", F.lit(n)).alias("shard"), (F.col("record_id") * 16 + F.col("seg_idx")).alias("ord"), F.filter("random_text", lambda x: x != 0).alias("tokens"))


def pack_text_blocks(spark, d):
    """Documents one after the other, in blocks of 256."""
    r = P.pack_blocks(_documents(spark, d), "shard", "ord", "tokens", 256)
    return r.select("shard", "block_no", F.aggregate("block", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("total"), F.col("block")[0].alias("first"), F.col("block")[255].alias("last"))


def pack_text_counts(spark, d):
    return P.block_counts(_documents(spark, d).withColumn("n", F.size("tokens")), "shard", "ord", "n", 256)


def grouped_blocks(spark, d):
    s = _seg(spark, d).select("record_id", "seg_idx", F.size("tok_ids").alias("n"))
    return P.grouped_rows(s, ["record_id"], ["seg_idx"], 4, "n")


def bin_pack_segments(spark, d):
    """Groups of 16 segments, parts from the front or the back and fillers by hash."""
    n = _seg(spark, d).where("youtube_id <> ''").groupBy("youtube_id").agg(F.count("*").alias("n"))
    shards = _shards(table(spark, d, "segment_k2f"), 100_000)
    return P.pack_groups(n.withColumn("shard", F.pmod(F.crc32(F.col("youtube_id")), F.lit(shards))), "shard", "youtube_id", "n", seed=17)


def packed_records(spark, d):
    """Records as arrays of their segments."""
    s = _seg(spark, d).groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("seg_idx", "youtube_id", "start_time", F.size("tok_ids").alias("n_tokens")))).alias("segments"))  # 16 at most
    return s.select("record_id", F.size("segments").alias("n"), F.col("segments")[0]["youtube_id"].alias("first_video"), F.aggregate("segments", F.lit(0), lambda a, x: a + x["n_tokens"]).alias("tokens"))


def video_src_index(spark, d):
    r = EV.running_source_index(_seg(spark, d), "record_id", "seg_idx", "youtube_id")
    return r.select("record_id", "seg_idx", "first_of_source", "src_index")


def split_src_index(spark, d):
    """With probability 0.1, a record's sources are split at one place by adding 16."""
    r = EV.running_source_index(_seg(spark, d), "record_id", "seg_idx", "youtube_id")
    at = F.floor(uniform(8, "record_id") * 16)
    return r.select("record_id", "seg_idx", (F.col("src_index") + F.when((uniform(7, "record_id") < 0.1) & (F.col("seg_idx") >= at), 64).otherwise(0)).alias("src_index"))


def attention_visibility(spark, d):
    r = EV.visible_pairs(_seg(spark, d), "record_id", "seg_idx", "youtube_id", F.col("youtube_id").isNotNull() & (F.size("tok_ids") > 0))
    return r.groupBy("record_id").agg(F.count("*").alias("pairs"))


def token_stats(spark, d):
    s = _seg(spark, d).select("youtube_id", F.size("tok_ids").alias("n"))
    return s.agg(F.sum("n").alias("total"), F.max("n").alias("most"), F.round(F.avg("n"), 4).alias("mean"), F.round(F.stddev_pop("n"), 4).alias("std"), F.expr("cast(percentile(n, 0.9) as int)").alias("p90"), F.expr("cast(percentile(n, 0.95) as int)").alias("p95"), F.count_distinct("youtube_id").alias("videos"))


def _spans(spark, d):
    """Segments' tokens cut into three spans, every fifth span of a record masked."""
    s = _seg(spark, d).where("size(tok_ids) > 0")
    n = F.size("tok_ids")
    a, b = F.floor(n / 3).cast("int"), F.floor(2 * n / 3).cast("int")
    s = s.withColumn("spans", F.array(F.slice("tok_ids", F.lit(1), a), F.slice("tok_ids", a + 1, b - a), F.slice("tok_ids", b + 1, n - b)))
    return s.withColumn("masked", F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda k: F.pmod(F.col("seg_idx") * 3 + k, F.lit(5)) == 0))


def span_mask(spark, d):
    s = _spans(spark, d).withColumn("t", M.masked_spans(F.col("spans"), F.col("masked"))).withColumn("p", A.fit_pointers(F.col("t"), 24))
    return s.select("record_id", "seg_idx", F.transform("p", lambda x: x["tok"]).alias("tok"), F.transform("p", lambda x: x["audio_ptr"]).alias("audio_ptr"), F.transform("p", lambda x: x["text_ptr"]).alias("text_ptr"))


def masked_texts(spark, d):
    s = _spans(spark, d).select("record_id", "seg_idx", F.posexplode(M.masked_texts(F.col("spans"), F.col("masked"))).alias("k", "text"))
    return s.where(M.span_is_valid(F.col("text"), F.size("text")))


def audio_span_mask(spark, d):
    """Spans after the first are heard where they aren't masked; masks hide the sound too."""
    s = _spans(spark, d)
    t = M.masked_spans(F.col("spans"), F.col("masked"), F.array(F.lit(False), F.lit(True), F.lit(True)), True, 100)
    return s.select("record_id", "seg_idx", F.transform(t, lambda x: x["tok"]).alias("tok"))


def truncated_masks(spark, d):
    """Masked records' segments cut to eight tokens without losing a mask."""
    s = _spans(spark, d).select("record_id", "seg_idx", M.truncated(M.masked_spans(F.col("spans"), F.col("masked")), 8, F.array(F.lit(0.3), F.lit(0.2), F.lit(0.1))).alias("t"))
    return s.select("record_id", "seg_idx", F.transform("t", lambda x: x["tok"]).alias("tok"))


def empty_span_repair(spark, d):
    """Spans of 0, 3 and n - 3 tokens: the empty first one, if masked, gets one."""
    s = _seg(spark, d).where("size(tok_ids) >= 6")
    n = F.size("tok_ids")
    spans = F.array(F.slice("tok_ids", 1, 0), F.slice("tok_ids", 1, 3), F.slice("tok_ids", F.lit(4), n - 3))
    r = M.reassign_empty(spans, F.array(F.col("seg_idx") % 2 == 0, F.lit(False), F.lit(False)))
    return s.select("record_id", "seg_idx", F.transform(r, lambda x: F.size(x)).alias("lengths"))


def neighbour_flags(spark, d):
    s = _seg(spark, d).select("record_id", "seg_idx", (F.coalesce(F.size("tok_ids"), F.lit(0)) < 12).alias("short"))
    return M.neighbour_flags(s, ["record_id"], "seg_idx", "short")


def mask_growth(spark, d):
    """Segments of a record as spans, short ones masked, bounds as audio bounds."""
    s = _seg(spark, d).where("start_time is not null and end_time is not null").select("record_id", F.col("seg_idx").alias("pos"), (F.size("tok_ids") < 12).alias("masked"), F.size("tok_ids").alias("n"), (F.col("start_time") + 0.05).alias("lo"), (F.col("end_time") - 0.05).alias("hi"), F.col("start_time").alias("audio_start"), F.col("end_time").alias("audio_end"))
    return M.grown_masks(s, ["record_id"]).select("record_id", "pos", "takes_right", "takes_left")


def grown_spans(spark, d):
    """Spans of a segment's tokens after masked ones took near tokens of their neighbours."""
    s = _spans(spark, d).where("size(tok_start_times) >= size(tok_ids) and size(tok_end_times) >= size(tok_ids)")
    centre = F.transform("tok_ids", lambda t, i: (F.get("tok_start_times", i).cast("double") + F.get("tok_end_times", i).cast("double")) / 2)
    s = s.withColumn("c", centre).withColumn("last", F.coalesce(F.array_max("c"), F.lit(0.0)))
    third = lambda k: F.col("last") * k / 3
    g = M.grown_spans(F.col("spans"), F.col("c"), F.col("masked"), F.array(third(0), third(1), third(2)), F.array(third(1), third(2), third(3)), F.col("record_id") % 2 == 0, 0.5)
    return s.select("record_id", "seg_idx", F.transform(g, lambda x: F.size(x)).alias("lengths"))


def pointer_groups(spark, d):
    """Pointers of a segment's three spans in three groups, each of 12."""
    s = _spans(spark, d).withColumn("g", M.pointer_groups(M.masked_spans(F.col("spans"), F.col("masked")), 3, 3, 12))
    return s.select("record_id", "seg_idx", F.transform("g", lambda p: F.transform(p, lambda x: x["tok"])).alias("groups"))


def pseudo_spans(spark, d):
    """Random texts cut by hash into spans, for a text of 256 tokens; the offset in the middle."""
    s = _seg(spark, d).where("size(random_text) > 0").withColumn("t", F.filter("random_text", lambda x: x != 0)).where("size(t) > 0")
    s = s.withColumn("lens", M.drawn_lengths(F.col("t"), 256, M.span_budget(256), 23, "record_id", "seg_idx"))
    x = M.pseudo_spans(F.col("t"), F.col("lens"), F.floor((F.size("t") - F.aggregate("lens", F.lit(0), lambda a, b: a + b)) / 2).cast("int"))
    return s.withColumn("x", x).select("record_id", "seg_idx", "lens", F.size("x.before").alias("before"), F.size("x.after").alias("after"), F.size(F.flatten("x.spans")).alias("inside"))


def span_lengths(spark, d):
    """How often masked spans have each length, and its share."""
    n = masked_texts(spark, d).groupBy(F.size("text").alias("length")).agg(F.count("*").alias("n"))
    return n.select("length", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("share"))  # a row a length


def valid_tokens(spark, d):
    """Tokens of random texts that are valid; the vocabulary has the first word of document n
    as token n."""
    vocabulary = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.regexp_extract(F.coalesce("text", F.lit("")), r"^(\S*)", 1).alias("text"))
    s = _seg(spark, d).where("size(random_text) > 0")
    return M.valid_by_blocks(s, ["record_id", "seg_idx"], "random_text", vocabulary).select("record_id", "seg_idx", F.size("valid").alias("valid"), "n")


def header_tokens(spark, d):
    s = _seg(spark, d).where("size(title) > 0")
    return s.select("record_id", "seg_idx", M.header(F.col("title"), F.lit(None), F.col("tags"), ([11], [12], [13]), 40).alias("tokens"))


def qa_sequences(spark, d):
    """A segment's title as the question and its tags as the option."""
    s = _seg(spark, d).where("size(title) > 0")
    return s.select("record_id", "seg_idx", M.qa_joint(F.col("title"), F.col("tags"), 16).alias("joint"), M.qa_linear(F.col("title"), 8).alias("query"))


def padded_subtitles(spark, d):
    """A record's segments padded to 20: the last one's length again, time -1, no subtitle."""
    rows = _seg(spark, d).select("record_id", "seg_idx", F.struct(F.coalesce(F.size("tok_ids"), F.lit(0)).alias("f"), F.coalesce("start_time", F.lit(0.0)).alias("t"), F.coalesce("youtube_id", F.lit("")).alias("s")).alias("x"))
    s = P.grouped_rows(rows, ["record_id"], ["seg_idx"], 20, "x")
    part = lambda c: F.transform("items", lambda i: i[c])
    return s.select("record_id", S.padded_frames(part("f"), part("t"), part("s"), 20).alias("p")).select("record_id", "p.*")


def per_token_words(spark, d):
    """A record's segments, each as often as it has tokens."""
    s = P.grouped_rows(_seg(spark, d).select("record_id", "seg_idx", F.struct("seg_idx", F.coalesce("tok_ids", F.array().cast("array<int>")).alias("t")).alias("x")), ["record_id"], ["seg_idx"], 20, "x")
    return s.select("record_id", W.per_token(F.transform("items", lambda i: i["seg_idx"]), F.transform("items", lambda i: i["t"])).alias("segments"))


def epoch_files(spark, d):
    """Two epochs of the crawl's id files of host 0 of 2: files by epoch, in the epoch's order."""
    files = table(spark, d, "meta_info").where("_ids_fn is not null").select("_ids_fn").distinct()
    e = epochs(files, 2, 5, "_ids_fn", 1, 0)
    return e.select("_ids_fn", "epoch", F.round("file_order", 9).alias("file_order"))


def choice_columns(spark, d):
    """Four columns of choices as rows."""
    q = table(spark, d, "eval_items").select("item_id", "suite", "show_name", "vid_name", "ts")
    return EV.expanded_choices(q, F.array("suite", "show_name", "vid_name", "ts")).select("item_id", "cond", "choice")


def flattened_batches(spark, d):
    """Pointer columns split out, by batches of 32 records."""
    s = _spans(spark, d).withColumn("p", A.fit_pointers(M.masked_spans(F.col("spans"), F.col("masked")), 12))
    s = s.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("seg_idx", "p"))).alias("l"))  # 16 at most
    flat = F.flatten(F.transform("l", lambda x: x["p"]))
    return s.select(F.floor(F.col("record_id") / 32).alias("batch"), "record_id", F.size(flat).alias("n"), F.aggregate(F.transform(flat, lambda x: x["tok"]), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("sum_tok"), F.array_max(F.transform(flat, lambda x: x["text_ptr"])).alias("max_text"))


def display_tokens(spark, d):
    """Tokens of each audio span as a line: MASK by name, others by their ids."""
    s = _spans(spark, d).select("record_id", "seg_idx", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.filter(M.masked_spans(F.col("spans"), F.col("masked")), lambda p: p["audio_ptr"] == k))).alias("audio_ptr", "p")).where("size(p) > 0")
    return s.select("record_id", "seg_idx", "audio_ptr", F.array_join(F.transform("p", lambda x: F.when(x["tok"] == A.MASK, F.lit("MASK")).otherwise(x["tok"].cast("string"))), " ").alias("line"))


def gumbel_sample(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("w"))
    return SA.weighted_sample(docs, 50, F.col("w"), 42, "doc_id").select("doc_id")


def uniform_sample(spark, d):
    """Three documents of each kind."""
    return SA.uniform_sample(table(spark, d, "documents").select("doc_id", "doc_kind"), 3, 9, "doc_id", by=["doc_kind"])


def bernoulli_choice(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    return docs.select("doc_id", SA.bernoulli(0.25, 1, "doc_id").alias("kept"), SA.choice(["up", "down", "flip"], 2, "doc_id").alias("way"))


def submission_pivot(spark, d):
    """Records as questions, their first four segments as conditions, times as answers."""
    s = _seg(spark, d).where("seg_idx < 4").select("record_id", F.col("seg_idx").alias("cond"), F.transform(F.array(F.lit(1), F.lit(2), F.lit(3), F.lit(4)), lambda k: (F.size("tok_ids") * k).cast("double") / 100).alias("ans"), F.transform(F.array(F.lit(1), F.lit(2), F.lit(3), F.lit(4)), lambda k: (F.coalesce(F.col("playback_speed"), F.lit(0)) + k).cast("double")).alias("rat"))
    return EV.submission(s, "record_id", "cond", "ans", "rat")


def choice_expansion(spark, d):
    """One row for each of the four pieces of an item's id."""
    q = table(spark, d, "eval_items").select("item_id", F.split("vid_name", "_").alias("c"))
    return EV.expanded_choices(q, F.slice("c", 1, 4)).select("item_id", "cond", "choice")


def object_naming(spark, d):
    p = table(spark, d, "part").select(F.floor(F.col("p_partkey") / 10).alias("grp"), "p_partkey", F.lower(F.element_at(F.split("p_type", " "), -1)).alias("kind"))
    return EV.named_objects(p, "grp", "kind", "p_partkey").select("grp", "p_partkey", "obj_name")


def reference_names(spark, d):
    """The first two objects of each group, joined."""
    n = object_naming(spark, d).groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "obj_name"))).alias("l"))  # ten a group
    return n.select("grp", EV.joined_names(F.transform("l", lambda x: x["obj_name"])).alias("names"))


def nation_lookup(spark, d):
    r = table(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name"))
    return EV.lookup(table(spark, d, "nation"), r, "n_regionkey").select("n_nationkey", "r_name")


def action_names(spark, d):
    """'a:b' nouns reversed after a verb."""
    p = table(spark, d, "part").select("p_partkey", F.lower(F.regexp_replace("p_name", " ", ":")).alias("noun"))
    return p.select("p_partkey", F.concat(F.lit("take the "), T.reversed_noun(F.col("noun"))).alias("action"))


def positional_zip(spark, d):
    """The n-th crawl id with the n-th video of the crawl, the shorter side deciding."""
    a = table(spark, d, "video_ids").where("video_id is not null").distinct()
    b = table(spark, d, "meta_info").where("youtube_id is not null").select("youtube_id").distinct()
    return zipped(a, ["video_id"], b, ["youtube_id"]).select("n", "video_id", "youtube_id")


def frame_zip(spark, d):
    """Segments with the spectrograms and times of the same place in the record."""
    s = _seg(spark, d).select("record_id", "seg_idx", F.size("tok_ids").alias("frame"))
    t = table(spark, d, "segment_k2f").groupBy("record_id", "seg_idx").agg(F.max("spectrogram_magic_number").alias("magic"), F.max("start_time").alias("start"))
    return s.join(t, ["record_id", "seg_idx"]).select("record_id", "seg_idx", "frame", "magic", "start")


def union_predictions(spark, d):
    s = _seg(spark, d).select("record_id", "seg_idx", F.size("tok_ids").alias("p"))
    return s.where("record_id % 2 = 0").withColumn("split", F.lit("val")).unionByName(s.where("record_id % 2 = 1").withColumn("split", F.lit("test"))).groupBy("split").agg(F.count("*").alias("n"), F.sum("p").alias("total"))


def sorted_index(spark, d):
    """Records by the number inside their name, numbered from 1."""
    s = table(spark, d, "meta_info").select("_ids_fn").distinct()
    order = F.regexp_extract("_ids_fn", r"(\d+)", 1).try_cast("int")
    return numbered(s, order, "_ids_fn").select("_ids_fn", (F.col("n") + 1).alias("n"))


def example_builder(spark, d):
    """Sums and counts over the four views of each record."""
    e = build_examples(table(spark, d, "segment_k2f"))
    total = lambda c: F.aggregate(F.transform(c, lambda t: t["tok"].cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a + x)
    masks = lambda c: F.size(F.filter(c, lambda t: t["tok"] == A.MASK))
    views = ("text_to_audio", "audio_to_text", "matching", "random_text")
    return e.select("record_id", *[x for c in views for x in (total(c).alias(f"{c}_sum"), masks(c).alias(f"{c}_masks"), F.size(c).alias(f"{c}_len"))], F.size("targets").alias("targets"), F.size(F.filter(F.flatten("targets"), lambda t: t != 0)).alias("target_tokens"))


QUERIES = {f.__name__: f for f in (example_builder, pack_text_blocks, pack_text_counts, grouped_blocks, bin_pack_segments, packed_records, video_src_index, split_src_index, attention_visibility, token_stats, span_mask, masked_texts, audio_span_mask, truncated_masks, empty_span_repair, neighbour_flags, mask_growth, grown_spans, pointer_groups, span_lengths, per_token_words, epoch_files, choice_columns, frame_zip, pseudo_spans, valid_tokens, header_tokens, qa_sequences, padded_subtitles, flattened_batches, display_tokens, gumbel_sample, uniform_sample, bernoulli_choice, submission_pivot, choice_expansion, object_naming, reference_names, nation_lookup, action_names, positional_zip, union_predictions, sorted_index)}
# One step a document: what is carried on, the document, and the blocks they make.
_BLOCKS = _S + """, n AS (SELECT record_id % greatest(1, (SELECT count(*) FROM segment_k2f) // 500) AS shard, record_id * 16 + seg_idx o, list_filter(random_text, lambda x: x <> 0) t FROM s WHERE len(random_text) > 0),
m AS (SELECT shard, row_number() OVER (PARTITION BY shard ORDER BY o) i, t FROM n),
r AS (WITH RECURSIVE q AS (SELECT DISTINCT shard, 0::BIGINT i, 0::BIGINT blocks, 0::BIGINT discarded, 0::BIGINT carried, []::INT[] rest, []::INT[][] out FROM m
 UNION ALL SELECT shard, i, blocks + len(a) // 256, discarded + CASE WHEN len(a) % 256 <= 32 THEN len(a) % 256 ELSE 0 END, CASE WHEN len(a) % 256 <= 32 THEN 0 ELSE len(a) % 256 END, CASE WHEN len(a) % 256 <= 32 THEN []::INT[] ELSE a[len(a) // 256 * 256 + 1:] END, list_transform(range(len(a) // 256), lambda z: a[z * 256 + 1:(z + 1) * 256])
 FROM (SELECT q.shard, m.i, blocks, discarded, list_concat(rest, [1], t, [2]) a FROM q JOIN m ON m.shard = q.shard AND m.i = q.i + 1)) SELECT * FROM q) {extra}"""
_IDX = _S + ", f AS (SELECT *, row_number() OVER w = 1 OR youtube_id IS DISTINCT FROM lag(youtube_id) OVER w AS first_of_source FROM s WINDOW w AS (PARTITION BY record_id ORDER BY seg_idx)), i AS (SELECT record_id, seg_idx, first_of_source, CAST(sum(CAST(first_of_source AS INT)) OVER (PARTITION BY record_id ORDER BY seg_idx ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS src_index FROM f)"
_3 = _S + ", n AS (SELECT *, len(tok_ids) n, len(tok_ids) // 3 a, 2 * len(tok_ids) // 3 b FROM s WHERE len(tok_ids) > 0), sp AS (SELECT record_id, seg_idx, [tok_ids[1:a], tok_ids[a+1:b], tok_ids[b+1:n]] spans, [(seg_idx * 3) % 5 = 0, (seg_idx * 3 + 1) % 5 = 0, (seg_idx * 3 + 2) % 5 = 0] m FROM n)"
_MASKED = _3 + ", t AS (SELECT record_id, seg_idx, CASE WHEN m[1] THEN [3] ELSE spans[1] END a, CASE WHEN m[2] THEN [3] ELSE spans[2] END b, CASE WHEN m[3] THEN [3] ELSE spans[3] END c, m FROM sp)"
_PAD = "list_concat({0}, list_transform(range(0, greatest(0, {2} - len({0}))), lambda z: CAST({1} AS INT)))[1:{2}]"
_TXT = "list_transform({x}, lambda z: CASE WHEN m[{k}] THEN CAST({v} AS INT) ELSE -1 END)"


def _bounds() -> str:
    """Bounds of the span lengths' distribution."""
    out, run = [], 0.0
    for x in M.SPAN_WEIGHTS[:-1]:
        run += x / sum(M.SPAN_WEIGHTS)
        out.append(f"{run!r}::DOUBLE")
    return "[" + ", ".join(out) + "]"


def _grow(frm: str, to: str, right: str) -> str:
    """One direction of growth over three spans: who takes, then the new lengths."""
    take_r = lambda i: f"coalesce(m[{i}] AND NOT m[{i + 1}] AND n[{i + 1}] > 1 AND list_min(c[list_sum(n[1:{i}])::BIGINT + 1:list_sum(n[1:{i + 1}])::BIGINT]) - l * {i} / 3 < 0.5, false)::INT" if i < 3 else "0"
    take_l = lambda i: f"coalesce(m[{i}] AND NOT m[{i - 1}] AND n[{i - 1}] > 1 AND l * {i - 1} / 3 - list_max(c[coalesce(list_sum(n[1:{i - 2}]), 0)::BIGINT + 1:list_sum(n[1:{i - 1}])::BIGINT]) < 0.5, false)::INT" if i > 1 else "0"
    r = ", ".join(f"n[{i}] + {take_r(i)} - {take_r(i - 1) if i > 1 else 0}" for i in (1, 2, 3))
    left = ", ".join(f"n[{i}] + {take_l(i)} - {take_l(i + 1) if i < 3 else 0}" for i in (1, 2, 3))
    return f", {to} AS (SELECT record_id, seg_idx, m, c, l, r, CASE WHEN {right} THEN [{r}] ELSE [{left}] END n FROM {frm})"


SQL = {
    "pack_text_counts": _BLOCKS.format(extra="") + "SELECT shard, blocks, discarded, carried FROM r QUALIFY row_number() OVER (PARTITION BY shard ORDER BY i DESC) = 1",
    "pack_text_blocks": _BLOCKS.format(extra="") + "SELECT shard, CAST(blocks - len(out) + k AS INT) AS block_no, CAST(list_sum(out[k + 1]) AS BIGINT) AS total, out[k + 1][1] AS first, out[k + 1][256] AS last FROM (SELECT *, unnest(range(len(out))) k FROM r)",
    "grouped_blocks": _S + " SELECT record_id, CAST(g AS INT) AS grp, list(len(tok_ids) ORDER BY seg_idx) AS items FROM (SELECT *, (row_number() OVER (PARTITION BY record_id ORDER BY seg_idx) - 1) // 4 g FROM s) GROUP BY 1, 2",
    "packed_records": _S + " SELECT record_id, CAST(count(*) AS INT) AS n, arg_min(struct_pack(y := youtube_id), seg_idx).y AS first_video, CAST(sum(len(tok_ids)) AS INT) AS tokens FROM s GROUP BY 1",
    "video_src_index": _IDX + " SELECT * FROM i",
    "split_src_index": _IDX + f" SELECT record_id, seg_idx, src_index + CASE WHEN {uniform_sql(7, 'record_id')} < 0.1 AND seg_idx >= floor({uniform_sql(8, 'record_id')} * 16) THEN 64 ELSE 0 END AS src_index FROM i",
    "attention_visibility": _S + " SELECT a.record_id, count(*) AS pairs FROM s a JOIN s b ON a.record_id = b.record_id AND a.youtube_id = b.youtube_id WHERE len(a.tok_ids) > 0 AND len(b.tok_ids) > 0 GROUP BY 1",
    "token_stats": _S + ", n AS (SELECT youtube_id, len(tok_ids) n FROM s) SELECT sum(n) AS total, max(n) AS most, round(avg(n), 4) AS mean, round(stddev_pop(n), 4) AS std, CAST(trunc(quantile_cont(n, 0.9)) AS INT) AS p90, CAST(trunc(quantile_cont(n, 0.95)) AS INT) AS p95, count(DISTINCT youtube_id) AS videos FROM n",
    "span_mask": _MASKED + ", o AS (SELECT record_id, seg_idx, list_concat(a, b, c) tok, list_concat(list_transform(a, lambda z: 0), list_transform(b, lambda z: 1), list_transform(c, lambda z: 2)) au, list_concat(" + _TXT.format(x="a", k=1, v="0") + ", " + _TXT.format(x="b", k=2, v="CAST(m[1] AS INT)") + ", " + _TXT.format(x="c", k=3, v="CAST(m[1] AS INT) + CAST(m[2] AS INT)") + ") tx FROM t) SELECT record_id, seg_idx, " + ", ".join(_PAD.format(c, v, 24) + f" AS {n}" for c, v, n in (("tok", 0, "tok"), ("au", -1, "audio_ptr"), ("tx", -1, "text_ptr"))) + " FROM o",
    "masked_texts": _3 + ", x AS (SELECT record_id, seg_idx, list_filter(list_zip(spans, m), lambda z: z[2]) l FROM sp), y AS (SELECT record_id, seg_idx, CAST(unnest(range(len(l))) AS INT) AS k, unnest(l)[1] AS text FROM x) SELECT * FROM y WHERE len(list_filter(text, lambda z: z <> 0)) > 0",
    "audio_span_mask": _3 + " SELECT record_id, seg_idx, list_concat(CASE WHEN m[1] THEN [3, 4] ELSE spans[1] END, CASE WHEN m[2] THEN [3, 4] ELSE [5, 5, 5, 5, 5, 5] END, CASE WHEN m[3] THEN [3, 4] ELSE [5, 5, 5, 5, 5, 5] END) AS tok FROM sp",
    "empty_span_repair": _S + " SELECT record_id, seg_idx, CASE WHEN seg_idx % 2 = 0 THEN [1, 2, len(tok_ids) - 3] ELSE [0, 3, len(tok_ids) - 3] END AS lengths FROM s WHERE len(tok_ids) >= 6",
    "neighbour_flags": _S + ", f AS (SELECT record_id, seg_idx, coalesce(len(tok_ids), 0) < 12 AS short FROM s) SELECT *, NOT short AND (coalesce(lag(short) OVER w, false) OR coalesce(lead(short) OVER w, false)) AS next_to FROM f WINDOW w AS (PARTITION BY record_id ORDER BY seg_idx)",
    "mask_growth": _S + ", f AS (SELECT record_id, seg_idx AS pos, len(tok_ids) n, len(tok_ids) < 12 m, start_time a, end_time e FROM s WHERE start_time IS NOT NULL AND end_time IS NOT NULL) SELECT record_id, pos, coalesce(m AND NOT lead(m) OVER w AND lead(n) OVER w > 1 AND lead(a) OVER w + 0.05 - e < 0.1, false) AS takes_right, coalesce(m AND NOT lag(m) OVER w AND lag(n) OVER w > 1 AND a - (lag(e) OVER w - 0.05) < 0.1, false) AS takes_left FROM f WINDOW w AS (PARTITION BY record_id ORDER BY pos)",
    "truncated_masks": _MASKED + """, o AS (SELECT record_id, seg_idx, list_concat(a, b, c) tok, list_concat(list_transform(a, lambda z: 0), list_transform(b, lambda z: 1), list_transform(c, lambda z: 2)) au FROM t),
f AS (SELECT *, len(tok) n, greatest(len(tok) - 8, 0) ov, coalesce(list_min(list_filter(range(len(tok)), lambda i: tok[i + 1] IN (3, 4, 5))), len(tok)) first, len(tok) - 1 - coalesce(list_max(list_filter(range(len(tok)), lambda i: tok[i + 1] IN (3, 4))), -1) rhs FROM o),
g AS (SELECT *, least(ov - least(ov // 2, first), rhs) back FROM f), h AS (SELECT *, least(ov - back, first) front FROM g),
k AS (SELECT record_id, seg_idx, tok[front + 1:n - back] tok, au[front + 1:n - back] au FROM h),
w AS (SELECT *, list_transform(list_sort(list_transform(range(len(tok)), lambda i: {'a': (tok[i + 1] NOT IN (3, 4))::INT, 'b': -([0.3, 0.2, 0.1][au[i + 1] + 1])::DOUBLE, 'i': i}))[1:8], lambda x: x.i) keep FROM k)
SELECT record_id, seg_idx, CASE WHEN len(tok) <= 8 THEN tok ELSE list_filter(tok, lambda z, i: list_contains(keep, i - 1)) END AS tok FROM w""",
    "valid_tokens": _S + rf", v AS (SELECT list(doc_id) ok FROM documents WHERE doc_id > 10 AND doc_id NOT IN {M.BAD_TOKENS} AND regexp_matches(regexp_extract(coalesce(text, ''), '^[^ \t\n\f\r\x0B]*'), '^[A-Za-z0-9'']*$')) SELECT record_id, seg_idx, CAST(len(list_filter(random_text, lambda x: list_contains(ok, x))) AS INT) AS valid, CAST(len(random_text) AS INT) AS n FROM s, v WHERE len(random_text) > 0",
    "grown_spans": _3 + """, z AS (SELECT s.record_id, s.seg_idx, m, [len(spans[1]), len(spans[2]), len(spans[3])] n, list_transform(range(len(tok_ids)), lambda i: (tok_start_times[i + 1]::DOUBLE + tok_end_times[i + 1]::DOUBLE) / 2) c FROM s JOIN sp USING (record_id, seg_idx) WHERE len(tok_start_times) >= len(tok_ids) AND len(tok_end_times) >= len(tok_ids)),
y AS (SELECT *, coalesce(list_max(c), 0) l, record_id % 2 = 0 r FROM z)""" + _grow("y", "y1", "r") + _grow("y1", "y2", "NOT r") + " SELECT record_id, seg_idx, list_transform(n, lambda x: CAST(x AS INT)) AS lengths FROM y2",
    "pointer_groups": _MASKED + " SELECT record_id, seg_idx, list_transform([a, b, c], lambda g: " + _PAD.format("g", 0, 12) + ") AS groups FROM (SELECT record_id, seg_idx, " + ", ".join(f"CASE WHEN len({x}) > 12 THEN list_concat({x}[1:0], {x})[(len({x}) - 12) // 2 + 1:(len({x}) - 12) // 2 + 12] ELSE {x} END {x}" for x in "abc") + " FROM t)",
    "span_lengths": _3 + ", x AS (SELECT unnest(list_filter(list_zip(spans, m), lambda z: z[2])) l FROM sp), g AS (SELECT CAST(len(l[1]) AS INT) AS length, count(*) AS n FROM x WHERE len(list_filter(l[1], lambda z: z <> 0)) > 0 GROUP BY 1) SELECT length, n, round(n / sum(n) OVER (), 6) AS share FROM g",
    "pseudo_spans": _S + f", t AS (SELECT record_id, seg_idx, list_filter(random_text, lambda x: x <> 0) t FROM s), l AS (SELECT *, least({256 + int((sum(i * w for i, w in enumerate(M.SPAN_WEIGHTS)) + 1) * 0.85 * M.span_budget(256) - M.span_budget(256))}, len(t)) room FROM t WHERE len(t) > 0), d AS (SELECT record_id, seg_idx, len(t) n, room, list_transform(range(room), lambda i: 1 + len(list_filter({_bounds()}, lambda b: {uniform_sql(23, 'record_id', 'seg_idx', 'i')} >= b))) x FROM l), k AS (SELECT record_id, seg_idx, n, list_filter(x, lambda z, i: list_sum(x[1:i]) <= room) lens FROM d) SELECT record_id, seg_idx, list_transform(lens, lambda z: CAST(z AS INT)) AS lens, CAST((n - w) // 2 AS INT) AS before, CAST(n - w - (n - w) // 2 AS INT) AS after, CAST(w AS INT) AS inside FROM (SELECT *, coalesce(list_sum(lens), 0) w FROM k)",
    "per_token_words": _S + " SELECT record_id, flatten(list(list_transform(range(coalesce(len(tok_ids), 0)), lambda z: seg_idx) ORDER BY seg_idx)) AS segments FROM s GROUP BY 1",
    "epoch_files": f"WITH f AS (SELECT DISTINCT _ids_fn FROM meta_info WHERE _ids_fn IS NOT NULL), e AS (SELECT _ids_fn, CAST(unnest([0, 1]) AS INT) AS epoch FROM f) SELECT _ids_fn, epoch, round({uniform_sql(5, 'epoch', '_ids_fn')}, 9) AS file_order FROM e",
    "choice_columns": "SELECT item_id, CAST(unnest(range(4)) AS INT) AS cond, unnest([suite, show_name, vid_name, ts]) AS choice FROM eval_items",
    "frame_zip": _S + ", t AS (SELECT record_id, seg_idx, max(spectrogram_magic_number) AS magic, max(start_time) AS start FROM segment_k2f GROUP BY 1, 2) SELECT record_id, seg_idx, CAST(len(tok_ids) AS INT) AS frame, magic, start FROM s JOIN t USING (record_id, seg_idx)",
    "flattened_batches": _MASKED + ", o AS (SELECT record_id, seg_idx, " + _PAD.format("list_concat(a, b, c)", 0, 12) + " tok, " + _PAD.format("list_concat(" + _TXT.format(x="a", k=1, v="0") + ", " + _TXT.format(x="b", k=2, v="CAST(m[1] AS INT)") + ", " + _TXT.format(x="c", k=3, v="CAST(m[1] AS INT) + CAST(m[2] AS INT)") + ")", -1, 12) + " tx FROM t) SELECT record_id // 32 AS batch, record_id, CAST(sum(len(tok)) AS INT) AS n, CAST(sum(list_sum(tok)) AS BIGINT) AS sum_tok, max(list_max(tx)) AS max_text FROM o GROUP BY 1, 2",
    "header_tokens": _S + " SELECT record_id, seg_idx, list_concat([1, 11], title, [1, 12], [1, 13], coalesce(tags, []), [2])[1:40] AS tokens FROM s WHERE len(title) > 0",
    "qa_sequences": _S + ", q AS (SELECT record_id, seg_idx, list_concat(list_concat(title, tags)[1:15], [3]) j, list_concat(title[1:7], [3]) q FROM s WHERE len(title) > 0) SELECT record_id, seg_idx, " + _PAD.format("j", 0, 16) + " AS joint, " + _PAD.format("q", 0, 8) + " AS query FROM q",
    "padded_subtitles": _S + ", l AS (SELECT record_id, list(CAST(coalesce(len(tok_ids), 0) AS INT) ORDER BY seg_idx) f, list(coalesce(start_time, 0.0) ORDER BY seg_idx) t, list(coalesce(youtube_id, '') ORDER BY seg_idx) y FROM s GROUP BY 1) SELECT record_id, list_concat(f, list_transform(range(0, 20 - len(f)), lambda z: f[-1])) AS frames, list_concat(t, list_transform(range(0, 20 - len(f)), lambda z: -1.0::DOUBLE)) AS times, list_concat(y, list_transform(range(0, 20 - len(f)), lambda z: '')) AS subs FROM l",
    "gumbel_sample": f"SELECT doc_id FROM documents WHERE n_chars > 0 ORDER BY ln(n_chars) - ln(-ln(greatest({uniform_sql(42, 'doc_id')}, 1e-15))) DESC, doc_id LIMIT 50",
    "uniform_sample": f"SELECT doc_id, doc_kind FROM (SELECT doc_id, doc_kind, row_number() OVER (PARTITION BY doc_kind ORDER BY {uniform_sql(9, 'doc_id')}, doc_id) k FROM documents) WHERE k <= 3",
    "bernoulli_choice": f"SELECT doc_id, {uniform_sql(1, 'doc_id')} < 0.25 AS kept, ['up', 'down', 'flip'][CAST(floor({uniform_sql(2, 'doc_id')} * 3) AS INT) + 1] AS way FROM documents",
    "submission_pivot": _S + ", r AS (SELECT record_id, seg_idx c, len(tok_ids) n, coalesce(playback_speed, 0) p FROM s WHERE seg_idx < 4) SELECT record_id, " + ", ".join(f"max(CASE WHEN c = 3 THEN n * {j + 1} / 100 END) AS answer_{j}" for j in range(4)) + ", " + ", ".join(f"max(CASE WHEN c = {i} THEN (p + {j + 1})::DOUBLE END) AS rationale_conditioned_on_a{i}_{j}" for i in range(4) for j in range(4)) + " FROM r GROUP BY 1",
    "choice_expansion": "WITH q AS (SELECT item_id, string_split(vid_name, '_')[1:4] c FROM eval_items) SELECT item_id, CAST(unnest(range(len(c))) AS INT) AS cond, unnest(c) AS choice FROM q",
    "object_naming": "WITH p AS (SELECT p_partkey // 10 AS grp, p_partkey, lower(split_part(p_type, ' ', -1)) k FROM part) SELECT grp, p_partkey, CASE WHEN count(*) OVER (PARTITION BY grp, k) = 1 THEN 'the ' || k ELSE upper(k[1:1]) || k[2:] || ' ' || row_number() OVER (PARTITION BY grp, k ORDER BY p_partkey) END AS obj_name FROM p",
    "reference_names": "WITH p AS (SELECT p_partkey // 10 AS grp, p_partkey, lower(split_part(p_type, ' ', -1)) k FROM part), n AS (SELECT grp, p_partkey, CASE WHEN count(*) OVER (PARTITION BY grp, k) = 1 THEN 'the ' || k ELSE upper(k[1:1]) || k[2:] || ' ' || row_number() OVER (PARTITION BY grp, k ORDER BY p_partkey) END o FROM p) SELECT grp, array_to_string(list(o ORDER BY p_partkey)[1:2], ' and ') AS names FROM n GROUP BY 1",
    "display_tokens": _3 + ", x AS (SELECT record_id, seg_idx, unnest([0, 1, 2]) k, unnest(spans) p, unnest(m) f FROM sp) SELECT record_id, seg_idx, CAST(k AS INT) AS audio_ptr, CASE WHEN f THEN 'MASK' ELSE array_to_string(list_transform(p, lambda z: CASE WHEN z = 3 THEN 'MASK' ELSE CAST(z AS VARCHAR) END), ' ') END AS line FROM x WHERE f OR len(p) > 0",
    "nation_lookup": "SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
    "action_names": "SELECT p_partkey, 'take the ' || array_to_string(list_reverse(string_split(lower(replace(p_name, ' ', ':')), ':')), ' ') AS action FROM part",
    "positional_zip": "WITH a AS (SELECT video_id, row_number() OVER (ORDER BY video_id) - 1 n FROM (SELECT DISTINCT video_id FROM video_ids WHERE video_id IS NOT NULL)), b AS (SELECT youtube_id, row_number() OVER (ORDER BY youtube_id) - 1 n FROM (SELECT DISTINCT youtube_id FROM meta_info WHERE youtube_id IS NOT NULL)) SELECT n, video_id, youtube_id FROM a JOIN b USING (n)",
    "union_predictions": _S + " SELECT CASE WHEN record_id % 2 = 0 THEN 'val' ELSE 'test' END AS split, count(*) AS n, sum(len(tok_ids)) AS total FROM s GROUP BY 1",
    "sorted_index": r"SELECT _ids_fn, (row_number() OVER (ORDER BY TRY_CAST(regexp_extract(_ids_fn, '(\d+)', 1) AS INT) NULLS FIRST, _ids_fn)) AS n FROM (SELECT DISTINCT _ids_fn FROM meta_info)",
}
