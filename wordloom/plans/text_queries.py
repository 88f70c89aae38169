"""Queries on documents and descriptions: cleaning, words, gates, vocabulary, with SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.arrays import encoded_string
from ..operators import quality as Q
from ..operators.numbering import numbered
from ..sources import readers as R
from ..operators import words as W
from ..rand import uniform, uniform_sql
from ..session import table


def _docs(spark, d):
    return table(spark, d, "documents")


def _words(spark, d):
    return W.words_of(_docs(spark, d), "doc_id", "text")


_Q = lambda s: s.replace("'", "''")
_WORDS = r"WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda w: w <> '') w FROM documents WHERE text IS NOT NULL), w AS (SELECT doc_id, CAST(unnest(range(len(w))) AS INT) AS pos, unnest(w) AS word FROM t)"


def clean_text(spark, d):
    return _docs(spark, d).select("doc_id", T.clean_text(F.col("text")).alias("clean"))


def _repair_sql(x: str) -> str:
    """A text read again as UTF-8, twice, from the code numbers of its characters."""
    utf8 = r"([\x00-\x7f]|[\x{c2}-\x{df}][\x{80}-\x{bf}]|[\x{e0}-\x{ef}][\x{80}-\x{bf}]{2}|[\x{f0}-\x{f4}][\x{80}-\x{bf}]{3})*"
    for _ in range(2):
        b = f"translate({x}, '{T.CP1252}', '{T.CP1252_AT}')"
        x = rf"(CASE WHEN regexp_matches({x}, '[\x{{c2}}-\x{{f4}}]') AND regexp_full_match({b}, '{utf8}', 's') THEN decode(unhex(array_to_string(list_transform(regexp_extract_all({b}, '.', 0, 's'), lambda h: printf('%02x', unicode(h))), ''))) ELSE {x} END)"
    return x


def _emoji_sql(x: str) -> str:
    """Emoji by a map from each to its name in Unicode."""
    named = {chr(c): T.name_emoji(chr(c)) for r in (range(0x2600, 0x27C0), range(0x1F300, 0x1FB00)) for c in r}
    entries = ", ".join(f"'{k}': '{v}'" for k, v in named.items())
    chars = rf"regexp_extract_all(regexp_replace({x}, '([\x{{1F300}}-\x{{1FAFF}}\x{{2600}}-\x{{27BF}}])\x{{FE0F}}', '\1', 'g'), '.', 0, 's')"
    return rf"(CASE WHEN regexp_matches({x}, '[\x{{1F300}}-\x{{1FAFF}}\x{{2600}}-\x{{27BF}}]') THEN array_to_string(list_transform({chars}, lambda h: coalesce(MAP {{{entries}}}[h], h)), '') ELSE {x} END)"


def _clean_sql() -> str:
    # In steps, so that no expression stands in another twice. The run-collapsing pattern needs
    # a back reference: one replacement for each mark instead.
    folded = f"regexp_replace(x, '{T.MARKUP}', '', 'g')"
    for k, v in T.FOLD_MANY.items():
        folded = f"replace({folded}, '{k}', '{v}')"
    s = f"translate({folded}, '{_Q(T.FOLD_FROM)}', '{_Q(T.FOLD_TO)}')"
    for c in T.RUNS:
        esc = "\\" + c if c in "$+./?[]\\-" else c
        s = f"regexp_replace({s}, '{_Q(esc)}{{2,}}', '{_Q(c) if c != chr(92) else chr(92) * 2}', 'g')"
    for k, v in T.SPELLED.items():
        s = f"replace({s}, '{k}', '{v}')"
    return f"WITH a AS (SELECT doc_id, {_repair_sql('text')} x FROM documents), b AS (SELECT doc_id, {_emoji_sql('x')} x FROM a), c AS (SELECT doc_id, {s} x FROM b) SELECT doc_id, trim(regexp_replace(x, '[\\p{{Z}}\\s\\x0B\\x{{85}}]+', ' ', 'g')) AS clean FROM c"


def clean_description(spark, d):
    rows = table(spark, d, "segment_k2f").where("description is not null").select("youtube_id", "description").distinct()
    return rows.select("youtube_id", T.clean_description(F.col("description")).alias("clean")).distinct()


def normalise_words(spark, d):
    return _words(spark, d).select("doc_id", "pos", T.normalised_word(F.col("word")).alias("norm"))


def word_features(spark, d):
    return W.row_features(_docs(spark, d).where("text is not null"), W.split_words(F.col("text")), "doc_id").drop("word")


def token_quality(spark, d):
    q = _docs(spark, d).where("text is not null").select("doc_id", W.row_quality(W.split_words(F.col("text"))).alias("q")).where("q is not null")
    return q.select("doc_id", "q.n_words", F.round("q.frac_good", 6).alias("frac_good"), F.round("q.len_var", 6).alias("len_var"), ((F.col("q.frac_good") < 0.6) | (F.col("q.len_var") > 10)).alias("dropped"))


def clean_subtitle_words(spark, d):
    return W.clean_subtitles(_words(spark, d)).groupBy("doc_id").agg(F.count("*").alias("n"))


def desc_token_filter(spark, d):
    return _docs(spark, d).where("text is not null").select("doc_id", T.description_tokens(F.col("text")).alias("kept"))


def spelled_numbers(spark, d):
    return _docs(spark, d).where("text is not null").select("doc_id", T.spelled_numbers(F.col("text")).alias("spelled"))


def repaired_texts(spark, d):
    return _docs(spark, d).where("text is not null").select("doc_id", T.named_emoji(T.repaired_text(F.col("text"))).alias("repaired"))


def quality_reason(spark, d):
    """The crawl's gates on documents joined with their video's latest crawl."""
    meta = table(spark, d, "meta_info").groupBy("youtube_id").agg(F.max(F.struct("crawled_at", "categories", "_avg_cosine_sim", "_num_coco_objects_expectation")).alias("m"))
    rows = _docs(spark, d).join(meta, "youtube_id", "left")
    gates = Q.crawl_gates(transcript=F.col("text"), duration=F.col("n_chars") / 2, categories=F.col("m.categories"), density=F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).cast("double"), lang=F.lower(F.substring("lang", 1, 2)), cosine=F.nanvl("m._avg_cosine_sim", F.lit(None)), objects=F.nanvl("m._num_coco_objects_expectation", F.lit(None)), min_density=20)
    return Q.with_reason(rows, gates).select("doc_id", "failreason")


def sampled_gate(spark, d):
    """The similarity gate applied to a tenth of the rows, chosen by hash."""
    u = uniform(3, "youtube_id", "upload_date")
    m = table(spark, d, "meta_info").select("youtube_id", "upload_date", u.alias("u"), "_avg_cosine_sim").distinct()
    return m.select("youtube_id", F.round("u", 9).alias("u"), F.coalesce((F.col("u") > 0.9) & (F.col("_avg_cosine_sim") > 0.85), F.lit(False)).alias("dropped"))


def source_whitelist_shard(spark, d):
    """Shard 1 of 4 by doc_id, of the kinds wanted."""
    return _docs(spark, d).where("doc_kind in ('transcript', 'article', 'qa') and doc_id % 4 = 1").select("doc_id", "doc_kind")


def vocab_topk_ties(spark, d):
    """Words at least as frequent as the 200th, ties kept. The rank is taken over words,
    after counting; only those near the top leave the partial limits."""
    n = _words(spark, d).groupBy("word").agg(F.count("*").alias("n"))
    return n.withColumn("rank", F.rank().over(Window.orderBy(F.desc("n")))).where("rank <= 200")


def answer_frequency(spark, d):
    return _docs(spark, d).groupBy(F.lower("doc_kind").alias("kind"), F.coalesce(F.lower("lang"), F.lit("")).alias("lang")).agg(F.count("*").alias("n"))


def dedup_random_survivor(spark, d):
    """One document of each different text, chosen by hash."""
    rows = _docs(spark, d).where("text is not null").select("doc_id", F.sha2("text", 256).alias("k"), uniform(5, "doc_id").alias("u"))
    best = rows.groupBy("k").agg(F.min(F.struct("u", "doc_id")).alias("b"), F.count("*").alias("copies"))
    return best.select("b.doc_id", "copies")


def sha_keys(spark, d):
    return _docs(spark, d).select("doc_id", F.sha2("text", 256).alias("sha"))


def string_codes(spark, d):
    return _docs(spark, d).select("doc_id", encoded_string(F.coalesce("source", F.lit("")), 24).alias("codes"))


def source_colours(spark, d):
    return _docs(spark, d).where("source is not null").select("source").distinct().select("source", T.stable_colour(F.col("source")).alias("rgb"))


def infill_template(spark, d):
    """Template of each question: its last word made '_'."""
    q = table(spark, d, "eval_items").where("text is not null").select("item_id", F.regexp_replace("text", r"\S+\s*$", "_").alias("t"))
    return q.select("item_id", T.infill(F.col("t")).alias("template"), T.infill(F.col("t")).isNull().alias("bad"))


def anti_join_resume(spark, d):
    """Ids of the list that are not crawled yet."""
    return table(spark, d, "video_ids").distinct().join(table(spark, d, "meta_info").select(F.col("youtube_id").alias("video_id")), "video_id", "left_anti")


def processed_ids(spark, d):
    return table(spark, d, "meta_info").select(F.col("youtube_id").alias("video_id")).distinct()


def kl_divergence(spark, d):
    """Divergence of each language's word lengths from all documents'."""
    rows = _docs(spark, d).where("text is not null").withColumn("lang", F.coalesce("lang", F.lit("?")))
    w = W.words_of(rows, "lang", "text").withColumn("len", F.least(F.length("word"), F.lit(20)))
    p = w.groupBy("lang", "len").agg(F.count("*").alias("n"))
    p = p.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("lang")))
    q = p.groupBy("len").agg(F.sum("n").alias("m"))
    q = q.withColumn("q", F.col("m") / F.sum("m").over(Window.partitionBy()))  # one row a length, 20 at most
    return p.join(F.broadcast(q), "len").groupBy("lang").agg(F.round(F.sum(F.col("p") * F.ln(F.col("p") / F.col("q"))), 6).alias("kl"))


def span_length_stats(spark, d):
    """Mean and linear quantiles of words per document."""
    n = _docs(spark, d).where("text is not null").select(F.size(W.split_words(F.col("text"))).alias("n")).where("n > 0")
    return n.agg(F.round(F.avg("n"), 4).alias("mean"), F.max("n").alias("most"), *[F.expr(f"cast(percentile(n, {p}) as int)").alias(f"p{int(p * 100)}") for p in (0.9, 0.95, 0.99)])


def clock_functions(spark, d):
    """Interval starts as clock strings and back."""
    q = table(spark, d, "eval_items").select("item_id", T.interval_of(F.col("ts")).alias("i"))
    return q.select("item_id", F.round("i.a", 3).alias("a"), F.round("i.b", 3).alias("b"), T.clock_of_seconds(F.col("i.a")).alias("clock"), F.round(T.seconds_of_clock(T.clock_of_seconds(F.col("i.a"))), 3).alias("back"))


def qa_ids(spark, d):
    q = table(spark, d, "eval_items").select("item_id", T.qa_id(F.col("item_id"), F.col("vid_name")).alias("id"))
    return q.select("item_id", "id", F.split_part("id", F.lit("~"), F.lit(1)).try_cast("bigint").alias("qid"), F.element_at(F.split("id", "_"), -1).alias("last_part"))


def split_chunks(spark, d):
    """Documents in id order cut into six equal parts and a rest."""
    size = F.greatest(F.floor(F.col("total") / 6), F.lit(1))
    return numbered(_docs(spark, d).select("doc_id"), "doc_id").select("doc_id", F.least(F.floor(F.col("n") / size), F.lit(6)).cast("int").alias("part"))


def clean_words(spark, d):
    """Words whose repaired form is not empty, as repaired."""
    return W.clean_subtitles(_words(spark, d), store_repaired=True)


def searchable_texts(spark, d):
    """An item's show, text without addresses, and words of its clip's name."""
    q = table(spark, d, "eval_items")
    return q.select("item_id", T.searchable_text(F.col("show_name"), F.col("text"), F.split("vid_name", "_")).alias("searchable"))


def clean_flags(spark, d):
    return _docs(spark, d).where("text is not null").select("doc_id", T.is_clean(F.col("text")).alias("clean"))


def location_texts(spark, d):
    """Where an item's interval lies in a video as long as it ends late."""
    q = table(spark, d, "eval_items").select("item_id", T.interval_of(F.col("ts")).alias("i"))
    return q.select("item_id", T.location_text(F.col("i.a"), F.col("i.b"), F.col("i.b") + 7).alias("location"))


def annotation_ids(spark, d):
    q = table(spark, d, "eval_items").select("item_id", F.concat(F.col("suite"), F.lit("-"), F.col("item_id").cast("string"), F.lit("-q_"), F.col("vid_name")).alias("name"))
    return q.select("item_id", T.annotation_id(F.col("name")).alias("annotation"), T.condition_of(F.col("name")).alias("condition"))


def category_ids(spark, d):
    """Crawled categories by the table of names, each with its videos; others have no id."""
    names = R.categories(spark)
    c = table(spark, d, "meta_info").select("youtube_id", F.explode("categories").alias("category")).distinct()
    return c.join(F.broadcast(names), F.lower("category") == F.col("name"), "left").groupBy("category", "category_id").agg(F.count("*").alias("videos"))  # twenty names


QUERIES = {f.__name__: f for f in (clean_text, clean_description, normalise_words, word_features, token_quality, clean_subtitle_words, desc_token_filter, spelled_numbers, repaired_texts, quality_reason, sampled_gate, source_whitelist_shard, vocab_topk_ties, answer_frequency, dedup_random_survivor, sha_keys, string_codes, source_colours, infill_template, anti_join_resume, processed_ids, kl_divergence, span_length_stats, clock_functions, qa_ids, split_chunks, clean_words, searchable_texts, clean_flags, location_texts, annotation_ids, category_ids)}

_UP = "({0} = upper({0}) AND {0} <> lower({0}))"
_LAG = "coalesce(lag({0}) OVER w, {1}) AS {0}_left, coalesce(lead({0}) OVER w, {1}) AS {0}_right"
_URL = r"""(?i)\b((?:https?://|www\d{0,3}[.]|[a-z0-9.\-]+[.][a-z]{2,4}/)(?:[^\s()<>]+|\(([^\s()<>]+|(\([^\s()<>]+\)))*\))+(?:\(([^\s()<>]+|(\([^\s()<>]+\)))*\)|[^\s`!()\[\]{};:'".,<>?«»“”‘’]))"""
_MOD = "list_reduce(list_prepend(0::BIGINT, list_transform(regexp_extract_all(sha256(source), '.'), lambda h: ('0x' || h)::BIGINT)), lambda s, x: (s * 16 + x) % {0})"
SQL = {
    "clean_description": f"WITH t AS (SELECT DISTINCT youtube_id, description t FROM segment_k2f WHERE description IS NOT NULL), a AS (SELECT youtube_id, regexp_replace(trim({_emoji_sql('t')}), '{_Q(_URL)}', '%', 'g') t FROM t) SELECT DISTINCT youtube_id, regexp_replace(regexp_replace(regexp_replace(t, ' +', ' ', 'g'), '\\s*\\n+', chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS clean FROM a",
    "source_colours": "SELECT DISTINCT source, [" + ", ".join(f"CAST(floor({_MOD.format(m)} * 255 / {m - 1}) AS INT)" for m in (1024, 1023, 1025)) + "] AS rgb FROM documents WHERE source IS NOT NULL",
    "clean_words": _WORDS + f", r AS (SELECT doc_id, pos, word w, regexp_replace({_repair_sql('word')}, '[\\x00-\\x08\\x0b\\x0e-\\x1f\\x7f\\x{{feff}}]', '', 'g') AS word FROM w) SELECT doc_id, pos, word FROM r WHERE NOT starts_with(w, '&') AND NOT ends_with(w, ';') AND word <> ''",
    "searchable_texts": r"SELECT item_id, coalesce(show_name, '') || chr(10) || coalesce(array_to_string(list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda w: NOT (contains(w, '#') OR contains(w, 'http') OR contains(w, '@') OR contains(w, 'www')))[1:100], ' '), '') || chr(10) || coalesce(replace(vid_name, '_', ' '), '') AS searchable FROM eval_items",
    "clean_flags": "SELECT doc_id, regexp_full_match(text, '[ A-Za-z0-9.,?!'']*\\n?') AS clean FROM documents WHERE text IS NOT NULL",
    "location_texts": """WITH p AS (SELECT item_id, try_cast(split_part(ts, '-', 1) AS DOUBLE) a, try_cast(split_part(ts, '-', 2) AS DOUBLE) b FROM eval_items), q AS (SELECT item_id, CASE WHEN a IS NULL OR b IS NULL OR isnan(a) OR isnan(b) THEN 0.0 ELSE a END a, CASE WHEN a IS NULL OR b IS NULL OR isnan(a) OR isnan(b) THEN 9999.0 ELSE b END b FROM p)
SELECT item_id, CAST(trunc(a / (b + 7) * 100) AS INT) || ' to ' || CAST(trunc(b / (b + 7) * 100) AS INT) AS location FROM q""",
    "annotation_ids": "WITH q AS (SELECT item_id, suite || '-' || item_id || '-q_' || vid_name n FROM eval_items) SELECT item_id, split_part(n, '-', 1) || '-' || split_part(n, '-', 2) AS annotation, split_part(n, '_', -1) AS condition FROM q",
    "category_ids": "WITH n AS (SELECT unnest([" + ", ".join(f"'{c}'" for c in R.CATEGORIES) + f"]) nm, unnest(range({len(R.CATEGORIES)})) i), c AS (SELECT DISTINCT youtube_id, unnest(categories) AS category FROM meta_info) SELECT category, CAST(i AS INT) AS category_id, count(*) AS videos FROM c LEFT JOIN n ON lower(category) = nm GROUP BY 1, 2",
    "clean_text": _clean_sql(),
    "repaired_texts": f"WITH a AS (SELECT doc_id, {_repair_sql('text')} x FROM documents WHERE text IS NOT NULL) SELECT doc_id, {_emoji_sql('x')} AS repaired FROM a",
    "normalise_words": _WORDS + f" SELECT doc_id, pos, lower(trim(translate(word, '{_Q(T.PUNCTUATION)}', ''))) AS norm FROM w",
    "word_features": _WORDS + f", f AS (SELECT doc_id, pos, CAST(length(word) AS DOUBLE) feat_charlen, CAST({_UP.format('word[1:1]')} AS INT)::DOUBLE feat_is_upper, length(regexp_replace(lower(word), '[^aeiou]', '', 'g'))::DOUBLE feat_num_vowels, len(regexp_extract_all(word, '[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}\\p{{Nl}}\\x{{24B6}}-\\x{{24E9}}\\x{{1F130}}-\\x{{1F149}}\\x{{1F150}}-\\x{{1F169}}\\x{{1F170}}-\\x{{1F189}}\\x{{200C}}\\x{{200D}}]'))::DOUBLE feat_num_punct FROM w) SELECT *, " + ", ".join(_LAG.format(c, v) for c, v in (("feat_charlen", "1.0"), ("feat_is_upper", "0.0"), ("feat_num_vowels", "0.0"), ("feat_num_punct", "0.0"))) + " FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY pos)",
    "token_quality": _WORDS + f", q AS (SELECT doc_id, count(*) n_words, avg(CAST(NOT (length(word) > 1 AND {_UP.format('word')}) AS INT)) g, coalesce(var_samp(length(word)), 0) v FROM w GROUP BY 1) SELECT doc_id, n_words, round(g, 6) AS frac_good, round(v, 6) AS len_var, g < 0.6 OR v > 10 AS dropped FROM q",
    "clean_subtitle_words": _WORDS + f" SELECT doc_id, count(*) AS n FROM w WHERE NOT starts_with(word, '&') AND NOT ends_with(word, ';') AND regexp_replace({_repair_sql('word')}, '[\\x00-\\x08\\x0b\\x0e-\\x1f\\x7f\\x{{feff}}]', '', 'g') <> '' GROUP BY 1",
    "desc_token_filter": r"SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda w: NOT (contains(w, '#') OR contains(w, 'http') OR contains(w, '@') OR contains(w, 'www')))[1:100], ' ') AS kept FROM documents WHERE text IS NOT NULL",
    "quality_reason": r"""WITH m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY youtube_id ORDER BY crawled_at DESC) k FROM meta_info) WHERE k = 1)
SELECT doc_id, CASE WHEN text IS NULL OR text = '' THEN 'no_transcript' WHEN n_chars IS NULL OR n_chars / 2 > 1200 THEN 'video too long' WHEN list_contains(categories, 'Gaming') THEN 'gaming'
WHEN len(list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda w: w <> '')) < 20 THEN 'word density too low' WHEN lang IS NULL OR lower(lang[1:2]) <> 'en' THEN 'maybe not english'
WHEN NOT isnan(_avg_cosine_sim) AND _avg_cosine_sim > 0.9 THEN 'acs_too_high' WHEN NOT isnan(_num_coco_objects_expectation) AND _num_coco_objects_expectation < 0.9 THEN 'nco_too_low' END AS failreason
FROM documents LEFT JOIN m USING (youtube_id)""",
    "sampled_gate": f"WITH m AS (SELECT DISTINCT youtube_id, upload_date, {uniform_sql(3, 'youtube_id', 'upload_date')} u, _avg_cosine_sim c FROM meta_info) SELECT youtube_id, round(u, 9) AS u, coalesce(u > 0.9 AND c > 0.85, false) AS dropped FROM m",
    "string_codes": "WITH s AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(source, ''))), '..'), lambda h: CAST('0x' || h AS INT)) c FROM documents) SELECT doc_id, list_concat(c, list_transform(range(0, greatest(0, 24 - len(c))), lambda z: CAST(0 AS INT)))[1:24] AS codes FROM s",
    "source_whitelist_shard": "SELECT doc_id, doc_kind FROM documents WHERE doc_kind IN ('transcript', 'article', 'qa') AND doc_id % 4 = 1",
    "vocab_topk_ties": _WORDS + ", n AS (SELECT word, count(*) n FROM w GROUP BY 1), r AS (SELECT word, n, CAST(rank() OVER (ORDER BY n DESC) AS INT) AS rank FROM n) SELECT * FROM r WHERE rank <= 200",
    "answer_frequency": "SELECT lower(doc_kind) AS kind, coalesce(lower(lang), '') AS lang, count(*) AS n FROM documents GROUP BY 1, 2",
    "dedup_random_survivor": f"SELECT doc_id, copies FROM (SELECT doc_id, count(*) OVER (PARTITION BY text) copies, row_number() OVER (PARTITION BY text ORDER BY {uniform_sql(5, 'doc_id')}, doc_id) k FROM documents WHERE text IS NOT NULL) WHERE k = 1",
    "sha_keys": "SELECT doc_id, sha256(text) AS sha FROM documents",
    "infill_template": r"""WITH t AS (SELECT item_id, regexp_replace(text, '[^ \t\n\x0B\f\r]+[ \t\n\x0B\f\r]*$', '_') t FROM eval_items WHERE text IS NOT NULL), o AS (SELECT item_id, t, length(t) - length(replace(t, '_', '')) = 1 ok FROM t)
SELECT item_id, CASE WHEN ok THEN replace(replace(t, '_', '<|MASK|>'), ' <|MASK|>', '<|MASK|>') END AS template, NOT ok AS bad FROM o""",
    "anti_join_resume": "SELECT DISTINCT video_id FROM video_ids WHERE NOT EXISTS (SELECT 1 FROM meta_info WHERE youtube_id = video_id)",
    "processed_ids": "SELECT DISTINCT youtube_id AS video_id FROM meta_info",
    "kl_divergence": _WORDS + ", x AS (SELECT coalesce(lang, '?') lang, least(length(word), 20) l FROM w JOIN documents USING (doc_id)), p AS (SELECT lang, l, count(*) n, count(*) / sum(count(*)) OVER (PARTITION BY lang) p FROM x GROUP BY 1, 2), q AS (SELECT l, sum(n) / sum(sum(n)) OVER () q FROM p GROUP BY 1) SELECT lang, round(sum(p * ln(p / q)), 6) AS kl FROM p JOIN q USING (l) GROUP BY 1",
    "span_length_stats": _WORDS + ", n AS (SELECT doc_id, count(*) n FROM w GROUP BY 1) SELECT round(avg(n), 4) AS mean, max(n) AS most, CAST(trunc(quantile_cont(n, 0.9)) AS INT) AS p90, CAST(trunc(quantile_cont(n, 0.95)) AS INT) AS p95, CAST(trunc(quantile_cont(n, 0.99)) AS INT) AS p99 FROM n",
    "clock_functions": """WITH p AS (SELECT item_id, try_cast(split_part(ts, '-', 1) AS DOUBLE) a, try_cast(split_part(ts, '-', 2) AS DOUBLE) b FROM eval_items), q AS (SELECT item_id, CASE WHEN a IS NULL OR b IS NULL OR isnan(a) OR isnan(b) THEN 0.0 ELSE a END a, CASE WHEN a IS NULL OR b IS NULL OR isnan(a) OR isnan(b) THEN 9999.0 ELSE b END b FROM p)
SELECT item_id, round(a, 3) AS a, round(b, 3) AS b, printf('%02d:%02d:%02d.%s', CAST(a AS INT) // 3600, CAST(floor(a) AS INT) // 60 % 60, CAST(floor(a) AS INT) % 60, split_part(printf('%.3f', a), '.', 2)) AS clock, round(a, 3) AS back FROM q""",
    "qa_ids": "WITH q AS (SELECT item_id, lpad(CAST(item_id AS VARCHAR), 6, '0') || '~' || vid_name AS id FROM eval_items) SELECT item_id, id, TRY_CAST(split_part(id, '~', 1) AS BIGINT) AS qid, split_part(id, '_', -1) AS last_part FROM q",
    "split_chunks": "SELECT doc_id, CAST(least((row_number() OVER (ORDER BY doc_id) - 1) // greatest(1, (SELECT count(*) FROM documents) // 6), 6) AS INT) AS part FROM documents",
}
