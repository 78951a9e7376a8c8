"""Queries over the test tables, one for each operator, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as fn
from .operators import embed, metrics, monitor, runlog, sampling, tokenize, vocab
from .plans import config as cfg
from .sources import corpus, files

ALPHA, TOTAL, DEV, SEED = 0.7, 1000, 0.1, 1


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _docs(spark, sf) -> DataFrame:
    return _t(spark, sf, "documents").select(F.col("lang").alias("source"), F.col("doc_id").alias("row_id"), "text")


def _keys(spark, sf) -> DataFrame:
    return _docs(spark, sf).drop("text")


# corpora


def docs_to_lines(spark, sf):
    return fn.docs_to_lines(_t(spark, sf, "documents").select("doc_id", "text"))


def documents_of_language(spark, sf):
    out = corpus.read_documents(spark, f"{sf}/documents.parquet", "fr")
    return out.select("split", "source_name", "row_idx.doc", "row_idx.pos", F.col("text").alias("line"))


def plaintext_clean(spark, sf):
    lines = docs_to_lines(spark, sf)
    padded = F.when(F.col("pos") % 5 == 0, F.lit("  \t")).otherwise(F.concat(F.lit(" \t"), "line", F.lit("  \r")))
    return fn.clean_lines(lines.select("doc_id", "pos", padded.alias("text")))


def concat_sources(spark, sf):
    parts = [("documents", "doc_id"), ("conversations", F.col("conv_id") * 1000 + F.col("turn")), ("benchmark", "item_id")]
    out = [_t(spark, sf, n).select(F.lit("train").alias("split"), F.lit(n).alias("source_name"), (F.col(k) if isinstance(k, str) else k).alias("row_idx"), "text") for n, k in parts]
    return corpus.concat(out).select("source_idx", "source_name", "row_idx", "text")


def dir_sources(spark, sf):
    import os

    folder = files.scratch(spark)
    for i, lines in enumerate((["b one", "", " two "], ["three"])):
        with open(os.path.join(folder, f"{i}.txt"), "w", encoding="utf-8") as f:
            f.write("\n".join(lines))
    return corpus.read_plaintext_dir(spark, folder)


# sampling


def split_fraction(spark, sf):
    return sampling.split(_keys(spark, sf), DEV, seed=SEED).select("source", "row_id", "split", "pool_idx")


def split_count(spark, sf):
    return sampling.split(_keys(spark, sf).withColumn("source", F.lit("all")), 50, seed=SEED).select("row_id", "split")


def _report(spark, sf, alpha=ALPHA):
    return sampling.multinomial(_keys(spark, sf), alpha, TOTAL, DEV, seed=SEED)


def alpha_probabilities(spark, sf):
    rows = sorted((r[0], r[1]) for r in _keys(spark, sf).groupBy("source").count().collect())
    p = sampling.probabilities([n for _, n in rows], ALPHA)
    return spark.createDataFrame([(s, n, round(x, 9)) for (s, n), x in zip(rows, p, strict=True)], "source string, n long, p double")


def allocation(spark, sf):
    out = None
    for alpha in (0.3, 0.7, 1.0):
        one = sampling.allocation_table(spark, _report(spark, sf, alpha)[2]).select(F.lit(alpha).alias("alpha"), "source", "train_rows", "allocated")
        out = one if out is None else out.union(one)
    return out


def sample_without(spark, sf):
    return _report(spark, sf)[0].where("source = 'en'").select("row_id", "draw_idx")


def sample_with(spark, sf):
    return _report(spark, sf)[0].where("source <> 'en'").select("source", "row_id", "draw_idx")


def multinomial_train(spark, sf):
    return _report(spark, sf)[0].select("source", "row_id", "draw_idx", "shuffle_key")


def multinomial_dev(spark, sf):
    return _report(spark, sf)[1].select("source", "row_id")


def multinomial_report(spark, sf):
    return sampling.allocation_table(spark, _report(spark, sf)[2])


def shuffle_order(spark, sf):
    keyed = _report(spark, sf)[0].withColumn("all", F.lit(0))
    return sampling.positions(keyed, ["all"], "shuffle_key", ["source", "row_id", "draw_idx"]).select("rn", "source", "row_id")


def vocab_subset(spark, sf):
    return sampling.subset(_docs(spark, sf).drop("source"), 100, seed=SEED).select("row_id", "text")


def subset_jsonl(spark, sf):
    path = f"{files.scratch(spark)}/subset.jsonl"
    files.write_jsonl(vocab_subset(spark, sf), path)
    return files.read_jsonl(spark, path)


# vocabularies


def _counts(spark, sf, lang=None):
    docs = _docs(spark, sf)
    docs = docs.where(F.col("source") == lang) if lang else docs
    return vocab.token_counts(vocab.whitespace_tokens(docs.select("text")))


def token_counts(spark, sf):
    return _counts(spark, sf)


OPTIONS = {"min_frequency": 2, "single": True, "registered": ("▁the", "▁de")}


def seed_vocab(spark, sf):
    return vocab.seed_vocabulary(_counts(spark, sf), **OPTIONS)


EXTRA = (("<s>", 5), ("<mask>", 3), ("<madeupword1>", 7), ("<madeupword2>", 1), ("▁<s>", 4))


def seed_reasons(spark, sf):
    return vocab.reasons(_counts(spark, sf).unionByName(spark.createDataFrame(list(EXTRA), "token string, freq long")), **OPTIONS)


def seed_totals(spark, sf):
    return vocab.totals(seed_vocab(spark, sf))


def vocab_preview(spark, sf):
    return seed_vocab(spark, sf).orderBy(F.desc("freq"), "token").limit(20)


def _ids(spark, sf):
    """Tokens numbered in the order of their hashes."""
    counts = _counts(spark, sf).withColumns({"all": F.lit(0), "key": F.md5("token")})
    return sampling.positions(counts, ["all"], "key", ["token"]).select("token", (F.col("rn") - 1).alias("id"))


def vocab_validation(spark, sf):
    return vocab.profile(_ids(spark, sf))


def vocab_overlap(spark, sf):
    return vocab.overlap(_counts(spark, sf, "en"), _counts(spark, sf, "fr"))


def _encoded(spark, sf, most=16):
    words = F.filter(F.split("text", r"[ \n]+"), lambda w: w != "")
    ids = F.transform(words, lambda w: F.length(w).cast("int"))
    return _t(spark, sf, "documents").select("doc_id", tokenize.truncate(ids, most).alias("input_ids"))


def encode_truncate(spark, sf):
    e = _encoded(spark, sf)
    return e.select("doc_id", F.array_join("input_ids", ",").alias("ids"), F.size("input_ids").alias("n"), F.array_join(tokenize.mask(F.col("input_ids")), ",").alias("mask"))


def collate_pad(spark, sf):
    c = tokenize.collate(_encoded(spark, sf).withColumn("batch", F.floor(F.col("doc_id") / 8)), "batch", 1)
    return c.select("doc_id", *[F.array_join(x, ",").alias(x) for x in ("input_ids", "labels", "attention_mask")])


def token_id_counts(spark, sf):
    import public_tokenizers

    return vocab.tokenizer_counts(_docs(spark, sf), public_tokenizers.path("piece_bpe_32k.model"))


def tokenize_public(spark, sf):
    import public_tokenizers

    rows = _docs(spark, sf).withColumn("split", F.lit("train"))
    out = tokenize.tokenize(rows, public_tokenizers.path("piece_bpe_32k.model"), 256)
    return out.select("source", "row_id", F.size("input_ids").alias("n"), F.crc32(F.array_join("input_ids", ",").cast("binary")).alias("ids_crc32"))


# metrics


def argmax(spark, sf):
    return _t(spark, sf, "embeddings").select("vec_id", metrics.argmax(F.col("embedding")).alias("best"))


def _predicted(spark, sf):
    words = F.filter(F.split("text", r"[ \n]+"), lambda w: w != "")
    return _t(spark, sf, "documents").select("lang", "doc_id", words.alias("pred"), F.transform(words, lambda w, i: F.when(i % 5 == 4, -100).otherwise(1)).alias("label"))


def _rounded(df):
    return df.withColumns({c: F.round(c, 9) for c in ("distinct_1_batch", "distinct_1_seq")})


def distinct_all(spark, sf):
    return _rounded(metrics.distinctness(_predicted(spark, sf)))


def distinct_unmasked(spark, sf):
    return _rounded(metrics.distinctness(_predicted(spark, sf), label=None))


def distinct_by_lang(spark, sf):
    return _rounded(metrics.distinctness(_predicted(spark, sf), by=["lang"]))


# run logs


def _log(spark, sf):
    """events as a log: a run for each user modulo 4, a column for each event type."""
    e = _t(spark, sf, "events").withColumn("run", F.concat(F.lit("run"), (F.col("user_id") % 4).cast("string")))
    kinds = ("view", "signup", "purchase", "error", "click")
    return e.select("run", F.col("event_id").alias("step"), *[F.when(F.col("event_type") == k, F.col("value")).alias(k) for k in kinds])


def runlog_union(spark, sf):
    log = _log(spark, sf)
    parts = [log.where("run = 'run0'").drop("click"), log.where("run = 'run1'").drop("view"), log.where("run = 'run2'").select("run", "step", "error")]
    return runlog.union(parts).select("run", "step", "view", "click", "error")


def runlog_list(spark, sf):
    return runlog.metric_counts(_log(spark, sf))


def runlog_series(spark, sf):
    return runlog.series(_log(spark, sf), "purchase")


def runlog_melt(spark, sf):
    return runlog.melt(_log(spark, sf), ["view", "error"])


def runlog_runs(spark, sf):
    return _log(spark, sf).agg(F.countDistinct("run").alias("n_runs"), (F.countDistinct("run") > 1).alias("several"))


def expand_patterns(spark, sf):
    names = _log(spark, sf).columns
    out = runlog.expand(["p*", "loss", "*i*", "view", "[ce]*"], [n for n in names if n not in runlog.AXES])
    return spark.createDataFrame(list(enumerate(out)), "pos long, metric string")


def _loss(spark, sf):
    e = _t(spark, sf, "events").where("value is not null")
    return e.select((F.col("user_id") % 8).alias("run"), F.col("event_id").alias("step"), (F.col("value") - 1).alias("loss"))


def divergence(spark, sf):
    return monitor.divergence(_loss(spark, sf))


def early_stop(spark, sf):
    return monitor.early_stop(_loss(spark, sf), 3, 0.2, 1000, loss="loss")


def unfreeze(spark, sf):
    return monitor.unfreeze(_loss(spark, sf), 0.1, 1000)


def freeze_prefix(spark, sf):
    return _t(spark, sf, "part").select("p_partkey", monitor.trainable(F.col("p_name"), "a").alias("trainable"))


def cadence(spark, sf):
    steps = _t(spark, sf, "events").select(F.col("event_id").alias("step"))
    return steps.agg(*[F.count_if(monitor.due(F.col("step"), 1000, n)).alias(k) for k, n in (("logged", 400), ("evaluated", 100))])


# names and configurations


def format_number(spark, sf):
    return _t(spark, sf, "orders").select("o_orderkey", fn.format_number(F.col("o_orderkey") * 997).alias("short"))


def shortname(spark, sf):
    return _t(spark, sf, "supplier").select("s_suppkey", fn.model_shortname(F.concat(F.lit("Org/Some-Model.v"), F.col("s_suppkey").cast("string"), F.lit("-B"))).alias("short"), fn.capitalize(F.col("s_name")).alias("title"))


def artifact_suffix(spark, sf):
    k = F.col("p_partkey")
    s = fn.artifact_suffix(F.lit("org/base-1.5B"), k * 100, k * 5000, k % 2 == 0, k % 3 == 0, (k % 4).cast("int"), k % 5 != 0)
    return _t(spark, sf, "part").select("p_partkey", s.alias("suffix"))


def path_parts(spark, sf):
    url = F.col("url")
    return _t(spark, sf, "pages").select("page_id", fn.file_stem(url).alias("stem"), fn.grandparent(url).alias("above"))


CONFIG_A = {"type": "oscar", "seed": 1, "training": {"max_length": 256, "dev_size": 100}, "old": True}
CONFIG_B = {"type": "concat", "seed": 1, "training": {"max_length": 512, "dev_size": 100}, "new": [1, 2]}


def config_diff(spark, sf):
    a = spark.createDataFrame(cfg.flatten(CONFIG_A), "path string, cached string")
    b = spark.createDataFrame(cfg.flatten(CONFIG_B), "path string, current string")
    both = a.join(b, "path", "full").where(~F.col("cached").eqNullSafe(F.col("current")))
    return both


# embeddings


def _vectors(spark, sf):
    """All are tokens of the new vocabulary, those of even ids of the old one, too."""
    return _t(spark, sf, "embeddings").select("vec_id", F.concat(F.lit("t"), F.col("vec_id").cast("string")).alias("token"), "embedding")


def _parts(spark, sf):
    v = _vectors(spark, sf)
    old, new = v.where("vec_id % 2 = 0").select("token", "embedding"), v.select("token", F.col("vec_id").alias("id"))
    return v, old, new


def embed_overlap(spark, sf):
    v, old, new = _parts(spark, sf)
    return embed.shared(old, new).select("id", F.lit(True).alias("shared")).union(embed.missing(old, new).select("id", F.lit(False)))


def _similar(spark, sf, pairs=embed.similarity):
    v, old, new = _parts(spark, sf)
    keys = embed.shared(old, new).select(F.col("id").alias("key"), F.col("embedding").alias("aux"))
    want = embed.missing(old, new).join(v.select("token", F.col("embedding").alias("aux")), "token")
    return pairs(want, keys)


def embed_similarity(spark, sf):
    return _similar(spark, sf).select("id", "key", F.round("z", 6).alias("z"))


def embed_sparsemax(spark, sf):
    return embed.sparsemax(_similar(spark, sf, embed.contenders)).select("id", "key", F.round("weight", 6).alias("weight"))


def embed_combine(spark, sf):
    v = _vectors(spark, sf).select(F.col("vec_id").alias("key"), "embedding")
    return embed.combine(embed.sparsemax(_similar(spark, sf, embed.contenders)), v).select("id", "pos", F.round("value", 6).alias("value"))


def embed_initialise(spark, sf):
    v, old, new = _parts(spark, sf)
    out = embed.initialise(old, new, v.select("token", F.col("embedding").alias("aux")))
    return out.select("id", F.size("embedding").alias("d"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


WHITE_SQL = r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
LINES_SQL = "SELECT doc_id, CAST(unnest(range(len(l))) AS INTEGER) AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)"
SPLIT_SQL = """
  r AS (SELECT lang AS source, doc_id AS row_id, row_number() OVER (PARTITION BY lang ORDER BY md5('1:split:' || lang || ':' || doc_id), doc_id) AS rn,
    count(*) OVER (PARTITION BY lang) AS n FROM documents),
  s AS (SELECT source, row_id, CASE WHEN rn <= ceil(n * CAST(0.1 AS DOUBLE)) THEN 'dev' ELSE 'train' END AS split,
    CASE WHEN rn > ceil(n * CAST(0.1 AS DOUBLE)) THEN CAST(rn - ceil(n * CAST(0.1 AS DOUBLE)) - 1 AS BIGINT) END AS pool_idx FROM r),
  z AS (SELECT source, count(*) FILTER (split = 'dev') AS dev_rows, count(*) FILTER (split = 'train') AS train_rows FROM s GROUP BY source)"""


def _alloc_sql(alpha: float, name: str = "a") -> str:
    return f"""
  {name}0 AS (SELECT *, floor(pow(train_rows, CAST({alpha} AS DOUBLE)) / sum(pow(train_rows, CAST({alpha} AS DOUBLE))) OVER () * {TOTAL}) AS f, row_number() OVER (ORDER BY source) AS k FROM z),
  {name} AS (SELECT source, dev_rows, train_rows, CAST(f + CASE WHEN k <= {TOTAL} - sum(f) OVER () THEN 1 ELSE 0 END AS BIGINT) AS allocated FROM {name}0)"""


TRAIN_SQL = f"""WITH {SPLIT_SQL}, {_alloc_sql(ALPHA)},
  w AS (SELECT s.source, row_id, pool_idx AS draw_idx FROM s JOIN a USING (source) WHERE split = 'train' AND allocated <= train_rows AND pool_idx < allocated),
  j AS (SELECT source, train_rows, unnest(range(allocated)) AS draw_idx FROM a WHERE allocated > train_rows),
  d AS (SELECT source, draw_idx, CAST('0x' || substr(md5('1:draw:' || source || ':' || draw_idx), 1, 15) AS BIGINT) % train_rows AS pool_idx FROM j),
  x AS (SELECT source, row_id, draw_idx FROM w UNION ALL SELECT d.source, s.row_id, d.draw_idx FROM d JOIN s ON s.source = d.source AND s.pool_idx = d.pool_idx),
  train AS (SELECT source, row_id, draw_idx, md5('1:shuffle:' || source || ':' || row_id || ':' || draw_idx) AS shuffle_key FROM x)"""
WORDS_SQL = "list_filter(regexp_split_to_array(text, '[ \\n]+'), lambda w: w <> '')"
TOKENS_SQL = f"c AS (SELECT token, count(*) AS freq FROM (SELECT '▁' || unnest({WORDS_SQL}) AS token FROM documents) GROUP BY token)"
REASON_SQL = """q AS (SELECT token, freq, CASE WHEN freq < 2 THEN 'below_min_frequency' WHEN token IN ('<unk>', '<s>', '</s>', '<pad>', '<mask>') THEN 'special_token'
    WHEN starts_with(token, '<madeupword') THEN 'madeupword_token' WHEN token IN ('▁the', '▁de') THEN 'registered_special' WHEN length(replace(token, '▁', '')) = 1 THEN 'single_char' END AS reason FROM c)"""
LOG_SQL = "g AS (SELECT 'run' || (user_id % 4) AS run, event_id AS step, " + ", ".join(f"CASE WHEN event_type = '{k}' THEN value END AS {k}" for k in ("view", "signup", "purchase", "error", "click")) + " FROM events)"
LOSS_SQL = "g AS (SELECT user_id % 8 AS run, event_id AS step, value - 1 AS loss FROM events WHERE value IS NOT NULL)"
PRED_SQL = f"p0 AS (SELECT lang, doc_id, {WORDS_SQL} AS w FROM documents)"


def _distinct_sql(by: str, masked: bool = True) -> str:
    keep = "list_filter(list_transform(w, lambda x, i: CASE WHEN (i - 1) % 5 = 4 THEN NULL ELSE x END), lambda x: x IS NOT NULL)" if masked else "w"
    sel, grp = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    return f"""WITH {PRED_SQL}, p AS (SELECT lang, doc_id, {keep} AS v FROM p0),
  e AS (SELECT {sel}count(DISTINCT t) AS kinds FROM (SELECT lang, unnest(v) AS t FROM p) {grp}),
  f AS (SELECT {sel}avg(len(list_distinct(v)) / nullif(CAST(len(v) AS DOUBLE), 0)) AS seq, CAST(sum(len(v)) AS BIGINT) AS n FROM p {grp})
SELECT {sel}round(coalesce(kinds / nullif(CAST(n AS DOUBLE), 0), 0.0), 9) AS distinct_1_batch, round(coalesce(seq, 0.0), 9) AS distinct_1_seq, n AS num_eval_tokens FROM f {f'JOIN e USING ({by})' if by else 'CROSS JOIN e'}"""


VEC_SQL = """
  v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
  u AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v),
  z AS (SELECT q.vec_id AS id, k.vec_id AS key, list_sum(list_transform(list_zip(q.e, k.e), lambda p: p[1] * p[2])) / (q.n * k.n) AS z
    FROM u q JOIN u k ON q.vec_id % 2 = 1 AND k.vec_id % 2 = 0)"""
MAX_SQL = VEC_SQL + """,
  o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY z DESC, key) AS k, sum(z) OVER (PARTITION BY id ORDER BY z DESC, key ROWS UNBOUNDED PRECEDING) AS c FROM z),
  t AS (SELECT id, max(k) AS k FROM o WHERE 1 + k * z > c GROUP BY id),
  m AS (SELECT o.id, o.key, o.z - (b.c - 1) / b.k AS weight FROM o JOIN t ON t.id = o.id JOIN o b ON b.id = t.id AND b.k = t.k),
  w AS (SELECT * FROM m WHERE weight > 0)"""


def oracle_sql() -> dict[str, str]:
    report = f"WITH {SPLIT_SQL}, {_alloc_sql(ALPHA)} SELECT source, dev_rows, train_rows, allocated, 100.0::DOUBLE * allocated / {TOTAL} AS percent FROM a"
    subset = "SELECT doc_id AS row_id, text FROM (SELECT doc_id, text, row_number() OVER (ORDER BY md5('1:subset:' || doc_id), doc_id) AS rn FROM documents) WHERE rn <= 100"
    num = lambda x: f"CASE WHEN {x} >= 1000000 THEN ({x} // 1000000) || 'm' WHEN {x} >= 1000 THEN ({x} // 1000) || 'k' ELSE CAST({x} AS VARCHAR) END"
    flat = lambda c, n: " UNION ALL ".join(f"SELECT '{k}' AS path, '{v}' AS {n}" for k, v in cfg.flatten(c))
    e16 = f"e AS (SELECT doc_id, list_slice(list_transform({WORDS_SQL}, lambda w: length(w)), 1, 16) AS x FROM documents)"
    return {
        "docs_to_lines": LINES_SQL,
        "documents_of_language": "SELECT 'train' AS split, 'fr' AS source_name, doc_id AS doc, CAST(unnest(range(len(l))) AS INTEGER) AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE lang = 'fr')",
        "plaintext_clean": f"""WITH l AS ({LINES_SQL}), p AS (SELECT doc_id, pos, CASE WHEN pos % 5 = 0 THEN chr(8195) || ' ' || chr(9) ELSE chr(160) || chr(9) || line || ' ' || chr(8195) || chr(13) END AS t FROM l),
  s AS (SELECT doc_id, pos, regexp_replace(t, '^[{WHITE_SQL}]+|[{WHITE_SQL}]+$', '', 'g') AS text FROM p) SELECT * FROM s WHERE length(text) > 0""",
        "concat_sources": """SELECT 0 AS source_idx, 'documents' AS source_name, doc_id AS row_idx, text FROM documents
  UNION ALL SELECT 1, 'conversations', conv_id * 1000 + turn, text FROM conversations UNION ALL SELECT 2, 'benchmark', item_id, text FROM benchmark""",
        "split_fraction": f"WITH {SPLIT_SQL} SELECT * FROM s",
        "split_count": "SELECT doc_id AS row_id, CASE WHEN row_number() OVER (ORDER BY md5('1:split:all:' || doc_id), doc_id) <= 50 THEN 'dev' ELSE 'train' END AS split FROM documents",
        "alpha_probabilities": f"SELECT source, n, round(pow(n, CAST({ALPHA} AS DOUBLE)) / sum(pow(n, CAST({ALPHA} AS DOUBLE))) OVER (), 9) AS p FROM (SELECT lang AS source, count(*) AS n FROM documents GROUP BY lang)",
        "allocation": f"WITH {SPLIT_SQL}, {_alloc_sql(0.3, 'a')}, {_alloc_sql(0.7, 'b')}, {_alloc_sql(1.0, 'c')} " + " UNION ALL ".join(f"SELECT CAST({x} AS DOUBLE) AS alpha, source, train_rows, allocated FROM {n}" for n, x in (("a", 0.3), ("b", 0.7), ("c", 1.0))),
        "sample_without": f"{TRAIN_SQL} SELECT row_id, draw_idx FROM train WHERE source = 'en'",
        "sample_with": f"{TRAIN_SQL} SELECT source, row_id, draw_idx FROM train WHERE source <> 'en'",
        "multinomial_train": f"{TRAIN_SQL} SELECT * FROM train",
        "multinomial_dev": f"WITH {SPLIT_SQL} SELECT source, row_id FROM s WHERE split = 'dev'",
        "multinomial_report": report,
        "shuffle_order": f"{TRAIN_SQL} SELECT row_number() OVER (ORDER BY shuffle_key, source, row_id, draw_idx) AS rn, source, row_id FROM train",
        "vocab_subset": subset,
        "subset_jsonl": f"SELECT text FROM ({subset})",
        "token_counts": f"WITH {TOKENS_SQL} SELECT token, freq FROM c",
        "seed_vocab": f"WITH {TOKENS_SQL}, {REASON_SQL} SELECT token, freq FROM q WHERE reason IS NULL",
        "seed_reasons": f"WITH {TOKENS_SQL.replace('c AS', 'c0 AS', 1)}, c AS (SELECT * FROM c0 UNION ALL VALUES {', '.join(f"('{t}', {n})" for t, n in EXTRA)}), {REASON_SQL} SELECT reason, count(*) AS n FROM q WHERE reason IS NOT NULL GROUP BY reason",
        "seed_totals": f"WITH {TOKENS_SQL}, {REASON_SQL} SELECT count(*) AS n_tokens, CAST(sum(freq) AS BIGINT) AS total_freq FROM q WHERE reason IS NULL",
        "vocab_preview": f"WITH {TOKENS_SQL}, {REASON_SQL} SELECT token, freq FROM q WHERE reason IS NULL ORDER BY freq DESC, token LIMIT 20",
        "vocab_validation": f"WITH {TOKENS_SQL} SELECT count(*) AS n, count(DISTINCT id) AS ids, min(id) AS low, max(id) AS high FROM (SELECT row_number() OVER (ORDER BY freq DESC, token) - 1 AS id FROM c)",
        "vocab_overlap": f"""WITH d AS (SELECT DISTINCT lang, '▁' || unnest({WORDS_SQL}) AS token FROM documents), o AS (SELECT token FROM d WHERE lang = 'en'), w AS (SELECT token FROM d WHERE lang = 'fr'), i AS (SELECT * FROM o INTERSECT SELECT * FROM w)
SELECT (SELECT count(*) FROM o) AS old_size, (SELECT count(*) FROM w) AS new_size, (SELECT count(*) FROM i) AS shared, 100.0::DOUBLE * (SELECT count(*) FROM i) / (SELECT count(*) FROM w) AS percent_of_new""",
        "encode_truncate": f"WITH {e16} SELECT doc_id, array_to_string(x, ',') AS ids, CAST(len(x) AS INTEGER) AS n, array_to_string(list_transform(x, lambda v: 1), ',') AS mask FROM e",
        "collate_pad": f"""WITH {e16}, m AS (SELECT *, max(len(x)) OVER (PARTITION BY doc_id // 8) - len(x) AS f FROM e),
  r AS (SELECT doc_id, x, list_transform(range(f), lambda v: 1) AS one, f FROM m)
SELECT doc_id, array_to_string(list_concat(x, one), ',') AS input_ids, array_to_string(list_concat(x, list_transform(one, lambda v: -100)), ',') AS labels,
  array_to_string(list_concat(list_transform(x, lambda v: 1), list_transform(one, lambda v: 0)), ',') AS attention_mask FROM r""",
        "argmax": "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS best FROM embeddings",
        "distinct_all": _distinct_sql(""),
        "distinct_unmasked": _distinct_sql("", False),
        "distinct_by_lang": _distinct_sql("lang"),
        "runlog_union": f"WITH {LOG_SQL} SELECT run, step, view, NULL::DOUBLE AS click, error FROM g WHERE run = 'run0' UNION ALL SELECT run, step, NULL, click, error FROM g WHERE run = 'run1' UNION ALL SELECT run, step, NULL, NULL, error FROM g WHERE run = 'run2'",
        "runlog_list": "SELECT event_type AS metric, count(value) AS n FROM events WHERE NOT isnan(value) GROUP BY event_type HAVING count(value) > 0",
        "runlog_series": f"WITH {LOG_SQL} SELECT step, purchase, run FROM g WHERE purchase IS NOT NULL AND NOT isnan(purchase)",
        "runlog_melt": f"WITH {LOG_SQL} SELECT step, run, 'view' AS metric_name, view AS metric_value FROM g WHERE view IS NOT NULL UNION ALL SELECT step, run, 'error', error FROM g WHERE error IS NOT NULL",
        "runlog_runs": f"WITH {LOG_SQL} SELECT count(DISTINCT run) AS n_runs, count(DISTINCT run) > 1 AS several FROM g",
        "expand_patterns": """WITH m(name) AS (VALUES ('view'), ('signup'), ('purchase'), ('error'), ('click')), p(k, pat) AS (VALUES (0, 'p*'), (1, 'loss'), (2, '*i*'), (3, 'view'), (4, '[ce]*')),
  x AS (SELECT k, name FROM p JOIN m ON name GLOB pat WHERE k <> 1 UNION ALL SELECT 1, 'loss'), f AS (SELECT name, min(k) AS k FROM x GROUP BY name)
SELECT row_number() OVER (ORDER BY k, name) - 1 AS pos, name AS metric FROM f""",
        "divergence": f"WITH {LOSS_SQL} SELECT run, min(step) AS diverged_at FROM g WHERE loss <= 0 GROUP BY run",
        "early_stop": f"""WITH {LOSS_SQL}, b AS (SELECT *, min(loss) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM g),
  i AS (SELECT run, step, CASE WHEN best IS NULL OR loss < best THEN 1 ELSE 0 END AS up FROM b), l AS (SELECT *, sum(up) OVER (PARTITION BY run ORDER BY step ROWS UNBOUNDED PRECEDING) AS island FROM i WHERE step >= 200),
  m AS (SELECT *, sum(1 - up) OVER (PARTITION BY run, island ORDER BY step ROWS UNBOUNDED PRECEDING) AS misses FROM l) SELECT run, min(step) AS stop_step FROM m WHERE misses >= 3 GROUP BY run""",
        "unfreeze": f"WITH {LOSS_SQL} SELECT run, min(step) AS unfreeze_step, 'checkpoint-' || min(step) || '-before-unfreeze' AS checkpoint FROM g WHERE step >= 100 GROUP BY run",
        "freeze_prefix": "SELECT p_partkey, NOT starts_with(p_name, 'a') AS trainable FROM part",
        "cadence": "SELECT count(*) FILTER (event_id % 2 = 0) AS logged, count(*) FILTER (event_id % 10 = 0) AS evaluated FROM events",
        "format_number": f"SELECT o_orderkey, {num('(o_orderkey * 997)')} AS short FROM orders",
        "shortname": "SELECT s_suppkey, 'somemodelv' || s_suppkey || 'b' AS short, upper(substr(s_name, 1, 1)) || lower(substr(s_name, 2)) AS title FROM supplier",
        "artifact_suffix": f"""SELECT p_partkey, 'base15b_v' || {num('(p_partkey * 100)')} || '_s' || {num('(p_partkey * 5000)')} || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE '_no-additional' END
  || CASE WHEN p_partkey % 3 = 0 THEN '_seeded' || CASE WHEN p_partkey % 4 > 1 THEN '-min' || (p_partkey % 4) ELSE '' END || CASE WHEN p_partkey % 5 <> 0 THEN '' ELSE '-chars' END ELSE '' END AS suffix FROM part""",
        "path_parts": "SELECT page_id, CASE WHEN f LIKE '_%.%' THEN left(f, length(f) - strpos(reverse(f), '.')) ELSE f END AS stem, p[-3] AS above FROM (SELECT page_id, string_split(url, '/') AS p, string_split(url, '/')[-1] AS f FROM pages)",
        "config_diff": f"SELECT path, cached, current FROM ({flat(CONFIG_A, 'cached')}) FULL JOIN ({flat(CONFIG_B, 'current')}) USING (path) WHERE cached IS DISTINCT FROM current",
        "embed_overlap": "SELECT vec_id AS id, vec_id % 2 = 0 AS shared FROM embeddings",
        "embed_similarity": f"WITH {VEC_SQL} SELECT id, key, round(z, 6) AS z FROM z",
        "embed_sparsemax": f"WITH {MAX_SQL} SELECT id, key, round(weight, 6) AS weight FROM w",
        "embed_combine": f"WITH {MAX_SQL}, x AS (SELECT vec_id AS key, unnest(e) AS x, CAST(unnest(range(len(e))) AS INTEGER) AS pos FROM v) SELECT id, pos, round(sum(weight * x), 6) AS value FROM w JOIN x USING (key) GROUP BY id, pos",
        "embed_initialise": f"""WITH {MAX_SQL}, s AS (SELECT vec_id, list_sum(e) AS t, len(e) AS d FROM v) SELECT id, any_value(CAST(d AS INTEGER)) AS d, round(sum(weight * t), 5) AS total FROM w JOIN s ON vec_id = key GROUP BY id
  UNION ALL SELECT vec_id, CAST(d AS INTEGER), round(t, 5) FROM s WHERE vec_id % 2 = 0""",
    }


def queries():
    names = """docs_to_lines documents_of_language plaintext_clean concat_sources dir_sources split_fraction split_count alpha_probabilities allocation sample_without sample_with
    multinomial_train multinomial_dev multinomial_report shuffle_order vocab_subset subset_jsonl token_counts seed_vocab seed_reasons seed_totals vocab_preview vocab_validation
    vocab_overlap encode_truncate collate_pad token_id_counts tokenize_public argmax distinct_all distinct_unmasked distinct_by_lang runlog_union runlog_list runlog_series runlog_melt runlog_runs
    expand_patterns divergence early_stop unfreeze freeze_prefix cadence format_number shortname artifact_suffix path_parts config_diff embed_overlap embed_similarity embed_sparsemax
    embed_combine embed_initialise""".split()
    return {n: globals()[n] for n in names}
