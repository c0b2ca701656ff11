"""Manifest, lookup and run-selection queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechlake.operators import manifest as m
from speechlake.plans.corpus import RECORDINGS_SQL, recordings, table
from speechlake.plans.registry import query
from speechlake.sources.scratch import stored

RATIO = (0.85, 0.075, 0.075)


def assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split of every silent key; the keys are stored because ranking reads them several times."""
    keys = recordings(spark, sf_dir).where("data_type = 'silent'").select(*m.KEY).distinct()
    return m.assign_splits(stored(keys, "keys"), RATIO)


def split_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.split_manifest(recordings(spark, sf_dir), assigned(spark, sf_dir))


SPLITS_SQL = (
    RECORDINGS_SQL
    + """, ranked AS (
  SELECT session, data_num, row_number() OVER (PARTITION BY session
           ORDER BY md5('42|' || session || '|' || data_num), data_num) - 1 AS r, count(*) OVER (PARTITION BY session) AS n
  FROM (SELECT DISTINCT session, data_num FROM recordings WHERE data_type = 'silent')),
cuts AS (
  SELECT *, CAST(round_even(n * 0.85::DOUBLE, 0) AS BIGINT) AS tr, CAST(round_even(n * 0.075::DOUBLE, 0) AS BIGINT) AS va FROM ranked),
splits AS (
  SELECT session, data_num, CASE WHEN r < tr THEN 'train'
    WHEN r < tr + CASE WHEN tr + va > n THEN greatest(0, n - tr) ELSE va END THEN 'valid' ELSE 'test' END AS split
  FROM cuts),
split_table AS (SELECT session, data_type, data_num, path, split FROM recordings JOIN splits USING (session, data_num))"""
)


@query("seeded_split_l1", f"WITH {SPLITS_SQL} SELECT * FROM splits")
def seeded_split(spark, sf_dir):
    return assigned(spark, sf_dir)


@query("paired_modality_j1", f"WITH {SPLITS_SQL} SELECT * FROM split_table")
def paired_modality(spark, sf_dir):
    return split_table(spark, sf_dir)


@query(
    "unmatched_report_j2",
    f"""WITH {RECORDINGS_SQL} SELECT session, data_num FROM recordings r WHERE data_type = 'silent' AND NOT EXISTS
    (SELECT 1 FROM recordings v WHERE v.data_type = 'voiced' AND v.session = r.session AND v.data_num = r.data_num)""",
)
def unmatched_report(spark, sf_dir):
    recs = recordings(spark, sf_dir)
    silent = recs.where("data_type = 'silent'").select(*m.KEY)
    return m.unmatched(silent, recs.where("data_type = 'voiced'"), m.KEY)


@query(
    "mandatory_lookup_j3",
    f"""WITH {RECORDINGS_SQL} SELECT s.session, s.data_num, s.data_type, s.path, d.lang
    FROM recordings s JOIN documents d ON d.source = s.session AND d.doc_id = s.data_num""",
)
def mandatory_lookup(spark, sf_dir):
    """The transcript's language of every recording; one without a transcript is an error."""
    recs = recordings(spark, sf_dir)
    spoken = table(spark, sf_dir, "documents").select(
        F.col("source").alias("session"), F.col("doc_id").cast("int").alias("data_num"), "lang"
    )
    return m.mandatory_lookup(recs, spoken, m.KEY, "lang")


@query(
    "optional_lookup_j4",
    f"""WITH {RECORDINGS_SQL}, v AS (SELECT session, data_num, min(path) AS voiced_path FROM recordings
      WHERE data_type = 'voiced' GROUP BY 1, 2)
    SELECT s.session, s.data_num, coalesce(v.voiced_path, '') AS voiced_path
    FROM recordings s LEFT JOIN v USING (session, data_num) WHERE s.data_type = 'silent'""",
)
def optional_lookup(spark, sf_dir):
    recs = recordings(spark, sf_dir)
    silent = recs.where("data_type = 'silent'").select(*m.KEY)
    voiced = m.first_path(recs.where("data_type = 'voiced'"), m.KEY).withColumnRenamed("path", "voiced_path")
    return m.optional_lookup(silent, voiced, m.KEY, "voiced_path", F.lit(""))


@query(
    "first_path_j5",
    f"WITH {RECORDINGS_SQL} SELECT data_type, session, data_num, min(path) AS path FROM recordings GROUP BY 1, 2, 3",
)
def first_path(spark, sf_dir):
    return m.first_path(recordings(spark, sf_dir), ["data_type", *m.KEY])


@query(
    "priority_lookup_j6",
    """WITH c AS (
      SELECT doc_id, 0 AS priority, 'text/' || source || '/' || doc_id || '.npz' AS path FROM documents JOIN labels USING (doc_id) WHERE quality = 1
      UNION ALL SELECT doc_id, 1, 'info/' || source || '/' || doc_id || '_info.json' FROM documents WHERE doc_id % 3 = 0
      UNION ALL SELECT doc_id, 2, 'any/' || lang || '/' || doc_id || '_info.json' FROM documents WHERE doc_id % 5 < 2
      UNION ALL SELECT doc_id, 2, 'any/' || source || '/' || doc_id || '_info.json' FROM documents WHERE doc_id % 5 < 2)
    SELECT doc_id, CAST(priority AS INT) AS priority, path FROM c
    QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY priority, path) = 1""",
)
def priority_lookup(spark, sf_dir):
    """Ground-truth file of every document: array file, then sidecar, then any match."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    labels = table(spark, sf_dir, "labels").where("quality = 1")
    place = lambda rel, priority, top, folder, end: rel.select(
        "doc_id",
        F.lit(priority).alias("priority"),
        F.concat(F.lit(top), F.col(folder), F.lit("/"), F.col("doc_id").cast("string"), F.lit(end)).alias("path"),
    )
    loose = docs.where("doc_id % 5 < 2")
    candidates = (
        place(docs.join(labels, "doc_id", "left_semi"), 0, "text/", "source", ".npz")
        .unionByName(place(docs.where("doc_id % 3 = 0"), 1, "info/", "source", "_info.json"))
        .unionByName(place(loose, 2, "any/", "lang", "_info.json"))
        .unionByName(place(loose, 2, "any/", "source", "_info.json"))
    )
    return m.first_of_candidates(candidates, ["doc_id"])


@query(
    "ambiguous_match_j14",
    f"""WITH {RECORDINGS_SQL} SELECT data_type, session, data_num, min(path) AS path, count(*) AS n
    FROM recordings GROUP BY 1, 2, 3 HAVING count(*) > 1""",
)
def ambiguous_match(spark, sf_dir):
    return m.ambiguous_matches(recordings(spark, sf_dir), ["data_type", *m.KEY])


@query("split_filter_p1", f"WITH {SPLITS_SQL} SELECT * FROM split_table WHERE split IN ('valid', 'test')")
def split_filter(spark, sf_dir):
    return m.filter_split(split_table(spark, sf_dir), "valid, test")


@query(
    "training_view_p2", f"WITH {SPLITS_SQL} SELECT * FROM split_table WHERE split = 'train' OR data_type = 'silent'"
)
def training_view(spark, sf_dir):
    return m.training_view(split_table(spark, sf_dir))


@query(
    "conditional_filter_p3",
    f"""WITH {SPLITS_SQL} SELECT 'silent' AS asked, * FROM split_table WHERE data_type = 'silent'
    UNION ALL SELECT 'whispered', * FROM split_table""",
)
def conditional_filter(spark, sf_dir):
    splits = split_table(spark, sf_dir)
    asked = lambda kind: m.prefer_type(splits, kind).withColumn("asked", F.lit(kind))
    return asked("silent").unionByName(asked("whispered"))


@query(
    "hierarchical_filter_p4",
    f"""WITH {RECORDINGS_SQL} SELECT session, data_num, path FROM recordings
    WHERE session IN ('src1', 'src7', 'src12') AND NOT contains(path, 'silent/')""",
)
def hierarchical_filter(spark, sf_dir):
    kept = m.matching(recordings(spark, sf_dir), sessions=["src1", "src7", "src12"], exclude="silent/")
    return kept.select("session", "data_num", "path")


@query(
    "path_keys_p5",
    """WITH p AS (SELECT page_id, string_split(split_part(split_part(url, '?', 1), '#', 1), '/') AS parts FROM pages)
    SELECT page_id, parts[-2] AS session, parts[-3] AS data_type,
           coalesce(parts[-4], '') AS split, split_part(parts[-1], '_', 1) AS idx,
           TRY_CAST(nullif(regexp_extract(parts[-1], '([0-9]+)[^0-9]*$', 1), '') AS INT) AS num FROM p""",
)
def path_keys(spark, sf_dir):
    """Keys read from the components of page addresses."""
    pages = table(spark, sf_dir, "pages").select(
        "page_id", F.substring_index(F.substring_index("url", "?", 1), "#", 1).alias("path")
    )
    keys = m.keys_from_feature_path(pages)
    num = F.regexp_extract(m.path_part(F.col("path"), 1), r"(\d+)\D*$", 1).try_cast("int")
    return keys.select("page_id", "session", "data_type", F.coalesce("split", F.lit("")).alias("split"), "idx", num.alias("num"))


@query(
    "wav_keys_p5",
    f"""WITH {RECORDINGS_SQL} SELECT data_type, session, data_num, data_num::VARCHAR AS idx FROM recordings""",
)
def wav_keys(spark, sf_dir):
    """Keys of evaluation files named after type, session and number."""
    named = recordings(spark, sf_dir).select(
        "data_num", F.format_string("wavs/%s/%s_%d.wav", "data_type", "session", "data_num").alias("path")
    )
    return m.keys_from_wav_name(named).select("data_type", "session", "data_num", "idx")


@query(
    "output_paths_p10",
    f"""WITH {RECORDINGS_SQL} SELECT path, regexp_replace(replace(path, '/emg/', '/emg_features/'), '\\.npz$', '.npy') AS feature_path,
      session || '/data/textgrid/tg_' || printf('%04d', data_num) || '.TextGrid' AS grid_path
    FROM recordings""",
)
def output_paths(spark, sf_dir):
    return recordings(spark, sf_dir).select(
        "path",
        m.swap_component(F.col("path"), "emg", "emg_features", ("npz", "npy")).alias("feature_path"),
        m.textgrid_path(F.col("session"), F.col("data_num")).alias("grid_path"),
    )


@query(
    "split_counts_a1",
    f"""WITH {SPLITS_SQL} SELECT session, split, CAST(grouping(session, split) AS INT) AS level, count(*) AS n
    FROM split_table GROUP BY GROUPING SETS ((session, split), (session), (split))""",
)
def split_counts(spark, sf_dir):
    return m.split_counts(split_table(spark, sf_dir))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkpoint files of experiments; the customer decides which name styles exist."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    epoch, score = F.col("o_orderkey") % 100, (F.col("o_orderkey") * 7919 % 10007) / 10007
    style = F.greatest(F.col("o_orderkey") % 4, F.col("o_custkey") % 4)
    name = (
        F.when(style == 0, F.format_string("%02d-%.4f.ckpt", epoch, score))
        .when(style == 1, F.format_string("epoch=%02d-val_phone_accuracy=%.4f_%d.ckpt", epoch, score, "o_orderkey"))
        .when(style == 2, F.format_string("epoch=%02d-val_loss=%.4f_%d.ckpt", epoch, score, "o_orderkey"))
        .otherwise(F.lit("last.ckpt"))
    )
    exp = F.concat(F.lit("exp"), F.col("o_custkey").cast("string"))
    return o.select(exp.alias("exp_name"), F.concat(F.lit("runs/"), exp, F.lit("/"), name).alias("path"))


RUNS_SQL = """runs AS (
  SELECT 'exp' || o_custkey AS exp_name, 'runs/exp' || o_custkey || '/' || CASE greatest(o_orderkey % 4, o_custkey % 4)
      WHEN 0 THEN printf('%02d-%.4f.ckpt', o_orderkey % 100, (o_orderkey * 7919 % 10007) / 10007)
      WHEN 1 THEN printf('epoch=%02d-val_phone_accuracy=%.4f_%d.ckpt', o_orderkey % 100, (o_orderkey * 7919 % 10007) / 10007, o_orderkey)
      WHEN 2 THEN printf('epoch=%02d-val_loss=%.4f_%d.ckpt', o_orderkey % 100, (o_orderkey * 7919 % 10007) / 10007, o_orderkey)
      ELSE 'last.ckpt' END AS path
  FROM orders), named AS (SELECT *, string_split(path, '/')[-1] AS name FROM runs),
scores AS (
  SELECT exp_name, path, 0 AS tier, TRY_CAST(regexp_extract(name, '^([0-9]+)-([-+0-9.eE]+)\\.ckpt$', 2) AS DOUBLE) AS score FROM named
  UNION ALL SELECT exp_name, path, 1, TRY_CAST(regexp_extract(name, '^epoch=.*val_phone_accuracy=([-+0-9.eE]+)', 1) AS DOUBLE) FROM named
  UNION ALL SELECT exp_name, path, 2, -TRY_CAST(regexp_extract(name, '^epoch=.*val_loss=([-+0-9.eE]+)', 1) AS DOUBLE) FROM named),
valid AS (SELECT * FROM scores WHERE score IS NOT NULL)"""


@query(
    "best_run_a13",
    f"""WITH {RUNS_SQL}, best AS (SELECT exp_name, path FROM valid
      QUALIFY row_number() OVER (PARTITION BY exp_name ORDER BY tier, score DESC, path) = 1)
    SELECT e.exp_name, best.path FROM (SELECT DISTINCT exp_name FROM runs) e LEFT JOIN best USING (exp_name)""",
)
def best_run(spark, sf_dir):
    return m.best_run(runs(spark, sf_dir))


@query(
    "latest_run_a14",
    f"""WITH {RUNS_SQL} SELECT exp_name, coalesce(max(path) FILTER (starts_with(name, 'epoch=')), '') AS path
    FROM named GROUP BY 1""",
)
def latest_run(spark, sf_dir):
    return m.latest_run(runs(spark, sf_dir), "epoch=", missing="")


@query(
    "keep_best_l3",
    f"""WITH {RUNS_SQL} SELECT exp_name, path, round(score, 4) AS score FROM valid WHERE tier = 0
    QUALIFY row_number() OVER (PARTITION BY exp_name ORDER BY score DESC, path) <= 3""",
)
def keep_best(spark, sf_dir):
    scored = m.run_metrics(runs(spark, sf_dir)).where("tier = 0").select("exp_name", "path", "score")
    return m.keep_best(scored, "exp_name", "score", 3).withColumn("score", F.round("score", 4))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    labels = table(spark, sf_dir, "labels")
    status = F.when(F.col("quality").isNull(), "failed").when(F.col("quality") == 1, "changed").otherwise("skipped")
    return docs.join(labels, "doc_id", "left").select(
        F.col("source").alias("session"),
        m.textgrid_path(F.col("source"), F.col("doc_id")).alias("path"),
        status.alias("status"),
    )


JOBS_SQL = """jobs AS (
  SELECT source AS session, source || '/data/textgrid/tg_' || printf('%04d', doc_id) || '.TextGrid' AS path,
         CASE WHEN quality IS NULL THEN 'failed' WHEN quality = 1 THEN 'changed' ELSE 'skipped' END AS status
  FROM documents LEFT JOIN labels USING (doc_id))"""


@query(
    "outcome_counts_a15",
    f"""WITH {JOBS_SQL} SELECT session, count(*) AS scanned, count(*) FILTER (status <> 'failed') AS parsed,
      count(*) FILTER (status = 'changed') AS changed, count(*) FILTER (status = 'skipped') AS skipped,
      count(*) FILTER (status = 'failed') AS failed FROM jobs GROUP BY ROLLUP (session)""",
)
def outcome_counts(spark, sf_dir):
    return m.outcome_counts(jobs(spark, sf_dir))


@query(
    "outcome_examples_a15",
    f"""WITH {JOBS_SQL} SELECT *, CAST(row_number() OVER (PARTITION BY status ORDER BY path) AS INT) AS rank FROM jobs
    QUALIFY rank <= 20""",
)
def outcome_examples(spark, sf_dir):
    return m.outcome_examples(jobs(spark, sf_dir), 20)


@query(
    "ordered_limit_l2",
    f"WITH {RECORDINGS_SQL} SELECT path FROM recordings WHERE data_type = 'voiced' ORDER BY path LIMIT 100",
)
def ordered_limit(spark, sf_dir):
    """The first 100 evaluated files: the filter comes before the limit."""
    return recordings(spark, sf_dir).where("data_type = 'voiced'").select("path").orderBy("path").limit(100)


@query(
    "candidate_union_l4",
    f"""WITH {RECORDINGS_SQL} SELECT path FROM recordings WHERE path LIKE '%7.npz'
    UNION SELECT path FROM recordings WHERE path LIKE '%silent/src1%'""",
)
def candidate_union(spark, sf_dir):
    recs = recordings(spark, sf_dir).select("path")
    return recs.where("path like '%7.npz'").union(recs.where("path like '%silent/src1%'")).distinct().orderBy("path")


@query(
    "fallback_relation_l5",
    f"WITH {RECORDINGS_SQL} SELECT path FROM recordings WHERE data_type = 'silent'",
)
def fallback_relation(spark, sf_dir):
    """Whispered recordings if there are any, else silent ones, else all."""
    recs = recordings(spark, sf_dir)
    return m.fallback_relation(
        recs.where("data_type = 'whispered'").select("path"), recs.where("data_type = 'silent'").select("path"), recs.select("path")
    )


@query(
    "difference_l6",
    f"""WITH {RECORDINGS_SQL} SELECT session, data_num FROM recordings WHERE data_type = 'voiced'
    EXCEPT SELECT session, data_num FROM recordings WHERE data_type = 'silent'""",
)
def difference(spark, sf_dir):
    recs = recordings(spark, sf_dir)
    keys = lambda kind: recs.where(F.col("data_type") == kind).select(*m.KEY)
    return keys("voiced").subtract(keys("silent"))


@query(
    "pending_work_s15",
    """SELECT doc_id FROM documents WHERE doc_id NOT IN (
      SELECT d.doc_id FROM documents d JOIN labels l USING (doc_id) WHERE d.n_chars * l.quality > 0)""",
)
def pending_work(spark, sf_dir):
    """Documents whose output is missing or empty; quality 0 stands for an empty file."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    outputs = docs.join(table(spark, sf_dir, "labels"), "doc_id").select(
        "doc_id", (F.col("n_chars") * F.col("quality")).alias("length")
    )
    return m.pending(docs.select("doc_id"), outputs, ["doc_id"])


@query(
    "neighbour_lookup_w28",
    f"""WITH {RECORDINGS_SQL}, s AS (SELECT session, data_num, path FROM recordings WHERE data_type = 'silent')
    SELECT s.session, s.data_num, b.path AS before, a.path AS after FROM s
    LEFT JOIN s b ON b.session = s.session AND b.data_num = s.data_num - 20
    LEFT JOIN s a ON a.session = s.session AND a.data_num = s.data_num + 20""",
)
def neighbour_lookup(spark, sf_dir):
    """Paths of the neighbouring numbers; a session owns every twentieth document."""
    silent = recordings(spark, sf_dir).where("data_type = 'silent'")
    numbered = silent.select(
        "session", (F.col("data_num") % 20).alias("slot"), F.floor(F.col("data_num") / 20).cast("int").alias("num"), "path"
    )
    near = m.neighbours(numbered, ["session", "slot"], "num", "path")
    return near.select("session", (F.col("num") * 20 + F.col("slot")).cast("int").alias("data_num"), "before", "after")
