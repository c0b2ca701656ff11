"""Source, sink and streaming queries.

Sinks write below the shared folder and the result is what reading back gives.
"""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from speechlake.functions import edits, text
from speechlake.operators import evaluation, lexicon, stats
from speechlake.operators.chunks import spread
from speechlake.operators.ordering import dense_index
from speechlake.plans.corpus import INTERVALS_SQL, PAIRS_SQL, SAMPLES_SQL, intervals, samples, table, turn_pairs
from speechlake.plans.manifests import SPLITS_SQL, split_table
from speechlake.plans.registry import query
from speechlake.plans.statistics import STATS_SQL
from speechlake.plans.texts import _RATES, _SCORED_SQL, _basic_sql
from speechlake.sources import arrayfiles, tables
from speechlake.sources.scratch import scratch_path, stored
from speechlake.streaming import moments, running


@query(
    "manifest_scan_s1",
    "SELECT DISTINCT lang AS data_type, source AS session, CAST(doc_id AS INT) AS data_num, 'emg' AS modality, true AS filled FROM documents",
)
def manifest_scan(spark, sf_dir):
    """Recordings written one file per number, listed again without reading them."""
    root = scratch_path(spark, "corpus")
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")
    path = F.format_string("%s/%s/data/emg/emg_%04d.npz", "lang", "source", "doc_id")
    arrayfiles.write_binary(docs.select(path.alias("path"), F.col("doc_id").cast("string").cast("binary").alias("content")), root)
    files = tables.scan_manifest(spark, root)
    return files.select("data_type", "session", "data_num", "modality", (F.col("length") > 0).alias("filled"))


@query("split_csv_s2", f"WITH {SPLITS_SQL} SELECT session, data_type, data_num, path, split FROM split_table")
def split_csv(spark, sf_dir):
    path = scratch_path(spark, "split")
    tables.write_split_csv(split_table(spark, sf_dir), path)
    return tables.read_split_csv(spark, path)


@query(
    "split_csv_sink_s9",
    f"WITH {SPLITS_SQL} SELECT session || ',' || data_type || ',' || data_num || ',' || path || ',' || split AS line FROM split_table",
)
def split_csv_sink(spark, sf_dir):
    """The lines of the written file without its header."""
    path = scratch_path(spark, "split")
    tables.write_split_csv(split_table(spark, sf_dir), path)
    lines = spark.read.text(path).select(F.col("value").alias("line"))
    return lines.where("line <> 'session,data_type,data_num,path,split'")


@query(
    "metadata_s3",
    f"""SELECT doc_id::VARCHAR || '.wav' AS id, {_basic_sql("regexp_replace(text, '[|\\n\\r]', ' ', 'g')")} AS text FROM documents""",
)
def metadata(spark, sf_dir):
    """Documents as ``id|text|normalised`` lines, some of them blank, read back as id
    and text; a document without a number has a name without one."""
    path = scratch_path(spark, "metadata")
    docs = table(spark, sf_dir, "documents")
    body = F.regexp_replace("text", r"[|\n\r]", " ")
    number = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    line = F.concat_ws("|", F.concat(F.lit("wavs/"), number, F.lit(".wav")), body, F.lower(body))
    docs.select(F.explode(F.array(line, F.lit(""))).alias("value")).write.text(path)
    return tables.metadata_texts(tables.read_metadata(spark, path)).withColumn("id", F.nullif("id", F.lit(".wav")))


@query(
    "phoneme_set_s5",
    f"""WITH {INTERVALS_SQL}, p AS (SELECT DISTINCT label AS phone FROM intervals)
    SELECT CAST(row_number() OVER (ORDER BY phone) - 1 AS INT) AS phone_id, phone FROM p
    UNION ALL SELECT count(*)::INT, 'sil' FROM p""",
)
def phoneme_set(spark, sf_dir):
    path = scratch_path(spark, "phonemes")
    tables.write_phoneme_set(intervals(spark, sf_dir).select(F.col("label").alias("phone")), path)
    return tables.read_phoneme_set(spark, path)


@query(
    "phoneme_set_sink_s13",
    f"""WITH {INTERVALS_SQL}, p AS (SELECT list_sort(list(DISTINCT label)) AS l FROM intervals)
    SELECT '{{"phonemes":["' || array_to_string(l, '","') || '"],"count":' || len(l) || '}}' AS value FROM p""",
)
def phoneme_set_sink(spark, sf_dir):
    path = scratch_path(spark, "phonemes")
    tables.write_phoneme_set(intervals(spark, sf_dir).select(F.col("label").alias("phone")), path)
    return spark.read.text(path)


@query("transcripts_s6", "SELECT text FROM conversations")
def transcripts(spark, sf_dir):
    path = scratch_path(spark, "transcripts")
    table(spark, sf_dir, "conversations").select("text", "role").write.json(path)
    return tables.read_transcripts(spark, path, multi_line=False).select("text")


@query("transcript_files_s6", "SELECT conv_id, max(turn) AS turns, arg_min(text, turn) AS text FROM conversations GROUP BY 1")
def transcript_files(spark, sf_dir):
    """One object over several lines per file; the key is in the name, a thousand files share a folder."""
    path = scratch_path(spark, "transcript-files")
    first = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("turns"), F.min_by("text", "turn").alias("text"))
    value = F.to_json(F.struct("text", "turns"), {"pretty": "true"}).alias("value")
    name = F.format_string("part=%d/conv_id=%d.json", F.floor(F.col("conv_id") / 1000), "conv_id")
    arrayfiles.write_binary(first.select(name.alias("path"), value.cast("binary").alias("content")), path)
    docs = tables.read_transcripts(spark, path, fields="text STRING, turns BIGINT", pattern="*.json")
    return docs.select(F.regexp_extract("path", r"conv_id=(-?\d+)\.json$", 1).cast("long").alias("conv_id"), "turns", "text")


def eval_rows(spark, sf_dir):
    """Scored pairs numbered in conversation order."""
    pairs = turn_pairs(spark, sf_dir)
    forms = evaluation.scored_forms(pairs, "prediction", "target")
    kept = forms.select("*", F.col("prediction").alias("p"), F.col("target").alias("t"))
    counts = evaluation.count_errors(kept, "p", "t")
    numbered = dense_index(counts, [], [F.col("conv_id"), F.col("turn")], F.col("conv_id"), "i")
    return numbered.withColumns({"session": F.concat(F.lit("c"), F.col("conv_id").cast("string")), "idx": F.col("turn").cast("string")})


_SQUEEZE = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
_NUMBERED_SQL = f"{_SCORED_SQL}, numbered AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn) - 1 AS i FROM coded)"


@query(
    "eval_log_s7",
    f"""WITH {_NUMBERED_SQL} SELECT i, 'c' || conv_id AS session, turn::VARCHAR AS idx, {_SQUEEZE.format('t')} AS target, {_SQUEEZE.format('p')} AS prediction FROM numbered""",
)
def eval_log(spark, sf_dir):
    """The evaluation report written as text and paired again."""
    path = scratch_path(spark, "log")
    lines = tables.eval_log_lines(eval_rows(spark, sf_dir))
    lines.repartitionByRange("i").sortWithinPartitions("i", "k").select("value").write.text(path)
    return tables.parse_eval_log(spark.read.text(path))


def _phones_sql(words: str) -> str:
    return f"array_to_string(list_transform({words}, lambda w: CASE WHEN list_contains(l, w) THEN translate(w, 'aeiou', 'AEIOU') ELSE w END), ' ')"


@query(
    "phoneme_error_rate_t17",
    f"""WITH {_SCORED_SQL}, known AS (
      SELECT list(DISTINCT w) AS l FROM (SELECT unnest(string_split({_basic_sql('strip_accents(text)')}, ' ')) AS w FROM benchmark) WHERE length(w) > 2),
    spoken AS (SELECT conv_id, turn, {_phones_sql('pw')} AS p, {_phones_sql('tw')} AS t FROM listed, known)
    SELECT CAST(conv_id % 16 AS INT) AS session, round(sum(levenshtein(p, t)) / sum(length(t)), 6) AS rate FROM spoken GROUP BY 1""",
)
def phoneme_error_rate(spark, sf_dir):
    """Both texts of a pair pronounced by the lexicon of another corpus; words it lacks keep their letters."""
    forms = evaluation.scored_forms(turn_pairs(spark, sf_dir), "prediction", "target")
    listed = table(spark, sf_dir, "benchmark").select(F.explode(F.split(text.normalize_basic(text.fold_accents(F.col("text"))), " ")).alias("word"))
    known = listed.where(F.length("word") > 2).distinct().withColumn("phones", F.translate("word", "aeiou", "AEIOU"))
    spoken = lexicon.pronounce(forms, ["conv_id", "turn"], ["prediction", "target"], known)
    by = spoken.withColumn("session", (F.col("conv_id") % 16).cast("int"))
    rates = evaluation.symbol_error_rate(by, "prediction", "target", "session")
    return rates.select("session", F.round("rate", 6).alias("rate"))


@F.pandas_udf(T.BinaryType())
def _npz(x: pd.Series) -> pd.Series:
    def pack(row) -> bytes:
        out = io.BytesIO()
        np.savez(out, data=np.asarray(row, dtype=np.float32).reshape(-1, 8))
        return out.getvalue()

    return x.map(pack)


@F.pandas_udf(T.BinaryType())
def _wav(x: pd.Series) -> pd.Series:
    def pack(row) -> bytes:
        out = io.BytesIO()
        with wave.open(out, "wb") as sound:
            sound.setnchannels(2)
            sound.setsampwidth(2)
            sound.setframerate(16000)
            sound.writeframes((np.asarray(row) * 32768).astype("<i2").tobytes())
        return out.getvalue()

    return x.map(pack)


@query(
    "array_ingest_s8",
    """WITH d AS (SELECT vec_id, unnest(range(64)) AS i, embedding FROM embeddings)
    SELECT vec_id, (i // 8)::INT AS t, (i % 8)::INT AS ch, round(embedding[i + 1]::DOUBLE, 6) + 0.0::DOUBLE AS value FROM d""",
)
def array_ingest(spark, sf_dir):
    """Array files of 64 vectors, written by tasks, listed and decoded to a stored
    table; a vector is 8 steps of 8 channels."""
    blocks, names = _blocks(spark, sf_dir)
    root = scratch_path(spark, "array-files")
    arrayfiles.write_binary(blocks.select(F.format_string("block=%d/data.npz", "block").alias("path"), _npz("x").alias("content")), root)
    rows = stored(arrayfiles.decode_arrays(arrayfiles.read_binary(spark, root, "*.npz")), "decoded-arrays")
    placed = rows.select(_block_of("path"), F.floor(F.col("t") / 8).cast("int").alias("place"), (F.col("t") % 8).cast("int").alias("t"), "x")
    long = placed.join(names, ["block", "place"]).select("vec_id", "t", F.posexplode_outer("x").alias("ch", "value"))
    return long.withColumn("value", F.round("value", 6) + F.lit(0.0))


def _blocks(spark, sf_dir):
    """``block, x``: 64 vectors at most, one after the other; ``block, place, vec_id``."""
    vectors = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 64).alias("block"), "vec_id", F.col("embedding").cast("array<double>").alias("x"))
    grouped = stored(vectors.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("vec_id", "x"))).alias("v")), "vector-blocks")
    return grouped.select("block", F.flatten("v.x").alias("x")), grouped.select("block", F.posexplode_outer("v.vec_id").alias("place", "vec_id"))


def _block_of(path):
    return F.regexp_extract(path, r"block=(\d+)/", 1).cast("long").alias("block")


@query(
    "sound_ingest_s8",
    """WITH d AS (SELECT vec_id, unnest(range(64)) AS i, embedding FROM embeddings)
    SELECT vec_id, 16000 AS rate, (i // 2)::INT AS t, (i % 2)::INT AS ch,
      round(trunc(embedding[i + 1]::DOUBLE * 32768) / 32768.0::DOUBLE, 9) + 0.0::DOUBLE AS value FROM d""",
)
def sound_ingest(spark, sf_dir):
    """Two-channel sound files of 64 vectors, written, listed and decoded likewise."""
    blocks, names = _blocks(spark, sf_dir)
    root = scratch_path(spark, "sound-files")
    arrayfiles.write_binary(blocks.select(F.format_string("block=%d/sound.wav", "block").alias("path"), _wav("x").alias("content")), root)
    rows = stored(arrayfiles.decode_wav(arrayfiles.read_binary(spark, root, "*.wav"), 16000), "decoded-sound")
    t = F.col("t")
    placed = rows.select(_block_of("path"), F.floor(t / 32).cast("int").alias("place"), "rate", (t % 32).cast("int").alias("t"), "ch", "value")
    return placed.join(names, ["block", "place"]).select("vec_id", "rate", "t", "ch", (F.round("value", 9) + F.lit(0.0)).alias("value"))


@query(
    "normaliser_store_s10",
    f"WITH {STATS_SQL} SELECT dim, n, round(mean, 6) + 0.0::DOUBLE AS mean, round(std, 6) AS std FROM st",
)
def normaliser_store(spark, sf_dir):
    """Computed and stored once; the second request reads the stored table."""
    path = scratch_path(spark, "normaliser")
    compute = lambda: stats.dim_moments(table(spark, sf_dir, "embeddings"), "embedding")
    tables.stored_or_computed(spark, path, compute)
    again = tables.stored_or_computed(spark, path, lambda: stats.dim_moments(table(spark, sf_dir, "embeddings").limit(0), "embedding"))
    return again.select("dim", "n", (F.round("mean", 6) + F.lit(0.0)).alias("mean"), F.round("std", 6).alias("std"))


@query(
    "feature_sink_s11",
    f"WITH {SPLITS_SQL} SELECT split, data_type, session, count(*) AS n, sum(data_num)::BIGINT AS total FROM split_table GROUP BY 1, 2, 3",
)
def feature_sink(spark, sf_dir):
    """Partitioned features, read back split by split: each read touches only its folders."""
    path = scratch_path(spark, "features")
    tables.write_features(split_table(spark, sf_dir), path)
    read = spark.read.parquet(path)
    rows = read.where("split = 'train'").union(read.where("split = 'valid'")).union(read.where("split = 'test'"))
    return rows.groupBy("split", "data_type", "session").agg(F.count(F.lit(1)).alias("n"), F.sum("data_num").alias("total"))


@query(
    "result_table_s14",
    f"""WITH {_SCORED_SQL} SELECT 'run' || conv_id % 3 AS exp_name, 59 AS ckpt_epoch, CASE WHEN turn < 2 THEN 'valid' ELSE 'test' END AS split,
      CAST(printf('%.2f', sum(char_err) / sum(char_len) * 100) AS DOUBLE) AS cer, CAST(printf('%.2f', sum(char_ns_err) / sum(char_ns_len) * 100) AS DOUBLE) AS cer_wo_space,
      CAST(printf('%.2f', sum(word_err) / sum(word_len) * 100) AS DOUBLE) AS wer FROM counts GROUP BY 1, 2, 3""",
)
def result_table(spark, sf_dir):
    """Rates of each run and split appended to one table, split by split."""
    path = scratch_path(spark, "results")
    counts = evaluation.error_counts(turn_pairs(spark, sf_dir)).select(
        "*", F.concat(F.lit("run"), (F.col("conv_id") % 3).cast("string")).alias("exp_name"),
        F.when(F.col("turn") < 2, "valid").otherwise("test").alias("split"),
    )
    rates = evaluation.error_rates(counts, "exp_name", "split").withColumn("ckpt_epoch", F.lit(59))
    for split in ("valid", "test"):
        tables.append_results(rates.where(F.col("split") == split), path)
    return tables.read_results(spark, path)


def _event_files(spark, sf_dir, label):
    """The events as several arriving files, in time order."""
    path = scratch_path(spark, label)
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartitionByRange(3, "ts").write.parquet(path)
    return path, events.schema


@query(
    "running_moments_x1",
    """SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(greatest(stddev_pop(value), 1e-8), 6) AS std FROM events GROUP BY 1""",
)
def running_moments(spark, sf_dir):
    path, schema = _event_files(spark, sf_dir, "events")
    made = running.run_updated(running.running_moments(running.file_stream(spark, path, schema), "event_type", "value"), ["event_type"], "moments")
    return made.select("event_type", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(
    "running_rates_x2",
    f"WITH {_SCORED_SQL} SELECT CAST(conv_id % 4 AS INT) AS session, CAST(sum(char_err) AS BIGINT) AS err, CAST(sum(char_len) AS BIGINT) AS len FROM counts GROUP BY 1",
)
def running_rates(spark, sf_dir):
    """Predictions arrive as files, as many as there are tasks, and are scored in the stream."""
    path = scratch_path(spark, "predictions")
    pairs = spread(turn_pairs(spark, sf_dir).select("conv_id", "turn", (F.col("conv_id") % 4).cast("int").alias("session"), "prediction", "target"), "conv_id", "turn")
    pairs.write.parquet(path)
    # Few bytes are much work: a task that reads several files deals their pairs out again.
    scored = evaluation.error_counts(spread(running.file_stream(spark, path, pairs.schema), "conv_id", "turn"))
    sums = running.running_rates(scored.select("session", F.col("char_err").alias("err"), F.col("char_len").alias("len")), "session")
    return running.run_updated(sums, ["session"], "rates")


@query(
    "daily_rates_x2",
    """WITH d AS (SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) FILTER (value > 100) AS err, count(*) AS len FROM events GROUP BY 1, 2)
    SELECT strftime(day, '%Y-%m-%d') AS day, event_type, err, len FROM d WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""",
)
def daily_rates(spark, sf_dir):
    """Only days the watermark has closed are final; the files arrive together, so none is late."""
    path, schema = _event_files(spark, sf_dir, "events")
    stream = running.file_stream(spark, path, schema, files_per_batch=1000).select(
        "ts", "event_type", (F.col("value") > 100).cast("long").alias("err"), F.lit(1).cast("long").alias("len")
    )
    made = running.run_append(running.daily_rates(stream, "ts", "event_type", "1 hour"), "daily")
    return made.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type", "err", "len")


@query(
    "vector_moments_x1",
    """WITH v AS (SELECT label, d AS dim, embedding[d + 1]::DOUBLE AS x FROM embeddings, (SELECT unnest(range(64))::INT AS d))
    SELECT label, dim, count(*) AS n, round(avg(x), 6) + 0.0::DOUBLE AS mean, round(var_pop(x) * count(*), 6) AS m2,
      round(greatest(stddev_pop(x), 1e-8), 6) AS std FROM v GROUP BY 1, 2""",
)
def vector_moments(spark, sf_dir):
    """Whole vectors arrive in two lots of two files, one file a micro-batch; the
    stream is stopped between the lots and goes on from its state."""
    path, out = scratch_path(spark, "vectors"), scratch_path(spark, "vector-moments")
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    for lot in range(2):
        vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(2)) == lot).repartitionByRange(2, "vec_id").write.mode("append").parquet(path)
        files = len(spark.read.parquet(path).inputFiles()) // (2 * (lot + 1))
        stream = running.file_stream(spark, path, vectors.schema, files_per_batch=max(files, 1))
        found = running.run_updated(moments.vector_moments(stream, "label", "embedding"), ["key"], "vector-moments", out)
    rows = moments.per_dimension(found)
    r6 = lambda c: (F.round(c, 6) + 0.0).alias(c)
    return rows.select(F.col("key").alias("label"), "dim", "n", r6("mean"), F.round("m2", 6).alias("m2"), r6("std"))


@query(
    "paired_rates_x2",
    f"""WITH {_SCORED_SQL} SELECT CAST(conv_id % 4 AS INT) AS session, CAST(sum(char_err) AS BIGINT) AS err, CAST(sum(char_len) AS BIGINT) AS len,
      count(*) AS pairs FROM counts WHERE conv_id % 10 <> 9 GROUP BY 1""",
)
def paired_rates(spark, sf_dir):
    """Predictions and targets arrive apart, in lots; the stream is stopped after each.

    Conversations 0-3 of ten come first, then 4-7 with every third prediction of
    the first lot once more, then two lots of number 8 hours later. Number 9 is
    as old as the first lot and arrives last, after the watermark: it is dropped.
    """
    keys, out = ["conv_id", "turn"], scratch_path(spark, "paired-rates")
    both = turn_pairs(spark, sf_dir)
    digit, minute = F.col("conv_id") % 10, F.col("turn") % 60
    hour = lambda h: F.timestamp_seconds(F.lit(1_600_000_000 + 3600 * h) + 60 * minute)
    lots = [
        (digit < 4, F.lit(False), hour(0)),
        ((digit >= 4) & (digit < 8), (digit < 4) & (F.col("conv_id") % 3 == 0), F.when(digit < 4, hour(0)).otherwise(hour(1))),
        ((digit == 8) & (F.col("turn") % 4 < 2), F.lit(False), hour(12)),
        ((digit == 8) & (F.col("turn") % 4 >= 2), F.lit(False), hour(13)),
        (digit == 9, F.lit(False), hour(0)),
    ]
    paths = [scratch_path(spark, side) for side in ("arriving-predictions", "arriving-targets")]
    for fresh, again, ts in lots:
        both.where(fresh | again).select(*keys, "prediction", ts.alias("ts")).write.mode("append").parquet(paths[0])
        both.where(fresh).select(*keys, "target", ts.alias("ts")).write.mode("append").parquet(paths[1])
        sides = [running.file_stream(spark, p, spark.read.parquet(p).schema) for p in paths]
        scored = evaluation.error_counts(running.paired(*sides, keys, "ts", "2 hours", "1 hour"))
        rows = scored.select(
            (F.col("conv_id") % 4).cast("int").alias("session"), F.col("char_err").alias("err"), F.col("char_len").alias("len"), F.lit(1).alias("pairs")
        )
        found = running.run_summed(rows, ["session"], ["err", "len", "pairs"], "paired-rates", out)
    return found
