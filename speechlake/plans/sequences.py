"""Sequence, alignment, augmentation and batch queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechlake.functions import arrays
from speechlake.operators import batches as b
from speechlake.operators import intervals as iv
from speechlake.operators import sequences as q
from speechlake.operators import signals as s
from speechlake.operators import stats, training
from speechlake.operators.ordering import dense_index
from speechlake.plans.annotations import FRAME_LABELS_SQL, RATE
from speechlake.plans.corpus import PHONES, SAMPLES_SQL, SIGNAL_SQL, SILENCE, intervals_of, samples, signal, table
from speechlake.plans.registry import query
from speechlake.plans.signals import MEL, _mel_sql, r, rsql
from speechlake.sources.scratch import stored

KEYS = ["utt", "ch"]
SEED = 42
FRAME_RATE, VIDEO_FPS = 2.0, 0.5  # scaled down with the short utterances; the ratio stays 4


def _hash_sql(x: str) -> str:
    return f"('0x' || substr(md5('{SEED}|' || {x}), 1, 8))::BIGINT"


def first_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).select("utt", "t", "value")


def lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modality lengths of every utterance; even ones are silent, the next is their voiced partner."""
    t, k = F.col("t"), F.col("k")
    sizes = samples(spark, sf_dir).groupBy("utt").agg(
        F.count_if(t % 4 == 0).cast("int").alias("speech_len"),
        F.count_if((t % 4 == 0) & (t > 0)).cast("int").alias("phone_len"),
        F.count(F.lit(1)).cast("int").alias("emg_len"),
        F.count_if((t % 16 == 0) & (k % 3 != 0)).cast("int").alias("video_len"),
    )
    partner = sizes.select((F.col("utt") - 1).alias("utt"), F.col("emg_len").alias("voiced_len"))
    silent = F.col("utt") % 2 == 0
    return sizes.join(partner, "utt", "left").withColumn("silent", silent).withColumn(
        "voiced_len", F.when(silent, F.col("voiced_len"))
    )


LENGTHS_SQL = f"""{SAMPLES_SQL}, sizes AS (
  SELECT utt, count(*) FILTER (t % 4 = 0)::INT AS speech_len, count(*) FILTER (t % 4 = 0 AND t > 0)::INT AS phone_len,
         count(*)::INT AS emg_len, count(*) FILTER (t % 16 = 0 AND k % 3 <> 0)::INT AS video_len FROM samples GROUP BY 1),
lengths AS (
  SELECT s.*, s.utt % 2 = 0 AS silent, CASE WHEN s.utt % 2 = 0 THEN p.emg_len END AS voiced_len
  FROM sizes s LEFT JOIN sizes p ON p.utt = s.utt + 1)"""


@query(
    "edge_trim_w15",
    f"""WITH {SAMPLES_SQL}, sized AS (SELECT *, count(*) OVER (PARTITION BY utt) AS n FROM samples)
    SELECT utt, t - 20 AS t, value FROM sized WHERE t >= 20 AND t < n - 40""",
)
def edge_trim(spark, sf_dir):
    return q.trim_edges(first_channel(spark, sf_dir), ["utt"], 20, 40)


@query(
    "center_trim_w16",
    f"""WITH {SAMPLES_SQL}, sized AS (SELECT *, count(*) OVER (PARTITION BY utt) AS n FROM samples),
    cut AS (SELECT *, greatest(n - (50 + utt % 10), 0) AS spare FROM sized)
    SELECT utt, CAST(t - spare // 2 AS INT) AS t, value FROM cut WHERE t >= spare // 2 AND t < n - (spare - spare // 2)""",
)
def center_trim(spark, sf_dir):
    x = first_channel(spark, sf_dir)
    targets = x.groupBy("utt").agg((F.lit(50) + F.max(F.col("utt") % 10)).alias("want"))
    return q.center_trim(x, ["utt"], targets, "want")


@query(
    "array_trims_w16",
    """WITH v AS (SELECT vec_id, embedding AS e, len(embedding) AS size, vec_id % 70 AS want, vec_id % 40 AS l FROM embeddings),
    cut AS (SELECT vec_id, e[greatest(size - want, 0) // 2 + 1 : greatest(size - want, 0) // 2 + least(want, size)] AS c,
      CASE WHEN size > l + 30 THEN e[l + 1 : size - 30] ELSE [] END AS t FROM v)
    SELECT vec_id, len(c)::INT AS n, array_to_string(list_transform(c, lambda x: round(x::DOUBLE * 1e6)::BIGINT), ',') AS centre,
      len(t)::INT AS edge_n, array_to_string(list_transform(t, lambda x: round(x::DOUBLE * 1e6)::BIGINT), ',') AS middle FROM cut""",
)
def array_trims(spark, sf_dir):
    """The array forms of both trims; whole vectors are compared."""
    want = (F.col("vec_id") % 70).cast("int")
    cut = table(spark, sf_dir, "embeddings").select(
        "vec_id",
        arrays.center_trim(F.col("embedding"), want).alias("c"),
        arrays.trim_edges(F.col("embedding"), (F.col("vec_id") % 40).cast("int"), 30).alias("e"),
    )
    spelt = lambda c: F.array_join(F.transform(c, lambda x: F.round(x.cast("double") * 1e6).cast("long").cast("string")), ",")
    return cut.select("vec_id", F.size("c").alias("n"), spelt("c").alias("centre"), F.size("e").alias("edge_n"), spelt("e").alias("middle"))


def _targets_sql(k: int) -> str:
    whole = lambda x: f"CASE WHEN video_len > 0 THEN ({x}) // {k} * {k} ELSE {x} END"
    video = f"CASE WHEN video_len > 0 THEN video_len * {k} END"
    return f"""{LENGTHS_SQL}, common AS (
      SELECT *, {whole(f'least(speech_len, phone_len, emg_len // 4, {video})')} AS v,
        {whole(f'least(emg_len // 4, {video})')} AS a, least(speech_len, phone_len, coalesce(voiced_len // 4, 0)) AS g FROM lengths),
    targets AS (SELECT *, CASE WHEN silent THEN g ELSE v END::INT AS speech_to, CASE WHEN silent THEN g ELSE v END::INT AS phone_to,
      (CASE WHEN silent THEN a ELSE v END * 4)::INT AS emg_to, (CASE WHEN silent THEN g * 4 END)::INT AS voiced_to,
      (CASE WHEN video_len > 0 THEN CASE WHEN silent THEN a ELSE v END // {k} ELSE video_len END)::INT AS video_to FROM common)"""


_TARGET_COLUMNS = "utt, silent, speech_len, phone_len, emg_len, video_len, voiced_len, speech_to, phone_to, emg_to, voiced_to, video_to"


@query("alignment_lengths_w17", f"WITH {_targets_sql(4)} SELECT {_TARGET_COLUMNS} FROM targets")
def alignment_lengths(spark, sf_dir):
    return q.alignment_targets(lengths(spark, sf_dir), FRAME_RATE, 4, VIDEO_FPS)


@query(
    "alignment_fractional_w17",
    f"""WITH {LENGTHS_SQL}, v AS (SELECT *, CASE WHEN video_len > 0 THEN floor(video_len * 86.13::DOUBLE / 25.0::DOUBLE) END AS vf FROM lengths),
    common AS (SELECT *, least(speech_len, phone_len, emg_len // 4, vf) AS vo, least(emg_len // 4, vf) AS a,
      least(speech_len, phone_len, coalesce(voiced_len // 4, 0)) AS g FROM v)
    SELECT utt, CASE WHEN silent THEN g ELSE vo END::INT AS speech_to, (CASE WHEN silent THEN a ELSE vo END * 4)::INT AS emg_to,
      (CASE WHEN video_len > 0 THEN floor(CASE WHEN silent THEN a ELSE vo END * 25.0::DOUBLE / 86.13::DOUBLE) ELSE video_len END)::INT AS video_to
    FROM common""",
)
def alignment_fractional(spark, sf_dir):
    """A frame rate that is no multiple of the video rate."""
    return q.alignment_targets(lengths(spark, sf_dir), 86.13).select("utt", "speech_to", "emg_to", "video_to")


@query(
    "aligned_signal_w17",
    f"""WITH {_targets_sql(4)}, cut AS (SELECT s.utt, s.t, s.value, emg_len - least(emg_to, emg_len) AS spare, least(emg_to, emg_len) AS keep
      FROM samples s JOIN targets USING (utt))
    SELECT utt, CAST(t - spare // 2 AS INT) AS t, value FROM cut WHERE t >= spare // 2 AND t < spare // 2 + keep""",
)
def aligned_signal(spark, sf_dir):
    targets = q.alignment_targets(lengths(spark, sf_dir), FRAME_RATE, 4, VIDEO_FPS)
    return q.center_trim(first_channel(spark, sf_dir), ["utt"], targets, "emg_to")


def modalities(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Rows (utt, t, value) of every modality that ``lengths`` counts."""
    x = samples(spark, sf_dir)
    phone = (F.array_position(F.lit(PHONES), F.col("event_type")) - 1).cast("double")
    every = F.col("t") % 4 == 0
    pictures = x.where((F.col("t") % 16 == 0) & (F.col("k") % 3 != 0)).withColumnRenamed("t", "at")
    return {
        "speech": x.where(every).select("utt", F.floor(F.col("t") / 4).alias("t"), "value"),
        "phone": x.where(every & (F.col("t") > 0)).select("utt", (F.floor(F.col("t") / 4) - 1).alias("t"), phone.alias("value")),
        "emg": x.select("utt", "t", "value"),
        "video": dense_index(pictures, ["utt"], [F.col("at")], F.col("at")).select("utt", "t", F.col("k").cast("double").alias("value")),
        "voiced": x.where("utt % 2 = 1").select((F.col("utt") - 1).alias("utt"), "t", "value"),
    }


@query(
    "aligned_modalities_w17",
    f"""WITH {_targets_sql(4)}, mods AS (
      SELECT utt, 'speech' AS modality, t // 4 AS t, value FROM samples WHERE t % 4 = 0
      UNION ALL SELECT utt, 'phone', t // 4 - 1, list_position({PHONES!r}, event_type) - 1 FROM samples WHERE t % 4 = 0 AND t > 0
      UNION ALL SELECT utt, 'emg', t, value FROM samples
      UNION ALL SELECT utt, 'video', row_number() OVER (PARTITION BY utt ORDER BY t) - 1, k FROM samples WHERE t % 16 = 0 AND k % 3 <> 0
      UNION ALL SELECT utt - 1, 'voiced', t, value FROM samples WHERE utt % 2 = 1),
    wanted AS (
      SELECT utt, 'speech' AS modality, speech_to AS w FROM targets UNION ALL SELECT utt, 'phone', phone_to FROM targets
      UNION ALL SELECT utt, 'emg', emg_to FROM targets UNION ALL SELECT utt, 'video', video_to FROM targets
      UNION ALL SELECT utt, 'voiced', voiced_to FROM targets WHERE silent),
    sized AS (SELECT m.*, count(*) OVER (PARTITION BY m.utt, m.modality) AS n, greatest(w, 0) AS w FROM mods m JOIN wanted USING (utt, modality)),
    cut AS (SELECT *, n - least(w, n) AS spare FROM sized)
    SELECT utt, modality, (t - spare // 2)::INT AS t, {rsql('value', 'value')} FROM cut WHERE t >= spare // 2 AND t < n - (spare - spare // 2)""",
)
def aligned_modalities(spark, sf_dir):
    """Speech, phones, signal, video and voiced signal, each cut to its target."""
    targets = stored(q.alignment_targets(lengths(spark, sf_dir), FRAME_RATE, 4, VIDEO_FPS), "targets")
    cut = lambda name, rows: q.center_trim(rows, ["utt"], targets, f"{name}_to").select(
        "utt", F.lit(name).alias("modality"), F.col("t").cast("int").alias("t"), r("value")
    )
    parts = [cut(name, rows) for name, rows in modalities(spark, sf_dir).items()]
    return reduce(DataFrame.union, parts)


@query(
    "fixed_chunks_w18",
    f"""WITH {SAMPLES_SQL}, flat AS (SELECT row_number() OVER (ORDER BY utt, t) - 1 AS p, value FROM samples),
    padded AS (SELECT p, value FROM flat UNION ALL SELECT unnest(range(n, (n + 299) // 300 * 300)), 0 FROM (SELECT count(*) AS n FROM flat))
    SELECT p // 300 AS piece, CAST(p % 300 AS INT) AS pos, value FROM padded""",
)
def fixed_chunks(spark, sf_dir):
    return q.fixed_length_chunks(first_channel(spark, sf_dir), "utt", 300)


@query(
    "split_by_lengths_j8",
    f"""WITH {SAMPLES_SQL}, flat AS (SELECT row_number() OVER (ORDER BY utt, t) - 1 AS p, value FROM samples),
    len AS (SELECT conv_id * 100 + turn AS item, length(text) // 10 + turn % 2 AS length FROM conversations WHERE role = 'user'),
    spans AS (SELECT item, sum(length) OVER (ORDER BY item) - length AS lo, sum(length) OVER (ORDER BY item) AS hi FROM len)
    SELECT item, CAST(p - lo AS INT) AS t, value FROM spans JOIN flat ON p >= lo AND p < hi""",
)
def split_by_lengths(spark, sf_dir):
    """The concatenated samples cut by the lengths of the user turns."""
    pieces = q.fixed_length_chunks(first_channel(spark, sf_dir), "utt", 300)
    flat = pieces.select((F.col("piece") * 300 + F.col("pos")).alias("at"), "value")
    turns = table(spark, sf_dir, "conversations").where("role = 'user'")
    cuts = turns.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("item"),
        (F.floor(F.length("text") / F.lit(10)) + F.col("turn") % 2).alias("length"),
    )
    return q.split_by_lengths(flat, cuts, "item")


@query(
    "splice_w19",
    f"""WITH {SAMPLES_SQL}, sized AS (SELECT utt, t, value, count(*) OVER (PARTITION BY utt) AS size FROM samples),
    cut AS (SELECT utt, t, value, CASE WHEN size % 20 < 4 THEN least(t // 20, size // 20 - 1) ELSE t // 20 END AS seg FROM sized),
    seg AS (SELECT utt, seg, t - seg * 20 AS i, value, count(*) OVER (PARTITION BY utt, seg) AS n FROM cut),
    w AS (SELECT utt, seg * 16 + i AS t, value * CASE WHEN i < 4 THEN i / 3.0::DOUBLE ELSE 1 END
        * CASE WHEN n - 1 - i < 4 THEN (n - 1 - i) / 3.0::DOUBLE ELSE 1 END AS value FROM seg)
    SELECT utt, t, {rsql('sum(value)', 'value')} FROM w GROUP BY 1, 2""",
)
def splice(spark, sf_dir):
    """Twenty-sample chunks overlapped by four; a rest shorter than the overlap joins the chunk before."""
    x = first_channel(spark, sf_dir)
    size, at = F.col("size"), F.floor(F.col("t") / 20)
    seg = F.when(size % 20 < 4, F.least(at, F.floor(size / 20) - 1)).otherwise(at)
    sized = x.join(x.groupBy("utt").agg(F.count(F.lit(1)).alias("size")), "utt").withColumn("seg", seg)
    chunks = sized.select("utt", "seg", (F.col("t") - F.col("seg") * 20).alias("i"), "value")
    return q.splice(chunks, ["utt"], 4).select("utt", "t", r("value"))


@query(
    "gap_fill_w20",
    f"""WITH {SAMPLES_SQL}, g AS (SELECT utt, t, CASE WHEN event_type <> 'error' AND utt % 50 <> 7 THEN value END AS v FROM samples),
    near AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN t END) OVER (PARTITION BY utt ORDER BY t) AS p,
      min(CASE WHEN v IS NOT NULL THEN t END) OVER (PARTITION BY utt ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n FROM g)
    SELECT x.utt, x.t, {rsql('coalesce(x.v, a.v + (x.t - x.p)::DOUBLE / (x.n - x.p) * (b.v - a.v), a.v, b.v)', 'value')}
    FROM near x LEFT JOIN g a ON a.utt = x.utt AND a.t = x.p LEFT JOIN g b ON b.utt = x.utt AND b.t = x.n
    WHERE coalesce(x.p, x.n) IS NOT NULL""",
)
def gap_fill(spark, sf_dir):
    """Errors are gaps; every fiftieth utterance has no valid sample at all and is dropped."""
    valid = (F.col("event_type") != "error") & (F.col("utt") % 50 != 7)
    x = samples(spark, sf_dir).select("utt", "t", F.when(valid, F.col("value")).alias("value"))
    return q.fill_gaps(x, ["utt"]).select("utt", "t", r("value"))


def landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, v = F.col("k").cast("double"), F.col("value")
    points = F.array(
        F.struct(F.lit(0).alias("point"), v.alias("x"), k.alias("y")),
        F.struct(F.lit(1).alias("point"), (k + 20).alias("x"), (v / 4).alias("y")),
    )
    return samples(spark, sf_dir).select("utt", "t", F.inline(points))


LANDMARKS_SQL = f"""{SAMPLES_SQL}, landmarks AS (
  SELECT utt, t, 0 AS point, value AS x, k::DOUBLE AS y FROM samples
  UNION ALL SELECT utt, t, 1, k::DOUBLE + 20, value / 4 FROM samples)"""


@query(
    "smooth_landmarks_w21",
    f"""WITH {LANDMARKS_SQL}, sized AS (SELECT *, count(*) OVER (PARTITION BY utt, point) AS n FROM landmarks),
    near AS (SELECT a.utt, a.t, a.point, a.x, a.y, avg(b.x) AS sx, avg(b.y) AS sy FROM sized a JOIN sized b
      ON b.utt = a.utt AND b.point = a.point AND abs(b.t - a.t) <= least(6, a.t, a.n - 1 - a.t) GROUP BY 1, 2, 3, 4, 5)
    SELECT utt, t, point, {rsql('sx + avg(x) OVER f - avg(sx) OVER f', 'x')}, {rsql('sy + avg(y) OVER f - avg(sy) OVER f', 'y')}
    FROM near WINDOW f AS (PARTITION BY utt, t)""",
)
def smooth_landmarks(spark, sf_dir):
    return q.smooth_landmarks(landmarks(spark, sf_dir), ["utt"]).select("utt", "t", "point", r("x"), r("y"))


@query(
    "range_quarantine_p9",
    f"""WITH {LANDMARKS_SQL}, c AS (SELECT utt, t, avg(x) AS cx, avg(y) AS cy FROM landmarks GROUP BY 1, 2),
    bad AS (SELECT DISTINCT utt FROM c WHERE abs(cy - 60) > 96 + 5 OR abs(cx - 100) > 96 + 5)
    SELECT utt, t, round_even(greatest(0, least(200, cx - 96)), 0)::INT AS x_min, round_even(greatest(0, least(200, cx + 96)), 0)::INT AS x_max,
      round_even(greatest(0, least(120, cy - 96)), 0)::INT AS y_min, round_even(greatest(0, least(120, cy + 96)), 0)::INT AS y_max
    FROM c WHERE utt NOT IN (SELECT utt FROM bad)""",
)
def range_quarantine(spark, sf_dir):
    boxes = q.centre_bounds(landmarks(spark, sf_dir), ["utt"], 120, 200, 96)
    return q.quarantine(boxes, ["utt"], 120, 200, 96).select("utt", "t", "x_min", "x_max", "y_min", "y_max")


@query(
    "with_video_j12",
    f"WITH {LENGTHS_SQL} SELECT s.utt, s.t, s.value FROM samples s JOIN lengths USING (utt) WHERE video_len > 0",
)
def with_video(spark, sf_dir):
    return q.with_modality(first_channel(spark, sf_dir), lengths(spark, sf_dir), ["utt"], "video_len")


@query(
    "time_shift_w22",
    f"""WITH {SIGNAL_SQL}, s AS (SELECT *, {_hash_sql('(utt // 32)')} % 8 AS r FROM signal)
    SELECT a.utt, a.ch, a.t, coalesce(b.value, 0) AS value FROM s a LEFT JOIN s b ON b.utt = a.utt AND b.ch = a.ch AND b.t = a.t + a.r""",
)
def time_shift(spark, sf_dir):
    batch = F.floor(F.col("utt") / 32).cast("string")
    return q.time_shift(signal(spark, sf_dir), KEYS, batch, SEED)


@query(
    "channel_dropout_w23",
    f"""WITH {SIGNAL_SQL} SELECT utt, ch, t, CASE WHEN {_hash_sql("(utt // 32) || '|' || ch")} < {int(0.4 * 2**32)} THEN 0 ELSE value END AS value FROM signal""",
)
def channel_dropout(spark, sf_dir):
    return q.drop_channels(signal(spark, sf_dir), F.floor(F.col("utt") / 32).cast("string"), SEED, 0.4)


@query(
    "channel_permutation_w24",
    f"""WITH {SIGNAL_SQL} SELECT utt, ch, CAST(row_number() OVER (PARTITION BY utt ORDER BY md5('{SEED}|' || utt || '|' || ch || '|' || t)) - 1 AS INT) AS t, value
    FROM signal WHERE ch = 1 UNION ALL SELECT utt, ch, t, value FROM signal WHERE ch = 0""",
)
def channel_permutation(spark, sf_dir):
    return q.permute_channels(signal(spark, sf_dir), KEYS, [1], SEED)


_SEGMENT_SQL = f"""{SAMPLES_SQL}, sized AS (SELECT utt, count(*) AS n FROM samples GROUP BY 1)"""


@query(
    "random_segment_w25",
    f"""WITH {_SEGMENT_SQL}, plan AS (SELECT utt, n, {_hash_sql('utt')} % greatest(n - 70 + 1, 1) AS start, unnest(range(70))::INT AS t FROM sized)
    SELECT p.utt, p.t, coalesce(s.value, 0) AS value FROM plan p LEFT JOIN samples s ON s.utt = p.utt AND s.t = p.start + p.t""",
)
def random_segment(spark, sf_dir):
    return q.random_segment(first_channel(spark, sf_dir), ["utt"], 70, SEED)


@query(
    "paired_segment_w25",
    f"""WITH {_SEGMENT_SQL}, plan AS (SELECT utt, n, CASE WHEN n >= 32 THEN {_hash_sql('utt')} % greatest((n + 3) // 4 - 8, 1) ELSE 0 END AS start FROM sized),
    f AS (SELECT utt, start, unnest(range(8))::INT AS t FROM plan), a AS (SELECT utt, start, unnest(range(32))::INT AS t FROM plan)
    SELECT 'feature' AS kind, f.utt, f.t, coalesce(s.value, 0) AS value FROM f LEFT JOIN samples s ON s.utt = f.utt AND s.t = (f.start + f.t) * 4
    UNION ALL SELECT 'audio', a.utt, a.t, coalesce(s.value, 0) FROM a LEFT JOIN samples s ON s.utt = a.utt AND s.t = a.start * 4 + a.t""",
)
def paired_segment(spark, sf_dir):
    audio = first_channel(spark, sf_dir)
    features = audio.where("t % 4 = 0").withColumn("t", (F.col("t") / 4).cast("int"))
    f, a = q.paired_segment(features, audio, ["utt"], 32, 4, SEED)
    return f.withColumn("kind", F.lit("feature")).unionByName(a.withColumn("kind", F.lit("audio")))


@query(
    "repeat_upsample_w27",
    f"""WITH {LENGTHS_SQL}, v AS (SELECT utt, t // 16 AS t, value FROM samples WHERE t % 16 = 0),
    grid AS (SELECT utt, video_len, unnest(range(speech_len))::INT AS t FROM lengths)
    SELECT g.utt, g.t, CASE WHEN g.t // 4 >= video_len THEN 0 ELSE coalesce(v.value, 0) END AS value,
      g.t // 4 >= video_len OR v.value IS NULL AS masked FROM grid g LEFT JOIN v ON v.utt = g.utt AND v.t = g.t // 4""",
)
def repeat_upsample(spark, sf_dir):
    """Video frames (every sixteenth sample) repeated to the speech frames."""
    video = first_channel(spark, sf_dir).where("t % 16 = 0").withColumn("t", (F.col("t") / 16).cast("int"))
    return q.repeat_upsample(video, ["utt"], 4, lengths(spark, sf_dir), "speech_len", "video_len")


def batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utterances with their batch; the lengths are stored because ranking reads them several times."""
    return b.assign_batches(stored(lengths(spark, sf_dir), "lengths"), "utt", 32, SEED)


BATCHES_SQL = f"""{LENGTHS_SQL}, batched AS (
  SELECT *, (row_number() OVER (ORDER BY md5('{SEED}|0|' || utt), utt) - 1) // 32 AS batch FROM lengths),
caps AS (
  SELECT batch, least(max(speech_len), 16) AS max_target, least(max(emg_len // 4), 16) AS max_est, max(video_len) AS v FROM batched GROUP BY 1),
capped AS (
  SELECT b.*, max_target::INT AS max_target, max_est::INT AS max_est,
         (CASE WHEN v = 0 THEN 0 ELSE least(v, 4, ceil(max_est / 4)) END)::INT AS max_video FROM batched b JOIN caps USING (batch)),
kept AS (
  SELECT *, least(speech_len, max_target)::INT AS target_length, least(emg_len // 4, max_est)::INT AS est_length,
         least(video_len, max_video)::INT AS video_length, (least(video_len, max_video) * 4)::INT AS video_est_length FROM capped)"""


@query("batches_b1", f"WITH {BATCHES_SQL} SELECT utt, batch FROM batched")
def batches(spark, sf_dir):
    return batched(spark, sf_dir).select("utt", "batch")


@query(
    "ordered_batches_b1",
    f"WITH {LENGTHS_SQL} SELECT utt, row_number() OVER (ORDER BY utt) - 1 AS batch FROM lengths",
)
def ordered_batches(spark, sf_dir):
    """Validation batches: one utterance each, in key order."""
    return b.assign_batches(stored(lengths(spark, sf_dir), "lengths"), "utt", 1).select("utt", "batch")


@query(
    "batch_order_b2",
    f"WITH {BATCHES_SQL} SELECT utt, batch, (row_number() OVER (PARTITION BY batch ORDER BY speech_len DESC, utt) - 1)::INT AS slot FROM batched",
)
def batch_order(spark, sf_dir):
    return b.sort_in_batch(batched(spark, sf_dir), "utt").select("utt", "batch", "slot")


def capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    caps = b.cap_lengths(stored(batched(spark, sf_dir), "batches"), FRAME_RATE, 8.0, 4, VIDEO_FPS)
    return stored(caps, "caps")


@query(
    "length_caps_b3",
    f"WITH {BATCHES_SQL} SELECT utt, batch, max_target, max_est, max_video, target_length, est_length, video_length, video_est_length FROM kept",
)
def length_caps(spark, sf_dir):
    return capped(spark, sf_dir).select(
        "utt", "batch", "max_target", "max_est", "max_video", "target_length", "est_length", "video_length", "video_est_length"
    )


PADDED_SQL = f"""{BATCHES_SQL}, grid AS (SELECT utt, batch, emg_len, unnest(range(max_est * 4))::INT AS t FROM kept),
  padded AS (SELECT g.utt, g.batch, g.t, coalesce(s.value, 0) AS value, g.t >= g.emg_len AS padded
    FROM grid g LEFT JOIN samples s ON s.utt = g.utt AND s.t = g.t)"""


@query("padding_b4", f"WITH {PADDED_SQL} SELECT utt, t, value, padded FROM padded")
def padding(spark, sf_dir):
    """Signals filled with zeros to the padded size of their batch."""
    caps = capped(spark, sf_dir).withColumn("size", F.col("max_est") * 4)
    return b.pad_samples(first_channel(spark, sf_dir), ["utt"], caps, "size", F.lit(0.0))


def mel_frames(x: DataFrame) -> DataFrame:
    """Speech features ``utt, t, x``: log-mel frames of the first channel, one for four samples."""
    rows = s.log_mel(x.select("utt", F.lit(0).alias("ch"), "t", (F.col("value") / 1000).alias("value")), KEYS, **MEL)
    return rows.select("utt", F.col("frame").cast("int").alias("t"), F.col("mel").alias("x"))


def silence_vector(x: DataFrame) -> DataFrame:
    """The mean log-mel frame of silence, ``band, x``."""
    return s.zero_output(s.log_mel(x.select("utt", F.lit(0).alias("ch"), "t", (F.col("value") * 0).alias("value")), KEYS, **MEL))


_ZERO_SQL = "zero AS (SELECT band AS dim, ln(greatest(sum(weight) * sqrt(1e-9::DOUBLE), 1e-5)) AS x FROM cells GROUP BY 1)"


@query(
    "speech_padding_b4",
    f"""WITH {_mel_sql('value / 1000')}, {_ZERO_SQL}, speech AS (SELECT utt, frame AS t, band AS dim, x FROM mel WHERE ch = 0),
    sizes AS (SELECT utt, max(t) + 1 AS n FROM speech GROUP BY 1),
    batched AS (SELECT *, (row_number() OVER (ORDER BY md5('{SEED}|0|' || utt), utt) - 1) // 32 AS batch FROM sizes),
    grid AS (SELECT utt, n, unnest(range(least(max(n) OVER (PARTITION BY batch), 16)))::INT AS t FROM batched)
    SELECT g.utt, g.t, z.dim, {rsql('CASE WHEN g.t < g.n THEN p.x ELSE z.x END', 'x', 5)}, g.t >= g.n AS padded
    FROM grid g CROSS JOIN zero z LEFT JOIN speech p ON p.utt = g.utt AND p.t = g.t AND p.dim = z.dim""",
)
def speech_padding(spark, sf_dir):
    """Speech features filled up with the mean frame of silence, a vector per frame."""
    x = stored(samples(spark, sf_dir).select("utt", "t", "value"), "samples")
    speech = stored(mel_frames(x), "mel")
    sizes = stored(speech.groupBy("utt").agg(F.count(F.lit(1)).cast("int").alias("speech_len")), "sizes")
    batched = b.assign_batches(sizes, "utt", 32, SEED).withColumns({"emg_len": F.lit(0), "video_len": F.lit(0)})
    caps = stored(b.cap_lengths(batched, FRAME_RATE, 8.0, 4, VIDEO_FPS), "caps")
    filler = training.vector_of(silence_vector(x), "band", "x")
    padded = b.pad_samples(speech, ["utt"], caps, "max_target", filler, "x")
    return padded.select("utt", "t", F.posexplode_outer("x").alias("dim", "x"), "padded").withColumn("x", r("x", 5))


EDGE_SECONDS = 1.0
_LEN = lambda m: f"count(*) FILTER (modality = '{m}' AND dim = 0) AS {m}_len"
_CHAIN_SQL = f"""{_mel_sql('value / 1000')}, {_ZERO_SQL}{FRAME_LABELS_SQL[len(SAMPLES_SQL):]},
speech AS (SELECT utt, frame AS t, band AS dim, x FROM mel WHERE ch = 0),
norm AS (SELECT dim, avg(x) AS mean, greatest(stddev_pop(x), 1e-8) AS std FROM speech GROUP BY 1),
wanted_labels AS (SELECT utt, size, unnest(range(n))::INT AS frame FROM (SELECT utt, count(*) AS n FROM speech WHERE dim = 0 GROUP BY 1) JOIN sizes USING (utt)),
mods AS (
  SELECT utt, 'speech' AS modality, t, dim, (x - mean) / std AS x FROM speech JOIN norm USING (dim)
  UNION ALL SELECT utt, 'phone', frame, 0, list_position({PHONES!r}, CASE WHEN frame < size THEN coalesce(label, '{SILENCE}') ELSE '{SILENCE}' END) - 1
    FROM wanted_labels LEFT JOIN winner USING (utt, frame)
  UNION ALL SELECT utt, 'emg', t, ch, value FROM signal
  UNION ALL SELECT utt - 1, 'voiced', t, ch, value FROM signal WHERE utt % 2 = 1
  UNION ALL SELECT utt, 'video', row_number() OVER (PARTITION BY utt ORDER BY t) - 1, 0, k FROM samples WHERE t % 16 = 0 AND k % 3 <> 0),
counted AS (SELECT utt, {', '.join(map(_LEN, training.MODALITIES))} FROM mods GROUP BY 1),
lengths AS (SELECT utt, utt % 2 = 0 AS silent, speech_len, phone_len, emg_len, video_len, CASE WHEN utt % 2 = 0 THEN voiced_len END AS voiced_len
  FROM counted WHERE emg_len > 0){_targets_sql(4)[len(LENGTHS_SQL):]},
asked AS (
  SELECT utt, 'speech' AS modality, speech_len AS n, speech_to AS w, 2 AS edge FROM targets UNION ALL SELECT utt, 'phone', phone_len, phone_to, 2 FROM targets
  UNION ALL SELECT utt, 'emg', emg_len, emg_to, 8 FROM targets UNION ALL SELECT utt, 'video', video_len, video_to, 0 FROM targets
  UNION ALL SELECT utt, 'voiced', coalesce(voiced_len, 0), coalesce(voiced_to, 0), 8 FROM targets),
cuts AS (SELECT utt, modality, (n - greatest(least(w, n), 0)) // 2 + edge AS start, greatest(greatest(least(w, n), 0) - 2 * edge, 0) AS keep FROM asked),
items AS (SELECT utt, max(keep) FILTER (modality = 'speech') AS sk, max(keep) FILTER (modality = 'emg') AS ek, max(keep) FILTER (modality = 'video') AS vk FROM cuts GROUP BY 1),
batched AS (SELECT *, (row_number() OVER (ORDER BY md5('{SEED}|0|' || utt), utt) - 1) // 32 AS batch FROM items),
sorted AS (SELECT *, (row_number() OVER (PARTITION BY batch ORDER BY sk DESC, utt) - 1)::INT AS slot FROM batched),
caps AS (SELECT batch, least(max(sk), 16) AS mt, least(max(ek // 4), 16) AS me, max(vk) AS v FROM batched GROUP BY 1),
plan AS (SELECT *, least(keep, size) AS kept FROM (SELECT c.*, s.batch, s.slot, (CASE WHEN modality IN ('speech', 'phone') THEN mt
    WHEN modality = 'video' THEN CASE WHEN v = 0 THEN 0 ELSE least(v, 4, ceil(me / 4)) END ELSE me * 4 END)::INT AS size
  FROM cuts c JOIN sorted s USING (utt) JOIN caps USING (batch))),
fillers AS (SELECT 'speech' AS modality, dim, x FROM zero UNION ALL SELECT * FROM (VALUES ('phone', 0, {PHONES.index(SILENCE)}), ('emg', 0, 0), ('emg', 1, 0),
  ('voiced', 0, 0), ('voiced', 1, 0), ('video', 0, 0))),
chain AS (
  SELECT utt, batch, slot, modality, t - start AS t, dim, x, false AS padded FROM plan JOIN mods USING (utt, modality) WHERE t >= start AND t < start + kept
  UNION ALL SELECT utt, batch, slot, modality, t, dim, x, true FROM (SELECT utt, batch, slot, modality, unnest(range(kept, size)) AS t FROM plan) JOIN fillers USING (modality))"""


@query("training_chain_b5", f"WITH {_CHAIN_SQL} SELECT utt, batch, slot, modality, t::INT AS t, dim::INT AS dim, {rsql('x', 'x', 5)}, padded FROM chain")
def training_chain(spark, sf_dir):
    """One epoch: features normalised, labels framed, five modalities aligned, edges
    cut, batched, capped and padded."""
    x = stored(samples(spark, sf_dir), "samples")
    speech = stored(mel_frames(x), "mel")
    normal = stats.normalize(speech, "x", stats.dim_moments(speech, "x"))
    frames = speech.groupBy("utt").agg(F.count(F.lit(1)).cast("int").alias("n"))
    phones = iv.frame_labels(intervals_of(x), "phones", RATE, frames, silence=SILENCE)
    phone = (F.array_position(F.lit(PHONES), F.col("label")) - 1).cast("double")
    pictures = x.where((F.col("t") % 16 == 0) & (F.col("k") % 3 != 0)).withColumnRenamed("t", "at")
    emg = F.array(F.col("value"), F.col("k").cast("double"))
    # A row of the signal serves two utterances: its own, and the silent one before it.
    own = F.struct("utt", F.lit("emg").alias("modality"))
    partner = F.struct((F.col("utt") - 1).alias("utt"), F.lit("voiced").alias("modality"))
    sides = F.when(F.col("utt") % 2 == 1, F.array(own, partner)).otherwise(F.array(own))
    of = lambda name, df, t, v: df.select("utt", F.lit(name).alias("modality"), F.col(t).cast("int").alias("t"), v.alias("x"))
    rows = reduce(
        DataFrame.unionByName,
        [
            of("speech", normal, "t", F.col("x")),
            of("phone", phones, "frame", F.array(phone)),
            of("video", dense_index(pictures, ["utt"], [F.col("at")], F.col("at")), "t", F.array(F.col("k").cast("double"))),
            x.select(F.inline(sides), "t", emg.alias("x")),
        ],
    )
    utterances = x.select("utt").distinct().withColumn("silent", F.col("utt") % 2 == 0)
    items = stored(training.windows(training.modality_lengths(rows, utterances), FRAME_RATE, EDGE_SECONDS, 4, VIDEO_FPS), "items")
    plan = stored(training.batch_plan(items, 32, SEED, FRAME_RATE, 0, 8.0, 4, VIDEO_FPS), "batch-plan")
    zeros = lambda n: F.array(*[F.lit(0.0)] * n)
    fillers = {
        "speech": training.vector_of(silence_vector(x), "band", "x"), "phone": F.array(F.lit(float(PHONES.index(SILENCE)))),
        "emg": zeros(2), "voiced": zeros(2), "video": zeros(1),
    }
    made = training.training_rows(rows, plan, fillers)
    return made.select("utt", "batch", "slot", "modality", "t", F.posexplode_outer("x").alias("dim", "x"), "padded").withColumn("x", r("x", 5))


@query(
    "label_padding_b4",
    f"""WITH {BATCHES_SQL}, grid AS (SELECT utt, silent, emg_len, speech_len, max_target, unnest(range(max_target))::INT AS t FROM kept)
    SELECT g.utt, g.t, CASE WHEN g.t >= g.speech_len OR g.silent THEN 'view' ELSE s.event_type END AS phone,
      g.t >= g.speech_len OR g.silent AS padded
    FROM grid g LEFT JOIN samples s ON s.utt = g.utt AND s.t = g.t * 4""",
)
def label_padding(spark, sf_dir):
    """Phones filled with silence; silent utterances have none here and are filled from the start."""
    phones = samples(spark, sf_dir).where("t % 4 = 0 AND utt % 2 = 1").select(
        "utt", (F.col("t") / 4).cast("int").alias("t"), F.col("event_type").alias("phone")
    )
    return b.pad_samples(phones, ["utt"], capped(spark, sf_dir), "max_target", F.lit("view"), "phone")


@query(
    "video_masks_b5",
    f"""WITH {BATCHES_SQL}, grid AS (SELECT utt, video_length, unnest(range(max_video))::INT AS pos FROM kept)
    SELECT utt, pos, pos >= video_length AS masked FROM grid""",
)
def video_masks(spark, sf_dir):
    return b.padding_masks(capped(spark, sf_dir), ["utt"], "video_length", "max_video")


@query(
    "batch_report_a19",
    f"""WITH {PADDED_SQL} SELECT batch, round(avg(abs(value)), 6) AS magnitude, round(avg(padded::INT), 6) AS padding,
      count(*) FILTER (t = 0) AS utterances FROM padded GROUP BY 1""",
)
def batch_report(spark, sf_dir):
    caps = capped(spark, sf_dir).withColumn("size", F.col("max_est") * 4)
    padded = b.pad_samples(first_channel(spark, sf_dir), ["utt"], caps, "size", F.lit(0.0))
    report = b.batch_report(padded.join(caps.select("utt", "batch"), "utt"))
    return report.select("batch", F.round("magnitude", 6).alias("magnitude"), F.round("padding", 6).alias("padding"), "utterances")


@query(
    "array_padding_b5",
    """SELECT vec_id, CAST((vec_id % 100 + 1) AS INT) AS n, CAST(least(64, (vec_id % 100 + 1)) AS INT) AS kept,
      CAST(greatest((vec_id % 100 + 1) - 64, 0) AS INT) AS masked, round(list_sum(list_transform(embedding[1:(vec_id % 100 + 1)], lambda x: x::DOUBLE)), 5) + 0.0::DOUBLE AS total
    FROM embeddings""",
)
def array_padding(spark, sf_dir):
    """Array forms: vectors cut or filled with zeros, and their masks."""
    n = (F.col("vec_id") % 100 + 1).cast("int")
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id",
        arrays.pad_to(F.col("embedding").cast("array<double>"), n, F.lit(0.0)).alias("x"),
        arrays.padding_mask(F.lit(64), n).alias("m"),
    )
    return rows.select(
        "vec_id",
        F.size("x").alias("n"),
        F.size(F.filter("m", lambda p: ~p)).alias("kept"),
        F.size(F.filter("m", lambda p: p)).alias("masked"),
        (F.round(F.aggregate("x", F.lit(0.0), lambda s, v: s + v), 5) + F.lit(0.0)).alias("total"),
    )


@query(
    "shape_validation_p11",
    """WITH m AS (SELECT vec_id, list_transform(range(4), lambda i: embedding[i * 16 + 1 : i * 16 + CASE WHEN i = 3 AND vec_id % 5 = 0 THEN 15 ELSE 16 END]) AS x
      FROM embeddings)
    SELECT vec_id, CASE WHEN len(list_filter(x, lambda r: len(r) <> 16)) = 0 THEN 'valid' ELSE 'rejected' END AS status, len(x)::INT AS steps FROM m""",
)
def shape_validation(spark, sf_dir):
    """Vectors as a matrix of 4 x 16 with a unit axis in front; every fifth has a short last frame."""
    last = F.when(F.col("vec_id") % 5 == 0, 15).otherwise(16)
    starts = F.array(*[F.lit(i) for i in range(4)])
    matrix = F.transform(starts, lambda i: F.slice(F.col("embedding"), i * 16 + 1, F.when(i == 3, last).otherwise(16)))
    shaped = table(spark, sf_dir, "embeddings").select("vec_id", arrays.drop_unit_axis(F.array(matrix)).alias("x"))
    status = F.when(arrays.has_width(F.col("x"), 16), "valid").otherwise("rejected")
    return shaped.select("vec_id", status.alias("status"), F.size("x").alias("steps"))
