"""Interval and annotation-file queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from speechlake.functions.text import phone_label
from speechlake.operators import intervals as iv
from speechlake.plans.corpus import INTERVALS_SQL, NOISE, SAMPLES_SQL, SILENCE, intervals, samples, table
from speechlake.plans.registry import query
from speechlake.sources import textgrid
from speechlake.sources.scratch import scratch_path

RATE = 10.0

_LABELS_SQL = """CASE event_type WHEN 'view' THEN '' WHEN 'click' THEN 'AA1' WHEN 'purchase' THEN 'sp'
  WHEN 'error' THEN 'spn' ELSE 'N0' END"""


@query(
    "phone_labels_t16",
    f"""WITH l AS (SELECT event_id, {_LABELS_SQL} AS label FROM events)
    SELECT event_id, CASE WHEN label IN ('', 'sp', 'spn') THEN 'sil' ELSE regexp_replace(lower(label), '[0-9]$', '') END AS phone,
      CASE WHEN label IN ('', 'sp') THEN 'sil' ELSE regexp_replace(lower(label), '[0-9]$', '') END AS with_noise FROM l""",
)
def phone_labels(spark, sf_dir):
    kind = F.col("event_type")
    raw = (
        F.when(kind == "view", "").when(kind == "click", "AA1").when(kind == "purchase", "sp").when(kind == "error", "spn")
        .otherwise("N0")
    )
    events = table(spark, sf_dir, "events").select("event_id", raw.alias("label"))
    return events.select(
        "event_id", phone_label(F.col("label"), False).alias("phone"), phone_label(F.col("label"), True).alias("with_noise")
    )


@query(
    "unknown_labels_t16",
    f"WITH {INTERVALS_SQL} SELECT DISTINCT label FROM intervals WHERE label NOT IN (SELECT event_type FROM events WHERE value > 400 AND event_type <> 'view')",
)
def unknown_labels(spark, sf_dir):
    """Labels missing from an inventory made of the loud events."""
    loud = table(spark, sf_dir, "events").where("value > 400 AND event_type <> 'view'")
    inventory = loud.select(F.col("event_type").alias("phone")).distinct()
    return iv.unknown_labels(intervals(spark, sf_dir), inventory)


FRAME_LABELS_SQL = f"""{INTERVALS_SQL}, sizes AS (
  SELECT utt, arg_max(xmax, idx) AS e, trunc(arg_max(xmax, idx) * 10.0::DOUBLE)::INT + 1 AS size FROM intervals GROUP BY 1),
covered AS (
  SELECT utt, unnest(range(trunc(xmin * 10.0::DOUBLE)::INT, trunc(xmax * 10.0::DOUBLE)::INT))::INT AS frame, idx, label FROM intervals),
winner AS (SELECT utt, frame, arg_max(label, idx) AS label FROM covered GROUP BY 1, 2)"""


@query(
    "frame_labels_j7",
    f"""WITH {FRAME_LABELS_SQL}, grid AS (SELECT utt, unnest(range(size))::INT AS frame FROM sizes)
    SELECT g.utt, g.frame, coalesce(w.label, '{SILENCE}') AS label FROM grid g LEFT JOIN winner w USING (utt, frame)""",
)
def frame_labels(spark, sf_dir):
    return iv.frame_labels(intervals(spark, sf_dir), "phones", RATE, silence=SILENCE)


@query(
    "frame_labels_to_length_j7",
    f"""WITH {FRAME_LABELS_SQL}, grid AS (SELECT utt, size, unnest(range(100 + utt % 60))::INT AS frame FROM sizes)
    SELECT g.utt, g.frame, CASE WHEN g.frame < g.size THEN coalesce(w.label, '{SILENCE}') ELSE '{SILENCE}' END AS label
    FROM grid g LEFT JOIN winner w USING (utt, frame)""",
)
def frame_labels_to_length(spark, sf_dir):
    """Cut or filled to a given number of frames per utterance."""
    rows = intervals(spark, sf_dir)
    wanted = rows.select("utt").distinct().withColumn("n", F.lit(100) + F.col("utt") % 60)
    return iv.frame_labels(rows, "phones", RATE, wanted, silence=SILENCE)


_REPAIR_SQL = f"""{INTERVALS_SQL}, last AS (SELECT * FROM intervals QUALIFY row_number() OVER (PARTITION BY utt ORDER BY idx DESC) = 1),
  report AS (SELECT utt, idx, xmax AS old_end, least(xmin + 0.15::DOUBLE, xmax) AS new_end, CASE
      WHEN label = 'view' THEN 'already_ends_with_silence' WHEN xmax - xmin + 1e-9 < 0.12 THEN 'last_dur<0.12'
      WHEN xmax - xmin <= 0.15 + 1e-9 THEN 'last_dur<=fixed_dur(0.15)'
      ELSE 'fixed_last:' || label || ', old_dur=' || printf('%.6f', xmax - xmin) || ', rem=' || printf('%.6f', xmax - least(xmin + 0.15::DOUBLE, xmax)) END AS reason
    FROM last)"""


@query("last_interval_report_w29", f"WITH {_REPAIR_SQL} SELECT utt, reason LIKE 'fixed_last:%' AS changed, reason FROM report")
def last_interval_report(spark, sf_dir):
    report = iv.last_interval_report(intervals(spark, sf_dir), "phones", 0.15, 0.12, [SILENCE])
    return report.select("utt", "changed", "reason")


@query(
    "last_interval_repair_w29",
    f"""WITH {_REPAIR_SQL}, cut AS (SELECT utt, idx, old_end, new_end FROM report WHERE reason LIKE 'fixed_last:%')
    SELECT i.utt, i.idx, round(i.xmin, 6) AS xmin, round(coalesce(c.new_end, i.xmax), 6) AS xmax, i.label FROM intervals i LEFT JOIN cut c USING (utt, idx)
    UNION ALL SELECT utt, idx + 1, round(new_end, 6), round(old_end, 6), 'view' FROM cut WHERE old_end - new_end > 1e-9""",
)
def last_interval_repair(spark, sf_dir):
    rows = intervals(spark, sf_dir)
    report = iv.last_interval_report(rows, "phones", 0.15, 0.12, [SILENCE])
    fixed = iv.repair_last_intervals(rows, report, SILENCE)
    return fixed.select("utt", "idx", F.round("xmin", 6).alias("xmin"), F.round("xmax", 6).alias("xmax"), "label")


@query(
    "inventory_a12",
    f"WITH {INTERVALS_SQL} SELECT DISTINCT label AS phone FROM intervals WHERE label NOT IN ('error', 'view')",
)
def inventory(spark, sf_dir):
    return iv.inventory(intervals(spark, sf_dir), "phones", [NOISE, SILENCE])


def noisy_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals in which only the errors with the highest k are noise; ``again`` is the label after a rerun."""
    kind, k = F.col("event_type"), F.col("k")
    noise = (kind == NOISE) & (k > 95)
    calm = F.when(kind == NOISE, "click").otherwise(kind)
    start = F.col("t") * 0.2
    return samples(spark, sf_dir).select(
        "utt", F.lit("phones").alias("tier"), F.col("t").alias("idx"), start.alias("xmin"), (start + 0.2).alias("xmax"),
        F.when(noise, NOISE).otherwise(calm).alias("label"),
        F.when(noise & (k % 2 == 1), NOISE).otherwise(calm).alias("again"),
    )


_NOISE_SQL = f"""{SAMPLES_SQL}, f AS (SELECT utt, bool_or(event_type = 'error' AND k > 95) AS noisy,
  bool_or(event_type = 'error' AND k > 95 AND k % 2 = 1) AS still FROM samples GROUP BY 1)"""


@query("noise_files_p8", f"WITH {_NOISE_SQL} SELECT utt, noisy AS found FROM f")
def noise_files(spark, sf_dir):
    return iv.has_label(noisy_intervals(spark, sf_dir), "phones", NOISE)


@query(
    "reprocess_set_j13",
    f"""WITH {_NOISE_SQL} SELECT utt, CASE WHEN NOT noisy THEN 'skipped' WHEN utt % 10 <> 0 AND NOT still THEN 'fixed' ELSE 'failed' END AS status FROM f""",
)
def reprocess_set(spark, sf_dir):
    """A rerun that clears noise with an even k; every tenth file has no number in its name."""
    rows = noisy_intervals(spark, sf_dir)
    name = F.when(F.col("utt") % 10 == 0, F.lit("tg_x.TextGrid")).otherwise(F.format_string("tg_%04d.TextGrid", "utt"))
    files = rows.select("utt").distinct().withColumn("path", name)
    before = iv.has_label(rows, "phones", NOISE)
    after = iv.has_label(rows.withColumn("label", F.col("again")), "phones", NOISE)
    return iv.reprocess_report(files, before, after)


def documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Annotation documents of sixteen utterances each, as tiers and intervals.

    Every utterance is a tier, the last first; two tiers of one name that end
    the document have no intervals, and documents start before their tiers.
    """
    rows = intervals(spark, sf_dir).select(
        F.floor(F.col("utt") / 16).alias("utt"), F.format_string("u%06d", "utt").alias("tier"), (15 - F.col("utt") % 16).cast("int").alias("place"),
        "idx", "xmin", "xmax", "label",
    )
    spoken = rows.groupBy("utt", "tier", "place").agg(F.min("xmin").alias("xmin"), F.max("xmax").alias("xmax"))
    bounds = spoken.groupBy("utt").agg((F.min("xmin") - 1).alias("doc_xmin"), (F.max("xmax") + 1).alias("doc_xmax"))
    silent = bounds.select(
        "utt", F.lit("noise").alias("tier"), F.explode(F.array(F.lit(16), F.lit(17))).alias("place"), F.col("doc_xmin").alias("xmin"), F.col("doc_xmax").alias("xmax")
    )
    number = F.row_number().over(Window.partitionBy("utt").orderBy("place")) - 1
    tiers = spoken.unionByName(silent).join(bounds, "utt").withColumn("tier_no", number)
    numbered = rows.join(tiers.select("utt", "place", "tier_no"), ["utt", "place"]).select("utt", "tier_no", "idx", "xmin", "xmax", "label")
    return tiers.select("utt", "doc_xmin", "doc_xmax", "tier_no", "tier", "xmin", "xmax"), numbered


_DOCS_SQL = f"""{INTERVALS_SQL}, spans AS (
  SELECT utt // 16 AS utt, printf('u%06d', utt) AS tier, 15 - utt % 16 AS place, min(xmin) AS lo, max(xmax) AS hi FROM intervals GROUP BY 1, 2, 3),
bounds AS (SELECT utt, min(lo) - 1 AS dlo, max(hi) + 1 AS dhi FROM spans GROUP BY 1),
tiers AS (SELECT utt, tier, lo, hi, dlo, dhi, (row_number() OVER (PARTITION BY utt ORDER BY place) - 1)::INT AS tier_no
  FROM (SELECT * FROM spans UNION ALL SELECT utt, 'noise', unnest([16, 17]), dlo, dhi FROM bounds) JOIN bounds USING (utt)),
docs AS (SELECT t.utt, t.tier_no, t.tier, i.idx, i.xmin, i.xmax, i.label
  FROM tiers t LEFT JOIN intervals i ON i.utt // 16 = t.utt AND printf('u%06d', i.utt) = t.tier)"""


def _fmt(x: str) -> str:
    return rf"regexp_replace(printf('%.6f', {x}), '\.?0+$', '')"


@query(
    "textgrid_lines_s12",
    f"""WITH {_DOCS_SQL}, sized AS (SELECT utt, tier_no, tier, lo, hi, (SELECT count(d.idx) FROM docs d WHERE d.utt = t.utt AND d.tier_no = t.tier_no) AS n FROM tiers t),
    files AS (SELECT utt, min(dlo) AS lo, max(dhi) AS hi, count(*) AS n FROM tiers GROUP BY 1),
    lines AS (
      SELECT utt, -1 AS tier_no, -1 AS idx, ['File type = "ooTextFile"', 'Object class = "TextGrid"', '', 'xmin = ' || {_fmt('lo')} || ' ',
        'xmax = ' || {_fmt('hi')} || ' ', 'tiers? <exists> ', 'size = ' || n || ' ', 'item []: '] AS l FROM files
      UNION ALL SELECT utt, tier_no, -1, ['    item [' || (tier_no + 1) || ']:', '        class = "IntervalTier" ', '        name = "' || tier || '" ',
        '        xmin = ' || {_fmt('lo')} || ' ', '        xmax = ' || {_fmt('hi')} || ' ', '        intervals: size = ' || n || ' '] FROM sized
      UNION ALL SELECT utt, tier_no, idx, ['        intervals [' || (idx + 1) || ']:', '            xmin = ' || {_fmt('xmin')} || ' ',
        '            xmax = ' || {_fmt('xmax')} || ' ', '            text = "' || label || '" '] FROM docs WHERE idx IS NOT NULL)
    SELECT utt, tier_no, idx, (unnest(range(len(l))))::INT AS k, unnest(l) AS line FROM lines""",
)
def textgrid_lines(spark, sf_dir):
    return textgrid.textgrid_lines(*documents(spark, sf_dir))


def _scanned(spark, sf_dir) -> DataFrame:
    """The corpus written as annotation files and scanned back."""
    path = scratch_path(spark, "textgrid")
    textgrid.write_textgrids(*documents(spark, sf_dir), path)
    return textgrid.read_textgrids(spark, f"{path}/utt=*")


@query(
    "textgrid_scan_s4",
    f"WITH {_DOCS_SQL} SELECT utt, tier_no, tier, idx, round(xmin, 6) AS xmin, round(xmax, 6) AS xmax, label FROM docs",
)
def textgrid_scan(spark, sf_dir):
    """All intervals as read back; a tier without any has one row of nulls."""
    rows = textgrid.document_intervals(_scanned(spark, sf_dir))
    utt = F.regexp_extract("path", r"utt=(\d+)", 1).cast("long")
    return rows.select(utt.alias("utt"), "tier_no", "tier", "idx", "xmin", "xmax", "label")


@query(
    "textgrid_tiers_s12",
    f"""WITH {_DOCS_SQL} SELECT utt, round(dlo, 6) AS doc_xmin, round(dhi, 6) AS doc_xmax, tier_no, tier, round(lo, 6) AS xmin, round(hi, 6) AS xmax FROM tiers""",
)
def textgrid_tiers(spark, sf_dir):
    """Bounds, order and names of all tiers as read back."""
    utt = F.regexp_extract("path", r"utt=(\d+)", 1).cast("long")
    return textgrid.document_tiers(_scanned(spark, sf_dir)).select(utt.alias("utt"), "doc_xmin", "doc_xmax", "tier_no", "tier", "xmin", "xmax")


@query(
    "textgrid_rejects_s4",
    f"""WITH {_DOCS_SQL}, kinds AS (SELECT DISTINCT utt, utt % 5 AS kind FROM tiers)
    SELECT utt, CASE kind WHEN 0 THEN 'not an annotation file' WHEN 1 THEN 'unsupported tier class TextTier'
      WHEN 2 THEN 'interval count mismatch' WHEN 3 THEN 'malformed interval' ELSE 'accepted' END AS verdict FROM kinds""",
)
def textgrid_rejects(spark, sf_dir):
    """Four documents of five are damaged, each in its own way."""
    path = scratch_path(spark, "textgrid")
    textgrid.write_textgrids(*documents(spark, sf_dir), path)
    files = spark.read.text(f"{path}/utt=*", wholetext=True)
    utt = F.regexp_extract(F.col("_metadata.file_path"), r"utt=(\d+)", 1).cast("long")
    kind, value = utt % 5, F.col("value")
    damaged = (
        F.when(kind == 0, F.replace(value, F.lit("Object class"), F.lit("Subject class")))
        .when(kind == 1, F.regexp_replace(value, "IntervalTier", "TextTier"))
        .when(kind == 2, F.regexp_replace(value, "intervals: size = ", "intervals: size = 9"))
        .when(kind == 3, F.regexp_replace(value, "text = ", "txt = "))
        .otherwise(value)
    )
    parsed = textgrid.parse_documents(files.select(utt.cast("string").alias("path"), damaged.alias("value")))
    return parsed.select(F.col("path").cast("long").alias("utt"), F.coalesce("error", F.lit("accepted")).alias("verdict"))
