"""Text normalisation and error-rate queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from speechlake.functions import edits, text
from speechlake.operators import evaluation
from speechlake.plans.corpus import PAIRS_SQL, documents, turn_pairs
from speechlake.plans.registry import query
from speechlake.sources.scratch import stored


def _per_document(spark: SparkSession, sf_dir: str, form: Callable[[Column], Column]) -> DataFrame:
    """Length and digest of a text form of every whole document."""
    docs = documents(spark, sf_dir).select("doc_id", form(F.col("text")).alias("made"))
    return docs.select("doc_id", F.length("made").alias("n"), F.md5("made").alias("digest"))


def _documents_sql(made: str, before: str = "") -> str:
    return f"""WITH {before} forms AS (SELECT doc_id, {made} AS made FROM documents)
    SELECT doc_id, CAST(length(made) AS INT) AS n, md5(made) AS digest FROM forms"""


def _strip_sql(x: str) -> str:
    return f"trim({x}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def _basic_sql(x: str) -> str:
    return f"trim(regexp_replace(replace(lower({x}), '-', ' '), '[^a-z ]+', '', 'g'))"


def _unicode_sql(x: str) -> str:
    kept = rf"regexp_replace(replace(lower({x}), '-', ' '), '[^\p{{L}}\p{{N}}\s]+', '', 'g')"
    return rf"trim(regexp_replace({kept}, '\s+', ' ', 'g'))"


_SPELLED_SQL = "strip_accents(text)"
for _letter, _spelled in text._SPELLED.items():
    _SPELLED_SQL = f"replace({_SPELLED_SQL}, '{_letter}', '{_spelled}')"


_CLEAN_SQL = rf"lower(regexp_replace({_SPELLED_SQL}, '[[:punct:]\p{{P}}]+', '', 'g'))"
# The alphabet has one kind of blank.
_SPACED_SQL = rf"regexp_replace({_CLEAN_SQL}, '\s', ' ', 'g')"


def _spaced(x):
    return F.regexp_replace(text.clean_text(x), r"\s", " ")


@query("clean_text_t1", _documents_sql(_CLEAN_SQL))
def clean_text(spark, sf_dir):
    return _per_document(spark, sf_dir, text.clean_text)


@query(
    "text_to_ids_t2",
    _documents_sql(
        f"""list_aggregate(list_transform(string_split({_SPACED_SQL}, ''),
        lambda c: instr('{text.ALPHABET}', c) - 1), 'string_agg', ',')"""
    ),
)
def text_to_ids(spark, sf_dir):
    return _per_document(spark, sf_dir, lambda t: F.array_join(text.text_to_ids(_spaced(t)), ","))


@query("ids_to_text_t2", _documents_sql(_SPACED_SQL))
def ids_to_text(spark, sf_dir):
    return _per_document(spark, sf_dir, lambda t: text.ids_to_text(text.text_to_ids(_spaced(t))))


def _digit_sql(place: int) -> str:
    digit = f"(CAST(x AS INT) // {10**place} % 10)"
    names = "[" + ", ".join(f"'{d}'" for d in text.DIGITS) + "]"
    if not place:
        return f"{names}[{digit} + 1]"
    return f"""CASE WHEN {digit} = 0 THEN '' WHEN {digit} = 1 THEN '{text.UNITS[place]}'
        ELSE {names}[{digit} + 1] || '{text.UNITS[place]}' END"""


_NUMBERS_SQL = f"""array_to_string(list_transform(regexp_extract_all(text, '[0-9]+|[^0-9]+'), lambda x:
    CASE WHEN x = '0' THEN '{text.ZERO}' WHEN regexp_full_match(x, '[1-9][0-9]{{0,3}}')
    THEN {' || '.join(_digit_sql(p) for p in (3, 2, 1, 0))} ELSE x END), '')"""


@query("spell_numbers_t3", _documents_sql(_NUMBERS_SQL))
def spell_numbers(spark, sf_dir):
    return _per_document(spark, sf_dir, text.spell_numbers)


def _letters_sql(x: str) -> str:
    opening = rf"""\s\(\[\{{"''“‘,.:;!?/\\{text.HANGUL_RANGES}"""
    closing = rf"""\s\)\]\}}"''”’,.:;!?/\\{text.HANGUL_RANGES}"""
    for letter, name in text.LETTERS.items():
        for _ in range(2):
            x = rf"regexp_replace({x}, '(^|[{opening}])[{letter}{letter.upper()}]($|[{closing}])', '\1{name}\2', 'g')"
    return x


@query("spell_letters_t4", _documents_sql(_letters_sql("text")))
def spell_letters(spark, sf_dir):
    return _per_document(spark, sf_dir, text.spell_letters)


@query("spell_percent_t5", _documents_sql(f"replace(replace(text, '％', '{text.PERCENT}'), '%', '{text.PERCENT}')"))
def spell_percent(spark, sf_dir):
    return _per_document(spark, sf_dir, text.spell_percent)


def _limit_sql(x: str) -> tuple[str, str]:
    """Word pass and character pass over the named expression ``x``."""
    before = rf"""parts AS (SELECT doc_id, regexp_extract_all(nfc_normalize({x}), '\s+|\S+') AS p FROM documents),
    worded AS (SELECT doc_id, string_split(array_to_string(list_filter(p, lambda w, i:
        NOT (coalesce(regexp_matches(w, '^\S') AND i > 6 AND p[i-2] = w AND p[i-4] = w AND p[i-6] = w, false))), ''), '') AS c
      FROM parts),
    documents_ AS (SELECT doc_id, array_to_string(list_filter(c, lambda w, i:
        NOT (coalesce(regexp_matches(w, '^\S') AND i > 3 AND c[i-1] = w AND c[i-2] = w AND c[i-3] = w, false))), '') AS text
      FROM worded),"""
    return before, _strip_sql("text")


def _limited_documents_sql(x: str) -> str:
    before, made = _limit_sql(x)
    return _documents_sql(made, before).replace("FROM documents)\n    SELECT", "FROM documents_)\n    SELECT")


@query("limit_repeats_t6", _limited_documents_sql("text"))
def limit_repeats(spark, sf_dir):
    return _per_document(spark, sf_dir, text.limit_repeats)


@query("canonical_form_t7", _documents_sql("nfc_normalize(text)"))
def canonical_form(spark, sf_dir):
    """Decomposed and composed again: equals the composed form of the original."""
    return _per_document(spark, sf_dir, lambda t: text.nfc(text.nfd(t)))


@query("alignment_text_t8", _documents_sql(_strip_sql(r"regexp_replace(text, '[^\p{L}\p{N}_\s]+', '', 'g')")))
def alignment_text(spark, sf_dir):
    return _per_document(spark, sf_dir, text.alignment_text)


@query("normalize_basic_t9", _documents_sql(_basic_sql("text")))
def normalize_basic(spark, sf_dir):
    return _per_document(spark, sf_dir, text.normalize_basic)


@query("normalize_unicode_t10", _documents_sql(_unicode_sql("strip_accents(text)")))
def normalize_unicode(spark, sf_dir):
    return _per_document(spark, sf_dir, lambda t: text.normalize_unicode(text.nfd(t)))


@query(
    "adaptive_form_t11",
    _documents_sql(
        "CASE WHEN length(b) >= greatest(2, length(u) // 2) THEN b ELSE u END",
        f"""documents_ AS (SELECT doc_id, {_basic_sql('strip_accents(text)')} AS b,
            {_unicode_sql('strip_accents(text)')} AS u FROM documents),""",
    ).replace("FROM documents)\n    SELECT", "FROM documents_)\n    SELECT"),
)
def adaptive_form(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text", F.col("text").alias("same"))
    chosen = evaluation.scored_forms(docs, "same", "text")
    return chosen.select("doc_id", F.length("text").alias("n"), F.md5("text").alias("digest"))


# Forms of both texts of a pair as they are scored.
_SCORED_SQL = f"""{PAIRS_SQL}, forms AS (
  SELECT conv_id, turn, {_basic_sql('strip_accents(prediction)')} AS pb, {_basic_sql('strip_accents(target)')} AS tb,
         {_unicode_sql('strip_accents(prediction)')} AS pu, {_unicode_sql('strip_accents(target)')} AS tu FROM pairs),
scored AS (
  SELECT conv_id, turn, CASE WHEN keep THEN pb ELSE pu END AS p, CASE WHEN keep THEN tb ELSE tu END AS t
  FROM (SELECT *, length(tb) >= greatest(2, length(tu) // 2) AS keep FROM forms)),
listed AS (
  SELECT *, list_filter(string_split(p, ' '), lambda w: w <> '') AS pw, list_filter(string_split(t, ' '), lambda w: w <> '') AS tw
  FROM scored),
coded AS (
  SELECT *, array_to_string(list_transform(pw, lambda w: chr(coalesce(list_position(tw, w), 127)::INT)), '') AS pc,
         array_to_string(list_transform(tw, lambda w: chr(list_position(tw, w)::INT)), '') AS tc
  FROM listed),
counts AS (
  SELECT conv_id, turn,
         CAST(levenshtein(p, t) AS INT) AS char_err, CAST(greatest(length(t), 1) AS INT) AS char_len,
         CAST(levenshtein(replace(p, ' ', ''), replace(t, ' ', '')) AS INT) AS char_ns_err,
         CAST(greatest(length(replace(t, ' ', '')), 1) AS INT) AS char_ns_len,
         CAST(levenshtein(pc, tc) AS INT) AS word_err, CAST(greatest(len(tw), 1) AS INT) AS word_len
  FROM coded)"""


@query("char_distance_t12", f"WITH {_SCORED_SQL} SELECT conv_id, turn, char_err, char_ns_err FROM counts")
def char_distance(spark, sf_dir):
    scored = evaluation.scored_forms(turn_pairs(spark, sf_dir), "prediction", "target")
    p, t = F.col("prediction"), F.col("target")
    return scored.select(
        "conv_id",
        "turn",
        edits.char_distance(p, t).alias("char_err"),
        edits.char_distance(edits.without_space(p), edits.without_space(t)).alias("char_ns_err"),
    )


@query("word_distance_t13", f"WITH {_SCORED_SQL} SELECT conv_id, turn, word_err FROM counts")
def word_distance(spark, sf_dir):
    scored = evaluation.scored_forms(turn_pairs(spark, sf_dir), "prediction", "target")
    return scored.select("conv_id", "turn", edits.word_distance(F.col("prediction"), F.col("target")).alias("word_err"))


# The distance table as a list of rows, then the way back one step at a time.
_SCRIPT_SQL = f"""{PAIRS_SQL}, forms AS (SELECT {_basic_sql('prediction')} AS p, {_basic_sql('target')} AS t FROM pairs),
listed AS (
  SELECT row_number() OVER () AS pair, list_filter(string_split(p, ' '), lambda w: w <> '') AS p, list_filter(string_split(t, ' '), lambda w: w <> '') AS t
  FROM forms),
tables AS (SELECT pair, p, t, list_reduce(list_transform(range(1, len(p) + 1), lambda i: [[i]]), lambda a, e:
    list_append(a, list_reduce(range(1, len(t) + 1), lambda row, j:
      list_append(row, least(a[-1][j + 1] + 1, row[j] + 1, a[-1][j] + (p[e[1][1]] <> t[j])::BIGINT)), [e[1][1]])),
    [range(0, len(t) + 1)]) AS d FROM listed),
back AS (
  SELECT pair, len(p) AS i, len(t) AS j, NULL::INT AS op FROM listed
  UNION ALL
  SELECT pair, CASE WHEN crossed OR up THEN i - 1 ELSE i END, CASE WHEN crossed OR NOT up THEN j - 1 ELSE j END,
    CASE WHEN same THEN 0 WHEN crossed THEN 1 END
  FROM (SELECT b.pair, i, j, p[i] = t[j] AS same, p[i] = t[j] OR d[i + 1][j + 1] = d[i][j] + 1 AS crossed, d[i + 1][j + 1] = d[i][j + 1] + 1 AS up
    FROM back b JOIN tables USING (pair) WHERE i > 0 AND j > 0)),
both_sides AS (SELECT op, count(*) AS n FROM back WHERE op IS NOT NULL GROUP BY 1),
alone AS (SELECT sum(len(p)) AS p, sum(len(t)) AS t, (SELECT coalesce(sum(n), 0) FROM both_sides) AS met FROM listed),
totals AS (
  SELECT side, op, n FROM both_sides, (VALUES ('prediction'), ('target')) s(side)
  UNION ALL SELECT 'prediction', 2, p - met FROM alone UNION ALL SELECT 'target', 3, t - met FROM alone)"""


@query("edit_script_t14", f"WITH RECURSIVE {_SCRIPT_SQL} SELECT side, op::INT AS op, n::BIGINT AS n FROM totals WHERE n > 0")
def edit_script(spark, sf_dir):
    """Corpus totals of the operations that turn the prediction into the target."""
    pairs = turn_pairs(spark, sf_dir).select(
        edits.edit_script(
            edits.words(text.normalize_basic(F.col("prediction"))), edits.words(text.normalize_basic(F.col("target")))
        ).alias("s")
    )
    ops = pairs.select(
        F.inline(
            F.array(
                F.struct(F.lit("prediction").alias("side"), F.col("s.x").alias("ops")),
                F.struct(F.lit("target").alias("side"), F.col("s.y").alias("ops")),
            )
        )
    ).select("side", F.explode_outer("ops").alias("op")).where("op IS NOT NULL")
    return ops.groupBy("side", "op").agg(F.count(F.lit(1)).alias("n"))


_PUNCT_SQL = lambda x: _strip_sql(rf"regexp_replace(regexp_replace({x}, '\p{{P}}+', '', 'g'), '  +', ' ', 'g')")


def _char_codes_sql(x: str) -> str:
    """One byte per character, as the SQL distance counts bytes."""
    return f"array_to_string(list_transform(string_split({x}, ''), lambda c: chr(coalesce(list_position(abc, c), 127)::INT)), '')"


@query(
    "punctuation_free_rates_t15",
    f"""WITH {PAIRS_SQL}, plain AS (
      SELECT strip_accents(prediction) AS prediction, strip_accents(target) AS target FROM pairs),
    forms AS (SELECT {_PUNCT_SQL('prediction')} AS p, {_PUNCT_SQL('target')} AS t FROM plain),
    listed AS (SELECT *, regexp_extract_all(p, '\\S+') AS pw, regexp_extract_all(t, '\\S+') AS tw,
      regexp_replace(p, '\\s', '', 'g') AS pn, regexp_replace(t, '\\s', '', 'g') AS tn FROM forms),
    coded AS (
      SELECT *, array_to_string(list_transform(pw, lambda w: chr(coalesce(list_position(tw, w), 127)::INT)), '') AS pc,
             array_to_string(list_transform(tw, lambda w: chr(list_position(tw, w)::INT)), '') AS tc,
             list_distinct(string_split(t, '')) AS abc FROM listed)
    SELECT round(sum(levenshtein({_char_codes_sql('p')}, {_char_codes_sql('t')})) / sum(length(t)), 6) AS cer,
           round(sum(levenshtein({_char_codes_sql('pn')}, {_char_codes_sql('tn')})) / sum(length(tn)), 6) AS cer_wo_space,
           round(sum(levenshtein(pc, tc)) / sum(len(tw)), 6) AS wer
    FROM coded""",
)
def punctuation_free_rates(spark, sf_dir):
    """Rates over texts without punctuation; micro-averaged over the pairs."""
    plain = lambda c: text.fold_accents(F.col(c))
    forms = turn_pairs(spark, sf_dir).select(
        text.drop_punctuation(plain("prediction")).alias("p"), text.drop_punctuation(plain("target")).alias("t")
    )
    p, t = F.col("p"), F.col("t")
    solid = lambda c: F.regexp_replace(c, r"(?U)\s", "")
    counts = forms.select(
        edits.char_distance(p, t).alias("ce"),
        F.length(t).alias("cl"),
        edits.char_distance(solid(p), solid(t)).alias("ne"),
        F.length(solid(t)).alias("nl"),
        edits.word_distance(p, t).alias("we"),
        F.size(edits.words(t)).alias("wl"),
    )
    return counts.agg(
        F.round(F.sum("ce") / F.sum("cl"), 6).alias("cer"),
        F.round(F.sum("ne") / F.sum("nl"), 6).alias("cer_wo_space"),
        F.round(F.sum("we") / F.sum("wl"), 6).alias("wer"),
    )


@query("error_counts_a6", f"WITH {_SCORED_SQL} SELECT * FROM counts")
def error_counts(spark, sf_dir):
    return evaluation.error_counts(turn_pairs(spark, sf_dir))


_RATES = "round(sum(char_err) / sum(char_len), 6) AS cer, round(sum(char_ns_err) / sum(char_ns_len), 6) AS cer_wo_space, round(sum(word_err) / sum(word_len), 6) AS wer"


@query(
    "error_rates_a7",
    f"WITH {_SCORED_SQL} SELECT CAST(conv_id % 16 AS INT) AS session, {_RATES} FROM counts GROUP BY 1",
)
def error_rates(spark, sf_dir):
    counts = evaluation.error_counts(turn_pairs(spark, sf_dir)).withColumn("session", (F.col("conv_id") % 16).cast("int"))
    rates = evaluation.error_rates(counts, "session")
    return rates.select("session", *[F.round(c, 6).alias(c) for c in ("cer", "cer_wo_space", "wer")])


@query(
    "report_line_t19",
    f"""WITH {_SCORED_SQL} SELECT printf('CER: %.2f%%, CER without space: %.2f%%, WER: %.2f%%',
      sum(char_err) / sum(char_len) * 100, sum(char_ns_err) / sum(char_ns_len) * 100,
      sum(word_err) / sum(word_len) * 100) AS report FROM counts""",
)
def report_line(spark, sf_dir):
    rates = evaluation.error_rates(evaluation.error_counts(turn_pairs(spark, sf_dir)))
    return rates.select(
        F.concat(
            F.lit("CER: "), text.percent(F.col("cer")), F.lit("%, CER without space: "),
            text.percent(F.col("cer_wo_space")), F.lit("%, WER: "), text.percent(F.col("wer")), F.lit("%"),
        ).alias("report")
    )


def _postprocess_sql() -> str:
    """All four steps in order, then the test for what is left."""
    before, made = _limit_sql("text")
    percent = f"replace(replace(text, '％', '{text.PERCENT}'), '%', '{text.PERCENT}')"
    steps = f"""numbered AS (SELECT doc_id, {_NUMBERS_SQL} AS text FROM documents),
    lettered AS (SELECT doc_id, {_letters_sql('text')} AS text FROM numbered),
    spelled AS (SELECT doc_id, {percent} AS text FROM lettered),"""
    return f"""WITH {steps} {before.replace("FROM documents)", "FROM spelled)")}
    forms AS (SELECT doc_id, {made} AS made FROM documents_)
    SELECT doc_id, md5(made) AS digest, regexp_matches(made, '[^{text.HANGUL_RANGES}\\s]') AS flagged FROM forms"""


@query("postprocess_chain_p7", _postprocess_sql())
def postprocess_chain(spark, sf_dir):
    """Post-processed documents and whether foreign characters are left in them.

    A flag, not a filter: a filter would be pushed below the steps and repeat them.
    """
    docs = documents(spark, sf_dir).select("doc_id", F.col("text").alias("made"))
    docs = evaluation.postprocess(docs, "made")
    return docs.select("doc_id", F.md5("made").alias("digest"), text.foreign_in_composed(F.col("made")).alias("flagged"))


@query(
    "foreign_chars_p7",
    rf"""SELECT doc_id, regexp_matches(nfc_normalize(text), '[^{text.HANGUL_RANGES}\s]') AS flagged FROM documents
    UNION ALL SELECT doc_id, regexp_matches(regexp_replace(text, '\S', '가', 'g'), '[^{text.HANGUL_RANGES}\s]') FROM documents""",
)
def foreign_chars(spark, sf_dir):
    """The predicate on every document and on its all-Hangul shadow."""
    docs = documents(spark, sf_dir)
    shadow = docs.withColumn("text", F.regexp_replace("text", r"\S", "가"))
    return docs.unionByName(shadow).select("doc_id", text.has_foreign_chars(F.col("text")).alias("flagged"))


def _chain_sql() -> str:
    """The recognised side of every pair post-processed, then scored."""
    before, made = _limit_sql("text")
    percent = f"replace(replace(text, '％', '{text.PERCENT}'), '%', '{text.PERCENT}')"
    steps = f"""heard AS (SELECT conv_id * 1000 + turn AS doc_id, prediction AS text FROM raw),
    numbered AS (SELECT doc_id, {_NUMBERS_SQL} AS text FROM heard),
    lettered AS (SELECT doc_id, {_letters_sql('text')} AS text FROM numbered),
    spelled AS (SELECT doc_id, {percent} AS text FROM lettered),"""
    return f"""{PAIRS_SQL.replace("pairs AS (", "raw AS (", 1)}, {steps} {before.replace("FROM documents)", "FROM spelled)")}
    spoken AS (SELECT doc_id, {made} AS made FROM documents_),
    pairs AS (SELECT conv_id, turn, target, made AS prediction FROM raw JOIN spoken ON doc_id = conv_id * 1000 + turn){_SCORED_SQL[len(PAIRS_SQL):]}"""


@query(
    "evaluation_chain_a7",
    f"""WITH {_chain_sql()}, rated AS (SELECT CAST(conv_id % 16 AS INT) AS session, sum(char_err) / sum(char_len) AS c,
      sum(char_ns_err) / sum(char_ns_len) AS n, sum(word_err) / sum(word_len) AS w FROM counts GROUP BY 1)
    SELECT session, round(c, 6) AS cer, round(n, 6) AS cer_wo_space, round(w, 6) AS wer,
      printf('CER: %.2f%%, CER without space: %.2f%%, WER: %.2f%%', c * 100, n * 100, w * 100) AS report FROM rated""",
)
def evaluation_chain(spark, sf_dir):
    """Recognised text to report: post-processing, counts, rates and the line, per session."""
    # Written out, so each form of a text is made from it once.
    spoken = stored(evaluation.postprocess(turn_pairs(spark, sf_dir), "prediction"), "spoken")
    counts = evaluation.error_counts(spoken).withColumn("session", (F.col("conv_id") % 16).cast("int"))
    rates = evaluation.error_rates(counts, "session")
    line = F.concat(
        F.lit("CER: "), text.percent(F.col("cer")), F.lit("%, CER without space: "),
        text.percent(F.col("cer_wo_space")), F.lit("%, WER: "), text.percent(F.col("wer")), F.lit("%"),
    )
    return rates.select("session", *[F.round(c, 6).alias(c) for c in ("cer", "cer_wo_space", "wer")], line.alias("report"))
