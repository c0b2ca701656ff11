from __future__ import annotations

import io
import json
import wave
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from speechlake.operators import manifest
from speechlake.sources import arrayfiles, scratch, tables, textgrid
from speechlake.streaming import running

INTERVALS = "utt int, tier string, idx int, xmin double, xmax double, label string"


def test_manifest_of_files(spark, tmp_path):
    names = {
        "voiced/s1/data/emg/emg_0012.wav_x.npz": ("voiced", "s1", 12, 12),
        "silent/s1/data/emg/emg_b_7.npz": ("silent", "s1", 7, 7),
        "silent/s2/data/emg/emg.npz": None,
    }
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    (tmp_path / "silent/s1/data/emg/readme.txt").write_text("no")
    for style, at in (("split", 2), ("index", 3)):
        rows = tables.scan_manifest(spark, str(tmp_path), style=style).collect()
        assert {(r.data_type, r.session, r.data_num) for r in rows} == {(v[0], v[1], v[at]) for v in names.values() if v}
        assert all(r.length == 1 and r.modality == "emg" for r in rows)
    assert [r.session for r in tables.sessions(tables.scan_manifest(spark, str(tmp_path))).collect()] == ["s1"]


def test_files_are_listed_by_tasks(spark, tmp_path):
    for name in ("a/b/1.npz", "a/b/_x.npz", "a/.c/2.npz", "key=1/_p=2/3.npz", "4.npz", "a/5.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * 3)
    for root in (str(tmp_path), f"file://{tmp_path}/"):
        rows = arrayfiles.list_files(spark, root, "*.npz").collect()
        assert {r.path.split(tmp_path.name + "/")[1] for r in rows} == {"a/b/1.npz", "key=1/_p=2/3.npz", "4.npz"}
        assert all(r.length == 3 for r in rows)
    assert arrayfiles.list_files(spark, str(tmp_path / "4.npz")).count() == 1


@pytest.mark.parametrize("name, label", [("manifest_scan_s1", "corpus"), ("transcript_files_s6", "transcript-files")])
def test_a_file_does_not_cost_a_folder(spark, name, label):
    rows = entry.queries()[name](spark, "/root/testdata/sf0.01").count()
    root = Path(next(p for p in reversed(scratch._made[spark.sparkContext.applicationId]) if f"/{label}-" in p).removeprefix("file:"))
    found = list(root.rglob("*"))
    assert sum(f.is_dir() for f in found) < rows / 3 and sum(f.is_file() and f.name[0] not in "._" for f in found) == rows


def test_paths(spark):
    df = spark.createDataFrame([("out/valid/silent/s1/12_emg.npy",)], "path string")
    assert tuple(manifest.keys_from_feature_path(df).first()) == ("out/valid/silent/s1/12_emg.npy", "valid", "silent", "s1", "12")
    df = spark.createDataFrame([("w/silent/3-4_0012.wav",)], "path string")
    assert tuple(manifest.keys_from_wav_name(df).first())[1:] == ("silent", "3-4", "0012")
    assert manifest.parse_split_filter(" * ") is None and manifest.parse_split_filter("") is None
    assert manifest.parse_split_filter("a, b,") == {"a", "b"} and manifest.parse_split_filter(["x"]) == {"x"}


def test_best_run_tiers(spark):
    rows = [
        ("new", "r/new/01-0.5000.ckpt"), ("new", "r/new/02-0.9000.ckpt"), ("new", "r/new/03-0.9000.ckpt"),
        ("new", "r/new/epoch=9-val_phone_accuracy=0.99_1.ckpt"),
        ("acc", "r/acc/epoch=1-val_phone_accuracy=0.4_1.ckpt"), ("acc", "r/acc/epoch=2-val_phone_accuracy=0.6_1.ckpt"),
        ("acc", "r/acc/epoch=3-val_loss=0.1_1.ckpt"),
        ("loss", "r/loss/epoch=1-val_loss=0.4_1.ckpt"), ("loss", "r/loss/epoch=2-val_loss=0.2_1.ckpt"),
        ("none", "r/none/last.ckpt"), ("none", "r/none/epoch=1-val_loss=0.2.ckpt"),
    ]
    runs = spark.createDataFrame(rows, "exp_name string, path string")
    made = {r.exp_name: r.path for r in manifest.best_run(runs).collect()}
    assert made == {
        "new": "r/new/02-0.9000.ckpt", "acc": "r/acc/epoch=2-val_phone_accuracy=0.6_1.ckpt",
        "loss": "r/loss/epoch=2-val_loss=0.2_1.ckpt", "none": None,
    }


def test_lookups(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    right = spark.createDataFrame([(1, "p")], "k int, path string")
    with pytest.raises(Exception, match="path not found for"):
        manifest.mandatory_lookup(left, right, ["k"], "path").collect()
    assert manifest.unmatched(left, right, ["k"]).collect() == [(2,)]
    empty = right.where("false")
    assert manifest.fallback_relation(empty, right).count() == 1
    done = spark.createDataFrame([(1, 0), (2, 5)], "k int, length int")
    assert manifest.pending(left, done, ["k"]).collect() == [(1,)]


@pytest.mark.parametrize("doc", ['["a", "b"]', '{"phonemes": ["a", "b"], "count": 2}', '["a", "b", "sil"]'])
def test_phoneme_set_forms(spark, tmp_path, doc):
    (tmp_path / "p.json").write_text(doc)
    rows = tables.read_phoneme_set(spark, str(tmp_path / "p.json")).orderBy("phone_id").collect()
    assert [r.phone for r in rows] == ["a", "b", "sil"]


def test_phoneme_set_of_another_form(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"x": 1}')
    with pytest.raises(Exception, match="unsupported phoneme set"):
        tables.read_phoneme_set(spark, str(tmp_path / "p.json")).collect()


def test_transcript_files(spark, tmp_path):
    (tmp_path / "0001_info.json").write_text(json.dumps({"text": "가 나", "x": 1}, indent=1))
    rows = tables.read_transcripts(spark, str(tmp_path)).collect()
    assert rows[0].text == "가 나" and rows[0].path.endswith("0001_info.json")
    (tmp_path / "0001_info.json").write_text('[{"text": "a"}, {"text": "b"}]')
    (tmp_path / "broken.json").write_text('{"text": ')
    assert sorted(str(r.text) for r in tables.read_transcripts(spark, str(tmp_path)).collect()) == ["None", "a", "b"]


def test_metadata_lines(spark, tmp_path):
    (tmp_path / "m.txt").write_text('LJ/x-1.wav|He said "Hi-there|he said\n\nLJ/x-2.wav|b|b\n')
    rows = tables.metadata_texts(tables.read_metadata(spark, str(tmp_path / "m.txt"))).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [("x-1.wav", "he said hi there"), ("x-2.wav", "b")]


def test_empty_and_missing_texts_and_names_equal_sql(spark, tmp_path):
    texts = ["", None, " ", "|", "\n", "\x00", "\x00a|b\x00 c", '"', '"a|b', "\\|a", "#a", "a\r\nb", "-", "\u0130 \u212a", "plain"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, ""), (None, None), (None, "a b")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in entry.queries()["metadata_s3"](spark, str(tmp_path)).select("id", "text").collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(entry.oracle_sql()["metadata_s3"]).fetchall()
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert dict(got)["0.wav"] == "" and dict(got)["1.wav"] is None


def test_cut_off_log(spark):
    lines = ["trgt0 s1 12: a  b", "pred0 s1 12: a c", "0 sample cer: 1.00, wer: 2.00", "trgt1 s1 13: x"]
    df = spark.createDataFrame([(v,) for v in lines], "value string")
    assert [tuple(r) for r in tables.parse_eval_log(df).collect()] == [(0, "s1", "12", "a b", "a c")]


def test_array_files(spark, tmp_path):
    x = np.arange(24, dtype=np.float32).reshape(12, 2)
    np.savez(tmp_path / "a.npz", data=x, other=x[:1])
    np.save(tmp_path / "b.npy", x[:, 0])
    files = arrayfiles.read_binary(spark, str(tmp_path), "*.np*")
    rows = arrayfiles.decode_arrays(files).orderBy("path", "t").collect()
    assert np.array_equal([r.x for r in rows[:12]], x) and [r.x for r in rows[12:]] == [[float(v)] for v in x[:, 0]]


def test_files_are_written_by_tasks_and_replace_themselves(spark, tmp_path):
    rows = [(f"a={i % 3}/{i}.bin", bytearray([i])) for i in range(20)]
    df = spark.createDataFrame(rows, "path string, content binary").repartition(4)
    for root in (f"{tmp_path}/x", f"file://{tmp_path}/x"):
        assert arrayfiles.write_binary(df, root) == 20
    found = arrayfiles.read_binary(spark, f"{tmp_path}/x", "*.bin").collect()
    assert {r.path.split("/x/")[1]: r.content for r in found} == dict(rows) and len(found) == 20
    assert arrayfiles.write_binary(df.limit(0), f"{tmp_path}/y") == 0


def test_sound_files(spark):
    out = io.BytesIO()
    with wave.open(out, "wb") as sound:
        sound.setnchannels(1)
        sound.setsampwidth(2)
        sound.setframerate(8000)
        sound.writeframes(np.array([0, 16384, -32768], dtype="<i2").tobytes())
    files = spark.createDataFrame([("x.wav", bytearray(out.getvalue()))], "path string, content binary")
    assert [r.value for r in arrayfiles.decode_wav(files).orderBy("t").collect()] == [0.0, 0.5, -1.0]
    with pytest.raises(Exception, match="rate 8000 is not 16000"):
        arrayfiles.decode_wav(files, 16000).collect()


def test_textgrid_round_trip(spark, tmp_path):
    rows = [
        (1, "phones", 0, 0.0, 1.49, "tɕ"), (1, "phones", 1, 1.49, 6.838125, ""), (1, "words", 0, 0.0, 6.838125, "가 나"),
        (20, "phones", 0, 0.0, 2.0, "a"),
    ] + [(3, "phones", i, i / 10, (i + 1) / 10, f"p{i}") for i in range(50)] + [(3, "words", i, i / 10, (i + 1) / 10, f"w{i}") for i in range(50)]
    df = spark.createDataFrame(rows, INTERVALS)
    tiers = textgrid.tiers_of(df)
    numbered = df.join(tiers.select("utt", "tier", "tier_no"), ["utt", "tier"])
    textgrid.write_textgrids(tiers, numbered, str(tmp_path / "named"))
    parsed = textgrid.read_textgrids(spark, str(tmp_path / "named" / "utt=*"))
    back = textgrid.document_intervals(parsed).select(
        F.regexp_extract("path", r"utt=(\d+)", 1).cast("int"), "tier", "idx", "xmin", "xmax", "label"
    )
    assert textgrid.rejected_documents(parsed).count() == 0
    assert sorted(tuple(r) for r in back.collect()) == sorted(rows)


def test_textgrid_keeps_order_bounds_and_empty_tiers(spark, tmp_path):
    heads = [(1, -1.0, 9.0, 0, "words", 0.0, 9.0), (1, -1.0, 9.0, 1, "phones", -1.0, 8.5), (1, -1.0, 9.0, 2, "words", 0.0, 9.0), (2, 0.0, 1.0, 0, "x", 0.0, 1.0)]
    rows = [(1, 0, i, i / 10, (i + 1) / 10, f"w{i}") for i in range(90)] + [(1, 2, 0, 0.0, 9.0, "again")]
    tiers = spark.createDataFrame(heads, "utt int, doc_xmin double, doc_xmax double, tier_no int, tier string, xmin double, xmax double")
    df = spark.createDataFrame(rows, "utt int, tier_no int, idx int, xmin double, xmax double, label string").repartition(7)
    textgrid.write_textgrids(tiers, df, str(tmp_path / "docs"))
    assert [len(list((tmp_path / "docs" / f"utt={u}").glob("part-*"))) for u in (1, 2)] == [1, 1]
    parsed = textgrid.read_textgrids(spark, str(tmp_path / "docs" / "utt=*"))
    assert textgrid.rejected_documents(parsed).count() == 0
    utt = F.regexp_extract("path", r"utt=(\d+)", 1).cast("int").alias("utt")
    back = textgrid.document_tiers(parsed).select(utt, "doc_xmin", "doc_xmax", "tier_no", "tier", "xmin", "xmax")
    assert sorted(tuple(r) for r in back.collect()) == sorted(heads)
    read = textgrid.document_intervals(parsed).where("idx is not null").select(utt, "tier_no", "idx", "xmin", "xmax", "label")
    assert sorted(tuple(r) for r in read.collect()) == sorted(rows)


GOOD = """File type = "ooTextFile"
Object class = "TextGrid"

xmin = 0 
xmax = 2 
tiers? <exists> 
size = 1 
item []: 
    item [1]:
        class = "IntervalTier" 
        name = "phones" 
        xmin = 0 
        xmax = 2 
        intervals: size = 1 
        intervals [1]:

            xmin = 0 
            xmax = 2 
            text = "a "b" c" 
"""


@pytest.mark.parametrize(
    "old,new,error",
    [
        ("x", "x", None), ('"TextGrid"', '"Sound"', "not an annotation file"), ("xmax = 2 \ntiers", "tiers", None),
        ("IntervalTier", "TextTier", "unsupported tier class TextTier"), ("intervals: size = 1", "intervals: size = 2", "interval count mismatch"),
        ("            xmax = 2", "            ymax = 2", "malformed interval"), ("    item [1]:\n", "", "no tiers"),
        ("size = 1 \nitem", "item", "no tier count"), ('        name = "phones" \n', "", "malformed tier: class, name, xmin or xmax is missing"),
    ],
)
def test_textgrid_rejects(spark, old, new, error):
    df = spark.createDataFrame([("p", GOOD.replace(old, new))], "path string, value string")
    parsed = textgrid.parse_documents(df)
    assert parsed.first().error == error
    if error is None:
        rows = textgrid.document_intervals(parsed).collect()
        assert [(r.tier, r.idx, r.xmin, r.xmax, r.label) for r in rows] == [("phones", 0, 0.0, 2.0, 'a "b" c')]


def test_stream_in_batches_equals_batch(spark, tmp_path):
    events = spark.createDataFrame([(i % 3, float(i)) for i in range(90)], "k int, v double")
    for part in range(3):
        events.where(f"v % 3 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = running.file_stream(spark, str(tmp_path / "in"), events.schema, files_per_batch=1)
    made = {r.k: (r.n, r.mean, r["std"]) for r in running.run_updated(running.running_moments(stream, "k", "v"), ["k"], "t").collect()}
    want = {r.k: (r.n, r.mean, r["std"]) for r in running.running_moments(events, "k", "v").collect()}
    assert made.keys() == want.keys() and all(np.allclose(made[k], want[k]) for k in want)


def test_results_are_appended_in_percent(spark, tmp_path):
    rates = spark.createDataFrame([("e", 59, "valid", 0.19861, 0.2025, 0.54472)], "exp_name string, ckpt_epoch int, split string, cer double, cer_wo_space double, wer double")
    for _ in range(2):
        tables.append_results(rates, str(tmp_path / "r"))
    assert [tuple(r) for r in tables.read_results(spark, str(tmp_path / "r")).collect()] == [("e", 59, "valid", 19.86, 20.25, 54.47)] * 2
