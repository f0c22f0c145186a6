"""Envelope peaks, requests, notes, digests, answers, files, events and bounded calls."""

import json
import struct
import wave
import zlib
from io import BytesIO

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_diagnosis import FS, RPM, impulses, slow_prominence, whole
from tremolo import config
from tremolo.functions import kernels
from tremolo.operators import features, model, report, sessions, verdict
from tremolo.operators import signals as sig
from tremolo.sources import download, mat
from tremolo.sources import signals as files


def test_envelope_peaks_stand_out():
    t = np.arange(12000) / FS
    base = features.frequencies(RPM)
    x = (1 + 0.5 * np.sin(2 * np.pi * base["bpfi"] * t)) * np.sin(2 * np.pi * 3500 * t)
    for signal in (x, impulses(base["bpfo"])):
        e = features.envelope(signal, FS, RPM)
        freq, mag = kernels.envelope_spectrum(kernels.bandpass(signal, FS)[0], FS)
        found = [(p["nearest_peak"], p["peak_amplitude"]) for p in e["characteristic_peaks"]] + [(p["frequency"], p["amplitude"]) for p in e["envelope_peaks"]]
        assert found and e["characteristic_frequencies"]["bsf_2x"] == round(2 * base["bsf"], 4)
        for f, a in found:
            k = int(np.abs(freq - f).argmin())
            assert slow_prominence(mag, k) >= config.PROMINENCE_RATIO * mag.max() and a == round(float(mag[k]), 12)
    assert [p["label"] for p in features.envelope(x, FS, RPM)["characteristic_peaks"]] == ["BPFI"]


def plain_filter(b, a, x, state):
    out = []
    for v in x:
        y = b[0] * v + state[0]
        state = np.append(state[1:], 0) + b[1:] * v - a[1:] * y
        out.append(y)
    return np.array(out)


def test_filter_equals_the_plain_recursion():
    rng = np.random.default_rng(1)
    for low, high in ((0.33, 0.83), (0.1, 0.3), (0.05, 0.1), (0.01, 0.99), (0.001, 0.003)):
        for b, a in kernels.butter_sections(low, high):
            assert (np.abs(np.roots(a)) < 1).all()
            for n in (1, 63, 64, 1000):
                x, z = rng.normal(size=n), rng.normal(size=2)
                want = plain_filter(b, a, x, z)
                assert np.abs(kernels._run(b, a, x, z) - want).max() < 1e-9 * max(1, np.abs(want).max())


def test_zero_phase_equals_the_whole_polynomial():
    rng = np.random.default_rng(2)
    sections = kernels.butter_sections(0.33, 0.83)
    b, a = whole(sections)
    x = rng.normal(size=700) + 3
    n, pad = len(a) - 1, 3 * len(a)
    companion = np.zeros((n, n))
    companion[0] = -a[1:]
    companion[np.arange(1, n), np.arange(n - 1)] = 1
    start = np.linalg.solve(np.eye(n) - companion.T, b[1:] - a[1:] * b[0])
    ext = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    y = plain_filter(b, a, ext, start * ext[0])[::-1]
    want = plain_filter(b, a, y, start * y[0])[::-1][pad:-pad]
    assert np.abs(kernels.zero_phase(sections, x) - want).max() < 1e-10


def test_requests_need_finite_numbers(spark):
    bad = [float("nan"), float("inf"), -1.0, 0.0, None]
    rows = [(k, "n", "a", FS, v) for k, v in enumerate(bad)] + [(10 + k, "n", "a", v, RPM) for k, v in enumerate(bad)] + [(20, " ", "a", FS, RPM), (21, "n", None, FS, RPM), (30, "n", "a", FS, RPM)]
    df = spark.createDataFrame(rows, "request_id long, normal_id string, abnormal_id string, sampling_rate double, rotation_speed double")
    assert [r.request_id for r in df.where(verdict.well_formed()).collect()] == [30]


def test_rate_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(sig, "BLOCK", 8)
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for name, n in (("a", 50), ("b", 8), ("c", 9), ("d", 1), ("e", 16)):
        ts = np.cumsum(rng.uniform(0.1, 2, n))
        want[name] = 1 / float(np.median(np.diff(ts))) if n > 1 else None
        rows += [(name, k, float(t)) for k, t in enumerate(ts)]
    rows += [("f", k, 1.0) for k in range(20)]
    got = {r.sample_id: r.rate for r in sig.sampling_rate(spark.createDataFrame(rows, "sample_id string, idx long, ts double")).collect()}
    assert got.pop("f") is None and got.keys() == want.keys()
    assert all(got[k] is None if v is None else abs(got[k] - v) < 1e-9 for k, v in want.items())


@pytest.fixture(scope="module")
def compared(spark):
    change = "struct<normal:double,abnormal:double,delta:double,ratio:double>"
    family = "struct<_order:double,_pos:int,label:string,frequency_hz:double,normal:double,abnormal:double,ratio:double,detected_in_baseline:boolean>"
    match = "struct<label:string,frequency:double,nearest_peak:double,deviation_pct:double,peak_amplitude:double,harmonic_order:int>"
    schema = (
        f"frequency_change struct<normal_dominant:double,abnormal_dominant:double,shift_hz:double>, band_changes array<struct<band:string,change:{change}>>, fault_frequencies struct<shaft:double,bpfo:double,bpfi:double,bsf:double,ftf:double>, "
        f"matches array<{match}>, changed_features array<string>, characteristic_changes array<{family}>, dominant struct<label:string,ambiguous:boolean,tied:array<string>>, rotation_speed double"
    )
    bands = [("0-1Hz", (1.0, 2.0, 1.0, 2.0)), ("1-2Hz", (5.0, 1.0, -4.0, 0.2)), ("2-3Hz", (1.0, 1.5, 0.5, 1.5))]
    energy = [(-0.5, 0, "BPFO", 107.4, 0.1, 0.5, 5.0, True), (-0.4, 1, "BPFI", 162.2, 0.0, 0.4, None, False), (-0.1, 2, "BSF", 70.6, 0.1, 0.1, 1.0, True), (-1e-5, 3, "FTF", 11.9, 1e-5, 1e-5, 1.0, True)]
    rows = [
        ((30.0, 30.0, 0.0), bands, (30.0, 107.4, 162.2, 70.6, 11.9), [("BPFO", 214.8, 214.0, 0.37, 0.2, 2)], ["rms"], energy, ("BPFO", False, []), 1797.0), ((30.0, 60.0, 30.0), bands, (30.0, 107.4, 162.2, 70.6, 11.9), [], [], energy, ("BPFO", True, ["BPFO", "BPFI"]), 1797.0),
        ((30.0, 60.0, 30.0), bands, None, None, [], None, None, None),
    ]
    return spark.createDataFrame(rows, schema).coalesce(1)


def test_notes(compared):
    rows = compared.select(report.spectrum_notes().alias("s"), report.envelope_notes().alias("e"), F.transform(report.changed_bands(), lambda b: b["band"]).alias("b"), F.transform(report.leading_families(), lambda c: c["label"]).alias("f")).collect()
    assert rows[0].b == ["1-2Hz", "0-1Hz"] and rows[0].f == ["BPFO", "BPFI", "BSF"]
    assert rows[0].s[0] == "the dominant frequency stays at 30.0 Hz" and "BPFO×2 214.80 Hz: peak at 214.00 Hz" in rows[0].s[3] and rows[0].s[4] == "changed features: rms"
    assert rows[0].e == ["the band of its harmonics has the most energy: BPFO (107.4 Hz) 5.00e-01 (baseline 1.00e-01, about 5 times)", "energies: BPFO 5.00e-01; BPFI 4.00e-01; BSF 1.00e-01"]
    assert "(+30.0 Hz)" in rows[1].s[0] and rows[1].s[3].startswith("no peak") and "none leads" in rows[1].e[0] and "BPFI (162.2 Hz) 4.00e-01 (not in the baseline)" in rows[1].e[0]
    assert rows[2].e is None and len(rows[2].s) == 2


def test_digest(spark):
    schema = (
        "session_id string, request struct<normal_id:string,abnormal_id:string,sampling_rate:double,rotation_speed:double>, status string, error string, quality struct<valid:boolean,comparable:boolean,errors:array<string>>, "
        "candidates array<struct<fault_type:string,title:string,score:double,evidence:string>>, sources array<string>, evidence array<string>, conclusion string, confidence string, confidence_reason string, suggestions array<string>, warnings array<string>"
    )
    rows = [("a", ("n", "s", 12000.0, 1797.0), "ok", None, (True, True, []), [("inner", "Inner", 0.7, "peaks")], list("123456"), ["e1", "e2", "e3", "e4", "e5"], "inner", "high", "clear", ["look"], []), ("b", (None, None, None, None), "error", "invalid_data", None, None, None, None, None, None, None, None, None)]
    got = spark.createDataFrame(rows, schema).orderBy("session_id").select(sessions.context_digest().alias("d"), sessions.digest_facts().alias("f")).collect()
    assert "input: baseline n, suspect s, speed 1797, rate 1.2e+04" in got[0].d and "- inner (Inner, score 0.7000): peaks" in got[0].d and "named: inner" in got[0].d and "- 5" in got[0].d and "- 6" not in got[0].d and "- e4" in got[0].d and "e5" not in got[0].d
    assert "error: invalid_data" in got[1].d and "conclusion" not in got[1].d and "candidates" not in got[1].d
    assert got[0].f == ["request_summary", "result.status", "result.data_quality", "result.candidates", "result.sources", "result.comparison", "result.report"] and got[1].f == ["request_summary", "result.status", "result.error"]


def test_answers_are_appended(spark):
    m = spark.createDataFrame([(7, "a", 1.0, "user", "t", None)], "id long, session_id string, created_at double, role string, content string, meta string")
    a = spark.createDataFrame([("a", "why?", "why_fault", "because", True, 9000.0), ("b", "hm", None, sessions.NO_SUPPORT, True, 50.0), ("z", "x", None, "session_not_found", False, 2.0)], "session_id string, question string, question_key string, content string, facts_used boolean, created_at double")
    rows = sessions.answered(m, a).orderBy("id").collect()
    assert [(r.id, r.session_id, r.role, r.content) for r in rows] == [(7, "a", "user", "t"), (8, "b", "user", "hm"), (9, "b", "assistant", sessions.NO_SUPPORT), (10, "a", "user", "why?"), (11, "a", "assistant", "because")]
    assert json.loads(rows[2].meta)["no_support"] is True and json.loads(rows[4].meta) == {"kind": "ask", "question_key": "why_fault", "facts_used": True, "no_support": False}


def test_names_ids_and_catalogue(spark, tmp_path):
    ids = [r[0] for r in spark.range(50).select(sessions.session_id()).collect()]
    assert len(set(ids)) == 50 and all(len(i) == 32 and int(i, 16) >= 0 for i in ids)
    df = spark.createDataFrame([("abc-_9", "normal"), ("abc", "normal"), ("abcdef", "other"), ("abc/../x", "normal"), ("abcdef\n", "normal")], "s string, t string")
    assert [r[0] for r in df.select(sessions.audio_name(F.col("s"), F.col("t"))).collect()] == ["abc-_9_normal.wav", None, None, None, None]
    samples = spark.createDataFrame([("n 1", "n 1.csv", "bearing", 12000.0, 1797.0, "drive_end", "normal", "正常", 3, "s", None), ("x", "x.csv", None, None, None, None, None, None, None, None, None)], files.SAMPLE)
    files.write_samples(samples, str(tmp_path / "meta"))
    assert "正常" in "".join(f.read_text() for f in (tmp_path / "meta").rglob("part-*"))
    assert sorted(map(tuple, files.read_samples(spark, str(tmp_path / "meta") + "/*").select(samples.columns).collect()), key=str) == sorted(map(tuple, samples.collect()), key=str)
    asked = spark.createDataFrame([("r1", "x"), ("r2", "no")], "request_id string, sample_id string")
    got = {r.request_id: r.sample_error for r in files.sample_lookup(asked, samples).collect()}
    assert got == {"r1": None, "r2": "sample_not_found; known: n 1, x"}


def test_sound_files(spark, tmp_path):
    wav = kernels.wav_bytes(impulses(100, 500), FS)
    df = spark.createDataFrame([(f"session{k}", s, bytearray(wav)) for k in range(4) for s in ("normal", "abnormal")] + [("../evil", "normal", bytearray(wav)), ("session9", "normal", None)], "session_id string, slot string, wav binary")
    assert df.select(F.unbase64(F.base64("wav")) == F.col("wav")).first()[0]
    assert files.write_audio(df, str(tmp_path / "wav"), keep=20) == 0
    names = sorted(f.name for f in (tmp_path / "wav").glob("*.wav"))
    assert names == sorted(f"session{k}_{s}.wav" for k in range(4) for s in ("normal", "abnormal"))
    assert wave.open(BytesIO((tmp_path / "wav" / names[0]).read_bytes())).getnframes() == 500
    assert files.write_audio(df, str(tmp_path / "wav"), keep=3) == 5 and len(list((tmp_path / "wav").glob("*.wav"))) == 3


def test_uploads_by_kind_and_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "UPLOAD_BYTES", 30)
    (tmp_path / "a.CSV").write_text("amplitude\n1\n2\n")
    (tmp_path / "b.txt").write_text("amplitude\n1\n")
    (tmp_path / "c.csv").write_text("amplitude\n" + "1\n" * 40)
    signals, scans = files.read_csv(spark, str(tmp_path))
    assert {r.sample_id: r.mode for r in scans.collect()} == {"a": "single", "b": "invalid_file_type", "c": "file_too_large"} and signals.count() == 2


def test_events_in_order(spark, tmp_path):
    from tremolo.streaming.signals import timed_stream

    base = "2024-01-01 00:00:"
    rows = [("a", "diagnosis_started", f"{base}00"), ("a", "node_started", f"{base}00.25"), ("b", "diagnosis_started", f"{base}05"), ("a", "diagnosis_completed", f"{base}02.5"), ("b", "warning", f"{base}05.001"), ("a", "no_such_event", f"{base}01")]
    df = spark.createDataFrame(rows, "session_id string, event string, t string").select("session_id", "event", F.col("t").cast("timestamp").alias("at"))
    want = {("a", 0): ("diagnosis_started", 0), ("a", 1): ("node_started", 250), ("a", 2): ("no_such_event", 1000), ("a", 3): ("diagnosis_completed", 2500), ("b", 0): ("diagnosis_started", 0), ("b", 1): ("warning", 1)}
    assert {(r.session_id, r.seq): (r.event, r.elapsed_ms) for r in sessions.timed_events(df).collect()} == want
    log = sessions.event_log(sessions.timed_events(df).withColumns({c: F.lit(None).cast("string") for c in ("node", "tool", "status", "label", "summary", "payload")}))
    assert log.count() == 5 and all(r.value.startswith("data: {") and r.value.endswith("}\n\n") for r in sessions.sse(log).collect())
    for k, part in enumerate((df.where("at < '2024-01-01 00:00:01'"), df.where("at >= '2024-01-01 00:00:01'"))):
        part.coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k}"))
    for k in range(2):  # the second run goes on from the state of the first
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in" / f"p{'01'[:k + 1] if k == 0 else '*'}"))
        timed_stream(stream).writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    assert {(r.session_id, r.seq): (r.event, r.elapsed_ms) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want


def element(kind, data, order="<"):
    return struct.pack(order + "II", kind, len(data)) + data + b"\0" * (-len(data) % 8)


def matrix(name, values, kind, packed, order="<", shape=None):
    shape = shape or (len(values), 1)
    data = np.asarray(values).astype(order + mat.KINDS[kind]).tobytes()
    body = element(6, struct.pack(order + "II", 6, 0), order) + element(5, struct.pack(order + "ii", *shape), order)
    body += (struct.pack(order + "HH", *((1, len(name)) if order == "<" else (len(name), 1))) + name.encode().ljust(4, b"\0") if len(name) <= 4 else element(1, name.encode(), order)) + element(kind, data, order)
    whole = element(14, body, order)
    return struct.pack(order + "II", 15, len(zlib.compress(whole))) + zlib.compress(whole) if packed else whole


def test_mat_files(spark, tmp_path):
    x = np.round(impulses(100, 700), 6)
    for order, mark in (("<", b"IM"), (">", b"MI")):
        head = b"MATLAB 5.0".ljust(124) + b"\0\1" + mark
        for packed in (False, True):
            data = head + matrix("X105_FE_time", [1.0], 9, packed, order) + matrix("X105_DE_time", x, 9, packed, order) + matrix("RPM", [1797], 4, packed, order) + matrix("grid", range(6), 3, packed, order, (2, 3))
            assert np.array_equal(mat.recording(data, 105)[0], x) and mat.recording(data, 105)[1] == 1797 and np.array_equal(mat.recording(data)[0], x)
            assert mat.matrices(data)["grid"].tolist() == [[0, 2, 4], [1, 3, 5]]
    (tmp_path / "105.mat").write_bytes(data)
    (tmp_path / "106.mat").write_bytes(data[:300])
    (tmp_path / "107.mat").write_bytes(b"no such file")
    (tmp_path / "108.mat").write_bytes(head + matrix("other", [1.0], 9, False, ">"))
    rows = mat.read_mat(spark, str(tmp_path), FS).collect()
    good = sorted((r.idx, r.amplitude, r.ts, r.rotation_speed) for r in rows if r.sample_id == "105")
    assert [g[1] for g in good] == x.tolist() and good[12][2] == 12 / FS and good[0][3] == 1797
    assert {r.sample_id for r in rows if r.error} == {"106", "107", "108"} and all(r.idx is None for r in rows if r.error)
    mat.register(spark)
    read = lambda **options: spark.read.format("signal-mat").options(samplingRate=FS, **options).load(str(tmp_path))
    assert sorted(map(tuple, read().collect()), key=repr) == sorted(map(tuple, rows), key=repr) and read().rdd.getNumPartitions() == 4
    named = read(variables="grid, X105_FE_time").collect()
    assert sorted((r.idx, r.amplitude) for r in named if r.sample_id == "105:grid") == list(enumerate([0.0, 1.0, 2.0, 3.0, 4.0, 5.0]))
    assert [r.amplitude for r in named if r.sample_id == "105:X105_FE_time"] == [1.0] and {r.error for r in named if r.sample_id.startswith("108")} == {"no variable grid", "no variable X105_FE_time"}
    with pytest.raises(Exception, match="samplingRate"):
        spark.read.format("signal-mat").load(str(tmp_path)).count()


def test_downloads(tmp_path):
    source, target = tmp_path / "a.bin", tmp_path / "kept" / "a.bin"
    source.write_bytes(b"x" * 200)
    get = lambda **more: download.fetch(source.as_uri(), str(target), **{"least": 100} | more)
    assert get() == "downloaded" and target.read_bytes() == b"x" * 200
    source.write_bytes(b"y" * 300)
    assert get() == "cached" and target.stat().st_size == 200 and get(force=True) == "downloaded" and target.stat().st_size == 300
    for broken in (lambda: get(force=True, least=1000), lambda: download.fetch((tmp_path / "none").as_uri(), str(target), force=True)):
        with pytest.raises(OSError):
            broken()
    assert [f.name for f in target.parent.iterdir()] == ["a.bin"] and target.stat().st_size == 300


def test_band_edges(spark):
    from tremolo.operators import spectra

    assert spectra.band_edges(None, 100.0) == [0, 10, 20, 30, 40, 50] and spectra.band_edges([1, 2.5, 4], 0) == [1, 2.5, 4] and spectra.band_edges([(0, 5), (5, 9)], 0) == [0, 5, 9]
    for bad in ([], [1], [2, 1], [1, 1], [(0, 5), (5, 5)], ["a", "b"], [float("nan"), 1.0]):
        with pytest.raises(ValueError, match="invalid_argument"):
            spectra.band_edges(bad, 1.0)
    x = impulses(100, 2000)
    assert list(features.features_of("s", x, FS, None, [(0, 1000), (1000, 6000)])["band_energy"]) == ["0-1000Hz", "1000-6000Hz"]


def test_one_session(spark):
    s = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "session_id string, created_at double")
    m = spark.createDataFrame([(5, "a", "second"), (2, "a", "first"), (3, "b", "other")], "id long, session_id string, content string")
    found, log = sessions.session(s, m, spark.createDataFrame([("a",), ("a",), ("z",)], "session_id string"))
    assert [r.session_id for r in found.collect()] == ["a"] and sorted((r.pos, r.content) for r in log.collect()) == [(0, "first"), (1, "second")]


def test_stages_close(spark):
    from tremolo.session import Stage, passing

    outer = Stage(spark, "outer")
    kept = outer.write(spark.range(3).toDF("id"))
    with passing():
        inner = Stage(spark, "inner")
        result = outer.write(inner.write(spark.range(5).toDF("id")).where("id > 1"))
    path = spark._jvm.org.apache.hadoop.fs.Path(inner.root)
    assert not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    assert (kept.count(), result.count()) == (3, 3)
    outer.close()


def test_bounded_calls():
    tries, said = [], []

    def call(code=None, fail=0):
        tries.append(code)
        if len([t for t in tries if t == code]) <= fail:
            raise model.ToolError(code)
        return "done"

    run = model.bounded(call, 3, retries=2, warn=said.append)
    assert run("mcp_timeout", fail=2) == "done" and len(tries) == 3 and len(said) == 2
    with pytest.raises(model.ToolError, match="missing_value"):
        run("missing_value", fail=1)
    with pytest.raises(model.ToolError, match="internal_error"):
        run("internal_error", fail=9)
    assert len(tries) == 7
    with pytest.raises(model.ToolError) as e:
        run()
    assert e.value.code == "max_tool_calls_exceeded" and len(tries) == 7


def test_a_given_band_begins_above_zero():
    x = np.sin(np.arange(500) / 3)
    for band in ((0, 100), (-1, 100), (200, 100), (float("nan"), 5)):
        with pytest.raises(ValueError, match="invalid_argument"):
            kernels.bandpass(x, 1000.0, band)
    assert kernels.bandpass(x, 1000.0, (100, 500))[2] == "unfiltered" and kernels.bandpass(x, 1000.0, (100, 400))[1] == [100.0, 400.0]


def test_prominences_and_matches_by_definition(spark):
    """Spectra with plateaus and equal heights against the kernel; the merge against every pair."""
    from tremolo.operators import spectra

    rng = np.random.default_rng(8)
    rows, want = [], set()
    for s in range(30):
        y = rng.integers(0, 6 if s % 2 else 1000, rng.integers(0, 60)).astype(float)
        rows += [(f"s{s}", k, k * 2.0, float(v)) for k, v in enumerate(y)]
        want |= {(f"s{s}", int(k), 2.0 * k, y[k], p) for k, p in zip(*kernels.peak_prominences(y))}
    df = spark.createDataFrame(rows, "sample_id string, bin long, freq double, mag double")
    for parts in (1, 5):
        got = spectra.prominences(df.repartition(parts)).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    peaks = spectra.local_maxima(df)
    assert {tuple(r) for r in peaks.select("sample_id", "bin", "freq", "mag").collect()} == {w[:4] for w in want}
    targets = spark.createDataFrame([("a", 1, 13.0), ("a", 2, 26.0), ("b", 1, 1.0), ("b", 2, 300.0), ("c", 1, 40.0), ("c", 2, 5.0)], "family string, harmonic long, target double")
    own = df.select("sample_id").distinct().join(targets)
    pairs = set()
    for s in {w[0] for w in want}:
        for t in targets.collect():
            gap, f, m = min((abs(w[2] - t.target), w[2], w[3]) for w in want if w[0] == s)
            if gap <= max(0.1 * t.target, 1.5):
                pairs.add((s, t.family, t.harmonic, t.target, f, m, gap / t.target * 100))
    for t in (targets, own):
        assert {tuple(r) for r in spectra.nearest_matches(peaks, t, 1.5, 0.1).collect()} == pairs


def test_addresses_and_names_by_every_pair(spark):
    """The merge and the automaton against the comparison of all pairs."""
    import random

    rng = random.Random(6)
    stems = ["http://a", "http://a.org", "http://a.org/", "http://a.org/x", "http://a.org/x/y", "https://b.net/é", "https://b.net/z?q=1", "http://a.orgx"]
    some = lambda n: [rng.choice(stems) + rng.choice(["", "/", "/more", "x"]) for _ in range(n)]
    allowed = [(k % 9, u) for k in range(40) for u in some(1)] + [(3, None), (None, "http://a.org")]
    said = {k: some(12) for k in [*range(12), None]}
    answers = spark.createDataFrame([(k, f"see ({u[0]}) and '{u[1]}' " + " ".join(u[2:])) for k, u in said.items()] + [(50, None)], "k int, t string")
    bad = sessions.rejected_urls(answers, spark.createDataFrame(allowed, "k int, url string"), "t", "k").collect()
    want = {(k, u) for k, us in said.items() for u in us if not any(k is not None and k == j and a and (u.startswith(a) or a.startswith(u)) for j, a in allowed)}
    assert {tuple(r) for r in bad} == want and len(bad) == len(want)

    names = ["inner", "inner_race", "race", "ra", "ball", "漢字", "normal", "", None, "none of them"]
    texts = [(1, "inner_race and 漢字"), (2, "a ball"), (2, "a ball race"), (3, None), (4, ""), (None, "race")]
    df, known = spark.createDataFrame(texts, "k int, t string"), spark.createDataFrame([(n,) for n in names] * 2, "fault_type string")
    want = sorted(((k, n) for k, t in texts for n in set(names) if n and t and n in t), key=repr)
    assert sorted(map(tuple, sessions.names_in(df, "t", "k", known).collect()), key=repr) == want
    old, sessions.NAME_BYTES = sessions.NAME_BYTES, 8  # several automata
    try:
        assert sorted(map(tuple, sessions.names_in(df, "t", "k", known).collect()), key=repr) == want
    finally:
        sessions.NAME_BYTES = old
    left = sessions.rejected_types(df, spark.createDataFrame([(1, "race"), (2, "ball")], "k int, fault_type string"), known, "t", "k")
    assert {tuple(r) for r in left.collect()} == {(1, "inner"), (1, "inner_race"), (1, "ra"), (1, "漢字"), (2, "race"), (2, "ra"), (None, "race"), (None, "ra")}
    assert "NestedLoop" not in left._jdf.queryExecution().executedPlan().toString()


def test_long_csv_by_split(spark, tmp_path):
    """Files read in many splits tell the same as files read whole."""
    rng = np.random.default_rng(9)
    pair = [f"{k / 100:.6f},{v:.5f}" for k, v in enumerate(rng.normal(size=900))]
    pair[17], pair[400], pair[401], pair[700] = "", "4.0,", "4.01,NaN", "1,2,3"
    texts = {
        "pair.csv": "\ufeffTimestamp, Amplitude\r\n" + "\r\n".join(pair) + "\r\n", "single.csv": "amplitude\n" + "\n".join(f"{v:.4f}" for v in rng.normal(size=700)), "times.csv": "timestamp,amplitude\n" + "\n".join(f"{'x' if k == 350 else k},{k}" for k in range(500)),
        "head.csv": "amplitude\n", "none.csv": "", "blank.csv": "\n \n", "odd.csv": "a,b\n1,2\n", "other.txt": "amplitude\n1\n", "with space+é.csv": "amplitude\n1\n2\n",
    }
    for name, t in texts.items():
        (tmp_path / name).write_bytes(t.encode())
    (tmp_path / "bytes.csv").write_bytes(b"amplitude\n1\n\xff\xfe\n")
    want = [sorted(map(repr, d.collect())) for d in files.read_csv(spark, str(tmp_path))]
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    lines, files.LINES = files.LINES, 64
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
        spark.conf.set("spark.sql.files.openCostInBytes", "0b")
        assert spark.read.text(str(tmp_path / "pair.csv")).rdd.getNumPartitions() > 10
        signals, scans = files.read_long_csv(spark, str(tmp_path))
        got = [sorted(map(repr, d.collect())) for d in (signals.select("sample_id", "idx", "ts", "amplitude"), scans)]
    finally:
        files.LINES = lines
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got[0] == want[0] and len(got[0]) > 2000
    assert got[1] == want[1]


def test_lines_do_not_carry_their_file(spark):
    """Above the rows made of a file's lines nothing reads the file's text or its array of lines."""
    df = spark.createDataFrame([("a", bytearray(b"amplitude\n1\n"), 12)], "sample_id string, content binary, size long")
    plan = str(files.parse_lines(df)._jdf.queryExecution().optimizedPlan().toString())
    above = plan[: plan.index("Generate posexplode")]
    assert "lines#" not in above and "text#" not in above and "content#" not in above
