"""Kernels by independent means, files, rules, and whole diagnoses of synthetic signals."""

import wave
from io import BytesIO

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremolo import config
from tremolo.functions import kernels, scalars
from tremolo.operators import features, retrieval, rules, sessions, signals as sig
from tremolo.plans.diagnose import diagnose, first_sources, projected
from tremolo.sources import knowledge, signals as files

FS, RPM = 12000.0, 1797.0


def impulses(hz, n=12000, seed=3, gain=1.0):
    """A decaying resonance triggered at one frequency, in noise."""
    t = np.arange(n) / FS
    out = np.random.default_rng(seed).normal(0, 0.05, n)
    for start in np.arange(0, n / FS, 1 / hz) if hz else []:
        d = t - start
        out += np.where(d >= 0, gain * np.exp(-900 * np.maximum(d, 0)) * np.sin(2 * np.pi * 3500 * d), 0)
    return out


def test_spectrum_of_known_sines():
    t = np.arange(12000) / FS
    x = np.sin(2 * np.pi * 162.2 * t) + 0.6 * np.sin(2 * np.pi * 324.4 * t) + 0.3 * np.sin(2 * np.pi * 30 * t)
    f = features.features_of("s", x, FS, None)
    assert f["dominant_frequency"] == 162.0 and f["dominant_amplitude"] > 0.4
    at = [p["frequency"] for p in f["spectrum_peaks"]]
    assert min(abs(a - 162.2) for a in at) < 1.5 and min(abs(a - 324.4) for a in at) < 2
    freq, mag = kernels.amplitude_spectrum(x - x.mean(), FS)
    assert abs(sum(f["band_energy"].values()) - (mag**2).sum()) < 1e-4


def whole(sections):
    b, a = np.ones(1), np.ones(1)
    for p, q in sections:
        b, a = np.polymul(b, p), np.polymul(a, q)
    return b, a


def test_filter_edges_and_phase():
    sections = kernels.butter_sections(0.33, 0.83)
    b, a = whole(sections)
    h = lambda w: abs(np.polyval(b[::-1], np.exp(-1j * np.pi * w)) / np.polyval(a[::-1], np.exp(-1j * np.pi * w)))
    centre = 2 / np.pi * np.arctan(np.sqrt(np.tan(np.pi * 0.33 / 2) * np.tan(np.pi * 0.83 / 2)))
    assert abs(h(centre) - 1) < 1e-9 and abs(20 * np.log10(h(0.33)) + 3.0103) < 1e-3 and abs(20 * np.log10(h(0.83)) + 3.0103) < 1e-3
    assert (abs(np.roots(a)) < 1).all()
    x = np.cos(np.pi * 0.5 * np.arange(4000))
    assert abs(kernels.zero_phase(sections, x) - h(0.5) ** 2 * x)[500:-500].max() < 1e-9


def slow_prominence(y, p):
    left, right = y[p], y[p]
    i = p
    while i >= 0 and y[i] <= y[p]:
        left = min(left, y[i])
        i -= 1
    i = p
    while i < len(y) and y[i] <= y[p]:
        right = min(right, y[i])
        i += 1
    return y[p] - max(left, right)


def test_peaks_by_definition():
    rng = np.random.default_rng(0)
    for _ in range(60):
        y = rng.integers(0, 9, 60).astype(float)
        tops = []
        k = 1
        while k < 59:
            e = k
            while e < 59 and y[e + 1] == y[k]:
                e += 1
            if e < 59 and y[k - 1] < y[k] > y[e + 1]:
                tops.append((k + e) // 2)
            k = e + 1
        for least in (0.0, 2.0, 4.0):
            assert kernels.find_peaks(y, least).tolist() == [p for p in tops if slow_prominence(y, p) >= least]


def test_envelope_finds_its_family():
    base = features.frequencies(RPM)
    assert base == {"shaft": 29.95, "bpfo": 107.3640, "bpfi": 162.186, "bsf": 70.5838, "ftf": 11.9293} or abs(base["bpfi"] - 162.186) < 1e-3
    for family in ("bpfo", "bpfi"):
        e = features.envelope(impulses(base[family]), FS, RPM)["characteristic_energy"]
        assert max(e, key=e.get) == family
    assert features.envelope(np.zeros(20), FS, RPM) is None


def test_wav_and_series(spark):
    w = wave.open(BytesIO(kernels.wav_bytes(impulses(100), FS)))
    assert (w.getnchannels(), w.getsampwidth(), w.getframerate(), w.getnframes()) == (1, 2, 12000, 12000)
    assert len(kernels.wav_bytes(impulses(100), FS)) == 24044
    df = spark.createDataFrame([("a", k, float(v)) for k, v in enumerate(impulses(100, 3000))], "sample_id string, idx long, amplitude double")
    s = features.extract_series(df, spark.createDataFrame([("a", FS)], "sample_id string, sampling_rate double")).first()
    assert len(s.waveform_min) == 600 and all(a <= b for a, b in zip(s.waveform_min, s.waveform_max)) and max(s.spectrum_mag) > 0


def csv_text(rows, header="timestamp,amplitude"):
    return "﻿" + header + "\n" + "\n".join(rows) + "\n\n"


def test_csv_diagnostics(spark, tmp_path):
    bad = {17: "", 58: "null", 103: "N/A", 149: "", 201: "NaN", 244: "nan", 288: "--"}
    (tmp_path / "corrupted.csv").write_text(csv_text([f"{k / FS:.6f},{bad.get(k, 0.5 + k % 3)}" for k in range(300)]))
    (tmp_path / "single.csv").write_text(csv_text(["1.5", "2", "", " 3e-1 "], "Amplitude"))
    (tmp_path / "times.csv").write_text(csv_text(["0,1", "x,2", "0.2,3", "1,2,3", ",", "0.3,"]))
    (tmp_path / "wrong.csv").write_text("time,value\n1,2\n")
    (tmp_path / "odd.csv").write_text("amplitude,timestamp\n1,2\n")
    (tmp_path / "empty.csv").write_text("\n\n")
    (tmp_path / "head.csv").write_text("amplitude\n")
    (tmp_path / "bytes.csv").write_bytes(b"amplitude\n\xff\xfe\n")
    signals, scans = files.read_csv(spark, str(tmp_path))
    s = {r.sample_id: r for r in scans.collect()}
    assert s["corrupted"].n_samples == 293 and len(s["corrupted"].errors) == 7
    assert s["corrupted"].errors[0].code == "missing_value" and s["corrupted"].errors[0].message.startswith("line 19") and {e.code for e in s["corrupted"].errors} == {"missing_value", "invalid_value"}
    assert abs(s["corrupted"].rate - FS) / FS < 0.01 and s["single"].n_samples == 3 and s["single"].rate is None
    assert s["times"].n_samples == 3 and [e.field for e in s["times"].errors] == ["row", "amplitude"] and len(s["times"].warnings) == 1 and s["times"].rate is None
    assert {k: s[k].file_error.code for k in ("wrong", "odd", "empty", "head", "bytes")} == {"wrong": "missing_column", "odd": "file_format", "empty": "empty_data", "head": "empty_data", "bytes": "file_format"}
    assert [r.idx for r in signals.where("sample_id = 'corrupted'").orderBy("idx").collect()] == list(range(293))
    with pytest.raises(Exception, match="missing_value"):
        files.strict(scans.where("sample_id = 'corrupted'")).count()
    files.write_csv(signals.where("sample_id = 'corrupted'"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 294


ENTRY = """---
fault_type: {0}
title: {1}
frequency_family: {2}
typical_features:
  - {3}
criteria:
{4}
sources:
  - name: Handbook | url: https://example.org/a:b | locator: p. {0}
  - plain note
---
{5}
"""


def entry(kind, title, family, words, body):
    rows = [c for c in rules.CLAUSES if c[0] == kind]
    lines = "\n".join("  - " + " | ".join(f"{k}: {v}" for k, v in zip(("id", "metric", "op", "value", "family", "order"), (c[1], c[2], f'"{c[3]}"', *c[4:])) if v) + " | claim: as the clause says" for c in rows)
    return (f"{kind}.md", ENTRY.format(kind, title, family, words, lines, body))


@pytest.fixture(scope="module")
def entries(spark):
    texts = [
        entry("inner_race_fault", "Inner race", "BPFI", "BPFI dominant envelope peaks", "BPFI BPFI dominant envelope rises"),
        entry("outer_race_fault", "Outer race", "BPFO", "BPFO dominant envelope peaks", "BPFO BPFO dominant envelope rises"),
        entry("ball_fault", "Ball", "BSF", "tied families BSF", "BSF tied"), entry("cage_fault", "Cage", "FTF", "FTF", "FTF slow"),
        entry("normal", "Healthy", "", "steady", "steady and calm"), entry("unbalance", "Unbalance", "", "shaft once", "shaft order one"), entry("misalignment", "Misalignment", "", "shaft twice", "coupling order two"),
        ("notes.md", "no front matter"),
    ]
    return knowledge.entries(spark.createDataFrame(texts, "name string, text string"))


def test_knowledge(entries):
    rows = {r.fault_type: r for r in entries.collect()}
    assert len(rows) == 7
    inner = rows["inner_race_fault"]
    assert [(c.id, c.metric, c.op, c.value, c.family) for c in inner.criteria] == [c[1:6] for c in rules.CLAUSES if c[0] == "inner_race_fault"]
    assert (inner.sources[0].url, inner.sources[1].name) == ("https://example.org/a:b", "plain note") and inner.typical_features == ["BPFI dominant envelope peaks"] and rows["normal"].frequency_family is None


def test_front_matter_forms(spark):
    texts = {
        "open": "---\nfault_type: a\nlist:\n- one\n  - two: 2", "none": " plain \n", "empty": "---\n---\n\nbody\n", "value": "---\na: 1\n- dropped: x\nb:\n-no\n - kept\n --- \nx\n---\ny\n", "blank": "", "first": "---\n- a: b\nc: d\n---",
    }
    rows = {r.name: (r.meta, r.lists, r.body) for r in knowledge.front_matter(spark.createDataFrame(list(texts.items()), "name string, text string")).collect()}
    assert rows == {
        "open": ({"fault_type": "a", "list": ""}, {"list": ["one", "two: 2"]}, ""), "none": ({}, {}, "plain"), "empty": ({}, {}, "body"),
        "value": ({"a": "1", "b": ""}, {"b": ["kept"]}, "x\n---\ny"), "blank": ({}, {}, ""), "first": ({"- a": "b", "c": "d"}, {}, ""),
    }


def test_whole_diagnoses(spark, entries):
    base = features.frequencies(RPM)
    data = {"normal": impulses(0), "inner": impulses(base["bpfi"]), "outer": impulses(base["bpfo"]), "short": impulses(base["bpfi"], 2000), "tiny": impulses(0, 300)}
    signals = spark.createDataFrame([(k, i, i / FS, float(v)) for k, x in data.items() for i, v in enumerate(x)], "sample_id string, idx long, ts double, amplitude double")
    issue = "array<struct<code:string,message:string,field:string>>"
    scans = spark.createDataFrame([(k, len(x), FS, None, [], []) for k, x in data.items()], f"sample_id string, n_samples long, rate double, file_error struct<code:string,message:string>, errors {issue}, warnings {issue}")
    asked = [("same", "normal", "normal", FS, RPM), ("inner", "normal", "inner", FS, RPM), ("outer", "normal", "outer", FS, RPM), ("short", "normal", "short", FS, RPM), ("tiny", "normal", "tiny", FS, RPM), ("none", "normal", "nowhere", FS, RPM), ("rate", "normal", "inner", -1.0, RPM), ("blank", "", "inner", FS, RPM)]
    requests = spark.createDataFrame(asked, "request_id string, normal_id string, abnormal_id string, sampling_rate double, rotation_speed double")
    run = diagnose(requests, signals, scans, entries, threshold=0.05)
    v = {r.request_id: r for r in run.verdicts.collect()}
    assert {k: (r.status, r.branch) for k, r in v.items()} == {
        "same": ("insufficient_evidence", "no_significant_change"), "inner": ("ok", "ok"), "outer": ("ok", "ok"), "short": ("insufficient_evidence", "short_signal"),
        "tiny": ("error", "invalid_data"), "none": ("error", "invalid_data"), "rate": ("error", "invalid_argument"), "blank": ("error", "invalid_argument"),
    }
    assert v["inner"].conclusion == "inner_race_fault" and v["outer"].conclusion == "outer_race_fault" and v["same"].conclusion == "unconfirmed"
    assert v["none"].error == "file_not_found"
    reports = {r.request_id: r for r in run.reports.collect()}
    assert reports["tiny"].report is None and reports["inner"].markdown.count("## ") == 11 and "inner_race_fault" in reports["inner"].markdown
    assert reports["inner"].report.sources and not reports["same"].report.candidates and len(reports["inner"].report.evidence) <= 6
    shown = {(r.request_id, r.align_rank): r for r in projected(run.candidates, run.checks, first_sources(entries)).collect()}
    assert shown["inner", 1].fault_type == "inner_race_fault" and shown["inner", 1].source == "Handbook" and len(shown["inner", 1].criteria_check) == 6 and len(shown["inner", 1]) == 12
    hybrid = diagnose(requests, signals, scans, entries, embed=retrieval.hashed_embedder(64), threshold=0.05)
    assert {r.request_id: r.conclusion for r in hybrid.verdicts.collect()}["outer"] == "outer_race_fault"


@pytest.mark.parametrize("hits,misses,unknown,want", [(0, 0, 0, ("none", 1.0)), (2, 0, 0, ("consistent", 1.0)), (0, 2, 0, ("conflict", 0.4)), (1, 1, 0, ("conflict", 0.7)), (2, 1, 0, ("partial", 0.8)), (0, 0, 1, ("unverified", 1.0))])
def test_factor_boundaries(spark, hits, misses, unknown, want):
    row = spark.range(1).select(rules.summary(F.lit(hits), F.lit(misses), F.lit(hits + misses + unknown)).alias("s"), rules.factor(F.lit(hits), F.lit(misses)).alias("f")).first()
    assert (row.s, row.f) == want


def test_scalars(spark):
    texts = ["1", " 2.5 ", "1e3", "-.5", "1d", "NaN", "inf", "1_000", "", "0x1", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(scalars.parsed(F.col("t"))).collect()] == [1, 2.5, 1000, -0.5] + [None] * 7
    numbers = [0.5, 12000.0, 0.0, 1234.5, 3.14159, 0.00012344, 0.000012344, None, 100.0]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in numbers], "v double").select(scalars.short_number(F.col("v"))).collect()]
    assert got == [None if n is None else f"{n:.4g}" for n in numbers]
    words = spark.createDataFrame([("包络谱 BPFI 主 12.5Hz x",)], "t string").select(retrieval.tokens(F.col("t"))).first()[0]
    assert words == ["包络", "络谱", "bpfi", "12.5", "hz", "x"]
    assert spark.createDataFrame([('```json\n{"a": 1}\n``` tail',), ("none",)], "t string").select(scalars.json_object(F.col("t"))).collect()[0][0] == '{"a": 1}'


def test_chunk_rule():
    text = "".join(f"sentence {k};" for k in range(200))
    parts = retrieval.split_text(text)
    assert all(len(p) <= 500 for p in parts) and all(p.endswith(";") for p in parts) and text.startswith(parts[0]) and text.endswith(parts[-1])
    assert retrieval.split_text("") == [] and retrieval.split_text("x" * 501, 500, 80)[1] == "x" * 81


def test_sessions(spark):
    s = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "session_id string, created_at double")
    m = spark.createDataFrame([(k, "abc"[k % 3], float(k), "user", f"t {k}", None) for k in range(9)], "id long, session_id string, created_at double, role string, content string, meta string")
    kept, own = sessions.retained(s, m, 2)
    assert {r.session_id for r in kept.collect()} == {"b", "c"} and own.count() == 6
    new = sessions.appended(m, m.drop("id").limit(2))
    assert new.count() == 11 and new.agg(F.max("id")).first()[0] == 10
    row = spark.createDataFrame([("a", "ok", "ball_fault", "low", "few", ["e1", "e2"], ["s1"], ["r1"], "# all")], "session_id string, status string, conclusion string, confidence string, confidence_reason string, evidence array<string>, sources array<string>, suggestions array<string>, markdown string")
    asked = spark.createDataFrame([("a", "Why is it this fault??"), ("a", "how certain"), ("a", "hello"), ("z", "x")], "session_id string, question string")
    got = {r.question: r for r in sessions.answer(row, asked).collect()}
    assert got["Why is it this fault??"].question_key == "why_fault" and got["how certain"].question_key == "confidence" and "ball_fault" in got["hello"].content and got["x"].content == "session_not_found"
    bad = sessions.rejected_urls(spark.createDataFrame([(1, "see https://a.org/x and http://b.org")], "k int, t string"), spark.createDataFrame([(1, "https://a.org/")], "k int, url string"), "t", "k")
    assert [r.url for r in bad.collect()] == ["http://b.org"]


def test_stream_equals_batch(spark, tmp_path):
    from tremolo.streaming.signals import read_events, run_to_table, windowed_stats

    source = "/root/testdata/sf0.001/events.parquet"
    events = spark.read.parquet(source)
    last = events.selectExpr("timestampadd(DAY, 9, max(ts)) AS t").first().t
    tail = events.limit(1).withColumn("ts", F.lit(last).cast(events.schema["ts"].dataType))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    tail.write.mode("append").parquet(str(tmp_path / "in"))
    run_to_table(windowed_stats(read_events(spark, str(tmp_path / "in"), events.schema)), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {(r.sample_id, r.start): (r.n_samples, round(r.rms, 6)) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.sample_id, r.start): (r.n_samples, round(r.rms, 6)) for r in windowed_stats(events).collect()}
    assert got == want


def test_stats_kernel_and_sql_agree(spark):
    x = impulses(100, 2000)
    df = spark.createDataFrame([("a", k, float(v)) for k, v in enumerate(x)], "sample_id string, idx long, amplitude double")
    s, f = sig.stats(df).first(), features.features_of("a", x, FS, None)
    assert all(abs(s[c] - f[c]) < 1e-5 for c in ("rms", "peak", "kurtosis", "crest_factor"))
    assert config.BALLS == 9


def test_shared_baseline_at_two_speeds(spark, entries):
    slow, fast = RPM * 0.7, RPM
    data = {"normal": impulses(0), "slow": impulses(features.frequencies(slow)["bpfo"]), "fast": impulses(features.frequencies(fast)["bpfi"])}
    signals = spark.createDataFrame([(k, i, i / FS, float(v)) for k, x in data.items() for i, v in enumerate(x)], "sample_id string, idx long, ts double, amplitude double")
    issue = "array<struct<code:string,message:string,field:string>>"
    scans = spark.createDataFrame([(k, len(x), FS, None, [], []) for k, x in data.items()], f"sample_id string, n_samples long, rate double, file_error struct<code:string,message:string>, errors {issue}, warnings {issue}")
    speeds = {"slow": slow, "fast": fast}
    requests = spark.createDataFrame([(k, "normal", k, FS, v) for k, v in speeds.items()], "request_id string, normal_id string, abnormal_id string, sampling_rate double, rotation_speed double")
    run = diagnose(requests, signals, scans, entries, threshold=0.05)
    rows = {r.request_id: r for r in run.comparisons.collect()}
    assert set(rows) == set(speeds)
    for k, rpm in speeds.items():
        n, a = (features.envelope(data[s] - data[s].mean(), FS, rpm) for s in ("normal", k))
        got = {c.label.lower(): c for c in rows[k].characteristic_changes}
        for f, c in got.items():
            assert c.frequency_hz == features.frequencies(rpm)[f] and abs(c.normal - n["characteristic_energy"][f]) < 1e-9 and abs(c.abnormal - a["characteristic_energy"][f]) < 1e-9
    assert sorted(r.request_id for r in run.verdicts.select("request_id").collect()) == ["fast", "slow"]
