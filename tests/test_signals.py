import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsequilt.functions import dsp
from pulsequilt.operators import kernels as K
from pulsequilt.sources import signals as S


@pytest.fixture(scope="module")
def recordings(spark):
    rates = [(k, 0.6 + 0.1 * k) for k in range(5)]
    return S.limb_leads(S.pairs_of(S.generated(spark.createDataFrame(rates, "record_id long, rr_s double"), fs=500)))


def test_limb_leads_satisfy_einthoven(recordings):
    by = {(r.record_id, r.lead): np.array(r.samples) for r in recordings.collect()}
    for k in range(5):
        assert np.allclose(by[k, "II"], by[k, "I"] + by[k, "III"])
        assert np.allclose(by[k, "aVR"] + by[k, "aVL"] + by[k, "aVF"], 0, atol=1e-12)


def test_every_beat_is_found(recordings):
    got = K.detected(recordings).groupBy("record_id").agg(F.sort_array(F.collect_list("r_sample")).alias("r")).collect()
    for row in got:
        rr = 0.6 + 0.1 * row.record_id
        want = [t for t in np.arange(S.FIRST_R, 10, rr) * 500 if 80 <= t <= 5000 - 81]
        assert len(row.r) == len(want)
        assert np.abs(np.array(row.r) - np.round(want)).max() <= 5


def test_bounds_are_near_the_generated_waves(recordings):
    b = K.delineated(recordings).where("lead = 'II' and record_id >= 2").collect()
    at = lambda name: np.median([(r[name] - r.r_peak) * 2 for r in b if r[name] is not None])
    assert abs(at("qrs_on") - -45) <= 20
    assert abs(at("qrs_off") - 60) <= 25
    assert abs(at("p_on") - -215) <= 30
    assert abs(at("p_off") - -105) <= 30
    assert abs(at("t_off") - 400) <= 30
    assert all(r.qrs_on <= r.r_peak <= r.qrs_off for r in b)


def test_filters_pass_and_stop_what_they_should():
    t = np.arange(5000) / 500
    slow, mid, fast, hum = (np.sin(2 * np.pi * f * t) for f in (0.05, 10, 120, 50))
    inner = slice(500, -500)
    y = dsp.bandpass(slow + mid + fast, 500, 1.0, 40.0)
    assert np.abs(y - mid)[inner].max() < 0.06
    assert np.abs(dsp.notch(mid + hum, 500, 50.0) - mid)[inner].max() < 0.05
    assert np.allclose(dsp.lowpass(mid, 500, 248.0), mid)
    up = dsp.resample(mid, 500, 250)
    assert up.size == 2500
    assert np.abs(up - np.sin(2 * np.pi * 10 * np.arange(2500) / 250))[100:-100].max() < 0.02


def test_zero_phase_keeps_constants_and_symmetry():
    x = np.ones(1000)
    assert np.allclose(dsp.lowpass(x, 500, 15.0), 1)
    pulse = np.zeros(1001)
    pulse[500] = 1
    y = dsp.lowpass(pulse, 500, 15.0)
    assert np.allclose(y, y[::-1])


def test_clusters_and_fusion():
    a, b = np.eye(8)[0], np.eye(8)[1]
    assert dsp.online_clusters(np.array([a, b, a, a + 0.1 * b, b, a])).tolist() == [0, 1, 0, 0, 1, 0]
    f = dsp.fuse(np.array([200, 202, 201, 203, 300]), np.ones(5), 500.0)
    assert abs(f["boundary"] - 201) <= 1 and f["support"] == 4


def test_clusters_of_records_stream_in_beat_order(spark):
    r = np.random.default_rng(2)
    rows = [(k % 3, k, (np.eye(6)[r.integers(0, 3)] + 0.2 * r.normal(size=6)).tolist()) for k in range(300)]
    df = spark.createDataFrame(rows, "record_id long, beat_id long, samples array<double>").repartition(5)
    got = {row.beat_id: row.group for row in K.clustered(df).collect()}
    for k in range(3):
        part = [x for x in rows if x[0] == k]
        assert [got[b] for _, b, _ in part] == dsp.online_clusters(np.array([w for *_, w in part])).tolist()
    assert "collect_list" not in K.clustered(df)._jdf.queryExecution().optimizedPlan().toString()


def test_bad_signals_are_named(spark):
    rows = [(1, "I", 50.0, [0.0] * 500), (2, "I", 500.0, []), (3, "I", 500.0, [0.0] * 10), (4, "I", 500.0, [float("nan")] * 600), (5, "a|b", 500.0, [0.0] * 600), (6, "I", 500.0, [0.0] * 600), (7, "I", None, None)]
    df = S.checked(spark.createDataFrame(rows, "record_id long, lead string, fs double, samples array<double>"))
    got = {r.record_id: r.error_code for r in df.collect()}
    assert got == {1: "sampling_rate_too_low", 2: "empty_signal", 3: "too_short", 4: "not_finite", 5: "lead_name", 6: None, 7: "sampling_rate_too_low"}


def test_files_are_read(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.arange(20.0).reshape(2, 10))
    got = {r.lead: r.samples for r in S.read_arrays(spark, str(tmp_path), 500.0, ["I", "II"]).collect()}
    assert got["II"] == list(np.arange(10.0, 20.0))
    raw = np.array([[100, 300], [200, 100]], "<i2")
    (tmp_path / "r1.dat").write_bytes(raw.tobytes())
    (tmp_path / "r1.hea").write_text("r1 2 500 2\nr1.dat 16 200(0)/mV 16 0 0 0 0 I\nr1.dat 16 100(100)/uV 16 0 0 0 0 II\n#Age: 50\n")
    spark.dataSource.register(S.WaveformSource)
    got = {r.lead: r.samples for r in spark.read.format("waveform_db").load(str(tmp_path)).collect()}
    assert got == {"I": [0.5, 1.0], "II": [0.002, 0.0]}
    with pytest.raises(ValueError):
        S.parse_header("nonsense")


def test_formats_offsets_and_files_of_waveform_databases(spark, tmp_path):
    a, b = np.array([[100, 200, -5], [7, -(1 << 31), 9]]), np.array([[1, -128, 127]])
    (tmp_path / "x.mat").write_bytes(b"h" * 24 + np.array([[10, 20], [30, -32768]], "<i2").T.tobytes())
    (tmp_path / "x.hea").write_text("x 2 500 2\nx.mat 16+24 10/mV 16 0 0 0 0 I\nx.mat 16+24 10/mV 16 0 0 0 0 II\n")
    (tmp_path / "y1.dat").write_bytes(a.T.astype("<i4").tobytes())
    (tmp_path / "y2.dat").write_bytes((b.T + 128).astype("u1").tobytes())
    (tmp_path / "y.hea").write_text("y 3 250 3\ny1.dat 32 200(0)/mV 32 0 0 0 0 I\ny2.dat 80 1/mV 8 0 0 0 0 V1\ny1.dat 32 1/mV 32 0 0 0 0 II\n")
    spark.dataSource.register(S.WaveformSource)
    got = {(r.record_id, r.lead): r.samples for r in spark.read.format("waveform_db").load(str(tmp_path)).collect()}
    same = lambda x, y: np.array_equal(np.array(x), np.array(y), equal_nan=True)
    assert same(got["x", "I"], [1.0, 2.0]) and same(got["x", "II"], [3.0, np.nan])
    assert same(got["y", "I"], [0.5, 1.0, -0.025]) and same(got["y", "II"], [7.0, np.nan, 9.0]) and same(got["y", "V1"], [1.0, np.nan, 127.0])
    for line in ("y1.dat 212 200 12 0 0 0 0 I", "y1.dat 16x2 200 16 0 0 0 0 I", "y1.dat 16:3 200 16 0 0 0 0 I", "y1.dat 16 200/mmHg 16 0 0 0 0 I"):
        with pytest.raises(ValueError):
            S.parse_header("y 1 250 3\n" + line)
    with pytest.raises(ValueError):
        S.decode_file(b"\0" * 6, S.parse_header("y 1 250 4\ny1.dat 16 200 16 0 0 0 0 I")["signals"], 4)


def test_kernels_on_disturbed_recordings(spark):
    """Beats are found through drift, hum and noise to 8 ms, and what is wrong with a recording is flagged."""
    n = spark.range(1, 15).select(F.col("id").alias("record_id"), (0.7 + F.col("id") * 0.02).alias("rr_s"))
    signals = S.limb_leads(S.pairs_of(S.disturbed(S.generated(n))))
    # a beat closer than 200 ms to the end is not whole, and not looked for
    want = {k: [0.5 + j * (0.7 + k * 0.02) for j in range(20) if 0.5 + j * (0.7 + k * 0.02) < 9.8] for k in range(1, 15)}
    got = {k: [] for k in want}
    for r in K.detected(signals).collect():
        got[r.record_id].append(r.time_s)
    for k, times in want.items():
        flat = k % 7 == 0
        inside = [t for t in times if not (flat and 3.9 <= t <= 5.1)]
        assert all(min(abs(t - g) for g in got[k]) <= 0.008 for t in inside), k
    flags = {}
    for r in K.signal_quality(signals).collect():
        flags.setdefault(r.record_id, set()).update(r.flags)
    assert any("mains" in f for f in flags[3]) and not any("mains" in f for f in flags[1])
