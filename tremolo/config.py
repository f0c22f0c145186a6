"""Domain constants. These are fixed values: results depend on them."""

from dataclasses import dataclass

#: Bearing geometry: balls, ball diameter and pitch diameter in inches, contact angle in degrees.
BALLS, BALL_DIAMETER, PITCH_DIAMETER, CONTACT_ANGLE = 9, 0.3126, 1.537, 0.0
RATE_TOLERANCE = 0.01
CHANGE_THRESHOLD = 0.3
PROMINENCE_RATIO = 0.02
LOW_BAND_HZ, BAND_ORDER, BAND_PEAKS, GLOBAL_PEAKS = 1000.0, 3, 20, 5
DOMINANCE_MARGIN = 1.15
HARMONICS, ENVELOPE_TOLERANCE, MIN_ENERGY = (1, 2, 3), 0.03, 1e-9
PEAK_TOLERANCE = 0.02
BASELINE_DETECTED = 0.01
RESONANCE_BAND = (0.33, 0.83)
WAVEFORM_POINTS, SPECTRUM_POINTS, ENVELOPE_POINTS, ENVELOPE_HZ = 600, 600, 400, 1000.0
WAV_SCALE, WAV_HEADROOM = 32767, 0.98
MIN_SAMPLES, MIN_SECONDS = 1024, 0.25
BANDS = 5
BM25_K1, BM25_B, BM25_SCALE = 1.5, 0.75, 2.5
FACTOR_BASE, FACTOR_SPAN, SHAFT_TOLERANCE = 0.4, 0.6, 0.1
TOP_K, SCORE_THRESHOLD = 5, 0.35
VECTOR_WEIGHT, BM25_WEIGHT = 0.6, 0.4
CHUNK_SIZE, CHUNK_OVERLAP, CHUNK_LOOKBACK, CHUNK_BORDERS = 500, 80, 100, "\n。；;"
CANDIDATE_GAP = 0.05
SESSIONS_KEPT, HISTORY_TURNS, HISTORY_CHARS, AUDIO_KEPT = 50, 3, 400, 200
UPLOAD_BYTES = 20 << 20
#: Families in the order in which ties are broken, and in which spectra list them.
FAMILIES = ("bpfo", "bpfi", "bsf", "ftf")
FEATURES = ("rms", "peak", "kurtosis", "crest_factor", "dominant_frequency", "dominant_amplitude")


@dataclass(frozen=True)
class Geometry:
    balls: int = BALLS
    ball: float = BALL_DIAMETER
    pitch: float = PITCH_DIAMETER
    angle: float = CONTACT_ANGLE
