"""Fixed values that results depend on."""

# ---- fixed values: frequency bands in Hz, first containing band wins ----
FREQUENCY_BANDS = {
    "infraslow": (0.0, 1.0),
    "delta": (1.0, 4.0),
    "theta": (4.0, 8.0),
    "alpha": (8.0, 13.0),
    "beta": (13.0, 20.0),
    "beta_wide": (13.0, 30.0),
}

# ---- fixed values: default bin edges in hours, minimum coverage, thresholds ----
DEFAULT_BIN_EDGES = [0, 6, 12, 18, 24, 48, 72]
MIN_COVERAGE_HOURS = 1.0
CONTINUITY_THRESHOLD = 10.0
MISSINGNESS_LIMITS = [("complete", 0.95), ("high_artifact", 0.5), ("moderate_artifact", 0.1)]
LOG_STAT_PREFIXES = ["fft_delta_", "fft_theta_", "fft_alpha_", "fft_beta_", "total_power_"]

# ---- fixed values: how a zero is to be read, by family ----
ZERO_IMPOSSIBLE = ["fft_spectrogram", "fft_power", "aeeg", "peak_envelope", "rhythmicity", "coherence_spectrogram"]
ZERO_LEGITIMATE = ["suppression_ratio", "asymmetry", "spectral_edge", "adr", "relative_power", "alpha_variability"]
NEVER_NULL = [
    "rhythmic_delta", "rda", "sleep", "spike_density", "seizure_detection", "seizure_probability",
    "seizure_notification", "seizure_burden", "status_epilepticus", "artifact_intensity",
    "electrode_quality", "heart_rate", "annotation", "time_display",
]
REGION_TOKENS = [
    "Left Anterior", "Right Anterior", "Left Posterior", "Right Posterior",
    "Left Hemisphere", "Right Hemisphere",
    "Asym Anterior", "Asym Posterior", "Asym Parasagittal", "Asym Temporal",
    "Asym Hemi", "All 10-20", "Anterior", "Posterior",
]
REGION_FALLBACK = {
    "Asym Hemi": ["All 10-20", "Left Hemisphere", "Right Hemisphere"],
    "Asym Anterior": ["Anterior", "All 10-20"],
    "Asym Posterior": ["Posterior", "All 10-20"],
    "Asym Parasagittal": ["All 10-20"],
    "Asym Temporal": ["All 10-20"],
}
DEAD_REFERENCE_SHARE = 0.95

# ---- fixed values: plausible value range per family ----
FAMILY_RANGES = {
    "fft_power": (0, 500),
    "fft_power_ratio": (0, 100),
    "adr": (0, 100),
    "relative_power": (0, 1),
    "electrode_quality": (0, 1.2),
    "seizure_probability": (0, 1),
    "status_epilepticus": (0, 100),
    "seizure_burden": (0, 100),
    "artifact_intensity": (0, 50),
    "aeeg": (0, 500),
    "suppression_ratio": (0, 100),
    "asymmetry": (-1, 1),
    "asymmetry_spectrogram": (-100, 100),
    "coherence_spectrogram": (0, 1),
    "spectral_edge": (0, 50),
    "peak_envelope": (0, 500),
    "heart_rate": (0, 300),
    "rhythmic_delta": (0, 1),
    "seizure_detection": (0, 1),
    "seizure_notification": (0, 1),
}

# ---- fixed values: artifact filter defaults ----
ARTIFACT_MODE = "quality"
INTENSITY_LIMIT = 5.0
QUALITY_LIMIT_PCT = 50.0
MIN_CLEAN_ELECTRODES = 10

# ---- fixed values: families dropped at ingest ----
DISCARDED_FAMILIES = ["artifact_detector"]

# ---- fixed values: family patterns in order, first match wins ----
FAMILY_PATTERNS = [
    ("artifact_intensity", r"Artifact Intensity|ArtifactIntensity"),
    ("artifact_detector", r"Artifact Detector|ArtifactDetector|^Artifact$"),
    ("electrode_quality", r"Electrode Signal Quality|ElectrodeSignalQuality"),
    ("alpha_variability", r"\bRAV\b|Relative Alpha|FFT_PowerRatio\s+6-14|FFT PowerRatio\s*,?\s*6-14"),
    ("fft_power_ratio", r"FFT_PowerRatio|FFT PowerRatio"),
    ("fft_power", r"FFT_Power\b|FFT Power,\s*\d"),
    ("fft_spectrogram", r"FFT_Spectrogram|FFT Spectrogram"),
    ("spectral_edge", r"FFT_Edge|SEF\d+"),
    ("aeeg", r"aEEG"),
    ("peak_envelope", r"PeakEnvelope"),
    ("suppression_ratio", r"Suppression Ratio|^BSR\b"),
    ("status_epilepticus", r"[Ss]tatus\s+[Ee]pilepticus"),
    ("seizure_burden", r"[Ss]eizure\s+[Bb]urden"),
    ("seizure_detection", r"SeizureProbabilityP14\s+Detections|[Ss]eizure\s+[Dd]etect"),
    ("seizure_probability", r"SeizureProbabilityP14|[Ss]eizure\s+[Pp]rob"),
    ("seizure_notification", r"[Ss]eizure\s+[Nn]otif"),
    ("spike_density", r"SpikeDensityV1|EventDensity\s+Spike|Spike"),
    ("rda", r"[Rr]hythmic\s+delta\s+indicator"),
    ("rhythmicity", r"Rhythmic"),
    ("asymmetry", r"Asymmetry"),
    ("coherence_spectrogram", r"Coherence"),
    ("sleep", r"Sleep"),
    ("rhythmic_delta", r"Boolean\s+[LR][A-Z]D"),
    ("heart_rate", r"Heart Rate|EKG Channel"),
    ("annotation", r"Comment"),
    ("time_display", r"^Time[,\s](?!Avg\s*<)"),
]
POWER_FAMILIES = ["fft_power", "fft_power_ratio", "alpha_variability", "adr", "relative_power"]
RATIO_TOLERANCE = 0.51

# ---- fixed values: electrodes, renamed electrodes, chain regions ----
ELECTRODES = [
    "Fp1", "Fp2", "F3", "F4", "C3", "C4", "P3", "P4", "O1", "O2", "F7", "F8", "T3", "T4", "T5", "T6",
    "Fz", "Cz", "Pz", "A1", "A2", "P7", "P8", "T7", "T8", "F9", "F10",
]
RENAMED_ELECTRODES = {"T3": "T7", "T4": "T8", "T5": "P7", "T6": "P8"}
CHAIN_REGIONS = {
    "F3C3P3": ("left", "frontal_central_parietal"),
    "F4C4P4": ("right", "frontal_central_parietal"),
    "P3P7O1": ("left", "parietal_temporal_occipital"),
    "P4P8O2": ("right", "parietal_temporal_occipital"),
    "F7T3P7": ("left", "fronto_temporal_parietal"),
    "F8T4P8": ("right", "fronto_temporal_parietal"),
    "F7T7P7": ("left", "fronto_temporal_parietal"),
    "F8T8P8": ("right", "fronto_temporal_parietal"),
    "T3T5O1": ("left", "temporal_occipital"),
    "T4T6O2": ("right", "temporal_occipital"),
    "T7P7O1": ("left", "temporal_occipital"),
    "T8P8O2": ("right", "temporal_occipital"),
    "C3P3O1": ("left", "central_parietal_occipital"),
    "C4P4O2": ("right", "central_parietal_occipital"),
    "Fp1F3C3": ("left", "frontal"),
    "Fp2F4C4": ("right", "frontal"),
}

# ---- fixed values: engine of each family, rows per independent observation, window seconds ----
FAMILY_ENGINES = {
    "fft_power": "FFTEngine01", "fft_power_ratio": "FFTEngine01", "adr": "FFTEngine01",
    "relative_power": "FFTEngine01", "alpha_variability": "FFTEngine01", "fft_spectrogram": "FFTEngine01",
    "spectral_edge": "FFTEngine01", "suppression_ratio": "Amplitude01", "rhythmicity": "RhythmicityEngine01",
    "rda": "RhythmicityEngine01", "rhythmic_delta": "RhythmicityEngine01", "artifact_intensity": "Artifact01",
    "electrode_quality": "Artifact01", "aeeg": "aEEG01", "peak_envelope": "PeakEnvelope01",
    "seizure_probability": "SeizureProbabilityP1401", "seizure_detection": "SeizureProbabilityP1401",
    "seizure_notification": "SeizureProbabilityP1401", "spike_density": "SpikeDensityV101",
    "asymmetry": "FFTEngine01",
}
ENGINE_CADENCE = {
    "FFTEngine01": 8, "Amplitude01": 10, "RhythmicityEngine01": 2, "Artifact01": 1, "aEEG01": 1,
    "PeakEnvelope01": 1, "SeizureProbabilityP1401": 1, "SpikeDensityV101": 1,
}
ENGINE_WINDOW = {
    "FFTEngine01": 4.0, "Amplitude01": 10.0, "RhythmicityEngine01": 3.0, "Artifact01": 1.2, "aEEG01": 1.0,
    "PeakEnvelope01": 1.0, "SeizureProbabilityP1401": 1.0, "SpikeDensityV101": 1.0,
}

# ---- fixed values: sub-column contract and names ----
FIXED_SUBCOLUMNS = {
    "artifact_intensity": 3, "aeeg": 5, "seizure_detection_notif_pair": 2, "fft_spectrogram": 40,
    "asymmetry_spectrogram": 40, "coherence_spectrogram": 63, "rhythmicity_spectrogram": 97,
    "rhythmicity_freqpow": 16,
}
VARIABLE_SUBCOLUMNS = {"electrode_signal_quality": 22}
ALTERNATIVE_SUBCOLUMNS = {"rhythmicity_spectrogram": 73}
SINGLE_VALUE_FAMILIES = [
    "fft_power", "fft_power_ratio", "fft_edge_sef", "reasi", "easi", "coherence_avg", "suppression_ratio",
    "peak_envelope", "seizure_probability", "seizure_detection", "seizure_notification", "seizure_events_p14",
    "spike_density", "event_density", "boolean_indicator", "rhythmic_delta_indicator", "sleep_stages",
    "sleep_wake", "color_scaled_bars", "heart_rate", "time_avg", "sum_values_abs", "threshold", "comment",
    "time_display",
]
SUBCOLUMN_NAMES = {
    "artifact_intensity": ["emg", "eye_vertical", "eye_horizontal"],
    "aeeg": ["max", "min", "p50", "p75", "p25"],
    "seizure_detection": ["detection_event", "notification_event"],
    "electrode_quality": [
        "Fp1", "Fp2", "F7", "F3", "Fz", "F4", "F8", "T3", "C3", "Cz", "C4", "T4", "T5", "P3", "Pz", "P4", "T6",
        "O1", "O2", "A1", "A2", "EKG",
    ],
}
ASYMMETRY_BANDS = {"0 - 5 Hz": "delta", "6 - 14 Hz": "alpha", "0 - 20 Hz": "broadband"}
ASYMMETRY_REGIONS = {
    "Asym Hemi": "hemisphere", "Asym Anterior": "anterior", "Asym Posterior": "posterior",
    "Asym Parasagittal": "parasagittal", "Asym Temporal": "temporal",
}
FREQPOW_BANDS = ["1_4hz", "4_9hz", "9_16hz", "16_25hz"]
FREQPOW_VALUES = ["freq", "bandwidth", "power", "fraction"]

# ---- fixed values: placeholder patient ids ----
JUNK_IDS = ["x", "xx", "xxx", "xxxx", "xxxxx", "xxxxxx", "xxxxxxx", "test", "patient", "unknown", "na", "n/a", "none", ""]

# ---- fixed values: sub-column names by instrument number, used when no template resolves it ----
INSTRUMENT_SUBCOLUMNS = {
    116: ["left"], 117: ["right"], 118: ["generalized"],
    119: ["detection_event", "notification_event"],
    123: ["stage_raw"], 124: ["wake"], 125: ["n1"], 126: ["n2"], 127: ["n3"], 128: ["rem"],
    129: ["indeterminate"], 130: ["state_binary"],
    131: ["burst_bilateral"], 132: ["generalized_per_10s"], 133: ["generalized_per_sec"], 134: ["left_per_10s"],
    135: ["left_per_sec"], 136: ["right_per_10s"], 137: ["right_per_sec"], 138: ["vertex_per_sec"],
    139: ["all_foci_per_sec"], 140: ["threshold_right"], 141: ["threshold_generalized"], 142: ["threshold_left"],
    143: ["rate_display_left_right"], 144: ["rate_display_left_right"], 145: ["rate_display_with_gen"],
    146: ["rate_display_with_gen"],
    92: ["lad"], 93: ["lpd"], 94: ["lrd"], 95: ["rad"], 96: ["rpd"], 97: ["rrd"],
}
SPIKE_LEFT = ["Fp1", "FP1", "F3", "F7", "C3", "T3", "T7", "P3", "T5", "P7", "O1"]
SPIKE_RIGHT = ["Fp2", "FP2", "F4", "F8", "C4", "T4", "T8", "P4", "T6", "P8", "O2"]
SPIKE_LEFT_LABEL = ["fp1", "f3", "c3", "p3", "o1", "f7", "t3", "t5", "t7", "p7", "a1"]
SPIKE_RIGHT_LABEL = ["fp2", "f4", "c4", "p4", "o2", "f8", "t4", "t6", "t8", "p8", "a2"]
NATIVE_TAG = "persyst"

# ---- fixed values: label patterns of the sub-column contract, first match wins, any case ----
CONTRACT_PATTERNS = [
    (r"^Threshold\b", "threshold"),
    (r"^SumValues\b", "sum_values_abs"),
    (r"^Spike Rate ?Threshold", "boolean_indicator"),
    (r"^Boolean (?:LAD|LPD|LRD|RAD|RPD|RRD)\+", "boolean_indicator"),
    (r"^Spikes\s*>=", "boolean_indicator"),
    (r"^Rhythmic delta indicator", "rhythmic_delta_indicator"),
    (r"^Sleep-Wake (?:Stage|State)", "sleep_wake"),
    (r"^Artifact Intensity\b", "artifact_intensity"),
    (r"^Electrode Signal Quality\b", "electrode_signal_quality"),
    (r"^aEEG\b", "aeeg"),
    (r"^Rhythmicity Spectrogram FreqPow", "rhythmicity_freqpow"),
    (r"^Rhythmicity Spectrogram\b", "rhythmicity_spectrogram"),
    (r"^Coherence_Spectrogram\b", "coherence_spectrogram"),
    (r"^Coherence_Avg\b", "coherence_avg"),
    (r"^Asymmetry,?\s*Relative Spectrogram", "asymmetry_spectrogram"),
    (r"^Asymmetry,?\s*Absolute Index", "easi"),
    (r"^Asymmetry,?\s*Relative Index", "reasi"),
    (r"^FFT Spectrogram\b", "fft_spectrogram"),
    (r"^Seizure Detections.*Notifications", "seizure_detection_notif_pair"),
    (r"Seizure probability", "seizure_probability"),
    (r"Seizure Notifications", "seizure_notification"),
    (r"Seizure Detections", "seizure_detection"),
    (r"FFT Edge|SEF\d", "fft_edge_sef"),
    (r"FFT PowerRatio", "fft_power_ratio"),
    (r"FFT Power", "fft_power"),
    (r"^Suppression Ratio|^BSR\b", "suppression_ratio"),
    (r"^PeakEnvelope", "peak_envelope"),
    (r"^Spike Burst Detection", "boolean_indicator"),
    (r"^Spike Detections", "spike_density"),
    (r"^EventDensity", "event_density"),
    (r"^SleepStages\b", "sleep_stages"),
    (r"^Heart Rate\b", "heart_rate"),
    (r"^Time Avg\b", "time_avg"),
    (r"^Time \(\d+", "time_avg"),
    (r"^Comment\b", "comment"),
]

# ---- fixed values: unit of every family, units of variants (family, pattern of the lower-case name), names of electrode chains ----
FAMILY_UNITS = {
    "fft_power": "µV (amplitude; MMX PowerType=1 — NOT µV² power)",
    "fft_power_ratio": "ratio of µV amplitudes (dimensionless); clamped at Ratio Max 10",
    "adr": "ratio of µV amplitudes (dimensionless); clamped at Ratio Max 10. NOT a power ratio — equals the square root of a conventional power-based ADR, so do not compare directly to published values.",
    "relative_power": "band/broadband ratio of µV amplitudes (dimensionless); clamped at Ratio Max 10. NOT conventional relative power (band power ÷ total power) — equals its square root.",
    "alpha_variability": "RAV: 6–14/1–20 Hz ratio of µV amplitudes (dimensionless); clamped at Ratio Max 10",
    "fft_spectrogram": "µV/√Hz (amplitude spectral density = √(µV²/Hz); Persyst label 'sqrt(µV)/Hz'; square to get PSD µV²/Hz)",
    "asymmetry_spectrogram": "% (−100 to +100) per bin",
    "rhythmicity_spectrogram": "rhythmic spectral amplitude (µV/Hz)",
    "spectral_edge": "Hz",
    "asymmetry": "% (EASI 0–100 magnitude; REASI −100 to +100, + = right>left)",
    "suppression_ratio": "% (0–100)",
    "rhythmicity": "rhythmicity index",
    "rda": "rhythmicity index",
    "rhythmic_delta": "boolean (0/1)",
    "artifact_intensity": "muscle: µV (per Persyst 2026-08-20; help text says µV² — unconfirmed). V-Eye / L-Eye: probability 0.0–1.0",
    "electrode_quality": "dimensionless, 0=clean → 1.0; >1.0 = above impedance disconnect threshold. Clamped at the MMX display Maximum (1.2 in this template)",
    "aeeg": "µV (peak-to-peak)",
    "peak_envelope": "µV",
    "seizure_probability": "probability (0–1)",
    "seizure_detection": "boolean (0/1)",
    "seizure_notification": "boolean (0/1)",
    "status_epilepticus": "binary (0/1) or % (0–100) per variant. PERCENT variants floor at 0.050331, never 0; advanced and combined are identical",
    "seizure_burden": "% (0–100) or category code per variant",
    "spike_density": "spikes/sec",
    "coherence_spectrogram": "coherence (0–1)",
    "sleep": "sleep stage code",
    "heart_rate": "bpm",
    "annotation": "text",
    "time_display": "timestamp",
}
UNIT_VARIANTS = [
    (["status_epilepticus", "seizure_burden"], "_binary$|_binary_", "binary (0/1)"),
    (["status_epilepticus", "seizure_burden"], "_percent$|_percent_|_pct$", "% (0–100)"),
    (["status_epilepticus", "seizure_burden"], "categor", "category code"),
    (["sleep"], "stage_display|rate_display|sleepstages$", "sleep stage code (0=indeterminate, 1=N3, 2=N2, 3=N1, 4=REM, 5=wake)"),
    (["sleep"], "", "binary (0/1) — one-hot flag for this stage"),
]
ELECTRODE_CHAIN = r"[a-z]{1,3}\d{1,2}[a-z]{1,3}\d{1,2}"
