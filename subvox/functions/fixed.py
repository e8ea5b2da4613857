"""They must equal the published ones for results to agree."""

# --- fixed values: band-pass presets (low Hz, high Hz, order, lowest usable rate Hz, exclusive) ---
MODES: dict[str, tuple[float, float, int, float]] = {
    "standard": (1.0, 50.0, 4, 0.0),
    "clinical": (0.5, 8.0, 4, 0.0),
    "wide": (20.0, 450.0, 4, 920.0),
    "gowda": (80.0, 1000.0, 3, 2020.0),
}
NOTCH_HZ = 60.0
NOTCH_Q = 30.0

# --- fixed values: packet header ---
PACKET_MAGIC = b"OA"
PACKET_VERSION = 1
PACKET_HEADER_BYTES = 20

# --- fixed values: phone inventory, class 0 is the blank ---
PHONES: list[str] = [
    "<blank>",
    "AA", "AE", "AH", "AO", "AW", "AY", "B", "CH", "D", "DH", "EH", "ER", "EY", "F", "G", "HH", "IH", "IY", "JH", "K",
    "L", "M", "N", "NG", "OW", "OY", "P", "R", "S", "SH", "T", "TH", "UH", "UW", "V", "W", "Y", "Z", "ZH",
]

# --- fixed values: relative phone durations, and mean durations in ms ---
PHONE_WEIGHT: dict[str, float] = {
    "AA": 1.0, "AE": 0.95, "AH": 0.85, "AO": 1.0, "AW": 1.1, "AY": 1.1, "B": 0.35, "CH": 0.45, "D": 0.35, "DH": 0.4,
    "EH": 0.9, "ER": 0.95, "EY": 1.0, "F": 0.5, "G": 0.4, "HH": 0.35, "IH": 0.85, "IY": 0.9, "JH": 0.45, "K": 0.35,
    "L": 0.55, "M": 0.5, "N": 0.5, "NG": 0.55, "OW": 1.0, "OY": 1.05, "P": 0.35, "R": 0.55, "S": 0.5, "SH": 0.55,
    "T": 0.35, "TH": 0.45, "UH": 0.85, "UW": 0.95, "V": 0.5, "W": 0.55, "Y": 0.55, "Z": 0.5, "ZH": 0.55,
}
PHONE_WEIGHT_OTHER = 0.6
PHONE_MS: dict[str, float] = {
    "AA": 95, "AE": 88, "AH": 72, "AO": 98, "AW": 110, "AY": 105, "B": 55, "CH": 68, "D": 52, "DH": 58,
    "EH": 82, "ER": 92, "EY": 95, "F": 75, "G": 58, "HH": 50, "IH": 78, "IY": 85, "JH": 65, "K": 55,
    "L": 70, "M": 68, "N": 68, "NG": 72, "OW": 98, "OY": 102, "P": 55, "R": 72, "S": 78, "SH": 82,
    "T": 52, "TH": 62, "UH": 75, "UW": 88, "V": 72, "W": 70, "Y": 68, "Z": 75, "ZH": 80,
}
PHONE_MS_OTHER = 80.0

# --- fixed values: command-word lexicon ---
BASE_LEXICON: dict[str, list[str]] = {
    "yes": ["Y", "EH", "S"],
    "no": ["N", "OW"],
    "left": ["L", "EH", "F", "T"],
    "right": ["R", "AY", "T"],
    "select": ["S", "AH", "L", "EH", "K", "T"],
    "cancel": ["K", "AE", "N", "S", "AH", "L"],
    "up": ["AH", "P"],
    "down": ["D", "AW", "N"],
    "help": ["HH", "EH", "L", "P"],
    "start": ["S", "T", "AA", "R", "T"],
    "stop": ["S", "T", "AA", "P"],
    "ok": ["OW", "K", "EY"],
    "enter": ["EH", "N", "T", "ER"],
    "back": ["B", "AE", "K"],
    "menu": ["M", "EH", "N", "Y", "UW"],
}

# --- fixed values: slot word sets of the date trials ---
WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
MONTHS = [
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
]
YEAR_PREFIXES = ["nineteen_", "two_thousand_"]

# --- fixed values: trial layout and splits ---
TRIAL_SAMPLES = 45_000
TRIAL_WORD_SAMPLES = [10_000, 10_000, 10_000, 15_000]
TRAIN_TRIALS, VAL_TRIALS, TEST_TRIALS, SIM_TRIALS = 370, 30, 100, 500
LM_WEIGHTS = [0.0, 0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0]

# --- fixed values: shrinkage and window of the covariance features ---
SPD_ETA, SPD_WINDOW_MS, SPD_STEP_MS = 0.1, 100, 50

# --- fixed values: adaption of the token gate (smoothed confidence that lowers or raises the threshold, step, pull) ---
GATE_EASY, GATE_HARD, GATE_STEP, GATE_PULL = 0.85, 0.60, 0.02, 0.05

# --- fixed values: reasons in recalibration messages ---
REASON_DEFICIT, REASON_MOTION = "snr_deficit_%.1fdb", "motion_index_%.2f"
REASON_STREAK, REASON_UNKNOWN = "sustained_low_snr", "missing_baseline_or_session_snr"

# --- fixed values: a word's phones in a pronunciation list ---
PHONE_PATTERN = r"^[A-Za-z@][A-Za-z0-9@\-]*$"

# Notes on recordings and labels.
NOTE_SNR, NOTE_MOTION = "signal only %.2f dB above noise (want more than 15)", "motion index %.3f is above 0.2"
NOTE_LABEL = "label %s: %d samples, fewer than %d"
