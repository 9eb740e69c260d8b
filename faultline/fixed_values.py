"""Values that results depend on and that other tools read or write.

Fixed values: names, patterns, word lists and key spellings below must stay exactly
as they are. Do not "correct" the spelling of the result keys.
"""

# --- Raw log records --------------------------------------------------------------
HEADER_KEYS = ("priority", "timestamp", "host", "partition", "Facility", "topic", "Severity")
BODY_CHARSET = "ISO-8859-1"
UNKNOWN_HOST = "UNKNOWN_HOST"

# --- Memory-error messages --------------------------------------------------------
HOST_PREFIXES = ("login", "c20", "c21", "hsm212", "osshsm213", "oss21")
UPPER_MESSAGE_LIKE = "% EDAC %"
LOWER_MESSAGE_LIKE = "%memory%error%"
NOISE_MESSAGE_LIKE = "%HANDLING MCE MEMORY ERROR%"

# Field name -> pattern; the value is capture group 1.
ERROR_FIELD_PATTERNS = {
    "channel": r"channel:(\d+)",
    "slot": r"slot:(\d+)",
    "page": r"page:(0x[0-9a-f]+)",
    "offset": r"offset:(0x[0-9a-f]+)",
    "grain": r"grain:(\d+)",
    "syndrome": r"syndrome:(0x[0-9a-f]+)",
    "err_code": r"err_code:(0x[0-9a-f]+:0x[0-9a-f]+)",
    "SystemAddress": r"SystemAddress:(0x[0-9a-f]+)",
    "ProcessorSocketId": r"ProcessorSocketId:(0x[0-9a-f]+)",
    "MemoryControllerId": r"MemoryControllerId:(0x[0-9a-f]+)",
    "ChannelAddress": r"ChannelAddress:(0x[0-9a-f]+)",
    "ChannelId": r"ChannelId:(0x[0-9a-f]+)",
    "RankAddress": r"RankAddress:(0x[0-9a-f]+)",
    "PhysicalRankId": r"PhysicalRankId:(0x[0-9a-f]+)",
    "DimmSlotId": r"DimmSlotId:(0x[0-9a-f]+)",
    "Row": r"Row:(0x[0-9a-f]+)",
    "Column": r"Column:(0x[0-9a-f]+)",
    "Bank": r"Bank:(0x[0-9a-f]+)",
    "BankGroup": r"BankGroup:(0x[0-9a-f]+)",
    "ChipSelect": r"ChipSelect:(0x[0-9a-f]+)",
    "ChipId": r"ChipId:(0x[0-9a-f]+)",
    "cpu_info": r"on\s+(.*?)\(",
    "ce_error": r"(\d+\s+[A-Z]+\s+memory\s+\w+\s+error)",
}
CE_COUNT_PATTERN = r"(\d+)"

# Group 1 is the error class, groups 2-5 are socket, controller, channel and DIMM.
ERROR_CLASS_PATTERN = (
    r".*?(\bCE\b|\bUE\b|\bSBE\b|\bDBE\b).*?CPU_SrcID#(\d+?)_(?:MC|Ha)#(\d+?)_Chan#(\d+?)_DIMM#(\d+?).*"
)
ERROR_CLASS_LITERAL = "CPU_SrcID#"  # part of every match

# --- MTBF -------------------------------------------------------------------------
GAP_PERCENTILES = (0.25, 0.50, 0.75, 0.90)
MIN_GAPS_EXCLUSIVE = 5          # a host needs more gaps than this
MIN_BURST_GAPS_EXCLUSIVE = 2    # a percentile needs more burst gaps than this
GLOBAL_BURST_SECONDS = 5

# --- MTBF result documents --------------------------------------------------------
PERCENTILE_KEYS = ("percentil_0", "percentil_1", "percentil_2", "percentil_3")
SPARSE_KEY = "nopercetil"
PERCENTILE_LABELS = {
    "percentil_0": "25%",
    "percentil_1": "50%",
    "percentil_2": "75%",
    "percentil_3": "90%",
    "nopercetil": "N/A",
}
RESULT_MTBF_KEY = "mbtf"
RESULT_MTBF_KEY_ALTERNATIVE = "mtbf"

# --- Calendar profiles ------------------------------------------------------------
WEEKDAY_NUMBERS = (2, 3, 4, 5, 6)  # Sunday is 1
WEEKDAY_NAME, WEEKEND_NAME = "Semana", "Fin de semana"
MONTH_THIRDS = ("Inicio", "Mitad", "Final")
WEEKDAY_ORDER = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")
SEASON_DAYS = 7

# --- Learning ---------------------------------------------------------------------
LOOKAHEAD_SECONDS = 3600
TRAIN_FRACTION = 0.8
NEGATIVE_FRACTION = 0.05
SEED = 42
REPORT_THRESHOLDS = (0.05, 0.1, 0.2)
CURVE_THRESHOLDS = 101
SMOOTHING = 1e-6
LEAK_COLUMNS = ("target_window_start", "label_feature_window")
MODEL_FEATURES = (
    "num_logs", "num_errors", "avg_severity", "max_severity", "error_ratio",
    "hour", "dayofweek", "is_night", "is_weekend", "log_intensity",
)
