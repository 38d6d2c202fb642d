"""Fixed values of the analysis, gathered in one place.

Everything below must equal the published configuration for results to agree.
"""

# Line formats: the loose quality check and the strict header.
LINE_FORMAT = r"^\d{6}\s+\d{6}\s+\d+\s+[A-Z]+\s+[^\n]+$"
HEADER = r"^(\d{6})\s+(\d{6})\s+(\d+)\s+([A-Z]+)\s+([^:]+):\s+([^\n]*)$"
BLOCK_ID = r"blk_-?\d+"

# Masks in the order they are applied.
MASKS = (
    (r"blk_-?\d+", "<BlockId>"),
    (r"(\d{1,3}\.){3}\d{1,3}:\d{1,5}", "<IPPORT>"),
    (r"(\d{1,3}\.){3}\d{1,3}", "<IP>"),
)
WILDCARD = "<*>"
EXTRA_DELIMITER = "_"

# Template mining.
SIMILARITY_THRESHOLD = 0.4
MAX_CHILDREN = 100
TOP_TEMPLATES = 20

# Collection.
LOG_EXTENSIONS = (".log", ".txt", ".csv")
SAMPLE_LINES = 5
MALFORMED_RATIO = 0.01
REJECT_SAMPLE = 20

# Features.
KNOWN_LEVELS = ("INFO", "WARN", "ERROR")
DENSITY_EPSILON = 1e-6
BASE_FEATURES = (
    "total_log_events",
    "unique_template_count",
    "unique_component_count",
    "time_duration_seconds",
    "event_sequence_length",
    "event_density",
    "info_count",
    "warn_count",
    "error_count",
    "other_count",
)

# Labels and splits.
NORMAL, ANOMALY = "Normal", "Anomaly"
SEED = 42
TRAIN_RATIO = 0.8
VALIDATION_RATIO = 0.5

# Feature selection.
CORRELATION_LIMIT = 0.95
VARIANCE_FLOOR = 1e-6

# Isolation forests: current and baseline settings.
FOREST = {"n_trees": 200, "max_samples": 0.5}
BASELINE_FOREST = {"n_trees": 200, "max_samples": 256}

# Autoencoder.
ENCODING_DIMS = (32, 16, 8)
LEARNING_RATE = 1e-3
BATCH_SIZE = 256
EPOCHS = 50
AE_VALIDATION_RATIO = 0.1
PATIENCE = 5
CONTAMINATION = 0.03

# Fusion.
IF_WEIGHT, AE_WEIGHT = 0.10, 0.90
FUSION_THRESHOLD = 0.323459
WEIGHT_GRID = (0.3, 0.4, 0.5, 0.6, 0.7)
WEIGHT_GRID_FULL = (0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)
WEIGHT_GRID_AE_DOMINANT = (0.05, 0.10, 0.15, 0.20)
STRATEGIES = ("weighted_raw", "weighted_normalized", "rank", "max")
RECALL_FLOOR = 0.80
BETA = 1.0

# Evaluation.
PRECISION_AT = (50, 100, 500, 1000, 2000, 5000)
CALIBRATED_CUTOFF = 0.5

# Triage.
CRITICAL_SCORE, HIGH_SCORE, MEDIUM_SCORE = 0.75, 0.323459, 0.15
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
PRIORITY = {"CRITICAL": 1, "HIGH": 2, "MEDIUM": 3, "LOW": 4}
UNKNOWN_PRIORITY = 99
TRIAGE_STATUS = {
    "CRITICAL": "Needs Investigation",
    "HIGH": "Needs Investigation",
    "MEDIUM": "Monitor",
    "LOW": "No Action Needed",
}
UNKNOWN_STATUS = "Unknown"
SEVERITY_BANDS = ((0, 25, "Low"), (26, 50, "Medium"), (51, 75, "High"), (76, 100, "Critical"))
HISTOGRAM_BINS = 60
SCATTER_ROWS = 20000
TOP_SUSPICIOUS = 15
TOP_TOTALS = 15

# Feature labels.
FEATURE_LABELS = {
    "total_log_events": "Total log events",
    "unique_template_count": "Unique template count",
    "event_sequence_length": "Event sequence length",
    "time_duration_seconds": "Block duration (s)",
    "unique_component_count": "Unique component count",
    "event_density": "Event density",
    "info_count": "INFO-level count",
    "warn_count": "WARN-level count",
    "error_count": "ERROR-level count",
    "other_count": "Other-level count",
}
LABEL_LENGTH = 70
NO_TEMPLATE = "(template text unavailable)"

# Attribution.
BACKGROUND_ROWS = 60
NORMAL_BACKGROUND_ROWS = 50
AE_COALITIONS = 120
MORE_COALITIONS = 2048  # besides two for each feature
TOP_ABSOLUTE = 10
TOP_SIGNED = 5
TOP_WATERFALL = 8
TOP_TEMPLATE_FEATURES = 12
