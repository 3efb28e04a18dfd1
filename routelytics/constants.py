"""Fixed values.

Everything in this module must equal the source system's values for results to
match: value pools of the message generator, queue names, delivery priorities,
latency targets, consumer batch parameters and the nominal handling costs.
"""

# ---- fixed values: message value pools (generator order) -------------------
FRAUD_TYPES = ["fraud", "breach", "chargeback", "alert",
               "suspicious", "blacklisted", "aml", "sanction"]
BATCH_TYPES = ["analytics", "report", "sensor", "log", "metrics"]
URGENT_TYPES = ["payment", "transfer", "withdrawal"]
URGENT_PRIORITIES = ["critical", "emergency", "high", "urgent", "immediate"]
BATCH_PRIORITIES = ["low", "minimal", "routine", "scheduled", "deferred"]
ALL_PRIORITIES = URGENT_PRIORITIES + BATCH_PRIORITIES
URGENT_REGIONS = ["HIGH-RISK", "SANCTIONED"]
BATCH_REGIONS = ["DOMESTIC", "APAC", "EU", "LATAM", "AFRICA", "MONITORED"]
ALL_REGIONS = URGENT_REGIONS + BATCH_REGIONS
CURRENCIES = ["USD", "EUR", "GBP", "JPY", "INR", "AUD", "CAD"]
SOURCES = ["mobile", "web", "api", "atm", "pos"]

# ---- fixed values: queues ---------------------------------------------------
URGENT_QUEUE = "urgent.queue"
BATCH_QUEUE = "batch.queue"
DEAD_LETTER_QUEUE = "dead.letter.queue"
NAIVE_QUEUE = "naive.queue"
TOPIC = "events"
URGENT_DELIVERY_PRIORITY = 10
OTHER_DELIVERY_PRIORITY = 1
DEFAULT_LABEL = "batch"
NAIVE_RULE_LABEL = "none"

# ---- fixed values: report targets -------------------------------------------
URGENT_P95_TARGET_MS = 100
BATCH_P95_TARGET_MS = 300
MISSING_P95_MS = 999
CRITICAL_ACCURACY_TARGET = 99.0
ACCURACY_VIEW_THRESHOLD = 95.0
HISTORY_DEFAULT_LIMIT = 50
METRICS_WINDOW_ROWS = 1000
DEPTH_SAMPLES_KEPT = 30
DEPTH_SAMPLE_EVERY = "2 seconds"

# ---- fixed values: consumers ------------------------------------------------
BATCH_SIZE = 10
BATCH_TIMEOUT_MS = 5000
URGENT_CONSUMER = "urgent-consumer"
BATCH_CONSUMER = "batch-consumer"
# urgent action -> nominal handling ms, in decision order
URGENT_ACTION_COST_MS = {"fraud_alert": 100, "manual_approval": 80,
                         "block_transaction": 60, "fast_track": 50}
# batch type group -> nominal handling ms
BATCH_ACTION_COST_MS = {"warehouse_aggregate": 200, "generate_reports": 150,
                        "time_series_store": 100, "generic_batch": 100}
URGENT_ACTION_AMOUNT = 10000
URGENT_ACTION_RISK = 0.8
RISK_FLAG_THRESHOLD = 0.8

# ---- fixed values: rule engine ----------------------------------------------
OPERATORS = ("equals", "contains", "greaterThan", "lessThan")
