"""Status vocabularies that appear as values in receipts and reports."""

from __future__ import annotations

# They must equal the strings recorded in receipts.
EVALUATED_STATUSES = ("CORRECT", "INCORRECT")
EVALUATION_STATUSES = ("CORRECT", "INCORRECT", "NON_EVALUABLE", "ERROR")
TRANSITION_LABELS = ("W_TO_C", "W_TO_W", "C_TO_C", "C_TO_W")
WRONG_START_LABELS = ("W_TO_C", "W_TO_W")
FAILED_STATUSES = ("FAILED", "INTERRUPTED_UNKNOWN")
STARTED_EVENT = "INTENT_STARTED"
TERMINAL_EVENT_STATES = {
    "RUNTIME_LOAD_COMPLETED": "COMPLETED",
    "RUNTIME_LOAD_FAILED": "FAILED",
    "BASE_COMPLETED": "COMPLETED",
    "BASE_FAILED": "FAILED",
    "CHECKPOINT_COMPLETED": "COMPLETED",
    "CHECKPOINT_FAILED": "FAILED",
    "INTERRUPTED_UNKNOWN": "INTERRUPTED_UNKNOWN",
}

NOT_RECORDED = "NOT_RECORDED"
