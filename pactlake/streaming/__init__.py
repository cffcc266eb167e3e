from .jobs import (
    ROCKSDB,
    quarantine_sink,
    stream_conformance,
    stream_service_state,
    stream_violation_rollup,
)
from .windows import stream_flush_windows

__all__ = [
    "ROCKSDB",
    "quarantine_sink",
    "stream_conformance",
    "stream_flush_windows",
    "stream_service_state",
    "stream_violation_rollup",
]
