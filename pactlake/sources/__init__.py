from .files import (
    contract_files,
    export_latest,
    latest_export,
    read_contract_dir,
    read_messages,
    sample_queue,
    stream_messages,
)
from .snapshots import SnapshotRegistry, publish_snapshot

__all__ = [
    "SnapshotRegistry",
    "contract_files",
    "export_latest",
    "latest_export",
    "publish_snapshot",
    "read_contract_dir",
    "read_messages",
    "sample_queue",
    "stream_messages",
]
