"""Names that appear on the wire: headers, content-type marker, reference scheme, id preimage.

Every one of them starts with the registry's own prefix. Data written by another registry that
uses the same envelope is read by passing that registry's prefix.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Wire:
    prefix: str = "contract"

    @property
    def version(self) -> str:
        return f"{self.prefix}-v"

    @property
    def schema_id(self) -> str:
        return f"{self.prefix}-schema-id"

    @property
    def subject(self) -> str:
        return f"{self.prefix}-subject"

    @property
    def ordinal(self) -> str:
        return f"{self.prefix}-version"

    @property
    def semver(self) -> str:
        return f"{self.prefix}-semver"

    @property
    def format(self) -> str:
        return f"{self.prefix}-format"

    @property
    def content_marker(self) -> str:
        return f"+{self.prefix}.v1."

    @property
    def scheme(self) -> str:
        return self.prefix

    @property
    def preimage(self) -> str:
        return f"{self.prefix}-schema-id/v1"


# The envelope version and the media type of each schema format.
ENVELOPE_VERSION = "1"
MEDIA_TYPES = {
    "json": "application/json",
    "avro": "application/avro",
    "protobuf": "application/x-protobuf",
}

# Enforcement modes in rising strictness, and compatibility surfaces in rising reach.
OFF, MONITOR, ENFORCE = 1, 2, 3
WIRE, WIRE_JSON, SOURCE = 1, 2, 3

# Compatibility mode when neither the subject nor its environment sets one.
DEFAULT_MODE = "BACKWARD"
DEFAULT_SURFACE = WIRE_JSON
