"""Readers for the inputs of the jobs."""

from clusterloom.sources.readers import (
    TRAFFIC_METADATA_SCHEMA,
    TRAFFIC_RAWDATA_SCHEMA,
    read_audit_log,
    read_items,
    read_traffic_metadata,
    read_traffic_rawdata,
    session_lines,
)

__all__ = [
    "TRAFFIC_METADATA_SCHEMA",
    "TRAFFIC_RAWDATA_SCHEMA",
    "read_audit_log",
    "read_items",
    "read_traffic_metadata",
    "read_traffic_rawdata",
    "session_lines",
]
