"""Column builders: string to number, string to time, names, digests."""

from tapelake.functions.digests import canonical_frame, canonical_prefix, rollup_digest
from tapelake.functions.names import archive_day, day_folder, file_day
from tapelake.functions.numbers import strip_edges, to_int64
from tapelake.functions.times import in_windows, is_short_time, to_time_ms, with_time_ms

__all__ = [
    "archive_day", "canonical_frame", "canonical_prefix", "day_folder", "file_day", "in_windows", "is_short_time", "rollup_digest", "strip_edges", "to_int64", "to_time_ms", "with_time_ms",
]
