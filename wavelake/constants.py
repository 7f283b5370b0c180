"""Numbers and names of the file format (fixed values)."""

from __future__ import annotations

BLOCK_BYTES = 256
ANNOTATION_LABELS = ("EDF Annotations", "BDF Annotations")
RECOMMENDED_RECORD_BYTES = 61_440
TICKS_PER_SECOND = 10_000_000
DIGITAL_LIMITS = {2: (-32_768, 32_767), 3: (-8_388_608, 8_388_607)}
MAX_SIGNALS = 9_999
DEFAULT_BUDGET_BYTES = 256 * 1024 * 1024
SCAN_BYTES = 4 * 1024 * 1024
INSPECT_BYTES = 128 * 1024
INT64_MIN, INT64_MAX = -(2**63), 2**63 - 1
ONSET_END, TEXT_END, TAL_END = 0x15, 0x14, 0x00

#: name: (offset, length) in the fixed header.
FIXED_FIELDS = {
    "version": (0, 8),
    "patient_id": (8, 80),
    "recording_id": (88, 80),
    "start_date": (168, 8),
    "start_time": (176, 8),
    "header_byte_length": (184, 8),
    "reserved": (192, 44),
    "record_count": (236, 8),
    "record_duration": (244, 8),
    "signal_count": (252, 4),
}
#: name: (offset of the field's block per signal, width) in the signal headers, which are field-major.
SIGNAL_FIELDS = {
    "label": (0, 16),
    "transducer_type": (16, 80),
    "physical_dimension": (96, 8),
    "physical_minimum": (104, 8),
    "physical_maximum": (112, 8),
    "digital_minimum": (120, 8),
    "digital_maximum": (128, 8),
    "prefiltering": (136, 80),
    "samples_per_record": (216, 8),
    "reserved": (224, 32),
}


def signal_field_offset(name: str, signal_count: int, signal_index: int) -> int:
    block, width = SIGNAL_FIELDS[name]
    return BLOCK_BYTES + signal_count * block + signal_index * width
