"""Typed errors. `kind` tells them apart: format, scaling, range, source, budget or channel."""

from __future__ import annotations


class WaveError(Exception):
    kind = "error"


class FormatError(WaveError):
    """The file says something that cannot be read without inventing; code names what."""

    kind = "format"

    def __init__(self, diagnostic, collected=()):
        super().__init__(f"{diagnostic.code}: {diagnostic.message}")
        self.code, self.diagnostic, self.diagnostics = diagnostic.code, diagnostic, (*collected, diagnostic)

    def __reduce__(self):
        return type(self), (self.diagnostic, self.diagnostics[:-1])


class ScalingError(WaveError):
    kind = "scaling"

    def __init__(self, code: str, message: str, signal_index: int | None = None):
        super().__init__(f"{code}: {message}")
        self.code, self.signal_index = code, signal_index


class RecordRangeError(WaveError):
    kind = "range"

    def __init__(self, message: str, requested=None, available=None):
        super().__init__(message)
        self.requested, self.available = requested, available


class SourceError(WaveError):
    kind = "source"


class AbortError(WaveError):
    kind = "abort"

    def __init__(self, reason: str | None = None):
        super().__init__(f"ended early{f': {reason}' if reason else ''}")
        self.reason = reason


class BudgetError(WaveError):
    kind = "budget"

    def __init__(self, message: str, required_bytes: int, budget_bytes: int):
        super().__init__(message)
        self.required_bytes, self.budget_bytes = required_bytes, budget_bytes


class AmbiguousChannelError(WaveError):
    kind = "channel"

    def __init__(self, label: str, indices: list[int]):
        super().__init__(f"label {label!r} names signals {indices}; select one by index")
        self.label, self.indices = label, indices


class ChannelNotFoundError(WaveError):
    kind = "channel"

    def __init__(self, selector, labels: list[str]):
        super().__init__(f"no signal {selector!r}; the file has {labels}")
        self.selector, self.labels = selector, labels


def is_wave_error(value) -> bool:
    return isinstance(value, WaveError)
