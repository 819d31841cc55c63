"""Stable error codes carried in result rows, and the exception for misuse of scalar arguments."""

# Codes that result rows carry.
LAYOUT = "LAYOUT"
INVALID_PARAMETER = "INVALID_PARAMETER"
UNKNOWN_EFFECT = "UNKNOWN_EFFECT"
GRAPH = "GRAPH"


class OperatorError(ValueError):
    """A call that can never succeed, whatever the data."""

    def __init__(self, code: str, reason: str):
        super().__init__(f"{code}: {reason}")
        self.code = code
        self.reason = reason


def within(name: str, value: float, low: float, high: float = float("inf")) -> float:
    """``value`` if it lies in its range; operators refuse other values instead of moving them."""
    if not low <= value <= high:
        raise OperatorError(INVALID_PARAMETER, f"{name} must be in [{low}, {high}], got {value}")
    return value
