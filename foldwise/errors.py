"""Errors raised when a table breaks its contract."""


class ContractViolation(ValueError):
    """A table does not meet the contract that an operator states."""


class LabelAccessError(PermissionError):
    """Labels were asked for by an operation that may not read them."""
