"""Error classes of the library."""

from __future__ import annotations


class Error(Exception):
    """Base of all errors raised here."""


class InvalidArgument(Error, ValueError):
    """A precondition on an argument does not hold."""


class NumericalFailure(Error, ArithmeticError):
    """The arithmetic broke down: a zero pivot, slope or curvature."""


class ConvergenceFailure(Error):
    """A caller insisted on convergence that did not happen."""


class BackendFailure(Error):
    """The execution layer failed."""


class ConfigurationError(Error):
    """An option names something unknown or out of range."""


def require(condition: bool, message: str) -> None:
    if not condition:
        raise InvalidArgument(message)
