"""Kinds of errors, each with the exit code of a command that ends by it."""

from __future__ import annotations


class EngineError(Exception):
    """What the engine itself refuses or can't do."""

    exit_code = 1


class ConfigError(EngineError, ValueError):
    """Parameters that make no sense."""

    exit_code = 2


class BuildError(EngineError, RuntimeError):
    """A build that can't be finished."""

    exit_code = 3


class IntegrityError(EngineError, ValueError):
    """Tables that contradict each other or themselves."""

    exit_code = 4


def exit_code(error: BaseException) -> int:
    """The code of the first error in the chain that has one; 1 for any other."""
    seen: BaseException | None = error
    while seen is not None:
        if isinstance(seen, EngineError):
            return seen.exit_code
        seen = seen.__cause__ or seen.__context__
    return 1
