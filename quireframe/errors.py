"""Errors meant for the person who asked."""

from __future__ import annotations


class UserError(Exception):
    """A message without a stack trace, at a level ('error', 'warn' or 'info')."""

    def __init__(self, message: str, level: str = "error") -> None:
        super().__init__(message)
        self.message, self.level = message, level


def as_header(error: BaseException, stack: str = "") -> dict[str, dict[str, str | None]]:
    """An error as ``{level: {message, stack}}``."""
    if isinstance(error, UserError):
        return {error.level: {"message": error.message, "stack": None}}
    return {"error": {"message": f"{type(error).__name__}: {error}", "stack": stack}}
