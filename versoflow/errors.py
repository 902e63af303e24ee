"""Errors raised on the driver."""

from __future__ import annotations


class VersoflowError(Exception):
    """Base of all errors: a message and, if known, details."""

    def __init__(self, message: str, **details: object) -> None:
        super().__init__(message)
        self.message, self.details = message, details

    def __str__(self) -> str:
        return f"{self.message} ({', '.join(f'{k}={v!r}' for k, v in self.details.items())})" if self.details else self.message

    def as_dict(self) -> dict[str, object]:
        return {"error": type(self).__name__, "message": self.message, **self.details}


class ConfigError(VersoflowError):
    """A setting out of its range."""


class SourceError(VersoflowError):
    """A file or table that can't be read as what it should be."""


class ResponseError(VersoflowError):
    """A reply of a translation backend that can't be used."""


class RenderError(VersoflowError):
    """Output that can't be produced."""
