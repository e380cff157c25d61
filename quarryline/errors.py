"""Typed errors. Messages name keys, never values."""

from __future__ import annotations


class EngineError(Exception):
    code = "E000"

    def __init__(self, message: str) -> None:
        super().__init__(f"{self.code}: {message}")


class NotFoundError(EngineError):
    code = "E001"


class TimeoutError_(EngineError):
    """Ran longer than its ``timeout``."""

    code = "E002"


class ValidationError(EngineError):
    code = "E003"


class ConnectionError_(EngineError):
    """A source cannot be reached."""

    code = "E004"


class RelationError(EngineError):
    code = "E005"


class MigrationError(EngineError):
    """Kept for its code; there are no migrations."""

    code = "E006"


class DepthError(EngineError):
    code = "E007"


class UniqueError(EngineError):
    """Rows to write repeat a unique key."""

    code = "E008"


class ForeignKeyError(EngineError):
    """A row points to a row that is not there."""

    code = "E009"


class NotNullError(EngineError):
    """A field that may not be null is."""

    code = "E010"


class CheckError(EngineError):
    """A row breaks a check of its table."""

    code = "E011"


class DeadlockError(EngineError):
    """Kept for its code; there is one writer at a time."""

    code = "E012"


class SerializationError(EngineError):
    """A table changed under a staged change."""

    code = "E013"


class PipelineError(EngineError):
    """Some reads of a pipeline failed; ``results`` holds what the others gave."""

    code = "E014"


class OptimisticLockError(EngineError):
    code = "E015"


class ExclusionError(EngineError):
    """Kept for its code."""

    code = "E016"


class UnsupportedError(EngineError):
    code = "E017"


class ReadOnlyError(ValidationError):
    """A change of a view."""

    code = "E018"


class _Marker:
    def __init__(self, name: str) -> None:
        self.name = name

    def __repr__(self) -> str:
        return self.name


#: Opts in to what is refused by default; a plain ``True`` does not.
UNSAFE = _Marker("UNSAFE")
#: A key with this value counts as not given.
UNSET = _Marker("UNSET")


def is_unsafe(flag: object) -> bool:
    if flag in (None, False) or flag is UNSET:
        return False
    if flag is UNSAFE:
        return True
    raise ValidationError("this option takes only the UNSAFE marker")
