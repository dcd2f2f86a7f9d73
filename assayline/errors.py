"""Errors a caller can tell apart."""


class DataQualityError(ValueError):
    """Base of every refusal raised by this package."""


class ContractError(DataQualityError):
    """A rule's output does not follow the (id, field, dq_check) contract."""


class AccessError(DataQualityError):
    """A rule reads something it may not read, or is not a plain query."""


class PreviewTooLarge(DataQualityError):
    """A strict preview produced more rows than its limit."""


class ImportRejected(DataQualityError):
    """A batch was refused as a whole; nothing was saved."""


class SchemaRefused(DataQualityError):
    """A schema, mapping or column edit is not allowed."""


class HistoryInconsistent(DataQualityError):
    """Stored run history does not add up, so it is left untouched."""


class PublicationConflict(DataQualityError):
    """A definition changed since it was compared."""


class JobFailed(RuntimeError):
    """At least one rule of a scheduled job failed, or none was active."""
