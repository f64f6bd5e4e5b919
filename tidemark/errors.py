"""One exception hierarchy for the engine."""


class TidemarkError(Exception):
    """Base of all errors of the engine."""


class CatalogError(TidemarkError):
    """The store's metadata could not be read or written."""


class CatalogCorrupted(CatalogError):
    """The manifest is malformed or of an unknown version."""


class BitmapIo(TidemarkError):
    """A data file could not be read or written."""


class BitmapCorrupted(TidemarkError):
    """Serialised set bytes are malformed."""


class GranularityMismatch(TidemarkError):
    """A write's period is not of the event's finest granularity."""


class InvalidEventName(TidemarkError):
    """An event name is empty or holds a character that is not allowed."""


class InvalidPeriod(TidemarkError):
    """A period, or a range of periods, is not valid."""


class EventAlreadyRegistered(TidemarkError):
    """An event of that name exists."""


class ReadOnly(TidemarkError):
    """A read-only store was asked to change."""


class Closed(TidemarkError):
    """The store is closed."""


class Configuration(TidemarkError):
    """An option or a limit is not met."""
