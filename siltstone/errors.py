class SiltstoneError(Exception):
    """Any error of this package."""


class ClosedError(SiltstoneError):
    """The engine or log is closed."""


class TooBigError(SiltstoneError):
    """A request has too many bytes."""


class OutOfOrderError(SiltstoneError):
    """A log record does not follow the last one."""


class OutOfRangeError(SiltstoneError):
    """A truncation index is not in the log."""


class NotFoundError(SiltstoneError):
    """No such log record."""


class CorruptError(SiltstoneError):
    """Stored bytes can't be read."""


class ManifestError(SiltstoneError):
    """A manifest change contradicts the manifest."""
