"""Errors that a caller can tell apart. Unreadable geometry of a single object is data, not an error."""


class SluiceError(Exception):
    """Any error of this package."""


class DatasetError(SluiceError):
    """A dataset cannot be read, cut, merged or written."""


class FileError(DatasetError):
    """A file is missing or cannot be opened or written."""


class EncodingError(DatasetError):
    """Bytes are neither UTF-8 nor in the fallback encoding."""


class TurtleError(DatasetError):
    """Text is not Turtle, or uses what does not belong in a dataset."""


class ContentError(DatasetError):
    """A dataset holds no network."""


class BoundaryError(DatasetError):
    """A boundary layer cannot be used."""


class CutError(DatasetError):
    """A dataset cannot be cut, or parts cannot be merged."""


class EngineError(DatasetError):
    """An evaluation did not end within its bound."""


class GeometryError(ValueError):
    """A GML literal cannot be read as a geometry."""
