"""Exceptions of the public API."""


class QuillonError(Exception):
    """Base of all errors raised on purpose."""


class ConfigurationError(QuillonError):
    """A setting is unknown, has a wrong type or is out of range."""


class DatasetError(QuillonError):
    """The input cannot be read as a table, or lacks a named column."""


class OutputError(QuillonError):
    """A path may not be written."""


class ModelError(QuillonError):
    """A model cannot be fitted or applied."""
