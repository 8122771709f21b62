"""Exceptions; all are raised while a plan is built or a small source is read."""


class TagError(Exception):
    """Base of all errors of this library."""


class PatternError(TagError, ValueError):
    """A tag pattern, column spec or query that cannot be read."""


class RecipeError(TagError):
    """A recipe with an unknown step or a missing argument."""


class SourceError(TagError, OSError):
    """A source that cannot be read."""


class HTMLSourceError(SourceError):
    """A source that is a web page."""


class AuthorizationError(SourceError):
    """A source that may not be read."""


class TagsNotFoundError(SourceError):
    """A source without a row of hashtags."""


class SchemaError(TagError):
    """A validation schema that cannot be read."""
