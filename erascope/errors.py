"""Error types raised by the library."""


class PanelError(Exception):
    """Base class."""


class SchemaMismatch(PanelError):
    """Parts that are to be stacked differ in column names or types."""


class PanelCheckFailed(PanelError):
    """A data-quality rule found violating rows."""


class BadFeatureValue(PanelError):
    """A feature or target code lies outside the allowed range."""


class NotTrained(PanelError):
    """A model was used before it was fitted."""


class SingularSystem(PanelError):
    """The normal equations have no unique solution."""
