"""Errors: wrong arguments and data are ValueErrors, failures of files are OSErrors."""


class RankError(ValueError):
    """The root of what this library raises for wrong arguments and data."""


class ShapeError(RankError):
    """A dimension, bit width or vector length that doesn't fit."""


class InvalidVectorError(RankError):
    """A coordinate that is null, NaN, infinite or too large."""


class DuplicateIdError(RankError):
    """An id that is there already, or twice in a batch."""


class UnknownIdError(RankError):
    """An id or slot that the index doesn't have."""


class MissingSignError(RankError):
    """Sign bits are required and the index has none, or can't have any."""


class OptionError(RankError):
    """Contradictory or senseless options."""


class RankedListError(RankError):
    """A ranked list with non-finite scores, a wrong order or repeated rows."""


class ModelError(RankError):
    """A ranking model or its features are not valid."""


class FilterError(RankError):
    """A metadata filter that can't be evaluated."""


class StoreError(RankError):
    """A store, bundle or manifest that doesn't verify."""


class StaleRevisionError(StoreError):
    """Someone else has published since this revision was read."""


class StorePathWarning(UserWarning):
    """A path that holds something else, or a store already."""


class UnsavedWriteWarning(UserWarning):
    """Records were written to a store in memory that is bound to a path, and not saved."""


class UnknownFilterKeyWarning(UserWarning):
    """A filter names a metadata key that no record has."""
