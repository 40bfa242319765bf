"""Errors that callers can tell apart."""

from __future__ import annotations


class LinkedReadError(ValueError):
    """Any error in arguments or input."""


class UndeterminedChemistry(LinkedReadError):
    """No barcode format was found in the records that were looked at."""


class WhitelistError(LinkedReadError):
    """A barcode list that can't be used."""


class CapacityError(LinkedReadError):
    """A style has fewer barcodes than are needed."""


class SampleSizeError(LinkedReadError):
    """More barcodes are asked for than there are."""
