"""What can go wrong: one exception for each kind of failure that callers tell apart."""


class TesseraError(Exception):
    """Any failure of a command."""


class NotFound(TesseraError):
    """A key, document, stream, collection, graph, branch, tag or index that is not there."""


class InvalidInput(TesseraError):
    """A key, name, path, value or vector that is not allowed."""


class WrongDimension(InvalidInput):
    """A vector of another length than its collection's."""


class AlreadyExists(TesseraError):
    """A branch, collection, index or type that is there already."""


class Conflict(TesseraError):
    """A transaction or merge that met other changes; the caller may try again."""


class ConstraintViolation(TesseraError):
    """Data that a frozen ontology or a policy forbids."""


class TransactionState(TesseraError):
    """A command that needs, or must not have, an open transaction."""


class NotImplementedHere(TesseraError):
    """A command that has no meaning in this engine."""
