"""Typed errors. Messages never hold texts, tokens or permission sets."""


class GatehouseError(Exception):
    """Base of all errors of this package."""


class InvalidPrincipalError(GatehouseError):
    """A principal or group id is malformed or reserved."""


class InvalidDocumentError(GatehouseError):
    """A document, chunk or source reference is malformed."""


class InvalidRequestError(GatehouseError):
    """A request is malformed."""


class EmbeddingError(GatehouseError):
    """Texts could not be embedded."""


class RerankError(GatehouseError):
    """Candidates could not be reranked."""


class VectorIndexError(GatehouseError):
    """The index is missing, damaged or of another dimension."""


class StoreError(GatehouseError):
    """The document tables can't be read or written."""


class AclResolutionError(GatehouseError):
    """Permissions could not be resolved; callers treat this as an empty set."""


class AuthError(GatehouseError):
    """The forwarded identity is missing or malformed."""


class SourceError(GatehouseError):
    """A source could not be listed, read or asked for its access rules."""
