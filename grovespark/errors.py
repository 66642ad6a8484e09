"""One exception for each family of faults. Faults of rows become an `error` column or a diagnostics
table instead; these are for faults of a whole query."""


class VersionDataError(Exception):
    """The root of all."""


class ObjectNotFoundError(VersionDataError):
    pass


class InvalidObjectError(VersionDataError):
    pass


class InvalidOidError(VersionDataError):
    pass


class RepositoryError(VersionDataError):
    pass


class CircularReferenceError(VersionDataError):
    pass


class RefNotFoundError(VersionDataError):
    pass


class InvalidRefNameError(VersionDataError):
    pass


class RefSpecError(VersionDataError):
    pass


class RefUpdateError(VersionDataError):
    pass


class TransactionError(VersionDataError):
    pass


class PreconditionError(VersionDataError):
    pass


class PushError(VersionDataError):
    pass


class PackError(VersionDataError):
    pass


class InvalidPackError(PackError):
    pass


class PackIndexError(PackError):
    pass


class DeltaError(PackError):
    pass


class PktLineError(VersionDataError):
    pass


class RefAdvertisementError(PktLineError):
    pass


class SideBandError(VersionDataError):
    pass


class ProtocolError(VersionDataError):
    """A response or request that doesn't hold what its command says."""


class HistoryTooLargeError(VersionDataError):
    """More commits than one sequence is made of."""


class PathNotFoundError(VersionDataError):
    pass


class PathExistsError(VersionDataError):
    pass


class NotDirectoryError(VersionDataError):
    pass


class NotFileError(VersionDataError):
    pass


class NotSymlinkError(VersionDataError):
    pass


class OriginUnavailableError(VersionDataError):
    pass
