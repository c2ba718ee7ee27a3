"""Errors a caller can tell apart."""


class LodestoneError(Exception):
    code = "INTERNAL"


class NotFound(LodestoneError):
    code = "NOT_FOUND"


class InvalidArgument(LodestoneError):
    code = "INVALID_ARGUMENT"


class AlreadyExists(LodestoneError):
    code = "ALREADY_EXISTS"


class Unavailable(LodestoneError):
    code = "UNAVAILABLE"


class ResourceExhausted(LodestoneError):
    code = "RESOURCE_EXHAUSTED"


class PermissionDenied(LodestoneError):
    code = "PERMISSION_DENIED"


class QuerySyntaxError(InvalidArgument):
    def __init__(self, message: str, position: int):
        super().__init__(f"at character {position}: {message}")
        self.position = position
