"""Errors by kind."""

from __future__ import annotations

from enum import StrEnum


class MediaKind(StrEnum):
    # What can be wrong with a clip
    NOT_FOUND = "NotFound"
    PROBE_FAILED = "ProbeFailed"
    DECODE_FAILED = "DecodeFailed"
    ENCODE_FAILED = "EncodeFailed"
    INVALID_METADATA = "InvalidMetadata"


class ServiceKind(StrEnum):
    # What can go wrong with the inference service
    SPAWN_FAILED = "SpawnFailed"
    IPC = "Ipc"
    SERVER_ERROR = "ServerError"
    TIMEOUT = "Timeout"
    IMAGE_ERROR = "ImageError"
    OOM = "Oom"
    INIT_FAILED = "InitFailed"


class MediaError(Exception):
    """A clip that cannot be read, graded or written; ``kind`` says at which step."""

    def __init__(self, kind: MediaKind, message: str):
        super().__init__(f"{kind}: {message}")
        self.kind = kind


class MediaNotFound(MediaError, FileNotFoundError):
    def __init__(self, path: str):
        MediaError.__init__(self, MediaKind.NOT_FOUND, path)


class FrameSizeError(MediaError, ValueError):
    """A frame whose bytes do not fit its width and height."""

    def __init__(self, kind: MediaKind, what: str):
        MediaError.__init__(self, kind, what)


class ServiceError(Exception):
    """An answer of the service that is none; ``kind`` is what :func:`protocol.dispatch` calls error_kind."""

    def __init__(self, kind: ServiceKind, message: str):
        super().__init__(f"{kind}: {message}")
        self.kind = kind
