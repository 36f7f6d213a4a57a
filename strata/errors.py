"""What can go wrong with archives."""

from __future__ import annotations


class StrataError(Exception):
    """Any of the errors below."""


class InvalidArchive(StrataError):
    """The bytes or tables aren't those of an archive."""

    def __init__(self, why: str):
        super().__init__(f"not a readable archive: {why}")


class IntegrityFailure(StrataError):
    """A chunk isn't what its address says."""

    def __init__(self, expected: str, actual: str):
        super().__init__(f"the chunk addressed {expected} hashes to {actual}")
        self.expected, self.actual = expected, actual


class DecompressError(StrataError):
    """A codec can't make sense of a payload."""

    def __init__(self, why: str):
        super().__init__(f"a payload can't be decoded: {why}")


class CoherenceError(StrataError):
    """Tables of one archive contradict each other."""

    def __init__(self, why: str):
        super().__init__(f"the archive contradicts itself: {why}")


class UnsupportedBackend(StrataError):
    """No codec is registered under a tag."""

    def __init__(self, tag: int):
        super().__init__(f"no codec has the tag {tag}")
        self.tag = tag
