"""Exceptions, one family per kind of failure."""

from __future__ import annotations


class StrataError(Exception):
    """Base of all."""


class ReadError(StrataError):
    """Bytes that are not what the format asks for; knows where."""

    def __init__(self, message: str, position: int = 0, span: tuple[int, int] = (0, 0), data: bytes = b"", before: int = 0):
        super().__init__(f"{message} at byte {position} (offsets {span[0]} to {span[1]})")
        self.message, self.position, self.span, self.data = message, position, span, data
        self.before = before  # bytes ahead of data

    def display(self) -> str:
        """The bytes around the failure in hex, with carets under the span."""
        at = max(0, self.position - self.before)
        shown = self.data[at : at + max(16, self.span[1])]
        line = " ".join(f"{b:02X}" for b in shown)
        marks = " ".join("^^" if self.span[0] <= i < self.span[1] else "  " for i in range(len(shown)))
        return f"{self}\n{line}\n{marks.rstrip()}"


class ArgError(StrataError):
    """An argument that can't be used."""


class ElementOp(StrataError):
    """A change of an element that its state does not allow."""


class EltNotFound(ElementOp):
    pass


class IdClash(ElementOp):
    pass


class IdGenFailure(ElementOp):
    pass


class PatchOp(StrataError):
    """A commit that can't be applied."""


class NoParent(PatchOp):
    pass


class WrongParent(PatchOp):
    pass


class PatchApply(PatchOp):
    pass


class PathError(StrataError):
    def __init__(self, message: str, path: str):
        super().__init__(f"{message}: {path}")
        self.path = path


class MatchError(StrataError):
    """A prefix that names no state, or more than one."""


class NoMatch(MatchError):
    pass


class MultiMatch(MatchError):
    def __init__(self, first: str, second: str):
        super().__init__(f"more than one state matches: {first}, {second}")
        self.first, self.second = first, second


class TipError(StrataError):
    pass


class NotReady(TipError):
    pass


class MergeRequired(TipError):
    pass


class MergeError(StrataError):
    pass


class NoState(MergeError):
    pass


class NoCommonAncestor(MergeError):
    pass


class NotSolved(MergeError):
    pass


class ReadOnly(StrataError):
    pass


class UserError(StrataError):
    def __init__(self, code: int, message: str):
        super().__init__(f"{message} ({code})")
        self.code = code


class CmdFailed(StrataError):
    """An external command, such as an editor, failed."""


class OtherError(StrataError):
    pass
