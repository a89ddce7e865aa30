"""Stores of numbered snapshots and logs as byte strings: in memory, or nowhere."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from strata.errors import ReadOnly


def pieces(data: bytes | Iterable[bytes]) -> Iterable[bytes]:
    return (data,) if isinstance(data, bytes | bytearray) else data


def joined(parts: Iterable[bytes], size: int = 1 << 20) -> Iterator[bytes]:
    """The same bytes in fewer pieces: small ones are joined up to ``size``."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part)
        if n >= size:
            yield b"".join(held)
            held, n = [], 0
    if held:
        yield b"".join(held)


class MemoryStore:
    """Keeps what is written; never replaces it. A log needs its snapshot's number."""

    def __init__(self, readonly: bool = False):
        self.readonly = readonly
        self.snapshots: dict[int, bytes] = {}
        self.logs: dict[tuple[int, int], bytes] = {}

    def _writable(self) -> None:
        if self.readonly:
            raise ReadOnly("the store is read-only")

    def ss_len(self) -> int:
        return max([*self.snapshots, *(s for s, _ in self.logs)], default=-1) + 1

    def cl_len(self, ss: int) -> int:
        return max((c for s, c in self.logs if s == ss), default=-1) + 1

    def has_snapshot(self, ss: int) -> bool:
        return ss in self.snapshots

    def read_snapshot(self, ss: int) -> bytes | None:
        return self.snapshots.get(ss)

    def read_log(self, ss: int, cl: int) -> bytes | None:
        return self.logs.get((ss, cl))

    def new_snapshot(self, ss: int, data: bytes | Iterable[bytes]) -> bool:
        self._writable()
        if ss in self.snapshots:
            return False
        self.snapshots[ss] = b"".join(pieces(data))
        return True

    def new_log(self, ss: int, cl: int, data: bytes | Iterable[bytes]) -> bool:
        self._writable()
        if ss not in self.snapshots or (ss, cl) in self.logs:
            return False
        self.logs[ss, cl] = b"".join(pieces(data))
        return True

    def append_log(self, ss: int, cl: int, data: bytes) -> bool:
        self._writable()
        if (ss, cl) not in self.logs:
            return False
        self.logs[ss, cl] += data
        return True


class NullStore(MemoryStore):
    """Takes everything, keeps nothing; like Spark's noop sink, for timing and for trials."""

    def new_snapshot(self, ss: int, data: bytes) -> bool:
        return True

    def new_log(self, ss: int, cl: int, data: bytes) -> bool:
        return True

    def append_log(self, ss: int, cl: int, data: bytes) -> bool:
        return True
