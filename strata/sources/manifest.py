"""Versions of a store's contents. A version names every folder that counts; all others are leftovers."""

import json
import zlib
from dataclasses import asdict, dataclass, field, replace

PREFIX = "manifest-"


class ManifestError(ValueError):
    pass


@dataclass(frozen=True)
class Segment:
    """A stretch of the log: folders of batches, oldest first."""

    id: int
    parts: tuple[str, ...] = ()
    bytes: int = 0


@dataclass(frozen=True)
class Table:
    """A sorted layer: newest version of each key up to a place in the log."""

    id: int
    folder: str
    rows: int
    bytes: int
    min_key: str | None
    max_key: str | None


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    next_id: int = 2
    next_seq: int = 1
    mem_bytes: int = 0
    #: Oldest first; the last segment is active.
    segments: tuple[Segment, ...] = field(default_factory=lambda: (Segment(1),))
    tables: tuple[Table, ...] = ()

    def next(self, **changes) -> "Manifest":
        return replace(self, version=self.version + 1, **changes)

    def folders(self) -> set[str]:
        return {p for s in self.segments for p in s.parts} | {t.folder for t in self.tables}

    def validate(self) -> None:
        ids = [x.id for x in (*self.segments, *self.tables)]
        if not self.segments:
            raise ManifestError("no active segment")
        if len(set(ids)) != len(ids):
            raise ManifestError(f"an id is used twice: {ids}")
        if self.next_id <= max(ids):
            raise ManifestError(f"next id {self.next_id} is not above {max(ids)}")
        if [s.id for s in self.segments] != sorted(s.id for s in self.segments):
            raise ManifestError("segments out of order")

    def encode(self) -> bytes:
        self.validate()
        body = json.dumps(asdict(self), sort_keys=True)
        return json.dumps({"crc32": zlib.crc32(body.encode()), "body": body}).encode()

    @staticmethod
    def decode(data: bytes) -> "Manifest":
        try:
            outer = json.loads(data)
            body = outer["body"]
            if zlib.crc32(body.encode()) != outer["crc32"]:
                raise ManifestError("checksum differs")
            d = json.loads(body)
            d["segments"] = tuple(Segment(s["id"], tuple(s["parts"]), s["bytes"]) for s in d["segments"])
            d["tables"] = tuple(Table(**t) for t in d["tables"])
            found = Manifest(**d)
        except ManifestError:
            raise
        except (ValueError, KeyError, TypeError) as e:
            raise ManifestError(f"not a manifest: {e}") from e
        found.validate()
        return found


def name(version: int) -> str:
    return f"{PREFIX}{version:012d}.json"


def load(files) -> Manifest | None:
    """The newest version. A damaged one is an error: an older one would hide committed writes."""
    known = [n for n in files.names() if n.startswith(PREFIX)]
    return Manifest.decode(files.read(known[-1])) if known else None


def commit(files, manifest: Manifest) -> Manifest:
    """Makes a version visible at once; FileExistsError if another writer was first."""
    files.create(name(manifest.version), manifest.encode())
    return manifest
