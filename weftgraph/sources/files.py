"""Opening files wherever they are: local paths directly, others by their file system."""

from __future__ import annotations

from pathlib import Path


def _local(path: str) -> str | None:
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return path if "://" not in path else None


def _remote(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def exists(path: str) -> bool:
    if (own := _local(path)) is not None:
        return Path(own).exists()
    from pyarrow import fs

    system, at = _remote(path)
    return system.get_file_info(at).type != fs.FileType.NotFound


def listing(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of a folder's files whose names start with part-."""
    if (own := _local(path)) is not None:
        p = Path(own)
        files = sorted(x for x in p.iterdir() if x.name.startswith("part-")) if p.is_dir() else [p]
        return [(str(x), x.stat().st_size) for x in files]
    from pyarrow import fs

    system, at = _remote(path)
    info = system.get_file_info(at)
    found = system.get_file_info(fs.FileSelector(at)) if info.type == fs.FileType.Directory else [info]
    root = path[: len(path) - len(at)] if path.endswith(at) else path.split("://")[0] + "://"
    return sorted((root + x.path, x.size) for x in found if info.type != fs.FileType.Directory or x.base_name.startswith("part-"))


def read_range(path: str, start: int, size: int) -> bytes:
    if (own := _local(path)) is not None:
        with open(own, "rb") as f:
            f.seek(start)
            return f.read(size)
    system, at = _remote(path)
    with system.open_input_file(at) as f:
        f.seek(start)
        return f.read(size)


def write_bytes(path: str, blocks) -> None:
    if (own := _local(path)) is not None:
        Path(own).parent.mkdir(parents=True, exist_ok=True)
        with open(own, "wb") as f:
            for b in blocks:
                f.write(b)
        return
    system, at = _remote(path)
    system.create_dir(at.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(at) as f:
        for b in blocks:
            f.write(b)


def move(old: str, new: str) -> None:
    if (own := _local(old)) is not None:
        Path(own).replace(_local(new))
        return
    system, at = _remote(old)
    system.move(at, _remote(new)[1])


def remove(path: str) -> None:
    if (own := _local(path)) is not None:
        Path(own).unlink(missing_ok=True)
        return
    system, at = _remote(path)
    system.delete_file(at)
