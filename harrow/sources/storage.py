"""File access from inside tasks, on any file system pyarrow knows."""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs


def located(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("s3a://"):
        path = "s3://" + path[len("s3a://"):]
    if "://" in path and not path.startswith("file://"):
        return pafs.FileSystem.from_uri(path)
    local = path.removeprefix("file://").removeprefix("file:")
    return pafs.LocalFileSystem(), local


def list_files(path: str, suffix: str) -> list[tuple[str, int]]:
    """`(base name, size)` of the files right under a folder; none if it is absent."""
    fs, root = located(path)
    found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
    return sorted(
        (info.base_name, info.size) for info in found
        if info.type == pafs.FileType.File and info.base_name.endswith(suffix)
    )


def publish(path: str, content: bytes) -> None:
    """Write a small file so that readers see all of it or nothing."""
    fs, place = located(path)
    fs.create_dir(place.rsplit("/", 1)[0], recursive=True)
    unfinished = f"{place}.{uuid.uuid4().hex[:8]}"
    with fs.open_output_stream(unfinished, compression=None) as out:
        out.write(content)
    fs.move(unfinished, place)
