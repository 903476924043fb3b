"""Files in the shared folder, by whatever file system its address names."""

from pyarrow import fs


def opened(address: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address (``file:``, ``hdfs:``, ``s3:``, a plain path) and the path in it."""
    return fs.FileSystem.from_uri(address)


def write(address: str, content: bytes) -> None:
    system, path = opened(address)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    with system.open_output_stream(path) as out:
        out.write(content)
