"""Binary files in the shared folder, written and read inside tasks.

Each attempt of a task writes a file of its own name and returns that name in its rows, so
the rows that Spark keeps name exactly the files of the attempts that counted. The folder is
the one ``spark.checkpoint.dir`` names; pyarrow must know its kind of store.
"""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark.sql import SparkSession

from doclake.session import shared_folder


def new_folder(spark: SparkSession, label: str) -> str:
    """A new folder below the shared one, as a URI."""
    return f"{shared_folder(spark).rstrip('/')}/doclake/{label}-{uuid.uuid4().hex}"


def open_new(folder: str, suffix: str):
    """A file of a new name in a folder: its URI and an output stream."""
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    name = f"{uuid.uuid4().hex}{suffix}"
    return f"{folder}/{name}", system.open_output_stream(f"{path}/{name}", compression=None)


def open_old(uri: str):
    """A file for reads at any place."""
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)
