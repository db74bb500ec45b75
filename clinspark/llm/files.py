"""Files of an own format in the shared folder, written and read inside tasks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

from clinspark.session import resolve, shared_folder


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder for one run below the folder named by ``spark.checkpoint.dir``."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def new_file(uri: str) -> Iterator:
    """A stream whose file gets its name when it is complete, so a retried or doubled task leaves one whole file."""
    fs, path = resolve(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    hidden = f"{path.rpartition('/')[0]}/_{uuid.uuid4().hex}"
    with fs.open_output_stream(hidden) as out:
        yield out
    fs.move(hidden, path)


def open_file(uri: str):
    fs, path = resolve(uri)
    return fs.open_input_file(path)
