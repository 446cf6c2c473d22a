"""Side files of functions, found where the function runs."""

from __future__ import annotations

import os


def resolve(path: str) -> str:
    """The path itself if this machine sees it, else the copy that ``SparkContext.addFile`` left here."""
    if os.path.exists(path):
        return path
    from pyspark import SparkFiles

    return SparkFiles.get(os.path.basename(path))
