"""corpuspipe: building text corpora (stage, check, hash, de-duplicate, read, cut, number, publish) on Spark."""

from __future__ import annotations

import pathlib
import tempfile
import zipfile

_shipped: set[str] = set()


def ship(spark) -> None:
    """Send this package to the Python workers of a session, once per application.

    Needed where the package is not installed on the executors: the functions that run in Python
    (markup, archives, case folding, the event fold) are imported there by name.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = pathlib.Path(__file__).parent
    archive = pathlib.Path(tempfile.mkdtemp(prefix="corpuspipe-package-")) / "corpuspipe.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
