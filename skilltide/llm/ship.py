"""The library's code for Python workers."""

import io
import pathlib
import zipfile

from pyspark.sql import SparkSession

import skilltide
from skilltide.storage import new_path

from .files import write

BATCH_ROWS = 1000  # rows of whole texts that go to a Python worker at a time, unless fewer are set
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once per application, so that they need no copy of their own,
    and bound the batches of the session, since Spark's default of 10,000 long texts is a lot of memory."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(setting)) <= BATCH_ROWS:
        spark.conf.set(setting, str(BATCH_ROWS))
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = pathlib.Path(skilltide.__file__).parent
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as archive:
        for source in sorted(root.rglob("*.py")):
            archive.writestr(source.relative_to(root.parent).as_posix(), source.read_bytes())
    address = new_path(spark, "code") + ".zip"
    write(address, held.getvalue())
    context.addPyFile(address)
    _shipped.add(context.applicationId)
