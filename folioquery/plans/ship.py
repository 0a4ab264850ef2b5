"""Hand this package to the executors, so that it needn't be installed on them."""

import io
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from folioquery.plans.workspace import Workspace

BATCH = 2_000
_done: set = set()


def ship(spark: SparkSession) -> None:
    """Send the package's sources once a Spark application, by the shared folder. Rows move
    to Python 2,000 at a time: documents can be long, and a batch lies in memory three times."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)
    app = spark.sparkContext.applicationId
    if app in _done:
        return
    _done.add(app)
    top, data = Path(__file__).resolve().parents[1], io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    spark.sparkContext.addPyFile(Workspace(spark, "package").write_bytes("folioquery_src.zip", data.getvalue()))
