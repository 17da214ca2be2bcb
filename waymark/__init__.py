"""waymark: audit and correction of GPS track corpora with Spark DataFrames."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

_SHIPPED: set[str] = set()


def ship(spark) -> None:
    """Give this package to the session's Python workers, once for each application. Where it is installed on all nodes there is no need."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    here = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="waymark-")) / "waymark.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted(here.rglob("*.py")):
            z.write(file, file.relative_to(here.parent))
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(app)
