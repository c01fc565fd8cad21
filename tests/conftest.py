import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from beaconry.plans.shipping import ship_package

    session = (SparkSession.builder.master("local[4]").appName("tests").config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false").config("spark.driver.host", "127.0.0.1")
               .config("spark.driver.bindAddress", "127.0.0.1").config("spark.sql.shuffle.partitions", "4")
               .config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def envelope(spark):
    """Envelopes from (batch id, signal, payload text or bytes, content type) rows."""
    from datetime import datetime, timezone

    from beaconry.schemas import ENVELOPE

    def make(*rows, **headers):
        now = datetime(2026, 1, 2, 3, 4, 5, tzinfo=timezone.utc)
        data = []
        for batch_id, signal, payload, content_type in rows:
            body = payload.encode() if isinstance(payload, str) else payload
            data.append((batch_id, now, signal, content_type, body, headers.get("source"), headers.get("node"),
                         headers.get("tenant"), headers.get("tenant_alt")))
        return spark.createDataFrame(data, ENVELOPE)

    return make
