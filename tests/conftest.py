import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))

from seclake.session import local_session  # noqa: E402

SCOPE = {"tenant_id": "acme", "environment": "preprod", "knowledge_base_id": "kb"}


@pytest.fixture(scope="session")
def spark():
    # tiny inputs: compiling generated code would take most of the time
    conf = {"spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN"}
    session = local_session(4, 2, **conf)
    yield session
    session.stop()


@pytest.fixture
def scope():
    return dict(SCOPE)


@pytest.fixture(scope="session")
def value(spark):
    """Evaluate a text expression on one string."""
    from pyspark.sql import functions as F

    def run(expression, text):
        frame = spark.createDataFrame([(text,)], "t string")
        return frame.select(expression(F.col("t")).alias("v")).first()["v"]

    return run
