import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from strataflow.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(
        "tests", 8, 4, **{"spark.ui.showConsoleProgress": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}
    )
    yield session
    session.stop()
