import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from diffloom.session import local_session

    # Tiny inputs: interpreting a plan is quicker than compiling it.
    quick = {"spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN"}
    session = local_session(8, partitions=2, extra=quick)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
