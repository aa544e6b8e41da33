import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def messy():
    from llm_tables import messy_rows

    return messy_rows()
