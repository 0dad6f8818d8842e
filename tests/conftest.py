import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from accesslens.schema import EVENT_COLUMNS, EVENTS  # noqa: E402
from accesslens.session import local_session  # noqa: E402
from verification.recipe import events_from  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    return local_session("8", "tests")


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def events(spark):
    return events_from(spark, SF_DIR).cache()


@pytest.fixture
def make_events(spark):
    """Event rows from keyword rows; what a test leaves out gets a default."""
    defaults = {
        "event_id": "e1", "event_date": "2024-01-30", "event_time": "2024-01-30T10:00:00+00:00",
        "event_name": "ListUsers", "event_source": "iam.amazonaws.com", "event_type": "iam",
        "aws_region": "us-east-1", "user_name": "bob", "source_ip": "10.0.0.1", "user_agent": "cli",
        "request_parameters": "{}", "response_elements": "null", "error_code": None, "error_message": None,
    }

    def make(*rows):
        return spark.createDataFrame([tuple({**defaults, **row}[c] for c in EVENT_COLUMNS) for row in rows], EVENTS)

    return make
