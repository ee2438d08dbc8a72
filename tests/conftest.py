import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sortie.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture
def as_lines(spark):
    """Log text to the lines table: {(label, tool): [lines]}; two lines per block."""

    def make(files, per_block=2):
        rows = [
            ("run-1", "i-1", tool, tool, f"{name}.log", i // per_block, i, line)
            for (name, tool), lines in files.items()
            for i, line in enumerate(lines)
        ]
        return spark.createDataFrame(
            rows, "run_id string, instance_id string, tool string, tool_label string, log_path string, block long, pos long, line string"
        )

    return make
