import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
for folder in (ROOT, os.path.dirname(os.path.abspath(__file__))):
    if folder not in sys.path:
        sys.path.insert(0, folder)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from riskloom.session import build_session

    session = build_session(
        "local[8]", app="tests",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
           "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def files_of(spark):
    """files(project_id, path, text) from {project: {path: text}}."""
    def make(projects):
        rows = [(p, path, text) for p, tree in projects.items() for path, text in tree.items()]
        return spark.createDataFrame(rows, "project_id string, path string, text string")
    return make
