import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from maskweave.session import build_session, ship_package  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session(
        "tests",
        "local[4]",
        spark__sql__shuffle__partitions="4",
        spark__driver__memory="6g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    s.sparkContext.setLogLevel("ERROR")
    ship_package(s)
    yield s
    s.stop()


@pytest.fixture
def make_policy(spark):
    """policy(("deny", "Acme", "ORG"), ...) with optional scope, whole_word and aliases."""
    from maskweave.operators.policy import POLICY_SCHEMA

    def make(*entries):
        rows = []
        for i, e in enumerate(entries):
            side, term, label = e[:3]
            opts = e[3] if len(e) > 3 else {}
            rows.append(
                (i, side, term, label, opts.get("scope", "global"), opts.get("aliases", []), "",
                 opts.get("whole_word", False))
            )
        return spark.createDataFrame(rows, POLICY_SCHEMA)

    return make
