from __future__ import annotations

import functools
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from cohortflow.session import build_session

    session = build_session(
        "tests", "local[8]", spark__sql__shuffle__partitions="4", spark__driver__memory="8g", spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__checkpoint__dir=str(tmp_path_factory.mktemp("checkpoint")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def shared_studies():
    """Build each proxy study once per test session and let every query reuse it."""
    from cohortflow.plans import attribution_queries, graph_queries, intake_queries, model_queries, proxies, study_queries

    for name in ("event_study", "order_study", "event_forecast", "order_forecast"):
        cached = functools.cache(getattr(proxies, name))
        for module in (proxies, study_queries, model_queries, graph_queries, attribution_queries, intake_queries):
            if hasattr(module, name):
                setattr(module, name, cached)
