import pytest

from agoradesk.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = build_session(
        master="local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="4g",
        spark__ui__showConsoleProgress="false", spark__checkpoint__dir=str(shared),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
