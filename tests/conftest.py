import pytest

from checks.compare import connect, session

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    made = session(4)
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()


@pytest.fixture(scope="session")
def second_engine():
    return connect(SMALL)


@pytest.fixture
def resources(spark):
    """Resource rows from texts: a list of (target, kind, address, text) or of texts."""

    def make(rows):
        rows = [(n, "html", "HTML page", r) if isinstance(r, str) else r for n, r in enumerate(rows)]
        return spark.createDataFrame(
            [(t, n, k, u, c) for n, (t, k, u, c) in enumerate(rows)],
            "target_id bigint, seq bigint, kind string, url string, content string",
        )

    return make


@pytest.fixture
def pages(spark):
    def make(texts):
        return spark.createDataFrame(
            [(n, f"https://s{n}.example.com/a/b.html?q=1", t) for n, t in enumerate(texts)],
            "page_id bigint, url string, html string",
        )

    return make
