import pytest

from reachlens.session import on_workers

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, words string, row long, _p string"


@pytest.fixture(scope="session")
def session(spark):
    return on_workers(spark)


@pytest.fixture
def documents(session):
    """Documents from (id, text) or (id, text, source), with extra columns whose names clash."""
    def make(rows):
        full = [(r[0], r[1], None, r[2] if len(r) > 2 else "s", None, "w", 1, "p") for r in rows]
        return session.createDataFrame(full, COLUMNS)

    return make


@pytest.fixture
def rows():
    def collected(frame, *columns):
        key = lambda r: tuple((x is None, str(type(x)), x) for x in r)
        return sorted((tuple(r[c] for c in columns or frame.columns) for r in frame.collect()), key=key)

    return collected
