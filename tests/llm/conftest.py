import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, n long, score double, kept boolean, h long, words string, size int, shard string, row_id long, _row string, _k1 long, _k2 string, _text string, _host int, _removed string, _gone long, _kept int, _cut string, _c long, _m1 string, _m2 long, _source string, _order int, _from long, _copy int, _times string, _gone2 int, _nth string, _row1 int, _row2 string, _root long, _found int, _id string, _words int, _lines string, block int, words2 int, target string, tie int, payload string"

_KINDS = [x.split()[1] for x in SCHEMA.split(", ")][13:]
FILLERS = [f"own {k}" if kind == "string" else 100 + k for k, kind in enumerate(_KINDS)]


@pytest.fixture
def make(spark):
    """Documents from (doc_id, text, source) with further columns whose names the operators use inside; they hold FILLERS from the 14th on."""

    def build(rows):
        cells = [(i, t, None, s, None if t is None else len(t), 1, 2, None, True, 3, "w", 4, "x", *FILLERS) for i, t, s in rows]
        return spark.createDataFrame(cells, SCHEMA)

    return build


@pytest.fixture
def odd(make):
    """Nulls in every column, an empty text, blanks, a very long text, ties and rows that repeat."""
    long = " ".join(f"word{k % 9973}x{k // 7}" for k in range(60_000))
    return make([(1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, long, "b"), (None, "a text without an id but with some words in it", "b"), (5, "same words in a row that repeats here", "a"), (5, "same words in a row that repeats here", "a"),
                 (6, None, None), (7, "ünïcödé — “quoted” 🙂 text\nwith lines\n\nwith lines", "ä"), (8, "x", "")])


@pytest.fixture
def none(make):
    return make([])
