import pytest

from simgrove.operators import columns as C

SCHEMA = "doc_id string, page int, page_height double, x_start double, x_end double, y double, text string"
PROSE = [("First line of the body", 50, 40), ("Second line of the body", 50, 60), ("Third line of the body", 50, 80)]


def page(lines, doc="d", number=1):
    """Words of 5 points a letter and 3 between, of lines (text, x, y)."""
    out = []
    for text, x, y in lines:
        for w in text.split():
            out.append((doc, number, 800.0, float(x), x + 5.0 * len(w), float(y), w))
            x += 5 * len(w) + 3
    return out


def texts(spark, rows):
    return {(r.doc_id, r.page): (r.columns, r.text.splitlines()) for r in C.page_texts(spark.createDataFrame(rows, SCHEMA)).collect()}


BESIDE = [(f"{side} row {i}", x, 100 + 20 * i) for i in range(5) for side, x in (("Left", 50), ("Right", 280))]
ONE_COLUMN = {
    "prose": PROSE,
    "running head": [("Journal", 50, 20), ("Vol. 4", 420, 20), *PROSE, ("Journal", 50, 120), ("p. 12", 420, 120)],
    "three segments": PROSE + [(w, x, 100 + 20 * i) for i in range(5) for w, x in (("a", 50), ("b", 200), ("c", 350))],
    "scattered boundaries": [(w, x, 20 + 40 * i) for i, right in enumerate((100, 250, 400)) for w, x in (("a", 50), ("b", right))] + [("plain", 50, 40 + 40 * i) for i in range(3)],
}


@pytest.mark.parametrize("name", ONE_COLUMN)
def test_pages_in_one_column(spark, name):
    columns, lines = texts(spark, page(ONE_COLUMN[name]))["d", 1]
    heights = sorted({y for _, _, y in ONE_COLUMN[name]})
    assert columns == 1 and lines == [" ".join(t for t, _, y in sorted(ONE_COLUMN[name], key=lambda w: w[1]) if y == h) for h in heights]


def test_pages_in_two_columns(spark):
    head = [("A title across the page", 50, 40)]
    jitter = [(t, x, y + (1.5 if x == 280 else 0)) for t, x, y in BESIDE]  # within a row's height
    apart = [(w, x, 20 + 40 * i) for i in range(3) for w, x in ((f"l{i}", 50), (f"r{i}", 90 + 20 * i))] + [("plain", 50, 40 + 40 * i) for i in range(3)]
    got = texts(spark, page(head + BESIDE) + page(jitter, "j", 2) + page(apart, "s"))
    left, right = ([f"{side} row {i}" for i in range(5)] for side in ("Left", "Right"))
    assert got["d", 1] == (2, [*[t for t, _, _ in head], *left, *right]) and got["j", 2] == (2, left + right)
    assert got["s", 1] == (2, ["l0", "plain", "l1", "plain", "l2", "plain", "r0", "r1", "r2"])


def test_documents_join_pages_and_skip_blanks(spark):
    rows = page(BESIDE, number=2) + page(PROSE, number=1) + [("d", 1, 800.0, 60.0, 70.0, 500.0, " "), ("d", 1, 800.0, 60.0, 70.0, 500.0, None), ("d", 3, 800.0, None, 1.0, 1.0, "x"), ("e", 1, 800.0, 1.0, 2.0, 1.0, "")]
    got = {r.doc_id: r.text.splitlines() for r in C.document_texts(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {"d": [t for t, _, _ in PROSE] + [f"{side} row {i}" for side in ("Left", "Right") for i in range(5)]}
    assert not C.document_texts(spark.createDataFrame([], SCHEMA)).count()
