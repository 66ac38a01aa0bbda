"""scanf formats."""

import pytest
from pyspark.sql import functions as F

from strandex.functions.scanf import scanf

# Fixed values: (format, text, fields, matched).
CASES = [
    ("abc", "abc", [], True),
    ("ab%c", "abc", ["c"], True),
    ("ab%c%d", "abc123", ["c", 123], True),
    ("ab%c%d", "abc-123efg", ["c", -123], True),
    ("ab%c%d", "abc+123efg", ["c", 123], True),
    ("ab%d %o", "ab123 1239fg", [123, 83], True),
    ("%s", "123 ", ["123"], True),
    (" %d ", "123", [123], True),
    (" %d %d %d", "123+123-123", [123, 123, -123], True),
    (" %3d ", "12345", [123], True),
    (" %i ", "0xAmmm", [10], True),
    (" %i ", "0199", [1], True),
    (" %i ", "0", [0], True),
    (" %i ", "-42", [-42], True),
    (" %f ", "0.999e+3", [999.0], True),
    (" %f ", "  999.0 ", [999.0], True),
    (" %f ", "  999 ", [999.0], True),
    ("%f%s", "12e3", [12.0, "e3"], True),
    ("%4f%s", "1.2345", [1.23, "45"], True),
    ("%[cba]", "abc", ["abc"], True),
    ("%[abc-f]", "adf_", ["adf"], True),
    ("%[^abc-]", "xyz-e", ["xyz"], True),
    (" %[^]abc-]%*c%c", "xyz]e", ["xyz", "e"], True),
    ("%2[a-z]%s", "abcd", ["ab", "cd"], True),
    ("%[a]", "b", [None], False),
    ("ab%c  %c", "abc  d", ["c", "d"], True),
    ("ab%c  %c", "abcd", ["c", "d"], True),
    ("ab%*c%d", "abc123", [123], True),
    ("ab%c%*d", "abc123", ["c"], True),
    ("ab%*c %*d", "abc   123", [], True),
    ("ab%*c%3d", "abc1234", [123], True),
    ("ab%c%3c", "abc1234", ["c", ["1", "2", "3"]], True),
    ("  %3s ", "  12345 ", ["123"], True),
    ("abd", "abc", [], False),
    ("ab%d", "abc", [None], False),
    ("ab%c%d", "abcd", ["c", None], False),
    ("ab%c%f", "abcd", ["c", None], False),
    ("%x %x", "0xFF -1a", [255, -26], True),
    ("%x%s", "0ff", [0, "ff"], True),
    ("%d%%%n%s", "50%x", [50, 3, "x"], True),
    ("%d", None, None, None),
]


def test_cases(spark):
    columns = [scanf(F.lit(t).cast("string"), f).alias(f"c{i}") for i, (f, t, _, _) in enumerate(CASES)]
    row = spark.range(1).select(*columns).first()
    for (fmt, text, fields, matched), got in zip(CASES, row, strict=True):
        if fields is None:
            assert got is None
        else:
            assert list(got)[:-1] == fields and got["matched"] is matched, (fmt, text, got)


def test_window_and_names(spark):
    r = spark.range(1).select(scanf(F.lit("xx12 34"), "%d %n%d", ["a", "n", "b"], start=2).alias("s")).first()["s"]
    assert (r["a"], r["n"], r["b"]) == (12, 5, 34)
    assert spark.range(1).select(scanf(F.lit("1234"), "%d", end=2)["f1"].alias("x")).first()["x"] == 12


@pytest.mark.parametrize("fmt", ["%q", "%", "%[abc"])
def test_rejected(fmt):
    with pytest.raises(ValueError):
        scanf(F.lit("a"), fmt)
