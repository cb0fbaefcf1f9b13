"""Lines of numbers, short lines and fields of frequent values in line dedup."""

from __future__ import annotations

from barloom.llm import line_templates


def test_unlike_numeric_lines_stay_and_equal_ones_go(spark):
    rows = [(k, f"{k} {k * 7} {k + 40}\n2021-03-01 10:15 88\nJob {k} took {k} s on host x{k}\nheld {k}") for k in range(6)]
    got = {r.doc_id: r.text.split("\n") for r in line_templates.drop_templates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == rows[0][1].split("\n")
    for k in range(1, 6):
        assert got[k] == [f"{k} {k * 7} {k + 40}", f"held {k}"]


def test_frequent_values_of_two_fields_stay_variable(spark):
    """Each name and each category stands in many documents, each pair of them in one."""
    rows = [(20 * a + b, f"Posted by our member name{'abcdefghijklmnopqrst'[a]} in the part about topic{'abcdefghijklmnopqrst'[b]} today") for a in range(20) for b in range(20)]
    rows += [(1000 + k, f"Posted by our staff and nobody else on day{'abcdefgh'[k]} nine") for k in range(3)]
    got = {r.doc_id: r.n_dropped for r in line_templates.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == 0 and all(got[k] == 1 for k in range(1, 400)) and all(got[1000 + k] == 0 for k in range(3))


def test_short_equal_lines_go(spark):
    rows = [(k, f"Read more\nsomething of its own {'abcdef'[k]} {'ghijkl'[k]} {'mnopqr'[k]}") for k in range(6)]
    got = [r.text.split("\n")[0] for r in line_templates.drop_templates(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got[0] == "Read more" and all(x.startswith("something") for x in got[1:])
