"""Both ways to mark words give the same findings, chosen by a session setting."""

from sitewarden.functions.words import AUTOMATON
from sitewarden.operators import fingerprint
from sitewarden.operators import secrets as sec

TEXTS = ["<i>glpat-aaaaabbbbbcccccddddd</i> React wp-content", "nothing", "", None, "WP-CONTENT jQuery <i>redis://u:pass@h/1</i>"]


def plan(df):
    return df._jdf.queryExecution().toString()


def test_scans_without_the_automaton(spark, resources):
    rows = resources([(n, "html", "HTML page", text) for n, text in enumerate(TEXTS)])

    def results():
        texts = fingerprint.page_texts(rows.selectExpr("target_id as page_id", "content as html"))
        return sec.secret_findings(rows), fingerprint.tech_detect(texts)

    python = results()
    assert all("ArrowEvalPython" in plan(df) for df in python)
    expected = [sorted(map(tuple, df.collect())) for df in python]
    assert all(expected)
    spark.conf.set(AUTOMATON, "false")
    try:
        native = results()
        assert not any("EvalPython" in plan(df) for df in native)
        assert [sorted(map(tuple, df.collect())) for df in native] == expected
    finally:
        spark.conf.unset(AUTOMATON)
