"""Answers that no replacement would change skip them all."""

from pyspark.sql import functions as F

from tests.conftest import rows
from trailmark.functions.answers import normalise_answer


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plain_answers_meet_one_pattern(spark):
    """What no replacement would change is told by one look; all others come out as before."""
    given = ["12", " 7 ", "-3/4", "x", "", "1.", ".", "a b", "1 2", "$5$", "\\boxed{ 3 }", "\\dfrac{1}{2}", "5.\u2028", "5.\n", "\t", None, "\\left( x \\right)"]
    answers = spark.createDataFrame([(a,) for a in given], "a string")

    def chain(a):
        inner = F.regexp_replace(F.trim(a), r"(?s)^\\boxed\s*\{(.*)\}$", "$1")
        plain = F.regexp_replace(inner, r"\\(?:left|right)(?![a-zA-Z])|\\[!,;: ]|\\?\$", "")
        plain = F.regexp_replace(plain, r"(?<![0-9])\s+|\s+(?![0-9])", "")
        plain = F.regexp_replace(plain, r"\\[dt]frac", r"\\frac")
        plain = F.regexp_replace(plain, r"^([+-]?)\\frac\{([+-]?[0-9.]+)\}\{([+-]?[0-9.]+)\}$", "$1$2/$3")
        return F.regexp_replace(plain, r"\.$", "")

    assert rows(answers.select(normalise_answer(F.col("a")).alias("n"))) == rows(answers.select(chain(F.col("a")).alias("n")))
    assert plan_of(answers.select(normalise_answer(F.col("a")))).index("CASE WHEN RLIKE") < plan_of(answers.select(normalise_answer(F.col("a")))).index("regexp_replace")
