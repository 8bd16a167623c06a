"""Extraction, token arrays and identities against hand cases and brute force."""

import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from tests.conftest import keyed, rows
from trailmark.functions import identity
from trailmark.functions.tokens import all_subsequence_starts, find_subsequence, termination_status
from trailmark.operators import grading, trajectory
from trailmark.params import CampaignPlan, CensoringPolicy

BOX = "\\boxed"


def brute_boxed(text):
    """Restates the rule position by position: last balanced marker, else last malformed."""
    balanced = malformed = None
    for start in [m.start() for m in re.finditer(re.escape(BOX), text)]:
        after = start + len(BOX)
        if after < len(text) and text[after].isalpha():
            continue
        brace = after
        while brace < len(text) and text[brace].isspace():
            brace += 1
        close = None
        if brace < len(text) and text[brace] == "{":
            depth = 0
            for i in range(brace, len(text)):
                slashes = len(text[:i]) - len(text[:i].rstrip("\\"))
                if text[i] in "{}" and slashes % 2 == 0:
                    depth += 1 if text[i] == "{" else -1
                    if depth == 0:
                        close = i
                        break
        if close is None:
            malformed = ("MALFORMED_BOXED_ANSWER", None, start, None)
        elif text[brace + 1 : close].strip():
            balanced = ("EXTRACTED", text[start : close + 1], start, close + 1)
        else:
            balanced = ("EMPTY_BOXED_ANSWER", None, start, close + 1)
    return balanced or malformed or ("MISSING_BOXED_ANSWER", None, None, None)


CASES = {
    "first \\boxed{1}; final \\boxed{\\frac{2}{3}}": ("EXTRACTED", "\\boxed{\\frac{2}{3}}"),
    "answer is probably four": ("MISSING_BOXED_ANSWER", None),
    "\\boxed{4": ("MALFORMED_BOXED_ANSWER", None),
    "broken \\boxed{unfinished answer; later \\boxed{4}": ("EXTRACTED", "\\boxed{4}"),
    "answer \\boxed{4}; typo \\boxed{": ("EXTRACTED", "\\boxed{4}"),
    "good \\boxed{4} then \\boxed{ }": ("EMPTY_BOXED_ANSWER", None),
    "é日本 \\boxed\u00a0{ü}": ("EXTRACTED", "\\boxed\u00a0{ü}"),
    "\\boxedé{1}": ("MISSING_BOXED_ANSWER", None),
}


def test_extract_boxed_matches_brute_force(spark):
    rng = random.Random(7)
    pieces = [BOX, "{", "}", "\\{", "\\", " ", "x", "é", "\n", "\\}", "1"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 18))) for _ in range(3000)]
    texts += list(CASES)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, generated_text string").repartition(8)
    found = {r["id"]: r["extraction"] for r in grading.extract_answers(df).collect()}
    for i, text in enumerate(texts):
        got = found[i]
        expected = brute_boxed(text)
        assert (got["status"], got["extracted_text"], got["start_offset"], got["end_offset"]) == expected, text
    for text, (status, extracted) in CASES.items():
        got = found[texts.index(text, 3000)]
        assert (got["status"], got["extracted_text"]) == (status, extracted)


def test_extraction_of_null_and_long_unbalanced_text(spark):
    long = "\\boxed{" * 20000
    df = spark.createDataFrame([(1, None), (2, long)], "id int, generated_text string")
    found = {r["id"]: r["extraction"] for r in grading.extract_answers(df).collect()}
    assert found[1]["status"] == "MISSING_BOXED_ANSWER"
    assert found[2]["status"] == "MALFORMED_BOXED_ANSWER"
    assert found[2]["start_offset"] == len(long) - len("\\boxed{")


def test_subsequence_search_matches_brute_force(spark):
    rng = random.Random(3)
    arrays = [[rng.choice([1, 2, 3, 12, 23]) for _ in range(rng.randint(0, 12))] for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(arrays)), "id int, t array<int>")
    for target in ([2, 3], [2], [1, 1], [2, 3, 2, 3, 2]):
        found = df.select("id", find_subsequence(F.col("t"), target).alias("first"),
                          all_subsequence_starts(F.col("t"), target).alias("all"))
        for r in found.collect():
            a = arrays[r["id"]]
            starts = [i for i in range(len(a) - len(target) + 1) if a[i : i + len(target)] == target]
            assert r["all"] == starts and r["first"] == (starts[0] if starts else None), (a, target)
    with pytest.raises(ValueError):
        find_subsequence(F.col("t"), [])


def _checkpoints(spark, tokens, positions, marker, eos=()):
    df = spark.createDataFrame([(tokens,)], "token_ids array<int>")
    return {r["checkpoint_token"]: r for r in rows(trajectory.fixed_checkpoints(df, positions, marker, eos))}


def test_fixed_checkpoints(spark):
    found = _checkpoints(spark, [10, 11, 90, 91, 12], (2, 3, 4), (90, 91))
    assert [found[p]["availability_status"] for p in (2, 3, 4)] == ["AVAILABLE", "AFTER_THINK_CLOSE", "AFTER_THINK_CLOSE"]
    assert found[2]["prefix_token_ids"] == [10, 11]
    assert found[2]["prefix_sha256"] == hashlib.sha256(b"[10,11]").hexdigest()
    found = _checkpoints(spark, [1, 2, 99], (2, 3, 4), (77,), (99,))
    assert [found[p]["availability_status"] for p in (2, 3, 4)] == ["AVAILABLE", "AFTER_TERMINAL_TOKEN", "TRAJECTORY_TOO_SHORT"]


def test_forced_input(spark):
    df = spark.createDataFrame([([50, 51, 52], [7, 8])], "token_ids array<int>, prompt_token_ids array<int>")
    found = rows(trajectory.forced_input(trajectory.fixed_checkpoints(df, (2, 9), (90, 91)), (90, 91)))
    assert len(found) == 1
    assert found[0]["input_token_ids"] == [7, 8, 50, 51, 90, 91]
    assert found[0]["input_sha256"] == hashlib.sha256(b"[7,8,50,51,90,91]").hexdigest()


def test_grading_and_label(spark):
    df = spark.createDataFrame([(1, "4", "final \\boxed{4}"), (2, "4", "forced \\boxed{5}"), (3, "4", "none"),
                                (4, " ", "\\boxed{1}"), (5, "1/2", "\\boxed{\\dfrac{2}{4}}"), (6, "0.5", "\\boxed{1/0}")],
                               "id int, reference_answer string, generated_text string")
    found = {r["id"]: r["evaluation"] for r in rows(grading.grade_completions(df))}
    assert [found[i]["status"] for i in range(1, 7)] == [
        "CORRECT", "INCORRECT", "NON_EVALUABLE", "NON_EVALUABLE", "CORRECT", "INCORRECT"]
    assert found[3]["reason"] == "answer extraction status: MISSING_BOXED_ANSWER"
    assert found[4]["reason"] == "missing or empty reference answer"


def test_user_grader_hook(spark):
    import pandas as pd

    def lenient(reference: pd.Series, candidate: pd.Series) -> pd.Series:
        return pd.Series([None if c is None else (r in c if r != "fault" else None) for r, c in zip(reference, candidate)])

    df = spark.createDataFrame([(1, "4", "\\boxed{x=4}"), (2, "5", "\\boxed{4}"), (3, "fault", "\\boxed{4}")],
                               "id int, reference_answer string, generated_text string")
    equal = F.pandas_udf(lenient, "boolean")
    graded = grading.evaluate_answers(grading.extract_answers(df), equal=lambda r, c: equal(r, c))
    assert keyed(graded, "id", "evaluation")[1]["correct"] is True
    assert keyed(graded, "id", "evaluation")[2]["status"] == "INCORRECT"
    assert keyed(graded, "id", "evaluation")[3]["status"] == "ERROR"


def test_censoring_policy(spark):
    row = ("AVAILABLE", "MAX_NEW_TOKENS", 3, "EOS", "INCORRECT", False, "CORRECT", True)
    df = spark.createDataFrame([row], "availability_status string, base_termination string, close_marker_start int, "
                               "forced_termination string, forced_status string, forced_correct boolean, "
                               "final_status string, final_correct boolean")
    found = rows(grading.label_transitions(df))[0]
    assert found["observed_transition_label"] == "W_TO_C" and found["transition_label"] is None
    assert found["analytic_eligibility"]["reasons"] == ["BASE_TERMINATION_NOT_NATURAL_EOS"]
    with pytest.raises(ValueError):
        CensoringPolicy(required_base_termination="ANY")
    with pytest.raises(ValueError):
        CampaignPlan(positions=(2, 2))
    assert CampaignPlan(positions=(4, 2)).positions == (2, 4)


def test_identities_match_plain_python(spark):
    texts = ["plain", "ünïcode/é b", "..--..", "a" * 100, "rollout:x:p 1:seed-2", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    names = keyed(df.select("t", identity.safe_name(F.col("t")).alias("n")), "t", "n")
    for t in texts:
        head = (re.sub(r"[^A-Za-z0-9._-]+", "-", t).strip(".-") or "item")[:72]
        assert names[t] == f"{head}--{hashlib.sha256(t.encode()).hexdigest()[:16]}.json"
    meta = spark.createDataFrame([(5, 'quote " é'), (None, None)], "level int, subject string")
    hashes = [r[0] for r in meta.select(identity.metadata_hash(F.col("level"), F.col("subject"))).collect()]
    expected = [json.dumps({"level": l, "subject": s}, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
                for l, s in ((5, 'quote " é'), (None, None))]
    assert hashes == [hashlib.sha256(e.encode()).hexdigest() for e in expected]


def test_termination_precedence(spark):
    df = spark.createDataFrame([(1, [1, 9]), (2, [1, 2]), (3, [1]), (4, [])], "id int, t array<int>")
    found = keyed(df.select("id", termination_status(F.col("t"), [9], 2).alias("s")), "id", "s")
    assert found == {1: "EOS", 2: "MAX_NEW_TOKENS", 3: "OTHER_STOP", 4: "OTHER_STOP"}


@pytest.mark.parametrize(
    "left,right,equal",
    [
        (r"\leftarrow", r"\rightarrow", False), ("1 2/3", "4", False), ("1 2", "12", False), (".5", "0.5", True), (r"\$5", "5", True),
        ("0.1234567", "0.12345670", True), ("1234567890123456", "1234567890123456.0", True), ("-0", "0.0", True), ("12345678901234567890123", "12345678901234567890124", False),
        (r"\left( 1, 2 \right)", "(1,2)", True), ("+007", "7", True), (r"\frac{2}{4}", "0.5", True),
    ],
)
def test_answers_that_were_graded_wrongly(spark, left, right, equal):
    from trailmark.operators.grading import evaluate_pairs

    row = evaluate_pairs(spark.createDataFrame([(left, right)], "a string, b string"), "a", "b").first()
    assert row.evaluation.correct is equal


def test_strict_reads_fail_when_only_counted(spark, tmp_path):
    from trailmark.sources.documents import read_json_files

    (tmp_path / "a.json").write_text('{"x": 1}')
    (tmp_path / "b.json").write_text("{")
    assert read_json_files(spark, str(tmp_path), strict_mode=False).count() == 2
    with pytest.raises(Exception, match="b.json"):
        read_json_files(spark, str(tmp_path)).count()


def test_control_characters_in_canonical_json(spark):
    import json

    from trailmark.functions.identity import canonical_json

    texts = ["a\x0bb", "\x1f\x0e\x1a", "\\u000B", "\\\\\x0b", "plain"]
    found = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string").select("i", canonical_json(F.struct("s")).alias("j"))
    assert [r.j for r in found.orderBy("i").collect()] == [json.dumps({"s": t}, separators=(",", ":"), ensure_ascii=False) for t in texts]


def test_declared_positions_name_every_fault():
    from trailmark.params import declared_positions

    assert declared_positions([512, 256]) == (256, 512)
    for bad, words in (([], "none"), ([0, 3, 3, True], "0 is no.*True is no.*'3' is declared 2 times")):
        with pytest.raises(ValueError, match=words):
            declared_positions(bad)
