"""Labelled survey columns, codebook, id map and answers."""

from waypoint.sources.survey import codebook, label_columns, survey_answers


def test_codebook_from_labels_matches_answer_columns(spark):
    raw = spark.createDataFrame([("S1", "Blue", 3.0)], "a string, b string, c double").toDF(
        "CID_External", "Segments V1", "Q1 Trips")
    labelled = label_columns(raw, {"CID_External": "Respondent", "Q1 Trips": "How many trips?"})
    book = {r.qid: r.full_question for r in codebook(spark, labelled).collect()}
    assert book == {"cid_external": "Respondent", "segments_v1": None, "q1_trips": "How many trips?"}
    ids = spark.createDataFrame([(7, "S1")], "ccid long, cid string")
    ans = survey_answers(labelled, ids)
    assert set(book) <= set(ans.columns)
    assert [(r.cid_external, r.ccid) for r in ans.collect()] == [("S1", 7)]


def test_answers_without_match_keep_null_ccid(spark):
    raw = spark.createDataFrame([("S1",), ("S2",)], "CID_External string")
    ids = spark.createDataFrame([(7, "S1")], "ccid long, cid string")
    got = {r.cid_external: r.ccid for r in survey_answers(raw, ids).collect()}
    assert got == {"S1": 7, "S2": None}


def test_codebook_file_decodes_and_orders_levels(spark, tmp_path):
    from waypoint.sources.survey import decoded, levels_of, read_codebook
    book = tmp_path / "book.csv"
    book.write_text("position,label,code,question_text,question\n2,Low,1,Which?,Seg\n1,High,2,Which?,Seg\n"
                    "9,Other,2,Which?,Seg\n,,,How many?,q\n1,unused,1,Gone?,absent\n")
    raw = spark.createDataFrame([("S1", 1.0, "7"), ("S2", 2.0, None), ("S3", 9.0, "x"), (None, None, "1")],
                                "CID_External string, Seg double, q string")
    got = decoded(raw, read_codebook(spark, str(book)))
    assert [tuple(r) for r in got.collect()] == [("S1", "Low", "7"), ("S2", "High", None), ("S3", "9", "x"), (None, None, "1")]
    assert levels_of(got, "Seg") == ("High", "Low") and levels_of(got, "q") == ()
    assert got.schema["q"].metadata["label"] == "How many?"
    # labels and levels outlive cleaned names, joins and filters
    ans = survey_answers(got, spark.createDataFrame([(7, "S1")], "ccid long, cid string")).where("ccid = 7")
    assert levels_of(ans, "seg") == ("High", "Low") and [(r.seg, r.ccid) for r in ans.collect()] == [("Low", 7)]


def test_codebook_without_a_column_is_refused(spark, tmp_path):
    import pytest
    from waypoint.sources.survey import read_codebook
    (tmp_path / "b.csv").write_text("question,code\nq,1\n")
    with pytest.raises(ValueError, match="label"):
        read_codebook(spark, str(tmp_path / "b.csv"))
