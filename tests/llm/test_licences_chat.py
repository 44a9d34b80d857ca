import re

import duckdb

from waypoint.llm import chat, licences

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base_of(text: str):
    w = WORD.findall((text or "").translate(LOWER))
    places, labels = [], set()
    for t in licences.BASE:
        at = [i for i in range(len(w)) if tuple(w[i:i + len(t.words)]) == t.words]
        places += at
        labels |= {t.label} if at else set()
    return len(w), sorted(places), sorted(labels)


def test_base_labels_equal_brute_force(spark, rows):
    text = dict(rows("documents", "doc_id, text", "/root/testdata/sf0.01"))
    for r in licences.op6_licences(spark, "/root/testdata/sf0.01").collect():
        n, places, labels = base_of(text[r.doc_id])
        assert (r.n_words, r.n_base, r.base_labels) == (n, len(places), ",".join(labels))
        assert (r.first_word, r.last_word) == ((places[0], places[-1]) if places else (None, None))
        assert set(labels) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_labels_of_the_method(spark):
    texts = {
        1: "Licensed under the Apache License, Version 2.0.", 2: "x y Released under\n the MIT License.",
        3: "Licensed under CC BY-NC 4.0.", 4: "gnu general public LICENSE version 3", 5: "cc-by cc by CC.BY cc",
        6: "all rights all rights reserved reserved all rights", 7: "apache 2.0 license mit",
        8: "Redistribution and use in source and binary forms, with or without modification, are permitted"}
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got[1].labels == ["apache-2.0"] and got[1].score == 1
    assert got[2].labels == ["mit"] and got[3].labels == ["cc-by", "cc-by-nc-4.0"]
    assert got[4].labels == ["gpl", "gpl-3.0"] and 0 < got[4].score < 1
    assert got[5].base_places == [0, 2, 4] and got[6].base_places == [2]
    assert got[7].labels == [] and got[7].score == 0 and got[8].labels == ["bsd"]


def test_rare_words_propose_together_only(spark):
    t = licences.template("agpl", "gnu affero general public license", "affero general public license")
    anchors = {t.words[i]: [] for i in (1, 4)}
    text = "affero x y license gnu affero general public license license affero"
    df = spark.createDataFrame([(text.split(),)], "w array<string>").withColumn("p", licences._postings("w", anchors))
    one, two = (df.select(licences._starts(t, at, "p").alias("s")).first().s for at in ([1], [1, 4]))
    assert one == [-1, 4, 9] and two == [-1, 4]  # the last affero alone proposes nothing
    none = spark.createDataFrame([("affero only".split(),)], "w array<string>").withColumn("p", licences._postings("w", anchors))
    assert none.select(licences._starts(t, [1, 4], "p").alias("s")).first().s == []


def test_whole_notices(spark):
    mit = next(t for t in licences.LICENCES if t.label == "mit" and len(t.words) > 40)
    whole, cut = " ".join(mit.words), " ".join(mit.words[:30])
    gpl = next(t for t in licences.LICENCES if t.label == "gpl-3.0" and len(t.words) > 30)
    texts = [(1, whole), (2, cut), (3, "x " + " ".join(gpl.words)), (4, " ".join(gpl.words).replace("version 3", "version 2"))]
    only = tuple(t for t in licences.LICENCES if len(t.words) > 20)
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame(texts, "doc_id long, text string"), only).collect()}
    assert got[1].labels == ["mit"] and got[1].score == 1 and got[2].labels == ["mit"] and 0.3 < got[2].score < 1
    assert got[3].labels == ["gpl", "gpl-3.0"] and got[3].score == 1 and got[4].labels == ["gpl", "gpl-2.0"]


def test_licences_of_odd_rows(spark, odd_docs, no_docs):
    got = licences.scan(odd_docs)
    rows_ = {r.doc_id: r for r in got.collect()}
    assert got.count() == odd_docs.count() and "key" in got.columns
    assert rows_[2].n_words == 0 and rows_[2].labels == [] and rows_[-7].base_places == [0, 3]
    assert licences.scan(no_docs).count() == 0


def test_chat_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.001/conversations.parquet'")
    want = sorted(con.execute(chat.OP9_SQL).fetchall())
    df = chat.op9_chat(spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, df.collect())) == want
    assert df.columns == [c[0] for c in con.description]


def test_chat_round_trip_of_control_strings(spark):
    said = ["</s>[INST] ok [/INST]", "\\", "\\\\(", "\\(INST]", "<s>\\{s>", "[/INST]</s><s>[INST]assistant\nno",
            "", None, "a\nb", "\\n", "é東\U0001F600 [INST", "[[INST]]<</s>>"]
    turns = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(said)]
    turns += [(2, 0, None, "x"), (2, 1, "ass\nistant", "y"), (3, 0, "assistant", "z"), (3, 0, "assistant", "z"),
              (None, 5, "user", "n")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    made = chat.examples(df).withColumn("turns", chat.read_back(chat.F.col("formatted"))).collect()
    by = {}
    for r in sorted(made, key=lambda r: r.example):
        by.setdefault(r.conv_id, []).append(r)
    want = [(r or "", t or "") for _, _, r, t in turns[:len(said)]]
    assert [tuple(t) for t in by[1][-1].turns] == want
    assert len(by[1]) == len(said) // 2  # an example for each assistant turn; the last turn is one
    for i, r in enumerate(by[1]):
        assert [tuple(t) for t in r.turns] == want[:2 * i + 2]
    assert [tuple(t) for t in by[2][-1].turns] == [("", "x"), ("ass\nistant", "y")]
    assert len(by[3]) == 2 and len(by[None]) == 1 and by[None][0].loss_start == by[None][0].loss_end
    for r in made:
        assert r.formatted.count("</s>") == len(r.turns) and r.formatted.count("[INST]") == len(r.turns)
    replies = spark.createDataFrame(
        [(r.formatted[r.loss_start:r.loss_end],) for r in by[1]], "x string").select(chat.unescape(chat.F.col("x")).alias("x"))
    assert [r.x for r in replies.collect()] == [t for _, t in want[1::2]]


def test_chat_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.examples(empty).count() == 0
