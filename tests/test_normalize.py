from conftest import rows

from textlab.operators import normalize as N

LONG = "one two three four five"


def test_first_accepted_header_in_column_order_wins():
    found = N.discover_columns(["source", "MODEL", "Post", "text", "CLASS"], N.SOCIAL_HEADERS)
    assert found == {"text": "Post", "label": "CLASS", "model": "source", "platform": None}


def test_adversarial_headers():
    found = N.discover_columns(["id", "generation", "model", "is_ai", "post"], N.ADVERSARIAL_HEADERS)
    assert found == {"text": "generation", "model": "model", "label": "is_ai"}


def test_no_text_column_gives_no_rows(spark):
    df = spark.createDataFrame([("ai", "x")], "label STRING, model STRING")
    for align in (N.align_social, N.align_adversarial):
        aligned = align(df)
        assert aligned.count() == 0
        assert aligned.columns == ["text", "raw_label", "label", "source_model", "platform", "dataset"]


def test_social_rows(spark):
    df = spark.createDataFrame(
        [
            (1, LONG, "AI", " gpt ", " Reddit "),
            (2, LONG, "human", None, None),
            (3, LONG, "generated", "NA", ""),
            (4, LONG, "banana", "m", "p"),
            (5, LONG, None, "m", "p"),
            (6, "a b", "banana", "m", "p"),
            (7, "one two three four", "ai", "m", "p"),
            (8, f"  {LONG} https://x.y ", "0", " ", "X"),
        ],
        "k INT, Post STRING, CLASS STRING, Generator STRING, Network STRING",
    )
    aligned = N.align_social(df, keep=["k"])
    assert rows(N.accepted(aligned, keep=["k"]), "k") == [
        (1, LONG, "ai", "gpt", "reddit", "multisocial"),
        (2, LONG, "human", "human", "unknown", "multisocial"),
        (3, LONG, "ai", "unknown_ai", "unknown", "multisocial"),
        (8, f"{LONG} [URL]", "human", "", "x", "multisocial"),
    ]
    assert rows(N.unknown_label_tally(aligned)) == [("banana", 1, 2), ("nan", 1, 2)]


def test_without_label_column_all_rows_are_human(spark):
    df = spark.createDataFrame([(LONG, "m")], "message STRING, model STRING")
    assert rows(N.accepted(N.align_social(df))) == [(LONG, "human", "m", "unknown", "multisocial")]


def test_adversarial_rows(spark):
    df = spark.createDataFrame(
        [
            (1, LONG, None, "gpt"),
            (2, LONG, None, " "),
            (3, LONG, None, None),
            (4, LONG, "original", "gpt"),
            (5, LONG, "True", None),
            (6, LONG, "no", "gpt"),
            (7, "a b", "original", "gpt"),
        ],
        "k INT, generation STRING, label STRING, model STRING",
    )
    aligned = N.align_adversarial(df, keep=["k"])
    assert rows(N.accepted(aligned, keep=["k"]), "k") == [
        (1, LONG, "ai", "gpt", "raid", "raid"),
        (2, LONG, "human", "", "raid", "raid"),
        (3, LONG, "human", "human", "raid", "raid"),
        (5, LONG, "ai", "unknown_ai", "raid", "raid"),
        (6, LONG, "human", "gpt", "raid", "raid"),
    ]
    assert rows(N.unknown_label_tally(aligned)) == [("original", 1, 1)]


def test_adversarial_without_label_and_model_is_all_human(spark):
    df = spark.createDataFrame([(LONG,)], "output STRING")
    assert rows(N.accepted(N.align_adversarial(df))) == [(LONG, "human", "human", "raid", "raid")]


def test_explode_answers(spark):
    df = spark.createDataFrame(
        [(1, [LONG, None, "short"], [LONG + " six"]), (2, None, []), (3, [], None)],
        "q INT, human_answers ARRAY<STRING>, chatgpt_answers ARRAY<STRING>",
    )
    assert rows(N.explode_answers(df, keep=["q"]), "q", "answer_pos") == [
        (1, 0, LONG, "human", "human", "qa_forum", "hc3"),
        (1, 3, LONG + " six", "ai", "chatgpt", "qa_forum", "hc3"),
    ]


def test_tally_orders_by_count_then_label(spark):
    data = [(LONG, f"odd{i:02d}") for i in range(12)] + [(LONG, "odd11")]
    tally = N.unknown_label_tally(N.align_social(spark.createDataFrame(data, "text STRING, label STRING")))
    found = [tuple(r) for r in tally.orderBy("n", ascending=False).collect()]
    assert len(found) == 10 and found[0] == ("odd11", 2, 13)
    assert {r[0] for r in found} == {"odd11"} | {f"odd{i:02d}" for i in range(9)}


def test_combine_keeps_duplicates(spark):
    df = spark.createDataFrame([(LONG, "ai")], "text STRING, label STRING")
    one = N.accepted(N.align_social(df))
    assert N.combine(one, one).count() == 2


def test_length_filter_reaches_the_scan_and_text_is_cleaned_once(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = N.accepted(N.align_social(df))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[URL]") == 1
    assert "n_chars" not in plan.split("Relation")[0]


def test_tallies_are_counted_while_rows_are_written(spark, tmp_path):
    from textlab.operators.normalize import Tallies

    posts = spark.createDataFrame(
        [("one two three four five", "ai"), ("too short", "ai"), ("one two three four six", "odd"), (None, "human")],
        "text STRING, label STRING",
    )
    nothing = spark.createDataFrame([(1,), (2,)], "note INT")
    tallies = Tallies()
    kept = tallies.align("posts", posts).unionByName(tallies.align("nothing", nothing))
    kept.write.parquet(str(tmp_path / "corpus"))
    assert spark.read.parquet(str(tmp_path / "corpus")).count() == 1
    assert sorted(map(tuple, tallies.report(spark).collect())) == [("nothing", 2, 2, 0, 0), ("posts", 4, 2, 1, 1)]
