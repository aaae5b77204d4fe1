"""Raw replies: fences, strict JSON, defaults, types and costs."""

from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftdesk import schemas
from siftdesk.functions import replies
from siftdesk.functions.numbers import round_float
from siftdesk.functions.replies import Prices
from siftdesk.operators.enrichment import as_enrichments, parse_responses, score, split_parsed

PRICES = Prices(Decimal("3.00"), Decimal("15.00"))


@pytest.fixture
def parse(frame):
    def run(*texts):
        rows = [
            {"ticket_id": str(i), "raw_text": t, "tokens_in": 1000, "tokens_out": 200}
            for i, t in enumerate(texts)
        ]
        found = parse_responses(frame(schemas.REPLIES, rows), PRICES, "m")
        return sorted(found.collect(), key=lambda row: int(row["ticket_id"]))

    return run


def test_well_formed(parse):
    text = (
        '{"severity":" HIGH\\n","category":"billing","summary":"s",'
        '"suggested_response":"r","confidence":0.85}'
    )
    (row,) = parse(text)
    assert (row.severity, row.category, row.summary) == ("high", "billing", "s")
    assert (row.suggested_response, row.confidence) == ("r", Decimal("0.850"))
    assert (row.estimated_cost, row.model_used, row.prompt_version) == (Decimal("0.006000"), "m", "v1.0")
    assert row.raw_response == text and row.parse_error is None


def test_defaults(parse):
    (row,) = parse("{}")
    assert (row.severity, row.category, row.confidence) == ("medium", "general", Decimal("0.500"))
    assert row.summary == "No summary available"
    assert row.suggested_response == "No response generated"


@pytest.mark.parametrize(
    "value, expected",
    [
        ("7", "1.000"),
        ("-1", "0.000"),
        ('"0.9"', "0.500"),
        ("null", "0.500"),
        ("true", "1.000"),
        ("false", "0.000"),
        ("[1]", "0.500"),
        ("0.1234", "0.123"),
        ("0.8125", "0.812"),
        ("1e400", "1.000"),
        ("NaN", "1.000"),
        ("-Infinity", "0.000"),
        ("123456789012345678901234567890", "1.000"),
    ],
)
def test_confidence(parse, value, expected):
    (row,) = parse(f'{{"confidence":{value}}}')
    assert row.confidence == Decimal(expected)


@pytest.mark.parametrize(
    "value, expected",
    [
        ("null", "None"),
        ("true", "True"),
        ("5", "5"),
        ("1.50", "1.5"),
        ("1.0", "1.0"),
        ("-0.0", "-0.0"),
        ("-0", "0"),
        ("123456789.123", "123456789.123"),
        ("1e20", "1e+20"),
        ("1e-7", "1e-07"),
        ("0.0001", "0.0001"),
        ("1E400", "inf"),
        ("NaN", "nan"),
        ("-Infinity", "-inf"),
        ("7.695759147568859e+17", "7.695759147568859e+17"),
        ("1" * 50, "1" * 50),
        ('"a\\n\\u0041"', "a\nA"),
        ('{"a":[1,2]}', '{"a":[1,2]}'),
    ],
)
def test_free_text(parse, value, expected):
    (row,) = parse(f'{{"summary":{value}}}')
    assert row.summary == expected


@pytest.mark.parametrize(
    "text",
    [
        '```json\n{"severity":"low"}\n```',
        '```{"severity":"low"}```',
        ' \n```\n{"severity":"low"}\n```\n ',
        '\xa0{"severity":"low"} ',
        '{"severity":"low"}```',
        '{"severity":"high","severity":"low"}',
    ],
)
def test_accepted_forms(parse, text):
    (row,) = parse(text)
    assert row.parse_error is None and row.severity == "low"


@pytest.mark.parametrize(
    "text",
    [
        '```json {"severity":"low"}```',
        "[1]",
        "null",
        "42",
        '"str"',
        "",
        None,
        "not json",
        '{"a":1,}',
        '{"a":1} xyz',
        '{"a":1} {"b":2}',
        '{"a":1},{"b":2}',
        '{"a":1}] [{"b":2}',
        '{"a":1},{"mark":0}] [{"b":2}',
        "{'a':1}",
        '{"summary":"a\nb"}',
        '{"severity":"low"',
        '{"a":01}',
        "```",
    ],
)
def test_refused_forms(parse, text):
    (row,) = parse(text)
    assert row.parse_error == "not_an_object"
    assert row.severity is None and row.estimated_cost is None


@pytest.mark.parametrize("value", ["null", "5", "true", '["low"]'])
@pytest.mark.parametrize("key", ["severity", "category"])
def test_labels_must_be_text(parse, key, value):
    (row,) = parse(f'{{"{key}":{value}}}')
    assert row.parse_error == f"{key}_not_text"


def test_unknown_labels_and_case_of_keys(parse):
    one, two = parse('{"severity":"urgent","category":"x"}', '{"Severity":"low"}')
    assert (one.severity, one.category) == ("medium", "general")
    assert two.severity == "medium"


def test_rows_of_the_enrichments_table(frame):
    rows = [
        {"ticket_id": str(i), "raw_text": t, "tokens_in": 1, "tokens_out": 1} for i, t in enumerate(["{}", "{"])
    ]
    made = as_enrichments(parse_responses(frame(schemas.REPLIES, rows), PRICES, "m"))
    assert [(f.name, f.dataType) for f in made.schema] == [(f.name, f.dataType) for f in schemas.ENRICHMENTS]
    (row,) = made.collect()
    assert row.ticket_id == "0" and row.id == made.first().id and len(row.id) == 36


def test_split(frame):
    rows = [
        {"ticket_id": "1", "raw_text": "{}", "tokens_in": 1, "tokens_out": 1},
        {"ticket_id": "2", "raw_text": "{", "tokens_in": 1, "tokens_out": 1},
    ]
    done, failed = split_parsed(parse_responses(frame(schemas.REPLIES, rows), PRICES, "m"))
    assert [r.ticket_id for r in done.collect()] == ["1"]
    assert [r.ticket_id for r in failed.collect()] == ["2"]


@pytest.mark.parametrize(
    "tokens, prices, expected",
    [
        ((1000, 200), PRICES, "0.006000"),
        ((0, 0), PRICES, "0.000000"),
        ((1, 1), PRICES, "0.000018"),
        ((2_147_483_647, 2_147_483_647), PRICES, None),
        ((1, 1), Prices(Decimal("0.25"), Decimal("1.25")), "0.000002"),
    ],
)
def test_cost(spark, tokens, prices, expected):
    df = spark.createDataFrame([tokens], "i int, o int")
    (row,) = df.select(replies.token_cost(F.col("i"), F.col("o"), prices).alias("c")).collect()
    assert row.c == (None if expected is None else Decimal(expected))


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    values=st.lists(
        st.one_of(
            st.floats(min_value=-1e6, max_value=1e6),
            st.integers(-4000, 4000).map(lambda k: (2 * k + 1) / 2000),
            st.integers(-64, 64).map(lambda k: k / 16),
        ),
        min_size=50,
        max_size=200,
    ),
    places=st.sampled_from([3, 4, 6]),
)
def test_rounds_like_a_float(spark, values, places):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    rows = df.select("x", round_float(F.col("x"), places).alias("y")).collect()
    for row in rows:
        assert row.y == round(row.x, places), row.x


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.floats(allow_nan=False, allow_infinity=False), st.integers()), min_size=30, max_size=100))
def test_numbers_are_spelled_like_python(spark, values):
    tokens = [repr(v) for v in values if not 0 < abs(v) < 1e-300]
    df = spark.createDataFrame([(t,) for t in tokens], "t string")
    for row in df.select("t", replies.number_text(F.col("t")).alias("x")).collect():
        assert row.x == row.t


def test_long_and_deep_replies(parse):
    long, deep = "x" * 21_000_000, "[" * 1200 + "]" * 1200
    one, two = parse(f'{{"summary":"{long}"}}', f'{{"summary":"s","other":{deep}}}')
    assert one.parse_error is None and len(one.summary) == 21_000_000
    assert two.parse_error is None and two.summary == "s"


def test_wanted_fields_only(frame):
    rows = [{"ticket_id": "1", "raw_text": '{"summary":5}', "tokens_in": 1, "tokens_out": 1}]
    found = parse_responses(frame(schemas.REPLIES, rows), PRICES, "m", fields=("category",))
    assert "summary" not in found.columns and found.first().category == "general"


def flaky():
    import pandas as pd

    def score_batch(batch):
        if (batch["title"] == "bad").any():
            raise ValueError("no")
        if (batch["title"] == "odd").any():
            return pd.DataFrame({"ticket_id": ["nobody"], "raw_text": ["{}"], "tokens_in": 1, "tokens_out": 1})
        batch = batch[batch["title"] != "lost"]
        good = [a >= int(t) for a, t in zip(batch["attempt"], batch["title"])]
        made = pd.DataFrame(
            {
                "ticket_id": batch["ticket_id"],
                "raw_text": ['{"severity":"low"}' if g else "sorry" for g in good],
                "tokens_in": 10,
                "tokens_out": batch["attempt"],
            }
        )
        return pd.concat([made, made.assign(raw_text='{"severity":"high"}')])

    return score_batch


def test_scoring_retries(tickets):
    from conftest import ticket

    rows = [ticket("a", title="1"), ticket("b", title="3"), ticket("c", title="4"), ticket("e", title="lost")]
    found = score(tickets(*rows).coalesce(1), flaky(), PRICES, "m").collect()
    assert sorted((r.ticket_id, r.attempts, r.severity, r.last_error) for r in found) == [
        ("a", 1, "low", None),
        ("b", 3, "low", None),
        ("c", 3, None, "not_an_object"),
        ("e", 3, None, "no reply"),
    ]
    assert {r.ticket_id: r.tokens_out for r in found}["b"] == 3


def test_no_ticket_is_sent_more_often_than_counted(spark, tickets, tmp_path):
    from conftest import ticket

    log = str(tmp_path / "sent")

    def noisy():
        inner = flaky()

        def score_batch(batch):
            with open(log, "a") as file:
                file.write("".join(f"{i}\n" for i in batch["ticket_id"]))
            return inner(batch)

        return score_batch

    rows = [ticket(str(i), title="1") for i in range(100)]
    rows += [ticket("bad", title="bad"), ticket("odd", title="odd")]
    found = {r.ticket_id: r for r in score(tickets(*rows).coalesce(1), noisy(), PRICES, "m").collect()}
    sent = open(log).read().split()
    assert len(found) == 102
    assert {i: sent.count(i) for i in found} == {i: r.attempts for i, r in found.items()}
    assert found["7"].attempts == 2 and found["7"].last_error is None
    assert found["bad"].attempts == 3 and found["bad"].last_error == "ValueError: no"
    assert found["odd"].last_error.startswith("ValueError: the scorer made up ids")


def test_scoring_nothing(tickets):
    assert score(tickets(), flaky(), PRICES, "m").count() == 0
