from pyspark.sql import functions as F
import pytest

from gleaner.functions import decisions, hashing, scoring, text
from gleaner.rules import seed_rules

RULES = seed_rules()


def one(spark, column, **values):
    """Value of a column over one row of literals."""
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()["x"]


def on(spark, function, value):
    return one(spark, function(F.col("v")), v=value)


def test_normalize(spark):
    source = "Need a **Bot**\t\tfor  my shop\n\n\n\nThanks"
    assert on(spark, text.normalize_text, source) == "need a bot for my shop\n\nthanks"
    assert on(spark, text.normalize_text, "  ~A_B`  ") == "ab"


def test_aliases_do_not_cascade(spark):
    source = "two devs need chat bots and a chat bot, web-scraping"
    expected = "two developer need chat bot and a chatbot, web scraping"
    assert on(spark, lambda c: text.apply_aliases(c, RULES.aliases), source) == expected
    chain = {"a": "b", "b": "c"}
    assert on(spark, lambda c: text.apply_aliases(c, chain), "a b a") == "b c b"
    assert on(spark, lambda c: text.apply_aliases(c, {}), "dev") == "dev"
    assert on(spark, lambda c: text.apply_aliases(c, RULES.aliases), "no such word") == "no such word"


@pytest.mark.parametrize(
    "title, tag",
    [
        ("[For Hire] Python dev", "for hire"),
        ("(Task) x", "task"),
        ("[H] x", None),
        ("Hiring [x]", None),
        ("  [ Hiring ) x", "hiring"),
    ],
)
def test_tag(spark, title, tag):
    assert on(spark, text.extract_tag, title) == tag


def test_struct_features(spark):
    source = "Title?\n\n- a\n- b\n3) c"
    found = one(spark, text.struct_features(F.col("v"), F.lit(True)), v=source).asDict()
    assert found == {
        "length": 20,
        "line_count": 4,
        "bullet_line_count": 3,
        "has_links": False,
        "has_email": False,
        "has_body": True,
        "title_is_question": True,
    }
    empty = one(spark, text.struct_features(F.col("v"), F.lit(False)), v="").asDict()
    assert empty["line_count"] == 0 and empty["title_is_question"] is False


def test_matched_terms_longest_first(spark):
    pattern = RULES.patterns["stack"]
    assert on(spark, lambda c: text.matched_terms(c, pattern), "web scraping with python python") == [
        "web scraping",
        "python",
    ]
    # Word bounds are Unicode: a Cyrillic letter joins the word.
    assert on(spark, lambda c: text.matched_terms(c, pattern), "яpython") == []


def test_terms_with_pattern_characters(spark):
    pattern = text.alternation(["node.js", "a+b"])
    assert on(spark, lambda c: text.matched_terms(c, pattern), "node.js nodexjs a+b aab") == [
        "node.js",
        "a+b",
    ]


def test_positions_count_code_points(spark):
    pattern = text.alternation(["solved"])
    assert on(spark, lambda c: text.match_positions(c, pattern), "😀 solved é solved") == [2, 11]
    assert on(spark, lambda c: text.match_positions(c, pattern), "none") == []


def test_token_index(spark):
    for position, index in [(0, 0), (2, 0), (3, 1), (5, 1), (6, 2), (99, 2)]:
        got = one(spark, text.token_index(F.col("t"), F.col("p")), t="ab cd ef", p=position)
        assert got == (0 if position == 2 else index)
    assert one(spark, text.token_index(F.col("t"), F.col("p")), t="   ", p=1) == 0


def test_starts_within(spark):
    pattern = text.alternation(["hire me"])
    assert on(spark, lambda c: text.starts_within(c, pattern, 300), "x" * 298 + " hire me")
    assert not on(spark, lambda c: text.starts_within(c, pattern, 300), "x" * 299 + " hire me")


@pytest.mark.parametrize(
    "source, money, contact",
    [
        ("my budget is $500", "budget is", None),
        ("pay $ 500 now", "$ 500", None),
        ("40 USD", "40 USD", None),
        ("30 per hour", "30 per hour", None),
        ("about 5k", "5k", None),
        ("write me@x.io or dm me", None, "me@x.io"),
        ("dms open", None, "dms open"),
        ("see t.me/abc now", None, "t.me/abc"),
        ("admin board", None, None),
    ],
)
def test_money_and_contact(spark, source, money, contact):
    assert on(spark, scoring.compensation, source) == money
    assert on(spark, scoring.contact, source) == contact


def test_body(spark):
    html = "x<!-- SC_OFF --><p>a &amp;amp; b</p>\n\n\n\n<i>c</i><!-- SC_ON -->tail"
    rows = spark.createDataFrame([(html,), ("no sentinel",), (None,), ("<!--SC_OFF--><!--SC_ON-->",)], "v string")
    got = [tuple(r.b) for r in rows.select(text.extract_body(F.col("v")).alias("b")).collect()]
    assert got == [("a & b \n\n c", True), ("", False), ("", False), ("", True)]


def _plain_simhash(tokens, digest):
    bits = [0] * 64
    for token in tokens:
        value = int.from_bytes(digest(token), "big")
        for i in range(64):
            bits[i] += 1 if value >> i & 1 else -1
    return sum(1 << i for i in range(64) if bits[i] > 0)


@pytest.mark.parametrize("kind", ["blake2b", "md5"])
def test_simhash(spark, kind):
    texts = ["", "a b", "one", "one two three two", "ещё слова тут", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    signed = hashing.simhash64(F.col("t"), kind)
    found = {r.i: r for r in rows.select("i", signed.alias("s"), hashing.to_unsigned64(signed).alias("u")).collect()}
    tokens = [[], [], ["one"], ["one", "two", "three", "two"], ["слова", "тут"], []]
    for i, expected in enumerate(_plain_simhash(t, hashing.TOKEN_DIGESTS[kind]) for t in tokens):
        assert int(found[i].u) == expected
        assert found[i].s == (expected - (1 << 64) if expected >= 1 << 63 else expected)


def test_bits(spark):
    longs = spark.createDataFrame([(-(1 << 62), (1 << 62) - 1, 6, 5)], "a bigint, b bigint, c bigint, d bigint")
    got = longs.select(
        hashing.hamming(F.col("a"), F.col("b")).alias("wide"),
        hashing.hamming(F.col("c"), F.col("d")).alias("two"),
        hashing.bands(F.lit(-(1 << 48) + 5)).alias("bands"),
    ).first()
    assert (got.wide, got.two, got.bands) == (64, 2, [5, 0, 0, 65535])


@pytest.mark.parametrize(
    "clock, score, notify, status",
    [
        ("22:59:59", 12, True, "new"),
        ("23:00:00", 14, True, "digest_pending"),
        ("23:30:00", 15, True, "new"),
        ("07:59:59", 10, True, "digest_pending"),
        ("08:00:00", 10, True, "new"),
        ("12:00:00", 40, False, "suppressed"),
        ("23:30:00", 40, False, "suppressed"),
    ],
)
def test_route(spark, clock, score, notify, status):
    ts = F.to_timestamp(F.concat(F.lit("2024-03-01 "), F.col("c")))
    got = decisions.route_status(F.col("s"), F.col("n"), decisions.in_quiet_hours(ts))
    assert one(spark, got, c=clock, s=score, n=notify) == status


def test_quiet_hours_in_a_zone_and_without_wrap(spark):
    ts = F.to_timestamp(F.lit("2024-07-01 21:30:00"))
    assert one(spark, decisions.in_quiet_hours(ts, zone="Europe/Berlin"), v=1) is True
    assert one(spark, decisions.in_quiet_hours(ts, zone="UTC"), v=1) is False
    assert one(spark, decisions.in_quiet_hours(ts, "21:00", "22:00"), v=1) is True
    assert one(spark, decisions.in_quiet_hours(ts, "20:00", "21:30"), v=1) is False


@pytest.mark.parametrize(
    "response, confidence",
    [
        ('{"is_lead": true, "confidence": 0.7}', 0.7),
        ('```json\n{"is_lead": true, "confidence": 0.7}\n```', 0.7),
        ('  ```{"confidence": 1}``` ', 1.0),
        ('json {"confidence": 1}', None),
        ('{"is_lead": 1, "confidence": "0.9"}', 0.9),
        ('{"is_lead": true, "confidence": "high"}', None),
        ("not json", None),
        ("[1]", None),
        ("", None),
    ],
)
def test_parse_verdict(spark, response, confidence):
    verdict = on(spark, decisions.parse_verdict, response)
    assert (verdict and verdict.confidence) == confidence


def test_simhash_holds_the_tokens_of_few_texts_at_a_time():
    import tracemalloc

    import pandas as pd

    from gleaner.functions import hashing

    texts = pd.Series([" ".join(f"word{(i * j) % 997}" for j in range(600)) for i in range(2000)] + [None, ""])
    tracemalloc.start()
    got = hashing._majority_bits(texts, hashing._md5_digest)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6, peak
    alone = [hashing._majority_bits(texts[i : i + 1], hashing._md5_digest)[0] for i in range(0, 2002, 91)]
    assert list(got[::91]) == alone and got[2000] == got[2001] == 0 and len(got) == 2002


def test_long_texts_come_to_python_in_batches_bounded_by_bytes(spark):
    import pandas as pd
    from pyspark.sql.types import LongType

    from conftest import DATA
    from gleaner.plans import corpus
    from gleaner.session import ARROW_BYTES

    spark.conf.unset(ARROW_BYTES)
    corpus.texts(spark, DATA, "pages")
    assert spark.conf.get(ARROW_BYTES) == "4m"

    @F.pandas_udf(LongType())
    def most(text: pd.Series) -> pd.Series:
        return pd.Series([text.str.len().sum()] * len(text))

    long = spark.range(0, 400, 1, 1).select(F.repeat(F.concat(F.lit("x"), F.col("id").cast("string")), 20_000).alias("t"))
    assert long.select(most("t").alias("n")).agg(F.max("n")).first()[0] < 8_000_000


def test_near_equals_the_difference_of_token_numbers(spark):
    whole = "  ab cd\u00a0ef  gh\nij k\u0301 😀 mn  "
    pairs = [(whole, a, b) for a in range(len(whole) + 2) for b in range(len(whole) + 2)] + [(whole, None, 3)]
    df = spark.createDataFrame(pairs, "t string, a int, b int")
    for window in (0, 1, 3):
        counted = F.abs(text.token_index(F.col("t"), F.col("a")) - text.token_index(F.col("t"), F.col("b"))) <= window
        got = df.select(text.near(F.col("t"), F.col("a"), F.col("b"), window).alias("got"), counted.alias("wanted"))
        assert got.filter(~F.col("got").eqNullSafe(F.col("wanted"))).isEmpty()


def test_a_term_is_looked_for_from_its_first_character_on(spark):
    pattern = text.alternation(["a+b", "-x", "[y]", "é", "😀z", "&&w", "^q"])
    assert pattern.startswith("(?=[")
    plain = pattern[pattern.index(")") + 1 :]
    for value in ("a+b -x [y] é😀z", "q-x1 k[y]k é a&&w w^q", "ea+bé 1😀z2", ""):
        got = one(spark, F.struct(F.regexp_extract_all("v", F.lit("(?U)" + pattern), F.lit(0)).alias("new"),
                                  F.regexp_extract_all("v", F.lit("(?U)" + plain), F.lit(0)).alias("plain")), v=value)
        assert got["new"] == got["plain"]


def test_simhash_keeps_digests_of_tokens_across_texts():
    import pandas as pd

    from gleaner.functions import hashing

    asked = []

    def digest(token):
        asked.append(token)
        return hashing.TOKEN_DIGESTS["md5"](token)

    texts = pd.Series(["word " * 3 + "x" * hashing.SLICE_CHARS, "word again", None, "WORD \u212aelvin"])
    digests = hashing._Digests(digest)
    got = hashing._majority_bits(texts, digests)
    # One call per distinct short token, also where the texts lie in different slices.
    assert asked.count("word") == 1 and "\u212aelvin" in asked
    alone = [hashing._majority_bits(texts[i : i + 1], hashing._md5_digest)[0] for i in range(4)]
    assert list(got) == alone
