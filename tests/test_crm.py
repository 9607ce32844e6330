import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from gleaner import schemas
from gleaner.operators import admin, crm

T0 = dt.datetime(2024, 5, 1)


@pytest.fixture(scope="module")
def tables(spark):
    """Five items and matches: three delivered, one suppressed, one new."""
    raw = spark.createDataFrame(
        [(i + 1, "alpha", f"user{i}", f"https://example.test/{i}", f"Заголовок {i}", f"Текст записи {i}", T0) for i in range(5)],
        "id bigint, source string, author_handle string, permalink string, title string, text string, posted_at timestamp",
    )
    status = ["notified"] * 3 + ["suppressed", "new"]
    matches = spark.createDataFrame(
        [(i + 1, i + 1, "main", 10 + i, "hiring_intent", f"Лид {i}", status[i], T0, i == 0) for i in range(5)],
        "id bigint, raw_item_id bigint, circuit string, score int, intent_tag string, headline string, status string, created_at timestamp, is_favorite boolean",
    )
    return raw, matches


def contact(lead, state="contacted"):
    return (lead, "contact", state, None, None, None, None)


def response(lead, taken, text="ok"):
    return (lead, "response", None, text, taken, None, None)


def earnings(lead, amount, currency=None):
    return (lead, "earnings", None, None, None, amount, currency)


def delete(lead):
    return (lead, "delete", None, None, None, None, None)


def run(spark, tables, *commands):
    rows = [(i, T0 + dt.timedelta(hours=i), *c) for i, c in enumerate(commands)]
    log = spark.createDataFrame(rows, schemas.CRM_COMMANDS)
    outcomes = crm.command_outcomes(log, tables[1])
    codes = [r.outcome for r in outcomes.orderBy("cmd_id").collect()]
    return codes, crm.crm_state(outcomes)


def ids(frame):
    return {r.id for r in frame.select("match.id").collect()}


def test_no_commands(spark, tables):
    _, state = run(spark, tables)
    rows = crm.lead_rows(tables[1], tables[0], state)
    page = crm.lead_page(rows).collect()
    assert [r.id for r in page] == [3, 2, 1]
    assert {(r.contact_state, r.total) for r in page} == {("not_contacted", 3)}
    first, second = crm.lead_page(rows, 2, 0).collect(), crm.lead_page(rows, 2, 2).collect()
    assert [r.id for r in first + second] == [3, 2, 1] and second[0].total == 3
    assert [r.id for r in crm.lead_page_after(rows, T0, 2).collect()] == [1]
    assert crm.lead_rows(tables[1], tables[0], state, circuit="browse").count() == 0


def test_whole_deal(spark, tables):
    codes, state = run(spark, tables, contact(1), response(1, "true"), earnings(1, "450.5", "EUR"))
    row = state.first()
    assert codes == [200, 200, 200] and row.taken_in_work is True and row.in_work_at == T0 + dt.timedelta(hours=1)
    assert (row.earnings, row.currency) == (Decimal("450.50"), "EUR")
    assert crm.crm_violations(state).count() == 0


@pytest.mark.parametrize(
    "commands, expected",
    [
        ([response(1, "true")], [400]),
        ([contact(1, "postponed"), response(1, "true")], [200, 400]),
        ([contact(1), response(1, "false"), earnings(1, "100")], [200, 200, 400]),
        ([contact(1), response(1, "true"), earnings(1, "-1")], [200, 200, 422]),
        ([contact(1), response(1, "true"), earnings(1, "1", "bad")], [200, 200, 422]),
        ([contact(1), response(1, "true"), earnings(1, "1.234")], [200, 200, 422]),
        ([contact(1), response(1, "true"), earnings(1, "12345678901")], [200, 200, 422]),
        ([contact(1), response(1, "true"), earnings(1, "100"), response(1, "false")], [200, 200, 200, 400]),
        ([contact(1), response(1, "true"), earnings(1, "100"), response(1, None), response(1, "true"), earnings(1, "7")], [200, 200, 200, 400, 200, 200]),
        ([contact(1, "not_contacted")], [422]),
        ([contact(1), response(1, "maybe")], [200, 422]),
        ([contact(1), response(1, "null", "")], [200, 422]),
        ([contact(1), response(1, "true"), response(1, "null"), earnings(1, "5")], [200, 200, 200, 400]),
        ([contact(4), delete(5), contact(99)], [404, 404, 404]),
        ([delete(1), delete(1), contact(1), earnings(1, "bad")], [204, 204, 404, 422]),
        ([contact(1), contact(1, "postponed"), response(1, "true"), contact(1), response(1, "true")], [200, 200, 400, 200, 200]),
    ],
)
def test_guards(spark, tables, commands, expected):
    assert run(spark, tables, *commands)[0] == expected


def test_first_contact_time_is_kept(spark, tables):
    _, state = run(spark, tables, contact(1), contact(1, "postponed"), contact(1))
    row = state.first()
    assert row.contacted_at == T0 and row.contact_state == "contacted"


def test_filters(spark, tables):
    _, state = run(spark, tables, contact(1), response(1, "true"), contact(2, "postponed"))
    slices = {n: ids(crm.visible_leads(tables[1], state, n)) for n in ("all", "not_contacted", "contacted", "postponed", "in_work", "no_deal")}
    assert slices == {"all": {1, 2, 3}, "not_contacted": {3}, "contacted": {1}, "postponed": {2}, "in_work": {1}, "no_deal": set()}
    with pytest.raises(ValueError):
        crm.visible_leads(tables[1], state, "other")


def test_delete_and_stats(spark, tables):
    raw, matches = tables
    _, state = run(spark, tables, contact(1), response(1, "true"), earnings(1, "300"), delete(1), contact(2))
    stats = crm.funnel_stats(matches, state).first().asDict()
    assert stats == {"total_leads": 2, "not_contacted": 1, "contacted": 1, "postponed": 0, "in_work": 0, "no_deal": 0, "removed": 1}
    assert [tuple(r) for r in crm.earnings_by_currency(state).collect()] == [("USD", Decimal("300.00"))]
    details = {r.id: r for r in crm.lead_details(matches, raw, state).collect()}
    assert set(details) == {2, 3} and details[3].crm is None and details[2].crm.contact_state == "contacted"
    asked = spark.createDataFrame([(i,) for i in (1, 2, 4, 77)], "match_id bigint")
    assert {r.match_id for r in crm.missing_leads(asked, matches, state).collect()} == {1, 4, 77}


def test_currencies_are_not_added_up(spark, tables):
    deals = [c for lead, cur in ((1, None), (2, "EUR")) for c in (contact(lead), response(lead, "true"), earnings(lead, "100" if lead == 1 else "200", cur))]
    _, state = run(spark, tables, *deals)
    assert [tuple(r) for r in crm.earnings_by_currency(state).collect()] == [("EUR", Decimal("200.00")), ("USD", Decimal("100.00"))]


def test_pinned_lead(spark, tables):
    _, state = run(spark, tables, delete(2))
    rows = crm.lead_rows(tables[1], tables[0], state)
    assert [r.id for r in crm.page_with_pinned(rows, 1, 1).collect()] == [1, 3]
    assert [r.id for r in crm.page_with_pinned(rows, 3, 1).collect()] == [3]
    assert [r.id for r in crm.page_with_pinned(rows, 2, 1).collect()] == [3]


def test_change_logs(spark):
    log = spark.createDataFrame(
        [(1, "add", "noise", "Foo", None), (2, "del", "noise", "foo", None), (3, "add", "noise", "bar", -3),
         (4, "add", "slang", "x", 1), (5, "del", "noise", "ghost", None), (6, "del", "money", "usd", None)],
        "id bigint, action string, dict_type string, term string, weight int",
    ).withColumn("ts", F.timestamp_seconds("id"))
    table = spark.createDataFrame([("money", "usd", 2, None, True), ("anti", "for hire", 0, None, True)], schemas.KEYWORDS)
    got = {(r.dict_type, r.term): (r.weight, r.enabled) for r in admin.keyword_state(log, table).collect()}
    assert got == {("noise", "foo"): (1, False), ("noise", "bar"): (-3, True), ("money", "usd"): (2, False), ("anti", "for hire"): (0, True)}
    commands = spark.createDataFrame(
        [(1, "mute", "a", None, None), (2, "mute", "b", 2, None), (3, "unmute", "b", None, None), (4, "category", "b", None, "gossip"), (5, "category", "a", None, "job_board")],
        "id bigint, action string, name string, hours int, category string",
    ).withColumn("ts", F.timestamp_seconds("id"))
    sources = spark.createDataFrame([("a", "other", T0), ("b", "other", T0), ("c", "other", T0)], "name string, category string, muted_until timestamp")
    got = {r.name: r for r in admin.source_state(sources, commands).collect()}
    assert got["a"].category == "job_board" and got["a"].muted_until == dt.datetime(1970, 1, 1, 0, 0, 1) + dt.timedelta(hours=8760)
    assert got["b"].category == "other" and got["b"].muted_until is None and got["c"].muted_until == T0
