"""Lead funnel: CRM command fold, lead lists, details and funnel statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner import fixed_values as fixed
from gleaner.functions.text import strip
from gleaner.operators.ordered import HOUR, carry_last
from gleaner.session import cut_lineage

DELIVERED = "notified"
MONEY = "decimal(12,2)"

OK, GONE, BAD_STATE, UNKNOWN_LEAD, INVALID = 200, 204, 400, 404, 422

_TRUE_WORDS = ["1", "t", "true", "y", "yes", "on"]
_FALSE_WORDS = ["0", "f", "false", "n", "no", "off"]


# --- command fold --------------------------------------------------------------------------


def _taken(value: Column) -> tuple[Column, Column]:
    """(tri-state value, whether the text is a valid one)."""
    word = F.lower(value)
    unknown = value.isNull() | F.lower(strip(value)).isin("", "null", "none")
    parsed = F.when(~unknown & word.isin(_TRUE_WORDS), True).when(
        ~unknown & word.isin(_FALSE_WORDS), False
    )
    return parsed, unknown | parsed.isNotNull()


def _amount(value: Column) -> Column:
    """The amount if it is a non-negative number of 12 digits, two of them decimals; else null."""
    text = value.cast("string")
    plain = text.rlike(r"^\+?(\d+(\.\d{0,2})?|\.\d{1,2})$")
    return F.when(plain, text.try_cast(MONEY))


def _parsed(commands: DataFrame) -> DataFrame:
    taken, taken_ok = _taken(F.col("taken_in_work"))
    currency = F.coalesce("currency", F.lit(fixed.DEFAULT_CURRENCY))
    amount = _amount(F.col("earnings"))
    kind = F.col("kind")
    length = F.length("response_text")
    valid = (
        F.when(kind == "contact", F.col("contact_state").isin("contacted", "postponed"))
        .when(kind == "response", length.between(1, fixed.RESPONSE_MAX_CHARS) & taken_ok)
        .when(kind == "earnings", amount.isNotNull() & currency.rlike(fixed.CURRENCY_PATTERN))
        .when(kind == "delete", True)
    )
    return commands.select(
        "cmd_id",
        "ts",
        "match_id",
        "kind",
        "contact_state",
        F.col("response_text").alias("reply_text"),
        taken.alias("taken"),
        amount.alias("amount"),
        currency.alias("currency"),
        F.coalesce(valid, F.lit(False)).alias("valid"),
    )


def command_outcomes(
    commands: DataFrame, matches: DataFrame, chunk_seconds: int = HOUR
) -> DataFrame:
    """Every command with its outcome code, in the order (ts, cmd_id) of its lead.

    422 unreadable command, 404 lead not delivered or deleted, 400 not allowed in this state,
    204 deleted, 200 done.  The guards only ask for the latest earlier command of some kind, so
    the fold is three ordered look-ups and no lead is gathered in one place.
    """
    delivered = (
        matches.filter(F.col("status") == DELIVERED)
        .select(F.col("id").alias("match_id"))
        .distinct()
        .withColumn("known", F.lit(True))
    )
    # What a command writes stays in this table; the fold carries only what its guards ask for.
    whole = cut_lineage(
        _parsed(commands)
        .join(delivered, "match_id", "left")
        .withColumn("_command", F.monotonically_increasing_id())
    )
    # Each look-up reads its input twice; stored before it, so that the work does not multiply.
    kind, valid = F.col("kind"), F.col("valid")
    rows = carry_last(
        whole.drop("reply_text", "amount", "currency"),
        ["match_id"],
        "ts",
        "cmd_id",
        {
            "state_before": F.when(valid & (kind == "contact"), F.col("contact_state")),
            "deleted_before": F.when(kind == "delete", True),
        },
        chunk_seconds,
    )
    reachable = valid & F.col("known").isNotNull() & F.col("deleted_before").isNull()
    replies = reachable & (kind == "response") & (F.col("state_before") == "contacted")
    rows = carry_last(
        cut_lineage(rows),
        ["match_id"],
        "ts",
        "cmd_id",
        # A struct, so that the answer "not decided yet" differs from no answer at all.
        {"answer_before": F.when(replies, F.struct("taken"))},
        chunk_seconds,
    )
    # Until the first amount is booked no answer is refused on its account, so these look-ups
    # are exact for it; after it the lead stays taken, because other answers are refused.
    first_booking = (
        reachable & (kind == "earnings") & F.coalesce(F.col("answer_before.taken"), F.lit(False))
    )
    rows = carry_last(
        cut_lineage(rows),
        ["match_id"],
        "ts",
        "cmd_id",
        {"booked_before": F.when(first_booking, True)},
        chunk_seconds,
    )
    booked = F.col("booked_before").isNotNull()
    contacted = F.coalesce(F.col("state_before") == "contacted", F.lit(False))
    taken = F.coalesce(F.col("taken"), F.lit(False))
    outcome = (
        F.when(~valid, INVALID)
        .when(F.col("known").isNull(), UNKNOWN_LEAD)
        .when(kind == "delete", GONE)
        .when(F.col("deleted_before").isNotNull(), UNKNOWN_LEAD)
        .when((kind == "response") & (~contacted | (booked & ~taken)), BAD_STATE)
        .when((kind == "earnings") & ~booked & ~first_booking, BAD_STATE)
        .otherwise(OK)
    )
    outcomes = rows.select("_command", outcome.alias("outcome"))
    return whole.join(outcomes, "_command").drop("_command", "known")


def crm_state(outcomes: DataFrame) -> DataFrame:
    """Current CRM row of each lead that any accepted command has touched."""
    order = F.struct("ts", "cmd_id")
    done = outcomes.filter(F.col("outcome").isin(OK, GONE))

    def is_kind(name: str) -> Column:
        return F.col("kind") == name

    def last(value: Column, kind: str) -> Column:
        return F.max_by(value, F.when(is_kind(kind), order))

    def first_time(condition: Column) -> Column:
        return F.min(F.when(condition, F.col("ts")))

    return (
        done.groupBy("match_id")
        .agg(
            last(F.col("contact_state"), "contact").alias("contact_state"),
            last(F.struct("reply_text", "taken"), "response").alias("_reply"),
            last(F.struct("amount", "currency"), "earnings").alias("_money"),
            first_time(is_kind("contact") & (F.col("contact_state") == "contacted")).alias(
                "contacted_at"
            ),
            first_time(is_kind("response") & F.col("taken")).alias("in_work_at"),
            first_time(is_kind("delete")).alias("deleted_at"),
            F.min("ts").alias("created_at"),
            F.max("ts").alias("updated_at"),
        )
        .select(
            "match_id",
            F.coalesce("contact_state", F.lit("not_contacted")).alias("contact_state"),
            F.col("_reply.reply_text").alias("reply_text"),
            F.col("_reply.taken").alias("taken_in_work"),
            F.col("_money.amount").alias("earnings"),
            F.col("_money.currency").alias("currency"),
            "contacted_at",
            "in_work_at",
            "deleted_at",
            "created_at",
            "updated_at",
        )
    )


def crm_violations(crm: DataFrame) -> DataFrame:
    """(match_id, rule) for every constraint a CRM row breaks."""
    state, money = F.col("contact_state"), F.col("earnings")
    rules = {
        "contact_state_known": state.isin(fixed.CONTACT_STATES),
        "currency_format": F.col("currency").isNull()
        | F.col("currency").rlike(fixed.CURRENCY_PATTERN),
        "earnings_not_negative": money.isNull() | (money >= 0),
        "earnings_need_work": money.isNull() | F.col("taken_in_work").eqNullSafe(True),
        "contacted_needs_time": (state != "contacted") | F.col("contacted_at").isNotNull(),
        "work_needs_time": ~F.col("taken_in_work").eqNullSafe(True)
        | F.col("in_work_at").isNotNull(),
    }
    broken = F.array_compact(
        F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()])
    )
    return crm.select("match_id", F.explode(broken).alias("rule"))


# --- reading leads -------------------------------------------------------------------------


def contact_state() -> Column:
    """A lead without a CRM row has not been contacted."""
    return F.coalesce(F.col("crm.contact_state"), F.lit("not_contacted"))


def _funnel_filters() -> dict[str, Column]:
    return {
        "all": F.lit(True),
        "not_contacted": contact_state() == "not_contacted",
        "contacted": contact_state() == "contacted",
        "postponed": contact_state() == "postponed",
        "in_work": F.col("crm.taken_in_work").eqNullSafe(True),
        "no_deal": F.col("crm.taken_in_work").eqNullSafe(False),
    }


def _delivered(matches: DataFrame, crm: DataFrame) -> DataFrame:
    return (
        matches.alias("match")
        .filter(F.col("match.status") == DELIVERED)
        .join(crm.alias("crm"), F.col("crm.match_id") == F.col("match.id"), "left")
    )


def visible_leads(matches: DataFrame, crm: DataFrame, lead_filter: str = "all") -> DataFrame:
    """Delivered, not deleted leads of one funnel slice, as aliases ``match`` and ``crm``."""
    filters = _funnel_filters()
    if lead_filter not in filters:
        raise ValueError(f"unknown lead filter {lead_filter!r}")
    # After the join: in the join condition it would bring deleted leads back as new ones.
    return _delivered(matches, crm).filter(F.col("crm.deleted_at").isNull()).filter(
        filters[lead_filter]
    )


def lead_slices(matches: DataFrame, crm: DataFrame) -> DataFrame:
    """(slice, id): each visible lead once for every funnel slice it is in, from one join."""
    names = [
        F.when(condition, name) for name, condition in _funnel_filters().items() if name != "all"
    ]
    return visible_leads(matches, crm).select(
        F.explode(F.array_compact(F.array(*names))).alias("slice"), F.col("match.id").alias("id")
    )


def slim_leads(
    matches: DataFrame, crm: DataFrame, lead_filter: str = "all", circuit: str | None = None
) -> DataFrame:
    """Lead rows without what the stored item adds: pages are cut from these first."""
    leads = visible_leads(matches, crm, lead_filter)
    if circuit is not None:
        leads = leads.filter(F.col("match.circuit") == circuit)
    return leads.select(
        "match.id",
        "match.raw_item_id",
        "match.headline",
        "match.score",
        "match.intent_tag",
        "match.circuit",
        "match.created_at",
        contact_state().alias("contact_state"),
        "crm.taken_in_work",
        "crm.earnings",
        "crm.currency",
    )


def with_source(page: DataFrame, raw_items: DataFrame) -> DataFrame:
    """A page of ``slim_leads`` (200 rows at most) with the source of each lead's item."""
    named = raw_items.select(F.col("id").alias("raw_item_id"), "source")
    return named.join(F.broadcast(page), "raw_item_id").select(
        "source", *[c for c in page.columns if c != "raw_item_id"]
    )


def lead_rows(
    matches: DataFrame,
    raw_items: DataFrame,
    crm: DataFrame,
    lead_filter: str = "all",
    circuit: str | None = None,
) -> DataFrame:
    """All leads of a slice, with the source of their items."""
    slim = slim_leads(matches, crm, lead_filter, circuit)
    named = raw_items.select(F.col("id").alias("raw_item_id"), "source")
    return slim.join(named, "raw_item_id").drop("raw_item_id")


def with_total(page: DataFrame, rows: DataFrame) -> DataFrame:
    """Add the number of all rows of the slice to each row of a page."""
    return page.withColumn("total", rows.agg(F.count("*")).scalar())


def lead_page(
    rows: DataFrame, limit: int = fixed.PAGE_SIZE, offset: int = 0
) -> DataFrame:
    """One page of ``lead_rows``, newest first, with the total of the slice.

    The rows, which hold no texts, are written once, so that the joins behind them run once.
    """
    if not 1 <= limit <= fixed.MAX_PAGE_SIZE or offset < 0:
        raise ValueError("limit must be 1 to 200 and offset not negative")
    rows = cut_lineage(rows)
    page = rows.orderBy(F.desc("created_at"), F.desc("id")).offset(offset).limit(limit)
    return with_total(page, rows)


def lead_page_after(
    rows: DataFrame, created_at, last_id: int, limit: int = fixed.PAGE_SIZE
) -> DataFrame:
    """The page after a known row: its cost does not grow with the page number."""
    key = F.struct("created_at", "id")
    return (
        rows.filter(key < F.struct(F.lit(created_at).cast("timestamp"), F.lit(last_id).cast("bigint")))
        .orderBy(F.desc("created_at"), F.desc("id"))
        .limit(limit)
    )


def page_with_pinned(rows: DataFrame, pinned_id: int, limit: int = fixed.PAGE_SIZE) -> DataFrame:
    """The first page; a visible lead that is not on it comes first as an extra row."""
    page = rows.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)
    pinned = rows.filter(F.col("id") == pinned_id).join(page.select("id"), "id", "left_anti")
    return (
        pinned.withColumn("place", F.lit(0))
        .unionByName(page.withColumn("place", F.lit(1)))
        .orderBy("place", F.desc("created_at"), F.desc("id"))
    )


def lead_details(matches: DataFrame, raw_items: DataFrame, crm: DataFrame) -> DataFrame:
    """Visible leads with their item and CRM state as nested records."""
    leads = visible_leads(matches, crm).join(
        raw_items.alias("raw"), F.col("raw.id") == F.col("match.raw_item_id")
    )
    own = [c for c in matches.columns if c not in ("raw_item_id", "status", "notified_at")]
    return leads.select(
        *[F.col(f"match.{c}") for c in own],
        F.struct(
            "raw.id",
            "raw.source",
            "raw.author_handle",
            F.col("raw.permalink").alias("url"),
            "raw.title",
            "raw.text",
            "raw.posted_at",
        ).alias("raw_item"),
        F.when(
            F.col("crm.match_id").isNotNull(),
            F.struct(
                "crm.contact_state",
                F.col("crm.reply_text").alias("response_text"),
                "crm.taken_in_work",
                "crm.earnings",
                "crm.currency",
                "crm.contacted_at",
                "crm.in_work_at",
                "crm.updated_at",
            ),
        ).alias("crm"),
    )


def missing_leads(requested: DataFrame, matches: DataFrame, crm: DataFrame) -> DataFrame:
    """Requested lead ids that are unknown, not delivered or deleted."""
    seen = visible_leads(matches, crm).select(F.col("match.id").alias("match_id"))
    return requested.join(seen, "match_id", "left_anti")


def funnel_stats(matches: DataFrame, crm: DataFrame) -> DataFrame:
    """Funnel counts of the delivered leads in one row, from one pass."""
    shown = F.col("crm.deleted_at").isNull()
    filters = _funnel_filters()
    return _delivered(matches, crm).agg(
        F.count_if(shown).alias("total_leads"),
        *[
            F.count_if(shown & condition).alias(name)
            for name, condition in filters.items()
            if name != "all"
        ],
        F.count_if(~shown).alias("removed"),
    )


def earnings_by_currency(crm: DataFrame) -> DataFrame:
    """Sum per currency over all CRM rows, deleted leads included."""
    return (
        crm.filter(F.col("earnings").isNotNull())
        .groupBy("currency")
        .agg(F.sum("earnings").alias("amount"))
        .orderBy("currency")
    )


def favorites(matches: DataFrame, n: int = fixed.FAVORITES_SIZE) -> DataFrame:
    return (
        matches.filter("is_favorite IS TRUE")
        .orderBy(F.desc("created_at"), F.desc("id"))
        .limit(n)
        .select("id", "score", "headline")
    )

