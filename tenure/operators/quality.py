"""Integrity rules as data checks, and the health score built on them.

The data model declares keys, references and value lists; files enforce none
of them, so they are counted here. Each rule reports how many keys or
rows break it.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenure.model import (
    ACCESS_LEVELS,
    ACCOUNT_STATUSES,
    CORE_TABLES,
    LINK_STATUSES,
    ORDER_STATUSES,
    SUBSCRIPTION_STATUSES,
    TRIAL_STATUSES,
    Tables,
)

C = F.col

# The declared rules.
NOT_NULL = {
    "stripe_customers": ("id", "user_id", "customer_id"),
    "stripe_subscriptions": ("id", "customer_id", "status"),
    "stripe_orders": (
        "id",
        "checkout_session_id",
        "payment_intent_id",
        "customer_id",
        "amount_subtotal",
        "amount_total",
        "currency",
        "payment_status",
        "status",
    ),
    "user_trials": (
        "id",
        "user_id",
        "trial_start_date",
        "trial_end_date",
        "trial_status",
        "created_at",
        "updated_at",
    ),
    "user_profiles": ("id", "email"),
    "linked_accounts": ("id", "user_id", "external_user_id", "external_email"),
    "user_account_state": ("user_id", "account_status"),
    "deleted_account_history": ("id", "original_user_id", "email"),
}
ALLOWED = {
    ("stripe_subscriptions", "status"): SUBSCRIPTION_STATUSES,
    ("stripe_orders", "status"): ORDER_STATUSES,
    ("user_trials", "trial_status"): TRIAL_STATUSES,
    ("user_account_state", "account_status"): ACCOUNT_STATUSES,
    ("user_account_state", "access_level"): ACCESS_LEVELS,
    ("linked_accounts", "account_status"): LINK_STATUSES,
}
# Key domains: every (table, column) that holds the key, which of them are
# unique, and which (table, column) refers to which table.
USER_KEY = {
    "users": "user_id",
    "stripe_customers": "user_id",
    "user_trials": "user_id",
    "user_profiles": "id",
    "linked_accounts": "user_id",
    "user_account_state": "user_id",
}
USER_UNIQUE = (
    "users",
    "stripe_customers",
    "user_trials",
    "user_profiles",
    "linked_accounts",
    "user_account_state",
)
USER_REFERENCES = {
    "stripe_customers": "users",
    "user_trials": "users",
    "user_profiles": "users",
    "linked_accounts": "user_profiles",
    "user_account_state": "user_profiles",
}
CUSTOMER_KEY = {"stripe_customers": "customer_id", "stripe_subscriptions": "customer_id"}
CUSTOMER_UNIQUE = ("stripe_customers", "stripe_subscriptions")
CUSTOMER_REFERENCES = {"stripe_subscriptions": "stripe_customers"}
OTHER_UNIQUE = (
    ("stripe_customers", "id"),
    ("stripe_subscriptions", "id"),
    ("stripe_orders", "id"),
    ("user_trials", "id"),
    ("linked_accounts", "id"),
    ("linked_accounts", "external_user_id"),
    ("deleted_account_history", "id"),
    ("deleted_account_history", "email"),
)


Rule = tuple[str, str]


def _inline(rules: dict[Rule, str]) -> str:
    """One (rule, table_name, violations) row per rule, as SQL text."""
    rows = ", ".join(
        f"struct('{rule}' as rule, '{table}' as table_name,"
        f" cast(coalesce({count}, 0) as bigint) as violations)"
        for (rule, table), count in rules.items()
    )
    return f"inline(array({rows}))"


def _row_rules(table: str) -> dict[Rule, str]:
    """Empty and disallowed values of a table, as conditions on a row."""
    rules = {(f"not_null:{c}", table): f"{c} is null" for c in NOT_NULL[table]}
    for (owner, column), values in ALLOWED.items():
        if owner == table:
            listed = ", ".join(f"'{v}'" for v in values)
            rules[f"values:{column}", table] = f"{column} not in ({listed})"
    return rules


def table_profile(t: Tables) -> DataFrame:
    """Per table, in ``v0``, ``v1`` ..., how many rows break each of its row
    rules; a table without rows has no line.

    All tables are read in one stage, each only by the columns its rules name,
    and reduced to one row per task and table before the single shuffle.
    """
    rules = {table: list(_row_rules(table).values()) for table in CORE_TABLES}
    width = max(map(len, rules.values()))
    parts = []
    for table, conditions in rules.items():
        padded = [*conditions, *["cast(null as boolean)"] * (width - len(conditions))]
        broken = [f"{c} as v{i}" for i, c in enumerate(padded)]
        parts.append(getattr(t, table).selectExpr(f"'{table}' as table_name", *broken))
    counts = [F.expr(f"count_if(v{i}) as v{i}") for i in range(width)]
    return reduce(DataFrame.unionByName, parts).groupBy("table_name").agg(*counts)


def row_violations(profile: DataFrame) -> DataFrame:
    """The row rules of every table, also of one without rows."""
    cells = {
        rule: (table, f"v{i}")
        for table in CORE_TABLES
        for i, rule in enumerate(_row_rules(table))
    }
    totals = [
        F.expr(f"sum(case when table_name = '{table}' then {v} end) as {table}_{v}")
        for table, v in cells.values()
    ]
    flat = {rule: f"{table}_{v}" for rule, (table, v) in cells.items()}
    return profile.agg(*totals).selectExpr(_inline(flat))


# Tables whose keys refer to each other share a domain; the others stand alone.
_DOMAINS = {
    "user": (USER_KEY, USER_UNIQUE, USER_REFERENCES),
    "customer": (CUSTOMER_KEY, CUSTOMER_UNIQUE, CUSTOMER_REFERENCES),
    **{f"{table}.{c}": ({table: c}, (table,), {}) for table, c in OTHER_UNIQUE},
}

# Views of live customers beside the live rows of another table; a customer
# with none at all has a row too.
_JOINED = {"user_subscriptions": "stripe_subscriptions", "user_orders": "stripe_orders"}
_HOLDS_ROWS = "holds_rows"


def key_violations(t: Tables, probes: bool = False) -> DataFrame:
    """Repeated keys and missing parents, over all tables and keys at once.

    Every key column is tagged with its domain and table; one grouping by key,
    with partial counts before the shuffle, then shows how often each table
    holds each key. A key with very many rows is reduced where it is read.

    With ``probes``, the same grouping also tells for each view of customers
    and their rows, without joining them, how many customers it shows, as rule
    ``holds_rows``.
    """
    rules: dict[Rule, str] = {}
    for domain, (columns, unique, references) in _DOMAINS.items():
        here = f"domain = '{domain}' and key is not null"
        for table in unique:
            rules[f"unique:{columns[table]}", table] = f"count_if({here} and {table} > 1)"
        for child, parent in references.items():
            orphans = f"sum(case when {here} and {parent} = 0 then {child} end)"
            rules[f"reference:{columns[child]}", child] = orphans
    if probes:
        for view, table in _JOINED.items():
            shown = f"(key is null or {table} = 0 or live_{table} > 0)"
            rules[_HOLDS_ROWS, view] = (
                f"count_if(domain = 'customer' and live_stripe_customers > 0 and {shown})"
            )
    names = {rule: f"v{i}" for i, rule in enumerate(rules)}
    per_key = _rows_per_key(t, probes)
    totals = per_key.agg(*[F.expr(f"{rules[rule]} as {name}") for rule, name in names.items()])
    return totals.selectExpr(_inline(names))


def _rows_per_key(t: Tables, probes: bool = False) -> DataFrame:
    """How many rows each table holds of each domain's key."""
    holders = {domain: dict(columns) for domain, (columns, _, _) in _DOMAINS.items()}
    if probes:
        holders["customer"] |= dict.fromkeys(_JOINED.values(), "customer_id")
    tagged = []
    for domain, columns in holders.items():
        live = "deleted_at is null" if probes and domain == "customer" else "true"
        tagged += [
            getattr(t, table).selectExpr(
                f"'{domain}' as domain",
                f"cast({column} as string) as key",
                f"'{table}' as src",
                f"{live} as live",
            )
            for table, column in columns.items()
        ]
    tables = dict.fromkeys(table for columns in holders.values() for table in columns)
    counts = {table: f"count_if(src = '{table}')" for table in tables}
    if probes:
        lasting = ("stripe_customers", *_JOINED.values())
        counts |= {f"live_{x}": f"count_if(src = '{x}' and live)" for x in lasting}
    return (
        reduce(DataFrame.unionByName, tagged)
        .groupBy("domain", "key")
        .agg(*[F.expr(f"{count} as {name}") for name, count in counts.items()])
    )


# What names a row of each table.
_ROW_KEY = {
    table: "user_id" if table == "user_account_state" else "id" for table in CORE_TABLES
}


def _broken(rules: list[tuple[str, str, str, str]]) -> str:
    """One (rule, table_name, rows) row per rule (name, table, condition, rows) that a
    row breaks, as SQL text."""
    told = ", ".join(
        f"struct('{rule}' as rule, '{table}' as table_name, cast({rows} as bigint) as rows,"
        f" {condition} as broken)"
        for rule, table, condition, rows in rules
    )
    return f"inline(filter(array({told}), x -> x.broken))"


def offending_keys(t: Tables) -> DataFrame:
    """(rule, table_name, key, rows): which keys break a rule, and by how many rows.

    A repeated key is named once with all its rows, a missing parent with the rows that
    refer to it, and a row with an empty or disallowed value by its table's own key.
    Their numbers are those of ``constraint_violations``. Sound rows of the row rules are
    dropped where they are read; key rules take the one grouping by key.
    """
    parts = []
    for table in CORE_TABLES:
        rules = [(rule, table, condition, "1") for (rule, _), condition in _row_rules(table).items()]
        key = f"cast({_ROW_KEY[table]} as string) as key"
        parts.append(getattr(t, table).selectExpr(key, _broken(rules)))
    rows = reduce(DataFrame.unionByName, parts).drop("broken")
    by_row = rows.groupBy("rule", "table_name", "key").agg(F.sum("rows").alias("rows"))
    rules = []
    for domain, (columns, unique, references) in _DOMAINS.items():
        here = f"domain = '{domain}'"
        for table in unique:
            rules.append((f"unique:{columns[table]}", table, f"{here} and {table} > 1", table))
        for child, parent in references.items():
            missing = f"{here} and {parent} = 0 and {child} > 0"
            rules.append((f"reference:{columns[child]}", child, missing, child))
    per_key = _rows_per_key(t).filter("key is not null")
    return by_row.unionByName(per_key.selectExpr("key", _broken(rules)).drop("broken"))


def constraint_violations(t: Tables) -> DataFrame:
    """(rule, table_name, violations) for every declared rule."""
    return row_violations(table_profile(t)).unionByName(key_violations(t))


# Health ---------------------------------------------------------------------

# The grade from the share of points reached.
GRADES = (("excellent", Decimal("1.0")), ("good", Decimal("0.8")), ("fair", Decimal("0.6")))
LOWEST_GRADE = "poor"
CRITICAL_VIEWS = ("trial_info", "access_status", "user_subscriptions")


# Views that hold one row per row of the table that drives them.
_DRIVEN = {
    "trial_info": "user_trials",
    "access_status": "user_trials",
    "user_overview": "user_profiles",
}


def health_checks(t: Tables) -> DataFrame:
    """(kind, name, ok): each table and view holds rows, each table is sound."""
    profile = table_profile(t)
    held = profile.agg(
        *[F.expr(f"bool_or(table_name = '{table}') as {table}") for table in CORE_TABLES]
    )
    found = {("table", table): table for table in CORE_TABLES}
    found |= {("view", view): table for view, table in _DRIVEN.items()}
    rows = ", ".join(
        f"struct('{kind}' as kind, '{name}' as name, coalesce({table}, false) as ok)"
        for (kind, name), table in found.items()
    )
    tables = held.selectExpr(f"inline(array({rows}))")
    # The sign-in platform's table has rules but no place in the score.
    counted = (
        row_violations(profile)
        .unionByName(key_violations(t, probes=True))
        .filter(C("table_name") != "users")
    )
    is_view = C("rule") == _HOLDS_ROWS
    others = (
        counted.groupBy(
            F.when(is_view, "view").otherwise("rules").alias("kind"), C("table_name").alias("name")
        )
        .agg(F.sum("violations").alias("n"))
        .select("kind", "name", ((C("n") == 0) != (C("kind") == "view")).alias("ok"))
    )
    return tables.unionByName(others)


def grade(score: Column, max_score: Column) -> Column:
    result = F.lit(LOWEST_GRADE)
    for name, share in reversed(GRADES):
        result = F.when(score >= max_score * F.lit(share), F.lit(name)).otherwise(result)
    return result


def health_score(t: Tables) -> DataFrame:
    """One row: points, share of points, grade, and whether tables and the
    views that access depends on all hold rows."""
    needed = (C("kind") == "table") | (
        (C("kind") == "view") & C("name").isin(*CRITICAL_VIEWS)
    )
    totals = health_checks(t).agg(
        F.count_if(C("ok")).alias("score"),
        F.count(F.lit(1)).alias("max_score"),
        F.bool_and(F.when(needed, C("ok"))).alias("healthy"),
    )
    share = C("score").cast("decimal(20,0)") / C("max_score").cast("decimal(20,0)") * 100
    return totals.select(
        "score",
        "max_score",
        F.round(share, 2).cast("decimal(5,2)").alias("percentage"),
        grade(C("score"), C("max_score")).alias("grade"),
        "healthy",
    )
