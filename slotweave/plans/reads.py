"""Sources, sinks, layouts, filters, sorts and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotweave.operators import filters as Fi
from slotweave.operators import parse, topk
from slotweave.operators.latest import upsert_accounts, upsert_latest
from slotweave.plans.oracle_views import oracle
from slotweave.plans.registry import ORACLES, query
from slotweave.session import work_path
from slotweave.sources import rpc, tables
from slotweave.sources.tiers import TieredTable

ACCOUNT = "pubkey, owner, lamports, slot, write_version, executable, is_startup"
PROGRAM, ACCOUNT_KEY = "Brand#13", "supp7"
LATEST = """
    SELECT * FROM v_account_updates
    QUALIFY row_number() OVER (PARTITION BY pubkey ORDER BY slot DESC, write_version DESC, seq DESC) = 1"""


def _cols(df, names=ACCOUNT):
    cols = [c.strip() for c in names.split(",")]
    return df.select(*[F.col(c).cast("bigint") if t.startswith("decimal") else F.col(c) for c, t in df.select(*cols).dtypes])


def _accounts(v):
    return tables.normalize_versions("accounts", v.account_updates)


# --- sources, sinks, layouts ----------------------------------------------------------------------


@query("s1_read_table", oracle("v_account_updates", f"SELECT {ACCOUNT} FROM v_account_updates"))
def read_table(v):
    path = work_path(v.spark, "accounts")
    tables.write_table(_accounts(v), path)
    return _cols(tables.read_table(v.spark, "accounts", path))


@query(
    "s2_write_table",
    oracle("v_account_updates", """
        SELECT owner, count(*) AS n, CAST(sum(lamports) AS BIGINT) AS lamports, count(DISTINCT pubkey) AS keys
        FROM v_account_updates GROUP BY owner"""),
)
def write_table(v):
    path = work_path(v.spark, "sink")
    tables.write_table(_accounts(v), path, compression="snappy", max_records=1000, max_file_mb=128)
    rows = tables.read_table(v.spark, "accounts", path)
    return rows.groupBy("owner").agg(
        F.count("*").alias("n"), F.sum("lamports").cast("bigint").alias("lamports"), F.countDistinct("pubkey").alias("keys")
    )


@query(
    "s3_slot_bucket_range",
    oracle("v_account_updates", f"SELECT {ACCOUNT} FROM v_account_updates WHERE slot BETWEEN 23 AND 58"),
)
def slot_bucket_range(v):
    path = work_path(v.spark, "bucketed")
    tables.write_bucketed(_accounts(v), path, width=10)
    return _cols(tables.read_bucketed(v.spark, "accounts", path, 23, 58, width=10))


@query(
    "s4_table_definitions",
    oracle("v_transactions", """
        SELECT signature, slot, idx, is_vote, err IS NULL AS success, fee, len(accounts) AS accounts,
               len(instructions) AS instructions
        FROM v_transactions"""),
)
def table_definitions(v):
    path = work_path(v.spark, "transactions")
    tables.write_table(tables.normalize_versions("transactions", v.transactions), path)
    return tables.read_table(v.spark, "transactions", path).select(
        "signature", "slot", "idx", "is_vote", F.col("err").isNull().alias("success"), F.col("fee").cast("bigint").alias("fee"),
        F.array_size("accounts").cast("bigint").alias("accounts"), F.array_size("instructions").cast("bigint").alias("instructions"),
    )


RPC_STATUS = """CASE WHEN NOT json_valid(body) THEN 'invalid'
    WHEN json_exists(body, '$.error') THEN 'error'
    WHEN NOT json_exists(body, '$.result') THEN 'missing_result'
    WHEN json_type(body, '$.result') = 'NULL' THEN 'not_found' ELSE 'ok' END"""


@query(
    "s5_read_rpc_json",
    oracle("v_account_rpc", f"SELECT {RPC_STATUS} AS rpc_status, count(*) AS n FROM v_account_rpc GROUP BY 1"),
)
def read_rpc_json(v):
    path = work_path(v.spark, "rpc")
    v.account_rpc.select("body").write.text(path)
    routed = parse.route_rpc(rpc.read_rpc_json(v.spark, path))
    return routed.groupBy("rpc_status").agg(F.count("*").alias("n"))


@query(
    "s6_export_json",
    oracle("v_watchlist", """
        SELECT '{"id":"' || id || '","type":"' || type || '","pubkey":"' || pubkey || '","added":' || added
               || ',"exportedAt":"2024-01-31T00:00:00Z"}' AS value
        FROM v_watchlist"""),
)
def export_json(v):
    path = work_path(v.spark, "export")
    rpc.export_json(v.watchlist.drop("name"), path, "2024-01-31T00:00:00Z")
    return v.spark.read.text(path)


@query(
    "s7_read_tables",
    oracle("v_account_updates v_blocks", """
        SELECT 'accounts' AS kind, count(*) AS rows, max(slot) AS max_slot FROM v_account_updates
        UNION ALL SELECT 'blocks', count(*), max(slot) FROM v_blocks"""),
)
def read_tables(v):
    root = work_path(v.spark, "tables")
    tables.write_table(_accounts(v), f"{root}/accounts")
    tables.write_table(tables.normalize_versions("blocks", v.blocks), f"{root}/blocks")
    feeds = tables.read_tables(v.spark, root, "accounts,blocks", {"accounts": ["*"]})
    parts = [df.select(F.lit(n).alias("kind"), "slot") for n, df in feeds.items()]
    both = parts[0].unionByName(parts[1])
    return both.groupBy("kind").agg(F.count("*").alias("rows"), F.max("slot").alias("max_slot"))


@query(
    "s8_hot_cold",
    oracle("v_account_updates", """
        SELECT pubkey, lamports, slot, write_version FROM hot
        UNION ALL SELECT pubkey, lamports, slot, write_version FROM cold WHERE pubkey NOT IN (SELECT pubkey FROM hot)""",
        hot="""SELECT * FROM v_account_updates WHERE slot >= 90
               QUALIFY row_number() OVER (PARTITION BY pubkey ORDER BY slot DESC, write_version DESC, seq DESC) = 1""",
        cold="""SELECT * FROM v_account_updates WHERE slot < 90
               QUALIFY row_number() OVER (PARTITION BY pubkey ORDER BY slot DESC, write_version DESC, seq DESC) = 1"""),
)
def hot_cold(v):
    hot, cold = tables.split_hot_cold(v.account_updates, 90)
    merged = tables.read_hot_cold(upsert_accounts(None, hot), upsert_accounts(None, cold), "pubkey")
    return merged.select("pubkey", "lamports", "slot", "write_version")


@query("s8_moving_cut", oracle("v_account_updates", "SELECT pubkey, lamports, slot, write_version, seq FROM v_account_updates"))
def moving_cut(v):
    """Rows come in while the cut between the hot and the cold store moves over them, some behind it."""
    rows = v.account_updates.select("pubkey", "lamports", "slot", "write_version", "seq")
    table = TieredTable(v.spark, work_path(v.spark, "hot"), work_path(v.spark, "cold"), rows.schema, width=10)
    for k, slot in enumerate((25, 60, 40)):
        table.append(rows.filter(F.col("seq") % 3 == k))
        table.move(slot)
    return table.read()


# --- filters ------------------------------------------------------------------------------------------


@query(
    "f1_select_accounts",
    oracle("v_account_updates", """
        SELECT seq, pubkey, owner FROM v_account_updates
        WHERE pubkey IN ('acct3', 'acct9', 'acct77') OR owner IN ('purchase')"""),
)
def select_accounts(v):
    return Fi.select_accounts(v.account_updates, ["acct3", "acct9", "acct77"], ["purchase"]).select("seq", "pubkey", "owner")


@query(
    "f1_select_accounts_long_list",
    oracle("v_account_updates", """
        SELECT seq, pubkey, owner FROM v_account_updates
        WHERE CAST(substr(pubkey, 5) AS BIGINT) % 2 = 0 OR owner = 'signup'"""),
)
def select_accounts_long(v):
    keys = [f"acct{i}" for i in range(0, 4000, 2)]
    return Fi.select_accounts(v.account_updates, keys, ["signup"]).select("seq", "pubkey", "owner")


@query(
    "f2_select_transactions",
    oracle("v_transactions", """
        SELECT signature, slot, is_vote FROM v_transactions
        WHERE is_vote OR list_has_any(accounts, ['supp7', 'cust11'])"""),
)
def select_transactions(v):
    return Fi.select_transactions(v.transactions, ["supp7", "cust11"], include_votes=True).select("signature", "slot", "is_vote")


@query("f2_all_votes", oracle("v_transactions", "SELECT signature, slot FROM v_transactions WHERE is_vote"))
def all_votes(v):
    return Fi.select_transactions(v.transactions, ["all_votes"]).select("signature", "slot")


@query(
    "f3_filter_account_updates",
    oracle("v_account_updates", """
        SELECT seq, pubkey, lamports FROM v_account_updates WHERE pubkey IN ('acct1', 'acct5') AND owner = 'click'"""),
)
def filter_account_updates(v):
    return Fi.filter_account_updates(v.account_updates, "acct1,acct5", "click").select("seq", "pubkey", "lamports")


@query(
    "f4_filter_transaction_updates",
    oracle("v_transactions", f"""
        SELECT signature, slot, fee FROM v_transactions
        WHERE list_contains(program_ids, '{PROGRAM}') AND list_contains(accounts, '{ACCOUNT_KEY}')"""),
)
def filter_transaction_updates(v):
    return Fi.filter_transaction_updates(v.transactions, PROGRAM, ACCOUNT_KEY).select("signature", "slot", "fee")


@query(
    "f5_accounts_by_program",
    oracle("v_account_updates", """
        SELECT pubkey, lamports, slot FROM cur WHERE owner = 'view' ORDER BY pubkey LIMIT 10""", cur=LATEST),
)
def accounts_by_program(v):
    current = upsert_accounts(None, v.account_updates)
    return Fi.accounts_by_program(current, "view", 10).select("pubkey", "lamports", "slot")


@query(
    "f6_slot_range",
    oracle("v_account_updates", """
        SELECT pubkey, slot, write_version, seq FROM v_account_updates WHERE slot BETWEEN 10 AND 40"""),
)
def slot_range(v):
    return Fi.slot_range(v.account_updates, 10, 40).select("pubkey", "slot", "write_version", "seq")


@query("f7_get_account", oracle("v_account_updates", f"SELECT {ACCOUNT} FROM cur WHERE pubkey = 'acct42'", cur=LATEST))
def get_account(v):
    # the key predicate goes below the aggregation, so only one key's versions are read
    return _cols(Fi.get_by_key(upsert_accounts(None, v.account_updates), "pubkey", "acct42"))


@query("f7_get_transaction", oracle("v_transactions", """
    SELECT signature, slot, fee, array_to_string(accounts, ',') AS accounts FROM v_transactions WHERE signature = 'sig77'"""))
def get_transaction(v):
    return Fi.get_by_key(v.transactions, "signature", "sig77").select(
        "signature", "slot", "fee", F.array_join("accounts", ",").alias("accounts")
    )


@query("f7_get_block", oracle("v_blocks", "SELECT slot, blockhash, transaction_count FROM v_blocks WHERE slot = 41"))
def get_block(v):
    return Fi.get_by_key(v.blocks, "slot", 41).select("slot", "blockhash", "transaction_count")


@query(
    "f8_is_recent",
    oracle("v_account_updates", """
        SELECT seq, pubkey FROM v_account_updates
        WHERE greatest(1706000000 - CAST(floor(epoch(updated_at)) AS BIGINT), 0) <= 86400"""),
)
def is_recent(v):
    rows = v.account_updates.withColumn("seconds", F.unix_timestamp("updated_at"))
    return Fi.recent_rows(rows, "seconds", 86400, 1706000000).select("seq", "pubkey")


@query(
    "f9_min_stake_filter",
    oracle("v_operators", """
        SELECT operator, stake, stake >= 1000000000 AS accepted,
               CASE WHEN stake < 1000000000 THEN 'stake below minimum' END AS reason
        FROM v_operators"""),
)
def min_stake_filter(v):
    return Fi.min_stake_filter(v.operators.select("operator", "stake"), 1_000_000_000)


@query("f10_active_operators", oracle("v_operators", "SELECT operator, stake FROM v_operators WHERE is_active"))
def active_operators(v):
    return Fi.active_operators(v.operators).select("operator", "stake")


@query(
    "f11_split_startup",
    oracle("v_account_updates", """
        SELECT CASE WHEN is_startup THEN 'startup' ELSE 'live' END AS part, count(*) AS n, CAST(sum(lamports) AS BIGINT) AS lamports
        FROM v_account_updates GROUP BY 1"""),
)
def split_startup(v):
    startup, live = Fi.split_startup(v.account_updates)
    both = startup.withColumn("part", F.lit("startup")).unionByName(live.withColumn("part", F.lit("live")))
    return both.groupBy("part").agg(F.count("*").alias("n"), F.sum("lamports").alias("lamports"))


@query(
    "f12_check_uptime",
    oracle("v_operators", "SELECT operator, uptime_pct / 100 AS uptime, uptime_pct / 100 >= 0.75 AS uptime_ok FROM v_operators"),
)
def check_uptime(v):
    rows = v.operators.select("operator", (F.col("uptime_pct") / 100).alias("uptime"))
    return Fi.check_uptime(rows, 0.75)


@query(
    "f13_relevant_to_program",
    oracle("v_transactions", """
        SELECT signature, slot FROM v_transactions
        WHERE list_contains(program_ids, 'Brand#2') OR list_contains(accounts, 'Brand#2')"""),
)
def relevant_to_program(v):
    return Fi.relevant_to_program(v.transactions, "Brand#2").select("signature", "slot")


# --- sorts, limits, top-k -----------------------------------------------------------------------------


@query(
    "l1_recent_accounts",
    oracle("v_account_updates", """
        SELECT pubkey, seq, CAST(floor(epoch(updated_at)) AS BIGINT) AS updated FROM cur
        ORDER BY updated_at DESC, pubkey LIMIT 50""",
        cur="SELECT * FROM v_account_updates QUALIFY row_number() OVER (PARTITION BY pubkey ORDER BY seq DESC) = 1"),
)
def recent_accounts(v):
    current = upsert_latest(None, v.account_updates, "pubkey")
    return topk.recent(current, 50).select("pubkey", "seq", F.unix_timestamp("updated_at").alias("updated"))


@query(
    "l2_slot_range_ordered",
    oracle("v_account_updates", """
        SELECT pubkey, slot, write_version, seq FROM v_account_updates WHERE slot BETWEEN 30 AND 60
        ORDER BY slot, write_version, seq LIMIT 200"""),
)
def slot_range_ordered(v):
    rows = Fi.slot_range(v.account_updates, 30, 60, 200, ["slot", "write_version", "seq"])
    return rows.select("pubkey", "slot", "write_version", "seq")


@query(
    "l3_recent_transactions",
    oracle("v_transactions", "SELECT signature, slot, idx, fee FROM v_transactions ORDER BY slot DESC, idx DESC LIMIT 25"),
)
def recent_transactions(v):
    return topk.recent_transactions(v.transactions, 25).select("signature", "slot", "idx", "fee")


@query(
    "l4_latest_block",
    oracle("v_blocks", """
        SELECT slot, parent_slot, blockhash, block_time, transaction_count, leader FROM v_blocks ORDER BY slot DESC LIMIT 1"""),
)
def latest_block(v):
    return topk.latest_block(v.blocks).select("slot", "parent_slot", "blockhash", "block_time", "transaction_count", "leader")


@query(
    "l5_sort_watchlist",
    oracle("v_watchlist", """
        SELECT id, type, pubkey, name, coalesce(name, pubkey) AS sort_key FROM v_watchlist
        ORDER BY coalesce(name, pubkey), id"""),
)
def sort_watchlist(v):
    rows = topk.sort_watchlist(v.watchlist, "name", "asc")
    return rows.select("id", "type", "pubkey", "name", F.coalesce("name", "pubkey").alias("sort_key"))


@query(
    "l6_largest_accounts",
    oracle("v_account_updates", "SELECT pubkey, lamports FROM cur ORDER BY lamports DESC, pubkey LIMIT 5", cur=LATEST),
)
def largest_accounts(v):
    return topk.largest_accounts(upsert_accounts(None, v.account_updates)).select("pubkey", "lamports")


@query(
    "l7_page",
    oracle("v_blocks", """
        SELECT slot, blockhash, transaction_count FROM v_blocks WHERE slot < 90 AND slot > 5 ORDER BY slot DESC LIMIT 40"""),
)
def page(v):
    return topk.page(v.blocks, "slot", 40, before=90, after=5).select("slot", "blockhash", "transaction_count")


MINE = f"list_contains(program_ids, '{PROGRAM}') OR list_contains(accounts, '{PROGRAM}')"
# Instruction codes, as in slotweave.functions.scalars.
TYPE_NAMES = """CASE substr(f.data, 1, 8)
    WHEN '01000000' THEN 'Swap' WHEN '02000000' THEN 'Deposit' WHEN '03000000' THEN 'Withdraw'
    WHEN '04000000' THEN 'Create Position' WHEN '05000000' THEN 'Create Pool' WHEN '06000000' THEN 'Close Position'
    WHEN '07000000' THEN 'Collect Fees' WHEN '08000000' THEN 'Update Fees' ELSE 'Unknown Instruction' END"""


def type_sql(program: str) -> str:
    """Transactions with ``type``; ``f`` is the first instruction of the program."""
    return f"""SELECT *, CASE WHEN len(instructions) = 0 THEN 'Unknown' WHEN f IS NULL THEN 'Other' ELSE {TYPE_NAMES} END AS type
        FROM (SELECT *, list_filter(instructions, lambda i: i.program_id = '{program}')[1] AS f FROM v_transactions)"""


@query(
    "l8_tracker_view",
    oracle("v_transactions", f"""
        SELECT signature, slot, type AS instruction_type,
               row_number() OVER (ORDER BY slot DESC, idx DESC) <= 20 AS shown
        FROM typed WHERE {MINE} ORDER BY slot DESC, idx DESC LIMIT 100""", typed=type_sql(PROGRAM)),
)
def tracker_view(v):
    return topk.tracker_view(v.transactions, PROGRAM).select("signature", "slot", "instruction_type", "shown")


STORED: dict[tuple[str, str], str] = {}


def stored_transactions(v) -> str:
    """The transactions as a table of slot buckets, written once for each session and data folder."""
    key = (v.spark.sparkContext.applicationId, v.sf_dir)
    if key not in STORED:
        path = work_path(v.spark, "transactions")
        tables.write_bucketed(v.transactions, path, width=50)
        STORED[key] = path
    return STORED[key]


@query("l3_newest_stored", ORACLES["l3_recent_transactions"])
def newest_stored(v):
    path = stored_transactions(v)
    return tables.read_newest(v.spark, v.transactions.schema, path, 25).select("signature", "slot", "idx", "fee")


@query("l8_tracker_stored", ORACLES["l8_tracker_view"])
def tracker_stored(v):
    """The tracker on a stored table: only the newest buckets that hold 100 transactions of the program are read."""
    newest = tables.read_newest(v.spark, v.transactions.schema, stored_transactions(v), 100, where=topk.mentions(PROGRAM))
    return topk.tracker_view(newest, PROGRAM).select("signature", "slot", "instruction_type", "shown")


# --- latest state ---------------------------------------------------------------------------------------


@query("u1_upsert_accounts", oracle("v_account_updates", f"SELECT {ACCOUNT}, seq FROM cur", cur=LATEST))
def upsert(v):
    snapshot, live = Fi.split_startup(v.account_updates)
    return upsert_accounts(snapshot, live).select(*[c.strip() for c in ACCOUNT.split(",")], "seq")


@query(
    "u1_upsert_accounts_arrival",
    oracle("v_account_updates", """
        SELECT pubkey, lamports, slot, seq FROM v_account_updates
        QUALIFY row_number() OVER (PARTITION BY pubkey ORDER BY slot DESC, seq DESC) = 1"""),
)
def upsert_arrival(v):
    return upsert_accounts(None, v.account_updates, tie="arrival").select("pubkey", "lamports", "slot", "seq")


@query(
    "u2_upsert_latest",
    oracle("v_slot_messages", """
        SELECT slot, seq, kind FROM v_slot_messages QUALIFY row_number() OVER (PARTITION BY slot ORDER BY seq DESC) = 1"""),
)
def upsert_slots(v):
    return upsert_latest(None, v.slot_messages, "slot").select("slot", "seq", "kind")


