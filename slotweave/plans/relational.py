"""Lookups, aggregations, ordered state and staking."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotweave.functions.scalars import probe_status, tx_success
from slotweave.operators import lookups as K
from slotweave.operators import ordered as O
from slotweave.operators import staking as St
from slotweave.operators import stats as A
from slotweave.operators import topk
from slotweave.operators.assembly import assemble_blocks, evict_rooted
from slotweave.operators.index import read_by_key, write_index
from slotweave.operators.latest import last_votes, latest_by, latest_metrics, operator_status, upsert_accounts
from slotweave.plans.oracle_views import oracle
from slotweave.plans.reads import ACCOUNT_KEY, LATEST, MINE, PROGRAM, type_sql
from slotweave.plans.registry import ORACLES, query
from slotweave.session import work_path

MIN_STAKE = 1_000_000_000
STAKE_MIN, STAKE_CAP = 1_200_000, 2_000_000_000

# --- lookups --------------------------------------------------------------------------------------------


@query(
    "k1_transactions_by_program",
    oracle("v_transactions", f"""
        SELECT signature, slot, fee FROM v_transactions WHERE list_contains(program_ids, '{PROGRAM}')
        ORDER BY slot DESC, idx DESC LIMIT 100"""),
)
def by_program(v):
    return K.transactions_by_program(v.transactions, PROGRAM, 100).select("signature", "slot", "fee")


@query(
    "k2_transactions_by_account",
    oracle("v_transactions", f"""
        SELECT signature, slot, fee FROM v_transactions WHERE list_contains(accounts, '{ACCOUNT_KEY}')
        ORDER BY slot DESC, idx DESC LIMIT 10"""),
)
def by_account(v):
    return K.transactions_by_account(v.transactions, ACCOUNT_KEY).select("signature", "slot", "fee")


@query("k1_index_by_program", oracle("v_transactions", f"""
    SELECT signature, slot FROM v_transactions WHERE list_contains(program_ids, '{PROGRAM}') ORDER BY slot DESC, idx DESC LIMIT 1000"""))
def program_index(v):
    path = work_path(v.spark, "program-index")
    write_index(v.transactions, "program_ids", path, buckets=16)
    return read_by_key(v.spark, path, PROGRAM, 1000, buckets=16).select("signature", "slot")


INDEXES: dict[tuple[str, str], str] = {}


@query("k1_lookup_stored", ORACLES["k1_index_by_program"])
def stored_lookup(v):
    """A lookup in an index that is there: it is built once for each session and data folder."""
    key = (v.spark.sparkContext.applicationId, v.sf_dir)
    if key not in INDEXES:
        path = work_path(v.spark, "stored-index")
        write_index(v.transactions, "program_ids", path, buckets=16)
        INDEXES[key] = path
    return read_by_key(v.spark, INDEXES[key], PROGRAM, 1000, buckets=16).select("signature", "slot")


@query("k2_index_by_account", oracle("v_transactions", f"""
    SELECT signature, slot FROM v_transactions WHERE list_contains(accounts, '{ACCOUNT_KEY}') ORDER BY slot DESC, idx DESC LIMIT 1000"""))
def account_index(v):
    path = work_path(v.spark, "account-index")
    for half in (0, 1, 0):  # taken in as slots come; one comes twice
        write_index(v.transactions.filter(F.col("slot") % 2 == half), "accounts", path, buckets=16)
    return read_by_key(v.spark, path, ACCOUNT_KEY, 1000, buckets=16).select("signature", "slot")


@query(
    "k3_build_mentions",
    oracle("v_transactions", """
        SELECT signature, unnest(accounts) AS pubkey, generate_subscripts(accounts, 1) = 1 AS is_signer, true AS is_writable
        FROM v_transactions"""),
)
def mentions(v):
    return K.build_mentions(v.transactions)


@query(
    "k4_cascade_mentions",
    oracle("v_transactions", """
        SELECT CASE WHEN err IS NULL THEN 'kept' ELSE 'dropped' END AS part, count(*) AS n, count(DISTINCT pubkey) AS keys
        FROM (SELECT signature, err, unnest(accounts) AS pubkey FROM v_transactions) GROUP BY 1"""),
)
def cascade(v):
    # dealt by signature before mentions are made: the joins find these in place, and their flags are not shuffled
    m = K.build_mentions(v.transactions.select("signature", "accounts").repartition("signature"))
    stored = v.transactions.filter(tx_success("err"))
    kept = K.cascade_mentions(m, stored).withColumn("part", F.lit("kept"))
    gone = K.orphan_mentions(m, stored).withColumn("part", F.lit("dropped"))
    return kept.unionByName(gone).groupBy("part").agg(F.count("*").alias("n"), F.countDistinct("pubkey").alias("keys"))


@query(
    "k5_enrich_watchlist",
    oracle("v_account_updates v_transactions v_token_balances v_watchlist", """
        SELECT id, type, pubkey, lamports, slot, tokens, coalesce(lamports, slot, tokens) IS NULL AS error,
               CASE WHEN type = 'account' AND lamports > 0 THEN
                        format('{:,}', lamports // 1000000000) || '.' || CASE WHEN length(rtrim(frac, '0')) < 4
                            THEN substr(frac, 1, 4) ELSE rtrim(frac, '0') END || ' SOL'
                    WHEN type = 'transaction' AND slot > 0 THEN 'Slot: ' || slot
                    WHEN type = 'token' AND tokens IS NOT NULL THEN tokens || ' tokens' ELSE 'No data' END AS key_data
        FROM (SELECT w.*, a.lamports, lpad(CAST(a.lamports % 1000000000 AS VARCHAR), 9, '0') AS frac, t.slot, k.tokens
              FROM v_watchlist w
              LEFT JOIN cur a ON w.type = 'account' AND w.pubkey = a.pubkey
              LEFT JOIN v_transactions t ON w.type = 'transaction' AND w.pubkey = t.signature
              LEFT JOIN (SELECT owner, count(*) AS tokens FROM v_token_balances GROUP BY owner) k
                ON w.type = 'token' AND w.pubkey = k.owner)""", cur=LATEST),
)
def watch(v):
    watched = v.watchlist.select("pubkey").distinct()
    current = upsert_accounts(None, v.account_updates.join(watched, "pubkey", "left_semi"))
    rows = K.enrich_watchlist(v.watchlist, current, v.transactions, v.token_balances)
    return rows.select("id", "type", "pubkey", "lamports", "slot", "tokens", "error", "key_data")


@query(
    "k6_with_operator_stake",
    oracle("v_messages v_operators", """
        SELECT m.seq, m.source, coalesce(o.stake, 0) AS stake FROM v_messages m LEFT JOIN v_operators o ON m.source = o.operator"""),
)
def operator_stakes(v):
    return K.with_operator_stake(v.messages, v.operators, "source").select("seq", "source", "stake")


VOTED = """SELECT block_hash, CAST(sum(coalesce(stake, 0)) AS BIGINT) AS vote_stake, count(*) AS voters
    FROM (SELECT DISTINCT block_hash, validator FROM v_votes) LEFT JOIN v_operators ON validator = operator
    GROUP BY block_hash"""


@query("k7_vote_stake", oracle("v_votes v_operators", VOTED))
def vote_stake(v):
    return K.vote_stake(v.votes, v.operators)


@query(
    "k8_admit_messages",
    oracle("v_messages v_operators", f"""
        SELECT message_id, source, seq, stake, CAST(floor(log10(stake)) AS BIGINT) AS priority
        FROM v_messages JOIN v_operators ON source = operator WHERE stake >= {MIN_STAKE}
        QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY seq) = 1"""),
)
def admit(v):
    rows = K.admit_messages(v.messages.select("message_id", "source", "seq"), v.operators, MIN_STAKE)
    return rows.select("message_id", "source", "seq", "stake", "priority")


LAST_MULTIPLIER = """SELECT operator AS op, multiplier FROM v_multipliers
    QUALIFY row_number() OVER (PARTITION BY operator ORDER BY seq DESC) = 1"""
REWARD = "CAST(floor(CAST(0.1 AS DOUBLE) * score * coalesce(multiplier, 1.0)) AS BIGINT)"


@query(
    "k9_reward_multipliers",
    oracle("v_scores v_multipliers", """
        SELECT seq, operator, score, coalesce(multiplier, 1.0)::DOUBLE AS multiplier FROM v_scores LEFT JOIN m ON operator = op""",
        m=LAST_MULTIPLIER),
)
def multipliers(v):
    return K.reward_multipliers(v.scores, v.multipliers).select("seq", "operator", "score", "multiplier")


@query(
    "k10_chain_link_check",
    oracle("v_blocks", """
        SELECT b.slot, b.parent_slot, p.slot IS NOT NULL AS parent_found, coalesce(p.blockhash = b.parent_blockhash, false) AS hash_ok,
               coalesce(b.block_height = p.block_height + 1, false) AS height_ok
        FROM v_blocks b LEFT JOIN v_blocks p ON b.parent_slot = p.slot"""),
)
def chain_links(v):
    return K.chain_link_check(v.blocks)


@query(
    "k11_contiguous_blocks",
    oracle("v_blocks", """
        SELECT s.slot, b.blockhash, b.transaction_count
        FROM (SELECT unnest(generate_series(greatest(max(slot) - 79, 0), max(slot))) AS slot FROM v_blocks) s
        LEFT JOIN v_blocks b ON s.slot = b.slot"""),
)
def contiguous(v):
    return K.contiguous_blocks(v.blocks, 80, show_gaps=True).select("slot", "blockhash", "transaction_count")


# --- aggregations ----------------------------------------------------------------------------------------


@query(
    "a1_table_counts",
    oracle("v_account_updates v_transactions v_blocks", """
        SELECT 'accounts' AS kind, count(*) AS rows FROM v_account_updates UNION ALL
        SELECT 'transactions', count(*) FROM v_transactions UNION ALL SELECT 'blocks', count(*) FROM v_blocks"""),
)
def counts(v):
    return A.table_counts({"accounts": v.account_updates, "transactions": v.transactions, "blocks": v.blocks})


@query(
    "a2_ingest_rates",
    oracle("v_account_updates", """
        SELECT kind, count(*) AS processed, CASE WHEN max(s) > min(s) THEN round(count(*) / (max(s) - min(s)), 9) ELSE 0 END AS per_second
        FROM (SELECT owner AS kind, CAST(floor(epoch(updated_at)) AS BIGINT) AS s FROM v_account_updates) GROUP BY kind"""),
)
def rates(v):
    rows = v.account_updates.select(F.col("owner").alias("kind"), F.unix_timestamp("updated_at").alias("s"))
    return A.ingest_rates(rows, "kind", "s").withColumn("per_second", F.round("per_second", 9))


@query(
    "a3_indexer_state",
    oracle("v_account_updates v_transactions", """
        SELECT greatest((SELECT max(slot) FROM v_account_updates), (SELECT max(slot) FROM v_transactions)) AS last_processed_slot,
               (SELECT count(*) FROM v_account_updates) AS total_accounts, (SELECT count(*) FROM v_transactions) AS total_transactions"""),
)
def state(v):
    return A.indexer_state(v.account_updates, v.transactions)


@query(
    "a4_daily_stats",
    oracle("v_transactions", """
        SELECT strftime(make_timestamp(block_time * 1000000), '%Y-%m-%d') AS date, count(*) AS transactions,
               count(*) FILTER (err IS NULL) / count(*) * 100 AS success_rate, round(CAST(sum(fee) AS DOUBLE) / 1e9, 6) AS fees
        FROM v_transactions GROUP BY 1"""),
)
def daily(v):
    return A.daily_stats(v.transactions)


@query(
    "a5_instruction_mix",
    oracle("v_transactions", f"""
        SELECT type AS name, count(*) AS value, round(count(*) / sum(count(*)) OVER () * 100, 6) AS percent
        FROM typed WHERE {MINE} GROUP BY type""", typed=type_sql(PROGRAM)),
)
def mix(v):
    return A.instruction_mix(v.transactions, PROGRAM).withColumn("percent", F.round("percent", 6))


@query(
    "a6_operator_stake",
    oracle("v_stake_events", f"""
        SELECT operator, CAST(sum(amount) AS BIGINT) AS total_stake, count(*) AS stakes
        FROM v_stake_events WHERE amount >= {STAKE_MIN} GROUP BY operator"""),
)
def stake_sums(v):
    return St.operator_stake(v.stake_events.filter(F.col("amount") >= STAKE_MIN))


@query(
    "a7_delegations",
    oracle("v_stake_events", "SELECT operator, staker, CAST(sum(amount) AS BIGINT) AS amount FROM v_stake_events GROUP BY operator, staker"),
)
def delegations(v):
    return St.delegations(v.stake_events)


@query("a7_staker_delegations", oracle("v_stake_events", """
    SELECT operator, staker, CAST(sum(amount) AS BIGINT) AS amount FROM v_stake_events WHERE staker = 'cust11' GROUP BY operator, staker"""))
def staker(v):
    return St.staker_delegations(v.stake_events, "cust11")


@query("a8_total_active_stake", oracle("v_operators", "SELECT CAST(sum(stake) AS BIGINT) AS total_stake FROM v_operators WHERE is_active"))
def active_stake(v):
    return St.total_active_stake(v.operators)


@query(
    "a9_supermajority",
    oracle("v_votes v_operators", """
        SELECT *, vote_stake::HUGEINT * 3 > (SELECT sum(stake) FROM v_operators WHERE is_active)::HUGEINT * 2 AS confirmed FROM voted""",
        voted=VOTED),
)
def supermajority(v):
    return St.supermajority(v.votes, v.operators)


@query(
    "a9_supermajority_members",
    oracle("v_votes v_operators", """
        SELECT block_hash, CAST(sum(stake) AS BIGINT) AS vote_stake, count(*) AS voters,
               sum(stake) * 3 > (SELECT sum(stake) FROM v_operators WHERE is_active) * 2 AS confirmed
        FROM (SELECT DISTINCT block_hash, validator FROM v_votes) JOIN v_operators ON validator = operator AND is_active
        GROUP BY block_hash"""),
)
def supermajority_members(v):
    return St.supermajority(v.votes, v.operators, members_only=True)


@query(
    "a10_consensus_ready",
    oracle("v_operators", """
        SELECT count(DISTINCT operator) AS operators, count(DISTINCT operator) >= 3 AND count(DISTINCT operator) / 3.0 >= 0.66 AS ready
        FROM v_operators WHERE is_active"""),
)
def ready(v):
    return St.consensus_ready(v.operators.filter("is_active"), 3, 0.66)


@query(
    "a11_health_rollup",
    oracle("v_health_probes", """
        SELECT service, CASE WHEN bool_and(s = 'healthy') THEN 'healthy' WHEN bool_or(s IN ('healthy', 'degraded')) THEN 'degraded'
                        ELSE 'unhealthy' END AS status, count(*) AS checks
        FROM (SELECT service, CASE probe WHEN 'ok' THEN 'healthy' WHEN 'http_error' THEN 'degraded' ELSE 'unhealthy' END AS s
              FROM v_health_probes QUALIFY row_number() OVER (PARTITION BY service, check_name ORDER BY seq DESC) = 1)
        GROUP BY service"""),
)
def health(v):
    last = latest_by(v.health_probes, ["service", "check_name"], F.struct("seq"))
    return A.health_rollup(last.withColumn("status", probe_status("probe")))


@query(
    "a12_epoch_rewards",
    oracle("v_scores v_multipliers", f"""
        SELECT epoch, operator, CAST(sum({REWARD}) AS BIGINT) AS reward FROM v_scores LEFT JOIN m ON operator = op
        GROUP BY epoch, operator""", m=LAST_MULTIPLIER),
)
def epoch_rewards(v):
    return St.epoch_rewards(v.scores, v.multipliers).withColumn("reward", F.col("reward").cast("bigint"))


@query(
    "a13_distribute_rewards",
    oracle("v_scores", """
        SELECT operator, CAST(sum(amount) AS BIGINT) AS amount, CAST(sum(c) AS BIGINT) AS commission,
               CAST(sum(amount - c) AS BIGINT) AS net
        FROM (SELECT operator, amount, CAST(floor(CAST(amount AS DOUBLE) * CAST(0.1 AS DOUBLE)) AS BIGINT) AS c
              FROM (SELECT operator, CAST(score AS BIGINT) AS amount FROM v_scores WHERE epoch % 2 = 1
                    UNION ALL
                    SELECT operator, CAST(score AS BIGINT) FROM v_scores WHERE epoch % 2 = 0
                        AND operator IN (SELECT operator FROM v_scores WHERE epoch % 2 = 1)))
        GROUP BY operator"""),
)
def distribute(v):
    amounts = v.scores.select("epoch", "operator", F.col("score").cast("bigint").alias("amount"))
    paid, _ = St.distribute_rewards(amounts.filter("epoch % 2 = 1"), amounts.filter("epoch % 2 = 0"))
    return paid.select("operator", *[F.col(c).cast("bigint").alias(c) for c in ("amount", "commission", "net")])


@query(
    "a14_pipeline_counters",
    oracle("v_slot_messages", """
        SELECT kind, count(*) AS received, count(*) FILTER (seq % 11 = 0) AS errors, count(*) FILTER (seq % 11 <> 0) AS published
        FROM v_slot_messages GROUP BY kind"""),
)
def counters(v):
    flagged = v.slot_messages.withColumns({"error": F.col("seq") % 11 == 0, "published": F.col("seq") % 11 != 0})
    return A.pipeline_counters(flagged)


@query(
    "a15_block_summary",
    oracle("v_slot_messages v_block_rewards", """
        SELECT slot, coalesce(entry_count, 0) AS entry_count, coalesce(executed_tx, 0) AS executed_tx,
               coalesce(rewards, 0) AS rewards, leader
        FROM (SELECT slot, count(*) AS entry_count, CAST(sum(executed_tx) AS BIGINT) AS executed_tx
              FROM v_slot_messages WHERE kind = 'entry' GROUP BY slot)
        FULL JOIN (SELECT slot, CAST(sum(lamports) AS BIGINT) AS rewards, arg_min(pubkey, idx) FILTER (reward_type = 'fee') AS leader
                   FROM v_block_rewards GROUP BY slot) USING (slot)"""),
)
def summary(v):
    entries = v.slot_messages.filter("kind = 'entry'").select("slot", F.col("executed_tx").alias("executed_transaction_count"))
    return A.block_summary(entries, v.block_rewards)


@query(
    "a16_latest_metrics",
    oracle("v_account_updates", """
        SELECT owner || ':' || pubkey AS key, lamports AS value FROM v_account_updates
        QUALIFY row_number() OVER (PARTITION BY owner, pubkey ORDER BY updated_at DESC, seq DESC) = 1"""),
)
def metrics(v):
    rows = v.account_updates.select(
        F.concat_ws(":", "owner", "pubkey").alias("key"), F.col("lamports").alias("value"), F.col("updated_at").alias("ts"), "seq"
    )
    return latest_metrics(rows).select("key", "value")


# --- ordered state -----------------------------------------------------------------------------------------


@query(
    "w1_recent_per_key",
    oracle("v_transactions", """
        SELECT program, signature, rn FROM (
            SELECT program, signature, row_number() OVER (PARTITION BY program ORDER BY slot * 10 + idx DESC) AS rn
            FROM (SELECT *, unnest(program_ids) AS program FROM v_transactions)) WHERE rn <= 100"""),
)
def recent_per_program(v):
    index = K.build_index(v.transactions, "program_ids", "program", ["signature", (F.col("slot") * 10 + F.col("idx")).alias("seq")])
    return O.recent_per_key(index, ["program"], "seq", 100).select("program", "signature", F.col("rn").cast("bigint").alias("rn"))


@query(
    "w2_slashing",
    oracle("v_violations", """
        SELECT operator, seq, total::DOUBLE AS total_severity, total >= 5.0 AS slashed,
               CASE WHEN total < 5.0 THEN 0 ELSE CASE violation WHEN 'LowUptime' THEN 1000 WHEN 'DoubleProposal' THEN 5000
                    WHEN 'DoubleVote' THEN 7500 ELSE 10000 END END AS penalty
        FROM (SELECT *, sum(CASE violation WHEN 'LowUptime' THEN 0.5 WHEN 'DoubleProposal' THEN 0.7 WHEN 'DoubleVote' THEN 0.8
                            ELSE 1.0 END::DECIMAL(10,1)) OVER (PARTITION BY operator ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS total
              FROM v_violations)"""),
)
def slashing(v):
    rows = St.slashing(v.violations, 5.0)
    return rows.select("operator", "seq", F.col("total_severity").cast("double").alias("total_severity"), "slashed", F.col("penalty").cast("bigint").alias("penalty"))


@query(
    "w3_top_peers",
    oracle("v_operators", """
        SELECT topic, operator, stake, rn FROM (
            SELECT *, row_number() OVER (PARTITION BY topic ORDER BY stake DESC, operator) AS rn FROM v_operators) WHERE rn <= 6"""),
)
def peers(v):
    return St.top_peers(v.operators).select("topic", "operator", "stake", F.col("rn").cast("bigint").alias("rn"))


@query(
    "w4_retain_latest_slots",
    oracle("v_blocks", """
        SELECT slot, blockhash FROM v_blocks
        WHERE (SELECT count(DISTINCT slot) FROM v_blocks) <= 1000 OR slot >= (SELECT min(slot) FROM (SELECT slot FROM v_blocks ORDER BY slot DESC LIMIT 500))"""),
)
def retain(v):
    return topk.retain_latest_slots(v.blocks).select("slot", "blockhash")


@query(
    "w5_advancing_slots",
    oracle("v_account_updates", """
        SELECT seq, owner, slot FROM (
            SELECT *, max(slot) OVER (PARTITION BY owner ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen
            FROM v_account_updates) WHERE seen IS NULL OR slot > seen"""),
)
def advancing(v):
    return O.advancing_slots(v.account_updates, ["owner"], ["seq"], O.seq_bucket()).select("seq", "owner", "slot")


@query(
    "w5_advancing_slots_global",
    oracle("v_account_updates", """
        SELECT seq, slot FROM (
            SELECT *, max(slot) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen
            FROM v_account_updates) WHERE seen IS NULL OR slot > seen"""),
)
def advancing_all(v):
    return O.advancing_slots(v.account_updates, [], ["seq"], O.seq_bucket()).select("seq", "slot")


# Greedy gate, written as a walk along "first tick at least an hour later".
GATE = """
    WITH RECURSIVE {views}, ticks AS (SELECT owner, s, min(seq) AS seq FROM t GROUP BY owner, s),
    nxt AS (SELECT a.owner, a.s, a.seq, b.s AS next FROM ticks a ASOF LEFT JOIN ticks b ON a.owner = b.owner AND a.s + 3600 <= b.s),
    walk AS (
        SELECT owner, s, seq, next FROM nxt WHERE (owner, s) IN (SELECT (owner, min(s)) FROM ticks GROUP BY owner)
        UNION ALL
        SELECT n.owner, n.s, n.seq, n.next FROM walk w JOIN nxt n ON n.owner = w.owner AND n.s = w.next)
    SELECT owner, s AS seconds, seq FROM walk"""


@query(
    "w6_distribution_gate",
    GATE.replace("{views}", oracle("v_account_updates", "", t="""
        SELECT owner, CAST(floor(epoch(updated_at)) AS BIGINT) AS s, seq FROM v_account_updates""").strip().removeprefix("WITH ")),
)
def gate(v):
    ticks = v.account_updates.select("owner", F.unix_timestamp("updated_at").alias("seconds"), "seq")
    return O.distribution_gate(ticks, ["owner"], "seconds", "seq", 3600)


LEDGER = """
    SELECT *, sum(CASE WHEN op = 'remove' THEN 1 ELSE 0 END)
        OVER (PARTITION BY operator, staker ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seg
    FROM v_delegation_ops"""


@query(
    "w7_delegation_ledger",
    oracle("v_delegation_ops", """
        SELECT max(seq) FILTER (op = 'remove') AS seq, operator, staker, CAST(sum(amount) FILTER (op = 'add') AS BIGINT) AS amount,
               CASE WHEN count(*) FILTER (op = 'add') = 0 THEN 'delegation not found' END AS error
        FROM (SELECT *, coalesce(seg, 0) AS segment FROM l) GROUP BY operator, staker, segment""", l=LEDGER),
)
def ledger(v):
    balances, removals = O.delegation_ledger(v.delegation_ops, O.seq_bucket())
    none = F.lit(None)
    return removals.unionByName(balances.withColumns({"seq": none.cast("bigint"), "error": none.cast("string")}))


# A sequential fold: row n of an operator is decided by the total accepted up to row n - 1.
FOLD = """
    SELECT operator, seq, tie, amount, n, CASE WHEN amount <= {cap} THEN amount ELSE 0 END AS total, amount <= {cap} AS taken
    FROM r WHERE n = 1
    UNION ALL
    SELECT r.operator, r.seq, r.tie, r.amount, r.n, CASE WHEN f.total + r.amount <= {cap} THEN f.total + r.amount ELSE f.total END,
           f.total + r.amount <= {cap}
    FROM fold f JOIN r ON r.operator = f.operator AND r.n = f.n + 1"""


@query(
    "w8_stake_with_cap",
    oracle("v_stake_events", f"""
        SELECT e.seq, e.tie, e.operator, e.staker, e.amount,
               CASE WHEN e.amount < {STAKE_MIN} THEN 'below minimum' WHEN f.taken THEN 'accepted' ELSE 'over cap' END AS decision
        FROM v_stake_events e LEFT JOIN fold f ON e.operator = f.operator AND e.seq = f.seq AND e.tie = f.tie AND e.amount = f.amount""",
        r=f"""SELECT operator, seq, tie, amount, row_number() OVER (PARTITION BY operator ORDER BY seq, tie, amount) AS n
              FROM v_stake_events WHERE amount >= {STAKE_MIN}""",
        fold=FOLD.format(cap=STAKE_CAP)).replace("WITH", "WITH RECURSIVE", 1),
)
def stake_cap(v):
    return O.stake_with_cap(v.stake_events, STAKE_MIN, STAKE_CAP, order=["seq", "tie", "amount"])


@query(
    "w9_batch_ids",
    oracle("v_account_updates", """
        SELECT seq, owner, (row_number() OVER (PARTITION BY owner ORDER BY seq) - 1) // 100 AS batch_id FROM v_account_updates"""),
)
def batches(v):
    return O.batch_ids(v.account_updates, 100, ["owner"], ["seq"], O.seq_bucket()).select("seq", "owner", "batch_id")


@query(
    "w10_operator_status",
    oracle("v_operators v_operator_updates", """
        SELECT operator, is_active, last_seen, CAST(NULL AS VARCHAR) AS error FROM (
            SELECT operator, is_active, seen_at AS last_seen FROM v_operator_updates
            QUALIFY row_number() OVER (PARTITION BY operator ORDER BY seq DESC) = 1)
        WHERE operator IN (SELECT operator FROM v_operators)
        UNION ALL
        SELECT operator, is_active, seen_at, 'Operator not found: ' || operator FROM v_operator_updates
        WHERE operator NOT IN (SELECT operator FROM v_operators)"""),
)
def status(v):
    known, unknown = operator_status(v.operators, v.operator_updates)
    bad = unknown.select("operator", "is_active", F.col("seen_at").alias("last_seen"), "error")
    return known.withColumn("error", F.lit(None).cast("string")).unionByName(bad)


@query("w10_last_votes", oracle("v_votes", "SELECT validator, max(seq) AS last_vote FROM v_votes GROUP BY validator"))
def votes_seen(v):
    return last_votes(v.votes)


# --- batch forms of the stream jobs ----------------------------------------------------------------------------

BLOCK_STATE = """
    SELECT *, last_value(status IGNORE NULLS) OVER w AS now_status,
        max(CASE WHEN kind = 'metadata' THEN seq END) OVER w AS meta_seq,
        max(CASE WHEN parent_slot IS NOT NULL THEN seq END) OVER w AS parent_seq,
        first_value(parent) OVER w AS first_parent,
        count(*) FILTER (kind = 'entry') OVER w AS entries,
        sum(executed_tx) OVER w AS executed
    FROM v_slot_messages WINDOW w AS (PARTITION BY slot ORDER BY seq ROWS UNBOUNDED PRECEDING)"""
BLOCKS_SQL = """
    SELECT s.slot, s.seq, coalesce(p.parent_slot, s.first_parent) AS parent_slot, 'rooted' AS status, m.blockhash, m.block_time,
           m.block_height, m.transaction_count, coalesce(m.entry_count, s.entries) AS entry_count,
           CAST(coalesce(s.executed, 0) AS BIGINT) AS executed_tx
    FROM st s LEFT JOIN v_slot_messages m ON m.seq = s.meta_seq LEFT JOIN v_slot_messages p ON p.seq = s.parent_seq
    WHERE s.kind <> 'entry' AND s.now_status = 'rooted'"""


@query("t1_assemble_blocks", oracle("v_slot_messages", BLOCKS_SQL, st=BLOCK_STATE))
def assembled(v):
    return assemble_blocks(v.slot_messages, O.seq_bucket())


@query(
    "t3_dedup_messages",
    oracle("v_messages", """
        SELECT message_id, source, seq FROM v_messages QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY seq) = 1"""),
)
def dedup(v):
    return K.dedup_messages(v.messages.select("message_id", "source", "seq"))


@query(
    "t6_evict_rooted",
    oracle("v_slot_messages", """
        SELECT slot, status FROM cur WHERE NOT (coalesce(status, '') = 'rooted' AND slot < (SELECT max(slot) FROM cur) - 20)""",
        cur="SELECT slot, arg_max(status, seq) FILTER (status IS NOT NULL) AS status FROM v_slot_messages GROUP BY slot"),
)
def evict(v):
    current = v.slot_messages.groupBy("slot").agg(F.max_by("status", F.when(F.col("status").isNotNull(), F.col("seq"))).alias("status"))
    return evict_rooted(current, 20)


@query(
    "t7_fan_out_topics",
    oracle("v_messages", """
        SELECT seq, message_id, topic FROM (SELECT *, unnest(topics) AS topic FROM v_messages) WHERE topic IN ('all', 'click', 'signup')"""),
)
def fan_out(v):
    return K.fan_out_topics(v.messages.drop("ts", "source"), ["all", "click", "signup"])


@query(
    "t9_live_tracker_batch",
    oracle("v_transactions", f"""
        SELECT strftime(make_timestamp(block_time * 1000000), '%Y-%m-%d') AS date, type AS name, count(*) AS transactions
        FROM (SELECT * FROM typed WHERE {MINE} ORDER BY slot DESC, idx DESC LIMIT 100) GROUP BY ALL""", typed=type_sql(PROGRAM)),
)
def tracker_stats(v):
    newest = topk.tracker_view(v.transactions, PROGRAM, keep=100)
    day = F.date_format(F.timestamp_seconds("block_time"), "yyyy-MM-dd")
    return newest.groupBy(day.alias("date"), F.col("instruction_type").alias("name")).agg(F.count("*").alias("transactions"))


