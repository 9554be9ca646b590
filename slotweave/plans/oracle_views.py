"""DuckDB SQL of the views in ``slotweave.fixtures``; same names with a ``v_`` prefix."""

from __future__ import annotations

K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


def _cents(col: str) -> str:
    return f"CAST(ROUND({col} * 100) AS BIGINT)"


VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "v_account_updates": ((), f"""
        SELECT event_id AS seq, 'acct' || user_id AS pubkey, event_type AS owner,
               {_cents('value')} * 10000000 AS lamports, (event_id * 7919) % 97 AS slot,
               {K} AS write_version, {K} % 2 = 0 AS executable, event_id % 20 = 0 AS is_startup,
               ts AS updated_at
        FROM events"""),
    "v_slot_messages": ((), f"""
        SELECT event_id AS seq, slot, kind,
               CASE WHEN kind = 'status' THEN CASE WHEN k % 2 = 0 THEN 'rooted' ELSE 'confirmed' END END AS status,
               CASE WHEN kind = 'status' THEN greatest(slot - 1, 0) END AS parent,
               CASE WHEN kind = 'metadata' AND k % 3 = 0 THEN greatest(slot - 2, 0) END AS parent_slot,
               CASE WHEN kind = 'metadata' THEN 'bh' || k END AS blockhash,
               CASE WHEN kind = 'metadata' THEN CAST(floor(epoch(ts)) AS BIGINT) END AS block_time,
               CASE WHEN kind = 'metadata' THEN slot END AS block_height,
               CASE WHEN kind = 'metadata' THEN k * 2 END AS transaction_count,
               CASE WHEN kind = 'metadata' AND k % 5 = 0 THEN k END AS entry_count,
               CASE WHEN kind = 'entry' THEN event_id % 20 END AS entry_index,
               CASE WHEN kind = 'entry' THEN k END AS executed_tx
        FROM (SELECT *, {K} AS k, event_id // 20 AS slot,
                     CASE WHEN event_type IN ('view', 'click') THEN 'entry'
                          WHEN event_type IN ('signup', 'purchase') THEN 'metadata'
                          ELSE 'status' END AS kind
              FROM events)"""),
    "v_block_messages": (("v_slot_messages",), f"""
        SELECT m.*, CASE WHEN kind = 'metadata' THEN
                    list_transform(range(1, 1 + {K} % 4), lambda i: 'v' || i || ':' || ({K} * i - 100) || ':' || ({K} + i) || ':'
                                   || CASE WHEN i % 2 = 0 THEN 'fee' ELSE 'voting' END || ':' || CASE WHEN i = 3 THEN '3' ELSE '' END) END AS rewards,
               CASE WHEN kind = 'entry' THEN entry_index || ':' || ({K} * 3 + 1) || ':h' || event_id || ':' || {K} || ':'
                    || CASE WHEN {K} % 2 = 0 THEN CAST({K} * 5 AS VARCHAR) ELSE '' END END AS entry
        FROM v_slot_messages m JOIN events e ON e.event_id = m.seq"""),
    "v_messages": ((), """
        SELECT event_id AS seq, 'm' || (event_id // 3) AS message_id, 's' || (user_id % 100) AS source,
               [event_type, 'all'] AS topics, ts
        FROM events"""),
    "v_delegation_ops": ((), f"""
        SELECT event_id AS seq, 's' || (user_id % 10) AS operator, 'u' || user_id AS staker,
               CASE WHEN event_type = 'error' THEN 'remove' ELSE 'add' END AS op,
               {_cents('value')} AS amount
        FROM events"""),
    "v_violations": ((), f"""
        SELECT 'u' || user_id AS operator, ts, event_id AS seq,
               CASE {K} % 4 WHEN 0 THEN 'LowUptime' WHEN 1 THEN 'DoubleProposal'
                    WHEN 2 THEN 'DoubleVote' ELSE 'MaliciousValidation' END AS violation
        FROM events"""),
    "v_votes": ((), f"""
        SELECT sha256('b' || {K}) AS block_hash, 's' || (user_id % 100) AS validator, event_id AS seq
        FROM events"""),
    "v_health_probes": ((), f"""
        SELECT 'svc' || user_id AS service, 'c' || ({K} % 2) AS check_name,
               CASE event_type WHEN 'error' THEN 'timeout' WHEN 'view' THEN 'http_error' ELSE 'ok' END AS probe,
               event_id AS seq
        FROM events"""),
    "v_operator_updates": ((), """
        SELECT event_id AS seq, 's' || (user_id % 120) AS operator, event_type <> 'error' AS is_active,
               CAST(floor(epoch(ts)) AS BIGINT) AS seen_at
        FROM events"""),
    "v_scores": ((), f"""
        SELECT event_id // 1000 AS epoch, 's' || (user_id % 100) AS operator,
               CAST({_cents('value')} * 10 AS DOUBLE) AS score, event_id AS seq
        FROM events"""),
    "v_operators": ((), f"""
        SELECT 's' || s_suppkey AS operator, greatest({_cents('s_acctbal')}, 0) * 10000 AS stake,
               s_suppkey % 7 <> 0 AS is_active, 't' || s_nationkey AS topic,
               CAST(s_suppkey % 50 + 50 AS DOUBLE) AS uptime_pct
        FROM supplier"""),
    "v_multipliers": ((), """
        SELECT 's' || s_suppkey AS operator, CAST(0.5 AS DOUBLE) AS multiplier, 1 AS seq
        FROM supplier WHERE s_suppkey % 3 <> 0
        UNION ALL
        SELECT 's' || s_suppkey, CAST(s_suppkey % 8 * 0.25 + 0.25 AS DOUBLE), 2
        FROM supplier WHERE s_suppkey % 3 = 1"""),
    "v_stake_events": ((), f"""
        SELECT l_orderkey * 100 + l_linenumber AS seq,
               l_partkey AS tie,
               's' || l_suppkey AS operator, 'cust' || o_custkey AS staker,
               {_cents('l_extendedprice')} AS amount
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""),
    "v_transactions": ((), f"""
        SELECT 'sig' || o_orderkey AS signature, o_orderkey // 10 AS slot, o_orderkey % 10 AS idx,
               CAST(epoch(o_orderdate) AS BIGINT) AS block_time, o_orderpriority = '5-LOW' AS is_vote,
               CASE WHEN o_orderstatus = 'P' THEN '{{"code":1}}' END AS err,
               {_cents('o_totalprice')} AS fee,
               list_sort(list_prepend('cust' || o_custkey, coalesce(suppliers, []))) AS accounts,
               coalesce(brands, []) AS program_ids,
               coalesce(instructions, []) AS instructions
        FROM orders LEFT JOIN (
            SELECT l_orderkey,
                   list_sort(list_distinct(list('supp' || l_suppkey))) AS suppliers,
                   list_sort(list_distinct(list(p_brand))) AS brands,
                   list({{'program_id': p_brand, 'accounts': ['supp' || l_suppkey],
                          'data': '0' || (p_size % 10) || '000000'}}
                        ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount,
                                 l_tax, l_returnflag, l_linestatus, l_shipdate) AS instructions
            FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey
        ) ON o_orderkey = l_orderkey"""),
    "v_blocks": (("v_transactions",), """
        SELECT slot, CASE WHEN slot > 0 THEN slot - 1 END AS parent_slot, 'bh' || slot AS blockhash,
               'bh' || (slot - 1) AS parent_blockhash, slot AS block_height, max(block_time) AS block_time,
               count(*) AS transaction_count, 'supp' || (slot % 100) AS leader
        FROM (SELECT slot + slot // 36 AS slot, block_time FROM v_transactions) GROUP BY slot"""),
    "v_block_rewards": (("v_transactions",), """
        SELECT slot, idx, 'supp' || ((slot + idx) % 100) AS pubkey, fee // 2 AS lamports,
               CASE WHEN idx % 2 = 0 THEN 'fee' ELSE 'rent' END AS reward_type
        FROM v_transactions"""),
    "v_token_balances": ((), f"""
        SELECT 'acct' || (p_partkey % 140) AS owner, 'mint' || p_partkey AS mint,
               {_cents('p_retailprice')} * 1000 AS amount, CAST(p_size % 10 AS BIGINT) AS decimals
        FROM part"""),
    "v_watchlist": ((), """
        SELECT 'w' || c_custkey AS id,
               CASE c_custkey % 3 WHEN 0 THEN 'account' WHEN 1 THEN 'transaction' ELSE 'token' END AS type,
               CASE WHEN c_custkey % 3 = 1
                    THEN CASE WHEN c_custkey % 10 = 0 THEN 'nosig' || c_custkey ELSE 'sig' || c_custkey END
                    ELSE 'acct' || (c_custkey % 165) END AS pubkey,
               800000000 + (c_custkey * 7919) % 100003 AS added,
               CASE WHEN c_custkey % 2 = 0 THEN c_name END AS name
        FROM customer"""),
    "v_account_rpc": (("v_account_updates",), """
        SELECT seq, pubkey, CASE b
            WHEN 0 THEN '{"jsonrpc":"2.0","result":{"context":' || context || ',"value":null}}'
            WHEN 4 THEN '{"jsonrpc":"2.0","error":{"code":-32602}}'
            WHEN 5 THEN '{"jsonrpc":"2.0","result":null}'
            WHEN 6 THEN '{"jsonrpc":"2.0"}'
            WHEN 7 THEN '{"jsonrpc":'
            ELSE '{"jsonrpc":"2.0","result":{"context":' || context || ',"value":{' || lam || '"owner":' || own
                 || ',"executable":' || exe || ',"rentEpoch":' || rent || ',"data":' || dat || '}}}' END AS body
        FROM (SELECT seq, pubkey, seq % 50 AS b,
                CASE seq % 50 WHEN 3 THEN '["***","base64"]'
                     WHEN 8 THEN '["' || to_base64(encode(pubkey)) || '"]'
                     ELSE '["' || to_base64(encode(pubkey)) || '","base64"]' END AS dat,
                CASE seq % 50 WHEN 1 THEN '' WHEN 10 THEN '"lamports":1.5,'
                     WHEN 11 THEN '"lamports":"' || lamports || '",' WHEN 12 THEN '"lamports":-5,'
                     ELSE '"lamports":' || lamports || ',' END AS lam,
                CASE seq % 50 WHEN 2 THEN '7' ELSE '"' || owner || '"' END AS own,
                CASE WHEN seq % 50 = 13 THEN '1' WHEN executable THEN 'true' ELSE 'false' END AS exe,
                CASE seq % 50 WHEN 9 THEN '18446744073709551615' ELSE CAST(write_version AS VARCHAR) END AS rent,
                CASE seq % 50 WHEN 14 THEN '{}' ELSE '{"slot":' || slot || '}' END AS context
              FROM v_account_updates)"""),
    "v_notifications": (("v_account_updates",), """
        SELECT seq, CASE seq % 4
            WHEN 0 THEN '{"method":"accountNotification","params":["' || pubkey || '",{"result":{"context":{"slot":'
                 || slot || '},"value":{"lamports":' || lamports || ',"owner":"' || owner || '","executable":'
                 || CASE WHEN executable THEN 'true' ELSE 'false' END || ',"rentEpoch":' || write_version
                 || ',"data":["' || CASE WHEN seq % 50 = 4 THEN '***' ELSE to_base64(encode(pubkey)) END
                 || '","base64"]}}}]}'
            WHEN 1 THEN CASE WHEN seq % 50 = 9 THEN '{"method":"signatureNotification","params":["only-one"]}'
                 ELSE '{"method":"signatureNotification","params":["sig' || seq || '",{"result":{"context":{"slot":'
                 || slot || '},"value":{"x":0' || CASE seq % 50 % 3 WHEN 0 THEN ',"err":null'
                      WHEN 1 THEN ',"err":{"code":1}' ELSE '' END || '}}}]}' END
            WHEN 2 THEN '{"method":"slotNotification","params":['
                 || CASE WHEN seq % 50 = 2 THEN '"x"' ELSE CAST(slot AS VARCHAR) END || ']}'
            ELSE CASE seq % 50 WHEN 7 THEN '{"method":' WHEN 11 THEN '{"id":1}'
                 ELSE '{"method":"rootNotification","params":[1]}' END END AS body
        FROM v_account_updates"""),
    "v_transaction_rpc": (("v_transactions",), """
        SELECT signature, CASE b
            WHEN 0 THEN '{"jsonrpc":"2.0","result":null}'
            WHEN 1 THEN '{"jsonrpc":"2.0","error":{"code":-32005}}'
            WHEN 2 THEN '{"jsonrpc":"2.0"}'
            WHEN 3 THEN '{"result"'
            ELSE '{"jsonrpc":"2.0","result":{' || CASE WHEN b = 12 THEN '' ELSE '"slot":' || slot || ',' END
                 || CASE WHEN b = 13 THEN '' ELSE '"meta":{'
                    || CASE WHEN err IS NOT NULL THEN '"err":' || err || ',' WHEN b % 2 = 0 THEN '"err":null,' ELSE '' END
                    || CASE WHEN b = 8 THEN '"fee":"1"' ELSE '"fee":' || fee END
                    || CASE WHEN b = 9 THEN ',"logMessages":null' WHEN b = 10 THEN ''
                            ELSE ',"logMessages":["log ' || idx || '",3]' END || '},' END
                 || CASE WHEN b = 14 THEN '"transaction":{}' ELSE '"transaction":{"message":{"recentBlockhash":'
                    || CASE WHEN b = 6 THEN '9' ELSE '"bh' || slot || '"' END
                    || ',"accountKeys":["' || array_to_string(accounts, '","') || '"]'
                    || CASE WHEN b = 7 THEN '' ELSE ',"instructions":['
                       || array_to_string(list_transform(instructions, lambda i, j:
                            '{' || CASE WHEN b = 5 THEN '' ELSE '"programId":"' || i.program_id || '",' END
                            || '"accounts":[' || ((j - 1) % 3) || ',1000],"data":"' || i.data || '"}'), ',')
                       || ']' END || '}}' END
                 || CASE WHEN b = 11 THEN ',"blockTime":null' ELSE ',"blockTime":' || block_time END || '}}'
            END AS body
        FROM (SELECT *, (slot * 10 + idx) % 50 AS b FROM v_transactions)"""),
    "v_block_rpc": (("v_blocks",), """
        SELECT slot, CASE b
            WHEN 1 THEN '{"error":{"code":-32007}}'
            WHEN 2 THEN '{"id":1}'
            WHEN 3 THEN '{"result":null}'
            WHEN 4 THEN '{'
            ELSE '{"result":{' || CASE WHEN b = 6 THEN '' ELSE '"slot":' || slot || ',' END
                 || CASE WHEN b = 7 THEN '' ELSE '"parentSlot":' || coalesce(parent_slot, 0) || ',' END
                 || CASE WHEN b = 8 THEN '"blockhash":1,' ELSE '"blockhash":"' || blockhash || '",' END
                 || CASE WHEN b = 9 THEN '' ELSE '"previousBlockhash":"' || parent_blockhash || '",' END
                 || CASE WHEN b = 10 THEN '' ELSE '"transactions":['
                    || rtrim(repeat('{},', transaction_count), ',') || '],' END
                 || CASE WHEN b = 11 THEN '"rewards":null,' ELSE
                    '"rewards":[{"pubkey":"voter","lamports":-3,"postBalance":10,"rewardType":"voting"},{"pubkey":"'
                    || leader || '","lamports":' || transaction_count || ',"postBalance":20'
                    || CASE WHEN b = 5 THEN '' ELSE ',"rewardType":"fee"' END
                    || '},{"pubkey":"late","lamports":1,"postBalance":30,"rewardType":"fee"}],' END
                 || CASE WHEN b = 12 THEN '' ELSE '"blockHeight":' || block_height || ',' END
                 || '"blockTime":' || CASE WHEN b = 13 THEN 'null' ELSE CAST(block_time AS VARCHAR) END || '}}'
            END AS body
        FROM (SELECT *, slot % 50 AS b FROM v_blocks)"""),
}


def oracle(views: str, body: str, **ctes: str) -> str:
    """One statement: the named views (with what they build on), extra CTEs, then ``body``."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for dep in VIEWS[name][0]:
            add(dep)
        if name not in wanted:
            wanted.append(name)

    for name in views.split():
        add(name)
    parts = [f"{name} AS ({VIEWS[name][1]})" for name in wanted]
    parts += [f"{name} AS ({sql})" for name, sql in ctes.items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body
