"""DuckDB SQL for the queries of the catalog, written against the tables and not against the Spark plans."""

from __future__ import annotations


def _rev(h: str) -> str:
    return f"array_to_string(list_transform(range(31, -1, -1), lambda i: substr({h}, (2 * i + 1)::int, 2)), '')"


def _hash2(h: str) -> str:
    return f"sha256(unhex(sha256(unhex({h}))))"


def _url(k: str) -> str:
    return f"'https://subscriber-' || ({k} % 20)::varchar || '.example/callback'"


def _compact(n: str) -> str:
    le = lambda size: "(" + " || ".join(f"lpad(lower(to_hex(({n} >> {8 * i}) & 255)), 2, '0')" for i in range(size)) + ")"
    return f"case when {n} < 253 then {le(1)} when {n} <= 65535 then 'fd' || {le(2)} when {n} <= 4294967295 then 'fe' || {le(4)} else 'ff' || {le(8)} end"


_TX = f"""
tx0 as (select o_orderkey as tx_key, strftime(o_orderdate, '%Y-%m') as month, sha256('tx:' || o_orderkey::varchar) as raw_hex from orders),
tx as (select *, {_rev('raw_hex')} as txid from tx0),
blk as (select month, 800000 + row_number() over (order by month) - 1 as height from (select distinct month from tx)),
leaf0 as (select height, sha256('block:' || height::varchar) as block_hash, raw_hex, txid,
  row_number() over (partition by height order by tx_key) - 1 as n from tx join blk using (month)),
leaf as (select height, block_hash, n // 64 as subtree_index, n % 64 as leaf_index, raw_hex, txid from leaf0)"""
_REG = f"""
ev0 as (select sha256('tx:' || l_orderkey::varchar) as h, {_url('l_suppkey')} as url,
  case when l_linenumber % 3 = 0 then '' else 'tok-' || l_linenumber::varchar end as token,
  l_shipdate as s1, l_linenumber as s2, l_suppkey as s3, l_partkey as s4, l_extendedprice as s5 from lineitem where l_returnflag = 'R'),
ev as (select {_rev('h')} as txid, url, token, s2, row_number() over (order by s1, s2, s3, s4, s5) as seq from ev0),
reg as (select txid, url, arg_max(token, seq) as token, min(seq) as first_seq from ev group by txid, url)"""
_FOUND = """
found as (select height, block_hash, subtree_index, max(leaf_index) as leaf_index, txid, url, any_value(token) as token
  from leaf join reg using (txid) group by height, block_hash, subtree_index, txid, url)"""
_SIZE = "siz as (select block_hash, height, subtree_index, count(*) as n from leaf group by all)"
_levels = lambda height: (
    _SIZE
    + ", l0 as (select block_hash, subtree_index, leaf_index as pos, raw_hex as hash from leaf)"
    + "".join(
        f""", l{i} as (select block_hash, subtree_index, pos // 2 as pos, {_hash2('arg_min(hash, pos) || arg_max(hash, pos)')} as hash
  from l{i - 1} where (block_hash, subtree_index) in (select (block_hash, subtree_index) from l{i - 1} where pos = 1) group by block_hash, subtree_index, pos // 2)"""
        for i in range(1, height + 1)
    )
    + ", lev as ("
    + " union all ".join(f"select block_hash, subtree_index, {i} as level, pos, hash from l{i}" for i in range(height + 1))
    + ")"
)
_LEVELS = _levels(6)
_NODES = """
th as (select *, case when n <= 1 then 0 else ceil(log2(n))::bigint end as tree_height from siz),
r as (select distinct f.block_hash, f.subtree_index, th.height, n, tree_height, leaf_index from found f join th using (block_hash, subtree_index) where tree_height > 0),
held as (select block_hash, subtree_index, height, n, tree_height, level, pos, max(own) as own from (
  select block_hash, subtree_index, height, n, tree_height, level, xor(leaf_index >> level, 1) as pos, 0 as own
    from (select *, unnest(range(0, tree_height)) as level from r)
  union all select block_hash, subtree_index, height, n, tree_height, 0, leaf_index, 1 from r) group by all),
nodes as (select h.block_hash, h.subtree_index, h.height, tree_height, level, pos,
  case when pos >= ceil(n / (1 << level)) then 1 when own = 1 then 2 else 0 end as flag, coalesce(lev.hash, '') as hash
  from held h left join lev using (block_hash, subtree_index, level, pos))"""
_ENC = f"""
lv as (select block_hash, subtree_index, height, tree_height, level,
  {_compact('count(*)')} || string_agg({_compact('pos')} || lpad(to_hex(flag), 2, '0') || hash, '' order by pos) as x from nodes group by all),
enc as (select block_hash, subtree_index, {_compact('height')} || lpad(to_hex(tree_height), 2, '0') || string_agg(x, '' order by level) as stump_hex
  from lv group by block_hash, subtree_index, height, tree_height)"""
_ALL = f"with {_TX}, {_REG}, {_FOUND}"
_PROOF = f"{_ALL}, {_LEVELS}, {_NODES}"
_NODE_COLS = "block_hash, subtree_index, tree_height, level, pos as \"offset\", flag::bigint as flag, hash"
_SUB = "sub as (select block_hash, height, subtree_index, sha256(unhex(string_agg(raw_hex, '' order by leaf_index))) as subtree_hash, list(raw_hex order by leaf_index) as every from leaf group by all)"
_SET = lambda t: f"substr(sha256(array_to_string(list_sort({t}), ',')), 1, 16)"
_OBS = "obs as (select user_id::varchar as txid, event_type || '-' || strftime(ts, '%Y-%m-%d') as subtree_id, ts, event_id as seq from events), fs as (select txid, subtree_id, min(ts) as first_ts from obs group by all)"
_FIRED = lambda k: f"fired as (select txid, subtree_id, first_ts as fired_at from (select *, row_number() over (partition by txid order by first_ts, subtree_id) as n from fs) where n = {k})"
_MSG = f"""
{_SUB}, msg as (select type, {_url('subtree_index')} as url, block_hash, subtree_index,
  case when type in ('STUMP', 'BLOCK_PROCESSED') then block_hash else '' end as block,
  case when type <> 'BLOCK_PROCESSED' and subtree_index % 2 = 0 then subtree_hash else '' end as subtree,
  case when type = 'STUMP' then subtree_index else 0 end as idx,
  case when type = 'SEEN_MULTIPLE_NODES' then every[1] else '' end as txid,
  case when type = 'SEEN_ON_NETWORK' then every else [] end as txids
  from sub, (values ('STUMP'), ('BLOCK_PROCESSED'), ('SEEN_ON_NETWORK'), ('SEEN_MULTIPLE_NODES')) k(type)),
key as (select *, case when type = 'BLOCK_PROCESSED' then block when type = 'STUMP' then block || ':' || idx
  when len(txids) > 0 then {_SET('txids')} else txid end as scope from msg)"""
_WORK = """
sub as (select distinct height, block_hash, subtree_index from leaf),
expected as (select block_hash, count(*) as expected from sub group by all),
finished as (select block_hash, subtree_index from leaf join orders on raw_hex = sha256('tx:' || o_orderkey::varchar) where leaf_index = 0 and (o_orderstatus <> 'P' or o_totalprice <= 475000)),
cd as (select block_hash, coalesce(expected, 0) as expected, coalesce(f, 0) as finished, greatest(0, coalesce(expected, 0) - coalesce(f, 0)) as remaining
  from expected full join (select block_hash, count(*) as f from finished group by all) using (block_hash))"""
_SEEN_URL = f"us as (select {_url('user_id')} as url, 'tok-' || (event_id % 7)::varchar as token, ts as last_seen, event_id as seq from events)"
_EXP = "expiring as (select user_id::varchar as txid, case when user_id % 10 <> 0 then max(ts) + interval 1 day end as expires_at from events group by user_id)"
_TRY = lambda ok: f"""with a as (select user_id as key, {_url('user_id')} as url, event_id as seq, ts, {ok} as ok,
  row_number() over w - 1 as retry, coalesce(max(({ok})::int) over (w rows between unbounded preceding and 1 preceding), 0) as past
  from events window w as (partition by user_id order by ts, event_id)),
s as (select key, url, seq, ts, retry, case when ok then 'delivered' when retry >= 5 then 'dlq' else 'retry' end as state from a where past = 0 and retry <= 5),
d as (select *, case when state = 'retry' then ts + to_seconds(30 * (retry + 1)) end as next_at from s)"""  # noqa: E731

_BATCHED = f"""
ev0 as (select sha256('tx:' || l_orderkey::varchar) as h, {_url('l_suppkey')} as url, case when l_linenumber % 3 = 0 then '' else 'tok-' || l_linenumber::varchar end as token,
  date_diff('day', date '1970-01-01', l_shipdate::date) * 1000000000 + l_linenumber * 100000000 + l_suppkey as seq, least(2, (l_linenumber - 1) // 2) as batch from lineitem where l_returnflag = 'R'),
ev as (select {_rev('h')} as txid, url, token, seq, batch from ev0),
p as (select batch, txid, url, arg_max(token, seq) as token, min(seq) as first from ev group by all)"""
_after = lambda before, batch: f"""(select txid, url, token from (select txid, url, coalesce(n.token, o.token) as token, o.token is not null as known,
  row_number() over (partition by txid order by o.token is not null desc, first, url) as slot from {before} o full join (select * from p where batch = {batch}) n using (txid, url)) where known or slot <= 3)"""  # noqa: E731

ORACLES: dict[str, str] = {
    "registered_by_url": f"{_ALL} select height, url, count(*) as n_txids, count(distinct subtree_index) as n_subtrees, min(txid) as first_txid from found group by height, url",
    "registration_lookup": f"{_ALL} select height, subtree_index, leaf_index, txid, url, token from found",
    "txid_display": f"with {_TX} select tx_key, raw_hex, txid from tx",
    "raw_split_txids": f"with {_TX} select height, subtree_index, leaf_index, raw_hex, txid from leaf",
    "watch_validation": """
with s as (select s_suppkey as k, s_suppkey % 24 as m from supplier),
e as (select k, -- fixed values: the answers that clients see
  case when m = 1 then 'txid is required' when m in (2, 22, 23) then 'invalid txid format: must be a 64-character hex string'
    when m = 3 then 'callbackUrl is required'
    when m in (4, 7, 21) then 'invalid callbackUrl: must be a valid HTTP/HTTPS URL with a public host'
    when m in (5, 6, 8, 12, 13, 14, 15, 17, 18, 19, 20) then 'invalid callbackUrl: host is on the SSRF deny-list (private, loopback, link-local, or metadata-endpoint address)'
    when m = 10 then 'invalid callbackToken: exceeds maximum length' end as error from s)
select k, case when error is null then 200 else 400 end::bigint as status, error from e""",
    "watch_bodies": """
with b as (select c_custkey, c_custkey % 9 as k, case c_custkey % 9 -- fixed values: the answers that clients see
  when 4 then 'txid is required' when 7 then 'txid is required' when 5 then 'callbackUrl is required'
  when 1 then 'invalid request body' when 2 then 'invalid request body' when 3 then 'invalid request body' when 6 then 'invalid request body' end as error from customer)
select c_custkey, case when error is null then 200 else 400 end::bigint as status, error from b""",
    "resolved_urls": "select s_suppkey as k, 'https://h' || (s_suppkey % 50)::varchar || '.example/cb' as url from supplier where s_suppkey % 50 not in (3, 4, 49)",
    "api_lookup": f"""
with {_REG}, a as (select c_custkey, {_rev("sha256('tx:' || c_custkey::varchar)")} as txid from customer), u as (select txid, string_agg(url, ',' order by url) as urls from reg group by txid)
-- fixed value: the answer that clients see
select c_custkey, case when c_custkey % 7 = 0 then 400 else 200 end::bigint as status, case when c_custkey % 7 = 0 then 'invalid txid format: must be a 64-character hex string' end as error,
  case when c_custkey % 7 <> 0 then coalesce(urls, '') end as urls from a left join u using (txid)""",
    "watch_admission": f"""
-- fixed values: the answers that clients see
with {_REG}, q as (select txid, case when s2 = 4 then 'ftp://x/' else url end as u, seq from ev),
p as (select txid, u, min(seq) as w from q where u <> 'ftp://x/' group by txid, u
  union all select {_rev("sha256('tx:' || o_orderkey::varchar)")}, 'https://known.example/', 0 from orders where o_orderpriority = '1-URGENT'),
r as (select *, row_number() over (partition by txid order by w, u) as slot from p)
select txid, u as "callbackUrl", case when u = 'ftp://x/' then 400 when max(slot) > 2 then 429 else 200 end::bigint as status, count(*) as n,
  case when u = 'ftp://x/' then 'invalid callbackUrl: must be a valid HTTP/HTTPS URL with a public host' when max(slot) > 2 then 'too many callback URLs registered for this txid' end as error
from q left join r using (txid, u) group by txid, u""",
    "registration_latest_token": f"with {_REG} select txid, url, token from reg",
    "registration_cap": f"with {_REG} select * from (select txid, url, row_number() over (partition by txid order by first_seq, url) as slot from reg) where slot <= 3",
    "registration_over_cap": f"with {_REG} select txid, count(*) as refused from (select txid, row_number() over (partition by txid order by first_seq, url) as slot from reg) where slot > 3 group by txid",
    "registration_point_get": f"with {_REG} select url, token from reg where txid = {_rev(chr(115) + 'ha256(' + chr(39) + 'tx:7' + chr(39) + ')')} order by url",
    "registration_missing_anti": f"with {_TX}, {_REG} select tx_key, txid from tx where txid not in (select txid from reg)",
    "registration_table": f"""with {_BATCHED}, none as (select '' as txid, '' as url, '' as token where false),
s0 as {_after("none", 0)},
due as (select {_rev("sha256('tx:' || o_orderkey::varchar)")} as txid, o_orderdate + interval 1 day as expires_at from orders where o_orderpriority = '1-URGENT'),
ttl as (select * from due where txid in (select txid from s0)),
s1 as {_after("s0", 1)}, swept as (select * from s1 where txid not in (select txid from ttl where expires_at < timestamp '1998-06-01')),
s2 as {_after("swept", 2)}
select txid, url, token, expires_at from s2 left join (select * from ttl where expires_at >= timestamp '1998-06-01') using (txid)""",
    "registration_table_lookup": f"""with {_BATCHED}, {_TX}, r as (select txid, url, arg_max(token, (batch, seq)) as token from ev group by all)
select height, subtree_index, leaf_index, txid, url, token from leaf join r using (txid)""",
    "registration_nested": f"with {_REG} select txid, string_agg(url || '|' || token, ',' order by url, token) as callbacks from reg group by txid",
    "ttl_update": f"with {_EXP} select txid, case when txid in (select user_id::varchar from events where event_type = 'purchase' and value > 150) then timestamp '2024-02-01 00:30:00' else expires_at end as expires_at from expiring",
    "ttl_sweep": f"""with {_EXP}, kept as (select txid from expiring where expires_at is null or expires_at >= timestamp '2024-01-31 12:00:00')
select k.txid, count(distinct {_url('event_id')}) as urls from kept k left join events e on e.user_id::varchar = k.txid group by k.txid""",
    "url_registry_upsert": f"with {_SEEN_URL} select url, max(last_seen) as last_seen, arg_max(token, seq) as token from us group by url",
    "url_registry_active": """with u as (select 'https://user-' || user_id::varchar || '.example/callback' as url, max(ts) as last_seen, 'tok-' || (max(event_id) % 7)::varchar as token from events group by user_id)
select url, token from u where token = 'tok-3' or last_seen >= timestamp '2024-01-31 12:00:00' - interval 1 day""",
    "seen_group_by_url": f"{_ALL} select height, subtree_index, url, coalesce(arg_min(token, leaf_index) filter (token <> ''), '') as token, count(*) as n, sha256(string_agg(txid, ',' order by txid)) as txids_sha256 from found group by height, subtree_index, url",
    "seen_message_json": f"""{_ALL}, c as (select *, (row_number() over (partition by block_hash, subtree_index, url order by txid) - 1) // 50 as chunk,
  coalesce(first_value(token) over (partition by block_hash, subtree_index, url order by token = '', leaf_index), '') as tok from found)
select block_hash || '/' || subtree_index as "subtreeHash", url as "callbackUrl", min(txid) as first_txid, '{{{{"callbackUrl":"' || url || '"' || case when any_value(tok) <> '' then ',"callbackToken":"' || any_value(tok) || '"' else '' end
  || ',"type":"SEEN_ON_NETWORK","txids":["' || string_agg(txid, '","' order by txid) || '"],"subtreeHash":"' || block_hash || '/' || subtree_index || '"}}}}' as value
from c group by block_hash, subtree_index, url, chunk""".replace("{{", "{").replace("}}", "}"),
    "seen_chunked": f"""{_ALL} select block_hash, subtree_index, url, chunk, count(*) as n, {_SET('list(txid)')} as set_hash
from (select *, (row_number() over (partition by block_hash, subtree_index, url order by txid) - 1) // 2 as chunk from found) group by block_hash, subtree_index, url, chunk""",
    "seen_distinct_count": f"with {_OBS} select txid, count(distinct subtree_id) as n from obs group by txid",
    "seen_threshold_fire": f"with {_OBS}, {_FIRED(3)} select * from fired",
    "seen_threshold_fire_55": f"with {_OBS}, {_FIRED(55)} select * from fired",
    "seen_multiple_nodes": f"with {_OBS}, {_FIRED(3)} select subtree_id, {_url('txid::bigint')} as url, count(*) as n, string_agg(txid, ',' order by txid) as txids from fired group by subtree_id, {_url('txid::bigint')}",
    "message_dedup": f"with {_OBS} select subtree_id, min(ts) as ts, arg_min(seq, (ts, seq)) as seq from obs group by subtree_id",
    "partition_key": f"""with {_TX}, {_MSG} select block_hash, subtree_index, type, case when subtree <> '' then subtree || '|' || url
  when block <> '' and type = 'BLOCK_PROCESSED' then block || '|' || url when block <> '' then block || '#' || idx || '|' || url else url end as partition_key from msg""",
    "idempotency_key": f"with {_TX}, {_MSG} select block_hash, subtree_index, type, case when scope = '' then '' else scope || ':' || type end as idempotency_key from key",
    "dedup_key": f"""with {_TX}, {_MSG}, bare as (select block_hash, subtree_index, type, case when subtree_index % 3 <> 2 then sha256(scope || ':' || url || ':' || type) end as dedup_key, subtree_index % 3 = 2 as b from key)
select distinct block_hash, subtree_index, case when b and type = 'STUMP' then 'BLOCK_PROCESSED' else type end as type, dedup_key from bare""",
    "callback_payload_json": f"""with {_TX}, {_MSG} select block_hash, subtree_index, type as kind, '{{{{"type":"' || type || '"' || case when txid <> '' then ',"txid":"' || txid || '"' else '' end
  || case when len(txids) > 0 then ',"txids":["' || array_to_string(txids, '","') || '"]' else '' end || case when block <> '' then ',"blockHash":"' || block || '"' else '' end
  || case when idx <> 0 then ',"subtreeIndex":' || idx else '' end || '}}}}' as payload from msg""".replace("{{", "{").replace("}}", "}"),
    "txid_set_hash": f"{_ALL} select block_hash, subtree_index, url, {_SET('list(distinct txid)')} as set_hash from found group by block_hash, subtree_index, url",
    "txids_json_list": f"""{_ALL} select block_hash, subtree_index, url, sha256('["' || string_agg(txid, '","' order by txid) || '"]') as digest, count(*) as n, max(txid) as last_txid
from found group by block_hash, subtree_index, url""",
    "hash_partition": f"""with {_SEEN_URL}, h as (select distinct url, sha256(url) as h from us), n as (select *, ('0x' || substr(h, 1, 8))::bigint as v from h)
select url, substr(h, 1, 16) as short_hash, case when v >= 2147483648 then v - 4294967296 else v end as int32 from n""",
    "compact_size": f"""with v as (select o_orderkey as k, case o_orderkey % 4 when 0 then o_orderkey * 1000003 when 1 then o_orderkey % 300 when 2 then o_orderkey * 97 else o_orderkey * 5000000007 end as v from orders)
select k, {_compact('v')} as encoded from v""",
    "backoff": "select p_partkey as k, least(10000, 500 * (1 << (p_partkey % 9)::int))::bigint as exponential_ms, (p_partkey % 9 + 1) * 30 as linear_s from part",
    "block_fanout": f"with {_TX}, {_SUB} select block_hash, height, subtree_index, subtree_hash from sub",
    "merkle_levels": f"with {_TX}, {_LEVELS} select height, subtree_index, level::bigint as level, pos as \"offset\", hash from lev join siz using (block_hash, subtree_index)",
    "tree_layout": f"with {_TX}, {_LEVELS} select height, subtree_index, level::bigint as level, pos as \"offset\", (pos + 0.5) * 100 * pow(2, level) as x, -level * 100.0::double as y from lev join siz using (block_hash, subtree_index)",
    "merkle_root": f"with {_TX}, {_LEVELS} select block_hash, subtree_index, n, arg_max(hash, level) as root from lev join siz using (block_hash, subtree_index) group by all",
    "merkle_root_4096": f"with {_TX.replace('n // 64', 'n // 4096').replace('n % 64', 'n % 4096')}, {_REG}, {_FOUND}, {_levels(12)}, {_NODES}, {_ENC}, rt as (select block_hash, subtree_index, arg_max(hash, level) as root from lev group by all) select block_hash, subtree_index, n, root, sha256(unhex(stump_hex)) as stump_ref from siz join rt using (block_hash, subtree_index) left join enc using (block_hash, subtree_index)",
    "merkle_large_subtree": f"""with leaf as materialized (select 'large' as block_hash, (o_orderkey * 16 + i) >> 18 as subtree_index, 900000 as height, (o_orderkey * 16 + i) % 262144 as leaf_index,
  sha256('out:' || o_orderkey::varchar || ':' || i::varchar) as raw_hex, i = 0 and o_totalprice > 499000 as own from orders, range(16) t(i)),
{_levels(18).replace(" as (", " as materialized (")}, found as (select * from leaf where own), {_NODES}, {_ENC},
rt as (select block_hash, subtree_index, arg_max(hash, level) as root, max(level) as tree_height from lev group by all)
select subtree_index, n, tree_height, root, coalesce(n_nodes, 0) as n_nodes, sha256(unhex(stump_hex)) as stump_ref
from siz join rt using (block_hash, subtree_index) left join (select subtree_index, count(*) as n_nodes from nodes group by all) using (subtree_index) left join enc using (subtree_index)""",
    "stump_nodes": f"{_PROOF} select {_NODE_COLS} from nodes",
    "stump_encode_hex": f"{_PROOF}, {_ENC} select block_hash, subtree_index, stump_hex from enc",
    "stump_ref": f"{_PROOF}, {_ENC} select block_hash, subtree_index, sha256(unhex(stump_hex)) as stump_ref from enc",
    "stump_decode": f"{_PROOF} select {_NODE_COLS} from nodes",
    "stump_verify": f"{_PROOF} select block_hash, subtree_index, leaf_index, true as ok from r",
    "stump_merge": f"{_PROOF} select {_NODE_COLS} from nodes",
    "stump_root": f"{_PROOF}, rt as (select block_hash, subtree_index, arg_max(hash, level) as root from lev group by all) select distinct block_hash, subtree_index, root, true as ok from rt join (select distinct block_hash, subtree_index from nodes) using (block_hash, subtree_index)",
    "stump_callbacks": f"""{_PROOF}, {_ENC}, u as (select block_hash, subtree_index, url, coalesce(arg_max(token, leaf_index) filter (token <> ''), '') as token from found group by all)
select block_hash, subtree_index, url, token, sha256(unhex(stump_hex)) as stump_ref from u join enc using (block_hash, subtree_index)""",
    "subtree_countdown": f"with {_TX}, {_WORK} select * from cd",
    "running_remaining": f"""with {_TX}, {_WORK} select block_hash, subtree_index,
  expected - count(*) over (partition by block_hash order by subtree_index rows unbounded preceding) as remaining from finished join expected using (block_hash)""",
    "block_processed_broadcast": f"""with {_TX}, {_WORK}, {_SEEN_URL}, u as (select url, max(last_seen) as last_seen, arg_max(token, seq) as token from us group by url)
select block_hash, url, token from cd, u where remaining <= 0 and last_seen >= timestamp '2024-02-01' - interval 7 day""",
    "accumulator_drain": f"""{_ALL}, e as (select block_hash, url, subtree_index, {_SET('list(txid)')} as h from found group by block_hash, url, subtree_index)
select block_hash, url, string_agg(subtree_index::varchar || ':' || h, ',' order by subtree_index) as entries from e group by block_hash, url""",
    "dah_prune": f"with {_TX} select distinct block_hash, subtree_index from leaf where subtree_index = 0 or height + 10 > 800040",
    "delivery_dedup": f"""with a as (select user_id as key, {_url('user_id')} as url, event_type, ts from events),
done as (select distinct key, event_type from a where event_type = 'purchase' and ts + interval 1 day > timestamp '2024-01-30 12:00:00')
select key, url, count(*) as n from a where (key, event_type) not in (select (key, event_type) from done) group by key, url""",
    "delivery_retry_schedule": f"{_TRY(chr(101) + 'vent_type <> ' + chr(39) + 'error' + chr(39))} select key, seq, retry, state, next_at from d",
    "delivery_outcome": f"{_TRY(chr(101) + 'vent_type <> ' + chr(39) + 'error' + chr(39))} select key, count(*) as tries, arg_max(state, retry) as state from d group by key",
    "dlq_rows": f"{_TRY(chr(101) + 'vent_type = ' + chr(39) + 'purchase' + chr(39))} select key, url, seq, retry from d where state = 'dlq'",
    "due_messages": f"{_TRY(chr(101) + 'vent_type = ' + chr(39) + 'purchase' + chr(39))} select key, seq, next_at is null or next_at <= timestamp '2024-01-01 06:00:02' as due from d",
    "delivery_latency_percentiles": """with o as (select o_totalprice as v, row_number() over (order by o_totalprice) as r, count(*) over () as n from orders)
select any_value(n) as n, min(v) as least, max(v) as most, min(v) filter (r >= ceil(0.5 * n)) as p50, min(v) filter (r >= ceil(0.95 * n)) as p95, min(v) filter (r >= ceil(0.99 * n)) as p99 from o""",
    "scale_duplicates": f"with {_REG} select txid, url, count(*) as n from ev group by txid, url having count(*) > 1",
    "recent_callbacks": f"select user_id as key, {_url('user_id')} as url, event_id as seq, ts, event_type <> 'error' as ok from events order by ts desc, event_id desc limit 100",
    "receiver_report": f"select {_url('user_id')} as url, count(*) as n, count(*) filter (event_type <> 'error') as ok, sum(length(event_type))::bigint as bytes, min(ts) as first_at, max(ts) as last_at from events group by 1",
    "missing_and_unexpected": f"{_ALL}, got as (select distinct txid, url from found where height < 800040) select 'missing' as what, count(*) as n from reg where (txid, url) not in (select (txid, url) from got) having count(*) > 0",
    "fixture_cover": """with f as (select i, i % 16 as subtree_index, sha256(unhex(lpad(to_hex(42), 16, '0') || lpad(lower(to_hex(i)), 16, '0'))) as h from range((select count(*) from orders)) t(i))
select subtree_index, count(*) as n, count(distinct h) as distinct_n, min(h) as first_hex from f group by subtree_index""",
    "exact_cover": f"with {_TX}, e as (select raw_hex, count(*) as n_leaves, count(distinct (block_hash, subtree_index)) as n_subtrees from leaf group by raw_hex) select n_leaves, n_subtrees, count(*) as n_txids, min(raw_hex) as first_hex from e group by n_leaves, n_subtrees",
    "latest_sighting_gap": f"""with {_OBS}, g as (select subtree_id, epoch_us(ts) - epoch_us(lag(ts) over (partition by txid, subtree_id order by ts, seq)) as gap from obs)
select subtree_id, count(*) as n, max(gap) as longest_us from g where gap is not null group by subtree_id""",
    "proof_walk": f"{_PROOF} select block_hash, subtree_index, leaf_index, level, leaf_index >> level as own, xor(leaf_index >> level, 1) as other from (select *, unnest(range(0, tree_height)) as level from r)",
    "root_in_either_order": f"with {_TX} select distinct block_hash, subtree_index, subtree_index % 3 <> 2 as ok from leaf",
    "stump_validity": f"{_PROOF} select distinct block_hash, subtree_index, (subtree_index + height) % 4 = 0 as ok from r",
    "receiver_totals": f"""{_PROOF}, {_ENC}, {_WORK}, {_SEEN_URL}, m as (
  select url, 'STUMP' as type from (select distinct block_hash, subtree_index, url from found join enc using (block_hash, subtree_index))
  union all select url, 'BLOCK_PROCESSED' from cd, (select url, max(last_seen) as last_seen from us group by url) where remaining <= 0 and last_seen >= timestamp '2024-02-01' - interval 7 day)
select url, count(*) as n, count(*) filter (type = 'STUMP') as stumps, count(*) filter (type = 'BLOCK_PROCESSED') as block_processed, sum(strlen(url))::bigint as bytes, 0::bigint as other, true as ok from m group by url""",
    "exactly_one_block_processed": f"""with {_TX}, {_WORK}, {_SEEN_URL}, u as (select url, max(last_seen) as last_seen from us group by url)
select block_hash, url, 1::bigint as n, true as ok from cd, u where remaining <= 0 and last_seen >= timestamp '2024-02-01' - interval 7 day""",
    "bulk_register_summary": "select s_suppkey % 24 in (0, 9, 11, 16) as ok, count(*) as n from supplier group by 1",
    "registry_keys": f"with {_SEEN_URL} select distinct url, sha256(url) as key, url as trimmed from us",
    "appended_values": f"with {_OBS} select txid, sha256(string_agg(subtree_id, '' order by ts, seq)) as digest from obs group by txid",
    "tracked_txids": f"with {_SEEN_URL} select token as txid, arg_max(url, last_seen) as urls, min(last_seen) as first_at from us group by token",
    "running_dedup_hits": f"with {_OBS} select subtree_id, count(*) - 1 as suppressed from obs group by subtree_id",
    "dead_letters_also_count_down": f"with {_TX}, {_WORK} select block_hash, remaining, 0::bigint as after_dlq from cd",
}
