"""The SQL counterpart of every registered query, for an independent engine over the same tables.

``TABLES`` derives the historian tables; a query's text gets those it names as common table
expressions.
"""

from __future__ import annotations

import re

AS_OF = "2024-01-31T00:00:00.000Z"
AS_OF_MS = 1706659200000
DAY_0 = 1704067200000
DAY = 86400000
W = 21600000
SITE = "a_b_c"  # 'a/b:c' as a file name
PLC = 7
START, END = DAY_0 + 5 * DAY, DAY_0 + 12 * DAY
CUTOFF = AS_OF_MS - 10 * DAY
BAND = 5.0


def iso(ms: str) -> str:
    return f"strftime(make_timestamp(({ms}) * 1000), '%Y-%m-%dT%H:%M:%S.') || lpad((({ms}) % 1000)::VARCHAR, 3, '0') || 'Z'"


def stamp(ms: str, form: str) -> str:
    return f"strftime(make_timestamp(({ms}) * 1000), '{form}')"


def number(value: str) -> str:
    return f"regexp_replace({value}::VARCHAR, '\\.0$', '')"


def csv(text: str) -> str:
    return (
        f"CASE WHEN regexp_matches({text}, '[,\"\\n\\r]') "
        f"THEN '\"' || replace({text}, '\"', '\"\"') || '\"' ELSE {text} END"
    )


def window_file(start: str) -> str:
    return f"'{SITE}-' || {stamp(start, '%Y%m%dT%H%MZ')} || '.parquet'"


def quality_name(code: str) -> str:
    return f"CASE {code} WHEN 0 THEN 'Good' WHEN 2 THEN 'Bad' ELSE 'Uncertain' END"


SHOWN = f"coalesce({number('value')}, value_text, '')"
ENDPOINT_RE = r"(?i)^opc\.tcp://([^\s/?#:\[\]]+)(:\d{1,5})?([/?#]\S*)?$"
POLICIES = "('none', 'basic256sha256', 'basic128rsa15', 'aes128_sha256_rsaoaep', 'aes256_sha256_rsapss')"


def plc_error(name: str, url: str, policy: str) -> str:
    return f"""CASE
      WHEN trim({name}) = '' THEN 'Name is required.'
      WHEN trim({url}) = '' THEN 'Endpoint URL is required.'
      WHEN NOT regexp_matches({url}, '{ENDPOINT_RE}') THEN 'Endpoint must be a valid opc.tcp:// URL (got ''' || {url} || ''').'
      WHEN lower({policy}) NOT IN {POLICIES} THEN 'Unknown security policy ''' || {policy} || '''.' END"""


def gated_steps(source: str, flag: str) -> str:
    """Deadband by recursion: ``source`` has id, tag_id, value, band and the gate ``flag``."""
    return f"""
    gated AS (SELECT id, tag_id, value, band, row_number() OVER (PARTITION BY tag_id ORDER BY id) AS n
              FROM {source} WHERE {flag}),
    steps(tag_id, n, id, last, kept) AS (
      SELECT tag_id, n, id, value, true FROM gated WHERE n = 1
      UNION ALL
      SELECT g.tag_id, g.n, g.id, CASE WHEN abs(g.value - s.last) < g.band THEN s.last ELSE g.value END,
             NOT abs(g.value - s.last) < g.band
      FROM steps s JOIN gated g ON g.tag_id = s.tag_id AND g.n = s.n + 1)"""


TABLES: dict[str, str] = {
    "plcs": """SELECT n_nationkey::INT AS plc_id, n_name AS name,
        'opc.tcp://10.0.' || n_regionkey || '.' || n_nationkey || ':4840' AS endpoint_url,
        CASE WHEN n_regionkey = 0 THEN 'None' ELSE 'Basic256Sha256' END AS security_policy FROM nation
        UNION ALL SELECT 25, 'SPARE', 'opc.tcp://10.0.9.25:4840', 'None'""",
    "tags": """SELECT c_custkey::INT AS tag_id, c_nationkey::INT AS plc_id,
        CASE WHEN c_custkey % 11 = 0 THEN 'ns=0;i=' || c_custkey
             WHEN c_custkey % 11 = 1 THEN 'ns=4;s=|vprop|' || n_name || '.' || c_name
             ELSE 'ns=4;s=|var|' || n_name || '.Application.' || c_mktsegment || '.fb_' || (c_custkey % 5) || '.' || c_name END AS node_id,
        CASE WHEN c_custkey % 11 IN (0, 1) THEN c_name
             ELSE c_mktsegment || '.fb_' || (c_custkey % 5) || '.' || c_name END AS tag_name,
        'Double' AS data_type, NULL::VARCHAR AS units,
        CASE c_custkey % 3 WHEN 0 THEN 20.0::DOUBLE WHEN 1 THEN 0.0::DOUBLE END AS deadband_override,
        '2024-01-01T00:00:00.000Z' AS first_seen_at, '2024-01-01T00:00:00.000Z' AS last_seen_at,
        CASE WHEN c_custkey % 13 = 0 THEN 0 ELSE 1 END AS active,
        CASE WHEN c_custkey % 7 = 0 THEN 0 ELSE 1 END AS enabled
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "readings": """SELECT event_id + 1 AS id, user_id::INT AS tag_id, epoch_us(ts) // 1000 AS ts_utc,
        CASE WHEN event_id % 97 <> 0 THEN epoch_us(ts) // 1000 + event_id % 5000 END AS ts_received_utc,
        CASE WHEN event_type <> 'view' THEN value END AS value,
        CASE WHEN event_type = 'view' THEN props END AS value_text,
        CASE event_type WHEN 'error' THEN 2 WHEN 'signup' THEN 1 ELSE 0 END AS quality FROM events""",
    "named": """SELECT r.*, t.plc_id, t.tag_name, p.name AS plc_name FROM readings r
        JOIN tags t ON t.tag_id = r.tag_id JOIN plcs p ON p.plc_id = t.plc_id""",
    "raw": """SELECT p.name AS plc_name, t.node_id, t.tag_id AS raw_tag, event_id + 1 AS seq, event_type, value AS raw_value, props,
        CASE WHEN event_id % 101 = 0 THEN (epoch_us(ts) + 1000 * (event_id % 5000)) // 1000 ELSE epoch_us(ts) // 1000 END AS ts_utc,
        (epoch_us(ts) + 1000 * (event_id % 5000)) // 1000 AS ts_received_utc,
        event_id % 103 = 0 AS dropped
        FROM events JOIN tags t ON t.tag_id = user_id JOIN plcs p ON p.plc_id = t.plc_id""",
    "normal": """SELECT seq AS id, plc_name, node_id, raw_tag, ts_utc, ts_received_utc,
        CASE event_type WHEN 'view' THEN NULL WHEN 'purchase' THEN (CASE WHEN raw_value > 50 THEN 1.0 ELSE 0.0 END)::DOUBLE
             ELSE CASE WHEN NOT dropped THEN raw_value END END AS value,
        CASE WHEN event_type = 'view' THEN props END AS value_text,
        CASE event_type WHEN 'error' THEN 2 WHEN 'signup' THEN 1 ELSE 0 END AS quality,
        CASE event_type WHEN 'view' THEN 'String' WHEN 'purchase' THEN 'Boolean'
             ELSE CASE WHEN dropped THEN 'Null' ELSE 'Double' END END AS data_type FROM raw""",
    "live": """SELECT n.id, n.raw_tag AS tag_id, n.plc_name, n.ts_utc, n.ts_received_utc, n.value, n.value_text, n.quality, n.data_type
        FROM normal n JOIN tags t ON t.tag_id = n.raw_tag WHERE t.active = 1 AND t.enabled = 1""",
    "bands": f"""SELECT tag_id, coalesce(deadband_override, {BAND}) AS band FROM tags
        WHERE coalesce(deadband_override, {BAND}) > 0""",
    "windows": f"""SELECT ts_utc // {W} * {W} AS partition_start, count(*) AS row_count, max(id) AS max_reading_id
        FROM named GROUP BY 1""",
    "manifest": f"""SELECT partition_start, 6 AS partition_hours, {window_file('partition_start')} AS file_name,
        row_count, max_reading_id, '{AS_OF}' AS exported_at,
        CASE WHEN (partition_start - {DAY_0}) // {W} % 4 <> 3 THEN '{AS_OF}' END AS uploaded_at,
        CASE WHEN (partition_start - {DAY_0}) // {W} % 5 = 0 AND (partition_start - {DAY_0}) // {W} % 4 <> 3
             THEN 1 ELSE 0 END AS local_deleted FROM windows""",
    "old_manifest": f"SELECT * FROM manifest WHERE partition_start < {DAY_0 + 25 * DAY}",
    "plc_stats": f"""SELECT plc_id, plc_name, count(*) AS row_count, max(id) AS max_reading_id,
        {iso('arg_min(ts_utc, id)')} AS period_start, {iso('arg_max(ts_utc, id)')} AS period_end
        FROM named GROUP BY 1, 2""",
    "half_stats": f"""SELECT plc_id, plc_name, count(*) AS row_count, max(id) AS max_reading_id
        FROM named WHERE ts_utc < {DAY_0 + 15 * DAY} GROUP BY 1, 2""",
    "export_state": f"""SELECT plc_id, '{SITE}-' || plc_name || '.csv' AS file_name,
        'exports/{SITE}-' || plc_name || '.csv' AS file_path, max_reading_id AS last_reading_id, row_count,
        '2024-01-01T00:00:00.000Z' AS exported_at,
        CASE plc_id % 3 WHEN 0 THEN max_reading_id WHEN 1 THEN max_reading_id // 2 ELSE 0 END AS uploaded_reading_id,
        CASE WHEN plc_id % 3 <> 2 THEN '2024-01-01T00:00:00.000Z' END AS uploaded_at,
        CASE plc_id % 3 WHEN 0 THEN 'Uploaded' WHEN 1 THEN 'Pending' ELSE 'UploadFailed' END AS status FROM half_stats""",
    "settings": f"""SELECT 'parquet_export_cursor' AS key, '{DAY_0 + 10 * DAY}' AS value
        UNION ALL SELECT 'backup_uploaded_reading_id', (max(id) * 3 // 10)::VARCHAR FROM readings""",
    "window_outcomes": f"""SELECT partition_start, {window_file('partition_start')} AS file_name,
        CASE WHEN (partition_start - {DAY_0}) // {W} = 91 THEN 'failed'
             WHEN (partition_start - {DAY_0}) // {W} % 47 = 43 THEN 'missing' ELSE 'ok' END AS outcome FROM windows""",
    "discovered": """SELECT plc_id, CASE WHEN tag_id % 10 = 0 THEN node_id || '_v2' ELSE node_id END AS node_id,
        tag_name, tag_id::BIGINT * 10 AS seq FROM tags
        UNION ALL SELECT plc_id, node_id, tag_name || '_dup', tag_id::BIGINT * 10 + 1 FROM tags WHERE tag_id % 10 = 1""",
    "folders": """SELECT DISTINCT plc_id, path FROM (
        SELECT plc_id, split_part(tag_name, '.', 1) AS path FROM tags WHERE tag_id % 11 > 1
        UNION ALL SELECT plc_id, split_part(tag_name, '.', 1) || '.' || split_part(tag_name, '.', 2) FROM tags WHERE tag_id % 11 > 1)""",
    "edges": """
        SELECT p.name AS plc_name, CASE WHEN tag_id % 11 < 2 THEN 'i=85' ELSE
                 'ns=4;s=folder|' || split_part(tag_name, '.', 1) || '.' || split_part(tag_name, '.', 2) END AS parent,
               node_id AS child, 'Variable' AS node_class,
               CASE WHEN tag_id % 17 <> 0 THEN split_part(tag_name, '.', -1) END AS display_name,
               CASE WHEN tag_id % 34 <> 0 THEN split_part(tag_name, '.', -1) END AS browse_name
        FROM tags JOIN plcs p USING (plc_id)
        UNION ALL SELECT name, CASE WHEN contains(path, '.') THEN 'ns=4;s=folder|' || split_part(path, '.', 1) ELSE 'i=85' END,
               'ns=4;s=folder|' || path, 'Object', NULL, NULL FROM folders JOIN plcs USING (plc_id)
        UNION ALL SELECT name, 'i=85', 'ns=4;s=hub', 'Object', NULL, NULL FROM plcs
        UNION ALL SELECT name, 'ns=4;s=hub', node_id, 'Variable', split_part(tag_name, '.', -1), NULL
               FROM tags JOIN plcs USING (plc_id) WHERE tag_id % 9 = 0
        UNION ALL SELECT name, 'ns=4;s=hub', 'i=85', 'Object', NULL, NULL FROM plcs
        UNION ALL SELECT name, 'ns=4;s=hub', 'ns=4;s=|var|M.Application.reset', 'Method', NULL, NULL FROM plcs
        UNION ALL SELECT name, 'i=85', 'i=2253', 'Object', NULL, NULL FROM plcs
        UNION ALL SELECT name, 'i=2253', 'ns=4;s=|var|S.Application.diag' || tag_id, 'Variable', split_part(tag_name, '.', -1), NULL
               FROM tags JOIN plcs USING (plc_id) WHERE tag_id % 8 = 0
        UNION ALL SELECT name, CASE WHEN n = 1 THEN 'i=85' ELSE 'ns=4;s=|var|C.Application.chain' || (n - 1) END,
               'ns=4;s=|var|C.Application.chain' || n, 'Variable', NULL, NULL FROM plcs, range(1, 35) AS r(n)""",
    "walk": """SELECT name AS plc_name, 'i=85' AS node, 0 AS depth FROM plcs
        UNION SELECT e.plc_name, e.child, w.depth + 1 FROM walk w JOIN edges e ON e.plc_name = w.plc_name AND e.parent = w.node
        WHERE e.node_class IN ('Object', 'Variable') AND e.child <> 'i=2253' AND w.depth < 30""",
    "leafs": """SELECT plc_name, parent, child, coalesce(display_name, browse_name, child) AS leaf FROM edges WHERE node_class = 'Variable'""",
    "found": """SELECT plc_name, child AS node_id, min(CASE WHEN contains(child, '.Application.')
               THEN substr(child, strpos(child, '.Application.') + 13) ELSE leaf END) AS tag_name
        FROM leafs WHERE (plc_name, parent) IN (SELECT plc_name, node FROM walk)
          AND starts_with(child, 'ns=4;') AND contains(lower(child), '|var|') AND contains(lower(child), '.application.')
        GROUP BY 1, 2""",
    "entries": """SELECT c_custkey // 10 AS site, (c_custkey % 10)::INT AS position, c_custkey AS k,
        CASE WHEN c_custkey % 37 = 0 THEN '  '
             WHEN c_custkey % 10 = 9 AND (c_custkey // 10) % 4 = 0 THEN 'plc_' || (c_custkey // 10) || '_8'
             ELSE 'PLC_' || (c_custkey // 10) || '_' || (c_custkey % 10) END AS name,
        CASE WHEN c_custkey % 23 = 0 THEN 'http://10.0.0.' || (c_custkey % 10) WHEN c_custkey % 29 = 0 THEN ''
             ELSE 'opc.tcp://10.' || ((c_custkey // 10) % 250) || '.0.' || (c_custkey % 10) || ':4840' END AS endpoint_url,
        CASE WHEN c_custkey % 19 = 0 THEN 'Basic999' WHEN c_custkey % 3 = 0 THEN 'none' ELSE 'Basic256Sha256' END AS security_policy
        FROM customer WHERE (c_custkey // 10) % 8 <> 5""",
    "sites": """SELECT s AS site, CASE WHEN s % 7 = 0 THEN '' WHEN s % 11 = 0 THEN 'a/b:c' ELSE 'Site ' || s END AS site_name,
        s % 17 <> 0 AS scheduled, ['Interval', 'Daily', 'Weekly', 'Monthly'][s % 4 + 1] AS mode,
        (30 * (s % 20))::INT AS interval_minutes, CASE WHEN s % 13 = 0 THEN '' ELSE '02:00' END AS daily_at,
        (s % 9)::INT AS day_of_week, (s % 31)::INT AS day_of_month, (6 * (s % 9))::INT AS partition_hours, s % 2 = 0 AS keep,
        (30 * (s % 5))::INT AS retention_days,
        CASE s % 6 WHEN 0 THEN 'Dropbox' WHEN 1 THEN 'GoogleDrive' ELSE 'None' END AS provider,
        CASE WHEN s % 12 = 1 THEN '' ELSE 'google_client.json' END AS credentials
        FROM (SELECT DISTINCT c_custkey // 10 AS s FROM customer)""",
    "periods": """SELECT *, CASE mode WHEN 'Interval' THEN greatest(interval_minutes, 1) / 60.0::DOUBLE WHEN 'Weekly' THEN 168.0::DOUBLE
        WHEN 'Monthly' THEN 672.0::DOUBLE ELSE 24.0::DOUBLE END AS period FROM sites WHERE scheduled""",
    "doubles": """SELECT site, lower(name) AS name_key, arg_min(name, position) AS name, count(*) AS copies
        FROM entries GROUP BY 1, 2 HAVING count(*) > 1""",
    "issues": f"""
        SELECT site, 'Warning' AS severity, 'Site name is empty: export files will carry the default name.' AS message
          FROM sites WHERE site_name = ''
        UNION ALL SELECT site, 'Warning', 'No PLCs are configured — nothing will be logged until one is added.' FROM sites WHERE site % 8 = 5
        UNION ALL SELECT site, 'Error', 'PLC ''' || name || ''': ' || error FROM
          (SELECT site, name, {plc_error('name', 'endpoint_url', 'security_policy')} AS error FROM entries) WHERE error IS NOT NULL
        UNION ALL SELECT site, 'Error', 'Duplicate PLC name ''' || name || ''' — names must be unique.' FROM doubles
        UNION ALL SELECT site, 'Error', 'Unknown upload provider ''Dropbox'' (expected None or GoogleDrive).' FROM sites WHERE provider = 'Dropbox'
        UNION ALL SELECT site, 'Error', 'Upload.GoogleDrive.CredentialsPath is required when the provider is GoogleDrive.'
          FROM sites WHERE provider = 'GoogleDrive' AND credentials = ''""",
    "registry": """SELECT site, arg_max(name, position) AS name, arg_max(endpoint_url, position) AS endpoint_url,
        arg_max(security_policy, position) AS security_policy, lower(name) AS k FROM entries WHERE trim(name) <> '' GROUP BY site, lower(name)""",
    "changes": """SELECT site, upper(name) AS name, 'opc.tcp://old:4840' AS endpoint_url, security_policy, site * 100 + position * 2 AS seq
          FROM entries WHERE trim(name) <> '' AND position % 2 = 0
        UNION ALL SELECT site, upper(name), CASE WHEN position % 4 = 0 THEN endpoint_url ELSE 'opc.tcp://moved:4840' END,
          upper(security_policy), site * 100 + position * 2 + 1 FROM entries WHERE trim(name) <> '' AND position % 2 = 0
        UNION ALL SELECT site, 'New', CASE WHEN site % 2 = 0 THEN 'opc.tcp://new:4840' ELSE 'new' END, 'None', site * 100 + position * 2 + 50
          FROM entries WHERE trim(name) <> '' AND position = 1""",
    "edited": """SELECT site, name, endpoint_url, security_policy, k FROM registry
          WHERE (site, k) NOT IN (SELECT (site, lower(name)) FROM changes)
        UNION ALL SELECT site, arg_max(name, seq), arg_max(endpoint_url, seq), arg_max(security_policy, seq), lower(name)
          FROM changes GROUP BY site, lower(name)""",
    "happenings": """SELECT event_id AS seq, name AS plc_name,
        CASE WHEN event_type = 'error' THEN 'removed' WHEN event_type IN ('click', 'purchase') THEN 'connected' ELSE 'disconnected' END AS kind,
        endpoint_url, CASE WHEN event_type = 'signup' THEN 'lost ' || event_id END AS error, epoch_us(ts) // 1000 AS at_ms
        FROM events JOIN customer ON user_id = c_custkey JOIN plcs ON plc_id = c_nationkey""",
    "since": """SELECT h.* FROM happenings h LEFT JOIN (SELECT plc_name, max(seq) AS gone FROM happenings WHERE kind = 'removed' GROUP BY 1) r
        USING (plc_name) WHERE h.seq > coalesce(r.gone, -1)""",
    "synced": f"""SELECT
        coalesce(t.tag_id, (SELECT max(tag_id) FROM tags) + row_number() OVER (PARTITION BY t.tag_id IS NULL ORDER BY d.arrival))::INT AS tag_id,
        coalesce(t.plc_id, d.plc_id) AS plc_id, coalesce(t.node_id, d.node_id) AS node_id, coalesce(d.tag_name, t.tag_name) AS tag_name,
        CASE WHEN t.tag_id IS NULL THEN 'Unknown' ELSE t.data_type END AS data_type, t.units, t.deadband_override,
        coalesce(t.first_seen_at, '{AS_OF}') AS first_seen_at,
        CASE WHEN d.node_id IS NOT NULL THEN '{AS_OF}' ELSE t.last_seen_at END AS last_seen_at,
        CASE WHEN d.node_id IS NOT NULL THEN 1 WHEN t.plc_id <> 3 THEN 0 ELSE t.active END AS active, coalesce(t.enabled, 1) AS enabled
        FROM tags t FULL JOIN (SELECT plc_id, node_id, arg_max(tag_name, seq) AS tag_name, min(seq) AS arrival FROM discovered
                               WHERE plc_id NOT IN (3, 4) GROUP BY 1, 2) d ON d.plc_id = t.plc_id AND d.node_id = t.node_id""",
    "connections": f"""SELECT plc_name, arg_max(kind, seq) = 'connected' AS connected,
        coalesce(arg_max(endpoint_url, seq) FILTER (kind = 'connected'), '') AS endpoint_url,
        {iso("arg_max(at_ms, seq) FILTER (kind = 'connected')")} AS last_connected,
        nullif(arg_max(coalesce(error, ''), seq) FILTER (kind = 'connected' OR error IS NOT NULL), '') AS last_error FROM since GROUP BY 1""",
    "plc_figures": f"""SELECT p.plc_id, p.name, {iso('s.last')} AS last_sample, coalesce(c.found, 0) AS discovered_tags,
        coalesce(c.logged, 0) AS monitored_tags FROM plcs p
        LEFT JOIN (SELECT t.plc_id, max(l.ts_received_utc) AS last FROM live l JOIN tags t ON t.tag_id = l.tag_id GROUP BY 1) s ON s.plc_id = p.plc_id
        LEFT JOIN (SELECT plc_id, count(*) FILTER (active = 1) AS found, count(*) FILTER (active = 1 AND enabled = 1) AS logged FROM tags GROUP BY 1) c
          ON c.plc_id = p.plc_id""",
    "small_windows": f"""SELECT ts_utc // 14400000 * 14400000 AS partition_start FROM named WHERE ts_utc >= {DAY_0 + 20 * DAY} GROUP BY 1""",
    "resized": """SELECT partition_start, 4 AS partition_hours FROM small_windows UNION ALL SELECT partition_start, 6 FROM old_manifest
        WHERE partition_start NOT IN (SELECT partition_start FROM small_windows)""",
    "old_export": "SELECT * FROM export_state WHERE plc_id <> 11",
}


def _with(text: str) -> str:
    """Prefix ``text`` with the tables it names, in dependency order."""
    needed: list[str] = []
    adding: list[str] = []

    def add(part: str) -> None:
        for name, definition in TABLES.items():
            if name not in needed and name not in adding and re.search(rf"(FROM|JOIN)\s+{name}\b", part):
                adding.append(name)
                add(definition)
                needed.append(name)  # after what it depends on

    add(text)
    parts = []
    for name in needed:
        head = "walk(plc_name, node, depth)" if name == "walk" else name
        parts.append(f"{head} AS ({TABLES[name]})")
    if re.match(r"\w+ AS \(", text):  # the text brings tables of its own
        return f"WITH RECURSIVE {', '.join(parts)}, {text}"
    return f"WITH RECURSIVE {', '.join(parts)} {text}" if parts else text


def _deadband(source: str, flag: str) -> str:
    """Rows outside the gate, and the gated rows a recursion keeps."""
    return f"""source AS ({source}), {gated_steps('source', flag)}
    SELECT * EXCLUDE (band) FROM source WHERE NOT coalesce({flag}, false) OR id IN (SELECT id FROM steps WHERE kept)"""


_GATE = "value IS NOT NULL AND quality = 0 AND band IS NOT NULL"
_LIVE_ROWS = "SELECT l.* EXCLUDE (plc_name), band FROM live l LEFT JOIN bands b ON b.tag_id = l.tag_id"
_ACCEPTED = f"""source AS ({_LIVE_ROWS}), {gated_steps('source', _GATE)},
    accepted AS (SELECT * FROM source WHERE NOT coalesce({_GATE}, false) OR id IN (SELECT id FROM steps WHERE kept))"""
_WRITTEN = f"ts_utc < {END}"
_STORED = "SELECT r.*, band FROM readings r LEFT JOIN bands b ON b.tag_id = r.tag_id"
_COARSE = "(SELECT * REPLACE (floor(value / 20) * 20 AS value) FROM {})"


def _changed(table: str) -> str:
    return f"""SELECT * EXCLUDE (n, pv, pt, pq) FROM (
        SELECT *, row_number() OVER w AS n, lag(value) OVER w AS pv, lag(value_text) OVER w AS pt, lag(quality) OVER w AS pq
        FROM {_COARSE.format(table)} WINDOW w AS (PARTITION BY tag_id ORDER BY id))
      WHERE n = 1 OR value IS DISTINCT FROM pv OR value_text IS DISTINCT FROM pt OR quality IS DISTINCT FROM pq"""


def _recorded(table: str, stats: str, as_of: str) -> str:
    """``table`` (a manifest) after exporting the windows in ``stats``."""
    return f"""SELECT partition_start, 6 AS partition_hours, {window_file('partition_start')} AS file_name, row_count, max_reading_id,
          '{as_of}' AS exported_at, NULL::VARCHAR AS uploaded_at, 0 AS local_deleted FROM {stats}
        UNION ALL SELECT * FROM {table} WHERE partition_start NOT IN (SELECT partition_start FROM {stats})"""


def _uploaded(manifest: str, as_of: str, keep: bool) -> str:
    """A manifest after an upload cycle with the outcomes of ``window_outcomes``."""
    gone = "outcome = 'missing'" if keep else "outcome IN ('ok', 'missing')"
    return f"""SELECT * EXCLUDE (outcome, tried) REPLACE (
          CASE WHEN tried AND outcome = 'ok' THEN '{as_of}' ELSE uploaded_at END AS uploaded_at,
          CASE WHEN tried AND {gone} THEN 1 ELSE local_deleted END AS local_deleted)
        FROM (SELECT m.*, outcome, m.uploaded_at IS NULL AND m.local_deleted = 0 AND partition_start <= coalesce(min(
                CASE WHEN m.uploaded_at IS NULL AND m.local_deleted = 0 AND outcome = 'failed' THEN partition_start END) OVER (),
                9e18::BIGINT) AS tried
              FROM ({manifest}) m LEFT JOIN window_outcomes o USING (partition_start, file_name)) m"""


def _recorded_exports(old: str) -> str:
    return f"""SELECT s.plc_id, '{SITE}-' || s.plc_name || '.csv' AS file_name, 'exports/plc=' || s.plc_name AS file_path,
          s.max_reading_id AS last_reading_id, s.row_count, '{AS_OF}' AS exported_at,
          coalesce(o.uploaded_reading_id, 0) AS uploaded_reading_id, o.uploaded_at,
          CASE WHEN o.plc_id IS NULL OR s.max_reading_id > o.uploaded_reading_id THEN 'Pending' ELSE o.status END AS status
        FROM plc_stats s LEFT JOIN {old} o ON o.plc_id = s.plc_id"""


def _sent(state: str) -> str:
    """A CSV state after an upload run: controller 20 fails and ends the run, controller 7's file is missing."""
    return f"""SELECT * EXCLUDE (due, fails) REPLACE (
          CASE WHEN due AND plc_id < coalesce(fails, 99) AND plc_id <> 7 THEN 'Uploaded' WHEN plc_id = fails THEN 'UploadFailed' ELSE status END AS status,
          CASE WHEN due AND plc_id < coalesce(fails, 99) AND plc_id <> 7 THEN last_reading_id ELSE uploaded_reading_id END AS uploaded_reading_id,
          CASE WHEN due AND plc_id < coalesce(fails, 99) AND plc_id <> 7 THEN '{AS_OF}' ELSE uploaded_at END AS uploaded_at)
        FROM (SELECT *, max(CASE WHEN plc_id = 20 AND due THEN 20 END) OVER () AS fails FROM
          (SELECT *, last_reading_id > uploaded_reading_id OR status = 'UploadFailed' AS due FROM ({state})))"""


_TAG_FLAGS = "SELECT tag_id, active, {} AS enabled FROM tags t"
_EXPORT = f"""SELECT id, ts_utc, plc_name, tag_name, value, value_text, {quality_name('quality')} AS quality FROM named"""
_CSV = f"SELECT {iso('ts_utc')} AS timestamp_utc, plc_name, tag_name, {SHOWN} AS value, {quality_name('quality')} AS quality FROM named"
_SWEEP = "SELECT '{}' AS source, count(*) AS retained, min(id) AS min_id, sum(id)::BIGINT AS sum_id FROM readings WHERE {}"
_BACKUP = "(SELECT max(id) * 3 // 10 FROM readings)"
_UPLOADED_ID = "(SELECT max(max_reading_id) FROM manifest WHERE uploaded_at IS NOT NULL)"
_HALF = f"(id > (SELECT max(id) // 2 FROM readings) AND ts_utc < {DAY_0 + 20 * DAY})"
_LAST_CLOSED = f"{AS_OF_MS} // {W} * {W}"

_TEXTS: dict[str, str] = {
    "scan_plc": f"{_EXPORT} WHERE plc_id = {PLC}",
    "scan_plc_range_closed": f"{_EXPORT} WHERE ts_utc BETWEEN {START} AND {END}",
    "scan_range_half_open": f"""SELECT id, ts_utc, ts_received_utc, plc_name, tag_name, value, value_text, quality FROM named
        WHERE ts_utc >= {START} AND ts_utc < {END}""",
    "latest_n": f"""SELECT id, tag_name, {stamp('ts_utc', '%Y-%m-%d %H:%M:%S')} AS ts, value, quality FROM named ORDER BY id DESC LIMIT 20""",
    "normalise_notifications": """SELECT id, plc_name, node_id, ts_utc, ts_received_utc, value, value_text, quality, data_type FROM normal""",
    "resolve_tags": """SELECT n.id AS seq, plc_name, n.node_id, n.raw_tag AS tag_id FROM normal n JOIN tags t ON t.tag_id = n.raw_tag
        WHERE active = 1 AND enabled = 1""",
    "quality_codes": f"""SELECT {quality_name('quality')} AS quality, quality AS code, {quality_name('quality')} AS back, count(*) AS n
        FROM normal GROUP BY 1, 2, 3""",
    "iso_timestamps": f"""SELECT id, {iso('ts_utc')} AS iso, {stamp('ts_utc', '%Y-%m-%d %H:%M:%S')} AS seconds,
        {stamp('ts_utc', '%Y-%m-%d')} AS day, ts_utc // {W} * {W} AS window_start FROM readings""",
    "csv_lines": f"""SELECT id, {iso('ts_utc')} || ',' || {csv('plc_name')} || ',' || {csv('tag_name')} || ',' || {csv(SHOWN)} || ',' ||
        {quality_name('quality')} AS line FROM named""",
    "derive_tag_names": """SELECT plc_name, parent, child AS node_id, leaf, CASE WHEN contains(child, '.Application.')
        THEN substr(child, strpos(child, '.Application.') + 13) ELSE leaf END AS tag_name FROM leafs""",
    "tag_filter": """SELECT tag_id, CASE WHEN tag_id % 11 = 0 THEN 0 ELSE 4 END AS namespace,
        CASE WHEN tag_id % 11 = 0 THEN tag_id::VARCHAR ELSE substr(node_id, 8) END AS identifier, tag_id % 11 > 1 AS by_default,
        tag_id % 11 > 1 AND contains(node_id, '.MACHINERY.') AS by_token, true AS by_nothing FROM tags""",
    "file_names": f"""SELECT plc_name, s AS start, {window_file('s')} AS window_file, '{SITE}-' || plc_name || '.csv' AS rolling_file,
        '{SITE}-' || plc_name || '-' || {stamp('s', '%Y%m%d%H%M')} || '_' || {stamp(f's + {W}', '%Y%m%d%H%M')} || '.csv' AS range_file,
        'Site-' || plc_name || '.csv' AS unnamed_file FROM (SELECT DISTINCT plc_name, ts_utc // {W} * {W} AS s FROM named)""",
    "tag_path_parts": """SELECT tag_id, tag_name,
        CASE WHEN contains(tag_name, '.') THEN regexp_replace(tag_name, '\\.[^.]*$', '') ELSE '' END AS folder,
        split_part(tag_name, '.', -1) AS leaf, len(string_split(tag_name, '.'))::INT AS depth FROM tags""",
    "effective_deadband": "SELECT tag_id, band FROM bands",
    "deadbanded_tags": "SELECT count(*) AS deadbanded FROM bands",
    "registry_entries": "SELECT site, position, name, endpoint_url, security_policy FROM entries",
    "registry_validate": f"""SELECT site, position, name, endpoint_url, security_policy,
        {plc_error('name', 'endpoint_url', 'security_policy')} AS error FROM entries""",
    "schedule_validate": f"""SELECT site, mode, partition_hours, period AS upload_period_hours, CASE
        WHEN partition_hours < 1 THEN 'Partition size must be at least 1 hour.'
        WHEN partition_hours > period THEN 'Partition size (' || partition_hours || ' h) must be ≤ the upload period (' || {number('round(period, 1)')} || ' h).'
        WHEN mode = 'Interval' AND interval_minutes < 1 THEN 'Interval must be at least 1 minute.'
        WHEN mode = 'Weekly' AND day_of_week NOT BETWEEN 0 AND 6 THEN 'Day of week must be 0 (Sunday) to 6 (Saturday).'
        WHEN mode = 'Monthly' AND day_of_month NOT BETWEEN 1 AND 28 THEN 'Day of month must be 1 to 28.' END AS error FROM periods""",
    "duplicate_names": "SELECT site, name_key, name, copies FROM doubles",
    "config_issues": "SELECT site, severity, message FROM issues",
    "issue_counts": "SELECT severity, count(*) AS issues FROM issues GROUP BY 1",
    "config_report": "SELECT site, severity, count(*) AS issues FROM issues GROUP BY 1, 2",
    "config_backfill": """SELECT site, CASE WHEN site_name = '' THEN 'Seed' ELSE site_name END AS site_name,
        CASE WHEN lacks THEN 'Daily' ELSE mode END AS mode, CASE WHEN lacks THEN '03:30' ELSE daily_at END AS daily_at,
        CASE WHEN lacks THEN 360 ELSE interval_minutes END AS interval_minutes, CASE WHEN lacks THEN 6 ELSE partition_hours END AS partition_hours,
        CASE WHEN lacks THEN false ELSE keep END AS keep, CASE WHEN retention_days <= 0 THEN 45 ELSE retention_days END AS retention_days
        FROM (SELECT *, NOT scheduled OR daily_at = '' AS lacks FROM sites)""",
    "registry_upsert": "SELECT site, name, endpoint_url, security_policy FROM edited",
    "registry_remove": """SELECT site, name, endpoint_url, security_policy FROM registry
        WHERE (site, k) NOT IN (SELECT (site, lower(name)) FROM changes)""",
    "registry_diff": f"""SELECT site, name, CASE WHEN NOT wanted THEN 'remove' WHEN runs AND same THEN 'keep' WHEN runs AND error IS NOT NULL THEN 'remove'
          WHEN error IS NOT NULL THEN 'skip' WHEN runs THEN 'restart' ELSE 'start' END AS action,
          CASE WHEN wanted AND error IS NOT NULL AND NOT (runs AND same) THEN error END AS error
        FROM (SELECT coalesce(d.site, r.site) AS site, coalesce(d.name, r.name) AS name, d.site IS NOT NULL AS wanted, r.site IS NOT NULL AS runs,
            lower(r.endpoint_url) = lower(d.endpoint_url) AND lower(r.security_policy) = lower(d.security_policy) AS same,
            {plc_error('d.name', 'd.endpoint_url', 'd.security_policy')} AS error
          FROM registry r FULL JOIN (SELECT * FROM edited e WHERE NOT (site % 3 = 0 AND ends_with(k, '_3')
                 AND (site, k) IN (SELECT (site, k) FROM registry))) d
          ON r.site = d.site AND r.k = d.k)""",
    "logged_plcs": "SELECT plc_id, name FROM plcs WHERE plc_id IN (SELECT plc_id FROM tags)",
    "enabled_bindings": "SELECT plc_id, node_id, tag_id, deadband_override FROM tags WHERE active = 1 AND enabled = 1",
    "tag_selection": "SELECT plc_id, tag_id, tag_name, enabled <> 0 AS enabled FROM tags WHERE active = 1",
    "set_tags_enabled": _TAG_FLAGS.format(
        "CASE WHEN plc_id < 20 AND contains(tag_name, 'fb_2') THEN 1 WHEN plc_id < 20 AND active = 1 THEN 0 ELSE enabled END"
    ),
    "subtree_toggle": _TAG_FLAGS.format(
        f"CASE WHEN active = 0 THEN enabled WHEN plc_id = {PLC} AND starts_with(tag_name, 'HOUSEHOLD.') THEN 1 "
        "WHEN starts_with(tag_name, 'MACHINERY.fb_1.') THEN 0 ELSE enabled END"
    ),
    "folder_rollup": """SELECT plc_id, folder, count(*) AS leaves, sum(enabled)::BIGINT AS selected,
        CASE WHEN sum(enabled) = count(*) THEN 'all' WHEN sum(enabled) > 0 THEN 'partial' ELSE 'none' END AS state
        FROM (SELECT plc_id, '' AS folder, enabled FROM tags WHERE active = 1
              UNION ALL SELECT plc_id, split_part(tag_name, '.', 1), enabled FROM tags WHERE active = 1 AND contains(tag_name, '.')
              UNION ALL SELECT plc_id, split_part(tag_name, '.', 1) || '.' || split_part(tag_name, '.', 2), enabled
                FROM tags WHERE active = 1 AND contains(tag_name, '.')) GROUP BY 1, 2""",
    "sibling_order": """SELECT plc_id, CASE WHEN contains(tag_name, '.') THEN regexp_replace(tag_name, '\\.[^.]*$', '') ELSE '' END AS parent,
          split_part(tag_name, '.', -1) AS name, 1 AS is_leaf, tag_id FROM tags WHERE active = 1
        UNION ALL SELECT DISTINCT plc_id, '', split_part(tag_name, '.', 1), 0, NULL::INT FROM tags WHERE active = 1 AND contains(tag_name, '.')
        UNION ALL SELECT DISTINCT plc_id, split_part(tag_name, '.', 1), split_part(tag_name, '.', 2), 0, NULL::INT
          FROM tags WHERE active = 1 AND contains(tag_name, '.')""",
    "upsert_plcs": """SELECT coalesce(p.plc_id, 25 + row_number() OVER (PARTITION BY p.plc_id IS NULL ORDER BY arrival))::INT AS plc_id,
          coalesce(p.name, i.name) AS name, coalesce(i.endpoint_url, p.endpoint_url) AS endpoint_url,
          coalesce(i.security_policy, p.security_policy) AS security_policy
        FROM plcs p FULL JOIN (SELECT name, 'opc.tcp://10.1.0.' || max(s_suppkey) || ':4840' AS endpoint_url, 'None' AS security_policy,
            min(s_suppkey) AS arrival FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'NATION_' || (s_suppkey % 40) ELSE s_name END AS name
            FROM supplier) GROUP BY 1) i ON i.name = p.name""",
    "sync_tags": "SELECT * FROM synced",
    "tag_data_types": """SELECT t.tag_id, coalesce(f.data_type, t.data_type) AS data_type FROM tags t LEFT JOIN
        (SELECT tag_id, arg_min(data_type, id) AS data_type FROM live WHERE data_type <> 'Null' GROUP BY 1) f ON f.tag_id = t.tag_id""",
    "first_names": "SELECT plc_id, node_id, arg_min(tag_name, seq) AS tag_name FROM discovered GROUP BY 1, 2",
    "display_names": """SELECT tag_id, CASE WHEN tag_id % 10 = 0 THEN node_id ELSE tag_name END AS display_name
        FROM tags WHERE active = 1 AND enabled = 1""",
    "add_missing_column": "SELECT tag_id, active, 1 AS enabled FROM tags",
    "reading_bounds": """SELECT 'all' AS source, max(id) AS max_id, min(ts_utc) AS min_ts FROM readings
        UNION ALL SELECT 'none', coalesce(max(id), 0), coalesce(min(ts_utc), -1) FROM readings WHERE id < 0""",
    "csv_stats": "SELECT * FROM plc_stats",
    "window_stats": "SELECT * FROM windows",
    "closed_window_stats": f"SELECT * FROM windows WHERE partition_start < {_LAST_CLOSED}",
    "run_totals": """SELECT (SELECT sum(row_count) FROM plc_stats)::BIGINT AS exported_rows, (SELECT count(*) FROM plc_stats) AS files,
        count(*) FILTER (outcome = 'ok') AS uploaded, count(*) FILTER (outcome = 'failed') AS failed FROM window_outcomes""",
    "last_export_upload": """SELECT (SELECT max(exported_at) FROM export_state) AS last_export, (SELECT max(uploaded_at) FROM export_state) AS last_upload,
        max(exported_at) AS last_window_export, max(uploaded_at) AS last_window_upload FROM manifest""",
    "prune_watermark": f"""SELECT 'both' AS source, greatest({_BACKUP}, {_UPLOADED_ID}) AS watermark UNION ALL SELECT 'backup', {_BACKUP}
        UNION ALL SELECT 'windows', {_UPLOADED_ID} UNION ALL SELECT 'none', 0""",
    "partition_export": f"""SELECT ts_utc, ts_received_utc, plc_name, tag_name, value, value_text, quality, ts_utc // {W} * {W} AS partition_start
        FROM named WHERE ts_utc >= {DAY_0 + 10 * DAY} AND ts_utc < {_LAST_CLOSED}""",
    "csv_rolling": _CSV,
    "csv_window": f"{_CSV} WHERE ts_utc BETWEEN {START} AND {END}",
    "snapshot": """SELECT 'readings' AS table_name, count(*) AS row_count, max(id) AS max_id FROM readings
        UNION ALL SELECT 'tags', count(*), NULL FROM tags UNION ALL SELECT 'plcs', count(*), NULL FROM plcs
        UNION ALL SELECT 'parquet_partitions', count(*), NULL FROM manifest
        UNION ALL SELECT 'export_state', count(*), NULL FROM export_state UNION ALL SELECT 'settings', count(*), NULL FROM settings""",
    "snapshot_watermark": """SELECT key, CASE WHEN key = 'backup_uploaded_reading_id' THEN (SELECT max(id)::VARCHAR FROM readings) ELSE value END AS value
        FROM settings""",
    "record_partition": _recorded(
        "old_manifest",
        f"""(SELECT ts_utc // {W} * {W} AS partition_start, count(*) AS row_count, max(id) AS max_reading_id FROM named
             WHERE ts_utc >= {DAY_0 + 20 * DAY} AND quality <> 2 GROUP BY 1)""",
        "2024-01-31T06:00:00.000Z",
    ),
    "overlapping_partitions": f"""SELECT DISTINCT a.partition_start, a.partition_hours FROM resized a JOIN resized b
        ON a.partition_start < b.partition_start + b.partition_hours * 3600000
        AND b.partition_start < a.partition_start + a.partition_hours * 3600000 AND a.partition_start <> b.partition_start""",
    "pending_partitions": """SELECT partition_start, file_name, max_reading_id FROM manifest WHERE uploaded_at IS NULL AND local_deleted = 0""",
    "mark_partitions": _uploaded("SELECT * FROM manifest", "2024-01-31T06:00:00.000Z", keep=False),
    "kept_partitions_cleanup": f"""SELECT * REPLACE (CASE WHEN uploaded_at IS NOT NULL AND partition_start < {CUTOFF} THEN 1 ELSE local_deleted END
        AS local_deleted) FROM manifest""",
    "record_export": _recorded_exports("old_export"),
    "pending_uploads": """SELECT plc_id, file_name, file_path, last_reading_id FROM export_state
        WHERE last_reading_id > uploaded_reading_id OR status = 'UploadFailed'""",
    "mark_uploads": _sent("SELECT * FROM export_state"),
    "cursor_set": f"SELECT key, CASE WHEN key = 'parquet_export_cursor' THEN ({_LAST_CLOSED})::VARCHAR ELSE value END AS value FROM settings",
    "backup_watermark": "SELECT 'backup_uploaded_reading_id' AS key, max(id)::VARCHAR AS value FROM readings",
    "prune_by_age": f"SELECT * FROM readings WHERE ts_utc >= {CUTOFF}",
    "prune_uploaded": f"SELECT * FROM readings WHERE ts_utc >= {CUTOFF} OR id > {_BACKUP}",
    "prune_listed": f"SELECT * FROM readings WHERE ts_utc >= {CUTOFF}",
    "prune_safe": f"""SELECT r.* FROM readings r LEFT JOIN manifest m ON m.partition_start = ts_utc // {W} * {W} AND m.uploaded_at IS NOT NULL
        WHERE NOT (ts_utc < {CUTOFF} AND id <= coalesce(max_reading_id, -1))""",
    "prune_stored": f"SELECT * FROM readings WHERE ts_utc >= {CUTOFF + 7 * 3600000} OR id > {_BACKUP}",
    "retention_sweep": " UNION ALL ".join([
        _SWEEP.format("age binds", f"ts_utc >= {CUTOFF} OR id > greatest({_BACKUP}, {_UPLOADED_ID})"),
        _SWEEP.format("id binds", f"ts_utc >= {CUTOFF} OR id > {_BACKUP}"), _SWEEP.format("nothing uploaded", "true"),
        _SWEEP.format("upload off", f"ts_utc >= {CUTOFF}"), _SWEEP.format("keep all", "true"),
    ]),
    "deadband_batch": _deadband(_STORED, _GATE),
    "ingest_batch": _deadband(_LIVE_ROWS, _GATE),
    "ingest_exempt_booleans": _deadband(_LIVE_ROWS, f"{_GATE} AND data_type <> 'Boolean'"),
    "deadband_segments": f"""SELECT id, tag_id, value, prev_value, anchor, sum(anchor::INT) OVER (PARTITION BY tag_id ORDER BY id)::BIGINT AS segment FROM (
        SELECT id, tag_id, value, lag(value) OVER w AS prev_value,
          coalesce(NOT abs(value - lag(value) OVER w) < 2 * band * (1 + 1e-12), true) AS anchor
        FROM (SELECT r.*, band FROM readings r JOIN bands b ON b.tag_id = r.tag_id WHERE value IS NOT NULL AND quality = 0)
        WINDOW w AS (PARTITION BY tag_id ORDER BY id))""",
    "change_only": _changed("readings"),
    "sample_interval": f"""SELECT tag_id, interval_start, id, ts_utc, ts_received_utc, value, value_text, quality FROM (
        SELECT *, ts_utc // {W} * {W} AS interval_start, row_number() OVER (PARTITION BY tag_id, ts_utc // {W} ORDER BY id DESC) AS n FROM readings)
        WHERE n = 1""",
    "queue_last_n": f"""SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY tag_id, ts_utc // {DAY} ORDER BY id DESC) AS n FROM readings)
        WHERE n <= 2""",
    "stream_closed_windows": f"""SELECT ts_utc // {W} * {W} AS partition_start, count(*) AS row_count, max(id) AS max_reading_id FROM live
        GROUP BY 1 HAVING ts_utc // {W} * {W} + {W} <= (SELECT max(ts_utc) FROM live)""",
    "change_stream": _changed("(SELECT * EXCLUDE (plc_name) FROM live)"),
    "stream_health": "SELECT plc_name, count(*) AS samples, max(ts_received_utc) AS last_sample_ms FROM live GROUP BY 1",
    "compact_stored": "SELECT * FROM readings",
    "stream_silent_plcs": f"""SELECT * FROM (WITH fed AS (SELECT * FROM live WHERE ts_utc < {DAY_0 + 20 * DAY} OR NOT starts_with(plc_name, 'I'))
      SELECT plc_name, count(*) AS samples, max(ts_utc) + {DAY} <= (SELECT max(ts_utc) FROM fed) - 3600000 AS silent FROM fed GROUP BY 1)""",
    "stream_window_report": f"""SELECT * FROM (WITH filed AS (
        SELECT id, ts_utc, ts_utc // {W} * {W} AS w, CASE WHEN d < 10 THEN 0 WHEN d < 16 THEN 2 WHEN d < 21 THEN 1 ELSE 3 END AS k
        FROM (SELECT *, (ts_utc - {DAY_0}) // {DAY} AS d FROM live)
      ), marks AS (
        SELECT k, coalesce((SELECT max(ts_utc) FROM filed f WHERE f.k < m.k) - 3600000, 0) AS mark FROM range(5) AS m(k)
      ), seen AS (SELECT filed.*, w + {W} <= mark AS late FROM filed JOIN marks USING (k))
      SELECT w AS partition_start, count(*) FILTER (NOT late) AS row_count, max(id) FILTER (NOT late) AS max_reading_id,
             count(*) FILTER (late) AS late_rows
      FROM seen WHERE w + {W} <= (SELECT mark FROM marks WHERE k = 4) GROUP BY 1)""",
    "stream_first_type": "SELECT tag_id, arg_min(data_type, id) AS data_type FROM live WHERE data_type <> 'Null' GROUP BY 1",
    "late_readings": f"SELECT * FROM readings WHERE {_HALF}",
    "late_windows": f"SELECT ts_utc // {W} * {W} AS partition_start, count(*) AS late_rows FROM readings WHERE {_HALF} GROUP BY 1",
    "stream_late_report": f"""SELECT id, tag_id, ts_utc, ts_utc // {W} * {W} AS partition_start FROM live WHERE ts_utc < {DAY_0 + 20 * DAY}""",
    "health_plcs": "SELECT * FROM plc_figures",
    "health_summary": f"""{_ACCEPTED} SELECT 'a/b:c' AS site, count(*) FILTER ({_WRITTEN}) AS readings_written,
        {iso(f'max(ts_received_utc) FILTER ({_WRITTEN})')} AS last_write, greatest(0, count(*) - count(*) FILTER ({_WRITTEN})) AS buffer_depth,
        (SELECT max(exported_at) FROM export_state) AS last_export, (SELECT max(uploaded_at) FROM export_state) AS last_upload FROM accepted""",
    "write_totals": "SELECT count(*) AS readings_written, max(ts_received_utc) AS last_write_ms FROM readings",
    "connection_state": "SELECT * FROM connections",
    "health_snapshot": """SELECT c.*, f.last_sample, coalesce(f.discovered_tags, 0) AS discovered_tags, coalesce(f.monitored_tags, 0) AS monitored_tags
        FROM connections c LEFT JOIN plc_figures f ON f.name = c.plc_name""",
    "backlog": f"""{_ACCEPTED} SELECT count(*) AS accepted, count(*) FILTER ({_WRITTEN}) AS written,
        greatest(0, count(*) - count(*) FILTER ({_WRITTEN})) AS backlog FROM accepted""",
    "discover_tags": "SELECT plc_name, node_id, tag_name FROM found",
    "discovery_sync": f"""SELECT
        coalesce(t.tag_id, (SELECT max(tag_id) FROM tags) + row_number() OVER (PARTITION BY t.tag_id IS NULL ORDER BY f.plc_id, f.node_id))::INT AS tag_id,
        coalesce(t.plc_id, f.plc_id) AS plc_id, coalesce(t.node_id, f.node_id) AS node_id, coalesce(f.tag_name, t.tag_name) AS tag_name,
        coalesce(t.data_type, 'Unknown') AS data_type, t.units, t.deadband_override, coalesce(t.first_seen_at, '{AS_OF}') AS first_seen_at,
        CASE WHEN f.node_id IS NOT NULL THEN '{AS_OF}' ELSE t.last_seen_at END AS last_seen_at,
        CASE WHEN f.node_id IS NOT NULL THEN 1 ELSE 0 END AS active, coalesce(t.enabled, 1) AS enabled
        FROM tags t FULL JOIN (SELECT plc_id, f.node_id, f.tag_name FROM found f JOIN plcs p ON p.name = f.plc_name) f
        ON f.plc_id = t.plc_id AND f.node_id = t.node_id""",
    "partition_cycle": _uploaded(
        _recorded("old_manifest", f"(SELECT * FROM windows WHERE partition_start >= {DAY_0 + 10 * DAY} AND partition_start < {_LAST_CLOSED})", AS_OF),
        AS_OF, keep=False,
    ),
    "csv_run": _sent(_recorded_exports("export_state")),
    "window_csv_run": f"""SELECT plc_id, plc_name, count(*) AS row_count, max(id) AS max_reading_id, {iso('arg_min(ts_utc, id)')} AS period_start,
        {iso('arg_max(ts_utc, id)')} AS period_end,
        '{SITE}-' || plc_name || '-{{}}_{{}}.csv' AS file_name FROM named WHERE ts_utc BETWEEN {START} AND {END} GROUP BY 1, 2""".format(
        "202401060000", "202401130000"
    ),
}
_TEXTS["latest_n_sql"] = _TEXTS["latest_n"]
_TEXTS["stored_range_scan"] = _TEXTS["scan_range_half_open"]
_TEXTS["deadband_sharded"] = _TEXTS["deadband_resumed"] = _TEXTS["deadband_batch"]
_TEXTS["stream_ingest"] = _TEXTS["ingest_batch"]
_TEXTS["deadband_stream"] = _TEXTS["ingest_exempt_booleans"]
_TEXTS["partition_cycle_settings"] = _TEXTS["cursor_set"]
_TEXTS["partition_cycle_keep"] = f"""SELECT * REPLACE (CASE WHEN uploaded_at IS NOT NULL AND partition_start < {CUTOFF} THEN 1 ELSE local_deleted END
    AS local_deleted) FROM ({_uploaded(_recorded("old_manifest", f"(SELECT * FROM windows WHERE partition_start >= {DAY_0 + 10 * DAY} AND partition_start < {_LAST_CLOSED})", AS_OF), AS_OF, keep=True)})"""

ORACLES: dict[str, str] = {name: _with(text) for name, text in _TEXTS.items()}
